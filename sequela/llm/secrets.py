"""Secrets in texts: fixed patterns, and formats learned by merging prefix-tree states.

The base patterns give spans of three kinds. Their values are labelled credentials: all of them are
counted into a prefix tree of character classes, and states whose continuations agree statistically
(Hoeffding bound) are merged into a probabilistic automaton for each kind. Every
candidate, base values included, is scored by the mean log likelihood of its format against that of
ordinary tokens. Tokens outside base spans that score as real credentials do become spans of kind
``format``; base spans always stay, with their scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequela.llm.common import few_rows, release, staged

KINDS = ("assign", "access", "hex", "format")
NODES = 100_000
"""Prefixes of a kind that are told apart on the driver, at most. Values under any other are counted all the same."""
SHARED = 2
"""A prefix that one value alone has differs from no state (the bound is above 1): it takes values as many as these."""
LEAST_EXAMPLES = 20
"""A kind with fewer usable values has an automaton that scores but adds no spans, and no quantile is taken of
fewer scores: of the fifth held out, a 5 % quantile would be one value or none."""
STRAY = 10
"""Tokens outside base spans that look like credentials are set aside up to this many, or a tenth of all."""

# The base patterns.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
HINTS = ("pass", "secret", "token", "api")

Span = tuple[int, str, int]  # start, kind, end


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, value) of the base patterns, by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), "assign", m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), "hex", m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


# ── Automata ─────────────────────────────────────────────────────────────────────────────────


class _Classes(dict):
    def __missing__(self, c: str) -> str:
        self[c] = out = ("9" if c.isdigit() else "h" if c in "abcdef" else "l" if c.islower() else "U" if c.isupper() else c)
        return out


CLASS = _Classes()
END = "$"


@dataclass
class Automaton:
    """Probabilities of the next class (or the end) for each state, and the state it leads to."""

    start: int = 0
    arcs: dict[int, dict[str, tuple[int, float]]] = field(default_factory=dict)
    floor: float = 1e-4

    def likelihood(self, token: str) -> float:
        """Mean log probability of a character of the token's format, its end included."""
        return self.fit(shape(token))

    def fit(self, form: str) -> float:
        """The same of a format."""
        state, total = self.start, 0.0
        for c in form + END:
            state, p = self.arcs.get(state, {}).get(c, (-1, self.floor)) if state >= 0 else (-1, self.floor)
            total += math.log(max(p, self.floor))
        return total / (len(form) + 1)


def shape(value: str) -> str:
    """The value's format: the class of each character."""
    return "".join(map(CLASS.__getitem__, value))


def _steps(form: str):
    """(prefix, class that follows, longer prefix) along a format and its end; prefixes are 64-bit numbers, the empty one 0."""
    at = 0
    for c in form + END:
        after = ((at ^ (at >> 31)) * 0x9E3779B97F4A7C15 + ord(c) * 0xC2B2AE3D27D4EB4F + 1) & 0x7FFFFFFFFFFFFFFF
        yield at, c, after
        at = after


def _tree(rows) -> dict[int, dict[str, list]]:
    """Rows (prefix, class, longer prefix, values) -> state -> class -> [next, count], states numbered level by level."""
    below: dict[int, list] = {}
    for at, c, after, n in rows:
        below.setdefault(at, []).append((c, after, n))
    tree: dict[int, dict[str, list]] = {0: {}}
    todo = [(0, 0)]
    for at, state in todo:
        for c, after, n in sorted(below.get(at, ())):
            if c == END:
                tree[state][c] = [-1, n]
            else:
                tree[state][c] = [len(tree), n]
                todo.append((after, len(tree)))
                tree[len(tree)] = {}
    return tree


def _merged(tree: dict[int, dict[str, list]], alpha: float = 0.05) -> dict[int, dict[str, int]]:
    """State merging: red and blue states of a prefix tree compared by the Hoeffding bound on the
    frequencies of what follows, compatible ones folded together. State -> class -> next state."""
    size = lambda s: sum(a[1] for a in tree[s].values())
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(p: int, q: int, depth: int = 0) -> bool:
        n, m = size(p), size(q)
        if not n or not m:
            return False
        limit = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        for c in tree[p].keys() | tree[q].keys():
            if abs(tree[p].get(c, (0, 0))[1] / n - tree[q].get(c, (0, 0))[1] / m) > limit:
                return True
        return depth < 8 and any(differ(tree[p][c][0], tree[q][c][0], depth + 1)
                                 for c in tree[p].keys() & tree[q].keys() if c != END)

    def fold(p: int, q: int) -> None:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            if p == q:
                continue
            for c, (to, n) in tree[q].items():
                if c in tree[p]:
                    tree[p][c][1] += n
                    if c != END:
                        todo.append((tree[p][c][0], to))
                else:
                    tree[p][c] = [to, n]

    red = [0]
    while True:
        known = set(red)
        blue = [(size(a[0]), s, c, a[0]) for s in red for c, a in tree[s].items() if c != END and a[0] not in known]
        if not blue:
            break
        _, parent, c, state = max(blue, key=lambda b: (b[0], -b[3]))
        for r in red:
            if not differ(r, state):
                tree[parent][c][0] = r
                fold(r, state)
                break
        else:
            red.append(state)
    return {s: {c: to for c, (to, _) in tree[s].items()} for s in red}


def _walked(arcs: dict[int, dict[str, int]], form: str):
    """(state, class) along a format and its end. What no arc takes goes on from the start, as prefixes of one value do."""
    state = 0
    for c in form + END:
        yield state, c
        state = arcs.get(state, {}).get(c, 0)


def _weighted(arcs: dict[int, dict[str, int]], passed: dict[tuple[int, str], int]) -> Automaton:
    """The automaton whose probabilities are the shares of all values that pass an arc."""
    size: Counter = Counter()
    for (s, _), n in passed.items():
        size[s] += n
    out = Automaton()
    for (s, c), n in sorted(passed.items()):
        out.arcs.setdefault(s, {})[c] = (-1 if c == END else arcs.get(s, {}).get(c, 0), n / size[s])
    return out


def infer(tokens: list[str]) -> Automaton:
    """States from the prefixes that several tokens share, probabilities from all tokens."""
    forms = [shape(t) for t in tokens]
    nodes: Counter = Counter()
    for form in forms:
        nodes.update(_steps(form))
    shared = {0} | {after for (_, c, after), n in nodes.items() if n >= SHARED and c != END}
    arcs = _merged(_tree([(*node, n) for node, n in nodes.items() if node[0] in shared]))
    return _weighted(arcs, Counter(step for form in forms for step in _walked(arcs, form)))


@dataclass
class Formats:
    """An automaton for each kind, one of ordinary tokens, and each kind's least score.

    ``few`` holds kinds with fewer than ``LEAST_EXAMPLES`` values: they score, but have no least score.
    """

    kinds: dict[str, Automaton] = field(default_factory=dict)
    few: dict[str, Automaton] = field(default_factory=dict)
    plain: Automaton = field(default_factory=Automaton)
    least: dict[str, float] = field(default_factory=dict)

    def score(self, token: str, kind: str) -> float:
        return (self.kinds.get(kind) or self.few[kind]).likelihood(token) - self.plain.likelihood(token)

    def scores(self, token: str) -> dict[str, float]:
        """The score under every automaton; a token's format is read once by each."""
        plain = self.plain.likelihood(token)
        return {k: a.likelihood(token) - plain for k, a in (self.kinds | self.few).items()}

    def accepts(self, scores: dict[str, float]) -> bool:
        return any(s >= self.least.get(k, math.inf) for k, s in scores.items())


def candidate(token: str) -> bool:
    """Credentials mix digits and letters."""
    return any("0" <= c <= "9" for c in token) and any(c.isalpha() for c in token)


def outside(text: str, spans: list[tuple]):
    """Tokens that touch none of the spans (by start), in one pass over both."""
    at, reach = 0, 0
    for m in TOKEN.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][2])
            at += 1
        if reach <= m.start():
            yield m


def _examples(batches):
    for batch in few_rows(batches):
        kinds, values = [], []
        for text in batch.column(0).to_pylist():
            text = text or ""
            spans = base_spans(text)
            found = {(kind, value) for _, kind, _, value in spans}
            found |= {("plain", m[0]) for m in outside(text, spans)}
            for kind, value in found:
                kinds.append(kind)
                values.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["kind", "value"])


def _shapes(batches):
    for batch in few_rows(batches):
        values = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([shape(v) for v in values], pa.string()), pa.array([candidate(v) for v in values]), batch.column(2)],
            ["kind", "form", "candidate", "h"])


HELD_ROWS = 100_000
"""Counts that a task holds before it hands them on."""


def _nodes(batches):
    """Rows kind, form -> how many values take each step of their kind's prefix tree."""
    def counted(found):
        kind, at, c, after = map(list, zip(*found)) if found else ([], [], [], [])
        return pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.string()), "at": pa.array(at, pa.int64()), "class": pa.array(c, pa.string()),
                                           "after": pa.array(after, pa.int64()), "n": pa.array(list(found.values()), pa.int64())})

    found: dict[tuple, int] = {}
    for batch in few_rows(batches):
        for kind, form in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for step in _steps(form):
                step = (kind, *step)
                found[step] = found.get(step, 0) + 1
                if len(found) >= HELD_ROWS:
                    yield counted(found)
                    found = {}
    yield counted(found)


def _passed(arcs: dict[str, dict[int, dict[str, int]]]):
    """Rows kind, form -> how many values pass each arc of their kind's states."""
    def run(batches):
        found: Counter = Counter()
        for batch in few_rows(batches):
            for kind, form in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for step in _walked(arcs[kind], form):
                    found[kind, *step] += 1
        yield pa.RecordBatch.from_pydict({"kind": pa.array([k for k, _, _ in found], pa.string()), "state": pa.array([s for _, s, _ in found], pa.int64()),
                                          "class": pa.array([c for _, _, c in found], pa.string()), "n": pa.array(list(found.values()), pa.int64())})
    return run


def _inferred(rows: DataFrame, kinds: list[str]) -> dict[str, Automaton]:
    """:func:`infer` over rows (kind, form), for each of the kinds. Of more than ``NODES`` shared prefixes of a
    kind those with most values become states."""
    if not kinds:
        return {}
    steps = rows.select("kind", "form").mapInArrow(_nodes, "kind string, at long, class string, after long, n long")
    nodes = staged(steps.groupBy("kind", "at", "class", "after").agg(F.sum("n").alias("n")), "prefixes")
    inner = nodes.where((F.col("class") != END) & (F.col("n") >= SHARED))
    sizes: dict[str, list] = {}
    for r in inner.groupBy("kind", "n").agg(F.count(F.lit(1)).alias("many")).collect():
        sizes.setdefault(r["kind"], []).append((r["n"], r["many"]))
    arcs = {}
    for kind in kinds:
        least, room = SHARED, NODES
        for n, many in sorted(sizes.get(kind, ()), reverse=True):
            room -= many
            if room < 0:
                least = n + 1
                break
        mine = nodes.where(F.col("kind") == kind).select("at", "class", "after", "n")
        shared = mine.where((F.col("class") != END) & (F.col("n") >= least)).select(F.col("after").alias("at"))
        met = mine.join(F.broadcast(shared.unionByName(rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("at")))), "at", "left_semi")
        table = met.select("at", "class", "after", "n").toArrow()
        arcs[kind] = _merged(_tree(zip(*(table.column(i).to_pylist() for i in range(4)))))
    passed: dict[str, dict] = {k: {} for k in kinds}
    counts = rows.select("kind", "form").mapInArrow(_passed(arcs), "kind string, state long, class string, n long")
    for r in counts.groupBy("kind", "state", "class").agg(F.sum("n").alias("n")).collect():
        passed[r["kind"]][r["state"], r["class"]] = r["n"]
    release(nodes)
    return {k: _weighted(arcs[k], passed[k]) for k in kinds}


def _fitted(automata: dict[str, Automaton]):
    """Rows kind, form, candidate -> kind, form, candidate and the likelihood under each automaton."""
    def run(batches):
        for batch in few_rows(batches):
            forms = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array([a.fit(f) for f in forms], pa.float64()) for a in automata.values())],
                ["kind", "form", "candidate", *(f"fit_{k}" for k in automata)])
    return run


def _fits(rows: DataFrame, automata: dict[str, Automaton]) -> DataFrame:
    return rows.select("kind", "form", "candidate").mapInArrow(
        _fitted(automata), "kind string, form string, candidate boolean" + "".join(f", fit_{k} double" for k in automata))


ACCURACY = 100_000
"""Of quantiles over values: one place in so many may be off."""


def _low(score, n: int, share: int):
    """:func:`low` of ``n`` scores as an aggregate."""
    return F.percentile_approx(score, (n // share + 0.5) / n, ACCURACY)


def learn(docs: DataFrame) -> Formats:
    """:func:`formats` of the corpus' own base matches and all tokens outside them, each distinct value once.

    All of them are learned from, in tasks: the driver gets at most ``NODES`` prefixes of a kind with what follows them. The
    fifth of a kind's candidates with the largest hashes is held out.
    """
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_examples, "kind string, value string").distinct()
    values = staged(rows.withColumn("h", F.xxhash64("value")).mapInArrow(_shapes, "kind string, form string, candidate boolean, h long"), "examples")
    good = F.when(F.col("candidate"), F.col("h"))
    facts = {r["kind"]: r for r in values.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count(good).alias("good"), F.percentile_approx(good, 0.8, ACCURACY).alias("cut")).collect()}
    labelled = [k for k in ("assign", "access", "hex") if k in facts and facts[k]["good"]]
    kinds = [k for k in labelled if facts[k]["good"] >= LEAST_EXAMPLES]
    cut = F.col("candidate") & (F.col("kind") != "plain")
    for k in kinds:
        cut = cut & ((F.col("kind") != k) | (F.col("h") <= facts[k]["cut"]))
    found = _inferred(values.where(cut), labelled)
    out = Formats({k: found[k] for k in kinds}, {k: found[k] for k in labelled if k not in kinds})

    held = values.where(F.col("candidate") & F.col("kind").isin(kinds) & ~cut)
    own = F.coalesce(*[F.when(F.col("kind") == k, F.col(f"fit_{k}")) for k in kinds]) if kinds else None
    sizes = {k: facts[k]["good"] - math.ceil(facts[k]["good"] * 0.8) for k in kinds}

    def quantile(scored: DataFrame, score) -> dict[str, float]:
        if not kinds:
            return {}
        each = scored.agg(*[_low(F.when(F.col("kind") == k, score), sizes[k], 20).alias(k) for k in kinds]).first()
        return {k: each[k] for k in kinds}

    fits = quantile(_fits(held, out.kinds), own)
    n_plain = facts["plain"]["n"] if "plain" in facts else 0
    stray = F.lit(False)
    for k in kinds:
        stray = stray | (F.col("fit_" + k) >= fits[k])
    plain = staged(_fits(values.where(F.col("kind") == "plain"), out.kinds).select("kind", "form", "candidate", (F.col("candidate") & stray).alias("stray")), "plain")
    n_stray = plain.where("stray").count()
    if n_stray <= max(STRAY, n_plain // 10):
        rest, n_plain = plain.where(~F.col("stray")), n_plain - n_stray
    else:
        rest = plain
    if n_plain:
        out.plain = _inferred(rest, ["plain"])["plain"]

    every = out.kinds | {"plain": out.plain}
    least = quantile(_fits(held, every), own - F.col("fit_plain")) if kinds else {}
    ordinary = rest.where("candidate")
    n_ordinary = ordinary.count() if kinds else 0
    if n_ordinary >= LEAST_EXAMPLES:
        most = _fits(ordinary, every).agg(*[_low(F.col("fit_plain") - F.col(f"fit_{k}"), n_ordinary, 20).alias(k) for k in kinds]).first()
    for k in kinds:
        out.least[k] = max(least[k], 0.0)
        if n_ordinary >= LEAST_EXAMPLES:
            out.least[k] = max(out.least[k], -most[k] + 1e-9)
    release(values, plain)
    return out


def low(scores: list[float], share: int) -> float:
    """The value below which one in ``share`` of the scores lies."""
    return sorted(scores)[len(scores) // share]


def formats(values: dict[str, list[str]], plain: list[str]) -> Formats:
    """Automata and least scores from credentials of each kind and tokens outside base spans.

    Among the latter are credentials that no base pattern has. Those that fit a kind's automaton as
    well as 95 % of its held-out values do are set aside while they are few, so that they neither
    train the automaton of ordinary tokens nor raise a least score. Where they are many, they are an
    ordinary format of these texts and stay. A least score is the largest of the 5 % quantile of held-out
    values, 0 and the 95 % quantile of ordinary candidates.
    """
    out, held, fits = Formats(), {}, {}
    for kind, every in values.items():
        good = [v for v in every if candidate(v)]
        if len(good) < LEAST_EXAMPLES:
            if good:
                out.few[kind] = infer(good)
            continue
        train, held[kind] = good[: len(good) * 4 // 5], good[len(good) * 4 // 5:]
        out.kinds[kind] = infer(train)
        fits[kind] = low([out.kinds[kind].likelihood(v) for v in held[kind]], 20)
    stray = {v for v in plain if candidate(v) and any(out.kinds[k].likelihood(v) >= fits[k] for k in fits)}
    if len(stray) <= max(STRAY, len(plain) // 10):
        plain = [v for v in plain if v not in stray]
    if plain:
        out.plain = infer(plain)
    ordinary = [v for v in plain if candidate(v)]
    for kind in out.kinds:
        least = max(low([out.score(v, kind) for v in held[kind]], 20), 0.0)
        if len(ordinary) >= LEAST_EXAMPLES:
            least = max(least, -low([-out.score(v, kind) for v in ordinary], 20) + 1e-9)
        out.least[kind] = least
    return out


def scanned(text: str, formats: Formats) -> tuple[list[Span], list[Span], list[float]]:
    """(base spans, all spans, scores) of a text, in order.

    A base value is scored by its own kind's automaton, or by the one that fits it best where its kind
    has none; any other candidate by the one that fits it best. Without automata nothing is scored:
    then no base value of these texts mixes digits and letters.
    """
    found = base_spans(text)
    base = [(s, k, e) for s, k, e, _ in found]
    more, scores = [], []
    if formats.kinds or formats.few:
        for _, kind, _, value in found:
            if kind in formats.kinds or kind in formats.few:
                scores.append(formats.score(value, kind))
            else:
                scores.append(max(formats.scores(value).values()))
        for m in outside(text, found):
            if candidate(m[0]):
                each = formats.scores(m[0])
                scores.append(max(each.values()))
                if formats.accepts(each):
                    more.append((m.start(), "format", m.end()))
    return base, sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[1]))), scores


SCANNED = ("doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS)
           + ", base string, spans string, n_scored long, least_score double, greatest_score double")


def _found(formats: Formats):
    def run(batches):
        for batch in batches:
            n = {k: [] for k in KINDS}
            base_text, all_text, scored = [], [], []
            for text in batch.column(1).to_pylist():
                base, every, scores = scanned(text or "", formats)
                count = Counter(k for _, k, _ in every)
                for k in KINDS:
                    n[k].append(count[k])
                base_text.append(",".join(f"{k}:{s}:{e}" for s, k, e in base))
                all_text.append(",".join(f"{k}:{s}:{e}" for s, k, e in every))
                scored.append((len(scores), min(scores, default=None), max(scores, default=None)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(n[k], pa.int64()) for k in KINDS), pa.array(base_text, pa.string()),
                 pa.array(all_text, pa.string()), pa.array([s[0] for s in scored], pa.int64()),
                 *(pa.array([s[i] for s in scored], pa.float64()) for i in (1, 2))],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "n_scored", "least_score", "greatest_score"])
    return run


def scan(docs: DataFrame, formats: Formats) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_format, base, spans, n_scored, least_score,
    greatest_score`` for every row; spans as ``kind:start:end`` in code points, scores over all
    candidates of the text, base values included (null where there is none). A null text is empty; null
    doc_ids and repeated rows stay."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_found(formats), SCANNED)


MASK = "[SECRET]"


def masked(text: str | None, formats: Formats) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for s, _, e in scanned(text, formats)[1]:
        if e <= at:
            continue
        out += [text[at:s], MASK] if s >= at else []
        at = e
    return "".join([*out, text[at:]])


def _masked(formats: Formats, text_at: int, chars_at: int | None):
    def run(batches):
        for batch in few_rows(batches):
            columns = list(batch.columns)
            texts = [masked(t, formats) for t in columns[text_at].to_pylist()]
            columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            if chars_at is not None:
                columns[chars_at] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
    return run


def redacted(docs: DataFrame, formats: Formats) -> DataFrame:
    """The documents with every secret replaced by ``[SECRET]`` (and ``n_chars`` to match); no row goes."""
    names = docs.columns
    return docs.mapInArrow(_masked(formats, names.index("text"), names.index("n_chars") if "n_chars" in names else None), docs.schema)
