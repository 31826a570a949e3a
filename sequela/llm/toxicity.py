"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding lower-cases, turns look-alike letters of other scripts and full-width forms into Latin ones,
and digits and signs that stand for letters into those letters; everything that is no letter becomes
a space. The lexicon holds words and word beginnings with weights (log odds of toxic against clean
documents), learned from labelled rows, and exception phrases in which an entry does not count. A
document's score is the logistic of the sum of its hits' weights over the logarithm of its length.

Learning reads a bounded sample (``SAMPLE`` labelled rows, those with the smallest hashes); scoring
goes over every whole text in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequela.llm.common import few_rows

SAMPLE = 20_000
"""Labelled rows the lexicon is learned from, at most."""

ENTRIES = 2_000
"""Entries and exception phrases of the lexicon, at most."""

CANDIDATES = 20_000
LEAST_DOCS, LEAST_ODDS, BEGINNINGS = 3, 2.0, range(4, 8)

# Letters that look like Latin ones, and what digits and signs stand for.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ɡ": "g", "ӏ": "l", "ո": "n", "ս": "u",
    "α": "a", "ο": "o", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i",
}


class _Fold(dict):
    def __missing__(self, point: int):
        char = chr(point)
        if 0xFF01 <= point <= 0xFF5E:
            char = chr(point - 0xFEE0).lower()
        char = LOOKALIKES.get(char, char)
        out = char if char.isalpha() else None if point in (0xAD, 0x200B, 0x200C, 0x200D, 0xFEFF) else " "
        self[point] = out
        return out


FOLD = _Fold()
TRAILING = re.compile(r"[!|]+(?=\s|$)")


def folded(text: str | None) -> str:
    """Words of the text with single spaces around and between."""
    text = (text or "").lower()
    if "!" in text or "|" in text:  # signs that end a word are punctuation, not letters
        text = TRAILING.sub(" ", text)
    return f" {' '.join(text.translate(FOLD).split())} "


@dataclass
class Lexicon:
    """``entries``: " word " or " beginning" to weight. ``exceptions``: phrases " a b " whose hits do not
    count. Score = 1 / (1 + exp(-slope * (x - cut))) with x the normalised sum."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slope: float = 4.0
    cut: float = 0.5

    def machine(self):
        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(phrase, (phrase, None))
        for entry, weight in self.entries.items():
            if entry not in self.exceptions:
                found.add_word(entry, (entry, weight))
        found.make_automaton()
        return found if len(found) else None

    def raw(self, text: str, machine) -> float:
        """Sum of the weights of the words hit, each at the best of its entries, over log2(2 + words)."""
        if machine is None:
            return 0.0
        best, spared = {}, []
        for end, (entry, weight) in machine.iter(text):
            start = end - len(entry) + 1
            if weight is None:
                spared.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if spared:
            best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in spared)}
        return sum(best.values()) / math.log2(1 + text.count(" ")) if best else 0.0

    def score(self, x: float) -> float:
        z = max(-60.0, min(60.0, self.slope * (x - self.cut)))
        return 1.0 / (1.0 + math.exp(-z))


def _keys(text: str) -> set[str]:
    """What could be an entry: every word, and every beginning of a longer word."""
    words = set(text.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in BEGINNINGS if len(w) >= n}


def _counts(batches):
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            (toxic if label else clean).update(_keys(folded(text)))
    keys = list(toxic.keys() | clean.keys())
    for i in range(0, len(keys), 50_000):
        part = keys[i:i + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.string()), pa.array([toxic[k] for k in part], pa.int64()), pa.array([clean[k] for k in part], pa.int64())],
            ["entry", "a", "b"])


def _hits(entries: dict[str, float]):
    """Per sampled document: label, words, entries hit and the two-word phrases around them."""
    lexicon = Lexicon(entries)

    def run(batches):
        machine = lexicon.machine()
        for batch in batches:
            rows = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = folded(text)
                hit, phrases = {}, set()
                for end, (entry, _) in (machine.iter(text) if machine else ()):
                    start = end - len(entry) + 1
                    hit.setdefault(entry, start)
                    stop = text.index(" ", start + 1)
                    after = text.find(" ", stop + 1)
                    before = text.rfind(" ", 0, start) if start else -1
                    if after > 0:
                        phrases.add((entry, text[start:after + 1]))
                    if before >= 0:
                        phrases.add((entry, text[before:stop + 1]))
                rows.append((int(label), list(hit), [p for _, p in phrases],
                             [e for e, _ in phrases], text.count(" ") - 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in (
                    (0, pa.int32()), (1, pa.list_(pa.string())), (2, pa.list_(pa.string())), (3, pa.list_(pa.string())), (4, pa.int64()))],
                ["label", "hit", "phrases", "of", "words"])
    return run


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """A lexicon from ``labels`` (doc_id, toxic) and the texts of ``docs``.

    Rows with a null label or doc_id are left out, and those whose crc32(doc_id) mod 5 is 0 are held
    out. Without toxic examples the lexicon is empty.
    """
    ids = F.col("doc_id").cast("long")
    known = (labels.select(ids.alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
             .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = (docs.select(ids.alias("doc_id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(known), "doc_id").select("text", "toxic"))  # at most ``sample`` ids
    from sequela.llm.common import release, staged

    rows = staged(rows, "labelled")
    n = dict(rows.groupBy("toxic").count().collect())
    nt, nc = sum(v for k, v in n.items() if k), n.get(0, 0)
    if not nt:
        return Lexicon()
    counted = rows.mapInArrow(_counts, "entry string, a long, b long").groupBy("entry").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    odds = F.log((F.col("a") + 0.5) / (nt + 1.0)) - F.log((F.col("b") + 0.5) / (nc + 1.0))
    kept = (counted.where(F.col("a") >= LEAST_DOCS).withColumn("w", odds).where(F.col("w") >= LEAST_ODDS)
            .orderBy(F.desc(F.col("a") * F.col("w")), "entry").limit(CANDIDATES).collect())
    weight = {r["entry"]: (r["w"], r["b"]) for r in kept}
    told = rows.mapInArrow(_hits({e: w for e, (w, _) in weight.items()}),
                           "label int, hit array<string>, phrases array<string>, of array<string>, words long").collect()  # the sample
    release(rows)
    entries = _cover([set(r["hit"]) for r in told if r["label"]], weight, nt, nc)
    toxic_phrases = Counter(p for r in told if r["label"] for p in r["phrases"])
    clean_phrases = Counter(p for r in told if not r["label"] for p, e in set(zip(r["phrases"], r["of"])) if e in entries)
    exceptions = tuple(sorted(p for p, c in clean_phrases.items() if c >= LEAST_DOCS and not toxic_phrases[p]))[:ENTRIES]
    lexicon = Lexicon(entries, exceptions)
    # The cut: between the normalised sums of clean and toxic rows, where most are on their side.
    x = np.array([sum(entries.get(e, 0.0) for e in _longest(r["hit"], entries)) / math.log2(2 + r["words"]) for r in told])
    y = np.array([bool(r["label"]) for r in told])
    levels = np.unique(x)
    cuts = np.append(levels[:-1] + np.diff(levels) / 2, levels[-1] + 0.5) if len(levels) else np.array([0.5])
    right = [(y & (x > c)).sum() / nt + (~y & (x <= c)).sum() / max(1, nc) for c in cuts]
    lexicon.cut = float(cuts[int(np.argmax(right))])
    lexicon.slope = 2.0 / max(lexicon.cut, 0.05)
    return lexicon


def _longest(hit, entries) -> list[str]:
    """Entries hit that count: of several for the same word the weightiest (by beginning)."""
    best: dict[str, str] = {}
    for e in hit:
        if e in entries:
            key = e[1:5]
            if key not in best or entries[e] > entries[best[key]]:
                best[key] = e
    return list(best.values())


def _cover(docs: list[set], weight: dict, nt: int, nc: int) -> dict[str, float]:
    """Entries chosen one by one, each for the toxic documents that no other explains yet."""
    where: dict[str, set] = {}
    for i, hit in enumerate(docs):
        for e in hit:
            where.setdefault(e, set()).add(i)
    total = {e: len(ds) for e, ds in where.items()}
    least = max(LEAST_DOCS, nt // 150)
    chosen: dict[str, float] = {}
    gain = {e: len(ds) - weight[e][1] * nt / max(1, nc) * 20 for e, ds in where.items()}
    while gain and len(chosen) < ENTRIES:
        e = max(gain, key=lambda k: (gain[k], len(k.strip()), k))
        if gain[e] < least:
            break
        new = where[e]
        chosen[e] = round(weight[e][0], 6)
        for other in list(gain):
            both = len(where[other] & new)
            if both:
                where[other] = where[other] - new
                gain[other] -= both
        gain.pop(e)
    # Entries that go with the chosen ones: frequent and never clean, though their documents are explained.
    # The share keeps out words that a few copies of one document repeat.
    for e, (w, b) in weight.items():
        if b == 0 and total[e] >= max(LEAST_DOCS, nt // 50) and len(chosen) < ENTRIES:
            chosen.setdefault(e, round(w, 6))
    # A beginning that stands for little more than one longer entry goes: it only reaches into other words.
    longer = sorted(chosen, key=len, reverse=True)
    for e in longer[::-1]:
        if any(len(o) > len(e) and o.startswith(e) and total.get(o, 0) >= 0.95 * total.get(e, 0) for o in longer if o in chosen):
            del chosen[e]
    return chosen


def _scored(lexicon: Lexicon, at: int):
    def run(batches):
        machine = lexicon.machine()
        for batch in few_rows(batches):
            scores = [lexicon.score(lexicon.raw(folded(t), machine)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())],
                                             schema=batch.schema.append(pa.field("_score", pa.float64())))
    return run


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` with ``_score`` from 0 to 1. Null and empty texts have no hits and score as any text
    without hits does."""
    from pyspark.sql.types import StructType

    schema = StructType(list(docs.schema.fields)).add("_score", "double")
    return docs.mapInArrow(_scored(lexicon, docs.columns.index("text")), schema)
