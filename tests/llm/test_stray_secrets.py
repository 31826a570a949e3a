"""Credentials outside the base patterns do not keep themselves, or others, from being found."""

import math
import random
from collections import Counter

import pytest

from sequela.llm import secrets


def hexes(rng, n, size=20):
    """Of a size that the base pattern for hex does not take."""
    return ["".join(rng.choices("0123456789abcdef", k=size - 2)) + "a7" for _ in range(n)]


def ordinary(rng, n):
    return [f"{rng.choice(['chapter', 'section', 'appendix'])}-{rng.randrange(10, 99)}-{rng.choice(['overview', 'exercise'])}"
            for _ in range(n)]


@pytest.mark.parametrize("bare", [1, 4, 10])
def test_bare_credential_of_a_learned_format_is_found(spark, bare):
    rng = random.Random(5)
    keyed, loose, other = hexes(rng, 200), hexes(rng, bare), ordinary(rng, 300)
    texts = [f"password={v}" for v in keyed] + [f"see {v} there" for v in loose + other] + ["internationalisation of words"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secrets.learn(docs)
    spans = {r.doc_id: r.spans for r in secrets.scan(docs, found).collect()}
    hit = sum(spans[200 + i] == f"format:4:{4 + len(v)}" for i, v in enumerate(loose))
    assert hit >= 0.9 * bare
    assert not any("format" in spans[200 + bare + i] for i in range(len(other)))
    masked = {r.doc_id: r.text for r in secrets.redacted(docs, found).collect()}
    assert sum(masked[200 + i] == "see [SECRET] there" for i in range(bare)) == hit


def test_few_stray_credentials_do_not_move_the_least_score():
    rng = random.Random(6)
    keyed, other = {"assign": hexes(rng, 200)}, ordinary(rng, 300)
    without = secrets.formats(keyed, other)
    few = secrets.formats(keyed, other + hexes(rng, 8))
    assert few.least["assign"] == pytest.approx(without.least["assign"], abs=0.1)


def test_fewer_than_twenty_examples_have_no_automaton():
    rng = random.Random(7)
    assert not secrets.formats({"assign": hexes(rng, 19)}, []).kinds
    assert secrets.formats({"assign": hexes(rng, 20)}, []).kinds


def test_scores_cover_base_values_and_bare_candidates(spark):
    rng = random.Random(8)
    keyed, loose, other = hexes(rng, 200), hexes(rng, 3), ordinary(rng, 300)
    texts = [f"password={v}" for v in keyed] + [f"see {v} there" for v in loose + other]
    texts += [f"token: {keyed[0]} or {other[0]} or {loose[0]}", "no candidate", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    formats = secrets.learn(docs)
    rows = {r.doc_id: r for r in secrets.scan(docs, formats).collect()}

    def plainly(value):
        """The ratio under the only automaton, arc by arc."""
        def walk(automaton):
            state, total = automaton.start, 0.0
            for c in [secrets.CLASS[x] for x in value] + [secrets.END]:
                arc = automaton.arcs.get(state, {}).get(c) if state != -1 else None
                state, p = arc if arc else (-1, automaton.floor)
                total += math.log(max(p, automaton.floor))
            return total / (len(value) + 1)
        return walk(formats.kinds["assign"]) - walk(formats.plain)

    for i, v in enumerate(keyed):
        assert rows[i].n_scored == 1 and rows[i].least_score == pytest.approx(plainly(v))
    several = sorted(map(plainly, (keyed[0], other[0], loose[0])))
    mixed = rows[len(texts) - 4]
    assert (mixed.n_scored, mixed.least_score, mixed.greatest_score) == (3, pytest.approx(several[0]), pytest.approx(several[2]))
    assert all((rows[i].n_scored, rows[i].least_score) == (0, None) for i in range(len(texts) - 3, len(texts)))
    # Credentials and ordinary tokens lie on either side of the least score.
    assert sum(plainly(v) >= formats.least["assign"] for v in keyed) >= 180
    assert not any(plainly(v) >= formats.least["assign"] for v in other)


def test_tokens_outside_spans_equal_a_comparison_with_every_span():
    rng = random.Random(9)
    for _ in range(200):
        text = " ".join(rng.choice(["api_key=" + "x1" * 9, "a1" * 14, "AKIA" + "Z9" * 10, "plain-token-number-7", "w"])
                        + rng.choice(["", ".", "/tail"]) for _ in range(12))
        spans = secrets.base_spans(text)
        want = [m[0] for m in secrets.TOKEN.finditer(text)
                if not any(s < m.end() and m.start() < e for s, _, e, _ in spans)]
        assert [m[0] for m in secrets.outside(text, spans)] == want


def test_overlong_values_are_scored_but_not_learned_from(spark):
    rng = random.Random(10)
    long = "xb12" * 5000  # too long to learn from, and no hex
    texts = [f"password={v}" for v in hexes(rng, 60)] + [f"password={long}", f"see {long} there"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    formats = secrets.learn(docs)
    rows = {r.doc_id: r for r in secrets.scan(docs, formats).collect()}
    assert rows[60].n_assign == 1 and rows[60].n_scored == rows[61].n_scored == 1
    assert rows[60].least_score == pytest.approx(rows[61].least_score)


def test_few_examples_score_but_add_no_span(spark):
    rng = random.Random(11)
    keyed = hexes(rng, 12)
    texts = [f"password={v}" for v in keyed] + [f"see {hexes(rng, 1)[0]} there"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    formats = secrets.learn(docs)
    assert not formats.kinds and list(formats.few) == ["assign"]
    rows = {r.doc_id: r for r in secrets.scan(docs, formats).collect()}
    assert all(r.n_scored == 1 and r.least_score is not None and r.n_format == 0 for r in rows.values())


def test_every_value_is_learned_from(spark):
    """More values than were once sampled, long ones too: the automata are those of a plain version over all of them."""
    rng = random.Random(12)
    keyed = sorted({*hexes(rng, 2980, 9), *("".join(rng.choices("GH019", k=300)) for _ in range(20))})
    keyed = keyed[len(keyed) % 5:]
    other = sorted(set(ordinary(rng, 400)) | {f"chapter-{i}-" + "x" * 240 for i in range(30)})
    texts = [f"password={v}" for v in keyed] + [f"see {v} there" for v in other]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:50])), "doc_id long, text string")
    by_hash = lambda values: [r.v for r in spark.createDataFrame([(v,) for v in values], "v string").selectExpr("v", "xxhash64(v) AS h").orderBy("h").collect()]
    found, plain = secrets.learn(docs), secrets.formats({"assign": by_hash(keyed)}, by_hash(other))
    passed = {k: Counter(step for v in some for step in secrets._walked({s: {c: to for c, (to, _) in arcs.items()} for s, arcs in a.arcs.items()}, secrets.shape(v)))
              for k, a, some in (("assign", found.kinds["assign"], by_hash(keyed)[:len(keyed) * 4 // 5]), ("plain", found.plain, other))}
    assert list(found.kinds) == ["assign"] and len(keyed) > 2900
    for kind, a, b in (("assign", found.kinds["assign"], plain.kinds["assign"]), ("plain", found.plain, plain.plain)):
        assert a.arcs.keys() == b.arcs.keys()
        for state, arcs in a.arcs.items():
            size = sum(n for (s, _), n in passed[kind].items() if s == state)
            assert {c: to for c, (to, _) in arcs.items()} == {c: to for c, (to, _) in b.arcs[state].items()}
            assert all(p == pytest.approx(passed[kind][state, c] / size) for c, (_, p) in arcs.items())
    assert found.least == pytest.approx(plain.least)
