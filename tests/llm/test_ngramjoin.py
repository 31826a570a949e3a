"""The shingle join against all pairs, on short texts, copies, ties and odd tables."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sequela.llm import ngramjoin, pieces, secrets, toxicity
from sequela.llm.common import mix, staged
from sequela.llm.ngramjoin import Similarity, _close_members, _close_pairs, may_be_similar, similar
from tests.llm.test_whole_queries import brute_groups


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    out = {0: None, 1: "", 2: " \n\t", 3: "one", 4: "ONE", 5: "one two three"}
    passage = " ".join(rng.choices(words, k=60))
    for i in range(6, 260):
        base = rng.choices(words, k=rng.choice([2, 3, 4, 5, 6, 8, 12, 20, 40, 90, 200]))
        out[i] = " ".join(base)
        if rng.random() < 0.4:  # a near copy, and copies of it
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out[1000 + i] = " ".join(copy)
        if rng.random() < 0.3:
            out[2000 + i] = f"{passage} {out[i]}"
    return out


@pytest.mark.parametrize("how", [Similarity(5, 80, 100), Similarity(4, 85, 100), Similarity(2, 60, 100)])
@pytest.mark.parametrize("dense", [512, 2])
def test_groups(spark, monkeypatch, how, dense):
    if dense == 2 and how.k != 5:
        pytest.skip("one setting is enough")
    monkeypatch.setattr(ngramjoin, "DENSE", dense)
    monkeypatch.setattr(ngramjoin, "BLOCK", 8 if dense == 2 else 4096)
    rows = texts()
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.groups(docs, how).collect()}
    assert got == brute_groups(rows, how.k, how.num, how.den)


def test_odd_tables(spark):
    long = " ".join(f"x{i}" for i in range(300))
    rows = [(1, long, 1), (1, long, 1), (None, long, 2), (7, long, 3), (8, None, 4), (9, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    assert sorted(map(tuple, ngramjoin.groups(docs).collect()), key=str) == [
        (1, 296, 1), (1, 296, 1), (7, 296, 1), (8, 0, 8), (9, 0, 9), (None, 296, None)]
    kept = ngramjoin.one_of_each(docs).collect()
    assert sorted(r.node for r in kept) == [1, 2, 4, 5]
    # One doc_id with two texts: its near copy goes with its own group, its other text stays.
    other = " ".join(f"y{i}" for i in range(90))
    twice = spark.createDataFrame([(3, long, 1), (5, long + " z", 2), (5, other, 3), (5, other, 4), (6, other + " q", 5), (7, None, 6)],
                                  "doc_id long, text string, _row int")
    assert sorted(r._row for r in ngramjoin.one_of_each(twice).collect()) in ([1, 3, 6], [1, 4, 6])
    assert ngramjoin.groups(docs.limit(0)).collect() == []


@pytest.mark.parametrize("how", [Similarity(5, 80, 100), Similarity(4, 85, 100), Similarity(2, 60, 100)])
def test_bands_do_not_depend_on_the_largest_set_of_a_batch(how):
    most = how.bands(100_000)
    for largest in range(1, 3_000):
        lows = how.bands(largest)
        assert list(lows) == list(most[:len(lows)]) and lows[-2] > largest


def _rows(rng, groups, sets):
    """Rows of groups, sorted: sketches and sets of one band, several blocks and components."""
    rows = []
    for key in range(groups):
        size, blocks = rng.choice([1, 2, 3, 9, 40]), rng.random() < 0.4
        base = rng.sample(range(10_000), 60)
        for node in sorted(rng.sample(range(1_000), size)):
            items = np.array(sorted({*rng.sample(base, 56), *rng.sample(range(10_000), rng.choice([0, 1, 4]))}), np.uint64)
            hashes = np.sort(mix(items, 1))
            who, place, data = ngramjoin.sketches(hashes, np.array([len(hashes)]), Similarity(), 0)
            side = rng.choice([0, 1]) if blocks else 2
            rows.append((key, int(place[0]), node, rng.choice([node, -1 - node % 3]), len(hashes), side, data[0], hashes.tobytes() if sets else None))
    return sorted(rows, key=lambda r: r[:2])


def _batches(rows, cuts):
    names = ["key", "band", "node", "root", "n", "side", "sketch", "items"]
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary(), pa.binary()]
    edges = [0, *sorted(cuts), len(rows)]
    for a, b in zip(edges, edges[1:]):
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[a:b]], kind) for k, kind in enumerate(kinds)], names)


def _allowed(rows, how):
    """Pairs of each group that meet, are in different components and pass size and sketch."""
    out = {}
    for x in rows:
        for y in rows:
            if x[:2] == y[:2] and x[2] < y[2] and x[3] != y[3] and (x[5] == 2 or x[5] != y[5]):
                n, data = np.array([x[4], y[4]]), np.frombuffer(x[6] + y[6], np.uint8).reshape(2, -1)
                if how.den * n.min() >= how.num * n.max() and may_be_similar(n, data, 0, np.array([1]), how)[0]:
                    out.setdefault(x[:2], []).append((x, y))
    return out


def _parts(rows, pairs):
    """Components of a group's rows by their roots and the given pairs."""
    root = {r[2]: r[3] for r in rows}
    for a, b in pairs:
        x, y = root[a], root[b]
        root = {k: x if v == y else v for k, v in root.items()}
    groups = {}
    for k, v in root.items():
        groups.setdefault(v, set()).add(k)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("pairs", [1, 50, 1 << 16])
@pytest.mark.parametrize("sets", [False, True])
def test_pairs_of_groups(monkeypatch, pairs, sets):
    monkeypatch.setattr(ngramjoin, "PAIRS", pairs)
    monkeypatch.setattr(ngramjoin, "SKETCH_BYTES", 200)
    rng, how = random.Random(5), Similarity()
    for _ in range(12):
        rows = _rows(rng, 6, sets)
        cuts = [rng.randrange(len(rows) + 1) for _ in range(rng.randrange(5))]
        allowed = _allowed(rows, how)
        links = {k: [(x[2], y[2]) for x, y in v if similar(np.frombuffer(x[7], np.uint64), np.frombuffer(y[7], np.uint64), how)]
                 for k, v in allowed.items()} if sets else None
        for turn in (None, 0, 1):
            got = [tuple(r.values()) for out in _close_pairs(how, turn)(_batches(rows, cuts)) for r in out.to_pylist()]
            if turn is None and not sets:
                assert sorted(got) == sorted((x[2], y[2], False) for v in allowed.values() for x, y in v)
                continue
            assert all(sure == sets for _, _, sure in got)
            named = 0
            for key in {r[:2] for r in rows}:
                members = [r for r in rows if r[:2] == key]
                may = {(x[2], y[2]) for x, y in allowed.get(key, [])} if not sets else set(links.get(key, []))
                # A forest that joins what all pairs would join; batches carry no key, so each group is run by itself.
                alone = [tuple(r.values())[:2] for out in _close_pairs(how, turn)(_batches(members, [])) for r in out.to_pylist()]
                named += len(alone)
                assert set(alone) <= may and _parts(members, alone) == _parts(members, may)
                assert len(alone) == len({r[3] for r in members}) - len(_parts(members, alone))
            assert named == len(got)


@pytest.mark.parametrize("pairs", [1, 50, 1 << 16])
def test_members_that_need_their_sets(monkeypatch, pairs):
    """Only members that sketches leave in a pair go on, and their sets give the same components."""
    monkeypatch.setattr(ngramjoin, "PAIRS", pairs)
    rng, how = random.Random(7), Similarity()
    dropped = 0
    for _ in range(12):
        rows = _rows(rng, 6, True)
        cuts = [rng.randrange(len(rows) + 1) for _ in range(rng.randrange(5))]
        kept = [tuple(r.values()) for out in _close_members(how)(_batches(rows, cuts)) for r in out.to_pylist()]
        wanted = {r for v in _allowed(rows, how).values() for pair in v for r in pair}
        assert len(kept) == len(wanted) and set(kept) == wanted
        dropped += len(rows) - len(kept)
        for key in {r[:2] for r in rows}:
            members = [r for r in rows if r[:2] == key]
            found = [[tuple(r.values())[:2] for out in _close_pairs(how)(_batches([m for m in part if m[:2] == key], [])) for r in out.to_pylist()]
                     for part in (members, kept)]
            assert _parts(members, found[0]) == _parts(members, found[1])
    assert dropped


def test_texts_become_sets_a_megabyte_at_a_time():
    """The arrays made on the way take many times the texts' bytes, in each of an executor's Python workers."""
    texts = [" ".join(f"w{i * j % 977}" for j in range(400)) for i in range(2000)]
    runs = list(ngramjoin.sets_of(pa.array(texts), Similarity(), 0))
    assert [r[0] for r in runs] == [0, *[r[1] for r in runs[:-1]]] and runs[-1][1] == len(texts)
    assert max(sum(map(len, texts[first:end])) for first, end, *_ in runs) <= 1 << 20
    whole = [s for r in runs for s in r[3].tolist()]
    assert whole == [s for t in texts for r in ngramjoin.sets_of(pa.array([t]), Similarity(), 0) for s in r[3].tolist()]


def test_staged_bounds_the_rows_of_a_python_step(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    found = [r.n for r in staged(spark.range(0, 5000, 1, 2).mapInArrow(sizes, "n long"), "sizes", 700).collect()]
    assert sum(found) == 5000 and max(found) == 700 and spark.conf.get(setting) == before


def test_staged_bounds_the_bytes_of_a_python_step(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('x', 2000) AS text")
    found = [r.n for r in staged(rows.mapInArrow(sizes, "n long"), "sizes", 2000).collect()]
    assert sum(found) == 3000 and max(found) * 2000 <= 1 << 20 and spark.conf.get(setting) == before


def test_every_python_step_of_the_join_is_bounded(spark, monkeypatch):
    bounds = []

    def seen(df, name, batch=None):
        if "MapInArrow" in df._jdf.queryExecution().simpleString():
            bounds.append((name, batch))
        return staged(df, name, batch)

    monkeypatch.setattr(ngramjoin, "staged", seen)
    ngramjoin.one_of_each(spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g h")], "doc_id long, text string")).collect()
    assert {name for name, _ in bounds} >= {"digests", "members", "sketches", "stars", "sets", "similar", "forest", "close", "dense"}
    assert all(batch for _, batch in bounds)


def test_sets_are_made_a_quarter_of_a_megabyte_at_a_time():
    texts = [" ".join(f"w{i * j % 977}" for j in range(100)) for i in range(3000)]
    runs = list(ngramjoin.sets_of(pa.array(texts), Similarity(), 0))
    assert sum(r[1] - r[0] for r in runs) == len(texts)
    assert max(sum(map(len, texts[first:end])) for first, end, *_ in runs) <= 1 << 18


def test_steps_that_make_python_objects_take_few_rows():
    texts = [f"text {i}" for i in range(1234)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1234), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    steps = [toxicity._scored(toxicity.Lexicon(), 1), secrets._masked(secrets.Formats(), 1, None), pieces._plain_rows(pieces.default_model())]
    for step in steps:
        out = list(step(iter([batch])))
        assert max(b.num_rows for b in out) <= 500
        assert [x for b in out for x in b.column(0).to_pylist()] == list(range(1234))
    for step in steps[:2]:
        assert [x for b in step(iter([batch])) for x in b.column(1).to_pylist()] == texts


@pytest.mark.parametrize("size", [2, 7, 8, 85, 300])
def test_sketches_by_words_tell_the_least_number_of_elements(size):
    rng, how = np.random.default_rng(size), Similarity()
    sketch = np.tile(rng.integers(0, 256, size, dtype=np.uint8), (40, 1))
    for row in sketch:
        some = rng.integers(0, size, rng.integers(0, size + 1))
        row[some] = rng.integers(0, 256, len(some))
    n = rng.integers(size, 9 * size, 40)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(40)))
    tables, place = ngramjoin._sketch_tables(sketch.ravel(), np.arange(41) * size)
    got = ngramjoin._sketches_agree(tables, place, np.full(40, size), n, i, j, how)
    assert got.tolist() == [bool(may_be_similar(n, sketch, a, np.array([b]), how)[0]) for a, b in zip(i, j)]
