"""Order-dependent operators against brute force, with and without heavy keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sequela.operators import ordered as O
from sequela.operators.joins import band_join, lookup


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = []
    for i in range(400):
        key = 1 if rng.random() < 0.4 else rng.randrange(2, 9)
        key = None if rng.random() < 0.05 else key
        data.append((key, rng.randrange(50), i, None if rng.random() < 0.3 else rng.randrange(100)))
    return data


SCHEMA = "k long, t long, id long, v long"


def by_key(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


def test_running_values(spark, rows, both):
    df = spark.createDataFrame(rows, SCHEMA)
    out = O.running(
        df, ["k"], [F.col("t"), F.col("id")],
        {"s": ("sum", "v"), "n": ("count", F.lit(1)), "lo": ("min", "v"), "hi": ("max", "v"),
         "last": ("last", "v"), "prev": ("lag", "v"), "next": ("lead", "v")},
        {"total": ("sum", "v")},
    ).collect()
    got = {r.id: r for r in out}
    assert len(out) == len(rows)
    for group in by_key(rows).values():
        seen = []
        total = sum(r[3] for r in group if r[3] is not None)
        for i, (_, _, rid, v) in enumerate(group):
            if v is not None:
                seen.append(v)
            r = got[rid]
            assert r.n == i + 1
            assert r.s == (sum(seen) if seen else None)
            assert r.lo == (min(seen) if seen else None)
            assert r.hi == (max(seen) if seen else None)
            assert r.last == (seen[-1] if seen else None)
            assert r.prev == (group[i - 1][3] if i else None)
            assert r.next == (group[i + 1][3] if i + 1 < len(group) else None)
            assert r.total == total


def test_running_without_keys_excludes_current(spark, rows, both):
    df = spark.createDataFrame(rows, SCHEMA)
    out = O.running(df, [], [F.col("id").desc()], {"s": ("sum", "v")}, inclusive=False).collect()
    got = {r.id: r.s for r in out}
    acc = None
    for r in sorted(rows, key=lambda r: -r[2]):
        assert got[r[2]] == acc
        if r[3] is not None:
            acc = (acc or 0) + r[3]


def test_row_order_does_not_matter(spark, rows, both):
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    order = [F.col("t"), F.col("id")]
    a, b = (
        sorted(O.neighbours(spark.createDataFrame(x, SCHEMA), ["k"], order, ["id", "v"])
               .select("id", "prev_id", "next_id").collect())
        for x in (rows, shuffled)
    )
    assert a == b


@pytest.mark.parametrize("buckets", [1, 4, 7])
def test_ntile(spark, rows, both, buckets):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r.q for r in O.ntile(df, ["k"], [F.col("t"), F.col("id")], buckets, "q").collect()}
    for group in by_key(rows).values():
        base, extra = divmod(len(group), buckets)
        want = [b + 1 for b in range(buckets) for _ in range(base + (b < extra))]
        assert [got[r[2]] for r in group] == want


def test_quantiles(spark, rows, both):
    df = spark.createDataFrame(rows, SCHEMA)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: r for r in O.quantiles(df, ["k"], {"v": probs, "t": [0.5]}).collect()}
    for key, group in by_key(rows).items():
        v = [r[3] for r in group if r[3] is not None]
        assert np.allclose(got[key].q_v, np.quantile(v, probs))
        assert np.allclose(got[key].q_t, [np.median([r[1] for r in group])])


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup(spark, rows, both, how):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (50, "c")], "k long, name string")
    out = lookup(spark.createDataFrame(rows, SCHEMA), table, ["k"], how)
    names = {1: "a", 2: "b"}
    want = sorted((r[2], names.get(r[0])) for r in rows if how == "left" or r[0] in names)
    assert sorted((r.id, r.name) for r in out.collect()) == want


@pytest.mark.parametrize("left_span, right_span", [(2000, 2000), (60, 2000), (60, 60)])
def test_band_join(spark, both, left_span, right_span):
    rng = random.Random(9)
    left = [(i, rng.choice([1, 1, 2, 3]), rng.randrange(left_span)) for i in range(60)]
    right = [(i, rng.choice([1, 1, 1, 2]), rng.randrange(right_span)) for i in range(150)]
    lo, hi = -7, 40
    ldf = spark.createDataFrame(left, "a long, k long, lt long").withColumn(
        "lt", F.timestamp_micros("lt"))
    rdf = spark.createDataFrame(right, "b long, k long, rt long").withColumn(
        "rt", F.timestamp_micros("rt"))
    got = sorted((r.a, r.b) for r in band_join(ldf, rdf, ["k"], "lt", "rt", lo, hi).collect())
    want = sorted((a, b) for a, ka, x in left for b, kb, y in right
                  if ka == kb and lo <= y - x <= hi)
    assert got == want


def test_heavy_keys_are_found_from_a_sample(spark):
    df = spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    heavy = O.heavy_keys(df, ["k"], limit=20_000)
    assert [r.k for r in heavy.collect()] == [0]
    assert O.heavy_keys(df.where("k > 0"), ["k"], limit=20_000) is None
