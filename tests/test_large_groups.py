"""Quantiles, buckets and rates on groups above the limits, against the plain ways."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sequela.operators import describe as D
from sequela.operators import ordered as O
from sequela.operators import providers as P


@pytest.fixture
def frame(spark):
    rng = np.random.default_rng(3)
    rows = [(["a", "b", None][int(k)], float(v), float(v) if u < 0.9 else None, int(t), i)
            for i, (k, v, u, t) in enumerate(zip(rng.integers(0, 3, 4000), rng.normal(size=4000).round(2), rng.random(4000), rng.integers(0, 9, 4000)))]
    return spark.createDataFrame(rows, "k string, v double, w double, t int, id int")


def test_quantiles_shuffle_only_the_neighbourhood(frame, hot, monkeypatch):
    """A group above the limit takes brackets and never the count of all values; null keys and one group's lone nulls included."""
    monkeypatch.setattr(O, "_counted", lambda *a: pytest.fail("all values were counted"))
    want = {r.k: r for r in frame.groupBy("k").agg(F.percentile("w", F.array(*map(F.lit, [0.0, 0.25, 0.5, 1.0]))).alias("w"), F.percentile("t", 0.3).alias("t")).collect()}
    none = frame.limit(1).select(F.lit("none").alias("k"), "v", F.lit(None).cast("double").alias("w"), "t", "id")
    with hot(100):
        got = {r.k: r for r in O.quantiles(frame, ["k"], {"w": [0.0, 0.25, 0.5, 1.0], "t": [0.3]}).collect()}
        assert set(got) == {"a", "b", None}
        for k, r in got.items():
            assert np.allclose(r.q_w, want[k].w) and np.allclose(r.q_t, [want[k].t])
        one = O.quantiles(frame, [], {"w": [0.5]}).first()
        assert one.q_w[0] == pytest.approx(frame.agg(F.percentile("w", 0.5)).first()[0])
    with hot(0):
        assert O.quantiles(none, [], {"w": [0.5]}).first().q_w == [None]


def test_quantiles_outside_their_bracket_are_counted(frame, hot, monkeypatch):
    """A sketch too coarse for its bracket costs time, not the result."""
    real = F.percentile_approx
    monkeypatch.setattr(O.F, "percentile_approx", lambda c, ps, n: F.transform(real(c, ps, n), lambda x: x + 1))
    with hot(100):
        got = O.quantiles(frame, [], {"v": [0.25, 0.5]}).first()
    assert np.allclose(got.q_v, frame.agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5)))).first()[0])


@pytest.mark.parametrize("lead", ["t", "v", "w", "id"])
def test_buckets_by_value(frame, hot, lead):
    """Few values, many, nulls and distinct ones give the buckets that a full sort gives."""
    order = [F.col(lead), F.col("id")]
    want = {r.id: r.q for r in O.ntile(frame, ["k"], order, 4, "q").collect()}
    with hot(100):
        got = O.ntile(frame, ["k"], order, 4, "q", lead)
        assert got.columns == [*frame.columns, "q"] and {r.id: r.q for r in got.collect()} == want


@pytest.mark.parametrize("providers", [0, 10])
def test_rates_of_many_cells(spark, monkeypatch, providers):
    """One join on the provider gives what the joins on provider and unit and on provider give."""
    rows = spark.createDataFrame(
        [(i, i % 7 if i % 11 else None, f"u{i % 3}" if i % 5 else None, "explicit" if i % 4 else "inferred", i % 2) for i in range(200)]
        + [(500, 99, "u1", "inferred", 1), (501, 3, "new", "inferred", 1)],
        "id int, provider_id int, unit string, source string, failed int")
    want = P.with_fallback_rate(rows, P.rate_tables(rows))
    monkeypatch.setattr(P, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(P, "BROADCAST_PROVIDERS", providers)
    got = P.with_fallback_rate(rows, P.rate_tables(rows))
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_box_stats_of_few_and_many_groups(frame, monkeypatch):
    want = sorted(map(str, D.box_stats(frame, ["k"], "v").collect()))
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert sorted(map(str, D.box_stats(frame, ["k"], "v").collect())) == want


@pytest.mark.parametrize("cells", [4, 50, 4096])
def test_features_counted_together(monkeypatch, cells):
    """Sums by node and bin from shared cells, over blocks taken as one, are those of every feature by itself."""
    from sequela.operators import boosting as B

    monkeypatch.setattr(B, "CELLS", cells)
    rng = np.random.default_rng(1)
    codes = np.concatenate([rng.integers(0, 5, (1, 400)), rng.integers(0, 3, (1, 400)), np.eye(4, 3, dtype=int)[rng.integers(0, 4, 400)].T, rng.integers(0, 2, (1, 400))]).astype(np.uint8)
    blocks = []
    for a, b in ((0, 150), (150, 400)):
        block = B._Block.__new__(B._Block)
        block.group, block.n, block.rows, block.fold = 0, b - a, np.arange(a, b), np.zeros(b - a, np.int16)
        block.codes, block.targets, block.scores = codes[:, a:b], np.zeros((1, b - a)), np.zeros((1, b - a))
        blocks.append(block)
    place = np.array([0, 5, 8, 10, 12, 14, 16])
    work = B._Work(B._Block.joined(blocks), place, 2, [(2, 5)])
    node, weight = rng.integers(0, 3, 400), rng.normal(size=400)
    got = work.histogram(work.counted(node, 3, [weight], work.cells), 3)
    for f in range(6):
        for n in range(3):
            for v in range(int(place[f + 1] - place[f])):
                here = (node == n) & (codes[f] == v)
                assert got[0, n, place[f] + v] == here.sum() and got[1, n, place[f] + v] == pytest.approx(weight[here].sum(), abs=1e-12)
    assert all(np.prod(widths) <= cells or len(widths) == 1 for widths, _ in work.groups)


def test_permuted_pairs_are_made_once(spark, monkeypatch):
    """The random partners are written once and read by every later step."""
    from sequela.operators import predict as R

    made = []
    real = R.staged
    monkeypatch.setattr(R, "staged", lambda df, name: made.append(name) or real(df, name))
    rows = spark.createDataFrame([(i, float(i % 13), float(i % 5), int(i % 13 > 6)) for i in range(300)], "id int, a double, b double, y int")
    got = {r.feature: r for r in R.permutation_importance(rows, ["a", "b"], lambda v: v["a"] + 0 * v["b"], "y", ["id"]).collect()}
    assert made == ["permuted", "permuted-areas"]
    assert got["a"].auc_loss > 0.2 and got["b"].auc == pytest.approx(1.0)
