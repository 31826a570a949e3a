"""Estimators against planted values and direct matrix computations."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from sequela.functions import tails
from sequela.operators import dml as X
from sequela.operators import evaluate as V
from sequela.operators import features as N
from sequela.operators import linmod as M
from sequela.operators import msm as W
from sequela.operators import nls as S
from sequela.operators import predict as R
from sequela.operators.logit import fit_logit


def frame(spark, **columns):
    names = list(columns)
    rows = list(zip(*[np.asarray(columns[n]).tolist() for n in names]))
    return spark.createDataFrame(rows, names)


def test_tails():
    assert tails.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert tails.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.t_two_sided(12.706205, 1) == pytest.approx(0.05, abs=1e-6)
    assert tails.f_upper(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.f_upper(2.866081, 4, 20) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_upper(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_upper(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_upper(1.0, 10) == pytest.approx(0.999828, abs=1e-6)


def test_weighted_least_squares(spark):
    rng = np.random.default_rng(1)
    n = 200
    x, z, w = rng.normal(size=n), rng.normal(size=n), rng.uniform(0.5, 3, n)
    y = 1 + 2 * x - z + rng.normal(size=n)
    fit = M.fit_linear(frame(spark, x=x, z=z, w=w, y=y), "y", ["x", "z"], "w")
    a = np.column_stack([np.ones(n), x, z])
    inv = np.linalg.inv(a.T @ (a * w[:, None]))
    b = inv @ a.T @ (w * y)
    rss = (w * (y - a @ b) ** 2).sum()
    assert np.allclose(fit.coef, b)
    assert np.allclose(fit.se, np.sqrt(np.diag(inv) * rss / (n - 3)))
    ybar = (w * y).sum() / w.sum()
    assert fit.r2 == pytest.approx(1 - rss / (w * (y - ybar) ** 2).sum())
    loglik = 0.5 * (np.log(w).sum() - n * (math.log(2 * math.pi) + 1 - math.log(n) + math.log(rss)))
    assert fit.aic == pytest.approx(-2 * loglik + 8)


def test_nested_f_equals_squared_t(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, 80)
    fits, table = M.fit_forms(frame(spark, x=x, y=1 + x + 0.5 * x**2 + rng.normal(0, 0.1, 80)), "y", "x")
    f, df1, df2, p = M.nested_f(fits["linear"], fits["quadratic"])
    row = table.where("model = 'quadratic' and term = 'x^2'").first()
    assert (df1, df2) == (1, 77)
    assert f == pytest.approx(row.t**2, rel=1e-6)
    assert p == pytest.approx(row.p, rel=1e-6)


def test_partial_correlation(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=60)
    x, y = z + rng.normal(size=60), -z + rng.normal(size=60)
    r = M.partial_correlation(frame(spark, x=x, y=y, z=z), "x", "y", "z").first()
    a = np.column_stack([np.ones(60), z])
    rx, ry = (v - a @ np.linalg.lstsq(a, v, rcond=None)[0] for v in (x, y))
    want = np.corrcoef(rx, ry)[0, 1]
    assert r.r == pytest.approx(want)
    assert r.p == pytest.approx(tails.t_two_sided(want * math.sqrt(57 / (1 - want**2)), 57))
    few = M.partial_correlation(frame(spark, x=x[:4], y=y[:4], z=z[:4]), "x", "y", "z").first()
    assert few.n == 4 and few.r is None


@pytest.fixture(scope="module")
def binary(spark):
    rng = np.random.default_rng(4)
    n = 3000
    x, z, g = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 40, n)
    w = rng.uniform(0.5, 2, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(-0.5 + 0.8 * x - 0.3 * z)))).astype(int)
    return frame(spark, x=x, z=z, g=g, w=w, y=y), (x, z, g, w, y)


def test_logit_recovers_and_solves_its_equations(binary):
    df, _ = binary
    fit = fit_logit(df, "y", ["x", "z"], "w", "g")
    assert np.allclose(fit.coef, [-0.5, 0.8, -0.3], atol=0.15)
    assert np.abs(fit.score).max() < 1e-5


def test_logit_covariances(binary):
    df, (x, z, g, w, y) = binary
    fit = fit_logit(df, "y", ["x", "z"], "w", "g")
    a = np.column_stack([np.ones(len(x)), x, z])
    mu = 1 / (1 + np.exp(-a @ fit.coef))
    v = w * mu * (1 - mu)
    bread = np.linalg.inv(a.T @ (a * v[:, None]))
    assert np.allclose(fit.cov["model"], bread)
    e = w * (y - mu)
    h = v * np.einsum("ij,jk,ik->i", a, bread, a)
    s = a * (e / (1 - h))[:, None]
    assert np.allclose(fit.cov["hc3"], bread @ s.T @ s @ bread)
    sums = np.array([(a * e[:, None])[g == k].sum(0) for k in range(40)])
    assert np.allclose(fit.cov["cluster"], bread @ sums.T @ sums @ bread * 40 / 39)


def test_density_weights(spark, both):
    rng = np.random.default_rng(5)
    n = 400
    x = rng.normal(size=n)
    t = 0.6 * x + rng.normal(size=n)
    out = M.density_weights(frame(spark, x=x, t=t), "t", ["x"])
    got = out.rows.toPandas().sort_values("x")
    a = np.column_stack([np.ones(n), x])
    b = np.linalg.lstsq(a, t, rcond=None)[0]
    sd = math.sqrt(((t - a @ b) ** 2).sum() / (n - 2))
    pdf = lambda v, m, s: np.exp(-(((v - m) / s) ** 2) / 2) / s
    raw = pdf(t, t.mean(), t.std(ddof=1)) / pdf(t, a @ b, sd)
    want = np.minimum(raw, np.quantile(raw, 0.99))
    want = (want / want.mean())[np.argsort(x)]
    assert np.allclose(got.sw, want)
    assert got.sw.mean() == pytest.approx(1)
    bal = M.balance(out.rows, "t", ["x"], "sw").first()
    assert abs(bal.r_weighted) < abs(bal.r_unweighted)


def test_structural_model_guards(spark):
    rng = np.random.default_rng(6)
    n = 600
    rate, age = rng.uniform(0, 1, n), rng.normal(size=n)
    df = frame(spark, provider_id=rng.integers(0, 19, n), unit=["u"] * n, rate=rate, age=age,
               flag=[0] * n, died=(rng.random(n) < 0.3).astype(int))
    spec = W.MsmSpec("rate", "died", ("age",), ("flag",))
    assert W.run_group(df, "g", ["u"], spec) is None
    from dataclasses import replace

    found = W.run_groups(df, {"g": ["u"]}, replace(spec, min_providers=19))
    assert len(found) == 1 and found[0].summary["n"] == n
    assert {r.covariance for r in W.results_table(spark, found).collect()} == {"hc3", "cluster"}


def test_saturating_curve(spark):
    rng = np.random.default_rng(7)
    parts = []
    for unit, (m, k) in {"a": (0.4, 60.0), "b": (0.25, 25.0)}.items():
        x = rng.uniform(0.005, 0.12, 300)
        y = m * (1 - np.exp(-k * x)) + rng.normal(0, 0.005, 300)
        parts += [(unit, float(a), float(b), float(w)) for a, b, w in
                  zip(x, y, rng.integers(20, 90, 300))]
    parts += [("tiny", 0.1, 0.2, 1.0)] * 3
    df = spark.createDataFrame(parts, "unit string, x double, y double, w double")
    got = {r.group: r for r in S.fit_saturating(df, "x", "y", "w", "unit").collect()}
    assert set(got) == {"a", "b"}
    for unit, (m, k) in {"a": (0.4, 60.0), "b": (0.25, 25.0)}.items():
        r = got[unit]
        assert r.converged
        assert r.m == pytest.approx(m, rel=0.02) and r.k == pytest.approx(k, rel=0.05)
        x, y, w = np.array([p[1:] for p in parts if p[0] == unit]).T
        e = np.exp(-r.k * x)
        jac = np.column_stack([1 - e, r.m * x * e])
        off = y - r.m * (1 - e)
        a = jac.T @ (jac * w[:, None])
        step = np.linalg.solve(a, jac.T @ (w * off))
        assert np.allclose(step / [r.m, r.k], 0, atol=1e-6)
        se = np.sqrt(np.diag(np.linalg.inv(a)) * (w * off**2).sum() / 298)
        assert np.allclose([r.m_se, r.k_se], se)


def test_curve_without_shape_is_reported(spark):
    df = spark.createDataFrame([(0.0, 1.0, 1.0)] * 20, "x double, y double, w double")
    r = S.fit_saturating(df, "x", "y", "w").first()
    assert not r.converged and r.m is None


def test_variance_components(spark):
    rng = np.random.default_rng(8)
    g = np.repeat(np.arange(200), 30)
    y = rng.normal(0, 1.5, 200)[g] + rng.normal(0, 2, len(g))
    r = M.variance_components(frame(spark, g=g, y=y), "g", "y").first()
    assert r.var_within == pytest.approx(4, rel=0.1)
    assert r.var_between == pytest.approx(2.25, rel=0.3)


def test_areas(spark, both):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 120)
    s = np.round(y * 0.3 + rng.random(120), 1)
    r = V.quality(frame(spark, s=s, y=y), "s", "y").first()
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
    ap, last = 0.0, 0.0
    for c in sorted(set(s), reverse=True):
        hit = s >= c
        recall = (y[hit] == 1).sum() / (y == 1).sum()
        ap += (recall - last) * (y[hit] == 1).mean()
        last = recall
    assert r.auc == pytest.approx(wins)
    assert r.average_precision == pytest.approx(ap)
    assert r.brier == pytest.approx(((s - y) ** 2).mean())


def test_split_and_folds(spark):
    df = spark.range(20_000).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    out = N.stratified_split(df, ["id"], "y")
    got = {(r.y, r.split): r["count"] for r in out.groupBy("y", "split").count().collect()}
    for y, total in ((0, 15_000), (1, 5_000)):
        assert got[(y, "train")] == pytest.approx(0.7 * total, rel=0.02)
        assert got[(y, "test")] == pytest.approx(0.15 * total, rel=0.05)
    assert sorted(out.collect()) == sorted(N.stratified_split(df, ["id"], "y").collect())
    sizes = [r["count"] for r in N.folds(df, ["id"]).groupBy("fold").count().collect()]
    assert len(sizes) == 5 and min(sizes) > 3_700


def test_unseen_categories_and_gaps(spark):
    train = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, None)], "x double, c string")
    model = N.fit_features(train, N.FeatureSpec(("x",), ("x",), ("c",)))
    new = spark.createDataFrame([(None, "zzz"), (3.0, "a")], "x double, c string")
    rows = [r.features.toArray() for r in model.transform(new).collect()]
    logs = np.log1p([1.0, 3.0, 2.0])
    assert rows[0][0] == pytest.approx((math.log1p(2) - logs.mean()) / logs.std())
    assert rows[0][1:].sum() == 1 and rows[1][1:].sum() == 1
    assert len(model.labels()) == len(rows[0])


def test_double_ml_recovers_effect(spark):
    rng = np.random.default_rng(10)
    n = 6000
    x = rng.normal(size=n)
    d = 0.5 * x + rng.normal(size=n)
    y = (rng.random(n) < np.clip(0.5 + 0.08 * d + 0.1 * x, 0, 1)).astype(int)
    df = frame(spark, id=np.arange(n), x=x, d=d, y=y)
    spec = X.DmlSpec("y", "d", N.FeatureSpec(("x",)), ("id",))
    res = X.residuals(df, spec, LogisticRegression, LinearRegression)
    assert res.count() == n
    t = X.theta(res).first()
    assert t.lo < 0.08 < t.hi
    p = res.toPandas()
    theta = (p.d_res * p.y_res).sum() / (p.d_res**2).sum()
    se = math.sqrt(((p.d_res * (p.y_res - theta * p.d_res)) ** 2).sum()) / (p.d_res**2).sum()
    assert t.theta == pytest.approx(theta) and t.se == pytest.approx(se)
    bins = X.binned_means(res).collect()
    assert len(bins) == 21 and sum(b.n for b in bins) == n


def test_permutation_importance(spark, both):
    rng = np.random.default_rng(11)
    n = 400
    a, b = rng.normal(size=n), rng.normal(size=n)
    df = frame(spark, id=np.arange(n), a=a, b=b, y=(a > 0).astype(int))
    out = {r.feature: r for r in R.permutation_importance(
        df, ["a", "b"], lambda v: v["a"] + v["b"] * 0.0, "y", ["id"]).collect()}
    assert out["b"].auc_loss == pytest.approx(0)
    assert out["a"].auc_loss == pytest.approx(0.5, abs=0.1)


def crossed_rows(rng, levels, cells, spread, lumped=True):
    """Rows over a sparse, uneven table of two factors with planted standard deviations; ``lumped`` puts
    half of the cells on one level of the second, whose single effect then decides the moments."""
    a, b = (rng.normal(0, sd, n) for sd, n in zip(spread, levels))
    i, j = rng.integers(0, levels[0], cells), rng.integers(0, levels[1], cells)
    if lumped:
        j *= rng.integers(0, 2, cells)
    n = rng.integers(1, 5, cells)
    i, j = np.repeat(i, n), np.repeat(j, n)
    return i, j, 3 + a[i] + b[j] + rng.normal(0, spread[2], len(i))


def test_crossed_components_equal_the_traces_of_their_quadratic_forms(spark):
    i, j, y = crossed_rows(np.random.default_rng(4), (6, 5), 14, (1.0, 2.0, 0.5))
    z = [(i[:, None] == np.unique(i)).astype(float), (j[:, None] == np.unique(j)).astype(float)]
    n = len(y)
    centre = np.full((n, n), 1 / n)
    forms = [f @ np.linalg.inv(f.T @ f) @ f.T - centre for f in z] + [np.eye(n) - centre]
    parts = [z[0] @ z[0].T, z[1] @ z[1].T, np.eye(n)]
    want = np.linalg.solve([[np.trace(q @ v) for v in parts] for q in forms], [y @ q @ y for q in forms])
    r = M.crossed_components(frame(spark, i=i, j=j, y=y), "i", "j", "y").first()
    assert (r.n_rows, r.n_first, r.n_second) == (n, z[0].shape[1], z[1].shape[1])
    assert r.n_cells == len({*zip(i, j)})
    assert [r.var_first, r.var_second, r.var_rest] == pytest.approx(np.maximum(want, 0).tolist(), rel=1e-9, abs=1e-12)
    assert r.share_first == pytest.approx(r.var_first / (r.var_first + r.var_second + r.var_rest))


def test_crossed_components_recover_planted_variances(spark):
    i, j, y = crossed_rows(np.random.default_rng(5), (400, 300), 30_000, (1.0, 0.5, 2.0), lumped=False)
    r = M.crossed_components(frame(spark, i=i, j=j, y=y), "i", "j", "y").first()
    assert r.var_first == pytest.approx(1.0, rel=0.2)
    assert r.var_second == pytest.approx(0.25, rel=0.3)
    assert r.var_rest == pytest.approx(4.0, rel=0.05)


def test_crossed_components_of_odd_tables(spark):
    schema = "i string, j string, y double"
    rows = [("p", "u", 1.0), ("p", "v", 2.0), (None, "u", 4.0), (None, "v", 3.5), ("q", None, 2.0), ("q", "u", None)]
    r = M.crossed_components(spark.createDataFrame(rows, schema), "i", "j", "y").first()
    assert (r.n_rows, r.n_cells, r.n_first, r.n_second) == (5, 5, 3, 3)
    for few in (rows[:2], rows[:1], [("p", "u", 1.0), ("q", "v", 2.0), ("p", "u", 1.5), ("q", "v", 2.5)], []):
        r = M.crossed_components(spark.createDataFrame(few, schema), "i", "j", "y").first()
        assert r.var_first is None and r.share_first is None and r.n_rows in (len(few), None)


def curve_rows(spark, rng, n, m=0.4, k=40.0, noise=0.02):
    x = rng.uniform(0.005, 0.12, n)
    y = m * (1 - np.exp(-k * x)) + rng.normal(0, noise, n)
    return frame(spark, id=np.arange(n), x=x, y=y, w=rng.integers(20, 90, n)), x, y


def test_resampled_draws_are_poisson_counts(spark):
    rows = spark.range(200_000).withColumn("b", F.lit(3))
    got = dict(rows.select(S.poisson_weight(["id"], "b", 1).alias("c")).groupBy("c").count().collect())
    for count in range(5):
        assert got[count] / 200_000 == pytest.approx(math.exp(-1) / math.factorial(count), abs=0.004)


def test_resampled_fits_equal_fits_of_the_drawn_rows(spark):
    df, x, y = curve_rows(spark, np.random.default_rng(12), 60)
    r = S.resampled_saturating(df, "x", "y", "w", ["id"], replicates=4).first()
    assert (r.n_replicates, r.n_converged) == (4, 4)
    ms, ks = [], []
    for b in range(4):
        times = df.withColumn("b", F.lit(b)).withColumn("w", F.col("w") * S.poisson_weight(["id"], "b", 11)).where("w > 0")
        alone = S.fit_saturating(times, "x", "y", "w").first()
        ms.append(alone.m)
        ks.append(alone.k)
    for got, all_of in (((r.m_lo, r.m_hi), ms), ((r.k_lo, r.k_hi), ks)):
        assert got == pytest.approx(np.quantile(all_of, [0.025, 0.975]).tolist(), rel=1e-3)  # both stop at the same tolerance


def test_resampled_intervals_cover_and_repeat(spark):
    rng = np.random.default_rng(13)
    inside = 0
    for _ in range(3):
        df, _, _ = curve_rows(spark, rng, 150)
        r = S.resampled_saturating(df, "x", "y", "w", ["id"], replicates=60).first()
        assert r.m_lo < r.m < r.m_hi and r.k_lo < r.k < r.k_hi
        inside += (r.m_lo <= 0.4 <= r.m_hi) + (r.k_lo <= 40 <= r.k_hi)
    assert inside >= 4  # of 6
    again = S.resampled_saturating(df.repartition(7), "x", "y", "w", ["id"], replicates=60).first()
    assert list(r) == pytest.approx(list(again), rel=1e-9)


def test_resampled_curve_without_shape_or_rows(spark):
    flat = spark.createDataFrame([(i, 0.0, 1.0, 1.0) for i in range(20)], "id long, x double, y double, w double")
    for df in (flat, flat.limit(0)):
        r = S.resampled_saturating(df, "x", "y", "w", ["id"], replicates=5).first()
        assert (r.n_replicates, r.n_converged, r.m, r.k_hi) == (5, 0, None, None)


def test_ridge_reads_no_categories_and_keeps_no_second_copy_of_its_features(spark, monkeypatch):
    """The fit caches blocks of its own; a cached frame of vectors beside them is the same rows twice."""
    from pyspark.sql.classic.dataframe import DataFrame

    from sequela.plans import models, registry

    rows = spark.range(400).selectExpr(
        "id AS subject_id", "id % 7 AS provider_id", "id % 50 AS part_id", "20 + id % 60 AS age", "id % 90 + 0.5 AS hours", "id % 11 AS severity",
        "id % 9 / 100 AS dose", "id % 13 / 13 AS rate", "id % 7 * 10 AS provider_n", "id % 5 AS n_failures", "int(id % 3 = 0) AS died")
    asked, kept, persist = [], [], DataFrame.persist

    def persisted(self, *level):
        kept.append(self.columns)
        return persist(self, *level)

    def base(spark, folder, *columns):
        asked.extend(columns)
        return rows.select(*dict.fromkeys(columns))

    monkeypatch.setattr(DataFrame, "persist", persisted)
    monkeypatch.setattr(models, "base", base)
    found = registry.QUERIES["ridge_logistic"](spark, "").collect()
    assert len(found) == 8 and all(math.isfinite(r.estimate) for r in found)
    assert not set(asked) & set(models.FEATURES.categorical)
    assert not any("features" in columns for columns in kept)
    quality = registry.QUERIES["baseline_quality"](spark, "").collect()
    assert sorted(r["split"] for r in quality) == ["test", "val"] and not any("features" in columns for columns in kept)
