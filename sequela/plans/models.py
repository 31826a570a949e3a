"""Queries on estimators, prediction, cross-fitting, scores and the report."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from sequela.functions.exprs import r6
from sequela.operators import cohort as K
from sequela.operators import codes as C
from sequela.operators import dml as X
from sequela.operators import evaluate as V
from sequela.operators import features as N
from sequela.operators import linmod as M
from sequela.operators import msm as W
from sequela.operators import nls as S
from sequela.operators import predict as R
from sequela.operators import scoring as Z
from sequela.operators.logit import coefficient_table, fit_logit
from sequela.plans.cohorts import SUMMARY, base, rounded, summary
from sequela.plans.registry import query
from sequela.sources import adapters as A
from sequela.sources.tables import build_report, keyed_map, read_table

GROUPS = {g: list(u) for g, u in A.SPEC.unit_groups.items()}
COVARIATES = ("age", "severity", "dose", "hours")
IDS = ("subject_id", "provider_id", "part_id", "age", "hours", "severity", "dose")


# ── Linear models ────────────────────────────────────────────────────────────────────────────

# Closed form of the one-regressor weighted fit.
LINEAR = SUMMARY + """,
s AS (SELECT count(*) AS n, sum(n_sample) AS w, sum(n_sample * provider_rate) AS wx,
             sum(n_sample * mortality_rate) AS wy,
             sum(n_sample * provider_rate * provider_rate) AS wxx,
             sum(n_sample * provider_rate * mortality_rate) AS wxy FROM summary),
f AS (SELECT n, (wxy - wx * wy / w) / (wxx - wx * wx / w) AS slope,
             wy / w - (wxy - wx * wy / w) / (wxx - wx * wx / w) * wx / w AS intercept,
             wxx - wx * wx / w AS sxx, wy / w AS ybar FROM s),
r AS (SELECT sum(n_sample * pow(mortality_rate - intercept - slope * provider_rate, 2)) AS rss,
             sum(n_sample * pow(mortality_rate - ybar, 2)) AS tss FROM summary, f)"""


@query("WITH" + LINEAR + """
SELECT round(slope, 5) AS estimate, round(sqrt(rss / (n - 2) / sxx), 5) AS std_error,
       round(1 - rss / tss, 6) AS r2, n
FROM f, r""")
def weighted_line(spark, folder):
    fits, table = M.fit_forms(summary(spark, folder), "mortality_rate", "provider_rate", "n_sample")
    rows = table.where((F.col("model") == "linear") & (F.col("term") == "provider_rate"))
    return rows.select(F.round("estimate", 5).alias("estimate"),
                       F.round("std_error", 5).alias("std_error"), r6("r2").alias("r2"), "n")


@query()
def functional_forms(spark, folder):
    return M.fit_forms(summary(spark, folder), "mortality_rate", "provider_rate", "n_sample")[1]


@query()
def nested_model_test(spark, folder):
    fits, _ = M.fit_forms(summary(spark, folder), "mortality_rate", "provider_rate", "n_sample")
    return spark.createDataFrame(
        [M.nested_f(fits["linear"], fits["quadratic"])],
        "statistic double, df1 long, df2 long, p double",
    )


@query()
def fitted_curves(spark, folder):
    rows = summary(spark, folder)
    fits, _ = M.fit_forms(rows, "mortality_rate", "provider_rate", "n_sample")
    ends = rows.agg(F.min("provider_rate").alias("lo"), F.max("provider_rate").alias("hi")).first()
    return M.fitted_grid(spark, fits, ends.lo, ends.hi, 0.01, "provider_rate")


def pcor_sql(source: str, by: str = "") -> str:
    pick = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""
p AS (SELECT {pick}count(*) AS n, avg(provider_rate) AS mx, avg(mortality_rate) AS my,
             corr(provider_rate, mortality_rate) AS xy, corr(provider_rate, n_sample) AS xz,
             corr(mortality_rate, n_sample) AS yz FROM {source}{group}),
q AS (SELECT *, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS r FROM p)
SELECT {pick}n, round(mx, 6) AS mean_provider_rate, round(my, 6) AS mean_mortality_rate,
       round(CASE WHEN n >= 5 THEN r END, 6) AS r,
       round(CASE WHEN n >= 5 THEN r * sqrt((n - 3) / (1 - r * r)) END, 5) AS t FROM q"""


PCOR = ("mean_provider_rate", "mean_mortality_rate", "r")


def pcor_rounded(out):
    return rounded(out, *PCOR).withColumn("t", F.round("t", 5)).drop("p")


@query("WITH" + SUMMARY + "," + pcor_sql("summary"))
def partial_correlation(spark, folder):
    return pcor_rounded(M.partial_correlation(
        summary(spark, folder), "provider_rate", "mortality_rate", "n_sample"))


@query("WITH" + SUMMARY + "," + pcor_sql("summary", "primary_unit"))
def partial_correlation_by_unit(spark, folder):
    return pcor_rounded(M.partial_correlation(
        summary(spark, folder), "provider_rate", "mortality_rate", "n_sample", ["primary_unit"]))


@query("WITH" + SUMMARY + """,
v AS (SELECT s.*, min_volume FROM summary s, (VALUES (10), (320)) t(min_volume)
      WHERE n_sample >= min_volume),""" + pcor_sql("v", "min_volume"))
def partial_correlation_by_volume(spark, folder):
    return pcor_rounded(M.partial_correlation_by_volume(
        summary(spark, folder), "provider_rate", "mortality_rate", "n_sample", "n_sample",
        [10, 320], min_rows=5))


@query()
def correlation_p_values(spark, folder):
    return M.partial_correlation(summary(spark, folder), "provider_n", "mortality_rate",
                                 "provider_rate")


# ── Weights and structural models ────────────────────────────────────────────────────────────

SW = A.BASE + """,
f AS (SELECT regr_slope(rate, age) AS b, regr_intercept(rate, age) AS a, avg(rate) AS m,
             stddev_samp(rate) AS s FROM base),
d AS (SELECT sqrt(sum(pow(rate - a - b * age, 2)) / (count(*) - 2)) AS sd FROM base, f),
raw AS (SELECT base.*, (exp(-pow((rate - m) / s, 2) / 2) / s)
               / (exp(-pow((rate - a - b * age) / sd, 2) / 2) / sd) AS raw FROM base, f, d),
cut AS (SELECT quantile_cont(raw, 0.99) AS c FROM raw),
mean AS (SELECT avg(least(raw, c)) AS m FROM raw, cut),
weighted AS (SELECT raw.*, least(raw, c) / mean.m AS sw FROM raw, cut, mean)"""


def one_covariate(spark, folder):
    return M.density_weights(base(spark, folder), "rate", ["age"])


@query("WITH" + SW + """
SELECT unit, count(*) AS n, round(avg(sw), 5) AS mean_weight, round(max(sw), 5) AS max_weight,
       round(sum(sw) * sum(sw) / sum(sw * sw), 3) AS eff_n
FROM weighted GROUP BY unit""")
def density_weights(spark, folder):
    return one_covariate(spark, folder).rows.groupBy("unit").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("sw"), 5).alias("mean_weight"),
        F.round(F.max("sw"), 5).alias("max_weight"),
        F.round(M.effective_n("sw"), 3).alias("eff_n"),
    )


def balance_sql(c: str) -> str:
    return f"""
SELECT '{c}' AS covariate, round(corr({c}, rate), 5) AS r_unweighted,
  round((sum(sw * ({c} - ma) * (rate - mr)) - sum(sw * ({c} - ma)) * sum(sw * (rate - mr)) / sum(sw))
  / sqrt((sum(sw * pow({c} - ma, 2)) - pow(sum(sw * ({c} - ma)), 2) / sum(sw))
       * (sum(sw * pow(rate - mr, 2)) - pow(sum(sw * (rate - mr)), 2) / sum(sw))), 5) AS r_weighted
FROM weighted, (SELECT avg({c}) AS ma, avg(rate) AS mr FROM weighted)"""


@query("WITH" + SW + " UNION ALL ".join(balance_sql(c) for c in ("age", "severity", "hours")))
def covariate_balance(spark, folder):
    out = M.balance(one_covariate(spark, folder).rows, "rate", ["age", "severity", "hours"], "sw")
    return out.withColumns({c: F.round(c, 5) for c in ("r_unweighted", "r_weighted")})


def with_flags(spark, folder):
    rows = base(spark, folder, *IDS, *FEATURES.continuous, *FEATURES.categorical, "died", "expired")
    rows = rows.withColumn("expired_early", F.col("expired") * (F.col("age") % 2))
    return rows.withColumns({f"flag_{i}": (F.col("part_id") % 5 == i).cast("int") for i in range(3)} |
                            {"flag_never": F.lit(0)})


MSM = W.MsmSpec(
    treatment="rate", outcome="died", covariates=COVARIATES,
    flags=("flag_0", "flag_1", "flag_2", "flag_never"), secondary=("expired",), min_providers=5,
)


@query()
def structural_models(spark, folder):
    found = W.run_groups(with_flags(spark, folder), GROUPS, MSM)
    return W.results_table(spark, found)


@query()
def structural_model_balance(spark, folder):
    found = W.run_groups(with_flags(spark, folder), GROUPS, MSM)
    return W.balance_table(spark, found)


@query()
def structural_model_excluding(spark, folder):
    found = W.run_groups(with_flags(spark, folder), {"Routine": GROUPS["Routine"]}, MSM,
                         exclude=F.col("n_failures") > 4)
    return W.results_table(spark, found)


# With one 0/1 regressor the coefficient is the log odds ratio of the two-by-two table.
@query("WITH" + A.BASE + """
SELECT round(ln((sum(CASE WHEN failed = 1 AND died = 1 THEN 1.0 ELSE 0 END)
               * sum(CASE WHEN failed = 0 AND died = 0 THEN 1.0 ELSE 0 END))
              / (sum(CASE WHEN failed = 1 AND died = 0 THEN 1.0 ELSE 0 END)
               * sum(CASE WHEN failed = 0 AND died = 1 THEN 1.0 ELSE 0 END))), 5) AS estimate,
       round(sqrt(1 / sum(CASE WHEN failed = 1 AND died = 1 THEN 1.0 ELSE 0 END)
                + 1 / sum(CASE WHEN failed = 0 AND died = 0 THEN 1.0 ELSE 0 END)
                + 1 / sum(CASE WHEN failed = 1 AND died = 0 THEN 1.0 ELSE 0 END)
                + 1 / sum(CASE WHEN failed = 0 AND died = 1 THEN 1.0 ELSE 0 END)), 5) AS std_error
FROM base""")
def logistic_two_by_two(spark, folder):
    fit = fit_logit(base(spark, folder), "died", ["failed"], kinds=("model",))
    table = coefficient_table(spark, {"base": fit}).where(F.col("term") == "failed")
    return table.select(F.round("estimate", 5).alias("estimate"),
                        F.round("std_error", 5).alias("std_error"))


@query()
def logistic_robust(spark, folder):
    fit = fit_logit(base(spark, folder), "died", ["rate", "age", "severity"], cluster="provider_id")
    return coefficient_table(spark, {"base": fit})


@query()
def saturating_curve(spark, folder):
    rows = summary(spark, folder).where(F.col("provider_rate") > 0)
    return S.fit_saturating(rows, "provider_rate", "mortality_rate", "n_sample")


@query()
def saturating_curve_resampled(spark, folder):
    rows = summary(spark, folder).where(F.col("provider_rate") > 0)
    return S.resampled_saturating(rows, "provider_rate", "mortality_rate", "n_sample", ["provider_id"])


@query()
def saturating_curve_by_unit(spark, folder):
    rows = summary(spark, folder).where(F.col("provider_rate") > 0)
    return S.fit_saturating(rows, "provider_rate", "mortality_rate", "n_sample", "primary_unit",
                            min_n=5)


@query("WITH" + A.BASE + """,
g AS (SELECT provider_id, count(*) AS n, avg(died) AS m, var_samp(died) AS v FROM base GROUP BY 1),
s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * pow(m - (SELECT avg(died) FROM base), 2)) AS ssb,
             sum((n - 1) * coalesce(v, 0)) AS ssw, sum(n * n) AS n2 FROM g),
c AS (SELECT k, n, ssw / (n - k) AS w,
             greatest((ssb / (k - 1) - ssw / (n - k)) / ((n - n2 / n) / (k - 1)), 0) AS b FROM s)
SELECT k AS n_groups, CAST(n AS BIGINT) AS n_rows, round(w, 6) AS var_within,
       round(b, 6) AS var_between, round(b / (b + w), 6) AS icc FROM c""")
def variance_components(spark, folder):
    out = M.variance_components(base(spark, folder), "provider_id", "died")
    return rounded(out, "var_within", "var_between", "icc")


# The three moment equations from level sums, solved by elimination of the rest's variance.
@query("WITH" + A.BASE + """,
y AS (SELECT provider_id AS p, unit AS u, died - avg(died) OVER () AS d FROM base WHERE died IS NOT NULL),
np AS (SELECT p, count(*) AS n, sum(d) AS s FROM y GROUP BY p),
nu AS (SELECT u, count(*) AS n, sum(d) AS s FROM y GROUP BY u),
cell AS (SELECT p, u, count(*) AS n FROM y GROUP BY p, u),
t AS (SELECT (SELECT count(*) FROM y) AS n, (SELECT sum(d * d) FROM y) AS q,
             (SELECT sum(s * s / n) FROM np) AS qp, (SELECT sum(s * s / n) FROM nu) AS qu,
             (SELECT count(*) FROM np) - 1 AS dp, (SELECT count(*) FROM nu) - 1 AS du,
             (SELECT sum(n * n) FROM np) AS sp, (SELECT sum(n * n) FROM nu) AS su,
             (SELECT sum(c.n * c.n / np.n) FROM cell c JOIN np ON c.p IS NOT DISTINCT FROM np.p) AS xu,
             (SELECT sum(c.n * c.n / nu.n) FROM cell c JOIN nu ON c.u IS NOT DISTINCT FROM nu.u) AS xp),
f AS (SELECT *, dp / (n - 1) AS rp, du / (n - 1) AS ru, n - sp / n AS kp, n - su / n AS ku FROM t),
e AS (SELECT *, kp - rp * kp AS a11, xu - su / n - rp * ku AS a12, qp - rp * q AS b1,
             xp - sp / n - ru * kp AS a21, ku - ru * ku AS a22, qu - ru * q AS b2 FROM f),
v AS (SELECT *, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a21) AS vp,
             (a11 * b2 - a21 * b1) / (a11 * a22 - a12 * a21) AS vu FROM e),
w AS (SELECT *, greatest(vp, 0) AS p0, greatest(vu, 0) AS u0, greatest((q - vp * kp - vu * ku) / (n - 1), 0) AS r0 FROM v)
SELECT n AS n_rows, (SELECT count(*) FROM cell) AS n_cells, dp + 1 AS n_first, du + 1 AS n_second,
       round(p0, 6) AS var_first, round(u0, 6) AS var_second, round(r0, 6) AS var_rest,
       round(p0 / (p0 + u0 + r0), 6) AS share_first, round(u0 / (p0 + u0 + r0), 6) AS share_second
FROM w""")
def crossed_components(spark, folder):
    out = M.crossed_components(base(spark, folder), "provider_id", "unit", "died")
    return rounded(out, "var_first", "var_second", "var_rest", "share_first", "share_second")


@query()
def shrunken_means(spark, folder):
    fit_rows = base(spark, folder)
    fit = fit_logit(fit_rows, "died", ["age", "severity"], kinds=("model",))
    residual = fit_rows.withColumn("residual", F.col("died") - fit.probability())
    return M.shrunken_means(residual, "provider_id", "residual")


# ── Features, prediction, quality ────────────────────────────────────────────────────────────

FEATURES = N.FeatureSpec(
    continuous=("age", "severity", "dose", "hours", "rate", "provider_n", "n_failures"),
    log1p=("hours", "provider_n"), categorical=("gender", "category", "diagnosis", "unit"),
)


@query("WITH" + A.BASE + """,
l AS (SELECT unit, ln(1 + hours) AS h, age FROM base),
m AS (SELECT avg(h) AS mh, stddev_pop(h) AS sh, avg(age) AS ma, stddev_pop(age) AS sa FROM l)
SELECT unit, count(*) AS n, round(avg((h - mh) / sh), 5) AS hours_z,
       round(avg((age - ma) / sa), 5) AS age_z, round(max((h - mh) / sh), 5) AS hours_z_max
FROM l, m GROUP BY unit""")
def feature_columns(spark, folder):
    rows = base(spark, folder, "unit", "age", "hours")
    model = N.fit_features(rows, N.FeatureSpec(("age", "hours"), ("hours",)))
    return rows.withColumns(model.numeric()).groupBy("unit").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("hours_z"), 5).alias("hours_z"),
        F.round(F.avg("age_z"), 5).alias("age_z"), F.round(F.max("hours_z"), 5).alias("hours_z_max"),
    )


@query()
def feature_vectors(spark, folder):
    from pyspark.ml.functions import vector_to_array

    rows = base(spark, folder, *FEATURES.continuous, *FEATURES.categorical, "unit_group")
    model = N.fit_features(rows, FEATURES)
    vector = vector_to_array("features")
    return model.transform(rows).groupBy("unit_group").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("n_features"),
        F.avg(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x)).alias("mean_sum"),
    )


def split(spark, folder, *more):
    """Study rows with identity, continuous features, outcome and the columns ``more``, and their split."""
    rows = base(spark, folder, *IDS, *FEATURES.continuous, *more, "died")
    return N.stratified_split(rows, list(IDS), "died")


@query()
def stratified_split(spark, folder):
    return split(spark, folder).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.avg("died").alias("outcome_rate")
    )


@query()
def ridge_logistic(spark, folder):
    rows = split(spark, folder)
    train = rows.where(F.col("split") == "train")
    spec = N.FeatureSpec(FEATURES.continuous, FEATURES.log1p)
    model = N.fit_features(train, spec)
    fit = R.ridge_logit(model.transform(train).select("features", "died"), "died")  # the fit caches its own blocks
    return R.coefficients(spark, fit, model.labels())


def boosted_baseline(spark, folder):
    """Labels of the features, the boosted classifier of the outcome and the scored validation and test rows."""
    rows = split(spark, folder, *FEATURES.categorical)
    features = N.fit_features(rows.where(F.col("split") == "train"), FEATURES, one_hot=False)
    prepared = features.transform(rows).select("features", "died", "split")
    model, scored = R.boosted(prepared, "died", {"val": 1, "test": 2}, "split")
    return features.labels(), model, scored


@query()
def boosted_importances(spark, folder):
    labels, model, _ = boosted_baseline(spark, folder)
    return R.importances(spark, model, labels)


@query()
def boosted_quality(spark, folder):
    _, model, scored = boosted_baseline(spark, folder)
    return V.quality(scored, "score", "died", ["split"]).withColumn("rounds", F.lit(len(model.trees)))


@query()
def baseline_quality(spark, folder):
    rows = split(spark, folder)
    train = rows.where(F.col("split") == "train")
    model = N.fit_features(train, N.FeatureSpec(FEATURES.continuous, FEATURES.log1p))
    prepared = model.transform(rows).select("features", "died", "split")
    fit = R.ridge_logit(prepared.where(F.col("split") == "train"), "died")
    scored = R.with_probability(fit, prepared.where(F.col("split") != "train"))
    return V.quality(scored, "score", "died", ["split"])


# A given score: its quality does not depend on a fitted model.
SCORED = A.COHORT + """,
scored AS (SELECT unit, died, severity / 20 + age / 200 AS score FROM cohort),
pts AS (SELECT score, sum(died) AS p, count(*) - sum(died) AS q FROM scored GROUP BY score),
cum AS (SELECT score, p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp,
               sum(p) OVER () AS np, sum(q) OVER () AS nq
        FROM pts WINDOW w AS (ORDER BY score DESC))"""


def scored(spark, folder):
    return A.cohort(spark, folder).withColumn(
        "score", F.col("severity") / 20 + F.col("age") / 200
    )


@query("WITH" + SCORED + """
SELECT round(sum(q / nq * (tp - p / 2) / np), 6) AS auc,
       round(sum(p / np * tp / (tp + fp)), 6) AS average_precision,
       round((SELECT avg(pow(score - died, 2)) FROM scored), 6) AS brier
FROM cum""")
def score_quality(spark, folder):
    out = V.quality(scored(spark, folder), "score", "died")
    return rounded(out, "auc", "average_precision", "brier")


@query("WITH" + SCORED + """
SELECT round(score, 6) AS threshold, round(fp / nq, 6) AS fpr, round(tp / np, 6) AS tpr FROM cum""")
def roc_curve(spark, folder):
    return rounded(V.roc_curve(scored(spark, folder), "score", "died"), "threshold", "fpr", "tpr")


@query("WITH" + SCORED + """
SELECT round(score, 6) AS threshold, round(tp / (tp + fp), 6) AS precision,
       round(tp / np, 6) AS recall
FROM cum""")
def pr_curve(spark, folder):
    return rounded(V.pr_curve(scored(spark, folder), "score", "died"),
                   "threshold", "precision", "recall")


@query()
def permutation_importance(spark, folder):
    columns = ["age", "severity", "hours", "rate"]
    rows = base(spark, folder, *IDS, *columns, "died")
    fit = fit_logit(rows, "died", columns, kinds=("model",))
    coef = dict(zip(fit.names, map(float, fit.coef)))

    def score(values):
        z = F.lit(coef["(intercept)"])
        for c in columns:
            z = z + values[c] * F.lit(coef[c])
        return z

    return R.permutation_importance(rows, columns, score, "died", list(IDS))


# ── Cross-fitting ────────────────────────────────────────────────────────────────────────────

DML = X.DmlSpec(
    outcome="died", treatment="rate", ids=IDS,
    features=N.FeatureSpec(tuple(c for c in FEATURES.continuous if c != "rate"), FEATURES.log1p, FEATURES.categorical),
)
FLAGS = ("flag_0", "flag_1", "flag_2", "flag_never")


def flags_for(part):
    """The code flags that a tenth of the rows has."""
    long = C.flags_long(part, ["subject_id"], list(FLAGS)).where(F.col("present") == 1)
    return part, C.select_codes(C.code_prevalence(long, cohort=part, denominator="cohort"), 0.10)


def cross_fitted(spark, folder):
    """Residuals of outcome and treatment given all confounders and the selected flags."""
    rows, flags = flags_for(with_flags(spark, folder))
    return X.boosted_residuals([(rows, replace(DML, features=replace(DML.features, flags=tuple(flags))), 20)])


@query()
def double_ml(spark, folder):
    return X.theta(cross_fitted(spark, folder))


@query()
def double_ml_fold_quality(spark, folder):
    return X.fold_quality(cross_fitted(spark, folder), "died", "rate")


@query()
def double_ml_report(spark, folder):
    res = cross_fitted(spark, folder)
    return X.effect_report(res, X.theta(res), "died", "rate")


@query()
def double_ml_by_group(spark, folder):
    return X.by_group(with_flags(spark, folder), GROUPS, DML, min_providers=5, flags_for=flags_for)


# Residuals from group means stand in for those of a model: the estimate given them is exact.
RESIDUALS = A.BASE + """,
res AS (SELECT round(died - avg(died) OVER (PARTITION BY severity), 9) AS y_res,
               round(rate - avg(rate) OVER (PARTITION BY severity), 9) AS d_res, died, rate FROM base)"""


def mean_residuals(spark, folder):
    rows = base(spark, folder, "died", "rate", "severity")
    means = rows.groupBy("severity").agg(F.avg("died").alias("_y"), F.avg("rate").alias("_d"))
    return rows.join(F.broadcast(means), "severity").select(
        "died", "rate", F.round(F.col("died") - F.col("_y"), 9).alias("y_res"),
        F.round(F.col("rate") - F.col("_d"), 9).alias("d_res"),
    )


@query("WITH" + RESIDUALS + """,
t AS (SELECT count(*) AS n, sum(d_res * y_res) / sum(d_res * d_res) AS theta,
             sum(d_res * d_res) AS dd FROM res),
s AS (SELECT sqrt(sum(pow(d_res * (y_res - theta * d_res), 2))) / max(dd) AS se FROM res, t)
SELECT n, round(theta, 5) AS theta, round(se, 6) AS se, round(theta / se, 4) AS z,
       round(theta - 1.96 * se, 5) AS lo, round(theta + 1.96 * se, 5) AS hi
FROM t, s""")
def orthogonal_estimate(spark, folder):
    out = X.theta(mean_residuals(spark, folder)).drop("p")
    return out.withColumns({"theta": F.round("theta", 5), "se": r6("se"), "z": F.round("z", 4),
                            "lo": F.round("lo", 5), "hi": F.round("hi", 5)})


@query("WITH" + RESIDUALS + """,
e AS (SELECT """ + ", ".join(f"quantile_cont(d_res, {i / 21!r}) AS e{i}" for i in range(22)) + """ FROM res),
b AS (SELECT *, """ + " + ".join(f"CASE WHEN d_res >= e{i} THEN 1 ELSE 0 END" for i in range(1, 21)) + """ AS bin
      FROM res, e)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(y_res), 6) AS mean,
       round(max(([""" + ", ".join(f"(e{i} + e{i + 1}) / 2" for i in range(21)) + """])[bin + 1]), 6) AS center
FROM b GROUP BY bin""")
def binned_means(spark, folder):
    return rounded(X.binned_means(mean_residuals(spark, folder)), "mean", "center")


# ── Scores and report ────────────────────────────────────────────────────────────────────────

def score_input(spark, folder):
    rows = read_table(spark, folder, "lineitem")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_linenumber").cast("double").alias("charlson"),
        (F.col("l_quantity") / 5).alias("sofa"), F.col("l_tax").alias("vasopressor"),
        (F.col("l_extendedprice") / 500).alias("vent_hours"), F.col("l_discount").alias("rate"),
        F.when(F.col("l_returnflag") == "A", "surgical")
        .when(F.col("l_returnflag") == "R", "medical-respiratory")
        .otherwise("medical-non-respiratory").alias("category"),
    )


RISK = """
x AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_linenumber AS DOUBLE) AS charlson,
             l_quantity / 5 AS sofa, l_tax AS vaso, l_extendedprice / 500 AS vent, l_discount AS rate,
             CASE l_returnflag WHEN 'A' THEN -0.30::DOUBLE WHEN 'R' THEN 0.10::DOUBLE
                  ELSE 0.20::DOUBLE END AS cat
      FROM lineitem),
p AS (SELECT *, 1.70 + cat + -0.18 * (charlson - 5) + -0.20 * (sofa - 8) + -1.80 * (vaso - 0.05)
             + -0.004 * (vent - 138) + -3.0 * rate + 5.0 * rate * rate AS lp FROM x),
s AS (SELECT *, 1 / (1 + exp(-lp)) AS prob FROM p)"""


@query("WITH" + RISK + """
SELECT CASE WHEN prob >= 0.8 THEN 'Lower Risk' WHEN prob >= 0.6 THEN 'Moderate Risk'
            ELSE 'Higher Risk' END AS risk,
       count(*) AS n, round(avg(lp), 6) AS mean_lp, round(avg(100 * prob), 6) AS mean_pct
FROM s GROUP BY 1""")
def risk_score(spark, folder):
    return Z.scored(score_input(spark, folder)).groupBy("risk").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("linear_predictor")).alias("mean_lp"),
        r6(F.avg("survival_pct")).alias("mean_pct"),
    )


@query("WITH" + RISK + """,
c AS (SELECT -0.18 * (charlson - 5) AS charlson, -0.20 * (sofa - 8) AS sofa,
             -1.80 * (vaso - 0.05) AS vasopressor, -0.004 * (vent - 138) AS vent_hours,
             cat + 0.30 AS category,
             -3.0 * rate + 5.0 * rate * rate - (-3.0 * 0.13 + 5.0 * 0.13 * 0.13) AS rate FROM x),
u AS (SELECT factor, CAST(v AS DOUBLE) AS v FROM (
      SELECT 'charlson' AS factor, charlson AS v FROM c UNION ALL SELECT 'sofa', sofa FROM c
      UNION ALL SELECT 'vasopressor', vasopressor FROM c
      UNION ALL SELECT 'vent_hours', vent_hours FROM c
      UNION ALL SELECT 'category', category FROM c UNION ALL SELECT 'rate', rate FROM c))
SELECT factor, count(*) AS n, round(avg(v), 6) AS mean, round(min(v), 6) AS low,
       round(max(v), 6) AS high
FROM u GROUP BY factor""")
def risk_contributions(spark, folder):
    rows = Z.contributions(score_input(spark, folder), ["l_orderkey"])
    return rows.groupBy("factor").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("contribution")).alias("mean"),
        r6(F.min("contribution")).alias("low"), r6(F.max("contribution")).alias("high"),
    )


@query()
def report(spark, folder):
    rows = A.rated(spark, folder)
    explicit = K.explicit_cohort(rows, A.SPEC)
    cohort = explicit.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("provider_id").alias("n_providers"),
        F.round(F.avg("died"), 3).alias("mortality"),
    )
    units = K.patient_cohort(rows, A.SPEC).groupBy("unit").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("age"), 1).alias("age_mean"),
        F.round(F.stddev_samp("age"), 1).alias("age_sd"),
        F.round(F.avg("died"), 3).alias("mortality"),
    )
    profiles = keyed_map(units, "unit", ["n", "age_mean", "age_sd", "mortality"])
    return build_report(spark, cohort=cohort, unit_profiles=profiles)


# The report's parts read back from its text.
@query("WITH" + A.BASE + """
SELECT unit, count(*) AS n, round(avg(died), 3) AS mortality,
       (SELECT count(*) FROM explicit_cohort) AS cohort_n
FROM patient GROUP BY unit""")
def report_by_unit(spark, folder):
    schema = ("cohort struct<n:bigint>, "
              "unit_profiles map<string, struct<n:bigint, mortality:double>>")
    parsed = report(spark, folder).select(F.from_json("report", schema).alias("r"))
    return parsed.select(
        F.explode("r.unit_profiles").alias("unit", "p"), F.col("r.cohort.n").alias("cohort_n")
    ).select("unit", F.col("p.n").alias("n"), F.col("p.mortality").alias("mortality"), "cohort_n")


