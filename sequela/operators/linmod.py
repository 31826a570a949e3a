"""Linear models, partial correlation, density weights, balance, variance components.

Model fits go through Spark ML; what it does not report follows from aggregates of the rows. Only
coefficients, sums and result rows reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequela.functions.exprs import scalars
from sequela.functions.tails import f_upper, t_p, t_two_sided
from sequela.operators.ordered import quantiles
from sequela.session import checkpointed

FEATURES = "_features"


def assembled(rows: DataFrame, xs: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=xs, outputCol=FEATURES, handleInvalid="error").transform(rows)


def predictor(names: list[str], coef: list[float]) -> Column:
    """Intercept first, then one coefficient per column."""
    out = F.lit(float(coef[0]))
    for name, b in zip(names, coef[1:]):
        out = out + F.col(name) * F.lit(float(b))
    return out


@dataclass(frozen=True)
class LinearFit:
    names: list[str]
    coef: list[float]
    se: list[float]
    n: int
    rss: float
    tss: float
    sum_log_w: float
    mean_y: float

    @property
    def df(self) -> int:
        return self.n - len(self.coef)

    @property
    def sigma(self) -> float:
        return math.sqrt(self.rss / self.df)

    @property
    def r2(self) -> float:
        return 1 - self.rss / self.tss

    @property
    def aic(self) -> float:
        log_lik = 0.5 * (
            self.sum_log_w - self.n * (math.log(2 * math.pi) + 1 - math.log(self.n)
                                       + math.log(self.rss))
        )
        return -2 * log_lik + 2 * (len(self.coef) + 1)

    def predict(self) -> Column:
        return predictor(self.names, self.coef)

    def rows(self, model: str) -> list[tuple]:
        out = []
        for name, b, se in zip(["(intercept)", *self.names], self.coef, self.se):
            t = b / se if se else float("nan")
            out.append((model, name, b, se, t, t_two_sided(t, self.df), self.n, self.r2, self.aic))
        return out


def fit_linear(
    rows: DataFrame, y: str, xs: list[str], weight: str | None = None
) -> LinearFit:
    """Weighted least squares with intercept. Rows must be complete; weights positive."""
    w = F.col(weight) if weight else F.lit(1.0)
    data = rows.select(*xs, F.col(y).cast("double").alias("_y"), w.cast("double").alias("_w"))
    data = data.persist()
    y_, w_ = F.col("_y"), F.col("_w")
    s = data.agg(
        F.count(F.lit(1)).alias("n"), F.sum(w_).alias("w"), F.sum(F.log(w_)).alias("log_w"),
        (F.sum(y_ * w_) / F.sum(w_)).alias("mean"),
    ).first()
    if xs:
        estimator = LinearRegression(
            featuresCol=FEATURES, labelCol="_y", weightCol="_w", solver="normal",
            regParam=0.0, standardization=False,
        )
        model = estimator.fit(assembled(data, xs))
        coef = [model.intercept, *model.coefficients.toArray().tolist()]
        errors = list(model.summary.coefficientStandardErrors)
        se = [errors[-1], *errors[:-1]]
    else:
        coef, se = [s["mean"]], None
    residual = y_ - predictor(xs, coef)
    off = y_ - F.lit(s["mean"])
    sq = data.agg(
        F.sum(w_ * residual * residual).alias("rss"), F.sum(w_ * off * off).alias("tss")
    ).first()
    data.unpersist()
    if se is None:
        se = [math.sqrt(sq.rss / (s.n - 1) / s.w)]
    return LinearFit(xs, coef, se, s.n, sq.rss, sq.tss, s.log_w, s["mean"])


def nested_f(small: LinearFit, large: LinearFit) -> tuple[float, int, int, float]:
    """F statistic of the larger model against the smaller one, its degrees of freedom and p."""
    extra = small.df - large.df
    f = ((small.rss - large.rss) / extra) / (large.rss / large.df)
    return f, extra, large.df, f_upper(f, extra, large.df)


COEF_SCHEMA = (
    "model string, term string, estimate double, std_error double, t double, p double, "
    "n long, r2 double, aic double"
)


def fit_forms(
    rows: DataFrame, y: str, x: str, weight: str | None = None
) -> tuple[dict[str, LinearFit], DataFrame]:
    """Linear, quadratic and log-linear fits of ``y`` on ``x`` with their coefficient table."""
    base = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns(
        {"_x": F.col(x).cast("double"), "_x2": F.col(x).cast("double") * F.col(x)}
    )
    base = base.persist()
    positive = base.where(F.col(y) > 0).withColumn("_log_y", F.log(y))
    fits = {
        "linear": fit_linear(base, y, ["_x"], weight),
        "quadratic": fit_linear(base, y, ["_x", "_x2"], weight),
        "log_linear": fit_linear(positive, "_log_y", ["_x"], weight),
    }
    base.unpersist()
    named = {"_x": x, "_x2": f"{x}^2"}
    table = [
        (m, named.get(term, term), *rest)
        for name, fit in fits.items() for m, term, *rest in fit.rows(name)
    ]
    return fits, rows.sparkSession.createDataFrame(table, COEF_SCHEMA)


def fitted_grid(
    spark, fits: dict[str, LinearFit], low: float, high: float, step: float, x: str = "x"
) -> DataFrame:
    """Fitted curves of :func:`fit_forms` over a grid."""
    n = int(math.floor((high - low) / step + 1e-9)) + 1
    grid = spark.range(n).select((F.lit(low) + F.col("id") * F.lit(step)).alias("_x"))
    grid = grid.withColumn("_x2", F.col("_x") * F.col("_x"))
    return grid.select(
        F.col("_x").alias(x),
        fits["linear"].predict().alias("linear"),
        fits["quadratic"].predict().alias("quadratic"),
        F.exp(fits["log_linear"].predict()).alias("exponential"),
    )


def partial_correlation(
    rows: DataFrame, x: str, y: str, control: str, by: list[str] = (), min_n: int = 5
) -> DataFrame:
    """Correlation of two columns given a third, with t and p; null below ``min_n`` rows."""
    rows = rows.select(*by, *[F.col(c).cast("double").alias(a)
                              for c, a in [(x, "_a"), (y, "_b"), (control, "_z")]]).dropna(
        subset=["_a", "_b", "_z"]
    )
    stats = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_a").alias(f"mean_{x}"), F.avg("_b").alias(f"mean_{y}"),
        F.corr("_a", "_b").alias("_ab"), F.corr("_a", "_z").alias("_az"),
        F.corr("_b", "_z").alias("_bz"),
    )
    rest = F.sqrt((1 - F.col("_az") * F.col("_az")) * (1 - F.col("_bz") * F.col("_bz")))
    r = (F.col("_ab") - F.col("_az") * F.col("_bz")) / F.nullif(rest, F.lit(0.0))
    df = F.col("n") - 3
    return (
        stats.withColumn("r", F.when(F.col("n") >= min_n, r))
        .withColumn("t", F.col("r") * F.sqrt(df / (1 - F.col("r") * F.col("r"))))
        .withColumn("p", t_p("t", df.cast("double")))
        .drop("_ab", "_az", "_bz")
    )


def partial_correlation_by_volume(
    rows: DataFrame, x: str, y: str, control: str, volume: str, thresholds: list[int] = (10, 20),
    min_rows: int = 10,
) -> DataFrame:
    """The same among rows of at least each volume, in one pass over the rows."""
    reached = F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col(volume) >= t)
    return partial_correlation(
        rows.withColumn("min_volume", F.explode(reached)), x, y, control, ["min_volume"], min_rows
    )


def normal_pdf(x: Column, mean: Column, sd: Column) -> Column:
    z = (x - mean) / sd
    return F.exp(-z * z / 2) / (sd * F.lit(math.sqrt(2 * math.pi)))


@dataclass(frozen=True)
class DensityWeights:
    rows: DataFrame
    r2_denominator: float
    coef: list[float]


def density_weights(
    rows: DataFrame,
    treatment: str,
    covariates: list[str],
    trim: tuple[float | None, float | None] = (None, 0.99),
    out: str = "sw",
    floor: float = 1e-10,
) -> DensityWeights:
    """Stabilised weights f(T) / f(T | X) for a continuous treatment, normal densities.

    Extreme weights are pulled in to the ``trim`` quantiles, then all are scaled to mean 1.
    """
    t = F.col(treatment).cast("double")
    den = fit_linear(rows, treatment, covariates)
    sd = math.sqrt(den.tss / (den.n - 1))
    f_num = normal_pdf(t, F.lit(den.mean_y), F.lit(sd))
    f_den = normal_pdf(t, den.predict(), F.lit(den.sigma))
    ratio = f_num / F.greatest(f_den, F.lit(floor))

    raw = rows.select(ratio.alias("_raw")).persist()
    lo, hi = trim
    probs = [p for p in (lo, hi) if p is not None]
    bounds = {}
    if probs:
        bounds = dict(zip(probs, quantiles(raw, [], {"_raw": probs}).first()[0]))

    def trimmed(w: Column) -> Column:
        if lo is not None:
            w = F.greatest(w, F.lit(bounds[lo]))
        return F.least(w, F.lit(bounds[hi])) if hi is not None else w

    mean = raw.agg(F.avg(trimmed(F.col("_raw"))).alias("m")).first().m
    raw.unpersist()
    return DensityWeights(
        rows.withColumn(out, trimmed(ratio) / F.lit(mean)), den.r2, den.coef
    )


def effective_n(weight: str) -> Column:
    w = F.col(weight)
    return F.sum(w) * F.sum(w) / F.sum(w * w)


def weighted_corr(x: Column, y: Column, w: Column) -> Column:
    """Weighted correlation as one aggregate expression."""
    sw, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    cov = F.sum(w * x * y) - sx * sy / sw
    vx = F.sum(w * x * x) - sx * sx / sw
    vy = F.sum(w * y * y) - sy * sy / sw
    return cov / F.sqrt(vx * vy)


def balance(
    rows: DataFrame, treatment: str, covariates: list[str], weight: str, by: list[str] = ()
) -> DataFrame:
    """Correlation of each covariate with the treatment before and after weighting."""
    used = list(dict.fromkeys([*by, treatment, weight, *covariates]))
    rows = rows.select(*used).persist()
    w = F.col(weight).cast("double")
    # Centred first: the sums of squares then stay small next to what is summed.
    mean = rows.agg(*[F.avg(c).alias(c) for c in (treatment, *covariates)]).first()
    t = F.col(treatment).cast("double") - F.lit(mean[treatment])
    wide = rows.groupBy(*by).agg(
        *[F.corr(F.col(c).cast("double"), F.col(treatment).cast("double")).alias(f"u__{c}")
          for c in covariates],
        *[weighted_corr(F.col(c).cast("double") - F.lit(mean[c]), t, w).alias(f"w__{c}")
          for c in covariates],
    )
    cells = [
        F.struct(F.lit(c).alias("covariate"), F.col(f"u__{c}").alias("r_unweighted"),
                 F.col(f"w__{c}").alias("r_weighted"))
        for c in covariates
    ]
    return wide.select(*by, F.explode(F.array(*cells)).alias("_c")).select(*by, "_c.*")


def variance_components(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Between- and within-group variance by the analysis-of-variance moments; one row.

    A moment estimate on the scale of ``value`` (an outcome or a model residual), in place of a
    likelihood fit of random intercepts.
    """
    g = rows.groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")
    ).where(F.col("n") > 0)
    value_of = scalars(g, grand=F.sum(F.col("n") * F.col("m")) / F.sum("n"))
    off = F.col("m") - value_of("grand")
    s = g.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("n") * off * off).alias("ssb"),
        F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("ssw"),
        F.sum(F.col("n") * F.col("n")).alias("n2"),
    )
    within = F.col("ssw") / (F.col("n") - F.col("k"))
    n0 = (F.col("n") - F.col("n2") / F.col("n")) / (F.col("k") - 1)
    between = F.greatest((F.col("ssb") / (F.col("k") - 1) - within) / n0, F.lit(0.0))
    return s.select(
        F.col("k").alias("n_groups"), F.col("n").alias("n_rows"),
        within.alias("var_within"), between.alias("var_between"),
        (between / (between + within)).alias("icc"),
    )


def crossed_components(rows: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """Variances of two crossed factors and the rest by Henderson's first method; one row.

    The model is ``value = mean + a[first] + b[second] + rest`` with independent effects. The squared
    sums between levels of either factor and over all rows, each about the overall mean, are set equal to
    their expectations, which need only the sizes of the occupied cells: one pass over the rows makes
    count, mean and spread of each cell, and everything after works on the staged cells. A level without an identifier is a level like any other, rows
    without a value take no part. Negative solutions read 0. Where a factor has one level, or
    the factors cannot be told apart, the variances are null.
    """
    y = F.col(value).cast("double")
    cells = checkpointed(
        rows.where(y.isNotNull()).groupBy(F.col(first).alias("_a"), F.col(second).alias("_b")).agg(
            F.count(F.lit(1)).alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
    )
    off = F.col("m") - scalars(cells, m=F.sum(F.col("n") * F.col("m")) / F.sum("n"))("m")
    cells = cells.select("_a", "_b", "n", (F.col("n") * off).alias("s"), (F.col("n") * (F.col("v") + off * off)).alias("ss"))

    def levels(of: str) -> DataFrame:
        sums = cells.groupBy(of).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("n") * F.col("n")).alias("nn"))
        return sums.agg(
            F.count(F.lit(1)).alias("levels"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"),
            F.sum(F.col("nn") / F.col("n")).alias("other"), F.sum(F.col("n") * F.col("n")).alias("squares"),
        ).select(F.struct("*").alias("row"))

    a, b = (levels(of).scalar() for of in ("_a", "_b"))
    whole = cells.agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n"), F.sum("ss").alias("ss"))
    n = F.col("n").cast("double")
    # Each equation: the sum, and what a unit of either factor's variance and of the rest's adds to it.
    own_a, own_b = n - a["squares"] / n, n - b["squares"] / n
    equations = [
        (a["between"], own_a, a["other"] - b["squares"] / n, a["levels"] - 1.0),
        (b["between"], b["other"] - a["squares"] / n, own_b, b["levels"] - 1.0),
        (F.col("ss"), own_a, own_b, n - 1.0),
    ]
    named = whole.select(
        F.col("n").alias("n_rows"), F.col("cells").alias("n_cells"),
        a["levels"].alias("n_first"), b["levels"].alias("n_second"),
        *[c.alias(f"_{i}{j}") for i, row in enumerate(equations) for j, c in enumerate(row)],
    )

    def determinant(order: list[int]):
        c = [[F.col(f"_{i}{j}") for j in order] for i in range(3)]
        return sum(
            (c[0][j] * (c[1][(j + 1) % 3] * c[2][(j + 2) % 3] - c[1][(j + 2) % 3] * c[2][(j + 1) % 3]) for j in range(3)),
            F.lit(0.0),
        )

    scale = F.abs(F.col("_01") * F.col("_12") * F.col("_23"))
    solvable = F.abs("_det") > scale * 1e-12
    solved = named.withColumn("_det", determinant([1, 2, 3])).select(
        "n_rows", "n_cells", "n_first", "n_second",
        *[F.when(solvable, F.greatest(determinant(order) / F.col("_det"), F.lit(0.0))).alias(name)
          for name, order in (("var_first", [0, 2, 3]), ("var_second", [1, 0, 3]), ("var_rest", [1, 2, 0]))],
    )
    total = F.col("var_first") + F.col("var_second") + F.col("var_rest")
    return solved.withColumns({f"share_{k}": F.when(total > 0, F.col(f"var_{k}") / total) for k in ("first", "second")})


def shrunken_means(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Group means pulled towards the overall mean by how little their size supports them."""
    v = scalars(
        variance_components(rows, group, value),
        within=F.max("var_within"), between=F.max("var_between"),
    )
    mean = scalars(rows, m=F.avg(value))
    g = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("group_mean"))
    trust = v("between") / (v("between") + v("within") / F.col("n"))
    return g.where(F.col("n") > 0).withColumn(
        "shrunken_mean", mean("m") + trust * (F.col("group_mean") - mean("m"))
    )


def nonconstant(rows: DataFrame, columns: list[str]) -> list[str]:
    """Columns that take more than one value, from one aggregate."""
    if not columns:
        return []
    row = rows.agg(*[(F.max(c) > F.min(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def dummies(rows: DataFrame, column: str, levels: list[str]) -> tuple[DataFrame, list[str]]:
    """0/1 columns for all levels but the first."""
    names = {f"{column}_{i}": level for i, level in enumerate(levels) if i}
    return rows.withColumns(
        {n: (F.col(column) == level).cast("double") for n, level in names.items()}
    ), list(names)


