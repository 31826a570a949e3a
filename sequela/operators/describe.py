"""Descriptive tables: frequencies, histograms, box plots, profiles, balance tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sequela.functions.exprs import case, join_groups, scalars
from sequela.functions.tails import chi2_p, f_p
from sequela.operators.joins import BROADCAST_ROWS
from sequela.operators.ordered import ntile, quantiles
from sequela.session import checkpointed


def frequency(rows: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Count and percentage per value; with ``top``, only the most frequent ones."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    value = scalars(counts, total=F.sum("n"))
    out = counts.withColumn("pct", F.col("n") / value("total") * 100)
    return out.orderBy(F.col("n").desc(), column).limit(top) if top else out


def summary(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """Count, mean, sd, extremes and quartiles of a column per group."""
    base = rows.groupBy(*by).agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("sd"), F.sum(column).alias("total"),
        F.min(column).alias("low"), F.max(column).alias("high"),
    )
    q = quantiles(rows, by, {column: [0.25, 0.5, 0.75]})
    q = q.select(*by, *[F.col(f"q_{column}")[i].alias(n)
                        for i, n in enumerate(["q25", "median", "q75"])])
    return join_groups(base, q, by).withColumn("iqr", F.col("q75") - F.col("q25"))


def rows_per_entity(rows: DataFrame, entity: str) -> DataFrame:
    """Rows, entities and the median rows per entity; one row."""
    sizes = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("_n"))
    q = quantiles(sizes, [], {"_n": [0.5]})
    value = scalars(sizes, n=F.sum("_n"), entities=F.count(entity))
    return q.select(
        value("n").alias("n_rows"), value("entities").alias("n_entities"),
        F.col("q__n")[0].alias("median_rows"),
    )


def share(condition: Column) -> Column:
    """Percentage of rows meeting a condition; rows where it is null do not count."""
    return F.avg(condition.cast("double")) * 100


def histogram_width(rows: DataFrame, column: str, width: float, by: list[str] = ()) -> DataFrame:
    """Counts per fixed-width bin, named by its lower edge."""
    edge = (F.floor(F.col(column) / width) * width).alias("bin")
    return rows.groupBy(*by, edge).agg(F.count(F.lit(1)).alias("n"))


def histogram_equal(rows: DataFrame, column: str, bins: int = 30, by: list[str] = ()) -> DataFrame:
    """Counts in ``bins`` equal bins between the smallest and the largest value."""
    value = scalars(rows, low=F.min(column).cast("double"), high=F.max(column).cast("double"))
    width = (value("high") - value("low")) / bins
    place = F.floor((F.col(column) - value("low")) / F.nullif(width, F.lit(0.0)))
    bin_id = F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int")
    kept = rows.where(F.col(column).isNotNull()).withColumn("bin", bin_id)
    return kept.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
    )


def box_stats(rows: DataFrame, by: list[str], column: str, log10: bool = False) -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5 IQR, and how many lie outside."""
    x = F.log10(column) if log10 else F.col(column)
    rows = rows.select(*by, x.cast("double").alias("_x")).where(F.col("_x").isNotNull())
    q = quantiles(rows, by, {"_x": [0.25, 0.5, 0.75]})
    q1, q2, q3 = (F.col("q__x")[i] for i in range(3))
    q = q.select(
        *by, q1.alias("q25"), q2.alias("median"), q3.alias("q75"),
        (q1 - 1.5 * (q3 - q1)).alias("_lo"), (q3 + 1.5 * (q3 - q1)).alias("_hi"),
    )
    q = checkpointed(q)
    if q.count() <= BROADCAST_ROWS:
        values, q = rows.withColumn("_n", F.lit(1)), F.broadcast(q)
    else:  # equal values share a row before the fences are attached
        values = rows.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_n"))
    inside = F.col("_x").between(F.col("_lo"), F.col("_hi"))
    names = ["q25", "median", "q75"]
    return (
        join_groups(values, q, by)
        .groupBy(*by, *names)
        .agg(
            F.sum("_n").alias("n"),
            F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("_n"))).alias("n_outliers"),
        )
    )


def mean_interval(rows: DataFrame, by: list[str | Column], column: str, min_n: int = 30) -> DataFrame:
    """Mean with its normal 95 % interval per group of at least ``min_n`` rows."""
    half = 1.96 * F.col("sd") / F.sqrt("n")
    return (
        rows.groupBy(*by)
        .agg(F.count(column).alias("n"), F.avg(column).alias("mean"),
             F.stddev_samp(column).alias("sd"))
        .where(F.col("n") >= min_n)
        .withColumns({"lo": F.col("mean") - half, "hi": F.col("mean") + half})
    )


def mean_sd_text(mean: Column, sd: Column) -> Column:
    return F.format_string("%.1f (%.1f)", mean, sd)


def median_iqr_text(q: Column) -> Column:
    """``median [q25–q75]`` in whole numbers from an array (q25, median, q75)."""
    return F.format_string(
        "%d [%d–%d]", q[1].cast("int"), q[0].cast("int"), q[2].cast("int")
    )


def characterise(
    rows: DataFrame,
    by: list[str],
    rate: str = "rate",
    provider: str = "provider_id",
    means: list[str] = (),
    medians: list[str] = (),
    shares: dict[str, Column] | None = None,
) -> DataFrame:
    """One descriptive line per group: n, providers, rate range, text cells and percentages."""
    shares = shares or {}
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct(provider).alias("n_providers"),
        F.min(rate).alias("_lo"), F.max(rate).alias("_hi"), F.avg(rate).alias("_rate"),
        *[F.avg(c).alias(f"_m_{c}") for c in means],
        *[F.stddev_samp(c).alias(f"_s_{c}") for c in means],
        *[share(c).alias(f"_p_{n}") for n, c in shares.items()],
    )
    if medians:
        base = join_groups(base, quantiles(rows, by, {c: [0.25, 0.5, 0.75] for c in medians}), by)
    pct = lambda c: F.format_string("%.1f", F.round(F.col(c) * 100, 1))
    return base.select(
        *by, "n", "n_providers",
        F.concat(pct("_lo"), F.lit("–"), pct("_hi"), F.lit("%")).alias("rate_range"),
        F.round(F.col("_rate") * 100, 2).alias("rate_mean_pct"),
        *[mean_sd_text(F.col(f"_m_{c}"), F.col(f"_s_{c}")).alias(f"{c}_mean_sd") for c in means],
        *[median_iqr_text(F.col(f"q_{c}")).alias(f"{c}_med_iqr") for c in medians],
        *[F.round(f"_p_{n}", 1).alias(f"pct_{n}") for n in shares],
    )


def quartiles_within(
    rows: DataFrame, group: str, rate: str, tiebreak: list[str], out: str = "quartile"
) -> DataFrame:
    """Equal-count quarters of the rate inside each group; ties are broken by ``tiebreak``."""
    return ntile(rows, [group], [F.col(rate), *map(F.col, tiebreak)], 4, out, rate)


def provider_profile(
    rows: DataFrame, stratum: str, provider: str = "provider_id", means: list[str] = ()
) -> DataFrame:
    """Means of provider means per stratum, with the spread of provider volume."""
    per = rows.groupBy(provider, stratum).agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(c) for c in means]
    )
    per = per.groupBy(provider).agg(
        F.min(stratum).alias(stratum), F.sum("_n").alias("volume"),
        *[(F.sum(F.col(c) * F.col("_n")) / F.sum("_n")).alias(c) for c in means],
    )
    base = per.groupBy(stratum).agg(
        F.count(F.lit(1)).alias("n_providers"), F.max("volume").alias("volume_max"),
        *[F.avg(c).alias(f"mean_{c}") for c in means],
    )
    q = quantiles(per, [stratum], {"volume": [0.25, 0.5, 0.75]})
    return join_groups(base, q, [stratum]).withColumn(
        "volume_med_iqr", median_iqr_text(F.col("q_volume"))
    ).drop("q_volume")


def unit_profile(
    rows: DataFrame, unit: str, means: list[str], medians: list[str], rates: list[str]
) -> DataFrame:
    """Count, mean and sd, quartiles, and outcome rates per unit."""
    base = rows.groupBy(unit).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"{c}_mean") for c in means],
        *[F.stddev_samp(c).alias(f"{c}_sd") for c in means],
        *[F.avg(c).alias(f"{c}_rate") for c in rates],
    )
    q = quantiles(rows, [unit], {c: [0.25, 0.5, 0.75] for c in medians})
    return join_groups(
        base,
        q.select(unit, *[F.col(f"q_{c}")[i].alias(f"{c}_{n}") for c in medians
                         for i, n in enumerate(["q25", "median", "q75"])]),
        [unit],
    )


def median_quadrants(rows: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """Counts on either side of the medians of two columns."""
    table = quantiles(rows, [], {x: [0.5], y: [0.5]})
    value = scalars(table, x=F.first(f"q_{x}"), y=F.first(f"q_{y}"))
    side = F.concat(
        F.when(F.col(x) > value("x")[0], "high ").otherwise("low "), F.lit(x + ", "),
        F.when(F.col(y) > value("y")[0], "high ").otherwise("low "), F.lit(y),
    )
    kept = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return kept.groupBy(*by, side.alias("quadrant")).agg(F.count(F.lit(1)).alias("n"))


def category_outcome(
    rows: DataFrame, category: list[str], subject: str, flag: Column, outcome: Column
) -> DataFrame:
    """Distinct subjects, flag rate and outcome rate per category."""
    return rows.groupBy(*category).agg(
        F.countDistinct(subject).alias("n_subjects"),
        share(flag).alias("flag_pct"), share(outcome).alias("outcome_pct"),
    )


def _long_moments(rows: DataFrame, variables: list[str], stratum: str) -> DataFrame:
    wide = rows.groupBy(stratum).agg(
        *[F.count(v).alias(f"n__{v}") for v in variables],
        *[F.avg(v).alias(f"m__{v}") for v in variables],
        *[F.var_samp(v).alias(f"v__{v}") for v in variables],
    )
    cells = [
        F.struct(F.lit(v).alias("variable"), F.col(f"n__{v}").alias("n"),
                 F.col(f"m__{v}").alias("mean"), F.col(f"v__{v}").alias("var"))
        for v in variables
    ]
    return wide.select(F.col(stratum).alias("stratum"), F.explode(F.array(*cells)).alias("_c")).select(
        "stratum", "_c.*"
    )


def table_one_continuous(rows: DataFrame, variables: list[str], stratum: str) -> DataFrame:
    """Mean and sd per stratum and overall, SMD (mean over pairs of strata) and one-way ANOVA.

    One pass over the rows gives the moments per stratum; everything else follows from them.
    """
    m = _long_moments(rows.where(F.col(stratum).isNotNull()), variables, stratum)
    n, mean, var = F.col("n"), F.col("mean"), F.col("var")
    # Deviations from the grand mean are squared, so a large offset costs no digits.
    whole = Window.partitionBy("variable")
    m = m.withColumn("grand", F.sum(n * mean).over(whole) / F.sum(n).over(whole))
    total = m.groupBy("variable").agg(
        F.sum(n).alias("n"),
        (F.sum(n * mean) / F.sum(n)).alias("mean"),
        F.sum((n - 1) * var).alias("within"),
        F.sum(n * (mean - F.col("grand")) ** 2).alias("between"),
        F.count(F.lit(1)).alias("k"),
        F.collect_list(F.struct("mean", "var")).alias("cells"),
    )
    # A stratum pair contributes |difference| / pooled sd; strata are few by nature.
    pairs = F.flatten(
        F.transform(
            "cells",
            lambda a, i: F.transform(
                F.slice("cells", i + 2, F.greatest(F.size("cells") - i - 1, F.lit(0))),
                lambda b: F.abs(a["mean"] - b["mean"]) / F.sqrt((a["var"] + b["var"]) / 2),
            ),
        )
    )
    smd = F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x) / F.size(pairs)
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    stat = (F.col("between") / df1) / (F.col("within") / df2)
    total = total.select(
        "variable", "n", "mean",
        F.sqrt((F.col("within") + F.col("between")) / (F.col("n") - 1)).alias("sd"),
        smd.alias("smd"), stat.alias("statistic"), df1.alias("df1"), df2.alias("df2"),
    ).withColumn("p", f_p("statistic", F.col("df1").cast("double"), F.col("df2").cast("double")))
    overall = total.withColumn("stratum", F.lit("Overall"))
    tests = total.select("variable", "smd", "statistic", "df1", "df2", "p")
    per = m.withColumn("sd", F.sqrt("var")).select("variable", "stratum", "n", "mean", "sd")
    per = per.withColumn("stratum", F.col("stratum").cast("string")).join(tests, "variable")
    return per.unionByName(overall.select(per.columns))


def table_one_categorical(
    rows: DataFrame, variables: list[str], stratum: str, correct: bool = True
) -> DataFrame:
    """Counts and percentages per stratum and overall, and the chi-square test.

    The cells come from one grouped count over all variables at once. Two-by-two tables get the
    continuity correction unless ``correct`` is off.
    """
    rows = rows.where(F.col(stratum).isNotNull()).select(
        F.col(stratum).cast("string").alias("stratum"),
        F.explode(F.array(*[
            F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("level"))
            for v in variables
        ])).alias("_c"),
    ).select("stratum", "_c.*").where(F.col("level").isNotNull())
    cells = rows.groupBy("variable", "stratum", "level").agg(F.count(F.lit(1)).alias("n"))
    by_stratum = cells.groupBy("variable", "stratum").agg(F.sum("n").alias("_row"))
    by_level = cells.groupBy("variable", "level").agg(F.sum("n").alias("_col"))
    rows_of = by_stratum.groupBy("variable").agg(
        F.sum("_row").alias("_total"), F.count(F.lit(1)).alias("_k"),
        F.sum(1 / F.col("_row")).alias("_inv_rows"),
    )
    cols_of = by_level.groupBy("variable").agg(
        F.count(F.lit(1)).alias("_l"), F.sum(1 / F.col("_col")).alias("_inv_cols")
    )
    total = rows_of.join(cols_of, "variable")
    full = cells.join(by_stratum, ["variable", "stratum"]).join(by_level, ["variable", "level"])
    full = full.join(total, "variable")

    # Empty cells add their expected count, so the sum over filled cells is n * (sum o²/(r c) - 1).
    # In a two-by-two table all cells are equally far from their expectation.
    product = F.col("_row") * F.col("_col")
    off = F.col("_off") - F.least(F.lit(0.5), F.col("_off"))
    corrected = off * off * F.col("_total") * F.col("_inv_rows") * F.col("_inv_cols")
    plain = F.col("_total") * (F.col("_q") - 1)
    two_by_two = (F.col("_k") == 2) & (F.col("_l") == 2) & F.lit(correct)
    tests = (
        full.groupBy("variable", *[c for c in total.columns if c != "variable"])
        .agg(
            F.sum(F.col("n") * F.col("n") / product).alias("_q"),
            F.max(F.abs(F.col("n") - product / F.col("_total"))).alias("_off"),
        )
        .select(
            "variable",
            F.when(two_by_two, corrected).otherwise(plain).alias("statistic"),
            ((F.col("_k") - 1) * (F.col("_l") - 1)).alias("df1"),
        )
        .withColumn("p", chi2_p("statistic", F.col("df1").cast("double")))
    )
    per = full.select("variable", "stratum", "level", "n",
                      (F.col("n") / F.col("_row") * 100).alias("pct"))
    overall = by_level.join(total, "variable").select(
        "variable", F.lit("Overall").alias("stratum"), "level", F.col("_col").alias("n"),
        (F.col("_col") / F.col("_total") * 100).alias("pct"),
    )
    return per.unionByName(overall).join(tests, "variable")


def categorical_smd(rows: DataFrame, variables: list[str], stratum: str) -> DataFrame:
    """Standardised difference of level shares between two or more strata, mean over pairs.

    Works on the counts per variable, stratum and level. With p the shares without the first
    level and S the mean of their multinomial covariances, the difference is
    sqrt((p1 - p2)' S^-1 (p1 - p2)).
    """
    cells = table_one_categorical(rows, variables, stratum).where(F.col("stratum") != "Overall")

    def of_variable(pdf):
        import itertools

        import numpy as np
        import pandas as pd

        shares = pdf.pivot_table(index="stratum", columns="level", values="pct", fill_value=0) / 100
        p = shares.sort_index(axis=1).to_numpy()[:, 1:]
        found = []
        for a, b in itertools.combinations(p, 2):
            cov = (np.diag(a) - np.outer(a, a) + np.diag(b) - np.outer(b, b)) / 2
            found.append(float(np.sqrt(max((a - b) @ np.linalg.pinv(cov) @ (a - b), 0.0))))
        return pd.DataFrame({"variable": [pdf.variable.iloc[0]],
                             "smd": [float(np.mean(found)) if found else None]})

    return cells.select("variable", "stratum", "level", "pct").groupBy("variable").applyInPandas(
        of_variable, "variable string, smd double"
    )


def kpis(
    rows: DataFrame, subject: str, provider: str, flag: Column, outcome: Column
) -> DataFrame:
    """Headline numbers; one row."""
    return rows.agg(
        F.countDistinct(subject).alias("n_subjects"),
        F.countDistinct(provider).alias("n_providers"),
        share(flag).alias("flag_pct"), share(outcome).alias("outcome_pct"),
    )


def volume_contrast(
    providers: DataFrame, volume: str, rate: str, low: int = 20, high: int = 50
) -> DataFrame:
    """Mean rate of low-volume and of high-volume providers; one row."""
    return providers.agg(
        F.avg(F.when(F.col(volume) < low, F.col(rate))).alias("low_volume_rate"),
        F.avg(F.when(F.col(volume) >= high, F.col(rate))).alias("high_volume_rate"),
        F.avg(rate).alias("overall_mean"),
    )
