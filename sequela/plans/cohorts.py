"""Queries on cohorts, provider summaries and descriptive tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sequela.functions.exprs import join_groups, r6
from sequela.operators import cohort as K
from sequela.operators import describe as D
from sequela.operators import providers as P
from sequela.operators.joins import label_by, lookup, star
from sequela.plans.registry import query
from sequela.session import shared_folder, staged
from sequela.sources import adapters as A
from sequela.sources.tables import read_table, read_typed_csv, write_csv


def patient(spark, folder, *columns):
    return _kept(K.patient_cohort, spark, folder, columns)


def base(spark, folder, *columns):
    return _kept(K.analysis_base, spark, folder, columns)


def _kept(make, spark, folder, columns):
    """The rows of ``make``; with ``columns``, these columns written once for a query of several passes."""
    if not columns:
        return make(A.rated(spark, folder), A.SPEC)
    rows = make(A.rated(spark, folder, [*columns, *A.SPEC.required]), A.SPEC)
    return staged(rows.select(*dict.fromkeys(columns)), "study-rows")


def cohort_columns(spark, folder, *columns):
    """Columns of the cohort, written once."""
    return staged(A.cohort(spark, folder).select(*columns), "study-rows")


def rounded(df, *columns: str):
    return df.withColumns({c: r6(c) for c in columns})


# ── Projections and filters ──────────────────────────────────────────────────────────────────

@query("WITH" + A.COHORT + """
SELECT subject_id, count(*) AS n FROM cohort
WHERE hours > 100 AND hours < 800 AND dose < 0.05 AND n_failures < 6 GROUP BY subject_id""")
def plausible_ranges(spark, folder):
    rows = K.plausible(A.cohort(spark, folder), "hours", "dose", "n_failures", 100, 800, 0.05, 6)
    return rows.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))


@query("WITH" + A.COHORT + """
SELECT provider_id, count(*) AS n FROM cohort
WHERE diagnosis IS NOT NULL AND death_date IS NOT NULL GROUP BY provider_id""")
def complete_cases(spark, folder):
    rows = K.complete_cases(A.cohort(spark, folder), ["diagnosis", "death_date"])
    return rows.groupBy("provider_id").agg(F.count(F.lit(1)).alias("n"))


@query("WITH" + A.COHORT + """,
d AS (SELECT *, date_diff('day', CAST(event_time AS DATE), death_date) AS days FROM cohort)
SELECT unit, CAST(sum(CASE WHEN death_date IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_survived,
       CAST(sum(died) AS BIGINT) AS n_died,
       round(avg(days), 6) AS mean_days,
       CAST(sum(CASE WHEN death_date IS NOT NULL AND days <= 30 THEN 1 ELSE 0 END) AS BIGINT) AS n_early,
       CAST(sum(CASE WHEN gender = 'M' AND death_date IS NOT NULL AND days <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_comfort
FROM d GROUP BY unit""")
def outcomes(spark, folder):
    rows = A.cohort(spark, folder).withColumn("expired", (F.col("gender") == "M").cast("int"))
    rows = K.outcomes(rows)
    return rows.groupBy("unit").agg(
        F.sum(F.col("survived").cast("long")).alias("n_survived"),
        F.sum("died").alias("n_died"), r6(F.avg("days_to_death")).alias("mean_days"),
        F.sum("died_early").alias("n_early"),
        F.sum(F.col("likely_comfort").cast("long")).alias("n_comfort"),
    )


@query("WITH" + A.BASE + """
SELECT 'patient' AS cohort, count(*) AS n, count(DISTINCT provider_id) AS n_providers FROM patient
UNION ALL SELECT 'explicit', count(*), count(DISTINCT provider_id) FROM explicit_cohort
UNION ALL SELECT 'base', count(*), count(DISTINCT provider_id) FROM base""")
def nested_cohorts(spark, folder):
    rows = A.rated(spark, folder)
    parts = [("patient", K.patient_cohort), ("explicit", K.explicit_cohort),
             ("base", K.analysis_base)]
    out = [
        make(rows, A.SPEC).agg(F.count(F.lit(1)).alias("n"),
                               F.countDistinct("provider_id").alias("n_providers"))
        .select(F.lit(name).alias("cohort"), "n", "n_providers")
        for name, make in parts
    ]
    return out[0].unionByName(out[1]).unionByName(out[2])


LABEL_RULES = [("URGENT", "urgent"), ("HIGH", "high"), ("NOT SPEC", "unknown")]


@query("WITH" + A.BASE + """
SELECT unit, unit_group,
       CASE WHEN unit LIKE '%URGENT%' THEN 'urgent' WHEN unit LIKE '%HIGH%' THEN 'high'
            WHEN unit LIKE '%NOT SPEC%' THEN 'unknown' ELSE unit END AS short,
       CASE unit WHEN '5-LOW' THEN 'low' ELSE 'not low' END AS lowness, count(*) AS n
FROM base GROUP BY 1, 2, 3, 4""")
def unit_labels(spark, folder):
    rows = base(spark, folder).withColumns({
        "short": K.short_label("unit", LABEL_RULES),
        "lowness": label_by(F.col("unit"), {"5-LOW": "low"}, "not low"),
    })
    return rows.groupBy("unit", "unit_group", "short", "lowness").agg(F.count(F.lit(1)).alias("n"))


@query("WITH" + A.BASE + """,
m AS (SELECT avg(age) AS ma, stddev_samp(age) AS sa, avg(rate) AS mr, stddev_samp(rate) AS sr FROM base)
SELECT unit, round(sum(age - ma), 4) AS age_centered, round(sum((age - ma) / sa), 4) AS age_scaled,
       round(sum((rate - mr) / sr), 4) AS rate_scaled
FROM base, m GROUP BY unit""")
def centred_scaled(spark, folder):
    rows = K.centred_scaled(base(spark, folder, "unit", "age", "rate"), ["age", "rate"])
    return rows.groupBy("unit").agg(*[
        F.round(F.sum(c), 4).alias(c) for c in ("age_centered", "age_scaled", "rate_scaled")
    ])


@query("WITH" + A.RATED + """
SELECT CASE WHEN provider_n < 440 THEN '1' WHEN provider_n < 450 THEN '2'
            WHEN provider_n < 460 THEN '3' ELSE '4' END AS tier,
       CASE WHEN died = 0 THEN 'Survived 12 mo' ELSE 'Did Not Survive' END AS outcome,
       CASE category WHEN 'surgical' THEN 'Surgical' WHEN 'medical-respiratory'
            THEN 'Medical – Respiratory' ELSE 'Medical – Non-Respiratory' END AS category_label,
       n_failures > 0 AS had_failure, count(*) AS n
FROM rated GROUP BY 1, 2, 3, 4""")
def display_labels(spark, folder):
    rows = A.rated(spark, folder).withColumn("survived", F.col("died") == 0).select(
        K.volume_tier("provider_n", [(440, "1"), (450, "2"), (460, "3")], "4").alias("tier"),
        K.outcome_label("survived").alias("outcome"),
        K.category_label("category").alias("category_label"),
        (F.col("n_failures") > 0).alias("had_failure"),
    )
    return rows.groupBy("tier", "outcome", "category_label", "had_failure").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("WITH" + A.BASE + """,
q AS (SELECT quantile_cont(rate, 0.25) AS a, quantile_cont(rate, 0.5) AS b,
             quantile_cont(rate, 0.75) AS c FROM base)
SELECT CASE WHEN rate <= a THEN 'Q1 (lowest)' WHEN rate <= b THEN 'Q2' WHEN rate <= c THEN 'Q3'
            ELSE 'Q4 (highest)' END AS stratum,
       count(*) AS n, round(avg(rate), 6) AS mean_rate, round(avg(died), 6) AS mortality
FROM base, q GROUP BY 1""")
def quantile_strata(spark, folder):
    rows = K.quantile_strata(base(spark, folder, "rate", "died"), "rate", "stratum")
    return rows.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("rate")).alias("mean_rate"),
        r6(F.avg("died")).alias("mortality"),
    )


ZERO = A.BASE + """,
z AS (SELECT quantile_cont(severity, 0.5) AS a, quantile_cont(severity, 0.75) AS b
      FROM base WHERE severity > 0),
strata AS (
  SELECT base.*, CASE WHEN severity = 0 THEN '0%' WHEN severity <= a THEN '>0–median'
              WHEN severity <= b THEN 'median–Q75' ELSE '>Q75' END AS stratum
  FROM base, z)"""


def strata(spark, folder):
    rows = base(spark, folder, "severity", "age", "died", "rate", "provider_id")
    return K.zero_aware_strata(rows, "severity", "stratum")


@query("WITH" + ZERO + """
SELECT stratum, count(*) AS n, round(avg(severity), 6) AS mean_severity FROM strata GROUP BY stratum""")
def zero_aware_strata(spark, folder):
    return strata(spark, folder).groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("severity")).alias("mean_severity")
    )


# ── Joins and provider statistics ────────────────────────────────────────────────────────────

@query("""
WITH d AS (SELECT l_orderkey, max(l_tax) AS dose FROM lineitem WHERE l_quantity > 30 GROUP BY l_orderkey),
f AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
SELECT o_orderkey, c_mktsegment, n_name, coalesce(dose, 0) AS dose, coalesce(n, 0) AS n_failures
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN d ON o_orderkey = d.l_orderkey LEFT JOIN f ON o_orderkey = f.l_orderkey""")
def star_assembly(spark, folder):
    orders = read_table(spark, folder, "orders", ["o_orderkey", "o_custkey"])
    customer = read_table(spark, folder, "customer", ["c_custkey", "c_mktsegment", "c_nationkey"])
    nation = read_table(spark, folder, "nation", ["n_nationkey", "n_name"])
    lines = read_table(spark, folder, "lineitem",
                       ["l_orderkey", "l_tax", "l_quantity", "l_returnflag"])
    lines = lines.withColumnRenamed("l_orderkey", "o_orderkey")
    dose = P.subject_max(lines.where(F.col("l_quantity") > 30), "o_orderkey", dose="l_tax")
    failures = lines.where(F.col("l_returnflag") == "R").groupBy("o_orderkey").agg(
        F.count(F.lit(1)).alias("n_failures"))
    customer = lookup(customer, nation.withColumnRenamed("n_nationkey", "c_nationkey"), ["c_nationkey"])
    wide = star(orders, (dose, ["o_orderkey"]), (failures, ["o_orderkey"]))
    wide = lookup(wide, customer.withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"])
    return wide.select(
        "o_orderkey", "c_mktsegment", "n_name", F.coalesce("dose", F.lit(0.0)).alias("dose"),
        F.coalesce("n_failures", F.lit(0)).alias("n_failures"),
    )


@query("WITH" + A.COHORT + """
SELECT subject_id, max(severity) AS severity, max(dose) AS dose, max(expired) AS expired
FROM cohort GROUP BY subject_id""")
def subject_max(spark, folder):
    return P.subject_max(A.cohort(spark, folder), "subject_id", severity="severity", dose="dose",
                         expired="expired")


@query("WITH" + A.RATED + """,
n AS (SELECT provider_id, unit, count(*) AS n FROM rated GROUP BY provider_id, unit)
SELECT provider_id, unit AS primary_unit FROM n
QUALIFY row_number() OVER (PARTITION BY provider_id ORDER BY n DESC, unit DESC) = 1""")
def primary_unit(spark, folder):
    return P.primary_unit(A.rated(spark, folder))


OUTCOMES = {"mortality_rate": "died", "expire_rate": "expired"}
SUMMARY = A.BASE + """,
cells AS (SELECT provider_id, unit, count(*) AS n, max(rate) AS rate FROM base GROUP BY 1, 2),
best AS (SELECT provider_id, unit AS primary_unit, rate AS provider_rate FROM cells
         QUALIFY row_number() OVER (PARTITION BY provider_id ORDER BY n DESC, unit DESC) = 1),
summary AS (
  SELECT b.provider_id, max(provider_rate) AS provider_rate, max(provider_n) AS provider_n,
         avg(died) AS mortality_rate, avg(expired) AS expire_rate, count(*) AS n_sample,
         max(primary_unit) AS primary_unit
  FROM (SELECT * EXCLUDE (provider_rate) FROM base) b
  JOIN best ON b.provider_id = best.provider_id GROUP BY b.provider_id)"""


def summary(spark, folder):
    return P.provider_summary(base(spark, folder), outcomes=OUTCOMES)


@query("WITH" + SUMMARY + """
SELECT provider_id, round(provider_rate, 6) AS provider_rate, provider_n,
       round(mortality_rate, 6) AS mortality_rate, round(expire_rate, 6) AS expire_rate,
       n_sample, primary_unit
FROM summary""")
def provider_summary(spark, folder):
    return rounded(summary(spark, folder), "provider_rate", "mortality_rate", "expire_rate")


@query("WITH" + ZERO + """,
per AS (SELECT provider_id, min(stratum) AS stratum, count(*) AS volume, avg(age) AS age,
               avg(died) AS died FROM strata GROUP BY provider_id)
SELECT stratum, count(*) AS n_providers, max(volume) AS volume_max, round(avg(age), 6) AS mean_age,
       round(avg(died), 6) AS mean_died,
       CAST(CAST(trunc(median(volume)) AS BIGINT) AS VARCHAR) || ' [' ||
       CAST(CAST(trunc(quantile_cont(volume, 0.25)) AS BIGINT) AS VARCHAR) || '–' ||
       CAST(CAST(trunc(quantile_cont(volume, 0.75)) AS BIGINT) AS VARCHAR) || ']' AS volume_med_iqr
FROM per GROUP BY stratum""")
def provider_profile(spark, folder):
    out = D.provider_profile(strata(spark, folder), "stratum", means=["age", "died"])
    return rounded(out, "mean_age", "mean_died")


# ── Aggregates ───────────────────────────────────────────────────────────────────────────────

@query("""
SELECT count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_entities,
       (SELECT median(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey)) AS median_rows
FROM lineitem""")
def rows_per_entity(spark, folder):
    return D.rows_per_entity(read_table(spark, folder, "lineitem", ["l_suppkey"]), "l_suppkey")


@query("WITH" + A.COHORT + """
SELECT unit, count(hours) AS n, round(avg(hours), 6) AS mean, round(stddev_samp(hours), 6) AS sd,
       round(sum(hours), 4) AS total, min(hours) AS low, max(hours) AS high,
       round(quantile_cont(hours, 0.25), 6) AS q25, round(median(hours), 6) AS median,
       round(quantile_cont(hours, 0.75), 6) AS q75,
       round(quantile_cont(hours, 0.75) - quantile_cont(hours, 0.25), 6) AS iqr
FROM cohort GROUP BY unit""")
def group_summary(spark, folder):
    out = D.summary(cohort_columns(spark, folder, "unit", "hours"), ["unit"], "hours")
    out = out.withColumn("total", F.round("total", 4))
    return rounded(out, "mean", "sd", "q25", "median", "q75", "iqr")


@query("WITH" + A.COHORT + """
SELECT unit, round(100 * avg(CASE WHEN category = 'surgical' THEN 1.0 ELSE 0 END), 6) AS pct_surgical,
       round(100 * avg(CASE WHEN diagnosis = 'D1' THEN 1.0 WHEN diagnosis IS NOT NULL THEN 0 END), 6) AS pct_d1
FROM cohort GROUP BY unit""")
def conditional_shares(spark, folder):
    return A.cohort(spark, folder).groupBy("unit").agg(
        r6(D.share(F.col("category") == "surgical")).alias("pct_surgical"),
        r6(D.share(F.col("diagnosis") == "D1")).alias("pct_d1"),
    )


@query("WITH" + A.COHORT + """
SELECT diagnosis, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM cohort
       WHERE diagnosis IS NOT NULL), 6) AS pct
FROM cohort WHERE diagnosis IS NOT NULL GROUP BY diagnosis ORDER BY n DESC, diagnosis LIMIT 4""")
def frequency_top(spark, folder):
    rows = A.cohort(spark, folder).where(F.col("diagnosis").isNotNull())
    return rounded(D.frequency(rows, "diagnosis", 4), "pct")


@query("WITH" + A.COHORT + """
SELECT floor(age / 5) * 5 AS bin, died, count(*) AS n FROM cohort GROUP BY 1, 2""")
def histogram_width(spark, folder):
    out = D.histogram_width(A.cohort(spark, folder), "age", 5, ["died"])
    return out.withColumn("bin", F.col("bin").cast("double"))


@query("WITH" + A.COHORT + """,
m AS (SELECT min(hours) AS lo, max(hours) AS hi FROM cohort)
SELECT source, CAST(least(floor((hours - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin,
       count(*) AS n, min(hours) AS low, max(hours) AS high
FROM cohort, m GROUP BY 1, 2""")
def histogram_equal(spark, folder):
    return D.histogram_equal(A.cohort(spark, folder), "hours", 30, ["source"])


def box_sql(x: str) -> str:
    return f"""
q AS (SELECT unit, quantile_cont({x}, 0.25) AS q25, median({x}) AS median,
             quantile_cont({x}, 0.75) AS q75 FROM cohort GROUP BY unit)
SELECT c.unit, round(max(q25), 6) AS q25, round(max(median), 6) AS median, round(max(q75), 6) AS q75,
       count(*) AS n,
       round(min({x}) FILTER ({x} >= q25 - 1.5 * (q75 - q25)), 6) AS whisker_low,
       round(max({x}) FILTER ({x} <= q75 + 1.5 * (q75 - q25)), 6) AS whisker_high,
       count(*) FILTER ({x} < q25 - 1.5 * (q75 - q25) OR {x} > q75 + 1.5 * (q75 - q25)) AS n_outliers
FROM cohort c JOIN q ON c.unit = q.unit GROUP BY c.unit"""


BOX = ("q25", "median", "q75", "whisker_low", "whisker_high")


@query("WITH" + A.COHORT + "," + box_sql("hours"))
def box_stats(spark, folder):
    return rounded(D.box_stats(cohort_columns(spark, folder, "unit", "hours"), ["unit"], "hours"), *BOX)


@query("WITH" + A.COHORT + "," + box_sql("log10(hours)"))
def box_stats_log(spark, folder):
    return rounded(D.box_stats(cohort_columns(spark, folder, "unit", "hours"), ["unit"], "hours", log10=True), *BOX)


@query("WITH" + A.COHORT + """
SELECT severity, died, count(*) AS n, round(avg(age), 6) AS mean, round(stddev_samp(age), 6) AS sd,
       round(avg(age) - 1.96 * stddev_samp(age) / sqrt(count(*)), 6) AS lo,
       round(avg(age) + 1.96 * stddev_samp(age) / sqrt(count(*)), 6) AS hi
FROM cohort GROUP BY severity, died HAVING count(*) >= 30""")
def mean_interval(spark, folder):
    out = D.mean_interval(A.cohort(spark, folder), ["severity", "died"], "age")
    return rounded(out, "mean", "sd", "lo", "hi")


# ── Quartiles, profiles, flow ────────────────────────────────────────────────────────────────

TIEBREAK = ["subject_id", "provider_id", "part_id", "age", "hours", "severity", "dose", "n_failures",
            "died", "expired", "failed", "death_date"]
QUARTILES = A.BASE + """,
quarters AS (
  SELECT *, ntile(4) OVER (PARTITION BY unit_group ORDER BY rate, """ + ", ".join(TIEBREAK) + """) AS quartile
  FROM base WHERE unit_group <> 'Other')"""


def quarters(spark, folder):
    rows = base(spark, folder, *TIEBREAK, "unit_group", "rate", "gender", "category").where(F.col("unit_group") != "Other")
    return D.quartiles_within(rows, "unit_group", "rate", TIEBREAK)


@query("WITH" + QUARTILES + """
SELECT unit_group, CAST(quartile AS INTEGER) AS quartile, count(*) AS n,
       count(DISTINCT provider_id) AS n_providers, round(min(rate), 6) AS rate_min,
       round(max(rate), 6) AS rate_max, round(avg(died), 6) AS mortality
FROM quarters GROUP BY 1, 2""")
def quartiles_within(spark, folder):
    return quarters(spark, folder).groupBy("unit_group", "quartile").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("provider_id").alias("n_providers"),
        r6(F.min("rate")).alias("rate_min"), r6(F.max("rate")).alias("rate_max"),
        r6(F.avg("died")).alias("mortality"),
    )


def characterised(spark, folder):
    """The quarters with the columns of the descriptive tables, written once."""
    rows = quarters(spark, folder)
    return staged(rows.select("unit_group", "quartile", "provider_id", "rate", "age", "severity", "hours",
                              "gender", "category", "died"), "study-rows")


# Cells of the text table, apart: the same numbers before they are put into words.
@query("WITH" + QUARTILES + """
SELECT unit_group, CAST(quartile AS INTEGER) AS quartile, count(*) AS n,
       count(DISTINCT provider_id) AS n_providers,
       CAST(CAST(trunc(median(hours)) AS BIGINT) AS VARCHAR) || ' [' ||
       CAST(CAST(trunc(quantile_cont(hours, 0.25)) AS BIGINT) AS VARCHAR) || '–' ||
       CAST(CAST(trunc(quantile_cont(hours, 0.75)) AS BIGINT) AS VARCHAR) || ']' AS hours_med_iqr,
       round(100 * avg(CASE WHEN gender = 'M' THEN 1.0 ELSE 0.0 END), 1) AS pct_male,
       round(100 * avg(CASE WHEN category = 'surgical' THEN 1.0 ELSE 0.0 END), 1) AS pct_surgical
FROM quarters GROUP BY 1, 2""")
def characterise(spark, folder):
    out = D.characterise(
        characterised(spark, folder), ["unit_group", "quartile"], means=["age", "severity"],
        medians=["hours"],
        shares={"male": F.col("gender") == "M", "surgical": F.col("category") == "surgical"},
    )
    return out.select("unit_group", "quartile", "n", "n_providers", "hours_med_iqr", "pct_male",
                      "pct_surgical")


@query()
def characterise_text(spark, folder):
    return D.characterise(
        characterised(spark, folder), ["unit_group", "quartile"], means=["age", "severity"],
        medians=["hours"], shares={"died": F.col("died") == 1},
    )


@query("WITH" + ZERO + """
SELECT stratum, count(*) AS n, count(DISTINCT provider_id) AS n_providers,
       round(100 * avg(rate), 2) AS rate_mean_pct,
       round(100 * avg(CASE WHEN died = 1 THEN 1.0 ELSE 0.0 END), 1) AS pct_died
FROM strata GROUP BY stratum""")
def characterise_strata(spark, folder):
    out = D.characterise(strata(spark, folder), ["stratum"], shares={"died": F.col("died") == 1})
    return out.select("stratum", "n", "n_providers", "rate_mean_pct", "pct_died")


@query("WITH" + A.BASE + """
SELECT unit, count(*) AS n, round(avg(age), 6) AS age_mean, round(stddev_samp(age), 6) AS age_sd,
       round(quantile_cont(hours, 0.25), 6) AS hours_q25, round(median(hours), 6) AS hours_median,
       round(quantile_cont(hours, 0.75), 6) AS hours_q75, round(avg(died), 6) AS died_rate
FROM patient GROUP BY unit""")
def unit_profile(spark, folder):
    out = D.unit_profile(patient(spark, folder, "unit", "age", "hours", "died"), "unit", ["age"], ["hours"], ["died"])
    return rounded(out, "age_mean", "age_sd", "hours_q25", "hours_median", "hours_q75", "died_rate")


@query("WITH" + SUMMARY + """
SELECT primary_unit, count(*) AS n_providers,
       round(median(provider_rate), 6) AS rate_median,
       round(quantile_cont(provider_rate, 0.25), 6) AS rate_q25,
       round(quantile_cont(provider_rate, 0.75), 6) AS rate_q75,
       round(max(provider_rate), 6) AS rate_max, round(median(provider_n), 6) AS volume_median,
       max(provider_n) AS volume_max, round(avg(mortality_rate), 6) AS mortality_mean
FROM summary GROUP BY primary_unit""")
def providers_by_unit(spark, folder):
    rows = summary(spark, folder).persist()
    q = D.quantiles(rows, ["primary_unit"], {"provider_rate": [0.25, 0.5, 0.75],
                                             "provider_n": [0.5]})
    out = rows.groupBy("primary_unit").agg(
        F.count(F.lit(1)).alias("n_providers"), F.max("provider_rate").alias("rate_max"),
        F.max("provider_n").alias("volume_max"), F.avg("mortality_rate").alias("mortality_mean"),
    )
    out = join_groups(out, q, ["primary_unit"])
    return out.select(
        "primary_unit", "n_providers", "volume_max",
        r6(F.col("q_provider_rate")[1]).alias("rate_median"),
        r6(F.col("q_provider_rate")[0]).alias("rate_q25"),
        r6(F.col("q_provider_rate")[2]).alias("rate_q75"), r6("rate_max").alias("rate_max"),
        r6(F.col("q_provider_n")[0]).alias("volume_median"),
        r6("mortality_mean").alias("mortality_mean"),
    )


@query("WITH" + A.BASE + """
SELECT unit, count(*) AS n, count(DISTINCT provider_id) AS n_providers,
       round(avg(rate), 6) AS mean_rate, round(avg(severity), 6) AS mean_severity,
       round(avg(died), 6) AS mortality
FROM explicit_cohort GROUP BY unit""")
def unit_severity(spark, folder):
    rows = K.explicit_cohort(A.rated(spark, folder), A.SPEC)
    return rows.groupBy("unit").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("provider_id").alias("n_providers"),
        r6(F.avg("rate")).alias("mean_rate"), r6(F.avg("severity")).alias("mean_severity"),
        r6(F.avg("died")).alias("mortality"),
    )


FLOW_COLUMNS = ["subject_id", *A.SPEC.required]
FLOW = A.BASE + """,
flow AS (
  SELECT *, 1 + CASE WHEN hours IS NULL OR severity IS NULL OR diagnosis IS NULL THEN 0
    WHEN source <> 'explicit' THEN 1
    WHEN provider_unit_n IS NULL OR coalesce(provider_n, 0) < 440
      OR unit NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') THEN 2
    WHEN provider_unit_n < 85 THEN 3
    WHEN unit NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 4 ELSE 5 END AS depth
  FROM rated),
stages AS (SELECT * FROM (VALUES (0, 'all'), (1, 'complete'), (2, 'explicit'), (3, 'volume'),
                                 (4, 'unit_volume'), (5, 'grouped')) t(stage_no, stage))"""


@query("WITH" + FLOW + """
SELECT stage_no, stage, count(*) FILTER (depth > stage_no) AS n_rows,
       count(DISTINCT CASE WHEN depth > stage_no THEN subject_id END) AS n_subjects,
       count(DISTINCT CASE WHEN depth > stage_no THEN provider_id END) AS n_providers,
       count(*) FILTER (depth > greatest(stage_no - 1, 0)) - count(*) FILTER (depth > stage_no) AS n_excluded
FROM flow, stages GROUP BY stage_no, stage""")
def cohort_flow(spark, folder):
    return K.cohort_flow(A.rated(spark, folder, FLOW_COLUMNS), A.SPEC.stages())


@query("WITH" + FLOW + """
SELECT category, stage_no, stage, count(*) FILTER (depth > stage_no) AS n_rows,
       count(DISTINCT CASE WHEN depth > stage_no THEN subject_id END) AS n_subjects,
       count(DISTINCT CASE WHEN depth > stage_no THEN provider_id END) AS n_providers,
       count(*) FILTER (depth > greatest(stage_no - 1, 0)) - count(*) FILTER (depth > stage_no) AS n_excluded
FROM flow, stages GROUP BY category, stage_no, stage""")
def cohort_flow_by_category(spark, folder):
    return K.cohort_flow(A.rated(spark, folder, [*FLOW_COLUMNS, "category"]), A.SPEC.stages(), by=["category"])


@query("WITH" + A.BASE + """
SELECT count(*) AS n, CAST(sum(n_failures) AS BIGINT) AS n_failures,
       round(avg(CASE WHEN n_failures > 0 THEN 1.0 ELSE 0 END), 6) AS share_any,
       round(avg(CASE WHEN n_failures > 1 THEN 1.0 ELSE 0 END), 6) AS share_several,
       round(avg(n_failures), 6) AS mean_count, round(avg(rate), 6) AS mean_rate,
       round(avg(CASE WHEN rate = 0 THEN 1.0 ELSE 0 END), 6) AS share_zero_rate,
       count(*) FILTER (n_failures > 1) AS n_several,
       round(avg(rate) FILTER (n_failures > 1), 6) AS mean_rate_several,
       round(avg(CASE WHEN rate < 0.5 THEN 1.0 ELSE 0 END) FILTER (n_failures > 1), 6) AS share_low_rate_several,
       round(avg(rate) FILTER (n_failures > 0), 6) AS mean_rate_any,
       round(avg(rate) FILTER (n_failures = 0), 6) AS mean_rate_none
FROM patient""")
def failure_count_checks(spark, folder):
    out = K.failure_count_checks(patient(spark, folder), "n_failures", low_rate=0.5)
    exact = {"n", "n_failures", "n_several"}
    return rounded(out, *[c for c in out.columns if c not in exact])


@query("WITH" + A.BASE + """
SELECT n_failures, source, count(*) AS n, round(avg(hours), 6) AS mean_hours,
       round(avg(severity), 6) AS mean_severity
FROM patient GROUP BY n_failures, source""")
def means_by_count(spark, folder):
    out = K.means_by(patient(spark, folder), ["n_failures", "source"], ["hours", "severity"])
    return rounded(out, "mean_hours", "mean_severity")


@query("WITH" + A.RATED + """
SELECT count(DISTINCT subject_id) AS n_subjects, count(DISTINCT provider_id) AS n_providers,
       round(100 * avg(CASE WHEN n_failures > 0 THEN 1.0 ELSE 0 END), 6) AS flag_pct,
       round(100 * avg(CASE WHEN died = 0 THEN 1.0 ELSE 0 END), 6) AS outcome_pct
FROM rated""")
def kpis(spark, folder):
    out = D.kpis(A.rated(spark, folder), "subject_id", "provider_id", F.col("n_failures") > 0,
                 F.col("died") == 0)
    return rounded(out, "flag_pct", "outcome_pct")


@query("WITH" + SUMMARY + """
SELECT round(avg(provider_rate) FILTER (provider_n < 450), 6) AS low_volume_rate,
       round(avg(provider_rate) FILTER (provider_n >= 460), 6) AS high_volume_rate,
       round(avg(provider_rate), 6) AS overall_mean
FROM summary""")
def volume_contrast(spark, folder):
    out = D.volume_contrast(summary(spark, folder), "provider_n", "provider_rate", 450, 460)
    return rounded(out, "low_volume_rate", "high_volume_rate", "overall_mean")


@query("WITH" + A.RATED + """
SELECT category, died, count(DISTINCT subject_id) AS n_subjects,
       round(100 * avg(CASE WHEN n_failures > 0 THEN 1.0 ELSE 0 END), 6) AS flag_pct,
       round(100 * avg(CASE WHEN died = 0 THEN 1.0 ELSE 0 END), 6) AS outcome_pct
FROM rated GROUP BY category, died""")
def category_outcome(spark, folder):
    out = D.category_outcome(A.rated(spark, folder), ["category", "died"], "subject_id",
                             F.col("n_failures") > 0, F.col("died") == 0)
    return rounded(out, "flag_pct", "outcome_pct")


@query("WITH" + A.COHORT + """,
m AS (SELECT median(age) AS a, median(severity) AS s FROM cohort)
SELECT died, CASE WHEN age > a THEN 'high ' ELSE 'low ' END || 'age, ' ||
       CASE WHEN severity > s THEN 'high ' ELSE 'low ' END || 'severity' AS quadrant, count(*) AS n
FROM cohort, m GROUP BY 1, 2""")
def median_quadrants(spark, folder):
    return D.median_quadrants(cohort_columns(spark, folder, "age", "severity", "died"), "age", "severity", ["died"])


CONTINUOUS = ["age", "severity", "dose", "hours", "n_failures"]


def anova_sql(stratum: str) -> str:
    long = " UNION ALL ".join(
        f"SELECT '{v}' AS variable, {stratum} AS stratum, CAST({v} AS DOUBLE) AS x FROM patient"
        for v in CONTINUOUS)
    return f"""
long AS ({long}),
m AS (SELECT variable, stratum, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS sd, var_samp(x) AS v
      FROM long GROUP BY 1, 2),
t AS (SELECT variable, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS sd FROM long GROUP BY 1),
f AS (SELECT m.variable, count(*) AS k, max(t.n) AS total,
             (sum(m.n * (m.mean - t.mean) * (m.mean - t.mean)) / (count(*) - 1))
             / (sum((m.n - 1) * v) / (max(t.n) - count(*))) AS statistic
      FROM m JOIN t ON m.variable = t.variable GROUP BY 1),
s AS (SELECT a.variable, avg(abs(a.mean - b.mean) / sqrt((a.v + b.v) / 2)) AS smd
      FROM m a JOIN m b ON a.variable = b.variable AND a.stratum < b.stratum GROUP BY 1)
SELECT x.variable, stratum, x.n, round(mean, 5) AS mean, round(sd, 5) AS sd, round(smd, 6) AS smd,
       round(statistic, 4) AS statistic, k - 1 AS df1, total - k AS df2
FROM (SELECT variable, stratum, n, mean, sd FROM m
      UNION ALL SELECT variable, 'Overall', n, mean, sd FROM t) x
JOIN f ON x.variable = f.variable JOIN s ON x.variable = s.variable"""


def table_one_numbers(rows, stratum):
    out = D.table_one_continuous(rows, CONTINUOUS, stratum).drop("p")
    return out.withColumns({"mean": F.round("mean", 5), "sd": F.round("sd", 5), "smd": r6("smd"),
                            "statistic": F.round("statistic", 4)})


@query("WITH" + A.BASE + "," + anova_sql("source"))
def table_one_continuous(spark, folder):
    return table_one_numbers(patient(spark, folder, *CONTINUOUS, "source"), "source")


@query("WITH" + A.BASE + "," + anova_sql("unit"))
def table_one_continuous_by_unit(spark, folder):
    return table_one_numbers(patient(spark, folder, *CONTINUOUS, "unit"), "unit")


CATEGORICAL = ["gender", "category", "diagnosis", "died"]
CHI = """
long AS (""" + " UNION ALL ".join(
    f"SELECT '{v}' AS variable, source AS stratum, CAST({v} AS VARCHAR) AS level FROM patient"
    for v in CATEGORICAL) + """),
c AS (SELECT variable, stratum, level, count(*) AS n FROM long GROUP BY 1, 2, 3),
r AS (SELECT variable, stratum, sum(n) AS r FROM c GROUP BY 1, 2),
l AS (SELECT variable, level, sum(n) AS l FROM c GROUP BY 1, 2),
t AS (SELECT variable, sum(n) AS t, count(DISTINCT stratum) AS k, count(DISTINCT level) AS lv FROM c GROUP BY 1),
e AS (SELECT r.variable, r.stratum, l.level, r * l / t AS expected, coalesce(n, 0) AS n, k, lv
      FROM r JOIN l ON r.variable = l.variable JOIN t ON r.variable = t.variable
      LEFT JOIN c ON c.variable = r.variable AND c.stratum = r.stratum AND c.level = l.level),
x AS (SELECT variable, max(k) AS k, max(lv) AS lv,
             sum(CASE WHEN k = 2 AND lv = 2
                      THEN pow(abs(n - expected) - least(0.5, abs(n - expected)), 2)
                      ELSE pow(n - expected, 2) END / expected) AS statistic FROM e GROUP BY 1)
SELECT p.variable, p.stratum, p.level, CAST(n AS BIGINT) AS n, round(pct, 6) AS pct,
       round(statistic, 6) AS statistic, (k - 1) * (lv - 1) AS df1
FROM (SELECT c.variable, c.stratum, c.level, n, 100 * n / r AS pct
      FROM c JOIN r ON c.variable = r.variable AND c.stratum = r.stratum
      UNION ALL SELECT l.variable, 'Overall', l.level, l, 100 * l / t
      FROM l JOIN t ON l.variable = t.variable) p
JOIN x ON p.variable = x.variable"""


@query("WITH" + A.BASE + "," + CHI)
def table_one_categorical(spark, folder):
    out = D.table_one_categorical(patient(spark, folder, *CATEGORICAL, "source"), CATEGORICAL, "source").drop("p")
    return rounded(out, "pct", "statistic")


@query()
def table_one_p_values(spark, folder):
    rows = patient(spark, folder, *CONTINUOUS, *CATEGORICAL, "source")
    a = D.table_one_continuous(rows, CONTINUOUS, "source").select("variable", "p").distinct()
    b = D.table_one_categorical(rows, CATEGORICAL, "source").select("variable", "p").distinct()
    return a.unionByName(b)


# Two levels: the difference of one share over its pooled deviation.
@query("WITH" + A.BASE + """,
p AS (SELECT source, avg(CASE WHEN gender = 'M' THEN 1.0 ELSE 0.0 END) AS g, avg(died) AS d
      FROM patient GROUP BY source),
w AS (SELECT max(g) FILTER (source = 'explicit') AS g1, max(g) FILTER (source = 'inferred') AS g2,
             max(d) FILTER (source = 'explicit') AS d1, max(d) FILTER (source = 'inferred') AS d2 FROM p)
SELECT 'gender' AS variable, round(abs(g1 - g2) / sqrt((g1 * (1 - g1) + g2 * (1 - g2)) / 2), 6) AS smd FROM w
UNION ALL
SELECT 'died', round(abs(d1 - d2) / sqrt((d1 * (1 - d1) + d2 * (1 - d2)) / 2), 6) FROM w""")
def categorical_smd(spark, folder):
    out = D.categorical_smd(patient(spark, folder, "gender", "died", "source"), ["gender", "died"], "source")
    return rounded(out, "smd")


# ── Text in and out ──────────────────────────────────────────────────────────────────────────

@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END AS o_orderstatus,
       CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS BIGINT) AS o_orderstatus_level,
       o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS ordered
FROM orders""")
def typed_csv(spark, folder):
    """All orders written as CSV to the shared folder and read back with declared types and levels."""
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
    rows = read_table(spark, folder, "orders", columns)
    path = f"{shared_folder(spark)}/orders-csv-{uuid.uuid4().hex}"
    write_csv(rows, path)
    back = read_typed_csv(spark, path, rows.schema, levels={"o_orderstatus": ["F", "O"]})
    return back.select("o_orderkey", "o_orderstatus", "o_orderstatus_level", "o_totalprice",
                       F.date_format("o_orderdate", "yyyy-MM-dd").alias("ordered"))
