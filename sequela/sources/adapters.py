"""The study's input shapes, taken from the test tables, and the same in SQL.

Each function gives one input of the operators; the string of the same name (upper case) is the
common table expression that gives it in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequela.operators.cohort import CohortSpec
from sequela.operators.joins import lookup
from sequela.operators.providers import rate_tables, with_fallback_rate
from sequela.operators.timeline import label_events
from sequela.session import staged
from sequela.sources.tables import read_table


def _events(spark: SparkSession, folder: str, kinds: list[str]) -> DataFrame:
    rows = read_table(spark, folder, "events", where=F.col("event_type").isin(kinds))
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _provider():
    return F.regexp_extract("props", "([0-9]+)", 1).cast("long") % 12


def timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Starts and ends per subject; every fourth event counts as inferred."""
    rows = label_events(
        _events(spark, folder, ["signup", "error"]).withColumnRenamed("event_type", "code"),
        "code", {"signup": "start", "error": "end"},
    )
    inferred = F.col("event_id") % 4 == 0
    return rows.select(
        "event_id", F.col("user_id").alias("subject_id"), F.col("user_id").alias("stay_id"),
        F.col("ts").alias("event_time"), "event_type",
        F.when(inferred, "inferred").otherwise("explicit").alias("source"),
        F.when(~inferred & (F.col("event_id") % 5 != 0), _provider()).alias("provider_id"),
        (F.col("user_id") % 5).alias("unit"),
    )


TIMELINE = """
timeline AS (
  SELECT event_id, user_id AS subject_id, user_id AS stay_id, ts AS event_time,
         CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'end' END AS event_type,
         CASE WHEN event_id % 4 = 0 THEN 'inferred' ELSE 'explicit' END AS source,
         CASE WHEN event_id % 4 <> 0 AND event_id % 5 <> 0
              THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 12 END AS provider_id,
         user_id % 5 AS unit
  FROM events WHERE event_type IN ('signup', 'error'))"""

SEQUENCED = TIMELINE + """,
sequenced AS (
  SELECT *, lag(event_type) OVER w AS prev_event_type, lag(event_time) OVER w AS prev_event_time,
         lag(source) OVER w AS prev_source, lead(event_type) OVER w AS next_event_type,
         lead(event_time) OVER w AS next_event_time, lead(source) OVER w AS next_source
  FROM timeline WINDOW w AS (PARTITION BY subject_id ORDER BY event_time, event_id))"""

ENDS = SEQUENCED + """,
ends AS (
  SELECT *, CASE WHEN next_event_type = 'start' AND source = 'explicit'
                  AND next_source = 'explicit'
                  AND epoch_us(next_event_time) - epoch_us(event_time) < 73 * 3600000000
                 THEN 1 ELSE 0 END AS failed
  FROM sequenced WHERE event_type = 'end')"""


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """Intervals that start at a view and last its value in minutes."""
    rows = _events(spark, folder, ["view"])
    length = F.round(F.col("value") * 60).cast("long") * 1_000_000
    return rows.select(
        F.col("user_id").alias("subject_id"), F.col("user_id").alias("stay_id"), "event_id",
        F.col("ts").alias("start_time"),
        F.timestamp_micros(F.unix_micros("ts") + length).alias("end_time"),
    )


SEGMENTS = """
segments AS (
  SELECT user_id AS subject_id, user_id AS stay_id, event_id, ts AS start_time,
         make_timestamp(epoch_us(ts) + CAST(round(value * 60) AS BIGINT) * 1000000) AS end_time
  FROM events WHERE event_type = 'view')"""


def candidates(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("click", "view")) -> DataFrame:
    """Records that name a provider."""
    return _events(spark, folder, list(kinds)).select(
        F.col("user_id").alias("stay_id"), F.col("ts").alias("time"), _provider().alias("provider"),
        F.col("event_type").alias("kind"),
    )


CANDIDATES = """
candidates AS (
  SELECT user_id AS stay_id, ts AS time, event_type AS kind,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 12 AS provider
  FROM events WHERE event_type IN ('click', 'view'))"""


def measures(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return _events(spark, folder, [kind]).select(
        F.col("user_id").alias("stay_id"), F.col("ts").alias("time"), "value"
    )


MEASURES = """
measures AS (
  SELECT user_id AS stay_id, ts AS time, value, event_type AS kind
  FROM events WHERE event_type IN ('click', 'view'))"""


def diagnoses(spark: SparkSession, folder: str) -> DataFrame:
    """Codes per stay, written with a dot; a third of them of version 9."""
    rows = read_table(spark, folder, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey"])
    part = F.col("l_partkey")
    return rows.select(
        F.col("l_orderkey").alias("subject_id"), F.col("l_orderkey").alias("hadm_id"),
        F.col("l_linenumber").alias("seq_num"),
        F.concat(F.floor(part / 10).cast("string"), F.lit("."), (part % 10).cast("string")).alias(
            "code"),
        F.when(part % 3 == 0, 9).otherwise(10).alias("version"),
        part.alias("part_id"),
    )


def code_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "part", ["p_partkey", "p_brand", "p_type", "p_name"])
    number = F.col("p_partkey")
    plain = F.concat(F.floor(number / 10).cast("string"), (number % 10).cast("string"))
    return rows.select(plain.alias("plain_code"), F.col("p_brand").alias("category"),
                       F.col("p_type").alias("label"), F.col("p_name").alias("title"))


DIAGNOSES = """
diagnoses AS (
  SELECT l_orderkey AS subject_id, l_orderkey AS hadm_id, l_linenumber AS seq_num,
         CAST(l_partkey // 10 AS VARCHAR) || '.' || CAST(l_partkey % 10 AS VARCHAR) AS code,
         CASE WHEN l_partkey % 3 = 0 THEN 9 ELSE 10 END AS version, l_partkey AS part_id
  FROM lineitem),
code_table AS (
  SELECT CAST(p_partkey // 10 AS VARCHAR) || CAST(p_partkey % 10 AS VARCHAR) AS plain_code,
         p_brand AS category, p_type AS label, p_name AS title
  FROM part),
coded AS (
  SELECT d.*, category, label, title
  FROM diagnoses d LEFT JOIN code_table t
    ON version = 10 AND replace(code, '.', '') = plain_code)"""


def long_codes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per subject and category of the crosswalk, from version-10 codes."""
    from sequela.operators.codes import crosswalk

    rows = crosswalk(diagnoses(spark, folder), code_table(spark, folder), "code", "plain_code",
                     "version", how="inner")
    return rows.select("subject_id", F.col("category").alias("code")).distinct()


LONG_CODES = DIAGNOSES + """,
long_codes AS (
  SELECT DISTINCT subject_id, category AS code FROM coded WHERE category IS NOT NULL)"""


# Fixed values of the test study.
SPEC = CohortSpec(
    required=("hours", "severity", "diagnosis"),
    units=("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"),
    unit_groups={"Acute": ("1-URGENT", "2-HIGH"), "Routine": ("3-MEDIUM",)},
    min_provider_n=440,
    min_unit_n=85,
)


def cohort(spark: SparkSession, folder: str) -> DataFrame:
    """One wide row per order line: subject, provider, unit, covariates, outcomes."""
    lines = read_table(spark, folder, "lineitem")
    orders = read_table(
        spark, folder, "orders", ["o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate"]
    ).withColumnRenamed("o_orderkey", "l_orderkey")
    rows = lookup(lines, orders, ["l_orderkey"], "inner")
    part, flag = F.col("l_partkey"), F.col("l_returnflag")
    return rows.select(
        F.col("l_orderkey").alias("subject_id"), F.col("l_suppkey").alias("provider_id"),
        F.col("o_orderpriority").alias("unit"), part.alias("part_id"),
        F.when(F.col("l_linenumber") % 4 == 0, "inferred").otherwise("explicit").alias("source"),
        F.when(F.col("o_orderstatus") == "F", "surgical")
        .when(F.col("o_orderstatus") == "O", "medical-respiratory")
        .otherwise("medical-non-respiratory").alias("category"),
        F.when(part % 2 == 0, "M").otherwise("F").alias("gender"),
        F.when(part % 7 > 0, F.concat(F.lit("D"), (part % 7).cast("string"))).alias("diagnosis"),
        F.col("l_quantity").alias("age"), F.round(F.col("l_discount") * 100).alias("severity"),
        F.col("l_tax").alias("dose"), (F.col("l_extendedprice") / 100).alias("hours"),
        (F.col("l_linenumber") - 1).alias("n_failures"),
        (F.col("l_linestatus") == "F").cast("int").alias("failed"),
        (flag == "R").cast("int").alias("died"), (flag == "A").cast("int").alias("expired"),
        F.col("o_orderdate").cast("timestamp").alias("event_time"),
        F.when(flag == "R", F.col("l_shipdate").cast("date")).alias("death_date"),
    )


def rated(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """The cohort with provider volumes and the fallback rate.

    With ``columns`` the cohort is written once with these and what the rates need, for queries
    that read it several times: its join is then made once.
    """
    rows = cohort(spark, folder)
    if columns is not None:
        keep = [c for c in dict.fromkeys(["provider_id", "unit", "source", "failed", *columns]) if c in rows.columns]
        rows = staged(rows.select(*keep), "cohort")
    return with_fallback_rate(rows, rate_tables(rows))


COHORT = """
cohort AS (
  SELECT l_orderkey AS subject_id, l_suppkey AS provider_id, o_orderpriority AS unit,
         l_partkey AS part_id,
         CASE WHEN l_linenumber % 4 = 0 THEN 'inferred' ELSE 'explicit' END AS source,
         CASE o_orderstatus WHEN 'F' THEN 'surgical' WHEN 'O' THEN 'medical-respiratory'
              ELSE 'medical-non-respiratory' END AS category,
         CASE WHEN l_partkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
         CASE WHEN l_partkey % 7 > 0 THEN 'D' || CAST(l_partkey % 7 AS VARCHAR) END AS diagnosis,
         l_quantity AS age, round(l_discount * 100) AS severity, l_tax AS dose,
         l_extendedprice / 100 AS hours, l_linenumber - 1 AS n_failures,
         CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS failed,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS died,
         CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS expired,
         o_orderdate AS event_time,
         CASE WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS DATE) END AS death_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

RATED = COHORT + """,
by_provider AS (
  SELECT provider_id, count(*) AS provider_n, avg(failed) AS provider_rate,
         count(*) >= 30 AS is_high_volume
  FROM cohort WHERE source = 'explicit' AND provider_id IS NOT NULL GROUP BY provider_id),
by_unit AS (
  SELECT provider_id, unit, count(*) AS provider_unit_n, avg(failed) AS provider_unit_rate
  FROM cohort WHERE source = 'explicit' AND provider_id IS NOT NULL GROUP BY provider_id, unit),
rated AS (
  SELECT c.*, provider_unit_n, provider_unit_rate, provider_n, provider_rate, is_high_volume,
         coalesce(provider_unit_rate, provider_rate,
                  (SELECT avg(failed) FROM cohort WHERE source = 'explicit')) AS rate
  FROM cohort c LEFT JOIN by_unit u ON c.provider_id = u.provider_id AND c.unit = u.unit
  LEFT JOIN by_provider p ON c.provider_id = p.provider_id)"""

BASE = RATED + """,
patient AS (
  SELECT * FROM rated
  WHERE hours IS NOT NULL AND severity IS NOT NULL AND diagnosis IS NOT NULL),
explicit_cohort AS (
  SELECT * FROM patient
  WHERE source = 'explicit' AND provider_unit_n IS NOT NULL AND provider_n >= 440
    AND unit IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')),
base AS (
  SELECT *, CASE WHEN unit IN ('1-URGENT', '2-HIGH') THEN 'Acute'
                 WHEN unit = '3-MEDIUM' THEN 'Routine' ELSE 'Other' END AS unit_group
  FROM explicit_cohort WHERE provider_unit_n >= 85)"""
