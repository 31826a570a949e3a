"""Queries on diagnosis codes and code flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from sequela.functions.exprs import r6
from sequela.operators import codes as C
from sequela.operators.joins import membership
from sequela.plans.registry import query
from sequela.plans.timelines import HOURS, timed
from sequela.sources import adapters as A
from sequela.sources.tables import read_table


def coded(spark, folder):
    return C.crosswalk(A.diagnoses(spark, folder), A.code_table(spark, folder), "code",
                       "plain_code", "version")


@query("WITH" + A.DIAGNOSES + """
SELECT hadm_id, seq_num, code, version, coalesce(category, '') AS category,
       coalesce(label, '') AS label
FROM coded""")
def crosswalk(spark, folder):
    return coded(spark, folder).select(
        "hadm_id", "seq_num", "code", "version",
        F.coalesce("category", F.lit("")).alias("category"),
        F.coalesce("label", F.lit("")).alias("label"),
    )


# Letters of part types make version-10 codes, part numbers the three digits of version-9 ones.
@query("""
WITH c AS (
  SELECT CASE WHEN l_linenumber % 2 = 0 THEN lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0')
              WHEN l_linenumber = 1 THEN substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 1 + l_partkey % 26, 1)
                   || CAST(l_partkey % 10 AS VARCHAR) || '0'
              ELSE substr('EVK', 1 + l_partkey % 3, 1) || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0')
              END AS code,
         CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 1 THEN 10 ELSE 9 END AS version
  FROM lineitem),
n AS (SELECT *, TRY_CAST(substr(code, 1, 3) AS INTEGER) AS d,
             substr(code, 1, 1) AS a, substr(code, 1, 2) AS ab FROM c),
ch AS (SELECT CASE
  WHEN version = 10 THEN CASE
    WHEN a IN ('A', 'B') THEN 'Infectious' WHEN a = 'C' OR ab IN ('D0', 'D1') THEN 'Neoplasms'
    WHEN a = 'D' THEN 'Blood/Immune' WHEN a = 'E' THEN 'Endocrine' WHEN a = 'F' THEN 'Mental'
    WHEN a = 'G' THEN 'Neurologic' WHEN ab IN ('H0', 'H1') THEN 'Eye' WHEN a = 'H' THEN 'Ear'
    WHEN a = 'I' THEN 'Circulatory' WHEN a = 'J' THEN 'Respiratory' WHEN a = 'K' THEN 'Digestive'
    WHEN a = 'L' THEN 'Skin' WHEN a = 'M' THEN 'Musculoskeletal' WHEN a = 'N' THEN 'Genitourinary'
    WHEN a = 'O' THEN 'Pregnancy' WHEN a = 'P' THEN 'Perinatal' WHEN a = 'Q' THEN 'Congenital'
    WHEN a = 'R' THEN 'Symptoms' WHEN a IN ('S', 'T') THEN 'InjuryPoisoning'
    WHEN a IN ('V', 'W', 'X', 'Y') THEN 'ExternalCauses' WHEN a = 'Z' THEN 'SocialFactors'
    WHEN a = 'U' THEN 'SpecialCodes_e.g.COVID' END
  WHEN version = 9 THEN CASE
    WHEN d BETWEEN 1 AND 139 THEN 'Infectious' WHEN d BETWEEN 140 AND 239 THEN 'Neoplasms'
    WHEN d BETWEEN 240 AND 279 THEN 'Endocrine' WHEN d BETWEEN 280 AND 289 THEN 'Blood/Immune'
    WHEN d BETWEEN 290 AND 319 THEN 'Mental' WHEN d BETWEEN 320 AND 389 THEN 'Neurologic'
    WHEN d BETWEEN 390 AND 459 THEN 'Circulatory' WHEN d BETWEEN 460 AND 519 THEN 'Respiratory'
    WHEN d BETWEEN 520 AND 579 THEN 'Digestive' WHEN d BETWEEN 580 AND 629 THEN 'Genitourinary'
    WHEN d BETWEEN 630 AND 679 THEN 'Pregnancy' WHEN d BETWEEN 680 AND 709 THEN 'Skin'
    WHEN d BETWEEN 710 AND 739 THEN 'Musculoskeletal' WHEN d BETWEEN 740 AND 759 THEN 'Congenital'
    WHEN d BETWEEN 760 AND 779 THEN 'Perinatal' WHEN d BETWEEN 780 AND 799 THEN 'Symptoms'
    WHEN d >= 800 THEN 'InjuryPoisoning' WHEN a = 'E' THEN 'ExternalCauses'
    WHEN a = 'V' THEN 'FactorsInfluencingHealth' ELSE 'OtherUnmapped' END END AS chapter
  FROM n)
SELECT coalesce(chapter, '') AS chapter, count(*) AS n FROM ch GROUP BY 1""")
def code_chapters(spark, folder):
    rows = read_table(spark, folder, "lineitem", ["l_linenumber", "l_partkey"])
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    three = F.lpad((part % 1000).cast("string"), 3, "0")
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    code = (
        F.when(n % 2 == 0, three)
        .when(n == 1, F.concat(F.substring(letters, part.cast("int") % 26 + 1, F.lit(1)),
                               (part % 10).cast("string"), F.lit("0")))
        .otherwise(F.concat(F.substring(F.lit("EVK"), part.cast("int") % 3 + 1, F.lit(1)), three))
    )
    rows = rows.select(code.alias("code"),
                       F.when(n == 7, None).when(n == 1, 10).otherwise(9).alias("version"))
    chapter = F.coalesce(C.code_chapter("code", "version"), F.lit(""))
    return rows.groupBy(chapter.alias("chapter")).agg(F.count(F.lit(1)).alias("n"))


# Procedures: two-character codes from part numbers, dated by shipment.
PROCEDURES = """
surgery AS (
  SELECT l_orderkey AS hadm_id, min(l_shipdate) AS surgery_time FROM lineitem
  WHERE lpad(CAST(l_partkey % 100 AS VARCHAR), 2, '0') BETWEEN '01' AND '07'
     OR lpad(CAST(l_partkey % 100 AS VARCHAR), 2, '0') BETWEEN '36' AND '39'
     OR lpad(CAST(l_partkey % 100 AS VARCHAR), 2, '0') BETWEEN '42' AND '54'
     OR lpad(CAST(l_partkey % 100 AS VARCHAR), 2, '0') BETWEEN '76' AND '84'
  GROUP BY l_orderkey)"""


def surgery(spark, folder):
    rows = read_table(spark, folder, "lineitem", ["l_orderkey", "l_partkey", "l_shipdate"])
    rows = rows.select(
        F.col("l_orderkey").alias("hadm_id"),
        F.lpad((F.col("l_partkey") % 100).cast("string"), 2, "0").alias("code"),
        F.col("l_shipdate").cast("timestamp").alias("date"),
    )
    return C.first_date_in_ranges(rows, "hadm_id", "code", "date")


@query("WITH" + PROCEDURES + """
SELECT hadm_id, epoch_us(surgery_time) AS surgery_us FROM surgery""")
def first_surgery(spark, folder):
    return surgery(spark, folder).select("hadm_id", F.unix_micros("surgery_time").alias("surgery_us"))


RESPIRATORY = """
respiratory AS (
  SELECT l_orderkey AS hadm_id, count(*) AS respiratory_count FROM lineitem
  WHERE l_partkey % 1000 BETWEEN 460 AND 519 GROUP BY l_orderkey)"""


def respiratory(spark, folder):
    rows = read_table(spark, folder, "lineitem", ["l_orderkey", "l_partkey"]).select(
        F.col("l_orderkey").alias("hadm_id"),
        F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0").alias("code"),
        F.lit(9).alias("version"),
    )
    return C.count_where(rows, "hadm_id", C.is_respiratory("code", "version"), "respiratory_count")


@query("WITH" + RESPIRATORY + " SELECT hadm_id, respiratory_count FROM respiratory")
def respiratory_counts(spark, folder):
    return respiratory(spark, folder)


# Orders as episodes: surgery within 12 hours of (order time + hours), else by codes.
@query("WITH" + PROCEDURES + "," + RESPIRATORY + """
SELECT o_orderkey AS hadm_id,
  CASE WHEN surgery_time IS NOT NULL
        AND trunc((epoch_us(o_orderdate) - epoch_us(surgery_time)) / 3.6e9)
            + coalesce(o_totalprice / 100, 0) BETWEEN -12 AND 12 THEN 'surgical'
       WHEN coalesce(respiratory_count, 0) > 0 THEN 'medical-respiratory'
       ELSE 'medical-non-respiratory' END AS category
FROM orders o LEFT JOIN surgery s ON o_orderkey = s.hadm_id
LEFT JOIN respiratory r ON o_orderkey = r.hadm_id""")
def classify_by_codes(spark, folder):
    orders = read_table(spark, folder, "orders", ["o_orderkey", "o_orderdate", "o_totalprice"])
    events = orders.select(
        F.col("o_orderkey").alias("hadm_id"),
        F.col("o_orderdate").cast("timestamp").alias("event_time"),
        (F.col("o_totalprice") / 100).alias("episode_hours"),
    )
    return C.classify_by_codes(events, surgery(spark, folder), respiratory(spark, folder),
                               "hadm_id").select("hadm_id", "category")


@query("WITH" + A.DIAGNOSES + """
SELECT hadm_id, coalesce(max(code || ': ' || title), '') AS long_label,
       coalesce(max(CASE WHEN version = 10 AND category IS NOT NULL
                         THEN category || ': ' || label END), '') AS category_label
FROM coded WHERE seq_num = 1 GROUP BY hadm_id""")
def primary_labels(spark, folder):
    rows = coded(spark, folder).where(F.col("seq_num") == 1)
    out = C.first_by_key(
        rows, "hadm_id", long_label=C.titled("code", "title"),
        category_label=F.when((F.col("version") == 10) & F.col("category").isNotNull(),
                              C.titled("category", "label")),
    )
    return out.fillna("", subset=["long_label", "category_label"])


@query("WITH" + A.DIAGNOSES + """
SELECT hadm_id,
  coalesce(array_to_string(list_sort(list(DISTINCT category) FILTER (category IS NOT NULL)), ','), '') AS codes,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '') AS labels
FROM coded WHERE seq_num <= 5 GROUP BY hadm_id""")
def code_arrays(spark, folder):
    out = C.code_arrays(coded(spark, folder), "hadm_id", {"codes": "category", "labels": "label"},
                        "seq_num", 5)
    return out.select("hadm_id", *[F.array_join(c, ",").alias(c) for c in ("codes", "labels")])


@query("WITH" + A.DIAGNOSES + """,
best AS (
  SELECT hadm_id, code || ': ' || title AS lab FROM coded
  QUALIFY row_number() OVER (PARTITION BY hadm_id ORDER BY seq_num, code) = 1),
""" + HOURS.strip() + """
SELECT event_id, coalesce(lab, '') AS nearest_label
FROM timed LEFT JOIN best ON stay_id = hadm_id""")
def nearest_code(spark, folder):
    codes = coded(spark, folder).withColumn("lab", C.titled("code", "title")).withColumnRenamed(
        "hadm_id", "stay_id"
    )
    out = C.nearest_code(timed(spark, folder), codes, "stay_id", "seq_num", "code", "lab")
    return out.select("event_id", F.coalesce("nearest_label", F.lit("")).alias("nearest_label"))


@query("WITH" + A.DIAGNOSES + """
SELECT DISTINCT hadm_id, category AS code FROM coded WHERE category IS NOT NULL""")
def explode_codes(spark, folder):
    arrays = C.code_arrays(coded(spark, folder), "hadm_id", {"codes": "category"})
    return C.explode_codes(arrays, "codes")


@query("WITH" + A.LONG_CODES + """
SELECT code, count(*) AS n_subjects,
       round(count(*) / (SELECT count(DISTINCT subject_id) FROM long_codes), 6) AS prevalence
FROM long_codes GROUP BY code""")
def code_prevalence(spark, folder):
    out = C.code_prevalence(A.long_codes(spark, folder))
    return out.withColumn("prevalence", r6("prevalence"))


@query("WITH" + A.LONG_CODES + """,
kept AS (SELECT o_orderkey AS subject_id FROM orders WHERE o_orderstatus = 'F')
SELECT code, count(*) AS n_subjects,
       round(count(*) / (SELECT count(*) FROM kept), 6) AS prevalence
FROM long_codes WHERE subject_id IN (SELECT subject_id FROM kept)
GROUP BY code HAVING count(*) / (SELECT count(*) FROM kept) >= 0.10 AND code <> 'Brand#1'""")
def code_selection(spark, folder):
    orders = read_table(spark, folder, "orders", ["o_orderkey"], F.col("o_orderstatus") == "F")
    cohort = orders.withColumnRenamed("o_orderkey", "subject_id")
    table = C.code_prevalence(A.long_codes(spark, folder), cohort=cohort, denominator="cohort")
    codes = C.select_codes(table, 0.10, ["Brand#1"])
    return table.where(F.col("code").isin(codes)).withColumn("prevalence", r6("prevalence"))


BRANDS = [f"Brand#{i}" for i in range(1, 26)]
"""All categories of the test tables, which SQL has to list; the queries select theirs from the data."""

FLAGS = A.LONG_CODES + """,
flagged AS (
  SELECT o_orderkey AS subject_id, o_orderpriority AS unit,""" + ",".join(f"""
         CAST(count(*) FILTER (code = '{b}') > 0 AS INTEGER) AS "code_{b}\"""" for b in BRANDS) + """
  FROM orders LEFT JOIN long_codes ON o_orderkey = subject_id
  GROUP BY o_orderkey, o_orderpriority)"""


def flagged(spark, folder):
    orders = read_table(spark, folder, "orders", ["o_orderkey", "o_orderpriority"])
    rows = orders.toDF("subject_id", "unit")
    long = A.long_codes(spark, folder)
    return C.code_flags(rows, long, all_codes(long))


def all_codes(long):
    return C.select_codes(C.code_prevalence(long), 0.0)


def flag_columns(rows):
    return [c for c in rows.columns if c.startswith("code_")]


FLAG_COLUMNS = [f"code_{b}" for b in BRANDS]


@query("WITH" + FLAGS + " SELECT * FROM flagged")
def code_flags(spark, folder):
    return flagged(spark, folder)


@query("WITH" + FLAGS + " SELECT * FROM flagged")
def code_flags_from_arrays(spark, folder):
    orders = read_table(spark, folder, "orders", ["o_orderkey", "o_orderpriority"])
    long = A.long_codes(spark, folder)
    arrays = C.code_arrays(long, "subject_id", {"codes": "code"})
    rows = orders.toDF("subject_id", "unit").join(arrays, "subject_id", "left")
    return C.array_flags(rows, "codes", all_codes(long)).drop("codes")


@query("WITH" + FLAGS + """
SELECT subject_id, code, present FROM flagged
UNPIVOT (present FOR code IN (""" + ", ".join(f'"{c}"' for c in FLAG_COLUMNS) + "))")
def flags_long(spark, folder):
    rows = flagged(spark, folder)
    return C.flags_long(rows, ["subject_id"], flag_columns(rows))


@query("WITH" + FLAGS + """,
long AS (SELECT * FROM flagged UNPIVOT (present FOR code IN (""" + ", ".join(
    f'"{c}"' for c in FLAG_COLUMNS) + """)))
SELECT unit, code, CAST(sum(present) AS BIGINT) AS n_subjects,
       round(sum(present) / count(*), 3) AS prevalence
FROM long GROUP BY unit, code HAVING round(sum(present) / count(*), 3) >= 0.10""")
def prevalence_by_stratum(spark, folder):
    rows = flagged(spark, folder)
    return C.prevalence_by_stratum(rows, "unit", flag_columns(rows), 0.10)


@query("WITH" + FLAGS + """,
long AS (SELECT * FROM flagged UNPIVOT (present FOR code IN (""" + ", ".join(
    f'"{c}"' for c in FLAG_COLUMNS) + """))),
p AS (SELECT unit, code, avg(present) AS a FROM long GROUP BY unit, code)
SELECT code, round(max(a) - min(a), 6) AS prev_range, round(min(a), 6) AS prev_min,
       round(max(a), 6) AS prev_max
FROM p GROUP BY code ORDER BY round(max(a) - min(a), 9) DESC, code LIMIT 3""")
def prevalence_range(spark, folder):
    rows = flagged(spark, folder)
    out = C.prevalence_range(rows, "unit", flag_columns(rows), 3)
    return out.withColumns({c: r6(c) for c in ("prev_range", "prev_min", "prev_max")})


@query("WITH" + A.DIAGNOSES + """
SELECT hadm_id, list_sort(list(DISTINCT category))[1] AS first_code,
       count(DISTINCT category) AS n_codes
FROM coded WHERE category IS NOT NULL GROUP BY hadm_id""")
def parse_code_text(spark, folder):
    """Arrays written as text in either form, then parsed back."""
    arrays = C.code_arrays(coded(spark, folder), "hadm_id", {"codes": "category"})
    quoted = F.concat(F.lit("['"), F.array_join("codes", "', '"), F.lit("']"))
    text = F.when(F.size("codes") == 0, "[]").when(F.col("hadm_id") % 2 == 0, quoted).otherwise(
        F.array_join("codes", ", ")
    )
    back = arrays.select("hadm_id", C.parse_code_text(text).alias("codes"))
    return back.where(F.size("codes") > 0).select(
        "hadm_id", F.col("codes")[0].alias("first_code"),
        F.size("codes").cast("long").alias("n_codes"),
    )


@query("""
SELECT o_orderkey FROM orders WHERE o_orderkey IN (
  SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""")
def membership_filter(spark, folder):
    orders = read_table(spark, folder, "orders", ["o_orderkey"])
    large = read_table(spark, folder, "lineitem", ["l_orderkey"], F.col("l_quantity") > 45)
    return membership(orders, large.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"])
