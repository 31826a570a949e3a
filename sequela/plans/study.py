"""The study tables: event facts, one row per subject, one row per event, one row per code."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequela.functions.exprs import r6
from sequela.operators import codes as C
from sequela.operators import providers as P
from sequela.operators import timejoin as J
from sequela.operators import timeline as T
from sequela.operators.cohort import plausible
from sequela.operators.joins import lookup, star
from sequela.operators.ordered import heavy_keys
from sequela.plans.codesets import PROCEDURES, RESPIRATORY, coded, respiratory, surgery
from sequela.plans.registry import query
from sequela.sources import adapters as A
from sequela.sources.tables import read_table, stage


@dataclass(frozen=True)
class StudyInputs:
    """Input tables; every one may be large. Keys: subject_id, hadm_id, stay_id."""

    events: DataFrame
    """Explicit events: event_id, keys, provider_id, event_time, event_type."""
    segments: DataFrame
    """stay_id, event_id, start_time, end_time."""
    stays: DataFrame
    """One row per stay: keys, unit."""
    tiers: list[tuple[str, DataFrame, int]]
    """Fallback sources of a provider: label, records (stay_id, time, provider), minutes."""
    charts: DataFrame
    """Records for the most-frequent fallback: stay_id, time, provider."""
    surgery: DataFrame
    respiratory: DataFrame
    diagnoses: DataFrame
    """hadm_id, seq_num, code, version, title, category, label."""
    patients: DataFrame
    """One row per subject: age, gender, death_date."""
    admissions: DataFrame
    """subject_id, expired."""
    scores: dict[str, DataFrame] = field(default_factory=dict)
    """Per name: subject_id and a column of that name."""
    doses: DataFrame | None = None
    """stay_id, dose."""


@dataclass(frozen=True)
class EventFacts:
    sequence: DataFrame
    ends: DataFrame
    heavy_subjects: DataFrame | None


def event_facts(
    inputs: StudyInputs,
    min_hours: float = 4,
    near_minutes: int = 30,
    failure_hours: int = 72,
    mode_hours: int = 2,
) -> EventFacts:
    """All events in order, and the ends with flag, hours and provider.

    Both are read by many later steps, so each is written once.
    """
    inferred = T.segments_to_events(
        inputs.segments, ["stay_id", "event_id"], min_hours=min_hours
    )
    inferred = lookup(inferred, inputs.stays.select("stay_id", "subject_id", "hadm_id"),
                      ["stay_id"], "inner")
    explicit = inputs.events.withColumn("source", F.lit(T.EXPLICIT))
    events = T.combine_sources(explicit, inferred)
    heavy = heavy_keys(events.select("subject_id"), ["subject_id"])
    kept = T.suppress_near_duplicates(events, minutes=near_minutes, heavy=heavy)
    sequence = stage(T.with_neighbors(kept, heavy=heavy))

    rows = sequence.where(F.col("event_type") == T.END)
    probes = rows.where(F.col("source") == T.EXPLICIT).select("stay_id", "event_time")
    key = ["stay_id", "event_time"]
    rows = rows.withColumns({
        "failed": T.failure_flag(hours=failure_hours), "recorded_start": T.recorded_start(),
    })
    rows = T.episode_hours(rows, inputs.segments, ["stay_id"])
    # The tiers draw on subsets of the same records.
    busy = J.busy_keys(probes, inputs.charts, ["stay_id"])
    tiers = []
    for label, records, minutes in inputs.tiers:
        near = J.nearest_within(probes, records, ["stay_id"], "event_time", "time", "provider",
                                minutes, out=label, heavy=busy)
        rows = rows.join(near.select(*key, label), key, "left")
        tiers.append(J.Tier(label, label))
    label = f"most_frequent_{mode_hours}h"
    most = J.most_frequent_nearby(probes, inputs.charts, ["stay_id"], "event_time", "time",
                                  "provider", mode_hours, out=label, heavy=busy)
    rows = rows.join(most, key, "left")
    tiers.append(J.Tier(label, label))
    rows = J.resolve_cascade(rows, "provider_id", tiers).drop(*[t.column for t in tiers])
    return EventFacts(sequence, stage(rows), heavy)


def _only(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the study's own keys; cuts a hospital-wide table before it is grouped."""
    return table.join(keys, keys.columns, "left_semi")


def _diagnosis_table(diagnoses: DataFrame) -> DataFrame:
    """Everything taken from a stay's diagnoses, in one grouped pass."""
    seq = F.col("seq_num")
    listed = (F.col("version") == 10) & (seq <= 10)
    # Computed before the grouping, where whole-stage code generation reaches it.
    d = diagnoses.withColumn("_title", C.titled("code", "title")).select(
        "hadm_id", "seq_num", "code", "_title",
        F.when(seq == 1, C.code_chapter("code", "version")).alias("_chapter"),
        F.when(seq == 1, F.col("_title")).alias("_first"),
        F.when(seq == 2, F.col("_title")).alias("_second"),
        F.when(listed, F.col("category")).alias("_category"),
        F.when(listed, F.col("label")).alias("_label"),
    )

    def array(value):
        values = F.array_sort(F.collect_set(value))
        return F.when(F.size(values) > 0, values)

    return d.groupBy("hadm_id").agg(
        F.max("_chapter").alias("primary_diagnosis"),
        F.max("_first").alias("primary_long_diagnosis"),
        array("_second").alias("secondary_diagnosis"),
        array("_category").alias("codes"), array("_label").alias("code_labels"),
        F.min_by("_title", F.struct("seq_num", "code")).alias("nearest_diagnosis"),
    )


def _subject_tables(inputs: StudyInputs, ends: DataFrame) -> list[DataFrame]:
    subjects = ends.select("subject_id").distinct()
    tables = [inputs.patients.select("subject_id", "age", "gender", "death_date"),
              P.subject_max(_only(inputs.admissions, subjects), "subject_id", expired="expired")]
    tables += [P.subject_max(_only(t, subjects), "subject_id", **{n: n})
               for n, t in inputs.scores.items()]
    if inputs.doses is not None:
        # The largest dose per stay first; a stay belongs to one subject.
        stays = ends.select("stay_id", "subject_id").distinct()
        per_stay = P.subject_max(_only(inputs.doses, stays.select("stay_id").distinct()),
                                 "stay_id", dose="dose")
        tables.append(P.subject_max(stays.join(per_stay, "stay_id"), "subject_id", dose="dose"))
    return tables


def last_event_table(inputs: StudyInputs, facts: EventFacts, **limits) -> DataFrame:
    """One wide row per subject: its last end with everything known about it."""
    sequence, ends = facts.sequence, facts.ends
    with_unit = lookup(ends, inputs.stays.select("stay_id", "unit"), ["stay_id"])
    rates = P.rate_tables(with_unit)
    last = T.last_per_subject(with_unit)
    stays = ends.select("hadm_id").distinct()
    # One row per subject is left, so no stay repeats enough to be heavy.
    last = C.classify_by_codes(last, _only(inputs.surgery, stays),
                               _only(inputs.respiratory, stays), "hadm_id", heavy=None)
    last = P.with_fallback_rate(last, rates)

    starts = sequence.where((F.col("event_type") == T.START) & (F.col("source") == T.EXPLICIT))
    explicit = sequence.where((F.col("event_type") == T.END) & (F.col("source") == T.EXPLICIT))
    pairs = T.followup_pairs(explicit, starts, heavy=facts.heavy_subjects)
    counts = T.failure_counts(pairs)
    subject_tables = [counts, T.total_hours(ends), *_subject_tables(inputs, ends)]
    wide = star(last, *[(t, ["subject_id"]) for t in subject_tables],
                (_diagnosis_table(_only(inputs.diagnoses, stays)), ["hadm_id"]))
    wide = wide.withColumns({
        "n_failures_lifetime": F.coalesce("n_failures_lifetime", F.lit(0)),
        **({"dose": F.coalesce("dose", F.lit(0.0))} if inputs.doses is not None else {}),
    })
    return plausible(wide, **limits).select(
        "subject_id", "hadm_id", "stay_id", "unit", "age", "gender", "primary_diagnosis",
        "primary_long_diagnosis", "codes", "code_labels", "secondary_diagnosis",
        "nearest_diagnosis", *inputs.scores, "dose", "total_hours",
        F.col("episode_hours").alias("last_hours"), "event_time", "category", "recorded_start",
        "source", "provider_source", "provider_id", "rate", "provider_n", "provider_unit_n",
        "n_failures_lifetime", "expired", "death_date",
    )


def all_event_table(
    inputs: StudyInputs,
    failure_hours: int = 72,
    min_provider_n: int = 10,
    min_hours: float = 1,
    max_hours: float = 1000,
) -> DataFrame:
    """One row per explicit end, with the provider's rate over its other ends."""
    rows = T.with_neighbors(inputs.events.withColumn("source", F.lit(T.EXPLICIT)))
    rows = rows.where(F.col("event_type") == T.END).withColumn(
        "failed", T.failure_flag(hours=failure_hours)
    )
    rows = T.episode_hours(rows, inputs.segments, ["stay_id"])
    rows = stage(rows.where(
        (F.col("episode_hours") > min_hours) & (F.col("episode_hours") < max_hours)
        & F.col("provider_id").isNotNull()
    ))
    out = P.leave_one_out(rows).where(F.col("provider_n") > min_provider_n)
    out = lookup(out, inputs.stays.select("stay_id", "unit"), ["stay_id"])
    # A subject may have any number of events, so its attributes are looked up, not starred.
    for table in _subject_tables(inputs, rows):
        out = lookup(out, table, ["subject_id"])
    return out.select(
        "event_id", "subject_id", "hadm_id", "stay_id", "unit", "age", "gender", *inputs.scores,
        F.coalesce("dose", F.lit(0.0)).alias("dose"), "episode_hours", "event_time", "source",
        "provider_id", "rate_loo", "provider_n", "failed", "expired", "death_date",
    )


def long_code_table(subjects: DataFrame, min_provider_n: int = 10) -> DataFrame:
    """One row per subject and code."""
    rows = subjects.where((F.col("provider_n") > min_provider_n) & F.col("codes").isNotNull())
    return C.explode_codes(rows, "codes").select(
        "subject_id", "hadm_id", "provider_id", "rate", "provider_n", "n_failures_lifetime",
        "source", "provider_source", "code",
    )


# ── On the test tables ───────────────────────────────────────────────────────────────────────

def inputs(spark, folder) -> StudyInputs:
    timeline = A.timeline(spark, folder).withColumn("hadm_id", F.col("stay_id"))
    explicit = timeline.where(F.col("source") == T.EXPLICIT)
    stays = read_table(spark, folder, "events", ["user_id"]).distinct().select(
        F.col("user_id").alias("subject_id"), F.col("user_id").alias("hadm_id"),
        F.col("user_id").alias("stay_id"), (F.col("user_id") % 5).alias("unit"),
    )
    customers = read_table(spark, folder, "customer", ["c_custkey", "c_acctbal", "c_mktsegment"])
    orders = read_table(spark, folder, "orders",
                        ["o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice"])
    orders = orders.withColumnRenamed("o_custkey", "subject_id")
    deaths = orders.where(F.col("o_orderstatus") == "F").groupBy("subject_id").agg(
        F.max(F.col("o_orderdate").cast("date")).alias("death_date"))
    patients = customers.select(
        F.col("c_custkey").alias("subject_id"), F.col("c_acctbal").alias("age"),
        F.col("c_mktsegment").alias("gender"),
    ).join(deaths, "subject_id", "left")
    doses = read_table(spark, folder, "lineitem", ["l_orderkey", "l_tax"])
    return StudyInputs(
        events=explicit.drop("source", "unit"),
        segments=A.segments(spark, folder), stays=stays,
        tiers=[("click_720m", A.candidates(spark, folder, ("click",)), 720),
               ("view_360m", A.candidates(spark, folder, ("view",)), 360),
               ("any_180m", A.candidates(spark, folder), 180)],
        charts=A.candidates(spark, folder), surgery=surgery(spark, folder),
        respiratory=respiratory(spark, folder), diagnoses=coded(spark, folder),
        patients=patients,
        admissions=orders.select("subject_id",
                                 (F.col("o_orderstatus") == "P").cast("int").alias("expired")),
        scores={"severity": orders.select("subject_id", F.col("o_totalprice").alias("severity"))},
        doses=doses.select(F.col("l_orderkey").alias("stay_id"), F.col("l_tax").alias("dose")),
    )


LIMITS = {"min_hours": 1, "max_hours": 5000, "max_dose": 1, "max_count": 1000}

SUBJECT_SQL = """
deaths AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS death_date FROM orders
           WHERE o_orderstatus = 'F' GROUP BY 1),
admission AS (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS expired,
                     max(o_totalprice) AS severity FROM orders GROUP BY 1),
doses AS (SELECT l_orderkey, max(l_tax) AS dose FROM lineitem GROUP BY 1)"""

CHAPTER = """CASE WHEN version = 10 THEN NULL WHEN version = 9 THEN
  CASE WHEN d BETWEEN 1 AND 139 THEN 'Infectious' WHEN d BETWEEN 140 AND 239 THEN 'Neoplasms'
       WHEN d BETWEEN 240 AND 279 THEN 'Endocrine' WHEN d BETWEEN 280 AND 289 THEN 'Blood/Immune'
       WHEN d BETWEEN 290 AND 319 THEN 'Mental' WHEN d BETWEEN 320 AND 389 THEN 'Neurologic'
       WHEN d BETWEEN 390 AND 459 THEN 'Circulatory' WHEN d BETWEEN 460 AND 519 THEN 'Respiratory'
       WHEN d BETWEEN 520 AND 579 THEN 'Digestive' WHEN d BETWEEN 580 AND 629 THEN 'Genitourinary'
       WHEN d BETWEEN 630 AND 679 THEN 'Pregnancy' WHEN d BETWEEN 680 AND 709 THEN 'Skin'
       WHEN d BETWEEN 710 AND 739 THEN 'Musculoskeletal' WHEN d BETWEEN 740 AND 759 THEN 'Congenital'
       WHEN d BETWEEN 760 AND 779 THEN 'Perinatal' WHEN d BETWEEN 780 AND 799 THEN 'Symptoms'
       WHEN d >= 800 THEN 'InjuryPoisoning' ELSE 'OtherUnmapped' END END"""


def _near(minutes: int, where: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT p.stay_id, p.event_time, c.provider AS v
  FROM probes p JOIN candidates c ON p.stay_id = c.stay_id AND {where}
   AND abs(epoch_us(c.time) - epoch_us(p.event_time)) < {(minutes + 1) * 60_000_000}
  QUALIFY row_number() OVER (PARTITION BY p.stay_id, p.event_time
    ORDER BY abs(epoch_us(c.time) - epoch_us(p.event_time)), c.provider) = 1)"""


FACTS = A.TIMELINE + "," + A.SEGMENTS + "," + A.CANDIDATES + """,
events_all AS (
  SELECT event_id, subject_id, event_time, event_type, source, provider_id
  FROM timeline WHERE source = 'explicit'
  UNION ALL SELECT event_id, subject_id, start_time, 'start', 'inferred', NULL FROM segments
  WHERE epoch_us(end_time) - epoch_us(start_time) >= 3600000000
  UNION ALL SELECT event_id, subject_id, end_time, 'end', 'inferred', NULL FROM segments
  WHERE epoch_us(end_time) - epoch_us(start_time) >= 3600000000),
kept AS (
  SELECT * FROM events_all WINDOW w AS (PARTITION BY subject_id ORDER BY event_time, event_id)
  QUALIFY NOT (source = 'inferred' AND (
    coalesce(lag(event_type) OVER w = event_type AND lag(source) OVER w = 'explicit'
      AND epoch_us(event_time) - epoch_us(lag(event_time) OVER w) < 7260000000, FALSE)
    OR coalesce(lead(event_type) OVER w = event_type AND lead(source) OVER w = 'explicit'
      AND epoch_us(lead(event_time) OVER w) - epoch_us(event_time) < 7260000000, FALSE)))),
seq AS (
  SELECT *, subject_id AS stay_id, lag(event_type) OVER w AS pt, lag(event_time) OVER w AS px,
         lead(event_type) OVER w AS nt, lead(event_time) OVER w AS nx, lead(source) OVER w AS ns
  FROM kept WINDOW w AS (PARTITION BY subject_id ORDER BY event_time, event_id)),
closing AS (SELECT stay_id, end_time, min(start_time) AS start_time FROM segments GROUP BY 1, 2),
probes AS (SELECT DISTINCT stay_id, event_time FROM seq
           WHERE event_type = 'end' AND source = 'explicit'),""" + \
    _near(720, "kind = 'click'", "near0") + "," + _near(360, "kind = 'view'", "near1") + "," + \
    _near(180, "TRUE", "near2") + """,
used AS (SELECT stay_id, provider, count(*) AS n FROM candidates GROUP BY 1, 2),
mode AS (
  SELECT p.stay_id, p.event_time, c.provider AS v
  FROM probes p JOIN candidates c ON p.stay_id = c.stay_id
   AND abs(epoch_us(c.time) - epoch_us(p.event_time)) < 25 * 3600000000
  JOIN used u ON c.stay_id = u.stay_id AND c.provider = u.provider
  QUALIFY row_number() OVER (PARTITION BY p.stay_id, p.event_time ORDER BY u.n DESC, c.provider) = 1),
facts AS (
  SELECT s.* EXCLUDE (provider_id), s.stay_id % 5 AS unit,
    CASE WHEN nt = 'start' AND source = 'explicit' AND ns = 'explicit'
          AND epoch_us(nx) - epoch_us(s.event_time) < 73 * 3600000000 THEN 1 ELSE 0 END AS failed,
    coalesce(pt = 'start', FALSE) AS recorded_start,
    CASE WHEN pt = 'start' AND s.event_time > px
         THEN (epoch_us(s.event_time) - epoch_us(px)) / 3.6e9
         WHEN c.start_time IS NOT NULL
         THEN (epoch_us(s.event_time) - epoch_us(c.start_time)) / 3.6e9 END AS episode_hours,
    CASE WHEN source = 'explicit'
         THEN coalesce(provider_id, near0.v, near1.v, near2.v, mode.v) END AS provider_id,
    CASE WHEN source = 'inferred' THEN 'inferred_none' WHEN provider_id IS NOT NULL THEN 'recorded'
         WHEN near0.v IS NOT NULL THEN 'click_720m' WHEN near1.v IS NOT NULL THEN 'view_360m'
         WHEN near2.v IS NOT NULL THEN 'any_180m' WHEN mode.v IS NOT NULL THEN 'most_frequent_24h'
         ELSE 'missing' END AS provider_source
  FROM seq s LEFT JOIN closing c ON s.stay_id = c.stay_id AND s.event_time = c.end_time
  LEFT JOIN near0 ON s.stay_id = near0.stay_id AND s.event_time = near0.event_time
  LEFT JOIN near1 ON s.stay_id = near1.stay_id AND s.event_time = near1.event_time
  LEFT JOIN near2 ON s.stay_id = near2.stay_id AND s.event_time = near2.event_time
  LEFT JOIN mode ON s.stay_id = mode.stay_id AND s.event_time = mode.event_time
  WHERE event_type = 'end')"""

SUBJECTS = FACTS + "," + A.DIAGNOSES + "," + PROCEDURES + "," + RESPIRATORY + "," + SUBJECT_SQL + """,
last AS (
  SELECT * FROM facts WHERE episode_hours > 0
  QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY event_time DESC, event_id DESC) = 1),
prov AS (SELECT provider_id, count(*) AS provider_n, avg(failed) AS r FROM facts
         WHERE provider_id IS NOT NULL AND source = 'explicit' GROUP BY 1),
prov_unit AS (SELECT provider_id, unit, count(*) AS provider_unit_n, avg(failed) AS r FROM facts
              WHERE provider_id IS NOT NULL AND source = 'explicit' GROUP BY 1, 2),
pairs AS (
  SELECT e.subject_id, e.event_time, min(s.event_time) AS t FROM seq e JOIN seq s
    ON e.subject_id = s.subject_id AND e.event_type = 'end' AND s.event_type = 'start'
   AND e.source = 'explicit' AND s.source = 'explicit'
   AND epoch_us(s.event_time) - epoch_us(e.event_time) BETWEEN 3600000000 AND 262799999999
  GROUP BY 1, 2),
failures AS (SELECT subject_id, count(*) AS n FROM pairs GROUP BY 1),
hours AS (SELECT subject_id, sum(episode_hours) AS total FROM facts GROUP BY 1),
prim AS (SELECT hadm_id, max(""" + CHAPTER + """) AS primary_diagnosis,
                max(code || ': ' || title) AS primary_long_diagnosis
         FROM (SELECT *, CASE WHEN regexp_matches(code, '^[0-9]{3}')
                               THEN CAST(substr(code, 1, 3) AS INTEGER) END AS d
               FROM coded WHERE seq_num = 1)
         GROUP BY 1),
sec AS (SELECT hadm_id, array_to_string(list_sort(list(DISTINCT code || ': ' || title)
               FILTER (code || ': ' || title IS NOT NULL)), '|') AS secondary_diagnosis
        FROM coded WHERE seq_num = 2 GROUP BY 1),
arr AS (SELECT hadm_id,
          array_to_string(list_sort(list(DISTINCT category) FILTER (category IS NOT NULL)), ',') AS codes,
          array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ',') AS code_labels
        FROM coded WHERE seq_num <= 10 AND version = 10 GROUP BY 1),
near_d AS (SELECT hadm_id, code || ': ' || title AS nearest_diagnosis FROM coded
           QUALIFY row_number() OVER (PARTITION BY hadm_id ORDER BY seq_num, code) = 1),
subjects AS (
  SELECT l.subject_id, l.unit, c_acctbal AS age, c_mktsegment AS gender, primary_diagnosis,
    primary_long_diagnosis, codes, code_labels, secondary_diagnosis, nearest_diagnosis, severity,
    coalesce(dose, 0) AS dose, total AS total_hours, episode_hours AS last_hours, l.event_time,
    CASE WHEN surgery_time IS NOT NULL
          AND trunc((epoch_us(l.event_time) - epoch_us(surgery_time)) / 3.6e9)
              + coalesce(episode_hours, 0) BETWEEN -12 AND 12 THEN 'surgical'
         WHEN coalesce(respiratory_count, 0) > 0 THEN 'medical-respiratory'
         ELSE 'medical-non-respiratory' END AS category,
    recorded_start, l.source, provider_source, l.provider_id,
    coalesce(pu.r, p.r, (SELECT avg(failed) FROM facts WHERE source = 'explicit')) AS rate,
    provider_n, provider_unit_n, coalesce(f.n, 0) AS n_failures_lifetime, expired, death_date
  FROM last l LEFT JOIN prov p ON l.provider_id = p.provider_id
  LEFT JOIN prov_unit pu ON l.provider_id = pu.provider_id AND l.unit = pu.unit
  LEFT JOIN failures f ON l.subject_id = f.subject_id
  LEFT JOIN hours h ON l.subject_id = h.subject_id
  LEFT JOIN customer ON l.subject_id = c_custkey
  LEFT JOIN deaths ON l.subject_id = deaths.o_custkey
  LEFT JOIN admission ON l.subject_id = admission.o_custkey
  LEFT JOIN doses ON l.stay_id = l_orderkey
  LEFT JOIN surgery ON l.stay_id = surgery.hadm_id
  LEFT JOIN respiratory ON l.stay_id = respiratory.hadm_id
  LEFT JOIN prim ON l.stay_id = prim.hadm_id LEFT JOIN sec ON l.stay_id = sec.hadm_id
  LEFT JOIN arr ON l.stay_id = arr.hadm_id LEFT JOIN near_d ON l.stay_id = near_d.hadm_id
  WHERE total > 1 AND total < 5000 AND coalesce(dose, 0) < 1 AND coalesce(f.n, 0) < 1000)"""

TEXTS = ("primary_diagnosis", "primary_long_diagnosis", "nearest_diagnosis")
LISTS = {"codes": ",", "code_labels": ",", "secondary_diagnosis": "|"}
NUMBERS = ("provider_id", "provider_n", "provider_unit_n", "expired")


@query("WITH" + SUBJECTS + """
SELECT subject_id, unit, coalesce(age, -1) AS age, coalesce(gender, '') AS gender, """ + ", ".join(
    f"coalesce({c}, '') AS {c}" for c in (*TEXTS, *LISTS)) + """,
  coalesce(severity, -1) AS severity, dose, round(total_hours, 6) AS total_hours,
  round(last_hours, 6) AS last_hours, epoch_us(event_time) AS event_time_us, category,
  recorded_start, source, provider_source, round(rate, 6) AS rate, """ + ", ".join(
    f"CAST(coalesce({c}, -1) AS BIGINT) AS {c}" for c in NUMBERS) + """,
  n_failures_lifetime, coalesce(CAST(death_date AS VARCHAR), '') AS death_date
FROM subjects""")
def last_event_per_subject(spark, folder):
    rows = _last(spark, folder)
    return rows.select(
        "subject_id", "unit", F.coalesce("age", F.lit(-1.0)).alias("age"),
        F.coalesce("gender", F.lit("")).alias("gender"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in TEXTS],
        *[F.coalesce(F.array_join(c, s), F.lit("")).alias(c) for c, s in LISTS.items()],
        F.coalesce("severity", F.lit(-1.0)).alias("severity"), "dose",
        r6("total_hours").alias("total_hours"), r6("last_hours").alias("last_hours"),
        F.unix_micros("event_time").alias("event_time_us"), "category", "recorded_start",
        "source", "provider_source", r6("rate").alias("rate"),
        *[F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c) for c in NUMBERS],
        "n_failures_lifetime",
        F.coalesce(F.col("death_date").cast("string"), F.lit("")).alias("death_date"),
    )


def _last(spark, folder):
    study = inputs(spark, folder)
    facts = event_facts(study, min_hours=1, near_minutes=120, mode_hours=24)
    return last_event_table(study, facts, **LIMITS)


@query("WITH" + SUBJECTS + """,
exploded AS (SELECT *, unnest(string_split(codes, ',')) AS code FROM subjects
             WHERE provider_n > 10 AND codes <> '')
SELECT subject_id, provider_id, round(rate, 6) AS rate, provider_n, n_failures_lifetime, source,
       provider_source, code
FROM exploded""")
def subject_codes_long(spark, folder):
    rows = long_code_table(_last(spark, folder))
    return rows.select("subject_id", "provider_id", r6("rate").alias("rate"), "provider_n",
                       "n_failures_lifetime", "source", "provider_source", "code")


@query("WITH" + A.TIMELINE + "," + A.SEGMENTS + "," + SUBJECT_SQL + """,
seq AS (
  SELECT *, lag(event_type) OVER w AS pt, lag(event_time) OVER w AS px,
         lead(event_type) OVER w AS nt, lead(event_time) OVER w AS nx
  FROM timeline WHERE source = 'explicit'
  WINDOW w AS (PARTITION BY subject_id ORDER BY event_time, event_id)),
closing AS (SELECT stay_id, end_time, min(start_time) AS start_time FROM segments GROUP BY 1, 2),
facts AS (
  SELECT s.*, CASE WHEN nt = 'start' AND epoch_us(nx) - epoch_us(s.event_time) < 73 * 3600000000
                   THEN 1 ELSE 0 END AS failed,
    CASE WHEN pt = 'start' AND s.event_time > px
         THEN (epoch_us(s.event_time) - epoch_us(px)) / 3.6e9
         WHEN c.start_time IS NOT NULL
         THEN (epoch_us(s.event_time) - epoch_us(c.start_time)) / 3.6e9 END AS episode_hours
  FROM seq s LEFT JOIN closing c ON s.stay_id = c.stay_id AND s.event_time = c.end_time
  WHERE event_type = 'end'),
ok AS (SELECT * FROM facts
       WHERE episode_hours > 1 AND episode_hours < 1000 AND provider_id IS NOT NULL),
sums AS (SELECT provider_id, count(*) AS n, sum(failed) AS f FROM ok GROUP BY 1)
SELECT event_id, subject_id, unit, coalesce(c_acctbal, -1) AS age, coalesce(severity, -1) AS severity,
       coalesce(dose, 0) AS dose, round(episode_hours, 6) AS episode_hours, ok.provider_id,
       round(CASE WHEN n > 1 THEN (f - failed) / (n - 1) END, 6) AS rate_loo, n AS provider_n,
       failed, CAST(coalesce(expired, -1) AS BIGINT) AS expired,
       coalesce(CAST(death_date AS VARCHAR), '') AS death_date
FROM ok JOIN sums ON ok.provider_id = sums.provider_id
LEFT JOIN customer ON subject_id = c_custkey LEFT JOIN deaths ON subject_id = deaths.o_custkey
LEFT JOIN admission ON subject_id = admission.o_custkey LEFT JOIN doses ON stay_id = l_orderkey
WHERE n > 10""")
def all_events(spark, folder):
    rows = all_event_table(inputs(spark, folder))
    return rows.select(
        "event_id", "subject_id", "unit", F.coalesce("age", F.lit(-1.0)).alias("age"),
        F.coalesce("severity", F.lit(-1.0)).alias("severity"), "dose",
        r6("episode_hours").alias("episode_hours"), "provider_id", r6("rate_loo").alias("rate_loo"),
        "provider_n", "failed",
        F.coalesce(F.col("expired").cast("long"), F.lit(-1)).alias("expired"),
        F.coalesce(F.col("death_date").cast("string"), F.lit("")).alias("death_date"),
    )
