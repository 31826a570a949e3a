"""Queries on event timelines, nearest-time matching and look-back windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sequela.functions.exprs import r6
from sequela.operators import providers as P
from sequela.operators import timejoin as J
from sequela.operators import timeline as T
from sequela.operators import trajectory as L
from sequela.operators.joins import band_join
from sequela.operators.logit import coefficient_table, fit_logit
from sequela.plans.registry import query
from sequela.sources import adapters as A

MINUTE = 60_000_000


def us(c: str):
    """Instant as a whole number; -1 stands for none, as it does in the SQL."""
    return F.coalesce(F.unix_micros(c), F.lit(-1)).alias(f"{c}_us")


def known(c: str):
    return F.coalesce(c, F.lit(-1)).alias(c)


def ends(spark, folder):
    rows = T.with_neighbors(A.timeline(spark, folder)).where(F.col("event_type") == T.END)
    return rows.withColumn("failed", T.failure_flag())


@query("WITH" + A.TIMELINE + """
SELECT event_id, subject_id, event_type, source, coalesce(provider_id, -1) AS provider_id,
       epoch_us(event_time) AS event_time_us
FROM timeline""")
def label_events(spark, folder):
    return A.timeline(spark, folder).select(
        "event_id", "subject_id", "event_type", "source", known("provider_id"), us("event_time")
    )


@query("WITH" + A.SEGMENTS + """
SELECT stay_id, 'start' AS event_type, epoch_us(start_time) AS event_time_us, 'inferred' AS source
FROM segments WHERE epoch_us(end_time) - epoch_us(start_time) >= 3600000000
UNION ALL
SELECT stay_id, 'end', epoch_us(end_time), 'inferred'
FROM segments WHERE epoch_us(end_time) - epoch_us(start_time) >= 3600000000""")
def segments_to_events(spark, folder):
    rows = T.segments_to_events(A.segments(spark, folder), ["stay_id"], min_hours=1)
    return rows.select("stay_id", "event_type", us("event_time"), "source")


COMBINED = A.TIMELINE + "," + A.SEGMENTS + """,
combined AS (
  SELECT event_id, subject_id, event_time, event_type, source, provider_id
  FROM timeline WHERE source = 'explicit'
  UNION ALL
  SELECT event_id, subject_id, start_time, 'start', 'inferred', NULL
  FROM segments WHERE epoch_us(end_time) - epoch_us(start_time) >= 3600000000
  UNION ALL
  SELECT event_id, subject_id, end_time, 'end', 'inferred', NULL
  FROM segments WHERE epoch_us(end_time) - epoch_us(start_time) >= 3600000000)"""


def combined(spark, folder):
    explicit = A.timeline(spark, folder).where(F.col("source") == T.EXPLICIT)
    inferred = T.segments_to_events(
        A.segments(spark, folder), ["subject_id", "event_id"], min_hours=1
    )
    return T.combine_sources(
        explicit.select("event_id", "subject_id", "event_time", "event_type", "source",
                        "provider_id"),
        inferred,
    )


@query("WITH" + COMBINED + """
SELECT event_id, subject_id, epoch_us(event_time) AS event_time_us, event_type, source,
       coalesce(provider_id, -1) AS provider_id
FROM combined""")
def combine_sources(spark, folder):
    return combined(spark, folder).select(
        "event_id", "subject_id", us("event_time"), "event_type", "source", known("provider_id")
    )


@query("WITH" + A.TIMELINE + """
SELECT event_id, subject_id, epoch_us(event_time) AS event_time_us, event_type, source
FROM timeline WINDOW w AS (PARTITION BY subject_id ORDER BY event_time, event_id)
QUALIFY NOT (source = 'inferred' AND (
  coalesce(lag(event_type) OVER w = event_type AND lag(source) OVER w = 'explicit'
    AND epoch_us(event_time) - epoch_us(lag(event_time) OVER w) < 43260000000, FALSE)
  OR coalesce(lead(event_type) OVER w = event_type AND lead(source) OVER w = 'explicit'
    AND epoch_us(lead(event_time) OVER w) - epoch_us(event_time) < 43260000000, FALSE)))""")
def suppress_near_duplicates(spark, folder):
    rows = T.suppress_near_duplicates(A.timeline(spark, folder), minutes=720)
    return rows.select("event_id", "subject_id", us("event_time"), "event_type", "source")


@query("WITH" + A.SEQUENCED + """
SELECT event_id, prev_event_type, coalesce(epoch_us(prev_event_time), -1) AS prev_event_time_us, prev_source,
       next_event_type, coalesce(epoch_us(next_event_time), -1) AS next_event_time_us, next_source
FROM sequenced""")
def with_neighbors(spark, folder):
    rows = T.with_neighbors(A.timeline(spark, folder))
    return rows.select(
        "event_id", "prev_event_type", us("prev_event_time"), "prev_source",
        "next_event_type", us("next_event_time"), "next_source",
    )


HOURS = A.ENDS + "," + A.SEGMENTS + """,
closing AS (
  SELECT stay_id, end_time, min(start_time) AS start_time FROM segments
  GROUP BY stay_id, end_time),
timed AS (
  SELECT e.*, CASE WHEN prev_event_type = 'start' AND event_time > prev_event_time
         THEN (epoch_us(event_time) - epoch_us(prev_event_time)) / 3.6e9
         WHEN c.start_time IS NOT NULL
         THEN (epoch_us(event_time) - epoch_us(c.start_time)) / 3.6e9 END AS episode_hours
  FROM ends e LEFT JOIN closing c ON e.stay_id = c.stay_id AND e.event_time = c.end_time)"""


def timed(spark, folder):
    return T.episode_hours(ends(spark, folder), A.segments(spark, folder), ["stay_id"])


@query("WITH" + HOURS + """
SELECT event_id, subject_id, round(episode_hours, 6) AS episode_hours FROM timed""")
def episode_hours(spark, folder):
    return timed(spark, folder).select(
        "event_id", "subject_id", r6("episode_hours").alias("episode_hours")
    )


# Ends of the intervals themselves: the exact match on the end time supplies the hours.
@query("WITH" + A.SEGMENTS + """,
seq AS (
  SELECT stay_id, event_time, event_type,
         lag(event_type) OVER w AS prev_type, lag(event_time) OVER w AS prev_time
  FROM (SELECT stay_id, event_id, start_time AS event_time, 'start' AS event_type FROM segments
        UNION ALL SELECT stay_id, event_id, end_time, 'end' FROM segments)
  WINDOW w AS (PARTITION BY stay_id ORDER BY event_time, event_id, event_type DESC)),
closing AS (
  SELECT stay_id, end_time, min(start_time) AS start_time FROM segments GROUP BY stay_id, end_time)
SELECT s.stay_id, epoch_us(event_time) AS event_time_us,
       round(CASE WHEN prev_type = 'start' AND event_time > prev_time
                  THEN (epoch_us(event_time) - epoch_us(prev_time)) / 3.6e9
                  ELSE (epoch_us(event_time) - epoch_us(start_time)) / 3.6e9 END, 6) AS hours
FROM seq s LEFT JOIN closing c ON s.stay_id = c.stay_id AND s.event_time = c.end_time
WHERE event_type = 'end'""")
def episode_hours_from_segments(spark, folder):
    seg = A.segments(spark, folder)
    events = T.segments_to_events(seg, ["stay_id", "event_id"], min_hours=0).withColumn(
        "tiebreak", F.struct("event_id", (F.col("event_type") == T.END).alias("is_end"))
    )
    rows = T.with_neighbors(events, "stay_id", "event_time", "tiebreak")
    rows = T.episode_hours(rows.where(F.col("event_type") == T.END), seg, ["stay_id"], out="hours")
    return rows.select("stay_id", us("event_time"), r6("hours").alias("hours"))


@query("WITH" + A.ENDS + """
SELECT event_id, failed, coalesce(prev_event_type = 'start', FALSE) AS recorded_start FROM ends""")
def failure_flag(spark, folder):
    return ends(spark, folder).select(
        "event_id", "failed", T.recorded_start().alias("recorded_start")
    )


# The flag in a sequence of explicit events only, where inferred ones cannot intervene.
@query("WITH" + A.TIMELINE + """,
seq AS (
  SELECT *, lead(event_type) OVER w AS nt, lead(event_time) OVER w AS nx
  FROM timeline WHERE source = 'explicit'
  WINDOW w AS (PARTITION BY subject_id ORDER BY event_time, event_id))
SELECT event_id, CASE WHEN nt = 'start' AND epoch_us(nx) - epoch_us(event_time) < 73 * 3600000000
                      THEN 1 ELSE 0 END AS failed
FROM seq WHERE event_type = 'end'""")
def failure_flag_explicit_only(spark, folder):
    explicit = A.timeline(spark, folder).where(F.col("source") == T.EXPLICIT)
    rows = T.with_neighbors(explicit).where(F.col("event_type") == T.END)
    return rows.select("event_id", T.failure_flag().alias("failed"))


PAIRS = A.TIMELINE + """,
pairs AS (
  SELECT e.subject_id, e.event_time, min(s.event_time) AS followup_time
  FROM timeline e JOIN timeline s ON e.subject_id = s.subject_id
   AND e.event_type = 'end' AND s.event_type = 'start'
   AND e.source = 'explicit' AND s.source = 'explicit'
   AND epoch_us(s.event_time) - epoch_us(e.event_time)
       BETWEEN 3600000000 AND 73 * 3600000000 - 1
  GROUP BY e.subject_id, e.event_time)"""


def pairs(spark, folder):
    explicit = A.timeline(spark, folder).where(F.col("source") == T.EXPLICIT)
    return T.followup_pairs(
        explicit.where(F.col("event_type") == T.END), explicit.where(F.col("event_type") == T.START)
    )


@query("WITH" + PAIRS + """
SELECT subject_id, epoch_us(event_time) AS event_time_us, epoch_us(followup_time) AS followup_time_us
FROM pairs""")
def followup_pairs(spark, folder):
    return pairs(spark, folder).select("subject_id", us("event_time"), us("followup_time"))


@query("WITH" + PAIRS + """
SELECT subject_id, count(*) AS n_failures_lifetime FROM pairs GROUP BY subject_id""")
def failure_counts(spark, folder):
    return T.failure_counts(pairs(spark, folder))


@query("WITH" + HOURS + """
SELECT subject_id, round(sum(episode_hours), 6) AS total_hours FROM timed GROUP BY subject_id""")
def total_hours(spark, folder):
    return T.total_hours(timed(spark, folder)).select(
        "subject_id", r6("total_hours").alias("total_hours")
    )


@query("WITH" + HOURS + """
SELECT event_id, subject_id, failed, round(episode_hours, 6) AS last_hours
FROM timed WHERE episode_hours > 0
QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY event_time DESC, event_id DESC) = 1""")
def last_per_subject(spark, folder):
    rows = T.last_per_subject(timed(spark, folder))
    return rows.select("event_id", "subject_id", "failed", r6("episode_hours").alias("last_hours"))


def explicit_ends(spark, folder):
    rows = A.timeline(spark, folder)
    return rows.where((F.col("event_type") == T.END) & (F.col("source") == T.EXPLICIT))


def nearest_sql(minutes: int, where: str = "TRUE", name: str = "near") -> str:
    reach = (minutes + 1) * MINUTE
    return f"""
{name} AS (
  SELECT e.stay_id, e.event_time, c.provider AS nearest,
         abs(epoch_us(c.time) - epoch_us(e.event_time)) / 1e6 AS nearest_seconds
  FROM (SELECT DISTINCT stay_id, event_time FROM timeline
        WHERE event_type = 'end' AND source = 'explicit') e
  JOIN candidates c ON e.stay_id = c.stay_id AND c.provider IS NOT NULL AND {where}
   AND abs(epoch_us(c.time) - epoch_us(e.event_time)) < {reach}
  QUALIFY row_number() OVER (PARTITION BY e.stay_id, e.event_time
    ORDER BY abs(epoch_us(c.time) - epoch_us(e.event_time)), c.provider) = 1)"""


@query("WITH" + A.TIMELINE + "," + A.CANDIDATES + "," + nearest_sql(720, "c.kind <> 'view'") + """
SELECT stay_id, epoch_us(event_time) AS event_time_us, nearest,
       round(nearest_seconds, 6) AS nearest_seconds
FROM near""")
def nearest_within(spark, folder):
    rows = J.nearest_within(
        explicit_ends(spark, folder), A.candidates(spark, folder), ["stay_id"], "event_time",
        "time", "provider", 720, exclude=F.col("kind") == "view",
    )
    return rows.select("stay_id", us("event_time"), "nearest",
                       r6("nearest_seconds").alias("nearest_seconds"))


def mode_sql(hours: int) -> str:
    return f"""
used AS (SELECT stay_id, provider, count(*) AS n FROM candidates
         WHERE provider IS NOT NULL GROUP BY stay_id, provider),
mode AS (
  SELECT e.stay_id, e.event_time, c.provider AS most_frequent
  FROM (SELECT DISTINCT stay_id, event_time FROM timeline
        WHERE event_type = 'end' AND source = 'explicit') e
  JOIN candidates c ON e.stay_id = c.stay_id
   AND abs(epoch_us(c.time) - epoch_us(e.event_time)) < {hours + 1} * 3600000000
  JOIN used u ON c.stay_id = u.stay_id AND c.provider = u.provider
  QUALIFY row_number() OVER (PARTITION BY e.stay_id, e.event_time
    ORDER BY u.n DESC, c.provider) = 1)"""


@query("WITH" + A.TIMELINE + "," + A.CANDIDATES + "," + mode_sql(24) + """
SELECT stay_id, epoch_us(event_time) AS event_time_us, most_frequent FROM mode""")
def most_frequent_nearby(spark, folder):
    rows = J.most_frequent_nearby(
        explicit_ends(spark, folder), A.candidates(spark, folder), ["stay_id"], "event_time",
        "time", "provider", 24,
    )
    return rows.select("stay_id", us("event_time"), "most_frequent")


TIERS = [("click_720m", "click", 720), ("view_360m", "view", 360), ("any_180m", None, 180)]

CASCADE = ("WITH" + A.ENDS + "," + A.CANDIDATES + "".join(
    "," + nearest_sql(m, f"c.kind = '{kind}'" if kind else "TRUE", f"near{i}")
    for i, (_, kind, m) in enumerate(TIERS)) + "," + mode_sql(24) + """,
resolved AS (
  SELECT e.* EXCLUDE (provider_id),
         CASE WHEN source = 'explicit' THEN coalesce(e.provider_id, near0.nearest, near1.nearest,
              near2.nearest, mode.most_frequent) END AS provider_id,
         CASE WHEN source = 'inferred' THEN 'inferred_none'
              WHEN e.provider_id IS NOT NULL THEN 'recorded'
              WHEN near0.nearest IS NOT NULL THEN 'click_720m'
              WHEN near1.nearest IS NOT NULL THEN 'view_360m'
              WHEN near2.nearest IS NOT NULL THEN 'any_180m'
              WHEN mode.most_frequent IS NOT NULL THEN 'most_frequent_24h'
              ELSE 'missing' END AS provider_source
  FROM ends e
  LEFT JOIN near0 ON e.stay_id = near0.stay_id AND e.event_time = near0.event_time
  LEFT JOIN near1 ON e.stay_id = near1.stay_id AND e.event_time = near1.event_time
  LEFT JOIN near2 ON e.stay_id = near2.stay_id AND e.event_time = near2.event_time
  LEFT JOIN mode ON e.stay_id = mode.stay_id AND e.event_time = mode.event_time)""")


def resolved(spark, folder):
    rows, key = ends(spark, folder), ["stay_id", "event_time"]
    probes = explicit_ends(spark, folder)
    busy = J.busy_keys(probes, A.candidates(spark, folder), ["stay_id"])
    tiers = []
    for label, kind, minutes in TIERS:
        pool = A.candidates(spark, folder, (kind,) if kind else ("click", "view"))
        near = J.nearest_within(probes, pool, ["stay_id"], "event_time", "time", "provider",
                                minutes, out=label, heavy=busy).drop(f"{label}_seconds")
        rows = rows.join(near, key, "left")
        tiers.append(J.Tier(label, label))
    most = J.most_frequent_nearby(probes, A.candidates(spark, folder), ["stay_id"], "event_time",
                                  "time", "provider", 24, out="most_frequent_24h", heavy=busy)
    rows = rows.join(most, key, "left")
    tiers.append(J.Tier("most_frequent_24h", "most_frequent_24h"))
    return J.resolve_cascade(rows, "provider_id", tiers).drop(*[t.column for t in tiers])


@query(CASCADE + " SELECT event_id, coalesce(provider_id, -1) AS provider_id, provider_source FROM resolved")
def resolve_cascade(spark, folder):
    return resolved(spark, folder).select(
        "event_id", known("provider_id"), "provider_source"
    )


@query("WITH" + A.ENDS + """
SELECT provider_id, count(*) AS provider_n, round(avg(failed), 6) AS provider_rate,
       count(*) >= 30 AS is_high_volume
FROM ends WHERE provider_id IS NOT NULL AND source = 'explicit' GROUP BY provider_id""")
def provider_rates(spark, folder):
    return P.provider_rates(ends(spark, folder)).withColumn("provider_rate", r6("provider_rate"))


@query("WITH" + A.ENDS + """
SELECT provider_id, unit, count(*) AS provider_unit_n, round(avg(failed), 6) AS provider_unit_rate
FROM ends WHERE provider_id IS NOT NULL AND source = 'explicit' GROUP BY provider_id, unit""")
def provider_unit_rates(spark, folder):
    rows = ends(spark, folder)
    units = rows.groupBy("stay_id").agg(F.max("unit").alias("unit"))
    out = P.provider_unit_rates(rows.drop("unit"), units, ["stay_id"])
    return out.withColumn("provider_unit_rate", r6("provider_unit_rate"))


@query("WITH" + A.ENDS + """
SELECT round(avg(failed), 6) AS overall_rate FROM ends WHERE source = 'explicit'""")
def overall_rate(spark, folder):
    return P.overall_rate(ends(spark, folder)).select(r6("overall_rate").alias("overall_rate"))


@query("WITH" + A.ENDS + """,
p AS (SELECT provider_id, avg(failed) AS r FROM ends
      WHERE provider_id IS NOT NULL AND source = 'explicit' GROUP BY provider_id),
u AS (SELECT provider_id, unit, avg(failed) AS r FROM ends
      WHERE provider_id IS NOT NULL AND source = 'explicit' GROUP BY provider_id, unit)
SELECT event_id, round(coalesce(u.r, p.r,
       (SELECT avg(failed) FROM ends WHERE source = 'explicit')), 6) AS rate
FROM ends e LEFT JOIN u ON e.provider_id = u.provider_id AND e.unit = u.unit
LEFT JOIN p ON e.provider_id = p.provider_id""")
def fallback_rate(spark, folder):
    rows = ends(spark, folder)
    out = P.with_fallback_rate(rows, P.rate_tables(rows))
    return out.select("event_id", r6("rate").alias("rate"))


LOO = "WITH" + A.ENDS + """,
s AS (SELECT provider_id, count(*) AS n, sum(failed) AS f FROM ends
      WHERE source = 'explicit' AND provider_id IS NOT NULL GROUP BY provider_id)
SELECT event_id, e.provider_id, n AS provider_n,
       round(CASE WHEN n > 1 THEN (f - failed) / (n - 1) END, 6) AS rate_loo
FROM ends e JOIN s ON e.provider_id = s.provider_id
WHERE source = 'explicit' AND n > 10"""


@query(LOO)
def leave_one_out(spark, folder):
    rows = ends(spark, folder).where(F.col("source") == T.EXPLICIT)
    out = P.leave_one_out(rows).where(F.col("provider_n") > 10)
    return out.select("event_id", "provider_id", "provider_n", r6("rate_loo").alias("rate_loo"))


# ── Bands and look-back windows ──────────────────────────────────────────────────────────────

@query("WITH" + A.TIMELINE + "," + A.CANDIDATES + """
SELECT event_id, epoch_us(time) AS time_us, provider, kind
FROM timeline e JOIN candidates c ON e.stay_id = c.stay_id
 AND epoch_us(time) - epoch_us(event_time) BETWEEN -7200000000 AND 7200000000""")
def band_join_pairs(spark, folder):
    rows = band_join(
        A.timeline(spark, folder), A.candidates(spark, folder), ["stay_id"], "event_time", "time",
        -120 * MINUTE, 120 * MINUTE,
    )
    return rows.select("event_id", us("time"), "provider", "kind")


LOOKBACK = A.ENDS + "," + A.MEASURES + """,
lookback AS (
  SELECT event_id, failed, m.time, value,
         ((epoch_us(event_time) - epoch_us(m.time)) // 60000000) / 60.0 AS hours_before
  FROM ends e JOIN measures m ON e.stay_id = m.stay_id AND kind = 'click'
   AND value BETWEEN 0 AND 600
   AND epoch_us(event_time) - epoch_us(m.time) BETWEEN 0 AND 259259999999)"""


def lookback(spark, folder):
    return L.lookback_measure(
        ends(spark, folder).select("event_id", "stay_id", "event_time", "failed"),
        A.measures(spark, folder, "click"), ["stay_id"], "event_time", "time", "value",
        low=0,
    )


@query("WITH" + LOOKBACK + """
SELECT event_id, epoch_us(time) AS time_us, value, round(hours_before, 6) AS hours_before
FROM lookback""")
def lookback_measure(spark, folder):
    return lookback(spark, folder).select("event_id", us("time"), "value",
                                          r6("hours_before").alias("hours_before"))


RATIOS = A.ENDS + "," + A.MEASURES + """,
ratios AS (
  SELECT a.stay_id, a.time, a.value / (b.value / 1000.0) AS ratio
  FROM measures a JOIN measures b ON a.stay_id = b.stay_id AND a.kind = 'click'
   AND b.kind = 'view' AND a.value > 0 AND b.value > 0
   AND abs(epoch_us(a.time) - epoch_us(b.time)) < 21660000000),
lookback AS (
  SELECT event_id, failed, r.time, ratio,
         ((epoch_us(event_time) - epoch_us(r.time)) // 60000000) / 60.0 AS hours_before
  FROM ends e JOIN ratios r ON e.stay_id = r.stay_id AND ratio BETWEEN 1 AND 50000
   AND epoch_us(event_time) - epoch_us(r.time) BETWEEN 0 AND 259259999999)"""


@query("WITH" + RATIOS + """
SELECT event_id, epoch_us(time) AS time_us, round(ratio, 6) AS ratio,
       round(hours_before, 6) AS hours_before
FROM lookback""")
def lookback_ratio(spark, folder):
    rows = L.lookback_ratio(
        ends(spark, folder).select("event_id", "stay_id", "event_time"),
        A.measures(spark, folder, "click"), A.measures(spark, folder, "view"), ["stay_id"],
        "event_time", "time", "value", minutes=360, high=50_000,
    )
    return rows.select("event_id", us("time"), r6("ratio").alias("ratio"),
                       r6("hours_before").alias("hours_before"))


SLOPES = LOOKBACK + """,
slopes AS (
  SELECT event_id, failed, regr_slope(value, hours_before) AS slope,
         arg_min(value, hours_before * 1e6 + value) AS level_at_event, avg(value) AS mean_value,
         count(*) AS n_obs
  FROM lookback GROUP BY event_id, failed HAVING count(*) >= 3)"""


@query("WITH" + SLOPES + """
SELECT event_id, failed, round(slope, 6) AS slope_per_hour_before, level_at_event,
       round(mean_value, 9) AS mean_value, n_obs
FROM slopes""")
def event_slopes(spark, folder):
    rows = L.event_slopes(lookback(spark, folder), ["event_id", "failed"], "value")
    return rows.withColumns({"slope_per_hour_before": r6("slope_per_hour_before"),
                             "mean_value": F.round("mean_value", 9)})


@query("WITH" + SLOPES + """
SELECT failed, count(*) AS n, round(avg(slope), 6) AS mean_slope,
       round(avg(level_at_event), 6) AS mean_level, round(median(slope), 6) AS median_slope
FROM slopes GROUP BY failed""")
def slopes_by_outcome(spark, folder):
    rows = L.event_slopes(lookback(spark, folder), ["event_id", "failed"], "value")
    out = L.slopes_by_outcome(rows, "failed")
    return out.withColumns({c: r6(c) for c in ["mean_slope", "mean_level", "median_slope"]})


@query("WITH" + LOOKBACK + """
SELECT CAST(floor(hours_before) AS BIGINT) AS hour_bin, failed, count(*) AS n,
       round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS sd,
       round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(*)), 9) AS lo,
       round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(*)), 9) AS hi
FROM lookback WHERE floor(hours_before) <= 72
GROUP BY 1, 2 HAVING count(*) >= 5""")
def hourly_curve(spark, folder):
    rows = L.hourly_curve(lookback(spark, folder), "failed", "value", min_n=5)
    return rows.withColumns({c: F.round(c, 9) for c in ["mean", "sd", "lo", "hi"]})


@query()
def outcome_by_level_and_slope(spark, folder):
    rows = L.event_slopes(lookback(spark, folder), ["event_id", "failed"], "value")
    rows = rows.where(F.col("slope_per_hour_before").isNotNull())
    fit = fit_logit(rows, "failed", ["level_at_event", "slope_per_hour_before"], kinds=("model",))
    return coefficient_table(spark, {"trajectory": fit})


