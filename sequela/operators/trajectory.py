"""Measurements in the hours before an event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequela.functions.exprs import MICROS_PER_MINUTE, join_groups, micros
from sequela.operators.describe import mean_interval
from sequela.operators.joins import band_join
from sequela.operators.ordered import quantiles

BEFORE = "hours_before"


def _minutes_before(event_time: str, time: str):
    return F.floor((micros(event_time) - micros(time)) / MICROS_PER_MINUTE)


def lookback_measure(
    events: DataFrame,
    measures: DataFrame,
    on: list[str],
    event_time: str,
    time: str,
    value: str,
    hours: int = 72,
    low: float = 50,
    high: float = 600,
) -> DataFrame:
    """Measurements in the ``hours`` before each event, with their distance in hours.

    Distance counts completed minutes; one row per event and measurement.
    """
    usable = measures.where(F.col(value).between(low, high))
    reach = (hours * 60 + 1) * MICROS_PER_MINUTE - 1
    pairs = band_join(events, usable, on, event_time, time, -reach, 0)
    return pairs.withColumn(BEFORE, _minutes_before(event_time, time) / 60.0)


def lookback_ratio(
    events: DataFrame,
    numerator: DataFrame,
    denominator: DataFrame,
    on: list[str],
    event_time: str,
    time: str,
    value: str,
    hours: int = 72,
    minutes: int = 5,
    scale: float = 1000.0,
    low: float = 1,
    high: float = 500,
    out: str = "ratio",
) -> DataFrame:
    """Ratio of two measures taken within ``minutes`` of each other before each event.

    The two measures meet first, in the narrow band between them; only their ratios in range are
    then matched to events over the wide one.
    """
    reach = (minutes + 1) * MICROS_PER_MINUTE - 1
    top = numerator.where(F.col(value) > 0).select(*on, time, F.col(value).alias("_top"))
    bottom = denominator.where(F.col(value) > 0).select(
        *on, F.col(time).alias("_other"), F.col(value).alias("_bottom")
    )
    ratios = band_join(top, bottom, on, time, "_other", -reach, reach).select(
        *on, time, (F.col("_top") / (F.col("_bottom") / scale)).alias(out)
    )
    return lookback_measure(events, ratios, on, event_time, time, out, hours, low, high)


def event_slopes(
    rows: DataFrame, event: list[str], value: str, min_obs: int = 3
) -> DataFrame:
    """Slope of the value on hours before the event, value nearest the event, mean and count.

    The regressor grows backwards in time, so a positive slope is a value falling towards the
    event.
    """
    x, y = F.col(BEFORE), F.col(value)
    return (
        rows.groupBy(*event)
        .agg(
            F.regr_slope(y, x).alias("slope_per_hour_before"),
            F.min_by(y, F.struct(x, y)).alias("level_at_event"),
            F.avg(y).alias("mean_value"),
            F.count(F.lit(1)).alias("n_obs"),
        )
        .where(F.col("n_obs") >= min_obs)
    )


def slopes_by_outcome(slopes: DataFrame, outcome: str) -> DataFrame:
    base = slopes.groupBy(outcome).agg(
        F.avg("slope_per_hour_before").alias("mean_slope"),
        F.avg("level_at_event").alias("mean_level"),
        F.count(F.lit(1)).alias("n"),
    )
    q = quantiles(slopes, [outcome], {"slope_per_hour_before": [0.5]})
    return join_groups(
        base, q.select(outcome, F.col("q_slope_per_hour_before")[0].alias("median_slope")), [outcome]
    )


def hourly_curve(
    rows: DataFrame, outcome: str, value: str, hours: int = 72, min_n: int = 30
) -> DataFrame:
    """Mean and interval per completed hour before the event and outcome."""
    rows = rows.withColumn("hour_bin", F.floor(BEFORE)).where(F.col("hour_bin") <= hours)
    return mean_interval(rows, ["hour_bin", outcome], value, min_n)


