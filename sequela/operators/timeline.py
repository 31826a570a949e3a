"""Per-subject event timelines: sources, sequence, episodes, failures."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequela.functions.exprs import (
    MICROS_PER_HOUR,
    MICROS_PER_MINUTE,
    case,
    col,
    hours_between,
    micros,
    whole_hours_between,
)
from sequela.operators.ordered import COUNT_FIRST, neighbours, running

START, END = "start", "end"
EXPLICIT, INFERRED = "explicit", "inferred"


def label_events(
    rows: DataFrame, code: str, labels: dict, out: str = "event_type"
) -> DataFrame:
    """Keep rows with a listed code and name it."""
    kept = rows.where(F.col(code).isin(*labels))
    return kept.withColumn(
        out, case([(F.col(code) == k, F.lit(v)) for k, v in labels.items()])
    )


def segments_to_events(
    segments: DataFrame,
    carry: Iterable[str],
    start: str = "start_time",
    end: str = "end_time",
    min_hours: float = 4,
    time: str = "event_time",
) -> DataFrame:
    """One inferred start and one inferred end per segment of at least ``min_hours``."""
    edge = F.struct
    edges = F.array(
        edge(F.col(start).alias(time), F.lit(START).alias("event_type")),
        edge(F.col(end).alias(time), F.lit(END).alias("event_type")),
    )
    return (
        segments.where(hours_between(start, end) >= min_hours)
        .select(*carry, F.explode(edges).alias("_e"))
        .select(*carry, f"_e.{time}", "_e.event_type", F.lit(INFERRED).alias("source"))
    )


def combine_sources(explicit: DataFrame, *inferred: DataFrame) -> DataFrame:
    """All events in one table; columns a source lacks are null."""
    for events in inferred:
        explicit = explicit.unionByName(events, allowMissingColumns=True)
    return explicit


def _order(time: str, tiebreak: str) -> list[Column]:
    return [F.col(time), F.col(tiebreak)]


def suppress_near_duplicates(
    events: DataFrame,
    subject: str = "subject_id",
    time: str = "event_time",
    tiebreak: str = "event_id",
    minutes: int = 30,
    heavy: DataFrame | None = COUNT_FIRST,
) -> DataFrame:
    """Drop an inferred event next to an explicit one of the same type within whole ``minutes``."""
    rows = neighbours(events, [subject], _order(time, tiebreak), ["event_type", "source", time],
                      heavy)
    reach = (minutes + 1) * MICROS_PER_MINUTE

    def doubled(side: str) -> Column:
        gap = F.abs(micros(f"{side}_{time}") - micros(time))
        return (
            (F.col(f"{side}_event_type") == F.col("event_type"))
            & (F.col(f"{side}_source") == EXPLICIT)
            & (gap < reach)
        )

    near = F.coalesce(doubled("prev"), F.lit(False)) | F.coalesce(doubled("next"), F.lit(False))
    return rows.where(~((F.col("source") == INFERRED) & near)).select(*events.columns)


def with_neighbors(
    events: DataFrame,
    subject: str = "subject_id",
    time: str = "event_time",
    tiebreak: str = "event_id",
    heavy: DataFrame | None = COUNT_FIRST,
) -> DataFrame:
    """Type, time and source of the previous and next event of the subject."""
    columns = ["event_type", time, "source"]
    return neighbours(events, [subject], _order(time, tiebreak), columns, heavy)


def recorded_start() -> Column:
    """Whether the event before is a start."""
    return F.coalesce(F.col("prev_event_type") == START, F.lit(False))


def failure_flag(time: str = "event_time", hours: int = 72) -> Column:
    """1 when the next event is a start within whole ``hours``, both recorded explicitly."""
    failed = (
        (F.col("next_event_type") == START)
        & (whole_hours_between(time, f"next_{time}") <= hours)
        & (F.col("source") == EXPLICIT)
        & (F.col("next_source") == EXPLICIT)
    )
    return F.when(failed, 1).otherwise(0)


def unique_segments(
    segments: DataFrame, on: list[str], start: str = "start_time", end: str = "end_time"
) -> DataFrame:
    """One segment per key and end time (the earliest start), so joins on it cannot fan out."""
    return segments.groupBy(*on, end).agg(F.min(start).alias(start))


def episode_hours(
    sequenced: DataFrame,
    segments: DataFrame,
    on: list[str],
    time: str = "event_time",
    start: str = "start_time",
    end: str = "end_time",
    out: str = "episode_hours",
) -> DataFrame:
    """Hours since the previous start; else the length of the segment ending at the event."""
    closing = unique_segments(segments, on, start, end).select(
        *on, F.col(end).alias(time), F.col(start).alias("_segment_start")
    )
    rows = sequenced.join(closing, on + [time], "left")
    since_start = hours_between(f"prev_{time}", time)
    return rows.withColumn(
        out,
        case(
            [
                ((F.col("prev_event_type") == START) & (since_start > 0), since_start),
                (F.col("_segment_start").isNotNull(), hours_between("_segment_start", time)),
            ]
        ),
    ).select(*sequenced.columns, out)


def followup_pairs(
    ends: DataFrame,
    starts: DataFrame,
    subject: str = "subject_id",
    time: str = "event_time",
    lo: int = 1,
    hi: int = 72,
    heavy: DataFrame | None = COUNT_FIRST,
) -> DataFrame:
    """Each distinct end with its first start between ``lo`` and ``hi`` whole hours later.

    The first start at or after ``time + lo`` is the only candidate, so it is read off a running
    value over ends and starts together rather than from all pairs of a subject.
    """
    due = micros(time) + lo * MICROS_PER_HOUR
    probes = ends.select(subject, due.alias("_at"), F.col(time).alias("_end"),
                         F.lit(None).cast("timestamp").alias("_start")).distinct()
    marks = starts.select(subject, micros(time).alias("_at"),
                          F.lit(None).cast("timestamp").alias("_end"),
                          F.col(time).alias("_start")).distinct()
    both = running(
        probes.unionByName(marks), [subject],
        [F.col("_at").desc(), F.col("_start").desc_nulls_last(), F.col("_end").desc_nulls_last()],
        {"followup_time": ("last", "_start")}, heavy=heavy,
    )
    gap = micros("followup_time") - micros("_end")
    return both.where(F.col("_end").isNotNull() & (gap < (hi + 1) * MICROS_PER_HOUR)).select(
        subject, F.col("_end").alias(time), "followup_time"
    )


def failure_counts(
    pairs: DataFrame, subject: str = "subject_id", out: str = "n_failures_lifetime"
) -> DataFrame:
    return pairs.groupBy(subject).agg(F.count(F.lit(1)).alias(out))


def total_hours(
    ends: DataFrame, subject: str = "subject_id", hours: str = "episode_hours",
    out: str = "total_hours",
) -> DataFrame:
    return ends.groupBy(subject).agg(F.sum(hours).alias(out))


def last_per_subject(
    ends: DataFrame,
    subject: str = "subject_id",
    time: str = "event_time",
    tiebreak: str = "event_id",
    having: Column | None = None,
) -> DataFrame:
    """The latest row of each subject; combines before the shuffle, so no subject is sorted."""
    having = col("episode_hours") > 0 if having is None else having
    return (
        ends.where(having)
        .groupBy(subject)
        .agg(F.max_by(F.struct(*ends.columns), F.struct(time, tiebreak)).alias("_row"))
        .select("_row.*")
    )
