"""Nearest-in-time matching without forming all pairs of a key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequela.functions.exprs import MICROS_PER_HOUR, MICROS_PER_MINUTE, case, micros
from sequela.operators.joins import in_reach, lookup
from sequela.operators.ordered import COUNT_FIRST, heavy_keys, running
from sequela.operators.timeline import INFERRED


def busy_keys(events: DataFrame, candidates: DataFrame, on: list[str]) -> DataFrame | None:
    """Heavy keys of events and candidates together."""
    return heavy_keys(events.select(*on).unionByName(candidates.select(*on)), on)


def nearest_within(
    events: DataFrame,
    candidates: DataFrame,
    on: list[str],
    event_time: str,
    candidate_time: str,
    value: str,
    minutes: int,
    out: str = "nearest",
    exclude: Column | None = None,
    heavy: DataFrame | None = COUNT_FIRST,
) -> DataFrame:
    """For each distinct event time of a key, the ``value`` recorded nearest to it.

    Counts candidates up to ``minutes`` whole minutes away on either side; the smallest value wins
    a tie. Events and candidates are put in one order per key and the latest candidate before and
    after each event is carried along, so the work is a sort, not a product. ``heavy`` passes on
    the heavy keys of events and candidates together.
    """
    reach = (minutes + 1) * MICROS_PER_MINUTE - 1
    if exclude is not None:
        candidates = candidates.where(~F.coalesce(exclude, F.lit(False)))
    usable = candidates.where(F.col(value).isNotNull())
    near = in_reach(usable, events, on, candidate_time, event_time, reach)

    seen = near.groupBy(*on, micros(candidate_time).alias("_at")).agg(F.min(value).alias("_v"))
    seen = seen.select(*on, "_at", F.lit(0).alias("_probe"), F.struct("_at", "_v").alias("_c"))
    none = F.lit(None).cast(seen.schema["_c"].dataType)
    probes = events.select(*on, micros(event_time).alias("_at"), F.lit(1).alias("_probe"),
                           none.alias("_c")).distinct()
    line = probes.unionByName(seen)
    if heavy is COUNT_FIRST:
        heavy = busy_keys(events, usable, on)
    line = running(line, on, [F.col("_at"), F.col("_probe")], {"_before": ("last", "_c")},
                   heavy=heavy)
    line = running(line, on, [F.col("_at").desc(), F.col("_probe")], {"_after": ("last", "_c")},
                   heavy=heavy)

    def ranked(side: str) -> Column:
        gap = F.abs(F.col(side)["_at"] - F.col("_at"))
        return F.when(gap <= reach, F.struct(gap.alias("gap"), F.col(side)["_v"].alias("v")))

    best = F.least(ranked("_before"), ranked("_after"))
    return (
        line.where(F.col("_probe") == 1)
        .select(*on, F.timestamp_micros("_at").alias(event_time), best.alias("_b"))
        .where(F.col("_b").isNotNull())
        .select(*on, event_time, F.col("_b")["v"].alias(out),
                (F.col("_b")["gap"] / 1e6).alias(f"{out}_seconds"))
    )


def most_frequent_nearby(
    events: DataFrame,
    candidates: DataFrame,
    on: list[str],
    event_time: str,
    candidate_time: str,
    value: str,
    hours: int = 2,
    out: str = "most_frequent",
    heavy: DataFrame | None = COUNT_FIRST,
) -> DataFrame:
    """Among values recorded within whole ``hours`` of the event, the one most used in the key.

    Frequency counts all of the key's records, not just those nearby; the smallest value wins a
    tie. The minimum over a sliding stretch of time is taken from two running minima: time is cut
    into blocks as wide as the stretch, which then covers the tail of one block and the head of
    the next.
    """
    reach = (hours + 1) * MICROS_PER_HOUR - 1
    width = 2 * reach + 1
    usable = candidates.where(F.col(value).isNotNull())
    use = usable.groupBy(*on, value).agg(F.count(F.lit(1)).alias("_n"))
    if heavy is COUNT_FIRST:
        heavy = busy_keys(events, usable, on)
    # Without a heavy key there is no heavy part of one either.
    finer = None if heavy is None else COUNT_FIRST
    near = in_reach(usable, events, on, candidate_time, event_time, reach)
    marks = near.select(*on, micros(candidate_time).alias("_at"), value).distinct()
    marks = lookup(marks, use, on + [value], "inner", finer)
    marks = marks.groupBy(*on, "_at").agg(
        F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("_m")
    )
    none = F.lit(None).cast(marks.schema["_m"].dataType)
    at = micros(event_time)
    distinct_events = events.select(*on, event_time).distinct()

    def side(shift: int, order: list[Column]) -> DataFrame:
        probes = distinct_events.select(*on, (at + shift).alias("_at"), none.alias("_m"),
                                        F.col(event_time))
        line = probes.unionByName(marks, allowMissingColumns=True).withColumn(
            "_block", F.floor(F.col("_at") / width)
        )
        done = running(line, on + ["_block"], order, {"_best": ("min", "_m")}, heavy=finer)
        return done.where(F.col(event_time).isNotNull()).select(*on, event_time, "_best")

    marks_first = F.col(event_time).isNotNull()
    tail = side(-reach, [F.col("_at").desc(), marks_first, F.col(event_time)])
    head = side(reach, [F.col("_at"), marks_first, F.col(event_time)])
    return (
        tail.unionByName(head)
        .groupBy(*on, event_time)
        .agg(F.min("_best").alias("_best"))
        .where(F.col("_best").isNotNull())
        .select(*on, event_time, F.col("_best")["v"].alias(out))
    )


@dataclass(frozen=True)
class Tier:
    """One fallback source: its label and the column holding its match."""

    label: str
    column: str


def resolve_cascade(
    events: DataFrame,
    recorded: str,
    tiers: list[Tier],
    source: str = "source",
    out: str = "provider_id",
    provenance: str = "provider_source",
) -> DataFrame:
    """First value found over the tiers, and which tier gave it; inferred events never get one."""
    inferred = F.col(source) == INFERRED
    value = F.coalesce(recorded, *[t.column for t in tiers])
    label = case(
        [(inferred, F.lit("inferred_none")), (F.col(recorded).isNotNull(), F.lit("recorded"))]
        + [(F.col(t.column).isNotNull(), F.lit(t.label)) for t in tiers],
        F.lit("missing"),
    )
    return events.withColumns({"_value": F.when(~inferred, value), provenance: label}).withColumn(
        out, F.col("_value")
    ).drop("_value")
