"""Order-dependent work that stays parallel when one key holds much of the table.

Everything that needs the previous row, a running total or a rank goes through :func:`running`.
Keys of ordinary size use a plain window. A key above the size limit is range-partitioned on the
ordering columns, so its rows spread over many tasks; each task works on its own stretch, and what
has to cross from one stretch to the next (a handful of values per stretch) is carried over from a
small summary. Both ways give the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sequela.functions.exprs import all_of, col, join_groups
from sequela.session import HOT_SHARE, checkpointed, hot_rows

POS, CHUNK = "_stretch_place", "_stretch"
SAMPLED_PER_LIMIT = 2000
"""Sampled rows expected of a key that just reaches the limit."""

COUNT_FIRST = object()
"""Default of ``heavy`` arguments: count the keys of the frame at hand."""


def heavy_keys(
    df: DataFrame, keys: list[str], n: str | None = None, limit: int | None = None
) -> DataFrame | None:
    """Keys above the row limit with their (estimated) counts, or None.

    Only decides how the work is spread; the results do not depend on it. Keys are therefore
    counted on a thin sample, dense enough to see any key near the limit, which keeps the count
    from shuffling every key of a large table. ``n`` names a column of counts if ``df`` already
    has them. The list comes to the driver and is bounded: every key in it holds at least
    ``HOT_SHARE`` of the rows, so there are at most ``1 / HOT_SHARE`` of them.
    """
    spark = df.sparkSession
    limit = hot_rows(spark) if limit is None else limit
    share = 1.0 if n else min(1.0, SAMPLED_PER_LIMIT / limit)
    sampled = df.select(*keys) if n is None else df.select(*keys, n)
    if share < 1:
        sampled = sampled.sample(share, seed=7)
    size = F.sum(n) if n else F.count(F.lit(1))
    counts = sampled.groupBy(*keys).agg(F.ceil(size / share).alias("_n"))
    total = counts.agg(F.sum("_n") * F.lit(HOT_SHARE)).scalar()
    rows = counts.where((F.col("_n") > limit) & (F.col("_n") > total)).collect()
    return spark.createDataFrame(rows, counts.schema) if rows else None


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return all_of([left[k].eqNullSafe(right[k]) for k in keys])


def split_heavy(
    df: DataFrame, keys: list[str], heavy: DataFrame | None = COUNT_FIRST
) -> tuple[DataFrame | None, DataFrame | None, int]:
    """``(ordinary rows, rows of heavy keys, number of heavy rows)``; either frame may be None."""
    if not keys:
        n = df.count()
        return (None, df, n) if n > hot_rows(df.sparkSession) else (df, None, 0)
    if heavy is COUNT_FIRST:
        heavy = heavy_keys(df, keys)
    if heavy is None:
        return df, None, 0
    n = heavy.agg(F.sum("_n")).first()[0]
    heavy = F.broadcast(heavy.select(*keys))
    same = _same(df, heavy, keys)
    return df.join(heavy, same, "left_anti"), df.join(heavy, same, "left_semi"), n


_WITHIN = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
_CARRY = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def _plain(df, keys, order_by, aggs, totals, inclusive):
    ordered = Window.partitionBy(*keys).orderBy(*order_by)
    frame = ordered.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    whole = Window.partitionBy(*keys)
    new = {}
    for out, (kind, c) in aggs.items():
        if kind == "lag":
            new[out] = F.lag(col(c)).over(ordered)
        elif kind == "lead":
            new[out] = F.lead(col(c)).over(ordered)
        elif kind == "last":
            new[out] = F.last(col(c), ignorenulls=True).over(frame)
        else:
            new[out] = _WITHIN[kind](col(c)).over(frame)
    for out, (kind, c) in totals.items():
        new[out] = _WITHIN[kind](col(c)).over(whole)
    return df.select("*", *[e.alias(n) for n, e in new.items()])


def _chunked(df, keys, order_by, aggs, totals, inclusive, n_rows):
    spark = df.sparkSession
    sort = [F.col(k) for k in keys] + list(order_by)
    stretches = max(2, math.ceil(2 * n_rows / hot_rows(spark)))
    inputs = {f"_in_{o}": col(c) for o, (_, c) in {**aggs, **totals}.items()}
    df = checkpointed(
        df.select("*", *[e.alias(n) for n, e in inputs.items()])
        .repartitionByRange(stretches, *sort)
        .sortWithinPartitions(*sort)
        .withColumn(POS, F.monotonically_increasing_id())
        .withColumn(CHUNK, F.shiftright(POS, 33))
    )

    within = Window.partitionBy(*keys, CHUNK).orderBy(POS)
    frame = within.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    whole = Window.partitionBy(*keys)

    summary, carry, local, combined = [], [], [], []
    for out, (kind, _) in aggs.items():
        value, s, c, w = F.col(f"_in_{out}"), f"_s_{out}", f"_c_{out}", f"_w_{out}"
        if kind == "lag":
            summary.append(F.max_by(value, POS).alias(s))
            carry.append(F.lag(s).over(by_chunk).alias(c))
            local.append(F.lag(value).over(within).alias(w))
            first = F.row_number().over(within) == 1
            local.append(first.alias(f"_edge_{out}"))
            combined.append(F.when(F.col(f"_edge_{out}"), F.col(c)).otherwise(F.col(w)).alias(out))
        elif kind == "lead":
            summary.append(F.min_by(value, POS).alias(s))
            carry.append(F.lead(s).over(by_chunk).alias(c))
            local.append(F.lead(value).over(within).alias(w))
            local.append(F.lead(F.lit(False), 1, True).over(within).alias(f"_edge_{out}"))
            combined.append(F.when(F.col(f"_edge_{out}"), F.col(c)).otherwise(F.col(w)).alias(out))
        elif kind == "last":
            seen = F.when(value.isNotNull(), F.col(POS))
            summary.append(F.max_by(value, seen).alias(s))
            carry.append(F.last(s, ignorenulls=True).over(before).alias(c))
            local.append(F.last(value, ignorenulls=True).over(frame).alias(w))
            combined.append(F.coalesce(w, c).alias(out))
        else:
            summary.append(_WITHIN[kind](value).alias(s))
            carry.append(_CARRY[kind](s).over(before).alias(c))
            local.append(_WITHIN[kind](value).over(frame).alias(w))
            if kind in ("sum", "count"):
                combined.append(F.coalesce(F.col(c) + F.col(w), F.col(c), F.col(w)).alias(out))
            else:
                pick = F.least if kind == "min" else F.greatest
                combined.append(pick(c, w).alias(out))
    for out, (kind, _) in totals.items():
        s = f"_s_{out}"
        summary.append(_WITHIN[kind](f"_in_{out}").alias(s))
        carry.append(_CARRY[kind](s).over(whole).alias(f"_c_{out}"))
        combined.append(F.col(f"_c_{out}").alias(out))

    # One row per (heavy key, stretch): as many as there are stretches plus heavy keys.
    edges = df.groupBy(*keys, CHUNK).agg(*summary).select(*keys, CHUNK, *carry)
    edges = F.broadcast(edges.select(*[F.col(c).alias(f"_e_{c}") for c in keys + [CHUNK]],
                                     *[c for c in edges.columns if c not in keys + [CHUNK]]))
    kept = [c for c in df.columns if c not in {POS, CHUNK, *inputs}]
    rows = df.select("*", *local)
    same = all_of([rows[k].eqNullSafe(edges[f"_e_{k}"]) for k in keys + [CHUNK]])
    return rows.join(edges, same).select(*kept, *combined)


def running(
    df: DataFrame,
    keys: list[str],
    order_by: list[Column],
    aggs: dict[str, tuple[str, str | Column]] | None = None,
    totals: dict[str, tuple[str, str | Column]] | None = None,
    inclusive: bool = True,
    heavy: DataFrame | None = COUNT_FIRST,
) -> DataFrame:
    """Add running values per key in the given total order.

    ``aggs`` maps a new column to ``(kind, column)``: ``sum``, ``count``, ``min``, ``max`` and
    ``last`` (latest non-null) run from the first row to the current one, or to the one before it
    when ``inclusive`` is off; ``lag`` and ``lead`` look at the row next to the current one.
    ``totals`` are over all rows of the key. ``order_by`` must leave no ties. ``heavy`` passes on
    the result of :func:`heavy_keys` where it is known from a cheaper frame.
    """
    aggs, totals = aggs or {}, totals or {}
    cold, hot, n_hot = split_heavy(df, keys, heavy)
    parts = []
    if cold is not None:
        parts.append(_plain(cold, keys, order_by, aggs, totals, inclusive))
    if hot is not None:
        parts.append(_chunked(hot, keys, order_by, aggs, totals, inclusive, n_hot))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def neighbours(
    df: DataFrame,
    keys: list[str],
    order_by: list[Column],
    columns: list[str],
    heavy: DataFrame | None = COUNT_FIRST,
) -> DataFrame:
    """``prev_<c>`` and ``next_<c>`` of the rows next to each row of a key."""
    row = F.struct(*columns)
    out = running(df, keys, order_by, {"_prev": ("lag", row), "_next": ("lead", row)},
                  heavy=heavy)
    return out.select(
        *df.columns,
        *[F.col("_prev")[c].alias(f"prev_{c}") for c in columns],
        *[F.col("_next")[c].alias(f"next_{c}") for c in columns],
    )


def ranked(
    df: DataFrame, keys: list[str], order_by: list[Column], rank: str, size: str | None = None
) -> DataFrame:
    """1-based position in the key's order, with the key's row count if asked for."""
    totals = {size: ("count", F.lit(1))} if size else {}
    return running(df, keys, order_by, {rank: ("count", F.lit(1))}, totals)


def _bucket(place: Column, size: Column, buckets: int) -> Column:
    """Bucket from 1 of a zero-based place among ``size`` rows."""
    base, surplus = F.floor(size / buckets), size % buckets
    bucket = F.when(place < surplus * (base + 1), F.floor(place / (base + 1))).otherwise(
        surplus + F.floor((place - surplus * (base + 1)) / F.greatest(base, F.lit(1)))
    )
    return (bucket + 1).cast("int")


def ntile(
    df: DataFrame, keys: list[str], order_by: list[Column], buckets: int, out: str,
    lead: str | None = None,
) -> DataFrame:
    """Equal-count buckets per key; the first ones take the surplus rows.

    ``lead`` names the first ordering column where it is a plain ascending one. The rows of heavy
    keys are then not sorted: its values are counted, and only rows whose value lies on both sides
    of a bucket's end are ranked.
    """
    heavy = COUNT_FIRST
    if lead is not None:
        cold, hot, _ = split_heavy(df, keys)
        if hot is not None:
            split = _ntile_by_value(hot, keys, order_by[1:], buckets, out, lead)
            return split if cold is None else _ntile_by_rank(cold, keys, order_by, buckets, out, None).unionByName(split)
        heavy = None
    return _ntile_by_rank(df, keys, order_by, buckets, out, heavy)


def _ntile_by_rank(df, keys, order_by, buckets, out, heavy):
    rows = running(df, keys, order_by, {"_rank": ("count", F.lit(1))}, {"_size": ("count", F.lit(1))}, heavy=heavy)
    return rows.select(*df.columns, _bucket(F.col("_rank") - 1, F.col("_size"), buckets).alias(out))


def _ntile_by_value(df, keys, rest, buckets, out, lead):
    freq = df.groupBy(*keys, lead).agg(F.count(F.lit(1)).alias("_n"))
    cum = running(freq, keys, [F.col(lead)], {"_upto": ("sum", "_n")}, {"_size": ("sum", "_n")})
    start = F.col("_upto") - F.col("_n")
    cum = cum.withColumns({"_first": _bucket(start, F.col("_size"), buckets),
                           "_last": _bucket(F.col("_upto") - 1, F.col("_size"), buckets)})
    parted = (F.col("_first") != F.col("_last")) | F.col(lead).isNull()
    # Per key the value at which each bucket after the first begins, and the values (fewer than
    # buckets, and null) whose rows have to be ranked.
    cuts = checkpointed(cum.groupBy(*keys).agg(
        F.array(*[F.min(F.when(F.col("_first") >= b, F.col(lead))) for b in range(2, buckets + 1)]).alias("_cuts"),
        F.collect_list(F.when(parted, F.struct(F.col(lead).alias("value"), start.alias("start")))).alias("_parted"),
        F.max("_size").alias("_size"),
    ))
    met = join_groups(df, F.broadcast(cuts), keys, "inner")
    met = met.withColumn("_part", F.get(F.filter("_parted", lambda v: v["value"].eqNullSafe(F.col(lead))), F.lit(0)))
    passed = sum((F.coalesce(F.col(lead) >= F.get("_cuts", F.lit(i)), F.lit(False)).cast("int") for i in range(buckets - 1)), F.lit(1))
    whole = met.where(F.col("_part").isNull()).select(*df.columns, passed.cast("int").alias(out))
    tied = running(met.where(F.col("_part").isNotNull()), [*keys, lead], rest, {"_rank": ("count", F.lit(1))})
    place = F.col("_part")["start"] + F.col("_rank") - 1
    return whole.unionByName(tied.select(*df.columns, _bucket(place, F.col("_size"), buckets).alias(out)))


def quantiles(
    df: DataFrame, keys: list[str], columns: dict[str, list[float]], prefix: str = "q"
) -> DataFrame:
    """Exact interpolated quantiles per key: one row per key, an array ``<prefix>_<column>`` each.

    Groups of ordinary size use the built-in ``percentile``, which keeps every distinct value of a
    group in one task. Groups above the limit take :func:`_selected`, which shuffles only the
    values near the wanted places.
    """
    cold, hot, _ = split_heavy(df, keys)
    plain = None if cold is None else cold.groupBy(*keys).agg(
        *[F.percentile(c, F.array(*map(F.lit, ps))).alias(f"{prefix}_{c}") for c, ps in columns.items()]
    )
    if hot is None:
        return plain
    picked = _selected(hot, keys, columns, prefix)
    if picked is None:
        picked = _counted(hot, keys, columns, prefix)
    return picked if plain is None else plain.unionByName(picked)


ACCURACY = 10_000
"""Of the sketches that bracket a quantile."""


def _selected(df: DataFrame, keys: list[str], columns: dict[str, list[float]], prefix: str) -> DataFrame | None:
    """Quantiles of few large groups: a sketch brackets each wanted place, one pass counts the rows
    below the bracket and another the values inside it, which are a few ten-thousandths of the rows
    besides repeats. None if a place is not inside its bracket."""
    gap = 2 / ACCURACY
    wanted = [(i, float(p)) for i, ps in enumerate(columns.values()) for p in ps]
    value = [F.col(f"_v{i}") for i in range(len(columns))]
    rows = df.select(*keys, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    brackets = checkpointed(rows.groupBy(*keys).agg(
        F.array(*[F.count(value[i]) for i, _ in wanted]).alias("_ns"),
        *[F.percentile_approx(v, [min(max(p + g, 0.0), 1.0) for k, p in wanted if k == i for g in (-gap, gap)], ACCURACY).alias(f"_b{i}")
          for i, v in enumerate(value)],
    ))
    ends, seen = [], [0] * len(columns)
    for i, p in wanted:
        low, high = (F.get(f"_b{i}", F.lit(2 * seen[i] + side)) for side in (0, 1))
        seen[i] += 1
        ends.append((value[i] < low if p > gap else F.lit(False), value[i] > high if p < 1 - gap else F.lit(False)))
    met = join_groups(rows, F.broadcast(brackets), keys, "inner")
    below = met.groupBy(*keys).agg(F.array(*[F.count(F.when(low, 1)) for low, _ in ends]).alias("_below"))
    inside = F.array(*[
        F.when(value[i].isNotNull() & ~low & ~high, F.struct(F.lit(w).alias("w"), value[i].alias("v")))
        for w, ((i, _), (low, high)) in enumerate(zip(wanted, ends))
    ])
    freq = met.select(*keys, F.explode(F.array_compact(inside)).alias("_s")).select(*keys, "_s.*").groupBy(
        *keys, "w", "v").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys, "w").orderBy("v"))
    facts = join_groups(brackets.select(*keys, "_ns"), below, keys)
    at = lambda c: F.get(c, F.col("w"))
    place = (at("_ns") - 1) * F.get(F.array(*[F.lit(p) for _, p in wanted]), F.col("w"))
    near = join_groups(freq.withColumn("_upto", upto), F.broadcast(facts), keys, "inner").select(
        *keys, "w", "v", place.alias("_place"), at("_below").alias("_under"), (F.col("_upto") + at("_below")).alias("_to"))
    found = near.groupBy(*keys, "w").agg(
        F.min(F.when(F.col("_to") > F.floor("_place"), F.col("v"))).alias("low"),
        F.min(F.when(F.col("_to") > F.ceil("_place"), F.col("v"))).alias("high"),
        F.max(F.col("_place") - F.floor("_place")).alias("part"),
        F.max(F.col("_under") <= F.floor("_place")).alias("ok"),
    ).withColumn("x", F.when(F.col("ok"), F.col("low") + (F.col("high") - F.col("low")) * F.col("part")))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("w") == w, F.col("x"))).alias(f"_x{w}") for w in range(len(wanted))])
    right = all_of([F.col(f"_x{w}").isNotNull() | (F.get("_ns", F.lit(w)) == 0) for w in range(len(wanted))])
    out, w = [], 0
    for c, ps in columns.items():
        out.append(F.array(*[F.col(f"_x{w + j}") for j in range(len(ps))]).alias(f"{prefix}_{c}"))
        w += len(ps)
    done = checkpointed(join_groups(facts, wide, keys).select(*keys, *out, right.alias("_right")))
    return done.drop("_right") if done.where(~F.col("_right")).isEmpty() else None


def _counted(df: DataFrame, keys: list[str], columns: dict[str, list[float]], prefix: str) -> DataFrame:
    """Quantiles of large groups from all values, counted, ranked by a running count and picked by position."""
    pairs = [F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value"))
             for c in columns]
    freq = (
        df.select(*keys, F.explode(F.array(*pairs)).alias("_p"))
        .select(*keys, "_p.variable", "_p.value")
        .where(F.col("value").isNotNull())
        .groupBy(*keys, "variable", "value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    cum = running(
        freq, keys + ["variable"], [F.col("value")],
        {"_upto": ("sum", "_n")}, {"_total": ("sum", "_n")},
    )

    picked = cum.groupBy(*keys).agg(
        *[
            F.array(*[_picked(p, c) for p in ps]).alias(f"{prefix}_{c}")
            for c, ps in columns.items()
        ]
    )
    # Groups without any value keep their row, with arrays of nulls as arrays.
    return join_groups(df.select(*keys).distinct(), picked, keys) if keys else picked


def _picked(p: float, variable: str) -> Column:
    place = F.when(F.col("variable") == variable, (F.col("_total") - 1) * F.lit(float(p)))
    low = F.min(F.when(F.col("_upto") > F.floor(place), F.col("value")))
    high = F.min(F.when(F.col("_upto") > F.ceil(place), F.col("value")))
    return low + (high - low) * F.max(place - F.floor(place))
