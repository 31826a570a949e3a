"""Joins on keys that may be very unevenly filled."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequela.functions.exprs import all_of, micros
from sequela.operators.ordered import COUNT_FIRST, heavy_keys
from sequela.session import hot_rows


BROADCAST_ROWS = 200_000
"""A counted table of at most this many (narrow) rows is broadcast."""


def lookup(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    how: str = "left",
    heavy: DataFrame | None = COUNT_FIRST,
    table_rows: int | None = None,
) -> DataFrame:
    """Join ``rows`` to ``table``, which has at most one row per key.

    Rows of heavy keys meet a broadcast of just those keys' table rows (their number is bounded,
    see :func:`heavy_keys`), and rows without a key skip the shuffle then; all others take the
    join Spark picks. Pass ``heavy`` when it is already known. A table counted beforehand
    (``table_rows``) and found small is broadcast whole, and nothing else is needed.
    """
    added = [c for c in table.columns if c not in on]
    no_key = ~all_of([F.col(k).isNotNull() for k in on])
    keyed = rows.where(~no_key)
    if table_rows is not None and table_rows <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), on, how).select(*rows.columns, *added)
    if heavy is COUNT_FIRST:
        heavy = heavy_keys(rows.select(*on), on)

    if heavy is None:
        if how == "left":
            return rows.join(table, on, "left").select(*rows.columns, *added)
        return keyed.join(table, on, how).select(*rows.columns, *added)

    hot = F.broadcast(heavy.select(*on))
    hot_table = F.broadcast(table.join(hot, on, "left_semi"))
    parts = [
        keyed.join(hot, on, "left_anti").join(table, on, how).select(*rows.columns, *added),
        keyed.join(hot, on, "left_semi").join(hot_table, on, how).select(*rows.columns, *added),
    ]
    if how == "left":
        types = dict(table.dtypes)
        parts.append(
            rows.where(no_key).select("*", *[F.lit(None).cast(types[c]).alias(c) for c in added])
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def star(rows: DataFrame, *tables: tuple[DataFrame, list[str]]) -> DataFrame:
    """Widen ``rows`` by left joins to tables that are unique on their keys.

    For rows that are themselves spread evenly over the keys (one per subject); use
    :func:`lookup` for keys that repeat.
    """
    for table, on in tables:
        rows = rows.join(table, on, "left")
    return rows


def band_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_time: str,
    right_time: str,
    lo: int,
    hi: int,
) -> DataFrame:
    """Inner join on ``on`` with ``lo <= right_time - left_time <= hi`` (microseconds).

    Time is cut into slots as wide as the band. A left row goes to the (at most two) slots its
    band touches and a right row to its own, so the join is an equi-join on key and slot and never
    compares rows far apart. A slot above the size limit on either side is salted: its rows of that
    side are spread over salts and those of the other side repeated for each.
    """
    width = hi - lo + 1
    slot = "_slot"

    first = F.floor((micros(left_time) + lo) / width)
    last = F.floor((micros(left_time) + hi) / width)
    left = left.withColumn(slot, F.explode(F.sequence(first, last)))
    right = right.withColumn(slot, F.floor(micros(right_time) / width))

    keys = on + [slot]
    heavy_right = heavy_keys(right.select(*keys), keys)
    heavy_left = heavy_keys(left.select(*keys), keys)
    salts = []
    if heavy_right is not None:
        right, left = _salted(right, left, heavy_right, keys, "_right_salt")
        salts.append("_right_salt")
    if heavy_left is not None:
        left, right = _salted(left, right, heavy_left, keys, "_left_salt")
        salts.append("_left_salt")

    gap = micros(right_time) - micros(left_time)
    return left.join(right, keys + salts).where(gap.between(lo, hi)).drop(slot, *salts)


def _salted(
    rows: DataFrame, other: DataFrame, heavy: DataFrame, keys: list[str], salt: str
) -> tuple[DataFrame, DataFrame]:
    """``rows`` of heavy keys spread over salts and ``other`` repeated for each salt of its key."""
    limit = hot_rows(rows.sparkSession)
    salts = F.broadcast(
        heavy.select(*keys, F.ceil(F.col("_n") / math.ceil(limit / 2)).cast("int").alias("_salts"))
    )
    n = F.coalesce("_salts", F.lit(1))
    spread = rows.join(salts, keys, "left").withColumn(salt, F.pmod(F.xxhash64(*rows.columns), n))
    repeated = other.join(salts, keys, "left").withColumn(
        salt, F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    )
    return spread.drop("_salts"), repeated.drop("_salts")


def in_reach(
    candidates: DataFrame,
    probes: DataFrame,
    on: list[str],
    candidate_time: str,
    probe_time: str,
    reach: int,
) -> DataFrame:
    """Candidates whose time slot lies next to some probe's, so far-away rows skip the sort."""
    width = reach + 1
    place = F.floor(micros(probe_time) / width)
    near = (
        probes.select(*on, F.explode(F.sequence(place - 1, place + 1)).alias("_slot"))
        .distinct()
    )
    return (
        candidates.withColumn("_slot", F.floor(micros(candidate_time) / width))
        .join(near, on + ["_slot"], "left_semi")
        .drop("_slot")
    )


def membership(rows: DataFrame, allowed: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key occurs in ``allowed``."""
    return rows.join(allowed.select(*on).distinct(), on, "left_semi")


def label_by(value: Column, mapping: dict[str, str], default: str) -> Column:
    """Map values through a small fixed dictionary."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(table[value], F.lit(default))
