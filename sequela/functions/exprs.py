"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_MINUTE = 60_000_000
MICROS_PER_HOUR = 3_600_000_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c: str | Column) -> Column:
    return F.unix_micros(col(c))


def hours_between(start: str | Column, end: str | Column) -> Column:
    """Elapsed hours as a double; negative when ``end`` comes first."""
    return (micros(end) - micros(start)) / F.lit(float(MICROS_PER_HOUR))


def whole_hours_between(start: str | Column, end: str | Column) -> Column:
    """Completed hours, truncated towards zero: 72 h 59 min counts as 72."""
    return F.timestamp_diff("HOUR", col(start), col(end))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def case(pairs: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """First matching branch of ``(condition, value)`` pairs."""
    expr = F
    for condition, value in pairs:
        expr = expr.when(condition, value)
    return expr if otherwise is None else expr.otherwise(otherwise)


def scalars(df: DataFrame, **aggs: Column):
    """One-row aggregates of ``df``, usable as columns of any other frame.

    Returns a function from name to column. The aggregates run once as a scalar subquery, so no
    one-row cross join is planned.
    """
    row = df.agg(F.struct(*[a.alias(n) for n, a in aggs.items()]).alias("row")).scalar()
    return lambda name: row.getField(name)


def r6(c: str | Column) -> Column:
    return F.round(col(c), 6)


def join_groups(left: DataFrame, right: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """Join two tables of groups on their keys; a null key is a group like any other."""
    if not by:
        return left.join(right)
    named = right.select(*[F.col(c).alias(f"_j_{c}") for c in by], *[c for c in right.columns if c not in by])
    same = all_of([F.col(c).eqNullSafe(F.col(f"_j_{c}")) for c in by])
    return left.join(named, same, how).drop(*[f"_j_{c}" for c in by])
