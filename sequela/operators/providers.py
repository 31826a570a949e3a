"""Provider statistics: rates, fallbacks, leave-one-out, summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequela.functions.exprs import scalars
from sequela.operators.joins import BROADCAST_ROWS, lookup
from sequela.operators.ordered import heavy_keys
from sequela.operators.timeline import EXPLICIT
from sequela.session import checkpointed


def provider_rates(
    ends: DataFrame,
    provider: str = "provider_id",
    flag: str = "failed",
    source: str = "source",
    high_volume: int = 30,
) -> DataFrame:
    """Count and mean flag over explicit events with a provider."""
    return (
        ends.where(F.col(provider).isNotNull() & (F.col(source) == EXPLICIT))
        .groupBy(provider)
        .agg(F.count(F.lit(1)).alias("provider_n"), F.avg(flag).alias("provider_rate"))
        .withColumn("is_high_volume", F.col("provider_n") >= high_volume)
    )


def provider_unit_rates(
    ends: DataFrame,
    units: DataFrame | None = None,
    unit_key: list[str] = (),
    provider: str = "provider_id",
    unit: str = "unit",
    flag: str = "failed",
    source: str = "source",
) -> DataFrame:
    """As :func:`provider_rates`, per provider and unit.

    With ``units`` (unique on ``unit_key``), the unit is looked up there; rows are summed per
    provider and unit key before that join, so no repeated key travels twice.
    """
    known = ends.where(F.col(provider).isNotNull() & (F.col(source) == EXPLICIT))
    sums = [F.count(F.lit(1)).alias("_n"), F.sum(flag).alias("_s")]
    if units is None:
        partial = known.groupBy(provider, unit).agg(*sums)
    else:
        partial = known.groupBy(provider, *unit_key).agg(*sums).join(
            units.select(*unit_key, unit), list(unit_key)
        )
    return partial.groupBy(provider, unit).agg(
        F.sum("_n").alias("provider_unit_n"),
        (F.sum("_s") / F.sum("_n")).alias("provider_unit_rate"),
    )


def overall_rate(ends: DataFrame, flag: str = "failed", source: str = "source") -> DataFrame:
    return ends.where(F.col(source) == EXPLICIT).agg(F.avg(flag).alias("overall_rate"))


@dataclass(frozen=True)
class RateTables:
    by_provider: DataFrame
    by_unit: DataFrame
    overall: DataFrame
    n_cells: int
    n_providers: int
    heavy_providers: DataFrame | None
    heavy_cells: DataFrame | None


def rate_tables(
    rows: DataFrame,
    provider: str = "provider_id",
    unit: str = "unit",
    flag: str = "failed",
    source: str = "source",
    high_volume: int = 30,
) -> RateTables:
    """Rates per provider, per provider and unit, and overall, from one pass over the rows.

    The cells (one row per provider and unit) are written once, as all three tables come from
    them. They also tell which keys are heavy, for the joins that bring the rates back.
    """
    explicit = F.col(source) == EXPLICIT
    cells = checkpointed(
        rows.groupBy(provider, unit).agg(
            F.count(F.lit(1)).alias("_rows"),
            F.count(F.when(explicit, 1)).alias("_n"),
            F.sum(F.when(explicit, F.col(flag))).alias("_s"),
        )
    )
    known = cells.where(F.col(provider).isNotNull() & (F.col("_n") > 0))
    by_unit = known.select(
        provider, unit, F.col("_n").alias("provider_unit_n"),
        (F.col("_s") / F.col("_n")).alias("provider_unit_rate"),
    )
    by_provider = known.groupBy(provider).agg(
        F.sum("_n").alias("provider_n"), (F.sum("_s") / F.sum("_n")).alias("provider_rate")
    ).withColumn("is_high_volume", F.col("provider_n") >= high_volume)
    overall = cells.agg((F.sum("_s") / F.sum("_n")).alias("overall_rate"))
    n_cells, n_providers, heavy = cells.count(), 0, [None, None]
    if n_cells > BROADCAST_ROWS:
        heavy = [heavy_keys(cells, keys, "_rows") for keys in ([provider], [provider, unit])]
        n_providers = by_provider.count()
    return RateTables(by_provider, by_unit, overall, n_cells, n_providers, *heavy)


UNITS = 64
"""A provider's units travel with it where there are no more than so many on average."""

BROADCAST_PROVIDERS = 500_000
"""So many providers with all their units are broadcast; a row with five units has about 400 bytes."""


def _with_units(rows: DataFrame, rates: RateTables, provider: str, unit: str) -> DataFrame:
    """Both rates from one join on the provider, whose row holds the rates of its units."""
    found = ["provider_unit_n", "provider_unit_rate"]
    units = rates.by_unit.where(F.col(unit).isNotNull()).groupBy(provider).agg(
        F.map_from_entries(F.collect_list(F.struct(unit, F.struct(*found)))).alias("_units"))
    table = rates.by_provider.join(units, provider, "left")
    if rates.n_providers <= BROADCAST_PROVIDERS:
        met = rows.join(F.broadcast(table), provider, "left")
    else:
        met = lookup(rows, table, [provider], heavy=rates.heavy_providers)
    cell = F.col("_units")[F.col(unit)]
    return met.select(*rows.columns, *[cell[c].alias(c) for c in found],
                      *[c for c in rates.by_provider.columns if c != provider])


def with_fallback_rate(
    rows: DataFrame,
    rates: RateTables,
    provider: str = "provider_id",
    unit: str = "unit",
    out: str = "rate",
) -> DataFrame:
    """Unit-level rate, else the provider's, else the overall one."""
    n = rates.n_cells
    if BROADCAST_ROWS < n <= UNITS * rates.n_providers:
        rows = _with_units(rows, rates, provider, unit)
    else:
        rows = lookup(rows, rates.by_unit, [provider, unit], heavy=rates.heavy_cells, table_rows=n)
        rows = lookup(rows, rates.by_provider, [provider], heavy=rates.heavy_providers, table_rows=n)
    value = scalars(rates.overall, overall_rate=F.max("overall_rate"))
    return rows.withColumn(
        out, F.coalesce("provider_unit_rate", "provider_rate", value("overall_rate"))
    )


def leave_one_out(
    rows: DataFrame,
    provider: str = "provider_id",
    flag: str = "failed",
    counted: Column | None = None,
    out: str = "rate_loo",
    n: str = "provider_n",
) -> DataFrame:
    """Mean flag over the provider's other rows; null with a single row.

    Sums per provider are joined back instead of taken over a window, so a provider's rows are
    combined before the shuffle and never sorted together. ``counted`` limits the rows that enter
    the sums.
    """
    base = rows.where(F.col(provider).isNotNull())
    if counted is not None:
        base = base.where(counted)
    sums = base.groupBy(provider).agg(
        F.count(F.lit(1)).alias(n), F.sum(F.col(flag).cast("double")).alias("_sum")
    )
    rate = F.when(
        F.col(n) > 1, (F.col("_sum") - F.col(flag).cast("double")) / (F.col(n) - F.lit(1))
    )
    return lookup(rows, sums, [provider]).withColumn(out, rate).drop("_sum")


def subject_max(rows: DataFrame, key: str | list[str], **columns: str) -> DataFrame:
    """Largest value per key, ready to be joined: ``subject_max(df, "id", top="score")``."""
    keys = [key] if isinstance(key, str) else key
    return rows.groupBy(*keys).agg(*[F.max(c).alias(out) for out, c in columns.items()])


def primary_unit(
    rows: DataFrame, provider: str = "provider_id", unit: str = "unit", out: str = "primary_unit"
) -> DataFrame:
    """The unit a provider has most rows in; the largest name wins a tie."""
    counts = rows.groupBy(provider, unit).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(provider).agg(F.max_by(unit, F.struct("_n", unit)).alias(out))


def provider_summary(
    rows: DataFrame,
    provider: str = "provider_id",
    unit: str = "unit",
    rate: str = "rate",
    volume: str = "provider_n",
    outcomes: dict[str, str] | None = None,
) -> DataFrame:
    """One row per provider: outcome means, sample size, primary unit, and the rate there.

    A rate may differ between a provider's units; the one of the primary unit is reported.
    """
    outcomes = outcomes or {}
    cells = rows.groupBy(provider, unit).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(rate).alias("_rate"),
        F.max(volume).alias("_volume"),
        *[F.sum(c).alias(f"_s_{o}") for o, c in outcomes.items()],
        *[F.count(c).alias(f"_c_{o}") for o, c in outcomes.items()],
    )
    order = F.struct("_n", unit)
    return cells.groupBy(provider).agg(
        F.max_by("_rate", order).alias("provider_rate"),
        F.max("_volume").alias("provider_n"),
        *[(F.sum(f"_s_{o}") / F.sum(f"_c_{o}")).alias(o) for o in outcomes],
        F.sum("_n").alias("n_sample"),
        F.max_by(unit, order).alias("primary_unit"),
    )
