"""Cohort construction: outcomes, nested filters, strata, flow counts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequela.functions.exprs import all_of, case, col, join_groups, scalars
from sequela.operators.ordered import quantiles
from sequela.operators.timeline import EXPLICIT
from sequela.session import staged


def plausible(
    rows: DataFrame,
    hours: str = "total_hours",
    dose: str = "dose",
    count: str = "n_failures_lifetime",
    min_hours: float = 1,
    max_hours: float = 1000,
    max_dose: float = 1,
    max_count: int = 10,
) -> DataFrame:
    """Rows with plausible ranges; a null in any of them fails."""
    return rows.where(
        (F.col(hours) > min_hours) & (F.col(hours) < max_hours)
        & (F.col(dose) < max_dose) & (F.col(count) < max_count)
    )


def complete_cases(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.dropna(subset=columns)


def outcomes(
    rows: DataFrame,
    death: str = "death_date",
    event: str = "event_time",
    expired: str = "expired",
    early_days: int = 30,
    comfort_days: int = 3,
) -> DataFrame:
    """Survival, mortality, days to death, early death, and likely comfort care."""
    days = F.datediff(F.col(death).cast("date"), F.col(event).cast("date"))
    dead = F.col(death).isNotNull()
    return rows.withColumns(
        {
            "survived": ~dead,
            "died": dead.cast("int"),
            "days_to_death": days,
            "died_early": F.coalesce((days <= early_days) & dead, F.lit(False)).cast("int"),
            "likely_comfort": F.coalesce(
                (F.col(expired) == 1) & dead & (days <= comfort_days), F.lit(False)
            ),
        }
    )


@dataclass(frozen=True)
class CohortSpec:
    """The nested cohorts of a study, widest first."""

    required: tuple[str, ...]
    units: tuple[str, ...]
    unit_groups: dict[str, tuple[str, ...]] = field(default_factory=dict)
    min_provider_n: int = 20
    min_unit_n: int = 20
    source: str = "source"
    unit: str = "unit"
    provider_n: str = "provider_n"
    unit_n: str = "provider_unit_n"
    other: str = "Other"

    def complete(self) -> Column:
        return all_of([F.col(c).isNotNull() for c in self.required])

    def explicit(self) -> Column:
        return F.col(self.source) == EXPLICIT

    def volume(self) -> Column:
        return (
            F.col(self.unit_n).isNotNull()
            & (F.col(self.provider_n) >= self.min_provider_n)
            & F.col(self.unit).isin(*self.units)
        )

    def unit_volume(self) -> Column:
        return F.col(self.unit_n) >= self.min_unit_n

    def group(self) -> Column:
        return case(
            [(F.col(self.unit).isin(*units), F.lit(g)) for g, units in self.unit_groups.items()],
            F.lit(self.other),
        )

    def stages(self) -> dict[str, Column]:
        """Name to condition; each stage also needs all before it."""
        return {
            "all": F.lit(True),
            "complete": self.complete(),
            "explicit": self.explicit(),
            "volume": self.volume(),
            "unit_volume": self.unit_volume(),
            "grouped": self.group() != self.other,
        }


def patient_cohort(rows: DataFrame, spec: CohortSpec) -> DataFrame:
    return rows.where(spec.complete())


def explicit_cohort(rows: DataFrame, spec: CohortSpec) -> DataFrame:
    return rows.where(spec.complete() & spec.explicit() & spec.volume())


def analysis_base(rows: DataFrame, spec: CohortSpec) -> DataFrame:
    """Explicit cohort with enough volume in the unit, and the unit group."""
    return explicit_cohort(rows, spec).where(spec.unit_volume()).withColumn(
        "unit_group", spec.group()
    )


def short_label(unit: str, rules: list[tuple[str, str]]) -> Column:
    """Label of the first rule whose text the unit name contains, else the name."""
    return case([(F.col(unit).contains(t), F.lit(label)) for t, label in rules], F.col(unit))


def centred_scaled(rows: DataFrame, columns: list[str], population_sd: bool = False) -> DataFrame:
    """``<c>_centered`` and ``<c>_scaled`` over the whole frame, from one scalar subquery."""
    sd = F.stddev_pop if population_sd else F.stddev_samp
    value = scalars(
        rows, **{f"m_{c}": F.avg(c) for c in columns}, **{f"s_{c}": sd(c) for c in columns}
    )
    new = {}
    for c in columns:
        new[f"{c}_centered"] = F.col(c) - value(f"m_{c}")
        new[f"{c}_scaled"] = (F.col(c) - value(f"m_{c}")) / F.nullif(value(f"s_{c}"), F.lit(0.0))
    return rows.withColumns(new)


# Volume tiers with their display labels.
VOLUME_TIERS = [(20, "1 – Low (<20)"), (50, "2 – Medium (20–49)"), (100, "3 – High (50–99)")]
TOP_TIER = "4 – Very High (100+)"


def volume_tier(
    n: str, tiers: list[tuple[int, str]] = VOLUME_TIERS, top: str = TOP_TIER
) -> Column:
    return case([(F.col(n) < limit, F.lit(label)) for limit, label in tiers], F.lit(top))


def outcome_label(survived: str, yes: str = "Survived 12 mo", no: str = "Did Not Survive") -> Column:
    return F.when(F.col(survived), yes).otherwise(no)


# Display labels of the admission categories.
CATEGORY_LABELS = {
    "surgical": "Surgical",
    "medical-respiratory": "Medical – Respiratory",
    "medical-non-respiratory": "Medical – Non-Respiratory",
}


def category_label(category: str, labels: dict[str, str] = CATEGORY_LABELS) -> Column:
    return case([(F.col(category) == k, F.lit(v)) for k, v in labels.items()], F.col(category))


def _cuts(rows: DataFrame, column: str, probs: list[float]):
    table = quantiles(rows, [], {column: probs}, prefix="q")
    value = scalars(table, q=F.first(f"q_{column}"))
    return [value("q")[i] for i in range(len(probs))]


def quantile_strata(
    rows: DataFrame,
    column: str,
    out: str,
    labels: tuple[str, ...] = ("Q1 (lowest)", "Q2", "Q3", "Q4 (highest)"),
) -> DataFrame:
    """Strata cut at equally spaced quantiles; a value on a cut belongs below it."""
    k = len(labels)
    cuts = _cuts(rows, column, [i / k for i in range(1, k)])
    x = F.col(column)
    return rows.withColumn(
        out, case([(x <= c, F.lit(label)) for c, label in zip(cuts, labels)], F.lit(labels[-1]))
    )


def zero_aware_strata(
    rows: DataFrame,
    column: str,
    out: str,
    labels: tuple[str, str, str, str] = ("0%", ">0–median", "median–Q75", ">Q75"),
) -> DataFrame:
    """Exact zeros apart; the rest cut at the median and upper quartile of the non-zero values."""
    x = F.col(column)
    median, upper = _cuts(rows.where(x > 0), column, [0.5, 0.75])
    return rows.withColumn(
        out,
        case(
            [(x == 0, F.lit(labels[0])), (x <= median, F.lit(labels[1])),
             (x <= upper, F.lit(labels[2]))],
            F.lit(labels[3]),
        ),
    )


def cohort_flow(
    rows: DataFrame,
    stages: dict[str, Column],
    subject: str = "subject_id",
    provider: str = "provider_id",
    by: list[str] = (),
) -> DataFrame:
    """Rows, subjects and providers left after each stage, and rows lost at it; one pass over ``rows``."""
    names = list(stages)
    reached, so_far = {}, F.lit(True)
    for i, (name, condition) in enumerate(stages.items()):
        so_far = so_far & F.coalesce(condition, F.lit(False))
        reached[name] = so_far
    # Distinct pairs are formed once with the furthest stage they reach.
    depth = sum((F.when(c, 1).otherwise(0) for c in reached.values()), F.lit(0))
    marked = staged(rows.select(*by, subject, provider, depth.cast("byte").alias("_depth")), "cohort-flow")
    counts = marked.groupBy(*by).agg(
        *[F.count(F.when(F.col("_depth") > i, 1)).alias(f"rows_{i}") for i in range(len(names))]
    )

    def distinct(key: str, label: str) -> DataFrame:
        deepest = marked.where(F.col(key).isNotNull()).groupBy(*by, key).agg(
            F.max("_depth").alias("_depth")
        )
        return deepest.groupBy(*by).agg(
            *[F.count(F.when(F.col("_depth") > i, 1)).alias(f"{label}_{i}")
              for i in range(len(names))]
        )

    long = []
    for i in range(len(names)):
        long.append(
            F.struct(
                F.lit(i).alias("stage_no"), F.lit(names[i]).alias("stage"),
                F.col(f"rows_{i}").alias("n_rows"),
                F.coalesce(f"subjects_{i}", F.lit(0)).alias("n_subjects"),
                F.coalesce(f"providers_{i}", F.lit(0)).alias("n_providers"),
                (F.col(f"rows_{max(i - 1, 0)}") - F.col(f"rows_{i}")).alias("n_excluded"),
            )
        )
    subjects, providers = distinct(subject, "subjects"), distinct(provider, "providers")
    if by:
        wide = join_groups(join_groups(counts, subjects, list(by)), providers, list(by))
    else:
        key = F.lit(0).alias("_k")
        wide = counts.select("*", key).join(subjects.select("*", key), "_k", "left").join(
            providers.select("*", key), "_k", "left"
        )
    return wide.select(*by, F.explode(F.array(*long)).alias("_s")).select(*by, "_s.*")


def failure_count_checks(
    rows: DataFrame,
    count: str = "n_failures_lifetime",
    rate: str = "rate",
    low_rate: float = 0.05,
) -> DataFrame:
    """Shares that tell whether a count is per lifetime or per event; one row."""
    c, r = col(count), col(rate)
    several = c > 1
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(c).alias("n_failures"),
        F.avg((c > 0).cast("double")).alias("share_any"),
        F.avg(several.cast("double")).alias("share_several"),
        F.avg(c).alias("mean_count"),
        F.avg(r).alias("mean_rate"),
        F.avg((r == 0).cast("double")).alias("share_zero_rate"),
        F.count(F.when(several, 1)).alias("n_several"),
        F.avg(F.when(several, r)).alias("mean_rate_several"),
        F.avg(F.when(several, (r < low_rate).cast("double"))).alias("share_low_rate_several"),
        F.avg(F.when(c > 0, r)).alias("mean_rate_any"),
        F.avg(F.when(c == 0, r)).alias("mean_rate_none"),
    )


def means_by(rows: DataFrame, key: list[str | Column], columns: list[str]) -> DataFrame:
    """Count and means per key."""
    return rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns]
    )
