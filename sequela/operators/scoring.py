"""A published logistic score as columns: estimate, category, contributions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequela.functions.exprs import case


@dataclass(frozen=True)
class ScoreSpec:
    """Fixed values of the score: intercept, slope and centre per input, rate curve, categories."""

    intercept: float = 1.70
    terms: dict[str, tuple[float, float]] = field(
        default_factory=lambda: {
            "charlson": (-0.18, 5.0),
            "sofa": (-0.20, 8.0),
            "vasopressor": (-1.80, 0.05),
            "vent_hours": (-0.004, 138.0),
        }
    )
    rate: str = "rate"
    rate_linear: float = -3.0
    rate_square: float = 5.0
    rate_mean: float = 0.13
    category: str = "category"
    category_effects: dict[str, float] = field(
        default_factory=lambda: {
            "surgical": -0.30,
            "medical-respiratory": 0.10,
            "medical-non-respiratory": 0.20,
        }
    )
    baseline_category: str = "surgical"
    lower_risk: float = 0.80
    moderate_risk: float = 0.60


def _category_effect(s: ScoreSpec) -> Column:
    return case([(F.col(s.category) == k, F.lit(v)) for k, v in s.category_effects.items()],
                F.lit(0.0))


def _rate_effect(s: ScoreSpec, x: Column) -> Column:
    return s.rate_linear * x + s.rate_square * x * x


def contribution_columns(s: ScoreSpec) -> dict[str, Column]:
    """Each input's distance from the average subject, in log-odds."""
    out = {name: F.lit(b) * (F.col(name) - F.lit(c)) for name, (b, c) in s.terms.items()}
    out[s.category] = _category_effect(s) - F.lit(s.category_effects[s.baseline_category])
    out[s.rate] = _rate_effect(s, F.col(s.rate)) - _rate_effect(s, F.lit(s.rate_mean))
    return out


def scored(rows: DataFrame, s: ScoreSpec = ScoreSpec()) -> DataFrame:
    """Linear predictor, probability, percentage and risk category."""
    linear = F.lit(s.intercept) + _category_effect(s) + _rate_effect(s, F.col(s.rate))
    for name, (b, c) in s.terms.items():
        linear = linear + F.lit(b) * (F.col(name) - F.lit(c))
    p = 1 / (1 + F.exp(-F.col("linear_predictor")))
    return (
        rows.withColumn("linear_predictor", linear)
        .withColumn("survival_probability", p)
        .withColumns(
            {
                "survival_pct": F.col("survival_probability") * 100,
                "risk": case(
                    [
                        (F.col("survival_probability") >= s.lower_risk, F.lit("Lower Risk")),
                        (F.col("survival_probability") >= s.moderate_risk,
                         F.lit("Moderate Risk")),
                    ],
                    F.lit("Higher Risk"),
                ),
            }
        )
    )


def contributions(rows: DataFrame, keys: list[str], s: ScoreSpec = ScoreSpec()) -> DataFrame:
    """One row per subject and input."""
    parts = contribution_columns(s)
    wide = rows.select(*keys, *[e.alias(f"_c_{n}") for n, e in parts.items()])
    cells = [F.struct(F.lit(n).alias("factor"), F.lit(i + 1).alias("factor_order"),
                      F.col(f"_c_{n}").alias("contribution")) for i, n in enumerate(parts)]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("_c")).select(*keys, "_c.*")
