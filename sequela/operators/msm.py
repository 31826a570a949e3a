"""Marginal structural model of a continuous treatment, per unit group."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequela.operators.linmod import balance, density_weights, dummies, effective_n, nonconstant
from sequela.operators.logit import LogitFit, fit_logit
from sequela.operators.ordered import quantiles


@dataclass(frozen=True)
class MsmSpec:
    treatment: str
    outcome: str
    covariates: tuple[str, ...]
    flags: tuple[str, ...] = ()
    secondary: tuple[str, ...] = ()
    balance_on: tuple[str, ...] = ()
    provider: str = "provider_id"
    unit: str = "unit"
    min_providers: int = 20
    delta: float = 0.05
    trim: tuple[float | None, float | None] = (None, 0.99)


@dataclass(frozen=True)
class MsmResult:
    group: str
    summary: dict
    effects: list[dict] = field(default_factory=list)
    balance: list[dict] = field(default_factory=list)
    fit: LogitFit | None = None


RESULT_SCHEMA = (
    "group string, outcome string, n long, n_providers long, eff_n double, rate_mean double, "
    "rate_median double, rate_iqr double, pct_zero double, r2_denominator double, coef double, "
    "covariance string, odds_ratio double, lo double, hi double, p double"
)
BALANCE_SCHEMA = "group string, covariate string, r_unweighted double, r_weighted double"


def run_group(
    base: DataFrame, group: str, units: list[str], spec: MsmSpec, exclude: Column | None = None
) -> MsmResult | None:
    """Weights, balance and outcome models of one group; None with too few providers."""
    rows = base.where(F.col(spec.unit).isin(list(units)))
    if exclude is not None:
        rows = rows.where(~F.coalesce(exclude, F.lit(False)))
    used = [spec.treatment, spec.outcome, *spec.covariates, *spec.flags, *spec.secondary,
            *spec.balance_on, spec.provider, spec.unit]
    complete = [spec.treatment, *spec.covariates]
    rows = rows.select(*dict.fromkeys(used)).dropna(subset=complete).persist()
    try:
        t = F.col(spec.treatment)
        s = rows.agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct(spec.provider).alias("n_providers"),
            F.avg(t).alias("mean"), F.avg((t == 0).cast("double") * 100).alias("zero"),
        ).first()
        if s.n_providers < spec.min_providers:
            return None
        q = quantiles(rows, [], {spec.treatment: [0.25, 0.5, 0.75]}).first()[0]
        covariates = list(spec.covariates) + nonconstant(rows, list(spec.flags))
        unit_terms: list[str] = []
        if len(units) > 1:
            rows_d, unit_terms = dummies(rows, spec.unit, list(units))
        else:
            rows_d = rows
        unit_terms = nonconstant(rows_d, unit_terms)
        weights = density_weights(
            rows_d, spec.treatment, covariates + unit_terms, spec.trim
        )
        weighted = weights.rows.persist()
        eff = weighted.agg(effective_n("sw").alias("e")).first().e
        summary = {
            "n": s.n, "n_providers": s.n_providers, "eff_n": eff, "rate_mean": s["mean"],
            "rate_median": q[1], "rate_iqr": q[2] - q[0], "pct_zero": s.zero,
            "r2_denominator": weights.r2_denominator,
        }
        bal = [
            r.asDict()
            for r in balance(weighted, spec.treatment,
                             list(spec.balance_on or spec.covariates), "sw").collect()
        ]
        effects, main = [], None
        for outcome in (spec.outcome, *spec.secondary):
            fit = fit_logit(
                weighted, outcome, [spec.treatment, *unit_terms], "sw", spec.provider,
                ("hc3", "cluster") if main is None else ("cluster",),
            )
            main = main or fit
            for kind in fit.cov:
                effects.append({
                    "outcome": outcome, "covariance": kind,
                    "coef": float(fit.coef[1]),
                    **fit.effect(spec.treatment, kind, spec.delta),
                })
        weighted.unpersist()
        return MsmResult(group, summary, effects, bal, main)
    finally:
        rows.unpersist()


def run_groups(
    base: DataFrame, groups: dict[str, list[str]], spec: MsmSpec, exclude: Column | None = None
) -> list[MsmResult]:
    found = [run_group(base, g, units, spec, exclude) for g, units in groups.items()]
    return [r for r in found if r is not None]


def results_table(spark, results: list[MsmResult]) -> DataFrame:
    rows = []
    for r in results:
        s = r.summary
        for e in r.effects:
            rows.append((
                r.group, e["outcome"], s["n"], s["n_providers"], s["eff_n"], s["rate_mean"],
                s["rate_median"], s["rate_iqr"], s["pct_zero"], s["r2_denominator"], e["coef"],
                e["covariance"], e["or"], e["lo"], e["hi"], e["p"],
            ))
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def balance_table(spark, results: list[MsmResult]) -> DataFrame:
    rows = [(r.group, b["covariate"], b["r_unweighted"], b["r_weighted"])
            for r in results for b in r.balance]
    return spark.createDataFrame(rows, BALANCE_SCHEMA)
