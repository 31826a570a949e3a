"""Weighted fit of a curve that saturates: y = m (1 - exp(-k x)), per group."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequela.functions.exprs import case
from sequela.functions.tails import t_two_sided

START = (0.4, 50.0)
STEPS = [2.0**-i for i in range(11)]

NLS_SCHEMA = (
    "group string, n long, m double, m_se double, m_lo double, m_hi double, k double, "
    "k_se double, k_lo double, k_hi double, rss double, aic double, converged boolean"
)


def _t_quantile(df: int, tail: float = 0.025) -> float:
    """Upper t quantile by bisection."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > 2 * tail else (lo, mid)
    return (lo + hi) / 2


def fit_saturating(
    rows: DataFrame,
    x: str,
    y: str,
    weight: str,
    by: str | None = None,
    start: tuple[float, float] = START,
    max_iter: int = 100,
    tol: float = 1e-5,
    min_n: int = 10,
    min_range: float = 0.02,
) -> DataFrame:
    """Gauss-Newton with step halving for all groups at once.

    Each round makes two aggregates: the two-by-two normal equations per group at the current
    parameters, and the residual sums at all step lengths. Only sums per group come back. With
    ``by``, groups with fewer than ``min_n`` rows or a narrower range of ``x`` are left out.
    """
    group = F.col(by).cast("string") if by else F.lit("all")
    data = rows.select(
        group.alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"),
        F.col(weight).cast("double").alias("w"),
    ).dropna().persist()
    try:
        return _fitted(data, start, max_iter, tol, (min_n, min_range) if by else None)
    finally:
        data.unpersist()


def _fitted(
    data: DataFrame, start: tuple[float, float], max_iter: int, tol: float, least: tuple[int, float] | None
) -> DataFrame:
    """The fits of all groups ``g`` of ``x, y, w``; ``least`` is the smallest size and range of a group."""
    spark = data.sparkSession
    sizes = data.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x")).alias("range"),
        F.sum(F.log("w")).alias("log_w"),
    ).collect()
    if least:
        sizes = [s for s in sizes if s.n >= least[0] and s["range"] > least[1]]
    info = {s.g: s for s in sizes}
    params = {g: start for g in info}
    open_groups, done, failed = set(info), {}, set()

    def with_params(values: dict, schema: str) -> DataFrame:
        # One row per group still open.
        table = spark.createDataFrame([(g, *v) for g, v in values.items()], schema)
        return data.join(F.broadcast(table), "g")

    def gradient_sums(values: dict) -> dict:
        e = F.exp(-F.col("k") * F.col("x"))
        dm, dk = 1 - e, F.col("m") * F.col("x") * e
        r = F.col("y") - F.col("m") * dm
        w = F.col("w")
        found = with_params(values, "g string, m double, k double").groupBy("g").agg(
            F.sum(w * dm * dm).alias("mm"), F.sum(w * dm * dk).alias("mk"),
            F.sum(w * dk * dk).alias("kk"), F.sum(w * dm * r).alias("gm"),
            F.sum(w * dk * r).alias("gk"), F.sum(w * r * r).alias("rss"),
        ).collect()
        return {f.g: f for f in found}

    for _ in range(max_iter):
        if not open_groups:
            break
        sums = gradient_sums({g: params[g] for g in open_groups})
        steps = {}
        for g in list(open_groups):
            s = sums[g]
            a = np.array([[s.mm, s.mk], [s.mk, s.kk]])
            b = np.array([s.gm, s.gk])
            scale = np.sqrt(np.diag(a))
            if not np.all(np.isfinite(a)) or np.any(scale == 0):
                failed.add(g)
                open_groups.discard(g)
                continue
            unit = a / np.outer(scale, scale)
            if np.linalg.cond(unit) > 1e12:
                failed.add(g)
                open_groups.discard(g)
                continue
            step = np.linalg.solve(unit, b / scale) / scale
            # Share of the residual still explained by the gradient.
            explained = float(b @ step)
            rest = max(s.rss - explained, 1e-300)
            if math.sqrt(max(explained, 0.0) / 2) <= tol * math.sqrt(rest / max(info[g].n - 2, 1)):
                done[g] = (s, a)
                open_groups.discard(g)
                continue
            steps[g] = (*params[g], float(step[0]), float(step[1]), s.rss)
        if not steps:
            continue
        trial = with_params(
            {g: v[:4] for g, v in steps.items()},
            "g string, m double, k double, sm double, sk double",
        ).groupBy("g").agg(*[
            F.sum(
                F.col("w") * F.pow(
                    F.col("y") - (F.col("m") + F.lit(h) * F.col("sm"))
                    * (1 - F.exp(-(F.col("k") + F.lit(h) * F.col("sk")) * F.col("x"))), 2)
            ).alias(f"r{i}") for i, h in enumerate(STEPS)
        ]).collect()
        for t in trial:
            m, k, sm, sk, rss = steps[t.g]
            better = [h for i, h in enumerate(STEPS)
                      if t[f"r{i}"] is not None and math.isfinite(t[f"r{i}"]) and t[f"r{i}"] <= rss]
            if better:
                params[t.g] = (m + better[0] * sm, k + better[0] * sk)
            else:
                failed.add(t.g)
                open_groups.discard(t.g)
    failed |= open_groups

    out = []
    for g, s in info.items():
        if g in failed:
            out.append((g, s.n, *[None] * 10, False))
            continue
        sums, a = done[g]
        df = s.n - 2
        cov = np.linalg.inv(a) * sums.rss / df
        q = _t_quantile(df)
        cells = []
        for value, var in zip(params[g], np.diag(cov)):
            se = math.sqrt(var)
            cells += [float(value), se, float(value - q * se), float(value + q * se)]
        log_lik = 0.5 * (s.log_w - s.n * (math.log(2 * math.pi) + 1 - math.log(s.n)
                                          + math.log(sums.rss)))
        out.append((g, s.n, *cells, sums.rss, -2 * log_lik + 6, True))
    return spark.createDataFrame(out, NLS_SCHEMA)


RESAMPLED_SCHEMA = (
    "n_replicates long, n_converged long, m double, m_lo double, m_hi double, k double, k_lo double, k_hi double"
)


def poisson_weight(key: list[str], replicate: str, seed: int) -> Column:
    """How often a row enters a replicate: a Poisson(1) count drawn from a hash of key, replicate and seed."""
    draw = F.shiftrightunsigned(F.xxhash64(*key, F.col(replicate), F.lit(seed)), 11) / F.lit(float(2**53))
    upto, p, steps = 0.0, math.exp(-1), []
    for count in range(19):  # the tail beyond is below the step of the draw
        upto += p
        steps.append((draw < upto, F.lit(count)))
        p /= count + 1
    return case(steps, F.lit(19))


def resampled_saturating(
    rows: DataFrame,
    x: str,
    y: str,
    weight: str,
    key: list[str],
    replicates: int = 200,
    level: float = 0.95,
    seed: int = 11,
    max_iter: int = 100,
    tol: float = 1e-5,
) -> DataFrame:
    """Percentile intervals of both parameters over a Poisson bootstrap; one row.

    Every replicate weighs each row by a count of its own, drawn from a hash of the row's ``key``, so reruns
    and other partitionings agree; rows that share a key are drawn together. All replicates are
    fitted at once: a round makes the normal equations of every open replicate in one aggregate. Rows
    are held once and repeated for the replicates on the way into the aggregate. Replicates that
    do not converge are counted and left out; without a fit of the whole rows, all values are null.
    """
    if replicates < 1:
        raise ValueError("replicates must be at least 1")
    spark = rows.sparkSession
    data = rows.select(
        *[F.col(c).alias(f"_key{i}") for i, c in enumerate(key)],
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(weight).cast("double").alias("w"),
    ).dropna(subset=["x", "y", "w"]).persist()
    keys = [f"_key{i}" for i in range(len(key))]
    try:
        whole = _fitted(data.withColumn("g", F.lit("all")), START, max_iter, tol, None).first()
        if whole is None or not whole.converged:
            return spark.createDataFrame([(replicates, 0, *[None] * 6)], RESAMPLED_SCHEMA)
        drawn = (
            data.withColumn("_replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
            .withColumn("_times", poisson_weight(keys, "_replicate", seed))
            .where(F.col("_times") > 0)
            .select(F.col("_replicate").cast("string").alias("g"), "x", "y", (F.col("w") * F.col("_times")).alias("w"))
        )
        fits = _fitted(drawn, (whole.m, whole.k), max_iter, tol, None)
        tails = F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))
        return fits.where("converged").agg(
            F.count(F.lit(1)).alias("n"), F.percentile("m", tails).alias("m"), F.percentile("k", tails).alias("k"),
        ).select(
            F.lit(replicates).cast("long").alias("n_replicates"), F.col("n").alias("n_converged"),
            *[c for name, value in (("m", whole.m), ("k", whole.k))
              for c in (F.lit(value).alias(name), F.col(name)[0].alias(f"{name}_lo"), F.col(name)[1].alias(f"{name}_hi"))],
        )
    finally:
        data.unpersist()
