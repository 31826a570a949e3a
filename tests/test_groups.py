"""Null groups keep their row, and large offsets cost no digits."""

import numpy as np
from pyspark.sql import functions as F

from sequela.operators import describe as D
from sequela.operators import dml


def test_null_and_empty_groups_stay(spark, both):
    rows = spark.createDataFrame([("a", 1.0)] * 5 + [(None, 2.0)] * 4 + [("b", None)] * 4, "unit string, x double")
    assert {r.unit: (r.n, r.median) for r in D.summary(rows, ["unit"], "x").collect()} == {"a": (5, 1.0), None: (4, 2.0), "b": (0, None)}
    assert {r.unit for r in D.unit_profile(rows, "unit", ["x"], ["x"], ["x"]).collect()} == {"a", "b", None}


def test_variance_analysis_on_an_offset(spark):
    def run(offset):
        rows = spark.range(20_000).select(
            (F.col("id") % 2).cast("string").alias("s"),
            (F.lit(offset) + (F.col("id") % 2) * 0.1 + F.pmod(F.hash("id"), F.lit(1000)) / 1000.0).alias("x"))
        return D.table_one_continuous(rows, ["x"], "s").first().statistic

    assert abs(run(1e9) / run(0.0) - 1) < 1e-3


def test_standard_error_beside_a_large_effect(spark):
    rng = np.random.default_rng(0)
    d = rng.normal(size=4000)
    noise = 1e-6 * rng.normal(size=4000)
    res = spark.createDataFrame([(float(5 * a + b), float(a)) for a, b in zip(d, noise)], "y_res double, d_res double")
    got = dml.theta(res).first()
    y = 5 * d + noise
    t = (d * y).sum() / (d * d).sum()
    assert np.isclose(got.se, np.sqrt(((d * (y - t * d)) ** 2).sum()) / (d * d).sum(), rtol=1e-3)
