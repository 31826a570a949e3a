"""Codes, cohorts and descriptive tables on small literal frames."""

from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sequela.operators import codes as C
from sequela.operators import cohort as K
from sequela.operators import describe as D
from sequela.operators import scoring as Z
from sequela.sources import tables as S


def test_chapters(spark):
    cases = [("D10", 10, "Neoplasms"), ("D50", 10, "Blood/Immune"), ("E119", 10, "Endocrine"),
             ("H25", 10, "Ear"), ("H05", 10, "Eye"), ("0389", 9, "Infectious"),
             ("0001", 9, "OtherUnmapped"), ("V270", 9, "FactorsInfluencingHealth"),
             ("E8120", 9, "ExternalCauses"), ("43.5", 9, "OtherUnmapped"), ("5070", 9, "Respiratory"),
             ("D10", None, None), ("D10", 11, None), ("410", 10, None)]
    df = spark.createDataFrame(cases, "code string, version int, want string")
    for r in df.withColumn("got", C.code_chapter("code", "version")).collect():
        assert r.got == r.want, r


def test_chapter_ranges_cover_every_category(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("code"),
                                  F.lit(9).alias("version"))
    out = df.groupBy(C.code_chapter("code", "version").alias("c")).count()
    got = {r.c: r["count"] for r in out.collect()}
    assert got.pop("OtherUnmapped") == 1
    assert sum(got.values()) == 999


def test_code_text(spark):
    cells = ["['A','B']", '["A", "B"]', "A, B", "A B", "[]", "[ ]", "", None, "[ 'A0' ]"]
    df = spark.createDataFrame([(c,) for c in cells], "t string")
    got = [r[0] for r in df.select(C.parse_code_text("t")).collect()]
    assert got == [["A", "B"]] * 4 + [[]] * 4 + [["A0"]]


def test_flags_are_zero_without_codes(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "subject_id long")
    long = spark.createDataFrame([(1, "X"), (1, "X"), (2, "Y"), (2, "Z")], "subject_id long, code string")
    out = C.code_flags(rows, long, ["X", "Y"]).orderBy("subject_id").collect()
    assert [(r.code_X, r.code_Y) for r in out] == [(1, 0), (0, 1), (0, 0)]


def test_denominators(spark):
    long = spark.createDataFrame([(1, "X"), (2, "X"), (2, "Y"), (9, "Y")], "subject_id long, code string")
    cohort = spark.createDataFrame([(i,) for i in range(1, 5)], "subject_id long")
    coded = {r.code: r.prevalence for r in C.code_prevalence(long).collect()}
    assert coded == {"X": pytest.approx(2 / 3), "Y": pytest.approx(2 / 3)}
    whole = {r.code: r.prevalence
             for r in C.code_prevalence(long, cohort=cohort, denominator="cohort").collect()}
    assert whole == {"X": 0.5, "Y": 0.25}
    assert C.select_codes(C.code_prevalence(long), 0.5, ["Y"]) == ["X"]


def test_classification(spark):
    ev = spark.createDataFrame(
        [(1, datetime(2024, 1, 2, 0), 5.0), (2, datetime(2024, 1, 2, 0), 13.0),
         (3, datetime(2024, 1, 2, 0), None), (4, datetime(2024, 1, 2, 0), 1.0)],
        "hadm_id long, event_time timestamp, episode_hours double")
    surgery = spark.createDataFrame(
        [(i, datetime(2024, 1, 2, 0)) for i in (1, 2, 3)], "hadm_id long, surgery_time timestamp")
    resp = spark.createDataFrame([(2, 3)], "hadm_id long, respiratory_count long")
    got = {r.hadm_id: r.category for r in C.classify_by_codes(ev, surgery, resp, "hadm_id").collect()}
    assert got == {1: "surgical", 2: "medical-respiratory", 3: "surgical",
                   4: "medical-non-respiratory"}


def test_outcomes(spark):
    df = spark.createDataFrame(
        [(None, 0), (date(2024, 1, 4), 1), (date(2024, 1, 4), 0), (date(2024, 3, 1), 1)],
        "death_date date, expired int").withColumn("event_time", F.lit(datetime(2024, 1, 1, 20)))
    got = [(r.died, r.days_to_death, r.died_early, r.likely_comfort) for r in K.outcomes(df).collect()]
    assert got == [(0, None, 0, False), (1, 3, 1, True), (1, 3, 1, False), (1, 60, 0, False)]


def test_strata(spark, both):
    x = [0, 0, 0, 1, 2, 3, 4, 10]
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = [r.s for r in K.zero_aware_strata(df, "x", "s").orderBy("x").collect()]
    assert got == ["0%"] * 3 + [">0–median"] * 3 + ["median–Q75", ">Q75"]
    cuts = np.quantile(x, [0.25, 0.5, 0.75])
    got = [r.s[:2] for r in K.quantile_strata(df, "x", "s").orderBy("x").collect()]
    assert got == [f"Q{1 + int((v > cuts).sum())}" for v in x]


def test_flow_excludes_rows_with_unknown_conditions(spark):
    df = spark.createDataFrame(
        [(1, "a", 5), (2, "a", None), (3, "b", 1), (4, None, 9)],
        "subject_id long, provider_id string, v int")
    out = K.cohort_flow(df, {"all": F.lit(True), "large": F.col("v") > 2})
    got = [(r.stage, r.n_rows, r.n_subjects, r.n_providers, r.n_excluded)
           for r in out.orderBy("stage_no").collect()]
    assert got == [("all", 4, 4, 2, 0), ("large", 2, 2, 1, 2)]


def test_chi_square_and_anova(spark):
    rows = [("a", "x", 1.0), ("a", "x", 2.0), ("a", "y", 4.0), ("b", "y", 3.0), ("b", "y", 5.0),
            ("b", "x", 9.0), ("b", "y", 6.0)]
    df = spark.createDataFrame(rows, "s string, c string, v double")
    plain = D.table_one_categorical(df, ["c"], "s", correct=False).first()
    table = np.array([[2, 1], [1, 3]])
    expected = np.outer(table.sum(1), table.sum(0)) / table.sum()
    assert plain.statistic == pytest.approx(((table - expected) ** 2 / expected).sum())
    yates = D.table_one_categorical(df, ["c"], "s").first()
    assert yates.statistic == pytest.approx(
        ((np.abs(table - expected) - np.minimum(0.5, np.abs(table - expected))) ** 2 / expected).sum())
    cont = D.table_one_continuous(df, ["v"], "s").first()
    a, b = (np.array([v for s, _, v in rows if s == k]) for k in "ab")
    smd = abs(a.mean() - b.mean()) / np.sqrt((a.var(ddof=1) + b.var(ddof=1)) / 2)
    grand = np.concatenate([a, b]).mean()
    between = len(a) * (a.mean() - grand) ** 2 + len(b) * (b.mean() - grand) ** 2
    within = a.var(ddof=1) * (len(a) - 1) + b.var(ddof=1) * (len(b) - 1)
    assert cont.smd == pytest.approx(smd)
    assert cont.statistic == pytest.approx(between / (within / 5))


def test_score(spark):
    df = spark.createDataFrame([(5.0, 8.0, 0.0, 96.0, 0.13, "surgical")],
                               "charlson double, sofa double, vasopressor double, "
                               "vent_hours double, rate double, category string")
    lp = 1.70 - 0.30 + 1.80 * 0.05 + 0.004 * 42 - 3 * 0.13 + 5 * 0.13**2
    r = Z.scored(df).first()
    assert r.linear_predictor == pytest.approx(lp)
    assert r.survival_probability == pytest.approx(1 / (1 + np.exp(-lp)))
    parts = {c.factor: c.contribution for c in Z.contributions(df, []).collect()}
    assert parts["rate"] == pytest.approx(0) and parts["category"] == pytest.approx(0)
    assert parts["vent_hours"] == pytest.approx(0.168)


def test_csv_round_trip_with_levels(spark, tmp_path):
    df = spark.createDataFrame(
        [("1", "b", date(2024, 1, 1), 1.5), ("2", "a", None, 2.0), ("3", "z", None, None)],
        "id string, f string, d date, x double")
    S.write_csv(df, str(tmp_path / "t"))
    back = S.read_typed_csv(spark, str(tmp_path / "t"), df.schema, levels={"f": ["a", "b"]})
    got = sorted((r.id, r.f, r.f_level, r.d, r.x) for r in back.collect())
    assert got == [("1", "b", 2, date(2024, 1, 1), 1.5), ("2", "a", 1, None, 2.0),
                   ("3", None, None, None, None)]
    narrow = S.read_typed_csv(spark, str(tmp_path / "t"), df.schema, ["id"])
    assert narrow.columns == ["id"] and narrow.count() == 3


def test_stage_and_report(spark, tmp_path):
    df = spark.createDataFrame([("u", 1), ("v", 2)], "unit string, n long")
    staged = S.stage(df, str(tmp_path / "s"))
    assert sorted(staged.collect()) == sorted(df.collect())
    assert sorted(S.stage(df).collect()) == sorted(df.collect())
    total = df.agg(F.sum("n").alias("n"))
    report = S.build_report(spark, cohort=total, units=S.keyed_map(staged, "unit", ["n"]))
    assert report.first()[0] == '{"cohort":{"n":3},"units":{"u":{"n":1},"v":{"n":2}}}'
    S.write_report(report, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == 1
