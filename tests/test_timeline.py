"""Semantics of timelines and nearest-time matching on small literal frames."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sequela.operators import providers as P
from sequela.operators import timejoin as J
from sequela.operators import timeline as T

DAY = datetime(2024, 1, 1)
EVENTS = "event_id long, subject_id long, event_time timestamp, event_type string, source string"


def at(**delta):
    return DAY + timedelta(**delta)


def events(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


@pytest.mark.parametrize("end,flag", [
    (at(days=3, hours=1, minutes=58), 1), (at(days=3, hours=2), 0), (at(hours=2), 1),
])
def test_failure_counts_whole_hours(spark, both, end, flag):
    rows = [(1, 7, at(minutes=59), "end", "explicit"), (2, 7, end, "start", "explicit")]
    out = T.with_neighbors(events(spark, rows)).where("event_type = 'end'")
    assert out.select(T.failure_flag()).first()[0] == flag


def test_failure_needs_two_explicit_events(spark):
    rows = [(1, 7, at(hours=1), "end", "explicit"), (2, 7, at(hours=2), "start", "inferred"),
            (3, 7, at(hours=3), "start", "explicit")]
    out = T.with_neighbors(events(spark, rows)).where("event_type = 'end'")
    assert out.select(T.failure_flag()).first()[0] == 0
    only = T.with_neighbors(events(spark, rows).where("source = 'explicit'")).where("event_type = 'end'")
    assert only.select(T.failure_flag()).first()[0] == 1


def test_equal_times_follow_the_tiebreak(spark, both):
    rows = [(i, 7, at(hours=1), "end", "explicit") for i in (4, 2, 9, 5, 1)]
    out = T.with_neighbors(events(spark, rows).withColumn("copy", F.col("event_id")))
    got = [(r.event_id, r.prev_event_time is None) for r in out.orderBy("event_id").collect()]
    assert got == [(1, True), (2, False), (4, False), (5, False), (9, False)]


@pytest.mark.parametrize("minutes,kept", [(30, 0), (30.9, 0), (31, 1)])
def test_near_duplicates(spark, both, minutes, kept):
    rows = [(1, 7, at(hours=1), "end", "explicit"),
            (2, 7, at(hours=1, minutes=minutes), "end", "inferred")]
    out = T.suppress_near_duplicates(events(spark, rows))
    assert out.where("source = 'inferred'").count() == kept
    assert out.where("source = 'explicit'").count() == 1


def test_segments_that_end_together_give_one_row(spark):
    rows = [(1, 7, at(hours=9), "end", "explicit")]
    segments = spark.createDataFrame(
        [(7, at(hours=2), at(hours=9)), (7, at(hours=4), at(hours=9))],
        "subject_id long, start_time timestamp, end_time timestamp")
    out = T.episode_hours(T.with_neighbors(events(spark, rows)), segments, ["subject_id"])
    assert [r.episode_hours for r in out.collect()] == [7.0]


def test_short_segments_are_left_out(spark):
    segments = spark.createDataFrame(
        [(1, at(hours=0), at(hours=4)), (2, at(hours=0), at(hours=3, minutes=59))],
        "stay_id long, start_time timestamp, end_time timestamp")
    out = T.segments_to_events(segments, ["stay_id"]).collect()
    assert sorted((r.stay_id, r.event_type) for r in out) == [(1, "end"), (1, "start")]


def brute_nearest(events, records, reach):
    out = {}
    for k, t in set(events):
        near = [(abs(u - t), v) for kk, u, v in records
                if kk == k and v is not None and abs(u - t) < reach]
        if near:
            out[(k, t)] = min(near)[1]
    return out


@pytest.fixture(scope="module")
def records():
    rng = random.Random(3)
    ends = [(rng.choice([1, 1, 2, 3]), rng.randrange(0, 40 * 3600)) for _ in range(80)]
    notes = [(rng.choice([1, 1, 1, 2]), rng.randrange(0, 40 * 3600),
              None if rng.random() < 0.1 else rng.randrange(6)) for _ in range(300)]
    return ends, notes


def frames(spark, ends, notes):
    e = spark.createDataFrame(ends, "k long, s long").select("k", F.timestamp_seconds("s").alias("t"))
    n = spark.createDataFrame(notes, "k long, s long, v long").select(
        "k", F.timestamp_seconds("s").alias("at"), "v")
    return e, n


def test_nearest_against_brute_force(spark, both, records):
    ends, notes = records
    out = J.nearest_within(*frames(spark, ends, notes), ["k"], "t", "at", "v", 10)
    got = {(r.k, int(r.t.timestamp())): r.nearest for r in
           out.withColumn("t", F.col("t")).collect()}
    want = brute_nearest(ends, notes, 11 * 60)
    assert len(got) == len(want)
    assert sorted(got.values()) == sorted(want.values())
    seconds = {(r.k, r.s): r.nearest for r in
               out.select("k", F.unix_seconds("t").alias("s"), "nearest").collect()}
    assert seconds == want


def test_most_frequent_against_brute_force(spark, both, records):
    ends, notes = records
    out = J.most_frequent_nearby(*frames(spark, ends, notes), ["k"], "t", "at", "v", 2)
    got = {(r.k, r.s): r.most_frequent for r in
           out.select("k", F.unix_seconds("t").alias("s"), "most_frequent").collect()}
    use = {}
    for k, _, v in notes:
        if v is not None:
            use[(k, v)] = use.get((k, v), 0) + 1
    want = {}
    for k, t in set(ends):
        near = [(-use[(k, v)], v) for kk, u, v in notes
                if kk == k and v is not None and abs(u - t) < 3 * 3600]
        if near:
            want[(k, t)] = min(near)[1]
    assert got == want


def test_frequency_counts_the_whole_stay(spark):
    """Ten records far away and one nearby beat two nearby."""
    notes = [(1, 3600, 5)] + [(1, 500_000 + i, 5) for i in range(10)] + [(1, 3500, 8), (1, 3700, 8)]
    out = J.most_frequent_nearby(*frames(spark, [(1, 3600)], notes), ["k"], "t", "at", "v", 2)
    assert out.first().most_frequent == 5


def test_followups_against_brute_force(spark, both):
    rng = random.Random(8)
    rows = [(i, rng.choice([1, 1, 2]), at(minutes=rng.randrange(0, 20_000)),
             rng.choice(["start", "end"]), "explicit") for i in range(120)]
    df = events(spark, rows)
    got = {(r.subject_id, r.event_time): r.followup_time for r in T.followup_pairs(
        df.where("event_type = 'end'"), df.where("event_type = 'start'")).collect()}
    want = {}
    for _, s, t, kind, _ in rows:
        later = [u for _, s2, u, k2, _ in rows if s2 == s and k2 == "start"
                 and timedelta(hours=1) <= u - t < timedelta(hours=73)]
        if kind == "end" and later:
            want[(s, t)] = min(later)
    assert got == want


def test_cascade_names_the_tier_that_answered(spark):
    rows = spark.createDataFrame(
        [("explicit", 1, 2, 3), ("explicit", None, 2, 3), ("explicit", None, None, 3),
         ("explicit", None, None, None), ("inferred", None, 2, 3)],
        "source string, recorded long, near long, mode long")
    out = J.resolve_cascade(rows, "recorded", [J.Tier("near_30m", "near"), J.Tier("mode_2h", "mode")])
    got = [(r.provider_id, r.provider_source) for r in out.collect()]
    assert got == [(1, "recorded"), (2, "near_30m"), (3, "mode_2h"), (None, "missing"),
                   (None, "inferred_none")]


def test_leave_one_out(spark, both):
    rows = [("a", 1), ("b", 1), ("b", 0), ("c", 1), ("c", 1), ("c", 0), ("c", 0), (None, 1)]
    df = spark.createDataFrame(rows, "provider_id string, failed int")
    out = P.leave_one_out(df).collect()
    assert len(out) == len(rows)
    got = {(r.provider_id, r.failed): r.rate_loo for r in out}
    assert got[("a", 1)] is None and got[(None, 1)] is None
    assert got[("b", 1)] == 0 and got[("b", 0)] == 1
    assert got[("c", 1)] == pytest.approx(1 / 3) and got[("c", 0)] == pytest.approx(2 / 3)


def test_last_event_keeps_one_row(spark):
    rows = [(1, 7, at(hours=1), "end", "explicit", 3.0), (2, 7, at(hours=5), "end", "explicit", 0.0),
            (3, 7, at(hours=1), "end", "inferred", 2.0), (4, 8, at(hours=1), "end", "explicit", None)]
    df = spark.createDataFrame(rows, EVENTS + ", episode_hours double")
    assert [r.event_id for r in T.last_per_subject(df).collect()] == [3]


def test_rates_with_and_without_broadcast(spark, monkeypatch, both):
    rng = random.Random(2)
    rows = [(i, rng.choice(["p", "p", "q", None]), rng.choice(["u", "v"]),
             rng.choice(["explicit", "explicit", "inferred"]), rng.randrange(2)) for i in range(80)]
    df = spark.createDataFrame(
        rows, "id long, provider_id string, unit string, source string, failed int")

    def rates():
        out = P.with_fallback_rate(df, P.rate_tables(df))
        return sorted((r.id, round(r.rate, 9), r.provider_n or 0) for r in out.collect())

    small = rates()
    monkeypatch.setattr("sequela.operators.joins.BROADCAST_ROWS", -1)
    monkeypatch.setattr("sequela.operators.providers.BROADCAST_ROWS", -1)
    assert rates() == small
    explicit = [r for r in rows if r[3] == "explicit"]
    for rid, rate, _ in small:
        _, p, u, _, _ = rows[rid]
        pool = [r[4] for r in explicit if r[1] == p and r[2] == u] if p else [r[4] for r in explicit]
        assert rate == pytest.approx(sum(pool) / len(pool), abs=1e-8)
