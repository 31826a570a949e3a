"""Named queries against their SQL in DuckDB, on the smallest tables.

A fast selection by default; all of them with SEQUELA_ALL=1.
"""

import math
import os

import duckdb
import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
FAST = """
label_events segments_to_events suppress_near_duplicates with_neighbors episode_hours failure_flag
followup_pairs last_per_subject nearest_within leave_one_out fallback_rate band_join_pairs
lookback_measure event_slopes crosswalk code_chapters classify_by_codes code_arrays code_flags
prevalence_range parse_code_text outcomes cohort_flow quantile_strata quartiles_within provider_summary
box_stats histogram_equal table_one_categorical partial_correlation score_quality roc_curve
risk_score last_event_per_subject typed_csv
""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


def cell(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def names():
    wanted = list(__spark_entry__.oracle_sql()) if os.environ.get("SEQUELA_ALL") else FAST
    return [n for n in wanted if n in __spark_entry__.oracle_sql()]


@pytest.mark.parametrize("name", names())
def test_query_matches_sql(spark, sql, name):
    got = __spark_entry__.queries()[name](spark, FOLDER)
    want = sql.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert table(got.columns, got.collect()) == table(columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["with_neighbors", "nearest_within", "most_frequent_nearby",
                                  "quartiles_within", "cohort_flow", "group_summary"])
def test_heavy_keys_give_the_same_rows(spark, hot, name):
    query = __spark_entry__.queries()[name]
    want = table(*(lambda d: (d.columns, d.collect()))(query(spark, FOLDER)))
    with hot(10):
        got = table(*(lambda d: (d.columns, d.collect()))(query(spark, FOLDER)))
    assert got == want
