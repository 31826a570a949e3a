import contextlib
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sequela.session import HOT_ROWS_CONF, build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """A context in which keys above ``n`` rows count as heavy."""

    @contextlib.contextmanager
    def at(n: int):
        spark.conf.set(HOT_ROWS_CONF, str(n))
        try:
            yield
        finally:
            spark.conf.unset(HOT_ROWS_CONF)

    return at


@pytest.fixture(params=["plain", "split"])
def both(request, spark):
    """Runs a test with ordinary keys and again with almost every key heavy."""
    if request.param == "split":
        spark.conf.set(HOT_ROWS_CONF, "3")
    yield request.param
    spark.conf.unset(HOT_ROWS_CONF)
