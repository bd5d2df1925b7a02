"""Metric queries read all points: a point on either side of any day reaches its result."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from pulsegrid.plans.operations_queries import QUERIES
from tools.check_oracle import connect, rows_of

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not there")
FEATURE = [name for name in QUERIES if name.startswith("metric_series_lookback")] + ["scan_logs"]      # a lookback is what these show
NAMES = sorted(name for name, query in QUERIES.items() if name not in FEATURE and query.sql and "FROM points" in query.sql)


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_the_twins_have_no_bound_in_time():
    bound = [name for name in NAMES if "TIMESTAMP '" in QUERIES[name].sql]
    assert len(NAMES) > 30 and not bound


@pytest.mark.parametrize("name", NAMES)
def test_all_points_are_read(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    result = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in result.description], result.fetchall())
