"""Every registered query beside its SQL twin, on whole tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from pulsegrid.plans.registry import QUERIES
from tools.check_oracle import TABLES, rows_of

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not there")

# Nodes that pair all rows, leave the JVM, or sort everything for a limit.
UNWANTED = ["CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "InPandas", "GlobalLimit"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in UNWANTED if node in plan]
    got = rows_of(df.columns, df.collect())
    result = con.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in result.description], result.fetchall())
    assert got == want


def test_flagship_runs(spark):
    assert entry.entry(spark).count() == 15


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql())


def test_entry_works_without_the_corpus_operators():
    """The subpackage and its pipeline are optional; nothing else may be passed over."""
    code = ("import sys; sys.modules[sys.argv[1]] = None; import __spark_entry__ as e; "
            "names = set(e.queries()); print(len(names), any(n.startswith(('op', 'pipeline')) for n in names))")
    for gone in ("pulsegrid.llm", "pulsegrid.llm.queries", "corpus_pipeline"):
        out = subprocess.run([sys.executable, "-c", code, gone], cwd=Path(entry.__file__).parent, capture_output=True, text=True, check=True)
        assert out.stdout.split() == [str(len(QUERIES)), "False"]
    broken = subprocess.run([sys.executable, "-c", code, "pulsegrid.operators.logs"], cwd=Path(entry.__file__).parent, capture_output=True, text=True)
    assert broken.returncode != 0


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name, table, scans", [
    ("top_traders_by_volume", "lineitem", 1),  # the list is used twice, computed once
    ("recent_perps", "lineitem", 1),
    ("most_active_users", "events", 1),
    ("time_to_trade", "events", 1),
    ("cohort_retention", "events", 1),
    ("notification_kpis", "events", 1),
    ("feature_engagement", "events", 1),
    ("service_memory", "events", 1),
    ("top_error_messages", "events", 1),
    ("service_health", "events", 1),
])
def test_large_tables_are_read_once(spark, name, table, scans):
    plan = final_plan(entry.queries()[name](spark, SF_DIR))
    assert sum(f"/{table}.parquet" in line for line in plan.splitlines() if "FileScan" in line) == scans


@pytest.mark.parametrize("name", ["feature_engagement", "funnel_trade", "wau_mau", "dau_by_platform", "platform_kpis"])
def test_distinct_counts_do_not_multiply_rows(spark, name):
    assert "Expand" not in final_plan(entry.queries()[name](spark, SF_DIR))


LISTS = ["top_traders_by_volume", "top_traders_by_count", "most_active_users", "time_spent_leaderboard", "top_tappers", "recent_swaps", "recent_perps",
         "recent_deposits", "user_profile"]


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", LISTS)
def test_lists_leave_the_users_where_they_are(spark, no_broadcast, name):
    """The wallets meet the broadcast list before any owner is chosen: no exchange or sort carries the user table."""
    plan = final_plan(QUERIES[name].frame(spark, SF_DIR)).splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*|"))
    scan = next(i for i, line in enumerate(plan) if "FileScan" in line and "/customer.parquet" in line)
    above, level = [], depth(plan[scan])
    for line in reversed(plan[:scan]):
        if depth(line) < level:
            above.append(line)
            level = depth(line)
    first = next(i for i, line in enumerate(above) if any(x in line for x in ("Exchange", "Sort", "Aggregate", "Join")))
    assert "BroadcastHashJoin" in above[first]


# Shuffles by key that a query may need when nothing is broadcast: one per aggregation (two for distinct counts) or join side.
HASH_SHUFFLES = {"dau": 2, "wau_mau": 1, "events_by_hour": 2, "top_error_messages": 1, "error_banner": 1, "swap_http_errors": 1, "api_health": 1,
                 "service_health": 2, "leverage_histogram": 2, "cdn_health": 1, "metric_series": 1, "feature_engagement": 2}


@pytest.mark.parametrize("name", sorted(HASH_SHUFFLES))
def test_number_of_shuffles_and_kind_of_aggregation(spark, no_broadcast, name):
    plan = final_plan(QUERIES[name].frame(spark, SF_DIR))
    main = plan.split("Subquery")[0]
    assert "SortAggregate" not in main or name == "error_banner"       # its worst service is a struct, over few rows
    assert sum("Exchange hashpartitioning" in line and "Reused" not in line for line in main.splitlines()) <= HASH_SHUFFLES[name]
