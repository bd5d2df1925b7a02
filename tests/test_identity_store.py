"""The latest owners, folded day by day, and joins of bucketed tables."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pulsegrid import schemas
from pulsegrid.operators import identity as I
from pulsegrid.operators import identity_store as S
from pulsegrid.session import work_dir


def account(kind, **fields):
    return {n: None for n in schemas.LINKED_ACCOUNT.names} | {"type": kind} | fields


@pytest.fixture(scope="module")
def users(spark):
    pick = random.Random(3)
    rows = []
    for i in range(300):
        accounts = [account("wallet", address=f"0xA{pick.randrange(120)}") for _ in range(pick.randint(0, 3))]
        accounts += [account("email", address=f"u{i}@x")] if i % 2 else [account("google_oauth", email=f"g{i}@x", name=None if i % 3 else f"G {i}")]
        rows.append((f"u{i % 250}", i // 2, accounts))                # some ids twice, some orders shared
    return spark.createDataFrame([*rows, ("none", 1, None), (None, None, [account("wallet", address="0xA1")])], schemas.USERS).cache()


def content(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 1, 0, 2), (2, 2, 0, 3, 1, 0, 3)])
def test_any_order_and_repetition_gives_the_full_table(spark, users, order):
    path = work_dir(spark, "t-owners")
    for n in order:
        S.fold_owners(users.where(F.coalesce(F.pmod(F.xxhash64("id", "ingest_order"), F.lit(4)), F.lit(0)) == n), path, 8)
    assert content(S.current_owners(spark, path)) == content(I.wallet_identity(users))


def test_only_touched_buckets_are_written(spark, users):
    path = work_dir(spark, "t-touched")
    assert S.fold_owners(users, path, 16) == list(range(16))
    before = set(Path(path).rglob("*.parquet"))
    one = users.where("id = 'u7'")
    touched = S.fold_owners(one, path, 16)
    written = set(Path(path).rglob("*.parquet")) - before
    assert 0 < len(touched) <= 6 and {int(f.parent.parent.name.split("=")[1]) for f in written} == set(touched) and len(written) == len(touched)
    assert content(S.current_owners(spark, path)) == content(I.wallet_identity(users))
    scan = S.current_owners(spark, path).inputFiles()
    assert len(scan) >= 16 and S.fold_owners(users.limit(0), path, 16) == []
    plan = S._of_versions(*S._versions(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert "version" in next(line for line in plan.splitlines() if "FileScan" in line).split("PartitionFilters")[1].split("PushedFilters")[0]


def test_a_failed_run_is_made_good(spark, users):
    """A version that only some buckets have: readers see whole buckets, and the next run completes it."""
    path = work_dir(spark, "t-failed")
    S.fold_owners(users.where("ingest_order < 100"), path, 4)
    S.fold_owners(users.where("ingest_order >= 100"), path, 4)
    for file in list(Path(path).glob("bucket=1/version=2/*")):        # as if the commit had stopped before this bucket
        file.unlink()
    assert content(S.current_owners(spark, path)) != content(I.wallet_identity(users.where("ingest_order IS NOT NULL")))
    S.fold_owners(users.where("ingest_order >= 100"), path, 4)
    assert content(S.current_owners(spark, path)) == content(I.wallet_identity(users.where("ingest_order IS NOT NULL")))


@pytest.fixture(scope="module")
def tables(spark, users):
    facts = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "0xa5").when(F.col("id") % 50 == 1, None).otherwise(
        F.concat(F.lit("0xA"), (F.col("id") % 150).cast("string"))).alias("wallet_address"))
    path = work_dir(spark, "t-bucketed")
    names = tuple(f"{kind}_{path.rsplit('-', 1)[-1]}" for kind in ("facts", "people"))
    S.write_bucketed(facts, I.wallet_identity(users), names, path, 8)
    yield facts, names
    for name in names:
        spark.sql(f"DROP TABLE {name}")


def test_the_join_has_no_exchange(spark, users, tables):
    facts, names = tables
    joined = S.enrich_bucketed(spark, names)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Broadcast" not in plan
    assert content(joined.select(*sorted(joined.columns))) == content((full := I.enrich_identity(facts, I.wallet_identity(users))).select(*sorted(full.columns)))


def test_a_hot_wallet_is_spread(spark, users, tables):
    """A wallet with a third of all rows: no bucket has more than a few times the mean."""
    facts, names = tables
    assert {r[0] for r in S.hot_wallets(facts, 8).collect()} == {"0xa5"}
    stored = spark.table(names[0])
    per_file = [r["n"] for r in stored.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert sum(per_file) == 4000 and max(per_file) < 2.5 * 4000 / 8
    assert stored.where("_wallet = '0xa5'").select("_salt").distinct().count() == S.SALTS
    assert spark.table(names[1]).where("_wallet <> '0xa5'").agg(F.max("_salt")).first()[0] == 0
