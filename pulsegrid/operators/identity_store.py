"""Stored identities: the latest owner of each wallet, kept up to date day by day, and tables that join without a shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .identity import OWNED, owner, wallet_rows, with_labels

BUCKETS = 256             # folders of the owner table
OWNERS = "wallet string, ingest_order bigint, user_id string, label string, login_type string, contact string, email string, bucket int, version bigint"
SALTS = 16                # groups into which rows of a hot wallet are dealt
_FOLDER = re.compile(r"/bucket=(\d+)/version=(\d+)/")


def _latest(rows: DataFrame) -> DataFrame:
    """The owner of each wallet: the last by ingest_order, then user_id. Folding is free of order and repetition."""
    return (rows.groupBy("wallet").agg(owner().alias("_owner"), F.max("ingest_order").alias("ingest_order"))
            .select("wallet", "ingest_order", "_owner.*"))


def _versions(spark: SparkSession, path: str) -> tuple[DataFrame, dict[int, int]]:
    """The table with all its versions, and the last version of each bucket, told from the paths."""
    table = spark.read.schema(OWNERS).parquet(path)
    last: dict[int, int] = {}
    for file in table.inputFiles():
        bucket, version = map(int, _FOLDER.search(file).groups())
        last[bucket] = max(version, last.get(bucket, 0))
    return table, last


def _of_versions(table: DataFrame, last: dict[int, int]) -> DataFrame:
    """Rows of the given buckets' last versions; a predicate on folders only, so that others are not read."""
    if not last:
        return table.where(F.lit(False))
    pairs = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])
    return table.where(F.col("bucket").isin(list(last)) & (F.col("version") == F.try_element_at(pairs, F.col("bucket"))))


def fold_owners(users: DataFrame, path: str, buckets: int = BUCKETS) -> list[int]:
    """Folds profiles, of a day say, into the owner table below `path`; the buckets that were rewritten.

    Profiles may come in any order and again: the table is that of all profiles so far. Only buckets with a wallet of `users`
    are read and written, each as one file of a new version that replaces the last one as soon as it is there. So readers see whole buckets at
    any time, and a run that failed is made good by running it again. Folders of older versions may be deleted by whoever owns the path.
    """
    spark = users.sparkSession
    new = _latest(wallet_rows(users)).withColumn("bucket", F.pmod(F.xxhash64("wallet"), F.lit(buckets)).cast("int"))
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())       # `buckets` at most
    # An append without rows makes the table on the first run.
    spark.createDataFrame([], OWNERS).write.mode("append").partitionBy("bucket", "version").parquet(path)
    table, last = _versions(spark, path)
    old = _of_versions(table, {b: last[b] for b in touched if b in last})
    columns = ["wallet", "ingest_order", *OWNED, "bucket"]
    both = old.select(*columns).unionByName(new.select(*columns))
    folded = _latest(both).withColumn("bucket", F.pmod(F.xxhash64("wallet"), F.lit(buckets)).cast("int"))
    (folded.withColumn("version", F.lit(max(last.values(), default=0) + 1).cast("bigint")).repartition("bucket").sortWithinPartitions("bucket", "wallet")
     .write.mode("append").partitionBy("bucket", "version").parquet(path))
    return touched


def current_owners(spark: SparkSession, path: str) -> DataFrame:
    """The owner table as `identity.wallet_identity` gives it for all profiles folded so far."""
    return _of_versions(*_versions(spark, path)).select("wallet", *OWNED)


# --- joins without a shuffle -----------------------------------------------------

def hot_wallets(df: DataFrame, buckets: int, wallet_col: str = "wallet_address") -> DataFrame:
    """Wallets (lower case, `_wallet`) with more than one in `buckets` of all rows: fewer than `buckets` of them."""
    counts = df.where(F.col(wallet_col).isNotNull()).groupBy(F.lower(wallet_col).alias("_wallet")).agg(F.count("*").alias("n"))
    every = counts.agg(F.sum("n")).scalar()
    return counts.where(F.col("n") * buckets > every).select("_wallet")


def _save(df: DataFrame, name: str, path: str, buckets: int) -> None:
    """One file per bucket, so that a scan of the table keeps its buckets and their order."""
    (df.repartition(buckets, "_wallet", "_salt").write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, "_wallet", "_salt").sortBy("_wallet", "_salt").saveAsTable(name))


def write_bucketed(df: DataFrame, identity: DataFrame, names: tuple[str, str], path: str, buckets: int = 64, wallet_col: str = "wallet_address") -> None:
    """Writes `df` and `identity` as two bucketed tables of the catalog, which `enrich_bucketed` joins without a shuffle.

    Both are dealt out by lower-cased wallet. What one wallet has of `df` would be one task at each join; so rows of the hot
    wallets, fewer than `buckets`, are dealt over `SALTS` groups, and only their identities are kept once per group.
    """
    hot = F.broadcast(hot_wallets(df, buckets, wallet_col).withColumn("_hot", F.lit(True)))
    salt: Column = F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    facts = df.withColumn("_wallet", F.lower(wallet_col)).join(hot, "_wallet", "left").withColumn("_salt", salt).drop("_hot")
    groups = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    people = identity.withColumnRenamed("wallet", "_wallet").join(hot, "_wallet", "left").withColumn("_salt", F.explode(groups)).drop("_hot")
    _save(facts, names[0], f"{path.rstrip('/')}/facts", buckets)
    _save(people, names[1], f"{path.rstrip('/')}/people", buckets)


def enrich_bucketed(spark: SparkSession, names: tuple[str, str], wallet_col: str = "wallet_address") -> DataFrame:
    """`identity.enrich_identity` over the tables of `write_bucketed`: no exchange on either side, whatever their sizes."""
    facts, people = spark.table(names[0]), spark.table(names[1])
    known = people.select("_wallet", "_salt", F.col("label").alias("_label"), F.col("contact").alias("_contact"), F.col("login_type").alias("_login"))
    return with_labels(facts.join(known.hint("merge"), ["_wallet", "_salt"], "left"), wallet_col).drop("_salt")
