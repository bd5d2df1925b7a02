"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir

# One byte class for white space everywhere: blank and U+0009 to U+000D. `bytes.split()` splits on the same set.
BLANK = "[\\x20\\x09-\\x0D]+"
HELD_OUT = 2
MASK = (1 << 64) - 1


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """`df` written once as Parquet to the folder all executors share, and read back.

    Lineage ends here, so a lost executor costs at most the stage that runs. The folder is the one
    that `spark.checkpoint.dir` names; whoever owns it empties it after the job.
    """
    path = work_dir(df.sparkSession, f"llm-{purpose}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents no model may learn from; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(True))


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of a caller can never clash with inner ones."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def _with_package(df: DataFrame) -> DataFrame:
    """Lets Python workers import this package from where the driver has it; elsewhere it is installed or sent along."""
    root, environment = str(Path(__file__).resolve().parents[2]), df.sparkSession.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(":")
    if root not in paths:
        environment["PYTHONPATH"] = ":".join([root, *filter(None, paths)])
    return df


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    return _with_package(df).mapInArrow(function, schema)


def map_pandas(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    return _with_package(df).mapInPandas(function, schema)
