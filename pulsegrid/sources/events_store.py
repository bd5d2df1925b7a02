"""Events by day with shredded metadata: each field that most events have is a column of its own in the files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_shredded_events(events: DataFrame, path: str) -> None:
    """Writes raw events below `path` in day folders, their metadata text as VARIANT.

    Spark shreds the variant by the fields it finds in each file, and a result over the table reads from the files just the fields it
    asks for, not the metadata as a whole. Text that is no JSON becomes null, which all results take for no metadata. Days that
    `events` has are replaced, so a day may be written again. A metadata column that is no text stays as it is.
    """
    if "metadata" in events.columns and isinstance(events.schema["metadata"].dataType, T.StringType):
        events = events.withColumn("metadata", F.try_parse_json("metadata"))
    (events.repartition("date", F.pmod(F.xxhash64("event", "wallet_address"), F.lit(16))).sortWithinPartitions("date", "event")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path))
