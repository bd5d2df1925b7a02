"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the library is designed for. A cluster keeps its own sizing (executors, memory,
# shuffle partitions); AQE coalesces or splits shuffle partitions from measured sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app_name: str = "pulsegrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; `conf` entries use `__` for dots and win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@functools.cache
def _local_folder() -> str:
    path = tempfile.mkdtemp(prefix="pulsegrid-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder path for stream checkpoints and written tables.

    It lies in the shared folder that the cluster names in `spark.checkpoint.dir`. Only where
    that is unset and everything runs on one machine (tests), a temporary folder is made, which goes with the process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):      # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
