"""The stream queries stream whatever form the table has."""

from pathlib import Path

import pytest

from pulsegrid.plans import operations_queries as O
from pulsegrid.plans.base import Inputs
from pulsegrid.streaming.rollups import Run

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not there")


def test_part_files_are_streamed(spark, tmp_path, monkeypatch):
    spark.read.parquet(f"{SF_DIR}/events.parquet").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    runs, run_available = [], O.run_available
    monkeypatch.setattr(O, "run_available", lambda *a: runs.append(run_available(*a)) or runs[-1])
    for folder in (SF_DIR, str(tmp_path)):
        assert O.QUERIES["stream_errors_per_hour"].frame(spark, folder).count() > 0
        assert runs[-1].table.count() > 0 and runs[-1].late_rows == 0


def test_missing_rows_are_an_error(spark, monkeypatch):
    x = Inputs(spark, SF_DIR)
    for late, read in ((1, 5), (0, 0)):
        monkeypatch.setattr(O, "run_available", lambda *a, n=(late, read): Run(x.logs, *n))
        with pytest.raises(RuntimeError):
            O._closed(x, x.logs, "errors-per-hour")
