import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pulsegrid.session import build_session  # noqa: E402

os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                            spark__driver__memory="4g", spark__sql__maxMetadataStringLength="10000")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def rows():
    """Collected rows as dictionaries."""
    return lambda df: [r.asDict(recursive=True) for r in df.collect()]


@pytest.fixture()
def frame(spark):
    """A small frame from a column list with types and row tuples."""
    return lambda schema, data: spark.createDataFrame(data, schema)


@pytest.fixture()
def make_events(frame):
    """Events from (timestamp, wallet, event, platform, metadata) tuples."""
    def make(*data):
        schema = "timestamp string, wallet_address string, event string, platform string, metadata string, session_id string"
        return frame(schema, [tuple(d) + (None,) * (5 - len(d)) + (f"s{i}",) for i, d in enumerate(data)])
    return make
