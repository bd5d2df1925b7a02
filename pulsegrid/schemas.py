"""Declared schemas of the six inputs, and the step that fits a frame to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


EVENTS = _struct(
    date=T.StringType(),
    timestamp=T.StringType(),
    event=T.StringType(),
    wallet_address=T.StringType(),
    platform=T.StringType(),
    session_id=T.StringType(),
    hour=T.StringType(),
    day_of_week=T.StringType(),
    metadata=T.StringType(),
)

TRADES = _struct(
    trade_date=T.StringType(),
    timestamp=T.StringType(),
    wallet_address=T.StringType(),
    type=T.StringType(),
    amount_usd=T.DecimalType(38, 18),
    leverage=T.StringType(),
    size=T.StringType(),
    price=T.StringType(),
    is_close=T.BooleanType(),
    category=T.StringType(),
    source=T.StringType(),
    venue=T.StringType(),
    asset=T.StringType(),
    side=T.StringType(),
    order_type=T.StringType(),
    from_token=T.StringType(),
    to_token=T.StringType(),
    status=T.StringType(),
)

LINKED_ACCOUNT = _struct(
    type=T.StringType(),
    address=T.StringType(),
    email=T.StringType(),
    name=T.StringType(),
    number=T.StringType(),
    username=T.StringType(),
)

USERS = _struct(
    id=T.StringType(),
    ingest_order=T.LongType(),
    linked_accounts=T.ArrayType(LINKED_ACCOUNT),
)

METRIC_POINTS = _struct(
    ts=T.TimestampNTZType(),
    namespace=T.StringType(),
    metric_name=T.StringType(),
    value=T.DoubleType(),
    dims=T.MapType(T.StringType(), T.StringType()),
)

LOGS = _struct(ts=T.TimestampNTZType(), log_group=T.StringType(), message=T.StringType())

ALARMS = _struct(
    AlarmName=T.StringType(),
    StateValue=T.StringType(),
    AlarmDescription=T.StringType(),
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the columns of `schema` that `df` lacks as typed nulls; keep everything else."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns}
    return df.withColumns(missing) if missing else df
