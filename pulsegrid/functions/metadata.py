"""Reading fields of the free-form event metadata.

The column may be JSON text, VARIANT, a map or a struct. Text that is not a JSON object gives
null fields, as if no metadata were there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _field(df: DataFrame, key: str, column: str) -> tuple[Column | None, Column, T.DataType | None]:
    """The field as (variant or None, plain column, plain type)."""
    null = F.lit(None).cast("string")
    if column not in df.columns:
        return None, null, T.StringType()
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.StructType):
        if key not in dtype.names:
            return None, null, T.StringType()
        return None, F.col(column).getField(key), dtype[key].dataType
    if isinstance(dtype, T.MapType):
        return None, F.try_element_at(F.col(column), F.lit(key)), dtype.valueType
    source = F.col(column) if isinstance(dtype, T.VariantType) else F.try_parse_json(F.col(column))
    return source, F.try_variant_get(source, f"$.{key}", "string"), None


def _json(variant: Column, key: str) -> Column:
    """The field as JSON: text stays quoted, so that "12" and 12 differ after one parse."""
    return F.to_json(F.try_variant_get(variant, f"$.{key}", "variant"))


def text(df: DataFrame, key: str, column: str = "metadata") -> Column:
    return _field(df, key, column)[1].cast("string")


def numeric(df: DataFrame, key: str, column: str = "metadata") -> Column:
    """The field as double if it is stored as a number (or a boolean), else null.

    Numeric text does not count as a number.
    """
    variant, plain, dtype = _field(df, key, column)
    if variant is None:
        if isinstance(dtype, T.BooleanType):
            return plain.cast("int").cast("double")
        return plain.cast("double") if isinstance(dtype, T.NumericType) else F.lit(None).cast("double")
    found = _json(variant, key)
    return F.coalesce(found.try_cast("double"), F.when(found == "true", F.lit(1.0)))


def whole_number(df: DataFrame, key: str, column: str = "metadata") -> Column:
    """The field cut to a whole number, 0 where it is missing; whole-number text counts."""
    variant, plain, _ = _field(df, key, column)
    value = plain.try_cast("double") if variant is None else F.try_variant_get(variant, f"$.{key}", "double")
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))


def truthy(df: DataFrame, key: str, column: str = "metadata") -> Column:
    """True where the field is set: a true boolean, a non-zero number, non-empty text or list."""
    variant, plain, dtype = _field(df, key, column)
    if variant is None:
        if isinstance(dtype, T.BooleanType):
            found = plain
        elif isinstance(dtype, T.NumericType):
            found = plain != 0
        else:
            found = plain.cast("string") != ""
        return F.coalesce(found, F.lit(False))
    found = _json(variant, key)
    empty = found.isin("false", "null", '""', "{}", "[]")
    return F.coalesce(~empty & F.coalesce(found.try_cast("double") != 0, F.lit(True)), F.lit(False))
