"""Missing values and coercion: NaN, infinities and unparseable text become NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATS = (T.DoubleType, T.FloatType)
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC = _FLOATS + _INTEGERS + (T.DecimalType,)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType, T.TimeType)


def finite(column: Column) -> Column:
    """NULL in place of NaN and the infinities (input must be floating point)."""
    return F.when(F.abs(column) < F.lit(float("inf")), column)


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN and infinities missing, whatever its type."""
    column = F.col(quoted(name))
    return finite(column) if isinstance(field_type(df, name), _FLOATS) else column


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def field_type(df: DataFrame, name: str) -> T.DataType:
    for f in df.schema.fields:
        if f.name == name:
            return f.dataType
    raise KeyError(f"No column {name!r}; the table has {df.columns}.")


def require(df: DataFrame, *names: str) -> None:
    for name in names:
        field_type(df, name)


def numeric(df: DataFrame, name: str) -> Column:
    """The column as a finite double; text that is not a number becomes NULL."""
    kind = field_type(df, name)
    column = F.col(quoted(name))
    if isinstance(kind, _FLOATS):
        return finite(column.cast("double"))
    if isinstance(kind, _INTEGERS + (T.DecimalType, T.BooleanType)):
        return column.cast("double")
    return finite(F.trim(column.cast("string")).try_cast("double"))


def moment(df: DataFrame, name: str) -> Column:
    """The column as a timestamp or date; unparseable text becomes NULL."""
    kind = field_type(df, name)
    column = F.col(quoted(name))
    if isinstance(kind, TEMPORAL):
        return column
    return F.try_to_timestamp(column.cast("string"))


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 for a temporal column, free of session time zones."""
    kind = field_type(df, name)
    column = moment(df, name)
    if isinstance(kind, T.TimestampNTZType):
        origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", origin, column)
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long") * F.lit(86_400_000_000)
    return F.unix_micros(column)


def key_number(df: DataFrame, name: str) -> Column:
    """A double that never decreases as the key grows: used only to place range boundaries."""
    kind = field_type(df, name)
    column = F.col(quoted(name))
    if isinstance(kind, NUMERIC):
        return column.cast("double")
    if isinstance(kind, TEMPORAL):
        return micros(df, name).cast("double")
    raise ValueError(f"{name!r} is neither a number nor a time.")
