"""Result form of the registered queries: stable types on both engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME = "yyyy-MM-dd HH:mm:ss"
# Whole numbers that may be missing are shown as doubles: engines differ on missing integers.
MAY_BE_MISSING = {"run_id"}
# From this size on values keep four decimals, below it six.
LARGE = 1000.0
# Sums differ in their last bits with the order of addition, so exact halves must not depend on
# them: the half is rounded up with this much tolerance.
HALF_UP = 0.501


def rounded(x: Column) -> Column:
    digits = F.when(F.abs(x) < LARGE, F.lit(1e6)).otherwise(F.lit(1e4))
    return F.floor(x * digits + F.lit(HALF_UP)) / digits


def present(df: DataFrame, *columns: str) -> DataFrame:
    """Times as text, whole numbers as bigint, doubles rounded; a column may be renamed with ``old=new``."""
    return df.select(*shown(df, *columns))


def shown(df: DataFrame, *columns: str) -> list[Column]:
    """The columns of ``present``, for rows that are put in their final form before the last step."""
    out = []
    for spec in columns or df.columns:
        name, _, alias = spec.partition("=")
        kind, c = df.schema[name].dataType, F.col(name)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, TIME)
        elif name in MAY_BE_MISSING:
            c = c.cast("double")
        elif isinstance(kind, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = rounded(c.cast("double"))
        out.append(c.alias(alias or name))
    return out
