"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds(ts) -> Column:
    """Whole seconds since the epoch."""
    return F.unix_timestamp(col(ts))


def plus_hours(ts, hours: float) -> Column:
    return F.timestamp_seconds(seconds(ts) + F.lit(int(round(hours * 3600))))


def hours_between(later, earlier) -> Column:
    return (seconds(later) - seconds(earlier)) / F.lit(3600.0)


def days_between(later, earlier) -> Column:
    return (seconds(later) - seconds(earlier)) / F.lit(86400.0)


def bucket(ts, bucket_s: int) -> Column:
    """Start of the epoch-aligned bucket a timestamp falls into."""
    s = F.lit(int(bucket_s))
    return F.timestamp_seconds(F.floor(seconds(ts) / s) * s)


def half_even(x, digits: int) -> Column:
    """Rounding that sends exact halves to the even neighbour (20.625 -> 20.62)."""
    return F.bround(col(x), digits)


def median(x) -> Column:
    """Exact median; unlike ``F.median`` it may be used in a window frame."""
    return F.percentile(col(x), 0.5)


def ratio(a, b) -> Column:
    """a / b, NULL where b is zero or NULL."""
    return F.try_divide(col(a), col(b))


# Doubles under NEAR are summed as whole numbers of steps of 1 / STEPS.
NEAR, STEPS = 2.0**52, 2.0**46


def steady_sum(x, over=None) -> Column:
    """Aggregate: the sum of doubles, the same in its last bit for any order of the rows.

    Partial sums of doubles depend on which task adds first, so that ranks would tell apart what is equal, differently in every
    run.  Whole parts and fractions are added as integers instead (fractions in steps of 2**-46).  A group that holds a number of
    2**52 or more, or too many rows for the integers (over 100,000 of them), gets the plain sum.  ``over``: a window.
    """
    x = col(x).cast("double")
    on = (lambda c: c) if over is None else (lambda c: c.over(over))
    near, whole = F.abs(x) < NEAR, F.floor(x)
    wholes = on(F.try_sum(F.when(near, whole))).cast("double")
    steps = on(F.try_sum(F.when(near, F.floor((x - whole) * STEPS)))).cast("double")
    return F.when(on(F.max(F.abs(x))) < NEAR, F.coalesce(wholes + steps / STEPS, on(F.sum(x)))).otherwise(on(F.sum(x)))


def steady_mean(x, over=None) -> Column:
    """Aggregate: ``steady_sum`` over the number of values; NULL without any."""
    n = F.count(col(x))
    return F.try_divide(steady_sum(x, over), n if over is None else n.over(over))


def none_if_nan(x) -> Column:
    return F.when(~F.isnan(col(x)), col(x))


def as_number(df: DataFrame, name: str) -> Column:
    """Column as double, NULL where it is not a number (strings, variants and NaN included)."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return none_if_nan(F.col(name).cast("double"))
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    if isinstance(kind, T.BooleanType):
        return F.col(name).cast("int").cast("double")
    return none_if_nan(F.expr(f"try_cast(`{name}` AS DOUBLE)"))


def pearson(a, b) -> Column:
    """Aggregate: Pearson correlation of complete pairs, NULL when either side is constant.

    A constant side is known by its bounds: merged partial sums of equal values may leave a variance in the last bits.
    Both arguments must already be NULL together (see ``complete``).
    """
    varies = (F.min(col(a)) < F.max(col(a))) & (F.min(col(b)) < F.max(col(b)))
    return F.when(varies, F.try_divide(F.covar_pop(col(a), col(b)), F.stddev_pop(col(a)) * F.stddev_pop(col(b))))


def deviation(x) -> Column:
    """Aggregate: sample deviation, exactly 0 for equal values."""
    return F.when(F.min(col(x)) < F.max(col(x)), F.stddev_samp(col(x))).otherwise(F.lit(0.0))


def spread_over(cols) -> Column:
    """Largest minus smallest of several columns, skipping NULLs; NULL when all are NULL."""
    return F.greatest(*map(col, cols)) - F.least(*map(col, cols))
