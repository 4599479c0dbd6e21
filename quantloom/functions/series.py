"""Column helpers shared by the operators. NULL is the only missing value: NaN never leaves these."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_if_nan(x) -> Column:
    """NaN and the infinities become NULL."""
    x = c(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ratio(a, b) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(c(a).cast("double"), c(b).cast("double"))


def safe_log(x) -> Column:
    x = c(x)
    return F.when(x > 0, F.ln(x))


def log_return(x, key, order, lag: int = 1) -> Column:
    w = W.partitionBy(*key).orderBy(*order)
    return safe_log(ratio(x, F.lag(x, lag).over(w)))


def rolling(fn, x, key, order, n: int, guard=None) -> Column:
    """fn over the last n rows, NULL unless all n values (of guard) are there."""
    w = W.partitionBy(*key).orderBy(*order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(c(guard if guard is not None else x)).over(w) == n, fn.over(w))


def average_rank(x, key) -> Column:
    """Rank with ties averaged among non-null values of a partition; NULL for NULL."""
    x = c(x)
    ordered = W.partitionBy(*key).orderBy(x.asc_nulls_last())
    ties = W.partitionBy(*key, x)
    return F.when(x.isNotNull(), F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def percent_rank_average(x, key) -> Column:
    return ratio(average_rank(x, key), F.count(c(x)).over(W.partitionBy(*key)))


def week_friday(d) -> Column:
    """The Friday that closes the date's week (a Friday is its own)."""
    return F.next_day(F.date_sub(c(d), 1), "FRI")


def right_bucket(ts, seconds: int) -> Column:
    """The end of the right-closed, right-labelled bucket of a timestamp."""
    step = seconds * 1_000_000
    return F.timestamp_micros((F.ceil(F.unix_micros(c(ts)) / F.lit(step)) * step).cast("long"))


def running_max(x, key, order) -> Column:
    return F.max(c(x)).over(W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def interval_seconds(text: str | None) -> float | None:
    """Seconds of "30s", "5min", "2h", "1D"; None for blank."""
    import re

    if text is None or not str(text).strip():
        return None
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(s|sec|min|m|h|d|days?)\s*", str(text), re.I)
    if not m:
        raise ValueError(f"not an interval: {text!r}")
    unit = m[2].lower()
    return float(m[1]) * {"s": 1, "sec": 1, "m": 60, "min": 60, "h": 3600}.get(unit, 86400)
