"""Number helpers shared by the operators.

Rounding is always "half up towards plus infinity", floor(x + 0.5); Spark's own
`round` sends -2.5 to -3 and would disagree on negative halves.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Nearest integer as bigint, halves upwards."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def clamp(x: Column, lo, hi) -> Column:
    """x limited to [lo, hi]; the upper bound wins when lo > hi."""
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.least(hi, F.greatest(lo, x))


def even(x: Column) -> Column:
    """Nearest even integer, at least 2."""
    return F.greatest(F.lit(2).cast("bigint"), half_up(x / 2) * 2)


def epoch_us(spark: SparkSession, col: str) -> Column:
    """Microseconds of a zone-less timestamp, whatever the session's time zone."""
    if spark.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "GMT"):
        return F.unix_micros(F.col(col).cast("timestamp"))
    since = f"({col} - timestamp_ntz'1970-01-01 00:00:00')"
    return F.expr(
        f"""extract(day from {since}) * 86400000000L + extract(hour from {since}) * 3600000000L
            + extract(minute from {since}) * 60000000L
            + cast(extract(second from {since}) * 1000000 as bigint)"""
    )
