"""Which rows lie in given windows of days: an interval join as an equi-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days of one bucket. A bucket's covered days are the bits of one long.
BUCKET = 32


def _bucket(number: Column) -> Column:
    return F.floor(number / BUCKET)


def covered_days(windows: DataFrame, keys: Sequence[str], first: str, last: str) -> DataFrame:
    """Per key and bucket of 32 days, the days that any window covers, as bits.

    Windows that overlap or repeat fold into the same bits before the shuffle,
    so the result has at most one row per key and bucket. Both ends are included;
    a window without an end, or with its ends the wrong way round, covers nothing.
    """
    span = windows.select(
        *keys, F.unix_date(first).alias("_first"), F.unix_date(last).alias("_last")
    ).where(F.col("_first") <= F.col("_last"))
    spread = span.withColumn(
        "_bucket", F.explode(F.sequence(_bucket(F.col("_first")), _bucket(F.col("_last"))))
    )
    start = F.col("_bucket") * BUCKET
    low = (F.greatest(F.col("_first"), start) - start).cast("int")
    high = (F.least(F.col("_last"), start + (BUCKET - 1)) - start).cast("int")
    ones = F.call_function("shiftleft", F.lit(1).cast("long"), high - low + 1) - 1
    return spread.groupBy(*keys, "_bucket").agg(
        F.bit_or(F.call_function("shiftleft", ones, low)).alias("_days")
    )


def mark_days(
    frame: DataFrame,
    windows: DataFrame,
    keys: Sequence[str],
    day: str,
    first: str = "first_day",
    last: str = "last_day",
    name: str = "in_window",
) -> DataFrame:
    """Add `name`: the day lies in a window of the row's key. No row is repeated or lost.

    Rows meet their bucket's bits by an equi-join on key and bucket: a key with a
    third of all rows spreads over its buckets, and Spark broadcasts the windows
    only when they are small. A null key or day lies in no window.
    """
    days = covered_days(windows, keys, first, last)
    days = days.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], "_bucket", "_days")
    number = F.unix_date(F.col(day))
    same = [F.col(k) == F.col(f"_key_{i}") for i, k in enumerate(keys)]
    joined = frame.withColumn("_at", _bucket(number)).join(
        days, [*same, F.col("_at") == F.col("_bucket")], "left"
    )
    offset = (number - F.col("_at") * BUCKET).cast("int")
    bit = F.call_function("shiftright", F.col("_days"), offset).bitwiseAND(F.lit(1))
    return joined.withColumn(name, F.coalesce(bit == 1, F.lit(False))).select(*frame.columns, name)
