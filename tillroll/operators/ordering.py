"""Running totals over a whole ordered table without sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.session import stage


def running_totals(
    df: DataFrame, order: Sequence[str], values: Sequence[str], descending: bool = False
) -> DataFrame:
    """Add before_<value>: the sum of value over all rows ahead in the order.

    The order columns must be unique per row. Rows are cut into ranges of the
    order, one per partition; the sum within a range is a window of that range,
    and the sum of earlier ranges a window over one row per range. The ranges
    are written down first, since a sampled layout may differ when recomputed.
    """
    by = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    ranged = df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id())
    ranged = stage(ranged, "ranges")

    sums = ranged.groupBy("_range").agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_range", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_off_{v}") for v in values]
    )
    inside = (
        Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    )
    total = ranged.join(F.broadcast(offsets), "_range")  # one row per shuffle partition
    for v in values:
        before = F.col(f"_off_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0))
        total = total.withColumn(f"before_{v}", before)
    return total.drop("_range", *[f"_off_{v}" for v in values])


def grouped_percentile(df: DataFrame, key: str, value: str, share: float, name: str) -> DataFrame:
    """key, name: the exact percentile of value per key, between two ranks in proportion.

    The same number as the built-in percentile, without its buffer of all
    distinct values of a key: equal values fold to a count, and running counts
    over ranges of (key, value) find the two values at the wanted rank. Nulls
    don't count; a key without a value has no row. A null key is a key.
    """
    folded = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(folded, [key, value], ["n"])
    place = (F.col("_total") - 1) * F.lit(share)
    ends = (
        ranked.groupBy(F.col(key).alias("_key"))
        .agg(F.min("before_n").alias("_first"), F.sum("n").alias("_total"))
        .withColumns({"_place": place, "_low": F.floor(place), "_high": F.ceil(place)})
    )
    rank = F.col("before_n") - F.col("_first")
    found = ranked.join(ends, F.col(key).eqNullSafe(F.col("_key"))).withColumn("_rank", rank)

    def at(wanted: str):
        holds = F.col(wanted).between(F.col("_rank"), F.col("_rank") + F.col("n") - 1)
        return F.max(F.when(holds, F.col(value).cast("double")))

    picked = found.groupBy(key, "_place", "_low", "_high").agg(at("_low").alias("_a"), at("_high").alias("_b"))
    between = (F.col("_high") - F.col("_place")) * F.col("_a") + (F.col("_place") - F.col("_low")) * F.col("_b")
    return picked.select(key, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(between).alias(name))


def number_rows(df: DataFrame, series: str, day: str, name: str = "row_id") -> DataFrame:
    """Number all rows 1.. by series, then day: numbers within a series plus the rows ahead of it."""
    df = stage(df, "to-number")
    counts = df.groupBy(series).agg(F.count(F.lit(1)).alias("n"))
    ahead = running_totals(counts, [series], ["n"]).select(F.col(series).alias("_series"), "before_n")
    within = F.row_number().over(Window.partitionBy(series).orderBy(day))
    return (
        df.withColumn("_n", within)
        .join(ahead, F.col(series).eqNullSafe(F.col("_series")))
        .withColumn(name, (F.col("before_n") + F.col("_n")).cast("long"))
        .drop("_n", "before_n", "_series")
    )
