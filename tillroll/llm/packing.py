"""Length buckets of least padding, and token-budget batches inside them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm.common import table


@dataclass(frozen=True)
class Packing:
    """window: longest piece; longer documents become several pieces, none is cut off.
    step: bucket lengths are multiples of it. budget: padded tokens of a batch.
    shard_rows: pieces of a bucket that one task numbers, about.
    """

    window: int = 8192
    step: int = 8
    buckets: int = 16
    budget: int = 65536
    shard_rows: int = 2048


DEFAULT = Packing()


def byte_tokens(text: str = "text") -> Column:
    """Tokens of a byte-level vocabulary: the UTF-8 bytes and an end mark."""
    return (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long")


def boundaries(counts: np.ndarray, buckets: int) -> list[int]:
    """Indices (ascending, the last one len(counts) - 1) of bucket ends with least padding.

    counts[i] pieces have length class i. A piece costs the end of its bucket;
    the dynamic programme over (buckets used, last end) is exact. Of equal
    costs the one with the smaller previous end wins. Fewer ends come back
    where fewer length classes occur.
    """
    used = np.flatnonzero(counts)
    if not len(used):
        return []
    before = np.concatenate([[0], np.cumsum(counts[used])]).astype(np.float64)
    m, ends = len(used), used + 1
    best = before[1:] * ends  # one bucket up to each used length
    choice = []
    for _ in range(min(buckets, m) - 1):
        # cost[j, i]: the earlier buckets end at used[i], the last one at used[j]
        cost = best[None, :] + (before[1:][:, None] - before[1:][None, :]) * ends[:, None]
        cost[np.triu_indices(m)] = np.inf
        pick = cost.argmin(axis=1)
        least = cost[np.arange(m), pick]
        pick = np.where(least < best, pick, -1)
        choice.append(pick)
        best = np.where(pick >= 0, least, best)
    out, j = [m - 1], m - 1
    for pick in reversed(choice):
        if pick[j] >= 0:
            j = int(pick[j])
            out.append(j)
    return [int(used[j]) for j in reversed(out)]


def pieces(docs: DataFrame, length: Column, keys: list[str], how: Packing) -> DataFrame:
    """keys, piece, start, length: every document cut at multiples of the window."""
    cut = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_length") / how.window) - 1, F.lit(0)))
    known = F.coalesce(length.cast("long"), F.lit(1))
    return docs.select(*keys, known.alias("_length")).select(
        *keys, F.col("_length"), F.explode(cut).alias("piece")
    ).select(
        *keys,
        F.col("piece").cast("long").alias("piece"),
        (F.col("piece") * how.window).cast("long").alias("start"),
        F.least(F.lit(how.window), F.col("_length") - F.col("piece") * how.window)
        .cast("long").alias("length"),
    )


def pack(
    docs: DataFrame, length: Column | None = None, keys: tuple[str, ...] = ("doc_id",),
    how: Packing = DEFAULT,
) -> DataFrame:
    """keys, piece, start, length, bucket, bucket_length, shard, batch, slot per piece.

    A batch is named by bucket, shard and batch; it holds at most budget padded
    tokens, and slot counts its pieces from 0. The histogram that reaches the
    driver has at most window / step rows, whatever the table's size. Pieces of
    a bucket are dealt to shards by a hash, as many as the bucket's count asks
    for, so a bucket that holds most rows is numbered by many tasks; each shard
    may leave one batch part full.

    A null or empty text has one piece, of its end mark; so has a row whose length is null. Rows that share keys
    are packed each; an empty table gives no rows; other columns are left out.
    """
    keys = list(keys)
    cut = pieces(docs, byte_tokens() if length is None else length, keys, how)
    size_class = F.ceil(F.greatest(F.col("length"), F.lit(1)) / how.step) - 1
    seen = cut.groupBy(size_class.cast("int").alias("c")).count().collect()  # window / step rows
    counts = np.zeros(-(-how.window // how.step), np.int64)
    for row in seen:
        counts[row["c"]] = row["count"]
    ends = boundaries(counts, how.buckets)
    if not ends:
        ends = [len(counts) - 1]
    totals = np.add.reduceat(counts, [0, *[e + 1 for e in ends[:-1]]])
    lengths = [(e + 1) * how.step for e in ends]
    shards = [max(1, -(-int(t) // how.shard_rows)) for t in totals]

    column = lambda values: F.array(*[F.lit(v) for v in values])[F.col("bucket")]
    bucket = sum(((F.col("length") > n).cast("int") for n in lengths[:-1]), F.lit(0))
    placed = cut.withColumn("bucket", bucket.cast("int"))
    placed = placed.withColumn("bucket_length", column(lengths).cast("long"))
    spread = F.pmod(F.xxhash64(*keys, "piece"), column(shards))
    placed = placed.withColumn("shard", spread.cast("long"))
    order = Window.partitionBy("bucket", "shard").orderBy(*keys, "piece", "length")
    number = F.row_number().over(order) - 1
    rows = F.greatest(F.floor(F.lit(how.budget) / F.col("bucket_length")), F.lit(1))
    return (
        placed.withColumn("_number", number).withColumn("_rows", rows)
        .withColumn("batch", F.floor(F.col("_number") / F.col("_rows")).cast("long"))
        .withColumn("slot", (F.col("_number") % F.col("_rows")).cast("long"))
        .drop("_number", "_rows")
    )


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents").select("doc_id", "text"))
