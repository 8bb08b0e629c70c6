"""What several operators share: session settings, tables, word splitting, hashing."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import RUNTIME

#: Rows handed to Python at once. A batch is also cut by bytes, so that long texts stay bounded.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}

#: Characters that separate words: blank, and 0x09 to 0x0D.
WHITE = " \t\n\x0b\x0c\r"


_sent: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the jobs of this package rely on; sends its modules to the executors."""
    for key, value in {**RUNTIME, **BATCH}.items():
        spark.conf.set(key, value)
    application = spark.sparkContext.applicationId
    if application not in _sent:
        package = Path(__file__).resolve().parents[1]
        with tempfile.NamedTemporaryFile(suffix=".zip", prefix="modules-", delete=False) as file:
            with zipfile.ZipFile(file, "w") as archive:
                for source in sorted(package.rglob("*.py")):
                    archive.write(source, os.path.join(package.name, source.relative_to(package)))
        atexit.register(Path(file.name).unlink, missing_ok=True)
        spark.sparkContext.addPyFile(file.name)  # Spark's file server hands it to the executors
        _sent.add(application)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def large_batches(
    batches: Iterator[pa.RecordBatch], text: str, limit: int = 16 << 20
) -> Iterator[pa.Table]:
    """Join record batches until their texts hold limit bytes: fewer, larger steps of bounded size."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(text)).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def words_of(texts: pa.ChunkedArray | pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and for each text the number of words before it (n + 1 ends)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(counts)), counts)[real]
    ends = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=len(counts)), out=ends[1:])
    return words.filter(pa.array(real)), ends


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit values spread over all bits (a finaliser of two multiplications)."""
    values = values.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        values ^= values >> np.uint64(shift)
        values *= np.uint64(factor)
    values ^= values >> np.uint64(33)
    return values


def range_cuts(docs: DataFrame, column: str, count: int) -> list[int]:
    """Ascending values that cut the table into about count equal ranges; one that fills several returns.

    One pass over a narrow column; the list is as long as the setting count.
    Unlike a range partitioning, which runs its input once more to sample it,
    this costs no work on what is computed from the rows.
    """
    wanted = [k / count for k in range(1, count)]
    if not wanted:
        return []
    row = docs.agg(F.percentile_approx(column, wanted, 10 * count).alias("cuts")).first()
    return sorted(row["cuts"] or [])


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
