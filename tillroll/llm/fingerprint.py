"""I-Match fingerprints: terms of middling rarity, hashed in several random lexicon subsets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import (
    large_batches,
    mixed,
    partitions_of,
    prepare,
    range_cuts,
    table,
    words_of,
)

#: The band: a term stays if at least 1 in RARE and at most 1 in COMMON documents
#: hold it, that is, its inverse document frequency is between ln COMMON and ln RARE.
RARE, COMMON = 2000, 20
LEAST_DOCS = 2
#: Random lexicon subsets of a fingerprint, EACH of every density: one that takes 1 term in 8,
#: in 32 and so on, drawn by a hash of the term. Whatever the length of a document, subsets of
#: some density hold few of its terms, so that an edit leaves some of them untouched.
DENSITIES = (8, 32, 128, 512, 2048)
EACH = 16
SUBSETS = EACH * len(DENSITIES)
TRIM = ".,;:!?\"'()[]"


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, term hash) of every distinct term of each text, and distinct hashes: rows
    sorted by text, the term as a place among the hashes. Terms are lower-case words without
    punctuation at their ends."""
    words, ends = words_of(pc.utf8_lower(pc.fill_null(texts, "")))
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    coded = words.dictionary_encode()
    names = pc.utf8_trim(coded.dictionary, TRIM)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w.as_buffer()) for w in names), np.uint64, len(names))
    empty = pc.equal(pc.binary_length(names), 0).to_numpy(zero_copy_only=False)
    distinct, place = np.unique(hashes, return_inverse=True)
    code = place[coded.indices.to_numpy()].astype(np.int64)
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    stays = ~empty[coded.indices.to_numpy()]
    cells = np.unique(owner[stays] * len(distinct) + code[stays])
    return cells // len(distinct), cells % len(distinct), distinct


def lexicon(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the terms inside the band, from the document frequencies of all terms.

    Frequencies are summed per batch before the shuffle. What comes to the
    driver is bounded: a term in it is held by a RAREth of all documents, so
    there are at most RARE times the mean number of distinct terms of a
    document, eight bytes each, whatever the number of documents.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in large_batches(batches, "text", 24 << 20):
            _, term, distinct = terms_of(part["text"].combine_chunks())
            held = np.bincount(term, minlength=len(distinct))
            yield pa.RecordBatch.from_arrays(
                [pa.array(distinct.view(np.int64)), pa.array(held.astype(np.int32), pa.int32())],
                ["term", "held"])

    total = docs.count()
    counted = docs.select("text").mapInArrow(run, "term long, held int").groupBy("term").agg(
        F.sum("held").alias("held"))
    low = max(LEAST_DOCS, -(-total // RARE))
    high = max(low, total // COMMON)
    inside = counted.filter(F.col("held").between(low, high)).select("term").toArrow()
    return np.sort(inside["term"].to_numpy().view(np.uint64))


def _members(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in value, subset) of every subset that takes a term, from the terms' mixed hashes.

    The densest subsets are two cuts of the whole lexicon into eight, so every term is in two.
    The others are disjoint within their density. Each cut reads bits of its own.
    """
    places, subsets = [], []
    shift, begin = 0, 0
    for density in DENSITIES:
        width = min(EACH, density)
        bits = density.bit_length() - 1
        for first in range(begin, begin + EACH, width):
            drawn = (value >> np.uint64(shift)) & np.uint64(density - 1)
            at = np.flatnonzero(drawn < width)
            places.append(at)
            subsets.append(drawn[at].astype(np.int64) + first)
            shift += bits
        begin += EACH
    return np.concatenate(places), np.concatenate(subsets)


def fingerprints(texts: pa.Array, known: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Fingerprint of each text, and its subset hashes (texts, SUBSETS; 0: no term in it).

    A subset's hash is taken over its sorted distinct terms. A text without any
    term of the lexicon gets a hash of all its terms instead, after a minus.
    """
    n = len(texts)
    owner, term, distinct = terms_of(texts)
    at = np.searchsorted(known, distinct)
    at[at == len(known)] = 0
    inside = known[at] == distinct if len(known) else np.zeros(len(distinct), bool)
    sums = np.zeros((n, SUBSETS), np.uint64)
    spread = mixed(distinct)
    keep = inside[term]
    if keep.any():
        # Terms of a text come in ascending order of their hash, each once: a sum of
        # mixed hashes names the sorted list.
        chosen, value = owner[keep], spread[term[keep]]
        at, subset = _members(value)
        group, value = chosen[at] * SUBSETS + subset, value[at]
        order = np.argsort(group, kind="stable")
        group = group[order]
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sums.ravel()[group[starts]] = mixed(np.add.reduceat(mixed(value[order]), starts))
    short = (sums >> np.uint64(32)).astype(np.uint32)
    short[(sums > 0) & (short == 0)] = 1
    whole = np.zeros(n, np.uint64)
    if len(owner):
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        whole[owner[starts]] = np.add.reduceat(spread[term], starts)
    hexes = short.astype(">u4").tobytes().hex()
    width = SUBSETS * 8
    used = short.any(axis=1)
    found = [hexes[k * width : (k + 1) * width] if used[k] else f"-{int(whole[k]):016x}" for k in range(n)]
    return found, short


def likeness(a: str, b: str, left: np.ndarray, right: np.ndarray) -> float:
    """1 for equal fingerprints, else equal subsets among those in which either has a term."""
    if a == b:
        return 1.0
    used = (left > 0) | (right > 0)
    return float(((left == right) & used).sum() / used.sum()) if used.any() else 0.0


def compare_neighbours(docs: DataFrame, known: np.ndarray, ranges: int) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and the likeness to the next one.

    The next document is the one with the next smaller doc_id; after the
    smallest comes the largest. Documents are dealt to ranges of doc_id, whose
    cuts are a list as long as the setting ranges. A range also gets the first
    document of the next one, so neighbours meet without a global sort. Texts
    travel compressed, once. Null ids come last; rows with one id have a
    fixed order that their texts decide. With one row the next document is that row itself.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"))
    cuts = sorted(set(range_cuts(docs, "doc_id", ranges)))
    # Range 0 has the largest ids; nulls go to the last one.
    bounds = F.array(*[F.lit(c) for c in reversed(cuts)]).cast("array<bigint>")
    place = F.size(F.filter(bounds, lambda c: F.col("doc_id").isNull() | (F.col("doc_id") < c)))
    placed = docs.withColumn("range", place.cast("long"))
    # First id of every range that has rows: at most ranges rows on the driver.
    firsts = sorted(
        (r["range"], r["top"])
        for r in placed.groupBy("range").agg(F.max("doc_id").alias("top")).collect())
    # A first document also goes to the range before; the very first one behind the last.
    lowest = -(2**63)
    copied = [(lowest if top is None else top, firsts[k - 1][0]) for k, (_, top) in enumerate(firsts)]
    helpers = spark.createDataFrame(copied, "key long, before long")  # at most ranges rows
    keyed = placed.withColumn("key", F.coalesce("doc_id", F.lit(lowest)))
    dealt = keyed.select("range", F.lit(False).alias("helper"), "doc_id", "text").unionByName(
        keyed.join(F.broadcast(helpers), "key").select(
            F.col("before").alias("range"), F.lit(True).alias("helper"), "doc_id", "text"))
    held = spark.sparkContext.broadcast(known)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [pack.compress(t.as_buffer()) for t in batch["text"]]
            yield batch.drop_columns(["text"]).append_column("packed", pa.array(texts, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = held.value
        for rows in _runs(batches):
            ids = [r[0] for r in rows]
            texts = [r[1] for r in rows]
            edited = []
            for text, (_, following) in zip(texts, [(None, r[2]) for r in rows], strict=True):
                half = len(text) // 2
                edited.append(text[: len(text) - half] + following[:half])
            last = rows[-1][2]
            found, subsets = fingerprints(pa.array([*texts, last], pa.string()), lexicon)
            changed, changed_subsets = fingerprints(pa.array(edited, pa.string()), lexicon)
            follows = [r[3] for r in rows]  # place of the next text in found
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                    pa.array(found[: len(rows)]),
                    pa.array(changed),
                    pa.array([likeness(found[k], changed[k], subsets[k], changed_subsets[k])
                              for k in range(len(rows))], pa.float64()),
                    pa.array([likeness(found[k], found[j], subsets[k], subsets[j])
                              for k, j in enumerate(follows)], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                 "near_edited", "near_next"],
            )

    packed = dealt.mapInArrow(squeeze, "range long, helper boolean, doc_id long, packed binary")
    ordered = packed.repartition("range").sortWithinPartitions(
        "range", "helper", F.col("doc_id").desc_nulls_last(), "packed")
    return ordered.mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double")


def _runs(
    batches: Iterator[pa.RecordBatch], limit: int = 4 << 20
) -> Iterator[list[tuple[int | None, str, str, int]]]:
    """Lists of (doc_id, text, next text, place of the next text in the list) of bounded size.

    In a list every next text but the last row's is the text of the row after
    it. A range ends with its helper; more helpers of it are not looked at.
    """
    unpack = zstandard.ZstdDecompressor()
    waiting: tuple[int, int | None, str] | None = None
    rows: list[tuple[int | None, str, str, int]] = []
    size = 0
    for batch in batches:
        for place, helper, doc_id, packed in zip(
            *(batch[c].to_pylist() for c in ("range", "helper", "doc_id", "packed")), strict=True
        ):
            if waiting is None and helper:
                continue
            text = unpack.decompress(packed).decode()
            if waiting is not None:
                rows.append((waiting[1], waiting[2], text, len(rows) + 1))
                size += len(waiting[2])
                if helper or size >= limit:
                    yield rows
                    rows, size = [], 0
            waiting = None if helper else (place, doc_id, text)
    if rows:
        yield rows


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ranges = 4 * partitions_of(prepare(spark))
    return compare_neighbours(docs, lexicon(docs), ranges)
