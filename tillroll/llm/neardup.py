"""Near-duplicates: MinHash signatures, a multi-index Hamming join, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import large_batches, mixed, prepare, table, words_of
from tillroll.llm.components import components
from tillroll.session import drop, stage

WORDS = 5
PERCENT = 75
#: A signature is SYMBOLS minimum hashes of BITS bits, cut into CHUNKS chunks.
SYMBOLS = 64
BITS = 16
CHUNKS = 16
PER_CHUNK = SYMBOLS // CHUNKS
#: Errors allowed in one chunk. Pigeonhole: up to (ERRORS + 1) * CHUNKS - 1 differing
#: symbols leave a chunk with no more errors than that, so such a pair always meets.
ERRORS = 1
DISTANCE = (ERRORS + 1) * CHUNKS - 1
#: A sharper sketch of classes that met: WIDE symbols of 8 bits. A pair at 75 % differs in
#: a quarter of them; pairs up to 4.75 standard deviations above that are confirmed on
#: full sets, so one in a million is lost.
WIDE = 512
#: Rounds in which a key's members are held against one of them, and members of a block
#: in the last round, which compares all that is still apart.
STAR_ROUNDS = 2
BLOCK = 1024
#: A key is hot if this share of the classes has it, by one class in SAMPLED: hot keys are not
#: exchanged, since it is known that they are shared. There are at most HOT_ONE_IN * CHUNKS * PER_CHUNK.
HOT_ONE_IN = 2000
SAMPLED = 64
HOT_SEEN = 16

_random = np.random.RandomState(20240607)
_FACTORS = (
    _random.randint(0, 2**63, SYMBOLS + WIDE, dtype=np.int64).astype(np.uint64) << np.uint64(1)
) | np.uint64(1)
_OFFSETS = _random.randint(0, 2**63, SYMBOLS + WIDE, dtype=np.int64).astype(np.uint64) * np.uint64(3)
_PLACES = (_random.randint(0, 2**63, WORDS, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_sets(texts: pa.ChunkedArray) -> Iterator[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its five-word shingles, A-Z in lower case.

    A text of one to four words has one shingle, the whole of them; a text
    without words or null has none.
    """
    words, ends = words_of(pc.ascii_lower(texts))
    if not len(words):
        for _ in range(len(ends) - 1):
            yield np.empty(0, np.uint64)
        return
    coded = words.dictionary_encode()
    known = np.fromiter(
        (xxhash.xxh64_intdigest(w.as_buffer()) for w in coded.dictionary),
        np.uint64, len(coded.dictionary),
    )
    hashes = known[coded.indices.to_numpy()]
    n = len(hashes)
    windows = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for k in range(WORDS):
        windows += hashes[k : n - WORDS + 1 + k] * _PLACES[k]
    windows = mixed(windows)
    for start, end in zip(ends[:-1], ends[1:], strict=True):
        size = end - start
        if size >= WORDS:
            yield np.unique(windows[start : end - WORDS + 1])
        elif size:
            few = np.array([int(size)], np.uint64)
            for k in range(size):
                few = mixed(few + hashes[start + k : start + k + 1] * _PLACES[k])
            yield few
        else:
            yield np.empty(0, np.uint64)


def _least(shingles: np.ndarray, which: slice) -> np.ndarray:
    """The minimum of the shingles under each of the permutations."""
    factors, offsets = _FACTORS[which, None], _OFFSETS[which, None]
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[None, at : at + 4096]
        np.minimum(least, (part * factors + offsets).min(axis=1), out=least)
    return mixed(least)


def signature(shingles: np.ndarray) -> np.ndarray:
    """SYMBOLS symbols of BITS bits: the low bits of the minimum under each permutation."""
    return (_least(shingles, slice(0, SYMBOLS)) & np.uint64((1 << BITS) - 1)).astype(np.uint16)


def wide_signature(shingles: np.ndarray) -> np.ndarray:
    """WIDE symbols of 8 bits, of other permutations."""
    return (_least(shingles, slice(SYMBOLS, None)) & np.uint64(255)).astype(np.uint8)


def _set_name(shingles: np.ndarray) -> bytes:
    """Sixteen bytes that name a set: 10^10 sets have two alike with a probability of 10^-19."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def keys_of(symbols: np.ndarray) -> np.ndarray:
    """Keys of signatures, (n, SYMBOLS) to (n, CHUNKS * PER_CHUNK): each chunk without each symbol.

    Chunk number, place left out and the other symbols fit one long, so two
    equal keys mean equal symbols.
    """
    parts = symbols.astype(np.int64).reshape(len(symbols), CHUNKS, PER_CHUNK)
    keys = np.empty((len(symbols), CHUNKS, PER_CHUNK), np.int64)
    for out in range(PER_CHUNK):
        key = np.arange(CHUNKS, dtype=np.int64)[None, :] * PER_CHUNK + out
        for k in range(PER_CHUNK):
            if k != out:
                key = (key << BITS) | parts[:, :, k]
        keys[:, :, out] = key
    return keys.reshape(len(symbols), -1)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in large_batches(batches, "text", 4 << 20):
        sizes, prints, symbols = [], [], []
        for shingles in shingle_sets(part["text"]):
            sizes.append(len(shingles))
            prints.append(_set_name(shingles))
            symbols.append(signature(shingles))
        yield pa.RecordBatch.from_arrays(
            [
                part["doc_id"].combine_chunks(),
                part["row_key"].combine_chunks(),
                pa.array(sizes, pa.int64()),
                pa.array(prints, pa.binary()),
                pa.array([s.tobytes() for s in symbols], pa.binary()),
            ],
            ["doc_id", "row_key", "n_shingles", "set_name", "signature"],
        )


def signatures(docs: DataFrame) -> DataFrame:
    """n_shingles, set_name (128 bits of the whole set) and signature of every doc_id, row_key, text."""
    return docs.mapInArrow(
        _sign, "doc_id long, row_key long, n_shingles long, set_name binary, signature binary"
    )


def _keyed(classes: DataFrame, hot: np.ndarray, chosen: bool = False) -> DataFrame:
    """key, class for all keys of the classes: those that are hot, or those that are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols = np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            keys = keys_of(symbols)
            named = np.repeat(batch["class"].to_numpy(), keys.shape[1])
            keys = keys.ravel()
            if len(hot):
                own = np.isin(keys, hot) == chosen
                keys, named = keys[own], named[own]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(named)], ["key", "class"])

    return classes.select("class", "signature").mapInArrow(run, "key long, class long")


def _hot_keys(classes: DataFrame) -> np.ndarray:
    """Keys that a sample of the classes has often. Only the way of their rows depends on it, no result."""
    sample = classes.filter(F.pmod(F.xxhash64("class"), F.lit(SAMPLED)) == 0)
    size = sample.count()
    seen = _keyed(sample, np.empty(0, np.int64)).groupBy("key").count()
    often = seen.filter(F.col("count") >= max(HOT_SEEN, size // HOT_ONE_IN))
    return np.array([r["key"] for r in often.collect()], np.int64)  # bounded, see HOT_ONE_IN


def _members(classes: DataFrame) -> DataFrame:
    """key, class, others of the keys that at least two classes have; others: how many share the key.

    One exchange, by key. Rows of hot keys stay where they are, so no task gets
    them all.
    """
    hot = _hot_keys(classes)
    others = F.count(F.lit(1)).over(Window.partitionBy("key")) - 1
    met = _keyed(classes, hot).withColumn("others", others).filter("others > 0")
    if not len(hot):
        return met
    held = _keyed(classes, hot, chosen=True)
    counts = held.groupBy("key").agg((F.count(F.lit(1)) - 1).alias("others"))
    return met.union(held.join(F.broadcast(counts), "key"))  # a row per hot key


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in large_batches(batches, "text", 4 << 20):
        found = [s.view(np.int64) for s in shingle_sets(part["text"])]
        offsets = np.zeros(len(found) + 1, np.int32)
        np.cumsum([len(s) for s in found], out=offsets[1:])
        values = np.concatenate(found) if found else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                part["class"].combine_chunks(),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                pa.array([wide_signature(s.view(np.uint64)).tobytes() for s in found], pa.binary()),
            ],
            ["class", "shingles", "wide"],
        )


@F.pandas_udf(T.IntegerType())
def _distance(left: pd.Series, right: pd.Series) -> pd.Series:
    """Symbols in which two wide signatures differ."""
    if not len(left):
        return pd.Series([], dtype="int32")
    a, b = (np.frombuffer(b"".join(x), np.uint8).reshape(-1, WIDE) for x in (left, right))
    return pd.Series((a != b).sum(axis=1).astype(np.int32))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("_left"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("_right"))
    both = F.size(F.array_intersect("_left", "_right"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    return joined.filter(
        100 * both >= percent * (F.size("_left") + F.size("_right") - both)
    ).select("a", "b")


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (class, hub) with the distance of their sketches, if it and the sizes allow a link."""
    side = lambda c: sets.select(
        F.col("class").alias(c), F.col("wide").alias(f"_s_{c}"), F.size("shingles").alias(f"_n_{c}"))
    joined = pairs.join(side("class"), "class").join(side("hub"), "hub").filter(
        100 * F.least("_n_class", "_n_hub") >= percent * F.greatest("_n_class", "_n_hub"))
    return joined.select("class", "hub", _distance("_s_class", "_s_hub").alias("distance")).filter(
        F.col("distance") <= _reach(percent))


def _reach(percent: int, seen: float = 1.0) -> int:
    """Wide symbols that may differ: as many as expected at percent, and 4.75 deviations.

    seen is the chance that a differing symbol shows, one half where a bit of it is compared.
    """
    apart = (1 - percent / 100) * seen
    return int(WIDE * apart + 4.75 * (WIDE * apart * (1 - apart)) ** 0.5)


def _with_scores(members: DataFrame) -> DataFrame:
    """members with score: how many others a class meets, over all its keys. It is high in the
    middle of a group of near copies."""
    scores = members.groupBy("class").agg(F.sum("others").alias("score"))
    return members.select("key", "class").join(scores, "class")


def _apart(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """members with component, of the keys whose members are not all in one component."""
    labelled = members.withColumn("component", F.col("class"))
    if labels is not None:
        labelled = members.join(
            labels.select(F.col("node").alias("class"), F.col("component").alias("_c")), "class", "left"
        ).select("key", "class", "score", F.coalesce("_c", "class").alias("component"))
    split = labelled.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"))
    return labelled.join(split.filter("_lo < _hi").select("key"), "key", "left_semi")


def _hubs(apart: DataFrame) -> DataFrame:
    """key, hub, hub_component: the member with the highest score."""
    best = F.max(F.struct("score", F.col("class").alias("hub"), F.col("component").alias("hub_component")))
    return apart.groupBy("key").agg(best.alias("_hub")).select("key", "_hub.hub", "_hub.hub_component")


def _star_pairs(apart: DataFrame, turn: int) -> DataFrame:
    """Each member with one member of its key: as many pairs as members.

    The first turn takes the hub of the key, later ones the hub of what is not
    in the first hub's component.
    """
    hubs = _hubs(apart)
    if turn:
        hubs = _hubs(apart.join(hubs, "key").filter("component != hub_component")
                     .select("key", "class", "score", "component"))
    return apart.join(hubs, "key").filter("component != hub_component").select("class", "hub").distinct()


def _block_pairs(apart: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of a key that are in different components, near by size and both signatures.

    Members of a key are dealt to blocks of about BLOCK, so that no task holds
    a hot key: a block meets itself and every other block in a group of its
    own. Only pairs that pass are given out, and only under the first key
    that both have.
    """
    sizes = apart.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    side = classes.select("class", "signature", "n_shingles").join(sets.select("class", "wide"), "class")
    dealt = (
        apart.join(sizes, "key").join(side, "class")
        .withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                "block", "class", "component", "signature", "wide", "n_shingles")
    )
    groups = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return groups.mapInPandas(lambda parts: _compare(parts, percent), "a long, b long").distinct()


def _compare(parts: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Near pairs of the groups (key, low, high) that follow each other in parts."""
    held: pd.DataFrame | None = None
    for part in parts:
        held = part if held is None else pd.concat([held, part], ignore_index=True)
        last = held[["key", "low", "high"]].iloc[-1]
        open_rows = (held[["key", "low", "high"]] == last).all(axis=1).to_numpy()
        if len(held) >= 8 * BLOCK and not open_rows.all():
            yield _pairs_of(held[~open_rows], percent)
            held = held[open_rows].reset_index(drop=True)
    if held is not None and len(held):
        yield _pairs_of(held, percent)


def _pairs_of(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Compare every row with the next one, then the one after that, and so on, within its group."""
    group = rows.groupby(["key", "low", "high"], sort=False).ngroup().to_numpy()
    symbols = np.frombuffer(b"".join(rows["signature"]), np.uint16).reshape(-1, SYMBOLS)
    wide = np.frombuffer(b"".join(rows["wide"]), np.uint8).reshape(-1, WIDE)
    number = rows["key"].to_numpy() >> (BITS * (PER_CHUNK - 1))
    bits = np.packbits(wide & 1, axis=1).view(np.uint64)
    reach, bit_reach = _reach(percent), _reach(percent, 0.5)
    ids, parts = rows["class"].to_numpy(), rows["component"].to_numpy()
    n, block = rows["n_shingles"].to_numpy(), rows["block"].to_numpy()
    same = rows["low"].to_numpy() == rows["high"].to_numpy()
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at, step = np.arange(len(rows)), 0
    while True:
        step += 1
        at = at[at + step < len(rows)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            return pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})
        to = at + step
        may = (parts[at] != parts[to]) & (same[at] | (block[at] != block[to])) & (
            100 * np.minimum(n[at], n[to]) >= percent * np.maximum(n[at], n[to]))
        i, j = at[may], to[may]
        far = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) > bit_reach
        i, j = i[~far], j[~far]
        differ = symbols[i] != symbols[j]
        near = (differ.sum(axis=1) <= DISTANCE) & (_first_key(differ) == number[i])
        i, j = i[near], j[near]
        for low in range(0, len(i), 50_000):
            x, y = i[low : low + 50_000], j[low : low + 50_000]
            alike = (wide[x] != wide[y]).sum(axis=1) <= reach
            left.append(np.maximum(ids[x[alike]], ids[y[alike]]))
            right.append(np.minimum(ids[x[alike]], ids[y[alike]]))


def _first_key(differ: np.ndarray) -> np.ndarray:
    """The number of the first key under which pairs meet, from the symbols in which they differ."""
    chunks = differ.reshape(len(differ), CHUNKS, PER_CHUNK)
    errors = chunks.sum(axis=2)
    first = (errors <= ERRORS).argmax(axis=1)
    inside = chunks[np.arange(len(differ)), first]
    return first * PER_CHUNK + inside.argmax(axis=1)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Rows with equal sets, by 128 bits of the set, form a class; the classes'
    signatures meet by key. Members of a key are first held against
    one of them, which folds a group of near copies into a component at linear
    cost; what is still apart is compared in blocks. Every link is confirmed on
    full sets. A signature misses a pair at exactly 75 % with a probability of
    about 1e-5, since half of 64 symbols would have to differ.

    Null or empty texts have no shingles and are linked with nothing. Every
    row is a document of its own, also where rows share a doc_id; a null
    doc_id never names a component of others, and stands for itself if no
    linked row has an id. One row of a group is kept, with its repetitions of
    id and text. Other columns are not read. Empty tables give no rows.
    """
    named = docs.select("doc_id", "text").withColumn("row_key", _row_key(["doc_id", "text"]))
    return _grouped(named, percent).drop("row_key")


def _row_key(columns: Iterable[str]):
    """Names a row, together with its doc_id; rows equal in all columns share it."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns])


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """docs: doc_id, text, row_key."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "row_key")
    signed = stage(signatures(docs), "signatures")
    classes = signed.filter("n_shingles > 0").groupBy("set_name").agg(
        _first_row().alias("first_row"), F.first("n_shingles").alias("n_shingles"),
        F.first("signature").alias("signature"))
    # Numbers are unique, and fixed once they are written.
    classes = stage(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    met = stage(_members(classes), "members")
    members = stage(_with_scores(met), "members")
    drop(met)
    sets = stage(_sets_of(docs, classes, members.select("class").distinct()), "sets")

    links, labels = None, None
    for turn in range(STAR_ROUNDS + 1):
        apart = stage(_apart(members, labels), "apart")
        if apart.isEmpty():
            drop(apart)
            break
        if turn < STAR_ROUNDS:
            near = _near(_star_pairs(apart, turn), sets, percent)
            best = near.groupBy("class").agg(F.min(F.struct("distance", "hub")).alias("_best"))
            pairs = best.select(F.col("class").alias("a"), F.col("_best.hub").alias("b"))
        else:
            pairs = _block_pairs(apart, classes, sets, percent)
        found = _confirmed(pairs, sets, percent)
        before, links = links, stage(found if links is None else links.union(found), "links")
        drop(apart, *[t for t in (before, labels) if t is not None])
        labels = stage(components(links), "labels")
    drop(members, sets)

    starts = classes.select("set_name", "class", "first_row")
    if labels is not None:
        named = labels.withColumnRenamed("node", "class").join(starts, "class")
        firsts = named.groupBy("component").agg(F.min("first_row").alias("component_row"))
        linked = named.join(firsts, "component").select("class", "component_row")
        starts = starts.join(linked, "class", "left").select(
            "set_name", F.coalesce("component_row", "first_row").alias("first_row"))
    out = signed.withColumn("set_name", F.when(F.col("n_shingles") > 0, F.col("set_name")))
    out = out.join(starts.select("set_name", "first_row"), "set_name", "left")
    named = F.col("first_row").isNotNull()
    own = (F.col("first_row.row_key") == F.col("row_key")) & F.col("first_row.doc_id").eqNullSafe(F.col("doc_id"))
    return out.select(
        "doc_id", "row_key", "n_shingles",
        F.when(named, F.col("first_row.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(named, own).otherwise(F.lit(True)).alias("kept"))


def _first_row():
    """The row that stands for a group: of the least doc_id, one without an id only if there is no other."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))


def _sets_of(docs: DataFrame, classes: DataFrame, met: DataFrame) -> DataFrame:
    """class, shingles, wide of the classes in met, from the text of their first row."""
    chosen = classes.join(met, "class", "left_semi").select(
        "class", F.col("first_row.row_key").alias("row_key"), F.col("first_row.doc_id").alias("_doc_id"))
    texts = docs.join(chosen, "row_key").filter(F.col("doc_id").eqNullSafe(F.col("_doc_id")))
    # Equal rows once.
    texts = texts.groupBy("row_key", "class").agg(F.first("text").alias("text"))
    return texts.select("class", "text").mapInArrow(_sets, "class long, shingles array<long>, wide binary")


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


def keep(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stand for their group, with the columns of docs; equal rows once.

    Of rows with one id and text, that with the least hash of all its columns stays.
    """
    given = docs.withColumn("_row_key", _row_key(docs.columns))
    kept = _grouped(
        given.select("doc_id", "text", F.col("_row_key").alias("row_key")), percent
    ).filter("kept").select("doc_id", F.col("row_key").alias("_row_key"))
    rows = given.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col("doc_id").cast("long").alias("_doc_id"), "_row_key")
    kept = kept.withColumnRenamed("_row_key", "_kept_key")
    same = (F.col("_row_key") == F.col("_kept_key")) & F.col("_doc_id").eqNullSafe(F.col("doc_id"))
    rows = rows.join(kept, same, "left_semi").dropDuplicates(["_row_key", "_doc_id"])
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
