"""Token ids in files of directly addressable codes: any token is read without decoding a block.

A shard file holds the documents of one range of doc_id. Its ids are cut into
levels: level 0 has the low bits of every id, level k the next bits of those
ids that need them. A bitmap beside each level but the last says whether an id
goes on, and a rank directory counts the marks before every block of the
bitmap, so the place in the next level is one addition and one popcount away.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm.common import large_batches, partitions_of, prepare, range_cuts, table
from tillroll.session import new_path

END_ID = 2
MAGIC = b"DACS0001"
#: Bits of each level; ids of the vocabulary must fit their sum.
WIDTHS = (8, 8)
#: Bits of a bitmap between two entries of its rank directory.
RANK_BLOCK = 512


def levels_of(ids: np.ndarray, widths: Sequence[int] = WIDTHS) -> list[dict[str, np.ndarray]]:
    """Chunks (one byte each, or two for widths over 8), bitmap and rank directory per level."""
    rest, levels = ids.astype(np.uint32), []
    for k, width in enumerate(widths):
        chunk = (rest & np.uint32((1 << width) - 1)).astype(np.uint8 if width <= 8 else np.uint16)
        rest = rest >> np.uint32(width)
        level = {"chunks": chunk}
        if k + 1 < len(widths):
            more = rest > 0
            level["bitmap"] = np.packbits(more, bitorder="little")
            starts = np.arange(0, len(more), RANK_BLOCK)
            marks = np.add.reduceat(more, starts, dtype=np.int64) if len(more) else np.empty(0, np.int64)
            level["ranks"] = (np.cumsum(marks) - marks).astype(np.uint64)
            rest = rest[more]
        elif len(rest) and int(rest.max()) > 0:
            raise ValueError("an id does not fit the levels")
        levels.append(level)
    return levels


class Shard:
    """A shard file in memory or mapped: ids by place, by document, or all of them."""

    def __init__(self, data: bytes | memoryview) -> None:
        view = memoryview(data)
        if bytes(view[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a file of this format")
        (size,) = struct.unpack_from("<I", view, len(MAGIC))
        at = len(MAGIC) + 4
        self.head = json.loads(bytes(view[at : at + size]))
        base = at + size
        self.widths = self.head["widths"]
        self._parts = {
            name: np.frombuffer(view, dtype, count, base + offset)
            for name, (dtype, count, offset) in self.head["parts"].items()
        }
        self.doc_ids = self._parts["doc_ids"]
        self.has_id = self._parts["has_id"]
        self.offsets = self._parts["offsets"]

    def token(self, place: int) -> int:
        """The id at a place of the shard, in as many steps as it has chunks."""
        value = shift = 0
        for k, width in enumerate(self.widths):
            value |= int(self._parts[f"chunks{k}"][place]) << shift
            shift += width
            if k + 1 == len(self.widths):
                return value
            bitmap = self._parts[f"bitmap{k}"]
            if not (int(bitmap[place >> 3]) >> (place & 7)) & 1:
                return value
            block = place // RANK_BLOCK
            before = bitmap[block * (RANK_BLOCK // 8) : place >> 3]
            last = int(bitmap[place >> 3]) & ((1 << (place & 7)) - 1)
            place = (
                int(self._parts[f"ranks{k}"][block])
                + int.from_bytes(before.tobytes(), "little").bit_count() + last.bit_count()
            )
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids of places start to stop, as uint32."""
        out = np.zeros(max(0, stop - start), np.uint32)
        where, shift = np.arange(len(out)), 0
        for k, width in enumerate(self.widths):
            out[where] |= self._parts[f"chunks{k}"][start:stop].astype(np.uint32) << np.uint32(shift)
            shift += width
            if k + 1 == len(self.widths) or start == stop:
                return out
            first = start // 8
            bits = np.unpackbits(
                self._parts[f"bitmap{k}"][first : (stop + 7) // 8], bitorder="little"
            )[start - first * 8 : stop - first * 8]
            where = where[bits.astype(bool)]
            start = self._rank(k, start)
            stop = start + len(where)
        return out

    def _rank(self, k: int, place: int) -> int:
        """Marks before place in the bitmap of level k."""
        block = place // RANK_BLOCK
        ranks = self._parts[f"ranks{k}"]
        if block >= len(ranks):
            return len(self._parts[f"chunks{k + 1}"])
        bits = int.from_bytes(
            self._parts[f"bitmap{k}"][block * (RANK_BLOCK // 8) : (place + 7) // 8].tobytes(), "little")
        return int(ranks[block]) + (bits & ((1 << int(place - block * RANK_BLOCK)) - 1)).bit_count()

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.offsets[k]), int(self.offsets[k + 1]))


def shard_bytes(
    doc_ids: Sequence[int | None], counts: Sequence[int], ids: np.ndarray, widths: Sequence[int] = WIDTHS
) -> Iterator[bytes | memoryview]:
    """The file of one shard, piece by piece."""
    parts = {
        "doc_ids": np.array([d or 0 for d in doc_ids], np.int64),
        "has_id": np.array([d is not None for d in doc_ids], np.uint8),
        "offsets": np.concatenate([[0], np.cumsum(counts)]).astype(np.int64),
    }
    for k, level in enumerate(levels_of(ids, widths)):
        parts |= {f"{name}{k}": array for name, array in level.items()}
    listed, at = {}, 0
    for name, array in parts.items():
        listed[name] = (array.dtype.str, len(array), at)
        at += -(-array.nbytes // 8) * 8
    head = json.dumps({"widths": list(widths), "rank_block": RANK_BLOCK, "parts": listed}).encode()
    head += b" " * (-(len(MAGIC) + 4 + len(head)) % 8)
    yield MAGIC + struct.pack("<I", len(head)) + head
    for array in parts.values():
        yield array.tobytes() + b"\0" * (-array.nbytes % 8)


# ---------------------------------------------------------------- encoding

_WHITE = r"[\s\x{0b}\p{Z}\x{1c}-\x{1f}\x{85}]"
_UNSAFE = f"^ | $| {_WHITE}|{_WHITE} "
_held: dict[tuple[str, bool], _Encoder] = {}
#: Words a Python worker remembers between batches, at most, and the length in bytes that they stay below.
REMEMBERED = 500_000
REMEMBERED_BYTES = 40


class _Encoder:
    """The library's tokenizer, and words whose ids a Python worker remembers between batches.

    special is the library's default: a text's literal of an added token becomes
    that token. Without it, it is spelled out like other text, and the pattern
    of literals is None.
    """

    def __init__(self, path: str, special: bool) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.tokenizer.model._resize_cache(0)  # words come once each, so its cache only costs
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin with a blank
        for token, k in vocabulary.items():
            self.opens[k] = token.startswith("\u0120")  # a blank in byte-level spelling
        literals = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.pattern = "|".join(map(re.escape, literals)) or None
        self.known = pa.array([], pa.string())
        self.known_ids = pa.array([], pa.large_binary())
        self.known_uses = np.empty(0, np.int64)

    def whole(self, texts: list[str]) -> pa.Array:
        """The ids of each text as uint16 bytes."""
        out = []
        for at in range(0, len(texts), 1000):
            done = self.tokenizer.encode_batch_fast(texts[at : at + 1000], add_special_tokens=False)
            out += [np.array(e.ids, np.uint16).tobytes() for e in done]
        return pa.array(out, pa.large_binary())

    def words(self, words: pa.Array) -> pa.Array:
        """The ids, as uint16 bytes, of each word with a blank before it.

        The words hold no blank, no white space at either end and no literal.
        They are joined, many to a text: only the first id of a word begins
        with a blank, so the ids fall apart again.
        """
        out = [pa.array([], pa.large_binary())]
        for at in range(0, len(words), 20_000):
            some = words.slice(at, 20_000)
            ends = np.append(np.arange(0, len(some), 200), len(some))
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), some), " ").to_pylist()
            done = self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.uint16) for e in done])
            cuts = np.append(np.flatnonzero(self.opens[ids]), len(ids)) * 2
            if len(cuts) != len(some) + 1:
                raise ValueError("the vocabulary does not keep a blank with the word after it")
            out.append(pa.Array.from_buffers(
                pa.large_binary(), len(some), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(ids)]))
        return pa.concat_arrays(out)

    def remember(self, words: pa.Array, ids: pa.Array, uses: np.ndarray) -> None:
        """Add words that are not known; of too many, the most used half of the limit stays."""
        short = pc.binary_length(words).to_numpy() < REMEMBERED_BYTES
        words, ids = words.filter(pa.array(short)), ids.filter(pa.array(short))
        self.known = pa.concat_arrays([self.known, words])
        self.known_ids = pa.concat_arrays([self.known_ids, ids])
        self.known_uses = np.concatenate([self.known_uses, uses[short]])
        if len(self.known) > REMEMBERED:
            stay = np.sort(np.argsort(-self.known_uses, kind="stable")[: REMEMBERED // 2])
            self.known, self.known_ids = self.known.take(pa.array(stay)), self.known_ids.take(pa.array(stay))
            self.known_uses = self.known_uses[stay]


def _encoder(path: str, special: bool = True) -> _Encoder:
    if (path, special) not in _held:
        _held[path, special] = _Encoder(path, special)
    return _held[path, special]


def encode_texts(texts: pa.Array, path: str, special: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another as uint16, and the number of ids of each text.

    The vocabulary's pattern starts a new piece at a single blank between two
    characters that are not blank, so texts are cut there, and each distinct
    word is encoded once. Texts with other runs of white space are encoded whole,
    and so are, with special, those that hold the literal of an added token.
    """
    encoder = _encoder(path, special)
    texts = pc.fill_null(texts, "")
    pattern = f"{_UNSAFE}|{encoder.pattern}" if encoder.pattern else _UNSAFE
    unsafe = pc.match_substring_regex(texts, pattern)
    lists = pc.if_else(unsafe, pa.scalar([""], pa.list_(pa.string())), pc.split_pattern(texts, " "))
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    begins = np.append(0, ends)[: len(ends)]  # every text has a first word, be it empty
    coded = lists.flatten().dictionary_encode()
    codes, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary

    # A text's first word has no blank before it, so its ids are others than elsewhere.
    first, first_codes = np.unique(codes[begins], return_inverse=True)
    uses = np.bincount(codes, minlength=len(names)) - np.bincount(codes[begins], minlength=len(names))
    place = pc.fill_null(pc.index_in(names, value_set=encoder.known), -1).to_numpy().astype(np.int64)
    new = np.flatnonzero((place < 0) & (uses > 0))
    encoder.known_uses[place[place >= 0]] += uses[place >= 0]
    words = names.take(pa.array(new))
    word_ids = encoder.words(words)

    # One table of ids: remembered words, new words, first words, whole texts.
    place[new] = len(encoder.known) + np.arange(len(new))
    codes = place[codes]
    at_first = len(encoder.known) + len(new)
    codes[begins] = at_first + first_codes
    whole = np.flatnonzero(unsafe.to_numpy(zero_copy_only=False))
    codes[begins[whole]] = at_first + len(first) + np.arange(len(whole))
    ids_of = pa.concat_arrays([
        encoder.known_ids, word_ids,
        encoder.whole(names.take(pa.array(first)).to_pylist()), encoder.whole(texts.filter(unsafe).to_pylist()),
    ])
    encoder.remember(words, word_ids, uses[new])

    taken = ids_of.take(pa.array(codes))
    _, offsets, data = taken.buffers()
    at = np.frombuffer(offsets, np.int64, len(taken) + 1) // 2
    ids = np.frombuffer(data, np.uint16, at[-1]) if data else np.empty(0, np.uint16)
    return ids, at[ends] - at[begins]


def encode(
    docs: DataFrame, path: str, end_id: int = END_ID, special: bool = True, ranges: Ranges | None = None
) -> DataFrame:
    """docs with n_tokens, ids (compressed little-endian uint16, end mark included) for the text.

    With ranges also the range of doc_id that a row belongs to.

    special: literals of added tokens become those tokens, as the library does by
    default; without it they are spelled out. A null text is encoded like an
    empty one: the end mark alone. Long texts are encoded whole, repeated rows
    each, and an empty table gives no rows. Ids must be below 65,536; a vocabulary
    with larger ones ends in an OverflowError.
    """
    kept = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*kept).dtypes)
    if ranges:
        docs = docs.withColumn("_part", F.pmod(F.xxhash64("text"), F.lit(SPREAD)))
        schema += ", range long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for part in large_batches(batches, "text", 12 << 20):
            ids, counts = encode_texts(part["text"].combine_chunks(), path, special)
            ends = np.cumsum(counts)
            packed = []
            for start, stop in zip(ends - counts, ends, strict=True):
                packed.append(squeeze.compress(np.append(ids[start:stop], np.uint16(end_id)).tobytes()))
            arrays = {c: part[c].combine_chunks() for c in kept}
            if ranges:
                arrays["range"] = ranges.numbers(arrays["doc_id"], part["_part"].combine_chunks())
            arrays |= {"n_tokens": pa.array(counts + 1), "ids": pa.array(packed, pa.binary())}
            yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    return docs.mapInArrow(run, f"{schema}, n_tokens long, ids binary")


#: Parts that the rows of one range are dealt to if no id separates them: null ids, and an id with many rows.
SPREAD = 16


class Ranges:
    """Numbers of ranges of doc_id, found by binary search: ascending with doc_id, null ids first.

    Rows without an id, and those of an id that alone fills a range, are dealt
    further by a hash of their text, so that no task holds them all; their
    parts follow each other.
    """

    def __init__(self, docs: DataFrame, ranges: int) -> None:
        cuts = range_cuts(docs.select(F.col("doc_id").cast("long")), "doc_id", ranges)
        values, times = np.unique(np.array(cuts, np.int64), return_counts=True)
        self.crowded = values[times > 1]
        # Each of them has a range of its own.
        self.cuts = np.unique(np.concatenate([values, self.crowded[self.crowded < 2**63 - 1] + 1]))

    def numbers(self, doc_ids: pa.Array, parts: pa.Array) -> pa.Array:
        null = pc.is_null(doc_ids).to_numpy(zero_copy_only=False)
        ids = pc.fill_null(doc_ids, 0).to_numpy(zero_copy_only=False)
        place = np.where(null, 0, 1 + np.searchsorted(self.cuts, ids, side="right"))
        spread = null | np.isin(ids, self.crowded)
        return pa.array(place * SPREAD + np.where(spread, parts.to_numpy(), 0), pa.int64())


# ---------------------------------------------------------------- files


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


#: Tokens of one file, about: a range that holds more gives several files.
FILE_TOKENS = 16 << 20


def write(encoded: DataFrame, folder: str) -> DataFrame:
    """Write shard files in ascending doc_id order; the list of files, also kept in folder/files.

    encoded has doc_id, range, n_tokens, ids; the documents of a range are
    written in order, to files named by range and number. A file appears under
    its name only when it is whole, and a repeated task writes the same bytes
    again, so a lost executor leaves no half file. Null ids come first; rows
    that share an id are ordered by their ids' bytes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        store.create_dir(f"{top}/shards", recursive=True)
        opener = zstandard.ZstdDecompressor()
        doc_ids: list[int | None] = []
        counts: list[int] = []
        ids: list[np.ndarray] = []
        now, number, held = None, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            name = f"{now:06d}-{number:06d}.dac"
            draft = f"{top}/shards/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                for piece in shard_bytes(doc_ids, counts, np.concatenate(ids)):
                    out.write(piece)
            store.move(draft, f"{top}/shards/{name}")
            row = {"range": now, "number": number, "name": name, "docs": len(counts), "tokens": held}
            number, held = number + 1, 0
            doc_ids.clear(), counts.clear(), ids.clear()
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("range", "doc_id", "n_tokens", "ids"))
            for place, doc_id, n, packed in zip(*columns, strict=True):
                if place != now or held >= FILE_TOKENS:
                    if counts:
                        yield flush()
                    if place != now:
                        now, number = place, 0
                doc_ids.append(doc_id)
                counts.append(n)
                held += n
                ids.append(np.frombuffer(opener.decompress(packed), np.uint16))
        if counts:
            yield flush()

    ordered = encoded.repartition("range").sortWithinPartitions("range", "doc_id", "ids")
    files = ordered.select("range", "doc_id", "n_tokens", "ids").mapInArrow(
        run, "range long, number long, name string, docs long, tokens long")
    files.write.parquet(f"{folder}/files")
    return encoded.sparkSession.read.parquet(f"{folder}/files")


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder in order, with the tokens before each; one row per file."""
    files = spark.read.parquet(f"{folder}/files")
    ahead = Window.orderBy("range", "number").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("before", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)))


#: Tokens decoded at once where all documents of a file are read, about.
READ_TOKENS = 1 << 18


def documents(shard: Shard) -> Iterator[np.ndarray]:
    """The ids of each document in turn, as little-endian uint32; small documents are decoded together."""
    offsets, k = shard.offsets, 0
    while k < len(shard.doc_ids):
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + READ_TOKENS, side="right")) - 1)
        ids = shard.slice(int(offsets[k]), int(offsets[stop])).astype("<u4")
        for a, b in itertools.pairwise((offsets[k : stop + 1] - offsets[k]).tolist()):
            yield ids[a:b]
        k = stop


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        for batch in batches:
            for name, before in zip(batch["name"].to_pylist(), batch["before"].to_pylist(), strict=True):
                with store.open_input_file(f"{top}/shards/{name}") as file:
                    shard = Shard(file.read())
                sums = [zlib.crc32(ids) for ids in documents(shard)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, mask=shard.has_id == 0),
                        pa.array(shard.offsets[:-1] + before),
                        pa.array(np.diff(shard.offsets)),
                        pa.array(sums, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    listed = shards(spark, folder).select("name", "before")
    # Files are whole units of work; given a number, they aren't put together into one task.
    return listed.repartition(partitions_of(spark), "name").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_output(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    prepare(spark)
    out = new_path(spark, "tokens")
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = Ranges(docs, 2 * partitions_of(spark))
    write(encode(docs, public_tokenizers.path("byte_bpe_50k.json"), ranges=ranges), out)
    return read(spark, out)
