"""SentencePiece BPE ids and texts by vectorised merge rounds, from a model file's pieces."""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import large_batches, table

SPACE = "▁"
NONE = np.iinfo(np.int32).max
#: Characters of a word from which on pairs are merged one by one.
LONG = 200
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    """Symbols, merges and byte spellings of a BPE model with byte fallback.

    A symbol is a piece id, or for a character that is no piece a number from
    unknown_from on, the character's code point added.
    """

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            data = file.read()
        pieces: list[tuple[str, float, int]] = []
        for field, value in _fields(data):
            if field == 1:
                part = dict(_fields(value))
                score = struct.unpack("<f", part[2])[0] if 2 in part else 0.0
                pieces.append((part[1].decode(), score, part.get(3, NORMAL)))
        self.size = len(pieces)
        self.unknown_from = self.size
        ids = {p: k for k, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.byte_ids = np.zeros(256, np.int32)
        spelt: list[bytes] = []
        for k, (piece, _, kind) in enumerate(pieces):
            if kind == BYTE:
                value = int(piece[3:5], 16)
                self.byte_ids[value] = k
                spelt.append(bytes([value]))
            elif kind == NORMAL:
                spelt.append(piece.replace(SPACE, " ").encode())
            else:
                spelt.append(" ⁇ ".encode() if kind == UNKNOWN else b"")
        self.is_byte = np.array([kind == BYTE for _, _, kind in pieces])
        self.control = np.array([kind == CONTROL for _, _, kind in pieces])
        self.spelling = np.frombuffer(b"".join(spelt), np.uint8)
        self.spelling_size = np.array([len(s) for s in spelt], np.int64)
        self.spelling_start = np.cumsum(self.spelling_size) - self.spelling_size
        self.opens_blank = np.array([kind == NORMAL and p[0] == SPACE for p, _, kind in pieces])

        self.symbol_of = np.full(0x110000, -1, np.int32)
        for piece, k in ids.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = k
        missing = self.symbol_of < 0
        self.symbol_of[missing] = self.unknown_from + np.flatnonzero(missing)

        # Rank: pieces by falling score; equal scores share a rank, so the leftmost pair wins.
        scores = np.array([pieces[k][1] for k in ids.values()])
        rank = dict(zip(ids, np.unique(-scores, return_inverse=True)[1].tolist(), strict=True))
        found: dict[int, tuple[int, int]] = {}
        for piece, k in ids.items():
            for cut in range(1, len(piece)):
                left, right = self._symbol(piece[:cut], ids), self._symbol(piece[cut:], ids)
                if left is not None and right is not None:
                    found[(left << 32) | right] = (rank[piece], k)
        if any(SPACE in p[1:] and p.strip(SPACE) for p in ids):
            raise ValueError("a piece of this model reaches over a blank")
        self.pairs = np.array(sorted(found), np.int64)
        values = [found[p] for p in self.pairs.tolist()]
        self.pair_rank = np.array([v[0] for v in values], np.int32)
        self.pair_id = np.array([v[1] for v in values], np.int32)

    def _symbol(self, text: str, ids: dict[str, int]) -> int | None:
        return int(self.symbol_of[ord(text)]) if len(text) == 1 else ids.get(text)

    def _merges(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if there is no such merge) and merged id of each pair."""
        keys = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.pairs, keys)
        at[at == len(self.pairs)] = 0
        hit = self.pairs[at] == keys
        return np.where(hit, self.pair_rank[at], NONE), self.pair_id[at]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words (each with its leading blank marks), and ids per word.

        Each round finds the least rank within each word, merges the leftmost
        pair of that rank in all words at once, and closes the gaps; words
        without a pair leave. Words of more than LONG characters, which would
        ask for as many rounds, are merged by a heap of their pairs.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        far = np.flatnonzero(lengths > LONG).tolist()
        short = [w if len(w) <= LONG else "" for w in words] if far else words
        lengths[far] = 0
        points = np.frombuffer("".join(short).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.symbol_of[points]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_owner, done_symbols = [], []
        for k in far:
            merged = self._merge_long(words[k])
            done_owner.append(np.full(len(merged), k))
            done_symbols.append(merged)

        rank = np.full(len(symbols), NONE, np.int32)
        into = np.zeros(len(symbols), np.int32)
        if len(symbols) > 1:
            inside = np.flatnonzero(owner[:-1] == owner[1:])
            rank[inside], into[inside] = self._merges(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            over = least == NONE
            if over.any():
                gone = np.repeat(over, sizes)
                done_owner.append(owner[gone])
                done_symbols.append(symbols[gone])
                stay = ~gone
                symbols, owner, rank, into = symbols[stay], owner[stay], rank[stay], into[stay]
                if not len(symbols):
                    break
                least, sizes = least[~over], sizes[~over]
                starts = np.cumsum(sizes) - sizes
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            at = at[np.append(True, owner[at[1:]] != owner[at[:-1]])]
            symbols[at] = into[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            changed = place[at]
            symbols, owner, rank, into = symbols[keep], owner[keep], rank[keep], into[keep]
            again = np.concatenate([changed, changed[changed > 0] - 1])
            rank[again] = NONE
            again = again[again + 1 < len(symbols)]
            again = again[owner[again] == owner[again + 1]]
            rank[again], into[again] = self._merges(symbols[again], symbols[again + 1])
        owner = np.concatenate([np.empty(0, np.int64), *done_owner])
        symbols = np.concatenate([np.empty(0, np.int32), *done_symbols])
        order = np.argsort(owner, kind="stable")
        return self._with_bytes(symbols[order], owner[order], len(words))

    def _merge_long(self, word: str) -> np.ndarray:
        """Symbols of one long word, merged pair by pair: least rank first, then leftmost."""
        symbols = self.symbol_of[np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks, ids = self._merges(symbols[:-1], symbols[1:])
        now = symbols.tolist()
        heap = [(int(ranks[k]), k, now[k], now[k + 1], int(ids[k])) for k in np.flatnonzero(ranks != NONE)]
        heapq.heapify(heap)

        def offer(k: int) -> None:
            if k >= 0 and after[k] >= 0:
                pair = (now[k] << 32) | now[after[k]]
                at = int(np.searchsorted(self.pairs, pair))
                if at < len(self.pairs) and self.pairs[at] == pair:
                    heapq.heappush(heap, (int(self.pair_rank[at]), k, now[k], now[after[k]],
                                          int(self.pair_id[at])))

        while heap:
            _, k, left, right, merged = heapq.heappop(heap)
            follower = after[k]
            if now[k] != left or follower < 0 or now[follower] != right:
                continue
            now[k], now[follower] = merged, -1
            after[k] = after[follower]
            if after[k] >= 0:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return np.array([s for s in now if s >= 0], np.int32)

    def _with_bytes(self, symbols: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Replace characters that are no piece by the ids of their bytes."""
        odd = np.flatnonzero(symbols >= self.unknown_from)
        if not len(odd):
            return symbols, np.bincount(owner, minlength=n)
        spelt = [chr(int(s) - self.unknown_from).encode() for s in symbols[odd]]
        times = np.ones(len(symbols), np.int64)
        times[odd] = [len(b) for b in spelt]
        out, owner = np.repeat(symbols, times), np.repeat(owner, times)
        ends = np.cumsum(times)
        for k, data in zip(odd, spelt, strict=True):
            out[ends[k] - len(data) : ends[k]] = self.byte_ids[list(data)]
        return out, np.bincount(owner, minlength=n)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 text of each run of ids: spellings in a row, without the blank put in front.

        Byte ids that form no character become the replacement character each.
        """
        ids = np.asarray(ids, np.int64)
        sizes = self.spelling_size[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        where = np.arange(total) + np.repeat(self.spelling_start[ids] - (ends - sizes), sizes)
        data = self.spelling[where].tobytes()
        stops = np.append(0, ends)[np.append(0, np.cumsum(counts))]
        texts, at = [], 0
        for k, n in enumerate(counts.tolist()):
            text = data[stops[k] : stops[k + 1]]
            mine = ids[at : at + n]
            at += n
            spoken = mine[~self.control[mine]] if n and self.control[mine[0]] else mine
            if len(spoken) and self.opens_blank[spoken[0]]:
                text = text[1:]
            texts.append(_repaired(text) if self.is_byte[mine].any() else text)
        return texts


def _repaired(data: bytes) -> bytes:
    """data with one replacement character for every byte that is part of no character."""
    out = []
    while data:
        try:
            data.decode()
            break
        except UnicodeDecodeError as error:
            out.append(data[: error.start] + "�".encode())
            data = data[error.start + 1 :]
    return b"".join([*out, data])


_models: dict[str, Model] = {}
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def model_of(path: str) -> Model:
    """The model of a file, read once in each Python worker."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode_texts(texts: pa.Array, path: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(ids, starts, sizes) of the distinct words, words of all texts by number, words per text.

    No piece has a blank mark behind another character, so texts fall into
    words at blanks. Each distinct word of the batch is merged once. A text
    with runs of blanks keeps a run together with the word after it.
    """
    model = model_of(path)
    texts = pc.fill_null(texts, "")
    runs = pc.match_substring_regex(texts, f"^ | $|  |{SPACE}")
    lists = pc.if_else(runs, pa.scalar([""], pa.list_(pa.string())), pc.split_pattern(texts, " "))
    coded = lists.flatten().dictionary_encode()
    words = [SPACE + w for w in coded.dictionary.to_pylist()]
    codes = coded.indices.to_numpy().astype(np.int64)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    special = np.flatnonzero(
        pc.or_(runs, pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False))
    if len(special):
        number = {w: k for k, w in enumerate(words)}
        pieces = np.split(codes, np.cumsum(counts)[:-1])
        for k in special.tolist():
            text = texts[k].as_py()
            found = _RUNS.findall(SPACE + text.replace(" ", SPACE)) if text else []
            pieces[k] = np.array([number.setdefault(w, len(number)) for w in found], np.int64)
            counts[k] = len(found)
        words, codes = list(number), np.concatenate(pieces)
    ids, sizes = model.encode_words(words)
    return [ids, np.cumsum(sizes) - sizes, sizes], codes, counts


def flat_ids(table: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
    """The ids of words by number, one after another."""
    ids, starts, sizes = table
    each = sizes[codes]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.arange(total) + np.repeat(starts[codes] - (ends - each), each)]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs' doc_id with ids (array<int>) of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in large_batches(batches, "text", 4 << 20):
            words, codes, counts = encode_texts(part["text"].combine_chunks(), path)
            owner = np.repeat(np.arange(len(counts)), counts)
            each = np.bincount(owner, weights=words[2][codes], minlength=len(counts)).astype(np.int32)
            offsets = pa.array(np.append(0, np.cumsum(each)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"].combine_chunks(),
                 pa.ListArray.from_arrays(offsets, pa.array(flat_ids(words, codes), pa.int32()))],
                ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id with the text of its ids; a null list is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ids"]
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            texts = model_of(path).decode(lists.flatten().to_numpy(), counts)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([t.decode() for t in texts], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, then decode the ids, per batch.

    Null texts count as empty, with no ids. Every row is encoded on its own;
    an empty table gives no rows. Batches are bounded by bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in large_batches(batches, "text", 12 << 20):
            words, codes, counts = encode_texts(part["text"].combine_chunks(), path)
            ids, starts, sizes = words
            flat = ids.tolist()
            spelt = [",".join(map(str, flat[s : s + n])) for s, n in zip(starts.tolist(), sizes.tolist(),
                                                                       strict=True)]
            listed, at, found = codes.tolist(), 0, []
            tokens = np.bincount(np.repeat(np.arange(len(counts)), counts), weights=sizes[codes],
                                 minlength=len(counts)).astype(np.int64)
            for n in counts.tolist():
                text = ",".join([spelt[c] for c in listed[at : at + n]])
                found.append(hashlib.sha256(text.encode()).hexdigest())
                at += n
            texts = model_of(path).decode(flat_ids(words, codes), tokens)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"].combine_chunks(), pa.array(tokens), pa.array(found, pa.string()),
                 pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
