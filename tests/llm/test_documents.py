"""Operators without SQL, against plain Python, a round trip or held-out accuracy."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import public_tokenizers
from tillroll.llm import fingerprint, language, neardup, packing, sentence, tokenstore
from tillroll.llm.components import components

SMALL = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

HARD = [
    None, "", " ", "  ", " a b", "a  b", "a b ", "it's I'll don't", "x\n y", "x \ny", "\n\n", "tab\tq\u3000d",
    "日本語 テキスト \U0001f600\U0001f600", "<|endoftext|> <s></s><unk><0x41>", "\u2581x \u2581", "\x00a", "a\u00a0 b",
    "a" * 300, "abab" * 80, "the" * 300 + " x", "é e\u0301 'S 's", "=" * 77 + " " * 77, "A b C\r\nd",
]


def random_texts(n: int, seed: int) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(" ab\tétheonin\u2581  .,") for _ in range(rnd.randint(1, 60))) for _ in range(n)]


def rows_of(spark, texts, more=""):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# --- token files


def test_spelled_out_literals_encode_like_whole_texts():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    texts = [*HARD, *random_texts(500, 1)]
    ids, counts = tokenstore.encode_texts(pa.array(texts, pa.string()), BPE, special=False)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == list(itertools.chain(*want))


def test_pieces_encode_like_the_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BPE)
    texts = [*HARD, *random_texts(100, 2), "end <|endoftext|> next", "a b<|endoftext|>c d", " <|endoftext|>",
             "<|endoftext|>", "x <|endoftext| y"]
    ids, counts = tokenstore.encode_texts(pa.array(texts, pa.string()), BPE)
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == list(itertools.chain(*want))
    spelled, _ = tokenstore.encode_texts(pa.array(["end <|endoftext|> next"]), BPE, special=False)
    assert spelled.tolist() != plain.encode("end <|endoftext|> next", add_special_tokens=False).ids


def test_words_of_earlier_batches_are_not_encoded_again(monkeypatch):
    import tokenizers

    handed = []

    class Counting:
        def __init__(self, inner):
            self.__dict__["inner"] = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def __setattr__(self, name, value):
            setattr(self.inner, name, value)

        def encode_batch_fast(self, texts, **more):
            handed.append(sum(map(len, texts)))
            return self.inner.encode_batch_fast(texts, **more)

    plain = tokenizers.Tokenizer.from_file(BPE)
    monkeypatch.setattr(tokenstore, "_held", {})
    monkeypatch.setattr(tokenizers, "Tokenizer", type("T", (), {"from_file": lambda path: Counting(plain)}))
    rnd = random.Random(3)
    once = [" ".join("".join(rnd.choices("aeinorst.,", k=9)) for _ in range(100)) for _ in range(20)]
    first, _ = tokenstore.encode_texts(pa.array(once), BPE)
    before = sum(handed)
    again, _ = tokenstore.encode_texts(pa.array(once), BPE)
    assert again.tolist() == first.tolist()
    assert sum(handed) - before < before / 20  # each text's first word only


@pytest.mark.parametrize("limit", [0, 1, 7, 100])
def test_remembered_words_stay_within_their_limit(monkeypatch, limit):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BPE)
    monkeypatch.setattr(tokenstore, "_held", {})
    monkeypatch.setattr(tokenstore, "REMEMBERED", limit)
    hard = [*HARD, "a \x0bb c", "a\x0b b", "x \x0b y", "a\u2003b \u2003c d\u2003 e", "w" * 50 + " " + "w" * 50]
    for seed in range(4):
        texts = [*hard, *random_texts(60, seed), "on a tin hen"]
        ids, counts = tokenstore.encode_texts(pa.array(texts, pa.string()), BPE)
        want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == list(itertools.chain(*want))
        assert len(tokenstore._encoder(BPE).known) <= limit


@pytest.mark.parametrize("widths", [(8, 8), (5, 6, 5), (10, 6)])
def test_codes_give_random_access(widths):
    r = np.random.RandomState(0)
    ids = np.where(r.rand(3000) < 0.4, r.randint(0, 30, 3000), r.randint(0, 65536, 3000)).astype(np.uint32)
    shard = tokenstore.Shard(b"".join(tokenstore.shard_bytes([None, 5, 7], [1000, 0, 2000], ids, widths)))
    assert [shard.token(k) for k in range(3000)] == ids.tolist()
    for _ in range(100):
        a, b = sorted(r.randint(0, 3001, 2))
        assert (shard.slice(a, b) == ids[a:b]).all()
    assert len(shard.document(1)) == 0 and (shard.document(2) == ids[1000:]).all()


@pytest.mark.parametrize("tokens", [1, 50, 10_000])
def test_documents_decoded_together(monkeypatch, tokens):
    monkeypatch.setattr(tokenstore, "READ_TOKENS", tokens)
    r = np.random.RandomState(1)
    counts = [0, 3, 0, 700, 1, 49, 50, 51, 0]
    ids = r.randint(0, 65536, sum(counts)).astype(np.uint32)
    shard = tokenstore.Shard(b"".join(tokenstore.shard_bytes(range(len(counts)), counts, ids)))
    got = list(tokenstore.documents(shard))
    assert [len(g) for g in got] == counts and np.concatenate(got).tolist() == ids.tolist()
    assert all((g == shard.document(k)).all() for k, g in enumerate(got))


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    docs = [(k * 3 % 41, t) for k, t in enumerate(HARD)] + [(None, "null id"), (2, "again"), (2, "again")]
    docs += [(50, "end <|endoftext|> next"), (51, "<|endoftext|>"), (2**63 - 1, "last"), (-(2**63), "first")]
    frame(spark, docs).selectExpr("*", "1 AS start", "'x' AS ids").write.parquet(
        str(tmp_path / "documents.parquet"))
    rows = tokenstore.op1_token_output(spark, str(tmp_path)).orderBy("start").collect()
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda d: (d is not None, d)) and len(rows) == len(docs)
    start, want = 0, {}
    for doc_id, text in docs:
        out = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.setdefault(doc_id, []).append((len(out), zlib.crc32(np.array(out, "<u4").tobytes())))
    for row in rows:
        assert row["start"] == start
        assert (row["n_tokens"], row["ids_crc32"]) in want[row["doc_id"]]
        start += row["n_tokens"]


def test_token_files_of_an_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert tokenstore.op1_token_output(spark, str(tmp_path)).collect() == []


def test_rows_of_one_id_or_none_are_dealt_out(spark):
    rows = [(None, f"n{k}") for k in range(300)] + [(7, f"s{k}") for k in range(300)]
    rows += [(k, f"o{k}") for k in range(300)]
    docs = frame(spark, rows)
    encoded = tokenstore.encode(docs, BPE, ranges=tokenstore.Ranges(docs, 8)).collect()
    per_range: dict[int, int] = {}
    for r in encoded:
        per_range[r["range"]] = per_range.get(r["range"], 0) + 1
    assert max(per_range.values()) < 150 and sum(per_range.values()) == len(rows)
    order = [r["doc_id"] for r in sorted(encoded, key=lambda r: (r["range"], r["doc_id"] or 0))]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))


# --- SentencePiece


def test_sentencepiece_ids_and_texts(spark, tmp_path):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [*HARD, *random_texts(800, 2)]
    docs = rows_of(spark, texts)
    encoded = sentence.encode(docs, PIECES)
    found = {r["doc_id"]: list(r["ids"]) for r in encoded.collect()}
    back = {r["doc_id"]: r["text"] for r in sentence.decode(encoded, PIECES).collect()}
    sums = {r["doc_id"]: r for r in sentence.digests(docs, PIECES).collect()}
    for k, text in enumerate(texts):
        want = library.encode(text or "")
        assert found[k] == want and back[k] == library.decode(want)
        assert sums[k]["n_tokens"] == len(want)
        assert sums[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert sums[k]["decoded_sha256"] == hashlib.sha256(library.decode(want).encode()).hexdigest()
    assert sentence.digests(docs.limit(0), PIECES).count() == 0


def test_sentencepiece_decodes_any_ids():
    import sentencepiece

    library, model = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentence.model_of(PIECES)
    r = np.random.RandomState(0)
    for _ in range(300):
        ids = np.where(r.rand(12) < 0.4, r.randint(3, 259, 12), r.randint(3, 32000, 12))
        assert model.decode(ids, np.array([12]))[0].decode() == library.decode(ids.tolist())


# --- language


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = language.op4_language_id(spark, "/root/testdata/sf0.1").filter("held_out")
    both = found.join(docs.select("doc_id", "lang"), "doc_id").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in both)
    assert right >= 0.98 * len(both) and all(0 <= r["score"] <= 1 for r in both)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in both)


def test_language_predictions_equal_a_plain_loop(spark):
    import zstandard

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    contents = language.dictionaries(docs)
    share = max(min(map(len, contents.values())), language.LEAST_SHARE)
    makers = {
        k: zstandard.ZstdCompressor(level=language.LEVEL, write_content_size=False, write_checksum=False,
                                    dict_data=zstandard.ZstdCompressionDict(c[-share:], zstandard.DICT_TYPE_RAWCONTENT))
        for k, c in sorted(contents.items())
    }
    given = docs.select("doc_id", "text", language.letters_only().alias("letters")).collect()
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, contents, ["doc_id"]).collect()}
    for row in given:
        data = row["letters"].encode()
        sizes = {
            k: sum(len(m.compress(data[at : at + 2048])) for at in range(0, len(data), 2048)) for k, m in makers.items()
        }
        want = min(sizes, key=lambda k: (sizes[k], k)) if re.search(r"[^\W\d_]", row["text"] or "") else "und"
        assert found[row["doc_id"]] == want


@pytest.mark.parametrize("search", [1, 4])
def test_language_sample_is_that_of_a_full_ranking(spark, monkeypatch, search):
    monkeypatch.setattr(language, "SAMPLE_DOCS", 6)
    monkeypatch.setattr(language, "SEARCH", max(search, 2))
    rnd = random.Random(search)
    rows = [
        (rnd.choice([None, 3, 3, k]), f"text {'abcdefghij'[k % 10] * rnd.choice((5, 300))}", rnd.choice(["aa", "bb", "bb", None]))
        for k in range(300)
    ]
    rows += [(1000 + k, "cc", "cc") for k in range(3)] + [(2000, None, "dd"), (2001, "123", "ee")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    ranked = docs.filter(~language.held_out() & docs.lang.isNotNull() & docs.text.rlike(r"\p{L}")).select(
        "lang", F.xxhash64("doc_id").alias("h"), language.letters_only().alias("text")).collect()
    want: dict[str, list] = {}
    for r in sorted(ranked, key=lambda r: (len(r["text"]) < 200, r["h"], r["text"])):
        want.setdefault(r["lang"], []).append(r["text"][: language.SAMPLE_CHARS])
    found = language._sample(docs)
    assert {k: v for k, v in found.items() if v} == {k: v[:6] for k, v in want.items()}


def test_language_of_awkward_rows(spark):
    words = {"aa": "lorem ipsum dolor sit amet ", "bb": "xqz vvk wjx qqv zzk "}
    rows = [(k, words[lang] * 20, lang) for k in range(40) for lang in words]
    odd = [(100, None, "aa"), (101, "", None), (102, "12 34 !!", "bb"), (None, words["aa"] * 9, None),
           (103, words["bb"] * 3000, None), (103, words["bb"] * 3000, None)]
    docs = spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string")
    contents = language.dictionaries(docs)
    out = language.predict(docs, contents, ["doc_id"]).collect()[-6:]
    assert [r["lang_pred"] for r in out] == ["und", "und", "und", "aa", "bb", "bb"]
    assert [r["rejected"] for r in out] == [True] * 3 + [False] * 3
    kept = language.keep(docs.withColumn("score", docs.doc_id), contents)
    assert kept.columns == ["doc_id", "text", "lang", "score"] and kept.count() == 83
    unlabelled = docs.withColumn("lang", docs.lang.substr(9, 1)).filter("lang = 'x'")
    assert language.dictionaries(unlabelled) == {}
    assert {r["lang_pred"] for r in language.predict(docs, {}, ["doc_id"]).collect()} == {"und"}
    assert language.keep(docs.limit(0), contents).count() == 0


# --- near-duplicates


def brute_components(rows: list[tuple[int, str | None]], percent: int = 75) -> dict[int, int]:
    sets = {}
    for doc_id, text in rows:
        words = WORD.findall((text or "").translate(LOWER))
        sets[doc_id] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def near_rows() -> list[tuple[int, str | None]]:
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(4000)]
    rows: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE  two"), (5, "two one")]
    for group in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice((8, 40, 200)))]
        for _ in range(rnd.randint(2, 14)):
            copy = list(base)
            for _ in range(rnd.choice((0, 0, 1, 2, 5))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((len(rows), " ".join(copy)))
    passage = " ".join(rnd.choice(words) for _ in range(60))
    for _ in range(60):
        rows.append((len(rows), passage + " " + " ".join(rnd.choice(words) for _ in range(rnd.randint(5, 60)))))
    ids = list(range(len(rows)))
    rnd.shuffle(ids)
    return [(i, t) for i, (_, t) in zip(ids, rows, strict=True)]


@pytest.mark.parametrize("block", [1024, 8])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = near_rows()
    want = brute_components(rows)
    found = neardup.near_duplicates(frame(spark, rows).selectExpr("*", "doc_id AS component_id")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_duplicates_of_awkward_rows(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (None, "z"), (3, "A B C D E F"),
            (9, "x y"), (9, "p q r s t u"), (1, None)]
    found = neardup.near_duplicates(frame(spark, rows)).collect()
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in found)
    assert got == sorted([
        ("7", 2, "3", False), ("7", 2, "3", False), ("None", 2, "3", False), ("None", 1, "None", True),
        ("3", 2, "3", True), ("9", 1, "9", True), ("9", 2, "9", True), ("1", 0, "1", True)])
    kept = neardup.keep(frame(spark, rows).selectExpr("*", "'l' AS lang"))
    assert kept.columns == ["doc_id", "text", "lang"] and kept.count() == 5
    assert neardup.near_duplicates(frame(spark, []).limit(0)).count() == 0


def test_near_copies_without_or_with_one_id(spark):
    words = [f"w{k}" for k in range(60)]
    near = [" ".join([*words[:k], "x", *words[k + 1 :]]) for k in (0, 59)]
    base = " ".join(words)
    far = " ".join(f"v{k}" for k in range(60))
    other = [far, far.upper(), far + " end"]
    rows = [(5, base), (None, near[0]), (None, near[1]), *((None, t) for t in other)]
    found = neardup.near_duplicates(frame(spark, rows)).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(5, 5), (None, 5), (None, None)}
    assert sum(r["kept"] for r in found) == 2
    assert [r["doc_id"] for r in found if r["kept"] and r["component_id"] == 5] == [5]
    shared = [(5, base), (5, near[0]), (5, near[1]), (6, base)]
    kept = neardup.keep(frame(spark, shared)).collect()
    assert len(kept) == 1 and kept[0]["doc_id"] == 5


def test_keys_meet_under_the_distance():
    r = np.random.RandomState(1)
    a = r.randint(0, 65536, (50, neardup.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[r.permutation(neardup.SYMBOLS)[: neardup.DISTANCE]] += 1
    assert all(set(x) & set(y) for x, y in zip(neardup.keys_of(a).tolist(), neardup.keys_of(b).tolist()))


def test_components_of_a_long_chain(spark):
    links = [(k, k + 1) for k in range(200)] + [(500, 501), (501, 501), (None, 3), (501, 500)]
    found = {r["node"]: r["component"] for r in components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(201)}, 500: 500, 501: 500}


# --- packing


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_have_least_padding(seed):
    r = np.random.RandomState(seed)
    counts = r.randint(0, 9, 11) * (r.rand(11) < 0.8)
    counts[r.randint(11)] += 1

    def cost(ends):
        return sum(c * (min(e for e in ends if e >= k) + 1) for k, c in enumerate(counts) if c)

    last = int(np.flatnonzero(counts)[-1])
    for buckets in (1, 2, 3, 5):
        best = min(cost((*e, last)) for n in range(buckets) for e in itertools.combinations(range(last), n))
        ends = packing.boundaries(counts, buckets)
        assert len(ends) <= buckets and cost(ends) == best


def test_packing_places_every_token(spark):
    how = packing.Packing(window=64, step=4, buckets=4, budget=256, shard_rows=8)
    rnd = random.Random(2)
    rows = [(k, "x" * rnd.choice((0, 3, 9, 30, 63, 64, 130, 1000))) for k in range(80)]
    rows += [(5, None), (5, None), (None, "é" * 40)]
    out = packing.pack(frame(spark, rows).selectExpr("*", "1 AS bucket"), how=how).collect()
    total = {}
    batches = {}
    for r in out:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
        assert 1 <= r["length"] <= r["bucket_length"] <= 64 and r["start"] == 64 * r["piece"]
        batches.setdefault((r["bucket"], r["shard"], r["batch"]), []).append((r["slot"], r["bucket_length"]))
    want = {}
    for d, t in rows:
        want[d] = want.get(d, 0) + len((t or "").encode()) + 1
    assert total == want
    for slots in batches.values():
        assert sorted(s for s, _ in slots) == list(range(len(slots)))
        assert sum(n for _, n in slots) <= 256
    assert packing.pack(frame(spark, rows).limit(0), how=how).count() == 0
    given = frame(spark, [(1, "a"), (2, "b")]).selectExpr("*", "CASE WHEN doc_id = 2 THEN 70 END AS n")
    out = packing.pack(given, given.n, how=how).orderBy("doc_id", "piece").collect()
    assert [(r["doc_id"], r["length"]) for r in out] == [(1, 1), (2, 64), (2, 6)]


# --- fingerprints


def test_fingerprints_of_neighbours(spark):
    rnd = random.Random(4)
    words = [f"term{k}" for k in range(300)]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 90)))) for k in range(60)]
    rows += [(60, None), (61, ""), (62, "the end"), (63, rows[0][1]), (64, "日本語 \U0001f600 " * 50)]
    docs = frame(spark, rows)
    known = fingerprint.lexicon(docs)
    for ranges in (1, 7):
        out = {r["doc_id"]: r for r in fingerprint.compare_neighbours(docs, known, ranges).collect()}
        assert len(out) == len(rows)
        order = sorted((d for d, _ in rows), reverse=True)
        texts = {d: t or "" for d, t in rows}
        for d, following in zip(order, [*order[1:], order[0]], strict=True):
            text, half = texts[d], len(texts[d]) // 2
            edited = text[: len(text) - half] + texts[following][:half]
            assert out[d]["n_chars"] == len(text)
            assert out[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            (own, changed, next_), subsets = fingerprint.fingerprints(
                pa.array([text, edited, texts[following]]), known)
            assert (out[d]["fingerprint"], out[d]["edited_fingerprint"]) == (own, changed)
            assert out[d]["near_edited"] == fingerprint.likeness(own, changed, subsets[0], subsets[1])
            assert out[d]["near_next"] == fingerprint.likeness(own, next_, subsets[0], subsets[2])
    assert out[0]["fingerprint"] == out[63]["fingerprint"]


@pytest.mark.parametrize("length", [8, 40, 150, 400, 1000])
def test_edited_texts_are_nearer_than_others(length):
    import xxhash

    rnd = random.Random(length)
    words = [f"term{k}" for k in range(40_000)]
    known = np.sort(np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64))
    edited, other = [], []
    for _ in range(60):
        a, b = rnd.sample(words, length), rnd.sample(words, length)
        texts = [" ".join(t) for t in (a, a[: length // 2] + b[: length // 2], b)]
        found, subsets = fingerprint.fingerprints(pa.array(texts), known)
        edited.append(fingerprint.likeness(found[0], found[1], subsets[0], subsets[1]))
        other.append(fingerprint.likeness(found[0], found[2], subsets[0], subsets[2]))
    assert np.mean(np.array(edited) > 0) > 0.8
    assert np.mean(edited) > 5 * np.mean(other) and np.mean(np.array(edited) > np.array(other)) > 0.75


def test_every_term_is_in_a_subset():
    value = np.random.RandomState(0).randint(0, 2**63, 5000).astype(np.uint64)
    at, subset = fingerprint._members(value)
    assert np.bincount(at).min() >= 2 and set(subset.tolist()) == set(range(fingerprint.SUBSETS))


def test_lexicon_is_the_band(spark):
    rows = [(k, f"Common, rare{k} pair{k // 2} common") for k in range(40)]
    known = fingerprint.lexicon(frame(spark, rows))
    import xxhash

    want = sorted(xxhash.xxh64_intdigest(f"pair{k}") for k in range(20))
    assert known.tolist() == want


def test_fingerprints_of_few_rows(spark):
    one = fingerprint.compare_neighbours(frame(spark, [(1, "a b")]), np.empty(0, np.uint64), 4).collect()
    assert [(r["near_next"], r["n_chars"]) for r in one] == [(1.0, 3)]
    odd = [(None, "x"), (None, "y"), (2, "q"), (2, "q")]
    assert fingerprint.compare_neighbours(frame(spark, odd), np.empty(0, np.uint64), 4).count() == 4
    assert fingerprint.compare_neighbours(frame(spark, odd).limit(0), np.empty(0, np.uint64), 4).count() == 0
