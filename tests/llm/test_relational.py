"""Operators that SQL can express, against their SQL on a stored table and on awkward rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from tillroll.llm import chat, lm, quality, warc

SMALL = "/root/testdata/sf0.001"

DOCS = [
    (1, "the of and to a in is that it for on with as was"),
    (2, None),
    (3, ""),
    (4, "   \n\t \x0b "),
    (5, "a b c d e " * 30),
    (5, "a b c d e " * 30),
    (None, "null id with eleven words in it and a few more words"),
    (7, "### $$$ %%% &&& *** ||| <<< >>> ### $$$ %%%"),
    (8, "same line here\nsame line here\nsame line here\n\n \nother line of the text"),
    (9, "word " * 20000),
    (10, "Größe ÉTÉ 日本語 \U0001f600 ß\u00a0x"),
]


def compare(spark, frame, sql: str, tables: dict[str, object], keys: list[str]) -> None:
    db = duckdb.connect()
    for name, table in tables.items():
        db.register(name, table)
    want = db.sql(sql)
    columns = sorted(frame.columns)
    assert sorted(want.columns) == columns
    ours = sorted(map(repr, ([row[c] for c in columns] for row in frame.collect())))
    theirs = sorted(map(repr, (list(r) for r in want.project(", ".join(columns)).fetchall())))
    assert ours == theirs


def test_quality_measures_match_sql(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    first = quality.judge(docs)
    compare(spark, first, quality.SQL, {"documents": docs.toPandas().astype({"doc_id": "Int64"})}, ["doc_id"])


def test_quality_keeps_rows_as_they_are(spark):
    docs = spark.createDataFrame(
        [(1, DOCS[0][1] + " n", 5, True), (2, None, 6, None), (3, DOCS[7][1], 7, False)],
        "doc_id long, text string, n_words int, kept boolean")
    rows = quality.keep(docs).collect()
    assert [tuple(r) for r in rows] == [(1, DOCS[0][1] + " n", 5, True)]
    assert quality.keep(docs.limit(0)).columns == docs.columns
    assert quality.judge(docs).columns.count("n_words") == 1


@pytest.mark.parametrize("n, words", [(0, []), (1, ["x"]), (4, ["a", "b", "a", "b"])])
def test_quality_short_texts(spark, n, words):
    row = quality.judge(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert (row["n_words"], row["n_repeat_words"], row["kept"]) == (n, 0, False)


def test_windows_count_each_word_once(spark):
    text = " ".join([*"abcdefg", *"xyz", *"abcdefg", "q"])
    row = quality.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_repeat_words"] == 14 and row["base_failed"]


def test_lm_matches_sql(spark, tmp_path):
    docs = spark.createDataFrame([d for d in DOCS if d[0] not in (5, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    frame = lm.op10_lm_scoring(spark, str(tmp_path))
    compare(spark, frame, lm.SQL, {"documents": docs.toPandas()}, ["doc_id"])


def test_lm_backs_off_and_scores_other_documents(spark):
    train = spark.createDataFrame([(1, "abab"), (2, "abc"), (3, None)], "doc_id long, text string")
    places = lm.postings(train)
    from pyspark.sql import functions as F

    seen = places.select("gram", F.aggregate(
        "times", F.lit(0).cast("long"), lambda t, n: t + n).alias("n"))
    score = lm.scores(lm.count_tables(seen))
    other = spark.createDataFrame([(7, "ab"), (7, "ab"), (8, "zz"), (9, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in lm.score_documents(other, lm.postings(other), score, -9.0).collect()}
    # "a" at the start 2 of 2, then "b" 2 of 2: certain. z was never seen.
    assert rows[7]["n_chars"] == 4 and rows[7]["log_score"] == 0.0
    assert rows[8]["log_score"] == -18.0 and rows[9]["perplexity"] is None
    assert lm.score_documents(other.limit(0), lm.postings(other.limit(0)), score, -9.0).count() == 0


def test_word_scoring_matches_sql(spark, tmp_path):
    docs = spark.createDataFrame([d for d in DOCS if d[0] not in (5, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    frame = lm.op10_word_scoring(spark, str(tmp_path))
    compare(spark, frame, lm.WORD_SQL, {"documents": docs.toPandas()}, ["doc_id"])


def test_word_scoring_sees_the_order_of_words(spark):
    train = spark.createDataFrame([(1, "a b c"), (2, "A b  c"), (3, None)], "doc_id long, text string")
    from pyspark.sql import functions as F

    pairs = lm.pair_counts(lm.word_postings(train).select("gram", F.aggregate(
        "times", F.lit(0).cast("long"), lambda t, n: t + n).alias("n")))
    assert {r["gram"]: r["count"] for r in pairs.collect()} == {" a": 2, "a b": 2, "b c": 2}
    other = spark.createDataFrame([(7, "a b c"), (8, "c b a"), (9, "a z"), (10, " ")], "doc_id long, text string")
    places = lm.word_postings(other)
    wanted = places.select("gram").distinct().join(pairs, "gram", "left").fillna(0, ["count"])
    score = lm.word_scores(wanted, pairs, unseen=-9.0)
    rows = {r["doc_id"]: r for r in lm.score_documents(other, places, score, -9.0).collect()}
    assert rows[7]["log_score"] == 0.0 and rows[9]["log_score"] == -9.0
    # No pair of "c b a" was seen: each word is a third of all words, discounted once.
    assert rows[8]["mean_log_score"] == pytest.approx(math.log(0.4 / 3), abs=1e-5)
    assert rows[10]["perplexity"] is None


PAGES = [
    (3, "u", "x" * 150), (1, "u", "x" * 150), (2, "u\r\nv", "x" * 150), (4, None, None), (5, "u", ""),
    (6, "u", "short"), (7, "u", "short"), (8, "u", "é" * 70), (9, "u", "é" * 70), (10, "u", "z" * 700000),
]


def test_warc_matches_sql(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    compare(spark, warc.op6_warc(spark, str(tmp_path)), warc.SQL, {"pages": pages.toPandas()}, ["page_id"])


def test_warc_chunks_join_to_payloads(spark, tmp_path):
    import hashlib
    import random

    rnd = random.Random(3)
    big = "".join(rnd.choice("abcdefgh \n") for _ in range(900_000))
    pages = spark.createDataFrame(
        [(1, "u", big), (None, "u", "n" * 120), (2, "u", "n" * 120)],
        "page_id long, url string, html string")
    warc.write(warc.with_roles(pages.withColumn("payload", pages.url)), str(tmp_path / "w"))
    rows = warc.read_chunks(spark, str(tmp_path / "w")).orderBy("page_id", "chunk").collect()
    parts = [r for r in rows if r["page_id"] == 1]
    assert len(parts) == 4 and max(len(p["data"]) for p in parts) <= warc.CHUNK
    joined = b"".join(p["data"] for p in parts)
    assert joined == big.encode() and parts[-1]["digest"] == hashlib.sha256(joined).hexdigest()
    assert parts[0]["digest"] == hashlib.sha256(parts[0]["data"]).hexdigest()
    missing = [r for r in rows if r["page_id"] is None]
    assert [(r["record_type"], r["refers_to"]) for r in missing] == [("revisit", 2)]
    empty = pages.limit(0)
    warc.write(warc.with_roles(empty), str(tmp_path / "e"))
    assert warc.read_chunks(spark, str(tmp_path / "e")).count() == 0


TURNS = [
    (1, 0, "user", "a\\b </turn> <turn>x"), (1, 1, "assistant", "\\</turn>\\\\<part:image:0>"),
    (1, 1, "assistant", "tie"), (2, 0, None, None), (2, 1, "assistant", ""), (None, 0, "user", "n"),
    (3, 0, "ro\nle\\n<turn>", "é\U0001f600\n"), (3, 0, "ro\nle\\n<turn>", "é\U0001f600\n"), (4, None, "user", "x"),
]
TURN_COLUMNS = "conv_id long, turn long, role string, text string"


def test_chat_matches_sql(spark, tmp_path):
    turns = spark.createDataFrame(TURNS, TURN_COLUMNS)
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    frame = turns.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})
    frame.loc[frame.turn.isna(), "turn"] = -1  # nulls come first there too
    compare(spark, chat.op9_chat_formatting(spark, str(tmp_path)), chat.SQL, {"conversations": frame}, ["conv_id"])


def test_chat_comes_back(spark):
    turns = spark.createDataFrame(TURNS, TURN_COLUMNS)
    back = chat.read_turns(chat.format_turns(turns)).collect()
    ours = sorted((repr(r["conv_id"]), repr(r["turn"]), r["role"], r["text"]) for r in back)
    assert ours == sorted((repr(c), repr(t), r or "", x or "") for c, t, r, x in TURNS)
    for row in back:
        assert row["loss_text"] == (row["text"] if row["role"] == "assistant" else None)
    assert chat.digests(chat.read_turns(chat.format_turns(turns.limit(0)))).count() == 0


def test_chat_parts(spark):
    from pyspark.sql import functions as F

    parts = f"array<{chat.PART}>"
    rows = spark.createDataFrame(
        [(1, 0, "user", None, [
            ("text", "see <part:image:9> ", None, None, None, None, None),
            ("image", None, "i.png", 57, 28, None, None), ("audio", None, "a.wav", None, None, 2.01, None),
            ("text", "\\end", None, None, None, None, None), ("document", None, "d.pdf", None, None, None, 3)]),
         (1, 1, "user", None, None)],
        f"{TURN_COLUMNS}, content {parts}")
    first, second = chat.format_turns(rows, F.col("content")).orderBy("turn").collect()
    assert first["formatted"] == (
        "<turn>user\nsee \\<part:image:9> <part:image:0><part:audio:1>\\\\end<part:document:2></turn>")
    assert [(a["place"], a["ref"], a["tokens"]) for a in first["attachments"]] == [
        (0, "i.png", 3), (1, "a.wav", 51), (2, "d.pdf", 768)]
    assert first["expanded_tokens"] == 822
    assert second["formatted"] == "<turn>user\n</turn>" and second["expanded_tokens"] == 0
