"""Stupid backoff over character n-grams: counts, scores and sums as joins and aggregations.

The unit is the lower-case character. A text's positions each give one n-gram
of ORDER characters, the first ones filled up with a start mark; shorter
n-grams are suffixes, so their counts follow from the longest ones. An n-gram
is a long: 21 bits a character, exact for every code point.

Beside it, the same over pairs of lower-case words: a pair is a string, the
word before, a blank and the word, so it is exact too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import large_batches, table, words_of
from tillroll.session import stage

ORDER = 3
BITS = 21
#: Before a text's first character; no code point, so it meets nothing else.
START = 0x10FFFF + 1
ALPHA = 0.4
#: An n-gram seen less often is left out of the model, so that scoring backs off.
LEAST = 2
#: Texts whose n-grams are written down together.
BLOCK_BYTES = 2 << 20
#: The same for word pairs, most of which come back only in larger blocks.
WORD_BLOCK_BYTES = 16 << 20


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of every position of all texts, and the number of positions per text."""
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data = "".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(data, np.uint32).astype(np.int64)
    ends = np.cumsum(lengths)
    place = np.arange(len(points)) - np.repeat(ends - lengths, lengths)
    keys = points.copy()
    for back in range(1, ORDER):
        earlier = np.full(len(points), START, np.int64)
        earlier[back:] = points[: len(points) - back] if back < len(points) else points[:0]
        earlier[place < back] = START
        keys |= earlier << (BITS * back)
    return keys, lengths


def _characters(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    keys, lengths = grams(texts)
    codes, names = pd.factorize(keys)
    return codes.astype(np.int64), pa.array(names), lengths


def word_pairs(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The pair of every word of all texts as a place among distinct pairs, these, and words per text.

    Before a text's first word stands the empty word, which is no word itself.
    """
    words, ends = words_of(pc.utf8_lower(pc.fill_null(texts, "")))
    lengths = np.diff(ends)
    coded = words.dictionary_encode()
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = len(coded.dictionary)
    before = np.append(empty, word[:-1])[: len(word)]
    before[ends[:-1][lengths > 0]] = empty
    codes, cells = pd.factorize(before * (empty + 1) + word)
    first, last = np.divmod(cells, empty + 1)
    known = pa.concat_arrays([coded.dictionary, pa.array([""], coded.dictionary.type)])
    names = pc.binary_join_element_wise(known.take(pa.array(first)), known.take(pa.array(last)), " ")
    return codes.astype(np.int64), names, lengths


def postings(docs: DataFrame) -> DataFrame:
    """gram, docs, times: where an n-gram stands, for each block of texts; docs and times match."""
    return _postings(docs, _characters, "long", BLOCK_BYTES)


def word_postings(docs: DataFrame) -> DataFrame:
    """postings of word pairs."""
    return _postings(docs, word_pairs, "string", WORD_BLOCK_BYTES)


def _postings(docs: DataFrame, unit: Callable, kind: str, block: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in large_batches(batches, "text", block):
            codes, names, lengths = unit(part["text"].combine_chunks())
            if not len(codes):
                continue
            rows = len(lengths)
            owner = np.repeat(np.arange(rows), lengths)
            cells = codes * rows + owner
            if len(names) * rows <= 1 << 25:
                dense = np.bincount(cells)
                found = np.flatnonzero(dense)
                times = dense[found]
            else:
                found, times = np.unique(cells, return_counts=True)
            gram, at = np.divmod(found, rows)
            offsets = np.searchsorted(gram, np.arange(len(names) + 1)).astype(np.int32)
            ids = part["doc_id"].combine_chunks().take(pa.array(at))
            for low in range(0, len(names), 4096):
                high = min(low + 4096, len(names))
                cut = pa.array(offsets[low : high + 1] - offsets[low])
                size = int(offsets[high] - offsets[low])
                begin = int(offsets[low])
                yield pa.RecordBatch.from_arrays(
                    [
                        names.slice(low, high - low),
                        pa.ListArray.from_arrays(cut, ids.slice(begin, size)),
                        pa.ListArray.from_arrays(cut, pa.array(times[begin : begin + size], pa.int32())),
                    ],
                    ["gram", "docs", "times"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, f"gram {kind}, docs array<long>, times array<int>")


def _tail(gram, n: int):
    """The last n characters of an n-gram."""
    return gram.bitwiseAND(F.lit((1 << (BITS * n)) - 1)) if n else F.lit(0).cast("long")


def count_tables(grams_seen: DataFrame) -> dict[int, DataFrame]:
    """For n = 1..ORDER: gram, count, context_count (of the n-gram without its last character).

    grams_seen has gram and n of the longest n-grams. Shorter n-grams are
    aggregated from them. The context of the last one, without characters, is
    seen as often as there are positions.
    """
    counted = grams_seen.groupBy("gram").agg(F.sum("n").alias("count"))
    tables = {}
    for n in range(ORDER, 0, -1):
        level = stage(counted.groupBy(_tail(F.col("gram"), n).alias("gram"))
                      .agg(F.sum("count").alias("count")), f"grams-{n}")
        context = F.shiftrightunsigned("gram", BITS)
        totals = level.groupBy(context.alias("context")).agg(F.sum("count").alias("context_count"))
        tables[n] = level.withColumn("context", context).join(totals, "context").drop("context")
        counted = level
    return tables


def scores(tables: dict[int, DataFrame], least: int = LEAST, alpha: float = ALPHA) -> DataFrame:
    """gram, log_score of every n-gram of the longest kind that was counted.

    count / context count if it was seen often enough, else alpha times the
    score of the n-gram without its first character. At one character the
    count is taken as it is.
    """
    score = None
    for n in range(1, ORDER + 1):
        level = tables[n].select("gram", "count", "context_count")
        own = F.log(F.col("count") / F.col("context_count"))
        if score is None:
            score = level.select("gram", own.alias("log_score"))
            continue
        shorter = score.select(F.col("gram").alias("_tail"), F.col("log_score").alias("_shorter"))
        joined = level.withColumn("_tail", _tail(F.col("gram"), n - 1)).join(shorter, "_tail", "left")
        score = joined.select("gram", F.when(F.col("count") >= least, own)
                              .otherwise(F.col("_shorter") + float(np.log(alpha))).alias("log_score"))
    return score


def pair_counts(grams_seen: DataFrame) -> DataFrame:
    """gram, count of every word pair; grams_seen has gram and n."""
    return stage(grams_seen.groupBy("gram").agg(F.sum("n").alias("count")), "pairs")


def word_scores(
    wanted: DataFrame, pairs: DataFrame, unseen: float, least: int = LEAST, alpha: float = ALPHA
) -> DataFrame:
    """gram, log_score of the pairs in wanted (gram, count; count 0: not in the model).

    count / count of the word before it if it was seen often enough, else alpha
    times the word's share of all words; a word the model never saw gets unseen.
    Either case needs one table of single words, folded from the pairs.
    """
    first, last = F.substring_index("gram", " ", 1), F.substring_index("gram", " ", -1)
    before = pairs.groupBy(first.alias("word")).agg(F.sum("count").alias("seen"))
    words = pairs.groupBy(last.alias("word")).agg(F.sum("count").alias("seen"))
    total = pairs.agg(F.sum("count")).first()[0]
    often = wanted.filter(F.col("count") >= least).withColumn("word", first).join(before, "word").select(
        "gram", F.log(F.col("count") / F.col("seen")).alias("log_score"))
    rare = wanted.filter(F.col("count") < least).withColumn("word", last).join(words, "word", "left")
    share = F.log(F.col("seen") / F.lit(total).cast("long")) + float(np.log(alpha))
    return often.union(rare.select("gram", F.coalesce(share, F.lit(unseen)).alias("log_score")))


def score_documents(docs: DataFrame, places: DataFrame, score: DataFrame, unseen: float) -> DataFrame:
    """doc_id, n_chars, log_score, mean_log_score, perplexity of every doc_id.

    places are postings of docs, joined to score by n-gram; an n-gram that the
    model never saw gets the score unseen. Null and empty texts have no
    position, score 0 and null means. Rows that share a doc_id, null included,
    are scored as one document. An empty table gives no rows.
    """
    pair = F.explode(F.arrays_zip("docs", "times")).alias("p")
    each = places.join(score, "gram", "left").select(
        pair, F.coalesce("log_score", F.lit(unseen)).alias("s"))
    # Sums in units of 2**-20: exact in any order, so a rerun gives the same digits.
    unit = F.round(F.col("s") * (1 << 20)).cast("long")
    sums = each.groupBy(F.col("p.docs").alias("doc_id")).agg(
        F.sum(F.col("p.times").cast("long")).alias("n_chars"),
        F.sum(F.col("p.times") * unit).alias("total"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.lit(None).cast("long").alias("n_chars"), F.lit(None).cast("long").alias("total"))
    whole = sums.union(ids).groupBy("doc_id").agg(
        F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n_chars"),
        (F.coalesce(F.sum("total"), F.lit(0)) / (1 << 20)).alias("log_score"))
    mean = F.when(F.col("n_chars") > 0, F.col("log_score") / F.col("n_chars"))
    return whole.withColumn("mean_log_score", F.round(mean, 6)).withColumn(
        "perplexity", F.round(F.exp(-mean), 4))


def op10_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    places = postings(docs)
    seen = places.select("gram", F.aggregate(
        "times", F.lit(0).cast("long"), lambda total, n: total + n).alias("n"))
    score = stage(scores(count_tables(seen)), "scores")
    return score_documents(docs, places, score, unseen=-20.0)


def op10_word_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """As op10_lm_scoring over pairs of words: n_words instead of n_chars, tables that grow with the input."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    places = word_postings(docs)
    pairs = pair_counts(places.select("gram", F.aggregate(
        "times", F.lit(0).cast("long"), lambda total, n: total + n).alias("n")))
    score = word_scores(pairs, pairs, unseen=-20.0)
    return score_documents(docs, places, score, unseen=-20.0).withColumnRenamed("n_chars", "n_words")


SQL = """
WITH d AS (
  SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents
), p AS (
  SELECT doc_id, substr(chr(2) || chr(2) || t, i, 3) AS g3
  FROM (SELECT doc_id, t, unnest(range(1, length(t) + 1)) AS i FROM d)
), c3 AS (SELECT g3, count(*) AS n3 FROM p GROUP BY g3),
k2 AS (SELECT left(g3, 2) AS x2, sum(n3) AS m2 FROM c3 GROUP BY 1),
c2 AS (SELECT right(g3, 2) AS g2, sum(n3) AS n2 FROM c3 GROUP BY 1),
k1 AS (SELECT left(g2, 1) AS x1, sum(n2) AS m1 FROM c2 GROUP BY 1),
c1 AS (SELECT right(g2, 1) AS g1, sum(n2) AS n1 FROM c2 GROUP BY 1),
k0 AS (SELECT sum(n1) AS m0 FROM c1),
s AS (
  SELECT g3, round(1048576 * CASE WHEN n3 >= 2 THEN ln(n3 / m2) WHEN n2 >= 2 THEN ln(n2 / m1) + ln(0.4)
              ELSE ln(n1 / m0) + 2 * ln(0.4) END)::BIGINT AS unit
  FROM c3 JOIN k2 ON x2 = left(g3, 2) JOIN c2 ON g2 = right(g3, 2) JOIN k1 ON x1 = left(g2, 1)
    JOIN c1 ON g1 = right(g3, 1) CROSS JOIN k0
), z AS (
  SELECT doc_id, count(*) AS n, sum(unit) / 1048576 AS total FROM p JOIN s USING (g3) GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_chars, coalesce(total, 0.0)::DOUBLE AS log_score,
  round(total / n, 6) AS mean_log_score, round(exp(-total / n), 4) AS perplexity
FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN z USING (doc_id)
"""

WORD_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^ \t\n\x0b\x0c\r]+') AS w FROM documents
), p AS (
  SELECT doc_id, CASE WHEN i > 1 THEN w[i - 1] ELSE '' END AS b, w[i] AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)
), c2 AS (SELECT b, x, count(*) AS n2 FROM p GROUP BY b, x),
k1 AS (SELECT b, sum(n2) AS m1 FROM c2 GROUP BY b),
c1 AS (SELECT x, sum(n2) AS n1 FROM c2 GROUP BY x),
k0 AS (SELECT sum(n1) AS m0 FROM c1),
s AS (
  SELECT b, x, round(1048576 * CASE WHEN n2 >= 2 THEN ln(n2 / m1)
              ELSE ln(n1 / m0) + ln(0.4) END)::BIGINT AS unit
  FROM c2 JOIN k1 USING (b) JOIN c1 USING (x) CROSS JOIN k0
), z AS (
  SELECT doc_id, count(*) AS n, sum(unit) / 1048576 AS total FROM p JOIN s USING (b, x) GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(total, 0.0)::DOUBLE AS log_score,
  round(total / n, 6) AS mean_log_score, round(exp(-total / n), 4) AS perplexity
FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN z USING (doc_id)
"""
