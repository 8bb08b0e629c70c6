"""Language by compression: the language whose dictionary makes the text smallest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm.common import table

#: Bytes of labelled text in one language's dictionary, and of one piece of a document.
#: A dictionary of this size holds the usual words and syllables; pieces keep
#: a long text from teaching the compressor its own words.
DICTIONARY_BYTES = 256 << 10
PIECE_BYTES = 2 << 10
#: Sampled documents per language, and characters taken from each: the bound of what is fitted on.
SAMPLE_DOCS = 1000
SAMPLE_CHARS = 600
LEVEL = 5
#: Dictionaries are cut to the smallest language's size, but not below this.
LEAST_SHARE = 64 << 10
#: A text is rejected when the second language needs less than this much more.
MARGIN = 0.005
UNKNOWN = "und"
HELD_OUT = 2


def letters_only(text: str = "text"):
    """What is compressed: the letters of the text in lower case, other runs as one blank."""
    return F.lower(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\P{L}+", " "))


def held_out(doc_id: str = "doc_id"):
    """Documents that nothing is learned from: remainder 2 of the id's crc32."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


#: Rows looked at for a language's sample, as a multiple of SAMPLE_DOCS. If too few of them are
#: long, the search goes on with SEARCH times as many.
SEARCH = 4


def _sample(docs: DataFrame) -> dict[str, list[str]]:
    """Texts of each language's sample in order: the SAMPLE_DOCS rows with the least hash of their id.

    Rows are admitted by a threshold of the hash that lets about SEARCH *
    SAMPLE_DOCS of a language pass, and their texts are cut before they are
    moved, so what is exchanged does not grow with the table.
    """
    spark = docs.sparkSession
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = known.select("lang", "text", F.xxhash64("doc_id").alias("hash"))
    counts = known.groupBy("lang").count().collect()  # a row per language
    shares = {r["lang"]: SEARCH * SAMPLE_DOCS / r["count"] for r in counts}
    found: dict[str, list[str]] = {}
    while shares:
        limits = spark.createDataFrame(
            [(k, min(2**63 - 1, int(share * 2**64) - 2**63)) for k, share in shares.items()],
            "lang string, most long")
        admitted = rows.join(F.broadcast(limits), "lang").filter(F.col("hash") <= F.col("most"))
        admitted = admitted.filter(F.col("text").rlike(r"\p{L}")).withColumn("text", letters_only())
        cut = admitted.select("lang", "hash", (F.length("text") < 200).alias("short"),
                              F.substring("text", 1, SAMPLE_CHARS).alias("text"))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("short", "hash", "text"))
        picked = cut.withColumn("rank", rank).filter(F.col("rank") <= SAMPLE_DOCS).collect()  # bounded
        by_language: dict[str, list] = {k: [] for k in shares}
        for row in picked:
            by_language[row["lang"]].append(row)
        for k, own in by_language.items():
            long = sum(not row["short"] for row in own)
            if shares[k] >= 1 or long == SAMPLE_DOCS:
                found[k] = [row["text"] for row in sorted(own, key=lambda row: row["rank"])]
        shares = {k: share * SEARCH for k, share in shares.items() if k not in found}
    return found


def dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """Raw content per language from a bounded sample of labelled, not held-out rows.

    The SAMPLE_DOCS rows of each language with the smallest hash of their id
    that hold at least 200 characters, and shorter ones if there are too few;
    of each its first SAMPLE_CHARS characters. Texts that read alike are taken
    once, so copies don't fill a dictionary.
    """
    contents: dict[str, bytes] = {}
    for language, texts in sorted(_sample(docs).items()):
        for text in reversed(texts):  # the compressor favours the end
            piece = text.encode()
            if piece not in contents.get(language, b""):
                contents[language] = (contents.get(language, b"") + piece)[-DICTIONARY_BYTES:]
    return contents


class Compressors:
    """One compressor per language, made once in each Python worker's task."""

    def __init__(self, contents: dict[str, bytes]) -> None:
        # Equal shares, or a language with little text would lose to the others.
        share = min((len(c) for c in contents.values()), default=0)
        self.languages = sorted(contents)
        self.by_language = []
        for language in self.languages:
            content = contents[language][-max(share, LEAST_SHARE):]
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.by_language.append(
                zstandard.ZstdCompressor(
                    dict_data=held, write_content_size=False, write_checksum=False
                )
            )

    def sizes(self, text: str) -> list[int]:
        data = text.encode()
        totals = [0] * len(self.languages)
        for at in range(0, len(data), PIECE_BYTES):
            piece = data[at : at + PIECE_BYTES]
            for k, compressor in enumerate(self.by_language):
                totals[k] += len(compressor.compress(piece))
        return totals

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, score, rejected. Ties go to the language first in the alphabet."""
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        best = sizes[order[0]]
        if len(order) == 1:
            return self.languages[order[0]], 1.0, False
        margin = (sizes[order[1]] - best) / sizes[order[1]]
        return self.languages[order[0]], min(1.0, margin / (margin + 0.05) * 1.05), margin < MARGIN


def predict(docs: DataFrame, contents: dict[str, bytes], keys: list[str]) -> DataFrame:
    """keys of docs with lang_pred, score, rejected. Only the text is looked at.

    A text that is null or has no letter is `und` with score 0, and rejected.
    Without any labelled row every text is. Repeated rows are predicted each;
    long texts are compressed whole, piece by piece.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*keys).dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compressors = Compressors(contents) if contents else None
        for batch in batches:
            found = [
                compressors.predict(text) if ok and compressors else (UNKNOWN, 0.0, True)
                for text, ok in zip(batch["_text"], batch["_letters"], strict=True)
            ]
            out = batch.drop(columns=["_text", "_letters"])
            out["lang_pred"] = [f[0] for f in found]
            out["score"] = [f[1] for f in found]
            out["rejected"] = [f[2] for f in found]
            yield out

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    given = docs.select(*keys, letters_only().alias("_text"), letters.alias("_letters"))
    return given.mapInPandas(run, f"{schema}, lang_pred string, score double, rejected boolean")


def keep(docs: DataFrame, contents: dict[str, bytes]) -> DataFrame:
    """The rows of docs whose language is clear, with the columns of docs."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"),
                         F.col("text"))
    judged = packed.withColumn("_letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    udf = _clear(contents)
    return judged.filter(F.col("_letters")).filter(udf(letters_only())).select(
        *[F.col("_row")[c].alias(c) for c in names])


def _clear(contents: dict[str, bytes]):
    held: list[Compressors] = []

    @F.pandas_udf("boolean")
    def clear(texts: pd.Series) -> pd.Series:
        if not contents:
            return pd.Series([False] * len(texts), dtype=bool)
        if not held:
            held.append(Compressors(contents))
        return pd.Series([not held[0].predict(t)[2] for t in texts], dtype=bool)

    return clear


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    contents = dictionaries(docs)
    given = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(given, contents, ["doc_id", "held_out"])
