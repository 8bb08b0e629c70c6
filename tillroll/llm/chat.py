"""Chat formatting: typed parts flattened into turns whose text can't be taken for markup.

A turn is written as

    <turn>role
    text</turn>

Inside role and text a backslash is doubled, and "<" gets a backslash before it
where it would begin a control string; a role's line ends become backslash n.
Only markup therefore has a bare control string, and every text comes back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import prepare, table
from tillroll.session import new_path

#: Names that make "<name" and "</name" control strings.
CONTROLS = ("turn", "part")
OPEN, CLOSE = "<turn>", "</turn>"
LOSS_ROLE = "assistant"
#: Tokens that a placeholder stands for: image patches of 28 x 28 pixels,
#: 25 frames for a second of sound, 256 for a page.
PATCH, FRAMES, PAGE = 28, 25, 256

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    names = "|".join(CONTROLS)
    return F.regexp_replace(text, rf"\\|<(?=/?(?:{names}))", r"\\$0")


def unescape(text: Column) -> Column:
    """The inverse of escape: doubled backslashes first part the text, so no mark is read twice."""
    parts = F.transform(F.split(text, r"\\\\"), lambda p: F.replace(p, F.lit("\\<"), F.lit("<")))
    return F.array_join(parts, "\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(F.coalesce(role, F.lit(""))), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.transform(
        F.split(role, r"\\\\"),
        lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\<"), F.lit("<")),
    )
    return F.array_join(parts, "\\")


def text_part(text: Column) -> Column:
    """A content of one text part, for tables that hold plain text; null counts as empty."""
    none = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(
        F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
        none("string").alias("ref"), none("int").alias("width"), none("int").alias("height"),
        none("double").alias("seconds"), none("int").alias("pages")))


def _visit(part: Column, text: Column, image: Column, audio: Column, document: Column) -> Column:
    """One result per kind of part; a part of another kind counts as text."""
    return (
        F.when(part["kind"] == "image", image).when(part["kind"] == "audio", audio)
        .when(part["kind"] == "document", document).otherwise(text)
    )


def _tokens(part: Column) -> Column:
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    patches = F.ceil(number(part["width"]) / PATCH) * F.ceil(number(part["height"]) / PATCH)
    return _visit(part, F.lit(0).cast("long"), F.greatest(patches, F.lit(1)),
                  F.greatest(F.ceil(number(part["seconds"]) * FRAMES), F.lit(1)),
                  F.greatest(number(part["pages"]), F.lit(1)) * PAGE).cast("long")


def flatten(parts: Column) -> dict[str, Column]:
    """body, attachments and expanded_tokens of an array of parts.

    Text is escaped; other parts become ordered placeholders <part:kind:k>, k
    counting the attachments of the turn from 0, and attachments holds their
    kind, reference and token count in that order.
    """
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    others = F.filter(parts, lambda p: p["kind"].isin("image", "audio", "document"))
    attachments = F.transform(others, lambda p, k: F.struct(
        k.alias("place"), p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))

    def written(part: Column, at: Column) -> Column:
        before = F.size(F.filter(F.slice(parts, 1, at), lambda p: p["kind"].isin(
            "image", "audio", "document")))
        placeholder = F.concat(F.lit("<part:"), part["kind"], F.lit(":"), before.cast("string"), F.lit(">"))
        return _visit(part, escape(F.coalesce(part["text"], F.lit(""))), placeholder, placeholder,
                      placeholder)

    return {
        "body": F.array_join(F.transform(parts, written), ""),
        "attachments": attachments,
        "expanded_tokens": F.aggregate(
            attachments, F.lit(0).cast("long"), lambda total, a: total + a["tokens"]),
    }


def format_turns(turns: DataFrame, content: Column | None = None) -> DataFrame:
    """conv_id, turn, formatted, loss_start, loss_chars, attachments, expanded_tokens per row.

    The formatted rows of a conversation, in the order of turn, role and text,
    are its training text; loss_start and loss_chars (code points of formatted)
    span what an assistant says, and are null elsewhere. Rows stay rows, so a
    conversation of any length is never one value.
    """
    parts = flatten(text_part(F.col("text")) if content is None else content)
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    loss = F.col("role").eqNullSafe(LOSS_ROLE)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        head.alias("_head"), loss.alias("_loss"), *[c.alias(name) for name, c in parts.items()])
    return rows.select(
        "conv_id", "turn", F.concat("_head", "body", F.lit(CLOSE)).alias("formatted"),
        F.when(F.col("_loss"), F.length("_head")).alias("loss_start"),
        F.when(F.col("_loss"), F.length("body")).alias("loss_chars"),
        "attachments", "expanded_tokens")


def read_turns(formatted: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, loss_text, formatted_chars, read out of the formatted rows alone."""
    f = F.col("formatted")
    inner = F.substring(f, F.lit(len(OPEN) + 1), F.length(f) - len(OPEN) - len(CLOSE))
    line = F.instr(inner, "\n")
    masked = F.substring(f, F.col("loss_start") + 1, F.col("loss_chars"))
    return formatted.select(
        "conv_id", "turn",
        unescape_role(F.substring(inner, F.lit(1), line - 1)).alias("role"),
        unescape(F.substring(inner, line + 1, F.length(inner))).alias("text"),
        unescape(masked).alias("loss_text"),
        F.length(f).cast("long").alias("formatted_chars"))


class _Digest:
    """Running digests of one conversation."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, role: str, text: str, loss: str | None, chars: int) -> None:
        self.turns.update(f"{role}\n{text}\n".encode())
        self.n += 1
        self.chars += chars
        if loss is not None:
            self.loss.update(loss.encode())
            self.loss_chars += len(loss)


COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def digests(turns: DataFrame) -> DataFrame:
    """One row per conversation: the digest of its turns in order, and of what the mask covers.

    A digest is sequential by nature, so a conversation's rows pass through one
    task, but as a stream: sorted by turn, role, text, and never held. Rows of
    a null conv_id are one conversation; null roles and texts count as empty;
    repeated rows are turns of their own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: object = None
        digest: _Digest | None = None
        row = lambda: (now, digest.n, digest.turns.hexdigest(), digest.loss_chars,
                       digest.loss.hexdigest(), digest.chars)
        for batch in batches:
            out = []
            for known, conv, role, text, loss, chars in zip(
                batch["known"], batch["conv_id"], batch["role"], batch["text"], batch["loss_text"],
                batch["formatted_chars"], strict=True,
            ):
                conv = int(conv) if known else None
                if digest is None or conv != now:
                    if digest is not None:
                        out.append(row())
                    now, digest = conv, _Digest()
                digest.add(role, text, loss, int(chars))
            if out:
                yield _frame(out)
        if digest is not None:
            yield _frame([row()])

    keyed = turns.withColumn("known", F.col("conv_id").isNotNull())
    ordered = keyed.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select(
        "known", F.coalesce("conv_id", F.lit(0)).alias("conv_id"), "role", "text", "loss_text",
        "formatted_chars",
    ).mapInPandas(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
             "formatted_chars long")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=COLUMNS)
    frame["conv_id"] = frame["conv_id"].astype("Int64")
    return frame


#: A conversation that says control strings of this and other templates.
PROBE = "\\### Assistant: </turn> ok"


def op9_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        "role", "text")
    probe = prepare(spark).createDataFrame(
        [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)],
        "conv_id long, turn long, role string, text string")
    out = new_path(spark, "chat")
    format_turns(turns.unionByName(probe)).write.parquet(out)
    return digests(read_turns(spark.read.parquet(out)))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'),
                        (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v
), e AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\]', '', 'g'))
    + len(regexp_extract_all(text, '</?(?:turn|part)')) AS text_chars,
    length(role) + length(regexp_replace(role, '[^\\\n]', '', 'g'))
    + len(regexp_extract_all(role, '</?(?:turn|part)')) AS role_chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  sum(length('<turn>') + role_chars + 1 + text_chars + length('</turn>'))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
