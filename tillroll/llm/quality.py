"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import WHITE, table

SYMBOLS = "#*$%&|<>"
WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 5

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on with as was be by at or an are this from "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es "
    "de la le et les des en un du une que est pour qui dans par plus au sur ne se "
    "el los las del y por con para su al lo como más pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """Passed if low <= 100 * part / whole <= high, or the text has fewer than from_words words.

    low and high are whole percent of the denominator, so that every engine
    decides alike. A denominator of zero passes.
    """

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None
    from_words: int = 0


RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("exclamations", "n_exclamations", "n_words", None, 15),
    Rule("capitals", "n_capitals", "n_letters", None, 50, 20),
    Rule("letters", "n_letters", "word_chars", 25, None),
    Rule("stop_words", "n_stop_words", "n_words", 1, None, 150),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 50, 50),
)


def _removed(column: Column, characters: str) -> Column:
    """Number of the given characters in column."""
    return F.length(column) - F.length(F.translate(column, characters, ""))


def _covered(marks: Column) -> Column:
    """Words in windows that start at the given ascending positions."""
    steps = F.transform(
        marks,
        lambda p, i: F.when(i + 1 < F.size(marks), F.least(F.lit(WINDOW), marks[i + 1] - p))
        .otherwise(F.lit(WINDOW)),
    )
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words and the counts the rules use, computed over the whole text.

    A text that is null or holds no word has no words; every count is then 0
    but for characters that stand in it. Windows are compared by a 64-bit hash
    of five 64-bit word hashes. Only texts in which a window returns take the
    second step, which sorts windows with their positions. Helper columns start
    with "_q_", so that columns of the input are kept, whatever their names.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    blank = F.translate(t, WHITE, "")
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(t, "\n"), lambda line: F.length(F.translate(line, WHITE, "")) > 0)
    df = docs.withColumns(
        {
            "_q_words": words,
            "_q_lines": lines,
            "_q_chars": F.length(blank),
            "_q_symbols": _removed(t, SYMBOLS),
            "_q_exclamations": _removed(t, "!"),
            "_q_letters": F.length(F.regexp_replace(t, r"\P{L}+", "")),
            "_q_capitals": F.length(F.regexp_replace(t, r"\P{Lu}+", "")),
        }
    )
    df = df.withColumn("_q_hashes", F.transform("_q_words", lambda w: F.xxhash64(w)))
    df = df.withColumn(
        "_q_windows",
        F.when(
            F.size("_q_words") >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size("_q_words") - WINDOW),
                lambda i: F.xxhash64(*[F.col("_q_hashes")[i + k] for k in range(WINDOW)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn(
        "_q_sorted",
        F.when(
            F.size(F.array_distinct("_q_windows")) < F.size("_q_windows"),
            F.array_sort(
                F.transform(
                    "_q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))
                )
            ),
        ),
    )
    s = F.col("_q_sorted")
    twin = F.filter(
        F.transform(
            s,
            lambda x, k: F.when(
                ((k > 0) & (F.get(s, k - 1)["h"] == x["h"]))
                | ((k + 1 < F.size(s)) & (F.get(s, k + 1)["h"] == x["h"])),
                x["i"],
            ),
        ),
        lambda p: p.isNotNull(),
    )
    df = df.withColumn("_q_marks", F.array_sort(twin))
    counts = {
        "n_words": F.size("_q_words"),
        "word_chars": F.col("_q_chars"),
        "n_symbols": F.col("_q_symbols"),
        "n_dup_lines": F.size("_q_lines") - F.size(F.array_distinct("_q_lines")),
        "n_repeat_words": F.when(F.col("_q_marks").isNull(), 0).otherwise(
            _covered(F.col("_q_marks"))
        ),
        "n_lines": F.size("_q_lines"),
        "n_exclamations": F.col("_q_exclamations"),
        "n_letters": F.col("_q_letters"),
        "n_capitals": F.col("_q_capitals"),
        "n_stop_words": F.size(
            F.filter(
                "_q_words",
                lambda w: F.lower(F.translate(w, ".,!;:?", "")).isin(STOP_WORDS),
            )
        ),
    }
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in counts]
    return df.select(*kept, *[c.cast("long").alias(name) for name, c in counts.items()])


def verdicts(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """The threshold table as columns: one per rule (true: failed), base_failed, kept."""
    failed = {}
    for r in rules:
        part, whole = F.col(r.part), F.col(r.whole)
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (100 * part < r.low * whole)
        if r.high is not None:
            bad = bad | (100 * part > r.high * whole)
        failed[f"fails_{r.name}"] = (whole > 0) & (F.col("n_words") >= r.from_words) & bad
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = ~base
    for column in failed.values():
        kept = kept & ~column
    return {"base_failed": base, **failed, "kept": kept}


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs without its text, with all measures and verdicts.

    Null or empty texts have no words and fail. Repeated rows are judged each
    on its own; an empty table gives an empty result. Columns of the input that
    are called like a measure are replaced by it.
    """
    columns = verdicts(rules)
    df = measures(docs, text).drop(text)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns],
                     *[c.alias(name) for name, c in columns.items()])


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"),
                       F.col(f"`{text}`").alias("_text"))
    # The row mark keeps the optimiser from moving the filter below the measures, which
    # would write them out once for every rule.
    judged = measures(held, "_text").withColumn("_mark", F.monotonically_increasing_id())
    judged = judged.filter((F.col("_mark") >= 0) & verdicts(rules)["kept"])
    return judged.select(*[F.col("_row")[c].alias(c) for c in names])


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    df = judge(docs)
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "base_failed", "kept"]
    return df.select(*first, *[c for c in df.columns if c not in first])


def _sql() -> str:
    words = ", ".join(f"'{w}'" for w in STOP_WORDS)
    tests = {}
    for r in RULES:
        bad = [f"100 * {r.part} {sign} {edge} * {r.whole}"
               for sign, edge in (("<", r.low), (">", r.high)) if edge is not None]
        tests[f"fails_{r.name}"] = (
            f"({r.whole} > 0 AND n_words >= {r.from_words} AND ({' OR '.join(bad)}))"
        )
    count = r"length(t) - length(regexp_replace(t, '{}', '', 'g'))"
    return f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, r, t, regexp_extract_all(t, '{WORD}') AS ws,
         [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '{WORD}')] AS ls FROM d
), wins AS (
  SELECT r, i, list_aggregate(ws[i:i + 4], 'string_agg', ' ') AS win
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM wins) WHERE n > 1
), covered AS (
  SELECT r, sum(least(5, coalesce(following - i, 5)))::BIGINT AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS following FROM twice) GROUP BY r
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    ({count.format('[#*$%&|<>]')})::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(ls)::BIGINT AS n_lines,
    ({count.format('!')})::BIGINT AS n_exclamations,
    ({count.format('[\\p{{L}}]').replace('{{', '{').replace('}}', '}')})::BIGINT AS n_letters,
    ({count.format('[\\p{{Lu}}]').replace('{{', '{').replace('}}', '}')})::BIGINT AS n_capitals,
    len([x FOR x IN ws IF lower(regexp_replace(x, '[.,!;:?]', '', 'g')) IN ({words})])::BIGINT
      AS n_stop_words
  FROM w LEFT JOIN covered c USING (r)
), v AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    {', '.join(f'{test} AS {name}' for name, test in tests.items())}
  FROM m
)
SELECT *, NOT (base_failed OR {' OR '.join(tests)}) AS kept FROM v
"""


SQL = _sql()
