"""Vector codes: each part of a vector as the nearest entry of its codebook, learned by ball k-means.

The parts given to an entry lie in a ball around it. Another entry can take a
part only if it is at most twice as far from the entry as the part is, so an
entry's neighbours are those within twice its ball's radius, parts nearer than
half the way to the nearest neighbour (the stable core) keep their entry
unseen, and a part in the ring between two neighbours is compared with the
nearer ones alone. All of it is done in exact integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import large_batches, prepare, table
from tillroll.llm.vectors import digest_text, folded, integers, matrix, sound, squared
from tillroll.session import drop, stage

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096


# ---------------------------------------------------------------- one codebook


class Balls:
    """A codebook and, for every entry, its neighbours from near to far.

    reach is at least the largest squared distance of a part given to the
    entry; without it (before the first round) nothing is known of the balls.
    """

    def __init__(self, entries: np.ndarray, reach: np.ndarray | None = None) -> None:
        self.entries = entries
        self.known = reach is not None
        self.neighbours: list[tuple[np.ndarray, np.ndarray]] = []
        if reach is None:
            return
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        for k in range(len(entries)):
            others = np.array([j for j in range(len(entries)) if j != k and apart[k, j] <= 4 * reach[k]], np.int64)
            others = others[np.argsort(apart[k, others], kind="stable")]
            self.neighbours.append((others, apart[k, others]))

    def assign(self, parts: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry of each part (ties to the lower index), squared distance, distances computed.

        before: the entry of each part in the round before.
        """
        if before is None or not self.known:
            distances = ((parts[:, None, :] - self.entries[None, :, :]) ** 2).sum(axis=2)
            label = distances.argmin(axis=1)
            return label, distances[np.arange(len(parts)), label], distances.size
        label = before.astype(np.int64)
        best = squared(parts, self.entries[label])
        done = len(parts)
        order = np.argsort(before, kind="stable")
        ends = np.searchsorted(before[order], np.arange(len(self.entries) + 1))
        own = best.copy()
        for k, (others, apart) in enumerate(self.neighbours):
            members = order[ends[k] : ends[k + 1]]
            if not len(members) or not len(others):
                continue
            # The ring a part lies in: as many neighbours as are at most twice as far as the part.
            ring = np.searchsorted(apart, 4 * own[members], side="right")
            for place in range(int(ring.max())):
                some = members[ring > place]
                distance = squared(parts[some], self.entries[others[place]])
                done += len(some)
                better = (distance < best[some]) | ((distance == best[some]) & (others[place] < label[some]))
                label[some[better]], best[some[better]] = others[place], distance[better]
        return label, best, done


def grown(radius: int, moved: int) -> int:
    """At least the squared radius of a ball whose centre moved: both given as squares."""
    if moved == 0:
        return radius
    return (math.isqrt(radius) + 1 + math.isqrt(moved) + 1) ** 2


# ---------------------------------------------------------------- all vectors


def _parts(vectors: np.ndarray, p: int, parts: int) -> np.ndarray:
    width = vectors.shape[1] // parts
    return vectors[:, p * width : (p + 1) * width]


def _codes(column: pa.ChunkedArray, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, parts)


def assigned(rows: DataFrame, books: list[Balls], width: int, full: bool = True) -> DataFrame:
    """rows (vec_id, label, vec, codes) with new codes; unless full, error instead of vec."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in large_batches(batches, "vec", 4 << 20):
            vectors = matrix(batch["vec"], width)
            before = _codes(batch["codes"], parts) if books[0].known else None
            codes, error = np.empty((len(vectors), parts), np.uint8), np.zeros(len(vectors), np.int64)
            for p, book in enumerate(books):
                label, best, _ = book.assign(_parts(vectors, p, parts), None if before is None else before[:, p])
                codes[:, p] = label
                error += best
            packed = pa.array([row.tobytes() for row in codes], pa.binary())
            keys = [batch["vec_id"].combine_chunks(), batch["label"].combine_chunks()]
            last = batch["vec"].combine_chunks() if full else pa.array(error)
            yield pa.RecordBatch.from_arrays(
                [*keys, packed, last], ["vec_id", "label", "codes", "vec" if full else "error"])

    label = dict(rows.dtypes)["label"]
    return rows.mapInArrow(
        run, f"vec_id long, label {label}, codes binary, {'vec array<int>' if full else 'error long'}")


def entry_sums(rows: DataFrame, books: list[Balls], width: int) -> dict[int, np.ndarray]:
    """For part * 256 + entry: the sums of its parts' components and their count."""
    parts, each = len(books), width // len(books)

    def fold(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        sums = np.zeros((parts, 256, each + 1), np.int64)
        for batch in large_batches(batches, "vec", 4 << 20):
            vectors, codes = matrix(batch["vec"], width), _codes(batch["codes"], parts)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                used, starts, counts = np.unique(codes[order, p], return_index=True, return_counts=True)
                sums[p, used, :each] += np.add.reduceat(_parts(vectors, p, parts)[order], starts, axis=0)
                sums[p, used, each] += counts
        return {int(p) * 256 + int(k): sums[p, k] for p, k in zip(*np.nonzero(sums[:, :, each]), strict=True)}

    return folded(rows.select("vec", "codes"), fold, each + 1, "long")


def radii(rows: DataFrame, books: list[Balls], width: int) -> dict[int, int]:
    """For part * 256 + entry: the largest squared distance of its parts, the ball's radius."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.full((parts, 256), -1, np.int64)
        for batch in large_batches(batches, "vec", 4 << 20):
            vectors, codes = matrix(batch["vec"], width), _codes(batch["codes"], parts)
            for p, book in enumerate(books):
                np.maximum.at(most[p], codes[:, p], squared(_parts(vectors, p, parts), book.entries[codes[:, p]]))
        p, k = np.nonzero(most >= 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p * 256 + k, pa.int32()), pa.array(most[p, k], pa.int64())], ["key", "radius"])

    found = rows.select("vec", "codes").mapInArrow(run, "key int, radius long")
    # One row per part and entry.
    return {r["key"]: r["radius"] for r in found.groupBy("key").agg(F.max("radius").alias("radius")).collect()}


def moved(books: list[Balls], sums: dict[int, np.ndarray], widest: dict[int, int]) -> list[Balls]:
    """Every used entry at the floor of its parts' mean, with a radius that holds around the new place."""
    out = []
    for p, book in enumerate(books):
        entries = book.entries.copy()
        reach = np.zeros(len(entries), object)
        for k in range(len(entries)):
            total = sums.get(p * 256 + k)
            if total is not None:
                entries[k] = total[:-1] // total[-1]  # floor, also of negative sums
                step = int(((entries[k] - book.entries[k]) ** 2).sum())
                reach[k] = grown(widest[p * 256 + k], step)
        out.append(Balls(entries, reach))
    return out


def compress(
    rows: DataFrame, vector: str = "embedding", label: str = "label", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row.

    Dropped are rows whose vector is null or holds a null or non-finite
    component. The length of the vectors is that of the smallest id's; rows of
    another length, or of one that parts does not divide, can't share its
    codebooks and are dropped too. Each component x becomes floor(scale * x),
    which must not exceed 2^27. The first entries are the parts of the smallest
    ids, ascending; an id that returns counts once, with its smallest vector,
    and rows without an id are coded but never entries. Fewer ids give fewer
    entries, none gives null codes. Ties go to the lower index; unused entries
    stay. label_error sums error over equal labels, null ones together. Other
    columns are not read; an empty table gives no rows. Codes are carried from
    round to round in a table of the shared folder, which the next one replaces.
    """
    spark = prepare(rows.sparkSession)
    if entries > 256:
        raise ValueError("an entry's index must fit a byte")
    length, cut = F.size("vec"), F.size(vector)
    given = rows.filter(sound(vector) & (cut > 0) & (cut % parts == 0)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label"),
        integers(vector, scale).alias("vec"), F.lit(b"").alias("codes"))
    held = stage(given, "coded")
    named = held.filter("vec_id IS NOT NULL")
    top = named.orderBy("vec_id", "vec").select(length.alias("n")).first()
    if top is None:
        none = [("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string")]
        return held.select("vec_id", *[F.lit(None).cast(kind).alias(column) for column, kind in none])
    width = top["n"]
    fitting = length == width
    first = (
        named.filter(fitting).groupBy("vec_id").agg(F.min("vec").alias("vec"))
        .orderBy("vec_id").limit(entries).collect()  # a parameter
    )
    start = np.array([row["vec"] for row in first], np.int64)
    books = [Balls(_parts(start, p, parts)) for p in range(parts)]
    for _ in range(rounds):
        coded = stage(assigned(held.filter(fitting), books, width), "coded")
        drop(held)
        held = coded
        books = moved(books, entry_sums(held, books, width), radii(held, books, width))
    out = stage(assigned(held.filter(fitting), books, width, full=False), "codes")
    drop(held)
    text = digest_text(np.stack([book.entries for book in books]))
    totals = out.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return out.join(totals, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error",
        F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return compress(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"))


def _sql() -> str:
    """The rounds written out: the key of a part's best entry is distance * 16 + index."""
    parts = [f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, label,
        list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % {PARTS} = 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), sized AS (SELECT len(v) // {PARTS} AS w FROM kept WHERE vec_id IS NOT NULL ORDER BY vec_id, v LIMIT 1
), x AS MATERIALIZED (
    SELECT r, vec_id, label, p, v[p * w + 1 : (p + 1) * w] AS v
    FROM kept, sized, range(0, {PARTS}) AS t(p) WHERE len(v) = {PARTS} * w
), firsts AS (
    SELECT row_number() OVER (ORDER BY vec_id) - 1 AS c, v FROM (
        SELECT vec_id, min(v) AS v FROM kept, sized
        WHERE vec_id IS NOT NULL AND len(v) = {PARTS} * w GROUP BY vec_id)
    QUALIFY c < {ENTRIES}
), c0 AS MATERIALIZED (
    SELECT p, c, v[p * w + 1 : (p + 1) * w] AS v FROM firsts, sized, range(0, {PARTS}) AS t(p)
)"""]
    for k in range(ROUNDS + 1):
        parts.append(f""", a{k} AS MATERIALIZED (
    SELECT r, x.p AS p, any_value(x.v) AS v, min(CAST(list_sum(list_transform(
        list_zip(x.v, c{k}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * {ENTRIES} + c) AS best
    FROM x JOIN c{k} ON x.p = c{k}.p GROUP BY r, x.p
)""")
        if k < ROUNDS:
            parts.append(f""", s{k} AS (
    SELECT p, best % {ENTRIES} AS c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n
    FROM a{k}, sized, range(1, w + 1) AS t(i) GROUP BY p, best % {ENTRIES}, i
), c{k + 1} AS MATERIALIZED (
    SELECT p, c, coalesce(m.v, c{k}.v) AS v FROM c{k} LEFT JOIN (
        SELECT p, c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{k} GROUP BY p, c
    ) AS m USING (p, c)
)""")
    last = f"a{ROUNDS}"
    parts.append(f""", coded AS (
    SELECT r, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY p) AS code,
        CAST(sum(best // {ENTRIES}) AS BIGINT) AS error
    FROM {last} GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, c)) FROM c{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (r)
""")
    return "".join(parts)


SQL = _sql()
