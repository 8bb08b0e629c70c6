"""Centroid clustering in exact integers, with centroids ruled out by rotated leading coordinates.

The vectors are rotated to their principal axes. Each keeps its first few
coordinates and the norm of the rest; the distance of the former plus the
squared difference of the latter is never more than the whole distance, so a
centroid whose bound exceeds an exact distance already found can't be nearer.
Only the others are compared, in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import large_batches, prepare, table
from tillroll.llm.vectors import digest_text, folded, integers, lists, matrix, sound, squared
from tillroll.session import drop, stage

COMPONENTS = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
SEED = 2
#: Rotated coordinates kept beside the residual norm.
LEADING = 16
#: Bounds are made from coordinates stored in single precision: this much of the squared
#: norms, far more than the rounding, is taken off them.
SLACK = 1e-5
#: Pairs of a vector and a centroid verified at once.
PAIRS = 100_000


@dataclass(frozen=True)
class Rotation:
    """Orthonormal leading axes of the vectors around a point near their mean."""

    centre: np.ndarray
    axes: np.ndarray

    def split(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and the norm of what they leave."""
        around = vectors - self.centre
        lead = around @ self.axes
        left = np.einsum("ij,ij->i", around, around) - np.einsum("ij,ij->i", lead, lead)
        return lead.astype(np.float32), np.sqrt(np.maximum(left, 0)).astype(np.float32)


def rotation(vectors: DataFrame, width: int, leading: int = LEADING) -> Rotation:
    """Principal axes from the products of components, summed over all vectors (column vec)."""

    def fold(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        products = np.zeros((width + 1, width + 1))
        for part in large_batches(batches, "vec", 4 << 20):
            rows = matrix(part["vec"], width).astype(float)
            rows = np.concatenate([rows, np.ones((len(rows), 1))], axis=1)
            products += rows.T @ rows
        return {k: products[k] for k in range(width + 1)} if products[width, width] else {}

    sums = folded(vectors.select("vec"), fold, width + 1, "double")
    products = np.stack([sums[k] for k in range(width + 1)])
    count = products[width, width]
    centre = products[width, :width] / count
    _, axes = np.linalg.eigh(products[:width, :width] / count - np.outer(centre, centre))
    return Rotation(centre, np.ascontiguousarray(axes[:, ::-1][:, : min(leading, width)]))


@dataclass(frozen=True)
class Centroids:
    whole: np.ndarray
    lead: np.ndarray
    rest: np.ndarray

    @staticmethod
    def of(whole: np.ndarray, turned: Rotation) -> Centroids:
        return Centroids(whole, *turned.split(whole))


def nearest(
    vectors: np.ndarray, lead: np.ndarray, rest: np.ndarray, to: Centroids
) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid of each vector, the exact squared distance, and pairs verified.

    Ties go to the smaller number.
    """
    a, b = lead.astype(float), to.lead.astype(float)
    size = np.einsum("ij,ij->i", a, a)[:, None], np.einsum("ij,ij->i", b, b)[None, :]
    norms = rest.astype(float)[:, None], to.rest.astype(float)[None, :]
    bound = size[0] + size[1] - 2 * (a @ b.T) + (norms[0] - norms[1]) ** 2
    bound -= SLACK * (size[0] + size[1] + norms[0] ** 2 + norms[1] ** 2) + SLACK
    label = bound.argmin(axis=1)
    best = squared(vectors, to.whole[label])
    may = bound <= best[:, None]
    may[np.arange(len(vectors)), label] = False
    rows, others = np.nonzero(may)
    for at in range(0, len(rows), PAIRS):
        i, j = rows[at : at + PAIRS], others[at : at + PAIRS]
        distance = squared(vectors[i], to.whole[j])
        order = np.lexsort((j, distance, i))
        i, j, distance = i[order], j[order], distance[order]
        first = np.append(True, i[1:] != i[:-1]) if len(i) else np.empty(0, bool)
        i, j, distance = i[first], j[first], distance[first]
        better = (distance < best[i]) | ((distance == best[i]) & (j < label[i]))
        label[i[better]], best[i[better]] = j[better], distance[better]
    return label, best, len(rows) + len(vectors)


def _turned(vectors: DataFrame, turned: Rotation, width: int) -> DataFrame:
    """vectors with lead (leading coordinates) and rest (residual norm)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in large_batches(batches, "vec", 4 << 20):
            lead, rest = turned.split(matrix(part["vec"], width))
            yield pa.RecordBatch.from_arrays(
                [part["vec_id"].combine_chunks(), part["vec"].combine_chunks(),
                 lists(lead, pa.float32()), pa.array(rest, pa.float32())],
                ["vec_id", "vec", "lead", "rest"])

    return vectors.select("vec_id", "vec").mapInArrow(
        run, "vec_id long, vec array<int>, lead array<float>, rest float")


def _columns(part: pa.Table, width: int, leading: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lead = part["lead"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, leading)
    return matrix(part["vec"], width), lead, part["rest"].to_numpy()


def cluster_sums(rows: DataFrame, to: Centroids) -> dict[int, np.ndarray]:
    """Per centroid number the sums of the components of its vectors, and their count."""
    width, leading = to.whole.shape[1], to.lead.shape[1]

    def fold(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        sums = np.zeros((len(to.whole), width + 1), np.int64)
        for part in large_batches(batches, "vec", 4 << 20):
            vectors, lead, rest = _columns(part, width, leading)
            label, _, _ = nearest(vectors, lead, rest, to)
            order = np.argsort(label, kind="stable")
            used, starts = np.unique(label[order], return_index=True)
            sums[used, :width] += np.add.reduceat(vectors[order], starts, axis=0)
            sums[:, width] += np.bincount(label, minlength=len(sums))
        return {k: sums[k] for k in np.flatnonzero(sums[:, width]).tolist()}

    return folded(rows.select("vec", "lead", "rest"), fold, width + 1, "long")


def assigned(rows: DataFrame, to: Centroids) -> DataFrame:
    """vec_id, cluster, distance of every row."""
    width, leading = to.whole.shape[1], to.lead.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in large_batches(batches, "vec", 4 << 20):
            label, best, _ = nearest(*_columns(part, width, leading), to)
            yield pa.RecordBatch.from_arrays(
                [part["vec_id"].combine_chunks(), pa.array(label, pa.int32()), pa.array(best, pa.int64())],
                ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(
    rows: DataFrame, vector: str = "embedding", width: int = COMPONENTS, scale: int = SCALE,
    clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept row.

    Kept are rows whose vector has width components, none null or non-finite;
    each component x becomes floor(scale * x), which must not exceed 2^27. The
    first centroids are the rows with the smallest sha256 of "seed:vec_id"; of
    repeated ids the smaller vector comes first, and rows without an id are
    never centroids, but are assigned. Fewer rows give fewer centroids, none
    gives null results. Ties go to the smaller number, an empty centroid stays.
    Repeated rows count each. Other columns are not read; an empty table gives
    no rows. The driver holds the centroids and one sum of each, no vectors.
    """
    spark = prepare(rows.sparkSession)
    given = rows.filter(sound(vector, width)).select(
        F.col("vec_id").cast("long").alias("vec_id"), integers(vector, scale).alias("vec"))
    plain = stage(given, "vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = plain.filter("vec_id IS NOT NULL").orderBy(name, "vec").limit(clusters).collect()  # a parameter
    if not first:
        none = "int cluster, long distance, long cluster_inertia, long inertia, string centroid_sha256"
        return plain.select("vec_id", *[
            F.lit(None).cast(kind).alias(column) for kind, column in (x.split() for x in none.split(", "))])

    turned = rotation(plain, width)
    held = stage(_turned(plain, turned, width), "vectors")
    drop(plain)
    now = Centroids.of(np.array([row["vec"] for row in first], np.int64), turned)
    for _ in range(rounds):
        whole = now.whole.copy()
        for k, sums in cluster_sums(held, now).items():
            whole[k] = sums[:-1] // sums[-1]  # floor, also of negative sums
        now = Centroids.of(whole, turned)

    out = stage(assigned(held, now), "clusters")
    drop(held)
    inertia = {r["cluster"]: r["d"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    about = spark.createDataFrame(
        [(k, inertia.get(k, 0), sum(inertia.values()),
          hashlib.sha256(digest_text(c).encode()).hexdigest()) for k, c in enumerate(now.whole)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(about), "cluster").select(  # one row per centroid
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return cluster(table(spark, folder, "embeddings").select("vec_id", "embedding"))


def _sql() -> str:
    """The rounds written out: the key of a vector's best centroid is distance * 64 + number."""
    parts = [f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id,
        list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) = {COMPONENTS}
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256(concat('{SEED}:', vec_id)), v) - 1 AS c, v
    FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {CLUSTERS}
)"""]
    for k in range(ROUNDS + 1):
        parts.append(f""", a{k} AS MATERIALIZED (
    SELECT r, any_value(kept.vec_id) AS vec_id, any_value(kept.v) AS v, min(CAST(list_sum(list_transform(
        list_zip(kept.v, c{k}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 64 + c) AS best
    FROM kept, c{k} GROUP BY r
)""")
        if k < ROUNDS:
            parts.append(f""", s{k} AS (
    SELECT best % 64 AS c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n
    FROM a{k}, range(1, {COMPONENTS + 1}) AS t(i) GROUP BY best % 64, i
), c{k + 1} AS MATERIALIZED (
    SELECT c, coalesce(m.v, c{k}.v) AS v FROM c{k}
    LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{k} GROUP BY c) AS m USING (c)
)""")
    parts.append(f""", total AS (SELECT best % 64 AS c, sum(best // 64) AS d FROM a{ROUNDS} GROUP BY 1)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, best // 64 AS distance,
    CAST(total.d AS BIGINT) AS cluster_inertia, CAST((SELECT sum(d) FROM total) AS BIGINT) AS inertia,
    sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN total ON total.c = best % 64 JOIN c{ROUNDS} USING (c)
""")
    return "".join(parts)


SQL = _sql()
