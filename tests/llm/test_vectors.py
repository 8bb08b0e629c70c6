"""Centroid clustering and vector codes against their SQL and against plain loops."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from tillroll.llm import clusters, codes

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, codes string"
NAN, INF = float("nan"), float("inf")


def awkward(width=64, n=300, seed=4):
    """Clumps, repeated rows and ids, ties, nulls in every column, broken vectors."""
    rnd = random.Random(seed)
    middles = [[rnd.uniform(-0.5, 0.5) for _ in range(width)] for _ in range(6)]
    rows = []
    for k in range(n):
        v = [float(np.float32(m + rnd.gauss(0, 0.05))) for m in rnd.choice(middles)]
        rows.append((k * 7 % 1009, v, rnd.choice([None, 1, 2, 3]), 1, "x"))
    rows += [rows[0], rows[5], (rows[9][0], rows[3][1], 9, None, None), (None, rows[1][1], 1, 1, "x")]
    rows += [(5000 + k, [0.0] * width, None, 1, "x") for k in range(30)]
    rows += [
        (6000, None, 1, 1, "x"), (6001, [], 1, 1, "x"), (6002, [0.5] * (width - 1), 1, 1, "x"),
        (6003, [None, *rows[0][1][1:]], 1, 1, "x"), (6004, [NAN, *rows[0][1][1:]], 1, 1, "x"),
        (6005, [*rows[0][1][:-1], -INF], 1, 1, "x"), (6006, [0.5] * (width + 8), 1, 1, "x"),
    ]
    return rows


def whole(rows, scale, width):
    return [
        (i, [math.floor(scale * x) for x in v], label)
        for i, v, label, *_ in rows
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)
    ]


def far(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def closest(v, entries):
    return min((far(v, e), k) for k, e in enumerate(entries))


def updated(entries, vectors, labels):
    out = []
    for k, e in enumerate(entries):
        own = [v for v, label in zip(vectors, labels, strict=True) if label == k]
        out.append([sum(c) // len(own) for c in zip(*own, strict=True)] if own else e)
    return out


def plain_clusters(rows):
    kept = whole(rows, 256, 64)
    name = lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    entries = [v for _, v, _ in sorted((r for r in kept if r[0] is not None), key=name)[:40]]
    vectors = [v for _, v, _ in kept]
    for _ in range(5):
        entries = updated(entries, vectors, [closest(v, entries)[1] for v in vectors])
    found = [closest(v, entries) for v in vectors]
    total = sum(d for d, _ in found)
    names = [hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() for e in entries]
    return sorted(
        repr((i, c, d, sum(x for x, y in found if y == c), total, names[c]))
        for (i, _, _), (d, c) in zip(kept, found, strict=True)
    )


def plain_codes(rows, width):
    kept = whole(rows, 4096, width)
    each = width // 8
    cut = lambda v, p: v[p * each : (p + 1) * each]
    least = {}
    for i, v, _ in kept:
        if i is not None:
            least[i] = min(v, least.get(i, v))
    start = [least[i] for i in sorted(least)[:16]]
    books = [[cut(v, p) for v in start] for p in range(8)]
    for _ in range(6):
        books = [
            updated(book, [cut(v, p) for _, v, _ in kept], [closest(cut(v, p), book)[1] for _, v, _ in kept])
            for p, book in enumerate(books)
        ]
    found = [[closest(cut(v, p), book) for p, book in enumerate(books)] for _, v, _ in kept]
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        labels[label] = labels.get(label, 0) + e
    text = ",".join(str(x) for book in books for e in book for x in e)
    name = hashlib.sha256(text.encode()).hexdigest()
    return sorted(
        repr((i, "".join(f"{k:02x}" for _, k in f), e, labels[label], name))
        for (i, _, label), f, e in zip(kept, found, errors, strict=True)
    )


def rows_of(frame):
    return sorted(repr(tuple(r)) for r in frame.collect())


def from_sql(sql, table):
    db = duckdb.connect()
    db.register("embeddings", table)
    return sorted(repr(r) for r in db.sql(sql).fetchall())


def test_clusters_equal_plain_loops_and_sql(spark):
    rows = awkward()
    given = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = plain_clusters(rows)
    assert rows_of(clusters.cluster(given)) == want
    assert from_sql(clusters.SQL, given.toArrow()) == want


def test_codes_equal_plain_loops_and_sql(spark):
    rows = awkward()
    given = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = plain_codes(rows, 64)
    assert rows_of(codes.compress(given)) == want
    assert from_sql(codes.SQL, given.toArrow()) == want


def test_codes_of_short_vectors_and_few_ids(spark):
    rows = awkward(8, 10, 1)[:12]
    assert rows_of(codes.compress(spark.createDataFrame(rows, SCHEMA))) == plain_codes(rows, 8)


@pytest.mark.parametrize("rows", [[], [(None, [0.25] * 64, 1, 1, "x")], [(1, None, 1, 1, "x")]])
def test_tables_without_first_entries(spark, rows):
    given = spark.createDataFrame(rows, SCHEMA)
    kept = sum(r[1] is not None for r in rows)
    for out in (clusters.cluster(given), codes.compress(given)):
        assert [tuple(r) for r in out.collect()] == [(None,) * len(out.columns)] * kept
    full = spark.createDataFrame(awkward(n=10), SCHEMA)
    assert clusters.cluster(given).dtypes == clusters.cluster(full).dtypes
    assert codes.compress(given).dtypes == codes.compress(full).dtypes


def test_too_large_components_are_an_error(spark):
    given = spark.createDataFrame([(1, [1e30] * 64, 1, 1, "x")], SCHEMA)
    for make in (clusters.cluster, codes.compress):
        with pytest.raises(Exception, match="too large"):
            make(given).collect()


def test_bounds_rule_out_but_never_the_nearest():
    r = np.random.RandomState(0)
    spread = np.linspace(4, 0.05, 64)
    middles = r.randn(40, 64) * spread * 60
    vectors = np.floor(middles[r.randint(0, 40, 4000)] + r.randn(4000, 64) * spread * 4).astype(np.int64)
    vectors[:50] = vectors[50]
    around = vectors - vectors.mean(axis=0)
    _, axes = np.linalg.eigh(around.T @ around)
    turned = clusters.Rotation(vectors.mean(axis=0), axes[:, ::-1][:, :16])
    to = clusters.Centroids.of(np.concatenate([vectors[100:3900:100], vectors[49:51]]), turned)
    label, best, done = clusters.nearest(vectors, *turned.split(vectors), to)
    every = ((vectors[:, None, :] - to.whole[None]) ** 2).sum(axis=2)
    assert (best == every.min(axis=1)).all() and (label == every.argmin(axis=1)).all()
    assert done < 0.5 * every.size


def test_balls_skip_work_and_find_the_nearest():
    r = np.random.RandomState(1)
    points = np.floor(r.randn(5000, 8) * 300 + r.randint(-4, 5, (5000, 1)) * 900).astype(np.int64)
    points[:40] = points[40]
    book = codes.Balls(points[:16 * 300 : 300].copy())
    before, best, done = book.assign(points, None)
    costs = []
    for _ in range(6):
        sums = {k: np.append(points[before == k].sum(axis=0), (before == k).sum()) for k in set(before.tolist())}
        wide = {k: int(best[before == k].max()) for k in sums}
        (book,) = codes.moved([book], sums, wide)
        label, best, done = book.assign(points, before.astype(np.uint8))
        every = ((points[:, None, :] - book.entries[None]) ** 2).sum(axis=2)
        assert (label == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
        costs.append(done)
        before = label
    assert costs[-1] < 0.6 * points.shape[0] * 16


def test_a_moved_ball_still_holds_its_parts():
    for radius, step in [(0, 0), (0, 5), (7, 0), (10**14, 3), (123456789, 987654321)]:
        assert codes.grown(radius, step) >= (math.sqrt(radius) + math.sqrt(step)) ** 2 - 1e-6


def test_superseded_tables_are_gone(spark):
    from pathlib import Path

    top = Path(spark.conf.get("spark.checkpoint.dir")) / spark.sparkContext.applicationId
    names = lambda: {p.name for p in top.iterdir() if p.name.split("-")[0] in ("vectors", "coded")}
    held = names()
    given = spark.createDataFrame(awkward(n=20), SCHEMA)
    assert clusters.cluster(given).count() and codes.compress(given).count()
    assert names() == held
