import random
from dataclasses import replace
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tillroll.config import RepairWindow
from tillroll.operators import outliers
from tillroll.operators.intervals import BUCKET, covered_days, mark_days

ROWS = "key string, day date, in_window string, n int"
WINDOWS = "key string, first_day date, last_day date, n int"


def day(n):
    return date(1969, 11, 1) + timedelta(days=n)


def plain(rows, windows):
    def inside(key, at):
        return any(
            key is not None and at is not None and key == k and a is not None and b is not None and a <= at <= b
            for k, a, b, _ in windows
        )

    return sorted((n, inside(key, at)) for key, at, _, n in rows)


def marked(spark, rows, windows):
    frame = spark.createDataFrame(rows, ROWS)
    table = spark.createDataFrame(windows, WINDOWS)
    got = mark_days(frame, table, ["key"], "day", name="hit")
    assert got.columns == ["key", "day", "in_window", "n", "hit"]
    return sorted((r["n"], r["hit"]) for r in got.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_windows_before_and_after_1970(spark, seed):
    draw = random.Random(seed)
    keys = ["hot"] * 4 + ["a", "b", None]

    def at(limit=200):
        return None if draw.random() < 0.05 else day(draw.randrange(limit))

    rows = [(draw.choice(keys), at(), "x", n) for n in range(600)]
    windows = []
    for _ in range(25):
        first = at()
        last = None if first is None or draw.random() < 0.1 else first + timedelta(days=draw.randrange(-3, 50))
        windows += [(draw.choice(keys), first, last, 0)] * draw.choice([1, 1, 3])
    assert marked(spark, rows, windows) == plain(rows, windows)


def test_bucket_edges(spark):
    edge = date(1970, 1, 1) + timedelta(days=BUCKET)
    rows = [("a", edge + timedelta(days=d), None, d) for d in range(-70, 70)]
    for first, last in [(0, 0), (-1, 0), (-1, -1), (0, 31), (-32, 31), (-60, 60), (31, 32)]:
        windows = [("a", edge + timedelta(days=first), edge + timedelta(days=last), 0)]
        assert marked(spark, rows, windows) == plain(rows, windows)


def test_no_rows_or_windows(spark):
    assert marked(spark, [], [("a", day(1), day(2), 0)]) == []
    assert marked(spark, [("a", day(1), None, 7)], []) == [(7, False)]


def test_overlapping_windows_fold_and_no_pairs_are_tried(spark):
    windows = spark.range(3000).select(
        F.lit("hot").alias("key"),
        F.date_add(F.lit("2001-01-01"), (F.col("id") % 300).cast("int")).alias("first_day"),
        F.date_add(F.lit("2001-01-01"), (F.col("id") % 300 + 40).cast("int")).alias("last_day"),
    )
    assert covered_days(windows, ["key"], "first_day", "last_day").count() <= 340 // BUCKET + 2
    frame = spark.range(2000).select(
        F.lit("hot").alias("key"), F.date_add(F.lit("2000-06-01"), (F.col("id") % 900).cast("int")).alias("day")
    )
    got = mark_days(frame, windows, ["key"], "day")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert got.count() == 2000
    inside = F.col("day").between("2001-01-01", "2001-12-06")
    assert got.where(inside != F.col("in_window")).count() == 0


def test_windows_from_a_table_repair_like_those_of_the_settings(spark, retail):
    rows = [("a", day(n), 20.0 + n % 7 + (200 if n == 15 else 0)) for n in range(60)]
    frame = spark.createDataFrame(rows, "series string, invoice_date date, total_quantity double")
    peaks = outliers.peak_windows(frame, 1)
    assert ("a", day(14), day(16)) in [tuple(r) for r in peaks.collect()]
    listed = tuple(RepairWindow(*row) for row in peaks.collect())
    got = sorted(outliers.repair_series(frame, retail, windows=peaks).collect())
    assert got == sorted(outliers.repair_series(frame, replace(retail, repair_windows=listed)).collect())
    changed = {r[1] for r, old in zip(got, rows, strict=True) if r[2] != old[2]}
    assert day(15) in changed and changed <= {day(14), day(15), day(16)}
