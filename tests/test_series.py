import math
import random
from dataclasses import replace
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tillroll.config import RepairWindow
from tillroll.operators import outliers, series, split
from tillroll.operators.ordering import grouped_percentile, number_rows, running_totals

SCHEMA = "series string, invoice_date date, total_quantity long"
START = date(2010, 1, 1)


def day(n):
    return START + timedelta(days=n - 1)


def daily(spark, *rows):
    return spark.createDataFrame([(s, day(n), q) for s, n, q in rows], SCHEMA)


def ragged(spark):
    return daily(spark, ("a", 1, 10), ("a", 2, 20), ("a", 5, 50), ("b", 3, 7), ("b", 4, 8))


def values(df):
    return {(r[0], (r[1] - START).days + 1): r[2] for r in df.collect()}


def test_padding_is_per_series(spark):
    got = values(series.pad_days(ragged(spark)))
    assert got == {
        ("a", 1): 10, ("a", 2): 20, ("a", 3): 0, ("a", 4): 0, ("a", 5): 50,
        ("b", 3): 7, ("b", 4): 8,
    }


def test_future_starts_at_each_series_own_end(spark):
    longer = series.extend_days(series.pad_days(ragged(spark)), 90)
    future = series.future_rows(longer)
    got = {
        r["series"]: (r["lo"], r["hi"], r["n"])
        for r in future.groupBy("series").agg(
            F.min("invoice_date").alias("lo"), F.max("invoice_date").alias("hi"), F.count("*").alias("n")
        ).collect()
    }
    assert got == {"a": (day(6), day(95), 90), "b": (day(5), day(94), 90)}
    assert longer.filter("total_quantity is not null").count() == 7


def test_daily_quantity_keeps_unknown_country_apart(spark, retail):
    rows = spark.createDataFrame(
        [("United Kingdom", START, 3), ("France", START, 4), ("Spain", START, 5), (None, START, 6)],
        "country string, invoice_date date, quantity int",
    )
    got = {r[0]: r[2] for r in series.daily_quantity(rows, retail).collect()}
    assert got == {"United Kingdom": 3, "All Others": 9, None: 6}


def test_lag_and_centred_means(spark, retail):
    rows = daily(spark, *[("a", n, n) for n in range(1, 201)])
    frame = series.series_features(series.extend_days(rows, 90), retail)
    got = {(r["invoice_date"] - START).days + 1: r for r in frame.collect()}
    assert got[90]["total_quantity_lag90"] is None
    assert got[91]["total_quantity_lag90"] == 1
    assert got[290]["total_quantity_lag90"] == 200
    assert got[150]["total_quantity_lag90_roll_7"] == 60
    assert got[150]["total_quantity_lag90_roll_14"] == sum(range(54, 68)) / 14
    assert got[290]["total_quantity_lag90_roll_7"] == sum(range(197, 201)) / 4
    k = (day(150) - date(1970, 1, 1)).days
    assert math.isclose(got[150]["sin7_k1"], math.sin(2 * math.pi * k / 7), abs_tol=1e-9)
    assert series.history_rows(frame).count() == 110, "the first 90 days have no lag"
    top = series.rolling(F.col("total_quantity"), 3, F.max)
    peak = {(r[1] - START).days + 1: r[-1] for r in rows.withColumn("m", top).collect()}
    assert peak[1] == 2 and peak[100] == 101 and peak[200] == 200


def test_calendar_fields(spark):
    row = series.with_calendar(
        spark.createDataFrame([(date(2011, 5, 31),)], "invoice_date date")
    ).first()
    expected = {
        "year": 2011, "half": 1, "quarter": 2, "month": 5, "month_lbl": "May", "day": 31,
        "wday": 3, "wday_lbl": "Tuesday", "qday": 61, "yday": 151, "mweek": 5, "week": 22,
        "week2": 0, "week3": 1, "week4": 2, "mday7": 5, "index_num": 1306800000,
    }
    assert {k: row[k] for k in expected} == expected


def test_autocorrelation(spark):
    xs = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9, 3]
    mean = sum(xs) / len(xs)
    c = [x - mean for x in xs]
    power = sum(x * x for x in c)
    want = [sum(c[i] * c[i + k] for i in range(len(c) - k)) / power for k in (1, 2, 3)]
    acf = series.autocorrelation(daily(spark, *[("a", n + 1, x) for n, x in enumerate(xs)]), 3)
    got = {r["lag"]: r["acf"] for r in acf.collect()}
    assert [got[k] for k in (1, 2, 3)] == pytest.approx(want)
    pacf = {r["lag"]: r["pacf"] for r in series.partial_autocorrelation(acf).collect()}
    r1, r2, _ = want
    assert pacf[1] == pytest.approx(r1)
    assert pacf[2] == pytest.approx((r2 - r1 * r1) / (1 - r1 * r1))


def spiky(spark):
    pattern = [10, 12, 11, 14, 20, 30, 5]
    rows = [("a", n, pattern[n % 7] + (200 if n == 15 else 0)) for n in range(1, 36)]
    return daily(spark, *rows).withColumn("total_quantity", F.col("total_quantity").cast("double"))


def test_a_spike_is_repaired_inside_its_window_only(spark, retail):
    cleaned = outliers.clean_series(spiky(spark))
    bad = cleaned.filter("is_outlier").collect()
    assert day(15) in {r["invoice_date"] for r in bad}
    fixed = next(r["total_quantity_cleaned"] for r in bad if r["invoice_date"] == day(15))
    assert fixed < 80
    here = replace(retail, repair_windows=(RepairWindow("a", day(14), day(16)), RepairWindow("a", day(15), day(15))))
    got = values(outliers.repair_series(spiky(spark), here))
    assert len(got) == 35 and got[("a", 15)] == fixed and got[("a", 14)] == 10
    away = replace(retail, repair_windows=(RepairWindow("a", day(20), day(22)),))
    assert values(outliers.repair_series(spiky(spark), away))[("a", 15)] == 212
    other = replace(retail, repair_windows=(RepairWindow("b", day(14), day(16)),))
    assert values(outliers.repair_series(spiky(spark), other))[("a", 15)] == 212
    assert values(outliers.repair_series(spiky(spark), replace(retail, repair_windows=())))[("a", 15)] == 212


def test_running_totals_and_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit(2).alias("v"))
    got = {r["k"]: r["before_v"] for r in running_totals(df, ["k"], ["v"]).collect()}
    assert got == {k: 2 * k for k in range(1000)}
    down = {r["k"]: r["before_v"] for r in running_totals(df, ["k"], ["v"], descending=True).collect()}
    assert down == {k: 2 * (999 - k) for k in range(1000)}
    rows = number_rows(ragged(spark), "series", "invoice_date").orderBy("series", "invoice_date").collect()
    assert [r["row_id"] for r in rows] == [1, 2, 3, 4, 5]


def test_display_tail_clamps(spark):
    rows = daily(spark, *[("a", n, n) for n in range(1, 601)])
    def count(days, months):
        return series.display_tail(rows, 90, days, months, START, ["series"]).count()
    assert series.clamp_view(10, 1) == (30, 3) and series.clamp_view(120, 20) == (90, 11)
    assert count(10, 1) == 3 * 30 + 30
    assert count(120, 20) == 11 * 30 + 90
    last = series.display_tail(rows, 90, 30, 3, START, ["series"]).agg(F.max("invoice_date")).first()[0]
    assert last == day(540)


def test_fold_is_stable(spark, retail):
    rows = ragged(spark).withColumn("fold", split.fold_of(retail, "series", "invoice_date"))
    folds = [r["fold"] for r in rows.collect()]
    assert all(0 <= f < retail.tune_folds for f in folds)


@pytest.mark.parametrize("share", [0.0, 0.3, 0.95, 1.0])
def test_grouped_percentile_is_the_built_in_one(spark, share):
    draw = random.Random(4)
    sizes = {1: 1, 2: 2, 3: 40, 4: 301, None: 25}
    rows = [
        (k, draw.choice([round(draw.uniform(-5, 5), 1), draw.uniform(0, 1e6)]))
        for k, n in sizes.items() for _ in range(n)
    ]
    rows += [(3, None), (9, None)] + [(5, 2.5)] * 200  # nulls, a key without a value, ties only
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    expected = df.groupBy("k").agg(F.percentile("v", share).alias("p")).filter("p IS NOT NULL")
    got = grouped_percentile(df, "k", "v", share, "p")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in expected.collect()}


def test_grouped_percentile_of_nothing(spark):
    empty = spark.createDataFrame([], "k int, v double")
    assert grouped_percentile(empty, "k", "v", 0.5, "p").collect() == []
