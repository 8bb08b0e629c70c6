from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tillroll.operators import cohorts, customers, split
from tillroll.plans import customer_value

SALES = "customer_id long, invoice_date date, country string, sales decimal(18,2)"


def sales(spark, *rows):
    return spark.createDataFrame([(c, d, k, Decimal(s)) for c, d, k, s in rows], SALES)


def test_cohort_is_the_nearest_quarter(spark):
    days = [date(2009, 12, 20), date(2010, 2, 14), date(2010, 2, 15), date(2010, 2, 20)]
    rows = sales(spark, *[(i, d, "France", 1) for i, d in enumerate(days)])
    got = {r["customer_id"]: r["first_purchase_cohort"] for r in cohorts.first_purchase(rows).collect()}
    assert got == {0: "Q1-2010", 1: "Q1-2010", 2: "Q2-2010", 3: "Q2-2010"}
    floor = cohorts.first_purchase(rows, rounding="floor").collect()
    assert {r["customer_id"]: r["first_purchase_cohort"] for r in floor}[0] == "Q4-2009"


def test_two_countries_do_not_repeat_lines(spark):
    rows = sales(
        spark,
        (1, date(2010, 1, 5), "France", 1),
        (1, date(2010, 1, 9), "Spain", 1),
        (1, date(2010, 1, 9), "Spain", 2),
    )
    one = cohorts.first_purchase(rows)
    assert [(r["country"], r["first_purchase_date"]) for r in one.collect()] == [
        ("France", date(2010, 1, 5))
    ]
    both = cohorts.first_purchase(rows, per_country=True).collect()
    assert sorted(r["country"] for r in both) == ["France", "Spain"]
    assert {r["first_purchase_date"] for r in both} == {date(2010, 1, 5)}
    joined = cohorts.analysis_cohort(rows, one, date(2010, 1, 1), date(2010, 12, 31))
    assert joined.count() == 3


def test_analysis_cohort_really_filters(spark):
    rows = sales(
        spark,
        (1, date(2010, 1, 5), "France", 1),
        (1, date(2010, 9, 1), "France", 1),
        (2, date(2010, 6, 1), "France", 1),
        (2, date(2010, 9, 30), "Spain", 1),
    )
    first = cohorts.first_purchase(rows)
    pick = dict(first_day=date(2010, 9, 1), last_day=date(2010, 9, 30))
    assert cohorts.analysis_cohort(rows, first, **pick).count() == 2
    assert cohorts.analysis_cohort(rows, first, **pick, cohorts=["Q1-2010"]).count() == 1
    assert cohorts.analysis_cohort(rows, first, **pick, countries=["Spain"]).count() == 1


def test_cohort_sizes(spark):
    rows = sales(spark, *[(i, date(2010, 1, 5), "France", 1) for i in range(3)],
                 (9, date(2010, 6, 20), "France", 1))
    got = [(r["first_purchase_cohort"], r["n"]) for r in cohorts.cohort_sizes(cohorts.first_purchase(rows)).collect()]
    assert got == [("Q1-2010", 3), ("Q3-2010", 1)]


def test_features_and_outcome(spark, retail):
    last = date(2011, 11, 30)
    cut = last - timedelta(days=90)
    rows = sales(
        spark,
        (1, cut, "France", 10),
        (1, cut - timedelta(days=10), "France", 20),
        (1, cut + timedelta(days=1), "France", 7),
        (2, cut - timedelta(days=40), "France", 5),
        (3, last, "France", 9),
    )
    bounds = split.TimeBounds(cut, cut)
    got = {r["customer_id"]: r for r in customers.customer_features(rows, bounds, retail).collect()}
    assert set(got) == {1, 2}, "a customer without an earlier line is absent"
    assert (got[1]["recency"], got[1]["frequency"]) == (0, 2)
    assert (got[1]["sales_sum"], got[1]["sales_mean"]) == (Decimal(30), 15.0)
    assert (got[1]["spend_90_total"], got[1]["spend_90_flag"]) == (Decimal(7), 1)
    assert got[2]["recency"] == -40
    assert (got[2]["spend_90_total"], got[2]["spend_90_flag"]) == (Decimal(0), 0)
    whole = {r["customer_id"]: r["recency"] for r in customers.rfm(rows, cut).collect()}
    assert whole == {1: 1, 2: -40, 3: 90}


def test_time_bounds(spark, retail):
    rows = sales(spark, *[(c, date(2011, 1, 1) + timedelta(days=c), "France", 1) for c in range(300)])
    got = split.time_bounds(rows, retail)
    cut = date(2011, 1, 1) + timedelta(days=299 - 90)
    train = [r["customer_id"] for r in split.customer_split(rows, retail).collect() if r["split"] == "train"]
    assert got.cut_day == cut
    assert got.reference_day == max(
        date(2011, 1, 1) + timedelta(days=c) for c in train if c <= 299 - 90
    )
    assert 200 < len(train) < 280


def test_cv_plan(spark, retail):
    days = spark.range(400).select(F.date_add(F.lit("2010-01-01"), F.col("id").cast("int")).alias("invoice_date"))
    plan = split.cv_plan(days, retail)
    got = {(r["slice_id"], r["part"]): r["n"] for r in plan.groupBy("slice_id", "part").agg(F.count("*").alias("n")).collect()}
    assert got == {
        (1, "train"): 310, (1, "test"): 90, (2, "train"): 220, (2, "test"): 90,
        (3, "train"): 130, (3, "test"): 90, (4, "train"): 40, (4, "test"): 90,
    }
    few = split.cv_plan(days.filter("invoice_date < '2010-06-01'"), retail)
    assert {r["slice_id"] for r in few.select("slice_id").distinct().collect()} == {1}


def test_sample_is_repeatable(spark):
    people = spark.range(1000).toDF("customer_id")
    a = {r[0] for r in customer_value.sample_customers(people, 0.3).collect()}
    b = {r[0] for r in customer_value.sample_customers(people.repartition(7), 0.3).collect()}
    assert a == b and 250 < len(a) < 350
    assert customer_value.sample_customers(people, 1.0).count() == 1000
