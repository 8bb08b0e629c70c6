"""A third of all lines on one order, one item and one customer: splits happen, results stay whole."""

from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

from tillroll.checks.sql import ORACLE
from tillroll.plans import catalog

TINY = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4kb",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4kb",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1kb",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """30,000 lines; order 0, item 0 and customer 0 hold a third of them each."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    line = spark.range(30000, numPartitions=4)
    hot = F.col("id") % 3 == 0
    tables = {
        "lineitem": line.select(
            F.when(hot, 0).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2000))).alias("l_orderkey"),
            F.when(F.col("id") % 3 == 1, 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(5000))).alias("l_partkey"),
            (F.col("id") % 40 + 1).cast("double").alias("l_quantity"),
            F.when(F.col("id") % 11 == 0, "R").otherwise("N").alias("l_returnflag"),
        ),
        "orders": spark.range(2000).select(
            F.col("id").alias("o_orderkey"),
            (F.col("id") % 300).alias("o_custkey"),
            F.date_sub(F.lit(date(2001, 7, 31)), (F.col("id") % 700).cast("int"))
            .cast("timestamp_ntz")
            .alias("o_orderdate"),
        ),
        "part": spark.range(5000).select(
            F.col("id").alias("p_partkey"),
            F.concat(F.lit("thing "), F.col("id")).alias("p_name"),
            (F.col("id") % 90 + 0.5).alias("p_retailprice"),
        ),
        "customer": spark.range(300).select(
            F.col("id").alias("c_custkey"), (F.col("id") % 23).cast("int").alias("c_nationkey")
        ),
        "nation": spark.range(23).select(
            F.col("id").cast("int").alias("n_nationkey"),
            F.concat(F.lit("NATION_"), F.col("id")).alias("n_name"),
        ),
    }
    for name, table in tables.items():
        table.coalesce(4).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture
def tiny_partitions(spark):
    before = {k: spark.conf.get(k) for k in TINY}
    for key, value in TINY.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def theirs(folder, name):
    con = duckdb.connect()
    for table in ("lineitem", "orders", "part", "customer", "nation"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    cursor = con.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    return columns, cursor.fetchall()


def test_hot_keys_are_split(spark, skewed, tiny_partitions):
    df = catalog.clean_sales(spark, skewed)
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan
    assert len(rows) == len(theirs(skewed, "clean_sales")[1])


@pytest.mark.parametrize("name", ["clv_training_table", "nearest_customers", "recommendations", "daily_quantity"])
def test_results_stay_whole(spark, skewed, tiny_partitions, name):
    from tillroll.checks.compare import close, sorted_rows

    df = catalog.RELATIONAL[name](spark, skewed)
    ours = sorted_rows(df.columns, df.collect())
    other = sorted_rows(*theirs(skewed, name))
    assert len(ours) == len(other)
    assert all(close(x, y) for a, b in zip(ours, other) for x, y in zip(a, b))


def test_a_large_month_is_split_on_write(spark, tmp_path, tiny_partitions):
    import glob

    from tillroll.sources.tables import write_table

    days = spark.range(60000, numPartitions=12).select(
        F.when(F.col("id") % 3 > 0, F.lit(date(2010, 5, 1)))
        .otherwise(F.date_add(F.lit(date(2010, 6, 1)), (F.col("id") % 90).cast("int")))
        .alias("invoice_date"),
        F.xxhash64("id").alias("x"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100kb")
    path = str(tmp_path / "by-month")
    write_table(days, path, month_of="invoice_date")
    assert spark.read.parquet(path).count() == 60000
    files = {m: len(glob.glob(f"{path}/sales_month={m}/*.parquet")) for m in ("2010-05", "2010-06")}
    assert files["2010-05"] > 1, "the month with two thirds of the rows is more than one file"
    assert files["2010-06"] < 12, "a small month is not one file per task"
