from datetime import date
from decimal import Decimal

import pytest

from tillroll.operators import clean
from tillroll.sources import tables

SCHEMA = (
    "invoice string, stock_code string, description string, quantity int, "
    "invoice_date string, price decimal(18,2), customer_id long, country string"
)
GOOD = ("1", "A", "mug", 2, "2010-03-01 08:26:00", Decimal("1.50"), 7, "France")


def lines(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_drops_what_is_no_sale(spark, retail):
    rows = lines(
        spark,
        GOOD,
        GOOD[:6] + (None, "France"),
        GOOD[:3] + (0,) + GOOD[4:],
        GOOD[:3] + (-5,) + GOOD[4:],
        GOOD[:7] + ("EIRE",),
    )
    out = clean.clean_sales(rows, retail).collect()
    assert len(out) == 1
    assert out[0]["sales"] == Decimal("3.00")
    assert out[0]["invoice_date"] == date(2010, 3, 1)


def test_unknown_country_stays(spark, retail):
    out = clean.clean_sales(lines(spark, GOOD[:7] + (None,)), retail)
    assert out.count() == 1


def test_repeated_line_counts_once(spark, retail):
    assert clean.clean_sales(lines(spark, GOOD, GOOD), retail).count() == 1


def test_text_is_trimmed_then_quotes_go(spark, retail):
    row = GOOD[:2] + (' \t "RED" MUG \n',) + GOOD[3:]
    out = clean.as_of(clean.clean_sales(lines(spark, row), retail), retail.as_of)
    assert out.first()["description"] == "RED MUG"


def test_cut_off_day_is_included(spark, retail):
    rows = lines(
        spark, GOOD[:4] + ("2011-11-30",) + GOOD[5:], GOOD[:4] + ("2011-12-01",) + GOOD[5:]
    )
    out = clean.as_of(clean.clean_sales(rows, retail), retail.as_of)
    assert [r["invoice_date"] for r in out.collect()] == [date(2011, 11, 30)]


def test_members_only(spark, retail):
    rows = lines(spark, GOOD, GOOD[:6] + (8, "France"))
    keys = spark.createDataFrame([(8,), (8,)], "customer_id long")
    assert [r["customer_id"] for r in clean.members_only(rows, keys, "customer_id").collect()] == [8]
    out = clean.members_only(rows, keys, "customer_id", inside=False).collect()
    assert [r["customer_id"] for r in out] == [7]


def test_csv_in_and_table_out(spark, retail, tmp_path):
    file = tmp_path / "raw.csv"
    file.write_text(
        "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"
        '536365,85123A,"WHITE ""HEART"" HOLDER",6,2010-12-01 08:26:00,2.55,17850,United Kingdom\n'
        "C536379,D,Discount,-1,2010-12-01 09:41:00,27.50,14527,United Kingdom\n"
        "536414,22139,,56,2010-12-01 11:52:00,0.00,,United Kingdom\n"
    )
    raw = tables.read_csv_lines(spark, str(file))
    assert raw.columns == [
        "invoice", "stock_code", "description", "quantity",
        "invoice_date", "price", "customer_id", "country",
    ]
    sales = clean.as_of(clean.clean_sales(raw, retail), retail.as_of)
    row = sales.first()
    assert sales.count() == 1 and row["sales"] == Decimal("15.30")
    assert row["description"] == "WHITE HEART HOLDER"

    path = str(tmp_path / "sales")
    for _ in range(2):  # the second write replaces the first
        tables.write_table(sales, path, month_of="invoice_date")
    back = tables.read_table(spark, path)
    assert back.count() == 1 and back.first()["sales_month"] == "2010-12"


def test_snake_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["Invoice Date", "StockCode", "customer.ID", "Stock Code"])
    from tillroll.functions.text import snake_columns

    assert snake_columns(df).columns == ["invoice_date", "stock_code", "customer_id", "stock_code_2"]


def test_list_tables_and_csv_export(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("three")
    assert "three" in tables.list_tables(spark)
    assert tables.read_table(spark, "three").count() == 3
    tables.write_csv(spark.range(3).toDF("Customer Id"), str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.dtypes == [("Customer Id", "string")] and back.count() == 3


def test_csv_keeps_every_line(spark, tmp_path):
    header = "Country,Customer ID,Price,InvoiceDate,Quantity,Description,StockCode,Invoice\n"
    file = tmp_path / "other-order.csv"
    file.write_text(header + "France,17850.0,2.50,2010-12-01,6,MUG,A1,1\n")
    row = tables.read_csv_lines(spark, str(file)).first()
    assert (row["customer_id"], row["price"], row["country"], row["quantity"]) == (
        17850, Decimal("2.50"), "France", 6)

    bad = tmp_path / "bad.csv"
    bad.write_text(
        header + "France,1,2.555,2010-12-01,6,MUG,A1,1\nFrance,x1,2.50,2010-12-01,6,MUG,A1,2\n"
        "France,1,2.50,2010-12-01,6,MUG,A1,3\n"
    )
    assert [r["Invoice"] for r in tables.bad_csv_lines(spark, str(bad)).collect()] == ["1", "2"]
    with pytest.raises(Exception, match="Price is not decimal"):
        tables.read_csv_lines(spark, str(bad)).collect()

    short = tmp_path / "short.csv"
    short.write_text("Invoice,StockCode\n1,A\n")
    with pytest.raises(ValueError, match="missing"):
        tables.read_csv_lines(spark, str(short))
