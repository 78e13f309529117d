"""The CSV reader and the canonical types, from literal files."""

from decimal import Decimal

import pytest
from helpers import lines

from tillroll.operators import reports
from tillroll.sources import bucketed_table, load_transactions_csv, save_bucketed
from tillroll.sources.transactions import TRANSACTION_COLUMNS, conform, read_transactions_csv

HEADER = ",".join(TRANSACTION_COLUMNS)


def read(spark, tmp_path, rows, name="a.csv", **kw):
    path = tmp_path / name
    path.write_bytes("\n".join([*rows, ""]).encode("latin-1"))
    return read_transactions_csv(spark, str(path), **kw).collect()


def test_doubled_quotes_and_commas(spark, tmp_path):
    rows = read(spark, tmp_path, [
        HEADER,
        '1,A,"CHARLIE+LOLA""EXTREMELY BUSY"" SIGN",2,12/1/2010 8:26,2.50,17850.0,United Kingdom',
        '2,B,"a ""b"", c",1,12/1/2010 8:26,1.00,,France',
        '3,C,back\\slash,1,12/1/2010 8:26,1.00,,France',
    ])
    assert [r.Description for r in rows] == ['CHARLIE+LOLA"EXTREMELY BUSY" SIGN', 'a "b", c', "back\\slash"]


def test_line_break_inside_quotes(spark, tmp_path):
    text = [HEADER, '1,A,"RED\nMUG",2,12/1/2010 8:26,2.50,1,UK', "2,B,BLUE,1,12/1/2010 8:26,1,2,UK"]
    rows = read(spark, tmp_path, text, multi_line=True)
    assert [(r.InvoiceNo, r.Description) for r in rows] == [("1", "RED\nMUG"), ("2", "BLUE")]
    with pytest.raises(Exception):  # without the option the broken line stops the job
        read(spark, tmp_path, text, name="b.csv")


def test_columns_by_header_name(spark, tmp_path):
    rows = read(spark, tmp_path, [
        "StockCode,InvoiceNo,Extra,Country,CustomerID,UnitPrice,InvoiceDate,Quantity,Description",
        "85123A,536365,x,UK,17850.0,2.55,12/1/2010 8:26,6,HOLDER",
    ])
    r = rows[0]
    assert (r.InvoiceNo, r.StockCode, r.Description, r.Quantity, r.UnitPrice, r.CustomerID, r.Country) == (
        "536365", "85123A", "HOLDER", 6, Decimal("2.5500"), 17850, "UK")
    with pytest.raises(ValueError, match="Quantity"):
        read(spark, tmp_path, ["InvoiceNo,StockCode", "1,A"], name="b.csv")


def test_prices_keep_their_digits_or_stop(spark, tmp_path):
    line = "1,A,X,1,12/1/2010 8:26,{},1,UK"
    rows = read(spark, tmp_path, [HEADER, line.format("0.001"), line.format("12.3456"), line.format(""), line.format("NaN")])
    assert [r.UnitPrice for r in rows] == [Decimal("0.0010"), Decimal("12.3456"), None, None]
    with pytest.raises(Exception, match="more than 4 decimal places"):
        read(spark, tmp_path, [HEADER, line.format("0.00001")], name="b.csv")


def test_date_layouts(spark, tmp_path):
    line = "1,A,X,1,{},1,1,UK"
    dates = ["12/1/2010 8:26", "2010-12-01 08:26:00", "2010-12-01T08:26:00", "2010-12-01 08:26", "12/1/2010 8:26:00", "2010-12-01T08:26:00.000"]
    rows = read(spark, tmp_path, [HEADER, *map(line.format, dates), line.format("2010-12-01"), line.format("")])
    assert [str(r.InvoiceDate) for r in rows] == ["2010-12-01 08:26:00"] * 6 + ["2010-12-01 00:00:00", "None"]
    with pytest.raises(Exception, match="none of the known layouts"):
        read(spark, tmp_path, [HEADER, line.format("first of May")], name="b.csv")


@pytest.mark.parametrize("line", ["1,A,X,many,12/1/2010 8:26,1,1,UK", "1,A,X,1,12/1/2010 8:26,cheap,1,UK", "1,A"])
def test_malformed_lines_stop_the_job(spark, tmp_path, line):
    with pytest.raises(Exception):
        read(spark, tmp_path, [HEADER, line])


def test_nan_in_floating_columns_is_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [("1", "A", "X", nan, "2011-01-01 00:00:00", nan, nan, "UK"), ("2", "A", "X", 2.0, "2011-01-01 00:00:00", 2.55, 7.0, "UK")],
        "InvoiceNo string, StockCode string, Description string, Quantity double, InvoiceDate string, UnitPrice double, CustomerID double, Country string")
    a, b = conform(df).collect()
    assert (a.Quantity, a.UnitPrice, a.CustomerID) == (None, None, None)
    assert (b.Quantity, b.UnitPrice, b.CustomerID) == (2, Decimal("2.5500"), 7)


def test_quarantine_splits_good_rows_from_rejected_ones(spark, tmp_path):
    good = ["1,A,X,2,12/1/2010 8:26,1.25,7,UK", '2,B,"a, ""b""",-3,2010-12-01 08:26:00,0.0001,,UK', "3,C,,,,NaN,nan,", "4,D,X,2.0,2010-12-01,1,17850.0,UK"]
    bad = {
        "5,A,X,2,soon,1,7,UK": "InvoiceDate is in none of the known layouts",
        "6,A,X,two,2010-12-01,1,7,UK": "Quantity is no whole number",
        "7,A,X,1.5,2010-12-01,1,7,UK": "Quantity is no whole number",
        "8,A,X,99999999999,2010-12-01,1,7,UK": "Quantity is no whole number",
        "9,A,X,1,2010-12-01,free,7,UK": "UnitPrice is no number",
        "10,A,X,1,2010-12-01,1.00001,7,UK": "UnitPrice has more than 4 decimal places",
        "11,A,X,1,2010-12-01,123456789.5,7,UK": "UnitPrice is too large",
        "12,A,X,1,2010-12-01,1,me,UK": "CustomerID is no whole number",
        "13,A,X,1,2010-12-01,1,7.5,UK": "CustomerID is no whole number",
        ",A,X,1,2010-12-01,1,7,UK": "InvoiceNo is missing",
        "14,,X,1,2010-12-01,1,7,UK": "StockCode is missing",
        "15,A,X": "malformed line",
        "16,A,X,1,2010-12-01,1,7,UK,more,still": "malformed line",
        "17,A,X,bad,worse,1,7,UK": "InvoiceDate is in none of the known layouts",
    }
    (tmp_path / "a.csv").write_text("\n".join([HEADER, *good[:2], *list(bad)[:7]]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join([HEADER, *good[2:], *list(bad)[7:]]) + "\n")
    loaded = load_transactions_csv(spark, str(tmp_path))
    assert loaded.lines == len(good) + len(bad) and loaded.good.count() == len(good)
    strict = tmp_path / "good.csv"
    strict.write_text("\n".join([HEADER, *good]) + "\n")
    assert sorted(map(str, loaded.good.collect())) == sorted(map(str, read_transactions_csv(spark, str(strict)).collect()))
    assert loaded.good.schema == read_transactions_csv(spark, str(strict)).schema
    rows = loaded.rejected.collect()
    assert sorted(r.Reason for r in rows) == sorted(bad.values())
    assert {r.Line for r in rows if r.Reason == "malformed line"} == {"15,A,X", "16,A,X,1,2010-12-01,1,7,UK,more,still"}
    assert {r.InvoiceNo: r.Quantity for r in rows}["6"] == "two"
    with pytest.raises(ValueError, match="Quantity"):
        (tmp_path / "c").mkdir()
        (tmp_path / "c" / "c.csv").write_text("InvoiceNo,StockCode\n1,A\n")
        load_transactions_csv(spark, str(tmp_path / "c"))


def test_quarantine_of_good_files_and_of_none(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(HEADER + "\n1,A,X,2,12/1/2010 8:26,1.25,7,UK\n")
    loaded = load_transactions_csv(spark, str(path))
    assert (loaded.lines, loaded.good.count(), loaded.rejected.count()) == (1, 1, 0)
    path = tmp_path / "b.csv"
    path.write_text(HEADER + "\n")
    loaded = load_transactions_csv(spark, str(path))
    assert (loaded.lines, loaded.good.count(), loaded.rejected.count()) == (0, 0, 0)


def test_reports_on_a_bucketed_table_do_not_shuffle_by_customer(spark, tmp_path):
    tx = lines(spark, [(f"I{i // 2}", f"P{i % 7}", "Red Mug", 1 + i % 3, f"2024-{1 + i % 12:02d}-01T10:00:00", 2, None if i % 3 == 0 else i % 11, "UK")
                       for i in range(200)])
    name = save_bucketed(tx, "bucketed_test", buckets=4, path=str(tmp_path / "t"))
    table = bucketed_table(spark, name)
    got = reports.customer_frequency(table)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, reports.customer_frequency(tx).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(CustomerID" not in plan and "SelectedBucketsCount: 4 out of 4" in plan
    assert "hashpartitioning(CustomerID" in reports.customer_frequency(spark.table(name))._jdf.queryExecution().executedPlan().toString()
    both = table.where("CustomerID IS NOT NULL").groupBy("CustomerID").count().join(table.where("Quantity > 1"), "CustomerID")
    assert "hashpartitioning(CustomerID" not in both._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, reports.revenue_by_country(table).collect())) == sorted(map(tuple, reports.revenue_by_country(tx).collect()))
    assert table.count() == 200
