"""Incremental ingestion of invoice-line files: each once, across sessions; bad files stop it."""

import os
import tempfile

import pytest

from tillroll.operators import reports
from tillroll.sources.transactions import read_transactions_parquet
from tillroll.streaming import ingest

HEADER = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"


def _write(folder, name, rows, header=HEADER):
    with open(os.path.join(folder, name), "wb") as f:
        f.write((header + "".join(r + "\n" for r in rows)).encode("latin-1"))


def _folders():
    root = tempfile.mkdtemp(prefix="ingest-")
    src, table = os.path.join(root, "in"), os.path.join(root, "table")
    os.makedirs(src)
    return src, table


def test_each_file_once_across_sessions(spark):
    src, table = _folders()
    _write(src, "a.csv", ["1,A,RED MUG,2,12/1/2010 8:26,2.50,17850.0,United Kingdom",
                          "1,B,BLUE MUG,1,12/1/2010 8:26,1.00,17850.0,United Kingdom"])
    _write(src, "b.csv", ["2,A,RED MUG,-1,1/5/2011 9:00,2.50,,France"])
    ingest(spark, src, table).awaitTermination(120)
    assert read_transactions_parquet(spark, table).count() == 3
    # a new file arrives; another session, with another checkpoint folder of its own, takes it alone
    _write(src, "c.csv", ['3,C,"CAFÉ ""CUP""",4,1/6/2011 10:00,3.00,12345.0,France'])
    other = spark.newSession()
    kept = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="other-"))
    try:
        ingest(other, src, table).awaitTermination(120)
    finally:
        if kept:
            spark.sparkContext.setCheckpointDir(kept)
    tx = read_transactions_parquet(spark, table)
    assert tx.count() == 4 and tx.where("Description = 'CAFÉ \"CUP\"'").count() == 1
    months = {r[0] for r in spark.read.parquet(table).select("InvoiceMonth").distinct().collect()}
    assert months == {"2010-12", "2011-01"}
    rev = {r.Country: r.TotalRevenue for r in reports.revenue_by_country(tx).collect()}
    assert rev == {"United Kingdom": 6.0, "France": 12.0}


@pytest.mark.parametrize("header, row", [
    (HEADER, "1,A,RED MUG,many,12/1/2010 8:26,2.50,1,UK"),
    (HEADER, "1,A,RED MUG"),
    ("StockCode,InvoiceNo,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n", "A,1,RED MUG,2,12/1/2010 8:26,2.50,1,UK"),
])
def test_bad_files_stop_the_ingestion(spark, header, row):
    src, table = _folders()
    _write(src, "a.csv", [row], header)
    with pytest.raises(Exception):
        ingest(spark, src, table).awaitTermination(120)
