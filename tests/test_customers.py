"""RFM, behaviour metrics and value projection: traps T1, T1b, T5, T7, A3."""

import math
import re
import random

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import pytest

from tillroll.operators import customers
from tillroll.plans import catalog
from tillroll.session import materialize as session_materialize
from tillroll.sources.transactions import clean_transactions
from helpers import lines


SMOKE = "/root/testdata/sf0.001"


def _by_id(df):
    return {r.CustomerID: r for r in df.collect()}


def test_recency_whole_days_plus_one(spark):
    rows = [
        ("1", "A", "X", 1, "2011-01-01 23:00:00", 1.0, 1, "UK"),
        ("2", "A", "X", 1, "2011-01-03 01:00:00", 1.0, 2, "UK"),  # latest invoice
    ]
    out = _by_id(customers.rfm(clean_transactions(lines(spark, rows))))
    # max + 1 day = 2011-01-04 01:00; customer 1: 2 days 2 h -> 2 whole days
    # (datediff would say 3)
    assert out[1].Recency == 2
    assert out[2].Recency == 1


def test_rfm_drops_non_positive_monetary_and_counts_invoices(spark):
    rows = [
        ("1", "A", "X", 1, "2011-01-01 00:00:00", 5.0, 1, "UK"),
        ("2", "A", "X", 2, "2011-01-02 00:00:00", 5.0, 1, "UK"),
        ("3", "A", "X", 1, "2011-01-02 00:00:00", 0.0, 2, "UK"),
        ("4", "A", "X", -1, "2011-01-02 00:00:00", 3.0, 3, "UK"),
    ]
    out = _by_id(customers.rfm(clean_transactions(lines(spark, rows))))
    assert set(out) == {1}
    assert out[1].Frequency == 2 and float(out[1].Monetary) == 15.0


def test_null_invoice_counts_once_in_frequency(spark):
    rows = [
        ("1", "A", "X", 1, "2011-01-01 00:00:00", 5.0, 1, "UK"),
        (None, "B", "X", 1, "2011-01-02 00:00:00", 5.0, 1, "UK"),
        (None, None, "X", 1, "2011-01-03 00:00:00", 5.0, 1, "UK"),
    ]
    out = _by_id(customers.behaviour_metrics(clean_transactions(lines(spark, rows))))
    r = out[1]
    assert r.Frequency == 2  # "1" and NULL
    assert r.ProductDiversity == 3  # A, B and NULL
    assert r.AvgOrderValue == 5.0  # mean over the known invoice only


def _regularity_brute(dates):
    if len(dates) <= 1:
        return 0.0
    d = sorted(dates)
    gaps = [math.floor((d[i] - d[i - 1]).total_seconds() / 86400) for i in range(1, len(d))]
    return float(np.std(gaps))


def test_regularity_small_cases(spark):
    rows = [
        ("1", "A", "X", 1, "2011-01-01 10:00:00", 1.0, 1, "UK"),  # one order -> 0
        ("2", "A", "X", 1, "2011-01-01 10:00:00", 1.0, 2, "UK"),  # two orders -> 0
        ("3", "A", "X", 1, "2011-01-05 09:00:00", 1.0, 2, "UK"),
        ("4", "A", "X", 1, "2011-01-01 00:00:00", 1.0, 3, "UK"),  # gaps 1, 3, 0
        ("5", "A", "X", 1, "2011-01-02 00:00:00", 1.0, 3, "UK"),
        ("6", "A", "X", 1, "2011-01-05 12:00:00", 1.0, 3, "UK"),
        ("7", "A", "X", 1, "2011-01-05 12:00:00", 1.0, 3, "UK"),
    ]
    out = _by_id(customers.behaviour_metrics(clean_transactions(lines(spark, rows))))
    assert out[1].PurchaseRegularity == 0.0
    assert out[2].PurchaseRegularity == 0.0
    assert math.isclose(out[3].PurchaseRegularity, float(np.std([1, 3, 0])), rel_tol=1e-12)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=60 * 24 * 20), min_size=1, max_size=40),
       st.sampled_from(["hour", "day", "month"]))
def test_regularity_matches_sorted_gaps(spark, minutes, bucket):
    from datetime import datetime, timedelta

    t0 = datetime(2011, 3, 1)
    dates = [t0 + timedelta(minutes=m) for m in minutes]
    random.Random(7).shuffle(dates)
    orders = spark.createDataFrame(
        [(1, str(i), d) for i, d in enumerate(dates)], "CustomerID long, InvoiceNo string, OrderDate timestamp_ntz")
    (r,) = customers.purchase_regularity(orders, bucket=bucket).collect()
    expected = _regularity_brute(dates)
    assert math.isclose(r.PurchaseRegularity, expected, rel_tol=1e-9, abs_tol=1e-12)


def test_value_projection_formulas(spark):
    rows = [
        ("1", "A", "X", 1, "2011-01-01 00:00:00", 10.0, 1, "UK"),
        ("2", "A", "X", 1, "2011-03-02 00:00:00", 20.0, 1, "UK"),
        ("3", "A", "X", 3, "2011-03-01 12:00:00", 10.0, 2, "UK"),
    ]
    clean = clean_transactions(lines(spark, rows))
    feats = customers.behaviour_metrics(clean)
    out = _by_id(customers.value_projection(feats, clean))
    a = out[1]
    assert a.DaysSinceFirst == 60
    assert math.isclose(a.MonthsActive, 60 / 30.44)
    assert math.isclose(a.PurchaseRate, 2 / (60 / 30.44))
    assert math.isclose(a.PredictedQuarterlyValue, 2 / (60 / 30.44) * 3 * 15.0)
    b = out[2]
    assert b.DaysSinceFirst == 0 and b.PurchaseRate == 1.0  # max(MonthsActive, 1)
    g = [(1 / math.log1p(r.Recency)) * math.log1p(r.Frequency) * math.log1p(float(r.Monetary))
         for r in (a, b)]
    assert {round(out[1].GrowthPotentialScore, 9), round(out[2].GrowthPotentialScore, 9)} == {0.0, 100.0}
    assert math.isclose(a.GrowthPotential, g[0])


def test_growth_score_null_when_all_equal(spark):
    rows = [("1", "A", "X", 1, "2011-01-01 00:00:00", 10.0, 1, "UK"),
            ("2", "A", "X", 1, "2011-01-01 00:00:00", 10.0, 2, "UK")]
    clean = clean_transactions(lines(spark, rows))
    out = customers.value_projection(customers.behaviour_metrics(clean), clean)
    assert [r.GrowthPotentialScore for r in out.collect()] == [None, None]  # 0/0 is not an error


def test_nan_customer_id_from_csv_is_dropped(spark, scratch_dir):
    import os

    from tillroll.sources.transactions import read_transactions_csv

    path = os.path.join(scratch_dir, "retail.csv")
    with open(path, "wb") as f:
        f.write(
            "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"
            "536365,85123A,CAF\xc9 MUG,6,12/1/2010 8:26,2.55,17850.0,United Kingdom\n"
            "536366,22633,HAND WARMER,6,12/1/2010 8:28,1.85,,United Kingdom\n"
            "536367,22634,HAND WARMER,6,12/1/2010 8:28,1.85,NaN,United Kingdom\n".encode("latin-1")
        )
    tx = read_transactions_csv(spark, path)
    got = tx.orderBy("InvoiceNo").collect()
    assert got[0].Description == "CAFÉ MUG" and got[0].CustomerID == 17850
    assert str(got[0].InvoiceDate) == "2010-12-01 08:26:00"
    assert got[1].CustomerID is None and got[2].CustomerID is None
    assert clean_transactions(tx).count() == 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_window_holds_the_orders_of_a_customer(spark):
    rows = [("1", "A", "X", 1, "2011-01-01 00:00:00", 10.0, 1, "UK")]
    orders = customers.customer_base(clean_transactions(lines(spark, rows))).orders
    windows = [line for line in _plan(customers.purchase_regularity(orders)).splitlines()
               if re.search(r"(^|[- ])Window \[", line)]
    assert len(windows) == 2
    keys = [re.findall(r"\[([^\]]*)\]", w) for w in windows]
    parts = [re.sub(r"#\d+L?", "", k[-2]) for k in keys]
    # instants lie in windows of (customer, bucket); those of a customer alone hold its buckets
    for w, part in zip(windows, parts):
        assert part == ("CustomerID, Bucket" if "lag(OrderDate" in w else "CustomerID")
        assert "lag(OrderDate" in w or "lag(LastAt" in w


@pytest.mark.parametrize("name", ["rfm", "behaviour_metrics", "value_projection", "cluster_labels"])
def test_the_lines_are_read_once(spark, monkeypatch, name):
    plans = []

    def kept(df, *args, **kw):
        plans.append(_plan(df))
        return session_materialize(df, *args, **kw)

    monkeypatch.setattr(customers, "_materialize", kept)
    monkeypatch.setattr(catalog, "materialize", kept)
    plans.append(_plan(catalog.QUERIES[name](spark, SMOKE)))
    assert sum(p.count("/lineitem.parquet") for p in plans) == 1
