"""Segment insights, summary priority, date dimension, rankings and KPIs."""

from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from tillroll.operators import insights, playbook


def _final(spark, rows):
    """rows: (CustomerID, Segment, Recency, Monetary)"""
    data = [(cid, seg, cid % 3, rec, 2, Decimal(str(m)), 10.0, 3, 5.0, 1.0, 50.0, datetime(2011, 1, 1))
            for cid, seg, rec, m in rows]
    return spark.createDataFrame(
        data,
        "CustomerID long, Segment string, Cluster int, Recency long, Frequency long, Monetary decimal(20,2), "
        "AvgOrderValue double, ProductDiversity long, AvgItemsPerOrder double, PredictedQuarterlyValue double, "
        "GrowthPotentialScore double, FirstPurchase timestamp_ntz",
    )


def test_share_double_rounding_as_published(spark):
    # 2 of 4,338 customers: 0.0461% -> 0.05 -> printed as 0.1 (the published 0.1%)
    rows = [(i, "Small" if i < 2 else "Big", 1, 1.0) for i in range(4338)]
    ins = {r.Segment: r for r in insights.segment_insights(_final(spark, rows)).collect()}
    assert ins["Small"].PercentOfCustomers == 0.05
    assert ins["Big"].PercentOfCustomers == 99.95
    text = playbook.segment_interpretation(insights.segment_insights(_final(spark, rows))) \
        .filter(F.col("Segment") == "Small").first().Interpretation
    assert "(0.1% of total)" in text and "**Customer Base:** 2 customers" in text


def test_means_round_half_to_even(spark):
    rows = [(i, "S", 2 if i == 7 else 1, 1.0) for i in range(8)]  # Recency mean 9/8 = 1.125
    rows += [(100 + i, "T", 1 if i == 0 else 2, 1.0) for i in range(8)]  # 15/8 = 1.875
    ins = {r.Segment: r for r in insights.segment_insights(_final(spark, rows)).collect()}
    assert ins["S"].Recency == 1.12 and ins["T"].Recency == 1.88


def test_summary_priority_rules(spark):
    ins = spark.createDataFrame(
        [("A", 1000, 50.0, 10.0, 100.0, 5.0, 1.0, 20.0, 60.0, 5.0),
         ("B", 10, 50.0, 10.0, 10.0, 5.0, 1.0, 20.0, 10.0, 5.0),
         ("C", 400, 50.0, 10.0, 50.0, 5.0, 1.0, 20.0, 10.0, 5.0),
         ("D", 300, 50.0, 10.0, 40.0, 5.0, 1.0, 20.0, 10.0, 30.0)],
        "Segment string, CustomerCount long, Recency double, Frequency double, Monetary double, "
        "AvgOrderValue double, ProductDiversity double, PredictedQuarterlyValue double, "
        "GrowthPotentialScore double, PercentOfCustomers double",
    )
    got = {r.Segment: r for r in insights.segment_summary(ins).collect()}
    # medians: count 350, monetary 45
    assert got["A"].Priority == "High" and got["C"].Priority == "High"
    assert got["B"].Priority == "Low"
    assert got["D"].Priority == "Medium"
    assert got["A"].TotalRevenue == 100000.0 and got["A"].PredictedValue == 20000.0


def test_date_dimension_calendar(spark):
    final = spark.createDataFrame(
        [(datetime(2011, 1, 1, 10, 0),), (datetime(2011, 1, 3, 0, 0),)], "FirstPurchase timestamp_ntz")
    dd = insights.date_dimension(final).orderBy("Date").collect()
    assert len(dd) == 92  # to 2011-04-03 00:00 in steps keeping 10:00
    first = dd[0]
    assert (first.Year, first.Quarter, first.Month, first.MonthName, first.Week) == (2011, 1, 1, "January", 52)
    assert (first.Weekday, first.WeekdayName, first.IsWeekend) == (5, "Saturday", 1)
    assert dd[2].Weekday == 0 and dd[2].WeekdayName == "Monday" and dd[2].IsWeekend == 0
    assert str(dd[-1].Date) == "2011-04-02 10:00:00"


def test_ranking_and_kpis(spark):
    ins = spark.createDataFrame(
        [("A", 2, 10.0, 1.0, 100.25, 5.0, 3.0, 20.5, 60.0, 40.0),
         ("B", 3, 10.0, 2.0, 50.5, 9.0, 8.0, 10.25, 10.0, 60.0)],
        "Segment string, CustomerCount long, Recency double, Frequency double, Monetary double, "
        "AvgOrderValue double, ProductDiversity double, PredictedQuarterlyValue double, "
        "GrowthPotentialScore double, PercentOfCustomers double",
    )
    rank = {(r.Metric, r.Segment): r.Rank for r in insights.segment_ranking(ins).collect()}
    assert rank[("Monetary", "A")] == 1 and rank[("Frequency", "B")] == 1
    k = insights.headline_kpis(ins).first()
    assert k.TotalCustomers == 5
    assert k.TotalRevenue == 100.25 * 2 + 50.5 * 3
    assert k.PredictedQuarterlyRevenue == 20.5 * 2 + 10.25 * 3
    assert abs(k.AvgCustomerValue - (352.0 / 5)) < 1e-12


def test_customer_sample_size_and_repeatable(spark):
    rows = [(i, "S", 1, float(i)) for i in range(1500)]
    f = _final(spark, rows)
    a = [r.CustomerID for r in insights.customer_sample(f).collect()]
    b = [r.CustomerID for r in insights.customer_sample(f).collect()]
    assert len(a) == 1000 and a == b
    small = [r.CustomerID for r in insights.customer_sample(_final(spark, rows[:20])).collect()]
    assert sorted(small) == list(range(20))


def test_segment_sizes(spark):
    rows = [(i, "S" if i < 3 else "T", 1, 1.0) for i in range(5)]
    got = {(r.Level, r.Name): r.CustomerCount for r in insights.segment_sizes(_final(spark, rows)).collect()}
    assert got[("Segment", "S")] == 3 and got[("Segment", "T")] == 2
    assert sum(v for (lvl, _), v in got.items() if lvl == "Cluster") == 5


def test_results_do_not_depend_on_the_partition_layout(spark):
    import random

    rng = random.Random(7)
    rows = [(i, f"S{i % 3}", rng.randint(1, 300), round(rng.uniform(1, 9000), 2)) for i in range(3000)]
    final = _final(spark, rows).withColumn("AvgOrderValue", F.col("Monetary").cast("double") / 7) \
        .withColumn("PredictedQuarterlyValue", F.col("Monetary").cast("double") / 3) \
        .withColumn("GrowthPotentialScore", F.log1p(F.col("Monetary").cast("double")))
    seen = set()
    for layout in (final.repartition(1), final.repartition(13), final.repartition(5, "Monetary"), final.orderBy(F.desc("Monetary"))):
        ins = insights.segment_insights(layout)
        seen.add((str(ins.collect()), str(insights.segment_summary(ins).orderBy("Segment").collect()),
                  str(insights.headline_kpis(ins).collect()), insights.dashboard_text(ins).first().Summary,
                  str(playbook.segment_interpretation(ins).orderBy("Segment").collect())))
    assert len(seen) == 1


def test_size_table_is_ordered(spark):
    rows = [(1, "B", 1, 1.0), (2, "A", 1, 1.0), (3, "C", 1, 1.0), (4, "C", 1, 1.0), (5, "A", 1, 1.0), (6, "C", 1, 1.0), (9, "B", 1, 1.0)]
    got = [tuple(r) for r in insights.segment_sizes(_final(spark, rows)).collect()]
    assert got == [("Cluster", "0", 3), ("Cluster", "1", 2), ("Cluster", "2", 2), ("Segment", "C", 3), ("Segment", "A", 2), ("Segment", "B", 2)]
    assert [r.Segment for r in insights.segment_insights(_final(spark, rows)).collect()] == ["A", "B", "C"]


def test_segment_contribution_shares_are_exact(spark):
    rows = [("A", Decimal("10.0000")), ("A", Decimal("0.0050")), ("B", Decimal("20.0100")), (None, Decimal("0.0000"))]
    final = spark.createDataFrame(rows, "Segment string, Monetary decimal(12,4)")
    got = {r.Segment: tuple(r)[1:] for r in insights.segment_contribution(final).collect()}
    assert got == {"A": (2, Decimal("10.0050"), 0.5, 0.3333, 5.0), "B": (1, Decimal("20.0100"), 0.25, 0.6667, 20.01),
                   None: (1, Decimal("0.0000"), 0.25, 0.0, 0.0)}
    assert insights.segment_contribution(final.limit(0)).count() == 0
