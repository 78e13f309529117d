"""Playbook rules against the published recommendations and KPI lists."""

from pyspark.sql import functions as F

from tillroll.operators import playbook

PUBLISHED = ["Active Loyal Low-Value", "Inactive Occasional High-Value", "Inactive Occasional Low-Value"]


def _segments(spark, labels):
    return spark.createDataFrame([(s,) for s in labels], "Segment string")


def test_published_priorities_and_action_titles(spark):
    acts = playbook.segment_actions(_segments(spark, PUBLISHED)).orderBy("Segment", "Rank").collect()
    by = {}
    for r in acts:
        by.setdefault(r.Segment, []).append(r)
    assert {s: rows[0].ActionPriority for s, rows in by.items()} == {
        "Active Loyal Low-Value": "MEDIUM",
        "Inactive Occasional High-Value": "MEDIUM",
        "Inactive Occasional Low-Value": "LOW",
    }
    assert [r.Action for r in by["Active Loyal Low-Value"]] == [
        "Basket building incentives", "Cross-sell campaigns", "Educational content",
        "Limited-time promotions", "Loyalty points acceleration"]
    assert [r.Action for r in by["Inactive Occasional High-Value"]][0] == "VIP win-back program"
    assert by["Inactive Occasional Low-Value"][-1].Detail == \
        "Periodic reminders with minimal resource investment"


def test_published_kpi_lists(spark):
    k = playbook.segment_kpis(_segments(spark, PUBLISHED)).collect()
    counts = {}
    for r in k:
        counts[r.Segment] = counts.get(r.Segment, 0) + 1
    assert counts == {"Active Loyal Low-Value": 11, "Inactive Occasional High-Value": 9,
                      "Inactive Occasional Low-Value": 7}
    hv = [r.Kpi for r in sorted(k, key=lambda r: r.Rank) if r.Segment == "Inactive Occasional High-Value"]
    assert hv[-2:] == ["Recovery rate compared to acquisition cost", "Feedback survey completion rate"]


def test_active_regular_has_no_rules(spark):
    seg = _segments(spark, ["Active Regular Mid-Value"])
    (a,) = playbook.segment_actions(seg).collect()
    assert a.ActionPriority is None and a.Action is None
    k = playbook.segment_kpis(seg).collect()
    assert [r.KpiGroup for r in k] == ["Universal"] * 3
    assert seg.select(playbook.characteristics(F.col("Segment"))).first()[0] is None


def test_inactive_loyal_rules_differ_between_actions_and_kpis(spark):
    seg = _segments(spark, ["Inactive Loyal Low-Value"])
    assert playbook.segment_actions(seg).first().Focus == "Loyalty recovery"
    assert playbook.segment_kpis(seg).count() == 3 + 4 + 2


def test_customer_actions_explode_per_customer(spark):
    final = spark.createDataFrame([(1, "Recent Occasional Low-Value"), (2, "Active Regular Low-Value")],
                                  "CustomerID long, Segment string")
    rows = playbook.customer_actions(final).collect()
    assert sum(r.CustomerID == 1 for r in rows) == 5
    assert [r.Action for r in rows if r.CustomerID == 2] == [None]


# label: priority, focus, first action, last KPI, number of KPIs, end of the characteristics
EXPECTED = {
    "Active Loyal High-Value": ("HIGH", "Retention and premium development", "Loyalty program tier upgrades", "Referral generation", 12,
                                "comfort with premium products.\n\n"),
    "Active Loyal Mid-Value": ("HIGH", "Value enhancement and loyalty rewards", "Tiered loyalty rewards", "Cross-sell success rate", 11,
                               "valuable despite moderate order values.\n\n"),
    "Active Loyal Low-Value": ("MEDIUM", "Frequency maintenance and value growth", "Basket building incentives", "Cross-sell success rate", 11,
                               "consistency rather than transaction size.\n\n"),
    "Active Occasional High-Value": ("HIGH", "Frequency development with value preservation", "Personalized reorder reminders",
                                     "Premium product exploration", 10, "make occasional large purchases.\n\n"),
    "Active Occasional Mid-Value": ("MEDIUM", "Engagement and frequency building", "Second purchase incentives",
                                    "Product category exploration", 10, "still exploring your product range.\n\n"),
    "Active Occasional Low-Value": ("MEDIUM", "Engagement and frequency building", "Second purchase incentives",
                                    "Product category exploration", 10, "haven't committed to regular purchases.\n\n"),
}
for _v in ("High-Value", "Mid-Value", "Low-Value"):
    EXPECTED[f"Active Regular {_v}"] = (None, None, None, "Segment profitability", 3, None)
    for _l in ("Loyal", "Regular", "Occasional"):
        EXPECTED[f"Recent {_l} {_v}"] = (
            "HIGH", "Re-engagement and churn prevention", "Win-back offers", "Email open and click rates", 8,
            "good candidates for re-engagement.\n\n" if _l == "Loyal" else "suggests low brand loyalty.\n\n")
for _l in ("Loyal", "Regular", "Occasional"):
    _end = "receptive to win-back campaigns.\n\n" if _l == "Loyal" else "engagement with your brand from the beginning.\n\n"
    EXPECTED[f"Inactive {_l} High-Value"] = (
        "MEDIUM", "High-value recovery", "VIP win-back program", "Feedback survey completion rate", 9,
        "make large but infrequent purchases.\n\n" if _l == "Occasional" else _end)
    for _v in ("Mid-Value", "Low-Value"):
        EXPECTED[f"Inactive {_l} {_v}"] = (
            ("MEDIUM", "Loyalty recovery", "'We miss you' campaigns", "Feedback survey completion rate", 9, _end) if _l == "Loyal" else
            ("LOW", "Selective reactivation", "Final reactivation attempt", "Unsubscribe rate", 7, _end))


def test_all_27_labels(spark):
    assert len(EXPECTED) == 27
    seg = _segments(spark, sorted(EXPECTED))
    acts, kpis = {}, {}
    for r in playbook.segment_actions(seg).orderBy("Segment", "Rank").collect():
        acts.setdefault(r.Segment, []).append(r)
    for r in playbook.segment_kpis(seg).orderBy("Segment", "Rank").collect():
        kpis.setdefault(r.Segment, []).append(r.Kpi)
    text = {r[0]: r[1] for r in seg.select("Segment", playbook.characteristics(F.col("Segment"))).collect()}
    for label, (priority, focus, action, kpi, n, end) in EXPECTED.items():
        a = acts[label]
        assert (a[0].ActionPriority, a[0].Focus, a[0].Action, len(a)) == (priority, focus, action, 5 if priority else 1)
        assert (kpis[label][-1], len(kpis[label])) == (kpi, n)
        assert text[label] is None if end is None else (
            text[label].startswith("**Segment Characteristics:**\nThis segment ") and text[label].endswith(end))
