"""Rule-based segment playbook: interpretation (U22), recommended actions
with a priority tier (U23) and KPI lists (U24).

The rules test which words a segment label contains and take the first
rule that matches. They are kept as data (the fixed texts below) and turned
into one ``CASE WHEN`` column expression each, so applying them is a
projection: no join, no shuffle. Per-customer actions are a projection plus
``explode`` of the customer's (at most five) actions.

The priority tier here (``ActionPriority``, by label) is unrelated to the
median-based ``Priority`` of the segment summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Texts and tests that must equal the reference's output.
# A test is a tuple of words that must all occur in the label; () matches any.
# ---------------------------------------------------------------------------

CHARACTERISTICS_HEADER = "**Segment Characteristics:**\n"

CHARACTERISTICS = [
    ("Active Loyal",
     "This segment represents your loyal customer base with recent purchases. "
     "These customers shop frequently and demonstrate strong engagement with your products. ",
     [(("High-Value",),
       "They are high spenders who contribute significantly to your revenue. "
       "Their high average order value indicates comfort with premium products.\n\n"),
      (("Mid-Value",),
       "They are consistent spenders with moderate basket sizes. "
       "Their purchase frequency makes them valuable despite moderate order values.\n\n"),
      ((),
       "While loyal, these customers tend to make smaller purchases. "
       "Their value comes from consistency rather than transaction size.\n\n")]),
    ("Active Occasional",
     "This segment consists of customers who have purchased recently but infrequently. "
     "They are engaged but haven't developed a consistent purchase pattern. ",
     [(("High-Value",),
       "Despite their infrequent purchases, they spend significantly when they do buy. "
       "These may be seasonal shoppers or customers who make occasional large purchases.\n\n"),
      (("Mid-Value",),
       "These customers make moderate purchases on an irregular basis. "
       "They may be new customers still exploring your product range.\n\n"),
      ((),
       "These are likely new or casual customers who have made small, infrequent purchases. "
       "They show interest but haven't committed to regular purchases.\n\n")]),
    ("Recent",
     "This segment includes customers with moderately recent purchases. "
     "They haven't bought very recently but are still within a reasonable timeframe. ",
     [(("Loyal",),
       "These were previously consistent customers who may be showing early signs of churn. "
       "Their historical loyalty makes them good candidates for re-engagement.\n\n"),
      ((),
       "These customers make purchases sporadically and are at risk of becoming inactive. "
       "Their irregular purchase pattern suggests low brand loyalty.\n\n")]),
    ("Inactive",
     "This segment represents customers who haven't purchased in a significant period. ",
     [(("Loyal",),
       "These were previously loyal customers who have stopped purchasing. "
       "Their historical engagement suggests they may be receptive to win-back campaigns.\n\n"),
      (("Occasional", "High-Value"),
       "These customers made infrequent but large purchases and have since become inactive. "
       "They may be project-based buyers or seasonal shoppers who make large but infrequent purchases.\n\n"),
      ((),
       "These customers made few, low-value purchases before becoming inactive. "
       "They likely had limited engagement with your brand from the beginning.\n\n")]),
]

RECOMMENDATIONS = [
    ("Active Loyal", [
        (("High-Value",), "HIGH", "Retention and premium development", [
            ("Loyalty program tier upgrades", "Offer exclusive benefits and early access to new products"),
            ("Personal shopping assistance", "Provide dedicated customer service representatives"),
            ("Premium product recommendations", "Suggest complementary high-value items"),
            ("Customer advisory board", "Invite to provide feedback on future products"),
            ("Exclusive events", "Host VIP shopping experiences")]),
        (("Mid-Value",), "HIGH", "Value enhancement and loyalty rewards", [
            ("Tiered loyalty rewards", "Encourage incremental spending increases"),
            ("Bundle offers", "Create packages that increase average order value"),
            ("Category expansion", "Introduce them to new product categories"),
            ("Referral incentives", "Reward for bringing in new customers"),
            ("Subscription options", "Offer convenience and discounts for recurring purchases")]),
        ((), "MEDIUM", "Frequency maintenance and value growth", [
            ("Basket building incentives", "Offer tiered discounts based on order size"),
            ("Cross-sell campaigns", "Suggest complementary products at checkout"),
            ("Educational content", "Share product usage ideas to increase utility"),
            ("Limited-time promotions", "Create urgency for additional purchases"),
            ("Loyalty points acceleration", "Offer bonus points for larger orders")]),
    ]),
    ("Active Occasional", [
        (("High-Value",), "HIGH", "Frequency development with value preservation", [
            ("Personalized reorder reminders", "Gently prompt based on typical purchase cycle"),
            ("Curated collections", "Create personalized showcases of new items"),
            ("Incentivized frequency program", "Reward for increasing purchase regularity"),
            ("Premium product education", "Share detailed information about high-value items"),
            ("Seasonal preview access", "Offer early access to new collections")]),
        ((), "MEDIUM", "Engagement and frequency building", [
            ("Second purchase incentives", "Offer special discount on next order"),
            ("Product discovery campaigns", "Highlight diverse product categories"),
            ("Engagement-focused emails", "Share content that drives site visits"),
            ("Limited-time free shipping", "Reduce barriers to repeat purchase"),
            ("Social media engagement", "Invite to follow and engage with brand content")]),
    ]),
    ("Recent", [
        ((), "HIGH", "Re-engagement and churn prevention", [
            ("Win-back offers", "Provide compelling incentives to return"),
            ("Product updates", "Highlight new items since last purchase"),
            ("Feedback surveys", "Learn why purchase frequency has decreased"),
            ("Personalized recommendations", "Based on previous purchase history"),
            ("Re-engagement email sequence", "Series of targeted communications")]),
    ]),
    ("Inactive", [
        (("High-Value",), "MEDIUM", "High-value recovery", [
            ("VIP win-back program", "Exclusive offers for returning customers"),
            ("Personal outreach", "Direct contact from customer service"),
            ("Major product announcements", "Share significant new offerings"),
            ("Substantial incentives", "Provide meaningful discounts to return"),
            ("Account review", "Ensure no service issues caused departure")]),
        (("Loyal",), "MEDIUM", "Loyalty recovery", [
            ("'We miss you' campaigns", "Emotionally engaging re-engagement"),
            ("Loyalty status preservation", "Extend status with next purchase"),
            ("New product highlights", "Showcase innovation since last purchase"),
            ("Re-engagement survey", "Learn what would bring them back"),
            ("Win-back discount ladder", "Increasing incentives over time")]),
        ((), "LOW", "Selective reactivation", [
            ("Final reactivation attempt", "Last-chance special offer"),
            ("New customer-like offers", "Treat as essentially new to the brand"),
            ("Low-cost engagement", "Social media and email reconnection"),
            ("Feedback survey", "Learn about their departure for future improvement"),
            ("Automated reactivation program", "Periodic reminders with minimal resource investment")]),
    ]),
]

UNIVERSAL_KPIS = [
    "Segment size (customer count and percentage)",
    "Segment revenue contribution",
    "Segment profitability",
]

SEGMENT_KPIS = [
    ("Active Loyal",
     ["Retention rate", "Repeat purchase rate", "Average time between purchases",
      "Loyalty program participation rate", "Product category penetration", "Share of wallet (estimated)"],
     [(("High-Value",), ["Premium product adoption rate", "VIP service utilization", "Referral generation"]),
      ((), ["Average order value growth", "Cross-sell success rate"])]),
    ("Active Occasional",
     ["Conversion to loyal segment", "Purchase frequency growth", "Email engagement rate",
      "Website visit frequency", "Second purchase rate"],
     [(("High-Value",), ["Repeat high-value purchase rate", "Premium product exploration"]),
      ((), ["Average order value growth", "Product category exploration"])]),
    ("Recent",
     ["Reactivation rate", "Days since last purchase", "Win-back campaign response rate", "Churn rate",
      "Email open and click rates"],
     []),
    ("Inactive",
     ["Reactivation rate", "Win-back campaign ROI", "Email deliverability", "Unsubscribe rate"],
     # "High-Value" or "Loyal": two alternatives with the same list
     [(("High-Value",), ["Recovery rate compared to acquisition cost", "Feedback survey completion rate"]),
      (("Loyal",), ["Recovery rate compared to acquisition cost", "Feedback survey completion rate"])]),
]

# ---------------------------------------------------------------------------


def _test(label: Column, words) -> Column:
    cond = F.lit(True)
    for w in words:
        cond = cond & label.contains(w)
    return cond


def _first_match(label: Column, cases: list[tuple[tuple, Column]]) -> Column:
    expr = None
    for words, value in cases:
        cond = _test(label, words)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr


def characteristics(label: Column) -> Column:
    """Characteristics paragraph of a label (NULL when no group matches)."""
    cases = []
    for group, intro, details in CHARACTERISTICS:
        for words, text in details:
            cases.append(((group, *words), F.lit(CHARACTERISTICS_HEADER + intro + text)))
    return _first_match(label, cases)


def _fmt(c: Column, places: int, grouping: bool = True) -> Column:
    s = F.format_number(c.cast("double"), places)
    return s if grouping else F.regexp_replace(s, ",", "")


def metrics_block(df: DataFrame) -> Column:
    """Header and key-metrics block of the interpretation text (its wording is a fixed value too)."""
    return F.concat(
        F.lit("### "), F.col("Segment"), F.lit(" Segment Analysis\n\n"),
        F.lit("**Customer Base:** "), _fmt(F.col("CustomerCount"), 0), F.lit(" customers "),
        F.lit("("), _fmt(F.col("PercentOfCustomers"), 1, False), F.lit("% of total)\n\n"),
        F.lit("**Key Metrics:**\n"),
        F.lit("- **Recency:** "), _fmt(F.col("Recency"), 1, False), F.lit(" days since last purchase\n"),
        F.lit("- **Frequency:** "), _fmt(F.col("Frequency"), 1, False), F.lit(" purchases on average\n"),
        F.lit("- **Monetary:** $"), _fmt(F.col("Monetary"), 2), F.lit(" average total spend\n"),
        F.lit("- **Average Order Value:** $"), _fmt(F.col("AvgOrderValue"), 2), F.lit("\n"),
        F.lit("- **Product Diversity:** "), _fmt(F.col("ProductDiversity"), 1, False),
        F.lit(" unique products purchased\n"),
        F.lit("- **Predicted Quarterly Value:** $"), _fmt(F.col("PredictedQuarterlyValue"), 2), F.lit("\n"),
        F.lit("- **Growth Potential Score:** "), _fmt(F.col("GrowthPotentialScore"), 1, False),
        F.lit("/100\n\n"),
    )


def segment_interpretation(insights: DataFrame) -> DataFrame:
    """Per segment, the characteristics paragraph and the full
    interpretation text (metrics block + characteristics)."""
    ch = characteristics(F.col("Segment"))
    return insights.select(
        "Segment",
        ch.alias("Characteristics"),
        F.concat(metrics_block(insights), F.coalesce(ch, F.lit(""))).alias("Interpretation"),
    )


def _recommendation(label: Column) -> Column:
    """struct(ActionPriority, Focus, Actions array<struct(Rank, Action, Detail)>)."""
    cases = []
    for group, branches in RECOMMENDATIONS:
        for words, priority, focus, actions in branches:
            arr = F.array(*[
                F.struct(F.lit(i + 1).alias("Rank"), F.lit(t).alias("Action"), F.lit(d).alias("Detail"))
                for i, (t, d) in enumerate(actions)
            ])
            cases.append(((group, *words), F.struct(
                F.lit(priority).alias("ActionPriority"), F.lit(focus).alias("Focus"), arr.alias("Actions"))))
    return _first_match(label, cases)


def segment_actions(segments: DataFrame) -> DataFrame:
    """U23 per segment: ActionPriority, Focus and the ranked actions (one
    row per action; one row of NULLs for a label no rule covers)."""
    rec = segments.select("Segment", _recommendation(F.col("Segment")).alias("r"))
    return rec.select(
        "Segment", F.col("r.ActionPriority").alias("ActionPriority"), F.col("r.Focus").alias("Focus"),
        F.explode_outer("r.Actions").alias("a"),
    ).select("Segment", "ActionPriority", "Focus", F.col("a.Rank").alias("Rank"),
             F.col("a.Action").alias("Action"), F.col("a.Detail").alias("Detail"))


def customer_actions(final: DataFrame) -> DataFrame:
    """U23 per customer: every customer with each action of its segment
    (a projection plus explode; no join, no shuffle)."""
    rec = final.select("CustomerID", "Segment", _recommendation(F.col("Segment")).alias("r"))
    return rec.select(
        "CustomerID", "Segment", F.col("r.ActionPriority").alias("ActionPriority"),
        F.explode_outer("r.Actions").alias("a"),
    ).select("CustomerID", "Segment", "ActionPriority", F.col("a.Rank").alias("Rank"),
             F.col("a.Action").alias("Action"))


def _kpi_array(kpis: list[str], group: str) -> list[Column]:
    return [F.struct(F.lit(group).alias("KpiGroup"), F.lit(k).alias("Kpi")) for k in kpis]


def segment_kpis(segments: DataFrame) -> DataFrame:
    """KPIs to track per segment, one row each:
    (Segment, KpiGroup = 'Universal' | 'Segment-Specific', Rank, Kpi)."""
    universal = _kpi_array(UNIVERSAL_KPIS, "Universal")
    cases = []
    for group, common, extras in SEGMENT_KPIS:
        for words, extra in extras:
            cases.append(((group, *words), F.array(*universal, *_kpi_array(common + extra, "Segment-Specific"))))
        cases.append(((group,), F.array(*universal, *_kpi_array(common, "Segment-Specific"))))
    cases.append(((), F.array(*universal)))
    lists = segments.select("Segment", _first_match(F.col("Segment"), cases).alias("k"))
    return lists.select("Segment", F.posexplode("k").alias("pos", "x")).select(
        "Segment", F.col("x.KpiGroup").alias("KpiGroup"), (F.col("pos") + 1).alias("Rank"),
        F.col("x.Kpi").alias("Kpi"))
