"""Registry of named queries: ``name -> f(spark, sf_dir) -> DataFrame``.

Each query reads the whole star schema under ``sf_dir`` and runs one
operator (or the pipeline up to that operator). Output columns that are
money are returned as DOUBLE after exact DECIMAL arithmetic so the results
compare cleanly with the SQL oracles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.columns import first_word
from tillroll.operators import affinity, alignment, customers, insights, kmeans, lifecycle, penetration, playbook, reports, segments
from tillroll.plans.pipeline import EXPORT_PREFIX, export, run_pipeline
from tillroll.session import materialize, new_path, tune
from tillroll.sources.quarantine import load_transactions_csv
from tillroll.sources.sinks import write_table
from tillroll.sources.tables import bucketed_table, save_bucketed
from tillroll.sources.transactions import (
    TRANSACTION_COLUMNS,
    clean_transactions,
    read_transactions_csv,
    transactions_from_star,
)

Query = Callable[[SparkSession, str], DataFrame]


def _tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_from_star(tune(spark), sf_dir)


def _report(fn) -> Query:
    return lambda spark, sf_dir: fn(_tx(spark, sf_dir))


def q_clean_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean_output(clean_transactions(_tx(spark, sf_dir)))


def q_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned lines written as CSV and read back with the public reader."""
    path = new_path(spark, "csv")
    write_table(_clean(spark, sf_dir).select(*reversed(TRANSACTION_COLUMNS)), path, "csv")
    return _clean_output(clean_transactions(read_transactions_csv(spark, path)))


def _clean_output(df: DataFrame) -> DataFrame:
    return df.withColumn("UnitPrice", F.col("UnitPrice").cast("double")).withColumn(
        "TotalAmount", F.col("TotalAmount").cast("double")
    )


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Cast every DECIMAL column to DOUBLE (exact sums are done by then)."""
    return df.select(*[
        F.col(f.name).cast("double").alias(f.name)
        if f.dataType.typeName() == "decimal" else F.col(f.name)
        for f in df.schema.fields
    ])


def round_columns(df: DataFrame, names: list[str], places: int = 6) -> DataFrame:
    """Round columns that pass through log/exp (last-ulp differences between
    math libraries) for comparison with another engine."""
    return df.select(*[
        F.round(F.col(c), places).alias(c) if c in names else F.col(c) for c in df.columns
    ])


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_transactions(_tx(spark, sf_dir))


def q_rfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decimals_to_double(customers.rfm(_clean(spark, sf_dir)))


def q_behaviour_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decimals_to_double(customers.behaviour_metrics(_clean(spark, sf_dir)))


LOG_DERIVED = ["GrowthPotential", "GrowthPotentialScore"]


def _base(spark: SparkSession, sf_dir: str) -> customers.CustomerBase:
    """Line rollup of the whole data set, checkpointed: the transaction
    joins run once however many steps read the orders and products."""
    return customers.customer_base(_clean(spark, sf_dir), materialize=True)


def q_value_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = customers.customer_features(_base(spark, sf_dir))
    return round_columns(decimals_to_double(customers.value_projection(feats)), LOG_DERIVED)


# ---- segment-level operators on a deterministic stand-in clustering ----
# K-means assignments cannot be reproduced in SQL, so the operators that
# consume clusters (labelling, insights, summary, playbook, ...) are
# registered over Cluster = CustomerID % 5: every customer, all rows, a
# clustering that an independent SQL engine can recompute exactly.
STANDIN_CLUSTERS = 5

MEAN_DOUBLES = ["AvgOrderValue", "AvgItemsPerOrder"]


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(customers.customer_features(_base(spark, sf_dir)), "features")


def standin_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer table after (stand-in) segmentation and value projection,
    checkpointed because every segment-level result reads it."""
    clustered = standin_clusters(_features(spark, sf_dir))
    labels = segments.label_clusters(clustered)
    segmented = segments.attach_segments(clustered, labels)
    return materialize(customers.value_projection(segmented), "final")


def standin_clusters(feats: DataFrame) -> DataFrame:
    return feats.withColumn("Cluster", (F.col("CustomerID") % STANDIN_CLUSTERS).cast("int"))


def q_cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(segments.label_clusters(standin_clusters(_features(spark, sf_dir))), MEAN_DOUBLES)


def _insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.segment_insights(standin_final(spark, sf_dir))


def q_segment_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _insights(spark, sf_dir)


def q_segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.segment_summary(_insights(spark, sf_dir))


def q_date_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.date_dimension(standin_final(spark, sf_dir))


def q_cluster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(segments.cluster_profile(standin_final(spark, sf_dir)), segments.PROFILE_FEATURES)


def q_segment_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.segment_sizes(standin_final(spark, sf_dir))


def q_segment_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decimals_to_double(insights.segment_contribution(standin_final(spark, sf_dir)))


def q_segment_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.segment_ranking(_insights(spark, sf_dir))


def q_headline_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.headline_kpis(_insights(spark, sf_dir))


def q_dashboard_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.dashboard_text(_insights(spark, sf_dir))


def q_customer_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decimals_to_double(insights.customer_sample(standin_final(spark, sf_dir)))


def q_segment_interpretation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return playbook.segment_interpretation(_insights(spark, sf_dir))


def q_segment_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return playbook.segment_actions(_insights(spark, sf_dir))


def q_customer_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return playbook.customer_actions(standin_final(spark, sf_dir))


def q_segment_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return playbook.segment_kpis(_insights(spark, sf_dir))


def q_pipeline_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export set written as CSV, and its customer table read back."""
    final = standin_final(spark, sf_dir)
    seg = materialize(insights.segment_insights(final), "insights")
    path = new_path(spark, "export")
    export({
        "final": decimals_to_double(final), "segment_insights": seg, "segment_summary": insights.segment_summary(seg),
        "date_dimension": insights.date_dimension(final), "interpretations": playbook.segment_interpretation(seg),
        "recommendations": playbook.segment_actions(seg), "kpis": playbook.segment_kpis(seg),
    }, path, fmt="csv")
    back = spark.read.option("header", True).option("escape", '"').schema(decimals_to_double(final).schema).csv(
        f"{path}/{EXPORT_PREFIX}customers")
    return round_columns(back, LOG_DERIVED)


#: For each export a figure that its values add up to.
EXPORT_TOTALS = {
    "customers": "SUM(CAST(Monetary AS DECIMAL(20,4)))",
    "segment_profiles": "SUM(CAST(Monetary AS DECIMAL(20,2)) + CustomerCount)",
    "date_dimension": "SUM(Day + Weekday)",
    "segment_summary": "SUM(CAST(TotalRevenue AS DECIMAL(20,2)))",
    "segment_interpretations": "SUM(LENGTH(Interpretation))",
    "segment_recommendations": "SUM(LENGTH(Action) + LENGTH(Detail))",
    "segment_kpis": "SUM(LENGTH(Kpi))",
}


def q_pipeline_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_pipeline over the stand-in clusters, every CSV export read back: its rows and what its values add up to."""
    def standin(features: DataFrame):
        clustered = standin_clusters(features)
        labels = segments.label_clusters(clustered)
        return segments.attach_segments(clustered, labels), labels, None

    path = new_path(spark, "run")
    results = run_pipeline(_tx(spark, sf_dir), out_dir=path, fmt="csv", segmenter=standin)
    frames = {"customers": "final", "segment_profiles": "segment_insights", "date_dimension": "date_dimension", "segment_summary": "segment_summary",
              "segment_interpretations": "interpretations", "segment_recommendations": "recommendations", "segment_kpis": "kpis"}
    rows = None
    for name, total in EXPORT_TOTALS.items():
        back = (spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(results[frames[name]].schema)
                .csv(f"{path}/{EXPORT_PREFIX}{name}"))
        own = back.agg(F.count(F.lit(1)).alias("Rows"), F.expr(total).cast("double").alias("Total")).select(F.lit(name).alias("Table"), "Rows", "Total")
        rows = own if rows is None else rows.union(own)
    return rows


# ---- scaling, cluster scores, Lloyd iterations and PCA over the real customer table ----

def _scaled(feats: DataFrame, *keep: str) -> DataFrame:
    names = list(segments.CLUSTER_FEATURES)
    columns = segments.feature_columns(feats)
    mus, sds, _var = segments.scaling_constants(columns, names)
    scaled = [((segments.feature_expr(n) - F.lit(mu)) / F.lit(sd)).alias(n) for n, mu, sd in zip(names, mus, sds)]
    return feats.select("CustomerID", *keep, *scaled)


def q_scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(_scaled(_features(spark, sf_dir)), segments.CLUSTER_FEATURES)


def q_standin_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = _scaled(standin_clusters(_features(spark, sf_dir)), "Cluster")
    return round_columns(segments.cluster_silhouette(scaled, segments.CLUSTER_FEATURES), ["Silhouette"])


def q_standin_inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = _scaled(standin_clusters(_features(spark, sf_dir)), "Cluster")
    return round_columns(segments.cluster_inertia(scaled, segments.CLUSTER_FEATURES), ["Inertia"])


FIXED_START, FIXED_ITERATIONS = 3, 4


def q_kmeans_fixed_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lloyd's iterations from the three smallest customer ids, then every customer's cluster (M3, M6)."""
    names = list(segments.CLUSTER_FEATURES)
    scaled = materialize(_scaled(_features(spark, sf_dir)), "vectors")
    start = [[r[n] for n in names] for r in scaled.orderBy("CustomerID").limit(FIXED_START).collect()]
    centers = kmeans.lloyd(scaled, names, start, FIXED_ITERATIONS)
    return scaled.select("CustomerID", kmeans.nearest_center([F.col(n) for n in names], centers).alias("Cluster"))


SWEEP_KS, SWEEP_ITERATIONS = (2, 3, 4, 5), 3


def q_k_selection_fixed_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k sweep, each k from the customers with the k smallest ids: inertia, silhouette and the chosen k."""
    names = list(segments.CLUSTER_FEATURES)
    scaled = materialize(_scaled(_features(spark, sf_dir)), "vectors")
    first = [[r[n] for n in names] for r in scaled.orderBy("CustomerID").limit(max(SWEEP_KS)).collect()]
    sweep = segments.sweep_from_starts(scaled, names, [first[:k] for k in SWEEP_KS], SWEEP_ITERATIONS)
    return round_columns(segments.k_selection_frame(spark, sweep), ["silhouette", "inertia"])


def q_pca_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    _scores, components = segments.pca_projection(standin_final(spark, sf_dir))
    return round_columns(components, ["Loading", "ExplainedVarianceRatio"])


# ---- the K-means sweep with random restarts (not expressible in SQL: rows-only checks) ----

def _kmeans(spark: SparkSession, sf_dir: str):
    return segments.enhanced_segmentation(_features(spark, sf_dir))


def q_kmeans_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    segmented, _labels, _curve = _kmeans(spark, sf_dir)
    return decimals_to_double(customers.value_projection(segmented))


def q_k_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.k_selection(_features(spark, sf_dir))


def q_pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _components = segments.pca_projection(standin_final(spark, sf_dir))
    return round_columns(scores, ["PC1", "PC2"])


# ---- purchase patterns and customer lifecycle (X2-X8) ----

def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(spark, sf_dir).orders


def _orders_and_segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The orders, and the (stand-in) segment of each customer, from one pass over the lines."""
    base = _base(spark, sf_dir)
    clustered = standin_clusters(materialize(customers.customer_features(base), "features"))
    return base.orders, segments.attach_segments(clustered, segments.label_clusters(clustered)).select("CustomerID", "Segment")


def q_product_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return affinity.product_affinity(_clean(spark, sf_dir))


def q_category_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of two and three categories that share at least ten baskets."""
    sets = affinity.product_sets(_clean(spark, sf_dir), first_word(F.col("Description")), min_support=10, max_size=3)
    return sets.select(F.array_join("Items", ", ").alias("Items"), F.size("Items").alias("Size"), "Together")


def q_cohort_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.cohort_retention(_orders(spark, sf_dir))


def q_segment_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decimals_to_double(lifecycle.segment_migration(_orders(spark, sf_dir)))


TRENDS = ["FrequencyGrowth", "SpendGrowth", "OrderValueGrowth"]


def q_value_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(lifecycle.value_growth(_orders(spark, sf_dir)), TRENDS)


def q_category_penetration(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, own = _orders_and_segments(spark, sf_dir)
    return decimals_to_double(penetration.category_penetration(_clean(spark, sf_dir), own))


def q_second_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.second_purchase(*_orders_and_segments(spark, sf_dir))


def q_time_between_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.time_between_purchases(*_orders_and_segments(spark, sf_dir))


def q_csv_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines written as CSV, some with a bad date, quantity, price or customer, and loaded with the bad ones set aside:
    lines, quantity and revenue per outcome."""
    tx = _tx(spark, sf_dir)
    kind = F.col("InvoiceNo").cast("long") * 31 + F.col("StockCode").cast("long")
    spoilt = tx.select(
        "InvoiceNo", "StockCode", "Description",
        F.when(kind % 17 == 1, "a few").otherwise(F.col("Quantity").cast("string")).alias("Quantity"),
        F.when(kind % 17 == 0, "soon").otherwise(F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss")).alias("InvoiceDate"),
        F.when(kind % 17 == 2, "1.23456").when(kind % 17 == 3, "free").otherwise(F.col("UnitPrice").cast("string")).alias("UnitPrice"),
        F.when(kind % 17 == 4, "12.5").otherwise(F.col("CustomerID").cast("string")).alias("CustomerID"), "Country")
    path = new_path(spark, "csv")
    write_table(spoilt, path, "csv")
    loaded = load_transactions_csv(spark, path)
    good = loaded.good.groupBy(F.lit("good").alias("Outcome")).agg(
        F.count(F.lit(1)).alias("Lines"), F.sum("Quantity").alias("Units"), F.sum(F.col("Quantity") * F.col("UnitPrice")).cast("double").alias("Revenue"))
    bad = loaded.rejected.groupBy(F.col("Reason").alias("Outcome")).agg(
        F.count(F.lit(1)).alias("Lines"), F.lit(0).cast("long").alias("Units"), F.lit(0).cast("double").alias("Revenue"))
    read = spark.range(1).select(F.lit("all").alias("Outcome"), F.lit(loaded.lines).cast("long").alias("Lines"),
                                 F.lit(0).cast("long").alias("Units"), F.lit(0).cast("double").alias("Revenue"))
    return good.union(bad).union(read)


def q_bucketed_customer_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer report on a named table, bucketed by customer."""
    path = new_path(spark, "bucketed")
    name = "bucketed_" + path[-8:]
    save_bucketed(_tx(spark, sf_dir), name, path=path)
    return reports.customer_frequency(bucketed_table(spark, name))


def q_customer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' first years, last years and returns side by side; each part lacks some customers."""
    lines = materialize(_tx(spark, sf_dir).where("CustomerID IS NOT NULL").withColumn("Value", F.col("Quantity") * F.col("UnitPrice")), "lines")
    year = F.year("InvoiceDate")
    bounds = F.broadcast(lines.agg(F.min(year).alias("FirstYear"), F.max(year).alias("LastYear")))
    dated = lines.crossJoin(bounds)
    early = dated.where((year == F.col("FirstYear")) & (F.col("Quantity") > 0)).groupBy("CustomerID").agg(F.sum("Value").alias("EarlySpend"))
    late = dated.where((year == F.col("LastYear")) & (F.col("Quantity") > 0)).groupBy("CustomerID").agg(F.sum("Value").alias("LateSpend"))
    returns = lines.where("Quantity < 0").groupBy("CustomerID").agg(F.count(F.lit(1)).alias("ReturnLines"), F.sum("Value").alias("Returned"))
    rows = alignment.align({"Early": early, "Late": late, "Returns": returns}, "CustomerID")
    return decimals_to_double(rows.fillna(0, ["ReturnLines"]))


QUERIES: dict[str, Query] = {
    "revenue_by_country": _report(reports.revenue_by_country),
    "monthly_revenue": _report(reports.monthly_revenue),
    "top_products": _report(reports.top_products),
    "customer_frequency": _report(reports.customer_frequency),
    "category_revenue": _report(reports.category_revenue),
    "clean_transactions": q_clean_transactions,
    "rfm": q_rfm,
    "behaviour_metrics": q_behaviour_metrics,
    "value_projection": q_value_projection,
    "cluster_labels": q_cluster_labels,
    "segment_insights": q_segment_insights,
    "segment_summary": q_segment_summary,
    "date_dimension": q_date_dimension,
    "cluster_profile": q_cluster_profile,
    "segment_sizes": q_segment_sizes,
    "segment_ranking": q_segment_ranking,
    "segment_contribution": q_segment_contribution,
    "headline_kpis": q_headline_kpis,
    "customer_sample": q_customer_sample,
    "dashboard_text": q_dashboard_text,
    "segment_interpretation": q_segment_interpretation,
    "segment_actions": q_segment_actions,
    "customer_actions": q_customer_actions,
    "segment_kpis": q_segment_kpis,
    "csv_roundtrip": q_csv_roundtrip,
    "pipeline_export": q_pipeline_export,
    "scaled_features": q_scaled_features,
    "standin_silhouette": q_standin_silhouette,
    "standin_inertia": q_standin_inertia,
    "kmeans_fixed_start": q_kmeans_fixed_start,
    "k_selection_fixed_starts": q_k_selection_fixed_starts,
    "pipeline_run": q_pipeline_run,
    "pca_components": q_pca_components,
    "product_affinity": q_product_affinity,
    "category_sets": q_category_sets,
    "cohort_retention": q_cohort_retention,
    "segment_migration": q_segment_migration,
    "value_growth": q_value_growth,
    "category_penetration": q_category_penetration,
    "second_purchase": q_second_purchase,
    "time_between_purchases": q_time_between_purchases,
    "csv_quarantine": q_csv_quarantine,
    "bucketed_customer_frequency": q_bucketed_customer_frequency,
    "customer_alignment": q_customer_alignment,
    "kmeans_segments": q_kmeans_segments,
    "k_selection": q_k_selection,
    "pca_projection": q_pca_projection,
}
