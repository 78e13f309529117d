"""End-to-end customer-value pipeline (U26) and its exports.

clean -> line rollup (checkpoint) -> customer features (checkpoint)
-> K-means segments -> value projection (checkpoint) -> segment tables,
PCA, playbook -> optional writes.

The checkpoints sit where one result feeds many later steps: the
transaction joins run once, the k sweep reads a fixed feature table, and
all segment-level results read one customer table. Every returned value is
a DataFrame; nothing is collected to the driver except K-means centres and
per-cluster sums (at most 90 models x 10 centres) and the PCA loadings (6 x 2).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tillroll.operators import customers, insights, playbook, segments
from tillroll.session import materialize, tune
from tillroll.sources.sinks import write_tables
from tillroll.sources.transactions import clean_transactions

EXPORT_PREFIX = "retail_analysis_"


def run_pipeline(
    tx: DataFrame,
    out_dir: str | None = None,
    prefix: str = EXPORT_PREFIX,
    fmt: str = "parquet",
    ks=range(2, 11),
    n_init: int = 10,
    seed: int = 42,
    max_iter: int = 300,
    segmenter: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame | None]] | None = None,
) -> dict[str, DataFrame]:
    """Run the whole analysis on invoice lines ``tx``.

    Returns a dict of DataFrames: ``final`` (one row per customer with
    features, Cluster, Segment and projection), ``segment_insights``,
    ``segment_summary``, ``segment_labels``, ``k_selection``,
    ``pca_scores``, ``pca_components``, ``cluster_profile``,
    ``segment_sizes``, ``segment_ranking``, ``headline_kpis``,
    ``customer_sample``, ``date_dimension``, ``interpretations``,
    ``recommendations``, ``customer_actions`` and ``kpis``.

    ``segmenter`` takes the place of the K-means sweep: from the customer
    features it makes the customers with Cluster and Segment, the label table
    and a k-selection table (or None).

    With ``out_dir`` the export tables are written there (one directory per
    table, ``fmt`` = 'parquet' or 'csv'); ``out_dir=None`` skips exports.

    The returned frames read intermediate tables in the checkpoint folder;
    call :func:`tillroll.session.release_tables` once they are no longer
    needed.
    """
    tune(tx.sparkSession)
    clean = clean_transactions(tx)
    features = materialize(customers.customer_features(customers.customer_base(clean)), "features")
    if segmenter is not None:
        segmented, labels, k_selection = segmenter(features)
    else:
        segmented, labels, k_selection = segments.enhanced_segmentation(
            features, ks=ks, n_init=n_init, seed=seed, max_iter=max_iter,
        )
    final = materialize(customers.value_projection(segmented), "final")
    seg_insights = materialize(insights.segment_insights(final))
    pca_scores, pca_components = segments.pca_projection(final)
    results = {
        "final": final,
        "segment_insights": seg_insights,
        "segment_summary": insights.segment_summary(seg_insights),
        "segment_labels": labels,
        "k_selection": k_selection,
        "pca_scores": pca_scores,
        "pca_components": pca_components,
        "cluster_profile": segments.cluster_profile(final),
        "segment_sizes": insights.segment_sizes(final),
        "segment_ranking": insights.segment_ranking(seg_insights),
        "headline_kpis": insights.headline_kpis(seg_insights),
        "customer_sample": insights.customer_sample(final, seed=seed),
        "date_dimension": insights.date_dimension(final),
        "interpretations": playbook.segment_interpretation(seg_insights),
        "recommendations": playbook.segment_actions(seg_insights),
        "customer_actions": playbook.customer_actions(final),
        "kpis": playbook.segment_kpis(seg_insights),
    }
    if k_selection is None:
        del results["k_selection"]
    export(results, out_dir, prefix, fmt)
    return results


def export(results: dict[str, DataFrame], out_dir: str | None, prefix: str = EXPORT_PREFIX,
           fmt: str = "parquet") -> dict[str, str]:
    """Write the export set. The customer table is written once
    (``customers``); the reference wrote the same frame a second time."""
    tables = {
        "customers": results["final"],
        "segment_profiles": results["segment_insights"],
        "date_dimension": results["date_dimension"],
        "segment_summary": results["segment_summary"],
        "segment_interpretations": results["interpretations"],
        "segment_recommendations": results["recommendations"],
        "segment_kpis": results["kpis"],
    }
    return write_tables(tables, out_dir, prefix, fmt)
