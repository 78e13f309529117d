"""Labelling rules (published cluster means), scaling, K-means and PCA properties."""

import math

import pytest
from pyspark.sql import functions as F

from tillroll.operators import customers, segments
from tillroll.sources.transactions import clean_transactions, transactions_from_star

SMOKE = "/root/testdata/sf0.001"


def test_label_rules_reproduce_published_segments(spark):
    # cluster means published with the reference's results: (Recency, Frequency, Monetary)
    means = spark.createDataFrame(
        [(0, 34.8, 8.0, 4236.06), (1, 163.5, 1.5, 122828.05), (2, 133.0, 1.7, 428.44)],
        "Cluster int, Recency double, Frequency double, Monetary double",
    )
    for c in ["AvgOrderValue", "ProductDiversity", "AvgItemsPerOrder"]:
        means = means.withColumn(c, F.lit(0.0))
    got = {r.Cluster: r.Segment for r in segments.label_rules(means).collect()}
    assert got == {
        0: "Active Loyal Low-Value",
        1: "Inactive Occasional High-Value",
        2: "Inactive Occasional Low-Value",
    }


def test_two_clusters_may_share_a_label(spark):
    means = spark.createDataFrame(
        [(0, 10.0, 5.0, 100.0), (1, 10.0, 5.0, 100.0), (2, 50.0, 1.0, 10.0), (3, 60.0, 1.0, 10.0)],
        "Cluster int, Recency double, Frequency double, Monetary double",
    )
    for c in ["AvgOrderValue", "ProductDiversity", "AvgItemsPerOrder"]:
        means = means.withColumn(c, F.lit(0.0))
    got = {r.Cluster: r.Segment for r in segments.label_rules(means).collect()}
    assert got[0] == got[1]


def test_standardize_population_std_and_constant_column(spark):
    df = spark.createDataFrame([(1, 1.0, 7.0), (2, 2.0, 7.0), (3, 3.0, 7.0)], "CustomerID long, a double, b double")
    out = {r.CustomerID: r for r in segments.standardize(df, ["a", "b"]).collect()}
    assert math.isclose(out[3].a, 1.0 / math.sqrt(2.0 / 3.0))
    assert out[1].b == 0.0 and out[3].b == 0.0


@pytest.fixture(scope="module")
def features(spark):
    clean = clean_transactions(transactions_from_star(spark, SMOKE))
    return customers.behaviour_metrics(clean).cache()


def test_kmeans_segmentation_properties(spark, features):
    seg, labels, curve = segments.enhanced_segmentation(features, ks=range(2, 5), n_init=2, max_iter=50)
    n = features.count()
    assert seg.count() == n
    assert seg.select("CustomerID").distinct().count() == n
    rows = curve.orderBy("k").collect()
    assert [r.k for r in rows] == [2, 3, 4]
    assert sum(r.chosen for r in rows) == 1
    best = next(r for r in rows if r.chosen)
    assert best.silhouette == max(r.silhouette for r in rows)
    assert {r.Cluster for r in seg.select("Cluster").distinct().collect()} == set(range(best.k))
    assert seg.filter(F.col("Segment").isNull()).count() == 0
    # inertia does not grow with k for these restarts
    assert rows[-1].inertia <= rows[0].inertia
    # ids renumbered by mean Monetary, descending
    means = [r.m for r in seg.groupBy("Cluster").agg(F.avg("Monetary").alias("m")).orderBy("Cluster").collect()]
    assert means == sorted(means, reverse=True)


def test_kmeans_same_seed_same_assignment(spark, features):
    a, _, _ = segments.enhanced_segmentation(features, ks=[3], n_init=2, max_iter=50)
    b, _, _ = segments.enhanced_segmentation(features, ks=[3], n_init=2, max_iter=50)
    pa = {r.CustomerID: r.Cluster for r in a.select("CustomerID", "Cluster").collect()}
    pb = {r.CustomerID: r.Cluster for r in b.select("CustomerID", "Cluster").collect()}
    assert pa == pb


def test_pca_properties(spark, features):
    seg = features.withColumn("Cluster", (F.col("CustomerID") % 3).cast("int"))
    scores, comps = segments.pca_projection(seg)
    ratios = [r.ExplainedVarianceRatio for r in comps.select("Component", "ExplainedVarianceRatio")
              .distinct().orderBy("Component").collect()]
    assert all(0 < v <= 1 for v in ratios) and ratios[0] >= ratios[1] and sum(ratios) <= 1 + 1e-9
    m = scores.agg(F.avg("PC1").alias("a"), F.avg("PC2").alias("b")).first()
    assert abs(m.a) < 1e-9 and abs(m.b) < 1e-9
    for comp in ["PC1", "PC2"]:
        loads = [r.Loading for r in comps.filter(F.col("Component") == comp).collect()]
        assert max(loads, key=abs) > 0
    assert scores.count() == features.count()


def test_cluster_profile_scaled_to_unit_range(spark, features):
    seg = features.withColumn("Cluster", (F.col("CustomerID") % 4).cast("int"))
    prof = segments.cluster_profile(seg).collect()
    for c in segments.PROFILE_FEATURES:
        vals = [r[c] for r in prof]
        assert min(vals) == 0.0 and max(vals) == 1.0


def test_pca_matches_numpy_svd(spark, features):
    import numpy as np

    seg = features.withColumn("Cluster", (F.col("CustomerID") % 3).cast("int"))
    scores, comps = segments.pca_projection(seg)
    pdf = features.select("CustomerID", *segments.PCA_FEATURES).toPandas().sort_values("CustomerID")
    X = pdf[segments.PCA_FEATURES].astype(float).to_numpy()
    for i, name in enumerate(segments.PCA_FEATURES):
        if name in segments.LOG_FEATURES:
            X[:, i] = np.log1p(X[:, i])
    sd = X.std(axis=0)
    Z = (X - X.mean(axis=0)) / np.where(sd > 0, sd, 1.0)
    _u, sv, vt = np.linalg.svd(Z, full_matrices=False)
    ratios = sv ** 2 / (sv ** 2).sum()
    for j in range(2):
        v = vt[j]
        v = v if v[np.argmax(np.abs(v))] > 0 else -v
        got = {r.Feature: r.Loading for r in comps.filter(F.col("Component") == f"PC{j + 1}").collect()}
        assert np.allclose([got[f] for f in segments.PCA_FEATURES], v, atol=1e-8)
        ratio = comps.filter(F.col("Component") == f"PC{j + 1}").first().ExplainedVarianceRatio
        assert np.isclose(ratio, ratios[j], atol=1e-10)
        want = Z @ v
        have = scores.select("CustomerID", f"PC{j + 1}").toPandas().sort_values("CustomerID")[f"PC{j + 1}"]
        assert np.allclose(have.to_numpy(), want, atol=1e-8)


def test_silhouette_of_coinciding_clusters_is_zero(spark):
    rows = [(i, 0.5, 1.0, i % 2) for i in range(6)] + [(9, 4.0, 4.0, 2), (10, 4.5, 4.0, 2)]
    scaled = spark.createDataFrame(rows, "CustomerID long, x double, y double, Cluster int")
    same = segments.cluster_silhouette(scaled.where("Cluster < 2"), ["x", "y"]).first().Silhouette
    assert same == 0.0  # as kmeans.silhouettes
    apart = segments.cluster_silhouette(scaled, ["x", "y"]).first().Silhouette
    assert 0 < apart < 0.25  # two of eight customers lie well, the others score 0
