"""Customer segmentation: features, K-means with automatic k, cluster labels,
PCA projection and cluster profiles (U9, U10, U15, U16, U18; M1-M10).

Scale notes
-----------
* Standardisation statistics are one 1-row aggregate (mean, population
  std), not a global window, so no stage funnels all customers into one
  task. K-means collects them (2 numbers per feature) and uses them as
  literals, so the sweep and the final assignment scale identically.
* The scaled features are written as a table in the session's checkpoint
  folder before the k sweep: every pass then reads a fixed table (no re-run
  of the transaction joins).
* All k x restart models are fitted together, one pass over the vectors
  per Lloyd iteration (:mod:`tillroll.operators.kmeans`). The chosen
  model's centres become a column expression, so assigning every customer
  is a projection inside whole-stage codegen, with no join.
* Everything per-cluster or per-segment is a table of at most ``k`` (<= 10)
  or 27 rows; those are the only broadcast joins.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.operators import kmeans
from tillroll.session import materialize as _materialize

# The clustering inputs and the features whose skew is reduced.
CLUSTER_FEATURES = [
    "Recency", "Frequency", "Monetary", "AvgOrderValue",
    "ProductDiversity", "AvgItemsPerOrder", "PurchaseRegularity",
]
PCA_FEATURES = [
    "Recency", "Frequency", "Monetary", "AvgOrderValue",
    "ProductDiversity", "AvgItemsPerOrder",
]
LOG_FEATURES = ["Monetary", "AvgOrderValue"]
PROFILE_FEATURES = PCA_FEATURES


# ---------------------------------------------------------------- features

def feature_expr(name: str, log_features=LOG_FEATURES, fill_null: bool = True):
    """One M1 feature as DOUBLE: NULL -> 0 (when ``fill_null``) *before*
    ``log1p`` of the skewed money features."""
    c = F.col(name).cast("double")
    if fill_null:
        c = F.coalesce(c, F.lit(0.0))
    if name in log_features:
        c = F.log1p(c)
    return c


def feature_columns(customers: DataFrame, features=CLUSTER_FEATURES, log_features=LOG_FEATURES,
                    fill_null: bool = True) -> DataFrame:
    """M1: CustomerID plus the feature columns (:func:`feature_expr`)."""
    return customers.select(
        F.col("CustomerID"), *[feature_expr(n, log_features, fill_null).alias(n) for n in features]
    )


def standardize(df: DataFrame, features: list[str]) -> DataFrame:
    """M2: ``(x - mean) / std`` with the *population* std (a constant
    column keeps scale 1, as scikit-learn does). The statistics are one
    broadcast row."""
    stats = df.agg(*[
        expr
        for name in features
        for expr in (F.avg(name).alias(f"__mu_{name}"), F.stddev_pop(name).alias(f"__sd_{name}"))
    ])
    scaled = df.crossJoin(F.broadcast(stats))
    out = [F.col(c) for c in df.columns if c not in features]
    for name in features:
        sd = F.col(f"__sd_{name}")
        scale = F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd)
        out.append(((F.col(name) - F.col(f"__mu_{name}")) / scale).alias(name))
    return scaled.select(*out)


# ---------------------------------------------------------------- k-means

@dataclass
class SweepResult:
    best_k: int
    centers: np.ndarray  # best_k x d, in the scaled feature space
    curve: list[tuple[int, float, float]]  # (k, silhouette, inertia)


def scaling_constants(feats: DataFrame, features: list[str]) -> tuple[list[float], list[float], float]:
    """Mean and population std per feature (a constant feature gets std 1,
    as scikit-learn does), from one 1-row aggregate, plus the mean variance
    of the scaled features (scikit-learn's tolerance scale: 1 per varying
    feature, 0 per constant one). Only 2 numbers per feature are collected,
    so the sweep and the final assignment use the very same constants."""
    row = feats.agg(*[
        expr
        for name in features
        for expr in (F.avg(name).alias(f"mu_{name}"), F.stddev_pop(name).alias(f"sd_{name}"))
    ]).first()
    mus = [float(row[f"mu_{n}"] or 0.0) for n in features]
    raw = [float(row[f"sd_{n}"] or 0.0) for n in features]
    sds = [sd if sd > 0 else 1.0 for sd in raw]
    return mus, sds, sum(1.0 for sd in raw if sd > 0) / len(features)


def scaled_columns(features: list[str], mus: list[float], sds: list[float]) -> list:
    return [((F.col(n) - F.lit(mu)) / F.lit(sd)).alias(n) for n, mu, sd in zip(features, mus, sds)]


def kmeans_sweep(vectors: DataFrame, features: list[str], ks=range(2, 11), n_init: int = 10,
                 seed: int = 42, max_iter: int = 300, tol: float = 1e-4,
                 mean_variance: float = 1.0) -> SweepResult:
    """M3-M6: for each k fit ``n_init`` restarts (seeds ``seed..``), keep the
    one with least inertia (the earliest restart on ties), score it by
    silhouette; the best k has the highest silhouette (the smallest k on
    ties).

    ``vectors`` holds CustomerID and the scaled ``features``. All k x
    restart models are fitted together (:mod:`tillroll.operators.kmeans`):
    one pass over the vectors per Lloyd iteration serves every model, and a
    single further pass scores the silhouette of every k.
    """
    ks = list(ks)
    specs = [(k, seed + i) for k in ks for i in range(n_init)]
    models = kmeans.fit_many(vectors, features, specs, max_iter=max_iter, tol=tol,
                             mean_variance=mean_variance)
    best_per_k: dict[int, kmeans.FittedModel] = {}
    for m in models:
        if m.k not in best_per_k or m.inertia < best_per_k[m.k].inertia:
            best_per_k[m.k] = m
    return _scored(vectors, features, [best_per_k[k] for k in ks])


def sweep_from_starts(vectors: DataFrame, features: list[str], starts: list[np.ndarray], iterations: int) -> SweepResult:
    """The sweep with given first centres, one model for each, and a given number of Lloyd iterations: repeatable in any engine."""
    models = [kmeans.FittedModel(k=len(c), seed=0, centers=np.array(c, dtype=np.float64)) for c in starts]
    return _scored(vectors, features, kmeans.iterate(vectors, features, models, iterations, threshold=-1.0))


def best_k(curve: list[tuple[int, float, float]]) -> int:
    """The k of the highest silhouette, the smallest on ties (A17); NaN scores don't take part."""
    valid = [(sc, k) for k, sc, _ in curve if sc == sc]
    if not valid:
        raise ValueError("no k produced two or more clusters")
    best_score = max(sc for sc, _ in valid)
    return min(k for sc, k in valid if sc == best_score)


def _scored(vectors: DataFrame, features: list[str], models: list[kmeans.FittedModel]) -> SweepResult:
    scores = kmeans.silhouettes(vectors, features, models)
    curve = [(m.k, float(sc), float(m.inertia)) for m, sc in zip(models, scores)]
    best = best_k(curve)
    return SweepResult(best_k=best, centers=next(m.centers for m in models if m.k == best), curve=curve)


def k_selection_frame(spark: SparkSession, sweep: SweepResult) -> DataFrame:
    """One row per k with silhouette, inertia and the chosen flag."""
    return spark.createDataFrame(
        [(k, s, i, k == sweep.best_k) for k, s, i in sweep.curve],
        "k int, silhouette double, inertia double, chosen boolean",
    )


def assign_clusters(customers: DataFrame, centers: np.ndarray, scaled: list) -> DataFrame:
    """Attach a ``Cluster`` id to every customer: the nearest centre,
    computed as a column expression on the customer table itself (no join).

    Raw K-means ids are arbitrary; they are renumbered 0..k-1 by mean
    Monetary (desc), then mean Frequency (desc), so ids are stable across
    runs. The renumbering table has k rows."""
    joined = customers.withColumn("raw", kmeans.nearest_center(scaled, centers))
    order = joined.groupBy("raw").agg(
        (F.sum("Monetary").cast("double") / F.count(F.lit(1))).alias("m"),
        (F.sum("Frequency").cast("double") / F.count(F.lit(1))).alias("f"),
    )
    ranked = order.select(
        "raw",
        (F.row_number().over(Window.orderBy(F.desc("m"), F.desc("f"), F.asc("raw"))) - 1)
        .cast("int").alias("Cluster"),
    )
    # at most k rows: broadcast is bounded by the model, not by the data
    return joined.join(F.broadcast(ranked), "raw").drop("raw")


def cluster_inertia(scaled: DataFrame, features: list[str], cluster_col: str = "Cluster") -> DataFrame:
    """M4/M5 for given clusters: size and inertia (summed squared distance to
    the mean) of each, in closed form from sums and summed squares."""
    n = F.count(F.lit(1))
    square = sum((F.sum(F.col(f) * F.col(f)) for f in features), F.lit(0.0))
    mean_part = sum((F.sum(f) * F.sum(f) for f in features), F.lit(0.0)) / n
    return scaled.groupBy(cluster_col).agg(n.alias("CustomerCount"), (square - mean_part).alias("Inertia"))


def cluster_silhouette(scaled: DataFrame, features: list[str], cluster_col: str = "Cluster") -> DataFrame:
    """M4 for given clusters: mean squared-Euclidean silhouette (one row).

    The mean squared distance of x to a cluster is |x|^2 + Q/n - 2 x.S/n, so
    the sums of the clusters (a row each, collected) make it a column
    expression: one more pass, no pairs. A cluster of one customer scores 0."""
    stats = scaled.groupBy(cluster_col).agg(
        F.count(F.lit(1)).alias("n"), sum((F.sum(F.col(f) * F.col(f)) for f in features), F.lit(0.0)).alias("q"),
        *[F.sum(f).alias(f"s_{f}") for f in features]).collect()
    own = F.col(cluster_col)
    norm = sum((F.col(f) * F.col(f) for f in features), F.lit(0.0))
    far = F.lit(float("inf"))
    a, b, size = far, [], F.lit(0)
    for r in stats:
        to = norm + r["q"] / r["n"] - sum((F.col(f) * (2.0 * r[f"s_{f}"] / r["n"]) for f in features), F.lit(0.0))
        here = own == F.lit(r[cluster_col])
        a = F.when(here, to * (r["n"] / max(r["n"] - 1, 1))).otherwise(a)
        b.append(F.when(here, far).otherwise(to))
        size = F.when(here, F.lit(r["n"])).otherwise(size)
    if len(b) < 2:
        return scaled.agg(F.max(F.lit(None).cast("double")).alias("Silhouette"))
    score = F.when(F.col("size") <= 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))  # coinciding clusters: 0
    return scaled.select(a.alias("a"), F.least(*b).alias("b"), size.alias("size")).agg(F.avg(score).alias("Silhouette"))


# ---------------------------------------------------------------- labels

def cluster_means(segmented: DataFrame, cluster_col: str = "Cluster") -> DataFrame:
    """M7: per-cluster means of the six profile features. Integer and
    DECIMAL features are averaged from exact sums, so the means (and the
    labels compared against their quantiles) do not depend on row order."""
    n = F.count(F.lit(1))
    return segmented.groupBy(cluster_col).agg(
        *[(F.sum(c).cast("double") / n).alias(c) for c in PROFILE_FEATURES]
    )


def label_rules(means: DataFrame, cluster_col: str = "Cluster") -> DataFrame:
    """U10 on a (small) table of cluster means: quantiles over the clusters,
    unweighted, linear interpolation; strict comparisons.

    recency   mean < q25 Active,        < median Recent,    else Inactive
    loyalty   Frequency > q75 Loyal,    > median Regular,   else Occasional
    value     Monetary  > q75 High-Value, > median Mid-Value, else Low-Value
    """
    q = means.agg(
        F.percentile("Recency", 0.25).alias("r25"), F.percentile("Recency", 0.5).alias("r50"),
        F.percentile("Frequency", 0.5).alias("f50"), F.percentile("Frequency", 0.75).alias("f75"),
        F.percentile("Monetary", 0.5).alias("m50"), F.percentile("Monetary", 0.75).alias("m75"),
    )
    recency = (F.when(F.col("Recency") < F.col("r25"), "Active")
               .when(F.col("Recency") < F.col("r50"), "Recent").otherwise("Inactive"))
    loyalty = (F.when(F.col("Frequency") > F.col("f75"), "Loyal")
               .when(F.col("Frequency") > F.col("f50"), "Regular").otherwise("Occasional"))
    value = (F.when(F.col("Monetary") > F.col("m75"), "High-Value")
             .when(F.col("Monetary") > F.col("m50"), "Mid-Value").otherwise("Low-Value"))
    return means.crossJoin(F.broadcast(q)).select(
        cluster_col, *PROFILE_FEATURES, F.concat_ws(" ", recency, loyalty, value).alias("Segment")
    )


def label_clusters(segmented: DataFrame, cluster_col: str = "Cluster",
                   materialize: bool = False) -> DataFrame:
    """Cluster -> readable label table (one row per cluster).

    The labels depend only on the Recency, Frequency and Monetary means,
    which come from exact integer / DECIMAL sums; evaluating them twice
    (rows and quantiles) therefore cannot flip a strict comparison.
    ``materialize`` checkpoints the means anyway (for floating inputs)."""
    means = cluster_means(segmented, cluster_col)
    if materialize:
        means = _materialize(means, "cluster_means")
    return label_rules(means, cluster_col)


def attach_segments(segmented: DataFrame, labels: DataFrame, cluster_col: str = "Cluster") -> DataFrame:
    """Look the label up per customer. Two clusters may share a label; they
    are one segment from here on."""
    return segmented.join(F.broadcast(labels.select(cluster_col, "Segment")), cluster_col, "left")


# ---------------------------------------------------------------- end to end

def k_selection(customers: DataFrame, ks=range(2, 11), n_init: int = 10, seed: int = 42, max_iter: int = 300, tol: float = 1e-4) -> DataFrame:
    """The sweep's table alone (silhouette and inertia of each k, the chosen one marked), without assigning anyone."""
    vectors, sweep, _scaled = _sweep(customers, ks, n_init, seed, max_iter, tol)
    return k_selection_frame(vectors.sparkSession, sweep)


def _sweep(customers: DataFrame, ks, n_init: int, seed: int, max_iter: int, tol: float) -> tuple[DataFrame, SweepResult, list]:
    """The scaled vectors (written), the sweep over them, and the scaling as expressions on the customer rows."""
    feats = feature_columns(customers)
    names = list(CLUSTER_FEATURES)
    mus, sds, var = scaling_constants(feats, names)
    vectors = _materialize(feats.select("CustomerID", *scaled_columns(names, mus, sds)), "vectors")
    sweep = kmeans_sweep(vectors, names, ks, n_init, seed, max_iter, tol, var)
    # the same expressions (and constants) as the sweep's input, on the customer rows
    return vectors, sweep, [(feature_expr(n) - F.lit(mu)) / F.lit(sd) for n, mu, sd in zip(names, mus, sds)]


def enhanced_segmentation(customers: DataFrame, ks=range(2, 11), n_init: int = 10, seed: int = 42,
                          max_iter: int = 300, tol: float = 1e-4):
    """Features -> scale -> sweep k -> assign -> label.

    Returns ``(segmented, labels, k_selection)``. The assigned customers are
    written once; labels and everything after read that table.
    """
    _vectors, sweep, scaled = _sweep(customers, ks, n_init, seed, max_iter, tol)
    clustered = _materialize(assign_clusters(customers, sweep.centers, scaled), "clustered")
    labels = label_clusters(clustered)
    segmented = attach_segments(clustered, labels)
    return segmented, labels, k_selection_frame(customers.sparkSession, sweep)


# ---------------------------------------------------------------- PCA, profile

def pca_projection(segmented: DataFrame, k: int = 2):
    """Project the six standardised profile features (no null
    fill, log1p money) on the first ``k`` principal components.

    Returns ``(scores, components)``: scores are CustomerID, PC1..PCk,
    Cluster; components are (Component, Feature, Loading,
    ExplainedVarianceRatio). Input is centred by the standardisation, so
    the projection equals scikit-learn's; each component's sign is fixed so
    that its largest absolute loading is positive. Scores are computed as
    plain column arithmetic from the (6 x k) loading matrix.
    """
    feats = PCA_FEATURES
    base = segmented.select("CustomerID", "Cluster", *[feature_expr(n, LOG_FEATURES, False).alias(n) for n in feats])
    mus, sds, _var = scaling_constants(base, feats)
    z = {n: (F.col(n) - F.lit(mu)) / F.lit(sd) for n, mu, sd in zip(feats, mus, sds)}
    # one pass: the 21 products of the 6 x 6 covariance, and the rows that no projection can use
    pairs = [(i, j) for i in range(len(feats)) for j in range(i, len(feats))]
    bad = ~F.coalesce(reduce(lambda a, b: a & b, [F.abs(F.col(n)) < F.lit(float("inf")) for n in feats]), F.lit(False))
    row = base.agg(F.count_if(bad | reduce(lambda a, b: a | b, [F.isnan(n) for n in feats])).alias("bad"), F.count(F.lit(1)).alias("n"),
                   *[F.sum(z[feats[i]] * z[feats[j]]).alias(f"p{i}_{j}") for i, j in pairs]).first()
    if row["bad"]:
        raise ValueError(f"PCA features must be finite; {row['bad']} customers have missing or non-finite values")
    cov = np.zeros((len(feats), len(feats)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = (row[f"p{i}_{j}"] or 0.0) / max(row["n"] - 1, 1)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:k]
    total = float(np.maximum(values, 0.0).sum())
    ratios = [float(max(values[o], 0.0) / total) if total else 0.0 for o in order]
    loadings = []
    for o in order:
        column = [float(v) for v in vectors[:, o]]
        pivot = max(range(len(feats)), key=lambda i: abs(column[i]))
        sign = -1.0 if column[pivot] < 0 else 1.0
        loadings.append([sign * v for v in column])
    scores = base.select(
        "CustomerID",
        *[
            sum((z[f] * F.lit(loadings[j][i]) for i, f in enumerate(feats)), F.lit(0.0)).alias(f"PC{j + 1}")
            for j in range(k)
        ],
        "Cluster",
    )
    spark = segmented.sparkSession
    components = spark.createDataFrame(
        [(f"PC{j + 1}", f, loadings[j][i], ratios[j]) for j in range(k) for i, f in enumerate(feats)],
        "Component string, Feature string, Loading double, ExplainedVarianceRatio double",
    )
    return scores, components


def cluster_profile(segmented: DataFrame, cluster_col: str = "Cluster") -> DataFrame:
    """U16: per-cluster feature means, min-max scaled across clusters
    (NULL where all clusters share a value).

    The min/max come from a window over the k-row table of means (at most
    k rows in one task). A self-join with an aggregate of the means would
    evaluate the floating-point means twice, in different summation
    orders, and the top cluster would come out as 0.99999... instead of 1.
    """
    means = cluster_means(segmented, cluster_col)
    clusters = Window.partitionBy()  # the k cluster rows only
    return means.select(
        cluster_col,
        *[
            F.try_divide(F.col(c) - F.min(c).over(clusters), F.max(c).over(clusters) - F.min(c).over(clusters))
            .alias(c)
            for c in PROFILE_FEATURES
        ],
    )
