"""K-means sweep with all (k, restart) models advancing in the same pass.

The reference fits k = 2..10 with 10 restarts each: 90 models. Fitting them
one by one with ``pyspark.ml`` reads the vectors once per Lloyd iteration
*per model*. Here one job per iteration serves every model that has not
converged yet, so the data is read ``max(iterations)`` times instead of
``sum(iterations)`` times.

Each pass is ``mapInPandas`` over Arrow batches of the scaled vectors. The
batch is multiplied against all centres at once (one matrix product), and
each task emits per-(model, cluster) partial sums. A ``groupBy`` merges them
map-side and the driver receives at most ``n_models * k_max`` rows (540 for
the reference settings). Centres are the only state the driver keeps. They
are bounded by the model count and the feature count, not by the data.

* Seeding is greedy k-means++: for each further centre ``2 + ln k`` candidates
  are drawn by D^2 sampling, and the one that leaves the least summed D^2
  stays. A draw is an exponential race: each point has a key
  ``-log(u) / D^2`` and the smallest key wins, so a partition only reports
  its local winners. ``u`` hashes (point id, seed, step, trial), which makes a
  re-executed task draw the same numbers. One pass weighs the candidates of a
  step for all models and at once draws those of the next step for each case
  of which one stays, so there is a pass per centre, and one more.
* Lloyd iterations stop per model when the summed squared centre shift is
  at most ``tol * mean feature variance`` (scikit-learn's rule) or after
  ``max_iter``. Empty clusters move to the points farthest from their own
  centres, as in scikit-learn: a further pass, only when there are any, finds
  the first few of each model by a top-n per task. Once
  a model has converged, one more pass gives its inertia, cluster sizes,
  sums and summed squared norms for the final centres.
* The silhouette is Spark's squared-Euclidean definition (the one
  ``ClusteringEvaluator`` computes). Its closed form needs only the
  per-cluster count, sum and sum of squared norms, so all k are scored in a
  single pass. The plain-Euclidean silhouette needs all point pairs and is
  not offered.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

# The 64-bit mixing constants of the public splitmix64
# generator (Steele, Lea and Flood, 2014), used to hash point ids.
_GOLDEN = 0x9E3779B97F4A7C15
_MIX1 = 0xBF58476D1CE4E5B9
_MIX2 = 0x94D049BB133111EB


def uniform_hash(ids: np.ndarray, seed: int, step: int) -> np.ndarray:
    """Deterministic uniform numbers in (0, 1) per (id, seed, step)."""
    offset = np.uint64((seed * _MIX1 + step * _MIX2 + 1) % (1 << 64))
    with np.errstate(over="ignore"):
        z = ids.astype(np.int64).view(np.uint64) * np.uint64(_GOLDEN) + offset
        z = (z ^ (z >> np.uint64(30))) * np.uint64(_MIX1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(_MIX2)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


@dataclass
class FittedModel:
    k: int
    seed: int
    centers: np.ndarray          # k x d
    iterations: int = 0
    inertia: float = float("nan")
    counts: np.ndarray | None = None   # k
    sums: np.ndarray | None = None     # k x d
    sq_norms: np.ndarray | None = None  # k


@dataclass
class _Layout:
    """Centres of several models stacked in one (C x d) matrix."""
    offsets: np.ndarray
    ks: np.ndarray
    centers: np.ndarray

    @classmethod
    def of(cls, centers: Sequence[np.ndarray]) -> "_Layout":
        ks = np.array([len(c) for c in centers], dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(ks)[:-1]]).astype(np.int64)
        return cls(offsets, ks, np.vstack(centers))

    def assign(self, X: np.ndarray):
        """Nearest centre per model: local labels (b x M) and squared
        distances (b x M)."""
        xx = np.einsum("ij,ij->i", X, X)
        cc = np.einsum("ij,ij->i", self.centers, self.centers)
        dist = xx[:, None] - 2.0 * (X @ self.centers.T) + cc[None, :]
        rows = np.arange(len(X))
        labels = np.empty((len(X), len(self.ks)), dtype=np.int64)
        best = np.empty((len(X), len(self.ks)))
        for m, (o, k) in enumerate(zip(self.offsets, self.ks)):
            block = dist[:, o:o + k]
            lab = block.argmin(axis=1)
            labels[:, m] = lab
            best[:, m] = block[rows, lab]
        return labels, np.maximum(best, 0.0), xx


    def sums(self, X: np.ndarray):
        """Per stacked centre, over the points nearest to it: their number, squared distances, squared norms and sums. A block of
        points at a time stays in the cache, with a row for each centre, so that all steps run along the points."""
        cc = np.einsum("ij,ij->i", self.centers, self.centers)
        twice, size = -2.0 * self.centers, len(self.centers)
        total, cost = np.zeros((size, X.shape[1] + 2)), np.zeros(size)
        for i in range(0, len(X), BLOCK):
            x = X[i:i + BLOCK]
            xx = np.einsum("ij,ij->i", x, x)
            all_of_it = np.column_stack([np.ones(len(x)), xx, x])
            dist = twice @ x.T
            dist += cc[:, None]
            for o, k in zip(self.offsets, self.ks):
                least = dist[o:o + k].min(axis=0)
                own = dist[o:o + k] == least
                if np.count_nonzero(own) > len(x):  # of equally near centres the first
                    own &= np.cumsum(own, axis=0) == 1
                own = own.astype(np.float64)
                total[o:o + k] += own @ all_of_it
                cost[o:o + k] += own @ np.maximum(least + xx, 0.0)
        return total[:, 0].astype(np.int64), cost, total[:, 1], total[:, 2:]


#: Points that :meth:`_Layout.sums` takes at a time.
BLOCK = 2000


def _batches(frames: Iterator[pd.DataFrame], cols: list[str]):
    """Arrow batches as float matrices. A missing or non-finite feature
    (e.g. log1p of a value below -1) fails the job, as scikit-learn refuses
    NaN input; it would otherwise turn a centre into NaN without notice."""
    for pdf in frames:
        if len(pdf):
            X = pdf[cols].to_numpy(dtype=np.float64)
            if not np.isfinite(X).all():
                bad = [c for c, ok in zip(cols, np.isfinite(X).all(axis=0)) if not ok]
                raise ValueError(f"K-means features must be finite; missing or non-finite values in {bad}")
            yield pdf, X


def _sum_partials(partials: DataFrame, key: str, columns: list[str]) -> pd.DataFrame:
    """Partials of all tasks, merged on the executors: one row per ``key``."""
    return partials.groupBy(key).agg(*[F.sum(c).alias(c) for c in columns]).toPandas()


TRIAL_SPAN = 64  # steps of the hash between one centre and the next


def trials_for(k: int) -> int:
    """Candidates a greedy draw weighs against each other (scikit-learn's number)."""
    return 2 + int(np.log(k))


def _winner(key: np.ndarray, ids: np.ndarray) -> int:
    """The place of the smallest key; of equal keys that of the smaller id."""
    ties = np.flatnonzero(key == key.min())
    return int(ties[ids[ties].argmin()])


def _seed_step(vectors: DataFrame, cols: list[str], seeds: list[int], chosen: list[np.ndarray], candidates: list[np.ndarray],
               trials: list[int], step: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per model: the summed D^2 that each of its ``candidates`` for centre ``step - 1`` leaves, and for each of
    them the points drawn for centre ``step`` (``trials`` of them, 0 for none). Without candidates the draw
    follows ``chosen`` alone; centre 0 is drawn from all points alike."""
    d = len(cols)
    xs = [f"x{j}" for j in range(d)]
    schema = "mid int, c int, t int, cost double, key double, cid long, " + ", ".join(f"{x} double" for x in xs)

    def draw(frames):
        costs: dict[tuple[int, int], float] = {}
        best: dict[tuple[int, int, int], tuple] = {}
        for pdf, X in _batches(frames, cols):
            ids = pdf["CustomerID"].to_numpy()
            for m, seed in enumerate(seeds):
                u = [uniform_hash(ids, seed, step * TRIAL_SPAN + t) for t in range(trials[m])]
                races = u if step == 0 else [-np.log(x) for x in u]
                near = np.full(len(X), np.inf)
                for centre in chosen[m]:
                    near = np.minimum(near, ((X - centre) ** 2).sum(axis=1))
                for c, extra in enumerate(candidates[m] if len(candidates[m]) else [None]):
                    left = near if extra is None else np.minimum(near, ((X - extra) ** 2).sum(axis=1))
                    if extra is not None:
                        costs[m, c] = costs.get((m, c), 0.0) + float(left.sum())
                    for t, race in enumerate(races):
                        with np.errstate(divide="ignore"):
                            key = race if step == 0 else np.where(left > 0, race / np.where(left > 0, left, 1.0), np.inf)
                        i = _winner(key, ids)
                        own = (float(key[i]), int(ids[i]), *map(float, X[i]))
                        best[m, c, t] = min(best.get((m, c, t), own), own)
        rows = [(m, c, -1, cost, None, None, *[None] * d) for (m, c), cost in costs.items()]
        rows += [(m, c, t, None, *own) for (m, c, t), own in best.items()]
        frame = pd.DataFrame(rows, columns=["mid", "c", "t", "cost", "key", "cid", *xs])
        yield frame.astype({"cid": "Int64", **dict.fromkeys(["cost", "key", *xs], "float64")})

    merged = (vectors.mapInPandas(draw, schema).groupBy("mid", "c", "t")
              .agg(F.sum("cost").alias("cost"), F.min(F.when(F.col("t") >= 0, F.struct("key", "cid", *xs))).alias("p"))
              .select("mid", "c", "t", "cost", *[F.col(f"p.{x}").alias(x) for x in xs]).collect())
    costs = [np.zeros(len(candidates[m])) for m in range(len(seeds))]
    points = [np.zeros((max(1, len(candidates[m])), trials[m], d)) for m in range(len(seeds))]
    for r in merged:
        if r.t < 0:
            costs[r.mid][r.c] = r.cost
        else:
            points[r.mid][r.c, r.t] = [r[x] for x in xs]
    return costs, points


def _seed_many(vectors: DataFrame, cols: list[str], specs: list[tuple[int, int]], trials: int | None) -> list[np.ndarray]:
    """First centres of every model. A draw depends on the seed, the step and the number of trials, not on k: of the models
    that agree in seed and trials, one of the largest k is drawn and the others take the first of its centres."""
    n_trials = [trials or trials_for(k) for k, _s in specs]
    most: dict[tuple[int, int], int] = {}
    for (k, s), t in zip(specs, n_trials):
        most[s, t] = max(k, most.get((s, t), 0))
    drawn = dict(zip(most, _seed_runs(vectors, cols, [(k, s) for (s, _t), k in most.items()], [t for _s, t in most])))
    return [drawn[s, t][:k] for (k, s), t in zip(specs, n_trials)]


def _seed_runs(vectors: DataFrame, cols: list[str], specs: list[tuple[int, int]], n_trials: list[int]) -> list[np.ndarray]:
    """First centres of each (k, seed), with so many candidates a draw."""
    d = len(cols)
    _, first = _seed_step(vectors, cols, [s for _k, s in specs], [np.zeros((0, d))] * len(specs), [np.zeros((0, d))] * len(specs), [1] * len(specs), 0)
    chosen = [p[0, :1] for p in first]
    drawn = [np.zeros((0, d))] * len(specs)
    for step in range(1, max(k for k, _s in specs) + 1):
        active = [m for m, (k, _s) in enumerate(specs) if k > 1 and step <= k]
        if not active:
            break
        costs, points = _seed_step(
            vectors, cols, [specs[m][1] for m in active], [chosen[m] for m in active], [drawn[m] for m in active],
            [n_trials[m] if step < specs[m][0] else 0 for m in active], step)
        for m, cost, point in zip(active, costs, points):
            pick = int(cost.argmin()) if len(cost) else 0
            if len(cost):
                chosen[m] = np.vstack([chosen[m], drawn[m][pick]])
            drawn[m] = point[pick]
    return chosen


def _farthest(vectors: DataFrame, cols: list[str], layout: _Layout, wanted: list[int]) -> list[list[tuple]]:
    """For each model in ``layout`` the ``wanted`` points farthest from their own centres: (squared distance, cluster, point),
    farthest first, of equal ones the smaller id. A task reports its own first few, the rest is a top-n of those."""
    xs = [f"x{j}" for j in range(len(cols))]
    schema = "mid int, d2 double, cid long, label int, " + ", ".join(f"{x} double" for x in xs)

    def local(frames):
        rows: list[list[tuple]] = [[] for _ in wanted]
        for pdf, X in _batches(frames, cols):
            ids = pdf["CustomerID"].to_numpy()
            labels, best, _xx = layout.assign(X)
            for m, n in enumerate(wanted):
                if n:
                    first = np.lexsort((ids, -best[:, m]))[:n]
                    rows[m] += [(m, float(best[i, m]), int(ids[i]), int(labels[i, m]), *map(float, X[i])) for i in first]
                    rows[m] = sorted(rows[m], key=lambda r: (-r[1], r[2]))[:n]
        yield pd.DataFrame([r for own in rows for r in own], columns=["mid", "d2", "cid", "label", *xs])

    order = Window.partitionBy("mid").orderBy(F.desc("d2"), F.asc("cid"))
    first = vectors.mapInPandas(local, schema).withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(wanted))
    out: list[list[tuple]] = [[] for _ in wanted]
    for r in sorted(first.collect(), key=lambda r: r.place):
        out[r.mid].append((r.d2, r.label, np.array([r[x] for x in xs])))
    return [own[:n] for own, n in zip(out, wanted)]


def _relocate(n: np.ndarray, s: np.ndarray, far: list[tuple]) -> None:
    """Gives each empty cluster one of the farthest points, taken from the sums of the cluster it was in."""
    for cluster, (d2, label, point) in zip(np.flatnonzero(n == 0), far):
        if d2 <= 0:  # fewer distinct points than clusters
            break
        s[label] -= point
        n[label] -= 1
        s[cluster] = point
        n[cluster] = 1


def _cluster_stats(vectors: DataFrame, cols: list[str], layout: _Layout):
    """One Lloyd E-step for every model in ``layout``: per stacked centre the
    point count, summed squared distance, summed squared norm and the sum
    of the assigned points."""
    d = len(cols)
    n_centres = len(layout.centers)
    schema = "gid int, n long, cost double, q double, " + ", ".join(f"s{j} double" for j in range(d))

    def partial(frames):
        n = np.zeros(n_centres, dtype=np.int64)
        cost = np.zeros(n_centres)
        q = np.zeros(n_centres)
        s = np.zeros((n_centres, d))
        for _pdf, X in _batches(frames, cols):
            for own, more in zip((n, cost, q, s), layout.sums(X)):
                own += more
        keep = np.flatnonzero(n)
        frame = pd.DataFrame({"gid": keep.astype(np.int32), "n": n[keep], "cost": cost[keep], "q": q[keep]})
        for j in range(d):
            frame[f"s{j}"] = s[keep, j]
        yield frame

    columns = ["n", "cost", "q"] + [f"s{j}" for j in range(d)]
    merged = _sum_partials(vectors.mapInPandas(partial, schema), "gid", columns)
    gid = merged["gid"].to_numpy(dtype=np.int64)
    n = np.zeros(n_centres, dtype=np.int64)
    cost = np.zeros(n_centres)
    q = np.zeros(n_centres)
    s = np.zeros((n_centres, d))
    n[gid] = merged["n"].to_numpy(dtype=np.int64)
    cost[gid] = merged["cost"].to_numpy(dtype=np.float64)
    q[gid] = merged["q"].to_numpy(dtype=np.float64)
    s[gid] = merged[[f"s{j}" for j in range(d)]].to_numpy(dtype=np.float64)
    return n, cost, q, s


def fit_many(vectors: DataFrame, cols: list[str], specs: list[tuple[int, int]], max_iter: int = 300,
             tol: float = 1e-4, mean_variance: float = 1.0, trials: int | None = None) -> list[FittedModel]:
    """Fit one K-means model per ``(k, seed)`` in ``specs``, all together.

    ``trials`` is the number of candidates of a seeding draw (1: plain
    k-means++; default: :func:`trials_for`).

    ``vectors`` needs ``CustomerID`` (the id hashed for seeding) and the
    feature columns ``cols``; it should be a materialised table because it
    is read once per seeding step and once per iteration. It is also kept
    in executor memory for the fit (a lost block is re-read from the
    table)."""
    vectors = vectors.select(F.col("CustomerID").cast("long").alias("CustomerID"), *cols)
    vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        centers = _seed_many(vectors, cols, specs, trials)
        models = [FittedModel(k=k, seed=seed, centers=c) for (k, seed), c in zip(specs, centers)]
        return iterate(vectors, cols, models, max_iter, tol * mean_variance)
    finally:
        vectors.unpersist()


def iterate(vectors: DataFrame, cols: list[str], models: list[FittedModel], max_iter: int, threshold: float) -> list[FittedModel]:
    """Lloyd iterations of all models from their centres until each has converged (a negative ``threshold``: ``max_iter`` of them)."""
    converged = [False] * len(models)
    pending = list(range(len(models)))
    while pending:
        layout = _Layout.of([models[m].centers for m in pending])
        n, cost, q, s = _cluster_stats(vectors, cols, layout)
        empty = [0 if converged[m] else int((n[o:o + k] == 0).sum()) for m, o, k in zip(pending, layout.offsets, layout.ks)]
        if any(empty):
            for o, k, far in zip(layout.offsets, layout.ks, _farthest(vectors, cols, layout, empty)):
                _relocate(n[o:o + k], s[o:o + k], far)
        still = []
        for m, o, k in zip(pending, layout.offsets, layout.ks):
            model = models[m]
            sl = slice(o, o + k)
            if converged[m]:
                model.counts, model.sums, model.sq_norms = n[sl].copy(), s[sl].copy(), q[sl].copy()
                model.inertia = float(cost[sl].sum())
                continue
            counts = n[sl][:, None]
            new = np.where(counts > 0, s[sl] / np.maximum(counts, 1), model.centers)
            shift = float(((new - model.centers) ** 2).sum())
            model.centers = new
            model.iterations += 1
            converged[m] = shift <= threshold or model.iterations >= max_iter
            still.append(m)
        pending = still
    return models


def lloyd(vectors: DataFrame, cols: list[str], centers: np.ndarray, iterations: int) -> np.ndarray:
    """Centres after a given number of Lloyd iterations from given ones (an empty cluster keeps its centre)."""
    centers = np.asarray(centers, dtype=np.float64)
    for _ in range(iterations):
        n, _cost, _q, s = _cluster_stats(vectors, cols, _Layout.of([centers]))
        centers = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], centers)
    return centers


def silhouettes(vectors: DataFrame, cols: list[str], models: list[FittedModel]) -> list[float]:
    """Mean squared-Euclidean silhouette of each model's assignment (NaN
    when fewer than two clusters are non-empty), all models in one pass.

    For point x and cluster c the mean squared distance to c's points is
    ``|x|^2 + Q_c / n_c - 2 x . S_c / n_c``. The own cluster is rescaled by
    ``n / (n - 1)`` to leave x itself out, and a singleton scores 0."""
    vectors = vectors.select(*cols)
    layout = _Layout.of([m.centers for m in models])
    counts = [m.counts.astype(np.float64) for m in models]
    means = [m.sums / np.maximum(m.counts, 1)[:, None] for m in models]
    sq_means = [m.sq_norms / np.maximum(m.counts, 1) for m in models]

    def partial(frames):
        total = np.zeros(len(models))
        points = np.zeros(len(models), dtype=np.int64)
        for _pdf, X in _batches(frames, cols):
            labels, _best, xx = layout.assign(X)
            rows = np.arange(len(X))
            for m in range(len(models)):
                n_c = counts[m]
                mean_d = xx[:, None] + sq_means[m][None, :] - 2.0 * (X @ means[m].T)
                mean_d = np.where(n_c[None, :] > 0, mean_d, np.inf)
                own = labels[:, m]
                n_own = n_c[own]
                a = mean_d[rows, own] * n_own / np.maximum(n_own - 1, 1)
                others = mean_d.copy()
                others[rows, own] = np.inf
                b = others.min(axis=1)
                coef = np.where(a < b, 1 - a / np.where(b == 0, 1, b), np.where(a > b, b / np.where(a == 0, 1, a) - 1, 0.0))
                coef = np.where(n_own <= 1, 0.0, coef)
                total[m] += coef.sum()
                points[m] += len(X)
        yield pd.DataFrame({"mid": np.arange(len(models), dtype=np.int32), "total": total, "points": points})

    partials = vectors.mapInPandas(partial, "mid int, total double, points long")
    merged = _sum_partials(partials, "mid", ["total", "points"])
    by_model = {int(r.mid): r.total / r.points if r.points else float("nan") for r in merged.itertuples()}
    return [
        by_model.get(i, float("nan")) if int((m.counts > 0).sum()) > 1 else float("nan")
        for i, m in enumerate(models)
    ]


def nearest_center(features: list, centers: np.ndarray):
    """Column expression: index of the nearest centre (first on ties), for
    assigning rows to a fitted model inside whole-stage codegen."""
    def squared(f, v):
        diff = f - F.lit(float(v))
        return diff * diff

    dist = [sum((squared(f, c[j]) for j, f in enumerate(features)), F.lit(0.0)) for c in centers]
    closest = F.least(*dist) if len(dist) > 1 else dist[0]
    expr = None
    for i, dcol in enumerate(dist):
        expr = F.when(dcol == closest, F.lit(i)) if expr is None else expr.when(dcol == closest, F.lit(i))
    return expr.otherwise(F.lit(0))
