"""Embedding near-dedup: navigable small-world graphs, one a shard, each asked for all vectors.

Equal vectors are one node with a number of copies. Nodes are dealt to shards
by hash, and a task builds each shard's hierarchy of graphs: a node's level is
drawn, each layer is built from the one above it, neighbours are chosen so that
none is nearer to another chosen one than to the node, and edges go both ways.

Each graph is then audited with probes: vectors whose cosine with one of its nodes
is just above the threshold, whose true neighbours an exact scan knows. The
beam is widened until the probes find ``RECALL`` of them; a graph that fails
with the widest beam is scanned instead.

Every pair of shards is one task, which asks each of the two graphs for the
other's vectors (a shard's own, too). A beam that holds nothing but links is
widened; beyond the widest, that vector is compared with the whole shard, in
blocks, so that a large group of near copies loses no link. All links are
verified by their cosine in double precision. A task returns, for each linked
node, its number of links and one edge of a spanning forest, never the links
themselves; sums and connected components put these together.

A shard holds at most ``SHARD_BYTES`` of vectors; a task holds two of them. The
work grows with the number of pairs of shards, as the method asks every shard.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components, and vectors of other lengths, link with nothing; each repeated row
is a vector of its own, linked to its copies; a null id keeps its row but names
no group, unless the group has no other id (its ``component_id`` is null and
its rows are kept); an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.components import connected_components
from tillroll.session import materialize

#: Neighbours of a node in the lowest layer (half as many above).
DEGREE = 32
BUILD_BEAM, FIRST_BEAM, WIDEST_BEAM = 64, 32, 256
#: Share of their true neighbours that the probes of a graph must find, and their number.
RECALL, PROBES = 0.995, 256
SHARD_BYTES, LEAST_SHARDS = 32 << 20, 6
#: Vectors that move through a graph together.
BATCH = 512
#: Single precision finds what double precision then verifies.
SLACK = 1e-4


def units(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; first scaled by their largest component, so that no square over- or underflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


class Layer:
    """A graph over some rows of ``x``: ``rows`` (ascending), and for each its neighbours as places in ``rows`` (-1: none)."""

    def __init__(self, rows: np.ndarray, edges: np.ndarray):
        self.rows, self.edges = rows, edges


def _similar(x: np.ndarray, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of each query with its own list of rows (-1: below any)."""
    s = np.einsum("bkd,bd->bk", x[np.maximum(rows, 0)], q)
    return np.where(rows < 0, -np.inf, s)


def beam_search(x: np.ndarray, layer: Layer, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the places (in the layer) and cosines of the best found from its own start."""
    b = len(q)
    places = np.full((b, beam), -1, np.int32)
    places[:, 0] = start
    sims = np.full((b, beam), -np.inf, np.float32)
    sims[:, 0] = np.einsum("bd,bd->b", x[layer.rows[start]], q)
    closed = places < 0
    seen = np.zeros((b, len(layer.rows)), bool)
    seen[np.arange(b), start] = True
    live = np.arange(b)
    while len(live):
        waiting = np.where(closed[live], -np.inf, sims[live])
        pick = waiting.argmax(axis=1)
        some = waiting[np.arange(len(live)), pick] > -np.inf
        live, pick = live[some], pick[some]
        if not len(live):
            break
        closed[live, pick] = True
        near = layer.edges[places[live, pick]]
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(fresh)
        seen[live[r], near[r, c]] = True
        near = np.where(fresh, near, -1)
        near_sims = _similar(x, q[live], np.where(fresh, layer.rows[np.maximum(near, 0)], -1)).astype(np.float32)
        all_places, all_sims = np.concatenate([places[live], near], axis=1), np.concatenate([sims[live], near_sims], axis=1)
        all_closed = np.concatenate([closed[live], ~fresh], axis=1)
        best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        places[live], sims[live] = np.take_along_axis(all_places, best, 1), np.take_along_axis(all_sims, best, 1)
        closed[live] = np.take_along_axis(all_closed, best, 1)
    return places, sims


class Hierarchy:
    """Layers over unit vectors ``x`` (single precision), the widest first."""

    def __init__(self, x: np.ndarray, layers: list[Layer], strays: np.ndarray, beam: int):
        #: ``strays`` are rows that no way leads to: every query is compared with them. ``beam`` 0: with all rows.
        self.x, self.layers, self.strays, self.beam = x, layers, strays, beam

    @classmethod
    def build(cls, x: np.ndarray, threshold: float, degree: int = DEGREE, seed: int = 11) -> Hierarchy:
        x = np.ascontiguousarray(x, np.float32)
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(1 - rng.random(len(x))) / np.log(degree / 2)).astype(int)
        level[0] = level.max(initial=0)  # one entry that is in all layers
        layers: list[Layer] = []
        for l in range(int(level.max(initial=0)), -1, -1):  # noqa: E741
            rows = np.flatnonzero(level >= l)
            layers.insert(0, cls._layer(x, rows, level[rows] > l, layers, degree if not l else degree // 2))
        out = cls(x, layers, np.zeros(0, np.int64), WIDEST_BEAM)
        out.strays = out._strays()
        out.beam = out._audited(threshold, rng)
        return out

    @staticmethod
    def _layer(x: np.ndarray, rows: np.ndarray, upper: np.ndarray, above: list[Layer], degree: int) -> Layer:
        """The layer of ``rows``. Those of the layer above come first, so the way down always ends in the graph."""
        layer = Layer(rows, np.full((len(rows), degree), -1, np.int32))
        order = np.concatenate([np.flatnonzero(upper), np.flatnonzero(~upper)])
        done, first = 1, order[0]
        while done < len(order):
            new = order[done:done + min(BATCH, max(1, done))]
            q = x[rows[new]]
            start = _descend(x, above, q)
            start = np.searchsorted(rows, start) if above else np.full(len(new), first)
            if done < len(above[0].rows if above else ()):
                start = np.full(len(new), first)  # the one above may itself not be in yet
            places, sims = beam_search(x, layer, q, start, BUILD_BEAM)
            among = q @ q.T  # near copies often come together
            np.fill_diagonal(among, -np.inf)
            take = np.argsort(-among, axis=1, kind="stable")[:, :min(degree, len(new) - 1)]
            places = np.concatenate([places, new[take].astype(np.int32)], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(among, take, 1)], axis=1)
            layer.edges[new] = _diverse(x, layer, places, sims, degree)
            _back(x, layer, new, degree)
            done += len(new)
        return layer

    def _strays(self) -> np.ndarray:
        edges = self.layers[0].edges
        seen = np.zeros(len(self.x), bool)
        front = np.zeros(min(1, len(self.x)), np.int64)
        while len(front):
            seen[front] = True
            near = np.unique(edges[front])
            near = near[near >= 0]
            front = near[~seen[near]]
        return np.flatnonzero(~seen)

    def _audited(self, threshold: float, rng: np.random.Generator) -> int:
        """The narrowest beam, doubling, with which the probes find their neighbours; 0 if none does."""
        n, d = self.x.shape
        own = self.x[rng.permutation(n)[:PROBES]].astype(np.float64)
        off = rng.standard_normal((len(own), d))
        off -= np.einsum("ij,ij->i", off, own)[:, None] * own
        length = np.sqrt(np.einsum("ij,ij->i", off, off))[:, None]
        off = np.divide(off, length, out=np.zeros_like(off), where=length > 1e-9)
        near = min(1.0, threshold + 2 * SLACK)
        probes = (near * own + np.sqrt(max(0.0, 1 - near * near)) * off).astype(np.float32)
        true = probes @ self.x.T >= threshold
        beam = FIRST_BEAM
        while beam <= WIDEST_BEAM:
            rows, sims = self.search(probes, beam)
            r, c = np.nonzero((sims >= threshold) & (rows >= 0))
            full = (sims[:, :beam] >= threshold).all(axis=1)  # would be widened
            found = np.zeros_like(true)
            found[r, rows[r, c]] = True
            found[full] = true[full]
            if (found & true).sum() >= RECALL * true.sum():
                return beam
            beam *= 2
        return 0

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query (a unit vector) the rows and cosines of the best ``beam`` found, strays besides."""
        start = _descend(self.x, self.layers[1:], q)
        rows, sims = beam_search(self.x, self.layers[0], q, start, beam)
        if len(self.strays):
            rows = np.concatenate([rows, np.broadcast_to(self.strays, (len(q), len(self.strays)))], axis=1)
            sims = np.concatenate([sims, q @ self.x[self.strays].T], axis=1)
        return rows, sims


def _descend(x: np.ndarray, layers: list[Layer], q: np.ndarray) -> np.ndarray:
    """The row that a greedy walk through the layers, from the top, ends at."""
    at = np.zeros(len(q), np.int64)  # row 0 is in all layers
    for layer in reversed(layers):
        place = np.searchsorted(layer.rows, at)
        best = np.einsum("bd,bd->b", x[at], q)
        live = np.arange(len(q))
        while len(live):
            near = layer.edges[place[live]]
            sims = _similar(x, q[live], np.where(near >= 0, layer.rows[np.maximum(near, 0)], -1))
            pick = sims.argmax(axis=1)
            top = sims[np.arange(len(live)), pick]
            nearer = top > best[live]
            live, pick, near, top = live[nearer], pick[nearer], near[nearer], top[nearer]
            place[live], best[live] = near[np.arange(len(live)), pick], top
        at = layer.rows[place]
    return at


def _diverse(x: np.ndarray, layer: Layer, places: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Of each node's candidates, nearest first, those that are nearer to it than to one already taken; then the nearest others."""
    order = np.argsort(-sims, axis=1, kind="stable")[:, :3 * degree]
    places, sims = np.take_along_axis(places, order, 1), np.take_along_axis(sims, order, 1)
    by = np.argsort(places, axis=1, kind="stable")
    same = np.zeros(places.shape, bool)
    np.put_along_axis(same, by[:, 1:], np.diff(np.take_along_axis(places, by, 1), axis=1) == 0, 1)
    usable = (places >= 0) & ~same & (sims > -np.inf)
    v = x[layer.rows[np.maximum(places, 0)]]
    out = np.full((len(places), degree), -1, np.int32)
    at = np.arange(len(places))
    left, chosen = usable.copy(), np.zeros(places.shape, bool)
    for _ in range(degree):
        pick = left.argmax(axis=1)  # they are sorted
        good = left[at, pick]
        if not good.any():
            break
        chosen[at[good], pick[good]] = True
        left[at, pick] = False
        left &= ~(good[:, None] & (np.einsum("bkd,bd->bk", v, v[at, pick]) > sims))
    rank = np.argsort(np.where(chosen, 0, np.where(usable, 1, 2)), axis=1, kind="stable")[:, :degree]
    kept = np.where(np.take_along_axis(usable, rank, 1), np.take_along_axis(places, rank, 1), -1)
    out[:, :kept.shape[1]] = kept
    return out


def _back(x: np.ndarray, layer: Layer, new: np.ndarray, degree: int) -> None:
    """The edges of ``new`` in the other direction; a node with more than ``degree`` chooses again."""
    dst = layer.edges[new].reshape(-1)
    src = np.repeat(new, degree)[dst >= 0].astype(np.int32)
    dst = dst[dst >= 0]
    fresh = ~(layer.edges[dst] == src[:, None]).any(axis=1)
    src, dst = src[fresh], dst[fresh]
    by = np.argsort(dst, kind="stable")
    src, dst = src[by], dst[by]
    targets, first, count = np.unique(dst, return_index=True, return_counts=True)
    if not len(targets):
        return
    more = np.full((len(targets), count.max()), -1, np.int32)
    more[np.repeat(np.arange(len(targets)), count), np.arange(len(src)) - np.repeat(first, count)] = src
    merged = np.concatenate([layer.edges[targets], more], axis=1)
    room = (merged >= 0).sum(axis=1) <= degree
    front = np.argsort(merged < 0, axis=1, kind="stable")[:, :degree]
    layer.edges[targets[room]] = np.take_along_axis(merged, front, 1)[room]
    full = np.flatnonzero(~room)
    for i in range(0, len(full), BATCH):
        t, own = targets[full[i:i + BATCH]], merged[full[i:i + BATCH]]
        sims = _similar(x, x[layer.rows[t]], np.where(own >= 0, layer.rows[np.maximum(own, 0)], -1))
        layer.edges[t] = _diverse(x, layer, own, sims, degree)


def _least_label(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least one it is linked to, over any number of links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


class Shard:
    """A shard's vectors in double precision, the copies of each, and its graph."""

    def __init__(self, v: np.ndarray, copies: np.ndarray, graph: Hierarchy):
        self.v, self.copies, self.graph = v, copies, graph


def _links(a: Shard, b: Shard, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Verified links ``(row of a, row of b)`` that a's vectors find in b's graph, and the rows of a that need a scan of b."""
    u, v, wide = [], [], []
    q = a.graph.x
    for i in range(0, len(q), BATCH):
        asked, beam = np.arange(i, min(i + BATCH, len(q))), b.graph.beam
        while beam and beam <= WIDEST_BEAM and len(asked):
            rows, sims = b.graph.search(q[asked], beam)
            own = sims >= threshold - SLACK
            full = own[:, :beam].all(axis=1) & (beam < len(b.v))
            r, c = np.nonzero(own & (rows >= 0) & ~full[:, None])
            x, y = asked[r], rows[r, c]
            true = np.einsum("ij,ij->i", a.v[x], b.v[y]) >= threshold
            u.append(x[true])
            v.append(y[true])
            asked, beam = asked[full], 2 * beam
        wide.append(asked)
    return np.concatenate(u or [np.zeros(0, int)]), np.concatenate(v or [np.zeros(0, int)]), np.concatenate(wide or [np.zeros(0, int)])


def linked(a: Shard, b: Shard, threshold: float, itself: bool) -> tuple[np.ndarray, np.ndarray]:
    """For the rows of ``a``, then those of ``b`` (only once, if b is a ``itself``): the number of vectors linked across, and the
    least place (in this order) each is connected to."""
    na = len(a.v)
    n = na if itself else na + len(b.v)
    shift = 0 if itself else na
    links = np.zeros(n, np.int64)
    u, v, wide_a = _links(a, b, threshold)
    if itself:
        wide_b = np.zeros(0, int)
        u, v = np.concatenate([u, v]), np.concatenate([v, u])
        u, v = u[u != v], v[u != v]
    else:
        y, x, wide_b = _links(b, a, threshold)
        u, v = np.concatenate([u, x]), np.concatenate([v, y])
    scanned_a, scanned_b = np.zeros(na, bool), np.zeros(len(b.v), bool)
    scanned_a[wide_a], scanned_b[wide_b] = True, True
    if itself:
        scanned_b = scanned_a
    # found by beams, in either direction; what a scan sees is counted there
    pair = np.unique((u * len(b.v) + v)[~(scanned_a[u] | scanned_b[v])])
    u, v = pair // max(1, len(b.v)), pair % max(1, len(b.v))
    np.add.at(links, u, b.copies[v])
    if not itself:
        np.add.at(links, v + shift, a.copies[u])
    label = np.arange(n)

    def scan(rows: np.ndarray, x: Shard, y: Shard, x_at: int, y_at: int, other_scanned: np.ndarray) -> None:
        nonlocal label
        for i in range(0, len(rows), BATCH):
            block = rows[i:i + BATCH]
            hit = x.v[block] @ y.v.T >= threshold
            if itself:
                hit[np.arange(len(block)), block] = False
            links[block + x_at] += hit @ y.copies
            # a row that is scanned itself counts its own links
            links[y_at:y_at + len(y.v)] += np.where(other_scanned, 0, x.copies[block] @ hit)
            for own, near in zip(block, hit):
                among = np.unique(label[np.append(np.flatnonzero(near) + y_at, own + x_at)])
                if len(among) > 1:
                    label[np.isin(label, among)] = among[0]

    scan(wide_a, a, b, 0, shift, scanned_b)
    if not itself:
        scan(wide_b, b, a, na, 0, scanned_a)
    return links, _least_label(n, np.concatenate([u, np.arange(n)]), np.concatenate([v + shift, label]))


def _prepared(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id``, ``v`` (doubles; null where the vector links with nothing) and two hashes of it."""
    v = vectors[vector_col].cast("array<double>")
    usable = (v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0))
    rows = vectors.select(vectors[id_col].alias("vec_id"), F.when(usable, v).alias("v"))
    return rows.withColumns({"h": F.xxhash64("v"), "g": F.xxhash64("v", F.lit(1))})  # 128 bits tell vectors apart


def _graphs(nodes: DataFrame, threshold: float, degree: int) -> DataFrame:
    """One row a shard: its nodes, copies, unit vectors, layers, strays and beam."""
    schema = ("dim int, shard int, nodes binary, copies binary, vectors binary, layer_rows array<binary>, layer_edges array<binary>, "
              "strays binary, beam int")

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by([("node", "ascending")])
        dim = t.column("dim")[0].as_py()
        v = units(t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim))
        graph = Hierarchy.build(v, threshold, degree)
        return pa.table({
            "dim": t.column("dim").slice(0, 1), "shard": t.column("shard").slice(0, 1),
            "nodes": [t.column("node").to_numpy().tobytes()], "copies": [t.column("copies").to_numpy().tobytes()], "vectors": [v.tobytes()],
            "layer_rows": pa.array([[x.rows.astype(np.int64).tobytes() for x in graph.layers]], pa.list_(pa.binary())),
            "layer_edges": pa.array([[x.edges.tobytes() for x in graph.layers]], pa.list_(pa.binary())),
            "strays": [graph.strays.astype(np.int64).tobytes()], "beam": pa.array([graph.beam], pa.int32()),
        })

    return nodes.groupBy("dim", "shard").applyInArrow(build, schema)


def _loaded(row: dict) -> tuple[np.ndarray, Shard]:
    v = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
    layers = []
    for rows, edges in zip(row["layer_rows"], row["layer_edges"]):
        rows = np.frombuffer(rows, np.int64)
        layers.append(Layer(rows, np.frombuffer(edges, np.int32).reshape(len(rows), -1)))
    graph = Hierarchy(np.ascontiguousarray(v, np.float32), layers, np.frombuffer(row["strays"], np.int64), row["beam"])
    return np.frombuffer(row["nodes"], np.int64), Shard(v, np.frombuffer(row["copies"], np.int64), graph)


def near_copies(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
                degree: int = DEGREE, shard_bytes: int = SHARD_BYTES, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id``, ``n_links`` (other vectors with a cosine of at least ``threshold``),
    ``component_id`` (the smallest id reachable over links) and ``kept`` (whether that is its own)."""
    rows = materialize(_prepared(vectors, id_col, vector_col), "vectors")
    classes = (rows.where("v IS NOT NULL").groupBy("h", "g")
               .agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"))
               .withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("v")}))
    classes = materialize(classes, "distinct-vectors")
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dim") * F.lit(8)).alias("bytes")).first()
    shards = max(1, min(size["n"], max(least_shards, -(-(size["bytes"] or 0) // shard_bytes))))
    shard = F.pmod("h", F.lit(shards)).cast("int").alias("shard")
    # a row a group, in tasks of their own: AQE does not join partitions whose number is given
    nodes = classes.select("dim", shard, "node", "copies", "v").repartition(4 * shards, "dim", "shard")
    graphs = materialize(_graphs(nodes, threshold, degree), "graphs")
    other = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("other")
    pairs = graphs.select("*", other).withColumns({
        "pair": F.concat_ws(":", "dim", F.least("shard", "other"), F.greatest("shard", "other"))}).drop("other")

    def ask(t: pa.Table) -> pa.Table:
        both = sorted((t.slice(i, 1).to_pylist()[0] for i in range(t.num_rows)), key=lambda r: r["shard"])
        low, high = both[0]["pair"].split(":")[1:]
        if low != high and len(both) < 2:  # no vector of this length in the other shard
            ids, links, label = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        else:
            (a_ids, a), (b_ids, b) = _loaded(both[0]), _loaded(both[-1])
            links, label = linked(a, b, threshold, low == high)
            ids = a_ids if low == high else np.concatenate([a_ids, b_ids])
        some = links > 0
        return pa.table({"node": ids[some], "links": links[some], "peer": ids[label[some]] if len(ids) else ids})

    n_pairs = shards * (shards + 1) // 2
    found = pairs.repartition(min(4 * n_pairs, 20_000), "pair").groupBy("pair").applyInArrow(ask, "node long, links long, peer long")
    found = materialize(found, "found-links")
    component = connected_components(found, "node", "peer")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labelled = classes.select("node", "h", "g", "copies", "first_id").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = materialize(labelled.join(links, "node", "left"), "labelled-vectors")
    first = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = labelled.join(first, "component").select(
        F.col("h").alias("k_h"), F.col("g").alias("k_g"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    apart = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    out = rows.where("v IS NOT NULL").join(known, (F.col("h") == F.col("k_h")) & (F.col("g") == F.col("k_g")))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")).union(apart)
