"""Approximate nearest neighbours: robust-pruned directed graphs, one a shard, searched by beams.

Equal vectors are one node: a class with its smallest ids (as many as an answer
can hold, and one more for the query itself). Classes are dealt to shards by hash;
each shard builds its graph in one task: from a random start graph, all nodes
are inserted twice in batches. A greedy search from the medoid proposes
neighbours, pruning keeps a near one and drops those that are ``alpha`` times
nearer to it than to the node, edges go both ways and full nodes are pruned
again. Every query is searched in every shard by a beam; distances are then
taken anew in double precision and the shards' answers merged.

A shard has at most about ``shard_rows`` classes and ``shard_bytes`` of vectors, a bound for its task's
memory. Its graph is written once, a row for each node. Queries are cut into blocks of about ``query_rows``, and
the blocks dealt to parts, which have about as many queries as a graph has nodes: more parts would send the
graphs more often than the queries are worth. Each (graph, part) is a task, which reads the nodes of the graph and
then the queries as a stream: no row is larger than a node or a query.

Edge cases: vectors that are null, empty, zero or hold null or non-finite parts take no part, nor do
queries with them; vectors of another length than the query's are no candidates; null ids take no part; repeated rows count
once; of several vectors under one query id the least (component by component) is asked for; fewer candidates than k give shorter answers; an empty table gives no
rows; ties go to the smaller id; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tillroll.llm._common import drop_kept
from tillroll.session import materialize

DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 32, 64, 96, 1.2
BATCH = 512
#: Entries of a beam that are looked into together, and products of candidates that pruning holds.
AT_ONCE, PRODUCTS = 4, 1 << 21
SHARD_ROWS, LEAST_SHARDS, QUERY_ROWS = 65_536, 6, 256
#: Of vectors in single precision; 65,536 of them with 64 components.
SHARD_BYTES = 16 << 20
#: Bytes of nodes that leave a task at a time; partitions of the search, which may hold several (graph, part).
SENT_BYTES, MOST_PARTITIONS = 2 << 20, 20_000


class Graph:
    """A directed graph over the rows of ``x`` (float32); ``edges`` holds neighbours, -1 where there is none."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7):
        # a common scale keeps very large and very small vectors within single precision
        self.scale = float(max(x.max(), -x.min())) or 1.0
        self.x = np.ascontiguousarray(x / x.dtype.type(self.scale), np.float32)
        self.degree = degree
        n = len(x)
        self.norm = np.einsum("ij,ij->i", self.x, self.x)
        rng = np.random.default_rng(seed)
        mean = self.x.mean(axis=0)
        self.start = int(np.argmin(((self.x - mean) ** 2).sum(axis=1)))
        self.edges = np.full((n, degree), -1, np.int32)
        if n > 1:
            first = rng.integers(0, n, (n, min(degree // 2, n - 1)), np.int32)
            self.edges[:, :first.shape[1]] = np.where(first == np.arange(n)[:, None], -1, first)
            for a in (1.0, alpha):
                order = rng.permutation(n).astype(np.int32)
                for i in range(0, n, BATCH):
                    self._insert(order[i:i + BATCH], beam, a)
            self._join_up(beam)

    @classmethod
    def loaded(cls, v: np.ndarray, edges: np.ndarray, scale: float, start: int) -> "Graph":
        """The graph over the rows of ``v`` that had these edges, to be searched."""
        out = cls.__new__(cls)
        out.x = np.ascontiguousarray(v / v.dtype.type(scale), np.float32)
        out.edges, out.scale, out.start = edges, scale, start
        out.norm = np.einsum("ij,ij->i", out.x, out.x)
        return out

    def _join_up(self, beam: int) -> None:
        """Gives each node that no way leads to an edge from the nearest node that has one."""
        while True:
            seen = np.zeros(len(self.x), bool)
            seen[self.start] = True
            front = np.array([self.start])
            while len(front):
                near = np.unique(self.edges[front])
                near = near[near >= 0]
                front = near[~seen[near]]
                seen[front] = True
            lost = np.flatnonzero(~seen)[:BATCH]
            if not len(lost):
                return
            ids, dist = self.search(self.x[lost], beam)
            near = ids[np.arange(len(lost)), dist.argmin(axis=1)]
            # one new edge a node, in a column more where all are taken; the others follow in the next round
            near, pick = np.unique(near, return_index=True)
            free = self.edges[near] < 0
            if not free.any(axis=1).all():
                self.edges = np.concatenate([self.edges, np.full((len(self.x), 1), -1, np.int32)], axis=1)
                free = self.edges[near] < 0
            self.edges[near, free.argmax(axis=1)] = lost[pick]

    def _near(self, q: np.ndarray, qn: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its own list of nodes (-1: infinity)."""
        at = np.maximum(ids, 0)
        d = self.norm.take(at) + qn[:, None] - 2 * np.einsum("bkd,bd->bk", self.x.take(at, axis=0), q)
        return np.where(ids < 0, np.inf, np.maximum(d, 0))

    def search(self, q: np.ndarray, beam: int, visited: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """For each query (scaled) the ids and squared distances of its beam, or of all nodes looked into."""
        b, n = len(q), len(self.x)
        qn = np.einsum("ij,ij->i", q, q)
        seen = np.zeros(b * n, bool)
        ids = np.full((b, beam), -1, np.int32)
        ids[:, 0] = self.start
        seen[np.arange(b) * n + self.start] = True
        dist = self._near(q, qn, ids)
        done = ids < 0
        looked_ids, looked_dist = [], []
        live = np.arange(b)
        while len(live):
            # the nearest entries of each beam that have not been looked into
            open_dist = np.where(done[live], np.inf, dist[live])
            pick = np.argpartition(open_dist, AT_ONCE - 1, axis=1)[:, :AT_ONCE] if beam > AT_ONCE else np.broadcast_to(np.arange(beam), (len(live), beam))
            some = np.isfinite(np.take_along_axis(open_dist, pick, 1))
            more = some.any(axis=1)
            live, pick, some = live[more], pick[more], some[more]
            if not len(live):
                break
            node = np.where(some, ids[live[:, None], pick], -1)
            done[live[:, None], pick] = True
            if visited:
                step_ids = np.full((b, pick.shape[1]), -1, np.int32)
                step_dist = np.full(step_ids.shape, np.inf, np.float32)
                step_ids[live], step_dist[live] = node, np.where(some, dist[live[:, None], pick], np.inf)
                looked_ids.append(step_ids)
                looked_dist.append(step_dist)
            # their neighbours that this query has not seen, each once
            r, c = np.nonzero(some)
            near = self.edges.take(node[r, c], axis=0)
            key = ((live[r] * n)[:, None] + near)[near >= 0]
            key = np.sort(key[~seen.take(key)])
            key = key[np.diff(key, prepend=-1) != 0]
            seen[key] = True
            of = key // n
            near = key - of * n
            near_dist = np.maximum(self.norm.take(near) + qn.take(of) - 2 * np.einsum("nd,nd->n", self.x.take(near, axis=0), q.take(of, axis=0)), 0)
            at = np.searchsorted(live, of)
            count = np.bincount(at, minlength=len(live))
            place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + beam
            width = beam + int(count.max(initial=0))
            all_ids = np.full((len(live), width), -1, np.int32)
            all_dist = np.full((len(live), width), np.inf, dist.dtype)
            all_done = np.ones((len(live), width), bool)
            all_ids[:, :beam], all_dist[:, :beam], all_done[:, :beam] = ids[live], dist[live], done[live]
            all_ids[at, place], all_dist[at, place], all_done[at, place] = near, near_dist, False
            keep = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
            ids[live], dist[live], done[live] = (np.take_along_axis(t, keep, 1) for t in (all_ids, all_dist, all_done))
        if visited:
            return np.concatenate(looked_ids, axis=1), np.concatenate(looked_dist, axis=1)
        return ids, dist

    def _prune(self, nodes: np.ndarray, ids: np.ndarray, dist: np.ndarray, alpha: float) -> np.ndarray:
        """Robust pruning of each node's candidates to at most ``degree`` diverse ones."""
        out = np.full((len(nodes), self.degree), -1, np.int32)
        step = max(1, PRODUCTS // min(ids.shape[1], 2 * BUILD_BEAM) ** 2)
        for i in range(0, len(nodes), step):
            out[i:i + step] = self._pruned(nodes[i:i + step], ids[i:i + step], dist[i:i + step], alpha)
        return out

    def _pruned(self, nodes: np.ndarray, ids: np.ndarray, dist: np.ndarray, alpha: float) -> np.ndarray:
        width = min(ids.shape[1], 2 * BUILD_BEAM)
        order = np.argsort(dist, axis=1, kind="stable")[:, :width]
        at = np.arange(len(nodes))[:, None]
        ids, dist = ids[at, order], dist[at, order].copy()
        dist[(ids < 0) | (ids == nodes[:, None])] = np.inf
        same = np.full(ids.shape, False)
        by = np.argsort(ids, axis=1, kind="stable")
        same[at, by[:, 1:]] = np.diff(ids[at, by], axis=1) == 0
        dist[same] = np.inf
        v = self.x.take(np.maximum(ids, 0), axis=0)
        vn = self.norm.take(np.maximum(ids, 0))
        products = np.matmul(v, v.transpose(0, 2, 1))  # of all candidates of one node
        out = np.full((len(nodes), self.degree), -1, np.int32)
        left = dist.copy()
        rows = np.arange(len(nodes))
        for k in range(self.degree):
            pick = left.argmin(axis=1)
            good = np.isfinite(left[rows, pick])
            if not good.any():
                break
            out[good, k] = ids[rows, pick][good]
            between = np.maximum(vn + vn[rows, pick][:, None] - 2 * products[rows, pick], 0)
            left[good[:, None] & (alpha * alpha * between <= dist)] = np.inf
            left[rows, pick] = np.inf
        return out

    def _insert(self, nodes: np.ndarray, beam: int, alpha: float) -> None:
        q, qn = self.x[nodes], self.norm[nodes]
        ids, dist = self.search(q, beam, visited=True)
        own = self.edges[nodes]
        ids = np.concatenate([ids, own], axis=1)
        dist = np.concatenate([dist, self._near(q, qn, own)], axis=1)
        self.edges[nodes] = self._prune(nodes, ids, dist, alpha)
        # the way back: each neighbour gets the node, and is pruned where it has no room
        src = np.repeat(nodes, self.degree)
        dst = self.edges[nodes].reshape(-1)
        src, dst = src[dst >= 0], dst[dst >= 0]
        known = (self.edges[dst] == src[:, None]).any(axis=1)
        src, dst = src[~known], dst[~known]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, first, count = np.unique(dst, return_index=True, return_counts=True)
        if not len(targets):
            return
        extra = np.full((len(targets), count.max()), -1, np.int32)
        extra[np.repeat(np.arange(len(targets)), count), np.arange(len(src)) - np.repeat(first, count)] = src
        merged = np.concatenate([self.edges[targets], extra], axis=1)
        own = self.edges.shape[1]
        room = (merged >= 0).sum(axis=1) <= self.degree
        if room.any():
            m = merged[room]
            at = np.argsort(m < 0, axis=1, kind="stable")[:, :self.degree]
            self.edges[targets[room]] = np.take_along_axis(m, at, axis=1)
        # those with as many new neighbours together, so that few columns are empty
        full = np.flatnonzero(~room)
        full = full[np.argsort(count[full], kind="stable")]
        for i in range(0, len(full), BATCH):
            part = full[i:i + BATCH]
            t, wide = targets[part], own + count[part].max()
            self.edges[t] = self._prune(t, merged[part, :wide], self._near(self.x[t], self.norm[t], merged[part, :wide]), alpha)


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``v`` (in single precision where the column is, else in double) of the rows that take part."""
    kind = vectors.schema[vector_col].dataType
    kind = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    return (vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast(f"array<{kind}>").alias("v"))
            .where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('infinity'))"
                   " AND exists(v, e -> e <> 0)"))


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: ``h`` (a hash), ``v``, ``ids`` (its k + 1 smallest)."""
    rows = rows.withColumns({"h": F.xxhash64("v"), "g": F.xxhash64("v", F.lit(1))})  # 128 bits tell vectors apart
    vectors = rows.groupBy("h", "g").agg(F.first("v").alias("v"))
    # the smallest ids of each part of the table first: a class of any size then comes as a few rows a part
    ids = rows.select("h", "g", "id").distinct().withColumn("part", F.spark_partition_id())
    for by in (["part", "h", "g"], ["h", "g"]):
        ids = ids.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("r") <= k + 1)
    ids = ids.groupBy("h", "g").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return vectors.join(ids, ["h", "g"]).select("h", "v", "ids")


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
            beam: int = SEARCH_BEAM, degree: int = DEGREE, alpha: float = ALPHA, shard_rows: int = SHARD_ROWS,
            least_shards: int = LEAST_SHARDS, query_rows: int = QUERY_ROWS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The k nearest rows of ``vectors`` to each row of ``queries`` (which leaves out the row of its own id):
    ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (the Euclidean distance)."""
    id_type = vectors.schema[id_col].dataType.simpleString()
    classes = materialize(_classes(_usable(vectors, id_col, vector_col), k), "vector-classes")
    asked = materialize(_usable(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v")), "queries")
    # vectors of one length in one shard
    per_size = classes.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    total = per_size.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max(F.col("n") * F.col("size") * 4), F.lit(0)).alias("bytes")).first()
    n, asking = total["n"], asked.count()
    shards = max(1, min(n, max(least_shards, -(-n // shard_rows), -(-total["bytes"] // shard_bytes))))
    blocks = max(1, -(-asking // query_rows))
    parts = max(1, min(blocks, -(-asking * shards // max(1, n))))
    # ranges of the key give each graph a task of its own
    own = F.concat_ws(":", F.size("v"), F.pmod("h", F.lit(shards)))
    nodes = classes.select(own.alias("graph"), "h", "v", "ids").repartitionByRange(4 * shards, "graph")
    wide = classes.schema["v"].dataType.elementType.simpleString()
    dtype = np.dtype(np.float32 if wide == "float" else np.float64)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        t = pa.Table.from_batches(list(batches)).sort_by([("h", "ascending")]).combine_chunks()
        name, ids = t.column("graph")[0], t.column("ids").chunk(0)
        v = t.column("v").chunk(0).flatten().to_numpy().reshape(len(t), -1)
        del t
        graph = Graph(v, degree, alpha=alpha)
        step = max(1, SENT_BYTES // (v[:1].nbytes + graph.edges[:1].nbytes))
        for i in range(0, len(v), step):
            part = v[i:i + step]
            yield pa.RecordBatch.from_arrays([
                pa.repeat(name, len(part)), pa.array(np.arange(i, i + len(part), dtype=np.int32)), _binary(part), _binary(graph.edges[i:i + step]),
                ids.slice(i, step), pa.repeat(pa.scalar(graph.scale), len(part)), pa.repeat(pa.scalar(graph.start, pa.int32()), len(part))], GRAPH)

    graphs = materialize(nodes.groupBy("graph").applyInArrow(
        build, f"graph string, at int, v binary, edges binary, ids array<{id_type}>, scale double, start int"), "graphs")
    # the nodes of a graph go to each part, the queries of a part to each graph of their length
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    sent = (asked.select(F.col("id").cast(id_type), F.col("v").alias("q"), F.pmod(block, F.lit(parts)).alias("part"),
                         F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("place"))
            .select(F.concat_ws(":", F.size("q"), "place", "part").alias("task"), "id", "q"))
    both = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("task", F.concat_ws(":", "graph", "part"))
    both = both.drop("graph", "part").unionByName(sent, allowMissingColumns=True)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        task, pieces, shard = None, [], None
        for batch in batches:
            names, is_node = batch.column("task"), batch.column("at").is_valid().to_numpy(zero_copy_only=False)
            code = names.dictionary_encode().indices.to_numpy()
            ends = np.flatnonzero((np.diff(code) != 0) | (np.diff(is_node) != 0)) + 1
            for i, j in zip([0, *ends], [*ends, len(code)] if len(code) else ()):
                i, j = int(i), int(j)
                if names[i].as_py() != task:
                    task, pieces, shard = names[i].as_py(), [], None
                run = batch.slice(i, j - i)
                if is_node[i]:
                    pieces.append(_node_rows(run, dtype))
                    continue
                if pieces:  # all nodes have come
                    shard, pieces = _Shard(pieces), []
                if shard is not None:
                    q = run.column("q").flatten().to_numpy().reshape(len(run), -1).astype(np.float64)
                    for a in range(0, len(q), BATCH):
                        found = shard.nearest(run.column("id").slice(a, BATCH).to_pylist(), q[a:a + BATCH], k, beam)
                        yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], kind) for c, kind in enumerate(
                            (run.schema.field("id").type, run.schema.field("id").type, pa.float64()))], ["query_id", "vec_id", "score"])

    found = (both.repartitionByRange(min(4 * shards * parts, MOST_PARTITIONS), "task").sortWithinPartitions("task", F.col("at").asc_nulls_last())
             .mapInArrow(search, f"query_id {id_type}, vec_id {id_type}, score double"))
    # a query has k rows from each shard at most
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "vec_id", "score"))


#: Columns of a stored graph: a row is a node.
GRAPH = ["graph", "at", "v", "edges", "ids", "scale", "start"]


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row as its bytes."""
    rows = np.ascontiguousarray(rows)
    size = rows[:1].nbytes
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, size * len(rows) + 1, size, dtype=np.int32)), pa.py_buffer(rows)])


def _rows(binary: pa.Array, dtype: np.dtype) -> np.ndarray:
    """What :func:`_binary` was given (in memory of its own)."""
    binary = binary.cast(pa.binary())
    starts = np.frombuffer(binary.buffers()[1], np.int32, len(binary) + 1, 4 * binary.offset)
    flat = np.frombuffer(binary.buffers()[2], np.uint8, int(starts[-1] - starts[0]), int(starts[0]))
    return flat.reshape(len(binary), -1).copy().view(dtype)


def _node_rows(run: pa.RecordBatch, dtype: np.dtype) -> tuple:
    ids = run.column("ids")
    return (_rows(run.column("v"), dtype), _rows(run.column("edges"), np.dtype(np.int32)), ids.flatten(), ids.value_lengths().to_numpy(),
            run.column("scale")[0].as_py(), run.column("start")[0].as_py())


class _Shard:
    """A stored graph with the vectors and ids of its nodes."""

    def __init__(self, pieces: list[tuple]):
        self.v, edges = (np.concatenate([p[c] for p in pieces]) for c in (0, 1))
        self.ids = pa.concat_arrays([p[2] for p in pieces])
        self.first = np.concatenate([[0], np.cumsum(np.concatenate([p[3] for p in pieces]))])
        self.graph = Graph.loaded(self.v, edges, *pieces[0][4:])

    def nearest(self, q_ids: list, q: np.ndarray, k: int, beam: int) -> list[tuple]:
        """(query, id, distance) of the k nearest rows to each query (double precision)."""
        out = []
        with np.errstate(over="ignore"):
            scaled = np.clip(q / self.graph.scale, -1e15, 1e15).astype(np.float32)
        found, _ = self.graph.search(scaled, max(beam, k + 1))
        for qi, own, near in zip(q_ids, q, found):
            near = near[near >= 0]
            d = np.sqrt(((self.v[near] - own) ** 2).sum(axis=1))
            best: list[tuple] = []
            for j in np.argsort(d, kind="stable"):
                if len(best) >= k and d[j] > best[k - 1][0]:
                    break
                a, b = self.first[near[j]], self.first[near[j] + 1]
                best = sorted(best + [(float(d[j]), x) for x in self.ids.slice(a, b - a).to_pylist() if x != qi])
            out += [(qi, x, s) for s, x in best[:k]]
        return out
