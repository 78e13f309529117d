"""Graph search against brute force: recall on whole tables, exact answers on small ones, edge cases."""

import math

import numpy as np
import pytest

from tillroll.llm import catalog, graph_ann
from tillroll.llm.graph_ann import Graph

SF = "/root/testdata/sf0.1"


def usable(v):
    return v is not None and len(v) > 0 and all(e is not None and math.isfinite(e) for e in v) and any(v)


def brute(rows, queries, k=10):
    own = sorted({(i, tuple(v)) for i, v in rows if i is not None and usable(v)})
    out = []
    for q, v in sorted({(i, tuple(v)) for i, v in queries if i is not None and usable(v)}):
        d = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w))), i) for i, w in own if i != q and len(w) == len(v))
        out += [(q, r, i, s) for r, (s, i) in enumerate(d[:k], 1)]
    return out


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=0)


def test_recall_on_the_whole_table(spark):
    table = [(r.vec_id, np.array(r.embedding, np.float64)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if usable(r.embedding)]
    ids, x = np.array([i for i, _ in table]), np.stack([v for _, v in table])
    got = rows(catalog.op9_graph_neighbours(spark, SF))
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        true = [i for _, i in sorted(zip(d[ids != q], ids[ids != q]))[:10]]
        mine = [g for g in got if g[0] == q]
        assert [m[1] for m in mine] == list(range(1, 11))
        assert np.allclose([m[3] for m in mine], [d[ids == m[2]][0] for m in mine], rtol=1e-12)
        assert [m[3] for m in mine] == sorted(m[3] for m in mine)
        hit, total = hit + len({m[2] for m in mine} & set(true)), total + 10
    assert hit / total >= 0.95


@pytest.mark.parametrize("n", [1, 2, 5, 60])
def test_small_graphs_reach_every_node(n):
    rng = np.random.default_rng(n)
    x = np.concatenate([rng.normal(size=(n, 4)), 1e6 + rng.normal(size=(n, 4))])
    g = Graph(x)
    ids, _ = g.search((x / g.scale).astype(np.float32), 130)
    assert all(set(r[r >= 0]) == set(range(2 * n)) for r in ids)


def test_edge_cases_are_exact(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(40)]
    same_vector = [1.0, 2.0, 3.0, 4.0]
    data += [(i, same_vector) for i in range(100, 160)] + [(100, same_vector)] * 3
    data += [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 2.0, 3.0]), (204, [float("nan")] * 4), (205, [float("inf"), 0.0, 0.0, 0.0]),
             (None, [1.0, 1.0, 1.0, 1.0]), (206, [1.0, 2.0]), (207, [1.0, 3.0]), (300, [1e30, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<double>, score string")
    queries = df.where("vec_id IN (0, 7, 100, 130, 159, 200, 202, 203, 205, 206, 300)")
    asked = [(i, v) for i, v in data if i in (0, 7, 100, 130, 159, 200, 202, 203, 205, 206, 300)]
    for shards in (1, 6):
        same(rows(graph_ann.nearest(df, queries, least_shards=shards)), brute(data, asked))
    assert rows(graph_ann.nearest(df.limit(0), queries)) == []
    assert rows(graph_ann.nearest(df, queries.limit(0))) == []
    few = df.where("vec_id IN (0, 7)")
    same(rows(graph_ann.nearest(few, few)), brute([d for d in data if d[0] in (0, 7)], [d for d in data if d[0] in (0, 7)]))


def test_repeated_query_ids_and_blocks(spark):
    rng = np.random.default_rng(8)
    data = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(50)]
    queries = data[:20] + [(0, [9.0, 9.0, 9.0]), (0, [-9.0, 9.0, 9.0]), (1, data[1][1])]
    least = {}
    for i, v in queries:
        least[i] = min(least.get(i, v), v)
    df, asked = (spark.createDataFrame(t, "vec_id long, embedding array<double>") for t in (data, queries))
    for size in (1, 7, 100):
        same(rows(graph_ann.nearest(df, asked, query_rows=size)), brute(data, list(least.items())))


def tables_of(monkeypatch):
    """The tables that the operator writes, by name."""
    seen, write = {}, graph_ann.materialize
    monkeypatch.setattr(graph_ann, "materialize", lambda df, name=None, **more: seen.setdefault(name, write(df, name, **more)))
    return seen


def test_no_row_holds_a_graph(spark, monkeypatch):
    rng = np.random.default_rng(9)
    data = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(1200)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    seen = tables_of(monkeypatch)
    got = rows(graph_ann.nearest(df, df.where("vec_id < 40"), least_shards=1, query_rows=8))
    widest = max(sum(len(c) for c in r if isinstance(c, (bytes, bytearray, list))) for t in seen.values() for r in t.collect())
    assert widest < 1000  # a vector of 64 bytes with its 32 neighbours, not 1,200 of them
    want = brute(data, data[:40])
    assert len(got) == len(want) and len({g[::2] for g in got} & {w[::2] for w in want}) >= 0.98 * len(want)


def test_wide_vectors_get_more_shards(spark, monkeypatch):
    rng = np.random.default_rng(10)
    data = [(i, [float(x) for x in rng.normal(size=64 if i < 200 else 2)]) for i in range(400)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    seen = tables_of(monkeypatch)
    same(rows(graph_ann.nearest(df, df.where("vec_id % 50 = 0"), least_shards=1, shard_bytes=4 * 64 * 25)), brute(data, data[::50]))
    counts = {r.graph: r["count"] for r in seen["graphs"].groupBy("graph").count().collect()}
    assert len([g for g in counts if g.startswith("64:")]) == 8 and sum(counts.values()) == 400


def test_several_tasks_in_one_stream_of_small_batches(spark, monkeypatch):
    rng = np.random.default_rng(11)
    data = [(f"v{i}", [float(x) for x in np.float32(rng.normal(size=3))]) for i in range(60)]
    data += [(f"w{i}", [float(i), 1.0]) for i in range(5)] + [("q", [1.0])]
    monkeypatch.setattr(graph_ann, "MOST_PARTITIONS", 2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for kind in ("float", "double"):  # both are exact, whatever the queries are in
            df, asked = (spark.createDataFrame(data, f"vec_id string, embedding array<{t}>") for t in (kind, "double"))
            same(rows(graph_ann.nearest(df, asked, least_shards=3, query_rows=4)), brute(data, data))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_beams_narrower_than_a_step():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 6))
    g = Graph(x)
    q = (x[:50] / g.scale).astype(np.float32)
    for beam in (1, 3, 4, 5):
        ids, dist = g.search(q, beam)
        assert ids.shape == (50, beam) and all(len(set(r[r >= 0])) == (r >= 0).sum() for r in ids)
        assert np.allclose(dist[ids >= 0], g._near(q, np.einsum("ij,ij->i", q, q), ids)[ids >= 0], atol=1e-6)
