"""Embedding near-dedup against all pairs: graphs, beams and scans, whole tables, edge cases."""

import math

import numpy as np
import pytest

from tests.oracle_harness import duck_connection, frame_hash
from tillroll.llm import catalog, hnsw_dedup
from tillroll.llm.hnsw_dedup import Hierarchy, Shard, linked, units

SF = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<double>"


def usable(v):
    return v is not None and len(v) > 0 and all(e is not None and math.isfinite(e) for e in v) and any(v)


def brute(table, threshold=0.95):
    own = [np.array(v) / max(map(abs, v)) if usable(v) else None for _, v in table]
    near = [set() for _ in table]
    for i, a in enumerate(own):
        for j in range(i):
            b = own[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                near[i].add(j)
                near[j].add(i)
    least = list(range(len(table)))
    for i in range(len(table)):
        if least[i] == i:
            group, front = {i}, [i]
            while front:
                new = near[front.pop()] - group
                group |= new
                front += new
            for j in group:
                least[j] = min(group)
    groups = {}
    for i, g in enumerate(least):
        groups.setdefault(g, []).append(table[i][0])
    out = []
    for i, (vec_id, _) in enumerate(table):
        ids = [x for x in groups[least[i]] if x is not None]
        root = min(ids) if ids else None
        out.append((vec_id, len(near[i]), root, vec_id == root))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def planted(rng, n, d, group, apart, chain=0):
    """n vectors, of which ``group`` are near copies of one, and ``chain`` step from one to the next."""
    x = rng.standard_normal((n, d))
    x[:group] = x[0] + apart * rng.standard_normal((group, d))
    for i in range(group + 1, group + chain):
        x[i] = x[i - 1] + 0.2 * rng.standard_normal(d)
    return x[rng.permutation(n)]


@pytest.mark.parametrize("group, apart", [(5, 0.05), (400, 0.05), (900, 0.15)])
def test_graphs_find_all_links_of_small_and_large_groups(group, apart):
    rng = np.random.default_rng(group)
    x = units(planted(rng, 2500, 32, group, apart, chain=30))
    copies = rng.integers(1, 4, len(x))
    halves = [(x[:1200], copies[:1200]), (x[1200:], copies[1200:])]
    a, b = (Shard(v, c, Hierarchy.build(v, 0.95)) for v, c in halves)
    for left, right, itself in ((a, b, False), (a, a, True)):
        hit = left.v @ right.v.T >= 0.95
        if itself:
            np.fill_diagonal(hit, False)
        links, label = linked(left, right, 0.95, itself)
        want = hit @ right.copies if itself else np.concatenate([hit @ right.copies, left.copies @ hit])
        assert np.array_equal(links, want)
        r, c = np.nonzero(hit)
        assert np.array_equal(label, hnsw_dedup._least_label(len(links), r, c + (0 if itself else len(left.v))))
    assert a.graph.beam and b.graph.beam and len(a.graph.layers) > 1


def test_a_graph_that_fails_its_audit_is_scanned(monkeypatch):
    rng = np.random.default_rng(1)
    x = units(planted(rng, 600, 16, 40, 0.05))
    monkeypatch.setattr(hnsw_dedup, "RECALL", 2.0)
    graph = Hierarchy.build(x, 0.95)
    assert graph.beam == 0
    shard = Shard(x, np.ones(len(x), int), graph)
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    assert np.array_equal(linked(shard, shard, 0.95, True)[0], hit.sum(axis=1))


def test_rows_that_no_way_leads_to_are_compared_with_all():
    rng = np.random.default_rng(2)
    x = units(rng.standard_normal((300, 8)))
    graph = Hierarchy.build(x, 0.95)
    for edges in (graph.layers[0].edges,):
        edges[edges == 250] = -1
    assert 250 in graph._strays()
    graph.strays = graph._strays()
    rows, sims = graph.search(graph.x[250:251], 16)
    assert 250 in rows[0][sims[0] > 0.999]


def test_whole_table_equals_all_pairs_and_sql(spark):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    result = catalog.op13_embedding_near_dedup(spark, SF)
    assert {k: v for k, v in result.dtypes} == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    assert got(result) == brute(table)
    small = SF.replace("0.1", "0.001")
    oracle = duck_connection(small).sql(catalog.ORACLES["op13_embedding_near_dedup"]).df()
    assert frame_hash(catalog.op13_embedding_near_dedup(spark, small).toPandas()) == frame_hash(oracle)


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 20_000}, {"least_shards": 1}])
def test_planted_groups_over_any_number_of_shards(spark, options):
    rng = np.random.default_rng(3)
    x = planted(rng, 900, 24, 300, 0.04, chain=20)
    x = np.concatenate([x, x[:40], 3 * x[40:60]])
    table = [(i, [float(e) for e in v]) for i, v in zip(rng.permutation(len(x)).tolist(), x)]
    df = spark.createDataFrame(table, SCHEMA).repartition(4)
    assert got(hnsw_dedup.near_copies(df, **options)) == brute(table)


def test_links_through_others_join_groups(spark):
    angle = math.acos(0.95) - 1e-6
    table = [(10 * (5 - i), [math.cos(i * angle), math.sin(i * angle)]) for i in range(5)] + [(99, [-1.0, 0.0])]
    rows = got(hnsw_dedup.near_copies(spark.createDataFrame(table, SCHEMA)))
    assert {r[:3] for r in rows} == {(50, 1, 10), (40, 2, 10), (30, 2, 10), (20, 2, 10), (10, 1, 10), (99, 0, 99)}


def test_nulls_zeros_repeats_other_lengths_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    table = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, nan]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]),
             (9, [1.0, 0.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [0.0, 1.0]), (11, [0.0, 5.0]), (None, [-1.0, -1.0]), (None, None),
             (12, [1e300, -1e300]), (13, [1e-300, -1e-300]), (14, [3.0]), (15, [-3.0]), (16, [-0.0, -1.0]), (17, [0.0, -1.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in table], SCHEMA + ", node int, n_links string")
    assert got(hnsw_dedup.near_copies(df)) == brute(table)


def test_empty_tables_and_one_vector(spark):
    assert got(hnsw_dedup.near_copies(spark.createDataFrame([], SCHEMA))) == []
    assert got(hnsw_dedup.near_copies(spark.createDataFrame([(1, None)], SCHEMA))) == [(1, 0, 1, True)]
    assert got(hnsw_dedup.near_copies(spark.createDataFrame([(1, [2.0])], SCHEMA))) == [(1, 0, 1, True)]
