"""SimHash groups against all-pairs comparison, and the edge cases."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tillroll.llm import simhash

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    parts = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_groups(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                label[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(d, ids.get(root(i), d))
    return sorted(((d, f"{fps[i]:016x}", ids.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def run(df, **kw):
    return sorted((tuple(r) for r in simhash.simhash_groups(df, **kw)
                   .select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_whole_table_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert run(docs) == slow_groups(rows)


@pytest.mark.parametrize("tile", [4096, 3])
def test_near_copies_in_one_large_bucket(spark, tile):
    base = [f"w{i}" for i in range(300)]
    rows = []
    for d in range(60):
        words = list(base)
        for j in range(d % 7):
            words[(37 * d + 11 * j) % 300] = f"x{d}"
        rows.append((100 - d, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df, tile=tile) == slow_groups(rows)
    assert run(df, tile=tile, blocks=5) == slow_groups(rows)


def test_edge_cases(spark):
    rows = [(5, None), (3, ""), (9, " \t\n"), (7, "One two"), (7, "one TWO"), (None, "one two"), (1, "É é"), (2, "É É"),
            (None, "only null ids here at all"), (11, "long " * 200_000)]
    df = spark.createDataFrame([(d, t, "a", "b") for d, t in rows], "doc_id long, text string, fp string, component string")
    assert run(df) == slow_groups(rows)
    assert run(df.limit(0)) == []
    kept = simhash.keep_one_per_group(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text and r.text[:7]) for r in kept.collect()), key=str)
    assert got == sorted([(3, ""), (7, min(["One two", "one TWO"], key=lambda t: _hash(spark, t))), (1, "É é"), (2, "É É"),
                          (None, "only nu"), (11, "long lo")], key=str)


def _hash(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(F.xxhash64("t")).first()[0]


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(4, "a b c d e f g")] * 3 + [(6, "a b c d e f g")], "doc_id long, text string")
    assert [tuple(r) for r in simhash.keep_one_per_group(df).collect()] == [(4, "a b c d e f g")]


def test_spanning_links_connect_like_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 4, np.uint64)
    fps = np.unique(np.concatenate([[b ^ np.uint64(1 << int(x)) ^ np.uint64(1 << int(y)) for x, y in rng.integers(0, 63, (40, 2))] for b in base]).astype(np.uint64))
    links = simhash._spanning_links(fps, 4)
    label = {int(f): int(f) for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        label[root(b)] = root(a)
    want = {int(f): int(f) for f in fps}
    changed = True
    while changed:
        changed = False
        for a in want:
            for b in want:
                if (a ^ b).bit_count() <= 4 and want[a] != want[b]:
                    want[a] = want[b] = min(want[a], want[b])
                    changed = True
    assert len({root(x) for x in label}) == len(set(want.values()))
    assert len(links) < len(fps)
