"""Bloom-filter model against exact counts; held-out gain; edge cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tillroll.llm import catalog, lm_bloom

SF = "/root/testdata/sf0.001"


def slow_tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def low(c):
    return int(lm_bloom.EDGES[np.searchsorted(lm_bloom.EDGES, c, "right") - 1])


def high(c):
    return int(lm_bloom.EDGES[np.searchsorted(lm_bloom.EDGES, c, "right")]) - 1


def slow_scores(rows):
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    words, pairs = Counter(), Counter()
    for (_, t), h in zip(rows, held):
        if not h:
            tok = slow_tokens(t)
            words.update(tok)
            pairs.update(zip(["<s>", *tok], tok))
    n, v = sum(words.values()), len(words)
    f = Counter(words.values())
    d = f[1] / (f[1] + 2 * f[2]) if f[1] and f[2] else 0.5
    out = []
    for (doc, t), h in zip(rows, held):
        tok = slow_tokens(t)
        base = score = 0.0
        for b, w in zip(["<s>", *tok], tok):
            c = words[w]
            base += math.log10((c + 1) / (n + v + 1))
            if n:
                single = (low(c) - d) / n if c else d * v / n
                ctx = words[None if b == "<s>" else b]
                both = low(pairs[b, w]) / high(ctx) if pairs[b, w] else 0.0
                score += math.log10(0.4 * both + 0.6 * single)
        out.append((doc, h, len(tok), sum(words[w] > 0 for w in tok), n, base, score))
    return out


def check(got, want):
    got, want = sorted((tuple(r) for r in got), key=str), sorted(want, key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5])) and abs(g[6] - w[6]) < 1e-6 * max(1, abs(w[6]))


@pytest.fixture
def sure(monkeypatch):
    """So many probes that no absent key is found."""
    monkeypatch.setattr(lm_bloom, "PROBES", 40)
    monkeypatch.setattr(lm_bloom, "BITS_PER_KEY", 58.0)


def in_this_process(rows, shard_bytes=lm_bloom.SHARD_BYTES, spark=None):
    """The operator's steps without Python workers, which would not see changed constants."""
    import pyarrow as pa

    learn = [t or "" for d, t in rows if not (d is not None and zlib.crc32(str(d).encode()) % 7 == 2)]
    batches = [pa.RecordBatch.from_pydict({"text": learn})] if learn else []
    counts = pa.Table.from_batches(list(lm_bloom._count_rows(iter(batches))), pa.schema([("key", pa.int64()), ("c", pa.int64())]))
    bits = 4
    counts = counts.sort_by("key")
    segs = [b.to_pylist()[0] for b in lm_bloom._build_rows(bits)(iter(counts.to_batches(max_chunksize=50)))]
    by = {s["seg"]: s for s in segs}
    total, distinct, once, twice = (sum(s[k] for s in segs) for k in ("tokens", "words", "once", "twice"))
    d = once / (once + 2 * twice) if once and twice else 0.5
    def part(what, a, b):
        own = [by.get(i, {f"{what}_n": 0, f"{what}_bits": b""}) for i in range(a, b)]
        return lm_bloom.Filter(bits, a, [x[f"{what}_n"] for x in own], [len(x[f"{what}_bits"]) for x in own], b"".join(x[f"{what}_bits"] for x in own))

    words, pairs = [], []
    for a, b in ((0, 5), (5, 16)):
        keys = np.frombuffer(b"".join(by[i]["word_keys"] for i in range(a, b) if i in by), np.uint64)
        c = np.frombuffer(b"".join(by[i]["word_counts"] for i in range(a, b) if i in by), np.int64)
        words.append(lm_bloom.Words(bits, a, b, part("word", a, b), keys, c))
        pairs.append(lm_bloom.Pairs(bits, a, b, part("pair", a, b)))
    sums = lm_bloom.score_texts([t or "" for _, t in rows], lm_bloom.Totals(total, distinct, d, 0.4), iter(words), iter(pairs))
    return [(doc, doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2, int(n), int(k), total, b, s)
            for (doc, _), n, k, b, s in zip(rows, *sums)]


ROWS = [(i, t) for i, t in enumerate([
    "the cat sat on the mat", "The CAT sat", None, "", "the the the the the the the", "É é É", "a b c d e f g",
    "on the mat the cat sat on the mat", "x\x0by\x0cz w\x1cw", "dog", "the dog", "unseen words here"] * 2)] + [(None, "null id"), (3, "the cat")]


def test_model_equals_exact_counts(sure):
    check(in_this_process(ROWS), slow_scores(ROWS))


def test_tokens_are_the_words():
    texts = [t or "" for _, t in ROWS] + ["", " ", "a" * 5000 + " b", "x\x1cy z\x85w\u2003v"]
    cur, before, sizes = lm_bloom.tokens(texts)
    flat = [w for t in texts for w in slow_tokens(t)]
    assert sizes.tolist() == [len(slow_tokens(t)) for t in texts]
    name = {}
    for w, h, b, i in zip(flat, cur.tolist(), before.tolist(), range(len(flat))):
        assert name.setdefault(h, w) == w and h & 1 == 0
        assert b == (lm_bloom.START if i == 0 or flat[i - 1] is None else cur[i - 1])
    assert len(name) == len(set(flat))


def test_filter_never_misses_and_rarely_errs():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 63, 40_000, np.uint64))
    counts = np.minimum(rng.zipf(1.6, len(keys)), 1 << 40)
    n, bits = lm_bloom.filter_bits(keys[::2], counts[::2])
    f = lm_bloom.Filter(4, 0, [n] * 16, [len(bits)] * 16, bits * 16)
    want = np.searchsorted(lm_bloom.EDGES, counts, "right")
    got = f.classes(keys)
    assert (got[::2] >= want[::2]).all() and (got[::2] > want[::2]).mean() < 0.02 and (got[1::2] > 0).mean() < 0.02


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = catalog.op3_lm_scoring(spark, SF).collect()
    want = slow_scores([tuple(d) for d in docs])
    key, off = (lambda r: r[0]), []
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 * abs(w[5])
        # absent keys that the filter takes for present; a word repeated all over a text errs all over it
        off.append(abs(g[6] - w[6]) / abs(w[6]))
    assert sum(x > 0.05 for x in off) <= 0.01 * len(off) and sum(off) / len(off) < 0.01
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held) and sum(r.score > r.base_score for r in held) >= 0.8 * len(held)


def test_edge_cases_and_shards(spark):
    df = spark.createDataFrame([(d, t, 1.0) for d, t in ROWS + ROWS[:1] * 3 + [(50, "word " * 300_000)]], "doc_id long, text string, score double")
    rows = [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]
    one = sorted((tuple(r) for r in lm_bloom.score_documents(df).collect()), key=str)
    assert [g[:5] for g in one] == [w[:5] for w in sorted(slow_scores(rows), key=str)]
    many = sorted((tuple(r) for r in lm_bloom.score_documents(df, shard_bytes=150, group_chars=500).collect()), key=str)
    assert [g[:5] for g in one] == [g[:5] for g in many]
    assert np.allclose([g[5:] for g in one], [g[5:] for g in many])
    assert lm_bloom.score_documents(df.limit(0)).count() == 0
    none = lm_bloom.score_documents(df.where("doc_id = 2")).collect()
    assert len(none) == 1


def test_texts_are_passed_once_whatever_the_shards(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(d, t) for d, t in ROWS], "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    scans = []
    keep = lm_bloom.materialize

    def written(df, name):
        scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation"))
        return keep(df, name)

    monkeypatch.setattr(lm_bloom, "materialize", written)
    for size in (lm_bloom.SHARD_BYTES, 100):
        scans.clear()
        df = lm_bloom.score_documents(spark.read.parquet(str(tmp_path / "docs")), shard_bytes=size)
        assert scans == [1] and df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1  # counted once, scored once
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
