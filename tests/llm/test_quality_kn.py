"""Kneser-Ney model against a plain dictionary version; held-out accuracy; edge cases."""

import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import catalog, quality_kn

SF = "/root/testdata/sf0.1"


def slow_model(texts):
    """Score of a text under p(w | three characters before) by plain recursion."""
    cnt = {n: Counter() for n in (1, 2, 3, 4)}

    def grams(t):
        s = ["<"] * 3 + list(t) + [">"]
        return zip(s, s[1:], s[2:], s[3:])

    for t in texts:
        cnt[4].update(grams(t))
    for n in (3, 2, 1):
        cnt[n].update(g[1:] for g in cnt[n + 1])
    disc, total, left = {}, {}, {}
    for n in cnt:
        f = Counter(cnt[n].values())
        y = f[1] / (f[1] + 2 * f[2]) if f[1] and f[2] else 0.5
        disc[n] = [min(j, max(0.05 * j, j - (j + 1) * y * f[j + 1] / f[j])) if f[j] else 0.5 for j in (1, 2, 3)]
        total[n], left[n] = Counter(), defaultdict(float)
        for g, c in cnt[n].items():
            total[n][g[:-1]] += c
            left[n][g[:-1]] += disc[n][min(c, 3) - 1]

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / 0x110000
        h = g[:-1]
        if not total[n][h]:
            return p(g[1:])
        c = cnt[n][g]
        return (c - disc[n][min(c, 3) - 1] if c else 0) / total[n][h] + left[n][h] / total[n][h] * p(g[1:])

    def score(t):
        return sum(math.log(p(g)) for g in grams(t)), len(t) + 1

    return score


def slow_limits(score, held, quantile=0.998, min_rows=100):
    """Of the held-out (lang, text) rows: a function of a language that gives its middle, lowest and highest."""
    known = defaultdict(list)
    for lang, text in held:
        logp, n = score(text)
        known[lang].append((-logp / n, n))

    def limit(rows):
        middle = np.quantile([x for x, _ in rows], 0.5)
        off = [(x - middle) * math.sqrt(min(n, quality_kn.STEADY)) for x, n in rows]
        return middle, np.quantile(off, 1 - quantile), np.quantile(off, quantile)

    every = limit([r for rows in known.values() for r in rows])
    return lambda lang: limit(known[lang]) if len(known.get(lang, ())) >= min_rows else every


def slow_deviation(score, text, middle):
    logp, n = score(text)
    return (-logp / n - middle) * math.sqrt(min(n, quality_kn.STEADY))


TEXTS = ["Abra cadabra, abra!", "the cat sat on the mat\n", "", "ÄÖ über straße 😀", "the the the", "x", "漢字かな交じり文、漢字かな。", "İstanbul"]


@pytest.mark.parametrize("shard_grams", [4_000_000, 37])
def test_model_equals_plain_version(spark, shard_grams):
    sample = spark.createDataFrame([(t, "en", False) for t in TEXTS] + [("held out", "en", True)], "text string, lang string, held boolean")
    model = quality_kn.load(quality_kn.train(spark, sample, shard_grams))
    assert (len(model.shards) > 1) == (shard_grams == 37)
    slow = slow_model(TEXTS)
    texts = [*TEXTS, "unseen q€", "zzzz", "the dog", "漢字", "\U0010ffff"]
    for t, logp, n in zip(texts, *model.scores(texts)):
        assert n == slow(t)[1] and abs(logp - slow(t)[0]) < 1e-9 * max(1, abs(logp))


def test_probabilities_of_seen_contexts_add_up(spark):
    sample = spark.createDataFrame([(t, "en", False) for t in TEXTS], "text string, lang string, held boolean")
    model = quality_kn.load(quality_kn.train(spark, sample))
    seen = sorted({ord(c) for t in TEXTS for c in t} | {quality_kn.END})
    for context in ("the", "abr", "漢字か"):
        a, b, c = map(ord, context)
        p = []
        for w in seen:
            keys = [quality_kn._key(n, np.array([a << 42 | b << 21 | c]), x) for n in (4, 3, 2, 1) for x in (np.array([w]), None)]
            got, weight = [model.get(k)[0] for k in keys], 1.0
            for known, own in zip(got[::2], got[1::2]):
                if known == known:
                    p.append(weight * known)
                    break
                weight *= own if own == own else 1.0
        rest = 1.0  # unseen characters share what all orders leave
        for n in (4, 3, 2, 1):
            own = model.get(quality_kn._key(n, np.array([a << 42 | b << 21 | c]), None))[0]
            rest *= own if own == own else 1.0
        assert abs(sum(p) + rest * (quality_kn.CODES - len(seen)) / quality_kn.CODES - 1) < 1e-4


def test_hash_table_finds_its_numbers_alone():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(1, 1 << 62, 5000).astype(np.uint64) | np.uint64(1))
    keys = np.concatenate([keys, (np.arange(3000, dtype=np.uint64) << np.uint64(40)) + np.uint64(1)])  # one slot
    table = quality_kn.Table.build(keys, np.arange(len(keys), dtype=float))
    assert np.array_equal(table.get(keys), np.arange(len(keys)))
    assert np.isnan(table.get(keys + np.uint64(2))[: 100]).sum() >= 98


def test_rejects_labelled_junk_and_keeps_clean_text(spark):
    got = {r.doc_id: r.keep for r in catalog.op8_quality_classifier(spark, SF).select("doc_id", "keep").collect()}
    rows = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{SF}/labels.parquet'").fetchall()
    assert len(got) == duckdb.sql(f"SELECT count(*) FROM '{SF}/documents.parquet'").fetchall()[0][0]
    clean, junk = ([got[d] for d, q, _ in rows if q == quality] for quality in (1, 0))
    assert len(junk) > 500 and sum(junk) / len(junk) <= 0.1
    assert sum(clean) / len(clean) >= 0.985


def test_perplexity_and_limits_of_the_query(spark):
    small = SF.replace("0.1", "0.001")
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").collect()
    labels = spark.read.parquet(f"{small}/labels.parquet").where("quality = 1 AND toxic = 0").select(
        "doc_id", (F.pmod(F.xxhash64(F.xxhash64("doc_id")), F.lit(3)) == 0).alias("held")).collect()
    held = {r.doc_id: r.held for r in labels}
    trusted = [d for d in docs if len(d.text) <= quality_kn.MAX_CHARS]
    score = slow_model([d.text for d in trusted if held.get(d.doc_id) is False])
    limits = slow_limits(score, [(d.lang, d.text) for d in trusted if held.get(d.doc_id)])
    got = {r.doc_id: r for r in catalog.op8_quality_classifier(spark, small).collect()}
    for d in docs:
        (logp, n), (middle, low, high) = score(d.text), limits(d.lang)
        off = slow_deviation(score, d.text, middle)
        r = got[d.doc_id]
        assert r.n_tokens == n and np.allclose([r.perplexity, r.deviation, r.lowest, r.highest], [math.exp(-logp / n), off, low, high], rtol=1e-6)
        assert r.keep == (low * (1 + 1e-9) <= off <= high * (1 + 1e-9))


def test_edge_cases(spark):
    good = ["plain words in a row are fine", "more plain words are fine too", "rows of words in plain text"]
    rows = [(i, good[i % 3], "en") for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, "#%#%#%#%#%#%#%", "xx"), (None, "plain words", None), (103, "words " * 100_000, "en"), (103, "words", "en")]
    df = spark.createDataFrame([(d, t, lang, 1.5, "k") for d, t, lang in rows],
                               "doc_id long, text string, lang string, perplexity double, Keep string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(0, 1, 0), (999, 1, 0), (None, 1, 0), (5, None, None), (102, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    scored, own = quality_kn.score_documents(df, labels)
    assert scored.columns[:5] == df.columns and scored.count() == len(rows)
    assert own["perplexity"] not in df.columns and own["keep"].lower() not in [c.lower() for c in df.columns]
    kept = quality_kn.reject_low_quality(df, labels)
    assert kept.schema == df.schema
    ids = [r.doc_id for r in kept.collect()]
    assert 102 not in ids and all(i in ids for i in range(60))
    assert quality_kn.reject_low_quality(df.limit(0), labels).count() == 0
    assert quality_kn.reject_low_quality(df, labels.limit(0)).count() == len(rows)


def test_all_trusted_rows_and_whole_texts_are_learned_from(spark):
    texts = {i: chr(0x4E00 + i) + "ab" for i in range(6500)} | {7000: "long " * 7000}  # more rows, and a longer text, than a sample once held
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in texts], "doc_id long, quality int, toxic int")
    held = {r.doc_id: r.held for r in labels.select(
        "doc_id", (F.pmod(F.xxhash64(F.xxhash64("doc_id")), F.lit(2)) == 0).alias("held")).collect()}
    assert not held[7000]
    score = slow_model([t for i, t in texts.items() if not held[i]])
    middle, low, high = slow_limits(score, [("en", t) for i, t in texts.items() if held[i]])("en")
    scored, own = quality_kn.score_documents(docs, labels, holdout=2)
    got = {r.doc_id: r for r in scored.collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        logp, n = score(t)
        want = [math.exp(-logp / n), (-logp / n - middle) * math.sqrt(min(n, quality_kn.STEADY)), low, high]
        assert np.allclose([got[i][own[c]] for c in ("perplexity", "deviation", "lowest", "highest")], want, rtol=1e-6, atol=1e-9)


def test_quantiles_over_partitions_are_those_of_percentile(spark):
    rows = spark.range(0, 5000, 1, 7).select(
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") < 4990, "b").otherwise("c").alias("key"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 7).alias("x"), F.xxhash64("id").alias("order"))
    at = {"low": 0.002, "mid": 0.5, "high": 0.998}
    got = {r.key: r for r in quality_kn._quantiles(rows, "x", at).collect()}
    want = rows.groupBy("key").agg(*[F.percentile("x", F.lit(q)).alias(n) for n, q in at.items()]).collect()
    assert len(got) == len(want) == 3
    for r in want:
        assert np.allclose([got[r.key][n] for n in at], [r[n] for n in at], rtol=1e-12)
