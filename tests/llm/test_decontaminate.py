"""Decontamination against scoring every passage with every item; planted leaks; edge cases."""

import math
import random
import re
from collections import Counter

import pytest

from tillroll.llm import catalog, decontaminate
from tillroll.llm.decontaminate import ItemIndex, question_and_answer

SF = "/root/testdata/sf0.01"


def slow_hits(texts, doc, threshold=0.5, overlap=0.8):
    """BM25 share of every item in every passage, then the overlap check."""
    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    df = Counter(t for w in words for t in set(w))
    mean = sum(map(len, words)) / max(1, len(words))
    window = max(64, 2 * max(map(len, words), default=0))
    d = re.findall(r"\w+", doc.lower())
    best = {}
    for s in range(0, max(1, len(d) - window // 2), window // 2):
        part = d[s:s + window]
        for i, w in enumerate(words):
            if not w:
                continue
            share = {}
            for t, n in Counter(w).items():
                idf = math.log(1 + (len(texts) - df[t] + 0.5) / (df[t] + 0.5))
                share[t] = idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean))
            score = sum(x for t, x in share.items() if t in set(part)) / sum(share.values())
            if score < threshold - 1e-9:
                continue
            cover = []
            for p in question_and_answer(texts[i]):
                n = min(5, len(p))
                own = {tuple(p[j:j + n]) for j in range(len(p) - n + 1)}
                there = {tuple(part[j:j + n]) for j in range(len(part) - n + 1)}
                cover.append(len(own & there) / len(own))
            if min(cover) >= overlap and (-sum(cover), s) < best.get(i, (0, 0))[:2]:
                best[i] = (-sum(cover), s, score)
    return [(i, s, round(x, 9)) for i, (_, s, x) in sorted(best.items())]


def fast_hits(texts, doc, **kw):
    return [(i, s, round(x, 9)) for i, s, x, _, _ in ItemIndex(texts, **kw).hits(doc)]


@pytest.mark.parametrize("seed", range(6))
def test_index_equals_full_scoring(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(rng.choice([40, 400]))]
    pick = lambda n: " ".join(rng.choices(vocab, weights=[1 / (i + 1) for i in range(len(vocab))], k=n))
    items = [". ".join(pick(rng.randint(1, 20)) for _ in range(rng.randint(1, 3))) + "." for _ in range(60)]
    for _ in range(8):
        doc = pick(rng.randint(0, 150))
        for i in rng.sample(items, rng.randint(0, 3)):
            words = i.split()
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = "changed"
            doc += " " + " ".join(words) + " " + pick(rng.randint(0, 90))
        assert fast_hits(items, doc, threshold=0.5) == slow_hits(items, doc)


def test_query_finds_the_planted_items_and_no_others(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    norm = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    want = {(d.doc_id, i.item_id) for d in docs for i in items if norm(i.text) in norm(d.text)}
    got = {(r.doc_id, r.item_id) for r in catalog.op2_benchmark_decontamination(spark, SF).collect()}
    assert want and want <= got
    texts = [i.text for i in sorted(items, key=lambda r: (r.item_id, r.text))]
    ids = sorted(i.item_id for i in items)
    for d in docs[:120]:
        assert {(d.doc_id, ids[i]) for i, _, _ in slow_hits(texts, d.text)} == {g for g in got if g[0] == d.doc_id}


def test_edge_cases(spark):
    items = [(1, "What is the colour of the old barn door? It is faded red."), (2, None), (3, "..."), (None, "One sentence item without end"),
             (1, "What is the colour of the old barn door? It is faded red.")]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    leak = "Noise before. what is the COLOUR of the old barn door? it is faded red! noise after"
    question_only = "What is the colour of the old barn door? It is green."
    docs = [(7, leak, "a"), (7, leak, "a"), (8, question_only, "b"), (9, None, None), (10, "", None), (None, "one sentence item WITHOUT end", "c"),
            (11, "filler words here " * 60_000 + leak, "d")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.find_contamination(df, bench).collect()), key=str)
    assert got == sorted([(7, 1)] * 4 + [(None, None)] + [(11, 1)] * 2, key=str)
    # several shards find the same
    many = sorted(((r.doc_id, r.item_id) for r in decontaminate.find_contamination(df, bench, shard_words=20).collect()), key=str)
    assert many == got
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.schema == df.schema
    assert sorted((r.doc_id for r in kept.collect())) == [8, 9, 10]
    assert decontaminate.find_contamination(df.limit(0), bench).count() == 0
    assert decontaminate.find_contamination(df, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(df, bench.limit(0)).count() == len(docs)


def test_rows_scores_and_passages_do_not_depend_on_the_shards(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    words = sum(len(re.findall(r"\w+", r.text)) for r in bench.collect())
    seen = []
    for shards in (1, 4, 16):
        rows = decontaminate.find_contamination(docs, bench, shard_words=-(-words // shards)).collect()
        seen.append(sorted(map(tuple, rows)))
        made = len(decontaminate._indexes(bench, "item_id", "text", -(-words // shards), 0.5, 0.8))
        assert shards * 3 // 4 <= made <= shards  # a shard may get no item
    assert seen[0] and seen[0] == seen[1] == seen[2]
    kept = [sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench, shard_words=n).select("doc_id").collect()) for n in (words, words // 8)]
    assert kept[0] == kept[1] == sorted({r.doc_id for r in docs.select("doc_id").collect()} - {r[0] for r in seen[0]})

