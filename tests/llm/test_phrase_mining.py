"""Phrase mining against plain counting: tries, whole tables, small literal texts."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.oracle_harness import duck_connection, frame_hash
from tillroll.llm import catalog, phrase_mining
from tillroll.llm._common import pack, unpack
from tillroll.llm.phrase_mining import RADIX, Trie

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "text string, lang string"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(table, min_count, longest=5, top=2000):
    f, n = {}, Counter()
    for text, lang in table:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, own in f.items():
        frequent = {p: a for p, a in own.items() if a >= min_count and len(p) > 1}
        rows = []
        for p, a in frequent.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in frequent.items()):
                continue
            score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def got(df):
    assert dict(df.dtypes) == {"lang": "string", "phrase": "string", **dict.fromkeys(["rank", "a", "l", "r", "n", "score"], "bigint")}
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def random_texts(seed, docs=200, words="abcdefgh"):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", "\t", ". ", ", ", "\n", "  "]) for _ in range(rng.randrange(60)))
    return [(text(), rng.choice(["en", "de", None])) for _ in range(docs)]


@pytest.mark.parametrize("length, words, rows", [(1, 5, 5), (2, 30, 200), (3, 50, 400), (4, RADIX * 3, 3000), (2, RADIX ** 2 + 9, 2000)])
def test_trie_accepts_its_rows_alone(length, words, rows):
    rng = np.random.default_rng(length)
    own = np.unique(np.minimum(rng.integers(0, words, (rows, length)), rng.integers(0, words, (rows, length))), axis=0)
    own = own[rng.permutation(len(own))]
    values = rng.permutation(len(own))
    trie = Trie.build(own, values, phrase_mining._digits(words))
    ids = np.concatenate([own.reshape(-1), rng.integers(0, words, 500), np.full(length, words - 1)]).astype(np.int32)
    known = {tuple(map(int, r)): int(v) for r, v in zip(own, values)}
    starts, found = trie.accepted(ids, np.arange(len(ids) - length), length)
    want = {i: known[k] for i in range(len(ids) - length) if (k := tuple(map(int, ids[i:i + length]))) in known}
    assert dict(zip(map(int, starts), map(int, found))) == want
    assert len(want) >= len(own)


def test_trie_with_very_many_children():
    own = np.array([(0, b) for b in range(3000)] + [(a, 1) for a in range(1, 3000)])
    trie = Trie.build(own, np.arange(len(own)), 2)
    starts, found = trie.accepted(own.reshape(-1).astype(np.int32), np.arange(len(own)) * 2, 2)
    assert np.array_equal(starts, np.arange(len(own)) * 2) and np.array_equal(found, np.arange(len(own)))
    assert len(trie.base) < 8 * own.size


def test_packed_numbers_come_back():
    rng = np.random.default_rng(9)
    for numbers in ([], [0], [0, 0, 255, 256], [1 << 40, 3], [-1, 5, -(1 << 50)], rng.integers(0, 1 << 62, 1000)):
        assert np.array_equal(unpack(pack(np.array(numbers, np.int64))), np.array(numbers, np.int64))


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 200}, {"trie_cells": 60}, {"chunk_bytes": 300, "trie_cells": 500, "bucket_words": 7},
                                   {"chunk_bytes": 500, "bucket_pairs": 50, "held_pairs": 8}])
def test_chunks_and_tries_of_any_size_give_the_same_rows(spark, sizes):
    table = random_texts(5)
    df = spark.createDataFrame(table, SCHEMA).repartition(3)
    assert got(phrase_mining.collocations(df, min_count=4, **sizes)) == brute(table, 4)


def test_top_and_ties(spark):
    table = random_texts(6, words="abcdefghijklmnop")
    want = brute(table, 3, top=25)
    assert len(want) == 75
    assert got(phrase_mining.collocations(spark.createDataFrame(table, SCHEMA), min_count=3, top=25)) == want


def test_query_equals_sql_and_brute_force(spark):
    result = catalog.op12_phrase_mining(spark, SF).toPandas()
    oracle = duck_connection(SF).sql(catalog.ORACLES["op12_phrase_mining"]).df()
    assert frame_hash(result) == frame_hash(oracle)
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").collect()]
    want = brute(table, 100)
    assert sorted(result[COLUMNS].itertuples(index=False, name=None)) == want and len(want) > 10


def test_literal_pieces_overlaps_letters_and_covered_phrases(spark):
    table = [("New YORK city, new york. new\tyork City;york", "en")] * 2 + [("a a a a", "en"), ("É È É È", None), ("É", "und"), (None, "en"), ("", None), ("x\x1cy z x\x1cy z", "en")]
    df = spark.createDataFrame(table, SCHEMA)
    assert got(phrase_mining.collocations(df, min_count=2)) == brute(table, 2)
    phrases = {r[2]: r[3] for r in got(phrase_mining.collocations(df, min_count=2))}
    assert phrases["new york city"] == 4 and phrases["new york"] == 6 and "york city" not in phrases and phrases["x\x1cy z"] == 2
    assert phrases["a a"] == 3


def test_counts_beyond_64_bits(spark):
    rows = spark.createDataFrame([(9_000_000_000_000_000, 90_000_000_000_000_000, 9_100_000_000_000_000, 9_200_000_000_000_000)], "a long, n long, l long, r long")
    row = rows.selectExpr("(1000 * CAST(a AS DECIMAL(16,0)) * CAST(n AS DECIMAL(17,0))) div (CAST(l AS DECIMAL(17,0)) * CAST(r AS DECIMAL(17,0))) AS s").first()
    assert row.s == 1000 * 9_000_000_000_000_000 * 90_000_000_000_000_000 // (9_100_000_000_000_000 * 9_200_000_000_000_000)


def test_long_text_clashing_columns_and_empty_tables(spark):
    table = [("long words go on and on. " * 40_000, "en"), ("tiny", "en")]
    df = spark.createDataFrame([(*r, 1, "x") for r in table], SCHEMA + ", phrase int, words string")
    assert got(phrase_mining.collocations(df, min_count=100, chunk_bytes=1000)) == brute(table, 100)
    for rows in ([], [(None, None)], [("one two", "en")]):
        assert got(phrase_mining.collocations(spark.createDataFrame(rows, SCHEMA), min_count=2)) == []
