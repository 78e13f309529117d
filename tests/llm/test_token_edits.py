"""Edited counts against encoding the whole text again."""

import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tillroll.llm import catalog, token_edits
from tillroll.llm._common import tokenizer_path
from tillroll.llm.token_edits import Counter, CountTree

SF = "/root/testdata/sf0.001"
FULL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load():
    with open(tokenizer_path(token_edits.RANKS), "rb") as f:
        return token_edits.read_ranks(f.read())


RANKS_TABLE = load()
COUNT = Counter(RANKS_TABLE)
ENCODING = tiktoken.Encoding("full", pat_str=FULL, mergeable_ranks=RANKS_TABLE, special_tokens={})


def whole(text):
    return len(ENCODING.encode_ordinary(text))


def replace(text, pos, cut, put):
    pos = min(max(pos, 0), len(text))
    return text[:pos] + put + text[min(pos + max(cut, 0), len(text)):]


PIECE = st.text(st.sampled_from(list("ab 's tlre\n\t1.é日😀  '")), max_size=12)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("ab 's tlre\n1.é😀  '")), max_size=60),
       st.lists(st.tuples(st.integers(-2, 70), st.integers(-1, 20), PIECE), max_size=6))
def test_edits_equal_encoding_anew(text, edits):
    tree = CountTree(*COUNT.leaves(text))
    assert tree.total == whole(text)
    for e in edits:
        want = replace(text, *e)
        text, _ = tree.edit(COUNT, text, *e)
        assert text == want and tree.total == whole(text) and tree.chars[1] == len(text)


def test_a_small_edit_of_a_long_text_encodes_little():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(20_000))
    tree = CountTree(*COUNT.leaves(text))
    for _ in range(200):
        pos = rng.randrange(len(text))
        text, n = tree.edit(COUNT, text, pos, 5, "new words")
        assert n < 120
    assert tree.total == whole(text)
    # the leaves alone carry the state on
    again = CountTree(*tree.leaves())
    assert np.array_equal(again.tokens, tree.tokens) and np.array_equal(again.chars, tree.chars)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    edits = {r.doc_id: r for r in docs.withColumn("edits", token_edits.own_text_edits()).collect()}
    got = catalog.op7_token_counts(spark, SF).collect()
    assert len(got) == docs.count()
    for r in got:
        text = edits[r.doc_id].text
        assert r.tokens_before == whole(text)
        for e in edits[r.doc_id].edits:
            text = replace(text, e.pos, e.cut, e.put)
        assert (r.tokens_after, r.n_chars) == (whole(text), len(text))
    assert sum(r.encoded_chars for r in got) < 0.2 * sum(r.n_chars for r in got)


def test_edge_cases(spark):
    rows = [(1, None, [(0, 0, "hello world")]), (2, "", None), (3, "it's fine", [(-5, 2, "I"), None, (3, None, "x"), (99, 1, " ok")]), (3, "it's fine", []),
            (None, "x" * 200_000, [(100_000, 10, " ")])]
    df = spark.createDataFrame([(d, t, e, "z") for d, t, e in rows],
                               "doc_id long, text string, edits array<struct<pos:int,cut:int,put:string>>, leaf_chars string")
    trees = token_edits.build_trees(df)
    assert trees.columns == [*df.columns, "_leaf_chars", "leaf_tokens"]
    done = token_edits.apply_edits(trees, chars_col="_leaf_chars")
    got = sorted(((r.doc_id, r.text[:20], r.tokens_before, r.tokens_after) for r in done.collect()), key=str)
    x = "x" * 100_000 + " " + "x" * 99_990
    want = [(1, "hello world", 0, whole("hello world")), (2, "", 0, 0), (3, "I's fine ok", whole("it's fine"), whole("I's fine ok")),
            (3, "it's fine", whole("it's fine"), whole("it's fine")), (None, "x" * 20, whole("x" * 200_000), whole(x))]
    assert got == sorted(want, key=str)
    assert token_edits.count_after_edits(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 8, 9])
def test_find(n):
    chars = [i % 3 for i in range(n)]
    tree = CountTree(chars, chars)
    at = 0
    for leaf, c in enumerate(chars):
        for p in range(at, at + c):
            assert tree.find(p) == (leaf, at)
        at += c
