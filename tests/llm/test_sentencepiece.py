"""Piece search against the sentencepiece library and a plain Viterbi; round trips; edge cases."""

import gc
import random
import weakref

import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tillroll.llm import catalog, sentencepiece_viterbi
from tillroll.llm._common import text_chunks, tokenizer_path
from tillroll.llm.sentencepiece_viterbi import MARK, MODEL, PieceModel, decode, encode

SF = "/root/testdata/sf0.001"
CASES = ["", " ", "   a  b   c", "hello    world\n\n\tfoo", "日本語テキスト😀", "a" * 500, "▁▁x", "abcabc" * 300, "<s>x</s><unk><0x0A>",
         "ab" * 400 + "😀zq\x00", "é" * 70, "don't won't", "  \n \n  ", "x" + " " * 100 + "y", "Straße ŒUVRE ñandú"]


@pytest.fixture(scope="module")
def data():
    with open(tokenizer_path(MODEL), "rb") as f:
        return f.read()


def texts(n=400):
    rng = random.Random(4)
    letters = "aeionrstl  \n.é日😀▁_-1"
    return CASES + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for _ in range(n)]


def test_bpe_ids_equal_the_library(data):
    model, lib = PieceModel.load(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    want = lib.encode(texts())
    assert [x.tolist() for x in model.encode_all(texts())] == want
    assert [model.encode(t).tolist() for t in reversed(texts())] == want[::-1]
    assert [model.decode(i) for i in want] == lib.decode(want)


def test_unigram_ids_equal_the_library(data):
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(data)
    proto.trainer_spec.model_type = 1
    # distinct scores, exact in single precision: no ties
    rng = random.Random(5)
    for p in proto.pieces:
        if p.type == 1:
            p.score = -(rng.randrange(1 << 12) + len(p.piece)) / 64
    model, lib = PieceModel.load(proto.SerializeToString()), sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def total(ids):
        return sum(proto.pieces[i].score for i in ids)

    for t in texts(200):
        got, want = model.encode(t).tolist(), lib.encode(t)
        assert got == want or (total(got) == total(want) and lib.decode(got) == lib.decode(want))


def slow_unigram(model, part):
    best = [(0.0, [])]
    for end in range(1, len(part) + 1):
        ways = []
        for begin in range(max(0, end - model.max_len), end):
            i = model.ids.get(part[begin:end])
            if i is not None or end - begin == 1:
                s = model.unk_score if i is None else model.scores[i]
                ways.append((best[begin][0] + s, -begin, best[begin][1] + ([i] if i is not None else [model.unk])))
        s, _, ids = max(ways, key=lambda w: w[:2])
        best.append((s, ids))
    return best[-1][1]


@pytest.mark.parametrize("seed", range(8))
def test_window_equals_whole_lattice(seed):
    rng = random.Random(seed)
    pieces = ["<unk>", "a", "b", MARK] + sorted({"".join(rng.choice("ab" + MARK) for _ in range(rng.randint(2, 5))) for _ in range(14)})
    model = PieceModel(pieces, [-rng.random() for _ in pieces], "unigram", dummy_prefix=False)
    for n in (1, 5, 60, 400, 1500):
        part = "".join(rng.choice("ab" + MARK + "c") for _ in range(n))
        assert model.search(part) == slow_unigram(model, part)
        assert model.search(part[:-1] + "a") == slow_unigram(model, part[:-1] + "a")


def test_bpe_window_equals_merging(data):
    model = PieceModel.load(data)
    rng = random.Random(6)
    for n in (3, 40, 700):
        part = "".join(rng.choice("etaoinsrh") for _ in range(n))
        assert [model.pieces[i] for i in model.search(part)] == model.merge(part)


def test_query_equals_the_library(spark, data):
    lib = sentencepiece.SentencePieceProcessor(model_proto=data)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = catalog.op1_sentencepiece(spark, SF).collect()
    want = spark.createDataFrame([(d, lib.encode(t)) for d, t in docs.items()], "doc_id long, ids array<int>")
    want = {r[0]: (r[1], r[2]) for r in want.select("doc_id", F.size("ids"), F.xxhash64("ids")).collect()}
    assert {r.doc_id: (r.n_ids, r.ids_hash) for r in got} == want
    assert all(r.decodes for r in got)


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "hello world", "c"), (2, "x" * 300_000, "d"), (3, "hello", "e"), (3, "hello", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode(df)
    assert out.columns == ["doc_id", "text", "ids", "_ids"] and out.count() == len(rows)
    back = decode(out, ids_col="_ids")
    assert sorted(map(str, ((r.doc_id, r.text or "", r.ids) for r in back.collect()))) == sorted(
        map(str, ((r.doc_id, r.decoded, r.ids) for r in back.collect())))
    assert encode(df.limit(0)).count() == 0
    odd = spark.createDataFrame([([5, None, 40_000_000, 1, 2],), (None,), ([],), ([3 + 0xFF],)], "ids array<int>")
    assert [r.decoded for r in decode(odd).collect()][1:3] == [None, ""]
    assert "⁇" in decode(odd).first().decoded


def test_a_worker_keeps_the_model_until_another_operator_comes(data):
    model = weakref.ref(sentencepiece_viterbi._model(data))
    gc.collect()
    assert sentencepiece_viterbi._model(data) is model()
    list(text_chunks(iter([])))  # as simhash and the classifier begin a task
    assert model() is None
