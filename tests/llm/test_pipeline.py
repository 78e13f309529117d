"""The pipeline's rows against each stage done over in plain Python."""

import __spark_entry__
import corpus_pipeline
import sentencepiece
from pyspark.sql import functions as F

from tillroll.llm import quality_kn, secret_scan
from tillroll.llm._common import tokenizer_path
from tillroll.llm.sentencepiece_viterbi import MODEL

from test_decontaminate import slow_hits
from test_quality_kn import slow_deviation, slow_limits, slow_model
from test_secret_scan import slow_spans
from test_simhash import slow_groups

SF = "/root/testdata/sf0.001"


def slow_pipeline(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND toxic = 0").select(
        "doc_id", (F.pmod(F.xxhash64(F.xxhash64("doc_id")), F.lit(3)) == 0).alias("held")).collect()
    held = {r.doc_id: r.held for r in labels}
    trusted = [d for d in docs if len(d["text"]) <= quality_kn.MAX_CHARS]
    score = slow_model([d["text"] for d in trusted if held.get(d["doc_id"]) is False])
    limits = slow_limits(score, [(d["lang"], d["text"]) for d in trusted if held.get(d["doc_id"])])

    def clean(d):
        middle, low, high = limits(d["lang"])
        return low * (1 + 1e-9) <= slow_deviation(score, d["text"], middle) <= high * (1 + 1e-9)

    docs = [d for d in docs if clean(d)]
    docs = [d for d, g in zip(sorted(docs, key=lambda d: d["doc_id"]),
                              sorted(slow_groups([(d["doc_id"], d["text"]) for d in docs]), key=lambda g: g[0])) if g[0] == g[2]]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    docs = [d for d in docs if not slow_hits(items, d["text"])]
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))
    out = []
    for d in docs:
        text, at, parts = d["text"], 0, []
        for s, _, _, e in slow_spans(text):
            if s >= at:
                parts += [text[at:s], secret_scan.MARK]
            at = max(at, e)
        clean = "".join(parts) + text[at:]
        out.append((d["doc_id"], clean, d["lang"], d["source"], len(clean) if parts else d["n_chars"], lib.encode(clean)))
    return sorted(out)


def test_pipeline_equals_plain_python(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids"]
    rows = sorted(tuple(r) for r in got.collect())
    want = slow_pipeline(spark)
    assert rows == want
    assert 0 < len(rows) < spark.read.parquet(f"{SF}/documents.parquet").count()
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


def test_stages_take_empty_and_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string"
    odd = spark.createDataFrame([(1, None, None, None, None, "k"), (None, "", "en", "s", 0, "k"), (2, "token=abcdefgh", "en", "s", 14, "k"),
                                 (2, "token=abcdefgh", "en", "s", 14, "k"), (3, "long " * 50_000, "xx", "s", 3, "k")], schema)
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= docs.count()
        out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert out.columns == [*docs.columns, "ids"] and out.count() == docs.count()
