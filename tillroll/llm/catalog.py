"""One registered query per training-data operator, with production parameters.

Each query runs over the whole of its table. ``ORACLES`` has DuckDB SQL where
SQL can express the result; the others are held against brute force in
``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import decontaminate, dialogue_repair, graph_ann, hnsw_dedup, lm_bloom, phrase_mining, quality_kn, secret_scan, sentencepiece_viterbi, simhash, substring_dedup, token_edits, warc
from tillroll.llm._common import read_table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.round_trip(read_table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_bloom.score_documents(read_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(read_table(spark, sf_dir, "documents")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read_table(spark, sf_dir, "pages")).drop("complete")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(read_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_edits.count_after_edits(read_table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored, own = quality_kn.score_documents(docs.select("doc_id", "text", "lang"), labels)
    return scored.select("doc_id", "lang", *[own[c] for c in ("n_tokens", "perplexity", "deviation", "lowest", "highest", "keep")])


def op9_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return graph_ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(read_table(spark, sf_dir, "documents"), shingle=4, max_bits=4, seed=42)
    return groups.select("doc_id", "fingerprint", "component_id")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue_repair.repair_damaged(read_table(spark, sf_dir, "conversations"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(read_table(spark, sf_dir, "documents"), min_count=100, longest=5, top=2000)


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw_dedup.near_copies(read_table(spark, sf_dir, "embeddings"), threshold=0.95)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_secret_scan": op4_secret_scan,
    "op5_warc": op5_warc,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_graph_neighbours": op9_graph_neighbours,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_embedding_near_dedup": op13_embedding_near_dedup,
}

ORACLES: dict[str, str] = {
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             g AS (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS lead FROM p),
             t AS (SELECT page_id, h, CASE WHEN strlen(h) >= 1000 AND page_id IS DISTINCT FROM lead THEN lead END AS refers_to FROM g)
        SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
        FROM t
    """,
    "op12_phrase_mining": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang,
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
             p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
             w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
             u AS (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) AS s(k) WHERE len(ws) >= k),
             f AS (SELECT lang, k, ws[i:i + k - 1] AS ws, count(*) AS a FROM u GROUP BY ALL HAVING count(*) >= 100),
             n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
             c AS (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
             s AS (SELECT c.lang, c.k, c.ws, c.cut, c.a, l.a AS l, r.a AS r, n.n,
                          (1000::HUGEINT * c.a * n.n) // (l.a::HUGEINT * r.a) AS score
                   FROM c JOIN n ON n.lang = c.lang
                   JOIN f AS l ON l.lang = c.lang AND l.ws = c.ws[:c.cut]
                   JOIN f AS r ON r.lang = c.lang AND r.ws = c.ws[c.cut + 1:]),
             b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, cut) = 1),
             x AS (SELECT lang, k, a, ws[g:g + m - 1] AS inner_ws
                   FROM (SELECT *, unnest(range(1, k - m + 2)) AS g FROM (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2))),
             kept AS (SELECT * FROM b WHERE NOT EXISTS (
                          SELECT 1 FROM x WHERE x.lang = b.lang AND x.inner_ws = b.ws AND 100 * x.a >= 100 * b.a)),
             o AS (SELECT *, array_to_string(ws, ' ') AS phrase FROM kept)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
               n::BIGINT AS n, score::BIGINT AS score
        FROM o QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
    """,
    "op13_embedding_near_dedup": """
        WITH RECURSIVE
             e AS (SELECT vec_id, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                                        AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS v FROM embeddings),
             u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM e WHERE v IS NOT NULL),
             p AS (SELECT a.vec_id, b.vec_id AS other FROM u AS a JOIN u AS b
                   ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95),
             r AS (SELECT vec_id, vec_id AS reached FROM e UNION SELECT r.vec_id, p.other FROM r JOIN p ON p.vec_id = r.reached),
             c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id),
             n AS (SELECT vec_id, count(*) AS n_links FROM p GROUP BY vec_id)
        SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
        FROM e JOIN c ON c.vec_id = e.vec_id LEFT JOIN n ON n.vec_id = e.vec_id
    """,
}
