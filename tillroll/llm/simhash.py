"""SimHash near-dedup: fingerprints, pigeonhole blocks, Hamming check, components.

Edge cases: a null text counts as empty; a text without words has fingerprint
zero and is linked like any other; fewer words than the shingle length give
one shingle of all words; repeated rows have the same fingerprint and give one
row each; a null id keeps its row, but never names a component (a component
of null ids only has a null ``component_id``); an empty table gives no rows;
other columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tillroll.llm._common import free_name, hex64, id_and_text, text_chunks
from tillroll.llm.components import connected_components
from tillroll.session import materialize

#: Members of a bucket that one task compares; a larger bucket is dealt out as pairs of chunks.
TILE = 4096


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included."""
    # bytes.lower and bytes.split touch A-Z and the six ASCII spaces alone
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0] + [e + 1 for e in ends[:-1]]
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1:]
    h = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:n], last)), np.uint64, n)
    bits = np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 255):  # no more than a byte holds
        ones += bits[i:i + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     shingle: int = 4, seed: int = 42) -> DataFrame:
    """Columns ``doc_id``, ``fp`` (the fingerprint as a signed long) and ``text_hash``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches):
            fp = np.array([fingerprint(t, shingle, seed) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(fp.view(np.int64)), b.column("text_hash")],
                ["doc_id", "fp", "text_hash"])

    slim = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, fp long, text_hash long")


def _blocks(m: int) -> list[tuple[int, int]]:
    """(offset, width) of ``m`` nearly equal blocks of 64 bits."""
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _spanning_links(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A link from the first member of each component of ``fps`` to every other one."""
    links, rest = [], fps
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= bits
            if near.any():
                found = rest[near]
                links += [(int(root), int(f)) for f in found]
                queue += list(found)
                rest = rest[~near]
    return links


def link_fingerprints(distinct: DataFrame, max_bits: int = 4, blocks: int | None = None,
                      tile: int = TILE) -> DataFrame:
    """Links ``src``, ``dst`` that connect the same fingerprints as all pairs within ``max_bits``.

    Of ``m`` blocks at least ``m - max_bits`` are equal in such a pair, so it
    shares the bucket of some choice of that many blocks; any ``m`` finds
    every pair, larger ones make smaller buckets and more rows. Within a
    bucket the bits are compared, and each component gives a star of links
    rather than its pairs. A bucket beyond ``tile`` members is dealt out as
    pairs of chunks: all its pairs still meet, but no task holds more than two chunks.
    """
    if blocks is None:
        n = distinct.count()
        # one block more for each 2^6-fold growth keeps buckets small
        blocks = max_bits + 2 + (n > 1 << 25) + (n > 1 << 31)
    parts = _blocks(blocks)
    keys = []
    for i, chosen in enumerate(combinations(range(blocks), blocks - max_bits)):
        key = F.lit(i).cast("long")
        for j in chosen:
            off, width = parts[j]
            key = F.xxhash64(key, F.shiftrightunsigned("fp", off).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = rows.groupBy("key").count().where("count > 1")
    n_tiles = F.ceil(F.col("count") / tile).cast("int")
    dealt = (
        rows.join(sizes, "key")
        .select("key", "fp", n_tiles.alias("n"), F.pmod(F.xxhash64("fp", "key"), n_tiles).cast("int").alias("c"))
        .select("key", "fp", "c", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o"))
        .select(F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")).alias("bucket"), "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(links):
            a = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["src", "dst"])

        held_key, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:
            held_key = np.concatenate([held_key, b.column("bucket").to_numpy()])
            held = np.concatenate([held, b.column("fp").to_numpy().view(np.uint64)])
            cuts = np.flatnonzero(np.diff(held_key)) + 1
            if len(cuts):  # the last bucket may go on in the next batch
                links = [x for part in np.split(held[:cuts[-1]], cuts[:-1]) if len(part) > 1
                         for x in _spanning_links(part, max_bits)]
                held_key, held = held_key[cuts[-1]:], held[cuts[-1]:]
                if links:
                    yield out(links)
        if links := _spanning_links(held, max_bits):
            yield out(links)

    return (dealt.repartition("bucket").sortWithinPartitions("bucket", "fp")
            .mapInArrow(run, "src long, dst long").distinct())


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                   max_bits: int = 4, seed: int = 42, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (hex), ``component_id``
    (the smallest id reachable over links of at most ``max_bits`` differing bits),
    ``fp`` and ``text_hash`` (XXH64 of the text).

    Copies share a fingerprint, so links are sought among distinct
    fingerprints only, and a group of copies costs one row there.
    """
    fps = materialize(with_fingerprint(docs, id_col, text_col, shingle, seed), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    comp = connected_components(link_fingerprints(distinct, max_bits, blocks, tile))
    label = distinct.join(comp, distinct.fp == comp.node, "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component"))
    label = materialize(label, "labels")
    first = label.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = label.join(first, "component").select("fp", "component_id")
    return fps.join(ids, "fp").select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id", "fp", "text_hash")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold the smallest id of their group, one row a group.

    All columns stay as they are. Of several texts under that id, that with
    the smallest text hash stays; of equal rows, one. A group whose ids are all null keeps one row.
    """
    groups = simhash_groups(docs, id_col, text_col, **options)
    # groups of null ids only have no id to be told by: their fingerprint names them
    groups = materialize(groups.withColumn(
        "group", F.when(F.col("component_id").isNull(), F.col("fp").cast("string")).otherwise(F.col("component_id").cast("string"))
    ).select("doc_id", "component_id", "group", "text_hash"), "groups")
    lead = (groups.where("doc_id <=> component_id").groupBy("group")
            .agg(F.min("text_hash").alias("text_hash"), F.first("doc_id").alias("doc_id")))
    copies = groups.groupBy("doc_id", "text_hash").count()
    kept = lead.alias("k").join(
        copies.alias("c"), F.expr("k.doc_id <=> c.doc_id AND k.text_hash = c.text_hash")
    )
    own, its_id, its_hash, n = (free_name(docs, x) for x in ("text_hash", "kept_id", "kept_hash", "copies"))
    kept = kept.select(F.col("k.doc_id").alias(its_id), F.col("k.text_hash").alias(its_hash), F.col("count").alias(n))
    tagged = docs.withColumn(own, F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))))
    found = tagged.join(kept, tagged[id_col].eqNullSafe(kept[its_id]) & (tagged[own] == kept[its_hash]))
    once = found.where(F.col(n) == 1)
    many = found.where(F.col(n) > 1).dropDuplicates([id_col, own])
    return once.unionByName(many).select(*[F.col(f"`{c}`") for c in docs.columns])
