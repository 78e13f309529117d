"""Shared pieces of the training-data operators."""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A task works on at most about this many characters at a time (one longer text is still whole).
CHUNK_CHARS = 2_000_000
#: What a Python worker keeps from task to task, for one operator at a time: its name, which one, and the thing itself.
_KEPT: list[tuple[str, int, Any]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder (any store that Spark reads)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``doc_id`` and ``text`` alone, a null text as the empty text."""
    return docs.select(
        docs[id_col].alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def kept(name: str, which: int, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, the same one in later tasks of the worker until another operator's tasks come."""
    if not _KEPT or _KEPT[0][:2] != (name, which):
        drop_kept()
        _KEPT.append((name, which, make()))
    return _KEPT[0][2]


def drop_kept(but: str | None = None) -> None:
    """Frees what the worker keeps for an operator other than ``but``: Spark goes on with the same workers."""
    if _KEPT and _KEPT[0][0] != but:
        _KEPT.clear()
        gc.collect()  # models refer to themselves


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = CHUNK_CHARS,
                keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``chars`` bytes of column ``text`` each. The worker keeps only what is kept for ``keep``."""
    drop_kept(keep)
    for batch in batches:
        sizes = batch.column(text).nbytes / max(1, batch.num_rows)
        step = max(1, int(chars / max(1.0, sizes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores until no column of ``df`` has that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def hex64(value: Column) -> Column:
    """A long as 16 lower-case hex digits of its unsigned form."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file; ``TOKENIZER_DIR`` names another folder."""
    return os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), name)


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers, compressed: first bytes first, then all second bytes ..."""
    numbers = np.ascontiguousarray(numbers, np.int64)
    planes = numbers.view(np.uint8).reshape(-1, 8).T
    used = 8 - int(np.argmax(planes[::-1].any(axis=1))) if planes.any() else 1  # a negative number uses all
    return len(numbers).to_bytes(8, "little") + bytes([used]) + pa.compress(planes[:used].tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes) -> np.ndarray:
    n, used = int.from_bytes(packed[:8], "little"), packed[8]
    planes = np.zeros((8, n), np.uint8)
    planes[:used] = np.frombuffer(pa.decompress(packed[9:], n * used, codec="zstd", asbytes=True), np.uint8).reshape(used, n)
    return np.ascontiguousarray(planes.T).view(np.int64).reshape(-1)


def one_by_one(sent: list) -> Iterator:
    """The values of broadcasts; of several, each goes before the next one comes."""
    for b in sent:
        yield b.value
        if len(sent) > 1:
            b.__dict__.pop("_value", None)


#: Bits of the filter by which rows without a partner stay out of the joins: 64 an id, 8 MB at most (when it fills up, more rows pass it).
LEAST_BITS, FILTER_BITS = 1 << 15, 1 << 26


def with_ids_of(rows: DataFrame, id_col: str, ids: DataFrame, column: str) -> DataFrame:
    """The rows of ``rows`` whose id is in ``column`` of ``ids``, and a few others: one bit for each id, in a bitmap of bounded size."""
    size = min(FILTER_BITS, max(LEAST_BITS, 1 << (64 * ids.count()).bit_length()))
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    bits = ids.select(bit(column).alias("b")).groupBy(F.bitmap_bucket_number("b").alias("n")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).collect()
    table = np.zeros(size // 8, np.uint8)
    for r in bits:  # bucket 1 has the bits 1 to 32768, as Spark counts them; 0 lies in bucket 0
        table_at = (r.n - 1) * 4096 if r.n else 0
        m = np.frombuffer(bytes(r.m), np.uint8)
        table[table_at:table_at + 4096] |= m[:len(table[table_at:table_at + 4096])]
    sent = rows.sparkSession.sparkContext.broadcast(table)
    at = F.struct(F.bitmap_bucket_number(bit(id_col)).alias("n"), F.bitmap_bit_position(bit(id_col)).alias("p"))
    return rows.withColumn("at", at).where(_in_bitmap(sent)(F.col("at.n"), F.col("at.p"))).drop("at")


def _in_bitmap(sent):
    @F.arrow_udf("boolean")
    def inside(bucket: pa.Array, position: pa.Array) -> pa.Array:
        drop_kept()
        n, p = bucket.to_numpy(), position.to_numpy()
        at = np.where(n > 0, (n - 1) * 32768, 0) + p
        return pa.array((sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return inside
