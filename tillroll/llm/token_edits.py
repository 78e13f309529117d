"""Edit-aware token counts: a segment tree over each document's pre-tokens.

The leaves of a document's tree are its pre-tokens in order, each with its
characters and its tokens; inner nodes hold sums, so the document's count is at
the root and a character is found by going down. An edit re-encodes the
pre-tokens that it touches, some context before them, and those after them up
to the first boundary where old and new pre-tokens meet again: pre-tokens are
cut from left to right by what follows, so from there on nothing changes. The new counts take the leaves of the old
ones (the last leaf takes what has no leaf of its own) and the sums above are updated.

The state of a document is two arrays, the characters and the tokens of its leaves, so it can be kept in a table between batches of edits.

Edge cases: a null text counts as empty (one empty leaf); null edits and null parts of an edit change nothing, an edit's
position and length are brought within the text; edits of a document apply in order, each to the
text that the one before left; repeated rows and null ids are kept, an empty
table gives no rows; :func:`build_trees` keeps other columns.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm._common import free_name, text_chunks, tokenizer_path

RANKS = "byte_bpe_50k.tiktoken"
MAX_RANK_BYTES = 64 << 20
# Fixed value: the pre-token pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A pre-token may depend on so many characters after its end.
CONTEXT = 3
PART_CHARS, PARTS = 48, 200_000
EDITS = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("cut", T.IntegerType()), T.StructField("put", T.StringType())]))


class Counter(dict):
    """Tokens of a pre-token; a bounded number of short ones is remembered."""

    def __init__(self, ranks: dict[bytes, int]):
        self.split = regex.compile(PATTERN)
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, part: str) -> int:
        n = len(self.encoding.encode_ordinary(part))
        if len(part) <= PART_CHARS:
            if len(self) >= PARTS:
                self.clear()
            self[part] = n
        return n

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        """Characters and tokens of the pre-tokens of a text (one empty leaf for the empty text)."""
        parts = self.split.findall(text)
        return (list(map(len, parts)), list(map(self.__getitem__, parts))) if parts else ([0], [0])


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class CountTree:
    """Sums of characters and tokens over the leaves of a document; node 1 is the root."""

    def __init__(self, chars, tokens):
        self.n = len(chars)
        self.size = 1 << max(0, self.n - 1).bit_length()
        self.chars, self.tokens = self._sums(chars), self._sums(tokens)

    def _sums(self, leaves) -> np.ndarray:
        a = np.zeros(2 * self.size, np.int64)
        a[self.size:self.size + self.n] = leaves
        low = self.size
        while low > 1:
            a[low // 2:low] = a[low:2 * low].reshape(-1, 2).sum(axis=1)
            low //= 2
        return a

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def find(self, pos: int) -> tuple[int, int]:
        """The leaf that holds the character ``pos``, and its first character."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if pos - start >= self.chars[i]:
                start += int(self.chars[i])
                i += 1
        return i - self.size, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        i = self.size + leaf
        more_chars, more_tokens = chars - self.chars[i], tokens - self.tokens[i]
        while i and (more_chars or more_tokens):
            self.chars[i] += more_chars
            self.tokens[i] += more_tokens
            i //= 2

    def edit(self, count: Counter, text: str, pos: int, cut: int, put: str) -> tuple[str, int]:
        """Replaces ``cut`` characters at ``pos`` by ``put``: the new text, and how many characters were encoded."""
        pos = min(max(pos, 0), len(text))
        end = min(pos + max(cut, 0), len(text))
        new, moved = text[:pos] + put + text[end:], len(put) - (end - pos)
        leaf, start = 0, 0
        if text:
            leaf, start = self.find(min(max(pos - CONTEXT, 0), len(text) - 1))
            if start:
                leaf, start = self.find(start - 1)
        after, old, parts, at = leaf, start, [], start
        for m in count.split.finditer(new, start):
            at = m.end()
            parts.append((at - m.start(), count[m[0]]))
            while after < self.n and (old < end or old + moved < at):
                old += int(self.chars[self.size + after])
                after += 1
            if after > leaf and old >= end and old + moved == at:
                break
        if at == len(new):
            after = self.n
        room = after - leaf
        if len(parts) > room:
            rest = parts[room - 1:]
            parts[room - 1:] = [(sum(c for c, _ in rest), sum(t for _, t in rest))]
        for i, (c, t) in enumerate(parts + [(0, 0)] * (room - len(parts))):
            self.put(leaf + i, c, t)
        return new, at - start

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.size, self.size + self.n)
        return self.chars[own], self.tokens[own]


_LOADED: dict[int, Counter] = {}


def _counter(data: bytes) -> Counter:
    key = hash(data)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Counter(read_ranks(data))
    return _LOADED[key]


def _broadcast(spark: SparkSession, path: str | None):
    with open(path or tokenizer_path(RANKS), "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"the vocabulary file is larger than {MAX_RANK_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def _lists(arrays: list) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.asarray(a, np.int32) for a in arrays] or [np.zeros(0, np.int32)]))


def build_trees(docs: DataFrame, text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """``docs`` with ``text_col`` (null: empty) and the leaves ``leaf_chars``, ``leaf_tokens`` (array of int; longer names if these are taken)."""
    sent = _broadcast(docs.sparkSession, ranks_path)
    own = [free_name(docs, "leaf_chars"), free_name(docs, "leaf_tokens")]
    fields = [f if f.name != text_col else T.StructField(text_col, T.StringType()) for f in docs.schema.fields]
    schema = T.StructType([*fields, *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in own]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(sent.value)
        for b in text_chunks(batches, text_col):
            got = [count.leaves(t) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, _lists([c for c, _ in got]), _lists([t for _, t in got])], schema.names)

    filled = docs.withColumn(text_col, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    return filled.mapInArrow(run, schema)


def apply_edits(trees: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits",
                chars_col: str = "leaf_chars", tokens_col: str = "leaf_tokens", ranks_path: str | None = None) -> DataFrame:
    """Applies the edits (array of ``pos``, ``cut``, ``put``) of each row: the id, the new text and leaves (as
    :func:`build_trees` names them), ``tokens_before``, ``tokens_after`` and ``encoded_chars``."""
    sent = _broadcast(trees.sparkSession, ranks_path)
    slim = trees.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{edits_col}`").cast(EDITS).alias("edits"),
                        F.col(f"`{chars_col}`").alias("leaf_chars"), F.col(f"`{tokens_col}`").alias("leaf_tokens"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text", "leaf_chars", "leaf_tokens", "tokens_before", "tokens_after", "encoded_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(sent.value)
        for b in text_chunks(batches):
            texts, leaves, told = [], [], []
            # lists as slices of one flat array: a Python number for each leaf would cost far more than the edits
            chars, tokens = (_slices(b.column(c)) for c in ("leaf_chars", "leaf_tokens"))
            for text, edits, c, t in zip(b.column("text").to_pylist(), b.column("edits").to_pylist(), chars, tokens):
                tree, encoded = CountTree(c, t), 0
                before = tree.total
                for e in edits or []:
                    if e and None not in e.values():
                        text, n = tree.edit(count, text, e["pos"], e["cut"], e["put"])
                        encoded += n
                texts.append(text)
                leaves.append(tree.leaves())
                told.append((before, tree.total, encoded))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(texts, pa.string()), _lists([x for x, _ in leaves]), _lists([x for _, x in leaves]),
                 *[pa.array([x[i] for x in told], pa.int64()) for i in range(3)]], names)

    return slim.mapInArrow(run, f"doc_id {kind}, text string, leaf_chars array<int>, leaf_tokens array<int>, "
                                "tokens_before long, tokens_after long, encoded_chars long")


def _slices(lists: pa.ListArray) -> list[np.ndarray]:
    flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


def own_text_edits(text_col: str = "text", each: int = 1000) -> Column:
    """A column of edits that the text itself determines: one, and another for each ``each`` characters. Each cuts up to 23
    characters at a place that a hash of the text gives, and puts up to 23 from elsewhere in the text there."""
    t = f"coalesce(`{text_col}`, '')"
    h = lambda what, most: f"CAST(pmod(xxhash64({t}, i, '{what}'), {most}) AS INT)"
    n = f"length({t})"
    return F.expr(f"""transform(sequence(1, 1 + CAST({n} / {each} AS INT)), i -> named_struct(
        'pos', {h('pos', n + ' + 1')}, 'cut', {h('cut', 24)}, 'put', substring({t}, 1 + {h('from', n + ' + 1')}, {h('put', 24)})))""")


def count_after_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """Builds the trees of ``docs``, applies :func:`own_text_edits`: ``doc_id``, ``n_chars``, ``tokens_before``, ``tokens_after``, ``encoded_chars``."""
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).withColumn("edits", own_text_edits())
    done = apply_edits(build_trees(slim, ranks_path=ranks_path), ranks_path=ranks_path)
    return done.select("doc_id", F.length("text").cast("long").alias("n_chars"), "tokens_before", "tokens_after", "encoded_chars")
