"""Benchmark decontamination: BM25 index of test items, block-max WAND, overlap check.

The test items are the indexed side and every passage of the training text is
a query: windows of words, each half over the one before, wide enough that an
item of the index lies whole in one of them. An item's BM25 score is taken as
a share of the score that the item itself would get; items at or above
``threshold`` are retrieved, and count as found if both their question and
their answer overlap the passage: at least ``overlap`` of their word shingles
occur there. The answer is the last sentence of an item of several sentences,
the question what stands before; an item of one sentence is question and
answer at once. Words are runs of letters, digits and underscores, in lower case.

Document frequencies, the number of items, their mean length and the longest one are aggregates over the whole
benchmark. Items are dealt to shards of about ``shard_words`` words (a larger
single item is a shard of its own); a task builds each shard's index with these figures, so rows, scores and
passages do not depend on the shards. Indexes are broadcast one by one and the
documents are passed once: a task takes a group of texts through one index after the other.

Edge cases: null texts count as empty and empty texts have no hits; items
without words are never found; equal items are found each; repeated rows of
documents give their hits each; null ids are carried along; empty tables give
no rows; other columns are not looked at (:func:`drop_contaminated` keeps them).
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tillroll.llm._common import free_name, id_and_text, one_by_one, text_chunks
from tillroll.session import materialize

WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"(?<=[.?!])\s+")
K1, B = 1.2, 0.75
BLOCK = 16
GROUPS = 128
SHINGLE = 5
EPS = 1e-9
HIT_FIELDS = "doc_id {id}, item_id {item}, passage_start int, score double, question_overlap double, answer_overlap double"


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer of an item."""
    parts = [w for w in (WORD.findall(p.lower()) for p in SENTENCE_END.split(text or "")) if w]
    if len(parts) < 2:
        return (parts[0], parts[0]) if parts else ([], [])
    return [w for p in parts[:-1] for w in p], parts[-1]


def _shingles(ids: list[int]) -> set[tuple[int, ...]]:
    n = min(SHINGLE, len(ids))
    return {tuple(ids[i:i + n]) for i in range(len(ids) - n + 1)}


class Figures(NamedTuple):
    """Of all items: their number, mean and greatest number of words, and (for the words at hand) in how many each word is."""

    items: int
    mean: float
    longest: int
    df: dict[str, int]

    @classmethod
    def of(cls, words: list[list[str]]) -> Figures:
        sizes = [len(w) for w in words]
        return cls(len(words), sum(sizes) / max(1, len(words)), max(sizes, default=0), Counter(w for ws in words for w in set(ws)))


class ItemIndex:
    """Inverted index over items; impacts are shares of an item's own score."""

    def __init__(self, texts: list[str], threshold: float = 0.5, overlap: float = 0.8, figures: Figures | None = None):
        self.threshold, self.overlap = threshold, overlap
        split = [question_and_answer(t) for t in texts]
        words = [WORD.findall((t or "").lower()) for t in texts]
        self.term = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
        ids = lambda ws: [self.term[w] for w in ws]
        self.parts = [(_shingles(ids(q)), _shingles(ids(a))) for q, a in split]
        known = figures or Figures.of(words)
        self.window = max(2 * known.longest, 64)
        tf = [Counter(ids(w)) for w in words]
        df = {t: known.df[w] for w, t in self.term.items()}
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for i, c in enumerate(tf):
            w = {t: math.log(1 + (known.items - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1)
                 / (n + K1 * (1 - B + B * len(words[i]) / known.mean)) for t, n in c.items()}
            own = math.fsum(w.values())
            for t, x in w.items():
                postings[t].append((i, x / own))
        self.items = {t: [i for i, _ in p] for t, p in postings.items()}
        self.impact = {t: [x for _, x in p] for t, p in postings.items()}
        self.blocks = {t: [max(x[j:j + BLOCK]) for j in range(0, len(x), BLOCK)] for t, x in self.impact.items()}
        self.most = {t: max(x) for t, x in self.blocks.items()}
        # A bound for whole windows, by groups of items: the common terms, taken together, add at most ``common`` to
        # an item of the group; each other term adds at most its highest impact there.
        n_groups = max(1, min(GROUPS, len(texts)))
        group = [i * n_groups // max(1, len(texts)) for i in range(len(texts))]
        held = np.zeros(len(texts))
        self.rare = np.ones(len(self.term) + 1, bool)
        self.rare[len(self.term)] = False  # the number for words of no item
        for t in sorted(df, key=lambda t: (-df[t], t)):
            now = held.copy()
            now[self.items[t]] += self.impact[t]
            if now.max() > threshold / 1.4:
                break
            held, self.rare[t] = now, False
        self.common = np.zeros(n_groups, np.float32)
        np.maximum.at(self.common, group, held)
        self.bound = np.zeros((len(self.term) + 1, n_groups), np.float32)
        for t, x in self.impact.items():
            if self.rare[t]:
                np.maximum.at(self.bound[t], [group[i] for i in self.items[t]], x)

    def _windows(self, ids: np.ndarray) -> list[int]:
        """First words of the windows in which some group of items may reach the threshold."""
        half = self.window // 2
        n = -(-len(ids) // half)
        sums = np.zeros((n, len(self.common)))
        for lo in range(0, n, 256):
            part = ids[lo * half:(lo + 256) * half]
            at = np.flatnonzero(self.rare[part])
            total = np.zeros((len(at) + 1, len(self.common)))
            np.cumsum(self.bound[part[at]], axis=0, out=total[1:])
            cuts = np.searchsorted(at, np.arange(0, len(part) + half, half))
            sums[lo:lo + 256] = total[cuts[1:]] - total[cuts[:-1]]
        if n > 1:
            sums = sums[:-1] + sums[1:]
        return (np.flatnonzero((sums + self.common >= self.threshold - 1e-5).any(axis=1)) * half).tolist()

    def search(self, terms: set[int]) -> list[tuple[int, float]]:
        """Block-max WAND: (item, score) of all items at or above the threshold."""
        least, found = self.threshold - EPS, []
        cur = [[self.items[t][0], 0, t] for t in terms]  # item, position, term

        def move(c: list, item: int) -> bool:
            items = self.items[c[2]]
            c[1] = bisect_left(items, item, c[1])
            if c[1] < len(items):
                c[0] = items[c[1]]
                return True
            return False

        while True:
            cur.sort()
            bound, p = 0.0, -1
            for i, c in enumerate(cur):
                bound += self.most[c[2]]
                if bound >= least:
                    p = i
                    break
            if p < 0:
                return found
            pivot = cur[p][0]
            while p + 1 < len(cur) and cur[p + 1][0] == pivot:
                p += 1
            block, last = 0.0, cur[p + 1][0] if p + 1 < len(cur) else 1 << 60
            for item, pos, t in cur[:p + 1]:
                at = bisect_left(self.items[t], pivot, pos)
                if at < len(self.items[t]):
                    block += self.blocks[t][at // BLOCK]
                    end = min((at // BLOCK + 1) * BLOCK, len(self.items[t])) - 1
                    last = min(last, self.items[t][end] + 1)
            if block < least:
                target = max(last, pivot + 1)  # no item of these blocks can reach the threshold
            elif cur[0][0] == pivot:
                score = math.fsum(self.impact[t][pos] for item, pos, t in cur[:p + 1])
                if score >= least:
                    found.append((pivot, score))
                target = pivot + 1
            else:
                target = pivot
            cur = [c for i, c in enumerate(cur) if i > p or move(c, target)]

    def hits(self, text: str) -> list[tuple[int, int, float, float, float]]:
        """(item, first word of the passage, score, question overlap, answer overlap), the best passage for each item."""
        none = len(self.term)
        get = self.term.get
        ids = np.array([get(w, none) for w in WORD.findall(text.lower())], np.int64)
        if not len(ids):
            return []
        best: dict[int, tuple] = {}
        for s in self._windows(ids):
            part = ids[s:s + self.window].tolist()
            got = self.search(set(part) - {none})
            if got:
                seen: dict[int, set] = {}
                for item, score in got:
                    q, a = (self._share(x, part, seen) for x in self.parts[item])
                    if q >= self.overlap and a >= self.overlap and (-q - a, s) < best.get(item, (0, 0))[:2]:
                        best[item] = (-q - a, s, score, q, a)
        return [(i, *b[1:]) for i, b in sorted(best.items())]

    @staticmethod
    def _share(own: set, part: list[int], seen: dict[int, set]) -> float:
        if not own:
            return 0.0
        n = len(next(iter(own)))
        if n not in seen:
            seen[n] = {tuple(part[i:i + n]) for i in range(len(part) - n + 1)}
        return len(own & seen[n]) / len(own)


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, shard_words: int, threshold: float, overlap: float) -> list:
    """Broadcasts of (index, ids of its items), one a shard."""
    item_type = benchmark.schema[item_col].dataType.simpleString()
    items = benchmark.select(benchmark[item_col].alias("item_id"), F.coalesce(benchmark[text_col].cast("string"), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches):
            words = [WORD.findall(t.lower()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), b.column("text"), pa.array([len(w) for w in words], pa.int32()),
                                              pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))], ["item_id", "text", "n", "words"])

    parsed = materialize(items.mapInArrow(cut, f"item_id {item_type}, text string, n int, words array<string>"), "items")
    row = parsed.agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).first()
    n_items, n_words, longest = row[0], row[1] or 0, row[2] or 0
    if not n_items:
        return []
    shards = max(1, math.ceil(n_words / shard_words))
    parsed = parsed.withColumn("shard", F.pmod(F.xxhash64("text", "item_id"), F.lit(shards)).cast("int"))
    each = parsed.select("shard", F.explode("words").alias("word"))
    # a shard's words with the number of items that have them, in all shards
    known = each.distinct().join(each.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "word").select(
        F.col("shard").alias("part"), "word", "df")

    def build(own: pa.Table, words: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table({"shard": pa.array([], pa.int32()), "index": pa.array([], pa.binary())})
        rows = sorted(zip(own.column("item_id").to_pylist(), own.column("text").to_pylist()), key=lambda r: (r[0] is not None, r[0], r[1]))
        df = dict(zip(words.column("word").to_pylist(), words.column("df").to_pylist()))
        index = ItemIndex([t for _, t in rows], threshold, overlap, Figures(n_items, n_words / n_items, longest, df))
        return pa.table({"shard": own.column("shard").slice(0, 1), "index": [pickle.dumps((index, [i for i, _ in rows]))]})

    built = parsed.select("shard", "item_id", "text").groupBy("shard").cogroup(known.groupBy("part")).applyInArrow(build, "shard int, index binary")
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast(pickle.loads(r["index"])) for r in materialize(built, "item-indexes").orderBy("shard").toLocalIterator()]


#: Characters that a task takes through one index after the other.
GROUP_CHARS = 4_000_000


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text: str = "text", threshold: float = 0.5,
                       overlap: float = 0.8, shard_words: int = 200_000) -> DataFrame:
    """One row per document and item found in it: ``doc_id``, ``item_id``, ``passage_start`` (a word's
    number), ``score`` (share of the item's own BM25 score), ``question_overlap``, ``answer_overlap``."""
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    slim = id_and_text(docs, id_col, text_col)
    schema = HIT_FIELDS.format(id=slim.schema["doc_id"].dataType.simpleString(), item=benchmark.schema[item_col].dataType.simpleString())
    sent = _indexes(benchmark, item_col, item_text, shard_words, threshold, overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, chars=GROUP_CHARS):
            texts = b.column("text").to_pylist()
            for index, names in one_by_one(sent):
                found = [(row, *h) for row, t in enumerate(texts) for h in index.hits(t)]
                if found:
                    row, item, start, *shares = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(pa.array(row)), pa.array([names[i] for i in item], item_type),
                         pa.array(start, pa.int32()), *[pa.array(x, pa.float64()) for x in shares]],
                        ["doc_id", "item_id", "passage_start", "score", "question_overlap", "answer_overlap"])

    return slim.mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text: str = "text", threshold: float = 0.5, overlap: float = 0.8,
                      shard_words: int = 200_000) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with their own columns."""
    flag = free_name(docs, "is_clean")
    clean = _is_clean(_indexes(benchmark, item_col, item_text, shard_words, threshold, overlap))
    marked = docs.withColumn(flag, clean(F.coalesce(docs[text_col].cast("string"), F.lit(""))))
    return marked.where(F.col(f"`{flag}`")).select(*[F.col(f"`{c}`") for c in docs.columns])


def _is_clean(sent: list):
    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            texts = column.to_pylist()
            ok = [True] * len(texts)
            for index, _ in one_by_one(sent):
                ok = [x and not index.hits(t) for x, t in zip(ok, texts)]
            yield pa.array(ok, pa.bool_())

    return clean
