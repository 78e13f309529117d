"""LM scoring with a log-frequency Bloom filter of n-gram counts.

Counting: each task counts the words and word pairs of its training texts as
64-bit hashes; one shuffle by the high bits of the hash brings the counts of a
segment together, and the task that has it makes the segment's part of the
filter. A key of quantised count q is in the filter q times, as (key, 1) to
(key, q); probing level after level until one fails gives q back. The filter
never misses a key; a probe of an absent one succeeds in about 2^-PROBES of the cases.

Scoring: words and pairs are probed in the broadcast filter. With h the word
before w, p(w | h) = MIX * c(h w) / c(h) + (1 - MIX) * p(w), where p(w) is
(c(w) - D) / N by absolute discounting and unknown words share what the
discounts leave; a pair counts only if both its words are known (their
counts bound the pair's). Quantised counts are the lowest of their class
above the line and the highest below it, so no context gives more than 1 in all.

Broadcast bound: segments are dealt to shards of at most ``shard_bytes``, of words (filter and exact counts) and of
pairs (filter); each is broadcast by itself, and the driver holds one at a time. The texts are passed
once, whatever the number of shards: a task takes them in groups of ``GROUP_CHARS``, cuts a group into words once
and then goes through the shards, of which it holds one at a time.

Exact counts: ``base_score`` uses the exact word counts, which lie beside the
filter, by the 63-bit hash of the word.

Edge cases: a null text counts as empty, an empty text is its end token alone;
a null id is learned from and not held out; repeated rows are learned from
as often as they occur and give one row each; an empty table gives no rows; without
training texts N and V are zero and every token is unknown with probability 1; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm._common import id_and_text, one_by_one, text_chunks
from tillroll.session import materialize

MIX = 0.4
PROBES = 7
BITS_PER_KEY = 10.1  # PROBES / ln 2
#: Keys that a segment has room for, about; and count rows that a task holds before it passes them on.
SEGMENT_KEYS, HELD_KEYS = 1 << 16, 1_500_000
SHARD_BYTES = 48 << 20
#: Characters that a task scores together; with several shards, each is loaded once for so many.
GROUP_CHARS = 4_000_000
#: Class q of the quantised counts is [EDGES[q - 1], EDGES[q]): one by one, then by steps of a half.
EDGES = [1]
while EDGES[-1] < 1 << 60:
    EDGES.append(max(EDGES[-1] + 1, EDGES[-1] * 3 // 2))
EDGES = np.array(EDGES, np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


END, START = (int(x) & ~1 for x in _mix(np.array([0x1E4D, 0x57A7], np.uint64)))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_WEIGHTS = np.zeros(0, np.uint64)


def _weights(n: int) -> np.ndarray:
    """A random number for each place in a word, the same in every process."""
    global _WEIGHTS
    if n > len(_WEIGHTS):
        _WEIGHTS = _mix(np.arange(1, max(64, 2 * n) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _WEIGHTS[:n]


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, each closed by END; the hash before each; the number of tokens of each text.

    Words are parted by the six ASCII spaces, A-Z is taken as a-z. A word's hash is the
    sum of its bytes, each times the random number of its place (multilinear hashing), mixed; its lowest bit is 0."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*parts, b""]).lower(), np.uint8)  # a space ends every text
    word = np.concatenate([[False], ~_SPACE[data]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, size = edge[::2], edge[1::2] - edge[::2]
    at = np.flatnonzero(word[1:])
    before = np.cumsum(size) - size
    place = np.arange(len(at)) - np.repeat(before, size)
    sums = (data[at].astype(np.uint64) + np.uint64(1)) * _weights(int(size.max(initial=0)))[place]
    hashes = _mix(np.add.reduceat(sums, before)) & np.uint64(0xFFFFFFFFFFFFFFFE) if len(size) else np.zeros(0, np.uint64)
    first = np.cumsum([0, *(len(p) + 1 for p in parts)])
    doc = np.searchsorted(first, start, "right") - 1
    sizes = np.bincount(doc, minlength=len(parts)) + 1
    cur = np.full(len(start) + len(parts), END, np.uint64)
    cur[np.arange(len(start)) + doc] = hashes
    left = np.empty_like(cur)
    left[1:] = cur[:-1]
    left[np.cumsum(sizes) - sizes] = START
    return cur, left, sizes


def group_tokens(texts: list[str], chars: int = 1_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`tokens` of many texts, about ``chars`` characters at a time: what cutting takes besides is several times the text."""
    parts, held, n = [], [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n > chars:
            parts.append(tokens(held))
            held, n = [], 0
    parts.append(tokens(held))
    return tuple(np.concatenate(x) for x in zip(*parts))


def pair_keys(before: np.ndarray, cur: np.ndarray) -> np.ndarray:
    return _mix(before * np.uint64(0x9E3779B97F4A7C15) + _mix(cur)) | np.uint64(1)


def _probes(keys: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Start and stride of a key's probes at a level."""
    g = _mix(keys + np.uint64(0xD1342543DE82EF95) * np.asarray(level, np.uint64))
    return g & np.uint64(0xFFFFFFFF), (g >> np.uint64(32)) | np.uint64(1)


def _position(low: np.ndarray, high: np.ndarray, n_bits: np.ndarray, j: int) -> np.ndarray:
    return ((low + np.uint64(j) * high & np.uint64(0xFFFFFFFF)) * n_bits) >> np.uint64(32)


def filter_bits(keys: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    """Number of bits and bits of a segment that holds the keys with their quantised counts."""
    q = np.searchsorted(EDGES, counts, "right")
    items = np.repeat(keys, q)
    level = np.arange(1, len(items) + 1) - np.repeat(np.cumsum(q) - q, q)
    n = max(64, math.ceil(len(items) * BITS_PER_KEY))
    bits = np.zeros(n, bool)
    low, high = _probes(items, level)
    for j in range(PROBES):
        bits[_position(low, high, np.uint64(n), j)] = True
    return n, np.packbits(bits, bitorder="little").tobytes()


class Filter:
    """Segments ``first`` and on, of 2^bits segments in all."""

    def __init__(self, bits: int, first: int, n_bits: np.ndarray, sizes: np.ndarray, data: bytes):
        """``n_bits`` and ``sizes``: bits, and bytes in ``data``, of each segment (0 where it has no keys)."""
        self.bits, self.first = bits, first
        self.n_bits = np.asarray(n_bits, np.uint64)
        sizes = np.asarray(sizes, np.uint64)
        self.offset = (np.cumsum(sizes) - sizes).astype(np.uint64)
        self.data = np.frombuffer(data, np.uint8)

    def classes(self, keys: np.ndarray) -> np.ndarray:
        """The quantised count of each key, 0 for keys that are not there."""
        got = np.zeros(len(keys), np.int64)
        seg = _segment(keys, self.bits) - self.first
        n, at = self.n_bits[seg], self.offset[seg]
        here = np.flatnonzero(n)
        level = 0
        while len(here):
            level += 1
            low, high = _probes(keys[here], level)
            bits, start = n[here], at[here]
            for j in range(PROBES):
                p = _position(low, high, bits, j)
                hit = (self.data[start + (p >> np.uint64(3))] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                if not hit.all():
                    here, low, high, bits, start = (x[hit] for x in (here, low, high, bits, start))
            got[here] = level
        return got


def _segment(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys and counts of words and pairs, summed up within the task as far as it can hold them."""
    held, n = [], 0

    def merged():
        keys = np.concatenate([k for k, _ in held])
        counts = np.concatenate([c for _, c in held])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(counts[order], first)

    def out(keys, counts):
        for i in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[i:i + 100_000].view(np.int64)), pa.array(counts[i:i + 100_000])], ["key", "c"])

    for b in text_chunks(batches):
        cur, before, _ = tokens(b.column("text").to_pylist())
        for part in (cur, pair_keys(before, cur)):
            keys, c = np.unique(part, return_counts=True)
            held.append((keys, c.astype(np.int64)))
            n += len(keys)
        if n > HELD_KEYS:
            held = [merged()]
            n = len(held[0][0])
            if n > HELD_KEYS // 2:
                yield from out(*held.pop())
                n = 0
    if held:
        yield from out(*merged())


SEGMENT = ("seg long, word_keys binary, word_counts binary, word_bits binary, word_n long, pair_bits binary, pair_n long, "
           "tokens long, words long, once long, twice long")


def _build_rows(bits: int):
    def build(keys: np.ndarray, counts: np.ndarray) -> list:
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        word = (keys & np.uint64(1)) == 0
        w, c = keys[word], counts[word]
        wn, wbits = filter_bits(w, c)
        pn, pbits = filter_bits(keys[~word], counts[~word])
        return [int(_segment(keys[:1], bits)[0]), w.tobytes(), c.tobytes(), wbits, wn, pbits, pn,
                int(c.sum()), len(w), int((c == 1).sum()), int((c == 2).sum())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        names = [f.split()[0] for f in SEGMENT.split(", ")]

        def out(k, c):
            return pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, build(k, c))})

        for b in batches:
            keys.append(b.column("key").to_numpy().view(np.uint64))
            counts.append(b.column("c").to_numpy())
            seg = _segment(keys[-1], bits)
            if seg[-1] != _segment(keys[0][:1], bits)[0]:  # segments end in this batch
                k, c = np.concatenate(keys), np.concatenate(counts)
                cuts = np.flatnonzero(np.diff(_segment(k, bits))) + 1
                for i, j in zip([0, *cuts[:-1]], cuts):
                    yield out(k[i:j], c[i:j])
                keys, counts = [k[cuts[-1]:]], [c[cuts[-1]:]]
        if keys:
            yield out(np.concatenate(keys), np.concatenate(counts))

    return run


class Words:
    """The words of the segments ``first`` to ``last``: their filter and exact counts."""

    def __init__(self, bits: int, first: int, last: int, counts: Filter, keys: np.ndarray, exact: np.ndarray):
        self.bits, self.first, self.last, self.filter, self.keys, self.exact = bits, first, last, counts, keys, exact

    def look_up(self, word: np.ndarray, classes: np.ndarray, counts: np.ndarray) -> None:
        """Sets quantised and exact counts of the words that are in these segments."""
        seg = _segment(word, self.bits)
        own = np.flatnonzero((seg >= self.first) & (seg < self.last))
        classes[own] = self.filter.classes(word[own])
        if len(self.keys):
            i = np.minimum(np.searchsorted(self.keys, word[own]), len(self.keys) - 1)
            counts[own] = np.where(self.keys[i] == word[own], self.exact[i], 0)


class Pairs:
    """The pairs of the segments ``first`` to ``last``."""

    def __init__(self, bits: int, first: int, last: int, counts: Filter):
        self.bits, self.first, self.last, self.filter = bits, first, last, counts

    def look_up(self, pair: np.ndarray, classes: np.ndarray) -> None:
        seg = _segment(pair, self.bits)
        own = np.flatnonzero((seg >= self.first) & (seg < self.last))
        classes[own] = self.filter.classes(pair[own])


class Totals:
    """Tokens and distinct words learned from, the discount, the weight of pairs."""

    def __init__(self, tokens: int, words: int, discount: float, mix: float):
        self.tokens, self.words, self.discount, self.mix = tokens, words, discount, mix


def score_texts(texts: list[str], totals: Totals, words: Iterator[Words], pairs: Iterator[Pairs]) -> list[np.ndarray]:
    """For each text: tokens, known tokens, base score, score. The shards are taken one after the other."""
    cur, before, sizes = group_tokens(texts)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    add = lambda x: np.bincount(doc, weights=x, minlength=len(sizes))
    word, at = np.unique(cur, return_inverse=True)
    q, c = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
    for shard in words:
        shard.look_up(word, q, c)
    known, base = add((c > 0)[at].astype(float)), add(np.log10((c + 1) / (totals.tokens + totals.words + 1))[at])
    if not totals.tokens:
        return [sizes, known, base, np.zeros(len(sizes))]
    # the model, by probes
    low = np.concatenate([[0], EDGES])
    single = np.where(q > 0, low[q] - totals.discount, totals.discount * totals.words) / totals.tokens
    left = np.empty_like(at)
    left[1:] = at[:-1]
    left[np.cumsum(sizes) - sizes] = np.searchsorted(word, END)  # a text's start is as frequent as its end
    both = np.flatnonzero((q[at] > 0) & (q[left] > 0))
    pair, of = np.unique(pair_keys(before[both], cur[both]), return_inverse=True)
    found = np.zeros(len(pair), np.int64)
    for shard in pairs:
        shard.look_up(pair, found)
    w, h = at[both], left[both]
    together = np.zeros(len(cur))
    together[both] = low[np.minimum(found[of], np.minimum(q[w], q[h]))] / (EDGES[q[h]] - 1)
    return [sizes, known, base, add(np.log10(totals.mix * together + (1 - totals.mix) * single[at]))]


def train(texts: DataFrame, shard_bytes: int = SHARD_BYTES, mix: float = MIX) -> tuple[Totals, Iterator[Words], Iterator[Pairs]]:
    """Counts the ``text`` column and gives the totals and the shards, which are fetched one by one."""
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    # about five characters a word, and a pair for each word
    bits = max(4, math.ceil(math.log2(max(1, chars / 3 / SEGMENT_KEYS))))
    # (the map-side sums leave a hot key one row a task)
    segments = materialize(
        texts.mapInArrow(_count_rows, "key long, c long")
        .repartition(F.shiftrightunsigned("key", 64 - bits)).sortWithinPartitions("key")
        .mapInArrow(_build_rows(bits), SEGMENT), "ngram-segments")
    size = lambda *c: sum((F.sum(F.length(x)) for x in c[1:]), F.sum(F.length(c[0])))
    s = segments.agg(F.sum("tokens"), F.sum("words"), F.sum("once"), F.sum("twice"), size("word_keys", "word_counts", "word_bits"), size("pair_bits")).first()
    total, distinct, once, twice, word_bytes, pair_bytes = (x or 0 for x in s)
    n = 1 << bits

    def fetch(first: int, last: int, *columns: str) -> pa.Table:
        own = segments.where(F.col("seg").between(first, last - 1))
        return own.select("seg", *columns).orderBy("seg").toArrow()

    def joined(column: pa.ChunkedArray) -> bytes:
        """The bytes of all rows, one after the other."""
        return b"".join(x.as_buffer() for x in column)

    def counts(what: str, first: int, last: int) -> Filter:
        rows = fetch(first, last, f"{what}_n", f"{what}_bits")
        n, size = np.zeros(last - first, np.uint64), np.zeros(last - first, np.uint64)
        at = rows.column("seg").to_numpy() - first
        n[at] = rows.column(f"{what}_n").to_numpy()
        size[at] = pc.binary_length(rows.column(f"{what}_bits")).to_numpy()
        return Filter(bits, first, n, size, joined(rows.column(f"{what}_bits")))

    def ranges(size: int) -> list[tuple[int, int]]:
        shards = min(n, max(1, math.ceil(size / shard_bytes)))
        return [(n * i // shards, n * (i + 1) // shards) for i in range(shards)]

    def words() -> Iterator[Words]:
        for first, last in ranges(word_bytes):
            rows = fetch(first, last, "word_keys", "word_counts")
            keys = np.frombuffer(joined(rows.column("word_keys")), np.uint64)
            exact = np.frombuffer(joined(rows.column("word_counts")), np.int64)
            if len(exact) and exact.max() < 1 << 32:
                exact = exact.astype(np.uint32)
            del rows
            yield Words(bits, first, last, counts("word", first, last), keys, exact)

    def pairs() -> Iterator[Pairs]:
        for first, last in ranges(pair_bytes):
            yield Pairs(bits, first, last, counts("pair", first, last))

    discount = once / (once + 2 * twice) if once and twice else 0.5
    return Totals(total, distinct, discount, mix), words(), pairs()


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2,
                    shard_bytes: int = SHARD_BYTES, mix: float = MIX, group_chars: int = GROUP_CHARS) -> DataFrame:
    """One row per row of ``docs``, by a model of the rows whose crc32(id as text) mod ``folds`` is not ``held_fold``:
    ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    context, slim = docs.sparkSession.sparkContext, id_and_text(docs, id_col, text_col)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_fold, F.lit(False))
    kind = slim.schema["doc_id"].dataType.simpleString()
    totals, words, pairs = train(slim.where(~held).select("text"), shard_bytes, mix)
    # a shard is on its way before the next one is fetched
    sent_words, sent_pairs = [context.broadcast(x) for x in words], [context.broadcast(x) for x in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, chars=group_chars):
            n, known, base, score = score_texts(b.column("text").to_pylist(), totals, one_by_one(sent_words), one_by_one(sent_pairs))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    scored = slim.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")
