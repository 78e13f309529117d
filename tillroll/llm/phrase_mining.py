"""Phrase collocation mining: counts of frequent phrases by broadcast tries, scored by their weakest cut.

Texts are cut into chunks, each with a dictionary of its words in the order of a
hash. A range of the hash is a bucket: the slices that all dictionaries have there
meet in one task, which counts their words and numbers the frequent ones
(buckets hold about ``BUCKET_WORDS`` entries, so their number grows with the
corpus). From then on a text is an array of numbers with breaks (a piece's end
or a rarer word, which no frequent phrase holds).

Level by level, the frequent phrases of ``k - 1`` words become double-array
tries. ``numpy`` moves all positions of a chunk through them at once, a digit of
a word's number at a time. Where a position and the next one both end in an
accepting state, the ``k`` words from there are an Apriori-safe candidate, named
by these two states: a candidate that no text holds never exists. Tasks count
their candidates with ``bincount``, an aggregate sums the counts, and those that
reach ``min_count`` are the next level.

A trie holds ``TRIE_CELLS`` cells at most (phrases are dealt to as many tries as
that takes, by a hash of all their words), which bounds each broadcast. A task
moves each position in one trie only and holds one trie at a time, so a pass
over the texts per level is enough however many tries there are. The words
themselves are never broadcast by this module.

Edge cases: a null text counts as empty, a null language as ``und``; a text of
any length is one chunk at least, never cut; repeated rows are counted each;
ties of the score go to the higher count, then the phrase in byte order; an
empty table, or one without frequent phrases, gives no rows; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm._common import pack, unpack
from tillroll.session import materialize

#: About so many bytes of text share a dictionary.
CHUNK_BYTES = 2_000_000
#: Entries of dictionaries that a task counts together.
BUCKET_WORDS = 500_000
#: Candidates that a task holds; a bucket with more gives partial counts, which an aggregate then sums.
HELD = 4_000_000
#: A bucket gets about so many candidates, and there are no more buckets than that.
BUCKET_PAIRS, MOST_BUCKETS = 4_000_000, 4096
#: Cells of a trie (8 bytes each).
TRIE_CELLS = 4_000_000
#: A word's number is read in digits of this base.
RADIX = 1024

_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_ONE_END = bytes.maketrans(_PIECE_ENDS, b"." * len(_PIECE_ENDS))


def tokens(texts: list[bytes]) -> list[bytes]:
    """Words of the texts in lower case (A-Z alone), with ``.`` at each end of a piece."""
    # no word holds a dot; bytes.split cuts at spaces and tabs, as all its other characters are piece ends
    return b" . ".join(t.lower().translate(_ONE_END).replace(b".", b" . ") for t in texts).split()


def _chunk(lang: str, texts: list[bytes]) -> tuple | None:
    """Language, number of words, dictionary (a line each, in the order of their hash), its counts and the chunk's text as numbers
    of its words (from 1; 0: end of a piece)."""
    coded = pa.array([*tokens(texts), b"."], pa.binary()).dictionary_encode()
    words = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy()
    counts = np.bincount(codes, minlength=len(words))
    dot = words.index(b".")
    order = np.argsort(_hashes(words), kind="stable")
    order = order[order != dot]
    if not len(order):
        return None
    place = np.zeros(len(words), np.int64)
    place[order] = np.arange(1, len(order) + 1)
    return lang, int(counts[order].sum()), b"\n".join(words[i] for i in order), pack(counts[order]), pack(place[codes])


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.int64, len(words))


def _chunks(docs: DataFrame, text_col: str, lang_col: str, chunk_bytes: int) -> DataFrame:
    slim = docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("text"),
                       F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def close(lang: str) -> Iterator[pa.RecordBatch]:
            made = _chunk(lang, held.pop(lang))
            sizes.pop(lang)
            if made:
                kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(made, kinds)], ["lang", "n", "words", "counts", "codes"])

        for b in batches:
            for text, lang in zip(b.column("text"), b.column("lang").to_pylist()):
                text = text.as_py()
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text) + 3
                if sizes[lang] >= chunk_bytes:
                    yield from close(lang)
        for lang in list(held):
            yield from close(lang)

    made = slim.mapInArrow(run, "lang string, n long, words binary, counts binary, codes binary")
    return materialize(made.withColumn("chunk", F.monotonically_increasing_id()), "token-chunks")


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written, with a dense ``sid`` from 0. The driver sees the number of rows of each partition."""
    low = (1 << 33) - 1
    kept = materialize(rows.withColumn("at", F.monotonically_increasing_id()), name)
    sizes = sorted(kept.groupBy(F.shiftright("at", 33).alias("p")).count().collect())
    starts = np.concatenate([[0], np.cumsum([r["count"] for r in sizes], dtype=np.int64)])
    first = kept.sparkSession.createDataFrame([(r["p"], int(s)) for r, s in zip(sizes, starts)], "p long, first long")
    return kept.join(F.broadcast(first), F.shiftright("at", 33) == F.col("p")).withColumn(
        "sid", (F.col("first") + F.col("at").bitwiseAND(F.lit(low))).cast("int")).drop("at", "p", "first")


def _counted(chunks: DataFrame, min_count: int, bucket_words: int) -> tuple[DataFrame, DataFrame]:
    """The words in at least ``min_count`` places (``sid`` from 0, ``lang``, ``phrase``, ``a``), and for each chunk and bucket the
    ``sid`` of the chunk's words there and 1 (0: rarer), packed, in the order of its dictionary, beginning at word ``start``."""
    n = chunks.agg(F.sum("n")).first()[0] or 0  # at least as many as entries
    buckets = max(1, -(-n // bucket_words))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, lang, words, counts in zip(*(b.column(c).to_pylist() for c in ("chunk", "lang", "words", "counts"))):
                each = words.split(b"\n")
                cuts = np.searchsorted(_hashes(each) * buckets >> 32, np.arange(buckets + 1))
                ends = np.cumsum([0, *(len(w) + 1 for w in each)])
                counts, some = unpack(counts), np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([
                    pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array([lang] * len(some)), pa.array(cuts[some], pa.int32()),
                    pa.array([words[ends[cuts[i]]:ends[cuts[i + 1]] - 1] for i in some], pa.binary()),
                    pa.array([pack(counts[cuts[i]:cuts[i + 1]]) for i in some], pa.binary()),
                ], ["bucket", "chunk", "lang", "start", "words", "counts"])

    def count(t: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("bucket", "chunk", "start", "ids", "lang", "words", "counts")}
        numbered = 0  # the words of the bucket's languages, one after the other

        def put(*row) -> None:
            for own, value in zip(out.values(), row):
                own.append(value)

        for lang in t.column("lang").unique():
            own = t.filter(pc.equal(t.column("lang"), lang))
            counts = [unpack(c) for c in own.column("counts").to_pylist()]
            coded = pa.array(b"\n".join(own.column("words").to_pylist()).split(b"\n"), pa.binary()).dictionary_encode()
            codes = coded.indices.to_numpy()
            places = np.bincount(codes, weights=np.concatenate(counts), minlength=len(coded.dictionary))
            frequent = np.flatnonzero(places >= min_count)
            sid = np.full(len(places), -1, np.int64)
            sid[frequent] = numbered + np.arange(len(frequent))
            ends = np.cumsum([len(c) for c in counts])
            bucket = own.column("bucket")[0].as_py()
            for chunk, start, ids in zip(own.column("chunk").to_pylist(), own.column("start").to_pylist(), np.split(sid[codes], ends[:-1])):
                if (ids >= 0).any():
                    put(bucket, chunk, start, pack(ids + 1), None, None, None)
            names = [w.decode("utf-8", "replace") for w in coded.dictionary.take(pa.array(frequent)).to_pylist()]
            put(bucket, None, numbered, None, lang.as_py(), names, places[frequent].astype(np.int64))
            numbered += len(frequent)
        return pa.table(out, pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("start", pa.int32()), ("ids", pa.binary()), ("lang", pa.string()),
                                        ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]))

    dealt = chunks.select("chunk", "lang", "words", "counts").mapInArrow(
        deal, "bucket int, chunk long, lang string, start int, words binary, counts binary")
    counted = materialize(dealt.groupBy("bucket").applyInArrow(
        count, "bucket int, chunk long, start int, ids binary, lang string, words array<string>, counts array<long>"), "counted-words")
    # a task numbers its bucket's words from 0, over its languages one after the other
    names = counted.where("chunk IS NULL")
    sizes = {r["bucket"]: r["n"] for r in names.groupBy("bucket").agg(F.sum(F.size("words")).alias("n")).collect()}
    first = dict(zip(sorted(sizes), np.concatenate([[0], np.cumsum([sizes[b] for b in sorted(sizes)])]).tolist()))
    first = chunks.sparkSession.createDataFrame(list(first.items()), "bucket int, first int")
    words = names.join(F.broadcast(first), "bucket").select(
        "lang", (F.col("first") + F.col("start")).alias("low"), F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select(
        (F.col("low") + F.col("at")).alias("sid"), "lang", F.col("w.words").alias("phrase"), F.col("w.counts").alias("a"))
    parts = counted.where("chunk IS NOT NULL").join(F.broadcast(first), "bucket").select("chunk", "start", "first", "ids")
    return words, parts


def _numbers(chunks: DataFrame, parts: DataFrame) -> DataFrame:
    """Each chunk's text in the numbers of the frequent words (-1: a break; single words between breaks are left out)."""
    found = parts.groupBy("chunk").agg(F.collect_list(F.struct("start", "first", "ids")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for codes, slices in zip(b.column("codes"), b.column("found")):
                codes = unpack(codes.as_py())
                known = np.full(int(codes.max()) + 1, -1, np.int64)
                for start, first, ids in zip(*(slices.values.field(c).to_pylist() for c in ("start", "first", "ids"))):
                    own = unpack(ids)
                    known[start + 1:start + 1 + len(own)] = np.where(own > 0, own - 1 + first, -1)
                ids = known[codes]
                # breaks in a row become one, and a word between two breaks starts no pair
                before, after = np.append(-1, ids[:-1]), np.append(ids[1:], -1)
                ids = np.where((before < 0) & (after < 0), -1, ids)
                ids = np.append(ids[(ids >= 0) | (np.append(-1, ids[:-1]) >= 0)], -1)
                yield pa.RecordBatch.from_arrays([pa.array([pack(ids + 1)], pa.binary()), pa.array([len(ids)])], ["ids", "n"])

    joined = chunks.select("chunk", "codes").join(found, "chunk").select("codes", "found")
    return materialize(joined.mapInArrow(run, "ids binary, n long"), "phrase-numbers")


class Trie:
    """A double-array trie over rows of numbers (all of one length): the cell of a child is
    ``base[cell] + digit``, and belongs to its parent if ``check`` there names it. A leaf's ``base`` is its value."""

    def __init__(self, base: np.ndarray, check: np.ndarray, digits: int):
        self.base, self.check, self.digits = base, check, digits

    @classmethod
    def build(cls, rows: np.ndarray, values: np.ndarray, digits: int) -> Trie:
        """``rows`` are distinct."""
        letters = np.stack([rows // RADIX ** d % RADIX for d in reversed(range(digits))], axis=2).reshape(len(rows), -1)
        order = np.lexsort(letters.T[::-1])
        letters, values = letters[order], values[order]
        size = 2 * RADIX + 2 * letters.size
        used, base, check = np.zeros(size, bool), np.zeros(size, np.int32), np.full(size, -1, np.int32)
        used[0] = True
        at = np.zeros(len(rows), np.int64)  # the cell of each row's prefix
        low = 1
        for step in range(letters.shape[1]):
            key = at * RADIX + letters[:, step]
            new, of = np.unique(key, return_inverse=True)
            parent, label = new // RADIX, new % RADIX
            cells = np.empty(len(new), np.int64)
            _, first, count = np.unique(parent, return_index=True, return_counts=True)
            for i in np.argsort(-count, kind="stable"):
                if count[i] == 1:
                    break
                own = slice(first[i], first[i] + count[i])
                at_base, low = cls._room(used, label[own], low)
                while at_base + RADIX >= len(used):
                    used, base = np.append(used, np.zeros(size, bool)), np.append(base, np.zeros(size, np.int32))
                    check = np.append(check, np.full(size, -1, np.int32))
                cells[own] = at_base + label[own]
                used[cells[own]] = True
                base[parent[first[i]]] = at_base
            single = first[count == 1]
            # an only child fits into any free cell
            while (free := np.flatnonzero(~used[RADIX:]) + RADIX).size < len(single) + RADIX:
                used, base = np.append(used, np.zeros(size, bool)), np.append(base, np.zeros(size, np.int32))
                check = np.append(check, np.full(size, -1, np.int32))
            cells[single] = free[:len(single)]
            used[cells[single]] = True
            base[parent[single]] = cells[single] - label[single]
            check[cells] = parent
            at = cells[of]
        base[at] = values
        # a base is no further than its children, so any digit can be read behind any cell
        end = int(np.flatnonzero(used)[-1]) + 1
        return cls(np.append(base[:end], np.zeros(RADIX, np.int32)), np.append(check[:end], np.full(RADIX, -1, np.int32)), digits)

    @staticmethod
    def _room(used: np.ndarray, labels: np.ndarray, low: int) -> tuple[int, int]:
        """The first base whose cells for all ``labels`` are free, and from where the next search starts."""
        at, window = low, 1024
        while True:
            free = np.flatnonzero(~used[at:at + window]) + at
            bases = free - labels[0]
            bases = bases[(bases >= 0) & (bases + labels[-1] < len(used))]
            fits = bases[~used[bases[:, None] + labels].any(axis=1)] if len(bases) else bases
            if len(fits):
                # an area that is nearly full is not looked at again
                return int(fits[0]), at if len(free) > window // 16 else at + window // 2
            if at + window >= len(used):
                return max(len(used), at), low
            at += window

    def accepted(self, ids: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the positions ``starts`` those whose next ``length`` numbers are a row, and the row's values."""
        cell = np.zeros(len(starts), np.int64)
        for step in range(length):
            word = ids[starts + step]
            for d in reversed(range(self.digits)):
                to = self.base[cell] + word // RADIX ** d % RADIX
                ok = self.check[to] == cell
                starts, cell, word = starts[ok], to[ok].astype(np.int64), word[ok]
        return starts, self.base[cell]


def _digits(n_words: int) -> int:
    digits = 1
    while RADIX ** digits < n_words:
        digits += 1
    return digits


def _dealt(ids: np.ndarray, starts: np.ndarray, length: int, tries: int) -> np.ndarray:
    """The trie that may hold the phrase at each start."""
    h = np.zeros(len(starts), np.uint64)
    for step in range(length):
        h = (h ^ ids[starts + step].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(tries)).astype(np.int64)


def _tries(phrases: DataFrame, length: int, n_words: int, cells: int) -> list:
    """Broadcasts of the tries of all phrases of ``length`` words; tasks build them, the driver passes on one at a time."""
    digits = _digits(n_words)
    n = -(-phrases.count() * length * digits // cells)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column("ids").flatten().to_numpy().astype(np.int32)
            shard = _dealt(rows, np.arange(b.num_rows) * length, length, n)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), b.column("sid"), b.column("ids")], ["shard", "sid", "ids"])

    def build(t: pa.Table) -> pa.Table:
        rows = t.column("ids").combine_chunks().flatten().to_numpy().reshape(-1, length).astype(np.int64)
        trie = Trie.build(rows, t.column("sid").to_numpy(), digits)
        return pa.table({"shard": t.column("shard").slice(0, 1), "base": [trie.base.tobytes()], "check": [trie.check.tobytes()]},
                        pa.schema([("shard", pa.int32()), ("base", pa.binary()), ("check", pa.binary())]))

    dealt = phrases.select("sid", "ids").mapInArrow(deal, "shard int, sid int, ids array<int>")
    built = materialize(dealt.groupBy("shard").applyInArrow(build, "shard int, base binary, check binary"), "tries")
    out = [None] * n
    for row in built.toLocalIterator():
        out[row["shard"]] = phrases.sparkSession.sparkContext.broadcast(
            (np.frombuffer(row["base"], np.int32), np.frombuffer(row["check"], np.int32), digits))
    return out


def _states(ids: np.ndarray, tries: list, length: int) -> np.ndarray:
    """For each position the number of the frequent phrase of ``length`` words that starts there, or -1."""
    padded = np.concatenate([ids, np.full(length, -1, ids.dtype)])
    whole = np.ones(len(ids), bool)
    for step in range(length):
        whole &= padded[step:step + len(ids)] >= 0
    starts = np.flatnonzero(whole)
    states = np.full(len(ids), -1, np.int64)
    of = _dealt(padded, starts, length, len(tries)) if len(tries) > 1 else np.zeros(len(starts), np.int64)
    for shard, sent in enumerate(tries):
        mine = starts[of == shard] if len(tries) > 1 else starts
        if sent is not None and len(mine):
            found, value = Trie(*sent.value).accepted(padded, mine, length)
            states[found] = value
            if len(tries) > 1:
                sent.__dict__.pop("_value", None)  # one trie in memory at a time; the next use reads it again
    return states


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, ascending, and the sums of their counts."""
    distinct, of = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(of, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)


def _pair_counts(numbers: DataFrame, tries: list | None, length: int, min_count: int, bucket_pairs: int, held_pairs: int) -> DataFrame:
    """``l``, ``r`` (neighbouring phrases of ``length`` words) that follow at one word's distance in ``a >= min_count`` places.

    The tasks' counts go to buckets as packed slices. A bucket's task sums
    them and knows the frequent ones; one that would have to hold more than ``held_pairs``
    passes on partial counts, and the last aggregate sums those.
    """
    buckets = min(MOST_BUCKETS, max(1, -(-(numbers.agg(F.sum("n")).first()[0] or 0) // bucket_pairs)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            key, n = _summed(keys, counts)
            keys.clear()
            counts.clear()
            of = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            order = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cuts))
            part = [order[cuts[i]:cuts[i + 1]] for i in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([pack(np.diff(key[p], prepend=0)) for p in part], pa.binary()),
                                               pa.array([pack(n[p]) for p in part], pa.binary())], ["bucket", "keys", "counts"])

        for b in batches:
            for packed in b.column("ids"):
                ids = unpack(packed.as_py()) - 1
                states = ids if tries is None else _states(ids, tries, length)
                at = np.flatnonzero((states[:-1] >= 0) & (states[1:] >= 0))
                pairs, of = np.unique(states[at] << 32 | states[at + 1], return_inverse=True)
                keys.append(pairs)
                counts.append(np.bincount(of, minlength=len(pairs)))
                if sum(map(len, keys)) > held_pairs // 2:
                    yield out()
        if keys:
            yield out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, keys, counts, partial = None, [], [], False

        def out(least: int) -> pa.RecordBatch:
            key, n = _summed(keys, counts)
            keys.clear()
            counts.clear()
            key, n = key[n >= least], n[n >= least]
            return pa.RecordBatch.from_arrays([pa.array(key >> 32, pa.int32()), pa.array(key & 0xFFFFFFFF, pa.int32()), pa.array(n)], ["l", "r", "n"])

        for b in batches:
            for own, key, n in zip(*(b.column(c).to_pylist() for c in ("bucket", "keys", "counts"))):
                if own != bucket:
                    if keys:
                        yield out(1 if partial else min_count)
                    bucket, partial = own, False
                keys.append(np.cumsum(unpack(key)))
                counts.append(unpack(n))
                if sum(map(len, keys)) > held_pairs:
                    key, n = _summed(keys, counts)
                    keys[:], counts[:] = [key], [n]
                    if len(key) > held_pairs // 2:
                        partial = True
                        yield out(1)
        if keys:
            yield out(1 if partial else min_count)

    dealt = numbers.select("ids").mapInArrow(count, "bucket int, keys binary, counts binary")
    sums = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "l int, r int, n long")
    return sums.groupBy("l", "r").agg(F.sum("n").alias("a")).where(F.col("a") >= min_count)


def _next_level(shorter: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Frequent phrases of ``k`` words with their own count and those of their two parts of ``k - 1`` words."""
    l, r = shorter.alias("l"), shorter.alias("r")  # noqa: E741
    named = (pairs.alias("p")
             .join(l, F.expr("p.l = l.sid")).join(r, F.expr("p.r = r.sid"))
             .select("l.lang", F.expr("concat(l.ids, slice(r.ids, -1, 1))").alias("ids"),
                     F.expr("concat(l.phrase, ' ', substring_index(r.phrase, ' ', -1))").alias("phrase"),
                     "p.a", F.col("l.a").alias("left_a"), F.col("r.a").alias("right_a")))
    return _numbered(named, f"phrases-{k}")


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 100, longest: int = 5,
                     chunk_bytes: int = CHUNK_BYTES, bucket_words: int = BUCKET_WORDS,
                     trie_cells: int = TRIE_CELLS, bucket_pairs: int = BUCKET_PAIRS, held_pairs: int = HELD) -> tuple[DataFrame, list[DataFrame]]:
    """Words of each language (``lang``, ``n``), and for each length from 1 a table of the phrases that occur
    ``min_count`` times: ``lang``, ``ids``, ``phrase``, ``a`` and, from two words on, the counts ``left_a`` and
    ``right_a`` of the phrase without its last and its first word."""
    chunks = _chunks(docs, text_col, lang_col, chunk_bytes)
    totals = materialize(chunks.groupBy("lang").agg(F.sum("n").alias("n")), "word-totals")
    words, parts = _counted(chunks, min_count, bucket_words)
    words = materialize(words.withColumn("ids", F.array("sid")), "phrases-1")
    levels, n_words = [words], words.count()
    if not n_words or longest < 2:
        return totals, levels
    numbers = _numbers(chunks, parts)
    for k in range(2, longest + 1):
        sent = None if k == 2 else _tries(levels[-1], k - 1, n_words, trie_cells)
        level = _next_level(levels[-1], _pair_counts(numbers, sent, k - 1, min_count, bucket_pairs, held_pairs), k)
        for b in sent or ():
            if b is not None:
                b.destroy()
        if level.isEmpty():
            break
        levels.append(level)
    return totals, levels


def _first(rows: DataFrame, by: str, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group with their ``rank``. All rows are sorted over all partitions and numbered there, so
    no task has a whole group: the rank is the distance from the group's first number."""
    numbered = _numbered(rows.orderBy(by, *order), "ranked-phrases")
    start = numbered.groupBy(F.col(by).alias("group")).agg(F.min("sid").alias("start"))
    ranked = numbered.join(start, F.col(by) == F.col("group")).withColumn("rank", F.col("sid") - F.col("start") + 1)
    return ranked.where(F.col("rank") <= n)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 100, longest: int = 5,
                 top: int = 2000, **sizes: int) -> DataFrame:
    """Each language's ``top`` phrases: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A phrase's score is ``floor(1000 a n / (l r))`` at the cut where that is
    least (the first of several). A phrase inside a longer one that occurs as
    often is left out; as counts cannot grow with length, it is enough to
    look at those longer by a word.
    """
    totals, levels = frequent_phrases(docs, text_col, lang_col, min_count, longest, **sizes)
    counts = levels[0].select("ids", "a")
    spark = docs.sparkSession
    if len(levels) == 1:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    for level in levels[1:-1]:
        counts = counts.union(level.select("ids", "a"))
    wanted = levels[1].select("lang", "ids", "phrase", "a")
    covered = None
    for level in levels[2:]:
        wanted = wanted.union(level.select("lang", "ids", "phrase", "a"))
        inner = level.select(F.explode(F.expr(
            "filter(array(if(a >= left_a, slice(ids, 1, size(ids) - 1), null), if(a >= right_a, slice(ids, 2, size(ids) - 1), null)), x -> x is not null)")).alias("ids"))
        covered = inner if covered is None else covered.union(inner)
    if covered is not None:
        wanted = wanted.join(covered.distinct(), "ids", "left_anti")
    cuts = wanted.withColumn("cut", F.explode(F.expr("sequence(1, size(ids) - 1)")))
    left = counts.select(F.col("ids").alias("l_ids"), F.col("a").alias("l"))
    right = counts.select(F.col("ids").alias("r_ids"), F.col("a").alias("r"))
    parts = (cuts.join(left, F.expr("slice(ids, 1, cut) = l_ids")).join(right, F.expr("slice(ids, cut + 1, size(ids) - cut) = r_ids"))
             .join(totals, "lang"))
    exact = F.expr("(1000 * CAST(a AS DECIMAL(16,0)) * CAST(n AS DECIMAL(17,0))) div (CAST(l AS DECIMAL(17,0)) * CAST(r AS DECIMAL(17,0)))")
    scored = (parts.select("lang", "ids", "phrase", "a", "n", F.struct(exact.alias("score"), "cut", "l", "r").alias("s"))
              .groupBy("lang", "ids", "phrase", "a", "n").agg(F.min("s").alias("s"))
              .select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score"))
    ranked = _first(scored, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
