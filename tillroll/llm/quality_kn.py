"""Quality classifier: interpolated modified Kneser-Ney over characters, perplexity, quantiles per language.

The model is a character 4-gram model of trusted text (labelled good and not
toxic), over all code points: there is no alphabet. Counts, continuation counts
and context totals are Spark aggregates; the interpolated probabilities are joins of
these count tables, order by order, sharded by context and character. All trusted
rows take part, with their whole texts.

The finished tables are dealt to shards of ``SHARD_GRAMS`` n-grams by a hash of the
n-gram, each an open hash table that a task builds. Documents stay where they are: their n-grams
are looked up shard by shard and the logarithms summed per document, so no
document's n-grams (several times its text) are shuffled. A task holds one of several shards at a time.

One in ``holdout`` of the trusted ids is not learned from and gives the limits, by exact quantiles from a sort over all partitions. Junk
is off in both directions: marks are surprising, one word over and over is
not surprising enough (or too much, always alike). A text's logarithm of perplexity is taken as its
distance from the language's median, in units that shrink with the square root of
its length (up to ``STEADY`` characters, beyond which texts vary no less); a document stays if that lies between
the quantiles ``1 - quantile`` and ``quantile`` of its language (of all held-out rows
where a language has fewer than ``min_rows``).

Edge cases: a null text counts as empty, an empty text is its end mark alone
and has a perplexity; repeated rows are scored alike; null languages are a
language of their own; labels without a document, or repeated, do not
matter, and a document with both a good and a bad label is not trusted; without trusted rows nothing is rejected (perplexity and limits are
null); an empty table gives no rows; other columns are kept by
:func:`reject_low_quality` and not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.numbering import dense_numbers
from tillroll.llm._common import drop_kept, free_name, one_by_one, text_chunks, with_ids_of
from tillroll.session import materialize

ORDER = 4
#: Marks beside the code points; a character takes 21 bits of a context.
START, END, CODES, BITS = 0x110000, 0x110001, 0x110000, 21
#: The longest text that Spark holds: none is left out.
MAX_CHARS = (1 << 31) - 1
SHARD_GRAMS = 4_000_000
STEADY = 1024
#: A task scores about so many characters at a time.
CHARS = 500_000


def _text(docs: DataFrame, text_col: str):
    return F.coalesce(docs[text_col].cast("string"), F.lit(""))


def trusted_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 lang_col: str = "lang", holdout: int = 3) -> DataFrame:
    """``text``, ``lang``, ``held`` and ``order`` (a hash of the id) of all rows with a trusted id. A bitmap of the trusted ids keeps
    most other rows out of the join, whose plan does not depend on the number of labels: the texts that it shuffles grow with the trusted ones."""
    good = materialize(labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
            .where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL")
            .select(F.col("doc_id").alias("trusted_id"), F.xxhash64("doc_id").alias("order")), "trusted-ids")
    rows = docs.select(docs[id_col].alias("doc_id"), _text(docs, text_col).alias("text"), docs[lang_col].alias("lang"))
    rows = with_ids_of(rows, "doc_id", good.select(F.col("trusted_id").cast(rows.schema["doc_id"].dataType).alias("id")), "id")
    return rows.join(good.hint("merge"), rows.doc_id == good.trusted_id).select(
        "text", "lang", (F.pmod(F.xxhash64("order"), F.lit(holdout)) == 0).alias("held"), "order")


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points (letters in their case) one after the other, each text between three start marks and an end mark; and where each text's first start mark is."""
    parts, sizes = [], []
    for t in texts:
        own = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        parts += [np.full(ORDER - 1, START, np.int64), own.astype(np.int64), np.array([END])]
        sizes.append(len(own) + ORDER)
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.cumsum([0, *sizes])


def _grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context (of three characters) and character, for each that is no start mark."""
    at = np.flatnonzero(points != START)
    context = points[at - 3] << 2 * BITS | points[at - 2] << BITS | points[at - 1]
    return context, points[at]


def _key(order: int, context: np.ndarray, char: np.ndarray | None) -> np.ndarray:
    """Number of an n-gram, or (without a character) of the weight of a context, among those of all orders. 64 bits of a hash: of the model's
    n-grams and those looked up, two are one by accident with a chance of about 1 in 10^12 a lookup."""
    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))

    short = context & ((1 << BITS * (order - 1)) - 1)
    char = np.zeros(1, np.uint64) if char is None else char.astype(np.uint64) + np.uint64(1)
    own = np.uint64(order) + (char << np.uint64(8))
    return mix(mix(short.astype(np.uint64)) + own * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Table:
    """An open hash table: numbers (never 0) and their values."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        size = 1 << int(2 * len(keys) + 1).bit_length()
        out = cls(np.zeros(size, np.uint64), np.zeros(size))
        slot, rest = keys & np.uint64(size - 1), np.arange(len(keys))
        while len(rest):
            free = out.keys[slot[rest]] == 0
            own, first = np.unique(slot[rest[free]], return_index=True)
            put = rest[free][first]
            out.keys[own], out.values[own] = keys[put], values[put]
            rest = rest[out.keys[slot[rest]] != keys[rest]]
            slot[rest] = slot[rest] + np.uint64(1) & np.uint64(size - 1)
        return out

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the numbers, NaN for unknown ones."""
        mask = np.uint64(len(self.keys) - 1)
        slot = keys & mask
        here = self.keys[slot]
        out = np.where(here == keys, self.values[slot], np.nan)
        rest = np.flatnonzero((here != keys) & (here != 0))
        while len(rest):
            slot[rest] = slot[rest] + np.uint64(1) & mask
            here = self.keys[slot[rest]]
            hit = here == keys[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (here != 0)]
        return out


class Model:
    """Shards of probabilities of seen n-grams and weights of seen contexts, as broadcasts (None: nothing in it)."""

    def __init__(self, sent: list):
        self.shards = sent
        self.table = self._load(sent[0].value if sent[0] is not None else None) if len(sent) == 1 else None

    @staticmethod
    def _load(value: tuple | None) -> Table:
        return Table(*value) if value is not None else Table(np.zeros(1, np.uint64), np.zeros(1))

    def get(self, keys: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table.get(keys)
        out = np.full(len(keys), np.nan)
        of = _shard(keys, len(self.shards))
        some = [i for i, b in enumerate(self.shards) if b is not None]
        for i, value in zip(some, one_by_one([self.shards[i] for i in some])):
            mine = np.flatnonzero(of == i)
            out[mine] = self._load(value).get(keys[mine])
        return out

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Natural logarithm of the probability of each text, and its characters (its end counted)."""
        points, first = _points(texts)
        if not len(texts):
            return np.zeros(0), np.zeros(0, np.int64)
        context, char = _grams(points)
        p, left = np.ones(len(char)), np.arange(len(char))
        if self.table is None:  # all orders at once: each shard is loaded once for these texts
            every = self.get(np.concatenate([_key(n, context, x) for n in range(ORDER, 0, -1) for x in (char, None)])).reshape(ORDER, 2, -1)
        for order in range(ORDER, 0, -1):
            seen = self.get(_key(order, context[left], char[left])) if self.table is not None else every[ORDER - order, 0, left]
            known = ~np.isnan(seen)
            p[left[known]] *= seen[known]
            left = left[~known]
            weight = self.get(_key(order, context[left], None)) if self.table is not None else every[ORDER - order, 1, left]
            p[left] *= np.where(np.isnan(weight), 1.0, weight)  # an unseen context leaves all to the lower order
        p[left] /= CODES
        sizes = np.diff(first) - (ORDER - 1)
        return np.add.reduceat(np.log(p), np.cumsum(sizes) - sizes), sizes


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ from the counts of counts (kept within (0, n], where a corpus lacks some of them)."""
    n = {r.c: r.n for r in counts.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    n = [n.get(i, 0) for i in range(5)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return [min(k, max(0.05 * k, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else 0.5 for k in (1, 2, 3)]


def _discounted(counts: DataFrame, d: list[float]) -> tuple[DataFrame, DataFrame]:
    """Per n-gram the discounted share ``a`` of its context, per context the weight ``g`` left for the lower order."""
    off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
    total = counts.groupBy("context").agg(F.sum("c").alias("t"), F.sum(off).alias("off"))
    share = counts.join(total, "context").select(*counts.columns, ((F.col("c") - off) / F.col("t")).alias("a"))
    return share, total.select("context", (F.col("off") / F.col("t")).alias("g"))


def train(spark: SparkSession, sample: DataFrame, shard_grams: int = SHARD_GRAMS) -> list | None:
    """Broadcast shards of the model of the rows of ``sample`` that are not held out; None if there are none.
    The driver sees one shard after the other."""
    texts = sample.where("NOT held")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches):
            context, char = _grams(_points(b.column("text").to_pylist())[0])
            order = np.lexsort((char, context))
            context, char = context[order], char[order]
            first = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (char[1:] != char[:-1])])) if len(char) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays(
                [pa.array(context[first]), pa.array(char[first], pa.int32()), pa.array(np.diff(np.append(first, len(char))))], ["context", "char", "c"])

    counts = {ORDER: materialize(texts.select("text").mapInArrow(count, "context long, char int, c long")
                                 .groupBy("context", "char").agg(F.sum("c").alias("c")), f"{ORDER}-grams")}
    for order in range(ORDER - 1, 0, -1):  # distinct left neighbours
        short = F.col("context").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))
        counts[order] = materialize(counts[order + 1].groupBy(short.alias("context"), "char").agg(F.count("*").alias("c")), f"{order}-grams")
    lower, rows = None, None
    for order in range(1, ORDER + 1):
        share, weight = _discounted(counts[order], _discounts(counts[order]))
        both = share.join(weight, "context")
        if lower is None:
            p = both.select("context", "char", (F.col("a") + F.col("g") / CODES).alias("p"))
        else:
            short = F.col("context").bitwiseAND(F.lit((1 << BITS * (order - 2)) - 1))
            lower = lower.select(F.col("context").alias("short"), F.col("char").alias("low_char"), F.col("p").alias("low"))
            p = both.join(lower, (short == F.col("short")) & (F.col("char") == F.col("low_char"))).select(
                "context", "char", (F.col("a") + F.col("g") * F.col("low")).alias("p"))
        lower = materialize(p, f"{order}-gram-probabilities")
        own = lower.select(F.lit(order).alias("n"), "context", "char", "p").union(
            weight.select(F.lit(order).alias("n"), "context", F.lit(None).cast("int").alias("char"), F.col("g").alias("p")))
        rows = own if rows is None else rows.union(own)
    rows = materialize(rows, "model")
    shards = -(-rows.count() // shard_grams)
    if not shards:
        return None

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, context, char = b.column("n").to_numpy(), b.column("context").to_numpy(), b.column("char")
            gram, letters = char.is_valid().to_numpy(zero_copy_only=False), char.fill_null(0).to_numpy()
            key = np.zeros(b.num_rows, np.uint64)
            for order in range(1, ORDER + 1):
                for at, letter in ((gram & (n == order), letters), (~gram & (n == order), None)):
                    key[at] = _key(order, context[at], None if letter is None else letter[at])
            yield pa.RecordBatch.from_arrays([pa.array(_shard(key, shards)), pa.array(key.view(np.int64)), b.column("p")], ["shard", "key", "p"])

    def build(t: pa.Table) -> pa.Table:
        table = Table.build(t.column("key").to_numpy().view(np.uint64), t.column("p").to_numpy())
        return pa.table({"shard": t.column("shard").slice(0, 1), "keys": [table.keys.tobytes()], "values": [table.values.tobytes()]},
                        pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("values", pa.binary())]))

    built = materialize(rows.mapInArrow(deal, "shard int, key long, p double").groupBy("shard").applyInArrow(
        build, "shard int, keys binary, values binary"), "model-shards")
    out = [None] * shards
    for r in built.toLocalIterator():
        out[r["shard"]] = spark.sparkContext.broadcast((np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["values"], np.float64)))
    return out


def load(sent: list) -> Model:
    return Model(sent)


def _scorer(sent: list):
    @F.arrow_udf("struct<logp:double,n:long>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        drop_kept()
        model = load(sent)
        for texts in batches:
            logp, n, held, chars = [], [], [], 0
            for t in texts.to_pylist():
                held.append(t)
                chars += len(t)
                if chars > CHARS:
                    for into, own in zip((logp, n), model.scores(held)):
                        into.append(own)
                    held, chars = [], 0
            for into, own in zip((logp, n), model.scores(held)):
                into.append(own)
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(logp), pa.float64()), pa.array(np.concatenate(n), pa.int64())], ["logp", "n"])

    return score


def _quantiles(rows: DataFrame, value: str, at: dict[str, float]) -> DataFrame:
    """Per ``key`` of ``rows`` the named quantiles of ``value``, exactly as ``percentile`` interpolates them: by places in a sort over all
    partitions, so that no task holds a group."""
    placed = dense_numbers(rows.select("key", value, "order"), [F.col("key"), F.col(value), F.col("order")], "place")
    whole = placed.groupBy("key").agg(F.min("place").alias("first"), (F.count(F.lit(1)) - 1).alias("last"))
    place = {name: F.col("last") * F.lit(q) for name, q in at.items()}
    value_at = lambda p: F.max(F.when(F.col("place") == F.col("first") + p, F.col(value)))
    around = placed.join(F.broadcast(whole), "key").groupBy("key", "last").agg(
        *[value_at(side(p)).alias(f"{name}_{n}") for name, p in place.items() for n, side in (("lo", F.floor), ("hi", F.ceil))])
    return around.select("key", *[
        F.when(F.floor(p) == F.ceil(p), F.col(f"{name}_lo")).otherwise(
            (F.ceil(p) - p) * F.col(f"{name}_lo") + (p - F.floor(p)) * F.col(f"{name}_hi")).alias(name) for name, p in place.items()])


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str = "lang", quantile: float = 0.998, min_rows: int = 100,
                    holdout: int = 3) -> tuple[DataFrame, dict[str, str]]:
    """All rows and columns of ``docs`` with six more, whose names the mapping gives: ``n_tokens``, ``perplexity``,
    ``deviation``, ``lowest`` and ``highest`` (its limits) and ``keep`` (whether it lies between them)."""
    spark = docs.sparkSession
    own = {x: free_name(docs, x) for x in ("n_tokens", "perplexity", "deviation", "lowest", "highest", "keep", "scored", "middle")}
    sample = materialize(trusted_rows(docs, labels, id_col, text_col, lang_col, holdout), "trusted")
    sent = train(spark, sample)
    if sent is None:
        none = F.lit(None).cast("double")
        return docs.withColumns({own["n_tokens"]: F.lit(None).cast("long"), **{own[x]: none for x in ("perplexity", "deviation", "lowest", "highest")},
                                 own["keep"]: F.lit(True)}), own
    score = _scorer(sent)

    def deviation(logp, n, middle):
        return (-logp / n - middle) * F.sqrt(F.least(n, F.lit(STEADY)).cast("double"))

    held = materialize(sample.where("held").select("lang", "order", score("text").alias("s")).select("lang", "order", "s.logp", "s.n"), "held-out")
    # each language with rows enough has limits of its own, and all rows together have some
    own_key = F.when(F.col("lang").isNull(), "none").otherwise(F.concat(F.lit("lang "), F.col("lang").cast("string")))
    langs = materialize(held.groupBy("lang").agg(F.count("*").alias("rows")).where(F.col("rows") >= min_rows).select(
        F.col("lang").alias("limit_lang"), own_key.alias("key")), "languages")
    grouped = held.join(F.broadcast(langs), F.col("lang").eqNullSafe(F.col("limit_lang"))).select("key", "order", "logp", "n").union(
        held.select(F.lit("all").alias("key"), "order", "logp", "n"))
    middle = materialize(_quantiles(grouped.withColumn("x", -F.col("logp") / F.col("n")), "x", {"middle": 0.5}), "middle")
    off = grouped.join(F.broadcast(middle), "key").withColumn("off", deviation(F.col("logp"), F.col("n"), F.col("middle")))
    limits = materialize(_quantiles(off, "off", {"lowest": 1 - quantile, "highest": quantile}).join(F.broadcast(middle), "key"), "limits")
    overall = limits.where("key = 'all'").first()
    limits = limits.join(F.broadcast(langs), "key").select("limit_lang", "middle", "lowest", "highest")
    names = {c: free_name(docs, c) for c in ("limit_lang", "middle", "lowest", "highest")}
    limits = limits.select(*[F.col(c).alias(n) for c, n in names.items()])
    out = docs.withColumn(own["scored"], score(_text(docs, text_col)))
    out = out.join(F.broadcast(limits), out[lang_col].eqNullSafe(limits[names["limit_lang"]]), "left")
    known = F.col(f"`{names['middle']}`").isNotNull()
    at = {c: F.when(known, F.col(f"`{names[c]}`")).otherwise(F.lit(overall[c] if overall else None).cast("double")) for c in ("middle", "lowest", "highest")}
    logp, n = F.col(f"`{own['scored']}`.logp"), F.col(f"`{own['scored']}`.n")
    off = deviation(logp, n, at["middle"])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], n.alias(own["n_tokens"]), F.exp(-logp / n).alias(own["perplexity"]),
                      off.alias(own["deviation"]), at["lowest"].alias(own["lowest"]), at["highest"].alias(own["highest"]),
                      F.coalesce(off.between(at["lowest"], at["highest"]), F.lit(True)).alias(own["keep"])), own


def reject_low_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their own columns."""
    scored, own = score_documents(docs, labels, **options)
    return scored.where(F.col(f"`{own['keep']}`")).select(*[F.col(f"`{c}`") for c in docs.columns])
