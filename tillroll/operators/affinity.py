"""Cross-purchase patterns (X7): frequent product sets over baskets, and the affinity matrix.

A basket is the set of distinct products of an invoice. Products are ranked by
support (the number of baskets that hold them), and a basket is the array of its
frequent products' ranks. No basket is joined with itself: each shard of products
gets a basket's prefix up to its last product there, once, and finds the sets
whose rarest product is its own from a prefix tree that merges what baskets
have in common. Equal baskets travel once, with their number.

Hot products: a product in a third of all baskets brings a third of the prefixes
to its shard. Shards with more than ``TREE_BASKETS`` prefixes are split by a salt
of the basket; the trees of a shard count their parts, and an aggregate adds
them up, so no tree sees more than its share. The result does not depend on the split.

A basket itself is one array, bounded by the number of frequent products: its pairs
are what is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import round_ratio
from tillroll.functions.numbering import dense_numbers
from tillroll.session import materialize

SHARDS, TREE_BASKETS = 256, 200_000


def basket_items(lines: DataFrame, item: Column | str = "StockCode") -> DataFrame:
    """Distinct (InvoiceNo, Item); lines without an invoice or an item are in no basket."""
    return lines.select("InvoiceNo", (F.col(item) if isinstance(item, str) else item).alias("Item")).where(
        "InvoiceNo IS NOT NULL AND Item IS NOT NULL").distinct()


def ranked_items(items: DataFrame, min_support: int) -> DataFrame:
    """Item, Support and Rank (from 0, the most frequent first) of the items in at least ``min_support`` baskets."""
    support = items.groupBy("Item").agg(F.count(F.lit(1)).alias("Support")).where(F.col("Support") >= min_support)
    return dense_numbers(support, [F.desc("Support"), F.asc("Item")], "Rank")


def _conditional(baskets: DataFrame, shards: int) -> DataFrame:
    """For each shard with a product in a basket: the basket up to its last product of that shard."""
    shard_of = F.transform("Basket", lambda r: r % shards)
    last = lambda s: F.size("Basket") - F.array_position(F.reverse(shard_of), s) + 1
    prefixes = F.transform(F.array_distinct(shard_of), lambda s: F.struct(
        s.alias("Shard"), F.slice("Basket", F.lit(1), last(s).cast("int")).alias("Prefix")))
    rows = baskets.select(F.explode(prefixes).alias("p"), "N").select("p.Shard", "p.Prefix", "N")
    return rows.where(F.size("Prefix") > 1).groupBy("Shard", "Prefix").agg(F.sum("N").alias("N"))


class _Node:
    __slots__ = ("children", "count")

    def __init__(self) -> None:
        self.children: dict[int, _Node] = {}
        self.count = 0


def _tree_sets(root: _Node, shard: int, shards: int, max_size: int) -> dict[tuple[int, ...], int]:
    """Counts of the sets of 2 to ``max_size`` products on the tree's paths that end in a product of the shard."""
    found: dict[tuple[int, ...], int] = {}
    stack = [(root, ())]
    while stack:
        node, path = stack.pop()
        for rank, child in node.children.items():
            if path and rank % shards == shard:
                for size in range(1, max_size):
                    for rest in combinations(path, size):
                        key = (*rest, rank)
                        found[key] = found.get(key, 0) + child.count
            stack.append((child, (*path, rank)))
    return found


def frequent_sets(items: DataFrame, ranks: DataFrame, min_support: int, max_size: int = 2, shards: int = SHARDS,
                  tree_baskets: int = TREE_BASKETS) -> DataFrame:
    """``Ranks`` (ascending array) and ``Together`` (baskets that hold them all), for sets of 2 to ``max_size`` products
    in at least ``min_support`` baskets."""
    own = items.join(ranks.select("Item", "Rank"), "Item").groupBy("InvoiceNo").agg(F.sort_array(F.collect_list("Rank")).alias("Basket"))
    baskets = own.where(F.size("Basket") > 1).groupBy("Basket").agg(F.count(F.lit(1)).alias("N"))
    prefixes = materialize(_conditional(baskets, shards), "conditional-baskets")
    # at most ``shards`` rows: how many trees each shard needs
    trees = prefixes.groupBy("Shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(tree_baskets)).cast("long").alias("Trees"))
    dealt = prefixes.join(F.broadcast(trees), "Shard").select(
        "Shard", F.pmod(F.xxhash64("Prefix"), "Trees").alias("Salt"), "Prefix", "N")

    def mine(table: pa.Table) -> pa.Table:
        shard, root = table.column("Shard")[0].as_py(), _Node()
        for prefix, n in zip(table.column("Prefix").to_pylist(), table.column("N").to_pylist()):
            node = root
            for rank in prefix:
                node = node.children.setdefault(rank, _Node())
                node.count += n
        found = _tree_sets(root, shard, shards, max_size)
        return pa.table({"Ranks": pa.array(list(found), pa.list_(pa.int64())), "N": pa.array(list(found.values()), pa.int64())})

    parts = dealt.groupBy("Shard", "Salt").applyInArrow(mine, "Ranks array<long>, N long")
    return parts.groupBy("Ranks").agg(F.sum("N").alias("Together")).where(F.col("Together") >= min_support)


def product_sets(lines: DataFrame, item: Column | str = "StockCode", min_support: int = 2, max_size: int = 2, **sizes: int) -> DataFrame:
    """Items (ascending array) and Together, for all sets of 2 to ``max_size`` items in at least ``min_support`` baskets."""
    items = materialize(basket_items(lines, item), "basket-items")
    ranks = ranked_items(items, min_support)
    sets = frequent_sets(items, ranks, min_support, max_size, **sizes)
    named = sets.select("Ranks", "Together", F.explode("Ranks").alias("Rank")).join(ranks.select("Rank", "Item"), "Rank")
    return named.groupBy("Ranks", "Together").agg(F.sort_array(F.collect_list("Item")).alias("Items")).select("Items", "Together")


def product_affinity(lines: DataFrame, item: Column | str = "StockCode", min_support: int = 2, **sizes: int) -> DataFrame:
    """One row for each two items (ItemA < ItemB) bought together in at least ``min_support`` baskets.

    Together, SupportA and SupportB count baskets; ConfidenceAB is the share of
    the baskets with A that hold B; Lift is how many times more often the two
    meet than independent items would. Ratios are exact, rounded to four places.
    """
    items = materialize(basket_items(lines, item), "basket-items")
    ranks = ranked_items(items, min_support)
    pairs = frequent_sets(items, ranks, min_support, 2, **sizes).select(
        F.col("Ranks")[0].alias("x"), F.col("Ranks")[1].alias("y"), "Together")
    total = items.agg(F.count_distinct("InvoiceNo").alias("Baskets"))
    x = ranks.select(F.col("Rank").alias("x"), F.col("Item").alias("ItemX"), F.col("Support").alias("SupportX"))
    y = ranks.select(F.col("Rank").alias("y"), F.col("Item").alias("ItemY"), F.col("Support").alias("SupportY"))
    named = pairs.join(x, "x").join(y, "y").crossJoin(F.broadcast(total))
    first = F.col("ItemX") < F.col("ItemY")
    sided = named.select(
        F.least("ItemX", "ItemY").alias("ItemA"), F.greatest("ItemX", "ItemY").alias("ItemB"), "Together",
        F.when(first, F.col("SupportX")).otherwise(F.col("SupportY")).alias("SupportA"),
        F.when(first, F.col("SupportY")).otherwise(F.col("SupportX")).alias("SupportB"), "Baskets")
    return sided.select(
        "ItemA", "ItemB", "Together", "SupportA", "SupportB", "Baskets",
        round_ratio("Together", "SupportA", 4).alias("ConfidenceAB"), round_ratio("Together", "SupportB", 4).alias("ConfidenceBA"),
        round_ratio("cast(Together as decimal(18,0)) * Baskets", "cast(SupportA as decimal(18,0)) * SupportB", 4).alias("Lift"))
