"""Frequent product sets: trees, shards and salts against counting all pairs; the plan; ties and nulls."""

import random
from collections import Counter
from itertools import combinations

import pytest
from helpers import lines
from pyspark.sql import functions as F

from tillroll.functions.numbering import dense_numbers
from tillroll.operators import affinity
from tillroll.operators.affinity import basket_items, product_affinity, product_sets, ranked_items


def baskets(spark, table):
    return lines(spark, [(inv, item, "Red Mug", 1, "2024-01-01T10:00:00", 1, 1, "UK") for inv, item in table])


def random_baskets(seed, n=120, products=12, hot="P0"):
    rng = random.Random(seed)
    table = []
    for i in range(n):
        own = {f"P{min(rng.randrange(products), rng.randrange(products))}" for _ in range(rng.randrange(6))}
        table += [(f"I{i}", p) for p in own | ({hot} if i % 3 == 0 else set())]
        table += [(f"I{i}", p) for p in sorted(own)[:1]]  # a product twice on an invoice
    return table


def brute(table, min_support, max_size):
    own = {}
    for inv, item in table:
        if inv is not None and item is not None:
            own.setdefault(inv, set()).add(item)
    counts = Counter(c for b in own.values() for k in range(2, max_size + 1) for c in combinations(sorted(b), k))
    return {c: n for c, n in counts.items() if n >= min_support}


@pytest.mark.parametrize("sizes", [{}, {"shards": 1}, {"shards": 3, "tree_baskets": 5}, {"tree_baskets": 1}])
def test_sets_equal_counting_whatever_the_shards_and_trees(spark, sizes):
    table = random_baskets(1)
    got = {tuple(r.Items): r.Together for r in product_sets(baskets(spark, table), min_support=3, max_size=3, **sizes).collect()}
    assert got == brute(table, 3, 3) and any(len(k) == 3 for k in got)


def test_hot_product_goes_to_several_trees(spark):
    table = [(f"I{i}", p) for i in range(300) for p in ("HOT", f"A{i % 20}", f"B{i % 7}")]
    items = basket_items(baskets(spark, table))
    ranks = ranked_items(items, 2)
    own = items.join(ranks, "Item").groupBy("InvoiceNo").agg(F.sort_array(F.collect_list("Rank")).alias("Basket")).withColumn("N", F.lit(1).cast("long"))
    prefixes = affinity._conditional(own, 4)
    assert prefixes.agg(F.max(F.size("Prefix"))).first()[0] == 3
    got = {tuple(r.Items): r.Together for r in product_sets(baskets(spark, table), shards=4, tree_baskets=10).collect()}
    assert got == brute(table, 2, 2)


def test_affinity_ratios_and_missing_values(spark):
    table = [("1", "A"), ("1", "B"), ("2", "A"), ("2", "B"), ("3", "A"), ("4", "C"), ("5", "A"), ("5", "A"), (None, "A"), (None, "B"), ("6", None), ("6", "B")]
    rows = product_affinity(baskets(spark, table)).collect()
    assert [tuple(r) for r in rows] == [("A", "B", 2, 4, 3, 6, 0.5, 0.6667, 1.0)]
    assert product_affinity(baskets(spark, [("1", "A")])).count() == 0
    assert product_affinity(baskets(spark, [])).count() == 0


def test_no_basket_meets_another(spark):
    df = product_affinity(baskets(spark, random_baskets(2)))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "InvoiceNo" not in "".join(line for line in plan.split("\n") if "Join" in line)


def test_dense_numbers_count_on_over_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(9)
    got = dense_numbers(rows, [F.desc("x")], "no").collect()
    assert sorted((r.no, r.x) for r in got) == [(i, 999 - i) for i in range(1000)]
    assert dense_numbers(rows.where("x < 0"), [F.desc("x")], "no").count() == 0
