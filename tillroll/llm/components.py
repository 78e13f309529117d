"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.session import materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def _written(low: DataFrame) -> DataFrame:
    """The minima as a table: behind an aggregate of its own, a join's partitions could not be split, and the
    neighbours of one node may be a large part of all edges."""
    return materialize(low, "least-neighbours")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node moves to the node's smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them. Edges come as u > v."""
    low = _written(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Columns ``node`` and ``component`` (its smallest node), for nodes with a link to another.

    Each round is two aggregates with map-side minima, whose results are
    written, and two joins with them (a node with very many neighbours is one row
    there, so AQE can split the neighbours); the edges are written to the checkpoint folder after each round. The
    driver sees a count and a checksum. Null ends and loops are ignored; no
    edges give no rows.
    """
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    e = e.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct()
    e = materialize(e, "edges")
    before = _state(e)
    while before[0]:
        e = materialize(_small_star(_large_star(e)).where("u <> v").distinct(), "edges")
        after = _state(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
