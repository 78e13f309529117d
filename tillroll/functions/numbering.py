"""Dense row numbers without a global window."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.session import materialize

_LOCAL = (1 << 33) - 1  # the part of monotonically_increasing_id that counts within a partition


def dense_numbers(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows``, written, with ``name`` counting from 0 in the given order (which must have no ties).

    Rows are range partitioned and sorted, numbered within their partition
    and shifted by the sizes of the partitions before it. The driver sees one
    size per partition, never the rows.
    """
    placed = materialize(rows.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), name)
    part = F.shiftright("_place", 33)
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = [0, *accumulate(n for _, n in sizes)]
    starts = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "_part long, _before long")
    return (placed.join(F.broadcast(starts), part == F.col("_part"))
            .withColumn(name, F.col("_before") + F.col("_place").bitwiseAND(F.lit(_LOCAL))).drop("_place", "_part", "_before"))
