"""Category penetration by segment (X4): distinct customers on every level of (segment, category).

Distinct counts don't add up, bitmaps do. The customers of each cell of the
finest level are bitmaps of ``bitmap_bucket_number`` (32,768 ids each); the coarser levels
are unions of them, one step up the lattice at a time, so the lines are
aggregated once and nothing is counted distinct twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import first_word, round_ratio
from tillroll.session import materialize


def category_penetration(clean: DataFrame, segments: DataFrame, category: Column | None = None) -> DataFrame:
    """GROUP BY CUBE(Segment, Category) over cleaned lines, with a row for every segment and category, bought or not.

    Level is 0 for (Segment, Category), 1 for Segment, 2 for Category and 3 for all (the other column is null there; a
    null category of the data is ``(none)``). Customers bought in the cell; Penetration is their share of the segment's
    customers (of all customers on levels 2 and 3); Revenue is the cell's.
    """
    name = F.coalesce(first_word(F.col("Description")) if category is None else category, F.lit("(none)"))
    # one row per customer and category first: a hot customer's lines are summed before the join
    bought = clean.groupBy("CustomerID", name.alias("Category")).agg(F.sum("TotalAmount").alias("Revenue"))
    cells = bought.join(segments.select("CustomerID", "Segment"), "CustomerID")
    fine = cells.groupBy("Segment", "Category", F.bitmap_bucket_number("CustomerID").alias("Bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("CustomerID")).alias("Bits"), F.sum("Revenue").alias("Revenue"))
    fine = materialize(fine, "penetration-bitmaps")

    def up(finer: DataFrame, *keys: str) -> DataFrame:
        return finer.groupBy(*keys, "Bucket").agg(F.bitmap_or_agg("Bits").alias("Bits"), F.sum("Revenue").alias("Revenue"))

    by_segment = materialize(up(fine, "Segment"), "segment-bitmaps")
    levels = [(0, fine, ["Segment", "Category"]), (1, by_segment, ["Segment"]), (2, up(fine, "Category"), ["Category"]), (3, up(by_segment), [])]
    counted = None
    for level, bitmaps, keys in levels:
        own = bitmaps.groupBy(*keys).agg(F.sum(F.bitmap_count("Bits")).alias("Customers"), F.sum("Revenue").alias("Revenue"))
        own = own.select(F.lit(level).alias("Level"), *[(F.col(k) if k in keys else F.lit(None).cast("string")).alias(k) for k in ("Segment", "Category")],
                         "Customers", "Revenue")
        counted = own if counted is None else counted.union(own)
    counted = materialize(counted, "penetration-levels")
    # every segment (at most 27) beside every category; of all customers of a segment, also those without a purchase
    sizes = segments.groupBy("Segment").agg(F.count(F.lit(1)).alias("Size"))
    named = sizes.agg(F.collect_list(F.struct("Segment", "Size")).alias("All"), F.sum("Size").alias("Total"))
    grid = counted.where("Level = 2").crossJoin(F.broadcast(named)).select(
        F.lit(0).alias("Level"), "Category", F.explode("All").alias("s")).select("Level", "s.Segment", "Category", F.col("s.Size").alias("Of"))
    segment_rows = sizes.select(F.lit(1).alias("Level"), "Segment", F.lit(None).cast("string").alias("Category"), F.col("Size").alias("Of"))
    coarse = counted.where("Level > 1").crossJoin(F.broadcast(named)).select("Level", "Segment", "Category", F.col("Total").alias("Of"))
    cube = grid.union(segment_rows).union(coarse)
    at = [cube[c].eqNullSafe(counted[c]) for c in ("Level", "Segment", "Category")]
    filled = cube.join(counted, at[0] & at[1] & at[2], "left").select(
        cube.Level, cube.Segment, cube.Category, F.coalesce("Customers", F.lit(0).cast("long")).alias("Customers"), "Of",
        F.coalesce("Revenue", F.lit(0)).alias("Revenue"))
    return filled.select("Level", "Segment", "Category", "Customers", F.col("Of").alias("SegmentCustomers"),
                         round_ratio("Customers", "Of", 4).alias("Penetration"), "Revenue")
