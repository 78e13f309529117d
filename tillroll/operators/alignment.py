"""Alignment of tables with differing keys (J3), as putting several pandas Series into one frame does."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align(frames: Mapping[str, DataFrame], key: str) -> DataFrame:
    """One row for each key of any frame: the columns of all frames, null where a frame lacks the key, and ``In<name>`` for each.

    A full outer join of all frames at once: their rows are stacked with nulls
    in the others' columns and merged by one aggregate, so any number of
    frames takes one shuffle of keys, with partial aggregation. A null key is
    a key. A key that occurs twice in a frame stops the job, as a duplicate
    index does; columns that two frames share are refused.
    """
    owner: dict[str, str] = {}
    for name, df in frames.items():
        for c in df.columns:
            if c != key and owner.setdefault(c, name) != name:
                raise ValueError(f"column {c} is in {owner[c]} and {name}")
    kinds = {c: frames[name].schema[c].dataType for c, name in owner.items()}
    rows = None
    for name, df in frames.items():
        own = df.select(
            F.col(key), *[F.lit(n == name).cast("int").alias(f"In{n}") for n in frames],
            *[(F.col(c) if n == name else F.lit(None).cast(kinds[c])).alias(c) for c, n in owner.items()])
        rows = own if rows is None else rows.unionByName(own)

    def once(n: str):
        twice = F.raise_error(F.concat(F.lit(f"{n} has a key twice: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
        return F.when(F.col(f"In{n}") > 1, twice.cast("boolean")).otherwise(F.col(f"In{n}") == 1).alias(f"In{n}")

    merged = rows.groupBy(key).agg(*[F.sum(f"In{n}").alias(f"In{n}") for n in frames], *[F.first(c, ignorenulls=True).alias(c) for c in owner])
    return merged.select(key, *owner, *[once(n) for n in frames])
