"""Column expressions shared by the operators.

All of them are built-in Catalyst expressions (no Python UDF), so they
stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.functions.exact import HALF_EVEN, HALF_UP, ratio_round_sql

MONEY_SCALE = 4
MONEY = f"decimal(12,{MONEY_SCALE})"  # prices below a cent stay exact


def nan_to_null(c: Column) -> Column:
    """NaN -> NULL. pandas treats NaN as missing (``NaN > 0`` is false and
    ``dropna`` drops it); in Spark ``NaN > 0`` is true and ``max`` returns
    NaN, so floating inputs are normalised once at the scan."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def whole_days(earlier: Column, later: Column) -> Column:
    """Whole elapsed 24-hour days from ``earlier`` to ``later``.

    This is ``(later - earlier).days`` of a Python timedelta: elapsed time
    floored to full days. ``datediff`` counts calendar-date boundaries
    instead (23:00 -> 01:00 next day is 1 there, 0 here).
    """
    return F.timestamp_diff("DAY", earlier, later)


def first_word(c: Column) -> Column:
    """Text before the first blank: ``SUBSTR(s, 1, INSTR(s || ' ', ' ') - 1)``.

    NULL stays NULL, a leading blank gives ``''``."""
    return F.substring_index(c, " ", 1)


def round_ratio(num_sql: str, den_sql: str, scale: int = 2, mode: str = HALF_UP,
                num_scale: int = 0) -> Column:
    """Exact ``round(num / den, scale)`` as DOUBLE (see :mod:`tillroll.functions.exact`).

    Arguments are SQL snippets so that aggregate calls (``sum(x)``,
    ``count(1)``) can be used inside ``agg``."""
    return F.expr(ratio_round_sql(num_sql, den_sql, scale, mode, num_scale, "spark"))


__all__ = [
    "HALF_EVEN",
    "HALF_UP",
    "MONEY",
    "first_word",
    "MONEY_SCALE",
    "nan_to_null",
    "round_ratio",
    "whole_days",
]
