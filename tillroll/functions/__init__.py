"""Column-level helpers (all built-in Catalyst expressions)."""

from tillroll.functions.columns import (
    HALF_EVEN,
    HALF_UP,
    MONEY,
    MONEY_SCALE,
    first_word,
    nan_to_null,
    round_ratio,
    whole_days,
)
from tillroll.functions.dates import date_attributes

__all__ = [
    "HALF_EVEN",
    "HALF_UP",
    "MONEY",
    "MONEY_SCALE",
    "date_attributes",
    "first_word",
    "nan_to_null",
    "round_ratio",
    "whole_days",
]
