"""Exact rounding of a ratio, as a SQL expression for Spark and DuckDB.

The reports round means (``ROUND(AVG(x), 2)``) and shares. Averaging a
DECIMAL in floating point and rounding afterwards is not stable: a mean
that is exactly a half cent in decimal (12.345) is 12.3449999... as a
double, and the two engines (or two runs with another summation order)
round it differently. Both numerator and denominator are exact here
(integer counts, DECIMAL sums), so the ratio is rounded in integer
arithmetic instead and only the final, already-rounded value becomes a
double. The same template renders for Spark (``div``) and DuckDB (``//``),
which is what keeps the oracle comparison hash-stable.
"""

from __future__ import annotations

HALF_UP = "half_up"  # SQL ROUND: ties away from zero
HALF_EVEN = "half_even"  # pandas/NumPy round: ties to even


def _int_type(dialect: str) -> str:
    return "decimal(38,0)" if dialect == "spark" else "HUGEINT"


def _idiv(dialect: str) -> str:
    return "div" if dialect == "spark" else "//"


def ratio_round_sql(
    num: str,
    den: str,
    scale: int = 2,
    mode: str = HALF_UP,
    num_scale: int = 0,
    dialect: str = "spark",
) -> str:
    """SQL for ``round(num / den, scale)`` computed exactly, as DOUBLE.

    ``num`` may carry at most ``num_scale`` decimal places (0 for integer
    sums, 2 for money); ``den`` must be a positive integer expression. The
    result is NULL when ``den`` is NULL or 0 (an empty group has no mean).
    """
    it = _int_type(dialect)
    div = _idiv(dialect)
    a = f"cast(({num}) * {10 ** (scale + num_scale)} as {it})"
    b = f"cast(({den}) * {10 ** num_scale} as {it})"
    mag = f"abs({a})"
    if mode == HALF_UP:
        q = f"((2 * {mag} + {b}) {div} (2 * {b}))"
    elif mode == HALF_EVEN:
        q0 = f"({mag} {div} {b})"
        r2 = f"(2 * ({mag} - {q0} * {b}))"
        q = (
            f"({q0} + CASE WHEN {r2} > {b} THEN 1 "
            f"WHEN {r2} = {b} THEN {q0} % 2 ELSE 0 END)"
        )
    else:
        raise ValueError(f"unknown rounding mode {mode!r}")
    signed = f"(CASE WHEN {a} < 0 THEN -{q} ELSE {q} END)"
    return (
        f"(CASE WHEN ({den}) IS NULL OR ({den}) = 0 THEN NULL "
        f"ELSE cast({signed} as double) / {10 ** scale}.0 END)"
    )
