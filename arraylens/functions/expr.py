"""Column expressions with the value rules of the operators.

Missing values are NULL inside the engine, comparisons with them are false, and
divisions never raise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scales of the median absolute deviation; operators use different ones.
MAD_AUTO, MAD_ARRAY, MAD_SQUARE = 1.4826, 1.486, 0.456
EPS64, EPS32 = 2.220446049250313e-16, 1.1920929e-07
INF = float("inf")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """x, or NULL where it is NaN or infinite."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(INF)), x)


def is_true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def at_least(x: Column | str, least: Column | float) -> Column:
    """x >= least; false for NULL and NaN."""
    x = col(x)
    return is_true((x >= least) & ~F.isnan(x))


def above(x: Column | str, least: Column | float) -> Column:
    x = col(x)
    return is_true((x > least) & ~F.isnan(x))


def robust_divide(num: Column | str, den: Column | str, eps: float = EPS64) -> Column:
    """num / den, and +inf where den is no larger than eps or no number, whatever num's sign."""
    num, den = col(num), col(den)
    return F.when(above(F.abs(den), eps), num / den).otherwise(F.lit(INF))


def ieee_divide(num: Column | str, den: Column | str) -> Column:
    """num / den with the infinities and NaN of floating-point arithmetic."""
    num, den = col(num), col(den)
    zero = F.when(F.isnan(num) | (num == 0), F.lit(float("nan"))).when(num > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(den == 0, zero).otherwise(F.try_divide(num, den))


def safe_divide(num: Column | str, den: Column | str) -> Column:
    """num / den, NULL where den is 0."""
    return F.try_divide(col(num), col(den))


def c_mul(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def c_conj(a: tuple[Column, Column]) -> tuple[Column, Column]:
    return a[0], -a[1]


def c_div(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    size = b[0] * b[0] + b[1] * b[1]
    re, im = c_mul(a, c_conj(b))
    return safe_divide(re, size), safe_divide(im, size)


def c_abs(re: Column | str, im: Column | str) -> Column:
    return F.hypot(col(re), col(im))


def c_arg(re: Column | str, im: Column | str) -> Column:
    return F.atan2(col(im), col(re))


def upper_median(values: Column) -> Column:
    """Element n div 2 (from 0) of the sorted array; NULL if it is empty."""
    return F.try_element_at(F.sort_array(values), (F.size(values) / 2).cast("int") + 1)


def r6(x: Column | str) -> Column:
    return F.round(col(x), 6)
