"""Column helpers shared by every operator. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_or_col(c) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half toward +infinity, the rule scores are published with (-1.25 -> -1.2 at one digit)."""
    if digits == 0:
        return F.floor(x + 0.5).cast("int")
    p = 10.0**digits
    return F.floor(x * p + 0.5) / p


def at_most(x: Column, hi: float) -> Column:
    """Upper bound that keeps NULL (``least`` alone would return the bound)."""
    return F.when(x.isNotNull(), F.least(x, F.lit(float(hi))))


def at_least(x: Column, lo: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(float(lo))))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def scale100(x: Column, a: float, b: float) -> Column:
    """Linear map of [a, b] onto [0, 100], clamped."""
    return clamp((x - F.lit(float(a))) / F.lit(float(b - a)) * 100.0, 0, 100)


def scale_unit(x: Column, a: float, b: float) -> Column:
    """Linear map of [a, b] onto [-1, 1], clamped; 0 for an empty interval."""
    if a == b:
        return F.lit(0.0)
    return clamp((x - F.lit(float(a))) * 2.0 / F.lit(float(b - a)) - 1.0, -1, 1)


def finite(x: ColumnLike) -> Column:
    """NULL for NULL, NaN and infinities, otherwise the value."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def finite_or(x: ColumnLike, fallback) -> Column:
    return F.coalesce(finite(x), lit_or_col(fallback))


def text_or(x: ColumnLike, fallback: ColumnLike) -> Column:
    """Fallback for NULL and for the empty string."""
    return F.coalesce(F.nullif(col(x), F.lit("")), col(fallback))


def ratio(a: Column, b: Column) -> Column:
    """Division that yields NULL on a zero denominator."""
    return F.try_divide(a, b)


def log_to_pct(x: Column) -> Column:
    return (F.exp(x) - 1.0) * 100.0


def log_return(cur: Column, prev: Column) -> Column:
    """0 when either price is not positive, NULL when there is no previous price."""
    return F.when(prev.isNull(), F.lit(None).cast("double")).otherwise(
        F.when((prev > 0) & (cur > 0), F.ln(ratio(cur, prev))).otherwise(0.0)
    )


def years_between(later: ColumnLike, earlier: ColumnLike) -> Column:
    return F.datediff(col(later), col(earlier)) / F.lit(365.25)


def rounded(x: ColumnLike, digits: int = 4) -> Column:
    """Round for publication.

    A nudge far below the last digit sends exact ties upward instead of leaving them to the noise of the last
    bit; adding 0.0 removes the sign of a negative zero.
    """
    return F.round(col(x) + 1e-9, digits) + F.lit(0.0)


def lookup(key: ColumnLike, table: dict, default=None) -> Column:
    """CASE over a small fixed table."""
    out = None
    for k, v in table.items():
        cond = col(key) == F.lit(k)
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return out.otherwise(F.lit(default))


def score_band(score: ColumnLike) -> Column:
    s = col(score)
    return (
        F.when(s >= 72, "strong").when(s >= 60, "good").when(s >= 46, "neutral").when(s >= 32, "weak").otherwise("poor")
    )


# --- display formats -----------------------------------------------------------------------------------


def signed_pct(x: Column, digits: int = 1) -> Column:
    return F.concat(F.when(x >= 0, "+").otherwise(""), F.format_string(f"%.{digits}f%%", x))


def price_text(x: Column) -> Column:
    return F.when(x >= 1000, F.format_number(x, 2)).otherwise(F.format_string("%.2f", x))


def pct_text(x: Column, digits: int = 2, signed: bool = True) -> Column:
    body = F.format_string(f"%.{digits}f%%", x)
    return F.concat(F.when(x > 0, "+").otherwise(""), body) if signed else body


def cap_text(billions: Column) -> Column:
    return (
        F.when(billions >= 1000, F.format_string("$%.2fT", billions / 1000))
        .when(billions >= 1, F.format_string("$%.0fB", billions))
        .otherwise(F.format_string("$%.0fM", billions * 1000))
    )


def times_text(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}fx", x)
