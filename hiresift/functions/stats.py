"""Interval statistics as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96
MIN_N_GRADED = 30


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """95% Wilson bounds of k/n as fractions; (0, 1) when n is 0."""
    nn, z2 = n.cast("double"), z * z
    p = F.try_divide(k.cast("double"), nn)
    denom = 1 + F.try_divide(F.lit(z2), nn)
    centre = (p + F.try_divide(F.lit(z2), 2 * nn)) / denom
    half = z * F.sqrt(F.try_divide(p * (1 - p), nn) + F.try_divide(F.lit(z2), 4 * nn * nn)) / denom
    low = F.when(n <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half))
    high = F.when(n <= 0, 1.0).otherwise(F.least(F.lit(1.0), centre + half))
    return low, high


def fisher(r: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """95% bounds of a correlation; (-1, 1) when n <= 3."""
    clamped = F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), r))
    fz = F.atanh(clamped)
    se = F.try_divide(F.lit(1.0), F.sqrt(F.greatest(n - 3, F.lit(0)).cast("double")))
    low = F.when(n <= 3, -1.0).otherwise(F.tanh(fz - z * se))
    high = F.when(n <= 3, 1.0).otherwise(F.tanh(fz + z * se))
    return F.when(r.isNotNull(), low), F.when(r.isNotNull(), high)


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson r, null below 3 points or without variance (ANSI-safe)."""
    usable = (F.count(x) >= 3) & (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(usable, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def strength(r: Column, low: Column, high: Column, n: Column) -> Column:
    sign = F.when(r > 0, "positive").otherwise("negative")
    graded = F.when(F.abs(r) >= 0.5, "strong").when(F.abs(r) >= 0.3, "moderate").otherwise("weak")
    return (F.when(r.isNull(), F.lit(None)).when(~distinguishable(low, high), "not distinguishable from zero")
            .when(n < MIN_N_GRADED, F.concat(sign, F.lit(f" (too few to grade, n<{MIN_N_GRADED})"))).otherwise(graded))


def distinguishable(low: Column, high: Column) -> Column:
    return (low > 0) | (high < 0)


def reading(r: Column, low: Column, high: Column, n: Column) -> Column:
    """Plain sentence for one correlation."""
    ci = F.format_string("95%% CI %+.2f to %+.2f, n=%d", low, high, n)
    direction = F.when(r > 0, "higher scores -> more callbacks").otherwise("higher scores -> FEWER callbacks")
    open_case = F.concat(F.format_string("r = %+.2f (", r), ci, F.lit(
        "): not distinguishable from zero — no evidence yet that this score tracks your callbacks"))
    graded = F.concat(strength(r, low, high, n), F.format_string(" correlation, r = %+.2f (", r), ci, F.lit("); "), direction)
    return F.when(r.isNotNull(), F.when(distinguishable(low, high), graded).otherwise(open_case))


def rate_text(k: Column, n: Column) -> Column:
    """'12/40 = 30% (95% CI 18–45%)'."""
    low, high = wilson(k, n)
    pct = F.bround(F.coalesce(F.try_divide(k.cast("double"), n.cast("double")), F.lit(0.0)) * 100, 0)
    return F.format_string("%d/%d = %.0f%% (95%% CI %.0f–%.0f%%)", k, n, pct, F.bround(low * 100, 0), F.bround(high * 100, 0))
