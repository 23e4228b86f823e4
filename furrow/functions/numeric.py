"""Number helpers with one fixed operand order, so results are reproducible."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(c: Column, digits: int = 0) -> Column:
    """Round half up on the double itself: ``floor(x * 10^d + 0.5) / 10^d``."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def cents(c: Column) -> Column:
    """Money as whole hundredths; sums of these are exact in any order."""
    return F.floor(c * F.lit(100.0) + F.lit(0.5)).cast("bigint")


def rupees(c: Column) -> Column:
    return c.cast("double") / F.lit(100.0)


def whole(c: Column) -> Column:
    """Round a double of hundredths to a whole number of hundredths."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))


def lenient_double(c: Column) -> Column:
    """Text to number; anything unreadable counts as zero."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def plain_number(c: Column) -> Column:
    """True for digits with at most one dot, the only text accepted as a price."""
    return c.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$")


def sample_std(n: Column, total: Column, squares: Column) -> Column:
    """Sample standard deviation from count, sum and sum of squares (as doubles)."""
    spread = F.greatest(n * squares - total * total, F.lit(0.0))
    return F.when(n > 1, F.sqrt(spread / (n * (n - F.lit(1.0)))))


def population_variance(n: Column, total: Column, squares: Column) -> Column:
    return F.when(n > 0, F.greatest(n * squares - total * total, F.lit(0.0)) / (n * n))


def futures_to_quintal(price: Column, unit: Column, kg: Column, usd_inr: Column, factor: Column) -> Column:
    """Futures quotation to rupees per quintal, rounded before and after the state factor."""
    usd_per_kg = F.when(unit == "cents_bushel", (price / F.lit(100.0)) / kg).otherwise(price / (kg * F.lit(100.0)))
    return round_to(round_to(usd_per_kg * F.lit(100.0) * usd_inr, 2) * factor, 2)


def support_price(base: Column, factor: Column, floor: float) -> Column:
    return round_to(F.greatest(F.lit(float(floor)), base * factor), 2)
