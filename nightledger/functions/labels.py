"""Bands, tiers and signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels in their display order.
EXPERIENCE_TIERS = ["New (<1yr)", "Growing (1-3yr)", "Established (3-6yr)", "Veteran (6yr+)"]
PRICE_CATEGORIES = ["Budget", "Mid-Range", "Premium", "Luxury"]
OVERPRICED = "Possibly Overpriced"
UNDERPRICED = "Possibly Underpriced"
WELL_PRICED = "Well-Priced"
RISK_LEVELS = ["High Risk", "Moderate Risk", "Healthy"]


def experience_tier(years: Column) -> Column:
    """Right-closed bins ending at 1, 3, 6 and 100 years."""
    new, growing, established, veteran = EXPERIENCE_TIERS
    return (
        F.when(years <= -0.01, None)
        .when(years <= 1, new)
        .when(years <= 3, growing)
        .when(years <= 6, established)
        .when(years <= 100, veteran)
    )


def price_category(price: Column, q1: Column, q2: Column, q3: Column) -> Column:
    """Quartile band; a value on an edge belongs to the lower band."""
    budget, mid, premium, luxury = PRICE_CATEGORIES
    return (
        F.when(price <= q1, budget)
        .when(price <= q2, mid)
        .when(price <= q3, premium)
        .when(price > q3, luxury)
    )


def pricing_signal(gap: Column, threshold: float = 20) -> Column:
    """F18; a missing gap counts as well priced."""
    return (
        F.when(gap > threshold, OVERPRICED)
        .when(gap < -threshold, UNDERPRICED)
        .otherwise(WELL_PRICED)
    )


def pricing_signal_pct(gap: Column, price: Column, threshold: float = 0.2) -> Column:
    """The gap judged relative to the base price."""
    relative = F.try_divide(gap.cast("double"), price.cast("double"))
    return (
        F.when(relative > threshold, OVERPRICED)
        .when(relative < -threshold, UNDERPRICED)
        .otherwise(WELL_PRICED)
    )


def performance_tier(occupancy: Column, score: Column) -> Column:
    """Q03: both cuts must be met."""
    return (
        F.when((occupancy >= 0.60) & (score >= 4.7), "Platinum")
        .when((occupancy >= 0.45) & (score >= 4.4), "Gold")
        .when((occupancy >= 0.30) & (score >= 4.0), "Silver")
        .otherwise("Needs Improvement")
    )


def review_score_bucket(score: Column) -> Column:
    return (
        F.when(score >= 4.8, "4.8 - 5.0 (Excellent)")
        .when(score >= 4.5, "4.5 - 4.8 (Very Good)")
        .when(score >= 4.0, "4.0 - 4.5 (Good)")
        .otherwise("Below 4.0")
    )


def risk_level(is_stale: Column, occupancy: Column) -> Column:
    high, moderate, healthy = RISK_LEVELS
    stale, low = is_stale == 1, occupancy < 0.30
    return F.when(stale & low, high).when(stale | low, moderate).otherwise(healthy)


def amenity_tier(count: Column) -> Column:
    return (
        F.when(count >= 20, "20+ amenities")
        .when(count >= 10, "10-19 amenities")
        .otherwise("Under 10 amenities")
    )


def sort_position(c: Column, order: list[str]) -> Column:
    """1-based place of a label in a custom order, 0 when it is not listed."""
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in order]), c), F.lit(0))
