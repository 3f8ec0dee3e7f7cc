"""Quintile scores, segments and loyalty tiers."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from clientele.functions.text import label

QUINTILES = (0.2, 0.4, 0.6, 0.8)
FEATURES = ("Recency", "Frequency", "Monetary")

# Recency-frequency codes and the segment each one names.
SEGMENTS = {
    "[1-2][1-2]": "Hibernating",
    "[1-2][3-4]": "At risk",
    "[1-2]5": "Can't lose them",
    "3[1-2]": "About to sleep",
    "33": "Need attention",
    "[3-4][4-5]": "Loyal customers",
    "41": "Promising",
    "51": "New customers",
    "[4-5][2-3]": "Potential loyalists",
    "5[4-5]": "Champions",
}

# The description shown with each segment.
SEGMENT_DESCRIPTIONS = {
    "Hibernating": "Customers with low recency, frequency, and monetary values. They may need re-engagement.",
    "At risk": "Customers who have not made purchases recently and are at risk of churning.",
    "Can't lose them": "High-value customers who have not been active recently. High priority for retention.",
    "About to sleep": "Customers with low engagement who may stop purchasing soon.",
    "Need attention": "Customers who need attention to prevent them from churning.",
    "Loyal customers": "Customers who purchase frequently and recently, showing loyalty.",
    "Promising": "Customers with potential to become loyal if nurtured properly.",
    "New customers": "Recently acquired customers with the potential for future loyalty.",
    "Potential loyalists": "Customers showing signs of becoming loyal with a bit more engagement.",
    "Champions": "Top customers with high recency, frequency, and monetary values. They are the most valuable.",
}

# A tier applies from above its score; the highest that fits wins.
TIERS = {10: "Platinum", 9: "Gold", 7: "Silver", 5: "Bronze"}
BASE_TIER = "Green"

# The description shown with each tier.
TIER_DESCRIPTIONS = {
    "Platinum": "Top tier customers with the highest RFM scores, representing the most valuable and loyal customers.",
    "Gold": "High tier customers with strong loyalty and value, just below Platinum.",
    "Silver": "Mid-tier customers with moderate loyalty and value.",
    "Bronze": "Lower tier customers who are less engaged or at risk of churning.",
    "Green": "New or low-engagement customers who haven’t yet shown strong purchasing behavior.",
}


def band(value: Column, cuts: Sequence[float], highest_first: bool = False) -> Column:
    """Band 1..n+1 of ``value`` between sorted cuts; a value on a cut stays below it.

    ``highest_first`` numbers the bands downwards (few days since the last visit
    score high). A null value lies in no band and takes the last number.
    """
    last = len(QUINTILES) + 1
    passed = sum(((value > F.lit(cut)).cast("int") for cut in cuts), F.lit(1))
    number = F.coalesce(passed, F.lit(last))
    return (F.lit(last + 1) - number) if highest_first else number


def digits(*scores: Column) -> Column:
    return F.concat(*[s.cast("string") for s in scores])


def segment(recency: Column, frequency: Column) -> Column:
    """The segment of a code, looked up in a constant array of all codes."""
    steps = range(1, len(QUINTILES) + 2)
    names = [next(s for p, s in SEGMENTS.items() if re.fullmatch(p, f"{r}{f}")) for r in steps for f in steps]
    return F.element_at(F.array(*[F.lit(n) for n in names]), (recency - 1) * len(steps) + frequency)


def segment_description(segment_name: Column) -> Column:
    return label(segment_name, SEGMENT_DESCRIPTIONS)


def tier(score: Column) -> Column:
    first, *rest = TIERS.items()
    chain = F.when(score > first[0], first[1])
    return reduce(lambda c, rule: c.when(score > rule[0], rule[1]), rest, chain).otherwise(BASE_TIER)


def tier_description(tier_name: Column) -> Column:
    return label(tier_name, TIER_DESCRIPTIONS)
