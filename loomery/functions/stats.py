"""Association and distribution measures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_likelihood(c11: Column, c1: Column, c2: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio of a pair.

    ``c11`` counts the pair, ``c1`` and ``c2`` its words, ``n`` everything.  Cells (observed
    or expected) that are not positive are left out: words may be counted by sentence and
    pairs by occurrence, so ``c1 - c11`` can be negative.
    """
    c11, c1, c2, n = (x.cast("double") for x in (c11, c1, c2, n))
    cells = [
        (c11, c1 * c2 / n),
        (c1 - c11, c1 * (n - c2) / n),
        (c2 - c11, (n - c1) * c2 / n),
        (n - c1 - c2 + c11, (n - c1) * (n - c2) / n),
    ]
    total = F.lit(0.0)
    for seen, expected in cells:
        total = total + F.when((seen > 0) & (expected > 0), seen * F.ln(seen / expected)).otherwise(F.lit(0.0))
    return 2 * total


def pointwise_information(c: Column, n: Column, *parts: Column) -> Column:
    """``log2(c * n / (p1 * p2 * ...))``."""
    below = F.lit(1.0)
    for part in parts:
        below = below * part.cast("double")
    return F.log2(c.cast("double") * n.cast("double") / below)


def smoothed_share(count: Column, total: Column, kinds: Column, alpha: float = 1.0) -> Column:
    """The add-``alpha`` estimate of a share."""
    return (count + F.lit(alpha)) / (total + F.lit(alpha) * kinds)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def positive_mean(value: Column) -> Column:
    """An aggregate: the mean of the values above 0, 0 where there is none."""
    return F.coalesce(F.avg(F.when(value > 0, value)), F.lit(0.0))
