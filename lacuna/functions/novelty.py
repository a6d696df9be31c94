"""Scores of links as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Shares of the two signals in hybrid mode.
WEIGHTS = {"lift": 0.55, "comention": 0.45}


def normalized(value: Column, *keys: str) -> Column:
    """value over the largest of its partition; 0 where that is not positive."""
    top = F.max(value).over(Window.partitionBy(*keys))
    return F.when(top > 0, value / top).otherwise(F.lit(0.0))


def specificity(works: Column) -> Column:
    return 1 / (1 + F.log10(F.greatest(F.coalesce(works, F.lit(0)).cast("double"), F.lit(10.0))))


def leg(ab: Column, bc: Column) -> Column:
    return F.sqrt(F.greatest(ab, F.lit(1e-6)) * F.greatest(bc, F.lit(1e-6)))


def safe_div(num: Column, den: Column, default=0.0) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(default))


def lift(direct: Column, wa: Column, wc: Column, corpus_size: Column) -> Column:
    """Direct works over those expected by chance; unknown counts are 10, the expectation at least a half."""
    ten = lambda c: F.when(F.coalesce(c, F.lit(0)) == 0, F.lit(10.0)).otherwise(c.cast("double"))
    return direct / F.greatest(ten(wa) * ten(wc) / F.greatest(corpus_size.cast("double"), F.lit(1.0)), F.lit(0.5))


def lift_novelty(direct: Column, wa: Column, wc: Column, corpus_size: Column, max_lift: float = 2.0) -> Column:
    """The lift signal of the rich modes: counts at least 10, the lift at most max_lift, 4 decimals."""
    at_least = lambda c: F.greatest(F.coalesce(c, F.lit(0)).cast("double"), F.lit(10.0))
    expected = F.greatest(at_least(wa) * at_least(wc) / F.greatest(corpus_size.cast("double"), F.lit(1.0)), F.lit(0.5))
    return F.round(1 / (1 + F.least(direct / expected, F.lit(max_lift))), 4)


def comention_novelty(hits: Column, scale: float = 30.0) -> Column:
    """From the number of works that mention both; null stands for unknown."""
    h = hits.cast("double")
    return F.when(hits.isNull(), F.lit(0.5)).when(hits <= 0, F.lit(0.95)).when(h <= scale, F.round(F.lit(0.85) - F.lit(0.35) * h / scale, 3)).otherwise(F.round(F.least(F.lit(0.4), scale / h), 3))


def blended(signals: list[tuple[Column, Column]]) -> Column:
    """Mean of (value, weight), those without a positive weight left out; the first value if none is left."""
    if not signals:
        return F.lit(0.5)
    weight = [F.when(w > 0, w).otherwise(F.lit(0.0)) for _, w in signals]
    total = sum(weight[1:], weight[0])
    mean = sum((v * w for (v, _), w in zip(signals[1:], weight[1:])), signals[0][0] * weight[0])
    return F.when(total > 0, F.round(F.round(mean / total, 9), 4)).otherwise(signals[0][0])  # halves count as halves, whatever a sum's last bit


def verdict(hits: Column, open_max: int = 0, emerging_max: int = 30) -> Column:
    return F.when(hits.isNull() | (hits < 0), "unverified").when(hits <= open_max, "open").when(hits <= emerging_max, "emerging").otherwise("established")


def verified_novelty(hits: Column, open_max: int = 0, emerging_max: int = 30) -> Column:
    """Null if unverified. Above emerging_max the numerator stays 30, whatever the band."""
    h, span = hits.cast("double"), float(max(emerging_max - open_max, 1))
    return F.when(hits.isNull() | (hits < 0), F.lit(None).cast("double")).when(hits <= open_max, F.lit(0.95)).when(hits <= emerging_max, F.round(F.lit(0.85) - F.lit(0.35) * (h - open_max) / span, 3)).otherwise(F.round(F.least(F.lit(0.4), 30.0 / h), 3))


def verdict_note(hits: Column, open_max: int = 0, emerging_max: int = 30) -> Column:
    v = verdict(hits, open_max, emerging_max)
    n = hits.cast("string")
    return (
        F.when(v == "unverified", F.lit("No count of works that mention both."))
        .when(v == "open", F.concat(n, F.lit(" works mention both: open.")))
        .when(v == "emerging", F.concat(n, F.lit(" works mention both: emerging.")))
        .otherwise(F.concat(n, F.lit(" works mention both: established.")))
    )
