"""Scores: weights, ages, decay, similarity, tiers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemoframe.functions.text import col

# Constants that results depend on.
WEIGHTS = {"high": 1.3, "medium": 1.1, "low": 0.9}
RECENCY_DAYS, RECENCY_FLOOR = 180.0, 0.7
DECAY_FLOOR = 0.70
HALF_LIVES = {"high": 90.0, "medium": 60.0, "low": 14.0}
DEFAULT_HALF_LIFE = 45.0
HABIT_HALF_LIFE = 60.0
RRF_K = 60
DAY = 86400


def weight_factor(weight: Column | str) -> Column:
    """1.3, 1.1 or 0.9 for high, medium or low in any case, else 1.0."""
    w = F.lower(F.coalesce(col(weight), F.lit("")))
    out = F.when(w == "high", WEIGHTS["high"])
    for name in ("medium", "low"):
        out = out.when(w == name, WEIGHTS[name])
    return out.otherwise(1.0)


def age_days(then: Column | str, now: int) -> Column:
    """Whole days since an epoch second."""
    return F.floor((F.lit(now) - col(then)) / F.lit(DAY)).cast("long")


def is_expired(expires: Column | str, now: int) -> Column:
    """Whether ``now`` is after the midnight that begins the date; no usable date: false."""
    day = F.try_to_date(F.btrim(col(expires)), "yyyy-MM-dd")
    return F.coalesce(F.timestamp_seconds(F.lit(now)) > day.cast("timestamp"), F.lit(False))


def recency_boost(last: Column | str, in_30_days: Column | str, now: int) -> Column:
    """(1 + min(0.5, 0.05 n)) times e^(-age/180) of at least 0.7; 1 without any access; an unset last access doesn't decay."""
    last, n = col(last), F.coalesce(col(in_30_days), F.lit(0))
    fresh = F.when(last > 0, F.greatest(F.lit(RECENCY_FLOOR), F.exp(-((F.lit(now) - last) / F.lit(float(DAY))) / RECENCY_DAYS))).otherwise(1.0)
    return F.when(last.isNull(), 1.0).otherwise((1 + F.least(F.lit(0.5), F.lit(0.05) * n)) * fresh)


def half_decay(age: Column | str, half_life: Column | float) -> Column:
    """e^(-ln 2 age / half life), ages under zero as zero."""
    half_life = F.lit(half_life) if isinstance(half_life, float) else half_life
    return F.exp(F.lit(-math.log(2)) * F.greatest(col(age), F.lit(0.0)) / half_life)


def decay_factor(last: Column | str, weight: Column | str, now: int) -> Column:
    """Half-life decay by weight since the last access, of at least 0.70; 1 if never accessed."""
    w = F.lower(F.coalesce(col(weight), F.lit("")))
    life = F.when(w == "high", HALF_LIVES["high"]).when(w == "medium", HALF_LIVES["medium"]).when(w == "low", HALF_LIVES["low"]).otherwise(DEFAULT_HALF_LIFE)
    age = (F.lit(now) - col(last)) / F.lit(float(DAY))
    return F.when(col(last).isNull() | (col(last) <= 0), 1.0).otherwise(F.greatest(F.lit(DECAY_FLOOR), half_decay(age, life)))


def corroboration_boost(count: Column | str) -> Column:
    """1 + 0.05 ln(1 + the count beyond the first); a null count gives 1."""
    return 1 + F.lit(0.05) * F.log1p(F.greatest(F.coalesce(col(count), F.lit(0)) - 1, F.lit(0)).cast("double"))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays of numbers in double; 0 for different lengths or a zero vector."""
    a, b = (F.transform(col(x), lambda v: v.cast("double")) for x in (a, b))
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norms = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)) * F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot / F.nullif(norms, F.lit(0.0)))


def confidence_tier(size: Column | str, span_days: Column | str, similarity: Column | str) -> Column:
    """HIGH: five members, 14 days, nothing above 0.50 alike; MEDIUM: three and 7 days; else LOW."""
    size, span, sim = col(size), col(span_days), F.coalesce(col(similarity), F.lit(0.0))
    return F.when((size >= 5) & (span >= 14) & (sim <= 0.50), "HIGH").when((size >= 3) & (span >= 7), "MEDIUM").otherwise("LOW")


def probe_verdict(similarity: Column | str) -> Column:
    """TIGHT from 0.85, NORMAL from 0.70, INVESTIGATE below; null stays null."""
    s = col(similarity)
    return F.when(s >= 0.85, "TIGHT").when(s >= 0.70, "NORMAL").when(s.isNotNull(), "INVESTIGATE")


def novelty_tier(similarity: Column | str) -> Column:
    """By the closest match: HIGH under 0.30, MEDIUM under 0.40, LOW under 0.50, else known; null without anything to compare."""
    s = col(similarity)
    return F.when(s < 0.30, "HIGH").when(s < 0.40, "MEDIUM").when(s < 0.50, "LOW").when(s.isNotNull(), "known")


def cluster_score(references: Column | str, size: Column | str) -> Column:
    """References / 10 + 0.05 a member, at most 1, to two places, halves to even."""
    return F.bround(F.least(F.lit(1.0), col(references) / F.lit(10.0) + F.lit(0.05) * col(size)), 2)
