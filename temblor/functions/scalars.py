"""Text, calendar, flag and risk expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


# Spellings of the same magnitude type.
MAG_TYPE_ALIASES = {"mb_lg": "mblg", "mltexnet": "ml", "ms_20": "ms", "ms_vx": "ms"}
# Texts that stand for a missing value.
NULL_TEXTS = ["", "nan", "none", "None"]


def normalize_text(col, fill: str = "unknown") -> Column:
    """Trimmed lower-case text; empty and null-like texts become ``fill``."""
    text = F.regexp_replace(_col(col), r"^\s+|\s+$", "")
    return F.coalesce(F.when(~text.isin(NULL_TEXTS), F.lower(text)), F.lit(fill))


def normalize_mag_type(col) -> Column:
    """Magnitude type without remarks in brackets, blanks, hyphens and aliases."""
    text = F.regexp_replace(normalize_text(col), r"\(.*?\)", "")
    text = F.regexp_replace(text, r"[\s-]+", "")
    chain = None
    for alias, name in MAG_TYPE_ALIASES.items():
        chain = F.when(text == alias, name) if chain is None else chain.when(text == alias, name)
    return chain.otherwise(text)


def season(month) -> Column:
    month = _col(month)
    return (F.when(month.isin(12, 1, 2), "Winter").when(month.isin(3, 4, 5), "Spring")
            .when(month.isin(6, 7, 8), "Summer").otherwise("Autumn"))


def time_of_day(hour) -> Column:
    hour = _col(hour)
    return (F.when((hour >= 6) & (hour < 12), "Morning").when((hour >= 12) & (hour < 18), "Afternoon")
            .when(hour >= 18, "Evening").otherwise("Night"))


def days_since_2000(time) -> Column:
    """Whole days since 2000-01-01, rounded down."""
    micros = F.unix_micros(_col(time)) - F.lit(946684800000000)
    return F.floor(micros / F.lit(86400e6)).cast("bigint")


def cyclic(col, period: float) -> tuple[Column, Column]:
    angle = F.lit(2.0 * math.pi) * _col(col) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def log1p_clipped(col) -> Column:
    """log(1 + x) with nulls and negative values taken as 0."""
    return F.log1p(F.greatest(F.coalesce(_col(col).cast("double"), F.lit(0.0)), F.lit(0.0)))


def flag(test: Column) -> Column:
    return F.when(test, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def data_quality(nst="nst", gap="gap") -> Column:
    nst, gap = _col(nst), _col(gap)
    return (F.when((nst >= 20) & (gap <= 90), "High")
            .when((nst >= 10) & (gap <= 180), "Medium").otherwise("Low"))


def positive_or(col, default: float) -> Column:
    col = _col(col)
    return F.when(col > 0, col).otherwise(F.lit(default))


def sigmoid(col) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(col)))


# Lower limits of risk levels, highest first.
RISK_LEVELS = [(0.7, "HIGH"), (0.4, "MEDIUM"), (None, "LOW")]
MAJOR_RISK_LEVELS = [(0.5, "CRITICAL"), (0.2, "HIGH"), (0.1, "MEDIUM"), (None, "LOW")]


def level(col, limits) -> Column:
    """Name of the first level whose lower limit the value reaches."""
    col, chain = _col(col), None
    for limit, name in limits:
        if limit is None:
            return chain.otherwise(name)
        limit = F.lit(limit) if not isinstance(limit, Column) else limit
        chain = F.when(col >= limit, name) if chain is None else chain.when(col >= limit, name)
    return chain


def alert_level(score, threshold) -> Column:
    """``high`` from 0.18 above the threshold (at most .95), then medium, low."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    high = F.least(F.lit(0.95), threshold + F.lit(0.18))
    return level(score, [(high, "high"), (threshold, "medium"), (None, "low")])


def major_probability(quake_probability, magnitude, center: float = 5.0) -> Column:
    """Probability of a major event: p * sigmoid(magnitude - center)."""
    return _col(quake_probability) * sigmoid(_col(magnitude) - F.lit(center))
