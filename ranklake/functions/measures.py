"""Dates, ages, flags and statistical summaries as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss XXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy")
#: Star scales: limits of p from strict to loose.
STARS = {"percent": ((0.01, "***"), (0.05, "**"), (0.10, "*")), "strict": ((0.001, "***"), (0.01, "**"), (0.05, "*")), "dotted": ((0.001, "***"), (0.01, "**"), (0.05, "*"), (0.10, "."))}


def parse_date(text: Column) -> Column:
    """The first format that fits, in UTC; null where none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])


def age_bucket(date: Column, as_of: Column) -> Column:
    """4 to 0 by days before as_of: 180, 365, 730, 1825; future dates 4, no date 0."""
    days = F.datediff(as_of, date)
    return F.when(days.isNull(), 0).when(days <= 180, 4).when(days <= 365, 3).when(days <= 730, 2).when(days <= 1825, 1).otherwise(0)


def age_years(created: Column, now: Column) -> Column:
    """Years of 365.25 days, 2 digits; zero is null."""
    years = F.round((F.unix_timestamp(now) - F.unix_timestamp(created)) / F.lit(365.25 * 86400), 2)
    return F.nullif(years, F.lit(0.0))


def authority_log(count: Column) -> Column:
    return F.log10(F.coalesce(count, F.lit(0)) + 1)


def brand_proxy(organic: Column, first_places: Column) -> Column:
    return F.coalesce((organic >= 100000) | (first_places >= 500), F.lit(False)).cast("int")


def stars(p: Column, scale: str = "percent") -> Column:
    out = F.lit("")
    for limit, mark in reversed(STARS[scale]):
        out = F.when(p < limit, mark).otherwise(out)
    return out


def effect_sentence(name: Column, coef: Column, p: Column, outcome: Column, level: float = 0.05) -> Column:
    way = F.when(coef > 0, "raises").otherwise("lowers")
    return F.when(p < level, F.format_string("%s %s %s by %.4f", name, way, outcome, F.abs(coef))).otherwise(F.format_string("%s has no clear effect on %s", name, outcome))


def precision_label(backend: Column, precision: Column) -> Column:
    return F.when(backend == "api", "api").when(precision.isin("bf16", "bfloat16"), "bf16").when(precision.isin("int4", "4bit", "nf4"), "int4").when(precision.isin("int8", "8bit"), "int8").otherwise("unknown")


def precision_of_path(path: Column) -> Column:
    return F.when(path.endswith("_local_bf16"), "bf16").when(path.endswith("_local_4bit"), "int4").when(path.endswith("_local"), "local").otherwise("api")


def one_hot(label: Column, values: tuple[str, ...], prefix: str) -> list[Column]:
    """One 0/1 column for each value; a null label gives zeros."""
    return [(F.coalesce(label, F.lit("")) == v).cast("double").alias(f"{prefix}{v}") for v in values]


def normal_tail(z: Column) -> Column:
    """Two-sided normal p-value by the rational approximation 7.1.26 of Abramowitz and Stegun (error under 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def interval(coef: Column, se: Column, z: float = 1.96) -> tuple[Column, Column]:
    return coef - z * se, coef + z * se


def bonferroni(p: Column, n: Column) -> Column:
    """p * n, at most 1 (Bonferroni)."""
    return F.least(p * n, F.lit(1.0))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; null where a side is constant (the built-in one divides by zero)."""
    return F.when((F.max(x) > F.min(x)) & (F.max(y) > F.min(y)), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
