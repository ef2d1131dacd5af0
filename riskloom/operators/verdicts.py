"""Rules that turn ratios, intervals and p-values into verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
MEANINGFUL_RATIO = 1.5
INFINITE_IN_MEAN = 3.0
SIGNIFICANT = 0.05


def gradients(rates: DataFrame, group: str, order: Column, rate: str = "rate") -> DataFrame:
    """(group, ratio, infinite, meaningful): the last stratum's rate over the first's, one row per group.
    A group with one stratum, or with both rates zero, has 1; an infinite ratio counts as INFINITE_IN_MEAN."""
    ends = rates.groupBy(group).agg(F.min_by(rate, order).alias("first"), F.max_by(rate, order).alias("last"))
    infinite = (F.col("first") == 0) & (F.col("last") > 0)
    ratio = F.when(infinite, INFINITE_IN_MEAN).when(F.col("first") == 0, 1.0).otherwise(F.try_divide("last", "first"))
    return ends.select(group, ratio.alias("ratio"), infinite.alias("infinite"), (ratio >= MEANINGFUL_RATIO).alias("meaningful"))


def correlation_verdict(rho: Column, p: Column) -> Column:
    return F.when((rho > 0) & (p < SIGNIFICANT), "supported").otherwise("not supported")


def gradient_verdict(meaningful: Column, groups: Column) -> Column:
    """How many of the groups have a meaningful gradient."""
    return F.when((groups > 0) & (meaningful == groups), "supported").when(meaningful > 0, "partly supported").otherwise("not supported")


def contrast_verdict(difference_low: Column, difference_high: Column, ratio_low: Column) -> Column:
    """Risk difference and ratio by their intervals."""
    return F.when((difference_low > 0) & (ratio_low > 1), "supported").when((difference_low <= 0) & (difference_high >= 0), "inconclusive").otherwise("not supported")


def gain_verdict(low: Column, point: Column, high: Column) -> Column:
    """Whether B adds to A, by the interval of the gain."""
    return F.when(low > 0, "supported").when((point > 0) & (high > 0), "inconclusive").otherwise("not supported")


def recommendation(low: Column, point: Column, high: Column) -> Column:
    """Whether an external validation is justified by the interval of the gain."""
    return F.when(low > 0, "justified").when((point > 0) & (high > 0), "inconclusive").otherwise("not justified")


#: Claims that an evaluation within the same domain must not make.
PROHIBITED_CLAIMS = ("external validation", "externally validated", "independent validation cohort", "independent external validation", "zero prior exposure to mimic", "completely unseen dataset")


def prohibited_claims(text: Column) -> Column:
    """The prohibited phrases that a text holds, in any case; none for a null text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*map(F.lit, PROHIBITED_CLAIMS)), lambda p: F.contains(low, p))


def gain_is_significant(low: Column) -> Column:
    """Whether a gain counts as incremental information: its interval lies above zero. It says nothing of clinical use."""
    return F.coalesce(low > 0, F.lit(False))
