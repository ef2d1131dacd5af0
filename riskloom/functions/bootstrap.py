"""Bootstrap intervals of any grouped metric, and paired differences of two scores on shared replicates.

A metric is a function (df, groups, y, score, weight) that gives a row per group with the column `value`. All replicates
run in one plan: a row's count in a replicate is Poisson(1), drawn from a hash of key, replicate and seed, so a lost task
draws the same again. The metrics of this module are drawn as vectors of all replicates (`resampling`); any other metric runs
on rows multiplied by their replicates (`replicated`), with the same counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import metrics, resampling

Metric = Callable[[DataFrame, list[str], str, str, "Column | None"], DataFrame]
#: Groups with fewer rows have an interval of no width, and a p-value of 1.
LEAST_ROWS = 5


def auroc(df: DataFrame, groups: list[str], y: str, score: str, weight: Column | None = None) -> DataFrame:
    return metrics.discrimination(df, groups, y, score, weight).select(*groups, F.col("auroc").alias("value"))


def auprc(df: DataFrame, groups: list[str], y: str, score: str, weight: Column | None = None) -> DataFrame:
    return metrics.discrimination(df, groups, y, score, weight).select(*groups, F.col("auprc").alias("value"))


def _mean_of(term: Column, df: DataFrame, groups: list[str], y: str, score: str, weight: Column | None) -> DataFrame:
    d = metrics._clean(df, groups, y, score, weight)
    return d.groupBy(*groups).agg(F.coalesce(F.try_divide(F.sum(F.col("_w") * term), F.sum("_w")), F.lit(0.0)).alias("value"))


def _squared() -> Column:
    return F.pow(F.col("_s") - F.col("_y"), 2.0)


def _surprise(eps: float = 1e-15) -> Column:
    p = metrics.clip(F.col("_s"), eps, 1 - eps)
    return -(F.col("_y") * F.ln(p) + (1.0 - F.col("_y")) * F.ln(1.0 - p))


def brier(df: DataFrame, groups: list[str], y: str, score: str, weight: Column | None = None) -> DataFrame:
    return _mean_of(_squared(), df, groups, y, score, weight)


def log_loss(df: DataFrame, groups: list[str], y: str, score: str, weight: Column | None = None, eps: float = 1e-15) -> DataFrame:
    return _mean_of(_surprise(eps), df, groups, y, score, weight)


def event_rate(df: DataFrame, groups: list[str], y: str, score: str, weight: Column | None = None) -> DataFrame:
    return _mean_of(F.col("_y"), df, groups, y, score, weight)


#: name -> (metric, whether a larger value is better, whether it reads probabilities)
METRICS: dict[str, tuple[Metric, bool, bool]] = {"auroc": (auroc, True, False), "auprc": (auprc, True, False), "brier": (brier, False, True), "log_loss": (log_loss, False, True)}


#: Metrics that are means of a term over rows.
MEANS: dict[Metric, Callable[[], Column]] = {brier: _squared, log_loss: _surprise, event_rate: lambda: F.col("_y")}


def poisson_count(key: Column, replicate: Column, seed: int) -> Column:
    """How often a row occurs in a replicate."""
    u = F.pmod(F.xxhash64(key, replicate, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    count, tail = F.lit(0.0), 0.0
    for k in range(9):
        tail += math.exp(-1) / math.factorial(k)
        count = count + (u >= tail).cast("double")
    return count


def replicated(df: DataFrame, key: str, replicates: int = metrics.REPLICATES, seed: int = 42) -> DataFrame:
    """df's rows once per replicate that holds them, with `replicate` and their count `_count`."""
    rows = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return rows.withColumn("_count", poisson_count(F.col(key), F.col("replicate"), seed)).where("_count > 0")


def draws(df: DataFrame, groups: list[str], metric: Metric, y: str, score: str, key: str, replicates: int, seed: int) -> DataFrame:
    """(groups, replicate, value) of a metric. A replicate without a row of a group gives none."""
    if metric in (auroc, auprc):
        return discrimination_sums(df, groups, y, score, key, replicates, seed, metric is auprc).select(*groups, "replicate", F.col("auroc" if metric is auroc else "auprc").alias("value"))
    if metric in MEANS:
        d = metrics._clean(df.withColumn("_key", F.col(key)), [*groups, "_key"], y, score)
        sums = resampling.weighted_sums(d, groups, [F.lit(1.0), MEANS[metric]()], "_key", replicates, seed)
        return sums.where("s0 > 0").select(*groups, "replicate", (F.col("s1") / F.col("s0")).alias("value"))
    return metric(replicated(df.select(*dict.fromkeys([*groups, key, y, score])), key, replicates, seed), [*groups, "replicate"], y, score, F.col("_count"))


def discrimination_sums(df: DataFrame, groups: list[str], y: str, score: str, key: str, replicates: int, seed: int, precision: bool = True) -> DataFrame:
    """(groups, replicate, auroc, auprc); one class gives 0.5 and the prevalence, as without replicates."""
    sums = resampling.ranked_sums(df, groups, y, score, key, replicates, seed, precision=precision).where("positives + negatives > 0")
    ranked = F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("pairs") / (F.col("positives") * F.col("negatives"))).otherwise(0.5)
    return sums.select(*groups, "replicate", ranked.alias("auroc"), F.when(F.col("positives") > 0, F.col("precision") / F.col("positives")).otherwise(0.0).alias("auprc"))


def discrimination_draws(df: DataFrame, groups: list[str], y: str, scores: list[str], key: str = "subject_id", replicates: int = metrics.REPLICATES, seed: int = 42) -> DataFrame:
    """(groups, replicate, score, auroc, auprc) of several scores on replicates that they share."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("_value")) for s in scores)))
    long = df.select(*dict.fromkeys([*groups, key, y]), each.alias("_x")).select(*dict.fromkeys([*groups, key, y]), "_x.*")
    return discrimination_sums(long, [*groups, "score"], y, "_value", key, replicates, seed).select(*groups, "replicate", "score", "auroc", "auprc")


def _bounds(draws: DataFrame, groups: list[str], level: float) -> DataFrame:
    return metrics.interval(draws.where("value IS NOT NULL AND NOT isnan(value)"), groups, "value", level)


def intervals(df: DataFrame, groups: list[str], metric: Metric, y: str, score: str, key: str = "subject_id", replicates: int = metrics.REPLICATES, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(groups, point, low, high, level, replicates) of a metric."""
    d = df.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    point = metric(d, groups, y, score, None).withColumnRenamed("value", "point")
    drawn = _bounds(draws(d, groups, metric, y, score, key, replicates, seed), groups, level)
    sizes = d.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    return _joined(groups, point, sizes, drawn).select(*groups, "point", *_held("point"), F.lit(level).alias("level"), F.lit(replicates).alias("replicates"))


def _joined(groups: list[str], *frames: DataFrame) -> DataFrame:
    on = groups or ["_one"]
    frames = tuple(f if groups else f.withColumn("_one", F.lit(1)) for f in frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, on, "left")
    return out


def _held(point: str) -> list[Column]:
    """The interval, of no width for few rows or without a draw."""
    few = F.col("_n") < LEAST_ROWS
    return [F.when(few, F.col(point)).otherwise(F.coalesce(c, point)).alias(c) for c in ("low", "high")]


def differences(df: DataFrame, groups: list[str], metric: Metric, y: str, b: str, a: str, key: str = "subject_id", replicates: int = metrics.REPLICATES, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(groups, a, b, point, low, high, p) of metric(b) - metric(a). p is twice the share of replicates on the other side
    of zero than the point, between 1 / replicates and 1."""
    d = df.where(F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    both = F.explode(F.array(*(F.struct(F.lit(n).alias("which"), F.col(c).cast("double").alias("x")) for n, c in (("a", a), ("b", b)))))
    kept = list(dict.fromkeys([*groups, key, y]))
    long = d.select(*kept, both.alias("_s")).select(*kept, "_s.*")

    def wide(values: DataFrame, by: list[str]) -> DataFrame:
        of = lambda n: F.max(F.when(F.col("which") == n, F.col("value"))).alias(n)
        return values.groupBy(*by).agg(of("a"), of("b")).withColumn("value", F.col("b") - F.col("a"))

    point = wide(metric(long, [*groups, "which"], y, "x", None), groups).withColumnRenamed("value", "point")
    drawn = wide(draws(long, [*groups, "which"], metric, y, "x", key, replicates, seed), [*groups, "replicate"])
    tails = drawn.groupBy(*groups).agg(F.avg((F.col("value") <= 0).cast("double")).alias("_under"), F.avg((F.col("value") >= 0).cast("double")).alias("_over"))
    sizes = d.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    out = _joined(groups, point, sizes, _bounds(drawn, groups, level), tails)
    p = metrics.clip(2.0 * F.when(F.col("point") >= 0, F.col("_under")).otherwise(F.col("_over")), 1.0 / replicates, 1.0)
    return out.select(*groups, "a", "b", "point", *_held("point"), F.when(F.col("_n") < LEAST_ROWS, 1.0).otherwise(p).alias("p"))


def compare_models(df: DataFrame, groups: list[str], y: str, a: str, b: str, p_a: str, p_b: str, key: str = "subject_id", replicates: int = metrics.REPLICATES, seed: int = 42) -> DataFrame:
    """(groups, measure, a, b, gain, low, high, p): AUROC and AUPRC as B - A of the scores, Brier score and log-loss as A - B of
    the probabilities, so that a positive gain always favours B. Each measure has a seed of its own."""
    parts = []
    for k, (name, (metric, up, probability)) in enumerate(METRICS.items()):
        x, z = (p_a, p_b) if probability else (a, b)
        d = differences(df, groups, metric, y, z if up else x, x if up else z, key, replicates, seed=seed + k)
        first, second = ("a", "b") if up else ("b", "a")
        parts.append(d.select(*groups, F.lit(name).alias("measure"), F.col(first).alias("a"), F.col(second).alias("b"), F.col("point").alias("gain"), "low", "high", "p"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
