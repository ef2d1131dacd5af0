"""What B adds to A: nested logistic models fitted on the development split and held against the test split."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import bootstrap, metrics

CLIP = 1e-15


def min_max(df: DataFrame, score: str) -> Column:
    """A score between 0 and 1 over df's range of it; 0.5 where all are equal."""
    low, high = df.agg(F.min(F.col(score).cast("double")), F.max(F.col(score).cast("double"))).first()
    return F.lit(0.5) if low is None or low == high else (F.col(score) - low) / (high - low)


def logistic(beta: list[float], xs: list[Column]) -> Column:
    return 1.0 / (1.0 + F.exp(-sum((F.lit(w) * x for w, x in zip(beta[1:], xs, strict=True)), F.lit(beta[0]))))


def both_classes(df: DataFrame, y: str) -> bool:
    low, high = df.agg(F.min(F.col(y).cast("int")), F.max(F.col(y).cast("int"))).first()
    return low is not None and low != high


def calibrated(dev: DataFrame, test: DataFrame, score: str, y: str) -> Column:
    """The probability of y by the score, from a logistic model on dev; the min-max of test where dev has one class."""
    d = dev.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    return logistic(metrics.logistic_fit(d, y, [F.col(score)]), [F.col(score).cast("double")]) if both_classes(d, y) else min_max(test, score)


def nested_models(dev: DataFrame, test: DataFrame, y: str, a: str, b: str) -> tuple[DataFrame, DataFrame, dict[str, list[float]]]:
    """(table, scored test, coefficients). table: model, parameters, log_likelihood, aic, bic on dev, log_loss, auroc, brier on
    test. A stands for its z-value on dev and the square, B for itself. The scored test has p_a, p_b and p_ab."""
    spark = dev.sparkSession
    mean, sd = dev.agg(F.avg(F.col(a).cast("double")), F.stddev_pop(F.col(a).cast("double"))).first()
    z = (F.col(a).cast("double") - mean) / max(sd or 0.0, 1e-12)
    models = {"A": [z, z * z], "B": [F.col(b).cast("double")], "A+B": [z, z * z, F.col(b).cast("double")]}
    label = F.col(y).cast("double")
    fits, names = {m: metrics.logistic_fit(dev, y, xs) for m, xs in models.items()}, {"A": "p_a", "B": "p_b", "A+B": "p_ab"}
    chance = lambda m: metrics.clip(logistic(fits[m], models[m]), CLIP, 1 - CLIP)
    likelihood = dev.agg(F.count(F.lit(1)), *(F.sum(label * F.ln(chance(m)) + (1.0 - label) * F.ln(1.0 - chance(m))) for m in models)).first()
    scored = test.withColumns({names[m]: chance(m) for m in models})
    rows = []
    for k, m in enumerate(models):
        n, ll, size = likelihood[0], float(likelihood[k + 1]), len(fits[m])
        loss, rank = metrics.proper_scores(scored, [], y, names[m]).first(), metrics.discrimination(scored, [], y, names[m]).first()
        rows.append((m, size, ll, 2.0 * size - 2.0 * ll, math.log(n) * size - 2.0 * ll, loss["log_loss"] if loss else 0.0, rank["auroc"] if rank else 0.5, loss["brier"] if loss else 0.0))
    table = spark.createDataFrame(rows, "model string, parameters int, log_likelihood double, aic double, bic double, log_loss double, auroc double, brier double")
    return table, scored, fits


def likelihood_ratio(table: DataFrame) -> tuple[float, float]:
    """Twice the gain in log-likelihood of A+B over A, and its p-value with one degree of freedom."""
    held = {r["model"]: r["log_likelihood"] for r in table.collect()}
    gain = max(2.0 * (held["A+B"] - held["A"]), 0.0)
    return gain, metrics.chi2_sf_1(gain)


def gains(scored: DataFrame, y: str, key: str = "subject_id", replicates: int = metrics.REPLICATES, seed: int = 42) -> DataFrame:
    """(measure, point, low, high, p) on the scored test: AUROC of A+B less that of A, Brier score and log-loss of A less those of A+B."""
    out = None
    for k, name in enumerate(("auroc", "brier", "log_loss")):
        metric, up, _ = bootstrap.METRICS[name]
        d = bootstrap.differences(scored, [], metric, y, "p_ab" if up else "p_a", "p_a" if up else "p_ab", key, replicates, seed=seed + k)
        d = d.select(F.lit(name).alias("measure"), "point", "low", "high", "p")
        out = d if out is None else out.unionByName(d)
    return out
