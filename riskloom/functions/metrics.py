"""Rank and threshold statistics as grouped operators: metric(df, groups, y, score) gives a row per group.

Ranks are built on distinct scores per group. The scores are cut into ZONES ranges of about equal size; windows run within
a group's range, and the sums of the ranges before are added, so that no task sorts a whole group. y is 0/1 (or
boolean), rows with a null y or score take no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of scores that are sorted apart.
ZONES = 64
#: Bootstrap replicates of a 95 % interval, unless a caller asks for another number.
REPLICATES = 1000


def _clean(df: DataFrame, groups: list[str], y: str, score: str, weight: Column | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight.cast("double")
    out = df.select(*groups, F.col(y).cast("double").alias("_y"), F.col(score).cast("double").alias("_s"), w.alias("_w"))
    return out.where("_y IS NOT NULL AND _s IS NOT NULL AND NOT isnan(_s)")


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def proper_scores(df: DataFrame, groups: list[str], y: str, p: str, eps: float = 1e-15) -> DataFrame:
    """n, events, log_loss and brier of probabilities p."""
    d = _clean(df, groups, y, p).withColumn("_p", clip(F.col("_s"), eps, 1 - eps))
    loss = -F.avg(F.col("_y") * F.ln("_p") + (1.0 - F.col("_y")) * F.ln(1.0 - F.col("_p")))
    return d.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").cast("long").alias("events"), F.coalesce(loss, F.lit(0.0)).alias("log_loss"), F.coalesce(F.avg(F.pow(F.col("_s") - F.col("_y"), 2.0)), F.lit(0.0)).alias("brier"))


def discrimination(df: DataFrame, groups: list[str], y: str, score: str, weight: Column | None = None) -> DataFrame:
    """auroc (ties count half; 0.5 with one class) and auprc (average precision over distinct scores; the
    prevalence with one class). `weight` counts rows, as a bootstrap replicate does."""
    d = _clean(df, groups, y, score, weight)
    by = d.groupBy(*groups, "_s").agg(F.sum(F.col("_y") * F.col("_w")).alias("_pos"), F.sum((1.0 - F.col("_y")) * F.col("_w")).alias("_neg"))
    by = running(by, groups, "_s", zone_of(df.select(F.col(score).cast("double").alias("_s")), "_s"), {"_pos": ("_tp", "_p"), "_neg": ("_fp", "_n")}, down=True)
    # a negative below all positives above it, and half of those tied with it
    pairs = F.sum(F.col("_neg") * (F.col("_tp") - F.col("_pos") / 2.0))
    precision = F.sum(F.when(F.col("_tp") + F.col("_fp") > 0, F.col("_pos") * F.col("_tp") / (F.col("_tp") + F.col("_fp"))).otherwise(0.0))
    p, n = F.max("_p"), F.max("_n")
    return by.groupBy(*groups).agg(F.when((p > 0) & (n > 0), pairs / (p * n)).otherwise(0.5).alias("auroc"), F.when(p > 0, precision / p).otherwise(0.0).alias("auprc"))


def zone_of(df: DataFrame, c: str) -> Column:
    """The range that a value of c falls into: the same for equal values, larger for larger ones. The ends are quantiles of df."""
    cuts = df.agg(F.expr(f"percentile_approx({c}, array({', '.join(f'{k / ZONES!r}D' for k in range(1, ZONES))}), 1000)")).first()[0]
    return sum(((F.col(c) >= x).cast("int") for x in sorted({x for x in cuts or [] if x == x})), F.lit(0))


def running(df: DataFrame, groups: list[str], order: str, zone: Column, sums: dict[str, tuple[str, str]], down: bool = False) -> DataFrame:
    """df with two columns for each column of `sums`: its sum over the group's rows up to this one, and over all rows of the group.
    Values of `order` are distinct within a group."""
    d = df.withColumn("_z", zone)
    totals = d.groupBy(*groups, "_z").agg(*(F.sum(c).alias(f"_t{k}") for k, c in enumerate(sums)))  # ZONES rows a group at most
    place = F.desc if down else F.asc
    before = Window.partitionBy(*groups).orderBy(place("_z")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*groups)
    totals = totals.select(*(F.col(g).alias(f"_h{k}") for k, g in enumerate(groups)), F.col("_z").alias("_hz"), *(x for k in range(len(sums)) for x in (F.coalesce(F.sum(f"_t{k}").over(before), F.lit(0.0)).alias(f"_b{k}"), F.sum(f"_t{k}").over(every).alias(f"_e{k}"))))
    same = F.col("_z") == F.col("_hz")
    for k, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_h{k}"))
    upto = Window.partitionBy(*groups, "_z").orderBy(place(order)).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({one: F.sum(c).over(upto) for c, (one, _) in sums.items()}).join(totals, same)
    out = {name: x for k, (one, all_) in enumerate(sums.values()) for name, x in ((one, F.col(one) + F.col(f"_b{k}")), (all_, F.col(f"_e{k}")))}
    return d.withColumns(out).drop("_z", "_hz", *(f"_h{k}" for k in range(len(groups))), *(f"_{x}{k}" for k in range(len(sums)) for x in "be"))


def correlations(df: DataFrame, groups: list[str], a: str, b: str) -> DataFrame:
    """pearson and spearman; 0 with under 3 rows or a constant side."""
    d = df.select(*groups, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL")
    for c in ("_a", "_b"):
        # the rank of a value: the rows up to it less half of its own, and a half
        by = d.groupBy(*groups, c).agg(F.count(F.lit(1)).cast("double").alias("_n"))
        by = running(by, groups, c, zone_of(d, c), {"_n": ("_upto", "_all")})
        ranks = by.select(*(F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)), F.col(c).alias("_v"), (F.col("_upto") - F.col("_n") / 2.0 + 0.5).alias(f"_r{c}"))
        same = F.col(c).eqNullSafe(F.col("_v"))
        for k, g in enumerate(groups):
            same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
        d = d.join(ranks, same).drop("_v", *(f"_g{k}" for k in range(len(groups))))
    rho = lambda x, y: F.when((F.count(F.lit(1)) < 3) | (F.stddev_pop(x) < 1e-12) | (F.stddev_pop(y) < 1e-12), 0.0).otherwise(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
    return d.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), rho("_a", "_b").alias("pearson"), rho("_r_a", "_r_b").alias("spearman"))


def logistic_fit(df: DataFrame, y: str, features: list[Column], penalty: float = 1e-9, steps: int = 60, tol: float = 1e-9) -> list[float]:
    """Intercept and weights of a logistic regression with penalty / 2 * |weights|^2, by damped Newton steps. Each
    step is one aggregate; only its sums reach the driver."""
    import numpy as np

    k = len(features) + 1
    d = df.select(F.col(y).cast("double").alias("_y"), *(f.cast("double").alias(f"_x{i}") for i, f in enumerate(features))).na.drop()
    d.persist()
    xs = [F.lit(1.0), *(F.col(f"_x{i}") for i in range(k - 1))]
    shrink = np.diag([0.0] + [penalty] * (k - 1))

    def sums(beta):
        z = sum((xs[i] * float(beta[i]) for i in range(1, k)), F.lit(float(beta[0])))
        p = 1.0 / (1.0 + F.exp(-z))
        loss = F.sum(F.greatest(z, F.lit(0.0)) - z * F.col("_y") + F.log1p(F.exp(-F.abs(z))))
        row = d.agg(loss, *(F.sum((p - F.col("_y")) * x) for x in xs), *(F.sum(p * (1.0 - p) * xs[i] * xs[j]) for i in range(k) for j in range(i, k))).first()
        if row[0] is None:
            raise ValueError("no complete rows to fit on")
        h, at = np.zeros((k, k)), 1 + k
        for i in range(k):
            for j in range(i, k):
                h[i, j] = h[j, i] = row[at]
                at += 1
        return row[0] + 0.5 * beta @ shrink @ beta, np.array(row[1 : 1 + k]) + shrink @ beta, h + shrink

    try:
        beta = np.zeros(k)
        value, g, h = sums(beta)
        for _ in range(steps):
            step = np.linalg.lstsq(h, g, rcond=None)[0]
            size = 1.0
            while True:
                new = sums(beta - size * step)
                if new[0] <= value + 1e-12 or size < 1e-4:
                    break
                size /= 2
            moved = float(np.abs(size * step).max())
            beta, (value, g, h) = beta - size * step, new
            if moved < tol:
                break
        return beta.tolist()
    finally:
        d.unpersist()


def calibration(df: DataFrame, y: str, p: str, eps: float = 1e-6) -> tuple[float, float]:
    """(slope, intercept) of y on logit(p); (1, 0) with under 10 rows or one class."""
    d = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    n, events = d.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col(y).cast("double")), F.lit(0.0))).first()
    if n < 10 or events in (0, n):
        return 1.0, 0.0
    q = clip(F.col(p).cast("double"), eps, 1 - eps)
    intercept, slope = logistic_fit(d, y, [F.ln(q / (1.0 - q))])
    return slope, intercept


def interval(df: DataFrame, groups: list[str], value: str, level: float = 0.95) -> DataFrame:
    """Percentile interval of replicated values."""
    low = (1 - level) / 2
    return df.groupBy(*groups).agg(F.expr(f"percentile({value}, {low}D)").alias("low"), F.expr(f"percentile({value}, {1 - low}D)").alias("high"))


def chi2_sf_1(x: float) -> float:
    """Upper tail of a chi-square with one degree of freedom."""
    return math.erfc(math.sqrt(max(x, 0.0) / 2))
