"""Logistic regressions of many groups and models at once, by damped Newton steps.

A step is one aggregate over the rows: per group, the loss, gradient and Hessian of every model at its own weights, which
travel as a table of one row per group. Rows aren't multiplied by models. Only the sums reach the driver, at most MOST
groups of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most groups of one call.
MOST = 10_000


@dataclass
class Fit:
    """One group's model: intercept and weights, and how it does on the rows it was fitted on."""

    group: tuple
    model: str
    beta: np.ndarray
    n: int = 0
    events: float = 0.0
    log_likelihood: float = 0.0
    value: float = np.inf
    step: np.ndarray = field(default_factory=lambda: np.zeros(0))
    size: float = 1.0
    done: bool = False

    @property
    def candidate(self) -> np.ndarray:
        return self.beta - self.size * self.step if len(self.step) else self.beta

    def take(self, loss: float, gradient: np.ndarray, hessian: np.ndarray, shrink: np.ndarray, tol: float) -> None:
        """Accepts the candidate, or halves the step where the loss grew."""
        at = self.candidate
        value = loss + 0.5 * at @ shrink @ at
        if value > self.value + 1e-12 and self.size >= 1e-4:
            self.size /= 2
            return
        moved = np.inf if not len(self.step) else float(np.abs(self.size * self.step).max())
        self.beta, self.value, self.log_likelihood, self.size = at, value, -loss, 1.0
        self.step = np.linalg.lstsq(hessian + shrink, gradient + shrink @ at, rcond=None)[0]
        self.done = moved < tol


def fit_groups(df: DataFrame, groups: list[str], y: str, models: dict[str, list[Column]], penalty: float = 1e-9, rounds: int = 100, tol: float = 1e-9, both_classes: bool = False) -> list[Fit]:
    """A Fit per group and model over the rows that are complete for all models, with penalty / 2 * |weights|^2 (not on the
    intercept). Groups without a complete row have none, nor those of one class if both_classes is asked for; separable groups
    are fitted as far as the penalty and `rounds` let them."""
    names = [f"_g{k}" for k in range(len(groups))]
    xs = {m: [f"_m{j}_{i}" for i in range(len(features))] for j, (m, features) in enumerate(models.items())}
    columns = [x.cast("double").alias(c) for m, features in models.items() for x, c in zip(features, xs[m], strict=True)]
    flat = [c for held in xs.values() for c in held]
    d = df.select(*(F.col(g).alias(n) for g, n in zip(groups, names, strict=True)), F.col(y).cast("double").alias("_y"), *columns)
    d = d.where(F.col("_y").isNotNull() & ~F.isnan("_y"))
    for c in flat:
        d = d.where(F.col(c).isNotNull() & ~F.isnan(c))
    d.persist()
    try:
        held = d.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("events")).where("n > 0").take(MOST + 1)
        if len(held) > MOST:
            raise ValueError(f"more than {MOST} groups")
        fits = [Fit(tuple(r[n] for n in names), m, np.zeros(len(cs) + 1), r["n"], r["events"]) for r in held if not both_classes or 0 < r["events"] < r["n"] for m, cs in xs.items()]
        for _ in range(rounds):
            if all(f.done for f in fits):
                break
            _round(d, names, xs, fits, df.schema, groups, penalty, tol)
        return fits
    finally:
        d.unpersist()


def _round(d: DataFrame, names: list[str], xs: dict[str, list[str]], fits: list[Fit], schema: T.StructType, groups: list[str], penalty: float, tol: float) -> None:
    open_ = {f.group for f in fits if not f.done}
    weights = {g: [f.candidate.tolist() for f in fits if f.group == g] for g in dict.fromkeys(f.group for f in fits) if g in open_}
    kinds = [T.StructField(f"_k{k}", schema[g].dataType) for k, g in enumerate(groups)]
    table = d.sparkSession.createDataFrame([(*g, w) for g, w in weights.items()], T.StructType([*kinds, T.StructField("_b", T.ArrayType(T.ArrayType(T.DoubleType())))]))
    same = F.lit(True)
    for k, n in enumerate(names):
        same = same & F.col(n).eqNullSafe(F.col(f"_k{k}"))
    met = d.join(F.broadcast(table), same)  # at most MOST rows
    sums: list[Column] = []
    for j, cs in enumerate(xs.values()):
        row = [F.lit(1.0), *map(F.col, cs)]
        z = sum((F.col("_b")[j][i] * x for i, x in enumerate(row)), F.lit(0.0))
        p = 1.0 / (1.0 + F.exp(-z))
        sums.append(F.sum(F.greatest(z, F.lit(0.0)) - z * F.col("_y") + F.log1p(F.exp(-F.abs(z)))))
        sums += [F.sum((p - F.col("_y")) * x) for x in row]
        sums += [F.sum(p * (1.0 - p) * row[i] * row[k]) for i in range(len(row)) for k in range(i, len(row))]
    by_group = {f: [] for f in open_}
    for f in fits:
        if f.group in by_group:
            by_group[f.group].append(f)
    for r in met.groupBy(*names).agg(*(s.alias(f"_s{k}") for k, s in enumerate(sums))).collect():
        values = iter(r[len(names) :])
        for f in by_group[tuple(r[: len(names)])]:
            loss, gradient, hessian = _read(values, len(f.beta))
            if not f.done:
                f.take(loss, gradient, hessian, np.diag([0.0] + [penalty] * (len(f.beta) - 1)), tol)


def _read(values: Iterator[float], k: int) -> tuple[float, np.ndarray, np.ndarray]:
    loss, gradient, hessian = next(values), np.array([next(values) for _ in range(k)]), np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            hessian[i, j] = hessian[j, i] = next(values)
    return loss, gradient, hessian
