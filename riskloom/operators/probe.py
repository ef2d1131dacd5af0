"""A linear probe over an embedding column: standardise on dev, choose C on val, predict as array expressions."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.metrics import proper_scores

#: The grid of inverse penalties.
C_GRID = (0.0001, 0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)


@dataclass
class Probe:
    coefficients: list[float]
    intercept: float
    mean: list[float]
    scale: list[float]
    best_c: float
    history: dict[str, float] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Probe:
        return Probe(**json.loads(text))

    def log_odds(self, embedding: Column) -> Column:
        """Null embeddings give null; the weights carry the standardisation, so a row costs one dot product."""
        w = [c / s for c, s in zip(self.coefficients, self.scale, strict=True)]
        shift = self.intercept - float(np.dot(w, self.mean))
        product = F.zip_with(embedding, F.lit(w), lambda x, c: x.cast("double") * c)
        return F.when(F.size(embedding) == len(w), F.aggregate(product, F.lit(shift), lambda s, x: s + x))


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1.0 / (1.0 + F.exp(-z))).otherwise(F.exp(z) / (1.0 + F.exp(z)))


def fit_probe(df: DataFrame, embedding: str, y: str, split: str = "split", grid: tuple[float, ...] = C_GRID, l1_ratio: float = 0.0) -> Probe:
    """The smallest validation log-loss wins, the first of equals."""
    dev = df.where(F.col(split) == "dev").where(F.col(embedding).isNotNull() & F.col(y).isNotNull())
    val = df.where(F.col(split) == "val").where(F.col(embedding).isNotNull() & F.col(y).isNotNull())
    d = dev.select(F.size(embedding)).first()[0]
    moments = dev.select(F.posexplode(embedding).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("s")).orderBy("i").collect()
    mean, scale = [r["m"] for r in moments], [max(r["s"], 1e-12) for r in moments]
    z = F.zip_with(F.zip_with(embedding, F.lit(mean), lambda x, m: x.cast("double") - m), F.lit(scale), lambda x, s: x / s)
    train = dev.select(array_to_vector(z).alias("features"), F.col(y).cast("double").alias("label")).persist()
    n = train.count()
    best, history = None, {}
    for c in grid:
        model = LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=l1_ratio, standardization=False, tol=1e-8, maxIter=500).fit(train)
        probe = Probe(model.coefficients.toArray().tolist(), float(model.intercept), mean, scale, c)
        loss = proper_scores(val.withColumn("_p", sigmoid(probe.log_odds(F.col(embedding)))), [], y, "_p").first()["log_loss"]
        history[str(c)] = loss
        if best is None or loss < history[str(best.best_c)]:
            best = probe
    train.unpersist()
    assert best is not None and len(best.coefficients) == d
    best.history = history
    return best
