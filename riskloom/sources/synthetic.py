"""Made-up predictions for a cohort: rule scores A, probabilities B from made-up embeddings, and labels where the cohort has none.

Every value is drawn from a hash of subject, study, a name and the seed: a lost task draws the same again, rows don't
depend on each other, and no table passes through the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators import rulescore, splits
from riskloom.operators.probe import sigmoid

KEYS = ("subject_id", "study_id")
#: A is gamma distributed and ends at the top; the weights of log-odds; the least number of events.
SHAPE, SCALE, TOP = 3, 4.0, 45.0
DIM, SLOPE, SPREAD, LEVEL = 16, 0.08, 0.2, -1.5
LABEL_A, LABEL_B, LABEL_LEVEL, LEAST_EVENTS = 0.12, 2.5, -3.2, 5
OUTCOMES = ("mortality_30d", "mortality_90d", "mortality_1yr")


def uniform(seed: int, name: str, *more: Column) -> Column:
    """Between 0 and 1, neither included; the same for the same row, name and seed."""
    return (F.pmod(F.xxhash64(*KEYS, F.lit(name), *more, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normals(seed: int, dim: int = DIM) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.sqrt(-2.0 * F.ln(uniform(seed, "radius", i))) * F.cos(2.0 * math.pi * uniform(seed, "angle", i)))


def _labelled(df: DataFrame, seed: int) -> DataFrame:
    """df with outcomes by A and B, the same at every horizon; where fewer than LEAST_EVENTS came up, the first rows by key have one too."""
    drawn = uniform(seed, "label") < sigmoid(LABEL_A * F.col("model_a_score") + LABEL_B * F.col("model_b_score") + LABEL_LEVEL)
    df = df.withColumn("_event", drawn)
    if (df.agg(F.count_if("_event")).first()[0]) < LEAST_EVENTS:
        first = df.select(*KEYS).orderBy(*KEYS).limit(LEAST_EVENTS).withColumn("_first", F.lit(True))
        df = df.join(F.broadcast(first), list(KEYS), "left").withColumn("_event", F.col("_event") | F.coalesce("_first", F.lit(False))).drop("_first")
    return df.withColumns({o: F.col("_event") for o in OUTCOMES}).drop("_event")


def simulate(cohort: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(predictions, embeddings) for a cohort of one row per subject with a split. embeddings: the keys, split, mortality_30d, embedding."""
    weights = np.random.default_rng(seed).normal(size=DIM).tolist()
    labels = [o for o in OUTCOMES if o in cohort.columns]
    a = F.least(-SCALE * sum((F.ln(uniform(seed, f"gamma {k}")) for k in range(SHAPE)), F.lit(0.0)), F.lit(TOP))
    made = cohort.select(*KEYS, "split", *labels).withColumn("model_a_score", a).withColumn("embedding", normals(seed))
    product = F.aggregate(F.zip_with("embedding", F.lit(weights), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    made = made.withColumn("model_b_log_odds", SLOPE * F.col("model_a_score") + SPREAD * product + LEVEL).withColumn("model_b_score", sigmoid(F.col("model_b_log_odds")))
    if OUTCOMES[0] not in labels:
        made = _labelled(made.drop(*labels), seed)
        labels = list(OUTCOMES)
    none = F.lit(None).cast("string")
    predictions = made.select(
        *KEYS, "split", *labels, "model_a_score", rulescore.category(F.col("model_a_score")).alias("model_a_category"), F.lit(True).alias("model_a_valid"), none.alias("model_a_error"),
        "model_b_score", "model_b_log_odds", F.lit(True).alias("model_b_valid"), none.alias("model_b_error"),
    )
    splits.verify_predictions(predictions)
    return predictions, made.select(*KEYS, "split", OUTCOMES[0], "embedding")
