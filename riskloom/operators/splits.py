"""Subject-disjoint splits and the guards of the prediction table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import materialize

SPLITS = ("dev", "val", "test")
#: A predictor may hold none of these words, but these columns aren't predictors.
FORBIDDEN = ("age", "gender", "sex", "race", "ethnicity", "admit", "disch", "hadm", "icd", "drg", "vital", "lab", "med", "note", "anchor", "insurance", "language", "marital")
ALLOWED = (
    "subject_id", "study_id", "split", "mortality_30d", "mortality_90d", "mortality_1yr", "inhospital_mortality", "model_a_score",
    "model_a_category", "model_a_valid", "model_a_error", "model_b_score", "model_b_log_odds", "model_b_valid", "model_b_error",
)
#: Columns that a table of predictions has.
REQUIRED = ("subject_id", "study_id", "split", "mortality_30d", "model_a_score", "model_a_category", "model_a_valid", "model_b_score", "model_b_log_odds", "model_b_valid")


@dataclass(frozen=True)
class SplitRatios:
    dev: float = 0.6
    val: float = 0.2
    test: float = 0.2

    def __post_init__(self) -> None:
        if min(self.dev, self.val, self.test) <= 0 or abs(self.dev + self.val + self.test - 1) > 1e-6:
            raise ValueError("ratios are positive and sum to 1")


def hashed_split(df: DataFrame, ratios: SplitRatios = SplitRatios(), seed: int = 42, buckets: int = 10_000) -> DataFrame:
    """A split by a hash of the subject: no shuffle, the same for a subject wherever it occurs, at any scale."""
    bucket = F.pmod(F.pmod(F.col("subject_id"), F.lit(1_000_003)) * 7919 + seed, F.lit(buckets))
    dev, val = int(buckets * ratios.dev), int(round(buckets * (ratios.dev + ratios.val)))
    return df.withColumn("split", F.when(bucket < dev, "dev").when(bucket < val, "val").otherwise("test"))


def positions(df: DataFrame, key: str = "subject_id") -> DataFrame:
    """(key, position): the distinct keys and their places in ascending order, from 0. Ranges of keys are sorted apart; a range's
    first place is the number of keys in the ranges before it."""
    ranged = df.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key)
    # the id holds the range above bit 33 and the row's place within it below
    held = materialize(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranges")
    range_ = F.shiftrightunsigned("_id", 33)
    sizes = held.groupBy(range_.alias("_range")).agg(F.count(F.lit(1)).alias("_n"))  # a row per range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_range", before.alias("_before"))
    within = F.col("_id") - F.shiftleft(range_, 33)
    return held.join(F.broadcast(offsets), range_ == F.col("_range")).select(key, (F.col("_before") + within).alias("position"))


def permuted_split(df: DataFrame, ratios: SplitRatios = SplitRatios(), seed: int = 42) -> DataFrame:
    """The exact sizes of a seeded permutation of the sorted subjects. The permutation is drawn in one task, which holds 8 bytes a
    subject and writes it in pieces; subjects meet it by their places, and none reach the driver."""
    placed = materialize(positions(df.where("subject_id IS NOT NULL")), "positions")
    n = placed.count()
    dev, val = round(n * ratios.dev), round(n * ratios.val)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.random.default_rng(seed).permutation(n)
            for at in range(0, n, 1_000_000):
                rank = np.arange(at, min(n, at + 1_000_000))
                names = pa.array(["dev", "val", "test"]).take(pa.array((rank >= dev).astype(int) + (rank >= dev + val)))
                yield pa.RecordBatch.from_arrays([pa.array(order[rank]), names], ["position", "split"])

    drawn = df.sparkSession.range(1).coalesce(1).mapInArrow(draw, "position long, split string")
    return df.drop("split").join(placed.join(drawn, "position").select("subject_id", "split"), "subject_id", "left")


def overlapping_subjects(df: DataFrame) -> DataFrame:
    """Subjects that occur in more than one split."""
    return df.groupBy("subject_id").agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def verify_disjoint(df: DataFrame) -> None:
    if n := overlapping_subjects(df).count():
        raise ValueError(f"{n} subjects occur in more than one split")


def firewall(columns: list[str]) -> list[str]:
    """Columns that hold a forbidden word (anywhere in the name) and aren't allowed."""
    return [c for c in columns if c not in ALLOWED and any(w in c.lower() for w in FORBIDDEN)]


def verify_firewall(df: DataFrame) -> None:
    if bad := firewall(df.columns):
        raise ValueError(f"forbidden predictors: {', '.join(bad)}")


def verify_predictions(df: DataFrame) -> None:
    """Columns, one row per subject, disjoint splits, split names, firewall; in this order."""
    if missing := [c for c in REQUIRED if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    rows, subjects = df.agg(F.count(F.lit(1)), F.countDistinct("subject_id")).first()
    if rows != subjects:
        raise ValueError(f"{rows} rows for {subjects} subjects")
    verify_disjoint(df)
    if odd := sorted({str(r[0]) for r in df.select("split").distinct().limit(50).collect()} - set(SPLITS)):
        raise ValueError(f"unknown splits: {', '.join(odd)}")
    verify_firewall(df)


def build_predictions(cohort: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """cohort with both models' columns, inner on subject and study; error columns exist in any case."""
    keys = ["subject_id", "study_id"]
    labels = [c for c in ("split", "mortality_30d", "mortality_90d", "mortality_1yr") if c in cohort.columns]
    own = lambda df, m: df.select(*keys, *(c for c in df.columns if c.startswith(f"model_{m}_")))
    out = cohort.select(*keys, *labels).join(own(a, "a"), keys).join(own(b, "b"), keys)
    for m in "ab":
        if f"model_{m}_error" not in out.columns:
            out = out.withColumn(f"model_{m}_error", F.lit(None).cast("string"))
    verify_predictions(out)
    return out


def split_summary(df: DataFrame, outcomes: tuple[str, ...]) -> DataFrame:
    """Per split: records, subjects, and events and rate of each outcome."""
    parts = [F.count(F.lit(1)).alias("records"), F.countDistinct("subject_id").alias("subjects")]
    for o in outcomes:
        parts += [F.sum(F.col(o).cast("long")).alias(f"events_{o}"), F.avg(F.col(o).cast("double")).alias(f"rate_{o}")]
    return df.groupBy("split").agg(*parts)
