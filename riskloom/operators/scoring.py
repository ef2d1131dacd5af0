"""A cohort scored by both models from its recordings: rule score A, and B by a linear probe on a model's embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import metrics
from riskloom.functions.quantiles import quantiles
from riskloom.operators import adapters, signals, splits
from riskloom.operators.incremental import both_classes
from riskloom.operators.probe import Probe, fit_probe, sigmoid
from riskloom.session import materialize
from riskloom.sources.paths import exists
from riskloom.sources.recordings import read_recordings, record_of

KEYS = ["subject_id", "study_id"]


def with_signals(cohort: DataFrame, root: str, fs: int = 500) -> DataFrame:
    """(subject_id, study_id, signal, leads) of every row of a cohort whose `path` names a recording below root. A recording that is
    missing, can't be read or has another sampling rate has a null signal."""
    spark = cohort.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    found = read_recordings(spark, root).select(F.col("record").alias("_record"), "leads", F.when(F.col("error").isNull() & (F.col("fs") == fs), F.col("signal")).alias("signal"))
    return cohort.select(*KEYS, F.concat(F.lit(f"{base}/"), record_of(F.col("path"))).alias("_record")).join(found, "_record", "left").select(*KEYS, "signal", "leads")


def model_a(recorded: DataFrame, fs: int = 500) -> DataFrame:
    """The rule score of each recording under the names of a table of predictions."""
    s = signals.score_recordings(recorded, fs, keep=KEYS)
    return s.select(*KEYS, F.col("total").alias("model_a_score"), F.col("category").alias("model_a_category"), F.col("is_valid").alias("model_a_valid"), F.col("error").alias("model_a_error"))


def cached(cohort: DataFrame, path: str | None, compute: Callable[[], DataFrame], column: str = "model_a_score") -> DataFrame:
    """The table at path where it holds the cohort's rows and the column, else what compute() gives, written there. Without a
    path it is computed."""
    spark = cohort.sparkSession
    if path is None:
        return compute()
    if exists(spark, path):
        held = spark.read.parquet(path)
        if {column, *KEYS} <= set(held.columns) and held.count() == cohort.count() and cohort.join(held, KEYS, "left_anti").isEmpty():
            return held
    compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def model_b(cohort: DataFrame, embedded: DataFrame, y: str = "mortality_30d") -> tuple[DataFrame, Probe]:
    """(scores, probe): a probe fitted on the dev rows of valid embeddings, its penalty chosen on val. embedded: study_id, embedding, is_valid, error."""
    rows = cohort.select(*KEYS, "split", y).join(embedded, "study_id")
    fit = rows.where("is_valid")
    if not both_classes(fit.where("split = 'dev'").where(F.col(y).isNotNull()), y):
        raise ValueError("the dev rows with an embedding need both outcomes")
    probe = fit_probe(fit, "embedding", y)
    z = F.when(F.col("is_valid"), probe.log_odds(F.col("embedding")))
    return rows.select(*KEYS, sigmoid(z).alias("model_b_score"), z.alias("model_b_log_odds"), F.col("is_valid").alias("model_b_valid"), F.col("error").alias("model_b_error")), probe


def build(cohort: DataFrame, root: str, make: Callable[[], adapters.Model], spec: adapters.Spec, fs: int = 500, checkpoint: str | None = None, batch_size: int = adapters.BATCH) -> tuple[DataFrame, Probe]:
    """(predictions, probe) of a cohort with `path`, `split` and outcomes. With a checkpoint folder the scores of A are kept there and
    the embeddings written part by part, so a second call goes on where the first one stopped."""
    recorded = with_signals(cohort, root, fs)
    a = cached(cohort, f"{checkpoint}/model_a" if checkpoint else None, lambda: model_a(recorded, fs))
    if checkpoint:
        embedded = adapters.embed_resumable(recorded, make, spec, fs, "study_id", f"{checkpoint}/embeddings", batch_size=batch_size)
    else:
        embedded = materialize(adapters.embed(recorded, make, spec, fs, ["study_id"], batch_size=batch_size))
    b, probe = model_b(cohort, embedded)
    return splits.build_predictions(cohort, a, b), probe


def validity(df: DataFrame) -> DataFrame:
    """Per split: rows, those each model scored, those both did, and their percentages. A null flag counts as not scored."""
    a, b = (F.coalesce(F.col(f"model_{m}_valid"), F.lit(False)) for m in "ab")
    counts = {"a": a, "b": b, "both": a & b}
    held = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(f"valid_{name}") for name, c in counts.items()))
    return held.withColumns({f"percent_{name}": 100.0 * F.col(f"valid_{name}") / F.col("n") for name in counts})


def prediction_summary(df: DataFrame, y: str = "mortality_30d") -> DataFrame:
    """Per split, over rows that both models scored: moments and quartiles of A and B, and how well B tells and predicts y."""
    p = df.where("model_a_valid AND model_b_valid")
    kinds = {"a": "model_a_score", "b": "model_b_score", "log_odds_b": "model_b_log_odds"}
    moments = [f(c).alias(f"{name}_{kind}") for kind, c in kinds.items() for name, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    one = p.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *moments)
    scores = [kinds["a"], kinds["b"]]
    quarters = quantiles(p, ["split"], scores, [0.25, 0.5, 0.75])
    quarters = quarters.select("split", *(F.col(f"{c}_q")[k].alias(f"q{n}_{m}") for m, c in zip("ab", scores, strict=True) for k, n in enumerate((25, 50, 75))))
    one = one.join(quarters, "split").select("split", "n", *(c for m in "ab" for c in (f"mean_{m}", f"sd_{m}", *(f"q{n}_{m}" for n in (25, 50, 75)))), "mean_log_odds_b", "sd_log_odds_b")
    return one.join(metrics.discrimination(p, ["split"], y, "model_b_score"), "split").join(metrics.proper_scores(p, ["split"], y, "model_b_score").drop("n", "events"), "split")
