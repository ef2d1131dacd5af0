"""Sensitivity analyses beyond cohorts and horizons: other probes, other embeddings, other rule scores, a quality subset."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import bootstrap, metrics
from riskloom.operators import rulescore, sensitivity
from riskloom.operators.probe import Probe, sigmoid
from riskloom.session import materialize

#: Name, penalty, inverse penalty, share of the absolute penalty.
VARIANTS = (
    ("Primary L2 (Tuned C)", "l2", 0.1, 0.0),
    ("L2 (Strong, C=0.001)", "l2", 0.001, 0.0),
    ("L2 (Moderate, C=1.0)", "l2", 1.0, 0.0),
    ("L2 (Weak, C=100.0)", "l2", 100.0, 0.0),
    ("Elastic-Net (L1+L2, alpha=0.5)", "elasticnet", 0.1, 0.5),
    ("L1 (Lasso, C=0.1)", "l1", 0.1, 1.0),
)
SECOND_C, LOGIT_BOUND = 0.1, 500.0


@dataclass
class Standard:
    """Training rows standardised by their population moments, fitted on as often as needed."""

    df: DataFrame
    embedding: str
    y: str

    def __post_init__(self) -> None:
        rows = self.df.where(F.col(self.embedding).isNotNull() & F.col(self.y).isNotNull())
        moments = rows.select(F.posexplode(self.embedding).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("s")).orderBy("i").collect()
        if not moments:
            raise ValueError("no rows to fit a probe on")
        self.mean, self.scale = [r["m"] for r in moments], [max(r["s"], 1e-12) for r in moments]
        z = F.zip_with(F.zip_with(self.embedding, F.lit(self.mean), lambda x, m: x.cast("double") - m), F.lit(self.scale), lambda x, s: x / s)
        self.rows = rows.select(array_to_vector(z).alias("features"), F.col(self.y).cast("double").alias("label")).persist()
        self.n = self.rows.count()

    def fit(self, c: float, l1_ratio: float = 0.0) -> Probe:
        model = LogisticRegression(regParam=1.0 / (c * self.n), elasticNetParam=l1_ratio, standardization=False, tol=1e-8, maxIter=500).fit(self.rows)
        return Probe(model.coefficients.toArray().tolist(), float(model.intercept), self.mean, self.scale, c)

    def close(self) -> None:
        self.rows.unpersist()


def probability(probe: Probe, embedding: str) -> Column:
    return sigmoid(metrics.clip(probe.log_odds(F.col(embedding)), -LOGIT_BOUND, LOGIT_BOUND))


def rated_variants(df: DataFrame, embedding: str, y: str, split: str = "split", primary: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, _label, _primary, variant, penalty, c, p): the test rows once per variant, rated by a probe fitted on dev."""
    standard = Standard(df.where(F.col(split) == "dev"), embedding, y)
    try:
        fits = {name: standard.fit(c, ratio) for name, _, c, ratio in VARIANTS}
    finally:
        standard.close()
    test = df.where(F.col(split) == "test").where(F.col(embedding).isNotNull() & F.col(y).isNotNull())
    against = F.col(primary) if primary else probability(fits[VARIANTS[0][0]], embedding)
    every = F.array(*(F.struct(F.lit(name).alias("variant"), F.lit(penalty).alias("penalty"), F.lit(c).alias("c"), probability(fits[name], embedding).alias("p")) for name, penalty, c, _ in VARIANTS))
    return test.select(*keep, F.col(y).alias("_label"), against.alias("_primary"), F.explode(every).alias("_v")).select(*keep, "_label", "_primary", "_v.*")


def probe_variants(df: DataFrame, embedding: str, y: str, split: str = "split", primary: str | None = None) -> DataFrame:
    """(variant, penalty, c, n, auroc, auprc, brier, log_loss, rank_correlation) on the test split, fitted on dev; the rank correlation is
    with the column `primary`, or with the first variant's probabilities."""
    long = rated_variants(df, embedding, y, split, primary)
    groups = ["variant", "penalty", "c"]
    ranks = metrics.correlations(long, groups, "_primary", "p").select(*groups, F.col("spearman").alias("rank_correlation"))
    return metrics.proper_scores(long, groups, "_label", "p").join(metrics.discrimination(long, groups, "_label", "p"), groups).join(ranks, groups).select(*groups, "n", "auroc", "auprc", "brier", "log_loss", "rank_correlation")


def probe_variant_intervals(df: DataFrame, embedding: str, y: str, key: str, split: str = "split", replicates: int = metrics.REPLICATES, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(variant, measure, low, high) of what probe_variants measures but the rank correlation. All variants share their replicates."""
    long = materialize(rated_variants(df, embedding, y, split, keep=[key]), "rated")
    parts = [bootstrap.draws(long, ["variant"], metric, "_label", "p", key, replicates, seed).withColumn("measure", F.lit(name)) for name, (metric, _, _) in bootstrap.METRICS.items()]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return metrics.interval(every, ["variant", "measure"], "value", level)


def second_embedding(df: DataFrame, embedding: str, y: str, rule_score: str, primary: str, split: str = "split", key: str = "subject_id", replicates: int = metrics.REPLICATES, seed: int = 42) -> DataFrame:
    """(n, auroc, auprc, brier, delta_auroc, low, high, p, rank_correlation) of a probe on another embedding: its gain in AUROC over the rule score
    with an interval, and its rank correlation with the primary probabilities."""
    standard = Standard(df.where(F.col(split) == "dev"), embedding, y)
    try:
        probe = standard.fit(SECOND_C)
    finally:
        standard.close()
    test = df.where(F.col(split) == "test").where(F.col(embedding).isNotNull() & F.col(y).isNotNull()).withColumn("_second", probability(probe, embedding)).withColumn("_one", F.lit(1))
    gain = bootstrap.differences(test, ["_one"], bootstrap.auroc, y, "_second", rule_score, key, replicates, seed=seed).select("_one", F.col("point").alias("delta_auroc"), "low", "high", "p")
    ranks = metrics.correlations(test, ["_one"], primary, "_second").select("_one", F.col("spearman").alias("rank_correlation"))
    out = metrics.proper_scores(test, ["_one"], y, "_second").join(metrics.discrimination(test, ["_one"], y, "_second"), "_one").join(gain, "_one").join(ranks, "_one")
    return out.select("n", "auroc", "auprc", "brier", "delta_auroc", "low", "high", "p", "rank_correlation")


def alternative_scores(df: DataFrame, y: str, b: str, scores: list[str]) -> DataFrame:
    """(model, auroc, auprc, spearman_b, delta_auroc) of each rule score, the first being the baseline: its rank correlation with B and B's gain
    in AUROC over it. Rows without a score don't count for it."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("model"), F.col(c).cast("double").alias("_s")) for c in scores)))
    long = df.where(F.col(y).isNotNull() & F.col(b).isNotNull()).select(F.col(y).alias("_label"), F.col(b).cast("double").alias("_b"), pairs.alias("_x")).select("_label", "_b", "_x.*").where("_s IS NOT NULL")
    own = metrics.discrimination(long, ["model"], "_label", "_s")
    theirs = metrics.discrimination(long, ["model"], "_label", "_b").select("model", F.col("auroc").alias("_auroc_b"))
    ranks = metrics.correlations(long, ["model"], "_s", "_b").select("model", F.col("spearman").alias("spearman_b"))
    return own.join(theirs, "model").join(ranks, "model").select("model", "auroc", "auprc", "spearman_b", (F.col("_auroc_b") - F.col("auroc")).alias("delta_auroc"))


def quality_subset(df: DataFrame, good: Column, y: str) -> DataFrame:
    """A, B and B - A over all rows and over those of good quality; a null quality isn't good."""
    subsets = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.coalesce(good, F.lit(False)), "high quality"))))
    return sensitivity.compare(df.withColumn("subset", subsets), ["subset"], y)


def direction_summary(found: DataFrame, delta: str) -> DataFrame:
    """One row: how many differences are above zero and how many aren't; nulls count as neither."""
    return found.agg(F.count_if(F.col(delta) > 0).alias("positive"), F.count_if(F.col(delta) <= 0).alias("not_positive"), F.count(delta).alias("comparisons"))


def centroid_probability(df: DataFrame, key: str, embedding: str, y: str, temperature: float = 1.0) -> DataFrame:
    """(key, probability): the logistic function of the cosine to the mean vector of rows with y less that of rows without, over a temperature."""
    parts = df.where(F.col(y).isNotNull()).select(F.col(y).cast("boolean").alias("y"), F.posexplode(embedding).alias("i", "x")).groupBy("y", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = {r["y"]: [m for _, m in sorted(r["c"])] for r in parts.groupBy("y").agg(F.collect_list(F.struct("i", "m")).alias("c")).collect()}  # two vectors
    if len(means) < 2:
        raise ValueError("both outcomes must occur")
    near = lambda k: rulescore.cosine(F.col(embedding), F.lit(means[k]))
    return df.select(key, sigmoid((near(True) - near(False)) / max(temperature, 1e-6)).alias("probability"))


def run(
    scored: DataFrame, outcomes: Sequence[str], records: DataFrame | None = None, admissions: DataFrame | None = None, patients: DataFrame | None = None, embeddings: DataFrame | None = None, second: DataFrame | None = None,
    quality: Column | None = None, scores: Sequence[str] = (), replicates: int = metrics.REPLICATES, seed: int = 42,
) -> dict[str, DataFrame]:
    """Every analysis whose inputs are there, by name, and `directions`, which counts the gains in AUROC of all. scored: predictions of both models
    in all splits; the first outcome is the primary one; embeddings, second: subject_id, split, the primary outcome, embedding. Intervals
    are beside each comparison, all from one seed; with 0 replicates there are none."""
    horizons = list(outcomes)
    if records is not None and admissions is not None and "inhospital_mortality" not in scored.columns:
        scored = sensitivity.with_inhospital(scored, records, admissions)
        horizons.append("inhospital_mortality")
    dev, test, y = scored.where("split = 'dev'"), scored.where("split = 'test'"), outcomes[0]
    compared = {}
    if records is not None and admissions is not None:
        compared["anchoring"] = (sensitivity.index_cohorts(test, records, admissions), "cohort", y)
    if patients is not None:
        compared["subgroups"] = (sensitivity.by_subgroup(test, patients), "subgroup", y)
    found = {"horizons": sensitivity.horizon_battery(dev, test, horizons)}
    if replicates:
        found["horizons_intervals"] = sensitivity.horizon_intervals(dev, test, horizons, replicates=replicates, seed=seed)
    for name, (df, group, label) in compared.items():
        found[name] = sensitivity.compare(df, [group], label)
        if replicates:
            found[f"{name}_intervals"] = sensitivity.compare_intervals(df, [group], label, replicates=replicates, seed=seed)
            if name == "subgroups":
                found["subgroup_contrasts"] = sensitivity.gain_contrasts(df, group, label, replicates=replicates, seed=seed)
    if quality is not None:
        found["quality"] = quality_subset(test, quality, y)
    if scores:
        found["alternative_scores"] = alternative_scores(test, y, sensitivity.B, list(scores))
    if embeddings is not None:
        found["probe_variants"] = probe_variants(embeddings, "embedding", y)
        if replicates:
            found["probe_variants_intervals"] = probe_variant_intervals(embeddings, "embedding", y, "subject_id", replicates=replicates, seed=seed)
    if second is not None:
        beside = second.join(scored.select("subject_id", sensitivity.A, sensitivity.B), "subject_id")
        found["second_embedding"] = second_embedding(beside, "embedding", y, sensitivity.A, sensitivity.B, replicates=max(replicates, 1), seed=seed)
    gains = [df.select(F.lit(name).alias("analysis"), "delta_auroc") for name, df in found.items() if "delta_auroc" in df.columns]
    every = gains[0]
    for more in gains[1:]:
        every = every.unionByName(more)
    found["directions"] = direction_summary(every, "delta_auroc")
    return found
