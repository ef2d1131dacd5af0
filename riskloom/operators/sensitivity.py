"""Model B against model A in several cohorts at once, and the cohort anchored on admissions. Each function gives rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import bootstrap, metrics, resampling
from riskloom.functions.logistic import fit_groups
from riskloom.operators import cohort, outcomes
from riskloom.session import materialize

A, B, P_A = "model_a_score", "model_b_score", "model_a_probability"
#: Horizons of the battery: the primary outcomes and death in hospital.
HORIZONS = ("inhospital_mortality", "mortality_30d", "mortality_90d", "mortality_1yr")
#: Fixed value: half the square of the weights counts once in the loss of the battery's fits.
HORIZON_PENALTY = 1.0


def index_cohorts(predictions: DataFrame, records: DataFrame, admissions: DataFrame) -> DataFrame:
    """Predictions by cohort: `earliest` holds the subjects with an index recording, `admission` those whose index recording is
    taken among the recordings inside an encounter. A subject of both has a row in each. index_study_id names the recording. The
    result is written once, as its readers read it several times."""
    seen = cohort.recordings_inside(records.select("subject_id", "study_id", "ecg_datetime"), admissions)
    chosen = {"earliest": cohort.index_recordings(records), "admission": cohort.index_recordings(seen)}
    frames = [df.select("subject_id", F.col("study_id").alias("index_study_id"), F.lit(name).alias("cohort")) for name, df in chosen.items()]
    return materialize(predictions.join(frames[0].unionByName(frames[1]), "subject_id"), "cohorts")


def by_horizon(df: DataFrame, horizons: Sequence[str]) -> DataFrame:
    """df's rows once for each outcome that it has, under `horizon` and `y`; a horizon without a label gives no rows."""
    return df.withColumn("_h", F.explode(F.array(*(F.struct(F.lit(o).alias("horizon"), F.col(o).alias("y")) for o in horizons if o in df.columns)))).select("*", "_h.*").drop("_h").where("y IS NOT NULL")


def by_subgroup(df: DataFrame, patients: DataFrame, least: int = 5) -> DataFrame:
    """df's rows once for each group of their subject: under 65 or not, and the sex. Groups of fewer than `least` rows are left out,
    an unknown age or sex gives no group."""
    age = F.when(F.col("anchor_age") < 65, "<65").when(F.col("anchor_age") >= 65, ">=65")
    groups = patients.select("subject_id", F.explode(F.array_compact(F.array(age, F.col("gender")))).alias("subgroup"))
    long = df.join(groups, "subject_id")
    return long.join(long.groupBy("subgroup").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n"), "subgroup")


def _complete(df: DataFrame, y: str) -> DataFrame:
    return df.where(F.col(y).isNotNull() & F.col(A).isNotNull() & F.col(B).isNotNull() & ~F.isnan(A) & ~F.isnan(B))


def _beside(df: DataFrame, groups: list[str]) -> DataFrame:
    """Values of A, of B and B - A, from a row per score."""
    of = lambda m, s: F.max(F.when(F.col("score") == s, F.col(m)))
    wide = df.groupBy(*groups).agg(*(of(m, s).alias(f"{m}_{n}") for m in ("auroc", "auprc") for n, s in (("a", A), ("b", B))))
    return wide.select(*groups, *(c for m in ("auroc", "auprc") for c in (f"{m}_a", f"{m}_b", (F.col(f"{m}_b") - F.col(f"{m}_a")).alias(f"delta_{m}"))))


def compare(df: DataFrame, groups: list[str], y: str) -> DataFrame:
    """n, events, rate, AUROC and AUPRC of A, of B and B - A, and the rank correlation of A and B, over rows with a label and both scores."""
    d = _complete(df, y)
    both = F.explode(F.array(*(F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("x")) for s in (A, B))))
    ranked = metrics.discrimination(d.select(*groups, y, both.alias("_s")).select(*groups, y, "_s.*"), [*groups, "score"], y, "x")
    label = F.col(y).cast("double")
    size = d.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("events"), F.avg(label).alias("rate"))
    return size.join(_beside(ranked, groups), groups).join(metrics.correlations(d, groups, A, B).select(*groups, "spearman"), groups)


def compare_intervals(df: DataFrame, groups: list[str], y: str, key: str = "subject_id", replicates: int = metrics.REPLICATES, seed: int = 42) -> DataFrame:
    """(measure, low, high, p) per group for what `compare` measures, on replicates that A and B share. p is two-sided, for the differences
    only, and no less than 1 / replicates."""
    draws = _beside(bootstrap.discrimination_draws(_complete(df, y), groups, y, [A, B], key, replicates, seed), [*groups, "replicate"])
    return _measured(draws, groups, [c for c in draws.columns if c not in (*groups, "replicate")], replicates)


def _measured(draws: DataFrame, groups: list[str], names: list[str], replicates: int) -> DataFrame:
    """(groups, measure, low, high, p) from a column of draws per measure."""
    long = draws.select(*groups, F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).alias("v")) for c in names))).alias("_x")).select(*groups, "_x.*")
    tails = long.groupBy(*groups, "measure").agg(F.least(F.avg((F.col("v") <= 0).cast("double")), F.avg((F.col("v") >= 0).cast("double"))).alias("_t"))
    p = F.when(F.col("measure").startswith("delta_"), metrics.clip(2.0 * F.col("_t"), 1.0 / replicates, 1.0))
    return metrics.interval(long, [*groups, "measure"], "v").join(tails, [*groups, "measure"]).select(*groups, "measure", "low", "high", p.alias("p"))


def with_inhospital(predictions: DataFrame, records: DataFrame, admissions: DataFrame) -> DataFrame:
    """Predictions with inhospital_mortality of the subject's first recording; null outside an encounter. The result is written once, as
    its readers read it many times."""
    found = outcomes.first_encounters(cohort.index_recordings(records), admissions)
    labels = found.select("subject_id", F.col("in_hospital_mortality").alias("inhospital_mortality"))
    return materialize(predictions.join(labels, "subject_id", "left"), "labelled")


def horizon_battery(dev: DataFrame, test: DataFrame, horizons: Sequence[str], penalty: float = HORIZON_PENALTY) -> DataFrame:
    """(horizon, what `compare` measures, brier_a, brier_b, delta_brier, lrt, p_value) on test; horizons that test lacks give no row.

    All horizons' models are fitted together on dev: A for the probability of A, and A with B for the likelihood ratio that says
    whether B adds to A there. Where dev has no row or one class, A's probability is its place between the smallest and
    largest score of the horizon on test, and B adds nothing (0, p 1)."""
    rated, tests = rate_horizons(dev, test, horizons, penalty)
    a = metrics.proper_scores(rated, ["horizon"], "y", P_A).select("horizon", F.col("brier").alias("brier_a"))
    b = metrics.proper_scores(rated, ["horizon"], "y", B).select("horizon", F.col("brier").alias("brier_b"))
    out = compare(rated, ["horizon"], "y").join(a, "horizon").join(b, "horizon").join(tests, "horizon", "left")
    return out.withColumn("delta_brier", F.col("brier_a") - F.col("brier_b")).withColumns({"lrt": F.coalesce("lrt", F.lit(0.0)), "p_value": F.coalesce("p_value", F.lit(1.0))})


def rate_horizons(dev: DataFrame, test: DataFrame, horizons: Sequence[str], penalty: float = HORIZON_PENALTY) -> tuple[DataFrame, DataFrame]:
    """(rows, tests): test's complete rows per horizon with A's probability P_A, and (horizon, lrt, p_value)."""
    spark = dev.sparkSession
    fits = fit_groups(_complete(by_horizon(dev, horizons), "y"), ["horizon"], "y", {"A": [F.col(A)], "A+B": [F.col(A), F.col(B)]}, penalty, both_classes=True)
    of = {(f.group[0], f.model): f for f in fits}
    rows = []
    for horizon in sorted({f.group[0] for f in fits}):
        one, both = of[horizon, "A"], of[horizon, "A+B"]
        gain = max(2.0 * (both.log_likelihood - one.log_likelihood), 0.0)
        rows.append((horizon, *map(float, one.beta), gain, metrics.chi2_sf_1(gain)))
    tests = spark.createDataFrame(rows, "horizon string, _b0 double, _b1 double, lrt double, p_value double")  # a row per horizon
    long = _complete(by_horizon(test, horizons), "y")
    ends = long.groupBy("horizon").agg(F.min(F.col(A).cast("double")).alias("_low"), F.max(F.col(A).cast("double")).alias("_high"))
    met = long.join(F.broadcast(ends.join(tests, "horizon", "left")), "horizon")
    place = F.when(F.col("_high") > F.col("_low"), (F.col(A) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.5)
    fitted = 1.0 / (1.0 + F.exp(-(F.col("_b0") + F.col("_b1") * F.col(A))))
    return met.withColumn(P_A, F.coalesce(fitted, place)).drop("_low", "_high", "_b0", "_b1", "lrt", "p_value"), tests.select("horizon", "lrt", "p_value")


def horizon_intervals(dev: DataFrame, test: DataFrame, horizons: Sequence[str], key: str = "subject_id", replicates: int = metrics.REPLICATES, seed: int = 42) -> DataFrame:
    """(horizon, measure, low, high, p) of what horizon_battery measures, on shared replicates; p as compare_intervals has it."""
    rated, _ = rate_horizons(dev, test, horizons)
    rated = materialize(rated.select(key, "horizon", "y", A, B, P_A), "rated")
    ranks = compare_intervals(rated, ["horizon"], "y", key, replicates, seed)
    label = F.col("y").cast("double")
    squared = [F.pow(F.col(c).cast("double") - label, 2.0) for c in (P_A, B)]
    sums = resampling.weighted_sums(rated, ["horizon"], [F.lit(1.0), *squared], key, replicates, seed).where("s0 > 0")
    draws = sums.select("horizon", (F.col("s1") / F.col("s0")).alias("brier_a"), (F.col("s2") / F.col("s0")).alias("brier_b")).withColumn("delta_brier", F.col("brier_a") - F.col("brier_b"))
    return ranks.unionByName(_measured(draws, ["horizon"], ["brier_a", "brier_b", "delta_brier"], replicates))


def gain_contrasts(df: DataFrame, group: str, y: str, key: str = "subject_id", replicates: int = metrics.REPLICATES, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(first, second, gain_first, gain_second, contrast, low, high, p): how the gain in AUROC of B over A differs between each two groups,
    in order of their names. Groups may share subjects: a subject counts as often in one group's replicate as in the other's. p is
    two-sided and no less than 1 / replicates. One group gives no row; a group of one class has gain 0."""
    d = _complete(df, y)
    gain = compare(d, [group], y).select(group, "delta_auroc")
    draws = materialize(_beside(bootstrap.discrimination_draws(d, [group], y, [A, B], key, replicates, seed), [group, "replicate"]).select(group, "replicate", "delta_auroc"), "gains")

    def beside(rows: DataFrame, on: list[str]) -> DataFrame:
        one = rows.select(F.col(group).alias("first"), *on, F.col("delta_auroc").alias("gain_first"))
        two = rows.select(F.col(group).alias("second"), *on, F.col("delta_auroc").alias("gain_second"))
        met = one.join(two, on) if on else one.join(two, F.col("first") < F.col("second"))
        return met.where("first < second").withColumn("contrast", F.col("gain_first") - F.col("gain_second"))

    # a row per pair of groups and replicate
    drawn = beside(draws, ["replicate"])
    tails = drawn.groupBy("first", "second").agg(F.least(F.avg((F.col("contrast") <= 0).cast("double")), F.avg((F.col("contrast") >= 0).cast("double"))).alias("_t"))
    out = beside(materialize(gain, "points"), []).join(metrics.interval(drawn, ["first", "second"], "contrast", level), ["first", "second"]).join(tails, ["first", "second"])
    return out.withColumn("p", metrics.clip(2.0 * F.col("_t"), 1.0 / replicates, 1.0)).drop("_t")
