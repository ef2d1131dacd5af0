"""Replicates as vectors against replicates as rows, and against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import bootstrap, metrics, resampling


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = [(int(i), ("x", "y", None)[i % 3], float(rng.integers(0, 12)), float(rng.random()), bool(rng.random() < 0.3)) for i in range(600)]
    # one score that many rows share, null and odd values
    data += [(1000 + i, "x", 5.0, 0.5, i % 4 == 0) for i in range(300)] + [(2000, "x", None, 0.1, True), (2001, "y", float("nan"), None, False), (2002, "x", 3.0, 0.2, None)]
    return spark.createDataFrame(data, "subject_id long, g string, a double, b double, y boolean").repartition(3).cache()


def test_counts_equal_the_hash_of_rows(spark):
    ids = [0, 1, -5, 2**40, 123456789]
    df = spark.createDataFrame([(i,) for i in ids], "subject_id long")
    want = df.select("subject_id", F.xxhash64("subject_id").alias("h"), *(bootstrap.poisson_count(F.col("subject_id"), F.lit(k), 7).alias(f"c{k}") for k in range(50))).collect()
    got = resampling.counts(np.array([r.h for r in want]), 50, 7)
    assert (got == np.array([[r[f"c{k}"] for k in range(50)] for r in want])).all()


def by_rows(df, metric, score, groups, replicates, seed):
    return metric(bootstrap.replicated(df, "subject_id", replicates, seed), [*groups, "replicate"], "y", score, F.col("_count"))


@pytest.mark.parametrize("metric", [bootstrap.auroc, bootstrap.auprc, bootstrap.brier, bootstrap.log_loss, bootstrap.event_rate])
@pytest.mark.parametrize("groups", [[], ["g"]])
def test_vectors_equal_rows(rows, metric, groups):
    for score in ("a", "b") if metric in (bootstrap.auroc, bootstrap.auprc) else ("b",):
        want = {tuple(r[c] for c in [*groups, "replicate"]): r.value for r in by_rows(rows, metric, score, groups, 40, 9).collect()}
        got = {tuple(r[c] for c in [*groups, "replicate"]): r.value for r in bootstrap.draws(rows, groups, metric, "y", score, "subject_id", 40, 9).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_ranges_and_shared_scores_change_nothing(rows):
    """Many ranges, and scores that are added up before the shuffle: 300 rows share one, of 20 replicates."""
    keep = ["replicate", "g", "positives", "negatives", "pairs", "precision"]
    whole = {tuple(r[:2]): r[2:] for r in resampling.ranked_sums(rows, ["g"], "y", "a", "subject_id", 20, 5).select(*keep).collect()}
    cut = {tuple(r[:2]): r[2:] for r in resampling.ranked_sums(rows, ["g"], "y", "a", "subject_id", 20, 5, rows=60).select(*keep).collect()}
    assert whole.keys() == cut.keys() and all(cut[k] == pytest.approx(whole[k]) for k in whole)
    assert len(resampling.range_cuts(rows.where("a IS NOT NULL AND NOT isnan(a)"), "a", 60)) > 5


def test_shuffled_rows_do_not_grow_with_the_replicates(rows):
    plan = lambda n: resampling.ranked_sums(rows, [], "y", "b", "subject_id", n, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan(10) and "Generate" not in plan(1000)


def test_other_metrics_run_on_rows(rows):
    def median_like(df, groups, y, score, weight=None):
        return metrics._clean(df, groups, y, score, weight).groupBy(*groups).agg((F.sum(F.col("_w") * F.col("_s")) / F.sum("_w")).alias("value"))

    got = bootstrap.intervals(rows, [], median_like, "y", "b", replicates=30).first()
    assert got.low < got.point < got.high


def test_empty_tables(rows):
    none = rows.where("subject_id < -1")
    assert bootstrap.draws(none, ["g"], bootstrap.auroc, "y", "b", "subject_id", 10, 1).count() == 0
    assert bootstrap.draws(none, ["g"], bootstrap.brier, "y", "b", "subject_id", 10, 1).count() == 0


def test_contrasts_of_gains_equal_plain_python(spark):
    """Two groups that share subjects, on replicates that they share."""
    from riskloom.operators import sensitivity

    rng = np.random.default_rng(8)
    data = []
    for i in range(240):
        a, b = float(rng.random()), float(rng.random())
        y = bool(rng.random() < (0.2 + 0.6 * (b if i % 2 else a)))
        data += [(i, g, a, b, y) for g in (("odd", "all") if i % 2 else ("even", "all"))]
    df = spark.createDataFrame(data, "subject_id long, g string, model_a_score double, model_b_score double, y boolean").repartition(3)
    got = {(r["first"], r["second"]): r for r in sensitivity.gain_contrasts(df, "g", "y", replicates=50, seed=3).collect()}
    assert set(got) == {("all", "even"), ("all", "odd"), ("even", "odd")}
    hashes = {r.subject_id: r.h for r in df.select("subject_id", F.xxhash64("subject_id").alias("h")).distinct().collect()}

    def auroc(y, s, w):
        less = (s[:, None] < s[None, :]) + 0.5 * (s[:, None] == s[None, :])
        pairs = (w * (1 - y))[:, None] * (w * y)[None, :]
        return (less * pairs).sum() / pairs.sum()

    def gain(g, column):
        rows = [r for r in data if r[1] == g]
        y, a, b = (np.array([r[k] for r in rows], float) for k in (4, 2, 3))
        w = np.ones(len(rows)) if column is None else resampling.counts(np.array([hashes[r[0]] for r in rows]), 50, 3)[:, column]
        return auroc(y, b, w) - auroc(y, a, w)

    for (g, h), r in got.items():
        draws = np.array([gain(g, k) - gain(h, k) for k in range(50)])
        assert r.contrast == pytest.approx(gain(g, None) - gain(h, None)) and (r.low, r.high) == pytest.approx((np.percentile(draws, 2.5), np.percentile(draws, 97.5)))
        assert r.p == pytest.approx(min(max(2 * min(np.mean(draws <= 0), np.mean(draws >= 0)), 1 / 50), 1))
    assert sensitivity.gain_contrasts(df.where("g = 'all'"), "g", "y", replicates=5).collect() == []


def test_intervals_of_probes_hold_their_points(spark):
    from riskloom.operators import battery

    rng = np.random.default_rng(1)
    data = []
    for i in range(400):
        x = rng.normal(0, 1, 4)
        data.append((i, ("dev", "test")[i % 2], x.tolist(), bool(rng.random() < 1 / (1 + np.exp(-x[0] - x[1])))))
    df = spark.createDataFrame(data, "k long, split string, e array<double>, y boolean").cache()
    points = {r.variant: r for r in battery.probe_variants(df, "e", "y").collect()}
    got = battery.probe_variant_intervals(df, "e", "y", "k", replicates=60).collect()
    assert len(got) == 4 * len(battery.VARIANTS) and all(r.low <= points[r.variant][r.measure] <= r.high for r in got)
