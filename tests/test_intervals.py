import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import bootstrap, metrics
from riskloom.operators import battery, cohort, incremental, outcomes, strata, synthesis


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(4)
    n = 400
    a = np.clip(rng.gamma(3, 4, n), 0, 45)
    p = 1 / (1 + np.exp(-(0.1 * a + rng.normal(0, 1, n) - 2)))
    y = rng.random(n) < p
    rows = [(i, float(a[i]), float(p[i]), bool(y[i]), ("dev", "test")[i % 2]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "subject_id long, a double, b double, y boolean, split string").repartition(3).cache()


def plain_auroc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return 0.5 if not len(pos) or not len(neg) else float(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)))


def draws_of(spark, ids, replicates, seed):
    """Each row's count in each replicate."""
    df = spark.createDataFrame([(int(i),) for i in ids], "subject_id long").select("subject_id", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    out = np.zeros((replicates, len(ids)))
    for r in df.withColumn("c", bootstrap.poisson_count(F.col("subject_id"), F.col("replicate"), seed)).collect():
        out[r.replicate, r.subject_id] = r.c
    return out


def test_intervals_and_differences_equal_plain_python(spark, scored):
    rows, df = scored
    y, a, b = (np.array([r[k] for r in rows], float) for k in (3, 1, 2))
    counts = draws_of(spark, range(len(rows)), 60, 42)
    assert abs(counts.mean() - 1) < 0.03 and abs(counts.var() - 1) < 0.06
    again = lambda x, c: np.repeat(x, c.astype(int))
    diffs = [plain_auroc(again(y, c), again(b, c)) - plain_auroc(again(y, c), again(a, c)) for c in counts]
    got = bootstrap.differences(df, [], bootstrap.auroc, "y", "b", "a", replicates=60).first()
    point = plain_auroc(y, b) - plain_auroc(y, a)
    assert got.point == pytest.approx(point) and (got.low, got.high) == pytest.approx((np.percentile(diffs, 2.5), np.percentile(diffs, 97.5)))
    tail = np.mean(np.array(diffs) <= 0) if point >= 0 else np.mean(np.array(diffs) >= 0)
    assert got.p == pytest.approx(min(max(2 * tail, 1 / 60), 1))
    one = bootstrap.intervals(df, [], bootstrap.brier, "y", "b", replicates=60).first()
    values = [np.average((b - y) ** 2, weights=c) for c in counts]
    assert one.point == pytest.approx(np.mean((b - y) ** 2)) and (one.low, one.high) == pytest.approx((np.percentile(values, 2.5), np.percentile(values, 97.5)))


def test_few_rows_have_no_width(spark):
    df = spark.createDataFrame([(1, 0.1, 0.2, True), (2, 0.3, 0.9, False)], "subject_id long, a double, b double, y boolean")
    one = bootstrap.intervals(df, [], bootstrap.auroc, "y", "a", replicates=20).first()
    two = bootstrap.differences(df, [], bootstrap.auroc, "y", "b", "a", replicates=20).first()
    assert one.low == one.point == one.high and two.low == two.point == two.high and two.p == 1.0


def test_gains_favour_the_better_model(scored):
    rows, df = scored
    flipped = df.withColumn("bad", 1.0 - F.col("b"))
    got = {r.measure: r for r in bootstrap.compare_models(flipped, [], "y", "bad", "b", "bad", "b", replicates=40).collect()}
    assert set(got) == set(bootstrap.METRICS) and all(r.gain > 0 and r.low > 0 and r.low <= r.gain <= r.high and r.p == 1 / 40 for r in got.values())
    assert got["brier"].gain == pytest.approx(got["brier"].a - got["brier"].b) and got["auroc"].gain == pytest.approx(got["auroc"].b - got["auroc"].a)


def test_nested_models(scored):
    _, df = scored
    dev, test = df.where("split = 'dev'"), df.where("split = 'test'")
    table, held, fits = incremental.nested_models(dev, test, "y", "a", "b")
    rows = {r.model: r for r in table.collect()}
    assert rows["A+B"].log_likelihood >= max(rows["A"].log_likelihood, rows["B"].log_likelihood) - 1e-6 and [rows[m].parameters for m in ("A", "B", "A+B")] == [3, 2, 4]
    n = dev.count()
    assert all(r.aic == pytest.approx(2 * r.parameters - 2 * r.log_likelihood) and r.bic == pytest.approx(math.log(n) * r.parameters - 2 * r.log_likelihood) for r in rows.values())
    gain, p = incremental.likelihood_ratio(table)
    assert gain == pytest.approx(2 * (rows["A+B"].log_likelihood - rows["A"].log_likelihood)) and 0 <= p <= 1
    got = {r.measure: r for r in incremental.gains(held, "y", replicates=40).collect()}
    assert got["auroc"].point == pytest.approx(rows["A+B"].auroc - rows["A"].auroc) and got["brier"].point == pytest.approx(rows["A"].brier - rows["A+B"].brier)
    one = incremental.calibrated(dev.where("y"), test, "a", "y")
    low, high = test.select(F.min(one), F.max(one)).first()
    assert (low, high) == (0.0, 1.0)


def test_discordance_intervals(spark, scored):
    rows, df = scored
    got = {r.measure: r for r in strata.discordance_intervals(df, "y", "a", "b", replicates=60).collect()}
    points = {r.quadrant: r for r in strata.discordance(df, "y", "a", "b").collect()}
    assert all(got[q].point == pytest.approx(points[q].rate) for q in points) and all(r.low <= r.point <= r.high for r in got.values())
    contrast = strata.risk_contrasts(strata.discordance(df, "y", "a", "b")).first()
    assert (got["rd_a_low"].point, got["rr_a_low"].point, got["rd_a_high"].point) == pytest.approx((contrast.rd_a_low, contrast.rr_a_low, contrast.rd_a_high))
    other = {r.quadrant: r.n for r in strata.discordance(df, "y", "a", "b", a_cut=None, b_cut=2.0).collect()}
    assert other["A-low/B-high"] == other["A-high/B-high"] == 0 and sum(other.values()) == len(rows)


def test_surface_and_thirds_are_whole(spark):
    df = spark.createDataFrame([(float(i), float(i), i % 2 == 0, "normal" if i < 20 else "borderline") for i in range(21)], "a double, b double, y boolean, c string")
    cells = strata.risk_surface(df, "y", "a", "b").collect()
    assert len(cells) == 25 and sum(r.n for r in cells) == 21 and sum(r.n == 0 for r in cells) == 20 and all(r.rate is None for r in cells if not r.n)
    thirds = strata.tertiles_within(df, "c", "y", "b").collect()
    assert {r.category for r in thirds} == {"normal"} and sum(r.n for r in thirds) == 20
    tied = strata.tertiles_within(df.withColumn("b", F.lit(1.0)), "c", "y", "b").collect()
    assert sorted((r.tertile, r.n, r.rate) for r in tied) == [("High", 20, 0.5), ("Low", 0, 0.0), ("Mid", 0, 0.0)]
    strat = {r.category: r for r in strata.stratified_risk(df, "c", "y", "b").collect()}
    assert strat["normal"].auroc == pytest.approx(0.45) and strat["borderline"].auroc is None and strat["possible_injury"].n == 0


def test_ranks_by_ranges(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [("g" if k % 3 else None, float(rng.integers(0, 40)), float(rng.normal()), bool(rng.random() < 0.4)) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, a double, b double, y boolean")
    got = {r["g"]: r for r in metrics.correlations(df, ["g"], "a", "b").collect()}
    ranks = {r["g"]: r for r in metrics.discrimination(df, ["g"], "y", "a").collect()}
    for g in ("g", None):
        x, z, y = (np.array([r[k] for r in rows if r[0] == g], float) for k in (1, 2, 3))
        average = lambda v: np.array([(v < u).sum() + ((v == u).sum() + 1) / 2 for u in v])
        assert got[g].spearman == pytest.approx(np.corrcoef(average(x), average(z))[0, 1]) and got[g].pearson == pytest.approx(np.corrcoef(x, z)[0, 1])
        assert ranks[g].auroc == pytest.approx(plain_auroc(y, x))
    plan = metrics.discrimination(df, [], "y", "b")._jdf.queryExecution().toString()
    assert "_z" in plan


def test_p_values_by_t(spark):
    for free, t in ((1, 12.706), (8, 2.306), (30, 2.042), (100, 1.984)):
        assert synthesis.correlation_p(t / math.sqrt(free + t * t), free + 2) == pytest.approx(0.05, abs=1e-3)
    assert synthesis.correlation_p(0.5, 2) == 1.0 and synthesis.correlation_p(1.0, 9) == 0.0 and synthesis.correlation_p(0.0, 9) == pytest.approx(1.0)


def test_battery(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        x = rng.normal(size=4)
        rows.append((i, [float(v) for v in x], bool(x[0] + 0.3 * rng.normal() > 0), ("dev", "test")[i % 2], float(x[1]), float(x[0])))
    df = spark.createDataFrame(rows, "subject_id long, e array<double>, y boolean, split string, model_a_score double, model_b_score double")
    got = {r.variant: r for r in battery.probe_variants(df, "e", "y", primary="model_b_score").collect()}
    assert set(got) == {v[0] for v in battery.VARIANTS} and all(r.n == 150 and r.auroc > 0.9 and r.rank_correlation > 0.8 for r in got.values())
    second = battery.second_embedding(df, "e", "y", "model_a_score", "model_b_score", replicates=30).first()
    assert second.delta_auroc > 0.2 and second.low > 0 and second.rank_correlation > 0.8
    subsets = {r["subset"]: r.n for r in battery.quality_subset(df, F.when(F.col("subject_id") < 100, F.col("subject_id") < 40), "y").collect()}
    assert subsets == {"all": 300, "high quality": 40}
    scores = {r.model: r for r in battery.alternative_scores(df, "y", "model_b_score", ["model_a_score", "model_b_score"]).collect()}
    assert scores["model_b_score"].delta_auroc == 0 and scores["model_b_score"].spearman_b == pytest.approx(1) and scores["model_a_score"].delta_auroc > 0.2
    deltas = spark.createDataFrame([(0.1,), (-0.2,), (0.0,), (None,)], "d double")
    assert tuple(battery.direction_summary(deltas, "d").first()) == (1, 2, 3)
    near = {r.subject_id: r.probability for r in battery.centroid_probability(df, "subject_id", "e", "y").collect()}
    assert np.mean([(near[i] > 0.5) == y for i, _, y, *_ in rows]) > 0.85


def test_inhospital_labels_and_flow(spark):
    import datetime as dt

    at = lambda d, h: dt.datetime(2150, 1, d, h)
    records = spark.createDataFrame([(1, 1, at(2, 9)), (1, 2, at(1, 10)), (2, 3, at(5, 1)), (3, 4, None)], "subject_id long, study_id long, ecg_datetime timestamp_ntz")
    admissions = spark.createDataFrame([(1, 90, at(2, 8), at(3, 8), 1, None), (2, 91, at(5, 0), at(6, 0), 1, at(5, 0))], "subject_id long, hadm_id long, admit_dt timestamp_ntz, disch_dt timestamp_ntz, hospital_expire_flag long, death_dt timestamp_ntz")
    got = lambda h: {r.study_id: (r.in_hospital_mortality, r.linked_hadm_id) for r in outcomes.inhospital_mortality(records, admissions, h).collect()}
    assert got(0) == {1: (True, 90), 2: (None, None), 3: (False, 91), 4: (None, None)} and got(24)[2] == (True, 90)
    patients = spark.createDataFrame([(1, 30, 2150, None), (2, 10, 2150, None)], "subject_id long, anchor_age long, anchor_year long, dod_date date")
    flow = cohort.attrition(records, patients, admissions).orderBy("step").collect()
    assert [(r.name, r.records, r.subjects) for r in flow] == [("all", 4, 3), ("linked", 3, 2), ("adult", 2, 1), ("valid", 2, 1), ("index", 1, 1)]
    assert [r.excluded_records for r in flow] == [0, 1, 1, 0, 1]
    assert [r.records for r in cohort.attrition(records.limit(0), patients, admissions).orderBy("step").collect()] == [0] * 5
