import datetime as dt

import pytest

from riskloom.operators import sensitivity

DAY = lambda n: dt.datetime(2150, 1, n)
PREDICTIONS = "subject_id long, model_a_score double, model_b_score double, mortality_30d boolean"


def test_the_anchored_cohort_follows_admissions(spark):
    records = spark.createDataFrame([(1, 11, DAY(1)), (1, 12, DAY(10)), (2, 21, DAY(5)), (3, 31, DAY(6)), (4, 41, DAY(7))], "subject_id long, study_id long, ecg_datetime timestamp_ntz")
    admissions = spark.createDataFrame([(1, 901, DAY(9), DAY(12)), (2, 902, DAY(20), DAY(21)), (3, 903, DAY(6), DAY(8))], "subject_id long, hadm_id long, admit_dt timestamp_ntz, disch_dt timestamp_ntz")
    predictions = spark.createDataFrame([(i, float(i), float(-i), i == 3) for i in range(1, 6)], PREDICTIONS)
    got = sensitivity.index_cohorts(predictions, records, admissions)
    held = {(r["cohort"], r["subject_id"]): r["index_study_id"] for r in got.collect()}
    assert held == {("earliest", 1): 11, ("earliest", 2): 21, ("earliest", 3): 31, ("earliest", 4): 41, ("admission", 1): 12, ("admission", 3): 31}
    rows = {r["cohort"]: r for r in sensitivity.compare(got, ["cohort"], "mortality_30d").collect()}
    assert [(rows[c].n, rows[c].events, rows[c].auroc_a, rows[c].auroc_b, rows[c].delta_auroc) for c in ("earliest", "admission")] == [(4, 1, pytest.approx(2 / 3), pytest.approx(1 / 3), pytest.approx(-1 / 3)), (2, 1, 1.0, 0.0, -1.0)]


def test_intervals_pair_the_scores(spark):
    rows = [(i, float(i % 10), float(i % 10), i % 10 > 4 + i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, PREDICTIONS).selectExpr("'x' AS cohort", "*")
    got = {r["measure"]: r for r in sensitivity.compare_intervals(df, ["cohort"], "mortality_30d", replicates=50).collect()}
    assert (got["delta_auroc"].low, got["delta_auroc"].high, got["delta_auroc"].p) == (0.0, 0.0, 1.0)
    assert got["auroc_a"].low < got["auroc_a"].high and got["auroc_a"].p is None


def test_horizons_and_subgroups_compare_both_models(spark):
    from riskloom.plans.queries import QUERIES

    for name, groups in (("horizon_comparison", 3), ("subgroup_comparison", 4)):
        rows = QUERIES[name](spark, "/root/testdata/sf0.001").collect()
        assert len(rows) == groups and all(r.delta_auroc == pytest.approx(r.auroc_b - r.auroc_a, abs=2e-8) and r.delta_auprc == pytest.approx(r.auprc_b - r.auprc_a, abs=2e-8) for r in rows)
