"""Grouped logistic fits and the battery of horizons against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import metrics
from riskloom.functions.logistic import fit_groups
from riskloom.operators import sensitivity


def plain_fit(x, y, penalty):
    x = np.column_stack([np.ones(len(y)), x])
    beta, shrink = np.zeros(x.shape[1]), np.diag([0.0] + [penalty] * (x.shape[1] - 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (p - y) + shrink @ beta)
    p = 1 / (1 + np.exp(-x @ beta))
    return beta, float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(12)
    out = []
    for i in range(900):
        a, b = rng.gamma(3, 4), rng.random()
        z = 0.15 * a + 2 * b - 4
        hit = [bool(rng.random() < 1 / (1 + math.exp(-(z + k)))) for k in range(3)]
        out.append((i, ("dev", "test")[i % 2], float(a), float(b), *hit, None if i % 3 else hit[0], False))
    out += [(1000, "dev", None, 0.5, True, True, True, None, False), (1001, "test", 3.0, float("nan"), True, True, True, None, False)]
    return out, spark.createDataFrame(out, "subject_id long, split string, model_a_score double, model_b_score double, mortality_30d boolean, mortality_90d boolean, mortality_1yr boolean, inhospital_mortality boolean, never boolean").repartition(3).cache()


@pytest.mark.parametrize("penalty", [1e-9, 1.0])
def test_grouped_fits_equal_single_fits(rows, penalty):
    data, df = rows
    long = sensitivity.by_horizon(df.where("split = 'dev'"), ["mortality_30d", "inhospital_mortality"]).withColumn("g", F.when(F.col("horizon") == "mortality_30d", "m"))
    fits = fit_groups(long, ["g"], "y", {"A": [F.col("model_a_score")], "A+B": [F.col("model_a_score"), F.col("model_b_score")]}, penalty)
    assert {(f.group, f.model) for f in fits} == {((g,), m) for g in ("m", None) for m in ("A", "A+B")}
    for f in fits:
        k = 4 if f.group[0] else 7
        held = [r for r in data if r[1] == "dev" and r[2] is not None and r[k] is not None]
        y, a, b = (np.array([r[c] for r in held], float) for c in (k, 2, 3))
        beta, likelihood = plain_fit(a[:, None] if f.model == "A" else np.column_stack([a, b]), y, penalty)
        assert f.beta == pytest.approx(beta, abs=1e-6) and f.log_likelihood == pytest.approx(likelihood) and (f.n, f.events) == (len(y), y.sum())
    one = [f for f in fits if f.group == ("m",) and f.model == "A"][0]
    single = metrics.logistic_fit(df.where("split = 'dev'").where("model_b_score IS NOT NULL"), "mortality_30d", [F.col("model_a_score")], penalty)
    assert single == pytest.approx(one.beta.tolist(), abs=1e-6)


def test_odd_groups(spark):
    df = spark.createDataFrame([("one", 1.0, True), ("one", 2.0, True), ("none", None, True), ("apart", 0.0, False), ("apart", 1.0, True), ("same", 3.0, True), ("same", 3.0, False)], "g string, x double, y boolean")
    fits = {f.group[0]: f for f in fit_groups(df, ["g"], "y", {"m": [F.col("x")]}, 0.01)}
    assert set(fits) == {"one", "apart", "same"} and all(np.isfinite(f.beta).all() for f in fits.values())
    assert fits["same"].log_likelihood == pytest.approx(2 * math.log(0.5)) and fits["apart"].beta[1] > 1
    assert fit_groups(df.where("false"), ["g"], "y", {"m": [F.col("x")]}) == []


def plain_auroc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return float(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)))


def test_battery_equals_plain_python(rows):
    data, df = rows
    dev, test = df.where("split = 'dev'"), df.where("split = 'test'")
    got = {r.horizon: r for r in sensitivity.horizon_battery(dev, test, [*sensitivity.HORIZONS, "never", "unknown"]).collect()}
    assert set(got) == {*sensitivity.HORIZONS, "never"}
    for k, horizon in ((7, "inhospital_mortality"), (4, "mortality_30d"), (5, "mortality_90d"), (6, "mortality_1yr")):
        (y, a, b), (ty, ta, tb) = ([np.array([r[c] for r in data if r[1] == split and r[2] is not None and r[3] == r[3] and r[k] is not None], float) for c in (k, 2, 3)] for split in ("dev", "test"))
        one, low = plain_fit(a[:, None], y, 1.0)
        _, high = plain_fit(np.column_stack([a, b]), y, 1.0)
        r = got[horizon]
        assert r.n == len(ty) and r.auroc_a == pytest.approx(plain_auroc(ty, ta)) and r.delta_auroc == pytest.approx(plain_auroc(ty, tb) - plain_auroc(ty, ta))
        p = 1 / (1 + np.exp(-(one[0] + one[1] * ta)))
        assert r.brier_a == pytest.approx(np.mean((p - ty) ** 2), abs=1e-8) and r.delta_brier == pytest.approx(r.brier_a - np.mean((tb - ty) ** 2), abs=1e-8)
        assert r.lrt == pytest.approx(max(2 * (high - low), 0), abs=1e-5) and r.p_value == pytest.approx(math.erfc(math.sqrt(r.lrt / 2)))
    # one class on dev: A's place between its ends
    ta = np.array([r[2] for r in data if r[1] == "test" and r[3] == r[3]])
    assert got["never"].lrt == 0 and got["never"].p_value == 1 and got["never"].brier_a == pytest.approx(np.mean(((ta - ta.min()) / (ta.max() - ta.min())) ** 2))


def test_battery_intervals_hold_the_points(rows):
    _, df = rows
    dev, test = df.where("split = 'dev'"), df.where("split = 'test'")
    points = {r.horizon: r.asDict() for r in sensitivity.horizon_battery(dev, test, sensitivity.HORIZONS).collect()}
    got = sensitivity.horizon_intervals(dev, test, sensitivity.HORIZONS, replicates=80).collect()
    assert {r.measure for r in got} == {f"{d}{m}{x}" for m in ("auroc", "auprc", "brier") for d, x in (("", "_a"), ("", "_b"), ("delta_", ""))}
    assert len(got) == 36 and all(r.low <= points[r.horizon][r.measure] <= r.high for r in got) and all((r.p is not None) == r.measure.startswith("delta_") for r in got)


def test_death_in_hospital_comes_from_the_first_recording(spark):
    import datetime as dt

    at = lambda d: dt.datetime(2020, 1, d)
    records = spark.createDataFrame([(1, 11, at(5)), (1, 12, at(9)), (2, 21, at(3)), (3, 31, at(1))], "subject_id long, study_id long, ecg_datetime timestamp")
    admissions = spark.createDataFrame([(1, 7, at(8), at(12), 1, None), (2, 8, at(2), at(4), 1, at(4)), (3, 9, at(1), at(2), 0, None)], "subject_id long, hadm_id long, admit_dt timestamp, disch_dt timestamp, hospital_expire_flag int, death_dt timestamp")
    p = spark.createDataFrame([(1,), (2,), (3,), (4,)], "subject_id long")
    got = {r.subject_id: r.inhospital_mortality for r in sensitivity.with_inhospital(p, records, admissions).collect()}
    assert got == {1: None, 2: True, 3: False, 4: None}
