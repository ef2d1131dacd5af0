import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import signals


def response(b, a, f, fs):
    z = np.exp(-2j * np.pi * f / fs * np.arange(len(b)))
    return abs((b @ z) / (a @ z))


def test_filters_have_their_edges():
    for fs in (100, 500):
        b, a = signals.high_pass(fs)
        assert response(b, a, 0.67, fs) == pytest.approx(0.5**0.5) and response(b, a, 0, fs) == pytest.approx(0, abs=1e-9) and response(b, a, fs / 2, fs) == pytest.approx(1)
        b, a = signals.band_pass(fs)
        assert len(a) == 5 and [response(b, a, f, fs) for f in (5, 18)] == pytest.approx([0.5**0.5] * 2) and response(b, a, 9.5, fs) == pytest.approx(1, abs=0.01)


def test_zero_phase_keeps_the_place_and_squares_the_response():
    fs, t = 500, np.arange(5000) / 500
    b, a = signals.band_pass(fs)
    x = np.stack([np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 5 * t), np.full_like(t, 3.0)])
    y = signals.zero_phase(b, a, x)
    assert np.allclose(y[0, 1000:4000], response(b, a, 10, fs) ** 2 * x[0, 1000:4000], atol=1e-3) and np.allclose(y[1, 1000:4000], x[1, 1000:4000] / 2, atol=1e-3) and np.allclose(y[2], 0, atol=1e-8)
    with pytest.raises(ValueError):
        signals.zero_phase(b, a, np.zeros((1, 15)))


def test_resample():
    t = np.arange(200) / 100
    x = np.sin(2 * np.pi * 3 * t)[None]
    assert np.allclose(signals.resample(x, 100, 250)[0], np.sin(2 * np.pi * 3 * np.arange(500) / 250), atol=1e-9)
    assert np.allclose(signals.resample(x, 100, 50)[0], np.sin(2 * np.pi * 3 * np.arange(100) / 50), atol=1e-9)
    assert signals.resample(x, 100, 100) is not x and signals.resample(np.zeros((2, 0)), 1, 2).shape == (2, 0)
    for rates in ((0, 100), (100, -1)):
        with pytest.raises(ValueError):
            signals.resample(x, *rates)


def test_peaks_keep_the_higher_of_two_near_ones():
    x = np.array([0, 1, 0, 3, 3, 3, 0, 2, 0, 0, 0, 2.5, 0, 9])
    assert signals.peaks(x, 0.5, 1).tolist() == [1, 4, 7, 11]
    assert signals.peaks(x, 0.5, 4).tolist() == [4, 11] and signals.peaks(x, 1.5, 4).tolist() == [4, 11] and signals.peaks(np.ones(5), 0, 1).tolist() == []


def plain_features(x, fs):
    r = int(0.25 * fs)
    z = [v - statistics.median(x[r - int(0.08 * fs) : r - int(0.03 * fs)]) for v in x]
    first = r - int(0.08 * fs)
    onset = next((i for i in range(r, first, -1) if abs(z[i]) < 0.015), first)
    low = min(z[onset:r], default=0)
    q, ms = (-low, (r - onset) / fs * 1000) if low < -0.02 else (0, 0)
    top = max(0, max(z[r - int(0.02 * fs) : r + int(0.04 * fs)]))
    t = z[r + int(0.06 * fs) : r + int(0.40 * fs)]
    return [ms, q, top, max(0, -min(z[r : r + int(0.08 * fs)])), max(0, max(t)), max(0, -min(t)), q / top if top > 0.02 else 10 if q > 0.02 else 0]


def test_lead_features_equal_a_plain_version(spark):
    rng = np.random.default_rng(3)
    for fs in (100, 500):
        n = int(0.25 * fs) + int(0.45 * fs)
        beats = [[(rng.normal(size=n) * scale).tolist() for scale in (0.005, 0.02, 0.5)] for _ in range(20)] + [[[0.0] * n, [0.3] * n, [-0.1] * (n // 2) + [0.1] * (n - n // 2)]]
        df = spark.createDataFrame([(k, b) for k, b in enumerate(beats)], "k int, beat array<array<double>>")
        for row in df.select("k", signals.lead_features(F.col("beat"), fs).alias("f")).collect():
            for x, f in zip(beats[row["k"]], row["f"], strict=True):
                assert list(f) == pytest.approx(plain_features(x, fs))


def test_order_and_its_errors(spark):
    full = list(signals.CLINICAL)
    rows = [(1, [[float(k)] for k in range(12)], full), (2, [[1.0]], ["I"]), (3, [[1.0]] * 12, full[:-1] + ["I"]), (4, [[1.0]], full), (5, None, full), (6, [], [])]
    df = spark.createDataFrame(rows, "k int, signal array<array<double>>, leads array<string>")
    c = F.col("signal"), F.col("leads"), signals.CABRERA
    got = {r["k"]: (r["o"], r["e"]) for r in df.select("k", signals.reorder(*c).alias("o"), signals.lead_error(*c).alias("e")).collect()}
    assert got[1] == ([[4.0], [0.0], [-3.0], [1.0], [5.0], [2.0], [6.0], [7.0], [8.0], [9.0], [10.0], [11.0]], None)
    assert got[2][1].startswith("missing leads: aVL, -aVR") and got[3] == (None, "repeated lead name") and got[4][1] == "signal and lead names differ in number" and got[5] == (None, "no signal or no lead names")
    assert got[6][0] is None and got[6][1].startswith("missing")


def test_scores_and_errors_as_rows(spark):
    fs = 100
    t = np.arange(400) % 80
    beat = np.maximum(0, 1 - abs(t - 40) / 3) + 0.3 * np.maximum(0, 1 - abs(t - 60) / 8)
    good = [beat.tolist()] * 12
    rows = [(1, good), (2, [[0.0] * 400] * 12), (3, [beat[:50].tolist()] * 12), (4, [[float("nan")] * 400] * 12), (5, [beat.tolist()] * 11 + [beat[:300].tolist()]), (6, None), (7, [[None] * 400] * 12)]
    df = spark.createDataFrame(rows, "id int, signal array<array<double>>").withColumn("leads", F.array(*map(F.lit, signals.CLINICAL)))
    got = {r["id"]: r for r in signals.score_recordings(df, fs, keep=["id"]).collect()}
    assert len(got) == 7 and got[1]["is_valid"] and got[1]["category"] is not None
    assert 0.7 < got[1]["v2_r"] < 1.2 and got[1]["avr_r"] < 0.2 and got[1]["cornell"] > 0.7
    assert all(not got[k]["is_valid"] and got[k]["error"] and got[k]["total"] is None and got[k]["category"] is None for k in range(2, 8))
    assert signals.score_recordings(df.where("id < 0"), fs, keep=["id"]).count() == 0


def plain_r_peaks(x, banded, fs):
    steps = [0.0, *((b - a) ** 2 for a, b in zip(banded, banded[1:]))]
    w = int(0.10 * fs)
    energy = [sum(steps[j] for j in range(max(0, i - w // 2), min(len(x), i + (w - 1) // 2 + 1))) / w for i in range(len(x))]
    found = signals.peaks(np.array(energy), statistics.fmean(energy) + 0.4 * statistics.pstdev(energy), int(0.28 * fs))
    return [max(range(max(0, p - int(0.08 * fs)), min(len(x), p + int(0.08 * fs))), key=lambda i: abs(x[i])) for p in found]


def beat_train(fs, seconds, at, seed):
    t, rng = np.arange(int(fs * seconds)) / fs, np.random.default_rng(seed)
    x = sum(np.exp(-(((t - a) / 0.012) ** 2)) - 0.3 * np.exp(-(((t - a - 0.03) / 0.012) ** 2)) + 0.25 * np.exp(-(((t - a - 0.25) / 0.04) ** 2)) for a in at)
    return x + 0.01 * rng.normal(size=len(t))


def test_r_peaks_equal_a_plain_version():
    fs = 200
    leads = np.stack([beat_train(fs, 5, (0.05, 1.0, 2.0, 3.0, 4.0, 4.97), 1), -beat_train(fs, 5, (0.6, 1.3, 2.2, 3.9), 2), np.zeros(5 * fs)])
    banded = signals.zero_phase(*signals.band_pass(fs), leads)
    assert np.allclose(signals.slope_energy(leads[:1], 5), np.convolve(np.diff(leads[0], prepend=leads[0, 0]) ** 2, np.full(5, 0.2), "same"))
    got = signals.r_peaks(leads, fs)
    for k in range(2):
        assert got[k].tolist() == plain_r_peaks(leads[k].tolist(), banded[k].tolist(), fs)
    assert [round(p / fs, 1) for p in got[1]] == [0.6, 1.3, 2.2, 3.9] and len(got[2]) == 0
    assert [len(x) for x in signals.r_peaks(leads[:, : fs - 1], fs)] == [0, 0, 0]


def test_median_beat_equals_a_plain_version():
    fs, rng = 100, np.random.default_rng(5)
    leads = rng.normal(size=(3, 400))
    at = np.array([10, 60, 130, 200, 340, 370])
    got = signals.median_beat(leads, at, fs)
    whole = [r for r in at.tolist() if r - 25 >= 0 and r + 45 <= 400]
    assert whole == [60, 130, 200, 340] and got.shape == (3, 70)
    assert all(got[k, i] == pytest.approx(statistics.median(leads[k, r - 25 + i] for r in whole)) for k in range(3) for i in range(70))
    with pytest.raises(ValueError):
        signals.median_beat(leads, np.array([5, 390]), fs)


def test_scores_of_a_beat_train_have_their_values(spark):
    fs = 500
    lead = beat_train(fs, 10, np.arange(0.7, 9.5, 1.0), 3)
    sizes = [1.0, 0.9, 0.5, -0.6, 0.7, 0.8, 0.4, 0.6, 0.8, 1.0, 1.2, 0.9]  # in clinical order: aVR, aVL, aVF, V1 ... V6
    df = spark.createDataFrame([(1, [(k * lead).tolist() for k in sizes])], "id int, signal array<array<double>>").withColumn("leads", F.array(*map(F.lit, signals.CLINICAL)))
    got = signals.score_recordings(df, fs, keep=["id"]).first()
    r = 0.94  # what the high-pass filter and the baseline leave of the R wave
    s = got["v5_s"] / 1.2
    assert got["is_valid"] and got["v2_r"] == pytest.approx(0.6 * r, abs=0.05) and 0.1 < s < 0.4
    place = dict(zip(signals.CLINICAL, sizes, strict=True))
    assert got["cornell"] == pytest.approx(place["aVL"] / place["V2"] * got["v2_r"] + place["V3"] * s, rel=0.05)
    assert got["sokolow_lyon"] == pytest.approx(place["V1"] * s + max(place["V5"], place["V6"]) / place["V2"] * got["v2_r"], rel=0.05)
    assert got["total"] is not None and got["simplified"] <= got["total"] + 60
