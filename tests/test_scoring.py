import json
from pathlib import Path
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom import cli
from riskloom.operators import adapters, battery, reports, scoring, splits, synthesis
from riskloom.sources import provenance, synthetic


def index(spark, n):
    return splits.hashed_split(spark.range(n).select(F.col("id").alias("subject_id"), (F.col("id") + 5000).alias("study_id")))


def test_simulated_predictions(spark):
    made, embedded = synthetic.simulate(index(spark, 4000), 7)
    p = made.toPandas().sort_values("subject_id").reset_index(drop=True)
    again = synthetic.simulate(index(spark, 4000).repartition(5), 7)[0].toPandas().sort_values("subject_id").reset_index(drop=True)
    assert p.equals(again) and not p.equals(synthetic.simulate(index(spark, 4000), 8)[0].toPandas().sort_values("subject_id").reset_index(drop=True))
    assert p.model_a_score.between(0, 45).all() and p.model_a_score.mean() == pytest.approx(12, abs=0.5) and p.model_a_score.std() == pytest.approx(math.sqrt(48), abs=0.5)
    e = np.stack(embedded.toPandas().sort_values("subject_id").embedding)
    assert e.shape == (4000, 16) and abs(e.mean()) < 0.02 and e.std() == pytest.approx(1, abs=0.02)
    w = np.random.default_rng(7).normal(size=16)
    z = 0.08 * p.model_a_score + 0.2 * (e @ w) - 1.5
    assert np.allclose(p.model_b_log_odds, z) and np.allclose(p.model_b_score, 1 / (1 + np.exp(-z)))
    chance = 1 / (1 + np.exp(-(0.12 * p.model_a_score + 2.5 * p.model_b_score - 3.2)))
    assert p.mortality_30d.mean() == pytest.approx(chance.mean(), abs=0.03) and (p.mortality_30d == p.mortality_1yr).all()


def test_simulation_keeps_labels_and_makes_a_few_events(spark):
    few = synthetic.simulate(index(spark, 6), 1)[0]
    assert few.where("mortality_30d").count() >= 5
    labelled = index(spark, 50).withColumn("mortality_30d", F.lit(False))
    assert synthetic.simulate(labelled, 1)[0].where("mortality_30d").count() == 0
    assert synthetic.simulate(index(spark, 0), 1)[0].count() == 0


def test_cached_scores(spark, tmp_path):
    cohort, path, calls = index(spark, 4), f"file://{tmp_path}/a", []

    def compute(n=4):
        calls.append(n)
        return index(spark, n).withColumn("model_a_score", F.lit(1.0))

    for _ in range(2):
        assert scoring.cached(cohort, path, compute).count() == 4
    assert calls == [4]
    other = cohort.withColumn("study_id", F.col("study_id") + 1)
    scoring.cached(other, path, compute)
    scoring.cached(cohort, path, compute, "another")
    assert calls == [4, 4, 4]
    scoring.cached(cohort, None, compute)
    assert len(calls) == 4


def write_record(folder, name, signal):
    leads = ["I", "II", "III", "aVR", "aVL", "aVF", "V1", "V2", "V3", "V4", "V5", "V6"]
    (folder / f"{name}.dat").write_bytes(np.round(signal * 1000).astype("<i2").T.tobytes())
    lines = [f"{name} 12 500 {signal.shape[1]}", *(f"{name}.dat 16 1000(0)/mV 16 0 0 0 0 {lead}" for lead in leads)]
    (folder / f"{name}.hea").write_text("\n".join(lines) + "\n")


def test_real_predictions_and_resume(spark, tmp_path):
    root = tmp_path / "r"
    (root / "files").mkdir(parents=True)
    rng = np.random.default_rng(0)
    t = np.arange(2500) / 500
    for k in range(12):
        beat = sum(np.exp(-(((t - c) / 0.012) ** 2)) for c in np.arange(0.4, 5, 0.8)) * (1 + 0.1 * k)
        write_record(root / "files", f"x{k}", np.stack([beat * (0.5 + 0.05 * lead) for lead in range(12)]) + rng.normal(0, 0.005, (12, 2500)))
    rows = [(k, 100 + k, f"files/x{k}", ("dev", "dev", "val", "test")[k % 4], k % 2 == 0 if k % 4 < 2 else k % 3 == 0) for k in range(13)]
    cohort = spark.createDataFrame(rows, "subject_id long, study_id long, path string, split string, mortality_30d boolean")
    spec = adapters.Spec("spectrum", "1", dim=8, samples=2500)
    make = lambda: adapters.SpectrumProjection(8)
    made, probe = scoring.build(cohort, str(root), make, spec, checkpoint=f"file://{tmp_path}/c")
    p = made.toPandas().sort_values("subject_id").reset_index(drop=True)
    assert len(p) == 13 and p.model_a_valid.tolist() == [True] * 12 + [False] and p.model_b_valid.tolist() == [True] * 12 + [False]
    assert p.model_a_score.notna().sum() == 12 and p.model_b_score[:12].between(0, 1).all() and "no signal" in p.model_b_error[12]
    again, other = scoring.build(cohort, str(root), make, spec, checkpoint=f"file://{tmp_path}/c")
    assert other.best_c == probe.best_c and again.count() == 13
    with pytest.raises(ValueError, match="both outcomes"):
        scoring.build(cohort.withColumn("mortality_30d", F.lit(True)), str(root), make, spec, checkpoint=f"file://{tmp_path}/c")


def test_validity_counts_nulls_as_failures(spark):
    df = spark.createDataFrame([("dev", True, None), ("dev", True, True), ("test", None, False)], "split string, model_a_valid boolean, model_b_valid boolean")
    assert sorted(map(tuple, scoring.validity(df).collect())) == [("dev", 2, 2, 1, 1, 100.0, 50.0, 50.0), ("test", 1, 0, 0, 0, 0.0, 0.0, 0.0)]


def test_battery_runs_what_it_has_inputs_for(spark):
    made, embedded = (df.cache() for df in synthetic.simulate(index(spark, 600), 3))
    alone = battery.run(made, ("mortality_30d", "no_such_column"), replicates=0)
    assert set(alone) == {"horizons", "directions"} and [r["horizon"] for r in alone["horizons"].collect()] == ["mortality_30d"]
    people = spark.range(600).select(F.col("id").alias("subject_id"), F.when(F.col("id") < 4, "M").otherwise("F").alias("gender"), F.when(F.col("id") % 2 == 0, 70).cast("long").alias("anchor_age"))
    more = battery.run(made, ("mortality_30d",), patients=people, embeddings=embedded, quality=F.col("subject_id") % 2 == 0, scores=["model_a_score"], replicates=5)
    assert set(more) == {"horizons", "horizons_intervals", "subgroups", "subgroups_intervals", "subgroup_contrasts", "quality", "alternative_scores", "probe_variants", "probe_variants_intervals", "directions"}
    assert {r["subgroup"] for r in more["subgroups"].collect()} == {">=65", "F"}
    assert more["directions"].first()["comparisons"] == 1 + 2 + 2 + 1


def test_utility_and_claims(spark):
    gains = spark.createDataFrame([("auroc", 0.1, 0.05, 0.2), ("brier", 0.01, -0.01, 0.02)], "measure string, point double, low double, high double")
    row = synthesis.utility_distinction(gains, 80.0, 1e-20).first()
    assert row["adds_information"] and "p < 10^-15" in row["summary"] and "0.1000 (0.0500 to 0.2000)" in row["summary"] and "0.1500 wide" in row["boundary"]
    none = synthesis.utility_distinction(gains.where("measure = 'brier'")).first()
    assert not none["adds_information"] and none["gain_auroc"] is None and "no test" in none["summary"]
    claim = spark.createDataFrame([("This was Externally Validated.",)], "text string")
    with pytest.raises(ValueError, match="externally validated"):
        reports.render("interpret", "real", {"findings": claim})
    assert "SIMULATED" in reports.render("analyze", "simulation", {"gains": gains}) and "What both gain" in reports.render("analyze", None, {"gains": gains})


def test_real_mode_fails_closed(spark, tmp_path, capsys):
    out, data = str(tmp_path / "o"), "/root/testdata/sf0.001"
    assert cli.main(["probe", "--data", data, "--out", out], spark) == 1 and "no recordings" in capsys.readouterr().err
    assert cli.main(["probe", "--data", data, "--out", out, "--simulate", "--max-records", "40"], spark) == 0
    manifest = json.loads(Path(provenance.manifest_of(spark, f"{out}/predictions.parquet")).read_text())
    assert manifest["execution_mode"] == "simulation" and manifest["rows"]["all"] == 40 and spark.read.parquet(f"{out}/predictions.parquet").count() == 40
    assert cli.main(["interpret", "--data", data, "--out", out], spark) == 1 and "simulation mode" in capsys.readouterr().err
    assert cli.main(["inventory", "--clinical-root", str(tmp_path), "--recordings-root", str(tmp_path), "--out", out], spark) == 1 and "not found" in capsys.readouterr().err
