import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from riskloom.functions import metrics
from riskloom.operators import cohort, outcomes, rulescore, splits
from riskloom.operators.probe import Probe, fit_probe, sigmoid
from riskloom.sources import bindings, provenance

T = lambda *a: dt.datetime(*a)


@pytest.fixture(scope="module")
def study(spark):
    records = spark.createDataFrame([(1, 101, T(2150, 1, 1, 10)), (1, 102, T(2150, 1, 1, 10)), (1, 103, T(2152, 6, 1, 12)), (2, 201, T(2160, 3, 15, 8)), (2, 202, T(2165, 4, 20, 16)), (3, 301, T(2140, 11, 10, 14)), (4, 401, T(2155, 9, 1, 9))], "subject_id long, study_id long, ecg_datetime timestamp_ntz")
    patients = spark.createDataFrame([(1, "M", 50, 2150, dt.date(2153, 1, 1)), (2, "F", 15, 2160, None), (3, "F", 80, 2140, dt.date(2141, 5, 1))], "subject_id long, gender string, anchor_age long, anchor_year long, dod_date date")
    admissions = spark.createDataFrame([(1, 10001, T(2150, 1, 1, 8), T(2150, 1, 5, 12)), (1, 10002, T(2152, 6, 1, 10), T(2152, 6, 10, 18)), (2, 20001, T(2160, 3, 15, 12), T(2160, 3, 20, 10))], "subject_id long, hadm_id long, admit_dt timestamp_ntz, disch_dt timestamp_ntz")
    return records, patients, admissions


def test_cohort(study):
    records, patients, admissions = study
    aged = cohort.age_at_recording(records, patients)
    assert sorted((r.subject_id, r.age_at_ecg) for r in aged.collect()) == [(1, 50), (1, 50), (1, 52), (2, 15), (2, 20), (3, 80)]
    assert [cohort.link_admissions(records, admissions, h).count() for h in (0, 24)] == [3, 4]
    grown = cohort.adults(aged)
    assert {r.subject_id: r.study_id for r in cohort.index_recordings(grown).collect()} == {1: 101, 2: 202, 3: 301}
    assert {r.subject_id: r.study_id for r in cohort.index_recordings(records, "latest").collect()}[1] == 103
    flow = cohort.cohort_flow(records, [("linked", aged), ("adult", grown), ("index", cohort.index_recordings(grown))]).orderBy("step").collect()
    assert [(r.records, r.subjects) for r in flow] == [(7, 4), (6, 3), (5, 3), (3, 3)]
    assert [r.excluded_records for r in flow] == [0, 1, 1, 2]
    with pytest.raises(ValueError):
        cohort.adults(records)


def test_outcomes(spark):
    day = lambda *a: dt.date(*a)
    dods = [day(2150, 1, 11), day(2150, 1, 31), day(2150, 2, 1), day(2150, 4, 1), day(2150, 4, 11), day(2151, 1, 1), day(2151, 5, 16), None, day(2149, 12, 31), day(2150, 1, 1)]
    records = spark.createDataFrame([(i, 100 + i, T(2150, 1, 1, 12)) for i in range(1, 11)], "subject_id long, study_id long, ecg_datetime timestamp_ntz")
    patients = spark.createDataFrame(list(enumerate(dods, 1)), "subject_id long, dod_date date")
    stay = [(1, 2001, T(2150, 1, 15, 18), T(2150, 1, 11, 14, 30), 1), (2, 2002, T(2150, 2, 5, 18), None, 0), (8, 2008, T(2150, 1, 10, 12), None, 0), (10, 2010, T(2150, 1, 1, 18), T(2150, 1, 1, 18), 1)]
    admissions = spark.createDataFrame([(s, h, T(2150, 1, 1, 8), d, x, f) for s, h, d, x, f in stay], "subject_id long, hadm_id long, admit_dt timestamp_ntz, disch_dt timestamp_ntz, death_dt timestamp_ntz, hospital_expire_flag long")
    got = {r.subject_id: r for r in outcomes.mortality_outcomes(records, patients, admissions).collect()}
    assert [got[i].mortality_30d for i in range(1, 11)] == [True, True, False, False, False, False, False, False, None, True]
    assert [got[i].mortality_90d for i in (3, 4, 5, 8)] == [True, True, False, False] and [got[i].mortality_1yr for i in (4, 5, 6, 7)] == [True, True, True, False]
    assert got[1].days_to_death == pytest.approx(10.1041666667) and not got[9].is_valid and got[9].exclusion_reason == outcomes.AFTER_DEATH
    strict = outcomes.mortality_outcomes(records, patients, admissions, outcomes.FollowUpPolicy(True)).where("subject_id = 8").first()
    assert not strict.is_valid and strict.mortality_30d is None
    inside = {r.study_id: r for r in outcomes.inhospital_mortality(records, admissions).collect()}
    assert inside[101].in_hospital_mortality and inside[101].linked_hadm_id == 2001 and not inside[102].in_hospital_mortality and inside[103].in_hospital_mortality is None and inside[103].linked_hadm_id is None and len(inside) == 10
    assert outcomes.death_table(patients, None).where("in_hosp_death_flag = 0").count() == 10


def test_splits_and_guards(spark):
    df = spark.createDataFrame([(i // 2, i) for i in range(200)], "subject_id long, study_id long")
    got = splits.permuted_split(df)
    assert {r["split"]: r["n"] for r in got.groupBy("split").agg(F.countDistinct("subject_id").alias("n")).collect()} == {"dev": 60, "val": 20, "test": 20}
    splits.verify_disjoint(got)
    assert splits.overlapping_subjects(splits.hashed_split(df)).count() == 0
    with pytest.raises(ValueError):
        splits.verify_disjoint(spark.createDataFrame([(1, "dev"), (1, "test")], "subject_id long, split string"))
    assert splits.firewall(["anchor_age", "model_a_score", "vital_x", "Median", "stage", "x1"]) == ["anchor_age", "vital_x", "Median", "stage"]
    with pytest.raises(ValueError):
        splits.SplitRatios(0.5, 0.5, 0.5)


def test_metrics(spark):
    rows = [("a", 0, 0.1), ("a", 0, 0.2), ("a", 1, 0.8), ("a", 1, 0.9), ("b", 0, 0.9), ("b", 1, 0.1), ("c", 1, 0.5), ("d", 0, 0.5), ("e", 0, 0.5), ("e", 1, 0.5)]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    got = {r.g: (r.auroc, r.auprc) for r in metrics.discrimination(df, ["g"], "y", "s").collect()}
    assert got == {"a": (1, 1), "b": (0, 0.5), "c": (0.5, 1), "d": (0.5, 0), "e": (0.5, 0.5)}
    line = spark.createDataFrame([("x", float(i), 10.0 * i) for i in range(1, 6)] + [("k", 1.0, float(i)) for i in range(5)], "g string, a double, b double")
    rho = {r.g: (round(r.pearson, 9), round(r.spearman, 9)) for r in metrics.correlations(line, ["g"], "a", "b").collect()}
    assert rho == {"x": (1, 1), "k": (0, 0)}
    assert metrics.calibration(df.limit(2), "y", "s") == (1.0, 0.0) and metrics.chi2_sf_1(3.8415) == pytest.approx(0.05, abs=1e-5)


def test_rule_items(spark):
    def item(k, **values):
        m = {f: F.lit(float(values.get(f, 0.0))) for f in rulescore.FIELDS}
        return spark.range(1).select(rulescore.items(m)[k - 1]).first()[0]

    assert [item(1, avl_q_ms=x) for x in (0, 10, 15, 20, 25, 30, 35, 40, 45, 50, 60)] == [5, 1, 1, 3, 3, 9, 9, 10, 10, 12, 12]
    assert [round(item(2, avl_t_pos=p, avl_t_neg=n), 9) for p, n in ((0.15, 0), (0.04, 0), (0.35, 0), (0, 0.1), (0, 0.2))] == [0, 3, 3, 5.3, 7.6]
    assert [item(4, avr_t_pos=x) for x in (0, 0.1, 0.2, 0.3, 0.4)] == [6, 3, 0, -2, -5] and item(4, avr_t_pos=0.6) == pytest.approx(-9)
    one = spark.createDataFrame([([float(i) for i in range(100)],)], "x array<double>")
    x = one.select(*(rulescore.pad_or_crop(F.col("x"), 60, a).alias(a) for a in ("start", "end", "center")), rulescore.pad_or_crop(F.col("x"), 103, mode="edge").alias("edge"), rulescore.scale_units(F.col("x"), "mV", "uV").alias("uv")).first()
    assert (x.start[0], x.end[0], x.center[0], x.center[-1], x.edge[-1], len(x.edge)) == (0, 40, 20, 79, 99, 103) and x.uv[1] == pytest.approx(1000)


def test_probe_and_provenance(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5)], int(i % 7 > 3), ("dev", "val")[i % 2]) for i in range(300)], "id long, e array<double>, y int, split string")
    probe = fit_probe(df, "e", "y", grid=(0.01, 1.0))
    assert Probe.from_json(probe.to_json()) == probe and set(probe.history) == {"0.01", "1.0"}
    scored = df.withColumn("p", sigmoid(probe.log_odds(F.col("e"))))
    assert metrics.discrimination(scored, [], "y", "p").first().auroc > 0.99
    held = bindings.predictions(spark, "/root/testdata/sf0.001")
    said = provenance.run_manifest(held, "real", 42, probe)
    assert said["rows"]["all"] == held.count() == sum(said["rows"][s] for s in ("dev", "val", "test")) and said["events"]["all"] == held.where("mortality_30d").count() and said["probe_c"] == probe.best_c
    assert said["rows_sha256"] == provenance.rows_checksum(held.repartition(5), bucket_rows=10**6) != provenance.rows_checksum(held.where("subject_id > 1"))
    for name in ("p.csv", "other"):
        provenance.save_predictions(held, str(tmp_path / name))
        assert provenance.load_predictions(spark, str(tmp_path / name)).count() == held.count()
    with pytest.raises(ValueError):
        provenance.save_predictions(held.unionByName(held), str(tmp_path / "twice"))
    path = tmp_path / "p.parquet"
    bindings.predictions(spark, "/root/testdata/sf0.001").write.parquet(str(path))
    with pytest.raises(ValueError):
        provenance.load_verified(spark, str(path))
    provenance.write_manifest(spark, str(path), "real", seed=42)
    assert provenance.load_verified(spark, str(path))[1] == "real"
    (tmp_path / "p.parquet.manifest.json").write_text(json.dumps([1]))
    assert provenance.load_verified(spark, str(path), allow_unverified=True)[1] == "unverified"
