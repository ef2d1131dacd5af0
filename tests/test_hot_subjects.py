"""Interval join, exact split and model workers where one key holds much of the rows."""

import datetime as dt
import os
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import adapters, cohort, signals, splits


def at(hours):
    return dt.datetime(2019, 12, 25) + dt.timedelta(hours=hours)


@pytest.mark.parametrize("days", [1, 30])
def test_interval_join_with_one_subject_holding_half_of_all_rows(spark, days):
    rng = random.Random(days)
    subject = lambda: 1 if rng.random() < 0.5 else rng.randint(2, 40)
    records = [(subject(), k, at(rng.randint(0, 3000))) for k in range(600)] + [(None, 900, at(5)), (1, 901, None), (1, 902, at(100)), (1, 903, at(200))]
    stays = []
    for k in range(300):
        start = rng.randint(-50, 3000)
        stays.append((subject(), k, at(start), at(start + rng.choice([0, 5, 100, 2000]))))
    stays += [(1, 901, at(50), at(40)), (1, 902, at(5), None), (None, 903, at(0), at(900)), (1, 904, at(100), at(200))]
    r = spark.createDataFrame(records, "subject_id long, study_id long, ecg_datetime timestamp").repartition(3)
    a = spark.createDataFrame(stays, "subject_id long, hadm_id long, admit_dt timestamp, disch_dt timestamp")
    for before in (0, 24):
        got = sorted((x.study_id, x.hadm_id) for x in cohort.link_admissions(r, a, before, days).collect())
        want = sorted((k, h) for s, k, t in records for p, h, x, y in stays if s is not None and s == p and t and y and x - dt.timedelta(hours=before) <= t <= y)
        assert got == want and len(set(got)) == len(got)
    assert cohort.link_admissions(r, a).columns == ["subject_id", "study_id", "ecg_datetime", "hadm_id", "admit_dt", "disch_dt"]
    plan = cohort.link_admissions(r, a, 0, days)._jdf.queryExecution().optimizedPlan().toString()
    assert "_span" in plan


def test_places_of_keys(spark):
    ids = random.Random(3).sample(range(10**12), 5000)
    df = spark.createDataFrame([(i,) for i in ids for _ in range(1 + i % 2)], "subject_id long").repartition(5)
    assert {r.subject_id: r.position for r in splits.positions(df).collect()} == {i: k for k, i in enumerate(sorted(ids))}
    assert splits.positions(df.where("false")).collect() == []


@pytest.mark.parametrize("n,seed", [(1, 0), (7, 42), (3001, 5)])
def test_permuted_split_equals_numpy(spark, n, seed):
    ids = random.Random(n).sample(range(10**9), n)
    df = spark.createDataFrame([(i, k) for i in ids for k in range(2)] + [(None, 0)], "subject_id long, k int").repartition(4)
    order = np.array(sorted(ids))[np.random.default_rng(seed).permutation(n)]
    dev, val = round(n * 0.6), round(n * 0.2)
    want = {int(i): "dev" if k < dev else "val" if k < dev + val else "test" for k, i in enumerate(order)}
    got = splits.permuted_split(df, seed=seed).collect()
    assert len(got) == 2 * n + 1 and all(r.split == want.get(r.subject_id) for r in got)


def test_a_model_is_built_once_per_worker_process(spark, tmp_path):
    folder = str(tmp_path)

    class Model:
        dim = 1

        def embed(self, batch):
            return batch[:, 0, :1]

    def make():
        Path(folder, f"{os.getpid()}-{random.random()}").touch()
        return Model()

    df = spark.range(64).withColumn("signal", F.array(*(F.array(*(F.lit(float(k + j)) for j in range(4))) for k in range(12)))).withColumn("leads", F.array(*map(F.lit, signals.CLINICAL))).repartition(8)
    spec = adapters.Spec("counted", "1", dim=1, fs=10, samples=4)
    for _ in range(2):
        assert adapters.embed(df, make, spec, 10, ["id"], batch_size=5).where("is_valid").count() == 64
    pids = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(pids) == len(set(pids)) <= 8


def test_a_stop_reads_the_input_no_more(spark, tmp_path):
    """The third part fails once: the next call goes on from the rows dealt before, and clears them."""
    path, bad = f"file://{tmp_path}/e", tmp_path / "bad"
    spec = adapters.Spec("stopped", "1", dim=1, fs=10, samples=4)

    class Model:
        dim = 1

        def embed(self, batch):
            return batch[:, 0, :1]

    def make():
        if bad.exists():
            raise MemoryError("stopped")
        return Model()

    df = spark.range(30).withColumn("signal", F.array(*(F.array(*(F.lit(1.0) for _ in range(4))) for _ in range(12)))).withColumn("leads", F.array(*map(F.lit, signals.CLINICAL)))
    bad.touch()
    with pytest.raises(Exception, match="stopped"):
        adapters.embed_resumable(df, make, spec, 10, "id", path, chunks=4)
    dealt = [p for p in (tmp_path / "e").iterdir() if p.name.endswith("-input")]
    assert len(dealt) == 1
    before = {p: p.stat().st_mtime_ns for p in dealt[0].rglob("*.parquet")}
    bad.unlink()
    (dealt[0] / "_SUCCESS").touch()
    assert before and adapters.embed_resumable(df, make, spec, 10, "id", path, chunks=4).where("is_valid").count() == 30
    assert not dealt[0].exists()
