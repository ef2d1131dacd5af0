import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom import cli
from riskloom.operators import adapters, signals, synthesis


class Picky:
    dim = 2

    def embed(self, batch):
        if (batch[:, 0, 0] > 8).any():
            raise RuntimeError("too large")
        return np.stack([batch[:, 0, 0], np.where(batch[:, 0, 0] == 7, np.nan, 4.0)], axis=1)


SPEC = adapters.Spec("picky", "1", dim=2, fs=10, samples=20)


def recordings(spark):
    rows = [(1, [[3.0] * 15] * 12), (2, [[9.0] * 15] * 12), (3, [[7.0] * 15] * 12), (4, None), (5, [[float("nan")] * 15] * 12), (6, [[]] * 12), (7, [[3.0] * 40] * 12)]
    return spark.createDataFrame(rows, "id int, signal array<array<double>>").withColumn("leads", F.array(*map(F.lit, signals.CLINICAL))).coalesce(1)


def test_a_bad_recording_fails_alone(spark):
    got = {r["id"]: r for r in adapters.embed(recordings(spark), Picky, SPEC, 10, ["id"]).collect()}
    assert len(got) == 7 and [k for k in got if got[k]["is_valid"]] == [1, 7]
    assert got[1]["embedding"] == pytest.approx([0.6, 0.8]) and got[7]["embedding"] == pytest.approx([0.6, 0.8])
    assert "too large" in got[2]["error"] and "finite" in got[3]["error"] and "no signal" in got[4]["error"] and all(got[k]["embedding"] is None for k in (2, 3, 4, 5, 6))


def test_embedding_resumes(spark, tmp_path):
    df, path = recordings(spark), f"file://{tmp_path}/e"
    first = adapters.embed_resumable(df, Picky, SPEC, 10, "id", path, chunks=3)
    assert first.count() == 7
    (folder,) = (tmp_path / "e").iterdir()
    kept = {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet") if "part=0" not in str(p)}
    (folder / "part=0" / "_SUCCESS").unlink()
    assert adapters.embed_resumable(df, Picky, SPEC, 10, "id", path, chunks=3).count() == 7
    assert all(p.stat().st_mtime_ns == t for p, t in kept.items())
    assert adapters.embed_resumable(df.where("id < 4"), Picky, SPEC, 10, "id", path, chunks=3).count() == 3 and len(list((tmp_path / "e").iterdir())) == 2
    louder = df.withColumn("signal", F.transform("signal", lambda lead: F.transform(lead, lambda x: x * 2.0)))
    assert adapters.embed_resumable(louder, Picky, SPEC, 10, "id", path, chunks=3).count() == 7 and len(list((tmp_path / "e").iterdir())) == 3


def test_command_line(spark, tmp_path, capsys):
    assert cli.main([], spark) == 0 and "usage" in capsys.readouterr().out
    assert cli.main(["inventory", "--data", str(tmp_path / "none"), "--out", str(tmp_path)], spark) == 1
    for stage in ("inventory", "cohort", "probe", "interpret"):
        assert cli.main([stage, "--data", "/root/testdata/sf0.001", "--out", str(tmp_path / "out"), "--simulate", "--bootstraps", "5", "--verbose"], spark) == 0
        assert (tmp_path / "out" / stage / "report.md").read_text().startswith(f"# {stage}")
    assert "gain in AUROC" in (tmp_path / "out" / "interpret" / "report.md").read_text()


def test_synthesis_edges(spark):
    assert synthesis.correlation_p(0.5, 3) == pytest.approx(2 / 3) and synthesis.correlation_p(0.5, 2) == 1.0 and synthesis.correlation_p(1.0, 9) == 0.0 and synthesis.correlation_p(0.0, 9) == 1.0
    empty = spark.createDataFrame([], "subject_id long, model_a_score double, model_b_score double, model_a_valid boolean, model_b_valid boolean, model_a_category string, mortality_30d boolean")
    with pytest.raises(ValueError):
        synthesis.findings(empty, empty)
    row = synthesis.failure_summary(spark.createDataFrame([(True, None), (False, True), (True, True), (None, True)], "model_a_valid boolean, model_b_valid boolean")).first()
    assert list(row) == [4, 2, 1, 0.5, 0.25, 2]
