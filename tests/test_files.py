"""Arrow IPC tables, digests and manifests through the store's own file system."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from riskloom.sources import files, ipc, provenance, tables

SCHEMA = "id long, name string, at timestamp, day date, xs array<double>, m struct<a:int,b:boolean>, raw binary"


def rows(n):
    return [(i, None if i % 5 == 0 else f"é{i}", dt.datetime(2020, 1, 1, 0, 0, i % 60), dt.date(2020, 1, 1 + i % 28), [1.5, None], (i, None), bytes([i % 256])) for i in range(n)]


@pytest.mark.parametrize("n,parts", [(0, 1), (1, 1), (500, 7)])
def test_round_trip(spark, tmp_path, n, parts):
    df = spark.createDataFrame(rows(n), SCHEMA).repartition(parts)
    for name in ("t.ipc", "t.arrow"):
        path = str(tmp_path / name)
        tables.save_table(df, path)
        back = tables.load_table(spark, path)
        assert back.dtypes == df.dtypes and sorted(back.collect(), key=lambda r: r.id) == sorted(df.collect(), key=lambda r: r.id)
        assert not (tmp_path / name / "_temporary").exists()
    tables.save_table(df.limit(0), path)
    assert tables.load_table(spark, path).count() == 0


def test_a_failed_write_leaves_no_table(spark, tmp_path):
    path = str(tmp_path / "t.ipc")
    bad = spark.range(100, numPartitions=4).select("id", F.expr("IF(id = 77, raise_error('stopped'), 'x')").alias("x"))
    with pytest.raises(Exception, match="stopped"):
        ipc.write_ipc(bad, path)
    assert not [p for p in (tmp_path / "t.ipc").glob("*.arrow")]
    with pytest.raises(FileNotFoundError, match="to its end"):
        ipc.read_ipc(spark, path).count()
    ipc.write_ipc(spark.range(3), path)
    assert ipc.read_ipc(spark, path).count() == 3


def test_other_endings_are_parquet_then_csv(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "p.data"))
    (tmp_path / "c.data").write_text("a,b\n1,x\n2,y\n")
    assert tables.load_table(spark, str(tmp_path / "p.data")).count() == 5
    assert [tuple(r) for r in tables.load_table(spark, str(tmp_path / "c.data")).orderBy("a").collect()] == [(1, "x"), (2, "y")]
    with pytest.raises(Exception):
        tables.load_table(spark, str(tmp_path / "none.data")).count()


def test_digests_of_files_and_folders(spark, tmp_path):
    (tmp_path / "one").write_bytes(b"abc" * 10_000)
    assert files.sha256_of(spark, str(tmp_path / "one")) == hashlib.sha256(b"abc" * 10_000).hexdigest()
    folder = tmp_path / "t"
    (folder / "sub").mkdir(parents=True)
    (folder / "b").write_bytes(b"b")
    (folder / "sub" / "a").write_bytes(b"a")
    before = files.sha256_of(spark, f"file://{folder}")
    (folder / "_SUCCESS").write_text("")
    (folder / ".b.crc").write_text("x")
    assert files.sha256_of(spark, str(folder)) == before and len(files.listed(spark, str(folder))) == 2
    (folder / "b").write_bytes(b"c")
    (folder / ".b.crc").unlink()
    assert files.sha256_of(spark, str(folder)) != before


def test_manifests_by_name(spark, tmp_path):
    path = f"file://{tmp_path}/p.parquet"
    spark.range(3).write.parquet(path)
    assert provenance.manifest_of(spark, path) is None
    (tmp_path / "run_manifest.json").write_text("{}")
    assert provenance.manifest_of(spark, path).endswith("/run_manifest.json")
    (tmp_path / "p.manifest.json").write_text("{}")
    assert provenance.manifest_of(spark, path).endswith("/p.manifest.json")
    provenance.write_manifest(spark, path, "real", note="é")
    held = json.loads(files.read_text(spark, provenance.manifest_of(spark, path)))
    assert held["note"] == "é" and held["artifact_sha256"] == files.sha256_of(spark, path)
