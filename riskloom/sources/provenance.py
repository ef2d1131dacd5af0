"""Manifests beside prediction tables, and loading that fails closed."""

from __future__ import annotations

import hashlib
import json
import subprocess
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.splits import verify_predictions
from riskloom.sources import files
from riskloom.sources.tables import load_table, save_table


def manifest_of(spark: SparkSession, path: str) -> str | None:
    """The manifest beside a table: by its whole name, its name without ending, or the run's."""
    folder, _, name = path.rstrip("/").rpartition("/")
    names = (f"{name}.manifest.json", f"{name.rpartition('.')[0] or name}.manifest.json", "run_manifest.json")
    return next((p for n in names if files.exists(spark, p := f"{folder}/{n}" if folder else n)), None)


def write_manifest(spark: SparkSession, path: str, mode: str, **more: object) -> str:
    out = f"{path.rstrip('/')}.manifest.json"
    files.write_text(spark, out, json.dumps({"created": datetime.now(timezone.utc).isoformat(), "execution_mode": mode, "artifact_sha256": files.sha256_of(spark, path), **more}, indent=1))
    return out


def git_sha(folder: str | None = None) -> str | None:
    """The commit that is checked out, None where there is none."""
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], cwd=folder, capture_output=True, text=True, check=True, timeout=5).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def rows_checksum(df: DataFrame, keys: tuple[str, ...] = ("subject_id", "study_id"), columns: tuple[str, ...] = ("model_a_score", "model_b_score"), bucket_rows: int = 100_000) -> str:
    """SHA-256 over keys and scores, the same for the same rows in any order. Rows are hashed in buckets of a bounded size, buckets
    by the thousand, so only a few digests reach the driver."""
    text = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in (*keys, *columns)))
    buckets = max(1, -(-df.count() // bucket_rows))
    rows = df.select(F.sha2(text, 256).alias("h")).withColumn("b", F.pmod(F.xxhash64("h"), F.lit(buckets)))
    joined = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), ""), 256)
    digests = rows.groupBy("b").agg(joined("h").alias("d")).groupBy((F.col("b") / 1000).cast("long")).agg(joined("d").alias("d"))
    return hashlib.sha256("".join(sorted(r["d"] for r in digests.collect())).encode()).hexdigest()


def run_manifest(df: DataFrame, mode: str, seed: int, probe: object = None, model_revision: str | None = None, notes: str | None = None, outcome: str = "mortality_30d") -> dict[str, object]:
    """What a manifest says of a table of predictions, after its checks: commit, checksum, rows, events and valid scores."""
    verify_predictions(df)
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    parts = {"all": F.lit(True), **{s: F.col("split") == s for s in ("dev", "val", "test")}}
    event, a, b = F.col(outcome).cast("boolean"), F.col("model_a_valid"), F.col("model_b_valid")
    held = df.agg(*(n(c).alias(f"rows_{s}") for s, c in parts.items()), *(n(c & event).alias(f"events_{s}") for s, c in parts.items()), n(a).alias("valid_a"), n(b).alias("valid_b"), n(a & b).alias("valid_both")).first()
    counts = lambda kind: {s: held[f"{kind}_{s}"] for s in parts}
    return {
        "seed": seed, "mode": mode, "git_sha": git_sha(), "model_revision": model_revision, "rows_sha256": rows_checksum(df), "rows": counts("rows"), "events": counts("events"),
        "valid": {k: held[f"valid_{k}"] for k in ("a", "b", "both")}, "probe_c": getattr(probe, "best_c", None), "probe_history": getattr(probe, "history", None), "notes": notes,
    }


def save_predictions(df: DataFrame, path: str) -> None:
    """Checks a table of predictions, then writes it in the format of the path's ending."""
    verify_predictions(df)
    save_table(df, path)


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Reads a table of predictions by the path's ending and checks it."""
    df = load_table(spark, path)
    verify_predictions(df)
    return df


def load_verified(spark: SparkSession, path: str, real: bool = True, allow_unverified: bool = False) -> tuple[DataFrame, str]:
    """(table, mode). In real mode a missing, unreadable, simulated or mismatched manifest is an error, or with
    allow_unverified degrades the mode to `unverified`."""
    problem, mode, found = None, "unverified", manifest_of(spark, path)
    if found is None:
        problem = "no manifest"
    else:
        try:
            held, digest = json.loads(files.read_text(spark, found)), files.sha256_of(spark, path)
        except (ValueError, Py4JJavaError):  # no JSON, or a store that finds the file or the table damaged
            held, digest = None, None
        if not isinstance(held, dict):
            problem = "the manifest or the table can't be read"
        elif not held.get("execution_mode"):
            problem = "the manifest names no mode"
        elif real and held["execution_mode"] != "real":
            problem = f"made in {held['execution_mode']} mode"
        elif held.get("artifact_sha256") != digest:
            problem = "the artifact's hash is missing or differs"
        else:
            mode = held["execution_mode"]
    if problem and real and not allow_unverified:
        raise ValueError(f"{path}: {problem}")
    return load_predictions(spark, path), "unverified" if problem else mode
