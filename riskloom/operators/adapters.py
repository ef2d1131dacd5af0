"""Models that turn recordings into embeddings, run over Arrow batches with one model per worker.

A model is any object with `dim` and embed(batch): recordings by leads by samples to recordings by dim. A recording
it can't take, or for which it fails or gives values that aren't finite, keeps its row with a message in `error`.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators import signals
from riskloom.session import ship

#: Recordings a model gets at once.
BATCH = 32


class Model(Protocol):
    dim: int

    def embed(self, batch: np.ndarray) -> np.ndarray: ...


@dataclass(frozen=True)
class Spec:
    """What a model is fed: name and version, lead order, sampling rate, samples per lead."""

    name: str
    version: str
    dim: int
    leads: tuple[str, ...] = signals.CANONICAL
    fs: int = 500
    samples: int = 5000
    normalize: bool = True


class SpectrumProjection:
    """A model without weights to load: a fixed random projection of the leads' lowest frequencies."""

    def __init__(self, dim: int = 64, lines: int = 16, seed: int = 42):
        self.dim, self.lines, self.seed = dim, lines, seed

    def embed(self, batch: np.ndarray) -> np.ndarray:
        lines = np.abs(np.fft.rfft(batch, axis=-1))[..., : self.lines].reshape(len(batch), -1) / max(batch.shape[-1], 1)
        weights = np.random.default_rng(self.seed).normal(size=(lines.shape[1], self.dim))
        return np.tanh(lines @ weights)


#: What a worker process has built, by what builds it.
_MODELS: dict[str, Model] = {}


def held_model(key: str, make: Callable[[], Model]) -> Model:
    """make() once per process and key. Tasks reach this function through its module, so they share the process's models."""
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = make()
    return _MODELS[key]


def fingerprint(spec: Spec, fs: int, **more: object) -> str:
    return hashlib.sha256(json.dumps({**asdict(spec), "source_fs": fs, **more}, sort_keys=True).encode()).hexdigest()


def _prepared(x: np.ndarray | None, spec: Spec, fs: int) -> tuple[np.ndarray | None, str | None]:
    """A recording at the model's rate and length (padded with zeros or cut at the end), or why not."""
    if x is None:
        return None, "no signal, or leads of several lengths"
    if not np.isfinite(x).all():
        return None, "signal holds null, NaN or infinite values"
    if x.shape[1] == 0:
        return None, "no samples"
    x = signals.resample(x, fs, spec.fs)[:, : spec.samples]
    return np.pad(x, ((0, 0), (0, spec.samples - x.shape[1]))), None


def _embedded(model: Model, batch: np.ndarray) -> list[tuple[np.ndarray | None, str | None]]:
    """Embeddings of a batch; where the model fails on it, one by one, so that a bad recording fails alone."""
    try:
        out = np.asarray(model.embed(batch), float)
        if out.shape != (len(batch), model.dim):
            raise ValueError(f"the model gave shape {out.shape}")
    except Exception as e:  # noqa: BLE001 - whatever a model raises is a recording's error
        if len(batch) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        return [r for k in range(len(batch)) for r in _embedded(model, batch[k : k + 1])]
    return [(v, None) if np.isfinite(v).all() else (None, "the embedding isn't finite") for v in out]


def embed(df: DataFrame, make: Callable[[], Model], spec: Spec, fs: int, keep: Sequence[str], signal: str = "signal", names: str = "leads", batch_size: int = BATCH) -> DataFrame:
    """(keep, embedding, is_valid, error): make() runs once per worker process, also over several calls; the model gets batch_size
    recordings at once. A process keeps one model, the one it used last."""
    ship(df.sparkSession)
    ordered = df.select(*keep, signals.reorder(F.col(signal), F.col(names), spec.leads).alias("_ordered"), signals.lead_error(F.col(signal), F.col(names), spec.leads).alias("_lead_error"))
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("is_valid", T.BooleanType()), T.StructField("error", T.StringType())])
    key = hashlib.sha256(cloudpickle.dumps((make, spec))).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held_model(key, make)
        for whole in batches:
            for at in range(0, whole.num_rows, batch_size):
                batch = whole.slice(at, batch_size)
                made = [_prepared(x, spec, fs) for x in signals._recordings(batch.column("_ordered"))]
                errors = [lead or e for lead, (_, e) in zip(batch.column("_lead_error").to_pylist(), made, strict=True)]
                fit = [k for k, e in enumerate(errors) if e is None]
                vectors: list[np.ndarray | None] = [None] * len(made)
                for k, (v, e) in zip(fit, _embedded(model, np.stack([made[k][0] for k in fit])) if fit else [], strict=True):
                    norm = np.linalg.norm(v) if v is not None and spec.normalize else 1.0
                    vectors[k], errors[k] = None if v is None else v / max(norm, 1e-12), e
                columns = [*(batch.column(c) for c in keep), pa.array(vectors, pa.list_(pa.float64())), pa.array([e is None for e in errors]), pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "embedding", "is_valid", "error"])

    return ordered.mapInArrow(run, schema)


def embed_resumable(df: DataFrame, make: Callable[[], Model], spec: Spec, fs: int, key: str, path: str, chunks: int = 8, batch_size: int = BATCH, signal: str = "signal", names: str = "leads") -> DataFrame:
    """embed() written under `path` in `chunks` parts dealt by a hash of the key; a second call writes only missing parts.

    The folder's name holds a fingerprint of the model, the rates, the keys and the signals, so other input or another model starts anew.
    df is read once for the fingerprint and once more to deal the rows of all missing parts into a table beside the folder; each part
    then reads its own rows there. That table stays until no part is missing, so a call after a stop doesn't read df for it again.
    """
    spark = df.sparkSession
    n, mixed = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(key, signal, names))).first()
    base = f"{path.rstrip('/')}/{fingerprint(spec, fs, rows=n, keys=mixed, chunks=chunks)[:16]}"
    dealt = f"{base}-input"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(base).getFileSystem(spark._jsc.hadoopConfiguration())
    done = lambda folder: files.exists(hadoop(f"{folder}/_SUCCESS"))
    missing = [part for part in range(chunks) if not done(f"{base}/part={part}")]
    if missing and not done(dealt):
        rows = df.select(key, signal, names).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(chunks)))
        rows.where(F.col("_part").isin(missing)).write.mode("overwrite").partitionBy("_part").parquet(dealt)
    for part in missing:
        mine = f"{dealt}/_part={part}"
        read = spark.read.schema(df.select(key, signal, names).schema)
        rows = read.parquet(mine) if files.exists(hadoop(mine)) else df.select(key, signal, names).where("false")
        embed(rows, make, spec, fs, [key], signal, names, batch_size).write.mode("overwrite").parquet(f"{base}/part={part}")
    if missing:
        files.delete(hadoop(dealt), True)
    return spark.read.parquet(base).drop("part")
