"""Bootstrap replicates as vectors: a task draws the counts of its rows in all replicates at once.

A row's count in a replicate is Poisson(1), drawn from the row's hash and the replicate's number, so a lost task draws the
same again and two scores of a row share their replicates. Rows are shuffled once each, whatever the number of
replicates; what leaves a task are sums over its rows, one per replicate.

* `weighted_sums`: sums of count * term, for means of any kind. Tasks add up before anything is shuffled.
* `ranked_sums`: AUROC and average precision. Rows go to ranges of scores; a task scans a range downwards, holding
  one vector of running positives and one of negatives. The sums of the ranges above enter AUROC afterwards and average
  precision in a second scan, which a table with one range doesn't need. Scores that many rows share are added up by replicate
  before the shuffle, so such a score is no task's burden.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import materialize, ship

#: Rows whose counts are drawn at once, and groups whose sums a task holds.
ROWS, HELD = 512, 64
#: Rows of a range of scores, about, and the most ranges.
RANGE_ROWS, MOST_RANGES = 200_000, 1024
#: The primes of the 64-bit xxHash.
PRIME1, PRIME2, PRIME3, PRIME5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5
_TAILS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])


def hash_int(value: np.ndarray | int, seed: np.ndarray) -> np.ndarray:
    """The xxHash of a 32-bit number on top of hashes, as the SQL function xxhash64 chains its arguments."""
    with np.errstate(over="ignore"):
        value = np.asarray(value, np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF)
        h = (seed + np.uint64(PRIME5) + np.uint64(4)) ^ (value * np.uint64(PRIME1))
        h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * np.uint64(PRIME2) + np.uint64(PRIME3)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(PRIME2)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(PRIME3)
        return h ^ (h >> np.uint64(32))


def counts(hashes: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Rows x replicates: how often a row occurs. hashes: xxhash64 of the rows' keys, as longs."""
    h = hash_int(seed, hash_int(np.arange(replicates), hashes.astype(np.int64).view(np.uint64)[:, None]))
    u = (h & np.uint64((1 << 52) - 1)).astype(np.float64) / float(1 << 52)
    out = np.zeros(u.shape)
    for tail in _TAILS:
        out += u >= tail
    return out


def _keys(batch: pa.RecordBatch, names: list[str]) -> list[tuple]:
    return list(zip(*(batch.column(c).to_pylist() for c in names), strict=True)) if names else [()] * batch.num_rows


def _types(df: DataFrame, names: list[str]) -> list[T.StructField]:
    return [T.StructField(f"_g{k}", df.schema[c].dataType) for k, c in enumerate(names)]


def _columns(keys: list[tuple], width: int, each: int, kinds: list[pa.DataType]) -> list[pa.Array]:
    """The group columns of `each` rows per key."""
    at = pa.array(np.repeat(np.arange(len(keys)), each))
    return [pa.array([k[i] for k in keys], kinds[i]).take(at) for i in range(width)]


def weighted_sums(df: DataFrame, groups: list[str], terms: list[Column], key: str, replicates: int, seed: int) -> DataFrame:
    """(groups, replicate, s0, s1, ...): sums of count * term per replicate; a null term counts 0."""
    ship(df.sparkSession)
    names, width = [f"_g{k}" for k in range(len(groups))], len(terms)
    fields = _types(df, groups)
    d = df.select(*(F.col(g).alias(n) for g, n in zip(groups, names, strict=True)), F.xxhash64(key).alias("_h"), *(F.coalesce(t.cast("double"), F.lit(0.0)).alias(f"_t{k}") for k, t in enumerate(terms)))
    schema = T.StructType([*fields, T.StructField("replicate", T.IntegerType()), *(T.StructField(f"s{k}", T.DoubleType()) for k in range(width))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds: list[pa.DataType] = []

        def send() -> pa.RecordBatch:
            flat = np.concatenate(list(held.values()))
            columns = _columns(list(held), len(names), replicates, kinds)
            out = pa.RecordBatch.from_arrays([*columns, pa.array(np.tile(np.arange(replicates, dtype=np.int32), len(held))), *(pa.array(flat[:, k]) for k in range(width))], schema.names)
            held.clear()
            return out

        for batch in batches:
            kinds = [batch.schema.field(n).type for n in names]
            hashes = batch.column("_h").to_numpy()
            values = np.stack([batch.column(f"_t{k}").to_numpy() for k in range(width)], 1)
            where: dict[tuple, list[int]] = {}
            for i, g in enumerate(_keys(batch, names)):
                where.setdefault(g, []).append(i)
            for g, rows in where.items():
                for at in range(0, len(rows), ROWS):
                    part = rows[at : at + ROWS]
                    held[g] = held.get(g, 0) + counts(hashes[part], replicates, seed).T @ values[part]
                if len(held) >= HELD:
                    yield send()
        if held:
            yield send()

    summed = d.mapInArrow(run, schema).groupBy(*names, "replicate").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(width)))
    return summed.select(*(F.col(n).alias(g) for g, n in zip(groups, names, strict=True)), "replicate", *(f"s{k}" for k in range(width)))


def range_cuts(df: DataFrame, score: str, rows: int = RANGE_ROWS) -> list[float]:
    """Ends of ranges of about `rows` rows; none for a small table."""
    n = df.count()
    ranges = min(MOST_RANGES, -(-n // rows))
    if ranges < 2:
        return []
    at = ", ".join(f"{k / ranges!r}D" for k in range(1, ranges))
    return sorted(set(df.agg(F.expr(f"percentile_approx({score}, array({at}), {20 * ranges})")).first()[0] or []))


def ranked_sums(df: DataFrame, groups: list[str], y: str, score: str, key: str, replicates: int, seed: int, rows: int = RANGE_ROWS, precision: bool = True) -> DataFrame:
    """(groups, replicate, positives, negatives, pairs, precision): pairs counts negatives below positives, ties half; precision is
    the sum of positives * precision over distinct scores (null unless asked for)."""
    ship(df.sparkSession)
    names = [f"_g{k}" for k in range(len(groups))]
    d = df.select(*(F.col(g).alias(n) for g, n in zip(groups, names, strict=True)), F.col(y).cast("double").alias("_y"), F.col(score).cast("double").alias("_s"), F.xxhash64(key).alias("_h"))
    d = d.where("_y IS NOT NULL AND _s IS NOT NULL AND NOT isnan(_s)")
    cuts = range_cuts(d, "_s", rows)
    fields = _types(df, groups)
    if cuts:
        sent = compacted(d, names, fields, replicates, seed)
    else:
        sent = d.select(*names, "_s", F.lit(None).cast("int").alias("replicate"), "_h", F.col("_y").alias("_pos"), (1.0 - F.col("_y")).alias("_neg"))
    sent = sent.withColumn("_z", F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<double>"), lambda c: c <= F.col("_s"))))
    if cuts:
        sent = materialize(sent, "replicates")
    first = scanned(sent, names, fields, replicates, seed)
    if cuts:
        first = materialize(first, "ranges")
    above = Window.partitionBy(*names, "replicate").orderBy(F.desc("_z")).rowsBetween(Window.unboundedPreceding, -1)
    before = first.withColumns({f"_{c}": F.coalesce(F.sum(c).over(above), F.lit(0.0)) for c in ("p", "n")})
    exact = F.col("ap")
    if cuts and precision:
        offsets = before.select(*names, F.lit(None).cast("double").alias("_s"), "replicate", F.lit(None).cast("long").alias("_h"), F.col("_p").alias("_pos"), F.col("_n").alias("_neg"), "_z")
        second = scanned(sent.select(offsets.columns).unionByName(offsets), names, fields, replicates, seed)
        before = before.drop("ap").join(second.select(*(F.col(n).alias(f"_k{n}") for n in names), F.col("_z").alias("_kz"), F.col("replicate").alias("_kr"), "ap"), [(F.col(n).eqNullSafe(F.col(f"_k{n}"))) for n in names] + [F.col("_z") == F.col("_kz"), F.col("replicate") == F.col("_kr")])
    total = before.groupBy(*names, "replicate").agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum(F.col("w") + F.col("n") * F.col("_p")).alias("pairs"), F.sum(exact).alias("precision"))
    return total.select(*(F.col(n).alias(g) for g, n in zip(groups, names, strict=True)), "replicate", "positives", "negatives", "pairs", "precision")


def compacted(d: DataFrame, names: list[str], fields: list[T.StructField], replicates: int, seed: int) -> DataFrame:
    """(groups, _s, replicate, _h, _pos, _neg): rows as they are (replicate null), but of scores that more rows of an Arrow batch share
    than there are replicates the sums by replicate, which are then added up over all tasks."""
    schema = T.StructType([*fields, T.StructField("_s", T.DoubleType()), T.StructField("replicate", T.IntegerType()), T.StructField("_h", T.LongType()), T.StructField("_pos", T.DoubleType()), T.StructField("_neg", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, s, h = (batch.column(c).to_numpy() for c in ("_y", "_s", "_h"))
            keys: dict[tuple, int] = {}
            group = np.array([keys.setdefault(g, len(keys)) for g in _keys(batch, names)], np.int64)
            _, code, n = np.unique(np.stack([group.astype(float), s]), axis=1, return_inverse=True, return_counts=True)
            shared = n[code.ravel()] > replicates
            own = np.flatnonzero(~shared)
            groups_of = [batch.column(c) for c in names]
            blank = pa.nulls(len(own), pa.int32())
            yield pa.RecordBatch.from_arrays([*(g.take(pa.array(own)) for g in groups_of), pa.array(s[own]), blank, pa.array(h[own]), pa.array(y[own]), pa.array(1.0 - y[own])], schema.names)
            for c in np.flatnonzero(n > replicates):
                rows = np.flatnonzero(code.ravel() == c)
                sums = np.zeros((2, replicates))
                for at in range(0, len(rows), ROWS):
                    part = rows[at : at + ROWS]
                    sums += np.stack([y[part], 1.0 - y[part]]) @ counts(h[part], replicates, seed)
                at = pa.array(np.repeat(rows[:1], replicates))
                yield pa.RecordBatch.from_arrays([*(g.take(at) for g in groups_of), pa.array(np.repeat(s[rows[:1]], replicates)), pa.array(np.arange(replicates, dtype=np.int32)), pa.nulls(replicates, pa.int64()), pa.array(sums[0]), pa.array(sums[1])], schema.names)

    out = materialize(d.mapInArrow(run, schema), "replicates")
    shared = out.where("replicate IS NOT NULL").groupBy(*names, "_s", "replicate").agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    return out.where("replicate IS NULL").unionByName(shared, allowMissingColumns=True)


def scanned(rows: DataFrame, names: list[str], fields: list[T.StructField], replicates: int, seed: int) -> DataFrame:
    """(groups, _z, replicate, p, n, w, ap) of every group and range: positives, negatives, pairs within the range and the sum of
    positives * precision. Rows without a score hold the sums of the ranges above."""
    schema = T.StructType([*fields, T.StructField("_z", T.IntegerType()), T.StructField("replicate", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in ("p", "n", "w", "ap"))])
    by = [*names, "_z"]

    class Scan:
        """One group's range, highest score first."""

        def __init__(self):
            self.above, self.total = np.zeros((2, replicates)), np.zeros((2, replicates))
            self.open, self.score = np.zeros((2, replicates)), None
            self.w, self.ap = np.zeros(replicates), np.zeros(replicates)

        def close(self, steps: np.ndarray) -> None:
            """steps: 2 x distinct scores x replicates."""
            running = self.total[:, None] + np.cumsum(steps, 1)
            self.w += (steps[1] * (running[0] - steps[0] / 2)).sum(0)
            whole = running + self.above[:, None]
            both = whole.sum(0)
            self.ap += np.divide(steps[0] * whole[0], both, out=np.zeros_like(both), where=both > 0).sum(0)
            self.total = running[:, -1]

        def add(self, s: np.ndarray, replicate: np.ndarray, h: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
            offsets = np.isnan(s)
            if offsets.any():
                at = replicate[offsets].astype(np.int64)
                self.above[0, at], self.above[1, at] = pos[offsets], neg[offsets]
            for first in range(int(offsets.sum()), len(s), ROWS):
                part = slice(first, first + ROWS)
                new = np.concatenate([[self.score is None or s[first] != self.score], s[part][1:] != s[part][:-1]])
                place = np.cumsum(new) - (1 if new[0] else 0)
                steps = np.zeros((2, place[-1] + 1, replicates))
                if not new[0]:
                    steps[:, 0] = self.open
                elif self.score is not None:
                    self.close(self.open[:, None])
                raw = np.isnan(replicate[part])
                drawn = counts(h[part][raw], replicates, seed)
                at, starts = np.unique(place[raw], return_index=True)
                for k, weight in enumerate((pos[part], neg[part])):
                    if len(at):
                        steps[k][at] += np.add.reduceat(drawn * weight[raw][:, None], starts)
                    np.add.at(steps[k], (place[~raw], replicate[part][~raw].astype(np.int64)), weight[~raw])
                if len(steps[0]) > 1:
                    self.close(steps[:, :-1])
                self.open, self.score = steps[:, -1], s[part][-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, scan, kinds = None, None, []

        def send() -> pa.RecordBatch:
            scan.close(scan.open[:, None])
            numbers = [pa.array(np.full(replicates, held[-1], np.int32)), pa.array(np.arange(replicates, dtype=np.int32)), *(pa.array(x) for x in (*scan.total, scan.w, scan.ap))]
            return pa.RecordBatch.from_arrays([*_columns([held], len(names), replicates, kinds), *numbers], schema.names)

        for batch in batches:
            kinds = [batch.schema.field(n).type for n in names]
            keys = _keys(batch, by)
            s, r, pos, neg = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("_s", "replicate", "_pos", "_neg"))
            h = batch.column("_h").fill_null(0).to_numpy()
            at = 0
            while at < len(keys):
                end = next((i for i in range(at, len(keys)) if keys[i] != keys[at]), len(keys))
                if keys[at] != held:
                    if held is not None:
                        yield send()
                    held, scan = keys[at], Scan()
                scan.add(s[at:end], r[at:end], h[at:end], pos[at:end], neg[at:end])
                at = end
        if held is not None:
            yield send()

    ordered = rows.repartition(*by).sortWithinPartitions(*by, F.desc_nulls_first("_s"))
    return ordered.mapInArrow(run, schema)
