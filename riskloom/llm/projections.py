"""Near-duplicate vectors by collision counting over one-dimensional projections.

Within a label, equal vectors are one class. Unit vectors are projected onto M random directions and
sorted along each. Around each vector a window of half-width WINDOW is cut out of every sorted projection by binary
search, and the collisions of each pair that a window emits are counted. A pair is verified by exact cosine when it
collides in at least `least_count` of the M projections, the largest count that keeps RECALL of pairs at the threshold.
The first projection also deals the work: vectors are ranged along it into slabs of SLAB's width, so near pairs lie in
the same or neighbouring slabs, and crowded slabs are cut into blocks, so that every task sorts and searches two
blocks of a bounded size. Tasks return link counts and a spanning forest of their links, never all pairs.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows without a label,
link with nothing; only vectors of the same length are compared; rows that repeat an id count as one
vector each and share a component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import kept_fields, map_slices, row_spread
from riskloom.llm.components import connected_components
from riskloom.llm.topk import usable
from riskloom.session import materialize, ship

M, RECALL = 32, 0.9995
#: Half-width of a window and width of a slab, in standard deviations of a projected difference at the threshold.
WINDOW, SLAB = 1.0, 3.8
#: Vectors of a block; pairs whose cosine is computed at once; the smallest distance that windows are made for.
BLOCK, VERIFIED, LEAST_DISTANCE = 2048, 20_000, 1e-3


def directions(d: int) -> np.ndarray:
    return np.random.default_rng(977).standard_normal((d, M)).astype(np.float64)


def least_count(threshold: float) -> tuple[float, int]:
    """Distance at the threshold, and the collision count that keeps RECALL of such pairs."""
    p = erf(WINDOW / sqrt(2))
    tail, count = 0.0, M
    while count > 0:
        tail += comb(M, count) * p**count * (1 - p) ** (M - count)
        if tail >= RECALL:
            break
        count -= 1
    return max(LEAST_DISTANCE, sqrt(max(0.0, 2 - 2 * threshold))), count


def collisions(left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, places in right) of the pairs with enough collisions; left, right: projections, a row per vector."""
    distance, least = least_count(threshold)
    half = WINDOW * distance
    order = np.argsort(right, axis=0, kind="stable")
    held = np.take_along_axis(right, order, 0)
    low, high = np.zeros(left.shape, np.int64), np.zeros(left.shape, np.int64)
    for m in range(M):
        low[:, m] = np.searchsorted(held[:, m], left[:, m] - half, "left")
        high[:, m] = np.searchsorted(held[:, m], left[:, m] + half, "right")
    columns = np.ascontiguousarray(order.T)
    for i, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        emitted = np.concatenate([column[x:y] for column, x, y in zip(columns, a, b, strict=True)])
        if len(emitted) >= least:
            yield i, np.flatnonzero(np.bincount(emitted, minlength=len(right)) >= least)


def links_between(left: dict, right: dict | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i in left, j in right) of the linked pairs; with right None, those within left, i < j."""
    other = left if right is None else right
    out: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def verify() -> None:
        i, j = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
        for at in range(0, len(i), VERIFIED):
            a, b = i[at : at + VERIFIED], j[at : at + VERIFIED]
            x, y = left["v"][a], other["v"][b]
            cosine = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
            out.append((a[cosine >= threshold], b[cosine >= threshold]))
        held.clear()

    for i, j in collisions(left["p"], other["p"], threshold):
        if right is None:
            j = j[j > i]
        if len(j):
            held.append((np.full(len(j), i), j))
            size += len(j)
            if size >= VERIFIED:
                verify()
                size = 0
    if held:
        verify()
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what all the edges (a, b) connect; edges of equal a stand together."""
    if not len(a):
        return []
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    part = np.arange(len(nodes))
    one, two = places[: len(a)], places[len(a) :]
    starts = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
    out = []
    for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(one)], strict=True):
        found, at = np.unique(part[two[x:y]], return_index=True)
        new = found != part[one[x]]
        if new.any():
            out += [(int(a[x]), int(b[x + k])) for k in at[new].tolist()]
            part[np.isin(part, found[new])] = part[one[x]]
    return out


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, keep: list[str] | None = None) -> DataFrame:
    """df with n_links long, component_id (smallest key reachable by links) and kept boolean (key = component_id)."""
    spark = df.sparkSession
    ship(spark)
    source = df.withColumn(key, F.col(key).cast("long"))
    good = usable(F.col(vector)) & F.exists(vector, lambda x: x != 0) & F.col(label).isNotNull() & F.col(key).isNotNull()
    values = F.transform(vector, lambda x: x.cast("double"))
    rows = materialize(source.select(F.col(key).alias("id"), F.when(good, F.md5(F.to_json(F.struct(F.col(label).alias("l"), values.alias("v"))))).alias("class"), F.when(good, F.col(label)).alias("l"), F.when(good, values).alias("v")), "vectors")
    classes = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("l").alias("l"), F.first("v").alias("v"))
    width = SLAB * least_count(threshold)[0]
    schema = T.StructType([T.StructField("class", T.StringType()), T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), df.select(F.col(label).alias("l")).schema["l"], T.StructField("d", T.IntegerType()), T.StructField("slab", T.IntegerType()), T.StructField("v", T.BinaryType()), T.StructField("p", T.BinaryType())])

    def project(batch: pa.RecordBatch) -> pa.RecordBatch:
        d, slab, vs, ps = [], [], [], []
        made: dict[int, np.ndarray] = {}
        for x in batch.column("v"):
            x = np.array(x.as_py(), np.float64)
            if len(x) not in made:
                made[len(x)] = directions(len(x))
            scaled = x / np.abs(x).max()
            p = ((scaled / np.sqrt((scaled**2).sum())) @ made[len(x)]).astype("<f4")
            d.append(len(x))
            slab.append(int(np.floor(p[0] / width)))
            vs.append(scaled.astype("<f8").tobytes())
            ps.append(p.tobytes())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("class", "id", "n", "l")), pa.array(d, pa.int32()), pa.array(slab, pa.int32()), pa.array(vs, pa.binary()), pa.array(ps, pa.binary())], schema.fieldNames())

    projected = materialize(map_slices(classes, project, schema), "projected")
    sizes = projected.groupBy("l", "d", "slab").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sizes = materialize(sizes, "slabs")
    at = lambda shift, name: sizes.select("l", "d", (F.col("slab") + shift).alias("slab"), F.col("blocks").alias(name))
    on = ["l", "d", "slab"]
    dealt = projected.join(at(0, "here"), on).join(at(-1, "above"), on, "left").join(at(1, "below"), on, "left")
    dealt = dealt.withColumn("own", F.pmod(row_spread("id"), F.col("here")).cast("int"))
    upto = lambda name: F.sequence(F.lit(0), F.coalesce(F.col(name), F.lit(0)) - 1)
    some = lambda name, xs: F.when(F.col(name) > 0, xs).otherwise(F.array().cast("array<struct<slab:int,next:int,i:int,j:int,side:int>>"))
    task = lambda slab, nxt, i, j, side: F.struct(slab.cast("int").alias("slab"), F.lit(nxt).alias("next"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    own = F.col("own")
    same = F.transform(upto("here"), lambda j: task(F.col("slab"), 0, F.least(own, j), F.greatest(own, j), F.when(own <= j, 0).otherwise(1)))
    up = some("above", F.transform(upto("above"), lambda j: task(F.col("slab"), 1, own, j, F.lit(0))))
    down = some("below", F.transform(upto("below"), lambda i: task(F.col("slab") - 1, 1, i, own, F.lit(1))))
    dealt = dealt.select("l", "d", F.explode(F.concat(same, up, down)).alias("t"), "id", "n", "v", "p").select("l", "d", "t.*", "id", "n", "v", "p")

    def compare(table: pa.Table) -> pa.Table:
        d = table.column("d")[0].as_py()
        side = table.column("side").to_numpy()

        def part(k: int) -> dict:
            mask = side == k
            take = lambda c: b"".join(x for x, m in zip(table.column(c).to_pylist(), mask, strict=True) if m)
            return {"id": table.column("id").to_numpy()[mask], "n": table.column("n").to_numpy()[mask], "v": np.frombuffer(take("v"), "<f8").reshape(-1, d), "p": np.frombuffer(take("p"), "<f4").reshape(-1, M)}

        left = part(0)
        alone = table.column("next")[0].as_py() == 0 and table.column("i")[0].as_py() == table.column("j")[0].as_py()
        right = None if alone else part(1)
        other = left if alone else right
        i, j = links_between(left, right, threshold) if len(left["id"]) and len(other["id"]) else (np.zeros(0, np.int64),) * 2
        edges = forest(left["id"][i], other["id"][j])
        ids = np.concatenate([left["id"][i], other["id"][j]])
        seen, inverse = np.unique(ids, return_inverse=True)
        count = np.bincount(inverse, np.concatenate([other["n"][j], left["n"][i]]), len(seen)).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        a = [*seen.tolist(), *(x for x, _ in edges)]
        b = [*([None] * len(seen)), *(y for _, y in edges)]
        n = [*count.tolist(), *([None] * len(edges))]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    found = materialize(dealt.groupBy("l", "d", "slab", "next", "i", "j").applyInArrow(compare, "a long, b long, n long"), "links")
    labels = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    named = projected.select("class", "id", "n").join(counts, "id", "left").join(labels, "id", "left")
    named = materialize(named.select("class", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "classes")
    result = rows.select("id", "class").join(named, "class", "left").select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    passed = kept_fields(df, keep, ["n_links", "component_id", "kept"])
    if passed != [key]:
        one = result.groupBy(key).agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
        result = source.select(*passed).join(one, key, "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
    return result.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True))).select(*passed, "n_links", "component_id", "kept")
