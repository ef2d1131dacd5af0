"""Exact top-k by inner product over an impact-ordered index.

Candidates are spread over blocks. A block's index holds, for each distinct (dimension, quantised
value), a posting segment of the rows with that value, segments ordered by descending
absolute value. A batch of queries runs through a block score-at-a-time: each segment adds value * query weight
to its rows' accumulators. Between impact levels a row's score is bounded by its accumulator
plus the product of the query's norm and the norm of the row's unprocessed values; once few
enough rows can still reach the k-th best score so far (proof by bound), processing stops and those
are rescored exactly. Otherwise all segments are processed and the accumulators are exact.

All queries first search one block, so that in every other block they start with a k-th best score. Then squares of
RUN blocks by GROUP batches of queries are searched, each in one task: neither side is sent more often than the
other side has runs or groups.

Defined results: vectors that are null, empty, or hold null or non-finite components, and rows without an id, take no
part; only vectors of the same length are compared; rows are told apart by more than their id, so a row that repeats
an id is a query and a candidate of its own, and a query is compared with every row but itself;
ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import materialize, ship

#: Candidates per index block, queries per batch; blocks and batches of a task.
BLOCK, BATCH, RUN, GROUP = 1024, 256, 8, 32
#: Processing may stop when at most this share of a block's (row, query) pairs can still be members.
SURVIVORS = 0.03


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def build_index(values: np.ndarray) -> dict[str, np.ndarray]:
    """Posting segments of n x d integers by descending absolute value."""
    n, d = values.shape
    flat = values.ravel()
    dim = np.tile(np.arange(d), n)
    row = np.repeat(np.arange(n), d)
    by = np.lexsort((row, flat, dim, -np.abs(flat)))
    by = by[flat[by] != 0]
    v, k = flat[by], dim[by]
    start = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (k[1:] != k[:-1]))) if len(by) else np.zeros(0, np.int64)
    return {"impact": v[start], "dim": k[start], "start": np.append(start, len(by)).astype(np.int64), "rows": row[by].astype(np.int32)}


def merge_top(top: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query of (query place, score, id, row), by descending score, then id, then row."""
    q, s, i, r = top
    by = np.lexsort((r, i, -s, q))
    q, s, i, r = q[by], s[by], i[by], r[by]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    keep = rank < k
    return q[keep], s[keep], i[keep], r[keep]


def search_block(index: dict[str, np.ndarray], values: np.ndarray, rows_of: np.ndarray, weights: np.ndarray, query_rows: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, score, place in the block) of all rows that may be among a query's k best; rows_of, query_rows: their
    numbers; floor: a query's k-th best score so far."""
    n, m = len(values), len(weights)
    other = rows_of[:, None] != query_rows[None, :]
    acc = np.zeros((n, m), np.int64 if np.abs(values).max(initial=0).astype(float) * np.abs(weights).max(initial=0) * values.shape[1] > 2**30 else np.int32)
    by_dim = np.ascontiguousarray(weights.T).astype(acc.dtype)
    norm = np.sqrt((weights.astype(float) ** 2).sum(1))
    size = np.abs(values)
    square = values.astype(float) ** 2
    impact, dim, start, rows = (index[x] for x in ("impact", "dim", "start", "rows"))
    level = np.abs(impact)
    ends = np.flatnonzero(np.append(level[1:] != level[:-1], True)) if len(level) else np.zeros(0, np.int64)  # last segment of each level
    done, checked = 0, 0.35
    for end in ends.tolist():
        for s in range(done, end + 1):
            acc[rows[start[s] : start[s + 1]]] += impact[s] * by_dim[dim[s]]
        done = end + 1
        if done < len(level) and start[done] >= checked * len(rows):
            checked += 0.1
            rest = np.sqrt(np.where(size < level[end], square, 0).sum(1))
            room = rest[:, None] * norm[None, :] * (1 + 1e-9) + 1e-6
            lower = np.where(other, acc - room, -np.inf)
            if n > k:
                floor = np.maximum(floor, -np.partition(-lower, k - 1, axis=0)[k - 1])
            may = (acc + room >= floor[None, :]) & other
            if may.sum() <= SURVIVORS * n * m:
                row, query = np.nonzero(may)
                return query, np.einsum("ij,ij->i", values[row].astype(np.int64), weights[query].astype(np.int64)), row
    if n > k:
        exact = np.where(other, acc, np.iinfo(acc.dtype).min)
        floor = np.maximum(floor, -np.partition(-exact.astype(float), k - 1, axis=0)[k - 1])
    row, query = np.nonzero((acc >= floor[None, :]) & other)
    return query, acc[row, query].astype(np.int64), row


def _blob(frame: pa.Table, **arrays: np.ndarray) -> pa.Table:
    """One row: length and part of the frame, and each array as bytes."""
    head = {"d": frame.column("d").slice(0, 1).combine_chunks(), "part": frame.column("part").slice(0, 1).combine_chunks()}
    return pa.table(head | {n: pa.array([x.tobytes()], pa.binary()) for n, x in arrays.items()})


def _values(frame: pa.Table) -> np.ndarray:
    return frame.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(frame.num_rows, -1).astype("<i8")


def top_k(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0, k: int = 20) -> DataFrame:
    """(query_id, rank int, vec_id, score long): each query row's k best other rows by the inner product of floor(scale * x)."""
    ship(df.sparkSession)
    rows = df.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = materialize(rows.withColumn("d", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "quantised")
    total, asked = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("q").cast("long")), F.lit(0))).first()
    blocks, batches = max(1, -(-total // BLOCK)), max(1, -(-asked // BATCH))

    def index(frame: pa.Table) -> pa.Table:
        values = _values(frame)
        made = build_index(values)
        return _blob(frame, ids=frame.column("id").to_numpy().astype("<i8"), rows_of=frame.column("row").to_numpy().astype("<i8"), values=values, impact=made["impact"].astype("<i8"), dim=made["dim"].astype("<i4"), start=made["start"].astype("<i8"), rows=made["rows"].astype("<i4"))

    def batch_of(frame: pa.Table) -> pa.Table:
        return _blob(frame, query_ids=frame.column("id").to_numpy().astype("<i8"), query_rows=frame.column("row").to_numpy().astype("<i8"), weights=_values(frame), floor=frame.column("floor").to_numpy().astype("<f8"))

    def dealt(frame: DataFrame, n: int) -> DataFrame:
        return frame.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")).groupBy("d", "part")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        """All batches of the right side through all blocks of the left side."""
        out = []
        read = lambda row, name, kind: np.frombuffer(row[name], kind)
        parts = left.to_pylist() if right.num_rows else []
        for asking in right.to_pylist() if parts else []:
            query_ids, query_rows, floor = read(asking, "query_ids", "<i8"), read(asking, "query_rows", "<i8"), read(asking, "floor", "<f8").copy()
            weights = read(asking, "weights", "<i8").reshape(len(query_ids), -1)
            top = tuple(np.zeros(0, np.int64) for _ in range(4))
            for part in parts:
                values, ids, numbers = read(part, "values", "<i8").reshape(-1, weights.shape[1]), read(part, "ids", "<i8"), read(part, "rows_of", "<i8")
                q, s, place = search_block({n: read(part, n, t) for n, t in (("impact", "<i8"), ("dim", "<i4"), ("start", "<i8"), ("rows", "<i4"))}, values, numbers, weights, query_rows, floor, k)
                top = merge_top(tuple(np.concatenate([a, b]) for a, b in zip(top, (q, s, ids[place], numbers[place]), strict=True)), k)
                full = np.bincount(top[0], minlength=len(query_ids)) >= k
                worst = np.full(len(query_ids), np.inf)
                np.minimum.at(worst, top[0], top[1])
                floor[full] = np.maximum(floor[full], worst[full])
            out.append(pa.table({"query_row": query_rows[top[0]], "query_id": query_ids[top[0]], "vec_id": top[2], "row": top[3], "score": top[1]}))
        return pa.concat_tables(out) if out else schema.empty_table()

    schema = pa.schema([(n, pa.int64()) for n in ("query_row", "query_id", "vec_id", "row", "score")])
    found_schema = "query_row long, query_id long, vec_id long, row long, score long"
    indexed = dealt(rows, blocks).applyInArrow(index, "d int, part int, ids binary, rows_of binary, values binary, impact binary, dim binary, start binary, rows binary")
    indexed = materialize(indexed, "index")
    asking = rows.where("q").withColumn("floor", F.lit(float("-inf")))
    batch_schema = "d int, part int, query_ids binary, query_rows binary, weights binary, floor binary"

    # a k-th best score of each query, from the first block of vectors of its length
    lead = indexed.join(indexed.groupBy("d").agg(F.min("part").alias("part")), ["d", "part"])
    groups = max(1, -(-batches // GROUP))
    one = dealt(asking, batches).applyInArrow(batch_of, batch_schema).withColumn("group", F.pmod("part", F.lit(groups)))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    seeds = lead.select("*", every(groups, "group")).groupBy("d", "group").cogroup(one.groupBy("d", "group")).applyInArrow(search, found_schema)
    floors = materialize(seeds.groupBy(F.col("query_row").alias("row")).agg(F.min("score").cast("double").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k), "floors")

    asking = asking.drop("floor").join(floors, "row", "left").select("d", "row", "id", "v", F.coalesce("least", F.lit(float("-inf"))).alias("floor"))
    runs = max(1, -(-blocks // RUN))
    two = dealt(asking, batches).applyInArrow(batch_of, batch_schema).withColumn("group", F.pmod("part", F.lit(groups)))
    left = indexed.withColumn("run", F.pmod("part", F.lit(runs))).select("*", every(groups, "group")).groupBy("d", "run", "group")
    right = two.select("*", every(runs, "run")).groupBy("d", "run", "group")
    found = left.cogroup(right).applyInArrow(search, found_schema)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
