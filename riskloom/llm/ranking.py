"""The first rows of every group by distributed radix selection.

A group's threshold is found digit by digit: a histogram over the next bits of the value, counted by partial aggregates,
tells in which bucket the k-th row lies. Rounds go on until the bucket holds at most SETTLED rows; values that tie are told
apart by the bytes of a string, in the same way. Then only rows above the bucket (fewer than k) and the bucket's own are
sorted, so no task holds a group, and the number of rounds doesn't depend on the number of rows.

Defined results: an empty table gives no rows; null groups are groups of their own; rows that tie in all values and the
string are ranked in any order. Values are longs of at least 0, the string isn't null.
"""

from __future__ import annotations

import os
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import materialize, ship

#: A bucket with at most so many rows is sorted instead of cut further.
SETTLED = 4096
#: Bits of a value, and bytes of a string, that a round resolves.
BITS, BYTES = 16, 2


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a with the row of b that has the same keys, nulls equal."""
    other = b.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(c for c in b.columns if c not in keys))
    met = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys))
    return a.join(other, met, how).drop(*(f"_k_{k}" for k in keys))


@F.udf(T.BinaryType())
def _common_start(a, b):
    return bytes(os.path.commonprefix([bytes(a), bytes(b)]))


def _found(hist: DataFrame, keys: list[str], digit: Column) -> DataFrame:
    """Of each group the histogram's row in which the running count reaches _need, with _before, the count ahead of it."""
    upto = Window.partitionBy(*keys).orderBy(digit).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = hist.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_before", F.col("_upto") - F.col("_n"))
    return counted.where("_upto >= _need AND _before < _need")


def top_per_group(df: DataFrame, groups: list[str], values: list[str], tie: str, k: int, rank_col: str = "rank", settled: int = SETTLED) -> DataFrame:
    """The k first rows of each group by `values` descending, then `tie` ascending by UTF-8 bytes, with rank_col (int, from 1).
    df is read several times, so it should be a table."""
    ship(df.sparkSession)
    state = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > max(k, settled)).select(*groups, F.lit(k).cast("long").alias("_need"))
    state = materialize(state, "open")
    done: list[DataFrame] = []  # groups whose bucket is small enough, with the floors of their values
    floors: list[str] = []
    for i, v in enumerate(values):
        if state.isEmpty():
            break
        floor = f"_floor{i}"
        of_bucket = F.lit(True)
        for name, had in zip(values, floors, strict=False):
            of_bucket &= F.col(name) == F.col(had)
        width = _same(df, state, groups).where(of_bucket).groupBy(*groups).agg(F.length(F.bin(F.max(v))).alias("_left"))
        now = _same(state, width, groups).withColumn(floor, F.lit(0).cast("long"))
        for _ in range(-(-63 // BITS)):
            now = materialize(now, "open")
            if now.where("_left > 0").isEmpty():
                break
            step, left = "least(_left, %d)" % BITS, f"_left - least(_left, {BITS})"
            met = _same(df, now.where("_left > 0"), groups).where(of_bucket).where(F.expr(f"shiftright({v}, _left) = {floor}"))
            hist = met.groupBy(*groups, *floors, floor, "_need", "_left", F.expr(f"shiftright({v}, {left}) & (shiftleft(1L, {step}) - 1)").alias("_digit")).agg(F.count(F.lit(1)).alias("_n"))
            found = materialize(_found(hist, groups, F.col("_digit").desc()), "digit")
            cut = found.select(*groups, (F.col("_need") - F.col("_before")).alias("_need"), *floors, F.expr(f"shiftleft({floor}, {step}) + _digit").alias(floor), F.expr(left).alias("_left"), "_n")
            small = cut.where(F.col("_n") <= settled)
            done.append(small.select(*groups, *floors, F.expr(f"shiftleft({floor}, _left)").alias(floor)))
            exact = now.where("_left = 0")
            now = cut.where(F.col("_n") > settled).select(exact.columns).unionByName(exact)
        floors.append(floor)
        state = materialize(now.select(*groups, "_need", *floors), "open")
    # ties in all values: the bytes of the string
    stem = state.withColumn("_stem", F.lit(b""))
    text = F.col(tie).cast("binary")
    while not state.isEmpty():
        of_bucket = F.lit(True)
        for name, had in zip(values, floors, strict=True):
            of_bucket &= F.col(name) == F.col(had)
        inside = lambda s: _same(df, s, groups).where(of_bucket & (F.substring(text, 1, F.length("_stem")) == F.col("_stem")))
        ends = inside(stem).groupBy(*groups).agg(F.min(text).alias("_a"), F.max(text).alias("_b"))
        stem = materialize(_same(stem.drop("_stem"), ends, groups).select(*groups, "_need", *floors, _common_start("_a", "_b").alias("_stem")), "open")
        hist = inside(stem).groupBy(*groups, *floors, "_need", "_stem", F.substring(text, F.length("_stem") + 1, F.lit(BYTES)).alias("_digit")).agg(F.count(F.lit(1)).alias("_n"))
        found = materialize(_found(hist, groups, F.col("_digit").asc()), "digit")
        cut = found.select(*groups, (F.col("_need") - F.col("_before")).alias("_need"), *floors, F.concat("_stem", "_digit").alias("_stem"), ((F.col("_n") <= settled) | (F.length("_digit") < BYTES)).alias("_settled"))
        done.append(cut.where("_settled").select(*groups, *floors, "_stem"))
        stem = materialize(cut.where("NOT _settled").drop("_settled"), "open")
        state = stem
    ranked = df
    chosen = F.lit(True)
    if done:
        cuts = done[0]
        for other in done[1:]:
            cuts = cuts.unionByName(other, allowMissingColumns=True)
        for c in (*(f"_floor{i}" for i in range(len(values))), "_stem"):
            if c not in cuts.columns:
                cuts = cuts.withColumn(c, F.lit(None).cast("binary" if c == "_stem" else "long"))
        cuts = materialize(cuts, "cuts")
        chosen = F.col("_stem").isNull() | (F.substring(text, 1, F.length("_stem")) <= F.col("_stem"))
        for i, v in reversed(list(enumerate(values))):
            f = F.col(f"_floor{i}")
            chosen = f.isNull() | (F.col(v) > f) | ((F.col(v) == f) & chosen)
            if i + 1 < len(values):
                chosen = chosen | ((F.col(v) >= f) & F.col(f"_floor{i + 1}").isNull())
            else:
                chosen = chosen | ((F.col(v) >= f) & F.col("_stem").isNull())
        ranked = _same(df, cuts, groups, "left").where(chosen)
    order = Window.partitionBy(*groups).orderBy(*(F.col(v).desc() for v in values), F.col(tie).asc())
    return ranked.select(*df.columns, F.row_number().over(order).alias(rank_col)).where(F.col(rank_col) <= k)
