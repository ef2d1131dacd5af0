"""Exact quantiles of many columns and groups by refining histograms.

Quantiles interpolate between the two rows around share * (n - 1), as SQL's quantile_cont does. Groups of at most SETTLED rows are
one aggregate, whose buffer that number bounds. In larger groups every wanted rank starts with the range of the whole group;
a round counts the rows of each open range in BINS bins by a partial aggregate and keeps the bin that holds the rank, with
its smallest and largest value as the new range. A range is done when it holds one value, however many rows tie on it, or at most
SETTLED rows, which are then ranked. A round has a row per bin and range, so no task holds a group.

Nulls and NaN take no part; a group without a value has null quantiles; null group keys are a group of their own.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import materialize

SETTLED, BINS = 100_000, 4096


def _met(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a with b's row of the same keys, null equal to null."""
    other = b.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in b.columns if c not in keys))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), F.lit(True))
    return a.join(other, same, how).drop(*(f"_k{i}" for i in range(len(keys))))


def quantiles(df: DataFrame, groups: list[str], values: list[str], shares: list[float], settled: int = SETTLED, bins: int = BINS) -> DataFrame:
    """A row per group of df: its keys and, for each of `values`, the array `<value>_q` of its quantiles at `shares`."""
    names = [f"_g{k}" for k in range(len(groups))]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("_c"), F.col(v).cast("double").alias("_v")) for k, v in enumerate(values))))
    long = df.select(*(F.col(g).alias(n) for g, n in zip(groups, names, strict=True)), each.alias("_x")).select(*names, "_x.*").where("_v IS NOT NULL AND NOT isnan(_v)")
    keys = [*names, "_c"]
    sizes = materialize(long.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")), "sizes")
    large = sizes.where(F.col("_n") > settled)
    some = not large.isEmpty()
    at = F.array(*(F.lit(float(s)) for s in shares))
    rows = _met(long, large.select(*keys), keys, "left_anti") if some else long
    out = rows.groupBy(*keys).agg(F.percentile("_v", at).alias("_q"))
    if some:
        out = out.unionByName(_refined(long, large, keys, shares, settled, bins))
    wide = out.groupBy(*names).agg(*(F.max(F.when(F.col("_c") == k, F.col("_q"))).alias(f"{v}_q") for k, v in enumerate(values)))
    if not groups:
        return wide
    every = df.select(*(F.col(g).alias(n) for g, n in zip(groups, names, strict=True))).distinct()
    return _met(every, wide, names, "left").select(*(F.col(n).alias(g) for g, n in zip(groups, names, strict=True)), *(f"{v}_q" for v in values))


def _refined(long: DataFrame, large: DataFrame, keys: list[str], shares: list[float], settled: int, bins: int) -> DataFrame:
    """(keys, _q) of the groups in `large`: (keys, _n, _low, _high)."""
    last = F.col("_n") - 1
    ends = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(F.lit(s) * last), F.ceil(F.lit(s) * last)) for s in map(float, shares)))))
    open_ = large.select(*keys, "_low", "_high", F.col("_n").alias("_rows"), F.explode(ends).alias("_rank")).withColumn("_left", F.col("_rank"))
    bounds = [*keys, "_low", "_high"]
    done, short = [], []
    while True:
        open_ = materialize(open_, "ranges")
        done.append(open_.where("_low = _high").select(*keys, "_rank", F.col("_low").alias("_value")))
        short.append(open_.where((F.col("_low") < F.col("_high")) & (F.col("_rows") <= settled)))
        open_ = open_.where((F.col("_low") < F.col("_high")) & (F.col("_rows") > settled))
        if open_.isEmpty():
            break
        inside = _within(long, open_.select(*bounds).distinct(), keys)
        v, low, high = F.col("_v"), F.col("_low"), F.col("_high")
        # bins of equal ratio where a range spans magnitudes, else of equal width; so few rounds do, however values are spread
        share = F.when(_magnitude(high) - _magnitude(low) > 1, _share(_magnitude(v), _magnitude(low), _magnitude(high))).otherwise(_share(v, low, high))
        bin_ = F.least(F.floor(share * bins), F.lit(bins - 1)).alias("_bin")
        hist = inside.groupBy(*bounds, bin_).agg(F.count(F.lit(1)).alias("_m"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        upto = Window.partitionBy(*bounds).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = materialize(hist.withColumn("_upto", F.sum("_m").over(upto)), "bins")
        met = _met(open_.drop("_rows"), hist, bounds).where((F.col("_left") < F.col("_upto")) & (F.col("_left") >= F.col("_upto") - F.col("_m")))
        open_ = met.select(*keys, F.col("_from").alias("_low"), F.col("_to").alias("_high"), F.col("_m").alias("_rows"), "_rank", (F.col("_left") - F.col("_upto") + F.col("_m")).alias("_left"))
    small = materialize(reduce(DataFrame.unionByName, short), "ranges")
    order = Window.partitionBy(*bounds).orderBy("_v")
    ranked = _within(long, small.select(*bounds).distinct(), keys).withColumn("_place", F.row_number().over(order) - 1)
    last_found = _met(small, ranked, bounds).where(F.col("_left") == F.col("_place")).select(*keys, "_rank", F.col("_v").alias("_value"))
    found = reduce(DataFrame.unionByName, done).unionByName(last_found)
    held = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"))
    held = _met(held, large.select(*keys, "_n"), keys)
    return held.select(*keys, F.array(*(_between(F.lit(float(s)) * last) for s in shares)).alias("_q"))


def _magnitude(x: Column) -> Column:
    """The binary logarithm of |x| with the sign of x, moved so that it grows with x for all doubles."""
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1075))


def _share(x: Column, low: Column, high: Column) -> Column:
    """Where x lies between low and high."""
    return (x - low) / (high - low)


def _between(place: Column) -> Column:
    low, high = F.col("_at")[F.floor(place)], F.col("_at")[F.ceil(place)]
    return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)


def _within(long: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each range, with its bounds. A group has no more ranges than wanted ranks."""
    return _met(long, ranges, keys).where((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
