"""Refined quantiles against numpy: ties, hot groups, odd values."""

import random

import numpy as np
import pytest

from riskloom.functions.quantiles import quantiles

SHARES = [0.0, 0.1, 1 / 3, 0.5, 0.75, 0.999, 1.0]


def groups_of(rows):
    held = {}
    for g, h, *values in rows:
        held.setdefault((g, h), []).append(values)
    return held


@pytest.mark.parametrize("settled,bins", [(100_000, 4096), (40, 64)])
def test_equal_numpy_for_any_bounds(spark, settled, bins):
    rng = random.Random(settled + bins)
    rows = []
    for g, h, n in (("hot", 1, 1500), ("tied", 2, 400), (None, 3, 120), ("x", None, 60), ("one", 1, 1), ("two", 1, 2), ("null", 1, 3)):
        for _ in range(n):
            tied = rng.choice([0.0, 1.0, 1.0, 1.0, 2.5])
            wide = rng.choice([1, -1]) * 10.0 ** rng.uniform(-300, 300)
            rows.append((g, h, tied if g == "tied" else rng.gauss(0, 1), wide))
    rows += [("null", 9, None, None), ("hot", 1, None, float("nan")), ("x", None, float("nan"), None)]
    df = spark.createDataFrame(rows, "g string, h int, v double, w double").repartition(3).cache()
    got = {(r.g, r.h): r for r in quantiles(df, ["g", "h"], ["v", "w"], SHARES, settled, bins).collect()}
    want = groups_of(rows)
    assert got.keys() == want.keys()
    for key, values in want.items():
        for k, name in enumerate(("v_q", "w_q")):
            x = [v[k] for v in values if v[k] is not None and v[k] == v[k]]
            if x:
                assert np.allclose(got[key][name], np.quantile(x, SHARES), rtol=1e-9, atol=1e-12)
            else:
                assert got[key][name] is None


def test_extremes_and_whole_tables(spark):
    rows = [(x,) for x in (1.7e308, -1.7e308, 0.0, 5e-324, -0.0, 3.0) * 5]
    df = spark.createDataFrame(rows, "v double")
    got = quantiles(df, [], ["v"], [0.0, 0.5, 1.0], settled=2, bins=4).first()
    assert got.v_q == [-1.7e308, 0.0, 1.7e308]
    assert quantiles(df.where("v > 1.75e308"), [], ["v"], [0.5]).first().v_q is None
    assert quantiles(df.where("false").selectExpr("1 AS g", "v"), ["g"], ["v"], [0.5]).count() == 0


def test_a_group_of_equal_values_needs_no_sorting(spark):
    df = spark.range(5000).selectExpr("id % 2 AS g", "IF(id % 2 = 0, 4.0D, cast(id AS double)) AS v")
    got = {r.g: r.v_q for r in quantiles(df, ["g"], ["v"], [0.5], settled=10, bins=16).collect()}
    assert got[0] == [4.0] and got[1] == pytest.approx([2500.0])
