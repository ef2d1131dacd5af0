import inspect

from riskloom import cli
from riskloom.functions import bootstrap, metrics
from riskloom.operators import synthesis


def test_intervals_rest_on_1000_replicates(spark):
    df = spark.createDataFrame([(i, i % 3 == 0, float(i % 7)) for i in range(12)], "id long, y boolean, s double")
    assert bootstrap.discrimination_draws(df, [], "y", ["s"], "id").select("replicate").distinct().count() == metrics.REPLICATES == 1000
    assert inspect.signature(synthesis.findings).parameters["replicates"].default == 1000
    asked = lambda *more: cli.Context(spark, cli.build_parser().parse_args(["interpret", "--data", "d", "--out", "o", *more])).replicates
    assert asked() == 1000 and asked("--simulate") == cli.SIMULATED_REPLICATES and asked("--bootstraps", "7") == asked("--simulate", "--bootstraps", "7") == 7
