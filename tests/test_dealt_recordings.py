"""Recordings made of vectors: dealt over many tasks, with the values of the formula."""

from riskloom.plans import queries


def test_recordings_are_dealt_and_follow_the_formula(spark, tmp_path):
    vectors = [[0.1 * (k + 1) * (-1) ** j - 0.03 * j for j in range(5 + k % 3)] for k in range(40)]
    rows = [(k, v) for k, v in enumerate(vectors)] + [(100, []), (101, None), (102, [None, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    made = queries.recordings(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    got = {r.vec_id: r.signal for r in made.collect()}
    assert len(got) == 43 and got[100] is None and got[101] is None
    assert len(got[102]) == 12 and got[102][1][40] == 0.5 + 1.0 and got[102][0][40] is None
    wave = lambda t, at, width: max(0.0, 1.0 - abs(t % 80 - at) / float(width))
    for n, v in enumerate(vectors):
        part = lambda k: abs(v[k % len(v)])  # noqa: B023, E731
        want = [[(0.5 + part(k)) * wave(t, 40, 3) - part(k + 12) * wave(t, 36, 2) + (part(k + 24) - 0.1) * wave(t, 60, 8) for t in range(400)] for k in range(12)]
        assert got[n] == want
