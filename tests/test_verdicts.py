from pyspark.sql import functions as F

from riskloom.operators import verdicts


def test_gradients(spark):
    rates = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.3), ("b", 1, 0.0), ("b", 2, 0.2), ("c", 1, 0.0), ("c", 2, 0.0), ("d", 1, 0.4)], "g string, k int, rate double")
    got = {r["g"]: (round(r["ratio"], 9), r["infinite"], r["meaningful"]) for r in verdicts.gradients(rates, "g", F.col("k")).collect()}
    assert got == {"a": (3.0, False, True), "b": (3.0, True, True), "c": (1.0, False, False), "d": (1.0, False, False)}


def test_verdicts(spark):
    c = lambda *x: [F.lit(v) for v in x]
    row = spark.range(1).select(
        verdicts.correlation_verdict(*c(0.3, 0.01)), verdicts.gradient_verdict(*c(2, 4)), verdicts.contrast_verdict(*c(-0.1, 0.2, 0.9)),
        verdicts.recommendation(*c(0.01, 0.1, 0.2)), verdicts.recommendation(*c(-0.1, 0.1, 0.2)), verdicts.recommendation(*c(-0.3, -0.1, 0.1)),
    ).first()
    assert list(row) == ["supported", "partly supported", "inconclusive", "justified", "inconclusive", "not justified"]


def test_claims_and_gains(spark):
    df = spark.createDataFrame([("An INDEPENDENT external validation of B", 0.1), ("probing within the domain", 0.0), (None, None)], "t string, low double")
    got = [(r.c, r.g) for r in df.select(verdicts.prohibited_claims(F.col("t")).alias("c"), verdicts.gain_is_significant(F.col("low")).alias("g")).collect()]
    assert got == [(["external validation", "independent external validation"], True), ([], False), ([], False)]


def test_findings_judge_the_joint_gain_and_the_discordant_groups(spark):
    """B alone is no better than A, but adds to it: the gain that counts is that of both over A."""
    import numpy as np

    from riskloom.operators import synthesis

    rng = np.random.default_rng(7)
    rows = []
    for i in range(3000):
        a, b = rng.gamma(3, 4), rng.random()
        y = rng.random() < 1 / (1 + np.exp(-(0.22 * a + 2.2 * b - 5)))
        rows.append((i, "dev" if i % 2 else "test", float(a), float(b), ("normal", "borderline", "possible_injury", "probable_infarction")[min(3, int(a) // 8)], bool(y), True, True))
    df = spark.createDataFrame(rows, "subject_id long, split string, model_a_score double, model_b_score double, model_a_category string, mortality_30d boolean, model_a_valid boolean, model_b_valid boolean").cache()
    got = {r.finding: r for r in synthesis.findings(df.where("split = 'dev'"), df.where("split = 'test'"), replicates=60).collect()}
    y, a, b = (np.array([r[k] for r in rows if r[1] == "test"], float) for k in (5, 2, 3))
    auroc = lambda s: np.mean(s[y == 1][:, None] > s[y == 0])
    assert auroc(b) < auroc(a) and got["H4: gain in AUROC"].low > 0
    assert got["H4: gain in AUROC"].verdict == "supported" and got["study on other data"].verdict == "justified"
    high = np.median(b)
    rate = lambda m: y[m].mean()
    low_rd = rate((a < 15) & (b >= high)) - rate((a < 15) & (b < high))
    h3 = got["H3: risk difference where A is low"]
    assert abs(h3.value - low_rd) < 1e-9 and h3.low < h3.value < h3.high and h3.verdict == "supported"
    assert abs(got["risk ratio where A is high"].value - rate((a >= 15) & (b >= high)) / rate((a >= 15) & (b < high))) < 1e-9
    assert abs(got["share with B alone high"].value - np.mean((a < 15) & (b >= high))) < 1e-9 and got["H1: rank correlation"].low is None
