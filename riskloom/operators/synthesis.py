"""From a table of predictions to verdicts and a Markdown report. Only aggregates of a bounded size reach the driver."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import metrics
from riskloom.operators import incremental, rulescore, strata, verdicts

A, B, CATEGORY = "model_a_score", "model_b_score", "model_a_category"
SCHEMA = "finding string, value double, low double, high double, verdict string"


def _beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction from the inside out."""
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(1 - x, b, a)
    inner = 1.0
    for k in range(200 + int(5 * math.sqrt(max(a, b))), 0, -1):
        m = k // 2
        weight = -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1)) if k % 2 else m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m))
        inner = 1 + weight * x / inner
    return math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a / inner


def correlation_p(rho: float, n: int) -> float:
    """Two-sided p-value of a correlation by t with n - 2 degrees of freedom; 1 under 3 rows."""
    if n < 3:
        return 1.0
    free = n - 2
    return 0.0 if abs(rho) >= 1 else _beta_tail(1 - rho * rho, free / 2, 0.5)


def failure_summary(df: DataFrame) -> DataFrame:
    """One row: rows, failures and failure rate of each model, and the rows both scored at least (total less the larger failure count)."""
    failed = {m: F.count_if(~F.coalesce(F.col(f"model_{m}_valid"), F.lit(False))) for m in "ab"}
    parts = [F.count(F.lit(1)).alias("n"), *(c.alias(f"failed_{m}") for m, c in failed.items())]
    rate = {f"failure_rate_{m}": F.coalesce(F.try_divide(F.col(f"failed_{m}").cast("double"), F.col("n")), F.lit(0.0)) for m in "ab"}
    return df.agg(*parts).withColumns({**rate, "joint": F.col("n") - F.greatest("failed_a", "failed_b")})


def discordant_readings(quadrants: DataFrame) -> DataFrame:
    """(reading, value) from the quadrants' rows: the share of rows where only B is high, and what a high B adds to the rate where A is
    low and where A is high, as difference and as ratio; a ratio over a rate of zero is 1, a share of no rows 0."""
    n = {q: F.max(F.when(F.col("quadrant") == q, F.col("n"))) for q, _, _ in strata.QUADRANTS}
    r = {q: F.max(F.when(F.col("quadrant") == q, F.col("rate"))) for q, _, _ in strata.QUADRANTS}
    ll, lh, hl, hh = (r[q] for q, _, _ in strata.QUADRANTS)
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(1.0)
    values = {
        "share with B alone high": F.coalesce(F.try_divide(n["A-low/B-high"].cast("double"), F.sum("n").cast("double")), F.lit(0.0)),
        "risk difference where A is low": lh - ll, "risk ratio where A is low": ratio(lh, ll), "risk difference where A is high": hh - hl, "risk ratio where A is high": ratio(hh, hl),
    }
    row = quadrants.agg(F.array(*(F.struct(F.lit(name).alias("reading"), v.alias("value")) for name, v in values.items())).alias("_r"))
    return row.select(F.explode("_r").alias("_r")).select("_r.*")


def findings(dev: DataFrame, test: DataFrame, y: str = "mortality_30d", key: str = "subject_id", replicates: int = metrics.REPLICATES, seed: int = 42, gains: DataFrame | None = None) -> DataFrame:
    """(finding, value, low, high, verdict) over the test rows that both models scored: H1, the rank correlation; H2, residual gradients within
    the categories of A; H3, what a high B adds to the risk where A is low; H4, the gain in AUROC of A and B together over A alone,
    fitted on dev, which also decides whether a study on other data is justified. `gains`, as incremental.gains gives them, spares the fit. An empty table is an error."""
    usable = lambda df: df.where("model_a_valid AND model_b_valid").where(F.col(y).isNotNull())
    df = usable(test)
    spark = df.sparkSession
    found = metrics.correlations(df, [], A, B).first()
    if not found["n"]:
        raise ValueError("no rows that both models scored")
    if gains is None:
        gains = incremental.gains(incremental.nested_models(usable(dev), df, y, A, B)[1], y, key, replicates, seed)
    order = F.expr("CASE tertile WHEN 'Low' THEN 1 WHEN 'Mid' THEN 2 ELSE 3 END")
    ratios = verdicts.gradients(strata.tertiles_within(df, CATEGORY, y, B), "category", order)
    strong = ratios.agg(F.avg("ratio").alias("mean"), F.count_if("meaningful").alias("meaningful"), F.count(F.lit(1)).alias("groups")).first()
    held = {r["measure"]: r for r in strata.discordance_intervals(df, y, A, B, key=key, replicates=replicates, seed=seed).collect()}  # seven rows
    readings = {r["reading"]: r["value"] for r in discordant_readings(strata.discordance(df, y, A, B)).collect()}
    gain = gains.where("measure = 'auroc'").first()
    bounds = lambda r: (r["point"], r["low"], r["high"])
    low_rd, low_rr = held["rd_a_low"], held["rr_a_low"]
    rows = [
        ("H1", "rank correlation", found["spearman"], None, None), ("H2", "mean gradient ratio", strong["mean"], None, None),
        ("H3", "risk difference where A is low", *bounds(low_rd)), ("", "risk ratio where A is low", *bounds(low_rr)), ("", "risk difference where A is high", *bounds(held["rd_a_high"])),
        *(("", name, readings[name], None, None) for name in ("risk ratio where A is high", "share with B alone high")),
        ("H4", "gain in AUROC", *bounds(gain)), ("", "study on other data", *bounds(gain)),
    ]
    t = spark.createDataFrame([(f"{h}: {name}" if h else name, None if v is None else float(v), low, high) for h, name, v, low, high in rows], "finding string, value double, low double, high double")
    is_ = lambda name: F.col("finding") == name
    aligned = F.concat_ws(", ", verdicts.correlation_verdict(F.col("value"), F.lit(correlation_p(found["spearman"], found["n"]))), rulescore.alignment_strength(F.col("value")))
    verdict = F.when(is_("H1: rank correlation"), aligned).when(is_("H2: mean gradient ratio"), verdicts.gradient_verdict(F.lit(strong["meaningful"]), F.lit(strong["groups"])))
    verdict = verdict.when(is_("H3: risk difference where A is low"), verdicts.contrast_verdict(F.col("low"), F.col("high"), F.lit(low_rr["low"])))
    verdict = verdict.when(is_("H4: gain in AUROC"), verdicts.gain_verdict(F.col("low"), F.col("value"), F.col("high"))).when(is_("study on other data"), verdicts.recommendation(F.col("low"), F.col("value"), F.col("high")))
    return t.select("finding", "value", "low", "high", verdict.alias("verdict"))


def utility_distinction(gains: DataFrame, lrt: float | None = None, p: float | None = None) -> DataFrame:
    """One row: whether B adds information (the gain in AUROC has an interval above zero), in words, and what its numbers leave open. gains: measure,
    point, low, high. Without a gain in AUROC nothing is added."""
    told = "no test of nested models" if p is None else f"likelihood ratio {lrt or 0.0:.2f}, " + ("p < 10^-15" if p < 1e-15 else f"p = {p:.2e}")
    of = lambda c, m: F.max(F.when(F.col("measure") == m, F.col(c)))
    held = gains.agg(*(of(c, m).alias(f"{m}_{c}") for m in ("auroc", "brier") for c in ("point", "low", "high")))
    adds = verdicts.gain_is_significant(F.col("auroc_low"))
    shown = lambda m: F.format_string(f"{m} %.4f (%.4f to %.4f)", f"{m}_point", f"{m}_low", f"{m}_high")
    summary = F.concat(F.when(adds, "B adds information on the test split: ").otherwise("B is not shown to add information on the test split: "), F.concat_ws(", ", F.when(F.col("auroc_point").isNotNull(), shown("auroc")), F.when(F.col("brier_point").isNotNull(), shown("brier")), F.lit(told)))
    width = F.format_string("The interval of the gain in AUROC is %.4f wide; nobody was treated by it.", F.col("auroc_high") - F.col("auroc_low"))
    return held.select(F.col("auroc_point").alias("gain_auroc"), F.col("brier_point").alias("gain_brier"), adds.alias("adds_information"), summary.alias("summary"), F.coalesce(width, F.lit("No gain in AUROC was measured.")).alias("boundary"))


def markdown(title: str, tables: dict[str, DataFrame], rows: int = 1000) -> str:
    """Small results as Markdown; a table of more than `rows` rows is an error, not cut."""
    out = [f"# {title}", ""]
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    for name, df in tables.items():
        held = df.take(rows + 1)
        if len(held) > rows:
            raise ValueError(f"{name} has more than {rows} rows")
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *("| " + " | ".join(map(show, r)) + " |" for r in held), ""]
    return "\n".join(out)
