"""Strata, surfaces, discordance and decision curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import metrics, resampling
from riskloom.functions.quantiles import quantiles

CATEGORIES = ("normal", "borderline", "possible_injury", "probable_infarction")
QUADRANTS = (("A-low/B-low", False, False), ("A-low/B-high", False, True), ("A-high/B-low", True, False), ("A-high/B-high", True, True))
QUARTERS = [0.25, 0.5, 0.75]
THRESHOLDS = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4)


def stratified_risk(df: DataFrame, category: str, y: str, b: str) -> DataFrame:
    """Per category, also empty ones: n, events, rate, the distribution of b, and its auroc and auprc where both classes occur."""
    names = F.broadcast(df.sparkSession.createDataFrame([(k, c) for k, c in enumerate(CATEGORIES)], "place int, category string"))
    by = df.groupBy(F.col(category).alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("events"), F.avg(F.col(y).cast("double")).alias("rate"), F.avg(b).alias("mean_b"), F.stddev_pop(b).alias("sd_b"),
    )
    quarters = quantiles(df.select(F.col(category).alias("category"), b), ["category"], [b], QUARTERS).withColumnRenamed(f"{b}_q", "_q")
    zero, both = F.lit(0).cast("long"), (F.col("events") > 0) & (F.col("events") < F.col("n"))
    ranks = metrics.discrimination(df, [category], y, b).withColumnRenamed(category, "category")
    out = names.join(by, "category", "left").join(ranks, "category", "left").join(quarters, "category", "left")
    return out.select("category", F.coalesce("n", zero).alias("n"), F.coalesce("events", zero).alias("events"), F.coalesce("rate", F.lit(0.0)).alias("rate"), "mean_b", "sd_b", F.col("_q")[0].alias("q25_b"), F.col("_q")[1].alias("median_b"), F.col("_q")[2].alias("q75_b"), F.when(both, F.col("auroc")).alias("auroc"), F.when(both, F.col("auprc")).alias("auprc"))


def tertiles_within(df: DataFrame, category: str, y: str, b: str) -> DataFrame:
    """Per category of at least 3 rows and third of b (value cuts, closed on the left): n, events, rate; 0 in an empty third."""
    rows = df.select(F.col(category).alias("category"), F.col(b).alias("_b"), F.col(y).alias("_y"))
    sizes = rows.groupBy("category").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 3").drop("_n")
    cuts = quantiles(rows, ["category"], ["_b"], [1 / 3, 2 / 3]).withColumnRenamed("_b_q", "_c").join(sizes, "category")
    rows = rows.join(cuts, "category")
    rows = rows.withColumn("tertile", F.when(F.col("_b") < F.col("_c")[0], "Low").when(F.col("_b") < F.col("_c")[1], "Mid").otherwise("High"))
    by = rows.groupBy("category", "tertile").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_y").cast("long")).alias("events"), F.avg(F.col("_y").cast("double")).alias("rate"))
    every = cuts.select("category", F.explode(F.array(*map(F.lit, ("Low", "Mid", "High")))).alias("tertile"))
    zero = F.lit(0).cast("long")
    return every.join(by, ["category", "tertile"], "left").select("category", "tertile", F.coalesce("n", zero).alias("n"), F.coalesce("events", zero).alias("events"), F.coalesce("rate", F.lit(0.0)).alias("rate"))


def cuts_of(df: DataFrame, a: str, b: str, a_cut: float | None = 15.0, b_cut: float | None = None) -> tuple[float | None, float | None]:
    """Both cuts; one that isn't given is the median of df."""
    if a_cut is not None and b_cut is not None:
        return a_cut, b_cut
    middle = quantiles(df, [], [a, b], [0.5]).first()
    return tuple((m[0] if m else None) if c is None else c for c, m in zip((a_cut, b_cut), middle, strict=True))


def discordance(df: DataFrame, y: str, a: str, b: str, a_cut: float | None = 15.0, b_cut: float | None = None) -> DataFrame:
    """The four quadrants in fixed order; high is at or above a cut, a cut that isn't given is the median."""
    a_cut, b_cut = cuts_of(df, a, b, a_cut, b_cut)
    by = df.groupBy((F.col(a) >= F.lit(a_cut)).alias("a_high"), (F.col(b) >= F.lit(b_cut)).alias("b_high")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("events"))
    names = F.broadcast(df.sparkSession.createDataFrame(QUADRANTS, "quadrant string, a_high boolean, b_high boolean"))
    out = names.join(by, ["a_high", "b_high"], "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n", "events")})
    return out.select("quadrant", "n", "events", F.when(F.col("n") > 0, F.col("events") / F.col("n")).otherwise(0.0).alias("rate"))


def discordance_intervals(df: DataFrame, y: str, a: str, b: str, a_cut: float | None = 15.0, b_cut: float | None = None, key: str = "subject_id", replicates: int = metrics.REPLICATES, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(measure, point, low, high): the event rate of each quadrant, and the contrasts rd_a_low, rr_a_low and rd_a_high. The cuts
    stay those of df. A ratio takes part in replicates whose lower rate is above zero; a difference where both quadrants have rows."""
    a_cut, b_cut = cuts_of(df, a, b, a_cut, b_cut)
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(y).isNotNull()).select(key, F.col(y).cast("double").alias("_y"), (2 * (F.col(a) >= F.lit(a_cut)).cast("int") + (F.col(b) >= F.lit(b_cut)).cast("int")).alias("_q"))
    inside = [(F.col("_q") == k).cast("double") for k in range(4)]
    terms = [x for here in inside for x in (here, here * F.col("_y"))]
    names_of = [f"{c}{k}" for k in range(4) for c in "ne"]
    rate = lambda k: F.try_divide(F.col(f"e{k}"), F.col(f"n{k}"))
    names = [q for q, _, _ in QUADRANTS]

    def measures(frame: DataFrame, whole: bool) -> DataFrame:
        held = [F.coalesce(rate(k), F.lit(0.0)) if whole else rate(k) for k in range(4)]
        ratio = F.when(held[0] > 0, held[1] / held[0])
        values = [*held, held[1] - held[0], F.coalesce(ratio, F.lit(1.0)) if whole else ratio, held[3] - held[2]]
        pairs = F.array(*(F.struct(F.lit(n).alias("measure"), v.alias("value")) for n, v in zip([*names, "rd_a_low", "rr_a_low", "rd_a_high"], values, strict=True)))
        return frame.select(F.explode(pairs).alias("_m")).select("_m.*")

    points = measures(d.agg(*(F.sum(x).alias(c) for x, c in zip(terms, names_of, strict=True))), True).withColumnRenamed("value", "point")
    sums = resampling.weighted_sums(d, [], terms, key, replicates, seed)
    draws = measures(sums.select(*(F.col(f"s{k}").alias(c) for k, c in enumerate(names_of))), False).where("value IS NOT NULL")
    out = points.join(metrics.interval(draws, ["measure"], "value", level), "measure", "left")
    return out.select("measure", "point", F.coalesce("low", "point").alias("low"), F.coalesce("high", "point").alias("high"))


def risk_contrasts(quadrants: DataFrame) -> DataFrame:
    """Risk difference and ratio of B-high against B-low; a ratio over zero is 1."""
    r = {q: F.max(F.when(F.col("quadrant") == q, F.col("rate"))) for q, _, _ in QUADRANTS}
    ll, lh, hl, hh = (r[q] for q, _, _ in QUADRANTS)
    return quadrants.agg((lh - ll).alias("rd_a_low"), F.when(ll > 0, lh / ll).otherwise(1.0).alias("rr_a_low"), (hh - hl).alias("rd_a_high"))


def smoother(df: DataFrame, a: str, b: str, points: int = 25) -> DataFrame:
    """E(b | a) on a grid over a, with Gaussian weights: each row meets the grid's 25 points, partial sums leave the task."""
    low, high, mean = df.agg(F.min(a), F.max(a), F.avg(b)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "x double, expected_b double")
    width = max((high - low) / 12.5, 1.0)
    grid = [low + (high - low) * k / (points - 1) for k in range(points)] if high > low else [low]
    d = df.select(F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"), F.explode(F.array(*(F.lit(float(g)) for g in grid))).alias("x"))
    w = F.exp(-0.5 * F.pow((F.col("_a") - F.col("x")) / width, 2.0))
    sums = d.groupBy("x").agg(F.sum(w).alias("_w"), F.sum(w * F.col("_b")).alias("_wb"))
    return sums.select("x", F.when(F.col("_w") > 1e-12, F.col("_wb") / F.col("_w")).otherwise(mean).alias("expected_b"))


def risk_surface(df: DataFrame, y: str, a: str, b: str, bins: int = 5) -> DataFrame:
    """(a_bin, b_bin, n, events, rate) of every cell between distinct percentile edges; the rate of an empty cell is null."""
    ea, eb = (sorted(set(e or [])) for e in quantiles(df, [], [a, b], [k / bins for k in range(bins + 1)]).first())
    place = lambda c, edges: sum(((F.col(c) >= e).cast("int") for e in edges[1:-1]), F.lit(0))
    by = df.groupBy(place(a, ea).alias("a_bin"), place(b, eb).alias("b_bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("events"), F.avg(F.col(y).cast("double")).alias("rate"))
    cells = [(i, j) for i in range(max(1, len(ea) - 1)) for j in range(max(1, len(eb) - 1))]
    zero = F.lit(0).cast("long")
    grid = F.broadcast(df.sparkSession.createDataFrame(cells, "a_bin int, b_bin int"))  # bins x bins rows
    return grid.join(by, ["a_bin", "b_bin"], "left").select("a_bin", "b_bin", F.coalesce("n", zero).alias("n"), F.coalesce("events", zero).alias("events"), "rate")


def decile_calibration(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """(bin, n, events, observed, predicted, low, high) over distinct percentile edges of the predicted probability."""
    edges = sorted(set(quantiles(df, [], [p], [k / bins for k in range(bins + 1)]).first()[0] or []))
    place = sum(((F.col(p) >= e).cast("int") for e in edges[1:-1]), F.lit(0))
    return df.where(F.col(p).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("events"), F.avg(F.col(y).cast("double")).alias("observed"), F.avg(p).alias("predicted"), F.min(p).alias("low"), F.max(p).alias("high"))


def decision_curve(df: DataFrame, y: str, p: str, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, net_benefit, treat_all): one aggregate over rows that meet each threshold."""
    d = df.select(F.col(y).cast("double").alias("_y"), F.col(p).alias("_p"), F.explode(F.array(*(F.lit(t) for t in thresholds))).alias("threshold"))
    odds = F.col("threshold") / (1.0 - F.col("threshold"))
    n, hit = F.count(F.lit(1)), F.col("_p") >= F.col("threshold")
    s = d.groupBy("threshold").agg(n.alias("n"), F.sum(F.when(hit, F.col("_y")).otherwise(0.0)).alias("tp"), F.sum(F.when(hit, 1.0 - F.col("_y")).otherwise(0.0)).alias("fp"), F.sum("_y").alias("e"))
    return s.select("threshold", (F.col("tp") / F.col("n") - F.col("fp") / F.col("n") * odds).alias("net_benefit"), (F.col("e") / F.col("n") - (F.col("n") - F.col("e")) / F.col("n") * odds).alias("treat_all"))


def decision_curves(df: DataFrame, y: str, models: dict[str, str], thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, net_benefit_<model> of each, treat_all) over the rows that all models rate; models: name -> column of probabilities."""
    d = df.dropna(subset=list(models.values())).select(F.col(y).cast("double").alias("_y"), *models.values(), F.explode(F.array(*(F.lit(t) for t in thresholds))).alias("threshold"))
    odds, n = F.col("threshold") / (1.0 - F.col("threshold")), F.count(F.lit(1))
    part = lambda p, term: F.sum(F.when(F.col(p) >= F.col("threshold"), term).otherwise(0.0))
    sums = [x for m, p in models.items() for x in (part(p, F.col("_y")).alias(f"tp_{m}"), part(p, 1.0 - F.col("_y")).alias(f"fp_{m}"))]
    s = d.groupBy("threshold").agg(n.alias("n"), F.sum("_y").alias("e"), *sums)
    benefit = lambda tp, fp: F.col(tp) / F.col("n") - F.col(fp) / F.col("n") * odds
    return s.select("threshold", *(benefit(f"tp_{m}", f"fp_{m}").alias(f"net_benefit_{m}") for m in models), (F.col("e") / F.col("n") - (F.col("n") - F.col("e")) / F.col("n") * odds).alias("treat_all"))


def score_distribution(df: DataFrame, y: str, score: str) -> DataFrame:
    d = df.select(F.col(y).cast("int").alias("outcome"), F.col(score).alias("_s"))
    moments = d.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.avg("_s").alias("mean"), F.stddev_pop("_s").alias("sd"))
    quarters = quantiles(d, ["outcome"], ["_s"], QUARTERS).withColumnRenamed("outcome", "_outcome")
    out = moments.join(quarters, F.col("outcome").eqNullSafe(F.col("_outcome")))
    return out.select("outcome", "n", "mean", "sd", *(F.col("_s_q")[k].alias(name) for k, name in enumerate(("q25", "median", "q75"))))


def capacity_capture(df: DataFrame, key: str, y: str, p: str, shares: tuple[float, ...] = (0.01, 0.025, 0.05, 0.1, 0.2)) -> DataFrame:
    """(share, flagged, captured, sensitivity, ppv) when the top share by p is flagged, ties to the smaller key.

    Ranks come from row numbers within ranges of p plus the sizes of the ranges above, so no task sorts all rows."""
    cuts = df.agg(F.expr(f"percentile_approx({p}, array({', '.join(f'{k / 64!r}D' for k in range(1, 64))}), 10000)")).first()[0]
    zone = sum(((F.col(p) < c).cast("int") for c in sorted(set(cuts or []))), F.lit(0))
    d = df.select(F.col(key).alias("_k"), F.col(y).cast("double").alias("_y"), F.col(p).alias("_p"), zone.alias("_z"))
    sizes = d.groupBy("_z").agg(F.count(F.lit(1)).alias("_n"))  # at most 64 rows
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_z").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.orderBy("_z").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ranked = d.join(F.broadcast(before), "_z").withColumn("_r", F.row_number().over(Window.partitionBy("_z").orderBy(F.desc("_p"), "_k")) + F.col("_before"))
    x = ranked.withColumn("share", F.explode(F.array(*(F.lit(s) for s in shares))))
    flag = F.col("_r") <= F.ceil(F.col("share") * F.col("_all"))
    s = x.groupBy("share").agg(F.sum(flag.cast("long")).alias("flagged"), F.sum(F.when(flag, F.col("_y")).otherwise(0.0)).cast("long").alias("captured"), F.sum("_y").alias("_e"))
    return s.select("share", "flagged", "captured", (F.col("captured") / F.col("_e")).alias("sensitivity"), (F.col("captured") / F.col("flagged")).alias("ppv"))
