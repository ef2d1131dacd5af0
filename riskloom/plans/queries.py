"""The queries of the evaluation engine over the bound tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import bootstrap, metrics
from riskloom.operators import adapters, battery, cohort, images, incremental, outcomes, rulescore, scoring, sensitivity, signals, splits, strata, synthesis, verdicts
from riskloom.session import materialize
from riskloom.sources import bindings as bind

OUTCOMES = ("mortality_30d", "mortality_90d", "mortality_1yr")
#: Replicates of queries that return points only, which don't depend on them.
FEW = 2

_RECORDS = "rec AS (SELECT o_custkey AS subject_id, o_orderkey AS study_id, o_orderdate AS ecg_datetime, year(o_orderdate)::BIGINT AS ecg_year FROM orders)"
_PATIENTS = """pat AS (SELECT c_custkey AS subject_id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, 12 + c_custkey % 70 AS anchor_age, 1998 AS anchor_year,
  CASE WHEN c_custkey % 3 = 0 THEN DATE '1998-01-01' + (c_custkey * 37 % 1500)::INTEGER END AS dod_date FROM customer WHERE c_custkey % 50 <> 0)"""
_ADMISSIONS = """lin AS (SELECT l_orderkey, min(l_shipdate) AS admit_dt, max(l_shipdate) AS disch_dt, max((l_returnflag = 'R' AND l_linestatus = 'F')::BIGINT) AS flag FROM lineitem GROUP BY 1),
adm AS (SELECT o_custkey AS subject_id, l_orderkey AS hadm_id, admit_dt, disch_dt, flag, CASE WHEN flag = 1 AND l_orderkey % 20 = 0 THEN disch_dt END AS death_dt FROM lin JOIN orders ON l_orderkey = o_orderkey)"""
_STAYS = """stay AS (SELECT user_id AS subject_id, event_id AS hadm_id, ts AS admit_dt, ts + INTERVAL 3 DAY AS disch_dt FROM events WHERE event_type = 'signup'),
vw AS (SELECT user_id AS subject_id, event_id AS study_id, ts AS ecg_datetime FROM events WHERE event_type = 'view')"""
_FIRST_STAY = """, fst AS (SELECT study_id, coalesce(flag = 1 AND (death_dt IS NULL OR ecg_datetime <= death_dt), false) AS in_hospital_mortality, hadm_id AS linked_hadm_id FROM rec JOIN adm USING (subject_id)
WHERE ecg_datetime BETWEEN admit_dt AND disch_dt QUALIFY row_number() OVER (PARTITION BY study_id ORDER BY admit_dt, hadm_id) = 1)"""
_FIRST_STAY_AGED, _FIRST_STAY_24H = _FIRST_STAY.replace("FROM rec", "FROM aged"), _FIRST_STAY.replace("BETWEEN admit_dt AND", "BETWEEN admit_dt - INTERVAL 24 HOUR AND")
_AGED = "aged AS (SELECT rec.*, gender, anchor_age, dod_date, anchor_age + ecg_year - anchor_year AS age_at_ecg FROM rec JOIN pat USING (subject_id))"
_DEATH = """dt AS (SELECT subject_id, dod_date, hd AS first_hosp_death_dt, coalesce(hf, 0) AS in_hosp_death_flag, ld AS last_disch_dt FROM pat LEFT JOIN (SELECT subject_id,
  min(CASE WHEN flag = 1 THEN death_dt END) AS hd, max((flag = 1)::BIGINT) AS hf, max(disch_dt) AS ld FROM adm GROUP BY 1) USING (subject_id))"""
_OUT = """o1 AS (SELECT a.subject_id, study_id, ecg_datetime, age_at_ecg, dt.dod_date, CASE WHEN in_hosp_death_flag = 1 AND first_hosp_death_dt IS NOT NULL THEN date_sub('second', ecg_datetime, first_hosp_death_dt) / 86400.0::DOUBLE
    WHEN dt.dod_date IS NOT NULL THEN date_diff('day', ecg_datetime::DATE, dt.dod_date)::DOUBLE END AS days_to_death,
    CASE WHEN last_disch_dt IS NOT NULL THEN date_sub('second', ecg_datetime, last_disch_dt) / 86400.0::DOUBLE ELSE 0.0::DOUBLE END AS activity_followup_days FROM aged a LEFT JOIN dt USING (subject_id)),
o2 AS (SELECT *, NOT coalesce(days_to_death < 0, false) AS is_valid FROM o1),
o3 AS (SELECT *, CASE WHEN is_valid THEN coalesce(days_to_death BETWEEN 0 AND 30, false) END AS m30, CASE WHEN is_valid THEN coalesce(days_to_death BETWEEN 0 AND 90, false) END AS m90, CASE WHEN is_valid THEN coalesce(days_to_death BETWEEN 0 AND 365.25::DOUBLE, false) END AS m1 FROM o2)"""
_PRED = """p0 AS (SELECT c_custkey, (c_acctbal + 1000.0::DOUBLE) / 11000.0::DOUBLE * 45.0::DOUBLE AS a FROM customer),
p1 AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(0.08::DOUBLE * a + 2.0::DOUBLE * ((c_custkey * 7919 % 1000) / 1000.0::DOUBLE) - 3.5::DOUBLE))) AS b FROM p0),
pred AS (SELECT c_custkey AS subject_id, CASE WHEN (c_custkey * 31 + 42) % 10 < 6 THEN 'dev' WHEN (c_custkey * 31 + 42) % 10 < 8 THEN 'val' ELSE 'test' END AS split, a, b, ln(b / (1.0::DOUBLE - b)) AS lo,
  CASE WHEN a < 10 THEN 'normal' WHEN a < 15 THEN 'borderline' WHEN a < 20 THEN 'possible_injury' ELSE 'probable_infarction' END AS cat, c_custkey % 41 <> 0 AS va, c_custkey % 43 <> 0 AS vb,
  (c_custkey * 104729 % 997) / 997.0::DOUBLE < b AS y30, (c_custkey * 7907 % 997) / 997.0::DOUBLE < b AS y90, (c_custkey * 6997 % 997) / 997.0::DOUBLE < b AS y1 FROM p1)"""


def _rank_sql(source: str, group: str) -> str:
    """auroc and auprc per group of source(g, y, s)."""
    return f"""d AS (SELECT {group} AS g, s, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM ({source}) GROUP BY ALL),
w AS (SELECT *, sum(pos) OVER (PARTITION BY g ORDER BY s DESC) AS tp, sum(neg) OVER (PARTITION BY g ORDER BY s DESC) AS fp, sum(pos) OVER (PARTITION BY g) AS p, sum(neg) OVER (PARTITION BY g) AS n FROM d),
r AS (SELECT g, round(CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(neg * (tp - pos / 2)) / (max(p) * max(n)) ELSE 0.5 END, 8) AS auroc, round(CASE WHEN max(p) > 0 THEN sum(pos * tp / (tp + fp)) / max(p) ELSE 0 END, 8) AS auprc FROM w GROUP BY g)"""


def _compare_sql(source: str, group: str) -> str:
    """A, B and B - A per group of source(h, a, b, y)."""
    ranked = "SELECT h || '|a' AS k, a AS s, y FROM src UNION ALL SELECT h || '|b', b, y FROM src"
    return f"""src AS ({source}), {_rank_sql(ranked, 'k')},
u AS (SELECT g, CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(neg * (tp - pos / 2)) / (max(p) * max(n)) ELSE 0.5 END AS auroc, CASE WHEN max(p) > 0 THEN sum(pos * tp / (tp + fp)) / max(p) ELSE 0 END AS auprc FROM w GROUP BY g),
q AS (SELECT h, y, rank() OVER (PARTITION BY h ORDER BY a) + (count(*) OVER (PARTITION BY h, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY h ORDER BY b) + (count(*) OVER (PARTITION BY h, b) - 1) / 2.0::DOUBLE AS rb FROM src),
c AS (SELECT h, count(*) AS n, sum(y)::BIGINT AS events, round(avg(y), 8) AS rate, round(corr(ra, rb), 8) AS spearman FROM q GROUP BY h)
SELECT h AS {group}, c.n, c.events, c.rate, {', '.join(f'round(ua.{m}, 8) AS {m}_a, round(ub.{m}, 8) AS {m}_b, round(ub.{m} - ua.{m}, 8) AS delta_{m}' for m in ('auroc', 'auprc'))}, spearman FROM c JOIN u ua ON ua.g = h || '|a' JOIN u ub ON ub.g = h || '|b'"""


def _rounded(df: DataFrame, places: int = 8) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _aged(s: SparkSession, d: str) -> DataFrame:
    return cohort.age_at_recording(bind.records(s, d), bind.patients(s, d))


def _outcomes(s: SparkSession, d: str) -> DataFrame:
    return outcomes.mortality_outcomes(_aged(s, d), bind.patients(s, d), bind.admissions(s, d))


def _valid(s: SparkSession, d: str, split: str | None = None) -> DataFrame:
    p = bind.predictions(s, d).where("model_a_valid AND model_b_valid")
    return p.where(F.col("split") == split) if split else p


def age_at_recording(s, d):
    return _aged(s, d).select("subject_id", "study_id", "ecg_year", "anchor_age", "age_at_ecg")


def adult_records(s, d):
    return cohort.adults(_aged(s, d)).select("subject_id", "study_id", "age_at_ecg")


def link_0h(s, d):
    return cohort.link_admissions(bind.records(s, d), bind.admissions(s, d)).select("subject_id", "study_id", "hadm_id")


def link_24h_stays(s, d):
    return cohort.link_admissions(bind.views(s, d), bind.stays(s, d), 24).select("subject_id", "study_id", "hadm_id")


def index_earliest(s, d):
    return cohort.index_recordings(bind.records(s, d)).select("subject_id", "study_id")


def index_latest(s, d):
    return cohort.index_recordings(bind.records(s, d), "latest").select("subject_id", "study_id")


def linkage_statistics(s, d):
    return _rounded(cohort.linkage_statistics(bind.views(s, d), bind.patients(s, d), bind.stays(s, d)))


def death_table(s, d):
    t = outcomes.death_table(bind.patients(s, d), bind.admissions(s, d))
    return t.select("subject_id", *(F.col(c).cast("string").alias(c) for c in ("dod_date", "first_hosp_death_dt", "last_disch_dt")), "in_hosp_death_flag")


def mortality_outcomes(s, d):
    o = _outcomes(s, d)
    return _rounded(o.select("subject_id", "study_id", "days_to_death", "activity_followup_days", "is_valid", "exclusion_reason", *OUTCOMES, *(f"time_to_{h}_days" for h, _ in outcomes.HORIZONS)))


def inhospital_mortality(s, d):
    return outcomes.inhospital_mortality(bind.records(s, d), bind.admissions(s, d))


def outcome_statistics(s, d):
    inside = outcomes.first_encounters(_aged(s, d), bind.admissions(s, d)).drop("subject_id")
    return _rounded(outcomes.outcome_statistics(_outcomes(s, d).join(inside, "study_id", "left")))


def attrition(s, d):
    return cohort.attrition(bind.records(s, d), bind.patients(s, d), bind.admissions(s, d))


def split_hashed(s, d):
    return splits.hashed_split(cohort.index_recordings(bind.records(s, d))).select("subject_id", "split")


def split_overlap(s, d):
    """The check on splits in which every 97th subject was put into one more split, as a leak would."""
    dealt = splits.hashed_split(bind.records(s, d)).select("subject_id", "split")
    leaked = dealt.where("subject_id % 97 = 0").withColumn("split", F.when(F.col("split") == "test", "dev").otherwise("test"))
    return splits.overlapping_subjects(dealt.unionByName(leaked)).select("subject_id", "splits")


def split_summary(s, d):
    return _rounded(splits.split_summary(bind.predictions(s, d), OUTCOMES))


def prediction_summary(s, d):
    return _rounded(scoring.prediction_summary(bind.predictions(s, d)))


def prediction_validity(s, d):
    return _rounded(scoring.validity(bind.predictions(s, d)))


def category_counts(s, d):
    return bind.predictions(s, d).groupBy("split", F.col("model_a_category").alias("category")).agg(F.count(F.lit(1)).alias("n"))


def proper_scores(s, d):
    return _rounded(metrics.proper_scores(_valid(s, d), ["split"], "mortality_30d", "model_b_score"))


def discrimination(s, d):
    return _rounded(metrics.discrimination(_valid(s, d), ["split"], "mortality_30d", "model_b_score"))


def correlations(s, d):
    return _rounded(metrics.correlations(_valid(s, d), ["split"], "model_a_score", "model_b_score"))


def horizon_sensitivity(s, d):
    p = _valid(s, d, "test")
    long = p.select("model_b_score", F.explode(F.array(*(F.struct(F.lit(o).alias("horizon"), F.col(o).alias("y")) for o in OUTCOMES))).alias("x")).select("model_b_score", "x.*")
    return _rounded(metrics.discrimination(long, ["horizon"], "y", "model_b_score"))


def score_comparison(s, d):
    """The rule score of the predictions against other rule scores of the same subjects, over those with a measured vector."""
    e, v = _measured(s, d)
    scores = e.select(F.col("vec_id").alias("subject_id"), rulescore.rule_score(v).alias("rule_score"), rulescore.simplified_score(v).alias("simplified_score"))
    p = _valid(s, d, "test").join(scores, "subject_id")
    return _rounded(battery.alternative_scores(p, "mortality_30d", "model_b_score", ["model_a_score", "rule_score", "simplified_score"]))


def subgroups(s, d):
    p = _valid(s, d, "test").join(bind.patients(s, d), "subject_id")
    groups = F.array(F.when(F.col("anchor_age") < 65, "<65").otherwise(">=65"), F.col("gender"))
    long = p.select("mortality_30d", "model_b_score", F.explode(groups).alias("subgroup"))
    big = long.groupBy("subgroup").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    return _rounded(metrics.discrimination(long, ["subgroup"], "mortality_30d", "model_b_score").join(big, "subgroup"))


def anchoring_sensitivity(s, d):
    """B in all subjects, in those that both models scored, and in those with a recording inside an encounter."""
    p = bind.predictions(s, d).where("model_b_valid")
    anchored = cohort.recordings_inside(bind.records(s, d), bind.admissions(s, d)).select("subject_id").distinct().withColumn("_anchored", F.lit(True))
    both = p.join(anchored, "subject_id", "left").withColumn("cohort", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("model_a_valid"), "joint"), F.when(F.col("_anchored"), "anchored")))))
    both = materialize(both.select("cohort", "mortality_30d", "model_b_score"), "anchored")  # read several times
    return _rounded(metrics.discrimination(both, ["cohort"], "mortality_30d", "model_b_score"))


def _by_horizon(s, d):
    return sensitivity.by_horizon(_valid(s, d, "test"), OUTCOMES)


def horizon_comparison(s, d):
    return _rounded(sensitivity.compare(_by_horizon(s, d), ["horizon"], "y"))


def horizon_comparison_intervals(s, d):
    return sensitivity.compare_intervals(_by_horizon(s, d), ["horizon"], "y")


def _battery_rows(s, d):
    p = sensitivity.with_inhospital(_valid(s, d), bind.records(s, d), bind.admissions(s, d))
    return p.where("split = 'dev'"), p.where("split = 'test'")


def horizon_battery(s, d):
    found = _rounded(sensitivity.horizon_battery(*_battery_rows(s, d), sensitivity.HORIZONS), 6)
    # p_value follows from lrt, and SQL has no chi-square
    return found.withColumn("lrt", F.round("lrt", 4)).drop("p_value")


def horizon_battery_intervals(s, d):
    return sensitivity.horizon_intervals(*_battery_rows(s, d), sensitivity.HORIZONS)


def _by_subgroup(s, d):
    return sensitivity.by_subgroup(_valid(s, d, "test"), bind.patients(s, d))


def subgroup_comparison(s, d):
    return _rounded(sensitivity.compare(_by_subgroup(s, d), ["subgroup"], "mortality_30d"))


def subgroup_comparison_intervals(s, d):
    return sensitivity.compare_intervals(_by_subgroup(s, d), ["subgroup"], "mortality_30d")


def subgroup_contrasts(s, d):
    return sensitivity.gain_contrasts(_by_subgroup(s, d), "subgroup", "mortality_30d")


def _index_cohorts(s, d):
    return sensitivity.index_cohorts(_valid(s, d, "test"), bind.records(s, d), bind.admissions(s, d))


def admission_anchoring(s, d):
    return _rounded(sensitivity.compare(_index_cohorts(s, d), ["cohort"], "mortality_30d"))


def admission_anchoring_intervals(s, d):
    return sensitivity.compare_intervals(_index_cohorts(s, d), ["cohort"], "mortality_30d")


def stratified_risk(s, d):
    return _rounded(strata.stratified_risk(_valid(s, d, "test"), "model_a_category", "mortality_30d", "model_b_score"))


def tertiles(s, d):
    return _rounded(strata.tertiles_within(_valid(s, d, "test"), "model_a_category", "mortality_30d", "model_b_score"))


def tertile_gradients(s, d):
    order = F.expr("CASE tertile WHEN 'Low' THEN 1 WHEN 'Mid' THEN 2 ELSE 3 END")
    return _rounded(verdicts.gradients(tertiles(s, d), "category", order), 6)


def discordance(s, d):
    return _rounded(strata.discordance(_valid(s, d, "test"), "mortality_30d", "model_a_score", "model_b_score"))


def risk_contrasts(s, d):
    return _rounded(strata.risk_contrasts(strata.discordance(_valid(s, d, "test"), "mortality_30d", "model_a_score", "model_b_score")))


def smoother(s, d):
    return _rounded(strata.smoother(_valid(s, d, "test"), "model_a_score", "model_b_score"))


def risk_surface(s, d):
    return _rounded(strata.risk_surface(_valid(s, d, "test"), "mortality_30d", "model_a_score", "model_b_score"))


def decision_curve(s, d):
    return _rounded(strata.decision_curve(_valid(s, d, "test"), "mortality_30d", "model_b_score"))


def score_distribution(s, d):
    return _rounded(strata.score_distribution(_valid(s, d, "test"), "mortality_30d", "model_a_score"))


def capacity_capture(s, d):
    return _rounded(strata.capacity_capture(_valid(s, d, "test"), "subject_id", "mortality_30d", "model_b_score"))


def min_max(s, d):
    return _rounded(_valid(s, d).select("subject_id", incremental.min_max(_valid(s, d), "model_a_score").alias("p")))


def _measured(s, d):
    e = bind.table(s, d, "embeddings")
    v = {f: F.abs(F.element_at("embedding", k + 1).cast("double")) * (200.0 if f.endswith("_ms") else 1.0) for k, f in enumerate(rulescore.FIELDS)}
    return e, v


def rule_score(s, d):
    e, v = _measured(s, d)
    out = e.select("vec_id", *(x.alias(f"item{k}") for k, x in enumerate(rulescore.items(v), 1)), rulescore.rule_score(v).alias("total"), rulescore.simplified_score(v).alias("simplified"))
    return _rounded(out.withColumn("category", rulescore.category(F.col("total"))))


def cosine_to_centroid(s, d):
    e = bind.table(s, d, "embeddings").where("label IS NOT NULL")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("c"))
    return _rounded(e.join(centre, "label").select("vec_id", rulescore.cosine(F.col("embedding"), F.col("c")).alias("cosine")), 6)


def pad_crop_scale(s, d):
    e = bind.table(s, d, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda p, q: p + q)
    return _rounded(e.select("vec_id", total(rulescore.pad_or_crop(x, 40, "center")).alias("center40"), total(rulescore.pad_or_crop(x, 40, "end")).alias("end40"), total(rulescore.pad_or_crop(x, 70, "start", "edge")).alias("edge70"), total(rulescore.scale_units(x, "mV", "uV")).alias("uv")), 5)


def lead_order(s, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    chunks = F.array(*(F.slice(x, 5 * k + 1, 5) for k in range(12)))
    names = F.array(*map(F.lit, signals.CLINICAL))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda p, q: p + q)
    e = bind.table(s, d, "embeddings").select("vec_id", signals.reorder(chunks, names, signals.CABRERA).alias("leads"))
    return _rounded(e.select("vec_id", *(total(F.get("leads", k)).alias(f"lead{k + 1}") for k in range(12))), 6)


def recordings(s, d):
    """A recording of 4 s at 100 Hz per vector: five equal beats whose waves follow the vector's components. Vectors are dealt to all
    cores first, as a file of some MB would be one task, and drawing and embedding cost thousands of times what reading does."""
    size = F.size("embedding")
    wave = lambda t, at, width: F.greatest(F.lit(0.0), 1.0 - F.abs(t % 80 - at) / float(width))
    part = lambda k: F.abs(F.get("embedding", (F.lit(k) % size)).cast("double"))
    beat = lambda k: F.transform(F.sequence(F.lit(0), F.lit(79)), lambda t: (0.5 + part(k)) * wave(t, 40, 3) - part(k + 12) * wave(t, 36, 2) + (part(k + 24) - 0.1) * wave(t, 60, 8))
    lead = lambda k: F.flatten(F.array_repeat(beat(k), 5))
    tasks = max(int(s.conf.get("spark.sql.shuffle.partitions")), 4 * s.sparkContext.defaultParallelism)
    e = bind.table(s, d, "embeddings").repartition(tasks, "vec_id")
    return e.select("vec_id", F.when(size > 0, F.array(*(lead(k) for k in range(12)))).alias("signal"), F.array(*map(F.lit, signals.CLINICAL)).alias("leads"))


def waveform_score(s, d):
    return _rounded(signals.score_recordings(recordings(s, d), 100, keep=["vec_id"]), 6)


def waveform_embeddings(s, d):
    spec = adapters.Spec("spectrum", "1", dim=16, fs=250, samples=1000)
    return adapters.embed(recordings(s, d), lambda: adapters.SpectrumProjection(16), spec, 100, ["vec_id"])


def recording_images(s, d):
    """Every recording drawn in both layouts: size and digest of each file, and how many pixels are dark."""
    drawn = [images.render(recordings(s, d), ["vec_id"], images.Sheet(layout)).withColumn("layout", F.lit(layout)) for layout in images.LAYOUTS]
    return drawn[0].unionByName(drawn[1]).select("vec_id", "layout", F.octet_length("image").cast("long").alias("bytes"), F.sha2("image", 256).alias("sha256"), "dark", "is_valid", "error")


def failure_summary(s, d):
    return _rounded(synthesis.failure_summary(bind.predictions(s, d)))


def findings(s, d):
    return synthesis.findings(_valid(s, d, "dev"), _valid(s, d, "test"))


def finding_points(s, d):
    return _rounded(synthesis.findings(_valid(s, d, "dev"), _valid(s, d, "test"), replicates=FEW).select("finding", "value"), 6)


def discordant_readings(s, d):
    return _rounded(synthesis.discordant_readings(strata.discordance(_valid(s, d, "test"), "mortality_30d", "model_a_score", "model_b_score")))


def document_quality(s, d):
    docs = bind.table(s, d, "documents").select("doc_id", "lang", "n_chars").join(bind.table(s, d, "labels"), "doc_id")
    return _rounded(metrics.discrimination(docs, ["lang"], "quality", "n_chars"))


def calibration(s, d):
    slope, intercept = metrics.calibration(_valid(s, d, "test"), "mortality_30d", "model_b_score")
    return _rounded(s.createDataFrame([(slope, intercept)], "slope double, intercept double"), 6)


def bootstrap_auroc(s, d):
    reps = bootstrap.discrimination_draws(_valid(s, d, "test"), [], "mortality_30d", ["model_a_score", "model_b_score"])
    return metrics.interval(reps, ["score"], "auroc")


def incremental_information(s, d):
    table, _, _ = incremental.nested_models(_valid(s, d, "dev"), _valid(s, d, "test"), "mortality_30d", "model_a_score", "model_b_score")
    gain, p = incremental.likelihood_ratio(table)
    return _rounded(table.withColumn("lrt", F.lit(gain)).withColumn("p_value", F.lit(p)), 6)


def _gains(s, d, replicates):
    _, scored, _ = incremental.nested_models(_valid(s, d, "dev"), _valid(s, d, "test"), "mortality_30d", "model_a_score", "model_b_score")
    return incremental.gains(scored, "mortality_30d", replicates=replicates)


def incremental_gains(s, d):
    return _gains(s, d, metrics.REPLICATES)


def incremental_gain_points(s, d):
    return _rounded(_gains(s, d, FEW).select("measure", "point"), 6)


def _comparison(s, d, replicates):
    dev, test = _valid(s, d, "dev"), _valid(s, d, "test")
    test = test.withColumn("p_a", incremental.calibrated(dev, test, "model_a_score", "mortality_30d"))
    return bootstrap.compare_models(test, [], "mortality_30d", "model_a_score", "model_b_score", "p_a", "model_b_score", replicates=replicates)


def model_comparison(s, d):
    """The four gains of B over A with their intervals; A's probability is calibrated on dev."""
    return _comparison(s, d, metrics.REPLICATES)


def model_comparison_points(s, d):
    return _rounded(_comparison(s, d, FEW).select("measure", "a", "b", "gain"), 6)


def _performance(s, d, replicates):
    test = _valid(s, d, "test")
    parts = [bootstrap.intervals(test, [], metric, "mortality_30d", "model_b_score", replicates=replicates).select(F.lit(name).alias("measure"), "point", "low", "high") for name, (metric, _, _) in bootstrap.METRICS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def performance_intervals(s, d):
    return _performance(s, d, metrics.REPLICATES)


def performance_points(s, d):
    return _rounded(_performance(s, d, FEW).select("measure", "point"))


def _discordance(s, d, replicates):
    return strata.discordance_intervals(_valid(s, d, "test"), "mortality_30d", "model_a_score", "model_b_score", replicates=replicates)


def discordance_intervals(s, d):
    return _discordance(s, d, metrics.REPLICATES)


def discordance_points(s, d):
    return _rounded(_discordance(s, d, FEW).select("measure", "point"))


def discordance_by_medians(s, d):
    return _rounded(strata.discordance(_valid(s, d, "test"), "mortality_30d", "model_a_score", "model_b_score", a_cut=None))


def decile_calibration(s, d):
    return _rounded(strata.decile_calibration(_valid(s, d, "test"), "mortality_30d", "model_b_score"))


def direction_summary(s, d):
    found = [compared(s, d).select(F.lit(name).alias("analysis"), "delta_auroc") for name, compared in (("horizon", horizon_comparison), ("subgroup", subgroup_comparison))]
    return battery.direction_summary(found[0].unionByName(found[1]), "delta_auroc")


def centroid_probability(s, d):
    """The probability of label < 3 by the cosines to the mean vectors of both outcomes."""
    e = bind.table(s, d, "embeddings").where("label IS NOT NULL").withColumn("y", F.col("label") < 3)
    return _rounded(battery.centroid_probability(e, "vec_id", "embedding", "y"), 6)


def _embedded(s, d):
    bucket = (F.col("vec_id") * 31 + 42) % 10
    e = bind.table(s, d, "embeddings").where("label IS NOT NULL")
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), (F.col("label") < 3).alias("y"), F.when(bucket < 6, "dev").when(bucket < 8, "val").otherwise("test").alias("split"))


def probe_variants(s, d):
    return battery.probe_variants(_embedded(s, d), "embedding", "y")


def probe_variant_intervals(s, d):
    return battery.probe_variant_intervals(_embedded(s, d), "embedding", "y", "vec_id")


def inhospital_24h(s, d):
    return outcomes.inhospital_mortality(bind.records(s, d), bind.admissions(s, d), 24)


_V = "(SELECT * FROM pred WHERE va AND vb)"
_T = "(SELECT * FROM pred WHERE va AND vb AND split = 'test')"
_HORIZONS = " UNION ALL ".join(f"SELECT '{o}' AS h, a, b, {y}::INT AS y FROM {_T}" for y, o in zip(("y30", "y90", "y1"), OUTCOMES, strict=True))
_SUBGROUPS = f"SELECT * FROM (SELECT unnest([CASE WHEN anchor_age < 65 THEN '<65' ELSE '>=65' END, gender]) AS h, a, b, y30::INT AS y FROM {_T} t JOIN pat USING (subject_id)) QUALIFY count(*) OVER (PARTITION BY h) >= 5"
_INDEXED = f"SELECT 'earliest' AS h, a, b, y30::INT AS y FROM {_T} t SEMI JOIN rec USING (subject_id) UNION ALL SELECT 'admission', a, b, y30::INT FROM {_T} t SEMI JOIN (SELECT subject_id FROM rec JOIN adm USING (subject_id) WHERE ecg_datetime BETWEEN admit_dt AND disch_dt) l USING (subject_id)"
_items = [f"abs(embedding[{k + 1}]::DOUBLE)" + (" * 200" if f.endswith("_ms") else "") + f" AS {f}" for k, f in enumerate(rulescore.FIELDS)]
_SUMMARY = ", ".join(f"round(avg({c}), 8) AS mean_{n}, round(stddev_pop({c}), 8) AS sd_{n}" for c, n in (("a", "a"), ("b", "b"), ("lo", "log_odds_b"))) + "".join(f", round(quantile_cont({c}, {q / 100}), 8) AS q{q}_{c}" for c in "ab" for q in (25, 50, 75))
_LOSS = "round(-avg(y30::INT * ln(b) + (1 - y30::INT) * ln(1 - b)), 8) AS log_loss, round(avg(pow(b - y30::INT, 2)), 8) AS brier"

_BATTERY_ROWS = f"""fi AS (SELECT subject_id, study_id, ecg_datetime FROM rec QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY ecg_datetime, study_id) = 1),
ih AS (SELECT subject_id, coalesce(flag = 1 AND (death_dt IS NULL OR ecg_datetime <= death_dt), false)::INT AS y FROM fi JOIN adm USING (subject_id) WHERE ecg_datetime BETWEEN admit_dt AND disch_dt QUALIFY row_number() OVER (PARTITION BY study_id ORDER BY admit_dt, hadm_id) = 1),
rows4 AS (SELECT 'inhospital_mortality' AS h, split, a, b, y FROM {_V} v JOIN ih USING (subject_id) UNION ALL {' UNION ALL '.join(f"SELECT '{o}', split, a, b, {y}::INT FROM {_V} v" for y, o in zip(("y30", "y90", "y1"), OUTCOMES, strict=True))})"""
#: Newton's method on dev as a recursive query: k counts the steps, the weights' penalty is 1.
_NEWTON = """f1(h, k, c0, c1) AS (SELECT DISTINCT h, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM rows4 WHERE split = 'dev' UNION ALL
  SELECT h, k + 1, c0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), c1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
    SELECT h, k, c0, c1, sum(p - y) AS g0, sum((p - y) * a) + c1 AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * a) AS h01, sum(p * (1 - p) * a * a) + 1 AS h11 FROM (
      SELECT f1.h, k, c0, c1, a, y, 1 / (1 + exp(-(c0 + c1 * a))) AS p FROM f1 JOIN rows4 r ON r.h = f1.h AND split = 'dev' WHERE k < 25) GROUP BY h, k, c0, c1)),
f2(h, k, c0, c1, c2) AS (SELECT DISTINCT h, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM rows4 WHERE split = 'dev' UNION ALL
  SELECT h, k + 1, c0 - (g0 * (m11 * m22 - m12 * m12) - m01 * (g1 * m22 - m12 * g2) + m02 * (g1 * m12 - m11 * g2)) / det, c1 - (m00 * (g1 * m22 - m12 * g2) - g0 * (m01 * m22 - m12 * m02) + m02 * (m01 * g2 - g1 * m02)) / det,
    c2 - (m00 * (m11 * g2 - g1 * m12) - m01 * (m01 * g2 - g1 * m02) + g0 * (m01 * m12 - m11 * m02)) / det FROM (
    SELECT *, m00 * (m11 * m22 - m12 * m12) - m01 * (m01 * m22 - m12 * m02) + m02 * (m01 * m12 - m11 * m02) AS det FROM (
      SELECT h, k, c0, c1, c2, sum(p - y) AS g0, sum((p - y) * a) + c1 AS g1, sum((p - y) * b) + c2 AS g2, sum(w) AS m00, sum(w * a) AS m01, sum(w * b) AS m02, sum(w * a * a) + 1 AS m11, sum(w * a * b) AS m12, sum(w * b * b) + 1 AS m22 FROM (
        SELECT *, p * (1 - p) AS w FROM (SELECT f2.h, k, c0, c1, c2, a, b, y, 1 / (1 + exp(-(c0 + c1 * a + c2 * b))) AS p FROM f2 JOIN rows4 r ON r.h = f2.h AND split = 'dev' WHERE k < 25)) GROUP BY h, k, c0, c1, c2))),
e1 AS (SELECT * FROM f1 WHERE k = 25), e2 AS (SELECT * FROM f2 WHERE k = 25),
lk AS (SELECT r.h, greatest(2 * (sum(y * ln(p2) + (1 - y) * ln(1 - p2)) - sum(y * ln(p1) + (1 - y) * ln(1 - p1))), 0) AS lrt FROM (
  SELECT r.h, y, 1 / (1 + exp(-(e1.c0 + e1.c1 * a))) AS p1, 1 / (1 + exp(-(e2.c0 + e2.c1 * a + e2.c2 * b))) AS p2 FROM rows4 r JOIN e1 ON e1.h = r.h JOIN e2 ON e2.h = r.h WHERE split = 'dev') r GROUP BY r.h),
br AS (SELECT r.h, avg(pow(1 / (1 + exp(-(c0 + c1 * a))) - y, 2)) AS ba, avg(pow(b - y, 2)) AS bb FROM rows4 r JOIN e1 ON e1.h = r.h WHERE split = 'test' GROUP BY r.h)"""


def _newton_sql(name: str, rows: str, xs: list[str], penalty: float = 1e-9, steps: int = 25) -> str:
    """A recursive query name(k, c0, c1, ...): Newton's method for a logistic regression of rows' y on xs; each step's equations are solved by elimination."""
    n = len(xs) + 1
    x, cs = ["1.0::DOUBLE", *xs], ", ".join(f"c{i}" for i in range(n))
    q = f"SELECT {name}.*, {', '.join([*xs, 'y'])}, 1 / (1 + exp(-({' + '.join(f'c{i} * {v}' for i, v in enumerate(x))}))) AS p FROM {name} CROSS JOIN {rows} WHERE k < {steps}"
    sums = [f"sum((p - y) * {x[i]}) + {penalty if i else 0.0!r}::DOUBLE * c{i} AS r{i}" for i in range(n)]
    sums += [f"sum(p * (1 - p) * {x[i]} * {x[j]}) + {penalty if i == j and i else 0.0!r}::DOUBLE AS m{i}_{j}" for i in range(n) for j in range(i, n)]
    q = f"SELECT k, {cs}, {', '.join(sums)} FROM ({q}) GROUP BY k, {cs}"
    for t in range(n - 1):
        less = [f"r{i} - m{t}_{i} / m{t}_{t} * r{t} AS r{i}" for i in range(t + 1, n)]
        less += [f"m{i}_{j} - m{t}_{i} / m{t}_{t} * m{t}_{j} AS m{i}_{j}" for i in range(t + 1, n) for j in range(i, n)]
        q = f"SELECT * REPLACE ({', '.join(less)}) FROM ({q})"
    for i in reversed(range(n)):
        q = f"SELECT *, ({' - '.join([f'r{i}', *(f'm{i}_{j} * d{j}' for j in range(i + 1, n))])}) / m{i}_{i} AS d{i} FROM ({q})"
    return f"{name}(k, {cs}) AS (SELECT 0, {', '.join(['0.0::DOUBLE'] * n)} UNION ALL SELECT k + 1, {', '.join(f'c{i} - d{i}' for i in range(n))} FROM ({q})), {name}_end AS (SELECT * FROM {name} WHERE k = {steps})"


def _chance_sql(fit: str, xs: list[str]) -> str:
    return f"least(greatest(1 / (1 + exp(-({' + '.join([f'{fit}_end.c0', *(f'{fit}_end.c{i + 1} * {v}' for i, v in enumerate(xs))])}))), 1e-15), 1 - 1e-15)"


_LOSSES = "-avg(y * ln(p) + (1 - y) * ln(1 - p))"
#: The nested models: a row per row of dev and test and model, with its probability p.
_NESTED_XS = {"A": ("fa", ["z", "z2"]), "B": ("fb", ["b"]), "A+B": ("fab", ["z", "z2", "b"])}
_NESTED = f"""ms AS (SELECT avg(a) AS m, greatest(stddev_pop(a), 1e-12) AS sd FROM {_V} v WHERE split = 'dev'), zs AS (SELECT split, (a - m) / sd AS z, pow((a - m) / sd, 2) AS z2, b, y30::INT AS y FROM {_V} v, ms),
dv AS (SELECT * FROM zs WHERE split = 'dev'), {', '.join(_newton_sql(fit, 'dv', xs) for fit, xs in _NESTED_XS.values())},
mp AS ({' UNION ALL '.join(f"SELECT '{m}' AS model, {len(xs) + 1} AS parameters, split, y, {_chance_sql(fit, xs)} AS p FROM zs, {fit}_end" for m, (fit, xs) in _NESTED_XS.items())}),
nr AS (WITH {_rank_sql("SELECT model, p AS s, y FROM mp WHERE split = 'test'", 'model')} SELECT g AS model, max_by(auroc, 1) AS auroc FROM r GROUP BY g),
nl AS (SELECT model, any_value(parameters) AS parameters, count(*) AS n, sum(y * ln(p) + (1 - y) * ln(1 - p)) AS ll FROM mp WHERE split = 'dev' GROUP BY model),
nt AS (SELECT model, {_LOSSES} AS log_loss, avg(pow(p - y, 2)) AS brier FROM mp WHERE split = 'test' GROUP BY model)"""
_GAIN = "(SELECT auroc FROM nr WHERE model = 'A+B') - (SELECT auroc FROM nr WHERE model = 'A')"
#: Areas of B and A by raw scores, and losses of B's probability and of A's, which is fitted on dev.
_COMPARED = f"""da AS (SELECT a, y30::INT AS y FROM {_V} v WHERE split = 'dev'), {_newton_sql('fc', 'da', ['a'])},
cp AS (SELECT a, b, y30::INT AS y, {_chance_sql('fc', ['a'])} AS pa FROM {_T} t, fc_end), cr AS (WITH {_rank_sql("SELECT 'a' AS which, a AS s, y FROM cp UNION ALL SELECT 'b', b, y FROM cp", 'which')} SELECT * FROM r),
cl AS (SELECT which, avg(pow(p - y, 2)) AS brier, {_LOSSES} AS log_loss FROM (SELECT 'a' AS which, y, pa AS p FROM cp UNION ALL SELECT 'b', y, b FROM cp) GROUP BY which),
cm AS ({' UNION ALL '.join(f"SELECT '{m}' AS measure, max(CASE WHEN {k} = 'a' THEN {m} END) AS a, max(CASE WHEN {k} = 'b' THEN {m} END) AS b, {sign} AS up FROM {t}" for m, k, t, sign in (('auroc', 'g', 'cr', 1), ('auprc', 'g', 'cr', 1), ('brier', 'which', 'cl', -1), ('log_loss', 'which', 'cl', -1)))})"""
#: Counts and rates of the quadrants beside each other.
_QUADRANTS = f"""tq AS {_T}, cq AS (SELECT quantile_cont(b, 0.5) AS m FROM tq), qd AS (SELECT avg(y30::INT) FILTER (a < 15 AND b < m) AS ll, avg(y30::INT) FILTER (a < 15 AND b >= m) AS lh, avg(y30::INT) FILTER (a >= 15 AND b < m) AS hl, avg(y30::INT) FILTER (a >= 15 AND b >= m) AS hh,
count(*) FILTER (a < 15 AND b >= m) / count(*) AS share FROM tq, cq)"""
_GRADIENTS = f"""gq AS (SELECT cat, quantile_cont(b, 0.3333333333333333) AS c1, quantile_cont(b, 0.6666666666666666) AS c2 FROM {_T} GROUP BY cat HAVING count(*) >= 3),
gk AS (SELECT cat, CASE WHEN b < c1 THEN 1 WHEN b < c2 THEN 2 ELSE 3 END AS k, avg(y30::INT) AS rate FROM {_T} t JOIN gq USING (cat) GROUP BY ALL),
gm AS (SELECT avg(CASE WHEN f = 0 AND l > 0 THEN 3 WHEN f = 0 THEN 1 ELSE l / f END) AS ratio FROM (SELECT arg_min(rate, k) AS f, arg_max(rate, k) AS l FROM gk GROUP BY cat))"""
#: name -> (query, SQL or None)
_RULES = f"""m AS (SELECT vec_id, {', '.join(_items)} FROM embeddings),
i AS (SELECT vec_id, (CASE WHEN avl_q_ms <= 0 THEN 5 WHEN avl_q_ms <= 15 THEN 1 WHEN avl_q_ms <= 25 THEN 3 WHEN avl_q_ms <= 35 THEN 9 WHEN avl_q_ms <= 45 THEN 10 ELSE 12 END)::DOUBLE AS item1,
(CASE WHEN avl_t_neg > 0.025::DOUBLE THEN 3 + 23.0::DOUBLE * avl_t_neg WHEN avl_t_pos <= 0.05::DOUBLE OR avl_t_pos > 0.3::DOUBLE THEN 3 ELSE 0 END)::DOUBLE AS item2, (CASE WHEN avr_r * 10 < 5 THEN -avr_r * 10 ELSE 0 END)::DOUBLE AS item3,
(CASE WHEN avr_t_pos * 10 <= 0.5::DOUBLE THEN 6 WHEN avr_t_pos * 10 <= 1.5::DOUBLE THEN 3 WHEN avr_t_pos * 10 <= 2.5::DOUBLE THEN 0 WHEN avr_t_pos * 10 <= 3.5::DOUBLE THEN -2 WHEN avr_t_pos * 10 <= 4.5::DOUBLE THEN -5 ELSE -5 - 2.0::DOUBLE * (avr_t_pos * 10 - 4) END)::DOUBLE AS item4,
{', '.join(f"(CASE WHEN {c} THEN {p} ELSE 0 END)::DOUBLE AS item{k}" for k, c, p in ((5, 'greatest(ii_qr, avf_qr) >= 0.25', 12), (6, 'greatest(iii_q_ms, avl_q_ms) >= 40', 5), (7, 'iii_t_neg > 0.1::DOUBLE', 7), (8, 'v1_t_pos > 0.2::DOUBLE', 5), (9, 'v2_r < 0.3::DOUBLE OR v2_r > 1.4::DOUBLE', 5), (10, 'v2_t_neg >= 0.025::DOUBLE', 5), (11, 'v3_qr > 0.05::DOUBLE', 9), (12, 'v5_s < 0.2::DOUBLE', 5)))} FROM m),
t AS (SELECT *, {' + '.join(f'item{k}' for k in range(1, 13))} AS tot FROM i)"""
REGISTRY = {
    "age_at_recording": (age_at_recording, f"WITH {_RECORDS}, {_PATIENTS}, {_AGED} SELECT subject_id, study_id, ecg_year, anchor_age, age_at_ecg FROM aged"),
    "adult_records": (adult_records, f"WITH {_RECORDS}, {_PATIENTS}, {_AGED} SELECT subject_id, study_id, age_at_ecg FROM aged WHERE age_at_ecg >= 18"),
    "link_0h": (link_0h, f"WITH {_RECORDS}, {_ADMISSIONS} SELECT subject_id, study_id, hadm_id FROM rec JOIN adm USING (subject_id) WHERE ecg_datetime BETWEEN admit_dt AND disch_dt"),
    "link_24h_stays": (link_24h_stays, f"WITH {_STAYS} SELECT subject_id, study_id, hadm_id FROM vw JOIN stay USING (subject_id) WHERE ecg_datetime BETWEEN admit_dt - INTERVAL 24 HOUR AND disch_dt"),
    "index_earliest": (index_earliest, f"WITH {_RECORDS} SELECT subject_id, study_id FROM rec QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY ecg_datetime, study_id) = 1"),
    "index_latest": (index_latest, f"WITH {_RECORDS} SELECT subject_id, study_id FROM rec QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY ecg_datetime DESC, study_id DESC) = 1"),
    "linkage_statistics": (linkage_statistics, f"""WITH {_STAYS}, {_PATIENTS}, per AS (SELECT count(*) AS n FROM vw GROUP BY subject_id), grown AS (SELECT vw.* FROM vw JOIN pat USING (subject_id) WHERE anchor_age + year(ecg_datetime) - anchor_year >= 18),
l0 AS (SELECT DISTINCT study_id, subject_id FROM vw JOIN stay USING (subject_id) WHERE ecg_datetime BETWEEN admit_dt AND disch_dt), l24 AS (SELECT DISTINCT study_id, subject_id FROM vw JOIN stay USING (subject_id) WHERE ecg_datetime BETWEEN admit_dt - INTERVAL 24 HOUR AND disch_dt)
SELECT (SELECT count(*) FROM vw) AS total_records, (SELECT count(DISTINCT subject_id) FROM vw) AS total_subjects, (SELECT count(DISTINCT study_id) FROM vw) AS total_studies, (SELECT count(*) FROM vw SEMI JOIN pat USING (subject_id)) AS linked_records,
(SELECT count(DISTINCT subject_id) FROM vw SEMI JOIN pat USING (subject_id)) AS linked_subjects, round((SELECT avg(n) FROM per), 8) AS mean_per_subject, (SELECT quantile_cont(n, 0.5) FROM per)::DOUBLE AS median_per_subject, (SELECT min(n) FROM per) AS min_per_subject, (SELECT max(n) FROM per) AS max_per_subject,
(SELECT count(DISTINCT study_id) FROM l0) AS records_within_0h, (SELECT count(DISTINCT subject_id) FROM l0) AS subjects_within_0h, (SELECT count(DISTINCT study_id) FROM l24) AS records_within_24h, (SELECT count(DISTINCT subject_id) FROM l24) AS subjects_within_24h,
(SELECT count(*) FROM grown) AS adult_records, (SELECT count(DISTINCT subject_id) FROM grown) AS adult_subjects, (SELECT count(DISTINCT subject_id) FROM grown) AS index_adult_records, (SELECT count(DISTINCT subject_id) FROM vw SEMI JOIN stay USING (subject_id)) AS subjects_with_admissions,
round(100.0::DOUBLE * (SELECT count(DISTINCT subject_id) FROM vw SEMI JOIN pat USING (subject_id)) / (SELECT count(DISTINCT subject_id) FROM vw), 8) AS linked_subject_percent, round(100.0::DOUBLE * (SELECT count(*) FROM vw SEMI JOIN pat USING (subject_id)) / (SELECT count(*) FROM vw), 8) AS linked_record_percent,
round(100.0::DOUBLE * (SELECT count(DISTINCT subject_id) FROM vw SEMI JOIN stay USING (subject_id)) / (SELECT count(DISTINCT subject_id) FROM vw), 8) AS subjects_with_admissions_percent"""),
    "death_table": (death_table, f"WITH {_RECORDS}, {_PATIENTS}, {_ADMISSIONS}, {_DEATH} SELECT subject_id, dod_date::VARCHAR AS dod_date, first_hosp_death_dt::VARCHAR AS first_hosp_death_dt, last_disch_dt::VARCHAR AS last_disch_dt, in_hosp_death_flag FROM dt"),
    "mortality_outcomes": (mortality_outcomes, f"""WITH {_RECORDS}, {_PATIENTS}, {_AGED}, {_ADMISSIONS}, {_DEATH}, {_OUT} SELECT subject_id, study_id, round(days_to_death, 8) AS days_to_death, round(activity_followup_days, 8) AS activity_followup_days, is_valid,
CASE WHEN NOT is_valid THEN '{outcomes.AFTER_DEATH}' END AS exclusion_reason, m30 AS mortality_30d, m90 AS mortality_90d, m1 AS mortality_1yr, {', '.join(f"CASE WHEN is_valid THEN CASE WHEN {m} THEN round(days_to_death, 8) ELSE {h}::DOUBLE END END AS time_to_{n}_days" for m, (n, h) in zip(('m30', 'm90', 'm1'), outcomes.HORIZONS, strict=True))} FROM o3"""),
    "inhospital_mortality": (inhospital_mortality, f"""WITH {_RECORDS}, {_ADMISSIONS} {_FIRST_STAY} SELECT study_id, in_hospital_mortality, linked_hadm_id FROM rec LEFT JOIN fst USING (study_id)"""),
    "outcome_statistics": (outcome_statistics, f"""WITH {_RECORDS}, {_PATIENTS}, {_AGED}, {_ADMISSIONS}, {_DEATH}, {_OUT}{_FIRST_STAY_AGED} SELECT count(*) AS total_records, count(*) FILTER (is_valid) AS valid_records, count(*) FILTER (NOT is_valid) AS invalid_records, count(*) FILTER (is_valid AND days_to_death IS NOT NULL) AS deaths, round(100.0::DOUBLE * count(*) FILTER (NOT is_valid) / count(*), 8) AS invalid_percent,
(SELECT count(in_hospital_mortality) FROM fst) AS inhospital_evaluable, (SELECT count(*) FILTER (in_hospital_mortality) FROM fst) AS inhospital_events, round((SELECT avg(in_hospital_mortality::INT) FROM fst), 8) AS inhospital_rate,
{', '.join(f"count(*) FILTER ({m}) AS events_{n}, round(avg({m}::INT), 8) AS rate_{n}" for m, n in (('m30', '30d'), ('m90', '90d'), ('m1', '1yr')))} FROM o3"""),
    "attrition": (attrition, f"""WITH {_RECORDS}, {_PATIENTS}, {_AGED}, {_ADMISSIONS}, {_DEATH}, {_OUT}, ok AS (SELECT * FROM o3 WHERE is_valid AND age_at_ecg >= 18),
f AS (SELECT 0 AS step, 'all' AS name, count(*) AS records, count(DISTINCT subject_id) AS subjects FROM rec UNION ALL SELECT 1, 'linked', count(*), count(DISTINCT subject_id) FROM aged UNION ALL SELECT 2, 'adult', count(*), count(DISTINCT subject_id) FROM aged WHERE age_at_ecg >= 18
UNION ALL SELECT 3, 'valid', count(*), count(DISTINCT subject_id) FROM ok UNION ALL SELECT 4, 'index', count(DISTINCT subject_id), count(DISTINCT subject_id) FROM ok)
SELECT *, coalesce(lag(records) OVER (ORDER BY step) - records, 0) AS excluded_records, coalesce(lag(subjects) OVER (ORDER BY step) - subjects, 0) AS excluded_subjects FROM f"""),
    "split_hashed": (split_hashed, "SELECT DISTINCT o_custkey AS subject_id, CASE WHEN (o_custkey % 1000003 * 7919 + 42) % 10000 < 6000 THEN 'dev' WHEN (o_custkey % 1000003 * 7919 + 42) % 10000 < 8000 THEN 'val' ELSE 'test' END AS split FROM orders"),
    "split_overlap": (split_overlap, "SELECT DISTINCT o_custkey AS subject_id, 2::BIGINT AS splits FROM orders WHERE o_custkey % 97 = 0"),
    "split_summary": (split_summary, f"WITH {_PRED} SELECT split, count(*) AS records, count(DISTINCT subject_id) AS subjects, {', '.join(f'count(*) FILTER ({y}) AS events_{o}, round(avg({y}::INT), 8) AS rate_{o}' for y, o in zip(('y30', 'y90', 'y1'), OUTCOMES, strict=True))} FROM pred GROUP BY split"),
    "prediction_summary": (prediction_summary, f"WITH {_PRED}, {_rank_sql(f'SELECT split, b AS s, y30::INT AS y FROM {_V}', 'split')} SELECT split, n, mean_a, sd_a, q25_a, q50_a, q75_a, mean_b, sd_b, q25_b, q50_b, q75_b, mean_log_odds_b, sd_log_odds_b, auroc, auprc, log_loss, brier FROM (SELECT split, count(*) AS n, {_SUMMARY}, {_LOSS} FROM {_V} GROUP BY split) JOIN r ON g = split"),
    "category_counts": (category_counts, f"WITH {_PRED} SELECT split, cat AS category, count(*) AS n FROM pred GROUP BY ALL"),
    "proper_scores": (proper_scores, f"WITH {_PRED} SELECT split, count(*) AS n, count(*) FILTER (y30) AS events, {_LOSS} FROM {_V} GROUP BY split"),
    "discrimination": (discrimination, f"WITH {_PRED}, {_rank_sql(f'SELECT split, b AS s, y30::INT AS y FROM {_V}', 'split')} SELECT g AS split, auroc, auprc FROM r"),
    "correlations": (correlations, f"WITH {_PRED}, k AS (SELECT *, rank() OVER (PARTITION BY split ORDER BY a) + (count(*) OVER (PARTITION BY split, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY split ORDER BY b) + (count(*) OVER (PARTITION BY split, b) - 1) / 2.0::DOUBLE AS rb FROM {_V}) SELECT split, count(*) AS n, round(corr(a, b), 8) AS pearson, round(corr(ra, rb), 8) AS spearman FROM k GROUP BY split"),
    "horizon_sensitivity": (horizon_sensitivity, f"WITH {_PRED}, {_rank_sql(' UNION ALL '.join(f'''SELECT '{o}' AS h, b AS s, {y}::INT AS y FROM {_T}''' for y, o in zip(('y30', 'y90', 'y1'), OUTCOMES, strict=True)), 'h')} SELECT g AS horizon, auroc, auprc FROM r"),
    "score_comparison": (score_comparison, f"""WITH {_PRED}, {_RULES}, alt AS (SELECT p.a, p.b, p.y30::INT AS y, tot, item1 + item5 + item10 + item12 AS sim FROM {_T} p JOIN t ON vec_id = subject_id),
lng AS ({' UNION ALL '.join(f"SELECT '{m}' AS h, {x} AS s, b, y FROM alt" for x, m in (('a', 'model_a_score'), ('tot', 'rule_score'), ('sim', 'simplified_score')))}),
{_rank_sql("SELECT h, s, y FROM lng UNION ALL SELECT 'b', b, y FROM alt", 'h')}, u AS (SELECT g, CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(neg * (tp - pos / 2)) / (max(p) * max(n)) ELSE 0.5 END AS auc FROM w GROUP BY g),
k AS (SELECT h, rank() OVER (PARTITION BY h ORDER BY s) + (count(*) OVER (PARTITION BY h, s) - 1) / 2.0::DOUBLE AS rs, rank() OVER (PARTITION BY h ORDER BY b) + (count(*) OVER (PARTITION BY h, b) - 1) / 2.0::DOUBLE AS rb FROM lng),
c AS (SELECT h, round(corr(rs, rb), 8) AS spearman_b FROM k GROUP BY h)
SELECT r.g AS model, r.auroc, r.auprc, c.spearman_b, round((SELECT auc FROM u WHERE g = 'b') - u.auc, 8) AS delta_auroc FROM r JOIN c ON c.h = r.g JOIN u ON u.g = r.g"""),
    "subgroups": (subgroups, f"WITH {_PRED}, {_PATIENTS}, sg AS (SELECT unnest([CASE WHEN anchor_age < 65 THEN '<65' ELSE '>=65' END, gender]) AS h, b AS s, y30::INT AS y FROM {_T} t JOIN pat USING (subject_id)), {_rank_sql('SELECT * FROM sg', 'h')} SELECT g AS subgroup, auroc, auprc, n FROM r JOIN (SELECT h, count(*) AS n FROM sg GROUP BY h HAVING count(*) >= 5) ON h = g"),
    "anchoring_sensitivity": (anchoring_sensitivity, f"WITH {_RECORDS}, {_ADMISSIONS}, {_PRED}, {_rank_sql('''SELECT 'all' AS h, b AS s, y30::INT AS y FROM pred WHERE vb UNION ALL SELECT 'joint', b, y30::INT FROM pred WHERE va AND vb UNION ALL SELECT 'anchored', b, y30::INT FROM pred WHERE vb AND subject_id IN (SELECT subject_id FROM rec JOIN adm USING (subject_id) WHERE ecg_datetime BETWEEN admit_dt AND disch_dt)''', 'h')} SELECT g AS cohort, auroc, auprc FROM r"),
    "horizon_comparison": (horizon_comparison, f"WITH {_PRED}, {_compare_sql(_HORIZONS, 'horizon')}"),
    "horizon_comparison_intervals": (horizon_comparison_intervals, None),
    "horizon_battery": (horizon_battery, f"""WITH RECURSIVE {_RECORDS}, {_ADMISSIONS}, {_PRED}, {_BATTERY_ROWS}, {_NEWTON}, cm AS (WITH {_compare_sql("SELECT h, a, b, y FROM rows4 WHERE split = 'test'", 'horizon').replace(', 8)', ', 6)')})
SELECT cm.*, round(ba, 6) AS brier_a, round(bb, 6) AS brier_b, round(ba - bb, 6) AS delta_brier, round(lrt, 4) AS lrt FROM cm JOIN br ON br.h = horizon JOIN lk ON lk.h = horizon"""),
    "horizon_battery_intervals": (horizon_battery_intervals, None),
    "subgroup_comparison": (subgroup_comparison, f"WITH {_PRED}, {_PATIENTS}, {_compare_sql(_SUBGROUPS, 'subgroup')}"),
    "subgroup_comparison_intervals": (subgroup_comparison_intervals, None),
    "subgroup_contrasts": (subgroup_contrasts, None),
    "admission_anchoring": (admission_anchoring, f"WITH {_RECORDS}, {_ADMISSIONS}, {_PRED}, {_compare_sql(_INDEXED, 'cohort')}"),
    "admission_anchoring_intervals": (admission_anchoring_intervals, None),
    "stratified_risk": (stratified_risk, f"WITH {_PRED}, {_rank_sql(f'SELECT cat, b AS s, y30::INT AS y FROM {_T}', 'cat')} SELECT c.category, count(t.cat) AS n, coalesce(sum(y30::INT), 0)::BIGINT AS events, round(coalesce(avg(y30::INT), 0), 8) AS rate, round(avg(b), 8) AS mean_b, round(stddev_pop(b), 8) AS sd_b, round(quantile_cont(b, 0.25), 8) AS q25_b, round(quantile_cont(b, 0.5), 8) AS median_b, round(quantile_cont(b, 0.75), 8) AS q75_b, CASE WHEN sum(y30::INT) > 0 AND sum(y30::INT) < count(t.cat) THEN any_value(r.auroc) END AS auroc, CASE WHEN sum(y30::INT) > 0 AND sum(y30::INT) < count(t.cat) THEN any_value(r.auprc) END AS auprc FROM (SELECT unnest({list(strata.CATEGORIES)}) AS category) c LEFT JOIN {_T} t ON t.cat = c.category LEFT JOIN r ON r.g = c.category GROUP BY c.category"),
    "tertiles": (tertiles, f"WITH {_PRED}, q AS (SELECT cat, quantile_cont(b, 0.3333333333333333) AS c1, quantile_cont(b, 0.6666666666666666) AS c2 FROM {_T} GROUP BY cat HAVING count(*) >= 3) SELECT q.cat AS category, l.tertile, count(t.b) AS n, coalesce(sum(y30::INT), 0)::BIGINT AS events, round(coalesce(avg(y30::INT), 0), 8) AS rate FROM q CROSS JOIN (VALUES ('Low'), ('Mid'), ('High')) l(tertile) LEFT JOIN {_T} t ON t.cat = q.cat AND l.tertile = CASE WHEN t.b < c1 THEN 'Low' WHEN t.b < c2 THEN 'Mid' ELSE 'High' END GROUP BY ALL"),
    "tertile_gradients": (tertile_gradients, f"WITH {_PRED}, q AS (SELECT cat, quantile_cont(b, 0.3333333333333333) AS c1, quantile_cont(b, 0.6666666666666666) AS c2 FROM {_T} GROUP BY cat), r AS (SELECT cat AS category, CASE WHEN b < c1 THEN 'Low' WHEN b < c2 THEN 'Mid' ELSE 'High' END AS tertile, count(*) AS n, sum(y30::INT)::BIGINT AS events, round(avg(y30::INT), 8) AS rate FROM {_T} t JOIN q USING (cat) GROUP BY ALL), o AS (SELECT *, CASE tertile WHEN 'Low' THEN 1 WHEN 'Mid' THEN 2 ELSE 3 END AS k FROM r), e AS (SELECT category, arg_min(rate, k) AS f, arg_max(rate, k) AS l FROM o GROUP BY 1), x AS (SELECT category, f = 0 AND l > 0 AS infinite, CASE WHEN f = 0 AND l > 0 THEN 3.0::DOUBLE WHEN f = 0 THEN 1.0::DOUBLE ELSE l / f END AS ratio FROM e) SELECT category, round(ratio, 6) AS ratio, infinite, ratio >= 1.5::DOUBLE AS meaningful FROM x"),
    "discordance": (discordance, f"WITH {_PRED}, t AS {_T}, c AS (SELECT quantile_cont(b, 0.5) AS m FROM t) SELECT 'A-' || CASE WHEN a >= 15 THEN 'high' ELSE 'low' END || '/B-' || CASE WHEN b >= m THEN 'high' ELSE 'low' END AS quadrant, count(*) AS n, sum(y30::INT)::BIGINT AS events, round(avg(y30::INT), 8) AS rate FROM t, c GROUP BY ALL"),
    "risk_contrasts": (risk_contrasts, f"WITH {_PRED}, t AS {_T}, c AS (SELECT quantile_cont(b, 0.5) AS m FROM t), x AS (SELECT avg(y30::INT) FILTER (a < 15 AND b < m) AS ll, avg(y30::INT) FILTER (a < 15 AND b >= m) AS lh, avg(y30::INT) FILTER (a >= 15 AND b < m) AS hl, avg(y30::INT) FILTER (a >= 15 AND b >= m) AS hh FROM t, c) SELECT round(lh - ll, 8) AS rd_a_low, round(CASE WHEN ll > 0 THEN lh / ll ELSE 1 END, 8) AS rr_a_low, round(hh - hl, 8) AS rd_a_high FROM x"),
    "smoother": (smoother, f"WITH {_PRED}, t AS {_T}, m AS (SELECT min(a) AS lo, max(a) AS hi, greatest((max(a) - min(a)) / 12.5::DOUBLE, 1) AS w FROM t), g AS (SELECT lo + (hi - lo) * k / 24 AS x, w FROM m, range(25) r(k)) SELECT round(x, 8) AS x, round(sum(exp(-0.5::DOUBLE * pow((a - x) / w, 2)) * b) / sum(exp(-0.5::DOUBLE * pow((a - x) / w, 2))), 8) AS expected_b FROM t, g GROUP BY x"),
    "risk_surface": (risk_surface, f"""WITH {_PRED}, t AS {_T}, e AS (SELECT list_sort(list_distinct(quantile_cont(a, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS ea, list_sort(list_distinct(quantile_cont(b, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS eb FROM t),
x AS (SELECT len(list_filter(ea[2:-2], lambda x: x <= a))::INT AS a_bin, len(list_filter(eb[2:-2], lambda x: x <= b))::INT AS b_bin, count(*) AS n, sum(y30::INT)::BIGINT AS events, round(avg(y30::INT), 8) AS rate FROM t, e GROUP BY ALL),
ga AS (SELECT unnest(range(greatest(1, len(ea) - 1)))::INT AS a_bin FROM e), gb AS (SELECT unnest(range(greatest(1, len(eb) - 1)))::INT AS b_bin FROM e)
SELECT a_bin, b_bin, coalesce(n, 0) AS n, coalesce(events, 0) AS events, rate FROM ga CROSS JOIN gb LEFT JOIN x USING (a_bin, b_bin)"""),
    "decision_curve": (decision_curve, f"WITH {_PRED}, s AS (SELECT h AS threshold, h / (1 - h) AS odds, count(*) AS n, count(*) FILTER (b >= h AND y30) AS tp, count(*) FILTER (b >= h AND NOT y30) AS fp, count(*) FILTER (y30) AS e FROM {_T} t, (SELECT unnest({list(strata.THRESHOLDS)})::DOUBLE AS h) GROUP BY h) SELECT threshold, round(tp / n - fp / n * odds, 8) AS net_benefit, round(e / n - (n - e) / n * odds, 8) AS treat_all FROM s"),
    "score_distribution": (score_distribution, f"WITH {_PRED} SELECT y30::INT AS outcome, count(*) AS n, round(avg(a), 8) AS mean, round(stddev_pop(a), 8) AS sd, round(quantile_cont(a, 0.25), 8) AS q25, round(quantile_cont(a, 0.5), 8) AS median, round(quantile_cont(a, 0.75), 8) AS q75 FROM {_T} GROUP BY ALL"),
    "capacity_capture": (capacity_capture, f"WITH {_PRED}, k AS (SELECT *, row_number() OVER (ORDER BY b DESC, subject_id) AS r, count(*) OVER () AS n, count(*) FILTER (y30) OVER () AS e FROM {_T}) SELECT h AS share, count(*) FILTER (r <= ceil(h * n)) AS flagged, count(*) FILTER (r <= ceil(h * n) AND y30) AS captured, round(captured / any_value(e), 8) AS sensitivity, round(captured / flagged, 8) AS ppv FROM k, (SELECT unnest([0.01, 0.025, 0.05, 0.1, 0.2])::DOUBLE AS h) GROUP BY h"),
    "min_max": (min_max, f"WITH {_PRED} SELECT subject_id, round((a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()), 8) AS p FROM {_V}"),
    "rule_score": (rule_score, f"""WITH {_RULES}
SELECT vec_id, {', '.join(f'round(item{k}, 8) AS item{k}' for k in range(1, 13))}, round(tot, 8) AS total, round(item1 + item5 + item10 + item12, 8) AS simplified, CASE WHEN tot < 10 THEN 'normal' WHEN tot < 15 THEN 'borderline' WHEN tot < 20 THEN 'possible_injury' ELSE 'probable_infarction' END AS category FROM t"""),
    "cosine_to_centroid": (cosine_to_centroid, "WITH u AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label IS NOT NULL), p AS (SELECT label, i, avg(x) AS m FROM u GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS c FROM p GROUP BY label) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], c), 6) AS cosine FROM embeddings JOIN c USING (label)"),
    "pad_crop_scale": (pad_crop_scale, "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) SELECT vec_id, round(list_sum(x[13:52]), 5) AS center40, round(list_sum(x[25:64]), 5) AS end40, round(list_sum(x) + 6 * x[64], 5) AS edge70, round(1000 * list_sum(x), 5) AS uv FROM e"),
    "lead_order": (lead_order, "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) SELECT vec_id, " + ", ".join(f"round({'-' if c == '-aVR' else ''}list_sum(x[{k + 1}:{k + 5}]), 6) AS lead{i + 1}" for i, c in enumerate(signals.CABRERA) for k in [5 * signals.CLINICAL.index(c.removeprefix('-'))]) + " FROM e"),
    "waveform_score": (waveform_score, None),
    "waveform_embeddings": (waveform_embeddings, None),
    "recording_images": (recording_images, None),
    "failure_summary": (failure_summary, f"WITH {_PRED}, f AS (SELECT count(*) AS n, count(*) FILTER (NOT va) AS failed_a, count(*) FILTER (NOT vb) AS failed_b FROM pred) SELECT *, round(failed_a / n, 8) AS failure_rate_a, round(failed_b / n, 8) AS failure_rate_b, n - greatest(failed_a, failed_b) AS joint FROM f"),
    "findings": (findings, None),
    "finding_points": (finding_points, f"""WITH RECURSIVE {_PRED}, {_NESTED}, {_QUADRANTS}, {_GRADIENTS}, rk AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM {_T}),
fp(finding, value) AS (SELECT 'H1: rank correlation', corr(ra, rb) FROM rk UNION ALL SELECT 'H2: mean gradient ratio', ratio FROM gm UNION ALL SELECT unnest(['H3: risk difference where A is low', 'risk ratio where A is low', 'risk difference where A is high', 'risk ratio where A is high', 'share with B alone high']),
unnest([lh - ll, CASE WHEN ll > 0 THEN lh / ll ELSE 1 END, hh - hl, CASE WHEN hl > 0 THEN hh / hl ELSE 1 END, share]) FROM qd UNION ALL SELECT unnest(['H4: gain in AUROC', 'study on other data']), {_GAIN}) SELECT finding, round(value, 6) AS value FROM fp"""),
    "discordant_readings": (discordant_readings, f"""WITH {_PRED}, t AS {_T}, c AS (SELECT quantile_cont(b, 0.5) AS m FROM t),
x AS (SELECT avg(y30::INT) FILTER (a < 15 AND b < m) AS ll, avg(y30::INT) FILTER (a < 15 AND b >= m) AS lh, avg(y30::INT) FILTER (a >= 15 AND b < m) AS hl, avg(y30::INT) FILTER (a >= 15 AND b >= m) AS hh, (count(*) FILTER (a < 15 AND b >= m))::DOUBLE / count(*) AS sh FROM t, c),
u AS (SELECT unnest([{{'reading': 'share with B alone high', 'v': sh}}, {{'reading': 'risk difference where A is low', 'v': lh - ll}}, {{'reading': 'risk ratio where A is low', 'v': CASE WHEN ll > 0 THEN lh / ll ELSE 1 END}},
  {{'reading': 'risk difference where A is high', 'v': hh - hl}}, {{'reading': 'risk ratio where A is high', 'v': CASE WHEN hl > 0 THEN hh / hl ELSE 1 END}}]) AS u FROM x)
SELECT u.reading AS reading, round(u.v, 8) AS value FROM u"""),
    "incremental_gains": (incremental_gains, None),
    "incremental_gain_points": (incremental_gain_points, f"""WITH RECURSIVE {_PRED}, {_NESTED}, gp(measure, point) AS (SELECT 'auroc', {_GAIN} UNION ALL SELECT unnest(['brier', 'log_loss']), unnest([x.brier - y.brier, x.log_loss - y.log_loss]) FROM nt x, nt y WHERE x.model = 'A' AND y.model = 'A+B') SELECT measure, round(point, 6) AS point FROM gp"""),
    "model_comparison": (model_comparison, None),
    "model_comparison_points": (model_comparison_points, f"WITH RECURSIVE {_PRED}, {_COMPARED} SELECT measure, round(a, 6) AS a, round(b, 6) AS b, round(up * (b - a), 6) AS gain FROM cm"),
    "performance_intervals": (performance_intervals, None),
    "performance_points": (performance_points, f"WITH RECURSIVE {_PRED}, {_COMPARED} SELECT measure, round(b, 8) AS point FROM cm"),
    "discordance_points": (discordance_points, f"""WITH {_PRED}, {_QUADRANTS} SELECT unnest(['A-low/B-low', 'A-low/B-high', 'A-high/B-low', 'A-high/B-high', 'rd_a_low', 'rr_a_low', 'rd_a_high']) AS measure,
unnest([round(v, 8) FOR v IN [coalesce(ll, 0), coalesce(lh, 0), coalesce(hl, 0), coalesce(hh, 0), coalesce(lh, 0) - coalesce(ll, 0), CASE WHEN ll > 0 THEN coalesce(lh, 0) / ll ELSE 1 END, coalesce(hh, 0) - coalesce(hl, 0)]]) AS point FROM qd"""),
    "discordance_intervals": (discordance_intervals, None),
    "probe_variants": (probe_variants, None),
    "probe_variant_intervals": (probe_variant_intervals, None),
    "discordance_by_medians": (discordance_by_medians, f"WITH {_PRED}, t AS {_T}, c AS (SELECT quantile_cont(a, 0.5) AS ma, quantile_cont(b, 0.5) AS mb FROM t), x AS (SELECT 'A-' || CASE WHEN a >= ma THEN 'high' ELSE 'low' END || '/B-' || CASE WHEN b >= mb THEN 'high' ELSE 'low' END AS quadrant, y30 FROM t, c) SELECT q.quadrant, count(y30) AS n, coalesce(sum(y30::INT), 0)::BIGINT AS events, round(coalesce(avg(y30::INT), 0), 8) AS rate FROM (SELECT unnest({[q for q, _, _ in strata.QUADRANTS]}) AS quadrant) q LEFT JOIN x USING (quadrant) GROUP BY q.quadrant"),
    "decile_calibration": (decile_calibration, f"""WITH {_PRED}, t AS {_T}, e AS (SELECT list_sort(list_distinct(quantile_cont(b, [k / 10.0::DOUBLE for k in range(11)]))) AS eb FROM t)
SELECT len(list_filter(eb[2:-2], lambda x: x <= b))::INT AS bin, count(*) AS n, sum(y30::INT)::BIGINT AS events, round(avg(y30::INT), 8) AS observed, round(avg(b), 8) AS predicted, round(min(b), 8) AS low, round(max(b), 8) AS high FROM t, e GROUP BY ALL"""),
    "centroid_probability": (centroid_probability, """WITH v AS (SELECT vec_id, label < 3 AS y, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL),
u AS (SELECT y, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM v), m AS (SELECT y, i, avg(x) AS m FROM u GROUP BY ALL), c AS (SELECT y, list(m ORDER BY i) AS c FROM m GROUP BY y)
SELECT vec_id, round(1 / (1 + exp(-(list_cosine_similarity(e, p.c) - list_cosine_similarity(e, q.c)))), 6) AS probability FROM v, (SELECT c FROM c WHERE y) p, (SELECT c FROM c WHERE NOT y) q"""),
    "inhospital_24h": (inhospital_24h, f"""WITH {_RECORDS}, {_ADMISSIONS}{_FIRST_STAY_24H} SELECT study_id, in_hospital_mortality, linked_hadm_id FROM rec LEFT JOIN fst USING (study_id)"""),
    "document_quality": (document_quality, f"WITH {_rank_sql('SELECT lang, n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id)', 'lang')} SELECT g AS lang, auroc, auprc FROM r"),
    "prediction_validity": (prediction_validity, f"""WITH {_PRED} SELECT split, count(*) AS n, count_if(va)::BIGINT AS valid_a, count_if(vb)::BIGINT AS valid_b, count_if(va AND vb)::BIGINT AS valid_both,
round(100.0::DOUBLE * count_if(va) / count(*), 8) AS percent_a, round(100.0::DOUBLE * count_if(vb) / count(*), 8) AS percent_b, round(100.0::DOUBLE * count_if(va AND vb) / count(*), 8) AS percent_both FROM pred GROUP BY 1"""),
    "calibration": (calibration, f"WITH RECURSIVE {_PRED}, lg AS (SELECT ln(q / (1 - q)) AS l, y FROM (SELECT least(greatest(b, 1e-6), 1 - 1e-6) AS q, y30::INT AS y FROM {_T})), {_newton_sql('fl', 'lg', ['l'])} SELECT round(c1, 6) AS slope, round(c0, 6) AS intercept FROM fl_end"),
    "bootstrap_auroc": (bootstrap_auroc, None),
    # the p-value is the normal density beyond the root of the likelihood ratio, summed by Simpson's rule
    "incremental_information": (incremental_information, f"""WITH RECURSIVE {_PRED}, {_NESTED}, lr AS (SELECT greatest(2 * (max(ll) FILTER (model = 'A+B') - max(ll) FILTER (model = 'A')), 0) AS lrt FROM nl),
pv AS (SELECT lrt, least(1, sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(sqrt(lrt) + i * 0.0025::DOUBLE, 2) / 2)) * 0.0025::DOUBLE / 3 * sqrt(2 / pi())) AS p FROM lr, range(4001) t(i) GROUP BY lrt)
SELECT model, parameters, round(ll, 6) AS log_likelihood, round(2 * parameters - 2 * ll, 6) AS aic, round(ln(n) * parameters - 2 * ll, 6) AS bic, round(log_loss, 6) AS log_loss, round(auroc, 6) AS auroc, round(brier, 6) AS brier, round(lrt, 6) AS lrt, round(p, 6) AS p_value FROM nl JOIN nt USING (model) JOIN nr USING (model), pv"""),
}
QUERIES = {name: query for name, (query, _) in REGISTRY.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in REGISTRY.items() if sql}
