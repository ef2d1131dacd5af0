"""Cohort derivation: age, adults, encounter linkage, index recordings, flow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns taken from the patients where they exist.
PATIENT_COLUMNS = ("subject_id", "gender", "anchor_age", "anchor_year", "anchor_year_group", "dod", "dod_date")
#: Spans of the interval join: days of the narrowest, how many times wider each next width is, how many widths there are, and
#: how many borders of its own width an encounter may cross.
BUCKET_DAYS, WIDER, WIDTHS, BORDERS = 30, 16, 3, 4


def age_at_recording(records: DataFrame, patients: DataFrame, how: str = "inner") -> DataFrame:
    """Records of known patients (of all with how="left") with age_at_ecg = anchor_age + (recording's year - anchor_year)."""
    if "ecg_year" not in records.columns:
        records = records.withColumn("ecg_year", F.year("ecg_datetime").cast("long"))
    known = [c for c in PATIENT_COLUMNS if c in patients.columns]
    taken = [c for c in known if c != "subject_id" and c in records.columns]
    joined = records.drop(*taken).join(patients.select(*known), "subject_id", how)
    return joined.withColumn("age_at_ecg", F.col("anchor_age") + F.col("ecg_year") - F.col("anchor_year"))


def adults(records: DataFrame, min_age: int = 18) -> DataFrame:
    if "age_at_ecg" not in records.columns:
        raise ValueError("age_at_ecg is missing")
    return records.where(F.col("age_at_ecg") >= min_age)


def _span(t: Column, days: int, width: int) -> Column:
    return F.floor(F.unix_date(F.to_date(t)) / (days * WIDER**width))


def spanned_encounters(admissions: DataFrame, pre_admit_hours: int = 0, days: int = BUCKET_DAYS) -> DataFrame:
    """Encounters under `_subject` with `_start`, once for each span (`_width`, `_span`) they touch, in the narrowest width of which they cross
    at most BORDERS borders, so that long ones have few rows. Those that end before they start, or with a null end, have none."""
    start = F.col("admit_dt") - F.expr(f"INTERVAL {int(pre_admit_hours)} HOURS")
    a = admissions.withColumnRenamed("subject_id", "_subject").withColumn("_start", start).where(F.col("_start") <= F.col("disch_dt"))
    ends = [(_span(F.col("_start"), days, k), _span(F.col("disch_dt"), days, k)) for k in range(WIDTHS)]
    width = F.lit(WIDTHS - 1)
    for k in reversed(range(WIDTHS - 1)):
        width = F.when(ends[k][1] - ends[k][0] <= BORDERS, F.lit(k)).otherwise(width)
    a = a.withColumn("_width", width)
    first, last = (F.get(F.array(*(e[j] for e in ends)), F.col("_width")) for j in (0, 1))
    return a.withColumn("_span", F.explode(F.sequence(first, last)))


def spanned_recordings(records: DataFrame, days: int = BUCKET_DAYS) -> DataFrame:
    """Recordings with their span (`_level`, `_at`) in every width."""
    return records.select("*", F.posexplode(F.array(*(_span(F.col("ecg_datetime"), days, k) for k in range(WIDTHS)))).alias("_level", "_at"))


def falls_into() -> Column:
    """Of a spanned recording and a spanned encounter: the same subject and span, and the exact range."""
    inside = (F.col("ecg_datetime") >= F.col("_start")) & (F.col("ecg_datetime") <= F.col("disch_dt"))
    return (F.col("subject_id") == F.col("_subject")) & (F.col("_level") == F.col("_width")) & (F.col("_at") == F.col("_span")) & inside


def link_admissions(records: DataFrame, admissions: DataFrame, pre_admit_hours: int = 0, days: int = BUCKET_DAYS) -> DataFrame:
    """Recordings with each encounter they fall into, pre_admit_hours before admission to discharge, both inclusive.

    One join on the subject and a span: a recording lies in one span of each width, an encounter has a row for each span of its
    own width that it touches, so a pair meets once and a subject with very many rows meets in many tasks. The exact range stays as
    a residual condition. Encounters that end before they start, or with a null end, have no pair."""
    shared = [c for c in admissions.columns if c in records.columns and c != "subject_id"]
    a = spanned_encounters(admissions.drop(*shared), pre_admit_hours, days)
    return spanned_recordings(records, days).join(a, falls_into()).drop("_subject", "_start", "_width", "_span", "_level", "_at")


def recordings_inside(records: DataFrame, admissions: DataFrame, pre_admit_hours: int = 0, days: int = BUCKET_DAYS) -> DataFrame:
    """Recordings that fall into an encounter, without it: once for each width of spans they meet one in, WIDTHS times at most. For a
    choice among them or for distinct values, which need no pairs."""
    a = spanned_encounters(admissions.select("subject_id", "admit_dt", "disch_dt"), pre_admit_hours, days)
    return spanned_recordings(records, days).join(a, falls_into(), "left_semi").drop("_level", "_at")


def index_recordings(records: DataFrame, which: str = "earliest") -> DataFrame:
    """The first (or last) row of each subject by time, then study; null times come first either way."""
    if which not in ("earliest", "latest"):
        raise ValueError("which is earliest or latest")
    order = [F.col("ecg_datetime").asc_nulls_first(), F.col("study_id").asc_nulls_first()] if which == "earliest" else [F.col("ecg_datetime").desc_nulls_first(), F.col("study_id").desc_nulls_first()]
    return records.withColumn("_n", F.row_number().over(Window.partitionBy("subject_id").orderBy(*order))).where("_n = 1").drop("_n")


def linkage_statistics(records: DataFrame, patients: DataFrame, admissions: DataFrame) -> DataFrame:
    """One row of counts; each input is read once per kind of link."""
    size = records.agg(F.count(F.lit(1)).alias("total_records"), F.countDistinct("subject_id").alias("total_subjects"), F.countDistinct("study_id").alias("total_studies"))
    known = records.join(patients.select("subject_id").distinct(), "subject_id", "left_semi").agg(F.count(F.lit(1)).alias("linked_records"), F.countDistinct("subject_id").alias("linked_subjects"))
    old = adults(age_at_recording(records, patients))
    grown = old.agg(F.count(F.lit(1)).alias("adult_records"), F.countDistinct("subject_id").alias("adult_subjects")).withColumn("index_adult_records", F.col("adult_subjects"))
    met = records.join(admissions.select("subject_id").distinct(), "subject_id", "left_semi").agg(F.countDistinct("subject_id").alias("subjects_with_admissions"))
    per = records.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n").alias("mean_per_subject"), F.expr("percentile(n, 0.5D)").alias("median_per_subject"), F.min("n").alias("min_per_subject"), F.max("n").alias("max_per_subject"))
    inside = [link_admissions(records, admissions, h).agg(F.countDistinct("study_id").alias(f"records_within_{h}h"), F.countDistinct("subject_id").alias(f"subjects_within_{h}h")) for h in (0, 24)]
    frames = [f.withColumn("_one", F.lit(1)) for f in (size, known, grown, met, per, *inside)]  # of one row each
    out = reduce(lambda a, b: a.join(b, "_one"), frames).drop("_one")
    share = {"linked_subject_percent": ("linked_subjects", "total_subjects"), "linked_record_percent": ("linked_records", "total_records"), "subjects_with_admissions_percent": ("subjects_with_admissions", "total_subjects")}
    return out.withColumns({name: 100.0 * F.try_divide(F.col(x).cast("double"), F.col(y)) for name, (x, y) in share.items()})


def cohort_flow(records: DataFrame, steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """(step, name, records, subjects, excluded_records, excluded_subjects) of successive subsets of records."""
    counts = [df.agg(F.count(F.lit(1)).alias("records"), F.countDistinct("subject_id").alias("subjects")).select(F.lit(k).alias("step"), F.lit(name).alias("name"), "records", "subjects") for k, (name, df) in enumerate([("all", records), *steps])]
    flow = reduce(DataFrame.unionByName, counts)
    w = Window.orderBy("step")
    return flow.withColumns({f"excluded_{c}": F.coalesce(F.lag(c).over(w) - F.col(c), F.lit(0).cast("long")) for c in ("records", "subjects")})


def flow_by_flags(df: DataFrame, steps: list[tuple[str, Column]], subject: str = "subject_id") -> DataFrame:
    """The flow of successive subsets that conditions on df's rows describe, by one aggregate per subject and one over all."""
    per = df.groupBy(subject).agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(f"_{k}") for k, (_, c) in enumerate(steps)))
    total = per.agg(*(x for k in range(len(steps)) for x in (F.sum(f"_{k}").alias(f"r{k}"), F.count_if((F.col(f"_{k}") > 0) & F.col(subject).isNotNull()).alias(f"s{k}"))))
    zero = F.lit(0).cast("long")
    at = lambda c, k: F.coalesce(F.col(f"{c}{k}"), zero)
    rows = [F.struct(F.lit(k).alias("step"), F.lit(name).alias("name"), at("r", k).alias("records"), at("s", k).alias("subjects"), (at("r", k - 1) - at("r", k) if k else zero).alias("excluded_records"), (at("s", k - 1) - at("s", k) if k else zero).alias("excluded_subjects")) for k, (name, _) in enumerate(steps)]
    return total.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def attrition(records: DataFrame, patients: DataFrame, admissions: DataFrame, min_age: int = 18) -> DataFrame:
    """All recordings, those of known patients, of adults, with a valid outcome, and the index recordings. Every record
    is tagged once; the tables are read once."""
    from riskloom.operators.outcomes import mortality_outcomes

    known = age_at_recording(records, patients.withColumn("dod", F.lit("known")), "left")
    tagged = mortality_outcomes(known.withColumn("_known", F.col("dod").isNotNull()), patients, admissions)
    grown = F.col("_known") & (F.col("age_at_ecg") >= min_age)
    tagged = tagged.withColumn("_valid", F.coalesce(grown & F.col("is_valid"), F.lit(False)))
    order = Window.partitionBy("subject_id").orderBy(F.desc("_valid"), F.col("ecg_datetime").asc_nulls_first(), F.col("study_id").asc_nulls_first())
    tagged = tagged.withColumn("_first", F.row_number().over(order) == 1)
    return flow_by_flags(tagged, [("all", F.lit(True)), ("linked", F.col("_known")), ("adult", grown), ("valid", F.col("_valid")), ("index", F.col("_valid") & F.col("_first"))])
