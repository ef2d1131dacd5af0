"""The domain tables, bound onto the driver's star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRIMARY_KEYS = {"records": "study_id", "patients": "subject_id", "admissions": "hadm_id", "predictions": "subject_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("study_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("ecg_datetime"), F.year("o_orderdate").cast("long").alias("ecg_year")
    )


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").where(key % 50 != 0).select(
        key.alias("subject_id"),
        F.when(key % 2 == 0, "F").otherwise("M").alias("gender"),
        (12 + key % 70).alias("anchor_age"),
        F.lit(1998).cast("long").alias("anchor_year"),
        F.when(key % 3 == 0, F.date_add(F.lit("1998-01-01").cast("date"), (key * 37 % 1500).cast("int"))).alias("dod_date"),
    )


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_shipdate").cast("timestamp_ntz").alias("admit_dt"), F.max("l_shipdate").cast("timestamp_ntz").alias("disch_dt"), F.max(((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).cast("long")).alias("hospital_expire_flag")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("subject_id"))
    out = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).withColumn("hadm_id", F.col("l_orderkey"))
    return out.select("subject_id", "hadm_id", "admit_dt", "disch_dt", "hospital_expire_flag", F.when((F.col("hospital_expire_flag") == 1) & (F.col("hadm_id") % 20 == 0), F.col("disch_dt")).alias("death_dt"))


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short encounters, three days from each signup."""
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return e.select(F.col("user_id").alias("subject_id"), F.col("event_id").alias("hadm_id"), F.col("ts").cast("timestamp_ntz").alias("admit_dt"), (F.col("ts") + F.expr("INTERVAL 3 DAYS")).cast("timestamp_ntz").alias("disch_dt"))


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    return e.select(F.col("user_id").alias("subject_id"), F.col("event_id").alias("study_id"), F.col("ts").cast("timestamp_ntz").alias("ecg_datetime"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per subject: rule score A, probability B, three outcomes and a split."""
    key = F.col("c_custkey")
    a = (F.col("c_acctbal") + 1000.0) / 11000.0 * 45.0
    b = 1.0 / (1.0 + F.exp(-(0.08 * F.col("model_a_score") + 2.0 * ((key * 7919 % 1000) / 1000.0) - 3.5)))
    y = lambda k: (key * k % 997) / 997.0 < F.col("model_b_score")
    bucket = (key * 31 + 42) % 10
    out = table(spark, sf_dir, "customer").select("c_custkey", a.alias("model_a_score")).withColumn("model_b_score", b)
    return out.select(
        key.alias("subject_id"), (key + 100000).alias("study_id"), F.when(bucket < 6, "dev").when(bucket < 8, "val").otherwise("test").alias("split"), "model_a_score",
        F.when(F.col("model_a_score") < 10, "normal").when(F.col("model_a_score") < 15, "borderline").when(F.col("model_a_score") < 20, "possible_injury").otherwise("probable_infarction").alias("model_a_category"),
        (key % 41 != 0).alias("model_a_valid"), "model_b_score", F.ln(F.col("model_b_score") / (1.0 - F.col("model_b_score"))).alias("model_b_log_odds"), (key % 43 != 0).alias("model_b_valid"),
        y(104729).alias("mortality_30d"), y(7907).alias("mortality_90d"), y(6997).alias("mortality_1yr"),
    )
