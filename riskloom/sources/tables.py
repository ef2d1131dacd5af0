"""Readers of the clinical CSV tables and sinks of results."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources import files, ipc

RECORD_LIST = "subject_id long, study_id long, file_name long, ecg_time string, path string"
MEASUREMENTS = ("subject_id", "study_id", "cart_id", "rr_interval", "p_onset", "p_end", "qrs_onset", "qrs_end", "t_end", "p_axis", "qrs_axis", "t_axis")
PATIENTS = "subject_id long, gender string, anchor_age long, anchor_year long, anchor_year_group string, dod string"
#: Parsed strictly and leniently: a bad value of the first kind is an error, of the second null.
STRICT, LENIENT = {"admittime": "admit_dt", "dischtime": "disch_dt"}, {"deathtime": "death_dt", "edregtime": "edreg_dt", "edouttime": "edout_dt"}
TIME = "yyyy-MM-dd HH:mm:ss"


def _csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def load_record_list(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path, RECORD_LIST)
    return df.withColumn("ecg_datetime", F.to_timestamp_ntz("ecg_time", F.lit(TIME))).withColumn("ecg_year", F.substring("ecg_time", 1, 4).cast("long"))


def load_machine_measurements(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path)
    df = df.withColumns({c: F.col(c).cast("long") for c in MEASUREMENTS if c in df.columns})
    return df.withColumn("ecg_datetime", F.to_timestamp_ntz("ecg_time", F.lit(TIME)))


def load_patients(spark: SparkSession, path: str) -> DataFrame:
    """Plain or gzip CSV; an unreadable date of death is null."""
    return _csv(spark, path, PATIENTS).withColumn("dod_date", F.expr("CAST(try_to_timestamp(dod, 'yyyy-MM-dd') AS DATE)"))


def load_admissions(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path)
    df = df.withColumns({c: F.col(c).cast("long") for c in ("subject_id", "hadm_id", "hospital_expire_flag")})
    df = df.withColumns({to: F.to_timestamp_ntz(c, F.lit(TIME)) for c, to in STRICT.items() if c in df.columns})
    return df.withColumns({to: F.expr(f"CAST(try_to_timestamp({c}, '{TIME}') AS TIMESTAMP_NTZ)") for c, to in LENIENT.items() if c in df.columns})


def save_table(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """By the path's ending CSV or Arrow IPC, else Parquet; of `columns` those that exist."""
    out = df.select(*(c for c in columns if c in df.columns)) if columns else df
    if path.endswith(".csv"):
        out.write.mode("overwrite").option("header", True).csv(path)
    elif path.endswith(ipc.ENDINGS):
        ipc.write_ipc(out, path)
    else:
        out.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """By the path's ending; with another ending as Parquet, and as CSV where it isn't."""
    csv = lambda: spark.read.option("header", True).option("inferSchema", True).csv(path)
    if path.endswith(".csv"):
        return csv()
    if path.endswith(ipc.ENDINGS):
        return ipc.read_ipc(spark, path)
    try:
        return spark.read.parquet(path)
    except (PySparkException, Py4JJavaError):
        if path.endswith(".parquet") or not files.exists(spark, path):
            raise
        return csv()
