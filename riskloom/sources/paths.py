"""Where the clinical tables stand: explicit folders, then the environment, then defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from riskloom.sources import tables
from riskloom.sources.files import exists

#: Environment variables, defaults, and places below the roots, the first that exists wins.
CLINICAL_ENV, RECORDING_ENVS = "MIMIC_ROOT", ("MIMIC_ECG_ROOT", "ECG_ROOT")
CLINICAL_DEFAULT, RECORDING_DEFAULT = "~/data/mimiciv/3.1", "~/data/mimic-iv-ecg/1.0"
PLACES = {
    "Record list": ("record_list.csv", "files/record_list.csv"),
    "Patients table": ("hosp/patients.csv.gz", "hosp/patients.csv", "patients.csv.gz", "patients.csv"),
    "Admissions table": ("hosp/admissions.csv.gz", "hosp/admissions.csv", "admissions.csv.gz", "admissions.csv"),
}


@dataclass(frozen=True)
class DataPaths:
    clinical: str
    recordings: str


def resolve(clinical: str | None = None, recordings: str | None = None) -> DataPaths:
    clinical = clinical or os.environ.get(CLINICAL_ENV) or CLINICAL_DEFAULT
    recordings = recordings or next((os.environ[e] for e in RECORDING_ENVS if os.environ.get(e)), RECORDING_DEFAULT)
    return DataPaths(*(p if ":" in p else os.path.abspath(os.path.expanduser(p)) for p in (clinical, recordings)))


def find(spark: SparkSession, base: str, candidates: tuple[str, ...]) -> str:
    """The first candidate that exists, else the first."""
    return next((p for c in candidates if exists(spark, p := f"{base}/{c}")), f"{base}/{candidates[0]}")


def load_tables(spark: SparkSession, paths: DataPaths) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, patients, admissions); FileNotFoundError names the first that is missing."""
    loaders = {"Record list": (paths.recordings, tables.load_record_list), "Patients table": (paths.clinical, tables.load_patients), "Admissions table": (paths.clinical, tables.load_admissions)}
    found = {name: find(spark, base, PLACES[name]) for name, (base, _) in loaders.items()}
    for name, path in found.items():
        if not exists(spark, path):
            raise FileNotFoundError(f"{name} not found at: {path}")
    return tuple(load(spark, found[name]) for name, (_, load) in loaders.items())
