import gzip

import numpy as np
import pytest

from riskloom.operators.signals import CANONICAL
from riskloom.sources import paths, recordings, tables


def header(name, n, fs, length, leads, units="mV", gain="200(10)", fmt="16"):
    lines = [f"{name} {n} {fs} {length} 12:00:00 01/01/2150"]
    lines += [f"{name}.dat {fmt} {gain}/{units} 16 0 -5 0 0 {lead}" for lead in leads]
    return "\n".join([*lines, "# a comment", "#another"]) + "\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("recordings") / "files" / "p1"
    base.mkdir(parents=True)
    rng = np.random.default_rng(1)
    raw = rng.integers(-3000, 3000, (5000, 12)).astype("<i2")
    raw[7, 3] = -32768
    (base / "good.hea").write_text(header("good", 12, 500, 5000, CANONICAL))
    (base / "good.dat").write_bytes(raw.tobytes())
    (base / "slow.hea").write_text(header("slow", 12, 250, 5000, CANONICAL))
    (base / "short.hea").write_text(header("short", 12, 500, 4000, CANONICAL))
    (base / "short.dat").write_bytes(raw[:100].tobytes())
    (base / "few.hea").write_text(header("few", 11, 500, 5000, CANONICAL[:-1]))
    (base / "micro.hea").write_text(header("micro", 12, 500, 5000, CANONICAL, units="uV"))
    (base / "plain.hea").write_text("plain 1 100 3\nplain.dat 16\n")
    (base / "plain.dat").write_bytes(np.array([200, -400, 0], "<i2").tobytes())
    (base / "other.hea").write_text(header("other", 1, 100, 3, ["I"], fmt="212"))
    (base / "broken.hea").write_text("broken two\n")
    (base / "empty.hea").write_text("# only a comment\n")
    return base.parent.parent, raw


def test_headers_and_their_eligibility(spark, folder):
    got = {r.record.rsplit("/", 1)[1]: r for r in recordings.eligibility(recordings.read_headers(spark, str(folder[0]))).collect()}
    good = got["good"]
    assert (good.n_sig, good.fs, good.sig_len, good.duration_seconds) == (12, 500, 5000, 10.0) and tuple(good.sig_name) == CANONICAL
    assert set(good.units) == {"mV"} and set(good.adc_gain) == {200.0} and set(good.baseline) == {10} and good.comments == ["a comment", "another"]
    assert good.eligible and good.reason is None
    assert got["slow"].reason == "sampling rate is 250 Hz, not 500 Hz"
    assert got["short"].reason == "signal length is 4000 samples, not 5000"
    assert got["few"].reason == "Missing required leads: V6" and got["micro"].reason == "units other than mV: uV"
    assert (got["plain"].adc_gain, got["plain"].baseline, got["plain"].units) == ([200.0], [0], ["mV"])
    assert got["broken"].error.startswith("header:") and not got["broken"].eligible and got["empty"].error == "header: empty header"


def test_signals(spark, folder):
    root, raw = folder
    got = {r.record.rsplit("/", 1)[1]: r for r in recordings.read_recordings(spark, str(root)).collect()}
    want = (raw.astype(float) - 10) / 200
    want[7, 3] = np.nan
    assert got["good"].error is None and np.allclose(np.array(got["good"].signal), want.T, equal_nan=True) and tuple(got["good"].leads) == CANONICAL
    assert got["plain"].signal == [[1.0, -2.0, 0.0]]
    assert got["short"].error == "100 of 4000 samples" and got["slow"].error == "no file of samples" and got["other"].error == "no file of samples" and got["broken"].signal is None
    assert got["few"].signal is None and len(got) == 9


def test_available_waveforms(spark, folder):
    df = spark.createDataFrame([("",), ("files/p1/none",), ("files/p1/good",)], "path string")
    assert recordings.waveforms_available(df, str(folder[0])) and not recordings.waveforms_available(df.where("path = 'files/p1/none'"), str(folder[0]))
    assert not recordings.waveforms_available(df.limit(0), str(folder[0]))


def test_loaders_and_paths(spark, tmp_path, monkeypatch):
    (tmp_path / "hosp").mkdir()
    (tmp_path / "record_list.csv").write_text("subject_id,study_id,file_name,ecg_time,path\n1,10,7,2150-01-01 10:00:00,files/a\n")
    (tmp_path / "m.csv").write_text("subject_id,study_id,cart_id,ecg_time,report_0,bandwidth,filtering,rr_interval,p_onset,p_end,qrs_onset,qrs_end,t_end,p_axis,qrs_axis,t_axis\n1,10,5,2150-01-01 10:00:00,Sinus rhythm,0.005-150 Hz,60 Hz,800,40,150,190,280,560,50,30,40\n")
    for name, text in (("patients", "subject_id,gender,anchor_age,anchor_year,anchor_year_group,dod\n1,M,50,2150,2008 - 2010,2153-01-01\n2,F,60,2150,2008 - 2010,\n3,F,60,2150,x,unknown\n"), ("admissions", "subject_id,hadm_id,admittime,dischtime,deathtime,hospital_expire_flag\n1,9,2150-01-01 08:00:00,2150-01-02 08:00:00,,0\n")):
        (tmp_path / "hosp" / f"{name}.csv.gz").write_bytes(gzip.compress(text.encode()))
    monkeypatch.setenv("MIMIC_ROOT", str(tmp_path))
    monkeypatch.setenv("ECG_ROOT", str(tmp_path))
    assert paths.resolve() == paths.DataPaths(str(tmp_path), str(tmp_path)) and paths.resolve("/a", "/b") == paths.DataPaths("/a", "/b")
    monkeypatch.setenv("MIMIC_ECG_ROOT", "/first")
    assert paths.resolve().recordings == "/first"
    records, patients, admissions = paths.load_tables(spark, paths.resolve(recordings=str(tmp_path)))
    r, a = records.first(), admissions.first()
    assert (r.subject_id, r.ecg_year, str(r.ecg_datetime)) == (1, 2150, "2150-01-01 10:00:00") and str(a.admit_dt) == "2150-01-01 08:00:00" and a.death_dt is None and a.hospital_expire_flag == 0
    assert [str(p.dod_date) for p in patients.orderBy("subject_id").collect()] == ["2153-01-01", "None", "None"]
    measured = tables.load_machine_measurements(spark, str(tmp_path / "m.csv"))
    assert dict(measured.dtypes)["rr_interval"] == "bigint" and measured.first().report_0 == "Sinus rhythm" and str(measured.first().ecg_datetime) == "2150-01-01 10:00:00"
    with pytest.raises(FileNotFoundError, match="Record list not found"):
        paths.load_tables(spark, paths.resolve(recordings="/nowhere"))
