"""Binary recordings: a text header (.hea) and one or more files of samples each, read through Spark's file sources.

A header's first line is `name signals rate samples`, then a line per signal: `file format gain(baseline)/units resolution
zero first checksum block description`. Lines after # are comments. Formats are those of `samples.BITS`, with samples per frame
skew and byte offset.

A record of segments has `name/segments` in its first line and then a line `name samples` per segment, each of which is a record of its own
in the same folder and gives a row of its own too. A first segment without samples is a layout: it names the record's signals, of which each segment
holds some. A segment named ~ is a gap. The record's signals are those of its segments one after the other, with missing samples (NaN) in gaps
and where a segment lacks a signal; its names and units are those of the layout, or of its first named segment.

Headers are read once and written as a table; a record's samples come together in one row. Defined results: a header that can't be parsed keeps its row with
a message in `error`; a record without a file of samples, with too few samples, or in another format, too, and so does one with a segment that can't be read, has another
length, rate or unit than the record says, or no header; an empty folder gives no rows, nor does a file
without a byte, which Spark's file sources leave out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.signals import CANONICAL
from riskloom.session import materialize, ship
from riskloom.sources.samples import parse_format, read_file

#: What a header leaves out.
RATE, GAIN, UNITS = 250.0, 200.0, "mV"
HEADER = {
    "record": "string", "record_name": "string", "n_sig": "int", "fs": "int", "sig_len": "long", "duration_seconds": "double", "sig_name": "array<string>", "units": "array<string>",
    "adc_gain": "array<double>", "baseline": "array<int>", "files": "array<string>", "formats": "array<string>", "comments": "array<string>", "segments": "array<struct<name:string,length:long>>", "error": "string",
}
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()), "array<struct<name:string,length:long>>": pa.list_(pa.struct([("name", pa.string()), ("length", pa.int64())]))}
#: What is needed of a header to read its samples.
LAYOUT = ("n_sig", "fs", "sig_len", "sig_name", "units", "adc_gain", "baseline", "files", "formats", "error")
#: Fixed value: the name of a gap, and of the file of a signal without samples.
NOTHING = "~"
_GAIN = re.compile(r"([-+0-9.eE]+)(?:\((-?\d+)\))?(?:/(.+))?")


@dataclass(frozen=True)
class Criteria:
    leads: tuple[str, ...] = CANONICAL
    fs: int = 500
    samples: int = 5000
    units: str | None = "mV"


def record_of(path: Column) -> Column:
    """A record's path without .hea or .dat."""
    return F.regexp_replace(path, r"\.(hea|dat)$", "")


def parse_header(text: str) -> dict:
    lines = [x.strip() for x in text.splitlines()]
    comments = [x[1:].strip() for x in lines if x.startswith("#")]
    rows = [x for x in lines if x and not x.startswith("#")]
    if not rows:
        raise ValueError("empty header")
    first = rows[0].split()
    if len(first) < 2:
        raise ValueError("no number of signals")
    name, _, count = first[0].partition("/")
    n_sig = int(first[1])
    fs = int(float(first[2].split("/")[0].split("(")[0])) if len(first) > 2 else int(RATE)
    sig_len = int(first[3]) if len(first) > 3 else 0
    if count:
        lines = [x.split() for x in rows[1 : int(count) + 1]]
        if len(lines) < max(1, int(count)):
            raise ValueError(f"{len(lines)} segment lines for {count} segments")
    elif len(rows) - 1 < n_sig:
        raise ValueError(f"{len(rows) - 1} signal lines for {n_sig} signals")
    out: dict = {"record_name": name, "n_sig": n_sig, "fs": fs, "sig_len": sig_len, "duration_seconds": sig_len / fs if fs > 0 else 0.0, "comments": comments}
    for column in ("sig_name", "units", "adc_gain", "baseline", "files", "formats"):
        out[column] = []
    if count:
        return out | {"segments": [{"name": x[0], "length": int(x[1])} for x in lines]}
    for row in rows[1 : n_sig + 1]:
        part = row.split(None, 8)
        found = _GAIN.fullmatch(part[2]) if len(part) > 2 else None
        gain = float(found[1]) if found else 0.0
        zero = int(part[4]) if len(part) > 4 else 0
        out["files"].append(part[0])
        out["formats"].append(part[1] if len(part) > 1 else "")
        out["adc_gain"].append(gain or GAIN)
        out["baseline"].append(int(found[2]) if found and found[2] is not None else zero)
        out["units"].append(found[3] if found and found[3] else UNITS)
        out["sig_name"].append(part[8] if len(part) > 8 else "")
    return out


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.hea").format("binaryFile").load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("record").to_pylist(), batch.column("content").to_pylist(), strict=True):
                row = dict.fromkeys(HEADER) | {"record": path}
                try:
                    row |= parse_header(content.decode("utf-8", "replace"))
                except (ValueError, IndexError) as e:
                    row["error"] = f"header: {e}"
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, arrow)

    arrow = pa.schema([(n, _ARROW[t]) for n, t in HEADER.items()])
    return text.select(record_of(F.col("path")).alias("record"), "content").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in HEADER.items()))


def _beside(file: Column) -> Column:
    """The path of a file in the record's folder."""
    return F.concat(F.regexp_extract("record", r"^(.*/)", 1), file)


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """One row per header below the folder; record: its path without the suffix."""
    held = materialize(_parsed(spark, folder), "headers")
    # a record of segments has the names and units of its layout, or of its first segment with a name
    named = F.get(F.filter("segments", lambda s: s["name"] != NOTHING), F.lit(0))["name"]
    first = held.select(F.col("record").alias("_first"), "sig_name", "units")
    cut = held.where("segments IS NOT NULL").drop("sig_name", "units").withColumn("_first", _beside(named)).join(first, "_first", "left")
    return held.where("segments IS NULL").unionByName(cut.select(*held.columns))


def _with_members(headers: DataFrame) -> DataFrame:
    """headers with members: what each segment's header says, in order; of a record without segments, its own."""
    own = F.struct(F.lit(0).alias("pos"), F.col("record_name").alias("name"), F.col("sig_len").alias("length"), F.lit(True).alias("found"), *LAYOUT)
    parts = headers.where("segments IS NOT NULL").select("record", F.posexplode("segments").alias("pos", "s")).select("record", "pos", "s.name", "s.length", _beside(F.col("s.name")).alias("_part"))
    held = headers.where("segments IS NULL").select(F.col("record").alias("_part"), F.lit(True).alias("found"), *LAYOUT)
    parts = parts.join(held, "_part", "left").select("record", F.struct("pos", "name", "length", F.coalesce("found", F.lit(False)).alias("found"), *LAYOUT).alias("m"))
    parts = parts.groupBy("record").agg(F.array_sort(F.collect_list("m")).alias("members"))
    cut = headers.where("segments IS NOT NULL").join(parts, "record")
    return headers.where("segments IS NULL").withColumn("members", F.array(own)).unionByName(cut)


def _decoded(member: dict, contents: dict[str, bytes]) -> list[np.ndarray]:
    """Physical values of one header's signals."""
    if member["error"]:
        raise ValueError(member["error"])
    formats = [parse_format(f) for f in member["formats"]]
    signals: list[np.ndarray] = [np.zeros(0)] * member["n_sig"]
    for file in dict.fromkeys(member["files"]):
        if file not in contents:
            raise ValueError("no file of samples")
        at = [k for k, f in enumerate(member["files"]) if f == file]
        for k, x in zip(at, read_file(contents[file], [formats[k] for k in at], member["sig_len"] or member["length"]), strict=True):
            signals[k] = (x - member["baseline"][k]) / member["adc_gain"][k]
    if len({len(x) for x in signals}) > 1:
        raise ValueError("files of several lengths")
    return signals


def _assembled(row: dict, contents: dict[str, bytes]) -> list[np.ndarray]:
    """The signals of a record of segments."""
    members, leads = row["members"], row["sig_name"]
    if lost := [m["name"] for m in members if m["name"] != NOTHING and not m["found"]]:
        raise ValueError(f"segments without a header: {', '.join(lost)}")
    total = sum(m["length"] for m in members)
    if not leads or row["sig_len"] not in (0, total):
        raise ValueError(f"segments of {total} samples, not {row['sig_len']}" if leads else "segments without signals")
    out, at = np.full((len(leads), total), np.nan), 0
    for m in members:
        if m["name"] != NOTHING and m["length"]:
            if m["fs"] != row["fs"] or m["sig_len"] not in (0, m["length"]):
                raise ValueError(f"segment {m['name']} has another rate or length")
            same = m["sig_name"] == leads  # names may repeat or be empty
            for k, x in enumerate(_decoded(m, contents)):
                if not same and leads.count(m["sig_name"][k]) != 1:
                    raise ValueError(f"segment {m['name']} has a signal that the record lacks: {m['sig_name'][k]}")
                to = k if same else leads.index(m["sig_name"][k])
                if m["units"][k] != row["units"][to]:
                    raise ValueError(f"segment {m['name']} has other units")
                out[to, at : at + m["length"]] = x
        at += m["length"]
    return list(out)


def read_recordings(spark: SparkSession, folder: str) -> DataFrame:
    """(record, fs, leads, signal, units, error): physical values, one array per lead."""
    headers = _with_members(read_headers(spark, folder))
    data = spark.read.option("recursiveFileLookup", True).format("binaryFile").load(folder).where("path NOT LIKE '%.hea'").select(F.col("path").alias("data_path"), "content")
    # one file of samples a row, then all files of a record together
    files = F.array_distinct(F.flatten(F.transform("members", lambda m: F.coalesce(m["files"], F.array().cast("array<string>")))))
    parts = headers.select("record", F.explode(files).alias("file")).where(F.col("file") != NOTHING)
    parts = parts.withColumn("data_path", _beside(F.col("file"))).join(data, "data_path")
    held = parts.groupBy("record").agg(F.collect_list(F.struct("file", "content")).alias("contents"))
    joined = headers.join(held, "record", "left")
    schema = "record string, fs int, leads array<string>, signal array<array<double>>, units array<string>, error string"
    arrow = pa.schema([("record", pa.string()), ("fs", pa.int32()), ("leads", pa.list_(pa.string())), ("signal", pa.list_(pa.list_(pa.float64()))), ("units", pa.list_(pa.string())), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = {"record": row["record"], "fs": row["fs"], "leads": row["sig_name"], "units": row["units"], "signal": None, "error": row["error"]}
                if not row["error"]:
                    contents = {c["file"]: c["content"] for c in row["contents"] or []}
                    try:
                        out["signal"] = _assembled(row, contents) if row["segmented"] else _decoded(row["members"][0], contents)
                    except ValueError as e:
                        out["error"] = str(e)
                yield pa.RecordBatch.from_pylist([out], arrow)

    return joined.select("record", "fs", "sig_len", "sig_name", "units", "error", F.col("segments").isNotNull().alias("segmented"), "members", "contents").mapInArrow(run, schema)


def ineligible(criteria: Criteria = Criteria()) -> Column:
    """The first reason why a header isn't eligible, null where it is."""
    listed = lambda xs: F.array_join(xs, ", ")
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    missing = F.filter(F.array(*map(F.lit, criteria.leads)), lambda x: ~F.array_contains("sig_name", x))
    out = F.when(~F.col("fs").eqNullSafe(criteria.fs), F.format_string(f"sampling rate is %s Hz, not {criteria.fs} Hz", said("fs")))
    out = out.when(~F.col("sig_len").eqNullSafe(criteria.samples), F.format_string(f"signal length is %s samples, not {criteria.samples}", said("sig_len")))
    out = out.when(F.size(missing) > 0, F.concat(F.lit("Missing required leads: "), listed(missing)))
    if criteria.units:
        other = F.array_sort(F.array_distinct(F.filter("units", lambda u: u != criteria.units)))
        out = out.when(F.size(other) > 0, F.concat(F.lit(f"units other than {criteria.units}: "), listed(other)))
    return out


def eligibility(headers: DataFrame, criteria: Criteria = Criteria()) -> DataFrame:
    """headers with eligible boolean and reason string: sampling rate, length, leads, units, in this order."""
    reason = F.coalesce(F.col("error") if "error" in headers.columns else F.lit(None).cast("string"), ineligible(criteria))
    return headers.withColumn("reason", reason).withColumn("eligible", F.col("reason").isNull())


def waveforms_available(records: DataFrame, root: str, path: str = "path", looked_at: int = 5) -> bool:
    """Whether a header or file of one of the first records with a path stands below root."""
    spark = records.sparkSession
    for (name,) in records.where(F.length(path) > 0).select(path).limit(looked_at).collect():
        for suffix in (".hea", ""):
            file = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{re.sub(r'[.](hea|dat)$', '', name)}{suffix}")
            if file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file):
                return True
    return False
