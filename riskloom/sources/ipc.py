"""Tables as folders of Arrow IPC files, one per task: rows go from tasks to the store and back, never through the driver.

A task writes its rows below `_temporary` under a name of its own attempt and reports the name when the file is closed. The commit
moves the reported files into the folder and marks it with _SUCCESS, so what failed or repeated attempts wrote is never
part of the table. Stores are those that pyarrow knows (local and shared folders, HDFS, S3, GCS).

Defined results: an empty table has one file without rows; a folder without its mark is an error, and so are files of
different columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from riskloom.session import ship
from riskloom.sources import files

#: Endings of paths that hold IPC files.
ENDINGS = (".ipc", ".arrow")


def write_ipc(df: DataFrame, path: str) -> None:
    """Replaces what stands at path."""
    spark = df.sparkSession
    ship(spark)
    schema = to_arrow_schema(df.schema)
    target = files.qualified(spark, path)
    held = f"{target}/_temporary"
    files.delete(spark, path)
    files.make_folder(spark, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(held)
        name, rows, writer, out = f"part-{uuid.uuid4().hex}.arrow", 0, None, None
        for batch in batches:
            if batch.num_rows:
                if writer is None:
                    out = system.open_output_stream(f"{folder}/{name}")
                    writer = pa.ipc.new_file(out, schema)
                writer.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema, strict=True)], schema=schema))
                rows += batch.num_rows
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows], pa.int64())], ["name", "rows"])

    done = [r["name"] for r in df.mapInArrow(run, "name string, rows long").collect()]  # a name per task
    if not done:
        system, folder = fs.FileSystem.from_uri(held)
        done = ["part-empty.arrow"]
        with system.open_output_stream(f"{folder}/{done[0]}") as out, pa.ipc.new_file(out, schema):
            pass
    for name in done:
        files.move(spark, f"{held}/{name}", f"{target}/{name}")
    files.delete(spark, held)
    files.write_text(spark, f"{target}/_SUCCESS", "")


def read_ipc(spark: SparkSession, path: str) -> DataFrame:
    """A table of a folder that write_ipc left, or of a single file. A task reads a file at a time, batch by batch."""
    ship(spark)
    target = files.qualified(spark, path)
    names = [files.qualified(spark, n) for n in files.listed(spark, path)]
    if names != [target] and not files.exists(spark, f"{target}/_SUCCESS"):
        raise FileNotFoundError(f"{path} holds no table that was written to its end")
    system, place = fs.FileSystem.from_uri(names[0])
    with system.open_input_file(place) as first:
        schema = pa.ipc.open_file(first).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("name").to_pylist():
                system, place = fs.FileSystem.from_uri(name)
                with system.open_input_file(place) as file:
                    reader = pa.ipc.open_file(file)
                    if reader.schema != schema:
                        raise ValueError(f"{name} has other columns than {names[0]}")
                    for k in range(reader.num_record_batches):
                        yield reader.get_batch(k)

    listed = spark.createDataFrame([(n,) for n in names], "name string").repartition(len(names), F.col("name"))
    return listed.mapInArrow(run, from_arrow_schema(schema))
