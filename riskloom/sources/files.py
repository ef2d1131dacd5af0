"""Files in any store that Spark reaches, through its own file systems: for manifests, digests and reports, never for rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file, file.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    file, system = _open(spark, path)
    return system.exists(file)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its store's name, as other libraries read it too."""
    file, system = _open(spark, path)
    found = system.makeQualified(file).toString()
    return f"file://{found.removeprefix('file:')}" if found.startswith("file:/") and not found.startswith("file://") else found


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    file, system = _open(spark, path)
    out = system.create(file, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def read_text(spark: SparkSession, path: str) -> str:
    file, system = _open(spark, path)
    stream = system.open(file)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def listed(spark: SparkSession, path: str) -> list[str]:
    """The data files of a table's folder in order of name, or the file itself; names that start with . or _ are no data."""
    file, system = _open(spark, path)
    if not system.getFileStatus(file).isDirectory():
        return [file.toString()]
    found, names = system.listFiles(file, True), []
    base = system.makeQualified(file).toString()
    while found.hasNext():
        name = found.next().getPath().toString()
        if not any(part[:1] in "._" for part in name[len(base) :].split("/") if part):
            names.append(name)
    return sorted(names)


def sha256_of(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file, or of the digests of a table's data files in order of name. A file is read as a stream of the JVM, of any size."""
    digests = []
    for name in listed(spark, path):
        file, system = _open(spark, name)
        stream = system.open(file)
        try:
            digests.append(spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream))
        finally:
            stream.close()
    file, system = _open(spark, path)
    return hashlib.sha256("".join(digests).encode()).hexdigest() if system.getFileStatus(file).isDirectory() else digests[0]


def move(spark: SparkSession, source: str, target: str) -> None:
    file, system = _open(spark, source)
    if not system.rename(file, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"{source} can't be moved to {target}")


def make_folder(spark: SparkSession, path: str) -> None:
    file, system = _open(spark, path)
    system.mkdirs(file)


def delete(spark: SparkSession, path: str) -> None:
    file, system = _open(spark, path)
    system.delete(file, True)
