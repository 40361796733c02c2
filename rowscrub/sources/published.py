"""Tables in versions: a new version is written beside the others, and a pointer that is swapped last makes it the current one.

A job that fails leaves the current version as it was, and readers of the version before go on. The swap is one rename,
which is atomic in HDFS and local file systems; object stores need a committer or a catalogue that gives the same.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from rowscrub.session import discard
from rowscrub.sources.sinks import write_parquet

POINTER = "_current"
KEPT = 2  # versions that stay: the current one, and the one before for its readers


def _system(spark: SparkSession, path: str):
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def pointer(spark: SparkSession, folder: str) -> dict | None:
    """What the pointer says: ``versions``, newest first, and the ``state`` given with the newest; None where nothing is published."""
    location, system = _system(spark, f"{folder.rstrip('/')}/{POINTER}")
    if not system.exists(location):
        return None
    stream = system.open(location)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def read_published(spark: SparkSession, folder: str) -> DataFrame:
    """The current version; this frame keeps reading it when another one is published."""
    found = pointer(spark, folder)
    if found is None:
        raise FileNotFoundError(f"nothing is published in {folder}")
    return spark.read.parquet(f"{folder.rstrip('/')}/{found['versions'][0]}")


def publish(df: DataFrame, folder: str, state: str = "", codec: str = "zstd") -> DataFrame:
    """Write a frame as the next version of a table and make it the current one; returns it as read from there.

    The frame may read the current version. Of two jobs that publish at the same time the one that ends last is current. Versions
    older than the one before go; those of failed jobs, to which no pointer has ever pointed, are removed by the failing job.
    """
    spark = df.sparkSession
    folder = folder.rstrip("/")
    version = f"version-{uuid.uuid4().hex}"
    try:
        write_parquet(df, f"{folder}/{version}", codec)
    except BaseException:
        discard(spark, f"{folder}/{version}")
        raise
    versions = [version, *(pointer(spark, folder) or {"versions": []})["versions"]]
    _swap(spark, folder, json.dumps({"versions": versions[:KEPT], "state": state}))
    for old in versions[KEPT:]:
        discard(spark, f"{folder}/{old}")
    return read_published(spark, folder)


def _swap(spark: SparkSession, folder: str, text: str) -> None:
    """Replace the pointer in one rename."""
    new, system = _system(spark, f"{folder}/_next-{uuid.uuid4().hex}")
    stream = system.create(new, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(context.makeQualified(new), context.makeQualified(hadoop.Path(f"{folder}/{POINTER}")), options)
