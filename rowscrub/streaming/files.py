"""The standard cleaning job over files as they arrive."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Literal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowscrub.operators.columns import ref
from rowscrub.operators.rows import dedup_keys
from rowscrub.plans.settings import Workflow
from rowscrub.plans.workflow import clean_rows
from rowscrub.sources.readers import inferred_types, read_marker, scan_plain, with_types, write_marker

Duplicates = Literal["all_time", "watermark", "keep"]


def stream_files(spark: SparkSession, path: str, like: DataFrame | None = None, fmt: str = "parquet",
                 files_per_batch: int | None = None, **options) -> DataFrame:
    """A stream of the files below a path. A stream needs its schema up front: that of ``like``."""
    schema = (like if like is not None else spark.read.format(fmt).options(**options).load(path)).schema
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def clean_stream(
    stream: DataFrame,
    wf: Workflow,
    duplicates: Duplicates,
    event_time: str | None = None,
    delay: str = "1 hour",
    salts: int = 16,
) -> DataFrame:
    """The standard job on a stream.

    ``duplicates`` must be chosen: ``all_time`` remembers every key for good (state grows
    with the number of distinct keys), ``watermark`` forgets keys older than ``delay`` of
    ``event_time``, which must still be a top-level column after nesting, and ``keep``
    removes none.

    A stream has no partial aggregation, so all copies of a key would meet in one task. They
    are first thinned out per key and salt (the number of the reading task), spread over
    ``salts`` tasks, which leaves at most ``salts`` copies of any key for the final removal.
    That step remembers every key once more; ``salts=1`` leaves it out. The state holds a hash of 32 bytes for
    each key, whatever the length of its texts.
    """
    if duplicates == "watermark":
        if not event_time:
            raise ValueError("duplicates='watermark' needs event_time")
        stream = stream.withWatermark(event_time, delay)
    cleaned, renamed = clean_rows(stream, wf)
    if duplicates == "keep":
        return cleaned
    keys = dedup_keys(cleaned.columns, renamed.unique_columns)

    hashed, salt = (name + "_" * max(map(len, cleaned.columns)) for name in ("key", "salt"))
    whole = F.to_json(F.struct(*[ref(k) for k in keys]), {"ignoreNullFields": "false"})
    cleaned = cleaned.withColumn(hashed, F.unhex(F.sha2(whole, 256)))

    def once(df: DataFrame, key: list[str]) -> DataFrame:
        return df.dropDuplicatesWithinWatermark(key) if duplicates == "watermark" else df.dropDuplicates(key)

    if salts > 1:
        salted = cleaned.withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(salts)))
        cleaned = once(salted, [hashed, salt]).drop(salt)
    return once(cleaned, [hashed]).drop(hashed)


def run_stream(
    stream: DataFrame,
    wf: Workflow,
    out: str,
    checkpoint: str,
    duplicates: Duplicates,
    event_time: str | None = None,
    delay: str = "1 hour",
    salts: int = 16,
) -> None:
    """Clean all files there are now, append them to a Parquet table, and stop.

    Run it again, with the same checkpoint, when more files have arrived. For ``all_time``
    on large streams use the RocksDB state store, which keeps its keys on disk.
    """
    cleaned = clean_stream(stream, wf, duplicates, event_time, delay, salts)
    writer = cleaned.writeStream.format("parquet").option("compression", "zstd").outputMode("append")
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()


def stage_delimited(
    spark: SparkSession,
    path: str,
    folder: str,
    delimiter: str = ",",
    types: Mapping[str, str] | None = None,
    strict: bool = True,
    files_per_batch: int | None = None,
) -> DataFrame | None:
    """Read the delimited files that have arrived below a path as :func:`scan_plain` does, into Parquet files of one schema.

    Only the names of files are streamed; every batch reads its files whole, so that quoted newlines, headers and files of
    several blocks are as in the batch job. Columns and types are fixed once: those given, or else what all rows of the
    first batch fit; they are kept in the folder. Later cells that do not fit, and later columns, fail the batch, or
    without ``strict`` are null or left out. A batch writes a folder of its own and replaces it when it has to run
    again. Returns an empty table with the schema, or None if no file has arrived yet.
    """
    folder = folder.rstrip("/")

    def read(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        names = [row["path"] for row in batch.select("path").collect()]  # as many as a batch has files
        if not names:
            return
        rows = scan_plain(session, names, delimiter, infer=False)
        known = read_marker(session, f"{folder}/types")
        if known is None:
            known = json.dumps(dict(types) if types else inferred_types(rows))
            write_marker(session, f"{folder}/types", known)
        with_types(rows, json.loads(known), strict).write.mode("overwrite").parquet(f"{folder}/rows/{number}")

    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    names = reader.load(path).select("path")
    names.writeStream.foreachBatch(read).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    known = read_marker(spark, f"{folder}/types")
    if known is None:
        return None
    fields = ", ".join("`" + name.replace("`", "``") + f"` {kind}" for name, kind in json.loads(known).items())
    return spark.createDataFrame([], fields)


def run_delimited_stream(
    spark: SparkSession,
    path: str,
    wf: Workflow,
    out: str,
    checkpoint: str,
    duplicates: Duplicates,
    delimiter: str = ",",
    types: Mapping[str, str] | None = None,
    strict: bool = True,
    files_per_batch: int | None = None,
    salts: int = 16,
) -> None:
    """:func:`run_stream` for delimited files: first into Parquet files (:func:`stage_delimited`), then the job over these.

    Both steps keep what they have done below ``checkpoint``. The second one starts when the first one has finished, so it
    never sees the files of an unfinished batch. The staged files may be deleted once a run has ended.
    """
    staged = f"{checkpoint.rstrip('/')}/delimited"
    like = stage_delimited(spark, path, staged, delimiter, types, strict, files_per_batch)
    if like is not None:
        stream = stream_files(spark, f"{staged}/rows/*", like=like, files_per_batch=files_per_batch)
        run_stream(stream, wf, out, f"{checkpoint.rstrip('/')}/rows", duplicates, salts=salts)
