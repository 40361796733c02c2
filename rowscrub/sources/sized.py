"""Parquet files of an asked size, named by their place, and slices of tables by row position.

Rows keep their order. A table is written once as it comes; from the sizes of these files follows how many bytes a row takes,
and so at which rows the files asked for begin; where they are many, a few are written first, as small files compress
less than large ones. If the files, once written, miss the size, their own sizes say more, and the cuts are made again.
"""

from __future__ import annotations

import uuid
from statistics import median
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowscrub.operators.columns import ref
from rowscrub.operators.records import broadcast_bytes, running_total
from rowscrub.session import discard, via_table
from rowscrub.sources.sinks import parquet_writer, write_parquet

CELLS = 64  # cuts lie between cells of rows; a file has about so many, if its rows are of like size
CELL_ROWS = 4096  # rows of a cell, at most
ROUNDS = 4  # writes after the first
PILOTS = 16  # files that are written to see how large they come out, where there are many
CUT_BYTES, FILE_BYTES = 16, 256  # of the broadcast table of cuts: of a cut, and of a block with the path of its file
TASK_BYTES = 32 << 20  # of the files that a task writes, if there are many small ones
TASKS_PER_CORE = 3


def write_sized(
    df: DataFrame,
    path: str,
    target_mb: float = 100,
    codec: str = "zstd",
    name: str | None = None,
    mode: str = "errorifexists",
    tolerance: float = 0.15,
) -> list[int]:
    """Parquet files ``<name>_part_<i>.parquet`` of ``target_mb`` each, the last one of what is left; returns their bytes.

    Small tasks are merged and large ones split, whatever the lengths of their rows. Files end between cells of rows, so that a row
    longer than a cell, or a table that never packs evenly, may leave a file beyond ``tolerance`` after the last
    of a few rounds; no row is lost by that. All work lies in a hidden folder beside ``path``, which gets its name when complete. A table
    without rows is one file. Names default to the last part of ``path``. Nulls and empty texts count as one byte.
    """
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError(f"mode {mode}: only errorifexists and overwrite")
    spark = df.sparkSession
    target = max(int(target_mb * (1 << 20)), 1)
    folder = path.rstrip("/")
    parent, last = folder.rsplit("/", 1) if "/" in folder else (".", folder)
    if mode == "errorifexists" and _exists(spark, folder):
        raise FileExistsError(folder)
    work = f"{parent}/_{last}-{uuid.uuid4().hex}"
    try:
        current = f"{work}/0"
        write_parquet(df, current, codec)
        files = _sizes(spark, current)
        for i in range(1, ROUNDS + 1):
            if _fits(files, target, tolerance):
                break
            cells = _cells(spark, current, df.schema, target)
            if cells is None:
                files = files[:1]  # no rows
                break
            factor = _factor(spark, cells, target, codec, f"{work}/pilots") if i == 1 else 1.0
            before, current = current, f"{work}/{i}"
            _write_parts(_cut(spark, cells, target, factor), current, codec)
            files = _sizes(spark, current)
            discard(spark, before)
        _publish(spark, files, f"{work}/out", folder, name or last.removesuffix(".parquet"), mode)
    finally:
        discard(spark, work)
    return [size for _, size in files]


def _write_parts(df: DataFrame, path: str, codec: str) -> None:
    """One folder and file for each value of the last column, whose rows lie together and in order."""
    # A bound on rows per file, if the session has one, would cut files once more.
    writer = parquet_writer(df, codec).option("maxRecordsPerFile", 0)
    writer.partitionBy(df.columns[-1]).parquet(path)


def _place(file: Column) -> Column:
    """Sorts files by their part, if they have one, and by name."""
    return F.concat(F.lpad(F.regexp_extract(file, r"=(\d+)/[^/]*\z", 1), 12, "0"), F.lit("/"), F.regexp_extract(file, r"[^/]*\z", 0))


def _sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and bytes of the data files of a written table, in order of their rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    found = files.select("path", "length", _place(F.col("path")).alias("place")).orderBy("place").collect()  # one row for each file
    return [(row["path"], row["length"]) for row in found]


def _fits(files: list[tuple[str, int]], target: int, tolerance: float) -> bool:
    sizes = [size for _, size in files]
    return all(abs(size - target) <= tolerance * target for size in sizes[:-1]) and all(s <= (1 + tolerance) * target for s in sizes[-1:])


def _weight(df: DataFrame) -> Column:
    """Bytes of a row, before compression and but for a factor."""
    weight = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = F.octet_length(ref(name))
        elif kind.startswith(("array", "map", "struct")):
            size = F.octet_length(F.to_json(F.struct(ref(name))))
        else:
            size = F.when(ref(name).isNotNull(), F.lit(8))
        weight = weight + F.coalesce(size, F.lit(0)) + 1
    return weight


class Cells(NamedTuple):
    """A written table, and where its cells of rows begin, in bytes from the start of the table."""

    table: DataFrame
    names: list[str]
    """Its columns, without the one that its folders may add."""
    placed: DataFrame
    rows: int
    """Rows of a cell."""
    block: int
    """Cells of a block, which has about the rows of a part."""
    files: int
    size: int


def _cells(spark: SparkSession, path: str, schema, target: int) -> Cells | None:
    """The cells of a written table; none for no rows."""
    table = spark.read.schema(schema).parquet(path)
    meta = table.metadataColumn("_metadata")
    light = table.select(*_places(table), meta["file_size"].alias("size"), _weight(table.select(*[ref(name) for name in schema.names])).alias("weight"))
    files = light.groupBy("path").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("weight"), F.max("weight").alias("most"))
    # What a file's name says is taken apart once for each file, not for each row.
    files = via_table(files.select("*", _place(F.col("path")).alias("file"), (F.col("size") / F.col("weight")).alias("bytes_per")), "file-weights")
    heaviest = F.max(F.col("most") * F.col("bytes_per")).alias("most")
    known = files.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum("rows").alias("rows"), heaviest).first()
    if not known["n"]:
        return None
    rows = int(min(max(target / CELLS / max(known["most"], 1e-9), 1), CELL_ROWS))
    # Cells in blocks of about the rows of a part: a row looks for its part among the few cuts of its block, however many its file has.
    block = max(int(known["rows"] * target / known["size"] / rows), 1)
    before = running_total(files, "file", "size", "file_start")
    cells = light.groupBy("path", F.expr(f"at div {rows}").alias("cell")).agg(F.sum("weight").alias("weight"))
    inside = Window.partitionBy("path").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.coalesce(F.sum("weight").over(inside), F.lit(0)) + F.col("weight") / 2
    begun = files.select("path", "file", "bytes_per").join(before, "file").drop("file")
    placed = cells.select("path", "cell", so_far.alias("so_far")).join(begun, "path")
    placed = placed.select("path", "file_start", "cell", (F.col("file_start") + F.col("so_far") * F.col("bytes_per")).alias("byte"))
    return Cells(table, schema.names, via_table(placed, "cells"), rows, block, known["n"], known["size"])


def _factor(spark: SparkSession, cells: Cells, target: int, codec: str, path: str) -> float:
    """How much larger files of the asked size come out than a table of other files says: by a few of them, written for that."""
    parts = cells.size // target
    if parts < 4 * PILOTS:
        return 1.0
    _write_parts(_cut(spark, cells, target, 1.0, [i * parts // PILOTS for i in range(PILOTS)]), path, codec)
    sizes = [size for _, size in _sizes(spark, path)]
    return median(sizes) / target if sizes else 1.0


def _places(table: DataFrame) -> list[Column]:
    meta = table.metadataColumn("_metadata")
    return [meta["file_path"].alias("path"), meta["row_index"].alias("at")]


def _cut(spark: SparkSession, cells: Cells, target: int, factor: float, chosen: list[int] | None = None) -> DataFrame:
    """The rows with the number of their file as last column, lying together by it; of all files, or of the chosen ones."""
    table, placed = cells.table, cells.placed
    part = F.floor(F.col("byte") * factor / target)
    first = (F.min("cell") * cells.rows).alias("start")
    starts = placed.groupBy("path", "file_start", F.expr(f"cell div {cells.block}").alias("block"), part.alias("part")).agg(first)
    listed = F.array_sort(F.collect_list(F.struct("start", "part"))).alias("cuts")
    cuts = via_table(starts.groupBy("path", "file_start", "block").agg(listed), "cuts")
    if chosen is not None:
        cuts = cuts.where(F.exists("cuts", lambda c: c["part"].isin(chosen)))
    parts = int(cells.size * factor / target) + 1
    if (cells.files + parts) * (FILE_BYTES + CUT_BYTES) <= broadcast_bytes(spark):
        cuts = F.broadcast(cuts)
    number = "part" + "_" * max(map(len, cells.names))
    row = F.struct(*[ref(name) for name in cells.names]).alias("row")
    dealt = table.select(row, *_places(table)).withColumn("block", F.expr(f"at div {cells.rows * cells.block}")).join(cuts, ["path", "block"])
    started = F.filter("cuts", lambda c: c["start"] <= F.col("at"))
    numbered = dealt.select("row", "file_start", "at", F.element_at(started, -1)["part"].alias(number))
    if chosen is not None:
        numbered = numbered.where(F.col(number).isin(chosen))
    # Neighbouring parts share a task where they are small, so that tasks grow with the bytes and not with the number of files.
    tasks = int(min(parts, max(cells.size * factor // TASK_BYTES + 1, TASKS_PER_CORE * spark.sparkContext.defaultParallelism)))
    task = F.least(F.floor(F.col(number) * F.lit(tasks / parts)), F.lit(tasks - 1)).cast("int")
    together = numbered.repartitionById(tasks, task).sortWithinPartitions(number, "file_start", "at")
    return together.select(*[F.col("row")[name].alias(name) for name in cells.names], number)


def _files_of(spark: SparkSession, path: str):
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    location, system = _files_of(spark, path)
    return system.exists(location)


def _move(spark: SparkSession, moves: list[tuple[str, str]]) -> None:
    """Rename files or folders, all of one file system."""
    if not moves:
        return
    system = _files_of(spark, moves[0][0])[1]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path  # looked up once: each look-up is many calls
    for source, target in moves:
        if not system.rename(path(source), path(target)):
            raise OSError(f"cannot rename {source} to {target}")


def _publish(spark: SparkSession, files: list[tuple[str, int]], staged: str, folder: str, name: str, mode: str) -> None:
    """Rename files by their place and then the whole folder; a table that is replaced goes when its successor is there."""
    location, system = _files_of(spark, staged)
    system.mkdirs(location)
    _move(spark, [(file, f"{staged}/{name}_part_{i}.parquet") for i, (file, _) in enumerate(files, 1)])
    if mode == "overwrite" and _exists(spark, folder):
        _move(spark, [(folder, staged + "-old")])
    _move(spark, [(staged, folder)])


def slice_table(spark: SparkSession, path: str, offset: int, length: int) -> DataFrame:
    """Rows ``offset`` to ``offset + length`` of a Parquet table, by the names of its files and the places of rows in them.

    Rows are counted from the footers of the files; only files that hold rows of the slice are read, each by its own tasks, so a slice may be
    as large as the table. A slice that begins beyond the table is empty. Files named ``..._part_<i>`` are taken by number.
    """
    if offset < 0 or length < 0:
        raise ValueError("offset and length must not be negative")
    table = spark.read.parquet(path)
    file = table.metadataColumn("_metadata")["file_path"]
    counted = via_table(table.groupBy(file.alias("path")).agg(F.count(F.lit(1)).alias("rows")), "file-rows")
    stem, number = F.regexp_extract("path", r"\A(.*_part_)\d+\.parquet\z", 1), F.regexp_extract("path", r"_part_(\d+)\.parquet\z", 1)
    place = F.when(stem != "", F.concat(stem, F.lpad(number, 18, "0"))).otherwise(F.col("path"))
    counted = counted.withColumn("place", place)
    if not counted.head(1):
        return table.limit(0)
    placed = counted.join(running_total(counted, "place", "rows", "start"), "place")
    wanted = placed.where((F.col("start") < offset + length) & (F.col("start") + F.col("rows") > offset)).select("path", "start").collect()
    if not wanted:
        return table.limit(0)
    names = [row["path"] for row in wanted]  # names of files that the scan lists on the driver anyway
    starts = spark.createDataFrame([(row["path"], row["start"]) for row in wanted], "path string, start long")
    chosen = spark.read.schema(table.schema).option("basePath", path).parquet(*names)
    meta = chosen.metadataColumn("_metadata")
    row = F.struct(*[ref(name) for name in table.columns]).alias("row")
    rows = chosen.select(row, meta["file_path"].alias("path"), meta["row_index"].alias("at")).join(starts, "path")
    at = F.col("start") + F.col("at")
    inside = rows.where((at >= offset) & (at < offset + length))
    return inside.select(*[F.col("row")[name].alias(name) for name in table.columns])
