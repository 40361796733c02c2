"""What kind of text files are these? One row per file, from the heads of the files only."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


DELIMITERS = [",", ";", "\t", "|"]  # fixed order: it decides ties
DELIMITER_LINES = 30
QUOTE_LINES = 21
ENCODING_BYTES = 10_000


LINE_BYTES = 1 << 20  # what is read of a file for its first lines, at most


def all_files(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of every file below a path, empty ones included, dealt to tasks.

    A scan leaves empty files out, so the names come from its file index, which the driver holds anyway.
    """
    names = [unquote(name) for name in spark.read.format("binaryFile").load(path).inputFiles()]
    names = [re.sub(r"^file:/+", "file:/", name) for name in names]
    return spark.createDataFrame([(name,) for name in names], "path string").repartition("path")


def _opened(name: str):
    """A file as a stream of bytes, in any file system that Arrow knows."""
    from pyarrow import fs

    scheme, rest = name.split(":", 1)
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    system, inner = fs.FileSystem.from_uri(f"{scheme}://" + rest.removeprefix("//"))
    return system.open_input_file(inner)


def file_heads(
    spark: SparkSession,
    path: str,
    max_lines: int = DELIMITER_LINES,
    max_bytes: int = ENCODING_BYTES,
    line_bytes: int = LINE_BYTES,
) -> DataFrame:
    """``file, head, lines``: the first bytes and the first lines of every file below a path.

    Spark distributes the list of files; a task opens each of its files and stops reading
    after the head, so a folder of huge files costs no more than one of small files. At most
    ``line_bytes`` are looked at for lines, so a longer first line is cut there. Empty files
    have an empty head and no lines.
    """
    schema = "file string, head binary, lines array<binary>"

    def first_lines(data: bytes) -> list[bytes]:
        found, at = [], 0
        while at < len(data) and len(found) < max_lines:
            end = data.find(b"\n", at)
            end = len(data) if end < 0 else end
            found += data[at:end].splitlines() or [b""]
            at = end + 1
        return found[:max_lines]

    def read(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for name in batch["path"]:
                with _opened(name) as stream:
                    data = stream.read(max(max_bytes, line_bytes))
                rows.append((name, data[:max_bytes], first_lines(data[:line_bytes])))
            yield pd.DataFrame(rows, columns=["file", "head", "lines"])

    return all_files(spark, path).mapInPandas(read, schema)


def head_lines(heads: DataFrame) -> DataFrame:
    """``file, line_no, line`` from :func:`file_heads`; line numbers start at 1.

    An empty file has one row with a null line, so that it stays in the profiles.
    """
    lines = heads.select("file", F.posexplode_outer("lines").alias("i", "line"))
    return lines.select("file", (F.coalesce("i", F.lit(0)) + 1).alias("line_no"), F.make_valid_utf8("line").alias("line"))


def encoding_profile(heads: DataFrame) -> DataFrame:
    """``utf8`` or ``utf8-lossy`` per file, judged on its first bytes.

    A character split by the end of the head is not held against the file: up to three
    trailing bytes of an unfinished character are cut off first.
    """
    whole = F.col("head")
    tails = [F.left(whole, F.octet_length(whole) - n) for n in range(4)]
    cut = F.octet_length(whole) >= ENCODING_BYTES
    valid = F.is_valid_utf8(whole.cast("string"))
    for tail in tails[1:]:
        valid = valid | (cut & F.is_valid_utf8(tail.cast("string")))
    return heads.select("file", F.when(valid, F.lit("utf8")).otherwise(F.lit("utf8-lossy")).alias("encoding"))


def delimiter_profile(lines: DataFrame, max_lines: int = DELIMITER_LINES) -> DataFrame:
    """The most frequent of the known delimiters in the first lines of each file.

    Ties, and files with none of them, get the earlier delimiter. Counts are summed inside
    the tasks first, so a file with very many lines sends four numbers per task.
    """
    counts = [
        F.sum(F.char_length("line") - F.char_length(F.replace(F.col("line"), F.lit(d), F.lit("")))).alias(f"d{i}")
        for i, d in enumerate(DELIMITERS)
    ]
    per_file = lines.where(F.col("line_no") <= max_lines).groupBy("file").agg(*counts)
    best = F.greatest(*[F.col(f"d{i}") for i in range(len(DELIMITERS))])
    pick = F.coalesce(*[F.when(F.col(f"d{i}") == best, F.lit(d)) for i, d in enumerate(DELIMITERS)])
    return per_file.select("file", F.coalesce(pick, F.lit(DELIMITERS[0])).alias("delimiter"))


def consistent_delimiter(lines: DataFrame, max_lines: int = DELIMITER_LINES) -> DataFrame:
    """The known delimiter by which most of the first lines of each file have one and the same number of fields.

    Delimiters inside double quotes do not count, and a line that it does not part is no vote for a delimiter. Ties go to
    more fields, then to the earlier delimiter. A file of which no line is parted gets the most frequent delimiter, quotes or
    not, as in :func:`delimiter_profile`. Four rows a line go through partial counts; per file a few numbers are left.
    """
    outside = F.regexp_replace("line", r'"[^"]*("|\z)', "")

    def count(text, d):
        return F.char_length(text) - F.char_length(F.replace(text, F.lit(d), F.lit("")))

    votes = [F.struct(F.lit(-i).alias("d"), (count(outside, d) + 1).alias("fields"), count(F.col("line"), d).alias("all")) for i, d in enumerate(DELIMITERS)]
    each = lines.where(F.col("line_no") <= max_lines).select("file", F.inline(F.array(*votes)))
    counted = each.groupBy("file", "d", "fields").agg(F.count(F.lit(1)).alias("lines"), F.sum("all").alias("all"))
    per = counted.groupBy("file", "d").agg(F.max(F.when(F.col("fields") > 1, F.struct("lines", "fields"))).alias("vote"), F.sum("all").alias("all"))
    best = F.max_by("d", F.struct(F.coalesce("vote.lines", F.lit(0)), F.coalesce("vote.fields", F.lit(0)), F.when(F.col("vote").isNull(), F.coalesce("all", F.lit(0))), "d"))
    names = F.array(*[F.lit(d) for d in DELIMITERS])
    return per.groupBy("file").agg(best.alias("d")).select("file", F.get(names, -F.col("d")).alias("delimiter"))


def has_quotes(lines: DataFrame, max_lines: int = QUOTE_LINES) -> DataFrame:
    """Is there a quote of either kind in the first lines of each file?"""
    quoted = F.contains(F.col("line"), F.lit('"')) | F.contains(F.col("line"), F.lit("'"))
    seen = lines.where(F.col("line_no") <= max_lines).groupBy("file").agg(F.bool_or(quoted).alias("q"))
    return seen.select("file", F.coalesce("q", F.lit(False)).alias("has_quotes"))


def text_lines(df: DataFrame, file: str, text: str, max_lines: int) -> DataFrame:
    """Treat every row as a file: ``file, line_no, line`` of the first lines of its text."""
    first = F.slice(F.split(F.col(text), "\n", max_lines + 1), 1, max_lines)
    lines = df.select(F.col(file).alias("file"), F.posexplode(first).alias("i", "line"))
    return lines.select("file", (F.col("i") + 1).alias("line_no"), "line")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file's bytes, read in chunks by the tasks; a file may have any size."""

    def digest(batches):
        import hashlib

        import pandas as pd

        for batch in batches:
            hashes = []
            for name in batch["path"]:
                total = hashlib.sha256()
                with _opened(name) as stream:
                    while chunk := stream.read(4 << 20):
                        total.update(chunk)
                hashes.append(total.hexdigest())
            yield pd.DataFrame({"path": batch["path"], "content_hash": hashes})

    return all_files(spark, path).mapInPandas(digest, "path string, content_hash string")


def strip_quotes_files(spark: SparkSession, path: str, out: str) -> None:
    """Copy text files without any quote character."""
    lines = spark.read.text(path)
    lines.select(F.translate("value", "\"'", "").alias("value")).write.text(out)
