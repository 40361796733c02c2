"""Records of text files: their numbers, and records that run over several lines.

Line by line, a record number is the position inside the block that a task reads plus the
records before that block, so numbering needs one small table of blocks and no sort.

Whether a line starts inside a quoted field depends on all lines before it, but every line
only does one of four things to that state: keep it, flip it, or set it to open or closed.
One pass reduces each block to its overall effect, for both states that it may start in; the effects are chained over the
few rows of the block table. Records that cross a block border, and headers, are then picked out by plain filters and
written aside; all other records lie inside their block and are joined in the one pass that yields them. Where no
line opens or closes a quoted field for the next one, lines are records and nothing but filters runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowscrub.functions.fields import open_quote
from rowscrub.functions.text import drop_bad_utf8
from rowscrub.operators.columns import ref
from rowscrub.session import via_table

BLOCK_ROW_BYTES = 64  # of a broadcast row: file hash, block, and up to four numbers
RECORD_LIMIT = 1 << 26  # characters of a record; a longer one is cut there and marked


def broadcast_bytes(spark: SparkSession) -> int:
    """Largest block table that is broadcast: an eighth of an executor's memory.

    With a row for each 128 MB of input, 100 TB make a table of about 50 MB.
    """
    memory = spark.sparkContext.getConf().get("spark.executor.memory", "1g")
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", memory.strip().lower()).groups()
    return (int(number) << {"": 20, "k": 10, "m": 20, "g": 30, "t": 40}[unit]) // 8


def scan_lines(spark: SparkSession, path: str | Sequence[str], line_end: str | None = None) -> DataFrame:
    """``file, block, seq, value`` of text files, bad bytes dropped.

    ``seq`` grows along the lines of a block. A block is a piece of a file that one task
    reads. Without ``line_end`` a line ends at LF, CR LF or CR.
    """
    raw = (spark.read.option("lineSep", line_end) if line_end else spark.read).text(path if isinstance(path, str) else list(path))
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(drop_bad_utf8(F.col("value"))).alias("value"),
    )


@contextmanager
def pinned_blocks(spark: SparkSession) -> Iterator[None]:
    """Scans of the same files inside cut and pack blocks alike.

    For small inputs Spark sizes blocks by the current number of cores, which changes as executors come
    and go. It is fixed here, unless it is set already, and released afterwards. A scan that runs later and
    cuts differently fails, as its lines are not where they were counted.
    """
    key = "spark.sql.files.minPartitionNum"
    unset = spark.conf.get(key, None) is None
    if unset:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if unset:
            spark.conf.unset(key)


def block_offsets(lines: DataFrame, scope: str = "file") -> DataFrame:
    """Per block: its first ``seq``, how many records come before it, and the first line of a file's first block.

    One row per block of the input (128 MB by default), so the running sum handles a
    table many orders smaller than the data. ``scope='file'`` starts anew in every file,
    ``scope='dataset'`` counts through the files in name order.
    """
    head = F.min_by(F.when(F.col("block") == 0, F.col("value")), "seq")
    blocks = lines.groupBy("file", "block").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("records"), head.alias("head")
    )
    blocks = via_table(blocks, "blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per_block = blocks.withColumn("in_file", F.coalesce(F.sum("records").over(before), F.lit(0)))
    if scope == "file":
        return per_block.withColumn("offset", F.col("in_file"))
    files = blocks.groupBy("file").agg(F.sum("records").alias("records"))
    starts = running_total(files, "file", "records", "file_start")
    return per_block.join(starts, "file").withColumn("offset", F.col("in_file") + F.col("file_start"))


def running_total(df: DataFrame, key: str, amount: str, name: str) -> DataFrame:
    """``key`` and the sum of ``amount`` over all rows with a smaller key, in two levels.

    Rows are dealt to tasks by ranges of the key and summed up there; what comes before a range is the sum of the
    few numbers of the ranges before it. Keys are distinct.
    """
    part = F.spark_partition_id()
    ranged = via_table(df.select(key, amount).repartitionByRange(key).select("*", part.alias("part")), "ranges")
    totals = ranged.groupBy("part").agg(F.sum(amount).alias("total")).orderBy("part").collect()  # one row for each task
    before, so_far = [], 0
    for row in totals:
        before.append((row["part"], so_far))
        so_far += row["total"]
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "part int, before long"))
    inside = Window.partitionBy("part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(starts, "part").select(key, (F.col("before") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).alias(name))


def number_records(lines: DataFrame, scope: str = "file") -> DataFrame:
    """Add ``row_number``, 1 for the first record, to :func:`scan_lines` output, without a sort.

    Position inside the block plus records before the block. The block table is broadcast
    while its size is known to fit (see :func:`broadcast_bytes`); beyond that the join runs by
    (file, block), whose groups are one block each and therefore even. A line whose block is not
    found as counted fails the job instead of getting a wrong number.
    """
    return _numbered(lines, block_offsets(lines, scope))


def number_data(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines of :func:`scan_lines` numbered from 2 in every file, and ``file, header``: the first line of each."""
    offsets = block_offsets(lines)
    heads = offsets.where("block = 0").select("file", F.col("head").alias("header"))
    return _numbered(lines, offsets).where("row_number > 1"), heads


def _numbered(lines: DataFrame, offsets: DataFrame) -> DataFrame:
    offsets = offsets.select("file", "block", "first_seq", "last_seq", "offset")
    joined = _with_blocks(lines, offsets, "offset")[0]
    number = F.col("seq") - F.col("first_seq") + F.col("offset") + 1
    return joined.select(*[ref(c) for c in lines.columns], number.alias("row_number"))


def _with_blocks(lines: DataFrame, blocks: DataFrame, checked: str) -> tuple[DataFrame, bool]:
    """Lines with the columns of their block, and whether the block table was broadcast.

    A broadcast table names files by a 64-bit hash; that no two files share one is checked here. A
    line that is not where its block was counted fails the job when ``checked`` is read.
    """
    known = blocks.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"), F.countDistinct(F.xxhash64("file")).alias("hashes")).first()
    small = known["n"] * BLOCK_ROW_BYTES <= broadcast_bytes(lines.sparkSession) and known["files"] == known["hashes"]
    if small:
        hashed = blocks.withColumn("file_hash", F.xxhash64("file")).drop("file")
        joined = lines.withColumn("file_hash", F.xxhash64("file")).join(F.broadcast(hashed), ["file_hash", "block"], "left").drop("file_hash")
    else:
        joined = lines.join(blocks, ["file", "block"], "left")
    same = F.col("seq").between(F.col("first_seq"), F.col("last_seq"))
    changed = F.raise_error(F.lit("blocks changed between two scans")).cast("bigint")
    return joined.withColumn(checked, F.when(same, F.col(checked)).otherwise(changed)), small


def line_effects(lines: DataFrame, delimiter: str) -> DataFrame:
    """Add ``opens`` and ``stays``: is a quote open after the line if none, or one, was before?"""
    value = F.col("value")
    quoted = F.contains(value, F.lit('"'))
    stays = F.when(quoted, open_quote(F.concat(F.lit('"'), value), delimiter)).otherwise(F.lit(True))
    return lines.select("*", open_quote(value, delimiter).alias("opens"), stays.alias("stays"))


def _chain():
    """A function that runs the state through lines; made here so that it travels to the tasks."""

    def chain(state, opens, stays):
        """Was a quote open before each line, and is one open after the last?"""
        import numpy as np

        fixed = np.maximum.accumulate(np.where(opens == stays, np.arange(len(opens)), -1))
        flips = np.cumsum(opens & ~stays)
        base = np.where(fixed >= 0, opens[fixed], state)
        after = base ^ ((flips - np.where(fixed >= 0, flips[fixed], 0)) % 2 == 1)
        return np.concatenate([[state], after[:-1]]).astype(bool), bool(after[-1])

    return chain


def block_effects(lines: DataFrame) -> DataFrame:
    """Per block: first and last ``seq``; whether any line leaves a quote open that was not; and for both states it may start in (closed, open):
    the state after it, how many records start in it, and where the first, the second and the last of them start."""
    sides = [f"{c}_{side}" for side in ("closed", "open") for c in ("end", "starts", "first", "second", "last")]
    kinds = ["boolean" if c.startswith("end") else "long" for c in sides]
    schema = "file string, block long, first_seq long, last_seq long, opens boolean, " + ", ".join(map(" ".join, zip(sides, kinds, strict=True)))
    columns = [c.split()[0] for c in schema.split(", ")]
    chain = _chain()

    def reduce_blocks(batches: Iterator) -> Iterator:
        import pandas as pd

        key, row, both = None, None, None

        def finished():
            return (*key, *row, *both[0], *both[1])

        for batch in batches:
            done = []
            for part_key, part in batch.groupby(["file", "block"], sort=False):
                seq, opens, stays = part["seq"].to_numpy(), part["opens"].to_numpy(bool), part["stays"].to_numpy(bool)
                if part_key != key:
                    if row:
                        done.append(finished())
                    key, row = part_key, [seq[0], None, False]
                    both = [[False, 0, None, None, None], [True, 0, None, None, None]]
                row[1] = seq[-1]
                row[2] |= bool(opens.any())
                for side in both:
                    before, side[0] = chain(side[0], opens, stays)
                    at = seq[~before].tolist()
                    side[1] += len(at)
                    side[2:4] = ([place for place in side[2:4] if place is not None] + at[:2] + [None, None])[:2]
                    side[4] = at[-1] if at else side[4]
            yield pd.DataFrame(done, columns=columns, dtype=object)
        if row:
            yield pd.DataFrame([finished()], columns=columns, dtype=object)

    return lines.select("file", "block", "seq", "opens", "stays").mapInPandas(reduce_blocks, schema)


def block_starts(effects: DataFrame) -> DataFrame:
    """Per block, now that its start is known: how many records start before it in its file and in it; where the first one and the
    second one start; and where the one starts that goes on in the next block, if one does."""
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    flip = (F.col("end_closed") & ~F.col("end_open")).cast("int")
    so_far = effects.withColumn("flips", F.sum(flip).over(order))
    # The last block that leaves a fixed state, then the flips since.
    fixed = F.when(F.col("end_closed") == F.col("end_open"), F.struct("end_closed", "flips"))
    chained = so_far.select(
        "*", F.last(fixed, ignorenulls=True).over(before).alias("fixed"), F.lag("flips", 1, 0).over(order).alias("before")
    )
    state = F.coalesce("fixed.end_closed", F.lit(False))
    odd = (F.col("before") - F.coalesce("fixed.flips", F.lit(0))) % 2 == 1
    opened = chained.withColumn("inside", state != odd)
    actual = [F.when(F.col("inside"), F.col(f"{c}_open")).otherwise(F.col(f"{c}_closed")).alias(c) for c in ("end", "starts", "first", "second", "last")]
    known = opened.select("file", "block", "first_seq", "last_seq", *actual)
    earlier = F.coalesce(F.sum("starts").over(before), F.lit(0))
    last = F.when(F.col("end"), F.col("last"))
    return known.select("file", "block", "first_seq", "last_seq", earlier.alias("earlier"), "starts", "first", "second", last.alias("open_from"))


def _joined_by_number(limit: int):
    """A function that joins neighbouring lines of one record number; ``chars`` is the length of the whole, ``value`` its first ``limit`` characters."""

    def join_lines(batches: Iterator) -> Iterator:
        import pandas as pd

        key, texts, chars = None, [], 0

        def closed():
            return (*key, chars, "\n".join(texts)[:limit])

        for batch in batches:
            done = []
            for part_key, part in batch.groupby(["file", "block", "row_number"], sort=False):
                if part_key != key:
                    if texts:
                        done.append(closed())
                    key, texts, chars = part_key, [], -1
                for text in part["value"]:
                    if chars <= limit:
                        texts.append(text)
                    chars += len(text) + 1
            yield pd.DataFrame(done, columns=["file", "block", "row_number", "chars", "value"])
        if texts:
            yield pd.DataFrame([closed()], columns=["file", "block", "row_number", "chars", "value"])

    return join_lines


def _joined_inside(limit: int):
    """A function that joins the lines of records that begin and end in a block, whose first line begins one."""
    columns = ["file", "row_number", "value", "chars"]
    chain = _chain()

    def join_lines(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        # The record that is still open: its number, its lines as far as they are kept, and all their characters.
        key, state, number, texts, chars, held = None, False, 0, [], 0, 0

        def frame(numbers, values, lengths):
            return pd.DataFrame({"row_number": numbers, "value": values, "chars": lengths}).assign(file=key[0])

        def closed():
            return frame([number], ["\n".join(texts)[:limit]], [chars])

        def hold(values):
            nonlocal chars, held
            for text in values:
                if chars <= limit:
                    texts.append(text)
                chars += len(text) + (held > 0)
                held += 1

        for batch in batches:
            out = []
            for part_key, part in batch.groupby(["file", "block"], sort=False):
                if part_key != key:
                    if held:
                        out.append(closed())
                    key, state, texts, chars, held = part_key, False, [], 0, 0
                    number = int(part["number"].iloc[0])
                before, state = chain(state, part["opens"].to_numpy(bool), part["stays"].to_numpy(bool))
                record = np.cumsum(~before)
                values, last = part["value"].to_numpy(object), record[-1]
                hold(values[record == 0])
                if last == 0:
                    continue
                if held:
                    out.append(closed())
                single = np.bincount(record)[record] == 1
                inner = (record > 0) & (record < last)
                alone = pd.Series(values[inner & single], dtype=object)
                out.append(frame(number + record[inner & single], alone.str.slice(0, limit), alone.str.len()))
                joined = pd.Series(values[inner & ~single], dtype=object).groupby(record[inner & ~single]).agg("\n".join)
                out.append(frame(number + joined.index.to_numpy(), joined.str.slice(0, limit).to_numpy(), joined.str.len().to_numpy()))
                number, texts, chars, held = number + int(last), [], 0, 0
                hold(values[record == last])
            if out:
                yield pd.concat(out)[columns]
        if held:
            yield closed()[columns]

    return join_lines


def split_records(
    spark: SparkSession, path: str | Sequence[str], delimiter: str = ",", limit: int = RECORD_LIMIT
) -> tuple[DataFrame, DataFrame]:
    """The first record of each file, and all others: ``file, row_number, value, chars``, numbered from 1 in each file.

    Lines end in LF or CR LF; inside quotes both are kept. An open quote at the end of a file ends
    there. ``chars`` is the length of the record; one of more than ``limit`` characters, as after a quote that
    was never closed, has the first ``limit`` of them as its value, whatever blocks and batches it runs over.

    The text is read once for the effects of blocks and once for what is written aside; what is returned reads it once more.
    """
    with pinned_blocks(spark):
        lines = line_effects(scan_lines(spark, path, "\n"), delimiter)
        effects = via_table(block_effects(lines), "block-effects")
        plain = effects.where("opens").isEmpty()
        starts = via_table(block_starts(effects), "block-starts")
        known, in_order = _with_blocks(lines, starts, "earlier")
        seq, first, open_from, earlier = (F.col(c) for c in ("seq", "first", "open_from", "earlier"))
        # Lines that go on from the block before, lines of the record that goes on in the next one, lines of the header.
        number = (
            F.when(first.isNull() | (seq < first), earlier)
            .when(seq >= open_from, earlier + F.col("starts"))
            .when((F.col("block") == 0) & (seq < F.coalesce("second", F.col("last_seq") + 1)), F.lit(1))
        )
        known = known.withColumn("row_number", number)

        def ordered(df: DataFrame) -> DataFrame:
            # A shuffled join has lost the order of the lines.
            return df if in_order else df.repartition("file", "block").sortWithinPartitions("file", "block", "seq")

        lines_aside = ordered(known.where(F.col("row_number").isNotNull())).select("file", "block", "row_number", "value")
        pieces = "file string, block long, row_number long, chars long, value string"
        aside = via_table(lines_aside.mapInPandas(_joined_by_number(limit), pieces), "records-aside")
    # Of a record over many blocks only the pieces that begin within the limit are brought together.
    before = Window.partitionBy("file", "row_number").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = aside.withColumn("at", F.coalesce(F.sum(F.col("chars") + 1).over(before), F.lit(0)))
    kept = F.when(F.col("at") <= limit, F.struct("block", "value"))
    crossing = placed.groupBy("file", "row_number").agg(
        F.sort_array(F.collect_list(kept)).alias("parts"), (F.sum(F.col("chars") + 1) - 1).alias("chars")
    )
    joined = F.left(F.array_join("parts.value", "\n"), F.lit(limit))
    whole = crossing.select("file", "row_number", joined.alias("value"), "chars")

    rest = known.where(F.col("row_number").isNull())
    has_header = (F.col("block") == 0).cast("int")
    if plain:
        number = earlier + seq - F.col("first_seq") + 1
        inside = rest.select("file", number.alias("row_number"), F.left("value", F.lit(limit)).alias("value"), F.length("value").cast("long").alias("chars"))
    else:
        # Numbers go on behind the record before; the header of a first block is one of them.
        needed = ordered(rest).select("file", "block", "opens", "stays", (earlier + has_header).alias("number"), "value")
        inside = needed.mapInPandas(_joined_inside(limit), "file string, row_number long, value string, chars long")

    def trimmed(df: DataFrame) -> DataFrame:
        return df.withColumn("value", F.when(F.col("chars") > limit, F.col("value")).otherwise(F.regexp_replace("value", "\r\\z", "")))

    return trimmed(whole.where("row_number = 1")), trimmed(inside.unionByName(whole.where("row_number > 1")))


def read_records(spark: SparkSession, path: str | Sequence[str], delimiter: str = ",", limit: int = RECORD_LIMIT) -> DataFrame:
    """``file, row_number, value, chars``: one row per record, see :func:`split_records`."""
    first, others = split_records(spark, path, delimiter, limit)
    return first.unionByName(others)
