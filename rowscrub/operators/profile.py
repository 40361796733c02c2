"""Column profiling: which character classes occur where."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowscrub.functions import names as N
from rowscrub.functions import patterns as P
from rowscrub.functions import text as X
from rowscrub.operators.columns import map_columns, ref

UNCOVERED = "__uncovered"


INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def _mask(flags: Sequence[Column]) -> Column:
    """Booleans as the bits of one number, the first flag being the lowest bit; null if a flag is."""
    return F.aggregate(
        F.array(*reversed(flags)), F.lit(0).cast("bigint"), lambda bits, flag: bits * 2 + flag.cast("bigint")
    )


def _any_flags(
    df: DataFrame,
    columns: Sequence[str],
    flags: dict[str, Column],
    helpers: dict[str, Column],
    presets: dict[str, Column] | None = None,
) -> DataFrame:
    """``column, pattern, found``: does a flag hold for any cell of a column?

    ``flags`` are tests on ``value`` and on ``helpers``, which are computed once per cell. The cells of a row fan out inside the task, each becomes one bit mask,
    and tasks OR the masks down to one number per column: that is all the shuffle carries,
    and neither plan nor generated code grows with the number of columns. ``presets`` gives
    a ready mask for columns that need no text search.
    """
    presets = presets or {}
    no_mask = F.lit(None).cast("bigint")
    cells = [
        F.struct(
            F.lit(name).alias("column"),
            (F.lit(None).cast("string") if name in presets else X.as_text(ref(name))).alias("value"),
            presets.get(name, no_mask).alias("preset"),
        )
        for name in columns
    ]
    fanned = df.select(F.inline(F.array(*cells)))
    empty = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    empty = empty.select("column", F.lit(None).cast("string").alias("value"), no_mask.alias("preset"))
    tested = fanned.unionByName(empty).select("*", *[h.alias(n) for n, h in helpers.items()])
    masks = tested.select("column", F.coalesce("preset", _mask(list(flags.values()))).alias("mask"))
    found = masks.groupBy("column").agg(F.coalesce(F.bit_or("mask"), F.lit(0)).alias("mask"))
    names = F.split(F.lit(",".join(flags)), ",")
    spread = found.select("column", "mask", F.posexplode(names).alias("bit", "pattern"))
    return spread.select("column", "pattern", (F.getbit("mask", F.col("bit")) == 1).alias("found"))


def pattern_profile(
    df: DataFrame, columns: Sequence[str] | None = None, uncovered: bool = False, drop_nan: bool = False
) -> DataFrame:
    """``column, pattern, found`` for all columns and classes, in one scan.

    Whole numbers need no text search: they are digits, with a hyphen if negative.
    """
    columns = list(df.columns if columns is None else columns)
    kinds = dict(df.dtypes)
    if drop_nan:
        fractions = [c for c in columns if kinds[c] in ("double", "float")]
        df = map_columns(df, fractions, lambda c: F.nanvl(c, F.lit(None)))
    flags = {n: X.matches_pattern(F.col("value"), n, F.col("wide")) for n in P.PATTERNS}
    if uncovered:
        flags[UNCOVERED] = X.has_uncovered(F.col("value"))
    order = list(flags)
    digits, hyphen = 1 << order.index("digits"), 1 << order.index("hyphen")
    presets = {
        c: F.when(ref(c) < 0, F.lit(digits | hyphen)).when(ref(c) >= 0, F.lit(digits)).cast("bigint")
        for c in columns
        if kinds[c] in INTEGRAL
    }
    return _any_flags(df, columns, flags, {"wide": X.may_hold_wide(F.col("value"))}, presets)


def pattern_set_first(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Classes found when each match counts only for the first class that fits it."""
    columns = list(df.columns if columns is None else columns)
    value, rest, wide = F.col("value"), F.col("rest"), F.col("wide")
    flags = {n: X.owns_match(value, n, rest, wide) for n in P.PATTERNS}
    helpers = {"rest": X.without_escapes(value), "wide": X.may_hold_wide(value)}
    return _any_flags(df, columns, flags, helpers).where("found").select("column", "pattern")


def pattern_set_column(df: DataFrame, column: str) -> DataFrame:
    """Classes found in one column; null and NaN do not count."""
    return pattern_profile(df, [column], drop_nan=True).where("found").select("pattern")


def column_metadata(profile: DataFrame, visible: Iterable[str] | None = None) -> DataFrame:
    """One profile record per column from :func:`pattern_profile` rows."""
    labels = F.create_map(*[F.lit(x) for pair in P.LABELS.items() for x in pair])
    shown = F.lit(True) if visible is None else F.col("column").isin(list(visible))
    found = F.when(F.col("found") & (F.col("pattern") != UNCOVERED), F.col("pattern"))
    by_column = profile.groupBy("column").agg(
        F.array_sort(F.collect_list(found)).alias("detected_patterns"),
        F.bool_or(F.col("found") & (F.col("pattern") == UNCOVERED)).alias("uncovered_chars"),
    )
    patterns = F.col("detected_patterns")
    shown_labels = F.transform(patterns, lambda p: F.coalesce(labels[p], p))
    return by_column.select(
        N.short_hash(F.col("column")).alias("hash"),
        "column",
        F.col("column").alias("origin_name"),
        F.col("column").alias("display_name"),
        patterns,
        patterns.alias("prev_selected_patterns"),
        patterns.alias("selected_patterns"),
        shown_labels.alias("detected_display_patterns"),
        shown_labels.alias("display_patterns"),
        F.when(shown, F.lit("standalone")).otherwise(F.lit("exclude")).alias("mode"),
        F.lit(None).cast("struct<source_columns:array<string>,separator:string>").alias("concatenated"),
        "uncovered_chars",
    )


def concat_metadata(metadata: DataFrame, name: str, sources: Sequence[str], separator: str) -> DataFrame:
    """The profile record of a concatenated column: the union of its sources' classes."""

    def union_of(field: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(field))))

    merged = metadata.where(F.col("column").isin(list(sources))).agg(
        union_of("detected_patterns").alias("p"), union_of("detected_display_patterns").alias("d")
    )
    return merged.select(
        N.short_hash(F.lit(name)).alias("hash"),
        *[F.lit(name).alias(n) for n in ("column", "origin_name", "display_name")],
        F.col("p").alias("detected_patterns"),
        F.lit(None).cast("array<string>").alias("prev_selected_patterns"),
        F.col("p").alias("selected_patterns"),
        F.col("d").alias("detected_display_patterns"),
        F.col("d").alias("display_patterns"),
        F.lit("standalone").alias("mode"),
        F.struct(F.array(*[F.lit(s) for s in sources]).alias("source_columns"), F.lit(separator).alias("separator")).alias(
            "concatenated"
        ),
        F.lit(None).cast("boolean").alias("uncovered_chars"),
    )


def detected_rules(profile: DataFrame) -> dict[str, list[str]]:
    """Detected classes per column on the driver: at most columns x 28 short rows."""
    rows = column_metadata(profile).select("column", "detected_patterns").collect()
    return {r["column"]: list(r["detected_patterns"]) for r in rows}


def table_info(df: DataFrame) -> DataFrame:
    """Row count, column count and column list."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.lit(",".join(df.columns)).alias("column_names"),
    )


def table_fingerprint(df: DataFrame) -> DataFrame:
    """A hash of a table's content that does not depend on row order or file layout.

    One scan, no shuffle of rows: two sums of 64-bit row hashes and the row count.
    """
    # The hash functions skip nulls, so every cell goes with its place and whether it is null.
    cells = [x for i, c in enumerate(df.columns) for x in (F.lit(i), F.isnull(ref(c)), ref(c))]
    one = F.xxhash64(*cells).cast("decimal(38,0)")
    two = F.xxhash64(F.lit("second"), *reversed(cells)).cast("decimal(38,0)")
    sums = df.agg(F.count(F.lit(1)).alias("n"), F.sum(one).alias("a"), F.sum(two).alias("b"))
    columns = F.lit(json.dumps(df.dtypes))
    return sums.select(N.content_hash(F.concat_ws("|", columns, F.col("n"), F.col("a"), F.col("b"))).alias("content_hash"))


def save_profile(metadata: DataFrame, content_hash: str, path: str, state: str | None = None) -> None:
    """Profile records with the hash of the content they describe, and the state of the files it came from."""
    marked = metadata.withColumn("content_hash", F.lit(content_hash)).withColumn("source_state", F.lit(state).cast("string"))
    marked.coalesce(1).write.mode("overwrite").parquet(path)


def load_profile(spark, path: str, content_hash: str | None, columns: Iterable[str], state: str | None = None) -> DataFrame | None:
    """A saved profile, only if it was made from the same content, or the same files, and the same columns."""
    try:
        saved = spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    if "source_state" not in saved.columns:
        saved = saved.withColumn("source_state", F.lit(None).cast("string"))
    rows = saved.select("column", "content_hash", "source_state").collect()
    same = {r["content_hash"] for r in rows} == {content_hash} or state is not None and {r["source_state"] for r in rows} == {state}
    if not same or {r["column"] for r in rows} != set(columns):
        return None
    return saved.drop("content_hash", "source_state")


def profile_or_reuse(df: DataFrame, path: str, state: str | None = None) -> tuple[DataFrame, bool]:
    """The saved profile at ``path`` if it still fits the table, else a new one, saved there.

    ``state`` names the state of the files that the table was read from (``readers.source_state``). While it is the
    saved one, the profile is reused without a look at the table; otherwise one scan for the content's hash decides.
    """
    spark = df.sparkSession
    if state is not None and (saved := load_profile(spark, path, None, df.columns, state)) is not None:
        return saved, True
    content_hash = table_fingerprint(df).first()["content_hash"]
    saved = load_profile(spark, path, content_hash, df.columns)
    if saved is not None:
        return saved, True
    save_profile(column_metadata(pattern_profile(df, uncovered=True)), content_hash, path, state)
    return load_profile(spark, path, content_hash, df.columns), False
