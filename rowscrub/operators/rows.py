"""Row-level operators: filters, duplicates, heads and slices."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowscrub.functions import text as X
from rowscrub.operators.columns import ref
from rowscrub.operators.report import Report, note


def require_not_null(
    df: DataFrame, names: Iterable[str], strict: bool = True, report: Report | None = None
) -> DataFrame:
    """Drop rows with a null in any required column; a missing column raises if ``strict``."""
    names = list(names)
    missing = [n for n in names if n not in df.columns]
    if missing and strict:
        raise ValueError(f"required columns not found: {missing}")
    valid = [n for n in names if n in df.columns]
    note(report, "not_null", valid, missing)
    return df.where(reduce(Column.__and__, [ref(n).isNotNull() for n in valid])) if valid else df


def require_not_empty(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop rows where any required column is null or an empty marker."""
    names = list(names)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"required columns not found: {missing}")
    return df.where(~reduce(Column.__or__, [X.is_empty(ref(n)) for n in names])) if names else df


def dedup_keys(columns: Sequence[str], subset: Iterable[str] | None, report: Report | None = None) -> list[str]:
    """The key columns that exist; none left means every column."""
    subset = list(subset or [])
    valid = [n for n in subset if n in columns]
    note(report, "dedup", valid or columns, [n for n in subset if n not in columns])
    return valid or list(columns)


def dedup(
    df: DataFrame,
    subset: Iterable[str] | None = None,
    order_by: Sequence[str | Column] | None = None,
    report: Report | None = None,
) -> DataFrame:
    """One row per key; null equals null.

    Without ``order_by`` any row may survive. With it the first row in that order does.
    Each map task keeps one row per key before the shuffle (a partial aggregate over all
    columns, or the window group limit that Spark derives from ``rank <= 1``), so a key
    that owns a third of the table sends one row per task and not all of its copies.

    The ranked form serves both cases: ``dropDuplicates(keys)`` carries the other columns as
    ``first`` aggregates, which for text Spark can only sort-aggregate. A 64-bit hash leads
    the partition key, so that sorting rarely has to compare long texts; the key itself
    follows, which keeps the result exact.
    """
    keys = dedup_keys(df.columns, subset, report)
    if len(keys) == len(df.columns):
        return df.dropDuplicates()
    key = [ref(k) for k in keys]
    order = [ref(o) if isinstance(o, str) else o for o in order_by or keys]
    rank = "rank" + "_" * max(map(len, df.columns))  # a name that no column has
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(F.xxhash64(*key), *key).orderBy(*order)))
    return ranked.where(F.col(rank) <= 1).drop(rank)


def head_rows(df: DataFrame, n: int, order_by: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows; with an order, Spark takes the top ``n`` of each task and merges them.

    The rows end up in one task, so this is for heads, not for large parts of a table.
    """
    return (df.orderBy(*[ref(o) for o in order_by]) if order_by else df).limit(n)


def slice_rows(df: DataFrame, offset: int, length: int, order_by: Sequence[str] | None = None) -> DataFrame:
    """Rows ``offset`` to ``offset + length``, which one task gathers together with those before them."""
    return (df.orderBy(*[ref(o) for o in order_by]) if order_by else df).offset(offset).limit(length)


def vstack(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack same-schema tables, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b), parts)
