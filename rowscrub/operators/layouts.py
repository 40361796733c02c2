"""Files of one input whose headers differ: which columns there are, and where each file has them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowscrub.operators.records import BLOCK_ROW_BYTES, broadcast_bytes

MOST_LAYOUTS = 1000  # different headers among the files of one input; more are an error


class Layouts(NamedTuple):
    """The header of each layout, and ``file, layout`` of all files; None if there is only one layout."""

    headers: list[list[str]]
    files: DataFrame | None

    @property
    def columns(self) -> list[str]:
        """The columns of the first file by name, then what others add."""
        return list(dict.fromkeys(name for names in self.headers for name in names))

    @property
    def places(self) -> list[list[int]]:
        """For each layout the place of every column, -1 where it has none."""
        return [[names.index(n) if n in names else -1 for n in self.columns] for names in self.headers]


def file_layouts(heads: DataFrame, names_of: Callable[[list[str]], list[list[str]]], where: str) -> Layouts:
    """The layouts of ``file, header``, one row a file, by the first file that has each.

    ``names_of`` turns header texts into names. The driver sees one row for each different header.
    """
    first = heads.groupBy("header").agg(F.min("file").alias("file")).limit(MOST_LAYOUTS + 1)
    known = sorted((r["file"], r["header"]) for r in first.collect())
    if len(known) > MOST_LAYOUTS:
        raise ValueError(f"more than {MOST_LAYOUTS} different headers below {where}")
    headers = names_of([header for _, header in known])
    if len(known) < 2:
        return Layouts(headers, None)
    rows = heads.sparkSession.createDataFrame([(i, header) for i, (_, header) in enumerate(known)], "layout int, header string")
    return Layouts(headers, heads.join(F.broadcast(rows), "header").select("file", "layout"))


def with_layout(lines: DataFrame, layouts: Layouts) -> DataFrame:
    """Lines with the ``layout`` of their file. The table of files is broadcast where its size is known to fit."""
    if layouts.files is None:
        return lines.withColumn("layout", F.lit(0))
    small = layouts.files.count() * BLOCK_ROW_BYTES * 4 <= broadcast_bytes(lines.sparkSession)
    return lines.join(F.broadcast(layouts.files) if small else layouts.files, "file")


def arranged(cells: Column, layouts: Layouts) -> list[Column]:
    """From an array of cells in the order of their own file, the columns; null where a file lacks one."""
    if layouts.files is None:
        return [F.get(cells, i).alias(name) for i, name in enumerate(layouts.columns)]
    all_places: Sequence = [F.array(*map(F.lit, places)) for places in layouts.places]
    place = F.element_at(F.array(*all_places), F.col("layout") + 1)
    at = [F.get(place, i) for i in range(len(layouts.columns))]
    return [F.when(i >= 0, F.get(cells, i)).alias(name) for i, name in zip(at, layouts.columns, strict=True)]
