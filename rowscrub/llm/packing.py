"""Packing of tokenized documents into sequences of fixed capacity, by bin completion.

Documents longer than a sequence are cut; the pieces are dealt to groups of bounded size by a hash, and each group is
packed by itself, so that its loss is at most a part of a sequence. Within a group a best-fit solution is the first
incumbent. If it uses more sequences than the token count demands, branch and bound looks for a better one: the longest
remaining piece opens a sequence, the undominated fillings around it are tried from the fullest on, and a branch ends when
its waste rules out an improvement.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscrub.llm.arrays import slices
from rowscrub.llm.tokens import vocabulary

CAPACITY = 2048
GROUP_ROWS = 20_000
"""Documents of a packing group, on average."""
NODES = 20_000
"""Sequences that the search of one group may try to fill beyond the best-fit solution."""
WIDTH = 12
"""Fillings tried around one piece."""
TRIES = 400
"""Lengths tried in enumerating them."""


class Multiset:
    """Piece lengths with their counts; the largest one up to a bound is found by bit operations."""

    def __init__(self, lengths: np.ndarray, capacity: int) -> None:
        self.counts = np.bincount(lengths, minlength=capacity + 1).tolist()
        self.bits = sum(1 << i for i, n in enumerate(self.counts) if n)

    def largest(self, upto: int) -> int:
        """The largest length of at most `upto`, 0 for none."""
        return (self.bits & ((1 << (upto + 1)) - 1)).bit_length() - 1 if upto > 0 and self.bits & ((1 << (upto + 1)) - 1) else 0

    def take(self, length: int) -> None:
        self.counts[length] -= 1
        if not self.counts[length]:
            self.bits ^= 1 << length

    def give(self, length: int) -> None:
        if not self.counts[length]:
            self.bits |= 1 << length
        self.counts[length] += 1


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit decreasing: each piece goes to the fullest sequence that has room. Lists of lengths."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for length in sorted(lengths.tolist(), reverse=True):
        wide = rooms >> length << length
        if wide:
            room = (wide & -wide).bit_length() - 1
            which = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, which = capacity, len(bins)
            bins.append([])
        bins[which].append(length)
        left = room - length
        if left:
            by_room[left].append(which)
            rooms |= 1 << left
    return bins


def fillings(rest: Multiset, room: int, waste: int) -> list[tuple[int, ...]]:
    """Undominated ways to fill the room with at most `waste` left over, fullest first.

    Lengths are tried from the largest that fits on, at every place. A filling is dominated by one into whose pieces
    its own can be dealt. At most `TRIES` lengths are tried and `WIDTH` fillings returned.
    """
    found: list[tuple[int, ...]] = []
    taken: list[int] = []
    tries = TRIES

    def extend(left: int, most: int) -> None:
        nonlocal tries
        length = rest.largest(min(left, most))
        if left <= waste and (not length or left == 0) and not any(_dominates(f, taken) for f in found):
            found.append(tuple(taken))
        while length and tries > 0 and not (found and sum(found[-1]) == room and len(found) >= WIDTH):
            tries -= 1
            rest.take(length)
            taken.append(length)
            extend(left - length, length)
            taken.pop()
            rest.give(length)
            length = rest.largest(length - 1)

    if rest.largest(room) == room:
        return [(room,)]  # one piece that fills the room exactly dominates all else
    extend(room, room)
    return sorted(found, key=lambda f: (-sum(f), len(f)))[:WIDTH]


def _dominates(filling: tuple[int, ...], other: list[int]) -> bool:
    """Can the other's pieces, put where they fit most tightly, be dealt into this one's? Then this one leaves the easier rest."""
    rooms = sorted(filling)
    for length in other:
        at = bisect.bisect_left(rooms, length)
        if at == len(rooms):
            return False
        left = rooms.pop(at) - length
        bisect.insort(rooms, left)
    return True


def complete(lengths: np.ndarray, capacity: int, incumbent: list[list[int]], nodes: int = NODES) -> list[list[int]]:
    """Branch and bound over fillings; returns the incumbent or a solution with fewer sequences."""
    total = int(lengths.sum())
    least = -(-total // capacity)
    while len(incumbent) > least and nodes > 0:
        allowed = (len(incumbent) - 1) * capacity - total
        rest, chosen = Multiset(lengths, capacity), []
        waste, better = 0, None

        def options(waste: int) -> Iterator[list[int]]:
            top = rest.largest(capacity)
            rest.take(top)
            ways = fillings(rest, capacity - top, allowed - waste)
            rest.give(top)
            return iter([[top, *way] for way in ways])

        stack = [options(0)]
        while stack and nodes > 0:
            bin_ = next(stack[-1], None)
            if bin_ is None:
                stack.pop()
                if chosen:
                    last = chosen.pop()
                    waste -= capacity - sum(last)
                    for length in last:
                        rest.give(length)
                continue
            nodes -= 1
            chosen.append(bin_)
            waste += capacity - sum(bin_)
            for length in bin_:
                rest.take(length)
            if not rest.bits:
                better = list(chosen)
                break
            stack.append(options(waste))
        if better is None:
            break
        incumbent = better
    return incumbent


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; lengths are from 1 to the capacity."""
    bins = best_fit(lengths, capacity)
    bins = complete(lengths, capacity, bins, len(bins) * 2 + NODES)
    order = np.argsort(lengths, kind="stable")
    pointer = np.searchsorted(lengths[order], np.arange(capacity + 2)).tolist()
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for number, bin_ in enumerate(bins):
        at = 0
        for length in bin_:
            piece = order[pointer[length]]
            pointer[length] += 1
            sequence[piece], offset[piece] = number, at
            at += length
    return sequence, offset


def token_pieces(documents: DataFrame, path: str, end: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every document.

    A document is its ids and then `end`; null and empty texts are `end` alone. Longer ones than the capacity are cut so
    that all pieces but the first are full.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        closing = np.array([end], "<u4").tobytes()
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = words.ids(text or "").astype("<u4").tobytes() + closing
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    length = (n - 1) % capacity + 1 if piece == 0 else capacity
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, piece, start, length, zlib.crc32(part), part)[: len(names)])
                    start, piece = start + length, piece + 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names)

    return documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(cut, schema)


def pack_pieces(pieces: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with `sequence_id` and `offset`; sequences of different groups have different numbers."""
    out = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    names = pieces.columns

    def fill(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        sequence, offset = pack(table.column("length").to_numpy(), capacity)
        return table.select(names).append_column("sequence_id", pa.array(sequence * groups + group)).append_column("offset", pa.array(offset))

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(fill, out.schema)


def pack_documents(documents: DataFrame, path: str, end: int = 0, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place in a sequence.

    The number of groups follows from the number of documents. Repeated rows are packed each; an empty table gives no
    rows; columns other than doc_id and text are not carried.
    """
    groups = max(1, math.ceil(documents.select("doc_id").count() / group_rows))
    return pack_pieces(token_pieces(documents, path, end, capacity, with_ids), groups, capacity)
