"""The prefix trie of conversations, with members, leaves and savings of every node.

A turn is the 128-bit digest of its role and text, a conversation the digests of its turns in a row, so that the order of these bytes
is an order of sequences of turns. Conversations are dealt to tasks by ranges of this order and, where many are alike, of their ids,
and come sorted. A task takes them in shards: the turns of a shard become small numbers by its own dictionary, the distinct sequences go
into a ternary search tree, the one in the middle first, and a traversal without recursion adds up the nodes.

Only prefixes of the first and the last conversation of a shard can go on in another one. These boundary nodes stay open,
as sums of what is complete below them; neighbouring shards are merged, many at a time, and what is then inside is closed, until none is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowscrub.llm.rounds import written
from rowscrub.operators.records import broadcast_bytes

WORD = r"[^\x20\x09-\x0D]+"
DIGEST = 16
"""Bytes that stand for a turn."""
SHARD_TURNS = 1 << 17
"""Turns and conversations of a shard; a longer conversation is a shard of its own."""
TOGETHER = 64
"""Neighbours whose boundaries are merged by one task."""
NAME_BYTES = 64
SALTS = 16
ROOT = b""
NOTHING = hashlib.sha256(b"").hexdigest()

CLOSED, OPEN, ENDS = range(3)
OUT = (
    "kind int, shard int, key binary, parent_key binary, depth long, words long, n_convs long, conv_id long, parent_conv_id long, "
    "n_children long, n_leaves long, saved_tokens long, first boolean, last boolean, ends_sha256 string, ids string"
)
TYPES = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
OUT_ARROW = pa.schema([(name, TYPES[kind]) for name, kind in (c.split() for c in OUT.split(", "))])
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_digest(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def block_of(conv_id: Column) -> Column:
    """The conversation from which this one's first turns come."""
    return conv_id - conv_id % 20


def borrowed(conv_id: Column) -> Column:
    """How many turns come from there."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 4).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, path (the digests of its rebuilt turns in a row, 16 bytes each) and words of each of these turns.

    One shuffle: the conversations that borrow from one another are dealt by the one they borrow from.
    """
    conv_id = F.col("conv_id").cast("long")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), turn_digest(role, text).alias("code"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    rows = turns.where(conv_id.isNotNull()).select(block_of(conv_id).alias("block"), conv_id.alias("conv_id"), turn.alias("t")).repartition("block")
    own = rows.groupBy("block", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    head = F.max(F.when(F.col("conv_id") == F.col("block"), F.slice("own", 1, 3))).over(Window.partitionBy("block"))
    n = borrowed(F.col("conv_id"))
    none = F.lit(None).cast("array<struct<turn:bigint,code:string,words:int>>")
    both = own.withColumn("head", F.coalesce(head, F.slice("own", 1, 0), none))
    full = both.select("conv_id", F.concat(F.slice("head", F.lit(1), n), F.slice("own", n + 1, F.size("own"))).alias("turns"))
    return full.select("conv_id", F.unhex(F.array_join("turns.code", "")).alias("path"), F.col("turns.words").alias("words"))


@dataclass
class Boundary:
    """A node that may go on in a neighbouring shard, with what is complete below it: children, leaves, and their savings."""

    key: bytes
    parent_key: bytes | None
    depth: int
    words: int
    n_convs: int
    conv_id: int
    n_children: int
    n_leaves: int
    saved_tokens: int
    first: bool
    last: bool


BOUNDARY = tuple(f.name for f in fields(Boundary))


class Table:
    """Rows of the output, column by column."""

    def __init__(self) -> None:
        self.columns: dict[str, list] = {name: [] for name in OUT_ARROW.names}

    def add(self, **cells) -> None:
        for name, column in self.columns.items():
            column.append(cells.get(name))

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.columns.values(), OUT_ARROW.types, strict=True)], schema=OUT_ARROW)


class SearchTree:
    """A ternary search tree over sequences of numbers; place 0 is the empty sequence."""

    def __init__(self) -> None:
        self.turn, self.less, self.more, self.after, self.ends = [-1], [-1], [-1], [-1], [-1]

    def _place(self, turn: int) -> int:
        for column, value in ((self.turn, turn), (self.less, -1), (self.more, -1), (self.after, -1), (self.ends, -1)):
            column.append(value)
        return len(self.turn) - 1

    def insert(self, sequence: Iterable[int], number: int) -> None:
        at = 0
        for turn in sequence:
            links, link, child = self.after, at, self.after[at]
            while child >= 0 and self.turn[child] != turn:
                links, link = (self.less if turn < self.turn[child] else self.more), child
                child = links[link]
            if child < 0:
                child = links[link] = self._place(turn)
            at = child
        self.ends[at] = number

    def walk(self) -> tuple[list[int], list[int]]:
        """All places, each after the one before it in its sequences, and these."""
        places, parents, todo = [0], [-1], [(self.after[0], 0)]
        while todo:
            at, parent = todo.pop()
            if at >= 0:
                places.append(at)
                parents.append(parent)
                todo += ((self.less[at], parent), (self.more[at], parent), (self.after[at], at))
        return places, parents


def balanced(n: int) -> Iterator[int]:
    """0 to n - 1: the one in the middle, then each half alike."""
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            todo += ((a, middle), (middle + 1, b))


def shard_nodes(paths: list[bytes], words: list[list[int]], conv_ids: list[int], out: Table) -> list[Boundary]:
    """Adds the complete nodes of a shard to `out`, and the ids that end at boundary nodes; returns the boundary nodes.

    The conversations come sorted by path, then by id.
    """
    codes = np.frombuffer(b"".join(paths), [("a", ">u8"), ("b", ">u8")])
    distinct, numbers = np.unique(codes, return_inverse=True)
    flat = np.zeros(len(distinct), np.int64)
    flat[numbers] = np.fromiter((w for part in words for w in part), np.int64, len(codes))
    cost, digests, numbers = flat.tolist(), [d.tobytes() for d in distinct], numbers.tolist()
    # Equal conversations are neighbours: the first of each kind, and where its turns begin.
    kinds, begins, at = [], [], 0
    for i, path in enumerate(paths):
        if not i or path != paths[i - 1]:
            kinds.append(i)
            begins.append(at)
        at += len(path) // DIGEST
    bounds = [*kinds, len(paths)]
    tree = SearchTree()
    for kind in balanced(len(kinds)):
        begin = begins[kind]
        tree.insert(numbers[begin : begin + len(paths[kinds[kind]]) // DIGEST], kind)
    places, parents = tree.walk()
    size = len(tree.turn)
    parent_of, depth = [-1] * size, [0] * size
    for at, parent in zip(places[1:], parents[1:], strict=True):
        parent_of[at], depth[at] = parent, depth[parent] + 1

    border: dict[int, bytes] = {0: ROOT}
    sides: dict[int, list[bool]] = {0: [True, True]}
    for side, kind in enumerate((0, len(kinds) - 1)):
        at = 0
        for turn in numbers[begins[kind] : begins[kind] + len(paths[kinds[kind]]) // DIGEST]:
            child = tree.after[at]
            while tree.turn[child] != turn:
                child = tree.less[child] if turn < tree.turn[child] else tree.more[child]
            border[child] = hashlib.md5(border[at] + digests[turn]).digest()
            sides.setdefault(child, [False, False])[side] = True
            at = child

    members, least, children, leaves, saved = [0] * size, [0] * size, [0] * size, [0] * size, [0] * size
    done, found = [], []
    for at in reversed(places):
        kind, parent, word = tree.ends[at], parent_of[at], cost[tree.turn[at]] if at else 0
        ids = conv_ids[bounds[kind] : bounds[kind + 1]] if kind >= 0 else []
        if ids:
            least[at] = min(least[at], ids[0]) if members[at] else ids[0]
            members[at] += len(ids)
        if at in border:
            if ids:
                out.add(kind=ENDS, key=border[at], conv_id=ids[0], ids=",".join(map(str, ids)))
            above = border[parent] if at else None
            found.append(Boundary(border[at], above, depth[at], word, members[at], least[at], children[at], leaves[at], saved[at], *sides[at]))
        else:
            leaves[at] = leaves[at] or 1
            saved[at] += (members[at] - 1) * word
            children[parent] += 1
            leaves[parent] += leaves[at]
            saved[parent] += saved[at]
            done.append((at, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() if ids else NOTHING))
        if at:
            least[parent] = min(least[parent], least[at]) if members[parent] else least[at]
            members[parent] += members[at]
    for at, ends in done:
        parent = parent_of[at]
        above = {"parent_key": border[parent]} if parent in border else {"parent_conv_id": least[parent]}
        out.add(
            kind=CLOSED, depth=depth[at], n_convs=members[at], conv_id=least[at], n_children=children[at], n_leaves=leaves[at],
            saved_tokens=saved[at], ends_sha256=ends, **above,
        )
    return found


def merged(parts: list[list[Boundary]], out: Table, final: bool) -> list[Boundary]:
    """One set of boundary nodes from those of neighbours, in order; nodes that are no longer at a border go to `out`, all if `final`."""
    nodes: dict[bytes, Boundary] = {}
    for i, part in enumerate(parts):
        for b in part:
            first, last = b.first and i == 0, b.last and i == len(parts) - 1
            known = nodes.get(b.key)
            if known is None:
                nodes[b.key] = Boundary(*(getattr(b, name) for name in BOUNDARY[:-2]), first, last)
            else:
                known.n_convs += b.n_convs
                known.conv_id = min(known.conv_id, b.conv_id)
                known.n_children += b.n_children
                known.n_leaves += b.n_leaves
                known.saved_tokens += b.saved_tokens
                known.first |= first
                known.last |= last
    left = []
    for b in sorted(nodes.values(), key=lambda b: -b.depth):
        if (b.first or b.last) and not final:
            left.append(b)
            continue
        b.n_leaves = b.n_leaves or 1
        b.saved_tokens += (b.n_convs - 1) * b.words
        if b.parent_key is not None:
            above = nodes[b.parent_key]
            above.n_children += 1
            above.n_leaves += b.n_leaves
            above.saved_tokens += b.saved_tokens
        out.add(kind=CLOSED, **{name: getattr(b, name) for name in BOUNDARY[:-2] if name != "words"})
    return left


def _put(left: list[Boundary], shard: int, out: Table) -> None:
    for b in left:
        out.add(kind=OPEN, shard=shard, **{name: getattr(b, name) for name in BOUNDARY})


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a task's conversations, shard by shard, and at the end the boundary nodes of all of them."""
    left: list[Boundary] = []
    for batch in batches:
        paths, words, ids = (batch.column(c).to_pylist() for c in ("path", "words", "conv_id"))
        ends = np.cumsum([len(p) // DIGEST + 1 for p in paths])
        at = 0
        while at < len(paths):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SHARD_TURNS, "right")))
            out = Table()
            found = shard_nodes(paths[at:upto], words[at:upto], ids[at:upto], out)
            left = merged([left, found], out, False) if left else found
            yield out.batch()
            at = upto
    if left:
        out = Table()
        _put(left, TaskContext.get().partitionId(), out)
        yield out.batch()


def _merge_group(shard_of: int, final: bool):
    def merge(table: pa.Table) -> pa.Table:
        parts: dict[int, list[Boundary]] = {}
        for row in table.select(["shard", *BOUNDARY]).to_pylist():
            parts.setdefault(row.pop("shard"), []).append(Boundary(**row))
        out = Table()
        left = merged([parts[shard] for shard in sorted(parts)], out, final)
        _put(left, min(parts) // shard_of, out)
        return pa.Table.from_batches([out.batch()])

    return merge


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces of lists of ids, sorted by key and place, the hash of each whole list."""
    key, state = None, None
    for batch in batches:
        keys, hashes = [], []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if k == key:
                state.update(b",")
            else:
                if state:
                    keys.append(key)
                    hashes.append(state.hexdigest())
                key, state = k, hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], names=["key", "ends"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends"])


def conversation_trie(turns: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `turns` has conv_id, turn, role and text; other columns are not used. Null roles and texts count as empty, null turns come first,
    turns of one number are ordered by their digests, and a row that occurs twice is a turn that occurs twice. Rows with a null conv_id belong to
    no conversation and are left out. A conversation with negative id borrows from the next multiple of 20 towards zero. An empty table gives
    no nodes, not even the root. A conversation is held by one task at about 20 bytes a turn, whatever its texts; the ids of equal
    conversations, however many, are spread over tasks, but their hash is made by one, as it cannot be made in parts.
    """
    spark = turns.sparkSession
    sorted_ = rebuilt(turns).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    tables = [written(sorted_.mapInArrow(_shards, OUT), "trie")]
    left = tables[0].where(F.col("kind") == OPEN)
    highest = left.agg(F.max("shard")).first()[0]
    while highest is not None:
        final = highest < TOGETHER
        done = left.groupBy(F.floor(F.col("shard") / TOGETHER)).applyInArrow(_merge_group(TOGETHER, final), OUT)
        tables.append(written(done, "trie-borders"))
        left, highest = tables[-1].where(F.col("kind") == OPEN), None if final else highest // TOGETHER

    # Nodes from merges, in a task or of tasks, have keys: by these they get the hashes of their ids, and give their children's rows their conv_id.
    ids = tables[0].where(F.col("kind") == ENDS).select("key", "conv_id", "ids").repartition("key").sortWithinPartitions("key", "conv_id")
    ends = ids.select("key", "ids").mapInArrow(_joined_ids, "key binary, ends string")
    nodes = tables[0].where((F.col("kind") == CLOSED) & F.col("key").isNull())
    border = tables[0].where((F.col("kind") == CLOSED) & F.col("key").isNotNull())
    if len(tables) > 1:
        for table in tables[1:]:
            border = border.unionByName(table.where(F.col("kind") == CLOSED))
        names = border.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
        hashed = border.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(NOTHING))).drop("ends")
        nodes = nodes.unionByName(hashed.select(*OUT_ARROW.names))
        if border.count() * NAME_BYTES <= broadcast_bytes(spark):
            nodes = nodes.join(F.broadcast(names), "parent_key", "left")
        else:
            # The root and other early nodes have many children: every name goes to several tasks.
            salted = nodes.withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)))
            names = names.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
            nodes = salted.join(names, ["parent_key", "salt"], "left")
        nodes = nodes.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return nodes.select(*RESULT)
