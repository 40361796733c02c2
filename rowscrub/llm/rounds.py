"""Questions of chunks of documents to buckets of keys, packed so that no row stands for a single key.

Documents are dealt to chunks by a hash of their id. In a round, each chunk sends the keys of its documents, each once,
to buckets by hash; a bucket sees all chunks that have a key and answers each of them with a few bits a key. A key that a
third of all documents contain is thus one entry for each chunk, and the keys of a bucket are bounded by its share of the hash
range. Later rounds compute the chunk's keys again instead of storing them. All rounds and the last step belong to
one query, so the exchange that deals the text to chunks is made once and read again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rowscrub.session import via_table

CHUNK_BYTES = 4 << 20
"""Text bytes of a chunk, on average."""
BUCKET_KEYS = 1 << 20
"""Keys of a bucket, on average."""

SENT = "bucket int, chunk int, keys binary, extra binary"
REPLY = "chunk int, round int, bucket int, reply binary"
SENT_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())])
REPLY_ARROW = pa.schema([("chunk", pa.int32()), ("round", pa.int32()), ("bucket", pa.int32()), ("reply", pa.binary())])

Replies = dict[tuple[int, int], bytes]
"""By round and bucket."""


class Documents(NamedTuple):
    """The documents of a chunk in the order of id and text; a null id comes last."""

    ids: np.ndarray
    column: pa.Array
    rows: pa.Table


class Chunked(NamedTuple):
    """Documents with their chunk, the bytes of all texts, and the numbers of documents and chunks."""

    frame: DataFrame
    size: int
    rows: int
    chunks: int

    def buckets(self, keys_per_byte: float) -> int:
        return max(1, math.ceil(self.size * keys_per_byte / BUCKET_KEYS))


LAST_ID = np.iinfo(np.int64).max


def with_rest(documents: DataFrame, carry: bool) -> DataFrame:
    """doc_id, text, and in `rest` whatever other columns are to be carried."""
    chosen = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    others = [F.col(f"`{c}`") for c in documents.columns if c not in ("doc_id", "text")]
    return documents.select(*chosen, *([F.struct(*others).alias("rest")] if carry and others else []))


def rest_of(table: pa.Table | pa.RecordBatch) -> dict[str, pa.Array]:
    """The carried columns of a result, by name; empty if there are none."""
    return {"rest": table.column("rest")} if "rest" in table.schema.names else {}


def in_chunks(documents: DataFrame, chunk_bytes: int = CHUNK_BYTES, carry: bool = False, by_text: bool = False) -> Chunked:
    """The documents dealt by their ids; with `by_text` by ids and texts, which spreads rows of one id or of none."""
    chosen = with_rest(documents, carry)
    size, rows = chosen.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16), F.count(F.lit(1))).first()
    chunks = max(1, math.ceil((size or 0) / chunk_bytes))
    return Chunked(chosen.select(F.pmod(F.xxhash64("doc_id", *(["text"] if by_text else [])), F.lit(chunks)).cast("int").alias("chunk"), "*"), size or 0, rows, chunks)


def documents_of(table: pa.Table) -> Documents:
    ids = table.column("doc_id").combine_chunks().fill_null(LAST_ID).to_numpy()
    order = np.argsort(ids, kind="stable")
    if len(np.unique(ids)) < len(ids):
        texts = table.column("text").to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i] or "")), np.int64)
    table = table.take(pa.array(order))
    return Documents(ids[order], table.column("text").combine_chunks(), table)


def replies_of(table: pa.Table | None) -> Replies:
    if table is None:
        return {}
    return {(row["round"], row["bucket"]): row["reply"] for row in table.to_pylist()}


Send = Callable[[Documents, Replies], Iterable[tuple[int, bytes, bytes]]]
Answer = Callable[[list[bytes], list[bytes]], list[bytes]]


def ask(chunked: Chunked, known: DataFrame | None, number: int, send: Send, answer: Answer) -> DataFrame:
    """Replies of one round, added to those known. `send` gives (bucket, keys, extra); `answer` one reply for each."""

    def sent(documents: pa.Table, replies: pa.Table | None) -> pa.Table:
        if not documents.num_rows:
            return SENT_ARROW.empty_table()
        chunk = documents.column("chunk")[0].as_py()
        rows = list(send(documents_of(documents), replies_of(replies)))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*((b, chunk, k, e) for b, k, e in rows), strict=True), SENT_ARROW.types, strict=True)], schema=SENT_ARROW) if rows else SENT_ARROW.empty_table()

    def answered(table: pa.Table) -> pa.Table:
        replies = answer(table.column("keys").to_pylist(), table.column("extra").to_pylist())
        return pa.Table.from_arrays(
            [table.column("chunk"), pa.array([number] * table.num_rows, pa.int32()), table.column("bucket"), pa.array(replies, pa.binary())], schema=REPLY_ARROW
        )

    if known is None:
        asked = chunked.frame.groupBy("chunk").applyInArrow(lambda table: sent(table, None), SENT)
    else:
        asked = chunked.frame.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(sent, SENT)
    replies = asked.groupBy("bucket").applyInArrow(answered, REPLY)
    return replies if known is None else known.unionByName(replies)


def result_schema(fields: str, frame: DataFrame) -> StructType:
    """The schema of a result, with the carried columns if the frame has some."""
    schema = StructType.fromDDL(fields)
    return schema.add(frame.schema["rest"]) if "rest" in frame.columns else schema


def finish(chunked: Chunked, known: DataFrame, last: Callable[[Documents, Replies], pa.Table], fields: str) -> DataFrame:
    """The result of each chunk from its documents and all replies."""
    schema = result_schema(fields, chunked.frame)
    empty = to_arrow_schema(schema)

    def done(documents: pa.Table, replies: pa.Table) -> pa.Table:
        if not documents.num_rows:
            return empty.empty_table()
        chunk = documents_of(documents)
        table = last(chunk, replies_of(replies))
        for name, column in rest_of(chunk.rows).items():
            table = table.append_column(name, column)
        return table

    return chunked.frame.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(done, schema)


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """`via_table`, with the shuffle files of the finished query removed: nothing reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, None)
    conf.set(CLEAN_UP, "true")
    try:
        return via_table(df, name)
    finally:
        conf.unset(CLEAN_UP) if before is None else conf.set(CLEAN_UP, before)


def dealt(keys: np.ndarray, buckets: int) -> Iterable[tuple[int, slice]]:
    """Of keys sorted by bucket_of(keys): each bucket that has some, and where they are."""
    bounds = np.searchsorted(keys, np.arange(buckets + 1))
    for bucket in np.flatnonzero(np.diff(bounds)):
        yield int(bucket), slice(int(bounds[bucket]), int(bounds[bucket + 1]))


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def split(array: np.ndarray, lengths: Iterable[int]) -> list[np.ndarray]:
    return np.split(array, np.cumsum(list(lengths))[:-1])
