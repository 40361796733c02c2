"""Removal of repeated word sequences by difference-cover anchors.

A match of 13 words is found by shorter windows of 7 words that are hashed only at some positions: those whose place in the
document modulo 7 is in the difference cover {1, 2, 4}. For any two places there is a shift below 7 that moves both into the
cover, so two equal 13-word windows share an aligned anchor. Documents whose anchors occur in no other document
are done. Around shared anchors the 13-word windows are hashed, and the smallest doc_id that has a window decides who keeps it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rowscrub.llm.arrays import (
    MULTIPLIER,
    NON_SPACE,
    SECOND,
    U64,
    covered,
    hash_spans,
    mixed,
    per_document,
    spans,
    text_bytes,
    window_hashes,
    window_starts,
    without_words,
)
from rowscrub.llm.rounds import Documents, Replies, ask, bits, dealt, finish, flags, in_chunks, split

WINDOW = 13
PERIOD = 7
COVER = (1, 2, 4)
"""Every difference modulo 7 is one of two members."""
ANCHOR = WINDOW - PERIOD + 1

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


class Words:
    """Words of a chunk and their hashes."""

    def __init__(self, documents: Documents) -> None:
        self.data, self.offsets = text_bytes(documents.column)
        self.starts, self.ends = spans(NON_SPACE[self.data], self.offsets)
        self.firsts = per_document(self.starts, self.offsets)
        self.hashes = hash_spans(self.data, self.starts, self.ends)
        self.windows = window_starts(self.firsts, WINDOW)

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, places, "right") - 1


def _anchors(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors; their distinct keys, sorted by bucket; each anchor's number in these; keys of several documents."""
    places = window_starts(words.firsts, ANCHOR)
    owner = words.document(places)
    long = np.diff(words.firsts)[owner] >= WINDOW
    inside = np.isin((places - words.firsts[owner]) % PERIOD, COVER) & long
    places, owner = places[inside], owner[inside]
    h = window_hashes(words.hashes, ANCHOR)[places] if len(places) else np.zeros(0, U64)
    # The bucket comes from the upper half, 32 bits within it from the lower half.
    keys = ((h >> U64(32)) % U64(buckets) << U64(32)) | (h & U64(0xFFFFFFFF))
    distinct, which = np.unique(keys, return_inverse=True)
    first = np.full(len(distinct), np.iinfo(np.int64).max)
    last = np.full(len(distinct), -1)
    np.minimum.at(first, which, owner)
    np.maximum.at(last, which, owner)
    return places, distinct, which, last > first


def _shared(keys: list[bytes], extra: list[bytes]) -> list[bytes]:
    """Which keys several documents have."""
    parts = [np.frombuffer(k, np.uint32) for k in keys]
    lengths = [len(p) for p in parts]
    several = np.concatenate([flags(e, n) for e, n in zip(extra, lengths, strict=True)])
    distinct, which, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    shared = counts > 1
    shared[which[several]] = True
    return [bits(part) for part in split(shared[which], lengths)]


def _candidates(words: Words, replies: Replies, buckets: int) -> np.ndarray:
    """Window starts around anchors that occur in other documents."""
    places, distinct, which, _ = _anchors(words, buckets)
    shared = np.zeros(len(distinct), bool)
    for bucket, part in dealt(distinct >> U64(32), buckets):
        shared[part] = flags(replies[1, bucket], part.stop - part.start)
    near = np.zeros(len(words.hashes) + 1, np.int32)
    hit = places[shared[which]]
    np.add.at(near, np.maximum(hit - (WINDOW - ANCHOR), 0), 1)
    np.add.at(near, hit + 1, -1)
    return words.windows[np.cumsum(near)[words.windows] > 0]


def _windows(words: Words, candidates: np.ndarray, ids: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and hash of the distinct candidate windows in this order, each window's number, and the least doc_id of each."""
    if not len(candidates):
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = window_hashes(words.hashes, WINDOW)[candidates]
    distinct, which = np.unique(h, return_inverse=True)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, which, ids[words.document(candidates)])
    bucket = mixed(distinct * SECOND + MULTIPLIER) % U64(buckets)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return bucket[order], distinct[order], place[which], least[order]


def _firsts(keys: list[bytes], extra: list[bytes]) -> list[bytes]:
    """Which windows another chunk has in a smaller document."""
    parts = [np.frombuffer(k, np.uint64) for k in keys]
    lengths = [len(p) for p in parts]
    ids = np.concatenate([np.frombuffer(e, np.int64) for e in extra])
    distinct, which = np.unique(np.concatenate(parts), return_inverse=True)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, which, ids)
    return [bits(part) for part in split(least[which] < ids, lengths)]


def removed_words(documents: DataFrame, keep_text: bool = True, carry: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one blank) and the kept text of every document.

    Words are separated by ASCII white space; windows never cross documents. Null texts have no words and no kept text; a text
    without kept words leaves its white space. `keep_text=False` leaves null for all kept texts. A null doc_id counts as the largest one. Rows with the same doc_id do not remove
    from each other. An empty table gives no rows. Other columns are carried in the struct `rest` if asked.
    """
    chunked = in_chunks(documents, carry=carry)
    anchor_buckets = chunked.buckets(len(COVER) / PERIOD / 6)
    window_buckets = chunked.buckets(1 / 12)

    def send_anchors(documents: Documents, replies: Replies):
        _, distinct, _, several = _anchors(Words(documents), anchor_buckets)
        for bucket, part in dealt(distinct >> U64(32), anchor_buckets):
            yield bucket, (distinct[part] & U64(0xFFFFFFFF)).astype(np.uint32).tobytes(), bits(several[part])

    def send_windows(documents: Documents, replies: Replies):
        words = Words(documents)
        bucket, distinct, _, least = _windows(words, _candidates(words, replies, anchor_buckets), documents.ids, window_buckets)
        for number, part in dealt(bucket, window_buckets):
            yield number, distinct[part].tobytes(), least[part].tobytes()

    def remove(documents: Documents, replies: Replies) -> pa.Table:
        words = Words(documents)
        candidates = _candidates(words, replies, anchor_buckets)
        bucket, distinct, which, least = _windows(words, candidates, documents.ids, window_buckets)
        later = np.zeros(len(distinct), bool)
        for number, part in dealt(bucket, window_buckets):
            later[part] = flags(replies[2, number], part.stop - part.start)
        repeated = later[which] | (documents.ids[words.document(candidates)] > least[which])
        gone = covered(candidates[repeated], WINDOW, len(words.hashes))
        nulls = documents.column.is_null().to_pylist()
        digests, kept = [], []
        for d in range(len(documents.ids)):
            begin, end, a, b = int(words.offsets[d]), int(words.offsets[d + 1]), int(words.firsts[d]), int(words.firsts[d + 1])
            found = words.data[begin:end].tobytes().split()
            digests.append(hashlib.sha256(b" ".join(w for w, g in zip(found, gone[a:b].tolist(), strict=True) if not g)).hexdigest())
            whole = keep_text and not nulls[d]
            kept.append(without_words(words.data, words.starts[a:b], words.ends[a:b], gone[a:b], begin, end) if whole else None)
        sums = np.concatenate(([0], np.cumsum(gone)))
        return pa.Table.from_arrays(
            [
                documents.rows.column("doc_id"),
                pa.array(np.diff(words.firsts)),
                pa.array(sums[words.firsts[1:]] - sums[words.firsts[:-1]]),
                pa.array(digests),
                pa.array(kept, pa.string()),
            ],
            schema=ARROW,
        )

    known = ask(chunked, None, 1, send_anchors, _shared)
    known = ask(chunked, known, 2, send_windows, _firsts)
    return finish(chunked, known, remove, SCHEMA)
