"""Numpy views of Arrow text columns: bytes, words and hashes of a whole slice of documents at once.

All hashes are 64-bit mixes of the exact bytes. Where equality of hashes stands for equality of words, the chance
of a wrong match among n values is about n * n / 2 ** 65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
"""Text bytes that are held as arrays at once; one longer document forms a slice of its own."""

U64 = np.uint64
MULTIPLIER = U64(0x9E3779B97F4A7C15)
SECOND = U64(0xC2B2AE3D27D4EB4F)


def _ascii(members: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in members]] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

SPACES = _ascii(" \t\n\v\f\r")
NON_SPACE = ~SPACES
"""Bytes of words separated by ASCII white space."""

ALNUM = _ascii("0123456789abcdefghijklmnopqrstuvwxyz")
ALNUM[128:] = True
"""Bytes of words of lower-cased text: ASCII digits and letters, and every byte of a non-ASCII character."""


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the offsets between them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text."""
    for batch in batches:
        if batch.num_rows:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
                yield batch.slice(at, upto - at)
                at = upto


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of true bytes; runs end with their document."""
    before = np.zeros(len(inside), bool)
    after = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    full = offsets[:-1][np.diff(offsets) > 0]
    before[full] = False
    after[full[1:] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def per_document(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For sorted positions: index of the first one of each document, and the total at the end."""
    return np.searchsorted(positions, offsets, "left")


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * MULTIPLIER
    h = (h ^ (h >> U64(29))) * SECOND
    return h ^ (h >> U64(32))


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """At each position the next eight bytes as one number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    window = eight_bytes(data)
    left = (ends - starts).astype(np.int64)
    h = mixed(left.astype(U64) * MULTIPLIER)
    at, todo = starts.astype(np.int64), np.arange(len(starts))
    while len(todo):
        rest = left[todo]
        keep = np.where(rest >= 8, U64(0xFFFFFFFFFFFFFFFF), (U64(1) << (U64(8) * np.clip(rest, 0, 7).astype(U64))) - U64(1))
        h[todo] = mixed(h[todo] * SECOND + (window[at[todo]] & keep))
        at[todo] += 8
        left[todo] -= 8
        todo = todo[left[todo] > 0]
    return h


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` consecutive words, whatever document they are in."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = words[:n].copy()
    for j in range(1, size):
        h *= MULTIPLIER
        h += words[j : j + n]
    return mixed(h)


def window_starts(firsts: np.ndarray, size: int) -> np.ndarray:
    """Word indices at which a window of `size` words of one document starts."""
    n = np.maximum(np.diff(firsts) - size + 1, 0)
    return ragged(firsts[:-1], n)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, `length` numbers each."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(total, dtype=np.int64) + shift


def covered(starts: np.ndarray, size: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a window that begins at one of the starts."""
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + size, n), -1)
    return np.cumsum(marks[:n]) > 0


def without_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray, begin: int, end: int) -> str:
    """Of one document, from byte `begin` to `end` with the words given, the text without the words marked as gone.

    What stands around a run of such words stays; what stands between them goes.
    """
    if not gone.any():
        return data[begin:end].tobytes().decode()
    parts, at = [], begin
    first = gone & ~np.concatenate(([False], gone[:-1]))
    last = gone & ~np.concatenate((gone[1:], [False]))
    for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True):
        parts.append(data[at:a].tobytes())
        at = b
    parts.append(data[at:end].tobytes())
    return b"".join(parts).decode()
