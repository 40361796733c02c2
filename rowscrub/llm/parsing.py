"""Removal of repeated byte strings by prefix-free parsing.

Every 100-byte string has a trigger: the place of the least rolling hash among the 32-byte grams inside it. Neighbouring
strings with one trigger form a phrase, which overlaps the next one by 99 bytes, so that each string lies in exactly one phrase,
and its trigger follows from its own bytes. The dictionary holds each distinct phrase once, with its earliest place; the
parse is the sequence of phrases of the documents. Three rounds narrow down what has to be compared:

1. trigger grams: a phrase whose gram occurs nowhere else repeats nothing;
2. phrases: of equal ones all but the earliest are repeated as a whole, so only the dictionary is looked at further, and
   of it only phrases that share a trigger gram with a different one;
3. strings of these phrases: a suffix array of each chunk's part of the dictionary puts equal 100-byte strings next to each
   other; with the places from the parse it gives the earliest of each, and the chunks' orders are merged by hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rowscrub.llm.arrays import MULTIPLIER, SECOND, U64, eight_bytes, hash_spans, mixed, ragged, text_bytes
from rowscrub.llm.rounds import Documents, Replies, ask, bits, dealt, finish, flags, in_chunks, split

MATCH = 100
GRAM = 32
REACH = MATCH - GRAM + 1
PIECE = 1 << 16
"""Bytes whose hashes are held at once; so few that they stay in the cache of a core."""
STEPS = (*range(0, MATCH - 8, 8), MATCH - 8)
"""Where the eight-byte pieces of a string begin; the last two overlap."""

NAMES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
ARROW = pa.schema(list(zip(NAMES, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)))
FAR = np.iinfo(np.int64).max
LOW = U64(0xFFFFFFFF)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the `GRAM` bytes at every position that has so many."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, U64)
    word = eight_bytes(data)
    h = mixed(word[:n] + MULTIPLIER)
    for at in range(8, GRAM, 8):
        h = (h ^ word[at : at + n]) * MULTIPLIER
        h ^= h >> U64(29)
    return mixed(h)


def least_places(values: np.ndarray, reach: int) -> np.ndarray:
    """For every window of `reach` values the place of its least one, the first of equals."""
    n = len(values) - reach + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # The low bits carry the place, so that a minimum is a place and ties go to the first.
    width = 21
    tagged = (values >> U64(width) << U64(width)) | np.arange(len(values), dtype=U64)
    blocks = -(-len(values) // reach)
    padded = np.full(blocks * reach, np.iinfo(np.uint64).max, U64)
    padded[: len(values)] = tagged
    square = padded.reshape(blocks, reach)
    forward = np.minimum.accumulate(square, axis=1).ravel()
    backward = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(backward[:n], forward[reach - 1 : reach - 1 + n])
    return (least & U64((1 << width) - 1)).astype(np.int64)


def phrases(data: np.ndarray, offsets: np.ndarray):
    """start, number of windows, trigger place of every phrase of the documents, in order."""
    starts, counts, triggers = [], [], []
    for a in range(0, max(len(data) - MATCH + 1, 0), PIECE):
        part = data[a : a + PIECE + MATCH - 1]
        place = least_places(gram_hashes(part), REACH)
        at = np.arange(a, a + len(place))
        ends = offsets[np.searchsorted(offsets, at, "right")] if len(at) else at
        whole = at + MATCH <= ends
        place = place + a
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | ~whole[:-1]
        first = np.flatnonzero(new & whole)
        # A phrase lasts until the next one starts or the windows of the document end.
        last = np.flatnonzero(whole & np.append(new[1:] | ~whole[1:], True))
        starts.append(at[first])
        counts.append(last - first + 1)
        triggers.append(place[first])
    if not starts:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(triggers)


def string_hashes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Hash of the `MATCH` bytes at each place."""
    word, h = eight_bytes(data), np.zeros(len(places), U64)
    for step in STEPS:
        h = mixed(h * SECOND + word[places + step])
    return h


def suffix_order(data: np.ndarray, places: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places by the `MATCH` bytes at them, and which of these strings differ from the one before.

    Sorted by eight bytes at first; then only those are compared further that are still tied with a different string, as their
    hashes tell. The text goes on for `MATCH` bytes after each place.
    """
    word = eight_bytes(data)
    keys = word[places].byteswap()
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(places), bool)
    new[1:] = np.diff(keys[order]) != 0
    todo = np.arange(len(places))
    for step in STEPS[1:]:
        first, own = new[todo], hashes[order[todo]]
        differs = np.append(False, own[1:] != own[:-1]) & ~first
        group = np.cumsum(first) - 1
        mixed_group = np.bincount(group, weights=differs, minlength=1) > 0
        open_ = mixed_group[group]
        todo, group = todo[open_], group[open_]
        if not len(todo):
            break
        part = order[todo]
        keys = word[places[part] + step].byteswap()
        again = np.lexsort((keys, group))
        order[todo], keys = part[again], keys[again]
        new[todo[1:]] |= keys[1:] != keys[:-1]
    return order, new


def suffix_ranks(data: np.ndarray) -> np.ndarray:
    """Rank of the `MATCH` bytes at every place of a text; equal strings have equal ranks. Zeros follow the end."""
    padded = np.append(data, np.zeros(MATCH, np.uint8))
    places = np.arange(len(data))
    order, new = suffix_order(padded, places, string_hashes(padded, places))
    ranks = np.empty(len(data), U64)
    ranks[order] = (np.cumsum(new) - 1).astype(U64)
    return ranks


class Parse:
    """The phrases of a chunk and what is asked about them."""

    def __init__(self, documents: Documents, buckets: int) -> None:
        self.ids = documents.ids
        self.data, self.offsets = text_bytes(documents.column)
        self.starts, self.counts, triggers = phrases(self.data, self.offsets)
        grams = hash_spans(self.data, triggers, triggers + GRAM)
        # The bucket comes from the upper half, 32 bits within it from the lower half.
        self.grams = ((grams >> U64(32)) % U64(buckets) << U64(32)) | (grams & LOW)
        self.distinct, self.which, times = np.unique(self.grams, return_inverse=True, return_counts=True)
        self.several = times > 1
        self.buckets = buckets

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, places, "right") - 1

    def shared(self, replies: Replies) -> np.ndarray:
        """Phrases whose trigger gram occurs more than once."""
        found = np.zeros(len(self.distinct), bool)
        for bucket, part in dealt(self.distinct >> U64(32), self.buckets):
            found[part] = flags(replies[1, bucket], part.stop - part.start)
        return np.flatnonzero(found[self.which])

    def dictionary(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the distinct phrases among these, by bucket: hash and earliest phrase; and for each of these its number."""
        ends = self.starts[shared] + self.counts[shared] + MATCH - 1
        keys = np.empty(len(shared), [("gram", U64), ("phrase", U64)])
        keys["gram"] = self.grams[shared]
        keys["phrase"] = hash_spans(self.data, self.starts[shared], ends)
        order = np.lexsort((shared, keys["phrase"], keys["gram"]))
        new = np.ones(len(order), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        return keys[first], shared[first], which

    def strings(self, chosen: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All 100-byte strings of these phrases: their places; bucket and hash of the distinct ones, by bucket; each string's
        number among these; and the earliest place of each."""
        places = ragged(self.starts[chosen], self.counts[chosen])
        if not len(places):
            return (np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        hashes = string_hashes(self.data, places)
        order, new = suffix_order(self.data, places, hashes)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        begins = np.flatnonzero(new)
        earliest = np.minimum.reduceat(places[order], begins)
        representative = order[begins]
        word, bucket = eight_bytes(self.data), np.zeros(len(begins), U64)
        for step in STEPS:
            bucket = (bucket ^ word[places[representative] + step]) * MULTIPLIER
            bucket ^= bucket >> U64(31)
        h, bucket = hashes[representative], mixed(bucket) % U64(buckets)
        order = np.argsort(bucket.astype(np.min_scalar_type(buckets)), kind="stable")  # a radix sort for up to 16 bits
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        return places, bucket[order], h[order], number[which], earliest[order]


def _occurs_again(keys: list[bytes], extra: list[bytes]) -> list[bytes]:
    """Which trigger grams occur more than once."""
    parts = [np.frombuffer(k, np.uint32) for k in keys]
    lengths = [len(p) for p in parts]
    several = np.concatenate([flags(e, n) for e, n in zip(extra, lengths, strict=True)])
    distinct, which, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    again = counts > 1
    again[which[several]] = True
    return [bits(part) for part in split(again[which], lengths)]


def _owners(keys: list[bytes], extra: list[bytes]) -> list[bytes]:
    """Two bits for each phrase: the chunk has its earliest occurrence; other phrases share its trigger gram."""
    parts = [np.frombuffer(k, "<u4,<u8") for k in keys]
    lengths = [len(p) for p in parts]
    items = np.concatenate(parts)
    ids = np.concatenate([np.frombuffer(e, np.int64) for e in extra])
    order = np.lexsort((ids, items["f1"], items["f0"]))
    gram, phrase = items["f0"][order], items["f1"][order]
    new_gram = np.ones(len(order), bool)
    new_gram[1:] = gram[1:] != gram[:-1]
    new = new_gram.copy()
    new[1:] |= phrase[1:] != phrase[:-1]
    group = np.cumsum(new_gram) - 1
    first, several = np.zeros(len(order), bool), np.zeros(len(order), bool)
    first[order] = new
    several[order] = (np.bincount(group, weights=new) > 1)[group]
    return [bits(np.concatenate((a, b))) for a, b in zip(split(first, lengths), split(several, lengths), strict=True)]


def _earlier(keys: list[bytes], extra: list[bytes]) -> list[bytes]:
    """Which strings another chunk has in a smaller document."""
    parts = [np.frombuffer(k, np.uint64) for k in keys]
    lengths = [len(p) for p in parts]
    ids = np.concatenate([_ids(e, n) for e, n in zip(extra, lengths, strict=True)])
    distinct, which = np.unique(np.concatenate(parts), return_inverse=True)
    least = np.full(len(distinct), FAR)
    np.minimum.at(least, which, ids)
    return [bits(part) for part in split(least[which] < ids, lengths)]


def _short(ids: np.ndarray) -> bytes:
    """Numbers as offsets of four bytes from the least one, or eight bytes each if they do not fit."""
    low = int(ids.min())
    if int(ids.max()) - low < 1 << 32:
        return np.int64(low).tobytes() + (ids - low).astype(np.uint32).tobytes()
    return ids.astype(np.int64).tobytes()


def _ids(data: bytes, n: int) -> np.ndarray:
    if len(data) == 8 + 4 * n:
        low = np.frombuffer(data, np.int64, 1)[0]
        return np.frombuffer(data, np.uint32, n, 8).astype(np.int64) + low
    return np.frombuffer(data, np.int64)


def removed_strings(documents: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every document.

    Texts are UTF-8 bytes; matches never cross documents, and cuts may fall inside a character, so what is left is binary
    (`keep_bytes=False` leaves null there). Null counts as empty. A null doc_id comes after all others; rows with the same doc_id
    count in the order of their texts. An empty table gives no rows; other columns are not carried.
    """
    chunked = in_chunks(documents)
    gram_buckets = chunked.buckets(2 / (REACH + 1))
    string_buckets = chunked.buckets(1 / 12)

    def send_grams(documents: Documents, replies: Replies):
        parse = Parse(documents, gram_buckets)
        for bucket, part in dealt(parse.distinct >> U64(32), gram_buckets):
            yield bucket, (parse.distinct[part] & LOW).astype(np.uint32).tobytes(), bits(parse.several[part])

    def send_phrases(documents: Documents, replies: Replies):
        parse = Parse(documents, gram_buckets)
        keys, first, _ = parse.dictionary(parse.shared(replies))
        ids = documents.ids[parse.document(parse.starts[first])]
        for bucket, part in dealt(keys["gram"] >> U64(32), gram_buckets):
            items = np.empty(part.stop - part.start, "<u4,<u8")
            items["f0"], items["f1"] = keys["gram"][part] & LOW, keys["phrase"][part]
            yield bucket, items.tobytes(), ids[part].tobytes()

    def owned(parse: Parse, keys: np.ndarray, replies: Replies) -> tuple[np.ndarray, np.ndarray]:
        first, several = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        for bucket, part in dealt(keys["gram"] >> U64(32), gram_buckets):
            n = part.stop - part.start
            both = flags(replies[2, bucket], 2 * n)
            first[part], several[part] = both[:n], both[n:]
        return first, several

    def send_strings(documents: Documents, replies: Replies):
        parse = Parse(documents, gram_buckets)
        keys, earliest, _ = parse.dictionary(parse.shared(replies))
        first, several = owned(parse, keys, replies)
        _, bucket, hashes, _, places = parse.strings(np.sort(earliest[first & several]), string_buckets)
        ids = documents.ids[parse.document(places)]
        for number, part in dealt(bucket, string_buckets):
            yield number, hashes[part].tobytes(), _short(ids[part])

    def remove(documents: Documents, replies: Replies) -> pa.Table:
        parse = Parse(documents, gram_buckets)
        shared = parse.shared(replies)
        keys, earliest, which = parse.dictionary(shared)
        first, several = owned(parse, keys, replies)
        # Whole phrases that occur earlier, in this chunk or in another one.
        whole = shared[~first[which] | (shared != earliest[which])]
        places, bucket, _, number, at = parse.strings(np.sort(earliest[first & several]), string_buckets)
        elsewhere = np.zeros(len(at), bool)
        for b, part in dealt(bucket, string_buckets):
            elsewhere[part] = flags(replies[3, b], part.stop - part.start)
        single = places[elsewhere[number] | (places > at[number])]
        n = len(parse.data)
        marks = np.zeros(n + 1, np.int32)
        np.add.at(marks, parse.starts[whole], 1)
        np.add.at(marks, parse.starts[whole] + parse.counts[whole] + MATCH - 1, -1)
        np.add.at(marks, single, 1)
        np.add.at(marks, single + MATCH, -1)
        gone = np.cumsum(marks[:n]) > 0
        totals = np.concatenate(([0], np.cumsum(gone)))
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        border = parse.offsets[:-1][np.diff(parse.offsets) > 0]
        opens[border] = gone[border]
        runs = np.concatenate(([0], np.cumsum(opens)))
        a, b = parse.offsets[:-1], parse.offsets[1:]
        kept = [parse.data[i:j][~gone[i:j]].tobytes() for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        return pa.Table.from_arrays(
            [
                documents.rows.column("doc_id"),
                pa.array(b - a),
                pa.array(totals[b] - totals[a]),
                pa.array(runs[b] - runs[a]),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                pa.array(kept if keep_bytes else [None] * len(kept), pa.binary()),
            ],
            schema=ARROW,
        )

    known = ask(chunked, None, 1, send_grams, _occurs_again)
    known = ask(chunked, known, 2, send_phrases, _owners)
    known = ask(chunked, known, 3, send_strings, _earlier)
    return finish(chunked, known, remove, SCHEMA)
