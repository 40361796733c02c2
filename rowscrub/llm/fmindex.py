"""Benchmark decontamination with an FM-index per shard of the corpus.

A shard is a slice of documents. Its words become symbols: a number for each word that the benchmark uses, 0 for all others.
Only stretches of benchmark words that are long enough for a window are indexed: their suffix array gives the
Burrows-Wheeler transform, which is kept as a wavelet tree, and a sample of suffix positions. All windows of the benchmark are
searched backwards at once; each occurrence steps back to a sampled position, and the hit words are merged to spans.

The benchmark is sent to the tasks in blocks of bounded size; with several blocks the documents pass one after the other.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from rowscrub.llm.arrays import ALNUM, LOWER, covered, hash_spans, per_document, ragged, slices, spans, text_bytes, without_words
from rowscrub.llm.rounds import rest_of, result_schema, with_rest

WINDOW = 10
BLOCK_BYTES = 8 << 20
"""Benchmark text of one block."""
SAMPLE = 8
"""Every so many positions the suffix array is kept."""


class Words(NamedTuple):
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray
    hashes: np.ndarray


def words_of(column: pa.Array) -> Words:
    data, offsets = text_bytes(column)
    lowered = LOWER[data]
    starts, ends = spans(ALNUM[lowered], offsets)
    return Words(data, starts, ends, per_document(starts, offsets), hash_spans(lowered, starts, ends))


class Phrases:
    """The windows of one block of the benchmark: symbols of its words, distinct windows, and the items that have each."""

    def __init__(self, items: list[Row]) -> None:
        words = words_of(pa.array([row.text for row in items], pa.large_string()))
        names = ["null" if row.item_id is None else str(row.item_id) for row in items]
        self.names = sorted(set(names))
        number = {name: i for i, name in enumerate(self.names)}
        self.vocabulary = np.unique(words.hashes)
        symbols = np.searchsorted(self.vocabulary, words.hashes) + 1
        by_window: dict[tuple[int, ...], set[int]] = {}
        for i, name in enumerate(names):
            item = symbols[words.firsts[i] : words.firsts[i + 1]].tolist()
            for at in range(max(1, len(item) - WINDOW + 1) if item else 0):
                by_window.setdefault(tuple(item[at : at + WINDOW]), set()).add(number[name])
        windows = list(by_window)
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.shortest = int(self.lengths.min()) if windows else 0
        self.windows = np.zeros((len(windows), WINDOW), np.int64)
        for row, window in zip(self.windows, windows, strict=True):
            row[: len(window)] = window
        owners = [sorted(by_window[w]) for w in windows]
        self.n_owners = np.array([len(o) for o in owners], np.int64)
        self.owners = np.array([i for o in owners for i in o], np.int64)
        self.first_owner = np.cumsum(self.n_owners) - self.n_owners


class WaveletTree:
    """Symbols by bits from the highest one, level by level, with the ones before each place counted."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.ones, self.zeros = [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int64))))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = symbols[np.argsort(bit, kind="stable")]

    def place(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Where the first `upto` places lead for a symbol; differences of these are counts of the symbol."""
        at = upto
        for level in range(self.bits):
            ones = self.ones[level][at]
            at = np.where((symbol >> (self.bits - 1 - level)) & 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        return self.place(symbol, upto) - self.place(symbol, np.zeros_like(upto))

    def symbol(self, at: np.ndarray) -> np.ndarray:
        found = np.zeros_like(at)
        for level in range(self.bits):
            ones = self.ones[level]
            bit = ones[at + 1] - ones[at]
            at = np.where(bit, self.zeros[level] + ones[at], at - ones[at])
            found = found * 2 + bit
        return found


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a sequence in which 0 ends a stretch; of equal stretches the earlier one comes first."""
    n = len(text)
    stops = text == 0
    # Separators differ from each other, by place, and come before all symbols.
    ranks = np.where(stops, np.cumsum(stops) - 1, text + int(stops.sum())).astype(np.int64)
    length = 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[: max(n - length, 0)] = ranks[length:] + 1
        keys = ranks * (int(ranks.max()) + 2) + behind
        distinct, ranks = np.unique(keys, return_inverse=True)
        if len(distinct) == n:
            return np.argsort(ranks)
        length *= 2


class FMIndex:
    """Index over stretches of symbols from 1 to `most`, each followed by 0."""

    def __init__(self, text: np.ndarray, most: int) -> None:
        order = suffix_array(text)
        self.tree = WaveletTree(text[order - 1], max(1, int(most).bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=most + 1))))
        # Positions behind a separator are always sampled, as a step back would leave the stretch.
        kept = (order % SAMPLE == 0) | (text[order - 1] == 0)
        self.sampled = np.concatenate(([0], np.cumsum(kept)))
        self.positions = order[kept]
        self.size = len(text)

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window the range of suffixes that begin with it."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.size, np.int64)
        for step in range(windows.shape[1]):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            symbol = windows[live, lengths[live] - 1 - step]
            low[live] = self.before[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to a sampled one."""
        found, steps = np.zeros(len(rows), np.int64), 0
        todo, at = np.arange(len(rows)), rows
        while len(todo):
            kept = self.sampled[at + 1] > self.sampled[at]
            found[todo[kept]] = self.positions[self.sampled[at[kept]]] + steps
            todo, at = todo[~kept], at[~kept]
            symbol = self.tree.symbol(at)
            at = self.before[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return found


def find(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences in a shard: place of the first word and number of the window."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(phrases.lengths) or not len(words.hashes):
        return none
    at = np.minimum(np.searchsorted(phrases.vocabulary, words.hashes), len(phrases.vocabulary) - 1)
    symbols = np.where(phrases.vocabulary[at] == words.hashes, at + 1, 0)
    begins, ends = spans(symbols > 0, words.firsts)
    long = ends - begins >= phrases.shortest
    begins, ends = begins[long], ends[long]
    if not len(begins):
        return none
    # Each stretch with the place behind it, where a 0 goes.
    origin = ragged(begins, ends - begins + 1)
    text = symbols[np.minimum(origin, len(symbols) - 1)]
    text[np.cumsum(ends - begins + 1) - 1] = 0
    index = FMIndex(text, len(phrases.vocabulary))
    low, high = index.search(phrases.windows, phrases.lengths)
    rows = ragged(low, high - low)
    return origin[index.locate(rows)], np.repeat(np.arange(len(low)), high - low)


SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())]))
SCHEMA = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "spans array<struct<first_word: long, n_words: long>>, kept string"
)
PASSED = "doc_id long, text string, places array<long>, items array<string>"


def decontaminated(
    documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, keep_text: bool = True, carry: bool = False
) -> DataFrame:
    """doc_id, counts of words, hit words and items, the items' hash, the merged hit spans, and the text without hit words.

    A window is 10 consecutive words of an item, or a whole shorter item. Null and empty texts have no words, on both
    sides; a null item_id is called `null`; items of one id count once. Null documents keep a null text. Repeated rows give a
    row each; an empty benchmark leaves all documents clean. Other columns are carried in the struct `rest` if asked.
    """
    items = benchmark.selectExpr("cast(item_id as string) item_id", "cast(text as string) text")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    context = documents.sparkSession.sparkContext
    empty = F.array()
    frame = with_rest(documents, carry)
    frame = frame.select("doc_id", "text", empty.cast("array<long>").alias("places"), empty.cast("array<string>").alias("items"), *frame.columns[2:])
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        frame = _pass(frame, context.broadcast(rows), block == blocks - 1, keep_text)
    return frame


def _pass(frame: DataFrame, block, last: bool, keep_text: bool) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(block.value)
        for batch in slices(batches):
            words = words_of(batch.column("text"))
            places, windows = find(words, phrases)
            hit = covered(places, phrases.lengths[windows], len(words.hashes))
            document = np.searchsorted(words.firsts, places, "right") - 1
            owner = ragged(phrases.first_owner[windows], phrases.n_owners[windows])
            pairs = np.unique(np.stack((np.repeat(document, phrases.n_owners[windows]), phrases.owners[owner])), axis=1)
            items = [set(known) for known in batch.column("items").to_pylist()]
            for d, i in pairs.T.tolist():
                items[d].add(phrases.names[i])
            for d, known in enumerate(batch.column("places").to_pylist()):
                hit[words.firsts[d] + np.array(known, np.int64)] = True
            columns = (_final if last else _passed)(batch, words, hit, items, keep_text) | rest_of(batch)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return frame.mapInArrow(scan, result_schema(SCHEMA if last else PASSED, frame))


def _passed(batch: pa.RecordBatch, words: Words, hit: np.ndarray, items: list[set[str]], keep_text: bool) -> dict[str, pa.Array]:
    places = [np.flatnonzero(hit[a:b]).tolist() for a, b in zip(words.firsts[:-1], words.firsts[1:], strict=True)]
    return {
        "doc_id": batch.column("doc_id"),
        "text": batch.column("text"),
        "places": pa.array(places, pa.list_(pa.int64())),
        "items": pa.array([sorted(i) for i in items], pa.list_(pa.string())),
    }


def _final(batch: pa.RecordBatch, words: Words, hit: np.ndarray, items: list[set[str]], keep_text: bool) -> dict[str, pa.Array]:
    sums = np.concatenate(([0], np.cumsum(hit)))
    n_hit = sums[words.firsts[1:]] - sums[words.firsts[:-1]]
    begins, ends = spans(hit, words.firsts)
    bounds = np.searchsorted(begins, words.firsts)
    _, offsets = text_bytes(batch.column("text"))
    nulls = batch.column("text").is_null().to_pylist()
    found, kept = [], []
    for d in range(batch.num_rows):
        a, b = int(words.firsts[d]), int(words.firsts[d + 1])
        found.append([{"first_word": int(s - a), "n_words": int(e - s)} for s, e in zip(begins[bounds[d] : bounds[d + 1]], ends[bounds[d] : bounds[d + 1]], strict=True)])
        whole = keep_text and not nulls[d]
        kept.append(without_words(words.data, words.starts[a:b], words.ends[a:b], hit[a:b], int(offsets[d]), int(offsets[d + 1])) if whole else None)
    return {
        "doc_id": batch.column("doc_id"),
        "n_words": pa.array(np.diff(words.firsts)),
        "n_hit": pa.array(n_hit),
        "n_items": pa.array([len(i) for i in items], pa.int64()),
        "items_sha256": pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items]),
        "contaminated": pa.array(n_hit > 0),
        "spans": pa.array(found, SPANS),
        "kept": pa.array(kept, pa.string()),
    }
