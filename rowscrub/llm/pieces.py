"""Offset-preserving encoding with a SentencePiece BPE model, and decoding.

A text is normalised by the longest prefix that the model's compiled character map knows, or character by character where the
map is empty or knows nothing; the source offset of every normalised byte is recorded on the way. No piece of such a vocabulary
goes on over two characters that stand side by side in none of its pieces, so the normalised text is cut there, and each distinct
chunk is merged once in a worker: best score first, the leftmost of equals. Characters without a piece become their bytes. The
lengths of the pieces, summed up, are places in the normalised text, and the recorded offsets take them to byte spans of the source.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_format

from rowscrub.llm.arrays import slices

# --- fixed values: the format of model files ----------------------------------------------
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE, BPE = 1, 2, 3, 6, 2
# --- end of fixed values ------------------------------------------------------------------

KEPT_CHUNKS = 400_000  # chunks that a worker remembers before it starts anew
SHORT = 48  # characters of a chunk that is remembered
NEVER = float("inf")
BLOCK = 1 << 20
"""Characters of a text whose chunks are held at once."""

NAMES = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "ids", "starts", "ends", "decoded")
SCHEMA = (
    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, "
    "ids array<int>, starts array<long>, ends array<long>, decoded string"
)
ARROW = pa.schema(
    list(zip(NAMES, (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 2, pa.string()), strict=True))
)


class CharacterMap:
    """A compiled character map: a double-array trie of byte strings, and the strings that replace them."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size :]
        self.inert: dict[str, bool] = {}

    def _walk(self, data: bytes, at: int) -> tuple[int, int, int]:
        """Bytes of the longest key that starts here, the place of its replacement, and for how many bytes the trie goes along."""
        units, best, value = self.units, 0, -1
        node = _offset(units[0])
        for n in range(len(data) - at):
            node ^= data[at + n]
            unit = units[node]
            if unit & 0x800000FF != data[at + n]:
                return best, value, n
            node ^= _offset(unit)
            if unit >> 8 & 1:
                best, value = n + 1, units[node] & 0x7FFFFFFF
        return best, value, len(data) - at

    def starts_nothing(self, character: str) -> bool:
        """Is the character the start of no key, so that it stays as it is?"""
        known = self.inert.get(character)
        if known is None:
            data = character.encode()
            known = self.inert[character] = not self.units or self._walk(data, 0)[2] < len(data)
        return known

    def apply(self, text: str) -> Iterator[tuple[bytes, int, bool]]:
        """Stretches of the normalised text, the bytes of their sources, and whether a stretch is its source itself."""
        data = text.encode()
        if not self.units or all(map(self.starts_nothing, set(text))):
            yield data, len(data), True
            return
        at = plain = 0
        while at < len(data):
            n, value, _ = self._walk(data, at)
            if n:
                yield data[plain:at], at - plain, True
                yield self.replacements[value : self.replacements.index(b"\0", value)], n, False
                at = plain = at + n
            else:
                at += 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
        yield data[plain:], len(data) - plain, True


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 0x200) >> 6)


class Encoded(NamedTuple):
    """Ids of the pieces, and the span of source bytes that each stands for."""

    ids: list[int]
    starts: np.ndarray
    ends: np.ndarray


class KnownChunks(dict):
    """Ids of chunks, worked out when first asked for."""

    def __init__(self, work_out) -> None:
        super().__init__()
        self.work_out = work_out

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        found = self.work_out(chunk)
        if len(chunk) <= SHORT:
            if len(self) >= KEPT_CHUNKS:
                self.clear()
            self[chunk] = found
        return found


class PieceModel:
    """A SentencePiece BPE model as it is needed for encoding with offsets; decoding is the library's."""

    def __init__(self, proto: bytes) -> None:
        model = model_format.ModelProto()
        model.ParseFromString(proto)
        self.rules = model.normalizer_spec
        if model.trainer_spec.model_type != BPE or model.trainer_spec.treat_whitespace_as_suffix or not self.rules.escape_whitespaces:
            raise ValueError("a BPE model with white space before its words is needed")
        if not model.trainer_spec.byte_fallback or {p.type for p in model.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("a model with byte fallback and without symbols of the user's is needed")
        self.characters = CharacterMap(self.rules.precompiled_charsmap)
        self.numbers = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.costs = {p.piece: -p.score for p in model.pieces if p.type == NORMAL}.get
        self.number_of, self.size = self.numbers.get, len(model.pieces)
        # A piece can be made of any two pieces that it consists of; equal scores have equal ranks.
        ranks = {score: rank for rank, score in enumerate(sorted({p.score for p in model.pieces}, reverse=True))}
        self.pair_costs: dict[int, int] = {}
        self.pair_ids: dict[int, int] = {}
        for p in model.pieces:
            for i in range(1, len(p.piece) if p.type == NORMAL else 0):
                left, right = self.number_of(p.piece[:i]), self.number_of(p.piece[i:])
                if left is not None and right is not None:
                    self.pair_costs[left * self.size + right] = ranks[p.score]
                    self.pair_ids[left * self.size + right] = self.numbers[p.piece]
        self.bytes = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
        self.shown = [str(i) for i in range(len(model.pieces))]
        self.width = np.array([1 if p.type == BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.is_byte = np.array([p.type == BYTE for p in model.pieces])
        self.side_by_side = {pair for piece in self.numbers for pair in pairwise(piece)}
        joined = sorted({c for pair in self.side_by_side for c in pair} - {SPACE})
        if any(b == SPACE and a != SPACE for a, b in self.side_by_side):
            raise ValueError("white space inside words")
        inside = "".join(map(re.escape, joined))
        self.cut = re.compile(f"{SPACE}*[{inside}]+|{SPACE}+|.", re.DOTALL).findall
        self.known = KnownChunks(self.chunk_ids)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.decode = self.library.decode

    def normalised(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the normalised text and the source offset of each, and of its end."""
        parts = list(self.characters.apply(text))
        data = np.frombuffer(b"".join(part for part, _, _ in parts), np.uint8)
        origin, at = [], 0
        for part, n, same in parts:
            origin.append(np.arange(at, at + n) if same else np.full(len(part), at))
            at += n
        origin.append(np.array([at]))
        places = np.concatenate(origin)
        blank = data == 0x20
        if self.rules.remove_extra_whitespaces:
            held = data.tobytes()
            first, end = len(held) - len(held.lstrip(b" ")), len(held)
            while end > first and held[first:end].endswith((b" ", SPACE.encode())):
                end -= 1 if held[end - 1] == 0x20 else 3
            if first == end:
                return np.zeros(0, np.uint8), np.zeros(1, np.int64)
            keep = ~blank
            keep[1:] |= ~blank[:-1]
            keep[:first] = keep[end:] = False
            places = np.append(places[:-1][keep], places[end])
            data, blank = data[keep], blank[keep]
        data = np.frombuffer(data.tobytes().replace(b" ", SPACE.encode()), np.uint8)
        places = np.append(np.repeat(places[:-1], np.where(blank, 3, 1)), places[-1])
        if self.rules.add_dummy_prefix and len(data):
            data = np.concatenate((np.frombuffer(SPACE.encode(), np.uint8), data))
            places = np.concatenate((np.full(3, places[0]), places))
        return data, places

    def encode(self, text: str) -> Encoded:
        data, places = self.normalised(text)
        whole = data.tobytes().decode()
        ids: list[int] = []
        for part in self.blocks(whole):
            ids += chain.from_iterable(map(self.known.__getitem__, self.cut(part)))
        pieces = np.array(ids, np.int64)
        end = np.cumsum(self.width[pieces])
        start = end - self.width[pieces]
        starts, ends = places[start], places[end]
        # Of the bytes of a character the last one stands for it, those before for nothing.
        lone = np.flatnonzero(self.is_byte[pieces])
        lone = lone[data[start[lone]] >= 0x80]
        if len(lone):
            leads = np.append((data & 0xC0) != 0x80, True)
            begins = np.maximum.accumulate(np.where(leads, np.arange(len(leads)), 0))
            starts[lone] = places[begins[start[lone]]]
            ends[lone] = np.where(leads[end[lone]], ends[lone], starts[lone])
        return Encoded(ids, starts, ends)

    def blocks(self, text: str) -> Iterator[str]:
        """The text in parts of about `BLOCK` characters that no chunk goes on over."""
        at = 0
        while len(text) - at > BLOCK:
            end = at + BLOCK
            while end < len(text) and (text[end - 1], text[end]) in self.side_by_side:
                end += 1
            yield text[at:end]
            at = end
        yield text[at:] if at else text

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        if len(chunk) == 1:
            return self.single(chunk)
        if len(chunk) <= SHORT:
            return self.merge_short(chunk)
        cuts = [i for i, pair in enumerate(pairwise(chunk), 1) if pair not in self.side_by_side]
        if cuts:
            return tuple(chain.from_iterable(self.known[chunk[a:b]] for a, b in pairwise([0, *cuts, len(chunk)])))
        return self.merge_short(chunk) if len(chunk) <= SHORT else self.merge_long(chunk)

    def single(self, symbol: str) -> tuple[int, ...]:
        found = self.numbers.get(symbol)
        return tuple(self.bytes[b] for b in symbol.encode()) if found is None else (found,)

    def merge_short(self, chunk: str) -> tuple[int, ...]:
        """Merges of neighbours by score, leftmost first, until no two make a piece; the best pair is looked for anew after each."""
        ids, costs, size = list(map(self.number_of, chunk)), self.pair_costs.get, self.size
        if None in ids:
            # A character without a piece joins nothing.
            return self.merge_long(chunk)
        pairs = [costs(a * size + b, NEVER) for a, b in pairwise(ids)]
        while pairs:
            best = min(pairs)
            if best is NEVER:
                break
            i = pairs.index(best)
            ids[i] = joined = self.pair_ids[ids[i] * size + ids[i + 1]]
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = costs(ids[i - 1] * size + joined, NEVER)
            if i < len(pairs):
                pairs[i] = costs(joined * size + ids[i + 1], NEVER)
        return tuple(ids)

    def ids_of(self, symbols: list[str]) -> tuple[int, ...]:
        try:
            return tuple(map(self.numbers.__getitem__, symbols))
        except KeyError:
            return tuple(chain.from_iterable(map(self.single, symbols)))

    def merge_long(self, chunk: str) -> tuple[int, ...]:
        """The same with a queue of pairs, for chunks of any length."""
        symbols, costs = list(chunk), self.costs
        before, behind = list(range(-1, len(chunk) - 1)), [*range(1, len(chunk)), -1]
        heap: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            right = behind[left]
            if left >= 0 and right >= 0:
                piece = symbols[left] + symbols[right]
                cost = costs(piece)
                if cost is not None:
                    heapq.heappush(heap, (cost, left, piece))

        for i in range(len(chunk) - 1):
            offer(i)
        while heap:
            _, left, piece = heapq.heappop(heap)
            right = behind[left]
            # Offers outlive the symbols they were made for.
            if not symbols[left] or right < 0 or len(symbols[left]) + len(symbols[right]) != len(piece):
                continue
            symbols[left], symbols[right] = piece, ""
            behind[left] = behind[right]
            if behind[right] >= 0:
                before[behind[right]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        return self.ids_of([s for s in symbols if s])


@functools.lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    with open(path, "rb") as file:
        return PieceModel(file.read())


def _encoded(batch: pa.RecordBatch, model: PieceModel, keep: bool) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in NAMES[1:]]
    for text in batch.column("text").to_pylist():
        ids, starts, ends = model.encode(text or "")
        decoded = model.decode(ids)
        row = [
            len(ids),
            hashlib.sha256(",".join(map(model.shown.__getitem__, ids)).encode()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest(),
            hashlib.sha256(np.stack((starts, ends)).astype("<i8").tobytes()).hexdigest(),
        ]
        for column, value in zip(columns, row + ([ids, starts, ends, decoded] if keep else [None] * 4), strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, ARROW.types[1:], strict=True))], schema=ARROW)


def encoded_pieces(documents: DataFrame, path: str, keep_pieces: bool = True) -> DataFrame:
    """doc_id, n_tokens, hashes of the ids (decimal, joined by commas), of the decoded text and of the spans (all starts, then all
    ends, as little-endian 64-bit numbers), and the ids, the spans of source bytes and the decoded text themselves.

    `path` names a model file that all executors can read. A null text counts as empty and has no pieces. The span of the piece
    that holds a leading space of the model's own leaves it out; of a character written as bytes the last byte has the span, those
    before are empty. Every row is encoded by itself, so null or repeated ids and repeated rows give a row each; an
    empty table gives no rows; other columns are not carried. With `keep_pieces=False` the last four columns are null.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in slices(batches):
            yield _encoded(batch, model, keep_pieces)

    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(encode, SCHEMA)
