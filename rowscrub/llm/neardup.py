"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its shingles of five words (lower-cased; a shorter document is one shingle). The weight of
a shingle is its count times an inverse document frequency that is scaled to lie between 1 - IDF_SHARE and 1, so that a
similarity of 0.8 means about the same for rare and for common text. Document frequencies are counted over all documents.

Weighted samples are banded. Documents that share a band are compared by their exact weighted Jaccard similarity, within
groups that are split into blocks of bounded size; pairs that are already connected are not compared. Classes are the connected
components of the verified links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscrub.llm.arrays import ALNUM, LOWER, MULTIPLIER, SECOND, U64, hash_spans, mixed, per_document, spans, text_bytes, window_hashes
from rowscrub.llm.rounds import (
    Chunked,
    Documents,
    Replies,
    ask,
    bits,
    dealt,
    documents_of,
    finish,
    flags,
    in_chunks,
    replies_of,
    split,
    written,
)

SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 16, 4
"""At similarity 0.8 a pair shares no band with probability (1 - 0.8 ** 4) ** 16 = 0.0002."""
IDF_SHARE = 0.1
BLOCK = 512
"""Documents of a block of candidates, on average."""
SALTS = 16
LOW = U64(0xFFFFFFFF)
STEPS_OF_TWO = 8  # document frequencies are rounded to eighths of a power of two


class Shingles:
    """The weighted sets of a chunk: for each document its distinct shingles in order, with counts."""

    def __init__(self, documents: Documents, buckets: int) -> None:
        data, offsets = text_bytes(documents.column)
        lowered = LOWER[data]
        starts, ends = spans(ALNUM[lowered], offsets)
        firsts = per_document(starts, offsets)
        words = hash_spans(lowered, starts, ends)
        del data, lowered
        n = np.diff(firsts)
        owner = np.repeat(np.arange(len(n)), np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64)))
        place = np.arange(len(owner)) - np.repeat(np.cumsum(np.bincount(owner, minlength=len(n))) - np.bincount(owner, minlength=len(n)), np.bincount(owner, minlength=len(n)))
        padded = np.concatenate((words, np.zeros(SHINGLE, U64)))
        at = firsts[:-1][owner] + place
        h = window_hashes(padded, SHINGLE)[at]
        for d in np.flatnonzero((n > 0) & (n < SHINGLE)):
            short = mixed(words[firsts[d] : firsts[d + 1]] * SECOND + MULTIPLIER * np.arange(1, n[d] + 1, dtype=U64))
            h[np.searchsorted(owner, d)] = short.sum(dtype=U64)
        # The bucket comes from the upper half, 32 bits within it from the lower half.
        keys = ((h >> U64(32)) % U64(buckets) << U64(32)) | (h & LOW)
        by_key = np.argsort(keys)
        order = by_key[np.argsort(owner[by_key], kind="stable")]
        keys, owner = keys[order], owner[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        self.keys, self.owner = keys[first], owner[first]
        self.times = np.diff(np.append(first, len(keys)))
        self.bounds = np.searchsorted(self.owner, np.arange(len(n) + 1))
        self.buckets = buckets

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of the chunk, each shingle's number among them, and how many documents have each."""
        return np.unique(self.keys, return_inverse=True, return_counts=True)

    def weights(self, replies: Replies, documents: int) -> np.ndarray:
        """TF-IDF weight of each shingle of each document."""
        distinct, which, _ = self.distinct()
        levels = np.zeros(len(distinct), np.uint16)
        for bucket, part in dealt(distinct >> U64(32), self.buckets):
            data = replies[1, bucket]
            n = part.stop - part.start
            shared = flags(data[: -(-n // 8)], n)
            inside = np.zeros(n, np.uint16)
            inside[shared] = np.frombuffer(data[-(-n // 8) :], np.uint16)
            levels[part] = inside
        frequency = 2.0 ** (levels / STEPS_OF_TWO)
        idf = np.clip(np.log((1 + documents) / (1 + frequency)) / math.log1p(documents), 0, 1) if documents else frequency
        return (self.times * (1 - IDF_SHARE + IDF_SHARE * idf)[which]).astype(np.float32)

    def nodes(self) -> list[bytes | None]:
        """A 128-bit name of each document's weighted set; none without words."""
        value = mixed(self.keys * SECOND + self.times.astype(U64))
        sums = [np.concatenate((np.zeros(1, U64), np.cumsum(v, dtype=U64))) for v in (value, mixed(value ^ MULTIPLIER))]
        a, b = ((s[self.bounds[1:]] - s[self.bounds[:-1]]).astype(">u8") for s in sums)
        return [x.tobytes() + y.tobytes() if e > s else None for x, y, s, e in zip(a, b, self.bounds[:-1], self.bounds[1:], strict=True)]


def _tables(size: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) variates and logarithms of others, by a fixed seed: equal on every machine."""
    draw = np.random.Generator(np.random.PCG64(20_240_229))
    return draw.gamma(2.0, 1.0, size).astype(np.float32), np.log(draw.gamma(2.0, 1.0, size)).astype(np.float32)


GAMMA, LOG_GAMMA = _tables()


def consistent_samples(keys: np.ndarray, weights: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """Improved consistent weighted sampling: for each set (from its start on) `count` samples of shingle and level.

    The random r, c and beta of a shingle come from its key and the sample's number only. A sample is the shingle with
    the least ln c - r (t - beta + 1), t = floor(ln weight / r + beta), together with t.
    """
    found = np.empty((len(starts), count), U64)
    logs = np.log(weights.astype(np.float32))
    seeds = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, count, dtype=np.uint64) * U64(2) + U64(1)
    base = mixed(keys)

    def drawn(part: np.ndarray | slice, seed: np.uint64) -> tuple[np.ndarray, ...]:
        """r, ln c, beta and t of these shingles."""
        x = base[part] * seed
        r = np.take(GAMMA, (x >> U64(48)).view(np.int64), mode="clip")
        log_c = np.take(LOG_GAMMA, (x >> U64(32) & U64(0xFFFF)).view(np.int64), mode="clip")
        beta = (x >> U64(16)).astype(np.uint16) * np.float32(1 / 65536)
        return r, log_c, beta, np.floor(logs[part] / r + beta)

    piece = 1 << 16
    packed = np.empty(len(keys), U64)
    for k in range(count):
        for a in range(0, len(keys), piece):
            r, log_c, beta, t = drawn(slice(a, a + piece), seeds[k])
            bits_ = (log_c - r * (t - beta + np.float32(1))).view(np.int32)
            # As an unsigned number in the order of the values, with the shingle's place behind it.
            order = np.where(bits_ < 0, ~bits_, bits_ ^ np.int32(-(2**31))).view(np.uint32)
            packed[a : a + piece] = (order.astype(U64) << U64(32)) | np.arange(a, min(a + piece, len(keys)), dtype=U64)
        least = (np.minimum.reduceat(packed, starts) & LOW).astype(np.int64)
        found[:, k] = mixed(base[least] + drawn(least, seeds[k])[3].astype(np.int64).astype(U64) * MULTIPLIER) & LOW
    return found


def _frequencies(keys: list[bytes], extra: list[bytes]) -> list[bytes]:
    """For each key: whether several documents have it, and then the rounded logarithm of their number."""
    parts = [np.frombuffer(k, np.uint32) for k in keys]
    lengths = [len(p) for p in parts]
    counts = np.concatenate([_counts(e, n) for e, n in zip(extra, lengths, strict=True)])
    distinct, which = np.unique(np.concatenate(parts), return_inverse=True)
    totals = np.bincount(which, weights=counts, minlength=len(distinct))[which]
    levels = np.round(STEPS_OF_TWO * np.log2(totals)).astype(np.uint16)
    return [bits(total > 1) + level[total > 1].tobytes() for total, level in zip(split(totals, lengths), split(levels, lengths), strict=True)]


def _packed_counts(counts: np.ndarray) -> bytes:
    several = counts > 1
    return bits(several) + counts[several].astype(np.uint32).tobytes()


def _counts(data: bytes, n: int) -> np.ndarray:
    several = flags(data[: -(-n // 8)], n)
    counts = np.ones(n, np.int64)
    counts[several] = np.frombuffer(data[-(-n // 8) :], np.uint32)
    return counts


SIGNED = "chunk int, doc_id long, node binary, bands array<long>"
SIGNED_ARROW = pa.schema([("chunk", pa.int32()), ("doc_id", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64()))])


def document_frequencies(chunked: Chunked, buckets: int) -> DataFrame:
    def send(documents: Documents, replies: Replies):
        shingles = Shingles(documents, buckets)
        distinct, _, counts = shingles.distinct()
        for bucket, part in dealt(distinct >> U64(32), buckets):
            yield bucket, (distinct[part] & LOW).astype(np.uint32).tobytes(), _packed_counts(counts[part])

    return ask(chunked, None, 1, send, _frequencies)


def signatures(chunked: Chunked, frequencies: DataFrame, buckets: int) -> DataFrame:
    """chunk, doc_id, node and the hashes of the bands; documents without words have neither node nor bands."""
    total = chunked.rows

    def sign(documents: Documents, replies: Replies) -> pa.Table:
        shingles = Shingles(documents, buckets)
        full = np.flatnonzero(np.diff(shingles.bounds) > 0)
        bands: list[list[int] | None] = [None] * len(documents.ids)
        if len(full):
            samples = consistent_samples(shingles.keys, shingles.weights(replies, total), shingles.bounds[full], BANDS * BAND_ROWS)
            samples = samples.reshape(len(full), BANDS, BAND_ROWS)
            h = np.zeros((len(full), BANDS), U64)
            for row in range(BAND_ROWS):
                h = mixed((h + samples[:, :, row]) * MULTIPLIER + SECOND)
            for d, hashes in zip(full, h.view(np.int64).tolist(), strict=True):
                bands[d] = hashes
        return pa.Table.from_arrays(
            [documents.rows.column("chunk"), documents.rows.column("doc_id"), pa.array(shingles.nodes(), pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            schema=SIGNED_ARROW,
        )

    return finish(chunked, frequencies, sign, SIGNED)


def candidates(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes, each with the place of one of its documents; and (leader, node) for every node that shares a band with its
    least one. Any two nodes that share a band so share a leader."""
    named = signed.where("node is not null")
    nodes = named.groupBy("node").agg(F.min(F.struct("doc_id", "chunk")).alias("at"), F.first("bands").alias("bands"))
    banded = nodes.select("node", F.posexplode("bands").alias("band", "hash"))
    leaders = banded.groupBy("band", "hash").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    pairs = banded.join(leaders, ["band", "hash"]).select("leader", "node").distinct()
    return nodes.select("node", "at.doc_id", "at.chunk"), pairs


SETS = "bucket int, block long, node binary, part int, label binary, keys binary, weights binary"
SETS_ARROW = pa.schema(
    [("bucket", pa.int32()), ("block", pa.int64()), ("node", pa.binary()), ("part", pa.int32()), ("label", pa.binary()), ("keys", pa.binary()), ("weights", pa.binary())]
)
WANTED = "chunk int, node binary, block long, part int, label binary"


def _sets(chunked: Chunked, frequencies: DataFrame, wanted: DataFrame, buckets: int, groups: int) -> DataFrame:
    """The weighted sets of the wanted nodes, once for each block that wants them."""
    total = chunked.rows
    known = frequencies.select("chunk", "round", "bucket", "reply", F.lit(None).cast("binary").alias("node"), F.lit(0).cast("long").alias("block"), F.lit(0).alias("part"), F.lit(None).cast("binary").alias("label"))
    asked = wanted.select("chunk", F.lit(0).alias("round"), F.lit(0).alias("bucket"), F.lit(None).cast("binary").alias("reply"), "node", "block", "part", "label")

    def look_up(documents: pa.Table, table: pa.Table) -> pa.Table:
        rounds = table.column("round").to_numpy()
        requests = table.filter(pa.array(rounds == 0))
        if not documents.num_rows or not requests.num_rows:
            return SETS_ARROW.empty_table()
        shingles = Shingles(documents_of(documents), buckets)
        weights = shingles.weights(replies_of(table.filter(pa.array(rounds > 0)).select(["chunk", "round", "bucket", "reply"])), total)
        place = {node: d for d, node in enumerate(shingles.nodes()) if node}
        rows = []
        for request in requests.select(["node", "block", "part", "label"]).to_pylist():
            d = place[request["node"]]
            part = slice(shingles.bounds[d], shingles.bounds[d + 1])
            # Keys of four bytes, in order of the upper ones first: equal sets of keys stay equal.
            keys = (mixed(shingles.keys[part]) & LOW).astype(np.uint32)
            order = np.argsort(keys, kind="stable")
            rows.append((request["block"] % groups, request["block"], request["node"], request["part"], request["label"], keys[order].tobytes(), weights[part][order].tobytes()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SETS_ARROW.types, strict=True)], schema=SETS_ARROW)

    return chunked.frame.groupBy("chunk").cogroup(known.unionByName(asked).groupBy("chunk")).applyInArrow(look_up, SETS)


def one_to_many(keys: np.ndarray, weights: np.ndarray, others: np.ndarray, other_weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of one set with many, which follow each other within bounds."""
    at = np.minimum(np.searchsorted(keys, others), len(keys) - 1)
    both = np.where(keys[at] == others, np.minimum(weights[at], other_weights), 0.0)
    common = np.add.reduceat(both, bounds[:-1])
    total = np.add.reduceat(other_weights, bounds[:-1]) + weights.sum() - common
    return common / total


def linked(nodes: list[bytes], parts: list[int], labels: list[bytes], keys: list[bytes], weights: list[bytes], similarity: float) -> Iterator[tuple[bytes, bytes]]:
    """Links that connect all nodes of a block that verified pairs connect.

    Nodes of one label are connected already. Two nodes of the same part (from 0 on) have been compared before.
    """
    n = len(nodes)
    comp = np.unique(np.array(labels, object), return_inverse=True)[1]
    part = np.array(parts)
    sets = [(np.frombuffer(k, np.uint32), np.frombuffer(w, np.float32).astype(np.float64)) for k, w in zip(keys, weights, strict=True)]
    sizes = np.array([w.sum() for _, w in sets])
    done = np.zeros(n, bool)
    while True:
        # The next one: the least node first, then those outside the largest component.
        counts = np.bincount(comp)
        open_ = np.flatnonzero(~done & ((comp != counts.argmax()) | ~done.any()))
        if not len(open_) or (counts > 0).sum() == 1:
            return
        q = int(open_[0])
        done[q] = True
        small, large = np.minimum(sizes, sizes[q]), np.maximum(sizes, sizes[q])
        others = np.flatnonzero((comp != comp[q]) & ((part != part[q]) | (part < 0)) & (small >= similarity * large) & (np.arange(n) != q) & ~(done & (np.arange(n) != q)))
        if not len(others):
            continue
        bounds = np.concatenate(([0], np.cumsum([len(sets[o][0]) for o in others])))
        found = one_to_many(*sets[q], np.concatenate([sets[o][0] for o in others]), np.concatenate([sets[o][1] for o in others]), bounds)
        for o in others[found >= similarity]:
            if comp[o] != comp[q]:
                comp[comp == comp[o]] = comp[q]
                yield nodes[q], nodes[o]


LINKS = "a binary, b binary"
LINKS_ARROW = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _verified(sets: DataFrame, similarity: float) -> DataFrame:
    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("node", "ascending")])
        blocks = table.column("block").to_numpy()
        cuts = np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 1 if len(blocks) else 0))
        links: list[tuple[bytes, bytes]] = []
        for a, b in zip(cuts, [*cuts[1:], len(blocks)], strict=True):
            block = table.slice(a, b - a)
            links += linked(*(block.column(c).to_pylist() for c in ("node", "part", "label", "keys", "weights")), similarity)
        return pa.Table.from_arrays([pa.array([x for x, _ in links], pa.binary()), pa.array([y for _, y in links], pa.binary())], schema=LINKS_ARROW)

    return sets.groupBy("bucket").applyInArrow(verify, LINKS)


def components(links: DataFrame) -> DataFrame:
    """node and label, the least node that links lead to, for every node with a link."""
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    edges = written(both, "links")
    labels = written(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        reached = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = labels.join(reached, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # A label's own label is as near: paths are halved.
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = written(nearer.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """doc_id and class_id, the least doc_id of its class, for every document.

    Equal weighted sets are one class; others are linked if their weighted Jaccard similarity is at least `similarity`. Documents
    without words (null texts too) are classes of their own. Rows with the same doc_id and different texts may be in different
    classes. A null doc_id counts as the largest when the least is taken; a class of nothing else has a null class_id. An
    empty table gives no rows; other columns are not carried.
    """
    chunked = in_chunks(documents, by_text=True)
    buckets = chunked.buckets(1 / 6)
    frequencies = written(document_frequencies(chunked, buckets), "frequencies")
    signed = written(signatures(chunked, frequencies, buckets), "signatures")
    nodes, pairs = candidates(signed)
    pairs = written(pairs.join(nodes, "node"), "candidates")
    labels = components(_links(chunked, frequencies, pairs, buckets, similarity, block))
    classes = signed.select("doc_id", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # Only classes of several documents have a least one to look up; a large one is looked up in several tasks.
    least = classes.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    spread = least.select("label", "class_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = classes.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, ["label", "salt"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def _links(chunked: Chunked, frequencies: DataFrame, pairs: DataFrame, buckets: int, similarity: float, block: int) -> DataFrame:
    """Verified links that connect whatever verified pairs connect among (leader, node) candidates."""
    blocks = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = written(pairs.join(blocks, "leader").withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "placed")
    groups = max(1, math.ceil(placed.count() / 1000))
    name = F.abs(F.xxhash64("leader", "part"))
    # The leader is in every block of its group, the others in one.
    leading = placed.where("leader = node").select("chunk", "node", "leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
    following = placed.where("leader <> node").select("chunk", "node", "leader", "part")
    first = leading.unionByName(following).select("chunk", "node", name.alias("block"), F.lit(-1).alias("part"), F.col("node").alias("label"))
    links = written(_verified(_sets(chunked, frequencies, first, buckets, groups), similarity), "links")
    # Blocks of one group whose nodes are not connected yet: each pair of blocks, across.
    split_ = placed.where("blocks > 1")
    if split_.isEmpty():
        return links
    labels = components(links)
    labelled = split_.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    loose = labelled.groupBy("leader").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("leader")
    rest = labelled.join(loose, "leader")
    partners = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    across = rest.select("chunk", "node", "leader", "label", "part", partners.alias("other")).where("part <> other")
    second = across.select("chunk", "node", F.abs(F.xxhash64("leader", F.least("part", "other"), F.greatest("part", "other"))).alias("block"), "part", "label")
    more = written(_verified(_sets(chunked, frequencies, second, buckets, groups), similarity), "links")
    return links.unionByName(more)
