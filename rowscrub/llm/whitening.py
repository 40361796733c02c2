"""Whitening of embeddings by a block Jacobi-Davidson method on a covariance that is never formed.

The vectors are written once as blocks of integers. A product of the covariance with a few columns is one pass over these blocks: every
task centres its vectors, multiplies them with the columns and back, and adds up one small matrix; where these are many, a shuffle
adds them up before the driver sees at most `PARTIALS` of them. On the driver lie only matrices of as many rows as a vector has entries.

All components wanted are improved side by side. Rayleigh-Ritz on the search space gives approximations; those whose
residual has reached double precision are locked; for each other one the correction equation, projected away from all approximations,
is solved by a few MINRES steps in lockstep, so that an inner step is one pass for all of them, and the search space grows by the solutions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscrub.llm.rounds import written

SCALE, SHIFT = 64, 1_000_000
MOST_COMPONENTS = 32
BLOCK_BYTES = 2 << 20
"""Bytes of a block of vectors."""
WIDEST = 1 << 40
"""Entries beyond this after scaling are an error: sums of a block would not be exact."""
PARTIALS = 32
"""Partial sums that the driver adds up after a shuffle has added up those of many tasks."""
DRIVER_BYTES = 64 << 20
"""Bytes of partial sums that the driver takes without that shuffle."""
TASK_BYTES = 32 << 20
INNER_STEPS = 6
OUTER_STEPS = 60
PRECISION = 4e-15
"""Residual, as a share of the largest eigenvalue and for each root of a dimension, at which a component counts as found."""

BLOCKS = "dim int, n long, low long, high long, sums array<long>, vec_ids array<long>, x binary"
BLOCKS_ARROW = pa.schema(
    [("dim", pa.int32()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("sums", pa.list_(pa.int64())), ("vec_ids", pa.list_(pa.int64())), ("x", pa.binary())]
)
WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
WHITE_ARROW = pa.schema(
    list(zip([c.split()[0] for c in WHITE.split(", ")], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True))
)


def blocks_of(embeddings: DataFrame) -> DataFrame:
    """The vectors without null or non-finite entries as blocks of scaled whole numbers, a block of one length each."""
    vector = F.col("embedding").cast("array<double>")
    chosen = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v"))
    # A null entry makes the comparison null; not a number counts as greater than all.
    sound = chosen.where(F.size("v") > 0).where(F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == dim))
                values = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                rows = max(1, BLOCK_BYTES // (8 * dim))
                for at in range(0, len(values), rows):
                    scaled = np.floor(SCALE * values[at : at + rows])
                    if np.abs(scaled).max() > WIDEST:
                        raise ValueError(f"an entry of a vector is beyond {WIDEST // SCALE}")
                    x = scaled.astype(np.int64) + SHIFT
                    ids = part.column("vec_id")[at : at + rows]
                    row = [dim, len(x), int(x.min()), int(x.max()), x.sum(axis=0).tolist(), ids.to_pylist(), x.astype("<i8").tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, BLOCKS_ARROW.types, strict=True)], schema=BLOCKS_ARROW)

    return sound.mapInArrow(pack, BLOCKS)


class Vectors(NamedTuple):
    """Blocks of vectors of one length, their number, their sums by dimension, and bounds of all entries."""

    blocks: DataFrame
    n: int
    sums: list[int]
    low: int
    high: int

    @property
    def dim(self) -> int:
        return len(self.sums)

    def centring(self) -> Callable[[bytes], tuple[np.ndarray, np.ndarray]]:
        """Of a block the whole numbers n * x - S, and x - S / n."""
        n, sums = self.n, self.sums
        exact = np.int64 if n * max(abs(self.low), abs(self.high), 1) < 1 << 62 else object
        totals = np.array(sums, exact)

        def centred(x: bytes) -> tuple[np.ndarray, np.ndarray]:
            values = np.frombuffer(x, "<i8").reshape(-1, len(sums)).astype(exact)
            whole = values * n - totals
            return whole, (whole / n).astype(np.float64)

        return centred

    def deviating(self) -> Callable[[np.ndarray], np.ndarray]:
        """Of the whole numbers n * x - S of a block the sums of squares by vector, exact."""
        fits = self.dim * (self.n * (self.high - self.low)) ** 2 < 1 << 63

        def deviation(whole: np.ndarray) -> np.ndarray:
            if fits:
                return (whole * whole).sum(axis=1).astype(np.int64)
            found = (whole.astype(object) ** 2).sum(axis=1)
            if max(found) >= 1 << 63:
                raise OverflowError("a deviation exceeds a long")
            return found.astype(np.int64)

        return deviation

    def total(self, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of what `work` makes of the centred vectors, over all blocks."""
        centred, shape = self.centring(), work(np.zeros((1, self.dim))).shape

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = None
            for batch in batches:
                for x in batch.column("x").to_pylist():
                    found = work(centred(x)[1])
                    sums = found if sums is None else sums + found
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sums.tobytes()])], names=["part", "sums"])

        def merge(table: pa.Table) -> pa.Table:
            table = table.sort_by("part")
            sums = np.sum([np.frombuffer(s) for s in table.column("sums").to_pylist()], axis=0)
            return pa.table({"part": table.column("part")[:1], "sums": pa.array([sums.tobytes()])})

        partial = self.blocks.select("x").mapInArrow(add_up, "part int, sums binary")
        tasks = max(self.blocks.sparkSession.sparkContext.defaultParallelism, self.n * self.dim * 8 // TASK_BYTES)
        if tasks * shape[0] * shape[-1] * 8 > DRIVER_BYTES:
            partial = partial.groupBy(F.col("part") % PARTIALS).applyInArrow(merge, "part int, sums binary")
        rows = sorted(partial.collect())
        return np.sum([np.frombuffer(r["sums"]) for r in rows], axis=0).reshape(shape)

    def product(self, columns: np.ndarray) -> np.ndarray:
        """The covariance times some columns: one pass over all vectors."""
        return self.total(lambda c: c.T @ (c @ columns)) / self.n


def vectors_of(embeddings: DataFrame) -> Vectors | None:
    """The vectors of the most frequent length, the longer of equally frequent ones; None if there are none."""
    packed = written(blocks_of(embeddings), "vectors")
    lengths = packed.groupBy("dim").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    most = lengths.orderBy(F.desc("n"), F.desc("dim")).head()
    if most is None:
        return None
    blocks = packed.where(F.col("dim") == most["dim"])
    entries = blocks.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = [int(r["s"]) for r in entries.orderBy("at").collect()]  # one number for each dimension
    return Vectors(blocks, most["n"], sums, most["low"], most["high"])


Product = Callable[[np.ndarray], np.ndarray]


def orthonormal(columns: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns add to orthonormal ones; columns that add nothing go."""
    found: list[np.ndarray] = []
    for column in columns.T:
        size = np.linalg.norm(column)
        if not size > 0:
            continue
        column = column / size
        for _ in range(3):
            for basis in against:
                column = column - basis @ (basis.T @ column)
            for other in found:
                column = column - other * (other @ column)
            left = np.linalg.norm(column)
            if left < 1e-10:
                break
            column = column / left
        else:
            found.append(column)
    return np.array(found).T if found else np.zeros((len(columns), 0))


def minres(apply: Product, right: np.ndarray, steps: int, enough: float) -> np.ndarray:
    """Approximate solutions of one symmetric system for each column, in lockstep: a step is one product for all columns."""
    solution, size = np.zeros_like(right), np.linalg.norm(right, axis=0)
    old, now = np.zeros_like(right), right / np.where(size > 0, size, 1)
    beta = np.zeros(right.shape[1])
    # Two earlier rotations, the right side left to reduce, and two earlier directions.
    c1, s1, c2, s2 = np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta)
    left = size.copy()
    before, last = np.zeros_like(right), np.zeros_like(right)
    for _ in range(steps):
        if (np.abs(left) <= enough * size).all():
            break
        image = apply(now)
        alpha = (now * image).sum(axis=0)
        image = image - alpha * now - beta * old
        following = np.linalg.norm(image, axis=0)
        # The new column of the tridiagonal matrix, rotated twice, then by a rotation of its own.
        far, near = s1 * beta, c1 * beta
        near, diagonal = c2 * near + s2 * alpha, c2 * alpha - s2 * near
        length = np.hypot(diagonal, following)
        safe = np.where(length > 0, length, 1)
        c, s = diagonal / safe, following / safe
        direction = np.where(length > 0, (now - far * before - near * last) / safe, 0)
        solution = solution + c * left * direction
        left = -s * left
        before, last = last, direction
        c1, s1, c2, s2 = c2, s2, c, s
        old, now = now, np.where(following > 1e-300, image / np.where(following > 0, following, 1), 0)
        beta = following
    return solution


def jacobi_davidson(product: Product, dim: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    space = orthonormal(np.random.default_rng(0).standard_normal((dim, wanted)))
    images, locked, most = product(space), np.zeros((dim, 0)), min(dim, 3 * wanted)
    largest = 0.0
    for _ in range(OUTER_STEPS):
        small = space.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        space, images, largest = space @ turn, images @ turn, max(largest, abs(values[0]))
        left = wanted - locked.shape[1]
        residual = images[:, :left] - space[:, :left] * values[:left]
        residual -= locked @ (locked.T @ residual)
        done = np.linalg.norm(residual, axis=0) <= PRECISION * np.sqrt(dim) * largest
        # Locked in falling order only, so that none is passed over.
        first = int(np.argmin(done)) if not done.all() else left
        locked, space, images = np.hstack((locked, space[:, :first])), space[:, first:], images[:, first:]
        if first == left:
            break
        open_ = ~done[first:]
        shifts = values[first:left][open_]
        near = np.hstack((locked, space[:, : left - first]))

        def away(columns: np.ndarray, near: np.ndarray = near) -> np.ndarray:
            return columns - near @ (near.T @ columns)

        def corrected(columns: np.ndarray, away: Product = away, shifts: np.ndarray = shifts) -> np.ndarray:
            inside = away(columns)
            return away(product(inside) - inside * shifts)

        grown = orthonormal(minres(corrected, -away(residual[:, first:][:, open_]), INNER_STEPS, 0.01), locked, space)
        if not grown.shape[1]:
            # Nothing new: the space holds what there is, or chance has to open it.
            grown = orthonormal(np.random.default_rng(1).standard_normal((dim, 1)), locked, space)
            if not grown.shape[1]:
                locked = np.hstack((locked, space[:, : left - first]))
                break
        if space.shape[1] + grown.shape[1] > most - locked.shape[1]:
            keep = max(most - locked.shape[1] - grown.shape[1], left - first)
            space, images = space[:, :keep], images[:, :keep]
        space, images = np.hstack((space, grown)), np.hstack((images, product(grown)))
    else:
        locked = np.hstack((locked, space[:, : wanted - locked.shape[1]]))
    # Once more over the whole, from fresh products.
    locked = np.linalg.qr(locked)[0]
    small = locked.T @ product(locked)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], locked @ turn[:, ::-1]


def whitened_embeddings(embeddings: DataFrame, components: int = MOST_COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every vector and component.

    Vectors that are null, empty or hold a null or non-finite entry are left out. The others are judged by the vectors of the most
    frequent length (the longer of equally frequent ones); those of other lengths have no place there and give no rows. Entries
    become floor(64 * entry) + 1000000; one beyond 2 ** 34 is an error, as is a deviation that exceeds a long. Components are
    numbered from 1 by falling eigenvalue, and the largest entry of each unit vector is positive. Components whose
    eigenvalue is zero to double precision cannot be scaled and are left out: no rows from equal vectors, from a single one or from
    an empty table. Null and repeated ids and repeated rows give rows like any other; other columns are not carried.
    """
    spark = embeddings.sparkSession
    vectors = vectors_of(embeddings)
    if vectors is None or vectors.low == vectors.high:
        return spark.createDataFrame([], WHITE)
    trace = float(vectors.total(lambda c: np.array([(c * c).sum()]))[0]) / vectors.n
    values, units = jacobi_davidson(vectors.product, vectors.dim, min(components, vectors.dim))
    sound = values > vectors.dim * np.finfo(float).eps * max(values[0], 0)
    values, units = values[sound], units[:, sound]
    if not len(values):
        return spark.createDataFrame([], WHITE)
    heavy = units[np.abs(units).argmax(axis=0), np.arange(len(values))]
    weights = units * np.sign(heavy) / np.sqrt(values)

    def moments(c: np.ndarray) -> np.ndarray:
        white = c @ weights
        return np.vstack((white.T @ white, white.sum(axis=0)))

    sums = vectors.total(moments) / vectors.n
    error = float(np.abs(sums[:-1] - np.outer(sums[-1], sums[-1]) - np.eye(len(values))).max())
    centred, deviating, n, share = vectors.centring(), vectors.deviating(), vectors.n, values / trace

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = weights.shape[1]
        for batch in batches:
            for ids, x in zip(batch.column("vec_ids"), batch.column("x").to_pylist(), strict=True):
                whole, c = centred(x)
                rows = len(c)
                columns = [
                    ids.values.take(pa.array(np.repeat(np.arange(rows), wide))),
                    pa.array(np.tile(np.arange(1, wide + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * wide, n)),
                    pa.array(np.repeat(deviating(whole), wide)),
                    pa.array((c @ weights).ravel()),
                    pa.array(np.tile(share, rows)),
                    pa.array(np.full(rows * wide, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=WHITE_ARROW)

    return vectors.blocks.select("vec_ids", "x").mapInArrow(whiten, WHITE)
