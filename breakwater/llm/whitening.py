"""Whitening of embeddings by block Lanczos: the covariance is never formed, only multiplied, by passes over all vectors.

A pass multiplies the centred rows by a block of a few columns and back, task by task; tasks' partial products are summed by ``GROUPS``
tasks more, and the driver gets a sum of a block's size from each. The basis is orthogonalised in full twice. A block
that brings nothing new is replaced by a random one outside the basis, and a full basis by its leading Ritz vectors. Vectors count as
converged when the residual of each is below ``TOL`` of the largest eigenvalue, or when the basis spans the whole space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakwater.llm.textvec import utf8
from breakwater.plans.lineage import cut

COMPONENTS = 8
#: Extra columns of a block, which speed up the last of the wanted ones.
EXTRA = 4
GROUPS = 16
TOL = 1e-12
#: Most blocks in the basis before it is replaced by its leading Ritz vectors, and most passes.
BASIS, PASSES = 24, 400
_MOST = 1 << 62


def grid(values: np.ndarray) -> np.ndarray:
    """Entries as whole numbers, floor(1024 c) + 100000, held within 62 bits."""
    at = np.floor(1024.0 * values)
    small = np.abs(at) < 2.0**61
    out = np.where(small, at, 0).astype(np.int64) + 100000
    return out if small.all() else np.where(small, out, np.where(at > 0, _MOST, -_MOST))


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return utf8(batch.column("x"))[0].view(np.int64).reshape(-1, width)


def clean_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, d, x`` of the rows whose vector is there and holds finite numbers only; ``x`` has the ``d`` whole numbers as bytes."""
    source = table.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    source = source.where("v IS NOT NULL AND size(v) > 0 AND NOT exists(v, c -> c IS NULL OR isnan(c) OR abs(c) = double('infinity'))")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            flat, at = grid(v.flatten().to_numpy(zero_copy_only=False)), np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy())])
            x = [flat[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(at[1:] - at[:-1], pa.int64()), pa.array(x, pa.binary())], ["vec_id", "d", "x"])

    kind = dict(source.dtypes)["vec_id"]
    return source.mapInArrow(run, f"vec_id {kind}, d long, x binary")


class Centred:
    """All vectors of one width with their number and sums, and passes over them."""

    def __init__(self, rows: DataFrame, width: int):
        self.rows, self.width, self.n = rows, width, 0
        self.sums = [0] * width
        for n, sums in self._sums():
            self.n += n
            self.sums = [a + int(b) for a, b in zip(self.sums, sums, strict=True)]

    def _sums(self) -> Iterator[tuple[int, list[str]]]:
        width = self.width

        def counted(pairs: Iterator[tuple[int, list]]) -> Iterator[pa.RecordBatch]:
            n, total = 0, [0] * width
            for k, one in pairs:
                n, total = n + k, [a + int(c) for a, c in zip(total, one, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([list(map(str, total))], pa.list_(pa.string()))], ["n", "s"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def pairs():
                for x in (_vectors(b, width) for b in batches):
                    small = int(np.abs(x).max(initial=0)) * max(1, len(x)) < _MOST
                    yield len(x), (x if small else x.astype(object)).sum(0)

            return counted(pairs())

        def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return counted((r["n"], r["s"]) for b in batches for r in b.to_pylist())

        kind = "n long, s array<string>"
        for r in self.rows.select("x").mapInArrow(run, kind).repartition(GROUPS).mapInArrow(both, kind).toLocalIterator():
            yield r.n, r.s

    def centre(self) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray | list]]:
        """Of whole numbers x: x - S/n, from the exact n x - S, and n x - S itself."""
        n, sums = self.n, self.sums
        mean = max((abs(s) for s in sums), default=0)

        def of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if int(np.abs(x).max(initial=0)) * n + mean < _MOST:
                off = n * x - np.array(sums, np.int64)
            else:
                off = n * x.astype(object) - np.array(sums, object)
            return (off / n).astype(np.float64), off

        return of

    def total(self, part: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum over all rows of ``part`` of (x - S/n, n x - S) of a batch; ``size`` numbers."""
        width, centre = self.width, self.centre()

        def added(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size)
            for x in parts:
                out += x.ravel()
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return added(part(*centre(_vectors(b, width))) for b in batches)

        def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return added(np.frombuffer(v) for b in batches for v in b.column(0).to_pylist())

        found = self.rows.select("x").mapInArrow(run, "sums binary").repartition(GROUPS).mapInArrow(both, "sums binary")
        return np.sum([np.frombuffer(bytes(r.sums)) for r in found.toLocalIterator()] or [np.zeros(size)], 0)

    def multiply(self, block: np.ndarray) -> np.ndarray:
        """The covariance (divisor n) times ``block``, by one pass."""
        return self.total(lambda y, _: y.T @ (y @ block), block.size).reshape(block.shape) / self.n


def orthonormal(block: np.ndarray, basis: np.ndarray, least: float, random: np.random.Generator) -> np.ndarray:
    """Columns that span what ``block`` adds to ``basis``; those that add less than ``least`` are drawn anew outside of it."""
    out = np.zeros((len(block), 0))
    for column in block.T[: len(block) - basis.shape[1]]:
        floor = least
        while True:
            known, size = np.hstack([basis, out]), np.linalg.norm(column)
            for _ in range(2):
                column = column - known @ (known.T @ column)
            left = np.linalg.norm(column)
            if left > floor and left > 1e-10 * size:
                break
            column, floor = random.standard_normal(len(block)), 0.0
        column = column / left
        column = column - known @ (known.T @ column)
        out = np.hstack([out, (column / np.linalg.norm(column))[:, None]])
    return out


def lanczos(multiply: Callable[[np.ndarray], np.ndarray], width: int, count: int, tol: float = TOL, basis: int = BASIS, extra: int = EXTRA, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit vectors as columns, of a symmetric non-negative ``multiply``.

    Raises ``RuntimeError`` if the residuals do not pass ``tol`` (or stay within rounding) in ``PASSES`` passes.
    """
    random, count = np.random.default_rng(seed), min(count, width)
    size = min(width, count + extra)
    block = orthonormal(random.standard_normal((width, size)), np.zeros((width, 0)), 0.0, random)
    q, aq = np.zeros((width, 0)), np.zeros((width, 0))
    for _ in range(PASSES):
        q, aq = np.hstack([q, block]), np.hstack([aq, multiply(block)])
        small = q.T @ aq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz = q @ turn
        residual = aq @ turn - ritz * values
        top = max(values[0], np.finfo(float).tiny)
        if q.shape[1] == width or np.linalg.norm(residual[:, :count], axis=0).max() <= tol * top:
            return values[:count], ritz[:, :count]
        if q.shape[1] + size > basis * size:
            kept = 2 * size
            q, aq, residual = ritz[:, :kept], aq @ turn[:, :kept], residual[:, :kept]
        block = orthonormal(residual[:, :size], q, tol * top / 10, random)
    raise RuntimeError(f"no convergence in {PASSES} passes")


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Each vector's whitened coordinates on the leading ``components`` eigenvectors of the covariance of its whole-number form.

    Rows whose vector is null or empty, or holds null or non-finite entries, are left out. Returns for each other row and component
    ``vec_id, component`` (from 1, by falling eigenvalue), ``n``, ``deviation`` (null where it passes 63 bits), ``whitened, explained`` and
    ``identity_error`` (the largest entry of the whitened vectors' covariance minus the identity). There are as many components as
    dimensions where those are fewer. Components without variance (an eigenvalue under 1e-12 of the largest) cannot be whitened
    and are left out, so vectors that are all equal give no rows; nor does an empty table. Repeated rows and ids count as often as
    they come; ids may be null. Where vectors differ in length, those of the most frequent length (the longest of several) are taken.
    """
    rows = cut(clean_vectors(table, id_col, vector_col))
    empty = f"vec_id {dict(rows.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    width = rows.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    if width is None:
        return table.sparkSession.createDataFrame([], empty)
    data = Centred(rows.where(F.col("d") == width.d), width.d)
    n = data.n
    values, vectors = lanczos(data.multiply, data.width, components)
    values, vectors = values[good := values > 1e-12 * max(values[0], 0)], vectors[:, good]
    k = len(values)
    if not k:
        return table.sparkSession.createDataFrame([], empty)
    turn = vectors / np.sqrt(values)
    moments = data.total(lambda y, _: np.concatenate([(y @ turn).sum(0), ((y @ turn).T @ (y @ turn)).ravel(), [(y * y).sum()]]), k + k * k + 1) / n
    trace = moments[-1]  # the mean square of all deviations
    error = float(np.abs(moments[k:-1].reshape(k, k) - np.outer(moments[:k], moments[:k]) - np.eye(k)).max())
    explained, centre, wide = values / trace, data.centre(), data.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, off = centre(_vectors(b, wide))
            most = int(np.abs(off).max(initial=0))
            exact = (off * off).sum(1) if most * most * wide < _MOST else (off.astype(object) ** 2).sum(1)
            deviation = pa.array([v if (v := int(e)) < 1 << 63 else None for e in exact], pa.int64())
            at = np.repeat(np.arange(len(b)), k)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(b))), pa.array(np.full(len(at), n)), deviation.take(pa.array(at)), pa.array((y @ turn).ravel()), pa.array(np.tile(explained, len(b))), pa.array(np.full(len(at), error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return data.rows.select("vec_id", "x").mapInArrow(run, empty)
