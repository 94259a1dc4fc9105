"""Embedding whitening by block Golub-Kahan-Lanczos bidiagonalisation.

The rows are integer vectors x; the fit list has each distinct one once, and is
centred as (n x - S) / n, whose numerator is exact. With Xc the centred list, the
bidiagonalisation alternates two distributed products::

    U_j B_jj     = Xc V_j  - U_{j-1} B_{j-1,j}     right block to left block
    V_{j+1} B_j,j+1' = Xc' U_j - V_j B_jj'             left block to right block

``BLOCK`` vectors go at a time, so a pass over the data serves as many (with a
block of one this is the classical form, one pass per product). Each block is
reorthogonalised against all blocks before it, twice. Right blocks have one entry
per dimension and are kept by the driver. Left blocks have one entry per vector
of the list and are never written: U_j = Xc C_j with a small C_j, so a task
recomputes its rows of all left blocks from its rows of Xc, and their products
come back as sums. The small block bidiagonal matrix B has the singular values
of Xc; its SVD gives deviations and, with V, components. The process ends when
the residuals of all wanted components are below ``TOLERANCE``, or the space is
used up; a block that loses rank is filled up with new directions.

What a task gives back is a few matrices of dimension x block; they are added up
in groups of tasks first, so the driver gets some square root of their number.

Edge cases: rows are left out whose vector is null, empty or holds a null or a
number that is not finite, and, where lengths differ, those that have not the
most frequent length (of equally frequent ones the longest); a null id stays; no
fit row or equal rows only give no component, as does any direction without
deviation (below ``RANK`` of the largest), so small or flat tables have fewer
components and rows of none are not in the result; an entry beyond 2^62 in
absolute value, once scaled, counts as 2^62; equal eigenvalues share a
space whose basis is arbitrary, the same for all rows; an exact sum that exceeds
a long is null. Other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.spans import freed
from tessera.session import bound_batches, materialize, scratch

#: Vectors of a block; components wanted; rows that are packed into one cell.
BLOCK, WANTED, PACK = 16, 16, 4096
#: Residual of a component, and the least deviation, each relative to the largest.
TOLERANCE, RANK = 1e-13, 1e-9
SCALE, OFFSET = 64, 1_000_000


def integers(rows: DataFrame) -> DataFrame:
    """vec_id and x, the entries as integers; rows that can't be used are left out (see the module)."""
    entries = F.col("embedding").cast("array<double>")
    unusable = F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(math.inf)))
    usable = rows.select("vec_id", entries.alias("e")).filter("e IS NOT NULL AND size(e) > 0").filter(~unusable)
    lengths = usable.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    most = F.lit(2.0**62)
    whole = F.transform("e", lambda v: F.floor(F.greatest(F.least(v * SCALE, most), -most)) + OFFSET)
    return usable.filter(F.size("e") == (lengths["d"] if lengths else 0)).select("vec_id", whole.alias("x"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors to cells of up to ``PACK`` of them."""
    for batch in batches:
        for i in range(0, batch.num_rows, PACK):
            part = batch.slice(i, PACK)
            x = part["x"].flatten().to_numpy().astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["rows", "cell"])


@dataclass(frozen=True)
class FitList:
    """The distinct vectors in cells; their number and exact sums."""

    cells: DataFrame
    n: int
    sums: tuple[int, ...]

    @property
    def parts(self) -> int:
        return max(1, self.cells.rdd.getNumPartitions())


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n x - S, exact: in 64 bits where that is enough, else as integers of any size."""
    most = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)
    return x * n - np.array(sums, dtype=np.int64) if most < 2**63 else x.astype(object) * n - np.array(sums, dtype=object)


def fit_list(vectors: DataFrame) -> FitList:
    """Each distinct x once, packed and written."""
    distinct = vectors.select("x").distinct()
    cells = materialize(distinct.mapInArrow(lambda it: freed(_packed(it)), "rows int, cell binary"), "whiten-cells")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, cell in zip(batch["rows"].to_pylist(), batch["cell"].to_pylist(), strict=True):
                x = np.frombuffer(cell, dtype="<i8").reshape(rows, -1)
                # Exact in any case: halves of 32 bits, each sum of which stays far within 64.
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                dims = np.arange(x.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(high), pa.array(low), pa.array([rows] * len(dims), pa.int64())], names=["dim", "high", "low", "rows"])

    whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    sums = cells.mapInArrow(summed, "dim int, high long, low long, rows long").groupBy("dim").agg(*whole, F.sum("rows").alias("rows")).orderBy("dim").collect()
    return FitList(cells, sums[0]["rows"] if sums else 0, tuple((int(r["high"]) << 32) + int(r["low"]) for r in sums))


def _added(fit: FitList, made: Callable[[np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
    """Sums over the fit list of the matrices that ``made`` gives for some centred rows; one distributed pass."""
    n, sums, groups = fit.n, fit.sums, math.isqrt(fit.parts - 1) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shapes = None, None
        for batch in batches:
            for rows, cell in zip(batch["rows"].to_pylist(), batch["cell"].to_pylist(), strict=True):
                x = _centred(np.frombuffer(cell, dtype="<i8").reshape(rows, -1), n, sums).astype(np.float64) / n
                matrices = made(x)
                shapes = [m.shape for m in matrices]
                flat = np.concatenate([m.ravel() for m in matrices])
                total = flat if total is None else total + flat
        if total is not None:
            at = TaskContext.get().partitionId()
            shape = pa.array([[k for s in shapes for k in s]], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([at % groups], pa.int32()), pa.array([at], pa.int32()), shape, pa.array([total.tobytes()], pa.binary())], names=["grp", "at", "shape", "total"])

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shape = None, None
        for batch in batches:
            for s, cell in zip(batch["shape"].to_pylist(), batch["total"].to_pylist(), strict=True):
                flat, shape = np.frombuffer(cell), s
                total = flat if total is None else total + flat
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([shape], pa.list_(pa.int32())), pa.array([total.tobytes()], pa.binary())], names=["at", "shape", "total"])

    parts = fit.cells.mapInArrow(partial, "grp int, at int, shape array<int>, total binary")
    groups_of = parts.repartition(groups, "grp").sortWithinPartitions("grp", "at").mapInArrow(combined, "at int, shape array<int>, total binary")
    found = sorted(groups_of.collect(), key=lambda r: r["at"])
    if not found:
        return []
    total, out = np.sum([np.frombuffer(r["total"]) for r in found], axis=0), []
    for a, b in zip(found[0]["shape"][::2], found[0]["shape"][1::2], strict=True):
        out.append(total[: a * b].reshape(a, b))
        total = total[a * b :]
    return out


def _filled(block: np.ndarray, before: np.ndarray, rng: np.random.Generator, size: float) -> tuple[np.ndarray, np.ndarray]:
    """Block = Q R with Q orthonormal and orthogonal to ``before``; directions that vanish are new ones with zeros in R."""
    for _ in range(2):
        block = block - before @ (before.T @ block)
    q, r = np.linalg.qr(block)
    gone = np.abs(np.diag(r)) <= 1e-12 * size
    room = block.shape[0] - before.shape[1]
    r[gone, :] = 0.0
    keep = q[:, ~gone]
    while keep.shape[1] < min(q.shape[1], room):
        new = rng.standard_normal((block.shape[0], 1))
        for _ in range(3):
            new = new - before @ (before.T @ new)
            new = new - keep @ (keep.T @ new)
        keep = np.hstack([keep, new / np.linalg.norm(new)])
    order = np.concatenate([np.flatnonzero(~gone), np.flatnonzero(gone)])
    return keep, r[order][: keep.shape[1]]


def _left(fit: FitList, c: np.ndarray, done: np.ndarray, done_products: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """C with U = Xc C orthonormal and orthogonal to all left blocks before, Xc' U, and R of Xc c = U R + (earlier blocks).

    ``done`` are the C of earlier blocks, ``done_products`` their Xc' U. Each
    round is one pass; the second removes what rounding left of the first.
    Directions without length are left out.
    """
    whole = np.eye(c.shape[1])
    for _ in range(3):
        products = _added(fit, lambda x, c=c: [(x @ done).T @ (u := x @ c), u.T @ u, x.T @ u])
        along, gram, down = products
        c, down = c - done @ along, down - done_products @ along
        gram = gram - along.T @ along
        w, e = np.linalg.eigh((gram + gram.T) / 2)
        live = w > max(1e-26, w.max(initial=0) * 1e-24)
        root = e[:, live] * np.sqrt(w[live])  # u = Q root'
        back = e[:, live] / np.sqrt(w[live])
        c, down, whole = c @ back, down @ back, root.T @ whole
        if np.abs(gram - np.eye(len(gram))).max(initial=0) < 1e-14 * len(gram) and np.abs(along).max(initial=0) < 1e-14:
            break
    return c, down, whole


@dataclass(frozen=True)
class Whitening:
    """Components (a column each), their deviations (square roots of eigenvalues) and the trace of the covariance."""

    components: np.ndarray
    deviations: np.ndarray
    trace: float


def bidiagonalise(fit: FitList, wanted: int = WANTED, block: int = BLOCK) -> Whitening:
    """The first components of the fit list's covariance by block Golub-Kahan-Lanczos steps."""
    d = len(fit.sums)
    if not fit.n:
        return Whitening(np.zeros((d, 0)), np.zeros(0), 0.0)
    trace = float(_added(fit, lambda x: [np.array([[(x * x).sum()]])])[0][0, 0]) / fit.n
    size = math.sqrt(trace * fit.n)
    if size == 0:
        return Whitening(np.zeros((d, 0)), np.zeros(0), 0.0)
    rng = np.random.default_rng(0)
    v, v_now = np.zeros((d, 0)), np.linalg.qr(rng.standard_normal((d, min(block, d))))[0]
    c, down = np.zeros((d, 0)), np.zeros((d, 0))
    b = np.zeros((0, 0))
    while True:
        # Xc V_j: its part along earlier left blocks is B's block above the diagonal, the rest its diagonal block.
        c_now, down_now, diagonal = _left(fit, v_now, c, down)
        above = down.T @ v_now
        b = np.block([[b, above], [np.zeros((diagonal.shape[0], b.shape[1])), diagonal]])
        v, c, down = np.hstack([v, v_now]), np.hstack([c, c_now]), np.hstack([down, down_now])
        left, sigma, right = np.linalg.svd(b, full_matrices=False)
        if v.shape[1] >= d:
            break
        # Xc' U_j less what lies in the right blocks so far is the next right block.
        v_next, beta = _filled(down_now, v, rng, size) if down_now.shape[1] else (np.zeros((d, 0)), np.zeros((0, 0)))
        residual = np.linalg.norm(beta @ left[-c_now.shape[1] :, :wanted], axis=0) if c_now.shape[1] else np.zeros(1)
        if len(sigma) >= wanted and residual.max(initial=0) <= TOLERANCE * sigma[0]:
            break
        if not v_next.shape[1]:
            v_next, _ = _filled(rng.standard_normal((d, min(block, d - v.shape[1]))), v, rng, 1.0)
        v_now = v_next
    components, deviations = v @ right.T, sigma / math.sqrt(fit.n)
    real = deviations > RANK * deviations[0]
    return Whitening(components[:, real][:, :wanted], deviations[real][:wanted], trace)


def whiten(rows: DataFrame, wanted: int = WANTED, block: int = BLOCK) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable row and component."""
    bound_batches(rows.sparkSession)
    with scratch(rows.sparkSession) as result:
        vectors = result(integers(rows), "whiten-vectors")
        fit = fit_list(vectors)
        found = bidiagonalise(fit, wanted, block)
        k, n, sums = len(found.deviations), fit.n, fit.sums
        scaled = found.components / found.deviations
        covariance = _added(fit, lambda x: [(w := x @ scaled).T @ w])[0] / n if k else np.zeros((0, 0))
    error = float(np.abs(covariance - np.eye(k)).max(initial=0.0))
    explained = found.deviations**2 / found.trace if k else np.zeros(0)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows if k else 0, PACK):
                part = batch.slice(i, PACK)
                m = part.num_rows
                exact = _centred(part["x"].flatten().to_numpy().reshape(m, -1), n, sums)
                if exact.dtype == object or int(np.abs(exact).max()) ** 2 * exact.shape[1] >= 2**63:
                    squares = [sum(int(v) ** 2 for v in row) for row in exact]
                    squares = [s if s < 2**63 else None for s in squares]
                else:
                    squares = (exact * exact).sum(axis=1).tolist()
                white = (exact.astype(np.float64) / n) @ scaled
                columns = [
                    part["vec_id"].take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, n), pa.int64()),
                    pa.array([s for s in squares for _ in range(k)], pa.int64()),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return vectors.mapInArrow(lambda it: freed(each(it)), schema)
