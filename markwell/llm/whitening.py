"""Whitening of vectors: principal axes by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

The matrix X has one centred row per vector. A step takes a unit vector v of the row space to u = X v and back to X'u, each made
orthogonal to all earlier ones of its kind. The left vectors have as many entries as there are rows, so none is kept: each is a
known combination of the columns of X (``u_j = X w_j``), and a task forms its part of all of them from its own rows again. So one
pass over the rows gives both products of a step and the inner products that reorthogonalise u, whatever number of rows there is;
only vectors as long as a row reach the driver. The small bidiagonal matrix yields components and deviations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwell.llm.common import stash

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
BLOCK_ROWS = 2048

# Integers up to here are exact in doubles; larger entries are taken as this, with their sign.
LARGEST = float(1 << 53)
LOW_BITS = 26

# A direction whose share of the total variance is smaller is no component: nothing varies there.
LEAST_SHARE = 1e-13
# A new vector this much shorter than the rows' scale lies in the span of the earlier ones.
BREAKDOWN = 1e-13


@dataclass
class Sums:
    """What one pass over the rows tells: their number, length, and per dimension the exact sum of ``x - SHIFT``."""

    n: int
    dims: int
    totals: list[int]
    largest: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([t / self.n for t in self.totals])


@dataclass
class Axes:
    """Components as rows, with the variance along each, and the variance of all dimensions together."""

    components: np.ndarray
    variances: np.ndarray
    trace: float


def usual_length(vectors: DataFrame, vector: str = "embedding") -> int:
    """The most frequent length of the usable vectors, the longer of equally frequent ones; 0 without any."""
    sized = vectors.select(F.size(F.col(f"`{vector}`")).alias("d")).filter("d > 0")
    row = sized.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    return row["d"] if row else 0


def pack_rows(vectors: DataFrame, dims: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Blocks ``(ids, rows)`` of usable vectors: each entry c as the integer ``floor(SCALE * c)``, that is x less ``SHIFT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(start, BLOCK_ROWS)
                lists = batch.column("vector")
                fits = pc.fill_null(pc.equal(pc.list_value_length(lists), dims), False)
                lists, ids = lists.filter(fits), batch.column("key").filter(fits)
                values = lists.flatten()
                entries = np.asarray(values.fill_null(np.nan).to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(lists), dims)
                usable = np.isfinite(entries).all(axis=1)
                if usable.any():
                    with np.errstate(over="ignore"):
                        scaled = np.clip(np.floor(SCALE * entries[usable]), -LARGEST, LARGEST)
                    yield pa.record_batch(
                        [
                            pa.array([ids.filter(pa.array(usable)).to_pylist()], pa.list_(pa.int64())),
                            pa.array([scaled.astype(np.int64).tobytes()], pa.binary()),
                        ],
                        names=["ids", "rows"],
                    )

    source = vectors.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    return source.mapInArrow(run, "ids array<long>, rows binary")


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for ids, rows in zip(batch.column("ids"), batch.column("rows"), strict=True):
            yield ids.values, np.frombuffer(rows.as_py(), np.int64).reshape(-1, dims)


def _totals(blocks: DataFrame, measure, size: int, kind: str) -> list:
    """Sum of ``measure``'s arrays over all partitions, entry by entry: added up per task, then by a shuffle of ``size`` keys."""

    def run(batches):
        total = measure(batches)
        yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.int64() if kind == "long" else pa.float64()))], names=["sums"])

    parts = blocks.mapInArrow(run, f"sums array<{kind}>").select(F.posexplode("sums").alias("at", "x"))
    sums = parts.groupBy("at").agg(F.sum("x").alias("x")).collect()  # one row per entry: ``size`` rows
    found = {r["at"]: r["x"] for r in sums}
    return [found.get(i, 0) for i in range(size)]


def count_rows(blocks: DataFrame, dims: int) -> Sums:
    """Exact sums: each integer is added in two parts, so no sum can overflow."""

    def measure(batches):
        total = np.zeros(2 * dims + 1, dtype=np.int64)
        for _, rows in _blocks(batches, dims):
            total[0] += len(rows)
            total[1 : dims + 1] += (rows >> LOW_BITS).sum(axis=0)
            total[dims + 1 :] += (rows & ((1 << LOW_BITS) - 1)).sum(axis=0)
        return total

    sums = _totals(blocks, measure, 2 * dims + 1, "long")
    totals = [(hi << LOW_BITS) + lo for hi, lo in zip(sums[1 : dims + 1], sums[dims + 1 :], strict=True)]

    def widest(batches):
        most = max((int(np.abs(rows).max()) for _, rows in _blocks(batches, dims) if rows.size), default=0)
        yield pa.record_batch([pa.array([most], pa.int64())], names=["most"])

    largest = blocks.mapInArrow(widest, "most long").agg(F.max("most")).first()[0] if sums[0] else 0
    return Sums(sums[0], dims, totals, float(largest or 0))


def _products(blocks: DataFrame, sums: Sums, v: np.ndarray, earlier: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """For r = X v: its squared length, its inner products with the earlier left vectors ``X earlier``, and X'r."""
    dims, mean = sums.dims, sums.mean

    def measure(batches):
        total = np.zeros(1 + earlier.shape[1] + dims)
        for _, rows in _blocks(batches, dims):
            centred = rows - mean
            r = centred @ v
            total[0] += r @ r
            total[1 : 1 + earlier.shape[1]] += (centred @ earlier).T @ r
            total[1 + earlier.shape[1] :] += centred.T @ r
        return total

    out = np.array(_totals(blocks, measure, 1 + earlier.shape[1] + dims, "double"), dtype=np.float64)
    return out[0], out[1 : 1 + earlier.shape[1]], out[1 + earlier.shape[1] :]


def _fresh_direction(rng: np.random.Generator, found: np.ndarray) -> np.ndarray | None:
    """A unit vector orthogonal to the columns of ``found``, or None if they span everything."""
    dims, taken = found.shape
    if taken >= dims:
        return None
    return _orthogonal(rng.normal(size=dims), found, 0.0)[0]


def _orthogonal(x: np.ndarray, found: np.ndarray, floor: float) -> tuple[np.ndarray | None, float]:
    """``x`` made orthogonal to the columns of ``found`` (twice, which is enough) and of length 1, and its length before that."""
    for _ in range(2):
        x = x - found @ (found.T @ x)
    length = float(np.linalg.norm(x))
    return (x / length if length > floor else None), length


def bidiagonalise(blocks: DataFrame, sums: Sums, steps: int | None = None, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Right vectors V (as columns) and the upper bidiagonal B with X V = U B, both reorthogonalised in full.

    ``steps``: number of steps, by default one per dimension, so that eigenvalues that lie close together or repeat are all
    found; fewer steps give the outer ones only. Where a vector vanishes (the rows span less, or eigenvalues repeat), the walk
    goes on from a fresh direction, and B holds a zero there. One pass over the rows per step.
    """
    dims = sums.dims
    steps = min(steps or dims, dims)
    rng = np.random.default_rng(seed)
    right, back = np.zeros((dims, 0)), np.zeros((dims, 0))  # v_j, and X'u_j
    combos = np.zeros((dims, 0))  # w_j with u_j = X w_j
    b = np.zeros((steps, steps))
    v, beta, scale = _fresh_direction(rng, right), 0.0, 0.0
    for j in range(steps):
        right = np.column_stack((right, v))
        square, inner, image = _products(blocks, sums, v, combos)
        # u_j = X v_j less its share of all earlier left vectors; the last of these shares is beta, others are rounding
        length = float(np.sqrt(max(square - inner @ inner, 0.0)))
        scale = max(scale, float(np.sqrt(square)))
        if j and beta:
            b[j - 1, j] = beta
        if length > BREAKDOWN * scale * np.sqrt(dims) and scale > 0:
            b[j, j] = length
            combos = np.column_stack((combos, (v - combos @ inner) / length))
            back = np.column_stack((back, (image - back @ inner) / length))
            v, beta = _orthogonal(back[:, -1], right, BREAKDOWN * scale)
        else:
            combos, back = np.column_stack((combos, np.zeros(dims))), np.column_stack((back, np.zeros(dims)))
            v, beta = None, 0.0
        if v is None:
            v, beta = _fresh_direction(rng, right), 0.0
            if v is None:
                break
    return right, b


def principal_axes(blocks: DataFrame, sums: Sums, components: int = COMPONENTS, steps: int | None = None) -> Axes:
    """The components of largest variance. Directions in which nothing varies are left out, so there may be fewer."""
    right, b = bidiagonalise(blocks, sums, steps)
    _, sigma, rotated = np.linalg.svd(b[: right.shape[1], : right.shape[1]])
    variances = sigma**2 / sums.n
    dims, mean = sums.dims, sums.mean

    def measure(batches):
        return np.array([sum(float(((rows - mean) ** 2).sum()) for _, rows in _blocks(batches, dims))])

    trace = float(_totals(blocks, measure, 1, "double")[0]) / sums.n
    wanted = np.flatnonzero(variances[:components] > LEAST_SHARE * trace)
    return Axes((right @ rotated.T).T[wanted], variances[wanted], trace)


def identity_error(blocks: DataFrame, sums: Sums, axes: Axes) -> float:
    """Largest absolute entry of the covariance of the whitened rows less the identity, measured over all rows."""
    k, dims, mean = len(axes.variances), sums.dims, sums.mean
    whiten = axes.components.T / np.sqrt(axes.variances)

    def measure(batches):
        total = np.zeros(k + k * k)
        for _, rows in _blocks(batches, dims):
            w = (rows - mean) @ whiten
            total[:k] += w.sum(axis=0)
            total[k:] += (w.T @ w).ravel()
        return total

    out = np.array(_totals(blocks, measure, k + k * k, "double"))
    middle = out[:k] / sums.n
    covariance = out[k:].reshape(k, k) / sums.n - np.outer(middle, middle)
    return float(np.abs(covariance - np.eye(k)).max()) if k else 0.0


def _exact_squares(rows: np.ndarray, sums: Sums) -> list[int]:
    """Per row the sum over dimensions of (n * x - S)^2, exactly."""
    spread = sums.n * (sums.largest + 1) * 2
    if spread < 2.0**62:
        off = sums.n * rows - np.array(sums.totals, dtype=np.int64)
        if spread * spread * sums.dims < 2.0**62:
            return (off * off).sum(axis=1).tolist()
        off = off.astype(object)
    else:
        off = sums.n * rows.astype(object) - np.array(sums.totals, dtype=object)
    return (off * off).sum(axis=1).tolist()


def whiten(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, steps: int | None = None
) -> DataFrame:
    """``(vec_id, n, deviation, whitened, explained, identity_error)`` per usable vector.

    ``whitened`` and ``explained`` are arrays over the components, numbered by falling variance: the row's centred projection over
    the deviation along the component, and the component's share of the variance. ``deviation`` is the exact squared distance
    from the mean, times n^2, as decimal(38, 0) (null beyond it). A vector that is null or holds a null or non-finite entry is
    dropped, as is one whose length isn't the table's most frequent one. Fewer components come out where vectors are shorter or
    nothing varies in a direction: equal rows, or a single one, give empty arrays. Repeated rows count as often as they stand;
    null keys are kept; other columns are not read; an empty table gives no rows.
    """
    dims = usual_length(vectors, vector)
    schema = "vec_id long, n long, deviation string, whitened array<double>, explained array<double>, identity_error double"
    blocks = stash(pack_rows(vectors, dims, key, vector)) if dims else None
    sums = count_rows(blocks, dims) if dims else Sums(0, 0, [], 0.0)
    if not sums.n:
        empty = vectors.sparkSession.createDataFrame([], schema)
        return empty.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
    axes = principal_axes(blocks, sums, components, steps)
    error, mean = identity_error(blocks, sums, axes), sums.mean
    projection = axes.components.T / np.sqrt(axes.variances)
    shares = axes.variances / axes.trace if axes.trace else axes.variances

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _blocks(batches, dims):
            m, k = len(rows), len(shares)
            ends = pa.array(np.arange(m + 1, dtype=np.int32) * k)
            yield pa.record_batch(
                [
                    ids,
                    pa.array(np.full(m, sums.n)),
                    pa.array([str(d) for d in _exact_squares(rows, sums)], pa.string()),
                    pa.ListArray.from_arrays(ends, pa.array(((rows - mean) @ projection).ravel())),
                    pa.ListArray.from_arrays(ends, pa.array(np.tile(shares, m))),
                    pa.array(np.full(m, error)),
                ],
                names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return blocks.mapInArrow(run, schema).withColumn("deviation", F.expr("try_cast(deviation as decimal(38,0))"))
