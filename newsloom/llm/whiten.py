"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Rows are centred exactly, in whole numbers: a row is n * x - S, divided by n. Each step
multiplies the centred rows X by a vector v and the result u by X transposed, and takes
all earlier directions out of both (full reorthogonalisation). What is left after as many
steps as there are dimensions is a small bidiagonal matrix with the singular values of X;
its singular vectors, turned back by the v's, are the components.

The rows never move: a step is one pass over them, in which a task gives sums of the size
of the dimensions. A vector u has one entry per row; it is never stored, since it is X
times a short vector g that the recurrence gives along with it. The driver holds the v's
and g's: dimensions times dimensions numbers, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import importable, saved

COMPONENTS, SEED = 8, 12
SCALE, SHIFT = 1024, 100_000
#: Rows handled at once.
_ROWS = 4096
#: An eigenvalue below this share of the greatest is no direction of the data.
_LEAST = 1e-20
_WIDE = 2**62


def fit_rows(vectors: DataFrame) -> DataFrame:
    """``vec_id, x``: the rows that remain, in whole numbers.

    Rows go whose vector is null or empty, or holds a null, an entry that is not finite,
    or one beyond the range of a long. Where vectors differ in length those of the most
    frequent length stay (of several, the greatest).
    """
    raw = vectors.select(F.col("vec_id").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c"))
    # A NaN fails the comparison's first half, an infinite entry the second.
    good = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(2.0**62 / SCALE)))
    x = F.transform("c", lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("long"))
    rows = raw.where(F.col("c").isNotNull() & good & (F.size("c") > 0)).select("vec_id", x.alias("x"))
    rows = saved(rows, "whole-vectors")
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (most["d"] if most else 0))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The vectors of arrow batches as matrices of whole numbers of at most ``_ROWS`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.column("x").slice(at, _ROWS)
            yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def _sums(rows: DataFrame, of_block: Callable[[np.ndarray], np.ndarray], size: int, kind: str) -> list:
    """Sums over all rows of what ``of_block`` makes of a block of them; ``size`` numbers.

    A task gives ``size`` rows, and Spark adds them up by place.
    """

    def run(batches):
        total = None
        for block in _blocks(batches):
            got = of_block(block)
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_pydict({"place": np.arange(size, dtype=np.int32), "value": total})

    parts = rows.select("x").mapInArrow(run, f"place int, value {kind}")
    value = F.col("value").cast("decimal(38,0)") if kind == "long" else F.col("value")
    found = parts.groupBy("place").agg(F.sum(value).alias("value")).collect()
    out = [0] * size
    for row in found:
        out[row["place"]] = int(row["value"]) if kind == "long" else row["value"]
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: as longs if they fit, else as Python's whole numbers."""
    if len(x) and n * int(np.abs(x).max()) + max(map(abs, sums)) >= _WIDE:
        return n * x.astype(object) - np.array(sums, object)
    return n * x - np.array(sums, np.int64)


def squared(dev: np.ndarray) -> list[int | None]:
    """Exact sums of squares of each row; null where one is beyond a long."""
    if dev.dtype != object and dev.size and int(np.abs(dev).max()) ** 2 * dev.shape[1] < 2**63:
        return (dev * dev).sum(1).tolist()
    exact = dev.astype(object)
    return [s if s < 2**63 else None for s in (exact * exact).sum(1)]


class Moments:
    """Number, sums and spread of all rows; makes centred blocks."""

    def __init__(self, rows: DataFrame):
        first = rows.select(F.size("x").alias("d")).first()
        self.d = d = first["d"] if first else 0

        def whole(block: np.ndarray) -> np.ndarray:
            # Halves of the numbers, so that no sum leaves the range of a long.
            return np.concatenate([[len(block)], (block >> 32).sum(0), (block & 0xFFFFFFFF).sum(0)])

        got = _sums(rows, whole, 2 * d + 1, "long")
        self.n = got[0]
        self.sums = [(h << 32) + low for h, low in zip(got[1 : d + 1], got[d + 1 :])]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return deviations(x, self.n, self.sums).astype(float) / self.n


def bidiagonal(multiply: Callable[[np.ndarray, np.ndarray], tuple], d: int, steps: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """``B, V`` of X V = U B, by ``steps`` steps; B is upper bidiagonal.

    ``multiply(g, G)`` passes over the rows: for u = X g it gives the squared length of
    u, X transposed times u, and the products of u with the columns of X G. A direction
    on which X vanishes leaves a zero on the diagonal; where the recurrence ends early it
    begins anew from a direction that is orthogonal to all before.
    """
    rng = np.random.default_rng(seed)
    v_all, g_all, q_all = (np.zeros((d, 0)) for _ in range(3))
    b, scale, beta = np.zeros((steps, steps)), 0.0, 0.0
    v = _unit(rng.standard_normal(d), v_all)
    for k in range(steps):
        v_all = np.column_stack([v_all, v])
        g = v - (beta * g_all[:, -1] if k and beta else 0.0)
        # Xv, less its share of the u's before; a second pass where much was taken out.
        for _ in range(3):
            length, q, along = multiply(g, g_all)
            g, q = g - g_all @ along, q - q_all @ along
            taken = float(along @ along)
            if taken <= 1e-16 * length:
                break
        alpha = np.sqrt(max(length - taken, 0.0))
        scale = max(scale, alpha)
        if alpha <= 1e-13 * scale or not scale:
            alpha, g, q = 0.0, np.zeros(d), np.zeros(d)
        else:
            g, q = g / alpha, q / alpha
        b[k, k] = alpha
        g_all, q_all = np.column_stack([g_all, g]), np.column_stack([q_all, q])
        if k + 1 == steps:
            break
        # Transposed X times u, less its share of the v's before.
        p = q - v_all @ (v_all.T @ q)
        p -= v_all @ (v_all.T @ p)
        beta = float(np.linalg.norm(p))
        if beta <= 1e-13 * scale:
            beta, v = 0.0, _unit(rng.standard_normal(d), v_all)
        else:
            v = p / beta
        b[k, k + 1] = beta
    return b, v_all


def _unit(v: np.ndarray, others: np.ndarray) -> np.ndarray:
    """``v`` without its share of orthonormal columns, of length 1."""
    for _ in range(2):
        v = v - others @ (others.T @ v)
    return v / np.linalg.norm(v)


def components(rows: DataFrame, moments: Moments, steps: int | None = None, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance, falling, and unit eigenvectors as columns.

    ``steps`` (all dimensions by default) is the number of passes; fewer give the leading
    components only as far as they have converged.
    """
    d = moments.d

    def multiply(g: np.ndarray, others: np.ndarray) -> tuple:
        k = others.shape[1]
        both = np.column_stack([others, g])

        def of_block(block: np.ndarray) -> np.ndarray:
            y = moments.centred(block)
            u = y @ both
            return np.concatenate([u.T @ u[:, k], y.T @ u[:, k]])

        got = np.array(_sums(rows, of_block, k + 1 + d, "double"), float)
        return float(got[k]), got[k + 1 :], got[:k]

    steps = d if steps is None else min(d, steps)
    b, v = bidiagonal(multiply, d, steps, seed)
    _, s, qt = np.linalg.svd(b)
    vectors = v @ qt.T
    return s * s / moments.n, vectors / np.linalg.norm(vectors, axis=0)


def whiten(vectors: DataFrame, count: int = COMPONENTS, steps: int | None = None) -> DataFrame:
    """Whitened coordinates of every row that remains: ``vec_id, component, n, deviation,
    whitened, explained, identity_error``.

    See ``fit_rows`` for the rows that remain; rows of equal or null ids stay as they are.
    Components are numbered from 1, at most ``count``; those on which the rows do not
    differ (fewer rows than dimensions, equal vectors) have no whitened form and are left
    out. An empty table, or rows that are all equal, give no rows. ``deviation`` is null
    where it is beyond a long. Other columns do not matter.
    """
    importable(vectors.sparkSession)
    rows = fit_rows(vectors)
    moments = Moments(rows)
    schema = (
        f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, "
        "whitened double, explained double, identity_error double"
    )
    if not moments.n:
        return vectors.sparkSession.createDataFrame([], schema)
    values, axes = components(rows, moments, steps)
    kept = int((values[:count] > _LEAST * max(values[0], 1.0)).sum()) if values[0] > 0 else 0
    values, axes = values[:kept], axes[:, :kept]
    turn = axes / np.sqrt(values)

    def of_block(block: np.ndarray) -> np.ndarray:
        y = moments.centred(block)
        w = y @ turn
        return np.concatenate([(y * y).sum(0), w.sum(0), (w.T @ w).ravel()])

    n, d = moments.n, moments.d
    got = np.array(_sums(rows, of_block, d + kept + kept * kept, "double"), float)
    trace, mean = got[:d].sum() / n, got[d : d + kept] / n
    spread = got[d + kept :].reshape(kept, kept) / n - np.outer(mean, mean)
    error = float(np.abs(spread - np.eye(kept)).max()) if kept else 0.0
    explained = values / trace if kept else values

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                x = next(_blocks(iter([part])))
                dev = deviations(x, n, moments.sums)
                m = len(x)
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": part.column("vec_id").take(pa.array(np.repeat(np.arange(m), kept))),
                        "component": pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)),
                        "n": pa.array(np.full(m * kept, n, np.int64)),
                        "deviation": pa.array([s for s in squared(dev) for _ in range(kept)], pa.int64()),
                        "whitened": pa.array(((dev.astype(float) / n) @ turn).ravel()),
                        "explained": pa.array(np.tile(explained, m)),
                        "identity_error": pa.array(np.full(m * kept, error)),
                    }
                )

    return rows.select("vec_id", "x").mapInArrow(run, schema)
