"""Co-moments of all pairs of columns, computed per batch and merged pairwise.

A state is five matrices over (i, j): the rows in which both columns are there,
the mean of i in them, the sums of centred squares of i and products of i and j.
(The mean and squares of j are those of i at (j, i).)  Batches are centred at a
value of their own, so a constant column's squares are exactly 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np


def of_rows(x: np.ndarray) -> np.ndarray:
    """State (4, k, k) of a block of rows; NaN is missing."""
    there = ~np.isnan(x)
    first = np.where(there.any(0), x[there.argmax(0), np.arange(x.shape[1])], 0.0)
    d, m = np.where(there, x - first, 0.0), there.astype(float)
    n = m.T @ m
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(n > 0, (d.T @ m) / n, 0.0)
    squares = (d * d).T @ m - n * mean * mean
    products = d.T @ d - n * mean * mean.T
    return np.stack([n, mean + first[:, None], np.maximum(squares, 0.0), products])


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    with np.errstate(invalid="ignore", divide="ignore"):
        share = np.where(n > 0, b[0] / n, 0.0)
    step = np.where(b[0] > 0, np.where(a[0] > 0, b[1] - a[1], 0.0), 0.0)
    mean = np.where(a[0] > 0, a[1] + step * share, b[1])
    weight = a[0] * share
    return np.stack([n, mean, a[2] + b[2] + step * step * weight, a[3] + b[3] + step * step.T * weight])


def _folded(states: Iterable[np.ndarray]) -> Iterator:
    import pyarrow as pa
    total = None
    for s in states:
        total = s if total is None else merge(total, s)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])


def of_batches(batches) -> Iterator:
    """One state row per task with rows."""
    return _folded(of_rows(np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns], 1)) for b in batches if b.num_rows)


def _state(m: bytes) -> np.ndarray:
    flat = np.frombuffer(m, float)
    k = int(round((len(flat) / 4) ** 0.5))
    return flat.reshape(4, k, k)


def merged(batches) -> Iterator:
    """One state row of all those of a task."""
    return _folded(_state(m) for b in batches for m in b.column(0).to_pylist())


def correlations(names: list[str]) -> Callable:
    """Rows (x, y, r) of a final state."""
    def run(batches) -> Iterator:
        import pyarrow as pa
        for b in batches:
            for m in b.column(0).to_pylist():
                n, _, squares, products = _state(m)
                scale = np.sqrt(squares * squares.T)
                r = np.divide(products, scale, out=np.full_like(products, np.nan), where=(squares > 0) & (squares.T > 0) & (scale > 0))
                r = np.clip(r, -1.0, 1.0)
                np.fill_diagonal(r, np.where(np.diag(squares) > 0, 1.0, np.nan))
                i, j = np.indices(r.shape).reshape(2, -1)
                out = r[i, j]
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in i]), pa.array([names[k] for k in j]),
                                                  pa.array(out, pa.float64(), mask=np.isnan(out))], names=["x", "y", "r"])
    return run
