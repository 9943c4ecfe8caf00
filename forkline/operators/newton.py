"""Many class-balanced L2 logistic fits at once by Newton's method, one aggregation over one table per round.

A table has a row of numbers ``x``, a label ``y`` and, for each block of columns, the fold the row was dealt to (-1: the
block is not complete there). A fit belongs to a block and leaves out one fold, or none. In a round every task adds up
loss, gradient and Hessian of all fits that are still open; the sums, a few thousand numbers whatever the rows, give the
next step. A step that raises the loss is halved. The gradient that is left is returned with the fit: the objective is
strictly convex, so it bounds the distance to the one solution.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-10  # largest entry of the gradient, per row
MOST_ROUNDS = 60


@dataclass(frozen=True)
class LinearFit:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float
    n: int
    n_pos: int
    gradient: float = 0.0  # largest entry per row at the solution
    rounds: int = 0


@dataclass(frozen=True)
class Task:
    """A fit over the columns of a block, without the rows of one fold."""

    block: int
    columns: tuple[int, ...]
    left_out: int | None = None


def _reader() -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """x, y and folds of a batch. Made here, so that it travels with the tasks: executors need only numpy and pyarrow."""

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, folds = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for i in (0, 2))
        return x, batch.column(1).to_numpy(zero_copy_only=False), folds

    return read


def _added_up(rows: DataFrame, tasks: Sequence[Task], numbers: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """For each fit the sum over all batches of ``numbers(fit, x, y)`` of its rows."""
    read, plain = _reader(), [(t.block, list(t.columns), t.left_out) for t in tasks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, folds = read(batch)
            for i, (block, columns, left_out) in enumerate(plain):
                fold = folds[:, block]
                used = (fold >= 0) if left_out is None else (fold >= 0) & (fold != left_out)
                if used.any():
                    got = numbers(i, x[used][:, columns], y[used].astype(np.float64))
                    total[i] = total[i] + got if i in total else got
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["fit", "sums"])

    cells = rows.select("x", "y", "folds").mapInArrow(run, "fit int, sums array<double>").select("fit", F.posexplode("sums").alias("place", "v"))
    out: dict[int, dict[int, float]] = {}
    for r in cells.groupBy("fit", "place").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r["fit"], {})[r["place"]] = r["v"]
    return [np.array([out[i][k] for k in range(len(out[i]))]) if i in out else np.zeros(0) for i in range(len(tasks))]


def _standardised(rows: DataFrame, tasks: Sequence[Task]) -> list[tuple | None]:
    """(n, positives, mean, scale) per fit; None where its rows hold one class only. A constant column has scale 1."""
    first = _added_up(rows, tasks, lambda i, x, y: np.concatenate([[len(y), y.sum()], x.sum(0)]))
    means = [s[2:] / s[0] if len(s) else None for s in first]
    squares = _added_up(rows, tasks, lambda i, x, y: ((x - means[i]) ** 2).sum(0))
    out: list[tuple | None] = []
    for s, mean, sq in zip(first, means, squares, strict=True):
        if not len(s) or s[1] == 0 or s[1] == s[0]:
            out.append(None)
            continue
        n, deviation = s[0], np.sqrt(sq / s[0])
        # A mean of equal numbers may be off by rounding; such a column is constant.
        flat = deviation <= 1e-12 * np.maximum(np.abs(mean), 1e-300)
        out.append((int(n), int(s[1]), mean, np.where(flat, 1.0, deviation)))
    return out


def fit_many(rows: DataFrame, tasks: Sequence[Task], tol: float = TOLERANCE) -> list[LinearFit | None]:
    """Fits over ``rows`` (``x array<double>, y int, folds array<int>``), which every round reads once; store them.

    Columns are standardised by the rows of each fit (population deviation); classes weigh n / (2 n_class); the penalty
    is half the squared weights, without the intercept. A fit whose rows hold one class only is None.
    """
    known = _standardised(rows, tasks)
    state = {i: np.zeros(len(t.columns) + 1) for i, t in enumerate(tasks) if known[i]}
    kept: dict[int, tuple] = {}  # accepted point, its loss, its step and the share of the step tried
    done: dict[int, LinearFit] = {}
    for round_ in range(1, MOST_ROUNDS + 1):
        if not state:
            break
        open_fits = list(state)
        now = [tasks[i] for i in open_fits]

        def numbers(at: int, x: np.ndarray, y: np.ndarray, open_fits=open_fits, state=dict(state)) -> np.ndarray:
            i = open_fits[at]
            n, p, mean, scale = known[i]
            a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
            z = a @ state[i]
            e = np.exp(-np.abs(z))
            prob = np.where(z >= 0, 1 / (1 + e), e / (1 + e))
            weight = np.where(y == 1, n / (2.0 * p), n / (2.0 * (n - p)))
            loss = weight @ (np.log1p(e) + np.maximum(z, 0) - y * z)
            hessian = a.T @ (a * (weight * prob * (1 - prob))[:, None])
            return np.concatenate([[loss], a.T @ (weight * (prob - y)), hessian.ravel()])

        for i, sums in zip(open_fits, _added_up(rows, now, numbers), strict=True):
            w, d = state[i], len(state[i])
            n, p, mean, scale = known[i]
            ridge = np.append(np.ones(d - 1), 0.0)
            loss, gradient = sums[0] + 0.5 * (ridge * w * w).sum(), sums[1 : d + 1] + ridge * w
            size = float(np.abs(gradient).max() / n)
            if i in kept and loss > kept[i][1] + 1e-9 * abs(kept[i][1]) and kept[i][3] > 1e-6:
                at, before, step, share = kept[i]
                kept[i] = (at, before, step, share / 2)
                state[i] = at - share / 2 * step
            elif size <= tol or round_ == MOST_ROUNDS:
                if size > 1e-4:
                    raise RuntimeError("the fit did not settle")
                done[i] = LinearFit(tuple(mean.tolist()), tuple(scale.tolist()), tuple(w[:-1].tolist()), float(w[-1]), n, p, size, round_)
                del state[i]
            else:
                step = np.linalg.solve(sums[d + 1 :].reshape(d, d) + np.diag(ridge), gradient)
                kept[i] = (w, loss, step, 1.0)
                state[i] = w - step
    return [done.get(i) for i in range(len(tasks))]


def left_out_probabilities(rows: DataFrame, tasks: Sequence[Task], fits: Sequence[LinearFit | None], names: Sequence[str]) -> DataFrame:
    """``key, y, prob`` of the rows each fit has left out, under the fit's name."""
    read = _reader()
    made = [(t.block, list(t.columns), t.left_out, name, *map(np.array, (f.mean, f.scale, f.weights)), f.intercept)
            for t, f, name in zip(tasks, fits, names, strict=True) if f]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, folds = read(batch)
            for block, columns, left_out, name, mean, scale, weights, intercept in made:
                used = folds[:, block] == left_out
                if used.any():
                    z = (x[used][:, columns] - mean) / scale @ weights + intercept
                    e = np.exp(-np.abs(z))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(z)), pa.array(y[used], pa.int32()), pa.array(np.where(z >= 0, 1 / (1 + e), e / (1 + e)))],
                        names=["key", "y", "prob"])

    return rows.select("x", "y", "folds").mapInArrow(run, "key string, y int, prob double")
