"""Linear classifiers for several penalties at once: multinomial logistic regression and squared
hinge separators of each class against the rest.

Each value of C is a quasi-Newton run of its own on the driver, which only holds weights. The
points that all unfinished runs want to know next are evaluated in one pass over the rows: a
task sums losses and gradients of its rows for all of them, groups of tasks are summed before
the driver sums the groups. So a path over C costs as many passes as its slowest run. Runs start
from the weights of a rough run at the middle C.

Losses are summed, ``C`` times their sum plus half the squared weights is minimised. The logistic
intercept is free, the separators' intercept is a weight like any other, as the usual
implementations have it. A run ends when no entry of the gradient, divided by C and the rows,
exceeds ``tol``; one that does not get there raises. Separators report their duality gap.

Results for odd input: rows with a null label or vector take no part; a table of one class always
predicts it; without rows predictions are null.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolens.sources.files import kept

#: The penalties of the two paths.
PATH, SHORT_PATH = [0.01, 0.1, 0.3, 1.0, 3.0, 10.0], [0.1, 1.0, 3.0]
#: Groups in which the sums of tasks are added up before they reach the driver.
GROUPS = 8
#: Numbers of scores that a task holds at a time.
_SLICE = 1 << 21
_SUMS = "part int, losses binary, gradients binary"


def _quasi_newton(at: np.ndarray, tol: float, steps: int, memory: int = 12) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Yields points, is sent (value, gradient) of each, returns the minimum of a smooth convex
    function: limited-memory updates, steps halved until the value falls enough."""
    value, slope = yield at
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(slope).max(initial=0.0) <= tol:
            return at
        way, used = -slope.copy(), []
        for s, y, r in reversed(moves):
            used.append(r * (s @ way))
            way -= used[-1] * y
        if moves:
            s, y, _ = moves[-1]
            way *= (s @ y) / (y @ y)
        else:
            way /= max(1.0, float(np.linalg.norm(slope)))
        for (s, y, r), a in zip(moves, reversed(used), strict=True):
            way += (a - r * (y @ way)) * s
        down = float(slope @ way)
        if down >= 0:
            moves, way, down = [], -slope, -float(slope @ slope)
        length = 1.0
        while True:
            trial = at + length * way
            new, turned = yield trial
            if new <= value + 1e-4 * length * down + 1e-13 * abs(value):
                break
            length *= 0.5
            if length < 1e-12:
                raise RuntimeError("no step along a falling direction makes the value fall")
        s, y = trial - at, turned - slope
        if s @ y > 1e-12 * (y @ y):
            moves = [*moves, (s, y, 1 / (s @ y))][-memory:]
        at, value, slope = trial, new, turned
    raise RuntimeError(f"not within {tol} after {steps} steps")


def _logistic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(losses by point, slopes) of scores rows x points x classes."""
    top = z.max(axis=2, keepdims=True)
    p = np.exp(z - top)
    total = p.sum(axis=2, keepdims=True)
    own = np.take_along_axis(z, y[:, None, None], axis=2)
    losses = (np.log(total) + top - own).sum(axis=(0, 2))
    p /= total
    p[np.arange(len(y)), :, y] -= 1
    return losses, p


def _hinge(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared hinge of each class against the rest."""
    side = np.full(z.shape, -1.0)
    side[np.arange(len(y)), :, y] = 1.0
    short = np.maximum(0.0, 1 - side * z)
    return (short**2).sum(axis=(0, 2)), -2 * side * short


_LOSSES = {"logistic": _logistic, "hinge": _hinge}


def _rows(batch: pa.RecordBatch, step: int) -> Iterator[tuple[np.ndarray, list]]:
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
        yield np.concatenate([x, np.ones((len(x), 1))], axis=1), part.column(1).to_pylist()


def _summed(points: np.ndarray, numbers: dict[str, int], loss: str):
    """Sums over a task's rows at ``points`` (points x (width + 1) x classes)."""
    n, width, classes = points.shape
    flat, step = points.transpose(1, 0, 2).reshape(width, n * classes), max(1, _SLICE // (n * classes + width))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        losses, gradients = np.zeros(n), np.zeros((width, n * classes))
        for batch in batches:
            for x, labels in _rows(batch, step):
                y = np.array([numbers[v] for v in labels])
                own, slopes = _LOSSES[loss]((x @ flat).reshape(len(x), n, classes), y)
                losses += own
                gradients += x.T @ slopes.reshape(len(x), n * classes)
        part = TaskContext.get().partitionId() % GROUPS
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([losses.tobytes()], pa.binary()), pa.array([gradients.tobytes()], pa.binary())], names=["part", "losses", "gradients"])

    return over


def _added(rows: pa.Table) -> pa.Table:
    total = lambda c: sum(np.frombuffer(b) for b in rows.column(c).to_pylist()).tobytes()
    return pa.table({"part": rows.column("part").slice(0, 1), "losses": pa.array([total("losses")], pa.binary()), "gradients": pa.array([total("gradients")], pa.binary())})


def _evaluated(data: DataFrame, points: np.ndarray, numbers: dict[str, int], loss: str) -> tuple[np.ndarray, np.ndarray]:
    """(sums of losses, gradients: points x (width + 1) x classes): one pass over the rows."""
    n, width, classes = points.shape
    sums = data.mapInArrow(_summed(points, numbers, loss), _SUMS).groupBy("part").applyInArrow(_added, _SUMS).collect()
    losses = sum((np.frombuffer(r["losses"]) for r in sums), np.zeros(n))
    gradients = sum((np.frombuffer(r["gradients"]) for r in sums), np.zeros(width * n * classes))
    return losses, gradients.reshape(width, n, classes).transpose(1, 0, 2)


@dataclass
class LinearPath:
    """Weights by C: (len(cs) x (width + 1) x classes); ``gaps`` are duality gaps relative to the
    minimum, for separators."""

    cs: list[float]
    labels: list[str]
    weights: np.ndarray
    gaps: list[float] | None = None

    def predict(self, test: DataFrame) -> DataFrame:
        """(c, query, pred): the class of the greatest score for each C, ties to the smaller label."""
        n, width, classes = self.weights.shape
        flat, labels, cs = self.weights.transpose(1, 0, 2).reshape(width, n * classes), np.array(self.labels, object), self.cs

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x, entries in _rows(batch, max(1, _SLICE // (n * classes + width))):
                    best = (x @ flat).reshape(len(x), n, classes).argmax(axis=2) if classes else None
                    found = labels[best.ravel()].tolist() if classes else [None] * (len(x) * n)
                    yield pa.RecordBatch.from_arrays([pa.array(cs * len(x), pa.float64()), pa.array(np.repeat(np.array(entries, object), n).tolist(), pa.string()), pa.array(found, pa.string())], names=["c", "query", "pred"])

        rows = test.where("features is not null").select(F.col("features").cast("array<double>").alias("features"), "entry")
        return rows.mapInArrow(over, "c double, query string, pred string")


def _run(data: DataFrame, n: int, cs: list[float], starts: np.ndarray, numbers: dict[str, int], loss: str, tol: float, steps: int) -> np.ndarray:
    """Minima of all runs; each pass serves all that are not at an end."""
    free = loss == "logistic"
    runs = [_quasi_newton(s.ravel(), tol, steps) for s in starts]
    wanted, done = {i: next(r) for i, r in enumerate(runs)}, {}
    while wanted:
        order = list(wanted)
        points = np.stack([wanted[i].reshape(starts.shape[1:]) for i in order])
        losses, gradients = _evaluated(data, points, numbers, loss)
        for i, w, value, slope in zip(order, points, losses, gradients, strict=True):
            held = w.copy()
            if free:
                held[-1] = 0
            scale = 1 / (cs[i] * n)
            try:
                wanted[i] = runs[i].send((value / n + scale * 0.5 * float((held**2).sum()), (slope / n + scale * held).ravel()))
            except StopIteration as end:
                done[i] = end.value.reshape(starts.shape[1:])
                del wanted[i]
    return np.stack([done[i] for i in range(len(cs))])


def fit_path(train: DataFrame, cs: list[float] | None = None, loss: str = "logistic", tol: float = 1e-5, steps: int = 2000) -> LinearPath:
    """Weights for every C over (label, features) from one series of passes."""
    cs = list(cs or PATH)
    rows = train.where("label is not null and features is not null").select(F.col("features").cast("array<double>").alias("features"), F.col("label").cast("string").alias("label"))
    data = kept(rows, "path-rows")
    sizes = data.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("features")).alias("width")).orderBy("label").collect()
    labels = [r["label"] for r in sizes]
    n, width = sum(r["n"] for r in sizes), max((r["width"] for r in sizes), default=0) + 1
    none = np.zeros((len(cs), width, len(labels)))
    if len(labels) < 2:
        return LinearPath(cs, labels, none, [0.0] * len(cs))
    numbers = {v: i for i, v in enumerate(labels)}
    middle = sorted(cs)[len(cs) // 2]
    rough = _run(data, n, [middle], none[:1], numbers, loss, max(tol, 1e-3), steps)
    weights = _run(data, n, cs, np.repeat(rough, len(cs), axis=0), numbers, loss, tol, steps)
    gaps = _gaps(data, cs, weights, numbers) if loss == "hinge" else None
    return LinearPath(cs, labels, weights, gaps)


def _gaps(data: DataFrame, cs: list[float], weights: np.ndarray, numbers: dict[str, int]) -> list[float]:
    """Primal less dual value over the primal one. Dual weights of a row are its slope times C: the
    gradient of the losses is then the sum of dual weights and rows, and their squares are four
    times the losses, so one pass gives both values."""
    losses, gradients = _evaluated(data, weights, numbers, "hinge")
    out = []
    for c, w, value, slope in zip(cs, weights, losses, gradients, strict=True):
        primal = 0.5 * float((w**2).sum()) + c * value
        # sum of dual weights a = 2 c short: c * sum(2 short); sum(short) = value + sum(short * side * z)
        total = 2 * c * (value - 0.5 * float((slope * w).sum()))
        dual = total - 0.5 * c * c * float((slope**2).sum()) - c * value
        out.append(float((primal - dual) / max(primal, 1e-300)))
    return out


def gate_grid(retrieved: DataFrame, predicted: DataFrame, thresholds: list[float]) -> DataFrame:
    """(c, threshold, query, pred): a retrieval (query, pred, prob) that is sure enough, else the
    classifier's answer (c, query, pred)."""
    sure = retrieved.select("query", F.col("pred").alias("found"), "prob")
    rows = predicted.join(sure, "query", "left").withColumn("threshold", F.explode(F.lit(thresholds)))
    pred = F.when(F.col("found").isNotNull() & (F.col("prob") >= F.col("threshold")), F.col("found")).otherwise(F.col("pred"))
    return rows.select("c", "threshold", "query", pred.alias("pred"))
