"""Paths of linear classifiers against plain solvers."""

import numpy as np
import pytest

from protolens.operators import metrics as A
from protolens.operators import path as L

CS = [0.01, 0.3, 10.0]


def some(n=240, width=5, classes=4, seed=3):
    g = np.random.default_rng(seed)
    middle = g.normal(0, 1.2, (classes, width))
    y = np.sort(g.integers(0, classes, n))
    return middle[y] + g.normal(0, 1, (n, width)), y


def frame(spark, x, y):
    rows = [(f"e{i:04}", f"class {c}", [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame([*rows, ("none", None, [0.0] * x.shape[1]), ("empty", "class 1", None)], "entry string, label string, features array<double>").repartition(5)


def objective(x, y, w, c):
    """Value and gradient of C times the summed logistic losses plus half the squared weights."""
    z = np.c_[x, np.ones(len(x))] @ w
    z -= z.max(1, keepdims=True)
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    held = np.r_[w[:-1], np.zeros((1, w.shape[1]))]
    value = -c * np.log(p[np.arange(len(y)), y]).sum() + 0.5 * (held**2).sum()
    p[np.arange(len(y)), y] -= 1
    return value, c * np.c_[x, np.ones(len(x))].T @ p + held


def newton(x, y, c, classes):
    """The minimum by damped Newton steps on the full Hessian."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros((a.shape[1], classes))
    for _ in range(60):
        z = a @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        value, slope = objective(x, y, w, c)
        h = np.zeros((w.size, w.size))
        for i in range(len(a)):
            h += c * np.kron(np.outer(a[i], a[i]), np.diag(p[i]) - np.outer(p[i], p[i]))
        free = np.repeat(np.r_[np.ones(a.shape[1] - 1), 0], classes)
        step = np.linalg.solve(h + np.diag(free + 1e-9), slope.ravel()).reshape(w.shape)
        length = 1.0
        while objective(x, y, w - length * step, c)[0] > value and length > 1e-9:
            length /= 2
        w = w - length * step
    return w


def test_optimality(spark):
    x, y = some()
    found = L.fit_path(frame(spark, x, y), CS, tol=1e-7)
    assert found.labels == [f"class {i}" for i in range(4)]
    for c, w in zip(CS, found.weights, strict=True):
        best = objective(x, y, newton(x, y, c, 4), c)[0]
        value, slope = objective(x, y, w, c)
        assert abs(slope).max() / (c * len(x)) <= 1.0001e-7
        assert 0 <= value - best + 1e-9 and (value - best) / best < 1e-8


def test_predictions(spark):
    x, y = some()
    other, _ = some(50, seed=9)
    found = L.fit_path(frame(spark, x, y), CS)
    got = {(r["c"], r["query"]): r["pred"] for r in found.predict(frame(spark, other, np.zeros(50, int))).collect()}
    assert len(got) == 3 * 51
    for c, w in zip(CS, found.weights, strict=True):
        best = (np.c_[other, np.ones(50)] @ newton(x, y, c, 4)).argmax(1)
        assert [got[c, f"e{i:04}"] for i in range(50)] == [f"class {b}" for b in best]


def test_separators(spark):
    """The duality gap bounds how far a separator's objective is from its minimum."""
    x, y = some()
    found = L.fit_path(frame(spark, x, y), CS, "hinge", tol=1e-7)
    a = np.c_[x, np.ones(len(x))]
    for c, w, gap in zip(CS, found.weights, found.gaps, strict=True):
        assert 0 <= gap + 1e-12 and gap < 1e-5
        side = np.where(y[:, None] == np.arange(4), 1.0, -1.0)
        short = np.maximum(0, 1 - side * (a @ w))
        primal = 0.5 * (w**2).sum() + c * (short**2).sum()
        alpha = 2 * c * short
        dual = alpha.sum() - 0.5 * ((a.T @ (alpha * side)) ** 2).sum() - (alpha**2).sum() / (4 * c)
        assert (primal - dual) / primal == pytest.approx(gap, abs=1e-9)
    loose = L.fit_path(frame(spark, x, y), CS, "hinge", tol=1e-2)
    assert max(loose.gaps) > max(found.gaps)


def test_few(spark):
    x, y = some()
    one = L.fit_path(frame(spark, x[:5], np.ones(5, int)), CS)
    assert {(r["c"], r["pred"]) for r in one.predict(frame(spark, x[:5], y[:5])).collect()} == {(c, "class 1") for c in CS}
    none = L.fit_path(frame(spark, x, y).limit(0), CS)
    assert none.predict(frame(spark, x[:5], y[:5]).limit(0)).count() == 0
    with pytest.raises(RuntimeError, match="not within"):
        L.fit_path(frame(spark, x, y), CS, tol=1e-9, steps=3)


def test_grid(spark):
    truth = spark.createDataFrame([("a", "x"), ("b", "y"), ("d", "x")], "query string, true string")
    sure = spark.createDataFrame([("a", "x", 0.8), ("b", "x", 0.6), ("d", None, 0.99)], "query string, pred string, prob double")
    preds = spark.createDataFrame([(c, q, "y" if c < 1 else "x") for c in (0.1, 1.0) for q in "abd"], "c double, query string, pred string")
    got = {(r["c"], r["threshold"], r["query"]): r["pred"] for r in L.gate_grid(sure, preds, [0.5, 0.7, 0.9]).collect()}
    assert len(got) == 18
    assert [got[0.1, t, "a"] for t in (0.5, 0.7, 0.9)] == ["x", "x", "y"] and [got[0.1, t, "b"] for t in (0.5, 0.7, 0.9)] == ["x", "y", "y"]
    assert {got[c, t, "d"] for c in (0.1,) for t in (0.5, 0.9)} == {"y"}
    rows = A.evaluate(truth, L.gate_grid(sure, preds, [0.5, 0.7, 0.9]), ["c", "threshold"], A.combinations(c=[0.1, 1.0], threshold=[0.5, 0.7, 0.9])).collect()
    assert len(rows) == 6 and all(r["n_predicted"] == 3 for r in rows)
