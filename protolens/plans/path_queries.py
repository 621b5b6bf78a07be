"""Queries of linear classifiers over several penalties, alone and behind a retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from protolens.operators import ensemble as N
from protolens.operators import metrics as A
from protolens.operators import ml as M
from protolens.operators import path as L
from protolens.operators import retrieval as R
from protolens.plans.data import truth, vectors

THRESHOLDS = [0.5, 0.7, 0.9]


def _grid(spark, sf_dir, train, test, cs):
    """Weighted F1 of a sure retrieval, else the classifier, for each C and threshold."""
    rows, queries = vectors(spark, sf_dir)
    found = L.fit_path(train, cs).predict(test)
    preds = L.gate_grid(R.top_1(R.hits_from_vectors(queries, rows, 1), rows), found, THRESHOLDS)
    return A.evaluate(truth(queries), preds, ["c", "threshold"], A.combinations(c=cs, threshold=THRESHOLDS))


def c_path_f1(spark, sf_dir):
    train, test = vectors(spark, sf_dir)
    return _grid(spark, sf_dir, *M.scaled(train, test), L.PATH)


def c_path_concat_f1(spark, sf_dir):
    """The same over two unit blocks side by side."""
    half = lambda t, i: t.withColumn("features", F.slice("features", 32 * i + 1, 32))
    both = lambda t: N.concat_vectors(half(t, 0), half(t, 1))
    train, test = vectors(spark, sf_dir)
    return _grid(spark, sf_dir, *M.scaled(both(train), both(test)), L.SHORT_PATH)


def svm_path_predict(spark, sf_dir):
    """Squared hinge separators of each class for three penalties."""
    train, test = vectors(spark, sf_dir)
    return L.fit_path(train, [0.1, 1.0, 10.0], "hinge").predict(test)


QUERIES = {"c_path_f1": c_path_f1, "c_path_concat_f1": c_path_concat_f1, "svm_path_predict": svm_path_predict}
ORACLES: dict[str, str] = {}
