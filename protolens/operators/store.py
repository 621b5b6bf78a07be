"""Fitted models kept in the shared folder under the data and parameters that they came from.

A model is a table. Its name is a digest of the kind, the parameters and a fingerprint of the
rows that it was fitted on, whatever their order and partitions; a query whose model is there
reads it and does not fit. A model is written beside its place and renamed, so that a run that
is cut off leaves none that is half there.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protolens.operators.path import LinearPath, fit_path
from protolens.sources.files import scratch


def fingerprint(rows: DataFrame) -> str:
    """A digest of the rows as a set with repeats: their number and two sums of row hashes."""
    names = sorted(rows.columns)
    both = [F.sum(F.xxhash64(F.lit(seed), *names).cast("decimal(38,0)")) for seed in (1, 2)]
    n, a, b = rows.agg(F.count("*"), *both).first()
    return hashlib.sha256(f"{sorted(rows.dtypes)} {n} {a} {b}".encode()).hexdigest()


class ModelStore:
    """Models in one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, (folder or scratch(spark, "models")).rstrip("/")

    def place(self, kind: str, params: dict, rows: DataFrame) -> str:
        key = json.dumps([kind, params, fingerprint(rows)], sort_keys=True)
        return f"{self.folder}/{kind}-{hashlib.sha256(key.encode()).hexdigest()}"

    def _files(self, path: str):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def table(self, kind: str, params: dict, rows: DataFrame, fit: Callable[[], DataFrame]) -> DataFrame:
        """The model's table: read if it is there, else fitted and written."""
        path = self.place(kind, params, rows)
        files, place = self._files(path)
        if not files.exists(place):
            made = f"{path}.{uuid.uuid4().hex}"
            fit().write.parquet(made)
            if not files.rename(self._files(made)[1], place):
                files.delete(self._files(made)[1], True)  # another run was first: its model is the same
        return self.spark.read.parquet(path)

    def linear_path(self, train: DataFrame, cs: list[float], loss: str = "logistic", **how) -> LinearPath:
        """``fit_path`` through the store."""
        rows = train.select("label", "features")

        def fit() -> DataFrame:
            found = fit_path(rows, cs, loss, **how)
            gaps = found.gaps or [None] * len(cs)
            each = [(c, v, w[:, j].tolist(), g) for c, w, g in zip(found.cs, found.weights, gaps, strict=True) for j, v in enumerate(found.labels)]
            return self.spark.createDataFrame(each, "c double, label string, weights array<double>, gap double").coalesce(1)

        kept = self.table("linear", {"cs": cs, "loss": loss, **how}, rows, fit).orderBy("c", "label").collect()
        labels = sorted({r["label"] for r in kept})
        by = {(r["c"], r["label"]): r for r in kept}
        width = len(kept[0]["weights"]) if kept else 1
        weights = np.array([[by[c, v]["weights"] for v in labels] for c in cs], float).reshape(len(cs), len(labels), width).transpose(0, 2, 1)
        gaps = [by[c, labels[0]]["gap"] for c in cs] if kept else None
        return LinearPath(list(cs), labels, weights, None if not gaps or gaps[0] is None else gaps)
