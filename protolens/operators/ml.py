"""Vector classifiers: nearest centroid, kNN, logistic regression, forests, SVMs, and a suite
that fits several and scores each.

Tables have (entry, label, features) with features an array of doubles; MLlib vectors are
made only at the border to an estimator.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protolens.functions.vector import l2_normalize, mean_vectors, scaling, standardize
from protolens.operators import forest
from protolens.operators.metrics import evaluate
from protolens.operators.retrieval import similar
from protolens.sources.files import kept


#: Entries of a kernel that a task holds: of columns while a machine is fitted, of a block that is judged.
HELD, JUDGED = 1 << 24, 1 << 21
#: Separators that are fitted at a time, rows of a task in their passes at the most.
AT_ONCE, PASS_ROWS = 8, 200_000
#: Numbers of separators that the driver holds while they are fitted, and vectors of one separator.
WEIGHTS, VECTORS = 1 << 25, 30


def class_means(train: DataFrame, by: str | None = None) -> DataFrame:
    """(entry, features): the unit mean of the unit vectors of each class, by its label."""
    keys = ["label", *([by] if by else [])]
    unit = train.select(*keys, l2_normalize(F.col("features")).alias("features"))
    means = mean_vectors(unit, keys, "features")
    return means.select(*keys[1:], F.col("label").cast("string").alias("entry"), l2_normalize(F.col("features")).alias("features"))


def nearest_mean(train: DataFrame, test: DataFrame, by: str | None = None, blocks: tuple[int, int] | None = None) -> DataFrame:
    """(by, query, pred): the class of greatest cosine, ties to the smaller label."""
    found = similar(test, class_means(train, by), 1, blocks=blocks, by=by)
    return found.select(*([by] if by else []), "query", F.col("target").alias("pred"))


def nearest_neighbours(train: DataFrame, test: DataFrame, k: int, metric: str = "cosine", by: str | None = None, blocks: tuple[int, int] | None = None) -> DataFrame:
    """(by, query, pred): the most frequent label of the ``k`` nearest rows, ties to the smaller label."""
    return most_frequent(similar(test, train, k, metric, blocks=blocks, by=by), train, by)


def most_frequent(near: DataFrame, train: DataFrame, by: str | None = None) -> DataFrame:
    """(by, query, pred): the most frequent label of each query's targets, ties to the smaller label."""
    keys = [*([by] if by else []), "query"]
    labels = train.select(F.col("entry").alias("target"), F.col("label").cast("string").alias("label")).distinct()
    near = near.join(labels, "target")
    votes = near.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    return votes.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("pred"))


def scaled(train: DataFrame, *others: DataFrame, with_mean: bool = True) -> list[DataFrame]:
    """All tables standardised by the means and population deviations of ``train``."""
    m, s = scaling(train, "features")
    return [t.withColumn("features", standardize(F.col("features"), m, s, with_mean)) for t in (train, *others)]


def _as_vector(rows: DataFrame) -> Column:
    """The features for an estimator: arrays become vectors, vectors stay."""
    return F.col("features") if isinstance(rows.schema["features"].dataType, VectorUDT) else array_to_vector("features")


def _fit_predict(estimator, train: DataFrame, test: DataFrame, passes: int = 0) -> DataFrame:
    """``passes``: the estimator goes over the rows many times, so these are dealt to so many tasks, once."""
    data = train.select(F.col("label").cast("string").alias("label"), _as_vector(train).alias("features"))
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(data)
    indexed = index.transform(data)
    indexed = (indexed.repartition(passes) if passes else indexed).cache()
    try:
        model = estimator.fit(indexed)
    finally:
        indexed.unpersist()
    out = model.transform(test.select(F.col("entry").alias("query"), _as_vector(test).alias("features")))
    return IndexToString(inputCol="prediction", outputCol="pred", labels=index.labels).transform(out).select("query", "pred")


def logistic_regression(train: DataFrame, test: DataFrame, c: float = 1.0, max_iter: int = 200) -> DataFrame:
    """Multinomial, L2; ``c`` is the inverse penalty of the summed loss."""
    n = max(1, train.count())
    return _fit_predict(LogisticRegression(labelCol="y", family="multinomial", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-8), train, test, passes=train.sparkSession.sparkContext.defaultParallelism)


def random_forest(train: DataFrame, test: DataFrame, trees: int = 100, balanced: bool = False, seed: int = 0) -> DataFrame:
    """Trees are grown until their leaves are pure, or to 30 levels."""
    return forest.predictions(train, test, trees, balanced, seed)


def linear_svm(train: DataFrame, test: DataFrame, c: float = 1.0, max_iter: int = 100) -> DataFrame:
    """One hinge-loss separator for each class against the rest; the optimiser stops after
    ``max_iter`` steps at the latest. AT_ONCE separators are fitted at a time, each by hundreds of
    short passes: together their tasks fill the cores, more tasks a pass only cost their start. Fewer
    are fitted at a time where vectors are so wide that the driver could not hold them."""
    n = max(1, train.count())
    cores = train.sparkSession.sparkContext.defaultParallelism
    together = at_once(train)
    tasks = max(4, -(-cores // together), -(-n // PASS_ROWS))
    return _fit_predict(OneVsRest(classifier=LinearSVC(maxIter=max_iter, regParam=1.0 / (c * n), standardization=False), labelCol="y", parallelism=together), train, test, passes=tasks)


def at_once(train: DataFrame) -> int:
    """Separators of these rows that the driver can hold."""
    row = train.select("features").where("features is not null").first()
    return max(1, min(AT_ONCE, WEIGHTS // (VECTORS * max(1, len(row["features"]) if row else 1))))


class _Radial:
    """The radial kernel of rows ``x``, column by column: those used last are held, up to HELD
    entries, so memory grows with the rows and not with their square."""

    def __init__(self, x: np.ndarray, gamma: float):
        self.x, self.gamma, self.squares, self.held = x, gamma, (x**2).sum(1), {}
        self.most = max(2, HELD // max(1, len(x)))

    def finite(self) -> bool:
        return bool(np.isfinite(self.squares).all())

    def column(self, i: int) -> np.ndarray:
        found = self.held.pop(i, None)
        if found is None:
            if len(self.held) >= self.most:
                del self.held[next(iter(self.held))]
            found = np.exp(-self.gamma * np.maximum(0, self.squares + self.squares[i] - 2 * (self.x @ self.x[i])))
        self.held[i] = found
        return found


class _Whole:
    """A kernel matrix that is at hand."""

    def __init__(self, k: np.ndarray):
        self.k = k

    def finite(self) -> bool:
        return bool(np.isfinite(self.k).all())

    def column(self, i: int) -> np.ndarray:
        return self.k[:, i]


def _dual(kernel: np.ndarray | _Radial, y: np.ndarray, c: float, tol: float = 1e-4, steps: int = 5_000_000) -> tuple[np.ndarray, float]:
    """Weights of a two-class machine by maximal violating pairs, until none violates by ``tol``;
    an error if the kernel isn't finite or that many steps don't get there."""
    kernel = _Whole(kernel) if isinstance(kernel, np.ndarray) else kernel
    if not kernel.finite():
        raise ValueError("the kernel holds numbers that are not finite")
    a, g = np.zeros(len(y)), -np.ones(len(y))
    for _ in range(steps):
        v = -y * g
        up, low = ((y > 0) & (a < c)) | ((y < 0) & (a > 0)), ((y > 0) & (a > 0)) | ((y < 0) & (a < c))
        i, j = int(np.where(up, v, -np.inf).argmax()), int(np.where(low, v, np.inf).argmin())
        if v[i] - v[j] < tol:
            break
        ki, kj = kernel.column(i), kernel.column(j)
        step = (v[i] - v[j]) / max(ki[i] + kj[j] - 2 * ki[j], 1e-12)
        step = min(step, (c - a[i]) if y[i] > 0 else a[i], a[j] if y[j] > 0 else (c - a[j]))
        a[i] += y[i] * step
        a[j] -= y[j] * step
        for m in (i, j):  # rounding must not leave a weight just beside a bound
            a[m] = 0.0 if a[m] < 1e-12 * c else c if c - a[m] < 1e-12 * c else a[m]
        g += y * (ki - kj) * step
    else:
        raise RuntimeError(f"pairs still violate by {tol} after {steps} steps")
    v = -y * g
    free = (a > 1e-8) & (a < c - 1e-8)
    up, low = ((y > 0) & (a < c)) | ((y < 0) & (a > 0)), ((y > 0) & (a > 0)) | ((y < 0) & (a < c))
    return a, float(v[free].mean() if free.any() else (v[up].max() + v[low].min()) / 2)


def rbf_svm(train: DataFrame, test: DataFrame, c: float = 1.0) -> DataFrame:
    """Radial kernel, one machine for each pair of classes, most votes win, ties to the smaller
    label; gamma is 1 / (width * variance of all entries).

    Pairs of classes are rows: each machine is fitted once, where its two classes meet, and
    written to the shared folder as the rows that carry weight; then it judges the test rows in
    blocks. Only single pairs of classes have to fit into a task. Classes are numbered, so that
    pairs meet by equal numbers.
    """
    long = train.select(F.explode("features").alias("v"))
    width = train.select(F.size("features").alias("n")).first()["n"]
    gamma = 1.0 / (width * max(long.agg(F.var_pop("v").alias("s")).first()["s"], 1e-12))
    def packed(frames):
        for pdf in frames:
            yield pd.DataFrame({"label": pdf["label"], "v": [np.asarray(v, float).tobytes() for v in pdf["v"]]})

    flat = train.select(F.col("label").cast("string").alias("label"), F.col("features").alias("v")).mapInPandas(packed, "label string, v binary")
    rows = kept(flat.groupBy("label").agg(F.array_join(F.collect_list(F.hex("v")), "").alias("rows")).select("label", F.unhex("rows").alias("rows")), "class-rows")
    labels = [r["label"] for r in rows.select("label").orderBy("label").collect()]
    if len(labels) < 2:
        return test.select(F.col("entry").alias("query"), F.lit(labels[0] if labels else None).cast("string").alias("pred"))
    number = F.array_position(F.lit(labels), F.col("label")).cast("int")
    n_blocks = max(1, test.count() // 2000)
    last, every = F.lit(len(labels)), F.sequence(F.lit(0), F.lit(n_blocks - 1))
    left = rows.where(number < last).select(F.col("label").alias("la"), F.col("rows").alias("ra"), F.explode(F.sequence(number + 1, last)).alias("b"))
    right = rows.select(F.col("label").alias("lb"), F.col("rows").alias("rb"), number.alias("b"))
    # A task for each pair of classes: by size they would all be put into a few.
    n_pairs = len(labels) * (len(labels) - 1) // 2
    pairs = left.join(right, "b").select("la", "ra", "lb", "rb").repartition(min(n_pairs, 2000), "la", "lb")
    blocks = test.select("entry", "features", F.pmod(F.xxhash64("entry"), F.lit(n_blocks)).cast("int").alias("t")).groupBy("t").agg(F.collect_list(F.struct("entry", "features")).alias("own"))

    k = lambda p, q: np.exp(-gamma * np.maximum(0, (p**2).sum(1)[:, None] + (q**2).sum(1)[None] - 2 * p @ q.T))
    matrix = lambda b: np.frombuffer(b, float).reshape(-1, width)

    def fitted(frames):
        for pdf in frames:
            for la, lb, ra, rb in zip(pdf["la"], pdf["lb"], pdf["ra"], pdf["rb"], strict=True):
                a, b = matrix(ra), matrix(rb)
                x, y = np.concatenate([a, b]), np.repeat([1.0, -1.0], [len(a), len(b)])
                weights, bias = _dual(_Radial(x, gamma), y, c)
                held = weights > 0
                yield pd.DataFrame([(la, lb, x[held].tobytes(), (weights * y)[held].tobytes(), bias)], columns=["la", "lb", "rows", "weights", "bias"])

    def judged(frames):
        for pdf in frames:
            for la, lb, rows, weights, bias, own in zip(*[pdf[n] for n in ("la", "lb", "rows", "weights", "bias", "own")], strict=True):
                x, w = matrix(rows), np.frombuffer(weights, float)
                t = np.array([list(o["features"]) for o in own], float)
                step = max(1, JUDGED // max(1, len(x)))
                side = np.concatenate([k(t[i : i + step], x) @ w + bias > 0 for i in range(0, len(t), step)])
                yield pd.DataFrame({"query": [o["entry"] for o in own], "label": np.where(side, la, lb)})

    machines = kept(pairs.mapInPandas(fitted, "la string, lb string, rows binary, weights binary, bias double"), "machines")
    met = machines.withColumn("t", F.explode(every)).join(blocks, "t").select("la", "lb", "rows", "weights", "bias", "own")
    met = met.repartition(min(n_pairs * n_blocks, 2000), "la", "lb", F.element_at("own", 1)["entry"])
    votes = met.mapInPandas(judged, "query string, label string").groupBy("query", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("query").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("pred"))


#: Models of a suite by name; each takes (train, test) that are scaled where it needs that.
SUITE = {
    "lr_l2": (True, lambda a, b: logistic_regression(a, b)),
    "svm_rbf": (True, lambda a, b: rbf_svm(a, b)),
    "rf_100": (False, lambda a, b: random_forest(a, b, 100)),
    "knn_cos_1": (False, lambda a, b: nearest_neighbours(a, b, 1)),
    "knn_cos_3": (False, lambda a, b: nearest_neighbours(a, b, 3)),
    "knn_cos_5": (False, lambda a, b: nearest_neighbours(a, b, 5)),
    "knn_l2_5": (True, lambda a, b: nearest_neighbours(a, b, 5, "l2")),
    "ncm": (False, lambda a, b: nearest_mean(a, b)),
}


def run_suite(train: DataFrame, test: DataFrame, names: list[str] | None = None, skip_failures: bool = True) -> DataFrame:
    """(method, weighted_f1, n_predicted, n_none) of each model; null scores, and a warning that
    names the fault, where one fails. Each row is computed here, so that faults of running count
    like those of planning."""
    spark, out = train.sparkSession, None
    truth = test.select(F.col("entry").alias("query"), F.col("label").cast("string").alias("true"))
    for name in names or list(SUITE):
        scale, run = SUITE[name]
        try:
            row = kept(evaluate(truth, run(*(scaled(train, test) if scale else (train, test)))).select(F.lit(name).alias("method"), "weighted_f1", "n_predicted", "n_none"), "suite")
        except Exception as fault:
            if not skip_failures:
                raise
            warnings.warn(f"{name}: {type(fault).__name__}: {str(fault)[:200]}", stacklevel=2)
            row = spark.createDataFrame([(name, None, None, None)], "method string, weighted_f1 double, n_predicted long, n_none long")
        out = row if out is None else out.unionByName(row)
    return out
