"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are taken in Arrow batches next to the data. The trees are fitted
on the driver from a bounded sample of labelled rows (``TRAIN_ROWS``, the first by a hash of
the id), binned into at most ``BINS`` histogram bins. All trees are complete, so they flatten
into arrays of features, thresholds and leaf values that numpy traverses for a whole batch
and all trees at once.

Results for odd input: null and empty texts have statistics of zero and get a score like any
other; null labels or ids are not learnt from; a null id is held out or not as the empty
string is; repeated rows score alike; without any label every score is 0.5; empty tables give
no rows; other columns are passed on by ``score`` and ignored by the query.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protolens.llm._util import small_batches, spare, table

#: At most so many labelled rows are learnt from.
TRAIN_ROWS = 20_000
BINS, TREES, DEPTH, RATE, L2, LEAST_WEIGHT = 64, 120, 4, 0.12, 1.0, 2.0
BATCH = 256

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".,;:", b"!?", b"*#$%&@~^", b"|<>{}[]()/\\_=+", b"-'\""]
FEATURES = ["log_chars", "upper", "lower", "digit", "space", "line", "stops", "calls", "symbols", "markup", "quotes", "control", "wide", "entropy", "log_words", "word_length", "word_spread", "longest", "distinct_words", "distinct_pairs", "top_word", "single", "line_length", "distinct_lines", "top_line", "short_lines", "adjacent", "ends", "capital", "tail"]


def statistics(text: str | None) -> list[float]:
    """The numbers that describe one whole text, in the order of FEATURES."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = [float(counts[np.frombuffer(c, np.uint8)].sum()) / n for c in _CLASSES]
    p = counts[counts > 0] / n
    out = [np.log1p(len(text)), *shares, float(counts[:32].sum() - counts[10]) / n, float(counts[128:].sum()) / n, float(-(p * np.log2(p)).sum())]
    words = text.split()
    k = len(words)
    if k:
        sizes = np.fromiter(map(len, words), np.int64, k)
        seen = Counter(words)
        pairs = set(zip(words, words[1:], strict=False))
        ends = sum(w[-1] in ".!?:" for w in words)
        same = sum(a == b for a, b in zip(words, words[1:], strict=False))
        out += [np.log1p(k), sizes.mean(), sizes.std(), float(sizes.max()), len(seen) / k, len(pairs) / max(1, k - 1), max(seen.values()) / k, float((sizes == 1).sum()) / k]
    else:
        ends = same = 0
        out += [0.0] * 8
    lines = text.split("\n")
    found = Counter(lines)
    m = len(lines)
    out += [n / m, len(found) / m, max(found.values()) / m, sum(v for x, v in found.items() if len(x) < 20) / m]
    capital = sum(w[0].isupper() for w in words)
    out += [same / max(1, k), ends / max(1, k), capital / max(1, k), float(not text.rstrip().endswith((".", "!", "?")))]
    return out


@dataclass
class Forest:
    """Complete trees of equal depth: node i has children 2i + 1 and 2i + 2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.leaf) or not len(x):
            return np.full(len(x), self.base)
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.leaf))[None, :]
        node = np.zeros((len(x), len(self.leaf)), np.int64)
        while node[0, 0] < self.feature.shape[1]:
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return self.base + self.leaf[trees, node - self.feature.shape[1]].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _edges(x: np.ndarray) -> list[np.ndarray]:
    at = np.linspace(0, 1, BINS + 1)[1:-1]
    out = []
    for c in x.T:
        v = np.unique(c)
        out.append((v[:-1] + v[1:]) / 2 if len(v) <= BINS else np.unique(np.quantile(c, at)))
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boosted trees for the logistic loss, grown level by level from histograms."""
    inner = (1 << depth) - 1
    if not len(y) or y.min() == y.max():
        base = 0.0 if not len(y) else float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = _edges(x)
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), base)
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            local = node - first
            best = np.full(width, 1e-6)
            for f, b in enumerate(binned):
                key = local * BINS + b
                gs = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                hs = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
                gain[(hs < LEAST_WEIGHT) | (ht - hs < LEAST_WEIGHT)] = 0
                gain = gain[:, : len(edges[f])]
                if not gain.shape[1]:
                    continue
                at = gain.argmax(axis=1)
                value = gain[np.arange(width), at]
                for i in np.flatnonzero(value > best):
                    best[i], feature[t, first + i], threshold[t, first + i] = value[i], f, edges[f][at[i]]
            go = x[np.arange(len(y)), feature[t, node]] > threshold[t, node]
            node = 2 * node + 1 + go
        at = node - inner
        gs, hs = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
        leaf[t] = -RATE * gs / (hs + L2)
        margin += leaf[t, at]
    return Forest(base, feature, threshold, leaf)


def held_out(doc_id: Column) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(3)) == 1


def _features(df: DataFrame, keep: list[str]) -> DataFrame:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, BATCH):
                batch = whole.slice(first, BATCH)
                rows = [statistics(t) for t in batch.column(batch.schema.names.index("text")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in keep), pa.array(rows, pa.list_(pa.float64()))], names=[*keep, "x"])

    return small_batches(df).select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(over, T.StructType([*(df.schema[c] for c in keep), T.StructField("x", T.ArrayType(T.DoubleType()))]))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Forest:
    """A forest from labels (doc_id, quality) of documents that are not held out."""
    usable = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    some = usable.select("doc_id", F.col("quality").cast("int").alias("y")).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "y").limit(rows)
    found = _features(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), ["doc_id", "y"]).toPandas()
    found = found.sort_values(["doc_id", "y"], kind="stable")
    x = np.array(found["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, found["y"].to_numpy(float))


def score(docs: DataFrame, forest: Forest, made: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text."""
    schema = T.StructType([*docs.schema.fields, T.StructField(made, T.DoubleType())])
    at = docs.columns.index("text")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, BATCH):
                batch = whole.slice(first, BATCH)
                x = np.array([statistics(t) for t in batch.column(at).to_pylist()], float).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.score(x), pa.float64())], names=[*batch.schema.names, made])

    return small_batches(docs).mapInArrow(over, schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, forest)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the classifier rejects."""
    made = spare(docs, "quality_score")
    return score(docs, train(docs, labels), made).where(F.col(made) >= 0.5).drop(made)
