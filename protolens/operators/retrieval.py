"""Similarity retrieval: all-pairs in blocks, top-k per query, affinity in long form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from protolens.operators.relational import last_label

#: Rows of a block of the all-pairs product, and of a slice of it that is held at a time.
BLOCK, SLICE = 8192, 256
#: Pairs whose vectors are held at a time.
_HELD = 1 << 15
_PAIRS = pa.schema([("by", pa.string()), ("query", pa.string()), ("target", pa.string()), ("sim", pa.float64())])


def _matrix(rows: pa.Table) -> np.ndarray:
    lists = rows.column("v").combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n > 0, n, 1.0)


def _able(sim: np.ndarray, k: int, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all that can be among the ``k`` greatest of each row, if values may be off
    by half of ``slack``: the ``k``-th of the maxima of runs of columns bounds the ``k``-th of all."""
    n = sim.shape[1]
    tops = np.maximum.reduceat(sim, np.arange(0, n, max(1, n // (8 * k))), axis=1)
    k = min(k, tops.shape[1])
    least = np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k]
    return np.nonzero(sim >= (least - slack)[:, None])


def _best(row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the ``k`` greatest of each row, ties to the smaller column."""
    order = np.lexsort((column, -value, row))
    row, column, value = row[order], column[order], value[order]
    first = np.searchsorted(row, np.arange(rows))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], column[keep], value[keep]


def _distances(x: np.ndarray, b: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    step = max(1, (_HELD << 6) // b.shape[1])
    parts = [np.sqrt(((b[column[i : i + step]] - x[row[i : i + step]]) ** 2).sum(1)) for i in range(0, len(row), step)]
    return np.concatenate([*parts, np.zeros(0)])


def _cell(metric: str, k: int):
    def block(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _PAIRS.empty_table()
        a, b = _matrix(left), _matrix(right)
        names = np.array(right.column("entry").to_pylist(), object)
        order = np.argsort(names, kind="stable")
        order = order[np.isfinite(b[order]).all(axis=1)]
        b, names = b[order], names[order]
        if not len(b):
            return _PAIRS.empty_table()
        if metric == "cosine":
            a, b = _unit(a), _unit(b)
        else:
            # Products tell which distances can be among the least; these are computed from the vectors.
            middle = b.mean(axis=0)
            moved = b - middle
            squares = (moved**2).sum(1)
        found = []
        for at in range(0, len(a), SLICE):
            x = a[at : at + SLICE]
            if metric == "cosine":
                sim = x @ b.T
                row, column = _able(sim, k, np.full(len(x), 2e-6))
                value = sim[row, column]
            else:
                y = x - middle
                own = (y**2).sum(1)
                sim = 2 * (y @ moved.T) - squares
                far = np.sqrt(own) + np.sqrt(squares.max())
                row, column = _able(sim, k, 1e-5 * (far + 1e-5) + 1e-11 * far**2)
                value = -_distances(x, b, row, column)
            rows, targets, values = _best(row, column, np.round(value, 6) + 0.0, len(x), k)
            found.append((rows + at, targets, values))
        rows, targets, values = (np.concatenate(c) for c in zip(*found, strict=True))
        queries = np.array(left.column("entry").to_pylist(), object)[rows]
        return pa.Table.from_arrays([pa.repeat(key[0], len(queries)), pa.array(queries.tolist(), pa.string()), pa.array(names[targets].tolist(), pa.string()), pa.array(values)], schema=_PAIRS)

    return block


def blocks_of(df: DataFrame, block: int = BLOCK) -> int:
    """Number of blocks that hold a table."""
    return max(1, -(-df.count() // block))


def similar(queries: DataFrame, targets: DataFrame, k: int, metric: str = "cosine", block: int = BLOCK, blocks: tuple[int, int] | None = None, by: str | None = None) -> DataFrame:
    """(query, target, sim) of the ``k`` most similar targets of each query, exactly.

    Both sides (entry, features) are cut into blocks; each pair of blocks is one matrix
    product that returns only its best ``k`` per query, so neither side is broadcast and no
    pair leaves a block that cannot be among the best. Similarities are rounded to 6 digits
    before ranking; ties go to the smaller target. ``l2`` gives negative distances. Rows are
    counted for the number of blocks unless ``blocks`` gives it for both sides. With ``by``, a
    string column of both, only rows that agree in it meet, and the result has it too.
    """
    n_q, n_t = blocks or (blocks_of(queries, block), blocks_of(targets, block))
    v, own = F.col("features").cast("array<double>").alias("v"), (F.col(by) if by else F.lit("")).alias("by")
    part = lambda n: F.pmod(F.xxhash64("entry"), F.lit(n)).cast("int")
    left = queries.select(own, "entry", v, part(n_q).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_t - 1))).alias("tb"))
    right = targets.select(own, "entry", v, part(n_t).alias("tb"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"))
    cells = left.groupBy("by", "qb", "tb").cogroup(right.groupBy("by", "qb", "tb"))
    pairs = cells.applyInArrow(_cell(metric, k), "by string, query string, target string, sim double")
    order = Window.partitionBy("by", "query").orderBy(F.desc("sim"), "target")
    best = pairs.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)
    return best.select(*([F.col("by").alias(by)] if by else []), "query", "target", "sim")


def hits_from_vectors(queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """Similarities as a hit table: bits is the cosine, prob maps it to [0, 1]."""
    sim = F.col("sim")
    return similar(queries, targets, k).select("query", "target", sim.alias("bits"), ((sim + 1) / 2).alias("prob"), (sim * sim).alias("alntmscore"), F.round(F.abs(sim), 6).alias("lddt"))


def top_k(hits: DataFrame, k: int, by: str = "bits", tie: str = "target", min_prob: float = 0.0) -> DataFrame:
    """The best ``k`` hits of each query with their rank; filtered by ``min_prob`` first."""
    if min_prob > 0:
        hits = hits.where(F.col("prob") >= min_prob)
    order = Window.partitionBy("query").orderBy(F.desc(by), tie)
    return hits.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)


def write_ranked(hits: DataFrame, path: str, by: str = "bits", tie: str = "target") -> None:
    """Hits with their rank, files sorted by query and rank: sorted once, when they are written."""
    order = Window.partitionBy("query").orderBy(F.desc(by), tie)
    hits.withColumn("rk", F.row_number().over(order)).write.mode("overwrite").parquet(path)


def read_ranked(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """The best ``k`` hits of each query, or all, of such files: a filter that the scan takes, with
    no shuffle and no sort."""
    hits = spark.read.parquet(path)
    return hits if k is None else hits.where(F.col("rk") <= k)


def top_1(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """(query, pred, prob) of each query's best hit; pred is null if its target has no label, and
    the last label of a repeated entry."""
    best = top_k(hits, 1).select("query", "target", "bits", "prob")
    own = last_label(labels) if "row_no" in labels.columns else labels.groupBy("entry").agg(F.max("label").alias("label"))
    return best.join(own.select(F.col("entry").alias("target"), F.col("label").alias("pred")), "target", "left").select("query", "target", "pred", "prob")


def best_residues(residues: DataFrame, k: int) -> DataFrame:
    """The ``k`` residues of each entry of highest confidence ``b``."""
    order = Window.partitionBy("entry").orderBy(F.desc("b"), "i")
    return residues.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k).drop("rk")


def drop_outputs(hits: DataFrame, marker: str = "_out") -> DataFrame:
    """Without hits whose query or target name holds the marker; null names stay."""
    has = lambda c: F.coalesce(F.contains(F.col(c), F.lit(marker)), F.lit(False))
    return hits.where(~has("query") & ~has("target"))


def affinity(hits: DataFrame, queries: DataFrame, targets: DataFrame, col: str = "bits", mask_self: bool = False) -> DataFrame:
    """Long affinity (query, target, value): known ids only, of duplicates the last by
    ``row_no``, no self hits if masked. Zeros are absent rows."""
    known = hits.join(queries.select(F.col("entry").alias("query")).distinct(), "query", "left_semi").join(targets.select(F.col("entry").alias("target")).distinct(), "target", "left_semi")
    if mask_self:
        known = known.where(F.col("query") != F.col("target"))
    order = F.col("row_no") if "row_no" in hits.columns else F.col(col)
    return known.groupBy("query", "target").agg(F.max_by(col, order).alias("value"))


def log1p(matrix: DataFrame) -> DataFrame:
    return matrix.withColumn("value", F.log1p("value"))


def with_any_hit(entries: DataFrame, matrix: DataFrame) -> DataFrame:
    """Entries whose affinity row is not all zero."""
    return entries.join(matrix.where("value > 0").select(F.col("query").alias("entry")), "entry", "left_semi")


def argmax_label(matrix: DataFrame, queries: DataFrame, targets: DataFrame, guess_first: bool = False) -> DataFrame:
    """(query, pred): label of the target of greatest affinity, ties to the first by ``row_no``.

    A query without any hit gets null, or the first target's label if ``guess_first``.
    """
    t = targets.select(F.col("entry").alias("target"), "row_no", "label")
    best = matrix.where("value > 0").join(t, "target").groupBy("query").agg(F.max_by("label", F.struct("value", -F.col("row_no"))).alias("pred"))
    out = queries.select(F.col("entry").alias("query")).join(best, "query", "left")
    if not guess_first:
        return out
    first = t.agg(F.min_by("label", "row_no").alias("first"))
    return out.withColumn("k", F.lit(1)).join(first.withColumn("k", F.lit(1)), "k", "left").select("query", F.coalesce("pred", "first").alias("pred"))


def affinity_features(matrix: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """(entry, label, features): affinity rows over target row numbers, for model fitting; a query
    without hits is a row of zeros. The width is the largest row number and one. A row is put
    together from its hits in order and the runs of zeros between them."""
    width = (targets.agg(F.max("row_no")).first()[0] or 0) + 1
    numbered = matrix.join(targets.select(F.col("entry").alias("target"), F.col("row_no").alias("pos")), "target")
    lists = numbered.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("cells"))
    own = queries.select("entry", "label").join(lists.withColumnRenamed("query", "entry"), "entry", "left")
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    held = own.withColumn("cells", F.coalesce("cells", F.array().cast("array<struct<pos:bigint,value:double>>")))
    runs = F.transform("cells", lambda c, i: F.concat(zeros(c["pos"] - F.coalesce(F.get("cells", i - 1)["pos"], F.lit(-1)) - 1), F.array(c["value"])))
    tail = zeros(F.lit(width - 1) - F.coalesce(F.get("cells", F.size("cells") - 1)["pos"], F.lit(-1)))
    return held.select("entry", "label", F.concat(F.flatten(runs), tail).alias("features"))



def affinity_cells(matrix: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """(entry, label, cells): the rows of ``affinity_features`` as (pos, value) of a query's hits, null
    without any: rows as wide as the table would grow with its square."""
    numbered = matrix.join(targets.select(F.col("entry").alias("target"), F.col("row_no").alias("pos")), "target")
    lists = numbered.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("cells"))
    return queries.select("entry", "label").join(lists.withColumnRenamed("query", "entry"), "entry", "left")


def affinity_vectors(matrix: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """(entry, label, features): the rows of ``affinity_cells`` as sparse vectors."""
    width = int((targets.agg(F.max("row_no")).first()[0] or 0) + 1)
    sparse = F.udf(lambda cells: Vectors.sparse(width, {c["pos"]: c["value"] for c in cells or []}), VectorUDT())
    return affinity_cells(matrix, queries, targets).select("entry", "label", sparse("cells").alias("features"))
