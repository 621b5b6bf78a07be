"""Experiment control: sweeps, ablations, reports, cached stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from protolens.functions.vector import group_ordinals, keep_ordinals
from protolens.operators.metrics import evaluate
from protolens.operators.ml import most_frequent, nearest_mean
from protolens.operators.retrieval import blocks_of, similar
from protolens.sources.files import kept


def grid(spark: SparkSession, **values: list) -> DataFrame:
    """Every combination of named parameter values, one row each."""
    out = None
    for name, own in values.items():
        column = F.explode(F.array(*map(F.lit, own))).alias(name)
        out = spark.range(1).select(column) if out is None else out.select("*", column)
    return out


def subsets(columns: list[tuple[str, str]]) -> dict[str, list[int]]:
    """Ablation: ALL, each group alone, ALL without each group; ordinals of each."""
    groups = list(dict.fromkeys(g for _, g in columns))
    out = {"ALL": list(range(len(columns)))}
    out |= {f"only_{g}": group_ordinals(columns, keep=g) for g in groups}
    if len(groups) > 1:
        out |= {f"ALL_minus_{g}": group_ordinals(columns, drop=g) for g in groups}
    return out


#: Neighbours that a model of this name asks; ``ncm`` asks the class means.
NEIGHBOURS = {"knn_cos_1": 1, "knn_cos_3": 3, "knn_cos_5": 5}


def ablate(train: DataFrame, test: DataFrame, columns: list[tuple[str, str]], models: list[str]) -> DataFrame:
    """(features, method, weighted_f1) of each subset and model.

    Every row becomes one for each subset, and subsets never meet: one plan for each model
    whatever the number of subsets. Neighbours are searched once, for the model that asks most,
    and written to the shared folder; other models take the first of these.
    """
    blocks, truth, out = (blocks_of(test), blocks_of(train)), test.select(F.col("entry").alias("query"), F.col("label").cast("string").alias("true")), None
    each = F.array(*[F.struct(F.lit(n).alias("subset"), keep_ordinals(F.col("features"), own).alias("features")) for n, own in subsets(columns).items()])
    a, b = (t.select("entry", "label", F.explode(each).alias("s")).select("entry", "label", "s.*") for t in (train, test))
    most = max((NEIGHBOURS.get(m, 0) for m in models), default=0)
    if most:
        order = Window.partitionBy("subset", "query").orderBy(F.desc("sim"), "target")
        near = kept(similar(b, a, most, blocks=blocks, by="subset").select("subset", "query", "target", F.row_number().over(order).alias("rk")), "neighbours")
    for m in models:
        preds = most_frequent(near.where(F.col("rk") <= NEIGHBOURS[m]), train, "subset") if m in NEIGHBOURS else nearest_mean(a, b, by="subset", blocks=blocks)
        rows = evaluate(truth, preds, ["subset"], [{"subset": n} for n in subsets(columns)])
        rows = rows.select(F.col("subset").alias("features"), F.lit(m).alias("method"), "weighted_f1")
        out = rows if out is None else out.unionByName(rows)
    return out


def pivoted(results: DataFrame, rows: str, columns: str, values: list[str], cell: str = "weighted_f1") -> DataFrame:
    """A report table with one column for each of ``values``, in that order."""
    return results.groupBy(rows).pivot(columns, values).agg(F.first(cell))


def best(results: DataFrame, score: str = "weighted_f1", tie: list[str] | None = None, n: int = 1) -> DataFrame:
    """The best ``n`` rows, ties in the order of the ``tie`` columns."""
    return results.orderBy(F.desc_nulls_last(score), *(tie or [])).limit(n)


def report(*parts: DataFrame) -> DataFrame:
    """Rows of all parts, columns that a part lacks null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def cached_stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at ``path``, built and written only if it is not there or ``force``."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if force or not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
