"""Combining predictors: fallback, confidence gate, agreement, layers, gated majority.

Predictors are tables (query, pred); the retrieval has a confidence ``prob`` as well. All are
joined to the queries from the left, so a missing answer is a null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolens.functions.vector import concat_blocks
from protolens.operators.vote import majority


def side_by_side(queries: DataFrame, **preds: DataFrame) -> DataFrame:
    """(query, each name): one column for each predictor, null where it has no answer."""
    out = queries.select("query")
    for name, p in preds.items():
        out = out.join(p.select("query", F.col("pred").alias(name)), "query", "left")
    return out


def fallback(queries: DataFrame, retrieval: DataFrame, model: DataFrame) -> DataFrame:
    """(query, pred, source): the retrieval's answer if it has one, else the model's."""
    both = side_by_side(queries, r=retrieval, m=model)
    return both.select("query", F.coalesce("r", "m").alias("pred"), F.when(F.col("r").isNotNull(), "retrieval").when(F.col("m").isNotNull(), "fallback").alias("source"))


def gate(queries: DataFrame, retrieval: DataFrame, model: DataFrame, threshold: float) -> DataFrame:
    """(query, pred, source): the retrieval's answer if its prob reaches the threshold."""
    r = retrieval.select("query", F.col("pred").alias("r"), "prob")
    both = queries.select("query").join(r, "query", "left").join(model.select("query", F.col("pred").alias("m")), "query", "left")
    sure = F.col("r").isNotNull() & (F.coalesce("prob", F.lit(0.0)) >= threshold)
    return both.select("query", F.when(sure, F.col("r")).otherwise(F.col("m")).alias("pred"), F.when(sure, "retrieval").when(F.col("m").isNotNull(), "fallback").alias("source"))


def gate_sweep(queries: DataFrame, retrieval: DataFrame, model: DataFrame, thresholds: list[float]) -> DataFrame:
    """``gate`` for several thresholds in one job: (threshold, query, pred)."""
    r = retrieval.select("query", F.col("pred").alias("r"), "prob")
    both = queries.select("query").join(r, "query", "left").join(model.select("query", F.col("pred").alias("m")), "query", "left")
    both = both.withColumn("threshold", F.explode(F.lit(thresholds).cast("array<double>")))
    sure = F.col("r").isNotNull() & (F.coalesce("prob", F.lit(0.0)) >= F.col("threshold"))
    return both.select("threshold", "query", F.when(sure, F.col("r")).otherwise(F.col("m")).alias("pred"))


def agreement(queries: DataFrame, retrieval: DataFrame, model: DataFrame, prefer: str = "retrieval") -> DataFrame:
    """(query, pred): the common answer; where they differ or one is missing, the preferred
    side's if it has one."""
    both = side_by_side(queries, r=retrieval, m=model)
    first, second = ("r", "m") if prefer == "retrieval" else ("m", "r")
    return both.select("query", F.when(F.col("r") == F.col("m"), F.col("r")).otherwise(F.coalesce(first, second)).alias("pred"))


def layered(queries: DataFrame, *sources: DataFrame) -> DataFrame:
    """(query, pred): the first source in order that has an answer."""
    names = {f"s{i}": s for i, s in enumerate(sources)}
    return side_by_side(queries, **names).select("query", F.coalesce(*names).alias("pred"))


def voted(queries: DataFrame, *voters: DataFrame) -> DataFrame:
    """(query, pred): plurality of the voters in order."""
    names = {f"v{i}": v for i, v in enumerate(voters)}
    return side_by_side(queries, **names).select("query", majority(*map(F.col, names)).alias("pred"))


def gated_majority(queries: DataFrame, retrieval: DataFrame, voters: list[DataFrame], threshold: float = 0.9) -> DataFrame:
    """The headline: a confident retrieval, else the majority of the models."""
    return gate(queries, retrieval, voted(queries, *voters), threshold)


def concat_vectors(*tables: DataFrame) -> DataFrame:
    """(entry, label, features): unit blocks of several vector tables side by side."""
    first, *rest = tables
    out = first.select("entry", "label", F.col("features").alias("f0"))
    out = reduce(lambda d, t: d.join(t[1].select("entry", F.col("features").alias(f"f{t[0]}")), "entry"), enumerate(rest, 1), out)
    return out.select("entry", "label", concat_blocks(*[F.col(f"f{i}") for i in range(len(tables))]).alias("features"))
