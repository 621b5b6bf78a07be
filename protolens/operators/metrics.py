"""Evaluation of predictions against a truth table."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: what a missing prediction counts as.
MISSING = "__none__"


def combinations(**values: list) -> list[dict]:
    """Every combination of named parameter values."""
    return [dict(zip(values, own, strict=True)) for own in product(*values.values())]


def with_truth(truth: DataFrame, preds: DataFrame, by: list[str] | None = None, configs: list[dict] | None = None) -> DataFrame:
    """(by, query, true, pred): every truth row, the sentinel where nothing was predicted.

    ``by`` names columns of ``preds`` that tell configurations apart; each is held against the
    whole truth. They are ``configs`` if given, which are spelled out beside each truth row, else
    those that occur in ``preds``, which meet the truth under one constant key; the few of them
    are broadcast by size at run time.
    """
    by = by or []
    if not by:
        return truth.join(preds.select("query", "pred"), "query", "left").withColumn("pred", F.coalesce("pred", F.lit(MISSING)))
    if configs:
        each = F.array(*[F.struct(*[F.lit(c[b]).alias(b) for b in by]) for c in configs])
        full = truth.withColumn("_c", F.explode(each)).select(*truth.columns, "_c.*")
    else:
        full = truth.withColumn("_on", F.lit(1)).join(preds.select(*by, F.lit(1).alias("_on")).distinct(), "_on").drop("_on")
    return full.join(preds.select(*by, "query", "pred"), [*by, "query"], "left").withColumn("pred", F.coalesce("pred", F.lit(MISSING)))


def weighted_f1(judged: DataFrame, by: list[str] | None = None, counts: bool = False) -> DataFrame:
    """Weighted F1 of (true, pred) rows: classes weigh their support, F1 is 0 where undefined.

    Rows become one for the true class and one for the predicted, summed map-side per class.
    With ``counts`` n_predicted and n_none come from the same sums.
    """
    by = by or []
    hit, none = F.when(F.col("true") == F.col("pred"), 1).otherwise(0), F.when(F.col("pred") == MISSING, 1).otherwise(0)
    side = lambda own, tp, sup, got, missing: F.struct(F.col(own).alias("_class"), tp.alias("tp"), F.lit(sup).alias("sup"), F.lit(got).alias("got"), missing.alias("missing"))
    sides = judged.select(*by, F.explode(F.array(side("true", hit, 1, 0, none), side("pred", F.lit(0), 0, 1, F.lit(0)))).alias("_side")).select(*by, "_side.*")
    classes = sides.groupBy(*by, "_class").agg(*[F.sum(c).alias(c) for c in ("tp", "sup", "got", "missing")])
    f1 = F.col("sup") * F.when(F.col("sup") + F.col("got") > 0, 2.0 * F.col("tp") / (F.col("sup") + F.col("got"))).otherwise(0.0)
    more = [F.coalesce(F.sum("sup") - F.sum("missing"), F.lit(0)).cast("long").alias("n_predicted"), F.coalesce(F.sum("missing"), F.lit(0)).cast("long").alias("n_none")] if counts else []
    return classes.groupBy(*by).agg(F.round(F.sum(f1) / F.sum("sup"), 6).alias("weighted_f1"), *more)


def evaluate(truth: DataFrame, preds: DataFrame, by: list[str] | None = None, configs: list[dict] | None = None) -> DataFrame:
    """Weighted F1 over all truth rows with n_predicted and n_none, in one pass."""
    return weighted_f1(with_truth(truth, preds, by, configs), by, counts=True)


def evaluate_predicted_only(truth: DataFrame, preds: DataFrame) -> DataFrame:
    """Weighted F1 over the queries that have a prediction."""
    return weighted_f1(truth.join(preds.where("pred is not null").select("query", "pred"), "query"))


def class_sizes(truth: DataFrame, label: str = "label", dense: bool = False) -> DataFrame:
    """Histogram of class sizes (size, n_classes), with empty sizes if ``dense``."""
    sizes = truth.groupBy(label).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_classes"))
    if not dense:
        return sizes
    upto = sizes.agg(F.max("size").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("size"))
    return upto.join(sizes, "size", "left").select("size", F.coalesce("n_classes", F.lit(0)).alias("n_classes"))


def sources_used(judged: DataFrame) -> DataFrame:
    """Counters of which source answered (column ``source``: null for none)."""
    return judged.agg(F.count_if(F.col("source") == "retrieval").cast("long").alias("n_retrieval"), F.count_if(F.col("source") == "fallback").cast("long").alias("n_fallback"), F.count_if(F.col("source").isNull()).cast("long").alias("n_none"))
