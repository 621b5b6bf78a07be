"""Weighted voting over ranked hits and plurality among voters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from protolens.operators.retrieval import top_k

#: What a hit may weigh.
WEIGHTS = ["bits", "prob", "lddt", "alntmscore", "uniform"]


def labelled(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Hits with the label of their target, null if it has none; of duplicate labels of an
    entry the last by ``row_no`` counts."""
    last = F.max_by("label", "row_no") if "row_no" in labels.columns else F.max("label")
    table = labels.groupBy("entry").agg(last.alias("label")).withColumnRenamed("entry", "target")
    return hits.join(table, "target", "left")


def weight_of(name: str) -> Column:
    return F.lit(1.0) if name == "uniform" else F.col(name)


def tally(ranked: DataFrame, by: list[str]) -> DataFrame:
    """(by, pred, n_hits, top_score) from ranked rows (by, label, w, rk).

    Sums are rounded to 9 digits before they are compared; ties go to the label of the best
    rank. n_hits counts slots, unlabelled ones included, and is 0 if no hit has a label.
    """
    scores = ranked.groupBy(*by, "label").agg(F.round(F.sum("w"), 9).alias("s"), F.min("rk").alias("first"), F.count("*").alias("n"))
    key = F.when(F.col("label").isNotNull(), F.struct("s", (-F.col("first")).alias("f")))
    best = scores.groupBy(*by).agg(F.max_by("label", key).alias("pred"), F.max(key).alias("_top"), F.sum("n").alias("n"))
    return best.select(*by, "pred", F.when(F.col("pred").isNull(), 0).otherwise(F.col("n")).cast("long").alias("n_hits"), F.coalesce("_top.s", F.lit(0.0)).alias("top_score"))


def vote(hits: DataFrame, labels: DataFrame, k: int, weight: str = "bits", min_prob: float = 0.0) -> DataFrame:
    """(query, pred, n_hits, top_score): the ``k`` best hits by bits vote with their weight."""
    ranked = labelled(top_k(hits, k, min_prob=min_prob), labels)
    return tally(ranked.withColumn("w", weight_of(weight)), ["query"])


def vote_sweep(hits: DataFrame, labels: DataFrame, ks: list[int], weights: list[str], min_probs: list[float] | None = None) -> DataFrame:
    """``vote`` for every combination (k, weight, min_prob) in one job: hits are ranked once
    for each threshold, then meet a table of the combinations."""
    thresholds = min_probs or [0.0]
    ranked = hits.withColumn("min_prob", F.explode(F.lit(thresholds).cast("array<double>"))).where((F.col("min_prob") <= 0) | (F.col("prob") >= F.col("min_prob")))
    order = Window.partitionBy("query", "min_prob").orderBy(F.desc("bits"), "target")
    ranked = ranked.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= max(ks))
    ranked = labelled(ranked, labels)
    each = F.array(*[F.struct(F.lit(w).alias("weight"), weight_of(w).cast("double").alias("w")) for w in weights])
    wide = ranked.withColumn("k", F.explode(F.lit(ks))).where("rk <= k").withColumn("c", F.explode(each))
    return tally(wide.select("k", "min_prob", "c.weight", "c.w", "query", "label", "rk"), ["k", "weight", "min_prob", "query"])


def majority(*voters: Column) -> Column:
    """Plurality of labels in the voters' order: ties go to the first voter among the most
    voted, null voters do not vote."""
    votes = F.filter(F.array(*voters), lambda v: v.isNotNull())
    counts = F.transform(votes, lambda v, i: F.struct(F.size(F.filter(votes, lambda u: u == v)).alias("n"), (-i).alias("i"), v.alias("v")))
    return F.array_max(counts)["v"]
