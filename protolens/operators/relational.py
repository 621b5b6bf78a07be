"""Alignment, filters and unions of labelled tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def align(a: DataFrame, b: DataFrame, keys: list[str], check: str = "label") -> DataFrame:
    """Inner join of two vector tables with concatenated features; an error if the labels of a
    key differ."""
    right = b.select(*keys, F.col(check).alias("_other"), F.col("features").alias("_more"))
    joined = a.join(right, keys)
    same = F.when(F.col(check).eqNullSafe(F.col("_other")), F.col(check)).otherwise(F.raise_error(F.concat(F.lit("labels differ for "), F.concat_ws(",", *keys))).cast(a.schema[check].dataType))
    return joined.withColumn(check, same).withColumn("features", F.concat("features", "_more")).drop("_other", "_more")


def label_mismatches(a: DataFrame, b: DataFrame, keys: list[str], check: str = "label") -> DataFrame:
    """Keys whose labels differ."""
    right = b.select(*keys, F.col(check).alias("other"))
    return a.select(*keys, check).join(right, keys).where(~F.col(check).eqNullSafe(F.col("other")))


def align_strict(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """``a`` with ``value`` of ``b``, in one-to-one order of ``a``; an error if a key is missing."""
    right = b.select(key, F.col(value).alias("_v"), F.lit(True).alias("_has"))
    joined = a.join(right, key, "left")
    kind = b.schema[value].dataType
    return joined.withColumn(value, F.when(F.col("_has"), F.col("_v")).otherwise(F.raise_error(F.concat(F.lit("missing "), F.col(key).cast("string"))).cast(kind))).drop("_v", "_has")


def known_labels(test: DataFrame, train: DataFrame, label: str = "label") -> DataFrame:
    """Test rows whose label occurs in train."""
    return test.join(train.select(label), label, "left_semi").select(*test.columns)


def unseen_labels(test: DataFrame, train: DataFrame, label: str = "label") -> DataFrame:
    """Test rows whose label does not."""
    return test.join(train.select(label), label, "left_anti").select(*test.columns)


def last_label(labels: DataFrame, key: str = "entry", label: str = "label", order: str = "row_no") -> DataFrame:
    """One label for each key: of duplicates the last."""
    return labels.groupBy(key).agg(F.max_by(label, order).alias(label))


def look_up(rows: DataFrame, labels: DataFrame, key: str, keep_missing: bool = True) -> DataFrame:
    """``rows`` with the label of ``key``; missing ones are null or left out."""
    return rows.join(last_label(labels).withColumnRenamed("entry", key), key, "left" if keep_missing else "inner")


def or_missing(column: Column, missing: str = "__none__") -> Column:
    return F.coalesce(column, F.lit(missing))



def status_counts(status: DataFrame) -> DataFrame:
    """(split, status, n) of a fetch log."""
    return status.groupBy("split", "status").agg(F.count("*").alias("n"))


def coverage(status: DataFrame, good: tuple[str, ...] = ("ok", "exists")) -> DataFrame:
    """(split, total, covered) of a fetch log."""
    return status.groupBy("split").agg(F.count("*").alias("total"), F.count_if(F.col("status").isin(*good)).cast("long").alias("covered"))


def all_splits(**tables: DataFrame) -> DataFrame:
    """One table of all splits, columns that some lack filled with nulls."""
    out = None
    for name, t in tables.items():
        t = t.withColumn("split", F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out
