"""The driver's tables in the forms that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protolens.functions.sequence import clean


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores before costly work, if they come from fewer files than that: a small
    file is one row group, which one task reads whatever the splits. Tables of many files stay
    where they are. Only the list of files is looked at; nothing is planned or run."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) of the embeddings: (entry, row_no, label, features)."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("entry"), F.col("vec_id").alias("row_no"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("features"))
    return v.where("row_no % 5 <> 0"), v.where("row_no % 5 = 0")


def truth(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("entry").alias("query"), F.col("label").alias("true"))


def sequences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) of the documents as residue strings: (entry, row_no, label, sequence)."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("entry"), F.col("doc_id").alias("row_no"), F.col("source").alias("label"), clean(F.col("text"), ascii_only=True).alias("sequence"))
    return d.where("row_no % 5 <> 0"), d.where("row_no % 5 = 0")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as residues of chains: three dimensions for a place, a fourth for the
    confidence, 20 letters. A chain has one label and at most 1,000 residues."""
    at = lambda i: (F.element_at("embedding", i).cast("double") * 40).alias
    return table(spark, sf_dir, "embeddings").select(F.concat_ws("/", F.col("label").cast("string"), F.floor(F.col("vec_id") / 1000).cast("string")).alias("entry"), F.col("vec_id").alias("i"), at(1)("x"), at(2)("y"), at(3)("z"), F.element_at("embedding", 4).cast("double").alias("b"), F.expr("substr('ACDEFGHIKLMNPQRSTVWY', cast(vec_id % 20 as int) + 1, 1)").alias("letter"))
