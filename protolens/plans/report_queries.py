"""Queries of reports, kept stages, file copies and rows that are left out."""

from __future__ import annotations

from pyspark.sql import functions as F

from protolens.operators import experiment as G
from protolens.operators import relational as J
from protolens.operators import spatial as P
from protolens.operators import structure as U
from protolens.plans.data import points, table, vectors
from protolens.plans.sequence_queries import _P
from protolens.sources import files as X

TOP, LEAST = 20, 45


def summary_lines(spark, sf_dir):
    """Lines of a text report, read back."""
    path = X.scratch(spark, "summary")
    X.write_summary(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, "Nations")
    return spark.read.text(path).select(F.col("value").alias("line"))


def report_top(spark, sf_dir):
    """The first rows of a report over all customers."""
    return G.best(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_acctbal", ["c_custkey"], TOP)


def kept_stage(spark, sf_dir):
    """A stage that is built by its first user; the second would build something else and reads."""
    path, built = X.scratch(spark, "stage"), table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    G.cached_stage(spark, path, lambda: built)
    return G.cached_stage(spark, path, lambda: built.limit(0))


def split_copies(spark, sf_dir):
    """Matrix files dealt to folders: a second run after one that had only even numbers."""
    made, copies = X.scratch(spark, "npz"), X.scratch(spark, "copies")
    a, b = vectors(spark, sf_dir)
    X.write_npz(J.all_splits(train=a, test=b), made, 100)
    number = F.floor(F.col("vec_id") / 50)
    wanted = table(spark, sf_dir, "embeddings").select(number.alias("n")).distinct().select(F.concat(F.lit("train-"), F.lpad(F.col("n").cast("string"), 5, "0")).alias("entry"), F.when(F.col("n") % 3 == 0, "test").otherwise("train").alias("split"), "n")
    X.copy_by_split(wanted.where("n % 2 = 0"), made, copies)
    return X.copy_by_split(wanted, made, copies)


def short_chains(spark, sf_dir):
    """Letters of chains, cut to a string that is shorter, without chains that are too short."""
    r = U.placed(points(spark, sf_dir).drop("letter")).drop("i").withColumnRenamed("place", "i")
    strings = r.groupBy("entry").agg((F.count("*") - F.count("*") % 7).cast("int").alias("n")).select("entry", F.expr("substring(repeat('ACDEF', n), 1, n)").alias("di"))
    return P.with_letters(r, strings, LEAST).groupBy("entry", "letter").agg(F.count("*").alias("n"))


QUERIES = {"summary_lines": summary_lines, "report_top": report_top, "kept_stage": kept_stage, "split_copies": split_copies, "short_chains": short_chains}
_FILES = "SELECT DISTINCT vec_id // 50 AS n, vec_id // 50 IN (SELECT vec_id // 100 FROM embeddings WHERE vec_id % 5 <> 0) AS there FROM embeddings"
ORACLES = {
    "summary_lines": "SELECT 'Nations' AS line UNION ALL SELECT 'n_nationkey=' || n_nationkey || '  n_name=' || n_name || '  n_regionkey=' || n_regionkey FROM nation",
    "report_top": f"SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT {TOP}",
    "kept_stage": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL",
    "split_copies": f"SELECT 'train-' || lpad(n::VARCHAR, 5, '0') AS entry, CASE WHEN n % 3 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN NOT there THEN 'missing' WHEN n % 2 = 0 THEN 'exists' ELSE 'copied' END AS status FROM ({_FILES})",
    "short_chains": f"WITH {_P}, g AS (SELECT entry, count(*) - count(*) % 7 AS n FROM p GROUP BY entry) SELECT entry, substr('ACDEF', (k % 5)::INT + 1, 1) AS letter, count(*) AS n FROM (SELECT entry, unnest(range(0, n)) AS k FROM g WHERE n >= {LEAST}) GROUP BY ALL",
}
