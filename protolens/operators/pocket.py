"""Pocket features of proteins: the 81-D vector of pocket reports and linings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolens.functions.sequence import slug
from protolens.schemas import AMINO

TOP = 3
#: The numbers that a pocket report gives for each pocket, in order.
FIELDS = [
    "Score", "Druggability Score", "Number of Alpha Spheres", "Total SASA", "Polar SASA", "Apolar SASA", "Volume",
    "Mean local hydrophobic density", "Mean alpha sphere radius", "Mean alp. sph. solvent access",
    "Apolar alpha sphere proportion", "Hydrophobicity score", "Volume score", "Polarity score", "Charge score",
    "Proportion of polar atoms", "Alpha sphere density", "Cent. of mass - Alpha Sphere max dist", "Flexibility",
]


def feature_columns(spark) -> list[tuple[str, str]]:
    """(column, group) of the 81 features in order."""
    names = [r["s"] for r in spark.createDataFrame([(i, f) for i, f in enumerate(FIELDS)], "i int, f string").orderBy("i").select(slug(F.col("f")).alias("s")).collect()]
    return [(f"pk{i + 1}_{n}", "pocket_num") for i in range(TOP) for n in names] + [(c, "pocket_agg") for c in ("n_pockets", "best_score", "best_volume", "mean_score")] + [(f"pk1_aa_{a}_frac", "pocket_aa") for a in AMINO]


def pocket_features(entries: DataFrame, pockets: DataFrame, linings: DataFrame) -> DataFrame:
    """(entry, features): every entry has a row, zeros where it has no report.

    ``pockets`` is (entry, pocket_no, props), ``linings`` (entry, aa, frac) of the top pocket.
    All of it is conditional aggregation by entry.
    """
    value = lambda f: F.coalesce(F.element_at("props", F.lit(f)), F.lit(0.0))
    at = lambda i, f: F.coalesce(F.max(F.when(F.col("pocket_no") == i, value(f))), F.lit(0.0))
    sums = [at(i, f).alias(f"p{i}_{j}") for i in range(1, TOP + 1) for j, f in enumerate(FIELDS)]
    sums += [F.count("*").cast("double").alias("n_pockets"), F.max(value("Score")).alias("best_score"), F.max(value("Volume")).alias("best_volume"), F.avg(value("Score")).alias("mean_score")]
    numbers = pockets.groupBy("entry").agg(*sums)
    letters = linings.groupBy("entry").agg(*[F.coalesce(F.max(F.when(F.col("aa") == a, F.col("frac"))), F.lit(0.0)).alias(f"aa_{a}") for a in AMINO])
    names = [c for c in numbers.columns if c != "entry"]
    out = entries.select("entry").join(numbers, "entry", "left").join(letters, "entry", "left")
    has = F.col("n_pockets").isNotNull()
    cells = [F.coalesce(F.col(c), F.lit(0.0)) for c in names] + [F.when(has, F.coalesce(F.col(f"aa_{a}"), F.lit(0.0))).otherwise(0.0) for a in AMINO]
    return out.select("entry", F.array(*cells).alias("features"))
