"""Spatial joins over residues (entry, i, x, y, z, b, and letters), by grid cells.

Pairs within a distance are found with an equi-join on cells of that width: one side is
copied to the 27 cells around it. A protein's residues therefore meet only their
neighbourhood, whatever the protein's length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protolens.operators.retrieval import best_residues

#: Separations and distances of pairs, triples and contacts.
PAIR_GAP, PAIR_DIST = 6, 9.0
TRIPLE_GAP, TRIPLE_DIST, TRIPLE_TOP = 6, 10.0, 50
CONTACT_GAP, CONTACT_DIST, CYS_DIST, MEDIUM, LONG = 2, 8.0, 7.0, 6, 12


def _gap(a: str, b: str) -> Column:
    square = lambda c: (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}"))
    return F.sqrt(square("x") + square("y") + square("z"))


def near_pairs(residues: DataFrame, min_gap: int, max_dist: float, strict: bool = False) -> DataFrame:
    """(entry, a, b, dist): residue structs i < j at least ``min_gap`` apart in sequence and
    within ``max_dist`` in space (``strict``: closer than it)."""
    cell = lambda c: F.floor(F.col(c) / F.lit(max_dist))
    own = [c for c in residues.columns if c != "entry"]
    base = residues.select("entry", F.struct(*own).alias("r"), cell("x").alias("cx"), cell("y").alias("cy"), cell("z").alias("cz"))
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    right = base
    for c in ("cx", "cy", "cz"):
        right = right.withColumn("d", F.explode(steps)).withColumn(c, F.col(c) + F.col("d")).drop("d")
    pairs = base.withColumnRenamed("r", "a").join(right.withColumnRenamed("r", "b"), ["entry", "cx", "cy", "cz"])
    pairs = pairs.where(F.col("b.i") - F.col("a.i") >= min_gap).withColumn("dist", _gap("a", "b"))
    return pairs.where(F.col("dist") < max_dist if strict else F.col("dist") <= max_dist).select("entry", "a", "b", "dist")


def _joined(*letters: Column) -> Column:
    return F.array_join(F.array_sort(F.array(*letters)), ",")


def pair_counts(residues: DataFrame, letter: str = "letter", min_gap: int = PAIR_GAP, max_dist: float = PAIR_DIST) -> DataFrame:
    """(entry, motif, n): sorted letter pairs of near residues with their number."""
    p = near_pairs(residues, min_gap, max_dist)
    return p.groupBy("entry", _joined(F.col(f"a.{letter}"), F.col(f"b.{letter}")).alias("motif")).agg(F.count("*").alias("n"))


def pair_motifs(residues: DataFrame, letter: str = "letter", min_gap: int = PAIR_GAP, max_dist: float = PAIR_DIST) -> DataFrame:
    """(entry, motif): each sorted letter pair once."""
    return pair_counts(residues, letter, min_gap, max_dist).select("entry", "motif")


def triple_motifs(residues: DataFrame, letter: str = "letter", min_gap: int = TRIPLE_GAP, max_dist: float = TRIPLE_DIST, top: int | None = TRIPLE_TOP) -> DataFrame:
    """(entry, motif): sorted letter triples i < j < k, all apart and near, among the ``top``
    residues of highest confidence: the table of near pairs joined with itself at j, closed by
    the pair i, k."""
    p = near_pairs(best_residues(residues, top) if top else residues, min_gap, max_dist)
    p = p.select("entry", F.col("a.i").alias("i"), F.col(f"a.{letter}").alias("li"), F.col("b.i").alias("j"), F.col(f"b.{letter}").alias("lj"))
    second = p.select("entry", F.col("i").alias("j"), F.col("j").alias("k"), F.col("lj").alias("lk"))
    closing = p.select("entry", "i", F.col("j").alias("k"))
    t = p.join(second, ["entry", "j"]).join(closing, ["entry", "i", "k"], "left_semi")
    return t.select("entry", _joined(F.col("li"), F.col("lj"), F.col("lk")).alias("motif")).distinct()


def joint_letters(aa: Column, di: Column) -> Column:
    """One token of a residue and its structural letter."""
    return F.concat(aa, di)


def with_letters(residues: DataFrame, strings: DataFrame, at_least: int = 0) -> DataFrame:
    """Residues with the letter at their place of a string (entry, di); entries are cut to the
    shorter of both and left out if fewer than ``at_least`` remain."""
    out = residues.join(strings.select("entry", "di"), "entry").where(F.col("i") < F.length("di"))
    out = out.withColumn("letter", F.expr("substring(di, cast(i + 1 as int), 1)")).drop("di")
    if not at_least:
        return out
    enough = out.groupBy("entry").count().where(F.col("count") >= at_least)
    return out.join(enough.select("entry"), "entry", "left_semi")


#: Names of the contact statistics in order.
CONTACT_COLUMNS = ["contact_density", "contact_lr_per_res", "contact_mean_dist", "contact_median_dist", "contact_short_frac", "contact_medium_frac", "contact_long_frac", "contact_mean_seq_sep", "contact_max_seq_sep_per_n", "contact_cys_pairs_per_res", "contact_clustering", "contact_radius_per_n"]


def farthest(residues: DataFrame) -> DataFrame:
    """(entry, max_dist): the greatest distance of two residues of an entry.

    An entry is one protein: its points meet in one task, in slices of 512 against all.
    """
    lists = residues.groupBy("entry").agg(F.collect_list(F.struct("x", "y", "z")).alias("p"))
    return lists.select("entry", F.pandas_udf(_diameter_of, "double")("p").alias("max_dist"))


def _diameter_of(points: pd.Series) -> pd.Series:
    out = []
    for own in points:
        p = np.array([(q["x"], q["y"], q["z"]) for q in own], float).reshape(-1, 3)
        best = 0.0
        for at in range(0, len(p), 512):
            d = ((p[at : at + 512, None, :] - p[None, :, :]) ** 2).sum(-1)
            best = max(best, float(d.max()) if d.size else 0.0)
        out.append(best**0.5)
    return pd.Series(out)


def contact_stats(residues: DataFrame, letter: str = "aa") -> DataFrame:
    """(entry, 12 statistics): contacts are residues two or more apart in sequence and closer
    than CONTACT_DIST but not in one place; entries without contacts get zeros."""
    n = residues.groupBy("entry").agg(F.count("*").alias("n"))
    near = near_pairs(residues, 1, CONTACT_DIST, strict=True)
    sep = F.col("b.i") - F.col("a.i")
    rows = near.select("entry", sep.alias("sep"), "dist", ((F.col(f"a.{letter}") == "C") & (F.col(f"b.{letter}") == "C") & (F.col("dist") < CYS_DIST)).alias("cys"))
    contact = (F.col("sep") >= CONTACT_GAP) & (F.col("dist") > 0)
    when = lambda c, v: F.when(c, v)
    sums = rows.groupBy("entry").agg(
        F.count_if(contact).alias("c"), F.count_if(contact & (F.col("sep") < MEDIUM)).alias("c_short"), F.count_if(contact & (F.col("sep") >= MEDIUM) & (F.col("sep") < LONG)).alias("c_medium"), F.count_if(contact & (F.col("sep") >= LONG)).alias("c_long"),
        F.avg(when(contact, F.col("dist"))).alias("mean_dist"), F.percentile(when(contact, F.col("dist")), F.lit(0.5)).alias("median_dist"), F.avg(when(contact, F.col("sep"))).alias("mean_sep"), F.max(when(contact, F.col("sep"))).alias("max_sep"),
        F.count_if("cys").alias("cys"), F.count_if(F.col("dist") > 0).alias("near"),
    )
    t = n.join(sums, "entry", "left").join(farthest(residues), "entry", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    each = F.greatest(z("c"), F.lit(1.0))
    values = [z("c") / F.col("n"), z("c_long") / F.col("n"), z("mean_dist"), z("median_dist"), z("c_short") / each, z("c_medium") / each, z("c_long") / each, z("mean_sep"), z("max_sep") / F.sqrt("n"), z("cys") / F.col("n"), 2 * z("near") / (F.col("n") * F.greatest(F.col("n") - 1, F.lit(1))), z("max_dist") / F.sqrt("n")]
    return t.select("entry", "n", *[v.alias(c) for v, c in zip(values, CONTACT_COLUMNS, strict=True)])
