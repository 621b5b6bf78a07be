"""Functions of residue strings, as column expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protolens.schemas import AMINO, AROMATIC, HYDROPATHY

DIPEPTIDES = [a + b for a in AMINO for b in AMINO]


def clean(seq: Column, limit: int | None = None, ascii_only: bool = False) -> Column:
    """Letters only, upper case, cut to ``limit``; null stays null."""
    if ascii_only:
        out = F.upper(F.regexp_replace(seq, "[^A-Za-z]", ""))
    else:
        out = F.upper(F.replace(F.regexp_replace(seq, r"[^\p{L}]", ""), F.lit("ß"), F.lit("SS")))
    return out if limit is None else F.substring(out, 1, limit)


def count_letter(seq: Column, letter: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(letter), F.lit("")))


def composition(seq: Column) -> Column:
    """Share of each standard residue among all letters; zeros for an empty string."""
    n = F.length(seq)
    return F.when(n > 0, F.array(*[count_letter(seq, a) / n for a in AMINO])).otherwise(F.array_repeat(F.lit(0.0), len(AMINO)))


def kmers(seq: Column, k: int) -> Column:
    """All overlapping k-mers in order, with repeats."""
    return F.when(F.length(seq) >= k, F.regexp_extract_all(seq, F.lit(f"(?=(.{{{k}}}))"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def kmer_set(seq: Column, k: int) -> Column:
    return F.array_distinct(kmers(seq, k))


def hydropathy(seq: Column) -> tuple[Column, Column]:
    """(mean, population deviation); unknown letters count as 0.

    Letters are counted once each, so the cost is one pass for each standard residue.
    """
    n = F.length(seq)
    total = sum((count_letter(seq, a) * v for a, v in HYDROPATHY.items()), F.lit(0.0))
    square = sum((count_letter(seq, a) * (v * v) for a, v in HYDROPATHY.items()), F.lit(0.0))
    mean = total / n
    return F.when(n > 0, mean).otherwise(0.0), F.when(n > 0, F.sqrt(F.greatest(F.lit(0.0), square / n - mean * mean))).otherwise(0.0)


def physico(seq: Column) -> Column:
    """log1p of the length, hydropathy mean and deviation, aromatic share."""
    mean, std = hydropathy(seq)
    n = F.length(seq)
    aromatic = sum((count_letter(seq, a) for a in AROMATIC), F.lit(0))
    return F.array(F.when(n > 0, F.log1p(n.cast("double"))).otherwise(0.0), mean, std, F.when(n > 0, aromatic / n).otherwise(0.0))


def by_repeats(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(rows of keys that stand in one row, rows of others): the first need no shuffle to be
    counted by key. Keys are counted here; without repeated ones there is no second table."""
    from protolens.sources.files import kept  # that module reads names with this one's functions

    repeated = kept(df.groupBy(*keys).count().where("count > 1").select(*keys), "repeated")
    if repeated.isEmpty():
        return df, None
    same = reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys])
    return df.alias("a").join(repeated.alias("b"), same, "left_anti"), df.alias("a").join(repeated.alias("b"), same, "left_semi")


def _dipeptide_counts(texts: pd.Series) -> pd.Series:
    code = np.full(256, -1)
    code[np.frombuffer(AMINO.encode(), np.uint8)] = np.arange(len(AMINO))
    out = []
    for text in texts:
        at = code[np.frombuffer((text or "").encode("ascii", "replace"), np.uint8)]
        both = (at[:-1] >= 0) & (at[1:] >= 0)
        pair, n = np.unique((at[:-1] * 20 + at[1:])[both], return_counts=True)
        out.append([{"at": int(p), "n": int(m)} for p, m in zip(pair, n, strict=True)])
    return pd.Series(out)


def dipeptides(df: DataFrame, seq: str, keys: list[str]) -> DataFrame:
    """(keys, dipeptide, freq) of the standard dipeptides that occur; others stay in the
    denominator. Each row is counted where it lies; only repeated keys are shuffled."""
    count = F.pandas_udf(_dipeptide_counts, "array<struct<at:int,n:long>>")
    name = F.element_at(F.lit(DIPEPTIDES), F.col("d.at") + 1).alias("dipeptide")
    counted = lambda t: t.select(*keys, F.length(seq).alias("n"), F.explode(count(F.col(seq))).alias("d")).select(*keys, name, F.col("d.n").alias("c"), "n")
    one, more = by_repeats(df, keys)
    out = counted(one).select(*keys, "dipeptide", (F.col("c") / (F.col("n") - 1)).alias("freq"))
    return out if more is None else out.unionByName(counted(more).groupBy(*keys, "dipeptide").agg((F.sum("c") / (F.first("n") - 1)).alias("freq")))


def feature_names() -> list[tuple[str, str]]:
    """(column, group) of the 424 sequence features in order."""
    return [(f"aa_{a}", "aa") for a in AMINO] + [(f"dipep_{d}", "dipep") for d in DIPEPTIDES] + [(c, "physico") for c in ("seq_log_len", "seq_mean_kd", "seq_std_kd", "seq_arom_frac")]


def _vector(texts: pd.Series) -> pd.Series:
    code = np.full(256, -1)
    code[np.frombuffer(AMINO.encode(), np.uint8)] = np.arange(len(AMINO))
    kd = np.array([HYDROPATHY[a] for a in AMINO] + [0.0])
    aromatic = np.array([a in AROMATIC for a in AMINO] + [False])
    out = []
    for text in texts:
        v = np.zeros(424)
        if text:
            at = code[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
            n = len(at)
            v[:20] = np.bincount(at[at >= 0], minlength=20) / n
            if n > 1:
                both = (at[:-1] >= 0) & (at[1:] >= 0)
                v[20:420] = np.bincount((at[:-1] * 20 + at[1:])[both], minlength=400) / (n - 1)
            v[420:] = np.log1p(n), kd[at].mean(), kd[at].std(), aromatic[at].mean()
        out.append(v)
    return pd.Series(out)


def sequence_features(seq: Column) -> Column:
    """The 424 features of a cleaned string as one array: histograms in Arrow batches, no shuffle."""
    return F.pandas_udf(_vector, "array<double>")(seq)


def model_input(seq: Column, mode: str) -> Column:
    """Input string of a sequence (``aa``) or 3Di language model: letters only and spaced,
    rare residues to X, the mode's prefix in front."""
    letters = F.regexp_replace(seq, r"[^\p{L}]", "")
    s, prefix = (F.regexp_replace(F.upper(letters), "[UZOB]", "X"), "<AA2fold>") if mode == "aa" else (F.lower(letters), "<fold2AA>")
    return F.concat(F.lit(prefix + " "), F.rtrim(F.regexp_replace(s, "(.)", "$1 ")))


def stem(path: Column) -> Column:
    """File name without its last suffix and without ``.pdb``."""
    name = F.element_at(F.split(path, "[/\\\\]"), -1)
    return F.replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit(".pdb"), F.lit(""))


def model_slug(name: Column) -> Column:
    return F.replace(F.element_at(F.split(name, "/"), -1), F.lit("_UR50D"), F.lit(""))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))
