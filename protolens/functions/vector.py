"""Functions of dense vectors held as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda would compute it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    return _once(a, lambda v: _once(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))))


def cosine(a: Column, b: Column) -> Column:
    return dot(l2_normalize(a), l2_normalize(b))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def concat_blocks(*blocks: Column, normalize: bool = True) -> Column:
    """Vectors side by side, each of unit length first unless told otherwise."""
    return F.concat(*[l2_normalize(b) if normalize else b for b in blocks])


def keep_ordinals(a: Column, ordinals: list[int]) -> Column:
    """The entries at 0-based ordinals, in their order; a shorter vector gives those it has. Runs of
    ordinals are slices."""
    starts = [i for i, o in enumerate(ordinals) if not i or o != ordinals[i - 1] + 1]
    ends = [*starts[1:], len(ordinals)]
    return F.concat(*[F.slice(a, ordinals[s] + 1, e - s) for s, e in zip(starts, ends, strict=True)]) if starts else F.slice(a, 1, 0)


def slice_range(a: Column, start: int, stop: int) -> Column:
    return F.slice(a, start + 1, stop - start)


def group_ordinals(columns: list[tuple[str, str]], keep: str | None = None, drop: str | None = None) -> list[int]:
    """Ordinals of a feature dictionary (column, group): one group, all but one, or all."""
    return [i for i, (_, g) in enumerate(columns) if (keep is None or g == keep) and (drop is None or g != drop)]


def positions(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Long form: (keys, pos, value)."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "value"))


def mean_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean vector of each key. Each position is summed map-side, so a class of any size
    ships one row for each position and task."""
    long = positions(df, keys, vector).groupBy(*keys, "pos").agg(F.avg("value").alias("value"))
    return long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias(vector))


def scaling(train: DataFrame, vector: str) -> tuple[list[float], list[float]]:
    """(means, population deviations) of each position; deviations of 0 become 1. One row for
    each position reaches the driver."""
    rows = positions(train, [], vector).groupBy("pos").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).orderBy("pos").collect()
    return [r["m"] for r in rows], [r["s"] if r["s"] else 1.0 for r in rows]


def standardize(a: Column, means: list[float], deviations: list[float], with_mean: bool = True) -> Column:
    pairs = F.arrays_zip(a.alias("x"), F.lit(means).alias("m"), F.lit(deviations).alias("s"))
    return F.transform(pairs, lambda p: ((p["x"] - p["m"]) if with_mean else p["x"]) / p["s"])
