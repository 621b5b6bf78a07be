"""Calls that leave the engine: embedding models and search programs of the caller.

Neither weights nor programs are part of this library. A caller gives a function that loads
its model or opens its program; it runs once for each task, next to the rows of that task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolens.functions.vector import mean_vectors

BATCH = 64


def embedded(rows: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "sequence", batch: int = BATCH) -> DataFrame:
    """(entry, features): a vector for each text, ``batch`` texts a call; a null text is empty."""

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                own = pdf.iloc[at : at + batch]
                x = np.asarray(model(own[text].fillna("").tolist()), float)
                yield pd.DataFrame({"entry": own["entry"], "features": list(x)})

    return rows.select("entry", text).mapInPandas(over, "entry string, features array<double>")


def searched(rows: DataFrame, load: Callable[[], Callable[[list[tuple[str, str]]], list[tuple]]], schema: str, text: str = "sequence", batch: int = BATCH) -> DataFrame:
    """Hits of each (entry, text) as the caller's program finds them, in rows of ``schema``."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = load()
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                own = pdf.iloc[at : at + batch]
                yield pd.DataFrame(search(list(zip(own["entry"], own[text].fillna(""), strict=True))), columns=names)

    return rows.select("entry", text).mapInPandas(over, schema)


def pooled(tokens: DataFrame, vector: str = "features") -> DataFrame:
    """(entry, features): the mean of an entry's token vectors (entry, i, vector) without its first
    and last token, which mark start and end. Entries of two tokens or fewer have no row."""
    ends = tokens.groupBy("entry").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    inner = tokens.join(ends, "entry").where("i > first and i < last")
    return mean_vectors(inner.select("entry", F.col(vector).alias("features")), ["entry"], "features")
