"""Calls that fetch something for each row, with a log of what is done.

The log is a table in the shared folder: a row for each key with its status. Keys that the log
has as done are met by an anti-join and not called again; the rest are dealt into waves, and each
wave appends to the log when it ends. A run that is cut off so loses one wave at most, and the
next run goes on from there. A call that fails is tried again; one that keeps failing goes to the
side table of bad rows with its error, and is called again by the next run.

Statuses: ``ok`` (fetched now), ``exists`` (an earlier run has it), ``no_entry`` (the call returned
nothing or raised LookupError; not asked for again) and ``error:<name of the error>``.

Results for odd input: repeated keys are called once, for one of their rows; rows with a null
key take no part; empty tables give no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DONE = ("ok", "no_entry")


class FetchLog:
    """Log and values of one source under a folder of the shared file system."""

    def __init__(self, spark: SparkSession, folder: str, value: str = "string"):
        self.spark, self.folder, self.value = spark, folder.rstrip("/"), value
        self.schema = f"key string, status string, value {value}, error string, run int"

    def rows(self) -> DataFrame:
        """Every attempt: (key, status, value, error, run)."""
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.folder)
        if not place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.folder)

    def latest(self) -> DataFrame:
        """(key, status, value, error, run): the last attempt of each key, what is done before all others."""
        order = F.struct(F.col("status").isin(*DONE).alias("done"), "run")
        return self.rows().groupBy("key").agg(F.max_by(F.struct("status", "value", "error", "run"), order).alias("r")).select("key", "r.*")

    def quarantine(self) -> DataFrame:
        """(key, error, run) of keys whose last attempt failed."""
        return self.latest().where(~F.col("status").isin(*DONE)).select("key", "error", "run")

    def fetch(self, rows: DataFrame, key: str, call: Callable[[dict], object], waves: int = 4, tries: int = 3, pause: float = 0.0, tasks: int | None = None) -> DataFrame:
        """Calls ``call`` with each row that is not done; (key, status) of all keys of ``rows``.

        ``call`` is given a dict of the row and returns the value. Calls of a wave run in
        ``tasks`` tasks, a call at a time in each.
        """
        done = self.latest().where(F.col("status").isin(*DONE)).select("key", F.when(F.col("status") == "ok", "exists").otherwise(F.col("status")).alias("before"))
        keyed = rows.where(F.col(key).isNotNull()).withColumn("_key", F.col(key).cast("string")).dropDuplicates(["_key"])
        todo = keyed.join(done.withColumnRenamed("key", "_key"), "_key", "left_anti")
        run = (self.rows().agg(F.max("run")).first()[0] or 0) + 1
        names = rows.columns
        n = tasks or rows.sparkSession.sparkContext.defaultParallelism

        def called(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for row in frame.to_dict("records"):
                    out.append((row.pop("_key"), *attempt(row), run))
                yield pd.DataFrame(out, columns=["key", "status", "value", "error", "run"])

        def attempt(row: dict) -> tuple:
            for left in range(tries - 1, -1, -1):
                try:
                    found = call(row)
                    return ("no_entry", None, None) if found is None else ("ok", found, None)
                except LookupError:
                    return "no_entry", None, None
                except Exception as error:  # any fault of the caller's function is a status
                    if not left:
                        return f"error:{type(error).__name__}", None, str(error)
                    time.sleep(pause)

        for wave in range(waves):
            own = todo.where(F.pmod(F.xxhash64("_key"), F.lit(waves)) == wave).select("_key", *names).repartition(n, "_key")
            own.mapInPandas(called, self.schema).write.mode("append").parquet(self.folder)
        now = self.latest().where(F.col("run") == run).select("key", "status")
        out = keyed.select(F.col("_key").alias("key")).join(now, "key", "left").join(done, "key", "left")
        return out.select("key", F.coalesce("status", "before").alias("status"))
