"""Shared helpers: the shared staging folder, plan cutting and null-safe text."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and holds no more rows than this.
BROADCAST_ROWS = 500_000

#: Rows of an Arrow batch of whole texts.
TEXT_ROWS = 1_024

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint directory). Only a
    session with a local master, where one machine is the cluster, may fall back to a
    temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="protolens-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs start from the files.

    The shuffle files of the writing job are released when it ends, so the disk that a
    multi-phase operator needs is the largest phase and not the sum of all of them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/protolens/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for frame in frames:
        for file in frame.inputFiles():
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose whole texts are about to go to Python: rows travel in batches of a number of
    rows, whatever their size, and are held by both sides. The session's limit is lowered to
    TEXT_ROWS where it is higher; it stays, as the plan may run at any later time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= TEXT_ROWS:
        df.sparkSession.conf.set(name, str(TEXT_ROWS))
    return df


def bounded(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows stay within ``limit``, else unchanged,
    which leaves a shuffled join that adaptive execution can split."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df


def text_of(column: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
