"""Exact dedup of a batch against an immutable snapshot.

Static binary-fuse filters, one for each shard of the snapshot's digests, screen the
distinct digests of the incoming batch. A filter has no false negatives: digests that it
rejects are new and never meet the snapshot, the few that pass are joined with the
snapshot's exact buckets. Duplicates inside the new batch are grouped on their own. All
texts of a class with more than one row are then compared byte by byte, grouped with
map-side combining, so that a class of any size ships one text per map task.

Results for odd input: a null text is the empty text; a null id is smaller than any other;
of repeated rows that share the largest id exactly one is kept; empty tables give no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protolens.llm._util import BROADCAST_ROWS, bounded, shared_dir, spare, stage, table, text_of

#: Distinct snapshot digests of one filter, on average; a filter takes about 1.2 MB.
SHARD_KEYS = 1 << 19
#: Rows of a class that is joined by broadcast, if there are too many classes for that.
HOT = 10_000
#: Bits of a fingerprint; false positives: about 2 ** -16.
_FP = np.uint16


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class FuseFilter:
    """A 3-wise binary-fuse filter over 64-bit keys with 16-bit fingerprints."""

    def __init__(self, seed: int, segment: int, segments: int, slots: np.ndarray):
        self.seed, self.segment, self.segments, self.slots = seed, segment, segments, slots

    @staticmethod
    def _places(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        base = first * np.uint64(segment)
        a = base + (h & mask)
        b = base + np.uint64(segment) + ((h >> np.uint64(18)) & mask)
        c = base + np.uint64(2 * segment) + ((h >> np.uint64(9)) & mask)
        return np.stack([a, b, c]).astype(np.int64)

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(32))).astype(_FP)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 4 if n < 8 else min(1 << int(np.floor(np.log(n) / np.log(3.33) + 2.25)), 1 << 18)
        grow = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        segments = max(1, int(np.ceil(n * grow / segment)) - 2)
        for seed in range(1, 200):
            h = _mix(keys, seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            made = cls._peel(h, segment, segments + (seed - 1) // 8)
            if made is not None:
                return cls(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1, segment, segments + (seed - 1) // 8, made)
        raise RuntimeError("no binary-fuse filter was found")

    @classmethod
    def _peel(cls, h: np.ndarray, segment: int, segments: int) -> np.ndarray | None:
        places, size = cls._places(h, segment, segments), (segments + 2) * segment
        count = np.bincount(places.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        numbers = np.arange(len(h))
        for row in places:
            np.bitwise_xor.at(owner, row, numbers)
        rounds, alone = [], np.flatnonzero(count == 1)
        while len(alone):
            who, at = np.unique(owner[alone], return_index=True)
            rounds.append((who, alone[at]))
            touched = places[:, who]
            np.subtract.at(count, touched.ravel(), 1)
            np.bitwise_xor.at(owner, touched.ravel(), np.tile(who, 3))
            near = np.unique(touched)
            alone = near[count[near] == 1]
        if sum(len(w) for w, _ in rounds) < len(h):
            return None
        slots, prints = np.zeros(size, _FP), cls._print(h)
        for who, at in reversed(rounds):
            slots[at] = 0
            others = np.bitwise_xor.reduce(slots[places[:, who]], axis=0)
            slots[at] = prints[who] ^ others
        return slots

    def has(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(keys.astype(np.uint64), self.seed)
        found = np.bitwise_xor.reduce(self.slots[self._places(h, self.segment, self.segments)], axis=0)
        return found == self._print(h)


def digests(rows: DataFrame, id_col: str, text_col: str, snapshot_col: str) -> DataFrame:
    """One narrow row for each document: no text, so later shuffles stay small."""
    return rows.select(
        F.col(id_col).cast("long").alias("id"),
        F.unhex(F.sha2(text_of(text_col), 256)).alias("sha"),
        F.coalesce(F.col(snapshot_col), F.lit(False)).alias("old"),
        F.monotonically_increasing_id().alias("rid"),
    ).withColumn("key", F.conv(F.hex(F.substring("sha", 1, 8)), 16, -10).cast("long"))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    made = FuseFilter.build(pdf["key"].to_numpy(np.int64).view(np.uint64))
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1].to_numpy(), "seed": [np.uint64(made.seed).view(np.int64)], "segment": [made.segment], "segments": [made.segments], "slots": [made.slots.tobytes()]})


def build_filters(snapshot_digests: DataFrame, shards: int) -> DataFrame:
    """The filters of a snapshot (shard, seed, segment, segments, slots); ``snapshot_digests``
    has the 64-bit ``key`` of each class."""
    keys = snapshot_digests.select(F.pmod("key", F.lit(shards)).alias("shard"), "key")
    return keys.groupBy("shard").applyInPandas(_build, "shard long, seed long, segment long, segments long, slots binary")


def _screen(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    if right.empty or left.empty:
        return left[["sha"]].iloc[:0]
    f = right.iloc[0]
    made = FuseFilter(int(np.int64(f["seed"]).view(np.uint64)), int(f["segment"]), int(f["segments"]), np.frombuffer(f["slots"], _FP))
    return left.loc[made.has(left["key"].to_numpy(np.int64).view(np.uint64)), ["sha"]]


def snapshot_filters(snapshot_digests: DataFrame, folder: str | None = None) -> tuple[DataFrame, int]:
    """(filters, number of shards) of an immutable snapshot.

    They are written once, to a folder named by the snapshot's keys under ``folder`` (or the
    shared folder of this run), and read from there for every later batch.
    """
    spark = snapshot_digests.sparkSession
    keys, mark = snapshot_digests.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("key").cast("decimal(38,0)")), F.lit(0))).first()
    shards = max(1, -(-keys // SHARD_KEYS))
    path = f"{folder or shared_dir(spark) + '/protolens'}/fuse-{keys}-{int(mark) % (1 << 64):016x}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build_filters(snapshot_digests, shards).write.mode("overwrite").parquet(path)
    return spark.read.schema("shard long, seed long, segment long, segments long, slots binary").parquet(path), shards


def screen(batch_digests: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The distinct batch digests that may be in the snapshot.

    A batch that is larger than the snapshot meets each filter in several parts, so that no
    task holds more than about SHARD_KEYS digests.
    """
    parts = max(1, -(-batch_digests.count() // (shards * SHARD_KEYS)))
    keyed = batch_digests.select("sha", "key", F.pmod("key", F.lit(shards)).alias("shard"), F.pmod(F.xxhash64("sha"), F.lit(parts)).alias("part"))
    each = filters.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return keyed.groupBy("shard", "part").cogroup(each.groupBy("shard", "part")).applyInPandas(_screen, "sha binary")


def _with_classes(d: DataFrame, classes: DataFrame) -> DataFrame:
    """Each row with its class, if it has one. Beyond what may be broadcast, classes of very many
    rows are still joined by broadcast, so that no task gets all rows of one digest."""
    classes = stage(classes, "judged")
    n = classes.count()
    if n <= BROADCAST_ROWS:
        return d.join(F.broadcast(classes), "sha", "left")
    hot, cold = classes.where(F.col("n") > HOT), classes.where(F.col("n") <= HOT)
    rest = d.join(bounded(hot.select("sha")), "sha", "left_anti").join(cold, "sha", "left")
    return d.join(bounded(hot), "sha").unionByName(rest)


def exact_dedup(rows: DataFrame, snapshot_col: str, id_col: str = "doc_id", text_col: str = "text", filters: str | None = None) -> DataFrame:
    """Classes of equal texts over a snapshot (``snapshot_col`` true) and a new batch.

    Returns (id, keep_id, group_size, kept, seen, sha): ``seen`` marks batch rows whose text
    the snapshot has. ``filters`` is a folder that keeps the snapshot's filters between runs.
    """
    d = stage(digests(rows, id_col, text_col, snapshot_col), "digests")
    best = F.max(F.struct("id", (-F.col("rid")).alias("nrid")))
    old = d.where("old").groupBy("sha", "key").agg(F.count("*").alias("n"), best.alias("best"))
    new = d.where("not old").groupBy("sha", "key").agg(F.count("*").alias("n"), best.alias("best"))
    old = stage(old, "snapshot")
    new = stage(new, "batch")
    maybe = screen(new, *snapshot_filters(old, filters))
    both = maybe.join(new, "sha").join(old.select("sha", F.col("n").alias("n0"), F.col("best").alias("best0")), "sha")
    seen = both.select("sha", "key", (F.col("n") + F.col("n0")).alias("n"), F.greatest("best", "best0").alias("best"), F.lit(True).alias("seen"))
    seen = stage(seen, "seen")
    apart = new.unionByName(old).where("n > 1").join(seen.select("sha"), "sha", "left_anti").withColumn("seen", F.lit(False))
    classes = stage(seen.unionByName(apart), "classes")
    texts = _byte_check(rows, classes, text_col)
    classes = classes.join(texts, "sha", "left").select(
        "sha", "seen", F.col("best.id").alias("keep_id"), (-F.col("best.nrid")).alias("keep_rid"),
        F.when((F.col("texts") == 1) & (F.col("n_bytes_equal") == F.col("n")), F.col("n")).otherwise(F.raise_error(F.lit("texts that differ share a SHA-256 digest")).cast("long")).alias("n"),
    )
    joined = _with_classes(d, classes)
    return joined.select(
        "id",
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("rid") == F.col("keep_rid"), F.lit(True)).alias("kept"),
        (F.coalesce("seen", F.lit(False)) & ~F.col("old")).alias("seen"),
        F.lower(F.hex("sha")).alias("sha"),
    )


def _byte_check(rows: DataFrame, classes: DataFrame, text_col: str) -> DataFrame:
    """For each class the number of different texts and of rows, comparing whole texts."""
    wanted = classes.select("sha")
    full = rows.select(text_of(text_col).alias("t"), F.unhex(F.sha2(text_of(text_col), 256)).alias("sha"))
    full = full.join(bounded(wanted), "sha", "left_semi")
    return full.groupBy("sha", "t").agg(F.count("*").alias("c")).groupBy("sha").agg(F.count("*").alias("texts"), F.sum("c").alias("n_bytes_equal"))


def arrival(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents split by a hash of the id into a snapshot and the batch that follows it."""
    return docs.withColumn("_old", F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(2)) == 0)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(arrival(table(spark, sf_dir, "documents").select("doc_id", "text")), "_old")
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def dedup_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without its duplicates, all columns kept; for pipelines.

    The narrow result is joined back by id; ids that occur more than once with the same text
    keep one row.
    """
    sha, keep_id, many = (spare(docs, f"dedup_{n}") for n in ("sha", "keep", "many"))
    marked = docs.withColumn(sha, F.unhex(F.sha2(text_of(), 256)))
    found = exact_dedup(arrival(docs.select("doc_id", "text")), "_old").where("group_size > 1 and kept")
    keep = stage(found.select(F.unhex("sha").alias(sha), F.col("id").alias(keep_id), F.lit(True).alias(many)), "keepers")
    out = marked.join(bounded(keep), sha, "left")
    single = out.where(F.col(many).isNull())
    chosen = out.where(F.col(many) & F.col("doc_id").eqNullSafe(F.col(keep_id))).dropDuplicates(["doc_id", sha])
    return single.unionByName(chosen).drop(sha, keep_id, many)
