"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source, documents are range-partitioned by
the leading bits of that key into blocks of about ``BLOCK_ROWS`` rows; block sums give each
block its offset, a running sum inside the block completes the prefix sum of sizes. A
source's budget is cut at exactly its number of words: whole epochs first, then the
documents in key order until the rest is used, the last of them in part. No block holds more
than a bounded share of a source, so a hot source needs no task of its own.

Only DataFrame operations run here. Results for odd input: a null text has size 0 and is
never taken; a null source is a source of its own, sorted last; repeated rows tie, and each
takes its own place in the order; a source without words gets target 0; empty tables give no
rows; other columns are ignored (``mix_documents`` keeps those of its input).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from protolens.llm._util import bounded, spare, stage, table, text_of

WEIGHTS, SHARE, MAX_EPOCHS, SEED = (5.0, 2.0, 1.0), 1.5, 2, "mix-1"
#: Rows of a block on average; at least two blocks and at most 2 ** 24 for each source.
BLOCK_ROWS = 65_536


def words(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def keyed(docs: DataFrame, seed: str = SEED, size: str = "size", key: str = "key") -> DataFrame:
    """``docs`` with size and hash-random key under these names."""
    return docs.withColumns({
        size: words(text_of()),
        key: F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
    })


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """Water filling over (source, source_size, n): adds weight, target, budget, epochs, rest.

    Sources whose weight gives them more than ``epochs`` times their size stop there; sorted
    by the level at which that happens, one running sum finds the level of all others.
    The table has one row for each source, so its global order is small.
    """
    by_name, level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("stop", "sid")
    before, all_rows = level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = sources.withColumn("sid", F.row_number().over(by_name).cast("long"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(epochs))).withColumn("stop", F.col("cap") / F.col("weight"))
    s = s.withColumn("level", (F.sum("source_size").over(all_rows) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("stop"), F.col("level"))).over(all_rows))
    s = s.withColumn("target", F.when(F.col("stop") < F.col("level"), F.col("cap")).otherwise(F.col("weight") * F.col("level")))
    s = s.withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))
    s = s.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long"))
    bits = F.least(F.lit(24), F.greatest(F.lit(1), F.ceil(F.log2(F.col("n") / F.lit(float(BLOCK_ROWS)))))).cast("int")
    return s.select("sid", "source", "source_size", "n", "target", "budget", "epochs", (F.col("budget") - F.col("epochs") * F.col("source_size")).alias("rest"), bits.alias("bits"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): for each document its size, source's size and target and the words
    taken; for each source its budget and, as ``cut``, the document in which the last epoch ends."""
    base = stage(keyed(docs.select("doc_id", "source", "text"), seed).select("doc_id", "source", "size", "key"), "mix-sizes")
    sums = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    src = stage(targets(sums, weights, share, epochs), "mix-sources")
    rows = base.alias("b").join(bounded(src).alias("s"), F.expr("b.source <=> s.source"))
    rows = rows.select("doc_id", "size", "key", "s.sid", "source_size", "target", "epochs", "rest", F.expr("conv(substr(key, 1, 8), 16, 10)::bigint >> (32 - bits)").alias("block"))
    sums = rows.groupBy("sid", "block").agg(F.sum("size").alias("in_block"))
    ahead = Window.partitionBy("sid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "block", F.coalesce(F.sum("in_block").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("sid", "block").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["sid", "block"])
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("offset") - F.col("ahead")))
    rows = rows.withColumn("part", part.cast("long")).withColumn("taken", (F.col("epochs") * F.col("size") + F.col("part")).cast("long"))
    return rows, src


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source
), s1 AS (
  SELECT *, [5.0, 2.0, 1.0][((sid - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s0
), s2 AS (
  SELECT *, cap / weight AS stop,
    ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS lv FROM s1
), s3 AS (
  SELECT *, max(CASE WHEN lv <= stop THEN lv END) OVER () AS level FROM s2
), s4 AS (
  SELECT *, CASE WHEN stop < level THEN cap ELSE weight * level END AS target FROM s3
), s AS (
  SELECT *, floor(target + 0.5)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM s4
), r AS (
  SELECT doc_id, size, source_size, target, epochs, budget - epochs * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY s.sid ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, size, source_size, target::DOUBLE AS target, (epochs * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken FROM r
"""


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``docs`` as the mix takes them: each row once for each whole or at least half copy taken.

    A document's place is known from its source's cut alone, so the texts are not shuffled.
    Documents of no words hold nothing to take and are left out.
    """
    rows, src = mix(docs, weights, share, epochs, seed)
    place = F.struct("key", "doc_id", "size")
    last = rows.where("part > 0 and 2 * part >= size").groupBy("sid").agg(F.max(place).alias("cut"))
    plan = stage(src.select("sid", "source", "epochs").join(last, "sid", "left"), "mix-cuts")
    size, key, copies, copy = (spare(docs, f"mix_{n}") for n in ("size", "key", "copies", "copy"))
    own = F.struct(F.col(f"d.{key}").alias("key"), F.col("d.doc_id").alias("doc_id"), F.col(f"d.{size}").alias("size"))
    taken = keyed(docs, seed, size, key).alias("d").join(bounded(plan).alias("s"), F.expr("d.source <=> s.source"))
    times = F.col("s.epochs") + F.when(F.col("s.cut").isNotNull() & (own <= F.col("s.cut")), F.lit(1)).otherwise(F.lit(0))
    taken = taken.where(F.col(f"d.{size}") > 0).withColumn(copies, times).where(F.col(copies) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*[F.col(f"d.`{c}`") for c in docs.columns])
