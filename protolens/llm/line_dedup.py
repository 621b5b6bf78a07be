"""Line dedup against levelled sorted runs of line hashes.

The store keeps runs: tables of (line hash, number of documents), bucketed and sorted by the
hash. A batch of documents first becomes a run of its own; it is anti-joined with all older
runs, which are read in buckets and so are not shuffled. What no run holds is fresh: those
lines get the batch's largest id as the document that keeps them. Then the batch's run is
added at level 0. ``FANOUT`` runs of a level are compacted to one of the next, so a batch meets
a number of runs that grows with the logarithm of the batches. Runs are merged by full outer
joins of their buckets, not by a union: Spark 4.1 takes a union of bucketed tables for one that
is still dealt by the hash, and then leaves some hashes in two rows.

Documents are dealt in batches of falling ids. So the batch in which a line is fresh holds its
largest document, which keeps it; the runs' sums say in how many documents it was found. Lines
of enough documents meet the lines of all documents again, and the places to drop go back to
the texts, which are cut between these places. Only DataFrame operations run here.

Results for odd input: a null text is one empty line; a null id is smaller than any other;
rows of one id count as one document and each is returned; repeated rows are decided alike;
empty tables give no rows; other columns are ignored (``without_repeats`` hands them on). Lines
are told apart by 128 bits of their key's digest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from protolens.llm._util import BROADCAST_ROWS, bounded, discard, shared_dir, spare, stage, table, text_of

MIN_CHARS, MIN_DOCS = 40, 5
#: Batches that the query deals documents in, and runs of a level that are compacted to one.
BATCHES, FANOUT = 6, 3
#: Fixed value: the white space that is stripped from a line's ends.
BLANKS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class LineRuns:
    """Sorted runs by level, in the shared folder; each is a bucketed table of (h, n)."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{shared_dir(self.spark)}/protolens/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        discard(self.spark, self.spark.table(name))
        self.spark.sql(f"DROP TABLE {name}")

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Takes a batch of (h, doc_id), each document's lines once; returns (h, keep) of the
        lines that no earlier batch had, ``keep`` being a struct of the largest doc_id."""
        name = self._write(lines.groupBy("h").agg(F.count("*").alias("n"), F.max(F.struct("doc_id")).alias("keep")))
        fresh = self.spark.table(name).select("h", "keep")
        for run in self.runs():
            fresh = fresh.join(run.hint("merge"), "h", "left_anti")
        fresh = stage(fresh, "line-fresh")
        self._put(0, name)
        return fresh

    def _put(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._write(self._summed([self.spark.table(n) for n in old])))
            for n in old:
                self._drop(n)

    @staticmethod
    def _summed(runs: list[DataFrame]) -> DataFrame:
        """Runs of equal buckets are merged side by side: each hash is once in a run."""
        every = runs[0].select("h", "n")
        for run in runs[1:]:
            every = every.join(run.select("h", F.col("n").alias("more")).hint("merge"), "h", "full")
            every = every.select("h", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))
        return every

    def found_in(self, at_least: int) -> DataFrame:
        """(h, n) of the lines of so many documents."""
        runs = self.runs()
        return self._summed(runs).where(F.col("n") >= at_least) if runs else self.spark.createDataFrame([], "h binary, n long")

    def close(self) -> None:
        for level in self.levels:
            for name in level:
                self._drop(name)
        self.levels = []


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), _UPPER, _UPPER.lower())


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, tag, i, h, first): the lines with keys long enough; ``tag`` tells texts of one
    id apart, ``first`` marks a row's first line of each key."""
    keys = F.transform(_lines(text_of()), lambda line, i: F.struct(line_key(line).alias("key"), i.alias("i")))
    keys = F.filter(keys, lambda k: F.char_length(k["key"]) >= min_chars)
    sorted_ = F.array_sort(F.transform(keys, lambda k: F.struct(F.unhex(F.md5(k["key"])).alias("h"), k["i"].alias("i"))))
    mark = lambda s: F.transform(s, lambda k, at: F.struct(k["h"].alias("h"), k["i"].alias("i"), ((at == 0) | (F.get(s, at - 1)["h"] != k["h"])).alias("first")))
    marked = F.flatten(F.transform(F.array(sorted_), mark))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("tag"), F.explode(marked).alias("k"))
    return rows.select("doc_id", "tag", "k.i", "k.h", "k.first")


def _once(lines: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """(h, doc_id), each line of a document once, also where several rows are one document."""
    rows = lines.where("first").select("h", "doc_id")
    if repeated is None:
        return rows
    same = F.expr("doc_id <=> again")
    return rows.join(repeated, same, "left_anti").unionByName(rows.join(repeated, same, "left_semi").distinct())


def _dealt(lines: DataFrame, bounds: list[int]) -> DataFrame:
    """With ``batch``: 0 for the largest ids, the last for the smallest and null."""
    above = F.size(F.filter(F.lit(bounds), lambda b: b > F.col("doc_id"))) if bounds else F.lit(0)
    return lines.withColumn("batch", F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(above).cast("int"))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """(id, tag, at): for each text that loses lines their sorted numbers, from 0."""
    spark = docs.sparkSession
    parts = [i / batches for i in range(1, batches)]
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    bounds = ids.agg(F.percentile_approx("doc_id", F.lit(parts)).alias("b")).first()["b"] if parts else None
    repeated = stage(ids.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again")), "line-ids")
    n_repeated = repeated.count()
    path = f"{shared_dir(spark)}/protolens/lines-{uuid.uuid4().hex}"
    bounds = sorted({b for b in bounds or [] if b is not None})
    _dealt(hashed_lines(docs, min_chars), bounds).write.option("compression", "zstd").partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id long, tag long, i int, h binary, first boolean, batch int").parquet(path)
    store, kept = LineRuns(spark), []
    for batch in range(len(bounds) + 1):
        kept.append(store.add(_once(lines.where(F.col("batch") == batch), bounded(repeated, n_repeated) if n_repeated else None)))
    frequent = stage(store.found_in(min_docs), "line-frequent")
    store.close()
    keep = kept[0]
    for more in kept[1:]:
        keep = keep.unionByName(more)
    keep = stage(keep.join(bounded(frequent), "h").select("h", "keep"), "line-keep")
    lost = lines.join(bounded(keep), "h").where("not (doc_id <=> keep.doc_id)")
    lost = lost.groupBy(F.col("doc_id").alias("id"), "tag").agg(F.array_sort(F.collect_set("i")).alias("at"))
    lost = stage(lost, "line-lost")
    discard(spark, lines, frequent, keep, *kept)
    return lost


def _kept(text: Column, at: Column) -> Column:
    """The text without the lines ``at``: the runs of lines between them, joined."""
    end = lambda lines, j: F.coalesce(F.get(at, j), F.size(lines))
    begin = lambda j: F.coalesce(F.get(at, j - 1) + 1, F.lit(0))
    parts = lambda lines: F.flatten(F.transform(F.sequence(F.lit(0), F.size(at)), lambda j: F.slice(lines, begin(j) + 1, end(lines, j) - begin(j))))
    return F.array_join(F.get(F.transform(F.array(_lines(text)), parts), F.lit(0)), "\n")


def without_repeats(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
    """``docs`` with repeated lines cut out of the texts; with the numbers of lines before and
    of lines dropped if names for these columns are given."""
    lost = dropped_lines(docs, min_chars, min_docs, batches)
    size = lost.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("at")), F.lit(0)).alias("lines")).first()
    side = lost.withColumnRenamed("tag", "lost_tag")
    if size["n"] <= BROADCAST_ROWS and size["lines"] <= 4 * BROADCAST_ROWS:
        side = F.broadcast(side)
    tag = spare(docs, "line_tag")
    own = docs.withColumn(tag, F.xxhash64(text_of())).alias("d")
    met = own.join(side.alias("l"), F.expr(f"cast(d.doc_id as long) <=> l.id and d.{tag} = l.lost_tag"), "left")
    text = F.coalesce(F.col("d.text").cast("string"), F.lit(""))
    cut = F.when(F.col("l.at").isNull(), text).otherwise(_kept(text, F.col("l.at")))
    more = [(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias(n_lines)] if n_lines else []
    more += [F.coalesce(F.size("l.at"), F.lit(0)).cast("long").alias(n_dropped)] if n_dropped else []
    return met.select(*[cut.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in docs.columns], *more)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs, n_lines="n_lines", n_dropped="n_dropped").select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (
  SELECT rid, doc_id, i, a[i] AS line, translate(trim(a[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_UPPER.lower()}') AS key
  FROM d, range(1, len(a) + 1) t(i)
), k AS (
  SELECT key, max(doc_id) AS keep FROM l WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '')) >= {MIN_DOCS}
), m AS (
  SELECT l.*, k.key IS NOT NULL AND l.doc_id IS DISTINCT FROM keep AS gone FROM l LEFT JOIN k ON l.key = k.key
)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY rid
"""
