"""The trie of conversation prefixes in preorder-interval encoding.

A node is a distinct sequence of first turns. Whole conversations are ranked in lexicographic
order of their turns: blocks of up to ``BLOCK`` turn digests are sorted and numbered, then
blocks of these numbers, until one number is left for each conversation; equal conversations
share it. Neighbours in that order tell by their common prefix which nodes a conversation is
the first to have; sorted by (first conversation, depth) the nodes stand in preorder. Each node
stores its position and the end of its subtree, which is the last node that the last
conversation through it brings. Leaves and savings of a subtree are differences of prefix sums
over the positions.

Orders and prefix sums are distributed: rows are range-partitioned and sorted, each partition is
numbered on its own and set off by the sums of those before it. A conversation is rows of a
turn each, so neither a long one nor a prefix that many share has to fit into a task. Texts
are read once and never shuffled; turns travel as 128 bits of a digest. Only the digest of the
ids that end at a node is sequential: ids are joined to chunks of up to ``CHUNK`` and streamed in order
through one task for each node, which keeps the state of the digest.

Results for odd input: a null role or text is empty; null turns come first, equal turns are in
order of their digests; repeated rows are turns of their own; rows with a null conv_id take no
part; a conversation without turns is a member of the root; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from protolens.llm._util import bounded, stage, table

BLOCK, CHUNK = 64, 4096
_NOTHING = hashlib.sha256(b"").hexdigest()


def in_order(rows: DataFrame, order: list, name: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``pos``, their place from 0 in ``order``, and for each column of ``sums`` its
    sum up to and with the row as ``<column>_to``. Written to the shared folder."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), f"{name}-placed")
    placed = placed.withColumn("part", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND((1 << 33) - 1))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("part").agg(F.count("*").alias("rows_before"), *[F.sum(c).alias(f"{c}_before") for c in sums])
    before = before.select("part", *[F.coalesce(F.sum(f"{c}_before").over(ahead), F.lit(0)).alias(f"{c}_before") for c in ("rows", *sums)])
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for c in sums:
        placed = placed.withColumn(f"{c}_to", F.sum(c).over(inside))
    placed = placed.join(bounded(stage(before, f"{name}-before")), "part")
    return placed.select(*rows.columns, (F.col("rows_before") + F.col("place")).alias("pos"), *[(F.col(f"{c}_before") + F.col(f"{c}_to")).cast("long").alias(f"{c}_to") for c in sums])


def turn_token(role: Column, text: Column) -> Column:
    """Digest of a turn; the length keeps role and text apart."""
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def turns_in_order(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, i, token, size) with i from 0 and the text's bytes as size, (conv_id, n))."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.substring(F.unhex(turn_token(role, text)), 1, 16).alias("token"), F.octet_length(text).cast("long").alias("size"))
    rows = stage(rows, "trie-turns")
    rows = in_order(rows, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("token")], "trie-turns").drop("turn")
    convs = stage(rows.groupBy("conv_id").agg(F.min("pos").alias("start"), F.count("*").alias("n")), "trie-convs")
    rows = rows.join(bounded(convs.select("conv_id", "start")), "conv_id").select("conv_id", (F.col("pos") - F.col("start")).alias("i"), "token", "size")
    return rows, convs.select("conv_id", "n")


def rebuilt(turns: DataFrame, convs: DataFrame, step: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as another does: c takes the first h turns of c - c % step, h
    being crc32(c) % heads, then its own after its first h. Returns (rows of ``trie``, members)."""
    own = convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % step).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"))
    base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    own = own.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    own = stage(own.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")), "trie-plan")
    rest = turns.join(bounded(own.select("conv_id", "h", "taken")), "conv_id").where("i >= h").select("conv_id", (F.col("taken") + F.col("i") - F.col("h") + 1).alias("depth"), "token", "size")
    begun = turns.where(F.col("i") < heads - 1).withColumnRenamed("conv_id", "base").join(own.select("conv_id", "base", "h"), "base").where("i < h").select("conv_id", (F.col("i") + 1).alias("depth"), "token", "size")
    return stage(rest.unionByName(begun), "trie-rebuilt"), own.select("conv_id", "length")


def ranked(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(conv_id, length, seq): the number, from 1, of each conversation's turns among all distinct
    ones in lexicographic order; 0 without turns."""
    longest = members.agg(F.max("length").alias("n")).first()["n"] or 0
    names = rows.select("conv_id", "depth", F.col("token").alias("name"))
    while True:
        parts = names.groupBy("conv_id", F.floor((F.col("depth") - 1) / BLOCK).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "name"))), lambda t: t["name"]).alias("names"))
        parts = stage(parts, "trie-blocks")
        known = stage(in_order(parts.select("names").distinct(), ["names"], "trie-names"), "trie-names")
        names = stage(parts.join(bounded(known), "names").select("conv_id", (F.col("block") + 1).alias("depth"), F.col("pos").alias("name")), "trie-named")
        longest = -(-longest // BLOCK)
        if longest <= 1:
            break
    out = members.join(names.select("conv_id", "name"), "conv_id", "left")
    return stage(out.select("conv_id", "length", F.coalesce(F.col("name") + 1, F.lit(0)).alias("seq")), "trie-ranked")


def _paths(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((seq, depth, size, n_convs, conv_id, length, node) for each turn of each distinct sequence,
    (seq, n_convs, conv_id) of all); nodes are numbered from 1 by depth, then order."""
    seqs = stage(convs.groupBy("seq").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("length").alias("length")), "trie-seqs")
    paths = stage(rows.join(bounded(seqs), "conv_id").select("seq", "depth", "token", "size", "n_convs", "conv_id", "length"), "trie-paths")
    last = paths.select((F.col("seq") + 1).alias("seq"), "depth", F.col("token").alias("other"))
    new = paths.join(last, ["seq", "depth"], "left").where("other is null or token <> other").groupBy("seq").agg(F.min("depth").alias("from"))
    paths = paths.join(bounded(stage(new, "trie-new")), "seq").withColumn("new", (F.col("depth") >= F.col("from")).cast("long")).drop("token", "from")
    paths = in_order(stage(paths, "trie-pairs"), ["depth", "seq"], "trie-pairs", ("new",))
    return stage(paths.withColumnRenamed("new_to", "node").drop("new", "pos"), "trie-nodes"), seqs


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each sequence from its chunks in order."""
    now, state, done = None, None, []
    pack = lambda: pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.int64(), pa.string()))], names=["seq", "digest"])
    for batch in batches:
        for seq, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if state is None or seq != now:
                if state is not None:
                    done.append((now, state.hexdigest()))
                now, state = seq, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(done) > 10_000:
            yield pack()
            done.clear()
    if state is not None:
        done.append((now, state.hexdigest()))
    yield pack()


def ends(convs: DataFrame) -> DataFrame:
    """(seq, digest): SHA-256 of the ids of each sequence, ascending and joined by commas."""
    placed = in_order(convs.select("seq", "conv_id"), ["seq", "conv_id"], "trie-ends")
    chunks = placed.groupBy("seq", F.floor(F.col("pos") / CHUNK).alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return chunks.repartition("seq").sortWithinPartitions("seq", "chunk").select("seq", "ids").mapInArrow(_id_digests, "seq long, digest string")


def trie(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes over (conv_id, depth from 1, token, size) and all members (conv_id, length).

    Returns (pos, end, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256): ``pos`` and ``end`` bound the subtree in preorder, the root is at 0.
    """
    convs = ranked(rows, members)
    paths, seqs = _paths(rows, convs)
    digests = stage(ends(convs), "trie-digests")
    nodes = paths.groupBy("node").agg(F.first("depth").alias("depth"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.first("size").alias("size"), F.max(F.when(F.col("length") == F.col("depth"), F.col("seq"))).alias("own"))
    leaf = (F.col("first") == F.col("last")) & F.col("own").isNotNull()
    nodes = nodes.withColumns({"leaf": leaf.cast("long"), "saved": (F.col("n_convs") - 1) * F.col("size")})
    nodes = stage(in_order(stage(nodes, "trie-tops"), ["first", "depth"], "trie-preorder", ("leaf", "saved")), "trie-preorder")
    stop = nodes.groupBy(F.col("first").alias("last")).agg(F.max(F.struct("pos", "leaf_to", "saved_to")).alias("s"))
    stop = stop.select("last", (F.col("s.pos") + 1).alias("end"), F.col("s.leaf_to").alias("leaf_end"), F.col("s.saved_to").alias("saved_end"))
    above = paths.select(F.col("seq").alias("first"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    known = nodes.join(stop, "last").join(above, ["first", "depth"], "left").withColumn("parent", F.coalesce("parent", F.lit(0)))
    known = stage(known, "trie-known")
    heads = seqs.agg(F.lit(0).cast("long").alias("node"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max(F.when(F.col("seq") == 0, F.col("seq"))).alias("own")).where("n_convs > 0")
    total = nodes.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"))
    root = heads.join(F.broadcast(total)).select("node", F.lit(-1).cast("long").alias("pos"), F.col("nodes").alias("end"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), "n_convs", F.greatest("leaves", F.lit(1)).alias("n_leaves"), F.col("saved").alias("saved_tokens"), "own")
    every = known.select("node", "pos", "end", "conv_id", "depth", "parent", "n_convs", (F.col("leaf_end") - F.col("leaf_to") + F.col("leaf")).alias("n_leaves"), (F.col("saved_end") - F.col("saved_to") + F.col("saved")).alias("saved_tokens"), "own").unionByName(root)
    every = stage(every, "trie-every")
    children = every.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    parents = every.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = every.join(children, "node", "left").join(parents, "parent", "left").join(digests.withColumnRenamed("seq", "own"), "own", "left")
    number = lambda c: F.col(c).cast("long").alias(c)
    return out.select(
        (F.col("pos") + 1).alias("pos"), (F.col("end") + 1).alias("end"), "conv_id", number("depth"), "parent_conv_id", number("n_convs"),
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), number("n_leaves"), number("saved_tokens"), F.coalesce("digest", F.lit(_NOTHING)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are."""
    turns, convs = turns_in_order(conversations)
    return trie(stage(turns.select("conv_id", (F.col("i") + 1).alias("depth"), "token", "size"), "trie-rows"), convs.withColumnRenamed("n", "length"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = turns_in_order(table(spark, sf_dir, "conversations"))
    return trie(*rebuilt(turns, convs)).drop("pos", "end")


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS a
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), c AS (
  SELECT conv_id, a, conv_id - conv_id % 5 AS base, xor(4294967295::BIGINT, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
    lambda x, y: list_reduce(list_concat([xor(x, y)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda p, q: xor(p >> 1, CASE WHEN p % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)))) % 9 AS h FROM t
), r AS (
  SELECT c.conv_id, list_concat(CASE WHEN b.a IS NULL THEN [] ELSE b.a[1:c.h] END, c.a[c.h + 1:]) AS path FROM c LEFT JOIN t b ON c.base = b.conv_id
), p AS (
  SELECT conv_id, d, path[1:d] AS path, len(path) = d AS ends FROM r, LATERAL (SELECT unnest(range(0, len(path) + 1)) AS d)
), g AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    (count(*) - 1) * coalesce(strlen(path[d].text), 0) AS own FROM p GROUP BY path, d
), k AS (
  SELECT path[1:d - 1] AS path, count(*) AS n_children FROM g WHERE d > 0 GROUP BY 1
), f AS (
  SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k ON g.path = k.path
), s AS (
  SELECT path[1:e] AS path, sum(own) AS saved, count_if(n_children = 0) AS leaves FROM f, LATERAL (SELECT unnest(range(0, d + 1)) AS e) GROUP BY 1
)
SELECT f.conv_id, f.d::BIGINT AS depth, CASE WHEN f.d > 0 THEN u.conv_id END AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
  s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN s ON f.path = s.path LEFT JOIN g u ON u.path = f.path[1:f.d - 1] AND u.d = f.d - 1
"""
