"""Chat formatting in budgeted windows.

Turns are rendered with a reversible template and counted in tokens. Prefix sums of the
tokens place each turn: with a stride that leaves room for the system turn and the history,
a turn that lies inside one stride joins the window of that stride, one that crosses a
border gets a window of its own. So windows are turn-aligned and need no sequential scan.
Each window repeats the leading system turn and as much history, latest turns first, as its
limit and the budget leave after the system turn and the window's own turns; repeated turns
carry no loss, each assistant turn is a target once. A window stays within the budget unless
the system turn and one turn alone are larger.

Prefix sums are taken in blocks of turns and offset by sums of blocks: no conversation has
to fit into one task. A window's rows are bounded by the budget.

Results for odd input: a null role or text is empty; null turns come last; equal turns are
ordered by role, then text; repeated rows are turns of their own; a null conv_id is a
conversation; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from protolens.llm._util import stage, table

BUDGET, HISTORY, OVERHEAD = 1024, 256, 4
#: Turns of one block of the prefix sums.
BLOCK = 256
_TURN = r"<turn ([^<>]*)>\n([^<]*)</turn>\n"


def escape(text: Column) -> Column:
    """Control characters of the template, reversibly: no escaped text holds ``<`` or ``>``."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in ((">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def _prefixed(rows: DataFrame, history: int, budget: int) -> tuple[DataFrame, DataFrame]:
    """(turns with their window, leading system turns)."""
    head = rows.groupBy("conv_id").agg(F.min(F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "text", "tokens")).alias("h"))
    system = head.where("h.role = 'system'").select("conv_id", F.col("h.role").alias("s_role"), F.col("h.text").alias("s_text"), F.col("h.tokens").alias("s_tokens"))
    order = [F.col("turn").asc_nulls_last(), "role", "text"]
    inside = Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("block", F.expr(f"floor(turn / {BLOCK})").cast("long"))
    sums = rows.groupBy("conv_id", "block").agg(F.sum("tokens").alias("t"))
    ahead = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("t").over(ahead), F.lit(0)))
    sums = sums.alias("b").join(system.select(F.col("conv_id").alias("s_conv"), "s_tokens"), F.expr("conv_id <=> s_conv"), "left").select(F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block"), "offset", F.coalesce("s_tokens", F.lit(0)).alias("s_tokens"))
    rows = rows.withColumn("ahead", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    rows = rows.join(sums, F.expr("conv_id <=> b_conv and block <=> b_block")).withColumn("start", F.col("offset") + F.col("ahead"))
    rows = rows.withColumn("is_system", (F.col("start") == 0) & (F.col("s_tokens") > 0))
    free = F.lit(budget) - F.col("s_tokens")
    rows = rows.withColumn("stride", F.greatest(F.lit(1), F.least(F.greatest(F.lit(budget // 4), free - history), free)))
    rows = rows.withColumn("most_history", F.greatest(F.lit(0), F.least(F.lit(history), free)))
    rows = rows.withColumn("from", F.when(F.col("is_system"), -F.col("tokens")).otherwise(F.col("start") - F.col("s_tokens")))
    rows = rows.withColumn("to", F.col("from") + F.col("tokens"))
    cell = F.floor(F.col("from") / F.col("stride"))
    crosses = F.floor((F.col("to") - 1) / F.col("stride")) > cell
    rows = rows.withColumn("window", F.when(F.col("is_system"), F.lit(0)).otherwise(2 * cell + crosses.cast("int")).cast("long"))
    return rows.select("conv_id", "role", "text", "tokens", "from", "to", "stride", "most_history", "is_system", "window"), system


def format_chats(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of ``conversations`` (conv_id, turn, role, text).

    Returns (conv_id, window, text, n_context, n_turns, n_tokens, loss): ``n_context`` leading
    turns of the text repeat earlier ones, ``loss`` are its target spans (start, end) in code
    points. Windows of a conversation in order hold its turns in order.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))
    rows = rows.withColumn("tokens", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + OVERHEAD)
    turns, system = _prefixed(rows, history, budget)
    turns = stage(turns, "chat-turns")
    own = turns.select("conv_id", "window", "from", F.lit(1).alias("own"), "role", "text", "tokens")
    first = turns.where("not is_system").groupBy("conv_id", "window").agg(F.min("from").alias("begin"), F.sum("tokens").alias("own"))
    first = first.join(system.select(F.col("conv_id").alias("s_conv"), "s_tokens"), F.expr("conv_id <=> s_conv"), "left")
    room = F.least(F.lit(history), F.lit(budget) - F.coalesce("s_tokens", F.lit(0)) - F.col("own"))
    first = first.select(F.col("conv_id").alias("w_conv"), F.col("window").alias("w_window"), "begin", room.alias("room"))
    reach = F.sequence(F.floor(F.col("to") / F.col("stride")), F.greatest(F.floor(F.col("to") / F.col("stride")), F.floor((F.col("from") + F.col("most_history")) / F.col("stride"))))
    near = turns.where("not is_system and tokens <= most_history").withColumn("cell", F.explode(reach)).withColumn("target", F.explode(F.array(2 * F.col("cell"), 2 * F.col("cell") + 1)))
    again = near.join(first, F.expr("conv_id <=> w_conv and target = w_window and to <= begin and from >= begin - room"))
    again = again.select("conv_id", F.col("target").alias("window"), "from", F.lit(0).alias("own"), "role", "text", "tokens")
    heads = first.join(system, F.expr("w_conv <=> conv_id")).join(turns.where("is_system").select(F.col("conv_id").alias("o_conv"), F.col("window").alias("o_window")), F.expr("w_conv <=> o_conv and w_window = o_window"), "left_anti")
    heads = heads.select(F.col("w_conv").alias("conv_id"), F.col("w_window").alias("window"), (-F.col("s_tokens")).alias("from"), F.lit(0).alias("own"), F.col("s_role").alias("role"), F.col("s_text").alias("text"), F.col("s_tokens").alias("tokens"))
    every = own.unionByName(again).unionByName(heads)
    every = every.withColumns({"pre": F.concat(F.lit("<turn "), escape(F.col("role")), F.lit(">\n")), "safe": escape(F.col("text"))})
    grouped = every.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("from", "own", "role", "pre", "safe"))).alias("turns"),
        F.sum("tokens").alias("n_tokens"), F.sum(1 - F.col("own")).cast("int").alias("n_context"), F.count("*").cast("int").alias("n_turns"),
    )
    size = lambda t: F.length(t["pre"]) + F.length(t["safe"]) + F.lit(len("</turn>\n"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    begin = lambda acc, t: acc["at"] + F.length(t["pre"])
    step = lambda acc, t: F.struct(
        (acc["at"] + size(t)).cast("int").alias("at"),
        F.when((t["own"] == 1) & (t["role"] == "assistant"), F.concat(acc["loss"], F.array(F.struct(begin(acc, t).cast("int").alias("start"), (begin(acc, t) + F.length(t["safe"])).cast("int").alias("end"))))).otherwise(acc["loss"]).alias("loss"),
    )
    loss = F.aggregate("turns", F.struct(F.lit(0).alias("at"), empty.alias("loss")), step, lambda acc: acc["loss"])
    body = F.array_join(F.transform("turns", lambda t: F.concat(t["pre"], t["safe"], F.lit("</turn>\n"))), "")
    return grouped.select("conv_id", "window", body.alias("text"), "n_context", "n_turns", "n_tokens", loss.alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, window, roles, texts, loss_texts) of the turns that each window does not repeat."""
    mine = lambda i: F.slice(F.regexp_extract_all("text", F.lit(_TURN), F.lit(i)), F.col("n_context") + 1, F.col("n_turns"))
    plain = lambda a: F.transform(a, unescape)
    loss = F.transform("loss", lambda s: unescape(F.col("text").substr(s["start"] + 1, s["end"] - s["start"])))
    return windows.select("conv_id", "window", plain(mine(1)).alias("roles"), plain(mine(2)).alias("texts"), loss.alias("loss_texts"), F.length("text").alias("chars"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from windows in order; holds one batch and two digests."""
    done: list[tuple] = []
    now, started = None, False
    turns = loss = None
    count = chars = total = 0

    def flush() -> None:
        if started:
            done.append((now, count, turns.hexdigest(), chars, loss.hexdigest(), total))

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    pack = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=names)
    for batch in batches:
        for conv, n, said, kept, kept_chars, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if not started or conv != now:
                flush()
                now, started, turns, loss, count, chars, total = conv, True, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            turns.update(said.encode())
            loss.update(kept.encode())
            count, chars, total = count + n, chars + kept_chars, total + size
        if len(done) > 10_000:
            yield pack()
            done.clear()
    flush()
    yield pack()


def conversation_digests(windows: DataFrame) -> DataFrame:
    """A digest of a whole conversation is sequential: its windows stream in order through one
    task, which keeps only the state of the digest."""
    back = read_back(windows)
    said = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat(t["roles"], F.lit("\n"), t["texts"], F.lit("\n"))), "")
    kept = F.array_join("loss_texts", "")
    back = back.select("conv_id", "window", F.size("texts").cast("long").alias("n"), said.alias("said"), kept.alias("kept"), F.length(kept).cast("long").alias("kept_chars"), F.col("chars").cast("long").alias("chars"))
    ordered = back.repartition("conv_id").sortWithinPartitions("conv_id", "window").drop("window")
    return ordered.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Fixed value: a text that imitates marks of chat templates.
PLANTED = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], rows.schema)
    return conversation_digests(format_chats(rows.unionByName(more)))


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), k AS (
  SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS i,
    17 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) - 1 AS size
  FROM c
), p AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
    coalesce(max(CASE WHEN i = 1 AND role = 'system' THEN tokens END) OVER (PARTITION BY conv_id), 0) AS s FROM k
), q AS (
  SELECT *, i = 1 AND role = 'system' AS sys, greatest(1, least(greatest(256, 768 - s), 1024 - s)) AS stride, start - s AS a, start - s + tokens AS b FROM p
), w AS (
  SELECT *, CASE WHEN sys THEN 0 ELSE 2 * (a // stride) + CASE WHEN (b - 1) // stride > a // stride THEN 1 ELSE 0 END END AS win FROM q
), f AS (
  SELECT conv_id, win, min(a) AS begin_, least(256, 1024 - any_value(s) - sum(tokens)) AS room FROM w WHERE NOT sys GROUP BY ALL
), h AS (
  SELECT w.conv_id, sum(size) AS chars FROM w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND NOT sys AND b <= begin_ AND a >= begin_ - room GROUP BY ALL
), y AS (
  SELECT w.conv_id, sum(size) AS chars FROM w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND sys AND f.win <> 0 GROUP BY ALL
), g AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS chars
  FROM w GROUP BY conv_id
)
SELECT g.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, (g.chars + coalesce(h.chars, 0) + coalesce(y.chars, 0))::BIGINT AS formatted_chars
FROM g LEFT JOIN h ON g.conv_id IS NOT DISTINCT FROM h.conv_id LEFT JOIN y ON g.conv_id IS NOT DISTINCT FROM y.conv_id
"""
