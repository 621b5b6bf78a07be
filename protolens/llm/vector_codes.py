"""Compression of vectors to short codes: Lloyd rounds with the bounds of Elkan.

Components become integers, a vector is cut into equal parts, and each part position has a
codebook of its own; a vector's code is the nearest entry of each part. A round assigns all
parts and moves the entries to the floor of the mean of their parts. Distances are integers,
so results depend on no order of summation.

Between rounds each part keeps its entry, an upper bound on the distance to it and a lower
bound on the distance to each entry. Bounds are whole numbers, rounded to the safe side, and
are shifted by the distance that entries moved. An entry is passed over only if it is
strictly farther than the part's own: its lower bound exceeds the upper bound, or the gap
between both entries exceeds twice the upper bound. All others are decided on exact squared
distances, ties by the lower index, so pruning never changes a result.

The state of a round (vectors as integers, entries, bounds) is a table in the shared folder;
tasks read it in batches, write the next one and add a row of what their moved parts change in
the sums. Only the sums of each codebook's entries, added up in Spark, reach the driver.

Results for odd input: vectors that are null, empty, of another length than most (ties: the
longer), or hold null or non-finite numbers take no part; neither do those with numbers so
large that squared distances leave 63 bits. A length that the number of parts does not divide
is filled up with zeros. A null id comes last in the order of ids, equal ids are ordered by
vector, and each row is coded; with fewer rows than entries a codebook is as short; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protolens.llm._util import bounded, discard, stage, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Numbers of one slice of an Arrow batch.
_SLICE = 1 << 19
_FAR = np.int64(1 << 40)
_LOW = np.iinfo(np.uint16).max


def floor_root(squares: np.ndarray) -> np.ndarray:
    r = np.sqrt(squares.astype(float)).astype(np.int64)
    r -= r * r > squares
    return r + ((r + 1) * (r + 1) <= squares)


def ceil_root(squares: np.ndarray) -> np.ndarray:
    r = floor_root(squares)
    return r + (r * r < squares)


def gaps(books: np.ndarray) -> np.ndarray:
    """Distances between the entries of each codebook, rounded down."""
    return np.stack([floor_root(((b[:, None] - b[None]) ** 2).sum(-1)) for b in books])


def shifted(upper: np.ndarray, lower: np.ndarray, own: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (n x parts, n x parts x entries) after entries moved by at most ``moved``."""
    return upper + moved[np.arange(moved.shape[0]), own], np.maximum(0, lower - moved)


def assign(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, books: np.ndarray, between: np.ndarray) -> int:
    """Moves each part (n x parts x width) to its nearest entry, in place; returns the number of
    exact distances that were needed."""
    exact = 0
    for p, (book, gap) in enumerate(zip(books, between, strict=True)):
        o, u, low = own[:, p], upper[:, p], lower[:, p]

        def open_(rows):
            near = (low[rows] <= u[rows, None]) & (gap[o[rows]] <= 2 * u[rows, None])
            near[np.arange(len(rows)), o[rows]] = False
            return near

        rows = np.arange(len(x))
        rows = rows[open_(rows).any(axis=1)]
        mine = ((x[rows, p] - book[o[rows]]) ** 2).sum(1)
        u[rows], low[rows, o[rows]] = ceil_root(mine), floor_root(mine)
        r, j = np.nonzero(open_(rows))
        square = ((x[rows[r], p] - book[j]) ** 2).sum(1)
        low[rows[r], j] = floor_root(square)
        every = np.full((len(rows), len(book)), np.iinfo(np.int64).max)
        every[np.arange(len(rows)), o[rows]] = mine
        every[r, j] = square
        best = every.argmin(axis=1)
        o[rows], u[rows] = best, ceil_root(every[np.arange(len(rows)), best])
        exact += len(mine) + len(square)
    return exact


@dataclass
class Codebooks:
    """Entries (parts x entries x width) as integers of ``scale`` to one."""

    books: np.ndarray
    scale: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for v in self.books.ravel().tolist()).encode()).hexdigest()


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> tuple[DataFrame, int]:
    """((vec_id, label, v) of the rows that take part, their length)."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    width = most["n"] if most else 0
    limit = (math.isqrt((1 << 63) // (4 * max(1, width))) - 1) / scale
    return rows.where(F.size(v) == width).where(F.forall(v, lambda e: F.abs(e) < F.lit(limit))), width


def _whole(vectors: list, parts: int, width: int, scale: int) -> np.ndarray:
    """Integers of the vectors, n x parts x (width of a part)."""
    x = np.floor(np.array(vectors, float).reshape(len(vectors), -1) * scale).astype(np.int64)
    return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)


def _bytes(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows).reshape(len(rows), -1)
    return pa.array([r.tobytes() for r in flat], pa.binary())


def _numbers(column: pa.Array, kind, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.int64).reshape(len(column), *shape)


def _slices(batch: pa.RecordBatch, numbers: int) -> Iterator[pa.RecordBatch]:
    step = max(1, _SLICE // max(1, numbers))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _round(books: np.ndarray, moved: np.ndarray | None, label: pa.DataType):
    """One round over a state table, or over raw vectors where nothing has moved yet: the next
    state, and a last row with the changes of counts and sums by part and entry."""
    parts, entries, width = books.shape
    between = gaps(books)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = np.zeros((parts, entries, width + 1), np.int64)
        every = np.arange(parts)
        for whole in batches:
            for batch in _slices(whole, parts * (width + entries)):
                x = _numbers(batch.column(2), np.int32, parts, width)
                n = len(x)
                if moved is None:
                    own, upper, lower = np.zeros((n, parts), np.int64), np.full((n, parts), _FAR), np.zeros((n, parts, entries), np.int64)
                else:
                    own, upper, lower = _numbers(batch.column(3), np.uint16, parts), _numbers(batch.column(4), np.int64, parts), _numbers(batch.column(5), np.uint16, parts, entries)
                    upper, lower = shifted(upper, lower, own, moved)
                before = own.copy()
                assign(x, own, upper, lower, books, between)
                with_one = np.concatenate([np.ones((n, parts, 1), np.int64), x], axis=2)
                r, p = np.nonzero(own != before) if moved is not None else np.nonzero(own >= 0)
                np.add.at(change, (every[p], own[r, p]), with_one[r, p])
                if moved is not None:
                    np.subtract.at(change, (every[p], before[r, p]), with_one[r, p])
                columns = [batch.column(0), batch.column(1), batch.column(2), _bytes(own.astype(np.uint16)), _bytes(upper), _bytes(np.minimum(lower, _LOW).astype(np.uint16)), pa.nulls(n, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=_STATE)
        last = [pa.nulls(1, t) for t in (pa.int64(), label, pa.binary(), pa.binary(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*last, pa.array([change.ravel().tolist()], pa.list_(pa.int64()))], names=_STATE)

    return over


_STATE = ["vec_id", "label", "x", "own", "upper", "lower", "change"]


def _final(books: np.ndarray, moved: np.ndarray | None):
    """(vec_id, label, code, error) of the last assignment."""
    parts, entries, width = books.shape
    between = gaps(books)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, parts * (width + entries)):
                x = _numbers(batch.column(2), np.int32, parts, width)
                own, upper, lower = _numbers(batch.column(3), np.uint16, parts), _numbers(batch.column(4), np.int64, parts), _numbers(batch.column(5), np.uint16, parts, entries)
                upper, lower = shifted(upper, lower, own, moved)
                assign(x, own, upper, lower, books, between)
                error = ((x - books[np.arange(parts), own]) ** 2).sum((1, 2))
                code = pa.array(own.tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return over


def _scaled(parts: int, width: int, scale: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, parts * width):
                x = _whole(batch.column(2).to_pylist(), parts, width, scale)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _bytes(x.astype(np.int32))], names=["vec_id", "label", "x"])

    return over


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """((vec_id, label, code: array of entries, error: squared distance), codebooks)."""
    spark = vectors.sparkSession
    rows, length = usable(vectors, id_col, vector_col, label_col, scale)
    width = -(-length // parts)
    label = rows.schema["label"].dataType
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        nothing = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
        return spark.createDataFrame([], nothing), Codebooks(np.zeros((parts, 0, 0), np.int64), scale)
    books = _whole([r["v"] for r in first], parts, width, scale).transpose(1, 0, 2)
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("x", T.BinaryType())])
    now, moved, previous = rows.mapInArrow(_scaled(parts, width, scale), schema), None, None
    for name in _STATE[3:6]:
        schema = schema.add(name, T.BinaryType())
    schema = schema.add("change", T.ArrayType(T.LongType()))
    arrow = pa.schema(vectors.select(F.col(label_col).alias("label")).limit(0).toArrow().schema).field("label").type
    counts = [[0] * (width + 1) for _ in range(parts * books.shape[1])]
    for _ in range(rounds):
        nxt = stage(now.mapInArrow(_round(books, moved, arrow), schema), "codes")
        for at, v in nxt.where("x is null").select(F.posexplode("change").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
            counts[at // (width + 1)][at % (width + 1)] += int(v)
        flat = [[s // c[0] for s in c[1:]] if c[0] else old for c, old in zip(counts, books.reshape(-1, width).tolist(), strict=True)]
        new = np.array(flat, np.int64).reshape(books.shape)
        moved, books = ceil_root(((new - books) ** 2).sum(-1)), new
        if previous is not None:
            discard(spark, previous)
        previous, now = nxt, nxt.where("x is not null")
    coded = now.mapInArrow(_final(books, moved), T.StructType([*schema.fields[:2], T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())]))
    coded = stage(coded, "codes")
    discard(spark, previous)
    return coded, Codebooks(books, scale)


def restored(coded: DataFrame, found: Codebooks, code: Column | None = None) -> DataFrame:
    """``coded`` with ``vector``: the entries of each code, back in the scale of the input."""
    books = F.lit((found.books / found.scale).tolist())
    pick = F.transform(F.col("code") if code is None else code, lambda j, p: F.get(F.get(books, p), j))
    return coded.withColumn("vector", F.flatten(pick))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, found = compress(table(spark, sf_dir, "embeddings"))
    sums = stage(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    code = F.array_join(F.transform("code", lambda j: F.lpad(F.lower(F.hex(j)), 2, "0")), "")
    out = coded.join(bounded(sums), F.expr("label <=> of"))
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def _sql() -> str:
    """Six rounds written out; each assigns by (squared distance, index) and takes floors of means."""
    out = [f"""
WITH v AS (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding::DOUBLE[]) AS rid FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), x AS (
  SELECT rid, vec_id, label, p, list_transform(embedding[p * (len(embedding) // {PARTS}) + 1 : (p + 1) * (len(embedding) // {PARTS})], lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x
  FROM v, range({PARTS}) t(p)
), b0 AS (SELECT p, rid - 1 AS j, x AS b FROM x WHERE rid <= {ENTRIES})"""]
    near = "SELECT rid, vec_id, label, x.p, x, min(row(list_sum(list_transform(list_zip(x, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, j)) AS m FROM x JOIN b{i} b ON x.p = b.p GROUP BY ALL"
    for i in range(ROUNDS):
        out.append(f"""a{i} AS ({near.format(i=i)}), s{i} AS (
  SELECT p, m[2] AS j, c, floor(sum(x[c]) / count(*))::BIGINT AS v FROM a{i}, range(1, len(x) + 1) t(c) GROUP BY ALL
), m{i} AS (SELECT p, j, list(v ORDER BY c) AS b FROM s{i} GROUP BY ALL),
b{i + 1} AS (SELECT b.p, b.j, coalesce(m.b, b.b) AS b FROM b{i} b LEFT JOIN m{i} m ON b.p = m.p AND b.j = m.j)""")
    out.append(f"""z AS ({near.format(i=ROUNDS)}), e AS (
  SELECT rid, vec_id, label, string_agg(printf('%02x', m[2]), '' ORDER BY p) AS code, sum(m[1])::BIGINT AS error FROM z GROUP BY ALL
), h AS (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM e, h""")
    return ",\n".join(out)


OP13_SQL = _sql()
