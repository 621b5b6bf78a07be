"""Approximate nearest neighbours: an inverted file with product-quantised residuals.

Coarse centroids and the quantiser are fitted on a bounded sample (of ``SAMPLE`` vectors or
``SHARE`` for each list, whichever is more; there are as many lists as the square root of the
vectors, up to ``LISTS``); every vector is indexed: assigned to its nearest centroid's list, its residual coded by product
quantisation. The number of lists that a query probes is set on the same sample, so that
probing would find ``TARGET`` of the sample's true neighbours. Lists are salted into blocks of
bounded size, and so are the queries of a list; a block is searched with asymmetric distance
tables, its shortlist reranked by exact distances on the original vectors. A vector is never
further from its code than its own coding error, so every other vector of the block that could
still be nearer than the shortlist's last is ranked too: codes lose no neighbour of a probed
list, however unlike the vectors' lengths are. The index works on vectors moved and scaled to
the sample's middle and size, so neither an offset nor the unit matters. Equal vectors of a
block are searched as one and expanded to as many copies as can matter, so copies never
crowd others out. Only each query's nearest of each block leave it. A query for which the
probed lists hold fewer candidates than wanted is searched in all lists.

Results for odd input: vectors that are null, zero, of another length than most, or hold null
or non-finite numbers take no part; rows with a null id are neither queries nor candidates;
repeated rows are candidates each; a query never finds its own id; ties go to the smaller id;
with fewer candidates all are returned; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from protolens.llm._util import bounded, stage, table

K = 10
SAMPLE, TARGET = 20_000, 0.985
LISTS, SHARE, CODES, SUBSPACES = 32_768, 8, 256, 16
#: Vectors and queries of one searched block, on average.
BLOCK, QUERIES = 8_192, 2_048
#: Pairs of a query and a vector that are held at a time.
PAIRS = 1 << 19
#: Of these so many whose vectors are held as well.
EXACT = PAIRS >> 4
#: Shortlist of a query in a block: at least so many, and so many for each wanted neighbour.
RERANK, PER_NEIGHBOUR = 48, 5


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.asarray(x, np.float32)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def _short(x: np.ndarray) -> np.ndarray:
    """Moved vectors as 32-bit numbers whose squares stay finite."""
    return np.clip(x, -1e15, 1e15).astype(np.float32)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None]


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    part = max(64, (1 << 22) // max(1, len(c)))
    return np.concatenate([_squares(x[i : i + part], c).argmin(1) for i in range(0, len(x), part)] + [np.zeros(0, np.int64)])


@dataclass
class Index:
    """Fitted centroids of moved and scaled vectors: lists x dim, and subspaces x codes x width;
    lists to probe."""

    coarse: np.ndarray
    fine: np.ndarray
    probes: int
    middle: np.ndarray | float = 0.0
    factor: float = 1.0

    def moved(self, x: np.ndarray) -> np.ndarray:
        return (np.asarray(x, float) - self.middle) * self.factor

    def code(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        r = (x - self.coarse[lists]).reshape(len(x), len(self.fine), -1)
        return np.stack([_nearest(np.ascontiguousarray(r[:, s]), f) for s, f in enumerate(self.fine)], axis=1).astype(np.uint8)


def lists_for(total: int) -> int:
    return min(LISTS, round(np.sqrt(total)))


def fit(sample: np.ndarray, total: int, k: int = K) -> Index:
    """An index from a sample of the ``total`` vectors that it will hold."""
    x = np.unique(np.asarray(sample, float), axis=0)  # copies would take centroids and hide what others need
    middle = np.median(x, axis=0)
    far = np.median(np.abs(x - middle).max(axis=1))
    factor = 1.0 / far if far > 0 else 1.0
    x = _short((x - middle) * factor)
    lists = int(max(1, min(lists_for(total), len(x))))
    coarse = _kmeans(x, lists)
    near = _nearest(x, coarse)
    dim = x.shape[1]
    m = next(s for s in range(min(SUBSPACES, dim), 0, -1) if dim % s == 0)
    r = (x - coarse[near]).reshape(len(x), m, -1)
    fine = np.stack([_kmeans(np.ascontiguousarray(r[:, s]), min(CODES, len(x))) for s in range(m)])
    rng = np.random.default_rng(11)
    q = rng.choice(len(x), min(256, len(x)), replace=False)
    d = _squares(x[q].astype(float), x.astype(float))
    d[np.arange(len(q)), q] = np.inf
    wanted = np.argsort(d, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(_squares(x[q], coarse), axis=1), axis=1)
    deep = np.sort(place[np.arange(len(q))[:, None], near[wanted]].ravel())
    probes = 1 if not len(deep) else int(deep[min(len(deep) - 1, int(np.ceil(TARGET * len(deep))) - 1)]) + 1
    return Index(coarse, fine, min(lists, max(8, probes)), middle, factor)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, all of the most frequent length."""
    v = F.col("v")
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null").where(ok)
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (most["n"] if most else 0))


def _sampled(rows: DataFrame, total: int, n: int) -> pd.DataFrame:
    """The ``n`` rows of least hash of their id. Hashes are even, so rows that can't be among them
    don't leave their tasks, each of which would send ``n`` rows to the driver; ids that repeat may
    leave too few, and all rows are ranked."""
    hashed, share = F.xxhash64("vec_id"), 1.1 * (n + 1000) / total
    able = rows if share >= 1 else rows.where(hashed <= F.lit(int(share * 2.0**64) - 2**63))
    least = lambda some: some.orderBy(hashed, "vec_id").limit(n).toPandas()
    found = least(able)
    return found if share >= 1 or len(found) == n else least(rows)


def _assigned(index: Index):
    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if pdf.empty:
                continue
            x = _short(index.moved(pdf["v"].tolist()))
            lists = _nearest(x, index.coarse)
            yield pd.DataFrame({"list": lists.astype(np.int32), "vec_id": pdf["vec_id"], "rid": pdf["rid"], "codes": [c.tobytes() for c in index.code(x, lists)], "v": pdf["v"]})

    return over


def _probed(index: Index, probes: int):
    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if pdf.empty:
                continue
            x = _short(index.moved(pdf["v"].tolist()))
            near = np.argsort(_squares(x, index.coarse), axis=1, kind="stable")[:, :probes]
            yield pd.DataFrame({"query_id": pdf["vec_id"], "lists": [n.astype(np.int32) for n in near], "q": pdf["v"]})

    return over


def _search(index: Index, k: int):
    short_list = max(RERANK, PER_NEIGHBOUR * k)

    def block(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(rows):
            rows = rows.sort_values("vec_id", kind="stable")
            v = np.array(rows["v"].tolist(), float)
            ids = rows["vec_id"].to_numpy()
            _, one, same = np.unique(v.view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel(), return_index=True, return_inverse=True)
            same = same.ravel()
            members, sizes = np.argsort(same, kind="stable"), np.bincount(same)
            starts = np.cumsum(sizes) - sizes
            x = v[one]
            n, subs = len(x), np.arange(len(index.fine))
            codes = np.frombuffer(b"".join(rows["codes"].iloc[one]), np.uint8).reshape(n, -1).astype(np.int64)
            centre = index.coarse[int(rows["list"].iloc[0])].astype(float)
            own = index.moved(x) - centre
            off = np.sqrt(((own - index.fine[subs, codes].reshape(n, -1)) ** 2).sum(1))
            squares = (own**2).sum(1)
            # Distances of moved vectors, and those by products, may be off by so much.
            rough = 1e-15 * index.factor * x.shape[1] * (np.abs(x).max() + np.abs(index.middle).max())
            names, asked = queries["query_id"].to_numpy(), np.array(queries["q"].tolist(), float)
            step = max(1, PAIRS // n)
            for at in range(0, len(names), step):
                query, q = names[at : at + step], asked[at : at + step]
                r = index.moved(q) - centre
                parts = r.reshape(len(r), len(index.fine), -1)
                near = np.zeros((len(r), n))
                for s, f in enumerate(index.fine):
                    near += np.maximum(_squares(parts[:, s], f.astype(float)), 0)[:, codes[:, s]]
                # Rows of the query's own id are no candidates; a vector that only they have isn't one either.
                a, b = np.searchsorted(ids, query), np.searchsorted(ids, query, side="right")
                gone = np.zeros((len(r), n), bool)
                for i in np.flatnonzero(b > a):
                    which, times = np.unique(same[a[i] : b[i]], return_counts=True)
                    gone[i, which[times == sizes[which]]] = True
                near[gone] = np.inf
                if n > short_list:
                    short = np.argpartition(near, short_list, axis=1)[:, :short_list]
                    rest = np.arange(len(r))[:, None]
                    exact = np.sqrt(((x[short] - q[:, None]) ** 2).sum(2))
                    exact[gone[rest, short]] = np.inf
                    last = (np.partition(exact, k - 1, axis=1)[:, k - 1] * index.factor)[:, None]
                    # Moved by at most its coding error, so a vector that can be among the nearest is ranked as well.
                    code = np.sqrt(near)
                    able = ~(code - off > last + rough + 1e-9 * (last + code + off))
                    own_q = (r**2).sum(1)[:, None]
                    able &= ~(own_q + squares - 2 * r @ own.T > (last + rough) ** 2 * (1 + 1e-9) + 1e-12 * (own_q + squares))
                    able[rest, short] = True
                    able &= ~gone
                    i, s = np.nonzero(able)
                else:
                    i, s = np.nonzero(~gone)
                d = np.concatenate([*(np.sqrt(((x[s[j : j + EXACT]] - q[i[j : j + EXACT]]) ** 2).sum(1)) for j in range(0, len(i), EXACT)), np.zeros(0)])
                i, s, d = _nearest_of(i, s, d, k, True)
                # Of equal vectors the first ``k`` can matter that are not the query's own.
                times = np.minimum(sizes[s], k + (b - a)[i])
                one_by_one = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row = members[np.repeat(starts[s], times) + one_by_one]
                i, d = np.repeat(i, times), np.repeat(d, times)
                other = ids[row] != query[i]
                i, row, d = _nearest_of(i[other], row[other], d[other], k)
                out["query_id"].append(query[i])
                out["vec_id"].append(ids[row])
                out["score"].append(d)
        return pd.DataFrame({c: np.concatenate([*v, np.zeros(0)]).astype(float if c == "score" else np.int64) for c, v in out.items()})

    return block


def _nearest_of(i: np.ndarray, row: np.ndarray, d: np.ndarray, k: int, ties: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest rows of each query ``i``, ties to the smaller row, or all that tie with the last."""
    order = np.lexsort((row, d, i))
    i, row, d = i[order], row[order], d[order]
    first = np.searchsorted(i, i)
    place = np.arange(len(i)) - first
    keep = place < k
    if ties and len(i):
        last = np.minimum(first + k, np.searchsorted(i, i, side="right")) - 1
        keep |= d <= d[last]
    return i[keep], row[keep], d[keep]


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query row."""
    rows = usable(vectors, id_col, vector_col)
    total = rows.count()
    spark = vectors.sparkSession
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = _sampled(rows, total, max(SAMPLE, SHARE * lists_for(total)))
    index = fit(np.array(sample["v"].tolist(), float), total, k)
    named = rows.withColumn("rid", F.monotonically_increasing_id())
    placed = stage(named.mapInPandas(_assigned(index), "list int, vec_id long, rid long, codes binary, v array<double>"), "ivf")
    queries = rows.where(is_query).select("vec_id", "v").distinct()
    found = stage(_found(queries, placed, index, index.probes, k), "found")
    if index.probes < len(index.coarse):
        some = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"))
        few = queries.join(some, "vec_id", "left_anti")
        if not few.isEmpty():
            found = found.join(few.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(_found(few, placed, index, len(index.coarse), k))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(queries: DataFrame, placed: DataFrame, index: Index, probes: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the nearest of each searched block of the probed lists."""
    asked = stage(queries.mapInPandas(_probed(index, probes), "query_id long, lists array<int>, q array<double>"), "queries")
    pairs = asked.select("query_id", F.explode("lists").alias("list"), "q")
    loads = pairs.groupBy("list").agg(F.count("*").alias("asked")).join(placed.groupBy("list").agg(F.count("*").alias("held")), "list")
    loads = stage(loads.select("list", F.ceil(F.col("held") / BLOCK).cast("int").alias("salts"), F.ceil(F.col("asked") / QUERIES).cast("int").alias("turns")), "loads")
    loads = bounded(loads)
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    left = pairs.join(loads, "list").withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int")).withColumn("salt", F.explode(upto("salts")))
    right = placed.join(loads, "list").withColumn("salt", F.pmod(F.xxhash64("rid"), F.col("salts")).cast("int")).withColumn("turn", F.explode(upto("turns")))
    key = ["list", "salt", "turn"]
    return left.select(*key, "query_id", "q").groupBy(*key).cogroup(right.select(*key, "vec_id", "codes", "v").groupBy(*key)).applyInPandas(_search(index, k), "query_id long, vec_id long, score double")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)
