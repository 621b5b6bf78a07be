"""Search of letter strings: seeds from an inverted k-mer index, gapped local alignment, E-values.

Each k-mer of a query stands for all k-mers that score at most ``seed_loss`` less against it than
it does itself. K-mers are so long that one match in all targets is expected by chance. They meet the k-mers of the targets in an equi-join, which is by broadcast if the counted seeds of
all queries are few, so that the targets' k-mers are not shuffled; else it is a shuffled join,
whatever Spark takes their size for.
Matches are summed by (query, target, diagonal): a target is a candidate if two k-mers that do
not overlap match on one diagonal (one is enough where a string is too short for two). The
``max_seqs`` candidates with most matches on a diagonal are aligned in full; hits with an
expected number of chance hits of at most ``evalue`` are returned.

Strings are ASCII. K-mers with fewer than ``distinct`` different letters are no seeds: runs of
a letter match everywhere. Results for odd input: null strings and strings shorter than k have
no hits; letters that the scoring doesn't know match nothing but are counted; entries are
expected to be unique; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the search: candidates and hits of a query, greatest E-value.
MAX_SEQS, EVALUE = 50, 10.0
#: Seeds of all queries up to this number are broadcast.
SEED_ROWS = 500_000
_COLUMNS = ["query", "target", "score", "fident", "q_start", "q_end", "t_start", "t_end", "m"]


@dataclass(frozen=True)
class Scoring:
    """Scores of letter pairs; a gap costs ``gap_open`` for its first letter, ``gap_extend`` for
    each further one. ``karlin_k`` is the search space's factor of the E-value."""

    letters: str
    table: tuple[tuple[int, ...], ...]
    gap_open: int
    gap_extend: int
    karlin_k: float = 0.1

    @staticmethod
    def by_rule(letters: str, rule: Callable[[str, str], int], gap_open: int, gap_extend: int) -> Scoring:
        return Scoring(letters, tuple(tuple(rule(a, b) for b in letters) for a in letters), gap_open, gap_extend)

    def matrix(self) -> np.ndarray:
        """By byte; letters that are not known score as the worst pair."""
        low = min(map(min, self.table))
        out = np.full((256, 256), low, np.int64)
        at = np.frombuffer(self.letters.encode(), np.uint8)
        out[np.ix_(at, at)] = np.array(self.table)
        return out

    def decay(self, shares: dict[str, float]) -> float:
        """The lambda for which chance pairs of letters of these shares weigh one in all."""
        p = np.array([shares.get(a, 0.0) for a in self.letters])
        p = p / p.sum() if p.sum() else np.full(len(p), 1 / len(p))
        s, w = np.array(self.table, float), np.outer(p, p)
        if (s * w).sum() >= 0 or (s * (w > 0)).max() <= 0:
            raise ValueError("chance pairs must score below zero on average, and some pair above")
        low, high = 0.0, 1.0
        while (w * np.exp(high * s)).sum() < 1:
            high *= 2
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if (w * np.exp(mid * s)).sum() < 1 else (low, mid)
        return high


def closeness(letters: str, same: int = 4, step: int = 2, worst: int = -4, gap_open: int = 6, gap_extend: int = 1) -> Scoring:
    """Letters in an order that means something: the score falls with their distance."""
    return Scoring.by_rule(letters, lambda a, b: max(worst, same - step * abs(letters.index(a) - letters.index(b))), gap_open, gap_extend)


def identity(letters: str, same: int = 2, other: int = -3, gap_open: int = 7, gap_extend: int = 2) -> Scoring:
    return Scoring.by_rule(letters, lambda a, b: same if a == b else other, gap_open, gap_extend)


def kmers(strings: DataFrame, k: int, distinct: int = 1) -> DataFrame:
    """(entry, n, pos, kmer: binary) of (entry, s); substrings of bytes cost their own length."""
    s = F.col("s").cast("binary")
    every = F.transform(F.sequence(F.lit(1), F.octet_length("s") - k + 1), lambda i: F.substring(s, i, F.lit(k)))
    rows = strings.where(F.octet_length("s") >= k).select("entry", F.octet_length("s").alias("n"), F.posexplode(every).alias("pos", "kmer"))
    return varied(rows, distinct)


def varied(rows: DataFrame, distinct: int) -> DataFrame:
    """The rows whose ``kmer`` has so many different letters."""
    return rows.where(F.size(F.array_distinct(F.split(F.col("kmer").cast("string"), ""))) >= distinct) if distinct > 1 else rows


def seed_length(total: int, letters: int) -> int:
    """The k at which there are as many k-mers as letters in the targets; at least three."""
    return max(3, math.ceil(math.log(max(total, 1)) / math.log(letters)))


def similar(own: np.ndarray, scoring: Scoring, seed_loss: int, distinct: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``own``, k-mer) of all k-mers that score at most ``seed_loss`` less against a row of
    ``own`` (bytes: n x k) than it does itself, with so many different letters. Letters that are
    not known have none."""
    letters, table = np.frombuffer(scoring.letters.encode(), np.uint8), np.array(scoring.table)
    number = np.full(256, -1)
    number[letters] = np.arange(len(letters))
    code = number[own]
    rows = np.flatnonzero((code >= 0).all(axis=1))
    code = code[rows]
    best = table.max(axis=1)[code]
    short = table[code, code].sum(axis=1) - seed_loss - best.sum(axis=1)  # what may be lost of the best, below zero
    at, lost, made = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.zeros((len(rows), 0), np.uint8)
    for i in range(code.shape[1]):
        loss = lost[:, None] + table[code[at, i]] - best[at, i][:, None]
        found, letter = np.nonzero(loss >= short[at][:, None])
        at, lost, made = at[found], loss[found, letter], np.concatenate([made[found], letters[letter][:, None]], axis=1)
    if distinct > 1:
        varied = (np.diff(np.sort(made, axis=1), axis=1) != 0).sum(axis=1) + 1 >= distinct
        at, made = at[varied], made[varied]
    return rows[at], made


def _seeds(scoring: Scoring, k: int, seed_loss: int, distinct: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                own = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(-1, k)
                at, made = similar(own, scoring, seed_loss, distinct)
                ends = pa.py_buffer(np.arange(0, (len(made) + 1) * k, k, dtype=np.int32))
                found = pa.Array.from_buffers(pa.binary(), len(made), [None, ends, pa.py_buffer(made.tobytes())])
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(pa.array(at)) for c in range(3)], found], names=["query", "n_q", "q_pos", "kmer"])

    return over


def seeds(queries: DataFrame, scoring: Scoring, k: int, seed_loss: int, distinct: int = 1) -> DataFrame:
    """(query, n_q, q_pos, kmer): each query's k-mers and all that are similar enough, told where the
    k-mers lie, so that nothing but the queries is shuffled. Seeds have enough different letters, so
    the many k-mers of the targets that meet them need not be asked."""
    own = kmers(queries.repartition(_tasks(queries)), k, distinct).select(F.col("entry").alias("query"), F.col("n").alias("n_q"), F.col("pos").alias("q_pos"), F.col("kmer").alias("own"))
    return own.mapInArrow(_seeds(scoring, k, seed_loss, distinct), "query string, n_q int, q_pos int, kmer binary")


def _tasks(rows: DataFrame) -> int:
    """A number of tasks that is given, as it is not coalesced: small rows of much work."""
    spark = rows.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def candidates(queries: DataFrame, targets: DataFrame, scoring: Scoring, k: int, seed_loss: int, max_seqs: int = MAX_SEQS, distinct: int = 1, seed_rows: int = SEED_ROWS) -> DataFrame:
    """(query, target, matches): the ``max_seqs`` targets of each query with the most k-mer
    matches on a diagonal of at least two that don't overlap; ties to the smaller target."""
    asked = seeds(queries, scoring, k, seed_loss, distinct)
    # Spark estimates seeds by the size of the file that queries lie in, so without a count or a hint it may broadcast any number.
    few = kmers(queries, k, distinct).count() <= seed_rows and asked.limit(seed_rows + 1).count() <= seed_rows
    asked = F.broadcast(asked) if few else asked.hint("merge")
    held = kmers(targets, k).select(F.col("entry").alias("target"), F.col("n").alias("n_t"), F.col("pos").alias("t_pos"), "kmer")
    met = held.join(asked, "kmer").select("query", "target", "q_pos", (F.col("t_pos") - F.col("q_pos")).alias("diagonal"), F.least("n_q", "n_t").alias("n"))
    lines = met.groupBy("query", "target", "diagonal").agg(F.min("q_pos").alias("first"), F.max("q_pos").alias("last"), F.count("*").alias("matches"), F.max("n").alias("n"))
    lines = lines.where(F.col("last") - F.col("first") >= F.least(F.lit(k), F.col("n") - k))
    best = lines.groupBy("query", "target").agg(F.max("matches").alias("matches"))
    order = Window.partitionBy("query").orderBy(F.desc("matches"), "target")
    return best.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= max_seqs).drop("rk")


def align(q: bytes, t: bytes, matrix: np.ndarray, gap_open: int, gap_extend: int) -> tuple[int, int, int, int, int, int, int]:
    """(score, equal letters, columns, q_start, q_end, t_start, t_end) of the best local alignment
    with affine gaps; of equal scores the one that ends first in q, then in t.

    A row of cells at a time, each with where its alignment began and what it holds, so memory
    grows with the target alone. A gap along the row is a running maximum: opening one at a
    cell that itself ends a gap along the row is never better than extending that one.
    """
    b = np.frombuffer(t, np.uint8)
    n = len(b)
    steps, far = np.arange(n) * gap_extend, np.int64(-1 << 40)
    h, e = np.zeros(n, np.int64), np.full(n, far)
    hc, ec = np.zeros((4, n), np.int64), np.zeros((4, n), np.int64)  # began in q, in t, equal, columns
    best = (0, 0, 0, 0, 0, 0, 0)
    for i, a in enumerate(q):
        opened, longer = h - gap_open, e - gap_extend
        ec = np.where(longer > opened, ec, hc)
        ec[3] += 1
        e = np.maximum(longer, opened)
        score = matrix[a][b]
        before, carried = np.concatenate([[0], h[:-1]]), np.concatenate([np.zeros((4, 1), np.int64), hc[:, :-1]], axis=1)
        fresh = before == 0
        carried = np.where(fresh, np.array([[i], [0], [0], [0]]), carried)
        carried[1] = np.where(fresh, np.arange(n), carried[1])
        carried[2] += b == a
        carried[3] += 1
        h = before + score
        hc = carried
        down = e > h
        h, hc = np.where(down, e, h), np.where(down, ec, hc)
        h = np.maximum(h, 0)
        if n > 1:
            reach = h + steps
            top = np.maximum.accumulate(reach)
            where = np.maximum.accumulate(np.where(np.concatenate([[True], reach[1:] > top[:-1]]), np.arange(n), 0))
            along = top[:-1] - gap_open - steps[:-1]
            side = np.concatenate([[False], along > h[1:]])
            if side.any():
                at = np.flatnonzero(side)
                source = where[at - 1]
                gapped = hc[:, source]
                gapped[3] += at - source
                hc = hc.copy()
                hc[:, at] = gapped
                h[at] = along[at - 1]
        j = int(h.argmax())
        if h[j] > best[0]:
            best = (int(h[j]), int(hc[2, j]), int(hc[3, j]), int(hc[0, j]), i + 1, int(hc[1, j]), j + 1)
    return best


def best_score(q: bytes, t: bytes, matrix: np.ndarray, gap_open: int, gap_extend: int) -> tuple[int, int, int]:
    """(score, q_end, t_end) of ``align``, which costs a fraction of following where alignments began."""
    b = np.frombuffer(t, np.uint8)
    n = len(b)
    if not n:
        return 0, 0, 0
    profile = {a: matrix[a][b].astype(np.int32) for a in set(q)}
    steps = (np.arange(n) * gap_extend).astype(np.int32)
    closing = steps[:-1] + np.int32(gap_open)
    h, e, best = np.zeros(n, np.int32), np.full(n, -1 << 30, np.int32), (0, 0, 0)
    for i, a in enumerate(q):
        e = np.maximum(e - np.int32(gap_extend), h - np.int32(gap_open))
        now = profile[a].copy()
        now[1:] += h[:-1]
        np.maximum(now, e, out=now)
        np.maximum(now, 0, out=now)
        if n > 1:
            top = np.maximum.accumulate((now + steps)[:-1])
            top -= closing
            np.maximum(now[1:], top, out=now[1:])
        h = now
        j = int(h.argmax())
        if h[j] > best[0]:
            best = (int(h[j]), i + 1, j + 1)
    return best


def _aligned(scoring: Scoring, rate: float, total: int, evalue: float):
    """Alignments of pairs; those whose scores are beyond ``evalue`` are left out before the places
    where they begin are sought."""
    matrix = scoring.matrix()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for query, target, q, t in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                q, t = q.encode(), t.encode()
                score, q_end, t_end = best_score(q, t, matrix, scoring.gap_open, scoring.gap_extend)
                chance = math.log(max(1, len(q)) * max(1, total)) + math.log(scoring.karlin_k) - score * rate
                if score <= 0 or evalue <= 0 or chance > math.log(evalue) + 1e-6:  # what is just beyond goes by the filter after this
                    continue
                score, same, columns, *places = align(q[:q_end], t[:t_end], matrix, scoring.gap_open, scoring.gap_extend)
                out.append((query, target, score, same / columns if columns else 0.0, *places, len(q)))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.float64(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=_COLUMNS)

    return over


def letter_counts(strings: DataFrame, letters: str) -> dict[str, int]:
    """Number of each letter over all strings: one row of sums."""
    count = lambda a: F.coalesce(F.sum((F.length("s") - F.length(F.replace("s", F.lit(a), F.lit("")))).cast("long")), F.lit(0)).alias(a)
    row = strings.agg(*[count(a) for a in letters], F.coalesce(F.sum(F.octet_length("s").cast("long")), F.lit(0)).alias("all")).first()
    return row.asDict()


def search(queries: DataFrame, targets: DataFrame, scoring: Scoring, k: int | None = None, seed_loss: int = 0, max_seqs: int = MAX_SEQS, evalue: float = EVALUE, distinct: int = 1, seed_rows: int = SEED_ROWS) -> DataFrame:
    """Hits of ``queries`` among ``targets``, both (entry, s).

    Returns (query, target, score, bits, evalue, fident, q_start, q_end, t_start, t_end); ends
    are exclusive. ``k`` is ``seed_length`` of the targets unless given. Letter shares for the
    E-value are those of all targets.
    """
    queries, targets = (d.select(F.col("entry").cast("string").alias("entry"), "s").where("entry is not null and s is not null") for d in (queries, targets))
    counts = letter_counts(targets, scoring.letters)
    total = counts.pop("all")
    rate = scoring.decay({a: n / max(1, total) for a, n in counts.items()})
    k = k or seed_length(total, len(scoring.letters))
    pairs = candidates(queries, targets, scoring, k, seed_loss, max_seqs, distinct, seed_rows)
    side = lambda d, name, s: d.select(F.col("entry").alias(name), F.col("s").alias(s))
    pairs = pairs.join(side(queries, "query", "q"), "query").join(side(targets, "target", "t"), "target")
    dealt = pairs.select("query", "target", "q", "t").repartition(_tasks(queries), "query", "target")
    found = dealt.mapInArrow(_aligned(scoring, rate, total, evalue), "query string, target string, score long, fident double, q_start long, q_end long, t_start long, t_end long, m long")
    bits = (F.col("score") * F.lit(rate) - F.lit(math.log(scoring.karlin_k))) / F.lit(math.log(2))
    found = found.withColumn("bits", bits).withColumn("evalue", F.col("m") * F.lit(float(total)) * F.pow(F.lit(2.0), -F.col("bits")))
    return found.where((F.col("evalue") <= evalue) & (F.col("score") > 0)).select("query", "target", "score", "bits", "evalue", "fident", "q_start", "q_end", "t_start", "t_end")


def as_hits(found: DataFrame) -> DataFrame:
    """A search's result as a hit table for votes and gates: ``prob`` falls from 1 with the E-value;
    the scores that need coordinates are null."""
    none = F.lit(None).cast("double")
    return found.select("query", "target", "bits", "evalue", (1 / (1 + F.col("evalue"))).alias("prob"), none.alias("alntmscore"), "fident", none.alias("lddt"))
