"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints of whole texts are taken next to the data; only distinct fingerprints, with
their least document, go on. Their bits are grouped by correlation into partitions, and a
dynamic programme gives each partition a threshold of its own, so that the thresholds plus
one sum to the distance plus one: two fingerprints within the distance agree within the
threshold in at least one partition. The costs it weighs are candidate counts estimated on a
bounded sample. Each fingerprint is indexed under its exact value in each partition and
probes the values within the threshold; candidates are verified on all bits.

A partition value that more than ``BUCKET`` fingerprints share is not paired: its
fingerprints meet at the points one bit away from each instead (two fingerprints within two
bits share such a point, and all that meet at one are within two bits of each other), which
is exact and takes 65 rows for each fingerprint. So no group is paired with itself.

Results for odd input: null texts and texts without words have fingerprint zero, which links
like any other; null ids belong to components but are never their id unless all are null;
repeated rows share a component; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from protolens.llm._util import bounded, stage, table, text_of
from protolens.llm.components import components

DISTANCE, SHINGLE, SEED = 2, 3, 42
#: Fingerprints of the sample that partitions and thresholds are planned on.
SAMPLE = 2_000
#: Fingerprints of a partition value that are compared pair by pair.
BUCKET = 128
#: The widest threshold of a partition; wider ones have too many values to probe.
WIDEST = 2
#: Compared pairs that cost as much as one record that is sent.
PROBE = 20.0
_PART = 8192


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a whole text; shingles are hashed in bounded parts."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = (np.fromiter(map(len, words), np.int64, len(words)) + 1).cumsum() - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    begin, stop = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(begin), _PART):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(begin[at : at + _PART], stop[at : at + _PART], strict=True)], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(begin)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _few(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of texts in slices, so that few texts are copied at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            made = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(over, "doc_id long, fp long")


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """64 bits in ``parts`` groups of nearly equal size, correlated bits together."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    bits -= bits.mean(axis=0)
    scale = np.sqrt((bits**2).mean(axis=0)) + 1e-12
    corr = np.abs(bits.T @ bits / max(1, len(bits)) / np.outer(scale, scale))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(64)), []
    for i in range(parts):
        size = (64 - sum(map(len, groups))) // (parts - i)
        own = [max(left, key=lambda b: (corr[b, sorted(left)].sum(), -b))]
        left.discard(own[0])
        while len(own) < size:
            nxt = max(left, key=lambda b: (corr[b, own].mean(), -b))
            own.append(nxt)
            left.discard(nxt)
        groups.append(sorted(own))
    return groups


def plan(sample: np.ndarray, total: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(mask of bits, threshold) of each probed partition, by dynamic programming.

    The cost of a partition at a threshold is its number of candidate pairs, scaled from the
    pairs of the sample, plus its number of probes, which cost PROBE pairs each.
    """
    sample = np.unique(sample.astype(np.uint64))
    if not len(sample):
        return []
    pairs = np.bitwise_xor.outer(sample, sample)[np.triu_indices(len(sample), 1)]
    scale = (total / max(2, len(sample))) ** 2
    best: tuple[float, list[tuple[int, int]]] | None = None
    for parts in (2, 3, 4, 5, 6):
        if distance + 1 > parts * (WIDEST + 1):
            continue
        groups = group_bits(sample, parts)
        costs = []
        for own in groups:
            mask = np.uint64(sum(1 << b for b in own))
            found = np.bincount(np.bitwise_count(pairs & mask), minlength=65)[: distance + 1].cumsum() * scale
            variants, ways = 0, 1
            row = [0.0]
            for e in range(min(distance, WIDEST) + 1):
                variants += ways
                ways = ways * (len(own) - e) // (e + 1)
                row.append(PROBE * total * (1.0 + (variants if e else 0)) + found[e])
            costs.append((int(mask), row))
        reach: dict[int, tuple[float, list[tuple[int, int]]]] = {0: (0.0, [])}
        for mask, row in costs:
            step: dict[int, tuple[float, list[tuple[int, int]]]] = {}
            for used, (cost, chosen) in reach.items():
                for e in range(min(distance + 1 - used, len(row) - 1) + 1):
                    new = (cost + row[e], chosen + ([(mask, e - 1)] if e else []))
                    if used + e not in step or new[0] < step[used + e][0]:
                        step[used + e] = new
            reach = step
        if best is None or reach[distance + 1][0] < best[0]:
            best = reach[distance + 1]
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(value: Column, mask: int, threshold: int) -> Column:
    """All values within ``threshold`` (0, 1 or 2) flipped bits of the mask."""
    bits = [b for b in range(64) if mask >> b & 1]
    flips = [0]
    if threshold > 0:
        flips += [1 << b for b in bits]
    if threshold > 1:
        flips += [1 << a | 1 << b for i, a in enumerate(bits) for b in bits[i + 1 :]]
    return F.transform(F.lit([_signed(f) for f in flips]), lambda f: value.bitwiseXOR(f))


def _records(nodes: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
    """(k, fp, role): role 0 is indexed and probes, 2 probes."""
    out = []
    for i, (mask, threshold) in enumerate(parts):
        value = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        key = lambda v, i=i: F.xxhash64(F.lit(i), v)
        out.append(nodes.select(key(value).alias("k"), "fp", F.lit(0).alias("role")))
        if threshold > 0:
            probes = nodes.select("fp", F.explode(_flips(value, mask, threshold)).alias("v")).where(F.col("v") != value)
            out.append(probes.select(key(F.col("v")).alias("k"), "fp", F.lit(2).alias("role")))
    return reduce(DataFrame.unionByName, out)


def _verify(distance: int):
    """Links of each value's fingerprints: indexed ones against all."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            lists = batch.column(0)
            ends = lists.offsets.to_numpy()
            flat = lists.flatten()
            fp, role = flat.field("fp").to_numpy(), flat.field("role").to_numpy()
            ends = ends - ends[0]
            for s, e in zip(ends[:-1], ends[1:], strict=True):
                x = fp[s:e]
                indexed = x[role[s:e] < 2]
                for at in range(0, len(indexed), 256):
                    some = indexed[at : at + 256]
                    i, j = np.nonzero(np.bitwise_count((some[:, None] ^ x[None, :]).view(np.uint64)) <= distance)
                    a.append(some[i])
                    b.append(x[j])
            a, b = np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])
            low, high = np.minimum(a, b), np.maximum(a, b)
            keep = low < high
            pairs = np.unique(np.stack([low[keep], high[keep]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return over


def _partitions(nodes: DataFrame, distance: int) -> list[tuple[int, int]]:
    """The plan for ``nodes``, from their number and a bounded sample."""
    sample = [r["fp"] for r in nodes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    return plan(np.array(sample, np.int64).view(np.uint64), nodes.count(), distance)


def links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) with the same components as all pairs of ``nodes`` (fp) within DISTANCE (2) bits."""
    parts = _partitions(nodes, DISTANCE)
    if not parts:
        return nodes.sparkSession.createDataFrame([], "a long, b long")
    records = _records(nodes, parts)
    many = stage(records.groupBy("k").count().where(F.col("count") > bucket).select("k"), "hot-values")
    n_many = many.count()
    cold = records if not n_many else records.join(bounded(many, n_many), "k", "left_anti")
    lists = cold.groupBy("k").agg(F.collect_list(F.struct("fp", "role")).alias("own")).where(F.size("own") > 1).select("own")
    found = lists.mapInArrow(_verify(DISTANCE), "a long, b long")
    if n_many:
        hot = records.join(bounded(many, n_many), "k", "left_semi").select("fp").distinct()
        points = hot.select("fp", F.explode(_flips(F.col("fp"), (1 << 64) - 1, 1)).alias("at"))
        met = points.groupBy("at").agg(F.collect_list("fp").alias("own")).where(F.size("own") > 1)  # 65 at most
        met = met.select(F.array_min("own").alias("a"), F.explode("own").alias("b"))
        found = found.unionByName(met.where("a < b"))
    return found


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): the least doc_id that links reach."""
    prints = stage(fingerprints(docs), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    own = components(links(nodes.select("fp")))
    rooted = nodes.join(own, nodes["fp"] == own["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = stage(rooted, "roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
