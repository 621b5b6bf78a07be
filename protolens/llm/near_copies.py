"""Groups of near copies: SimHash finds most, an exact join what fingerprints miss.

Two texts are near copies if their sets of five words (A-Z lower-cased; a shorter text is one
shingle) have a Jaccard similarity of SIMILARITY or more; a group is a component of all such
pairs. Texts of the same words in the same order are one class from the start, so only one
text of each class goes on.

1. Fingerprints of all texts are probed by the generalised pigeonhole of ``simhash``: a text
   without another fingerprint within WIDE bits has nothing to do in this phase.
2. The others meet in cells of the same probes, now with the sizes and parity sketches of
   their shingle sets, which bound the similarity from above. First neighbours in a cell are
   compared, which joins large groups without all their pairs; then all pairs of a cell that
   lie in different groups. Whole texts decide.
3. What lies beyond WIDE bits is found by an exact join: two similar sets share one of their
   first fifth of shingles in any common order (rare ones first). These travel packed, a row
   for each task and heap of hashes; only those that texts of different groups share go on,
   and only pairs between groups are compared.

A key that more than ``block`` records share is cut into blocks and each pair of blocks meets
on its own; blocks of one large group do not meet each other, so such a group costs its
members times the few that are not in it. Every phase is written to the shared folder.

Results for odd input: null texts and texts without words are copies of each other; of rows
with equal id and text one is kept; a null id is least; empty tables give no rows; columns of
any other name are kept as they are.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from protolens.llm._util import bounded, small_batches, spare, stage, text_of
from protolens.llm.components import components
from protolens.llm.simhash import SEED, _few, _partitions, fingerprint

#: Near copies: Jaccard similarity of sets of so many words.
WORDS, SIMILARITY = 5, 0.8
#: Words and bits of the search by fingerprints.
PAIR, WIDE = 2, 9
#: Rows beside each other in a cell that are compared first.
REACH = 3
#: Turns in which rows beside each other are compared, in another order each time, at most; and the
#: links for each thousand rows below which a turn is the last.
TURNS, WORTH = 6, 5
#: Texts of the sample that orders shingles, and texts of it that make a shingle common.
ORDERED, COMMON = 10_000, 4
#: Common shingles that tasks are told of; the others are ordered as rare ones.
TOLD = 100_000
#: Places of a sketch of a set, a multiple of 64.
SKETCH = 512
#: Keys before a record's own that it holds, so that a pair isn't told again under each that it shares.
BEFORE = 4
#: Records of a key that meet in one task.
BLOCK = 4096
#: Records of a key that are compared to find out whether a fingerprint has a partner; all of
#: a longer key are taken to have one.
LONGEST = 1 << 16
#: Records of a heap of first shingles, on average, and that a task holds before it deals them.
HEAP, _HELD = 250_000, 1_000_000
_PAIRS = 250_000

_CELL = "c long, side int, role int, u long, root long, n int, at int, fp long, sketch binary"


def shingles(text: str | None, words: int = WORDS) -> set[tuple[str, ...]]:
    """The set of ``words`` neighbouring words, A-Z lower-cased; a shorter text is one of its own."""
    own = (text or "").encode().lower().split()
    return {tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))}


def hashes(own: list[bytes], words: int = WORDS) -> np.ndarray:
    """Distinct hashes of the shingles of a text's words, ascending."""
    joined = b" ".join(own)
    if len(own) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = (np.fromiter(map(len, own), np.int64, len(own)) + 1).cumsum() - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(own) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64))


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _name(own: list[bytes]) -> int:
    """The class of a text: a hash of all its words in order."""
    return xxhash.xxh64_intdigest(b" ".join(own), SEED)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _few(batches):
        texts = batch.column(2).to_pylist()
        own = [_split(t) for t in texts]
        made = [_signed([_name(x) for x in own]), _signed([fingerprint(t, PAIR) for t in texts]), pa.array([len(x) for x in own], pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["row", "doc_id", "u", "fp", "words"])


def _keys(fp: np.ndarray, parts: list[tuple[int, int]], probes: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(32-bit keys, row, role, part) of all records of fingerprints; role 0 is indexed and probes,
    2 probes. Keys that meet by chance cost a comparison and nothing else."""
    keys, rows, roles, own = [], [], [], []
    with np.errstate(over="ignore"):
        for i, (mask, threshold) in enumerate(parts):
            bits = [b for b in range(64) if mask >> b & 1] if probes else []
            flips = [0] + ([1 << b for b in bits] if threshold > 0 else []) + ([1 << a | 1 << b for n, a in enumerate(bits) for b in bits[n + 1 :]] if threshold > 1 else [])
            value = (fp.view(np.uint64) & np.uint64(mask))[:, None] ^ np.array(flips, np.uint64)[None, :]
            mixed = (value ^ np.uint64(i + 1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            keys.append((mixed >> np.uint64(32)).astype(np.int64).ravel())
            rows.append(np.repeat(np.arange(len(fp)), len(flips)))
            roles.append(np.tile(np.array([0] + [2] * (len(flips) - 1), np.int32), len(fp)))
            own.append(np.full(len(rows[-1]), i, np.int32))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(roles), np.concatenate(own)


def _probed(parts: list[tuple[int, int]]):
    """(k, fp, role): the records of distinct fingerprints."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches, 1024):
            fp = batch.column(0).to_numpy()
            k, row, role, _ = _keys(fp, parts)
            yield pa.RecordBatch.from_arrays([pa.array((k - (1 << 31)).astype(np.int32)), pa.array(fp[row]), pa.array(role.astype(np.int8))], names=["k", "fp", "role"])

    return over


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the length."""
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]])


def _with_partner(distance: int, longest: int):
    """Indexed fingerprints with another one within the distance in their key; rows are sorted
    by key. Keys at the ends of a partition, which may go on in the next one, and keys of more
    than ``longest`` records are not compared: all of theirs are reported."""

    def tested(k: np.ndarray, fp: np.ndarray, role: np.ndarray, outright: set[int]) -> np.ndarray:
        found = []
        cut = _runs(k)
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            x = fp[s:e]
            own = x[role[s:e] == 0]
            if not len(own):
                continue
            if int(k[s]) in outright:
                found.append(own)
                continue
            step = max(1, (1 << 21) // len(x))
            for at in range(0, len(own), step):
                some = own[at : at + step, None]
                bits = np.bitwise_count((some ^ x[None, :]).view(np.uint64))
                found.append(own[at : at + step][((bits <= distance) & (some != x[None, :])).any(axis=1)])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        outright: set[int] = set()
        pack = lambda fp: pa.RecordBatch.from_arrays([pa.array(fp)], names=["fp"])
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy() for c in batch.columns]
            if held is None:
                outright.add(int(now[0][0]))
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last:
                yield pack(tested(*(c[:last] for c in held), outright))
                held = [c[last:].copy() for c in held]
            if len(held[0]) > longest:
                outright.add(int(held[0][-1]))
                yield pack(tested(*held, outright))
                held = [c[:0] for c in held]
        if held is not None and len(held[0]):
            yield pack(tested(*held, {int(held[0][-1])}))

    return over


def _placed(parts: list[tuple[int, int]], probes: bool):
    """Records (``_CELL``) of nodes (u, root, n, fp, sketch); ``at`` is the part of the key."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches, 512):
            k, row, role, part = _keys(batch.column(3).to_numpy(), parts, probes)
            own = batch.take(pa.array(row))
            none = pa.array(np.full(len(k), -1, np.int32))
            columns = [pa.array(k), none, pa.array(role), own.column(0), own.column(1), own.column(2), pa.array(part), own.column(3), own.column(4)]
            yield pa.RecordBatch.from_arrays(columns, names=["c", "side", "role", "u", "root", "n", "at", "fp", "sketch"])

    return over


def _cells(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` with keys of more than ``block`` records cut into cells.

    Records of such a key are dealt to blocks, those of a root with more than ``block`` records
    to blocks of its own. Each pair of blocks is a cell, but for two of the same root.
    """
    hot = stage(rows.groupBy("c").agg(F.count("*").alias("rows")).where(F.col("rows") > block).select("c"), "hot-keys")
    n = hot.count()
    if not n:
        return rows
    own = rows.select("c", "u", "root").join(bounded(hot, n), "c").groupBy("c", "root").agg(F.count("*").alias("rows"))
    large = F.col("rows") > block
    kinds = own.groupBy("c", large.alias("large"), F.when(large, F.col("root")).otherwise(F.lit(0)).alias("of")).agg(F.ceil(F.sum("rows") / block).cast("int").alias("blocks"))
    layout = kinds.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("large", "of", "blocks"))).alias("kinds"))
    layout = layout.select("c", F.flatten(F.transform("kinds", lambda x: F.array_repeat(F.struct(x["large"].alias("large"), x["of"].alias("of")), x["blocks"]))).alias("blocks"))
    layout = stage(layout, "hot-layout")
    known = rows.join(bounded(layout, n), "c", "left").withColumn("mine", F.coalesce(F.exists("blocks", lambda x: x["large"] & (x["of"] == F.col("root"))), F.lit(False)))
    same = lambda i: F.col("blocks")[i]["large"].eqNullSafe(F.col("mine")) & (~F.col("mine") | (F.col("blocks")[i]["of"] == F.col("root")))
    every = F.sequence(F.lit(0), F.size("blocks") - 1)
    known = known.withColumn("own", F.filter(every, same)).withColumn("own", F.col("own")[F.pmod(F.xxhash64("u", F.lit(1)), F.size("own")).cast("int")])
    meets = F.filter(every, lambda i: ~(F.col("mine") & same(i)))
    cold = known.where("blocks is null").select(*rows.columns)
    cut = known.where("blocks is not null").withColumn("other", F.explode(meets))
    cell = F.xxhash64("c", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own")).cast("int")
    return cold.unionByName(cut.withColumns({"c": cell, "side": side}).select(*rows.columns))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole runs of the first column, by which rows are sorted; a binary column
    becomes rows of 64-bit words."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), -1) if pa.types.is_binary(c.type) else c.to_numpy() for c in batch.columns]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        last = int(np.searchsorted(held[0], held[0][-1]))
        if last:
            yield [c[:last] for c in held]
            held = [c[last:].copy() for c in held]
    if held is not None:
        yield held


def _partners(similarity: float, distance: int | None, reach: int | None, parts: list[tuple[int, int]] | None = None):
    """(a, b): pairs of a cell's records of different roots that lie within ``reach`` rows of each
    other (None: all), without those that fingerprints (``distance``), sizes, places in the
    common order or sketches rule out. With ``parts`` a pair of fingerprints counts in one cell
    only of all in which it meets: the first part whose bits are near enough, indexed under the
    lesser name. What follows a sketch are the keys just before this one in the text's order: where
    all pairs meet, one whose records share such a key has met under that already."""
    share = similarity / (1 + similarity)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, side, role, u, root, n, at, fp, sketch in _whole(batches):
            cut = _runs(c)
            mixed = np.minimum.reduceat(root, cut[:-1]) < np.maximum.reduceat(root, cut[:-1])
            keep = np.repeat(mixed, np.diff(cut))
            c, side, role, u, root, n, at, fp, sketch = (x[keep] for x in (c, side, role, u, root, n, at, fp, sketch))
            sketch, before = np.split(sketch, [SKETCH // 64], axis=1)
            i, d, held, count = np.arange(len(c)), 0, [], 0
            while len(i) and (reach is None or d < reach):
                d += 1
                i = i[: np.searchsorted(i, len(c) - d)]
                i = i[c[i] == c[i + d]]
                j = i + d
                ok = (root[i] != root[j]) & ((side[i] < 0) | (side[i] != side[j])) & ((role[i] == 0) | (role[j] == 0))
                if distance is not None:
                    ok &= np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= distance
                    most = np.minimum(n[i], n[j])
                    if parts:
                        some = np.flatnonzero(ok)
                        x, y = i[some], j[some]
                        bits = (fp[x] ^ fp[y]).view(np.uint64)
                        first = np.stack([np.bitwise_count(bits & np.uint64(m)) <= t for m, t in parts]).argmax(axis=0)
                        named = np.where(u[x] < u[y], role[x], role[y]) == 0
                        ok[some] = (at[x] == first) & (at[y] == first) & named
                else:
                    most = np.minimum(n[i] - at[i], n[j] - at[j])  # in common, if this is the first of it
                both = n[i].astype(np.int64) + n[j]
                ok = np.flatnonzero(ok & (most >= share * both - 1e-9))
                x, y = i[ok], j[ok]
                differ = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64)
                near = differ <= (1 - 2 * share) * both[ok] + 1e-9
                x, y = x[near], y[near]
                if reach is None and before.shape[1]:
                    p, q = before[x][:, :, None], before[y][:, None, :]
                    new = ~((p == q) & (p != 0)).any(axis=(1, 2))
                    x, y = x[new], y[new]
                x, y = u[x], u[y]
                held.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
                count += len(x)
                if count > _PAIRS:
                    yield _pairs(held)
                    held, count = [], 0
            if count:
                yield _pairs(held)

    return over


def _pairs(held: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate(held), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _meet(cells: DataFrame, distance: int | None, parts: list[tuple[int, int]] | None = None) -> DataFrame:
    whole = cells.repartition("c").sortWithinPartitions("c", "root", "u")
    return whole.mapInArrow(_partners(SIMILARITY, distance, None, parts), "a long, b long").distinct()


def _alike(words: int, similarity: float):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, set] | None = None
        for batch in _few(batches):
            keep = []
            for name, a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if held is None or held[0] != name:
                    held = (name, shingles(a, words))
                other = shingles(b, words)
                both = len(held[1] & other)
                keep.append(both + 1e-9 >= similarity * (len(held[1]) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    return over


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, n, wide): a sketch of a text with twice as many places as its set has shingles."""
    for batch in _few(batches):
        names, sizes, made = [], [], []
        for t in batch.column(0).to_pylist():
            own = _split(t)
            h = hashes(own)
            places = max(SKETCH, 1 << (2 * len(h) - 1).bit_length())
            odd = np.bincount((h % np.uint64(places)).astype(np.int64), minlength=places) & 1
            names.append(_name(own))
            sizes.append(len(h))
            made.append(np.packbits(odd.astype(np.uint8)).tobytes())
        yield pa.RecordBatch.from_arrays([_signed(names), pa.array(sizes, pa.int32()), pa.array(made, pa.binary())], names=["u", "n", "wide"])


def _possible(similarity: float):
    """The pairs (a, b, na, wa, nb, wb) that their wide sketches allow; a sketch of twice the
    places is folded onto one of half."""
    share = similarity / (1 + similarity)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, x, m, y in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                while len(x) != len(y):
                    x, y = (x, y) if len(x) > len(y) else (y, x)
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                differ = int(np.bitwise_count(x ^ y).sum(dtype=np.int64))
                keep.append(min(n, m) >= share * (n + m) - 1e-9 and differ <= (1 - 2 * share) * (n + m) + 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    return over


def wide_sketches(texts: DataFrame) -> DataFrame:
    """(u, n, wide): sketches as wide as their texts (t) are long, a twentieth of the texts."""
    return stage(texts.select("t").mapInArrow(_wide, "u long, n int, wide binary"), "wide")


def possible(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, wide: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) that wide sketches allow, so only texts of pairs that are nearly similar
    have to meet."""
    wide = wide_sketches(texts) if wide is None else wide
    side = lambda c: wide.select(F.col("u").alias(c), F.col("n").alias(f"n{c}"), F.col("wide").alias(f"w{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "wa", "nb", "wb")
    return stage(both.mapInArrow(_possible(similarity), "a long, b long"), "possible")


def alike(pairs: DataFrame, texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of names whose whole texts are as similar; ``texts`` has (u, t)."""
    full = pairs.join(texts.select(F.col("u").alias("b"), F.col("t").alias("tb")), "b").join(texts.select(F.col("u").alias("a"), F.col("t").alias("ta")), "a")
    return full.select("a", "b", "ta", "tb").mapInArrow(_alike(words, similarity), "a long, b long")


def _sketch(h: np.ndarray) -> bytes:
    """The parities of a set of hashes in SKETCH places; two sets differ in at least as many
    shingles as their sketches in places."""
    odd = np.bincount((h % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, n, sketch, t): the size of a text's set of shingles and its sketch."""
    for batch in _few(batches):
        texts = batch.column(0).to_pylist()
        own = [_split(t) for t in texts]
        h = [hashes(x) for x in own]
        n = pa.array(np.fromiter(map(len, h), np.int32, len(h)))
        yield pa.RecordBatch.from_arrays([_signed([_name(x) for x in own]), n, pa.array([_sketch(x) for x in h], pa.binary()), pa.array(texts, pa.string())], names=["u", "n", "sketch", "t"])


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes, ascending; counts) of shingles that several texts of a bounded sample have, and how
    many texts there are for each of the sample."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            h = [hashes(_split(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64))], names=["h"])

    every = max(1, texts.count() // ORDERED)
    some = texts.where(F.pmod("row", F.lit(every)) == 0).select("t").mapInArrow(over, "h long")
    rows = some.groupBy("h").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(TOLD).collect()
    h, n = np.array([r["h"] for r in rows], np.int64).view(np.uint64), np.array([r["count"] for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], n[order], every


def _prefix(h: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first hashes of a set in an order that all sets share, rare ones first. Two sets of
    the similarity share one of these."""
    known, times = common
    rank = np.zeros(len(h), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        rank = np.where(known[at] == h, times[at], 0)
    return h[np.lexsort((h, rank))][: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]


_PACKED = np.dtype([("c", "<u8"), ("num", "<i8"), ("at", "<i4"), ("root", "<u4")])
_DEALT = pa.schema([("heap", pa.int64()), ("blob", pa.binary())])


def _planes(r: np.ndarray) -> bytes:
    """Records compressed byte by byte place, as most high bytes agree."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(r.view(np.uint8).reshape(len(r), -1).T).tobytes())


def _records(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(_PACKED.itemsize, -1)
    return np.ascontiguousarray(raw.T).view(_PACKED).ravel()


def _dealt(similarity: float, common: tuple[np.ndarray, np.ndarray], hot: np.ndarray, heaps: int):
    """(heap, blob): the first shingles of texts (t, root) by heaps of hashes, packed with the
    text's number, the place in the order and a hash of the root. Heap -1 holds each text's
    number, name, root, size and sketch. Records of ``hot`` shingles are spread over the heaps."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, about, size = TaskContext.get().partitionId() << 33, [], [], 0

        def full() -> pa.RecordBatch:
            r = np.concatenate(held)
            heap = ((r["c"] >> np.uint64(32)) * np.uint64(heaps) >> np.uint64(32)).astype(np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, r["c"]), len(hot) - 1)
                heap = np.where(hot[at] == r["c"], r["num"] % heaps, heap)
            order = np.lexsort((r["c"], heap))
            r, heap = r[order], heap[order]
            cut = _runs(heap)
            rows = [(int(heap[a]), _planes(r[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)] + [(-1, zstandard.compress(b"".join(about)))]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(_DEALT)], schema=_DEALT)

        for batch in _few(batches):
            for t, root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = _split(t)
                h = hashes(own)
                u = int(np.uint64(_name(own)).view(np.int64))
                root = u if root is None else root
                first = _prefix(h, similarity, common)
                r = np.empty(len(first), _PACKED)
                r["c"], r["num"], r["at"], r["root"] = first, number, np.arange(len(first)), root & 0xFFFFFFFF
                held.append(r)
                about.append(struct.pack("<qqqi", number, u, root, len(h)) + _sketch(h))
                number, size = number + 1, size + len(r)
                if size >= _HELD:
                    yield full()
                    held, about, size = [], [], 0
        if held:
            yield full()

    return over


def _sharing(hot: np.ndarray):
    """(c, num, at): the records of a heap whose shingle texts of several roots have."""

    def over(group: pa.Table) -> pa.Table:
        r = np.concatenate([_records(x.as_py()) for x in group.column("blob")])
        r = r[np.argsort(r["c"], kind="stable")]
        cut = _runs(r["c"])
        mixed = np.minimum.reduceat(r["root"], cut[:-1]) < np.maximum.reduceat(r["root"], cut[:-1])
        mixed |= np.isin(r["c"][cut[:-1]], hot)
        r = r[np.repeat(mixed, np.diff(cut))]
        return pa.table({"c": pa.array(np.ascontiguousarray(r["c"]).view(np.int64)), "num": pa.array(np.ascontiguousarray(r["num"])), "at": pa.array(np.ascontiguousarray(r["at"]))})

    return over


def _about(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(num, u, root, n, sketch) of heap -1."""
    kind = np.dtype([("num", "<i8"), ("u", "<i8"), ("root", "<i8"), ("n", "<i4"), ("sketch", f"V{SKETCH // 8}")])
    for batch in batches:
        for blob in batch.column(0):
            r = np.frombuffer(zstandard.decompress(blob.as_py()), kind)
            columns = [pa.array(np.ascontiguousarray(r[c])) for c in ("num", "u", "root", "n")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in r["sketch"]], pa.binary())], names=list(kind.names))


def pairs_within(nodes: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """(a, b): the pairs of ``nodes`` (u, root, n, fp, sketch) of different roots within
    ``distance`` bits whose sizes and sketches allow the similarity."""
    parts = _partitions(nodes.select("fp").distinct(), distance)
    if not parts:
        return nodes.sparkSession.createDataFrame([], "a long, b long")
    rows = nodes.select("u", "root", "n", "fp", "sketch").mapInArrow(_placed(parts, True), _CELL)
    return _meet(_cells(rows, block), distance, parts)


def with_partners(values: DataFrame, distance: int, longest: int = LONGEST) -> DataFrame:
    """(fp): the distinct fingerprints of ``values`` that have another within ``distance`` bits,
    and some more: see ``_with_partner``."""
    parts = _partitions(values, distance)
    if not parts:
        return values.select("fp")
    rows = values.select("fp").mapInArrow(_probed(parts), "k int, fp long, role tinyint")
    return rows.repartitionByRange("k", "fp").sortWithinPartitions("k").mapInArrow(_with_partner(distance, longest), "fp long").distinct()


def _rooted(nodes: DataFrame, groups: DataFrame | None) -> DataFrame:
    """``nodes`` with the root of their group; a node without links is its own."""
    if groups is None:
        return nodes.withColumn("root", F.col("u"))
    return nodes.join(bounded(groups.select(F.col("node").alias("u"), "root")), "u", "left").withColumn("root", F.coalesce("root", "u"))


def _by_prints(texts: DataFrame, nodes: DataFrame, distance: int, block: int, longest: int) -> tuple[DataFrame, DataFrame] | None:
    """(pairs of similar texts, pairs that were compared), found by fingerprints."""
    values = nodes.groupBy("fp").agg(F.count("*").alias("rows"))
    some = with_partners(values.select("fp"), distance, longest).unionByName(values.where("rows > 1").select("fp")).distinct()
    some = stage(nodes.join(bounded(stage(some, "with-partners")), "fp", "left_semi").select("row", "u", "fp"), "probing")
    n = some.count()
    if not n:
        return None
    known = texts.join(bounded(some.select("row"), n), "row", "left_semi").select("t").mapInArrow(_sketched, "u long, n int, sketch binary, t string")
    known = stage(known.join(bounded(some.select("u", "fp"), n), "u"), "near-texts")
    parts = _partitions(known.select("fp").distinct(), distance)
    wide = wide_sketches(known)
    cells = lambda groups: _rooted(known, groups).select("u", "root", "n", "fp", "sketch").mapInArrow(_placed(parts, False), _CELL)
    similar, tested, groups = _in_turns(cells, lambda pairs: alike(possible(pairs, known, wide=wide), known), distance, None, None, None, n)
    met = pairs_within(_rooted(known, groups), distance, block)
    met = stage(met.join(tested, ["a", "b"], "left_anti"), "met")
    return similar.unionByName(stage(alike(possible(met, known, wide=wide), known), "similar")), tested.unionByName(met)


def _in_turns(cells, verified, distance: int | None, similar: DataFrame | None, tested: DataFrame | None, groups: DataFrame | None, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(similar, tested, groups) after rows beside each other in a cell were compared, by
    fingerprint first and then in orders by chance, which brings a large group together with a
    few pairs for each row instead of all. It only spares later work: all pairs of rows that are
    still in different groups are compared after it, so no link depends on these orders.
    ``cells`` makes the records of groups, ``verified`` tells similar pairs."""
    for turn in range(TURNS):
        rows = cells(groups).withColumn("o", F.xxhash64("u", F.lit(turn)) if turn or distance is None else F.col("fp"))
        rows = rows.repartitionByRange("c", "o", "u").sortWithinPartitions("c", "o", "u").drop("o")
        found = rows.mapInArrow(_partners(SIMILARITY, distance, REACH), "a long, b long").distinct()
        found = stage(found if tested is None else found.join(tested, ["a", "b"], "left_anti"), "beside")
        tested = found if tested is None else tested.unionByName(found)
        more = stage(verified(found), "similar")
        links = more.count()
        if links or groups is None:
            similar = more if similar is None else similar.unionByName(more)
            groups = stage(components(similar), "groups")
        if links * 1000 <= n * WORTH:
            break
    return similar, tested, groups


def _by_shingles(texts: DataFrame, nodes: DataFrame, similar: DataFrame | None, groups: DataFrame | None, tested: DataFrame | None, words: int, block: int) -> DataFrame:
    """``similar`` and pairs of similar texts of different groups, found by shared first shingles.

    ``words`` of all texts set the number of heaps. A shingle that the sample says is in more
    than a heap's records is spread over all heaps and goes on whatever texts have it.
    """
    known, times, every = _common(texts)
    heaps = max(1, int(words * (1 - SIMILARITY)) // HEAP)
    hot = known[times * every > HEAP]
    none = F.lit(None).cast("long")
    rooted = texts.select("t", none.alias("root")) if groups is None else texts.join(bounded(groups.join(nodes, groups["node"] == nodes["u"]).select("row", "root")), "row", "left").select("t", "root")
    dealt = stage(rooted.mapInArrow(_dealt(SIMILARITY, (known, times), hot, heaps), "heap long, blob binary"), "first-shingles", "none")
    shared = dealt.where("heap >= 0").groupBy("heap").applyInArrow(_sharing(hot), "c long, num long, at int")
    about = dealt.where("heap < 0").select("blob").mapInArrow(_about, "num long, u long, root long, n int, sketch binary")
    about = stage(about, "about")
    order = Window.partitionBy("num").orderBy("at")
    packed = lambda c: F.unhex(F.lpad(F.hex(F.coalesce(c, F.lit(0).cast("long"))), 16, "0"))
    shared = shared.withColumn("before", F.concat(*[packed(F.lag("c", i).over(order)) for i in range(1, BEFORE + 1)]))
    shared = stage(shared, "shared-shingles")

    def cells(groups: DataFrame | None) -> DataFrame:
        own = _rooted(about.drop("root"), groups).join(shared, "num")
        return own.select("c", F.lit(-1).cast("int").alias("side"), F.lit(0).alias("role"), "u", "root", "n", "at", F.lit(0).cast("long").alias("fp"), F.concat("sketch", "before").alias("sketch"))

    def of(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("u")).unionByName(pairs.select(F.col("b").alias("u"))).distinct()
        return texts.join(bounded(stage(wanted.join(nodes.select("u", "row"), "u"), "meeting")), "row").select("u", "t")

    def verified(pairs: DataFrame) -> DataFrame:
        near = possible(pairs, of(pairs))
        return alike(near, stage(of(near), "meeting-texts"))

    similar, tested, groups = _in_turns(cells, verified, None, similar, tested, groups, nodes.count())
    met = _meet(_cells(cells(groups), block), None)
    met = stage(met.join(tested, ["a", "b"], "left_anti"), "met")
    return similar.unionByName(stage(verified(met), "similar"))


def near_copies(docs: DataFrame, distance: int = WIDE, block: int = BLOCK, longest: int = LONGEST, rest: bool = True) -> tuple[DataFrame, DataFrame]:
    """(members, prints): (u, root) of the classes that have near copies, and (row, doc_id, u, fp,
    words) of all rows, which are named by a hash of id and text.

    With ``rest`` groups are exact but for collisions of 64-bit hashes; without it, pairs whose
    fingerprints lie further apart than ``distance`` bits are not looked for.
    """
    name = F.xxhash64("doc_id", text_of())
    base = small_batches(docs).select(name.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
    prints = stage(base.mapInArrow(_prints, "row long, doc_id long, u long, fp long, words long"), "prints")
    nodes = stage(prints.groupBy("u", "fp").agg(F.min(F.struct("doc_id", "row"))["row"].alias("row")), "classes")
    others = stage(prints.join(nodes.select("row"), "row", "left_anti").select("row").distinct(), "class-members")
    texts = base.select("row", "t").join(bounded(others), "row", "left_anti")
    found = _by_prints(texts, nodes, distance, block, longest)
    similar, tested = found or (None, None)
    groups = None if similar is None else stage(components(similar), "groups")
    if rest:
        words = prints.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
        groups = components(_by_shingles(texts, nodes, similar, groups, tested, words, block))
    if groups is None:
        groups = docs.sparkSession.createDataFrame([], "node long, root long")
    return groups.select(F.col("node").alias("u"), "root"), prints


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one of least id, a null id
    first."""
    u = spare(docs, "row_name")
    named = docs.withColumn(u, F.xxhash64("doc_id", text_of()))
    twice = stage(named.groupBy(u).count().where("count > 1").select(u), "repeated")
    again = twice.count()
    if again:
        twice = bounded(twice, again)
        named = stage(named.join(twice, u, "left_anti").unionByName(named.join(twice, u, "left_semi").dropDuplicates([u])), "rows-once")
    members, prints = near_copies(named)
    members = stage(members, "near-groups")
    several = prints.groupBy("u").agg(F.count("*").alias("rows")).where("rows > 1").select("u")
    touched = stage(several.unionByName(members.select("u")).distinct(), "touched")
    rows = _rooted(prints.join(bounded(touched), "u", "left_semi"), members.withColumnRenamed("u", "node"))
    keep = rows.groupBy("root").agg(F.min(F.struct("doc_id", "row"))["row"].alias("keep"))
    drop = stage(rows.join(keep, "root").where("row <> keep").select(F.col("row").alias(u)).distinct(), "near-copies")
    return named.join(bounded(drop), u, "left_anti").drop(u)
