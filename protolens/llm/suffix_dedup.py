"""Suffix-array dedup: bytes inside a 50-byte string that an earlier document has.

Two suffixes are in one bucket at depth 50 if their first 50 bytes agree. Buckets are found by
bucket-pointer refinement: suffixes start in buckets of their first 8 bytes, and a bucket is
refined by sorting on the bucket identifiers of the suffixes that start 8 bytes later, then
16, then 18 bytes later, each step reusing the identifiers that the last one updated.

Only suffixes that can share a bucket with another document's are refined. Every 50-byte
string holds an anchor, the q-gram of least hash in it, and equal strings hold equal anchors.
So documents are packed into blocks; (1) each block reports its distinct anchors, a few
percent of its positions, and learns which of them other documents have; (2) around those it
cuts contexts, the bytes that all 50-byte strings with that anchor span, and reports the
distinct ones with their least document; contexts of equal anchors meet, are refined as above,
and each block learns for each context the least document and which of its strings an earlier
one has; (3) blocks cover and cut their texts. A block reports an anchor or context once,
however often it occurs, so the most frequent passage costs one row for each block.

Phases are written to the shared folder. All comparisons end in bytes; hashes only gather.

Results for odd input: a null text has no bytes; a null id matches nothing and loses nothing;
rows with one id never match each other, nor do repeated rows; texts under 50 bytes stay
whole; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protolens.llm._util import discard, stage, table

LENGTH, GRAM = 50, 26
#: Anchors are least among so many q-grams; a context reaches so far beside its anchor.
SPAN = LENGTH - GRAM + 1
SIDE = LENGTH - GRAM
FRAME = LENGTH + SIDE
#: Bytes of a block of texts, unless one text is longer.
BLOCK = 2 << 20
#: Anchors of one part of the exchange, on average; parts of the contexts are this much finer.
PART, FINER = 1_000_000, 4
#: Contexts that are refined together, unless one bucket has more.
REFINED = 4096
_PIECE, _ROWS = 1 << 16, 1 << 12
_NULL = np.iinfo(np.int64).min


def _u(x: int) -> np.uint64:
    return np.uint64(x & (1 << 64) - 1)


def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def planes(numbers: np.ndarray) -> bytes:
    """Numbers compressed byte by byte place, as most high bytes agree."""
    return squeeze(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes())


def numbers(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def pack(ids: list[int | None], texts: list[bytes]) -> bytes:
    at = np.array([_NULL if i is None else i for i in ids], np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return squeeze(b"".join([struct.pack("<q", len(ids)), at.tobytes(), sizes.tobytes(), *texts]))


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ends of texts, bytes of all texts)."""
    raw = zstandard.decompress(payload)
    (n,) = struct.unpack_from("<q", raw)
    ids = np.frombuffer(raw, np.int64, n, 8)
    sizes = np.frombuffer(raw, np.int64, n, 8 + 8 * n)
    return ids, sizes.cumsum(), np.frombuffer(raw, np.uint8, offset=8 + 16 * n)


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(block, payload): documents packed in the order in which their partition has them."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = TaskContext.get().partitionId() << 32, 0
        ids, texts, size = [], [], 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([first + number]), pa.array([pack(ids, texts)], pa.binary())], names=["block", "payload"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if size and size + len(t) > BLOCK:
                    yield full()
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(i)
                texts.append(t)
                size += len(t) + 1
        if ids:
            yield full()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long"), text).mapInArrow(over, "block long, payload binary")


def _grams(t: np.ndarray, q: int) -> np.ndarray:
    """A mixed hash of the q bytes at each position, by doubling."""
    base, done, out, power, h = 0x9E3779B97F4A7C15, 0, None, 1, t.astype(np.uint64)
    with np.errstate(over="ignore"):
        while power <= q:
            if q & power:
                if out is None:
                    out, done = h.copy(), power
                else:
                    n = len(out) - power
                    out = out[:n] * _u(pow(base, power, 1 << 64)) + h[done : done + n]
                    done += power
            n = len(h) - power
            h = h[:n] * _u(pow(base, power, 1 << 64)) + h[power:] if power * 2 <= q else h
            power *= 2
        out = out[: len(t) - q + 1]
        out ^= out >> _u(32)
        out *= _u(0xD6E8FEB86659FD93)
        out ^= out >> _u(29)
        out *= _u(0xA0761D6478BD642F)
        out ^= out >> _u(32)
    return out


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over each ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x = pick(x[: len(x) - done], x[done:])
        done *= 2
    rest = width - done
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(t: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of all 50-byte strings that lie inside a text."""
    positions, hashes = [], []
    starts = np.concatenate([[0], ends[:-1]])
    valid = np.zeros(len(t) + 1, np.int32)
    long = ends - starts >= LENGTH
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - LENGTH + 1, -1)
    valid = valid.cumsum() > 0
    for at in range(0, len(t) - GRAM + 1, _PIECE):  # anchors lie up to the last q-gram
        # strings that start in this piece, and those before it whose anchors may lie in it
        low, high = max(0, at - SPAN + 1), min(len(t), at + _PIECE + LENGTH + SPAN)
        part = t[low:high]
        if len(part) < LENGTH:
            continue
        h = np.maximum(_grams(part, GRAM), _u(1))  # NUL bytes hash to 0, which marks strings that cross texts
        least = _slide(h, SPAN, np.minimum)
        least[~valid[low : low + len(least)]] = 0
        pad = np.zeros(SPAN - 1, np.uint64)
        reach = _slide(np.concatenate([pad, least, pad]), SPAN, np.maximum)
        own = np.flatnonzero((h == reach) & (h != 0))
        own = own[(own + low >= at) & (own + low < at + _PIECE)]
        positions.append(own + low)
        hashes.append(h[own])
    if not positions:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(positions), np.concatenate(hashes)


def _block_anchors(payload: bytes) -> tuple:
    ids, ends, t = unpack(payload)
    p, h = anchors(t, ends)
    doc = np.searchsorted(ends, p, side="right")
    named = ids[doc] != _NULL
    return ids, ends, t, p[named], h[named], doc[named]


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _report(bits: int):
    """Distinct anchors of a block; the lowest bit tells whether two of its documents have it."""
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("keys", pa.binary())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, _, _, _, h, doc = _block_anchors(payload.as_py())
                if not len(h):
                    continue
                keys = h >> _u(1)
                order = np.argsort(keys, kind="stable")
                keys, own = keys[order], ids[doc[order]]
                at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                several = np.minimum.reduceat(own, at) < np.maximum.reduceat(own, at)
                keys = keys[at] << _u(1) | several.astype(np.uint64)
                part = (keys >> _u(64 - bits)).astype(np.int64)
                cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
                yield from _table(schema, [(int(part[a]), block, keys[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]).to_batches()

    return over


_SHARED = pa.schema([("block", pa.int64()), ("keys", pa.binary())])


def _shared(group: pa.Table) -> pa.Table:
    """For each block, which of its anchors in this part more than one document has."""
    owners = group.column("block").to_numpy()
    each = [np.frombuffer(k.as_py(), np.uint64) for k in group.column("keys")]
    keys = np.concatenate(each)
    order = np.argsort(keys >> _u(1), kind="stable")
    plain = keys[order] >> _u(1)
    at = np.flatnonzero(np.concatenate([[True], plain[1:] != plain[:-1]]))
    sizes = np.diff(np.concatenate([at, [len(plain)]]))
    many = (sizes > 1) | (np.maximum.reduceat((keys[order] & _u(1)).astype(np.int8), at) > 0)
    keep = np.zeros(len(keys), bool)
    keep[order] = np.repeat(many, sizes)
    cut = np.concatenate([[0], np.cumsum([len(k) for k in each])])
    rows = []
    for i, k in enumerate(each):
        own = k[keep[cut[i] : cut[i + 1]]] >> _u(1)
        if len(own):
            rows.append((int(owners[i]), own.tobytes()))
    return _table(_SHARED, rows)


def _mixed(words: np.ndarray, turn: int) -> np.ndarray:
    """A hash of each row of 64-bit words."""
    odd = np.random.default_rng(turn).integers(0, 1 << 63, words.shape[1], np.uint64) << _u(1) | _u(1)
    with np.errstate(over="ignore"):
        mixed = (words ^ (words >> _u(31))) * odd
        mixed = (mixed ^ (mixed >> _u(29))) * _u(0xBF58476D1CE4E5B9)
    return np.bitwise_xor.reduce(mixed ^ (mixed >> _u(32)), axis=1)


def _classes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a representative of each class, class of each row) of equal rows of 64-bit words.

    Rows are gathered by a hash and compared word by word; another hash is tried if that
    joined rows that differ.
    """
    turn = 1
    while True:
        _, first, same = np.unique(_mixed(words, turn), return_index=True, return_inverse=True)
        if (words == words[first[same]]).all():
            return first, same
        turn += 1


def contexts(t: np.ndarray, starts: np.ndarray, ends: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The bytes around each anchor as 10 words: SIDE before, the rest of FRAME from it, zero
    outside the text; the lengths of both sides fill the last bytes."""
    left, right = np.minimum(SIDE, p - starts), np.minimum(SIDE, ends - p - GRAM)
    out, offset = np.zeros((len(p), 80), np.uint8), np.arange(-SIDE, LENGTH)[None, :]
    for a in range(0, len(p), _ROWS):
        q, b = p[a : a + _ROWS, None], a + _ROWS
        inside = (offset >= -left[a:b, None]) & (offset < GRAM + right[a:b, None])
        out[a:b, :FRAME] = np.where(inside, t[np.clip(q + offset, 0, len(t) - 1)], 0)
    out[:, FRAME], out[:, FRAME + 1] = left, right
    return out.view(np.uint64)


_CUT = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("words", pa.binary()), ("docs", pa.binary())])


def _cut_contexts(bits: int):
    """Distinct contexts of a block by part, and (part -1) the places of all its contexts."""

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table(_CUT, [])
        name = left.column("block")[0].as_py()
        shared = np.sort(np.concatenate([np.frombuffer(k.as_py(), np.uint64) for k in right.column("keys")]))
        ids, ends, t, p, h, doc = _block_anchors(left.column("payload")[0].as_py())
        keys = h >> _u(1)
        at = np.minimum(np.searchsorted(shared, keys), len(shared) - 1)
        own = shared[at] == keys
        p, keys, doc = p[own], keys[own], doc[own]
        starts = np.concatenate([[0], ends[:-1]])
        words = contexts(t, starts[doc], ends[doc], p)
        first, same = _classes(words)
        members = np.argsort(same, kind="stable")
        group = np.flatnonzero(np.concatenate([[True], np.diff(same[members]) > 0]))
        named = ids[doc[members]]
        least, most = np.minimum.reduceat(named, group), np.maximum.reduceat(named, group)
        keys, words = keys[first], words[first]
        order = np.argsort(keys, kind="stable")
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        part = (keys[order] >> _u(63 - bits)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        rows = [(-1, name, 0, planes(np.diff(p, prepend=0).astype(np.int32)), planes(number[same]))]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            o = order[a:b]
            rows.append((int(part[a]), name, int(a), squeeze(words[o].tobytes()), planes(np.concatenate([least[o], most[o] - least[o]]))))
        return _table(_CUT, rows)

    return block


def refine(frames: np.ndarray) -> np.ndarray:
    """Bucket of the LENGTH bytes at each of the first SPAN offsets of each frame of bytes.

    Bucket-pointer refinement: buckets of 8 bytes, then of 16, 32 and LENGTH, each sorted on
    the bucket at its offset and the bucket that lies as far behind as is already sorted.
    """
    n = len(frames)
    wide = np.lib.stride_tricks.sliding_window_view(frames, 8, axis=1)[:, : FRAME - 7]
    words = np.ascontiguousarray(wide).view(np.uint64)[:, :, 0]
    bucket = np.unique(words, return_inverse=True)[1].reshape(words.shape).astype(np.int64)
    depth = 8
    while depth < LENGTH:
        later = min(depth, LENGTH - depth)
        wanted = FRAME - (depth + later) + 1
        pair = bucket[:, :wanted] * (int(bucket.max()) + 1) + bucket[:, later : later + wanted]
        bucket = np.unique(pair, return_inverse=True)[1].reshape(n, wanted).astype(np.int64)
        depth += later
    return bucket[:, :SPAN]


def _earlier(words: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each context a mask of its strings that a context of a smaller document has."""
    raw = np.ascontiguousarray(words).view(np.uint8)
    left, right = raw[:, FRAME].astype(int), raw[:, FRAME + 1].astype(int)
    bucket = refine(raw[:, :FRAME])
    offset = np.arange(SPAN)[None, :]
    inside = (offset >= SIDE - left[:, None]) & (offset <= right[:, None])
    own = np.broadcast_to(low[:, None], inside.shape)
    best = np.full(int(bucket.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(best, bucket[inside], own[inside])
    earlier = inside & (best[bucket] < own)
    return (earlier.astype(np.uint32) << np.arange(SPAN, dtype=np.uint32)[None, :]).sum(axis=1, dtype=np.uint32)


_VERDICT = pa.schema([("block", pa.int64()), ("number", pa.binary()), ("least", pa.binary()), ("mask", pa.binary())])


def _judge(group: pa.Table) -> pa.Table:
    """For each context of each block: its least document, and for that one a mask of the
    strings in it that a smaller document has."""
    each = [np.frombuffer(zstandard.decompress(w.as_py()), np.uint64).reshape(-1, 10) for w in group.column("words")]
    sizes = [len(w) for w in each]
    docs = [numbers(d.as_py(), np.int64).reshape(2, -1) for d in group.column("docs")]
    words, least, most = np.concatenate(each), np.concatenate([d[0] for d in docs]), np.concatenate([d[0] + d[1] for d in docs])
    del each, docs
    first, same = _classes(words)
    low, high = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), np.iinfo(np.int64).min)
    np.minimum.at(low, same, least)
    np.maximum.at(high, same, most)
    mask = np.zeros(len(first), np.uint32)
    middle = np.zeros((len(first), 32), np.uint8)
    middle[:, :GRAM] = words[first].view(np.uint8)[:, SIDE : SIDE + GRAM]
    _, bucket, count = np.unique(_mixed(middle.view(np.uint64), 0), return_inverse=True, return_counts=True)
    several = np.flatnonzero(count[bucket] > 1)
    several = several[np.argsort(bucket[several], kind="stable")]
    while len(several):  # whole buckets of equal anchors, about REFINED contexts at a time
        n = REFINED + int(np.searchsorted(bucket[several[REFINED:]], bucket[several[REFINED - 1]], side="right")) if len(several) > REFINED else len(several)
        own, several = several[:n], several[n:]
        mask[own] = _earlier(words[first[own]], low[own])
    cuts = (high > low) | (mask > 0)
    out, at = [], 0
    for block, base, n in zip(group.column("block").to_pylist(), group.column("first").to_pylist(), sizes, strict=True):
        own = same[at : at + n]
        at += n
        keep = np.flatnonzero(cuts[own])
        if len(keep):
            out.append((block, planes((base + keep).astype(np.int32)), planes(low[own[keep]]), planes(mask[own[keep]])))
    return _table(_VERDICT, out)


_DONE = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def _cover(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of a block without the bytes that its verdicts cover."""
    if not left.num_rows:
        return _table(_DONE, [])
    ids, ends, t = unpack(left.column("payload")[0].as_py())
    starts = np.concatenate([[0], ends[:-1]])
    edge = np.zeros(len(t) + 1, np.int64)
    places = [r for r in right.to_pylist() if r["part"] == -1] if right.num_rows else []
    found = [r for r in right.to_pylist() if r["part"] == -2] if right.num_rows else []
    if places and found:
        p, same = numbers(places[0]["words"], np.int32).cumsum(dtype=np.int64), numbers(places[0]["docs"], np.int32)
        doc = np.searchsorted(ends, p, side="right")
        low, mask = np.full(int(same.max()) + 1, np.iinfo(np.int64).max), np.zeros(int(same.max()) + 1, np.uint32)
        for r in found:
            number = numbers(r["number"], np.int32)
            low[number] = numbers(r["docs"], np.int64)
            mask[number] = numbers(r["words"], np.uint32)
        after = ids[doc] > low[same]
        q, d = p[after], doc[after]
        np.add.at(edge, np.maximum(starts[d], q - SIDE), 1)
        np.add.at(edge, np.minimum(ends[d], q + LENGTH), -1)
        some = np.flatnonzero(~after & (mask[same] > 0) & (ids[doc] == low[same]))
        for offset in range(SPAN):
            q = p[some[(mask[same[some]] >> np.uint32(offset) & np.uint32(1)) > 0]] - SIDE + offset
            np.add.at(edge, q, 1)
            np.add.at(edge, q + LENGTH, -1)
    covered = edge.cumsum()[:-1] > 0
    raw, out = t.tobytes(), []
    change = np.flatnonzero(np.diff(covered.astype(np.int8))) + 1
    for i, a, b in zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True):
        lo, hi = np.searchsorted(change, [a, b], side="left")
        inner = [a, *(x for x in change[lo:hi].tolist() if x > a), b]
        spans, kept = [], []
        for s, e in zip(inner[:-1], inner[1:], strict=True):
            if s == e:
                continue
            if covered[s]:
                spans.append({"start": s - a, "end": e - a})
            else:
                kept.append(raw[s:e])
        out.append((None if i == _NULL else i, b - a, spans, b"".join(kept)))
    return _table(_DONE, out)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept): removed runs of bytes and the bytes that stay."""
    spark = docs.sparkSession
    packed = stage(blocks(docs, id_col, text_col), "blocks", "none")
    size = docs.select(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("n")).first()["n"] or 0
    bits = max(1, int(np.ceil(np.log2(max(2, size * 2 / (SPAN + 1) / PART)))))
    reports = packed.mapInArrow(_report(bits), "part long, block long, keys binary")
    shared = stage(reports.groupBy("part").applyInArrow(_shared, "block long, keys binary"), "anchors", "none")
    bits = min(62, bits + int(np.log2(FINER)))
    cut = "part long, block long, first long, words binary, docs binary"
    found = stage(packed.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_cut_contexts(bits), cut), "contexts")
    discard(spark, shared)
    verdicts = stage(found.where("part >= 0").groupBy("part").applyInArrow(_judge, "block long, number binary, least binary, mask binary"), "verdicts")
    about = found.where("part = -1").select("part", "block", "words", "docs", F.lit(None).cast("binary").alias("number"))
    about = about.unionByName(verdicts.select(F.lit(-2).cast("long").alias("part"), "block", F.col("mask").alias("words"), F.col("least").alias("docs"), "number"))
    return packed.groupBy("block").cogroup(about.groupBy("block")).applyInArrow(_cover, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
