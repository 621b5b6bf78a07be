"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each leaf of the tree holds the rank of a pair of neighbouring symbols with its position in
the low bits, each inner node the least of its children. The root is therefore the leftmost
merge of lowest rank; a merge changes three leaves, each updated in logarithmic time, until
no mergeable pair remains. A piece of n symbols takes O(n log n) time however long it is, so
texts without any white space need no limit. The trees of short pieces are rows of one matrix
and step together.

A pass over the documents in their own partitions; nothing is shuffled. Workers keep the
codec and a bounded memo of pieces. The vocabulary file is a parameter; executors read it
from the same installed package.

Results for odd input: a null or empty text has no ids and decodes to the empty text; control
strings of special tokens in a text become their ids, as the library does; null ids of
documents, repeated rows and other columns are passed on; empty tables give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protolens.llm._util import small_batches, table, text_of

#: Pieces of a worker's memo; when it is full only those at hand stay.
MEMO = 100_000
#: Rows of a returned batch, and its characters unless one text has more.
BATCH, CHARS = 512, 1 << 20
#: Code points with the Unicode property White_Space.
_SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0  -     　"
#: Fixed value: the byte-level split of text before the merges.
_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_NONE, _LOW = 1 << 62, 32
#: Of trees that are built together: no rank, bits of a position, widest tree, trees at once.
_FREE, _BITS, _WIDEST, _TOGETHER = 1 << 30, 6, 64, 8192
#: Pieces that are merged together; a longer text is split as a stream.
_GROUP, _LONG = 200_000, 1 << 20
#: Multiplier and shift of the table of ranks.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in shown)
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Codec:
    """Encoder and decoder of a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.start = [vocab[c] for c in letters]
        self.rank, self.merged = {}, []
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[a] << 24 | vocab[b], r)
            self.merged.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes = [b""] * size
        for word, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in word)
        for word, i in self.special.items():
            self.bytes[i] = word.encode()
        self.start_array, self.merged_array = np.array(self.start), np.array(self.merged)
        bits = max(8, (3 * len(self.rank)).bit_length())  # at most a third of the slots is used
        self.shift, self.slots, self.slot_ranks = np.uint64(64 - bits), np.full(1 << bits, -1), np.zeros(1 << bits, np.int64)
        for key, r in self.rank.items():
            slot = (key * int(_SPREAD) & (1 << 64) - 1) >> 64 - bits
            while self.slots[slot] >= 0:
                slot = (slot + 1) % len(self.slots)
            self.slots[slot], self.slot_ranks[slot] = key, r
        self.find, self.iterate = regex.compile(_SPLIT).findall, regex.compile(_SPLIT).finditer
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.memo: dict[str, tuple[int, ...]] = {}

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """The ids of one piece of any length, by a segment tree of its own."""
        start, rank, merged = self.start, self.rank.get, self.merged
        symbols = [start[b] for b in raw]
        n = len(symbols)
        if n < 2:
            return tuple(symbols)
        width = 1 << (n - 2).bit_length()
        tree = [_NONE] * (2 * width)
        for i in range(n - 1):
            r = rank(symbols[i] << 24 | symbols[i + 1])
            if r is not None:
                tree[width + i] = r << _LOW | i
        for j in range(width - 1, 0, -1):
            a, b = tree[2 * j], tree[2 * j + 1]
            tree[j] = a if a < b else b
        after, before, mask = list(range(1, n + 1)), list(range(-1, n - 1)), (1 << _LOW) - 1
        while (top := tree[1]) != _NONE:
            i = top & mask
            j = after[i]
            k = after[j]
            symbols[i], symbols[j] = merged[top >> _LOW], -1
            after[i] = k
            if k < n:
                before[k] = i
            h = before[i]
            for at in (j, i, h):
                if at < 0 or at >= n - 1:
                    continue
                value = _NONE
                if at != j and (to := after[at]) < n:
                    r = rank(symbols[at] << 24 | symbols[to])
                    if r is not None:
                        value = r << _LOW | at
                at += width
                if tree[at] == value:
                    continue
                tree[at] = value
                while at > 1:
                    other = tree[at ^ 1]
                    at >>= 1
                    least = value if value < other else other
                    if tree[at] == least:
                        break
                    tree[at] = value = least
        return tuple(s for s in symbols if s >= 0)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, _FREE where they do not merge or one is absent."""
        key = a << 24 | b
        slot = (key.view(np.uint64) * _SPREAD >> self.shift).astype(np.int64)
        found = self.slots[slot]
        out = np.where(found == key, self.slot_ranks[slot], _FREE)
        left = np.flatnonzero((found != key) & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)
            found = self.slots[slot[left]]
            hit = found == key[left]
            out[left[hit]] = self.slot_ranks[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
        out[(a < 0) | (b < 0)] = _FREE
        return out

    def _many(self, raw: list[bytes], width: int) -> list[tuple[int, ...]]:
        """Ids of pieces of 2 to ``width`` + 1 bytes: their segment trees are the rows of one
        matrix, and each step takes the root's merge in every row that still has one."""
        m, sizes = len(raw), np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = np.full((m, width + 2), -1, np.int64)  # the last column stays absent
        symbols[np.arange(width + 2)[None, :] < sizes[:, None]] = self.start_array[np.frombuffer(b"".join(raw), np.uint8)]
        place = np.arange(width)
        tree = np.full((m, 2 * width), _FREE << _BITS, np.int64)
        ranks = self._ranks(symbols[:, :width].ravel(), symbols[:, 1 : width + 1].ravel()).reshape(m, width)
        tree[:, width:] = np.where(ranks < _FREE, ranks << _BITS | place, _FREE << _BITS)
        w = width
        while w > 1:
            w //= 2
            tree[:, w : 2 * w] = np.minimum(tree[:, 2 * w : 4 * w : 2], tree[:, 2 * w + 1 : 4 * w : 2])
        last = width + 1
        after = np.minimum(np.arange(1, width + 3), last) * np.ones((m, 1), np.int64)
        before = np.maximum(np.arange(-1, width + 1), -1) * np.ones((m, 1), np.int64)
        rows = np.flatnonzero(tree[:, 1] < _FREE << _BITS)
        while len(rows):
            top = tree[rows, 1]
            i = top & (1 << _BITS) - 1
            j = after[rows, i]
            k = after[rows, j]
            symbols[rows, i], symbols[rows, j] = self.merged_array[top >> _BITS], -1
            after[rows, i] = k
            before[rows, k] = i
            h = before[rows, i]
            r = self._ranks(np.concatenate([symbols[rows, i], np.where(h >= 0, symbols[rows, h], -1)]), np.concatenate([symbols[rows, k], symbols[rows, i]]))
            none = np.full(len(rows), _FREE << _BITS)
            here = np.where(r[: len(rows)] < _FREE, r[: len(rows)] << _BITS | i, none)
            prior = np.where(r[len(rows) :] < _FREE, r[len(rows) :] << _BITS | h, none)
            for at, value, ok in ((j, none, j < width), (i, here, None), (h, prior, h >= 0)):
                own, at, value = (rows, at, value) if ok is None else (rows[ok], at[ok], value[ok])
                at = at + width
                tree[own, at] = value
                for _ in range(width.bit_length() - 1):
                    at >>= 1
                    tree[own, at] = np.minimum(tree[own, 2 * at], tree[own, 2 * at + 1])
            rows = rows[tree[rows, 1] < _FREE << _BITS]
        kept = symbols >= 0
        flat, ends = symbols[kept].tolist(), kept.sum(axis=1).cumsum().tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _learn(self, pieces: set[str]) -> dict[str, tuple[int, ...]]:
        """The ids of all of ``pieces``, from the memo or merged now."""
        memo = self.memo
        new = [p for p in pieces if p not in memo]
        if len(memo) + len(new) > MEMO:
            memo = self.memo = {p: memo[p] for p in pieces if p in memo}
        classes: dict[int, tuple[list[str], list[bytes]]] = {}
        long: dict[str, tuple[int, ...]] = {}
        for p in new:
            raw = p.encode()
            if len(raw) < 2 or len(raw) > _WIDEST + 1:
                (long if len(raw) > 2 else memo)[p] = self.merge(raw)
            else:
                own = classes.setdefault(max(4, 1 << (len(raw) - 2).bit_length()), ([], []))
                own[0].append(p)
                own[1].append(raw)
        for width, (names, raws) in classes.items():
            for at in range(0, len(raws), _TOGETHER):
                memo.update(zip(names[at : at + _TOGETHER], self._many(raws[at : at + _TOGETHER], width), strict=True))
        return memo | long if long else memo

    def _pieces(self, text: str) -> Iterator[str | int]:
        """The pieces of a text in order, special tokens as their ids."""
        parts = [text] if self.cut is None or not any(s in text for s in self.special) else self.cut(text)
        for i, part in enumerate(parts):
            if i % 2:
                yield self.special[part]
            elif len(part) > _LONG:
                yield from (m[0] for m in self.iterate(part))
            else:
                yield from self.find(part)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; pieces that several texts share are merged once."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        group: list[tuple[int, list[str]]] = []
        held = 0

        def flush() -> None:
            known = self._learn({p for _, own in group for p in own if type(p) is str}) if group else {}
            for n, own in group:
                if self.cut is not None and any(type(p) is int for p in own):
                    ids = chain.from_iterable((p,) if type(p) is int else known[p] for p in own)
                else:
                    ids = chain.from_iterable(map(known.__getitem__, own))
                out[n].append(np.fromiter(ids, np.int32))
            group.clear()

        for n, text in enumerate(texts):
            simple = len(text) <= _LONG and not any(s in text for s in self.special)
            pieces = iter([self.find(text)]) if simple else iter(lambda it=self._pieces(text): list(islice(it, _GROUP)), [])
            for own in pieces:
                group.append((n, own))
                held += len(own)
                if held >= _GROUP:
                    flush()
                    held = 0
        flush()
        return [np.concatenate(own) if own else np.zeros(0, np.int32) for own in out]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``, special tokens included."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a file; it stays for later tasks of the worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most BATCH rows and about CHARS bytes of the column ``at``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist() if pa.types.is_string(batch.column(at).type) else [0] * batch.num_rows
    first = held = 0
    for i, n in enumerate(sizes):
        if i > first and (i - first >= BATCH or held + n > CHARS):
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if batch.num_rows > first:
        yield batch.slice(first)


def _mapped(df: DataFrame, column: str, made: list[tuple[str, T.DataType]], run) -> DataFrame:
    """``df`` with columns computed from ``column``, a few hundred rows at a time; a name that
    ``df`` has already is refused."""
    if clash := {c.lower() for c in df.columns} & {n.lower() for n, _ in made}:
        raise ValueError(f"the table already has {', '.join(sorted(clash))}; name the made columns otherwise")
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in made)])
    at, names = df.columns.index(column), [n for n, _ in made]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, at):
                yield pa.RecordBatch.from_arrays([*batch.columns, *run(batch.column(at))], names=[*batch.schema.names, *names])

    return small_batches(df).mapInArrow(over, schema)


_IDS = T.ArrayType(T.IntegerType())


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))


def encode(df: DataFrame, path: str, text_col: str = "text", made: str = "ids") -> DataFrame:
    """``df`` with the array of ids of a text column."""
    return _mapped(df, text_col, [(made, _IDS)], lambda texts: [_lists(codec(path).encode_all([t or "" for t in texts.to_pylist()]))])


def decode(df: DataFrame, path: str, ids_col: str = "ids", made: str = "decoded") -> DataFrame:
    """``df`` with the text of an array of ids."""
    return _mapped(df, ids_col, [(made, T.StringType())], lambda lists: [pa.array([codec(path).decode(x.values.to_numpy().tolist()) if x.is_valid else "" for x in lists], pa.string())])


def round_trip(df: DataFrame, path: str, text_col: str = "text", made: tuple[str, str] = ("ids", "decoded")) -> DataFrame:
    """``df`` with the ids of a text column and the text that those ids decode to: encode and
    decode in one pass, by one worker."""

    def run(texts: pa.Array) -> list[pa.Array]:
        c = codec(path)
        ids = c.encode_all([t or "" for t in texts.to_pylist()])
        return [_lists(ids), pa.array([c.decode(x.tolist()) for x in ids], pa.string())]

    return _mapped(df, text_col, [(made[0], _IDS), (made[1], T.StringType())], run)


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of whole texts, by encode() and decode()."""
    path = path or public_vocabulary()
    both = round_trip(docs.select("doc_id", text_of().alias("text")), path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_documents(table(spark, sf_dir, "documents"))
