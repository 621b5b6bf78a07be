import hashlib
import random

import numpy as np

from protolens.llm import suffix_dedup as D


def brute(rows):
    """(id, n_bytes, removed, spans, digest) by a dictionary of all 50-byte strings."""
    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    least = {}
    for i, t in raw:
        if i is not None:
            for s in range(len(t) - D.LENGTH + 1):
                g = t[s : s + D.LENGTH]
                if i < least.get(g, i + 1):
                    least[g] = i
    out = []
    for i, t in raw:
        cover = bytearray(len(t))
        if i is not None:
            for s in range(len(t) - D.LENGTH + 1):
                if least[t[s : s + D.LENGTH]] < i:
                    cover[s : s + D.LENGTH] = b"\1" * D.LENGTH
        kept = bytes(c for c, x in zip(t, cover, strict=True) if not x)
        spans = sum(bool(x) and (k == 0 or not cover[k - 1]) for k, x in enumerate(cover))
        out.append((i, len(t), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in D.remove_repeats(df).collect()), key=str)


def test_documents(odd_docs, odd_rows, no_docs):
    assert got(odd_docs) == brute(odd_rows)
    assert got(no_docs) == []


def test_mosaics(spark, monkeypatch):
    """Texts pieced together from a few passages, in blocks of a few texts and small pieces."""
    monkeypatch.setattr(D, "BLOCK", 4000)
    monkeypatch.setattr(D, "_PIECE", 300)
    monkeypatch.setattr(D, "REFINED", 5)
    r = random.Random(9)
    bits = ["".join(r.choice("ab ") for _ in range(r.choice([10, 30, 49, 50, 51, 70, 200]))) for _ in range(25)] + ["z" * 60, "yx" * 40, "é日" * 30]
    rows = [(r.randrange(150), "".join(r.choice(bits) if r.random() < 0.6 else "".join(r.choice("cdef") for _ in range(r.randrange(60))) for _ in range(r.randrange(8)))) for _ in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(df) == brute(rows)


def test_refine():
    rng = np.random.default_rng(3)
    frames = rng.integers(0, 2, (60, D.FRAME), np.uint8)
    frames[30:] = frames[:30]
    frames[40:, 60] ^= 1
    bucket = D.refine(np.ascontiguousarray(frames))
    seen = {}
    for i in range(60):
        for o in range(D.SPAN):
            assert seen.setdefault(frames[i, o : o + D.LENGTH].tobytes(), bucket[i, o]) == bucket[i, o]
    assert len(set(seen.values())) == len(seen)


def test_anchors_do_not_depend_on_place():
    rng = np.random.default_rng(1)
    t = rng.integers(97, 100, 5000).astype(np.uint8)
    p, h = D.anchors(t, np.array([5000]))
    q, g = D.anchors(np.concatenate([t[:77], t]), np.array([77, 5077]))
    assert set(zip(p.tolist(), h.tolist(), strict=True)) <= set(zip((q - 77).tolist(), g.tolist(), strict=True))
    assert len(p) < 0.15 * 5000


def test_anchors_at_ends_of_blocks(monkeypatch):
    """Every place of a least q-gram is an anchor, at all lengths around a multiple of a piece."""
    monkeypatch.setattr(D, "_PIECE", 300)
    rng = np.random.default_rng(6)
    for n in range(590, 660):
        t = rng.integers(97, 123, n).astype(np.uint8)
        h = D._grams(t, D.GRAM)
        want = {s + int(i) for s in range(n - D.LENGTH + 1) for i in np.flatnonzero(h[s : s + D.SPAN] == h[s : s + D.SPAN].min())}
        assert set(D.anchors(t, np.array([n]))[0].tolist()) == want


def test_repeat_at_the_end_of_a_block(spark):
    """The block is 40 bytes longer than a piece; its last string has an anchor in those only."""
    r = random.Random(2)
    tail = ""
    while not tail or D._grams(np.frombuffer(tail.encode(), np.uint8), D.GRAM).argmin() < 10:
        tail = "".join(r.choice("abcdefgh") for _ in range(D.LENGTH))
    first = tail + "".join(r.choice("abcdefgh") for _ in range(D._PIECE + 40 - 2 * D.LENGTH))
    rows = [(1, first), (2, tail)]
    out = got(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert out == brute(rows)
    assert out[1][2] == D.LENGTH


def test_runs_of_nul_bytes(spark):
    rows = [(1, "one" + "\0" * 70 + "more"), (2, "two" + "\0" * 60 + "other"), (3, "\0" * 50), (4, "x" * 24 + "\0" * 26), (5, "y" + "x" * 24 + "\0" * 26 + "z"), (6, "\0" * 49)]
    out = got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert out == brute(rows)
    assert [r[2] for r in out] == [0, 60, 50, 0, 50, 0]
