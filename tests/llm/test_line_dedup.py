import hashlib
import random
from collections import defaultdict

import pytest
from conftest import CLASHING, DOCS, row

from protolens.llm import line_dedup

low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=40, min_docs=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    held = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add((r[0] is not None, r[0] or 0))
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        gone = [len(held[key(x)]) >= min_docs and max(held[key(x)]) != (r[0] is not None, r[0] or 0) for x in lines]
        out.append((r[0], len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return sorted(out, key=str)


def some(seed=1):
    r = random.Random(seed)
    shared = [f"shared line number {i} " + "word " * (4 + i % 9) for i in range(12)]
    odd = ["", "   ", "\t", "short", "É" * 45, "é" * 45, "🙂" * 40, "🙂" * 39, "\x0b" + "vertical " * 6 + "\x0c", "A" * 60_000]
    rows = []
    for i in range(80):
        pick = [r.choice(shared) if r.random() < 0.5 else r.choice(odd) if r.random() < 0.5 else f"own {r.random()} " * 3 for _ in range(r.randrange(0, 15))]
        pick = [x.upper() if r.random() < 0.3 else "  " + x + "\r" if r.random() < 0.3 else x for x in pick]
        rows.append(row(r.choice([i, i, i, 3, None]), "\n".join(pick)))
    rows += [row(500, "\n".join(f"line {i} of a very long text with many lines" for i in range(20_000)))]
    rows += [row(501 + j, "\n".join(f"line {i} of a very long text with many lines" for i in range(0, 20_000, 2))) for j in range(5)]
    rows += [row(900, shared[0]), row(900, shared[0]), row(None, None), row(None, shared[0] + "\n"), row(-4, shared[0])]
    return rows


def got(spark, rows, **how):
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    out = line_dedup.without_repeats(df, n_lines="a", n_dropped="b", **how)
    assert out.columns == [*df.columns, "a", "b"]
    found = out.collect()
    assert {tuple(r)[5:-2] for r in found} <= {(7, "x", 1, *CLASHING)}
    return sorted(((r["doc_id"], r["a"], r["b"], r["text"]) for r in found), key=str)


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_lines(spark, batches):
    rows = some()
    assert got(spark, rows, batches=batches) == brute(rows)


def test_shuffled_sides(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(line_dedup, "bounded", lambda df, *_: df)
    rows = some(2)
    assert got(spark, rows) == brute(rows)


def test_odd(spark, odd_docs, odd_rows, no_docs):
    out = line_dedup.without_repeats(odd_docs, n_lines="a", n_dropped="b")
    assert sorted(((r["doc_id"], r["a"], r["b"], r["text"]) for r in out.collect()), key=str) == brute(odd_rows)
    assert line_dedup.without_repeats(no_docs).count() == 0


def test_runs(spark):
    """Lines of a batch that no run holds are fresh, whatever the levels; sums stay whole."""
    store, r = line_dedup.LineRuns(spark, fanout=2, buckets=3), random.Random(8)
    seen, counts = set(), defaultdict(int)
    for _ in range(7):
        batch = {(r.randrange(60), d) for d in range(30)}
        df = spark.createDataFrame([(hashlib.md5(str(h).encode()).digest(), d) for h, d in batch], "h binary, doc_id long")
        own = {h: max(d for x, d in batch if x == h) for h, _ in batch}
        fresh = {bytes(f["h"]): f["keep"]["doc_id"] for f in store.add(df).collect()}
        assert fresh == {hashlib.md5(str(h).encode()).digest(): d for h, d in own.items() if h not in seen}
        seen |= set(own)
        for h, _ in batch:
            counts[h] += 1
    assert [len(level) for level in store.levels] == [1, 1, 1]
    assert {bytes(x["h"]): x["n"] for x in store.found_in(4).collect()} == {hashlib.md5(str(h).encode()).digest(): n for h, n in counts.items() if n >= 4}
    store.close()
