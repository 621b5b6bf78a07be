import math
import random
from collections import defaultdict

import numpy as np
import pytest

from protolens.llm import vector_codes

ROWS = "vec_id long, embedding array<double>, label string, x int, own string"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Lloyd rounds without bounds, in whole numbers."""
    ok = [r for r in rows if r[1] and all(v is not None and math.isfinite(v) for v in r[1])]
    sizes = defaultdict(int)
    for r in ok:
        sizes[len(r[1])] += 1
    n = max(sizes, key=lambda s: (sizes[s], s), default=0)
    ok = sorted((r for r in ok if len(r[1]) == n), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-n // parts)
    cut = []
    for r in ok:
        q = [math.floor(scale * v) for v in r[1]] + [0] * (parts * width - n)
        cut.append([q[p * width : (p + 1) * width] for p in range(parts)])
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda: [[min((far(c[p], e), j) for j, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        near = nearest()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [c[p] for c, m in zip(cut, near, strict=True) if m[p][1] == j]
                if own:
                    books[p][j] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    out = [(r[0], r[2], tuple(j for _, j in m), sum(d for d, _ in m)) for r, m in zip(ok, nearest(), strict=True)]
    return sorted(out, key=str), books


def some(kind, n=150, width=24, seed=1):
    r = random.Random(seed)
    value = {"ties": lambda: r.choice([-1, 0, 1]) / 4096, "plain": lambda: r.gauss(0, 0.3), "far": lambda: r.choice([0, 1e4, -1e4]) + r.random()}[kind]
    rows = [(i, [value() for _ in range(width)], r.choice(["a", "b", None]), 1, "o") for i in range(n)]
    hot = [value() for _ in range(width)]
    rows += [(n + i, hot, "a", 1, "o") for i in range(n // 2)]
    rows += [(900, None, "a", 1, "o"), (901, [], "a", 1, "o"), (902, [0.5] * (width - 1) + [None], "b", 1, "o"), (903, [float("nan")] * width, "b", 1, "o"), (904, [float("-inf")] * width, "b", 1, "o"), (905, [0.1] * 3, "b", 1, "o"), (None, hot, None, 1, "o"), (7, hot, "b", 1, "o"), (7, hot, "b", 1, "o")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("kind", "width"), [("ties", 24), ("plain", 24), ("far", 24), ("plain", 13), ("plain", 3)])
def test_codes(spark, kind, width):
    rows = some(kind, width=width)
    coded, found = vector_codes.compress(spark.createDataFrame(rows, ROWS).repartition(3))
    want, books = plain(rows)
    assert sorted(((r["vec_id"], r["label"], tuple(r["code"]), r["error"]) for r in coded.collect()), key=str) == want
    assert found.books.tolist() == books


def test_few(spark):
    coded, found = vector_codes.compress(spark.createDataFrame([], ROWS))
    assert coded.count() == 0 and found.books.size == 0
    rows = some("plain", n=4)[:5]
    coded, found = vector_codes.compress(spark.createDataFrame(rows, ROWS))
    assert sorted(((r["vec_id"], r["label"], tuple(r["code"]), r["error"]) for r in coded.collect()), key=str) == plain(rows)[0]


def test_restored(spark):
    rows = [(i, [random.Random(i).gauss(0, 0.3) for _ in range(16)], "a", 1, "o") for i in range(200)]
    coded, found = vector_codes.compress(spark.createDataFrame(rows, ROWS))
    whole = {r[0]: np.floor(np.array(r[1]) * 4096) for r in rows}
    for r in vector_codes.restored(coded, found).collect():
        assert int(((np.array(r["vector"]) * 4096 - whole[r["vec_id"]]) ** 2).sum().round()) == r["error"]


def test_bounds_hold_and_prune():
    """Bounds never pass the true distances, and most entries are passed over."""
    g = np.random.default_rng(3)
    x = np.concatenate([g.normal(c * 3000, 100, (200, 1, 8)) for c in range(6)]).astype(np.int64)
    books = x[g.choice(len(x), 6, replace=False)].transpose(1, 0, 2).copy()
    own, upper, lower = np.zeros((len(x), 1), np.int64), np.full((len(x), 1), 1 << 40), np.zeros((len(x), 1, 6), np.int64)
    needed = []
    for _ in range(5):
        needed.append(vector_codes.assign(x, own, upper, lower, books, vector_codes.gaps(books)))
        true = ((x[:, 0, None] - books[0][None]) ** 2).sum(-1)
        assert (own[:, 0] == true.argmin(1)).all()
        new = np.stack([x[own[:, 0] == j, 0].sum(0) // max(1, (own[:, 0] == j).sum()) if (own[:, 0] == j).any() else books[0, j] for j in range(6)])[None]
        moved = vector_codes.ceil_root(((new - books) ** 2).sum(-1))
        books = new
        upper, lower = vector_codes.shifted(upper, lower, own, moved)
        true = np.sqrt(((x[:, 0, None] - books[0][None]) ** 2).sum(-1).astype(float))
        assert (upper[:, 0] >= true[np.arange(len(x)), own[:, 0]] - 1e-6).all() and (lower[:, 0] <= true + 1e-6).all()
    assert needed[-1] < needed[0] / 3


def test_roots():
    squares = np.array([0, 1, 2, 3, 4, 15, 16, 17, (1 << 31) ** 2 - 1, (1 << 31) ** 2, (1 << 31) ** 2 + 1, (1 << 62) - 1])
    assert vector_codes.floor_root(squares).tolist() == [math.isqrt(int(s)) for s in squares]
    assert vector_codes.ceil_root(squares).tolist() == [math.isqrt(int(s)) + (math.isqrt(int(s)) ** 2 < s) for s in squares]
