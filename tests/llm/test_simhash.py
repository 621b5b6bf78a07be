import re
from collections import defaultdict

import numpy as np
import xxhash

from protolens.llm import simhash as S
from protolens.llm.components import components


def plain(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(values, links):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def near(values):
    v = np.array(sorted(values), np.int64)
    i, j = np.nonzero(np.bitwise_count((v[:, None] ^ v[None]).view(np.uint64)) <= 2)
    return [(int(v[a]), int(v[b])) for a, b in zip(i, j, strict=True) if a < b]


def test_fingerprint(odd_rows):
    for t in ["", None, "A", "a b", "A b C", "a  b\tc\nd", "É é \x1c x", "a a a a a"] + [r[1] for r in odd_rows]:
        assert S.fingerprint(t) == plain(t)


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [tuple(map(int, rng.integers(2000, 2400, 2))) for _ in range(250)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots({x for e in edges if e[0] != e[1] for x in e}, edges)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links(spark):
    rng = np.random.default_rng(8)
    centre = rng.integers(-(1 << 63), 1 << 63 - 1, 40, np.int64)
    values = set(map(int, rng.integers(-(1 << 63), (1 << 63) - 1, 1500, np.int64)))
    flip = lambda x, k: int(np.bitwise_xor.reduce(np.array([x, *(np.uint64(1 << int(b)).view(np.int64) for b in rng.choice(64, k, replace=False))], np.int64)))
    for c in centre:
        values |= {int(c), *(flip(c, k) for k in (1, 2, 2, 3, 4))}
    values |= {flip(int(centre[0]), int(rng.integers(1, 4))) for _ in range(800)}  # a value that very many share
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    for bucket in (S.BUCKET, 3):
        found = [tuple(r) for r in S.links(nodes, bucket=bucket).select("a", "b").collect()]
        assert roots(values, found) == roots(values, near(values))


def test_plan_covers():
    rng = np.random.default_rng(2)
    for total in (100, 10**5, 10**10):
        parts = S.plan(rng.integers(0, 1 << 63, 500, np.uint64), total)
        assert sum(t + 1 for _, t in parts) == S.DISTANCE + 1
        seen = 0
        for mask, _ in parts:
            assert not seen & mask
            seen |= mask


def test_documents(odd_docs, odd_rows, no_docs):
    got = S.near_groups(odd_docs).collect()
    prints = [np.uint64(plain(r[1])).view(np.int64).item() for r in odd_rows]
    root = roots(set(prints), near(set(prints)))
    least = defaultdict(list)
    for r, p in zip(odd_rows, prints, strict=True):
        if r[0] is not None:
            least[root[p]].append(r[0])
    want = sorted(((r[0], p, min(least[root[p]])) for r, p in zip(odd_rows, prints, strict=True)), key=str)
    assert sorted(((r["doc_id"], r["fp"], r["component_id"]) for r in got), key=str) == want
    assert S.near_groups(no_docs).count() == 0
