import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from protolens.llm import prefix_trie

ROWS = "conv_id long, turn long, role string, text string, pos long, seq string, node int"
extra = (9, "s", 7)


def token(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def sequences(rows):
    by = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            by[c].append(((turn is not None, turn or 0), token(role or "", text or ""), role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in by.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(abs(c) % 5 * (1 if c >= 0 else -1))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(paths):
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(int)
    for n in members:
        if n:
            children[n[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += children[n] == 0
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1].encode()) if n else 0
    end = lambda n: hashlib.sha256(",".join(map(str, sorted(c for c in members[n] if len(paths[c]) == len(n)))).encode()).hexdigest()
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], end(n)) for n, m in members.items()), key=str)


def got(df):
    return sorted((tuple(r) for r in df.drop("pos", "end").collect()), key=str)


def some(seed=3, convs=60):
    r = random.Random(seed)
    say = lambda: ("user" if r.random() < 0.5 else "assistant", r.choice(["a", "b", "", "ü🙂", "long " * 50]))
    rows = [(c, t, *say()) for c in range(convs) for t in range(r.randrange(1, 13)) if c % 7]
    rows += [(200, t, "user", f"turn {t}") for t in range(150)] + [(201 + i, t, "user", f"turn {t}") for i in range(30) for t in range(140)]
    rows += [(300, None, None, None), (300, None, None, "x"), (300, 1, "user", "x"), (300, 1, "user", "x"), (300, 1, "assistant", "x"), (None, 1, "user", "x"), (-7, 0, "user", "a"), (-3, 0, "user", "b"), (-3, 1, None, "")]
    r.shuffle(rows)
    return [(*x, *extra) for x in rows]


@pytest.mark.parametrize("block", [2, 64])
def test_trie(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = some()
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    assert got(prefix_trie.trie(*prefix_trie.rebuilt(*prefix_trie.turns_in_order(df)))) == brute(rebuilt(sequences(rows)))


def test_intervals(spark):
    rows = some(4, 20)
    out = prefix_trie.prefix_trie(spark.createDataFrame(rows, ROWS)).collect()
    assert sorted((tuple(r)[2:] for r in out), key=str) == brute(sequences(rows))
    assert sorted(r["pos"] for r in out) == list(range(len(out)))
    for r in out:
        inside = [q for q in out if r["pos"] <= q["pos"] < r["end"]]
        assert sum(q["n_children"] == 0 for q in inside) == r["n_leaves"]
        assert sum(q["depth"] == r["depth"] + 1 for q in inside) == r["n_children"]


def test_few(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], ROWS)).count() == 0
    one = spark.createDataFrame([(4, 0, "user", "x", *extra)], ROWS)
    assert got(prefix_trie.trie(*prefix_trie.rebuilt(*prefix_trie.turns_in_order(one)))) == brute(rebuilt({4: [("user", "x")]}))
