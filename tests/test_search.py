import itertools
import math
import random

import numpy as np
import pytest

from protolens.operators import search as H
from protolens.operators import vote as V

NEAR = H.closeness("ACDEFG", same=4, step=3, worst=-6, gap_open=5, gap_extend=1)


def plain(q, t, scoring):
    """Best local alignment with affine gaps, cell by cell."""
    at, far, best = {a: i for i, a in enumerate(scoring.letters)}, -(10**9), 0
    low = min(map(min, scoring.table))
    h, e = [0] * (len(t) + 1), [far] * (len(t) + 1)
    for a in q:
        left, diagonal, f, row = 0, 0, far, [0]
        for j, b in enumerate(t, 1):
            e[j] = max(e[j] - scoring.gap_extend, h[j] - scoring.gap_open)
            f = max(f - scoring.gap_extend, left - scoring.gap_open)
            s = scoring.table[at[a]][at[b]] if a in at and b in at else low
            left = max(0, h[j - 1] + s, e[j], f)
            row.append(left)
            best = max(best, left)
        h = row
    return best


def say(r, n, letters="ACDEFG"):
    return "".join(r.choice(letters) for _ in range(n))


def changed(r, s):
    """A copy with some letters replaced, lost or added."""
    out = []
    for a in s:
        x = r.random()
        out += [] if x < 0.04 else [a, r.choice("ACDEFG")] if x < 0.08 else [r.choice("ACDEFG")] if x < 0.2 else [a]
    return "".join(out)


@pytest.mark.parametrize("scoring", [NEAR, H.identity("ACDEFG", gap_open=3, gap_extend=1), H.identity("ACDEFG", gap_open=2, gap_extend=2)])
def test_alignment(scoring):
    r = random.Random(2)
    for _ in range(120):
        q = say(r, r.randrange(1, 40))
        t = say(r, r.randrange(0, 20)) + (changed(r, q) if r.random() < 0.7 else "") + say(r, r.randrange(1, 20), "ACDEFGX")
        score, same, columns, *ends = H.align(q.encode(), t.encode(), scoring.matrix(), scoring.gap_open, scoring.gap_extend)
        assert score == plain(q, t, scoring)
        if score:
            a, b, c, d = ends
            assert plain(q[a:b], t[c:d], scoring) == score and max(b - a, d - c) <= columns <= (b - a) + (d - c)
            assert same <= min(b - a, d - c)
    assert H.align(b"ACDEFG", b"CCACDEFGCC", scoring.matrix(), 3, 1)[1:] == (6, 6, 0, 6, 2, 8)


def test_chance_level():
    """Scores 1 and -1 with four letters of a quarter each: lambda is ln 3."""
    s = H.identity("ABCD", 1, -1)
    assert s.decay(dict.fromkeys("ABCD", 0.25)) == pytest.approx(math.log(3))
    with pytest.raises(ValueError, match="below zero"):
        s.decay({"A": 0.5, "B": 0.5})


def strings(seed=4):
    r = random.Random(seed)
    targets = {f"t{i:03}": say(r, r.randrange(20, 90)) for i in range(150)}
    targets |= {"copy": targets["t000"], "again": targets["t000"], "run": "A" * 400, "odd": "XYZ" * 30}
    queries = {f"q{i:02}": changed(r, targets[f"t{i:03}"]) for i in range(20)}
    queries |= {"alone": say(r, 60), "run": "A" * 60}
    return queries, targets


def frames(spark, queries, targets):
    make = lambda d, more: spark.createDataFrame([*d.items(), *more], "entry string, s string").repartition(3)
    return make(queries, [("short", "AC"), ("none", None), ("nothing", "")]), make(targets, [("short", "C"), ("none", None), (None, "ACDEFG")])


@pytest.mark.parametrize("seed_rows", [0, 500_000])
def test_seeds_are_broadcast_by_count_alone(spark, tmp_path, seed_rows):
    """The size that Spark estimates of seeds is that of the file their queries lie in, times little."""
    for name, rows in zip("qt", frames(spark, *strings()), strict=True):
        rows.write.parquet(f"{tmp_path}/{name}")
    found = H.candidates(*(spark.read.parquet(f"{tmp_path}/{name}") for name in "qt"), NEAR, 4, 4, distinct=2, seed_rows=seed_rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) == (seed_rows > 0)
    assert ("SortMergeJoin" in plan) == (seed_rows == 0)


@pytest.mark.parametrize("seed_rows", [0, 500_000])
def test_search(spark, seed_rows):
    queries, targets = strings()
    found = H.search(*frames(spark, queries, targets), NEAR, 4, 4, distinct=2, seed_rows=seed_rows).collect()
    total = sum(map(len, targets.values())) + 1  # with the letter of the short one
    counts = {a: sum(t.count(a) for t in targets.values()) + (a == "C") for a in NEAR.letters}
    rate = NEAR.decay({a: n / total for a, n in counts.items()})
    every = {(q, t): plain(a, b, NEAR) for q, a in queries.items() for t, b in targets.items()}
    level = lambda q, n: len(queries[q]) * total * 2 ** -((n * rate - math.log(0.1)) / math.log(2))
    for x in found:
        assert x["score"] == every[x["query"], x["target"]]
        assert x["evalue"] == pytest.approx(level(x["query"], x["score"])) and x["evalue"] <= 10
    got = {(x["query"], x["target"]) for x in found}
    for below, least, recall in ((1e-6, 15, 1.0), (1e-3, 40, 0.8)):  # recall against aligning all pairs
        sure = {(q, t) for (q, t), n in every.items() if q != "run" and level(q, n) <= below}
        assert len(sure) >= least and len(sure & got) >= recall * len(sure)
    assert not {q for q, _ in got} & {"short", "none", "nothing", "run"} and not {t for _, t in got} & {"none", "odd"}


def test_most_candidates(spark):
    """The candidates with most matches on a diagonal of double hits, checked against all pairs."""
    queries, targets = strings(9)
    k, loss, top = 3, 3, 4
    got = {(r["query"], r["target"], r["matches"]) for r in H.candidates(*frames(spark, queries, targets), NEAR, k, loss, top).collect()}
    score = lambda a, b: sum(NEAR.table[NEAR.letters.index(x)][NEAR.letters.index(y)] for x, y in zip(a, b, strict=True))
    want = set()
    for q, a in (queries | {"short": "AC"}).items():
        best = []
        for t, b in targets.items():
            lines: dict[int, list[int]] = {}
            for i in range(len(a) - k + 1):
                for j in range(len(b) - k + 1):
                    if set(b[j : j + k]) <= set(NEAR.letters) and score(a[i : i + k], b[j : j + k]) >= score(a[i : i + k], a[i : i + k]) - loss:
                        lines.setdefault(j - i, []).append(i)
            double = [len(v) for v in lines.values() if max(v) - min(v) >= min(k, min(len(a), len(b)) - k)]
            best += [(-max(double), t)] if double else []
        want |= {(q, t, -n) for n, t in sorted(best)[:top]}
    assert got == want


def test_long_strings_and_votes(spark):
    r = random.Random(7)
    long = say(r, 30_000)
    queries = spark.createDataFrame([("q", long[12_000:12_400])], "entry string, s string")
    targets = spark.createDataFrame([("long", long), ("half", long[12_100:12_300]), ("other", say(r, 5000))], "entry string, s string")
    found = H.search(queries, targets, H.identity("ACDEFG"), 10, distinct=2)
    rows = {x["target"]: x for x in found.collect()}
    assert set(rows) == {"long", "half"}
    assert (rows["long"]["score"], rows["long"]["fident"], rows["long"]["t_start"], rows["long"]["t_end"]) == (800, 1.0, 12_000, 12_400)
    assert (rows["half"]["q_start"], rows["half"]["q_end"]) == (100, 300)
    labels = spark.createDataFrame([("long", "a", 0), ("half", "b", 1)], "entry string, label string, row_no long")
    voted = V.vote(H.as_hits(found), labels, 5).first()
    assert (voted["query"], voted["pred"], voted["n_hits"]) == ("q", "a", 2)


def test_no_rows(spark):
    none = spark.createDataFrame([], "entry string, s string")
    some = spark.createDataFrame([("a", "ACDEFGACDEFG")], "entry string, s string")
    assert H.search(none, some, NEAR, 3).count() == 0 and H.search(some, none, NEAR, 3).count() == 0
    assert H.seed_length(0, 20) == 3 and H.seed_length(25_600, 20) == 4
    assert np.asarray(NEAR.matrix()[ord("X")]).max() == -6


def test_scores_alone_equal_alignments():
    rng = np.random.default_rng(11)
    scoring = H.identity("ABCD")
    matrix = scoring.matrix()
    for n in (0, 1, 2, 40, 90):
        for m in (0, 1, 30, 70):
            q, t = (bytes(rng.choice(list(b"ABCD"), size).astype(np.uint8)) for size in (m, n))
            score, q_end, t_end = H.best_score(q, t, matrix, 3, 1)
            whole = H.align(q, t, matrix, 3, 1) if n else (0,) * 7
            assert (score, q_end, t_end) == (whole[0], whole[4], whole[6])
            if score:
                assert H.align(q[:q_end], t[:t_end], matrix, 3, 1) == whole


def test_seeds_are_told_where_the_queries_lie(spark):
    """Similar k-mers against all k-mers; the plan of the seeds has no join and shuffles queries only."""
    rows = [b"ACDE", b"GGGG", b"AXDE", b"ACDE", b"FACA"]
    every = [bytes(p) for p in itertools.product(b"ACDEFG", repeat=4)]
    for scoring, loss, distinct in ((NEAR, 5, 1), (NEAR, 5, 3), (NEAR, 0, 1), (H.Scoring("ACDEFG", tuple(tuple(i * j % 5 - 2 for j in range(6)) for i in range(6)), 3, 1), 1, 2)):
        at, made = H.similar(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 4), scoring, loss, distinct)
        score = lambda a, b: sum(scoring.table[scoring.letters.index(chr(x))][scoring.letters.index(chr(y))] for x, y in zip(a, b, strict=True))  # noqa: E731, B023
        want = [(i, b) for i, a in enumerate(rows) if b"X" not in a for b in every if score(a, b) >= score(a, a) - loss and len(set(b)) >= distinct]
        assert sorted(zip(at.tolist(), map(bytes, made), strict=True)) == want and want
    found = H.seeds(spark.createDataFrame([("a", "ACDEFACDE"), ("n", None), ("s", "AC")], "entry string, s string"), NEAR, 4, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert {(r["query"], r["n_q"], r["q_pos"]) for r in found.collect()} == {("a", 9, i) for i in range(6)}


def test_letters_are_asked_of_seeds_only(spark):
    rows = spark.createDataFrame([("a", "AAAAAAAA"), ("b", "ABCDABCD")], "entry string, s string")
    found = H.seeds(rows, H.identity("ABCD"), 4, 0, 3).collect()
    assert {bytes(r["kmer"]) for r in found} == {b"ABCD", b"BCDA", b"CDAB", b"DABC"}
    assert {(r["query"], r["target"]) for r in H.candidates(rows, rows, H.identity("ABCD"), 4, 0, distinct=3).collect()} == {("b", "b")}
    assert [r for r in H.candidates(rows, rows, H.identity("ABCD"), 4, 0).collect() if r["query"] == "a"]
