"""Near copies against plain versions."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_simhash import roots

from protolens.llm import near_copies as N
from protolens.llm import simhash as S


def jaccard(a, b):
    a, b = N.shingles(a), N.shingles(b)
    return len(a & b) / len(a | b)


def test_one_of_each(spark, odd_docs, odd_rows, no_docs):
    out = N.one_of_each(odd_docs)
    assert out.columns == odd_docs.columns
    kept = [r["text"] for r in out.collect()]
    for r in odd_rows:
        assert any(jaccard(r[1], k) >= 0.8 for k in kept)
    assert len({k or "" for k in kept}) == len({t or "" for t in kept})
    assert N.one_of_each(no_docs).count() == 0


def test_near_copies_are_caught(spark):
    """Copies with a few changed words leave, in small groups and in a large one."""
    rng = np.random.default_rng(12)
    text = lambda n: [f"w{i}" for i in rng.integers(0, 3000, n)]
    rows, origin, i = [], {}, 0
    for g in range(60):
        base = text(int(rng.integers(60, 300)))
        for c in range(300 if g == 0 else 3):
            own = list(base)
            for at in rng.choice(len(own), 0 if c == 0 else max(1, len(own) // 60), replace=False):
                own[at] = f"x{rng.integers(0, 10**6)}"
            if jaccard(" ".join(base), " ".join(own)) >= 0.8:
                rows.append((i, " ".join(own)))
                origin[i] = g
                i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = sorted(origin[r["doc_id"]] for r in N.one_of_each(df).collect())
    assert set(kept) == set(range(60))
    assert len(kept) <= 63


def node_table(spark, values, words=()):
    """Nodes with fingerprints ``values``, whose sizes and sketches allow any pair."""
    rows = [(v, v % 3, 10, v, bytes(N.SKETCH // 8)) for v in values]
    return spark.createDataFrame(rows, "u long, root long, n int, fp long, sketch binary")


def close(values, distance):
    v = np.array(sorted(values), np.int64)
    i, j = np.nonzero(np.bitwise_count((v[:, None] ^ v[None]).view(np.uint64)) <= distance)
    return {(int(v[a]), int(v[b])) for a, b in zip(i, j, strict=True) if a < b}


def fingerprint_values():
    rng = np.random.default_rng(5)
    values = set(map(int, rng.integers(0, 1 << 63, 300, np.int64)))
    one = next(iter(values))
    return values | {one ^ int(sum(1 << int(b) for b in rng.choice(62, k, replace=False))) for k in range(1, 9) for _ in range(40)}


def test_pairs_within(spark):
    values = fingerprint_values()
    want = {(a, b) for a, b in close(values, 7) if a % 3 != b % 3}
    for block in (N.BLOCK, 20):
        assert {tuple(r) for r in N.pairs_within(node_table(spark, values), 7, block=block).select("a", "b").collect()} == want


def test_large_groups_meet_only_others(spark):
    """Blocks of one root do not meet each other, those of others do."""
    values = sorted(fingerprint_values())
    nodes = node_table(spark, values).withColumn("root", F.when(F.col("u") % 7 == 0, F.col("u")).otherwise(F.lit(0)))
    root = {v: v if v % 7 == 0 else 0 for v in values}
    want = {(a, b) for a, b in close(values, 7) if root[a] != root[b]}
    assert {tuple(r) for r in N.pairs_within(nodes, 7, block=10).select("a", "b").collect()} == want


def test_with_partners(spark):
    values = fingerprint_values()
    lone = spark.createDataFrame([(v,) for v in values], "fp long")
    want = {x for p in close(values, 7) for x in p}
    for longest in (N.LONGEST, 30):
        got = {r["fp"] for r in N.with_partners(lone, 7, longest).collect()}
        assert want <= got <= values
    assert N.with_partners(lone.limit(0), 7).count() == 0


def test_recall_of_fingerprints(spark):
    """Without the exact rest at least 0.9 of similar pairs of ordinary texts end in one group."""
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(80):
        base = [f"w{i}" for i in rng.integers(0, 2000, int(rng.integers(80, 400)))]
        for c in range(4):
            own = list(base)
            for at in rng.choice(len(own), c * len(own) // 120, replace=False):
                own[at] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(own))
    pairs = [(a, b) for g in range(0, len(texts), 4) for a in range(g, g + 4) for b in range(a + 1, g + 4) if jaccard(texts[a], texts[b]) >= 0.8]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    members, prints = N.near_copies(df, rest=False)
    root = {r["doc_id"]: r["root"] for r in prints.join(members, "u").collect()}
    together = sum(a in root and root.get(a) == root.get(b) for a, b in pairs)
    assert len(pairs) > 200 and together >= 0.9 * len(pairs)


def test_clashing_columns_keep_their_values(spark):
    rows = [(i, f"text number {i} of some words that differ {i} {i}", i * 10, i * 100, f"r{i}") for i in range(6)]
    rows.append((9, rows[0][1].upper(), 90, 900, "r9"))
    df = spark.createDataFrame(rows, "doc_id long, text string, u long, row_name long, Row_Name_ string")
    out = N.one_of_each(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == sorted(rows[:6])


def test_near_copies_are_whole(spark):
    """Groups are those of a plain five-word join, whatever the fingerprints' distance and the
    number of unlike texts that share much of a template."""
    rng = np.random.default_rng(31)
    word = lambda: f"w{rng.integers(0, 400)}"
    texts = []
    for _ in range(6):  # templates whose fillings are unlike, each with a few copies near 0.8
        template = [word() for _ in range(26)]
        for _ in range(40):
            own = [word() for _ in range(14)]
            texts.append([*template[:13], *own, *template[13:]])
            if rng.random() < 0.4:
                near = list(texts[-1])
                near[int(rng.integers(0, 3))] = "new"
                texts.append(near)
    for _ in range(40):  # long texts with changes at random places
        base = [word() for _ in range(int(rng.integers(60, 200)))]
        for c in range(4):
            own = list(base)
            for at in rng.choice(len(own), c * len(own) // 80, replace=False):
                own[at] = word()
            texts.append(own)
    rows = list(enumerate(map(" ".join, texts)))
    sets = [N.shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    prints = [S.fingerprint(t, N.PAIR) for _, t in rows]
    assert sum((prints[a] ^ prints[b]).bit_count() > N.WIDE for a, b in links) > 5
    root = roots(range(len(rows)), links)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r["doc_id"] for r in N.one_of_each(df).collect()) == sorted(set(root.values()))


def test_pairs_of_a_large_group_that_meet(spark, monkeypatch):
    """A group of near copies comes together with a few pairs for each text, not all."""
    import random

    from protolens.llm import near_copies

    rng = random.Random(5)
    one, texts = [f"w{i}" for i in range(300)], []
    for _ in range(600):
        own = list(one)
        for _ in range(5):
            own[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    whole, met = near_copies.stage, []

    def counted(df, name, *more):
        out = whole(df, name, *more)
        if name in ("met", "beside"):
            met.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "stage", counted)
    left = [r["doc_id"] for r in near_copies.one_of_each(docs).collect()]
    monkeypatch.setattr(near_copies, "TURNS", 1)
    once, met[:] = sum(met), []
    assert left == [r["doc_id"] for r in near_copies.one_of_each(docs).collect()]
    assert once < 30 * 600, (once, sum(met))


def test_pairs_count_in_one_cell(spark):
    """A pair of near fingerprints that meets in several cells comes out once, before ``distinct``."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    base = rng.integers(-(2**63), 2**63 - 1, 12)
    fps = [int(b) ^ sum(1 << int(x) for x in rng.choice(63, rng.integers(0, 5), replace=False)) for b in base for _ in range(8)]
    nodes = spark.createDataFrame([(i + 1, i + 1, 10, f, bytes(N.SKETCH // 8)) for i, f in enumerate(fps)], "u long, root long, n int, fp long, sketch binary")
    parts = N._partitions(nodes.select("fp").distinct(), N.WIDE)
    rows = nodes.mapInArrow(N._placed(parts, True), N._CELL).repartition("c").sortWithinPartitions("c", "root", "u")
    got = sorted(map(tuple, rows.mapInArrow(N._partners(N.SIMILARITY, N.WIDE, None, parts), "a long, b long").collect()))
    near = [(a + 1, b + 1) for a in range(len(fps)) for b in range(a + 1, len(fps)) if (fps[a] ^ fps[b]).bit_count() <= N.WIDE]
    assert got == near and len(near) > 200
    assert rows.mapInArrow(N._partners(N.SIMILARITY, N.WIDE, None), "a long, b long").count() >= len(near)
    assert sorted(map(tuple, N.pairs_within(nodes, N.WIDE, 40).collect())) == near
    links = N.components(nodes.select(F.lit(1).cast("long").alias("a"), F.col("u").alias("b")))
    assert links.rdd.getNumPartitions() <= 4 and links.select("root").distinct().count() == 1


def test_a_pair_is_told_under_its_first_shared_key_only():
    def cell(key, *before):
        held = np.zeros(N.BEFORE, np.uint64)
        held[: len(before)] = before
        sketch = b"\0" * (N.SKETCH // 8) + held.tobytes()
        whole = lambda v, kind: pa.array([v, v], kind)
        columns = [whole(key, pa.int64()), whole(-1, pa.int32()), whole(0, pa.int32()), pa.array([1, 2]), pa.array([1, 2]), whole(20, pa.int32()), whole(len(before), pa.int32()), whole(0, pa.int64()), whole(sketch, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["c", "side", "role", "u", "root", "n", "at", "fp", "sketch"])

    told = lambda reach: sum(b.num_rows for b in N._partners(N.SIMILARITY, None, reach)(iter([cell(5), cell(6, 5), cell(7, 6, 5)])))
    assert told(None) == 1
    assert told(N.REACH) == 3  # rows beside each other need not have met before
