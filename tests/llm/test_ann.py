import time

import numpy as np
import pytest

from protolens.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, list int, codes string"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "x") for i, v in vectors], SCHEMA).repartition(3)


def brute(vectors, k=10):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in vectors if i is not None and v is not None and all(x is not None for x in v) and np.isfinite(np.array(v, np.float32)).all() and np.any(v) and len(v) == 16]
    ids, x = np.array([g[0] for g in good]), np.array([g[1] for g in good])
    out = {}
    for i, q in good:
        if i % 10 == 0:
            d = np.sqrt(((x - q) ** 2).sum(1))
            keep = ids != i
            order = np.lexsort((ids[keep], d[keep]))[:k]
            out[i] = list(zip(ids[keep][order].tolist(), d[keep][order].tolist(), strict=True))
    return out


@pytest.mark.parametrize("hot", [0, 400])
def test_search(spark, hot):
    rng = np.random.default_rng(6)
    one = rng.normal(size=16)
    vectors = [(i, rng.normal(size=16)) for i in range(800)] + [(5000 + i, one) for i in range(hot)]
    vectors += [(9000, None), (9010, [0.0] * 16), (9020, [1.0, None] + [0.0] * 14), (9030, [float("nan")] * 16), (9040, [float("inf")] * 16), (9050, [1.0] * 3), (9060, []), (None, one)]
    got = ann.search(table(spark, vectors), ann.F.pmod("vec_id", ann.F.lit(10)) == 0).collect()
    want = brute(vectors)
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == set(want)
    found = total = 0
    for q, rows in by.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        assert rows == sorted(rows, key=lambda r: (r[2], r[1]))
        true = dict(want[q])
        found += len({r[1] for r in rows} & set(true))
        total += 10
        for _, v, s in rows:
            if v in true:
                assert abs(s - true[v]) < 1e-12
    assert found / total >= 0.9


def test_few(spark):
    assert ann.search(table(spark, []), ann.F.lit(True)).count() == 0
    got = ann.search(table(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.5]), (2, [1.0, 1.5])]), ann.F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, 0.5), (2, 2, 0.5)]
    assert ann.search(table(spark, [(0, [1.0, 2.0])]), ann.F.lit(True)).count() == 0


def test_testdata(spark):
    """Recall against brute force on the driver's smallest table."""
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    found = total = 0
    for q, group in ann.search(df, ann.F.pmod("vec_id", ann.F.lit(10)) == 0).toPandas().groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        found += len(set(group["vec_id"]) & set(ids[np.lexsort((ids, d))[:10]]))
        total += 10
    assert found / total >= 0.9


def test_few_lists_and_repeated_ids(spark, monkeypatch):
    """Probed lists that hold too few are topped up, and a query's own rows never crowd others out."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 16)) * 50
    vectors = [(i, centres[i % 12] + rng.normal(size=16)) for i in range(60)]  # five rows about each centre
    vectors += [(0, vectors[0][1])] * 40
    whole = ann.fit
    monkeypatch.setattr(ann, "fit", lambda x, total, k: (lambda index: ann.Index(index.coarse, index.fine, 1))(whole(x, total, k)))
    got = ann.search(table(spark, vectors), ann.F.pmod("vec_id", ann.F.lit(10)) == 0).collect()
    want = brute(vectors)
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert {q: len(rows) for q, rows in by.items()} == dict.fromkeys(want, 10)
    assert all(v != q for q, rows in by.items() for _, v in rows)


def test_recall_on_more_vectors(spark):
    """Recall against brute force at sf0.1; on these vectors most lists have to be probed."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    found = total = 0
    for q, group in ann.search(df, ann.F.pmod("vec_id", ann.F.lit(20)) == 0).toPandas().groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        found += len(set(group["vec_id"]) & set(ids[np.lexsort((ids, d))[:10]]))
        total += 10
    assert total == 1000 and found / total >= 0.9


@pytest.mark.parametrize("kind", ["lengths", "clusters", "large", "small", "offset"])
def test_recall_on_other_rows(spark, kind):
    """Vectors of very unlike lengths, tight clusters, and values far from 1."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(4000, 16))
    x = {"lengths": x * np.exp(2 * rng.normal(size=(4000, 1))), "clusters": rng.normal(size=(20, 16))[np.arange(4000) % 20] + 0.05 * x, "large": x * 1e25, "small": x * 1e-25, "offset": x + 1000}[kind]
    vectors = list(enumerate(x.astype(np.float32)))
    want = brute(vectors)
    found = [r for r in ann.search(table(spark, vectors), ann.F.pmod("vec_id", ann.F.lit(10)) == 0).collect() if r["vec_id"] in dict(want[r["query_id"]])]
    assert len(want) == 400 and len(found) / 4000 >= 0.95


def test_codes_that_rule_out_little(spark):
    """Vectors of a block that codes don't rule out are ranked together: one by one this took 40 s."""
    rng = np.random.default_rng(14)
    x = rng.normal(size=(12_000, 64))
    ids = np.arange(12_000)
    index = ann.fit(x[:4000], 4000)
    lists = np.zeros(len(x), int)
    codes = index.code(ann._short(index.moved(x)), lists)
    rows = ann.pd.DataFrame({"list": 0, "vec_id": ids, "rid": ids, "codes": [c.tobytes() for c in codes], "v": list(x)})
    began = time.process_time()
    got = ann._search(index, 10)(ann.pd.DataFrame({"query_id": ids[:300], "q": list(x[:300])}), rows)
    assert time.process_time() - began < 15
    for q, own in list(got.groupby("query_id"))[::30]:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((ids, d))[:10]
        assert own["vec_id"].tolist() == best.tolist() and own["score"].tolist() == d[best].tolist()


def test_many_pairs_of_a_block():
    """More pairs than are ranked exactly at a time: 40 vectors, 2,000 queries."""
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(40, 8)), rng.normal(size=(2000, 8))
    index = ann.Index(np.zeros((1, 8), np.float32), rng.normal(size=(2, 5, 4)).astype(np.float32), 1)
    lists = np.zeros(len(x), int)
    rows = ann.pd.DataFrame({"list": lists, "vec_id": np.arange(40), "codes": [c.tobytes() for c in index.code(x, lists)], "v": list(x)})
    got = ann._search(index, 10)(ann.pd.DataFrame({"query_id": 100 + np.arange(2000), "q": list(q)}), rows)
    d = np.sqrt(((x[None] - q[:, None]) ** 2).sum(2))
    assert got["vec_id"].to_numpy().reshape(2000, 10).tolist() == np.argsort(d, axis=1)[:, :10].tolist()
    np.testing.assert_allclose(got["score"].to_numpy().reshape(2000, 10), np.sort(d, axis=1)[:, :10])


def test_sample_has_the_least_hashes(spark):
    rows = spark.range(5000).select(ann.F.col("id").alias("vec_id"), ann.F.array(ann.F.col("id").cast("double")).alias("v")).repartition(7)
    every = [r["vec_id"] for r in rows.orderBy(ann.F.xxhash64("vec_id"), "vec_id").limit(300).collect()]
    assert ann._sampled(rows, 5000, 300)["vec_id"].tolist() == every
    same = rows.withColumn("vec_id", ann.F.lit(1).cast("long"))
    assert len(ann._sampled(same, 5000, 300)) == 300
