import zlib

import numpy as np

from conftest import CLASHING

from protolens.llm import quality as Q


def test_forest_matches_plain_traversal():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 1)).astype(float)
    forest = Q.fit(x[:2000], y[:2000])
    assert ((forest.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    for row in x[2000:2050]:
        total = forest.base
        for t in range(len(forest.leaf)):
            node = 0
            while node < forest.feature.shape[1]:
                node = 2 * node + 1 + int(row[forest.feature[t, node]] > forest.threshold[t, node])
            total += forest.leaf[t, node - forest.feature.shape[1]]
        assert abs(total - forest.margin(row[None])[0]) < 1e-9


def test_statistics():
    for text in (None, "", " ", "\n\n", "a", "日本 🙂", "x" * 300_000):
        assert len(Q.statistics(text)) == len(Q.FEATURES)
        assert np.isfinite(Q.statistics(text)).all()


def test_held_out(spark):
    ids = [None, -5, 0, 1, 2, 3, 99, 12345]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select(Q.held_out(Q.F.col("doc_id"))).collect()]
    assert got == [zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1 for i in ids]


def test_documents(spark, odd_docs, odd_rows, no_docs):
    bad = [(1000 + i, ("!!! BUY *** $$$ " * (20 + i)), "en", "a", 1, 7, "x", 1, *CLASHING) for i in range(60)]
    good = [(2000 + i, ("A calm sentence about item %d follows here. " % i) * (5 + i % 9), "en", "a", 1, 7, "x", 1, *CLASHING) for i in range(60)]
    docs = odd_docs.unionByName(spark.createDataFrame(bad + good, odd_docs.schema))
    labels = spark.createDataFrame([(r[0], 0, 0) for r in bad] + [(r[0], 1, 0) for r in good] + [(1, None, 0), (None, 1, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    got = Q.score(docs, Q.train(docs, labels)).select("doc_id", "score", Q.held_out(Q.F.col("doc_id")).alias("h")).collect()
    assert len(got) == len(odd_rows) + 120
    assert all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["h"] and r["doc_id"] is not None and r["doc_id"] >= 1000]
    assert len(held) > 20
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] >= 2000) for r in held]) == 1
    kept = Q.good_documents(docs, labels)
    assert kept.columns == docs.columns
    assert {tuple(r)[5:] for r in kept.collect()} == {(7, "x", 1, *CLASHING)}
    assert kept.where("doc_id >= 2000").count() == 60
    assert Q.good_documents(no_docs, labels.limit(0)).count() == 0
    assert {r["score"] for r in Q.score(docs, Q.train(docs, labels.limit(0))).collect()} == {0.5}
