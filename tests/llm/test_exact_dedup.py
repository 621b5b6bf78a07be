import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from conftest import CLASHING

from protolens.llm import exact_dedup as X


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 100, 5_000, 60_000):
        keys = rng.integers(0, 1 << 63, n, np.uint64)
        made = X.FuseFilter.build(np.concatenate([keys, keys[: n // 2]]))
        assert made.has(keys).all()
        other = rng.integers(1 << 63, (1 << 64) - 1, 20_000, np.uint64)
        assert made.has(other).mean() < 0.002


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    return groups


def test_classes(odd_docs, odd_rows):
    got = X.exact_dedup(X.arrival(odd_docs), "_old").collect()
    groups = expected(odd_rows)
    assert len(got) == len(odd_rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = defaultdict(int)
    for r in got:
        ids = by_sha[r["sha"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
        if r["kept"]:
            assert r["id"] == r["keep_id"]
            kept[r["sha"]] += 1
    assert kept == dict.fromkeys(by_sha, 1)


def test_all_in_one_side(odd_docs, odd_rows):
    for old in (True, False):
        got = X.exact_dedup(odd_docs.withColumn("_old", F.lit(old)), "_old")
        assert got.where("kept").count() == len(expected(odd_rows))
        assert got.where("seen").count() == 0


def test_pipeline_form(odd_docs, odd_rows, no_docs):
    out = X.dedup_documents(odd_docs)
    assert out.columns == odd_docs.columns
    assert {tuple(r)[5:] for r in out.collect()} == {(7, "x", 1, *CLASHING)}
    texts = [r["text"] or "" for r in out.collect()]
    assert sorted(texts) == sorted(expected(odd_rows))
    assert X.dedup_documents(no_docs).count() == 0
    assert X.exact_dedup(X.arrival(no_docs), "_old").count() == 0


def test_small_snapshot_and_large_batch(spark, monkeypatch, tmp_path):
    """Neither an empty snapshot nor a batch of several shards changes the classes, and kept
    filters serve a later batch."""
    monkeypatch.setattr(X, "SHARD_KEYS", 40)
    monkeypatch.setattr(X, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(X, "HOT", 5)
    rows = [(i, f"text {i % 170}" if i < 300 else "hot text") for i in range(400)]
    groups = expected(rows)
    sizes = {hashlib.sha256(t.encode()).hexdigest(): len(ids) for t, ids in groups.items()}
    for old in (F.lit(False), F.col("doc_id") < 7, F.col("doc_id") % 2 == 0):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("_old", old)
        for _ in range(2):
            got = X.exact_dedup(df, "_old", filters=str(tmp_path)).collect()
            assert len(got) == len(rows) and all(r["group_size"] == sizes[r["sha"]] for r in got)
            assert sum(r["kept"] for r in got) == len(groups)
    assert len(list(tmp_path.glob("fuse-*"))) == 3
    shards = X.snapshot_filters(spark.range(100).select(F.xxhash64("id").alias("key")), str(tmp_path))[1]
    assert shards == 3
