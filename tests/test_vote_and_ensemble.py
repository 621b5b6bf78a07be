import pytest
from pyspark.sql import functions as F

from protolens.operators import ensemble as N
from protolens.operators import metrics as A
from protolens.operators import retrieval as R
from protolens.operators import vote as V

HITS = "query string, target string, bits double, prob double, lddt double, alntmscore double"


def hits(spark, rows, query="q"):
    return spark.createDataFrame([(query, t, float(b), 0.5, float(b), float(b)) for t, b in rows], HITS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "entry string, label string")


def one(df):
    return tuple(df.first())


@pytest.mark.parametrize(
    "rows, names, k, weight, want",
    [
        ([("t1", 10), ("t2", 6), ("t3", 5), ("t4", 4)], "ABBA", 3, "bits", ("q", "B", 3, 11.0)),
        ([("t1", 10), ("t2", 6)], "AB", 2, "uniform", ("q", "A", 2, 1.0)),
        ([("t1", 10), ("t2", 6), ("t3", 5)], ".BA", 2, "bits", ("q", "B", 2, 6.0)),
        ([("t1", 10), ("t2", 6), ("t3", 5)], "...", 1, "bits", ("q", None, 0, 0.0)),
        ([("t2", 10), ("t1", 10)], "BA", 1, "bits", ("q", "A", 1, 10.0)),
    ],
)
def test_vote(spark, rows, names, k, weight, want):
    known = labels(spark, [(t, n) for (t, _), n in zip(rows, names, strict=True) if n != "."] or [("none", "x")])
    assert one(V.vote(hits(spark, rows), known, k, weight)) == want


def test_one_hit_weighs_the_same(spark):
    h, known = hits(spark, [("t1", 3), ("t2", 2)]), labels(spark, [("t1", "A"), ("t2", "B")])
    assert {one(V.vote(h, known, 1, w))[1] for w in V.WEIGHTS} == {"A"}
    swept = V.vote_sweep(h, known, [1, 2], V.WEIGHTS, [0.0, 0.4, 0.9])
    assert swept.count() == 2 * len(V.WEIGHTS) * 2
    assert {r["pred"] for r in swept.collect()} == {"A"}


def test_last_label_counts(spark):
    known = spark.createDataFrame([("t1", "A", 1), ("t1", "B", 2)], "entry string, label string, row_no long")
    assert one(V.vote(hits(spark, [("t1", 3)]), known, 1))[1] == "B"


def test_majority(spark):
    rows = [("A", "B", "B"), ("A", "B", "C"), ("A", "B", None), (None, None, "C"), (None, None, None), ("C", "B", "B")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string, c string").coalesce(1).select(V.majority(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["B", "A", "A", "C", None, "B"]


def test_gate_fallback_layers_agreement(spark):
    q = spark.createDataFrame([("q1",), ("q2",), ("q3",), ("q4",)], "query string")
    r = spark.createDataFrame([("q1", "R", 0.9), ("q2", "R", 0.89), ("q4", None, 1.0)], "query string, pred string, prob double")
    m = spark.createDataFrame([("q1", "M"), ("q2", "M"), ("q3", "M")], "query string, pred string")
    table = lambda df: {x["query"]: x["pred"] for x in df.collect()}
    assert table(N.gate(q, r, m, 0.9)) == {"q1": "R", "q2": "M", "q3": "M", "q4": None}
    assert table(N.fallback(q, r, m)) == table(N.gate(q, r, m, 0.0)) == {"q1": "R", "q2": "R", "q3": "M", "q4": None}
    assert table(N.agreement(q, r, m)) == table(N.fallback(q, r, m))
    assert table(N.agreement(q, r, m, "model")) == {"q1": "M", "q2": "M", "q3": "M", "q4": None}
    assert table(N.layered(q, r, m, m)) == table(N.layered(q, r, m))
    assert table(N.voted(q, r, m)) == {"q1": "R", "q2": "R", "q3": "M", "q4": None}
    assert table(N.gated_majority(q, r, [m, r, r], 0.9)) == {"q1": "R", "q2": "R", "q3": "M", "q4": None}
    assert one(A.sources_used(N.gate(q, r, m, 0.9))) == (1, 2, 1)
    swept = N.gate_sweep(q, r, m, [0.0, 0.9])
    assert table(swept.where("threshold = 0.9")) == table(N.gate(q, r, m, 0.9))


def test_weighted_f1(spark):
    truth = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "C"), ("4", "C")], "query string, true string")
    preds = spark.createDataFrame([("1", "A"), ("2", None), ("3", "C"), ("4", "B")], "query string, pred string")
    assert one(A.evaluate(truth, preds)) == (0.583333, 3, 1)
    same = truth.withColumnRenamed("true", "pred")
    assert one(A.evaluate(truth, same)) == (1.0, 4, 0)
    assert one(A.evaluate(truth, same.limit(0)))[0] == 0.0
    assert one(A.evaluate_predicted_only(truth, same.limit(2))) == (1.0,)
    by = same.withColumn("c", F.lit(1)).unionByName(preds.withColumn("c", F.lit(2)))
    assert {r["c"]: r["weighted_f1"] for r in A.evaluate(truth, by, ["c"]).collect()} == {1: 1.0, 2: 0.583333}


def test_top_1_and_affinity(spark):
    h = spark.createDataFrame([("q", "t1", 5.0, 0.7, 1), ("q", "t1", 9.0, 0.8, 2), ("q", "q", 7.0, 1.0, 3), ("z_out", "t1", 1.0, 1.0, 4), (None, "t1", 1.0, 1.0, 5), ("q", "unknown", 99.0, 1.0, 6)], "query string, target string, bits double, prob double, row_no long")
    assert R.drop_outputs(h).count() == 5
    e = spark.createDataFrame([("q", 0, "A"), ("t1", 1, "B"), ("r", 2, "C")], "entry string, row_no long, label string")
    got = {(r["query"], r["target"]): r["value"] for r in R.affinity(h, e, e, mask_self=True).collect()}
    assert got == {("q", "t1"): 9.0}
    m = R.affinity(h, e, e, mask_self=True)
    assert {r["entry"] for r in R.with_any_hit(e, m).collect()} == {"q"}
    table = lambda df: {r["query"]: r["pred"] for r in df.collect()}
    assert table(R.argmax_label(m, e, e)) == {"q": "B", "t1": None, "r": None}
    assert table(R.argmax_label(m, e, e, guess_first=True)) == {"q": "B", "t1": "A", "r": "A"}
    best = R.top_1(h, e).where("query = 'q'").first()
    assert (best["target"], best["pred"]) == ("unknown", None)


def test_similar_in_blocks(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(60, 5))
    x[7] = 0
    df = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "entry string, features array<double>")
    for metric in ("cosine", "l2"):
        a = sorted(map(tuple, R.similar(df, df, 3, metric, block=1000).collect()))
        assert a == sorted(map(tuple, R.similar(df, df, 3, metric, block=7).collect()))
        assert len(a) == 180
