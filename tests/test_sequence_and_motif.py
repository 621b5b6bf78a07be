import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from protolens.functions import sequence as S
from protolens.functions import vector as X
from protolens.operators import motif as O
from protolens.operators import relational as J
from protolens.operators import spatial as P
from protolens.schemas import AMINO, AROMATIC, HYDROPATHY


def column(spark, values, kind, expr):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").coalesce(1).select(expr).collect()]


def test_clean_and_kmers(spark):
    texts = ["aC-c1", "", None, "Straße 7", "日本 x", "ab\ncd"]
    assert column(spark, texts, "string", S.clean(F.col("v"))) == ["ACC", "", None, "STRASSE", "日本X", "ABCD"]
    assert column(spark, texts, "string", S.clean(F.col("v"), 2, ascii_only=True)) == ["AC", "", None, "ST", "X", "AB"]
    assert column(spark, ["AAAA", "AA", "", "ABCAB"], "string", S.kmers(F.col("v"), 3)) == [["AAA", "AAA"], [], [], ["ABC", "BCA", "CAB"]]
    assert column(spark, ["AAAA"], "string", S.kmer_set(F.col("v"), 3)) == [["AAA"]]


def features(seq):
    n, v = len(seq), [0.0] * 424
    if not n:
        return v
    for i, a in enumerate(AMINO):
        v[i] = seq.count(a) / n
    for a, b in zip(seq, seq[1:], strict=False):
        if a in AMINO and b in AMINO:
            v[20 + AMINO.index(a) * 20 + AMINO.index(b)] += 1 / (n - 1)
    kd = [HYDROPATHY.get(a, 0.0) for a in seq]
    v[420:] = math.log1p(n), np.mean(kd), np.std(kd), sum(a in AROMATIC for a in seq) / n
    return v


def test_sequence_features(spark):
    r = random.Random(1)
    seqs = ["ACC", "AXA", "", "W", *("".join(r.choice(AMINO + "XBÉ") for _ in range(n)) for n in (2, 50, 700))]
    got = column(spark, seqs, "string", S.sequence_features(F.col("v")))
    for s, v in zip(seqs, got, strict=True):
        assert np.allclose(v, features(s), atol=1e-12)
    assert len(S.feature_names()) == 424
    for s, p, c in zip(seqs, column(spark, seqs, "string", S.physico(F.col("v"))), column(spark, seqs, "string", S.composition(F.col("v"))), strict=True):
        assert np.allclose(p, features(s)[420:], atol=1e-9)
        assert np.allclose(c, features(s)[:20])
    df = spark.createDataFrame([("e", "ACC"), ("x", "AXA"), ("s", "A")], "entry string, sequence string")
    assert {(r["entry"], r["dipeptide"], r["freq"]) for r in S.dipeptides(df, "sequence", ["entry"]).collect()} == {("e", "AC", 0.5), ("e", "CC", 0.5)}


def test_names(spark):
    assert column(spark, ["a/b/AF-1.pdb", "x.pdb.gz", "plain", ".hid"], "string", S.stem(F.col("v"))) == ["AF-1", "x", "plain", ".hid"]
    assert column(spark, ["Mean alp. sph. solvent access", "--A--"], "string", S.slug(F.col("v"))) == ["mean_alp_sph_solvent_access", "a"]
    assert column(spark, ["org/m_t12_35M_UR50D"], "string", S.model_slug(F.col("v"))) == ["m_t12_35M"]
    assert column(spark, ["aUb-C"], "string", S.model_input(F.col("v"), "aa")) == ["<AA2fold> A X X C"]
    assert column(spark, ["AbC"], "string", S.model_input(F.col("v"), "3di")) == ["<fold2AA> a b c"]


def test_vectors(spark):
    assert column(spark, [[0.0, 0.0], [3.0, 4.0]], "array<double>", X.l2_normalize(F.col("v"))) == [[0.0, 0.0], [0.6, 0.8]]
    train = spark.createDataFrame([([1.0, 5.0],), ([2.0, 5.0],), ([4.0, 5.0],)], "v array<double>")
    m, s = X.scaling(train, "v")
    assert s[0] == pytest.approx(1.247219, abs=1e-6) and s[1] == 1.0
    got = [r[0] for r in train.select(X.standardize(F.col("v"), m, s)).collect()]
    assert np.allclose(sorted(got), [[-1.069045, 0], [-0.267261, 0], [1.336306, 0]], atol=1e-6)
    assert column(spark, [[1.0, 2.0, 3.0]], "array<double>", X.keep_ordinals(F.col("v"), [2, 0])) == [[3.0, 1.0]]
    assert X.group_ordinals([("a", "g"), ("b", "h"), ("c", "g")], keep="g") == [0, 2]
    assert X.group_ordinals([("a", "g"), ("b", "h"), ("c", "g")], drop="g") == [1]


def test_motif_model(spark):
    rows = [(f"m{i}", "A", i, "AAB" if i < 3 else "CCC") for i in range(4)] + [(f"o{i}", "B", 10 + i, "DDD") for i in range(8)]
    train = spark.createDataFrame(rows, "entry string, label string, row_no long, sequence string")
    f = O.kmer_presence(train, 2)
    got = {(r["class"], r["motif"]): r for r in O.discover(f, train, 3, 3.0).collect()}
    assert got["A", "AA"]["enrichment"] == pytest.approx(3.0) and got["A", "AA"]["weight"] == pytest.approx(1.584963, abs=1e-6)
    assert not [k for k in got if k[0] == "A" and k[1] == "CC"]
    assert O.discover(f, train, 4, 3.0).where("class = 'A'").count() == 0
    assert O.discover(f, train, 3, 5.0).count() == 0
    bg = spark.createDataFrame([("1", "AAB"), ("2", "AAC")], "entry string, sequence string")
    assert {r["motif"]: r["background"] for r in O.background(O.kmer_presence(bg, 2), bg).collect()} == {"AA": 1.0, "AB": 0.5, "AC": 0.5}
    motifs = spark.createDataFrame([("B", "AA", 1.0), ("A", "AA", 1.0), ("C", "ZZ", 9.0)], "class string, motif string, weight double")
    test = spark.createDataFrame([("q", "AAAA"), ("none", "TTTT")], "entry string, sequence string")
    counts = O.kmer_counts(test, 2)
    assert {r["class"]: r["score"] for r in O.score(counts, motifs).collect()} == {"A": 3.0, "B": 3.0}
    assert {r["class"]: r["score"] for r in O.score(counts, motifs, "presence").collect()} == {"A": 1.0, "B": 1.0}
    assert [tuple(r) for r in O.predict(O.score(counts, motifs), O.class_order(train)).collect()] == [("q", "A", 3.0)]
    swept = O.sweep(f, train, [3, 4], [3.0, 5.0], O.kmer_counts(test.withColumn("sequence", F.lit("AAB")), 2)).collect()
    assert {(r["min_members"], r["min_enrichment"], r["pred"]) for r in swept} == {(3, 3.0, "A")}


def residues(spark, rows):
    return spark.createDataFrame([("p", i, float(x), float(y), float(z), float(b), c) for i, x, y, z, b, c in rows], "entry string, i long, x double, y double, z double, b double, letter string")


def test_spatial_fixture(spark):
    rows = [(0, 0, 0, 0, 1, "D"), (6, 9, 0, 0, 1, "A"), (5, 1, 0, 0, 1, "C")] + [(i, 500 * i, 0, 300, 1, "E") for i in range(1, 5)]
    assert [tuple(r) for r in P.pair_motifs(residues(spark, rows)).collect()] == [("p", "A,D")]
    c = P.contact_stats(residues(spark, [(0, 0, 0, 0, 1, "C"), (2, 8, 0, 0, 1, "C")]), "letter").first()
    assert c["contact_density"] == 0 and c["contact_cys_pairs_per_res"] == 0 and c["contact_radius_per_n"] == pytest.approx(8 / 2**0.5)


def test_spatial_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    pts = rng.uniform(-20, 20, (120, 3))
    rows = [(i, *p, rng.uniform(), "ABCD"[i % 4]) for i, p in enumerate(pts)]
    got = {(r["a"]["i"], r["b"]["i"]) for r in P.near_pairs(residues(spark, rows), 6, 9.0).collect()}
    d = np.linalg.norm(pts[:, None] - pts[None], axis=-1)
    assert got == {(i, j) for i in range(120) for j in range(i + 6, 120) if d[i, j] <= 9.0}
    top = sorted(sorted(range(120), key=lambda i: (-rows[i][4], i))[:50])
    want = {",".join(sorted(rows[x][5] for x in (i, j, k))) for i in top for j in top for k in top if j - i >= 6 and k - j >= 6 and max(d[i, j], d[j, k], d[i, k]) <= 10.0}
    assert {r["motif"] for r in P.triple_motifs(residues(spark, rows)).collect()} == want


def test_alignment(spark):
    s = "split string, entry string, label string, features array<double>"
    a = spark.createDataFrame([("t", "e1", "A", [1.0]), ("t", "e2", "B", [2.0])], s)
    b = spark.createDataFrame([("t", "e1", "A", [3.0])], s)
    assert J.align(a, b, ["split", "entry"]).first()["features"] == [1.0, 3.0]
    bad = spark.createDataFrame([("t", "e1", "B", [3.0])], s)
    with pytest.raises(Exception, match="labels differ"):
        J.align(a, bad, ["split", "entry"]).collect()
    assert J.label_mismatches(a, bad, ["entry"]).count() == 1
    with pytest.raises(Exception, match="missing e2"):
        J.align_strict(a.drop("features"), b, "entry", "features").collect()
    test = spark.createDataFrame([("x", "A"), ("y", "C")], "entry string, label string")
    train = spark.createDataFrame([("A",), ("B",)], "label string")
    assert [r["entry"] for r in J.known_labels(test, train).collect()] == ["x"]
    assert J.unseen_labels(test, train).count() == 1
    merged = J.all_splits(train=test, test=test.drop("label"))
    assert merged.where("split = 'test' and label is null").count() == 2


def test_short_vectors_keep_what_they_have(spark):
    assert column(spark, [[1.0, 2.0, 3.0, 4.0], [1.0], None], "array<double>", X.keep_ordinals(F.col("v"), [0, 1, 3])) == [[1.0, 2.0, 4.0], [1.0], None]
    assert column(spark, [[1.0]], "array<double>", X.keep_ordinals(F.col("v"), [])) == [[]]


def test_counts_of_rows_that_repeat_a_key(spark):
    """Only keys of several rows are shuffled; letters beyond ASCII and long k-mers are counted as well."""
    rows = [("a", "ABAB"), ("a", "AB"), ("b", "ÄBÄB"), ("c", None), (None, "ABC"), ("d", "A")]
    df = spark.createDataFrame(rows, "entry string, sequence string")
    assert {tuple(r) for r in O.kmer_counts(df, 2).collect()} == {("a", "AB", 3), ("a", "BA", 1), ("b", "ÄB", 2), ("b", "BÄ", 1), (None, "AB", 1), (None, "BC", 1)}
    one = df.where("entry = 'b' OR entry IS NULL")
    assert "HashAggregate" not in O.kmer_counts(one, 2)._jdf.queryExecution().executedPlan().toString()
    long = spark.createDataFrame([("e", "ABCDEFGHIJ")], "entry string, sequence string")
    assert {r["motif"] for r in O.kmer_presence(long, 9).collect()} == {"ABCDEFGHI", "BCDEFGHIJ"}
    assert {r["motif"] for r in O.kmer_presence(long, 8).collect()} == {"ABCDEFGH", "BCDEFGHI", "CDEFGHIJ"}
    assert {(r["entry"], r["dipeptide"], r["freq"]) for r in S.dipeptides(spark.createDataFrame([("f", "ACAC"), ("g", "AC"), ("g", "CA")], "entry string, sequence string"), "sequence", ["entry"]).collect()} == {("f", "AC", 2 / 3), ("f", "CA", 1 / 3), ("g", "AC", 1.0), ("g", "CA", 1.0)}


def test_support_is_counted_in_parts(spark):
    df = spark.createDataFrame([("a", "X", "ABAB"), ("b", "X", "ABC"), ("c", "Y", "ABÄ"), ("d", None, "AB")], "entry string, label string, sequence string").repartition(3)
    found = O._held(O.support(df, 2), df).collect()
    assert {tuple(r) for r in found} == {("X", "AB", 2), ("X", "BA", 1), ("X", "BC", 1), ("Y", "AB", 1), ("Y", "BÄ", 1), (None, "AB", 1)}


@pytest.mark.parametrize("limit", [0, 500_000])
def test_few_motifs_leave_kmers_where_they_lie(spark, monkeypatch, limit):
    """Counted motifs are broadcast, whatever Spark estimates; more of them are joined by a shuffle."""
    from protolens.operators import motif

    monkeypatch.setattr(motif, "MOTIF_ROWS", limit)
    rows = spark.createDataFrame([(f"e{i}", i, "xy"[i % 2], ("ABAB", "CDCD")[i % 2]) for i in range(12)], "entry string, row_no long, label string, sequence string")
    found = motif.sweep(motif.support(rows, 3), rows, [2, 3], [1.5], motif.kmer_counts(rows, 3))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("hashpartitioning(motif" in plan) == (limit == 0)
    assert "SortMergeJoin" in plan if limit == 0 else "_supported" not in plan
    got = {(r["query"], r["min_members"], r["pred"]) for r in found.collect()}
    assert got == {(f"e{i}", m, "xy"[i % 2]) for i in range(12) for m in (2, 3)}
