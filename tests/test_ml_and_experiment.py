import numpy as np
import pytest

from protolens.operators import experiment as G
from protolens.operators import ml as M
from protolens.operators import retrieval as R

SCHEMA = "entry string, label string, features array<double>"


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    centre = {"A": (5, 0, 0, 0), "B": (0, 5, 0, 0), "C": (0, 0, 5, 0)}
    rows = [(f"{c}{i}", c, (np.array(m) + rng.normal(size=4)).tolist()) for c, m in centre.items() for i in range(12)]
    return spark.createDataFrame([r for r in rows if int(r[0][1:]) < 9], SCHEMA), spark.createDataFrame([r for r in rows if int(r[0][1:]) >= 9], SCHEMA)


@pytest.mark.parametrize("name", list(M.SUITE))
def test_suite_model(blobs, name):
    train, test = blobs
    r = M.run_suite(train, test, [name], skip_failures=False).first()
    assert (r["method"], r["n_predicted"], r["n_none"]) == (name, 9, 0)
    assert r["weighted_f1"] > 0.85


def test_linear_svm_and_balanced_forest(blobs):
    train, test = blobs
    for out in (M.linear_svm(train, test), M.random_forest(train, test, 20, balanced=True)):
        assert sum(r["pred"] == r["query"][0] for r in out.collect()) >= 8


def test_failures_become_nulls(blobs, monkeypatch):
    monkeypatch.setitem(M.SUITE, "broken", (False, lambda a, b: a.select("nothing")))
    rows = M.run_suite(*blobs, ["ncm", "broken"]).collect()
    assert rows[1]["weighted_f1"] is None and rows[0]["weighted_f1"] is not None


def test_faults_of_running_become_nulls(blobs, monkeypatch):
    def fails(frames):
        raise ValueError("while running")
        yield from frames

    monkeypatch.setitem(M.SUITE, "broken", (False, lambda a, b: b.select("entry").mapInPandas(fails, "query string, pred string")))
    with pytest.warns(UserWarning, match="broken"):
        rows = M.run_suite(*blobs, ["broken", "ncm"]).collect()
    assert rows[0]["weighted_f1"] is None and rows[1]["weighted_f1"] is not None


def test_machine_ends():
    with pytest.raises(ValueError, match="not finite"):
        M._dual(np.array([[1.0, np.nan], [np.nan, 1.0]]), np.array([1.0, -1.0]), 1.0)
    x = np.random.default_rng(1).normal(size=(40, 2))
    with pytest.raises(RuntimeError, match="violate"):
        M._dual(x @ x.T, np.where(np.arange(40) % 2, 1.0, -1.0), 10.0, steps=3)


def test_two_class_machine():
    x = np.array([[0.0], [1.0], [3.0], [4.0]])
    y = np.array([1.0, 1.0, -1.0, -1.0])
    k = x @ x.T
    a, bias = M._dual(k, y, 10.0)
    side = k @ (a * y) + bias
    assert np.allclose(side, [2.0, 1.0, -1.0, -2.0], atol=1e-3)


def test_knn_ties(spark):
    train = spark.createDataFrame([("1", "B", [1.0, 0.0]), ("2", "A", [1.0, 0.0])], SCHEMA)
    test = spark.createDataFrame([("q", "A", [2.0, 0.0])], SCHEMA)
    assert M.nearest_neighbours(train, test, 2).first()["pred"] == "A"
    assert M.nearest_neighbours(train, test, 1).first()["pred"] == "B"
    assert M.nearest_mean(train, test).first()["pred"] == "A"


def test_experiments(spark, blobs, tmp_path):
    assert G.grid(spark, k=[1, 2], w=["a", "b", "c"]).count() == 6
    columns = [("a", "g"), ("b", "g"), ("c", "h"), ("d", "h")]
    assert {n: len(v) for n, v in G.subsets(columns).items()} == {"ALL": 4, "only_g": 2, "only_h": 2, "ALL_minus_g": 2, "ALL_minus_h": 2}
    table = G.pivoted(G.ablate(*blobs, columns, ["ncm"]), "features", "method", ["ncm"])
    got = {r["features"]: r["ncm"] for r in table.collect()}
    assert got["only_g"] == got["ALL_minus_h"] and got["ALL"] > 0.9
    rows = spark.createDataFrame([("x", 0.5), ("y", 0.7), ("z", 0.7), ("n", None)], "m string, weighted_f1 double")
    assert G.best(rows, tie=["m"]).first()["m"] == "y"
    assert G.report(rows, spark.createDataFrame([("k",)], "other string")).columns == ["m", "weighted_f1", "other"]
    built = []
    build = lambda: built.append(1) or rows
    path = str(tmp_path / "stage")
    for force in (False, False, True):
        assert G.cached_stage(spark, path, build, force).count() == 4
    assert len(built) == 2


def test_affinity_rows_are_filled(spark):
    """Rows of many gaps against a plain filling."""
    rng = np.random.default_rng(5)
    cells = {(f"q{q}", int(t)): float(rng.random()) for q in range(20) for t in rng.choice(90, rng.integers(0, 30), replace=False)}
    m = spark.createDataFrame([(q, f"t{t}", v) for (q, t), v in cells.items()], "query string, target string, value double")
    t = spark.createDataFrame([(f"t{i}", i) for i in range(90)], "entry string, row_no long")
    q = spark.createDataFrame([(f"q{i}", "A") for i in range(20)], "entry string, label string")
    for r in R.affinity_features(m, q, t).collect():
        assert r["features"] == [cells.get((r["entry"], i), 0.0) for i in range(90)]


def test_affinity_vectors(spark):
    m = spark.createDataFrame([("q", "a", 2.0), ("q", "c", 1.0)], "query string, target string, value double")
    t = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "entry string, row_no long")
    q = spark.createDataFrame([("q", "A"), ("none", "B")], "entry string, label string")
    assert {r["entry"]: (r["label"], r["features"]) for r in R.affinity_features(m, q, t).collect()} == {"q": ("A", [2.0, 0.0, 1.0]), "none": ("B", [0.0, 0.0, 0.0])}


def test_affinity_rows_are_sparse(spark):
    """A row holds its hits only, whatever the width of the table, and models take it."""
    m = spark.createDataFrame([("q", "a", 2.0), ("q", "c", 1.0)], "query string, target string, value double")
    t = spark.createDataFrame([("a", 0), ("b", 1), ("c", 10**7)], "entry string, row_no long")
    q = spark.createDataFrame([("q", "A"), ("none", "B")], "entry string, label string")
    rows = R.affinity_vectors(m, q, t)
    got = {r["entry"]: r["features"] for r in rows.collect()}
    assert got["q"].size == got["none"].size == 10**7 + 1
    assert (got["q"].indices.tolist(), got["q"].values.tolist(), len(got["none"].indices)) == ([0, 10**7], [2.0, 1.0], 0)
    t = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "entry string, row_no long")
    rows = R.affinity_vectors(m, q, t)
    for model in (M.linear_svm, M.logistic_regression):
        assert {r["query"]: r["pred"] for r in model(rows, rows).collect()} == {"q": "A", "none": "B"}


def test_machine_without_its_kernel(monkeypatch):
    """Columns of the kernel are made as needed and few are held; weights are those of the whole matrix."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4))
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=300) > 0, 1.0, -1.0)
    whole, bias = M._dual(np.exp(-0.25 * ((x[:, None] - x[None]) ** 2).sum(-1)), y, 1.0)
    monkeypatch.setattr(M, "HELD", 300 * 20)
    kernel = M._Radial(x, 0.25)
    some, own = M._dual(kernel, y, 1.0)
    assert len(kernel.held) <= 20
    assert np.allclose(whole, some, atol=1e-3) and abs(bias - own) < 1e-3


def test_dual_reaches_its_tolerance():
    """Overlapping classes that take more than 2,000 pair updates."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3))
    y = np.where(rng.random(600) < 0.5, 1.0, -1.0)
    k = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(-1))
    a, _ = M._dual(k, y, 10.0)
    v = y - k @ (a * y)
    up, low = ((y > 0) & (a < 10)) | ((y < 0) & (a > 0)), ((y > 0) & (a > 0)) | ((y < 0) & (a < 10))
    assert v[up].max() - v[low].min() < 2e-4
    assert abs(a @ y) < 1e-6


def test_suite_query_has_every_model(spark, monkeypatch):
    from protolens.plans import relational_queries as Q

    monkeypatch.setattr(Q.M, "run_suite", lambda train, test, names=None: names or list(M.SUITE))
    assert Q.suite(spark, "/root/testdata/sf0.001") == list(M.SUITE)


def test_block_of_distances_holds_few_pairs():
    """Least distances are those of all pairs, with ties and far offsets, but only pairs that can be
    among the least are computed one by one."""
    import numpy as np
    import pyarrow as pa

    from protolens.operators import retrieval as R

    rng, held = np.random.default_rng(3), []
    a, b = rng.normal(size=(50, 8)) + 1000, rng.normal(size=(700, 8)) + 1000
    b[5:20] = b[5]
    a[0] = b[5]
    table = lambda x: pa.table({"entry": [f"{i:04}" for i in range(len(x))], "v": pa.array(x.tolist(), pa.list_(pa.float64()))})
    whole, R._distances = R._distances, lambda x, b, row, column: (held.append(len(row)), whole(x, b, row, column))[1]
    try:
        got = R._cell("l2", 5)(("",), table(a), table(b)).to_pydict()
    finally:
        R._distances = whole
    d = -np.round(np.sqrt(((b[None] - a[:, None]) ** 2).sum(2)), 6) + 0.0
    want = [(f"{i:04}", f"{j:04}", d[i, j]) for i in range(50) for j in np.lexsort((np.arange(700), -d[i]))[:5]]
    assert list(zip(got["query"], got["target"], got["sim"], strict=True)) == want and sum(held) < 50 * 40


def test_separators_take_few_tasks_a_pass(spark, monkeypatch):
    """Several separators are fitted at a time, so a pass takes few tasks whatever the cores, but more
    where a task would have too many rows."""
    data, seen = spark.range(90).selectExpr("string(id) entry", "string(id % 3) label", "array(double(id)) features"), []
    monkeypatch.setattr(M, "_fit_predict", lambda estimator, train, test, passes: seen.append((estimator.getParallelism(), passes)))
    M.linear_svm(data, data)
    monkeypatch.setattr(M, "PASS_ROWS", 10)
    M.linear_svm(data, data)
    assert seen == [(8, 4), (8, 9)]


def test_separators_of_wide_rows_are_fitted_in_turns(spark):
    """So many of them that what the driver holds does not grow with the width."""
    from pyspark.ml.linalg import Vectors

    rows = lambda width: spark.createDataFrame([("a", "x", Vectors.sparse(width, {0: 1.0}))], ["entry", "label", "features"])
    assert M.at_once(rows(1000)) == M.AT_ONCE
    assert [M.at_once(rows(n)) * n * M.VECTORS <= M.WEIGHTS for n in (200_000, 600_000, 1_000_000)] == [True] * 3
    assert M.at_once(rows(100_000_000)) == 1
