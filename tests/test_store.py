"""Logs of calls that are cut off and go on, and models that are fitted once."""

import numpy as np
import pytest

from protolens.operators import path as L
from protolens.operators import retrieval as R
from protolens.operators import store as S
from protolens.sources.fetch import FetchLog

KEYS = "id string, size long"


def pages(spark, n=30):
    return spark.createDataFrame([*[(f"k{i:02}", i) for i in range(n)], ("k03", 3), (None, 1)], KEYS).repartition(3)


def statuses(df):
    return {r["key"]: r["status"] for r in df.collect()}


def test_statuses(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def call(row):
        with open(calls / row["id"], "a") as f:
            f.write("x")
        if row["size"] % 5 == 0:
            raise ValueError(f"bad {row['id']}")
        if row["size"] % 7 == 0:
            raise KeyError(row["id"])
        return None if row["size"] % 11 == 0 else f"value {row['size']}"

    log = FetchLog(spark, str(tmp_path / "log"))
    first = statuses(log.fetch(pages(spark), "id", call, tries=2))
    kind = lambda i: "error:ValueError" if i % 5 == 0 else "no_entry" if i % 7 == 0 or i % 11 == 0 else "ok"
    assert first == {f"k{i:02}": kind(i) for i in range(30)}
    assert {p.name: len(p.read_text()) for p in calls.iterdir()} == {f"k{i:02}": 2 if i % 5 == 0 else 1 for i in range(30)}
    assert {(r["key"], r["error"]) for r in log.quarantine().collect()} == {(f"k{i:02}", f"bad k{i:02}") for i in range(0, 30, 5)}
    again = statuses(log.fetch(pages(spark), "id", lambda row: "late", tries=1))
    assert again == {k: {"ok": "exists", "no_entry": "no_entry"}.get(v, "ok") for k, v in first.items()}
    values = {r["key"]: r["value"] for r in log.latest().where("status = 'ok'").collect()}
    assert values["k01"] == "value 1" and values["k05"] == "late"
    assert log.quarantine().count() == 0
    assert log.fetch(pages(spark).limit(0), "id", call).count() == 0


def test_cut_off_run_goes_on(spark, tmp_path):
    """A run that dies after some waves: the next calls only the rest."""
    log, seen = FetchLog(spark, str(tmp_path / "log")), tmp_path / "seen"
    seen.mkdir()
    write = FetchLog.rows

    def call(row):
        (seen / row["id"]).write_text("x")
        return "v"

    class Dies(Exception):
        pass

    waves = []
    original = spark.createDataFrame([("k",)], "key string").write.__class__.parquet

    def parquet(self, *a, **k):
        if len(waves) == 2:
            raise Dies
        waves.append(1)
        return original(self, *a, **k)

    with pytest.MonkeyPatch.context() as m, pytest.raises(Dies):
        m.setattr(spark.createDataFrame([("k",)], "key string").write.__class__, "parquet", parquet)
        log.fetch(pages(spark), "id", call, waves=4)
    assert FetchLog.rows is write
    before = {p.name for p in seen.iterdir()}
    assert 0 < len(before) < 30
    for p in seen.iterdir():
        p.unlink()
    got = statuses(log.fetch(pages(spark), "id", call, waves=4))
    assert {p.name for p in seen.iterdir()} == {f"k{i:02}" for i in range(30)} - before
    assert got == {f"k{i:02}": "exists" if f"k{i:02}" in before else "ok" for i in range(30)}


def test_ranked_hits(spark, tmp_path):
    """Written ranks are those of a window over the hits, and reading needs neither shuffle nor sort."""
    g = np.random.default_rng(4)
    rows = [(f"q{i % 9}", f"t{i}", float(v)) for i, v in enumerate(g.integers(0, 20, 300))]
    hits = spark.createDataFrame(rows, "query string, target string, bits double").repartition(5)
    R.write_ranked(hits, str(tmp_path / "hits"))
    for k in (1, 3, 50):
        got = R.read_ranked(spark, str(tmp_path / "hits"), k)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, R.top_k(hits, k).collect()))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan and "PushedFilters: [IsNotNull(rk), LessThanOrEqual(rk" in plan
    assert R.read_ranked(spark, str(tmp_path / "hits")).count() == 300


def test_models(spark, tmp_path, monkeypatch):
    g = np.random.default_rng(2)
    rows = [(f"e{i}", f"c{i % 3}", [float(v) for v in g.normal(i % 3, 1, 4)]) for i in range(60)]
    train = spark.createDataFrame(rows, "entry string, label string, features array<double>")
    store, fits = S.ModelStore(spark, str(tmp_path / "models")), []
    fit = L.fit_path
    monkeypatch.setattr(S, "fit_path", lambda *a, **k: fits.append(1) or fit(*a, **k))
    first = store.linear_path(train, [0.1, 1.0])
    second = S.ModelStore(spark, str(tmp_path / "models")).linear_path(train.repartition(7).orderBy("entry"), [0.1, 1.0])
    assert len(fits) == 1 and np.array_equal(first.weights, second.weights) and first.labels == second.labels == ["c0", "c1", "c2"]
    direct = fit(train, [0.1, 1.0])
    assert np.allclose(direct.weights, second.weights, atol=1e-3)
    assert [tuple(r) for r in second.predict(train).orderBy("c", "query").collect()] == [tuple(r) for r in direct.predict(train).orderBy("c", "query").collect()]
    store.linear_path(train, [0.1])
    store.linear_path(train.limit(50), [0.1, 1.0])
    hinge = store.linear_path(train, [0.1, 1.0], "hinge")
    assert len(fits) == 4 and max(hinge.gaps) < 1e-2
    assert S.fingerprint(train.union(train.limit(1))) != S.fingerprint(train)
