"""The registered queries on the driver's smallest tables, against plain versions or SQL."""

import hashlib
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from protolens.llm.registry import ORACLES, QUERIES

sys.path.insert(0, str(Path(__file__).parent))
import test_secret_scan  # noqa: E402
import test_simhash  # noqa: E402
import test_suffix_dedup  # noqa: E402

DIR = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]


def rows(df, *names):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = c.sql(ORACLES[name])
    names = sorted(want.columns)
    df = QUERIES[name](spark, DIR)
    assert sorted(df.columns) == names
    assert rows(df, *names) == sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in want.project(", ".join(names)).fetchall()), key=str)


def test_op3(spark, docs):
    got = QUERIES["op3_quality"](spark, DIR).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, _ in docs)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p == t for p, t in held]) >= 0.9


def test_op5(spark):
    got = QUERIES["op5_ann"](spark, DIR).toPandas()
    e = spark.read.parquet(f"{DIR}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, x = e["vec_id"].to_numpy(), np.array(e["embedding"].tolist(), float)
    assert set(got["query_id"]) == {i for i in ids if i % 100 == 0}
    found = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        found += len(set(g["vec_id"]) & set(ids[np.lexsort((ids, d))[:10]]))
        assert np.allclose(g.sort_values("rank")["score"], [d[ids == v][0] for v in g.sort_values("rank")["vec_id"]])
    assert found >= 0.9 * len(got)


def test_op6(spark, docs):
    got = rows(QUERIES["op6_suffix_dedup"](spark, DIR), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == test_suffix_dedup.brute(docs)


def test_op8(spark, docs):
    got = rows(QUERIES["op8_simhash"](spark, DIR), "doc_id", "fingerprint", "component_id")
    prints = {d: np.uint64(test_simhash.plain(t)).view(np.int64).item() for d, t in docs}
    root = test_simhash.roots(set(prints.values()), test_simhash.near(set(prints.values())))
    least: dict[int, int] = {}
    for d, p in prints.items():
        least[root[p]] = min(d, least.get(root[p], d))
    assert got == sorted(((d, f"{p % (1 << 64):016x}", least[root[p]]) for d, p in prints.items()), key=str)


def test_op9(spark, docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert rows(QUERIES["op9_bpe"](spark, DIR), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)


def test_op10(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op10_secret_scan"](spark, DIR).collect()}
    assert len(got) == len(docs)
    for d, text in docs:
        base = test_secret_scan.base(text or "")
        kinds = [x.split(":")[0] for x in base.split(",")] if base else []
        r = got[d]
        assert r["base_sha256"] == sha(base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(map(kinds.count, ("assign", "access", "hex")))
        assert set(base.split(",")) - {""} <= set(r["spans"].split(","))
