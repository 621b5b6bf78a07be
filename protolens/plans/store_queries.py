"""Queries of what outlives a run: logs of calls and stored models."""

from __future__ import annotations

from protolens.operators import ml as M
from protolens.operators import retrieval as R
from protolens.operators.store import ModelStore
from protolens.plans.data import table, vectors
from protolens.plans.retrieval_queries import ORACLES as RETRIEVAL_ORACLES
from protolens.sources import files as X
from protolens.sources.fetch import FetchLog


def _first(row):
    if row["url"] is None:
        return None
    if "net" in row["url"]:
        raise ValueError(row["url"])
    return str(len(row["url"]))


def _second(row):
    if "/es" in row["url"]:
        raise ConnectionError(row["url"])
    return str(len(row["url"]))


def _log(spark, sf_dir):
    """A log after two runs over all pages; the second calls what failed in the first."""
    log = FetchLog(spark, X.scratch(spark, "fetch"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    log.fetch(pages, "page_id", _first)
    return log, log.fetch(pages, "page_id", _second)


def fetch_status(spark, sf_dir):
    return _log(spark, sf_dir)[1]


def fetch_quarantine(spark, sf_dir):
    return _log(spark, sf_dir)[0].quarantine()


def stored_path(spark, sf_dir):
    """Predictions of a model that is fitted once and read by the second user."""
    train, test = M.scaled(*vectors(spark, sf_dir))
    store = ModelStore(spark)
    store.linear_path(train, [0.1, 1.0])
    return store.linear_path(train, [0.1, 1.0]).predict(test)


def ranked_head(spark, sf_dir):
    """The best five hits of each query from hits that were ranked when they were written."""
    train, test = vectors(spark, sf_dir)
    path = X.scratch(spark, "ranked")
    R.write_ranked(R.hits_from_vectors(test, train, 20), path)
    return R.read_ranked(spark, path, 5).select("query", "target", "bits", "prob", "rk")


QUERIES = {"ranked_head": ranked_head, "fetch_status": fetch_status, "fetch_quarantine": fetch_quarantine, "stored_path": stored_path}
_FAILS = "url IS NOT NULL AND contains(url, 'net') AND contains(url, '/es')"
ORACLES = {
    "ranked_head": RETRIEVAL_ORACLES["topk_hits"],
    "fetch_status": f"SELECT DISTINCT page_id::VARCHAR AS key, CASE WHEN url IS NULL THEN 'no_entry' WHEN {_FAILS} THEN 'error:ConnectionError' WHEN contains(url, 'net') THEN 'ok' ELSE 'exists' END AS status FROM pages WHERE page_id IS NOT NULL",
    "fetch_quarantine": f"SELECT page_id::VARCHAR AS key, url AS error, 2::INT AS run FROM pages WHERE {_FAILS}",
}
