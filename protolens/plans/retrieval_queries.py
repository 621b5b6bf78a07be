"""Queries of retrieval, voting, ensembles and evaluation over the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protolens.operators import ensemble as N
from protolens.operators import metrics as A
from protolens.operators import ml as M
from protolens.operators import retrieval as R
from protolens.operators import vote as V
from protolens.plans.data import truth, vectors

KS, THRESHOLDS, MIN_PROBS = [1, 3, 5, 10, 20], [0.3, 0.5, 0.7, 0.9], [0.0, 0.6, 0.65, 0.7]
SWEEP_KS, BACKED = [1, 3, 5], ["bits", "alntmscore"]


def _hits(spark: SparkSession, sf_dir: str, k: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    train, test = vectors(spark, sf_dir)
    return train, test, R.hits_from_vectors(test, train, k)


def topk_hits(spark, sf_dir):
    _, _, hits = _hits(spark, sf_dir, 5)
    return R.top_k(hits, 5).select("query", "target", "bits", "prob", F.col("rk").cast("long").alias("rk"))


def top1(spark, sf_dir):
    train, _, hits = _hits(spark, sf_dir, 1)
    return R.top_1(hits, train)


def vote_k5_bits(spark, sf_dir):
    train, _, hits = _hits(spark, sf_dir, 5)
    return V.vote(hits, train, 5)


def vote_k10_lddt_min_prob(spark, sf_dir):
    train, _, hits = _hits(spark, sf_dir)
    return V.vote(hits, train, 10, "lddt", min_prob=0.65)


def vote_f1(spark, sf_dir):
    train, test, hits = _hits(spark, sf_dir, 5)
    return A.evaluate(truth(test), V.vote(hits, train, 5))


def vote_f1_predicted_only(spark, sf_dir):
    train, test, hits = _hits(spark, sf_dir)
    return A.evaluate_predicted_only(truth(test), V.vote(hits, train, 5, min_prob=0.65))


def sweep_vote(spark, sf_dir):
    train, test, hits = _hits(spark, sf_dir)
    return A.evaluate(truth(test), V.vote_sweep(hits, train, KS, V.WEIGHTS), ["k", "weight"], A.combinations(k=KS, weight=V.WEIGHTS))


def sweep_vote_fallback(spark, sf_dir):
    """k x weight x threshold alone (60), and with the nearest mean as fallback (18)."""
    train, test, hits = _hits(spark, sf_dir)
    found = V.vote_sweep(hits, train, SWEEP_KS, V.WEIGHTS, MIN_PROBS).select("k", "weight", "min_prob", "query", F.col("pred").alias("r"))
    model = M.nearest_mean(train, test).select("query", F.col("pred").alias("m"))
    by = ["k", "weight", "min_prob"]
    alone, backed = A.combinations(k=SWEEP_KS, weight=V.WEIGHTS, min_prob=MIN_PROBS), A.combinations(k=SWEEP_KS, weight=BACKED, min_prob=MIN_PROBS[:3])
    preds = A.with_truth(test.select(F.col("entry").alias("query"), F.lit("").alias("true")), found.withColumnRenamed("r", "pred"), by, alone).select(*by, "query", F.expr(f"nullif(pred, '{A.MISSING}')").alias("pred"))
    first = A.evaluate(truth(test), preds, by, alone).withColumn("fallback", F.lit("none"))
    both = preds.join(model, "query", "left").select(*by, "query", F.coalesce("pred", "m").alias("pred"))
    return first.unionByName(A.evaluate(truth(test), both, by, backed).withColumn("fallback", F.lit("ncm")))


def best_config(spark, sf_dir):
    from protolens.operators.experiment import best

    return best(sweep_vote(spark, sf_dir), tie=["k", "weight"])


def _voters(spark, sf_dir):
    train, test = vectors(spark, sf_dir)
    r = R.top_1(R.hits_from_vectors(test, train, 1), train)
    return test.select(F.col("entry").alias("query")), test, r, [M.nearest_neighbours(train, test, 1), M.nearest_neighbours(train, test, 5), M.nearest_mean(train, test)]


def ncm(spark, sf_dir):
    return M.nearest_mean(*vectors(spark, sf_dir))


def _knn(k, metric):
    return lambda spark, sf_dir: M.nearest_neighbours(*vectors(spark, sf_dir), k, metric)


def knn_l2_scaled_5(spark, sf_dir):
    return M.nearest_neighbours(*M.scaled(*vectors(spark, sf_dir)), 5, "l2")


def fallback(spark, sf_dir):
    q, _, r, v = _voters(spark, sf_dir)
    return N.fallback(q, r.where("prob >= 0.65"), v[2])


def gate_0_65(spark, sf_dir):
    q, _, r, v = _voters(spark, sf_dir)
    return N.gate(q, r, v[2], 0.65)


def gate_sweep_f1(spark, sf_dir):
    q, test, r, v = _voters(spark, sf_dir)
    return A.evaluate(truth(test), N.gate_sweep(q, r, v[2], THRESHOLDS), ["threshold"], A.combinations(threshold=THRESHOLDS))


def coverage(spark, sf_dir):
    return A.sources_used(gate_0_65(spark, sf_dir))


def agreement_prefer_retrieval(spark, sf_dir):
    q, _, r, v = _voters(spark, sf_dir)
    return N.agreement(q, r, v[2])


def agreement_prefer_model(spark, sf_dir):
    q, _, r, v = _voters(spark, sf_dir)
    return N.agreement(q, r, v[2], "model")


def agreement_gaps(spark, sf_dir):
    """Agreement where the retrieval has no answer for its less sure rows, the model none for
    some of its classes."""
    q, _, r, v = _voters(spark, sf_dir)
    return N.agreement(q, r.where("prob >= 0.66"), v[2].where("pred > '4'"), "model")


def layered(spark, sf_dir):
    q, _, r, v = _voters(spark, sf_dir)
    """Sure retrievals, then neighbours where the retrieval is less sure, then the class means."""
    return N.layered(q, r.where("prob >= 0.72"), v[1].join(r.where("prob >= 0.68"), "query", "left_semi"), v[2])


def majority(spark, sf_dir):
    q, _, _, v = _voters(spark, sf_dir)
    return N.voted(q, *v)


def majority_of_two(spark, sf_dir):
    q, _, _, v = _voters(spark, sf_dir)
    return N.voted(q, v[2], v[1])


def headline_ensemble(spark, sf_dir):
    q, _, r, v = _voters(spark, sf_dir)
    return N.gated_majority(q, r, v, 0.65).select("query", "pred", "source")


def headline_f1(spark, sf_dir):
    q, test, r, v = _voters(spark, sf_dir)
    return A.evaluate(truth(test), N.gated_majority(q, r, v, 0.65))


def affinity_long(spark, sf_dir):
    train, test, hits = _hits(spark, sf_dir)
    return R.affinity(hits, test, train)


def affinity_log1p(spark, sf_dir):
    return R.log1p(affinity_long(spark, sf_dir).withColumn("value", F.greatest("value", F.lit(0.0)))).withColumn("value", F.round("value", 9))


def affinity_argmax(spark, sf_dir):
    train, test, hits = _hits(spark, sf_dir)
    return R.argmax_label(R.affinity(hits, test, train), test, train)


def affinity_argmax_first(spark, sf_dir):
    train, test, hits = _hits(spark, sf_dir)
    return R.argmax_label(R.affinity(hits, test, train).where("value > 0.4"), test, train, guess_first=True)


def selfhit_masked(spark, sf_dir):
    train, _ = vectors(spark, sf_dir)
    matrix = R.affinity(R.hits_from_vectors(train, train, 3), train, train, mask_self=True)
    return matrix.join(R.with_any_hit(train, matrix).select(F.col("entry").alias("query")), "query", "left_semi")


def class_size_hist(spark, sf_dir):
    return A.class_sizes(vectors(spark, sf_dir)[0])


def class_size_hist_dense(spark, sf_dir):
    return A.class_sizes(vectors(spark, sf_dir)[0], dense=True)


_V = "v AS (SELECT vec_id::VARCHAR AS entry, vec_id AS row_no, label::VARCHAR AS label, list_transform(embedding, lambda x: x::DOUBLE) AS f FROM embeddings), te AS (SELECT * FROM v WHERE row_no % 5 = 0), tr AS (SELECT * FROM v WHERE row_no % 5 <> 0)"
_HITS = _V + """, sims AS (SELECT q.entry AS query, t.entry AS target, t.label, t.row_no, round(list_cosine_similarity(q.f, t.f), 6) + 0.0 AS bits FROM te q, tr t),
hits AS (SELECT *, (bits + 1) / 2 AS prob, bits * bits AS alntmscore, abs(bits) AS lddt, 1.0::DOUBLE AS uniform, row_number() OVER (PARTITION BY query ORDER BY bits DESC, target) AS rk FROM sims QUALIFY rk <= 20),
truth AS (SELECT entry AS query, label AS "true" FROM te)"""


def vote_sql(source: str, weight: str, by: str = "query") -> str:
    """Votes of ranked rows ``source`` (by, label, rk and the weight)."""
    return f"""SELECT {by}, first(label ORDER BY (label IS NULL), s DESC, fr) AS pred, CASE WHEN count(label) = 0 THEN 0 ELSE sum(n) END::BIGINT AS n_hits,
      coalesce(max(s) FILTER (label IS NOT NULL), 0.0)::DOUBLE AS top_score
      FROM (SELECT {by}, label, round(sum({weight}), 9) AS s, min(rk) AS fr, count(*) AS n FROM {source} GROUP BY {by}, label) GROUP BY {by}"""


def f1_sql(judged: str, by: str = "", counts: bool = True) -> str:
    """Weighted F1 of rows ``judged`` (by, true, pred)."""
    b = f"{by}, " if by else ""
    g = f"GROUP BY {by}" if by else ""
    more = ", max(n_predicted)::BIGINT AS n_predicted, max(n_none)::BIGINT AS n_none" if counts else ""
    return f"""SELECT {b}round(sum(sup * CASE WHEN sup + got > 0 THEN 2.0::DOUBLE * tp / (sup + got) ELSE 0 END) / sum(sup), 6) AS weighted_f1 {more} FROM (
      SELECT {b}c, sum(tp) AS tp, sum(sup) AS sup, sum(got) AS got, max(n_predicted) AS n_predicted, max(n_none) AS n_none FROM (
        SELECT {b}"true" AS c, ("true" = pred)::INT AS tp, 1 AS sup, 0 AS got, count(*) FILTER (pred <> '__none__') OVER w AS n_predicted, count(*) FILTER (pred = '__none__') OVER w AS n_none FROM {judged} WINDOW w AS ({"PARTITION BY " + by if by else ""})
        UNION ALL SELECT {b}pred, 0, 0, 1, 0, 0 FROM {judged}) GROUP BY {b}c) {g}"""


def judged_sql(preds: str) -> str:
    return f"""SELECT "true", coalesce(pred, '__none__') AS pred FROM truth LEFT JOIN (SELECT query, pred FROM {preds}) USING (query)"""


_UNIT = "list_transform({0}, lambda x: CASE WHEN n > 0 THEN x / n ELSE x END)"
_NCM = f""", u AS (SELECT label, {_UNIT.format('f')} AS f FROM (SELECT *, sqrt(list_dot_product(f, f)) AS n FROM tr)),
m0 AS (SELECT label, list(a ORDER BY p) AS f FROM (SELECT label, p, avg(x) AS a FROM (SELECT label, unnest(f) AS x, generate_subscripts(f, 1) AS p FROM u) GROUP BY ALL) GROUP BY label),
ncm AS (SELECT q.entry AS query, first(m0.label ORDER BY round(list_cosine_similarity(q.f, m0.f), 6) DESC, m0.label) AS pred FROM te q, m0 GROUP BY q.entry)"""


def knn_sql(k: int, metric: str = "cosine") -> str:
    sim = "round(list_cosine_similarity(q.f, t.f), 6)" if metric == "cosine" else "-round(list_distance(q.f, t.f), 6)"
    return f"""SELECT query, first(label ORDER BY n DESC, label) AS pred FROM (SELECT query, label, count(*) AS n FROM (
      SELECT q.entry AS query, t.label FROM te q, tr t QUALIFY row_number() OVER (PARTITION BY q.entry ORDER BY {sim} DESC, t.entry) <= {k}) GROUP BY ALL) GROUP BY query"""


_VOTERS = _HITS + _NCM + f""", r AS (SELECT query, label AS pred, prob FROM hits WHERE rk = 1), k1 AS ({knn_sql(1)}), k5 AS ({knn_sql(5)}),
maj AS (SELECT query, CASE WHEN k1.pred = k5.pred OR k1.pred = ncm.pred OR k5.pred <> ncm.pred THEN k1.pred ELSE k5.pred END AS pred FROM k1 JOIN k5 USING (query) JOIN ncm USING (query)),
gated AS (SELECT query, CASE WHEN prob >= 0.65 THEN r.pred ELSE ncm.pred END AS pred, CASE WHEN prob >= 0.65 THEN 'retrieval' ELSE 'fallback' END AS source FROM r JOIN ncm USING (query)),
head AS (SELECT query, CASE WHEN prob >= 0.65 THEN r.pred ELSE maj.pred END AS pred, CASE WHEN prob >= 0.65 THEN 'retrieval' ELSE 'fallback' END AS source FROM r JOIN maj USING (query))"""
_EACH = " UNION ALL ".join(f"SELECT {k} AS k, '{w}' AS weight, query, label, rk, {w}::DOUBLE AS w FROM hits WHERE rk <= {k}" for k in KS for w in V.WEIGHTS)
_SWEEP = f"WITH {_HITS}, each AS ({_EACH}), preds AS ({vote_sql('each', 'w', 'k, weight, query')}), conf AS (SELECT DISTINCT k, weight FROM preds), j AS (SELECT conf.k, conf.weight, \"true\", coalesce(pred, '__none__') AS pred FROM conf CROSS JOIN truth LEFT JOIN preds ON preds.k = conf.k AND preds.weight = conf.weight AND preds.query = truth.query)"
_EACH3 = " UNION ALL ".join(f"SELECT {k} AS k, '{w}' AS weight, {t}::DOUBLE AS min_prob, query, label, row_number() OVER (PARTITION BY query ORDER BY bits DESC, target) AS rk, {w}::DOUBLE AS w FROM hits WHERE {t} <= 0 OR prob >= {t} QUALIFY row_number() OVER (PARTITION BY query ORDER BY bits DESC, target) <= {k}" for k in SWEEP_KS for w in V.WEIGHTS for t in MIN_PROBS)
_CONF = "(" + " UNION ALL ".join(f"SELECT {k} AS k, '{w}' AS weight, {t}::DOUBLE AS min_prob, '{b}' AS fallback" for b, ws, ts in (("none", V.WEIGHTS, MIN_PROBS), ("ncm", BACKED, MIN_PROBS[:3])) for k in SWEEP_KS for w in ws for t in ts) + ")"

QUERIES = {
    "topk_hits": topk_hits, "top1": top1, "vote_k5_bits": vote_k5_bits, "vote_k10_lddt_min_prob": vote_k10_lddt_min_prob, "vote_f1": vote_f1,
    "vote_f1_predicted_only": vote_f1_predicted_only, "sweep_vote": sweep_vote, "sweep_vote_fallback": sweep_vote_fallback, "best_config": best_config, "ncm": ncm,
    "knn_cos_1": _knn(1, "cosine"), "knn_cos_3": _knn(3, "cosine"), "knn_cos_5": _knn(5, "cosine"), "knn_l2_1": _knn(1, "l2"), "knn_l2_3": _knn(3, "l2"), "knn_l2_5": _knn(5, "l2"),
    "knn_l2_scaled_5": knn_l2_scaled_5, "fallback": fallback, "gate_0_65": gate_0_65, "gate_sweep_f1": gate_sweep_f1, "coverage": coverage,
    "agreement_prefer_retrieval": agreement_prefer_retrieval, "agreement_prefer_model": agreement_prefer_model, "agreement_gaps": agreement_gaps, "layered": layered, "majority": majority, "majority_of_two": majority_of_two,
    "headline_ensemble": headline_ensemble, "headline_f1": headline_f1, "affinity_long": affinity_long, "affinity_log1p": affinity_log1p, "affinity_argmax": affinity_argmax,
    "affinity_argmax_first": affinity_argmax_first, "selfhit_masked": selfhit_masked, "class_size_hist": class_size_hist, "class_size_hist_dense": class_size_hist_dense,
}

ORACLES = {
    "topk_hits": f"WITH {_HITS} SELECT query, target, bits, prob, rk FROM hits WHERE rk <= 5",
    "top1": f"WITH {_HITS} SELECT query, target, label AS pred, prob FROM hits WHERE rk = 1",
    "vote_k5_bits": f"WITH {_HITS} {vote_sql('(SELECT * FROM hits WHERE rk <= 5)', 'bits')}",
    "vote_k10_lddt_min_prob": f"WITH {_HITS}, x AS (SELECT query, label, lddt, row_number() OVER (PARTITION BY query ORDER BY bits DESC, target) AS rk FROM hits WHERE prob >= 0.65 QUALIFY row_number() OVER (PARTITION BY query ORDER BY bits DESC, target) <= 10) {vote_sql('x', 'lddt')}",
    "vote_f1": f"WITH {_HITS}, p AS ({vote_sql('(SELECT * FROM hits WHERE rk <= 5)', 'bits')}), j AS ({judged_sql('p')}) {f1_sql('j')}",
    "vote_f1_predicted_only": f"WITH {_HITS}, x AS (SELECT query, label, bits, row_number() OVER (PARTITION BY query ORDER BY bits DESC, target) AS rk FROM hits WHERE prob >= 0.65 QUALIFY row_number() OVER (PARTITION BY query ORDER BY bits DESC, target) <= 5), p AS ({vote_sql('x', 'bits')}), j AS (SELECT \"true\", pred FROM truth JOIN p USING (query)) {f1_sql('j', counts=False)}",
    "sweep_vote": f"{_SWEEP} {f1_sql('j', 'k, weight')}",
    "sweep_vote_fallback": f"WITH {_HITS}{_NCM}, each AS ({_EACH3}), preds AS ({vote_sql('each', 'w', 'k, weight, min_prob, query')}), conf AS {_CONF}, j AS (SELECT conf.k, conf.weight, conf.min_prob, conf.fallback, \"true\", coalesce(p.pred, CASE WHEN fallback = 'ncm' THEN ncm.pred END, '__none__') AS pred FROM conf CROSS JOIN truth JOIN ncm ON ncm.query = truth.query LEFT JOIN preds p ON p.k = conf.k AND p.weight = conf.weight AND p.min_prob = conf.min_prob AND p.query = truth.query) {f1_sql('j', 'k, weight, min_prob, fallback')}",
    "best_config": f"{_SWEEP} SELECT * FROM ({f1_sql('j', 'k, weight')}) ORDER BY weighted_f1 DESC, k, weight LIMIT 1",
    "ncm": f"WITH {_HITS}{_NCM} SELECT * FROM ncm",
    **{f"knn_cos_{k}": f"WITH {_V} {knn_sql(k)}" for k in (1, 3, 5)},
    **{f"knn_l2_{k}": f"WITH {_V} {knn_sql(k, 'l2')}" for k in (1, 3, 5)},
    "knn_l2_scaled_5": f"""WITH v AS (SELECT vec_id::VARCHAR AS entry, vec_id AS row_no, label::VARCHAR AS label, list_transform(embedding, lambda x: x::DOUBLE) AS f0 FROM embeddings),
      s AS (SELECT list(m ORDER BY p) AS m, list(d ORDER BY p) AS d FROM (SELECT p, avg(x) AS m, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS d FROM (SELECT unnest(f0) AS x, generate_subscripts(f0, 1) AS p FROM v WHERE row_no % 5 <> 0) GROUP BY p)),
      w AS (SELECT entry, row_no, label, list_transform(list_zip(f0, m, d), lambda z: (z[1] - z[2]) / z[3]) AS f FROM v, s), te AS (SELECT * FROM w WHERE row_no % 5 = 0), tr AS (SELECT * FROM w WHERE row_no % 5 <> 0) {knn_sql(5, 'l2')}""",
    "fallback": f"WITH {_VOTERS} SELECT query, coalesce(x.pred, ncm.pred) AS pred, CASE WHEN x.pred IS NOT NULL THEN 'retrieval' ELSE 'fallback' END AS source FROM ncm LEFT JOIN (SELECT * FROM r WHERE prob >= 0.65) x USING (query)",
    "gate_0_65": f"WITH {_VOTERS} SELECT * FROM gated",
    "gate_sweep_f1": f"WITH {_VOTERS}, j AS (SELECT t AS threshold, \"true\", CASE WHEN prob >= t THEN r.pred ELSE ncm.pred END AS pred FROM truth JOIN r USING (query) JOIN ncm USING (query), (SELECT unnest([0.3, 0.5, 0.7, 0.9])::DOUBLE AS t)) {f1_sql('j', 'threshold')}",
    "coverage": f"WITH {_VOTERS} SELECT count(*) FILTER (source = 'retrieval') AS n_retrieval, count(*) FILTER (source = 'fallback') AS n_fallback, count(*) FILTER (source IS NULL) AS n_none FROM gated",
    "agreement_prefer_retrieval": f"WITH {_VOTERS} SELECT query, pred FROM r",
    "agreement_prefer_model": f"WITH {_VOTERS} SELECT query, pred FROM ncm",
    "agreement_gaps": f"WITH {_VOTERS} SELECT query, coalesce(CASE WHEN ncm.pred > '4' THEN ncm.pred END, CASE WHEN prob >= 0.66 THEN r.pred END) AS pred FROM r JOIN ncm USING (query)",
    "layered": f"WITH {_VOTERS} SELECT query, CASE WHEN prob >= 0.72 THEN r.pred WHEN prob >= 0.68 THEN k5.pred ELSE ncm.pred END AS pred FROM r JOIN k5 USING (query) JOIN ncm USING (query)",
    "majority": f"WITH {_VOTERS} SELECT * FROM maj",
    "majority_of_two": f"WITH {_VOTERS} SELECT * FROM ncm",
    "headline_ensemble": f"WITH {_VOTERS} SELECT * FROM head",
    "headline_f1": f"WITH {_VOTERS}, j AS ({judged_sql('head')}) {f1_sql('j')}",
    "affinity_long": f"WITH {_HITS} SELECT query, target, bits AS value FROM hits",
    "affinity_log1p": f"WITH {_HITS} SELECT query, target, round(ln(1 + greatest(bits, 0.0)), 9) AS value FROM hits",
    "affinity_argmax": f"WITH {_HITS} SELECT te.entry AS query, b.pred FROM te LEFT JOIN (SELECT query, first(label ORDER BY bits DESC, row_no) AS pred FROM hits WHERE bits > 0 GROUP BY query) b ON b.query = te.entry",
    "affinity_argmax_first": f"WITH {_HITS} SELECT te.entry AS query, coalesce(b.pred, (SELECT first(label ORDER BY row_no) FROM tr)) AS pred FROM te LEFT JOIN (SELECT query, first(label ORDER BY bits DESC, row_no) AS pred FROM hits WHERE bits > 0.4 GROUP BY query) b ON b.query = te.entry",
    "selfhit_masked": f"WITH {_V}, s AS (SELECT q.entry AS query, t.entry AS target, round(list_cosine_similarity(q.f, t.f), 6) + 0.0 AS value FROM tr q, tr t QUALIFY row_number() OVER (PARTITION BY q.entry ORDER BY round(list_cosine_similarity(q.f, t.f), 6) DESC, t.entry) <= 3), m AS (SELECT * FROM s WHERE query <> target) SELECT * FROM m WHERE query IN (SELECT query FROM m WHERE value > 0)",
    "class_size_hist": f"WITH {_V} SELECT size, count(*) AS n_classes FROM (SELECT count(*) AS size FROM tr GROUP BY label) GROUP BY size",
    "class_size_hist_dense": f"WITH {_V}, c AS (SELECT count(*) AS size FROM tr GROUP BY label) SELECT g AS size, count(c.size) AS n_classes FROM (SELECT unnest(range(0, (SELECT max(size) FROM c) + 1)) AS g) LEFT JOIN c ON c.size = g GROUP BY g",
}
