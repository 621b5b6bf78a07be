"""Queries of filters, alignments, unions, reports and vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from protolens.functions import sequence as S
from protolens.functions import vector as X
from protolens.operators import ensemble as N
from protolens.operators import experiment as G
from protolens.operators import ml as M
from protolens.operators import relational as J
from protolens.operators import retrieval as R
from protolens.plans.data import table, vectors
from protolens.plans.retrieval_queries import _NCM, _V, f1_sql, knn_sql

WIDTHS = [("g1", 16), ("g2", 40), ("g3", 8)]
ABLATED = ["ncm", "knn_cos_1", "knn_cos_3", "knn_cos_5"]
COLUMNS = [(f"{g}_{i}", g) for g, n in WIDTHS for i in range(n)]


def _both(spark, sf_dir):
    a, b = vectors(spark, sf_dir)
    return J.all_splits(train=a, test=b)


def _values(df, name="features"):
    """Long form with rounded values."""
    return df.select("entry", F.posexplode(name).alias("pos", "value")).select("entry", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


def union_splits(spark, sf_dir):
    return _both(spark, sf_dir).select("split", "entry", "label")


def l2norm(spark, sf_dir):
    return _values(_both(spark, sf_dir).select("entry", X.l2_normalize(F.col("features")).alias("features")))


def standardize(spark, sf_dir):
    return _values(M.scaled(*vectors(spark, sf_dir))[1])


def standardize_without_mean(spark, sf_dir):
    return _values(M.scaled(*vectors(spark, sf_dir), with_mean=False)[1])


def concat_blocks(spark, sf_dir):
    v = _both(spark, sf_dir)
    left = v.withColumn("features", X.slice_range(F.col("features"), 0, 16))
    return _values(N.concat_vectors(left, v.withColumn("features", X.slice_range(F.col("features"), 16, 64))))


def slice_groups(spark, sf_dir):
    v = _both(spark, sf_dir)
    return _values(v.withColumn("features", X.keep_ordinals(F.col("features"), X.group_ordinals(COLUMNS, drop="g2"))))


def align_inner(spark, sf_dir):
    v = _both(spark, sf_dir)
    a, b = v.where("features[0] > 0"), v.where("features[1] > 0")  # tables that overlap in part
    half = lambda d, i: d.select("split", "entry", "label", X.slice_range(F.col("features"), i, i + 4).alias("features"))
    return _values(J.align(half(a, 0), half(b, 8), ["split", "entry"]))


def align_strict(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return J.align_strict(o.select("o_orderkey", "o_custkey"), c, "o_custkey", "c_mktsegment").select("o_orderkey", "c_mktsegment")


def label_mismatch(spark, sf_dir):
    t = table(spark, sf_dir, "labels")
    return J.label_mismatches(t.select("doc_id", F.col("quality").alias("label")), t.select("doc_id", F.col("toxic").alias("label")), ["doc_id"])


def _labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(":", "lang", (F.col("n_chars") % 97).cast("string")).alias("label"))
    return d.where("doc_id % 5 <> 0"), d.where("doc_id % 5 = 0")


def known_label_semi(spark, sf_dir):
    train, test = _labelled(spark, sf_dir)
    return J.known_labels(test, train)


def unseen_anti(spark, sf_dir):
    train, test = _labelled(spark, sf_dir)
    return J.unseen_labels(test, train)


def look_up_left(spark, sf_dir):
    t = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("entry"), F.col("quality").alias("label"), F.col("doc_id").alias("row_no"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("target"))
    return J.look_up(d, t, "target").select("target", J.or_missing(F.col("label").cast("string")).alias("label"))


def _status(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("split"), F.col("o_orderstatus").alias("status"))


def status_counts(spark, sf_dir):
    return J.status_counts(_status(spark, sf_dir))


def status_coverage(spark, sf_dir):
    return J.coverage(_status(spark, sf_dir), ("F", "O"))


def not_like(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("query"), F.col("p_type").alias("target"), "p_partkey")
    return R.drop_outputs(p, "ring").select("p_partkey")


def threshold_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("query"), F.col("event_id").cast("string").alias("target"), F.col("value").alias("bits"), (F.col("value") / 500).alias("prob"))
    return R.top_k(e, 3, min_prob=0.5).select("query", "target", "bits", F.col("rk").cast("long").alias("rk"))


def dropna_distinct(spark, sf_dir):
    t = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return t.dropna(subset=["quality"]).groupBy("source").agg(F.count_distinct("lang", "quality").alias("n"))


def report_union(spark, sf_dir):
    a = status_counts(spark, sf_dir)
    return G.report(a, status_coverage(spark, sf_dir)).select("split", "status", "n", "total", "covered")


def ablation(spark, sf_dir):
    return G.ablate(*vectors(spark, sf_dir), COLUMNS, ABLATED)


def ablation_pivot(spark, sf_dir):
    return G.pivoted(ablation(spark, sf_dir), "features", "method", ABLATED)


def clean_letters(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.clean(F.col("text")).alias("letters"))


def model_inputs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", S.clean(F.col("text"), ascii_only=True).alias("s"))
    return d.select("doc_id", S.model_input(F.col("s"), "aa").alias("aa"), S.model_input(F.col("s"), "3di").alias("di"))


def slugs(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", S.slug(F.col("url")).alias("slug"), S.stem(F.col("url")).alias("stem"))


def class_means(spark, sf_dir):
    return _values(M.class_means(vectors(spark, sf_dir)[0]))


def lr_predict(spark, sf_dir):
    return M.logistic_regression(*vectors(spark, sf_dir))


def rf_predict(spark, sf_dir):
    return M.random_forest(*vectors(spark, sf_dir), trees=100, balanced=True)


def svc_linear(spark, sf_dir):
    return M.linear_svm(*vectors(spark, sf_dir))


def svc_rbf(spark, sf_dir):
    return M.rbf_svm(*M.scaled(*vectors(spark, sf_dir)))


def suite(spark, sf_dir):
    return M.run_suite(*vectors(spark, sf_dir))


_ALL = "v AS (SELECT vec_id::VARCHAR AS entry, vec_id AS row_no, label::VARCHAR AS label, list_transform(embedding, lambda x: x::DOUBLE) AS f FROM embeddings)"
_LONG = lambda src: f"SELECT entry, (generate_subscripts(f, 1) - 1)::BIGINT AS pos, round(unnest(f), 6) AS value FROM {src}"
_ORD = {name: own for name, own in G.subsets(COLUMNS).items()}


def _ablation_sql() -> str:
    parts = []
    for name, own in _ORD.items():
        pick = f"[{', '.join(f'f[{i + 1}]' for i in own)}]"
        base = _V.replace("list_transform(embedding, lambda x: x::DOUBLE) AS f", f"(SELECT {pick} FROM (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS f)) AS f")
        for method, preds in (("ncm", "SELECT * FROM ncm"), *((f"knn_cos_{k}", knn_sql(k)) for k in (1, 3, 5))):
            parts.append(f"SELECT '{name}' AS features, '{method}' AS method, weighted_f1 FROM (WITH {base}{_NCM}, truth AS (SELECT entry AS query, label AS \"true\" FROM te), p AS ({preds}), j AS (SELECT \"true\", coalesce(pred, '__none__') AS pred FROM truth LEFT JOIN p USING (query)) {f1_sql('j')})")
    return " UNION ALL ".join(parts)


def _scale_sql(formula: str) -> str:
    return f"""WITH {_ALL}, s AS (SELECT p, avg(x) AS m, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS d FROM (SELECT unnest(f) AS x, generate_subscripts(f, 1) AS p FROM v WHERE row_no % 5 <> 0) GROUP BY p)
      SELECT entry, (l.p - 1)::BIGINT AS pos, round({formula}, 6) AS value FROM (SELECT entry, unnest(f) AS x, generate_subscripts(f, 1) AS p FROM v WHERE row_no % 5 = 0) l JOIN s USING (p)"""


_NORM = "(SELECT entry, label, list_transform(f, lambda x: CASE WHEN n > 0 THEN x / n ELSE x END) AS f FROM (SELECT *, sqrt(list_dot_product(f, f)) AS n FROM {0}))"
_DOCS = "d AS (SELECT doc_id, lang || ':' || (n_chars % 97)::VARCHAR AS label FROM documents), tr AS (SELECT * FROM d WHERE doc_id % 5 <> 0), te AS (SELECT * FROM d WHERE doc_id % 5 = 0)"
_COUNTS = "SELECT o_orderpriority AS split, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL"
_COVER = "SELECT o_orderpriority AS split, count(*) AS total, count(*) FILTER (o_orderstatus IN ('F', 'O')) AS covered FROM orders GROUP BY ALL"

QUERIES = {
    "union_splits": union_splits, "l2norm": l2norm, "standardize": standardize, "standardize_without_mean": standardize_without_mean, "concat_blocks": concat_blocks, "slice_groups": slice_groups,
    "align_inner": align_inner, "align_strict": align_strict, "label_mismatch": label_mismatch, "known_label_semi": known_label_semi, "unseen_anti": unseen_anti, "look_up_left": look_up_left,
    "status_counts": status_counts, "status_coverage": status_coverage, "not_like": not_like, "threshold_filter": threshold_filter, "dropna_distinct": dropna_distinct, "report_union": report_union,
    "ablation": ablation, "ablation_pivot": ablation_pivot, "clean_letters": clean_letters, "model_inputs": model_inputs, "slugs": slugs, "class_means": class_means,
    "lr_predict": lr_predict, "rf_predict": rf_predict, "svc_linear": svc_linear, "svc_rbf": svc_rbf, "suite": suite,
}

ORACLES = {
    "union_splits": f"WITH {_ALL} SELECT CASE WHEN row_no % 5 = 0 THEN 'test' ELSE 'train' END AS split, entry, label FROM v",
    "l2norm": f"WITH {_ALL} {_LONG(_NORM.format('v'))}",
    "standardize": _scale_sql("(x - m) / d"),
    "standardize_without_mean": _scale_sql("x / d"),
    "concat_blocks": f"WITH {_ALL}, a AS (SELECT entry, label, f[1:16] AS f FROM v), b AS (SELECT entry, label, f[17:64] AS f FROM v), x AS {_NORM.format('a')}, y AS {_NORM.format('b')}, c AS (SELECT x.entry, list_concat(x.f, y.f) AS f FROM x JOIN y USING (entry)) {_LONG('c')}",
    "slice_groups": f"WITH {_ALL}, c AS (SELECT entry, list_concat(f[1:16], f[57:64]) AS f FROM v) {_LONG('c')}",
    "align_inner": f"WITH {_ALL}, c AS (SELECT entry, list_concat(f[1:4], f[9:12]) AS f FROM v WHERE f[1] > 0 AND f[2] > 0) {_LONG('c')}",
    "align_strict": "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
    "label_mismatch": "SELECT doc_id, quality AS label, toxic AS other FROM labels WHERE quality IS DISTINCT FROM toxic",
    "known_label_semi": f"WITH {_DOCS} SELECT * FROM te WHERE label IN (SELECT label FROM tr)",
    "unseen_anti": f"WITH {_DOCS} SELECT * FROM te WHERE label NOT IN (SELECT label FROM tr)",
    "look_up_left": "SELECT doc_id::VARCHAR AS target, coalesce(quality::VARCHAR, '__none__') AS label FROM documents LEFT JOIN labels USING (doc_id)",
    "status_counts": _COUNTS,
    "status_coverage": _COVER,
    "not_like": "SELECT p_partkey FROM part WHERE p_name NOT LIKE '%ring%' AND p_type NOT LIKE '%ring%'",
    "threshold_filter": "SELECT user_id::VARCHAR AS query, event_id::VARCHAR AS target, value AS bits, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id::VARCHAR) AS rk FROM events WHERE value / 500 >= 0.5 QUALIFY rk <= 3",
    "dropna_distinct": "SELECT source, count(DISTINCT (lang, quality)) AS n FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY source",
    "report_union": f"SELECT split, status, n, NULL::BIGINT AS total, NULL::BIGINT AS covered FROM ({_COUNTS}) UNION ALL SELECT split, NULL, NULL, total, covered FROM ({_COVER})",
    "ablation": _ablation_sql(),
    "ablation_pivot": f"SELECT features, {', '.join(f"max(weighted_f1) FILTER (method = '{m}') AS {m}" for m in ABLATED)} FROM ({_ablation_sql()}) GROUP BY features",
    "clean_letters": r"SELECT doc_id, upper(replace(regexp_replace(text, '[^\p{L}]', '', 'g'), 'ß', 'SS')) AS letters FROM documents",
    "model_inputs": "WITH d AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM documents) SELECT doc_id, '<AA2fold> ' || rtrim(regexp_replace(regexp_replace(s, '[UZOB]', 'X', 'g'), '(.)', '\\1 ', 'g')) AS aa, '<fold2AA> ' || rtrim(regexp_replace(lower(s), '(.)', '\\1 ', 'g')) AS di FROM d",
    "slugs": r"SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') AS slug, replace(regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '(.)\.[^.]*$', '\1'), '.pdb', '') AS stem FROM pages",
    "class_means": f"WITH {_V}{_NCM}, x AS {_NORM.format('(SELECT label AS entry, label, f FROM m0)')} {_LONG('x')}",
}
