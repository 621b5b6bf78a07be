"""Queries of sequence features, motifs and spatial joins over documents and embeddings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolens.functions import sequence as S
from protolens.operators import metrics as A
from protolens.operators import motif as O
from protolens.operators import spatial as P
from protolens.plans.data import points, sequences, spread, truth
from protolens.plans.retrieval_queries import f1_sql
from protolens.schemas import AMINO, AROMATIC, HYDROPATHY
from protolens.sources.files import kept

K, MEMBERS, ENRICHMENT = 4, 3, 5.0
SWEEP_K, SWEEP_MEMBERS, SWEEP_ENRICHMENT = [4, 5, 6, 7, 8], [3, 4, 5], [2.0, 5.0, 10.0]


def _all(spark, sf_dir):
    a, b = sequences(spark, sf_dir)
    return spread(a.unionByName(b))


def aa_composition(spark, sf_dir):
    c = _all(spark, sf_dir).select("entry", S.composition(F.col("sequence")).alias("c"))
    return c.select("entry", *[F.round(F.col("c")[i], 9).alias(f"aa_{a}") for i, a in enumerate(AMINO)])


def dipeptide_freq(spark, sf_dir):
    return S.dipeptides(_all(spark, sf_dir), "sequence", ["entry"]).withColumn("freq", F.round("freq", 9))


def physico(spark, sf_dir):
    p = _all(spark, sf_dir).select("entry", S.physico(F.col("sequence")).alias("p"))
    return p.select("entry", *[F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate(("seq_log_len", "seq_mean_kd", "seq_std_kd", "seq_arom_frac"))])


def sequence_features(spark, sf_dir):
    """Long form of the 424 features: entries that are not zero."""
    v = _all(spark, sf_dir).select("entry", F.posexplode(S.sequence_features(F.col("sequence"))).alias("pos", "value"))
    return v.select("entry", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value")).where("value <> 0")


def kmer_counts(spark, sf_dir):
    return O.kmer_counts(_all(spark, sf_dir), 3)


def kmer_presence(spark, sf_dir):
    return O.kmer_presence(_all(spark, sf_dir), K)


def _train(spark, sf_dir):
    train, test = sequences(spark, sf_dir)
    return spread(train), spread(test)


def motif_background(spark, sf_dir):
    train, _ = _train(spark, sf_dir)
    return O.background(O.kmer_presence(train, K), train).withColumn("background", F.round("background", 9))


def _motifs(spark, sf_dir):
    train, test = _train(spark, sf_dir)
    return train, test, O.discover(O.support(train, K), train, MEMBERS, ENRICHMENT)


def motif_discover(spark, sf_dir):
    m = _motifs(spark, sf_dir)[2]
    return m.select("class", "motif", "held", *[F.round(c, 6).alias(c) for c in ("background", "enrichment", "weight")])


def _scores(spark, sf_dir, mode):
    train, test, m = _motifs(spark, sf_dir)
    m = m.withColumn("weight", F.round("weight", 9))
    return train, test, O.score(O.kmer_counts(test, K), m, mode)


def motif_score(spark, sf_dir):
    return _scores(spark, sf_dir, "count")[2]


def motif_score_presence(spark, sf_dir):
    return _scores(spark, sf_dir, "presence")[2]


def motif_predict(spark, sf_dir):
    train, _, s = _scores(spark, sf_dir, "count")
    return O.predict(s, O.class_order(train))


def motif_f1(spark, sf_dir):
    train, test, s = _scores(spark, sf_dir, "count")
    return A.evaluate(truth(test), O.predict(s, O.class_order(train)))


def sweep_motif(spark, sf_dir):
    """Length by length, so the disk holds the shuffles of one."""
    train, test = _train(spark, sf_dir)
    own = lambda k: kept(O.sweep(O.support(train, k), train, SWEEP_MEMBERS, SWEEP_ENRICHMENT, O.kmer_counts(test, k)), "sweep", release=True)
    preds = reduce(DataFrame.unionByName, map(own, SWEEP_K))
    configs = A.combinations(k=SWEEP_K, min_members=SWEEP_MEMBERS, min_enrichment=SWEEP_ENRICHMENT)
    return A.evaluate(truth(test), preds, ["k", "min_members", "min_enrichment"], configs)


def motifs_per_class(spark, sf_dir):
    train, _, m = _motifs(spark, sf_dir)
    return O.motifs_per_class(m, train).withColumn("avg_motifs", F.round("avg_motifs", 6))


def spatial_pairs(spark, sf_dir):
    return P.pair_motifs(points(spark, sf_dir))


def spatial_pair_counts(spark, sf_dir):
    return P.pair_counts(points(spark, sf_dir))


def spatial_triples(spark, sf_dir):
    return P.triple_motifs(points(spark, sf_dir))


def joint_pairs(spark, sf_dir):
    r = points(spark, sf_dir).withColumn("letter", P.joint_letters(F.col("letter"), F.lower("letter")))
    return P.pair_motifs(r)


def contact_stats(spark, sf_dir):
    c = P.contact_stats(points(spark, sf_dir), "letter")
    return c.select("entry", F.col("n").cast("long").alias("n"), *[F.round(x, 6).alias(x) for x in P.CONTACT_COLUMNS])


_S = "s AS (SELECT doc_id::VARCHAR AS entry, doc_id AS row_no, source AS label, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM documents)"
_K = lambda k, src="s": f"kc AS (SELECT entry, motif, count(*) AS n FROM (SELECT entry, unnest(list_transform(range(1, length(s) - {k - 2}), lambda i: substr(s, i, {k}))) AS motif FROM {src}) GROUP BY ALL)"
_COUNT = lambda a: f"(length(s) - length(replace(s, '{a}', '')))"
_SUM = lambda power: " + ".join(f"{_COUNT(a)} * {v ** power!r}::DOUBLE" for a, v in HYDROPATHY.items())
_PHYS = f"SELECT entry, CASE WHEN length(s) > 0 THEN ln(1 + length(s)::DOUBLE) ELSE 0 END AS a, CASE WHEN length(s) > 0 THEN ({_SUM(1)}) / length(s) ELSE 0 END AS b, CASE WHEN length(s) > 0 THEN ({_SUM(2)}) / length(s) ELSE 0 END AS q, CASE WHEN length(s) > 0 THEN ({' + '.join(_COUNT(a) for a in AROMATIC)})::DOUBLE / length(s) ELSE 0 END AS d FROM s"
_DI = f"di AS (SELECT entry, p AS dipeptide, count(*)::DOUBLE / (max(length(s)) - 1) AS freq FROM (SELECT entry, s, unnest(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) AS p FROM s) WHERE regexp_full_match(p, '[{AMINO}]{{2}}') GROUP BY entry, p)"
_M = f"""{_S}, tr AS (SELECT * FROM s WHERE row_no % 5 <> 0), te AS (SELECT * FROM s WHERE row_no % 5 = 0), {_K(K)}, f AS (SELECT kc.entry, motif, label FROM kc JOIN tr USING (entry)),
bg AS (SELECT motif, count(*)::DOUBLE / (SELECT count(*) FROM tr) AS background FROM f GROUP BY motif),
sup AS (SELECT label AS class, motif, count(*) AS held, any_value(size) AS size FROM f JOIN (SELECT label, count(*) AS size FROM tr GROUP BY label) USING (label) GROUP BY ALL),
enr AS (SELECT *, held::DOUBLE / size / greatest(background, 1e-9) AS enrichment FROM sup JOIN bg USING (motif)),
mot AS (SELECT *, log2(enrichment) AS weight FROM enr WHERE size >= {MEMBERS} AND held >= {MEMBERS} AND round(enrichment, 9) >= {ENRICHMENT}),
sc AS (SELECT kc.entry AS query, class, round(sum(round(weight, 9) * n), 6) AS score FROM kc JOIN te USING (entry) JOIN mot USING (motif) GROUP BY ALL),
ord AS (SELECT label AS class, min(row_no) AS ordinal FROM tr GROUP BY label), truth AS (SELECT entry AS query, label AS "true" FROM te),
pr AS (SELECT query, first(class ORDER BY score DESC, ordinal) AS pred, max(score) AS score FROM sc JOIN ord USING (class) WHERE score > 0 GROUP BY query)"""
_MANY = "kc AS (" + " UNION ALL ".join(f"SELECT entry, motif, count(*) AS n FROM (SELECT entry, unnest(list_transform(range(1, length(s) - {k - 2}), lambda i: substr(s, i, {k}))) AS motif FROM s) GROUP BY ALL" for k in SWEEP_K) + ")"
_SW = f"""{_M.replace(_K(K), _MANY)}, conf AS (SELECT k::INT AS k, m AS min_members, e AS min_enrichment FROM (SELECT unnest({SWEEP_K}) AS k), (SELECT unnest({SWEEP_MEMBERS}) AS m), (SELECT unnest({SWEEP_ENRICHMENT})::DOUBLE AS e)),
sm AS (SELECT k, min_members, min_enrichment, class, motif, log2(enrichment) AS weight FROM enr JOIN conf ON length(motif) = k AND size >= min_members AND held >= min_members AND round(enrichment, 9) >= min_enrichment),
ss AS (SELECT k, min_members, min_enrichment, kc.entry AS query, class, round(sum(weight * n), 6) AS score FROM kc JOIN te USING (entry) JOIN sm USING (motif) GROUP BY ALL),
sp AS (SELECT k, min_members, min_enrichment, query, first(class ORDER BY score DESC, ordinal) AS pred FROM ss JOIN ord USING (class) WHERE score > 0 GROUP BY ALL),
j AS (SELECT conf.k, conf.min_members, conf.min_enrichment, "true", coalesce(pred, '__none__') AS pred FROM conf CROSS JOIN truth LEFT JOIN sp ON sp.k = conf.k AND sp.min_members = conf.min_members AND sp.min_enrichment = conf.min_enrichment AND sp.query = truth.query)"""
_P = """p AS (SELECT label::VARCHAR || '/' || (vec_id // 1000)::VARCHAR AS entry, vec_id AS i, embedding[1]::DOUBLE * 40 AS x, embedding[2]::DOUBLE * 40 AS y, embedding[3]::DOUBLE * 40 AS z, embedding[4]::DOUBLE AS b, substr('ACDEFGHIKLMNPQRSTVWY', (vec_id % 20)::INT + 1, 1) AS l FROM embeddings)"""
_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
_PAIRS = f"{_P}, pr AS (SELECT a.entry, array_to_string(list_sort([a.l, b.l]), ',') AS motif, array_to_string(list_sort([a.l || lower(a.l), b.l || lower(b.l)]), ',') AS joint FROM p a JOIN p b ON a.entry = b.entry AND b.i - a.i >= 6 AND {_D} <= 9.0)"
_E = lambda a, b: "sqrt(" + " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in "xyz") + ")"

QUERIES = {
    "aa_composition": aa_composition, "dipeptide_freq": dipeptide_freq, "physico": physico, "sequence_features": sequence_features, "kmer_counts": kmer_counts, "kmer_presence": kmer_presence,
    "motif_background": motif_background, "motif_discover": motif_discover, "motif_score": motif_score, "motif_score_presence": motif_score_presence, "motif_predict": motif_predict, "motif_f1": motif_f1,
    "sweep_motif": sweep_motif, "motifs_per_class": motifs_per_class, "spatial_pairs": spatial_pairs, "spatial_pair_counts": spatial_pair_counts, "spatial_triples": spatial_triples, "joint_pairs": joint_pairs, "contact_stats": contact_stats,
}

ORACLES = {
    "aa_composition": f"WITH {_S} SELECT entry, " + ", ".join(f"round(CASE WHEN length(s) > 0 THEN {_COUNT(a)}::DOUBLE / length(s) ELSE 0 END, 9) AS aa_{a}" for a in AMINO) + " FROM s",
    "dipeptide_freq": f"WITH {_S}, {_DI} SELECT entry, dipeptide, round(freq, 9) AS freq FROM di",
    "physico": f"WITH {_S}, p AS ({_PHYS}) SELECT entry, round(a, 6) AS seq_log_len, round(b, 6) AS seq_mean_kd, round(sqrt(greatest(0, q - b * b)), 6) AS seq_std_kd, round(d, 6) AS seq_arom_frac FROM p",
    "sequence_features": f"""WITH {_S}, {_DI}, p AS ({_PHYS}), every AS (
      SELECT entry, (instr('{AMINO}', c) - 1)::BIGINT AS pos, count(*)::DOUBLE / max(length(s)) AS value FROM (SELECT entry, s, unnest(string_split(s, '')) AS c FROM s WHERE s <> '') WHERE instr('{AMINO}', c) > 0 GROUP BY entry, c
      UNION ALL SELECT entry, 20 + (instr('{AMINO}', dipeptide[1]) - 1) * 20 + instr('{AMINO}', dipeptide[2]) - 1, freq FROM di
      UNION ALL SELECT entry, 420, a FROM p UNION ALL SELECT entry, 421, b FROM p UNION ALL SELECT entry, 422, sqrt(greatest(0, q - b * b)) FROM p UNION ALL SELECT entry, 423, d FROM p)
      SELECT entry, pos, round(value, 6) AS value FROM every WHERE round(value, 6) <> 0""",
    "kmer_counts": f"WITH {_S}, {_K(3)} SELECT entry, motif, n FROM kc",
    "kmer_presence": f"WITH {_S}, {_K(K)} SELECT entry, motif FROM kc",
    "motif_background": f"WITH {_M} SELECT motif, round(background, 9) AS background FROM bg",
    "motif_discover": f"WITH {_M} SELECT class, motif, held, round(background, 6) AS background, round(enrichment, 6) AS enrichment, round(weight, 6) AS weight FROM mot",
    "motif_score": f"WITH {_M} SELECT * FROM sc",
    "motif_score_presence": f"WITH {_M} SELECT kc.entry AS query, class, round(sum(round(weight, 9)), 6) AS score FROM kc JOIN te USING (entry) JOIN mot USING (motif) GROUP BY ALL",
    "motif_predict": f"WITH {_M} SELECT * FROM pr",
    "motif_f1": f"WITH {_M}, j AS (SELECT \"true\", coalesce(pred, '__none__') AS pred FROM truth LEFT JOIN pr USING (query)) {f1_sql('j')}",
    "sweep_motif": f"WITH {_SW} {f1_sql('j', 'k, min_members, min_enrichment')}",
    "motifs_per_class": f"WITH {_M} SELECT round(coalesce(avg(n), 0), 6) AS avg_motifs FROM (SELECT count(*) AS n FROM mot GROUP BY class)",
    "spatial_pairs": f"WITH {_PAIRS} SELECT DISTINCT entry, motif FROM pr",
    "spatial_pair_counts": f"WITH {_PAIRS} SELECT entry, motif, count(*) AS n FROM pr GROUP BY ALL",
    "spatial_triples": f"WITH {_P}, t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY entry ORDER BY b DESC, i) <= 50) SELECT DISTINCT a.entry, array_to_string(list_sort([a.l, b.l, c.l]), ',') AS motif FROM t a JOIN t b ON a.entry = b.entry AND b.i - a.i >= 6 JOIN t c ON c.entry = a.entry AND c.i - b.i >= 6 WHERE {_E('a', 'b')} <= 10.0 AND {_E('b', 'c')} <= 10.0 AND {_E('a', 'c')} <= 10.0",
    "joint_pairs": f"WITH {_PAIRS} SELECT DISTINCT entry, joint AS motif FROM pr",
    "contact_stats": f"""WITH {_P}, n AS (SELECT entry, count(*) AS n FROM p GROUP BY entry), d AS (SELECT a.entry, b.i - a.i AS sep, {_D} AS dist, a.l = 'C' AND b.l = 'C' AS cc FROM p a JOIN p b ON a.entry = b.entry AND b.i > a.i),
      c AS (SELECT *, sep >= 2 AND dist > 0 AND dist < 8.0 AS hit FROM d), g AS (SELECT entry, count(*) FILTER (hit) AS c, count(*) FILTER (hit AND sep < 6) AS s, count(*) FILTER (hit AND sep >= 6 AND sep < 12) AS m, count(*) FILTER (hit AND sep >= 12) AS l,
      avg(dist) FILTER (hit) AS md, median(dist) FILTER (hit) AS mm, avg(sep) FILTER (hit) AS ms, max(sep) FILTER (hit) AS xs, count(*) FILTER (cc AND dist < 7.0) AS cys, count(*) FILTER (dist > 0 AND dist < 8.0) AS near, max(dist) AS far FROM c GROUP BY entry)
      SELECT entry, n, round(c::DOUBLE / n, 6) AS contact_density, round(l::DOUBLE / n, 6) AS contact_lr_per_res, round(coalesce(md, 0), 6) AS contact_mean_dist, round(coalesce(mm, 0), 6) AS contact_median_dist, round(s::DOUBLE / greatest(c, 1), 6) AS contact_short_frac,
      round(m::DOUBLE / greatest(c, 1), 6) AS contact_medium_frac, round(l::DOUBLE / greatest(c, 1), 6) AS contact_long_frac, round(coalesce(ms, 0), 6) AS contact_mean_seq_sep, round(coalesce(xs, 0) / sqrt(n), 6) AS contact_max_seq_sep_per_n, round(cys::DOUBLE / n, 6) AS contact_cys_pairs_per_res,
      round(2.0::DOUBLE * near / (n * greatest(n - 1, 1)), 6) AS contact_clustering, round(far / sqrt(n), 6) AS contact_radius_per_n FROM n JOIN g USING (entry)""",
}
