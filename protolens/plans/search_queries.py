"""Queries of the search of letter strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from protolens.functions.sequence import clean
from protolens.operators import search as H
from protolens.plans.data import table, vectors
from protolens.schemas import AMINO

#: Letters of vectors: components in steps of 1/40 from -1/4, in the order of the letters.
STEPS, LEAST, LOSS = 40, 0.25, 4
PASSAGE_K = 8
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _strings(rows):
    """(entry, s): a letter for each component."""
    step = lambda x: F.least(F.lit(19), F.greatest(F.lit(0), F.floor((x + LEAST) * STEPS))).cast("int")
    return rows.select("entry", F.array_join(F.transform("features", lambda x: F.substring(F.lit(AMINO), step(x) + 1, F.lit(1))), "").alias("s"))


def search_hits(spark, sf_dir):
    """Vectors as strings of ordered letters: test rows among train rows."""
    train, test = vectors(spark, sf_dir)
    found = H.search(_strings(test), _strings(train), H.closeness(AMINO), seed_loss=LOSS, distinct=2)
    return found.select("query", "target", "score", F.round("bits", 6).alias("bits"), F.round("evalue", 6).alias("evalue"))


def search_passages(spark, sf_dir):
    """Benchmark texts among all documents, as strings of letters."""
    letters = lambda d, i: d.select(F.col(i).cast("string").alias("entry"), clean(F.col("text"), ascii_only=True).alias("s"))
    return H.search(letters(table(spark, sf_dir, "benchmark"), "item_id"), letters(table(spark, sf_dir, "documents"), "doc_id"), H.identity(LETTERS), PASSAGE_K, distinct=3)


QUERIES = {"search_hits": search_hits, "search_passages": search_passages}


def _running_max(levels: int) -> str:
    """Running maximum of the list ``reach`` by doubling steps."""
    out = "SELECT *, reach AS p FROM c"
    for i in range(levels):
        out = f"SELECT * REPLACE (list_transform(p, lambda x, j: CASE WHEN j > {1 << i} THEN greatest(x, p[j - {1 << i}]) ELSE x END) AS p) FROM ({out})"
    return out


_SCORE = "greatest(-4, 4 - 2 * abs({a} - {b}))"
_LOSS = f"list_sum(list_transform(list_zip(a.w, b.w), lambda z: 4 - {_SCORE.format(a='z[1]', b='z[2]')}))"
ORACLES = {
    "search_hits": f"""
WITH RECURSIVE st AS (SELECT vec_id::VARCHAR AS entry, vec_id % 5 = 0 AS test, list_transform(embedding, lambda x: least(19, greatest(0, floor((x::DOUBLE + {LEAST}::DOUBLE) * {STEPS})))::INT) AS c FROM embeddings),
sz AS (SELECT sum(len(c)) AS total, greatest(3, ceil(ln(sum(len(c))) / ln(20)))::INT AS k FROM st WHERE NOT test),
km AS (SELECT entry, test, len(c) AS n, i - 1 AS pos, c[i:i + k - 1] AS w FROM st, sz, range(1, 1000) t(i) WHERE i <= len(c) - k + 1 AND len(list_distinct(c[i:i + k - 1])) >= 2),
dk AS (SELECT DISTINCT test, w FROM km),
near AS (SELECT a.w AS aw, b.w AS bw FROM dk a, range(-2, 3) x(d), range(-2, 3) y(f) JOIN dk b ON NOT b.test AND b.w[1] = a.w[1] + d AND b.w[2] = a.w[2] + f WHERE a.test AND {_LOSS} <= {LOSS}),
ln AS (SELECT a.entry AS query, b.entry AS target, b.pos - a.pos AS diagonal, count(*) AS matches FROM km a JOIN near ON a.test AND a.w = aw JOIN km b ON NOT b.test AND b.w = bw
  GROUP BY ALL HAVING max(a.pos) - min(a.pos) >= least((SELECT k FROM sz), max(least(a.n, b.n)) - (SELECT k FROM sz))),
tp AS (SELECT query, target FROM (SELECT query, target, max(matches) AS m FROM ln GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query ORDER BY m DESC, target) <= {H.MAX_SEQS}),
sw AS (
  SELECT query, target, q.c AS q, t.c AS t, 0 AS i, list_transform(t.c, lambda x: 0) AS h, list_transform(t.c, lambda x: -1000) AS e, 0 AS best FROM tp JOIN st q ON q.entry = query JOIN st t ON t.entry = target
  UNION ALL
  SELECT query, target, q, t, i + 1, n, e, greatest(best, list_max(n)) FROM (
    SELECT *, list_transform(g, lambda x, j: CASE WHEN j > 1 THEN greatest(x, p[j - 1] - 6 - (j - 2)) ELSE x END) AS n FROM (
      WITH a AS (SELECT query, target, q, t, i, best, h, list_transform(h, lambda x, j: greatest(x - 6, e[j] - 1)) AS e FROM sw WHERE i < len(q)),
      b AS (SELECT *, list_transform(t, lambda x, j: greatest(0, e[j], CASE WHEN j > 1 THEN h[j - 1] ELSE 0 END + {_SCORE.format(a='x', b='q[i + 1]')})) AS g FROM a),
      c AS (SELECT *, list_transform(g, lambda x, j: x + j - 1) AS reach FROM b) {_running_max(6)}))
),
al AS (SELECT query, target, len(q) AS m, best AS score FROM sw WHERE i = len(q)),
sh AS (SELECT v, count(*)::DOUBLE / (SELECT total FROM sz) AS share FROM (SELECT unnest(c) AS v FROM st WHERE NOT test) GROUP BY v),
ws AS (SELECT sum(CASE WHEN s = 4 THEN w ELSE 0 END) AS w4, sum(CASE WHEN s = 2 THEN w ELSE 0 END) AS w2, sum(CASE WHEN s = 0 THEN w ELSE 0 END) AS w0, sum(CASE WHEN s = -2 THEN w ELSE 0 END) AS n2, sum(CASE WHEN s = -4 THEN w ELSE 0 END) AS n4
  FROM (SELECT {_SCORE.format(a='a.v', b='b.v')} AS s, a.share * b.share AS w FROM sh a, sh b)),
bi AS (SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high UNION ALL
  SELECT step + 1, CASE WHEN f < 1 THEN mid ELSE low END, CASE WHEN f < 1 THEN high ELSE mid END FROM (SELECT *, (low + high) / 2 AS mid, w4 * exp(4 * (low + high) / 2) + w2 * exp(low + high) + w0 + n2 * exp(-(low + high)) + n4 * exp(-2 * (low + high)) AS f FROM bi, ws WHERE step < 100)),
hit AS (SELECT query, target, score::BIGINT AS score, (score * high - ln(0.1::DOUBLE)) / ln(2) AS bits, m FROM al, bi WHERE step = 100)
SELECT query, target, score, round(bits, 6) AS bits, round(m * total::DOUBLE * pow(2.0::DOUBLE, -bits), 6) AS evalue FROM hit, sz WHERE score > 0 AND m * total::DOUBLE * pow(2.0::DOUBLE, -bits) <= {H.EVALUE}
"""}
