"""Queries of sources, sinks, structure and pocket features, and calls that leave the engine.

Files are written from the tables to the shared folder and read back by the sources.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from protolens.operators import ensemble as N
from protolens.operators import external as E
from protolens.operators import ml as M
from protolens.operators import pocket as K
from protolens.operators import relational as J
from protolens.operators import retrieval as R
from protolens.operators import structure as U
from protolens.operators import wide as W
from protolens.plans.data import points, sequences, spread, table, vectors
from protolens.plans.relational_queries import _ALL
from protolens.plans.retrieval_queries import _HITS, _NCM, _V
from protolens.plans.sequence_queries import _P, _S, ORACLES as SEQUENCE_ORACLES
from protolens.schemas import AMINO, RESIDUES
from protolens.sources import files as X

NAMES = {letter: name for name, letter in RESIDUES.items()}
_ORDERED = [NAMES[a] for a in AMINO]


def _long(df):
    v = df.select("entry", F.posexplode("features").alias("pos", "value"))
    return v.select("entry", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value")).where("value <> 0")


def csv_round_trip(spark, sf_dir):
    path = X.scratch(spark, "csv")
    X.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), path)
    return X.read_csv(spark, path, "c_custkey long, c_name string, c_mktsegment string, c_acctbal double")


def hit_list(spark, sf_dir):
    """Events as a hit list of eight columns without a header."""
    e = table(spark, sf_dir, "events")
    path = X.scratch(spark, "hits")
    e.select(F.col("user_id").cast("string"), F.col("event_id").cast("string"), "value", F.lit(0.001), F.col("value") / 500, F.lit(0.5), F.lit(0.25), F.col("value") / 1000).write.option("sep", "\t").csv(path)
    return X.read_hits(spark, path)


def hit_list_short(spark, sf_dir):
    """Events as a hit list of six columns, some of them empty."""
    e = table(spark, sf_dir, "events")
    path = X.scratch(spark, "hits")
    e.select(F.col("user_id").cast("string"), F.col("event_id").cast("string"), "value", F.lit(0.001), F.col("value") / 500, F.when(F.col("value") > 50, F.lit(0.5))).write.option("sep", "\t").csv(path)
    return X.read_hits(spark, path, short=True)


def fasta_round_trip(spark, sf_dir):
    path = X.scratch(spark, "fasta")
    a, b = sequences(spark, sf_dir)
    X.write_fasta(a.unionByName(b).select("entry", "sequence"), path)
    return X.read_fasta(spark, path)


def split_files(spark, sf_dir):
    path = X.scratch(spark, "splits")
    a, b = vectors(spark, sf_dir)
    X.write_by_split(J.all_splits(train=a, test=b).select("split", "entry", "label"), path)
    return spark.read.parquet(path).select(F.col("split").cast("string").alias("split"), "entry", "label")


def _npz(spark, sf_dir):
    path = X.scratch(spark, "npz")
    a, b = vectors(spark, sf_dir)
    X.write_npz(J.all_splits(train=a, test=b), path)
    return path


def npz_round_trip(spark, sf_dir):
    v = X.read_npz(spark, _npz(spark, sf_dir))
    return v.select("split", "entry", "label", F.posexplode("features").alias("pos", "value")).select("split", "entry", "label", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


def present_files(spark, sf_dir):
    wanted = spark.createDataFrame([("train-00000",), ("test-00000",), ("gone",)], "entry string")
    return X.present(spark, wanted, _npz(spark, sf_dir))


def present_entries(spark, sf_dir):
    """Matrix files of a hundred rows each, asked for by names of which half are not there."""
    path, wanted = X.scratch(spark, "npz"), table(spark, sf_dir, "embeddings")
    a, b = vectors(spark, sf_dir)
    X.write_npz(J.all_splits(train=a, test=b), path, 100)
    names = wanted.select(F.concat(F.lit("test-"), F.lpad(F.floor(F.col("vec_id") / 50).cast("string"), 5, "0")).alias("entry")).distinct()
    return X.present(spark, names, path)


def mapped_status(spark, sf_dir):
    """A call for each page that fails for some."""

    def fetch(row):
        if "net" in row["url"]:
            raise ValueError(row["url"])
        return {"page_id": row["page_id"], "status": "ok", "size": len(row["url"])}

    return X.mapped(table(spark, sf_dir, "pages").where("url is not null").select("page_id", "url"), fetch, "page_id long, status string, size long", 4)


def _line(name, atom, number, x, y, z, b):
    """An atom line by fixed columns."""
    return F.format_string(f"ATOM  %5d  {atom:<3} %3s A%4d    %8.3f%8.3f%8.3f%6.2f%6.2f           {atom[0]}", number, name, number, x, y, z, F.lit(1.0), b)


def _structures(spark, sf_dir):
    """(entry, value): one structure file for each chain of ``points``, all backbone atoms of a
    residue in one place."""
    p = points(spark, sf_dir)
    name = F.element_at(F.array(*map(F.lit, _ORDERED)), F.instr(F.lit(AMINO), F.col("letter")))
    lines = F.concat_ws("\n", *[_line(name, a, (F.col("i") % 1000).cast("int"), F.col("x"), F.col("y"), F.col("z"), F.abs("b")) for a in ("N", "CA", "C", "O")])
    rows = p.select("entry", "i", lines.alias("l")).groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("i", "l"))).alias("r"))
    return rows.select("entry", F.concat(F.array_join(F.transform("r", lambda r: r["l"]), "\n"), F.lit("\nENDMDL\n")).alias("value"))


def _placed(r):
    return r.select("entry", F.col("i").cast("long").alias("i"), "aa", *[(F.col(c) + 0.0).alias(c) for c in ("x", "y", "z")])


def structure_scan(spark, sf_dir):
    return _placed(X.parse_structures(_structures(spark, sf_dir)))


def ca_scan(spark, sf_dir):
    return _placed(X.parse_ca(_structures(spark, sf_dir), standard_only=True))


def ca_scan_any(spark, sf_dir):
    """Each residue with a CA, where every seventh is a ligand's residue that has no letter."""
    p = points(spark, sf_dir)
    other = F.col("i") % 7 == 0
    name = F.when(other, F.lit("MSE")).otherwise(F.element_at(F.array(*map(F.lit, _ORDERED)), F.instr(F.lit(AMINO), F.col("letter"))))
    line = _line(name, "CA", (F.col("i") % 1000).cast("int"), F.col("x"), F.col("y"), F.col("z"), F.abs("b"))
    line = F.when(other, F.concat(F.lit("HETATM"), F.substring(line, 7, 200))).otherwise(line)
    rows = p.select("entry", "i", line.alias("l")).groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("i", "l"))).alias("r"))
    return _placed(X.parse_ca(rows.select("entry", F.array_join(F.transform("r", lambda r: r["l"]), "\n").alias("value"))))


def surface_atoms(spark, sf_dir):
    a = X.parse_surface_atoms(_structures(spark, sf_dir))
    return a.groupBy("entry", "element").agg(F.count("*").alias("n"), F.count_distinct("res").alias("residues"))


def structure_features(spark, sf_dir):
    """Long form of the 100 features: entries that are not zero."""
    p = points(spark, sf_dir)
    one = F.array("x", "y", "z")
    return _long(U.structure_features(p.withColumn("aa", F.col("letter")).withColumn("bb", F.concat(one, one, one, one))))


def _reports(spark, sf_dir):
    """(entry, value): pocket reports with none to three pockets."""
    e = table(spark, sf_dir, "embeddings")
    number = lambda j, f: F.element_at("embedding", (j * 19 + f) % 64 + 1).cast("double").cast("string")
    block = lambda j: F.concat(F.lit(f"Pocket {j} :\n"), *[F.concat(F.lit(f"\t{name} : \t"), number(j, f), F.lit("\n")) for f, name in enumerate(K.FIELDS)], F.lit("\tName : \tx\n\n"))
    blocks = F.concat(*[F.when(F.col("vec_id") % 4 >= j, block(j)).otherwise(F.lit("")) for j in (1, 2, 3)])
    return e.select(F.col("vec_id").cast("string").alias("entry"), blocks.alias("value"))


def pocket_scan(spark, sf_dir):
    p = X.parse_pockets(_reports(spark, sf_dir))
    return p.select("entry", F.col("pocket_no").cast("long").alias("pocket_no"), F.explode("props").alias("name", "value"))


def _linings(spark, sf_dir):
    """(entry, value): atom lines of eight residues, two atoms each."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("entry"), "vec_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("k"), F.lit(0.0).alias("o"))
    name = F.element_at(F.array(*map(F.lit, _ORDERED)), (F.pmod(F.col("vec_id") + F.col("k") * F.col("k"), F.lit(20)) + 1).cast("int"))
    return e.select("entry", F.explode(F.array(*[_line(name, a, F.col("k"), F.col("o"), F.col("o"), F.col("o"), F.col("o")) for a in ("CA", "CB")])).alias("value"))


def lining_scan(spark, sf_dir):
    return X.lining_composition(_linings(spark, sf_dir))


def pocket_features(spark, sf_dir):
    """Long form of the 81 features: entries that are not zero."""
    entries = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("entry"))
    return _long(K.pocket_features(entries, X.parse_pockets(_reports(spark, sf_dir)), X.lining_composition(_linings(spark, sf_dir))))


def mean_pool(spark, sf_dir):
    tokens = table(spark, sf_dir, "embeddings").select(F.concat_ws("/", F.col("label").cast("string"), F.floor(F.col("vec_id") / 1000).cast("string")).alias("entry"), F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("features"))
    v = E.pooled(tokens).select("entry", F.posexplode("features").alias("pos", "value"))
    return v.select("entry", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


def _letter_shares():
    """A stand-in for a model: the share of each standard letter."""

    def model(texts):
        return np.array([[t.count(a) / len(t) if t else 0.0 for a in AMINO] for t in texts])

    return model


def embedder(spark, sf_dir):
    a, b = sequences(spark, sf_dir)
    return _long(E.embedded(spread(a.unionByName(b)), _letter_shares))


def _self_search():
    """A stand-in for a search program: each query hits itself."""
    return lambda rows: [(e, e, float(len(s)), 1.0) for e, s in rows]


def external_search(spark, sf_dir):
    a, b = sequences(spark, sf_dir)
    return E.searched(a.unionByName(b), _self_search, "query string, target string, bits double, prob double")


def gate_concat(spark, sf_dir):
    """A sure retrieval, else the class means of two unit blocks side by side."""
    train, test = vectors(spark, sf_dir)
    half = lambda t, i: t.withColumn("features", F.slice("features", 32 * i + 1, 32))
    both = lambda t: N.concat_vectors(half(t, 0), half(t, 1))
    r = R.top_1(R.hits_from_vectors(test, train, 1), train)
    return N.gate(test.select(F.col("entry").alias("query")), r, M.nearest_mean(both(train), both(test)), 0.68)


def _affinity(spark, sf_dir, form=R.affinity_vectors):
    """Affinity rows of train and test, searched once: fitting goes over them many times."""
    train, test = vectors(spark, sf_dir)
    made = lambda rows: form(R.affinity(R.hits_from_vectors(rows, train, 20), rows, train, mask_self=True), rows, train)
    return X.kept(made(train), "affinity-train"), made(test)


def affinity_lr(spark, sf_dir):
    return W.logistic_regression(*_affinity(spark, sf_dir, R.affinity_cells))


def affinity_svm(spark, sf_dir):
    return M.linear_svm(*_affinity(spark, sf_dir))


QUERIES = {
    "csv_round_trip": csv_round_trip, "hit_list": hit_list, "fasta_round_trip": fasta_round_trip, "split_files": split_files, "npz_round_trip": npz_round_trip, "present_files": present_files,
    "mapped_status": mapped_status, "structure_scan": structure_scan, "ca_scan": ca_scan, "surface_atoms": surface_atoms, "structure_features": structure_features, "pocket_scan": pocket_scan,
    "lining_scan": lining_scan, "pocket_features": pocket_features, "mean_pool": mean_pool, "embedder": embedder, "external_search": external_search, "gate_concat": gate_concat,
    "hit_list_short": hit_list_short, "present_entries": present_entries, "ca_scan_any": ca_scan_any, "affinity_lr": affinity_lr, "affinity_svm": affinity_svm,
}

_PLACED = "SELECT entry, row_number() OVER (PARTITION BY entry ORDER BY i) - 1 AS i, l AS aa, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(z, 3) + 0.0 AS z FROM p"
_POCKETS = "pk AS (" + " UNION ALL ".join(f"SELECT vec_id::VARCHAR AS entry, {j}::BIGINT AS pocket_no, '{name}' AS name, embedding[{(j * 19 + f) % 64 + 1}]::DOUBLE AS value, {(j - 1) * 19 + f}::BIGINT AS pos FROM embeddings WHERE vec_id % 4 >= {j}" for j in (1, 2, 3) for f, name in enumerate(K.FIELDS)) + ")"
_LINING = f"li AS (SELECT entry, aa, count(*)::DOUBLE / 8 AS frac FROM (SELECT vec_id::VARCHAR AS entry, substr('{AMINO}', ((vec_id + k * k) % 20)::INT + 1, 1) AS aa FROM embeddings, (SELECT unnest(range(1, 9)) AS k)) GROUP BY ALL)"
_HALVES = "(SELECT list_concat(list_transform(a, lambda x: x / na), list_transform(b, lambda x: x / nb)) FROM (SELECT a, b, sqrt(list_dot_product(a, a)) AS na, sqrt(list_dot_product(b, b)) AS nb FROM (SELECT list_transform(embedding[1:32], lambda x: x::DOUBLE) AS a, list_transform(embedding[33:64], lambda x: x::DOUBLE) AS b))) AS f"
_CONTACT_AT = "".join(f" UNION ALL SELECT entry, {68 + i}, {c} FROM cs" for i, c in enumerate(U.CONTACT_COLUMNS))

ORACLES = {
    "csv_round_trip": "SELECT c_custkey, c_name, c_mktsegment, c_acctbal::DOUBLE AS c_acctbal FROM customer",
    "hit_list": "SELECT user_id::VARCHAR AS query, event_id::VARCHAR AS target, value AS bits, 0.001::DOUBLE AS evalue, value / 500 AS prob, 0.5::DOUBLE AS alntmscore, 0.25::DOUBLE AS fident, value / 1000 AS lddt FROM events",
    "hit_list_short": "SELECT user_id::VARCHAR AS query, event_id::VARCHAR AS target, value AS bits, 0.001::DOUBLE AS evalue, value / 500 AS prob, CASE WHEN value > 50 THEN 0.5::DOUBLE END AS alntmscore FROM events",
    "present_entries": "SELECT DISTINCT 'test-' || lpad((vec_id // 50)::VARCHAR, 5, '0') AS entry FROM embeddings WHERE vec_id // 50 IN (SELECT vec_id // 100 FROM embeddings WHERE vec_id % 5 = 0)",
    "ca_scan_any": f"WITH {_P} {_PLACED.replace('l AS aa', chr(39).join(['CASE WHEN i % 7 = 0 THEN ', 'X', ' ELSE l END AS aa']))}",
    "fasta_round_trip": f"WITH {_S} SELECT entry, s AS sequence FROM s",
    "split_files": f"WITH {_ALL} SELECT CASE WHEN row_no % 5 = 0 THEN 'test' ELSE 'train' END AS split, entry, label FROM v",
    "npz_round_trip": f"WITH {_ALL} SELECT CASE WHEN row_no % 5 = 0 THEN 'test' ELSE 'train' END AS split, entry, label, (generate_subscripts(f, 1) - 1)::BIGINT AS pos, round(unnest(f), 6) AS value FROM v",
    "present_files": "SELECT unnest(['train-00000', 'test-00000']) AS entry",
    "mapped_status": "SELECT page_id, CASE WHEN contains(url, 'net') THEN 'error:ValueError' ELSE 'ok' END AS status, CASE WHEN NOT contains(url, 'net') THEN length(url) END AS size FROM pages WHERE url IS NOT NULL",
    "structure_scan": f"WITH {_P} {_PLACED}",
    "ca_scan": f"WITH {_P} {_PLACED}",
    "surface_atoms": f"WITH {_P} SELECT entry, e AS element, count(*) AS n, count(DISTINCT i) AS residues FROM p, (SELECT unnest(['N', 'C', 'C', 'O']) AS e) GROUP BY entry, e",
    "structure_features": f"""WITH cs AS ({SEQUENCE_ORACLES['contact_stats']}), {_P}, g AS (SELECT entry, count(*)::DOUBLE AS n, sqrt(greatest(0, avg(x * x) - avg(x) * avg(x) + avg(y * y) - avg(y) * avg(y) + avg(z * z) - avg(z) * avg(z))) AS rg, avg(b) AS b FROM p GROUP BY entry),
      aa AS (SELECT entry, instr('{AMINO}', l) - 1 AS k, count(*)::DOUBLE / any_value(n) AS frac FROM p JOIN g USING (entry) GROUP BY entry, l),
      every AS (SELECT entry, 2::BIGINT AS pos, 1.0::DOUBLE AS value FROM g UNION ALL SELECT entry, 3, rg FROM g UNION ALL SELECT entry, 4, b FROM g UNION ALL SELECT entry, 5, n FROM g
      UNION ALL SELECT entry, 8 + 3 * k + 2, frac FROM aa UNION ALL SELECT entry, 80 + k, frac FROM aa{_CONTACT_AT}) SELECT entry, pos, round(value, 6) AS value FROM every WHERE round(value, 6) <> 0""",
    "pocket_scan": f"WITH {_POCKETS} SELECT entry, pocket_no, name, value FROM pk",
    "lining_scan": f"WITH {_LINING} SELECT entry, aa, frac FROM li",
    "pocket_features": f"""WITH {_POCKETS}, {_LINING}, every AS (SELECT entry, pos, value FROM pk UNION ALL SELECT entry, 57, count(*)::DOUBLE FROM pk WHERE name = 'Score' GROUP BY entry
      UNION ALL SELECT entry, 58, max(value) FROM pk WHERE name = 'Score' GROUP BY entry UNION ALL SELECT entry, 59, max(value) FROM pk WHERE name = 'Volume' GROUP BY entry UNION ALL SELECT entry, 60, avg(value) FROM pk WHERE name = 'Score' GROUP BY entry
      UNION ALL SELECT entry, 61 + instr('{AMINO}', aa) - 1, frac FROM li WHERE entry IN (SELECT entry FROM pk)) SELECT entry, pos, round(value, 6) AS value FROM every WHERE round(value, 6) <> 0""",
    "mean_pool": "WITH t AS (SELECT label::VARCHAR || '/' || (vec_id // 1000)::VARCHAR AS entry, vec_id, embedding FROM embeddings), u AS (SELECT *, min(vec_id) OVER w AS lo, max(vec_id) OVER w AS hi FROM t WINDOW w AS (PARTITION BY entry)), x AS (SELECT entry, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p FROM u WHERE vec_id > lo AND vec_id < hi) SELECT entry, (p - 1)::BIGINT AS pos, round(avg(v), 6) AS value FROM x GROUP BY ALL",
    "embedder": f"WITH {_S} SELECT entry, (instr('{AMINO}', c) - 1)::BIGINT AS pos, round(count(*)::DOUBLE / any_value(length(s)), 6) AS value FROM (SELECT entry, s, unnest(string_split(s, '')) AS c FROM s WHERE s <> '') WHERE instr('{AMINO}', c) > 0 GROUP BY entry, c HAVING round(count(*)::DOUBLE / any_value(length(s)), 6) <> 0",
    "external_search": f"WITH {_S} SELECT entry AS query, entry AS target, length(s)::DOUBLE AS bits, 1.0::DOUBLE AS prob FROM s",
    "gate_concat": f"WITH {_HITS}, m AS (SELECT * FROM (WITH {_V.replace('list_transform(embedding, lambda x: x::DOUBLE) AS f', _HALVES)}{_NCM} SELECT * FROM ncm)) SELECT h.query, CASE WHEN prob >= 0.68 THEN h.label ELSE m.pred END AS pred, CASE WHEN prob >= 0.68 THEN 'retrieval' ELSE 'fallback' END AS source FROM hits h JOIN m USING (query) WHERE rk = 1",
}
