"""Queries of structures with real geometry: chains of helices and sheets made from the vectors."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from protolens.operators import cavity as C
from protolens.operators import pocket as K
from protolens.operators import structure as U
from protolens.plans.data import table
from protolens.plans.sequence_queries import _P, ORACLES as SEQUENCE_ORACLES
from protolens.schemas import AMINO, RESIDUES
from protolens.sources.files import kept

#: Radius in Å, turn in degrees and rise in Å of an ideal helix's backbone atoms.
HELIX = {"n": (1.55, -27.0, -0.9), "a": (2.28, 0.0, 0.0), "c": (1.68, 26.0, 1.1), "o": (1.99, 22.5, 2.3)}
#: Place along and across a strand of its backbone atoms in Å; strands of eight residues.
STRAND = {"n": (-1.2, 0.3), "a": (0.0, -0.2), "c": (1.2, 0.3), "o": (1.2, 1.53)}
#: Share of the vectors' components that is added to the places.
JITTER = 0.4
NAMES = {letter: name for name, letter in RESIDUES.items()}
ELEMENTS = {"n": "N", "a": "C", "c": "C", "o": "O"}


def chains(spark, sf_dir, bundled: bool = False):
    """(entry, i, aa, x, y, z, b, bb): chains with even labels are helices, the others sheets whose
    strands run to and fro; each place is moved a little by the residue's own vector. ``bundled``
    chains are pieces of helix of eighteen residues side by side, ten Å apart."""
    e = table(spark, sf_dir, "embeddings").select(F.concat_ws("/", F.col("label").cast("string"), F.floor(F.col("vec_id") / 1000).cast("string")).alias("entry"), F.col("vec_id").alias("i"), F.coalesce("label", F.lit(0)).alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    e = U.placed(e).withColumnRenamed("place", "k").withColumns({"s": F.floor(F.col("k") / 8), "m": F.col("k") % 8})
    even = F.col("s") % 2 == 0
    e = e.withColumns({"u": F.when(even, F.col("m")).otherwise(7 - F.col("m")), "way": F.when(even, 1.0).otherwise(-1.0)})
    e = e.withColumn("up", F.when((F.col("u") + F.col("s")) % 2 == 0, 1.0).otherwise(-1.0))
    places = []
    for n, atom in enumerate(HELIX):
        radius, turn, rise = HELIX[atom]
        along, across = STRAND[atom]
        angle = (100 * F.col("k") + turn) * (math.pi / 180)
        helix = [radius * F.cos(angle), radius * F.sin(angle), 1.5 * F.col("k") + rise]
        sheet = [3.4 * F.col("u") + along * F.col("way"), 4.8 * F.col("s") + across * F.col("up"), F.lit(0.0)]
        if bundled:
            piece = F.floor(F.col("k") / 18)
            row = F.floor(piece / 3)
            sheet = helix = [10 * (piece % 3) + 5 * (row % 2) + helix[0], 8.66 * row + helix[1], 1.5 * (F.col("k") % 18) + rise]
        places += [F.when(F.col("label") % 2 == 0, h).otherwise(t) + JITTER * F.get("v", F.lit(3 * n + c)) for c, (h, t) in enumerate(zip(helix, sheet, strict=True))]
    letter = F.expr(f"substr('{AMINO}', cast(i % 20 as int) + 1, 1)")
    return e.select("entry", "i", letter.alias("aa"), *[places[3 + c].alias(x) for c, x in enumerate("xyz")], F.get("v", F.lit(12)).alias("b"), F.array(*places).alias("bb"))


def atoms(residues):
    """(entry, res, element, x, y, z) of their backbones."""
    one = lambda n, element: F.struct(F.lit(element).alias("element"), *[F.get("bb", F.lit(3 * n + c)).alias(x) for c, x in enumerate("xyz")])
    return residues.select("entry", F.col("i").cast("string").alias("res"), F.explode(F.array(*[one(n, ELEMENTS[a]) for n, a in enumerate(ELEMENTS)])).alias("a")).select("entry", "res", "a.*")


def structure_states(spark, sf_dir):
    return U.secondary_structure(chains(spark, sf_dir)).select("entry", "i", "ss")


def structure_surfaces(spark, sf_dir):
    s = U.surfaces(atoms(chains(spark, sf_dir)))
    return s.select("entry", F.round("mean_sasa", 4).alias("mean_sasa"), F.round("total_sasa", 4).alias("total_sasa"))


def structure_vectors(spark, sf_dir):
    """Long form of the 100 features with states and surfaces: entries that are not zero."""
    r = chains(spark, sf_dir)
    v = U.structure_features(r, atoms(r)).select("entry", F.posexplode("features").alias("pos", "value"))
    return v.select("entry", F.col("pos").cast("long").alias("pos"), F.round("value", 4).alias("value")).where("value <> 0")


def found_pockets(spark, sf_dir):
    """The 81 pocket features of chains whose pockets are found here: entries that are not zero."""
    r = chains(spark, sf_dir, bundled=True)
    name = F.element_at(F.array(*[F.lit(NAMES[a]) for a in AMINO]), F.instr(F.lit(AMINO), F.col("aa")))
    one = lambda n, element: F.struct((F.col("i") * len(ELEMENTS) + n).alias("atom"), F.lit(element).alias("element"), *[F.get("bb", F.lit(3 * n + c)).alias(x) for c, x in enumerate("xyz")])
    a = r.select("entry", "b", F.concat_ws(":", F.lit("A"), F.col("i").cast("string"), name).alias("res"), F.explode(F.array(*[one(n, ELEMENTS[a]) for n, a in enumerate(ELEMENTS)])).alias("a")).select("entry", "res", "b", "a.*")
    pockets, linings = C.find_pockets(kept(a, "atoms"))
    v = K.pocket_features(r.select("entry").distinct(), pockets, linings).select("entry", F.posexplode("features").alias("pos", "value"))
    return v.select("entry", F.col("pos").cast("long").alias("pos"), F.round("value", 4).alias("value")).where("value <> 0")


QUERIES = {"found_pockets": found_pockets, "structure_states": structure_states, "structure_surfaces": structure_surfaces, "structure_vectors": structure_vectors}


def _place(atom: str, n: int, c: int) -> str:
    radius, turn, rise = HELIX[atom]
    along, across = STRAND[atom]
    angle = f"((100 * k + {turn}::DOUBLE) * (pi() / 180))"
    helix = (f"{radius}::DOUBLE * cos{angle}", f"{radius}::DOUBLE * sin{angle}", f"1.5::DOUBLE * k + {rise}::DOUBLE")[c]
    sheet = (f"3.4::DOUBLE * u + {along}::DOUBLE * way", f"4.8::DOUBLE * s + {across}::DOUBLE * up", "0.0::DOUBLE")[c]
    return f"CASE WHEN label % 2 = 0 THEN {helix} ELSE {sheet} END + {JITTER}::DOUBLE * embedding[{3 * n + c + 1}]::DOUBLE AS {atom}{'xyz'[c]}"


_FAR = lambda a, p, b, q: "greatest(sqrt(" + " + ".join(f"({a}.{p}{c} - {b}.{q}{c}) * ({a}.{p}{c} - {b}.{q}{c})" for c in "xyz") + "), 1e-3::DOUBLE)"
_CH = f"""ch0 AS (SELECT concat_ws('/', label::VARCHAR, (vec_id // 1000)::VARCHAR) AS entry, vec_id AS i, coalesce(label, 0) AS label, embedding FROM embeddings),
ch1 AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY i) - 1 AS k FROM ch0), ch2 AS (SELECT *, k // 8 AS s, CASE WHEN (k // 8) % 2 = 0 THEN k % 8 ELSE 7 - k % 8 END AS u, CASE WHEN (k // 8) % 2 = 0 THEN 1 ELSE -1 END AS way FROM ch1),
ch3 AS (SELECT *, CASE WHEN (u + s) % 2 = 0 THEN 1 ELSE -1 END AS up FROM ch2),
ch AS (SELECT entry, i, k, substr('{AMINO}', (i % 20)::INT + 1, 1) AS l, embedding[13]::DOUBLE AS b, {", ".join(_place(a, n, c) for n, a in enumerate(HELIX) for c in range(3))} FROM ch3),
p AS (SELECT entry, i, ax AS x, ay AS y, az AS z, b, l FROM ch)"""
_SS = f"""{_CH}, q0 AS (SELECT c.*, p.cx AS px, p.cy AS py, p.cz AS pz FROM ch c LEFT JOIN ch p ON c.entry = p.entry AND p.k = c.k - 1),
q1 AS (SELECT *, sqrt({" + ".join(f"(n{c} - p{c}) * (n{c} - p{c})" for c in "xyz")}) AS dp, sqrt({" + ".join(f"(n{c} - a{c}) * (n{c} - a{c})" for c in "xyz")}) AS da FROM q0),
q2 AS (SELECT *, {", ".join(f"(n{c} - p{c}) / greatest(dp, 1e-9::DOUBLE) + (n{c} - a{c}) / greatest(da, 1e-9::DOUBLE) AS w{c}" for c in "xyz")} FROM q1),
q AS (SELECT *, {", ".join(f"n{c} + 1.01::DOUBLE * w{c} / greatest(sqrt(wx * wx + wy * wy + wz * wz), 1e-9::DOUBLE) AS h{c}" for c in "xyz")} FROM q2),
bo AS (SELECT a.entry, a.k AS i, b.k AS j FROM q a JOIN q b ON a.entry = b.entry AND abs(a.k - b.k) >= 2 AND b.k > 0 AND {_FAR("a", "a", "b", "a")} < {U.CA_NEAR}::DOUBLE
  WHERE 0.084::DOUBLE * 332 * (1 / {_FAR("a", "o", "b", "n")} + 1 / {_FAR("a", "c", "b", "h")} - 1 / {_FAR("a", "o", "b", "h")} - 1 / {_FAR("a", "c", "b", "n")}) < -0.5::DOUBLE),
nn AS (SELECT entry, count(*) AS n FROM ch GROUP BY entry),
hx AS (SELECT x.entry, unnest(range(x.i, x.j)) AS k FROM bo x JOIN bo y ON x.entry = y.entry AND y.i = x.i - 1 AND y.j = x.j - 1 AND x.j - x.i BETWEEN 3 AND 5),
br0 AS (SELECT x.entry, x.i + 1 AS p, x.j AS q FROM bo x JOIN bo y ON x.entry = y.entry AND y.i = x.j AND y.j = x.i + 2
  UNION ALL SELECT x.entry, x.i, x.j FROM bo x JOIN bo y ON x.entry = y.entry AND y.i = x.j AND y.j = x.i
  UNION ALL SELECT x.entry, x.i + 1, x.j - 1 FROM bo x JOIN bo y ON x.entry = y.entry AND y.i = x.j - 2 AND y.j = x.i + 2),
br AS (SELECT entry, unnest([p, q]) AS k FROM br0 JOIN nn USING (entry) WHERE p BETWEEN 1 AND n - 2 AND q BETWEEN 1 AND n - 2 AND abs(p - q) > 2),
ss AS (SELECT ch.entry, ch.i, l, CASE WHEN n < 4 THEN 'L' WHEN h.k IS NOT NULL THEN 'H' WHEN e.k IS NOT NULL THEN 'E' ELSE 'L' END AS ss FROM ch JOIN nn USING (entry)
  LEFT JOIN (SELECT DISTINCT * FROM hx) h ON h.entry = ch.entry AND h.k = ch.k LEFT JOIN (SELECT DISTINCT * FROM br) e ON e.entry = ch.entry AND e.k = ch.k)"""
_AT = "atm AS (SELECT *, row_number() OVER () AS id FROM (" + " UNION ALL ".join(f"SELECT entry, i AS res, {U.RADII[e] + U.PROBE}::DOUBLE AS w, {a}x AS x, {a}y AS y, {a}z AS z FROM ch" for a, e in ELEMENTS.items()) + "))"
_SA = f"""{_AT}, dt AS (SELECT cos(pi() * (1 + sqrt(5.0::DOUBLE)) * (d + 0.5::DOUBLE)) * sin(acos(1 - 2 * (d + 0.5::DOUBLE) / {U.DOTS})) AS dx, sin(pi() * (1 + sqrt(5.0::DOUBLE)) * (d + 0.5::DOUBLE)) * sin(acos(1 - 2 * (d + 0.5::DOUBLE) / {U.DOTS})) AS dy, 1 - 2 * (d + 0.5::DOUBLE) / {U.DOTS} AS dz, d FROM range({U.DOTS}) t(d)),
nb AS (SELECT a.id, a.w, a.x, a.y, a.z, b.x AS bx, b.y AS by_, b.z AS bz, b.w AS bw FROM atm a JOIN atm b ON a.entry = b.entry AND a.id <> b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) < a.w + b.w),
hd AS (SELECT id, count(DISTINCT d) AS hidden FROM nb, dt WHERE pow(x + w * dx - bx, 2) + pow(y + w * dy - by_, 2) + pow(z + w * dz - bz, 2) < bw * bw GROUP BY id),
sa AS (SELECT entry, avg(area) AS mean_sasa, sum(area) AS total_sasa FROM (SELECT entry, res, sum(4 * pi() * w * w * (1 - coalesce(hidden, 0) / {U.DOTS}::DOUBLE)) AS area FROM atm LEFT JOIN hd USING (id) GROUP BY entry, res) GROUP BY entry)"""
_CONTACTS = SEQUENCE_ORACLES["contact_stats"].replace(f"WITH {_P}, ", "").split("SELECT entry, n, round", 1)
ORACLES = {
    "structure_states": f"WITH {_SS} SELECT entry, i, ss FROM ss",
    "structure_surfaces": f"WITH {_CH}, {_SA} SELECT entry, round(mean_sasa, 4) AS mean_sasa, round(total_sasa, 4) AS total_sasa FROM sa",
    "structure_vectors": f"""WITH {_SS}, {_SA}, {_CONTACTS[0].rstrip()}, cs AS (SELECT entry, n, round{_CONTACTS[1]}), f AS (
  SELECT entry, instr('{U.STATES}', ss) - 1 AS pos, count(*)::DOUBLE / any_value(n) AS value FROM ss JOIN nn USING (entry) GROUP BY entry, ss
  UNION ALL SELECT entry, 3, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) FROM p GROUP BY entry UNION ALL SELECT entry, 4, avg(b) FROM p GROUP BY entry UNION ALL SELECT entry, 5, n FROM nn
  UNION ALL SELECT entry, 6, mean_sasa FROM sa UNION ALL SELECT entry, 7, total_sasa FROM sa
  UNION ALL SELECT entry, 8 + 3 * (instr('{AMINO}', l) - 1) + instr('{U.STATES}', ss) - 1, count(*)::DOUBLE / any_value(n) FROM ss JOIN nn USING (entry) GROUP BY entry, l, ss
  UNION ALL SELECT entry, 80 + instr('{AMINO}', l) - 1, count(*)::DOUBLE / any_value(n) FROM ss JOIN nn USING (entry) GROUP BY entry, l
  {" ".join(f"UNION ALL SELECT entry, {68 + i}, {c} FROM cs" for i, c in enumerate(U.CONTACT_COLUMNS))}
) SELECT entry, pos::BIGINT AS pos, round(value, 4) AS value FROM f WHERE round(value, 4) <> 0""",
}
