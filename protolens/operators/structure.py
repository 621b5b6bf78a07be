"""Structural features of proteins: secondary structure, accessible surface, the 100-D vector.

Secondary structure follows the published hydrogen-bond rule: electrostatic energy below
-0.5 kcal/mol between C=O and N-H, of residues whose CA atoms are nearer than 9 Å. Residues meet
in an equi-join of grid cells; turns, helices and bridges are joins of the bonds on their
numbers. Surfaces follow the rolling-probe method: atoms are dealt to blocks of space, with the
atoms around each block, and a block's points on spheres are tested in one call. So neither a
long chain nor a whole protein is a task's unit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from protolens.operators.spatial import CONTACT_COLUMNS, contact_stats, near_pairs
from protolens.schemas import AMINO
from protolens.sources.files import kept

STATES = "HEL"
#: charges' factor in kcal/mol, the energy under which a bond counts, the distance
#: of CA atoms in Å within which it is sought.
FACTOR, BOND, CA_NEAR = 0.084 * 332, -0.5, 9.0
#: Van der Waals radii in Å and the probe's; points on a sphere.
RADII, OTHER, PROBE, DOTS = {"H": 1.2, "C": 1.7, "N": 1.55, "O": 1.52, "S": 1.8, "P": 1.8}, 1.7, 1.4, 100
#: Edge in Å of the blocks of space in which surfaces are measured: about a thousand atoms.
EDGE = 25.6
#: Structures of up to so many atoms are not cut; such structures share a task's call, up to so many atoms.
WHOLE, TOGETHER = 1000, 8192


def _three(name: str, at: int) -> list[Column]:
    return [F.get("bb", F.lit(at + k)).alias(f"{name}{c}") for k, c in enumerate("xyz")]


def _apart(a: Column, p: str, b: Column, q: str) -> Column:
    """Distance of the places p of a and q of b, not under 0.001."""
    square = lambda c: (a[p + c] - b[q + c]) * (a[p + c] - b[q + c])
    return F.greatest(F.sqrt(square("x") + square("y") + square("z")), F.lit(1e-3))


def _unit(v: list[Column]) -> list[Column]:
    length = F.greatest(F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]), F.lit(1e-9))
    return [c / length for c in v]


def placed(residues: DataFrame) -> DataFrame:
    """``residues`` with ``place``, counted from 0 in each entry by i."""
    return residues.withColumn("place", (F.row_number().over(Window.partitionBy("entry").orderBy("i")) - 1).cast("long"))


def bonds(sites: DataFrame) -> DataFrame:
    """(entry, i, j): hydrogen bonds from C=O of place i to N-H of place j, two or more apart.

    ``sites`` are placed residues. The hydrogen lies 1.01 Å from N, away from the C before and
    from CA; the first residue of an entry has none.
    """
    own = sites.select("entry", F.col("place").alias("i"), *_three("n", 0), *_three("a", 3), *_three("c", 6), *_three("o", 9))
    before = own.select("entry", (F.col("i") + 1).alias("i"), *[F.col(f"c{c}").alias(f"p{c}") for c in "xyz"])
    own = own.join(before, ["entry", "i"], "left")
    towards = lambda p: _unit([F.col(f"n{c}") - F.col(p + c) for c in "xyz"])
    both = _unit([u + v for u, v in zip(towards("p"), towards("a"), strict=True)])
    own = own.withColumns({f"h{c}": F.col(f"n{c}") + 1.01 * u for c, u in zip("xyz", both, strict=True)} | {c: F.col(f"a{c}") for c in "xyz"})
    near = near_pairs(own.drop("px", "py", "pz", "ax", "ay", "az"), 2, CA_NEAR, strict=True)
    energy = lambda a, b: FACTOR * (1 / _apart(a, "o", b, "n") + 1 / _apart(a, "c", b, "h") - 1 / _apart(a, "o", b, "h") - 1 / _apart(a, "c", b, "n"))
    way = lambda a, b: F.struct(a["i"].alias("i"), b["i"].alias("j"), energy(a, b).alias("energy"))
    a, b = F.col("a"), F.col("b")
    made = near.select("entry", F.explode(F.array(way(a, b), way(b, a))).alias("w"))
    return made.where((F.col("w.energy") < BOND) & (F.col("w.j") > 0)).select("entry", "w.i", "w.j")


def _helices(made: DataFrame) -> DataFrame:
    """(entry, place) between two turns of one kind that follow each other."""
    turns = made.select("entry", "i", (F.col("j") - F.col("i")).alias("turn")).where("turn between 3 and 5")
    after = turns.select("entry", (F.col("i") + 1).alias("i"), "turn")
    return turns.join(after, ["entry", "i", "turn"]).select("entry", F.explode(F.sequence(F.col("i"), F.col("i") + F.col("turn") - 1)).alias("place"))


def _bridges(made: DataFrame, sizes: DataFrame) -> DataFrame:
    """(entry, place) in a bridge of p and q, both inside the chain and more than two apart. A
    bond and the one that it asks for: parallel p-1 to q and q to p+1, antiparallel p to q and
    back, or p-1 to q+1 and q-1 to p+1."""
    i, j = F.col("i"), F.col("j")
    ask = lambda want_i, want_j, p, q: F.struct(want_i.alias("i"), want_j.alias("j"), p.alias("p"), q.alias("q"))
    asked = made.select("entry", F.explode(F.array(ask(j, i + 2, i + 1, j), ask(j, i, i, j), ask(j - 2, i + 2, i + 1, j - 1))).alias("w")).select("entry", "w.*")
    met = asked.join(made, ["entry", "i", "j"]).join(sizes, "entry")
    inside = lambda c: (F.col(c) >= 1) & (F.col(c) <= F.col("n") - 2)
    return met.where(inside("p") & inside("q") & (F.abs(F.col("p") - F.col("q")) > 2)).select("entry", F.explode(F.array("p", "q")).alias("place"))


def secondary_structure(residues: DataFrame) -> DataFrame:
    """``residues`` (entry, i, bb, ...) with ``ss``: H, E or L; all L in entries under 4 residues.

    ``bb`` are the 12 coordinates of N, CA, C and O. Bonds are used four times: they are
    written to the shared folder once.
    """
    sites = placed(residues)
    sizes = sites.groupBy("entry").agg(F.count("*").alias("n"))
    made = kept(bonds(sites), "bonds")
    marks = _helices(made).withColumn("mark", F.lit("H")).unionByName(_bridges(made, sizes).withColumn("mark", F.lit("E")))
    marks = marks.groupBy("entry", "place").agg(F.max("mark").alias("mark"))
    out = sites.join(marks, ["entry", "place"], "left").join(sizes, "entry")
    return out.select(*[F.col(c) for c in residues.columns], F.when(F.col("n") < 4, F.lit("L")).otherwise(F.coalesce("mark", F.lit("L"))).alias("ss"))


def accessible_surface(points: np.ndarray, radii: np.ndarray, probe: float = PROBE, dots: int = DOTS, own: np.ndarray | None = None) -> np.ndarray:
    """Accessible surface of each atom in square Å, or of those that ``own`` numbers, by points
    on its expanded sphere."""
    k = np.arange(dots) + 0.5
    polar, turn = np.arccos(1 - 2 * k / dots), np.pi * (1 + 5**0.5) * k
    sphere = np.stack([np.cos(turn) * np.sin(polar), np.sin(turn) * np.sin(polar), np.cos(polar)], axis=1)
    wide, own = radii + probe, np.arange(len(points)) if own is None else own
    out = np.zeros(len(own))
    for at in range(0, len(own), 64):
        some = own[at : at + 64]
        apart = np.sqrt(((points[some, None] - points[None]) ** 2).sum(-1))
        near = apart < wide[some, None] + wide[None]
        near[np.arange(len(some)), some] = False
        for k, (i, others) in enumerate(zip(some, near, strict=True)):
            others = np.flatnonzero(others)
            surface = points[i] + wide[i] * sphere
            hidden = (((surface[:, None] - points[others][None]) ** 2).sum(-1) < wide[others] ** 2).any(axis=1) if len(others) else np.zeros(dots, bool)
            out[at + k] = 4 * np.pi * wide[i] ** 2 * (1 - hidden.mean())
    return out


def radius_of(element: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in RADII.items() for x in pair])[element], F.lit(OTHER))


def parted(rows: DataFrame, whole: int) -> tuple[DataFrame, int]:
    """(``rows`` with ``bucket``, number of tasks): entries of at most ``whole`` rows share a bucket
    with others, of up to TOGETHER rows but as many as there are tasks; larger ones have none. Rows
    are few bytes of much work, so the number of tasks for them is given."""
    sizes = rows.groupBy(F.col("entry").alias("of")).agg(F.count("*").alias("held"))
    spark = rows.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    small = sizes.where(F.col("held") <= whole).agg(F.sum("held")).first()[0] or 0
    buckets = max(1, -(-small // TOGETHER), min(tasks, -(-small // 1024)))
    rows = rows.join(sizes, F.col("entry").eqNullSafe(F.col("of"))).drop("of")
    return rows.withColumn("bucket", F.when(F.col("held") <= whole, F.pmod(F.xxhash64("entry"), F.lit(buckets)))).drop("held"), tasks


def dealt(atoms: DataFrame, edge: float, reach: float, whole: int = WHOLE):
    """``atoms`` grouped for work on structures, by (bucket, cut, bx, by, bz). An entry of at most
    ``whole`` atoms stays whole in a bucket of several. An atom of a larger one, ``cut``, goes to its
    own block of space, where ``own`` is set, and to all others that it lies within ``reach`` of."""
    rows, tasks = parted(atoms.where("x is not null and y is not null and z is not null"), whole)
    stays = F.col("bucket").isNotNull()
    rows = rows.withColumn("cut", F.when(~stays, F.col("entry")))
    cell = lambda v: F.floor(v / F.lit(edge))
    for c in "xyz":
        blocks = F.when(stays, F.array(F.lit(None).cast("long"))).otherwise(F.sequence(cell(F.col(c) - reach), cell(F.col(c) + reach)))
        rows = rows.withColumn(f"b{c}", F.explode(blocks))
    mine = [cell(F.col(c)) == F.col(f"b{c}") for c in "xyz"]
    keys = ["bucket", "cut", "bx", "by", "bz"]
    return rows.withColumn("own", stays | (mine[0] & mine[1] & mine[2])).repartition(tasks, *keys).groupBy(*keys)


def _block_surfaces(rows: pa.Table) -> pa.Table:
    p = np.stack([rows.column(c).to_numpy() for c in "xyz"], axis=1).astype(float)
    own, radius = rows.column("own").to_numpy(zero_copy_only=False), rows.column("radius").to_numpy()
    code = rows.column("entry").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    area = np.zeros(len(p))
    for e in range(code.max(initial=-1) + 1):
        at = np.flatnonzero(code == e)
        mine = own[at]
        area[at[mine]] = accessible_surface(p[at], radius[at], own=np.flatnonzero(mine))
    at = np.flatnonzero(own)
    return pa.table({"entry": rows.column("entry").take(at), "atom": rows.column("atom").take(at), "area": pa.array(area[at])})


def atom_surfaces(atoms: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(entry, atom, area) of (entry, atom, element, x, y, z): a call for several small entries, or
    for each block of space with the atoms around it; atoms are told apart by (entry, atom)."""
    reach = 2 * (max(*RADII.values(), OTHER) + PROBE)
    rows = atoms.select("entry", "atom", radius_of(F.col("element")).alias("radius"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    name = atoms.schema["atom"].dataType.simpleString()
    return dealt(rows, EDGE, reach, whole).applyInArrow(_block_surfaces, f"entry string, atom {name}, area double")


def surfaces(atoms: DataFrame) -> DataFrame:
    """(entry, mean_sasa, total_sasa) over the residues of (entry, res, element, x, y, z)."""
    each = atom_surfaces(atoms.withColumn("atom", F.col("res"))).groupBy("entry", "atom").agg(F.sum("area").alias("area"))
    return each.groupBy("entry").agg(F.avg("area").alias("mean_sasa"), F.sum("area").alias("total_sasa"))


def feature_columns() -> list[tuple[str, str]]:
    """(column, group) of the 100 structural features in order."""
    return [(f"ss_{s}_frac", "ss") for s in STATES] + [(c, "geom") for c in ("geom_radius_of_gyration", "geom_mean_bfactor", "geom_n_residues", "geom_mean_sasa", "geom_total_sasa")] + [(f"aass_{a}_{s}", "aa_ss") for a in AMINO for s in STATES] + [(c, "contact") for c in CONTACT_COLUMNS] + [(f"aa_{a}_frac", "aa") for a in AMINO]


def structure_features(residues: DataFrame, atoms: DataFrame | None = None) -> DataFrame:
    """(entry, n_residues, ss_counts, features): the 100-D vector of each entry.

    ``residues`` has (entry, i, aa, x, y, z, b, bb) with ``bb`` the 12 backbone coordinates.
    Shares are conditional sums by entry; contacts come from the grid join. Without ``atoms``
    surfaces are 0, as where they can't be computed.
    """
    p = secondary_structure(residues)
    count = lambda when: F.count_if(when).cast("double")
    sums = [F.count("*").alias("n"), F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("rg"), F.avg("b").alias("mean_b")]
    sums += [count(F.col("ss") == s).alias(f"ss_{s}") for s in STATES] + [count(F.col("aa") == a).alias(f"aa_{a}") for a in AMINO]
    sums += [count((F.col("aa") == a) & (F.col("ss") == s)).alias(f"both_{a}{s}") for a in AMINO for s in STATES]
    p = p.groupBy("entry").agg(*sums).join(contact_stats(residues).drop("n"), "entry", "left")
    if atoms is not None:
        p = p.join(surfaces(atoms), "entry", "left")
    sasa = [F.coalesce(F.col(c), F.lit(0.0)) if atoms is not None else F.lit(0.0) for c in ("mean_sasa", "total_sasa")]
    share = lambda c: F.col(c) / F.col("n")
    vector = [share(f"ss_{s}") for s in STATES] + [F.col("rg"), F.col("mean_b"), F.col("n").cast("double"), *sasa]
    vector += [share(f"both_{a}{s}") for a in AMINO for s in STATES] + [F.col(c) for c in CONTACT_COLUMNS] + [share(f"aa_{a}") for a in AMINO]
    counts = F.map_filter(F.map_from_arrays(F.lit(list(STATES)), F.array(*[F.col(f"ss_{s}").cast("int") for s in STATES])), lambda _, v: v > 0)
    return p.select("entry", F.col("n").cast("int").alias("n_residues"), counts.alias("ss_counts"), F.array(*[v.cast("double") for v in vector]).alias("features"))
