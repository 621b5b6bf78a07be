"""Pockets of proteins from alpha spheres: empty spheres that touch four atoms.

Alpha spheres are the circumscribed spheres of Delaunay tetrahedra; those with radii between
``LEAST`` and ``MOST`` lie in clefts and cavities. A sphere whose centre lies in a block of space
is decided by the atoms within ``MOST`` of that block: atoms of large structures are dealt to blocks
with that margin, each block is triangulated on its own and keeps the spheres of its centres, so that
blocks together give the spheres of the whole structure, each once. Small structures stay whole, and
several are triangulated together. Every sphere is checked to be empty.

Spheres whose centres are within ``LINK`` are linked (in large structures by a grid join); connected
ones are a pocket if there are at least ``SPHERES`` of them. Descriptors are aggregations over spheres, the atoms and
residues that they touch, and voxels.

Results for odd input: atoms without a full place take no part, of atoms on one place that with
the least id counts; places are moved by less than 0.0001 Å so that no five atoms lie on one
sphere; structures without pockets give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from protolens.operators.graph import connected
from protolens.operators.spatial import near_pairs
from protolens.operators.structure import WHOLE, atom_surfaces, dealt, parted
from protolens.schemas import HYDROPATHY, RESIDUES
from protolens.sources.files import kept

#: Radii of alpha spheres and distance of linked centres in Å, spheres of a pocket.
LEAST, MOST, LINK, SPHERES = 3.0, 6.0, 2.4, 15
#: Edges in Å of the blocks that are triangulated and of the voxels of a volume.
EDGE, VOXEL = 20.0, 1.0
#: Structures of up to so many spheres are linked in one call.
LINKED = 4096
#: Polar elements, polar residues, charges of residues.
POLAR, POLAR_RESIDUES, CHARGES = ("N", "O"), "DEHKNQRSTYCW", {"K": 1, "R": 1, "D": -1, "E": -1}


def circumspheres(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and squared radii of tetrahedra (n x 4 x 3); flat ones have an infinite radius."""
    edges = p[:, 1:] - p[:, :1]
    right = (edges**2).sum(2) / 2
    flat = np.abs(np.linalg.det(edges)) < 1e-12
    edges = np.where(flat[:, None, None], np.eye(3), edges)
    middle = np.linalg.solve(edges, right[:, :, None])[:, :, 0]
    return p[:, 0] + middle, np.where(flat, np.inf, (middle**2).sum(1))


def tetrahedra(points: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """Delaunay tetrahedra (n x 4) of points in general position, of structures of these ``sizes``
    that follow each other: each point takes out the tetrahedra whose spheres hold it and is joined
    to the faces of the hole. A step adds a point to every structure. Tetrahedra whose spheres end
    before the x of all points to come are put aside, so points sorted by x ask few."""
    n, sizes = len(points), np.array([len(points)] if sizes is None else sizes)
    first = np.cumsum(sizes) - sizes
    parts = [slice(a, a + k) for a, k in zip(first, sizes, strict=True)]
    far = 1e3 * (1 + np.array([np.abs(points[s]).max(initial=0.0) for s in parts]))
    p = np.concatenate([points, (far[:, None, None] * np.array([[1, 1, 1], [1, -1, -1], [-1, 1, -1], [-1, -1, 1]])).reshape(-1, 3)])
    least = np.concatenate([np.minimum.accumulate(points[s, 0][::-1])[::-1] for s in parts] + [[np.inf]])
    every, used, aside = len(p), len(sizes), []
    corners, of = n + np.arange(4 * used).reshape(-1, 4), np.arange(used)
    centre, square = circumspheres(p[corners])  # a square below zero marks a free place
    now = np.full((len(sizes), 3), np.nan)
    for i in range(sizes.max(initial=0)):
        now[sizes <= i], now[sizes > i] = np.nan, p[first[sizes > i] + i]
        hit = np.flatnonzero(((centre[:used] - now[of[:used]]) ** 2).sum(1) < square[:used])
        own = np.sort(corners[hit], axis=1)
        faces = own[:, [[0, 1, 2], [0, 1, 3], [0, 2, 3], [1, 2, 3]]].reshape(-1, 3)
        keys = (faces[:, 0] * every + faces[:, 1]) * every + faces[:, 2]
        order = np.argsort(keys)
        twin, once = np.diff(keys[order]) == 0, np.ones(len(keys), bool)
        once[1:] &= ~twin
        once[:-1] &= ~twin
        outer = order[once]
        whose = of[hit[outer // 4]]
        new = np.concatenate([faces[outer], (first[whose] + i)[:, None]], axis=1)
        made, wide = circumspheres(p[new])
        if used + len(new) > len(square):
            more = used + len(new)
            corners, centre, square, of = (np.concatenate([v[:used], np.zeros((more, *v.shape[1:]), v.dtype)]) for v in (corners, centre, square, of))
        square[hit] = -1
        at = np.concatenate([hit, np.arange(used, used + max(0, len(new) - len(hit)))])[: len(new)]
        corners[at], centre[at], square[at], of[at] = new, made, wide, whose
        used = max(used, int(at.max(initial=-1)) + 1)
        if i % 16 == 15:
            coming = np.where(sizes > i + 1, least[np.minimum(first + i + 1, n)], np.inf)
            live = square[:used] >= 0
            over = live & (centre[:used, 0] + np.sqrt(np.maximum(square[:used], 0)) < coming[of[:used]] - 1e-6)
            aside.append(corners[:used][over])
            stay = np.flatnonzero(live & ~over)
            used = len(stay)
            for v in (corners, centre, square, of):
                v[:used] = v[stay]
    corners = np.concatenate([*aside, corners[:used][square[:used] >= 0]])
    return corners[(corners < n).all(axis=1)]


def alpha_spheres_of(points: np.ndarray, least: float, most: float, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(corners, centres, radii) of the empty spheres with radii in that range, of structures of
    these ``sizes`` that follow each other."""
    sizes = np.array([len(points)] if sizes is None else sizes)
    ends = np.cumsum(sizes)
    shift = np.concatenate([np.zeros((0, 3))] + [np.tile(points[e - k : e].mean(axis=0), (k, 1)) for e, k in zip(ends, sizes, strict=True) if k])
    noise = np.sin(points @ np.array([[12.9898, 39.3467, 73.1562], [78.233, 11.1357, 52.2351], [37.719, 83.155, 9.1513]])) * 43758.5453
    p = points - shift + 1e-4 * (noise - np.floor(noise) - 0.5)
    corners = tetrahedra(p, sizes)
    centres, squares = circumspheres(p[corners])
    fits = np.flatnonzero((squares >= least**2) & (squares <= most**2))
    of = np.searchsorted(ends, corners[fits, 0], "right")
    fits, of = fits[np.argsort(of, kind="stable")], np.sort(of)
    corners, centres, radii = corners[fits], centres[fits], np.sqrt(squares[fits])
    empty = np.ones(len(radii), bool)
    for s, (e, k) in enumerate(zip(ends, sizes, strict=True)):
        own, last = p[e - k : e], np.searchsorted(of, s, "right")
        for at in range(np.searchsorted(of, s), last, 256):
            some = slice(at, min(at + 256, last))
            apart = np.sqrt(((centres[some, None] - own[None]) ** 2).sum(-1))
            empty[some] = (apart >= radii[some, None] - 1e-6).all(axis=1)
    return corners[empty], centres[empty] + shift[corners[empty, 0]], radii[empty]


def _block_spheres(edge: float, least: float, most: float):
    def over(key: tuple, rows: pa.Table) -> pa.Table:
        block = [k.as_py() for k in key[2:]]
        ids, polar = rows.column("atom").to_numpy(), rows.column("polar").to_numpy(zero_copy_only=False)
        names = rows.column("entry").combine_chunks().dictionary_encode(null_encoding="encode")
        code = names.indices.to_numpy()
        p = np.stack([rows.column(c).to_numpy() for c in "xyz"], axis=1)
        order = np.lexsort((ids, p[:, 2], p[:, 1], p[:, 0], code))
        order = order[np.concatenate([[True], (p[order][1:] != p[order][:-1]).any(axis=1) | (code[order][1:] != code[order][:-1])])]
        ids, polar, p, code = ids[order], polar[order], p[order], code[order]
        corners, centres, radii = alpha_spheres_of(p, least, most, np.bincount(code))
        if block[0] is not None:
            here = (np.floor(centres / edge) == np.array(block)).all(axis=1)
            corners, centres, radii = corners[here], centres[here], radii[here]
        touched = np.sort(ids[corners], axis=1)
        arrays = [names.dictionary.take(pa.array(code[corners[:, 0]])), *[pa.array(centres[:, c]) for c in range(3)], pa.array(radii), pa.array((~polar[corners]).sum(axis=1) >= 3), pa.array(touched.tolist(), pa.list_(pa.int64()))]
        return pa.Table.from_arrays(arrays, names=["entry", "x", "y", "z", "radius", "apolar", "atoms"])

    return over


def alpha_spheres(atoms: DataFrame, least: float = LEAST, most: float = MOST, edge: float = EDGE, whole: int = WHOLE) -> DataFrame:
    """(sphere, entry, x, y, z, radius, apolar, atoms) of (entry, atom: long, element, x, y, z);
    ``atoms`` are the four that it touches, apolar spheres touch three or four apolar ones."""
    rows = atoms.select("entry", "atom", F.col("element").isin(*POLAR).alias("polar"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    made = dealt(rows, edge, most, whole).applyInArrow(_block_spheres(edge, least, most), "entry string, x double, y double, z double, radius double, apolar boolean, atoms array<bigint>")
    return kept(made.withColumn("sphere", F.monotonically_increasing_id()), "spheres")


def _linked(link: float):
    """Spheres with their pocket, of several whole entries: roots sink along links and are shortened."""

    def over(rows: pa.Table) -> pa.Table:
        p = np.stack([rows.column(c).to_numpy() for c in "xyz"], axis=1)
        ids = rows.column("sphere").to_numpy()
        code = rows.column("entry").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        pocket = np.empty(len(ids), np.int64)
        for e in range(code.max(initial=-1) + 1):
            at = np.flatnonzero(code == e)
            at = at[np.argsort(ids[at])]
            q, a, b = p[at], [], []
            for i in range(0, len(at), 256):
                near = np.nonzero(np.sqrt(((q[i : i + 256, None] - q[None]) ** 2).sum(-1)) <= link)
                a.append(near[0] + i)
                b.append(near[1])
            a, b, root = np.concatenate(a), np.concatenate(b), np.arange(len(at))
            while True:
                low = root.copy()
                np.minimum.at(low, a, root[b])
                np.minimum.at(low, root, low.copy())
                low = low[low]
                if (low == root).all():
                    break
                root = low
            pocket[at] = ids[at[root]]
        return rows.append_column("pocket", pa.array(pocket))

    return over


def pocket_spheres(spheres: DataFrame, link: float = LINK, at_least: int = SPHERES, whole: int = LINKED) -> DataFrame:
    """``spheres`` with ``pocket``, the least sphere of a group, of groups that are large enough.
    Entries of at most ``whole`` spheres are linked where they lie, larger ones by a grid join."""
    rows, tasks = parted(spheres, whole)
    rows = kept(rows, "parted-spheres")
    own, large = rows.where("bucket is not null").repartition(tasks, "bucket"), rows.where("bucket is null").drop("bucket")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    every = own.groupBy("bucket").applyInArrow(_linked(link), f"{schema}, pocket long").drop("bucket")
    if not large.isEmpty():
        near = near_pairs(large.select("entry", F.col("sphere").alias("i"), "x", "y", "z"), 1, link)
        groups = connected(near.select(F.col("a.i").alias("a"), F.col("b.i").alias("b")))
        every = every.unionByName(large.join(groups.withColumnRenamed("node", "sphere"), "sphere", "left").withColumn("pocket", F.coalesce("root", "sphere")).drop("root"))
    every = kept(every, "linked-spheres")
    sizes = every.groupBy("pocket").count().where(F.col("count") >= at_least)
    return kept(every.join(sizes.select("pocket"), "pocket", "left_semi"), "pocket-spheres")


def _volumes(spheres: DataFrame, voxel: float) -> DataFrame:
    """(pocket, volume): voxels whose middle lies in a sphere, each once."""
    span = lambda c: F.sequence(F.ceil((F.col(c) - F.col("radius")) / voxel - 0.5), F.floor((F.col(c) + F.col("radius")) / voxel - 0.5))
    rows = spheres.select("pocket", "x", "y", "z", "radius", F.explode(span("x")).alias("vx")).withColumn("vy", F.explode(span("y"))).withColumn("vz", F.explode(span("z")))
    off = lambda c: F.pow((F.col(f"v{c}") + 0.5) * voxel - F.col(c), F.lit(2))
    inside = rows.where(off("x") + off("y") + off("z") <= F.col("radius") * F.col("radius"))
    return inside.select("pocket", "vx", "vy", "vz").distinct().groupBy("pocket").agg((F.count("*") * voxel**3).alias("volume"))


def _letter(res: Column) -> Column:
    """One letter of a residue named chain:number:name."""
    name = F.element_at(F.split(res, ":"), -1)
    return F.create_map(*[F.lit(x) for pair in RESIDUES.items() for x in pair])[name]


def _by_letter(values: dict[str, float], letter: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))])[letter], F.lit(0.0))


def find_pockets(atoms: DataFrame, least: float = LEAST, most: float = MOST, link: float = LINK, at_least: int = SPHERES) -> tuple[DataFrame, DataFrame]:
    """((entry, pocket_no, props), (entry, aa, frac) of the first pocket): the tables that
    ``pocket_features`` takes.

    ``atoms`` has (entry, atom: long, res: chain:number:name, element, x, y, z, b). Pockets of an
    entry are numbered by falling score, the logarithm of the number of spheres times the share
    of apolar ones and one; it orders pockets and isn't fitted to anything. Densities are those
    of the reports' fields: other apolar spheres that overlap an apolar one, on average, and the
    root mean square distance of two centres. Flexibility is the mean place of lining atoms' b
    between the entry's least and greatest. Druggability, volume score and solvent access are not given.
    """
    spheres = pocket_spheres(alpha_spheres(atoms, least, most), link, at_least)
    middle = spheres.groupBy("pocket").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"))
    reach = F.sqrt(sum(((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in "xyz"), F.lit(0.0)))
    n = F.count("*")
    shape = spheres.join(middle, "pocket").groupBy("entry", "pocket").agg(n.alias("n"), F.avg("radius").alias("radius"), F.avg(F.col("apolar").cast("double")).alias("apolar"), F.max(reach).alias("reach"), F.sqrt(2 * n / F.greatest(n - 1, F.lit(1)) * (F.var_pop("x") + F.var_pop("y") + F.var_pop("z"))).alias("spread"))
    hydro = spheres.where("apolar").select(F.col("pocket").alias("entry"), F.col("sphere").alias("i"), "x", "y", "z", "radius")
    close = near_pairs(hydro, 1, 2 * most).where(F.col("dist") <= F.col("a.radius") + F.col("b.radius")).groupBy(F.col("entry").alias("pocket")).agg((2 * F.count("*")).alias("close"))
    close = close.join(hydro.groupBy(F.col("entry").alias("pocket")).agg(n.alias("hydro")), "pocket").select("pocket", (F.col("close") / F.col("hydro")).alias("density"))
    span = atoms.groupBy("entry").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    lined = spheres.select("entry", "pocket", F.explode("atoms").alias("atom")).distinct()
    lined = lined.join(atoms.select("entry", "atom", "res", "element", "b"), ["entry", "atom"]).join(atom_surfaces(atoms), ["entry", "atom"], "left").join(span, "entry")
    lined = kept(lined.withColumn("letter", _letter(F.col("res"))), "linings")
    polar = F.col("element").isin(*POLAR)
    bend = F.when(F.col("high") > F.col("low"), (F.col("b") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    touch = lined.groupBy("pocket").agg(F.sum("area").alias("sasa"), F.coalesce(F.sum(F.when(polar, F.col("area"))), F.lit(0.0)).alias("polar_sasa"), F.avg(polar.cast("double")).alias("polar"), F.avg(bend).alias("bend"))
    residues = lined.select("entry", "pocket", "res", "letter").distinct()
    kinds = residues.groupBy("pocket").agg(F.avg(_by_letter(HYDROPATHY, F.col("letter"))).alias("hydropathy"), F.count_if(F.coalesce(F.col("letter").isin(*POLAR_RESIDUES), F.lit(False))).alias("polarity"), F.sum(_by_letter(CHARGES, F.col("letter"))).alias("charge"))
    found = shape.join(close, "pocket", "left").join(touch, "pocket").join(kinds, "pocket").join(_volumes(spheres, VOXEL), "pocket", "left")
    found = found.withColumn("score", F.log1p("n") * (1 + F.col("apolar")))
    order = Window.partitionBy("entry").orderBy(F.desc("score"), "pocket")
    found = kept(found.withColumn("pocket_no", F.row_number().over(order)), "pockets")
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    fields = {
        "Score": "score", "Number of Alpha Spheres": "n", "Total SASA": "sasa", "Polar SASA": "polar_sasa", "Volume": "volume", "Mean local hydrophobic density": "density", "Mean alpha sphere radius": "radius",
        "Apolar alpha sphere proportion": "apolar", "Hydrophobicity score": "hydropathy", "Polarity score": "polarity", "Charge score": "charge", "Proportion of polar atoms": "polar",
        "Alpha sphere density": "spread", "Cent. of mass - Alpha Sphere max dist": "reach", "Flexibility": "bend",
    }
    props = F.create_map(*[x for name, c in fields.items() for x in (F.lit(name), value(c))], F.lit("Apolar SASA"), value("sasa") - value("polar_sasa"))
    pockets = found.select("entry", "pocket_no", props.alias("props"))
    first = residues.where("letter is not null").join(found.where("pocket_no = 1").select("pocket"), "pocket", "left_semi")
    total = first.groupBy("entry").agg(n.alias("t"))
    linings = first.groupBy("entry", F.col("letter").alias("aa")).agg(n.alias("k")).join(total, "entry").select("entry", "aa", (F.col("k") / F.col("t")).alias("frac"))
    return pockets, linings
