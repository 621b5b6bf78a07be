"""Secondary structure, surfaces and pockets against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from protolens.operators import cavity as C
from protolens.operators import pocket as K
from protolens.operators import structure as U
from protolens.operators.graph import connected
from protolens.plans import structure_queries as Q

DIR = "/root/testdata/sf0.001"


def plain_bonds(backbone):
    """Matrix of hydrogen bonds, C=O of row i to N-H of column j; n x (N, CA, C, O) x 3."""
    nitrogen, alpha, carbon, oxygen = (backbone[:, k] for k in range(4))
    towards = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-9)
    hydrogen = nitrogen.copy()
    hydrogen[1:] += 1.01 * towards(towards(nitrogen[1:] - carbon[:-1]) + towards(nitrogen[1:] - alpha[1:]))
    far = lambda a, b: np.maximum(np.linalg.norm(a[:, None] - b[None], axis=-1), 1e-3)
    made = U.FACTOR * (1 / far(oxygen, nitrogen) + 1 / far(carbon, hydrogen) - 1 / far(oxygen, hydrogen) - 1 / far(carbon, nitrogen)) < U.BOND
    made &= np.linalg.norm(alpha[:, None] - alpha[None], axis=-1) < U.CA_NEAR
    i, j = np.indices(made.shape)
    return made & (np.abs(i - j) >= 2) & (j > 0)


def plain_states(backbone):
    n = len(backbone)
    if n < 4:
        return "L" * n
    b = plain_bonds(backbone)
    at = lambda i, j: 0 <= i < n and 0 <= j < n and b[i, j]
    out = ["L"] * n
    for p, q in itertools.product(range(1, n - 1), repeat=2):
        if abs(p - q) > 2 and ((at(p - 1, q) and at(q, p + 1)) or (at(q - 1, p) and at(p, q + 1)) or (at(p, q) and at(q, p)) or (at(p - 1, q + 1) and at(q - 1, p + 1))):
            out[p] = "E"
    for turn, i in itertools.product((3, 4, 5), range(1, n)):
        if at(i, i + turn) and at(i - 1, i - 1 + turn):
            out[i : i + turn] = "H" * turn
    return "".join(out)


def chain(rng, kind, n):
    places = []
    for k in range(n):
        s, m = divmod(k, 8)
        u, way = (m, 1) if s % 2 == 0 else (7 - m, -1)
        up = 1 if (u + s) % 2 == 0 else -1
        for a in Q.HELIX:
            if kind == "helix":
                r, turn, rise = Q.HELIX[a]
                w = math.radians(100 * k + turn)
                places.append((r * math.cos(w), r * math.sin(w), 1.5 * k + rise))
            elif kind == "sheet":
                places.append((3.4 * u + Q.STRAND[a][0] * way, 4.8 * s + Q.STRAND[a][1] * up, 0.0))
            else:
                places.append(tuple(rng.uniform(0, 9, 3)))
    return (np.array(places) + rng.normal(0, 0.08, (4 * n, 3))).reshape(n, 4, 3)


def test_states(spark):
    rng = np.random.default_rng(4)
    made = {f"{kind}{n}": chain(rng, kind, n) for kind in ("helix", "sheet", "cloud") for n in (1, 3, 4, 17, 60)}
    rows = [(e, 3 * i + 5, *map(float, r.ravel())) for e, c in made.items() for i, r in enumerate(c)]
    names = [f"c{k}" for k in range(12)]
    df = spark.createDataFrame(rows, ["entry", "i", *names]).select("entry", "i", F.array(*names).alias("bb")).repartition(3)
    got = {e: "" for e in made}
    for r in U.secondary_structure(df).orderBy("entry", "i").collect():
        got[r["entry"]] += r["ss"]
    assert got == {e: plain_states(c) for e, c in made.items()}
    assert got["helix60"].count("H") > 45 and got["sheet60"].count("E") > 30 and "E" in got["cloud60"] + got["sheet17"]


def test_surfaces_in_blocks(spark):
    """Blocks give what one call on all atoms gives, over their borders too."""
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.uniform(-40, 40, (700, 3)), rng.uniform(20, 30, (200, 3)), [[25.6, 0, 0], [25.6, 25.6, 25.6], [0, 0, 0]]])
    kinds = rng.choice(["C", "N", "O", "S", "X"], len(p))
    df = spark.createDataFrame([("e", int(i), str(k), *map(float, v)) for i, (k, v) in enumerate(zip(kinds, p, strict=True))] + [("e", 9999, "C", None, 0.0, 0.0), ("f", 1, "C", 0.0, 0.0, 0.0)], "entry string, atom long, element string, x double, y double, z double").repartition(4)
    got = {(r["entry"], r["atom"]): r["area"] for r in U.atom_surfaces(df).collect()}
    want = U.accessible_surface(p, np.array([U.RADII.get(k, U.OTHER) for k in kinds]))
    assert len(got) == len(p) + 1 and got["f", 1] == pytest.approx(4 * math.pi * 3.1**2)
    assert [got["e", i] for i in range(len(p))] == pytest.approx(want.tolist())


def plain_spheres(p, least, most):
    found = {}
    for c in itertools.combinations(range(len(p)), 4):
        middle, square = C.circumspheres(p[list(c)][None])
        if least**2 <= square[0] <= most**2 and (((p - middle) ** 2).sum(1) >= square[0] - 1e-3).all():
            found[c] = (*middle[0], square[0] ** 0.5)
    return found


def test_alpha_spheres(spark):
    """All empty spheres of four atoms, found in blocks smaller than the structure."""
    rng = np.random.default_rng(6)
    made = {e: rng.uniform(-9, 9, (n, 3)) for e, n in (("a", 26), ("b", 3), ("c", 4))}
    made["d"] = np.concatenate([made["a"][:8], made["a"][:8]])  # atoms on one place
    rows = [(e, i, "C", *map(float, v)) for e, p in made.items() for i, v in enumerate(p)]
    atoms = spark.createDataFrame([*rows, ("a", 99, "C", None, 1.0, 1.0)], "entry string, atom long, element string, x double, y double, z double")
    got = {}
    for r in C.alpha_spheres(atoms, 2.0, 6.0, edge=7.0).collect():
        assert (r["entry"], tuple(r["atoms"])) not in got
        got[r["entry"], tuple(r["atoms"])] = (r["x"], r["y"], r["z"], r["radius"])
    want = {(e, c): v for e, p in made.items() for c, v in plain_spheres(p[:8] if e == "d" else p, 2.0, 6.0).items()}
    assert set(got) == set(want) and len(want) > 40
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-2)


def test_small_structures_stay_whole(spark):
    """Atoms of small entries are dealt once, not to every block around, and blocks, whole entries
    and entries that share a call give the same spheres, pockets and surfaces."""
    rng = np.random.default_rng(9)
    made = {e: rng.uniform(-9, 9, (n, 3)) for e, n in (("a", 60), ("b", 3), ("c", 45), ("d", 1))}
    rows = [(e, i, "C", *map(float, v)) for e, p in made.items() for i, v in enumerate(p)] + [(None, 7, "C", 1.0, 1.0, 1.0)]
    atoms = spark.createDataFrame(rows, "entry string, atom long, element string, x double, y double, z double").repartition(3)
    assert U.dealt(atoms, 7.0, 6.0).count().agg({"count": "sum"}).first()[0] == len(rows)
    found = {w: C.alpha_spheres(atoms, 2.0, 6.0, edge=7.0, whole=w) for w in (0, 50, 1000)}
    got = {w: {(r["entry"], tuple(r["atoms"])): (r["x"], r["y"], r["z"], r["radius"], r["apolar"]) for r in f.collect()} for w, f in found.items()}
    assert len(got[0]) > 40 and {e for e, _ in got[0]} == {"a", "c"} and got[0].keys() == got[50].keys() == got[1000].keys()
    assert all(got[w][k] == pytest.approx(v, abs=1e-9) for w in (50, 1000) for k, v in got[0].items())
    areas = [{(r["entry"], r["atom"]): r["area"] for r in U.atom_surfaces(atoms, w).collect()} for w in (0, 1000)]
    assert areas[0] == areas[1] and len(areas[0]) == len(rows)
    least = max(1, min(len([k for k in got[0] if k[0] == e]) for e in "ac"))
    pockets = [sorted((r["sphere"], r["pocket"]) for r in C.pocket_spheres(found[0], 1.5, 2, w).collect()) for w in (0, least, 1000)]
    assert pockets[0] == pockets[1] == pockets[2] and len({p for _, p in pockets[0]}) > 2


def shell(radius, n=220):
    """Atoms evenly on a sphere."""
    k = np.arange(n) + 0.5
    polar, turn = np.arccos(1 - 2 * k / n), np.pi * (1 + 5**0.5) * k
    return radius * np.stack([np.cos(turn) * np.sin(polar), np.sin(turn) * np.sin(polar), np.cos(polar)], axis=1)


def test_known_cavity(spark):
    """A hollow ball has one pocket inside of known size; a full one and a plane have none."""
    rng = np.random.default_rng(7)
    ball = np.concatenate([shell(r, int(2.2 * r * r) + 40) for r in (6.0, 7.5, 9.0)])
    full = np.concatenate([ball, shell(4.5, 110), shell(3.0, 50), shell(1.5, 14), [[0, 0, 0]]])
    plane = np.array([[1.5 * i, 1.5 * j, 0] for i in range(15) for j in range(15)], float) + rng.normal(0, 0.02, (225, 3))
    rows = []
    for e, p in (("hollow", ball), ("full", full), ("plane", plane)):
        rows += [(e, i, f"A:{i // 4}:{'LEU' if i % 8 < 4 else 'LYS'}", "O" if i % 4 == 3 else "C", *map(float, v + 31.7), float(i % 4)) for i, v in enumerate(p)]
    atoms = spark.createDataFrame(rows, "entry string, atom long, res string, element string, x double, y double, z double, b double").repartition(3)
    pockets, linings = C.find_pockets(atoms)
    got = pockets.collect()
    assert [(r["entry"], r["pocket_no"]) for r in got] == [("hollow", 1)]
    p = got[0]["props"]
    assert 5.5 < p["Mean alpha sphere radius"] <= 6.0 and p["Volume"] == pytest.approx(4 / 3 * math.pi * 6**3, rel=0.1)
    assert set(p) <= set(K.FIELDS) and p["Number of Alpha Spheres"] >= 15 and p["Total SASA"] == pytest.approx(p["Polar SASA"] + p["Apolar SASA"])
    assert 0 < p["Proportion of polar atoms"] < 1 and p["Charge score"] > 0 and 0 <= p["Flexibility"] <= 1
    shares = {r["aa"]: r["frac"] for r in linings.collect()}
    assert set(shares) == {"L", "K"} and sum(shares.values()) == pytest.approx(1)
    vectors = {r["entry"]: r["features"] for r in K.pocket_features(spark.createDataFrame([("hollow",), ("full",)], "entry string"), pockets, linings).collect()}
    assert vectors["hollow"][57] == 1 and vectors["hollow"][59] == p["Volume"] and set(vectors["full"]) == {0.0}


def test_connected(spark):
    rng = np.random.default_rng(8)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(1, 300)]
    root = {n: n for link in links for n in link}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: top(n) for n in root}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_made_chains(spark):
    """The query's chains are helices and sheets, and their states are those of the plain version."""
    rows = Q.structure_states(spark, DIR).join(Q.chains(spark, DIR).select("entry", "i", "bb"), ["entry", "i"]).orderBy("entry", "i").collect()
    for e in {r["entry"] for r in rows}:
        own = [r for r in rows if r["entry"] == e]
        assert "".join(r["ss"] for r in own) == plain_states(np.array([r["bb"] for r in own]).reshape(-1, 4, 3))
    assert {r["ss"] for r in rows} == {"H", "E", "L"}
