import math

import numpy as np
import pytest

from protolens.operators import pocket as K
from protolens.operators import spatial as P
from protolens.operators import structure as U
from protolens.sources import files as S


def atom(serial, name, res, chain, num, x, y, z, b, record="ATOM  ", element=None):
    return f"{record}{serial:>5} {name:<4} {res:>3} {chain}{num:>4}    {x:8.3f}{y:8.3f}{z:8.3f}{1.0:6.2f}{b:6.2f}          {element or name.strip()[0]:>2}"


def helix(n, res="ALA"):
    """Backbone of an ideal alpha helix."""
    lines, serial = [], 1
    for i in range(n):
        for name, radius, turn, rise in (("N", 1.55, -27.0, -0.9), ("CA", 2.28, 0.0, 0.0), ("C", 1.68, 26.0, 1.1), ("O", 1.99, 22.5, 2.3)):
            a = math.radians(100 * i + turn)
            lines.append(atom(serial, f" {name}", res, "A", i + 1, radius * math.cos(a), radius * math.sin(a), 1.5 * i + rise, 50 + i))
            serial += 1
    return lines


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "pdb").mkdir()
    (d / "pdb/h1.pdb").write_text("\n".join(["HEADER x", "MODEL 1", *helix(14), atom(99, " CA", "UNK", "A", 90, 1, 1, 1, 9), atom(98, " CA", "GLY", "A", 91, 2, 2, 2, 9), atom(97, " CA", "HOH", "A", 92, 3, 3, 3, 9, "HETATM"), "ENDMDL", "MODEL 2", *helix(14)]) + "\n")
    (d / "pdb/empty.pdb").write_text("")
    (d / "a.fasta").write_text(">one desc\nAcd\nef\n\n>two\n>three x\nGG GG\n>one again\nKK\n")
    (d / "hits.tsv").write_text("q\tt\t12.5\t1e-3\t0.9\t0.5\t0.3\t0.7\nq\tu\t7\t2\t0.1\t0.2\t0.1\t0.2\n")
    (d / "t.csv").write_text("entry,label\ne1,2.7.7.10\ne2,1.1.1.100\n")
    (d / "p1_info.txt").write_text("Pocket 1 :\n\tScore : \t0.5\n\tVolume : \t100.0\n\tName : \tabc\n\nPocket 2 :\n\tScore : \t0.25\n\tVolume : \t300.0\n\nPocket 3 :\n\tName : x\n")
    (d / "p1_out/pockets").mkdir(parents=True)
    (d / "p1_out/pockets/pocket0_atm.pdb").write_text("\n".join([atom(1, " CA", "ALA", "A", 1, 0, 0, 0, 1), atom(2, " CB", "ALA", "A", 1, 0, 0, 0, 1), atom(3, " CA", "CYS", "A", 2, 0, 0, 0, 1), atom(4, " CA", "CYS", "B", 2, 0, 0, 0, 1), atom(5, " CA", "UNK", "B", 3, 0, 0, 0, 1)]))
    return d


def test_tables(spark, folder):
    hits = S.read_hits(spark, str(folder / "hits.tsv"))
    assert hits.first()["bits"] == 12.5 and hits.columns[-1] == "lddt" and hits.count() == 2
    assert [r["label"] for r in S.read_csv(spark, str(folder / "t.csv"), "entry string, label string").collect()] == ["2.7.7.10", "1.1.1.100"]
    assert {r["entry"]: r["sequence"] for r in S.read_fasta(spark, str(folder / "a.fasta")).collect()} == {"one": "KK", "two": "", "three": "GGGG"}
    assert {r["entry"] for r in S.present(spark, spark.createDataFrame([("h1",), ("empty",), ("gone",)], "entry string"), str(folder / "pdb")).collect()} == {"h1"}


def test_structures(spark, folder):
    r = S.read_structures(spark, str(folder / "pdb")).orderBy("i").collect()
    assert len(r) == 14 and [x["i"] for x in r] == list(range(14))
    assert r[3]["aa"] == "A" and r[3]["b"] == 53.0 and len(r[0]["bb"]) == 12
    every, standard = S.read_ca(spark, str(folder / "pdb")), S.read_ca(spark, str(folder / "pdb"), standard_only=True)
    assert every.count() == 17 and standard.count() == 15
    assert "".join(x["aa"] for x in standard.orderBy("i").collect()) == "A" * 14 + "G"
    assert S.read_atoms(spark, str(folder / "pdb")).count() == 57


def test_structure_features(spark, folder):
    out = U.structure_features(S.read_structures(spark, str(folder / "pdb")), S.read_atoms(spark, str(folder / "pdb"))).first()
    names = [c for c, _ in U.feature_columns()]
    v = dict(zip(names, out["features"], strict=True))
    assert len(names) == 100 and out["n_residues"] == 14
    assert v["ss_H_frac"] > 0.6 and v["ss_E_frac"] == 0 and abs(v["ss_H_frac"] + v["ss_L_frac"] - 1) < 1e-9
    assert out["ss_counts"]["H"] == round(v["ss_H_frac"] * 14)
    assert v["geom_mean_bfactor"] == pytest.approx(56.5) and v["aa_A_frac"] == 1 and v["aass_A_H"] == v["ss_H_frac"]
    ca = np.array([[2.28 * math.cos(math.radians(100 * i)), 2.28 * math.sin(math.radians(100 * i)), 1.5 * i] for i in range(14)])
    assert v["geom_radius_of_gyration"] == pytest.approx(np.sqrt(((ca - ca.mean(0)) ** 2).sum(1).mean()), abs=1e-3)
    assert v["geom_total_sasa"] > v["geom_mean_sasa"] > 0
    d = np.linalg.norm(ca[:, None] - ca[None], axis=-1)
    i, j = np.triu_indices(14, 2)
    assert v["contact_density"] == pytest.approx((d[i, j] < 8).sum() / 14)
    assert v["contact_radius_per_n"] == pytest.approx(d.max() / 14**0.5, abs=1e-3)


def test_surface(spark):
    one = U.accessible_surface(np.zeros((1, 3)), np.array([1.7]))
    assert one[0] == pytest.approx(4 * np.pi * 3.1**2)
    far = U.accessible_surface(np.array([[0, 0, 0], [100, 0, 0]], float), np.array([1.7, 1.7]))
    assert far.sum() == pytest.approx(2 * one[0])
    near = U.accessible_surface(np.array([[0, 0, 0], [3.1, 0, 0]], float), np.array([1.7, 1.7]))
    assert near[0] == pytest.approx(4 * np.pi * 3.1**2 * 0.75, rel=0.03)  # a cap of half the radius is hidden
    three = spark.createDataFrame([("e", i, [0.0] * 12) for i in range(3)], "entry string, i long, bb array<double>")
    assert [r["ss"] for r in U.secondary_structure(three).orderBy("i").collect()] == ["L", "L", "L"]


def test_pockets(spark, folder):
    pockets = S.read_pockets(spark, str(folder / "p1_info.txt"))
    rows = {r["pocket_no"]: r["props"] for r in pockets.collect()}
    assert rows == {1: {"Score": 0.5, "Volume": 100.0}, 2: {"Score": 0.25, "Volume": 300.0}}
    lining = S.read_linings(spark, str(folder / "p1_out/pockets/pocket0_atm.pdb"))
    assert {r["aa"]: r["frac"] for r in lining.collect()} == {"A": pytest.approx(1 / 3), "C": pytest.approx(2 / 3)}
    out = {r["entry"]: r["features"] for r in K.pocket_features(spark.createDataFrame([("p1",), ("none",)], "entry string"), pockets, lining).collect()}
    names = [c for c, _ in K.feature_columns(spark)]
    assert len(names) == 81 and set(out["none"]) == {0.0}
    v = dict(zip(names, out["p1"], strict=True))
    assert (v["pk1_score"], v["pk2_volume"], v["pk3_score"], v["n_pockets"], v["best_score"], v["best_volume"], v["mean_score"]) == (0.5, 300.0, 0.0, 2.0, 0.5, 300.0, 0.375)
    assert v["pk1_aa_C_frac"] == pytest.approx(2 / 3)


def test_letters(spark, folder):
    di = spark.createDataFrame([("h1", "DDDDDDDDDDDDAC")], "entry string, di string")
    r = P.with_letters(S.read_ca(spark, str(folder / "pdb"), standard_only=True), di, 10)
    assert r.count() == 14 and r.where("i = 13").first()["letter"] == "C"
    assert P.with_letters(S.read_ca(spark, str(folder / "pdb")), di, 15).count() == 0


def test_sinks(spark, tmp_path):
    v = spark.createDataFrame([("train", "e", "A", [1.0]), ("test", "f", "B", [2.0])], "split string, entry string, label string, features array<double>")
    S.write_vectors(v, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).where("split = 'test'").first()["entry"] == "f"
    S.write_csv(v.drop("features"), str(tmp_path / "c"))
    assert S.read_csv(spark, str(tmp_path / "c"), "split string, entry string, label string").count() == 2
    S.write_summary(v.select("entry", "label"), str(tmp_path / "s"), "Report")
    assert [r[0] for r in spark.read.text(str(tmp_path / "s")).collect()][0] == "Report"
    np.savez(tmp_path / "m.npz", X_train=np.eye(2, dtype=np.float32), y_train=np.array(["A", "B"]), entries_train=np.array(["e", "f"]))
    got = S.read_npz(spark, str(tmp_path / "m.npz")).orderBy("row_no").collect()
    assert [(r["split"], r["entry"], r["label"], r["features"]) for r in got] == [("train", "e", "A", [1.0, 0.0]), ("train", "f", "B", [0.0, 1.0])]


def test_matrix_files(spark, tmp_path):
    """Files of the sink hold their rows in order, and arrays of objects are read as text."""
    rows = [("train", 7 - i, f"e{7 - i}", None if i == 2 else f"L{i}", [float(i), 0.5]) for i in range(8)] + [("test", 3, "q", "A", [1.0, 2.0])]
    S.write_npz(spark.createDataFrame(rows, "split string, row_no long, entry string, label string, features array<double>"), str(tmp_path / "out"), 3)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.suffix == ".npz" and not p.name.startswith(".")) == ["test-00001.npz", "train-00000.npz", "train-00001.npz", "train-00002.npz"]
    one = np.load(tmp_path / "out/train-00001.npz")
    assert one["entries_train"].tolist() == ["e3", "e4", "e5"] and one["X_train"].tolist() == [[4.0, 0.5], [3.0, 0.5], [2.0, 0.5]]
    back = S.read_npz(spark, str(tmp_path / "out")).where("split = 'train'")
    assert sorted(r["entry"] for r in back.collect()) == [f"e{i}" for i in range(8)]
    (tmp_path / "objects").mkdir()
    np.savez(tmp_path / "objects/m.npz", X_test=np.eye(2), y_test=np.array(["A", "B"], object), entries_test=np.array(["e", "ü" * 40], object))
    got = S.read_npz(spark, str(tmp_path / "objects")).orderBy("row_no").collect()
    assert [(r["split"], r["entry"], r["label"], r["features"]) for r in got] == [("test", "e", "A", [1.0, 0.0]), ("test", "ü" * 40, "B", [0.0, 1.0])]


def test_copies_by_split(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(6):
        (tmp_path / f"in/e{n}.pdb").write_bytes(bytes([n]) * 1000)
    splits = spark.createDataFrame([(f"e{n}", "train" if n % 2 else "test") for n in range(8)], "entry string, split string")
    status = lambda df: {r["entry"]: r["status"] for r in df.collect()}
    first = status(S.copy_by_split(splits.where("entry < 'e2'"), str(tmp_path / "in"), str(tmp_path / "out")))
    assert first == {"e0": "copied", "e1": "copied"}
    (tmp_path / "out/train/e1.pdb").write_text("kept")
    assert status(S.copy_by_split(splits, str(tmp_path / "in"), str(tmp_path / "out"))) == {"e0": "exists", "e1": "exists", **{f"e{n}": "copied" for n in range(2, 6)}, "e6": "missing", "e7": "missing"}
    assert sorted(p.name for p in (tmp_path / "out/test").iterdir() if not p.name.startswith(".")) == ["e0.pdb", "e2.pdb", "e4.pdb"]
    assert (tmp_path / "out/test/e4.pdb").read_bytes() == bytes([4]) * 1000 and (tmp_path / "out/train/e1.pdb").read_text() == "kept"


def test_mapped(spark):
    def fetch(row):
        if row["id"] == "bad":
            raise ValueError("no")
        return {"id": row["id"], "status": "ok"}

    got = S.mapped(spark.createDataFrame([("a",), ("bad",), ("b",)], "id string"), fetch, "id string, status string", 2).collect()
    assert {(r["id"], r["status"]) for r in got} == {("a", "ok"), ("b", "ok"), ("bad", "error:ValueError")}
