"""The registry, and queries against their oracle SQL on the driver's smallest tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DIR = entry.SMOKE_DIR
SQL = {name: sql for plan in entry.PLANS for name, sql in plan.ORACLES.items()}
SLOW = {"ablation", "ablation_pivot"}


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(values):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in values), key=str)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(SQL) > 60


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_oracle(spark, tables, name):
    df = entry.queries()[name](spark, DIR)
    names = sorted(df.columns)
    want = tables.sql(SQL[name])
    assert sorted(want.columns) == names
    assert rows(map(tuple, df.select(*names).collect())) == rows(want.project(", ".join(f'"{n}"' for n in names)).fetchall())


def test_whole_texts(spark):
    """clean_letters and model_inputs take whole texts."""
    letters = {r["doc_id"]: r["letters"] for r in entry.queries()["clean_letters"](spark, DIR).collect()}
    inputs = entry.queries()["model_inputs"](spark, DIR).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert max(map(len, letters.values())) > 1024
    for r in inputs:
        own = [c for c in texts[r["doc_id"]] if c.isascii() and c.isalpha()]
        assert r["di"].split() == ["<fold2AA>", *"".join(own).lower()]
        assert len(letters[r["doc_id"]] or "") >= len(own)


def test_entry(spark):
    assert entry.entry(spark).columns == ["weighted_f1", "n_predicted", "n_none"]


def test_library_stands_alone():
    """Without the optional part everything else imports and has its queries."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.split(".")[:2] == ["protolens", "llm"]:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 60 and not [q for q in e.queries() if q.startswith("op")]
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(entry.__file__).parent)


def test_nothing_else_imports_the_optional_part():
    root = Path(entry.__file__).parent / "protolens"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "protolens.llm" not in p.read_text()


def test_small_files_are_dealt_to_all_cores(spark, tmp_path):
    """A file of one row group is one partition with rows, whatever the splits; a union of two
    such tables is dealt too, a table of many files stays."""
    from protolens.plans.data import spread

    spark.range(4000).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(4000).repartition(16).write.parquet(str(tmp_path / "many"))
    one, many = spark.read.parquet(str(tmp_path / "one")), spark.read.parquet(str(tmp_path / "many"))
    sizes = lambda df: [n for n in df.rdd.glom().map(len).collect() if n]
    for df in (one, one.unionByName(one)):
        assert len(sizes(spread(df))) >= 4 and max(sizes(spread(df))) < 0.5 * df.count()
    assert spread(many) is many
