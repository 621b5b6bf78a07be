"""Sources and sinks: tables, hit lists, FASTA, protein structures, pocket reports, matrices."""

from __future__ import annotations

import io
import pickle
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protolens.functions.sequence import stem
from protolens.schemas import HITS, HITS_SHORT, RESIDUES


def _letter(name: Column) -> Column:
    """One letter of a three-letter residue name, null for others."""
    return F.create_map(*[F.lit(x) for pair in RESIDUES.items() for x in pair])[name]


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``); only a
    session with a local master may use a temporary folder of its machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="protolens-")
    return f"{shared.rstrip('/')}/protolens-files/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: what is used again is not computed
    again, and a lost executor costs no more than what it was doing. ``release``: the shuffle files
    of the writing job go when it ends."""
    path, conf = scratch(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    if release:
        conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if release:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A table with a header; the schema is declared, so labels stay strings."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_hits(spark: SparkSession, path: str, short: bool = False) -> DataFrame:
    """A tab-separated hit list without header, of 8 columns or 6."""
    return spark.read.schema(HITS_SHORT if short else HITS).option("sep", "\t").csv(path)


def read_fasta(spark: SparkSession, path: str, upper: bool = True) -> DataFrame:
    """(entry, sequence): the id is the header's first token, wrapped lines are joined, blank
    lines skipped, of duplicate ids the last counts."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", "^>", "").alias("v"))
    body = F.regexp_replace(F.regexp_replace("v", r"^[^\n]*", ""), r"\s", "")
    rows = rows.where(F.trim("v") != "").select("n", F.regexp_extract("v", r"^[ \t]*([^\s]+)", 1).alias("entry"), (F.upper(body) if upper else body).alias("sequence"))
    return rows.groupBy("entry").agg(F.max_by("sequence", "n").alias("sequence"))


def write_fasta(rows: DataFrame, path: str, width: int = 60) -> None:
    """FASTA files of (entry, sequence), lines of ``width`` letters."""
    body = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    rows.select(F.concat(F.lit(">"), F.col("entry"), F.lit("\n"), body)).write.mode("overwrite").text(path)


def structure_files(spark: SparkSession, path: str) -> DataFrame:
    """(entry, value): whole structure files, named by their stem."""
    return spark.read.text(path, wholetext=True).select(stem(F.col("_metadata.file_name")).alias("entry"), "value")


def _atoms(files: DataFrame, records: tuple[str, ...] = ("ATOM",)) -> DataFrame:
    """Atom lines of the first model of each file, by fixed columns."""
    files = files.select("entry", F.element_at(F.split("value", r"\nENDMDL"), 1).alias("v"))
    lines = files.select("entry", F.posexplode(F.split("v", r"\r?\n")).alias("line", "l")).where(F.trim(F.substring("l", 1, 6)).isin(*records))
    cut = lambda a, n: F.trim(F.substring("l", a, n))
    number = lambda a, n: F.expr(f"try_cast(trim(substring(l, {a}, {n})) as double)")
    return lines.select("entry", "line", cut(13, 4).alias("atom"), cut(17, 1).alias("alt"), cut(18, 3).alias("name"), cut(22, 1).alias("chain"), cut(23, 5).alias("num"), number(31, 8).alias("x"), number(39, 8).alias("y"), number(47, 8).alias("z"), number(61, 6).alias("b"), cut(77, 2).alias("element"))


def _numbered(residues: DataFrame) -> DataFrame:
    """Residues counted from 0 in file order: proteins are sorted arrays, not windows."""
    own = [c for c in residues.columns if c not in ("entry", "line")]
    lists = residues.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("line", *own))).alias("r"))
    return lists.select("entry", F.posexplode("r").alias("i", "r")).select("entry", F.col("i").cast("long").alias("i"), *[F.col(f"r.{c}").alias(c) for c in own])


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """``parse_structures`` of the files at a path."""
    return parse_structures(structure_files(spark, path))


def parse_structures(files: DataFrame) -> DataFrame:
    """(entry, i, aa, x, y, z, b, bb): standard residues that have all of N, CA, C and O; place
    and confidence of CA, ``bb`` the 12 backbone coordinates."""
    a = _atoms(files).where(F.col("name").isin(*RESIDUES) & F.col("atom").isin("N", "CA", "C", "O"))
    at = lambda n, c: F.min_by(c, F.when(F.col("atom") == n, F.col("line")))
    r = a.groupBy("entry", "chain", "num", "name").agg(F.min("line").alias("line"), F.count_distinct("atom").alias("k"), *[at("CA", c).alias(c) for c in ("x", "y", "z", "b")], F.array(*[at(n, c) for n in ("N", "CA", "C", "O") for c in ("x", "y", "z")]).alias("bb"))
    return _numbered(r.where("k = 4").select("entry", "line", _letter(F.col("name")).alias("aa"), "x", "y", "z", "b", "bb"))


def read_ca(spark: SparkSession, path: str, standard_only: bool = False) -> DataFrame:
    """``parse_ca`` of the files at a path."""
    return parse_ca(structure_files(spark, path), standard_only)


def parse_ca(files: DataFrame, standard_only: bool = False) -> DataFrame:
    """(entry, i, aa, x, y, z, b) of every residue with a CA, or of the standard ones."""
    a = _atoms(files, ("ATOM",) if standard_only else ("ATOM", "HETATM")).where("atom = 'CA'")
    if standard_only:
        a = a.where(F.col("name").isin(*RESIDUES))
    first = a.groupBy("entry", "chain", "num", "name").agg(F.min("line").alias("line"), *[F.min_by(c, "line").alias(c) for c in ("x", "y", "z", "b")])
    return _numbered(first.select("entry", "line", F.coalesce(_letter(F.col("name")), F.lit("X")).alias("aa"), "x", "y", "z", "b"))


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    """``parse_surface_atoms`` of the files at a path."""
    return parse_surface_atoms(structure_files(spark, path))


def parse_surface_atoms(files: DataFrame) -> DataFrame:
    """(entry, res, element, x, y, z) of standard residues, for surfaces."""
    a = _atoms(files).where(F.col("name").isin(*RESIDUES))
    element = F.when(F.col("element") != "", F.col("element")).otherwise(F.substring(F.regexp_replace("atom", "[0-9]", ""), 1, 1))
    return a.select("entry", F.concat_ws(":", "chain", "num", "name").alias("res"), element.alias("element"), "x", "y", "z")


def parse_pockets(reports: DataFrame, text: str = "value") -> DataFrame:
    """(entry, pocket_no, props): the blocks of a report in order; values that are no numbers
    and blocks without any are dropped."""
    blocks = reports.select("entry", F.posexplode(F.filter(F.split(text, r"\nPocket \d+ :\n"), lambda b: F.trim(b) != "")).alias("at", "b"))
    lines = F.filter(F.split("b", "\n"), lambda l: F.contains(l, F.lit(":")))
    pairs = F.transform(lines, lambda l: F.struct(F.trim(F.regexp_extract(l, r"^\s*([^:]*):", 1)).alias("key"), F.trim(F.regexp_extract(l, r"^[^:]*:\s*(.*?)\s*$", 1)).try_cast("double").alias("value")))
    blocks = blocks.select("entry", "at", F.filter(pairs, lambda p: p["value"].isNotNull()).alias("p")).where(F.size("p") > 0)
    last = F.map_from_entries(F.filter("p", lambda p, i: ~F.exists(F.slice("p", i + 2, F.size("p")), lambda q: q["key"] == p["key"])))
    lists = blocks.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("at", "p"))).alias("r"))
    each = lists.select("entry", F.posexplode("r").alias("n", "r")).select("entry", "n", F.col("r.p").alias("p"))
    return each.select("entry", (F.col("n") + 1).alias("pocket_no"), last.alias("props"))


def read_pockets(spark: SparkSession, path: str) -> DataFrame:
    """Pocket reports ``<entry>_info.txt``."""
    files = spark.read.text(path, wholetext=True)
    return parse_pockets(files.select(F.regexp_replace(F.col("_metadata.file_name"), r"_info\.txt$", "").alias("entry"), "value"))


def lining_composition(lines: DataFrame) -> DataFrame:
    """(entry, aa, frac): shares of the distinct residues of a pocket's atom lines (entry, value)."""
    cut = lambda a, n: F.trim(F.substring("value", a, n))
    r = lines.where(F.startswith("value", F.lit("ATOM"))).select("entry", cut(22, 1).alias("chain"), cut(23, 4).alias("num"), _letter(cut(18, 3)).alias("aa")).where("aa is not null").distinct()
    total = r.groupBy("entry").agg(F.count("*").alias("t"))
    return r.groupBy("entry", "aa").agg(F.count("*").alias("n")).join(total, "entry").select("entry", "aa", (F.col("n") / F.col("t")).alias("frac"))


def read_linings(spark: SparkSession, path: str) -> DataFrame:
    """Linings of top pockets at ``<entry>_out/pockets/<file>``."""
    files = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_out/pockets/[^/]+$", 1).alias("entry"), "value")
    return lining_composition(files)


def present(spark: SparkSession, entries: DataFrame, path: str) -> DataFrame:
    """Entries that have a non-empty file under ``path``; only the listing is read."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(stem(F.col("path")).alias("entry"))
    return entries.join(files, "entry", "left_semi")


def mapped(df: DataFrame, make, schema: str, parts: int) -> DataFrame:
    """A function of one row's dict over all rows, ``parts`` at a time; order is not kept.

    For calls that leave the cluster; an error becomes the row's status."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    out.append(make(row))
                except Exception as e:
                    out.append(row | {"status": f"error:{type(e).__name__}"})
            yield pd.DataFrame(out, columns=names)

    return df.repartition(parts).mapInPandas(over, schema)


class _Strings(pickle.Unpickler):
    """Unpickles arrays of plain values and nothing else, so that a file cannot run code."""

    def find_class(self, module: str, name: str):
        known = {"numpy.core.multiarray": "numpy._core.multiarray", "numpy._core.multiarray": "numpy._core.multiarray", "numpy": "numpy"}
        if (known.get(module), name) not in {("numpy._core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "scalar"), ("numpy", "ndarray"), ("numpy", "dtype")}:
            raise pickle.UnpicklingError(f"{module}.{name} is not allowed in a matrix file")
        return super().find_class(known[module], name)


def _array(z: np.lib.npyio.NpzFile, name: str) -> np.ndarray:
    """One array of a matrix file, of plain values or of objects that are plain values."""
    with z.zip.open(f"{name}.npy") as f:
        version = np.lib.format.read_magic(f)
        header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        kind = header(f)[2]
        if kind.hasobject:
            return _Strings(io.BytesIO(f.read())).load()
    return z[name]


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """(split, row_no, entry, label, features) of matrix files with X_, y_ and entries_ arrays of
    each split. Each file is read where its bytes are; arrays of objects may hold plain values."""

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for content in pdf["content"]:
                z = np.load(io.BytesIO(content), allow_pickle=False)
                for split in ("train", "test"):
                    if f"X_{split}" in z:
                        x, y, e = (_array(z, f"{c}_{split}") for c in ("X", "y", "entries"))
                        yield pd.DataFrame({"split": split, "row_no": np.arange(len(e)), "entry": e.astype(str), "label": y.astype(str), "features": [r.astype(float) for r in x]})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(over, "split string, row_no long, entry string, label string, features array<double>")


class _Sink(io.RawIOBase):
    """A stream that a zip file can be written to without going back."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)


def write_npz(vectors: DataFrame, path: str, rows: int = 50_000) -> None:
    """Matrix files ``<split>-<number>.npz`` of (split, row_no, entry, label, features), of about
    ``rows`` rows each, in order of row_no. Executors write them to ``path`` under a name of the
    attempt; the driver, which sees names only, gives them theirs when all are written."""
    place, files = (path[5:] if path.startswith("file:") else path).rstrip("/"), vectors.sparkSession.sparkContext

    def made(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        split, n = key
        own = pdf.sort_values("row_no")
        arrays = {"X": np.array(own["features"].tolist(), np.float32), "y": own["label"].to_numpy(str), "entries": own["entry"].to_numpy(str)}
        name = f"{split}-{n:05d}.npz"
        attempt = f".{name}.{uuid.uuid4().hex}"
        system, folder = pafs.FileSystem.from_uri(place)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{attempt}") as out:
            np.savez_compressed(_Sink(out), **{f"{k}_{split}": v for k, v in arrays.items()})
        return pd.DataFrame({"name": [name], "attempt": [attempt]})

    part = F.floor(F.col("row_no") / rows).cast("long")
    made_files = kept(vectors.groupBy("split", part).applyInPandas(made, "name string, attempt string"), "npz-names")
    conf = files._jsc.hadoopConfiguration()
    for file in made_files.toLocalIterator():
        source, target = (files._jvm.org.apache.hadoop.fs.Path(place, file[c]) for c in ("attempt", "name"))
        system = source.getFileSystem(conf)
        system.delete(target, False)
        if not system.rename(source, target):
            raise OSError(f"{source} was not renamed")


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors as Parquet, one folder for each split."""
    vectors.write.mode("overwrite").partitionBy("split").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_by_split(df: DataFrame, path: str) -> None:
    """Files of a table split into folders."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def copy_by_split(splits: DataFrame, source: str, target: str) -> DataFrame:
    """Copies the file of each entry (entry, split) to the folder of its split; (entry, split,
    status) with ``copied``, ``exists`` and ``missing``.

    Executors copy, each file under a name of the attempt that is changed at the end; files that
    are there are left alone, so that a run that is cut off is run again. File names without
    their ending are unique in ``source``.
    """
    spark = splits.sparkSession
    place = (target[5:] if target.startswith("file:") else target).rstrip("/")

    def copied(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder = pafs.FileSystem.from_uri(place)
        for pdf in frames:
            done = []
            for split, path, content in zip(pdf["split"], pdf["path"], pdf["content"], strict=True):
                own = f"{folder}/{split}/{path.rsplit('/', 1)[-1]}"
                if system.get_file_info(own).type == pafs.FileType.File:
                    done.append("exists")
                    continue
                system.create_dir(f"{folder}/{split}", recursive=True)
                attempt = f"{folder}/{split}/.{uuid.uuid4().hex}"
                with system.open_output_stream(attempt) as out:
                    out.write(content)
                system.move(attempt, own)
                done.append("copied")
            yield pd.DataFrame({"entry": pdf["entry"], "status": done})

    files = spark.read.format("binaryFile").load(source).select(stem(F.col("path")).alias("entry"), "path", "content")
    found = files.join(splits.select("entry", "split"), "entry").mapInPandas(copied, "entry string, status string")
    found = kept(found, "copies")
    return splits.select("entry", "split").join(found, "entry", "left").select("entry", "split", F.coalesce("status", F.lit("missing")).alias("status"))


def write_summary(rows: DataFrame, path: str, title: str, limit: int = 1000) -> None:
    """A text report of a small table, one file; at most ``limit`` rows."""
    line = F.concat_ws("  ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in rows.columns])
    head = rows.sparkSession.createDataFrame([(0, title)], "n long, value string")
    body = rows.limit(limit).select((F.monotonically_increasing_id() + 1).alias("n"), line.alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)
