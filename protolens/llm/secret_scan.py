"""Secret scans: base patterns, and character Markov models for everything else.

Two bigram models, one of random strings and one of ordinary identifiers, are trained from
labelled samples; a candidate token is a secret if its log-likelihood ratio, in total and
per character, passes a threshold. Candidates are runs of 20 or more characters of TOKEN that
no base span touches, in one case or in several. All of it is DataFrame expressions: the samples are made
and counted by Spark, the trained table (one ratio for each pair of symbols of a fixed
alphabet, about 4,600 numbers) is a literal in the scan, which reads every text once and
shuffles nothing.

Results for odd input: a null text is empty and has no spans; a null id is kept; repeated
rows are scanned alike; empty tables give no rows; other columns are ignored. Offsets are
code points, ends exclusive.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from protolens.llm._util import table, text_of

#: Kinds and patterns of the base, with the least length of a match or its value.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE, ACCESS_LEAST = 6, 20
#: Candidates of the models.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: A secret's ratio passes both: nats in all, nats for each character.
TOTAL, EACH = 12.0, 0.5
SAMPLES = 4000
#: Parts of ordinary identifiers.
PARTS = """account action active add address admin after alert align all alpha amount and angle api app apply area array
asset async auth author auto back background badge balance bar base batch before begin between bind bit block body book
border bottom box branch break bridge buffer build button byte cache call cancel card case cell center chain change
channel char check child class clean clear click client clock clone close cloud code collect color column command
comment commit common compare complete compress config connect console const container content context control copy
core cost count country create credit current cursor custom data date day debug decode default delete delta depth
description design detail device dialog digest direct disable display document domain double download draft draw drive
drop edge edit element email empty enable encode end endpoint engine entry error event exception execute exit expand
export extend factory fail false feature fetch field file filter final find first flag float flow focus folder font for
form format forward frame free from front function future gateway general generate get global grid group guard handle
handler hash head header height help hidden history hook host icon identity image import in include index info init
input insert instance int integer internal interval item iterator join json keep key label language last layer layout
leader left length level library light limit line link list listen load local location lock log login long loop machine
main make manager map mark master match matrix max measure member memory menu merge message meta method min mobile mode
model module monitor month mouse move multi name native network new next node normal not notification null number
object observer offset old on open operation option order origin output owner package page panel parent parse part
password patch path pattern payment pending percent permission phone picture pixel place plan player plugin point policy
pool port position post prefix prepare press price primary print private process product profile program progress
project promise property protocol provider public publish pull push query queue quick random range rate raw read ready
real receive record reduce ref refresh region register release remote remove render replace report request require
reset resize resource response rest result retry return reverse right role root round route row rule run sample save
scale scan schedule schema scope score screen script scroll search second section secret security select send sequence
series server service session set setting setup shadow shape share shell shift short show side sign signal simple size
skip sleep slice slot small snapshot socket sort sound source space spec speed split stack stage standard start state
static station status step stop storage store stream string strip style submit success suffix sum support switch symbol
sync system tab table tag target task team temp template test text theme thread threshold time title to toggle token
tool top total touch track transaction transfer transform tree trigger true type under unit update upload upper url use
user util valid value variable vector verify version vertical video view virtual visible visit wait walk warning watch
web week weight wheel width window with word work worker wrap write year zone""".split()


def _spans(kind: str, text: Column, pattern: str, value: int = 0) -> Column:
    """All leftmost non-overlapping matches as (start, kind, end, match, value).

    Offsets are running sums, taken in chunks of about the root of the number of matches: an
    array that grows by one is copied each time, so a single one would cost the square.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value)) if value else found
    gaps = F.split(text, pattern, -1)
    parts = F.arrays_zip(F.transform(F.slice(gaps, 1, F.size(found)), F.length).alias("gap"), found.alias("m"), values.alias("v"))
    span = "struct<start:int,k:int,kind:string,end:int,m:string,v:string>"
    empty, none = F.array().cast(f"array<{span}>"), F.array().cast(f"array<array<{span}>>")
    order = ["assign", "access", "hex", "markov"].index(kind)

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.length(p["m"])
        one = F.struct(start.alias("start"), F.lit(order).alias("k"), F.lit(kind).alias("kind"), end.alias("end"), p["m"].alias("m"), p["v"].alias("v"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    each = F.ceil(F.sqrt(F.size(found))).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / each).cast("int")), lambda i: F.slice(parts, i * each + 1, each))
    inner = lambda at, chunk: F.aggregate(chunk, F.struct(at.alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])
    ahead = lambda at, chunk: F.aggregate(chunk, at, lambda n, p: n + p["gap"] + F.length(p["m"]))
    outer = lambda acc, chunk: F.struct(ahead(acc["at"], chunk).alias("at"), F.concat(acc["all"], F.array(inner(acc["at"], chunk))).alias("all"))
    spans = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), none.alias("all")), outer, lambda acc: F.flatten(acc["all"]))
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(empty)


def labelled_samples(spark: SparkSession, n: int = SAMPLES, first: int = 0) -> DataFrame:
    """(text, secret): ``n`` random strings of common shapes, ``n`` ordinary identifiers, numbered
    from ``first``; other numbers make other samples."""
    hashed = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 512)
    b64 = F.base64(F.unhex(hashed))
    shapes = [F.substring(b64, 1, 40), F.substring(hashed, 1, 40), F.substring(F.translate(b64, "+/=", "-_"), 1, 44), F.upper(F.substring(F.regexp_replace(b64, "[^A-Za-z0-9]", ""), 1, 32)), F.substring(F.regexp_replace(b64, "[^A-Za-z0-9]", ""), 1, 36), F.lower(F.substring(F.regexp_replace(b64, "[^A-Za-z]", ""), 1, 40)), F.upper(F.substring(F.regexp_replace(b64, "[^A-Za-z]", ""), 1, 40))]
    shape = F.pmod(F.col("id"), F.lit(len(shapes)))
    secret = shapes[-1]
    for i, s in enumerate(shapes[:-1]):
        secret = F.when(shape == i, s).otherwise(secret)
    random = spark.range(first, first + n).select(secret.alias("text"), F.lit(1).alias("secret"))
    parts = F.split(F.lit(" ".join(PARTS)), " ")
    pick = lambda i: F.element_at(parts, F.pmod(F.hash(F.col("id"), F.lit(i)), F.lit(len(PARTS))) + 1)
    w = [pick(i) for i in range(5)]
    title = [F.initcap(x) for x in w]
    shapes = [F.concat_ws("_", *w), F.concat_ws("-", *w[:4]), F.concat_ws("", w[0], *title[1:4]), F.concat_ws("", *title), F.upper(F.concat_ws("_", *w[:4])), F.concat_ws("/", *w), F.concat_ws("", *w[:4]), F.concat(F.concat_ws("_", *w[:3]), F.lit("_"), F.pmod(F.hash("id"), F.lit(2100)).cast("string"))]
    shape = F.pmod(F.col("id"), F.lit(len(shapes)))
    plain = shapes[-1]
    for i, s in enumerate(shapes[:-1]):
        plain = F.when(shape == i, s).otherwise(plain)
    return random.unionByName(spark.range(first, first + n).select(plain.alias("text"), F.lit(0).alias("secret")))


def train(samples: DataFrame) -> list[float]:
    """Log ratios log P(b | a, random) - log P(b | a, ordinary), at a * size + b; add-half
    smoothing. Symbols are counted by Spark, at most two counts for each pair come back."""
    size = len(ALPHABET)
    pairs = samples.where(F.length("text") > 1).select("secret", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.col("text").substr(i, F.lit(2)))).alias("pair"))
    pairs = pairs.select("secret", F.instr(F.lit(ALPHABET), F.substring("pair", 1, 1)).alias("a"), F.instr(F.lit(ALPHABET), F.substring("pair", 2, 1)).alias("b")).where("a > 0 and b > 0")
    counts = [[[0.5] * size for _ in range(size)] for _ in range(2)]
    for r in pairs.groupBy("secret", "a", "b").count().collect():
        counts[r["secret"]][r["a"] - 1][r["b"] - 1] += r["count"]
    rows = [[[math.log(x / sum(row)) for x in row] for row in model] for model in counts]
    return [rows[1][a][b] - rows[0][a][b] for a in range(size) for b in range(size)]


def ratio(token: Column, table_: list[float]) -> Column:
    """The log-likelihood ratio of a token of the alphabet."""
    size = len(ALPHABET)
    rates = F.from_json(F.lit(json.dumps([round(x, 6) for x in table_])), "array<double>")
    symbols = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    step = lambda acc, s: F.struct(
        s.alias("a"), (acc["r"] + F.when((acc["a"] > 0) & (s > 0), F.element_at(rates, (acc["a"] - 1) * size + s)).otherwise(F.lit(0.0))).alias("r"))
    return F.aggregate(symbols, F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("r")), step, lambda acc: acc["r"])


def scan(docs: DataFrame, model: list[float], total: float = TOTAL, each: float = EACH, id_col: str = "doc_id") -> DataFrame:
    """(id, spans): array of (start, k, kind, end, m, v) by start, then kind; ``m`` is the match."""
    text = text_of()
    base = docs.select(F.col(id_col), text.alias("text"))
    base = base.withColumns({
        "assign": F.filter(_spans("assign", F.col("text"), ASSIGN, 2), lambda s: F.length(s["v"]) >= ASSIGN_VALUE),
        "access": F.filter(_spans("access", F.col("text"), ACCESS), lambda s: F.length(s["m"]) >= ACCESS_LEAST),
        "hex": _spans("hex", F.col("text"), HEX),
        "token": _spans("markov", F.col("text"), TOKEN),
    })
    base = base.withColumn("base", F.concat("assign", "access", "hex"))
    free = F.filter("token", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    odd = F.filter(free, lambda s: ratio(s["m"], model) >= F.greatest(F.lit(total), F.lit(each) * F.length(s["m"])))
    return base.select(id_col, F.array_sort(F.concat("base", odd)).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(labelled_samples(spark))
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
