"""URL filters: rules first, then empirical-Bayes reputation of the host.

Labelled page outcomes are counted for each host. A host's rate of bad pages is shrunk to
that of its registered domain, the domain's to that of its suffix, the suffix's to the rate
of all, each through a beta-binomial prior whose weight comes from the spread of the rates
at that level (method of moments). A host is blocked if the lower bound of its posterior
rate passes a threshold, so hosts with few outcomes are left alone.

Suffixes come from ``suffix_rules``, written as in the public suffix list (``co.uk``, ``*.ck``,
``!www.ck``; data of the caller); without them a suffix is the last label, and two labels
under a country for those in SECOND_LEVEL.

Everything is counted per host before it is joined with the pages; the tables that meet the
pages have one row for each host and are broadcast only when counted small.

Results for odd input: a null url, or one without ``://``, has empty host and path, fits no
rule and is allowed unless outcomes of such urls are bad; outcomes of unknown pages, null
labels and null ids are ignored; repeated rows are judged alike; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from protolens.llm._util import bounded, stage, table

#: Rules of the query, as (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Second-level labels that belong to the suffix under a two-letter country.
SECOND_LEVEL = ["co", "com", "org", "net", "ac", "gov", "edu"]
#: The bound is mean - Z * deviation; a host is blocked above THRESHOLD.
Z, THRESHOLD = 1.645, 0.5
#: Limits of a prior's weight in pages.
LEAST, MOST = 1.0, 500.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url, both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def suffixes(host: Column, deepest: int) -> Column:
    """A host and the domains above it, of at most ``deepest`` labels."""
    n = F.size(F.split(host, r"\."))
    return F.transform(F.sequence(F.lit(1), F.least(n, F.lit(deepest))), lambda i: F.array_join(F.slice(F.split(host, r"\."), n - i + 1, i), "."))


def _tail(parts: Column, k: Column) -> Column:
    n = F.size(parts)
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), n - k + 1), F.least(n, k)), ".")


def _labels(host: Column) -> Column:
    return F.split(F.regexp_replace(host, r":[0-9]*$", ""), r"\.")


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    parts = _labels(host)
    n = F.size(parts)
    deep = (n > 2) & (F.length(F.element_at(parts, -1)) == 2) & F.element_at(parts, F.when(n > 1, -2).otherwise(-1)).isin(SECOND_LEVEL)
    k = F.when(deep, 2).otherwise(1)
    return _tail(parts, k + 1), _tail(parts, k)


def by_suffix_rules(hosts: DataFrame, suffix_rules: list[str]) -> DataFrame:
    """``hosts`` with domain and suffix by rules: an exception wins, else the longest, else ``*``."""
    spark = hosts.sparkSession
    table_ = [(r.lstrip("!").lower(), r.count(".") + (0 if r.startswith("!") else 1), r.startswith("!")) for r in suffix_rules]
    rules = spark.createDataFrame(table_, "rule string, labels int, exception boolean")
    deepest = max([1, *(r[0].count(".") + 1 for r in table_)])
    own = hosts.select("host", suffixes(F.regexp_replace("host", r":[0-9]*$", ""), deepest).alias("ends"))
    tips = own.select("host", F.explode("ends").alias("tip"))
    forms = tips.select("host", F.explode(F.array("tip", F.regexp_replace("tip", r"^[^.]*", "*"))).alias("rule"))
    fits = forms.join(bounded(rules, len(table_)), "rule").groupBy("host").agg(F.max(F.struct("exception", "labels"))["labels"].alias("k"))
    parts, k = _labels(F.col("host")), F.coalesce("k", F.lit(1))
    return hosts.join(fits, "host", "left").withColumns({"domain": _tail(parts, k + 1), "suffix": _tail(parts, k)}).drop("k")


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """For each host the rules that fit it or a domain above it, longest first."""
    deepest = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 1
    up = hosts.select("host", F.explode(suffixes(F.col("host"), deepest)).alias("over"))
    fits = up.join(bounded(rules), up["over"] == rules["rule_host"]).select("host", F.struct(F.length("rule").alias("n"), "rule", "rule_path", "rule_verdict").alias("r"))
    return fits.groupBy("host").agg(F.sort_array(F.collect_set("r"), asc=False).alias("rules"))


def _level(t: DataFrame, rate: str) -> tuple[DataFrame, float]:
    """Weight of the prior at one level, from (n, bad, parent's rate); the driver gets one row."""
    p = F.col(rate)
    spread = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - p, 2)) / F.sum("n")
    noise, base = F.sum(p * (1 - p)) / F.sum("n"), F.sum(F.col("n") * p * (1 - p)) / F.sum("n")
    row = t.where("n > 0").agg(spread.alias("s"), noise.alias("e"), base.alias("b")).first()
    if row is None or row["b"] is None or row["b"] <= 0:
        return t, MOST
    rho = max(0.0, (row["s"] - row["e"]) / row["b"])
    return t, MOST if rho <= 0 else min(MOST, max(LEAST, (1 - rho) / rho))


def reputation(hosts: DataFrame, suffix_rules: list[str] | None = None) -> DataFrame:
    """(host, mean, bound) from (host, n, bad); hosts without outcomes get their domain's rate."""
    domain, suffix = domain_and_suffix(F.col("host"))
    h = hosts.withColumns({"domain": domain, "suffix": suffix}) if suffix_rules is None else stage(by_suffix_rules(hosts, suffix_rules), "host-domains")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    d = h.groupBy("domain", "suffix").agg(*sums)
    s = stage(d.groupBy("suffix").agg(*sums), "suffixes")
    total = s.agg(*sums).first()
    p0 = ((total["bad"] or 0) + 1.0) / ((total["n"] or 0) + 2.0)
    post = lambda rate, k: (F.col("bad") + F.lit(k) * F.col(rate)) / (F.col("n") + F.lit(k))
    s = s.withColumn("p0", F.lit(p0))
    s, k = _level(s, "p0")
    s = s.select("suffix", post("p0", k).alias("p_suffix"))
    d = stage(d.join(s, "suffix"), "domains")
    d, k = _level(d, "p_suffix")
    d = d.select("domain", "suffix", post("p_suffix", k).alias("p_domain"))
    h = stage(h.join(d, ["domain", "suffix"]), "hosts")
    h, k = _level(h, "p_domain")
    h = h.withColumn("mean", post("p_domain", k))
    return h.select("host", "mean", (F.col("mean") - F.lit(Z) * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.lit(k + 1)))).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: DataFrame, threshold: float = THRESHOLD, suffix_rules: list[str] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, mean, bound) for each row of ``pages``.

    ``outcomes`` has (page_id, bad), ``rules`` (rule_host, rule_path, rule, rule_verdict).
    """
    host, path = split_url(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    seen = p.join(known, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = stage(seen, "host-counts")
    about = stage(reputation(hosts, suffix_rules).join(host_rules(hosts.select("host"), rules), "host", "left"), "host-verdicts")
    out = p.join(bounded(about), "host", "left")
    out = out.withColumn("r", F.when(F.col("rules").isNotNull() & (F.size("rules") > 0), F.try_element_at(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(1))))
    by_host = F.when(F.col("bound") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.rule_verdict"), by_host).alias("verdict"), "mean", "bound")


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([(h, p, h + p, v) for h, p, v in rules], "rule_host string, rule_path string, rule string, rule_verdict string")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the quality labels under the page's id: quality 0 is a bad page."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    out = judge(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes, rule_table(spark))
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("mean", 6).alias("mean"), F.round("bound", 6).alias("bound"))


def _weight_sql(source: str, rate: str) -> str:
    """The weight of the prior at one level, as _level finds it."""
    return f"""(SELECT CASE WHEN b IS NULL OR b <= 0 OR s - e <= 0 THEN {MOST} ELSE least({MOST}, greatest({LEAST}, (1 - (s - e) / b) / ((s - e) / b))) END::DOUBLE AS k FROM (
      SELECT sum(n * pow(bad::DOUBLE / n - {rate}, 2)) / sum(n) AS s, sum({rate} * (1 - {rate})) / sum(n) AS e, sum(n * {rate} * (1 - {rate})) / sum(n) AS b FROM {source} WHERE n > 0))"""


_TAIL = "array_to_string(list_slice(parts, greatest(1, len(parts) - {0} + 1), len(parts)), '.')"
OP7_SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), known AS (
  SELECT doc_id AS page_id, max((quality = 0)::INT) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1
), h0 AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS parts FROM p LEFT JOIN known USING (page_id) GROUP BY host
), h1 AS (
  SELECT *, CASE WHEN len(parts) > 2 AND length(parts[-1]) = 2 AND parts[-2] IN ({', '.join(f"'{x}'" for x in SECOND_LEVEL)}) THEN 2 ELSE 1 END AS deep FROM h0
), h AS (
  SELECT host, n, bad, {_TAIL.format('(deep + 1)')} AS domain, {_TAIL.format('deep')} AS suffix FROM h1
), s AS (
  SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad, (sum(sum(bad)) OVER () + 1.0::DOUBLE) / (sum(sum(n)) OVER () + 2.0::DOUBLE) AS p0 FROM h GROUP BY suffix
), ps AS (
  SELECT suffix, (bad + k * p0) / (n + k) AS p_suffix FROM s, {_weight_sql('s', 'p0')}
), d AS (
  SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad, any_value(p_suffix) AS p_suffix FROM h JOIN ps USING (suffix) GROUP BY domain, suffix
), pd AS (
  SELECT domain, suffix, (bad + k * p_suffix) / (n + k) AS p_domain FROM d, {_weight_sql('d', 'p_suffix')}
), hp AS (
  SELECT h.*, p_domain FROM h JOIN pd USING (domain, suffix)
), b AS (
  SELECT host, m AS mean, m - {Z} * sqrt(m * (1 - m) / (n + k + 1)) AS bound FROM (SELECT host, n, k, (bad + k * p_domain) / (n + k) AS m FROM hp, {_weight_sql('hp', 'p_domain')})
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES {', '.join(f"('{a}', '{b}', '{v}')" for a, b, v in RULES)}
), best AS (
  SELECT host, path, first(rule_host || rule_path ORDER BY length(rule_host || rule_path) DESC) AS rule, first(rule_verdict ORDER BY length(rule_host || rule_path) DESC) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path
)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, CASE WHEN bound > {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict, round(mean, 6) AS mean, round(bound, 6) AS bound
FROM p LEFT JOIN b USING (host) LEFT JOIN best ON best.host = p.host AND best.path = p.path
"""
