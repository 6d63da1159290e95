"""URL filters by hashed host-suffix and path-prefix expressions.

Each URL is expanded to the (host suffix, path prefix) pairs of the shapes that
occur in the rules. The expressions meet the rules on the first 4 bytes of
their SHA-256, the full digests confirm, and the longest confirmed rule wins.

The work is done once for each distinct (host, path): however many pages share
a URL, they are one row of the join. Rules are broadcast only where Spark finds
them below its broadcast threshold; otherwise each goes to ``PLACES`` places,
among which the URLs of its expression are dealt, as a rule for a top domain has
a large share of all URLs.

Defined cases: a null URL, or one without ``://``, has an empty host and path,
fits no rule and gets the default verdict. Repeated pages each get their row.
Rules without a host never fit; a null path is an empty one. Of equal rules
with both verdicts, block wins. Without rules every URL gets the default.
A very long URL is cut where it is read. Columns beside the URL are carried; ``host``, ``path``, ``rule`` and
``verdict`` of the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from curbside.llm.words import lower_ascii, whole
from curbside.skew import spread_join

#: Columns of the result that take the place of the input's.
ADDED = ("host", "path", "rule", "verdict")
RULE_SCHEMA = "host string, path string, verdict string"
#: Places that the URLs of one expression are dealt to.
PLACES = 16


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.when(F.instr(whole(url), "://") > 0, F.regexp_extract(whole(url), r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return lower_ascii(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to the pages."""
    rules = rules.filter("host IS NOT NULL AND host <> ''").select(
        lower_ascii(F.col("host")).alias("r_host"), whole(F.col("path")).alias("r_path"), F.col("verdict").alias("r_verdict")
    )
    # Bounded by the lengths of host names and paths, not by the number of rules.
    shape = rules.agg(
        F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels"), F.collect_set(F.char_length("r_path")).alias("lengths")
    ).first()
    table = rules.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path"))).withColumn("r_key", F.substring("r_digest", 1, 8))
    table = table.withColumn("r_place", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))))

    host, path = split_url(F.col(url_col))
    # The page goes along as one column, whatever its columns are called.
    page = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in ADDED]).alias("page")
    found = pages.select(page, host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    urls = found.filter("host <> ''").groupBy("host", "path").agg(F.count("*").alias("pages"))
    parts = F.split(F.col("host"), r"\.")
    hosts = F.array(*[F.when(F.size(parts) >= k, F.array_join(F.slice(parts, -k, k), ".")) for k in sorted(shape.labels)] or [F.lit(None).cast("string")])
    paths = F.array(*[F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in sorted(shape.lengths)] or [F.lit(None).cast("string")])
    tries = (
        urls.withColumn("e_host", F.explode(hosts))
        .filter("e_host IS NOT NULL")
        .withColumn("e_path", F.explode(paths))
        .filter("e_path IS NOT NULL")
        .withColumn("digest", _digest(F.col("e_host"), F.col("e_path")))
        .withColumn("key", F.substring("digest", 1, 8))
        .withColumn("place", F.pmod(F.xxhash64("host", "path"), F.lit(PLACES)).cast("int"))
    )
    hits = tries.join(table, (F.col("key") == F.col("r_key")) & (F.col("place") == F.col("r_place"))).filter("digest = r_digest AND e_host = r_host AND e_path = r_path")
    order = F.struct(F.char_length("r_host") + F.char_length("r_path"), F.char_length("r_host"), F.col("r_verdict"), F.concat("r_host", "r_path").alias("rule"))
    best = hits.groupBy("host", "path").agg(F.max(order).alias("b"), F.first("pages").alias("pages"))
    best = best.select(F.struct("host", "path").alias("url"), "b.rule", F.col("b.r_verdict").alias("verdict"), "pages")
    # Pages without a host have no key and fit no rule; those of one URL are dealt where they are very many.
    keyed = found.withColumn("url", F.when(F.col("host") != "", F.struct("host", "path")))
    joined = spread_join(keyed, best, "url", "pages", "row", "left")
    return joined.select("page.*", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


#: The contract's rules.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, spark.createDataFrame(RULES, RULE_SCHEMA)).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH u AS (
  SELECT row_number() OVER () AS r, page_id,
         CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT r, rh || rp AS rule, rv, row_number() OVER (PARTITION BY r ORDER BY length(rh) + length(rp) DESC, length(rh) DESC) AS k
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM p LEFT JOIN m ON p.r = m.r AND k = 1
"""
