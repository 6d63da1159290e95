"""Audit of how filters interact: what each removes, alone and behind the others, in every order.

A document is reduced to the set of filters that it fails, a bit mask. In the
lexicographic list of all orders, those that begin with the same letters stand
together: a prefix of s letters covers (n - s)! ranks from the rank that its
Lehmer digits give. A mask is removed at step s by exactly the prefixes whose
last letter is its only one. So each (part, mask) adds its counts where such an
interval begins, takes them off where it ends, and a running sum over the ranks
gives every order's figures; no document is looked at once per order.

Documents are counted per (part, mask) with map-side combining. What follows has
a size that the number of filters fixes: n! ranks of n steps for each part.
Copies are found on digests: the smallest id of each digest is joined back, and
the rows of a digest with very many are dealt to several places.

Defined cases: a null text is the empty text, a null part the empty string. A
null id is smaller than none and larger than none, and has no labels. Rows that
repeat an id and text are no copies of each other. A document is good (or toxic)
if any label row of its id says 1; null labels say nothing. An empty table has
no parts and gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from curbside.llm.words import whole, words
from curbside.runtime import cut
from curbside.skew import spread_join


def first_rank(prefix: tuple[int, ...], n: int) -> int:
    """Rank of the first of the orders of 0 .. n-1 that begin with ``prefix``."""
    rank = 0
    for i, x in enumerate(prefix):
        digit = x - sum(y < x for y in prefix[:i])
        rank += digit * factorial(n - 1 - i)
    return rank


def removal_intervals(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank behind the last) of the orders that remove a mask at a step."""
    found = []
    for step in range(1, n + 1):
        for prefix in permutations(range(n), step):
            begin = first_rank(prefix, n)
            earlier = sum(1 << x for x in prefix[:-1])
            found += [(mask, step, begin, begin + factorial(n - step)) for mask in range(1 << n) if mask >> prefix[-1] & 1 and not mask & earlier]
    return found


def audit(rows: DataFrame, letters: str) -> DataFrame:
    """Figures of every part, order and step for ``rows(part, mask, good, toxic)``; bit i of the mask is a failure of letter i.

    ``letters`` are in ascending order. Columns: part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    spark, n = rows.sparkSession, len(letters)
    sums = ["n", "good", "toxic"]
    counts = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    counts = cut(counts, "masks")
    # Fixed by the number of filters, not by the data: n! x n and at most 2^n x e x n! rows.
    steps = spark.createDataFrame([(r, s + 1, "".join(letters[x] for x in order), order[s]) for r, order in enumerate(permutations(range(n))) for s in range(n)], "rank int, step int, filter_order string, filter int")
    spans = spark.createDataFrame(removal_intervals(n), "mask int, step int, begin int, end int")

    hits = counts.join(F.broadcast(spans), "mask")
    begins = hits.select("part", "step", F.col("begin").alias("rank"), *sums)
    ends = hits.filter(F.col("end") < factorial(n)).select("part", "step", F.col("end").alias("rank"), *[(-F.col(c)).alias(c) for c in sums])
    grid = counts.select("part").distinct().withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    grid = grid.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) - 1)))).select("part", "step", "rank", *[F.lit(0).cast("long").alias(c) for c in sums])
    changes = begins.unionByName(ends).unionByName(grid).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in sums])
    along = Window.partitionBy("part", "step").orderBy("rank")
    lost = changes.select("part", "step", "rank", *[F.sum(c).over(along).alias(c) for c in sums]).join(F.broadcast(steps), ["rank", "step"])

    fails = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0)) for i in range(n)]
    alone = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(n)]
    totals = counts.groupBy("part").agg(F.sum("n").alias("total"), F.array(*fails).alias("fails"), F.array(*alone).alias("alone"))
    so_far = Window.partitionBy("part", "rank").orderBy("step")
    by_filter = Window.partitionBy("part", "filter")
    return lost.join(totals, "part").select(
        "part", "filter_order", "step",
        (F.col("total") - F.sum("n").over(so_far)).alias("kept"), F.col("n").alias("removed"), (F.get("fails", F.col("filter")) - F.col("n")).alias("redundant"),
        F.get("alone", F.col("filter")).alias("unique_fails"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("n").over(by_filter).alias("shapley"),
    )


def _bits(failures: list[Column]) -> Column:
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures)), F.lit(0))


def failed_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part and mask of each row: bits 0 to 4 for few words, repeated words, capitals, symbols and earlier copies."""
    texts = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(part_col)).alias("part"), whole(F.col(text_col)).alias("text"))
    texts = texts.select("*", words(F.col("text")).alias("words"))
    sizes = texts.select("doc_id", "part", "text", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct"))
    length = F.char_length("text").cast("long")
    capitals = length - F.char_length(F.regexp_replace("text", "[A-Z]+", ""))
    own = [F.col("n_words") < 100, F.lit(100).cast("long") * F.col("n_distinct") < F.lit(80).cast("long") * F.col("n_words"), 100 * capitals > 10 * length, F.col("text").rlike("[#$%&*|]")]
    rows = cut(sizes.select("doc_id", "part", _bits(own).alias("own"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.monotonically_increasing_id().alias("tag")), "failures")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return spread_join(rows, firsts, "digest", "copies", "tag").select("doc_id", "part", (F.col("own") + F.when(copy, 16).otherwise(0)).alias("mask"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``good`` and ``toxic`` from labels(doc_id, quality, toxic)."""
    marks = labels.filter("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    return rows.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(with_labels(failed_rules(docs), labels), "ABCDE")


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels GROUP BY doc_id),
f AS (
  SELECT part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e, coalesce(good, false) AS good, coalesce(bad, false) AS bad
  FROM t LEFT JOIN l USING (doc_id)),
m AS (SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (bad) AS x FROM f GROUP BY ALL),
k(v) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.v || q.v || r.v || s.v || u.v AS o FROM k p, k q, k r, k s, k u
      WHERE len(list_distinct([p.v, q.v, r.v, s.v, u.v])) = 5),
z AS (SELECT m.*, o, least(CASE WHEN a THEN instr(o, 'A') ELSE 9 END, CASE WHEN b THEN instr(o, 'B') ELSE 9 END, CASE WHEN c THEN instr(o, 'C') ELSE 9 END,
             CASE WHEN d THEN instr(o, 'D') ELSE 9 END, CASE WHEN e THEN instr(o, 'E') ELSE 9 END) AS pos,
             concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END) AS letters FROM m, o),
s AS (
  SELECT part, o AS filter_order, step::INTEGER AS step, o[step] AS letter, sum(n) FILTER (pos > step) AS kept, sum(n) FILTER (pos = step) AS removed,
         sum(n) FILTER (pos < step AND contains(letters, o[step])) AS redundant, sum(n) FILTER (letters = o[step]) AS alone,
         sum(g) FILTER (pos = step) AS good_lost, sum(x) FILTER (pos = step) AS toxic_lost
  FROM z, range(1, 6) AS r(step) GROUP BY part, o, step)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(alone, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM s
"""
