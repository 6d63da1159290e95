"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. The ratio of target to size gives each
document its expected copies: whole copies are certain, and the fraction is an
inclusion probability. Documents are ranked by their random odds u/(1-u)
divided by their inclusion odds p/(1-p), and each source takes the lowest ranks
until its remaining words are reached, so the sample's size is fixed. The
probabilities are unequal between sources; within a source a mix by target
weights leaves every document the same one, whatever its size, and there the
division keeps the order that the random odds have.

No source is ever sorted as a whole. Ranks are counted in cells (map-side
combined), the cell that holds the cut is found from the counts in two steps,
of ``CELLS`` rows a source each, and only that cell's documents are put in order.

Defined cases: a null or blank text has size 0 and is taken 0 words. Null is a
source of its own, after all others. The null id hashes as an empty one, and
repeated rows, alike in id and size, tie; which of them is taken doesn't show.
Without rows, or where all sizes are 0, targets are 0. The random number is a
hash of seed and id, so reruns agree. Very long texts count with all their
words; one that is longer than what its source misses is passed over. ``plan``
reads id, text and source only; ``mix`` carries all other columns, whatever
their names but for those that begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from curbside.llm.words import n_words
from curbside.runtime import cut
from curbside.skew import spread_join

#: Cells of a source's ranks, and of each of them: bounds the rows per source that are put in order for the cut.
CELLS = 256


def uniform(seed: int, key: Column) -> Column:
    """A number in (0, 1) from a hash of seed and key, with 48 bits."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def source_targets(sizes: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """source, n_docs, source_size, target from (source, size) rows.

    The sources share ``share`` times all words by weight. A source stops at
    ``cap`` times its size and what it leaves is shared by weight among the
    rest: in the order of size/weight the sources that stop come first, so
    running sums tell each source at once whether it stops. The window runs
    over the sources, one row each.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
    by_need = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    after = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap) / F.sum("weight").over(after))
    per = per.withColumn("stops", F.col("source_size") * cap <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("stops"), F.col("level"))).over(Window.partitionBy())  # that of the first which doesn't stop
    target = F.when(F.col("stops"), F.col("source_size") * cap).otherwise(level * F.col("weight"))
    return per.select("source", "n_docs", "source_size", target.cast("double").alias("target"))


def _edge(cells: DataFrame) -> DataFrame:
    """(key, edge, before): the first cell of each source that goes beyond what it misses; cells before it are taken whole."""
    upto = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("upto", F.col("before") + F.sum("words").over(upto)).filter("upto > missing")
    first = cells.groupBy("key").agg(F.min_by(F.struct("cell", (F.col("upto") - F.col("words")).alias("before")), "cell").alias("e"))
    return first.select("key", F.col("e.cell").alias("edge"), F.col("e.before").alias("before"))


def plan(
    docs: DataFrame,
    weights: list[int],
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies.

    After the cut, one more document of each source may be taken: the one whose
    size is nearest to the words still missing, where it brings the source
    nearer to its target.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # a null source has one of its own
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), uniform(seed, F.col(id_col)).alias("u"))
    rows = cut(rows.withColumn("key", key), "sizes")
    targets = cut(source_targets(rows, weights, share, cap).withColumn("key", key), "targets")
    total = targets.agg(F.sum("n_docs")).first()[0] or 0
    counts = targets.select("key", "n_docs")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.select(
        "key",
        "n_docs",
        "source_size",
        "target",
        F.floor(ratio).alias("copies"),
        (ratio - F.floor(ratio)).alias("p"),
        (F.col("target") - F.floor(ratio) * F.col("source_size")).alias("missing"),
    )

    def with_source(left: DataFrame, per_source: DataFrame, how: str = "left") -> DataFrame:
        """Joins what is known of each source; a source with much of all rows is dealt to several tasks."""
        return spread_join(left, per_source if "n_docs" in per_source.columns else per_source.join(counts, "key"), "key", "n_docs", "u", how, total=total)

    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    rank = F.when(F.col("p") > 0, odds / (1 + odds)).otherwise(F.col("u"))
    ranked = with_source(rows, targets, "inner").withColumn("rank", rank)
    ranked = ranked.withColumn("cell", F.least(F.floor(F.col("rank") * CELLS * CELLS), F.lit(CELLS * CELLS - 1)).cast("int"))
    fine = cut(ranked.groupBy("key", "cell").agg(F.sum("size").alias("words"), F.first("missing").alias("missing")), "cells")
    coarse = fine.groupBy("key", F.shiftright("cell", 8).alias("cell")).agg(F.sum("words").alias("words"), F.first("missing").alias("missing"))
    rough = _edge(coarse.withColumn("before", F.lit(0))).withColumnRenamed("edge", "rough")
    near = fine.join(rough, "key").filter(F.shiftright("cell", 8) == F.col("rough"))
    placed = with_source(ranked, _edge(near.drop("rough")))
    edge = F.coalesce(F.col("edge"), F.lit(CELLS * CELLS))
    inside = placed.filter(F.col("cell") == edge)
    running = Window.partitionBy("key").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("hit", F.col("before") + F.sum("size").over(running) <= F.col("missing"))
    chosen = cut(
        placed.filter(F.col("cell") != edge).withColumn("hit", F.col("cell") < edge).unionByName(inside),
        "chosen",
    )
    hit_words = F.sum(F.when(F.col("hit"), F.col("size")).otherwise(0))
    short = cut(chosen.groupBy("key").agg((F.first("missing") - hit_words).alias("short")), "short")
    rest = with_source(chosen.filter(~F.col("hit") & (F.col("size") > 0)), short, "inner")
    gap = F.abs(F.col("size") - F.col("short"))
    fill = (
        rest.groupBy("key")
        .agg(F.min(F.struct(gap.alias("gap"), F.col("rank"), F.col("doc_id"), F.col("size"), F.col("short"))).alias("f"))
        .filter("f.gap < f.short")
        .select("key", F.col("f.rank").alias("f_rank"), F.col("f.doc_id").alias("f_id"), F.col("f.size").alias("f_size"))
    )
    more = F.col("f_rank").isNotNull() & ~F.col("hit") & (F.col("rank") == F.col("f_rank")) & F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("size") == F.col("f_size"))
    return with_source(chosen, cut(fill, "fill")).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("copies") + F.when(F.col("hit") | more, 1).otherwise(0)).cast("long").alias("copies")
    )


def mix(docs: DataFrame, weights: list[int], share: float = 1.0, cap: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix, with their columns, each as often as it is taken.

    Rows that share id, source and size are told apart by a number, so that the
    plan of each reaches one of them.
    """
    twins = ["__id", "__source", "__size"]
    number = F.row_number().over(Window.partitionBy(*twins).orderBy("__id"))
    planned = plan(docs, weights, share, cap, seed, id_col, text_col, source_col)
    planned = planned.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), "copies")
    planned = planned.withColumn("__n", number).filter("copies > 0").select(*(F.col(c).alias(c + "p") for c in (*twins, "__n")), F.col("copies").alias("__copies"))
    own = docs.withColumn("__id", F.col(id_col)).withColumn("__source", F.col(source_col)).withColumn("__size", n_words(F.col(text_col))).withColumn("__n", number)
    same = [F.col(c).eqNullSafe(F.col(c + "p")) for c in (*twins, "__n")]
    taken = own.join(planned, same[0] & same[1] & same[2] & same[3]).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])


#: The contract's settings.
WEIGHTS, SHARE, CAP, SEED = [5, 2, 1], 1.5, 2.0, 17


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = plan(docs, WEIGHTS, SHARE, CAP, SEED)
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP2_SQL = r"""
WITH rows_ AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM rows_ GROUP BY source),
lev AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5
      - coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2.0)
      / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per),
tgt AS (
  SELECT source, source_size,
         CASE WHEN source_size * 2.0::DOUBLE <= level * weight THEN source_size * 2.0::DOUBLE
              ELSE max(CASE WHEN NOT source_size * 2.0::DOUBLE <= level * weight THEN level END) OVER () * weight END AS target
  FROM lev),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS ratio FROM tgt),
d AS (
  SELECT rows_.*, r.source_size, r.target, floor(ratio) AS copies, ratio - floor(ratio) AS p,
         target - floor(ratio) * r.source_size AS missing
  FROM rows_ JOIN r ON rows_.source IS NOT DISTINCT FROM r.source),
k AS (
  SELECT *, CASE WHEN p > 0 THEN ((u / (1 - u)) / (p / (1 - p))) / (1 + (u / (1 - u)) / (p / (1 - p))) ELSE u END AS rank FROM d),
c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) <= missing AS hit,
         row_number() OVER (PARTITION BY source ORDER BY rank, doc_id NULLS FIRST, size) AS pos FROM k),
s AS (
  SELECT source, first(missing) - sum(CASE WHEN hit THEN size ELSE 0 END) AS short FROM c GROUP BY source),
f AS (
  SELECT c.source, c.pos, abs(c.size - s.short) AS gap, s.short,
         row_number() OVER (PARTITION BY c.source ORDER BY abs(c.size - s.short), rank, doc_id NULLS FIRST, size) AS best
  FROM c JOIN s ON c.source IS NOT DISTINCT FROM s.source WHERE NOT hit AND size > 0)
SELECT c.doc_id, c.size, c.source_size, c.target,
       (c.size * (c.copies + CASE WHEN c.hit OR f.pos IS NOT NULL THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c LEFT JOIN f ON c.source IS NOT DISTINCT FROM f.source AND c.pos = f.pos AND f.best = 1 AND f.gap < f.short
"""
