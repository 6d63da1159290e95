"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

Words and word pairs hash into a fixed number of buckets. Two multinomials over
the buckets are counted: one over the trusted documents, one over all. A
document's score is the sum of its n-grams' log ratios divided by their number;
documents below a threshold go. The ratios are rounded to whole millionths, so
sums don't depend on their order and a verdict is the same in every run.

The counts leave the map side as one row per bucket and task. Only the bucket
weights, bounded by ``BUCKETS``, pass the driver, and they return as a literal;
texts are never shuffled.

Defined cases: a null or blank text has no words, all counts 0, and fails the
base rules. Repeated rows are judged alike. Without trusted documents all
ratios follow from smoothing alone; ``fit`` then returns weights of 0, and only
the base rules decide. Of a very long text the words are held as an array by
its task. ``keep`` gives the columns of its input back untouched, whatever their
names; ``base_rules`` and ``judge`` replace columns that have the names they add.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from curbside.llm.words import SPACE, whole, words

#: Buckets of the hashed n-grams.
BUCKETS = 10_000
#: Trusted documents at most, chosen by a hash of their id.
TRUSTED = 20_000
#: Least mean log ratio of a kept document, in millionths. Set on the labelled documents of the test tables:
#: of those none that is good falls, and 83 % of the bad ones do that pass the base rules.
THRESHOLD = -75_000
#: Neutral n-grams added to each document's own, so that a few rare words don't condemn a short text.
PRIOR = 50

SYMBOLS = "[#*$%&|<>]"


def ngram_buckets(word_array: Column) -> tuple[Column, Column]:
    """Buckets of the words and of the adjacent pairs, as two arrays.

    A pair's bucket comes from both words' checksums; ``zip_with`` pads the last
    word with null, which ``filter`` removes.
    """
    sums = F.transform(word_array, lambda w: F.crc32(w.cast("binary")))
    pairs = F.zip_with(sums, F.slice(sums, 2, F.greatest(F.size(sums), F.lit(1))), lambda a, b: (a * 31 + b + 7) % BUCKETS)
    return F.transform(sums, lambda c: c % BUCKETS), F.filter(pairs, lambda p: p.isNotNull())


def trusted_ids(labels: DataFrame, limit: int = TRUSTED) -> DataFrame:
    """Ids of good, harmless labelled documents: ``limit`` of them at most."""
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(limit)


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """Log ratio of each bucket in millionths, from all documents.

    ``trusted`` holds ids, no more than ``TRUSTED``, and is small enough to
    broadcast by that bound.
    """
    marked = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w")).join(
        F.broadcast(trusted.select("doc_id", F.lit(1).alias("good"))), "doc_id", "left"
    )
    ones, pairs = ngram_buckets(F.col("w"))
    counts = (
        marked.select("good", F.explode(F.concat(ones, pairs)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count("good").alias("target"))
    )

    found = {r.bucket: (r.raw, r.target) for r in counts.collect()}  # at most BUCKETS rows

    n_raw, n_target = sum(r for r, _ in found.values()), sum(t for _, t in found.values())
    if not n_target:
        return [0] * BUCKETS
    import math

    def weight(raw: int, target: int) -> int:
        return round(1e6 * math.log(((target + 1) * (n_raw + BUCKETS)) / ((raw + 1) * (n_target + BUCKETS))))

    return [weight(*found.get(b, (0, 0))) for b in range(BUCKETS)]


def _repeat_words(w: str) -> list[tuple[str, str]]:
    """Columns, one after the other, that end in n_repeat_words.

    Window hashes with their places are sorted, equal neighbours are repeats, and
    each repeat's start adds the words up to the next start, five at most.
    """
    return [
        ("__h", f"IF(n_words >= 6, transform(sequence(0, n_words - 5), i -> xxhash64({', '.join(f'get({w}, CAST(i AS INT) + {k})' for k in range(5))})), array())"),
        ("__s", "IF(size(array_distinct(__h)) < size(__h), array_sort(transform(__h, (x, i) -> struct(x, i))), CAST(array() AS ARRAY<STRUCT<x: BIGINT, i: INT>>))"),
        ("__p", "sort_array(transform(filter(__s, (e, j) -> e.x <=> get(__s, j - 1).x OR e.x <=> get(__s, j + 1).x), e -> e.i))"),
        ("n_repeat_words", "aggregate(__p, named_struct('n', 0L, 'to', -1), (a, p) -> named_struct('n', a.n + p + 5 - greatest(p, a.to), 'to', p + 5), a -> a.n)"),
    ]


def base_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = whole(F.col(text_col))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = (
        docs.withColumn("__w", words(F.col(text_col)))
        .withColumn("__l", lines)
        .withColumn("n_words", F.size("__w").cast("long"))
        .withColumn("word_chars", F.char_length(F.regexp_replace(text, SPACE + "+", "")).cast("long"))
        .withColumn("n_symbols", (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
    )
    for name, expression in _repeat_words("__w"):
        out = out.withColumn(name, F.expr(expression))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("__l", "__h", "__s", "__p")


def judge(docs: DataFrame, weights: list[int], threshold: int = THRESHOLD, text_col: str = "text") -> DataFrame:
    """Adds the base columns, ``llr`` (millionths, summed), ``n_grams`` and ``kept``."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")  # folds to a literal
    ones, pairs = ngram_buckets(F.col("__w"))

    def total(buckets: Column) -> Column:
        return F.aggregate(buckets, F.lit(0).cast("long"), lambda s, b: s + F.get(table, b.cast("int")))

    out = base_rules(docs, text_col).withColumn("llr", total(ones) + total(pairs))
    out = out.withColumn("n_grams", F.greatest(2 * F.col("n_words") - 1, F.lit(0)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(threshold) * (F.col("n_grams") + PRIOR))).drop("__w")


def keep(docs: DataFrame, weights: list[int], threshold: int = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that stay, with their columns.

    The row number in the condition keeps Spark from taking the filter below the
    projections, where each column that a verdict needs would be computed again
    for every use.
    """
    own = docs.select(F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    judged = judge(own, weights, threshold).withColumn("__row", F.monotonically_increasing_id())
    return judged.filter("kept AND __row >= 0").select("__doc.*")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights = fit(docs, trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(docs, weights).select(*columns, "llr")


OP3_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT b AS byte, 0 AS k, b::BIGINT AS v FROM range(256) t(b)
  UNION ALL
  SELECT byte, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384::BIGINT, v >> 1) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY byte) AS tab FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
vocab AS (SELECT DISTINCT unnest(w) AS word FROM d),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(word)), lambda i: ('0x' || substr(hex(word), 2 * i::INT + 1, 2))::BIGINT)),
                               lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS h
  FROM vocab, crc),
tok AS (SELECT r, i, word FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d)),
th AS (SELECT tok.r, tok.i, h FROM tok JOIN hashed USING (word)),
gram AS (
  SELECT r, h % 10000 AS b FROM th
  UNION ALL
  SELECT x.r, (x.h * 31 + y.h + 7) % 10000 FROM th x JOIN th y ON x.r = y.r AND y.i = x.i + 1),
good AS (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL)
         ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 20000),
cnt AS (SELECT b, count(*) AS raw, count(good.doc_id) AS target FROM gram JOIN d USING (r) LEFT JOIN good ON good.doc_id = d.doc_id GROUP BY b),
tot AS (SELECT sum(raw) AS nr, sum(target) AS nt FROM cnt),
wt AS (SELECT b, CASE WHEN nt = 0 THEN 0 ELSE round(1e6::DOUBLE * ln(((target + 1) * (nr + 10000))::DOUBLE / ((raw + 1) * (nt + 10000))::DOUBLE))::BIGINT END AS v FROM cnt, tot),
sc AS (SELECT r, sum(v)::BIGINT AS llr, count(*) AS n_grams FROM gram JOIN wt USING (b) GROUP BY r),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k
        FROM (SELECT r, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d))),
rep AS (SELECT r, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM win WHERE k > 1) GROUP BY r),
ln AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
base AS (
  SELECT d.r, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(ln.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (r) LEFT JOIN ln USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(llr, 0) >= -75000 * (coalesce(n_grams, 0) + 50) AS kept,
       coalesce(llr, 0) AS llr
FROM base LEFT JOIN sc USING (r)
"""
