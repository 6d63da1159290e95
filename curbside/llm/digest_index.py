"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest: one row for each distinct
normalised text ever admitted, with the id of the row that stays. A new batch
is reduced to one row per digest (map-side combined, so a huge group of copies
is a counter and not a partition), loses by a sort-merge anti-join what the
index has, and the rest is appended. The index stands still in both joins with
it: its buckets are the join's partitions, and the batch's digests come to them.

Defined cases: a null text is the empty text; copies of the empty text are a
group like any other. A null id sorts below every id. Rows equal in id and in
normalised text tie, and one of them stays. An empty batch appends nothing.
Very long texts are hashed where they are read; only digests move. Columns
beside the id and the text are carried unread by ``deduplicate``, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from curbside.llm.words import lower_ascii
from curbside.runtime import cut, scratch
from curbside.skew import spread_join

#: Digests of a bucket, about, in an index that is made for a known number of rows.
BUCKET_ROWS = 2_000_000


def text_digest(text: Column) -> Column:
    """SHA-256 (binary) of the text with A-Z lower-cased."""
    return F.unhex(F.sha2(lower_ascii(text).cast("binary"), 256))


class DigestIndex:
    """A digest table at ``location``, in ``buckets`` buckets (64 without a number); made if it isn't there.

    The number of buckets decides where a digest's row is looked for, so it is
    written beside the table once. An index is opened with the number that it
    was made with; another one is an error.
    """

    def __init__(self, spark: SparkSession, name: str, location: str, buckets: int | None = None):
        self.spark, self.name, self.location = spark, name, location
        self.buckets = self._layout(buckets)
        buckets = self.buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT, keep_tag BIGINT, n BIGINT, batch STRING)"
            f" USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{location}'"
        )

    def _layout(self, buckets: int | None) -> int:
        """The stored number of buckets; a new index stores the given one."""
        where = f"{self.location.rstrip('/')}_layout"
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        conf = self.spark._jsc.hadoopConfiguration()
        at = path(where)
        if not at.getFileSystem(conf).exists(path(f"{where}/_SUCCESS")):
            data = path(self.location)
            if data.getFileSystem(conf).exists(data):
                raise ValueError(f"the index at {self.location} has rows but no {where}: its number of buckets isn't known")
            self.spark.createDataFrame([(buckets or 64,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(where)
        stored = self.spark.read.schema("buckets int").parquet(where).first().buckets
        if buckets is not None and buckets != stored:
            raise ValueError(f"the index at {self.location} has {stored} buckets, not {buckets}")
        return stored

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def admit(self, rows: DataFrame, batch: str) -> DataFrame:
        """Adds what is new among ``rows(doc_id, digest, tag)``; returns the index row of each of their digests, with their number ``copies``.

        A batch that was admitted before adds nothing, so a retry is harmless.
        """
        groups = cut(
            rows.groupBy("digest")
            .agg(F.max(F.struct("doc_id", "tag")).alias("keep"), F.count("*").alias("n"))
            .select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.tag").alias("keep_tag"), "n", F.lit(batch).alias("batch")),
            "groups",
        )
        fresh = groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        cut(fresh, "fresh").repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        return groups.select("digest", F.col("n").alias("copies")).join(self.table().hint("merge"), "digest")

    def forget(self) -> None:
        """Takes the table's name off the catalog; its files stay and can be opened again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _labels(docs: DataFrame, index: DigestIndex, batch: str, id_col: str, text_col: str) -> DataFrame:
    rows = cut(
        docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("tag")),
        "digests",
    )
    entries = cut(index.admit(rows, batch).withColumn("new", F.col("batch") == batch), "entries")
    return spread_join(rows, entries, "digest", "copies", "tag").withColumn("kept", F.col("new") & (F.col("tag") == F.col("keep_tag")))


def label(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``group_size`` counts the copies in the batch that brought the digest. A
    digest that an earlier batch brought keeps that batch's row, and all its
    new copies go.
    """
    return _labels(docs, index, batch, id_col, text_col).select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their columns.

    Texts move once, by (id, digest), so that a large group of copies spreads
    over all partitions; they meet only the (id, digest) pairs that go.
    """
    lost = (
        _labels(docs, index, batch, id_col, text_col)
        .filter(~F.col("new") | ~F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .select(F.col("doc_id").alias("__id"), F.col("digest").alias("__lost"))
        .distinct()
    )
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")  # whatever the columns are called
    marked = docs.select(doc, F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"))
    left = marked.join(lost, F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__lost")), "left_anti")
    tied = Window.partitionBy("id", "digest").orderBy("digest")  # rows alike in id and text: one stays
    return left.withColumn("n", F.row_number().over(tied)).filter("n = 1").select("doc.*")


def fresh_index(spark: SparkSession, rows: int = 0, buckets: int = 8) -> DigestIndex:
    """A new index below the shared folder, with at least so many buckets and one for each ``BUCKET_ROWS`` of the expected rows."""
    location = scratch(spark, "digest_index")
    return DigestIndex(spark, location.rpartition("/")[2].replace("-", "_"), location, max(buckets, -(-rows // BUCKET_ROWS)))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = fresh_index(spark, docs.count())
    found = label(docs, index, "all")
    index.forget()
    return found


OP7_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       text_sha256
FROM t
"""
