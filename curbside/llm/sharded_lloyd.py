"""Centroid clustering by exact integer Lloyd rounds, sharded by dimension.

Vectors are cut into blocks of columns, and the centroids into the same slices.
A task of a column block computes, for every vector of its rows, the exact
partial squared distances to all centroids on its own slice; partial distances
are added by row, and the smallest sum names the cluster. The assignment then
goes back to the column blocks, and each sums its own columns by cluster, with
map-side combining, and replaces its own slice. No task needs whole centroids,
so neither the dimensions nor their product with the clusters bound a worker.

The blocks are one table in the shared folder, a folder per block, and each
round's assignment is another; a lost executor costs a reread. Rows are numbered
once and dealt by that number, so equal vectors, however many, spread evenly.
Through the driver go k x dimensions integers a round, and nothing that grows
with the rows.

Defined cases: only vectors with exactly ``dimensions`` components, none null or
non-finite, take part; others have no row. With fewer vectors than k each is a
centroid. A component's integer is held within +-2^27, so that sums of squares
stay exact in 64 bits for up to 128 dimensions. Equal distances go to the smaller
centroid; repeated rows each get their row; of rows with one id the start order
is that of their components. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from curbside.runtime import cut, scratch

#: Largest absolute value of a component's integer.
LARGEST = 1 << 27


def grid_vector(vector: Column, scale: int) -> Column:
    """Components as integers floor(scale * x) in double precision."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(F.lit(float(scale)) * x.cast("double")), F.lit(LARGEST)), F.lit(-LARGEST)).cast("long"))


def usable(vector: Column, dimensions: int) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size(vector) == dimensions) & ~odd


class ColumnBlocks:
    """The table (row, vec_id, block, x0 ..) of all blocks, and the grid vectors in (row, vec_id, v)."""

    def __init__(self, vectors: DataFrame, dimensions: int, width: int, scale: int, id_col: str, vec_col: str):
        spark = vectors.sparkSession
        self.dimensions, self.width = dimensions, width
        self.count = -(-dimensions // width)
        rows = vectors.filter(usable(F.col(vec_col), dimensions)).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"), grid_vector(F.col(vec_col), scale).alias("v"))
        self.rows = cut(rows, "vectors")
        zero = F.lit(0).cast("long")
        slices = F.array(*[F.struct(F.lit(b).alias("block"), *[F.coalesce(F.get("v", F.lit(b * width + i)), zero).alias(f"x{i}") for i in range(width)]) for b in range(self.count)])
        blocks = self.rows.select("row", "vec_id", F.explode(slices).alias("s")).select("row", "vec_id", "s.*")
        where = scratch(spark, "blocks")
        blocks.write.partitionBy("block").parquet(where)
        self.table = spark.read.schema(blocks.schema).parquet(where)

    def cut(self, centroids: np.ndarray) -> np.ndarray:
        """Slices (block, cluster, width) of centroids (cluster, dimensions)."""
        padded = np.zeros((len(centroids), self.count * self.width), np.int64)
        padded[:, : self.dimensions] = centroids
        return padded.reshape(len(centroids), self.count, self.width).transpose(1, 0, 2)

    def assign(self, centroids: np.ndarray) -> DataFrame:
        """(row, vec_id, cluster, distance) of every vector."""
        slices, k = self.cut(centroids), len(centroids)
        names = [f"d{c}" for c in range(k)]

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                t = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                xs = np.stack([t[f"x{i}"].to_numpy() for i in range(slices.shape[2])], axis=1)
                block = t["block"].to_numpy()
                out = np.empty((len(block), k), np.int64)
                for b in np.unique(block):
                    at = block == b
                    for c, centre in enumerate(slices[b]):
                        out[at, c] = np.square(xs[at] - centre).sum(axis=1)
                yield pa.RecordBatch.from_arrays([t["row"], t["vec_id"], *[pa.array(out[:, c]) for c in range(k)]], ["row", "vec_id", *names])

        kinds = dict(self.rows.dtypes)
        parts = self.table.mapInArrow(partial, f"row long, vec_id {kinds['vec_id']}, " + ", ".join(f"{n} long" for n in names))
        whole = parts.groupBy("row", "vec_id").agg(F.array(*[F.sum(n) for n in names]).alias("d"))
        least = F.array_min("d")
        return whole.select("row", "vec_id", (F.array_position("d", least) - 1).cast("int").alias("cluster"), least.alias("distance"))

    def means(self, assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
        """Componentwise floor of each cluster's mean; an empty cluster keeps its centroid."""
        by_block = self.table.join(assigned.select("row", "cluster"), "row").groupBy("block", "cluster")
        sums = by_block.agg(F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"x{i}") for i in range(self.width)])
        slices = self.cut(centroids).copy()
        for r in sums.collect():  # k x blocks rows
            slices[r["block"], r["cluster"]] = [r[f"x{i}"] // r["n"] for i in range(self.width)]
        return slices.transpose(1, 0, 2).reshape(len(centroids), -1)[:, : self.dimensions]


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``seed:id``, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r.v for r in first], np.int64)


def cluster(vectors: DataFrame, k: int, rounds: int, dimensions: int, scale: int = 64, width: int = 16, seed: str = "1", id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that takes part, and the final integer centroids."""
    blocks = ColumnBlocks(vectors, dimensions, width, scale, id_col, vec_col)
    centroids = first_centroids(blocks.rows, k, seed)
    if not len(centroids):
        return blocks.rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for done in range(rounds + 1):
        assigned = cut(blocks.assign(centroids), "assigned")
        if done < rounds:
            centroids = blocks.means(assigned, centroids)
    return assigned.select("vec_id", "cluster", "distance"), centroids


def op12_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=16, rounds=3, dimensions=64)
    digests = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    sums = sums.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0))))  # a row for each cluster
    sums = sums.join(spark.createDataFrame(digests, "cluster int, centroid_sha256 string"), "cluster")
    return rows.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql(rounds: int) -> str:
    """The assignment of every round and the centroids that follow from it."""
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT n, c, d FROM (
    SELECT v.n, k.c, list_sum(list_transform(list_zip(v.v, k.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d,
           row_number() OVER (PARTITION BY v.n ORDER BY list_sum(list_transform(list_zip(v.v, k.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), k.c) AS o
    FROM v, c{r} k) WHERE o = 1)""")
        if r < rounds:
            parts.append(f"""m{r} AS (
  SELECT c, i, (sum(x) - ((sum(x) % count(*) + count(*)) % count(*))) // count(*) AS x
  FROM (SELECT a.c, unnest(v.v) AS x, unnest(range(1, 65)) AS i FROM a{r} a JOIN v USING (n)) GROUP BY c, i),
c{r + 1} AS MATERIALIZED (
  SELECT k.c, coalesce(w.v, k.v) AS v FROM c{r} k LEFT JOIN (SELECT c, list(x::BIGINT ORDER BY i) AS v FROM m{r} GROUP BY c) w USING (c))""")
    return ",\n".join(parts)


OP12_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: greatest(least(floor(64 * x::DOUBLE), {LARGEST}), -{LARGEST})::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1)::INTEGER AS c, v FROM v ORDER BY sha256('1:' || vec_id), v LIMIT 16),
{_rounds_sql(3)},
s AS (SELECT c, sum(d)::BIGINT AS i FROM a3 GROUP BY c)
SELECT vec_id, a3.c AS cluster, d AS distance, s.i AS cluster_inertia, (SELECT sum(d) FROM a3)::BIGINT AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN v USING (n) JOIN s ON s.c = a3.c JOIN c3 ON c3.c = a3.c
"""
