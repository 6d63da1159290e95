"""Approximate nearest neighbours over robust-pruned directed graphs, one per shard.

Equal vectors are one node, which carries the smallest ids of its group, as many
as an answer can use. Nodes are dealt to shards of a bounded size by a hash, and
a task builds each shard's graph: nodes enter in batches, a greedy search from
the shard's middle proposes neighbours (its beam and the nodes that it passed),
pruning keeps a near one only where no kept one is closer to it by a factor of
``alpha``, and the reverse edges are pruned alike. Nodes that no path reaches
get an edge from a near one that is reached. A shard's graph, vectors and ids
are one row of the index, a table in the shared folder.

A search sends each query to every shard of its dimension, in lanes of a bounded
number of queries; a beam search walks the graph in scaled single precision, its
whole beam is measured on the original vectors in double precision, and the
answers of all shards are merged. Every row is indexed; what a beam doesn't meet
is missed.

Work. Building is in proportion to the rows. Searching is queries x shards
beams, each of which costs the logarithm of a shard; ``shard_rows`` sets their
number, bounded by the memory of a task (about 0.7 KB a row of 64 components).

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows without an id. Only vectors of equal length
are compared. Rows that repeat an id and a vector count once; all rows with the
query's id are its own; a vector that repeats under other ids is found at
distance 0. Ties go to the smaller id. With fewer candidates than k all that the
beams meet are returned. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from curbside.runtime import cut

#: Rows of a shard, about; edges of a node; beams of building and of searching.
SHARD_ROWS, DEGREE, BUILD_BEAM, SEARCH_BEAM = 8192, 32, 64, 192
#: A node is passed over where a kept one is nearer to it by this factor.
ALPHA = 1.2
#: Queries of a lane, which one task sends through one shard, and of a step within it.
LANE_ROWS, STEP_ROWS = 16384, 256
#: Nodes that a query opens at once.
OPENED = 4

INDEX = "dim int, shard int, entry int, degree int, vectors binary, edges binary, starts binary, ids binary"


def usable(vector: Column) -> Column:
    """True for a vector with finite components that aren't all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def navigable(x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Vectors in single precision around their mean, with the scale and mean to bring queries there."""
    scale = float(np.abs(x).max())
    small = x / scale
    mean = small.mean(axis=0)
    return (small - mean).astype(np.float32), scale, mean


def beam_search(x: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes and squared distances of each query's beam, nearest first (-1 and inf where it isn't full), and of the nodes it opened."""
    b, n = len(queries), len(x)
    ids, dist, fresh = np.full((b, beam), -1, np.int32), np.full((b, beam), np.inf, np.float32), np.zeros((b, beam), bool)
    ids[:, 0], dist[:, 0], fresh[:, 0] = entry, np.square(queries - x[entry]).sum(axis=1), True
    seen = np.zeros((b, n), bool)
    seen[:, entry] = True
    passed_ids, passed = [], []
    while True:
        pick = fresh & (np.cumsum(fresh, axis=1) <= OPENED)
        row, col = np.nonzero(pick)
        if not len(row):
            break
        fresh[pick] = False
        order = np.cumsum(pick, axis=1)[row, col] - 1
        step_ids, step = np.full((b, OPENED), -1, np.int32), np.full((b, OPENED), np.inf, np.float32)
        step_ids[row, order], step[row, order] = ids[row, col], dist[row, col]
        passed_ids.append(step_ids)
        passed.append(step)
        near = edges[ids[row, col]]
        keys = (row[:, None] * np.int64(n) + near)[near >= 0]
        keys = np.unique(keys[~seen.ravel()[keys]])
        seen.ravel()[keys] = True
        row, node = np.divmod(keys, n)
        if not len(row):
            continue
        d = np.square(x[node] - queries[row]).sum(axis=1)
        first = np.searchsorted(row, np.arange(b))
        at = np.arange(len(row)) - first[row]
        wide = beam + int(at.max()) + 1
        all_ids, all_dist, all_fresh = np.full((b, wide), -1, np.int32), np.full((b, wide), np.inf, np.float32), np.zeros((b, wide), bool)
        all_ids[:, :beam], all_dist[:, :beam], all_fresh[:, :beam] = ids, dist, fresh
        all_ids[row, beam + at], all_dist[row, beam + at], all_fresh[row, beam + at] = node, d, True
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids, dist, fresh = (np.take_along_axis(a, order, axis=1) for a in (all_ids, all_dist, all_fresh))
    return ids, dist, np.concatenate(passed_ids, axis=1), np.concatenate(passed, axis=1)


def prune(x: np.ndarray, near: np.ndarray, dist: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates (-1: none; repeats allowed) at squared distances, at most ``degree`` diverse ones; -1 behind them."""
    rows = np.arange(len(near))
    order = np.lexsort((near, dist), axis=1)
    near, dist = np.take_along_axis(near, order, axis=1), np.take_along_axis(dist, order, axis=1)
    v = x[near]
    norms = np.square(v).sum(axis=2)
    between = norms[:, :, None] + norms[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
    alive = (near >= 0) & np.isfinite(dist)
    alive[:, 1:] &= near[:, 1:] != near[:, :-1]
    kept = np.full((len(near), degree), -1, np.int32)
    for k in range(degree):
        first = np.argmax(alive, axis=1)
        has = alive[rows, first]
        if not has.any():
            break
        kept[has, k] = near[rows, first][has]
        alive &= between[rows, first] * ALPHA**2 > dist
        alive[rows, first] = False
    return kept


def _add_reverse(x: np.ndarray, edges: np.ndarray, sources: np.ndarray) -> None:
    """Gives every node that ``sources`` point to an edge back; full nodes are pruned."""
    degree = edges.shape[1]
    target = edges[sources].ravel()
    source = np.repeat(sources, degree)[target >= 0]
    target = target[target >= 0]
    order = np.lexsort((source, target))
    target, source = target[order], source[order]
    nodes, first, new = np.unique(target, return_index=True, return_counts=True)
    have = (edges[nodes] >= 0).sum(axis=1)
    at = np.arange(len(target)) - np.repeat(first, new)
    full = have + new > degree
    room = ~np.repeat(full, new)
    edges[target[room], (np.repeat(have, new) + at)[room]] = source[room]
    by_size = np.flatnonzero(full)[np.argsort(new[full], kind="stable")]
    while len(by_size):  # groups of nodes with about as many candidates, of bounded size together
        wide = degree + int(new[by_size[min(len(by_size), 64) - 1]])
        group, by_size = np.split(by_size, [max(1, min(64, 4_000_000 // wide**2))])
        wide = degree + int(new[group].max())
        near = np.full((len(group), wide), -1, np.int32)
        near[:, :degree] = edges[nodes[group]]
        for i, g in enumerate(group):
            near[i, degree : degree + new[g]] = source[first[g] : first[g] + new[g]]
        dist = np.square(x[near] - x[nodes[group]][:, None]).sum(axis=2)
        edges[nodes[group]] = prune(x, near, dist, degree)


def _reached(edges: np.ndarray, begin: np.ndarray, reached: np.ndarray) -> None:
    reached[begin] = True
    while len(begin):
        begin = np.unique(edges[begin])
        begin = begin[begin >= 0]
        begin = begin[~reached[begin]]
        reached[begin] = True


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM) -> tuple[np.ndarray, int]:
    """Edges (-1: none) and entry of a graph over distinct vectors in which every node is reached from the entry."""
    n = len(x)
    entry = int(np.argmin(np.square(x - x.mean(axis=0)).sum(axis=1)))
    edges = np.full((n, degree), -1, np.int32)
    order = np.array([i for i in range(n) if i != entry], np.int32)
    at, size, most = 0, 1, max(STEP_ROWS // 4, n // 50)
    while at < len(order):
        batch = order[at : at + size]
        for some in np.split(batch, range(STEP_ROWS, len(batch), STEP_ROWS)):
            ids, dist, passed_ids, passed = beam_search(x, edges, entry, x[some], beam)
            edges[some] = prune(x, np.concatenate([ids, passed_ids], axis=1), np.concatenate([dist, passed], axis=1), degree)
        _add_reverse(x, edges, batch)
        at, size = at + size, min(2 * size, most)
    reached = np.zeros(n, bool)
    _reached(edges, np.array([entry]), reached)
    while not reached.all():
        lost = int(np.argmin(reached))
        near = beam_search(x, edges, entry, x[[lost]], beam)[0][0]
        free = [i for i in near if i >= 0 and (edges[i] < 0).any()]
        if not free:
            edges = np.concatenate([edges, np.full((n, 1), -1, np.int32)], axis=1)
            continue
        edges[free[0], np.argmax(edges[free[0]] < 0)] = lost
        _reached(edges, np.array([lost]), reached)
    return edges, entry


def _build(table: pa.Table) -> pa.Table:
    """One index row from the nodes (dim, shard, v, ids) of a shard."""
    dim, shard = table["dim"][0].as_py(), table["shard"][0].as_py()
    ids = table["ids"].combine_chunks()
    order = np.argsort(np.array([i[0].as_py() for i in ids]), kind="stable")
    x = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)[order]
    members = [ids[int(i)].as_py() for i in order]
    edges, entry = build_graph(navigable(x)[0])
    starts = np.cumsum([0, *map(len, members)], dtype=np.int32)
    flat = np.array([m for own in members for m in own], np.int64)
    row = {"dim": dim, "shard": shard, "entry": entry, "degree": edges.shape[1], "vectors": x.tobytes(), "edges": edges.tobytes(), "starts": starts.tobytes(), "ids": flat.tobytes()}
    kinds = pa.schema([(n, pa.int32()) for n in ("dim", "shard", "entry", "degree")] + [(n, pa.binary()) for n in ("vectors", "edges", "starts", "ids")])
    return pa.Table.from_pylist([row], kinds)


def _spread(groups: int) -> int:
    """Partitions for so many groups of much work: few of them share one."""
    return max(1, min(4 * groups, 20_000))


def build(vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index of all vectors for answers of up to ``k`` neighbours, one row per shard."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v"))).distinct()
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    rows = rows.withColumn("n", first).filter(F.col("n") <= k + 1)  # cut before the shuffle too, so a huge group sends k + 1 rows a task
    nodes = cut(rows.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.size("v").alias("dim"), "v", "ids"), "nodes")
    shards = nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    dealt = nodes.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))
    # A shard is seconds of work in little data: a number of partitions of its own keeps Spark from putting many into one task.
    total = shards.agg(F.sum("shards")).first()[0] or 1
    apart = dealt.select("dim", "shard", "v", "ids").repartition(_spread(total), "dim", "shard")
    return cut(apart.groupBy("dim", "shard").applyInArrow(_build, INDEX), "graphs")


def _answers(k: int, beam: int):
    def answers(index: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if index.num_rows and queries.num_rows:
            row = {c: index[c][0].as_py() for c in index.column_names}
            x = np.frombuffer(row["vectors"]).reshape(-1, row["dim"])
            edges = np.frombuffer(row["edges"], np.int32).reshape(len(x), row["degree"])
            starts, ids = np.frombuffer(row["starts"], np.int32), np.frombuffer(row["ids"], np.int64)
            small, scale, mean = navigable(x)
            own = queries["query_id"].to_numpy()
            tag = queries["tag"].to_numpy()
            q = queries["v"].combine_chunks().flatten().to_numpy().reshape(-1, row["dim"])
            for at in range(0, len(q), STEP_ROWS):
                some = slice(at, at + STEP_ROWS)
                moved = np.clip(q[some] / scale - mean, -1e15, 1e15).astype(np.float32)
                near = beam_search(small, edges, row["entry"], moved, beam)[0]
                who, col = np.nonzero(near >= 0)
                node = near[who, col]
                score = np.sqrt(np.cumsum(np.square(x[node] - q[some][who]), axis=1)[:, -1])
                size = starts[node + 1] - starts[node]
                item = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[node], size)
                who, score, vec = np.repeat(who, size), np.repeat(score, size), ids[item]
                other = vec != own[some][who]
                who, score, vec = who[other], score[other], vec[other]
                order = np.lexsort((vec, score, who))
                who, score, vec = who[order], score[order], vec[order]
                rank = np.arange(len(who)) - np.searchsorted(who, who)
                best = rank < k
                found.append([own[some][who[best]], tag[some][who[best]], vec[best], score[best]])
        kinds = [np.int64, np.int64, np.int64, np.float64]
        columns = [np.concatenate([f[i] for f in found] or [np.empty(0, kind)]) for i, kind in enumerate(kinds)]
        return pa.table(columns, names=["query_id", "tag", "vec_id", "score"])

    return answers


def search(index: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", beam: int = SEARCH_BEAM, lane_rows: int = LANE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's nearest rows found in the index of ``build``."""
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).cast("array<double>").alias("v"))
    asked = cut(asked.filter(F.col("query_id").isNotNull() & usable(F.col("v"))).distinct(), "queries")
    lanes = -(-asked.count() // lane_rows) or 1
    shards = index.groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    asked = asked.select("query_id", "v", F.size("v").alias("dim"), F.xxhash64("v").alias("tag"), F.pmod(F.xxhash64("query_id", "v"), F.lit(lanes)).cast("int").alias("lane"))
    asked = asked.join(shards, "dim").withColumn("shard", F.explode("shards")).drop("shards")
    graphs = index.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    keys = ["dim", "shard", "lane"]
    parts = _spread(index.count() * lanes)
    graphs, asked = (side.repartition(parts, *keys) for side in (graphs, asked))
    found = graphs.groupBy(keys).cogroup(asked.groupBy(keys)).applyInArrow(_answers(k, beam), "query_id long, tag long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "tag").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_graph_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(build(rows, 10), rows.filter("vec_id % 100 = 0"), 10)


#: All pairs; equal where the beams meet every neighbour, as they do on small tables.
OP11_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, embedding AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, q.v AS q, c.vec_id, c.v,
         sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id, q ORDER BY score, vec_id))::INTEGER AS rank, vec_id, score FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
