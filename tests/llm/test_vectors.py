"""Graph index, sharded Lloyd and filter audit against brute force."""

from itertools import permutations

import numpy as np
import pytest

from curbside.llm import filter_audit, graph_index, sharded_lloyd


def exact(ids, x, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(np.square(x - x[ids.index(q)]).sum(axis=1))
        out[q] = [i for _, i in sorted((d[j], i) for j, i in enumerate(ids) if i != q)[:k]]
    return out


@pytest.mark.parametrize("shard_rows", [100_000, 400])
def test_recall_over_shards(spark, shard_rows):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 32))[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 32)) * 0.8
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = graph_index.build(rows, 10, shard_rows=shard_rows)
    assert (index.count() > 1) == (shard_rows == 400)
    got = {}
    for r in graph_index.search(index, rows.filter("vec_id % 20 = 0"), 10, lane_rows=30).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = exact(list(range(1500)), x, range(0, 1500, 20), 10)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert np.mean([len({*got[q]} & {*want[q]}) / 10 for q in want]) >= 0.95


def test_one_vector_holds_a_third_of_all_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 8))
    x[::3] = x[0]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(7)
    index = graph_index.build(rows, 5)
    got = {}
    for r in graph_index.search(index, rows.filter("vec_id < 12"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == exact(list(range(900)), x, range(12), 5)


def test_every_node_is_reached():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(300, 4)) + 100 * c for c in range(4)]).astype(np.float32)
    edges, entry = graph_index.build_graph(graph_index.navigable(x.astype(np.float64))[0], degree=4, beam=8)
    reached = np.zeros(len(x), bool)
    graph_index._reached(edges, np.array([entry]), reached)
    assert reached.all()


def test_lloyd_in_other_shapes(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 10))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    grid = np.floor(16 * x).astype(int)
    found, centroids = sharded_lloyd.cluster(rows, k=5, rounds=2, dimensions=10, scale=16, width=4)
    firsts = sharded_lloyd.first_centroids(rows.selectExpr("vec_id", "transform(embedding, e -> floor(16 * e)) v"), 5, "1")
    for _ in range(2):
        best = np.square(grid[:, None] - firsts[None]).sum(axis=2).argmin(axis=1)
        firsts = np.array([grid[best == c].sum(axis=0) // (best == c).sum() if (best == c).any() else firsts[c] for c in range(5)])
    d = np.square(grid[:, None] - firsts[None]).sum(axis=2)
    assert (centroids == firsts).all()
    assert sorted(map(tuple, found.collect())) == [(i, int(d[i].argmin()), int(d[i].min())) for i in range(300)]


def test_intervals_cover_every_order_once():
    for n in (1, 3, 5):
        orders = list(permutations(range(n)))
        spans = filter_audit.removal_intervals(n)
        for mask in range(1 << n):
            steps = [None] * len(orders)
            for _, step, begin, end in (s for s in spans if s[0] == mask):
                for r in range(begin, end):
                    assert steps[r] is None
                    steps[r] = step
            assert steps == [next((i + 1 for i, f in enumerate(o) if mask >> f & 1), None) for o in orders]


def test_audit_by_hand(spark):
    rows = spark.createDataFrame([("x", 0, True, False), ("x", 1, True, False), ("x", 3, False, True), ("x", 2, False, False), ("y", 0, False, False)], "part string, mask int, good boolean, toxic boolean")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(rows, "AB").collect()}
    assert got == {
        ("x", "AB", 1): (2, 2, 0, 1, 1, 1, 3), ("x", "AB", 2): (1, 1, 1, 1, 0, 0, 3), ("x", "BA", 1): (2, 2, 0, 1, 0, 1, 3), ("x", "BA", 2): (1, 1, 1, 1, 1, 0, 3),
        ("y", "AB", 1): (1, 0, 0, 0, 0, 0, 0), ("y", "AB", 2): (1, 0, 0, 0, 0, 0, 0), ("y", "BA", 1): (1, 0, 0, 0, 0, 0, 0), ("y", "BA", 2): (1, 0, 0, 0, 0, 0, 0),
    }
