import numpy as np
import pytest

from curbside.components import connected_components
from curbside.llm import near_dedup


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def copies(seed, n, edits):
    """A text and copies of copies with random edits: many near the threshold, in chains."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [list(rng.choice(words, 60))]
    for _ in range(n):
        t = list(texts[rng.integers(0, max(1, len(texts) // 3))])
        for _ in range(rng.integers(0, edits)):
            t[rng.integers(len(t))] = rng.choice(words)
        texts.append(t)
    rows = [(int(i), " ".join(t)) for i, t in enumerate(texts)]
    rows += [(900 + i, " ".join(rng.choice(words, 50))) for i in range(40)]
    odd = [(None, rows[0][1]), (950, None), (951, ""), (952, "  \n"), (953, "one"), (954, "ONE"), (955, "one two"), (5, rows[5][1]), (956, "long " * 9000)]
    return rows + odd


@pytest.mark.parametrize("small", [512, 8])
def test_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    rows = copies(small, 120, 9)
    docs = spark.createDataFrame([(d, t, b"clash") for d, t in rows], "doc_id long, text string, key binary")
    got = near_dedup.find_components(docs, 3, 85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 3, 85)


def test_deduplicate_and_empty(spark):
    rows = [(2, "a b c d e f g h"), (1, "A b c d e f g h"), (3, None), (4, None), (7, "x"), (7, "x")]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n int")
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 7]
    assert near_dedup.find_components(docs.limit(0)).count() == 0


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 101), (103, 103)], "u long, v long")
    got = {r.v: r.component for r in connected_components(edges).collect()}
    assert got == dict.fromkeys(range(51), 0) | {100: 100, 101: 100, 103: 103}
