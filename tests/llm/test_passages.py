import hashlib

import numpy as np
import pytest

from curbside.llm import automaton_dedup, bwt_dedup
from tests.llm.test_token_store import twins


def brute_bytes(rows, window):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - window + 1):
            w = b[p : p + window]
            if i is not None:
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - window + 1):
            m = first.get(b[p : p + window])
            if m is not None and (i is None or m < i):
                gone[p : p + window] = True
        gone = gone[: len(b)]
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows, window):
    first, out = {}, []
    for i, t in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - window + 1):
            g = tuple(w[p : p + window])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            m = first.get(tuple(w[p : p + window]))
            if m is not None and (i is None or m < i):
                gone[p : p + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made_up(seed):
    rng = np.random.default_rng(seed)
    words = ["ab", "c", "deé", "ff", "g,", "xyz"]
    passages = [" ".join(rng.choice(words, 30)) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [" ".join(rng.choice(words, rng.integers(0, 40))) if rng.random() < 0.5 else passages[rng.integers(6)] for _ in range(4)]
        rows.append((int(rng.integers(0, 30)), "\n".join(parts)))
    return [*rows, (None, passages[0]), (None, passages[0]), (3, None), (4, ""), (5, "short"), (90, "tail " * 4000), (91, "tail " * 4000)]


@pytest.mark.parametrize("seed", [1])
def test_both_against_brute_force(spark, sf_dir, seed, monkeypatch):
    monkeypatch.setattr("curbside.llm.passages.BLOCK", 600)
    monkeypatch.setattr("curbside.llm.passages.FILE", 3000)
    monkeypatch.setattr("curbside.llm.winnow.SEGMENT", 700)
    rows = made_up(seed)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, kept string")
    got = bwt_dedup.remove_repeats(docs, 50, with_text=True).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute_bytes(rows, 50)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    got = automaton_dedup.remove_repeats(docs, 13, with_text=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_words(rows, 13)


@pytest.mark.parametrize("window", [65, 100, 150])
def test_long_windows_in_small_shards(spark, monkeypatch, window):
    monkeypatch.setattr(bwt_dedup, "CELL", 3000)
    monkeypatch.setattr(bwt_dedup, "SHARD", 700)
    rows = made_up(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = bwt_dedup.remove_repeats(docs, window).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_bytes(rows, window)


def test_different_words_of_one_polynomial_hash(spark):
    one, two = twins()
    around = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{around} {one} tail"), (2, f"{around} {two} tail"), (3, f"{two} {around} {one}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = automaton_dedup.remove_repeats(docs, 13).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_words(rows, 13)
    got = bwt_dedup.remove_repeats(docs, 50).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_bytes(rows, 50)


def test_frequent_grams_change_no_result(spark, monkeypatch):
    monkeypatch.setattr("curbside.llm.passages.FREQUENT", 0.0)
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join([*rng.choice(words, 25), "a phrase that is found in every single one of them", *rng.choice(words, 25)])) for i in range(60)]
    rows += [(100 + i, rows[i][1][20:]) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = bwt_dedup.remove_repeats(docs, 50).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_bytes(rows, 50)
    got = automaton_dedup.remove_repeats(docs, 13).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_words(rows, 13)


def test_whole_small_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = bwt_dedup.op1_suffix_dedup(spark, sf_dir).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_bytes(rows, 50)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bwt_dedup.remove_repeats(none).count() == 0 and automaton_dedup.remove_repeats(none).count() == 0


def test_classes_of_windows_above_64_symbols():
    rng = np.random.default_rng(5)
    same, ends = rng.integers(1, 5, 90).astype(np.uint8), [rng.integers(1, 5, 60).astype(np.uint8) for _ in range(3)]
    zero = np.zeros(1, np.uint8)
    shards = [np.concatenate([x for k in order for x in (rng.integers(1, 5, 7).astype(np.uint8), same, ends[k], zero)]) for order in ([2, 0, 1, 2], [1, 2, 0], [0, 1])]
    for depth in (50, 100, 131):
        seen, windows = {}, set()
        for text, classes in zip(shards, bwt_dedup.merged_classes(shards, depth), strict=True):
            for i in range(len(text) - depth + 1):
                window = text[i : i + depth].tobytes()
                if 0 not in window:
                    seen.setdefault(int(classes[i]), set()).add(window)
                    windows.add(window)
        assert all(len(w) == 1 for w in seen.values()) and len(seen) == len(windows), depth
