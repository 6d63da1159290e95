import hashlib

import duckdb
import public_tokenizers
import sentencepiece

import corpus_pipeline
from curbside.llm import quality


def sha_order(doc_id):
    u = (int(hashlib.md5(f"17:{doc_id}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
    return u


def lower(text):
    return text.encode().lower()


def near_groups(docs):
    sets = {}
    for i, t, _ in docs:
        w = lower(t).split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i for i in ids if find(i) == i}


def mixed(docs):
    size = {i: len(t.encode().split()) for i, t, _ in docs}
    by = {}
    for i, _, s in docs:
        by.setdefault(s, []).append(i)
    words = {s: sum(size[i] for i in by[s]) for s in by}
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(sorted(by, key=lambda s: s.encode()))}
    target, free, left = {}, set(by), float(sum(words.values()))
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if 2 * words[s] <= level * weight[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * words[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    out = {}
    for s, ids in by.items():
        ratio = target[s] / words[s]
        whole, p = int(ratio), ratio - int(ratio)
        missing = target[s] - whole * words[s]
        out |= dict.fromkeys(ids, whole)
        rank = lambda i: (sha_order(i), i)  # noqa: E731  the same inclusion odds within a source keep the order
        got, rest = 0, []
        for k, i in enumerate(sorted(ids, key=rank)):
            if not rest and got + size[i] <= missing:
                got += size[i]
                out[i] += 1
            else:
                rest.append(i)
        rest = [i for i in rest if size[i]]
        if rest:
            best = min(rest, key=lambda i: (abs(size[i] - (missing - got)), rank(i)))
            if abs(size[best] - (missing - got)) < missing - got:
                out[best] += 1
    return out


def test_run_against_brute_force(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    names = [c[0] for c in con.execute(quality.OP3_SQL).description]
    kept = {r[names.index("doc_id")] for r in con.execute(quality.OP3_SQL).fetchall() if r[names.index("kept")]}
    docs = [(r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.doc_id in kept]
    best = {}
    for i, t, _ in docs:
        best[lower(t)] = max(best.get(lower(t), i), i)
    docs = [d for d in docs if best[lower(d[1])] == d[0]]
    first = near_groups(docs)
    docs = [d for d in docs if d[0] in first]
    copies, text = mixed(docs), {d[0]: d[1] for d in docs}
    judge = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((i, judge.encode(text[i])) for i, n in copies.items() for _ in range(n))
    assert sorted((r.doc_id, r.ids) for r in got) == want
    assert len(kept) > len(docs) > 50 and set(copies.values()) >= {0, 1}


GOOD = "plain words of a document that is long enough for every rule and says the same thing number {}"
ODD = [(1, GOOD.format(1), "a"), (1, GOOD.format(1), "a"), (2, GOOD.format(1).upper(), None), (None, GOOD.format(1), "a"), (None, None, None), (3, None, "a"), (4, "", "b"), (5, " \n", "b")]
ODD += [(6, "lorem ipsum dolor sit amet " * 9000, "b"), (7, " ".join(f"other{i}" for i in range(40)), None), (7, " ".join(f"other{i}" for i in range(40)), "z"), (8, " ".join(f"third{i}" for i in range(40)), "a")]
KIND = "doc_id long, text string, source string, n_words string, kept string, digest int, component_id string, size string, `odd.name` double"


def test_stages_on_odd_rows_and_empty_tables(spark, sf_dir):
    kept = {"quality_rules": {1, 2, 7, 8, None}, "exact_dedup": {2, 4, 5, 6, 7, 8}, "near_duplicates": {1, None, 3, 4, 5, 6, 7, 8}}
    for rows in (ODD, []):
        docs = spark.createDataFrame([(*r, "mine", "yes", 3, None, "big", 1.5) for r in rows], KIND)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns, name
            found = out.collect()
            own = {tuple(r) for r in docs.collect()}
            assert all(tuple(r) in own for r in found), name
            if rows and name in kept:
                assert {r.doc_id for r in found} - {None} == kept[name] - {None}, name
        out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
        assert len(out) == len(rows) and all((r.ids == []) == (r.doc_id in (4, None, 3) and not r.n_tokens) for r in out)


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
