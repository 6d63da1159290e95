"""Every query with SQL on a table of odd rows, and on empty tables."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from curbside.llm import digest_index, mixing, near_dedup, quality, queries, url_filter

LONG = "lorem ipsum dolor sit amet " * 4000
TEXTS = [
    (1, "Same TEXT here and more words to make it long enough for rules", "a"),
    (2, "same text HERE and more words to make it long enough for rules", "a"),
    (3, None, None),
    (4, "", "b"),
    (5, " \t\n\x0b\x0c\r ", "b"),
    (6, "one", "b"),
    (7, LONG, "c"),
    (8, LONG + "tail", "c"),
    (9, "É é ß ﬁ \U0001f600 ÀB naïve # * $ % & | < > symbols\nline\nline\n\n \nline", "d"),
    (10, "a b c d e a b c d e a b c d e f", "é"),
    (11, "x\u00a0y z\u3000w words with odd spaces that are no separators at all here", None),
    (12, "<|endoftext|> literal " * 30, "Z"),
] + [(20 + i, f"number {i} of many documents that differ in one word only and are long enough to link number {i % 2}", "big") for i in range(30)]
PAGES = [
    (1, "http://WWW.Example.COM/en/x?q#f", "<p>a"), (2, "https://example.com/en/", "<p>a"), (3, "https://example.com/english", None), (4, "x.net/es/", ""),
    (5, None, "b"), (6, "http://a.net/fr/1", "<p>a"), (7, "http://net/es/", "c"), (8, "ftp://?x", "c"), (9, "http://com", "é"), (10, "http://..com/", "é"), (11, "a://b://c.com/", "z"), (2, "https://example.com/en/", "<p>a"),
]

NAN, INF = float("nan"), float("inf")
SPREAD = [[((i * j * 37 + i) % 101 - 50) / 50 for j in range(64)] for i in range(1, 150)]
VECTORS = (
    [(i, v) for i, v in enumerate(SPREAD, 95)] + [(1000 + i, SPREAD[3]) for i in range(40)] + [(2000, SPREAD[3]), (2000, SPREAD[3]), (2000, SPREAD[4]), (None, SPREAD[5]), (3000, None), (3100, []), (3200, [0.0] * 64)]
    + [(3300, [NAN] + [1.0] * 63), (3400, [1.0] * 63 + [INF]), (3500, [None] + [1.0] * 63), (3600, [1.0, 2.0]), (3700, [1.0, 2.5]), (3800, [-0.0] * 63 + [1.0]), (3900, [0.0] * 63 + [1.0]), (4000, [3e9] * 64), (4100, [-3e9] * 64)]
)


@pytest.fixture(params=["odd", "empty"])
def odd_dir(tmp_path, request):
    keep = slice(None) if request.param == "odd" else slice(0)
    docs, pages = TEXTS[keep], PAGES[keep]
    kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string()), ("keep_id", pa.string()), ("n_chars", pa.int64()), ("lang", pa.string()), ("part", pa.int32())])
    pq.write_table(pa.table([list(c) for c in zip(*[(i, t, s, "clash", 1, [None, "", "en", "de"][i % 4], 5) for i, t, s in docs], strict=True)] or [[]] * 7, schema=kinds), tmp_path / "documents.parquet")
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("host", pa.int32())])
    pq.write_table(pa.table([list(c) for c in zip(*[(*p, 3) for p in pages], strict=True)] or [[]] * 4, schema=kinds), tmp_path / "pages.parquet")
    labels = [(1, 1, 0), (7, 1, None), (9, 0, 0), (None, 1, 0), (99, 1, 0)][keep]
    kinds = pa.schema([("doc_id", pa.int64()), ("quality", pa.int64()), ("toxic", pa.int64())])
    pq.write_table(pa.table([list(c) for c in zip(*labels, strict=True)] or [[]] * 3, schema=kinds), tmp_path / "labels.parquet")
    kinds = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("cluster", pa.string())])
    pq.write_table(pa.table([list(c) for c in zip(*[(i, v, 1, "clash") for i, v in VECTORS[keep]], strict=True)] or [[]] * 4, schema=kinds), tmp_path / "embeddings.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, odd_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{odd_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, odd_dir)
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    plain = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    rows = sorted([plain(r[c]) for c in sorted(names)] for r in got.collect())
    assert rows == sorted([plain(v) for _, v in sorted(zip(names, r, strict=True))] for r in want.fetchall())


def test_index_persists_between_batches(spark):
    index = digest_index.fresh_index(spark, buckets=4)
    first = spark.createDataFrame([(1, "a", 0), (2, "A", 0), (None, "b", 0), (3, None, 0), (4, "", 0)], "doc_id long, text string, digest int")
    assert sorted(r.doc_id for r in digest_index.deduplicate(first, index, "one").collect() if r.doc_id) == [2, 4]
    second = spark.createDataFrame([(2, "a"), (9, "B"), (7, "new"), (7, "new")], "doc_id long, text string")
    assert [r.doc_id for r in digest_index.deduplicate(second, index, "two").collect()] == [7]
    again = digest_index.DigestIndex(spark, index.name, index.location, 4)
    assert again.table().count() == 4
    again.admit(first.select("doc_id", digest_index.text_digest(first.text).alias("digest")).withColumn("tag", first.doc_id), "one")
    assert again.table().count() == 4


def test_mix_reaches_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    plan = mixing.plan(docs, [5, 2, 1], 1.5)
    per = plan.selectExpr("source", "target", "size * copies AS taken", "source_size").groupBy("source").agg({"taken": "sum", "target": "max", "source_size": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 0.02 * r["max(target)"] for r in per)
    assert sum(r["max(target)"] for r in per) == pytest.approx(1.5 * sum(r["max(source_size)"] for r in per))
    assert all(r["max(target)"] <= 2 * r["max(source_size)"] + 1e-6 for r in per)
    mixed = mixing.mix(docs, [5, 2, 1], 1.5)
    assert mixed.columns == docs.columns and mixed.count() == plan.selectExpr("sum(copies) n").first().n
    assert sorted(mixing.plan(docs.repartition(7), [5, 2, 1], 1.5).collect()) == sorted(plan.collect())


def test_targets_follow_the_loop(spark):
    for share in (0.2, 1.0, 1.5, 1.9, 2.0):
        sizes = {"a": 10, "b": 400, "c": 0, "d": 90, "e": 1000, "f": 3}
        weight = dict(zip(sorted(sizes), [5, 2, 1] * 2, strict=True))
        left, free, want = share * sum(sizes.values()), set(sizes), {}
        while over := {s for s in free if left * weight[s] / sum(weight[x] for x in free) >= 2 * sizes[s]}:
            want |= {s: 2 * sizes[s] for s in over}
            free -= over
            left = share * sum(sizes.values()) - sum(want.values())
        want |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(rows, [5, 2, 1], share, 2.0).collect()}
        assert got == pytest.approx(want), share


def test_rules_and_weights(spark):
    rules = spark.createDataFrame([("A.com", "/x", "block"), ("a.com", "/x", "allow"), ("", "/", "block"), (None, "/", "block"), ("b.com", None, "block")], url_filter.RULE_SCHEMA)
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(["http://a.com/xyz", "http://z.a.com/y", "http://q.b.com", "http://c.com/"])], "page_id long, url string, rule string")
    assert [(r.rule, r.verdict) for r in url_filter.judge(pages, rules).orderBy("page_id").collect()] == [("a.com/x", "block"), (None, "allow"), ("b.com", "block"), (None, "allow")]
    assert url_filter.judge(pages, rules.limit(0)).filter("verdict = 'allow'").count() == 4
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    assert set(quality.fit(docs, quality.trusted_ids(none))) == {0}


def test_keep_gives_clashing_columns_back(spark):
    text = "plain words that are long enough for the base rules and nothing else at all"
    docs = spark.createDataFrame([(1, text, -7, "mine", 5.5)], "doc_id long, text string, n_words int, kept string, `odd.name` double")
    assert [tuple(r) for r in quality.keep(docs, [0] * quality.BUCKETS).collect()] == [(1, text, -7, "mine", 5.5)]


def test_an_index_keeps_its_number_of_buckets(spark):
    index = digest_index.fresh_index(spark, buckets=8)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    assert digest_index.deduplicate(docs, index, "one").count() == 200
    index.forget()
    with pytest.raises(ValueError, match="8 buckets, not 64"):
        digest_index.DigestIndex(spark, "reopened", index.location, 64)
    again = digest_index.DigestIndex(spark.newSession(), "reopened", index.location)
    assert again.buckets == 8
    assert digest_index.deduplicate(docs.withColumn("doc_id", docs.doc_id + 1000), again, "two").count() == 0
    assert again.table().count() == 200


def test_clashing_column_names_come_back(spark):
    long = "some words that are long enough to be linked with a near copy of themselves in this test of names"
    odd = "doc_id long, text string, __n int, __id string, __h int, n int, doc int, digest string, rows int, page int, `a.b` int"
    docs = spark.createDataFrame([(1, long, 1, "x", 2, 3, 4, "y", 5, 6, 7), (2, long + " more", 1, "x", 2, 3, 4, "y", 5, 6, 7)], odd)
    kept = digest_index.deduplicate(docs, digest_index.fresh_index(spark), "a")
    assert kept.columns == docs.columns and sorted(kept.collect()) == sorted(docs.collect())
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.collect() == docs.filter("doc_id = 1").collect()
    pages = docs.withColumnRenamed("text", "url").withColumn("rule", docs.n)
    judged = url_filter.judge(pages, spark.createDataFrame(url_filter.RULES, url_filter.RULE_SCHEMA))
    assert judged.columns == [c for c in pages.columns if c != "rule"] + ["host", "path", "rule", "verdict"] and judged.count() == 2


def test_hot_urls_and_pages_without_a_host(spark):
    urls = ["http://hot.com/x", None, "no host", "http://a.net/es/1"]
    pages = spark.createDataFrame([(i, urls[i % 4] if i % 3 else "http://hot.com/x") for i in range(4000)], "page_id long, url string")
    got = url_filter.judge(pages, spark.createDataFrame(url_filter.RULES, url_filter.RULE_SCHEMA)).groupBy("url", "rule", "verdict").count().collect()
    counts = {u: sum(1 for i in range(4000) if (urls[i % 4] if i % 3 else urls[0]) == u) for u in urls}
    assert {(r.url, r.rule, r.verdict): r["count"] for r in got} == {(urls[0], "com/", "allow"): counts[urls[0]], (None, None, "allow"): counts[None], ("no host", None, "allow"): counts["no host"], (urls[3], "net/es/", "block"): counts[urls[3]]}
