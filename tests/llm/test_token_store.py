import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from curbside.llm import token_store as ts
from curbside.runtime import scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    (5, "Hello  world\n\n x <|endoftext|> don't stop, 12345!"),
    (1, None),
    (2, ""),
    (3, "a  b \x0b c d \n"),
    (3, "the same id again"),
    (3, "the same id again"),
    (None, "no id"),
    (9, "word " * 3000 + "é" * 500 + " " * 40 + "end"),
    (-4, "  leading, trailing  \t\n "),
]


def twins(n=12):
    """A Thue-Morse word of letters a and b, and its complement: equal under a polynomial modulo 2**64."""
    bits = [bin(i).count("1") % 2 for i in range(2**n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def expected(rows):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return {(i, x): [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in rows}


def run(spark, rows):
    docs = spark.createDataFrame([(i, x, "clash") for i, x in rows], "doc_id long, text string, shard string")
    base = scratch(spark, "store")
    entries = ts.write_store(docs, base, PATH, 2).cache()
    index = ts.build_index(entries, base)
    places = ts.locate(docs.select("doc_id"), index).unionByName(entries.filter("doc_id IS NULL").select("doc_id", "shard", "offset", "n_tokens", "start"))
    return sorted(ts.read_back(places).collect(), key=lambda r: r.start), index, entries


def test_store_agrees_with_the_library(spark):
    got, _, _ = run(spark, TEXTS)
    want = expected(TEXTS)
    crc = lambda ids: zlib.crc32(np.asarray(ids, "<u4").tobytes())
    assert sorted((r.doc_id or -99, r.n_tokens, r.ids_crc32) for r in got) == sorted((i or -99, len(want[i, x]), crc(want[i, x])) for i, x in TEXTS)
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens


def test_lookup_of_strangers_and_empty_table(spark):
    _, index, _ = run(spark, TEXTS)
    keys = spark.createDataFrame([(k,) for k in (100, 9, 10**12, -1)], "doc_id long")
    assert [r.doc_id for r in ts.locate(keys, index).collect()] == [9]
    got, index, _ = run(spark, [])
    assert got == [] and index.count() == 0


def test_perfect_hash_is_minimal_and_one_to_one():
    keys = np.unique(np.random.default_rng(3).integers(-(2**63), 2**63, 20000))
    ph = ts.PerfectHash.of(keys)
    assert sorted(ph.slots(keys)) == list(range(len(keys)))


def test_words_that_share_a_polynomial_hash(spark):
    one, two = twins()
    rows = [(i, f"{a} {b}") for i, (a, b) in enumerate(((one, one), (one, two), (two, one), (two, two)))]
    got, _, _ = run(spark, rows)
    want = expected(rows)
    crc = lambda ids: zlib.crc32(np.asarray(ids, "<u4").tobytes())
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(i, len(want[i, x]), crc(want[i, x])) for i, x in rows]


def test_whole_small_table(spark, sf_dir):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    want, start = expected(rows), 0
    got = {r.doc_id: r for r in ts.op8_token_store(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        ids = want[i, text]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)


def test_ids_that_do_not_fit(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(ValueError, match="don't fit"):
        ts.write_store(docs, scratch(spark, "store"), PATH, 2, "<u1")
