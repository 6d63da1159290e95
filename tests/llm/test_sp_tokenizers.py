import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import decoders

from curbside.llm import sp_tokenizers as sp
from tests.llm.test_token_store import twins

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "Hello   world \n x　y ﬁ", "", None, " ", "   ", "a", "▁ literal marker", "<s> <0x0A> </s> <unk>", "émile \U0001f9ff zz\x00z",
    "trailing   ", "aaaaaaaaaaaaaaaa aaaaaaa", "1234567 12,3", "x" * 500 + " " * 70 + "y", "same", "same", "中文字符測試 한국어",
]


def test_against_sentencepiece(spark, sf_dir):
    judge = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)]
    rows += [(100 + r.doc_id, r.text, "x") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in sp.encode(docs, PATH).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        want = judge.encode(text or "")
        assert got[i].ids == want and got[i].n_tokens == len(want), text
        assert got[i].round_trip == (judge.decode(want) == (text or "")), text


def test_backend_alone_and_decode(spark):
    codec = sp.Codec(PATH)
    text = "The backend by itself agrees, in one piece."
    judge = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert codec.ids([codec.normalise(text)])[0] == judge.encode(text)
    ids = spark.createDataFrame([(judge.encode(t or ""),) for t in TEXTS[:2]] + [(None,)], "ids array<int>")
    assert [r.text for r in sp.decode(ids, PATH).collect()] == ["Hello   world \n x　y ﬁ", "", ""]


def test_empty(spark):
    assert sp.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_a_marker_leaves_its_neighbours_alone(spark, monkeypatch):
    plain, seen = "clean words beside", []
    docs = spark.createDataFrame([(1, plain), (2, "▁ literal"), (3, "")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in sp.encode(docs, PATH).collect()}
    judge = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert [got[i].ids for i in (1, 2, 3)] == [judge.encode(plain), judge.encode("▁ literal"), []] and [got[i].round_trip for i in (1, 2, 3)] == [True, False, True]
    # The work itself, in this process: only the text with the marker goes whole.
    monkeypatch.setattr(sp.Codec, "whole", lambda self, text, f=sp.Codec.whole: (seen.append(text), f(self, text))[1])
    work = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: work.append(f))
    sp.encode(docs, PATH)
    rows = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": [plain.encode(), "▁ literal".encode(), b""]})
    assert sum(b.num_rows for b in work[0](iter([rows]))) == 3 and seen == ["▁ literal"]


def test_a_wrong_backend_fails_and_its_decoder_is_used(monkeypatch):
    codec = sp.Codec(PATH, verify_every=1)
    monkeypatch.setattr(codec, "ids", lambda marked: [[5] for _ in marked])
    with pytest.raises(ValueError, match="unlike SentencePiece"):
        codec._many([b" one", b" two"])
    codec = sp.Codec(PATH)
    codec.tokenizer.decoder = decoders.Fuse()
    assert not codec.spaced(np.frombuffer(b" words", np.uint8), np.asarray([0, 6]))[2][0]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram_model(path):
    """A small unigram model with byte fallback, written as SentencePiece's protobuf."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    words = {"▁": -2.1, "▁the": -3.3, "▁th": -5.2, "e": -4.1, "▁cat": -6.7, "c": -7.3, "a": -6.2, "t": -6.9, "at": -5.6, "h": -7.1, "s": -5.05, "▁s": -6.4, "▁sat": -7.7, "é": -8.3, "on": -6.6, "o": -7.9, "n": -7.6}
    pieces += [(p, s, 1) for p, s in words.items()]
    body = b"".join(field(1, field(1, p.encode()) + varint(2 << 3 | 5) + np.float32(s).tobytes() + field(3, k)) for p, s, k in pieces)
    body += field(2, field(3, 1) + field(35, 1) + field(40, 0) + field(41, 1) + field(42, 2))
    body += field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))
    path.write_bytes(body)
    return str(path)


def test_unigram_scores_and_byte_fallback(spark, tmp_path):
    path = unigram_model(tmp_path / "unigram.model")
    judge = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(4)
    texts = ["the cat sat on the", "the  cats", "é at", "thé zebra 中", "", None, *("".join(rng.choice(list("theca son "), 60)) for _ in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in sp.encode(docs, path, verify_every=1).collect()}
    assert [got[i].ids for i in range(len(texts))] == [judge.encode(t or "") for t in texts]
    back = sp.decode(docs.join(sp.encode(docs, path).select("doc_id", "ids"), "doc_id"), path, out_col="back").collect()
    assert all(r.back == (r.text or "") for r in back)


def test_odd_letters_by_bpe_equal_sentencepiece():
    judge, codec = sentencepiece.SentencePieceProcessor(model_file=PATH), sp.Codec(PATH)
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("aeinrst  ABé1.,中"), 80)) for _ in range(800)]
    assert [codec.whole(t)[0].tolist() for t in texts] == judge.encode(texts)


def test_words_that_share_a_polynomial_hash(spark):
    one = twins()[0]
    judge = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [f"{a} {b}" for a, b in ((one, one), (one, twins()[1]), (twins()[1], one))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in sp.encode(docs, PATH).collect()}
    assert [got[i].ids for i in range(3)] == [judge.encode(t) for t in texts] and all(r.round_trip for r in got.values())
