"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed here, and a tokenizers backend is rebuilt
from it: the normaliser with its character map, the metaspace marker, unigram
scores or byte-pair merges, and byte fallback. Batches are encoded in threads,
each distinct chunk (a run of markers and what follows up to the next) once for
each worker. Ids and decoded texts are always the backend's.

Parity: with ``verify_every`` every so many-th distinct chunk, picked by its
CRC-32, is also encoded by SentencePiece, and a difference fails the task; the
ids are never taken from there. 0 leaves the check out.

Defined cases: a null or empty text has no ids and decodes to the empty text.
Repeated rows encode alike. The marker character itself in a text decodes to a
space, as in SentencePiece, and ``round_trip`` is false there. Very long texts
are encoded in chunks; one without any space is a single chunk, held whole by
its task. An empty table gives an empty result. Columns beside the id and the
text are not read by ``encode``, whatever their names.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from curbside.llm.chunk_ids import ChunkIds
from curbside.llm.token_store import byte_pieces
from curbside.llm.words import whole

MARK = "▁"
#: Threads of the library in each task.
THREADS = 2
#: The registered query has one of so many distinct chunks verified: every one.
VERIFY_EVERY = 1

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: integers, or bytes of the other wire types."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        size = varint() if size is None else size
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    """Pieces and settings of a SentencePiece model file."""

    def __init__(self, path: str):
        self.path = path
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.unk_id, self.unk_surface = UNIGRAM, False, 0, " ⁇ "
        self.charsmap, self.dummy_prefix, self.squeeze, self.escape = b"", True, True, True
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    piece = dict(_fields(value))
                    self.pieces.append((piece[1].decode(), float(np.frombuffer(piece.get(2, b"\0" * 4), "<f4")[0]), piece.get(3, NORMAL)))
                elif number == 2:
                    spec = dict(_fields(value))
                    self.kind, self.byte_fallback, self.unk_id = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), spec.get(40, 0)
                    self.unk_surface = spec.get(44, self.unk_surface.encode()).decode()
                elif number == 3:
                    spec = dict(_fields(value))
                    self.charsmap = spec.get(2, b"")
                    self.dummy_prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))

    @property
    def cuttable(self) -> bool:
        """Whether chunks are independent and each can be checked by itself."""
        plain = not self.charsmap and self.dummy_prefix and not self.squeeze and self.escape
        return plain and not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER))

    def merges(self) -> list[tuple[str, str]]:
        """All ways to put two pieces together to a third, best scored third first."""
        known = {p: s for p, s, kind in self.pieces if kind in (NORMAL, USER)}
        found = []
        for i, (piece, score, kind) in enumerate(self.pieces):
            if kind in (NORMAL, USER):
                found += [(-score, i, k, piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in known and piece[k:] in known]
        return [(a, b) for *_, a, b in sorted(found)]

    def backend(self):
        """A tokenizers.Tokenizer for texts whose spaces are markers already."""
        from tokenizers import Tokenizer, decoders, models

        if self.kind == UNIGRAM:
            core = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unk_id, self.byte_fallback)
        elif self.kind == BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            core = models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unk_id][0], byte_fallback=self.byte_fallback, fuse_unk=True)
        else:
            raise ValueError(f"model type {self.kind} is neither unigram nor BPE")
        out = Tokenizer(core)
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        return out

    def normaliser(self):
        """Text to marked text: character map, squeezed spaces, prefix, markers."""
        if not self.charsmap and not self.squeeze:
            prefix = MARK if self.dummy_prefix else ""
            return lambda text: prefix + text.replace(" ", MARK) if text else ""
        from tokenizers import Regex, normalizers

        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        steps.append(normalizers.Replace(" ", MARK))
        return normalizers.Sequence(steps).normalize_str


def chunk_starts(b: np.ndarray) -> np.ndarray:
    """Spaces after other bytes: no piece has a marker after another character."""
    space = b == 32
    mark = space.copy()
    mark[1:] &= ~space[:-1]
    return mark


class Codec:
    """Encodes and decodes texts; lives in a worker process."""

    def __init__(self, path: str, verify_every: int = 0):
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        self.model, self.verify_every = Model(path), verify_every
        self.tokenizer, self.normalise = self.model.backend(), self.model.normaliser()
        self._chunks, self._judge = ChunkIds(chunk_starts, self._many), None

    def ids(self, marked: list[str]) -> list[list[int]]:
        """What the backend makes of marked texts."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(marked, add_special_tokens=False)]

    def _many(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the chunks, the ids of each, and a mark where ids don't decode to the chunk."""
        texts = [c.decode() for c in chunks]
        found = self.ids([t.replace(" ", MARK) for t in texts])
        # A chunk starts with a space, which SentencePiece puts before a text itself; the space alone is its empty text.
        self.verify([(t[1:], ids) for t, ids in zip(texts, found, strict=True) if len(t) > 1])
        marks = np.fromiter((a != b for a, b in zip(self.tokenizer.decode_batch(found), texts, strict=True)), np.int64, len(texts))
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.int32, int(counts.sum())), counts, marks

    def verify(self, encoded: list[tuple[str, list[int]]]) -> None:
        """Fails where SentencePiece encodes one of the picked texts differently."""
        if not self.verify_every:
            return
        picked = [(t, ids) for t, ids in encoded if zlib.crc32(t.encode()) % self.verify_every == 0]
        if picked and self._judge is None:
            import sentencepiece

            self._judge = sentencepiece.SentencePieceProcessor(model_file=self.model.path)
        for text, ids in picked:
            if self._judge.encode(text) != ids:
                raise ValueError(f"the backend encodes {text[:80]!r} unlike SentencePiece")

    def spaced(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids of each, whether each decodes to itself) of texts with a space before them."""
        ids, counts, marks = self._chunks(data, bounds)
        return ids, counts, marks == 0

    def whole(self, text: str) -> tuple[np.ndarray, bool]:
        """(ids, whether they decode to the text) of any text."""
        found = self.ids([self.normalise(text)])[0]
        self.verify([(text, found)])
        return np.asarray(found, np.int32), self.decode([found])[0] == text

    def decode(self, ids: list[list[int]]) -> list[str]:
        cut = 1 if self.model.dummy_prefix else 0
        return [t[cut:] for t in self.tokenizer.decode_batch(ids)]


_codecs: dict[tuple[str, int], Codec] = {}


def _codec(path: str, verify_every: int = 0) -> Codec:
    """The worker process's codec: what it remembers serves all its tasks."""
    key = (path, verify_every)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", verify_every: int = 0) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip.

    A map over the documents, without a shuffle. ``round_trip`` says whether
    decoding the ids gives the text back.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codec, at = _codec(path, verify_every), 0
            for data, bounds in byte_pieces(batch.column("text"), 1 << 20):
                n = len(bounds) - 1
                # Markers in a text are spaces to SentencePiece; such texts, and models whose chunks aren't independent, go whole.
                alone = np.full(n, not codec.model.cuttable)
                for place in re.finditer(MARK.encode(), data):
                    alone[np.searchsorted(bounds, place.start(), "right") - 1] = True
                size = np.where(alone, 0, np.diff(bounds))
                full = size > 0
                own = np.concatenate([[0], np.cumsum(size)])
                spaced = own + np.concatenate([[0], np.cumsum(full)])
                rest = data[np.repeat(~alone, np.diff(bounds))] if alone.any() else data
                ids, counts, same = codec.spaced(np.insert(rest, own[:-1][full], 32), spaced)
                if alone.any():
                    parts = np.split(ids, np.cumsum(counts)[:-1])
                    for i in np.flatnonzero(alone):
                        parts[i], same[i] = codec.whole(data[bounds[i] : bounds[i + 1]].tobytes().decode())
                        counts[i] = len(parts[i])
                    ids = np.concatenate(parts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids))
                columns = [batch.column("doc_id").slice(at, n), lists, pa.array(counts, pa.int32()), pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n_tokens", "round_trip"])
                at += n

    rows = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).cast("binary").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(work, f"doc_id {kind}, ids array<int>, n_tokens int, round_trip boolean")


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Adds the decoded text of an array of ids; null ids decode to the empty text."""

    @F.pandas_udf("string")
    def decoded(ids):
        return ids.__class__(_codec(path).decode([[] if x is None else [int(i) for i in x] for x in ids]))

    return rows.withColumn(out_col, decoded(F.col(ids_col)))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), verify_every=VERIFY_EVERY)
