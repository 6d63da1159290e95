"""The job around both substring dedups: what is removed where, over all documents.

1. Each task keeps its documents in files of the shared folder, with the pieces
   of their windows (see ``winnow``). Pieces alike in their tokens are one entry
   of a file, with the least and the largest document id that has it; entries
   are dealt to parts by the anchor's hash.
2. A part keeps the anchors of two documents or more. Entries alike are a class.
3. The tokens of all these classes, one copy each, are fetched from the files.
4. A part finds the least document id of every window of its classes, by the
   method of the operator, and tells each file about its entries whose windows
   a smaller document has.
5. Each file's documents are read once more, cut, and reported.

Texts are neither shuffled nor joined: some 20 bytes for an entry are, and one
copy of the tokens of a class. A passage that many documents share is one entry
in each file that has it and one class in its part, whatever the number of its
holders. Pieces are alike by 96 bits of BLAKE2b over their tokens.

The number of parts follows the bytes of all texts, so a part's share stays the
same at every size; a task works on one part at a time. A file of documents has
the name of its partition, so that a repeated task writes the same file again;
the documents must come in the same partitions then, as those of a table do.
The other files are named in rows that Spark commits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from curbside.llm import files
from curbside.llm.token_store import byte_pieces
from curbside.llm.winnow import KINDS, SEGMENT, gram_hashes, kinds_of, pieces, word_places, word_tokens
from curbside.llm.word_hashes import WordHashes
from curbside.runtime import cut, scratch

#: Bytes of text that are worked on at one time, that a file holds, and whose pieces a part gets, about.
BLOCK, FILE, PART = 2 << 20, 16 << 20, 16 << 20
#: Spark partitions at most that parts are dealt to; a task takes its parts one by one.
MOST_PARTITIONS = 20_000
#: Bytes, about, in which frequent kinds of grams are looked for, and the share from which a kind is frequent.
SAMPLE, FREQUENT = 32 << 20, 5e-6
#: The id that stands for a null id: never smaller than another.
NO_ID = np.iinfo(np.int64).max

_ROWS = "part int, uri string, kind int, data binary, more binary"
_FILE, _REQUESTS, _TOKENS, _PART, _ANSWERS = range(5)
#: Columns of entries on their way to a part, of requests, of a part's entries, and of pieces in a file.
_ENTRY = ("<u4", "<u2", "<u8", "<u4", "<u2", "<u4", "<i8", "<i8")
_REQUEST = np.dtype([("c", "<u4"), ("entry", "<u4"), ("n", "<u2")])
_CLASS = np.dtype([("n", "<u2"), ("group", "<u4"), ("id", "<i8")])
_HELD = np.dtype([("c", "<u4"), ("entry", "<u4"), ("id", "<i8")])

#: (group of each piece, its tokens by range of pieces, their sizes, least id of each piece) -> least id of each window.
Finder = Callable[[np.ndarray, Callable[[int, int], np.ndarray], np.ndarray, np.ndarray], np.ndarray]


def _batch(*columns) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "uri", "kind", "data", "more"])


def _row(part: int, uri: str, kind: int, data: bytes = b"", more: bytes = b"") -> pa.RecordBatch:
    return _batch([part], [uri], [kind], [data], [more])


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., for size[0] numbers, then those of the others."""
    total = np.cumsum(size)
    return np.repeat(start - (total - size), size) + np.arange(total[-1] if len(total) else 0)


def _squeezed(*columns: np.ndarray) -> bytes:
    """Arrays of one length, each by itself and then compressed: random hashes stay, the rest nearly vanishes."""
    raw = b"".join(c.tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unsqueezed(data: bytes, *kinds) -> list[np.ndarray]:
    n, sizes = int.from_bytes(data[:8], "little"), [np.dtype(k).itemsize for k in kinds]
    raw, out, at = pa.decompress(data[8:], n * sum(sizes), codec="zstd", asbytes=True), [], 0
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * size
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


class _Entries:
    """Distinct pieces of a file, in the order of their first places."""

    def __init__(self, h: np.ndarray, g: np.ndarray, n: np.ndarray, ids: np.ndarray):
        order = np.argsort(g["g1"], kind="stable")
        one, two, new = g["g1"][order], g["g2"][order], np.ones(len(order), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        start = np.flatnonzero(new)
        first = order[start]  # the sort is stable
        rank = np.empty(len(first), np.int64)
        rank[np.argsort(first)] = np.arange(len(first))
        #: Entry of each piece.
        self.of = np.empty(len(order), np.int64)
        self.of[order] = rank[np.cumsum(new) - 1]
        where = np.argsort(first)
        lo, hi = (f.reduceat(ids[order], start) if len(start) else np.zeros(0, np.int64) for f in (np.minimum, np.maximum))
        self.lo, self.hi, place = lo[where], hi[where], np.sort(first)
        self.h, self.g1, self.g2, self.n = h[place], g["g1"][place], g["g2"][place], n[place]

    def packed(self, e: np.ndarray) -> bytes:
        """Some entries in rising order, as columns that compress well."""
        h, lo = self.h[e], self.lo[e]
        return _squeezed(h.astype("<u4"), (h >> np.uint64(32)).astype("<u2"), self.g1[e], self.g2[e], self.n[e], _steps(e.astype("<u4")), _steps(lo), self.hi[e] - lo)

    @staticmethod
    def unpacked(data: bytes) -> dict[str, np.ndarray]:
        low, high, g1, g2, n, e, lo, more = _unsqueezed(data, *_ENTRY)
        lo = np.cumsum(lo)
        return {"h": low | (high.astype(np.uint64) << np.uint64(32)), "g1": g1, "g2": g2, "n": n, "entry": np.cumsum(e, dtype=np.uint32), "lo": lo, "hi": lo + more}


class _Store:
    """A file of documents, Arrow batches of (doc_id, text), and beside it one of their pieces."""

    def __init__(self, base: str, name: str):
        self.sink, self.other = files.Sink(base, ".docs", name), files.Sink(base, ".pieces", name)
        self.uri, self.bytes, self._found = self.sink.uri, 0, []

    def add(self, ids: pa.Array, texts: pa.Array, found: tuple[np.ndarray, ...]) -> None:
        """A block of documents with (h, g, n, id) of its pieces."""
        out = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays([ids, texts], names=["doc_id", "text"])
        with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as w:
            w.write_batch(batch)
        data = out.getvalue().to_pybytes()
        self.sink.write(len(data).to_bytes(8, "little") + data)
        self._found.append(found)

    def close(self) -> _Entries:
        entries = _Entries(*(np.concatenate(c) for c in zip(*self._found, strict=True)))
        n = np.concatenate([f[2] for f in self._found])
        fresh = entries.of >= np.append(0, np.maximum.accumulate(entries.of + 1)[:-1])
        expected = np.cumsum(fresh) - fresh
        self.other.write(_squeezed(n, (entries.of - expected).astype("<i4")))
        self.sink.close()
        self.other.close()
        return entries

    @staticmethod
    def read(uri: str) -> Iterator[pa.RecordBatch]:
        with files.open_input(uri) as f:
            while head := f.read(8):
                yield from pa.ipc.open_stream(f.read(int.from_bytes(head, "little")))

    @staticmethod
    def read_pieces(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(windows of each piece, its entry, whether it is the entry's first)."""
        with files.open_input(uri.removesuffix(".docs") + ".pieces") as f:
            n, step = _unsqueezed(f.read(), "<u2", "<i4")
        fresh = step == 0
        return n.astype(np.int64), np.cumsum(fresh) - fresh + step, fresh


class Passages:
    """``tokens`` are "bytes" or "words"; a window of ``window`` of them, anchored by ``k``, is what repeats."""

    def __init__(self, tokens: str, window: int, k: int, find: Finder):
        self.words, self.window, self.k, self.find = tokens == "words", window, k, find

    def _tokens(self, data: np.ndarray, bounds: np.ndarray, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
        return word_tokens(data, bounds, known) if self.words else (data, bounds)

    def frequent(self, rows: DataFrame, total: int) -> np.ndarray | None:
        """Marks of the frequent kinds of grams, from a sample of ``SAMPLE`` bytes or so.

        They change which anchors windows take and so how evenly the work is
        dealt, never a result.
        """

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, known = np.zeros(KINDS, np.int64), WordHashes()
            for batch in batches:
                for data, bounds in byte_pieces(batch.column("text"), BLOCK):
                    tokens = self._tokens(data, bounds, known)[0]
                    for at in range(0, len(tokens), SEGMENT):
                        seen += np.bincount(kinds_of(gram_hashes(tokens[at : at + SEGMENT + self.k - 1], self.k)), minlength=KINDS)
            some = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["kind", "n"])

        sample = rows.select("text") if total <= SAMPLE else rows.select("text").sample(SAMPLE / total, 11)
        per = cut(sample.mapInArrow(count, "kind long, n long").groupBy("kind").agg(F.sum("n").alias("n")), "kinds")
        many = per.agg(F.sum("n")).first()[0] or 0
        late = np.zeros(KINDS, bool)
        # At most 1 / FREQUENT rows.
        late[[r.kind for r in per.filter(F.col("n") > max(20, many * FREQUENT)).collect()]] = True
        return late if late.any() else None

    def deal(self, docs: DataFrame, base: str, parts: int, late: np.ndarray | None) -> DataFrame:
        """Entries by part, and a row for each file, dealt to any part."""
        width = 8 if self.words else 1

        def digests(tokens: np.ndarray, p: np.ndarray) -> np.ndarray:
            raw, blake2b = tokens.tobytes(), hashlib.blake2b
            start, end = p["first"] * width, (p["first"] + p["n"] + self.window - 1) * width
            found = b"".join([blake2b(raw[i:j], digest_size=12).digest() for i, j in zip(start.tolist(), end.tolist(), strict=True)])
            return np.frombuffer(found, [("g1", "<u8"), ("g2", "<u4")])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, number, task, known = None, 0, TaskContext.get().partitionId(), WordHashes()

            def close() -> pa.RecordBatch:
                entries = store.close()
                part = (entries.h % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                full, start = np.unique(part[order], return_index=True)
                cuts = np.split(order, start[1:]) if len(full) else []
                k = len(full) + 1
                return _batch([task % parts, *full], [store.uri] * k, [_FILE] + [_PART] * (k - 1), [b""] + [entries.packed(e) for e in cuts], [b""] * k)

            for batch in batches:
                at, ids = 0, batch.column("doc_id")
                for data, bounds in byte_pieces(batch.column("text"), BLOCK):
                    if store is not None and store.bytes > FILE:
                        yield close()
                        store = None
                    if store is None:
                        store, number = _Store(base, f"{task:06d}-{number:04d}"), number + 1
                    n = len(bounds) - 1
                    tokens, of = self._tokens(data, bounds, known)
                    p = pieces(tokens, of, self.window, self.k, late)
                    own = np.asarray(ids.slice(at, n).fill_null(NO_ID)).astype("<i8")[p["doc"]]
                    store.add(ids.slice(at, n), batch.column("text").slice(at, n), (p["h"] & np.uint64((1 << 48) - 1), digests(tokens, p), p["n"], own))
                    store.bytes += len(data)
                    at += n
            if store is not None:
                yield close()

        return docs.mapInArrow(work, _ROWS)

    def _share(self, part: int, base: str, blocks: list[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
        """Classes and their entries of one part, in a file, and the requests for tokens."""
        uris = sorted({u for u, _ in blocks})
        number = {u: i for i, u in enumerate(uris)}
        found = [_Entries.unpacked(d) for _, d in blocks]
        file = np.concatenate([np.full(len(x["h"]), number[u], np.int32) for (u, _), x in zip(blocks, found, strict=True)])
        e = {c: np.concatenate([x[c] for x in found]) for c in found[0]}
        del found
        order = np.argsort(e["h"], kind="stable")
        h = e["h"][order]
        new = np.append(True, h[1:] != h[:-1])
        start = np.flatnonzero(new)
        several = np.minimum.reduceat(e["lo"][order], start) != np.maximum.reduceat(e["hi"][order], start)
        order = order[several[np.cumsum(new) - 1]]
        if not len(order):
            return
        order = order[np.lexsort((e["g2"][order], e["g1"][order], e["h"][order]))]
        e, file = {c: x[order] for c, x in e.items()}, file[order]
        differs = lambda c: np.append(True, e[c][1:] != e[c][:-1])
        new_h = differs("h")
        first = np.flatnonzero(new_h | differs("g1") | differs("g2"))
        classes = np.zeros(len(first), _CLASS)
        classes["n"], classes["id"], classes["group"] = e["n"][first], np.minimum.reduceat(e["lo"], first), (np.cumsum(new_h) - 1)[first]
        held = np.zeros(len(file), _HELD)
        held["c"], held["entry"], held["id"] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(file)))), e["entry"], e["hi"]
        ask = np.zeros(len(first), _REQUEST)
        ask["c"], ask["entry"], ask["n"] = np.arange(len(first)), e["entry"][first], classes["n"]
        sink = files.Sink(base, ".part")
        head = _squeezed(classes)
        sink.write(len(head).to_bytes(8, "little") + head)
        for u, rows in self._by_file(held, file):
            data, name = _squeezed(*(np.ascontiguousarray(rows[c]) for c in _HELD.names)), uris[u].encode()
            sink.write(len(name).to_bytes(8, "little") + name + len(data).to_bytes(8, "little") + data)
        sink.close()
        yield _row(part, sink.uri, _PART)
        for u, rows in self._by_file(ask, file[first]):
            yield _row(part, uris[u], _REQUESTS, rows.tobytes())

    @staticmethod
    def _by_file(rows: np.ndarray, file: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(file, kind="stable")
        file, rows = file[order], rows[order]
        for u in np.unique(file).tolist():
            i, j = np.searchsorted(file, [u, u + 1])
            yield u, rows[i:j]

    @staticmethod
    def _read_part(uri: str) -> Iterator:
        """The classes of a part's file, then (uri, entries) of each file of documents."""
        with files.open_input(uri) as f:
            take = lambda: f.read(int.from_bytes(size, "little")) if (size := f.read(8)) else None
            yield _unsqueezed(take(), _CLASS)[0]
            while (name := take()) is not None:
                columns = _unsqueezed(take(), *(_HELD[n] for n in _HELD.names))
                yield name.decode(), dict(zip(_HELD.names, columns, strict=True))

    def _windows(self, of: np.ndarray) -> np.ndarray:
        """Windows of each text."""
        return np.maximum(np.diff(of) - self.window + 1, 0)

    def _fetch(self, uri: str, asked: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        """The tokens that the parts want from one file."""
        asks = np.concatenate([np.frombuffer(d, _REQUEST) for _, d in asked])
        part = np.concatenate([np.full(len(d) // _REQUEST.itemsize, k, np.int32) for k, d in asked])
        n, _, fresh = _Store.read_pieces(uri)
        window = (np.cumsum(n) - n)[fresh][asks["entry"]]  # of all windows of the file, the first of each wanted piece
        order = np.argsort(window, kind="stable")
        asks, part, window, base, known = asks[order], part[order], window[order], 0, WordHashes()
        for batch in _Store.read(uri):
            for data, bounds in byte_pieces(batch.column("text"), BLOCK):
                tokens, of = self._tokens(data, bounds, known)
                ends = np.cumsum(self._windows(of))
                i, j = np.searchsorted(window, [base, base + ends[-1]])
                at = window[i:j] - base
                base += ends[-1]
                if i == j:
                    continue
                doc = np.searchsorted(ends, at, "right")
                start = of[doc] + at - (ends - self._windows(of))[doc]
                order = np.argsort(part[i:j], kind="stable")
                some, to, start = asks[i:j][order], part[i:j][order], start[order]
                size = some["n"].astype(np.int64) + self.window - 1
                flat, stops = tokens[_ragged(start, size)], np.cumsum(size)
                edges = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to))
                for x, y in zip(edges, edges[1:], strict=False):
                    yield _row(int(to[x]), "", _TOKENS, some["c"][x:y].tobytes(), flat[stops[x] - size[x] : stops[y - 1]].tobytes())

    def _settle(self, classes: np.ndarray, tokens: list[tuple[bytes, bytes]]) -> np.ndarray:
        """Least id of each window of each class."""
        n = classes["n"].astype(np.int64)
        c = np.concatenate([np.frombuffer(x, "<u4") for x, _ in tokens]).astype(np.int64)
        flat = np.concatenate([np.frombuffer(x, "<u8" if self.words else np.uint8) for _, x in tokens])
        size = n[c] + self.window - 1
        start, order = np.cumsum(size) - size, np.argsort(c)
        if not np.array_equal(c[order], np.arange(len(classes))):
            raise ValueError("each class needs its tokens once")
        start, size = start[order], size[order]
        return self.find(classes["group"], lambda a, b: flat[_ragged(start[a:b], size[a:b])], size, classes["id"])

    def run(self, docs: DataFrame, report: Callable, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per document: ``report(ids, data, bounds, of, gone)`` makes the columns of ``schema`` for a block.

        ``of`` are the bounds of the texts in tokens, ``gone`` marks the tokens to remove.
        """
        spark = docs.sparkSession
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        parts, base = max(least, -(-total // PART)), scratch(spark, "passages")
        partitions, by_file = min(parts, MOST_PARTITIONS), min(max(least, -(-total // FILE)), MOST_PARTITIONS)
        dealt = self.deal(rows, base, parts, self.frequent(rows, total))

        def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, found in _runs(batches, "part"):
                for r in found:
                    if r["kind"] == _FILE:
                        yield _row(-1, r["uri"], _FILE)
                blocks = [(r["uri"], r["data"]) for r in found if r["kind"] == _PART]
                if blocks:
                    yield from self._share(part, base, blocks)

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for uri, found in _runs(batches, "uri"):
                yield from self._fetch(uri, [(r["part"], r["data"]) for r in found])

        def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, found in _runs(batches, "part"):
                held = self._read_part(next(r["uri"] for r in found if r["kind"] == _PART))
                classes = next(held)
                least = self._settle(classes, [(r["data"], r["more"]) for r in found if r["kind"] == _TOKENS])
                n = classes["n"].astype(np.int64)
                first = np.cumsum(n) - n
                lowest = np.minimum.reduceat(least, first)
                for uri, e in held:
                    tell = lowest[e["c"]] < e["id"]
                    if tell.any():
                        c = e["c"][tell].astype(np.int64)
                        yield _row(part, uri, _ANSWERS, _squeezed(e["entry"][tell]), _squeezed(least[_ragged(first[c], n[c])]))

        types = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in spark.createDataFrame([], schema).schema])

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for uri, found in _runs(batches, "uri"):
                answers = [(_unsqueezed(r["data"], "<u4")[0], _unsqueezed(r["more"], "<i8")[0]) for r in found if r["kind"] == _ANSWERS]
                for block, gone in self._blocks(uri, answers):
                    columns = report(*block, gone)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, types, strict=True)], schema=types)

        by_part = dealt.repartitionById(partitions, F.col("part") % partitions).sortWithinPartitions("part", "uri")
        shared = cut(by_part.mapInArrow(share, _ROWS), "shared")
        asked = shared.filter(F.col("kind") == _REQUESTS).repartition(by_file, "uri").sortWithinPartitions("uri")
        told = asked.mapInArrow(fetch, _ROWS).unionByName(shared.filter(F.col("kind") == _PART))
        answers = cut(told.repartitionById(partitions, F.col("part") % partitions).sortWithinPartitions("part", "kind").mapInArrow(settle, _ROWS), "answers")
        every = answers.unionByName(shared.filter(F.col("kind") == _FILE))
        return every.repartition(by_file, "uri").sortWithinPartitions("uri").mapInArrow(finish, schema)

    def _blocks(self, uri: str, answers: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[tuple, np.ndarray]]:
        """((ids, data, bounds, token bounds), removed tokens) of each block of a file."""
        n, entry, fresh = _Store.read_pieces(uri)
        # Where the answer to each entry starts in all answers; -1 without one.
        start, size = np.full(int(fresh.sum()), -1, np.int64), n[fresh]
        entries = np.concatenate([a for a, _ in answers]) if answers else np.zeros(0, np.uint32)
        least = np.concatenate([b for _, b in answers]) if answers else np.zeros(0, np.int64)
        start[entries] = np.cumsum(size[entries]) - size[entries]
        ends, base = np.cumsum(n), 0
        for batch in _Store.read(uri):
            at, ids = 0, batch.column("doc_id")
            for data, bounds in byte_pieces(batch.column("text"), BLOCK):
                m = len(bounds) - 1
                own = ids.slice(at, m)
                of = word_places(data, bounds)[2] if self.words else bounds
                windows = self._windows(of)
                stops = np.cumsum(windows)
                i, j = np.searchsorted(ends, [base, base + stops[-1]], "right")
                p = np.flatnonzero(start[entry[i:j]] >= 0) + i
                place = _ragged(ends[p] - n[p] - base, n[p])  # windows with an answer
                doc = np.searchsorted(stops, place, "right")
                hit = least[_ragged(start[entry[p]], n[p])] < np.asarray(own.fill_null(NO_ID)).astype(np.int64)[doc]
                place, doc = place[hit], doc[hit]
                token = of[doc] + place - (stops - windows)[doc]
                step = np.zeros(of[-1] + 1, np.int8)  # a token begins one window at most
                step[token] = 1
                step[token + self.window] -= 1
                yield (own, data, bounds, of), np.cumsum(step[:-1], dtype=np.int32) > 0
                at, base = at + m, base + stops[-1]


def _arrow(kind) -> pa.DataType:
    return {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[kind.simpleString()]


def _runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int | str, list[dict]]]:
    """The rows of each value of ``by``, from sorted rows."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[by] != key:
                yield key, held
                held = []
            key = row[by]
            held.append(row)
    if held:
        yield key, held


def removed(of: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(removed tokens of each text, maximal runs of them)."""
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    edge = of[:-1][np.diff(of) > 0]
    begins[edge] = gone[edge]
    count = lambda x: np.diff(np.append(0, np.cumsum(x, dtype=np.int64))[of])
    return count(gone), count(begins)


def sha256_hex(pieces: Iterator[bytes]) -> list[str]:
    return [hashlib.sha256(p).hexdigest() for p in pieces]
