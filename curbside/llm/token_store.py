"""Token ids as binary shards with a minimal perfect hash index.

``write_store`` orders the documents by id, encodes each, appends the end id
and writes raw little-endian ids to shard files, one per task. A table of
entries (doc_id, shard, offset, n_tokens, start) goes beside them.
``build_index`` deals the entries to buckets by a hash of the id and gives each
bucket a file with a minimal perfect hash of its ids: key to slot, slot to a
stored fingerprint and to the place in the shard. ``lookup`` answers keys
through these files in constant time each and reads the ids back.

Defined cases: a null or empty text is the end id alone. A null id is a key of
its own and sorts first. Rows that share an id are neighbours, in the order of
their text's hash, and a lookup of the id gives them all. An empty table gives
no shards, and every lookup comes back empty. Very long texts are encoded in
chunks; one without white space is a single chunk, held whole by its task.
Columns beside the id and the text are not read, whatever their names. Ids that
don't fit in the file's integers are an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from curbside.llm import files
from curbside.llm.chunk_ids import ChunkIds
from curbside.llm.words import whole
from curbside.runtime import cut, scratch

#: Bytes of text, about, that are encoded at one time.
STEP = 1 << 20
#: Ids per bucket of the index, about.
BUCKET_KEYS = 50_000
#: Bits per remaining key in a level of the hash.
GAMMA = 2

_ENTRY = "doc_id long, shard string, part int, pos long, offset long, n_tokens long"


def chunk_starts(b: np.ndarray) -> np.ndarray:
    """White space after other bytes, and punctuation after a Latin letter.

    No token of a byte-level BPE with the usual splitting pattern crosses such a
    place, unless white space of other kinds joins the run.
    """
    space = (b == 32) | ((b >= 9) & (b <= 13))
    lower = b | 32
    before = np.empty(len(b), np.uint8)
    before[0], before[1:] = 0, b[:-1]
    letter = (lower >= 97) & (lower <= 122)
    letter[1:] |= (before[1:] >= 0xC3) & (before[1:] <= 0xC9) & (b[1:] >= 0x80) & ~((before[1:] == 0xC3) & ((b[1:] == 0x97) | (b[1:] == 0xB7)))
    mark = np.zeros(len(b), bool)
    mark[1:] = (space[1:] & ~space[:-1]) | (_PUNCTUATION[b[1:]] & letter[:-1])
    return mark


_PUNCTUATION = np.isin(np.arange(256), list(b",.;:!?"))
_ODD_LEADS = np.isin(np.arange(256), [0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF])


def odd_places(b: np.ndarray) -> np.ndarray:
    """Places of white space other than space, tab and line ends; texts with any are encoded whole."""
    at = np.flatnonzero(_ODD_LEADS[b])
    b = np.concatenate([b, np.zeros(2, np.uint8)])
    x, y, z = b[at], b[at + 1], b[at + 2]
    odd = (x < 0x20) | ((x == 0xC2) & ((y == 0x85) | (y == 0xA0))) | ((x == 0xE1) & ((y == 0x9A) | (y == 0xA0))) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))
    odd |= ((x == 0xE2) & (((y == 0x80) & ((z <= 0x8F) | (z >= 0xA8))) | ((y == 0x81) & (z >= 0x9F)))) | ((x == 0xEF) & (y == 0xBB))
    return at[odd]


class ByteBpe:
    """Encodes texts with a tokenizers file of a byte-level BPE; lives in a worker process."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path) as f:
            added = json.load(f)["added_tokens"]
        self._tokenizer, self._parted = Tokenizer.from_file(path), Tokenizer.from_file(path)
        #: The largest id that a text can get.
        self.most_id = max(self._tokenizer.get_vocab(with_added_tokens=True).values())
        self._tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        #: A special token parts a text before all else, so chunks joined by it are encoded as if alone.
        self._part = next(((t["content"], t["id"]) for t in added if t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"])), None)
        self._chunks = ChunkIds(chunk_starts, self._many)

    def _alone(self, text: bytes) -> np.ndarray:
        return np.asarray(self._tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.int32)

    def _many(self, chunks: list[bytes], at_once: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the chunks, the number of ids of each, and no marks."""
        ids, counts = [], []
        for k in range(0, len(chunks), at_once):
            some = chunks[k : k + at_once]
            joined = b"" if self._part is None else self._part[0].encode().join(some)
            if self._part is None or joined.count(self._part[0].encode()) != len(some) - 1:
                parts = [self._alone(c) for c in some]
                ids.append(np.concatenate(parts))
                counts.append([len(p) for p in parts])
                continue
            flat = np.asarray(self._parted.encode_batch_fast([joined.decode()], add_special_tokens=False)[0].ids, np.int32)
            parting = flat == self._part[1]
            counts.append(np.diff(np.concatenate([[-1], np.flatnonzero(parting), [len(flat)]])) - 1)
            ids.append(flat[~parting])
        return np.concatenate(ids), np.concatenate(counts).astype(np.int64), np.zeros(len(chunks), np.int32)

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """The ids of each text; text i is data[bounds[i]:bounds[i + 1]]."""
        odd = np.zeros(len(bounds) - 1, bool)
        odd[np.searchsorted(bounds, odd_places(data), "right") - 1] = True
        ids, counts, _ = self._chunks(data, bounds)
        out = np.split(ids, np.cumsum(counts)[:-1])
        for i in np.flatnonzero(odd).tolist():
            out[i] = self._alone(data[bounds[i] : bounds[i + 1]].tobytes())
        return out


_encoders: dict[str, ByteBpe] = {}


def _encoder(path: str) -> ByteBpe:
    """The worker process's encoder: what it remembers serves all its tasks."""
    if path not in _encoders:
        _encoders[path] = ByteBpe(path)
    return _encoders[path]


def byte_pieces(column: pa.Array, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, bounds) of runs of rows of a binary column, of about ``step`` bytes each."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + step)))
        to = min(to, len(column))
        yield data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def write_store(docs: DataFrame, base: str, tokenizer_path: str, end_id: int, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards; returns the entries, each with the ``start`` among all ids.

    Order comes from a range partition by (id, text hash), so that no task holds
    more than its share, and running totals are taken over shards, not documents.
    """
    most = max(end_id, ByteBpe(tokenizer_path).most_id)
    if most > np.iinfo(dtype).max:
        raise ValueError(f"ids up to {most} don't fit in {dtype}")
    end = np.asarray([end_id], dtype).tobytes()
    width = len(end)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, pos, part = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = _encoder(tokenizer_path)
            sink = sink or files.Sink(base, ".ids")
            offsets, counts = [], []
            for data, bounds in byte_pieces(batch.column("text"), STEP):
                for ids in encoder(data, bounds):
                    offsets.append(sink.write(ids.astype(dtype).tobytes() + end) // width)
                    counts.append(len(ids) + 1)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([sink.uri] * n), pa.array([part] * n, pa.int32()), pa.array(range(pos, pos + n), pa.int64()), pa.array(offsets, pa.int64()), pa.array(counts, pa.int64())],
                names=["doc_id", "shard", "part", "pos", "offset", "n_tokens"],
            )
            pos += n
        if sink:
            sink.close()

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).cast("binary").alias("text"))
        .withColumn("h", F.xxhash64("text"))
        .repartitionByRange("doc_id", "h")
        .sortWithinPartitions("doc_id", "h")
        .select("doc_id", "text")
    )
    entries = cut(ordered.mapInArrow(encode, _ENTRY), "entries")
    # One row for each shard from here on.
    shards = entries.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select(F.col("shard").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return entries.join(shards, F.col("shard") == F.col("s")).select(
        "doc_id", "shard", "part", "pos", "offset", "n_tokens", (F.col("base") + F.col("offset")).alias("start")
    )


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixing function; one-to-one for each seed, so different keys never meet before the modulus."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bits and their ranks.

    In each level a key whose bit no other key shares is settled; the others go
    on to the next. A key's slot is the number of bits before its own.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        ends = np.cumsum([0] + [int(x.sum()) for x in levels])
        self._ranks = [np.cumsum(x, dtype=np.int64) - 1 + b for x, b in zip(levels, ends, strict=False)]

    @classmethod
    def of(cls, keys: np.ndarray) -> "PerfectHash":
        levels = []
        while len(keys):
            size = max(8, GAMMA * len(keys))
            at = (_mix(keys, len(levels)) % np.uint64(size)).astype(np.int64)
            hits = np.bincount(at, minlength=size)
            levels.append(hits == 1)
            keys = keys[hits[at] != 1]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for some keys that aren't in the set."""
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, (bits, ranks) in enumerate(zip(self.levels, self._ranks, strict=True)):
            at = (_mix(keys[rest], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[rest[hit]] = ranks[at[hit]]
            rest = rest[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1000) >> np.uint64(32)).astype(np.uint32)


def _pack(keys: np.ndarray, tables: dict[str, np.ndarray], shards: list[str]) -> bytes:
    """A bucket file: an Arrow stream of the hash's bits, then slots, then entries."""
    import io

    ph = PerfectHash.of(keys)
    slots = ph.slots(keys)
    order = np.argsort(slots)
    columns = {
        "level_sizes": np.asarray([len(x) for x in ph.levels], np.int64),
        "bits": np.packbits(np.concatenate(ph.levels)) if ph.levels else np.zeros(0, np.uint8),
        "fingerprint": fingerprints(keys)[order],
    } | {k: v[order] if k in ("first", "count") else v for k, v in tables.items()}
    out = io.BytesIO()
    np.savez(out, shards=np.asarray(shards, dtype=np.str_), **columns)
    return out.getvalue()


class Bucket:
    """A bucket file in memory."""

    def __init__(self, data: bytes):
        import io

        z = np.load(io.BytesIO(data))
        self.t = {k: z[k] for k in z.files}
        bits = np.unpackbits(self.t["bits"]).astype(bool)
        ends = np.cumsum(self.t["level_sizes"])
        self.hash = PerfectHash([bits[e - s : e] for s, e in zip(self.t["level_sizes"], ends, strict=True)])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the key, entry) pairs of the keys that are there."""
        slots = self.hash.slots(keys)
        ok = slots >= 0
        ok[ok] = self.t["fingerprint"][slots[ok]] == fingerprints(keys[ok])
        which, s = np.flatnonzero(ok), slots[ok]
        first, count = self.t["first"][s], self.t["count"][s]
        entry = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]) if len(s) else first, count) + np.arange(count.sum())
        which = np.repeat(which, count)
        same = self.t["key"][entry] == keys[which]  # the fingerprint sorts out most strangers, the stored key all
        return which[same], entry[same]


def _bucket(n: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")


def build_index(entries: DataFrame, base: str) -> DataFrame:
    """Writes a file for each bucket; returns (bucket, n_buckets, uri). Null ids are left to ``lookup``."""
    keyed = entries.filter("doc_id IS NOT NULL")
    n = max(1, -(-keyed.count() // BUCKET_KEYS))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, t in _by_bucket(batches):
            keys = t["doc_id"].to_numpy().astype(np.int64)
            uniq, first, count = np.unique(keys, return_index=True, return_counts=True)
            names = t["shard"].dictionary_encode().combine_chunks()
            data = _pack(
                uniq,
                {"first": first, "count": count, "key": keys, "shard": names.indices.to_numpy(), "offset": t["offset"].to_numpy(), "n_tokens": t["n_tokens"].to_numpy(), "start": t["start"].to_numpy()},
                names.dictionary.to_pylist(),
            )
            sink = files.Sink(base, ".mph")
            sink.write(data)
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([n], pa.int32()), pa.array([sink.uri])], names=["bucket", "n_buckets", "uri"])

    dealt = keyed.withColumn("bucket", _bucket(n)).repartition(n, "bucket").sortWithinPartitions("bucket", "doc_id", "start")
    return cut(dealt.select("bucket", "doc_id", "shard", "offset", "n_tokens", "start").mapInArrow(build, "bucket int, n_buckets int, uri string"), "index")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Tables of the rows of one bucket each, from rows sorted by bucket."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        column = batch.column("bucket").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if held and held[-1].column("bucket")[0].as_py() != column[a]:
                yield held[-1].column("bucket")[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held[-1].column("bucket")[0].as_py(), pa.Table.from_batches(held)


def locate(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, shard, offset, n_tokens, start) of distinct ids, through the bucket files."""
    head = index.select("n_buckets").first()
    schema = "doc_id long, shard string, offset long, n_tokens long, start long"
    if head is None:
        return keys.sparkSession.createDataFrame([], schema)
    n = head.n_buckets

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _by_bucket(batches):
            with files.open_input(t["uri"][0].as_py()) as f:
                b = Bucket(f.read())
            keys = t["doc_id"].to_numpy().astype(np.int64)
            which, entry = b.find(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[which]), pa.array(b.t["shards"][b.t["shard"][entry]].tolist(), pa.string()), *(pa.array(b.t[c][entry]) for c in ("offset", "n_tokens", "start"))],
                names=["doc_id", "shard", "offset", "n_tokens", "start"],
            )

    asked = keys.filter("doc_id IS NOT NULL").select("doc_id").distinct().withColumn("bucket", _bucket(n))
    asked = asked.join(index.select("bucket", "uri"), "bucket").repartition(n, "bucket").sortWithinPartitions("bucket")
    return asked.select("bucket", "doc_id", "uri").mapInArrow(find, schema)


def read_back(places: DataFrame, dtype: str = "<u2") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each place, from the shard files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, opened, width = None, None, np.dtype(dtype).itemsize
        for batch in batches:
            crcs = []
            for uri, offset, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "n_tokens")), strict=True):
                if uri != opened:
                    f, opened = files.open_input(uri), uri
                f.seek(offset * width)
                crcs.append(zlib.crc32(np.frombuffer(f.read(n * width), dtype).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = places.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    grouped = places.repartitionByRange(n, "shard", "offset").sortWithinPartitions("shard", "offset")
    return grouped.select("doc_id", "shard", "offset", "n_tokens", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = scratch(spark, "token_store")
    entries = cut(write_store(docs, base, public_tokenizers.path("byte_bpe_50k.json"), 2), "places")
    index = build_index(entries, base)
    places = locate(docs.select("doc_id"), index).unionByName(entries.filter("doc_id IS NULL").select("doc_id", "shard", "offset", "n_tokens", "start"))
    return read_back(places)
