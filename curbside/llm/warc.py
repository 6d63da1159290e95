"""WARC archives: writing with revisits, and the monolithic gzip normaliser.

``write_archives`` writes whole-file gzip streams, as crawlers and careless
tools leave them: one member around many records, which can only be read from
the start. ``normalise`` inflates each such stream once, writes every record as
a member of its own and a sidecar index of offsets, so that any record can be
read alone. ``read_records`` reads records through the sidecars.

Memory is bounded by one record and, for reading, the fields of some thousand,
not by a file. Payloads move once, by their place in the table: which of equal
payloads is the response is found on digests alone. Files are named by a table
of URIs that Spark commits, so what a lost task wrote is never read.

Defined cases: a null payload is an empty one. Equal payloads are found by
SHA-1 over the whole payload; of rows that tie in payload and id one is the
response. A null id is larger than every other, and a revisit of such a row has
no ``refers_to``. A null URL leaves the target out; line breaks in a URL are
percent-encoded. Empty tables and empty files give no records. A very long
payload is one record, held whole by its task. Columns beside id, URL and
payload are not read, whatever their names. The pages must be read the same way twice (a
table is), since ties are told apart by their place.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from curbside.llm import files
from curbside.runtime import cut, scratch
from curbside.skew import spread_join

#: Bytes of payload after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

_MANIFEST = "uri string, n_records long, n_bytes long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of one record. A revisit has the response's HTTP header and no payload."""
    block = HTTP if revisit else HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflate(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The content of a gzip stream of one member or many, piece by piece."""
    z = zlib.decompressobj(31)
    for piece in pieces:
        while piece:
            out = z.decompress(piece, 1 << 20)
            if out:
                yield out
            piece = z.unconsumed_tail
            if z.eof:
                piece, z = z.unused_data, zlib.decompressobj(31)
    if tail := z.flush():
        yield tail


def split_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header fields by lower-case name, block, all bytes) of each record of a stream."""
    held, source = bytearray(), iter(pieces)

    def more() -> bool:
        piece = next(source, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("a record's header has no end")
                return
        lines = held[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record starts with {lines[0][:40]!r}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = end + 4 + int(fields["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("a record is cut off")
        whole = bytes(held[:size])
        del held[:size]
        yield fields, whole[end + 4 : -4], whole


def mark_revisits(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """page_id, url, payload, sha1, size, response_id and revisit of each page."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload")
    ).select("page_id", "url", "payload", F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("size"), F.monotonically_increasing_id().alias("tag"))
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "tag")
    slim = cut(rows.select("page_id", "sha1", "size", "tag"), "digests").filter(F.col("size") >= least_bytes)
    groups = slim.groupBy("sha1").agg(F.min(place).alias("first"), F.count("*").alias("copies"))
    groups = groups.select("sha1", "copies", F.col("first.page_id").alias("response_id"), F.col("first.tag").alias("response_tag"))
    marks = spread_join(slim.select("tag", "sha1"), cut(groups.filter("copies > 1"), "groups"), "sha1", "copies", "tag").filter("tag <> response_tag")
    joined = rows.join(marks.select(F.col("tag").alias("t"), "response_id"), F.col("tag") == F.col("t"), "left")
    return joined.withColumn("revisit", F.col("t").isNotNull()).drop("t", "tag")


def write_archives(pages: DataFrame, base: str, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes monolithic archives; returns their (uri, n_records, n_bytes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, z, n, size = None, None, 0, 0

        def close() -> pa.RecordBatch:
            sink.write(z.flush())
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([sink.uri]), pa.array([n], pa.int64()), pa.array([sink.size], pa.int64())], names=["uri", "n_records", "n_bytes"])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "sha1", "size", "response_id", "revisit")]
            for row in zip(*columns, strict=True):
                page_id, url, payload, sha1, length, response_id, revisit = (x.as_py() for x in row)
                if sink is None:
                    sink, z, n, size = files.Sink(base, ".warc.gz"), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                sink.write(z.compress(record(page_id, url, payload, digest, length, response_id, revisit)))
                n, size = n + 1, size + length
                if size >= archive_bytes:
                    yield close()
                    sink = None
        if sink is not None:
            yield close()

    return cut(mark_revisits(pages, id_col, payload_col, least_bytes).mapInArrow(work, _MANIFEST), "archives")


def _spread(manifest: DataFrame) -> DataFrame:
    """Some partition for each file by the order of their names, so that files are read side by side."""
    return manifest.repartitionByRange(max(1, manifest.count()), "uri")


def _lines(uri: str) -> Iterator[bytes]:
    rest = b""
    for piece in files.chunks(uri):
        *full, rest = (rest + piece).split(b"\n")
        yield from full
    if rest:
        yield rest


def normalise(archives: DataFrame, base: str) -> DataFrame:
    """Rewrites each archive by record, with a sidecar; returns (uri, sidecar, n_records)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                out, index, n = files.Sink(base, ".warc.gz"), files.Sink(base, ".idx"), 0
                for fields, _, whole in split_records(inflate(files.chunks(uri))):
                    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    data = z.compress(whole) + z.flush()
                    at = out.write(data)
                    line = {"offset": at, "length": len(data), "type": fields["warc-type"], "id": fields["warc-record-id"]}
                    index.write(json.dumps(line).encode() + b"\n")
                    n += 1
                out.close()
                index.close()
                yield pa.RecordBatch.from_arrays([pa.array([out.uri]), pa.array([index.uri]), pa.array([n], pa.int64())], names=["uri", "sidecar", "n_records"])

    return cut(_spread(archives).mapInArrow(work, "uri string, sidecar string, n_records long"), "normalised")


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read_records(normalised: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type and refers_to of each record.

    Each record is read at its sidecar's offset. A response's digest and length
    are taken from the payload that was read; a header that differs is an error.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        rows = []

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return out

        for batch in batches:
            for uri, sidecar in zip(batch.column("uri").to_pylist(), batch.column("sidecar").to_pylist(), strict=True):
                with files.open_input(uri) as f:
                    for line in map(json.loads, _lines(sidecar)):
                        f.seek(line["offset"])
                        fields, block, _ = next(split_records(inflate([f.read(line["length"])])))
                        digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
                        if line["type"] == "response":
                            payload = block[len(HTTP) :]
                            if (digest, size) != (base32_sha1(payload), len(payload)):
                                raise ValueError(f"{uri} at {line['offset']}: the payload isn't what its header says")
                        refers = fields.get("warc-refers-to")
                        rows.append((_page(line["id"]), fields.get("warc-target-uri"), size, digest, line["type"], refers and _page(refers)))
                        if len(rows) == 5000:
                            yield told()
        if rows:
            yield told()

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return _spread(normalised).mapInArrow(work, schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = write_archives(pages, scratch(spark, "warc_raw"), least_bytes=0)
    records = read_records(normalise(archives, scratch(spark, "warc")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# Base32 of a SHA-1: its 40 hexadecimal digits are 8 groups of 5, each of 20 bits and 4 letters.
OP5_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST, r) AS k, first(page_id) OVER (PARTITION BY h ORDER BY page_id NULLS LAST, r) AS f FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4)::INT * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k > 1 THEN f END AS refers_to
FROM g
"""
