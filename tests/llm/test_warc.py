import gzip
import zlib

from curbside.llm import files, warc
from curbside.runtime import scratch

PAGES = [
    (3, "http://a/\r\nx: y", "same"), (1, "http://b/", "same"), (2, None, "same"), (1, "http://b/", "same"),
    (4, "http://c/", None), (5, "http://d/", ""), (None, "http://e/", "lone"), (6, "http://f/", "WARC/1.1\r\n\r\n" * 9000),
]


def records(spark, rows, **options):
    pages = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, size int")
    archives = warc.write_archives(pages, scratch(spark, "raw"), **options)
    normal = warc.normalise(archives, scratch(spark, "warc"))
    return warc.read_records(normal).collect(), archives.collect(), normal.collect()


def test_revisits_and_round_trip(spark):
    got, archives, normal = records(spark, PAGES, archive_bytes=4)
    by = sorted(((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=str)
    assert by == sorted([(3, "revisit", 1, 4), (1, "response", None, 4), (1, "revisit", 1, 4), (2, "revisit", 1, 4), (4, "response", None, 0), (5, "revisit", 4, 0), (-1, "response", None, 4), (6, "response", None, 108000)], key=str)
    assert {r.payload_digest for r in got if r.payload_bytes == 0} == {warc.base32_sha1(b"")}
    assert {r.url for r in got if r.page_id in (2, 3)} == {None, "http://a/%0D%0Ax: y"}
    assert len(archives) > 1
    for r in archives:  # one member around everything
        z = zlib.decompressobj(31)
        with files.open_input(r.uri) as f:
            z.decompress(f.read())
        assert z.eof and not z.unused_data
    for r in normal:  # each record alone at its offset
        with files.open_input(r.uri) as f:
            data = f.read()
        with files.open_input(r.sidecar) as f:
            lines = f.read().splitlines()
        assert len(lines) == r.n_records and gzip.decompress(data).count(b"WARC-Record-ID") == r.n_records


def test_least_bytes_and_empty(spark):
    got, *_ = records(spark, PAGES, least_bytes=5)
    assert {r.record_type for r in got} == {"response"} and len(got) == len(PAGES)
    assert records(spark, [])[0] == []


def test_inflate_reads_many_members_in_small_pieces():
    data = gzip.compress(b"one") + gzip.compress(b"two" * 10**6)
    assert b"".join(warc.inflate(data[i : i + 7] for i in range(0, len(data), 7))) == b"one" + b"two" * 10**6
