"""Pictures from image files, decoded by Spark, and image files from pictures."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from curbside.functions import text


def pictures(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """file, width, height, channels and data of image files, as Spark's image source decodes them.

    ``data`` is row by row with the blue byte first; a file that can't be decoded
    has width and height 0 and no data. ``pixels.perceptual_hash`` and
    ``pixels.crop_pixels`` take these rows.
    """
    own = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", recursive).load(paths)
    read = own.select(F.col("_metadata.file_path").alias("file"), "image.*").filter(text.is_image_file(F.col("file")))
    good = F.col("width") > 0
    return read.select("file", F.when(good, F.col("width")).otherwise(0).alias("width"), F.when(good, F.col("height")).otherwise(0).alias("height"), F.when(good, F.col("nChannels")).alias("channels"), F.when(good, F.col("data")).alias("data"))


def digests(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """file and sha256 of image files; their bytes don't leave the task."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(paths)
    return own.select(F.col("_metadata.file_path").alias("file"), F.sha2("content", 256).alias("sha256")).filter(text.is_image_file(F.col("file")))


def listing(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """file of the image files in a folder; none is opened."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    return own.select(F.col("_metadata.file_path").alias("file")).filter(text.is_image_file(F.col("file")))


def png_bytes(width: int, height: int, data: bytes) -> bytes:
    """A PNG file of a picture with three bytes a pixel, red first."""
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = b"".join(b"\0" + data[y * width * 3 : (y + 1) * width * 3] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the ``content`` of each row to the file ``file_name`` below a folder; (file_name, n_bytes) of what was written, when it is read.

    A file appears under its name when it is whole, so a repeated task replaces
    like by like. Each task makes its files in a hidden folder of its own, as many
    writers wait for each other where they all make files in one folder.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        own, made = f"{base}/.{uuid.uuid4().hex}.part", set()
        store.create_dir(own, recursive=True)
        for batch in batches:
            names, contents = batch.column(0).to_pylist(), batch.column(1)
            for name, content in zip(names, contents, strict=True):
                path = f"{base}/{name}"
                at = path.rpartition("/")[0]
                if at not in made:
                    store.create_dir(at, recursive=True)
                    made.add(at)
                with store.open_output_stream(f"{own}/file", compression=None) as out:
                    out.write(content.as_buffer())
                store.move(f"{own}/file", path)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([len(c.as_buffer()) for c in contents], pa.int64())], ["file_name", "n_bytes"])
        store.delete_dir(own)

    return rows.select("file_name", F.col("content").cast("binary")).mapInArrow(write, "file_name string, n_bytes long")


def as_png(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Adds ``content``, the PNG file of each picture (width, height, data)."""
    kinds = dict(rows.dtypes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [png_bytes(w, h, d) for w, h, d in zip(*(batch.column(len(keep) + i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(files, pa.binary())], [*keep, "content"])

    return rows.select(*keep, "width", "height", "data").mapInArrow(encode, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "content binary"]))
