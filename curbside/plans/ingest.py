"""From a configuration and its folders to the tables images and instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from curbside.functions import text
from curbside.operators import pixels
from curbside.operators.release import ranked_in_order
from curbside.runtime import cut
from curbside.settings import Source
from curbside.sources import images as files, scans

IMAGES = ["image_id", "source_id", "raw_path", "source_image_id", "split", "width", "height", "sha256", "phash", "h", "group_id", "ingest_seq"]
INSTANCES = ["instance_id", "image_id", "class_name", "x", "y", "w", "h", "visible_w", "visible_h", "occlusion", "ignore", "confidence"]


def _stem(file: Column) -> Column:
    return F.regexp_replace(text.file_name(file), r"(?<=.)\.[^.]*$", "")


def _below(source: Source, folder: str) -> str:
    return f"{source.mount.rstrip('/')}/{folder.strip('/')}"


def _read(spark: SparkSession, folder: str, chosen: list[str] | None = None) -> DataFrame:
    """file, stem, width, height, sha256, phash and h of image files: decoded and hashed where they are read.

    Of ``chosen`` files only these are opened: Spark filters its listing of the
    folder by name, where a path for each of them would be looked up by itself.
    """
    wanted = F.lit(True) if chosen is None else F.col("file").isin(chosen)
    hashed = pixels.perceptual_hash(files.pictures(spark, folder).filter(wanted), ["file", "width", "height"])
    return hashed.join(files.digests(spark, folder).filter(wanted), "file").withColumn("stem", _stem(F.col("file")))


def _first_split(source: Source) -> str:
    return (source.lora_splits or ("train",))[0]


def _yolo_images(spark: SparkSession, source: Source) -> list[DataFrame]:
    """The images of each configured split that feeds training or evaluation, or of all where none is named."""
    active, found = {*source.lora_splits, *source.eval_splits}, []
    for split, folder in source.splits.items():
        if (not active or split in active) and scans.mounted(spark, _below(source, folder)):
            name = text.stable_id(F.lit(source.source_id), F.lit(split), F.col("stem"))
            found.append(_read(spark, _below(source, folder)).withColumns({"split": F.lit(split), "image_id": name, "group_id": name}))
    return found


def _yolo_boxes(spark: SparkSession, source: Source, images: DataFrame, person: str) -> list[DataFrame]:
    found = []
    for split in source.splits:
        folder = _below(source, source.label_dirs.get(split, ""))
        if not scans.mounted(spark, folder):
            continue
        lines = scans.lines(spark, folder).filter(F.col("path").endswith(".txt")).withColumn("source_image_id", _stem(F.col("path")))
        own = images.filter((F.col("source_id") == source.source_id) & (F.col("split") == split)).select("image_id", "source_image_id", "width", "height")
        boxes = scans.yolo_boxes(lines.join(own, "source_image_id"), {0: person})
        found.append(boxes.select(
            text.stable_id(F.col("image_id"), F.col("line_no")).alias("instance_id"), "image_id", "class_name", *"xywh", F.col("w").alias("visible_w"), F.col("h").alias("visible_h"),
            F.lit(None).cast("double").alias("occlusion"), (F.col("class_name") != person).alias("ignore"), F.lit(1.0).alias("confidence"),
        ))
    return found


def _sequence(spark: SparkSession, source: Source) -> DataFrame | None:
    """(file, window_id) of the sampled frames: sampled first, windows counted over what is left."""
    folder = _below(source, source.sequence_dir)
    if not scans.mounted(spark, folder):
        return None
    listed = files.listing(spark, folder).withColumn("sequence", F.lit(source.source_id))
    return scans.sequence_frames(listed, source.source_fps, source.fps, source.window_seconds, order="file").select("file", "window_id")


def _mot_images(spark: SparkSession, source: Source) -> list[DataFrame]:
    frames = _sequence(spark, source)
    chosen = [] if frames is None else [r.file for r in frames.select("file").collect()]  # the names of one sequence's frames; only these are decoded
    if not chosen:
        return []
    group = text.stable_id(F.lit(source.source_id), F.lit("window"), F.col("window_id"))
    read = _read(spark, _below(source, source.sequence_dir), chosen).join(frames, "file")
    return [read.withColumns({"split": F.lit(_first_split(source)), "image_id": text.stable_id(F.lit(source.source_id), F.col("stem")), "group_id": group}).drop("window_id")]


def _mot_boxes(spark: SparkSession, source: Source, images: DataFrame, person: str) -> list[DataFrame]:
    truth = f"{_below(source, source.gt_dir)}/gt.txt"
    frames = _sequence(spark, source)
    if frames is None or not source.gt_dir or not scans.mounted(spark, truth):
        return []
    boxes = scans.frame_instances(frames.withColumnRenamed("file", "path"), scans.mot_boxes(scans.lines(spark, truth)), source.source_id)
    return [boxes.select("instance_id", "image_id", F.lit(person).alias("class_name"), *"xywh", "visible_w", "visible_h", "occlusion", "ignore", F.lit(1.0).alias("confidence"))]


def _folder_images(spark: SparkSession, source: Source) -> list[DataFrame]:
    folder = _below(source, source.positive_dir)
    if not scans.mounted(spark, folder):
        return []
    name = text.stable_id(F.lit(source.source_id), F.lit("pos"), F.col("stem"))
    return [_read(spark, folder).withColumns({"split": F.lit(_first_split(source)), "image_id": name, "group_id": name})]


def _folder_boxes(spark: SparkSession, source: Source, images: DataFrame, person: str) -> list[DataFrame]:
    own = images.filter(F.col("source_id") == source.source_id).withColumn("path", F.col("image_id"))
    boxes = scans.folder_boxes(own, person).withColumnRenamed("path", "image_id")
    return [boxes.select(
        text.stable_id(F.col("image_id"), F.lit(0)).alias("instance_id"), "image_id", "class_name", *"xywh", F.col("w").alias("visible_w"), F.col("h").alias("visible_h"),
        F.lit(None).cast("double").alias("occlusion"), F.lit(False).alias("ignore"), "confidence",
    )]


_PARSERS = {"yolo": (_yolo_images, _yolo_boxes), "mot": (_mot_images, _mot_boxes), "classification_folders": (_folder_images, _folder_boxes)}


def ingest(spark: SparkSession, sources: list[Source], person: str = "pedestrian") -> dict[str, DataFrame]:
    """The tables ``images`` and ``instances`` of all sources, written once and read back.

    ``ingest_seq`` numbers the images by the order of sources, then of splits,
    then of file names. Folders that aren't there are passed over; without any
    image it is an error, and so is an unknown parser. Images are decoded by
    Spark and hashed where they are read; boxes meet them by their ids.
    """
    unknown = [s.parser for s in sources if s.parser not in _PARSERS]
    if unknown:
        raise ValueError(f"unknown parser {unknown[0]!r}")
    parts = None
    for i, source in enumerate(sources):
        for j, found in enumerate(_PARSERS[source.parser][0](spark, source)):
            own = found.withColumns({"source_id": F.lit(source.source_id), "order": F.struct(F.lit(i).alias("source"), F.lit(j).alias("split"), F.col("file").alias("file"))})
            parts = own if parts is None else parts.unionByName(own)
    if parts is None:
        raise FileNotFoundError("no images found: none of the sources' folders is there")
    # Ranges are sampled before they are dealt, which would decode every file twice.
    numbered = ranked_in_order(cut(parts, "parts"), "order").withColumn("ingest_seq", F.col("__rank") - 1)
    images = cut(numbered.withColumnsRenamed({"file": "raw_path", "stem": "source_image_id"}).select(*IMAGES), "images")
    if images.isEmpty():
        raise FileNotFoundError("no images found in the sources' folders")
    boxes = None
    for source in sources:
        for own in _PARSERS[source.parser][1](spark, source, images, person):
            boxes = own if boxes is None else boxes.unionByName(own)
    if boxes is None:
        boxes = spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in zip(INSTANCES, ["string"] * 3 + ["double"] * 7 + ["boolean", "double"], strict=True)))
    return {"images": images, "instances": cut(boxes.select(*INSTANCES).join(images.select("image_id"), "image_id", "left_semi"), "instances")}
