"""Scans of image inventories, label files, captions and pair tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from curbside.functions import geometry as geo, text


#: Bytes of a file in which its header's size is looked for first.
HEAD = 1 << 16


def mounted(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def inventory(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """path, width, height, sha256 of the image files below a folder; unreadable ones are 0 x 0.

    Each file is read once; its sides come from its header, and only they and
    the digest leave the task. A PNG's header is read by Spark; of a JPEG file
    Python gets the first 64 KB, and the whole only where its size comes later.
    """
    own = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    own = own.filter(text.is_image_file(F.col("path"))).select("path", _sides("content").alias("s"), F.sha2("content", 256).alias("sha256"))
    out = own.select("path", "sha256", "s.width", "s.height")
    return out if limit is None else out.orderBy("path").limit(limit)


def image_sides(data: bytes) -> tuple[int, int]:
    """Width and height from the header of a PNG or JPEG file; zeros for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR" and len(data) >= 24:
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data):
        marker = data[at + 1]
        if data[at] != 0xFF:
            break
        if marker == 0xFF or marker == 1 or 0xD0 <= marker <= 0xD8:  # fill bytes and markers without a body
            at += 1 if marker == 0xFF else 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return 0, 0


def _sides(content: str) -> Column:
    @F.pandas_udf("width int, height int")
    def sides(files: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(0, 0) if f is None else image_sides(bytes(f)) for f in files], columns=["width", "height"])

    data = F.col(content)
    number = lambda at: F.conv(F.hex(F.substring(data, at, 4)), 16, 10).try_cast("int")
    is_png = (F.hex(F.substring(data, 1, 8)) == "89504E470D0A1A0A") & (F.hex(F.substring(data, 13, 4)) == "49484452") & (F.octet_length(data) >= 24)
    is_jpeg = F.hex(F.substring(data, 1, 2)) == "FFD8"
    head = sides(F.when(is_jpeg, F.substring(data, 1, HEAD)))
    whole = sides(F.when(is_jpeg & (head["width"] == 0) & (F.octet_length(data) > HEAD), data))
    read = F.when(head["width"] > 0, head).otherwise(whole)
    return F.when(is_png, F.struct(F.coalesce(number(17), F.lit(0)).alias("width"), F.coalesce(number(21), F.lit(0)).alias("height"))).otherwise(read)


def usual_splits(eval_splits: list[str] | None = None, train_splits: list[str] | None = None) -> list[str]:
    """The splits of a source that are listed where none are named: those of evaluation, else of training, else ``train``."""
    return list(eval_splits or train_splits or ["train"])


def inventories(spark: SparkSession, roots: dict[str, dict[str, str]], splits: dict[str, list[str]], limit: int | None = None, skip_missing: bool = False) -> DataFrame:
    """Inventories of several sources by their configured splits, at most ``limit`` images of each source.

    A split without a folder in ``roots``, or whose folder isn't there, has no
    images. A source of whose splits no folder is there isn't mounted: an error,
    or with ``skip_missing`` passed over.
    """
    out = None
    for source, wanted in splits.items():
        if source not in roots:
            raise ValueError(f"unknown source {source!r}")
        there = [(i, split) for i, split in enumerate(wanted) if split in roots[source] and mounted(spark, roots[source][split])]
        if not there and not skip_missing:
            raise FileNotFoundError(f"no folder of source {source!r} is there")
        for ordinal, split in there:
            part = inventory(spark, roots[source][split]).withColumns({"source_id": F.lit(source), "split": F.lit(split), "split_ordinal": F.lit(ordinal)})
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError("no source is configured or there")
    if limit is not None:
        order = Window.partitionBy("source_id").orderBy("split_ordinal", "path")
        out = out.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= limit).drop("__n")
    return out


def source_images(spark: SparkSession, root: str) -> DataFrame:
    """The inventory of a folder without generated and label images, which their names tell."""
    return inventory(spark, root).filter(text.is_source_image(F.col("path")))


def dataset(spark: SparkSession, root: str, split_folders: dict[str, str], caption_map: DataFrame | None = None, default: str = "", limit: int | None = None) -> DataFrame:
    """Source images of the split folders, in the order of splits and paths, with caption and split.

    Where no split folder has an image, all below ``root`` are taken and the path tells the split.
    """
    out = None
    for ordinal, (split, folder) in enumerate(split_folders.items()):
        part = source_images(spark, folder).withColumns({"split": F.lit(split), "split_ordinal": F.lit(ordinal)})
        out = part if out is None else out.unionByName(part)
    if out is None or out.isEmpty():
        out = source_images(spark, root).withColumns({"split": text.split_of_path(F.col("path")), "split_ordinal": F.lit(0)})
    if limit is not None:
        out = out.orderBy("split_ordinal", "path").limit(limit)
    if caption_map is None:
        return out.withColumn("caption", F.lit(default))
    return with_captions(out, caption_map, default)


def split_listing(spark: SparkSession, split_path: str) -> DataFrame:
    """(path, label_path) of a detector dataset's split: of the lines of a list file, or of the images below a folder."""
    if split_path.endswith(".txt"):
        rows = spark.read.text(split_path).select(F.trim("value").alias("path")).filter("path <> ''")
    else:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(split_path).select("path").filter(F.lower("path").rlike(r"\.(jpg|jpeg|png)$"))
    return rows.withColumn("label_path", label_path(F.col("path")))


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, line_no (from 0, blank lines counted) and line of text files that each fit in a row."""
    whole = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def _fields(line: str, by: str) -> Column:
    """The fields of a line, as a generated column: Spark moves later filters below a projection, where each condition would split the line anew, but not below an explode."""
    return F.explode(F.array(F.split(F.trim(line), by)))


def yolo_boxes(label_lines: DataFrame, names: dict[int, str], class_mapping: dict[str, str] | None = None) -> DataFrame:
    """Boxes of ``class cx cy w h`` lines (with width and height of the image); short lines are left out.

    An id without a name gets ``ignore``; the mapping renames classes.
    """
    rows = label_lines.withColumn("__parts", _fields("line", r"\s+")).filter(F.size("__parts") >= 5)
    value = [F.get("__parts", F.lit(i)).try_cast("double") for i in range(5)]
    x, y, w, h = geo.from_centre(*value[1:], F.col("width"), F.col("height"))
    name = F.coalesce(*[F.when(value[0].cast("int") == k, v) for k, v in names.items()], F.lit("ignore"))
    if class_mapping:
        name = F.coalesce(*[F.when(name == k, v) for k, v in class_mapping.items()], name)
    keep = [c for c in label_lines.columns if c != "line"]
    return rows.select(*keep, value[0].cast("int").alias("class_id"), name.alias("class_name"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")).filter("class_id IS NOT NULL AND h IS NOT NULL")


def class_boxes(label_lines: DataFrame, class_id: int = 0) -> DataFrame:
    """Boxes x1..y2 in pixels of one class of ``class cx cy w h`` lines."""
    own = yolo_boxes(label_lines, {}).filter(F.col("class_id") == class_id)
    return own.select(*[c for c in label_lines.columns if c != "line"], *geo.Box.xywh(*(F.col(c) for c in "xywh")).columns())


def mot_boxes(label_lines: DataFrame, strict: bool = False) -> DataFrame:
    """Boxes of class 1 of ``frame,id,x,y,w,h,conf,class[,visibility]`` lines, with their index in the frame.

    Without a ninth field the visibility is null. The cast to a number takes off
    the white space around a field; a single character splits without a pattern.
    ``strict`` wants a confidence above 0 and positive sides as well.
    """
    p = F.col("__parts")
    get = lambda i: F.get(p, F.lit(i)).try_cast("double")
    rows = label_lines.withColumn("__parts", _fields("line", ",")).select(
        "*", get(0).cast("bigint").alias("frame"), get(1).cast("bigint").alias("track_id"), *[get(i + 2).alias(c) for i, c in enumerate("xywh")],
        get(6).alias("conf"), F.when(F.size(p) >= 8, get(7).cast("int")).otherwise(1).alias("cls"), F.when(F.size(p) >= 9, get(8)).alias("visibility"),
    ).filter("frame IS NOT NULL AND h IS NOT NULL AND cls = 1")
    if strict:
        rows = rows.filter("conf > 0 AND w > 0 AND h > 0")
    order = Window.partitionBy("path", "frame").orderBy("line_no")
    return rows.drop("line", "__parts").withColumn("box_idx", F.row_number().over(order) - 1)


def frame_instances(frames: DataFrame, boxes: DataFrame, source_id: str) -> DataFrame:
    """Boxes of the sampled frames (path, window_id) by frame number, with ids of image, instance and group.

    ``boxes`` are those of ``mot_boxes``; the box seen is the whole one, and what isn't visible counts as occluded.
    """
    stem = F.regexp_replace(text.file_name(F.col("path")), r"(?<=.)\.[^.]*$", "")
    own = frames.select(text.stable_id(F.lit(source_id), stem).alias("image_id"), text.stable_id(F.lit(source_id), F.lit("window"), F.col("window_id")).alias("group_id"), text.frame_number(F.col("path")).alias("frame"))
    found = own.join(boxes.select("frame", "box_idx", *"xywh", "visibility"), "frame")
    return found.select(
        "image_id", text.stable_id(F.col("image_id"), F.col("box_idx")).alias("instance_id"), "group_id", F.lit("pedestrian").alias("class_name"), *"xywh",
        F.col("w").alias("visible_w"), F.col("h").alias("visible_h"), (1 - F.col("visibility")).alias("occlusion"), F.lit(False).alias("ignore"),
    )


def folder_boxes(images: DataFrame, class_name: str = "pedestrian") -> DataFrame:
    """One box around each whole image, with confidence 0."""
    zero = F.lit(0.0)
    return images.select("path", F.lit(class_name).alias("class_name"), zero.alias("x"), zero.alias("y"), F.col("width").cast("double").alias("w"), F.col("height").cast("double").alias("h"), zero.alias("confidence"))


def label_candidates(path: Column, split_folders: dict[str, str] | None = None) -> Column:
    """The nine places where an image's label file may be, the likeliest first; null where a folder does not apply.

    ``split_folders`` has the label folder of a split, which the path's segments tell.
    """
    folder, stem = F.regexp_replace(path, "[^/]*$", ""), F.regexp_replace(text.file_name(path), r"(?<=.)\.[^.]*$", "")
    sibling = F.when(folder.rlike("(^|/)images/$"), F.regexp_replace(folder, "images/$", "labels/"))
    split = text.split_of_path(path)
    own = F.coalesce(*[F.when(split == k, v.rstrip("/") + "/") for k, v in (split_folders or {}).items()], F.lit(None).cast("string"))
    # The reference names the first place twice.
    places = [(folder, ".json"), (folder, ".json"), (folder, ".txt"), (sibling, ".txt"), (sibling, ".json"), (own, ".txt"), (own, ".json"), (folder, "_gtBboxCityPersons.json"), (folder, "_gtFine_polygons.json")]
    return F.array(*[F.concat(d, stem, F.lit(end)) for d, end in places])


def match_labels(images: DataFrame, label_files: DataFrame, split_folders: dict[str, str] | None = None) -> DataFrame:
    """label_path of each image: the first candidate that exists.

    Spark takes the exploded candidates for as small as the paths and would
    broadcast them, so that join is hinted to be a shuffled one.
    """
    tries = images.select("path", F.posexplode(label_candidates(F.col("path"), split_folders)).alias("rank", "label_path")).hint("merge")
    found = tries.join(label_files.select(F.col("path").alias("label_path")), "label_path").groupBy("path").agg(F.min_by("label_path", "rank").alias("label_path"))
    return images.join(found, "path", "left")


def captions(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, caption) of a CSV file with a header; of several rows for a file the last one counts.

    The name is in ``file_name``, ``filename`` or ``image``, the caption in
    ``caption`` or ``prompt``: the first of them that isn't empty. Cells may be
    quoted, with doubled quotes, commas and line breaks inside; a byte-order mark
    is taken off.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    names = {c.lstrip("\ufeff"): c for c in raw.columns}
    pick = lambda options: F.coalesce(*[F.nullif(F.col(f"`{names[o]}`"), F.lit("")) for o in options if o in names], F.lit(None).cast("string"))
    out = raw.select(text.file_name(pick(("file_name", "filename", "image"))).alias("file_name"), pick(("caption", "prompt")).alias("caption"), F.monotonically_increasing_id().alias("__at"))
    return out.filter("file_name IS NOT NULL AND caption IS NOT NULL").groupBy("file_name").agg(F.max_by("caption", "__at").alias("caption"))


def with_captions(images: DataFrame, caption_map: DataFrame, default: str) -> DataFrame:
    joined = images.withColumn("file_name", text.file_name(F.col("path"))).join(caption_map, "file_name", "left")
    return joined.withColumn("caption", F.coalesce("caption", F.lit(default)))


def pairs(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Before/after pairs: parquet rows with both images, the instruction and its class.

    With a limit the first rows in the order of the files' names and of their rows.
    """
    out = spark.read.parquet(path)
    return out if limit is None else out.orderBy("_metadata.file_path", "_metadata.row_index").limit(limit)


def label_path(path: Column) -> Column:
    """Label file of an image: the first folder ``images`` on its path becomes ``labels``, or ``labels`` beside its own folder."""
    text_file = F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ".txt")
    beside = F.regexp_replace(text_file, r"[^/]+/([^/]+)$", "labels/$1")
    return F.when(path.rlike("(^|/)images/"), F.regexp_replace(text_file, "^(.*?)(^|/)images/", "$1$2labels/")).otherwise(beside)


def sample_frames(frames: DataFrame, source_fps: float, fps: float, key: str = "sequence", order: str = "frame") -> DataFrame:
    """Every n-th frame of each sequence, n being the ratio of the rates."""
    n = max(1, int(source_fps / fps))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return frames.withColumn("__rn", rank).filter((F.col("__rn") - 1) % n == 0).drop("__rn")


def sequence_frames(frames: DataFrame, source_fps: float = 30.0, fps: float = 2.0, seconds: float = 2.0, key: str = "sequence", order: str = "frame") -> DataFrame:
    """The sampled frames of each sequence with the ``window_id`` of the time window that they fall in.

    The frames of a window are counted among those that the sample keeps.
    """
    return frame_windows(sample_frames(frames, source_fps, fps, key, order), max(1, int(seconds * fps)), key, order)


def frame_windows(frames: DataFrame, size: int, key: str = "sequence", order: str = "frame") -> DataFrame:
    """window_id of each frame: ``size`` frames of a sequence in a row belong together."""
    return frames.withColumn("window_id", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / size))
