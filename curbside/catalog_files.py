"""Registered queries that write files and tables from the given ones and read them back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from curbside import catalog_rules
from curbside.catalog_images import _bytes, _gray, _pictures
from curbside.operators import detection, pixels, release
from curbside.plans import ingest, tables
from curbside.registry import EVENTS, KEYS, ORACLES, query, table
from curbside.runtime import cut, scratch
from curbside.settings import Source
from curbside.sources import images, scans, sinks

_NAME = "lpad({}::VARCHAR, 6, '0')"


def _name(suffix: str) -> F.Column:
    return F.concat(F.lpad(F.col("vec_id").cast("string"), 6, "0"), F.lit(suffix))


def _written(rows: DataFrame, folder: str) -> None:
    """Writes the files; the counts of what was written are asked for and dropped."""
    images.write_files(rows, folder).agg(F.sum("n_bytes")).collect()


def _picture_files(spark, sf_dir) -> DataFrame:
    """vec_id and the PNG file of its picture."""
    return images.as_png(_pictures(spark, sf_dir).withColumnRenamed("source", "data"), ["vec_id"])


def _source_folders(spark, sf_dir) -> list[Source]:
    """Three sources made from the vectors: labelled images of two splits, the frames of a sequence, and folders by class."""
    root, k = scratch(spark, "sources"), F.col("vec_id")
    files = _picture_files(spark, sf_dir)
    split = F.when(k % 2 == 0, "train/").otherwise("valid/")
    folder = F.when(k % 3 == 0, F.concat(F.lit("yolo/"), split, F.lit("images/"))).when(k % 3 == 1, "mot/img1/").otherwise(F.concat(F.lit("folders/"), k % 2, F.lit("/")))
    _written(files.select(F.concat(folder, _name(".png")).alias("file_name"), "content"), root)
    labels = F.concat(k % 3, F.lit(" "), (1 + k % 7) / 8, F.lit(" 0.5 0.25 0.5\nbad\n\n"), k % 2, F.lit(" 0.25 0.25 0.5 0.125\n"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id")
    _written(vectors.filter("vec_id % 12 < 9 AND vec_id % 3 = 0").select(F.concat(F.lit("yolo/"), split, F.lit("labels/"), _name(".txt")).alias("file_name"), labels.alias("content")), root)
    frames = vectors.filter("vec_id % 3 = 1").repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    line = F.concat_ws(",", k, F.lit(1), k % 5, k % 4, F.lit(3), F.lit(2), F.lit(1))
    full = F.concat(line, F.lit(","), F.when(k % 5 == 0, 7).otherwise(1), F.lit(","), (k % 4) / 4)
    frames.select(F.when(k % 7 == 0, line).otherwise(full).alias("value")).write.text(f"{root}/mot/gt/gt.txt")
    return [
        Source("cp", "yolo", f"{root}/yolo", ("train",), ("val",), {"train": "train/images", "val": "valid/images", "test": "test/images"}, {"train": "train/labels", "val": "valid/labels"}),
        Source("seq", "mot", f"{root}/mot", ("train",), sequence_dir="img1", gt_dir="gt", source_fps=30, fps=10, window_seconds=0.4),
        Source("hd", "classification_folders", f"{root}/folders", ("train",), positive_dir="1"),
    ]


@query(f"""WITH e AS (SELECT vec_id AS k, {_NAME.format('vec_id')} AS n FROM embeddings),
f AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS r FROM e WHERE k % 3 = 1), s AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS o FROM f WHERE r % 3 = 0),
im AS (SELECT 0 AS so, CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END AS sp, k, 'cp' AS source_id, CASE WHEN k % 2 = 0 THEN 'train' ELSE 'val' END AS split, 'cp_' || CASE WHEN k % 2 = 0 THEN 'train_' ELSE 'val_' END || n AS image_id, NULL AS g FROM e WHERE k % 3 = 0
 UNION ALL SELECT 1, 0, k, 'seq', 'train', 'seq_' || n, 'seq_window_' || (o // 4) FROM s UNION ALL SELECT 2, 0, k, 'hd', 'train', 'hd_pos_' || n, NULL FROM e WHERE k % 3 = 2 AND k % 2 = 1),
q AS (SELECT *, row_number() OVER (ORDER BY so, sp, k) - 1 AS ingest_seq FROM im),
b AS (SELECT image_id, image_id || '_0' AS instance_id, k % 3 = 0 AS person, (1 + k % 7) - 1.0 AS x, 2.0 AS y, 2.0 AS w, 4.0 AS h, NULL AS occlusion, 1.0 AS confidence FROM q WHERE so = 0 AND k % 12 < 9
 UNION ALL SELECT image_id, image_id || '_3', k % 2 = 0, 0.0, 1.5, 4.0, 1.0, NULL, 1.0 FROM q WHERE so = 0 AND k % 12 < 9
 UNION ALL SELECT image_id, image_id || '_0', true, k % 5, k % 4, 3.0, 2.0, CASE WHEN k % 7 > 0 THEN 1 - (k % 4) / 4.0 END, 1.0 FROM q WHERE so = 1 AND (k % 7 = 0 OR k % 5 > 0)
 UNION ALL SELECT image_id, image_id || '_0', true, 0.0, 0.0, 8.0, 8.0, NULL, 0.0 FROM q WHERE so = 2)
SELECT q.image_id, source_id, split, coalesce(g, q.image_id) AS group_id, 8 AS width, 8 AS height, ingest_seq, instance_id, CASE WHEN person THEN 'pedestrian' WHEN NOT person THEN 'ignore' END AS class_name,
x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS w, h::DOUBLE AS h, occlusion::DOUBLE AS occlusion, NOT person AS ignore, confidence::DOUBLE AS confidence FROM q LEFT JOIN b USING (image_id)""")
def ingested_boxes(spark, sf_dir):
    """Images and boxes that an ingest makes of the folders of three sources."""
    out = ingest.ingest(spark, _source_folders(spark, sf_dir))
    own = out["images"].select("image_id", "source_id", "split", "group_id", "width", "height", F.col("ingest_seq").cast("bigint").alias("ingest_seq"))
    return own.join(out["instances"].select("image_id", "instance_id", "class_name", *"xywh", "occlusion", "ignore", "confidence"), "image_id", "left")


def _from_files(spark, sf_dir) -> DataFrame:
    folder = scratch(spark, "pictures")
    _written(_picture_files(spark, sf_dir).select(_name(".png").alias("file_name"), "content"), folder)
    return images.pictures(spark, folder).withColumn("vec_id", F.regexp_extract("file", r"(\d+)\.png$", 1).cast("bigint"))


@query(ORACLES["perceptual_hashes"])
def file_hashes(spark, sf_dir):
    """Hashes of pictures that were written as files and are decoded by Spark, but for their first bit."""
    return pixels.perceptual_hash(_from_files(spark, sf_dir), ["vec_id"]).select("vec_id", F.col("h").bitwiseAND(F.lit((1 << 63) - 1)).alias("low_bits"))


@query(ORACLES["crop_pixels"])
def file_crops(spark, sf_dir):
    """Windows of pictures that were written as files, resized by area sampling."""
    rows = _from_files(spark, sf_dir).withColumns({"x1": F.lit(0), "y1": F.lit(0), "x2": F.lit(6), "y2": F.lit(8), "out_width": F.lit(3), "out_height": F.lit(2)})
    return pixels.crop_pixels(rows, ["vec_id"]).select("vec_id", F.hex("crop").alias("crop"))


@query(f"""SELECT {_NAME.format('vec_id')} || CASE vec_id % 4 WHEN 1 THEN '.PNG' ELSE '.png' END AS file_name, CASE WHEN vec_id % 3 = 0 THEN 'val' ELSE 'train' END AS split,
CASE vec_id % 5 WHEN 0 THEN 'say "' || vec_id || '", twice' WHEN 1 THEN 'two' || chr(10) || 'lines' ELSE 'usual' END AS caption FROM embeddings WHERE vec_id % 4 <> 2""")
def dataset_files(spark, sf_dir):
    """Source images of split folders with their captions; masks and labels among them are passed over."""
    root, k = scratch(spark, "dataset"), F.col("vec_id")
    suffix = F.when(k % 4 == 1, ".PNG").when(k % 4 == 2, "_mask.png").otherwise(".png")
    name = F.concat(_name(""), suffix)
    _written(_picture_files(spark, sf_dir).select(F.concat(F.when(k % 3 == 0, "valid/").otherwise("train/a/"), name).alias("file_name"), "content"), root)
    told = F.when(k % 5 == 0, F.concat(F.lit('say "'), k, F.lit('", twice'))).when(k % 5 == 1, "two\nlines")
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("x/"), name).alias("file_name"), told.alias("caption"))
    rows.write.csv(f"{root}/captions", header=True, quote='"', escape='"')
    found = scans.dataset(spark, root, {"train": f"{root}/train", "val": f"{root}/valid"}, scans.captions(spark, f"{root}/captions"), "usual")
    return found.select("file_name", "split", "caption")


@query(ORACLES["release_samples"])
def published_release(spark, sf_dir):
    """Samples of a release, read from the version that was committed last."""
    folder = scratch(spark, "release")
    built = catalog_rules._release(spark, sf_dir)
    built["status"] = cut(built["status"], "status")  # both versions note it
    record = cut(sinks.release_record(built["samples"].select("image_id", "split"), "r", "<vin_ped>", "v1"), "record")
    sinks.publish_release(spark, folder, built | {"samples": built["samples"].limit(3)}, record)
    sinks.publish_release(spark, folder, built, record)
    return sinks.Versions(spark, folder).read("samples").select(*KEYS, "group_id", "duplicate_cluster_id", "split")


@query(f"SELECT case_id, image_id, eval_set FROM ({ORACLES['eval_cases']})")
def written_cases(spark, sf_dir):
    """Frozen cases, read back from their files by set."""
    path = scratch(spark, "cases")
    found = catalog_rules.eval_cases(spark, sf_dir).withColumn("group_id", F.col("image_id"))
    sinks.eval_cases(found, f"{path}/cases", f"{path}/manifest")
    return spark.read.schema("case_id string, image_id long, eval_set string").json(f"{path}/cases").select("case_id", "image_id", "eval_set")


@query(f"""{EVENTS} SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, count(*) AS n_missing FROM ev GROUP BY event_type""")
def written_csv(spark, sf_dir):
    """Rows of a CSV file with a fixed list of columns, one of them missing, read back."""
    path = scratch(spark, "csv")
    sinks.fixed_csv(tables.events(spark, sf_dir), ["event_id", "event_type", "value", "absent"], path, order="event_id")
    rows = spark.read.schema("event_id long, event_type string, value double, absent string").csv(path, header=True)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.count_if(F.col("absent").isNull()).alias("n_missing"))


@query(f"{EVENTS} SELECT count(*) AS n, count(*) FILTER (event_type = 'purchase') AS n_accepted FROM ev")
def written_summary(spark, sf_dir):
    """A one-row result, read back from its CSV form."""
    path = scratch(spark, "summary")
    sinks.one_row(tables.events(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("n_accepted")), path)
    return spark.read.schema("n long, n_accepted long").csv(f"{path}/csv", header=True)


@query("""WITH s AS (SELECT r, vec_id // 4 AS g, CASE WHEN r = 'flawed' AND vec_id % 7 = 0 THEN '' ELSE '<vin_ped> ' || vec_id END AS caption,
CASE WHEN (CASE r WHEN 'sound' THEN vec_id // 4 ELSE vec_id END) % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM embeddings, (VALUES ('sound'), ('flawed')) t(r)),
x AS (SELECT r, count(*) AS shared FROM (SELECT r, g FROM s GROUP BY r, g HAVING count(DISTINCT split) = 2) GROUP BY r),
c AS (SELECT r, count(*) FILTER (split = 'train') AS train_count, count(*) FILTER (split = 'val') AS val_count, count(*) FILTER (NOT contains(caption, '<vin_ped>')) AS lacking, count(*) FILTER (trim(caption) = '') AS blank FROM s GROUP BY r),
e AS (SELECT c.*, concat_ws('; ', CASE WHEN lacking > 0 THEN 'captions without trigger' END, CASE WHEN blank > 0 THEN 'blank captions' END, CASE WHEN train_count = 0 THEN 'lora_train is empty' END,
CASE WHEN val_count = 0 THEN 'lora_val is empty' END, CASE WHEN shared > 0 THEN 'group_id overlap' END) AS errors FROM c LEFT JOIN x USING (r))
SELECT r AS release_name, CASE WHEN errors = '' THEN 'validated' ELSE 'draft' END AS dataset_status, train_count, val_count, errors FROM e""")
def written_provenance(spark, sf_dir):
    """What training runs note about two releases, one sound and one not: the record and the report are read back from files."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("vec_id").alias("duplicate_cluster_id"), F.expr("vec_id div 4").alias("group_id"))
    out = None
    for name, dealt in (("sound", F.col("group_id")), ("flawed", F.col("image_id"))):
        path = scratch(spark, f"provenance_{name}")
        caption = F.concat(F.lit("<vin_ped> "), F.col("image_id").cast("string"))
        caption = caption if name == "sound" else F.when(F.col("image_id") % 7 == 0, "").otherwise(caption)
        samples = rows.withColumns({"split": F.when(dealt % 5 == 0, "val").otherwise("train"), "caption": caption})
        status = release.status(release.validation(samples, "<vin_ped>"), release.leaks(samples, rows.filter("image_id < 0")))
        record = sinks.write_validation(sinks.release_record(samples, name, "<vin_ped>", "v1"), status, path)
        sinks.one_row(sinks.provenance(record, path), f"{path}/dataset")
        noted = spark.read.json(f"{path}/dataset/json").select("release_name", "dataset_status", "train_count", "val_count")
        noted = noted.crossJoin(spark.read.schema("errors string").json(f"{path}/validation_report"))  # single rows
        out = noted if out is None else out.unionByName(noted)
    return out


@query("""SELECT 'images/' || vec_id || '.jpg' AS file_name, 'vector ' || vec_id AS text, CASE WHEN vec_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, 192::BIGINT AS n_bytes FROM embeddings WHERE vec_id % 3 <> 0""")
def written_metadata(spark, sf_dir):
    """The metadata of a release beside its crops, by split, read back from files; a third of the samples have no crop."""
    path = scratch(spark, "metadata")
    split, number = F.when(F.col("vec_id") % 5 == 0, "val").otherwise("train").alias("split"), F.col("vec_id").cast("string")
    crop = F.concat(F.lit("/crops/"), number).alias("crop_path")
    samples = table(spark, sf_dir, "embeddings").select(number.alias("sample_id"), crop, F.concat(F.lit("vector "), number).alias("caption"), split)
    crops = _pictures(spark, sf_dir).filter("vec_id % 3 <> 0").select(crop, F.concat(F.lit("images/"), number, F.lit(".jpg")).alias("file_name"), "width", "height", F.col("source").alias("data"), split)
    sinks.release_metadata(samples, crops, f"{path}/metadata")
    sinks.release_images(crops, f"{path}/images")
    stored = spark.read.parquet(f"{path}/images").select("file_name", "split", F.octet_length("data").cast("bigint").alias("n_bytes"))
    return spark.read.schema("file_name string, text string, split string").json(f"{path}/metadata").join(stored, ["file_name", "split"]).select("file_name", "text", "split", "n_bytes")


class _Bright:
    """A detector of what is brighter than a level: one box around it, and its mask."""

    level = 150

    def picture(self, row) -> np.ndarray:
        return np.frombuffer(row.source, np.uint8).reshape(row.height, row.width, 3)[:, :, 0] > self.level

    def boxes(self, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples(index=False):
            on = self.picture(r)
            if on.any():
                ys, xs = np.nonzero(on)
                out.append((r.image_id, 0, float(xs.min()), float(ys.min()), float(xs.max() + 1), float(ys.max() + 1), float(on.mean()), 0))
        return pd.DataFrame(out, columns=["image_id", "det_idx", "x1", "y1", "x2", "y2", "conf", "cls"])

    def masks(self, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(r.image_id, r.width, r.height, (half * 255).astype(np.uint8).tobytes(), 0.0, 0.0, 8.0, 8.0, float(half.mean())) for r in pdf.itertuples(index=False) for half in (self.picture(r), ~self.picture(r))]
        return pd.DataFrame(rows, columns=["image_id", "width", "height", "mask", "x1", "y1", "x2", "y2", "conf"])


_BRIGHT = detection.Model("bright", _Bright)
_ON = """WITH px AS (SELECT vec_id::VARCHAR AS image_id, i % 8 AS x, i // 8 AS y, greatest(0, least(255, floor((embedding[i + 1]::DOUBLE + 0.5) * 256)))::INT > 150 AS hit FROM embeddings, range(64) t(i))"""


@query(f"""{_ON} SELECT image_id, (min(x) FILTER (hit))::DOUBLE AS x1, (min(y) FILTER (hit))::DOUBLE AS y1, (max(x) FILTER (hit) + 1)::DOUBLE AS x2, (max(y) FILTER (hit) + 1)::DOUBLE AS y2, round(avg(hit::INT), 6) AS conf FROM px GROUP BY image_id HAVING bool_or(hit)""")
def detector_boxes(spark, sf_dir):
    """Boxes of a user's detector, which each Python worker loads once."""
    rows = _pictures(spark, sf_dir).select(F.col("vec_id").cast("string").alias("image_id"), "width", "height", "source")
    found = detection.detect(rows, lambda model, pdf: model.boxes(pdf), model=_BRIGHT)
    return found.select("image_id", "x1", "y1", "x2", "y2", F.round("conf", 6).alias("conf"))


@query(f"""{_ON}, m AS (SELECT image_id, hit, count(*) AS n FROM px GROUP BY ALL UNION ALL SELECT image_id, NOT hit, 0 FROM px GROUP BY image_id, hit HAVING count(*) = 64) SELECT image_id, max(n) AS largest, min(n) AS smallest FROM m GROUP BY image_id""")
def segmenter_masks(spark, sf_dir):
    """Pixels of the masks of a user's segmenter, the most confident one and the next."""
    rows = _pictures(spark, sf_dir).select(F.col("vec_id").cast("string").alias("image_id"), "width", "height", "source")
    found = detection.segment(rows, lambda model, pdf: model.masks(pdf), model=_BRIGHT)
    size = F.col("conf") * 64
    at = lambda i: F.max(F.when(F.col("mask_idx") == i, size)).cast("bigint")
    return found.groupBy("image_id").agg(at(0).alias("largest"), at(1).alias("smallest"))


@query(f"""WITH px AS (SELECT vec_id, i % 8 AS x, i // 8 AS y, abs(greatest(0, least(255, floor((embedding[i + 1]::DOUBLE + 0.5) * 256)))::INT - greatest(0, least(255, floor((embedding[(i * 5 + 3) % 64 + 1]::DOUBLE + 0.5) * 256)))::INT) AS d FROM embeddings, range(64) t(i)),
c AS (SELECT vec_id, count(*) FILTER (d > 60) AS changed FROM px GROUP BY vec_id), k AS (SELECT vec_id, changed, row_number() OVER (ORDER BY vec_id) - 1 AS kept FROM c WHERE changed >= 16)
SELECT 'pipe_' || vec_id || '_' || (vec_id % 9) || '_' || kept AS case_id, changed, kept FROM k WHERE kept < 40""")
def first_cases(spark, sf_dir):
    """The first forty pairs with enough changed pixels: ranges of the order are read until they are found."""
    rows = _pictures(spark, sf_dir).select(F.col("vec_id").alias("pair_seq"), F.col("vec_id").alias("img_id"), (F.col("vec_id") % 9).alias("ann_id"), "width", "height", "source", "target")
    found = release.first_changed_pairs(rows, lambda some: pixels.change_masks(some, 60, keep=["pair_seq", "img_id", "ann_id"]), 40, 16)
    return found.select("case_id", "changed", F.col("kept").cast("bigint").alias("kept"))


@query(ORACLES["pixel_background"])
def tiled_background(spark, sf_dir):
    """Difference and likeness of pictures that come in four tiles each, outside a grown box."""
    rows, part = _pictures(spark, sf_dir), lambda gray: F.filter(gray, lambda v, i: (F.floor(i % 8 / 4) == F.col("q") % 2) & (F.floor(i / 32) == F.floor(F.col("q") / 2)))
    grays = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("q"), _gray(lambda i: i).alias("a"), _gray(lambda i: (i * 5 + 3) % 64).alias("b"))
    tiles = grays.select(F.col("vec_id"), (F.col("q") % 2 * 4).alias("left"), (F.floor(F.col("q") / 2) * 4).alias("top"), F.lit(4).alias("width"), F.lit(4).alias("height"), _bytes(part(F.col("a")), 3).alias("source"), _bytes(part(F.col("b")), 3).alias("target"))
    found = pixels.tile_background(tiles.join(rows.select("vec_id", "x1", "y1", "x2", "y2"), "vec_id").withColumnRenamed("vec_id", "case_id"), 1)
    return found.select("case_id", F.round("bg_mae", 6).alias("bg_mae"), F.round("bg_ssim", 6).alias("bg_ssim"))
