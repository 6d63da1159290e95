"""From folders to tables: scans, pixels from files, the whole ingest."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbside.operators import pixels, release
from curbside.plans import ingest, release_build
from curbside.settings import CaptionSettings, CurationSettings, Source, SourceRole, registry, sources_of
from curbside.sources import images, scans


def picture(path, array):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(images.png_bytes(array.shape[1], array.shape[0], array.tobytes()))


def colours(seed, h=40, w=30):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3), np.uint8)


@pytest.fixture
def folders(tmp_path):
    for i, name in enumerate(["b", "a", "instance_01", "colorado_street"]):
        picture(tmp_path / f"yolo/train/images/{name}.png", colours(i))
    (tmp_path / "yolo/train/images/notes.md").write_text("x")
    picture(tmp_path / "yolo/valid/images/v.png", colours(1))
    (tmp_path / "yolo/train/labels").mkdir()
    (tmp_path / "yolo/train/labels/b.txt").write_text("0 0.5 0.5 0.2 0.4\n1 2\n\n2 0.1 0.1 0.1 0.1\n")
    (tmp_path / "yolo/train/labels/stray.txt").write_text("0 0.5 0.5 0.2 0.4\n")
    for i in range(20):
        picture(tmp_path / f"mot/S/img1/{i + 1:06d}.png", colours(100 + i))
    (tmp_path / "mot/S/gt").mkdir()
    (tmp_path / "mot/S/gt/gt.txt").write_text("1,1,10,20,30,40,1,1,0.8\n1,2,1,2,3,4,1,7,1\n1,3,5,6,7,8,0,1\n2,1,9,9,9,9,1,1,1\n7,1,1,1,2,2,1,1,0.25\n")
    picture(tmp_path / "pos/1/p.png", colours(0))
    (tmp_path / "pos/1/broken.jpg").write_bytes(b"hello")
    picture(tmp_path / "pos/0/n.png", colours(9))
    return tmp_path


def sources(root):
    return [
        Source("cp", "yolo", f"{root}/yolo", ("train",), ("val",), {"train": "train/images", "val": "valid/images", "test": "test/images"}, {"train": "train/labels", "val": "valid/labels"}),
        Source("mot", "mot", f"{root}/mot", ("train",), sequence_dir="S/img1", gt_dir="S/gt", source_fps=30, fps=10, window_seconds=0.3),
        Source("hd", "classification_folders", f"{root}/pos", ("train",)),
    ]


def test_ingest_of_three_parsers(spark, folders):
    out = ingest.ingest(spark, sources(folders))
    rows = out["images"].orderBy("ingest_seq").collect()
    assert [r.ingest_seq for r in rows] == list(range(len(rows)))
    assert [r.image_id for r in rows] == [
        "cp_train_a", "cp_train_b", "cp_train_colorado_street", "cp_train_instance_01", "cp_val_v", *[f"mot_{i:06d}" for i in (1, 4, 7, 10, 13, 16, 19)], "hd_pos_broken", "hd_pos_p",
    ]
    by = {r.image_id: r for r in rows}
    assert (by["cp_train_b"].width, by["cp_train_b"].height, by["cp_train_b"].split, by["cp_train_b"].group_id) == (30, 40, "train", "cp_train_b")
    assert by["cp_train_b"].sha256 == hashlib.sha256((folders / "yolo/train/images/b.png").read_bytes()).hexdigest() == by["hd_pos_p"].sha256
    assert by["cp_train_b"].phash == by["hd_pos_p"].phash != by["cp_train_a"].phash and (by["hd_pos_broken"].width, by["hd_pos_broken"].phash, by["hd_pos_broken"].h) == (0, "", None)
    # Sampled first, windows of three among what is left.
    assert [by[f"mot_{i:06d}"].group_id for i in (1, 4, 7, 10, 19)] == ["mot_window_0"] * 3 + ["mot_window_1", "mot_window_2"]
    got = {r.instance_id: r for r in out["instances"].collect()}
    assert set(got) == {"cp_train_b_0", "cp_train_b_3", "mot_000001_0", "mot_000001_1", "mot_000007_0", "hd_pos_broken_0", "hd_pos_p_0"}
    assert (got["cp_train_b_0"].x, got["cp_train_b_0"].h, got["cp_train_b_0"].occlusion, got["cp_train_b_0"].ignore) == (12.0, 16.0, None, False) and got["cp_train_b_3"].ignore
    assert (got["mot_000001_0"].occlusion, got["mot_000001_1"].occlusion) == (pytest.approx(0.2), None) and (got["hd_pos_p_0"].w, got["hd_pos_p_0"].confidence) == (30.0, 0.0)


def test_release_from_folders(spark, folders):
    out = ingest.ingest(spark, sources(folders))
    roles = registry(spark, [SourceRole("cp", "train", "train"), SourceRole("cp", "val", "eval"), SourceRole("mot", "train", "train"), SourceRole("hd", "train", "train")])
    built = release_build.build(out["images"], out["instances"], roles, CurationSettings(min_height=10, min_quality=0.5), CaptionSettings())
    status = {r.image_id: r.dedupe_status for r in built["groups"].collect()}
    assert status["hd_pos_p"] == "exact_duplicate" and status["cp_train_b"] == "unique"
    assert {r.instance_id for r in built["samples"].collect()} == {"cp_train_b_0", "mot_000001_0"}


def test_each_image_is_decoded_once_and_no_frame_beside_the_sample(spark, folders, monkeypatch):
    seen, hashed = spark.sparkContext.accumulator(0), pixels.perceptual_hash

    def counted(rows, keep):
        def same(v):
            seen.add(1)
            return v

        return hashed(rows.withColumn("width", F.udf(same, "int")("width")), keep)

    monkeypatch.setattr(ingest.pixels, "perceptual_hash", counted)
    assert ingest.ingest(spark, sources(folders))["images"].count() == 14 == seen.value


def test_written_files_leave_nothing_beside_them(spark, tmp_path):
    rows = spark.createDataFrame([(f"{k % 3}/{k}.txt", f"text {k}") for k in range(20)], "file_name string, content string").repartition(4)
    for _ in range(2):
        assert {(r.file_name, r.n_bytes) for r in images.write_files(rows, f"file://{tmp_path}").collect()} == {(f"{k % 3}/{k}.txt", len(f"text {k}")) for k in range(20)}
    assert {str(f.relative_to(tmp_path)): f.read_text() for f in tmp_path.rglob("*") if f.is_file()} == {f"{k % 3}/{k}.txt": f"text {k}" for k in range(20)}
    assert {f.name for f in tmp_path.iterdir()} == {"0", "1", "2"}


def test_nothing_to_ingest_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        ingest.ingest(spark, sources(tmp_path))
    (tmp_path / "pos/1").mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        ingest.ingest(spark, sources(tmp_path))
    with pytest.raises(ValueError, match="parser"):
        ingest.ingest(spark, [Source("x", "csv", str(tmp_path))])


def test_sources_of_a_configuration():
    config = {"sources": [{"source_id": "a", "parser": "mot", "kaggle_mount": "/m", "lora_splits": ["train"], "temporal_sampling_fps": 4.0, "notes": "x", "eval_splits": []}]}
    assert sources_of(config) == [Source("a", "mot", "/m", ("train",), fps=4.0)]


def test_pixels_from_files_equal_those_of_tables(spark, tmp_path):
    arrays = [colours(i, 37, 53) for i in range(3)]
    for i, a in enumerate(arrays):
        picture(tmp_path / f"{i}.png", a)
    read = images.pictures(spark, str(tmp_path)).withColumn("k", F.regexp_extract("file", r"(\d+)\.png$", 1).cast("int"))
    table = spark.createDataFrame([(i, 53, 37, bytearray(a.tobytes())) for i, a in enumerate(arrays)], "k int, width int, height int, data binary")
    hashes = lambda df: {r.k: r.phash for r in pixels.perceptual_hash(df, ["k"]).collect()}
    assert hashes(read) == hashes(table) and len(set(hashes(read).values())) == 3
    window = {"x1": 5, "y1": 3, "x2": 45, "y2": 33, "out_width": 20, "out_height": 10}
    crops = lambda df: {r.k: bytes(r.crop) for r in pixels.crop_pixels(df.withColumns({k: F.lit(v) for k, v in window.items()}), ["k"]).collect()}
    assert crops(read) == crops(table)
    mean = arrays[0][3:33, 5:45].reshape(10, 3, 20, 2, 3).mean((1, 3))
    assert np.abs(np.frombuffer(crops(read)[0], np.uint8).reshape(10, 20, 3) - mean).max() <= 0.5


def test_headers_and_names(spark, tmp_path):
    picture(tmp_path / "instance_01.png", colours(0))
    picture(tmp_path / "b/colorado_street.PNG", colours(1))
    far = b"\xff\xd8" + b"\xff\xe1\xff\xff" + b"\0" * 65533 + b"\xff\xc2\x00\x11\x08\x01\x02\x03\x04\x03rest"
    (tmp_path / "far.jpg").write_bytes(far)
    (tmp_path / "cut.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    got = {r.path.rpartition("/")[2]: (r.width, r.height) for r in scans.inventory(spark, str(tmp_path)).collect()}
    assert got == {"instance_01.png": (30, 40), "colorado_street.PNG": (30, 40), "far.jpg": (0x304, 0x102), "cut.png": (0, 0)}
    assert [r.path.rpartition("/")[2] for r in scans.source_images(spark, str(tmp_path)).collect() if "01" in r.path] == []


def test_listing_passes_over_what_is_not_mounted(spark, tmp_path):
    picture(tmp_path / "here/a.png", colours(0))
    roots = {"s": {"train": f"{tmp_path}/here", "val": f"{tmp_path}/gone"}, "t": {"train": f"{tmp_path}/gone"}}
    assert scans.inventories(spark, roots, {"s": ["train", "val"], "t": ["train"]}, skip_missing=True).count() == 1
    with pytest.raises(FileNotFoundError):
        scans.inventories(spark, roots, {"t": ["train"]})
    assert scans.usual_splits(["val"], ["train"]) == ["val"] and scans.usual_splits([], ["lora"]) == ["lora"] and scans.usual_splits() == ["train"]


def test_caption_files(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('﻿file_name,filename,caption,prompt,text\nx/a.png,,"say ""hi"", twice",,no\n,b.png,,"two\nlines",no\nc.png,,old,,no\nc.png,,new,,no\nd.png,,,,no\n', encoding="utf-8")
    assert {r.file_name: r.caption for r in scans.captions(spark, str(path)).collect()} == {"a.png": 'say "hi", twice', "b.png": "two\nlines", "c.png": "new"}
    other = tmp_path / "d.csv"
    other.write_text("image,text,prompt\na.png,wrong,right\n")
    assert [tuple(r) for r in scans.captions(spark, str(other)).collect()] == [("a.png", "right")]


def test_first_pairs_in_file_order(spark, tmp_path):
    rows = spark.range(100).selectExpr("id AS img_id", "100 - id AS other")
    rows.repartitionByRange(4, "img_id").sortWithinPartitions("img_id").write.parquet(f"{tmp_path}/pairs")
    assert sorted(r.img_id for r in scans.pairs(spark, f"{tmp_path}/pairs", 30).collect()) == list(range(30))


def test_statuses_and_hot_hashes(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**62, 30)]
    # A third of all images share one hash; the others are up to eight bits from some base.
    rows = [(f"i{k:04d}", "s", base[0] if k % 3 == 0 else base[k % 30] ^ sum(1 << int(b) for b in rng.choice(62, k % 9, replace=False)), k, f"h{k}", "unique") for k in range(600)]
    images_ = spark.createDataFrame(rows, "image_id string, source_id string, h long, ingest_seq long, sha256 string, dedupe_status string").repartition(8)
    want = {}
    for j, (name, _, h, *_) in enumerate(rows):
        earlier = [rows[i][0] for i in range(j) if bin(rows[i][2] ^ h).count("1") <= 6]
        want[name] = (earlier[-1], "near_duplicate") if earlier else (name, "unique")
    assert {r.image_id: (r.duplicate_cluster_id, r.dedupe_status) for r in release.near_clusters(images_, 6).collect()} == want
    # The same content under a third of all images.
    same = images_.withColumn("sha256", F.when(F.col("ingest_seq") % 3 == 0, "one").otherwise(F.col("sha256")))
    got = {r.image_id: (r.canonical_image_id, r.dedupe_status) for r in release.exact_groups(same).collect()}
    assert got["i0003"] == ("i0000", "exact_duplicate") and got["i0000"] == ("i0000", "unique") and got["i0004"] == ("i0004", "unique") and len(got) == 600
