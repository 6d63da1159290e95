import math
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curbside.components import connected_components
from curbside.functions import geometry as geo, scores, text
from curbside.operators import attempts, detection, metrics, pixels, placement, release
from curbside.plans import release_build
from curbside.settings import CaptionSettings, CurationSettings, SourceRole, registry
from curbside.sources import scans, sinks


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def box(*v):
    return geo.Box(*(F.lit(float(x)) for x in v))


def test_boxes(spark):
    ok, share = geo.depth_order_ok(box(120, 210, 190, 430), box(187, 300, 237, 390))
    bad, _ = geo.depth_order_ok(box(120, 270, 170, 390), box(140, 230, 220, 410))
    r = one(spark, geo.iou(box(0, 0, 10, 10), box(5, 0, 15, 10)).alias("i"), ok.alias("ok"), share.alias("s"), bad.alias("bad"), geo.iou(box(0, 0, 1, 1), geo.Box(*[F.lit(None).cast("double")] * 4)).alias("n"))
    assert r.i == pytest.approx(1 / 3) and r.ok and 0 < r.s <= 0.08 and not r.bad and r.n is None
    c = one(spark, *geo.clamp(box(-3.5, 2.5, 700, 2.6), F.lit(512), F.lit(512)).columns())
    assert (c.x1, c.y1, c.x2, c.y2) == (0, 2, 512, 3)


def test_presence_inclusion_scale(spark):
    rows = [("a", 0, 10.0, 10.0, 30.0, 60.0, 0.9, 0), ("a", 1, 40.0, 40.0, 50.0, 55.0, 0.4, 0), ("b", 0, 0.0, 0.0, 5.0, 5.0, 0.9, 2)]
    det = spark.createDataFrame(rows, "image_id string, det_idx int, x1 double, y1 double, x2 double, y2 double, conf double, cls int")
    images = spark.createDataFrame([("a",), ("b",), ("c",)], "image_id string")
    got = {r.image_id: r for r in metrics.presence(images, metrics.keep_detections(det, 0.25)).collect()}
    assert (got["a"].person_detected, got["a"].person_count, got["a"].person_confidence) == (1, 2, 0.9) and got["b"].person_detected == 0 and got["c"].person_count == 0
    expected = spark.createDataFrame([("a", 40.0), ("b", None)], "image_id string, expected_height double")
    got = {r.image_id: r for r in metrics.scale(det, expected).collect()}
    assert got["a"].scale_ratio == 1.25 and got["a"].scale_error == 0.25 and got["b"].scale_ratio is None


def test_affordance_cases(spark):
    def score(y1, y2):
        b = box(220, y1, 270, y2)
        p = scores.placement_score(b, F.lit(512.0), F.lit(512.0), F.lit(430.0))["placement_score"]
        s = scores.scale_score(b, F.lit(150.0))["scale_score"]
        o = scores.occlusion_score(b, F.lit(5000.0), F.lit(512.0), F.lit(512.0), F.lit(0.0))["occlusion_score"]
        return one(spark, p.alias("p"), s.alias("s"), o.alias("o"), scores.affordance(p, s, o).alias("a"), scores.affordance_reason(p, s, o, b.height, F.lit(150.0)).alias("why"))

    good, bad = score(280, 430), score(70, 190)
    assert good.p >= 0.6 and good.s >= 0.6 and good.o >= 0.5 and good.why == "" and bad.p < 0.6 and bad.why == "bad_placement"
    r = one(spark, scores.affordance(F.lit(0.9), F.lit(None).cast("double"), F.lit(0.6)).alias("a"), *[c.alias(n) for n, c in zip(("lo", "hi"), scores.wilson(F.lit(69), F.lit(100)), strict=True)])
    assert r.a == pytest.approx(0.8) and round(r.lo, 3) == 0.594 and round(r.hi, 3) == 0.772


def test_manifest_and_rollup(spark):
    rows = spark.createDataFrame([("true", 0.9, None), ("true", 0.64, 0.5), ("false", 0.1, None)], "accepted string, affordance_score double, scale_score double")
    r = metrics.run_summary(rows, ["affordance_score"]).first()
    assert (r.generated, r.accepted, r.mean_affordance_score) == (3, 2, 0.77)
    runs = spark.createDataFrame([("a", 50, 30, 0.9676), ("b", 50, 36, 0.9742), ("c", 50, 37, 0.9284)], "run string, generated int, accepted int, mean_scale double")
    r = metrics.rollup_runs(runs).filter("run IS NULL").first()
    assert round(r.accept_rate, 3) == 0.687 and round(r.mean_scale, 3) == 0.957


def test_paired_directions(spark):
    a = spark.createDataFrame([("c", 1, 0.5, 2.0, 0.3)], "case_id string, seed int, person_confidence double, bg_mae double, scale_error double")
    b = spark.createDataFrame([("c", 1, 0.8, 3.0, 0.1)], a.schema)
    got = {r.metric: r.improved for r in metrics.paired(a, b, ["case_id", "seed"]).collect()}
    assert got == {"person_confidence": True, "bg_mae": False, "scale_error": True}


def test_texts(spark):
    def subject(s):
        return one(spark, text.subject_of(F.lit(s)).alias("x")).x

    assert [subject(s) for s in ("add a man wearing a hat", "insert in a pedestrian", "", "   ", "add ")] == ["a man wearing a hat", "a pedestrian", "a person", "a person", "a person"]
    words = ["person", "man", "mane", "german", "hat", "woman", ""]
    assert [one(spark, text.mentions_person(F.lit(w)).alias("x")).x for w in words] == [True, True, False, False, False, True, False]
    reasons = ["RuntimeError last_reason=bad_placement), x", "Composite rejected as foo_bar.", "it was partial_or_cropped_body now", "mixed dtype here", "Whatever). else", ""]
    assert [one(spark, text.reject_reason(F.lit(r)).alias("x")).x for r in reasons] == ["bad_placement", "foo_bar", "partial_or_cropped_body", "pipeline_dtype_mismatch", "Whatever", "unknown"]
    cells = ["12.5", "[1, 3, 2]", "[[4, 5]]", "", "x", None]
    got = [one(spark, text.first_number(F.lit(c).cast("string")).alias("f"), text.largest_number(F.lit(c).cast("string")).alias("l"), text.mean_number(F.lit(c).cast("string")).alias("m")) for c in cells]
    assert [tuple(g) for g in got] == [(12.5, 12.5, 12.5), (1.0, 3.0, 2.0), (4.0, 5.0, 4.5), (None, None, None), (None, None, None), (None, None, None)]
    r = one(spark, text.hamming(F.lit("00000000000000ff"), F.lit("000000000000000f")).alias("d"), text.hamming(F.lit(""), F.lit("0")).alias("e"), text.box_numbers(F.lit("(1,2,3.5,4)")).alias("b"))
    assert (r.d, r.e, r.b) == (4, 999, [1.0, 2.0, 3.5, 4.0])


def test_captions_keep_the_trigger(spark):
    s = CaptionSettings()
    rows = spark.createDataFrame([("citypersons", 0.9), ("mot17_02", 0.4), ("human_detection", 1.0), ("other", None)], "source_id string, visible_ratio double")
    got = [r.caption for r in release.with_captions(rows, s).collect()]
    assert all(s.trigger in c and ", ," not in c for c in got) and "partially occluded" in got[1]
    assert one(spark, text.caption(F.lit(1.0), F.lit("x"), CaptionSettings(template="{framing}, {pose}")).alias("c")).c == "a photo of <vin_ped> pedestrian, full body"


def test_labels(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.5 0.5 0.2 0.4\n1 2\n\n7 0.1 0.1 0.1 0.1\n")
    rows = scans.lines(spark, str(tmp_path / "a.txt")).withColumn("width", F.lit(100)).withColumn("height", F.lit(200))
    got = scans.yolo_boxes(rows, {0: "pedestrian"}).orderBy("line_no").collect()
    assert [(r.line_no, r.class_name) for r in got] == [(0, "pedestrian"), (3, "ignore")] and (got[0].x, got[0].y, got[0].w, got[0].h) == (40, 60, 20, 80)
    (tmp_path / "gt.txt").write_text("45,1,10,20,30,40,1,1,0.8\n46,1,10,20,30,40,1,7\n45,2,1,2,3,4,0,1\n")
    rows = scans.lines(spark, str(tmp_path / "gt.txt"))
    assert [(r.frame, r.box_idx) for r in scans.mot_boxes(rows, strict=True).collect()] == [(45, 0)] and scans.mot_boxes(rows).count() == 2


def png(path, pixels):
    h, w, _ = pixels.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_inventory(spark, tmp_path):
    png(tmp_path / "one.png", np.full((4, 6, 3), 9, np.uint8))
    png(tmp_path / "one_mask.png", np.full((4, 6, 3), 9, np.uint8))
    (tmp_path / "broken.jpg").write_bytes(b"hello")
    got = {r.path.rpartition("/")[2]: r for r in scans.inventory(spark, str(tmp_path)).collect()}
    assert set(got) == {"one.png", "one_mask.png", "broken.jpg"} and (got["one.png"].width, got["one.png"].height, got["broken.jpg"].width) == (6, 4, 0)
    assert got["broken.jpg"].sha256.startswith("2cf24dba") and got["broken.jpg"].sha256.endswith("9824")
    with pytest.raises(ValueError):
        scans.inventories(spark, {}, {"nowhere": ["train"]})
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xc2\x00\x11\x08\x01\x02\x03\x04\x03rest"
    assert scans.image_sides(jpeg) == (0x304, 0x102) and scans.image_sides(jpeg[:12]) == (0, 0) and scans.image_sides(b"") == (0, 0) and scans.image_sides(b"\xff\xd8\x00" * 9) == (0, 0)


def test_near_hash_bands_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63, 40)
    rows = [(int(rng.integers(2)), int(base[i % 40] ^ int(sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 10), replace=False))))) for i in range(300)]
    rows = sorted(set(rows))
    got = {(r.source_id, r.a, r.b) for r in release.near_hashes(spark.createDataFrame(rows, "source_id int, h long"), 6).collect()}
    want = {(s, min(a, b), max(a, b)) for s, a in rows for t, b in rows if s == t and a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 6}
    assert got == want and want
    images = spark.createDataFrame([(i, s, h, i) for i, (s, h) in enumerate(rows)], "image_id long, source_id int, h long, ingest_seq long")
    last = {i: max([j for j, (t, g) in enumerate(rows[:i]) if t == s and bin((g ^ h) & (2**64 - 1)).count("1") <= 6], default=i) for i, (s, h) in enumerate(rows)}
    assert {r.image_id: r.duplicate_cluster_id for r in release.near_clusters(images, 6).collect()} == last
    joined = {r.image_id: r.duplicate_cluster_id for r in release.near_clusters(images, 6, "connected").collect()}
    assert all(joined[i] == joined[last[i]] for i in last)


def test_greedy_match_and_ap(spark):
    kind = "image_id int, idx int, x1 double, y1 double, x2 double, y2 double, conf double"
    truth = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, 0.0), (1, 1, 20.0, 0.0, 30.0, 10.0, 0.0), (2, 0, 0.0, 0.0, 5.0, 5.0, 0.0)], kind)
    pred = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, 1.0, 0.0, 11.0, 10.0, 0.8), (3, 0, 0.0, 0.0, 1.0, 1.0, 0.5)], kind)
    got = {r.image_id: (r.tp, r.fn, r.fp) for r in detection.greedy_matches(truth, pred, 0.5).collect()}
    assert got == {1: (1, 1, 1), 2: (0, 1, 0), 3: (0, 0, 1)}
    assert detection.miss_rate(detection.greedy_matches(truth, pred)).first().miss_rate == pytest.approx(2 / 3)
    ap = {r.threshold: r.ap for r in detection.average_precision(truth, pred, [0.5, 0.95]).collect()}
    assert ap[0.5] == pytest.approx(34 / 101)


def test_attempt_rules(spark):
    rows = spark.createDataFrame([("j", i, r) for i, r in enumerate(["scale_unrecoverable", "scale_unrecoverable", "bad_placement", "scale_unrecoverable"])], "job_id string, seq int, reject_reason string")
    assert [(r.attempt, r.streak) for r in attempts.streaks(rows).orderBy("seq").collect()] == [(0, 1), (1, 2), (2, 0), (3, 1)]
    again = lambda reason, attempt, streak=0, ratio=False: one(spark, scores.should_retry(F.lit(reason), F.lit(attempt), F.lit(4), F.lit(streak), F.lit(ratio), F.lit(None).cast("double"), F.lit(True)).alias("x")).x
    assert again("low_person_conf", 0) and not again("low_person_conf", 4) and not again("low_person_conf", 1, 2) and not again("scale_unrecoverable", 1, 0, True) and not again("mask_too_soft", 1) and not again("other", 0)
    run = spark.createDataFrame([(40, 200, 0.4, 0.9, 0.9, 0.9, 0, 0, 0)], "n_accepted int, n_jobs int, person_p10 double, scale_p10 double, background_p10 double, edge_p10 double, low_person int, bad_scale int, bad_depth int")
    settings = spark.createDataFrame([("CONTEXT_GENERATION_RETRIES", 4.0), ("CONTEXT_PERSON_MIN_CONFIDENCE", 0.12)], "name string, current double")
    got = {r.name: r.value for r in attempts.advice(run, settings).collect()}
    assert got["CONTEXT_GENERATION_RETRIES"] == 5 and got["CONTEXT_PERSON_MIN_CONFIDENCE"] == pytest.approx(0.108)


def test_monotonic_heights_follow_the_loop(spark):
    heights = [50.0, 51.0, 90.0, 80.0, 100.0]
    rows = spark.createDataFrame([("i", float(k), k, h) for k, h in enumerate(heights)], "image_id string, foot_y double, order int, expected_height double")
    want, last = [], None
    for h in heights:
        last = h if last is None else max(h, 1.04 * last)
        want.append(last)
    got = [r.expected_height for r in placement.monotonic_heights(rows).orderBy("order").collect()]
    assert got == pytest.approx(want)


def image_rows(spark, *pairs_):
    return spark.createDataFrame([(k, 64, 64, bytearray(a.tobytes()), bytearray(b.tobytes()), *box_) for k, a, b, box_ in pairs_], "case_id string, width int, height int, source binary, target binary, x1 double, y1 double, x2 double, y2 double")


def test_pixels(spark):
    flat = np.full((64, 64, 3), 120, np.uint8)
    far, near = flat.copy(), flat.copy()
    far[0:10, 0:10] = 0
    near[22:38, 22:38] = 0
    b = (20.0, 20.0, 40.0, 40.0)
    got = {r.case_id: r for r in pixels.background(image_rows(spark, ("same", flat, flat, b), ("far", flat, far, b), ("near", flat, near, b)), 0).collect()}
    assert got["same"].bg_mae == 0 and got["same"].bg_ssim >= 0.99 and got["far"].bg_mae > 0 and got["near"].bg_mae == 0
    source, target = np.full((64, 64, 3), 100, np.uint8), np.full((64, 64, 3), 100, np.uint8)
    target[10:30, 15:35] = 200
    r = {r.case_id: r for r in pixels.change_masks(image_rows(spark, ("x", source, target, b), ("y", source, source, b)), keep=["case_id"]).collect()}
    assert (r["x"].x1, r["x"].y1, r["x"].x2, r["x"].y2, r["x"].changed) == (15, 10, 34, 29, 400) and r["y"].changed == 0 and r["y"].x1 is None
    mask = np.zeros((64, 64), np.uint8)
    mask[8:40, 8:16] = 255
    m = spark.createDataFrame([("m", 64, 64, bytearray(mask.tobytes())), ("none", 64, 64, None)], "image_id string, width int, height int, mask binary")
    r = {r.image_id: r for r in pixels.mask_figures(m).collect()}
    assert (r["m"].x1, r["m"].y2, r["m"].active, r["m"].opaque_share, r["m"].low) == (8, 40, 256, 1.0, 1.0) and r["none"].active == 0
    noise = np.random.default_rng(1).integers(0, 255, (64, 64, 3)).astype(np.uint8)
    brighter = np.clip(noise.astype(int) + 3, 0, 255).astype(np.uint8)
    rows = spark.createDataFrame([(k, 64, 64, bytearray(p.tobytes())) for k, p in (("a", noise), ("b", brighter), ("c", noise[::-1].copy()))], "image_id string, width int, height int, data binary")
    h = {r.image_id: r.phash for r in pixels.perceptual_hash(rows, ["image_id"]).collect()}
    apart = lambda a, b: bin(int(h[a], 16) ^ int(h[b], 16)).count("1")
    assert apart("a", "b") <= 6 < apart("a", "c")


def test_detector_and_release(spark, tmp_path):
    found = detection.detect(spark.createDataFrame([("i",)], "image_id string"), lambda pdf: pd.DataFrame({"image_id": pdf.image_id, "det_idx": 0, "x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0, "conf": 0.5, "cls": 0}))
    assert found.first().conf == 0.5
    images = spark.createDataFrame([(i, "s", "eval" if i >= 18 else "train", i // 2, f"hash{i % 17}", i * 1000003, i) for i in range(20)], "image_id long, source_id string, split string, group_id long, sha256 string, h long, ingest_seq long")
    inst = spark.createDataFrame([(i, "pedestrian", 40.0, 200.0, 40.0, 200.0, 0.0, False) for i in range(20)], "image_id long, class_name string, w double, h double, visible_w double, visible_h double, occlusion double, ignore boolean")
    roles = registry(spark, [SourceRole("s", "train", "train"), SourceRole("s", "eval", "eval")])
    out = release_build.build(images, inst, roles, CurationSettings(train_ratio=0.5), CaptionSettings())
    samples = out["samples"].collect()
    assert {r.image_id for r in samples} == set(range(17)) and not {r.group_id for r in samples if r.split == "train"} & {r.group_id for r in samples if r.split == "val"}
    status = out["status"].first()
    assert status.status == "validated", status
    bad = out["samples"].withColumn("caption", F.lit("no trigger")).withColumn("split", F.when(F.col("image_id") == 0, "val").otherwise("train"))
    row = release.status(release.validation(bad, "<vin_ped>"), release.leaks(bad, images.select("image_id", "group_id"))).first()
    assert row.status == "draft" and all(k in row.errors for k in ("trigger", "group_id overlap", "leaked"))
    a, b = release.content_hash(out["samples"]).first(), release.content_hash(out["samples"].repartition(7)).first()
    assert a == b
    sinks.release_metadata(out["samples"].withColumn("crop_path", F.concat(F.lit("/x/"), F.col("image_id"))).withColumn("sample_id", text.stable_id(F.lit("r"), F.col("image_id"))), spark.createDataFrame([("/x/3",)], "crop_path string"), str(tmp_path / "meta"))
    assert [r.file_name for r in spark.read.json(str(tmp_path / "meta")).collect()] == ["images/r_3.jpg"]
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert math.isclose(one(spark, scores.perspective_scale(F.lit(512 * 0.68)).alias("x")).x, 0.5)


def test_contamination_of_short_and_quoted_items(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    items = [(n, " ".join(words[:n])) for n in range(1, 13)] + [(20, ""), (21, "\nalpha beta gamma delta epsilon\n"), (22, "mu"), (23, None), (24, "beta  gamma"), (24, "zeta eta"), (25, "psi beta gamma delta")]
    line = " ".join(words)
    texts = [f'He said: "{line}", twice', f"({line})", line, f"x {' '.join(words[:8])}, and so on for some more words than eight", "so\nalpha beta gamma delta epsilon\nend", " ".join(words[:5]), "mumu alpha", "beta  gamma", "", None, f"{line} {line}"]
    want = {}
    for i, item in items:
        n = sum(item in t for t in texts if t is not None) if item is not None else 0
        if n:
            want[i] = want.get(i, 0) + n
    got = release.contamination(spark.createDataFrame([(t,) for t in texts], "caption string"), spark.createDataFrame(items, "item_id int, text string"))
    assert {r.item_id: r.n_texts for r in got.collect()} == want


def test_label_places_and_their_order(spark):
    image = "/d/train/images/a.b.png"
    places = ["/d/train/images/a.b.json", "/d/train/images/a.b.txt", "/d/train/labels/a.b.txt", "/d/train/labels/a.b.json", "/cfg/a.b.txt", "/cfg/a.b.json", "/d/train/images/a.b_gtBboxCityPersons.json", "/d/train/images/a.b_gtFine_polygons.json"]
    images = spark.createDataFrame([(image,), ("/d/train/other/x.jpg",), ("images/y.jpg",)], "path string")
    also = ["/d/train/labels/x.txt", "labels/y.txt", "/d/train/images/labels/a.b.txt"]
    found = lambda files, **kw: {r.path: r.label_path for r in scans.match_labels(images, spark.createDataFrame([(f,) for f in files], "path string"), **kw).collect()}
    for i in range(len(places)):
        got = found(places[i:][::-1] + also, split_folders={"val": "/no", "train": "/cfg/"})
        assert got == {image: places[i], "/d/train/other/x.jpg": None, "images/y.jpg": "labels/y.txt"}
    assert found(places[4:6] + also)[image] is None


def test_correction_plan_rejects_by_border_aspect_and_area(spark):
    rows = [
        ("good", 200.0, 100.0, 250.0, 200.0, 120.0), ("slim", 200.0, 100.0, 220.0, 200.0, 120.0), ("stout", 200.0, 100.0, 290.0, 200.0, 100.0),
        ("tiny", 200.0, 190.0, 205.0, 206.0, 14.0), ("border", 3.0, 100.0, 53.0, 200.0, 100.0), ("far", 200.0, 100.0, 250.0, 200.0, 400.0),
    ]
    items = spark.createDataFrame(rows, "k string, x1 double, y1 double, x2 double, y2 double, expected_height double").withColumns({"conf": F.lit(0.9), "mask_share": F.lit(0.01), "width": F.lit(512), "height": F.lit(512)})
    got = {r.k: r for r in placement.correction_plan(items).collect()}
    bad = "bad_scale_geometry_after_resize"
    assert {k: r.status for k, r in got.items()} == {"good": "recoverable", "slim": bad, "stout": bad, "tiny": bad, "border": "border_reject_after_resize", "far": "unrecoverable"}
    assert [k for k, r in got.items() if r.reject_reason == ""] == ["good"]
    assert (got["good"].r_x1, got["good"].r_y1, got["good"].r_x2, got["good"].r_y2) == (195, 80, 255, 200)


def test_advice_on_mean_quality(spark):
    run = spark.createDataFrame([(150, 200, 0.9, 0.9, 0.9, 0.9, 0, 0, 0, 0.7)], "n_accepted int, n_jobs int, person_p10 double, scale_p10 double, background_p10 double, edge_p10 double, low_person int, bad_scale int, bad_depth int, quality_mean double")
    settings = spark.createDataFrame([("CONTEXT_GENERATION_RETRIES", 4.0)], "name string, current double")
    assert {r.name: r.value for r in attempts.advice(run, settings).collect()} == {"GENERATION_STRENGTH_DELTA": 0.01, "GENERATION_GUIDANCE_DELTA": 0.10}
    assert attempts.advice(run.withColumn("quality_mean", F.lit(0.72)), settings).count() == 0


def test_settings_files(spark, tmp_path):
    import json

    from curbside import settings

    config = {"sources": [{"source_id": "a", "lora_splits": ["train"], "eval_splits": ["val", "test"]}, {"source_id": "b", "lora_splits": ["train"], "eval_splits": None}], "quality_thresholds": {"min_bbox_height_px": 50}, "split_config": {"train_ratio": 0.5}}
    (tmp_path / "c.json").write_text(json.dumps(config))
    read = settings.load(str(tmp_path / "c.json"))
    assert [(r.source_id, r.split, r.role) for r in settings.roles_of(read)] == [("a", "train", "train"), ("a", "val", "eval"), ("a", "test", "eval"), ("b", "train", "train")]
    own = settings.curation_of(read)
    assert (own.min_height, own.train_ratio, own.min_visible) == (50, 0.5, 0.45)
    (tmp_path / "p.yaml").write_text("trigger_token: <x>\ncaption_template: >\n  a  {framing},\n  {scene}\n")
    assert settings.captions_of(settings.load(str(tmp_path / "p.yaml"))).template == "a {framing}, {scene}"


def test_scans_of_folders(spark, tmp_path):
    for folder in ("train/images", "val"):
        (tmp_path / folder).mkdir(parents=True)
    for name in ("train/images/b.png", "train/images/a.png", "val/c.png", "val/c_color.png"):
        png(tmp_path / name, np.full((4, 6, 3), 9, np.uint8))
    (tmp_path / "captions.csv").write_text("\ufefffilename,prompt\n/x/a.png,first\nb.png,\n")
    told = scans.captions(spark, str(tmp_path / "captions.csv"))
    got = scans.dataset(spark, str(tmp_path), {"train": str(tmp_path / "train"), "val": str(tmp_path / "val")}, told, "usual")
    assert sorted((r.file_name, r.split, r.caption) for r in got.collect()) == [("a.png", "train", "first"), ("b.png", "train", "usual"), ("c.png", "val", "usual")]
    assert [r.path[-5:] for r in scans.dataset(spark, str(tmp_path), {"train": str(tmp_path / "train")}, limit=1).collect()] == ["a.png"]
    (tmp_path / "empty").mkdir()
    by_path = scans.dataset(spark, str(tmp_path), {"train": str(tmp_path / "empty")}, default="d")
    assert sorted((r.path[-5:], r.split) for r in by_path.collect()) == [("a.png", "train"), ("b.png", "train"), ("c.png", "val")]
    both = scans.inventories(spark, {"s": {"t": str(tmp_path / "train"), "v": str(tmp_path / "val")}}, {"s": ["v", "t"]}, 3)
    assert sorted((r.split, r.path[-5:]) for r in both.collect()) == [("t", "a.png"), ("v", "c.png"), ("v", "r.png")]
    (tmp_path / "list.txt").write_text("/d/images/x/images/1.2.jpg\n\n/d/plain/7.png\nimages/3.jpg\n")
    rows = scans.split_listing(spark, str(tmp_path / "list.txt"))
    assert sorted(r.label_path for r in rows.collect()) == ["/d/labels/7.txt", "/d/labels/x/images/1.2.txt", "labels/3.txt"]
    assert scans.split_listing(spark, str(tmp_path / "val")).count() == 2
    paths = spark.createDataFrame([("/q/IMG1/000012.jpg",), ("/q/other/x1.jpg",)], "path string")
    assert [tuple(r) for r in paths.select(text.sequence_truth(F.col("path")), text.frame_of_stem(F.col("path"))).collect()] == [("/q/gt/gt.txt", 12), (None, None)]
    spark.createDataFrame([(1, "add a man")], "img_id int, instruction string").write.parquet(str(tmp_path / "pairs"))
    assert scans.pairs(spark, str(tmp_path / "pairs"), 1).first().instruction == "add a man"


def test_sinks_write_what_they_say(spark, tmp_path):
    samples = spark.createDataFrame([("s1", "train", "<vin_ped> a", 1, 1, 1), ("s2", "val", "<vin_ped> b", 2, 2, 2)], "sample_id string, split string, caption string, image_id int, group_id int, duplicate_cluster_id int")
    record = sinks.release_record(samples, "r1", "<vin_ped>", "v1")
    with pytest.raises(ValueError):
        sinks.require_validated(record)
    leaks_ = release.leaks(samples, spark.createDataFrame([], "image_id int, group_id int"))
    written = sinks.write_validation(record, release.status(release.validation(samples, "<vin_ped>"), leaks_), str(tmp_path / "v"))
    assert sinks.require_validated(written).first().n_train == 1 and spark.read.json(str(tmp_path / "v/validation_report")).first().errors == ""
    noted = sinks.provenance(written, "/releases/r1", "abc").first()
    sinks.one_row(sinks.provenance(written, "/releases/r1"), str(tmp_path / "noted"))  # without a commit
    assert (noted.release_name, noted.dataset_status, noted.val_count, noted.git_commit) == ("r1", "validated", 1, "abc")
    lost = samples.withColumn("crop_path", F.concat(F.lit("/c/"), "sample_id"))
    errors = release.status(release.validation(lost, "", spark.createDataFrame([("/c/s1",)], "crop_path string")), leaks_).first().errors
    assert errors == "trigger_token is empty; crop files missing"
    cases = spark.createDataFrame([("c1", 1, 5, "dev"), ("c2", 2, 6, "final")], "case_id string, image_id int, group_id int, eval_set string")
    sinks.eval_cases(cases, str(tmp_path / "cases"), str(tmp_path / "manifest"))
    assert {(r.image_id, r.group_id) for r in spark.read.parquet(str(tmp_path / "manifest")).collect()} == {(1, 5), (2, 6)} and spark.read.json(str(tmp_path / "cases/eval_set=dev")).first().case_id == "c1"
    rows = spark.createDataFrame([(3, "x"), (1, "y")], "seed int, extra string")
    sinks.fixed_csv(rows, ["seed", "missing"], str(tmp_path / "csv"), order="seed")
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert back.columns == ["seed", "missing"] and [r.seed for r in back.collect()] == ["1", "3"]
    sinks.one_row(record, str(tmp_path / "one"))
    assert spark.read.json(str(tmp_path / "one/json")).first().name == "r1" and spark.read.csv(str(tmp_path / "one/csv"), header=True).first()["name"] == "r1"
    sinks.stage_table(samples, str(tmp_path / "stage"))
    crops = spark.createDataFrame([("a.jpg", 1, 1, bytearray(b"abc"), "train")], "file_name string, width int, height int, data binary, split string")
    sinks.release_images(crops, str(tmp_path / "images"))
    assert spark.read.parquet(str(tmp_path / "stage")).count() == 2 and bytes(spark.read.parquet(str(tmp_path / "images")).first().data) == b"abc"


def test_detection_utility_and_user_functions(spark):
    kind = "image_id string, idx int, x1 double, y1 double, x2 double, y2 double, conf double"
    truth = spark.createDataFrame([("a", 0, 0.0, 0.0, 10.0, 10.0, 0.0), ("b", 0, 0.0, 0.0, 10.0, 10.0, 0.0)], kind)
    # A confident miss stands before the right one of the same box.
    pred = spark.createDataFrame([("a", 0, 6.0, 0.0, 16.0, 10.0, 0.9), ("a", 1, 0.0, 0.0, 10.0, 10.0, 0.8), ("b", 0, 0.0, 0.0, 10.0, 10.0, 0.1)], kind)
    ap = {r.threshold: r.ap for r in detection.average_precision(truth, pred.filter("image_id = 'a'"), [0.5]).collect()}
    assert ap[0.5] == pytest.approx(0.5 * 51 / 101)
    r = detection.utility(truth, pred).first()
    assert (r.tp, r.fn, r.fp) == (1, 1, 1) and r.ap50 == pytest.approx(0.252475) and r.map50_95 == pytest.approx(0.252475)
    images = spark.createDataFrame([("i",)], "image_id string")
    assert detection.detect(images, None).count() == 0
    assert [(r.person_detected, r.person_count) for r in metrics.presence(images, metrics.keep_detections(detection.detect(images, None), 0.25)).collect()] == [(0, 0)]
    masks = detection.segment(images, lambda pdf: pd.DataFrame({"image_id": ["i", "i"], "width": 1, "height": 1, "mask": [b"a", b"b"], "x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0, "conf": [0.2, 0.7]}))
    assert {bytes(r.mask): r.mask_idx for r in masks.collect()} == {b"b": 0, b"a": 1}


def test_refusals_and_regions(spark):
    records = spark.createDataFrame([("a", "Val"), ("b", "train")], "image_id string, split string")
    with pytest.raises(ValueError, match="val"):
        attempts.gate_target_splits(records)
    assert attempts.gate_target_splits(records.filter("split = 'train'")).count() == 1
    images = spark.createDataFrame([("a", "add_single_pedestrian"), ("b", "add_near_pedestrian")], "image_id string, variant string")
    persons = spark.createDataFrame([("a", 100.0, 300.0, 140.0, 400.0)], "image_id string, x1 double, y1 double, x2 double, y2 double")
    got = {r.image_id: r for r in placement.insertion_regions(images, persons, persons.limit(0), tries=40).collect()}
    assert set(got) == {"a", "b"}
    for r in got.values():
        assert 16 <= r.x1 < r.x2 <= 496 and 16 <= r.y1 < r.y2 <= 496 and r.expected_height == pytest.approx((r.y2 - r.y1) / 1.16)
    again = {r.image_id: r for r in placement.insertion_regions(images.repartition(3), persons, persons.limit(0), tries=40).collect()}
    assert again == got


def test_ranks_in_order_and_joins_of_hot_keys(spark):
    from curbside.skew import spread_join

    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert {r.k: r["__rank"] for r in release.ranked_in_order(rows.repartition(5), "k").collect()} == {i: i + 1 for i in range(1000)}
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id"))).alias("key"))
    right = left.groupBy("key").agg(F.count("*").alias("n")).filter("key IS NOT NULL").withColumn("v", F.length("key"))
    got = spread_join(left, right, "key", "n", "id", "left").collect()
    assert len(got) == 3000 and all(r.v == (None if r.key is None else len(r.key)) for r in got) and set(got[0].asDict()) == {"key", "id", "v"}
