"""Operators that must not gather what grows: order statistics, filters, joins of one key, models, versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curbside import catalog
from curbside.functions import scores
from curbside.operators import attempts, bloom, detection, metrics, order_stats, phrases, pixels, placement, release
from curbside.plans import release_build
from curbside.settings import CaptionSettings, CurationSettings, SourceRole, registry
from curbside.skew import dealt_join
from curbside.sources import images, scans, sinks


@pytest.mark.parametrize("few", [1, 50, 10_000])
def test_percentiles_equal_numpy(spark, few):
    rng = np.random.default_rng(1)
    columns = {
        "plain": rng.normal(size=3000), "ties": np.where(rng.random(3000) < 0.4, 7.0, rng.integers(0, 20, 3000)).astype(float), "wide": rng.normal(size=3000) * 10.0 ** rng.integers(-200, 200, 3000),
        "one": np.full(3000, 3.5), "holes": np.where(rng.random(3000) < 0.5, np.nan, rng.random(3000)),
    }
    rows = spark.createDataFrame([tuple(None if x != x else float(x) for x in r) for r in zip(*columns.values(), strict=True)], ", ".join(f"{c} double" for c in columns)).repartition(5)
    shares = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = order_stats.percentiles(rows, dict.fromkeys(columns, shares), few)
    for c, values in columns.items():
        assert [got[c, p] for p in shares] == pytest.approx(list(np.quantile(values[values == values], shares)), rel=1e-12)
    assert order_stats.percentiles(rows.limit(0), {"plain": [0.5]}) == {("plain", 0.5): None}


def test_missing_scores_count_as_nothing(spark):
    rows = spark.createDataFrame([(0.8, 0.9), (None, 0.9), (0.5, 0.0)], "person_score double, quality_score double")
    r = metrics.quality_summary(rows, ["person_score", "quality_score"]).first()
    assert (r.n, r.person_score_mean, r.person_score_p10, r.quality_score_mean) == (2, 0.4, 0.08, 0.9)
    assert metrics.quality_summary(rows.limit(0), ["person_score"]).first().person_score_p10 == 0.0


def test_box_quality_by_hand(spark):
    values = [(1.0, None, 128.0, 0.9), (1.0, float("nan"), 128.0, 0.9), (1.0, 1.5, 128.0, 0.6), (1.0, 0.0, 512.0, 1.0), (0.5, 0.25, 64.0, 0.525)]
    rows = spark.createDataFrame(values, "v double, o double, h double, want double")
    assert all(r.q == pytest.approx(r.want, abs=1e-9) for r in rows.select("want", scores.box_quality(F.col("v"), F.col("o"), F.col("h")).alias("q")).collect())


def test_whole_settings_stay_whole_and_modes_of_advice(spark):
    run = spark.createDataFrame([(40, 200, 0.4, 0.9, 0.9, 0.9, 0, 30, 0)], "n_accepted int, n_jobs int, person_p10 double, scale_p10 double, background_p10 double, edge_p10 double, low_person int, bad_scale int, bad_depth int")
    settings = spark.createDataFrame([("CONTEXT_GENERATION_RETRIES", 4.0), ("SCALE_CORRECTION_MAX_ATTEMPTS", 2.0), ("CONTEXT_PERSON_MIN_CONFIDENCE", 0.12)], "name string, current double")
    assert {r.name: r.value for r in attempts.advice(run, settings).collect()} == {"CONTEXT_GENERATION_RETRIES": 5.0, "SCALE_CORRECTION_MAX_ATTEMPTS": 3.0, "CONTEXT_PERSON_MIN_CONFIDENCE": pytest.approx(0.108)}
    assert {r.name for r in attempts.skipped_advice(run, settings).collect()} == {"MIN_RETRY_PERSON_CONFIDENCE", "SCALE_CORRECTION_HEIGHT_STEP"}
    told = attempts.advice(run, settings.withColumn("whole", F.col("name") == "CONTEXT_PERSON_MIN_CONFIDENCE"))
    assert {r.name: r.value for r in told.collect()}["CONTEXT_GENERATION_RETRIES"] == pytest.approx(4.6)
    counts = spark.createDataFrame([("bad_scale_too_large", 3), ("scale_unrecoverable", 4), ("bad_scale", 1), ("no_person_mask", 2)], "reason string, n long")
    assert [attempts.reject_figures(counts, m).first().bad_scale for m in ("fixed", "reference")] == [8, 1]
    assert attempts.reject_figures(counts).first().low_person == 2 and attempts.reject_figures(counts.limit(0)).first().bad_depth == 0


def test_nulls_do_not_leak(spark):
    kind = "image_id int, group_id int, duplicate_cluster_id int, split string"
    samples = spark.createDataFrame([(1, None, None, "train"), (2, None, None, "val"), (3, 5, 6, "train"), (4, 5, 7, "val")], kind)
    r = release.leaks(samples, spark.createDataFrame([(None, None), (4, 9)], "image_id int, group_id int")).first()
    assert (r.shared_group_id, r.shared_duplicate_cluster_id, r.leaked_image_id, r.leaked_group_id) == (1, 0, 1, 0)


@pytest.mark.parametrize("distance", [0, 3, 6, 9, 16])
def test_keys_find_every_pair(spark, distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(-(2**63), 2**63, 12)
    hashes = sorted({int(base[i % 12]) ^ int(np.bitwise_xor.reduce([np.int64(1) << np.int64(b) for b in rng.choice(63, rng.integers(0, 2 + distance), replace=False)] or [np.int64(0)])) for i in range(150)})
    got = sorted((r.a, r.b, r.distance) for r in release.near_hashes(spark.createDataFrame([("s", h) for h in hashes], "source_id string, h long"), distance).collect())
    apart = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    assert got == sorted((a, b, apart(a, b)) for i, a in enumerate(hashes) for b in hashes[i + 1 :] if apart(a, b) <= distance)
    assert sum(w for _, w, _ in release.hash_keys(distance)) == 64


def test_keys_of_six_bits_let_few_meet():
    keys = release.hash_keys(6)
    assert [(w, f) for _, w, f in keys] == [(16, 1)] * 4
    assert sum(release._in_ball(w, f) / 2**w for _, w, f in keys) < 0.1 * 7 / 2**9


def test_bloom_passes_every_key_and_few_others(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    might = bloom.might_contain(keys, "k", 5000)
    assert keys.filter(might(F.col("k"))).count() == 5000
    assert spark.range(10**6, 10**6 + 100_000).filter(might(F.xxhash64("id"))).count() < 200
    assert spark.range(10).filter(bloom.might_contain(keys, "k", 10**8)(F.col("id"))).count() == 10


def test_many_short_phrases(spark):
    words = [f"w{i}" for i in range(300)]
    items = [(i, f"{words[i % 300]} {words[(i * 7 + i // 300) % 300]}") for i in range(100_000)] + [(-1, ""), (-2, "absent one"), (-3, None)]
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(words, 60)) for _ in range(30)] + [None, ""]
    found = phrases.texts_with(spark.createDataFrame([(t,) for t in texts], "t string"), "t", spark.createDataFrame(items, "item_id long, p string"), "item_id", "p", most=30_000)
    want = {}
    for i, p in items:
        if p is not None and (n := sum(p in t for t in texts if t is not None)):
            want[i] = n
    assert {r.item_id: r.n_texts for r in found.collect()} == want


def test_contamination_of_all_lengths(spark):
    rng = np.random.default_rng(4)
    words = [f"x{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, 80)) for _ in range(60)]
    items = []
    for i in range(120):
        t, n = texts[i % 60].split(), 1 + i % 14
        at = int(rng.integers(0, 80 - n))
        items.append((i, " ".join(t[at : at + n])[0 if i % 3 else 1 :] or "x"))
    items.append((999, " ".join(words[:9])))
    got = {r.item_id: r.n_texts for r in release.contamination(spark.createDataFrame([(t,) for t in [*texts, None]], "caption string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: n for i, p in items if (n := sum(p in t for t in texts))}


def test_nearest_sample_of_an_image_with_ten_thousand(spark):
    rng = np.random.default_rng(5)
    ys, hs = rng.integers(0, 5000, 10_000) / 10, rng.integers(20, 200, 10_000).astype(float)
    samples = spark.createDataFrame(list(zip(["i"] * 10_000, map(float, ys), map(float, hs), strict=True)), "image_id string, ground_y double, height double")
    targets = [float(t) for t in rng.integers(-500, 6000, 200) / 10]
    got = {r.target_y: r.nearest for r in placement.nearest_height(spark.createDataFrame([("i", t) for t in targets] + [("j", 5.0)], "image_id string, target_y double"), samples).collect()}
    scale = lambda y: float(spark.range(1).select(scores.perspective_scale(F.lit(float(y)), 512).alias("s")).first().s)
    for t in targets[:12]:
        away, y, h = min(zip(np.abs(ys - t), ys, hs, strict=True))
        assert got[t] == (pytest.approx(h * scale(t) / max(1e-6, scale(y))) if away <= 70 else None)
    near = {r.target_y: r.weighted for r in placement.weighted_height(spark.createDataFrame([("i", t) for t in targets], "image_id string, target_y double"), samples).collect()}
    for t in targets:
        w = np.where(np.abs(ys - t) <= 120, 1 / (1 + np.abs(ys - t)), 0)
        assert near[t] == (pytest.approx((w * hs).sum() / w.sum()) if w.any() else None)


def test_models_load_once_a_worker(spark, tmp_path):
    import os
    import uuid

    folder = str(tmp_path)

    def load():
        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return 0.5

    def run(conf, pdf):
        assert len(pdf) <= 8
        if (pdf.image_id == "bad").any():
            raise ValueError("broken picture")
        return pd.DataFrame({"image_id": pdf.image_id, "det_idx": 0, "x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0, "conf": conf, "cls": 0})

    model = detection.Model(f"test-{uuid.uuid4().hex}", load)
    rows = spark.createDataFrame([(f"i{i}",) for i in range(100)], "image_id string").repartition(12)
    assert detection.detect(rows, run, model=model, rows=8).count() == 100
    assert detection.detect(rows, run, model=model, rows=8).count() == 100
    pids = [f.name.partition("-")[0] for f in tmp_path.iterdir()]
    assert 0 < len(pids) == len(set(pids)) <= 12
    mixed = rows.union(spark.createDataFrame([("bad",)], "image_id string")).coalesce(1)
    got = detection.detect(mixed, run, model=model, rows=8, errors=True).collect()
    assert len(got) == 101 and [(r.image_id, r.error, r.conf) for r in got if r.error] == [("bad", "ValueError: broken picture", None)]
    with pytest.raises(Exception, match="broken picture"):
        detection.detect(mixed, run, model=model, rows=8).collect()


def test_a_reader_never_sees_half_a_version(spark, tmp_path):
    versions = sinks.Versions(spark, f"file://{tmp_path}/release")
    with pytest.raises(FileNotFoundError):
        versions.read("a")
    one = spark.createDataFrame([(1, "train")], "v int, split string")
    versions.publish({"a": one, "b": one}, {"a": "split"})
    broken = one.withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        versions.publish({"a": one.withColumn("v", F.lit(2)), "b": broken})
    assert [r.v for r in versions.read("a").collect()] == [1] and [r.v for r in versions.read("b").collect()] == [1]
    late = sinks.Versions(spark, f"file://{tmp_path}/release")
    late._committed = lambda: []
    with pytest.raises(RuntimeError, match="another writer"):
        late.publish({"a": one})
    versions.publish({"a": one.withColumn("v", F.lit(3)), "b": one})
    assert [r.v for r in versions.read("a").collect()] == [3]


def colours(seed, h, w):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3), np.uint8)


def test_tiles_equal_the_whole_picture(spark):
    whole, tiles = [], []
    for k, box in enumerate([(20.0, 30.0, 70.0, 90.0), (None,) * 4, (0.0, 0.0, 200.0, 200.0)]):
        a, b = colours(k, 120, 150), colours(k + 50, 120, 150)
        whole.append((k, 150, 120, bytearray(a.tobytes()), bytearray(b.tobytes()), *box))
        for top in range(0, 120, 50):
            for left in range(0, 150, 64):
                x, y = a[top : top + 50, left : left + 64], b[top : top + 50, left : left + 64]
                tiles.append((k, left, top, x.shape[1], x.shape[0], bytearray(x.tobytes()), bytearray(y.tobytes()), *box))
    kinds = "source binary, target binary, x1 double, y1 double, x2 double, y2 double"
    want = {r.case_id: r for r in pixels.background(spark.createDataFrame(whole, f"case_id int, width int, height int, {kinds}"), 8).collect()}
    for r in pixels.tile_background(spark.createDataFrame(tiles, f"case_id int, left int, top int, width int, height int, {kinds}"), 8).collect():
        assert (r.bg_mae, r.bg_ssim) == (pytest.approx(want[r.case_id].bg_mae), pytest.approx(want[r.case_id].bg_ssim))


def test_channels_are_told_apart(spark):
    a = np.zeros((8, 8, 3), np.uint8)
    b = a.copy()
    b[0, 0] = (0, 0, 30)  # the largest channel decides, not the mean
    b[1, 1] = (20, 20, 20)
    rows = spark.createDataFrame([(1, 8, 8, bytearray(a.tobytes()), bytearray(b.tobytes()))], "pair_id int, width int, height int, source binary, target binary")
    r = pixels.change_masks(rows, 25).first()
    assert (r.changed, r.x1, r.y2) == (1, 0, 0)
    assert pixels._luma(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]]], np.uint8)).tolist() == [[76, 150, 29, 9]]


def test_first_cases_read_little(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(i, i, 0, 4, 4, bytearray(bytes(48)), bytearray(bytes([200 if i % 3 else 0]) * 48)) for i in range(2000)], "pair_seq long, img_id long, ann_id long, width int, height int, source binary, target binary")

    def masks(some):
        seen.add(some.count())
        return pixels.change_masks(some, keep=["pair_seq", "img_id", "ann_id"])

    got = release.first_changed_pairs(rows, masks, 30, 16).orderBy("kept").collect()
    assert [(r.pair_seq, r.kept, r.case_id) for r in got] == [(i, n, f"pipe_{i}_0_{n}") for n, i in enumerate([i for i in range(2000) if i % 3][:30])]
    assert seen.value == 64
    assert release.first_changed_pairs(rows.limit(0), masks, 3).count() == 0


def test_height_from_a_depth_map(spark):
    depth = [round((x + y) / 20, 3) for y in range(6) for x in range(8)]
    rows = spark.createDataFrame([(depth, 8, 3.7, 2.2, 400.0, "add_single_pedestrian"), (depth, 8, 50.0, -4.0, 400.0, "add_single_pedestrian"), ([0.0] * 48, 8, 3.0, 3.0, 100.0, "add_single_pedestrian")], "depth array<double>, width int, x double, y double, h double, variant string")
    c = F.col
    got = [r.e for r in rows.select(scores.expected_height_from_depth(c("depth"), c("width"), c("x"), c("y"), c("h"), c("variant")).alias("e")).collect()]
    flat = np.array(depth).reshape(6, 8)
    usual = spark.range(1).select(scores._height_multiplier(F.lit("add_single_pedestrian")).alias("m")).first().m
    height = lambda mean, h: max(28.0, max(0.075, min(0.29, 0.075 + mean * 0.215)) * usual * h)
    assert got == pytest.approx([height(flat[0:5, 1:6].mean(), 400), height(flat[0:3, 5:8].mean(), 400), height(0.0, 100)])


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def _stored(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_exploded_label_candidates_are_not_broadcast(spark, tmp_path):
    images = spark.createDataFrame([("/d/val/images/1.png",), ("/d/val/images/2.png",), ("/d/val/3.png",)], "path string")
    files = spark.createDataFrame([("/d/val/labels/1.txt",), ("/d/val/images/1.json",), ("/d/val/3.txt",)], "path string")
    found = scans.match_labels(_stored(images, tmp_path / "images"), _stored(files, tmp_path / "files"))
    assert {tuple(r) for r in found.collect()} == {("/d/val/images/1.png", "/d/val/images/1.json"), ("/d/val/images/2.png", None), ("/d/val/3.png", "/d/val/3.txt")}
    assert _plan(found).count("SortMergeJoin") == 1


def test_hashes_listed_under_many_keys_are_not_broadcast(spark, tmp_path):
    hashes = _stored(spark.createDataFrame([("a", 0), ("a", 7), ("a", 2**40 - 1), ("b", 1)], "source_id string, h long"), tmp_path / "hashes")
    found = release.near_hashes(hashes, 6)
    assert [tuple(r) for r in found.collect()] == [("a", 0, 7, 3)]
    assert _plan(found).count("SortMergeJoin") == 1
    assert _plan(dealt_join(hashes, hashes.withColumnRenamed("h", "o"), ["source_id"], "h")).count("SortMergeJoin") == 1


def test_clusters_do_not_broadcast_neighbours(spark, tmp_path):
    images = _stored(spark.createDataFrame([(1, "a", 0, 1), (2, "a", 7, 2), (3, "a", 2**40 - 1, 3), (4, "a", 0, 4), (5, "b", 0, 5)], "image_id int, source_id string, h long, ingest_seq int"), tmp_path / "images")
    neighbours = _stored(spark.createDataFrame([("a", 0, 0), ("a", 0, 7), ("a", 7, 0), ("a", 7, 7), ("a", 2**40 - 1, 2**40 - 1), ("b", 0, 0)], "source_id string, h long, o long"), tmp_path / "neighbours")
    found = release._last_earlier(images, neighbours)
    assert {tuple(r) for r in found.collect()} == {(1, None), (2, 1), (3, None), (4, 2), (5, None)}
    plan = _plan(found)
    broadcast = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "o#" in line and "__hot" not in line]
    assert plan.count("SortMergeJoin") >= 2 and not [line for line in broadcast if "LeftOuter" not in line]



def test_scale_metrics_of_a_large_part_key(spark, tmp_path):
    spark.sql("SELECT 1L o_orderkey, 20L o_custkey, 'F' o_orderstatus, '2-HIGH' o_orderpriority").write.parquet(str(tmp_path / "orders.parquet"))
    line = "SELECT 1L l_orderkey, {} l_linenumber, {}L l_partkey, 3L l_suppkey, 5.0D l_quantity, 0.05D l_discount, 0.0D l_tax, 'N' l_returnflag, 'F' l_linestatus"
    spark.sql(f"{line.format(1, 20000)} UNION ALL {line.format(2, 1)}").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert catalog.QUERIES["scale_metrics"](spark, str(tmp_path)).first().height == 40 + 20000 % 260


def test_flat_pictures_have_no_noise_in_their_hash(spark):
    rows = spark.createDataFrame([(v, 8, 8, bytearray([v] * 192)) for v in (1, 77, 128, 201, 255)], "k int, width int, height int, data binary")
    assert {r.phash for r in pixels.perceptual_hash(rows, ["k"]).collect()} == {"8000000000000000"}


def test_flat_picture_files_have_no_noise_in_their_hash(spark, tmp_path):
    for v in (77, 201):
        (tmp_path / f"{v}.png").write_bytes(images.png_bytes(8, 8, bytes([v] * 192)))
    assert [r.phash for r in pixels.perceptual_hash(images.pictures(spark, str(tmp_path)), ["file"]).collect()] == ["8000000000000000"] * 2


def test_nested_clamps_grow_by_their_length(spark):
    rows = spark.createDataFrame([(None,), (-3.0,), (0.25,), (9.0,), (float("nan"),)], "v double")
    nested = F.col("v")
    for _ in range(7):
        nested = scores.clamp01(nested)
    found = rows.select(nested.alias("c"))
    assert [r.c for r in found.collect()] == [0.0, 0.0, 0.25, 1.0, 1.0]
    assert found._jdf.queryExecution().analyzed().toString().count("v#") < 50


def test_few_boxes_meet_as_many_do():
    rng = np.random.default_rng(3)
    a, b = (np.sort(rng.integers(0, 30, (n, 2, 2)), axis=1).reshape(n, 4).astype(float) for n in (9, 7))
    b[0] = a[0]
    assert np.array_equal(np.array(detection._few_ious(a.tolist(), b.tolist())), detection._ious(a, b))


def test_confident_matches_without_truth_or_meeting(spark):
    kind = "image_id int, idx long, conf double, x1 double, y1 double, x2 double, y2 double"
    predicted = spark.createDataFrame([(1, 1, 0.5, 0.0, 0.0, 9.0, 9.0), (1, 2, 0.9, 0.0, 0.0, 9.0, 9.0), (2, 1, 0.7, 0.0, 0.0, 5.0, 5.0), (3, 1, 0.7, 0.0, 0.0, 5.0, 5.0), (4, 1, 0.6, None, 0.0, 5.0, 5.0)], kind)
    truth = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0, 9.0, 9.0), (2, 1, 0.0, 50.0, 50.0, 60.0, 60.0), (4, 1, 0.0, 0.0, 0.0, 5.0, 5.0)], kind).drop("conf")
    hits = {(r.threshold, r.image_id, r.idx) for r in detection.confident_matches(truth, predicted, [0.3, 0.5]).collect() if r.hit}
    assert hits == {(0.3, 1, 2), (0.5, 1, 2)}


def test_release_computes_its_images_and_boxes_once(spark):
    seen = {k: spark.sparkContext.accumulator(0) for k in ("images", "boxes")}

    def counted(name, column):
        def same(v):
            seen[name].add(1)
            return v

        return F.udf(same, "string")(column)

    images = spark.createDataFrame([(f"i{k:02d}", "a", "eval" if k % 5 == 0 else "train", f"g{k % 7}", f"s{k // 2}", k * 4099, k) for k in range(40)], "image_id string, source_id string, split string, group_id string, sha256 string, h long, ingest_seq int")
    boxes = spark.createDataFrame([(f"i{k:02d}", f"b{k}", "pedestrian", 0.0, 0.0, 60.0, 300.0, 60.0, 300.0, 0.0, False) for k in range(40)], "image_id string, instance_id string, class_name string, x double, y double, w double, h double, visible_w double, visible_h double, occlusion double, ignore boolean")
    roles = registry(spark, [SourceRole("a", "train", "train"), SourceRole("a", "eval", "eval")])
    built = release_build.build(images.withColumn("sha256", counted("images", "sha256")), boxes.withColumn("instance_id", counted("boxes", "instance_id")), roles, CurationSettings(), CaptionSettings())
    assert built["groups"].count() == 40 and built["status"].first().n == built["samples"].count() > 0
    assert {k: v.value for k, v in seen.items()} == {"images": 40, "boxes": 40}


def test_label_lines_are_split_once(spark):
    lines = [(0, "0 0.5 0.5 0.2 0.4"), (1, "1 2"), (2, None), (3, "x 1 1 1 1"), (4, "1,2,3,4,5,6,0.5,1,0.25"), (5, "1,2,3,4,5,6,0,1"), (6, "2, 9 ,1,1,1,1,1")]
    rows = spark.createDataFrame([("f", n, line, 100, 50) for n, line in lines], "path string, line_no int, line string, width int, height int")
    yolo, mot = scans.yolo_boxes(rows, {0: "person"}), scans.mot_boxes(rows)
    assert [(r.line_no, r.class_name, r.x, r.h) for r in yolo.collect()] == [(0, "person", 40.0, 20.0)]
    assert sorted((r.line_no, r.track_id, r.box_idx, r.visibility) for r in mot.collect()) == [(4, 2, 0, 0.25), (5, 2, 1, None), (6, 9, 0, None)]
    assert "line" not in mot.columns and "__parts" not in yolo.columns + mot.columns
    for found in (yolo, mot, scans.mot_boxes(rows, strict=True)):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def _small_build(spark, mode="reference"):
    images = spark.createDataFrame([(f"i{k:02d}", "a", "eval" if k % 5 == 0 else "train", f"g{k % 7}", f"s{k // 2}" if k % 9 else None, (k // 6) * 4099 if k % 11 else None, k) for k in range(40)], "image_id string, source_id string, split string, group_id string, sha256 string, h long, ingest_seq int")
    boxes = spark.createDataFrame([(f"i{k:02d}", f"b{k}", "pedestrian", 0.0, 0.0, 60.0, 300.0, 60.0, 300.0, 0.0, False) for k in range(40)], "image_id string, instance_id string, class_name string, x double, y double, w double, h double, visible_w double, visible_h double, occlusion double, ignore boolean")
    roles = registry(spark, [SourceRole("a", "train", "train"), SourceRole("a", "eval", "eval")])
    return images, boxes, roles, release_build.build(images, boxes, roles, CurationSettings(), CaptionSettings(), mode)


@pytest.mark.parametrize("mode", ["reference", "connected"])
def test_release_joins_and_writes_unique_images_alone(spark, mode):
    images, boxes, roles, built = _small_build(spark, mode)
    exact = release.exact_groups(images)
    again = [f for f in built["groups"].inputFiles() if "/exact-" not in f]
    n = exact.filter("dedupe_status = 'unique'").count()
    assert 0 < n < 40 and spark.read.parquet(*again).count() == n
    # The same rows as by the operators one after the other.
    near = release.near_clusters(exact.filter("dedupe_status = 'unique'"), CurationSettings().near_distance, mode)
    cluster = {r.image_id: (r.duplicate_cluster_id, r.dedupe_status) for r in near.collect()}
    want = {r.image_id: cluster.get(r.image_id, (r.image_id if mode == "reference" else r.canonical_image_id, "exact_duplicate")) for r in exact.collect()}
    assert {r.image_id: (r.duplicate_cluster_id, r.dedupe_status) for r in built["groups"].collect()} == want and len(want) == 40
    found = release.with_captions(release.candidates(release.training_images(images, roles), boxes, CurationSettings()), CaptionSettings())
    plain = release.drop_duplicates(found, built["groups"])
    assert built["samples"].count() > 0
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, built["samples"].select(*plain.columns).collect()))


def test_published_checks_are_made_once(spark, tmp_path):
    *_, built = _small_build(spark)
    seen = spark.sparkContext.accumulator(0)

    def same(v):
        seen.add(1)
        return v

    built["status"] = built["status"].withColumn("errors", F.udf(same, "string")("errors"))
    record = sinks.release_record(built["samples"].select("image_id", "split"), "r", "<vin_ped>", "v1")
    sinks.publish_release(spark, f"file://{tmp_path}/release", built, record)
    own = sinks.Versions(spark, f"file://{tmp_path}/release")
    assert own.read("release").first().errors == own.read("validation_report").first().errors is not None
    assert seen.value == 1


def test_sequence_lines_are_split_without_a_pattern(spark):
    lines = [(0, " 1 ,\t2\t, 3,4 , 5,6,\t0.5 , 1 ,0.25 "), (1, "1,2,3,4,5,6,1,,"), (2, "1,,3,4,5,6,1"), (3, "1 2,2,3,4,5,6,1"), (4, "1,2,3,4,5,6,1,1,")]
    found = scans.mot_boxes(spark.createDataFrame([("f", n, line) for n, line in lines], "path string, line_no int, line string"))
    assert sorted((r.line_no, r.track_id, r.x, r.h, r.conf, r.visibility) for r in found.collect()) == [(0, 2, 3.0, 6.0, 0.5, 0.25), (2, None, 3.0, 6.0, 1.0, None), (4, 2, 3.0, 6.0, 1.0, None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "\\s" not in plan
    made = catalog.QUERIES["sequence_lines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "format_string" not in made


def test_label_lines_shuffle_their_distinct_rows_once(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    some = rows.limit(40).withColumn("l_linenumber", F.when(F.col("l_partkey") % 3 > 0, F.col("l_linenumber")))
    some.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalog.QUERIES["label_lines"](spark, str(tmp_path))
    got = found.collect()
    cars = [r for r in got if r.class_id == 2]
    assert any(r.det_idx is None for r in cars)  # a row without a number has its car's edge as well
    assert all((r.car_x2 is not None) == (r.class_id == 2) for r in got)
    whole = catalog.QUERIES["label_lines"](spark, "/root/testdata/sf0.001")
    whole.collect()
    assert "ReusedExchange" in whole._jdf.queryExecution().executedPlan().toString()
