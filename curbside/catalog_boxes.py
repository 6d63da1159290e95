"""Registered queries of box geometry, scans of label lines, gates and placement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from curbside.functions import geometry as geo, scores, text
from curbside.operators import attempts, detection, metrics, placement
from curbside.plans import tables
from curbside.registry import BOX, KEYS, WITH, area_sql, clamp_sql, depth_sql, inter_sql, query
from curbside.settings import ROAD_BAND, VARIANTS
from curbside.sources import scans



def _size() -> list:
    return [F.lit(n) for n in (640, 360)]


_SHIFTED = "SELECT image_id, det_idx, p, s, x1 + 0.5 AS x1, y1 - 0.25 AS y1, x2 + 0.5 AS x2, y2 + 0.75 AS y2 FROM inst"


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _shifted(spark, sf_dir) -> DataFrame:
    boxes = tables.instances(spark, sf_dir)
    return boxes.withColumns({"x1": F.col("x1") + 0.5, "y1": F.col("y1") - 0.25, "x2": F.col("x2") + 0.5, "y2": F.col("y2") + 0.75})


_SCALE, _LEFT, _TOP = 512 / 360, 199, 0  # 640 x 360 becomes 910 x 512
_IN = "(x2 * c - 199 > 0 AND x1 * c - 199 < 512 AND y2 * c > 0 AND y1 * c < 512)"
_CROP = clamp_sql("x1 * c - 199", "y1 * c", "x2 * c - 199", "y2 * c", "512", "512")
_FIRST = clamp_sql("x1 - pad", "y1 - pad", "x2 + pad", "y2 + pad", "512", "512")
_SECOND = clamp_sql("a1 - mx", "b1", "a2 + mx", "b2", "512", "512")
_THIRD = clamp_sql("a1", "b1 - my", "a2", "b2 + my", "512", "512")
_SCALED = clamp_sql("(x1 + x2) / 2 - (x2 - x1) * 2.2 / 2", "(y1 + y2) / 2 - (y2 - y1) * 2.2 / 2", "(x1 + x2) / 2 + (x2 - x1) * 2.2 / 2", "(y1 + y2) / 2 + (y2 - y1) * 2.2 / 2", "640", "360")
_CLAMPED = clamp_sql("x1", "y1", "x2", "y2", "640", "360")


@query(f"""{WITH}, b AS (SELECT *, 512.0::DOUBLE / 360 AS c, trunc(greatest(x2 - x1, y2 - y1) * 0.18::DOUBLE) AS pad, trunc(greatest(x2 - x1, y2 - y1) * 0.08::DOUBLE) AS d FROM ({_SHIFTED})),
e1 AS (SELECT *, {_FIRST[0]} AS a1, {_FIRST[1]} AS b1, {_FIRST[2]} AS a2, {_FIRST[3]} AS b2 FROM b),
e2 AS (SELECT * EXCLUDE (a1, b1, a2, b2), {_SECOND[0]} AS a1, {_SECOND[1]} AS b1, {_SECOND[2]} AS a2, {_SECOND[3]} AS b2 FROM (SELECT *, CASE WHEN a2 - a1 < 128 THEN floor((128 - (a2 - a1)) / 2) ELSE 0 END AS mx FROM e1)),
e3 AS (SELECT * EXCLUDE (a1, b1, a2, b2), {_THIRD[0]} AS a1, {_THIRD[1]} AS b1, {_THIRD[2]} AS a2, {_THIRD[3]} AS b2 FROM (SELECT *, CASE WHEN b2 - b1 < 128 THEN floor((128 - (b2 - b1)) / 2) ELSE 0 END AS my FROM e2)),
q AS (SELECT *, least(floor(greatest(192, (x2 - x1) * 3.4::DOUBLE, (y2 - y1) * 3.4::DOUBLE)), 640, 360) AS side FROM e3),
w AS (SELECT *, greatest(0, least(640 - side, round_even((x1 + x2) / 2 - side / 2, 0))) AS qx, greatest(0, least(360 - side, round_even((y1 + y2) / 2 - side / 2, 0))) AS qy FROM q)
SELECT image_id, det_idx, p, s, {_CLAMPED[0]} AS c_x1, {_CLAMPED[1]} AS c_y1, {_CLAMPED[2]} AS c_x2, {_CLAMPED[3]} AS c_y2,
CASE WHEN {_IN} THEN {_CROP[0]} END AS k_x1, CASE WHEN {_IN} THEN {_CROP[1]} END AS k_y1, CASE WHEN {_IN} THEN {_CROP[2]} END AS k_x2, CASE WHEN {_IN} THEN {_CROP[3]} END AS k_y2,
greatest(0, trunc(x1 - d))::INT AS m_x1, greatest(0, trunc(y1 - d))::INT AS m_y1, least(640, trunc(x2 + d))::INT AS m_x2, least(360, trunc(y2 + d))::INT AS m_y2,
a1 AS e_x1, b1 AS e_y1, a2 AS e_x2, b2 AS e_y2, {_SCALED[0]} AS d_x1, {_SCALED[1]} AS d_y1, {_SCALED[2]} AS d_x2, {_SCALED[3]} AS d_y2,
qx AS s_x1, qy AS s_y1, qx + side AS s_x2, qy + side AS s_y2,
round_even((x1 - qx) * 512 / side, 0) AS i_x1, round_even((y1 - qy) * 512 / side, 0) AS i_y1, round_even((x2 - qx) * 512 / side, 0) AS i_x2, round_even((y2 - qy) * 512 / side, 0) AS i_y2 FROM w""")
def box_transforms(spark, sf_dir):
    """Clamped, cropped, dilated, grown, scaled and windowed boxes."""
    boxes, b = _shifted(spark, sf_dir), geo.Box.of()
    window = geo.square_window(b, *_size())
    made = {"c_": geo.clamp(b, *_size()), "k_": geo.centre_crop(b, *_size(), 512), "m_": geo.dilated(b, *_size()), "e_": geo.with_context(b, 512), "d_": geo.scaled(b, *_size(), 2.2), "s_": window, "i_": geo.into_window(b, window, 512)}
    out = boxes.select(*KEYS, *[c for k, v in made.items() for c in v.columns(k)])
    return out.withColumns({c: F.col(c).cast("double") for c in out.columns if c[1:2] == "_" and c[0] in "ckedsi"})


@query(f"""{WITH}, b AS (SELECT *, {inter_sql('', 'o')} AS bo, {area_sql('')} AS one FROM (SELECT *, 100.0 AS ox1, 120.0 AS oy1, 400.0 AS ox2, 420.0 AS oy2 FROM ({_SHIFTED}))),
k AS (SELECT *, trunc(greatest(0, x1 - (x2 - x1) * 0.25)) AS a1, trunc(greatest(0, y1 - (y2 - y1) * 0.25)) AS b1, trunc(least(640, x2 + (x2 - x1) * 0.25)) AS a2, trunc(least(360, y2 + (y2 - y1) * 0.25)) AS b2 FROM b),
z AS (SELECT *, (a2 - a1)::DOUBLE AS w0, (b2 - b1)::DOUBLE AS h0, greatest(a2 - a1, b2 - b1)::DOUBLE AS m FROM k WHERE a2 - a1 >= 8 AND b2 - b1 >= 8),
d AS (SELECT *, CASE WHEN m > 200 THEN greatest(1, trunc(w0 * (200.0::DOUBLE / m))) ELSE w0 END AS w1, CASE WHEN m > 200 THEN greatest(1, trunc(h0 * (200.0::DOUBLE / m))) ELSE h0 END AS h1 FROM z),
u AS (SELECT *, greatest(w1, h1) AS n FROM d)
SELECT image_id, det_idx, p, s, round(bo / greatest(one, 1), 6) AS of_own, round(bo / 90000, 7) AS of_other, round(bo / least(greatest(one, 1), 90000), 6) AS of_smaller,
(CASE WHEN n < 96 THEN greatest(1, trunc(w1 * (96.0::DOUBLE / n))) ELSE w1 END)::INT AS crop_w, (CASE WHEN n < 96 THEN greatest(1, trunc(h1 * (96.0::DOUBLE / n))) ELSE h1 END)::INT AS crop_h FROM u""")
def overlaps_and_crops(spark, sf_dir):
    """Shares of a box and of a fixed one that both cover, and the size of the box's crop."""
    boxes, b = _shifted(spark, sf_dir), geo.Box.of()
    own, other, smaller = geo.overlap_ratios(b, geo.Box(*(F.lit(float(v)) for v in (100, 120, 400, 420))))
    window = geo.context_window(b, *_size(), 0.25)
    w, h = geo.crop_size(window, 200, 96)
    out = boxes.select(*KEYS, own.alias("of_own"), other.alias("of_other"), smaller.alias("of_smaller"), w.alias("crop_w"), h.alias("crop_h"), *window.columns("w"))
    return _rounded(_rounded(out, 6, "of_own", "of_smaller"), 7, "of_other").filter("wx2 - wx1 >= 8 AND wy2 - wy1 >= 8").drop("wx1", "wy1", "wx2", "wy2")


_ROWS = "SELECT DISTINCT image_id, det_idx, p, s, side, conf FROM inst"


def _distinct(spark, sf_dir) -> DataFrame:
    return tables.instances(spark, sf_dir).select(*KEYS, "side", "conf").distinct()


@query(f"""{WITH}, b AS (SELECT *, p % 4 AS c, (p % 100) / 100.0::DOUBLE AS cx, (s % 100) / 100.0::DOUBLE AS cy, (p % 37) / 100.0::DOUBLE AS w, (s % 53) / 100.0::DOUBLE AS h FROM ({_ROWS}) WHERE p % 7 <> 0)
SELECT image_id, det_idx, p, s, c::INT AS class_id, CASE c WHEN 0 THEN 'pedestrian' WHEN 1 THEN 'pedestrian' WHEN 2 THEN 'car' ELSE 'ignore' END AS class_name,
round((cx - w / 2) * 640, 4) AS x, round((cy - h / 2) * 360, 4) AS y, round(w * 640, 4) AS w, round(h * 360, 4) AS h,
CASE WHEN c = 2 THEN round((cx - w / 2) * 640 + w * 640, 4) END AS car_x2 FROM b""")
def label_lines(spark, sf_dir):
    """Boxes of label lines in normalised numbers, with renamed classes; short lines drop out."""
    cents = lambda c: F.concat(F.lit("0."), F.lpad(c.cast("string"), 2, "0"))
    full = F.concat_ws(" ", (F.col("p") % 4).cast("string"), cents(F.col("p") % 100), cents(F.col("s") % 100), cents(F.col("p") % 37), cents(F.col("s") % 53))
    rows = _distinct(spark, sf_dir).select(*KEYS, F.when(F.col("p") % 7 == 0, "1 0.5").otherwise(full).alias("line"), F.lit(640).alias("width"), F.lit(360).alias("height"))
    found = scans.yolo_boxes(rows, {0: "pedestrian", 1: "rider", 2: "car"}, {"rider": "pedestrian"})
    cars = scans.class_boxes(rows, 2).select(*[F.col(k).alias(f"car_{k}") for k in KEYS], F.col("x2").alias("car_x2"))
    # A null key is equal to itself; without a filter on nulls both sides are the same distinct rows, which Spark shuffles once.
    same = [F.col(k).eqNullSafe(F.col(f"car_{k}")) for k in KEYS]
    return _rounded(found.join(cars, same, "left").drop("width", "height", *[f"car_{k}" for k in KEYS]), 4, *"xywh", "car_x2")


_MOT = f"""m AS (SELECT image_id % 50 AS seq, image_id AS frame, det_idx::BIGINT * 1000000000 + p * 10000 + s AS line_no, p AS track_id, (p % 600)::DOUBLE AS x, (s % 300)::DOUBLE AS y, (p % 41)::DOUBLE AS w, (s % 97)::DOUBLE AS h,
(CASE WHEN s % 3 = 0 THEN 0.0 ELSE 1.0 END)::DOUBLE AS conf, CASE WHEN p % 11 = 0 THEN 1 WHEN p % 2 = 0 THEN 7 ELSE 1 END AS cls, CASE WHEN p % 11 > 0 AND p % 5 > 0 THEN (s % 10) / 10.0::DOUBLE END AS visibility FROM ({_ROWS}))"""


def _mot_lines(spark, sf_dir) -> DataFrame:
    p, s = F.col("p"), F.col("s")
    head = F.concat_ws(",", F.col("image_id"), p, p % 600, s % 300, p % 41, s % 97, F.when(s % 3 == 0, "0").otherwise("1"))
    line = F.when(p % 11 == 0, head).when(p % 5 == 0, F.concat(head, F.when(p % 2 == 0, ",7").otherwise(",1"))).otherwise(F.concat(head, F.when(p % 2 == 0, ",7,").otherwise(",1,"), F.lit("0."), s % 10))
    order = F.col("det_idx").cast("bigint") * 1000000000 + p * 10000 + s
    return _distinct(spark, sf_dir).select((F.col("image_id") % 50).cast("string").alias("path"), order.alias("line_no"), line.alias("line"))


@query(f"""{WITH}, {_MOT} SELECT seq::VARCHAR AS path, frame, track_id, x, y, w, h, conf, visibility, row_number() OVER (PARTITION BY seq, frame ORDER BY line_no) - 1 AS box_idx FROM m WHERE cls = 1 AND conf > 0 AND w > 0 AND h > 0""")
def sequence_lines(spark, sf_dir):
    """Boxes of sequence label lines of seven to nine fields, strictly read, with their index in the frame."""
    return scans.mot_boxes(_mot_lines(spark, sf_dir), strict=True).drop("line_no", "cls").withColumn("box_idx", F.col("box_idx").cast("bigint"))


@query(f"""{WITH}, {_MOT}, b AS (SELECT *, row_number() OVER (PARTITION BY seq, frame ORDER BY line_no) - 1 AS i FROM m WHERE cls = 1),
f AS (SELECT image_id, (row_number() OVER (PARTITION BY group_id ORDER BY image_id) - 1) AS r FROM images)
SELECT 'mot_' || lpad(image_id::VARCHAR, 8, '0') AS image_id, 'mot_' || lpad(image_id::VARCHAR, 8, '0') || '_' || i AS instance_id, 'mot_window_' || (r // 2 // 3) AS group_id, x, y, w, h, round(1 - visibility, 6) AS occlusion
FROM f JOIN b ON b.frame = f.image_id WHERE r % 2 = 0""")
def frame_instances(spark, sf_dir):
    """Boxes of every second frame of a sequence, with stable ids; windows of three sampled frames are the groups."""
    images = tables.images(spark, sf_dir)
    frames = scans.frame_windows(scans.sample_frames(images, 10, 5, "group_id", "image_id"), 3, "group_id", "image_id")
    paths = frames.select(F.concat(F.lit("/seq/img1/"), F.lpad(F.col("image_id").cast("string"), 8, "0"), F.lit(".jpg")).alias("path"), "window_id")
    found = scans.frame_instances(paths, scans.mot_boxes(_mot_lines(spark, sf_dir)), "mot")
    return found.select("image_id", "instance_id", "group_id", *"xywh", F.round("occlusion", 6).alias("occlusion"))


@query(f"""{WITH}, i AS (SELECT image_id, '/d/' || split || CASE WHEN image_id % 2 = 0 THEN '/images/' ELSE '/other/' END AS folder, split, image_id || CASE WHEN image_id % 3 = 0 THEN '_gtFine' ELSE '' END AS stem, CASE image_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.jpeg' ELSE '.txt' END AS ext FROM images)
SELECT image_id, ext <> '.txt' AND NOT contains(stem, 'gtFine') AS is_source, CASE split WHEN 'test' THEN 'test' WHEN 'val' THEN 'val' ELSE 'train' END AS split,
CASE WHEN image_id % 10 = 1 THEN folder || stem || '.json' WHEN image_id % 10 = 2 THEN folder || stem || '.txt' WHEN image_id % 10 = 4 THEN replace(folder, '/images/', '/labels/') || stem || '.json'
 WHEN image_id % 10 IN (5, 6) AND split = 'val' THEN '/own/' || stem || '.txt' WHEN image_id % 10 = 7 THEN folder || stem || '_gtFine_polygons.json' END AS label_path,
CASE WHEN image_id % 2 = 0 THEN '/d/' || split || '/labels/' || stem || '.txt' ELSE '/d/' || split || '/labels/' || stem || '.txt' END AS plain_path FROM i""")
def label_files(spark, sf_dir):
    """Which paths are source images, their split, and the first place that holds a label file."""
    images = tables.images(spark, sf_dir)
    k = F.col("image_id")
    folder = F.concat(F.lit("/d/"), "split", F.when(k % 2 == 0, "/images/").otherwise("/other/"))
    stem = F.concat(k.cast("string"), F.when(k % 3 == 0, "_gtFine").otherwise(""))
    ext = F.when(k % 4 == 0, ".png").when(k % 4 == 1, ".JPG").when(k % 4 == 2, ".jpeg").otherwise(".txt")
    rows = images.select("image_id", folder.alias("folder"), stem.alias("stem"), F.concat(folder, stem, ext).alias("path"))
    at = lambda digits, *parts: rows.filter((k % 10).isin(*digits)).select(F.concat(*parts).alias("path"))
    f, n = F.col("folder"), F.col("stem")
    files = at([1, 2], f, n, F.lit(".txt")).unionByName(at([1], f, n, F.lit(".json"))).unionByName(at([4], F.replace(f, F.lit("/images/"), F.lit("/labels/")), n, F.lit(".json")))
    files = files.unionByName(at([5, 6], F.lit("/own/"), n, F.lit(".txt"))).unionByName(at([7], f, n, F.lit("_gtFine_polygons.json")))
    found = scans.match_labels(rows.select("image_id", "path"), files.distinct(), {"val": "/own"})
    path = F.col("path")
    return found.select("image_id", text.is_source_image(path).alias("is_source"), text.split_of_path(path).alias("split"), "label_path", scans.label_path(path).alias("plain_path"))


_V = list(VARIANTS)
_V_SQL = "CASE p % 6 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_V)) + " END"


def _variant(c: str = "p"):
    return F.coalesce(*[F.when(F.col(c) % 6 == i, v) for i, v in enumerate(_V)])


_OK, _SHARE = depth_sql("a.", "b.")
_OLD = f"""fresh AS (SELECT DISTINCT * FROM inst WHERE side = 'F'), old AS (SELECT DISTINCT * FROM inst WHERE side = 'O'),
sm AS (SELECT a.image_id, a.det_idx, a.p, a.s, coalesce(max({_SHARE}) FILTER (b.p IS NOT NULL), 0) AS max_overlap, coalesce(max({inter_sql('a.', 'b.')} / greatest({area_sql('a.')} + {area_sql('b.')} - {inter_sql('a.', 'b.')}, 1)) FILTER (b.p IS NOT NULL), 0) AS max_iou,
 coalesce(bool_or(NOT {_OK}) FILTER (b.p IS NOT NULL), false) AS bad_depth, coalesce(sum({inter_sql('a.', 'b.')} / greatest({area_sql('a.')}, 1)) FILTER (b.p IS NOT NULL), 0) AS summed FROM fresh a LEFT JOIN old b ON a.image_id = b.image_id GROUP BY ALL)"""


def _candidates(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    boxes = tables.instances(spark, sf_dir).distinct()
    fresh = boxes.filter("side = 'F'").withColumn("candidate_id", text.stable_id(*(F.col(k) for k in KEYS)))
    return fresh, boxes.filter("side = 'O'").select("image_id", *geo.Box.of().columns("e_"))


@query(f"""{WITH}, {_OLD} SELECT image_id || '_' || det_idx || '_' || p || '_' || s AS candidate_id, round(max_overlap, 6) AS max_overlap, round(max_iou, 6) AS max_iou, bad_depth, round(summed, 6) AS summed_overlap FROM sm""")
def overlap_summaries(spark, sf_dir):
    """Overlap of each new box with what the image held before, and whether their order of depth is wrong."""
    fresh, old = _candidates(spark, sf_dir)
    return _rounded(placement.overlap_summary(fresh, old), 6, "max_overlap", "max_iou", "summed_overlap")


_CHANCE = "CASE p % 6 " + " ".join(f"WHEN {i} THEN {v.min_conf}" for i, v in enumerate(VARIANTS.values())) + " END"


@query(f"""{WITH}, {_OLD}, g AS (SELECT *, p % 9 AS cls, conf / 100.0::DOUBLE AS c, {_CHANCE} AS least_c, CASE WHEN s % 4 > 0 THEN (s % 10) / 10.0::DOUBLE END AS foot, (p % 12) / 200.0::DOUBLE AS foot_avoid,
CASE WHEN s % 17 > 0 THEN h * (p % 20) / 20 END AS mask_h, x1 <= 3 OR y1 <= 3 OR x2 >= 509 OR y2 >= 509 AS border, h / 100 AS ratio FROM fresh JOIN sm USING (image_id, det_idx, p, s))
SELECT image_id, det_idx, p, s, CASE WHEN cls <> 0 AND cls < 2 THEN 'other_class' WHEN c < least_c - 0.1 THEN 'low_person_conf' WHEN bad_depth AND p % 3 = 0 THEN 'bad_person_depth_overlap' WHEN max_overlap > 0.1 AND p % 3 = 0 OR max_iou > 0.06 THEN 'bad_person_depth_overlap'
WHEN h < 18 OR w < 5 THEN 'too_small_or_ghost_person' WHEN CASE WHEN foot IS NOT NULL THEN foot < 0.48 OR foot_avoid > 0.05 ELSE NOT y2 / 512 BETWEEN 0.68 - 0.16 AND 0.90 + 0.08 END THEN 'floating_or_bad_ground'
WHEN mask_h IS NULL THEN 'too_small_or_ghost_person' WHEN border OR mask_h < 0.45 * h THEN 'partial_or_cropped_body'
WHEN NOT ratio BETWEEN 0.62 AND 2.2 AND (ratio < 0.35 OR ratio > 3.2 OR c < 0.05) THEN 'scale_unrecoverable' ELSE '' END AS reject_reason FROM g""")
def new_object_gates(spark, sf_dir):
    """The first gate that each new box fails; without a ground map its feet must be in a band."""
    fresh, old = _candidates(spark, sf_dir)
    c = F.col
    rows = fresh.join(placement.overlap_summary(fresh, old), "candidate_id")
    chance = F.coalesce(*[F.when(c("p") % 6 == i, F.lit(v.min_conf)) for i, v in enumerate(VARIANTS.values())])
    rows = rows.select(
        *KEYS, F.when((c("p") % 9 != 0) & (c("p") % 9 < 2), 1).otherwise(0).alias("cls"), (c("conf") / 100 + 0.1).alias("conf"), F.round(chance, 2).alias("min_conf"), (c("bad_depth") & (c("p") % 3 == 0)).alias("bad_depth"),
        F.when(c("p") % 3 == 0, c("max_overlap")).otherwise(0.0).alias("old_overlap"), c("max_iou").alias("old_iou"), c("h").alias("height"), c("w").alias("width"),
        F.when(c("s") % 4 > 0, (c("s") % 10) / 10).alias("foot"), ((c("p") % 12) / 200).alias("foot_avoid"), (c("y2") / 512).alias("ground_share"), F.when(c("s") % 17 > 0, c("h") * (c("p") % 20) / 20).alias("mask_height"),
        geo.touches_border(geo.Box.of(), F.lit(512), F.lit(512)).alias("at_border"), scores.scale_policy(c("h") / 100, F.when(c("conf") >= 5, 0.5).otherwise(0.1), F.lit(0.01)).alias("policy"),
    )
    return detection.gate_cascade(rows).select(*KEYS, "reject_reason")


_TOP = f"""sc AS (SELECT *, {_V_SQL} AS variant, round(conf / 100.0::DOUBLE + 2.2 * ((s % 10) / 10.0::DOUBLE), 6) AS score, det_idx * 100000000 + p * 10000 + s AS k FROM (SELECT DISTINCT * FROM inst)),
one AS (SELECT *, CASE min(p % 6) OVER (PARTITION BY image_id) WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END AS want, min(p % 6) OVER (PARTITION BY image_id) AS v FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, k) AS r, max(score) OVER (PARTITION BY image_id) AS best FROM one),
top AS (SELECT * FROM rk WHERE r <= want OR (r <= want + 2 AND best - score <= 1.35))"""


@query(f"""{WITH}, {_TOP}, n AS (SELECT image_id, count(*) AS n, round(avg(conf), 4) AS c FROM top WHERE conf >= 20 GROUP BY image_id)
SELECT o.image_id, o.v::INT AS v, coalesce(n, 0) AS n, c AS person_confidence, CASE WHEN coalesce(n, 0) >= CASE WHEN o.v IN (1, 2) THEN 2 ELSE 1 END THEN '' ELSE 'not_enough_new_people' END AS reject_reason
FROM (SELECT DISTINCT image_id, v FROM one) o LEFT JOIN n USING (image_id)""")
def count_rules(spark, sf_dir):
    """The best detections of each image, and whether enough of them are accepted."""
    w = Window.partitionBy("image_id")
    rows = tables.instances(spark, sf_dir).distinct().withColumn("v", F.min(F.col("p") % 6).over(w)).withColumn("variant", _variant("v"))
    rows = rows.withColumn("score", F.round(scores.detection_rank(F.col("conf") / 100, (F.col("s") % 10) / 10, F.lit(0.0), F.lit(2.718281828459045), F.lit(0.0), F.lit(0.0)), 6)).withColumn("expected_count", text.expected_count(F.col("variant")))
    rows = rows.withColumn("det_idx", F.col("det_idx") * 100000000 + F.col("p") * 10000 + F.col("s"))
    best = detection.top_detections(rows)
    images = rows.select("image_id", "variant", "v").distinct()
    out = detection.count_rule(images, best.filter("conf >= 20"))
    return images.join(out, ["image_id", "variant"]).select("image_id", F.col("v").cast("int").alias("v"), "n", "person_confidence", "reject_reason")


_T = clamp_sql("(a.x1 + a.x2) / 2 - (a.x2 - a.x1) * 2.2 / 2", "(a.y1 + a.y2) / 2 - (a.y2 - a.y1) * 2.2 / 2", "(a.x1 + a.x2) / 2 + (a.x2 - a.x1) * 2.2 / 2", "(a.y1 + a.y2) / 2 + (a.y2 - a.y1) * 2.2 / 2", "512", "512")


@query(f"""{WITH}, a AS (SELECT image_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM inst WHERE side = 'O' GROUP BY image_id),
w AS (SELECT a.image_id, {_T[0]} AS tx1, {_T[1]} AS ty1, {_T[2]} AS tx2, {_T[3]} AS ty2, a.x1 + a.x2 AS sx, a.y1 + a.y2 AS sy, greatest(1, a.y2 - a.y1) AS th FROM a),
j AS (SELECT i.*, i.det_idx * 100000000 + i.p * 10000 + i.s AS k, {inter_sql('', 't')} AS bo, {area_sql('')} AS one, {area_sql('t')} AS two, sx, sy, th FROM (SELECT DISTINCT * FROM inst WHERE side = 'F') i JOIN w USING (image_id)),
f AS (SELECT image_id, k, round(3 * bo / greatest(one + two - bo, 1) + 1.5 * bo / greatest(1, one) + conf / 100.0::DOUBLE - sqrt(pow((x1 + x2 - sx) / 2, 2) + pow((y1 + y2 - sy) / 2, 2)) / 512, 6) AS score
 FROM j WHERE p % 5 <> 0 AND h / th BETWEEN 0.75 AND 2.05 AND h * 0.9 / th >= 0.5 AND (bo > 0 OR bo / greatest(1, one) >= 0.12))
SELECT image_id, arg_max(k, (score, -k)) AS det_idx, max(score) AS score FROM f GROUP BY image_id""")
def chosen_masks(spark, sf_dir):
    """The detection nearest to what was inserted, among those of the right kind and size."""
    boxes = tables.instances(spark, sf_dir).distinct()
    target = geo.around(boxes.filter("side = 'O'")).select("image_id", *geo.Box.of().columns("t_"))
    rows = boxes.filter("side = 'F'").join(target, "image_id").withColumn("det_idx", F.col("det_idx") * 100000000 + F.col("p") * 10000 + F.col("s"))
    rows = rows.withColumns({"cls": F.lit(0), "partial_reason": F.when(F.col("p") % 5 == 0, "aspect").otherwise(""), "mask_height": F.col("h") * 0.9, "conf": F.col("conf") / 100})
    return detection.nearest_to_target(rows).withColumn("score", F.round("score", 6))


@query(f"""{WITH}, m AS (SELECT *, {_V_SQL} AS variant, CASE WHEN p % 13 > 0 THEN w END AS mw, CASE WHEN p % 13 > 0 THEN h END AS mh, (s % 90)::DOUBLE + 60 AS dh, CASE WHEN p % 3 > 0 THEN (p % 200)::DOUBLE END AS eh, (s % 100) / 100.0::DOUBLE AS opaque, (p % 40) / 20.0::DOUBLE AS diff,
 (p % 10) / 10.0::DOUBLE AS top, (s % 10) / 10.0::DOUBLE AS middle, (p % 7) / 20.0::DOUBLE AS low FROM inst),
t AS (SELECT *, greatest(0, least(1, (y2 - 512 * 0.68::DOUBLE) / (512 * 0.90::DOUBLE - 512 * 0.68::DOUBLE))) AS t FROM m),
l AS (SELECT *, CASE WHEN variant = 'add_distant_pedestrian' THEN 0.08 ELSE greatest(CASE WHEN variant = 'add_near_pedestrian' THEN 0.16 ELSE 0.09 END, 0.08 + t * (0.17 - 0.08), CASE WHEN y2 / 512 >= 0.72 THEN 0.12 ELSE 0 END) END AS least_r FROM t)
SELECT image_id, det_idx, p, s, CASE WHEN mh IS NULL THEN 'empty mask' WHEN greatest(1, mh) / dh < 0.62 THEN 'too little detection height' WHEN greatest(1, mh) / 120 < 0.48 THEN 'too little target height'
 WHEN NOT greatest(1, mh) / greatest(1, mw) BETWEEN 1.35 AND 6 THEN 'aspect' WHEN s % 19 = 0 THEN 'empty detection crop' WHEN least(top, middle) < 0.18 OR low < 0.081 THEN 'vertical coverage' ELSE '' END AS partial_reason,
CASE WHEN mh IS NULL THEN 'accepted_mask_empty' WHEN NOT mh / greatest(1, mw) BETWEEN 1.15 AND 6 THEN 'mask_aspect_invalid' WHEN eh > 1 AND NOT mh / eh BETWEEN 0.76 AND 1.85 THEN 'final_scale_mismatch'
 WHEN coalesce(eh, 0) <= 1 AND mh < 512 * least_r THEN 'person_too_small' WHEN opaque < 0.24 THEN 'mask_too_soft' WHEN diff < CASE WHEN s % 2 = 0 THEN 0.75 ELSE 1.0 END THEN 'ghost_person_low_contrast' ELSE '' END AS reject_reason,
CASE WHEN eh > 1 THEN round(mh / eh, 4) END AS final_scale_ratio FROM l""")
def mask_gates(spark, sf_dir):
    """Whether a mask is a whole body, and what the final check says of it."""
    c = F.col
    rows = tables.instances(spark, sf_dir).withColumn("variant", _variant()).withColumns({
        "mask_width": F.when(c("p") % 13 > 0, c("w")), "mask_height": F.when(c("p") % 13 > 0, c("h")), "det_height": (c("s") % 90).cast("double") + 60, "target_height": F.lit(120.0),
        "expected_height": F.when(c("p") % 3 > 0, (c("p") % 200).cast("double")), "opaque_share": (c("s") % 100) / 100, "diff255": (c("p") % 40) / 20, "seamless": c("s") % 2 == 0, "ground_y": c("y2"),
        "top": F.when(c("s") % 19 > 0, (c("p") % 10) / 10), "middle": F.when(c("s") % 19 > 0, (c("s") % 10) / 10), "low": (c("p") % 7) / 20,
    })
    return detection.final_mask_gate(detection.mask_completeness(rows)).select(*KEYS, "partial_reason", "reject_reason", "final_scale_ratio")


@query(f"""{WITH} SELECT image_id, det_idx, p, s, CASE split WHEN 'train' THEN 'train' ELSE 'gated' END AS split, CASE WHEN (p % 100) / 1000.0 < 0.05 AND (s % 100) / 100.0 > 0.28 AND det_idx < 3 THEN 'bad_placement' ELSE '' END AS reject_reason FROM inst JOIN images USING (image_id)""")
def target_windows(spark, sf_dir):
    """Results that miss their target window while attempts remain, with relabelled splits."""
    rows = tables.instances(spark, sf_dir).join(tables.images(spark, sf_dir).select("image_id", "split"), "image_id")
    rows = rows.withColumns({"target_overlap": (F.col("p") % 100) / 1000, "centre_distance": (F.col("s") % 100) / 100, "attempts_left": 3 - F.col("det_idx"), "reject_reason": F.lit(None).cast("string")})
    return attempts.bad_placement(attempts.gate_target_splits(rows, "gated")).select(*KEYS, "split", "reject_reason")


@query(f"""{WITH}, b AS (SELECT DISTINCT * FROM inst), a AS (SELECT * FROM b WHERE class_name = 'A'),
pr AS (SELECT a.image_id, a.det_idx, a.p, a.s, {_SHARE} AS share FROM a JOIN b ON a.image_id = b.image_id AND b.class_name = 'N' WHERE NOT {_OK} AND {inter_sql('a.', 'b.')} > 0),
ve AS (SELECT a.image_id, a.det_idx, a.p, a.s, {inter_sql('a.', 'b.')} / least(greatest({area_sql('a.')}, 1), greatest({area_sql('b.')}, 1)) AS share, b.y2 AS by2, a.y2 AS ay2, b.h AS bh, a.h AS ah FROM a JOIN b ON a.image_id = b.image_id AND b.class_name = 'R' WHERE {inter_sql('a.', 'b.')} > 0),
al AS (SELECT image_id, det_idx, p, s, share FROM pr UNION ALL SELECT image_id, det_idx, p, s, share FROM ve WHERE share >= 0.03 AND (by2 >= ay2 - 18 OR bh >= ah * 0.35))
SELECT a.image_id || '_' || a.det_idx || '_' || a.p || '_' || a.s AS box_id, count(share) AS n_occluders, coalesce(round(max(share), 4), 0) AS max_share FROM a LEFT JOIN al USING (image_id, det_idx, p, s) GROUP BY ALL""")
def foreground_occluders(spark, sf_dir):
    """Persons and vehicles that stand before a box, and the largest overlap with one."""
    boxes = tables.instances(spark, sf_dir).distinct().withColumn("box_id", text.stable_id(*(F.col(k) for k in KEYS)))
    of = lambda k: boxes.filter(F.col("class_name") == k).select("image_id", *geo.Box.of().columns("e_"))
    return placement.foreground_occluders(boxes.filter("class_name = 'A'").select("image_id", "box_id", *BOX), of("N"), of("R"))


_PERSPECTIVE = "(0.5 + greatest(0, least(1, ({} - 512 * 0.68::DOUBLE) / (512 * 0.9::DOUBLE - 512 * 0.68::DOUBLE))) * (1.14 - 0.5))"


def _line_sql(name: str) -> str:
    return f"""{name}n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY g, h) AS i FROM {name}),
{name}s AS (SELECT a.image_id, median((b.h - a.h) / (b.g - a.g)) AS k FROM {name}n a JOIN {name}n b ON a.image_id = b.image_id AND a.i < b.i WHERE abs(b.g - a.g) >= 24 AND (b.h - a.h) / (b.g - a.g) BETWEEN 0.06 AND 1.1 GROUP BY a.image_id),
{name}l AS (SELECT {name}.image_id, any_value(k) AS k, median({name}.h - k * g) AS c FROM {name} JOIN {name}s USING (image_id) GROUP BY {name}.image_id),
{name}f AS (SELECT image_id, CASE WHEN k * 400 + c > 0 THEN k * 400 + c END AS f FROM {name}l)"""


@query(f"""{WITH}, b AS (SELECT DISTINCT * FROM inst), pp AS (SELECT image_id, y2 AS g, h FROM b WHERE class_name = 'N' AND h BETWEEN 24 AND 180 AND (x2 - x1) / greatest(1, h) BETWEEN 0.12 AND 0.85),
vv AS (SELECT image_id, y2 AS g, h * 1.05::DOUBLE AS h FROM b WHERE h BETWEEN 18 AND 130 AND (x2 - x1) * 3 / greatest(1, h) BETWEEN 1.0 AND 4.8 AND class_name = 'R'),
{_line_sql('pp')}, {_line_sql('vv')},
near AS (SELECT image_id, CASE WHEN k[1] <= 70 THEN k[3] * {_PERSPECTIVE.format('400')} / {_PERSPECTIVE.format('k[2]')} END AS v FROM (SELECT image_id, min((abs(g - 400), g, h)) AS k FROM pp GROUP BY image_id)),
wt AS (SELECT image_id, sum(h / (1 + abs(g - 400))) / sum(1 / (1 + abs(g - 400))) AS v FROM vv WHERE abs(g - 400) <= 120 GROUP BY image_id),
r AS (SELECT images.image_id, coalesce(ppf.f, near.v) AS person, coalesce(vvf.f, wt.v) AS vehicle FROM images LEFT JOIN ppf USING (image_id) LEFT JOIN near USING (image_id) LEFT JOIN vvf USING (image_id) LEFT JOIN wt USING (image_id))
SELECT image_id, round(person, 5) AS person, round(vehicle, 5) AS vehicle, round(coalesce(0.3 * person + 0.7 * vehicle, person, vehicle), 5) AS reference FROM r""")
def reference_heights(spark, sf_dir):
    """Height at a ground position: a robust line, else the nearest person or the weighted vehicles, then both blended."""
    boxes = tables.instances(spark, sf_dir).distinct()
    wide = boxes.filter("class_name = 'R'").withColumn("x2", F.col("x1") + (F.col("x2") - F.col("x1")) * 3)
    targets = tables.images(spark, sf_dir).select("image_id", F.lit(400.0).alias("target_y"))
    found = placement.reference_height(targets, boxes.filter("class_name = 'N'"), wide)
    return _rounded(found.select("image_id", "person", "vehicle", "reference"), 5, "person", "vehicle", "reference")


_BASE = "CASE variant " + " ".join(f"WHEN '{k}' THEN {v.base_height}" for k, v in VARIANTS.items()) + " END"
_MULT = "CASE variant " + " ".join(f"WHEN '{k}' THEN {v.scale_multiplier}" for k, v in VARIANTS.items()) + " END"
_LEAST = "CASE variant " + " ".join(f"WHEN '{k}' THEN {v.min_height_ratio}" for k, v in VARIANTS.items()) + " END"


@query(f"""{WITH}, b AS (SELECT image_id, det_idx, p, s, {_V_SQL} AS variant, (250 + s * 5 % 262)::DOUBLE AS y, CASE WHEN p % 3 > 0 THEN h END AS ref FROM inst),
f0 AS (SELECT *, {_PERSPECTIVE.format('y')} AS sc, least({_BASE} * {_PERSPECTIVE.format('y')}, 512 * CASE variant WHEN 'add_near_pedestrian' THEN 0.62 WHEN 'add_distant_pedestrian' THEN 0.26 ELSE 0.50 END) AS f FROM b),
f1 AS (SELECT * EXCLUDE (f), CASE WHEN y / 512 < 0.74 THEN least(f, 512 * 0.34) ELSE f END AS f FROM f0),
f2 AS (SELECT *, CASE WHEN ref IS NULL THEN f ELSE 0.56 * greatest(f * 0.7, least(ref, f * 1.75)) + 0.44 * f END * greatest({_MULT}, 1.6) AS h0, 512 * (0.28 + 0.34 * greatest(0, least(1, y / 512))) AS m0 FROM f1),
f3 AS (SELECT *, greatest(512 * {_LEAST}, least(h0, CASE variant WHEN 'add_distant_pedestrian' THEN least(m0, 512 * 0.25) WHEN 'add_near_pedestrian' THEN least(m0, 512 * 0.72) ELSE m0 END)) AS hh FROM f2),
k AS (SELECT *, hh * 0.36 * CASE variant WHEN 'add_two_pedestrians' THEN 2 * 0.86 WHEN 'add_small_group' THEN 3 * 0.86 ELSE 1.0 END AS ww,
 greatest(CASE WHEN variant IN ('add_distant_pedestrian', 'add_small_group') THEN 0.82 WHEN variant = 'add_near_pedestrian' THEN 1.13 WHEN variant = 'add_two_pedestrians' THEN 0.96 ELSE 1.0 END, 1.6) AS mu,
 greatest(0, least(1, (y - 512 * 0.68::DOUBLE) / (512 * 0.90::DOUBLE - 512 * 0.68::DOUBLE))) AS t,
 CASE WHEN variant IN ('add_two_pedestrians', 'add_small_group') THEN ([-0.04, 0.0, 0.04, -0.02, 0.02])[det_idx % 5 + 1] ELSE 0 END AS jit FROM f3)
SELECT image_id, det_idx, p, s, round(sc, 6) AS perspective, round(f, 5) AS fallback, round(greatest(28, least(ww * 1.3, 480)), 3) AS w_raw, round(greatest(46, least(hh * 1.16, 480)), 3) AS h_raw,
round(greatest(28, greatest(0.075, least(0.29, 0.065 + (y / 512 - 0.55) * 0.58)) * mu * (1 + jit) * 512), 4) AS expected,
round(CASE variant WHEN 'add_distant_pedestrian' THEN 0.08 ELSE greatest(CASE variant WHEN 'add_near_pedestrian' THEN 0.16 ELSE 0.09 END, 0.08 + t * (0.17 - 0.08), CASE WHEN y / 512 >= 0.72 THEN 0.12 ELSE 0 END) END, 6) AS least_share,
round(CASE variant WHEN 'add_distant_pedestrian' THEN 0.27 ELSE 0.36 + t * (CASE variant WHEN 'add_near_pedestrian' THEN 0.62 ELSE 0.52 END - 0.36) END, 6) AS most_share FROM k""")
def insert_sizes(spark, sf_dir):
    """Sizes by variant and ground position: fallback, insert size, expected and accepted heights."""
    v, y = F.col("variant"), F.col("y")
    rows = tables.instances(spark, sf_dir).select(*KEYS, _variant().alias("variant"), (250 + F.col("s") * 5 % 262).cast("double").alias("y"), F.when(F.col("p") % 3 > 0, F.col("h")).alias("ref"))
    w, h = scores.insert_size_raw(v, y, F.col("ref"))
    least, most = scores.accepted_height_range(v, y)
    expected = scores.expected_height(y, F.lit(512.0), v, scores.group_jitter(v, F.col("det_idx")))
    out = rows.select(*KEYS, scores.perspective_scale(y).alias("perspective"), scores.fallback_height(v, y).alias("fallback"), w.alias("w_raw"), h.alias("h_raw"), expected.alias("expected"), least.alias("least_share"), most.alias("most_share"))
    return _rounded(_rounded(_rounded(_rounded(out, 6, "perspective", "least_share", "most_share"), 5, "fallback"), 4, "expected"), 3, "w_raw", "h_raw")


_U = "(('0x' || substr(md5('42:' || {}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_UY, _UX = _U.format("'y:' || image_id || ':' || variant || ':' || t"), _U.format("'x:' || image_id || ':' || variant || ':' || t")
_UJ = {k: _U.format(f"'{k}:' || image_id || ':' || variant") for k in ("sx", "sy", "jx", "jy")}


@query(f"""{WITH}, r AS (SELECT image_id, variant, t FROM (SELECT image_id, CASE group_id % 4 WHEN 0 THEN 'add_near_pedestrian' WHEN 1 THEN 'add_distant_pedestrian' WHEN 2 THEN 'add_occluded_pedestrian' ELSE 'add_single_pedestrian' END AS variant FROM images), range(6) z(t)),
d AS (SELECT *, {_UY} AS u, {_UX} AS ux, {_UJ['sx']} AS sx, {_UJ['sy']} AS sy, {_UJ['jx']} AS jx, {_UJ['jy']} AS jy FROM r),
g AS (SELECT *, CASE variant WHEN 'add_near_pedestrian' THEN 412 WHEN 'add_occluded_pedestrian' THEN 370 ELSE 348 END AS y0, CASE variant WHEN 'add_distant_pedestrian' THEN 386 WHEN 'add_occluded_pedestrian' THEN 435 ELSE 460 END AS y1,
 CASE variant WHEN 'add_distant_pedestrian' THEN 0.90 * pow(u, 1.35) WHEN 'add_near_pedestrian' THEN 0.12 + 0.76 * pow(u, 1.25) ELSE 0.06 + 0.84 * pow(u, 1.15) END AS k FROM d)
SELECT image_id, variant, t::INT AS try, round_even(y0 + greatest(0, least(0.92, k)) * (y1 - y0), 0)::INT AS ground_y, (16 + floor(ux * 481))::INT AS centre_x,
round(greatest(0.08, least(0.92, ([0.2, 0.36, 0.52, 0.68, 0.82])[floor(sx * 5)::INT + 1] + (jx * 2 - 1) * 0.06)), 6) AS target_x,
round(greatest(0.68, least(0.90, CASE variant WHEN 'add_distant_pedestrian' THEN ([0.68, 0.74])[floor(sy * 2)::INT + 1] WHEN 'add_near_pedestrian' THEN ([0.86, 0.91])[floor(sy * 2)::INT + 1] ELSE ([0.68, 0.74, 0.8, 0.86, 0.91])[floor(sy * 5)::INT + 1] END + (jy * 2 - 1) * 0.06)), 6) AS target_y FROM g""")
def candidate_draws(spark, sf_dir):
    """Ground positions that are tried for each image and variant, and its target slot."""
    g = F.col("group_id") % 4
    images = tables.images(spark, sf_dir).select("image_id", F.when(g == 0, _V[5]).when(g == 1, _V[4]).when(g == 2, _V[3]).otherwise(_V[0]).alias("variant"))
    found = placement.make_candidates(images, 6, 42).join(placement.slot_target(images, 42), ["image_id", "variant"])
    return _rounded(found, 6, "target_x", "target_y")


_SCORE = """(1.10 * (1 - least(1, abs(y2 - (512 * 0.68::DOUBLE + 0.68 * (512 * 0.9::DOUBLE - 512 * 0.68::DOUBLE))) / (512 * 0.9::DOUBLE - 512 * 0.68::DOUBLE)))
 + 1.45 * greatest(0, 1 - (abs((x1 + x2) / 2 / 512 - 0.5) / 0.24 + abs(y2 / 512 - 0.8) / 0.18) / 2) + 0.35 * least(1, greatest(0, least(x1, y1, 512 - x2, 512 - y2) / 16))
 + 0.45 * CASE WHEN h / 512 < 0.10 THEN h / 512 / 0.10 WHEN h / 512 > 0.42 THEN greatest(0, 1 - (h / 512 - 0.42) / 0.20) ELSE 1 END - 3.0 * 0.35 * po + 0.08 * least(least(1, vo), 0.22) - CASE WHEN least(1, vo) > 0.22 THEN 3.0 * (least(1, vo) - 0.22) ELSE 0 END)"""


@query(f"""{WITH}, d AS (SELECT DISTINCT * FROM inst), a AS (SELECT * FROM d WHERE side = 'F'), q AS (SELECT a.image_id, a.det_idx, a.p, a.s, coalesce(max({_SHARE}) FILTER (b.p IS NOT NULL), 0) AS po, coalesce(bool_or(NOT {_OK}) FILTER (b.p IS NOT NULL), false) AS bad FROM a LEFT JOIN d b ON a.image_id = b.image_id AND b.side = 'O' AND b.class_name = 'N' GROUP BY ALL),
vq AS (SELECT a.image_id, a.det_idx, a.p, a.s, coalesce(sum({inter_sql('a.', 'b.')} / greatest({area_sql('a.')}, 1)) FILTER (b.p IS NOT NULL), 0) AS vo FROM a LEFT JOIN d b ON a.image_id = b.image_id AND b.side = 'O' AND b.class_name = 'A' GROUP BY ALL),
k AS (SELECT a.*, round({_SCORE} + 6.5 * ((a.s % 10) / 10.0) + 0.45 * 0.5 - 9.0 * ((a.p % 3) / 10.0) + 0.00000001::DOUBLE, 6) AS score, det_idx * 100000000 + p * 10000 + s AS t FROM a JOIN q USING (image_id, det_idx, p, s) JOIN vq USING (image_id, det_idx, p, s) WHERE NOT bad AND (a.s % 10) / 10.0 >= 0.48 AND (a.p % 12) / 200.0 <= 0.05)
SELECT image_id, arg_max(t, (score, -t)) AS try, max(score) AS score, arg_max(x1, (score, -t)) AS x1, arg_max(y2, (score, -t)) AS y2 FROM k GROUP BY image_id""")
def best_placements(spark, sf_dir):
    """The best-scoring box of each image among those that stand right and on the ground."""
    boxes, c = tables.instances(spark, sf_dir).distinct(), F.col
    old = boxes.filter("side = 'O'")
    made = boxes.filter("side = 'F'").select(
        "image_id", F.lit("v").alias("variant"), (c("det_idx") * 100000000 + c("p") * 10000 + c("s")).alias("try"), text.stable_id(*(c(k) for k in KEYS)).alias("candidate_id"), *BOX, c("y2").cast("int").alias("ground_y"),
        ((c("s") % 10) / 10).alias("foot"), ((c("p") % 12) / 200).alias("foot_avoid"), F.lit(0.5).alias("body"), ((c("p") % 3) / 10).alias("avoid"),
    )
    targets = tables.images(spark, sf_dir).select("image_id", F.lit("v").alias("variant"), F.lit(0.5).alias("target_x"), F.lit(0.8).alias("target_y"))
    scored = placement.scored_candidates(made, old.filter("class_name = 'N'"), old.filter("class_name = 'A'"), targets).withColumn("score", F.round(F.col("score") + 1e-8, 6))
    return placement.best_region(scored).select("image_id", "try", "score", "x1", "y2")


@query(f"""{WITH}, b AS (SELECT image_id, det_idx, p, s, greatest(0, round_even(x1, 0)) AS a1, greatest(0, round_even(y1, 0)) AS b1, least(512, round_even(x2, 0)) AS a2, least(512, round_even(y2, 0)) AS b2, (40 + s % 200)::DOUBLE AS eh, conf / 100.0::DOUBLE AS c FROM inst),
r AS (SELECT *, greatest(1, a2 - a1) AS sw, greatest(1, b2 - b1) AS sh FROM b), k AS (SELECT *, eh / sh AS ratio, greatest(4, round_even(sw * (eh / sh), 0)) AS w, greatest(8, round_even(sh * (eh / sh), 0)) AS h FROM r),
m AS (SELECT *, round_even((a1 + a2) / 2 - w / 2, 0) AS l FROM k), q AS (SELECT *, l < 9 OR l + w > 503 OR b2 - h < 9 OR b2 > 503 AS border, CASE WHEN ratio BETWEEN 0.62 AND 2.2 THEN 'recoverable' WHEN ratio < 0.35 OR ratio > 3.2 THEN 'unrecoverable' WHEN c >= 0.05 THEN 'borderline_accept' ELSE 'borderline_retry' END AS pol FROM m),
f AS (SELECT *, CASE WHEN pol IN ('unrecoverable', 'borderline_retry') THEN pol WHEN border THEN 'border_reject_after_resize' WHEN NOT h / w BETWEEN 1.35 AND 3.6 OR h * w / 262144 < 0.00045 THEN 'bad_scale_geometry_after_resize' ELSE pol END AS status FROM q)
SELECT image_id, det_idx, p, s, round(ratio, 6) AS scale_ratio, status, l AS r_x1, b2 - h AS r_y1, l + w AS r_x2, b2 AS r_y2, CASE WHEN status IN ('recoverable', 'borderline_accept') THEN '' ELSE 'scale_unrecoverable' END AS reject_reason FROM f""")
def scale_corrections(spark, sf_dir):
    """Resized boxes that keep their feet in place, with what speaks against them."""
    c = F.col
    items = tables.instances(spark, sf_dir).select(*KEYS, *BOX, (40 + c("s") % 200).cast("double").alias("expected_height"), F.when(c("conf") / 100 >= 0.05, 0.5).otherwise(0.1).alias("conf"), F.lit(0.01).alias("mask_share"), F.lit(512).alias("width"), F.lit(512).alias("height"))
    return placement.correction_plan(items).select(*KEYS, F.round("scale_ratio", 6).alias("scale_ratio"), "status", *["r_" + b for b in BOX], "reject_reason")


_PAIRS = """t AS (SELECT image_id, x1, y1, x2, y2, row_number() OVER (PARTITION BY image_id ORDER BY det_idx, p, s) AS g FROM inst WHERE side = 'O'),
d AS (SELECT image_id, x1, y1, x2, y2, conf, row_number() OVER (PARTITION BY image_id ORDER BY det_idx, p, s) AS g FROM inst WHERE side = 'F')"""
_IOU = f"{inter_sql('t.', 'd.')} / greatest({area_sql('t.')} + {area_sql('d.')} - {inter_sql('t.', 'd.')}, 1)"
GREEDY_SQL = f"""{WITH.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_PAIRS},
pf AS (SELECT t.image_id, t.g, list({{'i': d.g, 'v': {_IOU}}} ORDER BY {_IOU} DESC, d.g) FILTER (d.g IS NOT NULL) AS l FROM t LEFT JOIN d ON t.image_id = d.image_id GROUP BY ALL),
r AS (SELECT DISTINCT image_id, 0::BIGINT AS g, []::BIGINT[] AS used FROM t
 UNION ALL SELECT r.image_id, pf.g, CASE WHEN n.v >= 0.1 THEN list_append(used, n.i) ELSE used END FROM r JOIN pf ON pf.image_id = r.image_id AND pf.g = r.g + 1, LATERAL (SELECT list_filter(coalesce(pf.l, []), lambda x: NOT list_contains(r.used, x.i))[1] AS n)),
e AS (SELECT image_id, arg_max(len(used), g) AS tp FROM r GROUP BY image_id), a AS (SELECT image_id, count(*) AS n FROM t GROUP BY ALL), b AS (SELECT image_id, count(*) AS n FROM d GROUP BY ALL),
m AS (SELECT image_id, coalesce(tp, 0)::BIGINT AS tp, coalesce(a.n, 0) - coalesce(tp, 0)::BIGINT AS fn, coalesce(b.n, 0) - coalesce(tp, 0)::BIGINT AS fp FROM a FULL JOIN b USING (image_id) LEFT JOIN e USING (image_id))"""


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    order = Window.partitionBy("image_id", "side").orderBy("det_idx", "p", "s")
    boxes = tables.instances(spark, sf_dir).withColumn("idx", F.row_number().over(order)).withColumn("conf", F.col("conf") / 100)
    return boxes.filter("side = 'O'"), boxes.filter("side = 'F'")


@query(GREEDY_SQL + " SELECT * FROM m")
def greedy_matching(spark, sf_dir):
    """True and false positives and misses of each image."""
    return detection.greedy_matches(*_sides(spark, sf_dir), 0.1)


@query(GREEDY_SQL + " SELECT sum(tp)::BIGINT AS tp, sum(fn)::BIGINT AS fn, sum(fp)::BIGINT AS fp, round(sum(fn) / (sum(tp) + sum(fn)), 9) AS miss_rate FROM m")
def miss_rates(spark, sf_dir):
    """Share of missed boxes over all images."""
    return detection.miss_rate(detection.greedy_matches(*_sides(spark, sf_dir), 0.1)).withColumn("miss_rate", F.round("miss_rate", 9))


def _precision_sql(threshold: float) -> str:
    return f"""SELECT {threshold}::DOUBLE AS threshold, round(sum(p) / 101, 9) AS ap FROM (SELECT z, coalesce(max(precision) FILTER (recall >= z / 100.0::DOUBLE - 1e-11::DOUBLE), 0) AS p FROM range(101) q(z), (
 SELECT sum(tp) OVER w / (SELECT count(*) FROM t)::DOUBLE AS recall, sum(tp) OVER w / (sum(n) OVER w)::DOUBLE AS precision FROM (SELECT conf, count(*) AS n, count(*) FILTER (hit) AS tp FROM h{int(threshold * 100)} GROUP BY conf) WINDOW w AS (ORDER BY conf DESC)) GROUP BY z)"""


def _hits_sql(threshold: float) -> str:
    k = int(threshold * 100)
    return f"""r{k} AS (SELECT DISTINCT image_id, 0::BIGINT AS k, []::BIGINT[] AS used, 0 AS conf, false AS hit FROM o
 UNION ALL SELECT r.image_id, o.k, CASE WHEN n.v >= {threshold} THEN list_append(used, n.i) ELSE used END, o.conf, coalesce(n.v >= {threshold}, false) FROM r{k} r JOIN o ON o.image_id = r.image_id AND o.k = r.k + 1, LATERAL (SELECT list_filter(coalesce(o.l, []), lambda x: NOT list_contains(r.used, x.i))[1] AS n)),
h{k} AS (SELECT * FROM r{k} WHERE k > 0)"""


@query(f"""{WITH.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_PAIRS},
o AS (SELECT d.image_id, row_number() OVER (PARTITION BY d.image_id ORDER BY d.conf DESC, d.g) AS k, d.conf, list({{'i': t.g, 'v': {_IOU}}} ORDER BY {_IOU} DESC, t.g) FILTER (t.g IS NOT NULL) AS l FROM d LEFT JOIN t ON t.image_id = d.image_id GROUP BY d.image_id, d.g, d.conf),
{_hits_sql(0.05)}, {_hits_sql(0.3)} {_precision_sql(0.05)} UNION ALL {_precision_sql(0.3)}""")
def detection_precision(spark, sf_dir):
    """Average precision at two thresholds, every confidence a step of its own."""
    return detection.average_precision(*_sides(spark, sf_dir), [0.05, 0.3]).withColumn("ap", F.round("ap", 9))
