"""The registered queries of the library, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from curbside.functions import geometry as geo, scores, text
from curbside.operators import attempts, detection, metrics, pixels, placement, release
from curbside.plans import tables
from curbside.registry import BOX as _BOX, EVENTS as _EVENTS, ORACLES, QUERIES, WITH as _WITH, query, table as _table
from curbside.settings import CaptionSettings, CurationSettings, variant_table
from curbside.sources import scans



def _as_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = tables.instances(spark, sf_dir)
    seen = boxes.withColumnRenamed("ignore_flag", "ignore").withColumn("visible_w", F.col("w")).withColumn("visible_h", F.col("h") * (1 - F.col("occlusion") / 2))
    return seen.withColumn("occlusion", F.when(F.col("p") % 4 == 0, None).when(F.col("p") % 9 == 0, 1.3).otherwise(F.col("occlusion")))  # none of the table's boxes lacks it or is beyond 1


_SEEN = "CASE WHEN w * h > 0 THEN least(1.0, w * (h * (1 - occlusion / 2)) / (w * h)) ELSE 0.0 END"
_QUALITY = f"round(0.5 * ({_SEEN}) + CASE WHEN p % 4 = 0 THEN 0.3 WHEN p % 9 = 0 THEN 0.0 ELSE 0.3 * (1 - occlusion) END + 0.2 * least(1.0, h / 256), 4)"


@query(f"""{_WITH}, ok AS (SELECT image_id, source_id FROM images WHERE split = 'train'),
c AS (SELECT inst.*, source_id, {_SEEN} AS v, {_QUALITY} AS q FROM inst JOIN ok USING (image_id) WHERE class_name = 'N' AND NOT ignore_flag)
SELECT source_id, count(*) AS n_candidates, count(DISTINCT image_id) AS n_images, round(sum(round(q * 10000)::BIGINT)::DOUBLE / (count(*) * 10000)::DOUBLE, 3) AS mean_quality
FROM c WHERE h >= 96 AND v >= 0.45 AND q >= 0.7 GROUP BY source_id""")
def candidates_by_source(spark, sf_dir):
    """Boxes that qualify as training candidates outside eval splits, by source."""
    boxes = release.keep_class(_as_instances(spark, sf_dir), "N")
    images = release.training_images(tables.images(spark, sf_dir), tables.registry(spark, sf_dir))
    found = release.candidates(images, boxes, CurationSettings())
    return found.groupBy("source_id").agg(F.count("*").alias("n_candidates"), F.countDistinct("image_id").alias("n_images"), F.round(F.sum(F.round(F.col("quality_score") * 10000).cast("bigint")) / (F.count("*") * 10000), 3).alias("mean_quality"))  # whole numbers add up alike in any order


@query(f"""{_WITH} SELECT split, count(*) AS n FROM images WHERE image_id IN (SELECT image_id FROM inst WHERE class_name = 'N' AND NOT ignore_flag) GROUP BY split""")
def images_with_instances(spark, sf_dir):
    boxes = release.keep_class(_as_instances(spark, sf_dir), "N")
    return release.with_instances(tables.images(spark, sf_dir), boxes).groupBy("split").agg(F.count("*").alias("n"))


@query(f"""{_WITH} SELECT image_id, det_idx, p, s, round(x2 - x1, 4) AS width, (greatest(x2 - x1, 0) * greatest(y2 - y1, 0)) AS area,
round((least(x2, 400) - greatest(x1, 100)) * 0 + greatest(least(x2, 400) - greatest(x1, 100), 0) * greatest(least(y2, 420) - greatest(y1, 120), 0), 4) AS inter,
round(greatest(least(x2, 400) - greatest(x1, 100), 0) * greatest(least(y2, 420) - greatest(y1, 120), 0)
 / greatest((x2 - x1) * (y2 - y1) + 90000 - greatest(least(x2, 400) - greatest(x1, 100), 0) * greatest(least(y2, 420) - greatest(y1, 120), 0), 1), 6) AS iou,
x1 <= 3 OR y1 <= 3 OR x2 >= 509 OR y2 >= 509 AS at_border FROM inst""")
def box_geometry(spark, sf_dir):
    """Width, area, and overlap with a fixed window of every box."""
    boxes, b = tables.instances(spark, sf_dir), geo.Box.of()
    window = geo.Box(*(F.lit(float(v)) for v in (100, 120, 400, 420)))
    return boxes.select(
        "image_id", "det_idx", "p", "s", F.round(b.width, 4).alias("width"), geo.area(b).alias("area"), F.round(geo.intersection(b, window), 4).alias("inter"),
        F.round(geo.iou(b, window), 6).alias("iou"), geo.touches_border(b, F.lit(512), F.lit(512)).alias("at_border"),
    )


@query(f"""{_WITH}, k AS (SELECT *, greatest(0.0, x1 - w * 0.25)::DOUBLE AS a, greatest(0.0, y1 - h * 0.25)::DOUBLE AS b, least(512.0, x2 + w * 0.25)::DOUBLE AS c, least(512.0, y2 + h * 0.25)::DOUBLE AS d FROM inst),
t AS (SELECT *, trunc(a)::INT AS wx1, trunc(b)::INT AS wy1, trunc(c)::INT AS wx2, trunc(d)::INT AS wy2 FROM k)
SELECT image_id, det_idx, p, s, wx1, wy1, wx2, wy2, greatest(y1, y2 - greatest(4, trunc(h * 0.16)::INT)) AS foot_y FROM t WHERE wx2 - wx1 >= 8 AND wy2 - wy1 >= 8""")
def crop_windows(spark, sf_dir):
    """Context window and foot band of every box; windows under 8 pixels drop out."""
    boxes, b = tables.instances(spark, sf_dir), geo.Box.of()
    window = geo.context_window(b, F.lit(512), F.lit(512), 0.25)
    out = boxes.select("image_id", "det_idx", "p", "s", *window.columns("w"), geo.foot_band(b).y1.alias("foot_y"))
    return out.filter("wx2 - wx1 >= 8 AND wy2 - wy1 >= 8")


@query(f"""{_WITH} SELECT image_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM inst GROUP BY image_id""")
def union_boxes(spark, sf_dir):
    """Box around all boxes of an image."""
    return geo.around(tables.instances(spark, sf_dir))


@query("""WITH d AS (SELECT doc_id, coalesce(nullif(sha256(text), ''), doc_id::VARCHAR) AS k FROM documents)
SELECT doc_id AS image_id, first(doc_id) OVER (PARTITION BY k ORDER BY doc_id) AS canonical_image_id,
CASE WHEN first(doc_id) OVER (PARTITION BY k ORDER BY doc_id) = doc_id THEN 'unique' ELSE 'exact_duplicate' END AS dedupe_status FROM d""")
def exact_duplicates(spark, sf_dir):
    """First row of each content hash, with texts in the place of image files."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.col("doc_id").alias("ingest_seq"))
    return release.exact_groups(docs).select("image_id", "canonical_image_id", "dedupe_status")


_SPLIT = """g AS (SELECT group_id, row_number() OVER (ORDER BY md5('42:' || group_id), group_id) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM images)),
sp AS (SELECT group_id, CASE WHEN rn <= floor(n * 0.85::DOUBLE) THEN 'train' ELSE 'val' END AS part FROM g)"""


@query(f"""{_WITH}, {_SPLIT} SELECT image_id, group_id, part FROM images JOIN sp USING (group_id)""")
def group_split(spark, sf_dir):
    """Group-disjoint split of the images."""
    return release.split_groups(tables.images(spark, sf_dir), 0.85, 42, key="group_id", out="part").select("image_id", "group_id", "part")


@query(f"""{_WITH}, {_SPLIT}, r AS (SELECT image_id, group_id, part FROM images JOIN sp USING (group_id)), e AS (SELECT image_id, group_id FROM images WHERE split = 'test')
SELECT (SELECT count(*) FROM (SELECT group_id FROM r WHERE part = 'train' INTERSECT SELECT group_id FROM r WHERE part = 'val')) AS shared_group_id,
(SELECT count(*) FROM (SELECT image_id // 5 FROM r WHERE part = 'train' INTERSECT SELECT image_id // 5 FROM r WHERE part = 'val')) AS shared_duplicate_cluster_id,
(SELECT count(*) FROM (SELECT image_id FROM r INTERSECT SELECT image_id FROM e)) AS leaked_image_id,
(SELECT count(*) FROM (SELECT group_id FROM r INTERSECT SELECT group_id FROM e)) AS leaked_group_id""")
def leak_checks(spark, sf_dir):
    """Keys on both sides of the split, and eval keys in the release."""
    images = tables.images(spark, sf_dir)
    samples = release.split_groups(images, 0.85, 42, key="group_id", out="part").withColumn("split", F.col("part")).withColumn("duplicate_cluster_id", F.floor(F.col("image_id") / 5))
    return release.leaks(samples, images.filter("split = 'test'"))


@query(f"""{_WITH}, c AS (SELECT image_id, det_idx, p, s, CASE source_id WHEN '1-URGENT' THEN 'urban street scene' WHEN '5-LOW' THEN 'real-world scene' ELSE '' END AS scene,
CASE WHEN {_SEEN} = 0 THEN 1.0 ELSE {_SEEN} END AS v FROM inst JOIN images USING (image_id))
SELECT image_id, det_idx, p, s, 'a photo of <vin_ped> pedestrian, ' || CASE WHEN v >= 0.85 THEN 'full body' ELSE 'partially visible body' END || CASE WHEN v < 0.6 THEN ', partially occluded' ELSE '' END
 || CASE WHEN scene <> '' THEN ', ' || scene ELSE '' END || ', natural lighting' AS caption FROM c""")
def sample_captions(spark, sf_dir):
    """Caption of every box, from its visible share and its source."""
    boxes = _as_instances(spark, sf_dir).join(tables.images(spark, sf_dir).select("image_id", "source_id"), "image_id")
    seen = boxes.withColumn("visible_ratio", scores.visible_ratio(F.col("visible_w") * F.col("visible_h"), F.col("w") * F.col("h")))
    return release.with_captions(seen, CaptionSettings(scenes={"1-URGENT": "urban street scene", "5-LOW": "real-world scene"})).select("image_id", "det_idx", "p", "s", "caption")


@query(r"""SELECT item_id, count(*) AS n_texts FROM benchmark JOIN documents ON contains(documents.text, benchmark.text) GROUP BY item_id""")
def contamination(spark, sf_dir):
    """Documents that hold a benchmark passage, by passage."""
    return release.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), "text")


@query(r"""SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '\S+'))::INT AS n_tokens, contains(coalesce(text, ''), 'the') AS has_trigger, trim(coalesce(text, '')) = '' AS is_blank FROM conversations""")
def caption_contract(spark, sf_dir):
    """Token count and contract of captions, with conversation turns in their place."""
    t = F.col("text")
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", text.n_tokens(t).alias("n_tokens"), F.contains(F.coalesce(t, F.lit("")), F.lit("the")).alias("has_trigger"), (F.trim(F.coalesce(t, F.lit(""))) == "").alias("is_blank"))


@query(r"""SELECT p_partkey, coalesce(nullif(trim(regexp_replace(trim('Please add in ' || p_name), '^\s*(please\s+)?(add|place|put|insert|include|introduce|spawn|draw|paint)(\s+in|\s+on)?(\s+|$)', '', 'i')), ''), 'a person') AS subject,
regexp_matches(lower(p_name || ' ' || p_type), '\b(person|people|pedestrian|man|woman|men|women|boy|girl|child|children|kid|human)\b') AS is_person FROM part""")
def instruction_subjects(spark, sf_dir):
    """Subject phrase of imperative instructions, and the person filter."""
    return _table(spark, sf_dir, "part").select("p_partkey", text.subject_of(F.concat(F.lit("Please add in "), F.col("p_name"))).alias("subject"), text.mentions_person(F.col("p_name"), F.col("p_type")).alias("is_person"))


@query(r"""WITH u AS (SELECT page_id, string_split(lower(url), '/') AS p, coalesce(try_cast(regexp_replace(regexp_replace(list_last(string_split(url, '/')), '\.[^.]*$', ''), '[^0-9]', '', 'g') AS BIGINT), 0) AS frame FROM pages)
SELECT page_id, CASE WHEN list_contains(p, 'train') THEN 'train' WHEN list_contains(p, 'valid') OR list_contains(p, 'val') THEN 'val' WHEN list_contains(p, 'test') THEN 'test' ELSE 'train' END AS split, frame FROM u""")
def path_rules(spark, sf_dir):
    """Split and frame number of paths, with URLs in their place."""
    return _table(spark, sf_dir, "pages").select("page_id", text.split_of_path(F.col("url")).alias("split"), text.frame_number(F.col("url")).alias("frame"))


@query(f"""{_WITH}, d AS (SELECT image_id, max(conf) AS c, count(*) AS n FROM inst WHERE conf >= 25 AND class_name = 'N' GROUP BY image_id)
SELECT images.image_id, CASE WHEN n > 0 THEN 1 ELSE 0 END AS person_detected, coalesce(c, 0)::DOUBLE AS person_confidence, coalesce(n, 0) AS person_count FROM images LEFT JOIN d USING (image_id)""")
def presence_metrics(spark, sf_dir):
    """Detected flag, best confidence and count of every image."""
    boxes = tables.instances(spark, sf_dir).withColumn("cls", F.when(F.col("class_name") == "N", 0).otherwise(1))
    found = metrics.presence(tables.images(spark, sf_dir), metrics.keep_detections(boxes, 25, 0))
    return found.withColumn("person_confidence", F.col("person_confidence").cast("double"))


@query(f"""{_WITH}, a AS (SELECT image_id, count(*) FILTER (side = 'O') AS source_count, count(*) FILTER (side = 'F') AS result_count FROM inst GROUP BY image_id)
SELECT image_id, source_count, result_count, result_count - source_count AS person_count_delta, CASE WHEN result_count > source_count THEN 1 ELSE 0 END AS object_added FROM a""")
def inclusion_metrics(spark, sf_dir):
    """Objects before and after, and whether one was added."""
    boxes = tables.instances(spark, sf_dir)
    per = boxes.groupBy("image_id").agg(F.count_if(F.col("side") == "O").alias("o"), F.count_if(F.col("side") == "F").alias("f"))
    return metrics.inclusion(per.select("image_id", F.col("o").alias("person_count")), per.select("image_id", F.col("f").alias("person_count")))


@query(f"""{_WITH}, b AS (SELECT image_id, arg_max(y2 - y1, (conf, -det_idx, -p, -s)) AS height FROM inst GROUP BY image_id)
SELECT images.image_id, height, CASE WHEN group_id % 300 > 0 THEN round(height / (group_id % 300), 6) END AS scale_ratio, CASE WHEN group_id % 300 > 0 THEN round(abs(height - group_id % 300) / (group_id % 300), 6) END AS scale_error FROM images LEFT JOIN b USING (image_id)""")
def scale_metrics(spark, sf_dir):
    """Height of the most confident box against an expected one."""
    expected = tables.images(spark, sf_dir).select("image_id", (F.col("group_id") % 300).alias("expected_height"))
    return metrics.scale(tables.instances(spark, sf_dir), expected, ("det_idx", "p", "s")).select("image_id", "height", F.round("scale_ratio", 6).alias("scale_ratio"), F.round("scale_error", 6).alias("scale_error"))


@query(f"""{_EVENTS}, l AS (SELECT half, user_id, day, arg_max(value, (ts, event_id)) AS v FROM ev GROUP BY half, user_id, day)
SELECT 'scale_error' AS metric, round(avg(a.v), 4) AS mean_a, round(avg(b.v), 4) AS mean_b, count(*) AS n_pairs, round(round(avg(b.v), 4) - round(avg(a.v), 4), 4) AS delta,
round(round(avg(b.v), 4) - round(avg(a.v), 4), 4) <= 0 AS improved FROM l a JOIN l b ON a.half = 0 AND b.half = 1 AND a.user_id = b.user_id AND a.day = b.day""")
def paired_metrics(spark, sf_dir):
    """Two flows compared on their common keys, the last row of each."""
    ev = tables.events(spark, sf_dir).withColumn("scale_error", F.col("value")).withColumn("last", F.struct("ts", "event_id"))
    side = lambda k: metrics.last_per_key(ev.filter(F.col("half") == k).select("user_id", "day", "last", "scale_error"), ["user_id", "day"], "last")
    return metrics.paired(side(0), side(1), ["user_id", "day"])


@query(f"""{_EVENTS} SELECT count(*) AS generated, count(*) FILTER (event_type <> 'error') AS accepted, count(*) FILTER (event_type = 'error') AS rejected,
round((count(*) FILTER (event_type <> 'error'))::DOUBLE / count(*), 4) AS accept_rate, round(avg(value) FILTER (event_type <> 'error'), 4) AS mean_value FROM ev""")
def manifest_summary(spark, sf_dir):
    """Run summary of a manifest."""
    rows = tables.events(spark, sf_dir).withColumn("accepted", F.col("event_type") != "error")
    return metrics.run_summary(rows, ["value"])


@query(f"""{_EVENTS} SELECT event_type AS reason, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share FROM ev GROUP BY event_type""")
def reject_shares(spark, sf_dir):
    """Count and share of each reject reason."""
    return metrics.reject_histogram(tables.events(spark, sf_dir), "event_type").withColumn("share", F.round("share", 9))


@query(f"""{_EVENTS}, s AS (SELECT value, CASE WHEN event_id % 7 = 0 THEN 0 ELSE value / 2 END AS score FROM ev WHERE value > 0)
SELECT count(*) AS n, round(avg(value), 4) AS value_mean, round(quantile_cont(value, 0.1), 4) AS value_p10, round(avg(score), 4) AS score_mean, round(quantile_cont(score, 0.1), 4) AS score_p10 FROM s""")
def quality_percentiles(spark, sf_dir):
    """Mean and 10th percentile over rows with quality; a missing score counts as 0."""
    rows = tables.events(spark, sf_dir).withColumn("score", F.when(F.col("event_id") % 7 != 0, F.col("value") / 2))
    return metrics.quality_summary(rows, ["value", "score"], "value")


@query(f"""{_EVENTS}, r AS (SELECT event_type AS run, count(*) AS generated, count(*) FILTER (value > 10) AS accepted, round(avg(value), 6) AS mean_scale FROM ev GROUP BY 1)
SELECT run, sum(generated)::BIGINT AS generated, sum(accepted)::BIGINT AS accepted, round(avg(mean_scale), 6) AS mean_scale, round(sum(accepted)::DOUBLE / sum(generated), 9) AS accept_rate FROM r GROUP BY ROLLUP (run)""")
def run_rollup(spark, sf_dir):
    """Runs and their total, weighted and unweighted."""
    runs = tables.events(spark, sf_dir).groupBy(F.col("event_type").alias("run")).agg(F.count("*").alias("generated"), F.count_if(F.col("value") > 10).alias("accepted"), F.round(F.avg("value"), 6).alias("mean_scale"))
    return metrics.rollup_runs(runs).select("run", "generated", "accepted", F.round("mean_scale", 6).alias("mean_scale"), F.round("accept_rate", 9).alias("accept_rate"))


@query(f"""{_EVENTS}, a AS (SELECT count(*) AS n, count(*) FILTER (value > 10) AS k, round(stddev_samp(value), 6) AS sd, median(value) AS median, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS least, max(value) AS largest FROM ev)
SELECT *, round(k::DOUBLE / n, 6) AS rate, round(((k::DOUBLE / n + 3.8414588206941285::DOUBLE / (2 * n)) - 1.959963984540054::DOUBLE * sqrt((k::DOUBLE / n) * (1 - k::DOUBLE / n) / n + 3.8414588206941285::DOUBLE / (4 * n::DOUBLE * n))) / (1 + 3.8414588206941285::DOUBLE / n), 6) AS low,
round(((k::DOUBLE / n + 3.8414588206941285::DOUBLE / (2 * n)) + 1.959963984540054::DOUBLE * sqrt((k::DOUBLE / n) * (1 - k::DOUBLE / n) / n + 3.8414588206941285::DOUBLE / (4 * n::DOUBLE * n))) / (1 + 3.8414588206941285::DOUBLE / n), 6) AS high FROM a""")
def rate_intervals(spark, sf_dir):
    """Rate with its interval and the spread of a value."""
    out = metrics.rate_audit(tables.events(spark, sf_dir), "value", F.col("value") > 10)
    return out.withColumns({c: F.round(c, 6) for c in ("sd", "p95", "rate", "low", "high")})


@query(f"""{_EVENTS} SELECT count(*) AS n, count(DISTINCT event_id) AS n_keys, count(DISTINCT user_id) AS n_seeds, min(user_id) AS first_seed, max(user_id) AS last_seed, count(*) FILTER (event_id IS NULL) AS missing_keys,
count(*) FILTER (event_id % 2 + half <> 2 * half) AS broken_sums FROM ev""")
def row_integrity(spark, sf_dir):
    """Keys, seeds and identities of a case table."""
    return metrics.integrity(tables.events(spark, sf_dir), "event_id", "user_id", F.col("event_id") % 2 + F.col("half"), 2 * F.col("half"))


def _order(*keys):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy("det_idx", "p", "s")


@query(f"""{_WITH}, t AS (SELECT image_id, x1 AS a1, y1 AS b1, x2 AS a2, y2 AS b2 FROM inst WHERE side = 'O'),
j AS (SELECT i.image_id, i.conf, greatest(least(x2, a2) - greatest(x1, a1), 0) * greatest(least(y2, b2) - greatest(y1, b1), 0) AS o, (x2 - x1) * (y2 - y1) + (a2 - a1) * (b2 - b1) AS u FROM t LEFT JOIN (SELECT * FROM inst WHERE side = 'F') i USING (image_id))
SELECT t.image_id, coalesce(bool_or(o / greatest(u - o, 1) >= 0.5), false) AS target_detected, round(coalesce(max(o / greatest(u - o, 1)), 0), 6) AS best_iou, coalesce(max(conf), 0) AS best_conf
FROM (SELECT DISTINCT image_id FROM t) t LEFT JOIN j USING (image_id) GROUP BY t.image_id""")
def target_detections(spark, sf_dir):
    """Whether a detection meets an inserted box of the image."""
    boxes = tables.instances(spark, sf_dir)
    inserted = boxes.filter("side = 'O'").select("image_id", *geo.Box.of().columns("i_"))
    found = metrics.target_detection(inserted, boxes.filter("side = 'F'").select("image_id", "conf", *_BOX))
    return found.withColumn("best_iou", F.round("best_iou", 6)).withColumn("best_conf", F.col("best_conf").cast("int"))


@query(f"""{_WITH}, m AS (SELECT image_id, det_idx, p, s, x1, y1, x2, y2, w, h, occlusion FROM inst),
pl AS (SELECT *, abs(y2 - 430) AS err, (x1 + x2) / 2 BETWEEN 0 AND 512 AND y2 BETWEEN 0 AND 512 AS inside, y2 / 512 >= 0.68 - 0.10 AND y2 / 512 <= 0.90 + 0.10 AS band FROM m),
q AS (SELECT *, greatest(0, least(1, 1 - err / greatest(54.0, 0.10 * 512))) * CASE WHEN inside THEN 1.0 ELSE 0.25 END * CASE WHEN band THEN 1.0 ELSE 0.55 END AS ps, exp(-abs(greatest(1, y2 - y1) - 150) / 150) AS ss FROM pl)
SELECT image_id, det_idx, p, s, round(ps, 4) AS placement_score, round(ss, 4) AS scale_score,
CASE WHEN round(ps, 4) < 0.45 THEN 'bad_placement' WHEN round(ss, 4) < 0.5 THEN CASE WHEN h > 150 THEN 'bad_scale_too_large' ELSE 'bad_scale_too_small' END ELSE '' END AS reason FROM q""")
def affordance_gates(spark, sf_dir):
    """Placement and scale scores of boxes as masks, and the gate they fail."""
    boxes, b = tables.instances(spark, sf_dir), geo.Box.of()
    p = scores.placement_score(b, F.lit(512), F.lit(512), F.lit(430))["placement_score"]
    s = scores.scale_score(b, F.lit(150.0))["scale_score"]
    out = boxes.select("image_id", "det_idx", "p", "s", "h", p.alias("placement_score"), s.alias("scale_score"))
    reason = scores.affordance_reason(F.col("placement_score"), F.col("scale_score"), F.lit(1.0), F.col("h"), F.lit(150.0))
    return out.withColumn("reason", reason).drop("h")


@query(f"""{_WITH} SELECT image_id, det_idx, p, s, CASE WHEN h / 100 BETWEEN 0.62 AND 2.2 THEN 'recoverable' WHEN h / 100 < 0.35 OR h / 100 > 3.2 THEN 'unrecoverable' WHEN conf >= 50 THEN 'borderline_accept' ELSE 'borderline_retry' END AS policy,
CASE class_name WHEN 'N' THEN 5 WHEN 'R' THEN 2 ELSE 4 END AS retry_budget FROM inst""")
def scale_policies(spark, sf_dir):
    """Scale policy and retry budget of boxes."""
    v = F.when(F.col("class_name") == "N", "add_small_group").when(F.col("class_name") == "R", "add_near_pedestrian").otherwise("add_single_pedestrian")
    policy = scores.scale_policy(F.col("h") / 100, F.when(F.col("conf") >= 50, 0.5).otherwise(0.1), F.lit(0.01))
    return tables.instances(spark, sf_dir).select("image_id", "det_idx", "p", "s", policy.alias("policy"), scores.retry_budget(v).alias("retry_budget"))


@query(f"""{_EVENTS}, a AS (SELECT event_id, user_id, event_type, row_number() OVER w - 1 AS attempt, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER w AS g FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, attempt, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY event_id)::BIGINT AS streak FROM a""")
def attempt_streaks(spark, sf_dir):
    """Attempt number and running streak of one reason, by user."""
    return attempts.streaks(tables.events(spark, sf_dir), "user_id", "event_id", "event_type", "error").select("event_id", "attempt", "streak")


@query(f"""{_WITH}, v(variant, low, high) AS (VALUES ('add_single_pedestrian', 0.0, 0.24), ('add_two_pedestrians', 0.24, 0.42), ('add_small_group', 0.42, 0.58), ('add_occluded_pedestrian', 0.58, 0.76), ('add_distant_pedestrian', 0.76, 0.9), ('add_near_pedestrian', 0.9, 1.0)),
j AS (SELECT split, source_id AS bucket, row_number() OVER (ORDER BY split, source_id, k) - 1 AS job_index FROM (SELECT DISTINCT split, source_id FROM images), range(20) t(k)),
u AS (SELECT *, job_index + 42 AS seed, ('0x' || substr(md5((job_index + 42)::VARCHAR || ':variant'), 1, 8))::BIGINT / 4294967296.0 AS u FROM j)
SELECT split, bucket, job_index, seed, variant FROM u JOIN v ON u >= low AND u < high""")
def weighted_jobs(spark, sf_dir):
    """Jobs of each split and bucket, with a variant drawn by weight."""
    records = tables.images(spark, sf_dir).select("split", F.col("source_id").alias("bucket"))
    return attempts.jobs(records, variant_table(spark), 20, 42).select("split", "bucket", "job_index", "seed", "variant")


@query(f"""{_WITH}, sm AS (SELECT image_id, y2 AS g, y2 - y1 AS h FROM inst WHERE y2 - y1 BETWEEN 24 AND 180 AND (x2 - x1) / (y2 - y1) BETWEEN 0.12 AND 0.85),
t AS (SELECT image_id, 400.0::DOUBLE AS target_y FROM images), n AS (SELECT image_id, min((abs(g - 400), g, h)) AS k FROM sm GROUP BY image_id)
SELECT t.image_id, CASE WHEN k[1] <= 70 THEN round(k[3] * (0.5 + greatest(0, least(1, (400 - 512 * 0.68) / (512 * 0.9 - 512 * 0.68))) * (1.14 - 0.5)) / (0.5 + greatest(0, least(1, (k[2] - 512 * 0.68) / (512 * 0.9 - 512 * 0.68))) * (1.14 - 0.5)), 6) END AS nearest
FROM t LEFT JOIN n USING (image_id)""")
def nearest_reference(spark, sf_dir):
    """Height at a ground position from the nearest sample of the image."""
    boxes = tables.instances(spark, sf_dir)
    targets = tables.images(spark, sf_dir).select("image_id", F.lit(400.0).alias("target_y"))
    return placement.nearest_height(targets, placement.person_samples(boxes)).select("image_id", F.round("nearest", 6).alias("nearest"))


@query(f"""{_WITH}, o AS (SELECT image_id, det_idx, p, s, h, row_number() OVER (PARTITION BY image_id ORDER BY y2, det_idx, p, s) AS i FROM (SELECT DISTINCT * FROM inst))
SELECT image_id, det_idx, p, s, round(max(h / pow(1.04, i)) OVER (PARTITION BY image_id ORDER BY i) * pow(1.04, i), 6) AS height FROM o""")
def monotonic_heights(spark, sf_dir):
    """Heights that grow with the ground position."""
    boxes = tables.instances(spark, sf_dir).distinct().withColumn("order", F.struct("det_idx", "p", "s")).withColumnsRenamed({"y2": "foot_y", "h": "expected_height"})
    return placement.monotonic_heights(boxes).select("image_id", "det_idx", "p", "s", F.round("expected_height", 6).alias("height"))


@query("""SELECT event_id, (event_id % 7 = 0) AS sampled, (rn - 1) // 6 // 10 AS window_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE (rn - 1) % 6 = 0""")
def sampled_frames(spark, sf_dir):
    """Every sixth frame of a sequence, and its window of ten frames that the sample keeps."""
    frames = scans.sequence_frames(tables.events(spark, sf_dir), 30, 5, 2, "user_id", "event_id")
    return frames.select("event_id", (F.col("event_id") % 7 == 0).alias("sampled"), "window_id")


@query("""SELECT event_id, try_cast(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS first_value FROM events""")
def number_cells(spark, sf_dir):
    """First number of a list cell, made from the events' properties."""
    cell = F.concat(F.lit("["), F.regexp_extract("props", r"([0-9]+)", 1), F.lit(", 7.5, null]"))
    return _table(spark, sf_dir, "events").select("event_id", text.first_number(cell).alias("first_value"))


from curbside import catalog_boxes, catalog_images, catalog_rules, catalog_files  # noqa: E402, F401, I001  its queries are registered when it is imported
