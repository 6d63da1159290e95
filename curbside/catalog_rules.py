"""Registered queries of text rules, scores, attempts, runs and the release."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from curbside.functions import geometry as geo, scores, text
from curbside.operators import attempts, detection, metrics, release
from curbside.plans import release_build, tables
from curbside.registry import BOX, EVENTS, KEYS, WITH, area_sql, query, table
from curbside.settings import VARIANTS, CaptionSettings, CurationSettings, variant_table
from curbside.sources import scans, sinks

_V = list(VARIANTS)
_V_SQL = "CASE {} % 6 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_V)) + " END"


def _variant(c: str):
    return F.coalesce(*[F.when(F.col(c) % 6 == i, v) for i, v in enumerate(_V)])


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


_SUBJECT = r"coalesce(nullif(trim(regexp_replace(trim('please draw on ' || p_name), '^\s*(please\s+)?(add|place|put|insert|include|introduce|spawn|draw|paint)(\s+in|\s+on)?(\s+|$)', '', 'i')), ''), 'a person')"


@query(rf"""WITH a AS (SELECT p_partkey, p_name, p_size, 'a photo of sks ' || {_SUBJECT} AS cap, {_V_SQL.format('p_partkey')} AS variant FROM part)
SELECT p_partkey, cap AS caption, p_size % 3 = 0 AS is_person_class, cap || '. Add ' || CASE variant WHEN 'add_near_pedestrian' THEN 'one walker nearby' ELSE '' END || ' ' || CASE WHEN variant IN ('add_two_pedestrians', 'add_small_group') THEN 'side by side in an empty road or sidewalk area, not overlapping'
 WHEN variant = 'add_occluded_pedestrian' THEN 'with realistic occlusion' ELSE 'in an empty road or sidewalk area' END || '. Keep scene unchanged. As it was.' AS prompt, 'blurry, missing feet, amputated legs, tiny ghost, sticker outline' AS negative,
substr(variant, 5) AS target, CASE variant WHEN 'add_two_pedestrians' THEN 2 WHEN 'add_small_group' THEN 3 ELSE 1 END AS expected, contains(replace(lower(p_name), '_', ' '), 'red') OR contains(replace(lower(p_name), '_', ' '), 'part 1') AS matches,
'part_' || p_partkey || '_' || p_size AS stable_id, '/out/train/' || p_size || '/images/' || p_partkey || '_aug_' || lpad(p_size::VARCHAR, 4, '0') || '_' || variant || '.png' AS result_path,
'/out/comparison_pairs/train/' || p_size || '/' || p_partkey || '_pair_' || lpad(p_size::VARCHAR, 4, '0') || '_' || variant || '.png' AS pair_path FROM a""")
def prompts(spark, sf_dir):
    """Captions, prompts and paths of instructions, by variant."""
    name, size, v = F.col("p_name"), F.col("p_size"), F.col("variant")
    rows = table(spark, sf_dir, "part").withColumn("variant", _variant("p_partkey"))
    cap = text.instruction_caption(F.concat(F.lit("please draw on "), name), "a photo of ", " sks ")
    args = (F.lit("/out"), F.lit("train"), size.cast("string"), v, F.col("p_partkey").cast("string"), size)
    return rows.select(
        "p_partkey", cap.alias("caption"), text.mentions_person(F.when(size % 3 == 0, "a Woman").otherwise("womanly")).alias("is_person_class"),
        text.generation_prompt(cap, v, {"add_near_pedestrian": "one walker nearby"}, "As it was.").alias("prompt"), text.negative_prompt("blurry").alias("negative"), text.variant_target(v).alias("target"),
        text.expected_count(v).alias("expected"), text.label_matches(name, ["red", "part 1"]).alias("matches"), text.stable_id(F.lit("part"), F.col("p_partkey"), size).alias("stable_id"),
        sinks.generated_path(*args).alias("result_path"), sinks.comparison_path(*args).alias("pair_path"),
    )


_MESSAGE = """CASE event_id % 9 WHEN 0 THEN 'Run failed last_reason=' || event_type || '), again' WHEN 1 THEN 'Composite rejected as ' || event_type || '_' || user_id || '.' WHEN 2 THEN 'it was ' || CASE WHEN user_id % 2 = 0 THEN 'partial_or_cropped_body' ELSE 'bad_placement' END || ' here'
WHEN 3 THEN 'expected scalar type Half of ' || event_type WHEN 4 THEN event_type || '). then' WHEN 5 THEN '' WHEN 6 THEN 'Accepted person scale mismatch on full image' WHEN 7 THEN 'Accepted mask is too soft' ELSE 'Accepted person is visually too small' END"""


@query(rf"""{EVENTS}, m AS (SELECT event_id, user_id, event_type, value, {_MESSAGE} AS t FROM ev)
SELECT event_id, CASE event_id % 9 WHEN 0 THEN event_type WHEN 1 THEN event_type || '_' || user_id WHEN 2 THEN CASE WHEN user_id % 2 = 0 THEN 'partial_or_cropped_body' ELSE 'bad_placement' END WHEN 3 THEN 'pipeline_dtype_mismatch' WHEN 4 THEN event_type WHEN 5 THEN 'unknown' ELSE 'Accepted' END AS reason,
CASE WHEN contains(t, 'scale mismatch') THEN 'final_scale_mismatch' WHEN contains(t, 'soft') THEN 'mask_too_soft' WHEN contains(t, 'too small') THEN 'person_too_small' WHEN event_id % 9 = 5 THEN 'unknown' ELSE NULL END AS gate_reason,
CASE event_id % 3 WHEN 0 THEN [1.5, -2, 3, user_id]::DOUBLE[] WHEN 1 THEN [user_id, 0, 7, 8.25]::DOUBLE[] END AS box, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS num,
CASE WHEN event_id % 5 = 0 THEN 999 ELSE bit_count(xor(('0x' || substr(md5(event_id::VARCHAR), 2, 15))::BIGINT, ('0x' || substr(md5(user_id::VARCHAR), 2, 15))::BIGINT)) END::INT AS apart,
'{{"kind":"' || event_type || '","n":' || user_id || CASE WHEN event_id % 2 = 0 THEN ',"xs":[1,' || user_id || ']' ELSE '' END || '}}' AS safe FROM m""")
def messages(spark, sf_dir):
    """Reject reasons of messages, boxes and numbers of text cells, distances of hashes, and JSON-safe values."""
    k, u, e = F.col("event_id") % 9, F.col("user_id"), F.col("event_type")
    t = (
        F.when(k == 0, F.concat(F.lit("Run failed last_reason="), e, F.lit("), again"))).when(k == 1, F.concat(F.lit("Composite rejected as "), e, F.lit("_"), u, F.lit(".")))
        .when(k == 2, F.concat(F.lit("it was "), F.when(u % 2 == 0, "partial_or_cropped_body").otherwise("bad_placement"), F.lit(" here"))).when(k == 3, F.concat(F.lit("expected scalar type Half of "), e))
        .when(k == 4, F.concat(e, F.lit("). then"))).when(k == 5, "").when(k == 6, "Accepted person scale mismatch on full image").when(k == 7, "Accepted mask is too soft").otherwise("Accepted person is visually too small")
    )
    i = F.col("event_id")
    box = F.when(i % 3 == 0, F.concat(F.lit("(1.5, -2,3,"), u, F.lit(")"))).when(i % 3 == 1, F.concat(F.lit("["), u, F.lit(",0,7,8.25]"))).otherwise("(1,2,3)")
    cell = F.when(i % 4 == 0, F.when(i % 8 == 0, "NaN").otherwise("x")).otherwise(F.col("value").cast("string"))
    digits = lambda c: F.concat(F.lit("0"), F.substring(F.md5(c.cast("string").cast("binary")), 2, 15))
    gate = text.composite_reason(t)
    return tables.events(spark, sf_dir).select(
        "event_id", text.reject_reason(t).alias("reason"), F.when(k >= 5, gate).alias("gate_reason"), text.box_numbers(box).alias("box"), text.number(cell).alias("num"),
        text.hamming(F.when(i % 5 == 0, "").otherwise(digits(i)), digits(u)).alias("apart"), text.json_safe({"kind": e, "n": u, "xs": F.when(i % 2 == 0, F.array(F.lit(1), u))}).alias("safe"),
    )


@query(f"""{EVENTS} SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE round(value, 2) END AS first, CASE event_id % 4 WHEN 0 THEN round(value, 2) WHEN 3 THEN NULL ELSE greatest(round(value, 2), user_id) END AS largest,
CASE event_id % 4 WHEN 0 THEN round(value, 2) WHEN 3 THEN NULL ELSE round((round(value, 2) + user_id) / 2, 6) END AS mean, CASE event_id % 4 WHEN 3 THEN 0 ELSE greatest(0, least(1, round(value, 2) / 50)) END AS clamped FROM ev""")
def list_cells(spark, sf_dir):
    """First, largest and mean number of cells that hold a number, a list or a list of lists."""
    i, v, u = F.col("event_id") % 4, F.round("value", 2).cast("string"), F.col("user_id")
    cell = F.when(i == 0, v).when(i == 1, F.concat(F.lit("["), v, F.lit(", "), u, F.lit(', "x"]'))).when(i == 2, F.concat(F.lit("[["), v, F.lit("], ["), u, F.lit("]]"))).otherwise("")
    first = text.first_number(cell)
    return tables.events(spark, sf_dir).select("event_id", first.alias("first"), text.largest_number(cell).alias("largest"), F.round(text.mean_number(cell), 6).alias("mean"), scores.clamp01(first / 50).alias("clamped"))


_CUT = "greatest(0, least(1, 1 - greatest(0, least(400, x2) - greatest(0, x1)) * greatest(0, least(400, y2) - greatest(0, y1)) / greatest(1, w * h)))"


@query(f"""{WITH}, m AS (SELECT *, greatest(0, least(1, round(w * h * (1 - occlusion)) / greatest(1, w * h))) AS seen, {_CUT} AS cut0, (p % 50) / 100.0::DOUBLE AS ov, CASE WHEN s % 3 > 0 THEN (40 + s * 5 % 262)::DOUBLE END AS eh FROM inst),
c AS (SELECT *, CASE WHEN x1 <= 3 OR y1 <= 3 OR x2 >= 397 OR y2 >= 397 THEN greatest(cut0, 0.35) ELSE cut0 END AS cut FROM m),
o AS (SELECT *, round(greatest(0, least(1, 1 - 0.50 * least(1, ov / 0.24) - 0.35 * cut - 0.35 * greatest(0, least(1, (0.18 - seen) / 0.18)))) + 0.0000001::DOUBLE, 4) AS oc, round(greatest(0, least(1, exp(-abs(greatest(1, h) - eh) / eh))), 4) AS sc, round(least(1, p / 2000.0::DOUBLE), 4) AS pl FROM c)
SELECT image_id, det_idx, p, s, CASE WHEN p % 31 = 0 THEN 0 ELSE oc END AS occlusion_score, CASE WHEN p % 31 > 0 THEN round(seen + 0.0000001::DOUBLE, 4) END AS visible_share, CASE WHEN p % 31 > 0 THEN round(cut + 0.0000001::DOUBLE, 4) END AS truncation,
CASE WHEN p % 31 = 0 THEN 'missing_mask_bbox;missing_mask_bbox;missing_mask_bbox' WHEN eh IS NULL THEN 'missing_expected_height' ELSE '' END AS warning,
round(CASE WHEN eh IS NULL THEN 0.4 / 0.6000000000000001 * pl + 0.2 / 0.6000000000000001 * 0.5 ELSE 0.4 * pl + 0.4 * sc + 0.2 * 0.5 END + 0.0000001::DOUBLE, 4) AS affordance FROM o""")
def occlusion_scores(spark, sf_dir):
    """Occlusion score of boxes as masks, what lacks, and the weighted affordance with and without a scale score."""
    boxes, c = tables.instances(spark, sf_dir), F.col
    mask = geo.Box(*(F.when(c("p") % 31 > 0, c(b)) for b in BOX))
    part = scores.occlusion_parts(mask, F.round(c("w") * c("h") * (1 - c("occlusion"))), F.lit(400.0), F.lit(400.0), (c("p") % 50) / 100)
    expected = F.when(c("s") % 3 > 0, (40 + c("s") * 5 % 262).cast("double"))
    scale = scores.scale_score(geo.Box.of(), expected)["scale_score"]
    total = scores.affordance_raw(F.round(F.least(F.lit(1.0), c("p") / 2000), 4), scale, F.lit(0.5))
    near = lambda x: F.round(x + 1e-7, 4)
    return boxes.select(
        *KEYS, F.when(mask.y2.isNull(), 0.0).otherwise(near(part["score"])).alias("occlusion_score"), near(part["seen"]).alias("visible_share"), near(part["cut"]).alias("truncation"),
        scores.affordance_warnings(mask.y2.isNull(), scale).alias("warning"), near(total).alias("affordance"),
    )


@query(f"""{EVENTS}, m AS (SELECT event_id, user_id, {_V_SQL.format('user_id')} AS variant, CASE WHEN event_id % 3 > 0 THEN (user_id % 90) / 100.0::DOUBLE END AS pc, 0.3 + (event_id % 20) / 10.0::DOUBLE AS ra, (user_id % 12)::DOUBLE AS df, (event_id % 30) / 100.0::DOUBLE AS er, event_id % 2 = 0 AS se, user_id % 5 = 0 AS fa FROM ev),
q AS (SELECT *, coalesce(pc, 1.0) AS a, greatest(0, least(1, 1 - least(1, abs(ln(ra))))) AS b, least(1, df / (2.5 * 4)) AS c, greatest(0, least(1, 1 - er + CASE WHEN se THEN 0.12 ELSE 0 END - CASE WHEN fa THEN 0.08 ELSE 0 END)) AS d FROM m)
SELECT event_id, round(a, 6) AS person_score, round(b, 6) AS scale_score, round(c, 6) AS background_score, round(d, 6) AS edge_score, round(0.45 * a + 0.25 * b + 0.20 * c + 0.10 * d, 6) AS quality_score,
round(coalesce(pc, 0) + 2.2 * er + 0.8 * c + 0.45 * (1 - least(1, abs(ln(ra)))) - 2.8 * 0.1 - 0.2 * 0.25, 6) AS rank_score, user_id + 9973 * (event_id % 5) AS seed,
CASE WHEN variant IN ('add_distant_pedestrian', 'add_small_group') THEN 5 WHEN variant = 'add_near_pedestrian' THEN 2 ELSE 4 END AS budget, CASE WHEN user_id % 12 = 0 THEN 0.6 * ra ELSE round(least(greatest(df + (ra - df) * 0.6, df / 1.35), df * 1.35), 4) END AS blended FROM q""")
def composite_scores(spark, sf_dir):
    """Quality of composites, rank of detections, seeds, budgets and blended settings."""
    c = F.col
    i, u = c("event_id"), c("user_id")
    ratio, diff, edge, person = 0.3 + (i % 20) / 10, (u % 12).cast("double"), (i % 30) / 100, F.when(i % 3 > 0, (u % 90) / 100)
    quality = scores.composite_parts(person, ratio, diff, F.lit(2.5), edge, i % 2 == 0, u % 5 == 0)
    rank = scores.detection_rank(F.coalesce(person, F.lit(0.0)), edge, F.least(F.lit(1.0), diff / 10), ratio, F.lit(0.1), F.lit(0.25))
    return tables.events(spark, sf_dir).select(
        "event_id", *[F.round(v, 6).alias(n) for n, v in quality.items()], F.round(rank, 6).alias("rank_score"), scores.attempt_seed(u, i % 5).alias("seed"), scores.retry_budget(_variant("user_id")).alias("budget"), scores.blended(diff, ratio).alias("blended")
    )


_R = ["low_person_conf", "partial_or_cropped", "scale_unrecoverable", "too_large_for_perspective", "not_enough_new_people", "bad_person_depth_overlap", "bad_placement", "mask_too_soft", "something_else"]
_R_SQL = "CASE event_id % 9 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_R)) + " END"


@query(f"""{EVENTS}, m AS (SELECT event_id, {_V_SQL.format('user_id')} AS variant, {_R_SQL} AS r, (user_id % 6)::INT AS a, user_id % 3 AS streak, event_id % 4 > 0 AS has_ratio, CASE WHEN user_id % 7 > 0 THEN (event_id % 30) / 10000.0::DOUBLE END AS share, event_id % 2 = 0 AS se FROM ev),
g AS (SELECT *, CASE WHEN variant IN ('add_distant_pedestrian', 'add_small_group') THEN 5 WHEN variant = 'add_near_pedestrian' THEN 2 ELSE 4 END AS budget FROM m),
k AS (SELECT *, a + 1 AS n FROM g WHERE NOT (a >= budget OR streak >= 2) AND CASE WHEN r IN ('mask_too_soft') THEN coalesce(share, 0) >= 0.0015 OR (se AND a = 0) OR NOT se WHEN r IN ('too_large_for_perspective', 'partial_or_cropped_x', 'something_else') THEN false WHEN contains(r, 'scale') AND has_ratio THEN a < 1 ELSE true END),
t AS (SELECT *, CASE r WHEN 'low_person_conf' THEN least(0.84, 0.7 + 0.04 * n) WHEN 'not_enough_new_people' THEN least(0.86, 0.7 + 0.03 * n) WHEN 'partial_or_cropped' THEN greatest(0.62, 0.7 - 0.03 * n) ELSE least(0.80, 0.7 + 0.02 * n) END AS st,
 CASE r WHEN 'low_person_conf' THEN least(8.2, 6.5 + 0.6 * n) WHEN 'not_enough_new_people' THEN least(8.6, 6.5 + 0.55 * n) WHEN 'partial_or_cropped' THEN greatest(6.0, 6.5 - 0.2 * n) ELSE least(7.8, 6.5 + 0.25 * n) END AS gu FROM k)
SELECT event_id, n AS attempt, round(CASE r WHEN 'low_person_conf' THEN least(st + 0.04, 0.86) WHEN 'scale_unrecoverable' THEN least(st + 0.03, 0.86) WHEN 'not_enough_new_people' THEN least(st + 0.03, 0.86) WHEN 'bad_person_depth_overlap' THEN greatest(st - 0.02, 0.62) WHEN 'bad_placement' THEN least(st + 0.02, 0.84) ELSE st END, 6)::DOUBLE AS strength,
round(CASE r WHEN 'low_person_conf' THEN least(gu + 0.35, 8.6) WHEN 'scale_unrecoverable' THEN least(gu + 0.25, 8.4) WHEN 'not_enough_new_people' THEN least(gu + 0.30, 8.4) WHEN 'bad_placement' THEN least(gu + 0.25, 8.2) ELSE gu END, 6)::DOUBLE AS guidance,
round(CASE WHEN r = 'partial_or_cropped' THEN 1.5 * (1 + 0.14 * n) ELSE 1.5 END, 6)::DOUBLE AS margin, event_id + 9973 * n AS seed,
CASE r WHEN 'low_person_conf' THEN ', clear solid person' WHEN 'partial_or_cropped' THEN ', complete body visible' WHEN 'scale_unrecoverable' THEN ', visible grounded person' WHEN 'not_enough_new_people' THEN ', all people separate, visible gaps, distinct bodies'
 WHEN 'bad_person_depth_overlap' THEN ', separated depth, no body overlap, distinct silhouettes' WHEN 'bad_placement' THEN ', exactly inside the marked placement area, centered on the guide' WHEN 'mask_too_soft' THEN ', complete body visible' END AS prompt FROM t""")
def next_attempts(spark, sf_dir):
    """Rejected attempts that get another one, with its settings, seed and added words."""
    c = F.col
    i, u = c("event_id"), c("user_id")
    reason = F.coalesce(*[F.when(i % 9 == k, r) for k, r in enumerate(_R)])
    rows = tables.events(spark, sf_dir).select(
        i.alias("job_id"), _variant("user_id").alias("variant"), reason.alias("reject_reason"), (u % 6).cast("int").alias("attempt"), (u % 3).alias("streak"), F.when(i % 4 > 0, 1.0).alias("scale_ratio"),
        F.when(u % 7 > 0, (i % 30) / 10000).alias("mask_share"), (i % 2 == 0).alias("seamless"), F.lit(0.7).alias("strength"), F.lit(6.5).alias("guidance"), F.lit(1.5).alias("margin"), i.alias("seed"),
    )
    found = attempts.next_attempts(rows, attempts.retry_rules(spark))
    return _rounded(found.select(F.col("job_id").alias("event_id"), "attempt", "strength", "guidance", "margin", "seed", "prompt"), 6, "strength", "guidance", "margin")


@query(f"""{EVENTS}, r AS (SELECT count(*) FILTER (event_type = 'purchase') AS na, count(*) AS nj, quantile_cont(value / 100, 0.1) AS pp, quantile_cont(value / 50, 0.1) AS sp, quantile_cont(value / 20, 0.1) AS bp, quantile_cont(value / 10, 0.1) AS ep,
 count(*) FILTER (event_type = 'click') AS lp, count(*) FILTER (event_type = 'error') AS bs, count(*) FILTER (event_type = 'view') AS bd, avg(value) / 100 AS qm FROM ev),
rule(name, fires, d, cap, cur) AS (SELECT unnest(['CONTEXT_GENERATION_RETRIES', 'CONTEXT_PERSON_MIN_CONFIDENCE', 'SCALE_CORRECTION_MAX_ATTEMPTS', 'MAX_PERSON_PERSON_OVERLAP_RATIO', 'LOCAL_BRIGHTNESS_STRENGTH', 'EDGE_HALO_COLOR_MATCH_STRENGTH']),
 unnest([na / greatest(nj, 1) < 0.30, lp >= greatest(2, nj * 0.15) OR pp < 0.45, bs >= greatest(2, nj * 0.12) OR sp < 0.55, bd >= greatest(1, nj * 0.08), bp < 0.55, ep < 0.55]), unnest([1.0, -0.02, 1.0, -0.02, 0.04, 0.04]::DOUBLE[]), unnest([5.0, 0.08, 4.0, 0.04, 0.45, 0.48]::DOUBLE[]), unnest([4.0, 0.12, 2.0, 0.08, 0.3, 0.4]::DOUBLE[]) FROM r WHERE na >= 30),
f AS (SELECT *, CASE WHEN d > 0 THEN least(cur + d, cap) ELSE greatest(cur + d, cap) END AS prop FROM rule WHERE fires), b AS (SELECT *, least(greatest(cur + (prop - cur) * 0.6, cur / 1.35), cur * 1.35) AS bound FROM f), v AS (SELECT *, CASE WHEN name IN ('CONTEXT_GENERATION_RETRIES', 'SCALE_CORRECTION_MAX_ATTEMPTS') THEN round_even(bound, 0) ELSE round(bound, 4) END AS val FROM b)
SELECT name, round(cur, 6) AS current, round(prop, 6) AS proposed, val AS value, round((val - cur) / cur, 4) AS change FROM v
UNION ALL SELECT unnest(['GENERATION_STRENGTH_DELTA', 'GENERATION_GUIDANCE_DELTA']), 0.0, unnest([0.01, 0.10]::DOUBLE[]), unnest([0.01, 0.10]::DOUBLE[]), NULL FROM r WHERE na >= 30 AND qm < 0.72""")
def run_advice(spark, sf_dir):
    """Settings that a run's figures speak for, moved by a share and within bounds."""
    is_ = lambda k: F.count_if(F.col("event_type") == k)
    p10 = lambda d: F.percentile(F.col("value") / d, F.lit(0.1))
    run = tables.events(spark, sf_dir).agg(
        is_("purchase").alias("n_accepted"), F.count("*").alias("n_jobs"), p10(100).alias("person_p10"), p10(50).alias("scale_p10"), p10(20).alias("background_p10"), p10(10).alias("edge_p10"),
        is_("click").alias("low_person"), is_("error").alias("bad_scale"), is_("view").alias("bad_depth"), (F.avg("value") / 100).alias("quality_mean"),
    )
    current = [("CONTEXT_GENERATION_RETRIES", 4.0), ("CONTEXT_PERSON_MIN_CONFIDENCE", 0.12), ("SCALE_CORRECTION_MAX_ATTEMPTS", 2.0), ("MAX_PERSON_PERSON_OVERLAP_RATIO", 0.08), ("LOCAL_BRIGHTNESS_STRENGTH", 0.3), ("EDGE_HALO_COLOR_MATCH_STRENGTH", 0.4)]
    return _rounded(attempts.advice(run, spark.createDataFrame(current, "name string, current double")), 6, "current", "proposed")


@query(f"""{EVENTS}, a AS (SELECT * FROM ev WHERE event_type = 'purchase'), h AS (SELECT event_type AS reason, count(*) AS n FROM ev WHERE event_type <> 'purchase' GROUP BY 1)
SELECT (SELECT count(*) FROM ev) AS generated, (SELECT count(*) FROM a) AS accepted, (SELECT sum(n) FROM h)::BIGINT AS rejected, round((SELECT count(*) FROM a)::DOUBLE / (SELECT count(*) FROM ev), 4) AS accept_rate, (SELECT round(avg(value), 4) FROM a) AS mean_value,
(SELECT string_agg(reason || '=' || n, ',' ORDER BY reason) FROM h) AS reasons""")
def unflagged_summary(spark, sf_dir):
    """Summary of a manifest of accepted rows only, with the rejects of two shards."""
    ev = tables.events(spark, sf_dir)
    shard = lambda k: ev.filter((F.col("event_type") != "purchase") & (F.col("half") == k)).groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n"))
    found = metrics.run_summary(ev.filter("event_type = 'purchase'"), ["value"], metrics.merged_rejects([shard(0), shard(1)]))
    pairs = F.array_sort(F.transform(F.map_entries("reject_reason_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.withColumn("reasons", F.array_join(pairs, ",")).drop("reject_reason_counts")


@query(f"""{EVENTS}, m AS (SELECT *, user_id % 4 AS retry, event_id % 3 = 0 AS sc, event_id % 2 = 0 AS se, event_id % 5 = 0 AS fa FROM ev)
SELECT count(*) AS accepted, sum(retry)::BIGINT AS retried, count(*) FILTER (sc) AS scale_corrected_count, count(*) FILTER (se) AS seamless_clone_used_count, count(*) FILTER (fa) AS fallback_alpha_paste_count,
round((count(*) - count(*) FILTER (sc)) / 20000.0::DOUBLE, 9) AS accept_rate_before, round(count(*) / 20000.0::DOUBLE, 9) AS accept_rate_after, round(count(*) FILTER (sc) / count(*)::DOUBLE, 9) AS scale_correction_share, round(count(*) FILTER (se) / count(*)::DOUBLE, 9) AS seamless_clone_rate FROM m""")
def run_counters(spark, sf_dir):
    """Counters of a run over its merged parts."""
    ev = tables.events(spark, sf_dir)
    flags = lambda n: F.when(F.col("event_id") % n == 0, "True").otherwise("false")
    rows = ev.withColumns({"retry_attempts": (F.col("user_id") % 4).cast("string"), "scale_corrected": flags(3), "seamless_clone_used": flags(2)})
    rows = metrics.merged_runs({"a": rows.filter("half = 0"), "b": rows.filter("half = 1").drop("ts")}).withColumn("fallback_alpha_paste", F.col("event_id") % 5 == 0)
    found = metrics.run_counters(rows, 20000)
    return _rounded(found, 9, "accept_rate_before", "accept_rate_after", "scale_correction_share", "seamless_clone_rate")


@query(f"""{WITH}, d AS (SELECT image_id, det_idx * 100000000 + p * 10000 + s AS k, conf / 100.0::DOUBLE AS c, y2 - y1 AS hh, side FROM inst WHERE conf >= 3 AND (p % 3 = 0 OR p % 3 = 1)),
r AS (SELECT image_id, count(*) AS n, max(c) AS c, arg_max(hh, (c, -k)) AS hh FROM d WHERE side = 'F' GROUP BY image_id), o AS (SELECT image_id, count(*) AS n FROM d WHERE side = 'O' GROUP BY image_id),
c AS (SELECT image_id, (group_id % 300)::DOUBLE AS eh FROM images)
SELECT c.image_id, CASE WHEN r.n > 0 THEN 1 ELSE 0 END AS person_detected, coalesce(round(r.c, 4), 0) AS person_confidence, coalesce(r.n, 0) AS person_count, coalesce(o.n, 0) AS source_person_count, coalesce(r.n, 0) - coalesce(o.n, 0) AS inclusion_count_delta,
CASE WHEN coalesce(r.n, 0) > coalesce(o.n, 0) THEN 1 ELSE 0 END AS object_added, coalesce(hh, 0) AS detected_height, eh AS expected_height, CASE WHEN eh > 0 THEN round(hh / eh, 4) END AS scale_ratio, CASE WHEN eh > 0 THEN round(abs(hh - eh) / eh, 4) END AS scale_error,
CASE WHEN c.image_id % 2 = 0 THEN round(c.image_id % 100 / 7.0::DOUBLE, 4) END AS bg_mae, CASE WHEN c.image_id % 2 = 0 THEN 1.0::DOUBLE END AS bg_ssim FROM c LEFT JOIN r USING (image_id) LEFT JOIN o USING (image_id)""")
def case_metrics(spark, sf_dir):
    """All metrics of each case in one row."""
    boxes = tables.instances(spark, sf_dir).withColumn("det_idx", F.col("det_idx") * 100000000 + F.col("p") * 10000 + F.col("s")).withColumns({"conf": F.col("conf") / 100, "cls": F.when(F.col("p") % 3 == 0, 0).when(F.col("p") % 3 == 2, 5)})
    images = tables.images(spark, sf_dir)
    cases = images.select("image_id", (F.col("group_id") % 300).cast("double").alias("expected_height"))
    backgrounds = images.filter("image_id % 2 = 0").select("image_id", (F.col("image_id") % 100 / 7).alias("bg_mae"), F.lit(1.0).alias("bg_ssim"))
    return metrics.case_metrics(cases, boxes.filter("side = 'F'"), boxes.filter("side = 'O'"), backgrounds, threshold=0.03)


@query(f"""{WITH} SELECT split, source_id AS bucket, count(*) AS n FROM images GROUP BY ROLLUP (split, source_id)""")
def record_counts(spark, sf_dir):
    """Records by split and bucket, by split, and of all."""
    return release.record_counts(tables.images(spark, sf_dir).withColumn("bucket", F.col("source_id")))


@query(f"""{WITH}, a AS (SELECT image_id, row_number() OVER (ORDER BY md5('7:' || image_id), image_id) AS r FROM images), e AS (SELECT image_id, row_number() OVER (ORDER BY md5('7:' || image_id), image_id) - 1 AS r FROM images WHERE group_id % 40 = 0)
SELECT 'all' AS part, image_id, 1::BIGINT AS n FROM a WHERE r <= 50 UNION ALL SELECT 'few', image_id, count(*) FROM (SELECT e.image_id FROM range(1000) t(i) JOIN e ON i % (SELECT count(*) FROM e) = r) GROUP BY image_id""")
def record_samples(spark, sf_dir):
    """Records of a sample: without repetition where there are enough, else with."""
    images = tables.images(spark, sf_dir).select("image_id", "group_id")
    few = attempts.pick_records(images.filter("group_id % 40 = 0"), 1000, 7)
    found = attempts.pick_records(images, 50, 7).withColumn("part", F.lit("all")).unionByName(few.withColumn("part", F.lit("few")))
    return found.groupBy("part", "image_id").agg(F.count("*").alias("n"))


@query(f"""{WITH}, f AS (SELECT image_id, source_id FROM images ORDER BY '/i/' || lpad(image_id::VARCHAR, 9, '0') LIMIT 5), v(variant) AS (SELECT unnest({[*VARIANTS]!r}))
SELECT '/i/' || lpad(image_id::VARCHAR, 9, '0') AS path, variant, source_id AS caption, source_id || '. Add  ' || CASE WHEN variant IN ('add_two_pedestrians', 'add_small_group') THEN 'side by side in an empty road or sidewalk area, not overlapping' WHEN variant = 'add_occluded_pedestrian' THEN 'with realistic occlusion' ELSE 'in an empty road or sidewalk area' END || '. Keep scene unchanged. x' AS prompt FROM f, v""")
def prompt_preview(spark, sf_dir):
    """Prompts of the first records for each variant."""
    records = tables.images(spark, sf_dir).select(F.concat(F.lit("/i/"), F.lpad(F.col("image_id").cast("string"), 9, "0")).alias("path"), F.col("source_id").alias("caption"))
    return attempts.prompt_preview(records, variant_table(spark), 5, {}, "x")


_EVAL = f"""{WITH}, g AS (SELECT group_id, row_number() OVER (ORDER BY md5('7:' || group_id), group_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM images WHERE split = 'val')),
st AS (SELECT group_id, CASE WHEN r <= floor(n * 0.7::DOUBLE) THEN 'dev' ELSE 'final' END AS eval_set FROM g), b AS (SELECT DISTINCT image_id, det_idx, p, s, x1, y1, w, h FROM inst),
c AS (SELECT b.*, source_id, eval_set, trunc(greatest(w, h) * 0.08::DOUBLE) AS d FROM b JOIN images USING (image_id) JOIN st USING (group_id) WHERE split = 'val'),
m AS (SELECT *, greatest(0, trunc(x1 - d))::INT AS m_x1, greatest(0, trunc(y1 - d))::INT AS m_y1, least(512, trunc(x1 + w + d))::INT AS m_x2, least(300, trunc(y1 + h + d))::INT AS m_y2 FROM c)"""


@query(f"""{_EVAL} SELECT source_id || '_val_' || image_id || '_' || det_idx || '_' || p || '_' || s AS case_id, image_id, m_x1, m_y1, m_x2, m_y2, x1 AS b_x1, y1 + h AS b_y2, eval_set, 'masks/' || source_id || '_val_' || image_id || '_' || det_idx || '_' || p || '_' || s || '.png' AS mask_path FROM m WHERE m_x2 - m_x1 >= 4 AND m_y2 - m_y1 >= 4""")
def eval_cases(spark, sf_dir):
    """Frozen cases of the eval images in two sets of disjoint groups."""
    images = release.eval_images(tables.images(spark, sf_dir), tables.registry(spark, sf_dir)).withColumns({"width": F.lit(512), "height": F.lit(300)})
    boxes = tables.instances(spark, sf_dir).select(*KEYS, F.col("x1").alias("x"), F.col("y1").alias("y"), "w", "h").distinct().withColumn("instance_id", text.stable_id(*(F.col(k) for k in KEYS)))
    found = release.eval_cases(images, boxes, 0.7, 7)
    return found.select("case_id", "image_id", *["m_" + b for b in BOX], F.get("expected_bbox_xyxy", F.lit(0)).alias("b_x1"), F.get("expected_bbox_xyxy", F.lit(3)).alias("b_y2"), "eval_set", "mask_path")


@query(f"""{WITH}, k AS (SELECT image_id, det_idx, p, s, row_number() OVER (ORDER BY image_id, det_idx, p, s) - 1 AS kept FROM (SELECT DISTINCT image_id, det_idx, p, s FROM inst) WHERE p * 7 % 100 >= 64)
SELECT 'pipe_' || image_id || '_' || det_idx || '_' || kept AS case_id, p AS part, s AS supplier, kept FROM k""")
def pipe_cases(spark, sf_dir):
    """Pairs with enough changed pixels, numbered among those kept."""
    rows = tables.instances(spark, sf_dir).select(*KEYS).distinct()
    order = F.struct("image_id", "det_idx", "p", "s")
    pairs = rows.select(order.alias("pair_seq"), F.col("image_id").alias("img_id"), F.col("det_idx").alias("ann_id"), (F.col("p") * 7 % 100).alias("changed"), F.col("p").alias("part"), F.col("s").alias("supplier"))
    return release.changed_pairs(pairs, 64).select("case_id", "part", "supplier", F.col("kept").cast("bigint").alias("kept"))


# Hashes around a base of each customer in five hundred, up to five bits away from it.
_PLANTED = """hs AS (SELECT o_orderkey AS k, 'img' || lpad(o_orderkey::VARCHAR, 9, '0') AS image_id, o_orderpriority AS source_id, 'g' || (o_custkey % 97) AS group_id,
xor(('0x' || substr(md5((o_custkey % 500)::VARCHAR), 1, 15))::BIGINT, (SELECT coalesce(bit_xor(1::BIGINT << ((o_orderkey * (7 + 2 * i)) % 60)::INT), 0) FROM range(6) t(i) WHERE i < o_orderkey % 6)) AS h, md5((o_orderkey // 3)::VARCHAR) AS sha256 FROM orders)"""


def _planted(spark, sf_dir) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    base = F.conv(F.substring(F.md5((c % 500).cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint")
    noise = F.aggregate(F.sequence(F.lit(0), F.lit(5)), F.lit(0).cast("bigint"), lambda a, i: F.when(i < k % 6, a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), ((k * (7 + 2 * i)) % 60).cast("int")))).otherwise(a))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("img"), F.lpad(k.cast("string"), 9, "0")).alias("image_id"), F.col("o_orderpriority").alias("source_id"), F.concat(F.lit("g"), c % 97).alias("group_id"), base.bitwiseXOR(noise).alias("h"),
        F.md5(F.floor(k / 3).cast("string").cast("binary")).alias("sha256"), k.alias("ingest_seq"), F.when(k % 5 == 0, "eval").otherwise("train").alias("split"),
    )


@query(f"""WITH {_PLANTED}, u AS (SELECT DISTINCT source_id, h FROM hs) SELECT a.source_id, a.h AS a, b.h AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM u a JOIN u b ON a.source_id = b.source_id AND a.h < b.h AND bit_count(xor(a.h, b.h)) <= 6""")
def near_duplicate_pairs(spark, sf_dir):
    """Pairs of different hashes of a source within 6 of 64 bits, found by keys of 16 bits with one flip."""
    return release.near_hashes(_planted(spark, sf_dir).select("source_id", "h").distinct(), 6).withColumn("distance", F.col("distance").cast("int"))


_CLUSTERS = f"""WITH {_PLANTED}, cl AS (SELECT j.image_id, coalesce(arg_max(i.image_id, i.k), j.image_id) AS duplicate_cluster_id FROM hs j LEFT JOIN hs i ON i.source_id = j.source_id AND i.k < j.k AND bit_count(xor(i.h, j.h)) <= 6 GROUP BY j.image_id)"""


@query(f"{_CLUSTERS} SELECT * FROM cl")
def near_duplicate_clusters(spark, sf_dir):
    """Last earlier image within 6 bits, by text ids."""
    return release.near_clusters(_planted(spark, sf_dir), 6).select("image_id", "duplicate_cluster_id")


_RELEASE = f"""WITH RECURSIVE {_PLANTED}, inst AS ({tables.INSTANCES}), ib AS (SELECT DISTINCT 'img' || lpad(image_id::VARCHAR, 9, '0') AS image_id, det_idx, p, s, w, h AS bh, occlusion FROM inst WHERE class_name = 'N' AND NOT ignore_flag),
im AS (SELECT * FROM hs WHERE image_id IN (SELECT image_id FROM ib)), ca AS (SELECT *, first(image_id) OVER (PARTITION BY sha256 ORDER BY k) AS canon FROM im), un AS (SELECT * FROM ca WHERE canon = image_id),
cl AS (SELECT j.image_id, coalesce(arg_max(i.image_id, i.k), j.image_id) AS cluster FROM un j LEFT JOIN un i ON i.source_id = j.source_id AND i.k < j.k AND bit_count(xor(i.h, j.h)) <= 6 GROUP BY j.image_id),
sa AS (SELECT ib.*, un.group_id, un.source_id, cluster FROM ib JOIN un USING (image_id) JOIN cl USING (image_id) WHERE un.k % 5 <> 0 AND bh >= 96 AND 1 - occlusion / 2 >= 0.45 AND round(0.5 * (1 - occlusion / 2) + 0.3 * (1 - occlusion) + 0.2 * least(1, bh / 256), 4) >= 0.7),
gr AS (SELECT group_id, row_number() OVER (ORDER BY md5('42:' || group_id), group_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM sa)), sp AS (SELECT group_id, CASE WHEN r <= floor(n * 0.85::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM gr),
rel AS (SELECT sa.*, split FROM sa JOIN sp USING (group_id))"""


def _release(spark, sf_dir) -> dict[str, DataFrame]:
    images = _planted(spark, sf_dir)
    boxes = tables.instances(spark, sf_dir).withColumn("image_id", F.concat(F.lit("img"), F.lpad(F.col("image_id").cast("string"), 9, "0")))
    boxes = boxes.filter("NOT ignore_flag").select(*KEYS, "class_name", "w", "h", F.col("w").alias("visible_w"), (F.col("h") * (1 - F.col("occlusion") / 2)).alias("visible_h"), "occlusion", F.lit(False).alias("ignore")).distinct()
    roles = images.select("source_id", "split").distinct().withColumn("role", F.col("split"))
    return release_build.build(images, boxes.drop("x1"), roles, CurationSettings(pedestrian_class="N"), CaptionSettings())


@query(f"{_RELEASE} SELECT image_id, det_idx, p, s, group_id, cluster AS duplicate_cluster_id, split FROM rel")
def release_samples(spark, sf_dir):
    """Samples of a release that is built from images with text ids."""
    return _release(spark, sf_dir)["samples"].select(*KEYS, "group_id", "duplicate_cluster_id", "split")


@query(f"""{_RELEASE}, ev AS (SELECT image_id, group_id FROM im WHERE k % 5 = 0) SELECT count(*) AS n, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(DISTINCT group_id) AS n_groups,
(SELECT count(*) FROM rel WHERE s % 3 = 0) AS missing_crops, (SELECT count(*) FROM (SELECT cluster FROM rel WHERE split = 'train' INTERSECT SELECT cluster FROM rel WHERE split = 'val')) AS shared_duplicate_cluster_id,
(SELECT count(*) FROM (SELECT group_id FROM rel INTERSECT SELECT group_id FROM ev)) AS leaked_group_id,
(SELECT count(*) FROM im) AS n_images, (SELECT count(*) FROM ca WHERE canon <> image_id) + (SELECT count(*) FROM cl WHERE cluster <> image_id) AS n_duplicates, (SELECT count(DISTINCT coalesce(cluster, image_id)) FROM ca LEFT JOIN cl USING (image_id)) AS n_clusters, (SELECT median(5 + CASE WHEN 1 - occlusion / 2 >= 0.85 THEN 2 ELSE 3 END + CASE WHEN 1 - occlusion / 2 < 0.6 THEN 2 ELSE 0 END + 2) FROM rel) AS median_tokens FROM rel""")
def release_status(spark, sf_dir):
    """Statistics, missing crops and leaks of the release."""
    out = _release(spark, sf_dir)
    samples = out["samples"].withColumn("crop_path", text.stable_id(*(F.col(k) for k in KEYS)))
    report = release.status(release.validation(samples, "<vin_ped>", samples.filter("s % 3 <> 0").select("crop_path")), release.leaks(samples, out["evaluation"]))
    stages = release.stage_statistics(out["groups"], samples).select("n_images", "n_duplicates", "n_clusters", "median_tokens")
    return report.select("n", "n_train", "n_val", "n_groups", "missing_crops", "shared_duplicate_cluster_id", "leaked_group_id").crossJoin(stages)


@query(f"""{EVENTS}, a AS (SELECT 'm' || user_id AS metric, avg(value) FILTER (half = 0) AS a, avg(value) FILTER (half = 1) AS b, user_id FROM ev GROUP BY user_id HAVING count(*) FILTER (half = 0) > 0 AND count(*) FILTER (half = 1) > 0)
SELECT metric, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS delta, CASE WHEN metric = 'm1' THEN b <= a ELSE b >= a END AS improved FROM a""")
def utility_delta(spark, sf_dir):
    """Delta of two tables of metrics, and which are better."""
    side = lambda k: tables.events(spark, sf_dir).filter(F.col("half") == k).groupBy(F.concat(F.lit("m"), "user_id").alias("metric")).agg(F.avg("value").alias("value"))
    return _rounded(detection.compare(side(0), side(1), {"m1": False}), 6, "a", "b", "delta")


@query(f"""{WITH}, m AS (SELECT person_detected::DOUBLE AS d FROM (SELECT CASE WHEN image_id % 3 = 0 THEN 1 WHEN image_id % 3 = 1 THEN 0 END AS person_detected FROM images)) SELECT count(*) AS n_cases, round(avg(d), 4) AS person_detected FROM m""")
def metric_means(spark, sf_dir):
    """Means of the metrics over all cases, missing values left out."""
    rows = tables.images(spark, sf_dir).select(F.when(F.col("image_id") % 3 == 0, 1).when(F.col("image_id") % 3 == 1, 0).alias("person_detected"))
    return metrics.summary(rows, ["person_detected"])


@query(f"""{WITH} SELECT image_id, 'pedestrian' AS class_name, 0.0::DOUBLE AS x, (image_id % 640)::DOUBLE AS w, (group_id % 480)::DOUBLE AS h, 0.0::DOUBLE AS confidence, coalesce('c' || (image_id % 4), 'usual') AS caption FROM images WHERE image_id % 4 < 2
UNION ALL SELECT image_id, 'pedestrian', 0.0, (image_id % 640)::DOUBLE, (group_id % 480)::DOUBLE, 0.0, 'usual' FROM images WHERE image_id % 4 >= 2""")
def folder_boxes(spark, sf_dir):
    """A box around each whole image of a positive folder, with the caption of its file or the usual one."""
    images = tables.images(spark, sf_dir)
    path = F.concat(F.lit("/pos/"), F.col("image_id").cast("string"), F.lit(".jpg"))
    rows = images.select("image_id", path.alias("path"), (F.col("image_id") % 640).alias("width"), (F.col("group_id") % 480).alias("height"))
    told = images.filter("image_id % 4 < 2").select(F.concat(F.col("image_id").cast("string"), F.lit(".jpg")).alias("file_name"), F.concat(F.lit("c"), F.col("image_id") % 4).alias("caption"))
    boxes = scans.folder_boxes(rows)
    captions = scans.with_captions(rows, told, "usual").select("image_id", "path", "caption")
    return boxes.join(captions, "path").select("image_id", "class_name", "x", "w", "h", "confidence", "caption")


@query(f"""{WITH}, k AS (SELECT 'images/' || image_id || '_' || det_idx || '_' || p || '_' || s || '.jpg' AS file_name, split FROM inst JOIN images USING (image_id) WHERE p % 2 = 0) SELECT file_name, split, count(*) AS n FROM k GROUP BY ALL""")
def release_rows(spark, sf_dir):
    """Metadata rows of the samples whose crop exists."""
    samples = tables.instances(spark, sf_dir).join(tables.images(spark, sf_dir).select("image_id", "split"), "image_id").withColumn("sample_id", text.stable_id(*(F.col(k) for k in KEYS))).withColumn("caption", F.lit("c"))
    samples = samples.withColumn("crop_path", F.concat(F.lit("/crops/"), F.col("p")))
    crops = samples.filter("p % 2 = 0").select("crop_path").distinct()
    return sinks.release_rows(samples, crops).groupBy("file_name", "split").agg(F.count("*").alias("n"))
