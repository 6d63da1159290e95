"""Where and how large to insert an object, from what the image holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from curbside.functions import geometry as geo, scores, text
from curbside.settings import RESOLUTION, ROAD_BAND, SLOT_XS, SLOT_YS


def overlap_summary(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Per candidate: largest overlap and IoU with the image's objects, any bad depth order, summed overlap.

    ``existing`` has image_id and boxes e_x1..e_y2; candidates without objects keep zeros.
    """
    a, b = geo.Box.of(), geo.Box.of("e_")
    ok, overlap = geo.depth_order_ok(a, b)
    joined = candidates.select("candidate_id", "image_id", "x1", "y1", "x2", "y2").join(existing, "image_id", "left")
    zero = F.lit(0.0)
    return joined.groupBy("candidate_id").agg(
        F.coalesce(F.max(overlap), zero).alias("max_overlap"), F.coalesce(F.max(geo.iou(a, b)), zero).alias("max_iou"), F.coalesce(F.bool_or(~ok), F.lit(False)).alias("bad_depth"),
        F.coalesce(F.sum(geo.intersection(a, b) / F.greatest(geo.area(a), F.lit(1))), zero).alias("summed_overlap"),
    )


def foreground_occluders(boxes: DataFrame, persons: DataFrame, vehicles: DataFrame, foot_delta: float = 18.0, least: float = 0.03, height_ratio: float = 0.35) -> DataFrame:
    """Per box: how many objects stand before it, and the largest overlap with one.

    Persons stand before it where the order of depth is wrong, vehicles that
    overlap by ``least`` where they are near or large enough.
    """
    a, b = geo.Box.of(), geo.Box.of("e_")
    ok, overlap = geo.depth_order_ok(a, b)
    share = geo.intersection(a, b) / F.least(F.greatest(geo.area(a), F.lit(1)), F.greatest(geo.area(b), F.lit(1)))
    large = F.greatest(b.height, F.lit(1)) >= F.greatest(a.height, F.lit(1)) * height_ratio
    p = boxes.join(persons, "image_id").filter(~ok & (geo.intersection(a, b) > 0)).select("box_id", overlap.alias("share"))
    v = boxes.join(vehicles, "image_id").filter((geo.intersection(a, b) > 0) & (share >= least) & ((b.y2 >= a.y2 - foot_delta) | large)).select("box_id", share.alias("share"))
    per = p.unionByName(v).groupBy("box_id").agg(F.count("*").alias("n"), F.round(F.max("share"), 4).alias("most"))
    return boxes.select("box_id").join(per, "box_id", "left").select("box_id", F.coalesce("n", F.lit(0)).alias("n_occluders"), F.coalesce("most", F.lit(0.0)).alias("max_share"))


def person_samples(boxes: DataFrame) -> DataFrame:
    """(image_id, ground_y, height) of persons that are fit to scale by."""
    h, w = F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")
    return boxes.filter(h.between(24, 180) & (w > 0) & (w / F.greatest(F.lit(1), h)).between(0.12, 0.85)).select("image_id", F.col("y2").alias("ground_y"), h.alias("height"))


def vehicle_samples(boxes: DataFrame) -> DataFrame:
    """The same from vehicles, their height turned into that of a person beside them."""
    h, w = F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")
    return boxes.filter(h.between(18, 130) & (w > 0) & (w / F.greatest(F.lit(1), h)).between(1.0, 4.8)).select("image_id", F.col("y2").alias("ground_y"), (h * 1.05).alias("height"))


def fitted_height(targets: DataFrame, samples: DataFrame) -> DataFrame:
    """Height at a ground position from a robust line: median of pair slopes, then of intercepts.

    Pairs are formed within an image, whose samples are few.
    """
    numbered = samples.withColumn("i", F.row_number().over(Window.partitionBy("image_id").orderBy("ground_y", "height")))
    a, b = numbered.alias("a"), numbered.alias("b")
    dy = F.col("b.ground_y") - F.col("a.ground_y")
    slope = (F.col("b.height") - F.col("a.height")) / dy
    pairs = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.i") < F.col("b.i"))).filter((F.abs(dy) >= 24) & slope.between(0.06, 1.1))
    slopes = pairs.groupBy(F.col("a.image_id").alias("image_id")).agg(F.median(slope).alias("slope"))
    lines = samples.join(slopes, "image_id").groupBy("image_id", "slope").agg(F.median(F.col("height") - F.col("slope") * F.col("ground_y")).alias("intercept"))
    height = F.col("slope") * F.col("target_y") + F.col("intercept")
    return targets.join(lines, "image_id", "left").withColumn("fitted", F.when(height > 0, height)).drop("slope", "intercept")


def nearest_height(targets: DataFrame, samples: DataFrame, most: float = 70.0, side: int = RESOLUTION) -> DataFrame:
    """Height at a ground position from the nearest sample, carried along the perspective; null beyond ``most``.

    An as-of join: targets and samples of an image stand in one order of the
    ground, and the last sample before a target and the first one behind it are
    compared. Equally near ones go to the smaller position, then height.
    """
    kinds = "struct<ground_y: double, height: double>"
    found = samples.filter("ground_y IS NOT NULL AND height IS NOT NULL").groupBy("image_id", F.col("ground_y").cast("double").alias("at")).agg(F.min("height").cast("double").alias("height"))
    points = found.select("image_id", "at", F.lit(0).alias("kind"), F.struct(F.col("at").alias("ground_y"), "height").alias("sample"), F.lit(None).cast("double").alias("target_y"))
    asked = targets.select("image_id", "target_y").distinct().filter("target_y IS NOT NULL")
    points = points.unionByName(asked.select("image_id", F.col("target_y").cast("double").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(kinds).alias("sample"), F.col("target_y").cast("double").alias("target_y")))
    along = Window.partitionBy("image_id").orderBy("at", "kind")
    before = F.last("sample", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    behind = F.first("sample", ignorenulls=True).over(along.rowsBetween(0, Window.unboundedFollowing))
    away = lambda s: F.when(s.isNotNull(), F.struct(F.abs(s["ground_y"] - F.col("target_y")).alias("away"), s["ground_y"].alias("ground_y"), s["height"].alias("height")))
    near = points.withColumns({"before": before, "behind": behind}).filter("kind = 1")
    best = near.select("image_id", F.col("target_y").cast(dict(targets.dtypes)["target_y"]).alias("target_y"), F.least(away(F.col("before")), away(F.col("behind"))).alias("s"))
    height = F.col("s.height") * scores.perspective_scale(F.col("target_y"), side) / F.greatest(F.lit(1e-6), scores.perspective_scale(F.col("s.ground_y"), side))
    return targets.join(best.select("image_id", "target_y", F.when(F.col("s.away") <= most, height).alias("nearest")), ["image_id", "target_y"], "left")


def weighted_height(targets: DataFrame, samples: DataFrame, most: float = 120.0) -> DataFrame:
    """Height from all samples within ``most``, weighted by 1 / (1 + distance).

    Samples are added up by position first, and a target meets those of its own
    and the two neighbouring bands of the ground alone.
    """
    away = F.abs(F.col("ground_y") - F.col("target_y"))
    band = lambda c: F.floor(F.col(c) / most)
    at = samples.groupBy("image_id", "ground_y").agg(F.sum("height").alias("height"), F.count("height").alias("n")).withColumn("band", band("ground_y"))
    asked = targets.select("image_id", "target_y").distinct().withColumn("band", F.explode(F.sequence(band("target_y") - 1, band("target_y") + 1)))
    near = asked.join(at, ["image_id", "band"]).filter(away <= most)
    per = near.groupBy("image_id", "target_y").agg((F.sum(F.col("height") / (1 + away)) / F.sum(F.col("n") / (1 + away))).alias("weighted"))
    return targets.join(per, ["image_id", "target_y"], "left")


def reference_height(targets: DataFrame, persons: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Reference height of each (image_id, target_y): persons and vehicles blended 30 to 70 where both tell one."""
    p, v = person_samples(persons), vehicle_samples(vehicles)
    out = nearest_height(fitted_height(targets, p), p).withColumn("person", F.coalesce("fitted", "nearest")).drop("fitted", "nearest")
    out = weighted_height(fitted_height(out, v), v).withColumn("vehicle", F.coalesce("fitted", "weighted")).drop("fitted", "weighted")
    return out.withColumn("reference", F.coalesce(0.3 * F.col("person") + 0.7 * F.col("vehicle"), "person", "vehicle"))


def make_candidates(images: DataFrame, tries: int = 180, seed: int = 42, side: int = RESOLUTION) -> DataFrame:
    """Candidate ground positions of each (image_id, variant): a skewed draw within the variant's range of the road."""
    low, high = int(side * ROAD_BAND[0]), int(side * ROAD_BAND[1])
    span, v = max(1, high - low), F.col("variant")
    near, distant, occluded = (v == f"add_{n}_pedestrian" for n in ("near", "distant", "occluded"))
    y0 = F.when(near, low + int(span * 0.58)).when(occluded, low + int(span * 0.20)).otherwise(low)
    y1 = F.when(distant, low + int(span * 0.34)).when(occluded, low + int(span * 0.78)).otherwise(high)
    rows = images.select("image_id", "variant", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("try"))
    draw = lambda s: text.uniform(seed, F.lit(s), F.col("image_id"), v, F.col("try"))
    u = draw("y")
    u = F.when(distant, 0.90 * F.pow(u, F.lit(1.35))).when(near, 0.12 + 0.76 * F.pow(u, F.lit(1.25))).otherwise(0.06 + 0.84 * F.pow(u, F.lit(1.15)))
    rows = rows.withColumn("ground_y", F.rint(y0 + F.greatest(F.lit(0.0), F.least(F.lit(0.92), u)) * (y1 - y0)).cast("int"))
    return rows.withColumn("centre_x", (16 + F.floor(draw("x") * (side - 31))).cast("int"))


def slot_target(images: DataFrame, seed: int = 42) -> DataFrame:
    """Target point of each (image_id, variant): a slot with jitter, held within the road."""
    v = F.col("variant")
    draw = lambda s: text.uniform(seed, F.lit(s), F.col("image_id"), v)
    pick = lambda values, s: F.get(F.array(*[F.lit(x) for x in values]), F.floor(draw(s) * len(values)).cast("int"))
    ys = F.when(v == "add_distant_pedestrian", pick(SLOT_YS[:2], "sy")).when(v == "add_near_pedestrian", pick(SLOT_YS[-2:], "sy")).otherwise(pick(SLOT_YS, "sy"))
    x, y = pick(SLOT_XS, "sx") + (draw("jx") * 2 - 1) * 0.06, ys + (draw("jy") * 2 - 1) * 0.06
    return images.select("image_id", "variant", F.greatest(F.lit(0.08), F.least(F.lit(0.92), x)).alias("target_x"), F.greatest(F.lit(ROAD_BAND[0]), F.least(F.lit(ROAD_BAND[1]), y)).alias("target_y"))


def candidate_boxes(candidates: DataFrame, side: int = RESOLUTION, edge: int = 16) -> DataFrame:
    """Box of each candidate by its insert size (insert_w, insert_h), moved within the edges; sizes that fit nowhere drop out."""
    w, h = F.col("insert_w"), F.col("insert_h")
    x = F.greatest(F.lit(float(edge)), F.least(side - w - edge, F.col("centre_x") - F.floor(w / 2)))
    y = F.greatest(F.lit(float(edge)), F.least(side - h - edge, F.col("ground_y") - h))
    return candidates.filter(side - w - edge > edge).withColumns({"x1": x, "y1": y, "x2": x + w, "y2": y + h})


def scored_candidates(candidates: DataFrame, persons: DataFrame, vehicles: DataFrame, targets: DataFrame, side: int = RESOLUTION) -> DataFrame:
    """Candidates (with candidate_id, image_id, variant and box) with their score.

    Those that stand wrong in depth drop out, and, where the candidates have
    columns foot, foot_avoid, body and avoid, those off the ground.
    """
    summary = lambda e: overlap_summary(candidates, e.select("image_id", *[F.col(c).alias("e_" + c) for c in ("x1", "y1", "x2", "y2")]))
    p = summary(persons).select("candidate_id", "max_overlap", "bad_depth")
    v = summary(vehicles).select("candidate_id", "summed_overlap")
    target = targets.select("image_id", "variant", "target_x", F.col("target_y").alias("slot_y"))
    joined = candidates.join(p, "candidate_id").join(v, "candidate_id").join(target, ["image_id", "variant"]).filter(~F.col("bad_depth"))
    score = scores.candidate_score(geo.Box.of(), F.col("max_overlap"), F.col("summed_overlap"), F.col("target_x"), F.col("slot_y"), side)
    if "foot" in candidates.columns:
        score = score + scores.semantic_terms(*(F.col(c) for c in ("foot", "foot_avoid", "body", "avoid")))
    return joined.withColumn("score", score).filter("score IS NOT NULL").drop("bad_depth", "slot_y", "target_x")


def insertion_regions(images: DataFrame, persons: DataFrame, vehicles: DataFrame, tries: int = 180, seed: int = 42, side: int = RESOLUTION) -> DataFrame:
    """Best box for each (image_id, variant), with the expected size of the person in it."""
    made = make_candidates(images, tries, seed, side)
    grounds = made.select("image_id", F.col("ground_y").cast("double").alias("target_y")).distinct()
    heights = reference_height(grounds, persons, vehicles).select("image_id", F.col("target_y").cast("int").alias("ground_y"), "reference")
    w, h = scores.insert_size(F.col("variant"), F.col("ground_y"), F.col("reference"), side)
    sized = made.join(heights, ["image_id", "ground_y"], "left").withColumns({"insert_w": w, "insert_h": h})
    boxes = candidate_boxes(sized, side).withColumn("candidate_id", text.stable_id(F.col("image_id"), F.col("variant"), F.col("try")))
    best = best_region(scored_candidates(boxes, persons, vehicles, slot_target(images, seed), side))
    return best.withColumns({"expected_height": (F.col("y2") - F.col("y1")) / 1.16, "expected_width": (F.col("x2") - F.col("x1")) / 1.3})


def best_region(scored: DataFrame, least: float = -1000.0) -> DataFrame:
    """The best-scoring candidate of each image and variant, the first of equals; none at or below the least score."""
    best = scored.filter(F.col("score") > least).groupBy("image_id", "variant").agg(F.max(F.struct("score", (-F.col("try")).alias("t"), "ground_y", "x1", "y1", "x2", "y2")).alias("b"))
    return best.select("image_id", "variant", (-F.col("b.t")).alias("try"), *[F.col(f"b.{c}").alias(c) for c in ("score", "ground_y", "x1", "y1", "x2", "y2")])


def monotonic_heights(items: DataFrame, ratio: float = 1.04) -> DataFrame:
    """Heights of a group's objects in the order of their feet, each at least ``ratio`` times the one before."""
    w = Window.partitionBy("image_id").orderBy("foot_y", "order")
    i = F.row_number().over(w)
    power = F.pow(F.lit(ratio), i.cast("double"))
    scaled = items.withColumn("__p", power).withColumn("__s", F.col("expected_height") / F.col("__p"))
    return scaled.withColumn("expected_height", F.max("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)) * F.col("__p")).drop("__p", "__s")


def correction_plan(items: DataFrame) -> DataFrame:
    """Resized box of each detected object, standing where its feet are, with status and reject_reason.

    Sides are whole pixels. After the policy a box is rejected within the margin
    of the border, and then by its aspect and its share of the image.
    """
    wide, high = F.col("width"), F.col("height")
    x1, y1 = (F.greatest(F.lit(0.0), F.rint(c)) for c in ("x1", "y1"))
    x2, y2 = F.least(wide.cast("double"), F.rint("x2")), F.least(high.cast("double"), F.rint("y2"))
    seen_w, seen_h = F.greatest(F.lit(1.0), x2 - x1), F.greatest(F.lit(1.0), y2 - y1)
    ratio = F.col("expected_height") / seen_h
    w, h = F.greatest(F.lit(4.0), F.rint(seen_w * ratio)), F.greatest(F.lit(8.0), F.rint(seen_h * ratio))
    left = F.rint((x1 + x2) / 2 - w / 2)
    moved, margin = geo.Box(left, y2 - h, left + w, y2), F.floor(F.greatest(wide, high) * 0.018)
    border = (moved.x1 < margin) | (moved.x2 > wide - margin) | (moved.y1 < margin) | (moved.y2 > high - margin)
    shape = ~(h / w).between(1.35, 3.6) | (h * w / F.greatest(F.lit(1), wide * high) < 0.00045)
    policy = scores.scale_policy(ratio, F.col("conf"), F.col("mask_share"))
    status = F.when(policy.isin("unrecoverable", "borderline_retry"), policy).when(border, "border_reject_after_resize").when(shape, "bad_scale_geometry_after_resize").otherwise(policy)
    out = items.select("*", ratio.alias("scale_ratio"), status.alias("status"), *moved.columns("r_"), border.alias("at_border"))
    return out.withColumn("reject_reason", F.when(F.col("status").isin("recoverable", "borderline_accept"), "").otherwise("scale_unrecoverable"))
