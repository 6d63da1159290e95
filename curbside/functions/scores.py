"""Score, size and policy expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from curbside.functions.geometry import Box, area
from curbside.settings import AFFORDANCE_WEIGHTS, MIN_AFFORDANCE, MIN_OCCLUSION, MIN_PLACEMENT, MIN_SCALE, RESOLUTION, ROAD_BAND, VARIANTS


def clamp01(c: Column) -> Column:
    """Held within 0 and 1; a missing value is 0 (the least and the greatest of columns pass nulls over).

    The column stands in the expression once, since each repetition doubles the work of what is nested.
    """
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))


def visible_ratio(visible_area: Column, full_area: Column) -> Column:
    return F.when(full_area > 0, F.least(F.lit(1.0), visible_area / full_area)).otherwise(0.0)


def box_quality(visible: Column, occlusion: Column, height: Column) -> Column:
    """0.5 visible + 0.3 (1 - occlusion) + 0.2 of the height up to 256; without an occlusion the second term is 0.3, and it is never negative."""
    occ = occlusion.cast("double")
    clear = F.when(occ.isNull() | F.isnan(occ), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - occ))
    return F.round(0.5 * visible + 0.3 * clear + 0.2 * F.least(F.lit(1.0), height / 256), 4)


def placement_score(mask: Box, width: Column, height: Column, expected_y: Column) -> dict[str, Column]:
    """How near the feet of a mask are to where they should be."""
    foot, size = mask.y2, F.greatest(F.lit(1.0), height)
    error = F.abs(foot - F.coalesce(expected_y, foot))
    inside = (mask.x1 + mask.x2 >= 0) & ((mask.x1 + mask.x2) / 2 <= width) & (foot >= 0) & (foot <= height)
    band = (foot / size >= ROAD_BAND[0] - 0.10) & (foot / size <= ROAD_BAND[1] + 0.10)
    score = clamp01(1 - error / F.greatest(F.lit(54.0), 0.10 * size)) * F.when(inside, 1.0).otherwise(0.25) * F.when(band, 1.0).otherwise(0.55)
    missing = foot.isNull()
    return {
        "placement_score": F.when(missing, 0.0).otherwise(F.round(score, 4)),
        "placement_available": ~missing,
        "foot_y_error": F.round(error, 4),
        "valid_grounding": F.coalesce((score >= MIN_PLACEMENT) & band & inside, F.lit(False)),
    }


def scale_score(mask: Box, expected_height: Column) -> dict[str, Column]:
    """exp(-relative error) of the height; null without an expected height, 0 without a mask."""
    actual = F.greatest(F.lit(1.0), mask.height)
    known = expected_height > 0
    error = F.when(known, F.abs(actual - expected_height) / F.greatest(F.lit(1.0), expected_height))
    score = F.when(mask.y2.isNull(), 0.0).otherwise(F.round(clamp01(F.exp(-error)), 4))
    return {"scale_score": F.when(mask.y2.isNull() | known, score), "scale_available": F.coalesce(mask.y2.isNotNull() & known, F.lit(False)), "scale_relative_error": F.round(error, 4)}


def occlusion_parts(mask: Box, mask_area: Column, width: Column, height: Column, overlap: Column) -> dict[str, Column]:
    """1 less penalties for overlap, for what the border cuts off and for holes in the mask; the visible share, and the share cut off."""
    box = F.greatest(F.lit(1.0), area(mask))
    missing = mask.y2.isNull()
    seen = F.when(~missing, clamp01(mask_area / box))
    zero = F.lit(0.0)
    inside = F.greatest(zero, F.least(width, mask.x2) - F.greatest(zero, mask.x1)) * F.greatest(zero, F.least(height, mask.y2) - F.greatest(zero, mask.y1))
    cut = clamp01(1 - inside / box)
    at_border = (mask.x1 <= 3) | (mask.y1 <= 3) | (mask.x2 >= width - 3) | (mask.y2 >= height - 3)
    cut = F.when(~missing, F.when(at_border, F.greatest(cut, F.lit(0.35))).otherwise(cut))
    score = clamp01(1 - 0.50 * clamp01(F.coalesce(overlap, zero) / 0.24) - 0.35 * cut - 0.35 * clamp01((0.18 - seen) / 0.18))
    return {"score": score, "seen": seen, "cut": cut}


def occlusion_score(mask: Box, mask_area: Column, width: Column, height: Column, overlap: Column) -> dict[str, Column]:
    """The same to four digits; 0 without a mask."""
    part, missing = occlusion_parts(mask, mask_area, width, height, overlap), mask.y2.isNull()
    return {
        "occlusion_score": F.when(missing, 0.0).otherwise(F.round(part["score"], 4)),
        "occlusion_available": ~missing,
        "visible_share": F.round(part["seen"], 4),
        "truncation": F.round(part["cut"], 4),
    }


def affordance(placement: Column, scale: Column, occlusion: Column) -> Column:
    """Weighted sum to four digits; without a scale score the other weights are shared out again."""
    return F.round(affordance_raw(placement, scale, occlusion), 4)


def affordance_raw(placement: Column, scale: Column, occlusion: Column) -> Column:
    p, s, o = (AFFORDANCE_WEIGHTS[k] for k in ("placement", "scale", "occlusion"))
    without = p / (p + o) * placement + o / (p + o) * occlusion
    return clamp01(F.when(scale.isNull(), without).otherwise(p * placement + s * scale + o * occlusion))


def affordance_warnings(missing_mask: Column, scale: Column) -> Column:
    """What the scores could not be made from, joined by semicolons; empty when nothing lacks."""
    lost = F.when(missing_mask, "missing_mask_bbox")
    return F.concat_ws(";", lost, F.coalesce(lost, F.when(scale.isNull(), "missing_expected_height")), lost)


def affordance_reason(placement: Column, scale: Column, occlusion: Column, actual: Column, expected: Column, total: Column | None = None) -> Column:
    """First gate that a scored object fails; empty when none. The total is a gate only where it is given."""
    size = F.when(actual.isNull() | expected.isNull(), "bad_scale").when(actual > expected, "bad_scale_too_large").otherwise("bad_scale_too_small")
    out = F.when(placement < MIN_PLACEMENT, "bad_placement").when(scale < MIN_SCALE, size).when(occlusion < MIN_OCCLUSION, "bad_occlusion")
    if total is not None:
        out = out.when(total < MIN_AFFORDANCE, "low_affordance_score")
    return out.otherwise("")


def composite_quality(person: Column, scale_ratio: Column, diff: Column, threshold: Column, edge_removed: Column, seamless: Column, fallback: Column) -> dict[str, Column]:
    """Person, scale, background, edge and overall quality of a composite to four digits; missing inputs are neutral."""
    return {k: F.round(v, 4) for k, v in composite_parts(person, scale_ratio, diff, threshold, edge_removed, seamless, fallback).items()}


def composite_parts(person: Column, scale_ratio: Column, diff: Column, threshold: Column, edge_removed: Column, seamless: Column, fallback: Column) -> dict[str, Column]:
    person_score = clamp01(F.coalesce(person, F.lit(1.0)))
    ratio = F.coalesce(F.nullif(scale_ratio, F.lit(0.0)), F.lit(1.0))
    scale = clamp01(1 - F.least(F.lit(1.0), F.abs(F.ln(F.greatest(ratio, F.lit(1e-6))))))
    background = clamp01(F.coalesce(diff, F.lit(0.0)) / F.greatest(F.lit(1e-6), F.coalesce(threshold, F.lit(1.0)) * 4))
    edge = clamp01(1 - F.coalesce(edge_removed, F.lit(0.0)) + F.when(seamless, 0.12).otherwise(0.0) - F.when(fallback, 0.08).otherwise(0.0))
    total = clamp01(0.45 * person_score + 0.25 * scale + 0.20 * background + 0.10 * edge)
    return {"person_score": person_score, "scale_score": scale, "background_score": background, "edge_score": edge, "quality_score": total}


def _along_road(ground_y: Column, side: int) -> Column:
    far, near = side * ROAD_BAND[0], side * ROAD_BAND[1]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (ground_y - far) / max(1.0, near - far)))


def perspective_scale(ground_y: Column, side: int = RESOLUTION) -> Column:
    return 0.50 + _along_road(ground_y, side) * (1.14 - 0.50)


def by_variant(variant: Column, values: dict[str, float], otherwise: float) -> Column:
    return F.coalesce(*[F.when(variant == k, F.lit(v)) for k, v in values.items()], F.lit(otherwise))


def fallback_height(variant: Column, ground_y: Column, side: int = RESOLUTION) -> Column:
    """Height of a person without references, by variant and ground position."""
    base = by_variant(variant, {k: float(v.base_height) for k, v in VARIANTS.items()}, 96.0) * perspective_scale(ground_y, side)
    most = side * F.when(variant == "add_near_pedestrian", 0.62).when(variant == "add_distant_pedestrian", 0.26).otherwise(0.50)
    out = F.least(base, most)
    return F.when(ground_y / side < 0.74, F.least(out, F.lit(side * 0.34))).otherwise(out)


def insert_size(variant: Column, ground_y: Column, reference: Column, side: int = RESOLUTION) -> tuple[Column, Column]:
    """Width and height of the box to insert, in whole pixels."""
    w, h = insert_size_raw(variant, ground_y, reference, side)
    return F.rint(w), F.rint(h)


def insert_size_raw(variant: Column, ground_y: Column, reference: Column, side: int = RESOLUTION) -> tuple[Column, Column]:
    """The same before rounding, from fallback and reference heights."""
    fallback = fallback_height(variant, ground_y, side)
    bounded = F.greatest(fallback * 0.7, F.least(reference, fallback * 1.75))
    height = F.when(reference.isNull(), fallback).otherwise(0.56 * bounded + 0.44 * fallback)
    height = height * F.greatest(by_variant(variant, {k: v.scale_multiplier for k, v in VARIANTS.items()}, 1.0), F.lit(1.6))
    y = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ground_y / side))
    most = side * (0.28 + 0.34 * y)
    most = F.when(variant == "add_distant_pedestrian", F.least(most, F.lit(side * 0.25))).when(variant == "add_near_pedestrian", F.least(most, F.lit(side * 0.72))).otherwise(most)
    height = F.greatest(side * by_variant(variant, {k: v.min_height_ratio for k, v in VARIANTS.items()}, 0.09), F.least(height, most))
    width = height * 0.36 * F.when(variant == "add_two_pedestrians", 2 * 0.86).when(variant == "add_small_group", 3 * 0.86).otherwise(1.0)
    room = F.lit(float(side - 32))
    return F.greatest(F.lit(28.0), F.least(width * 1.3, room)), F.greatest(F.lit(46.0), F.least(height * 1.16, room))


def _height_multiplier(variant: Column) -> Column:
    v = F.coalesce(variant, F.lit("add_single_pedestrian"))
    own = F.when(F.contains(v, F.lit("distant")) | F.contains(v, F.lit("small_group")), 0.82).when(F.contains(v, F.lit("near")), 1.13).when(F.contains(v, F.lit("two")), 0.96).otherwise(1.0)
    return F.greatest(own, F.lit(1.6))


def group_jitter(variant: Column, index: Column) -> Column:
    """Share by which the members of a group differ in height, by their index; 0 for single persons."""
    steps = F.array(*[F.lit(x) for x in (-0.04, 0.0, 0.04, -0.02, 0.02)])
    return F.when(variant.isin("add_two_pedestrians", "add_small_group"), F.get(steps, (index % 5).cast("int"))).otherwise(0.0)


def expected_height(foot_y: Column, image_height: Column, variant: Column, jitter: Column | None = None) -> Column:
    """Expected height of a person from the ground position, changed by ``jitter`` where it is given."""
    ratio = 0.065 + (foot_y / F.greatest(F.lit(1.0), image_height) - 0.55) * 0.58
    own = F.greatest(F.lit(0.075), F.least(F.lit(0.29), ratio)) * _height_multiplier(variant)
    return F.greatest(F.lit(28.0), own * (F.lit(1.0) if jitter is None else 1 + jitter) * image_height)


def expected_height_from_depth(depth: Column, width: Column, foot_x: Column, foot_y: Column, image_height: Column, variant: Column) -> Column:
    """The same from a depth map (array, row by row): mean of the 5 x 5 neighbourhood."""
    height = (F.size(depth) / width).cast("int")
    fx = F.greatest(F.lit(0), F.least(width - 1, foot_x.cast("int")))
    fy = F.greatest(F.lit(0), F.least(height - 1, foot_y.cast("int")))
    x0, x1, y0, y1 = F.greatest(F.lit(0), fx - 2), F.least(width, fx + 3), F.greatest(F.lit(0), fy - 2), F.least(height, fy + 3)
    rows = F.flatten(F.transform(F.sequence(y0, y1 - 1), lambda y: F.slice(depth, y * width + x0 + 1, x1 - x0)))
    mean = F.aggregate(rows, F.lit(0.0), lambda a, v: a + v.cast("double")) / F.size(rows)
    ratio = F.greatest(F.lit(0.075), F.least(F.lit(0.29), 0.075 + mean * (0.29 - 0.075)))
    return F.greatest(F.lit(28.0), ratio * _height_multiplier(variant) * image_height)


def accepted_height_range(variant: Column, ground_y: Column, side: int = RESOLUTION) -> tuple[Column, Column]:
    """Least and largest share of the image height that a person may have."""
    t = _along_road(ground_y, side)
    near = variant == "add_near_pedestrian"
    least = F.greatest(F.when(near, 0.16).otherwise(0.09), 0.08 + t * (0.17 - 0.08))
    least = F.when(ground_y / side >= 0.72, F.greatest(least, F.lit(0.12))).otherwise(least)
    most = 0.36 + t * (F.when(near, 0.62).otherwise(0.52) - 0.36)
    distant = variant == "add_distant_pedestrian"
    return F.when(distant, 0.08).otherwise(least), F.when(distant, 0.27).otherwise(most)


def scale_policy(ratio: Column, conf: Column, mask_share: Column) -> Column:
    return (
        F.when(ratio.between(0.62, 2.2), "recoverable").when((ratio < 0.35) | (ratio > 3.2), "unrecoverable")
        .when((conf >= 0.48) & (mask_share >= 0.0015), "borderline_accept").otherwise("borderline_retry")
    )


def detection_rank(conf: Column, foot: Column, body: Column, scale_ratio: Column, avoid: Column, centre_distance: Column) -> Column:
    scale = 1 - F.least(F.lit(1.0), F.abs(F.ln(F.greatest(scale_ratio, F.lit(1e-6)))))
    return conf + 2.2 * foot + 0.8 * body + 0.45 * scale - 2.8 * avoid - 0.2 * centre_distance


def candidate_score(b: Box, person_overlap: Column, vehicle_overlap: Column, target_x: Column, target_y: Column, side: int = RESOLUTION) -> Column:
    """Placement score of a candidate box without semantic terms; those are added by ``semantic_terms``."""
    low, high = side * ROAD_BAND[0], side * ROAD_BAND[1]
    middle = low + 0.68 * (high - low)
    cx = (b.x1 + b.x2) / 2
    one = F.lit(1.0)
    road = 1 - F.least(one, F.abs(b.y2 - middle) / max(1.0, high - low))
    margin = F.least(one, F.greatest(F.lit(0.0), F.least(b.x1, b.y1, side - b.x2, side - b.y2) / 16.0))
    ratio = b.height / side
    size = F.when(ratio < 0.10, ratio / 0.10).when(ratio > 0.42, F.greatest(F.lit(0.0), 1 - (ratio - 0.42) / 0.20)).otherwise(1.0)
    slot = F.greatest(F.lit(0.0), 1 - (F.abs(cx / side - target_x) / 0.24 + F.abs(b.y2 / side - target_y) / 0.18) / 2)
    vehicle = F.least(one, F.coalesce(vehicle_overlap, F.lit(0.0)))
    person = F.coalesce(person_overlap, F.lit(0.0))
    score = 1.10 * road + 1.45 * slot + 0.35 * margin + 0.45 * size - 3.0 * 0.35 * person + 0.08 * F.least(vehicle, F.lit(0.22))
    return score - F.when(vehicle > 0.22, 3.0 * (vehicle - 0.22)).otherwise(0.0)


def semantic_terms(foot: Column, foot_avoid: Column, body: Column, avoid: Column) -> Column:
    """What mask coverage adds to a candidate's score; null for a candidate that has to go."""
    return F.when((foot >= 0.48) & (foot_avoid <= 0.05), 6.5 * foot + 0.45 * body - 9.0 * avoid)


def retry_budget(variant: Column, base: int = 4) -> Column:
    return F.when(variant.isin("add_distant_pedestrian", "add_small_group"), base + 1).when(variant == "add_near_pedestrian", min(base, 2)).otherwise(base)


EARLY_REASONS = (
    "no_person_detected", "no_person_mask", "segmenter_failed", "segmenter_unavailable", "low_person_conf", "partial_or_cropped_body", "partial_or_cropped",
    "not_enough_new_people", "bad_person_depth_overlap", "bad_placement", "scale_unrecoverable", "floating_or_bad_ground", "too_small_or_ghost_person",
)
LATE_REASONS = ("ghost_person_low_contrast", "bad_composite_quality", "final_scale_mismatch", "accepted_mask_empty", "mask_too_soft")


def should_retry(reason: Column, attempt: Column, budget: Column, streak: Column, has_scale_ratio: Column, mask_share: Column, seamless: Column) -> Column:
    """Whether a rejected attempt gets another one."""
    early = F.when(F.contains(reason, F.lit("scale")) & has_scale_ratio, attempt < 1).otherwise(True)
    late = (F.coalesce(mask_share, F.lit(0.0)) >= 0.0015) | (seamless & (attempt == 0)) | ~seamless
    return F.when((attempt >= budget) | (streak >= 2), False).when(reason.isin(*EARLY_REASONS), early).when(reason.isin(*LATE_REASONS), late).otherwise(False)


def retry_settings(strength: Column, guidance: Column, reason: Column, attempt: Column) -> tuple[Column, Column]:
    """Strength and guidance of the next attempt."""
    r = F.coalesce(F.nullif(reason, F.lit("")), F.lit("no_person_mask"))
    weak = r.isin("ghost_person_low_contrast", "too_small_or_ghost_person", "low_person_conf", "no_person_mask")

    def step(base: Column, rules: list[tuple[Column, float, float]], usual: tuple[float, float]) -> Column:
        out, moved = F.when(attempt <= 0, base), lambda d, cap: (F.least if d > 0 else F.greatest)(F.lit(cap), base + d * attempt)
        for condition, delta, cap in rules:
            out = out.when(condition, moved(delta, cap))
        return out.otherwise(moved(*usual))

    return (
        step(strength, [(weak, 0.04, 0.84), (r == "not_enough_new_people", 0.03, 0.86), (r == "too_large_for_perspective", -0.04, 0.60), (r == "partial_or_cropped", -0.03, 0.62)], (0.02, 0.80)),
        step(guidance, [(weak, 0.60, 8.2), (r == "not_enough_new_people", 0.55, 8.6), (r == "too_large_for_perspective", -0.60, 6.0), (r == "partial_or_cropped", -0.20, 6.0)], (0.25, 7.8)),
    )


def context_margin(margin: Column, reason: Column, attempt: Column) -> Column:
    return F.when((attempt > 0) & (reason == "partial_or_cropped"), margin * (1 + 0.14 * attempt)).otherwise(margin)


def attempt_seed(seed: Column, attempt: Column) -> Column:
    return seed + 9973 * attempt


def blended(current: Column, proposed: Column, whole: Column | None = None, share: float = 0.60, most: float = 1.35) -> Column:
    """Current value moved a share of the way to the proposed one, within a ratio of the current.

    Where ``whole`` is true the setting is a whole number and stays one, halves going to even.
    """
    new = current + (proposed - current) * share
    bounded = F.least(F.greatest(new, current / most), current * most)
    rounded = F.round(bounded, 4)
    if whole is not None:
        rounded = F.when(F.coalesce(whole, F.lit(False)), F.rint(bounded)).otherwise(rounded)
    return F.when(current == 0, new).otherwise(rounded)


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """95 % interval of a rate."""
    p, zz = successes / n, z * z
    centre, half = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return (centre - half) / (1 + zz / n), (centre + half) / (1 + zz / n)
