"""Jobs, their attempts, and advice drawn from a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from curbside.functions import scores, text
from curbside.operators.release import ranked_by_hash


def jobs(records: DataFrame, variants: DataFrame, per_bucket: int, base_seed: int) -> DataFrame:
    """``per_bucket`` jobs for each (split, bucket): index, seed and a variant drawn by weight.

    Variants are a handful of rows with their interval [low, high); the join
    with them is a broadcast range join.
    """
    # The window is over the buckets, one row each.
    buckets = records.select("split", "bucket").distinct().withColumn("b", F.row_number().over(Window.orderBy("split", "bucket")) - 1)
    rows = buckets.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_bucket - 1)))).withColumn("job_index", F.col("b") * per_bucket + F.col("k")).drop("b")
    rows = rows.withColumn("seed", F.col("job_index") + base_seed).withColumn("u", text.uniform(F.col("seed"), F.lit("variant")))
    return rows.join(F.broadcast(variants.select("variant", "low", "high")), (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).drop("low", "high", "k")


def pick_records(records: DataFrame, n: int, seed: int, key: str = "image_id") -> DataFrame:
    """``n`` records in an order by hash; with repetition when there are fewer."""
    have = records.count()
    if have >= n or not have:
        return records.orderBy(text.seeded(seed, F.col(key)), key).limit(n)
    numbered = ranked_by_hash(records, key, seed).withColumn("__i", F.col("__rank") - 1).drop("__rank", "__of")
    wanted = records.sparkSession.range(n).select((F.col("id") % have).alias("__i"))
    return wanted.join(numbered, "__i").drop("__i")


def streaks(attempts: DataFrame, job: str = "job_id", order: str = "seq", reason: str = "reject_reason", name: str = "scale_unrecoverable") -> DataFrame:
    """Attempt number, and the running length of the current streak of one reason."""
    w = Window.partitionBy(job).orderBy(order)
    hit = F.coalesce(F.col(reason) == name, F.lit(False))
    island = attempts.withColumn("attempt", F.row_number().over(w) - 1).withColumn("__g", F.sum(F.when(hit, 0).otherwise(1)).over(w))
    inner = Window.partitionBy(job, "__g").orderBy(order)
    return island.withColumn("streak", F.sum(F.when(hit, 1).otherwise(0)).over(inner)).drop("__g")


def next_attempts(attempts: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Rejected attempts that get another one, with its settings and seed, and with ``rules`` (see ``retry_rules``) what their reason adds."""
    c = F.col
    budget = scores.retry_budget(c("variant"))
    again = scores.should_retry(c("reject_reason"), c("attempt"), budget, c("streak"), c("scale_ratio").isNotNull(), c("mask_share"), c("seamless"))
    after = c("attempt") + 1
    strength, guidance = scores.retry_settings(c("strength"), c("guidance"), c("reject_reason"), after)
    out = attempts.filter(again).select(
        "job_id", "reject_reason", after.alias("attempt"), strength.alias("strength"), guidance.alias("guidance"),
        scores.context_margin(c("margin"), c("reject_reason"), after).alias("margin"), scores.attempt_seed(c("seed"), after).alias("seed"),
    )
    return out if rules is None else with_retry_rules(out, rules)


def retry_rules(spark) -> DataFrame:
    """What a reason adds to the next attempt: deltas with caps, and words for both prompts."""
    weak = ("ghost_person_low_contrast", "too_small_or_ghost_person", "low_person_conf", "no_person_mask", "no_person_detected")
    partial = ("partial_or_cropped", "partial_or_cropped_body", "accepted_mask_empty", "mask_too_soft")
    rows = [(r, 0.04, 0.86, 0.35, 8.6, ", clear solid person", ", transparent, faded") for r in weak]
    rows += [(r, 0.0, None, 0.0, None, ", complete body visible", ", cropped head, cropped feet, half body") for r in partial]
    rows += [(r, 0.03, 0.86, 0.25, 8.4, ", visible grounded person", ", tiny, barely visible") for r in ("scale_unrecoverable", "final_scale_mismatch")]
    rows += [
        ("too_large_for_perspective", 0.0, None, 0.0, None, ", realistic scale", ", wrong scale"),
        ("not_enough_new_people", 0.03, 0.86, 0.30, 8.4, ", all people separate, visible gaps, distinct bodies", ", missing person, merged bodies, fused bodies, overlapping people"),
        ("bad_person_depth_overlap", -0.02, 0.62, 0.0, None, ", separated depth, no body overlap, distinct silhouettes", ", overlap, merged people, fused bodies, person on person"),
        ("bad_placement", 0.02, 0.84, 0.25, 8.2, ", exactly inside the marked placement area, centered on the guide", ", person outside marked area, wrong location"),
        ("floating_or_bad_ground", 0.0, None, 0.0, None, ", feet on road", ", floating, on vehicle"),
        ("bad_composite_quality", 0.0, None, 0.0, None, ", clean edges", ", sticker, halo, blurry"),
    ]
    return spark.createDataFrame(rows, "reject_reason string, d_strength double, strength_cap double, d_guidance double, guidance_cap double, prompt string, negative string")


def with_retry_rules(settings: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds the rule of its reason to each next attempt."""
    def moved(c: str) -> F.Column:
        new, cap, d = F.col(c) + F.col(f"d_{c}"), F.col(f"{c}_cap"), F.col(f"d_{c}")
        return F.coalesce(F.when(d > 0, F.least(new, cap)).when(d < 0, F.greatest(new, cap)), F.col(c))

    joined = settings.join(F.broadcast(rules), "reject_reason", "left")
    return joined.withColumn("strength", moved("strength")).withColumn("guidance", moved("guidance")).drop("d_strength", "d_guidance", "strength_cap", "guidance_cap")


def reject_figures(counts: DataFrame, mode: str = "fixed") -> DataFrame:
    """low_person, bad_scale and bad_depth of (reason, n) rows, for ``advice``.

    ``reference`` counts rejects named ``bad_scale`` alone, which no gate emits;
    ``fixed`` counts the reasons that the gates do emit for a wrong size.
    """
    if mode not in ("fixed", "reference"):
        raise ValueError(f"mode {mode!r} is neither fixed nor reference")
    scale = ["bad_scale"] if mode == "reference" else ["bad_scale", "bad_scale_too_large", "bad_scale_too_small", "scale_unrecoverable"]
    of = lambda reasons: F.coalesce(F.sum(F.when(F.col("reason").isin(reasons), F.col("n"))), F.lit(0))
    return counts.agg(
        of(["low_person_conf", "no_person_detected", "no_person_mask", "segmenter_failed"]).alias("low_person"), of(scale).alias("bad_scale"), of(["bad_person_depth_overlap"]).alias("bad_depth")
    )


def skipped_advice(run: DataFrame, settings: DataFrame, min_samples: int = 30) -> DataFrame:
    """(name) of the settings that a run's figures speak for and ``settings`` doesn't have."""
    return _fired(run, min_samples).join(settings, "name", "left_anti").select("name")


def advice(run: DataFrame, settings: DataFrame, min_samples: int = 30) -> DataFrame:
    """(name, current, proposed, value, change) of the settings that a run's figures speak for.

    ``run`` is one row: n_accepted, n_jobs, person_p10, scale_p10, background_p10,
    edge_p10, low_person, bad_scale, bad_depth. ``settings`` has (name, current)
    and may have ``whole``, true for a whole number (by default the two that count
    attempts); names that it lacks are left out (see ``skipped_advice``). With a
    column quality_mean below 0.72 there are two rows more,
    GENERATION_STRENGTH_DELTA and GENERATION_GUIDANCE_DELTA: what all attempts
    add, neither blended nor bounded.
    """
    c = F.col
    out = _fired(run, min_samples).join(settings, "name")
    usual = c("name").isin("CONTEXT_GENERATION_RETRIES", "SCALE_CORRECTION_MAX_ATTEMPTS")
    whole = F.coalesce("whole", usual) if "whole" in settings.columns else usual
    proposed = F.when(c("delta") > 0, F.least(c("current") + c("delta"), c("cap"))).otherwise(F.greatest(c("current") + c("delta"), c("cap")))
    out = out.withColumn("proposed", proposed).withColumn("value", scores.blended(c("current"), c("proposed"), whole))
    out = out.select("name", "current", "proposed", "value", F.round((c("value") - c("current")) / F.nullif(F.abs(c("current")), F.lit(0.0)), 4).alias("change"))
    if "quality_mean" not in run.columns:
        return out
    deltas = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(0.0).alias("current"), F.lit(d).alias("proposed")) for n, d in (("GENERATION_STRENGTH_DELTA", 0.01), ("GENERATION_GUIDANCE_DELTA", 0.10))])).alias("r")
    low = run.filter((c("n_accepted") >= min_samples) & (c("quality_mean") < 0.72)).select(deltas).select("r.*")
    return out.unionByName(low.select("name", "current", "proposed", c("proposed").alias("value"), F.lit(None).cast("double").alias("change")))


def _fired(run: DataFrame, min_samples: int) -> DataFrame:
    """(name, delta, cap) of the rules that a run's figures set off."""
    c, jobs_ = F.col, F.greatest(F.col("n_jobs"), F.lit(1))
    rules = [
        ("CONTEXT_GENERATION_RETRIES", c("n_accepted") / jobs_ < 0.30, 1.0, 5.0),
        ("CONTEXT_PERSON_MIN_CONFIDENCE", (c("low_person") >= F.greatest(F.lit(2.0), jobs_ * 0.15)) | (c("person_p10") < 0.45), -0.02, 0.08),
        ("MIN_RETRY_PERSON_CONFIDENCE", (c("low_person") >= F.greatest(F.lit(2.0), jobs_ * 0.15)) | (c("person_p10") < 0.45), -0.02, 0.08),
        ("SCALE_CORRECTION_MAX_ATTEMPTS", (c("bad_scale") >= F.greatest(F.lit(2.0), jobs_ * 0.12)) | (c("scale_p10") < 0.55), 1.0, 4.0),
        ("SCALE_CORRECTION_HEIGHT_STEP", (c("bad_scale") >= F.greatest(F.lit(2.0), jobs_ * 0.12)) | (c("scale_p10") < 0.55), 0.02, 0.12),
        ("MAX_PERSON_PERSON_OVERLAP_RATIO", c("bad_depth") >= F.greatest(F.lit(1.0), jobs_ * 0.08), -0.02, 0.04),
        ("OCCLUDED_PERSON_MAX_HEIGHT_RATIO", c("bad_depth") >= F.greatest(F.lit(1.0), jobs_ * 0.08), -0.05, 0.55),
        ("SEAMLESS_CLONE_MIN_MASK_AREA", c("background_p10") < 0.55, -0.001, 0.003),
        ("LOCAL_BRIGHTNESS_STRENGTH", c("background_p10") < 0.55, 0.04, 0.45),
        ("PERSON_COLOR_MATCH_STRENGTH", c("background_p10") < 0.55, 0.04, 0.45),
        ("EDGE_HALO_COLOR_MATCH_STRENGTH", c("edge_p10") < 0.55, 0.04, 0.48),
        ("PERSON_PASTE_FEATHER_RADIUS", c("edge_p10") < 0.55, 0.08, 0.60),
    ]
    fired = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), on.alias("on"), F.lit(d).alias("delta"), F.lit(cap).alias("cap")) for n, on, d, cap in rules])).alias("r")
    return run.filter(c("n_accepted") >= min_samples).select(fired).select("r.*").filter("on")


def gate_target_splits(records: DataFrame, gate_as: str | None = None) -> DataFrame:
    """Records as targets of augmentation; test and validation rows are an error, unless they are relabelled by name."""
    held = F.lower("split").isin("test", "val", "valid")
    if gate_as is not None:
        return records.withColumn("split", F.when(held, gate_as).otherwise(F.col("split")))
    found = sorted(r[0] for r in records.filter(held).select(F.lower("split")).distinct().collect())  # three names at most
    if found:
        raise ValueError(f"targets of augmentation are of the splits {found}")
    return records


def prompt_preview(records: DataFrame, variants: DataFrame, n: int, prompts: dict[str, str], preservation: str) -> DataFrame:
    """Path, caption and generation prompt of the first ``n`` records for each variant."""
    first = records.orderBy("path").limit(n).crossJoin(F.broadcast(variants.select("variant")))  # n rows and a handful
    return first.select("path", "variant", "caption", text.generation_prompt(F.col("caption"), F.col("variant"), prompts, preservation).alias("prompt"))


def bad_placement(b: DataFrame, overlap: str = "target_overlap", distance: str = "centre_distance", attempts_left: str = "attempts_left") -> DataFrame:
    """Marks results that miss their target window while attempts remain."""
    miss = (F.col(overlap) < 0.05) & (F.col(distance) > 0.28) & (F.col(attempts_left) > 0)
    return b.withColumn("reject_reason", F.when(miss, "bad_placement").otherwise(F.coalesce("reject_reason", F.lit(""))))
