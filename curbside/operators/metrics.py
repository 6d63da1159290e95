"""Metrics over detections, cases and run manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from curbside.functions import geometry as geo, scores
from curbside.operators.order_stats import percentiles
from curbside.settings import METRIC_DIRECTIONS


def keep_detections(detections: DataFrame, threshold: float, person_class: int | None = 0) -> DataFrame:
    """Detections with enough confidence of the class; a missing class passes."""
    own = F.lit(True) if person_class is None else F.col("cls").isNull() | (F.col("cls") == person_class)
    return detections.filter((F.col("conf") >= threshold) & own)


def presence(images: DataFrame, detections: DataFrame) -> DataFrame:
    """person_detected, person_confidence and person_count of every image; zeros without a detection."""
    per = detections.groupBy("image_id").agg(F.max("conf").alias("c"), F.count("*").alias("n"))
    return images.select("image_id").join(per, "image_id", "left").select(
        "image_id", F.when(F.col("n") > 0, 1).otherwise(0).alias("person_detected"), F.coalesce("c", F.lit(0.0)).alias("person_confidence"), F.coalesce("n", F.lit(0)).alias("person_count")
    )


def inclusion(source: DataFrame, result: DataFrame) -> DataFrame:
    """Count delta of (image_id, person_count) tables, and whether an object was added."""
    a, b = source.select("image_id", F.col("person_count").alias("source_count")), result.select("image_id", F.col("person_count").alias("result_count"))
    delta = F.col("result_count") - F.col("source_count")
    return a.join(b, "image_id").withColumn("person_count_delta", delta).withColumn("object_added", F.when(delta > 0, 1).otherwise(0))


def scale(detections: DataFrame, expected: DataFrame, order: tuple[str, ...] = ("det_idx",)) -> DataFrame:
    """Height of the most confident detection against (image_id, expected_height); ties go to the first by the columns of ``order``."""
    best = detections.groupBy("image_id").agg(F.max_by(F.col("y2") - F.col("y1"), F.struct("conf", *[(-F.col(c)).alias(c) for c in order])).alias("height"))
    ratio = F.when(F.col("expected_height") > 0, F.col("height") / F.col("expected_height"))
    return expected.join(best, "image_id", "left").withColumn("scale_ratio", ratio).withColumn("scale_error", F.when(F.col("expected_height") > 0, F.abs(F.col("height") - F.col("expected_height")) / F.col("expected_height")))


def last_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; ties in the order are broken by the row's own values."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rows.columns if c not in keys])


def summary(cases: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean of each metric, missing values left out, and the number of cases."""
    return cases.agg(F.count("*").alias("n_cases"), *[F.round(F.avg(m), 4).alias(m) for m in metrics])


def paired(a: DataFrame, b: DataFrame, keys: list[str], metrics: dict[str, bool | None] = METRIC_DIRECTIONS) -> DataFrame:
    """Means of both sides over common keys, their delta and whether b is better; null for neutral metrics.

    Keys meet null-safe. Sides must have one row per key (``last_per_key``).
    """
    own = [m for m in metrics if m in a.columns and m in b.columns]
    right = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(m).alias(f"__{m}") for m in own])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = a.join(right, same)
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("a"), F.col(f"__{m}").cast("double").alias("b")) for m in own]))
    per = joined.select(rows.alias("r")).groupBy("r.metric").agg(F.round(F.avg("r.a"), 4).alias("mean_a"), F.round(F.avg("r.b"), 4).alias("mean_b"), F.count("*").alias("n_pairs"))
    delta = F.round(F.col("mean_b") - F.col("mean_a"), 4)
    better = F.coalesce(*[F.when(F.col("metric") == m, F.lit(d)) for m, d in metrics.items() if d is not None], F.lit(None).cast("boolean"))
    return per.withColumn("delta", delta).withColumn("improved", F.when(better, F.col("delta") >= 0).when(~better, F.col("delta") <= 0))


def case_metrics(cases: DataFrame, result: DataFrame, source: DataFrame | None = None, backgrounds: DataFrame | None = None, threshold: float = 0.25, person_class: int | None = 0) -> DataFrame:
    """All metrics of each case (image_id, expected_height) in one row.

    ``result`` and ``source`` are detections of the edited image and of the one
    before; ``backgrounds`` has bg_mae and bg_ssim (see ``pixels.background``).
    What a missing input would tell is left out.
    """
    kept = keep_detections(result, threshold, person_class)
    found = presence(cases, kept).withColumn("person_confidence", F.round(F.col("person_confidence").cast("double"), 4))
    if source is not None:
        before = presence(cases, keep_detections(source, threshold, person_class)).select("image_id", F.col("person_count").alias("source_person_count"))
        delta = F.col("person_count") - F.col("source_person_count")
        found = found.join(before, "image_id").withColumn("inclusion_count_delta", delta).withColumn("object_added", F.when(delta >= 1, 1).otherwise(0))
    sizes = scale(kept, cases.select("image_id", "expected_height")).select(
        "image_id", F.round(F.coalesce("height", F.lit(0.0)), 4).alias("detected_height"), F.coalesce(F.col("expected_height").cast("double"), F.lit(0.0)).alias("expected_height"),
        F.round("scale_ratio", 4).alias("scale_ratio"), F.round("scale_error", 4).alias("scale_error"),
    )
    found = found.join(sizes, "image_id")
    if backgrounds is None:
        return found
    return found.join(backgrounds.select("image_id", F.round("bg_mae", 4).alias("bg_mae"), F.round("bg_ssim", 4).alias("bg_ssim")), "image_id", "left")


def run_summary(manifest: DataFrame, score_columns: list[str], rejects: DataFrame | None = None) -> DataFrame:
    """Generated, accepted, rejected, accept rate, scale coverage and mean scores of accepted rows (0 without any).

    A manifest without a column ``accepted`` has accepted rows only. ``rejects``
    (reason, n) are then those that it lacks; their map is in reject_reason_counts.
    """
    if "accepted" not in manifest.columns:
        own = run_summary(manifest.withColumn("accepted", F.lit("true")), score_columns)
        n = rejects.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("__n")) if rejects is not None else manifest.sparkSession.range(1).select(F.lit(0).alias("__n"))
        own = own.crossJoin(n).withColumn("rejected", F.col("__n")).withColumn("generated", F.col("accepted") + F.col("__n"))  # single rows
        own = own.withColumn("accept_rate", F.round(F.col("accepted") / F.greatest(F.lit(1), F.col("generated")), 4)).drop("__n")
        return own if rejects is None else own.crossJoin(reason_counts(rejects))
    if rejects is not None:
        return run_summary(manifest, score_columns).crossJoin(reason_counts(rejects))  # single rows
    yes = F.coalesce(F.lower(F.col("accepted").cast("string")) == "true", F.lit(False))
    means = [F.round(F.coalesce(F.avg(F.when(yes, F.col(c))), F.lit(0.0)), 4).alias(f"mean_{c}") for c in score_columns]
    covered = [F.round(F.avg(F.when(F.col("scale_score").isNotNull(), 1.0).otherwise(0.0)), 4).alias("scale_coverage_rate")] if "scale_score" in manifest.columns else []
    return manifest.agg(
        F.count("*").alias("generated"), F.count_if(yes).alias("accepted"), F.count_if(~yes).alias("rejected"),
        F.round(F.coalesce(F.count_if(yes) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 4).alias("accept_rate"), *covered, *means,
    )


def reason_counts(rejects: DataFrame) -> DataFrame:
    """One row: the map from reason to count of (reason, n) rows, as many as there are reasons."""
    pairs = F.array_sort(F.collect_list(F.struct("reason", "n")))
    return rejects.groupBy("reason").agg(F.sum("n").alias("n")).agg(F.map_from_entries(pairs).alias("reject_reason_counts"))


def merged_rejects(shards: list[DataFrame]) -> DataFrame:
    """(reason, n) over the (reason, n) tables of several shards."""
    out = shards[0]
    for more in shards[1:]:
        out = out.unionByName(more)
    return out.groupBy("reason").agg(F.sum("n").alias("n"))


def merged_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """The rows of several runs with their name in ``run``; columns that a run lacks are null there."""
    out = None
    for name, rows in runs.items():
        own = rows.withColumn("run", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def run_counters(manifest: DataFrame, n_jobs: int) -> DataFrame:
    """Retries, corrected, blended and fallback rows of accepted rows, and accept rates before and after scale correction."""
    yes = lambda c: F.count_if(F.coalesce(F.lower(F.col(c).cast("string")) == "true", F.lit(False)))
    out = manifest.agg(
        F.count("*").alias("accepted"), F.coalesce(F.sum(F.coalesce(F.col("retry_attempts").cast("bigint"), F.lit(0))), F.lit(0)).alias("retried"),
        yes("scale_corrected").alias("scale_corrected_count"), yes("seamless_clone_used").alias("seamless_clone_used_count"), yes("fallback_alpha_paste").alias("fallback_alpha_paste_count"),
    )
    jobs = F.nullif(F.lit(n_jobs), F.lit(0))
    out = out.withColumn("accept_rate_before", F.greatest(F.lit(0), F.col("accepted") - F.col("scale_corrected_count")) / jobs).withColumn("accept_rate_after", F.col("accepted") / jobs)
    share = lambda c: F.col(c) / F.nullif("accepted", F.lit(0))
    return out.withColumn("scale_correction_share", share("scale_corrected_count")).withColumn("seamless_clone_rate", share("seamless_clone_used_count"))


def reject_histogram(rejects: DataFrame, reason: str = "reject_reason") -> DataFrame:
    """Count and share of each reason among all rejects; the window runs over the reasons."""
    per = rejects.filter(F.coalesce(F.col(reason), F.lit("")) != "").groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def quality_summary(rows: DataFrame, columns: list[str], quality: str = "quality_score") -> DataFrame:
    """Mean and 10th percentile of each score over rows with a quality above 0; a missing score counts as 0, and so do all without rows."""
    kept = rows.filter(F.coalesce(F.col(quality), F.lit(0.0)) > 0).select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    tenth = percentiles(kept, {c: [0.1] for c in columns})
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    return kept.agg(F.count("*").alias("n"), *[zero(F.avg(c)).alias(f"{c}_mean") for c in columns], *[zero(F.lit(tenth[c, 0.1]).cast("double")).alias(f"{c}_p10") for c in columns])


def rollup_runs(runs: DataFrame) -> DataFrame:
    """Accept rate of each run and of all (weighted), with the unweighted mean of the runs' scale."""
    return runs.rollup("run").agg(F.sum("generated").alias("generated"), F.sum("accepted").alias("accepted"), F.avg("mean_scale").alias("mean_scale")).withColumn(
        "accept_rate", F.col("accepted") / F.col("generated")
    )


def rate_audit(rows: DataFrame, value: str, success: Column) -> DataFrame:
    """Rate with its interval, and deviation, median, 95th percentile and range of a value."""
    middle = percentiles(rows, {value: [0.5, 0.95]})
    out = rows.agg(
        F.count("*").alias("n"), F.count_if(success).alias("k"), F.stddev_samp(value).alias("sd"), F.lit(middle[value, 0.5]).cast("double").alias("median"),
        F.lit(middle[value, 0.95]).cast("double").alias("p95"), F.min(value).alias("least"), F.max(value).alias("largest"),
    )
    low, high = scores.wilson(F.col("k"), F.col("n"))
    return out.withColumn("rate", F.col("k") / F.col("n")).withColumn("low", low).withColumn("high", high)


def integrity(rows: DataFrame, key: str, seed: str, parts: Column, whole: Column) -> DataFrame:
    """Unique keys, seed range, missing keys and broken sums of a case table."""
    return rows.agg(
        F.count("*").alias("n"), F.countDistinct(key).alias("n_keys"), F.countDistinct(seed).alias("n_seeds"), F.min(seed).alias("first_seed"), F.max(seed).alias("last_seed"),
        F.count_if(F.col(key).isNull()).alias("missing_keys"), F.count_if(parts != whole).alias("broken_sums"),
    )


def target_detection(inserted: DataFrame, detections: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Whether any detection meets the inserted box (i_x1..i_y2), with best IoU and confidence."""
    joined = inserted.join(detections, "image_id", "left").withColumn("iou", geo.iou(geo.Box.of("i_"), geo.Box.of()))
    return joined.groupBy("image_id").agg(
        F.coalesce(F.bool_or(F.col("iou") >= threshold), F.lit(False)).alias("target_detected"), F.coalesce(F.max("iou"), F.lit(0.0)).alias("best_iou"), F.coalesce(F.max("conf"), F.lit(0.0)).alias("best_conf")
    )
