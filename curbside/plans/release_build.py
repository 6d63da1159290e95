"""The release build as one plan: candidates, duplicates, captions, split, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from curbside.functions import text
from curbside.operators import release
from curbside.runtime import cut
from curbside.settings import CaptionSettings, CurationSettings


def build(images: DataFrame, instances: DataFrame, registry: DataFrame, curation: CurationSettings, captions: CaptionSettings, mode: str = "reference", name: str = "release") -> dict[str, DataFrame]:
    """samples, groups, evaluation and status of a release.

    ``images`` carries sha256 and the 64-bit hash ``h``. The boxes of the class,
    their images, the groups and the samples are each written once, since several
    later steps read them. Only unique images are joined with their clusters and
    asked for samples: their exact duplicates stand in the groups as
    ``exact_groups`` left them. ``mode`` is that of ``near_clusters``; "connected"
    also splits by cluster, so that near duplicates never stand on both sides.
    """
    boxes = cut(release.keep_class(instances, curation.pedestrian_class), "boxes")
    images = cut(release.with_instances(images, boxes), "images")
    exact = cut(release.exact_groups(images), "exact")
    unique = cut(release.near_clusters(exact.filter("dedupe_status = 'unique'"), curation.near_distance, mode), "unique")
    alone = "image_id" if mode == "reference" else "canonical_image_id"  # of exact duplicates
    groups = unique.unionByName(exact.filter("dedupe_status <> 'unique'").withColumn("duplicate_cluster_id", F.col(alone)))
    evaluation = cut(release.eval_images(images, registry).select("image_id", "group_id"), "evaluation")
    ids = ["canonical_image_id", "duplicate_cluster_id"]
    found = release.candidates(release.training_images(unique, registry), boxes, curation, ids)
    samples = release.with_captions(found, captions)
    samples = samples.select(*[c for c in samples.columns if c not in ids], *ids)
    if "instance_id" in samples.columns:
        samples = samples.withColumn("sample_id", text.stable_id(F.lit(name), F.col("instance_id")))
    samples = cut(samples, "unsplit")
    key = "duplicate_cluster_id" if mode == "connected" else "group_id"
    samples = cut(release.split_groups(samples, curation.train_ratio, curation.seed, key=key), "samples")
    report = release.validation(samples, captions.trigger)
    return {"samples": samples, "groups": groups, "evaluation": evaluation, "status": release.status(report, release.leaks(samples, evaluation))}
