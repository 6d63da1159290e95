"""Settings of the data build and of the metric rules, as plain values."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

# Fixed values that results depend on.
ROAD_BAND = (0.68, 0.90)
RESOLUTION = 512
SLOT_XS = (0.2, 0.36, 0.52, 0.68, 0.82)
SLOT_YS = (0.68, 0.74, 0.8, 0.86, 0.91)
AFFORDANCE_WEIGHTS = {"placement": 0.4, "scale": 0.4, "occlusion": 0.2}
MIN_PLACEMENT, MIN_SCALE, MIN_OCCLUSION, MIN_AFFORDANCE = 0.45, 0.50, 0.40, 0.55
PERSON_WORDS = ("person", "people", "pedestrian", "man", "woman", "men", "women", "boy", "girl", "child", "children", "kid", "human")
NOT_SOURCE_TOKENS = ("mask", "label", "gtfine", "gtbbox", "instance", "polygon", "color")
SCENES = {"citypersons": "urban street scene", "mot17_02": "surveillance street scene", "human_detection": "real-world scene"}


class Variant(NamedTuple):
    weight: float
    expected_count: int
    target: str
    extra_retries: int
    min_conf: float
    base_height: int
    scale_multiplier: float
    min_height_ratio: float


# Fixed values of each kind of insertion.
VARIANTS = {
    "add_single_pedestrian": Variant(0.24, 1, "single_pedestrian", 0, 0.22, 96, 1.0, 0.09),
    "add_two_pedestrians": Variant(0.18, 2, "two_pedestrians", 0, 0.17, 98, 1.0, 0.085),
    "add_small_group": Variant(0.16, 3, "small_group", 1, 0.15, 102, 1.0, 0.085),
    "add_occluded_pedestrian": Variant(0.18, 1, "occluded_pedestrian", 0, 0.12, 90, 0.92, 0.075),
    "add_distant_pedestrian": Variant(0.14, 1, "distant_pedestrian", 1, 0.11, 68, 0.82, 0.08),
    "add_near_pedestrian": Variant(0.1, 1, "near_pedestrian", 0, 0.22, 150, 1.6, 0.16),
}
#: metric: whether larger values are better; None for neutral ones.
METRIC_DIRECTIONS = {"person_detected": True, "person_confidence": True, "person_count_delta": None, "object_added": True, "scale_error": False, "bg_mae": False, "bg_ssim": True}


@dataclass(frozen=True)
class CurationSettings:
    """Thresholds a box has to reach to become a training candidate."""

    pedestrian_class: str = "pedestrian"
    min_height: float = 96.0
    min_visible: float = 0.45
    min_quality: float = 0.70
    context_margin: float = 0.25
    max_side: int = 768
    min_side: int = 128
    near_distance: int = 6
    train_ratio: float = 0.85
    seed: int = 42


@dataclass(frozen=True)
class CaptionSettings:
    trigger: str = "<vin_ped>"
    class_token: str = "pedestrian"
    template_version: str = "v1"
    template: str = "a photo of <vin_ped> pedestrian, {framing}, {view}, {pose}, {occlusion}, {scene}, {lighting}"
    scenes: dict[str, str] = field(default_factory=lambda: dict(SCENES))


@dataclass(frozen=True)
class SourceRole:
    source_id: str
    split: str
    role: str  # "train" or "eval"


@dataclass(frozen=True)
class Source:
    """Where a source's files are and how they are read: ``yolo``, ``mot`` or ``classification_folders``."""

    source_id: str
    parser: str
    mount: str
    lora_splits: tuple[str, ...] = ()
    eval_splits: tuple[str, ...] = ()
    splits: dict[str, str] = field(default_factory=dict)
    label_dirs: dict[str, str] = field(default_factory=dict)
    sequence_dir: str = ""
    gt_dir: str = ""
    positive_dir: str = "1"
    source_fps: float = 30.0
    fps: float = 2.0
    window_seconds: float = 2.0


def sources_of(config: dict) -> list[Source]:
    """The sources of a configuration, in its order."""
    names = {"kaggle_mount": "mount", "temporal_sampling_fps": "fps", "temporal_window_seconds": "window_seconds"}
    known = {f.name for f in dataclasses.fields(Source)}
    found = []
    for entry in config.get("sources", []):
        own = {names.get(k, k): v for k, v in entry.items() if v is not None}
        found.append(Source(**{k: tuple(v) if isinstance(v, list) else v for k, v in own.items() if k in known}))
    return found


def registry(spark: SparkSession, roles: list[SourceRole]) -> DataFrame:
    """The (source_id, split, role) rows of a configuration: a small table, never larger than the configuration."""
    return spark.createDataFrame([(r.source_id, r.split, r.role) for r in roles], "source_id string, split string, role string")


def variant_table(spark: SparkSession) -> DataFrame:
    """One row for each variant, with the interval of its cumulative weight."""
    rows, low = [], 0.0
    total = sum(v.weight for v in VARIANTS.values())
    for name, v in VARIANTS.items():
        high = low + v.weight / total
        rows.append((name, low, high, *v[1:]))
        low = high
    return spark.createDataFrame(
        rows, "variant string, low double, high double, expected_count int, target string, extra_retries int, min_conf double, base_height int, scale_multiplier double, min_height_ratio double"
    )


def load(path: str) -> dict:
    """Settings of a JSON or YAML file, which the driver reads: it is a configuration of some kilobytes."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        import yaml

        return yaml.safe_load(f)


def roles_of(config: dict) -> list[SourceRole]:
    """Roles from the splits that each source of a configuration names for training and for evaluation."""
    return [SourceRole(s["source_id"], split, role) for s in config.get("sources", []) for role, key in (("train", "lora_splits"), ("eval", "eval_splits")) for split in s.get(key) or []]


def curation_of(config: dict) -> CurationSettings:
    """Thresholds, split and export sizes of a configuration; what it doesn't name keeps its usual value."""
    quality, split, export = (config.get(k) or {} for k in ("quality_thresholds", "split_config", "export_config"))
    found = {
        "min_height": quality.get("min_bbox_height_px"), "min_visible": quality.get("min_visible_ratio"), "min_quality": quality.get("min_quality_score"),
        "train_ratio": split.get("train_ratio"), "seed": split.get("split_seed"),
        "context_margin": export.get("crop_context_ratio"), "max_side": export.get("crop_max_size"), "min_side": export.get("crop_min_size"),
    }
    return dataclasses.replace(CurationSettings(), **{k: v for k, v in found.items() if v is not None})


def captions_of(config: dict) -> CaptionSettings:
    """Caption settings of a configuration, white space in the template folded."""
    usual = CaptionSettings()
    return dataclasses.replace(
        usual, trigger=config["trigger_token"], class_token=config.get("class_token", usual.class_token),
        template_version=config.get("template_version", usual.template_version), template=" ".join(config["caption_template"].split()),
    )
