"""Text, path, number-cell and hash expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from curbside.settings import NOT_SOURCE_TOKENS, PERSON_WORDS, VARIANTS, CaptionSettings

_IMPERATIVE = r"(?i)^\s*(please\s+)?(add|place|put|insert|include|introduce|spawn|draw|paint)(\s+in|\s+on)?(\s+|$)"
# Reasons that are looked for by name, in this order; a longer name stands before one it contains.
KNOWN_REASONS = (
    "scale_unrecoverable", "ghost_person_low_contrast", "floating_or_bad_ground", "not_enough_new_people", "bad_person_depth_overlap",
    "low_person_conf", "partial_or_cropped_body", "partial_or_cropped", "bad_mask_quality", "bad_placement", "no_person_detected",
)


def subject_of(instruction: Column) -> Column:
    """Imperative instruction to the phrase it names; ``a person`` when nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.trim(F.coalesce(instruction, F.lit(""))), _IMPERATIVE, "")), F.lit("")), F.lit("a person"))


def instruction_caption(instruction: Column, prefix: str = "a photo of ", trigger: str = "") -> Column:
    return F.trim(F.concat(F.lit(prefix), F.lit(f"{trigger.strip()} " if trigger.strip() else ""), subject_of(instruction)))


def mentions_person(*texts: Column) -> Column:
    """Whether any of the texts has one of the person words as a whole word."""
    return F.lower(F.concat_ws(" ", *texts)).rlike(r"\b(" + "|".join(PERSON_WORDS) + r")\b")


def caption_fields(visible: Column, source: Column, scenes: dict[str, str]) -> dict[str, Column]:
    """Caption fields of an annotation; a missing or zero visible share counts as 1."""
    v = F.when(F.coalesce(visible, F.lit(0.0)) == 0, 1.0).otherwise(visible)
    scene = F.coalesce(*[F.when(source == k, text) for k, text in scenes.items()], F.lit(""))
    return {
        "framing": F.when(v >= 0.85, "full body").otherwise("partially visible body"),
        "view": F.lit(""),
        "pose": F.lit(""),
        "occlusion": F.when(v < 0.6, "partially occluded").otherwise(""),
        "scene": scene,
        "lighting": F.lit("natural lighting"),
    }


def render(template: str, fields: dict[str, Column]) -> Column:
    """Fills a template and drops the comma fragments that stay empty."""
    text = F.lit(template)
    for name, value in fields.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_join(parts, ", ")


def caption(visible: Column, source: Column, settings: CaptionSettings) -> Column:
    """Caption of a sample; the trigger is put before one that lacks it."""
    text = render(settings.template, caption_fields(visible, source, settings.scenes))
    return F.when(F.contains(text, F.lit(settings.trigger)), text).otherwise(F.concat(F.lit(f"a photo of {settings.trigger} {settings.class_token}, "), text))


def generation_prompt(caption_: Column, variant: Column, prompts: dict[str, str], preservation: str) -> Column:
    place = (
        F.when(variant.isin("add_two_pedestrians", "add_small_group"), "side by side in an empty road or sidewalk area, not overlapping")
        .when(variant == "add_occluded_pedestrian", "with realistic occlusion")
        .otherwise("in an empty road or sidewalk area")
    )
    prompt = F.coalesce(*[F.when(variant == k, v) for k, v in prompts.items()], F.lit(""))
    return F.concat(caption_, F.lit(". Add "), prompt, F.lit(" "), place, F.lit(f". Keep scene unchanged. {preservation}"))


def negative_prompt(base: str) -> Column:
    return F.lit(base + ", missing feet, amputated legs, tiny ghost, sticker outline")


def variant_target(variant: Column) -> Column:
    return F.coalesce(*[F.when(variant == k, v.target) for k, v in VARIANTS.items()], F.lit("pedestrian_insertion"))


def expected_count(variant: Column) -> Column:
    return F.when(variant == "add_two_pedestrians", 2).when(variant == "add_small_group", 3).otherwise(1)


def reject_reason(text: Column) -> Column:
    """Name of a reject reason in a message: named patterns, known names, type errors, first word."""
    t = F.coalesce(text, F.lit(""))
    named = [F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (r"last_reason=([A-Za-z0-9_]+)", r"Composite rejected as ([A-Za-z0-9_]+)", r"rejected as ([A-Za-z0-9_]+)")]
    known = [F.when(F.contains(t, F.lit(r)), r) for r in KNOWN_REASONS]
    types = F.when(F.contains(t, F.lit("expected scalar type Half")) | F.contains(t, F.lit("mixed dtype")), "pipeline_dtype_mismatch")
    first = F.regexp_replace(F.regexp_extract(t, r"(\S+)", 1), r"^[).,]+|[).,]+$", "")
    return F.coalesce(*named, *known, types, F.when(F.trim(t) == "", "unknown").otherwise(first))


def composite_reason(message: Column) -> Column:
    """Reason of a failed final mask check, from its message."""
    has = lambda s: F.contains(message, F.lit(s))
    return (
        F.when(has("scale mismatch"), "final_scale_mismatch").when(has("empty"), "accepted_mask_empty").when(has("soft") | has("transparent"), "mask_too_soft")
        .when(has("aspect"), "mask_aspect_invalid").when(has("too small"), "person_too_small").otherwise(reject_reason(message))
    )


def split_of_path(path: Column) -> Column:
    """train, val or test from the segments of a path; train when none says so."""
    parts = F.split(F.lower(path), "/")
    has = lambda s: F.array_contains(parts, s)
    return F.when(has("train"), "train").when(has("valid") | has("val"), "val").when(has("test"), "test").otherwise("train")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_image_file(path: Column) -> Column:
    """True for the names that an image scan takes: by suffix alone."""
    return F.lower(file_name(path)).rlike(r"\.(jpg|jpeg|png)$")


def is_source_image(path: Column) -> Column:
    """True for image files that no generated or label file's name token marks."""
    name = F.lower(file_name(path))
    banned = F.lit(False)
    for token in NOT_SOURCE_TOKENS:
        banned = banned | F.contains(name, F.lit(token))
    return is_image_file(path) & ~banned


def frame_number(path: Column) -> Column:
    """All digits of a file's stem as a number, 0 when there are none."""
    stem = F.regexp_replace(file_name(path), r"\.[^.]*$", "")
    return F.coalesce(F.regexp_replace(stem, "[^0-9]", "").try_cast("bigint"), F.lit(0).cast("bigint"))


def label_matches(label: Column, targets: list[str]) -> Column:
    text = F.replace(F.lower(label.cast("string")), F.lit("_"), F.lit(" "))
    return F.exists(F.array(*[F.lit(t) for t in targets]), lambda t: F.contains(text, t))


def stable_id(*parts: Column) -> Column:
    return F.concat_ws("_", *[p.cast("string") for p in parts])


def n_tokens(text: Column) -> Column:
    """Words of a caption; 0 for a blank one."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def numbers(cell: Column) -> Column:
    """Numbers of a cell that holds one, a JSON list or a list of lists; null when there are none."""
    flat = F.concat(F.lit("["), F.regexp_replace(cell, r"[\[\]\s]", ""), F.lit("]"))
    many = F.filter(F.transform(F.from_json(flat, "array<string>"), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    one = cell.try_cast("double")
    found = F.when(one.isNotNull(), F.array(one)).when(F.trim(cell).startswith("["), many)
    return F.when(F.size(found) > 0, found)


def first_number(cell: Column) -> Column:
    return F.get(numbers(cell), F.lit(0))


def largest_number(cell: Column) -> Column:
    return F.array_max(numbers(cell))


def mean_number(cell: Column) -> Column:
    n = numbers(cell)
    return F.aggregate(n, F.lit(0.0), lambda a, x: a + x) / F.size(n)


def box_numbers(cell: Column) -> Column:
    """The four numbers of ``(x1,y1,x2,y2)`` or ``[...]``; null unless there are four."""
    found = F.transform(F.regexp_extract_all(cell, F.lit(r"(-?\d+(?:\.\d+)?)")), lambda x: x.cast("double"))
    return F.when(F.size(found) == 4, found)


def number(cell: Column) -> Column:
    """A number cell; NaN and text are missing."""
    v = cell.try_cast("double")
    return F.when(~F.isnan(v), v)


def json_safe(df_columns: dict[str, Column]) -> Column:
    """One JSON text of named values, nested ones too; missing values are left out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in df_columns.items()]))


def sequence_truth(path: Column) -> Column:
    """Path of a sequence's truth file, from that of a frame in its folder ``img1``; null elsewhere."""
    return F.when(path.rlike(r"(?i)/img1/"), F.concat(F.regexp_extract(path, r"(?i)^(.*)/img1/", 1), F.lit("/gt/gt.txt")))


def frame_of_stem(path: Column) -> Column:
    """Frame number of a file whose whole stem is a number; null otherwise."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "").try_cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hashes of 16 hexadecimal digits; 999 when either isn't one."""
    ok = a.rlike("^[0-9a-fA-F]{16}$") & b.rlike("^[0-9a-fA-F]{16}$")
    bits = lambda h: F.conv(h, 16, -10).cast("bigint")
    return F.when(F.coalesce(ok, F.lit(False)), F.bit_count(bits(a).bitwiseXOR(bits(b)))).otherwise(999)


def seeded(seed: int | Column, *parts: Column) -> Column:
    """Hash that orders rows the same way in every run."""
    own = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", own.cast("string"), *[p.cast("string") for p in parts]).cast("binary"))


def uniform(seed: int | Column, *parts: Column) -> Column:
    """A number in [0, 1) from ``seeded``."""
    return F.conv(F.substring(seeded(seed, *parts), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
