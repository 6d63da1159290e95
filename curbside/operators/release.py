"""From annotated images to a checked training release.

Tables: images(image_id, source_id, split, group_id, sha256, phash, ingest_seq),
instances(image_id, instance_id, class_name, x, y, w, h, visible_w, visible_h,
occlusion, ignore), registry(source_id, split, role).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window, functions as F

from curbside.components import connected_components
from curbside.functions import geometry as geo, scores, text
from curbside.operators import bloom, phrases
from curbside.operators.order_stats import percentiles
from curbside.runtime import cut
from curbside.skew import dealt_join, spread_join
from curbside.settings import CaptionSettings, CurationSettings


def keep_class(instances: DataFrame, name: str = "pedestrian") -> DataFrame:
    """Boxes of one class that aren't marked to be ignored."""
    return instances.filter((F.col("class_name") == name) & ~F.coalesce(F.col("ignore"), F.lit(False)))


def with_instances(images: DataFrame, instances: DataFrame) -> DataFrame:
    """Images that still have a box."""
    return images.join(instances, "image_id", "left_semi")


def training_images(images: DataFrame, registry: DataFrame) -> DataFrame:
    """Images whose split feeds training: none of an eval split, and of a named training split where a source names any.

    The registry is as small as a configuration; Spark broadcasts it.
    """
    locked = registry.filter("role = 'eval'").select("source_id", "split")
    train = registry.filter("role = 'train'").select("source_id", "split")
    return images.join(locked, ["source_id", "split"], "left_anti").join(train, ["source_id", "split"], "left_semi")


def eval_images(images: DataFrame, registry: DataFrame) -> DataFrame:
    return images.join(registry.filter("role = 'eval'").select("source_id", "split"), ["source_id", "split"], "left_semi")


def candidates(images: DataFrame, instances: DataFrame, settings: CurationSettings, keep: Sequence[str] = ()) -> DataFrame:
    """Boxes that pass the thresholds, with visible share, quality and the columns of ``images`` in ``keep``; images without a row drop out."""
    area = F.col("w") * F.col("h")
    seen = scores.visible_ratio(F.col("visible_w") * F.col("visible_h"), area)
    boxes = instances.withColumn("visible_ratio", seen).withColumn("quality_score", scores.box_quality(F.col("visible_ratio"), F.col("occlusion"), F.col("h")))
    kept = boxes.filter((F.col("h") >= settings.min_height) & (F.col("visible_ratio") >= settings.min_visible) & (F.col("quality_score") >= settings.min_quality))
    return kept.join(images.select("image_id", "source_id", "group_id", *keep), "image_id")


def exact_groups(images: DataFrame) -> DataFrame:
    """canonical_image_id and dedupe_status by content hash; an image without a hash is its own.

    The first image of a hash is found by an aggregate and joined back by its
    key; the images of a hash with very many are dealt to several places.
    """
    key = F.coalesce(F.nullif("sha256", F.lit("")), F.col("image_id").cast("string"))
    keyed = images.withColumn("__key", key)
    first = keyed.groupBy("__key").agg(F.min_by("image_id", "ingest_seq").alias("canonical_image_id"), F.count("*").alias("__copies"))
    status = F.when(F.col("canonical_image_id") == F.col("image_id"), "unique").otherwise("exact_duplicate")
    return spread_join(keyed, first, "__key", "__copies", "image_id", total=images.count()).withColumn("dedupe_status", status).drop("__key")


def _in_ball(bits: int, most: int) -> int:
    return sum(comb(bits, i) for i in range(most + 1))


def hash_keys(distance: int, most_entries: int = 512) -> list[tuple[int, int, int]]:
    """(shift, width, flips) of the keys that 64 bits are cut into.

    Two hashes within ``distance`` bits differ in at most ``flips`` bits of one
    of m keys, flips being distance / m rounded down. Of the numbers of keys that
    list at most ``most_entries`` values a hash, the one is taken that lets the
    smallest share of random hashes meet.
    """
    plans = []
    for m in range(1, distance + 2):
        edges = [64 * i // m for i in range(m + 1)]
        keys = [(a, b - a, distance // m) for a, b in zip(edges, edges[1:], strict=False)]
        if sum(_in_ball(w, f) for _, w, f in keys) <= most_entries:
            plans.append((sum(_in_ball(w, f) / 2**w for _, w, f in keys), keys))
    return min(plans)[1]


def near_hashes(hashes: DataFrame, distance: int = 6) -> DataFrame:
    """(source_id, a, b, distance) of distinct hashes of a source within ``distance`` bits, a < b.

    Multi-index hashing: a hash has one value in each key, and on the other side
    every value that few enough flips away from its own; an equi-join finds each
    pair, and a pair that meets in several keys counts in the first of them. At
    6 bits there are four keys of 16 bits with one flip, 68 values a hash, and
    one in a thousand of a source's pairs meets. Equal hashes must have been
    collapsed before. The rows of a key that very many hashes share are dealt.
    """
    keys = hash_keys(distance)

    def part(h: Column, i: int) -> Column:
        shift, width, _ = keys[i]
        own = F.shiftrightunsigned(h, shift)
        return own if width == 64 else own.bitwiseAND(F.lit((1 << width) - 1))

    def listed(i: int) -> Column:
        _, width, flips = keys[i]
        signed = lambda m: m - (1 << 64) if m >> 63 else m
        masks = [signed(sum(1 << b for b in bits)) for n in range(flips + 1) for bits in combinations(range(width), n)]
        return F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda m: F.struct(F.lit(i).alias("key"), part(F.col("h"), i).bitwiseXOR(m).alias("v")))

    own = F.explode(F.array(*[F.struct(F.lit(i).alias("key"), part(F.col("h"), i).alias("v")) for i in range(len(keys))])).alias("e")
    around = F.explode(F.concat(*[listed(i) for i in range(len(keys))])).alias("e")
    a = hashes.select("source_id", F.col("h").alias("a"), own).select("source_id", "a", "e.*")
    b = hashes.select("source_id", F.col("h").alias("b"), around).select("source_id", "b", "e.*")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = dealt_join(a, b, ["source_id", "key", "v"], "a").filter("a < b").withColumn("distance", apart).filter(F.col("distance") <= distance)
    both = F.col("a").bitwiseXOR(F.col("b"))
    earlier = F.lit(False)
    for i, (_, _, flips) in enumerate(keys):
        earlier = earlier | ((F.col("key") > i) & (F.bit_count(part(both, i)) <= flips))
    return pairs.filter(~earlier).select("source_id", "a", "b", "distance")


def _last_earlier(images: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(image_id, __cluster): the last earlier image under one of the ``neighbours(source_id, h, o)`` of each image's hash, null without one.

    A segmented running maximum: images are cut into ranges of the ingest order,
    each range's last image of a hash is carried to the later ranges, and inside
    a range a window finds the rest. However many images share a hash, no task
    holds more of them than a range has.
    """
    own = images.filter("h IS NOT NULL").select("source_id", "h", F.col("ingest_seq").alias("s"), F.col("image_id").alias("i"))
    ranged = cut(own.repartitionByRange("s").withColumn("segment", F.spark_partition_id()), "segments")
    offers = ranged.withColumnRenamed("h", "o")
    offered = dealt_join(offers, neighbours, ["source_id", "o"], "i").select("source_id", "h", "segment", "s", "i", F.lit(False).alias("own"))
    asked = ranged.select("source_id", "h", "segment", "s", "i", F.lit(True).alias("own"))
    inside = Window.partitionBy("source_id", "h", "segment").orderBy("s").rangeBetween(Window.unboundedPreceding, -1)
    near = offered.unionByName(asked).withColumn("near", F.max(F.when(~F.col("own"), F.struct("s", "i"))).over(inside)).filter("own")

    lasts = offers.groupBy("source_id", "o", "segment").agg(F.max(F.struct("s", "i")).alias("last"))
    lasts = lasts.join(neighbours.hint("merge"), ["source_id", "o"]).select("source_id", "h", "segment", "last")
    per = lasts.unionByName(asked.select("source_id", "h", "segment", F.lit(None).cast(lasts.schema["last"].dataType).alias("last"))).groupBy("source_id", "h", "segment").agg(F.max("last").alias("last"))
    before = Window.partitionBy("source_id", "h").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select("source_id", "h", "segment", F.max("last").over(before).alias("carried"))
    return near.join(carried, ["source_id", "h", "segment"]).select(F.col("i").alias("image_id"), F.coalesce("near.i", "carried.i").alias("__cluster"))


def near_clusters(images: DataFrame, distance: int = 6, mode: str = "reference") -> DataFrame:
    """duplicate_cluster_id of each image with a 64-bit hash column ``h``.

    ``reference``: the last earlier image of the source within the distance, the
    image itself without one; clusters don't chain. ``connected``: the least
    image of everything that is linked, which a split needs to be leak-free. An
    image that another one stands for gets the ``dedupe_status`` near_duplicate,
    if there is such a column.
    """
    hashes = images.filter("h IS NOT NULL").select("source_id", "h").distinct()
    pairs = cut(near_hashes(hashes, distance), "pairs")
    if mode == "reference":
        both = pairs.select("source_id", F.col("a").alias("h"), F.col("b").alias("o")).unionByName(pairs.select("source_id", F.col("b").alias("h"), F.col("a").alias("o")))
        found = _last_earlier(images, both.unionByName(hashes.select("source_id", "h", F.col("h").alias("o"))))
    else:
        least = images.filter("h IS NOT NULL").groupBy("source_id", "h").agg(F.min("image_id").alias("first"), F.count("*").alias("copies"))
        ends = pairs.join(least.select("source_id", F.col("h").alias("a"), F.col("first").alias("u")), ["source_id", "a"]).join(least.select("source_id", F.col("h").alias("b"), F.col("first").alias("v")), ["source_id", "b"])
        parts = connected_components(ends.select("u", "v"))
        of_hash = least.join(parts, F.col("first") == F.col("v"), "left").select(F.struct("source_id", "h").alias("k"), F.coalesce("component", "first").alias("__cluster"), "copies")
        keyed = images.filter("h IS NOT NULL").select("image_id", F.struct("source_id", "h").alias("k"))
        found = spread_join(keyed, of_hash, "k", "copies", "image_id").select("image_id", "__cluster")
    out = images.join(found, "image_id", "left").withColumn("duplicate_cluster_id", F.coalesce("__cluster", "image_id")).drop("__cluster")
    if "dedupe_status" in images.columns:
        out = out.withColumn("dedupe_status", F.when(F.col("duplicate_cluster_id") != F.col("image_id"), "near_duplicate").otherwise(F.col("dedupe_status")))
    return out


def drop_duplicates(samples: DataFrame, groups: DataFrame) -> DataFrame:
    """Samples of canonical images, with their cluster; images without a group row stand for themselves."""
    own = groups.select("image_id", "canonical_image_id", "duplicate_cluster_id")
    joined = samples.join(own, "image_id", "left")
    return joined.filter(F.coalesce("canonical_image_id", "image_id") == F.col("image_id")).withColumn("duplicate_cluster_id", F.coalesce("duplicate_cluster_id", "image_id"))


def split_groups(samples: DataFrame, ratio: float, seed: int, names: tuple[str, str] = ("train", "val"), key: str = "group_id", out: str = "split") -> DataFrame:
    """Group-disjoint split: the first share of the groups, in an order by hash, goes to the first name."""
    ranked = ranked_by_hash(samples.select(key).distinct(), key, seed)
    placed = ranked.select(key, F.when(F.col("__rank") <= F.floor(F.col("__of") * F.lit(ratio)), names[0]).otherwise(names[1]).alias(out))
    return samples.drop(out).join(placed, key)


def ranked_by_hash(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds ``__rank``, the place in an order by seeded hash and key, and ``__of``, the number of rows.

    Rows are counted by the hash's first three digits; the running total is over
    these 4096 cells, and each cell is put in order by itself.
    """
    hashed = rows.withColumn("__hash", text.seeded(seed, F.col(key))).withColumn("__cell", F.substring("__hash", 1, 3))
    counts = hashed.groupBy("__cell").agg(F.count("*").alias("__k"))
    upto = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = counts.select("__cell", (F.sum("__k").over(upto) - F.col("__k")).alias("__before"), F.sum("__k").over(Window.partitionBy()).alias("__of"))
    inside = F.row_number().over(Window.partitionBy("__cell").orderBy("__hash", key))
    return hashed.join(F.broadcast(cells), "__cell").withColumn("__rank", F.col("__before") + inside).drop("__hash", "__cell", "__before")


def with_captions(samples: DataFrame, settings: CaptionSettings) -> DataFrame:
    return samples.withColumn("caption", text.caption(F.col("visible_ratio"), F.col("source_id"), settings)).withColumn("trigger_token", F.lit(settings.trigger))


def leaks(samples: DataFrame, evaluation: DataFrame) -> DataFrame:
    """One row: groups and clusters on both sides of the split, and eval images and groups in the release; nulls meet nothing."""
    def present(rows: DataFrame, key: str) -> DataFrame:
        return rows.filter(F.col(key).isNotNull()).select(key)

    def shared(key: str) -> DataFrame:
        return present(samples.filter("split = 'train'"), key).intersect(present(samples.filter("split = 'val'"), key)).agg(F.count("*").alias(f"shared_{key}"))

    def leaked(key: str) -> DataFrame:
        return present(samples, key).intersect(present(evaluation, key)).agg(F.count("*").alias(f"leaked_{key}"))

    parts = [shared("group_id"), shared("duplicate_cluster_id"), leaked("image_id"), leaked("group_id")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # single rows
    return out


def contamination(samples: DataFrame, benchmark: DataFrame, text_col: str = "caption") -> DataFrame:
    """Benchmark items that a text contains: (item_id, n_texts).

    Within a text the first and the last word of an item may be glued to what
    stands around them; the words between are words of the text. Both sides meet
    on hashes of runs of eight such words, or of all of them where an item has
    three to seven. A Bloom filter over the items' runs is asked in the scan, so
    only texts that hold a run of an item, or one in some thousands by chance,
    go on, and only such runs are shuffled; what meets is compared as text. Items
    with fewer words are looked for by Aho-Corasick automata of a bounded size.
    """
    most, least = 8, 3

    def split(c: str) -> Column:
        return F.split(F.trim(c), r"\s+")

    def run(words: Column, at: Column, n: int) -> Column:
        return F.xxhash64(F.lit(n), *[F.get(words, at + F.lit(k)) for k in range(n)])

    def runs(words: Column, n: int) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: run(words, i, n))
        return F.when(F.size(words) >= n, found).otherwise(F.array().cast("array<bigint>"))

    items = benchmark.select("item_id", F.col("text").alias("__item"), split("text").alias("__w")).withColumn("__n", F.least(F.size("__w") - 2, F.lit(most))).filter("__item IS NOT NULL")
    texts = samples.select(F.col(text_col).alias("__text")).filter("__text IS NOT NULL")
    # One row for each length from 3 to 8 at most, and one for what is shorter.
    counts = {r[0]: r[1] for r in items.groupBy(F.greatest("__n", F.lit(least - 1))).count().collect()}
    lengths = sorted(n for n in counts if n >= least)
    parts = []
    if lengths:
        probe = F.coalesce(*[F.when(F.col("__n") == n, run(F.col("__w"), F.lit(1), n)) for n in lengths])
        probes = cut(items.filter(F.col("__n") >= least).select("item_id", "__item", probe.alias("__g")), "probes")
        might = bloom.might_contain(probes.select("__g"), "__g", sum(counts[n] for n in lengths))
        held = F.filter(F.concat(*[runs(F.col("__w"), n) for n in lengths]), might)
        # The row number keeps Spark from filtering below, where it would split the text anew for each word.
        found = texts.withColumn("__w", split("__text")).select("__text", F.array_distinct(held).alias("__gs"), F.monotonically_increasing_id().alias("__row"))
        found = cut(found.filter(F.size("__gs") > 0), "texts")
        met = found.select("__row", F.explode("__gs").alias("__g")).join(probes, "__g").select("__row", "item_id", "__item")
        hits = found.select("__row", "__text").join(met, "__row").filter(F.contains("__text", F.col("__item")))
        parts.append(hits.groupBy("item_id").agg(F.count("*").alias("n_texts")))
    if least - 1 in counts:
        parts.append(phrases.texts_with(texts, "__text", items.filter(F.col("__n") < least), "item_id", "__item"))
    if not parts:
        return items.select("item_id", F.lit(0).cast("bigint").alias("n_texts"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).groupBy("item_id").agg(F.sum("n_texts").alias("n_texts"))


def content_hash(df: DataFrame) -> DataFrame:
    """One hash over all rows, whatever their order and their files."""
    row = F.xxhash64(*df.columns)
    sums = df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"), F.bit_xor(row).alias("x"))
    return sums.select("n", F.sha2(F.concat_ws("|", F.col("n"), F.col("s"), F.col("x")).cast("binary"), 256).alias("manifest_hash"))


def validation(samples: DataFrame, trigger: str, crops: DataFrame | None = None) -> DataFrame:
    """One row of release statistics; with a listing of ``crop_path`` also the crops that are missing."""
    has = F.contains(F.coalesce("caption", F.lit("")), F.lit(trigger))
    blank = F.trim(F.coalesce("caption", F.lit(""))) == ""
    out = samples.agg(
        F.count("*").alias("n"), F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "val").alias("n_val"),
        F.count_if(~has).alias("without_trigger"), F.count_if(blank).alias("blank_captions"), F.countDistinct("group_id").alias("n_groups"),
        F.lit(trigger == "").alias("no_trigger"),
    )
    if crops is None:
        return out.withColumn("missing_crops", F.lit(0).cast("bigint"))
    lost = samples.select("crop_path").join(crops.select("crop_path"), "crop_path", "left_anti")
    return out.crossJoin(lost.agg(F.count("*").alias("missing_crops")))  # single rows


def status(report: DataFrame, leak_row: DataFrame) -> DataFrame:
    """Errors of a release and its status: ``validated`` without errors."""
    both = report.crossJoin(leak_row)  # single rows
    errors = F.concat_ws(
        "; ",
        F.when(F.col("no_trigger"), "trigger_token is empty"),
        F.when((F.col("without_trigger") > 0) & ~F.col("no_trigger"), "captions without trigger"), F.when(F.col("blank_captions") > 0, "blank captions"),
        F.when(F.col("n_train") == 0, "lora_train is empty"), F.when(F.col("n_val") == 0, "lora_val is empty"),
        F.when(F.col("missing_crops") > 0, "crop files missing"),
        F.when(F.col("shared_group_id") > 0, "group_id overlap"), F.when(F.col("shared_duplicate_cluster_id") > 0, "duplicate cluster overlap"),
        F.when((F.col("leaked_image_id") > 0) | (F.col("leaked_group_id") > 0), "eval rows leaked into the release"),
    )
    return both.withColumn("errors", errors).withColumn("status", F.when(F.col("errors") == "", "validated").otherwise("draft"))


def eval_cases(images: DataFrame, instances: DataFrame, ratio: float = 0.5, seed: int = 7, names: tuple[str, str] = ("dev", "final")) -> DataFrame:
    """Frozen cases of the eval images: id, paths, mask rectangle, box and set, by disjoint groups.

    ``images`` are those of the eval splits, with width and height. The mask is
    the box grown by 8 % of its longer side; under 4 pixels the case drops out.
    An image without a group is in the first set.
    """
    sets = split_groups(images.filter("group_id IS NOT NULL").select("group_id").distinct(), ratio, seed, names, out="eval_set")
    joined = instances.join(images.select("image_id", "source_id", F.col("split").alias("source_split"), "group_id", "width", "height"), "image_id").join(sets, "group_id", "left")
    box = geo.Box.xywh(*(F.col(c).cast("double") for c in "xywh"))
    mask = geo.dilated(box, F.col("width"), F.col("height"))
    case = text.stable_id(F.col("source_id"), F.col("source_split"), F.col("instance_id"))
    out = joined.filter((mask.width >= 4) & (mask.height >= 4)).select(
        case.alias("case_id"), "image_id", "group_id", *mask.columns("m_"), F.array(*box).alias("expected_bbox_xyxy"), "source_split", F.coalesce("eval_set", F.lit(names[0])).alias("eval_set"), F.lit(True).alias("frozen")
    )
    paths = {f"{k}_path": F.concat(F.lit(f"{folder}/"), F.col("case_id"), F.lit(".png")) for k, folder in (("image", "images"), ("mask", "masks"), ("reference", "reference"))}
    return out.withColumns(paths)


def changed_pairs(pairs: DataFrame, least: int = 64, limit: int | None = None) -> DataFrame:
    """Pairs with enough changed pixels, and their case ids: pair ids and the place among those kept.

    ``pairs`` has pair_seq, img_id, ann_id and ``changed`` (see ``pixels.change_masks``).
    The places are counted over the pairs that are kept, by ranges of the order.
    """
    kept = pairs.filter(F.col("changed") >= least)
    if limit is not None:
        kept = kept.orderBy("pair_seq").limit(limit)
    numbered = ranked_in_order(kept, "pair_seq").withColumn("kept", F.col("__rank") - 1).drop("__rank")
    return numbered.withColumn("case_id", text.stable_id(F.lit("pipe"), F.col("img_id"), F.col("ann_id"), F.col("kept")))


def first_changed_pairs(pairs: DataFrame, masks: Callable[[DataFrame], DataFrame], n: int, least: int = 64, batch: int | None = None) -> DataFrame:
    """The first ``n`` pairs in the order of ``pair_seq`` that have enough changed pixels, numbered as by ``changed_pairs``.

    Ranges of the order are read in growing batches until ``n`` are kept, so that
    ``masks`` (see ``pixels.change_masks``; it has to keep pair_seq, img_id and
    ann_id) is asked for little more than what is needed. ``pair_seq`` is a
    number or text and unique; a range of it is a filter that files can skip by.
    """
    order = cut(ranked_in_order(pairs.select("pair_seq"), "pair_seq"), "order")
    total, begin, size, kept, found = order.count(), 1, batch or max(64, 2 * n), 0, None
    while kept < n and begin <= total:
        ends = order.filter(F.col("__rank").between(begin, begin + size - 1)).agg(F.min("pair_seq").alias("low"), F.max("pair_seq").alias("high")).first()
        own = masks(pairs.filter(F.col("pair_seq").between(ends.low, ends.high)))
        own = cut(own.filter(F.col("changed") >= least), "changed")
        kept, found = kept + own.count(), own if found is None else found.unionByName(own)
        begin, size = begin + size, 2 * size
    return changed_pairs(masks(pairs.limit(0)) if found is None else found, least, n)


def ranked_in_order(rows: DataFrame, order: str) -> DataFrame:
    """Adds ``__rank``, the place in the order of a column: range partitions are counted, and each is numbered by itself."""
    ranged = cut(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__k"))
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    before = counts.select("__part", (F.sum("__k").over(upto) - F.col("__k")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return ranged.join(F.broadcast(before), "__part").withColumn("__rank", F.col("__before") + inside).drop("__part", "__before")


def stage_statistics(groups: DataFrame, samples: DataFrame) -> DataFrame:
    """One row: images, duplicates, clusters and groups of the dedupe table, samples and median caption tokens."""
    a = groups.agg(
        F.count("*").alias("n_images"), F.count_if(F.col("dedupe_status") != "unique").alias("n_duplicates"),
        F.countDistinct("duplicate_cluster_id").alias("n_clusters"), F.countDistinct("group_id").alias("n_groups"),
    )
    tokens = percentiles(samples.select(text.n_tokens(F.col("caption")).alias("n")), {"n": [0.5]})
    b = samples.agg(F.count("*").alias("n_samples"), F.lit(tokens["n", 0.5]).cast("double").alias("median_tokens"))
    return a.crossJoin(b)  # single rows


def record_counts(records: DataFrame) -> DataFrame:
    """Rows by split and bucket, by split, and of all."""
    return records.rollup("split", "bucket").agg(F.count("*").alias("n"))
