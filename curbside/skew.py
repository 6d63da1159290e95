"""Joins of a large table with one row per key, where a few keys hold much of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is hot with more than this share of the rows, so there are fewer than 1000 hot keys.
HOT_SHARE = 0.001


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, count: str, by: str, how: str = "inner", pieces: int = 64, total: int | None = None) -> DataFrame:
    """``rows`` joined on ``key`` with ``per_key``, which has one row per key and in ``count`` the rows it stands for.

    Hot keys, whose number ``HOT_SHARE`` bounds, are broadcast; their rows are
    dealt to ``pieces`` places by a hash of the column ``by``, and their row of
    ``per_key`` goes to each. Null keys meet nothing and are dealt like hot ones.
    ``count`` is not in the result. ``total``, the number of rows, is counted where it isn't given.
    """
    if total is None:
        total = per_key.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > total * HOT_SHARE
    keys = per_key.filter(hot).select(F.col(key).alias("__hot"))
    left = rows.join(F.broadcast(keys), F.col(key) == F.col("__hot"), "left")
    apart = F.col("__hot").isNotNull() | F.col(key).isNull()
    left = left.withColumn("__place", F.when(apart, F.pmod(F.xxhash64(by), F.lit(pieces))).otherwise(0).cast("int")).drop("__hot")
    places = F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(pieces - 1))).otherwise(F.array(F.lit(0))))
    right = per_key.withColumn("__place", places).drop(count)
    return left.join(right, [key, "__place"], how).drop("__place")


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, pieces: int = 64, least: int = 1000) -> DataFrame:
    """Inner join on ``keys`` of two tables with many rows per key, where a few keys hold much of ``left``.

    The rows of ``left`` under a hot key, one with more than ``HOT_SHARE`` of all
    and ``least`` rows, are dealt to ``pieces`` places by a hash of the column
    ``by``; what ``right`` has under it goes to each. Null keys meet nothing.
    Neither side is broadcast: Spark doesn't see how many rows an explode makes.
    """
    counts = left.groupBy(keys).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    hot = F.broadcast(counts.filter(F.col("__n") > max(least, int(total * HOT_SHARE))).select(*keys, F.lit(True).alias("__hot")))
    place = F.when(F.col("__hot"), F.pmod(F.xxhash64(by), F.lit(pieces))).otherwise(0).cast("int")
    places = F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(pieces - 1))).otherwise(F.array(F.lit(0))))
    a = left.join(hot, keys, "left").withColumn("__place", place).drop("__hot")
    b = right.join(hot, keys, "left").withColumn("__place", places).drop("__hot")
    return a.join(b.hint("merge"), [*keys, "__place"]).drop("__place")
