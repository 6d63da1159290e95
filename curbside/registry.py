"""Where queries are registered, with the tables that they share as text of both SQL dialects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curbside.plans import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WITH = f"WITH images AS ({tables.IMAGES}), inst AS ({tables.INSTANCES}), reg AS ({tables.REGISTRY})"
EVENTS = f"WITH ev AS ({tables.EVENTS})"
BOX = ["x1", "y1", "x2", "y2"]
KEYS = ["image_id", "det_idx", "p", "s"]


def query(sql: str | None = None):
    """Registers a function under its name."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clamp_sql(x1: str, y1: str, x2: str, y2: str, width: str, height: str) -> list[str]:
    """SQL of a box that is rounded half to even and held within an image."""
    a, b = (f"greatest(0, least({w} - 1, round_even({c}, 0)))" for c, w in ((x1, width), (y1, height)))
    return [a, b, f"greatest({a} + 1, least({width}, round_even({x2}, 0)))", f"greatest({b} + 1, least({height}, round_even({y2}, 0)))"]


def inter_sql(a: str, b: str) -> str:
    """SQL of the area that two boxes share, by their prefixes."""
    return f"(greatest(least({a}x2, {b}x2) - greatest({a}x1, {b}x1), 0) * greatest(least({a}y2, {b}y2) - greatest({a}y1, {b}y1), 0))"


def area_sql(a: str) -> str:
    return f"(greatest({a}x2 - {a}x1, 0) * greatest({a}y2 - {a}y1, 0))"


def depth_sql(a: str, b: str) -> tuple[str, str]:
    """SQL of (allowed, overlap) of a box before another."""
    both = inter_sql(a, b)
    share = f"({both} / least(greatest({area_sql(a)}, 1), greatest({area_sql(b)}, 1)))"
    tall, short = f"greatest({a}y2 - {a}y1, 1)", f"greatest({b}y2 - {b}y1, 1)"
    ok = f"({share} <= 0.08 AND {tall} > {short} AND {short} <= {tall} * 0.68 AND {a}y2 >= {b}y2 AND {b}y2 <= {a}y2)"
    return f"(CASE WHEN {both} <= 0 THEN true ELSE {ok} END)", f"(CASE WHEN {both} <= 0 THEN 0.0 ELSE {share} END)"
