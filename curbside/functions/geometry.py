"""Box expressions. A box is four columns: x1, y1, x2, y2."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        """The columns prefix + x1, y1, x2, y2."""
        return cls(*(F.col(prefix + c) for c in ("x1", "y1", "x2", "y2")))

    @classmethod
    def xywh(cls, x: Column, y: Column, w: Column, h: Column) -> Box:
        return cls(x, y, x + w, y + h)

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for c, n in zip(self, ("x1", "y1", "x2", "y2"), strict=True)]


def _floor0(c: Column) -> Column:
    return F.greatest(c, F.lit(0))


def from_centre(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """Normalised centre box to pixel x, y, w, h."""
    return (cx - w / 2) * width, (cy - h / 2) * height, w * width, h * height


def area(b: Box) -> Column:
    return _floor0(b.width) * _floor0(b.height)


def intersection(a: Box, b: Box) -> Column:
    """Area that both cover; null when either is missing."""
    both = _floor0(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) * _floor0(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))
    return F.when(a.x1.isNotNull() & b.x1.isNotNull(), both)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, the union at least 1."""
    both = intersection(a, b)
    return both / F.greatest(area(a) + area(b) - both, F.lit(1))


def overlap_ratios(a: Box, b: Box) -> tuple[Column, Column, Column]:
    """Share of a, of b and of the smaller that both cover; areas at least 1."""
    both, one, two = intersection(a, b), F.greatest(area(a), F.lit(1)), F.greatest(area(b), F.lit(1))
    return both / one, both / two, both / F.least(one, two)


def clamp(b: Box, width: Column, height: Column) -> Box:
    """Half-even rounded box within the image, one pixel wide and high at least."""
    r = Box(*(F.rint(c) for c in b))
    x1, y1 = F.greatest(F.lit(0), F.least(width - 1, r.x1)), F.greatest(F.lit(0), F.least(height - 1, r.y1))
    return Box(x1, y1, F.greatest(x1 + 1, F.least(width, r.x2)), F.greatest(y1 + 1, F.least(height, r.y2)))


def centre_crop(b: Box, width: Column, height: Column, side: int) -> Box:
    """The box after the image's short side is scaled to ``side`` and its centre is cropped; nulls where the crop leaves nothing of it."""
    scale = F.lit(float(side)) / F.least(width, height)
    left, top = (F.floor((F.rint(c * scale) - side) / 2) for c in (width, height))
    moved = Box(b.x1 * scale - left, b.y1 * scale - top, b.x2 * scale - left, b.y2 * scale - top)
    inside = (moved.x2 > 0) & (moved.x1 < side) & (moved.y2 > 0) & (moved.y1 < side)
    return Box(*(F.when(inside, c) for c in clamp(moved, F.lit(side), F.lit(side))))


def around(boxes: DataFrame, by: str = "image_id") -> DataFrame:
    """The box around all boxes of each image."""
    return boxes.groupBy(by).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def visible(b: Box) -> Column:
    return (b.x2 > b.x1) & (b.y2 > b.y1)


def context_window(b: Box, width: Column, height: Column, margin: float) -> Box:
    """Box grown by a share of its sides, cut at the image, in whole pixels."""
    dx, dy = b.width * margin, b.height * margin
    return Box(
        F.greatest(F.lit(0.0), b.x1 - dx).cast("int"), F.greatest(F.lit(0.0), b.y1 - dy).cast("int"),
        F.least(width.cast("double"), b.x2 + dx).cast("int"), F.least(height.cast("double"), b.y2 + dy).cast("int"),
    )


def crop_size(window: Box, max_side: int, min_side: int) -> tuple[Column, Column]:
    """Width and height of a crop after its longest side is brought between the limits."""
    w, h = window.width.cast("double"), window.height.cast("double")
    longest = F.greatest(w, h)
    down = F.when(longest > max_side, max_side / longest).otherwise(1.0)
    w, h = F.when(longest > max_side, F.greatest(F.lit(1), (w * down).cast("int"))).otherwise(w), F.when(longest > max_side, F.greatest(F.lit(1), (h * down).cast("int"))).otherwise(h)
    again = F.greatest(w, h)
    up = F.lit(float(min_side)) / again
    grow = lambda c: F.when(again < min_side, F.greatest(F.lit(1), (c * up).cast("int"))).otherwise(c).cast("int")
    return grow(w), grow(h)


def dilated(b: Box, width: Column, height: Column, share: float = 0.08) -> Box:
    """Mask rectangle: box grown by int(share * longer side), cut at the image."""
    pad = (F.greatest(b.width, b.height) * share).cast("int")
    return Box(F.greatest(F.lit(0), (b.x1 - pad).cast("int")), F.greatest(F.lit(0), (b.y1 - pad).cast("int")), F.least(width, (b.x2 + pad).cast("int")), F.least(height, (b.y2 + pad).cast("int")))


def with_context(b: Box, side: int, ratio: float = 0.18, least: int = 128) -> Box:
    """Box grown by a share of its longer side, then to a least patch size on each axis."""
    w = F.lit(side)
    pad = (F.greatest(b.width, b.height) * ratio).cast("int")
    b = clamp(Box(b.x1 - pad, b.y1 - pad, b.x2 + pad, b.y2 + pad), w, w)
    more = F.when(b.width < least, F.floor((least - b.width) / 2)).otherwise(0)
    b = clamp(Box(b.x1 - more, b.y1, b.x2 + more, b.y2), w, w)
    more = F.when(b.height < least, F.floor((least - b.height) / 2)).otherwise(0)
    return clamp(Box(b.x1, b.y1 - more, b.x2, b.y2 + more), w, w)


def scaled(b: Box, width: Column, height: Column, factor: float) -> Box:
    """Box scaled about its centre."""
    cx, cy, w, h = (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2, b.width * factor / 2, b.height * factor / 2
    return clamp(Box(cx - w, cy - h, cx + w, cy + h), width, height)


def square_window(b: Box, width: Column, height: Column, ratio: float = 3.4, least: int = 192) -> Box:
    """Square around a box, ``ratio`` times its longer side and ``least`` at the least, in whole pixels and moved into the image."""
    side = F.least(F.floor(F.greatest(F.lit(float(least)), b.width * ratio, b.height * ratio)), width, height)
    x = F.greatest(F.lit(0), F.least(width - side, F.rint((b.x1 + b.x2) / 2 - side / 2)))
    y = F.greatest(F.lit(0), F.least(height - side, F.rint((b.y1 + b.y2) / 2 - side / 2)))
    return Box(x, y, x + side, y + side)


def into_window(b: Box, window: Box, side: int) -> Box:
    """A box in the whole pixels of a window that is resized to ``side``."""
    sx, sy = (side / F.greatest(F.lit(1), c) for c in (window.width, window.height))
    return Box(*(F.rint(c) for c in ((b.x1 - window.x1) * sx, (b.y1 - window.y1) * sy, (b.x2 - window.x1) * sx, (b.y2 - window.y1) * sy)))


def foot_band(b: Box) -> Box:
    """The lowest 16 % of a box, 4 pixels at least."""
    band = F.greatest(F.lit(4), (b.height * 0.16).cast("int"))
    return Box(b.x1, F.greatest(b.y1, b.y2 - band), b.x2, b.y2)


def touches_border(b: Box, width: Column, height: Column, margin: int = 3) -> Column:
    """Whether a box comes within ``margin`` of the border; a missing box does."""
    return F.coalesce((b.x1 <= margin) | (b.y1 <= margin) | (b.x2 >= width - margin) | (b.y2 >= height - margin), F.lit(True))


def depth_order_ok(front: Box, behind: Box, most: float = 0.08, height_ratio: float = 0.68, foot_delta: float = 0.0) -> tuple[Column, Column]:
    """(allowed, overlap): overlap is fine where the box behind is smaller, higher up and hardly covered."""
    both = intersection(front, behind)
    overlap = both / F.least(F.greatest(area(front), F.lit(1)), F.greatest(area(behind), F.lit(1)))
    tall, short = F.greatest(front.height, F.lit(1)), F.greatest(behind.height, F.lit(1))
    ok = (overlap <= most) & (tall > short) & (short <= tall * height_ratio) & (front.y2 >= behind.y2 - foot_delta) & (behind.y2 <= front.y2 + foot_delta)
    apart = F.coalesce(both, F.lit(0.0)) <= 0
    return F.when(apart, True).otherwise(ok), F.when(apart, 0.0).otherwise(overlap)
