"""Jobs over image and mask rows: numpy on Arrow batches, one row at a time.

Images are (width, height, data) with three bytes a pixel, masks (width, height,
mask) with one. A missing or ill-sized mask counts as empty. Rows with a column
``channels`` are as ``images.pictures`` reads them from files: one, three or four
bytes a pixel, blue first.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def _image(data, width, height) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(int(height), int(width), 3)


def _read(r) -> np.ndarray:
    """The picture of a row in red, green, blue, whether it comes from a table or from a file."""
    if getattr(r, "channels", None) is None:
        return _image(r.data, r.width, r.height)
    own = np.frombuffer(r.data, np.uint8).reshape(int(r.height), int(r.width), int(r.channels))
    return np.repeat(own, 3, axis=2) if r.channels == 1 else own[:, :, 2::-1]


def _luma(picture: np.ndarray) -> np.ndarray:
    """Gray values by the usual weights of red, green and blue, in 16 bits of fixed point."""
    return ((picture.astype(np.int64) @ np.array([19595, 38470, 7471]) + 0x8000) >> 16).astype(float)


def _mask(data, width, height) -> np.ndarray:
    if data is None or width is None or height is None or len(data) != int(width) * int(height):
        return np.zeros((0, 0), np.uint8)
    return np.frombuffer(data, np.uint8).reshape(int(height), int(width))


def map_rows(df: DataFrame, fn: Callable[[object], dict], columns: str, keep: list[str]) -> DataFrame:
    """Columns that ``fn`` computes for each row, beside those to keep."""
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), columns])
    computed = to_arrow_schema(StructType.fromDDL(columns))
    row = namedtuple("row", df.columns, rename=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            found = [fn(row(*v)) for v in values]
            made = [pa.array([f[field.name] for f in found], field.type) for field in computed]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, *computed.names])

    return df.mapInArrow(work, schema)


def dilate(mask: np.ndarray, px: int) -> np.ndarray:
    """Largest value of each (2 px + 1) square."""
    for axis in (0, 1):
        padded = np.pad(mask, [(px, px) if a == axis else (0, 0) for a in (0, 1)])
        mask = np.lib.stride_tricks.sliding_window_view(padded, 2 * px + 1, axis=axis).max(-1) if px and mask.size else mask
    return mask


def erode(mask: np.ndarray, px: int) -> np.ndarray:
    return 255 - dilate(255 - mask, px)


def box_of(on: np.ndarray, inclusive: bool = False) -> tuple | None:
    """x1, y1, x2, y2 of what is set; the far edge is one beyond unless ``inclusive``."""
    ys, xs = np.nonzero(on)
    if not len(ys):
        return None
    far = 0 if inclusive else 1
    return int(xs.min()), int(ys.min()), int(xs.max()) + far, int(ys.max()) + far


def change_masks(pairs: DataFrame, threshold: int = 25, dilate_px: int = 0, keep: list[str] | None = None) -> DataFrame:
    """Mask of what differs between source and target, its size and its box (inclusive edges)."""

    def one(r) -> dict:
        diff = np.abs(_image(r.target, r.width, r.height).astype(int) - _image(r.source, r.width, r.height)).max(2) > threshold
        mask = dilate(diff.astype(np.uint8) * 255, dilate_px)
        x1, y1, x2, y2 = box_of(mask > 0, inclusive=True) or (None,) * 4
        return {"mask": mask.tobytes(), "changed": int((mask > 0).sum()), "x1": x1, "y1": y1, "x2": x2, "y2": y2}

    return map_rows(pairs, one, "mask binary, changed long, x1 double, y1 double, x2 double, y2 double", keep or ["pair_id"])


def mask_figures(masks: DataFrame, threshold: int = 10, keep: list[str] | None = None) -> DataFrame:
    """Box and pixels above ``threshold``, their share of the box and of the image, the opaque share, and row coverage of three vertical bands.

    The area share counts pixels above 0.20, the opaque share those above 0.72
    among those above 0.04 (null without any). Bands are cut from the row's box
    d_x1..d_y2, that of a detection, or without one from the mask's own; with a
    box that is off the image they are null.
    """
    given = "d_x1" in masks.columns

    def one(r) -> dict:
        m = _mask(r.mask, r.width, r.height)
        on = m > threshold
        box = box_of(on)
        out = dict(zip(("x1", "y1", "x2", "y2"), box or (None,) * 4, strict=True))
        x1, y1, x2, y2 = (max(0, int(round(v))) for v in (r.d_x1, r.d_y1, r.d_x2, r.d_y2)) if given else box or (0, 0, 0, 0)
        crop = on[y1:y2, x1:x2]
        bands = [float(b.any(1).mean()) if b.size else 0.0 for b in np.array_split(crop, 3, axis=0)] if crop.size else [None] * 3
        soft, n = m > 0.04 * 255, int(on.sum())
        size = max(1, (box[2] - box[0]) * (box[3] - box[1])) if box else 1
        out |= {"active": n, "box_share": n / size, "area_share": float((m > 0.20 * 255).mean()) if m.size else 0.0, "opaque_share": float((m[soft] > 0.72 * 255).mean()) if soft.any() else None}
        return out | dict(zip(("top", "middle", "low"), bands, strict=True))

    return map_rows(masks, one, "x1 double, y1 double, x2 double, y2 double, active long, box_share double, area_share double, opaque_share double, top double, middle double, low double", keep or ["image_id"])


def _clamped(box: tuple, width: int, height: int) -> tuple[int, int, int, int]:
    x1, y1, x2, y2 = (int(round(v)) for v in box)
    x1, y1 = max(0, min(width - 1, x1)), max(0, min(height - 1, y1))
    return x1, y1, max(x1 + 1, min(width, x2)), max(y1 + 1, min(height, y2))


def coverage(masks: DataFrame, keep: list[str], padding: float = 0.12, least: int = 6) -> DataFrame:
    """Mean of a 0-255 mask within the row's box x1..y2, as a share, and the share of the mask (above 0.20) outside the padded box.

    An empty mask covers nothing and is all outside.
    """

    def one(r) -> dict:
        m = _mask(r.mask, r.width, r.height)
        if not m.size:
            return {"coverage": 0.0, "outside": 1.0}
        box = (r.x1, r.y1, r.x2, r.y2)
        x1, y1, x2, y2 = _clamped(box, m.shape[1], m.shape[0])
        active, pad = m > 0.20 * 255, max(least, int(round(max(r.x2 - r.x1, r.y2 - r.y1) * padding)))
        p1, q1, p2, q2 = _clamped((r.x1 - pad, r.y1 - pad, r.x2 + pad, r.y2 + pad), m.shape[1], m.shape[0])
        total = int(active.sum())
        return {"coverage": float(m[y1:y2, x1:x2].mean() / 255), "outside": 1 - int(active[q1:q2, p1:p2].sum()) / total if total else 1.0}

    return map_rows(masks, one, "coverage double, outside double", keep)


def background(pairs: DataFrame, dilate_px: int = 8, keep: list[str] | None = None) -> DataFrame:
    """bg_mae and bg_ssim of two images outside the object, grown by ``dilate_px``.

    The object is the row's ``mask`` (above 127), without one its box x1..y2,
    without that its ``detections`` (arrays of x1, y1, x2, y2); where all are
    missing every pixel counts. With none left the MAE is 0 and the SSIM 1.
    """

    def one(r) -> dict:
        a, b = _image(r.source, r.width, r.height).astype(float), _image(r.target, r.width, r.height).astype(float)
        inside, boxes = np.zeros(a.shape[:2], bool), []
        if getattr(r, "mask", None) is not None:
            inside = _mask(r.mask, r.width, r.height) > 127
        elif r.x1 is not None and r.x1 == r.x1:
            boxes = [(r.x1, r.y1, r.x2, r.y2)]
        elif getattr(r, "detections", None) is not None:
            boxes = r.detections
        for x1, y1, x2, y2 in boxes:
            inside[max(0, int(y1)) : max(0, int(y2)), max(0, int(x1)) : max(0, int(x2))] = True
        outside = ~(dilate(inside.astype(np.uint8), dilate_px) > 0)
        if not outside.any():
            return {"bg_mae": 0.0, "bg_ssim": 1.0}
        mae = float(np.abs(a - b).mean(2)[outside].mean())
        x, y = a.mean(2)[outside], b.mean(2)[outside]
        c1, c2 = 2.55**2, 7.65**2
        mx, my, cov = x.mean(), y.mean(), ((x - x.mean()) * (y - y.mean())).mean()
        ssim = (2 * mx * my + c1) * (2 * cov + c2) / ((mx**2 + my**2 + c1) * (x.var() + y.var() + c2) + 1e-9)
        return {"bg_mae": mae, "bg_ssim": float(ssim)}

    return map_rows(pairs, one, "bg_mae double, bg_ssim double", keep or ["case_id"])


def tile_background(tiles: DataFrame, dilate_px: int = 8, key: str = "case_id") -> DataFrame:
    """bg_mae and bg_ssim of pictures that come in tiles, outside the object's box, grown by ``dilate_px``.

    Rows are (key, left, top, width, height, source, target, x1..y2): a tile, its
    place in the picture, and the box in the picture's coordinates; without one
    every pixel counts. A tile gives exact integer sums of its pixels, squares and
    products, and Spark adds them by picture, however many tiles it has.
    """
    sums = ["n", "diff", "a", "b", "aa", "bb", "ab"]

    def one(r) -> dict:
        a, b = (_image(d, r.width, r.height).astype(np.int64) for d in (r.source, r.target))
        outside = np.ones(a.shape[:2], bool)
        if r.x1 is not None and r.x1 == r.x1:
            x1, y1, x2, y2 = (max(0, int(v)) for v in (r.x1, r.y1, r.x2, r.y2))
            if x2 > x1 and y2 > y1:
                rows, columns = (slice(max(0, low - dilate_px - at), max(0, high + dilate_px - at)) for low, high, at in ((y1, y2, int(r.top)), (x1, x2, int(r.left))))
                outside[rows, columns] = False
        x, y = a.sum(2)[outside], b.sum(2)[outside]  # three times the gray value
        return dict(zip(sums, map(int, (outside.sum(), np.abs(a - b).sum(2)[outside].sum(), x.sum(), y.sum(), (x * x).sum(), (y * y).sum(), (x * y).sum())), strict=True))

    per = map_rows(tiles, one, ", ".join(f"{s} long" for s in sums), [key]).groupBy(key).agg(*[F.sum(s).alias(s) for s in sums])
    n = F.nullif("n", F.lit(0))
    ma, mb = F.col("a") / (3 * n), F.col("b") / (3 * n)
    va, vb, ab = F.col("aa") / (9 * n) - ma * ma, F.col("bb") / (9 * n) - mb * mb, F.col("ab") / (9 * n) - ma * mb
    c1, c2 = 2.55**2, 7.65**2
    ssim = (2 * ma * mb + c1) * (2 * ab + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2) + 1e-9)
    return per.select(key, F.coalesce(F.col("diff") / (3 * n), F.lit(0.0)).alias("bg_mae"), F.coalesce(ssim, F.lit(1.0)).alias("bg_ssim"))


def masked_mae(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """Mean absolute difference under a mask (above 0.20), 0 to 1 and 0 to 255; 0 for an empty mask."""

    def one(r) -> dict:
        on = _mask(r.mask, r.width, r.height) > 0.20 * 255
        if not on.any():
            return {"mae": 0.0, "mae255": 0.0}
        diff = np.abs(_image(r.source, r.width, r.height).astype(float) - _image(r.target, r.width, r.height))[on].mean()
        return {"mae": float(diff / 255), "mae255": float(diff)}

    return map_rows(pairs, one, "mae double, mae255 double", keep)


def edge_scores(pairs: DataFrame, keep: list[str], px: int = 2) -> DataFrame:
    """How little the brightness steps across a mask's border, and how sharp the border is, both 0 to 1.

    The inner rim is read from ``target``, the outer one from ``source``; without
    either rim the step is 1 and the sharpness 0.
    """

    def one(r) -> dict:
        m = _mask(r.mask, r.width, r.height)
        on, a, b = m > 8, _image(r.source, r.width, r.height).astype(float), _image(r.target, r.width, r.height).astype(float)
        inner = on & ~(erode(on.astype(np.uint8) * 255, px) > 0)
        outer = (dilate(on.astype(np.uint8) * 255, px) > 0) & ~on
        if not inner.any() or not outer.any():
            return {"edge_contrast": 1.0, "edge_laplacian": 0.0}
        luma = np.asarray([0.2126, 0.7152, 0.0722])
        step = abs((b @ luma)[inner].mean() - (a @ luma)[outer].mean())
        gray = b.mean(2)
        lap = np.abs(sum(np.roll(gray, s, k) for k in (0, 1) for s in (1, -1)) - 4 * gray)
        return {"edge_contrast": float(np.clip(1 - step / 96, 0, 1)), "edge_laplacian": float(np.clip(lap[inner | outer].mean() / 48, 0, 1))}

    return map_rows(pairs, one, "edge_contrast double, edge_laplacian double", keep)


def perceptual_hash(images: DataFrame, keep: list[str]) -> DataFrame:
    """64-bit hash of the low frequencies of a 32 x 32 gray image: ``phash`` (16 hexadecimal digits) and ``h``.

    A bit tells whether a frequency is above their median, both in thousandths,
    so that frequencies that are equal but for the order of additions stay equal.
    """
    k = np.arange(32)
    dct = np.cos(np.pi / 32 * (k[None, :] + 0.5) * k[:, None])

    def one(r) -> dict:
        if r.data is None or not r.width or not r.height or r.width < 0:
            return {"phash": "", "h": None}
        gray = _luma(_read(r))
        ys, xs = (np.linspace(0, n, 33).astype(int) for n in gray.shape)
        sums = np.pad(gray.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        y0, y1, x0, x1 = ys[:-1], np.maximum(ys[1:], ys[:-1] + 1).clip(max=gray.shape[0]), xs[:-1], np.maximum(xs[1:], xs[:-1] + 1).clip(max=gray.shape[1])
        y0, x0 = np.minimum(y0, y1 - 1), np.minimum(x0, x1 - 1)
        small = (sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]) / np.outer(y1 - y0, x1 - x0)
        low = np.floor((dct @ small @ dct.T)[:8, :8].ravel() * 1000 + 0.5)
        value = int("".join("1" if above else "0" for above in low > np.median(low)), 2)
        return {"phash": f"{value:016x}", "h": value - (1 << 64) if value >> 63 else value}

    return map_rows(images, one, "phash string, h bigint", keep)


def _shares(size: int, out: int) -> np.ndarray:
    """Share of each of ``size`` pixels in each of ``out``: rows of ones, dealt by overlap."""
    edges = np.linspace(0, size, out + 1)
    at = np.arange(size)
    both = np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at)
    return np.maximum(both, 0) * out / size


def crop_pixels(images: DataFrame, keep: list[str]) -> DataFrame:
    """The window x1..y2 of each image, resized to out_width x out_height by area sampling, as raw pixels."""

    def one(r) -> dict:
        crop = _read(r)[int(r.y1) : int(r.y2), int(r.x1) : int(r.x2)].astype(float)
        ys, xs = _shares(crop.shape[0], int(r.out_height)), _shares(crop.shape[1], int(r.out_width))
        return {"crop": np.floor(np.einsum("yi,ijc,xj->yxc", ys, crop, xs) + 0.5).astype(np.uint8).tobytes()}

    return map_rows(images, one, "crop binary", keep)


def class_masks(maps: DataFrame, valid: set[int], avoid: set[int], keep: list[str]) -> DataFrame:
    """Masks of valid and of avoided ground from a map of class ids."""

    def one(r) -> dict:
        ids = _mask(r.classes, r.width, r.height)
        return {name: (np.isin(ids, list(which)).astype(np.uint8) * 255).tobytes() for name, which in (("valid", valid), ("avoid", avoid))}

    return map_rows(maps, one, "valid binary, avoid binary", keep)


def occluded_share(masks: DataFrame, keep: list[str], most: float = 0.55) -> DataFrame:
    """Share of a mask (above 8) under the row's occluder boxes (array of x1, y1, x2, y2); ``skipped`` above ``most``."""

    def one(r) -> dict:
        m = _mask(r.mask, r.width, r.height) > 8
        under = np.zeros_like(m)
        for x1, y1, x2, y2 in r.occluders if r.occluders is not None else []:
            under[max(0, int(y1)) : max(0, int(y2)), max(0, int(x1)) : max(0, int(x2))] = True
        share = float((m & under).sum() / m.sum()) if m.any() else 0.0
        return {"occluded": share, "skipped": share > most}

    return map_rows(masks, one, "occluded double, skipped boolean", keep)
