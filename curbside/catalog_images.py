"""Registered queries of the jobs over pixels, on small gray pictures made from the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from curbside.operators import pixels
from curbside.registry import query, table

# The first 64 values of a vector as an 8 x 8 picture, and the next ones as another; i counts the pixels from 0.
_GRAY = "greatest(0, least(255, floor((embedding[{}]::DOUBLE + 0.5) * 256)))::INT"
_PX = f"""WITH px AS (SELECT vec_id, i, i % 8 AS x, i // 8 AS y, {_GRAY.format('i + 1')} AS a, {_GRAY.format('(i * 5 + 3) % 64 + 1')} AS b FROM embeddings, range(64) t(i)),
v AS (SELECT vec_id, vec_id % 5 AS x1, vec_id % 4 AS y1, vec_id % 5 + 3 AS x2, vec_id % 4 + 4 AS y2 FROM embeddings)"""


def _gray(order) -> F.Column:
    values = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("embedding", order(i)))
    return F.transform(values, lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 0.5) * 256))).cast("int"))


def _bytes(gray, repeat: int = 1) -> F.Column:
    return F.unhex(F.array_join(F.transform(gray, lambda v: F.repeat(F.lpad(F.hex(v), 2, "0"), F.lit(repeat))), ""))


def _pictures(spark, sf_dir) -> DataFrame:
    """vec_id, size, two pictures (source, target), both as masks (mask, classes), and a box."""
    a, b, k = _gray(lambda i: i), _gray(lambda i: (i * 5 + 3) % 64), F.col("vec_id")
    box = {"x1": k % 5, "y1": k % 4, "x2": k % 5 + 3, "y2": k % 4 + 4}
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), _bytes(a, 3).alias("source"), _bytes(b, 3).alias("target"), _bytes(a).alias("mask"), _bytes(F.transform(b, lambda v: v % 4)).alias("classes"),
        *[v.cast("double").alias(n) for n, v in box.items()],
    )


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(f"""{_PX}, o AS (SELECT px.*, NOT (x >= x1 - 1 AND x < x2 + 1 AND y >= y1 - 1 AND y < y2 + 1) AS outside FROM px JOIN v USING (vec_id)),
g AS (SELECT vec_id, avg(abs(a - b)) AS mae, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS ab FROM o WHERE outside GROUP BY vec_id)
SELECT vec_id AS case_id, round(mae, 6) AS bg_mae, round((2 * ma * mb + 6.5025) * (2 * ab + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225) + 1e-9::DOUBLE), 6) AS bg_ssim FROM g""")
def pixel_background(spark, sf_dir):
    """Difference and structural likeness of two pictures outside a grown box."""
    rows = _pictures(spark, sf_dir).withColumnRenamed("vec_id", "case_id").drop("mask")
    return _rounded(pixels.background(rows, 1), 6, "bg_mae", "bg_ssim")


@query(f"""{_PX}, o AS (SELECT px.*, CASE vec_id % 3 WHEN 0 THEN a > 127 ELSE x >= x1 AND x < x2 AND y >= y1 AND y < y2 END AS inside FROM px JOIN v USING (vec_id)),
g AS (SELECT vec_id, avg(abs(a - b)) FILTER (NOT inside) AS mae FROM o GROUP BY vec_id) SELECT vec_id AS case_id, round(coalesce(mae, 0), 6) AS bg_mae FROM g""")
def object_regions(spark, sf_dir):
    """Background difference where the object is a mask, a box or a list of detections."""
    k = F.col("case_id") % 3
    rows = _pictures(spark, sf_dir).withColumnRenamed("vec_id", "case_id")
    rows = rows.withColumn("detections", F.when(k == 2, F.array(F.array("x1", "y1", "x2", "y2")))).withColumn("mask", F.when(k == 0, F.col("mask"))).withColumns({c: F.when(k == 1, F.col(c)) for c in ("x1", "y1", "x2", "y2")})
    return pixels.background(rows, 0).select("case_id", F.round("bg_mae", 6).alias("bg_mae"))


@query(f"""{_PX}, d AS (SELECT p.vec_id, p.x, p.y, max(abs(q.a - q.b)) > 90 AS hit FROM px p JOIN px q ON p.vec_id = q.vec_id AND abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 GROUP BY ALL)
SELECT vec_id AS pair_id, count(*) FILTER (hit) AS changed, (min(x) FILTER (hit))::DOUBLE AS x1, (min(y) FILTER (hit))::DOUBLE AS y1, (max(x) FILTER (hit))::DOUBLE AS x2, (max(y) FILTER (hit))::DOUBLE AS y2 FROM d GROUP BY vec_id""")
def change_masks(spark, sf_dir):
    """Dilated mask of what differs between two pictures: its size and box."""
    return pixels.change_masks(_pictures(spark, sf_dir).drop("x1", "y1", "x2", "y2", "mask").withColumnRenamed("vec_id", "pair_id"), 90, 1).drop("mask")


@query(f"""{_PX}, m AS (SELECT px.*, a > 128 AS hit FROM px), b AS (SELECT vec_id, min(x) FILTER (hit) AS x1, min(y) FILTER (hit) AS y1, max(x) FILTER (hit) + 1 AS x2, max(y) FILTER (hit) + 1 AS y2, count(*) FILTER (hit) AS active, avg(CASE WHEN a > 51 THEN 1.0 ELSE 0 END) AS area_share,
 (count(*) FILTER (a > 183.6)) / nullif(count(*) FILTER (a > 10.2), 0)::DOUBLE AS opaque FROM m GROUP BY vec_id),
r AS (SELECT m.vec_id, m.y, bool_or(hit) AS any_hit FROM m JOIN v USING (vec_id) WHERE m.x >= v.x1 AND m.x < v.x2 AND m.y >= v.y1 AND m.y < v.y2 GROUP BY m.vec_id, m.y),
w AS (SELECT r.vec_id, avg(any_hit::INT) FILTER (r.y - v.y1 < 2) AS top, avg(any_hit::INT) FILTER (r.y - v.y1 = 2) AS middle, avg(any_hit::INT) FILTER (r.y - v.y1 = 3) AS low FROM r JOIN v USING (vec_id) GROUP BY r.vec_id)
SELECT vec_id, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2, active, round(active / greatest(1, coalesce((x2 - x1) * (y2 - y1), 1)), 6) AS box_share, round(area_share, 6) AS area_share, round(opaque, 6) AS opaque_share, top, middle, low FROM b JOIN w USING (vec_id)""")
def mask_figures(spark, sf_dir):
    """Box, pixels, shares and band coverage of a soft mask against a detection's box."""
    rows = _pictures(spark, sf_dir).withColumnsRenamed({c: "d_" + c for c in ("x1", "y1", "x2", "y2")})
    return _rounded(pixels.mask_figures(rows, 128, ["vec_id"]), 6, "box_share", "area_share", "opaque_share")


@query(f"""{_PX}, g AS (SELECT vec_id, avg(a) FILTER (x >= x1 AND x < x2 AND y >= y1 AND y < y2) / 255 AS cov, count(*) FILTER (a > 51) AS n, count(*) FILTER (a > 51 AND x >= x1 - 1 AND x < x2 + 1 AND y >= y1 - 1 AND y < y2 + 1) AS k FROM px JOIN v USING (vec_id) GROUP BY vec_id)
SELECT vec_id, round(cov, 6) AS coverage, CASE WHEN n = 0 THEN 1.0 ELSE round(1 - k / n::DOUBLE, 6) END AS outside FROM g""")
def mask_coverage(spark, sf_dir):
    """Mean of a mask within a box, and its share outside the padded one."""
    return _rounded(pixels.coverage(_pictures(spark, sf_dir), ["vec_id"], 0.12, 1), 6, "coverage", "outside")


@query(f"""{_PX} SELECT vec_id, round(coalesce(avg(abs(a - b)) FILTER (a > 51), 0) / 255, 6) AS mae, round(coalesce(avg(abs(a - b)) FILTER (a > 51), 0), 6) AS mae255 FROM px GROUP BY vec_id""")
def masked_difference(spark, sf_dir):
    """Mean difference of two pictures under a mask."""
    return _rounded(pixels.masked_mae(_pictures(spark, sf_dir), ["vec_id"]), 6, "mae", "mae255")


@query(f"""{_PX}, e AS (SELECT p.vec_id, p.i, p.x, p.y, p.a > 128 AS m, max(CASE WHEN q.a > 128 THEN 1 ELSE 0 END) AS up, min(CASE WHEN q.a > 128 THEN 1 ELSE 0 END) AS down FROM px p JOIN px q ON p.vec_id = q.vec_id AND abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 GROUP BY ALL),
k AS (SELECT e.*, px.a, px.b, m AND down = 0 AS rim, up = 1 AND NOT m AS ring, abs(l.b + r.b + u.b + d.b - 4 * px.b) AS lap FROM e JOIN px ON e.vec_id = px.vec_id AND e.i = px.i
 JOIN px l ON l.vec_id = e.vec_id AND l.y = e.y AND l.x = (e.x + 7) % 8 JOIN px r ON r.vec_id = e.vec_id AND r.y = e.y AND r.x = (e.x + 1) % 8 JOIN px u ON u.vec_id = e.vec_id AND u.x = e.x AND u.y = (e.y + 7) % 8 JOIN px d ON d.vec_id = e.vec_id AND d.x = e.x AND d.y = (e.y + 1) % 8),
g AS (SELECT vec_id, avg(b) FILTER (rim) AS i, avg(a) FILTER (ring) AS o, avg(lap) FILTER (rim OR ring) AS l FROM k GROUP BY vec_id)
SELECT vec_id, CASE WHEN i IS NULL OR o IS NULL THEN 1.0 ELSE round(greatest(0, least(1, 1 - abs(i - o) / 96)) + 0.0000001::DOUBLE, 5) END AS edge_contrast, CASE WHEN i IS NULL OR o IS NULL THEN 0.0 ELSE round(greatest(0, least(1, l / 48)) + 0.0000001::DOUBLE, 5) END AS edge_laplacian FROM g""")
def edge_scores(spark, sf_dir):
    """Step and sharpness along the border of a mask; outside the picture counts as mask for the inner rim."""
    found = pixels.edge_scores(_hard(_pictures(spark, sf_dir)), ["vec_id"], 1)
    return found.withColumns({c: F.round(F.col(c) + 1e-7, 5) for c in ("edge_contrast", "edge_laplacian")})  # so that no tie hangs on a last digit


def _hard(rows: DataFrame) -> DataFrame:
    """The mask's pixels above 128 as 255, the others as 0."""
    digits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.conv(F.substring(F.hex("mask"), i * 2 + 1, F.lit(2)), 16, 10).cast("int") > 128, "FF").otherwise("00"))
    return rows.withColumn("mask", F.unhex(F.array_join(digits, "")))


@query(f"""{_PX} SELECT vec_id, count(*) FILTER (b % 4 IN (0, 1)) AS n_valid, count(*) FILTER (b % 4 = 3) AS n_avoid, min(i) FILTER (b % 4 = 3) AS first_avoid FROM px GROUP BY vec_id""")
def ground_masks(spark, sf_dir):
    """Masks of valid and of avoided ground from class maps: how many pixels, and where the first is."""
    found = pixels.class_masks(_pictures(spark, sf_dir), {0, 1}, {3}, ["vec_id"])
    count = lambda c: ((F.length(F.hex(c)) - F.length(F.replace(F.hex(c), F.lit("FF"), F.lit("")))) / 2).cast("bigint")
    first = F.when(F.instr(F.hex("avoid"), "FF") > 0, ((F.instr(F.hex("avoid"), "FF") - 1) / 2).cast("bigint"))
    return found.select("vec_id", count("valid").alias("n_valid"), count("avoid").alias("n_avoid"), first.alias("first_avoid"))


@query(f"""{_PX}, g AS (SELECT vec_id, count(*) FILTER (a > 8) AS n, count(*) FILTER (a > 8 AND ((x >= x1 AND x < x2 AND y >= y1 AND y < y2) OR y >= 6)) AS k FROM px JOIN v USING (vec_id) GROUP BY vec_id)
SELECT vec_id, coalesce(round(k / nullif(n, 0)::DOUBLE, 6), 0) AS occluded, coalesce(k / nullif(n, 0)::DOUBLE, 0) > 0.4 AS skipped FROM g""")
def occluded_shares(spark, sf_dir):
    """Share of a mask under two occluder boxes."""
    low = F.array(*[F.lit(float(c)) for c in (0, 6, 8, 8)])
    rows = _pictures(spark, sf_dir).withColumn("occluders", F.array(F.array("x1", "y1", "x2", "y2"), low))
    return _rounded(pixels.occluded_share(rows, ["vec_id"], 0.4), 6, "occluded")


@query(f"""{_PX}, c AS (SELECT vec_id, x // 2 AS cx, y // 4 AS cy, floor(avg(a) + 0.5)::INT AS v FROM px WHERE x < 6 GROUP BY ALL) SELECT vec_id, string_agg(lpad(hex(v), 2, '0') || lpad(hex(v), 2, '0') || lpad(hex(v), 2, '0'), '' ORDER BY cy, cx) AS crop FROM c GROUP BY vec_id""")
def crop_pixels(spark, sf_dir):
    """A window of each picture, resized by area sampling."""
    rows = _pictures(spark, sf_dir).withColumnRenamed("source", "data").withColumns({"x1": F.lit(0), "y1": F.lit(0), "x2": F.lit(6), "y2": F.lit(8), "out_width": F.lit(3), "out_height": F.lit(2)})
    return pixels.crop_pixels(rows, ["vec_id"]).select("vec_id", F.hex("crop").alias("crop"))


# A picture of 8 x 8 is spread to 32 x 32, each pixel to 4 x 4, before its 8 x 8 low frequencies are taken, in thousandths.
@query(f"""{_PX}, k AS (SELECT u, x, sum(cos(pi() / 32 * (4 * x + j + 0.5) * u)) AS c FROM range(8) t(u), range(8) r(x), range(4) q(j) GROUP BY u, x),
d AS (SELECT vec_id, kv.u AS v, kh.u AS u, floor(sum(a * kv.c * kh.c) * 1000 + 0.5) AS f FROM px JOIN k kv ON kv.x = px.y JOIN k kh ON kh.x = px.x GROUP BY ALL), m AS (SELECT vec_id, median(f) AS md FROM d GROUP BY vec_id)
SELECT vec_id, sum(CASE WHEN f > md AND v * 8 + u > 0 THEN 1::HUGEINT << (63 - v * 8 - u)::INT ELSE 0 END)::BIGINT AS low_bits FROM d JOIN m USING (vec_id) GROUP BY vec_id""")
def perceptual_hashes(spark, sf_dir):
    """Hash of the low frequencies of each picture, but for its first bit."""
    rows = _pictures(spark, sf_dir).withColumnRenamed("source", "data")
    return pixels.perceptual_hash(rows, ["vec_id"]).select("vec_id", F.col("h").bitwiseAND(F.lit((1 << 63) - 1)).alias("low_bits"))
