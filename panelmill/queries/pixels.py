"""Queries over pixel tables. Images are built from the rows of fx_pixrows: 200 rows of 64 grey pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pixels as P
from ..plans.stitch import stitch_images as stitch_flow
from . import query
from .cuts import DETAIL, ROWS, _rows


def _images(spark, sf):
    """(image_id, height, width, data): an image has at most 200 rows, so its rows fit one cell."""
    three = F.transform("px", lambda v: F.repeat(F.lpad(F.hex(v), 2, "0"), F.lit(3)))
    lines = _rows(spark, sf).select("image_id", "y", F.unhex(F.array_join(three, "")).alias("data"), F.lit(1).alias("height"), F.lit(64).alias("width"))
    return P.stack(lines, ["image_id"], "y")


HEX = ROWS.rstrip() + """, hexed AS (SELECT image_id, y, array_to_string(list_transform(px, lambda v: repeat(printf('%02X', v), 3)), '') AS t FROM px)
"""


@query("pixel_images", HEX + "SELECT image_id, count(*) AS height, 64 AS width, md5(string_agg(t, '' ORDER BY y)) AS digest FROM hexed GROUP BY image_id")
def pixel_images(spark, sf):
    return _images(spark, sf).select("image_id", "height", "width", F.md5(F.hex("data")).alias("digest"))


@query("pixel_row_table", ROWS.rstrip() + DETAIL + """SELECT r.image_id, r.y, 64 AS width, round(cost, 6) AS cost, coalesce(mid, 0) AS mid, coalesce(top, 0) AS top, coalesce(bot, 0) AS bot
FROM raw r JOIN detail d ON r.image_id = d.image_id AND r.y = d.y""")
def pixel_row_table(spark, sf):
    return P.row_table(_images(spark, sf)).withColumn("cost", F.round("cost", 6))


@query("cropped_rows", HEX + "SELECT image_id, y // 30 AS k, md5(string_agg(t, '' ORDER BY y)) AS digest FROM hexed GROUP BY image_id, y // 30")
def cropped_rows(spark, sf):
    images = _images(spark, sf).withColumn("k", F.explode(F.expr("sequence(0, (height - 1) div 30)")))
    y0, y1 = F.col("k") * 30, F.least(F.col("k") * 30 + 30, F.col("height"))
    return images.select("image_id", "k", F.md5(F.hex(P.crop_rows(F.col("data"), F.col("width"), y0, y1))).alias("digest"))


def _pages(images):
    return images.select(F.expr("image_id % 3").alias("chapter"), F.col("image_id").alias("seq"), "image_id", F.col("width").alias("w"), F.col("height").alias("h"))


@query("stitched_pixels", HEX + """, p AS (SELECT image_id % 3 AS chapter, image_id, count(*) AS h FROM hexed GROUP BY image_id),
t AS (SELECT chapter, sum(h) AS total FROM p GROUP BY chapter),
n AS (SELECT chapter, total, CAST(ceil(total / greatest(2, ceil(total / 150))) AS BIGINT) AS seg_h FROM t),
r AS (SELECT x.image_id % 3 AS chapter, t, row_number() OVER (PARTITION BY x.image_id % 3 ORDER BY x.image_id, y) - 1 AS pos FROM hexed x)
SELECT r.chapter, pos // seg_h AS segment, printf('%02d.jpg', pos // seg_h + 1) AS name, count(*) AS height, 64 AS width, md5(string_agg(t, '' ORDER BY pos)) AS digest
FROM r JOIN n ON r.chapter = n.chapter GROUP BY r.chapter, pos // seg_h""")
def stitched_pixels(spark, sf):
    images = _images(spark, sf)
    out = stitch_flow(_pages(images), images, segments=2, max_height=150)
    return out.select("chapter", "segment", "name", "height", "width", F.md5(F.hex("data")).alias("digest"))


CELLS = HEX.rstrip() + ", cell AS (SELECT image_id, y, unnest(px) AS v, generate_subscripts(px, 1) - 1 AS x FROM px)\n"


@query("rescaled_pixels", CELLS + """, half AS (SELECT image_id, y // 2 AS y, x // 2 AS x, CAST(round_even(avg(v), 0) AS BIGINT) AS v FROM cell GROUP BY image_id, y // 2, x // 2)
SELECT image_id, count(DISTINCT y) AS height, 32 AS width, md5(string_agg(repeat(printf('%02X', v), 3), '' ORDER BY y, x)) AS digest FROM half GROUP BY image_id""")
def rescaled_pixels(spark, sf):
    """Images brought to half their width, as sizes and digests."""
    wanted = _images(spark, sf).withColumns({"new_w": F.expr("width div 2"), "new_h": F.expr("greatest(1, height div 2)")})
    out = P.rescale_images(wanted)
    return out.select("image_id", "height", "width", F.md5(F.hex("data")).alias("digest"))


def _boxes(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    return lines.selectExpr(
        "l_orderkey as image_id", "case l_returnflag when 'R' then 'text_free' else 'text_bubble' end as class",
        "cast(l_partkey % 50 as int) as x1", "cast((l_partkey * 7) % 180 as int) as y1",
        "cast(l_partkey % 50 + 12 as int) as x2", "cast((l_partkey * 7) % 180 + 8 as int) as y2",
    )


BOXES = """SELECT l_orderkey AS image_id, l_partkey % 50 AS x1, (l_partkey * 7) % 180 AS y1, l_partkey % 50 + 12 AS x2, (l_partkey * 7) % 180 + 8 AS y2 FROM lineitem"""


@query("outlined_pages", CELLS + f""", b AS ({BOXES}), hit AS (SELECT DISTINCT c.image_id, c.x, c.y FROM cell c JOIN b ON b.image_id = c.image_id
  AND c.x BETWEEN x1 - 1 AND x2 AND c.y BETWEEN y1 - 1 AND y2 AND NOT (c.x BETWEEN x1 + 1 AND x2 - 2 AND c.y BETWEEN y1 + 1 AND y2 - 2))
SELECT c.image_id, count(DISTINCT c.y) AS height, 64 AS width, md5(string_agg(CASE WHEN h.x IS NOT NULL THEN '0000FF' ELSE repeat(printf('%02X', v), 3) END, '' ORDER BY c.y, c.x)) AS digest
FROM cell c LEFT JOIN hit h ON h.image_id = c.image_id AND h.x = c.x AND h.y = c.y GROUP BY c.image_id""")
def outlined_pages(spark, sf):
    items = _boxes(spark, sf).selectExpr("image_id", "x1 as x", "y1 as y", "x2 - x1 as w", "y2 - y1 as h")
    out = P.overlay_boxes(_images(spark, sf), items)
    return out.select("image_id", "height", "width", F.md5(F.hex("data")).alias("digest"))
