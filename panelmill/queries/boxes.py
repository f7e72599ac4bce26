"""Queries over detections and text boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boxes as B
from ..operators.ordering import ordinal, rank_rows
from ..sources.fixtures import ctes, view
from . import query

FX = ctes("fx_boxes")
PAGE_W, PAGE_H = 300, 420
CLASS = "CASE label WHEN 0 THEN 'bubble' WHEN 1 THEN 'text_bubble' ELSE 'text_free' END"


def _boxes(spark, sf):
    return view(spark, sf, "fx_boxes").withColumn("class", F.expr(CLASS))


def _lines(spark, sf):
    """Boxes as recognised text lines."""
    return view(spark, sf, "fx_boxes").selectExpr(
        "image_id", "box_id", "x1 as x", "y1 as y", "x2 - x1 as w", "y2 - y1 as h",
        "concat('t', cast(box_id as string)) as text", "score as conf",
        "case label when 2 then 'sfx' else 'dialogue' end as kind", "'latin' as script",
    )


LINES = FX + """, lines AS (
  SELECT image_id, box_id, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h, concat('t', CAST(box_id AS STRING)) AS text, score AS conf,
    CASE label WHEN 2 THEN 'sfx' ELSE 'dialogue' END AS kind, 'latin' AS script FROM fx_boxes)
"""


@query("detections", FX + f""", d AS (
  SELECT image_id, box_id, label, score, greatest(0, CAST(round_even(x1 - 20.5, 0) AS INT)) AS x1, greatest(0, CAST(round_even(y1 - 1.5, 0) AS INT)) AS y1,
    least({PAGE_W}, CAST(round_even(x2 + 0.5, 0) AS INT)) AS x2, least({PAGE_H}, CAST(round_even(y2 + 0.25, 0) AS INT)) AS y2
  FROM fx_boxes WHERE score >= 0.3)
SELECT image_id, box_id, x1, y1, x2, y2, {CLASS} AS class FROM d WHERE x2 - x1 >= 2 AND y2 - y1 >= 2""")
def detections(spark, sf):
    raw = view(spark, sf, "fx_boxes").selectExpr(
        "image_id", "box_id", "label", "score", "x1 - 20.5D as x1", "y1 - 1.5D as y1", "x2 + 0.5D as x2", "y2 + 0.25D as y2",
        f"{PAGE_W} as page_w", f"{PAGE_H} as page_h",
    )
    return B.postprocess(raw).select("image_id", "box_id", "x1", "y1", "x2", "y2", "class")


@query("target_boxes", FX + "SELECT image_id, count(*) AS n, count(*) FILTER (WHERE label = 2) AS free_text FROM fx_boxes WHERE label IN (1, 2) GROUP BY image_id")
def target_boxes(spark, sf):
    return B.counts(B.select_targets(_boxes(spark, sf)), ["image_id"], free_text=F.col("class") == "text_free")


@query("dialogue_targets", FX + "SELECT image_id, box_id FROM fx_boxes WHERE label = 1")
def dialogue_targets(spark, sf):
    return B.select_targets(_boxes(spark, sf), include_sfx=False).select("image_id", "box_id")


@query("quad_boxes", FX + "SELECT image_id, box_id, least(x1, x2) AS x, y1 AS y, x2 - x1 AS w, y2 - y1 + 3 AS h FROM fx_boxes")
def quad_boxes(spark, sf):
    corner = "named_struct('x', {}, 'y', {})"
    quad = "array(" + ", ".join(corner.format(*p) for p in (("x2", "y1 + 1"), ("x1", "y1"), ("x1", "y2"), ("x2", "y2 + 3"))) + ")"
    df = view(spark, sf, "fx_boxes").select("image_id", "box_id", B.quad_bbox(F.expr(quad)).alias("q"))
    return df.select("image_id", "box_id", "q.*")


@query("kept_lines", LINES + "SELECT image_id, box_id, round_even(c, 3) AS conf FROM (SELECT *, conf * 0.98765 AS c, CASE WHEN x % 9 = 0 THEN '' ELSE text END AS t FROM lines) l WHERE t <> '' AND c >= 0.4")
def kept_lines(spark, sf):
    lines = _lines(spark, sf).withColumn("conf", F.col("conf") * 0.98765).withColumn("text", F.expr("case when x % 9 = 0 then '' else text end"))
    return B.keep_lines(lines).select("image_id", "box_id", "conf")


@query("bubble_tags", FX + """
SELECT a.image_id, a.box_id, CASE WHEN EXISTS (SELECT 1 FROM fx_boxes b WHERE b.label IN (0, 1) AND b.image_id = a.image_id AND b.box_id <> a.box_id + 1
  AND a.x1 - 10 + (a.x2 - a.x1) // 2 BETWEEN b.x1 AND b.x2 AND a.y1 + 15 + (a.y2 - a.y1) // 2 BETWEEN b.y1 AND b.y2) THEN 'bubble' ELSE 'sfx' END AS kind FROM fx_boxes a""".replace(" AND b.box_id <> a.box_id + 1", ""))
def bubble_tags(spark, sf):
    items = view(spark, sf, "fx_boxes").selectExpr("image_id", "box_id", "x1 - 10 as x", "y1 + 15 as y", "x2 - x1 as w", "y2 - y1 as h")
    return B.tag_kind(items, _boxes(spark, sf)).select("image_id", "box_id", "kind")


PAIRS = """, g AS (
  SELECT image_id, box_id, x - 0.35::DOUBLE * h AS gx1, y - 0.8::DOUBLE * h AS gy1, x + w + 0.35::DOUBLE * h AS gx2, y + h + 0.8::DOUBLE * h AS gy2
  FROM lines WHERE kind = 'dialogue'
), pairs AS (
  SELECT a.image_id, a.box_id AS a, b.box_id AS b FROM g a JOIN g b ON a.image_id = b.image_id AND a.box_id < b.box_id
    AND NOT (a.gx2 < b.gx1 OR b.gx2 < a.gx1 OR a.gy2 < b.gy1 OR b.gy2 < a.gy1))
"""


@query("overlap_pairs", LINES + PAIRS + "SELECT * FROM pairs")
def overlap_pairs(spark, sf):
    return B.overlap_pairs(_lines(spark, sf).where("kind = 'dialogue'"))


MERGED = LINES.replace("WITH", "WITH RECURSIVE", 1) + PAIRS.rstrip() + """, twoway AS (
  SELECT image_id, a, b FROM pairs UNION ALL SELECT image_id, b, a FROM pairs
), reach AS (
  SELECT image_id, box_id AS a, box_id AS root FROM g
  UNION
  SELECT r.image_id, e.b, r.root FROM reach r JOIN twoway e ON e.image_id = r.image_id AND e.a = r.a WHERE r.root < e.b
), labels AS (SELECT image_id, a AS box_id, min(root) AS label FROM reach GROUP BY image_id, a)
SELECT l.image_id, label AS group_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h,
  string_agg(text, ' ' ORDER BY y, x, l.box_id) AS text, round_even(min(conf), 3) AS conf, 'dialogue' AS kind, 'latin' AS script
FROM lines l JOIN labels USING (image_id, box_id) GROUP BY l.image_id, label
UNION ALL SELECT image_id, box_id, x, y, w, h, text, conf, kind, script FROM lines WHERE kind = 'sfx'
"""


@query("merged_lines", MERGED)
def merged_lines(spark, sf):
    return B.group_lines(_lines(spark, sf))


@query("merged_lines_distributed", MERGED)
def merged_lines_distributed(spark, sf):
    """The same clusters through the method that serves pages of any size."""
    return B.group_lines(_lines(spark, sf), limit=0)


@query("crop_windows", FX + f""", s AS (
  SELECT *, greatest(CAST(floor(greatest(x2 - x1, y2 - y1) * 2.0) AS INT), 64) AS side, x1 + (x2 - x1) // 2 AS cx, y1 + (y2 - y1) // 2 AS cy FROM fx_boxes
), e AS (SELECT *, least({PAGE_W}, greatest(0, cx - side // 2) + side) AS ex, least({PAGE_H}, greatest(0, cy - side // 2) + side) AS ey FROM s)
SELECT image_id, box_id, greatest(0, ex - side) AS x0, greatest(0, ey - side) AS y0, ex AS x1, ey AS y1, ((ex - greatest(0, ex - side) + 7) // 8) * 8 AS padded FROM e""")
def crop_windows(spark, sf):
    clusters = view(spark, sf, "fx_boxes").selectExpr(
        "image_id", "box_id", "x1 as x", "y1 as y", "x2 - x1 as w", "y2 - y1 as h", f"{PAGE_W} as page_w", f"{PAGE_H} as page_h"
    )
    out = B.crop_windows(clusters, *B.CROP_WIDE)
    return out.select("image_id", "box_id", "x0", "y0", "x1", "y1", B.round_up(F.col("x1") - F.col("x0"), 8).alias("padded"))


@query("merged_ranges", FX + """, s AS (SELECT image_id, y1 AS a, y2 AS b FROM fx_boxes),
m AS (SELECT *, max(b) OVER (PARTITION BY image_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM s),
i AS (SELECT *, sum(CASE WHEN r >= a THEN 0 ELSE 1 END) OVER (PARTITION BY image_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT image_id, min(a) AS a, max(b) AS b FROM i GROUP BY image_id, k""")
def merged_ranges(spark, sf):
    return B.merge_intervals(view(spark, sf, "fx_boxes").select("image_id", F.col("y1").alias("a"), F.col("y2").alias("b")))


@query("box_gaps", LINES + """SELECT image_id, box_id, next_y, next_y - (y + h) AS gap, (y + h + next_y) / 2.0 AS mid FROM (
  SELECT *, lead(y) OVER (PARTITION BY image_id ORDER BY y, box_id) AS next_y FROM lines) l""")
def box_gaps(spark, sf):
    return B.gaps(_lines(spark, sf)).select("image_id", "box_id", "next_y", "gap", "mid")


@query("reading_order", LINES + "SELECT image_id, box_id, row_number() OVER (PARTITION BY image_id ORDER BY y, x, box_id) AS n FROM lines")
def reading_order(spark, sf):
    return rank_rows(_lines(spark, sf).select("image_id", "box_id", "x", "y"), ["image_id"], ["y", "x", "box_id"]).select("image_id", "box_id", "n")


@query("reading_order_by_range", LINES + "SELECT image_id, box_id, row_number() OVER (PARTITION BY image_id ORDER BY y, x, box_id) AS n FROM lines")
def reading_order_by_range(spark, sf):
    """The same order by the method that serves pages of any size."""
    return ordinal(_lines(spark, sf).select("image_id", "box_id", "x", "y"), ["image_id"], ["y", "x", "box_id"]).select("image_id", "box_id", "n")


@query("box_counts", LINES + "SELECT image_id, count(*) AS n, count(*) FILTER (WHERE conf >= 0.3) AS kept, count(*) FILTER (WHERE kind = 'sfx') AS sfx FROM lines GROUP BY image_id")
def box_counts(spark, sf):
    return B.counts(_lines(spark, sf), ["image_id"], kept=F.col("conf") >= 0.3, sfx=F.col("kind") == "sfx")


RUNS = "SELECT image_id, y1 AS y, min(x1) AS x0, max(x2) AS x1 FROM fx_boxes WHERE label = 2 GROUP BY image_id, y1"


def _runs(spark, sf):
    free = view(spark, sf, "fx_boxes").where("label = 2")
    return free.groupBy("image_id", F.col("y1").alias("y")).agg(F.min("x1").alias("x0"), F.max("x2").alias("x1"))


@query("mask_coverage", FX + f""", runs AS ({RUNS}), m AS (
  SELECT b.image_id, b.box_id, sum(greatest(0, least(r.x1, b.x2 + 1) - greatest(r.x0, b.x1))) AS c FROM fx_boxes b JOIN runs r ON r.image_id = b.image_id AND r.y BETWEEN b.y1 AND b.y2
  WHERE label <> 2 GROUP BY b.image_id, b.box_id)
SELECT b.image_id, b.box_id, CAST(coalesce(c, 0) AS BIGINT) AS covered, (x2 - x1 + 1) * (y2 - y1 + 1) AS area, coalesce(c, 0) / ((x2 - x1 + 1) * (y2 - y1 + 1)) < 0.02 AS whole
FROM fx_boxes b LEFT JOIN m USING (image_id, box_id) WHERE label <> 2""")
def mask_coverage(spark, sf):
    boxes = view(spark, sf, "fx_boxes").where("label <> 2")
    return B.box_coverage(_runs(spark, sf), boxes, least=0.02).select("image_id", "box_id", "covered", "area", "whole")


@query("boxes_in_mask", FX + f""", runs AS ({RUNS}), c AS (
  SELECT image_id, box_id, CAST(trunc(least(greatest((x1 + x2) / 2.0, 0.0), {PAGE_W} - 1.0)) AS INT) AS cx, CAST(trunc(least(greatest((y1 + y2) / 2.0, 0.0), {PAGE_H} - 1.0)) AS INT) AS cy FROM fx_boxes)
SELECT c.image_id, c.box_id FROM c WHERE EXISTS (SELECT 1 FROM runs r WHERE r.image_id = c.image_id AND r.y = c.cy AND c.cx >= r.x0 AND c.cx < r.x1)""")
def boxes_in_mask(spark, sf):
    corner = "named_struct('x', {}, 'y', {})"
    quad = "array(" + ", ".join(corner.format(*p) for p in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))) + ")"
    boxes = view(spark, sf, "fx_boxes").select("image_id", "box_id", F.expr(quad).alias("quad"), F.lit(PAGE_W).alias("page_w"), F.lit(PAGE_H).alias("page_h"))
    return B.in_mask(boxes, _runs(spark, sf)).select("image_id", "box_id")
