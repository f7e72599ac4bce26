"""Queries over page geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import FOLDER_EXTS, PAGE_EXTS, SPLIT_EXTS, has_ext
from ..operators import boxes as B, layout as L
from ..plans.stitch import stitch_manifest as stitch_flow
from ..sources.fixtures import ctes, view
from ..sources.images import in_reading_order
from . import query

WIDTHS = """, widths AS (
  SELECT chapter, arg_max(w, (c, -f)) AS width FROM (SELECT chapter, w, count(*) AS c, min(seq) AS f FROM fx_images GROUP BY chapter, w) g GROUP BY chapter
), sized AS (
  SELECT i.*, width, CASE WHEN w = width THEN CAST(h AS BIGINT) ELSE greatest(1, CAST(round_even(h * width / w, 0) AS BIGINT)) END AS new_h
  FROM fx_images i JOIN widths USING (chapter)
), placed AS (
  SELECT *, CAST(coalesce(sum(new_h) OVER (PARTITION BY chapter ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS top FROM sized
), plan AS (
  SELECT chapter, total_h, n_seg, CAST(ceil(total_h / n_seg) AS BIGINT) AS seg_h FROM (
    SELECT chapter, CAST(sum(new_h) AS BIGINT) AS total_h, greatest(5, CAST(ceil(sum(new_h) / 12000) AS BIGINT)) AS n_seg FROM sized GROUP BY chapter) t
), segs AS (
  SELECT chapter, segment, segment * seg_h AS y0, least((segment + 1) * seg_h, total_h) AS y1 FROM (
    SELECT *, unnest(generate_series(0, n_seg - 1)) AS segment FROM plan) s WHERE segment * seg_h < total_h
), parts AS (
  SELECT s.*, p.seq, greatest(p.top, y0) - p.top AS src0, least(p.top + p.new_h, y1) - p.top AS src1
  FROM segs s JOIN placed p ON s.chapter = p.chapter AND p.top < s.y1 AND p.top + p.new_h > s.y0)
"""
FX = ctes("fx_images") + WIDTHS


# page numbers far apart, some negative, whose order is not that of the ids
SPARSE = "(doc_id % 1000) * CAST(9000000000000000 AS BIGINT) + doc_id - CAST(4000000000000000000 AS BIGINT)"


def _pages(spark, sf, sparse):
    pages = view(spark, sf, "fx_images")
    return pages.withColumn("seq", F.expr(SPARSE.replace("doc_id", "image_id"))) if sparse else pages


def _sparse(sql):
    return sql.replace("doc_id AS seq", SPARSE + " AS seq", 1)


def _sized(spark, sf, rule="stitch", sparse=False):
    pages = _pages(spark, sf, sparse)
    return L.rescale(pages, L.modal_width(pages), rule)


@query("stitch_manifest", FX + """SELECT chapter, segment, y0, y1, printf('%02d', segment + 1) || '.jpg' AS name, count(*) AS n_pages
FROM parts GROUP BY chapter, segment, y0, y1""")
def stitch_manifest(spark, sf):
    return stitch_flow(view(spark, sf, "fx_images"))


@query("sparse_stitch_manifest", _sparse(FX) + """SELECT chapter, segment, y0, y1, printf('%02d', segment + 1) || '.jpg' AS name, count(*) AS n_pages
FROM parts GROUP BY chapter, segment, y0, y1""")
def sparse_stitch_manifest(spark, sf):
    """The manifest of chapters whose page numbers lie far apart."""
    return stitch_flow(_pages(spark, sf, True))


@query("modal_width", FX + "SELECT chapter, width FROM widths")
def modal_width(spark, sf):
    return L.modal_width(view(spark, sf, "fx_images"))


@query("page_offsets", FX + "SELECT chapter, seq, new_h, top FROM placed")
def page_offsets(spark, sf):
    return L.page_offsets(_sized(spark, sf)).select("chapter", "seq", "new_h", "top")


@query("sparse_page_offsets", _sparse(FX) + "SELECT chapter, seq, new_h, top FROM placed")
def sparse_page_offsets(spark, sf):
    return L.page_offsets(_sized(spark, sf, sparse=True)).select("chapter", "seq", "new_h", "top")


@query("stitch_plan", FX + "SELECT chapter, total_h, n_seg, seg_h FROM plan")
def stitch_plan(spark, sf):
    return L.stitch_plan(_sized(spark, sf))


@query("segment_pages", FX + "SELECT chapter, segment, seq, y0, y1, src0, src1 FROM parts")
def segment_pages(spark, sf):
    sized = _sized(spark, sf)
    out = L.segment_pages(L.page_offsets(sized), L.stitch_plan(sized))
    return out.select("chapter", "segment", "seq", "y0", "y1", "src0", "src1")


PACK = ctes("fx_images").replace("WITH", "WITH RECURSIVE", 1) + WIDTHS.rstrip() + """, flat AS (
  SELECT i.chapter, i.seq, i.image_id, i.w, width, CAST(round_even(h * width / w, 0) AS BIGINT) AS ph,
    CAST(round_even(h * (width / w), 0) AS BIGINT) AS dh, row_number() OVER (PARTITION BY i.chapter ORDER BY i.seq) AS r
  FROM fx_images i JOIN widths USING (chapter)
), fold AS (
  SELECT chapter, r, ph AS cur, 1 AS pack FROM flat WHERE r = 1
  UNION ALL
  SELECT f.chapter, f.r, CASE WHEN o.cur + f.ph > 16000 THEN f.ph ELSE o.cur + f.ph END, o.pack + CASE WHEN o.cur + f.ph > 16000 THEN 1 ELSE 0 END
  FROM fold o JOIN flat f ON f.chapter = o.chapter AND f.r = o.r + 1
), packed AS (
  SELECT flat.*, pack, coalesce(sum(dh) OVER (PARTITION BY flat.chapter, pack ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM flat JOIN fold USING (chapter, r))
"""


def _packed(spark, sf):
    return L.pack(_sized(spark, sf, "canvas"))


@query("canvas_packing", PACK + "SELECT chapter, seq, pack FROM packed")
def canvas_packing(spark, sf):
    return _packed(spark, sf).select("chapter", "seq", "pack")


@query("canvas_packing_blocks", PACK + "SELECT chapter, seq, pack FROM packed")
def canvas_packing_blocks(spark, sf):
    """The same packing through the block walk that serves chapters of any length."""
    return L.pack(_sized(spark, sf, "canvas"), limit=0, stretch=64_000, fan_in=4).select("chapter", "seq", "pack")


@query("sparse_canvas_packing", _sparse(PACK) + "SELECT chapter, seq, pack FROM packed")
def sparse_canvas_packing(spark, sf):
    """Packing by the block walk when page numbers lie far apart."""
    return L.pack(_sized(spark, sf, "canvas", sparse=True), limit=0, stretch=64_000, fan_in=4).select("chapter", "seq", "pack")


@query("canvases", PACK + """SELECT chapter, pack, width, CAST(sum(dh) AS BIGINT) AS height, count(*) AS n_pages,
  'canvas_' || printf('%03d', pack) || '.png' AS image FROM packed GROUP BY chapter, pack, width""")
def canvases(spark, sf):
    return L.canvases(_packed(spark, sf))


@query("placed_items", PACK.replace(", widths AS", ", " + ctes("fx_boxes")[5:] + ", widths AS", 1) + """
SELECT chapter, pack, p.image_id, box_id, CAST(trunc(x1 * (width / w)) AS INT) AS x, CAST(trunc(off + y1 * (width / w)) AS INT) AS y,
  CAST(trunc((x2 - x1) * (width / w)) AS INT) AS w, CAST(trunc((y2 - y1) * (width / w)) AS INT) AS h
FROM packed p JOIN fx_boxes b ON b.image_id = p.image_id""")
def placed_items(spark, sf):
    items = view(spark, sf, "fx_boxes").selectExpr("image_id", "box_id", "x1 as x", "y1 as y", "x2 - x1 as w", "y2 - y1 as h")
    return L.place_items(_packed(spark, sf), items)


NAMES = "CASE image_id % 8 WHEN 0 THEN fname WHEN 1 THEN upper(fname) WHEN 2 THEN 'a.gif' WHEN 3 THEN 'b.Bmp' WHEN 4 THEN 'c.txt' WHEN 5 THEN 'd.jpg.part' WHEN 6 THEN 'e.webp' ELSE 'jpg' END"


@query("image_files", ctes("fx_images") + rf"""
SELECT image_id, f AS fname, regexp_matches(lower(f), '\.(jpg|jpeg|png|webp|gif|bmp)$') AS in_folder,
  regexp_matches(lower(f), '\.(jpg|jpeg|png|webp|bmp)$') AS in_split, regexp_matches(lower(f), '\.(jpg|jpeg|png|webp|gif)$') AS in_page FROM (SELECT image_id, {NAMES} AS f FROM fx_images) x""")
def image_files(spark, sf):
    df = view(spark, sf, "fx_images").select("image_id", F.expr(NAMES).alias("fname"))
    of = lambda exts, name: has_ext(F.col("fname"), exts).alias(name)
    return df.select("image_id", "fname", of(FOLDER_EXTS, "in_folder"), of(SPLIT_EXTS, "in_split"), of(PAGE_EXTS, "in_page"))


MIXED = "CASE WHEN image_id % 3 = 0 THEN concat(CAST(image_id AS STRING), '.png') WHEN image_id % 3 = 1 THEN upper(fname) ELSE fname END"


@query("natural_order", ctes("fx_images") + f"""
SELECT chapter, fname, row_number() OVER (PARTITION BY chapter ORDER BY CASE WHEN image_id % 3 = 0 THEN 0 ELSE 1 END, image_id) AS seq
FROM (SELECT chapter, image_id, {MIXED} AS fname FROM fx_images) x""")
def natural_order(spark, sf):
    files = view(spark, sf, "fx_images").select("chapter", F.expr(MIXED).alias("fname"))
    return in_reading_order(files)


def _tile_sql(h, o):
    return f"""SELECT image_id, k AS tile, k * {h - o} AS y0, least(k * {h - o} + {h}, h) AS y1 FROM (
  SELECT image_id, h, unnest(generate_series(0, CASE WHEN h <= {h} THEN 0 ELSE CAST(ceil((h - {o}) / {h - o}.0) AS INT) - 1 END)) AS k FROM fx_images) t"""


@query("detect_tiles", ctes("fx_images") + _tile_sql(*B.DETECT_TILE))
def detect_tiles(spark, sf):
    return B.tiles(view(spark, sf, "fx_images"))


@query("read_tiles", ctes("fx_images") + _tile_sql(*B.READ_TILE))
def read_tiles(spark, sf):
    return B.tiles(view(spark, sf, "fx_images"), *B.READ_TILE)


@query("untiled_boxes", ctes("fx_images", "fx_boxes") + f""", t AS ({_tile_sql(*B.DETECT_TILE)})
SELECT b.image_id, b.box_id, t.tile, b.y1 + t.y0 AS y1, b.y2 + t.y0 AS y2 FROM fx_boxes b JOIN t ON b.image_id = t.image_id""")
def untiled_boxes(spark, sf):
    t = B.tiles(view(spark, sf, "fx_images")).select("image_id", "tile", F.col("y0").alias("tile_y0"))
    return B.untile(view(spark, sf, "fx_boxes").join(t, "image_id")).select("image_id", "box_id", "tile", "y1", "y2")


CUTS = "SELECT image_id, y1 * 12.5 - 300 AS y FROM fx_boxes"
SLICES = """, ends AS (
  SELECT image_id, y, h, row_number() OVER (PARTITION BY image_id ORDER BY y) AS k, lead(y) OVER (PARTITION BY image_id ORDER BY y) AS nxt FROM (
    SELECT image_id, y, h FROM kept UNION ALL SELECT image_id, 0, h FROM fx_images) u
), slices AS (SELECT image_id, CAST(k AS INT) AS k, y AS y0, coalesce(nxt, h) AS y1 FROM ends WHERE coalesce(nxt, h) > y)
"""


def _cuts(spark, sf):
    return view(spark, sf, "fx_boxes").selectExpr("image_id", "y1 * 12.5 - 300 as y")


@query("clean_cuts", ctes("fx_images", "fx_boxes") + f""", c AS ({CUTS})
SELECT c.image_id, CAST(trunc(greatest(1.0, least(h - 1, y))) AS INT) AS y FROM c JOIN fx_images i ON c.image_id = i.image_id
WHERE trunc(greatest(1.0, least(h - 1, y))) > 0 AND trunc(greatest(1.0, least(h - 1, y))) < h""")
def clean_cuts(spark, sf):
    return L.clean_cuts(_cuts(spark, sf), view(spark, sf, "fx_images"), interactive=True)


@query("manual_slices", ctes("fx_images", "fx_boxes") + f""", c AS ({CUTS}), kept AS (
  SELECT c.image_id, CAST(trunc(y) AS INT) AS y, h FROM c JOIN fx_images i ON c.image_id = i.image_id WHERE trunc(y) > 0 AND trunc(y) < h)
""" + SLICES + """SELECT s.*, regexp_replace(fname, '\\.[^.]*$', '') || '_' || printf('%03d', k) || '.jpg' AS name
FROM slices s JOIN fx_images i ON s.image_id = i.image_id""")
def manual_slices(spark, sf):
    cuts = _cuts(spark, sf).withColumn("y", F.col("y").cast("int"))
    return L.manual_split(view(spark, sf, "fx_images"), cuts).select("image_id", "k", "y0", "y1", "name")


SHARED = [400, 150, 900, 900, 2500, 0, 12000]


@query("shared_cuts", ctes("fx_images") + f""", kept AS (SELECT image_id, y, h FROM (SELECT image_id, h, unnest({SHARED}) AS y FROM fx_images) x WHERE y > 0 AND y < h)
""" + SLICES + "SELECT * FROM slices")
def shared_cuts(spark, sf):
    images = view(spark, sf, "fx_images")
    return L.cuts_to_slices(L.apply_shared_cuts(images, SHARED), images)
