"""Cut queries over many tall images: strips of 700 rows whose greys come from orders, with every lineitem as a protected box.

Parts of a strip are blank, so that slices without drawing merge into their neighbours.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cuts as C
from ..sources.fixtures import table
from . import cuts as Q, query

PX = "SELECT CAST(floor(o_orderkey / 700) AS BIGINT) AS image_id, CAST(o_orderkey % 700 AS INT) AS y, {greys} AS px FROM {t}"
GREY = "CASE WHEN o_orderkey % 700 % 175 < 70 THEN CAST(200 AS BIGINT) ELSE (o_custkey * 31 + x * (o_custkey % 17 + 3) * 7) % 256 END"
PROTECT = """SELECT CAST(floor(l_orderkey / 700) AS BIGINT) AS image_id, 97 * (l_partkey % 7) + 5 * (l_orderkey % 4) AS y0,
  97 * (l_partkey % 7) + 5 * (l_orderkey % 4) + 6 AS y1 FROM {t}"""
TARGETS = "SELECT CAST(floor(o_orderkey / 700) AS BIGINT) AS image_id, 95 * (o_custkey % 7) + 20 AS t FROM {t}"


def on_strips(sql: str) -> str:
    """A checking text of the small images, turned to strips."""
    start = Q.ROWS.index("SELECT image_id, y, list_transform")
    pixels = Q.ROWS[start : Q.ROWS.index("FROM fx_pixrows", start) + len("FROM fx_pixrows")]
    sql = sql.replace(pixels, PX.format(t="orders", greys=f"list_transform(range(64), lambda x: {GREY})"))
    sql = sql.replace(Q.PROTECT.format(t="lineitem"), PROTECT.format(t="lineitem"))
    return sql.replace(Q.TARGETS.format(t="customer"), TARGETS.format(t="orders"))


def _rows(spark, sf):
    greys = f"transform(sequence(0, 63), x -> {GREY})"
    return spark.sql(PX.format(t="{orders}", greys=greys), orders=table(spark, sf, "orders"))


def _ranges(spark, sf, rows):
    return C.forbidden(spark.sql(PROTECT.format(t="{lines}"), lines=table(spark, sf, "lineitem")), Q._images(rows))


def _split(spark, sf, targets=None, merge=True, **more):
    rows = _rows(spark, sf)
    return C.split_panels(Q._profile(rows), C.detail_rows(rows), Q._images(rows), _ranges(spark, sf, rows), targets, merge, **more)


def _targets(spark, sf):
    return spark.sql(TARGETS.format(t="{orders}"), orders=table(spark, sf, "orders"))


@query("strip_free_rows", on_strips(Q.BARRED + "SELECT image_id, y FROM free"))
def strip_free_rows(spark, sf):
    rows = _rows(spark, sf)
    return C.free_rows(Q._profile(rows), _ranges(spark, sf, rows)).select("image_id", "y")


@query("strip_cheapest_row", on_strips(Q.BARRED + "SELECT image_id, arg_min(y, (round(cost, 6), y)) AS y FROM free GROUP BY image_id"))
def strip_cheapest_row(spark, sf):
    rows = _rows(spark, sf)
    profile = Q._profile(rows).withColumn("cost", F.round("cost", 6))
    return C.argmin_row(C.free_rows(profile, _ranges(spark, sf, rows)))


@query("strip_art_scores", on_strips(Q.ART))
def strip_art_scores(spark, sf):
    rows = _rows(spark, sf)
    scored = C.art_scores(Q.thirties(rows), C.detail_rows(rows), _ranges(spark, sf, rows))
    return scored.select("image_id", "k", F.round("art", 9).alias("art"))


@query("strip_size_cuts", on_strips(Q.WALK))
def strip_size_cuts(spark, sf):
    return _split(spark, sf, merge=False)


@query("strip_size_cuts_blocks", on_strips(Q.WALK))
def strip_size_cuts_blocks(spark, sf):
    """The same cuts by the method for images of any height."""
    return _split(spark, sf, merge=False, limit=0, block=250)


@query("strip_snapped_cuts", on_strips(Q.SNAP))
def strip_snapped_cuts(spark, sf):
    """Strips without story targets stay whole."""
    return _split(spark, sf, _targets(spark, sf), merge=False, by_size=False)


@query("strip_panels", on_strips(Q.MERGE))
def strip_panels(spark, sf):
    """Panels of strips with blank parts: lonely slices have joined a neighbour."""
    return _split(spark, sf)


@query("strip_panels_blocks", on_strips(Q.MERGE))
def strip_panels_blocks(spark, sf):
    """The same panels by the method for images of any height."""
    return _split(spark, sf, limit=0, block=250)


@query("strip_numbered_panels", on_strips(Q.NUMBERS))
def strip_numbered_panels(spark, sf):
    images = Q._images(_rows(spark, sf)).select(F.lit("all").alias("chapter"), F.col("image_id").alias("seq"), "image_id")
    return C.number_panels(_split(spark, sf, merge=False), images).select("image_id", "k", "n", "name")
