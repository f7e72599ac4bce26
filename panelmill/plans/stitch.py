"""From pages to long images: what a stitching run writes, and the bytes of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import layout as L, pixels as P


def _placed(pages: DataFrame):
    sized = L.rescale(pages, L.modal_width(pages))
    return L.page_offsets(sized), sized


def stitch_manifest(pages: DataFrame, segments: int = 5, max_height: int = 12000) -> DataFrame:
    """(chapter, segment, y0, y1, name, n_pages) of all stitched images.

    ``pages`` holds (chapter, seq, w, h). Geometry only: no pixel is read.
    """
    placed, sized = _placed(pages)
    plan = L.stitch_plan(sized, segments, max_height)
    return L.recut(L.segment_pages(placed, plan, pages=pages))


def stitch_images(pages: DataFrame, images: DataFrame, segments: int = 5, max_height: int = 12000) -> DataFrame:
    """The stitched images themselves: (chapter, segment, name, height, width, data).

    ``pages`` as above plus image_id; ``images`` the pixel table. Geometry decides first;
    then each page is brought to width once, only the rows of a segment are cut from it,
    and the cuts of one segment (at most ``max_height`` rows) are stacked.
    """
    placed, sized = _placed(pages)
    plan = L.stitch_plan(sized, segments, max_height)
    parts = L.segment_pages(placed, plan, pages=pages).select("chapter", "segment", "seq", "image_id", "src0", "src1")
    sizes = sized.select("image_id", F.col("width").cast("int").alias("new_w"), F.col("new_h").cast("int").alias("new_h"))
    ready = P.rescale_images(images.select("image_id", "height", "width", "data").join(sizes, "image_id"))
    cut = parts.join(ready, "image_id").select(
        "chapter", "segment", "seq", "width", (F.col("src1") - F.col("src0")).cast("int").alias("height"),
        P.crop_rows(F.col("data"), F.col("width"), F.col("src0"), F.col("src1")).alias("data"),
    )
    return P.stack(cut, ["chapter", "segment"], "seq").withColumn("name", F.format_string("%02d.jpg", F.col("segment") + 1))
