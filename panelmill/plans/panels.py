"""From finished canvases to numbered panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import cuts as C, pixels as P
from ..session import durable

MODES = ("auto", "heuristic", "visual")


def story_targets(
    boxes: DataFrame, ends: DataFrame | None = None, mode: str = "auto", grouped: DataFrame | None = None
) -> DataFrame | None:
    """Rows where the story wants a cut.

    ``visual`` asks for none; post groups (``ends``) win in ``auto``; otherwise the reading rhythm decides. ``grouped`` (image_id) lists the
    images of chapters that have post groups at all, as a chapter of one post has groups but no ends: the rhythm then decides for
    all other images. Without it, post groups are taken to speak for every image.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if mode == "visual":
        return None
    if ends is not None and mode == "auto":
        told = C.group_cuts(boxes, ends)
        if grouped is None:
            return told
        told = told.join(grouped.select("image_id").distinct(), "image_id", "left_semi")
        free = C.story_cuts(boxes.join(grouped.select("image_id").distinct(), "image_id", "left_anti"))
        return told.unionByName(free.select(*told.columns))
    return C.story_cuts(boxes)


def cut_canvases(
    images: DataFrame,
    boxes: DataFrame,
    canvases: DataFrame,
    ends: DataFrame | None = None,
    mode: str = "auto",
    grouped: DataFrame | None = None,
) -> DataFrame:
    """Numbered panels with their pixels: (chapter, image_id, k, n, name, height, width, data).

    ``images`` is the pixel table, ``canvases`` (chapter, seq, image_id), ``boxes`` the text
    boxes (image_id, box_id, n, y, h, text, page_w, page_h). The pixels of canvases that need
    cutting are read once for the row table, which is written down because two joins read
    it, and all pixels once more for the final crops.
    """
    sizes = images.select("image_id", F.col("height").alias("h"), F.col("width").alias("w"))
    targets = story_targets(boxes, ends, mode, grouped)
    long = sizes.where(F.col("h") > F.floor(F.col("w") * C.MAX_RATIO)).select("image_id")
    if targets is not None:
        targets = durable(targets)
        long = long.unionByName(targets.select("image_id")).distinct()
    table = durable(P.row_table(images.join(long, "image_id", "left_semi")))
    protect = boxes.select("image_id", F.col("y").alias("y0"), (F.col("y") + F.col("h")).alias("y1"))
    slices = C.split_panels(
        C.smooth(table.select("image_id", "y", "cost")), table.select("image_id", "y", "width", "mid", "top", "bot"),
        sizes, C.forbidden(protect, sizes), targets,
    )
    numbered = C.number_panels(slices, canvases)
    return numbered.join(images.select("image_id", "width", "data"), "image_id").select(
        "chapter", "image_id", "k", "n", "name", (F.col("y1") - F.col("y0")).alias("height"), "width",
        P.crop_rows(F.col("data"), F.col("width"), F.col("y0"), F.col("y1")).alias("data"),
    )
