"""From readings and detections to a numbered transcript, canvases and filled items."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import boxes as B, layout as L, textflow as T


def read_items(readings: DataFrame, detections: DataFrame, pages: DataFrame, lang: str = "en", min_conf: float = 0.4, limit: int = 256) -> DataFrame:
    """Numbered text items of every chapter: (chapter, page, n, kind, x, y, w, h, text, conf, script, image_id).

    ``readings`` holds one row per text line with both readings and its box: (image_id,
    box_id, x, y, w, h, en_text, en_conf, ko_text, ko_conf); ``detections`` are page boxes with
    their class; ``pages`` maps (chapter, seq, image_id).
    """
    lines = B.keep_lines(T.route_script(readings, lang), min_conf)
    grouped = B.group_lines(lines.select("image_id", "box_id", "x", "y", "w", "h", "text", "conf", "kind", "script"), limit=limit)
    tagged = B.tag_kind(grouped, detections)
    placed = tagged.join(pages.select("chapter", F.col("seq").alias("page"), "image_id"), "image_id")
    return T.number_items(placed, ["y", "x", "group_id"])


def lay_out(pages: DataFrame, items: DataFrame, cap: int = L.CANVAS_HEIGHT) -> tuple[DataFrame, DataFrame]:
    """Canvases (chapter, pack, image, width, height, n_pages) and the items in canvas coordinates."""
    sized = L.rescale(pages, L.modal_width(pages), "canvas")
    packed = L.pack(sized, cap)
    return L.canvases(packed), L.place_items(packed, items.drop("chapter"))


def apply_reply(items: DataFrame, replies: DataFrame, kind_filter: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Fill items from translated replies; returns the filled items and the post groups."""
    wanted = items if kind_filter is None else items.where(F.col("kind").isin(*kind_filter))
    return T.fill(wanted, T.parse_numbered(replies)), T.posts_of(replies)
