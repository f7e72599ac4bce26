"""Pixel jobs: numeric kernels over an image table, run as Arrow batches.

An image row is (image_id, height, width, data) with data = height*width*3 bytes, blue
first. Kernels read pixels once and emit small tables; bytes come back only to be cut,
stacked or painted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .cuts import EDGE_THRESHOLD

# Grey weights (blue, green, red) in 1/32768.
GREY = (3735, 19235, 9798)


def as_array(data: bytes, height: int, width: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, 3)


def grey(img: np.ndarray) -> np.ndarray:
    b, g, r = (img[..., i].astype(np.int64) * GREY[i] for i in range(3))
    return ((b + g + r + 16384) >> 15).astype(np.int32)


def row_costs(g: np.ndarray) -> np.ndarray:
    return g.var(axis=1) / 255.0 + np.abs(np.diff(g, axis=1)).mean(axis=1)


def edge_counts(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strong-edge pixels per row: inside an image, as a first row, as a last row."""
    g = g.astype(np.int32)
    across = np.zeros_like(g)
    across[:, 1:-1] = g[:, 2:] - g[:, :-2]
    h = len(g)
    mid, top, bot = (np.zeros(h, np.int64) for _ in range(3))
    if h > 1:
        edge = np.abs(2 * across[:-1] + 2 * across[1:]) > EDGE_THRESHOLD
        top[:-1] = edge.sum(axis=1)
        bot[1:] = edge.sum(axis=1)
    if h > 2:
        gx = across[:-2] + 2 * across[1:-1] + across[2:]
        step = np.pad(g[2:] - g[:-2], ((0, 0), (1, 1)), mode="reflect")
        gy = step[:, :-2] + 2 * step[:, 1:-1] + step[:, 2:]
        mid[1:-1] = (np.abs(gx) + np.abs(gy) > EDGE_THRESHOLD).sum(axis=1)
    return mid, top, bot


def row_table(images: DataFrame) -> DataFrame:
    """(image_id, y, width, cost, mid, top, bot): everything the cut search needs, one pass over the pixels.

    ``cost`` is not yet smoothed.
    """
    kind = images.schema["image_id"].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for image, h, w, data in zip(pdf["image_id"], pdf["height"], pdf["width"], pdf["data"]):
                g = grey(as_array(data, h, w))
                mid, top, bot = edge_counts(g)
                yield pd.DataFrame({"image_id": image, "y": np.arange(h, dtype=np.int32), "width": w,
                                    "cost": row_costs(g), "mid": mid, "top": top, "bot": bot})

    return images.select("image_id", "height", "width", "data").mapInPandas(
        work, f"image_id {kind}, y int, width int, cost double, mid int, top int, bot int"
    )


def crop_rows(data: Column, width: Column, y0: Column, y1: Column) -> Column:
    """Rows y0..y1 of an image. Bytes are row-major, so this is a substring."""
    return F.substring(data, (y0 * width * 3 + 1).cast("int"), ((y1 - y0) * width * 3).cast("int"))


def stack(parts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Put images of one width under each other: (keys, height, width, data).

    A stacked image holds at most one canvas, some tens of megabytes.
    """
    return parts.groupBy(*keys).agg(
        F.sum("height").cast("int").alias("height"), F.first("width").alias("width"),
        F.expr(f"listagg(data, X'') within group (order by {order})").alias("data"),
    )


def area_resize(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """Shrink by area average (each output pixel is the mean of the source it covers)."""

    def weights(n_in: int, n_out: int) -> np.ndarray:
        edges = np.arange(n_out + 1) * (n_in / n_out)
        cover = np.minimum(edges[1:, None], np.arange(1, n_in + 1)) - np.maximum(edges[:-1, None], np.arange(n_in))
        return np.clip(cover, 0, None) * (n_out / n_in)

    rows = weights(img.shape[0], height)
    cols = weights(img.shape[1], width)
    out = np.einsum("yh,hwc->ywc", rows, img.astype(np.float64), optimize=True)
    return np.rint(np.einsum("xw,ywc->yxc", cols, out, optimize=True)).clip(0, 255).astype(np.uint8)


def linear_resize(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear resize with pixel centres aligned."""

    def grid(n_in: int, n_out: int):
        at = np.clip((np.arange(n_out) + 0.5) * (n_in / n_out) - 0.5, 0, n_in - 1)
        lo = np.floor(at).astype(int)
        return lo, np.minimum(lo + 1, n_in - 1), at - lo

    y0, y1, fy = grid(img.shape[0], height)
    x0, x1, fx = grid(img.shape[1], width)
    f = img.astype(np.float64)
    rows = f[y0] * (1 - fy)[:, None, None] + f[y1] * fy[:, None, None]
    out = rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]
    return np.rint(out).clip(0, 255).astype(np.uint8)


def rescale_images(images: DataFrame, rule: str = "stitch") -> DataFrame:
    """Bring images to (new_w, new_h).

    ``stitch`` averages areas when shrinking and is bilinear when growing; ``canvas`` is
    bilinear. The pixel table is read once, and only bytes that change go to Python: for
    images of the right size the kernel sees a null.
    """

    def resize(data: pd.Series, h: pd.Series, w: pd.Series, nh: pd.Series, nw: pd.Series) -> pd.Series:
        out = []
        for d, h0, w0, h1, w1 in zip(data, h, w, nh, nw):
            if d is None:
                out.append(None)
                continue
            fn = area_resize if rule == "stitch" and w1 <= w0 and h1 <= h0 else linear_resize
            out.append(fn(as_array(d, h0, w0), int(w1), int(h1)).tobytes())
        return pd.Series(out, dtype=object)

    moved = (F.col("width") != F.col("new_w")) | (F.col("height") != F.col("new_h"))
    changed = F.pandas_udf(resize, "binary")(F.when(moved, F.col("data")), "height", "width", "new_h", "new_w")
    keep = [c for c in images.columns if c not in ("height", "width", "data", "new_w", "new_h")]
    return images.select(
        *keep, F.col("new_h").cast("int").alias("height"), F.col("new_w").cast("int").alias("width"),
        F.coalesce(changed, F.col("data")).alias("data"),
    )


# -- overlays ---------------------------------------------------------------


RED = (0, 0, 255)


WHITE = (255, 255, 255)
# Digits of five rows with three dots, drawn STROKE pixels a dot, MARGIN pixels inside their tag.
DIGITS = {
    "0": "### #.# #.# #.# ###", "1": ".#. ##. .#. .#. ###", "2": "### ..# ### #.. ###", "3": "### ..# .## ..# ###", "4": "#.# #.# ### ..# ..#",
    "5": "### #.. ### ..# ###", "6": "### #.. ### #.# ###", "7": "### ..# .#. .#. .#.", "8": "### #.# ### #.# ###", "9": "### #.# ### ..# ###",
}
STROKE, MARGIN = 3, 3


def digit_dots(number: str) -> np.ndarray:
    """Dots of a number's digits, one dot apart, at STROKE pixels a dot."""
    rows = [".".join(DIGITS[d].split()[i] for d in number) for i in range(5)]
    return np.kron(np.array([[c == "#" for c in r] for r in rows]), np.ones((STROKE, STROKE), bool))


def draw_number(img: np.ndarray, number: str, x: int, y: int) -> None:
    """A red tag with white digits on top of the corner (x, y), moved down where the image ends; what lies outside is cut off."""
    dots = np.pad(digit_dots(number), MARGIN)
    top, left = max(0, y - dots.shape[0]), max(0, x)
    place = img[top : top + dots.shape[0], left : left + dots.shape[1]]
    place[:] = RED
    place[dots[: place.shape[0], : place.shape[1]]] = WHITE


def overlay_boxes(images: DataFrame, items: DataFrame) -> DataFrame:
    """Draw a two-pixel red outline around every item (x, y, w, h), and its number above it where items have ``n``."""
    shape = ["x", "y", "w", "h", *(["n"] if "n" in items.columns else [])]
    lists = items.select("image_id", *shape).distinct().groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(*reversed(shape)))).alias("boxes"))

    def outline(img: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> None:
        rows, cols = slice(max(0, y1 - 1), max(0, y2 + 1)), slice(max(0, x1 - 1), max(0, x2 + 1))
        if x2 - x1 <= 2 or y2 - y1 <= 2:  # no room inside
            img[rows, cols] = RED
            return
        for a in (y1, y2):
            img[max(0, a - 1) : max(0, a + 1), cols] = RED
        for a in (x1, x2):
            img[rows, max(0, a - 1) : max(0, a + 1)] = RED

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            drawn = []
            for h, w, data, boxes in zip(pdf["height"], pdf["width"], pdf["data"], pdf["boxes"]):
                img = as_array(data, h, w).copy()
                for b in [] if boxes is None else boxes:
                    outline(img, b["x"], b["y"], b["x"] + b["w"], b["y"] + b["h"])
                    if "n" in shape and b["n"] is not None:
                        draw_number(img, str(abs(int(b["n"]))), b["x"], b["y"])
                drawn.append(img.tobytes())
            yield pd.DataFrame({"image_id": pdf["image_id"], "height": pdf["height"], "width": pdf["width"], "data": drawn})

    slim = images.select("image_id", "height", "width", "data")
    return slim.join(lists, "image_id", "left").mapInPandas(work, slim.schema)
