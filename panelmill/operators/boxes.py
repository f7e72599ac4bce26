"""Detections and text boxes: tiling, filters, spatial joins, clustering, interval merging.

Spatial joins hash on (page, cell), so a crowded page spreads over many tasks and only
boxes that share a cell are ever compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import let
from ..session import durable
from .graphs import components
from .ordering import look_up, split_hot

# Detector classes, and the one used for unknown labels.
CLASSES = {0: "bubble", 1: "text_bubble", 2: "text_free"}
OTHER_CLASS = "text_free"
BUBBLE_CLASSES = ("bubble", "text_bubble")
# Score threshold, tile sizes as (height, overlap), crop rules as (context, least side).
MIN_SCORE = 0.3
DETECT_TILE = (1600, 200)
READ_TILE = (2000, 250)
CROP_WIDE = (2.0, 64)
CROP_TIGHT = (1.8, 256)
# How far a text line reaches for its neighbours, in line heights (x, y).
GROW = (0.35, 0.8)


# -- tiles and post-filters -------------------------------------------------


def tiles(images: DataFrame, height: int = DETECT_TILE[0], overlap: int = DETECT_TILE[1]) -> DataFrame:
    """Horizontal slabs of tall pages: (image_id, tile, y0, y1)."""
    step = height - overlap
    count = F.when(F.col("h") <= height, F.lit(1)).otherwise(F.ceil((F.col("h") - overlap) / step)).cast("int")
    return (
        images.select("image_id", "h", F.explode(F.sequence(F.lit(0), count - 1)).alias("tile"))
        .withColumn("y0", F.col("tile") * step)
        .withColumn("y1", F.least(F.col("y0") + height, F.col("h")))
        .drop("h")
    )


def untile(boxes: DataFrame) -> DataFrame:
    """Move boxes from tile to page rows. A box seen in two tiles stays twice."""
    return boxes.withColumn("y1", F.col("y1") + F.col("tile_y0")).withColumn("y2", F.col("y2") + F.col("tile_y0"))


def postprocess(dets: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Threshold, round half-even, clamp to the page (columns page_w, page_h), drop slivers, name the class."""
    named = F.lit(OTHER_CLASS)
    for label, name in CLASSES.items():
        named = F.when(F.col("label") == label, F.lit(name)).otherwise(named)
    lo = lambda c: F.greatest(F.lit(0), F.rint(c).cast("int"))
    return (
        dets.where(F.col("score") >= min_score)
        .withColumn("x1", lo(F.col("x1")))
        .withColumn("y1", lo(F.col("y1")))
        .withColumn("x2", F.least(F.col("page_w"), F.rint("x2").cast("int")))
        .withColumn("y2", F.least(F.col("page_h"), F.rint("y2").cast("int")))
        .where("x2 - x1 >= 2 and y2 - y1 >= 2")
        .withColumn("class", named)
    )


def select_targets(boxes: DataFrame, include_sfx: bool = True) -> DataFrame:
    """Boxes to erase: dialogue always, free text only when sound effects are in scope."""
    wanted = ["text_bubble", "text_free"] if include_sfx else ["text_bubble"]
    return boxes.where(F.col("class").isin(*wanted))


def quad_bbox(quad: Column) -> Column:
    """struct<x, y, w, h> around an array<struct<x, y>>."""

    def bounds(q: Column) -> Column:
        xs, ys = F.transform(q, lambda p: p.x), F.transform(q, lambda p: p.y)
        x, y = F.array_min(xs), F.array_min(ys)
        return F.struct(
            x.alias("x"), y.alias("y"), (F.array_max(xs) - x).alias("w"), (F.array_max(ys) - y).alias("h")
        )

    return let(quad, bounds)


def keep_lines(lines: DataFrame, min_conf: float = 0.4) -> DataFrame:
    """Drop empty or doubtful readings; confidences keep three places (half-even)."""
    return lines.where((F.col("text") != "") & (F.col("conf") >= min_conf)).withColumn("conf", F.bround("conf", 3))


def crop_windows(clusters: DataFrame, context: float = CROP_TIGHT[0], min_side: int = CROP_TIGHT[1]) -> DataFrame:
    """Square context windows around clusters (x, y, w, h), inside the page (page_w, page_h)."""
    side = F.greatest(F.floor(F.greatest("w", "h") * F.lit(context)).cast("int"), F.lit(min_side))
    half = F.floor(F.col("side") / 2).cast("int")
    out = clusters.withColumn("side", side)
    for a, size, lo, hi, page in (("x", "w", "x0", "x1", "page_w"), ("y", "h", "y0", "y1", "page_h")):
        centre = F.col(a) + F.floor(F.col(size) / 2).cast("int")
        near = F.greatest(F.lit(0), centre - half)
        out = out.withColumn(hi, F.least(F.col(page), near + F.col("side"))).withColumn(
            lo, F.greatest(F.lit(0), F.col(hi) - F.col("side"))
        )
    return out


def round_up(c: Column, m: int) -> Column:
    return (F.floor((c + F.lit(m - 1)) / m) * m).cast("int")


# -- spatial joins ----------------------------------------------------------


def _cells(lo: str | Column, hi: str | Column, size: int) -> Column:
    lo = F.col(lo) if isinstance(lo, str) else lo
    hi = F.col(hi) if isinstance(hi, str) else hi
    return F.sequence(F.floor(lo / size).cast("int"), F.floor(hi / size).cast("int"))


def _clipped(boxes: DataFrame, page: str, cell: int) -> DataFrame:
    """Boxes cut at cell borders and made distinct per cell.

    The many boxes that cover a whole cell of a crowded page shrink to one row; of boxes
    with the same left, right and top edge only the deepest stays.
    """
    parts = boxes.select(page, "x1", "y1", "x2", "y2", F.explode(_cells("x1", "x2", cell)).alias("gx")).select(
        "*", F.explode(_cells("y1", "y2", cell)).alias("gy")
    )
    x, y = F.col("gx") * cell, F.col("gy") * cell
    return (
        parts.select(
            page, "gx", "gy", F.greatest("x1", x).alias("x1"), F.least("x2", x + (cell - 1)).alias("x2"),
            F.greatest("y1", y).alias("y1"), F.least("y2", y + (cell - 1)).alias("y2"),
        )
        .groupBy(page, "gx", "gy", "x1", "x2", "y1").agg(F.max("y2").alias("y2"))
    )


def in_any_box(points: DataFrame, boxes: DataFrame, page: str = "image_id", cell: int = 128) -> DataFrame:
    """Add ``inside``: whether the point (cx, cy) lies in any box of its page, edges included.

    A semi and an anti join over the same two shuffled sides; neither emits a pair. No key
    can be null, so both joins read their sides in the same form and share the shuffles.
    """
    spots = points.withColumns({c: F.coalesce(c, F.lit(-(2**31))) for c in ("cx", "cy")})
    row_of = lambda c: F.coalesce(F.floor(F.col(c) / cell).cast("int"), F.lit(0))
    spots = spots.withColumns({"gx": row_of("cx"), "gy": row_of("cy")})
    s, b = spots.alias("s"), _clipped(boxes, page, cell).alias("b")
    match = (
        F.col(f"s.{page}").eqNullSafe(F.col(f"b.{page}")) & (F.col("s.gx") == F.col("b.gx")) & (F.col("s.gy") == F.col("b.gy"))
        & F.col("s.cx").between(F.col("b.x1"), F.col("b.x2")) & F.col("s.cy").between(F.col("b.y1"), F.col("b.y2"))
    )
    hit = s.join(b, match, "left_semi").withColumn("inside", F.lit(True))
    miss = s.join(b, match, "left_anti").withColumn("inside", F.lit(False))
    return hit.unionByName(miss).drop("gx", "gy")


def tag_kind(items: DataFrame, boxes: DataFrame, page: str = "image_id") -> DataFrame:
    """Set ``kind`` to ``bubble`` where an item's centre lies in a bubble box, else ``sfx``."""
    cx = F.col("x") + F.floor(F.col("w") / 2).cast("int")
    cy = F.col("y") + F.floor(F.col("h") / 2).cast("int")
    bubbles = boxes.where(F.col("class").isin(*BUBBLE_CLASSES))
    tagged = in_any_box(items.withColumn("cx", cx).withColumn("cy", cy), bubbles, page)
    kind = F.when(F.col("inside"), F.lit("bubble")).otherwise(F.lit("sfx"))
    return tagged.withColumn("kind", kind).drop("inside", "cx", "cy")


def grown(lines: DataFrame) -> DataFrame:
    """Add the reach of each line (gx1, gy1, gx2, gy2): its box grown by parts of its height."""
    mx, my = F.lit(GROW[0]) * F.col("h"), F.lit(GROW[1]) * F.col("h")
    return (
        lines.withColumn("gx1", F.col("x") - mx).withColumn("gy1", F.col("y") - my)
        .withColumn("gx2", F.col("x") + F.col("w") + mx).withColumn("gy2", F.col("y") + F.col("h") + my)
    )


def _gridded(rects: DataFrame, cell: int, inside: int | None = None) -> DataFrame:
    """One row per touched cell; with ``inside``, only cells of the coarser cell (px, py) of that size."""
    for lo, hi, parent, out in (("gx1", "gx2", "px", "cx"), ("gy1", "gy2", "py", "cy")):
        first, last = F.col(lo), F.col(hi)
        if inside:
            first = F.greatest(first, F.col(parent) * inside)
            last = F.least(last, F.col(parent) * inside + inside - cell)
        rects = rects.select("*", F.explode(_cells(first, last, cell)).alias(out))
    return rects


def overlap_pairs(lines: DataFrame, page: str = "image_id", ident: str = "box_id", cell: int = 256, crowd: int = 2048) -> DataFrame:
    """Pairs (page, a, b), a < b, of lines whose reaches touch (closed rectangles).

    A pair is reported only by the cell that holds the corner of its intersection, so no ``distinct`` is needed. The lines of
    a cell with more than ``crowd`` of them are dealt into blocks, and each pair of blocks is swept by itself.
    """
    where = [page, "cx", "cy"]
    g = _gridded(grown(lines).select(page, ident, "gx1", "gy1", "gx2", "gy2"), cell)
    small, hot = split_hot(g, where, crowd)
    a, b = small.alias("a"), small.alias("b")
    left, top = F.greatest("a.gx1", "b.gx1"), F.greatest("a.gy1", "b.gy1")
    pairs = a.join(
        b,
        (F.col(f"a.{page}") == F.col(f"b.{page}")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))
        & (F.col(f"a.{ident}") < F.col(f"b.{ident}"))
        & (left <= F.least("a.gx2", "b.gx2")) & (top <= F.least("a.gy2", "b.gy2"))
        & (F.floor(left / cell) == F.col("a.cx")) & (F.floor(top / cell) == F.col("a.cy")),
    ).select(F.col(f"a.{page}").alias(page), F.col(f"a.{ident}").alias("a"), F.col(f"b.{ident}").alias("b"))
    return pairs if hot is None else pairs.unionByName(_crowded_pairs(hot, page, ident, cell, crowd))


def block_pairs(rows: DataFrame, keys: list[str], ident: str, size: int) -> DataFrame:
    """Rows of a group dealt into blocks of about ``size`` rows and copied to each pair (i, j), i <= j, of its blocks, with their own block ``mine``."""
    spread = F.pmod(F.xxhash64(ident), F.lit(1 << 30))
    count = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias("_of"))
    dealt = look_up(rows, count, keys, F.pmod(F.xxhash64(ident), F.lit(64)))
    dealt = dealt.withColumn("mine", (spread % F.col("_of")).cast("int"))
    other = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    return other.withColumn("i", F.least("mine", "_other")).withColumn("j", F.greatest("mine", "_other")).drop("_of", "_other")


def _crowded_pairs(g: DataFrame, page: str, ident: str, cell: int, crowd: int) -> DataFrame:
    where = [page, "cx", "cy"]

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rectangles by left edge: each meets those that start before it ends."""
        pdf = pdf.sort_values("gx1", kind="stable")
        x1, x2, y1, y2 = (pdf[c].to_numpy(float) for c in ("gx1", "gx2", "gy1", "gy2"))
        ids, mine = pdf[ident].to_numpy(), pdf["mine"].to_numpy()
        first, both = np.arange(1, len(x1) + 1), pdf["i"].iloc[0] != pdf["j"].iloc[0]
        count = np.searchsorted(x1, x2, "right") - first
        out = []
        for lo in range(0, len(x1), 256):
            n = np.maximum(count[lo : lo + 256], 0)
            a = np.repeat(np.arange(lo, lo + len(n)), n)
            b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + first[a]
            top = np.maximum(y1[a], y1[b])
            hit = top <= np.minimum(y2[a], y2[b])
            hit &= (np.floor(x1[b] / cell) == pdf["cx"].iloc[0]) & (np.floor(top / cell) == pdf["cy"].iloc[0])
            if both:
                hit &= mine[a] != mine[b]
            a, b = ids[a[hit]], ids[b[hit]]
            out.append(pd.DataFrame({page: [pdf[page].iloc[0]] * len(a), "a": np.minimum(a, b), "b": np.maximum(a, b)}))
        return pd.concat(out, ignore_index=True)

    kinds = {c: g.schema[c].dataType.simpleString() for c in (page, ident)}
    dealt = block_pairs(g, where, ident, crowd)
    return dealt.groupBy(*where, "i", "j").applyInPandas(sweep, f"{page} {kinds[page]}, a {kinds[ident]}, b {kinds[ident]}")


def merge_intervals(df: DataFrame, key: str = "image_id", lo: str = "a", hi: str = "b") -> DataFrame:
    """Union of half-open row ranges per image: disjoint (key, a, b).

    Ranges with the same start are reduced first, so a window holds at most one row per
    image row, however many ranges an image has.
    """
    starts = df.where(F.col(hi) > F.col(lo)).groupBy(key, F.col(lo).alias("a")).agg(F.max(hi).alias("b"))
    w = Window.partitionBy(key).orderBy("a")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = starts.withColumn("_new", F.when(reach >= F.col("a"), 0).otherwise(1))
    islands = opened.withColumn("_island", F.sum("_new").over(w))
    return islands.groupBy(key, "_island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_island")


# -- clusters of text lines -------------------------------------------------


PAIRS_AT_ONCE = 1 << 20


def _batch_components(x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
    """Component label (an index) of every line, for an Arrow batch of small pages.

    Runs of pages are taken together as long as they have PAIRS_AT_ONCE pairs of lines at most (a page alone may have more),
    so memory does not grow with the batch.
    """
    turn = np.cumsum(x.map(len).to_numpy().astype(np.int64) ** 2) // PAIRS_AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(x)]
    runs = [_run_components(*(c.iloc[a:b] for c in (x, y, w, h))) for a, b in zip(cuts, cuts[1:]) if b > a]
    return pd.concat(runs, ignore_index=True) if runs else pd.Series([], dtype=object)


def _run_components(x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
    sizes = x.map(len).to_numpy()
    x, y, w, h = (np.concatenate(c.to_list()) for c in (x, y, w, h))
    mx, my = GROW[0] * h, GROW[1] * h
    x1, y1, x2, y2 = x - mx, y - my, x + w + mx, y + h + my
    ends = np.cumsum(sizes)
    first = ends - sizes
    # every rectangle against the rectangles of its own page
    owner = np.repeat(np.arange(len(sizes)), sizes)
    fan = sizes[owner]
    left = np.repeat(np.arange(len(x1)), fan)
    right = first[owner[left]] + np.arange(len(left)) - np.repeat(np.cumsum(fan) - fan, fan)
    hit = (
        (left < right)
        & (x2[left] >= x1[right]) & (x2[right] >= x1[left])
        & (y2[left] >= y1[right]) & (y2[right] >= y1[left])
    )
    left, right = left[hit], right[hit]
    label = np.arange(len(x1))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return pd.Series(np.split(label - first[owner], ends[:-1]))


_FIELDS = ("box_id", "x", "y", "w", "h", "text", "conf")


def _small_labels(lines: DataFrame, page: str) -> DataFrame:
    """Lines of pages of bounded size with their cluster label.

    One array per page, one kernel call per Arrow batch. The rows ride along in the array,
    so nothing has to be joined back, and the output is still partitioned by page.
    """
    kernel = F.pandas_udf(_batch_components, "array<bigint>")
    lists = lines.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(*_FIELDS))).alias("_r"))
    labelled = lists.withColumn("_l", kernel(*[F.col(f"_r.{c}") for c in ("x", "y", "w", "h")]))
    rows = F.transform(
        "_r", lambda r, i: F.struct(r.alias("r"), F.get("_r", F.get("_l", i).cast("int"))["box_id"].alias("label"))
    )
    return labelled.select(page, F.explode_outer(rows).alias("p")).select(page, "p.r.*", "p.label")


def sparse_edges(rects: DataFrame, page: str = "image_id", sizes=(256, 32, 4), crowded: int = 48) -> DataFrame:
    """Few edges (page, a, b; some twice) that connect exactly what all overlaps of the rectangles connect.

    In a grid cell that some rectangle covers fully, everything in the cell touches that
    one rectangle: a star replaces all pairs. A sparse cell lists its touching pairs. A
    crowded cell without a cover is cut into finer cells; the last size lists its pairs.
    """
    rest, parts = rects.select(page, F.col("box_id").alias("id"), "gx1", "gy1", "gx2", "gy2"), []
    for i, size in enumerate(sizes):
        last = i == len(sizes) - 1
        cells = _gridded(rest, size, inside=sizes[i - 1] if i else None).drop("px", "py")
        covers = (
            (F.col("gx1") <= F.col("cx") * size) & (F.col("gx2") >= F.col("cx") * size + size)
            & (F.col("gy1") <= F.col("cy") * size) & (F.col("gy2") >= F.col("cy") * size + size)
        )
        stats = cells.groupBy(page, "cx", "cy").agg(
            F.min(F.when(covers, F.col("id"))).alias("hub"), F.count("*").alias("n")
        ).where("n > 1")
        marked = cells.join(stats, [page, "cx", "cy"])
        parts.append(marked.where("hub is not null and hub <> id").select(page, F.col("hub").alias("a"), F.col("id").alias("b")))
        listed = marked.where("hub is null" if last else f"hub is null and n <= {crowded}")
        a, b = listed.alias("a"), listed.alias("b")
        parts.append(
            a.join(
                b,
                (F.col(f"a.{page}") == F.col(f"b.{page}")) & (F.col("a.cx") == F.col("b.cx"))
                & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.id") < F.col("b.id"))
                & (F.greatest("a.gx1", "b.gx1") <= F.least("a.gx2", "b.gx2"))
                & (F.greatest("a.gy1", "b.gy1") <= F.least("a.gy2", "b.gy2")),
            ).select(F.col(f"a.{page}").alias(page), F.col("a.id").alias("a"), F.col("b.id").alias("b"))
        )
        if not last:
            rest = marked.where(f"hub is null and n > {crowded}").select(
                page, "id", "gx1", "gy1", "gx2", "gy2", F.col("cx").alias("px"), F.col("cy").alias("py")
            )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _hot_labels(rects: DataFrame, page: str, local: int = 1 << 14) -> DataFrame:
    """Rectangles of pages of any size with their cluster label: sparse edges, then their components, by star contraction on pages with over ``local`` edges."""
    shape = [page, "gx1", "gy1", "gx2", "gy2"]
    # equal rectangles are one node, which carries their rows: they end in one cluster anyway
    own = F.collect_list(F.struct(*[c for c in rects.columns if c not in shape]))
    nodes = durable(rects.groupBy(*shape).agg(F.min("box_id").alias("node"), own.alias("_rows")))
    edges = sparse_edges(nodes.select(*shape, F.col("node").alias("box_id")), page)
    labels, _ = components(edges, [page], local=local)
    named = nodes.join(labels.withColumnRenamed("id", "node"), [page, "node"], "left")
    return named.select(page, F.coalesce("label", "node").alias("label"), F.explode("_rows").alias("r")).select(page, "r.*", "label")


def line_labels(lines: DataFrame, page: str = "image_id", limit: int = 256) -> DataFrame:
    """Lines (page, box_id, x, y, w, h, text, conf) with ``label``, the least box_id of their cluster.

    Pages of up to ``limit`` lines are labelled in Arrow batches; larger pages by the
    distributed method. Both are exact.
    """
    slim = lines.select(page, *_FIELDS)
    small, hot = split_hot(slim, [page], limit)
    out = _small_labels(small, page)
    if hot is None:
        return out
    return out.unionByName(_hot_labels(grown(hot), page).select(*out.columns))


def group_lines(lines: DataFrame, page: str = "image_id", limit: int = 256) -> DataFrame:
    """Merge dialogue lines of one bubble; sound effects pass through.

    Merged rows hold the union box, the texts joined in reading order, the least
    confidence, and script ``latin``. Output: (page, group_id, x, y, w, h, text, conf, kind, script).
    """
    labelled = line_labels(lines.where("kind = 'dialogue'"), page, limit)
    merged = labelled.groupBy(page, F.col("label").alias("group_id")).agg(
        F.min("x").alias("x"), F.min("y").alias("y"),
        (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"),
        (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"),
        F.array_join(F.array_sort(F.collect_list(F.struct("y", "x", "box_id", "text"))).getField("text"), " ").alias("text"),
        F.bround(F.min("conf"), 3).alias("conf"),
        F.lit("dialogue").alias("kind"), F.lit("latin").alias("script"),
    )
    loose = lines.where("kind = 'sfx'").select(
        page, F.col("box_id").alias("group_id"), "x", "y", "w", "h", "text", "conf", "kind", "script"
    )
    return merged.unionByName(loose)


# -- gaps, masks, counts ----------------------------------------------------


def gaps(boxes: DataFrame, page: str = "image_id", pos: str = "box_id") -> DataFrame:
    """Add next_y, gap and mid: distance to the next box by top edge, and the row halfway.

    The next top is this top again unless the box is the last at its height, so only one
    row per distinct top goes through the window.
    """
    tops = boxes.groupBy(page, "y").agg(F.max(pos).alias("_last"))
    tops = tops.withColumn("_below", F.lead("y").over(Window.partitionBy(page).orderBy("y")))
    bottom = F.col("y") + F.col("h")
    return (
        boxes.join(tops, [page, "y"])
        .withColumn("next_y", F.when(F.col(pos) < F.col("_last"), F.col("y")).otherwise(F.col("_below")))
        .withColumn("gap", F.col("next_y") - bottom)
        .withColumn("mid", (bottom + F.col("next_y")) / 2)
        .drop("_last", "_below")
    )


def box_coverage(runs: DataFrame, boxes: DataFrame, least: float = 0.10, page: str = "image_id", limit: int = 1 << 16) -> DataFrame:
    """Share of each box covered by mask runs (page, y, x0, x1 half-open), and whether to erase it whole.

    Box edges are inclusive. Boxes are exchanged once; on pages with more than ``limit`` of them equal ones are measured once.
    """
    shape = [page, "x1", "y1", "x2", "y2"]
    few, many = split_hot(boxes, [page], limit)
    out = _covered(runs, few, page)
    if many is not None:
        out = out.unionByName(many.join(_covered(runs, many.select(*shape).distinct(), page), shape))
    area = (F.col("x2") - F.col("x1") + 1) * (F.col("y2") - F.col("y1") + 1)
    return out.withColumn("area", area.cast("bigint")).withColumn("whole", F.col("covered") / F.col("area") < least)


def _covered(runs: DataFrame, boxes: DataFrame, page: str) -> DataFrame:
    """Add ``covered``: pixels of a box inside the mask.

    A box meets the runs of a block of rows at least as high as itself, and of the next one, in a single list; a list is
    at most some four times as long as what the box spans (256 rows at least).
    """
    # block height by box height, as a power of two: the few that occur reach the driver
    placed = boxes.withColumn("_bits", F.greatest(F.lit(6), F.expr("cast(ceil(log2(y2 - y1 + 1)) as int)")))
    sizes = sorted(r[0] for r in placed.select("_bits").distinct().collect()) or [6]
    near = runs.select(page, "y", "x0", "x1", F.explode(F.array(*map(F.lit, sizes))).alias("_bits"))
    blk = F.expr("shiftright(y, _bits)")
    lists = near.withColumn("_blk", F.explode(F.array(blk, blk - 1))).groupBy(page, "_bits", "_blk").agg(
        F.collect_list(F.struct("y", "x0", "x1")).alias("_runs")
    )

    def add(total: Column, r: Column) -> Column:
        inside = F.greatest(F.lit(0), F.least(r["x1"], F.col("x2") + 1) - F.greatest(r["x0"], F.col("x1")))
        return total + F.when(r["y"].between(F.col("y1"), F.col("y2")), inside).otherwise(0).cast("bigint")

    met = placed.withColumn("_blk", F.expr("shiftright(y1, _bits)")).join(lists, [page, "_bits", "_blk"], "left")
    covered = F.coalesce(F.aggregate("_runs", F.lit(0).cast("bigint"), add), F.lit(0).cast("bigint"))
    return met.withColumn("covered", covered).drop("_bits", "_blk", "_runs")


def in_mask(boxes: DataFrame, runs: DataFrame, page: str = "image_id") -> DataFrame:
    """Boxes (with quad) whose mean point, clipped to the page, lies in a mask run."""
    mean = lambda f: F.aggregate("quad", F.lit(0.0), lambda acc, p: acc + p[f]) / F.size("quad")
    spot = boxes.withColumn("_cx", F.least(F.greatest(mean("x"), F.lit(0.0)), F.col("page_w") - 1.0).cast("int")).withColumn(
        "_cy", F.least(F.greatest(mean("y"), F.lit(0.0)), F.col("page_h") - 1.0).cast("int")
    )
    b, r = spot.alias("b"), runs.alias("r")
    return b.join(
        r,
        (F.col(f"b.{page}") == F.col(f"r.{page}")) & (F.col("b._cy") == F.col("r.y"))
        & (F.col("b._cx") >= F.col("r.x0")) & (F.col("b._cx") < F.col("r.x1")),
        "left_semi",
    ).drop("_cx", "_cy")


def counts(df: DataFrame, by: list[str], **conditions: Column) -> DataFrame:
    """Rows per key and, per named condition, how many rows meet it."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])
