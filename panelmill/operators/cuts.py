"""Cutting long canvases at safe rows.

Pixels are read once and leave a small row table (cost and detail counts per row). All
decisions work on that table. A canvas is at most a few ten thousand rows tall, so the
per-image walk of a cut search sees a bounded group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import ends_sentence, let
from ..session import durable
from .boxes import gaps, merge_intervals
from .graphs import path
from .ordering import in_groups, look_up, running, split_hot
from .rhythm import STEP, cuts_along, cuts_within

# Panel heights relative to the width, margins and thresholds.
MAX_RATIO = 1.25
IDEAL_RATIO = 0.8
MIN_RATIO = 0.35
MARGIN = 4
ART_MIN = 0.012
EDGE = 8
EDGE_THRESHOLD = 30


# -- row table from row arrays (JVM only) ------------------------------------


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def row_cost(px: Column) -> Column:
    """Spread plus horizontal detail of one row of grey values: variance/255 + mean |difference|."""
    n = F.size(px)
    total = F.aggregate(px, F.lit(0).cast("bigint"), lambda s, v: s + v)
    squares = F.aggregate(px, F.lit(0).cast("bigint"), lambda s, v: s + v * v)
    # integer sums keep the variance exact
    var = (n * squares - total * total) / (n * n)
    steps = F.zip_with(F.slice(px, F.lit(2), n - 1), F.slice(px, F.lit(1), n - 1), lambda b, a: F.abs(b - a))
    return var / 255.0 + F.aggregate(steps, F.lit(0).cast("bigint"), lambda s, v: s + v) / (n - 1)


def row_profile(rows: DataFrame, px: str = "px") -> DataFrame:
    """(image_id, y, cost) from rows of grey values."""
    return rows.select("image_id", "y", row_cost(F.col(px)).alias("cost"))


def _in_parts(rows: DataFrame, reach: int, bits: int = 16) -> DataFrame:
    """Rows cut into parts of 2 ** bits rows of an image (_blk); rows near a border are copied to the part beyond it (not _own)."""
    of = lambda by: F.shiftright(F.col("y") + by, bits)
    parts = rows.withColumn("_blk", F.explode(F.array_distinct(F.array(of(0), of(-reach), of(reach)))))
    return parts.withColumn("_own", F.col("_blk") == of(0))


def smooth(profile: DataFrame, bits: int = 16) -> DataFrame:
    """Mean of five rows, counting rows outside the image as zero."""
    w = Window.partitionBy("image_id", "_blk").orderBy("y").rowsBetween(-2, 2)
    return _in_parts(profile, 2, bits).withColumn("cost", F.sum("cost").over(w) / 5.0).where("_own").drop("_blk", "_own")


def forbidden(protect: DataFrame, images: DataFrame, margin: int = MARGIN) -> DataFrame:
    """Disjoint half-open row ranges (image_id, a, b) that no cut may enter."""
    wide = protect.join(images.select("image_id", "h"), "image_id").select(
        "image_id",
        F.greatest(F.lit(0), F.col("y0").cast("int") - margin).alias("a"),
        F.least(F.col("h"), F.col("y1").cast("int") + margin).alias("b"),
    )
    return merge_intervals(wide)


def free_rows(profile: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows outside all ranges. Ranges are disjoint, so listing their rows stays within image size
    and the anti join hashes on (image_id, y)."""
    return profile.join(_listed(ranges, "a", "b", "image_id"), ["image_id", "y"], "left_anti")


def _listed(spans: DataFrame, first: str, end: str, *keep: str) -> DataFrame:
    """The rows ``y`` of half-open spans, to be joined by (image_id, y).

    Spark takes a listing to be as small as its spans and would broadcast every row; the hint keeps the join in exchanges.
    """
    return spans.select(*keep, F.explode(F.sequence(F.col(first), F.col(end) - 1)).alias("y")).hint("merge")


def detail_rows(rows: DataFrame, px: str = "px", bits: int = 16) -> DataFrame:
    """(image_id, y, width, mid, top, bot): pixels with strong edges per row.

    ``mid`` counts with both neighbour rows; ``top`` and ``bot`` count as if the row were
    the first or last of a slice (the edge is mirrored there), so that the detail of any
    slice is a sum over this table.
    """
    w = Window.partitionBy("image_id", "_blk").orderBy("y")
    n = F.size("c")

    def across(a: Column) -> Column:
        # right minus left neighbour; mirrored at both ends, hence zero there
        return F.transform(a, lambda v, i: F.when((i == 0) | (i == n - 1), F.lit(0)).otherwise(F.get(a, i + 1) - F.get(a, i - 1)))

    # a row's slopes are worked out once, after its exchange, and seen by its neighbours
    parts = _in_parts(rows.select("image_id", "y", F.col(px).alias("c")), 1, bits).repartition("image_id", "_blk")
    sloped = parts.withColumn("xc", across(F.col("c")))
    around = sloped.select(
        "image_id", "y", "c", F.lag("c").over(w).alias("u"), F.lead("c").over(w).alias("d"), "xc",
        F.lag("xc").over(w).alias("xu"), F.lead("xc").over(w).alias("xd"), "_own",
    ).where("_own")

    def down(a: Column, b: Column) -> Column:
        left = lambda i: F.when(i == 0, F.lit(1)).otherwise(i - 1)
        right = lambda i: F.when(i == n - 1, n - 2).otherwise(i + 1)
        return let(
            F.zip_with(b, a, lambda q, p: q - p),
            lambda step: F.transform(step, lambda v, i: F.get(step, left(i)) + 2 * v + F.get(step, right(i))),
        )

    def strong(gx: Column, gy: Column | None = None) -> Column:
        mag = F.transform(gx, F.abs) if gy is None else F.zip_with(gx, gy, lambda a, b: F.abs(a) + F.abs(b))
        return F.size(F.filter(mag, lambda v: v > EDGE_THRESHOLD))

    slopes = around.withColumn("dy", F.when(F.col("u").isNotNull() & F.col("d").isNotNull(), down(F.col("u"), F.col("d"))))
    full = F.zip_with(F.zip_with("xu", "xd", lambda a, b: a + b), "xc", lambda s, c: s + 2 * c)
    edge = lambda other: F.zip_with("xc", other, lambda a, b: 2 * a + 2 * b)
    return slopes.select(
        "image_id", "y", n.alias("width"),
        F.when(F.col("dy").isNotNull(), strong(full, F.col("dy"))).alias("mid"),
        F.when(F.col("d").isNotNull(), strong(edge("xd"))).alias("top"),
        F.when(F.col("u").isNotNull(), strong(edge("xu"))).alias("bot"),
    )


def art_scores(slices: DataFrame, detail: DataFrame, ranges: DataFrame) -> DataFrame:
    """Share of strong-edge pixels outside forbidden rows per slice; 0 below two rows or with no free row.

    Slices list their rows, so the join hashes on (image_id, y).
    """
    listed = _listed(slices.where("y1 - y0 >= 2"), "y0", "y1", "image_id", "k", "y0", "y1")
    free = free_rows(detail, ranges)
    hits = F.when(F.col("y") == F.col("y0"), F.col("top")).when(F.col("y") == F.col("y1") - 1, F.col("bot")).otherwise(F.col("mid"))
    scored = listed.join(free, ["image_id", "y"]).groupBy("image_id", "k").agg(
        (F.sum(hits) / F.sum("width")).alias("art")
    )
    return slices.join(scored.hint("merge"), ["image_id", "k"], "left").withColumn("art", F.coalesce("art", F.lit(0.0)))


def argmin_row(profile: DataFrame, score: str = "cost") -> DataFrame:
    """Cheapest row per image, the uppermost on ties."""
    return profile.groupBy("image_id").agg(F.min_by("y", F.struct(score, "y")).alias("y"))


# -- cut search ---------------------------------------------------------------


class _Rows:
    """The allowed rows of one image, or of a part that starts at row ``base``, with their costs: a window of rows is a slice found by bisection."""

    def __init__(self, cost: np.ndarray, free: np.ndarray, base: int = 0):
        at = np.flatnonzero(free)
        self.y, self.cost = at + base, cost[at]

    def cheapest(self, lo: int, hi: int, aim: float, pull: float) -> int | None:
        """Row of least cost in [lo, hi) with a pull toward ``aim``; None when the window holds no allowed row."""
        part = slice(*np.searchsorted(self.y, (lo, hi)))
        y, cost = self.y[part], self.cost[part]
        if not y.size:
            return None
        bias = pull * (float(np.ptp(cost)) or 1.0) / max(1, hi - lo)
        return int(y[np.argmin(cost + bias * np.abs(y - aim))])

    def next_from(self, lo: int) -> int | None:
        at = np.searchsorted(self.y, lo)
        return int(self.y[at]) if at < self.y.size else None


def _chain(link, start: int = 0) -> list[int]:
    """Follow ``link`` (a boundary to the next one, or None) from a start."""
    out, at = [], link(start)
    while at is not None:
        out.append(at)
        at = link(at)
    return out


def _size_link(rows: _Rows, height: int, low: int, ideal: int, high: int):
    """The boundary after a given one when panels are cut by size: the best row that leaves both sides high enough, else the first
    allowed row below; none where the rest fits one panel."""

    def link(at: int) -> int | None:
        stop = min(at + high, height - low)
        if height - at <= high or stop <= at + low:
            return None
        best = rows.cheapest(at + low, stop, at + ideal, 0.25)
        return rows.next_from(stop) if best is None else best

    return link


def _story_link(rows: _Rows, height: int, width: int, targets):
    """The boundary after a given one when panels follow story cuts: that of the first target below it with an allowed row in reach.

    A target is used once, as the boundary it gave may lie above it.
    """
    aims = np.unique(np.asarray(targets).astype(np.int64))
    aims, reach = aims[aims < height - EDGE], max(60, int(width * 0.45))

    left = iter(aims.tolist())

    def link(at: int) -> int | None:
        floor = at + EDGE
        near = (rows.cheapest(max(floor, t - reach), min(height - EDGE, t + reach), t, 0.6) for t in left if t > floor)
        return next((y for y in near if y is not None and y > floor), None)

    return link


def slice_sums(bounds: list[int], rows: dict[str, np.ndarray]) -> pd.DataFrame:
    """What merging needs of each slice: edge counts of all its rows, of its first and last one, and its free rows."""
    b = np.asarray(bounds)
    first, last = b[:-1], b[1:] - 1
    held = {c: np.where(rows["free"], rows[c], 0).astype(np.int64) for c in ("mid", "top", "bot")}
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[b])
    return pd.DataFrame({
        "y0": first, "y1": last + 1, "inner": total(held["mid"]), "clear": total(np.asarray(rows["free"], np.int64)),
        "mid0": held["mid"][first], "mid1": held["mid"][last], "top0": held["top"][first], "bot1": held["bot"][last],
    })


def absorbed(slices: pd.DataFrame, width: int, low: int) -> list[int]:
    """Merge slices (in order, as from ``slice_sums``) that are short or hold no drawing into the neighbour with more of it.

    The slices are a linked list, and a merged one is looked at again, so a merge costs a constant.
    """
    cell = {c: slices[c].tolist() for c in slices.columns}
    n = len(slices)
    back, on = list(range(-1, n - 1)), [*range(1, n), -1]

    def art(i: int) -> float:
        rows, clear = cell["y1"][i] - cell["y0"][i], cell["clear"][i]
        if rows < 2 or clear == 0:
            return 0.0
        return float(cell["inner"][i] - cell["mid0"][i] - cell["mid1"][i] + cell["top0"][i] + cell["bot1"][i]) / float(clear * width)

    score = [art(i) for i in range(n)]
    at = 0
    while at >= 0:
        fine = cell["y1"][at] - cell["y0"][at] >= low and score[at] >= ART_MIN
        if fine or back[at] == on[at] == -1:
            at = on[at]
            continue
        up, down = back[at], on[at]
        at, gone = (at, down) if up < 0 or (down >= 0 and score[up] < score[down]) else (up, at)
        for c in ("y1", "mid1", "bot1"):
            cell[c][at] = cell[c][gone]
        for c in ("inner", "clear"):
            cell[c][at] += cell[c][gone]
        on[at] = on[gone]
        if on[at] >= 0:
            back[on[at]] = at
        score[at] = art(at)
    out, at = [], 0
    while at >= 0:
        out.append(cell["y0"][at])
        at = on[at]
    return [*out, cell["y1"][-1]]


def panel_window(width: int, max_h=None, ideal_h=None, min_h=None) -> tuple[int, int, int]:
    """(least, ideal, most) panel height for an image width, each at most the next."""
    most = int(max_h or width * MAX_RATIO)
    least = min(max(1, int(min_h or width * MIN_RATIO)), max(1, most))
    return least, int(np.clip(int(ideal_h or width * IDEAL_RATIO), least, max(least, most))), most


def panel_bounds(width, height, rows, targets, merge=True, **window) -> list[int]:
    """Slice boundaries of one image from its row table."""
    low, ideal, high = panel_window(width, **window)
    table = _Rows(rows["cost"], rows["free"])
    told = targets is not None and len(targets) > 0
    if not told and height <= high:
        return [0, height]
    link = _story_link(table, height, width, targets) if told else _size_link(table, height, low, ideal, high)
    bounds = [0, *_chain(link), height]
    return absorbed(slice_sums(bounds, rows), width, low) if merge else bounds


def split_panels(
    profile: DataFrame,
    detail: DataFrame,
    images: DataFrame,
    ranges: DataFrame,
    targets: DataFrame | None = None,
    merge: bool = True,
    limit: int = 1 << 17,
    block: int = 1 << 16,
    by_size: bool = True,
    **window,
) -> DataFrame:
    """Panels (image_id, k, y0, y1, searched), k from 0, that cover every image without gaps.

    ``profile`` is the smoothed cost, ``detail`` the edge counts, ``ranges`` the merged
    forbidden rows, ``targets`` (image_id, t) the story cuts: images that have any snap to
    them, the others are cut by size, or stay whole without ``by_size``. Images short enough to stay whole never reach the
    search; an image that should be cut but has no rows in the table stays whole too, with ``searched`` false.

    An image of up to ``limit`` rows is searched as one Arrow group. A taller one that is cut by size is searched in blocks of
    ``block`` rows; its slices, not its rows, meet for merging. Story cuts depend on the cut before, so such an image is one group.
    """
    high = F.lit(int(window["max_h"])) if window.get("max_h") else F.floor(F.col("w") * MAX_RATIO)
    wanted = images
    if targets is not None:
        aims = targets.groupBy("image_id").agg(F.array_sort(F.collect_set(F.col("t").cast("int"))).alias("aims"))
        wanted = wanted.join(aims, "image_id", "left")
    else:
        wanted = wanted.withColumn("aims", F.lit(None).cast("array<int>"))
    fits = (F.col("h") <= high) if by_size else F.lit(True)
    whole = wanted.where(fits & F.col("aims").isNull()).select(
        "image_id", F.lit(0).alias("k"), F.lit(0).alias("y0"), F.col("h").cast("int").alias("y1"), F.lit(True).alias("searched")
    )
    taken = _listed(ranges.withColumn("free", F.lit(False)), "a", "b", "image_id", "free")
    tall = wanted.where(~fits | F.col("aims").isNotNull()).select("image_id", "w", "h", "aims")
    huge = tall.where((F.col("h") > limit) & F.col("aims").isNull())
    tall = tall.where((F.col("h") <= limit) | F.col("aims").isNotNull())
    table = profile.join(detail, ["image_id", "y"]).join(taken, ["image_id", "y"], "left")
    table = table.select("image_id", "y", "cost", F.coalesce("free", F.lit(True)).alias("free"), *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("mid", "top", "bot")])
    kind = images.schema["image_id"].dataType.simpleString()
    # an image's sizes and targets come once, above its rows
    heads = tall.withColumn("y", F.lit(-1))
    rows = table.join(tall.select("image_id"), "image_id", "left_semi").unionByName(heads, allowMissingColumns=True)

    def search(part: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        cols = {c: part[c].to_numpy() for c in ("image_id", "w", "h", "aims")}
        held = {c: part[c].to_numpy(t) for c, t in (("cost", float), ("mid", float), ("top", float), ("bot", float))}
        held["free"] = part["free"].eq(True).to_numpy(bool)
        out = []
        for at, end in zip(first, np.append(first[1:], len(part))):
            h = int(cols["h"][at])
            b, found = [0, h], end > at + 1
            if found:
                b = panel_bounds(int(cols["w"][at]), h, {c: v[at + 1 : end] for c, v in held.items()}, cols["aims"][at], merge=merge, **window)
            out.append((cols["image_id"][at], b, found))
        size = [len(b) - 1 for _, b, _ in out]
        join = lambda lists: np.concatenate([np.asarray(x, np.int64) for x in lists])
        return pd.DataFrame({
            "image_id": np.repeat(np.array([i for i, _, _ in out], part["image_id"].dtype), size), "k": join([np.arange(n) for n in size]),
            "y0": join([b[:-1] for _, b, _ in out]), "y1": join([b[1:] for _, b, _ in out]), "searched": np.repeat([f for _, _, f in out], size),
        })

    cut = in_groups(rows, ["image_id"], ["y"], search, f"image_id {kind}, k int, y0 int, y1 int, searched boolean")
    blocks = split_blocks(table, huge.drop("aims"), merge, block, window)
    return whole.unionByName(cut) if blocks is None else whole.unionByName(cut).unionByName(blocks)


def split_blocks(table: DataFrame, images: DataFrame, merge: bool, block: int, window: dict) -> DataFrame | None:
    """Panels of images (image_id, w, h) of any height from their row table, by blocks of rows; None without images.

    The best row after a boundary lies within a panel's greatest height below it, so a block with that many rows of the next one
    finds all links from the boundaries it may hold: those that its uppermost rows lead to. Where no row is free, a link seeks the
    first free row that the blocks below have beyond this one's reach. The walk from row 0 then takes a few rounds (``graphs.path``).
    """
    if images.isEmpty():
        return None
    images = durable(images)
    kind = images.schema["image_id"].dataType.simpleString()
    most = F.lit(int(window["max_h"])) if window.get("max_h") else F.floor(F.col("w") * MAX_RATIO)
    sizes = images.withColumn("_high", most.cast("bigint")).withColumn("_s", F.greatest(F.lit(block), 4 * F.col("_high")))
    rows = durable(look_up(table, sizes, ["image_id"], F.shiftright("y", 16)))
    own = F.expr("cast(y div _s as bigint)")
    near = F.when((own > 0) & (F.col("y") % F.col("_s") < F.col("_high")), F.array(own, own - 1)).otherwise(F.array(own))
    parts = rows.withColumn("blk", F.explode(near))

    def links_of(blk: int, s: int, w: int, h: int, high: int, y: np.ndarray, cost: np.ndarray, free: np.ndarray) -> dict[int, int | None]:
        base, end = int(y[0]), min((blk + 1) * s, h)
        table = _Rows(cost, free, base)
        low, ideal, _ = panel_window(w, **window)
        step = _size_link(table, h, low, ideal, high)
        seek, links = -(blk + 1), {}
        # what the block above may lead to: its uppermost rows, and the first free row below them
        near = table.y[(table.y >= blk * s) & (table.y < min(blk * s + high, end))].tolist()
        far = table.next_from(blk * s + high)
        if blk:
            links[seek] = far if far is not None else seek - 1 if end < h else None
        todo = [0] if not blk else near if far is None else [*near, far]
        for at in todo:
            while at is not None and at < end and at not in links:
                to = step(at)
                if to is None and h - at > high and min(at + high, h - low) > at + low and end < h:
                    to = seek - 1  # a free row may follow in the blocks below
                links[at] = to
                at = to if to is not None and to >= 0 else None
        return links

    def search(part: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        heads = part[["image_id", "blk", "_s", "w", "h", "_high"]].iloc[first]
        y, cost, free = part["y"].to_numpy(), part["cost"].to_numpy(), part["free"].to_numpy(bool)
        found, size = [], []
        for at, end, (blk, s, w, h, high) in zip(first, np.append(first[1:], len(part)), heads.drop(columns="image_id").itertuples(index=False)):
            links = links_of(int(blk), int(s), int(w), int(h), int(high), y[at:end], cost[at:end], free[at:end])
            mine = [(a, t, t // s if t >= 0 else -t - 1) for a, t in links.items() if t is not None]
            found += mine
            size.append(len(mine))
        table = np.array(found, np.int64).reshape(-1, 3)
        return pd.DataFrame({"image_id": np.repeat(heads["image_id"].to_numpy(), size), "blk": np.repeat(heads["blk"].to_numpy(), size),
                             "at": table[:, 0], "to": table[:, 1], "to_blk": table[:, 2]})

    parts = parts.select("image_id", "blk", "_s", "w", "h", "_high", "y", "cost", "free")
    links = durable(in_groups(parts, ["image_id", "blk"], ["y"], search, f"image_id {kind}, blk bigint, at bigint, to bigint, to_blk bigint"))
    zero = F.lit(0).cast("bigint")
    held = rows.select("image_id").distinct()
    starts = held.select("image_id", zero.alias("at"), zero.alias("blk"))
    walk, _ = path(links, starts, "image_id")
    bounds = walk.where("at > 0").join(images.select("image_id", "h"), "image_id").where("at < h").select("image_id", "at", "h")
    bounds = bounds.unionByName(held.join(images, "image_id").select("image_id", zero.alias("at"), "h"))
    # a row for each slice of an image, not for each of its rows
    order = Window.partitionBy("image_id").orderBy("at")
    slices = bounds.select(
        "image_id", (F.row_number().over(order) - 1).alias("k"), F.col("at").cast("int").alias("y0"),
        F.coalesce(F.lead("at").over(order), "h").cast("int").alias("y1"),
    )
    if merge:
        slices = _merged(slices, rows.select(*table.columns), images, kind, window)
    missing = images.join(held, "image_id", "left_anti").select("image_id", F.lit(0).alias("k"), F.lit(0).alias("y0"), F.col("h").cast("int").alias("y1"), F.lit(False).alias("searched"))
    return slices.withColumn("searched", F.lit(True)).unionByName(missing)


def _merged(slices: DataFrame, table: DataFrame, images: DataFrame, kind: str, window: dict) -> DataFrame:
    """Slices after merging: their sums are collected by rows, then one narrow row per slice meets in its image."""
    slices = durable(slices)
    free = lambda c, where=None: F.when(F.col("free") if where is None else F.col("free") & where, F.col(c)).otherwise(F.lit(0)).cast("bigint")
    first, last = F.col("y") == F.col("y0"), F.col("y") == F.col("y1") - 1
    listed = _listed(slices, "y0", "y1", "image_id", "k", "y0", "y1")
    sums = listed.join(table, ["image_id", "y"]).groupBy("image_id", "k", "y0", "y1").agg(
        F.sum(free("mid")).alias("inner"), F.count_if("free").alias("clear"), F.sum(free("mid", first)).alias("mid0"),
        F.sum(free("mid", last)).alias("mid1"), F.sum(free("top", first)).alias("top0"), F.sum(free("bot", last)).alias("bot1"),
    )

    def merge(part: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        out = []
        for at, end in zip(first, np.append(first[1:], len(part))):
            width = int(part["w"].iat[at])
            out.append(absorbed(part.iloc[at:end], width, panel_window(width, **window)[0]))
        size = [len(b) - 1 for b in out]
        return pd.DataFrame({
            "image_id": np.repeat(part["image_id"].to_numpy()[first], size), "k": np.concatenate([np.arange(n) for n in size]),
            "y0": np.concatenate([b[:-1] for b in out]), "y1": np.concatenate([b[1:] for b in out]),
        })

    told = sums.join(images.select("image_id", "w"), "image_id")
    return in_groups(told, ["image_id"], ["k"], merge, f"image_id {kind}, k int, y0 int, y1 int")


def number_panels(panels: DataFrame, images: DataFrame, key: str = "chapter", seq: str = "seq") -> DataFrame:
    """Add ``n`` and ``name``: one continuous number per chapter over all its images' panels."""
    per_image = panels.groupBy("image_id").agg(F.count("*").alias("_c"))
    placed = images.select(key, seq, "image_id").join(per_image, "image_id")
    offsets = running(placed, [key], seq, {"_off": F.col("_c")}).select(key, seq, "image_id", "_off")
    return (
        panels.join(offsets, "image_id")
        .withColumn("n", F.col("_off") + F.col("k") + 1)
        .withColumn("name", F.format_string("panel_%04d.jpg", F.col("n")))
        .drop("_off")
    )


# -- story cuts -----------------------------------------------------------------


def group_cuts(boxes: DataFrame, ends: DataFrame) -> DataFrame:
    """Targets (image_id, t) after boxes that end a post: halfway to the next box.

    ``ends`` holds (image_id, n).
    """
    marked = gaps(boxes).where("next_y is not null").join(ends.select("image_id", "n").distinct(), ["image_id", "n"], "left_semi")
    return marked.select("image_id", F.col("mid").alias("t"), "page_h").where("t > 8 and t < page_h - 8").drop("page_h")


def _rule(last: Column, bottom: Column, gap: Column, w: Column, ends: Column) -> Column:
    grown_by = bottom - last
    return ((grown_by >= w * IDEAL_RATIO) & (ends | (gap > w * 0.5))) | (grown_by >= w * MAX_RATIO)


def story_cuts(boxes: DataFrame, page: str = "image_id", pos: str = "box_id", limit: int = 2000) -> DataFrame:
    """Targets (image_id, t) by reading rhythm.

    Walking the boxes by top edge, a cut falls halfway to the next box when the stretch
    since the last cut is long enough and a sentence ends or a wide gap follows, or when
    it grows too long. Input: (image_id, box_id, y, h, text, page_w, page_h).

    Images of up to ``limit`` boxes fold as one array, with one shuffle. On larger ones every box links to the next
    cut, and links are composed in rounds whose number grows with the logarithm of the image's blocks.
    """
    slim = boxes.select(
        page, F.col("y").cast("double").alias("y"), F.col(pos).alias("pos"), F.col("h").cast("double").alias("h"),
        ends_sentence(F.col("text")).alias("ends"), F.col("page_w").cast("double").alias("w"), "page_h",
    )
    small, hot = split_hot(slim, [page], limit)
    lists = small.groupBy(page).agg(
        F.array_sort(F.collect_list(F.struct("y", "pos", "h", "ends"))).alias("_b"),
        F.first("w").alias("w"), F.first("page_h").alias("page_h"),
    )
    zero = F.struct(F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("cuts"))
    # every box together with the top of the next one
    paired = F.zip_with(
        F.slice("_b", F.lit(1), F.greatest(F.size("_b") - 1, F.lit(0))), F.slice("_b", F.lit(2), F.size("_b")),
        lambda a, b: F.struct((a.y + a.h).alias("bottom"), b.y.alias("next_y"), a.ends.alias("ends")),
    )

    def step(acc: Column, box: Column) -> Column:
        mid = (box["bottom"] + box["next_y"]) / 2
        return F.when(
            _rule(acc["last"], box["bottom"], box["next_y"] - box["bottom"], F.col("w"), box["ends"]),
            F.struct(mid.alias("last"), F.concat(acc["cuts"], F.array(mid)).alias("cuts")),
        ).otherwise(acc)

    found = lists.select(page, "page_h", F.explode_outer(F.aggregate(paired, zero, step)["cuts"]).alias("t"))
    if hot is not None:
        found = found.unionByName(_hot_story(hot, page))
    return found.where("t > 8 and t < page_h - 8").select(page, "t").distinct()


def _hot_story(boxes: DataFrame, page: str) -> DataFrame:
    """Cuts of images with any number of boxes: from one walk where they fit a block, else from links to the next cut."""
    few, many = split_hot(boxes, [page], STEP - 1)
    found = cuts_within(few, page, IDEAL_RATIO, MAX_RATIO)
    return found if many is None else found.unionByName(_linked_story(many, page))


def _linked_story(boxes: DataFrame, page: str) -> DataFrame:
    ready = gaps(boxes, page, "pos").where("next_y is not null").select(
        page, "y", "pos", (F.col("y") + F.col("h")).alias("bottom"), "mid", "w", (F.col("ends") | (F.col("gap") > F.col("w") * 0.5)).alias("free"), "page_h"
    )
    found, _ = cuts_along(ready, page, IDEAL_RATIO, MAX_RATIO)
    return found.select(page, "page_h", F.col("mid").alias("t"))
