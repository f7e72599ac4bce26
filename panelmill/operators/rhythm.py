"""Reading-rhythm cuts on images with any number of boxes: links from each box to the next cut, and a walk along them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .graphs import path
from .ordering import in_groups, look_up, ordinal

# A block holds STEP boxes, or more on images that would have over BLOCKS of them.
STEP = 4096
BLOCKS = 2048
NONE = -1


def reach(last: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The smallest number whose distance from ``last`` is ``least`` or more, as floating point subtracts."""
    t = last + least
    while (short := t - last < least).any():
        t = np.where(short, np.nextafter(t, np.inf), t)
    while (wide := (lower := np.nextafter(t, -np.inf)) - last >= least).any():
        t = np.where(wide, lower, t)
    return t


def maxima(values: np.ndarray, span: int) -> list[np.ndarray]:
    """The largest of each 1, 2, 4 … successive values, up to ``span`` of them."""
    table = [values]
    while 2 ** len(table) <= min(span, len(values)):
        x, s = table[-1], 1 << (len(table) - 1)
        table.append(np.maximum(x[:-s], x[s:]))
    return table


def first_at_least(table: list[np.ndarray], start: np.ndarray, t: np.ndarray) -> np.ndarray:
    """First place from ``start`` on with a value of ``t`` or more; a place beyond the table's span, or the number of values, if there is none."""
    at = start.astype(np.int64)
    for k in range(len(table) - 1, -1, -1):
        x = table[k]
        fits = at < len(x)
        at = np.where(fits & (x[np.minimum(at, len(x) - 1)] < t), at + (1 << k), at)
    return np.minimum(at, len(table[0]))


def next_at_least(values: np.ndarray, start: np.ndarray, t: np.ndarray) -> np.ndarray:
    """First place from ``start`` on with a value of ``t`` or more, len(values) if there is none."""
    return first_at_least(maxima(values, len(values)), start, t)


def cuts_within(boxes: DataFrame, page: str, ideal: float, most: float) -> DataFrame:
    """Cuts (page, t, page_h) of images whose boxes (page, y, pos, h, ends, w, page_h) fit a block: the walks of many images go on side by side."""
    kind = {c: boxes.schema[c].dataType.simpleString() for c in (page, "page_h")}

    def walk(rows: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        y, w = rows["y"].to_numpy(float), rows["w"].to_numpy(float)
        stop = np.append(first[1:], len(y))
        bottom, below = y + rows["h"].to_numpy(float), np.append(y[1:], np.nan)
        below[stop - 1] = np.nan
        mid, gap = (bottom + below) / 2, below - bottom
        # an image's last box has no cut after it
        tight = np.where(np.isnan(below), -np.inf, bottom)
        loose = np.where(rows["ends"].to_numpy(bool) | (gap > w * 0.5), tight, -np.inf)
        any_, free = (maxima(x, int((stop - first).max())) for x in (tight, loose))
        begin, last, width, found = first, np.zeros(len(first)), w[first], []
        while begin.size:
            at = np.minimum(first_at_least(any_, begin, reach(last, width * most)), first_at_least(free, begin, reach(last, width * ideal)))
            on = at < stop
            at, stop = at[on], stop[on]
            found.append(at)
            begin, last, width = at + 1, mid[at], w[at]
        cut = np.concatenate(found)
        return pd.DataFrame({page: rows[page].to_numpy()[cut], "page_h": rows["page_h"].to_numpy()[cut], "t": mid[cut]})

    slim = boxes.where("y is not null").select(page, "y", "pos", "h", "ends", "w", "page_h")
    return in_groups(slim, [page], ["y", "pos"], walk, f"{page} {kind[page]}, page_h {kind['page_h']}, t double")


def cut_links(boxes: DataFrame, page: str, ideal: float, most: float, step: int = STEP, blocks: int = BLOCKS) -> tuple[DataFrame, DataFrame]:
    """Where the next cut falls if the last one fell after a given box.

    ``boxes`` holds (page, y, pos, bottom, mid, w, free); a cut falls after the first later box that ends ``most`` widths below the
    last cut, or ``ideal`` widths where it is ``free``. Returns the numbered boxes (page, n from 1, blk, mid …) and links (page, blk, at,
    to); the walk starts at 0, with the last cut at 0.

    A block answers for its own boxes. Where the answer lies in a later block, the largest bottoms of the blocks name the first one that holds
    it, and that block is asked. An image has a bounded number of blocks, so this list is short.
    """
    kind = boxes.schema[page].dataType.simpleString()
    numbered = ordinal(boxes, [page], ["y", "pos"], "n")
    size = numbered.groupBy(page).agg(F.count("*").alias("_all"))
    size = size.select(page, F.greatest(F.lit(step), F.ceil(F.col("_all") / blocks)).cast("bigint").alias("_step"))
    numbered = look_up(numbered, size, [page], F.shiftright("n", 16))
    numbered = durable(numbered.withColumn("blk", F.expr("n div _step")).drop("_step"))
    tops = numbered.groupBy(page, "blk").agg(F.max("bottom").alias("any"), F.max(F.when(F.col("free"), F.col("bottom"))).alias("free"))
    lists = tops.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("blk", "any", "free"))).alias("tops"))
    told = tops.select(page, "blk").join(lists, page)
    told = told.toDF(*told.columns)  # fresh columns: both sides stem from the same boxes
    work = numbered.select(page, "blk", "n", "bottom", "mid", "w", "free")

    def inside(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        blk, tops = int(told["blk"].iloc[0]), told["tops"].iloc[0]
        n, last, w = rows["n"].to_numpy(), rows["mid"].to_numpy(), rows["w"].to_numpy()
        bottom = rows["bottom"].to_numpy()
        loose = np.where(rows["free"].to_numpy(bool), bottom, -np.inf)
        begin = np.arange(1, len(n) + 1)
        if n[0] == 1:  # the walk's start, before the first box
            n, last, w, begin = np.append(0, n), np.append(0.0, last), np.append(w[0], w), np.append(0, begin)
        far, near = reach(last, w * most), reach(last, w * ideal)
        j = np.minimum(next_at_least(bottom, begin, far), next_at_least(loose, begin, near))
        here = j < len(bottom)
        to = np.where(here, rows["n"].to_numpy()[np.minimum(j, len(bottom) - 1)], NONE)
        later = [t for t in tops if t["blk"] > blk]
        ask = np.full(len(n), NONE)
        if later:
            b = np.array([t["blk"] for t in later])
            low = lambda name: np.array([-np.inf if t[name] is None else t[name] for t in later])
            zero = np.zeros(len(n), np.int64)
            first = np.minimum(next_at_least(low("any"), zero, far), next_at_least(low("free"), zero, near))
            ask = np.where(~here & (first < len(b)), b[np.minimum(first, len(b) - 1)], NONE)
        return pd.DataFrame({page: rows[page].iloc[0], "blk": blk, "at": n, "to": to, "ask": ask, "far": far, "near": near})

    schema = f"{page} {kind}, blk bigint, at bigint, to bigint, ask bigint, far double, near double"
    found = durable(work.groupBy(page, "blk").cogroup(told.groupBy(page, "blk")).applyInPandas(inside, schema))

    def asked(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        if asks.empty:
            return pd.DataFrame({page: rows[page].iloc[:0], "blk": [], "at": [], "to": []})
        bottom = rows["bottom"].to_numpy()
        loose = np.where(rows["free"].to_numpy(bool), bottom, -np.inf)
        place = [np.searchsorted(np.maximum.accumulate(x), asks[t].to_numpy(), "left") for x, t in ((bottom, "far"), (loose, "near"))]
        return pd.DataFrame({page: asks[page], "blk": asks["blk"], "at": asks["at"], "to": rows["n"].to_numpy()[np.minimum(*place)]})

    late = work.groupBy(page, "blk").cogroup(found.where(F.col("ask") != NONE).groupBy(page, "ask")).applyInPandas(asked, f"{page} {kind}, blk bigint, at bigint, to bigint")
    here = found.where(F.col("to") != NONE).select(page, "blk", "at", "to")
    return numbered, durable(here.unionByName(late))


def cuts_along(boxes: DataFrame, page: str, ideal: float, most: float, step: int = STEP, blocks: int = BLOCKS) -> tuple[DataFrame, int]:
    """The boxes after which a cut falls, and the rounds that the walk took."""
    numbered, links = cut_links(boxes, page, ideal, most, step, blocks)
    own = numbered.select(page, F.col("n").alias("to"), F.col("blk").alias("to_blk"))
    zero = F.lit(0).cast("bigint")
    starts = numbered.select(page).distinct().select(page, zero.alias("at"), zero.alias("blk"))
    cuts, rounds = path(links.join(own, [page, "to"]), starts, page)
    return numbered.join(cuts.withColumnRenamed("at", "n"), [page, "n"], "left_semi"), rounds
