"""Packing token sequences into as few fixed-size sequences as the method finds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import width, written


def pieces(docs: DataFrame, path: str, limit: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Cut documents (doc_id, text) into pieces of at most ``limit`` ids: (doc_id, piece, start, length, ids_crc32[, ids]).

    A document is the ids of its text and then ``end``; a null or empty text is ``end`` alone. Only a longer document is
    cut, so that all pieces but the first are full. ``ids`` holds little-endian unsigned 32-bit numbers.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, no, start, length, crc, held = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                raw = np.append(bpe.ids(path, text.as_py()), np.uint32(end)).astype("<u4")
                first = (len(raw) - 1) % limit + 1
                for k, hi in enumerate(range(first, len(raw) + 1, limit)):
                    lo = max(0, hi - limit)
                    data = raw[lo:hi].tobytes()
                    at.append(i), no.append(k), start.append(lo), length.append(hi - lo), crc.append(zlib.crc32(data))
                    if with_ids:
                        held.append(data)
            out = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(held, pa.binary())] if with_ids else []), ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def fullest(available: dict[int, int], gap: int) -> list[tuple[int, int]]:
    """The lengths, with copies, whose sum comes closest to ``gap`` from below; ``available`` says how many there are.

    Bitset dynamic programming: bit s of a mask says that sum s can be made. Copies of a length are added in powers of two.
    """
    masks, steps, full = [1], [], (1 << (gap + 1)) - 1
    for length in sorted((x for x in available if x <= gap), reverse=True):
        left, k = min(available[length], gap // length), 1
        while left > 0 and not masks[-1] >> gap & 1:
            k = min(k, left)
            steps.append((length, k))
            masks.append((masks[-1] | masks[-1] << length * k) & full)
            left, k = left - k, k * 2
        if masks[-1] >> gap & 1:
            break
    at, taken = masks[-1].bit_length() - 1, {}
    for i in range(len(steps) - 1, -1, -1):
        if not masks[i] >> at & 1:
            length, k = steps[i]
            taken[length] = taken.get(length, 0) + k
            at -= length * k
    return sorted(taken.items(), reverse=True)


def fill_plan(counts: dict[int, int], limit: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Minimum bin slack over a histogram of lengths: (lengths with copies in one sequence, number of such sequences).

    Each step starts a sequence with the largest length left, fills it with the fullest feasible combination and removes
    it as often as the counts allow. The work depends on the number of distinct lengths, not on the number of pieces.
    """
    left = {x: n for x, n in counts.items() if n > 0}
    plan = []
    while left:
        top = max(left)
        rest = left | {top: left[top] - 1}
        combo: dict[int, int] = {top: 1}
        for x, k in fullest({x: n for x, n in rest.items() if n > 0}, limit - top):
            combo[x] = combo.get(x, 0) + k
        times = min(left[x] // k for x, k in combo.items())
        plan.append((sorted(combo.items(), reverse=True), times))
        for x, k in combo.items():
            left[x] -= k * times
            if not left[x]:
                del left[x]
    return plan


def places(plan: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """The plan as intervals of ranks inside a length: where the pieces of an interval go."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for combo, times in plan:
        offset = 0
        for length, k in combo:
            rank = used.get(length, 0)
            rows.append((length, rank, sequence, k, offset))
            used[length] = rank + k * times
            offset += length * k
        sequence += times
    rows.sort()
    names = ("length", "rank", "sequence", "copies", "offset")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def pack(docs: DataFrame, path: str, limit: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Place every piece of every document: the columns of ``pieces`` with sequence_id and offset.

    The driver sees one count for each of at most ``limit`` lengths, and the plan it makes has some rows for each. Pieces are
    ranked inside (length, block), so a length that a third of all pieces share is spread over blocks of 100,000 pieces or so.
    Null texts are empty; equal rows are packed one by one; an empty table gives no rows; other columns are not read.
    """
    if limit < 1:
        raise ValueError("a sequence holds one id at least")
    cut = written(pieces(docs, path, limit, end, with_ids).withColumn("lot", F.xxhash64("doc_id", "piece", "ids_crc32")))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    blocks = max(width(docs), sum(counts.values()) // 100_000)
    cut = cut.withColumn("lot", F.pmod("lot", F.lit(blocks)))
    before = Window.partitionBy("length").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("length", "lot").count().select("length", "lot", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "lot").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.join(totals, ["length", "lot"]).withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
    table = places(fill_plan(counts, limit))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, at = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        first = np.searchsorted(table["length"], size)
        span = np.searchsorted(table["length"], size, "right")
        row = np.empty(len(size), np.int64)
        for x in np.unique(size):
            mine = size == x
            lo, hi = first[mine][0], span[mine][0]
            row[mine] = lo + np.searchsorted(table["rank"][lo:hi], at[mine], "right") - 1
        step = at - table["rank"][row]
        return pd.DataFrame({"sequence_id": table["sequence"][row] + step // table["copies"][row], "offset": table["offset"][row] + step % table["copies"][row] * size})

    out = ranked.withColumn("place", placed("length", "rank"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "place.sequence_id", "place.offset")
