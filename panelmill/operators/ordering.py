"""Ordered work that stays parallel inside one hot group.

A plain window over ``partitionBy(chapter)`` puts a whole chapter into one task. The helpers here cut a group into blocks of bounded
size and carry block totals across, so each window sees a bounded number of rows, whatever the skew and however sparse the order is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import durable

# a block spans 2 ** BITS values of the order column, and 2 ** BITS blocks make a larger one: three levels span 64 bits,
# and a window of so many narrow rows still sorts in one task
BITS = 22


def block(seq: str, bits: int = BITS) -> Column:
    """The block of a row: at most 2 ** bits rows of a group share one."""
    return F.shiftright(F.col(seq).cast("bigint"), bits)


def look_up(
    rows: DataFrame, known: DataFrame, keys: list[str], part: Column, how: str = "inner", source: DataFrame | None = None
) -> DataFrame:
    """Rows joined to ``known``, which has one row per key, without meeting on the bare key.

    ``part`` cuts a key's rows into parts of bounded size. The known row is copied to the parts that occur, and the join is on
    (keys, part), so a key with a third of all rows fills many tasks. ``source`` may name the parts where that is cheaper than ``rows``.
    """
    named = (rows if source is None else source).select(*keys, part.alias("_part"))
    copies = named.groupBy(*keys, "_part").agg(F.lit(1).alias("_one")).drop("_one").join(known, keys)
    return rows.withColumn("_part", part).join(copies, [*keys, "_part"], how).drop("_part")


def block_totals(
    df: DataFrame, keys: list[str], seq: str, sums: dict[str, Column], bits: int = BITS
) -> DataFrame:
    """(keys, _blk, _t_<name>…): sums per block of ``seq``, combined per task before the shuffle.

    Callers that need both totals and running sums build both on this, so that Spark
    shuffles and computes it once.
    """
    return df.groupBy(*keys, block(seq, bits).alias("_blk")).agg(*[F.sum(v).alias(f"_t_{o}") for o, v in sums.items()])


def running(
    df: DataFrame,
    keys: list[str],
    seq: str,
    sums: dict[str, Column],
    bits: int = BITS,
) -> DataFrame:
    """Add exclusive running sums along the 64-bit integer column ``seq`` inside each key group.

    ``sums`` maps new column names to the summed expressions. ``seq`` is unique per group; it may be negative and have
    gaps of any size.

    A scan over a tree: rows fall into blocks, blocks into larger blocks, until 64 bits are used up. Totals go up the
    tree, offsets come down, and no window at any level holds more than 2 ** bits rows of a group.
    """
    names = list(sums)
    levels = [block_totals(df, keys, seq, sums, bits)]
    while bits * (len(levels) + 1) < 64:
        up = levels[-1].groupBy(*keys, F.shiftright("_blk", bits).alias("_blk"))
        levels.append(up.agg(*[F.sum(f"_t_{o}").alias(f"_t_{o}") for o in names]))

    def before(w: Window, value: Column | str) -> Column:
        return F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    offsets = None
    for level in reversed(levels):
        level = level.withColumn("_up", F.shiftright("_blk", bits))
        inside = Window.partitionBy(*keys, *(["_up"] if offsets is not None else [])).orderBy("_blk")
        level = level.select(*keys, "_blk", "_up", *[before(inside, f"_t_{o}").alias(f"_o_{o}") for o in names])
        if offsets is not None:
            level = level.join(offsets.withColumnsRenamed({"_blk": "_up"} | {f"_o_{o}": f"_p_{o}" for o in names}), [*keys, "_up"])
            level = level.withColumns({f"_o_{o}": F.col(f"_o_{o}") + F.col(f"_p_{o}") for o in names})
        offsets = level.select(*keys, "_blk", *[f"_o_{o}" for o in names])
    local = Window.partitionBy(*keys, "_blk").orderBy(seq)
    out = df.withColumn("_blk", block(seq, bits)).join(offsets, [*keys, "_blk"])
    return out.withColumns({o: F.col(f"_o_{o}") + before(local, v) for o, v in sums.items()}).drop("_blk", *[f"_o_{o}" for o in names])


def ordinal(df: DataFrame, keys: list[str], order: list[Column | str], out: str = "n", start: int = 1) -> DataFrame:
    """Add a dense row number per key group along any order, without a per-group window.

    Rows are range-partitioned and sorted by (keys, order), so a hot group spreads over
    many partitions. Row positions inside a partition are free; only one offset per
    (group, partition) has to be summed up. ``order`` must be total inside a group.
    """
    by = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    laid = df.repartitionByRange(*by).sortWithinPartitions(*by)
    laid = durable(laid.withColumn("_at", F.monotonically_increasing_id()))
    laid = laid.withColumn("_part", F.shiftright("_at", 33)).withColumn(
        "_row", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    )
    spans = laid.groupBy(*keys, "_part").agg(F.min("_row").alias("_lo"), F.count("*").alias("_rows"))
    # at most one row per partition in this window
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    return laid.join(spans, [*keys, "_part"]).withColumn(
        out, F.col("_before") + F.col("_row") - F.col("_lo") + F.lit(start)
    ).drop("_at", "_part", "_row", "_lo", "_before")


def split_hot(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Split rows into groups of at most ``limit`` rows and the rest (None when no group is hot).

    Costs one narrow counting pass, or none where ``limit`` is 0 and all groups are hot. Callers use a per-group method
    on the first part and an exact distributed one on the second.
    """
    if limit < 1:
        known = F.lit(True)
        for k in keys:
            known &= F.col(k).isNotNull()
        return df.where(~known), df.where(known)
    hot = durable(df.groupBy(*keys).count().where(F.col("count") > limit).select(*keys))
    if hot.isEmpty():
        return df, None
    return df.join(hot, keys, "left_anti"), df.join(hot, keys, "left_semi")


def rank_rows(
    df: DataFrame, keys: list[str], order: list[Column | str], out: str = "n", start: int = 1, limit: int = 1 << 17
) -> DataFrame:
    """Add a dense row number per key group: a plain window for groups of up to ``limit`` rows,
    ``ordinal`` for larger ones. ``order`` must be total inside a group."""
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    small, hot = split_hot(df, keys, limit)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*by)).cast("bigint") + F.lit(start - 1)
    ranked = small.withColumn(out, place)
    return ranked if hot is None else ranked.unionByName(ordinal(hot, keys, order, out, start))


def in_groups(df: DataFrame, keys: list[str], order: list[str], work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """Whole groups go to ``work``, as many at once as an Arrow batch holds: rows sorted by (keys, order), and the first row of each group.

    Meant for many small groups, where a call per group would cost more than its rows. Keys are not null.

    Rows are dealt by a hash of the keys, not by the keys: rows that a join or union has dealt by them already would not be dealt
    again, and a plan that changes while it runs may then read their exchange in pieces that split groups.
    """
    laid = df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)

    def firsts(rows: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(rows), bool)
        new[0] = True
        for k in keys:
            v = rows[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        ready = lambda: pd.concat(held, ignore_index=True)
        for rows in parts:
            if rows.empty:
                continue
            last = int(firsts(rows)[-1])
            if not (held and last == 0 and all(held[-1][k].iloc[-1] == rows[k].iloc[0] for k in keys)):
                held += [rows.iloc[:last]] if last else []
                if held:
                    whole = ready()
                    yield work(whole, firsts(whole))
                held = []
            held.append(rows.iloc[last:])
        if held:
            whole = ready()
            yield work(whole, firsts(whole))

    return laid.mapInPandas(batches, schema)
