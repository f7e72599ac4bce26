"""Exact top-k inner products by score bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024
EMPTY = -(1 << 62)


def scaled(vector: Column, factor: float = 256.0) -> Column:
    """Integer components floor(factor * x); null where the vector is null or holds a null or non-finite component."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(whole, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(factor))))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), -1)


def max_score(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of one shard for each query, by MaxScore over the components as terms.

    A component's contribution is shifted by its least value in a block of rows, so contributions are not negative and
    each term has a bound in the block. Terms are taken in order of their bounds: the large ones, whose bounds alone
    can reach the k-th score, are essential and summed for every row of the block; the rest are probed in groups, for those
    rows whose sum and remaining bounds still reach the threshold. A bound equal to the threshold stays, because of ties.
    """
    dim = rows.shape[1]
    top_score = np.full((len(queries), k), EMPTY)
    top_id = np.full((len(queries), k), np.iinfo(np.int64).max)
    # 53 bits of a double hold every partial sum, else whole numbers are used
    reach = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(1, dim) * 2
    if reach >= 1 << 62:
        raise OverflowError("a score does not fit 62 bits")
    kind = np.float64 if reach < 1 << 53 else np.int64
    q_all = queries.astype(kind)
    for lo in range(0, len(rows), BLOCK):
        x, ids = rows[lo : lo + BLOCK].astype(kind), row_ids[lo : lo + BLOCK]
        low, high = x.min(axis=0), x.max(axis=0)
        for i, q in enumerate(q_all):
            base = np.where(q >= 0, q * low, q * high)
            bound = np.abs(q) * (high - low)
            floor = top_score[i, -1]
            order = np.argsort(-bound, kind="stable")
            rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # bounds of the terms from a place on
            start = base.sum()
            if start + rest[0] < floor:
                continue
            essential = int(np.searchsorted(-(start + rest), -float(floor), "right")) if kind is np.float64 else int((start + rest >= floor).sum())
            essential = min(max(essential, 1), dim) if dim else 0
            cand = np.arange(len(x))
            part = start + (x[:, order[:essential]] @ q[order[:essential]] - base[order[:essential]].sum())
            at = essential
            while True:
                alive = part + rest[at] >= floor
                if not alive.all():
                    cand, part = cand[alive], part[alive]
                if at >= dim or not len(cand):
                    break
                group = order[at : at + 8]
                part = part + (x[np.ix_(cand, group)] @ q[group] - base[group].sum())
                at += len(group)
            own = ids[cand] == query_ids[i]
            if own.any():
                cand, part = cand[~own], part[~own]
            if not len(cand):
                continue
            score = np.concatenate([top_score[i], part.astype(np.int64)])
            who = np.concatenate([top_id[i], ids[cand]])
            best = np.lexsort((who, -score))[:k]
            top_score[i], top_id[i] = score[best], who[best]
    at, slot = np.nonzero(top_score != EMPTY)
    return query_ids[at], top_id[at, slot], top_score[at, slot]


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5, query_block: int = 2048, shard_rows: int = 16_384) -> DataFrame:
    """The k highest inner products of each query with the rows, ties to the smaller id: (query_id, rank, vec_id, score).

    Both inputs are (vec_id long, v array<long>). Every row but those with the query's own id is a candidate; rows of another
    length than the query take no part; rows without an id or vector are left out; a repeated row counts once for
    each time, a repeated query is answered once for each id and vector. Queries meet rows in blocks: each pair of a query
    block and a shard of rows is one bounded group, which returns k rows a query, and the shards are merged by an aggregate.
    """
    rows, queries = (d.where("vec_id is not null and v is not null").select("vec_id", "v", F.size("v").alias("dim")) for d in (rows, queries.distinct()))
    n, m = rows.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // query_block))
    # a few small shards would leave cores idle
    shards = max(shards, min(-(-n // 1024), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))) or 1)
    spread = lambda name, count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    home = lambda name, count: F.pmod(F.xxhash64("vec_id", "v"), F.lit(count)).cast("int").alias(name)
    left = queries.select("vec_id", "v", "dim", home("block", blocks), spread("shard", shards))
    right = rows.select("vec_id", "v", "dim", home("shard", shards), spread("block", blocks))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            q, x = matrix(a["v"]), matrix(b["v"])
            out = max_score(q, a["vec_id"].to_numpy(), x, b["vec_id"].to_numpy(), k)
        out = [pa.array(c, pa.int64()) for c in out] or [pa.array([], pa.int64())] * 3
        return pa.Table.from_arrays(out, ["query_id", "vec_id", "score"])

    keys = ["dim", "block", "shard"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
