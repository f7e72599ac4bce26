"""Connected components and walks along links, in a number of rounds that grows with the logarithm of their length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .ordering import in_groups, split_hot

# Rounds after which a graph of any size that fits a cluster has settled; more mean a fault.
MOST_ROUNDS = 60


def _downward(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Each edge once, from its larger to its smaller end."""
    return edges.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _joined(keys: list[str]):
    """Labels of the nodes of many groups of edges at once, each group's smallest reached node."""

    def work(edges: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(edges))))
        ids, owner = np.concatenate([edges["a"], edges["b"]]), np.concatenate([group, group])
        order = np.lexsort((ids, owner))
        ids, owner = ids[order], owner[order]
        new = np.append(True, (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1]))
        node = np.empty(len(order), np.int64)
        node[order] = np.cumsum(new) - 1
        a, b = node[: len(edges)], node[len(edges) :]
        label = np.arange(int(new.sum()))
        while True:
            low = np.minimum(label[a], label[b])
            # the labels of two ends hang under the lesser one, then every node under its label's label
            nxt = label.copy()
            for end in (a, b):
                np.minimum.at(nxt, label[end], low)
                np.minimum.at(nxt, end, low)
            nxt = nxt[nxt]
            if np.array_equal(nxt, label):
                break
            label = nxt
        ids, at = ids[new], first[owner[new]]
        return pd.DataFrame({k: edges[k].to_numpy()[at] for k in keys} | {"id": ids, "label": ids[label]})

    return work


def components(edges: DataFrame, keys: list[str], most: int = MOST_ROUNDS, local: int = 0) -> tuple[DataFrame, int]:
    """Label the nodes of ``edges`` (keys, a, b) with the smallest node they reach under the same keys: (keys, id, label), and the rounds taken.

    With ``local``, keys of up to that many edges are settled where their edges meet; only the others take rounds.
    """
    if not local:
        return _contracted(edges, keys, most)
    few, many = split_hot(durable(edges.select(*keys, "a", "b")), keys, local)
    kind = ", ".join(f"{k} {edges.schema[k].dataType.simpleString()}" for k in keys)
    ids = edges.schema["a"].dataType.simpleString()
    labels = in_groups(few, keys, [], _joined(keys), f"{kind}, id {ids}, label {ids}")
    if many is None:
        return labels, 0
    more, rounds = _contracted(many, keys, most)
    return labels.unionByName(more), rounds


def _contracted(edges: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, int]:
    """The components by rounds over all edges.

    Star contraction: a round hangs the larger neighbours of every node under its smallest neighbour, then the smaller ones; the
    set of edges never grows, and a round is two aggregates with a join each, combined per task, so a hub is no one task's
    work. Chains shorten by a factor in each round. A round is written down; its size and a checksum tell whether it moved.
    """
    now, before = durable(_downward(edges, keys)), None
    for rounds in range(1, most + 1):
        both = now.unionByName(now.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*keys, "a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = _downward(both.join(low, [*keys, "a"]).where("b > a").select(*keys, F.col("b").alias("a"), F.col("m").alias("b")), keys)
        under = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        small = large.join(under, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        now = durable(_downward(small.unionByName(under.select(*keys, "a", F.col("m").alias("b"))), keys))
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64(*keys, "a", "b"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"the components did not settle in {most} rounds")
    labels = now.groupBy(*keys, F.col("a").alias("id")).agg(F.min("b").alias("label"))
    return labels.unionByName(labels.select(*keys, F.col("label").alias("id"), "label").distinct()), rounds


def walked(links: DataFrame, starts: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Places (keys, at) that walks from ``starts`` (keys, at) visit along ``links`` (keys, at, to; one row per place), and the rounds taken.

    Each round doubles the links' reach and adds what the visited places reach by them, so a walk of n steps takes about log2(n)
    rounds. Links lead to greater places, so no walk returns.
    """
    seen, rounds = durable(starts.select(*keys, "at").distinct()), 0
    links = durable(links.select(*keys, "at", "to"))
    while not links.isEmpty():
        rounds += 1
        more = seen.join(links, [*keys, "at"]).select(*keys, F.col("to").alias("at"))
        seen = durable(seen.unionByName(more).distinct())
        onward = links.select(*keys, F.col("at").alias("to"), F.col("to").alias("_far"))
        links = durable(links.join(onward, [*keys, "to"]).select(*keys, "at", F.col("_far").alias("to")))
    return seen, rounds


def path(links: DataFrame, starts: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Places (key, at) on the walks from ``starts`` (key, at, blk) along ``links`` (key, blk, at, to, to_blk), and the rounds taken.

    Every place lies in a block. Links are cut short to those that leave a block; the walk over these takes about log2(blocks)
    rounds, and each block then follows its own links from where the walk enters it. Links never lead back.
    """
    kind = links.schema[key].dataType.simpleString()
    inner = links.select(key, "blk", "at", "to")

    ends = lambda rows, first: zip(first, np.append(first[1:], len(rows)))

    def leaving(rows: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        far = rows["to"].to_numpy().copy()
        for lo, hi in ends(rows, first):
            at, to = rows["at"].to_numpy()[lo:hi], far[lo:hi]
            while True:
                row = np.minimum(np.searchsorted(at, to), len(at) - 1)
                stays = at[row] == to
                if not stays.any():
                    break
                to = np.where(stays, to[row], to)
            far[lo:hi] = to
        return pd.DataFrame({key: rows[key], "at": rows["at"], "to": far})

    doors = links.where("to_blk <> blk").select(key, F.col("to").alias("at"), F.col("to_blk").alias("blk"))
    doors = durable(doors.unionByName(starts.select(key, "at", "blk")).distinct())
    hops = in_groups(inner, [key, "blk"], ["at"], leaving, f"{key} {kind}, at bigint, to bigint")
    seen, rounds = walked(hops.join(doors.select(key, "at"), [key, "at"], "left_semi"), starts, [key])
    entered = seen.join(doors, [key, "at"])
    entered = entered.toDF(*entered.columns)  # fresh columns: both sides stem from the same links

    def follow(rows: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        at, to, enters = rows["at"].to_numpy(), rows["to"].to_numpy(), rows["_enters"].to_numpy(bool)
        found, size = [], []
        for lo, hi in ends(rows, first):
            own = ~enters[lo:hi]
            link, seen = dict(zip(at[lo:hi][own].tolist(), to[lo:hi][own].tolist())), {}
            for place in at[lo:hi][enters[lo:hi]].tolist():
                while place is not None and place not in seen:
                    seen[place] = True
                    place = link.get(place)
            # the last place may lie in a later block, which then reports it again
            found += seen
            size.append(len(seen))
        return pd.DataFrame({key: np.repeat(rows[key].to_numpy()[first], size), "at": np.array(found, np.int64)})

    both = inner.withColumn("_enters", F.lit(False)).unionByName(
        entered.select(key, "blk", "at", F.col("at").alias("to"), F.lit(True).alias("_enters"))
    )
    found = in_groups(both, [key, "blk"], ["at"], follow, f"{key} {kind}, at bigint")
    return found.distinct(), rounds
