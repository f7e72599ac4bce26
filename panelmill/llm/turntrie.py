"""A trie of conversations by their first turns, grouped by blocks of turns before single turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.operators.ordering import rank_rows

from .common import looked_up, width, written

WORD = r"[^ \x09-\x0D]+"
#: Blocks of one conversation that a window holds.
STRETCH = 1024
NODE = ["depth", "k1", "k2"]


def ordered(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, pos, role, text), numbered from 1 in the order of ``turn`` (null first, ties by role and text); null roles and texts are empty.

    Rows without a conv_id belong to no conversation. A conversation may hold any share of all rows.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role"), text("text"))
    return rank_rows(rows, ["conv_id"], [F.asc_nulls_first("turn"), "role", "text"], "pos").drop("turn")


def with_openings(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Give each conversation c the first h turns of conversation c - c % group (all if fewer) before its own turns after its first h, with
    h = crc32(c) % most. A conversation left without turns is no row of the result."""
    base = F.col("conv_id") - F.col("conv_id") % group
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    ids = turns.select("conv_id").distinct().select("conv_id", base.alias("base"), h.alias("h"))
    heads = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
    opened = ids.join(heads, "base").where("pos <= h").select("conv_id", "pos", "role", "text")
    size = heads.groupBy("base").agg(F.max("pos").alias("size"))
    own = looked_up(turns.where(F.col("pos") > h).withColumn("base", base), size, ["base"], ["conv_id", "pos"])
    place = F.col("pos") - h + F.least(h, F.coalesce("size", F.lit(0)))
    return opened.unionByName(own.select("conv_id", place.alias("pos"), "role", "text"))


def scanned(df: DataFrame, what: dict[str, Column], fold, reverse: bool = False) -> DataFrame:
    """Add running folds of ``what`` over the blocks of each conversation, from its start without the block itself, or from its end with it.

    A window holds STRETCH blocks, and one row for each stretch before.
    """
    by = F.desc if reverse else F.asc
    first = Window.partitionBy("conv_id", "_s").orderBy(by("blk")).rowsBetween(Window.unboundedPreceding, 0 if reverse else -1)
    outer = Window.partitionBy("conv_id").orderBy(by("_s")).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_s", F.expr(f"blk div {STRETCH}"))
    total = df.groupBy("conv_id", "_s").agg(*[fold(c).alias(f"_{o}") for o, c in what.items()])
    before = total.select("conv_id", "_s", *[fold(f"_{o}").over(outer).alias(f"_{o}") for o in what])
    inside = df.withColumns({o: fold(c).over(first) for o, c in what.items()}).join(before, ["conv_id", "_s"])
    zero = F.lit(0).cast("long")
    join = (lambda a, b: a + b) if fold is F.sum else (lambda a, b: a.bitwiseXOR(b))
    return inside.withColumns({o: join(F.coalesce(o, zero), F.coalesce(f"_{o}", zero)) for o in what}).drop("_s", *[f"_{o}" for o in what])


def lanes(*parts: Column | str) -> list[Column]:
    """Two independent 64-bit codes."""
    return [F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)]


def digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids, joined by commas, of each node's (NODE, conv_id): (NODE, ends_sha256).

    Ids are sorted and joined over ranges, which a large node may fill many of; what streams through the digest is a few long strings.
    """
    schema = "depth long, k1 long, k2 long"
    names = [*NODE, "conv_id", "ids"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            out, last = [], None
            for *node, c in zip(*cols, strict=True):
                if node != last:
                    out.append((*node, c, []))
                    last = node
                out[-1][-1].append(str(c))
            rows = zip(*((*x[:-1], ",".join(x[-1])) for x in out), strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i == 4 else pa.int64()) for i, x in enumerate(rows)], names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for b in batches:
            out = []
            for *node, _, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if node != now:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = node, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pack(out)
        if now is not None:
            yield pack([(*now, sha.hexdigest())])

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i == 3 else pa.int64()) for i, x in enumerate(cols)], [*NODE, "ends_sha256"])

    order = [*NODE, "conv_id"]
    laid = ends.select(*order).repartitionByRange(width(ends), *order).sortWithinPartitions(*order)
    strings = laid.mapInArrow(joined, f"{schema}, conv_id long, ids string")
    return strings.repartition(width(ends), *NODE).sortWithinPartitions(*order).mapInArrow(hashed, f"{schema}, ends_sha256 string")


def prefix_trie(turns: DataFrame, ids: DataFrame, block: int = 4) -> DataFrame:
    """The trie of conversations: a node for each distinct sequence of first turns that some conversation starts with.

    ``turns`` holds (conv_id, pos, role, text), pos from 1 without gaps; ``ids`` all conv_ids, those without turns too. Returns (conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the node's and its parent's smallest member, members,
    children, childless nodes in the subtree (itself included), the words of last turns that members share in the subtree, and a digest of the
    members that end there.

    1. Turns become blocks of ``block`` turns with a digest; the chain of a conversation's block digests names where a block hangs.
    2. Equal blocks at one place are one row from then on. A block without siblings is a string of nodes with the same members. Only where siblings
    diverge are turn boundaries refined, by digests of the block's own prefixes. 3. Sums over subtrees run over the blocks first: each place's
    total is laid on one conversation that goes through it, summed from its end, and added up by place; inside a block a node adds to
    the few nodes above it.

    Conversations without turns are members of the root. No conversation at all gives no rows. Texts of any length count as their digest and
    number of words; repeated turns are turns of their own.
    """
    hexed = F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256), 1, 32)
    rows = turns.select(
        "conv_id", F.expr(f"cast((pos - 1) div {block} as long)").alias("blk"), F.struct(
            F.expr(f"cast((pos - 1) % {block} as int)").alias("j"), hexed.alias("code"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")
        ).alias("t"),
    )
    blocks = rows.groupBy("conv_id", "blk").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    digest = lambda codes: F.substring(F.sha2(F.array_join(codes, "").cast("binary"), 256), 1, 32)
    blocks = blocks.withColumn("whole", digest(F.col("turns.code")))
    l1, l2 = lanes("blk", "whole")
    chained = written(scanned(blocks, {"g1": l1, "g2": l2}, F.bit_xor))
    place = ["blk", "g1", "g2"]

    # equal blocks at one place are one row
    apart = chained.groupBy(*place, "whole").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"), F.first("turns").alias("turns"))
    apart = written(apart)
    siblings = apart.groupBy(*place).agg((F.count("*") == 1).alias("alone"))
    apart = looked_up(apart, siblings, place, ["whole"])
    size = F.size("turns")
    steps = F.sequence(F.lit(1), size)
    mark = F.when(
        F.col("alone"), F.transform(steps, lambda j: F.when(j == size, F.col("whole")).otherwise(F.concat("whole", F.lit(":"), j.cast("string"))))
    ).otherwise(F.transform(steps, lambda j: digest(F.slice(F.col("turns.code"), F.lit(1), j))))

    def node_key(j: Column, m: Column) -> list[Column]:
        """The key of a node inside a block; the last of a full block has the key of the place below it."""
        inner, full = lanes(*place, j, m), lanes("blk", m)
        return [F.when(j == block, F.col(g).bitwiseXOR(f)).otherwise(i) for g, f, i in zip(("g1", "g2"), full, inner, strict=True)]

    pair = lambda j, m: F.struct(*[c.alias(n) for c, n in zip(node_key(j, m), ("k1", "k2"), strict=True)])
    apart = apart.withColumn("_marks", mark).withColumn("keys", F.transform("_marks", lambda m, i: pair(i + 1, m))).drop("_marks")
    each = apart.select(*place, "alone", "n", "low", "keys", F.posexplode("turns").alias("i", "t"))
    own = F.get("keys", F.col("i"))
    above = F.when(F.col("i") == 0, F.struct(F.col("g1").alias("k1"), F.col("g2").alias("k2"))).otherwise(F.get("keys", F.col("i") - 1))
    each = each.select(
        (F.col("blk") * block + F.col("i") + 1).alias("depth"), own["k1"].alias("k1"), own["k2"].alias("k2"), above["k1"].alias("p1"), above["k2"].alias("p2"),
        *place, "alone", "n", "low", F.col("t.words").alias("words"), F.slice("keys", F.lit(1), F.col("i") + 1).alias("path"),
    )
    # refined: prefixes that diverging siblings share
    met = each.where("not alone").groupBy(*NODE).agg(
        *[F.first(c).alias(c) for c in ("p1", "p2", *place)], F.sum("n").alias("n"), F.min("low").alias("low"), F.first("words").alias("words"), F.first("path").alias("path")
    )
    whole = lambda v: F.lit(v).cast("long")
    root = ids.select("conv_id").distinct().agg(F.count("*").alias("n"), F.min("conv_id").alias("low")).where("n > 0").select(
        *[whole(0).alias(c) for c in NODE], *[whole(None).alias(c) for c in ("p1", "p2", *place)], "n", "low", whole(0).alias("words"), F.lit(None).cast(each.schema["path"].dataType).alias("path")
    )
    nodes = written(each.where("alone").drop("alone").unionByName(met).unionByName(root))
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumn("saved", (F.col("n") - 1) * F.col("words")).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    nodes = written(nodes)

    # what hangs below the full blocks
    both = ["saved", "leaf"]
    added = [F.sum(c).alias(c) for c in both]
    deep = chained.where("blk > 0").select("conv_id", *place)
    held = nodes.where("blk > 0").groupBy(*place).agg(*added).join(deep.groupBy(*place).agg(F.min("conv_id").alias("conv_id")), place)
    laid = deep.join(held.select("conv_id", "blk", *both), ["conv_id", "blk"], "left").fillna(0, both)
    laid = scanned(laid, {f"sub_{c}": F.col(c) for c in both}, F.sum, reverse=True)
    below = laid.groupBy(*place).agg(*[F.sum(f"sub_{c}").alias(f"sub_{c}") for c in both])
    below = below.select((F.col("blk") * block).alias("depth"), F.col("g1").alias("k1"), F.col("g2").alias("k2"), *[f"sub_{c}" for c in both])
    full = nodes.where("depth > 0").join(below, NODE, "left").fillna(0, [f"sub_{c}" for c in both])
    up = full.select("blk", *[(F.col(c) + F.col(f"sub_{c}")).alias(c) for c in both], F.posexplode("path").alias("i", "k"))
    sums = up.select((F.col("blk") * block + F.col("i") + 1).alias("depth"), "k.k1", "k.k2", *both).groupBy(*NODE).agg(*added)
    sums = sums.unionByName(nodes.agg(*added).select(*[whole(0).alias(c) for c in NODE], *both))

    # where conversations end
    last = chained.groupBy("conv_id").agg(F.max_by(F.struct(*place, "whole", F.size("turns").alias("m")), "blk").alias("e")).select("conv_id", "e.*")
    k1, k2 = node_key(F.col("m"), F.col("whole"))
    last = last.select("conv_id", (F.col("blk") * block + F.col("m")).cast("long").alias("depth"), k1.alias("k1"), k2.alias("k2"))
    bare = ids.select("conv_id").distinct().join(chained.select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", *[whole(0).alias(c) for c in NODE])
    ended = digests(last.unionByName(bare))

    out = nodes.select(*NODE, (F.col("depth") - 1).alias("pd"), "p1", "p2", "n", "low", "n_children")
    out = out.join(sums.withColumnsRenamed({"saved": "saved_tokens", "leaf": "n_leaves"}), NODE).join(ended, NODE, "left")
    parents = nodes.select(F.col("depth").alias("pd"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("low").alias("parent_conv_id"))
    out = looked_up(out, parents, ["pd", "p1", "p2"], NODE)
    return out.select(
        F.col("low").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
