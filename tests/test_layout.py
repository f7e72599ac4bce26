import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.operators import layout as L, ordering as O


def greedy(heights, cap):
    out, pack, cur, empty = [], 1, 0, True
    for h in heights:
        if not empty and cur + h > cap:
            pack, cur = pack + 1, 0
        out.append(pack)
        cur, empty = cur + h, False
    return out


def chapters(rng):
    yield "even", [100] * 30
    yield "random", [rng.randint(1, 400) for _ in range(400)]
    yield "tall", [rng.choice([10, 50, 2500, 9000, 90]) for _ in range(200)]
    yield "zeros", [rng.choice([0, 0, 500, 30, 1600]) for _ in range(300)]
    yield "one", [99999]
    yield "jump", [300, 20000, 0, 0, 10, 10, 50000, 1]


@pytest.mark.parametrize("limit,fan_in", [(10_000, 4), (0, 2), (0, 5), (100, 3)])
def test_packing(spark, limit, fan_in):
    rng, rows, want = random.Random(5), [], {}
    for name, heights in chapters(rng):
        seqs = sorted(rng.sample(range(10 * len(heights)), len(heights)))
        rows += [(name, s, h) for s, h in zip(seqs, heights)]
        want[name] = greedy(heights, 1000)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "chapter string, seq int, new_h bigint")
    got = L.pack(df, cap=1000, limit=limit, stretch=3000, fan_in=fan_in).collect()
    for name in want:
        mine = [r.pack for r in sorted((r for r in got if r.chapter == name), key=lambda r: r.seq)]
        assert mine == want[name], name


def test_packing_by_blocks_takes_no_call_each(spark):
    """Stretches across Arrow batches, page numbers far apart: packs as folded, and no Python call per stretch."""
    rng, rows, want = random.Random(6), [], set()
    for name, heights in chapters(rng):
        seqs = sorted(rng.randrange(-(2**62), 2**62) for _ in heights)
        rows += [(name, s, h) for s, h in zip(seqs, heights)]
        want |= {(name, s, p) for s, p in zip(seqs, greedy(heights, 1000))}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "chapter string, seq bigint, new_h bigint")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
    try:
        packed = L.pack(df, cap=1000, limit=0, stretch=3000, fan_in=4)
        got = packed.select("chapter", "seq", "pack").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows) and {tuple(r) for r in got} == want
    assert "FlatMap" not in packed._jdf.queryExecution().executedPlan().toString()


def test_packing_when_a_join_is_planned_anew(spark):
    """Walks that flow down the levels meet all entries of their group, also where few of them are broadcast while the plan runs."""
    rng, rows, want = random.Random(7), [], set()
    for name in map(str, range(20)):
        heights = [rng.choice([10, 500, 90]) for _ in range(200)]
        rows += [(name, s, h) for s, h in enumerate(heights)]
        want |= {(name, s, p) for s, p in enumerate(greedy(heights, 1000))}
    df = spark.createDataFrame(rows, "chapter string, seq bigint, new_h bigint")
    small = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")
    spark.conf.set(small, "1")
    try:
        got = {tuple(r) for r in L.pack(df, cap=1000, limit=0, stretch=3000, fan_in=4).select("chapter", "seq", "pack").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset(small)
    assert got == want


def test_running_and_ordinal_over_blocks(spark):
    rng = random.Random(1)
    rows = [(k, s, rng.randint(0, 9)) for k in "ab" for s in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k string, s int, v int")
    for bits in (11, 21, 32):
        got = {(r.k, r.s): r.t for r in O.running(df, ["k"], "s", {"t": F.col("v")}, bits).collect()}
        for k in "ab":
            total = 0
            for _, s, v in sorted(r for r in rows if r[0] == k):
                assert got[k, s] == total
                total += v
    got = {(r.k, r.s): r.n for r in O.ordinal(df.repartition(8), ["k"], ["v", "s"], "n").collect()}
    for k in "ab":
        for i, (_, s, v) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1]))):
            assert got[k, s] == i + 1


def test_sparse_order_fills_no_window(spark):
    """Sparse 64-bit places: the sums are right, and no block at any level holds the group."""
    rng = random.Random(2)
    rows = [("hot", rng.randrange(-(2**63), 2**63), rng.randint(0, 9)) for _ in range(3000)] + [("hot", 2**63 - 1, 4), ("hot", -(2**63), 5), ("one", 7, 1)]
    df = spark.createDataFrame(rows, "k string, s bigint, v int")
    got = {(r.k, r.s): r.t for r in O.running(df, ["k"], "s", {"t": F.col("v")}, bits=9).collect()}
    total = 0
    for _, s, v in sorted(r for r in rows if r[0] == "hot"):
        assert got["hot", s] == total
        total += v
    for bits in (9, O.BITS):
        places = {s for k, s, _ in rows if k == "hot"}
        while places:  # what each window of a level holds: the children of one block
            inside = {}
            for p in places:
                inside.setdefault(p >> bits, []).append(p)
            assert max(map(len, inside.values())) <= 2**bits
            places = set(inside) if len(inside) > 2 else set()


def test_hot_key_look_up_is_spread(spark):
    rows = spark.range(40_000).select(F.lit("hot").alias("k"), F.col("id").alias("s")).unionByName(spark.createDataFrame([("b", 1), ("c", 2)], "k string, s bigint"))
    known = spark.createDataFrame([("hot", 5), ("b", 6), ("d", 7)], "k string, w int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = O.look_up(rows, known, ["k"], O.block("s", 8))
        parts = [len(p) for p in out.select("s").rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(parts) == 40_001 and max(parts) < 20_000
    assert {(r.k, r.w) for r in out.select("k", "w").distinct().collect()} == {("hot", 5), ("b", 6)}


def test_groups_stay_whole_when_a_join_is_planned_anew(spark):
    """A join planned as an exchange of both sides becomes a broadcast while it runs, and reads the larger side's exchange in other pieces."""
    rows = spark.range(0, 400_000, 1, 8).selectExpr("id % 40 as k", "id as v")
    few = spark.range(0, 400_000, 1, 8).where("id < 40").selectExpr("id % 40 as k", "id as c")
    sizes = lambda part, first: part.iloc[first][["k"]].assign(n=[len(g) for g in np.split(part["v"].to_numpy(), first[1:])])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")
    try:
        got = sorted(map(tuple, O.in_groups(rows.join(few, "k"), ["k"], ["v"], sizes, "k bigint, n bigint").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [(k, 10_000) for k in range(40)]


def test_split_hot(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 2, "k string")
    small, hot = O.split_hot(df, ["k"], 3)
    assert small.count() == 2 and hot.count() == 5
    assert O.split_hot(df, ["k"], 5)[1] is None


def test_modal_width_prefers_first_seen(spark):
    df = spark.createDataFrame([("c", 1, 700), ("c", 2, 800), ("c", 3, 800), ("c", 4, 700), ("d", 9, 5)], "chapter string, seq int, w int")
    assert {tuple(r) for r in L.modal_width(df).collect()} == {("c", 700), ("d", 5)}


def test_stitch_keeps_every_row(spark):
    heights = [1300, 1500, 1100, 1700, 1400, 1200]  # 8200 rows, three images
    df = spark.createDataFrame([("c", i, 600, h) for i, h in enumerate(heights)], "chapter string, seq int, w int, h int")
    sized = L.rescale(df, L.modal_width(df))
    parts = L.segment_pages(L.page_offsets(sized), L.stitch_plan(sized, 3))
    cut = L.recut(parts).orderBy("segment").collect()
    assert [(r.y0, r.y1) for r in cut] == [(0, 2734), (2734, 5468), (5468, 8200)]
    assert [r.name for r in cut] == ["01.jpg", "02.jpg", "03.jpg"]
    assert parts.select(F.sum(F.col("src1") - F.col("src0"))).first()[0] == 8200


def test_stitch_stops_when_rows_run_out(spark):
    df = spark.createDataFrame([("c", 0, 10, 3)], "chapter string, seq int, w int, h int")
    sized = L.rescale(df, L.modal_width(df))
    cut = L.recut(L.segment_pages(L.page_offsets(sized), L.stitch_plan(sized, 5))).collect()
    assert sorted((r.y0, r.y1) for r in cut) == [(0, 1), (1, 2), (2, 3)]


def test_rescale_rounds_half_to_even(spark):
    df = spark.createDataFrame([("c", 1, 4, 9), ("c", 2, 4, 9), ("c", 3, 8, 5), ("c", 4, 1000, 1)], "chapter string, seq int, w int, h int")
    rows = {r.seq: r.new_h for r in L.rescale(df, L.modal_width(df)).collect()}
    assert rows == {1: 9, 2: 9, 3: 2, 4: 1}
    rows = {r.seq: r.new_h for r in L.rescale(df, L.modal_width(df), "canvas").collect()}
    assert rows[4] == 0


def test_repeated_cuts_keep_their_numbers(spark):
    img = spark.createDataFrame([(1, 100, "a.b.png")], "image_id int, h int, fname string")
    cuts = spark.createDataFrame([(1, 30), (1, 30), (1, 60)], "image_id int, y int")
    assert sorted(tuple(r) for r in L.cuts_to_slices(cuts, img).collect()) == [(1, 1, 0, 30), (1, 3, 30, 60), (1, 4, 60, 100)]
    one = L.manual_split(img, [50, 0, 100, 200])
    assert sorted((r.name, r.y0, r.y1) for r in one.collect()) == [("001.jpg", 0, 50), ("002.jpg", 50, 100)]
    two = L.manual_split(img.union(spark.createDataFrame([(2, 40, "c.png")], img.schema)), [50])
    assert sorted(r.name for r in two.collect()) == ["a.b_001.jpg", "a.b_002.jpg", "c_001.jpg"]
