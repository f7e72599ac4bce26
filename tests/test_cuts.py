import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.operators import cuts as C, pixels as P, rhythm
from panelmill.plans.panels import story_targets


# -- detail of pixels -----------------------------------------------------------


def sobel(region):
    p = np.pad(region.astype(int), 1, mode="reflect")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    return np.abs(gx) + np.abs(gy) > 30


def art(g, a, b, barred):
    keep = ~barred[a:b]
    if b - a < 2 or not keep.any():
        return 0.0
    return float(sobel(g[a:b])[keep].mean())


def strip(seed, height=200, width=40):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 256, (height, width)).astype(np.uint8)
    g[60:65] = 255
    g[130:135] = 0
    if seed % 3 == 0:
        g[90:150] = 200  # a flat stretch: too little drawing to stand alone
    if seed % 4 == 1:
        g[:] = (g // 32) * 3  # faint drawing
    return g


CASES = {
    0: ([], None), 1: ([(30, 110)], None), 2: ([(10, 20), (50, 75), (128, 140)], None), 3: ([(0, 200)], None), 4: ([], [65, 70, 132, 5, 195]),
    5: ([(55, 70)], [66.7, 120]), 6: ([(40, 190)], None), 7: ([(100, 110)], [100]), 8: ([], [3]), 9: ([(20, 30)], None),
}


@pytest.fixture(scope="module")
def tables(spark):
    grey = {i: strip(i) for i in CASES}
    grey[10] = strip(10, height=50)  # short enough to stay whole
    images = [(i, g.shape[0], g.shape[1], bytearray(np.repeat(g[..., None], 3, axis=2).tobytes())) for i, g in grey.items()]
    df = spark.createDataFrame(images, "image_id int, height int, width int, data binary")
    return grey, df, P.row_table(df).cache()


def free_of(i, height):
    out = np.ones(height, bool)
    for a, b in CASES.get(i, ([], None))[0]:
        out[max(0, a - 4) : b + 4] = False
    return out


@pytest.mark.parametrize("merge", [False, True])
def test_panels_cover_images_and_cut_no_text(spark, tables, merge):
    grey, df, table = tables
    sizes = df.select("image_id", F.col("height").alias("h"), F.col("width").alias("w"))
    sizes = sizes.unionByName(spark.createDataFrame([(77, 500, 40)], "image_id int, h int, w int"))  # no rows in the table
    protect = spark.createDataFrame([(i, a, b) for i, (p, _) in CASES.items() for a, b in p], "image_id int, y0 int, y1 int")
    targets = spark.createDataFrame([(i, float(t)) for i, (_, ts) in CASES.items() for t in ts or []], "image_id int, t double")
    smooth = C.smooth(table.select("image_id", "y", "cost"))
    cost = {(r.image_id, r.y): r.cost for r in smooth.collect()}
    got = C.split_panels(smooth, table.drop("cost"), sizes, C.forbidden(protect, sizes), targets, merge).orderBy("image_id", "k").collect()
    assert [(r.k, r.y0, r.y1, r.searched) for r in got if r.image_id == 77] == [(0, 0, 500, False)]
    for i, g in grey.items():
        spans, free = [(r.y0, r.y1) for r in got if r.image_id == i], free_of(i, len(g))
        assert spans[0][0] == 0 and spans[-1][1] == len(g) and all(a[1] == b[0] for a, b in zip(spans, spans[1:])), i
        cuts = [a for a, _ in spans[1:]]
        assert all(free[y] for y in cuts), i
        told = CASES.get(i, ([], None))[1]
        if merge:
            assert len(spans) == 1 or all(b - a >= 14 and art(g, a, b, ~free) >= 0.012 for a, b in spans), i
        elif not told:
            assert all(b - a >= 14 for a, b in spans[:-1]), i
            for a, b in spans[:-1]:
                # no free row in the window is both cheaper and nearer to the ideal height
                window = [y for y in range(a + 14, min(a + 50, len(g) - 14)) if free[y]]
                assert b not in window or all(cost[i, b] <= cost[i, y] or abs(b - a - 32) < abs(y - a - 32) for y in window), i
        else:
            assert len(cuts) <= len(told) and all(min(abs(y - t) for t in told) <= 60 for y in cuts), i
    if not merge:
        assert {r.image_id for r in got if r.image_id in grey and r.k > 0} >= {0, 1, 2, 4}
        assert len([r for r in got if r.image_id == 3]) == 1 and len([r for r in got if r.image_id == 10]) == 1 and len([r for r in got if r.image_id == 8]) == 1


def test_small_cut_cases():
    flat = np.zeros(100)
    rows = C._Rows(flat, np.ones(100, bool))
    assert rows.cheapest(10, 20, 14, 0.25) == 14 and rows.cheapest(20, 20, 20, 1) is None
    low = flat.copy()
    low[17] = -5
    assert C._Rows(low, np.ones(100, bool)).cheapest(10, 20, 14, 0.25) == 17
    assert C._Rows(flat, np.arange(100) >= 30).next_from(10) == 30 and C._Rows(flat, np.zeros(100, bool)).next_from(0) is None
    table = {"cost": flat, "free": np.ones(100, bool), "mid": np.full(100, 9), "top": np.full(100, 9), "bot": np.full(100, 9)}
    assert C.panel_bounds(10, 100, table, None, max_h=40, ideal_h=30, min_h=10) == [0, 30, 60, 100]
    assert C.panel_bounds(10, 100, table, [50.9, 3, 97], max_h=40, min_h=10) == [0, 50, 100]
    assert C.panel_bounds(10, 100, table, [12, 14, 60], merge=False) == [0, 12, 60, 100]


def test_row_table_matches_array_form(spark, tables):
    grey, df, table = tables
    rows = spark.createDataFrame([(i, y, [int(v) for v in r]) for i, g in grey.items() for y, r in enumerate(g)], "image_id int, y int, px array<bigint>")
    a = {(r.image_id, r.y): r for r in table.collect()}
    for r in C.row_profile(rows).collect():
        assert abs(a[r.image_id, r.y].cost - r.cost) < 1e-9
    for r in C.detail_rows(rows).collect():
        k = a[r.image_id, r.y]
        assert (k.mid, k.top, k.bot) == (r.mid or 0, r.top or 0, r.bot or 0)


def test_art_scores_match_pixels(spark, tables):
    grey, df, table = tables
    sizes = df.select("image_id", F.col("height").alias("h"))
    protect = spark.createDataFrame([(i, a, b) for i, (p, _) in CASES.items() for a, b in p], "image_id int, y0 int, y1 int")
    slices = [(i, k, a, b) for i in CASES for k, (a, b) in enumerate([(0, 1), (1, 3), (3, 90), (90, 91), (91, 200)])]
    df2 = spark.createDataFrame(slices, "image_id int, k int, y0 int, y1 int")
    for r in C.art_scores(df2, table.drop("cost"), C.forbidden(protect, sizes)).collect():
        barred = np.zeros(200, bool)
        for a, b in CASES[r.image_id][0]:
            barred[max(0, a - 4) : b + 4] = True
        assert abs(r.art - art(grey[r.image_id], r.y0, r.y1, barred)) < 1e-9


def test_numbers_run_on_over_images(spark):
    panels = spark.createDataFrame([(i, k) for i, n in ((5, 2), (6, 1), (7, 3)) for k in range(n)], "image_id int, k int")
    images = spark.createDataFrame([("c", 2, 5), ("c", 1, 6), ("d", 1, 7)], "chapter string, seq int, image_id int")
    got = {(r.image_id, r.k): r.name for r in C.number_panels(panels, images).collect()}
    assert got == {(6, 0): "panel_0001.jpg", (5, 0): "panel_0002.jpg", (5, 1): "panel_0003.jpg",
                   (7, 0): "panel_0001.jpg", (7, 1): "panel_0002.jpg", (7, 2): "panel_0003.jpg"}


def strips(rng):
    strips = {i: [(k, rng.randint(20, 3000), rng.choice([10, 30, 200, 900]), rng.choice(["a.", "b", "", "c! "])) for k in range(n)] for i, n in enumerate((1, 2, 25, 60, 400))}
    strips[9] = [(k, 500, 300 + k, "x.") for k in range(40)]  # many boxes at one height
    strips[10] = [(k, 40 * k + 20, 5, "y") for k in range(50)] + [(99, 700, 2900, "deep")]
    return strips


def check_rhythm(boxes, cuts):
    """Each cut is halfway to the next box; the stretch it ends is long enough, and no box before it would have ended that stretch."""
    tops = sorted((y, k, y + h, text) for k, y, h, text in boxes)
    ends = [(bottom, (bottom + below[0]) / 2, text.strip().endswith((".", "!")) or below[0] - bottom > 150) for (_, _, bottom, text), below in zip(tops, tops[1:])]
    fits = lambda i, last: ends[i][0] - last >= (240 if ends[i][2] else 375)
    last, done = 0.0, 0
    while True:
        after = [i for i in range(done, len(ends)) if ends[i][1] in cuts and fits(i, last)]
        stop = after[0] if after else len(ends)
        assert not any(fits(i, last) for i in range(done, stop))
        if not after:
            break
        last, done = ends[stop][1], stop + 1
        cuts = cuts - {last} if not any(ends[i][1] == last for i in range(done, len(ends))) else cuts
    assert cuts <= {m for _, m, _ in ends}


@pytest.mark.parametrize("limit", [1000, 0, 30])
def test_story_cuts(spark, limit):
    boxes = strips(random.Random(4))
    rows = [(i, *b, 300, 10_000) for i, bs in boxes.items() for b in bs]
    df = spark.createDataFrame(rows, "image_id int, box_id bigint, y int, h int, text string, page_w int, page_h int")
    got = {}
    for r in C.story_cuts(df, limit=limit).collect():
        got.setdefault(r.image_id, set()).add(r.t)
    assert 1 not in got or len(got[1]) < 2
    for i, bs in boxes.items():
        check_rhythm(bs, got.get(i, set()))


def test_story_cuts_fixed(spark):
    rows = [(1, 1, 0, 250, "a."), (1, 2, 260, 100, "b"), (1, 3, 380, 100, "c."), (1, 4, 500, 40, "d"), (1, 5, 900, 40, "e"), (1, 6, 1000, 10, "f")]
    df = spark.createDataFrame([(*r, 300, 2000) for r in rows], "image_id int, box_id bigint, y int, h int, text string, page_w int, page_h int")
    for limit in (100, 0):  # a sentence after 250; a wide gap after 540; the length alone does it nowhere
        assert sorted(r.t for r in C.story_cuts(df, limit=limit).collect()) == [255.0, 720.0]


def test_links_over_blocks(spark):
    """Blocks of few boxes give the cuts of the fold, and the rounds of the walk grow with the logarithm of the blocks."""
    rng = random.Random(11)
    boxes = strips(rng) | {20: [(k, 13 * k + rng.randint(0, 40), rng.choice([4, 30, 60]), rng.choice(["a.", "b"])) for k in range(2000)]}
    rows = [(i, float(y), k, float(h), text, 300.0) for i, bs in boxes.items() for k, y, h, text in bs]
    df = spark.createDataFrame(rows, "image_id int, y double, pos bigint, h double, text string, w double")
    gap = C.gaps(df.withColumn("page_h", F.lit(99_999)), "image_id", "pos").where("next_y is not null")
    ready = gap.select("image_id", "y", "pos", (F.col("y") + F.col("h")).alias("bottom"), "mid", "w", (F.col("text").endswith(".") | (F.col("gap") > 150)).alias("free"))
    got, rounds = rhythm.cuts_along(ready, "image_id", 0.8, 1.25, step=8, blocks=1000)
    got = sorted({(r.image_id, r.mid) for r in got.collect()})
    plain, few = rhythm.cuts_along(ready, "image_id", 0.8, 1.25)
    assert got == sorted({(r.image_id, r.mid) for r in plain.collect()})
    assert few <= 1 and 3 <= rounds <= 9 and len([1 for i, _ in got if i == 20]) > 60


def test_modes(spark):
    boxes = spark.createDataFrame([(1, 1, 1, 100, 50, "a.", 100, 900), (1, 2, 2, 400, 50, "b", 100, 900)],
                                  "image_id int, box_id bigint, n int, y int, h int, text string, page_w int, page_h int")
    ends = spark.createDataFrame([(1, 1)], "image_id int, n int")
    assert story_targets(boxes, ends, "visual") is None
    assert [r.t for r in story_targets(boxes, ends).collect()] == [275.0]
    assert [r.t for r in story_targets(boxes, ends.limit(0), "heuristic").collect()] == [275.0]
    assert story_targets(boxes, ends.limit(0)).count() == 0
    with pytest.raises(ValueError):
        story_targets(boxes, ends, "other")


def test_tall_images_in_blocks(spark):
    """Blocks of rows give the panels of the whole-image search, also over long stretches without a free row."""
    rng = np.random.default_rng(3)
    heights = {1: 3000, 2: 2100, 3: 640, 4: 2500}
    rows = []
    for i, h in heights.items():
        for y in range(h):
            free = not (i == 2 and 300 < y < 1500) and not (i == 4 and y > 200) and y % 9 != 4
            drawn = int(rng.integers(0, 30)) if y % 200 > 60 else 0
            rows.append((i, y, float(rng.integers(0, 50)), drawn, drawn, drawn, free))
    df = spark.createDataFrame(rows, "image_id int, y int, cost double, mid int, top int, bot int, free boolean")
    images = spark.createDataFrame([(i, 60, h) for i, h in heights.items()] + [(9, 60, 5000)], "image_id int, w int, h int")
    taken = df.where("not free").select("image_id", F.col("y").alias("a"), (F.col("y") + 1).alias("b"))
    for merge in (False, True):
        got = [
            sorted(tuple(r) for r in C.split_panels(df.select("image_id", "y", "cost"), df.select("image_id", "y", F.lit(60).alias("width"), "mid", "top", "bot"), images, taken, merge=merge, **more).collect())
            for more in ({}, {"limit": 0, "block": 320}, {"limit": 1000, "block": 1})
        ]
        assert got[0] == got[1] == got[2]
        assert len([r for r in got[0] if r[0] == 1]) > 20 and (9, 0, 0, 5000, False) in got[0]
    assert len(got[0]) < len(C.split_panels(df.select("image_id", "y", "cost"), df.select("image_id", "y", F.lit(60).alias("width"), "mid", "top", "bot"), images, taken, merge=False).collect())


def test_windows_by_parts(spark):
    rng = random.Random(1)
    rows = [(i, y, [rng.randint(0, 255) for _ in range(6)]) for i in (1, 2) for y in range(70)]
    df = spark.createDataFrame(rows, "image_id int, y int, px array<bigint>")
    for f in (lambda b: C.smooth(C.row_profile(df), b), lambda b: C.detail_rows(df, bits=b)):
        assert sorted(f(3).collect()) == sorted(f(16).collect())


def test_listed_rows_are_not_broadcast(spark):
    slices = spark.createDataFrame([(1, 0, 0, 300), (1, 1, 300, 301)], "image_id int, k int, y0 int, y1 int")
    detail = spark.range(301).selectExpr("1 as image_id", "cast(id as int) as y", "10 as width", "3 as mid", "5 as top", "7 as bot")
    ranges = spark.createDataFrame([(1, 100, 200)], "image_id int, a int, b int")
    scored = C.art_scores(slices, detail, ranges)
    assert sorted((r.k, r.art) for r in scored.collect()) == [(0, (198 * 3 + 5 + 7) / 2000), (1, 0.0)]
    assert "Broadcast" not in scored._jdf.queryExecution().executedPlan().toString()


def test_snapped_images_without_targets_follow_the_sql(spark, tmp_path):
    """More images than customers' numbers name: those without a target stay whole."""
    import oracle
    from panelmill import queries as registry

    registry.load()
    sf = "/root/testdata/sf0.001"
    far = spark.read.parquet(f"{sf}/embeddings.parquet")
    far.unionByName(far.withColumn("vec_id", F.col("vec_id") + 2000)).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("lineitem", "customer"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    con = oracle.duckdb.connect()
    for name in ("embeddings", "lineitem", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    name = "story_snapped_cuts"
    assert oracle.compare(spark, con, str(tmp_path), name, registry.QUERIES[name], registry.ORACLES[name]) is None


def test_strips_keep_their_rows_in_small_partitions(spark):
    """An image's sizes and targets come with its rows, however Spark joins the partitions of either."""
    assert _in_small_partitions(spark, "strip_snapped_cuts") is None


def test_images_keep_their_rows_in_small_partitions(spark):
    assert _in_small_partitions(spark, "story_snapped_cuts") is None


def _in_small_partitions(spark, name):
    import oracle
    from panelmill import queries as registry

    registry.load()
    sf, small = "/root/testdata/sf0.001", "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    spark.conf.set(small, "1")
    try:
        return oracle.compare(spark, oracle.connect(sf), sf, name, registry.QUERIES[name], registry.ORACLES[name])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset(small)


def test_many_small_images_walk_together(spark):
    rng = random.Random(5)
    boxes = [(i, b, 8 * rng.randrange(400), rng.randrange(10, 400), rng.choice(["a.", "b"]), 400, 3600) for i in range(60) for b in range(rng.randrange(0, 40))]
    df = spark.createDataFrame(boxes, "image_id int, box_id int, y int, h int, text string, page_w int, page_h int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")  # images lie across batches
    try:
        together = C.story_cuts(df, limit=0)
        got = sorted(map(tuple, together.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got and got == sorted(map(tuple, C.story_cuts(df).collect()))
    # no Python call for each image, however small
    assert "FlatMap" not in together._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [1 << 17, 0])
def test_panels_of_many_images_take_no_call_each(spark, limit):
    """Images across Arrow batches, one of them without rows: the same panels, and no Python call per image or block."""
    grey = {i: strip(i) for i in range(12)}
    df = spark.createDataFrame([(i, y, [int(v) for v in g[y]]) for i, g in grey.items() for y in range(len(g))], "image_id int, y int, px array<bigint>")
    images = spark.createDataFrame([(i, 200, 40) for i in (*grey, 99)], "image_id int, h int, w int")
    ranges = spark.createDataFrame([(2, 30, 60), (5, 0, 200)], "image_id int, a int, b int")
    cut = lambda: C.split_panels(C.smooth(C.row_profile(df)), C.detail_rows(df), images, ranges, limit=limit, block=64)
    want = sorted(map(tuple, cut().collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
    try:
        split = cut()
        got = sorted(map(tuple, split.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and (99, 0, 0, 200, False) in got and len(got) > 20
    assert "FlatMapGroups" not in split._jdf.queryExecution().executedPlan().toString()


def test_slopes_of_a_row_are_worked_out_once(spark):
    g = strip(3, height=30)
    df = spark.createDataFrame([(1, y, [int(v) for v in g[y]]) for y in range(30)], "image_id int, y int, px array<bigint>")
    whole = C.detail_rows(df)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, C.detail_rows(df, bits=2).collect()))
    assert "lag(xc" in whole._jdf.queryExecution().optimizedPlan().toString()
