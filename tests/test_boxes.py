import random

import pytest
from pyspark.sql import functions as F

from panelmill.operators import boxes as B, graphs, textflow as T


def touches(a, b):
    """Two lines (id, x, y, w, h) are near when their rectangles, grown by 0.35 and 0.8 heights, meet."""
    (_, ax, ay, aw, ah), (_, bx, by, bw, bh) = a, b
    side, lid = 0.35 * (ah + bh), 0.8 * (ah + bh)
    return ax <= bx + bw + side and bx <= ax + aw + side and ay <= by + bh + lid and by <= ay + ah + lid


def connected(members):
    """Whether steps between near lines lead from the first to all others."""
    todo, rest = [members[0]], members[1:]
    while todo:
        at = todo.pop()
        near = [m for m in rest if touches(at, m)]
        rest = [m for m in rest if m not in near]
        todo += near
    return not rest


def page(rng, n, size, least, most):
    return [(i, rng.randint(0, size), rng.randint(0, size), rng.randint(least, most), rng.randint(2, max(2, most // 3))) for i in range(n)]


PAGES = {
    1: lambda r: page(r, 60, 2000, 5, 60), 2: lambda r: page(r, 300, 900, 2, 12), 3: lambda r: page(r, 200, 60, 2, 300),
    4: lambda r: page(r, 400, 3000, 20, 90), 5: lambda r: [(i, 7, 7, 3, 3) for i in range(150)], 6: lambda r: page(r, 1, 10, 2, 5),
    7: lambda r: page(r, 350, 200, 2, 4),
}


@pytest.mark.parametrize("limit", [1000, 0, 100])
def test_line_clusters(spark, limit):
    rng = random.Random(3)
    pages = {k: make(rng) for k, make in PAGES.items()}
    rows = [(k, *l, f"t{l[0]}", 0.5) for k, ls in pages.items() for l in ls]
    df = spark.createDataFrame(rows, "image_id int, box_id bigint, x int, y int, w int, h int, text string, conf double")
    got = {}
    for r in B.line_labels(df, limit=limit).collect():
        got.setdefault(r.image_id, {}).setdefault(r.label, set()).add(r.box_id)
    for k, lines in pages.items():
        by = {l[0]: l for l in lines}
        label = {b: name for name, members in got[k].items() for b in members}
        assert label.keys() == by.keys(), k
        assert all(label[a[0]] == label[b[0]] for i, a in enumerate(lines) for b in lines[:i] if touches(a, b)), k
        assert all(connected([by[b] for b in sorted(v)]) for v in got[k].values()), k
        assert all(label == min(v) for label, v in got[k].items())


def test_group_lines_rules(spark):
    rows = [(1, 1, 10, 30, 50, 10, "second", 0.91239, "dialogue", "hangul"), (1, 2, 12, 10, 50, 10, "first", 0.5, "dialogue", "hangul"),
            (1, 3, 10, 12, 50, 10, "BOOM", 0.9, "sfx", "hangul")]
    df = spark.createDataFrame(rows, "image_id int, box_id bigint, x int, y int, w int, h int, text string, conf double, kind string, script string")
    got = sorted(tuple(r) for r in B.group_lines(df).collect())
    assert got == [(1, 1, 10, 10, 52, 30, "first second", 0.5, "dialogue", "latin"), (1, 3, 10, 12, 50, 10, "BOOM", 0.9, "sfx", "hangul")]


def test_overlap_pairs_touching(spark):
    # two lines whose reaches share just one corner point are a pair
    rows = [(1, 1, 0, 0, 10, 20), (1, 2, 24, 52, 10, 20), (1, 3, 25, 52, 10, 20)]
    df = spark.createDataFrame(rows, "image_id int, box_id int, x int, y int, w int, h int")
    assert sorted(tuple(r)[1:] for r in B.overlap_pairs(df, cell=16).collect()) == [(1, 2), (2, 3)]


@pytest.mark.parametrize("cell", [4, 64, 1000])
def test_points_in_boxes(spark, cell):
    rng = random.Random(8)
    boxes = [(1, x, y, x + rng.randint(0, 30), y + rng.randint(0, 30)) for x, y in ((rng.randint(-20, 200), rng.randint(0, 200)) for _ in range(80))]
    points = [(1, i, rng.randint(-30, 240), rng.randint(-10, 240)) for i in range(500)] + [(2, 1, 5, 5)]
    b = spark.createDataFrame(boxes, "image_id int, x1 int, y1 int, x2 int, y2 int")
    p = spark.createDataFrame(points, "image_id int, i int, cx int, cy int")
    got = {(r.image_id, r.i): r.inside for r in B.in_any_box(p, b, cell=cell).collect()}
    for page_, i, cx, cy in points:
        assert got[page_, i] == any(page_ == k and x1 <= cx <= x2 and y1 <= cy <= y2 for k, x1, y1, x2, y2 in boxes)


def test_tiles_cover_and_stop(spark):
    df = spark.createDataFrame([(1, 1600), (2, 1601), (3, 3000), (4, 3001), (5, 10)], "image_id int, h int")
    got = {}
    for r in B.tiles(df).orderBy("tile").collect():
        got.setdefault(r.image_id, []).append((r.y0, r.y1))
    assert got[1] == [(0, 1600)] and got[2] == [(0, 1600), (1400, 1601)] and got[5] == [(0, 10)]
    assert got[3] == [(0, 1600), (1400, 3000)] and got[4] == [(0, 1600), (1400, 3000), (2800, 3001)]


def test_unknown_label_is_free_text(spark):
    df = spark.createDataFrame([(7, 0.5, 0.5, 9.5, 8.4, 0.3, 9, 9), (0, 1.0, 1.0, 2.4, 9.0, 0.9, 9, 9), (1, 1.0, 1.0, 5.0, 5.0, 0.29, 9, 9)],
                               "label int, x1 double, y1 double, x2 double, y2 double, score double, page_w int, page_h int")
    assert [(r["class"], r.x1, r.y1, r.x2, r.y2) for r in B.postprocess(df).collect()] == [("text_free", 0, 0, 9, 8)]


def test_reading_routes(spark):
    rows = [(1, "hi ", 0.9, "안녕", 0.2), (2, "hi", 0.9, "안녕", 0.3), (3, "hi", 0.9, "abc", 0.9)]
    df = spark.createDataFrame(rows, "i int, en_text string, en_conf double, ko_text string, ko_conf double")
    of = lambda lang: [(r.kind, r.text, r.conf, r.script) for r in T.route_script(df, lang).orderBy("i").collect()]
    assert of("en") == [("dialogue", "hi", 0.9, "latin"), ("sfx", "안녕", 0.3, "hangul"), ("dialogue", "hi", 0.9, "latin")]
    assert of("ko") == [("dialogue", "안녕", 0.2, "hangul"), ("dialogue", "안녕", 0.3, "hangul"), ("sfx", "hi", 0.9, "latin")]
    with pytest.raises(ValueError):
        T.route_script(df, "fr")


def test_coverage_of_small_parts(spark):
    runs = spark.createDataFrame([(1, 3, 0, 4), (1, 3, 6, 20), (1, 5, 2, 3)], "image_id int, y int, x0 int, x1 int")
    boxes = spark.createDataFrame([(1, 0, 0, 9, 9), (1, 2, 5, 3, 6), (1, 50, 50, 59, 59)], "image_id int, x1 int, y1 int, x2 int, y2 int")
    got = {r.x1: (r.covered, r.area, r.whole) for r in B.box_coverage(runs, boxes).collect()}
    assert got == {0: (9, 100, True), 2: (1, 4, False), 50: (0, 100, True)}


def test_detector_repeats_are_kept(spark):
    df = spark.createDataFrame([(1, 0, 1450, 9, 1500, 0), (1, 0, 50, 9, 100, 1400)], "image_id int, x1 int, y1 int, x2 int, y2 int, tile_y0 int")
    assert [(r.y1, r.y2) for r in B.untile(df).collect()] == [(1450, 1500)] * 2
    assert B.untile(df).where(F.col("y1") == 1450).count() == 2


def test_crowded_cell_is_swept_in_block_pairs(spark):
    rng = random.Random(3)
    rows = [(1, i, rng.randint(0, 200), rng.randint(0, 200), rng.randint(1, 20), rng.randint(1, 12)) for i in range(700)]
    rows += [(1, 800, 250, 250, 40, 20), (1, 801, 255, 255, 5, 5), (2, 1, 0, 0, 9, 9), (2, 2, 3, 3, 9, 9)]
    df = spark.createDataFrame(rows, "image_id int, box_id int, x int, y int, w int, h int")
    reach = {(p, i): (x - 0.35 * h, y - 0.8 * h, x + w + 0.35 * h, y + h + 0.8 * h) for p, i, x, y, w, h in rows}
    want = sorted((p, i, j) for p, i in reach for q, j in reach if p == q and i < j for a, b in [(reach[p, i], reach[p, j])] if max(a[0], b[0]) <= min(a[2], b[2]) and max(a[1], b[1]) <= min(a[3], b[3]))
    assert sorted(tuple(r) for r in B.overlap_pairs(df, cell=256, crowd=100).collect()) == want
    dealt = B.block_pairs(df, ["image_id"], "box_id", 100)
    sizes = [r["count"] for r in dealt.groupBy("image_id", "i", "j").count().collect()]
    assert max(sizes) < 400 and len(sizes) > 20


def test_long_chain_settles_in_few_rounds(spark):
    """A page whose boxes form one chain, each touching only the next, among loose ones."""
    n = 10_000
    order = list(range(n))
    random.Random(4).shuffle(order)
    chain = [(1, order[i] + 5, i * 30, (i % 2) * 3, 25, 10) for i in range(n)]
    loose = [(1, n + 10 + i, 40 * i, 5000, 5, 5) for i in range(50)]
    df = spark.createDataFrame(chain + loose, "image_id int, box_id int, x int, y int, w int, h int")
    rects = B.grown(df).select("image_id", "box_id", "gx1", "gy1", "gx2", "gy2")
    edges = B.sparse_edges(rects)
    labels, rounds = graphs.components(edges, ["image_id"], most=20)
    assert rounds <= 20 and {r.label for r in labels.collect()} == {5}
    got = {r.box_id: r.label for r in B._hot_labels(rects, "image_id").collect()}
    assert all(got[b] == 5 for _, b, *_ in chain) and all(got[b] == b for _, b, *_ in loose)


def test_coverage_lists_no_rows_of_boxes(spark):
    """Boxes of very different heights, above row 0 too, on a page of the usual kind and on a crowded one."""
    rng = random.Random(3)
    runs = [(p, y, x, x + 5) for p in (1, 2) for y in range(-30, 400, 2) for x in (10, 30)]
    boxes = [(p, n, x, y, x + rng.randrange(30), y + rng.choice([0, 7, 63, 64, 300])) for n in range(80) for p in (1, 2)
             for x, y in [(rng.randrange(40), rng.randrange(-40, 200))]]
    boxes += [(1, 90, 0, -40, 50, -40), (3, 91, 0, 0, 9, 9)]
    df = spark.createDataFrame(boxes, "image_id int, box_id int, x1 int, y1 int, x2 int, y2 int")
    marks = spark.createDataFrame(runs, "image_id int, y int, x0 int, x1 int")

    def area(b):
        return sum(max(0, min(r[3], b[4] + 1) - max(r[2], b[2])) for r in runs if r[0] == b[0] and b[3] <= r[1] <= b[5])

    want = {b[:2]: area(b) for b in boxes}
    for limit in (1 << 16, 79):
        out = B.box_coverage(marks, df, limit=limit)
        assert {(r.image_id, r.box_id): r.covered for r in out.collect()} == want
        assert "sequence(y1" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("local, fewest", [(1 << 14, 0), (20, 1)])
def test_components_of_many_small_groups(spark, local, fewest):
    """Groups with few edges are settled where the edges meet, others by rounds; doubled edges change nothing."""
    rng = random.Random(8)
    edges = [(g, rng.randrange(30), rng.randrange(30)) for g in range(40) for _ in range(g)]
    edges = [(g, a, b) for g, a, b in edges if a != b] * 2
    df = spark.createDataFrame(edges, "image_id int, a bigint, b bigint")
    labels, rounds = graphs.components(df, ["image_id"], local=local)
    plain, _ = graphs.components(df, ["image_id"])
    got = sorted(map(tuple, labels.collect()))
    assert got and got == sorted(map(tuple, plain.collect()))
    assert (rounds > 0) == bool(fewest)
