import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from panelmill.operators import jobs as J, links as K, textflow as T
from panelmill.plans import batch, transcript

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_bundle_files_in_order(spark):
    rows = [("a", 7, s, f"{s}.txt", s * 10) for s in (30, 1, 2)] + [("b", 12345, 5, "é.txt", 0)]
    df = spark.createDataFrame(rows, "chapter string, ch int, seq bigint, name string, size bigint")
    got = sorted(tuple(r) for r in J.bundle_files(df).collect())
    assert got == [("a", "chapter_0007.zip", 1, "1.txt", 10, 0), ("a", "chapter_0007.zip", 2, "2.txt", 20, 10), ("a", "chapter_0007.zip", 30, "30.txt", 300, 30), ("b", "chapter_12345.zip", 5, "é.txt", 0, 0)]


def test_batch_expansion(spark):
    df = spark.createDataFrame([("http://s/chapter-8/x",)], "url string")
    assert [r.ch for r in J.expand_batch(df).collect()] == [str(i) for i in range(8, 18)]
    assert [r.chapter_url for r in J.expand_batch(df, 3, 4).collect()] == ["http://s/chapter-3/x", "http://s/chapter-4/x"]
    assert [r.ch for r in J.expand_batch(df, 5, 2).collect()] == ["5"]
    bad = spark.createDataFrame([("http://s/none",)], "url string")
    with pytest.raises(Exception, match="no chapter number"):
        J.expand_batch(bad).collect()
    assert J.expand_batch(bad, strict=False).count() == 0
    far = spark.createDataFrame([("http://s/chapter-" + "9" * 45,)], "url string")
    assert [r.ch for r in J.expand_batch(far).collect()] == ["9" * 45, *[str(10**45 + i) for i in range(9)]]
    assert [r.ch for r in J.expand_batch(far, end=10**45 + 1).collect()] == ["9" * 45, "1" + "0" * 45, "1" + "0" * 44 + "1"]
    with pytest.raises(Exception, match="too many chapters"):
        J.expand_batch(far, 1, 10**20).collect()
    assert batch.plan_batch(df, 1, 1).first().folder == "x"


def process(url):
    if url.endswith("2"):
        raise RuntimeError("gone")
    return ("/out/" + url[-1], 0 if url.endswith("3") else 4)


def test_run_batch_keeps_errors_as_rows(spark):
    df = spark.createDataFrame([(f"http://s/c/{i}", i) for i in (1, 2, 3)], "chapter_url string, ch bigint")
    got = {r.ch: (r.status, r.error) for r in J.run_batch(df, process).collect()}
    assert got == {1: ("done", None), 2: ("failed", "gone"), 3: ("skipped", None)}


def test_all_failed_stops_the_job(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), ("b", "x")], "chapter string, error string")
    assert J.require_any(df.where("chapter = 'a'"), ["chapter"]).collect()[0][1:] == (1, 1)
    with pytest.raises(Exception, match="every page failed"):
        J.require_any(df, ["chapter"]).collect()


def test_elapsed(spark):
    rows = [("a", 0, "start"), ("a", 10, "pause"), ("a", 25, "resume"), ("a", 40, "pause"), ("a", 100, "end"), ("b", 5, "start"), ("b", 9, "end")]
    df = spark.createDataFrame(rows, "job_id string, s bigint, kind string").select("job_id", F.timestamp_seconds("s").alias("ts"), "kind")
    got = J.elapsed(df).withColumn("t", J.clock(F.col("seconds")))
    assert {r.job_id: (r.seconds, r.t) for r in got.collect()} == {"a": (25.0, "00:25"), "b": (4.0, "00:04")}


def test_registry(spark):
    log = spark.createDataFrame([("/a/x/t/layout.json", "", 1), ("/b/y/t/layout.json", "B", 2), ("/a/x/t/layout.json", "", 3)], "layout string, chapter string, arrival bigint")
    log = log.withColumn("saved_at", F.timestamp_seconds("arrival"))
    got = J.labels(J.upsert_recent(log)).collect()
    assert [(r.name, r.arrival, r.shown) for r in got] == [("x", 3, "Jan 01, 00:00"), ("B", 2, "Jan 01, 00:00")]
    assert [r.arrival for r in J.upsert_recent(log, keep=1).collect()] == [3]
    there = spark.createDataFrame([("/b/y/t/layout.json",)], "layout string")
    assert [r.layout for r in J.live(J.upsert_recent(log), there).collect()] == ["/b/y/t/layout.json"]


def test_tiers(spark):
    rows = [("a", 1, True)] * 2 + [("a", 2, True)] * 3 + [("a", 3, True)] * 9 + [("b", 2, True)] * 2 + [("b", 3, True)] * 2 + [("c", 1, False)] * 5
    df = spark.createDataFrame(rows, "chapter string, tier int, ok boolean")
    assert {tuple(r) for r in K.choose_tier(df).collect()} == {("a", 2, 3), ("b", 2, 2), ("c", None, 0)}
    assert {(r.chapter, r.status) for r in J.ledger(df).collect()} == {("a", "done"), ("b", "done"), ("c", "failed")}


def test_log_order(spark):
    log = '# /d/3.jpg\n"/d/1.PNG"\nskip\n# /d/3.jpg\n  /d/2.bmp'
    df = spark.createDataFrame([("c", log)], "chapter string, log string")
    assert [(r.pos, r.file) for r in K.order_from_log(df).collect()] == [(1, "/d/3.jpg"), (2, "/d/1.PNG"), (3, "/d/2.bmp")]


def test_rendered_lists(spark):
    schema = "page_id int, dom array<string>, srcset array<string>, api array<string>, net array<string>"
    g = lambda d, n: [f"http://h/{d}/{i}.jpg" for i in range(n)]
    rows = [(1, g("d", 2), ["http://h/d/9.jpg"], g("a", 5), []), (2, g("d", 2), [], g("a", 3), g("n", 9)), (3, g("d", 1), [], g("a", 2), g("n", 2)),
            (4, ["blob:x", "http://h/logo.png"], [], [], ["ftp://n/1.jpg"]), (5, [], [], [], [])]
    got = {}
    for r in K.rendered_urls(spark.createDataFrame(rows, schema)).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append(r.img)
    assert got == {1: g("d", 2) + ["http://h/d/9.jpg"], 2: g("a", 3), 3: g("a", 2), 4: ["ftp://n/1.jpg"]}


def test_acquire(spark):
    imgs = "".join(f"<img src='/b/{i}.jpg'>" for i in range(4))
    rows = [(1, "http://h/1", "http://h/1", imgs), (2, "http://h/2", "http://other/", imgs), (3, "http://h/3", "http://h/3", "<p>")]
    crawled = spark.createDataFrame(rows, "page_id int, url string, final_url string, html string")
    more = spark.createDataFrame([(3, 1, "http://h/x.jpg")], "page_id int, pos int, img string")
    pages, ledger = batch.acquire(crawled, more)
    assert {(r.page_id, r.pos, r.img) for r in pages.collect()} == {(1, i + 1, f"http://h/b/{i}.jpg") for i in range(4)} | {(3, 1, "http://h/x.jpg")}
    assert {(r.chapter, r.status) for r in ledger.collect()} == {(1, "done"), (2, "failed"), (3, "done")}
    assert [r.page_id for r in K.require_urls(crawled, pages).collect()] == [2]


def test_transcript_flow(spark):
    """Readings to items, items to canvases, and a reply back onto them."""
    pages = spark.createDataFrame([("c", 1, 10, 100, 200), ("c", 2, 11, 50, 100)], "chapter string, seq int, image_id int, w int, h int")
    rows = [(10, 1, 10, 10, 40, 10, "hello", 0.9, "", 0.0), (10, 2, 10, 24, 40, 10, "there", 0.8, "", 0.0), (10, 3, 60, 150, 30, 20, "xx", 0.9, "쾅", 0.7),
            (11, 4, 5, 5, 20, 10, "bye.", 0.95, "", 0.0), (11, 5, 5, 60, 20, 10, "faint", 0.1, "", 0.0)]
    readings = spark.createDataFrame(rows, "image_id int, box_id bigint, x int, y int, w int, h int, en_text string, en_conf double, ko_text string, ko_conf double")
    dets = spark.createDataFrame([(10, "bubble", 0, 0, 60, 50), (11, "text_free", 0, 0, 50, 50)], "image_id int, class string, x1 int, y1 int, x2 int, y2 int")
    items = transcript.read_items(readings, dets, pages)
    got = [(r.page, r.n, r.kind, r.text) for r in items.orderBy("n").collect()]
    assert got == [(1, 1, "bubble", "hello there"), (1, 2, "sfx", "쾅"), (2, 3, "sfx", "bye.")]
    canvases, placed = transcript.lay_out(pages, items)
    assert [(r.image, r.width, r.height) for r in canvases.collect()] == [("canvas_001.png", 100, 400)]
    assert [(r.n, r.x, r.y, r.w, r.h) for r in placed.orderBy("n").collect()][2] == (3, 10, 210, 40, 20)
    reply = spark.createDataFrame([("c", "1. **Ra** hi\n3. x\n9. y\nPOSTS: 1-2 | 3")], "chapter string, text string")
    filled, posts = transcript.apply_reply(items, reply)
    assert [(r.n, r.text, r.filled, r.styled) for r in filled.orderBy("n").collect()] == [(1, "Ra hi", True, True), (2, "쾅", False, False), (3, "x", True, False)]
    assert [r.n for r in T.cut_after(items.withColumn("n", F.col("n").cast("int")), posts).collect()] == [2]
