import json

from pyspark.sql import functions as F

from panelmill.operators import textflow as T
from panelmill.sources import documents as D


def items(spark):
    rows = [("c1", 1, 1, "bubble", 1, 2, 3, 4, 'say "hi"', 0.91), ("c1", 1, 2, "sfx", 5, 6, 7, 8, "ប៊ូម\\", 0.5), ("c1", 3, 3, "bubble", 0, 0, 1, 1, "end", 1.0),
            ("c2", 2, 1, "sfx", 0, 0, 1, 1, "x", 0.4)]
    return spark.createDataFrame(rows, "chapter string, page bigint, n int, kind string, x int, y int, w int, h int, text string, conf double")


def joined(lines, chapter, **where):
    rows = lines.where(F.col("chapter") == chapter)
    for k, v in where.items():
        rows = rows.where(F.col(k) == v)
    return "\n".join(r.line for r in rows.orderBy(*T.LINE_ORDER).collect())


def test_transcript_text(spark):
    text = joined(T.transcript_lines(items(spark), "ko", "PROMPT"), "c1")
    assert text == '# c1 — transcript (ko)\n\n> PROMPT\n\n## Page 1\n1. [bubble] say "hi"\n2. [sfx] ប៊ូម\\\n\n## Page 3\n3. [bubble] end\n'


def test_transcript_json_round_trip(spark, tmp_path):
    doc = json.loads(joined(T.transcript_json_lines(items(spark), "ko"), "c1"))
    assert doc["chapter"] == "c1" and doc["lang"] == "ko" and [p["page"] for p in doc["pages"]] == [1, 3]
    assert doc["pages"][0]["items"][0] == {"n": 1, "kind": "bubble", "bbox": [1, 2, 3, 4], "text": 'say "hi"', "conf": 0.91}
    (tmp_path / "transcript.json").write_text(json.dumps(doc))
    (tmp_path / "corrupt.json").write_text("{nope")
    back = D.read_transcripts(spark, str(tmp_path)).orderBy("n").collect()
    assert [(r.page, r.item, r.n, r.kind, r.x, r.h, r.text, r.conf) for r in back] == [
        (1, 0, 1, "bubble", 1, 4, 'say "hi"', 0.91), (1, 1, 2, "sfx", 5, 8, "ប៊ូម\\", 0.5), (3, 0, 3, "bubble", 0, 1, "end", 1.0)]


def test_json_commas_over_gaps_and_blocks(spark):
    rows = [("c", p, n, "k", 1, 1, 1, 1, f"t{n}", 0.5) for p, n in ((1, 1), (1, 5), (4, 9), (4, 200_000), (4, 5_000_000), (7, 5_000_001))]
    gappy = spark.createDataFrame(rows, items(spark).schema.simpleString()[7:-1].replace(":", " ").replace("n int", "n bigint"))
    doc = json.loads(joined(T.transcript_json_lines(gappy), "c"))
    assert [(p["page"], [i["n"] for i in p["items"]]) for p in doc["pages"]] == [(1, [1, 5]), (4, [9, 200_000, 5_000_000]), (7, [5_000_001])]
    got = T.with_neighbours(gappy, "chapter", "page", bits=1).orderBy("n").collect()
    assert [(r["_before"], r["_after"]) for r in got] == [(None, 1), (1, 4), (1, 4), (4, 4), (4, 7), (4, None)]


def test_layout_json_round_trip(spark, tmp_path):
    segs = spark.createDataFrame([("c1", 1, "canvas_001.png", 700, 900), ("c1", 2, "canvas_002.png", 700, 50)], "chapter string, pack int, image string, width int, height int")
    its = items(spark).where("chapter = 'c1'").withColumn("pack", F.lit(1))
    doc = json.loads(joined(T.layout_json_lines(segs, its), "c1"))
    assert [s["image"] for s in doc["segments"]] == ["canvas_001.png", "canvas_002.png"] and doc["segments"][1]["items"] == []
    assert doc["segments"][0]["items"][1] == {"n": 2, "bbox": [5, 6, 7, 8], "src": "ប៊ូម\\", "kind": "sfx"}
    (tmp_path / "layout.json").write_text(json.dumps(doc))
    s, i = D.read_layouts(spark, str(tmp_path))
    assert [(r.pack, r.image, r.height) for r in s.orderBy("pack").collect()] == [(1, "canvas_001.png", 900), (2, "canvas_002.png", 50)]
    assert i.count() == 3


def test_page_scripts(spark):
    table = spark.createDataFrame([("c1", 1, 'a"b'), ("c1", 2, "boom")], "chapter string, n int, text string")
    lines = T.page_script_lines(items(spark), table, "// head\n", kinds=("bubble",))
    assert joined(lines, "c1", page=1).split("\n")[-1] == 'addText("a\\"b", 1, 2, 3, 4, "kh_1_bubble");'
    assert joined(lines, "c1", page=3) == "// head\n"
    got = {(r.chapter, r.page): (r.script, r.layers) for r in T.script_counts(items(spark), table).collect()}
    assert got == {("c1", 1): ("page_001.jsx", 2), ("c1", 3): ("page_003.jsx", 0), ("c2", 2): ("page_002.jsx", 0)}


def test_written_lines_are_ordered_and_replaced(spark, tmp_path):
    out = str(tmp_path / "out")
    for prompt in ("OLD", "NEW"):
        T.write_lines(T.transcript_lines(items(spark), "en", prompt), out, ["chapter"], partitions=3)
    parts = sorted((tmp_path / "out" / "chapter=c1").glob("part-*.txt"))
    text = "".join(p.read_text() for p in parts)
    assert text == joined(T.transcript_lines(items(spark), "en", "NEW"), "c1") + "\n"


def project(spark):
    rows = [("c", 1, "layout.json", "N", 1, [[1, 4], [5, 9]], "b.png", [("text", 2)], False), ("c", 0, "layout.json", "N", 1, [[1, 4], [5, 9]], "a.png", [("text", 1)], True)]
    return spark.createDataFrame(rows, "chapter string, pos int, layout string, name string, seg_idx int, post_groups array<array<int>>, image string, state array<struct<kind:string,n:int>>, differs boolean")


def test_project_round_trip(spark, tmp_path):
    data = json.loads(joined(T.project_lines(project(spark)), "c"))
    assert data["segments"] == [{"image": "a.png", "state": [{"kind": "text", "n": 1}], "work": "a_work.png"}, {"image": "b.png", "state": [{"kind": "text", "n": 2}]}]
    data["segments"][0]["state"].append({"kind": "image", "x": 1.0, "data": "AAEC"})
    (tmp_path / "p.json").write_text(json.dumps(data))
    (tmp_path / "q.json").write_text("[")
    head, segs, posts = D.read_projects(spark, str(tmp_path))
    assert head.select("layout", "name", "seg_idx").collect()[0] == ("layout.json", "N", 1)
    assert sorted((r.k, r.lo, r.hi) for r in posts.collect()) == [(0, 1, 4), (1, 5, 9)]
    assert [r.n for r in D.text_boxes(segs).orderBy("n").collect()] == [1, 2]
    assert bytes(D.image_boxes(segs).first().data) == b"\0\1\2"


def test_resume_keeps_unmatched(spark):
    layout = spark.createDataFrame([("a.png", 1), ("b.png", 2)], "image string, k int")
    saved = spark.createDataFrame([("a.png", "old", 1), ("a.png", "new", 2), ("z.png", "z", 3)], "image string, state string, at int")
    assert sorted(tuple(r) for r in T.project_merge(layout, saved, ["image"], "at").collect()) == [("a.png", 1, "new"), ("b.png", 2, None)]


def test_recents_and_replies(spark, tmp_path):
    good, bad = tmp_path / "r.json", tmp_path / "bad.json"
    good.write_text(json.dumps([{"layout": "/x", "chapter": "c", "thumb": "", "saved_at": 1700000000.5}, {"layout": "/y", "saved_at": 1.0}]))
    bad.write_text("{{{")
    rows = D.read_recents(spark, str(good)).orderBy(F.desc("arrival")).collect()
    assert [(r.layout, r.chapter) for r in rows] == [("/x", "c"), ("/y", "")] and rows[0].saved_at.microsecond == 500000
    assert D.read_recents(spark, str(bad)).count() == 0
    (tmp_path / "c9").mkdir()
    (tmp_path / "c9" / "reply.txt").write_text("1. a\n2. b")
    assert [(r.chapter, r.text) for r in D.read_replies(spark, str(tmp_path / "c9")).collect()] == [("c9", "1. a\n2. b")]


def test_sources_split(spark):
    df = spark.createDataFrame([(" HTTP://x/1",), ("/data/ch",)], "source string")
    urls, folders = D.route_sources(df)
    assert urls.count() == 1 and folders.first().source == "/data/ch"


def test_translated_canvases(spark):
    canv = spark.createDataFrame([(1, "a.png"), (2, "b.png"), (3, "c.png")], "page int, image string")
    its = spark.createDataFrame([(1, "hi"), (1, "ក"), (2, "hi")], "page int, text string")
    rows = {r.page: (r.status, r.target, r.in_book) for r in T.route_export(T.is_translated(canv, its, ["page"])).collect()}
    assert rows == {1: ("translated", "a_kh.png", True), 2: ("clean_untranslated", "clean_untranslated/b_kh.png", False), 3: ("translated", "c_kh.png", True)}
