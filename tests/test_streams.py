import numpy as np
from conftest import png
from pyspark.sql import functions as F

from panelmill.streaming import arrivals as A


def write(folder, name, h, w):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(png(np.zeros((h, w, 3), np.uint8)))


def test_pages_are_planned_as_they_arrive(spark, tmp_path):
    src, table, plans, check = (tmp_path / n for n in ("in", "pages", "plans", "check"))
    write(src / "c1", "1.png", 30, 10)
    (src / "c1" / "bad.png").write_bytes(b"x")
    write(src / "c2", "1.png", 8, 4)

    def run():
        stream = A.arriving_images(spark, str(src))
        A.plan_arrivals(stream, str(table), str(plans), str(check), segments=2).awaitTermination()
        return {(r.chapter, r.segment): (r.y0, r.y1, r.batch) for r in A.current_plans(spark, str(plans)).collect()}

    assert run() == {("c1", 0): (0, 15, 0), ("c1", 1): (15, 30, 0), ("c2", 0): (0, 4, 0), ("c2", 1): (4, 8, 0)}
    write(src / "c1", "2.png", 10, 10)
    assert run() == {("c1", 0): (0, 20, 1), ("c1", 1): (20, 40, 1), ("c2", 0): (0, 4, 0), ("c2", 1): (4, 8, 0)}


def test_a_batch_reads_touched_chapters_only(spark, tmp_path):
    src, table, plans, check = (tmp_path / n for n in ("in", "pages", "plans", "check"))
    names = [f"c{i}" for i in range(6)]

    def run():
        A.plan_arrivals(A.arriving_images(spark, str(src)), str(table), str(plans), str(check), segments=2).awaitTermination()
        return {(r.chapter, r.segment): (r.y0, r.y1) for r in A.current_plans(spark, str(plans)).collect()}

    want = {}
    for i, name in enumerate(names):
        write(src / name, "1.png", 10 + 2 * i, 5)
        want |= {(name, 0): (0, 5 + i), (name, 1): (5 + i, 10 + 2 * i)}
    assert run() == want
    write(src / "c1", "2.png", 4, 5)
    want |= {("c1", 0): (0, 8), ("c1", 1): (8, 16)}
    assert run() == want
    write(src / "c2", "2.png", 6, 5)
    want |= {("c2", 0): (0, 10), ("c2", 1): (10, 20)}
    assert run() == want
    of = {r.chapter: r.b for r in spark.createDataFrame([(n,) for n in names], "chapter string").select("chapter", A.bucket_of("chapter", 256).alias("b")).collect()}
    assert len(set(of.values())) == len(names)
    # what the third batch read and wrote: the folders of its own chapter
    read = A.in_buckets(spark, str(table), [of["c2"]], 3)
    assert [r.chapter for r in read.collect()] == ["c2", "c2"]
    pruned = read._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in pruned and "batch" in pruned
    assert [p.parent.name for p in plans.glob("bucket=*/batch=2")] == [f"bucket={of['c2']}"]
    # a repeated batch changes nothing
    for name in ("2", ".2.crc"):
        (check / "commits" / name).unlink(missing_ok=True)
    assert run() == want


def test_progress_state_ends_with_the_job(spark, tmp_path):
    src, told = tmp_path / "e", {}
    schema = "job_id bigint, stage string, ts timestamp"

    def batch(rows):
        df = spark.createDataFrame(rows, "job_id bigint, stage string, s bigint").select("job_id", "stage", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(str(src))
        events = spark.readStream.schema(schema).parquet(str(src))
        keep = lambda out, _: told.update({(r.job_id, r.stage): (r.done, r.closed) for r in out.collect()})
        q = A.closing_progress(events, idle="1 hour").writeStream.foreachBatch(keep).outputMode("update")
        q = q.option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start()
        q.awaitTermination()
        return q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"], told

    size, rows = batch([(1, "clean", 10), (1, "clean", 20), (2, "stitch", 5), (3, "clean", 6)])
    assert size == 3 and told == {(1, "clean"): (2, False), (2, "stitch"): (1, False), (3, "clean"): (1, False)}
    size, rows = batch([(1, "clean", 30), (1, "end", 40), (2, "stitch", 50)])
    assert size == 2 and rows[1, "clean"] == (3, True) and rows[1, "end"] == (1, True) and rows[2, "stitch"] == (2, False)
    batch([(4, "clean", 20_000)])  # hours later: the idle jobs close
    size, rows = batch([(4, "clean", 20_001)])
    assert size == 1 and rows[4, "clean"] == (2, False)


def test_links_are_given_once_for_good(spark, tmp_path):
    src, seen, out, check = (str(tmp_path / n) for n in ("l", "seen", "out", "check"))

    def again():
        links = spark.readStream.schema("page_id bigint, img string, ts timestamp").parquet(src)
        A.first_seen_for_good(links, seen, out, check, buckets=4).awaitTermination()
        return sorted((r.page_id, r.img, int(r.ts.timestamp())) for r in spark.read.parquet(out).collect())

    def batch(rows):
        df = spark.createDataFrame(rows, "page_id bigint, img string, s bigint").select("page_id", "img", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(src)
        return again()

    year = 365 * 86400
    assert batch([(1, "a", 2), (1, "a", 1), (1, "b", 3), (2, "a", 4)]) == [(1, "a", 1), (1, "b", 3), (2, "a", 4)]
    after = [(1, "a", 1), (1, "b", 3), (2, "a", 4), (3, "c", year)]
    assert batch([(1, "a", year), (3, "c", year)]) == after
    # a restart repeats the last batch
    for name in ("1", ".1.crc"):
        (tmp_path / "check" / "commits" / name).unlink(missing_ok=True)
    assert again() == after
    assert batch([(3, "c", 2 * year), (2, "a", 2 * year)]) == after


def test_collect_pages(spark, tmp_path):
    write(tmp_path / "in" / "c", "a.png", 3, 2)
    (tmp_path / "in" / "c" / "note.txt").write_text("x")
    A.collect_pages(A.arriving_images(spark, str(tmp_path / "in"), files_per_batch=1), str(tmp_path / "t"), str(tmp_path / "k")).awaitTermination()
    assert [(r.chapter, r.fname, r.w, r.h) for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [("c", "a.png", 2, 3)]


def memory(stream, name, mode, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()


def test_progress(spark, tmp_path):
    rows = [(1, "clean", 10), (1, "clean", 20), (1, "stitch", 30), (2, "clean", 5)]
    spark.createDataFrame(rows, "job_id bigint, stage string, s bigint").select("job_id", "stage", F.timestamp_seconds("s").alias("ts")).write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema("job_id bigint, stage string, ts timestamp").parquet(str(tmp_path / "e"))
    memory(A.progress_stream(events), "prog", "update", tmp_path)
    assert {(r.job_id, r.stage, r.done) for r in spark.table("prog").collect()} == {(1, "clean", 2), (1, "stitch", 1), (2, "clean", 1)}
    totals = spark.createDataFrame([(1, 4)], "job_id bigint, total bigint")
    memory(A.progress_stream(events, totals), "shared", "update", tmp_path)
    assert {(r.job_id, r.stage, r.total, r.share) for r in spark.table("shared").collect()} == {(1, "clean", 4, 0.5), (1, "stitch", 4, 0.25), (2, "clean", None, None)}


def test_first_seen(spark, tmp_path):
    rows = [(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "a", 4)]
    spark.createDataFrame(rows, "page_id bigint, img string, s bigint").select("page_id", "img", F.timestamp_seconds("s").alias("ts")).write.parquet(str(tmp_path / "l"))
    links = spark.readStream.schema("page_id bigint, img string, ts timestamp").parquet(str(tmp_path / "l"))
    memory(A.first_seen(links), "seen", "append", tmp_path)
    assert sorted((r.page_id, r.img) for r in spark.table("seen").collect()) == [(1, "a"), (1, "b"), (2, "a")]


def test_page_urls_need_no_state(spark, tmp_path):
    spark.createDataFrame([(1, "http://h/", "<img class='chapter-img' src='a.jpg'>")], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "p"))
    pages = spark.readStream.schema("page_id bigint, url string, html string").parquet(str(tmp_path / "p"))
    memory(A.page_url_stream(pages), "urls", "append", tmp_path)
    assert [tuple(r) for r in spark.table("urls").collect()] == [(1, 1, "http://h/a.jpg")]
