"""Streams: arriving page images, job progress, first-seen links."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.urls import FOLDER_EXTS, has_ext
from ..operators import links
from ..operators.jobs import progress
from ..plans.stitch import stitch_manifest
from ..session import durable
from ..sources.images import base_name, folder_name, image_size

PAGE_FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving_images(spark: SparkSession, path: str, exts=FOLDER_EXTS, files_per_batch: int | None = None) -> DataFrame:
    """Stream of new image files below ``path``: (path, chapter, fname, arrived, w, h).

    Sizes come from the file headers; a file that is no image has w = h = -1.
    """
    reader = spark.readStream.format("binaryFile").schema(PAGE_FILES).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    files = reader.load(path).where(has_ext(F.col("path"), exts))
    sized = files.withColumn("_s", image_size(F.col("content")))
    return sized.select(
        "path", folder_name(F.col("path")).alias("chapter"), base_name(F.col("path")).alias("fname"),
        F.col("modificationTime").alias("arrived"), "_s.w", "_s.h",
    )


def collect_pages(arrivals: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append readable pages to the parquet table ``table``; runs over what is there and stops."""
    return (
        arrivals.where("h > 0").writeStream.format("parquet").option("path", table)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def bucket_of(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def in_buckets(spark: SparkSession, table: str, buckets: list[int], before: int) -> DataFrame | None:
    """Rows of a table laid out by (bucket, batch), of these buckets and of batches before ``before``: no other folder is read."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    if not buckets or not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    rows = spark.read.option("basePath", table).parquet(table)
    return rows.where(F.col("bucket").isin(buckets) & (F.col("batch") < before))


def into_buckets(rows: DataFrame, table: str) -> None:
    """Write rows that carry (bucket, batch); a repeated batch replaces its own folders only."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(table)


def plan_arrivals(arrivals: DataFrame, table: str, plans: str, checkpoint: str, buckets: int = 256, **options) -> StreamingQuery:
    """Keep stitching plans current: each batch adds its pages and re-plans the chapters it touched.

    Pages and plans lie in ``buckets`` folders by a hash of their chapter. A batch reads the pages of the buckets it touches and
    no others, so its cost does not grow with the chapters that rest. It writes these buckets' plans anew, those of resting chapters
    copied; the newest batch of a bucket holds. A repeated batch replaces its own output, so a restart changes nothing.
    """
    from ..sources.images import in_reading_order

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        marked = batch.where("h > 0").withColumn("bucket", bucket_of("chapter", buckets)).withColumn("batch", F.lit(epoch))
        into_buckets(marked, table)
        new = spark.read.option("basePath", table).parquet(table).where(F.col("batch") == epoch).select("chapter", "bucket").distinct()
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        pages = in_buckets(spark, table, touched, epoch + 1)
        if pages is None:
            return
        pages = pages.join(new.select("chapter"), "chapter", "left_semi")
        plan = stitch_manifest(in_reading_order(pages.select("chapter", "fname", "w", "h")), **options)
        plan = plan.withColumn("bucket", bucket_of("chapter", buckets)).withColumn("batch", F.lit(epoch))
        old = in_buckets(spark, plans, touched, epoch)
        if old is not None:
            resting = _newest(old).join(new.select("chapter"), "chapter", "left_anti")
            plan = plan.unionByName(resting.withColumn("batch", F.lit(epoch)))
        into_buckets(durable(plan), plans)

    return (
        arrivals.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _newest(rows: DataFrame) -> DataFrame:
    """Of each bucket the newest batch. The folders' names say which those are, so older files are not opened."""
    newest: dict[int, int] = {}
    for name in rows.inputFiles():
        bucket, batch = (int(x) for x in re.search(r"/bucket=(\d+)/batch=(\d+)/", name).groups())
        newest[bucket] = max(newest.get(bucket, -1), batch)
    hit = F.lit(False)
    for batch in sorted(set(newest.values())):
        hit = hit | ((F.col("batch") == batch) & F.col("bucket").isin([k for k, v in newest.items() if v == batch]))
    return rows.where(hit)


def current_plans(spark: SparkSession, plans: str) -> DataFrame:
    """The newest plan of every chapter: one batch of each bucket is read."""
    return _newest(spark.read.option("basePath", plans).parquet(plans)).drop("bucket")


def progress_stream(events: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Running (job_id, stage, done, last_ts) for an update-mode sink; with ``totals`` (job_id, total) also total and share.

    The state is one row for each job and stage, for good; ``closing_progress`` lets it go.
    """
    done = events.groupBy("job_id", "stage").agg(F.count("*").alias("done"), F.max("ts").alias("last_ts"))
    if totals is None:
        return done
    return done.join(totals.select("job_id", "total"), "job_id", "left").withColumn("share", F.round(F.col("done") / F.col("total"), 6))


def closing_progress(events: DataFrame, ends: tuple[str, ...] = ("end",), idle: str = "1 day") -> DataFrame:
    """Running (job_id, stage, done, last_ts, closed) for an update-mode sink, whose state ends with the job.

    A job is closed by an event of a stage in ``ends``, or once event time has passed its last event by ``idle``; its counts are then given a
    last time with ``closed`` set, and its state is removed. Events of a closed job open it anew. A job's events come in
    Arrow batches, and its state is a few counts, so a busy job needs no more memory than a quiet one.
    """
    kind = events.schema["job_id"].dataType.simpleString()

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get[:1], zip(*state.get[1:3]))) if state.exists else {}
        closed = state.hasTimedOut
        for pdf in [] if closed else batches:
            for stage, ts in pdf.groupby("stage")["ts"]:
                n, last = held.get(stage, (0, 0))
                held[stage] = (n + len(ts), max(last, int(ts.max().timestamp() * 1_000_000)))
                closed = closed or stage in ends
        if closed:
            if state.exists:
                state.remove()
        else:
            latest = max((last for _, last in held.values()), default=0)
            state.update((list(held), [n for n, _ in held.values()], [last for _, last in held.values()]))
            state.setTimeoutTimestamp(max(latest // 1000 + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({
            "job_id": [key[0]] * len(held), "stage": list(held), "done": [n for n, _ in held.values()],
            "last_ts": pd.to_datetime([last for _, last in held.values()], unit="us"), "closed": [closed] * len(held),
        })

    wait = int(pd.Timedelta(idle).total_seconds() * 1000)
    out = f"job_id {kind}, stage string, done bigint, last_ts timestamp, closed boolean"
    keyed = events.select("job_id", "stage", "ts").withWatermark("ts", idle).groupBy("job_id")
    return keyed.applyInPandasWithState(advance, out, "stages array<string>, done array<bigint>, last array<bigint>", "update", GroupStateTimeout.EventTimeTimeout)


def first_seen(links_: DataFrame, ts: str = "ts", keys=("page_id", "img"), delay: str = "1 day") -> DataFrame:
    """Drop repeated links of a page as they arrive. A link is remembered for ``delay`` of event time only: one that comes back
    later is given again; ``first_seen_for_good`` remembers for ever."""
    return links_.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def first_seen_for_good(
    links_: DataFrame, seen: str, out: str, checkpoint: str, ts: str = "ts", keys=("page_id", "img"), buckets: int = 64
) -> StreamingQuery:
    """Give each link once, however late it comes back; new links of a batch are written below ``out``.

    Keys that were given lie as two 64-bit codes in ``buckets`` folders, their files with Parquet Bloom filters. A batch is made distinct,
    reads the folders it touches, and asks for its own codes only: the stored side of that semi join is the one that Spark
    can thin out by a filter of the batch. A repeated batch sees the keys of earlier batches only and replaces its own files, so a
    restart neither loses nor repeats a link.
    """
    code = [F.xxhash64(*keys).alias("k1"), F.xxhash64(F.lit("second"), *keys).alias("k2")]

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("*", *code).groupBy("k1", "k2").agg(F.min_by(F.struct(*batch.columns), ts).alias("r"))
        rows = durable(rows.withColumn("bucket", bucket_of("k1", buckets)).withColumn("batch", F.lit(epoch)))
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        old = in_buckets(spark, seen, touched, epoch)
        if old is not None:
            mine = rows.select("k1", "k2")
            again = old.select("k1", "k2").join(mine, ["k1", "k2"], "left_semi")
            rows = rows.join(again, ["k1", "k2"], "left_anti")
        rows.select("r.*").write.mode("overwrite").parquet(f"{out}/batch={epoch}")
        filtered = rows.select("k1", "k2", "bucket", "batch").write.option("parquet.bloom.filter.enabled#k1", "true")
        filtered.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(seen)

    return links_.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def page_url_stream(pages: DataFrame) -> DataFrame:
    """Page-image links of a stream of crawled pages; the work is row-local, so it needs no state."""
    return links.page_urls(pages)


__all__ = [
    "arriving_images", "collect_pages", "plan_arrivals", "current_plans", "progress_stream", "closing_progress", "first_seen",
    "first_seen_for_good", "page_url_stream", "progress",
]
