"""Job tables: batch expansion, outcome ledgers, registries, progress, bundles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import urls as U
from .ordering import running

WINDOW = 10


def expand_batch(sources: DataFrame, start: int | None = None, end: int | None = None, strict: bool = True) -> DataFrame:
    """One row per chapter address: start..end, by default the detected number and the nine after it.

    Chapter numbers (``ch``) are digits of any length. An end before the start still gives one chapter. A source without a chapter
    number is an error (``strict``) or dropped; so is, always as an error, a range of 10 ** 18 chapters or more.
    """
    found = sources.withColumn("_d", U.detect_chapter(F.col("url")))
    if strict:
        message = F.concat(F.lit("no chapter number in "), F.col("url"))
        found = found.withColumn("_d", F.when(F.col("_d").isNull(), F.raise_error(message)).otherwise(F.col("_d")))
    found = found.where("_d is not null")
    first = F.col("_d.n") if start is None else F.lit(str(start))
    more = F.lit(WINDOW - 1).cast("bigint")
    if end is not None:
        more = F.coalesce(U.distance(first, F.lit(str(end))), F.raise_error(F.concat(F.lit("too many chapters for "), F.col("url"))).cast("bigint"))
    return (
        found.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), more)))
        .withColumn("ch", U.add_to_digits(first, F.col("_k")))
        .withColumn("chapter_url", U.make_url(F.col("url"), F.col("_d"), F.col("ch")))
        .withColumn("bundle", F.concat(F.lit("chapter_"), padded(F.col("ch")), F.lit(".zip")))
        .drop("_d", "_k")
    )


def padded(n: Column) -> Column:
    """A whole number with four digits at least."""
    text = n.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(4)), "0")


def outcome(pages: Column, error: Column) -> Column:
    return F.when(error.isNotNull(), "failed").when(pages > 0, "done").otherwise("skipped")


def ledger(outcomes: DataFrame, key: str = "chapter") -> DataFrame:
    """(chapter, n_pages, n_errors, status): done with any page, failed on errors alone, else skipped."""
    pages, errors = F.count_if("ok"), F.count_if(~F.col("ok"))
    return outcomes.groupBy(key).agg(pages.alias("n_pages"), errors.alias("n_errors")).withColumn(
        "status", F.when(F.col("n_pages") > 0, "done").when(F.col("n_errors") > 0, "failed").otherwise("skipped")
    )


def require_any(results: DataFrame, keys: list[str], message: str = "every page failed") -> DataFrame:
    """Per key the counts of good and bad rows; a key whose rows all failed stops the job."""
    tally = results.groupBy(*keys).agg(F.count_if(F.col("error").isNull()).alias("good"), F.count("error").alias("bad"))
    return tally.where(F.when(F.col("good") == 0, F.raise_error(F.lit(message))).otherwise(F.lit(True)))


def run_batch(chapters: DataFrame, process: Callable[[str], tuple[str | None, int]], tasks: int | None = None) -> DataFrame:
    """Call ``process(chapter_url) -> (folder, pages)`` for every chapter; errors become rows.

    Output: (chapter_url, ch, folder, pages, error, status). Chapters are few rows of much
    work, so they are spread over ``tasks`` (by default every core) whatever their size.
    """
    tasks = tasks or chapters.sparkSession.sparkContext.defaultParallelism

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url, ch in zip(pdf["chapter_url"], pdf["ch"]):
                try:
                    folder, n = process(url)
                    rows.append((url, ch, folder, int(n), None))
                except Exception as exc:
                    rows.append((url, ch, None, 0, str(exc)))
            yield pd.DataFrame(rows, columns=["chapter_url", "ch", "folder", "pages", "error"])

    kind = chapters.schema["ch"].dataType.simpleString()
    done = chapters.select("chapter_url", "ch").repartition(tasks).mapInPandas(
        work, f"chapter_url string, ch {kind}, folder string, pages bigint, error string"
    )
    return done.withColumn("status", outcome(F.col("pages"), F.col("error")))


def elapsed(control: DataFrame, key: str = "job_id") -> DataFrame:
    """Seconds worked per job: end minus start minus pauses.

    ``control`` rows are (job, ts, kind) with kinds start, pause, resume, end. Pauses and
    resumes alternate, so the paused time is a difference of two sums and no ordering is
    needed; a job paused at its end counts until the pause.
    """
    # wide whole numbers: the sums stay exact and cannot overflow
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(20,0)")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, at)), F.lit(0).cast("decimal(30,0)"))
    open_pause = F.count_if(F.col("kind") == "pause") - F.count_if(F.col("kind") == "resume")
    end = F.max(F.when(F.col("kind") == "end", at))
    start = F.min(F.when(F.col("kind") == "start", at))
    paused = of("resume") - of("pause") + open_pause * end
    return control.groupBy(key).agg(((end - start - paused).cast("bigint") / 1_000_000).alias("seconds"))


def upsert_recent(log: DataFrame, key: str = "layout", keep: int = 30) -> DataFrame:
    """Registry after replaying a log: one row per key, newest arrival first, at most ``keep``."""
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), "arrival").alias("_r"))
    return last.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest]).orderBy(F.desc("arrival")).limit(keep)


def live(recents: DataFrame, listing: DataFrame, key: str = "layout") -> DataFrame:
    """Registry rows whose target still exists, most recent first."""
    return recents.join(listing.select(key), key, "left_semi").orderBy(F.desc("saved_at"), key)


def missing(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return required.join(present.select(key), key, "left_anti")


def labels(recents: DataFrame) -> DataFrame:
    """Display name (chapter, else the folder two above the layout file) and date text."""
    above = F.get(F.split("layout", "/"), F.size(F.split("layout", "/")) - 3)
    name = F.coalesce(F.nullif(F.col("chapter"), F.lit("")), above, F.lit(""))
    return recents.withColumn("name", name).withColumn(
        "shown", F.coalesce(F.date_format("saved_at", "MMM dd, HH:mm"), F.lit(""))
    )


def clock(seconds: Column) -> Column:
    """``mm:ss``; minutes may pass 99."""
    s = seconds.cast("bigint")
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def progress(events: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Latest state per (job, stage): done, total, share, and the stage's last time."""
    done = events.groupBy("job_id", "stage").agg(F.count("*").alias("done"), F.max("ts").alias("last_ts"))
    if totals is None:
        totals = events.groupBy("job_id").agg(F.count("*").alias("total"))
    return done.join(totals, "job_id").withColumn("share", F.round(F.col("done") / F.col("total"), 6))


# -- bundles ----------------------------------------------------------------


def bundle_files(files: DataFrame) -> DataFrame:
    """What each chapter's archive holds, in order: (chapter, archive, seq, name, size, at).

    Input: (chapter string, ch, seq bigint, name, size). ``at`` is the number of bytes before a file. Only sizes move and are
    summed in blocks along the order; an archiver reads the files themselves.
    """
    placed = running(files.select("chapter", "ch", "seq", "name", "size"), ["chapter"], "seq", {"at": F.col("size")})
    return placed.select("chapter", F.concat(F.lit("chapter_"), padded(F.col("ch")), F.lit(".zip")).alias("archive"), "seq", "name", "size", "at")
