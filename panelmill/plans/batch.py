"""From chapter addresses to finished chapters: all chapters of a batch at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import jobs as J, links as K
from ..functions.urls import host_moved, name_from_url, safe_name


def plan_batch(sources: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Chapter addresses with their output folder and bundle name."""
    spread = J.expand_batch(sources, start, end)
    return spread.withColumn("folder", safe_name(name_from_url(F.col("chapter_url"))))


def acquire(crawled: DataFrame, *more_tiers: DataFrame, min_pages: int = 3) -> tuple[DataFrame, DataFrame]:
    """Page images per crawled chapter and the ledger of outcomes.

    ``crawled`` holds (page_id, url, final_url, html). Pages that were redirected to another
    host fail. ``more_tiers`` are link tables (page_id, pos, img) of other download ways;
    the first tier with enough pages wins.
    """
    moved = host_moved(F.col("url"), F.col("final_url"))
    tiers = [K.page_urls(crawled.where(~moved)), *more_tiers]
    found = K.ordered_union(*tiers)
    attempts = found.select(F.col("page_id").alias("chapter"), F.col("src_rank").alias("tier"), F.lit(True).alias("ok"))
    chosen = K.choose_tier(attempts, min_pages)
    pages = found.join(
        chosen.select(F.col("chapter").alias("page_id"), F.col("tier").alias("src_rank")), ["page_id", "src_rank"], "left_semi"
    )
    ledger = (
        crawled.select(F.col("page_id").alias("chapter"), moved.alias("moved"))
        .join(chosen, "chapter", "left")
        .select(
            "chapter", F.coalesce("n_pages", F.lit(0)).alias("n_pages"),
            F.when(F.col("moved"), F.lit("site redirected to another host")).alias("error"),
        )
        .withColumn("status", J.outcome(F.col("n_pages"), F.when(F.col("n_pages") == 0, F.col("error"))))
    )
    return pages, ledger
