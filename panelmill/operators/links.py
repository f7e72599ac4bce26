"""Page-image links: from crawled HTML to the ordered list of a chapter's images.

A crawled page is one row, and its link list is bounded by that row, so extraction,
dedupe and grouping stay inside the row: no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import urls as U
from ..functions.text import LINE_END, natural_key, strip
from .ordering import rank_rows


def _numbered(df: DataFrame, keep: list[str], urls: Column, name: str = "img") -> DataFrame:
    """One row per list entry, numbered from 1.

    The outer form keeps the optimizer from repeating the whole list expression in a
    "list is not empty" filter below the explode.
    """
    rows = df.select(*keep, F.posexplode_outer(urls).alias("pos", name)).where("pos is not null")
    return rows.withColumn("pos", F.col("pos") + 1)


def page_links(pages: DataFrame, tag: str = "a", attribute: str = "href") -> DataFrame:
    """(page_id, pos, raw, link): a tag's attribute in document order, resolved against the page."""
    based = pages.select("page_id", U.base_parts(F.col("url")).alias("base"), "html")
    tags = _numbered(based, ["page_id", "base"], U.extract_tags(F.col("html"), tag), "tag")
    raw = U.attr(F.col("tag"), attribute)
    return tags.select("page_id", "pos", "base", raw.alias("raw")).where("raw <> ''").select(
        "page_id", "pos", "raw", U.join_parts(F.col("base"), strip(F.col("raw"))).alias("link")
    )


def _found(pages: DataFrame) -> DataFrame:
    """Row-local candidate lists: ``reader`` (marked page images) and ``loose`` (all tags, then script text)."""
    based = pages.select("page_id", "html", U.base_parts(F.col("url")).alias("base"))
    tagged = based.select(
        "page_id", "html",
        F.transform(
            U.extract_tags(F.col("html"), "img"),
            lambda t: F.struct(U.is_reader_img(t).alias("reader"), U.pick_attr(t, F.col("base")).alias("u")),
        ).alias("tags"),
    )
    good = lambda urls: F.array_distinct(F.filter(urls, lambda u: u.isNotNull() & U.is_image_url(u)))
    return tagged.select(
        "page_id",
        good(F.transform(F.filter("tags", lambda t: t.reader), lambda t: t.u)).alias("reader"),
        good(F.concat(F.transform("tags", lambda t: t.u), U.extract_urls(F.col("html")))).alias("loose"),
    )


def page_urls(pages: DataFrame) -> DataFrame:
    """Ordered page images (page_id, pos, img) of crawled pages.

    Marked reader images win; otherwise all image tags and script addresses, reduced to
    the fullest directory. A page without candidates gives no rows.
    """
    found = _found(pages)
    chosen = F.when(F.size("reader") > 0, F.col("reader")).otherwise(U.largest_group(F.col("loose"), 3, 3))
    return _numbered(found.select("page_id", chosen.alias("_u")), ["page_id"], F.col("_u"))


def loose_urls(pages: DataFrame) -> DataFrame:
    """All distinct image candidates in first-seen order, before grouping."""
    return _numbered(_found(pages), ["page_id"], F.col("loose"))


def require_urls(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """Pages that gave no image at all, with the message a caller raises or reports."""
    return pages.select("page_id", "url").join(urls.select("page_id"), "page_id", "left_anti").withColumn(
        "error", F.lit("no page images found on that address")
    )


def rendered_urls(seen: DataFrame, key: str = "page_id") -> DataFrame:
    """The rendered-page rule over lists ``dom``, ``srcset``, ``api`` and ``net`` (array<string> each).

    Every source is reduced to its fullest directory (at least two, else all). The first of
    dom and api with three pages wins, else the longest, the earlier on ties.
    """
    http = lambda a: F.filter(a, lambda u: u.startswith("http"))
    group = lambda a: U.largest_group(
        F.array_distinct(F.filter(a, lambda u: (u != "") & U.looks_like_page(u))), 2, 0
    )
    picked = seen.select(
        key,
        group(http(F.concat("dom", "srcset"))).alias("dom"), group(http(F.col("api"))).alias("api"), group(F.col("net")).alias("net"),
    )
    d, a, n = F.size("dom"), F.size("api"), F.size("net")
    best = (
        F.when(d >= 3, F.col("dom")).when(a >= 3, F.col("api"))
        .when((d >= a) & (d >= n), F.col("dom")).when(a >= n, F.col("api")).otherwise(F.col("net"))
    )
    return _numbered(picked.select(key, best.alias("_u")), [key], F.col("_u"))


def ordered_union(*sources: DataFrame, pos: str = "pos") -> DataFrame:
    """Stack sources in rank order: rows carry ``src_rank`` ahead of their own position."""
    out = None
    for rank, df in enumerate(sources):
        df = df.withColumn("src_rank", F.lit(rank))
        out = df if out is None else out.unionByName(df)
    return out


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in the given order, as an aggregate (partial per task, so hot keys are cheap)."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def largest_group(urls: DataFrame, key: str, min_best: int = 3, keep_if_at_least: int = 3) -> DataFrame:
    """The fullest-directory rule over a link *table* (key, pos, img), for lists that are not one row.

    The links of a page's directory become one row before directories are compared, so a page is read and shuffled once.
    """
    dirs = urls.groupBy(key, U.directory(F.col("img")).alias("_dir")).agg(
        F.count("*").alias("_c"), F.min("pos").alias("_p"), F.collect_list(F.struct(*[c for c in urls.columns if c != key])).alias("_rows")
    )
    page = Window.partitionBy(key)
    best = F.max(F.struct("_c", (-F.col("_p")).alias("q"), "_dir")).over(page)
    ranked = dirs.withColumn("_best", best).withColumn("_all", F.sum("_c").over(page))
    keep_all = (F.col("_best._c") < min_best) & (F.col("_all") >= keep_if_at_least)
    kept = ranked.where(keep_all | F.col("_dir").eqNullSafe(F.col("_best._dir")))
    return kept.select(key, F.explode("_rows").alias("_r")).select(*[F.col(c) if c == key else F.col(f"_r.`{c}`") for c in urls.columns])


def choose_tier(attempts: DataFrame, min_pages: int = 3, key: str = "chapter") -> DataFrame:
    """(chapter, tier, n_pages): the first tier with enough pages, else the longest (earliest on ties).

    Failed rows count nothing; a chapter without any page has a null tier.
    """
    sizes = attempts.groupBy(key, "tier").agg(F.count_if("ok").alias("c"))
    few = F.col("c") < min_pages
    rank = F.struct(few.alias("few"), F.when(few, -F.col("c")).otherwise(0).alias("less"), "tier")
    best = sizes.groupBy(key).agg(F.min_by(F.struct("tier", "c"), rank).alias("b"))
    some = F.col("b.c") > 0
    return best.select(key, F.when(some, F.col("b.tier")).alias("tier"), F.col("b.c").alias("n_pages"))


def order_from_log(logs: DataFrame, key: str = "chapter") -> DataFrame:
    """(chapter, pos, file): page order from a download tool's log, one row per log text.

    Lines lose ``# `` and quotes; only image names count; a repeated name keeps its first place.
    """
    cleaned = F.transform(
        F.split("log", LINE_END),
        lambda line: F.btrim(strip(F.ltrim(strip(line), F.lit("# "))), F.lit('"')),
    )
    files = F.array_distinct(F.filter(cleaned, lambda f: U.has_ext(f, U.FOLDER_EXTS)))
    return _numbered(logs, [key], files, "file")


def order_files(logs: DataFrame, listing: DataFrame, key: str = "chapter") -> DataFrame:
    """(chapter, pos, file): the files that are there, in the order of the download tool's log.

    ``listing`` (chapter, file) holds the paths found. A logged name means the file at that path or else the one with that base
    name; what is not there is left out. A chapter without any hit falls back to the natural order of its file names.
    """
    base = lambda c: F.substring_index(c, "/", -1)
    there = listing.select(key, F.col("file").alias("_path"), base(F.col("file")).alias("_base")).distinct()
    named = order_from_log(logs, key).withColumn("_base", base(F.col("file")))
    hits = named.join(there, [key, "_base"]).groupBy(key, "pos").agg(
        F.min_by("_path", F.struct((F.col("_path") != F.col("file")).alias("other"), "_path")).alias("file")
    )
    first = hits.groupBy(key, "file").agg(F.min("pos").alias("_at"))
    told = rank_rows(first, [key], ["_at"], "pos").select(key, "pos", "file")
    rest = there.join(told.select(key).distinct(), key, "left_anti").withColumn("_k", natural_key(F.col("_base")))
    return told.unionByName(rank_rows(rest, [key], ["_k", "_path"], "pos").select(key, "pos", F.col("_path").alias("file")))


def output_names(urls: DataFrame, strict: bool = False) -> DataFrame:
    """Download target of every link: three digits and the link's suffix."""
    return urls.withColumn("name", F.concat(F.format_string("%03d", F.col("pos")), U.url_ext(F.col("img"), strict)))
