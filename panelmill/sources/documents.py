"""JSON documents, replies, registries and crawled pages as flat tables. Schemas are fixed, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .images import folder_name

TRANSCRIPT = (
    "chapter string, lang string, pages array<struct<page:bigint,items:array<struct<"
    "n:int,kind:string,bbox:array<int>,text:string,conf:double>>>>"
)
LAYOUT = (
    "chapter string, lang string, segments array<struct<image:string,width:int,height:int,"
    "items:array<struct<n:int,bbox:array<int>,src:string,kind:string>>>>"
)
# Fields of a saved text or image box; each kind uses a part of them.
BOX_STATE = (
    "kind:string,n:int,text:string,x:double,y:double,w:double,h:double,font:string,size:double,fill:string,"
    "outline:string,outline_w:double,bold:boolean,italic:boolean,underline:boolean,align:int,rot:double,"
    "gradient_colors:array<string>,gradient_angle:double,effect:string,effect_color:string,data:string"
)
PROJECT = (
    "layout string, name string, seg_idx int, post_groups array<array<int>>, "
    f"segments array<struct<image:string,state:array<struct<{BOX_STATE}>>,work:string>>"
)
RECENT = "layout string, chapter string, thumb string, saved_at double"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source, text): whole files below ``path``."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def _parsed(texts: DataFrame, schema: str) -> DataFrame:
    """The documents in column ``text`` with the other columns beside; a text that is no such document gives no row."""
    doc = F.from_json("text", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rest = [c for c in texts.columns if c != "text"]
    rows = texts.where("text is not null").select(*rest, doc.alias("_d"))
    return rows.where("_d is not null and _d._bad is null").select(*rest, "_d.*").drop("_bad")


def _bbox():
    return [F.get("i.bbox", F.lit(k)).alias(c) for k, c in enumerate("xywh")]


def parse_transcripts(texts: DataFrame) -> DataFrame:
    """Documents in column ``text``: (chapter, lang, page, item, n, kind, x, y, w, h, text, conf); pages without items keep one row with null n."""
    docs = _parsed(texts.select("text"), TRANSCRIPT)
    pages = docs.select("chapter", "lang", F.explode("pages").alias("p")).select("chapter", "lang", "p.page", "p.items")
    return pages.select("chapter", "lang", "page", F.posexplode_outer("items").alias("item", "i")).select(
        "chapter", "lang", "page", "item", "i.n", "i.kind", *_bbox(), "i.text", "i.conf"
    )


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return parse_transcripts(read_texts(spark, path))


def parse_layouts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents in column ``text``: segments (chapter, lang, pack, image, width, height) and items (chapter, pack, n, x, y, w, h, text, kind)."""
    segs = _parsed(texts.select("text"), LAYOUT).select("chapter", "lang", F.posexplode("segments").alias("pos", "s"))
    segs = segs.select("chapter", "lang", (F.col("pos") + 1).alias("pack"), "s.*")
    items = segs.select("chapter", "pack", F.explode("items").alias("i")).select(
        "chapter", "pack", "i.n", *_bbox(), F.col("i.src").alias("text"), "i.kind"
    )
    return segs.drop("items"), items


def read_layouts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_layouts(read_texts(spark, path))


def parse_projects(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents in column ``text``, named by ``source``: projects (source, layout, name, seg_idx), their segments (source, pos, image, state, work), and post groups (source, k, lo, hi)."""
    docs = _parsed(texts.select("source", "text"), PROJECT)
    segs = docs.select("source", F.posexplode("segments").alias("pos", "s")).select("source", "pos", "s.*")
    posts = docs.select("source", F.posexplode("post_groups").alias("k", "g")).select(
        "source", "k", F.get("g", F.lit(0)).alias("lo"), F.get("g", F.lit(1)).alias("hi")
    )
    return docs.select("source", "layout", "name", "seg_idx"), segs, posts


def read_projects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return parse_projects(read_texts(spark, path))


def text_boxes(segments: DataFrame) -> DataFrame:
    """Saved text boxes of project segments, one row each."""
    return segments.select("source", "image", F.posexplode("state").alias("item", "b")).where("b.kind = 'text'").select(
        "source", "image", "item", *[f"b.{c}" for c in ("n", "text", "x", "y", "w", "h", "font", "size", "fill", "outline",
                                                         "outline_w", "bold", "italic", "underline", "align", "rot",
                                                         "gradient_colors", "gradient_angle", "effect", "effect_color")]
    )


def image_boxes(segments: DataFrame) -> DataFrame:
    """Saved image boxes of project segments with their decoded bytes."""
    return segments.select("source", "image", F.posexplode("state").alias("item", "b")).where("b.kind = 'image'").select(
        "source", "image", "item", "b.x", "b.y", "b.w", "b.h", "b.rot", F.unbase64("b.data").alias("data")
    )


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """(chapter, source, text): whole reply files; the chapter is the folder name."""
    return read_texts(spark, path).select(folder_name(F.col("source")).alias("chapter"), "source", "text")


def parse_recents(texts: DataFrame) -> DataFrame:
    """Registries in column ``text`` as rows (layout, chapter, thumb, saved_at timestamp, arrival); a corrupt one gives none.

    ``arrival`` grows toward the front of the list, as the newest entry comes first.
    """
    rows = F.from_json("text", f"array<struct<{RECENT.replace(' string', ':string').replace(' double', ':double')}>>")
    return texts.select(F.posexplode(rows).alias("pos", "r")).where("r.layout is not null").select(
        "r.layout", F.coalesce("r.chapter", F.lit("")).alias("chapter"), F.coalesce("r.thumb", F.lit("")).alias("thumb"),
        F.timestamp_micros((F.col("r.saved_at") * 1_000_000).cast("bigint")).alias("saved_at"),
        (-F.col("pos")).cast("bigint").alias("arrival"),
    )


def read_recents(spark: SparkSession, path: str) -> DataFrame:
    return parse_recents(read_texts(spark, path))


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawled pages (page_id, url, html)."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def route_sources(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split job inputs (column ``source``) into addresses and folders."""
    from ..functions.urls import is_url

    return sources.where(is_url(F.col("source"))), sources.where(~is_url(F.col("source")))
