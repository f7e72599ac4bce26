"""Text items: script routing, numbering, filling in translations, post groups, exports as ordered lines.

Documents are produced as ordered *lines* (one row each), never as one cell per chapter,
so a chapter of any size stays spread over tasks. ``write_lines`` puts them in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import (
    flag_names, has_script, js_escape, KHMER, numbered_lines, parse_posts, script_ratio, strip, strip_names,
)
from .ordering import block, look_up, ordinal, running, split_hot

# What counts as Hangul text, and the least confidence for it on an English page.
HANGUL_SHARE = 0.3
HANGUL_CONF = 0.3

# Request texts that head an export.
TRANSCRIPT_PROMPT = (
    "Translate each numbered line below into natural Khmer for a manhwa. "
    "Keep the numbers and the [bubble]/[sfx] tags, one line each. "
    "Wrap proper nouns (character names, place names, special terms and skill names) "
    "in **double asterisks** in the Khmer output — e.g. **រ៉ានីយ៉ា** or **ព្រះអង្គ**. "
    "Do NOT wrap common words, only names and unique terms."
)
CLIPBOARD_PROMPT = (
    "Translate each numbered line below into natural Khmer for a manhwa. "
    "Keep the numbers and the [bubble]/[sfx] tags, one line each.\n\n"
    "Then, on a final line, group the bubbles into Facebook posts — each "
    "post a coherent emotional beat that ends on a little hook when it can "
    "— as:\n"
    "POSTS: 1-4 | 5-9 | 10-13\n\n"
)


def route_script(df: DataFrame, lang: str = "en") -> DataFrame:
    """Choose between two readings (en_text, en_conf, ko_text, ko_conf): kind, text, conf, script."""
    if lang not in ("en", "ko"):
        raise ValueError(f"unsupported language: {lang}")
    hangul = script_ratio(F.col("ko_text")) > HANGUL_SHARE
    if lang == "en":
        hangul = hangul & (F.col("ko_conf") >= HANGUL_CONF)
    kinds = ("sfx", "dialogue") if lang == "en" else ("dialogue", "sfx")
    ko = F.col("_hangul")
    routed = df.withColumn("_hangul", hangul)
    return routed.select(
        *df.columns,
        F.when(ko, kinds[0]).otherwise(kinds[1]).alias("kind"),
        strip(F.when(ko, F.col("ko_text")).otherwise(F.col("en_text"))).alias("text"),
        F.when(ko, F.col("ko_conf")).otherwise(F.col("en_conf")).alias("conf"),
        F.when(ko, "hangul").otherwise("latin").alias("script"),
    )


def _page_offsets(items: DataFrame, key: str, page: str) -> DataFrame:
    """(chapter, page, _off): items of the chapter before each page. Only page totals are summed up."""
    totals = items.groupBy(key, page).agg(F.count("*").alias("_c"))
    return running(totals, [key], page, {"_off": F.col("_c")}).select(key, page, "_off")


def number_items(
    items: DataFrame, order: list[str] | None = None, key: str = "chapter", page: str = "page", limit: int = 1 << 17
) -> DataFrame:
    """Chapter-wide item number ``n`` from 1 in (page, y, x, input position) order; pages are integers.

    Items are ranked inside their page only. A page of more than ``limit`` items is ranked
    by range, so neither a long chapter nor a crowded page lands in one task.
    """
    order, offsets = order or ["y", "x", "item"], _page_offsets(items, key, page)
    small, hot = split_hot(items, [key, page], limit)
    place = F.row_number().over(Window.partitionBy(key, page).orderBy(*order)).cast("bigint")
    ranked = small.withColumn("_r", place).join(offsets, [key, page])
    if hot is not None:
        ranked = ranked.unionByName(look_up(ordinal(hot, [key, page], order, "_r"), offsets, [key, page], block("_r")))
    return ranked.withColumn("n", F.col("_off") + F.col("_r")).drop("_off", "_r")


def number_items_by_page(items: DataFrame, key: str = "chapter", page: str = "page", pos: str = "item") -> DataFrame:
    """The same number when ``pos`` is already the place in the page, dense from 0."""
    return look_up(items, _page_offsets(items, key, page), [key, page], block(pos)).withColumn(
        "n", F.col("_off") + F.col(pos) + 1
    ).drop("_off")


# -- replies ----------------------------------------------------------------


def parse_numbered(replies: DataFrame, key: str = "chapter", text: str = "text", seq: str | None = None) -> DataFrame:
    """(chapter, n, text) of numbered reply lines; for a repeated number the last line wins.

    ``seq`` orders several replies of one chapter.
    """
    order = F.struct(F.col(seq), F.col("r.pos")) if seq else F.col("r.pos")
    rows = replies.select(key, *([seq] if seq else []), F.explode_outer(numbered_lines(F.col(text))).alias("r")).where("r is not null")
    return rows.groupBy(key, F.col("r.n").alias("n")).agg(F.max_by("r.text", order).alias("text"))


def posts_of(replies: DataFrame, key: str = "chapter", text: str = "text") -> DataFrame:
    """(chapter, k, lo, hi): post groups of each reply in order."""
    return replies.select(key, F.posexplode_outer(parse_posts(F.col(text))).alias("k", "p")).where("p is not null").select(
        key, "k", "p.lo", "p.hi"
    )


def _by_number(items: DataFrame, table: DataFrame, how: str, key: str) -> DataFrame:
    """Join on (chapter, n), where the table's ``_n`` is a number written as text."""
    other = table.withColumnRenamed(key, "_key")
    return items.join(other, (items[key] == other["_key"]) & (items["n"].cast("string") == other["_n"].cast("string")), how).drop("_key")


def fill(items: DataFrame, table: DataFrame, how: str = "left", key: str = "chapter") -> DataFrame:
    """Join translated lines by number.

    ``inner`` keeps matched items only; ``left`` keeps the old text where nothing matches.
    Adds ``filled`` and ``styled`` (a name marker was present: bold and italic).
    """
    new = table.select(key, F.col("n").alias("_n"), F.col("text").alias("_raw"))
    joined = _by_number(items, new, how, key).drop("_n")
    matched = F.col("_raw").isNotNull()
    return (
        joined.withColumn("text", F.when(matched, strip_names(F.col("_raw"))).otherwise(F.col("text")))
        .withColumn("filled", matched)
        .withColumn("styled", F.coalesce(flag_names(F.col("_raw")), F.lit(False)))
        .drop("_raw")
    )


def cut_after(boxes: DataFrame, posts: DataFrame, key: str = "chapter") -> DataFrame:
    """Boxes whose number ends any post but the chapter's last one."""
    last = posts.groupBy(key).agg(F.max("k").alias("_last"))
    ends = posts.join(last, key).where("k < _last").select(key, F.col("hi").alias("_n")).distinct()
    return _by_number(boxes, ends, "left_semi", key)


def is_translated(canvases: DataFrame, items: DataFrame, keys: list[str], blocks=KHMER) -> DataFrame:
    """Add ``translated``: no text boxes at all, or any box in the target script."""
    flags = items.groupBy(*keys).agg(F.bool_or(has_script(F.col("text"), blocks)).alias("_any"))
    return canvases.join(flags, keys, "left").withColumn("translated", F.coalesce("_any", F.lit(True))).drop("_any")


def route_export(canvases: DataFrame, image: str = "image") -> DataFrame:
    """Destination and file name per canvas; only translated ones go on to the book."""
    done = F.col("translated")
    return canvases.withColumn("status", F.when(done, "translated").otherwise("clean_untranslated")).withColumn(
        "target", F.concat(F.when(done, "").otherwise("clean_untranslated/"), F.regexp_replace(image, "\\.png", "_kh.png"))
    ).withColumn("in_book", done)


def project_merge(layout: DataFrame, saved: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """Bring saved segment states back onto a layout: last saved wins, the rest stay as they are.

    A saved row whose state is null, an empty list or an empty text says nothing and leaves an older one in force.
    """
    state = [c for c in saved.columns if c not in (*keys, arrival)]
    said = F.lit(False)
    for c in state:
        kind = saved.schema[c].dataType.typeName()
        full = F.size(c) > 0 if kind == "array" else F.col(c) != "" if kind == "string" else F.col(c).isNotNull()
        said = said | F.coalesce(full, F.lit(False))
    last = saved.where(said).groupBy(*keys).agg(F.max_by(F.struct(*state), arrival).alias("_s"))
    return layout.join(last, keys, "left").select(layout["*"], *[F.col(f"_s.{c}").alias(c) for c in state])


def clamp_index(index: Column, count: Column) -> Column:
    """A saved canvas index brought into the canvases there are; 0 when there are none."""
    return F.greatest(F.lit(0), F.least(F.coalesce(index, F.lit(0)), count - 1))


# -- exports as lines -------------------------------------------------------


def _line(df: DataFrame, keys: list[str], part: int, text: Column, page: Column | None = None, n: Column | None = None):
    zero = F.lit(0).cast("bigint")
    return df.select(
        *keys,
        F.lit(part if page is None else 1).alias("part"),
        (zero if page is None else page.cast("bigint")).alias("page"),
        F.lit(part).alias("sub"),
        (zero if n is None else n.cast("bigint")).alias("n"),
        text.alias("line"),
    )


LINE_ORDER = ["part", "page", "sub", "n"]


def _stack(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def transcript_lines(items: DataFrame, lang: str = "en", prompt: str = TRANSCRIPT_PROMPT, key: str = "chapter", pages: DataFrame | None = None) -> DataFrame:
    """Lines of the transcript text: title, quoted prompt, per page a heading, its items and a blank.

    ``pages`` (chapter, page) adds headings for pages without items.
    """
    pages = (items if pages is None else pages).select(key, "page").distinct()
    chapters = pages.select(key).distinct()
    name = F.col(key).cast("string")
    head = F.concat(F.lit("# "), name, F.lit(f" — transcript ({lang})\n\n> {prompt}\n"))
    item = F.concat(F.col("n").cast("string"), F.lit(". ["), F.col("kind"), F.lit("] "), F.col("text"))
    return _stack([
        _line(chapters, [key], 0, head),
        _line(pages, [key], 1, F.concat(F.lit("## Page "), F.col("page").cast("string")), F.col("page")),
        _line(items, [key], 2, item, F.col("page"), F.col("n")),
        _line(pages, [key], 3, F.lit(""), F.col("page")),
    ])


def prompt_lines(items: DataFrame, key: str = "chapter") -> DataFrame:
    """Lines of the translation request: the prompt, then every item by number."""
    line = F.concat(F.col("n").cast("string"), F.lit(". ["), F.col("kind"), F.lit("] "), F.col("text"))
    return _stack([
        _line(items.select(key).distinct(), [key], 0, F.lit(CLIPBOARD_PROMPT.rstrip("\n") + "\n")),
        _line(items, [key], 1, line, F.lit(0), F.col("n")),
    ])


def with_neighbours(items: DataFrame, key: str, of: str, bits: int = 16) -> DataFrame:
    """Add ``_before`` and ``_after``: ``of`` of the item before and after by ``n`` inside the key, null where there is none.

    Neighbours are found inside blocks of the order; across borders only a block's first and last item are looked at. Numbers may have gaps.
    """
    edges = items.groupBy(key, block("n", bits).alias("_blk")).agg(F.min_by(of, "n").alias("_first"), F.max_by(of, "n").alias("_last"))
    outer, inner = Window.partitionBy(key).orderBy("_blk"), Window.partitionBy(key, "_blk").orderBy("n")
    edges = edges.select(key, "_blk", F.lag("_last").over(outer).alias("_up"), F.lead("_first").over(outer).alias("_down"))
    met = items.withColumn("_blk", block("n", bits)).join(edges, [key, "_blk"])
    met = met.withColumn("_before", F.coalesce(F.lag(of).over(inner), F.col("_up"))).withColumn("_after", F.coalesce(F.lead(of).over(inner), F.col("_down")))
    return met.drop("_blk", "_up", "_down")


def _lines_of(rows: DataFrame, key: str, page: str, lines: list[tuple[Column, int, bool, bool, Column]]) -> DataFrame:
    """Lines (when, sub, on a page, of an item, text) of each row, by one explode."""
    zero = F.lit(0).cast("bigint")
    parts = [
        F.when(when, F.struct(
            F.lit(1 if paged else sub).alias("part"), (F.col(page).cast("bigint") if paged else zero).alias("page"), F.lit(sub).alias("sub"),
            (F.col("n").cast("bigint") if single else zero).alias("n"), text.alias("line"),
        ))
        for when, sub, paged, single, text in lines
    ]
    return rows.select(key, F.explode(F.array_compact(F.array(*parts))).alias("l")).select(key, "l.*")


def transcript_json_lines(items: DataFrame, lang: str = "en", key: str = "chapter") -> DataFrame:
    """Lines that, in order, form one JSON document per chapter: {chapter, lang, pages:[{page, items:[…]}]}.

    An item's neighbours say where pages and the document start and end; one explode gives its lines.
    """
    body = F.to_json(F.struct("n", "kind", F.array("x", "y", "w", "h").alias("bbox"), "text", "conf"))
    rows = with_neighbours(items.select(key, "n", "page", body.alias("_body")), key, "page")
    first, last = F.col("_before").isNull(), F.col("_after").isNull()
    opens, closes = first | (F.col("_before") != F.col("page")), last | (F.col("_after") != F.col("page"))
    comma = lambda at: F.when(at, "").otherwise(",")
    quoted = F.to_json(F.array(F.col(key).cast("string")))
    head = F.concat(F.lit('{"chapter": '), quoted.substr(F.lit(2), F.length(quoted) - 2), F.lit(f', "lang": "{lang}", "pages": ['))
    return _lines_of(rows, key, "page", [
        (first, 0, False, False, head),
        (opens, 1, True, False, F.concat(comma(first), F.lit('{"page": '), F.col("page").cast("string"), F.lit(', "items": ['))),
        (F.lit(True), 2, True, True, F.concat(comma(opens), F.col("_body"))),
        (closes, 3, True, False, F.lit("]}")),
        (last, 4, False, False, F.lit("]}")),
    ])


def layout_json_lines(segments: DataFrame, items: DataFrame, lang: str = "en", key: str = "chapter") -> DataFrame:
    """Lines of one layout document per chapter: {chapter, lang, segments:[{image, width, height, items:[…]}]}.

    What opens and closes the document comes from the few segments, commas between items from their neighbours.
    """
    segs = segments.select(key, F.struct("pack", "image", "width", "height").alias("s")).groupBy(key).agg(F.min("s.pack").alias("_p"), F.max("s.pack").alias("_z"))
    segs = segments.join(segs, key)
    body = F.to_json(F.struct("n", F.array("x", "y", "w", "h").alias("bbox"), F.col("text").alias("src"), "kind"))
    rows = with_neighbours(items.select(key, "n", "pack", body.alias("_body")), key, "pack")
    opens = F.col("_before").isNull() | (F.col("_before") != F.col("pack"))
    quoted = F.to_json(F.struct(F.col(key).cast("string").alias("chapter"), F.lit(lang).alias("lang")))
    head = F.concat(F.regexp_replace(quoted, "\\}$", ""), F.lit(',"segments": ['))
    seg = F.regexp_replace(F.to_json(F.struct("image", "width", "height")), "\\}$", "")
    comma = lambda at: F.when(at, "").otherwise(",")
    around = _lines_of(segs.withColumn("n", F.lit(0)), key, "pack", [
        (F.col("pack") == F.col("_p"), 0, False, False, head),
        (F.lit(True), 1, True, False, F.concat(comma(F.col("pack") == F.col("_p")), seg, F.lit(',"items": ['))),
        (F.lit(True), 3, True, False, F.lit("]}")),
        (F.col("pack") == F.col("_z"), 4, False, False, F.lit("]}")),
    ])
    return around.unionByName(_lines_of(rows, key, "pack", [(F.lit(True), 2, True, True, F.concat(comma(opens), F.col("_body")))]))


def project_lines(segments: DataFrame, key: str = "chapter") -> DataFrame:
    """Lines of one saved project per chapter: {layout, name, seg_idx, post_groups, segments:[{image, state, work}]}.

    Input: one row per segment with (chapter, pos, layout, name, seg_idx, post_groups, image, state, differs). The work image is named
    only where it differs from the original. A segment is a line of its own, so a project may have any number of them.
    """
    work = F.when(F.col("differs"), F.concat(F.regexp_replace("image", "(?<=[^.])\\.[^.]*$", ""), F.lit("_work.png")))
    first = segments.groupBy(key, "layout", "name", "seg_idx", "post_groups").agg(F.min("pos").alias("_p"))
    head = F.concat(F.regexp_replace(F.to_json(F.struct("layout", "name", "seg_idx", "post_groups")), "\\}$", ""), F.lit(',"segments":['))
    rows = segments.join(first.select(key, "_p"), key)
    body = F.to_json(F.struct("image", "state", work.alias("work")))
    return _stack([
        _line(first, [key], 0, head),
        _line(rows, [key], 2, F.concat(F.when(F.col("pos") == F.col("_p"), "").otherwise(","), body), F.col("pos")),
        _line(first, [key], 4, F.lit("]}")),
    ])


def page_script_lines(
    items: DataFrame, table: DataFrame, header: str, kinds=("bubble", "sfx"), key: str = "chapter"
) -> DataFrame:
    """Lines of one script per page: the caller's header, then one call per translated item.

    The header opens the document and defines ``addText(text, x, y, w, h, name)`` for the program that will run it. A page without a match keeps its header. Items without text are left out.
    """
    pages = items.select(key, "page").distinct()
    hit = fill_raw(items.where(F.col("kind").isin(*kinds)), table, key)
    call = F.concat(
        F.lit('addText("'), js_escape(F.col("new_text")), F.lit('", '),
        F.concat_ws(", ", "x", "y", "w", "h"),
        F.lit(', "kh_'), F.col("n").cast("string"), F.lit("_"), F.col("kind"), F.lit('");'),
    )
    return _stack([
        _line(pages, [key], 1, F.lit(header), F.col("page")),
        _line(hit, [key], 2, call, F.col("page"), F.col("n")),
    ])


def fill_raw(items: DataFrame, table: DataFrame, key: str = "chapter") -> DataFrame:
    """Inner join by number that keeps markers as they are, in ``new_text``."""
    new = table.select(key, F.col("n").alias("_n"), F.col("text").alias("new_text"))
    return _by_number(items, new, "inner", key).drop("_n").where("new_text <> ''")


def script_counts(items: DataFrame, table: DataFrame, kinds=("bubble", "sfx"), key: str = "chapter") -> DataFrame:
    """(chapter, page, script, layers): one script per page with the number of layers it adds."""
    hit = fill_raw(items.where(F.col("kind").isin(*kinds)), table, key).groupBy(key, "page").agg(F.count("*").alias("layers"))
    return (
        items.select(key, "page").distinct().join(hit, [key, "page"], "left")
        .withColumn("layers", F.coalesce("layers", F.lit(0)))
        .withColumn("script", F.format_string("page_%03d.jsx", F.col("page")))
    )


def write_lines(lines: DataFrame, path: str, keys: list[str], partitions: int | None = None) -> None:
    """Write ordered lines as text, one folder per key; stale files are replaced.

    Rows are range-partitioned by (keys, order): a long document becomes several part
    files whose names sort in reading order.
    """
    by = [F.col(c) for c in (*keys, *LINE_ORDER)]
    laid = lines.repartitionByRange(partitions, *by) if partitions else lines.repartitionByRange(*by)
    laid.sortWithinPartitions(*by).select(*keys, F.col("line").alias("value")).write.mode("overwrite").partitionBy(
        *keys
    ).text(path)
