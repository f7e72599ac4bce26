"""Column functions over URLs and HTML. All work inside one row: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let, strip

# The generic URI grammar's splitting pattern: scheme, authority, path, query, fragment.
URI = "^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?(//([^/?#]*))?([^?#]*)(\\?([^#]*))?(#(.*))?"

# Image file suffixes by use.
PAGE_EXTS = ("jpg", "jpeg", "png", "webp", "gif")
FOLDER_EXTS = ("jpg", "jpeg", "png", "webp", "gif", "bmp")
SPLIT_EXTS = ("jpg", "jpeg", "png", "webp", "bmp")
# Image attributes in order of preference.
IMAGE_ATTRS = ("data-src", "data-original", "data-lazy-src", "data-url", "src")
# Parts of a URL that mark decoration.
SKIP_HINTS = ("/covers/", "/cover/", "avatar", "logo", "favicon", "icon", "banner")
# Resized thumbnails, and image addresses inside any text.
THUMB = "(?i)-\\d+x\\d+\\.(?:jpg|jpeg|png|webp|gif)$"
IN_TEXT = "(?i)https?://[^\\s\"'<>]+?\\.(?:jpg|jpeg|png|webp)"
IN_TEXT_QUERY = IN_TEXT + "(?:\\?[^\\s\"'<>]*)?"
# Query keys that name a chapter.
NAME_KEYS = ("wr_id", "is", "id")
# Where a chapter number sits in a URL, by priority (prefix, digits, what follows).
CHAPTER_PATTERNS = (
    ("chapter[-_/]", ""),
    ("-ep[-_]?", ""),
    ("/ep[-_]?", ""),
    ("[?&]ch(?:apter)?=", ""),
    ("/c", "(?:[/\\-_]|$)"),
)


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, URI, 1))


def host(u: Column) -> Column:
    """Host with port, as written."""
    return F.regexp_extract(u, URI, 3)


def path(u: Column) -> Column:
    """Path without the parameters that may follow its last part after a semicolon."""
    return F.regexp_replace(F.regexp_extract(u, URI, 4), ";[^/]*$", "")


def query_string(u: Column) -> Column:
    return F.regexp_extract(u, URI, 6)


def is_url(c: Column) -> Column:
    return F.lower(strip(c)).rlike("^https?://")


def has_ext(name: Column, exts) -> Column:
    return name.rlike("(?i)\\.(?:" + "|".join(exts) + ")$")


def safe_name(c: Column) -> Column:
    """A file-system name: odd runs become ``_``, at most 80 characters, never empty."""
    clean = F.regexp_replace(c, "[^\\p{L}\\p{N}_.\\- ]+", "_")
    clean = F.left(F.btrim(strip(clean), F.lit(".")), F.lit(80))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("chapter"))


def query_value(u: Column, key: str) -> Column:
    raw = F.replace(F.regexp_extract(query_string(u), f"(?:^|&){key}=([^&]+)", 1), F.lit("+"), F.lit(" "))
    return F.nullif(F.coalesce(F.try_url_decode(raw), raw), F.lit(""))


def name_from_url(u: Column) -> Column:
    named = [F.concat(F.lit("chapter_"), query_value(u, k)) for k in NAME_KEYS]
    last = F.element_at(F.split(F.rtrim(path(u), F.lit("/")), "/"), -1)
    return F.coalesce(*named, F.nullif(last, F.lit("")), F.lit("chapter"))


# digits that are added up as a number; those before them only take a carry
LOW = 18


def whole(digits: Column) -> Column:
    """A run of ASCII digits without leading zeros."""
    return F.regexp_replace(digits, "^0+(?=[0-9])", "")


def _one_more(digits: Column) -> Column:
    """The next whole number: the last digit that is no nine goes up, nines behind it turn to zero."""
    nines = F.length(digits) - F.length(F.rtrim(digits, F.lit("9")))
    kept = F.left(digits, F.length(digits) - nines)
    last = F.when(kept == "", "1").otherwise((F.right(kept, F.lit(1)).cast("int") + 1).cast("string"))
    return F.concat(F.left(kept, F.greatest(F.length(kept) - 1, F.lit(0))), last, F.repeat(F.lit("0"), nines))


def add_to_digits(digits: Column, k: Column) -> Column:
    """A whole number of any length, as digits, plus a number from 0 to 10 ** 18 - 1."""
    low = F.right(digits, F.lit(LOW)).cast("decimal(38,0)") + k.cast("decimal(38,0)")
    high = F.left(digits, F.greatest(F.length(digits) - LOW, F.lit(0)))
    top = F.lit(10**LOW)
    kept = F.lpad(F.when(low >= top, low - top).otherwise(low).cast("decimal(19,0)").cast("string"), LOW, "0")
    return whole(F.concat(F.when(low >= top, F.when(high == "", "1").otherwise(_one_more(high))).otherwise(high), kept))


def distance(a: Column, b: Column) -> Column:
    """How far the whole number b lies above a (both digits of any length), at least 0; null from 10 ** 18 on."""
    size = F.greatest(F.length(a), F.length(b), F.lit(LOW))
    return let(
        F.struct(F.lpad(a, size, "0").alias("a"), F.lpad(b, size, "0").alias("b")),
        lambda p: let(
            F.struct(
                F.left(p.a, F.length(p.a) - LOW).alias("ha"), F.left(p.b, F.length(p.b) - LOW).alias("hb"),
                (F.right(p.b, F.lit(LOW)).cast("bigint") - F.right(p.a, F.lit(LOW)).cast("bigint")).alias("low"),
            ),
            lambda q: F.when(p.b <= p.a, F.lit(0).cast("bigint")).when(q.ha == q.hb, q.low)
            .when((_one_more(q.ha) == q.hb) & (q.low < 0), q.low + 10**LOW),
        ),
    )


def detect_chapter(u: Column) -> Column:
    """struct<n, start, stop> of the chapter number in a URL (0-based span), or null; ``n`` is its digits without leading zeros, however many."""

    def found(match: Column) -> Column:
        digits = match.digits
        start = F.length(match.before)
        return F.when(
            digits != "",
            F.struct(
                whole(digits).alias("n"),
                start.alias("start"),
                (start + F.length(digits)).alias("stop"),
            ),
        )

    def attempt(pattern: str) -> Column:
        return let(
            F.struct(
                F.regexp_extract(u, pattern, 1).alias("before"),
                F.regexp_extract(u, pattern, 2).alias("digits"),
            ),
            found,
        )

    ladder = [attempt(f"(?is)^(.*?{lead})(\\d+){tail}") for lead, tail in CHAPTER_PATTERNS]
    tail = let(
        attempt("(?s)^([^?#]*[^?#\\d])(\\d{1,4})[^\\d?#]*(?:[?#]|$)"),
        lambda m: F.when(m.n != "0", m),
    )
    return F.coalesce(*ladder, tail)


def make_url(u: Column, span: Column, n: Column) -> Column:
    """Put chapter ``n`` where the detected number stood."""
    return F.concat(
        F.left(u, span["start"]), n.cast("string"), F.substring(u, span["stop"] + F.lit(1), F.length(u))
    )


def _resolve_path(base: Column, ref: Column) -> Column:
    """Merge a reference path onto a base path and remove dot parts."""
    stem = F.regexp_extract(base, "^(.*/)", 1)
    merged = F.when(ref.startswith("/"), ref).when(stem != "", F.concat(stem, ref)).otherwise(
        F.concat(F.lit("/"), ref)
    )
    parts = F.split(merged, "/")

    def tidy(p: Column) -> Column:
        n = F.size(p)
        # empty parts vanish except the first and the last
        kept = F.filter(p, lambda s, i: (s != "") | (i == 0) | (i == n - 1))
        walked = F.aggregate(
            kept,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))),
        )
        closed = F.when(F.element_at(kept, -1).isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
        # climbing above the root ends at the root
        return F.regexp_replace(F.array_join(closed, "/"), "^(?!/)", "/")

    return F.when(merged.rlike("/\\.{1,2}(/|$)|//"), let(parts, tidy)).otherwise(merged)


def base_parts(base: Column) -> Column:
    """What a page address contributes to its links; compute it once per page."""
    site = F.concat(scheme(base), F.lit(":"), F.regexp_extract(base, URI, 2))
    return F.struct(
        base.alias("url"), scheme(base).alias("scheme"), site.alias("site"), path(base).alias("path"),
        F.when(query_string(base) != "", F.regexp_extract(base, URI, 5)).otherwise(F.lit("")).alias("query"),
    )


def join_parts(base: Column, ref: Column) -> Column:
    """Resolve a link against ``base_parts`` of its page."""

    def build(r: Column) -> Column:
        part = lambda i: F.regexp_extract(r, URI, i)
        # a bare "?" or "#" adds nothing
        own_query = F.when(part(6) != "", part(5)).otherwise(F.lit(""))
        anchor = F.when(part(8) != "", part(7)).otherwise(F.lit(""))
        tail = F.concat(own_query, anchor)
        query = F.when(part(6) != "", part(5)).otherwise(base["query"])
        # the common case first: a plain path from the root
        plain = r.startswith("/") & ~r.rlike("//|/\\.|[?#]")
        return (
            F.when(plain, F.concat(base["site"], r))
            .when(r == "", base["url"])
            .when((part(1) != "") & (F.lower(part(1)) != base["scheme"]), r)
            .when(part(2) != "", F.concat(base["scheme"], F.lit(":"), part(2), part(4), tail))
            .when(part(4) == "", F.concat(base["site"], base["path"], query, anchor))
            .otherwise(F.concat(base["site"], _resolve_path(base["path"], part(4)), tail))
        )

    return let(ref, build)


def url_join(base: Column, ref: Column) -> Column:
    """Resolve a link against the address of its page."""
    return let(base_parts(base), lambda b: join_parts(b, ref))


def is_image_url(u: Column) -> Column:
    p = F.lower(path(u))
    return has_ext(p, PAGE_EXTS) & ~p.rlike(THUMB)


def looks_like_page(u: Column) -> Column:
    hints = "|".join(SKIP_HINTS)
    return ~F.lower(u).rlike(hints) & ~path(u).rlike(THUMB)


def extract_urls(c: Column, with_query: bool = False) -> Column:
    """Every image address inside a text, with or without its query string."""
    return F.regexp_extract_all(c, F.lit(IN_TEXT_QUERY if with_query else IN_TEXT), 0)


def url_ext(u: Column, strict: bool = False) -> Column:
    """Lower-case suffix of the path; ``.jpg`` when absent (``strict``: or unknown)."""
    ext = F.lower(F.regexp_extract(path(u), "[^/.][^/]*?(\\.[^./]*)$", 1))
    if strict:
        return F.when(ext.isin(*["." + e for e in PAGE_EXTS]), ext).otherwise(F.lit(".jpg"))
    return F.when(ext == "", F.lit(".jpg")).otherwise(ext)


def host_moved(asked: Column, final: Column) -> Column:
    a, b = host(asked), host(final)
    return (a != "") & (b != "") & (a != b)


def parse_srcset(c: Column) -> Column:
    """Addresses of a ``srcset`` value: the first word of every comma part."""
    words = F.transform(F.split(c, ","), lambda part: F.element_at(F.split(strip(part), " "), 1))
    return F.filter(words, lambda w: w != "")


def directory(u: Column) -> Column:
    """Everything before the last slash."""
    return F.regexp_replace(u, "/[^/]*$", "")


# -- HTML ------------------------------------------------------------------

_ATTR = "([^\\s\"'<>/=]+)(?:\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s>\"']+))?"


def _unquote(v: Column) -> Column:
    v = F.regexp_replace(v, "^[\"']|[\"']$", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        v = F.replace(v, F.lit(entity), F.lit(char))
    return v


def extract_tags(html: Column, name: str) -> Column:
    """The ``name`` tags of a document in order, as array<struct<keys, vals>>.

    Comments and the bodies of scripts and styles hold no tags.
    """
    live = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    live = F.regexp_replace(live, "(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>", "")
    tags = F.regexp_extract_all(
        live, F.lit(f"(?i)<{name}(?=[\\s/>])([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>"), 1
    )
    return F.transform(
        tags,
        lambda t: F.struct(
            F.transform(F.regexp_extract_all(t, F.lit(_ATTR), 1), F.lower).alias("keys"),
            F.regexp_extract_all(t, F.lit(_ATTR), 2).alias("vals"),
        ),
    )


def _raw_attr(tag: Column, name: str) -> Column:
    at = F.size(tag["keys"]) - F.array_position(F.reverse(tag["keys"]), name)
    return F.when(F.array_contains(tag["keys"], name), F.get(tag["vals"], at.cast("int")))


def attr(tag: Column, name: str) -> Column:
    """Value of an attribute of an extracted tag (empty when absent; the last one wins)."""
    return F.coalesce(_unquote(_raw_attr(tag, name)), F.lit(""))


def pick_attr(tag: Column, base: Column) -> Column:
    """The image address of a tag: first usable attribute, resolved against ``base_parts``; null when none."""
    present = F.array_compact(F.array(*[_raw_attr(tag, a) for a in IMAGE_ATTRS]))
    values = F.transform(present, lambda v: let(_unquote(v), lambda u: F.struct(u.alias("raw"), strip(u).alias("v"))))
    usable = F.filter(values, lambda x: (x.raw != "") & ~x.v.startswith("data:"))
    return let(F.get(usable, F.lit(0)), lambda x: F.when(x.isNotNull(), join_parts(base, x.v)))


def is_reader_img(tag: Column) -> Column:
    """True when any class of the tag contains ``chapter-img``."""
    return F.exists(F.split(attr(tag, "class"), "\\s+"), lambda c: c.contains("chapter-img"))


def largest_group(urls: Column, min_best: int = 3, keep_if_at_least: int = 3) -> Column:
    """Keep the addresses of the fullest directory (first seen on ties).

    When that directory holds fewer than ``min_best`` of at least ``keep_if_at_least``
    addresses, all are kept. One sorted pass per row, so long lists stay cheap.
    """
    tagged = F.array_sort(
        F.transform(urls, lambda u, i: F.struct(directory(u).alias("dir"), i.alias("pos")))
    )
    zero = F.struct(
        F.lit(None).cast("string").alias("dir"), F.lit(0).alias("n"), F.lit(0).alias("first"),
        F.lit(None).cast("string").alias("best"), F.lit(0).alias("best_n"), F.lit(0).alias("best_first"),
    )

    def step(acc: Column, x: Column) -> Column:
        same = F.coalesce(acc.dir == x.dir, F.lit(False))
        run = F.struct(
            x.dir.alias("dir"),
            F.when(same, acc.n + 1).otherwise(F.lit(1)).alias("n"),
            F.when(same, acc.first).otherwise(x.pos).alias("first"),
        )

        def choose(r: Column) -> Column:
            better = (r.n > acc.best_n) | ((r.n == acc.best_n) & (r["first"] < acc.best_first))
            return F.struct(
                r.dir.alias("dir"), r.n.alias("n"), r["first"].alias("first"),
                F.when(better, r.dir).otherwise(acc.best).alias("best"),
                F.when(better, r.n).otherwise(acc.best_n).alias("best_n"),
                F.when(better, r["first"]).otherwise(acc.best_first).alias("best_first"),
            )

        return let(run, choose)

    best = F.aggregate(tagged, zero, step)
    return let(
        best,
        lambda b: F.when((b.best_n < min_best) & (F.size(urls) >= keep_if_at_least), urls).otherwise(
            F.filter(urls, lambda u: directory(u) == b.best)
        ),
    )
