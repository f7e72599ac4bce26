"""Queries over crawled pages and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import strip
from ..operators import jobs, links
from ..sources.documents import scan_pages
from ..sources.fixtures import ctes, view
from . import query, sql as Q


def _pages(spark, sf):
    return scan_pages(spark, f"{sf}/pages.parquet")


SOURCE = "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat('  ', upper(url)) WHEN 2 THEN concat('/local/', url) ELSE 'ftp://x/y' END"


@query("source_routing", rf"SELECT page_id, {SOURCE} AS source, regexp_matches(lower({Q.strip('(' + SOURCE + ')')}), '^https?://') AS is_url FROM pages")
def source_routing(spark, sf):
    df = _pages(spark, sf).select("page_id", F.expr(SOURCE).alias("source"))
    return df.withColumn("is_url", U.is_url(F.col("source")))


@query("safe_names", rf"""
SELECT doc_id, coalesce(nullif(left(trim({Q.strip("regexp_replace(text, '[^" + chr(92) + "pL" + chr(92) + "pN_." + chr(92) + "- ]+', '_', 'g')")}, '.'), 80), ''), 'chapter') AS name
FROM documents""")
def safe_names(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", U.safe_name(F.col("text")).alias("name"))


NAMED = """CASE page_id % 4 WHEN 0 THEN url
  WHEN 1 THEN concat('https://a.example.com/v/?x=1&wr_id=', CAST(page_id AS STRING), '&id=9')
  WHEN 2 THEN concat('https://a.example.com/v/read/?id=a%20b+c', CAST(page_id AS STRING), '#t') ELSE 'https://a.example.com/' END"""


@query("names_from_urls", f"""
WITH u AS (SELECT page_id, {NAMED} AS u FROM pages), q AS (SELECT page_id, u, {Q.part('u', 6)} AS q, {Q.part('u', 4)} AS p FROM u),
v AS (SELECT *, nullif(url_decode(replace(regexp_extract(q, '(?:^|&)wr_id=([^&]+)', 1), '+', ' ')), '') AS k1,
  nullif(url_decode(replace(regexp_extract(q, '(?:^|&)is=([^&]+)', 1), '+', ' ')), '') AS k2,
  nullif(url_decode(replace(regexp_extract(q, '(?:^|&)id=([^&]+)', 1), '+', ' ')), '') AS k3 FROM q)
SELECT page_id, coalesce('chapter_' || k1, 'chapter_' || k2, 'chapter_' || k3, nullif(string_split(rtrim(p, '/'), '/')[-1], ''), 'chapter') AS name FROM v""")
def names_from_urls(spark, sf):
    df = _pages(spark, sf).select("page_id", F.expr(NAMED).alias("u"))
    return df.select("page_id", U.name_from_url(F.col("u")).alias("name"))


NUMBERED = """CASE page_id % 7 WHEN 0 THEN url WHEN 1 THEN concat('http://a.b/t/Chapter-', CAST(page_id AS STRING), '/9')
  WHEN 2 THEN concat('http://a.b/tale-ep_0', CAST(page_id AS STRING)) WHEN 3 THEN concat('http://a.b/x/c', CAST(page_id AS STRING), '-end')
  WHEN 4 THEN concat('http://a.b/v?x=7&ch=', CAST(page_id AS STRING), '#9') WHEN 5 THEN concat('http://a.b/s123456/', CAST(page_id AS STRING), '?p=3')
  ELSE 'http://a.b/none' END"""
_STEPS = [(r"chapter[-_/]", ""), (r"-ep[-_]?", ""), (r"/ep[-_]?", ""), (r"[?&]ch(?:apter)?=", ""), (r"/c", r"(?:[/\-_]|$)")]
_D = [f"(?is)^(.*?{lead})(\\d+){tail}" for lead, tail in _STEPS] + [r"^([^?#]*\D)(\d{1,4})[^\d?#]*(?:[?#].*)?$"]
CHAPTERS = "WITH u AS (SELECT page_id, " + NUMBERED + " AS url FROM pages), m AS (SELECT *, CASE " + " ".join(
    f"WHEN regexp_matches(url, '{p}') THEN {i}" for i, p in enumerate(_D)
) + " END AS k FROM u), d AS (SELECT page_id, url, CASE k " + " ".join(
    f"WHEN {i} THEN length(regexp_extract(url, '{p}', 1))" for i, p in enumerate(_D)
) + " END AS start, CASE k " + " ".join(f"WHEN {i} THEN regexp_extract(url, '{p}', 2)" for i, p in enumerate(_D)) + """ END AS digits, k FROM m),
found AS (SELECT page_id, url, CAST(digits AS DECIMAL(38,0)) AS n, start, start + length(digits) AS stop FROM d
  WHERE k < 5 OR CAST(digits AS DECIMAL(38,0)) BETWEEN 1 AND 9999)
"""


@query("chapter_numbers", CHAPTERS + "SELECT u.page_id, CAST(n AS VARCHAR) AS n, start, stop FROM u LEFT JOIN found USING (page_id)")
def chapter_numbers(spark, sf):
    df = _pages(spark, sf).select("page_id", F.expr(NUMBERED).alias("url"))
    return df.select("page_id", U.detect_chapter(F.col("url")).alias("d")).select("page_id", F.col("d.n").cast("string").alias("n"), "d.start", "d.stop")


@query("chapter_batches", CHAPTERS + """
SELECT page_id, CAST(ch AS VARCHAR) AS ch, substring(url, 1, start) || CAST(ch AS VARCHAR) || substring(url, stop + 1) AS chapter_url,
  'chapter_' || lpad(CAST(ch AS VARCHAR), CAST(greatest(4, length(CAST(ch AS VARCHAR))) AS INT), '0') || '.zip' AS bundle
FROM (SELECT *, CAST(n AS HUGEINT) + unnest(range(0, 10)) AS ch FROM found) e""")
def chapter_batches(spark, sf):
    df = _pages(spark, sf).select("page_id", F.expr(NUMBERED).alias("url"))
    return jobs.expand_batch(df, strict=False).select("page_id", F.col("ch").cast("string").alias("ch"), "chapter_url", "bundle")


LONG_URL = "concat('http://a.b/t/chapter-', repeat(CAST(1 + page_id % 8 AS STRING), CASE page_id % 3 WHEN 0 THEN 12 WHEN 1 THEN 20 ELSE 45 END), '/x')"


@query("long_chapters", f"""WITH u AS (SELECT page_id, regexp_extract({LONG_URL.replace('STRING', 'VARCHAR')}, '[0-9]+') AS d FROM pages)
SELECT page_id, CASE WHEN length(d) > 30 THEN left(d, length(d) - 18) || CAST(CAST(right(d, 18) AS HUGEINT) + k AS VARCHAR) ELSE CAST(CAST(d AS HUGEINT) + k AS VARCHAR) END AS ch
FROM u, (SELECT unnest(range(0, 10)) AS k) r""")
def long_chapters(spark, sf):
    """Numbers of 12, 20 and 45 digits are counted on alike."""
    df = _pages(spark, sf).select("page_id", F.expr(LONG_URL).alias("url"))
    return jobs.expand_batch(df, strict=False).select("page_id", "ch")


@query("page_links", f"""
WITH t AS (SELECT page_id, url, {Q.tags('html', 'a')} AS tags FROM pages),
r AS (SELECT page_id, url, pos, {Q.attr('tag', 'href')} AS raw FROM (SELECT page_id, url, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM t) x)
SELECT page_id, pos, raw, {Q.join('url', 'ref')} AS link FROM (SELECT *, {Q.strip('raw')} AS ref FROM r WHERE raw <> '') y""")
def page_links(spark, sf):
    return links.page_links(_pages(spark, sf))


REFS = ("../up/1.jpg", "./x.png", "?q=1", "#top", "//cdn.example.com/a.jpg", "/abs/y.gif", "a//b/../c.webp", "", "..", "../../../z", ".",
        "ftp://other/x", "a/b/", "./", "data:image/gif,AA")
REF_ARRAY = "array(" + ", ".join(f"'{r}'" for r in REFS) + ")"
REF_LIST = "[" + ", ".join(f"'{r}'" for r in REFS) + "]"


@query("resolved_links", f"WITH r AS (SELECT page_id, url, unnest({REF_LIST}) AS ref FROM pages) SELECT page_id, ref, {Q.join('url', 'ref')} AS link FROM r")
def resolved_links(spark, sf):
    df = _pages(spark, sf).select("page_id", "url", F.explode(F.expr(REF_ARRAY)).alias("ref"))
    return df.select("page_id", "ref", U.url_join(F.col("url"), F.col("ref")).alias("link"))


FX = ctes("fx_html") + ",\n" + Q.IMG_TAGS
CHOSEN = f""", reader AS (
  SELECT page_id, u, row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) AS pos FROM img_picked
  WHERE contains(cls, 'chapter-img') AND {Q.is_image('u')} GROUP BY page_id, u
), chosen AS (
  SELECT page_id, u, pos FROM reader UNION ALL SELECT page_id, u, row_number() OVER (PARTITION BY page_id ORDER BY pos) FROM {Q.best_dir('loose', 3, 3)} b
  WHERE page_id NOT IN (SELECT page_id FROM reader))
"""


@query("page_images", FX + CHOSEN + "SELECT page_id, pos, u AS img FROM chosen")
def page_images(spark, sf):
    return links.page_urls(view(spark, sf, "fx_html"))


@query("image_candidates", FX + "SELECT page_id, pos, u AS img FROM loose")
def image_candidates(spark, sf):
    return links.loose_urls(view(spark, sf, "fx_html"))


@query("directory_groups", FX + f"SELECT page_id, pos, u AS img FROM {Q.best_dir('loose', 3, 3)} b")
def directory_groups(spark, sf):
    return links.largest_group(links.loose_urls(view(spark, sf, "fx_html")), "page_id")


@query("download_names", FX + CHOSEN + rf"""SELECT page_id, pos, printf('%03d', pos) ||
  CASE WHEN e = '' THEN '.jpg' ELSE e END AS name, CASE WHEN e IN ('.jpg', '.jpeg', '.png', '.webp', '.gif') THEN e ELSE '.jpg' END AS strict_ext
FROM (SELECT *, {Q.url_ext('u')} AS e FROM chosen) c""")
def download_names(spark, sf):
    named = links.output_names(links.page_urls(view(spark, sf, "fx_html")))
    return named.select("page_id", "pos", "name", U.url_ext(F.col("img"), strict=True).alias("strict_ext"))


@query("link_tests", FX + rf"""
SELECT page_id, pos, u AS img, {Q.is_image('u')} AS is_image,
  NOT regexp_matches(lower(u), '/covers/|/cover/|avatar|logo|favicon|icon|banner') AND NOT regexp_matches({Q.part('u', 4)}, '(?i)-\d+x\d+\.(?:jpg|jpeg|png|webp|gif)$') AS is_page,
  contains(cls, 'chapter-img') AS is_reader FROM img_picked""")
def link_tests(spark, sf):
    tags = view(spark, sf, "fx_html").select("page_id", "url", F.posexplode_outer(U.extract_tags(F.col("html"), "img")).alias("pos", "tag"))
    img = tags.select("page_id", (F.col("pos") + 1).alias("pos"), U.pick_attr(F.col("tag"), U.base_parts(F.col("url"))).alias("img"), U.is_reader_img(F.col("tag")).alias("is_reader"))
    return img.where("img is not null").select(
        "page_id", "pos", "img", U.is_image_url(F.col("img")).alias("is_image"), U.looks_like_page(F.col("img")).alias("is_page"), "is_reader"
    )


@query("embedded_urls", ctes("fx_html") + f"""
SELECT page_id, pos, img, with_query FROM (
  SELECT page_id, generate_subscripts(a, 1) AS pos, unnest(a) AS img, unnest(b) AS with_query FROM (
    SELECT page_id, regexp_extract_all(html, '{Q.IN_TEXT}') AS a,
      regexp_extract_all(html, '{Q.IN_TEXT}' || '(?:\\?[^\\s"''<>]*)?') AS b FROM fx_html) x) y""".replace("\\\\", "\\"))
def embedded_urls(spark, sf):
    html = F.col("html")
    pairs = F.arrays_zip(U.extract_urls(html).alias("img"), U.extract_urls(html, True).alias("with_query"))
    df = view(spark, sf, "fx_html").select("page_id", F.posexplode_outer(pairs).alias("pos", "p")).where("pos is not null")
    return df.select("page_id", (F.col("pos") + 1).alias("pos"), F.col("p.img").alias("img"), F.col("p.with_query").alias("with_query"))


@query("rendered_images", FX + f""", dom AS (
  SELECT page_id, u, row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) AS pos FROM img_picked
  WHERE starts_with(u, 'http') AND NOT regexp_matches(lower(u), '/covers/|/cover/|avatar|logo|favicon|icon|banner')
    AND NOT regexp_matches({Q.part('u', 4)}, '(?i)-[0-9]+x[0-9]+\\.(?:jpg|jpeg|png|webp|gif)$') GROUP BY page_id, u
), api AS (
  SELECT page_id, u, row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) AS pos FROM script_urls
  WHERE NOT regexp_matches(lower(u), '/covers/|/cover/|avatar|logo|favicon|icon|banner') GROUP BY page_id, u
), d AS (SELECT * FROM {Q.best_dir('dom', 2, 0)} x), a AS (SELECT * FROM {Q.best_dir('api', 2, 0)} x),
n AS (SELECT page_id, (SELECT count(*) FROM d WHERE d.page_id = p.page_id) AS nd, (SELECT count(*) FROM a WHERE a.page_id = p.page_id) AS na FROM pages p),
w AS (SELECT page_id, CASE WHEN nd >= 3 OR (na < 3 AND nd >= na) THEN 'd' ELSE 'a' END AS w FROM n)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS pos, u AS img FROM (
  SELECT d.* FROM d JOIN w USING (page_id) WHERE w = 'd' UNION ALL SELECT a.* FROM a JOIN w USING (page_id) WHERE w = 'a') z""")
def rendered_images(spark, sf):
    picked = F.transform(U.extract_tags(F.col("html"), "img"), lambda t: U.pick_attr(t, F.col("base")))
    seen = view(spark, sf, "fx_html").withColumn("base", U.base_parts(F.col("url"))).select(
        "page_id", F.filter(picked, lambda u: u.isNotNull()).alias("dom"), F.array().cast("array<string>").alias("srcset"),
        U.extract_urls(F.col("html")).alias("api"), F.array().cast("array<string>").alias("net"),
    )
    return links.rendered_urls(seen)


FINAL = "CASE page_id % 5 WHEN 0 THEN 'https://discord.example/x' WHEN 1 THEN '/relative' ELSE concat(url, '&z=1') END"


@query("host_guard", f"""
SELECT page_id, {Q.part('url', 3)} AS asked, {Q.part('final', 3)} AS final_host,
  {Q.part('url', 3)} <> '' AND {Q.part('final', 3)} <> '' AND {Q.part('url', 3)} <> {Q.part('final', 3)} AS moved
FROM (SELECT *, {FINAL} AS final FROM pages) p""")
def host_guard(spark, sf):
    df = _pages(spark, sf).select("page_id", "url", F.expr(FINAL).alias("final"))
    return df.select("page_id", U.host(F.col("url")).alias("asked"), U.host(F.col("final")).alias("final_host"), U.host_moved(F.col("url"), F.col("final")).alias("moved"))


PARAMS = "concat('http://h.example.com/a;b/', CAST(page_id AS STRING), CASE page_id % 4 WHEN 0 THEN '.jpg;v=2' WHEN 1 THEN ';x/c.PNG;a;b?q=1' WHEN 2 THEN '.webp' ELSE ';d.gif' END)"


@query("parameter_urls", """SELECT page_id, page_id % 4 <> 3 AS is_image, CASE page_id % 4 WHEN 1 THEN '.png' WHEN 2 THEN '.webp' ELSE '.jpg' END AS ext FROM pages""")
def parameter_urls(spark, sf):
    """Parameters after a semicolon belong to no path."""
    u = F.expr(PARAMS)
    return _pages(spark, sf).select("page_id", U.is_image_url(u).alias("is_image"), U.url_ext(u).alias("ext"))


SRCSET = "concat(' /b/', CAST(page_id AS STRING), '/1.jpg 1x, /b/', CAST(page_id AS STRING), '/2.jpg 2x,, ,', url)"


@query("srcset_links", f"""
SELECT page_id, pos, link FROM (SELECT page_id, generate_subscripts(l, 1) AS pos, unnest(l) AS link FROM (
  SELECT page_id, list_filter(list_transform(string_split({SRCSET}, ','), lambda p: string_split(trim(p), ' ')[1]), lambda w: w <> '') AS l FROM pages) x) y""")
def srcset_links(spark, sf):
    df = _pages(spark, sf).select("page_id", F.posexplode_outer(U.parse_srcset(F.expr(SRCSET))).alias("pos", "link"))
    return df.withColumn("pos", F.col("pos") + 1)


LOG = """concat('# /d/', CAST(page_id AS STRING), '.JPG', chr(10), 'note', chr(10), '/d/b.png', chr(10), '  "/d/', CAST(page_id % 3 AS STRING), '.webp" ', chr(10), '/d/b.png', chr(13), chr(10), url)"""


@query("log_order", rf"""
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY min(p)) AS pos, f AS file FROM (
  SELECT page_id, p, trim({Q.strip('ltrim(' + Q.strip('l') + ", '# ')")}, '"') AS f FROM (
    SELECT page_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS p FROM (SELECT page_id, regexp_split_to_array({LOG}, '\r\n|[\n\r]') AS ls FROM pages) a) b) c
WHERE regexp_matches(f, '(?i)\.(?:jpg|jpeg|png|webp|gif|bmp)$') GROUP BY page_id, f""")
def log_order(spark, sf):
    df = _pages(spark, sf).select("page_id", F.expr(LOG).alias("log"))
    return links.order_from_log(df, "page_id")


LISTED = """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN e ELSE f END AS file FROM (SELECT page_id, url, concat('/x/', CAST(page_id AS STRING), '.JPG') AS f, '/e/10.png' AS e FROM {t}
  UNION ALL SELECT page_id, url, '/d/b.png', '/e/9.png' FROM {t} UNION ALL SELECT page_id, url, '/e/zz.png', '/e/Zz.png' FROM {t}) x"""


@query("logged_files", """SELECT page_id, pos, file FROM (SELECT page_id, unnest([1, 2, 3]) AS pos, CASE WHEN page_id % 4 = 0 THEN unnest(['/e/9.png', '/e/10.png', '/e/Zz.png'])
  ELSE unnest(['/x/' || CAST(page_id AS VARCHAR) || '.JPG', '/d/b.png', NULL]) END AS file FROM pages) x WHERE file IS NOT NULL""")
def logged_files(spark, sf):
    """Every fourth page's log names no file that is there; its files stand in natural order."""
    logs = _pages(spark, sf).select("page_id", F.expr(LOG).alias("log"))
    return links.order_files(logs, spark.sql(LISTED.replace("{t}", "{pages}"), pages=_pages(spark, sf)), "page_id")


@query("first_seen_links", f"""
WITH t AS (SELECT page_id, {Q.tags('html', 'a')} AS tags FROM pages),
r AS (SELECT page_id, pos, {Q.attr('tag', 'href')} AS raw FROM (SELECT page_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM t) x)
SELECT raw, arg_min(page_id, (page_id, pos)) AS page_id, arg_min(pos, (page_id, pos)) AS pos FROM r WHERE raw <> '' GROUP BY raw""")
def first_seen_links(spark, sf):
    found = links.page_links(_pages(spark, sf)).select("raw", "page_id", "pos")
    return links.dedupe_first(found, ["raw"], ["page_id", "pos"])


@query("tier_choice", ctes("fx_attempts") + """,
s AS (SELECT chapter, tier, count(*) FILTER (WHERE ok) AS c FROM fx_attempts GROUP BY chapter, tier),
b AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY CASE WHEN c >= 3 THEN 0 ELSE 1 END, CASE WHEN c >= 3 THEN 0 ELSE -c END, tier) AS r FROM s)
SELECT chapter, CASE WHEN c > 0 THEN tier END AS tier, c AS n_pages FROM b WHERE r = 1""")
def tier_choice(spark, sf):
    return links.choose_tier(view(spark, sf, "fx_attempts"))


@query("ordered_sources", FX + f""", t AS (SELECT page_id, url, {Q.tags('html', 'a')} AS tags FROM fx_html),
r AS (SELECT page_id, url, pos, {Q.attr('tag', 'href')} AS raw FROM (SELECT page_id, url, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM t) x)
SELECT page_id, pos, u AS link, 0 AS src_rank FROM loose UNION ALL SELECT page_id, pos, {Q.join('url', 'ref')}, 1 FROM (SELECT *, {Q.strip('raw')} AS ref FROM r WHERE raw <> '') y""")
def ordered_sources(spark, sf):
    html = view(spark, sf, "fx_html")
    images = links.loose_urls(html).select("page_id", "pos", F.col("img").alias("link"))
    return links.ordered_union(images, links.page_links(html).select("page_id", "pos", "link"))
