"""Queries over text items and their documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import textflow as T
from ..sources import documents as D
from ..sources.fixtures import ctes, table, view
from . import query

ACCENTS = ((0xC0, 0x24F),)
SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"


def _docs(spark, sf):
    return table(spark, sf, "documents")


@query("script_shares", rf"""
SELECT doc_id, CASE WHEN length(d) > 0 THEN (length(d) - length(regexp_replace(d, '[À-ɏ]', '', 'g'))) / length(d) ELSE 0 END AS share
FROM (SELECT doc_id, regexp_replace(text, '{SPACE}', '', 'g') AS d FROM documents) x""")
def script_shares(spark, sf):
    return _docs(spark, sf).select("doc_id", X.script_ratio(F.col("text"), ACCENTS).alias("share"))


READINGS = """SELECT doc_id, text AS en_text, (doc_id % 10) / 10.0 AS en_conf, {ko} AS ko_text, (doc_id % 7) / 10.0 AS ko_conf FROM {t}"""


def _route_sql(lang: str) -> str:
    hangul = "(CASE WHEN length(d) > 0 THEN (length(d) - length(regexp_replace(d, '[가-힣ᄀ-ᇿ㄰-㆏]', '', 'g'))) / length(d) ELSE 0 END) > 0.3"
    if lang == "en":
        hangul = f"({hangul} AND ko_conf >= 0.3)"
    kinds = ("sfx", "dialogue") if lang == "en" else ("dialogue", "sfx")
    readings = READINGS.format(ko="regexp_replace(text, '[aeiou]', '가', 'g')", t="documents")
    return rf"""WITH r AS (SELECT *, regexp_replace(ko_text, '{SPACE}', '', 'g') AS d FROM ({readings}) x), h AS (SELECT *, {hangul} AS han FROM r)
SELECT doc_id, CASE WHEN han THEN '{kinds[0]}' ELSE '{kinds[1]}' END AS kind, md5(trim(CASE WHEN han THEN ko_text ELSE en_text END, chr(10)||' ')) AS text_md5,
  CASE WHEN han THEN ko_conf ELSE en_conf END AS conf, CASE WHEN han THEN 'hangul' ELSE 'latin' END AS script FROM h"""


def _routed(spark, sf, lang):
    sql = READINGS.format(ko="regexp_replace(text, '[aeiou]', '가')", t="{docs}").replace("/ 10.0", "/ 10.0D")
    routed = T.route_script(spark.sql(sql, docs=_docs(spark, sf)), lang)
    return routed.select("doc_id", "kind", F.md5("text").alias("text_md5"), "conf", "script")


@query("routed_english", _route_sql("en"))
def routed_english(spark, sf):
    return _routed(spark, sf, "en")


@query("routed_korean", _route_sql("ko"))
def routed_korean(spark, sf):
    return _routed(spark, sf, "ko")


MARKED = "CASE WHEN doc_id % 2 = 0 THEN concat('**', split_part(text, ' ', 1), '** and ', text) ELSE text END"


@query("text_tests", rf"""
SELECT doc_id, regexp_matches(m, '\*\*[^*]+\*\*') AS named, md5(regexp_replace(m, '\*\*([^*]+)\*\*', '\1', 'g')) AS plain_md5,
  regexp_matches(m, '[à-ÿ]') AS has_block, md5(replace(replace(replace(m, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n')) AS escaped_md5,
  coalesce(right(trim(m, ' ' || chr(10) || chr(9) || chr(13)), 1) IN ('.', '!', '?', '…', '។', '៕'), false) AS ends
FROM (SELECT doc_id, {MARKED} AS m FROM documents) x""")
def text_tests(spark, sf):
    m = F.col("m")
    return _docs(spark, sf).select("doc_id", F.expr(MARKED).alias("m")).select(
        "doc_id", X.flag_names(m).alias("named"), F.md5(X.strip_names(m)).alias("plain_md5"), X.has_script(m, ((0xE0, 0xFF),)).alias("has_block"),
        F.md5(X.js_escape(m)).alias("escaped_md5"), X.ends_sentence(m).alias("ends"),
    )


FX = ctes("fx_transcript")
NUMBERED = FX + """, items AS (
  SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY page, item) AS n, item * 10 AS x, item * 40 AS y, 100 + item AS w, 30 AS h, 0.5 AS conf FROM fx_transcript)
"""


def _items(spark, sf):
    raw = view(spark, sf, "fx_transcript").selectExpr("*", "item * 10 as x", "item * 40 as y", "100 + item as w", "30 as h", "0.5D as conf")
    return T.number_items(raw, ["item"])


@query("numbered_items", NUMBERED + "SELECT chapter, page, item, n FROM items")
def numbered_items(spark, sf):
    return T.number_items(view(spark, sf, "fx_transcript"), ["item"]).select("chapter", "page", "item", "n")


@query("numbered_items_by_page", NUMBERED + "SELECT chapter, page, item, n FROM items")
def numbered_items_by_page(spark, sf):
    return T.number_items_by_page(view(spark, sf, "fx_transcript")).select("chapter", "page", "item", "n")


# pages far apart, some negative
FAR = "(page % 10) * CAST(900000000000000000 AS BIGINT) + page - CAST(4000000000000000000 AS BIGINT)"


@query("sparse_numbered_items", f"""{FX}, far AS (SELECT chapter, {FAR} AS page, item FROM fx_transcript)
SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY page, item) AS n FROM far""")
def sparse_numbered_items(spark, sf):
    far = view(spark, sf, "fx_transcript").select("chapter", F.expr(FAR).alias("page"), "item")
    return T.number_items(far, ["item"]).select("chapter", "page", "item", "n")


LINE = "SELECT chapter, {p} AS part, {page} AS page, {s} AS sub, {n} AS n, {text} AS line FROM {t}"
_PROMPT = T.TRANSCRIPT_PROMPT.replace("'", "''")
_CLIP = (T.CLIPBOARD_PROMPT.rstrip("\n") + "\n").replace("'", "''")
_ITEM = "CAST(n AS VARCHAR) || '. [' || kind || '] ' || text"


def _union(*parts) -> str:
    return " UNION ALL ".join(LINE.format(**p) for p in parts)


@query("transcript_text", NUMBERED + _union(
    dict(p=0, page=0, s=0, n=0, text=f"'# ' || CAST(chapter AS VARCHAR) || ' — transcript (en)' || chr(10) || chr(10) || '> {_PROMPT}' || chr(10)", t="(SELECT DISTINCT chapter FROM items) c"),
    dict(p=1, page="page", s=1, n=0, text="'## Page ' || CAST(page AS VARCHAR)", t="(SELECT DISTINCT chapter, page FROM items) c"),
    dict(p=1, page="page", s=2, n="n", text=_ITEM, t="items"),
    dict(p=1, page="page", s=3, n=0, text="''", t="(SELECT DISTINCT chapter, page FROM items) c"),
))
def transcript_text(spark, sf):
    return T.transcript_lines(_items(spark, sf))


@query("translation_prompt", NUMBERED + _union(
    dict(p=0, page=0, s=0, n=0, text=f"'{_CLIP}'", t="(SELECT DISTINCT chapter FROM items) c"),
    dict(p=1, page=0, s=1, n="n", text=_ITEM, t="items"),
))
def translation_prompt(spark, sf):
    return T.prompt_lines(_items(spark, sf))


@query("transcript_json", NUMBERED + """, p AS (SELECT chapter, page, min(n) AS fn, min(page) OVER (PARTITION BY chapter) AS fp FROM items GROUP BY chapter, page)
""" + _union(
    dict(p=0, page=0, s=0, n=0, text="""'{"chapter": "' || CAST(chapter AS VARCHAR) || '", "lang": "en", "pages": ['""", t="(SELECT DISTINCT chapter FROM items) c"),
    dict(p=1, page="page", s=1, n=0, text="""CASE WHEN page = fp THEN '' ELSE ',' END || '{"page": ' || CAST(page AS VARCHAR) || ', "items": ['""", t="p"),
    dict(p=1, page="page", s=2, n="n", text="""CASE WHEN n = fn THEN '' ELSE ',' END || '{"n":' || CAST(n AS VARCHAR) || ',"kind":"' || kind || '","bbox":[' || CAST(x AS VARCHAR) || ',' || CAST(y AS VARCHAR) || ',' || CAST(w AS VARCHAR)
      || ',' || CAST(h AS VARCHAR) || '],"text":' || CAST(to_json(text) AS VARCHAR) || ',"conf":0.5}'""", t="(SELECT i.*, fn FROM items i JOIN p USING (chapter, page)) c"),
    dict(p=1, page="page", s=3, n=0, text="']}'", t="p"),
    dict(p=4, page=0, s=4, n=0, text="']}'", t="(SELECT DISTINCT chapter FROM items) c"),
))
def transcript_json(spark, sf):
    return T.transcript_json_lines(_items(spark, sf))


# Replies: one text per item, with a repeated number, a second line, other separators and an empty line.
REPLY = """concat('  ', CAST(CASE WHEN item % 4 = 3 THEN n - 1 ELSE n END AS STRING), CASE n % 3 WHEN 0 THEN '. ' WHEN 1 THEN ') ' ELSE ' - ' END,
  CASE WHEN n % 2 = 0 THEN concat('[', kind, '] ') ELSE '' END, CASE WHEN n % 5 = 0 THEN '**Nam** ' ELSE '' END, replace(text, chr(10), ' '), '  ', chr(10),
  CASE WHEN n % 6 = 0 THEN concat(CAST(n AS STRING), '. last ', kind, chr(10)) ELSE 'note' END, chr(13), chr(10), CAST(n AS STRING), '.', chr(10))"""
REPLIES = NUMBERED.rstrip() + rf""", replies AS (SELECT chapter, n AS seq, {REPLY} AS text FROM items),
rl AS (SELECT chapter, seq, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM (SELECT chapter, seq, regexp_split_to_array(text, '\r\n|[\n\r]') AS ls FROM replies) x),
rm AS (SELECT *, regexp_extract(l, '{X.NUMBERED.replace(chr(92) * 2, chr(92))}', 1) AS d, regexp_extract(l, '{X.NUMBERED.replace(chr(92) * 2, chr(92))}', 2) AS body FROM rl),
filled AS (SELECT chapter, CASE WHEN ltrim(d, '0') = '' THEN '0' ELSE ltrim(d, '0') END AS n, arg_max(trim(body), (seq, pos)) AS text FROM rm WHERE d <> '' AND trim(body) <> '' GROUP BY ALL)
"""


def _table(spark, sf):
    replies = _items(spark, sf).select("chapter", F.col("n").alias("seq"), F.expr(REPLY).alias("text"))
    return T.parse_numbered(replies, seq="seq")


@query("reply_lines", REPLIES + "SELECT chapter, n, text FROM filled")
def reply_lines(spark, sf):
    return _table(spark, sf)


FILL = r"""SELECT i.chapter, i.n, CASE WHEN f.text IS NOT NULL THEN regexp_replace(f.text, '\*\*([^*]+)\*\*', '\1', 'g') ELSE i.text END AS text,
  f.text IS NOT NULL AS filled, coalesce(regexp_matches(f.text, '\*\*[^*]+\*\*'), false) AS styled FROM items i """


@query("filled_items", REPLIES + FILL + "LEFT JOIN filled f ON i.chapter = f.chapter AND CAST(i.n AS VARCHAR) = f.n")
def filled_items(spark, sf):
    return T.fill(_items(spark, sf), _table(spark, sf)).select("chapter", "n", "text", "filled", "styled")


@query("matched_items", REPLIES + FILL + "JOIN filled f ON i.chapter = f.chapter AND CAST(i.n AS VARCHAR) = f.n")
def matched_items(spark, sf):
    return T.fill(_items(spark, sf), _table(spark, sf), "inner").select("chapter", "n", "text", "filled", "styled")


_CALL = """'addText("' || replace(replace(f.text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '", ' || concat_ws(', ', x, y, w, h) || ', "kh_' || CAST(i.n AS VARCHAR) || '_' || kind || '");'"""
HEADER = "// one text layer for each call\nfunction addText(text, x, y, w, h, name) { layers.push([name, text, x, y, w, h]); }\n"


@query("page_scripts", REPLIES + f"""SELECT chapter, 1 AS part, page, 1 AS sub, 0 AS n, '{HEADER}' AS line FROM (SELECT DISTINCT chapter, page FROM items) c
UNION ALL SELECT i.chapter, 1, page, 2, i.n, {_CALL} FROM items i JOIN filled f ON i.chapter = f.chapter AND CAST(i.n AS VARCHAR) = f.n WHERE kind = 'bubble'""")
def page_scripts(spark, sf):
    return T.page_script_lines(_items(spark, sf), _table(spark, sf), HEADER, kinds=("bubble",))


@query("script_counts", REPLIES + """SELECT c.chapter, c.page, coalesce(layers, 0) AS layers, printf('page_%03d.jsx', c.page) AS script FROM (SELECT DISTINCT chapter, page FROM items) c
LEFT JOIN (SELECT i.chapter, page, count(*) AS layers FROM items i JOIN filled f ON i.chapter = f.chapter AND CAST(i.n AS VARCHAR) = f.n WHERE kind = 'sfx' GROUP BY i.chapter, page) k ON c.chapter = k.chapter AND c.page = k.page""")
def script_counts(spark, sf):
    return T.script_counts(_items(spark, sf), _table(spark, sf), kinds=("sfx",))


POSTS = "concat('ok', chr(10), 'Posts : 1 - ', CAST(chapter + 3 AS STRING), ' | ', CAST(chapter + 4 AS STRING), ', 9-2 | ', CAST(20 + chapter AS STRING), '-', CAST(30 + chapter AS STRING), ' | 4 4 |', chr(10), 'bye')"
POST_ROWS = rf""", pl AS (SELECT chapter, regexp_split_to_array(regexp_extract(t, '(?i)POSTS?\s*:\s*([0-9\-\s|,]+)', 1), '[|,]') AS ps FROM (SELECT DISTINCT chapter, {POSTS} AS t FROM fx_transcript) x),
pp AS (SELECT chapter, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM pl),
posts AS (SELECT chapter, row_number() OVER (PARTITION BY chapter ORDER BY i) - 1 AS k, CAST(CAST(CASE WHEN r <> '' THEN r ELSE one END AS HUGEINT) AS VARCHAR) AS lo, CAST(CAST(CASE WHEN r <> '' THEN r2 ELSE one END AS HUGEINT) AS VARCHAR) AS hi FROM (
  SELECT *, regexp_extract(p, '^\s*(\d+)\s*-\s*(\d+)', 1) AS r, regexp_extract(p, '^\s*(\d+)\s*-\s*(\d+)', 2) AS r2, regexp_extract(p, '^\s*(\d+)\s*$', 1) AS one FROM pp) q WHERE r <> '' OR one <> '')
"""


def _posts(spark, sf):
    replies = view(spark, sf, "fx_transcript").select("chapter").distinct().withColumn("text", F.expr(POSTS))
    return T.posts_of(replies)


@query("post_groups", FX + POST_ROWS + "SELECT chapter, k, lo, hi FROM posts")
def post_groups(spark, sf):
    return _posts(spark, sf)


@query("post_ends", NUMBERED.rstrip() + POST_ROWS + """SELECT chapter, n FROM items i WHERE EXISTS (
  SELECT 1 FROM posts p WHERE p.chapter = i.chapter AND p.hi = CAST(i.n AS VARCHAR) AND k < (SELECT max(k) FROM posts z WHERE z.chapter = p.chapter))""")
def post_ends(spark, sf):
    return T.cut_after(_items(spark, sf), _posts(spark, sf)).select("chapter", "n")


@query("translated_pages", FX + r""", pages AS (SELECT page, min(chapter) AS chapter, 'canvas_' || CAST(page AS VARCHAR) || '.png' AS image FROM fx_transcript GROUP BY page
  UNION ALL SELECT -1 - page, 0, 'empty.png' FROM fx_transcript WHERE item = 0),
f AS (SELECT p.page, image, coalesce((SELECT bool_or(regexp_matches(text, '[à-ï]')) FROM fx_transcript t WHERE t.page = p.page), true) AS translated FROM pages p)
SELECT page, translated, CASE WHEN translated THEN 'translated' ELSE 'clean_untranslated' END AS status, CASE WHEN translated THEN '' ELSE 'clean_untranslated/' END || replace(image, '.png', '_kh.png') AS target, translated AS in_book FROM f""")
def translated_pages(spark, sf):
    items = view(spark, sf, "fx_transcript")
    pages = items.groupBy("page").agg(F.min("chapter").alias("chapter")).withColumn("image", F.expr("concat('canvas_', cast(page as string), '.png')"))
    empty = items.where("item = 0").selectExpr("-1 - page as page", "0 as chapter", "'empty.png' as image")
    flagged = T.is_translated(pages.unionByName(empty), items, ["page"], ((0xE0, 0xEF),))
    return T.route_export(flagged).select("page", "translated", "status", "target", "in_book")


LAYOUT_ITEMS = NUMBERED.rstrip() + """, segs AS (SELECT chapter, page AS pack, printf('canvas_%03d.png', page) AS image, 700 AS width, CAST(900 + page AS INT) AS height FROM items GROUP BY chapter, page),
s AS (SELECT *, min(pack) OVER (PARTITION BY chapter) AS fp FROM segs), i AS (SELECT *, min(n) OVER (PARTITION BY chapter, page) AS fn FROM items)
"""


@query("layout_json", LAYOUT_ITEMS + _union(
    dict(p=0, page=0, s=0, n=0, text="""'{"chapter":"' || CAST(chapter AS VARCHAR) || '","lang":"en","segments": ['""", t="(SELECT DISTINCT chapter FROM items) c"),
    dict(p=1, page="pack", s=1, n=0, text="""CASE WHEN pack = fp THEN '' ELSE ',' END || '{"image":"' || image || '","width":' || CAST(width AS VARCHAR) || ',"height":' || CAST(height AS VARCHAR) || ',"items": ['""", t="s"),
    dict(p=1, page="page", s=2, n="n", text="""CASE WHEN n = fn THEN '' ELSE ',' END || '{"n":' || CAST(n AS VARCHAR) || ',"bbox":[' || CAST(x AS VARCHAR) || ',' || CAST(y AS VARCHAR) || ',' || CAST(w AS VARCHAR)
      || ',' || CAST(h AS VARCHAR) || '],"src":' || CAST(to_json(text) AS VARCHAR) || ',"kind":"' || kind || '"}'""", t="i"),
    dict(p=1, page="pack", s=3, n=0, text="']}'", t="s"),
    dict(p=4, page=0, s=4, n=0, text="']}'", t="(SELECT DISTINCT chapter FROM items) c"),
))
def layout_json(spark, sf):
    items = _items(spark, sf).withColumn("pack", F.col("page"))
    segs = items.select("chapter", "pack").distinct().selectExpr(
        "chapter", "pack", "format_string('canvas_%03d.png', pack) as image", "700 as width", "cast(900 + pack as int) as height"
    )
    return T.layout_json_lines(segs, items)


@query("saved_projects", FX + """, segs AS (SELECT chapter, page, count(*) AS c, min(page) OVER (PARTITION BY chapter) AS fp FROM fx_transcript GROUP BY chapter, page)
""" + _union(
    dict(p=0, page=0, s=0, n=0, text="""'{"layout":"layout.json","name":"p","seg_idx":0,"post_groups":[[1,4],[5,9]],"segments":['""", t="(SELECT DISTINCT chapter FROM segs) c"),
    dict(p=1, page="page", s=2, n=0, text="""CASE WHEN page = fp THEN '' ELSE ',' END || '{"image":"c' || CAST(page AS VARCHAR) || '.png","state":[{"n":' || CAST(c AS VARCHAR) || '}]'
      || CASE WHEN c > 5 THEN ',"work":"c' || CAST(page AS VARCHAR) || '_work.png"' ELSE '' END || '}'""", t="segs"),
    dict(p=4, page=0, s=4, n=0, text="']}'", t="(SELECT DISTINCT chapter FROM segs) c"),
))
def saved_projects(spark, sf):
    segs = view(spark, sf, "fx_transcript").groupBy("chapter", "page").agg(F.count("*").alias("c")).selectExpr(
        "chapter", "page as pos", "'layout.json' as layout", "'p' as name", "0 as seg_idx", "array(array(1, 4), array(5, 9)) as post_groups",
        "concat('c', cast(page as string), '.png') as image", "array(named_struct('n', c)) as state", "c > 5 as differs",
    )
    return T.project_lines(segs)


# numbers of 12, 20 and 45 digits, in replies, post lists and names
LONG = "repeat(CAST(1 + conv_id % 9 AS STRING), {n})"
LONG_ROWS = f"""SELECT conv_id AS chapter, turn AS seq, concat('000', {LONG.format(n=12)}, '. a ', role, chr(10), {LONG.format(n=20)}, ') b', chr(10), {LONG.format(n=45)}, ' - c', chr(10), 'POSTS: ',
  {LONG.format(n=12)}, '-', {LONG.format(n=20)}, ' | ', {LONG.format(n=45)}) AS text FROM {{t}}"""


@query("long_numbers", f"""WITH r AS ({LONG_ROWS.format(t='conversations').replace('STRING', 'VARCHAR')}), d AS (SELECT chapter, max(seq) AS seq FROM r GROUP BY chapter)
SELECT r.chapter, 'line' AS kind, repeat(CAST(1 + r.chapter % 9 AS VARCHAR), x.n) AS lo, '' AS hi FROM (SELECT DISTINCT chapter FROM r) r, (VALUES (12), (20), (45)) x(n)
UNION ALL SELECT chapter, 'post', repeat(CAST(1 + chapter % 9 AS VARCHAR), a), repeat(CAST(1 + chapter % 9 AS VARCHAR), b) FROM d, (VALUES (12, 20), (45, 45)) y(a, b)""")
def long_numbers(spark, sf):
    replies = spark.sql(LONG_ROWS, t=table(spark, sf, "conversations"))
    lines = T.parse_numbered(replies, seq="seq").select("chapter", F.lit("line").alias("kind"), F.col("n").alias("lo"), F.lit("").alias("hi"))
    last = replies.groupBy("chapter").agg(F.max_by("text", "seq").alias("text"))
    return lines.unionByName(T.posts_of(last).select("chapter", F.lit("post").alias("kind"), "lo", "hi"))


NAMED = "concat(CASE doc_id % 3 WHEN 0 THEN '' ELSE '0' END, repeat(CAST(1 + doc_id % 9 AS STRING), CASE doc_id % 4 WHEN 0 THEN 12 WHEN 1 THEN 20 WHEN 2 THEN 45 ELSE 2 END), 'p', CAST(doc_id AS STRING))"


@query("long_natural_order", f"""SELECT doc_id, name, row_number() OVER (ORDER BY length(ltrim(regexp_extract(name, '^[0-9]+'), '0')), ltrim(regexp_extract(name, '^[0-9]+'), '0'), doc_id) AS r
FROM (SELECT doc_id, {NAMED.replace('STRING', 'VARCHAR')} AS name FROM documents) x""")
def long_natural_order(spark, sf):
    from ..operators.ordering import ordinal

    names = _docs(spark, sf).select("doc_id", F.expr(NAMED).alias("name"), F.lit(0).alias("g")).withColumn("k", X.natural_key(F.col("name")))
    return ordinal(names, ["g"], ["k", "doc_id"], "r").select("doc_id", "name", "r")


# Documents as texts, written by SQL from the given tables; the checking SQL reads them with its own JSON functions.
TRANSCRIPTS = """SELECT concat('{"chapter": "c', CAST(conv_id AS STRING), '", "lang": "en", "pages": [{"page": ', CAST(conv_id AS STRING), ', "items": [{"n": ', CAST(turn AS STRING), ', "kind": "', role,
  '", "bbox": [1, 2, ', CAST(turn AS STRING), ', 4], "text": "a\\u00e9 ', role, '", "conf": 0.5}]}, {"page": 9, "items": []}', CASE WHEN turn = 3 THEN '' ELSE ']}' END) AS text FROM {t}"""


def _texts(spark, sf, sql, name):
    table(spark, sf, name).createOrReplaceTempView("given_rows")
    return spark.sql(sql.replace("{t}", "given_rows"))


def _docs_sql(sql: str, name: str) -> str:
    return sql.replace("AS STRING", "AS VARCHAR").replace("{t}", name)


@query("parsed_transcripts", f"""WITH d AS ({_docs_sql(TRANSCRIPTS, 'conversations')}),
p AS (SELECT text->>'chapter' AS chapter, unnest(CAST(text->'pages' AS JSON[])) AS p FROM d WHERE json_valid(text)),
i AS (SELECT chapter, CAST(p->>'page' AS BIGINT) AS page, unnest(CASE WHEN json_array_length(p->'items') = 0 THEN [NULL] ELSE CAST(p->'items' AS JSON[]) END) AS i FROM p)
SELECT chapter, page, CAST(i->>'n' AS INT) AS n, i->>'kind' AS kind, CAST(i->'bbox'->>2 AS INT) AS w, i->>'text' AS text, CAST(i->>'conf' AS DOUBLE) AS conf FROM i""")
def parsed_transcripts(spark, sf):
    return D.parse_transcripts(_texts(spark, sf, TRANSCRIPTS, "conversations")).select("chapter", "page", "n", "kind", "w", "text", "conf")


LAYOUTS = """SELECT concat('{"chapter": "', source, '", "lang": "', lang, '", "segments": [{"image": "a', CAST(doc_id AS STRING), '.png", "width": 700, "height": ', CAST(n_chars AS STRING),
  ', "items": [{"n": 1, "bbox": [0, 1, 2, 3], "src": "x", "kind": "sfx"}]}, {"image": "b.png", "width": 1, "height": 2, "items": []}]', CASE doc_id % 5 WHEN 0 THEN '' ELSE '}' END) AS text FROM {t}"""


@query("parsed_layouts", f"""WITH d AS ({_docs_sql(LAYOUTS, 'documents')}),
s AS (SELECT text->>'chapter' AS chapter, text->>'lang' AS lang, unnest([1, 2]) AS pack, unnest(CAST(text->'segments' AS JSON[])) AS s FROM d WHERE json_valid(text))
SELECT chapter, lang, pack, s->>'image' AS image, CAST(s->>'width' AS INT) AS width, CAST(s->>'height' AS INT) AS height FROM s""")
def parsed_layouts(spark, sf):
    return D.parse_layouts(_texts(spark, sf, LAYOUTS, "documents"))[0]


PROJECTS = """SELECT CAST(c_custkey AS STRING) AS source, concat('{"layout": "l', CAST(c_nationkey AS STRING), '.json", "name": "p", "seg_idx": ', CAST(c_nationkey AS STRING), ', "post_groups": [[1, ', CAST(c_nationkey AS STRING),
  '], [5, 9]], "segments": [{"image": "a.png", "state": [{"kind": "text", "n": ', CAST(c_custkey AS STRING), ', "text": "t", "x": 1.5}], "work": null}]}') AS text FROM {t}"""


@query("parsed_projects", f"""WITH d AS ({_docs_sql(PROJECTS, 'customer')})
SELECT source, k, CAST(text->'post_groups'->k->>0 AS INT) AS lo, CAST(text->'post_groups'->k->>1 AS INT) AS hi, CAST(text->'segments'->0->'state'->0->>'n' AS INT) AS n FROM d, (SELECT unnest([0, 1]) AS k) r""")
def parsed_projects(spark, sf):
    _, segments, posts = D.parse_projects(_texts(spark, sf, PROJECTS, "customer"))
    return posts.join(D.text_boxes(segments).select("source", "n"), "source").select("source", "k", "lo", "hi", "n")


RECENTS = """SELECT concat('[{"layout": "/p/', CAST(o_orderkey AS STRING), '.json", "chapter": "c", "saved_at": ', CAST(1700000000 + o_orderkey AS STRING), '.5}, {"chapter": "none"}, {"layout": "old", "thumb": "t.png", "saved_at": 0}]') AS text FROM {t}"""


@query("parsed_recents", f"""WITH d AS ({_docs_sql(RECENTS, 'orders')}), r AS (SELECT unnest([0, 2]) AS i)
SELECT text->i->>'layout' AS layout, coalesce(text->i->>'chapter', '') AS chapter, coalesce(text->i->>'thumb', '') AS thumb, make_timestamp(CAST(CAST(text->i->>'saved_at' AS DOUBLE) * 1000000 AS BIGINT)) AS saved_at, CAST(-i AS BIGINT) AS arrival FROM d, r""")
def parsed_recents(spark, sf):
    return D.parse_recents(_texts(spark, sf, RECENTS, "orders"))
