"""Text blocks shared by the checking SQL."""

from __future__ import annotations

URI = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"
WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(8232)||chr(8233)||chr(12288)"
TAG_BODY = r"""([\s/][^>"'']*(?:"[^"]*"[^>"'']*|''[^'']*''[^>"'']*)*)>"""
ATTR = r"""([^\s"''<>/=]+)(?:\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+))?"""
IN_TEXT = r"""(?i)https?://[^\s"''<>]+?\.(?:jpg|jpeg|png|webp)"""


def part(u: str, i: int) -> str:
    return f"regexp_extract({u}, '{URI}', {i})"


def strip(c: str) -> str:
    return f"trim({c}, {WS})"


def live(html: str) -> str:
    """HTML without comments, scripts and styles."""
    out = f"regexp_replace({html}, '(?s)<!--.*?-->', '', 'g')"
    return rf"regexp_replace({out}, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g')"


def tags(html: str, name: str) -> str:
    return f"regexp_extract_all({live(html)}, '(?i)<{name}{TAG_BODY}', 1)"


def attr(tag: str, name: str) -> str:
    """Value of the last attribute of that name, without quotes; '' when absent."""
    raw = (
        f"list_filter(list_zip(list_transform(regexp_extract_all({tag}, '{ATTR}', 1), lambda q: lower(q)), "
        f"regexp_extract_all({tag}, '{ATTR}', 2)), lambda p: p[1] = '{name}')[-1][2]"
    )
    v = f"regexp_replace(coalesce({raw}, ''), '^[\"'']|[\"'']$', '', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        v = f"replace({v}, '{entity}', '{char}')"
    return v


def merged(bp: str, rp: str) -> str:
    return (
        f"CASE WHEN starts_with({rp}, '/') THEN {rp} WHEN regexp_extract({bp}, '^(.*/)', 1) <> '' "
        f"THEN regexp_extract({bp}, '^(.*/)', 1) || {rp} ELSE '/' || {rp} END"
    )


def tidy(p: str) -> str:
    """Collapse empty parts and dot parts of a path that starts with a slash."""
    parts = f"list_filter(string_split({p}, '/')[2:], lambda s, i: s <> '' OR i = len(string_split({p}, '/')) - 1)"
    walk = (
        f"list_reduce(list_prepend('', {parts}), lambda acc, s: CASE WHEN s = '..' THEN regexp_replace(acc, '/[^/]*$', '') "
        f"WHEN s = '.' THEN acc ELSE acc || '/' || s END)"
    )
    shut = rf"CASE WHEN regexp_matches({p}, '(^|/)\.\.?$') THEN {walk} || '/' ELSE {walk} END"
    return rf"CASE WHEN regexp_matches({p}, '/\.\.?(/|$)|//') THEN (CASE WHEN ({shut}) = '' THEN '/' ELSE ({shut}) END) ELSE {p} END"


def join(b: str, r: str) -> str:
    site = f"lower({part(b, 1)}) || ':' || {part(b, 2)}"
    tail = f"{part(r, 5)} || {part(r, 7)}"
    return (
        f"CASE WHEN {r} = '' THEN {b} "
        f"WHEN {part(r, 1)} <> '' AND lower({part(r, 1)}) <> lower({part(b, 1)}) THEN {r} "
        f"WHEN {part(r, 2)} <> '' THEN lower({part(b, 1)}) || ':' || {part(r, 2)} || {part(r, 4)} || {tail} "
        f"WHEN {part(r, 4)} = '' THEN {site} || {part(b, 4)} || CASE WHEN {part(r, 6)} <> '' THEN {part(r, 5)} ELSE {part(b, 5)} END || {part(r, 7)} "
        f"ELSE {site} || {tidy('(' + merged(part(b, 4), part(r, 4)) + ')')} || {tail} END"
    )


def bare_path(u: str) -> str:
    """Path whose last part ends before its first semicolon."""
    full = part(u, 4)
    last = f"string_split({full}, '/')[-1]"
    return f"(left({full}, length({full}) - length({last})) || string_split({last}, ';')[1])"


def is_image(u: str) -> str:
    p = f"lower({bare_path(u)})"
    return (
        rf"(regexp_matches({p}, '\.(?:jpg|jpeg|png|webp|gif)$') AND NOT regexp_matches({p}, '-\d+x\d+\.(?:jpg|jpeg|png|webp|gif)$'))"
    )


def directory(u: str) -> str:
    return f"regexp_replace({u}, '/[^/]*$', '')"


def url_ext(u: str) -> str:
    return rf"lower(regexp_extract({bare_path(u)}, '[^/.][^/]*?(\.[^./]*)$', 1))"


# tags of fx_html with their position, base address and picked attribute
IMG_TAGS = f"""img_tags AS (
  SELECT page_id, url, pos, {attr('tag', 'class')} AS cls, a1, a2, a3, a4, a5 FROM (
    SELECT page_id, url, pos, tag, {attr('tag', 'data-src')} AS a1, {attr('tag', 'data-original')} AS a2,
      {attr('tag', 'data-lazy-src')} AS a3, {attr('tag', 'data-url')} AS a4, {attr('tag', 'src')} AS a5
    FROM (SELECT page_id, url, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos
          FROM (SELECT page_id, url, {tags('html', 'img')} AS tags FROM fx_html) t0) t1) t2
), img_raw AS (
  SELECT *, CASE WHEN a1 <> '' AND NOT starts_with({strip('a1')}, 'data:') THEN {strip('a1')}
    WHEN a2 <> '' AND NOT starts_with({strip('a2')}, 'data:') THEN {strip('a2')}
    WHEN a3 <> '' AND NOT starts_with({strip('a3')}, 'data:') THEN {strip('a3')}
    WHEN a4 <> '' AND NOT starts_with({strip('a4')}, 'data:') THEN {strip('a4')}
    WHEN a5 <> '' AND NOT starts_with({strip('a5')}, 'data:') THEN {strip('a5')} END AS ref FROM img_tags
), img_picked AS (
  SELECT page_id, pos, cls, {join('url', 'ref')} AS u FROM img_raw WHERE ref IS NOT NULL
), script_urls AS (
  SELECT page_id, 100000 + generate_subscripts(us, 1) AS pos, unnest(us) AS u
  FROM (SELECT page_id, regexp_extract_all(html, '{IN_TEXT}') AS us FROM fx_html) s
), loose AS (
  SELECT page_id, u, row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) AS pos
  FROM (SELECT page_id, pos, u FROM img_picked UNION ALL SELECT page_id, pos, u FROM script_urls) c
  WHERE {is_image('u')} GROUP BY page_id, u
)"""


def best_dir(source: str, min_best: int, keep: int) -> str:
    """Rows of ``source`` (page_id, u, pos) that the fullest-directory rule keeps."""
    return f"""(
  SELECT l.page_id, l.u, l.pos FROM {source} l JOIN (
    SELECT page_id, arg_max(d, (c, -p)) AS d, max(c) AS c, sum(c) AS n FROM (
      SELECT page_id, {directory('u')} AS d, count(*) AS c, min(pos) AS p FROM {source} GROUP BY ALL) g GROUP BY page_id
  ) b ON l.page_id = b.page_id AND ({directory('l.u')} = b.d OR (b.c < {min_best} AND b.n >= {keep})))"""
