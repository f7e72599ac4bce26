"""The registered queries of this folder: each operator over its whole table, with the SQL that checks it where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, licenses, lm, mixing, neardup, packing, passages, pii, quality, repeats, tokens, topk, turntrie
from . import query
from .common import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query(
    "op2_max_score",
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.scaled(F.col("embedding")).alias("v"))
    return topk.top_k(rows.where("vec_id % 50 = 0"), rows, 5)


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), 2048)


@query(
    "op4_odd_sketch",
    r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM d
), x AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s
), common AS (
  SELECT a.doc_id AS i, b.doc_id AS j, a.n AS n, b.n AS m, count(*) AS c FROM x a JOIN x b USING (t) WHERE a.doc_id < b.doc_id
  AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL
), link AS (
  SELECT i, j FROM common WHERE 100 * c >= 85 * (n + m - c)
), edge AS (
  SELECT i, j FROM link UNION ALL SELECT j, i FROM link
), reach AS (
  SELECT doc_id, doc_id AS node FROM s UNION SELECT reach.doc_id, edge.j FROM reach JOIN edge ON reach.node = edge.i
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM s JOIN (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 85)


@query("op5_domain_mix")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = mixing.mix_sources(docs, table(spark, sf_dir, "labels"), carry=["doc_id"])
    return out.select("doc_id", "n_tokens", "p_clean", "p_junk", "p_toxic", "rate", "copies")


@query("op6_pitman_yor")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    "op7_run_length_index",
    """
WITH d AS (
  SELECT row_number() OVER () AS i, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), g AS (
  SELECT i, doc_id, p, substr(h, 2 * p + 1, 100) AS s
  FROM (SELECT i, doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS p FROM d) u
), early AS (
  SELECT s, min(doc_id) AS least FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)
), bad AS (
  SELECT i, p FROM g JOIN early USING (s) WHERE doc_id > least
), steps AS (
  SELECT i, p, p > lag(p) OVER (PARTITION BY i ORDER BY p) + 50 IS NOT FALSE AS opens FROM bad
), runs AS (
  SELECT i, min(p) AS lo, max(p) + 50 AS hi FROM (SELECT i, p, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY i ORDER BY p) AS run FROM steps) r
  GROUP BY i, run
), gaps AS (
  SELECT i, lo, hi, coalesce(lag(hi) OVER (PARTITION BY i ORDER BY lo), 0) AS since FROM runs
), kept AS (
  SELECT i, string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS k,
    sum(hi - lo) AS n, count(*) AS spans FROM gaps JOIN d USING (i) GROUP BY i
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (i)""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 50)
    removed = F.reduce("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


LINE = r"regexp_replace(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[ \x09-\x0D]+|[ \x09-\x0D]+$', '', 'g'), '[ \x09-\x0D]+', ' ', 'g')"


@query(
    "op8_line_frequency",
    rf"""
WITH d AS (
  SELECT row_number() OVER () AS i, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^ \x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS l FROM d
), t AS (
  SELECT i, p, w[p] || chr(10) || w[p + 1] || chr(10) || w[p + 2] AS t FROM (SELECT i, w, unnest(range(1, len(w) - 1)) AS p FROM w) u
), twice AS (
  SELECT i, p FROM t QUALIFY count(*) OVER (PARTITION BY i, t) > 1
), rep AS (
  SELECT i, count(DISTINCT p + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) o GROUP BY i
), base AS (
  SELECT i, doc_id, source, list_transform(l, lambda x: {LINE.format("x")}) AS content, len(w) AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (i)
), texts AS (
  SELECT DISTINCT source, content FROM base
), hosts AS (
  SELECT source, count(*) AS total FROM texts GROUP BY source
), each AS (
  SELECT source, content, x, count(*) * (len(x) - len(replace(x, ' ', '')) + 1) AS words
  FROM (SELECT source, content, unnest(content) AS x FROM texts) u GROUP BY source, content, x
), common AS (
  SELECT source, x FROM each JOIN hosts USING (source) GROUP BY source, x, total HAVING count(*) > 10 AND count(*) > total * 0.05
), gone AS (
  SELECT source, content, sum(words) AS words FROM each JOIN common USING (source, x) GROUP BY source, content
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND n_words - coalesce(words, 0) >= 50 AND n_words - coalesce(words, 0) >= n_words * 0.3 AS kept
FROM failed LEFT JOIN gone ON failed.source IS NOT DISTINCT FROM gone.source AND failed.content = gone.content""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op9_feistel_pseudonyms")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, "panelmill").select("doc_id", "text", "n_numbers", "n_dates", "n_names")


def _templates() -> str:
    rows = ((n, b) for n, b in sorted((n, licenses.bigrams_in(t)) for n, t in licenses.NOTICES.items()))
    return ", ".join(f"('{n}', [{', '.join(repr(x) for x in b)}])" for n, b in rows)


@query(
    "op10_license_scan",
    rf"""
WITH tpl AS (
  SELECT * FROM (VALUES {_templates()}) t(license, b)
), d AS (
  SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS text FROM documents
), u AS (
  SELECT i, s FROM (SELECT i, unnest(string_split(text, chr(10))) AS s FROM d) l
  UNION ALL SELECT i, text FROM d WHERE contains(text, chr(10))
), words AS (
  SELECT i, list_filter(string_split(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM u
), g AS (
  SELECT i, list_distinct(list_transform(range(1, len(w)), lambda p: w[p] || ' ' || w[p + 1])) AS b FROM words WHERE len(w) > 1
), m AS (
  SELECT i, license, 2.0::DOUBLE * len(list_intersect(g.b, tpl.b)) / (len(g.b) + len(tpl.b)) AS dice FROM g, tpl
), hit AS (
  SELECT i, count(*) AS n, max(dice) AS dice, arg_min(license, (-dice, license)) AS license FROM m WHERE dice >= 0.8 GROUP BY i
)
SELECT doc_id, CAST(coalesce(n, 0) AS INT) AS n_licenses, license, dice FROM d LEFT JOIN hit USING (i)""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_licenses", "license", "dice")


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), pieces())


def _crc_table() -> list[int]:
    """Remainders of single bytes by the CRC-32 polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in table]
    return table


@query(
    "op12_turn_trie",
    rf"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''),
    lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, ({_crc_table()}::BIGINT[])[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t) ids
), m AS (
  SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = base AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h
), r AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, role, text FROM m
), p AS (
  SELECT conv_id, depth, list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY depth) AS k,
    len(regexp_extract_all(text, '[^ 	-]+')) AS words FROM r
  UNION ALL SELECT conv_id, 0, [], 0 FROM c
), q AS (
  SELECT conv_id, depth, sha256(array_to_string(k, ',')) AS k, words, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p
), path AS (
  SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY depth) AS pk FROM q
), n AS (
  SELECT depth, k, any_value(pk) AS pk, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own,
    sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM path GROUP BY depth, k
), kids AS (
  SELECT depth - 1 AS depth, pk AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL
), node AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (depth, k)
), sub AS (
  SELECT q.depth, q.k, sum(own) AS saved_tokens, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
  FROM node JOIN q ON q.conv_id = node.conv_id AND q.depth <= node.depth GROUP BY ALL
)
SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, b.conv_id AS parent_conv_id, a.n_convs, CAST(a.n_children AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, a.ends_sha256
FROM node a JOIN sub USING (depth, k) LEFT JOIN node b ON b.depth = a.depth - 1 AND b.k = a.pk""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turntrie.ordered(table(spark, sf_dir, "conversations"))
    return turntrie.prefix_trie(turntrie.with_openings(turns), turns.select("conv_id"))


@query(
    "op13_fm_index",
    r"""
WITH d AS (
  SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT i, doc_id, p, array_to_string(w[p : p + 49], ' ') AS s FROM (SELECT i, doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d) u
), early AS (
  SELECT s, min(doc_id) AS least FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)
), bad AS (
  SELECT i, list(p) AS ps FROM g JOIN early USING (s) WHERE doc_id > least GROUP BY i
), gone AS (
  SELECT i, list_distinct(flatten(list_transform(ps, lambda x: range(x, x + 50)))) AS gone FROM bad
), kept AS (
  SELECT doc_id, w, CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)),
    lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END AS kept
  FROM d LEFT JOIN gone USING (i)
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM kept""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), 50)
    removed = F.reduce("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), "kept_sha256")
