"""Test inputs: views over the given tables that stand for pages, boxes, rows, items and logs.

Each view is one SQL text that runs unchanged on Spark and on the checking engine. None
uses a window, so a view scales with its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_images": """
SELECT doc_id AS image_id, source AS chapter, doc_id AS seq, concat('p', CAST(doc_id AS STRING), '.jpg') AS fname,
  CASE lang WHEN 'en' THEN 800 WHEN 'de' THEN 720 WHEN 'fr' THEN 690 ELSE 1000 END AS w,
  CAST(n_chars AS INT) AS h FROM documents""",
    "fx_boxes": """
SELECT l_orderkey AS image_id,
  l_linenumber * CAST(1000000000000 AS BIGINT) + CAST(round(l_extendedprice * 100) AS BIGINT) * 1000 + l_suppkey % 1000 AS box_id,
  CAST(l_partkey % 200 AS INT) AS x1, CAST((l_partkey * 7 + l_suppkey * 13) % 400 AS INT) AS y1,
  CAST(l_partkey % 200 + 40 + 2 * CAST(l_quantity AS INT) AS INT) AS x2,
  CAST((l_partkey * 7 + l_suppkey * 13) % 400 + 10 + CAST(l_quantity AS INT) AS INT) AS y2,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label, l_discount * 10 AS score FROM lineitem""",
    "fx_pixrows": """
SELECT CAST(floor(vec_id / 200) AS BIGINT) AS image_id, CAST(vec_id % 200 AS INT) AS y, embedding AS px_raw FROM embeddings""",
    "fx_transcript": """
SELECT CAST(floor(conv_id / 10) AS INT) AS chapter, conv_id AS page, CAST(turn AS INT) AS item,
  CASE role WHEN 'assistant' THEN 'bubble' ELSE 'sfx' END AS kind, text FROM conversations""",
    "fx_attempts": """
SELECT user_id AS chapter, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS tier,
  event_id AS path_id, event_type <> 'error' AS ok FROM events""",
    "fx_recents": """
SELECT concat('/p/', CAST(user_id AS STRING), '/layout.json') AS layout, event_type AS chapter,
  ts AS saved_at, event_id AS arrival FROM events""",
    "fx_progress": """
SELECT event_id, ts, user_id AS job_id,
  CASE event_type WHEN 'view' THEN 'download' WHEN 'click' THEN 'clean'
       WHEN 'signup' THEN 'transcript' ELSE 'stitch' END AS stage FROM events""",
    "fx_html": """
SELECT page_id, url, concat(
  CASE WHEN page_id % 2 = 0 THEN concat('<img class="wp-manga chapter-img" data-src=" /up/', CAST(page_id AS STRING), '/1.jpg ">',
    '<img class="wp-manga chapter-img" src="/up/', CAST(page_id AS STRING), '/2.jpg">') ELSE '' END,
  '<img src="data:image/gif,AA" data-original="/b/', CAST(page_id AS STRING), '/2.webp">',
  '<img src="/b/', CAST(page_id AS STRING), '/3.PNG"><img src="/b/', CAST(page_id AS STRING), '/3.PNG">',
  CASE WHEN page_id % 3 = 0 THEN concat('<script>var p="https://cdn.example.com/b/', CAST(page_id AS STRING), '/4.jpg?v=1"</script>') ELSE '' END,
  '<img src="/b/', CAST(page_id AS STRING), '/5.gif"><img class="logo" src="/static/logo-75x106.png"><img src="/static/a.png">', html) AS html FROM pages""",
}

TABLES = {
    "fx_images": "documents", "fx_boxes": "lineitem", "fx_pixrows": "embeddings", "fx_transcript": "conversations",
    "fx_attempts": "events", "fx_recents": "events", "fx_progress": "events", "fx_html": "pages",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the parquet tables of ``sf_dir``."""
    base = TABLES[name]
    return spark.sql(VIEWS[name].replace(f"FROM {base}", "FROM {base}"), base=table(spark, sf_dir, base))


def ctes(*names: str) -> str:
    """The same views as a WITH clause for the checking engine."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
