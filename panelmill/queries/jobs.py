"""Queries over job tables: ledgers, registries, progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs as J, textflow as T
from ..sources.fixtures import ctes, table, view
from . import query
from .layout import SPARSE


@query("chapter_ledger", ctes("fx_attempts") + """
SELECT chapter, count(*) FILTER (WHERE ok) AS n_pages, count(*) FILTER (WHERE NOT ok) AS n_errors,
  CASE WHEN count(*) FILTER (WHERE ok) > 0 THEN 'done' WHEN count(*) FILTER (WHERE NOT ok) > 0 THEN 'failed' ELSE 'skipped' END AS status FROM fx_attempts GROUP BY chapter""")
def chapter_ledger(spark, sf):
    return J.ledger(view(spark, sf, "fx_attempts"))


@query("page_outcomes", ctes("fx_attempts") + "SELECT tier, count(*) FILTER (WHERE ok) AS good, count(*) FILTER (WHERE NOT ok) AS bad FROM fx_attempts GROUP BY tier")
def page_outcomes(spark, sf):
    results = view(spark, sf, "fx_attempts").withColumn("error", F.expr("case when not ok then 'failed' end"))
    return J.require_any(results, ["tier"])


@query("recent_projects", ctes("fx_recents") + """
SELECT layout, chapter, saved_at, arrival FROM (SELECT *, row_number() OVER (PARTITION BY layout ORDER BY arrival DESC) AS r FROM fx_recents) x WHERE r = 1 ORDER BY arrival DESC LIMIT 30""")
def recent_projects(spark, sf):
    return J.upsert_recent(view(spark, sf, "fx_recents"))


@query("recent_labels", ctes("fx_recents") + """
SELECT layout, arrival, CASE WHEN c <> '' THEN c ELSE coalesce(string_split(layout, '/')[-3], '') END AS name, strftime(saved_at, '%b %d, %H:%M') AS shown
FROM (SELECT *, CASE WHEN chapter = 'error' THEN '' ELSE chapter END AS c FROM fx_recents) x""")
def recent_labels(spark, sf):
    recents = view(spark, sf, "fx_recents").withColumn("chapter", F.expr("case when chapter = 'error' then '' else chapter end"))
    return J.labels(recents).select("layout", "arrival", "name", "shown")


LISTING = "SELECT concat('/p/', CAST(c_custkey AS STRING), '/layout.json') AS layout FROM {t} WHERE c_custkey % 3 <> 0"


@query("live_projects", ctes("fx_recents") + f"SELECT layout, arrival FROM fx_recents r WHERE EXISTS (SELECT 1 FROM ({LISTING.format(t='customer')}) l WHERE l.layout = r.layout)")
def live_projects(spark, sf):
    listing = spark.sql(LISTING, t=table(spark, sf, "customer"))
    return J.live(view(spark, sf, "fx_recents"), listing).select("layout", "arrival")


@query("resumed_segments", ctes("fx_images", "fx_recents") + """, saved AS (
  SELECT CAST(substr(layout, 4, length(layout) - 15) AS BIGINT) AS image_id, chapter AS state, arrival FROM fx_recents WHERE chapter <> 'view')
SELECT i.image_id, i.fname, state, CAST(CASE WHEN seq > 7 THEN 7 ELSE seq END AS BIGINT) AS at FROM fx_images i LEFT JOIN (SELECT image_id, arg_max(state, arrival) AS state FROM saved GROUP BY image_id) s USING (image_id)""")
def resumed_segments(spark, sf):
    saved = view(spark, sf, "fx_recents").selectExpr("cast(substr(layout, 4, length(layout) - 15) as bigint) as image_id", "case chapter when 'view' then '' else chapter end as state", "arrival")
    layout = view(spark, sf, "fx_images").select("image_id", "fname", T.clamp_index(F.col("seq"), F.lit(8)).cast("bigint").alias("at"))
    return T.project_merge(layout, saved, ["image_id"], "arrival")


@query("missing_labels", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_labels(spark, sf):
    return J.missing(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("stage_progress", ctes("fx_progress") + """, t AS (SELECT job_id, count(*) AS total FROM fx_progress GROUP BY job_id)
SELECT job_id, stage, done, last_ts, total, round(done / total, 6) AS share FROM (SELECT job_id, stage, count(*) AS done, max(ts) AS last_ts FROM fx_progress GROUP BY job_id, stage) d JOIN t USING (job_id)""")
def stage_progress(spark, sf):
    return J.progress(view(spark, sf, "fx_progress"))


@query("worked_seconds", ctes("fx_progress") + """, o AS (
  SELECT job_id, epoch_us(ts) AS s, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS r, max(epoch_us(ts)) OVER (PARTITION BY job_id) AS e FROM fx_progress),
p AS (SELECT job_id, CAST(max(e) - min(s) - sum(CASE WHEN r % 2 = 0 THEN coalesce(nxt, e) - s ELSE 0 END) AS BIGINT) AS us FROM (
  SELECT *, lead(s) OVER (PARTITION BY job_id ORDER BY r) AS nxt FROM o) x GROUP BY job_id)
SELECT job_id, us / 1000000 AS seconds, printf('%02d:%02d', us // 60000000, (us // 1000000) % 60) AS shown FROM p""")
def worked_seconds(spark, sf):
    """Every second event of a job pauses it, the next one resumes; the last ends it."""
    from ..operators.ordering import ordinal

    ranked = ordinal(view(spark, sf, "fx_progress").select("job_id", "ts", "event_id"), ["job_id"], ["ts", "event_id"], "r")
    toggles = ranked.selectExpr("job_id", "ts", "case when r = 1 then 'start' when r % 2 = 0 then 'pause' else 'resume' end as kind")
    ends = ranked.groupBy("job_id").agg(F.max("ts").alias("ts")).withColumn("kind", F.lit("end"))
    worked = J.elapsed(toggles.unionByName(ends))
    return worked.withColumn("shown", J.clock(F.col("seconds")))


BUNDLES = """SELECT source AS chapter, 'chapter_' || lpad(substr(source, 4), CAST(greatest(4, length(source) - 3) AS INT), '0') || '.zip' AS archive, {seq} AS seq, CAST(doc_id AS VARCHAR) || '.txt' AS name,
  CAST(octet_length(encode(text)) AS BIGINT) AS size, CAST(coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY {seq} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM documents"""


def _bundles(spark, sf, seq):
    files = table(spark, sf, "documents").selectExpr(
        "source as chapter", "cast(substr(source, 4) as int) as ch", f"{seq} as seq", "concat(cast(doc_id as string), '.txt') as name", "cast(octet_length(text) as bigint) as size"
    )
    return J.bundle_files(files)


@query("chapter_bundles", BUNDLES.format(seq="doc_id"))
def chapter_bundles(spark, sf):
    """The files of every chapter's archive, with their order and places."""
    return _bundles(spark, sf, "doc_id")


@query("sparse_chapter_bundles", BUNDLES.format(seq=SPARSE))
def sparse_chapter_bundles(spark, sf):
    return _bundles(spark, sf, SPARSE)
