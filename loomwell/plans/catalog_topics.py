"""Queries of topic pages: compilation, staleness and the catalogue of sources, with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.operators import topics as T
from loomwell.operators.lineage import cut
from loomwell.plans.adapters import Knowledge
from loomwell.plans.registry import query

N = "CAST(floor(doc_id / 12e0) AS BIGINT)"
RECORDS = "SELECT 'records/doc-' || CAST(doc_id AS STRING) AS slug, 'doc ' || CAST(doc_id AS STRING) AS title, 'record' AS type, md5({0}coalesce(text, '')) AS content_hash, CAST(length(coalesce(text, '')) AS BIGINT) AS chars FROM documents WHERE {1}"
#: Topics of up to twelve documents, some with an empty title, an unknown source, one source only, or a title that a page has.
REQUESTS = f"""SELECT 'topic/t-' || CAST({N} AS STRING) AS topic, CASE WHEN {N} % 17 = 3 THEN ' ' WHEN {N} % 23 = 5 THEN 'NATION_3' ELSE 'Topic ' || CAST({N} AS STRING) END AS title, 'records/doc-' || CAST(doc_id AS STRING) AS source
  FROM documents WHERE doc_id % 12 <= {N} % 12
  UNION ALL SELECT 'topic/t-' || CAST({N} AS STRING), CASE WHEN {N} % 17 = 3 THEN ' ' WHEN {N} % 23 = 5 THEN 'NATION_3' ELSE 'Topic ' || CAST({N} AS STRING) END, 'records/none' FROM documents WHERE doc_id % 12 = 0 AND {N} % 10 = 4"""
#: Some records are withdrawn by a rejected link; later some texts change, some tags are added, some records are gone.
LINKS = "SELECT from_slug, to_slug, link_key, trust_state FROM klinks WHERE relation = 'mentions' UNION ALL SELECT 'records/doc-' || CAST(doc_id AS STRING), 'entity/location/n-1', 'x' || CAST(doc_id AS STRING), 'rejected' FROM documents WHERE doc_id % 19 = 0"
TAGS = "SELECT page_slug, tag FROM ktags WHERE page_slug LIKE 'records/%'"
LATER_TAGS = f"{TAGS} UNION ALL SELECT 'records/doc-' || CAST(doc_id AS STRING), 'later' FROM documents WHERE doc_id % 31 = 5"


def found(k: Knowledge, later: bool = False) -> DataFrame:
    pages = k.sql(RECORDS.format("CASE WHEN doc_id % 25 = 3 THEN 'new ' ELSE '' END || ", "doc_id % 41 <> 7") if later else RECORDS.format("", "true"))
    return T.sources(pages, T.governance(k.sql(LATER_TAGS if later else TAGS), k.sql(LINKS), k.ktimeline.filter("page_slug LIKE 'records/%'")))


def compiled(k: Knowledge) -> tuple[DataFrame, T.Topics, DataFrame]:
    """The plan, the topics after it, and the sources that they were made of."""
    spark = k.spark
    none = T.Topics(spark.createDataFrame([], "topic string, source string, content_hash string, gov_n long, gov_sum decimal(38,0)"), spark.createDataFrame([], "topic string, title string, output_hash string, state string, catalogue decimal(38,0)"))
    now, requests = cut(found(k)), k.sql(REQUESTS)
    plan = cut(T.compile_plan(requests, now, k.kpages, none, spark.createDataFrame([], "topic string, body_hash string, indexed boolean")))
    out = T.committed(plan, requests, now, none, plan.select("topic", F.md5("topic").alias("output_hash")), T.catalogue(now))
    return plan, T.Topics(cut(out.manifest), cut(out.heads)), now


def bodies(topics: T.Topics) -> DataFrame:
    """The topics' pages: one in nine edited by hand, one in thirteen not indexed."""
    n = F.regexp_extract("topic", r"(\d+)$", 1).cast("long")
    return topics.heads.select("topic", F.md5(F.concat(F.when(n % 9 == 2, "edited ").otherwise(""), F.col("topic"))).alias("body_hash"), (n % 13 != 1).alias("indexed"))


def states(k: Knowledge) -> DataFrame:
    _, topics, _ = compiled(k)
    later = cut(found(k, later=True))
    return T.inspect(topics, later, bodies(topics), T.catalogue(later))


def again(k: Knowledge) -> DataFrame:
    """The second compilation: what has not changed stays, the rest is refreshed or blocked."""
    _, topics, _ = compiled(k)
    pages = k.kpages.select("slug", "title", "type").unionByName(topics.heads.select(F.col("topic").alias("slug"), "title", F.lit("topic").alias("type")))
    return T.compile_plan(k.sql(REQUESTS), found(k, later=True), pages, topics, bodies(topics)).groupBy("status", "reason").agg(F.count("*").alias("n"))


PLAN = f"""WITH r AS ({REQUESTS}), s AS (SELECT r.topic, r.title, r.source, d.doc_id, d.doc_id IS NOT NULL AND d.doc_id % 19 <> 0 AS usable FROM (SELECT DISTINCT topic, title, source FROM r) r LEFT JOIN documents d ON r.source = 'records/doc-' || CAST(d.doc_id AS STRING)),
  p AS (SELECT topic, max(title) AS title, count(*) AS asked, count(*) FILTER (usable) AS usable, count(*) FILTER (doc_id IS NULL) AS unknown, count(*) FILTER (NOT usable AND doc_id IS NOT NULL) AS withdrawn FROM s GROUP BY topic),
  plan AS (SELECT topic, title, usable, CASE WHEN trim(title) = '' THEN 'invalid_title' WHEN asked > 20 THEN 'too_many_sources' WHEN title = 'NATION_3' THEN 'title_conflict' WHEN unknown > 0 THEN 'source_not_found' WHEN withdrawn > 0 THEN 'source_governance_rejected' WHEN usable < 2 THEN 'too_few_sources'
      WHEN (SELECT sum(length(text)) FROM s JOIN documents d ON d.doc_id = s.doc_id WHERE s.topic = p.topic) > 200000 THEN 'material_over_budget' END AS reason FROM p),
  made AS (SELECT topic, CAST(regexp_extract(topic, '(\\d+)$', 1) AS BIGINT) AS n FROM plan WHERE reason IS NULL),
  m AS (SELECT s.topic, s.source, CASE WHEN doc_id % 41 = 7 THEN '1 source_missing' WHEN doc_id % 25 = 3 THEN '3 content_changed' WHEN doc_id % 31 = 5 THEN '4 governance_changed' END AS why FROM s JOIN made ON made.topic = s.topic WHERE usable)"""
query("n13_compile_plan", lambda k: compiled(k)[0].select("topic", "status", "reason", "n_sources"), f"{PLAN} SELECT topic, CASE WHEN reason IS NULL THEN 'created' ELSE 'blocked' END AS status, reason, usable AS n_sources FROM plan")
query("n13_topic_states", states,
      f"""{PLAN}, w AS (SELECT made.topic, n, min(why) AS why FROM made JOIN m ON m.topic = made.topic GROUP BY 1, 2), x AS (SELECT topic, CASE WHEN n % 9 = 2 THEN 'edited_by_user' WHEN n % 13 = 1 THEN 'index_pending_or_dirty' ELSE substring(why, 3) END AS reason FROM w)
          SELECT topic, CASE WHEN reason IS NULL THEN 'fresh' ELSE 'stale' END AS state, reason, true AS catalogue_changed FROM x""")
query("n13_stale_topics", lambda k: (lambda c: T.stale_topics(c[1], found(k, later=True).filter(F.regexp_extract("slug", r"(\d+)$", 1).cast("long") % 25 == 3)))(compiled(k)), f"{PLAN} SELECT DISTINCT topic, source FROM m WHERE why = '3 content_changed'")
query("n13_recompile", again,
      f"""{PLAN}, f AS (SELECT s.topic, count(*) FILTER (usable AND doc_id % 41 <> 7) AS now_usable, count(*) FILTER (doc_id IS NULL OR doc_id % 41 = 7) AS now_unknown FROM s GROUP BY 1), w AS (SELECT topic, min(why) AS why FROM m GROUP BY 1),
          x AS (SELECT CASE WHEN made.topic IS NULL THEN CASE WHEN plan.reason IN ('invalid_title', 'title_conflict', 'too_many_sources') THEN plan.reason WHEN now_unknown > 0 THEN 'source_not_found' ELSE plan.reason END WHEN made.n % 9 = 2 THEN 'target_edited' END AS reason, made.n, why FROM plan JOIN f ON f.topic = plan.topic LEFT JOIN made ON made.topic = plan.topic LEFT JOIN w ON w.topic = plan.topic)
          SELECT CASE WHEN reason IS NOT NULL THEN 'blocked' WHEN why IS NULL AND n % 13 <> 1 THEN 'unchanged' ELSE 'refreshed' END AS status, reason, count(*) AS n FROM x GROUP BY 1, 2""")


def catalogues(k: Knowledge) -> DataFrame:
    """The catalogue, and whether the one carried forward from the changed sources alone equals it."""
    before, later = cut(found(k)), cut(found(k, later=True))
    moved = lambda t: t.filter("CAST(regexp_extract(slug, '([0-9]+)$', 1) AS BIGINT) % 25 = 3 OR CAST(regexp_extract(slug, '([0-9]+)$', 1) AS BIGINT) % 31 = 5 OR CAST(regexp_extract(slug, '([0-9]+)$', 1) AS BIGINT) % 41 = 7")
    carried = T.changed_catalogue(T.catalogue(before), moved(before), moved(later)).select(F.col("n").alias("n2"), F.col("digest").alias("digest2"))
    return T.catalogue(later).crossJoin(F.broadcast(carried)).select("n", ((F.col("n") == F.col("n2")) & (F.col("digest") == F.col("digest2"))).alias("same"))  # one row each


query("n13_catalogue", catalogues, "SELECT count(*) AS n, true AS same FROM documents WHERE doc_id % 19 <> 0 AND doc_id % 41 <> 7")
