"""Queries of mentions, organisations, routed texts, extraction, seals, dossiers, project state, logs and review, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwell.operators import intake as T
from loomwell.plans.adapters import ORDER_AS_OF
from loomwell.plans.catalog_relational import ACTIVE, CURRENT
from loomwell.plans.registry import query

# ---- links from pages ----
PLACE, ALIAS = "'NATION_' || CAST(doc_id % 30 AS STRING)", "'cust ' || CAST(doc_id % 90 AS STRING)"
NOTED = f"SELECT 'records/doc-' || CAST(doc_id AS STRING) AS slug, 'in [[' || {PLACE} || ']] and [[brain/places/' || {PLACE} || '|there]], [[' || {ALIAS} || ']], [[red widget]], [[NATION_1|考虑]] `[[NATION_2]]` ![[NATION_3]] [[NATION_4.pdf]]' AS body FROM documents"
ONE_TITLE = "SELECT title AS name, min(slug) AS slug FROM kpages WHERE trim(title) <> '' GROUP BY title HAVING count(*) = 1"
ONE_ALIAS = "SELECT alias AS name, min(page_slug) AS slug FROM (SELECT DISTINCT alias, page_slug FROM kaliases) a GROUP BY alias HAVING count(*) = 1"
EDGES = f"""WITH l AS (SELECT 'records/doc-' || CAST(doc_id AS VARCHAR) AS from_slug, unnest(['NATION_' || CAST(doc_id % 30 AS VARCHAR), 'cust ' || CAST(doc_id % 90 AS VARCHAR), 'red widget']) AS name FROM documents), t AS ({ONE_TITLE}), a AS ({ONE_ALIAS})
  SELECT DISTINCT from_slug, coalesce(t.slug, a.slug) AS to_slug, '提及' AS relation, 'wikilink' AS source_type FROM l LEFT JOIN t ON t.name = l.name LEFT JOIN a ON a.name = l.name WHERE coalesce(t.slug, a.slug) IS NOT NULL"""
edges = lambda k: T.mention_edges(k.sql(NOTED), k.kpages, k.kaliases)
query("n4_mention_edges", edges, EDGES)
query("n4_mention_changes", lambda k: T.mention_changes(k.klinks.filter("relation = 'mentions'").select("from_slug", F.lit("entity/location/n-3").alias("to_slug")), edges(k)),
      f"SELECT to_slug AS slug, count(*) AS delta FROM ({EDGES}) e WHERE NOT (to_slug = 'entity/location/n-3' AND from_slug IN (SELECT from_slug FROM klinks WHERE relation = 'mentions')) GROUP BY 1")
STATED = """SELECT 'entity/person/c-' || CAST(c_custkey AS STRING) AS slug, CASE CAST(c_custkey % 8 AS INT) WHEN 0 THEN ' Supplier#000000001 ' WHEN 1 THEN 'entity/company/s-2' WHEN 2 THEN 'cust ' || CAST(c_custkey AS STRING) WHEN 3 THEN 'red widget' WHEN 4 THEN 'NATION_3' WHEN 5 THEN 'entity/person/c-' || CAST(c_custkey AS STRING) WHEN 6 THEN ' ' ELSE 'nowhere' END AS organization,
  CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'manual' WHEN 1 THEN 'agent' WHEN 2 THEN 'manual' WHEN 3 THEN 'ner' END AS organization_source FROM customer UNION ALL SELECT 'entity/company/s-' || CAST(s_suppkey AS STRING), s_name, 'manual' FROM supplier"""
query("n5_organisations", lambda k: T.organisations(k.sql(STATED), k.kpages, k.kaliases),
      f"""WITH s AS (SELECT *, trim(organization) AS org FROM ({STATED}) x), t AS (SELECT title, count(*) AS n, min(slug) AS slug FROM kpages WHERE trim(title) <> '' GROUP BY 1), a AS (SELECT alias, count(*) AS n, min(page_slug) AS slug FROM kaliases GROUP BY 1),
          j AS (SELECT s.*, own.type AS own, p.slug IS NOT NULL AS is_page, t.n AS tn, a.n AS an, CASE WHEN p.slug IS NOT NULL THEN p.slug WHEN t.n = 1 THEN t.slug WHEN t.n IS NULL AND a.n = 1 THEN a.slug END AS target FROM s LEFT JOIN kpages own ON own.slug = s.slug LEFT JOIN kpages p ON p.slug = org LEFT JOIN t ON t.title = org LEFT JOIN a ON a.alias = org),
          r AS (SELECT j.*, CASE WHEN coalesce(organization_source, '') = '' THEN 'missing_source' WHEN organization_source NOT IN ('manual', 'agent') THEN 'untrusted_source' WHEN own IS DISTINCT FROM 'entity/person' THEN 'invalid_source_type' WHEN coalesce(org, '') = '' THEN 'invalid_organization' WHEN NOT is_page AND tn > 1 THEN 'ambiguous_title' WHEN NOT is_page AND tn IS NULL AND an > 1 THEN 'ambiguous_alias'
            WHEN target IS NULL THEN 'target_not_found' WHEN target = j.slug THEN 'self_reference' WHEN tp.type NOT IN ('entity/company', 'entity/organization') THEN 'invalid_target_type' END AS reason FROM j LEFT JOIN kpages tp ON tp.slug = target) SELECT slug, CASE WHEN reason IS NULL THEN target END AS target, CASE WHEN reason IS NULL THEN 'projected' ELSE 'skipped' END AS status, reason FROM r""")

# ---- routed texts ----
SENT = """SELECT doc_id AS id, CASE CAST(doc_id % 8 AS INT) WHEN 0 THEN '---' || chr(10) || 'title: Doc ' || CAST(doc_id AS STRING) || chr(10) || '---' || chr(10) || 'body ' || CAST(doc_id AS STRING) WHEN 1 THEN ' !!' || chr(10) || 'plain line ' || CAST(doc_id AS STRING) || chr(10) || 'more' WHEN 2 THEN '?? !' WHEN 3 THEN 'known body' WHEN 4 THEN 'said something new' WHEN 5 THEN 'old block'
  WHEN 6 THEN '---' || chr(10) || 'title: x' || chr(10) || 'slug: entity/location/n-1' || chr(10) || '---' || chr(10) || 'update ' || CAST(doc_id AS STRING) ELSE 'same for all' END AS content, CASE CAST(doc_id % 8 AS INT) WHEN 3 THEN 'Three' WHEN 4 THEN 'Customer#000000001' WHEN 5 THEN 'Customer#000000002' WHEN 7 THEN CASE WHEN doc_id % 3 = 0 THEN '/etc/passwd' ELSE 'Seven' END END AS title FROM documents"""
KNOWN = "SELECT 'records/a' AS slug, 'known body' AS body UNION ALL SELECT 'entity/person/c-2', 'before' || chr(10) || 'old block' || chr(10) || 'after' UNION ALL SELECT 'entity/person/c-1', 'nothing'"
query("n9_routed_texts", lambda k: T.route_texts(k.sql(SENT), k.kpages, k.sql(KNOWN)),
      f"""WITH s AS (SELECT id, content, title AS given, CAST(id % 8 AS INT) AS m FROM ({SENT}) x), t AS (SELECT *, CASE WHEN m IN (0, 6) THEN 'markdown' ELSE 'text' END AS kind, CASE m WHEN 0 THEN 'Doc ' || CAST(id AS VARCHAR) WHEN 1 THEN 'plain line ' || CAST(id AS VARCHAR) WHEN 6 THEN 'x' ELSE given END AS title, row_number() OVER (PARTITION BY CASE WHEN m IN (0, 1, 6) THEN CAST(id AS VARCHAR) ELSE 'm' || CAST(m AS VARCHAR) END ORDER BY id) AS rn FROM s)
          SELECT id, kind, title, slug, CASE WHEN title IS NULL OR title LIKE '/%' THEN 'invalid' WHEN m = 4 THEN 'appended' WHEN m IN (3, 5) OR rn > 1 THEN 'duplicate' WHEN slug IN (SELECT slug FROM kpages) THEN 'updated' ELSE 'created' END AS outcome FROM (SELECT id, kind, title, m, rn, CASE m WHEN 4 THEN 'entity/person/c-1' WHEN 5 THEN 'entity/person/c-2' WHEN 6 THEN 'entity/location/n-1' WHEN 2 THEN NULL ELSE 'records/' || regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(title, '[.]', '-', 'g')), '[^a-z0-9 -]', '', 'g'), ' +', '-', 'g'), '^-|-$', '', 'g') END AS slug FROM t) u""")

# ---- extraction ----
ITEMS = "SELECT o_custkey AS doc, CAST(o_orderkey % 4 AS INT) AS chunk, o_orderkey AS pos, o_orderpriority AS name, o_orderstatus AS kind, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date, o_orderpriority AS description, CAST(o_orderkey % 10 AS DOUBLE) / 10e0 AS confidence FROM orders"
query("n6_merged_entities", lambda k: T.merge_entities(k.sql(ITEMS)), f"SELECT doc, name, kind FROM (SELECT *, row_number() OVER (PARTITION BY doc, name ORDER BY chunk, pos) AS rn FROM ({ITEMS}) x) y WHERE rn = 1")
query("n6_merged_events", lambda k: T.merge_events(k.sql(ITEMS)), f"SELECT DISTINCT doc, coalesce(date, '') AS date, description FROM ({ITEMS}) x")
query("n6_merged_facts", lambda k: T.merge_facts(k.sql(ITEMS).select("doc", "chunk", "pos", F.col("name").alias("entity"), F.col("kind").alias("field"), F.col("date").alias("value"), "confidence")),
      f"SELECT doc, name AS entity, kind AS field, date AS value, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc, name, kind ORDER BY confidence DESC, chunk, pos) AS rn FROM ({ITEMS}) x) y WHERE rn = 1")
JOBS = "SELECT o_orderkey AS id, CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN ' ' WHEN 1 THEN 'entity/person/gone' ELSE 'entity/person/c-' || CAST(o_custkey AS STRING) END AS slug, CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'other' WHEN 1 THEN NULL ELSE 'ner' END AS kind, CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN md5(o_orderpriority) WHEN 1 THEN md5('Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0')) END AS fingerprint, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'pending' END AS status, CAST(o_custkey % 4 AS INT) AS priority FROM orders"
query("n12_backfill_plan", lambda k: T.backfill_plan(k.sql(JOBS), k.kpages.select("slug", F.col("content_hash").alias("fingerprint")), 200),
      f"SELECT id, j.slug, CASE WHEN trim(j.slug) = '' OR coalesce(kind, 'ner') NOT IN ('ner', 'entity_facts') THEN 'invalid_job' WHEN p.slug IS NULL THEN 'source_unavailable' WHEN fingerprint IS NOT NULL AND fingerprint <> content_hash THEN 'source_changed' ELSE 'run' END AS outcome FROM (SELECT * FROM ({JOBS}) x WHERE status = 'pending' ORDER BY priority DESC, id LIMIT 200) j LEFT JOIN kpages p ON p.slug = j.slug")

# ---- seals and dossiers ----
HASHES = "SELECT page_slug AS slug, count(*) AS raw, sum(('0x' || md5(CAST(chunk_index AS VARCHAR) || '|' || content)[1:8])::BIGINT)::BIGINT AS hash FROM kchunks WHERE summary_level = 0 GROUP BY 1"
sealed = lambda k: k.kpages.filter("type = 'record'").join(T.raw_hashes(k.kchunks), "slug").select("slug", F.when(F.col("mention_count") == 1, F.col("hash") + 1).otherwise(F.col("hash")).alias("hash"), "mention_count").filter("mention_count < 2")
PLAN = f"SELECT p.slug, CASE WHEN h.raw IS NULL THEN 'no raw chunks' WHEN p.mention_count >= 2 OR p.type <> 'record' THEN 'seal' WHEN p.mention_count = 1 THEN 'reseal' ELSE 'unchanged' END AS state, h.hash FROM kpages p LEFT JOIN ({HASHES}) h ON h.slug = p.slug"
plan = lambda k: T.seal_plan(k.kpages, k.kchunks, sealed(k).drop("mention_count"))
query("l22_seal_plan", plan, PLAN)
query("l22_sealed_chunks", lambda k: T.seal(k.kchunks, plan(k), k.kpages.select("slug", F.when(F.col("mention_count") == 1, F.concat(F.lit("about "), "title")).otherwise(" ").alias("summary"))).groupBy("summary_level").agg(F.count("*").alias("n"), F.count_distinct("page_slug").alias("pages"), F.sum((F.col("chunk_index") == -1).cast("long")).alias("new")),
      f"""WITH p AS ({PLAN}), n AS (SELECT p.slug FROM p JOIN kpages k ON k.slug = p.slug WHERE state IN ('seal', 'reseal') AND mention_count = 1), c AS (SELECT page_slug, chunk_index, summary_level FROM kchunks WHERE summary_level = 0 OR page_slug NOT IN (SELECT slug FROM n) UNION ALL SELECT slug, -1, 1 FROM n)
          SELECT summary_level, count(*) AS n, count(DISTINCT page_slug) AS pages, sum(CAST(chunk_index = -1 AS INT))::BIGINT AS new FROM c GROUP BY 1""")
query("l23_dossier_inputs", lambda k: T.dossier_inputs(k.kpages, k.kchunks, k.klinks, k.ktimeline, k.ktags),
      f"""WITH i AS (SELECT DISTINCT to_slug AS slug, from_slug AS page_slug FROM klinks WHERE {CURRENT} AND from_slug <> to_slug), v AS (SELECT * FROM (SELECT i.*, p.title, row_number() OVER (PARTITION BY i.slug ORDER BY page_slug) AS rn FROM i JOIN kpages p ON p.slug = i.slug) x WHERE rn <= 8),
          w AS (SELECT slug, count(*) AS n FROM (SELECT v.slug, row_number() OVER (PARTITION BY v.slug, v.page_slug ORDER BY c.chunk_index) AS rn FROM v JOIN kchunks c ON c.page_slug = v.page_slug AND summary_level = 0 AND (contains(content, title) OR contains(content, regexp_extract(v.slug, '[^/]*$')))) y WHERE rn <= 2 GROUP BY slug)
          SELECT p.slug, coalesce(c.n, 0) AS chunks, coalesce(o.n, 0) AS outgoing, coalesce(n.n, 0) AS incoming, coalesce(e.n, 0) AS events, coalesce(t.n, 0) AS tags, coalesce(w.n, 0) AS views FROM kpages p LEFT JOIN (SELECT page_slug, count(*) AS n FROM kchunks WHERE summary_level = 0 GROUP BY 1) c ON c.page_slug = p.slug
          LEFT JOIN (SELECT from_slug, count(*) AS n FROM klinks WHERE {CURRENT} GROUP BY 1) o ON from_slug = p.slug LEFT JOIN (SELECT to_slug, count(*) AS n FROM klinks WHERE {CURRENT} GROUP BY 1) n ON to_slug = p.slug LEFT JOIN (SELECT page_slug, count(*) AS n FROM ktimeline WHERE {ACTIVE} GROUP BY 1) e ON e.page_slug = p.slug LEFT JOIN (SELECT page_slug, count(*) AS n FROM ktags GROUP BY 1) t ON t.page_slug = p.slug LEFT JOIN w ON w.slug = p.slug""")
DOSSIERS = "SELECT doc_id, array_join_ AS t, CAST(doc_id % 9 AS INT) AS n FROM (SELECT doc_id, " + " || ".join(f"CASE WHEN doc_id % {i + 3} = 0 THEN '' ELSE '{h} x' || chr(10) END" for i, h in enumerate(T.SECTIONS)) + " || coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN '[[a]] [[b]] [[c]]' ELSE '' END AS array_join_ FROM documents) d"
query("l23_dossier_issues", lambda k: k.sql(DOSSIERS).select("doc_id", F.array_join(T.dossier_issues(F.col("t"), F.col("n")), "; ").alias("issues")),
      "SELECT doc_id, concat_ws('; ', " + ", ".join(f"CASE WHEN doc_id % {i + 3} = 0 THEN 'missing {h}' END" for i, h in enumerate(T.SECTIONS)) + f", CASE WHEN length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')) < 500 THEN 'short' END, CASE WHEN n > 5 AND (length(t) - length(replace(t, '[[', ''))) / 2 < 3 THEN 'few citations' END) AS issues FROM ({DOSSIERS}) x")
STATES = """SELECT c_custkey AS project, CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'no json' ELSE '{"updated_at": "' || CASE WHEN c_custkey % 2 = 0 THEN '2001-07-30 00:00:00' ELSE '2001-01-01 00:00:00' END || '", "active_work": ["' || c_name || '", "api_key=abc"], "notes": ["' || repeat('n', CAST(c_custkey % 40 AS INT)) || '"]}' END AS json FROM customer"""
query("l24_project_states", lambda k: T.project_states(k.sql(STATES), ORDER_AS_OF, 14, 40),
      f"""SELECT project, CASE project % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'unreadable' ELSE 'ok' END AS status, CAST(CASE WHEN project % 5 < 2 THEN 0 ELSE 3 END AS INT) AS signals, CAST(project % 5 >= 2 AND length(d) > 40 AS INT) AS truncated, CASE WHEN project % 5 < 2 THEN '' ELSE d[1:40] END AS display, CAST(project % 5 >= 2 AND project % 2 = 1 AS INT) AS stale
          FROM (SELECT c_custkey AS project, c_name || CASE WHEN c_custkey % 40 = 0 THEN '' ELSE chr(10) || repeat('n', CAST(c_custkey % 40 AS INT)) END AS d FROM customer) x""")

# ---- logs and review ----
query("m13_append_log", lambda k: (lambda log: T.append_log(log, k.kqlog.select("id", "tool").filter("tool <> 'other'").unionByName(log)))(k.kqlog.select("id", "tool").filter("k >= 50")).groupBy("tool").agg(F.count("*").alias("n")), "SELECT tool, count(*) AS n FROM kqlog WHERE k >= 50 OR tool <> 'other' GROUP BY tool")
query("m13_trace_steps", lambda k: T.trace_steps(k.ksearch.select(F.col("id").alias("trace"), F.when(F.col("degraded") == 0, F.col("latency_ms")).alias("vector"), F.col("hit_count").alias("rank")), {"vector": "vector", "rank": "rank"}),
      "SELECT id AS trace, 0 AS step, 'vector' AS kind, CAST(latency_ms AS BIGINT) AS latency_ms FROM ksearch WHERE degraded = 0 UNION ALL SELECT id, CASE WHEN degraded = 0 THEN 1 ELSE 0 END, 'rank', CAST(hit_count AS BIGINT) FROM ksearch")
FOUND = "SELECT id, CASE WHEN id % 9 <> 0 THEN CAST(id % 6 AS INT) END AS shared, CAST(id % 3 AS INT) AS sessions, CAST(id % 2 AS INT) AS events, CASE WHEN id % 4 = 1 THEN '/etc/x/' ELSE '2024-01-0' || CAST(id % 9 AS STRING) END AS event_date, score AS novelty, CASE WHEN id % 7 <> 0 THEN 0.25e0 END AS risk, occurrence_count AS occurrences FROM kdiscoveries WHERE type = 'proactive_connection'"
query("l12_review_candidates", lambda k: T.review_candidates(k.sql(FOUND)),
      f"""SELECT id, CAST(shared + CAST(sessions >= 1 AS INT) + CAST(events >= 1 AS INT) AS BIGINT) AS evidence, CAST(least(greatest(occurrences, 0), 2) + CASE WHEN sessions >= 1 AND events >= 1 THEN 1 ELSE 0 END AS BIGINT) AS persistence, novelty, 0.5e0 AS action_value, risk AS trust_risk, '{T.REVIEW_TITLE}' AS title, '两条记忆通过 ' || CAST(shared AS VARCHAR) || ' 个共同邻居与 ' || CAST(sessions AS VARCHAR) || ' 次共现形成连接，值得复盘是否建立显式关联。' AS summary,
          CASE WHEN events >= 1 THEN CASE WHEN event_date LIKE '/etc%' THEN '' ELSE event_date END END AS date_range FROM ({FOUND}) f WHERE shared IS NOT NULL AND risk IS NOT NULL""")
