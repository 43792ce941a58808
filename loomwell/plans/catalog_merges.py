"""Queries of whole merges and of hints, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwell.operators import hints, merges
from loomwell.plans.adapters import EVENT_AS_OF, ORDER_AS_OF, Knowledge
from loomwell.plans.catalog_relational import ACTIVE, CURRENT
from loomwell.plans.registry import query

# ---- review candidates ----
OLD = """SELECT row_number() OVER (ORDER BY min(id)) AS id, h AS content_hash, min_by(title, id) AS title, CASE min(id) % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'deferred' WHEN 2 THEN 'accepted' ELSE 'rejected' END AS status, max(detected_at) AS last_seen_at, max(detected_at) AS updated_at
  FROM (SELECT id, sha256(type || '|' || entity_a) AS h, type || ' ' || entity_b AS title, detected_at FROM kdiscoveries WHERE detected_at < TIMESTAMP '1997-06-01 00:00:00') x GROUP BY h"""
NEW = "SELECT id AS seq, sha256(type || '|' || entity_a) AS content_hash, type || ' ' || entity_b AS title FROM kdiscoveries WHERE detected_at >= TIMESTAMP '1997-01-01 00:00:00'"
_spark = lambda text: text.replace("sha256(type || '|' || entity_a)", "sha2(type || '|' || entity_a, 256)").replace("row_number() OVER (ORDER BY min(id))", "min(id)")
_OLD = OLD.replace("row_number() OVER (ORDER BY min(id))", "min(id)")
query("m3_candidate_upsert", lambda k: merges.candidate_upsert(k.sql(_spark(OLD)), k.sql(_spark(NEW)), ORDER_AS_OF),
      f"""WITH o AS ({_OLD}), f AS (SELECT content_hash, min(seq) AS seq, min_by(title, seq) AS title FROM ({NEW}) x GROUP BY 1), again AS (SELECT content_hash FROM f)
          SELECT id, content_hash, title, status, CASE WHEN status IN ('pending', 'deferred') AND content_hash IN (SELECT content_hash FROM again) THEN TIMESTAMP '{ORDER_AS_OF}' ELSE last_seen_at END AS last_seen_at, CASE WHEN status IN ('pending', 'deferred') AND content_hash IN (SELECT content_hash FROM again) THEN TIMESTAMP '{ORDER_AS_OF}' ELSE updated_at END AS updated_at FROM o
          UNION ALL SELECT (SELECT max(id) FROM o) + row_number() OVER (ORDER BY seq), content_hash, title, 'pending', TIMESTAMP '{ORDER_AS_OF}', TIMESTAMP '{ORDER_AS_OF}' FROM f WHERE content_hash NOT IN (SELECT content_hash FROM o)""")
MOVES = "SELECT id AS seq, id - id % 3 AS id, CASE id % 5 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' WHEN 2 THEN 'defer' WHEN 3 THEN 'reopen' ELSE 'unknown' END AS action, 'note ' || CAST(id AS STRING) AS note FROM kdiscoveries WHERE id % 2 = 0"


def moved(k: Knowledge):
    after, feedback = merges.candidate_moves(k.sql(_spark(OLD)), k.sql(MOVES), ORDER_AS_OF)
    return after.groupBy("status").agg(F.count("*").alias("n"), F.sum("id").alias("ids")).unionByName(feedback.groupBy(F.concat(F.lit("feedback "), "action").alias("status")).agg(F.count("*").alias("n"), F.sum("candidate_id").alias("ids")))


query("m3_candidate_moves", moved,
      f"""WITH o AS ({_OLD}), m AS (SELECT * FROM ({MOVES}) x WHERE action <> 'unknown' AND id IN (SELECT id FROM o)), l AS (SELECT id, max_by(action, seq) AS action FROM m GROUP BY id),
          s AS (SELECT o.id, CASE action WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' WHEN 'defer' THEN 'deferred' WHEN 'reopen' THEN 'pending' ELSE status END AS status FROM o LEFT JOIN l ON l.id = o.id)
          SELECT status, count(*) AS n, sum(id)::BIGINT AS ids FROM s GROUP BY 1 UNION ALL SELECT 'feedback ' || action, count(*), sum(id)::BIGINT FROM m GROUP BY 1""")

# ---- insights ----
INSIGHTS = "SELECT id, CASE status WHEN 'pending' THEN 'active' WHEN 'seen' THEN 'active' ELSE 'dismissed' END AS status, CASE WHEN id % 3 = 0 THEN NULL ELSE detected_at + INTERVAL 900 DAYS END AS expires_at, detected_at AS created_at, {0} AS source_entities FROM kdiscoveries"
ASKED = "SELECT 'q' || CAST(c_nationkey AS STRING) AS query, 'entity/person/c-' || CAST(c_custkey AS STRING) AS slug FROM customer"
query("m4_insights_of", lambda k: merges.insights_of(k.sql(INSIGHTS.format("array(entity_a, entity_b)")), k.sql(ASKED), ORDER_AS_OF),
      f"""WITH i AS ({INSIGHTS.format('[entity_a, entity_b]')}), m AS (SELECT DISTINCT query, id, created_at FROM (SELECT id, created_at, unnest(source_entities) AS slug FROM i WHERE status = 'active' AND (expires_at IS NULL OR expires_at >= TIMESTAMP '{ORDER_AS_OF}')) x JOIN ({ASKED}) a USING (slug))
          SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY created_at DESC, id DESC) AS INT) AS pos, id FROM m QUALIFY pos <= 10""")
query("m4_archive_expired", lambda k: merges.archive_expired(k.sql(INSIGHTS.format("array(entity_a)")), ORDER_AS_OF).groupBy("status").agg(F.count("*").alias("n"), F.sum("id").alias("ids")),
      f"SELECT CASE WHEN status = 'active' AND expires_at < TIMESTAMP '{ORDER_AS_OF}' THEN 'archived' ELSE status END AS status, count(*) AS n, sum(id)::BIGINT AS ids FROM ({INSIGHTS.format('[entity_a]')}) i GROUP BY 1")

# ---- pages ----
PAGES = "SELECT slug, type, title, file_path, content_hash, tier, expires_at, created_at, updated_at FROM kpages"
UPSERTS = "SELECT slug, 'record' AS type, 'renamed ' || title AS title, 'elsewhere.md' AS file_path, CASE WHEN mention_count % 2 = 0 THEN md5(title) END AS content_hash FROM kpages WHERE mention_count % 5 = 1 UNION ALL SELECT 'new/' || slug, type, title, 'new/' || file_path, NULL FROM kpages WHERE type = 'entity/company'"
query("m7_page_upsert", lambda k: merges.page_upsert(k.sql(PAGES), k.sql(UPSERTS), ORDER_AS_OF),
      f"""WITH p AS ({PAGES}), n AS ({UPSERTS}) SELECT coalesce(p.slug, n.slug) AS slug, CASE WHEN p.slug IS NULL THEN n.type ELSE p.type END AS type, CASE WHEN n.slug IS NULL THEN p.title ELSE n.title END AS title, CASE WHEN p.slug IS NULL THEN n.file_path ELSE p.file_path END AS file_path,
          coalesce(n.content_hash, p.content_hash) AS content_hash, CASE WHEN p.slug IS NULL THEN 3 ELSE p.tier END AS tier, p.expires_at, CASE WHEN p.slug IS NULL THEN TIMESTAMP '{ORDER_AS_OF}' ELSE p.created_at END AS created_at, CASE WHEN n.slug IS NULL THEN p.updated_at ELSE TIMESTAMP '{ORDER_AS_OF}' END AS updated_at FROM p FULL JOIN n ON n.slug = p.slug""")
RENAMES = """SELECT slug AS old, 'moved/' || slug AS new, 'entity/organization' AS type, 'moved/' || file_path AS file_path FROM kpages WHERE type = 'entity/company' UNION ALL SELECT slug, slug, type, file_path FROM kpages WHERE slug LIKE 'entity/location/n-1%'
  UNION ALL SELECT 'nobody', 'nobody/2', 'record', 'x.md' UNION ALL SELECT slug, 'entity/location/n-0', type, file_path FROM kpages WHERE slug = 'entity/location/n-3' UNION ALL SELECT slug, 'both', type, file_path FROM kpages WHERE slug IN ('entity/location/n-4', 'entity/location/n-5')"""


def renamed(k: Knowledge):
    pages, done, problems = merges.page_moves(k.sql(PAGES), k.sql(RENAMES), {"links": (k.klinks, ["from_slug", "to_slug"]), "aliases": (k.kaliases, ["page_slug"])}, ORDER_AS_OF)
    count = lambda rows, what, key: rows.groupBy(F.split(key, "/")[0].alias("key")).agg(F.count("*").alias("n")).withColumn("what", F.lit(what))
    return count(pages, "pages", F.col("slug")).unionByName(count(done["links"], "from", F.col("from_slug"))).unionByName(count(done["links"], "to", F.col("to_slug"))).unionByName(count(done["aliases"], "aliases", F.col("page_slug"))).unionByName(count(problems, "problem", F.col("problem")))


_TO = "CASE WHEN {0} LIKE 'entity/company/%' THEN 'moved' ELSE split_part({0}, '/', 1) END"
query("m7_page_moves", renamed, " UNION ALL ".join(f"SELECT {_TO.format(c)} AS key, count(*) AS n, '{what}' AS what FROM {t} GROUP BY 1" for what, t, c in (("pages", "kpages", "slug"), ("from", "klinks", "from_slug"), ("to", "klinks", "to_slug"), ("aliases", "kaliases", "page_slug")))
      + " UNION ALL SELECT 'same_slug', count(*), 'problem' FROM kpages WHERE slug LIKE 'entity/location/n-1%' UNION ALL SELECT * FROM (VALUES ('no_page', 1, 'problem'), ('taken', 1, 'problem'), ('repeated', 2, 'problem')) v")

# ---- promotions ----
PROMOTED = "SELECT id, CASE WHEN id % 9 = 0 THEN 'action_review_discovery' WHEN id % 9 = 1 THEN 'contradiction' WHEN id % 9 = 2 THEN 'unshown' ELSE type END AS type, score * 1.5e0 AS score, CASE WHEN id % 10 = 3 THEN 'odd' ELSE actionable END AS actionable, CASE WHEN id % 7 = 0 THEN NULL ELSE occurrence_count END AS occurrence_count, CAST(id % 6 = 0 AS INT) AS auto_applicable, CASE id % 4 WHEN 1 THEN ' ' WHEN 2 THEN '[]' END AS proposed_actions FROM kdiscoveries"
query("l27_drafts", lambda k: merges.promotions(k.sql(PROMOTED)).withColumn("score", F.round("score", 8)),
      f"""SELECT id, type, round(greatest(0.1e0, least(1e0, score)), 8) AS score, CASE WHEN actionable = 'odd' THEN 'low' ELSE actionable END AS actionable, coalesce(occurrence_count, 1) >= 3 AS repeated, coalesce(trim(proposed_actions), '') <> '' AS has_proposals FROM ({PROMOTED}) d
          WHERE type NOT LIKE 'action\\_%' ESCAPE '\\' AND type NOT IN ('proactive_connection', 'unshown') AND auto_applicable <> 1 AND (actionable = 'high' OR coalesce(occurrence_count, 1) >= 3 OR coalesce(trim(proposed_actions), '') <> '' OR type = 'contradiction')""")

# ---- hints ----
#: Many questions at once: the results of each logged query text; pages are moved to the time of the log.
RESULTS = "SELECT DISTINCT 'k' || CAST(k AS STRING) AS query, slug FROM khits JOIN (SELECT id, k FROM kqlog) q USING (id) UNION SELECT 'n' || CAST(c_nationkey AS STRING), 'entity/person/c-' || CAST(c_custkey AS STRING) FROM customer"
DUE = "SELECT slug, CASE expires_at WHEN '2002-01-01' THEN '2024-02-20' WHEN '1998-06-01' THEN '2024-06-01' ELSE expires_at END AS expires_at FROM kpages"
DAY = EVENT_AS_OF[:10]
_NEAR = lambda cond: f"SELECT from_slug AS slug, to_slug AS o FROM klinks WHERE {cond} UNION SELECT to_slug, from_slug FROM klinks WHERE {cond}"
query("h18_hints", lambda k: hints.hints(k.sql(RESULTS), k.sql(DUE), k.klinks, k.ktimeline, EVENT_AS_OF).withColumn("score", F.round("score", 6)),
      f"""WITH r AS ({RESULTS}), p AS ({DUE}), x AS (SELECT query, 'expiry_alert' AS rule, 1 AS place, p.slug, 1e0 AS score, NULL::BIGINT AS age_days FROM r JOIN p ON p.slug = r.slug WHERE trim(expires_at) <> '' AND expires_at <= CAST(DATE '{DAY}' + 30 AS VARCHAR) QUALIFY row_number() OVER (PARTITION BY query ORDER BY expires_at, p.slug) = 1),
          a AS (SELECT DISTINCT query, o FROM r JOIN ({_NEAR(ACTIVE)}) n ON n.slug = r.slug EXCEPT SELECT query, slug FROM r), l AS (SELECT query, page_slug, event_date, id FROM a JOIN ktimeline t ON t.page_slug = a.o WHERE {ACTIVE} AND event_date >= CAST(DATE '{DAY}' - 30 AS VARCHAR) AND page_slug IN (SELECT slug FROM kpages) QUALIFY row_number() OVER (PARTITION BY query ORDER BY event_date DESC, id DESC) <= 5),
          t AS (SELECT query, 'network_timeline' AS rule, 2 AS place, page_slug AS slug, greatest(0, least(1, 1 - (DATE '{DAY}' - TRY_CAST(event_date AS DATE)) / 180e0)) AS score, CAST(DATE '{DAY}' - TRY_CAST(event_date AS DATE) AS BIGINT) AS age_days FROM l WHERE page_slug NOT LIKE 'records/%' QUALIFY row_number() OVER (PARTITION BY query ORDER BY event_date DESC, id DESC) = 1),
          s AS (SELECT query, 'shared_connection' AS rule, 3 AS place, o AS slug, greatest(0, 1 - count(*) / 10e0) AS score, NULL::BIGINT AS age_days FROM (SELECT DISTINCT query, r.slug, o FROM r JOIN ({_NEAR(CURRENT)}) n ON n.slug = r.slug WHERE o NOT LIKE 'records/%') f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.query = f.query AND r.slug = f.o) GROUP BY query, o HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY query ORDER BY count(*) DESC, o) = 1)
          SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, place) AS INT) AS pos, rule, slug, round(score, 6) AS score, age_days FROM (SELECT * FROM x UNION ALL SELECT * FROM t UNION ALL SELECT * FROM s) u WHERE score >= 0.5 QUALIFY pos <= 3""")
