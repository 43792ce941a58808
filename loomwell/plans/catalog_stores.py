"""Queries of the synchronised store and of the consistency probes, with oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.operators import probes as P
from loomwell.operators import sync
from loomwell.operators.lineage import shared_folder
from loomwell.plans import models
from loomwell.plans.adapters import Knowledge
from loomwell.plans.catalog_health import RICH, SOURCES
from loomwell.plans.registry import query
from loomwell.sources import vault

# ---- probes ----
FILES = """SELECT CASE WHEN mention_count % 13 = 5 THEN 'moved/' || file_path ELSE file_path END AS path, CASE WHEN mention_count % 11 = 3 THEN NULL ELSE slug END AS slug, CASE WHEN length(title) % 11 = 0 THEN 0 ELSE length(title) END AS size,
    CASE WHEN tier = 1 AND mention_count % 9 = 0 THEN 'outside' WHEN mention_count % 37 = 1 THEN 'unreadable' ELSE 'ok' END AS state FROM kpages WHERE type <> 'concept/method'
  UNION ALL SELECT 'lost/' || file_path, 'lost/' || slug, 10, 'ok' FROM kpages WHERE type = 'entity/company'"""
#: Some pages left the text index, and some chunks their table.
UNINDEXED, CHUNKS = "slug LIKE 'records/doc-%3'", "SELECT * FROM kchunks WHERE page_slug NOT LIKE '%7'"
TAGS = "SELECT page_slug, tag FROM ktags UNION ALL SELECT 'lost/' || page_slug, tag FROM ktags WHERE page_slug LIKE '%9'"


def stores(k: Knowledge) -> P.Stores:
    index = k.text_index.fork(f"{shared_folder(k.spark)}/loomwell-textindex-{uuid.uuid4().hex[:12]}")
    index.update(k.kpages.filter(UNINDEXED), k.kchunks.limit(0))
    return P.Stores(k.kpages, k.klinks, k.sql(CHUNKS), k.sql(TAGS), k.kaliases, k.ktimeline, k.sql(FILES), k.sql(SOURCES["managers"]), index.pages(), k.kvectors.withColumnRenamed("page_slug", "slug"), k.sql(SOURCES["quarantine"]))


_ROW = lambda check, layer, severity, rest: f"SELECT '{layer}.{check}' AS \"check\", '{layer}' AS layer, '{severity}' AS severity, {rest}"
_ORPHANS = " UNION ALL ".join(_ROW(f"orphan_{n}", "tables", "warning", f"page_slug FROM {t} WHERE page_slug NOT IN (SELECT slug FROM kpages)") for n, t in (("chunks", "pchunks"), ("tags", "ptags"), ("aliases", "kaliases"), ("timeline", "ktimeline")))
FINDINGS = f"""WITH pchunks AS ({CHUNKS}), ptags AS ({TAGS}), pfiles AS ({FILES}), pmanagers AS ({SOURCES['managers']}), pindexed AS (SELECT DISTINCT page_slug AS slug FROM kchunks WHERE page_slug NOT LIKE 'records/doc-%3'), f AS (
{_ROW('title_collision', 'tables', 'error', 'slug FROM kpages WHERE title IN (SELECT title FROM kpages GROUP BY title HAVING count(*) > 1)')}
UNION ALL {_ROW('page_without_chunks', 'tables', 'warning', 'slug FROM kpages WHERE slug NOT IN (SELECT page_slug FROM pchunks)')}
UNION ALL SELECT 'tables.zero_link_rich_records', 'tables', 'warning', slug FROM {RICH.replace('SELECT count(*) FROM kpages', 'SELECT slug FROM kpages', 1).replace('kchunks', 'pchunks').replace('ktags', 'ptags')} z
UNION ALL SELECT 'tables.quarantine_context', 'tables', 'info', slug FROM ({SOURCES['quarantine']}) q
UNION ALL {_ROW('orphan_links', 'tables', 'warning', "slug FROM (SELECT from_slug AS slug FROM klinks UNION ALL SELECT to_slug FROM klinks WHERE from_slug <> to_slug) x WHERE slug NOT IN (SELECT slug FROM kpages)")}
UNION ALL {_ORPHANS}
UNION ALL {_ROW('coverage_gap', 'text', 'warning', 'slug FROM (SELECT DISTINCT page_slug AS slug FROM pchunks) x WHERE slug NOT IN (SELECT slug FROM pindexed)')}
UNION ALL {_ROW('stale_rows', 'text', 'warning', 'slug FROM pindexed WHERE slug NOT IN (SELECT page_slug FROM pchunks)')}
UNION ALL {_ROW('coverage_gap', 'vectors', 'error', 'slug FROM (SELECT DISTINCT page_slug AS slug FROM pchunks) x WHERE slug NOT IN (SELECT page_slug FROM kvectors)')}
UNION ALL {_ROW('malformed_reports_to', 'hierarchy', 'error', "slug FROM pmanagers WHERE reports_to <> '' AND NOT contains(reports_to, '/')")}
UNION ALL {_ROW('graph_mismatch', 'hierarchy', 'error', "slug FROM pmanagers m WHERE contains(reports_to, '/') AND NOT EXISTS (SELECT 1 FROM klinks l WHERE l.from_slug = m.slug AND l.to_slug = m.reports_to AND relation = 'reports_to' AND (trust_state IS NULL OR trust_state IN ('trusted', 'user_thought')))")}
UNION ALL {_ROW('file_without_page', 'vault', 'error', "slug FROM (SELECT DISTINCT slug FROM pfiles WHERE state = 'ok' AND slug IS NOT NULL) x WHERE slug NOT IN (SELECT slug FROM kpages)")}
UNION ALL {_ROW('page_without_file', 'vault', 'error', "slug FROM kpages WHERE file_path NOT IN (SELECT path FROM pfiles WHERE state = 'ok')")}
UNION ALL {_ROW('path_mismatch', 'vault', 'warning', "x.slug FROM (SELECT DISTINCT slug, path FROM pfiles WHERE state = 'ok' AND slug IS NOT NULL) x JOIN kpages p ON p.slug = x.slug WHERE p.file_path <> x.path")}
UNION ALL {_ROW('zero_byte', 'hygiene', 'warning', "path FROM pfiles WHERE size = 0 AND path LIKE '%.md'")} UNION ALL {_ROW('review_required', 'hygiene', 'warning', "path FROM pfiles WHERE state = 'outside'")} UNION ALL {_ROW('scan_incomplete', 'hygiene', 'warning', "path FROM pfiles WHERE state = 'unreadable'")})
"""
query("n14_probes", lambda k: P.report(P.probe(stores(k))),
      f"""{FINDINGS}, s AS (SELECT "check", substring(sha256(slug), 1, 12) AS name FROM f GROUP BY 1, 2), t AS (SELECT "check", string_agg(name, ' ' ORDER BY name) AS sample FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY "check" ORDER BY name) <= 5) x GROUP BY 1)
          SELECT f."check", layer, severity, count(*) AS n, any_value(sample) AS sample FROM f JOIN t ON t."check" = f."check" GROUP BY 1, 2, 3""")
query("n14_store_differences", lambda k: P.differences(P.keys(k.kpages, "slug"), P.keys(k.klinks, "to_slug")).groupBy("only_in").agg(F.count("*").alias("n")),
      "SELECT 'a' AS only_in, count(*) AS n FROM kpages WHERE slug NOT IN (SELECT to_slug FROM klinks) UNION ALL SELECT 'b', count(DISTINCT to_slug) FROM klinks WHERE to_slug NOT IN (SELECT slug FROM kpages) HAVING count(*) > 0")
query("n14_gate", lambda k: P.gate(P.probe(stores(k), ("hierarchy", "hygiene", "vault")), k.spark.createDataFrame([("hygiene.zero_byte", 3), ("vault.path_mismatch", 10**9), ("gone.check", 2)], "check string, n long")),
      f"""{FINDINGS}, n AS (SELECT "check", severity, count(*) AS now FROM f WHERE layer IN ('hierarchy', 'hygiene', 'vault') GROUP BY 1, 2), b("check", before) AS (VALUES ('hygiene.zero_byte', 3), ('vault.path_mismatch', 1000000000), ('gone.check', 2)),
          j AS (SELECT coalesce(n."check", b."check") AS "check", severity, coalesce(before, 0)::BIGINT AS before, coalesce(now, 0) AS now FROM n FULL JOIN b ON b."check" = n."check") SELECT "check", before, now, CASE WHEN now > before THEN 'worse' WHEN now < before THEN 'better' ELSE 'same' END AS state, coalesce(severity = 'error', false) AND now > before AS closes FROM j""")

# ---- the synchronised store ----
#: Two states of the vault's files: each document a page, some with the titles of others, some slugs twice, some texts changed, some gone.
FIRST = "SELECT 'd/' || CAST(doc_id AS STRING) || '.md' AS file_path, doc_id, coalesce(text, '') AS body, CASE WHEN doc_id % 50 = 7 THEN 'title 6' ELSE 'title ' || CAST(doc_id AS STRING) END AS title FROM documents WHERE doc_id % 9 <> 4"
SECOND = """SELECT 'd/' || CAST(doc_id AS STRING) || '.md' AS file_path, doc_id, CASE WHEN doc_id % 7 = 2 THEN 'new ' || coalesce(text, '') ELSE coalesce(text, '') END AS body, CASE WHEN doc_id % 50 = 7 AND doc_id % 3 = 0 THEN 'title 6' ELSE 'title ' || CAST(doc_id AS STRING) END AS title FROM documents WHERE doc_id % 10 <> 3
  UNION ALL SELECT 'd/again-' || CAST(doc_id AS STRING) || '.md', doc_id, 'twice', 'other' FROM documents WHERE doc_id % 40 = 1"""


def vault_files(k: Knowledge, sql: str) -> DataFrame:
    """Whole files: frontmatter with title and slug, then the body."""
    rows = k.sql(sql).select("file_path", F.concat(F.lit("---\ntitle: "), "title", F.lit("\nslug: records/x-"), F.col("doc_id").cast("string"), F.lit("\n---\n"), "body").alias("text"), F.concat(F.lit("records/x-"), F.col("doc_id").cast("string")).alias("slug"))
    return rows.withColumn("content_hash", F.substring(F.sha2("text", 256), 1, 16))


def synced(k: Knowledge) -> tuple[sync.Store, list[DataFrame]]:
    store = sync.Store(k.spark, f"{shared_folder(k.spark)}/loomwell-store-{uuid.uuid4().hex[:12]}", models.embed(F.col("content"), models.hashing_embedder(16)), buckets=16)
    first = vault_files(k, FIRST)
    plans = [store.apply(first, "one", whole=True), store.apply(first, "one", whole=True), store.apply(vault_files(k, SECOND), "two", whole=True)]
    return store, plans


#: Who keeps 'title 6' is the first file by path.
_KEEPER = f"(SELECT min_by(doc_id, file_path) FROM ({FIRST}) x WHERE title = 'title 6')"
#: Then the same while it has the title, or else the first that claims it.
_NEXT = f"(SELECT min_by(doc_id, (doc_id <> {_KEEPER}, file_path)) FROM ({SECOND}) x WHERE title = 'title 6')"
ACTIONS = f"""WITH one AS ({FIRST}), two AS (SELECT doc_id, count(*) AS files, min_by(body, file_path) AS body, min_by(title, file_path) AS title FROM ({SECOND}) x GROUP BY 1),
  a AS (SELECT doc_id, body, title, CASE WHEN title = 'title 6' AND doc_id <> {_KEEPER} THEN 'quarantine' ELSE 'add' END AS action FROM one), held AS (SELECT * FROM a WHERE action = 'add'),
  b AS (SELECT coalesce(t.doc_id, h.doc_id) AS doc_id, t.body, t.title, CASE WHEN t.doc_id IS NULL THEN 'delete' WHEN files > 1 THEN 'duplicate' WHEN h.doc_id IS NULL THEN CASE WHEN t.title = 'title 6' AND t.doc_id <> {_NEXT} THEN 'quarantine' ELSE 'add' END
      WHEN h.body <> t.body OR h.title <> t.title THEN 'update' ELSE 'skip' END AS action FROM two t FULL JOIN held h ON h.doc_id = t.doc_id)"""
query("s11_sync_actions", lambda k: (lambda plans: plans[0].groupBy("action").agg(F.count("*").alias("n")).withColumn("batch", F.lit("one")).unionByName(plans[1].groupBy("action").agg(F.count("*").alias("n")).withColumn("batch", F.lit("one again"))).unionByName(plans[2].groupBy("action").agg(F.count("*").alias("n")).withColumn("batch", F.lit("two"))))(synced(k)[1]),
      f"{ACTIONS} SELECT 'one' AS batch, action, count(*) AS n FROM a GROUP BY 2 UNION ALL SELECT 'two', action, count(*) FROM b GROUP BY 2")
query("s11_synced_pages", lambda k: (lambda s: s.pages.select("slug", "title", "content_hash", "file_path").join(s.vectors.groupBy(F.col("page_slug").alias("slug")).agg(F.count("*").alias("n")), "slug", "left").select("slug", "title", "content_hash", (F.coalesce("n", F.lit(0)) > 0).alias("embedded")))(synced(k)[0].snapshot()),
      f"""{ACTIONS}, s AS (SELECT doc_id, body, title FROM b WHERE action IN ('add', 'update', 'skip') UNION ALL SELECT h.doc_id, h.body, h.title FROM b JOIN held h ON h.doc_id = b.doc_id WHERE b.action = 'duplicate')
          SELECT 'records/x-' || CAST(doc_id AS VARCHAR) AS slug, title, sha256('---' || chr(10) || 'title: ' || title || chr(10) || 'slug: records/x-' || CAST(doc_id AS VARCHAR) || chr(10) || '---' || chr(10) || body)[1:16] AS content_hash, regexp_matches(body, '\\S') AS embedded FROM s""")
query("s10_store_agrees", lambda k: (lambda s: P.report(P.text_probe(p := P.Stores(s.pages, s.pages, s.chunks, s.pages, s.pages, s.pages, s.pages, s.pages, s.text.pages(), s.vectors.withColumnRenamed("page_slug", "slug"), s.pages)).unionByName(P.vector_probe(p)).unionByName(P.finding(s.quarantine, "tables", "quarantine_context", "info"))).drop("sample"))(synced(k)[0].snapshot()),
      f"{ACTIONS} SELECT 'tables.quarantine_context' AS \"check\", 'tables' AS layer, 'info' AS severity, count(*) AS n FROM b WHERE action = 'quarantine' HAVING count(*) > 0")
