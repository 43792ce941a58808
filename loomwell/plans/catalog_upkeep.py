"""Queries of files, sinks, watchers, learning and planned research, with their oracles. Files go to the folder that the session shares."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.operators import inquiry as Q
from loomwell.operators import knowledge as N
from loomwell.operators import relational as R
from loomwell.operators import upkeep as U
from loomwell.operators.lineage import cut, shared_folder
from loomwell.plans import models, nightly
from loomwell.plans.adapters import Knowledge
from loomwell.plans.catalog_relational import ACTIVE, CURRENT
from loomwell.plans.registry import query
from loomwell.sources import vault, web


def folder(k: Knowledge, name: str) -> str:
    return f"{shared_folder(k.spark)}/loomwell-{name}-{uuid.uuid4().hex[:12]}"


# ---- sources and sinks ----
FILES = """SELECT CASE WHEN n_nationkey % 7 = 0 THEN '.hidden/' WHEN n_nationkey % 7 = 1 THEN 'attachments/' WHEN n_nationkey % 7 = 2 THEN 'places/deep/' ELSE 'places/' END || n_name || CASE WHEN n_nationkey % 7 = 3 THEN '.txt' ELSE '.md' END AS file_path, '---' || chr(10) || 'title: ' || n_name || chr(10) || 'type: entity/location' || chr(10) || '---' || chr(10) || 'body of ' || n_name AS text, n_name FROM nation"""


def scanned(k: Knowledge) -> DataFrame:
    path = folder(k, "vault")
    vault.write_pages(k.sql(FILES), path)
    return vault.scan_vault(k.spark, path, ("attachments",))


query("s1_vault_scan", lambda k: vault.parse_vault(scanned(k)).select("slug", "file_path", "title", "type", "body", "content_hash"),
      f"SELECT regexp_replace(file_path, '\\.md$', '') AS slug, file_path, n_name AS title, 'entity/location' AS type, 'body of ' || n_name AS body, sha256(text)[1:16] AS content_hash FROM ({FILES}) f WHERE file_path LIKE 'places/%.md'")


def snapshots(k: Knowledge) -> DataFrame:
    path = folder(k, "table")
    N.replace_table(k.nation.select(F.col("n_name").alias("name")), path)
    old = vault.read_snapshot(k.spark, path)
    N.replace_table(k.region.select(F.col("r_name").alias("name")), path)
    return old.withColumn("version", F.lit("old")).unionByName(vault.read_snapshot(k.spark, path).withColumn("version", F.lit("new")))


query("s9_snapshots", snapshots, "SELECT n_name AS name, 'old' AS version FROM nation UNION ALL SELECT r_name, 'new' FROM region")
BODIES = "SELECT 'records/doc-' || CAST(doc_id AS STRING) AS slug, CASE WHEN toxic = 1 THEN ' ' ELSE 'new body ' || CAST(doc_id AS STRING) END AS body FROM (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l"


def replaced(k: Knowledge) -> DataFrame:
    vectors = k.kvectors.select("page_slug", "chunk_index", "vector")
    chunks, posts, vecs = U.replace_page_index(k.kchunks, k.text_index.page_terms(), vectors, k.sql(BODIES), models.embed(F.col("content"), models.hashing_embedder(64)))
    rows = lambda t, key, name, what: t.groupBy(F.col(key).alias("slug")).agg(what.alias("n")).withColumn("store", F.lit(name))
    return rows(chunks, "page_slug", "chunks", F.count("*")).unionByName(rows(posts, "slug", "text", F.sum("tf"))).unionByName(rows(vecs, "page_slug", "vectors", F.count("*")))


query("s10_page_replace", replaced,
      f"""WITH b AS ({BODIES}), c AS (SELECT page_slug, content FROM kchunks WHERE page_slug NOT IN (SELECT slug FROM b) UNION ALL SELECT slug, body FROM b WHERE trim(body) <> '')
          SELECT page_slug AS slug, count(*) AS n, 'chunks' AS store FROM c GROUP BY 1 UNION ALL SELECT page_slug, sum(greatest(length(content) - 2, 0))::BIGINT, 'text' FROM c GROUP BY 1 HAVING sum(greatest(length(content) - 2, 0)) > 0
          UNION ALL SELECT page_slug, count(*), 'vectors' FROM (SELECT page_slug FROM kvectors WHERE page_slug NOT IN (SELECT slug FROM b) UNION ALL SELECT slug FROM b WHERE trim(body) <> '') v GROUP BY 1""")
CHANGES = "SELECT change, count(*) AS n FROM (SELECT CASE WHEN o.slug IS NULL THEN 'added' ELSE 'removed' END AS change FROM ksnap_old o FULL JOIN ksnap_new n ON o.slug = n.slug WHERE o.slug IS NULL OR n.slug IS NULL UNION ALL SELECT unnest(list_filter([CASE WHEN o.content_hash <> n.content_hash THEN 'content' END, CASE WHEN o.tier <> n.tier THEN 'tier' END, CASE WHEN o.link_count <> n.link_count THEN 'links' END, CASE WHEN o.confidence_decay - n.confidence_decay > 0.1e0 THEN 'confidence' END], lambda x: x IS NOT NULL)) FROM ksnap_old o JOIN ksnap_new n ON o.slug = n.slug) x GROUP BY 1"


def wakeups(k: Knowledge) -> DataFrame:
    path = folder(k, "wakeup")
    vault.write_wakeup(R.snapshot_diff(k.ksnap_old, k.ksnap_new), path, "2001-08-02")
    read = lambda name: k.spark.read.schema("slug string, change string").json(f"{path}/{name}").groupBy("change").agg(F.count("*").alias("n")).withColumn("report", F.lit(name))
    return read("2001-08-02").unionByName(read("latest"))


query("s14_wakeup_reports", wakeups, f"SELECT change, n, report FROM ({CHANGES}) c, (VALUES ('2001-08-02'), ('latest')) r(report)")


def compacted(k: Knowledge) -> DataFrame:
    path = folder(k, "vectors")
    k.kvectors.select("vec_id", "vector").repartition(9).write.parquet(f"{path}/loose")
    rows = vault.compact(k.spark, f"{path}/loose", f"{path}/dense", 2)
    files = lambda name: k.spark.read.parquet(f"{path}/{name}").select(F.col("_metadata.file_path").alias("f")).distinct().count()
    return k.spark.createDataFrame([("loose", files("loose"), rows), ("dense", files("dense"), rows)], "version string, files long, rows long")


query("s15_compaction", compacted, "SELECT v AS version, f AS files, (SELECT count(*) FROM embeddings) AS rows FROM (VALUES ('loose', CAST(9 AS BIGINT)), ('dense', CAST(2 AS BIGINT))) t(v, f)")
query("s16_web_supplement", lambda k: web.web_results(k.sql("SELECT DISTINCT source AS query FROM documents UNION ALL SELECT ' '"), lambda q: [(f"{q} {i}", f"https://example.org/{q}/{i}", "…") for i in range(9)], 3).select("query", "pos", "title", "url"),
      "SELECT query, CAST(i AS INT) AS pos, query || ' ' || CAST(i AS VARCHAR) AS title, 'https://example.org/' || query || '/' || CAST(i AS VARCHAR) AS url FROM (SELECT DISTINCT source AS query FROM documents WHERE source IS NOT NULL) d, range(3) t(i)")

# ---- watchers ----
SEEN = "SELECT file_path AS path, created_at AS mtime, length(title) AS size, content_hash AS hash FROM kpages WHERE type <> 'entity/location'"
NOW = "SELECT file_path AS path, CASE WHEN mention_count % 3 = 0 THEN updated_at ELSE created_at END AS mtime, length(title) + CASE WHEN tier = 1 THEN 1 ELSE 0 END AS size, CASE WHEN tier = 1 THEN md5(slug) ELSE content_hash END AS hash FROM kpages WHERE type <> 'entity/company'"
PLAN = f"SELECT coalesce(n.path, s.path) AS path, CASE WHEN n.path IS NULL THEN 'delete' WHEN s.path IS NULL THEN 'sync' WHEN n.mtime = s.mtime AND n.size = s.size THEN 'skip' WHEN n.hash = s.hash THEN 'touched' ELSE 'sync' END AS action FROM ({NOW}) n FULL JOIN ({SEEN}) s ON s.path = n.path"
query("t1_watch_plan", lambda k: U.watch_plan(k.sql(SEEN), k.sql(NOW)), PLAN)
query("t3_held_changes", lambda k: U.release_plan(U.watch_plan(k.sql(SEEN), k.sql(NOW)).filter("action in ('sync', 'delete')")), f"SELECT *, CAST(CASE WHEN count(*) OVER () > 50 THEN ceil(row_number() OVER (ORDER BY path) / 10e0) ELSE 0 END AS INT) AS batch FROM ({PLAN}) p WHERE action IN ('sync', 'delete')")
SYNCED = "SELECT 'p' || CAST(k AS STRING) AS slug, id AS seq, 'h' || CAST(CAST(floor(id / 1500e0) AS INT) AS STRING) AS hash, tool <> 'other' AND latency_ms % 4 = 0 AS ok FROM kqlog"
query("t2_quarantine", lambda k: U.quarantine_states(k.sql(SYNCED)),
      f"""WITH s AS (SELECT *, CASE WHEN lag(hash) OVER w IS NULL OR hash <> lag(hash) OVER w OR lag(ok) OVER w THEN 1 ELSE 0 END AS fresh FROM ({SYNCED}) x WINDOW w AS (PARTITION BY slug ORDER BY seq)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY slug ORDER BY seq) AS run FROM s), p AS (SELECT slug, run, count(*) FILTER (NOT ok) AS failures FROM r GROUP BY 1, 2)
          SELECT slug, max_by(failures, run) AS failures, CASE WHEN max_by(failures, run) >= 3 THEN 'quarantined' ELSE 'active' END AS state FROM p GROUP BY slug""")
MARK, SINCE = 100, "2024-01-10 00:00:00"


def learned(k: Knowledge) -> DataFrame:
    once = cut(U.learning_step(k.klinks, k.khits, MARK, SINCE))
    mark = once.agg(F.max("watermark")).first()[0]
    return U.learning_step(once.drop("watermark"), k.khits, mark, SINCE).groupBy("relation").agg(F.round(F.sum("weight"), 4).alias("weight"), F.max("watermark").alias("watermark"))


query("t4_learning_step", learned,
      f"""WITH h AS (SELECT *, id > {MARK} AND created_at >= TIMESTAMP '{SINCE}' AS fresh FROM khits), s AS (SELECT DISTINCT session_id FROM h WHERE fresh), p AS (SELECT a.slug AS a, b.slug AS b, count(*) AS n FROM h a JOIN h b ON a.session_id = b.session_id AND a.slug < b.slug WHERE a.session_id IN (SELECT session_id FROM s) AND (a.fresh OR b.fresh) GROUP BY 1, 2)
          SELECT relation, round(sum(CASE WHEN n IS NULL THEN weight ELSE least(10e0, weight + 0.1e0 * n) END), 4) AS weight, (SELECT max(id) FROM khits) AS watermark FROM klinks LEFT JOIN p ON a = least(from_slug, to_slug) AND b = greatest(from_slug, to_slug) GROUP BY relation""")


def nights(k: Knowledge) -> DataFrame:
    path = folder(k, "night")

    def broken(tables, as_of):
        raise ValueError("no")

    stages = [("rank", lambda t, d: {"pages": t["pages"].filter("tier = 1")}), ("broken", broken), ("links", lambda t, d: {"links": t["links"].join(t["pages"].select(F.col("slug").alias("to_slug")), "to_slug", "left_semi")})]
    lock = nightly.Lock(k.spark, f"{path}.lock")
    run = nightly.Nightly(path, stages, lock=lock)
    out = run.run({"pages": k.kpages, "links": k.klinks}, "2001-08-02")
    lock.acquire(time.time())
    second = nightly.Nightly(path, stages, lock=lock)
    second.run({}, "2001-08-02")
    lock.release()
    rows = [(r.stage, int(r.ok), {"rank": out["pages"], "links": out["links"]}[r.stage].count() if r.ok else 0) for r in (*run.reports, *second.reports)]
    return k.spark.createDataFrame(rows, "stage string, ok int, rows long")


query("t9_nightly", nights, "SELECT 'rank' AS stage, 1 AS ok, (SELECT count(*) FROM kpages WHERE tier = 1) AS rows UNION ALL SELECT 'broken', 0, 0 UNION ALL SELECT 'links', 1, (SELECT count(*) FROM klinks WHERE to_slug IN (SELECT slug FROM kpages WHERE tier = 1)) UNION ALL SELECT 'lock', 0, 0")

# ---- research ----
ASKED = "SELECT CAST(k AS BIGINT) AS id, CASE k % 7 WHEN 0 THEN 'a 和 b 的关系' WHEN 1 THEN '最近怎样' WHEN 2 THEN '对比一下' WHEN 3 THEN '总结' WHEN 4 THEN '有没有遗漏' ELSE 'who is this' END AS query FROM (SELECT DISTINCT k FROM kqlog) x"
NAMED = "SELECT CAST(k AS BIGINT) AS id, 'entity/person/c-' || CAST(k AS STRING) AS slug FROM (SELECT DISTINCT k FROM kqlog) x WHERE k % 5 <> 0 UNION SELECT CAST(k AS BIGINT), CASE WHEN k % 2 = 0 THEN 'entity/location/n-' || CAST(k % 30 AS STRING) ELSE 'nowhere/' || CAST(k AS STRING) END FROM (SELECT DISTINCT k FROM kqlog) x"


def judged(k: Knowledge):
    steps = cut(Q.plan(k.sql(ASKED)))
    found = cut(Q.execute(steps, k.sql(NAMED), k.kpages, k.kchunks, k.klinks, k.ktimeline))
    return steps, Q.judge(k.sql(ASKED), steps, found, k.sql(NAMED), k.klinks, k.ktimeline)


KIND = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(query, {w!r})' for w in words)} THEN '{name}'" for name, words in Q.INTENTS) + " ELSE 'entity_lookup' END"
STEPS = "(VALUES " + ", ".join(f"('{i}', '{kind}')" for i, steps in Q.STEPS.items() for kind, _ in steps if kind != "resolve") + ") st(intent, kind)"
JUDGED = f"""WITH q AS (SELECT id, {KIND} AS intent FROM ({ASKED}) a), n AS ({NAMED}), g AS (SELECT slug, count(*) AS c FROM (SELECT from_slug AS slug FROM klinks WHERE {CURRENT} UNION ALL SELECT to_slug FROM klinks WHERE {CURRENT} AND to_slug <> from_slug) x GROUP BY 1), e AS (SELECT page_slug AS slug, count(*) AS c FROM ktimeline WHERE {ACTIVE} GROUP BY 1), c AS (SELECT page_slug AS slug, count(*) AS c FROM kchunks GROUP BY 1),
  f AS (SELECT q.id, kind, n.slug, CASE kind WHEN 'graph' THEN g.c WHEN 'timeline' THEN e.c WHEN 'chunks' THEN c.c ELSE CASE WHEN n.slug IN (SELECT slug FROM kpages) THEN 1 END END AS found FROM q JOIN {STEPS} ON st.intent = q.intent JOIN n ON n.id = q.id LEFT JOIN g ON g.slug = n.slug LEFT JOIN e ON e.slug = n.slug LEFT JOIN c ON c.slug = n.slug), h AS (SELECT * FROM f WHERE found IS NOT NULL),
  o AS (SELECT from_slug AS slug FROM klinks WHERE {CURRENT} AND trust_state = 'trusted' UNION ALL SELECT to_slug FROM klinks WHERE {CURRENT} AND trust_state = 'trusted' AND to_slug <> from_slug UNION ALL SELECT page_slug FROM ktimeline WHERE trust_state = 'trusted'), oc AS (SELECT slug, count(*) AS c FROM o GROUP BY 1),
  s AS (SELECT q.*, coalesce((SELECT sum(oc.c) FROM n JOIN oc ON oc.slug = n.slug WHERE n.id = q.id), 0)::BIGINT AS facts, (SELECT count(DISTINCT slug) FROM (SELECT id, slug FROM h WHERE kind <> 'timeline' UNION SELECT n.id, n.slug FROM n JOIN oc ON oc.slug = n.slug) z WHERE z.id = q.id) AS sources, (SELECT count(*) FROM {STEPS} WHERE st.intent = q.intent AND st.kind NOT IN (SELECT kind FROM h WHERE h.id = q.id)) AS gaps,
    (SELECT count(*) FROM h WHERE h.id = q.id AND kind = 'graph') AS gr, (SELECT count(*) FROM h WHERE h.id = q.id AND kind = 'timeline') AS tl, (SELECT count(*) FROM h WHERE h.id = q.id AND kind IN ('page', 'chunks')) AS pg FROM q),
  j AS (SELECT *, CASE intent WHEN 'relationship' THEN gr > 0 WHEN 'timeline' THEN tl > 0 WHEN 'comparison' THEN sources >= 2 WHEN 'gap_analysis' THEN gaps > 0 OR facts > 0 ELSE facts > 0 OR pg > 0 END AS ok FROM s)
  SELECT id, intent, CAST(ok AS INT) AS sufficient, CASE WHEN NOT ok THEN 'low' WHEN facts > 0 THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN NOT ok THEN CASE WHEN intent IN ('relationship', 'timeline', 'comparison') THEN intent WHEN intent = 'gap_analysis' THEN 'evidence' ELSE 'entity' END END AS missing, facts, sources FROM j"""
query("h21_plan_execute_critique", lambda k: judged(k)[1], JUDGED)
query("h21_follow_ups", lambda k: (lambda p: Q.follow_ups(p[1], p[0], k.sql(NAMED)))(judged(k)),
      f"""WITH jj AS ({JUDGED}), more(missing, place, kind, basis) AS (VALUES ('relationship', 0, 'graph-neighbors', 'x'), ('relationship', 1, 'graph-traverse', 'x'), ('timeline', 0, 'timeline', 'x'), ('comparison', 0, 'page', 'x'), ('comparison', 1, 'chunks', 'x'), ('entity', 0, 'page', 'entity'), ('entity', 1, 'chunks', 'entity')),
          tried(intent, kind) AS (VALUES {", ".join(f"('{i}', '{t}')" for i, steps in Q.STEPS.items() for kind, d in steps for t in ([f'graph-{d}'] + (['graph-neighbors'] if d == 'traverse' else []) if kind == 'graph' else [kind]))}),
          u AS (SELECT jj.id, m.kind, n.slug AS target, place FROM jj JOIN more m ON m.missing = jj.missing JOIN ({NAMED}) n ON n.id = jj.id WHERE sufficient = 0 AND NOT EXISTS (SELECT 1 FROM tried t WHERE t.intent = jj.intent AND t.kind = m.kind) UNION ALL SELECT id, 'search', NULL, 9 FROM jj WHERE sufficient = 0)
          SELECT id, kind, target FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place, target) AS rn FROM u) z WHERE rn <= 3""")


def researched(k: Knowledge) -> DataFrame:
    titles = k.kpages.select("slug", "title", "type")

    def search(text: str) -> DataFrame:
        return titles.filter(F.lower("title").contains(text.lower())).orderBy("slug").limit(5).select("slug", "title")

    def follow_up(hits: DataFrame) -> list[str]:
        up = k.klinks.filter("relation = 'part_of'").join(hits.select(F.col("slug").alias("from_slug")).distinct(), "from_slug", "left_semi")
        return [r[0] for r in up.join(titles.select(F.col("slug").alias("to_slug"), F.col("title").alias("t")), "to_slug").select("t").distinct().orderBy("t").limit(3).collect()]

    return Q.research(search, follow_up, "nation_1").select("slug", "query", F.col("round").cast("int").alias("round"))


query("h7_multi_step_research", researched,
      """WITH a AS (SELECT slug FROM kpages WHERE contains(lower(title), 'nation_1') ORDER BY slug LIMIT 5), f AS (SELECT DISTINCT p.title AS t FROM klinks l JOIN kpages p ON p.slug = l.to_slug WHERE relation = 'part_of' AND from_slug IN (SELECT slug FROM a) ORDER BY t LIMIT 3),
         b AS (SELECT slug, t, row_number() OVER (PARTITION BY t ORDER BY slug) AS rn FROM f JOIN kpages ON contains(lower(title), lower(t))) SELECT slug, 'nation_1' AS query, 0 AS round FROM a UNION ALL SELECT slug, t, 1 FROM b WHERE rn <= 5""")
