"""Queries of merges, jobs, records, action drafts, batches, extraction filters and contradictions, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwell.operators import evidence as E
from loomwell.operators import knowledge as N
from loomwell.operators import stewardship as S
from loomwell.plans.adapters import ORDER_AS_OF
from loomwell.plans.registry import query

# ---- merges ----
MERGED = """SELECT 'entity/company/s-' || CAST(s_suppkey AS STRING) AS source, 'entity/person/c-' || CAST(s_suppkey AS STRING) AS target FROM supplier UNION ALL SELECT 'entity/location/n-' || CAST(n_nationkey AS STRING), 'entity/location/r-' || CAST(n_regionkey AS STRING) FROM nation
  UNION ALL SELECT 'records/doc-' || CAST(doc_id AS STRING), 'concept/product/p-' || CAST(doc_id AS STRING) FROM documents UNION ALL SELECT 'concept/product/p-' || CAST(p_partkey AS STRING), 'entity/company/s-' || CAST(p_partkey AS STRING) FROM part UNION ALL SELECT 'entity/person/c-1', 'entity/person/c-1'"""
NOTES = "SELECT 'records/doc-' || CAST(doc_id AS STRING) AS slug, 'see [[' || CASE WHEN doc_id % 2 = 0 THEN 's-' ELSE 'entity/company/s-' END || CAST(doc_id % 50 AS STRING) || '|x]] and [[n-' || CAST(doc_id % 30 AS STRING) || ']]' AS body FROM documents"
MENTIONED = "SELECT 'records/doc-' || CAST(doc_id AS STRING) AS slug, CASE WHEN doc_id % 2 = 0 THEN 's-' ELSE 'entity/company/s-' END || CAST(doc_id % 50 AS STRING) AS target FROM documents UNION ALL SELECT 'records/doc-' || CAST(doc_id AS STRING), 'n-' || CAST(doc_id % 30 AS STRING) FROM documents"


def mentions(k):
    return k.sql(NOTES).select("slug", F.explode(N.wikilinks(F.col("body"))).alias("target"))


AFFINE = " OR ".join(f"(a.type IN {g!r} AND b.type IN {g!r})" for g in S.AFFINE_TYPES)
query("e12_merge_plan", lambda k: S.merge_plan(k.sql(MERGED), k.kpages, k.klinks, k.ktimeline, k.kaliases, k.ktags, mentions(k)),
      f"""WITH m AS ({MERGED}), w AS ({MENTIONED}), o AS (SELECT from_slug AS slug, count(*) AS n FROM klinks GROUP BY 1), i AS (SELECT to_slug AS slug, count(*) AS n FROM klinks GROUP BY 1), e AS (SELECT page_slug AS slug, count(*) AS n FROM ktimeline GROUP BY 1),
          l AS (SELECT page_slug AS slug, count(*) AS n FROM kaliases GROUP BY 1), t AS (SELECT source, target, count(DISTINCT tag) AS n FROM m JOIN ktags ON page_slug IN (source, target) GROUP BY 1, 2), s AS (SELECT source, count(DISTINCT w.slug) AS n FROM (SELECT DISTINCT source FROM m) x JOIN w ON w.target IN (source, regexp_extract(source, '[^/]*$')) GROUP BY 1),
          j AS (SELECT m.*, a.title AS ta, b.title AS tb, CASE WHEN (a.type = 'record') <> (b.type = 'record') THEN 'cross_layer' WHEN a.type <> b.type AND NOT ({AFFINE}) THEN 'types' END AS conflict FROM m JOIN kpages a ON a.slug = source JOIN kpages b ON b.slug = target WHERE source <> target)
          SELECT j.source, j.target, conflict, CAST(conflict IS NULL AS INT) AS allowed, CAST(ta <> tb AS INT) AS new_alias, coalesce(o.n, 0) AS outgoing, coalesce(i.n, 0) AS incoming, coalesce(e.n, 0) AS events, coalesce(l.n, 0) AS aliases, coalesce(t.n, 0) AS tags, coalesce(s.n, 0) AS mentions
          FROM j LEFT JOIN o ON o.slug = j.source LEFT JOIN i ON i.slug = j.source LEFT JOIN e ON e.slug = j.source LEFT JOIN l ON l.slug = j.source LEFT JOIN t ON t.source = j.source AND t.target = j.target LEFT JOIN s ON s.source = j.source""")
query("e12_merge_residue", lambda k: S.merge_residue(k.sql("SELECT slug AS source FROM kpages WHERE type = 'entity/company' UNION ALL SELECT 'entity/company/s-0' UNION ALL SELECT 'nowhere/x'"), k.kpages, k.klinks, mentions(k)),
      f"""WITH s AS (SELECT slug AS source FROM kpages WHERE type = 'entity/company' UNION SELECT 'entity/company/s-0' UNION SELECT 'nowhere/x'), w AS ({MENTIONED}), l AS (SELECT slug, count(*) AS n FROM (SELECT from_slug AS slug FROM klinks UNION ALL SELECT to_slug FROM klinks WHERE to_slug <> from_slug) x GROUP BY 1),
          c AS (SELECT source, CAST(source IN (SELECT slug FROM kpages) AS INT) AS page, coalesce(l.n, 0) AS links, (SELECT count(*) FROM w WHERE w.target = source OR w.target = regexp_extract(source, '[^/]*$')) AS mentions FROM s LEFT JOIN l ON l.slug = source) SELECT *, CAST(page = 0 AND links = 0 AND mentions = 0 AS INT) AS clean FROM c""")

# ---- jobs ----
STEPPED = """SELECT o_orderkey AS id, CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' WHEN 3 THEN 'done' ELSE 'cancelled' END AS status, CAST(o_orderkey % 4 AS INT) AS attempts, 3 AS max_attempts, CAST(o_orderdate AS TIMESTAMP) AS started_at,
  o_orderpriority AS stage, CASE CAST(o_custkey % 6 AS INT) WHEN 0 THEN 'fail' WHEN 1 THEN 'complete' WHEN 2 THEN 'cancel' WHEN 3 THEN 'retry' WHEN 4 THEN 'none' END AS op FROM orders"""
query("m11_job_step", lambda k: S.job_step(k.sql(STEPPED).select("id", "status", "attempts", "max_attempts", "started_at", F.create_map(F.lit("stage"), "stage", F.lit("was"), F.lit("1")).alias("result")),
          k.sql(STEPPED).filter("op is not null").select("id", "op", F.create_map(F.lit("stage"), F.lit("end"), F.lit("now"), F.lit("2")).alias("result")), ORDER_AS_OF, 60 * 24 * 365).select("id", "status", "attempts", F.col("started_at").isNull().cast("int").alias("unstarted"), F.col("result")["stage"].alias("stage"), F.col("result")["was"].alias("was"), F.col("result")["now"].alias("now")),
      f"""WITH j AS ({STEPPED}), s AS (SELECT *, status IN ('pending', 'running') AS live, CASE WHEN status IN ('pending', 'running') AND op = 'fail' THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END WHEN status IN ('pending', 'running') AND op = 'complete' THEN 'done' WHEN status IN ('pending', 'running') AND op = 'cancel' THEN 'cancelled' WHEN status = 'failed' AND op = 'retry' THEN 'pending' ELSE status END AS next FROM j),
          t AS (SELECT *, status = 'failed' AND op = 'retry' AS again, next = 'running' AND started_at <= TIMESTAMP '{ORDER_AS_OF}' - INTERVAL 525600 MINUTE AS stale, coalesce(live AND op = 'complete', FALSE) AS finished FROM s)
          SELECT id, CASE WHEN stale THEN 'pending' ELSE next END AS status, CASE WHEN coalesce(again, FALSE) THEN 0 ELSE attempts END AS attempts, CAST(stale OR coalesce(again, FALSE) AS INT) AS unstarted, CASE WHEN finished THEN 'end' ELSE stage END AS stage, '1' AS was, CASE WHEN finished THEN '2' END AS now FROM t""")

QUEUED = "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'cancelled' ELSE 'pending' END AS status, CAST(o_orderkey % 2 AS INT) AS attempts, 3 AS max_attempts, CAST(o_custkey % 5 AS INT) AS priority, CAST(NULL AS TIMESTAMP) AS started_at, CAST(o_custkey % 7 AS INT) AS luck FROM orders"


def worked(k):
    luck = k.sql(QUEUED).select("id", "luck")

    def run(claimed):
        op = F.when(F.col("luck") == 0, "cancel").when((F.col("luck") < 3) & (F.col("attempts") < 10), "fail").otherwise("complete")
        return claimed.join(luck, "id").select("id", op.alias("op"), F.create_map(F.lit("by"), F.lit("worker")).alias("result"))

    jobs = k.sql(QUEUED).drop("luck").withColumn("result", F.lit(None).cast("map<string,string>"))
    return S.work(jobs, run, ORDER_AS_OF).select("id", "status", "attempts", F.col("result")["by"].alias("by"))


query("t10_worker", worked,
      f"SELECT id, CASE WHEN status = 'cancelled' OR luck = 0 THEN 'cancelled' WHEN luck < 3 THEN 'failed' ELSE 'done' END AS status, CASE WHEN status = 'cancelled' THEN attempts WHEN luck IN (1, 2) THEN 3 ELSE attempts + 1 END AS attempts, CASE WHEN status <> 'cancelled' AND luck >= 3 THEN 'worker' END AS by FROM ({QUEUED}) q")

# ---- records ----
RECORDS = """SELECT 'r' || CAST(o_orderkey AS STRING) AS record_id, 'k' || CAST(o_custkey AS STRING) AS key, o_orderpriority AS priority, o_orderstatus AS status, CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'pending' WHEN 1 THEN 'rejected' WHEN 2 THEN 'superseded' ELSE 'current' END AS lifecycle,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN TIMESTAMP '1999-01-01 00:00:00' ELSE TIMESTAMP '2030-01-01 00:00:00' END AS suppressed_until, o_orderkey AS seq FROM orders"""
PROPOSED = "SELECT 'new-' || CAST(c_custkey AS STRING) AS record_id, 'k' || CAST(c_custkey AS STRING) AS key, CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN '1-URGENT' WHEN 1 THEN '3-MEDIUM' ELSE '5-LOW' END AS priority, CASE WHEN c_custkey % 2 = 0 THEN 'O' ELSE 'F' END AS status FROM customer"


def payload():
    return F.create_map(F.lit("status"), "status", F.lit("priority"), "priority")


PRINT = """sha256('{"priority":"' || priority || '","status":"' || status || '"}')"""
query("m9_store_records", lambda k: S.store_records(k.sql(RECORDS).withColumn("fingerprint", S.record_fingerprint(payload())), k.sql(PROPOSED).withColumn("payload", payload()), ORDER_AS_OF),
      f"""WITH r AS (SELECT *, {PRINT} AS fingerprint FROM ({RECORDS}) x), p AS (SELECT *, {PRINT} AS fingerprint FROM ({PROPOSED}) x), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM r WHERE lifecycle IN ('pending', 'current')) x WHERE rn = 1),
          d AS (SELECT p.*, a.record_id AS active_id, CASE WHEN a.fingerprint = p.fingerprint THEN 'unchanged' WHEN EXISTS (SELECT 1 FROM r WHERE r.key = p.key AND r.fingerprint = p.fingerprint AND r.lifecycle = 'rejected' AND (r.suppressed_until IS NULL OR r.suppressed_until > TIMESTAMP '{ORDER_AS_OF}')) THEN 'suppressed' ELSE 'created' END AS done FROM p LEFT JOIN a ON a.key = p.key)
          SELECT record_id, key, fingerprint, CASE WHEN done = 'created' THEN 'pending' END AS lifecycle, done FROM d UNION ALL SELECT record_id, key, fingerprint, CASE WHEN record_id IN (SELECT active_id FROM d WHERE done = 'created') THEN 'superseded' ELSE lifecycle END, CASE WHEN record_id IN (SELECT active_id FROM d WHERE done = 'created') THEN 'superseded' ELSE 'kept' END FROM r""")
MOVES = "SELECT 'r' || CAST(o_orderkey AS STRING) AS record_id, CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN 'current' WHEN 1 THEN 'rejected' WHEN 2 THEN 'invalidated' ELSE 'superseded' END AS to, CAST(o_orderdate AS TIMESTAMP) AS at FROM orders WHERE o_orderstatus <> 'P'"
LEGAL = " OR ".join(f"(lifecycle = '{s}' AND m.to IN ({', '.join(repr(t) for t in to)}))" for s, to in S.LIFECYCLE.items() if to)
query("m9_lifecycle", lambda k: S.lifecycle_step(k.sql(RECORDS).select("record_id", "lifecycle"), k.sql(MOVES)).select("record_id", "lifecycle", "ok", F.unix_micros("suppressed_until").alias("until_us")),
      f"SELECT r.record_id, CASE WHEN {LEGAL} THEN m.to ELSE lifecycle END AS lifecycle, CASE WHEN m.to IS NOT NULL THEN CAST(coalesce({LEGAL}, FALSE) AS INT) END AS ok, CASE WHEN ({LEGAL}) AND m.to = 'rejected' THEN epoch_us(m.at + INTERVAL 30 DAY) END AS until_us FROM ({RECORDS}) r LEFT JOIN ({MOVES}) m ON m.record_id = r.record_id")
AXES = {"evidence": ["content_hash"], "constraint": ["tier"], "option": ["mention_count"], "dependency": ["link_count"], "conclusion": ["verdict"]}
SIDE = "SELECT slug AS record, content_hash, tier, CASE WHEN mention_count % 5 <> 0 THEN mention_count END AS mention_count, link_count, CASE WHEN confidence_decay > 0.5e0 THEN 'propose' ELSE 'abstain' END AS verdict FROM {0}"
query("m10_record_diff", lambda k: S.record_diff(S.record_axes(k.sql(SIDE.format("ksnap_old")), AXES), S.record_axes(k.sql(SIDE.format("ksnap_new")), AXES)),
      "WITH " + ", ".join(f"{n} AS (" + " UNION ALL ".join(f"SELECT record, '{a}' AS axis, '{c}' AS key, CAST({c} AS VARCHAR) AS value FROM ({SIDE.format(t)}) x WHERE {c} IS NOT NULL" for a, (c,) in AXES.items()) + ")" for n, t in (("o", "ksnap_old"), ("n", "ksnap_new")))
      + " SELECT coalesce(o.record, n.record) AS record, coalesce(o.axis, n.axis) AS axis, coalesce(o.key, n.key) AS key, CASE WHEN o.value IS NULL THEN 'added' WHEN n.value IS NULL THEN 'removed' ELSE 'changed' END AS change, o.value AS before, n.value AS after FROM o FULL JOIN n ON o.record = n.record AND o.key = n.key WHERE o.value IS DISTINCT FROM n.value AND coalesce(o.record, n.record) IN (SELECT slug FROM ksnap_old) AND coalesce(o.record, n.record) IN (SELECT slug FROM ksnap_new)")
INPUTS = "SELECT slug AS record, CAST(tier AS STRING) AS tier, content_hash AS body, CASE WHEN mention_count % 7 = 0 THEN 'tampered' ELSE content_hash END AS seen, CASE WHEN tier = 1 OR mention_count % 5 = 0 THEN 'propose' ELSE 'abstain' END AS conclusion FROM kpages"
query("m10_replay", lambda k: S.replay(k.sql(INPUTS).select("record", "conclusion", F.create_map(F.lit("tier"), "tier", F.lit("body"), "body").alias("inputs"), S.record_fingerprint(F.create_map(F.lit("body"), "seen", F.lit("tier"), "tier")).alias("inputs_hash")), F.when(F.col("inputs")["tier"] == "1", "propose").otherwise("abstain")),
      f"SELECT record, CASE WHEN body <> seen THEN 'corrupt' WHEN (tier = '1') = (conclusion = 'propose') THEN 'same' ELSE 'differs' END AS status FROM ({INPUTS}) x")

# ---- drafts ----
FOUND = "SELECT id, CASE CAST(id % 7 AS INT) WHEN 5 THEN 'similar_entity' WHEN 6 THEN 'structural_hole' ELSE type END AS type, score, actionable, occurrence_count, CASE WHEN id % 2 = 0 THEN type || entity_a END AS dedup_key, id % 13 = 0 AS has_actions FROM kdiscoveries"
SHOWN = "(VALUES " + ", ".join(f"('{t}', '{v[0]}')" for t, v in S.DISCOVERY_DISPLAY.items()) + ") d(kind, title)"
PLANNED = """SELECT relation AS dimension, CASE WHEN weight > 0.5e0 THEN source_type END AS kind, CASE CAST(length(link_key) % 4 AS INT) WHEN 0 THEN 'blocked' WHEN 1 THEN 'auto_repairable' WHEN 2 THEN 'observe_only' ELSE 'needs_review' END AS "group",
  CASE WHEN confidence >= 1 THEN 'high' WHEN confidence >= 0.6e0 THEN 'medium' ELSE 'info' END AS severity, CASE WHEN trust_state IS NULL THEN '-' ELSE from_slug END AS slug, CASE WHEN trust_state = 'rejected' THEN 'C1' END AS code FROM klinks"""
ALWAYS = ", ".join(f"'{t}'" for t in S.ALWAYS)
query("l14_action_candidates", lambda k: S.discovery_drafts(k.sql(FOUND)).unionByName(S.health_drafts(k.sql(PLANNED.replace('"', "`")))).groupBy(*[c for c in S.DRAFT if c not in ("ref", "score")]).agg(F.count_distinct("ref").alias("refs"), F.round(F.sum("score"), 4).alias("score"), F.min("ref").alias("first")),
      f"""WITH x AS (SELECT 'action_review_discovery' AS type, 'discovery:' || coalesce(dedup_key, CAST(id AS VARCHAR)) AS ref, greatest(0.1e0, least(1e0, score)) AS score, actionable, title, CASE WHEN occurrence_count >= 3 THEN '{S.RECURRING}' ELSE '{S.IMPORTANT}' END AS reason, 'review' AS action, 'discovery' AS source, f.type AS kind
            FROM ({FOUND}) f JOIN {SHOWN} ON d.kind = f.type WHERE actionable = 'high' OR occurrence_count >= 3 OR has_actions OR f.type IN ({ALWAYS})
          UNION ALL SELECT CASE WHEN "group" = 'auto_repairable' THEN 'action_repair_preview' ELSE 'action_health_review' END, 'health:' || dimension || ':' || coalesce(kind, "group") || ':' || coalesce(code, CASE WHEN slug <> '-' THEN slug END, 'global'), CASE severity WHEN 'high' THEN 0.9e0 WHEN 'medium' THEN 0.6e0 ELSE 0.3e0 END,
            CASE WHEN severity IN ('high', 'medium') THEN severity ELSE 'low' END, CASE "group" WHEN 'blocked' THEN '{S.HEALTH_DISPLAY["blocked"]}' WHEN 'auto_repairable' THEN '{S.HEALTH_DISPLAY["auto_repairable"]}' ELSE '{S.HEALTH_DISPLAY["needs_review"]}' END, CASE WHEN "group" = 'auto_repairable' THEN '预览这项修复，不自动执行。' ELSE '复核这项健康信号是否需要后续处理。' END,
            CASE WHEN "group" = 'auto_repairable' THEN 'dry_run' ELSE 'review' END, 'health', coalesce(kind, "group") FROM ({PLANNED}) p WHERE "group" <> 'observe_only')
          SELECT type, actionable, title, reason, action, source, kind, count(DISTINCT ref) AS refs, round(sum(score), 4) AS score, min(ref) AS first FROM x GROUP BY ALL""")

# ---- batches ----
OPERATIONS = "SELECT id, CASE CAST(id % 3 AS INT) WHEN 0 THEN 'delete' WHEN 1 THEN 'link' ELSE 'merge' END AS op, 'entity/person/c-' || CAST(id AS STRING) AS slug, 'entity/person/c-' || CAST(CASE WHEN id % 4 = 0 THEN id ELSE id * 2 END AS STRING) AS target FROM kqlog"
RESULTS = f"SELECT id, op, slug, target, CASE WHEN op <> 'delete' AND slug = target THEN 'invalid' WHEN slug NOT IN (SELECT slug FROM kpages) OR (op <> 'delete' AND target NOT IN (SELECT slug FROM kpages)) THEN 'missing' ELSE 'ok' END AS result FROM ({OPERATIONS}) o"
query("m15_batch_operations", lambda k: S.batch_results(k.kpages, k.sql(OPERATIONS)), RESULTS)
query("m15_batch_links", lambda k: S.apply_batch(k.kpages, k.klinks, k.sql(OPERATIONS))[1].groupBy("relation").agg(F.count("*").alias("n"), F.min("from_slug").alias("first"), F.max("to_slug").alias("last")),
      f"""WITH r AS ({RESULTS}), g AS (SELECT slug, CASE WHEN op = 'merge' THEN target END AS into_ FROM r WHERE result = 'ok' AND op <> 'link'), l AS (SELECT from_slug, to_slug, relation FROM klinks UNION ALL SELECT slug, target, 'mentions' FROM r WHERE result = 'ok' AND op = 'link'),
          a AS (SELECT CASE WHEN g.slug IS NULL THEN from_slug ELSE into_ END AS f, to_slug, relation FROM l LEFT JOIN g ON g.slug = from_slug), b AS (SELECT f, CASE WHEN g.slug IS NULL THEN to_slug ELSE into_ END AS t, relation FROM a LEFT JOIN g ON g.slug = to_slug),
          c AS (SELECT DISTINCT f, t, relation FROM b WHERE f IS NOT NULL AND t IS NOT NULL AND f <> t AND f NOT IN (SELECT slug FROM g) AND t NOT IN (SELECT slug FROM g)) SELECT relation, count(*) AS n, min(f) AS first, max(t) AS last FROM c GROUP BY relation""")

# ---- extraction ----
EXTRACTED = """SELECT o_custkey AS doc, o_orderkey AS pos, CASE CAST(o_orderkey % 12 AS INT) WHEN 0 THEN '未来' WHEN 1 THEN '3' WHEN 2 THEN 'v12' WHEN 3 THEN 'abcdefghijklm' WHEN 4 THEN 'AB' WHEN 5 THEN '产品经理' WHEN 6 THEN '2024年5月' WHEN 7 THEN '目录' WHEN 8 THEN '平台化' WHEN 9 THEN '红星集团' ELSE 'Name ' || CAST(o_orderkey AS STRING) END AS name,
  CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'person' WHEN 1 THEN 'concept' WHEN 2 THEN 'company' WHEN 3 THEN 'technology' ELSE 'weather' END AS kind, CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN NULL ELSE 'high' END AS relevance FROM orders"""
quoted = lambda words: ", ".join(f"'{w}'" for w in words)
query("p24_extracted_entities", lambda k: S.extracted_entities(k.sql(EXTRACTED), 4, 3),
      f"""WITH c AS ({EXTRACTED}), d AS (SELECT *, kind IN ({quoted(S.ENTITY_KINDS)}) AS concrete, CASE WHEN name IN ({quoted(S.GENERIC_TERMS)}) THEN 'blacklisted' WHEN length(name) < 2 THEN 'too_short' WHEN regexp_matches(name, '^\\d+$|^#\\d+$') OR regexp_matches(name, '(?i)^v\\d+$') THEN 'numeric' WHEN contains(name, '@') THEN 'unclassified_type'
            WHEN regexp_matches(name, '^[a-z][a-z0-9]{{10,}}$') THEN CASE WHEN kind <> 'concept' THEN 'hash_like' ELSE 'unclassified_type' END WHEN regexp_matches(name, '^[A-Z]{{2}}$') AND kind <> 'concept' THEN 'two_letter_code' WHEN regexp_matches(name, '{S.JOB_TITLE}') THEN 'job_title' WHEN regexp_matches(name, '{S.DATED}') THEN 'date_pattern' WHEN name IN ({quoted(S.STRUCTURAL_TERMS)}) THEN 'structural_term'
            WHEN kind NOT IN ({quoted(S.ENTITY_KINDS)}) AND regexp_matches(name, '{S.GENERIC_SUFFIX}') THEN 'generic_suffix' END AS why FROM c),
          e AS (SELECT *, CASE WHEN why IS NULL THEN CASE WHEN regexp_matches(name, '{S.ORGANISATION}') THEN 'entity' WHEN kind IN ({quoted(S.CONCEPT_KINDS)}) THEN 'concept' WHEN concrete THEN 'entity' END END AS family FROM d),
          f AS (SELECT *, coalesce(why, CASE WHEN family IS NULL THEN 'unclassified_type' WHEN coalesce(relevance, 'low') = 'low' THEN 'low_relevance' END) AS cut FROM e),
          g AS (SELECT *, row_number() OVER (PARTITION BY doc, cut IS NULL, family ORDER BY CASE WHEN relevance = 'high' THEN 0 ELSE 1 END, pos) AS rn FROM f) SELECT doc, pos, name, family, coalesce(cut, CASE WHEN rn > CASE WHEN family = 'concept' THEN 3 ELSE 4 END THEN family || '_cap' END) AS reason FROM g""")

# ---- contradictions ----
CONTEXTS = "SELECT page_slug AS slug, id AS record, CASE trust_state WHEN 'rejected' THEN '不' || summary WHEN 'candidate' THEN summary || ' 任职' WHEN 'user_thought' THEN summary || ' 离职' ELSE summary || ' 的' END AS text FROM ktimeline"
STATES = ", ".join(f"CASE WHEN {' OR '.join(f'contains(joined, {t!r})' for t in no)} THEN 2 WHEN {' OR '.join(f'contains(joined, {t!r})' for t in yes)} THEN 1 ELSE 0 END" for yes, no in E.OPPOSITES)
CONFLICTS = f"""WITH c AS ({CONTEXTS}), t AS (SELECT slug, record, list_filter(string_split(text, ''), lambda x: NOT regexp_matches(x, '[\\s，。、；：！？]') AND NOT list_contains([{quoted(E.STOP_CHARACTERS)}], x)) AS chars FROM c),
  u AS (SELECT slug, record, list_distinct(chars) AS s, len(list_intersect(chars, [{quoted(E.NEGATIONS)}])) > 0 AS neg, array_to_string(chars, '') AS joined FROM t WHERE len(chars) >= 3), v AS (SELECT *, [{STATES}] AS states FROM u)
  SELECT a.slug, a.record AS a, b.record AS b FROM v a JOIN v b ON a.slug = b.slug AND a.record < b.record WHERE len(list_intersect(a.s, b.s)) >= 0.2e0 * least(len(a.s), len(b.s)) AND (a.neg <> b.neg OR len(list_filter(list_zip(a.states, b.states), lambda z: z[1] > 0 AND z[2] > 0 AND z[1] <> z[2])) > 0)"""
query("e13_contradictions", lambda k: E.context_conflicts(k.sql(CONTEXTS)), CONFLICTS)
query("l8_contradiction_pairs", lambda k: E.context_conflicts(k.sql(CONTEXTS)).groupBy("slug").agg(F.count("*").alias("n"), F.min("a").alias("first")), f"SELECT slug, count(*) AS n, min(a) AS first FROM ({CONFLICTS}) x GROUP BY slug")
