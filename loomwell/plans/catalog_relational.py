"""Queries over filters, joins, aggregates, windows, rankings and set operations, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwell.functions import exprs as X
from loomwell.operators import relational as R
from loomwell.plans.adapters import EVENT_AS_OF, ORDER_AS_OF, Knowledge
from loomwell.plans.registry import query

ACTIVE = "(trust_state IS NULL OR trust_state NOT IN ('rejected', 'superseded'))"
CURRENT = f"({ACTIVE} AND NOT (relation = 'reports_to' AND trust_state IS NOT DISTINCT FROM 'candidate'))"
EOC = "(type LIKE 'entity/%' OR type LIKE 'concept/%')"
ENDS_ONCE = f"(SELECT from_slug AS slug, link_key FROM klinks WHERE {CURRENT} UNION SELECT to_slug, link_key FROM klinks WHERE {CURRENT})"
NEIGHBOURS = f"(SELECT from_slug AS slug, to_slug AS neighbour FROM klinks WHERE {CURRENT} UNION SELECT to_slug, from_slug FROM klinks WHERE {CURRENT})"
AS_OF = f"TIMESTAMP '{ORDER_AS_OF}'"
E_AS_OF = f"TIMESTAMP '{EVENT_AS_OF}'"
DAY = "INTERVAL 1 DAY"


def since_orders(days: int):
    return X.ts(ORDER_AS_OF) - F.expr(f"INTERVAL {days} DAYS")


# ---- scans ----
query("s3_point_reads", lambda k: k.kpages.filter((F.col("slug") == "entity/person/c-7") | (F.col("title") == "Customer#000000009")).select("slug", "title", "type"),
      "SELECT slug, title, type FROM kpages WHERE slug = 'entity/person/c-7' OR title = 'Customer#000000009'")
query("s4_filtered_pages", lambda k: R.filtered_pages(k.kpages, types=("entity/person", "entity/company"), order_by="mention_count", limit=40, offset=10).select("slug", "type", "mention_count"),
      "SELECT slug, type, mention_count FROM kpages WHERE type IN ('entity/person', 'entity/company') ORDER BY mention_count DESC, slug LIMIT 40 OFFSET 10")
query("s4_filtered_pages_fallback", lambda k: R.filtered_pages(k.kpages, prefix="entity/", order_by="no such column", descending=False, limit=25).select("slug"),
      "SELECT slug FROM kpages WHERE type LIKE 'entity/%' ORDER BY updated_at, slug LIMIT 25")
query("s5_batch_reads", lambda k: R.keyed_read(k.kpages.filter("type = 'entity/company'").select("slug"), k.kaliases.select(F.col("page_slug").alias("slug"), "alias"), "slug"),
      "SELECT p.slug, a.alias FROM kpages p LEFT JOIN kaliases a ON a.page_slug = p.slug WHERE p.type = 'entity/company'")
query("s6_chunk_scan", lambda k: k.kchunks.filter("page_slug = 'records/doc-10' AND summary_level = 0").orderBy("chunk_index").limit(3).select("page_slug", "chunk_index", F.md5("content").alias("h")),
      "SELECT page_slug, chunk_index, md5(content) AS h FROM kchunks WHERE page_slug = 'records/doc-10' AND summary_level = 0 ORDER BY chunk_index LIMIT 3")
query("s7_vector_pages", lambda k: k.kvectors.filter("chunk_index >= 0").groupBy("page_slug").agg(F.count("*").alias("rows")),
      "SELECT page_slug, count(*) AS rows FROM kvectors WHERE chunk_index >= 0 GROUP BY page_slug")
query("s8_log_tail", lambda k: R.newest(k.kqlog, 20).select("id", "tool", "query"), "SELECT id, tool, query FROM kqlog ORDER BY id DESC LIMIT 20")
query("s12_orphans", lambda k: k.kpages.join(k.kchunks.select(F.col("page_slug").alias("slug")), "slug", "left_anti").filter("type = 'record'").select("slug", F.lit("no_chunks").alias("issue")).unionByName(
          k.kchunks.select(F.col("page_slug").alias("slug")).distinct().join(k.kpages.filter("type <> ''"), "slug", "left_anti").select("slug", F.lit("no_page").alias("issue"))),
      "SELECT slug, 'no_chunks' AS issue FROM kpages WHERE type = 'record' AND slug NOT IN (SELECT page_slug FROM kchunks) UNION ALL SELECT DISTINCT page_slug, 'no_page' FROM kchunks WHERE page_slug NOT IN (SELECT slug FROM kpages WHERE type <> '')")
query("s13_index_report", lambda k: k.kpages.filter("type <> 'record'").groupBy("type").agg(F.count("*").alias("n"), F.min("slug").alias("first"), F.max("slug").alias("last"), F.sum(X.hash32(F.col("slug"))).alias("listing")),
      "SELECT type, count(*) AS n, min(slug) AS first, max(slug) AS last, sum(('0x' || md5(slug)[1:8])::BIGINT)::BIGINT AS listing FROM kpages WHERE type <> 'record' GROUP BY type")

# ---- filters ----
PREFIXES = "SELECT DISTINCT upper(substring(title, 1, n)) AS name FROM kpages, (SELECT 5 AS n UNION ALL SELECT 6 UNION ALL SELECT 7) w WHERE type = 'record' AND length(trim(title)) >= n UNION SELECT '100%' UNION SELECT 'doc_1'"
query("p1_current_links", lambda k: k.klinks.filter(X.current_fact()).groupBy("relation").agg(F.count("*").alias("n")), f"SELECT relation, count(*) AS n FROM klinks WHERE {CURRENT} GROUP BY relation")
query("p1_active_links", lambda k: k.klinks.filter(X.active_link()).groupBy("relation").agg(F.count("*").alias("n")), f"SELECT relation, count(*) AS n FROM klinks WHERE {ACTIVE} GROUP BY relation")
query("p2_type_family", lambda k: k.kpages.filter(F.col("type").startswith("entity/")).select("slug"), "SELECT slug FROM kpages WHERE type LIKE 'entity/%'")
query("p3_recent_pages", lambda k: k.kpages.filter(F.col("updated_at") >= since_orders(90)).select("slug"), f"SELECT slug FROM kpages WHERE updated_at >= {AS_OF} - 90 * {DAY}")
query("p4_stale_pages", lambda k: k.kpages.filter((F.col("tier") <= 2) & (F.col("updated_at") < since_orders(60))).select("slug", "tier"), f"SELECT slug, tier FROM kpages WHERE tier <= 2 AND updated_at < {AS_OF} - 60 * {DAY}")
query("p5_expired_pages", lambda k: k.kpages.filter((F.trim("expires_at") != "") & (F.col("expires_at") < ORDER_AS_OF[:10])).select("slug", "expires_at"), f"SELECT slug, expires_at FROM kpages WHERE trim(expires_at) <> '' AND expires_at < '{ORDER_AS_OF[:10]}'")
query("p6_low_decay", lambda k: k.kpages.filter("confidence_decay < 0.3e0").select("slug", "confidence_decay"), "SELECT slug, confidence_decay FROM kpages WHERE confidence_decay < 0.3e0")
query("p7_missing_titles", lambda k: k.kpages.filter(F.coalesce(F.trim("title"), F.lit("")).isin("") | (F.col("title") == F.col("slug")) | (F.coalesce(F.trim("type"), F.lit("")) == "")).select("slug"),
      "SELECT slug FROM kpages WHERE coalesce(trim(title), '') = '' OR title = slug OR coalesce(trim(type), '') = ''")
query("p8_expiring_in_set", lambda k: k.kpages.join(k.klinks.filter("relation = 'uses'").select(F.col("to_slug").alias("slug")), "slug", "left_semi").filter((F.trim("expires_at") != "") & (F.col("expires_at") <= "2002-03-01")).select("slug", "expires_at"),
      "SELECT slug, expires_at FROM kpages WHERE slug IN (SELECT to_slug FROM klinks WHERE relation = 'uses') AND trim(expires_at) <> '' AND expires_at <= '2002-03-01'")
query("p9_high_mentions", lambda k: k.kpages.filter(F.col("type").startswith("entity/") & (F.col("mention_count") >= 15)).select("slug", "mention_count"), "SELECT slug, mention_count FROM kpages WHERE type LIKE 'entity/%' AND mention_count >= 15")
query("p10_valid_dates", lambda k: k.ktimeline.filter(X.valid_date()).groupBy("event_date").agg(F.count("*").alias("n")),
      """SELECT event_date, count(*) AS n FROM ktimeline WHERE regexp_full_match(trim(event_date), '\\d{4}(-\\d{2}(-\\d{2})?)?') AND trim(event_date)[1:4] <> '0000'
         AND TRY_CAST(CASE length(trim(event_date)) WHEN 4 THEN trim(event_date) || '-01-01' WHEN 7 THEN trim(event_date) || '-01' ELSE trim(event_date) END AS DATE) IS NOT NULL GROUP BY event_date""")
query("p11_stub_flag", lambda k: R.pages_with_link_count(k.kpages, k.klinks).filter((F.col("tier") == 3) & X.entity_or_concept()).select("slug", ((F.col("links") <= 1) & (F.col("mention_count") <= 1)).cast("int").alias("stub")),
      f"SELECT p.slug, CAST(coalesce(n, 0) <= 1 AND mention_count <= 1 AS INT) AS stub FROM kpages p LEFT JOIN (SELECT slug, count(*) AS n FROM {ENDS_ONCE} e GROUP BY slug) d ON d.slug = p.slug WHERE tier = 3 AND {EOC}")
query("p12_tagged_pages", lambda k: k.kpages.join(k.ktags.filter("tag = 'auto-extracted'").select(F.col("page_slug").alias("slug")), "slug", "left_semi").select("slug"), "SELECT slug FROM kpages WHERE slug IN (SELECT page_slug FROM ktags WHERE tag = 'auto-extracted')")
query("p14_unique_prefix", lambda k: R.unique_prefixes(k.sql(PREFIXES), k.kpages.filter("type = 'record'")),
      f"""WITH names AS ({PREFIXES}) SELECT n.name, CASE WHEN count(p.slug) = 1 THEN min(p.slug) END AS slug FROM names n LEFT JOIN kpages p ON starts_with(lower(p.title), lower(n.name)) AND p.type = 'record' GROUP BY n.name""")
query("p16_sufficient_records", lambda k: k.documents.filter(F.length(F.regexp_replace(F.regexp_replace("text", r"https?://\S+", ""), r"[^\p{L}\p{N}]", "")) >= 50).select("doc_id"),
      "SELECT doc_id FROM documents WHERE length(regexp_replace(regexp_replace(text, 'https?://\\S+', '', 'g'), '[^\\p{L}\\p{N}]', '', 'g')) >= 50")
query("p20_junk_slugs", lambda k: k.kpages.filter(~(F.col("slug").startswith("records/") | F.col("slug").startswith("templates/") | F.col("slug").startswith("attachments/"))).groupBy("type").agg(F.count("*").alias("n")),
      "SELECT type, count(*) AS n FROM kpages WHERE slug NOT LIKE 'records/%' AND slug NOT LIKE 'templates/%' AND slug NOT LIKE 'attachments/%' GROUP BY type")

# ---- joins ----
NAMES = [("Customer#000000003",), ("entity/company/s-4",), ("cust 42",), ("ring",), ("nation_1",), ("no such name",), ("RED WIDGET",), ("",)]
query("j1_alias_first_match", lambda k: R.first_by(k.kaliases.join(k.kpages.withColumnRenamed("slug", "page_slug"), "page_slug"), ["alias"], X.type_rank(), "id").select("alias", "page_slug"),
      """SELECT alias, page_slug FROM (SELECT alias, page_slug, row_number() OVER (PARTITION BY alias ORDER BY CASE WHEN type LIKE 'entity/%' THEN 0 WHEN type LIKE 'concept/%' THEN 1 ELSE 2 END, a.id) AS rn
         FROM kaliases a JOIN kpages p ON p.slug = a.page_slug) x WHERE rn = 1""")
query("j2_resolve_names", lambda k: R.resolve_names(k.spark.createDataFrame(NAMES, "name string"), k.kpages, k.kaliases).select("name", "slug", F.col("pass").cast("long").alias("pass")),
      """WITH names(name) AS (VALUES ('Customer#000000003'), ('entity/company/s-4'), ('cust 42'), ('ring'), ('nation_1'), ('no such name'), ('RED WIDGET'), ('')),
         p AS (SELECT slug, title, CASE WHEN type LIKE 'entity/%' THEN 0 WHEN type LIKE 'concept/%' THEN 1 ELSE 2 END AS rank FROM kpages),
         c AS (SELECT name, slug, 1 AS pass, rank, slug AS tie FROM names JOIN p ON slug = name UNION ALL SELECT name, slug, 2, rank, slug FROM names JOIN p ON title = name
           UNION ALL SELECT name, p.slug, 3, rank, lpad(CAST(a.id AS VARCHAR), 20, '0') FROM names JOIN kaliases a ON alias = name JOIN p ON p.slug = a.page_slug
           UNION ALL SELECT name, slug, 4, rank, slug FROM names JOIN p ON contains(lower(title), lower(name)) WHERE trim(name) <> ''),
         r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pass, rank, tie) AS rn FROM c)
         SELECT n.name, r.slug, CAST(r.pass AS BIGINT) AS pass FROM names n LEFT JOIN r ON r.name = n.name AND rn = 1""")
query("j3_unique_titles", lambda k: R.unique_matches(k.spark.createDataFrame([("red widget",), ("Customer#000000001",), ("NATION_3",), ("nobody",)], "name string"), k.kpages),
      "WITH names(name) AS (VALUES ('red widget'), ('Customer#000000001'), ('NATION_3'), ('nobody')) SELECT n.name, CASE WHEN count(p.slug) = 1 THEN min(p.slug) END AS slug FROM names n LEFT JOIN kpages p ON p.title = n.name GROUP BY n.name")
query("j4_records_without_chunks", lambda k: k.kpages.filter("type = 'record'").join(k.kchunks.select(F.col("page_slug").alias("slug")), "slug", "left_anti").select("slug"), "SELECT slug FROM kpages WHERE type = 'record' AND slug NOT IN (SELECT page_slug FROM kchunks)")
query("j5_empty_shells", lambda k: R.empty_shells(k.kpages, k.klinks, k.kaliases, k.ktags).select("slug"),
      f"""SELECT slug FROM kpages WHERE type <> 'record' AND mention_count = 0 AND slug NOT IN (SELECT from_slug FROM klinks WHERE {ACTIVE}) AND slug NOT IN (SELECT to_slug FROM klinks WHERE {ACTIVE})
          AND slug NOT IN (SELECT page_slug FROM kaliases) AND slug NOT IN (SELECT page_slug FROM ktags)""")
query("j6_bare_stubs", lambda k: R.bare_stubs(k.kpages, k.klinks).select("slug", "links"),
      f"SELECT p.slug, coalesce(n, 0) AS links FROM kpages p LEFT JOIN (SELECT slug, count(*) AS n FROM {ENDS_ONCE} e GROUP BY slug) d ON d.slug = p.slug WHERE tier = 3 AND {EOC} AND mention_count <= 1 AND coalesce(n, 0) <= 1")
query("j7_islands", lambda k: R.islands(k.kpages, k.klinks).select("slug"), f"SELECT slug FROM kpages WHERE slug NOT IN (SELECT slug FROM {ENDS_ONCE} e)")
query("j8_link_count_per_page", lambda k: R.pages_with_link_count(k.kpages.filter("type LIKE 'entity/%'"), k.klinks).select("slug", "links"),
      f"SELECT p.slug, coalesce(n, 0) AS links FROM kpages p LEFT JOIN (SELECT slug, count(*) AS n FROM {ENDS_ONCE} e GROUP BY slug) d ON d.slug = p.slug WHERE type LIKE 'entity/%'")
query("j9_entity_quality", lambda k: R.entity_quality(k.kpages, k.kaliases, k.ktags, k.kchunks).select("slug", "alias_count", "tag_count", "chunk_count", "body_chars"),
      f"""SELECT p.slug, coalesce(a.n, 0) AS alias_count, coalesce(t.n, 0) AS tag_count, coalesce(c.n, 0) AS chunk_count, CAST(coalesce(c.s, 0) AS BIGINT) AS body_chars FROM kpages p LEFT JOIN (SELECT page_slug, count(*) AS n FROM kaliases GROUP BY 1) a ON a.page_slug = slug
          LEFT JOIN (SELECT page_slug, count(*) AS n FROM ktags GROUP BY 1) t ON t.page_slug = slug LEFT JOIN (SELECT page_slug, count(*) AS n, sum(length(content)) AS s FROM kchunks GROUP BY 1) c ON c.page_slug = slug WHERE {EOC}""")
DUPES = "(SELECT slug, type, title, mention_count FROM kpages UNION ALL SELECT 'entity/brand/' || slug, 'entity/brand', upper(title), 0 FROM kpages WHERE type = 'entity/location')"
query("j10_cross_type_duplicates", lambda k: R.cross_type_duplicates(k.sql(f"SELECT * FROM {DUPES} d")), f"""WITH d AS (SELECT slug, type, lower(trim(title)) AS t FROM {DUPES} x WHERE trim(title) <> '')
         SELECT a.slug AS slug_a, b.slug AS slug_b, a.t AS title FROM d a JOIN d b ON a.t = b.t AND a.slug < b.slug AND a.type <> b.type""")
query("j11_neighbours", lambda k: R.neighbours(k.klinks.filter("relation IN ('reports_to', 'part_of')")), f"SELECT from_slug AS slug, to_slug AS neighbour FROM klinks WHERE relation IN ('reports_to', 'part_of') AND {CURRENT} UNION SELECT to_slug, from_slug FROM klinks WHERE relation IN ('reports_to', 'part_of') AND {CURRENT}")
query("j12_links_per_slug", lambda k: (lambda keys: keys.join(k.klinks.filter(X.current_fact()).groupBy(F.col("from_slug").alias("slug")).agg(F.count("*").alias("outgoing")), "slug", "left").join(
          k.klinks.filter(X.current_fact()).groupBy(F.col("to_slug").alias("slug")).agg(F.count("*").alias("incoming")), "slug", "left").fillna(0).select("slug", "outgoing", "incoming"))(k.kpages.filter("type = 'entity/company'").select("slug")),
      f"SELECT slug, coalesce(o.n, 0) AS outgoing, coalesce(i.n, 0) AS incoming FROM kpages LEFT JOIN (SELECT from_slug, count(*) AS n FROM klinks WHERE {CURRENT} GROUP BY 1) o ON from_slug = slug LEFT JOIN (SELECT to_slug, count(*) AS n FROM klinks WHERE {CURRENT} GROUP BY 1) i ON to_slug = slug WHERE type = 'entity/company'")
query("j13_timeline_per_slug", lambda k: R.first_by(k.ktimeline.filter(X.active_link()), ["page_slug"], F.col("event_date").desc_nulls_last(), F.desc("id"), n=5).select("page_slug", "id", "event_date"),
      f"SELECT page_slug, id, event_date FROM (SELECT *, row_number() OVER (PARTITION BY page_slug ORDER BY event_date DESC NULLS LAST, id DESC) AS rn FROM ktimeline WHERE {ACTIVE}) t WHERE rn <= 5")
query("j14_network_events", lambda k: (lambda seeds: R.neighbours(k.klinks).join(seeds, "slug").select(F.col("neighbour").alias("page_slug")).distinct().join(seeds.withColumnRenamed("slug", "page_slug"), "page_slug", "left_anti")
          .join(k.ktimeline.filter(X.active_link() & (F.col("event_date") >= "2024-01-20")), "page_slug").join(k.kpages.select(F.col("slug").alias("page_slug"), "title"), "page_slug").orderBy(F.desc("event_date"), F.desc("id")).limit(30).select("page_slug", "title", "event_date", "id"))(
          k.kpages.filter("type = 'entity/location'").select("slug")),
      f"""WITH seeds AS (SELECT slug FROM kpages WHERE type = 'entity/location'), n AS (SELECT DISTINCT neighbour FROM {NEIGHBOURS} x WHERE slug IN (SELECT slug FROM seeds) AND neighbour NOT IN (SELECT slug FROM seeds))
          SELECT page_slug, title, event_date, t.id FROM ktimeline t JOIN n ON neighbour = page_slug JOIN kpages p ON p.slug = page_slug WHERE {ACTIVE} AND event_date >= '2024-01-20' ORDER BY event_date DESC, t.id DESC LIMIT 30""")
query("j15_trusted_timeline", lambda k: k.ktimeline.filter(F.col("trust_state").isin("trusted", "user_thought") & X.valid_date()).orderBy(F.desc("event_date"), F.desc("id")).limit(50).select("id", "page_slug", "event_date"),
      "SELECT id, page_slug, event_date FROM ktimeline WHERE trust_state IN ('trusted', 'user_thought') AND (event_date LIKE '2024%') ORDER BY event_date DESC, id DESC LIMIT 50")
query("j16_detail_hits", lambda k: R.first_by(k.kchunks.filter("summary_level = 0").withColumn("rank", F.when(F.lower("content").contains("password"), 0).when(F.lower("content").contains("license"), 1).when(F.lower("content").contains("the"), 2)).filter("rank is not null"),
                                             ["page_slug"], "rank", "chunk_index", n=2).select("page_slug", "chunk_index", F.col("rank").cast("long").alias("rank")),
      """SELECT page_slug, chunk_index, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page_slug ORDER BY rank, chunk_index) AS rn FROM (SELECT *, CASE WHEN contains(lower(content), 'password') THEN 0 WHEN contains(lower(content), 'license') THEN 1
         WHEN contains(lower(content), 'the') THEN 2 END AS rank FROM kchunks WHERE summary_level = 0) c WHERE rank IS NOT NULL) d WHERE rn <= 2""")
query("j17_slugs_with_patterns", lambda k: k.kchunks.filter(F.lower("content").contains("license") | F.lower("content").contains("password")).select("page_slug").distinct(), "SELECT DISTINCT page_slug FROM kchunks WHERE content ILIKE '%license%' OR content ILIKE '%password%'")
query("j18_dangling_links", lambda k: R.dangling(k.klinks, k.kpages).groupBy("relation", "missing").agg(F.count("*").alias("n")),
      "SELECT relation, 'from' AS missing, count(*) AS n FROM klinks WHERE from_slug NOT IN (SELECT slug FROM kpages) GROUP BY relation UNION ALL SELECT relation, 'to', count(*) FROM klinks WHERE to_slug NOT IN (SELECT slug FROM kpages) GROUP BY relation")
query("j19_session_cooccurrence", lambda k: R.session_pairs(k.khits),
      "SELECT a.slug AS slug_a, b.slug AS slug_b, count(*) AS n FROM khits a JOIN khits b ON a.session_id = b.session_id AND a.slug < b.slug GROUP BY 1, 2")
query("j20_incremental_cooccurrence", lambda k: R.new_session_pairs(k.khits, 5000, "2024-01-10 00:00:00"),
      """WITH h AS (SELECT *, id > 5000 AND created_at >= TIMESTAMP '2024-01-10 00:00:00' AS fresh FROM khits), s AS (SELECT DISTINCT session_id FROM h WHERE fresh)
         SELECT a.slug AS slug_a, b.slug AS slug_b, count(*) AS n FROM h a JOIN h b ON a.session_id = b.session_id AND a.slug < b.slug WHERE a.session_id IN (SELECT session_id FROM s) AND (a.fresh OR b.fresh) GROUP BY 1, 2""")
query("j21_zero_link_records", lambda k: R.zero_link_records(k.kpages, k.kchunks, k.ktags, k.klinks).select("slug", "chunks", F.col("chars").cast("long").alias("chars"), "tags"),
      f"""SELECT slug, coalesce(c.n, 0) AS chunks, CAST(coalesce(c.s, 0) AS BIGINT) AS chars, coalesce(t.n, 0) AS tags FROM kpages LEFT JOIN (SELECT page_slug, count(*) AS n, sum(length(content)) AS s FROM kchunks GROUP BY 1) c ON c.page_slug = slug LEFT JOIN (SELECT page_slug, count(*) AS n FROM ktags GROUP BY 1) t ON t.page_slug = slug
          WHERE type = 'record' AND (coalesce(c.n, 0) >= 2 OR coalesce(c.s, 0) >= 1000 OR coalesce(t.n, 0) >= 3) AND slug NOT IN (SELECT from_slug FROM klinks WHERE {CURRENT} AND from_slug <> to_slug) AND slug NOT IN (SELECT to_slug FROM klinks WHERE {CURRENT} AND from_slug <> to_slug)""")
query("j22_topic_candidates", lambda k: R.topic_candidates(k.ktags.filter(F.col("page_slug").startswith("records/")).select(F.concat(F.lit("tag:"), "tag").alias("seed"), F.col("page_slug").alias("slug")).unionByName(
          k.klinks.filter(F.col("from_slug").startswith("records/")).join(k.klinks.filter("relation = 'located_in'").select(F.col("from_slug").alias("mid"), F.col("to_slug").alias("place")), F.col("to_slug") == F.col("mid")).select(F.concat(F.lit("link:"), "place").alias("seed"), F.col("from_slug").alias("slug")))),
      """WITH s AS (SELECT 'tag:' || tag AS seed, page_slug AS slug FROM ktags WHERE page_slug LIKE 'records/%' UNION SELECT 'link:' || b.to_slug, a.from_slug FROM klinks a JOIN klinks b ON a.to_slug = b.from_slug AND b.relation = 'located_in' WHERE a.from_slug LIKE 'records/%'),
         g AS (SELECT seed, count(*) AS n, string_agg(slug, ',' ORDER BY slug) AS records, sum(('0x' || md5(slug)[1:8])::BIGINT)::BIGINT AS h FROM s GROUP BY seed HAVING count(*) >= 3) SELECT min(seed) AS seed, min(n) AS n, min(h) AS h FROM g GROUP BY records""")
query("j23_edge_exists", lambda k: (lambda probe: probe.join(k.klinks.select(F.explode(F.array(F.struct("from_slug", "to_slug"), F.struct(F.col("to_slug").alias("from_slug"), F.col("from_slug").alias("to_slug")))).alias("e")).select(F.col("e.from_slug").alias("a"), F.col("e.to_slug").alias("b")).distinct().withColumn("hit", F.lit(1)), ["a", "b"], "left").select("a", "b", F.coalesce("hit", F.lit(0)).cast("int").alias("taken")))(
          k.kpages.filter("type = 'entity/location'").select(F.col("slug").alias("a")).join(k.kpages.filter("slug LIKE 'entity/location/r-%'").select(F.col("slug").alias("b")), F.col("a") != F.col("b"))),
      "SELECT p.slug AS a, q.slug AS b, CAST(EXISTS (SELECT 1 FROM klinks l WHERE (l.from_slug = p.slug AND l.to_slug = q.slug) OR (l.from_slug = q.slug AND l.to_slug = p.slug)) AS INT) AS taken FROM kpages p JOIN kpages q ON p.slug <> q.slug AND q.slug LIKE 'entity/location/r-%' WHERE p.type = 'entity/location'")
query("j24_link_titles", lambda k: k.klinks.filter("relation = 'reports_to'").join(k.kpages.select(F.col("slug").alias("to_slug"), "title"), "to_slug", "left").join(k.kaliases.groupBy(F.col("page_slug").alias("to_slug")).agg(F.min("alias").alias("alias")), "to_slug", "left").select("from_slug", "to_slug", F.coalesce("title", "alias").alias("label")),
      "SELECT from_slug, to_slug, coalesce(p.title, a.alias) AS label FROM klinks LEFT JOIN kpages p ON p.slug = to_slug LEFT JOIN (SELECT page_slug, min(alias) AS alias FROM kaliases GROUP BY 1) a ON a.page_slug = to_slug WHERE relation = 'reports_to'")
query("j25_feedback_lifecycle", lambda k: k.kdiscoveries.groupBy("type", "status").agg(F.count("*").alias("n"), F.count_distinct("entity_a").alias("entities")), "SELECT type, status, count(*) AS n, count(DISTINCT entity_a) AS entities FROM kdiscoveries GROUP BY type, status")

# ---- aggregates ----
query("a1_global_counts", lambda k: k.kpages.agg(F.count("*").alias("pages"), F.sum(F.col("type").startswith("entity/").cast("long")).alias("entities")).crossJoin(k.klinks.filter(X.active_link()).agg(F.count("*").alias("links"))).crossJoin(k.kchunks.agg(F.count("*").alias("chunks"))),
      f"SELECT (SELECT count(*) FROM kpages) AS pages, (SELECT count(*) FROM kpages WHERE type LIKE 'entity/%') AS entities, (SELECT count(*) FROM klinks WHERE {ACTIVE}) AS links, (SELECT count(*) FROM kchunks) AS chunks")
query("a2_type_histogram", lambda k: k.kpages.groupBy("type").agg(F.count("*").alias("n")), "SELECT type, count(*) AS n FROM kpages GROUP BY type")
query("a3_relation_histogram", lambda k: k.klinks.groupBy("relation").agg(F.count("*").alias("n")), "SELECT relation, count(*) AS n FROM klinks GROUP BY relation")
query("a4_average_mentions", lambda k: k.kpages.agg(F.round(F.coalesce(F.avg("mention_count"), F.lit(0.0)), 6).alias("avg_mentions")), "SELECT round(coalesce(avg(mention_count), 0), 6) AS avg_mentions FROM kpages")
query("a5_link_degree", lambda k: R.degree(k.klinks), f"SELECT slug, count(*) AS degree FROM (SELECT from_slug AS slug FROM klinks WHERE {ACTIVE} AND from_slug <> to_slug UNION ALL SELECT to_slug FROM klinks WHERE {ACTIVE} AND from_slug <> to_slug) e GROUP BY slug")
query("a6_link_count", lambda k: R.link_count(k.klinks), f"SELECT slug, count(*) AS links FROM {ENDS_ONCE} e GROUP BY slug")
query("a7_connectivity", lambda k: R.connectivity(k.klinks, 8), f"SELECT slug, sum(n)::BIGINT AS connections FROM (SELECT from_slug AS slug, count(DISTINCT to_slug) AS n FROM klinks WHERE {CURRENT} GROUP BY 1 UNION ALL SELECT to_slug, count(DISTINCT from_slug) FROM klinks WHERE {CURRENT} GROUP BY 1) x GROUP BY slug HAVING sum(n) >= 8")
query("a8_query_usage", lambda k: R.usage(k.khits, "2024-01-10 00:00:00").select("slug", "query_count", "avg_position", "tools", F.unix_micros("last_queried_at").alias("last_us")),
      "SELECT slug, count(*) AS query_count, 1e0 AS avg_position, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools, epoch_us(max(created_at)) AS last_us FROM khits WHERE created_at >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY slug")
query("a9_feedback_counts", lambda k: k.kfeedback.groupBy("slug", "signal").agg(F.count("*").alias("n")), "SELECT slug, signal, count(*) AS n FROM kfeedback GROUP BY slug, signal")
query("a10_actionable_counts", lambda k: k.kdiscoveries.filter("seen = 0 AND status = 'pending'").agg(*[F.count(F.when(F.col("actionable") == x, 1)).alias(x) for x in ("high", "medium", "low")]),
      "SELECT count(*) FILTER (actionable = 'high') AS high, count(*) FILTER (actionable = 'medium') AS medium, count(*) FILTER (actionable = 'low') AS low FROM kdiscoveries WHERE seen = 0 AND status = 'pending'")
SEARCH_SQL = """SELECT count(*) AS total, round(avg(CASE WHEN reason = 'parser_fallback' THEN CAST(hit_count = 0 AS INT) WHEN reason IN ('rerank_skipped', 'hierarchy_mismatch') THEN 1 WHEN degraded = 1 AND reason IS NULL THEN 1 ELSE 0 END), 6) AS degraded_rate,
  round(avg(CASE WHEN reason = 'latency_warning' THEN 1 ELSE 0 END), 6) AS latency_warning_rate, CAST(floor(avg(latency_ms) + 0.5) AS BIGINT) AS avg_latency_ms, count(*) FILTER (hit_count = 0) AS empty, count(*) FILTER (reason = 'hierarchy_mismatch') AS hierarchy_mismatches
  FROM ksearch WHERE created_at >= TIMESTAMP '2024-01-24 00:00:00'"""
query("a11_search_quality", lambda k: R.search_quality(k.ksearch, "2024-01-24 00:00:00").select("total", F.round("degraded_rate", 6).alias("degraded_rate"), F.round("latency_warning_rate", 6).alias("latency_warning_rate"), F.col("avg_latency_ms").cast("long").alias("avg_latency_ms"), "empty", "hierarchy_mismatches"), SEARCH_SQL)
query("a11_top_reasons", lambda k: R.top_reasons(k.ksearch, 3), "SELECT reason, count(*) AS n FROM ksearch WHERE reason IS NOT NULL GROUP BY reason ORDER BY n DESC, reason LIMIT 3")
query("a12_extraction_quality", lambda k: k.kqlog.filter(F.col("created_at") >= X.ts("2024-01-20 00:00:00")).agg(F.sum("k").alias("raw"), F.sum(F.when(F.col("tool") == "other", F.col("k")).otherwise(0)).alias("filtered")).select("raw", "filtered", F.round(F.when(F.col("raw") > 0, F.col("filtered") / F.col("raw")).otherwise(0.0), 6).alias("filter_ratio")),
      "SELECT sum(k)::BIGINT AS raw, sum(CASE WHEN tool = 'other' THEN k ELSE 0 END)::BIGINT AS filtered, round(CASE WHEN sum(k) > 0 THEN sum(CASE WHEN tool = 'other' THEN k ELSE 0 END) / sum(k) ELSE 0 END, 6) AS filter_ratio FROM kqlog WHERE created_at >= TIMESTAMP '2024-01-20 00:00:00'")
query("a13_outcome_counts", lambda k: k.ksearch.filter(F.col("created_at") >= X.ts(EVENT_AS_OF) - F.expr("INTERVAL 48 HOURS")).groupBy("strategy", F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n")),
      f"SELECT strategy, coalesce(reason, 'none') AS reason, count(*) AS n FROM ksearch WHERE created_at >= {E_AS_OF} - INTERVAL 48 HOUR GROUP BY 1, 2")
query("a14_error_count", lambda k: k.events.filter((F.col("event_type") == "error") & (F.col("ts") >= X.ts(EVENT_AS_OF) - F.expr("INTERVAL 24 HOURS"))).agg(F.count("*").alias("errors")), f"SELECT count(*) AS errors FROM events WHERE event_type = 'error' AND ts >= {E_AS_OF} - INTERVAL 24 HOUR")
query("a15_p95_by_offset", lambda k: R.p95_by_offset(k.kpages, "mention_count"), """WITH v AS (SELECT CAST(mention_count AS DOUBLE) AS v, row_number() OVER (ORDER BY mention_count DESC, slug) AS rn, count(*) OVER () AS n FROM kpages WHERE mention_count > 0) SELECT coalesce(max(v), 1e0) AS p95 FROM v WHERE rn = CAST(floor(n * 0.05) AS BIGINT) + 1""")
query("a15_p95_activity", lambda k: R.p95_by_offset(k.kpages, "activity_weight"), """WITH v AS (SELECT activity_weight AS v, row_number() OVER (ORDER BY activity_weight DESC, slug) AS rn, count(*) OVER () AS n FROM kpages WHERE activity_weight > 0) SELECT coalesce(max(v), 1e0) AS p95 FROM v WHERE rn = CAST(floor(n * 0.05) AS BIGINT) + 1""")
query("a16_latency_percentiles", lambda k: R.percentiles(k.ksearch, "strategy", degraded="degraded").withColumn("degraded_rate", F.round("degraded_rate", 6)),
      """WITH r AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY latency_ms) AS rn, count(*) OVER (PARTITION BY strategy) AS n FROM ksearch)
         SELECT strategy, max(n) AS n, max(CASE WHEN rn = greatest(1, CAST(ceil(0.5 * n) AS BIGINT)) THEN latency_ms END) AS p50, max(CASE WHEN rn = greatest(1, CAST(ceil(0.95 * n) AS BIGINT)) THEN latency_ms END) AS p95, max(latency_ms) AS max, round(avg(degraded), 6) AS degraded_rate FROM r GROUP BY strategy""")
query("a17_slowest_step", lambda k: R.slowest_step(k.ksearch.select("session_id", F.col("strategy").alias("kind"), "latency_ms", F.col("id").alias("step_index"))),
      "SELECT session_id, kind, latency_ms FROM (SELECT session_id, strategy AS kind, latency_ms, row_number() OVER (PARTITION BY session_id ORDER BY latency_ms DESC, id) AS rn FROM ksearch) s WHERE rn = 1")
query("a18_budget_report", lambda k: k.ksearch.groupBy("strategy").agg(F.max("latency_ms").alias("slowest"), F.max_by("id", F.struct("latency_ms", -F.col("id"))).alias("hottest"), F.every(F.col("latency_ms") <= 5000).cast("int").alias("go"), F.count(F.when(F.col("latency_ms") >= 4000, 1)).alias("warnings")),
      "SELECT strategy, max(latency_ms) AS slowest, (array_agg(id ORDER BY latency_ms DESC, id))[1] AS hottest, CAST(bool_and(latency_ms <= 5000) AS INT) AS go, count(*) FILTER (latency_ms >= 4000) AS warnings FROM ksearch GROUP BY strategy")
query("a19_shared_titles", lambda k: R.shared_titles(k.kpages), "SELECT title, n, slug FROM (SELECT title, slug, count(*) OVER (PARTITION BY title) AS n FROM kpages WHERE trim(title) <> '') x WHERE n > 1")
query("a20_duplicate_timeline", lambda k: k.ktimeline.withColumn("rn", F.row_number().over(R.Window.partitionBy("page_slug", F.coalesce("event_date", F.lit("")), "summary").orderBy("id"))).filter("rn > 1").select("id"),
      "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY page_slug, coalesce(event_date, ''), summary ORDER BY id) AS rn FROM ktimeline) t WHERE rn > 1")
query("a21_metrics_snapshot", lambda k: k.kpages.agg(F.count(F.when(F.col("type") == "record", 1)).alias("records"), F.count(F.when(F.col("type").startswith("concept/"), 1)).alias("concepts"), F.count(F.when(F.col("tier") == 1, 1)).alias("tier1")).select("*", F.round(F.when(F.col("records") > 0, F.col("concepts") / F.col("records")).otherwise(0.0), 6).alias("ratio")),
      "SELECT count(*) FILTER (type = 'record') AS records, count(*) FILTER (type LIKE 'concept/%') AS concepts, count(*) FILTER (tier = 1) AS tier1, round(count(*) FILTER (type LIKE 'concept/%') / count(*) FILTER (type = 'record'), 6) AS ratio FROM kpages")
query("a22_new_pages", lambda k: k.kpages.filter(F.col("created_at") >= X.ts("1996-01-01 00:00:00")).agg(F.sum(F.col("type").startswith("entity/").cast("long")).alias("entities"), F.sum(F.col("type").startswith("concept/").cast("long")).alias("concepts")),
      "SELECT count(*) FILTER (type LIKE 'entity/%') AS entities, count(*) FILTER (type LIKE 'concept/%') AS concepts FROM kpages WHERE created_at >= TIMESTAMP '1996-01-01 00:00:00'")
query("a23_top_mentions", lambda k: k.kpages.orderBy(F.desc("mention_count"), "slug").limit(15).select("slug", "mention_count"), "SELECT slug, mention_count FROM kpages ORDER BY mention_count DESC, slug LIMIT 15")
query("a24_snapshot_retention", lambda k: R.first_by(k.ksnapshots, ["slug"], F.desc("snapshot_date"), n=7).groupBy("slug").agg(F.count("*").alias("kept"), F.min("snapshot_date").cast("string").alias("oldest")),
      "SELECT slug, count(*) AS kept, CAST(min(snapshot_date) AS VARCHAR) AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY snapshot_date DESC) AS rn FROM ksnapshots) s WHERE rn <= 7 GROUP BY slug")
query("a25_debt_delta", lambda k: R.debt_delta(k.kqlog.filter("created_at >= TIMESTAMP '2024-01-16 00:00:00'").groupBy(F.col("tool").alias("layer"), F.col("query").alias("check")).agg(F.count("*").alias("count")), k.kqlog.filter("created_at < TIMESTAMP '2024-01-16 00:00:00'").groupBy(F.col("tool").alias("layer"), F.col("query").alias("check")).agg(F.count("*").alias("count"))),
      """SELECT tool AS layer, query AS "check", count(*) FILTER (created_at >= TIMESTAMP '2024-01-16 00:00:00') AS now, count(*) FILTER (created_at < TIMESTAMP '2024-01-16 00:00:00') AS before, count(*) FILTER (created_at >= TIMESTAMP '2024-01-16 00:00:00') - count(*) FILTER (created_at < TIMESTAMP '2024-01-16 00:00:00') AS delta FROM kqlog GROUP BY 1, 2 HAVING delta > 0""")
query("a26_consistency_gate", lambda k: k.ksearch.groupBy("strategy").agg(F.count(F.when(F.col("reason") == "hierarchy_mismatch", 1)).alias("hard"), F.count(F.when(F.col("reason") == "latency_warning", 1)).alias("warnings")).withColumn("ok", (F.col("hard") == 0).cast("int")),
      "SELECT strategy, count(*) FILTER (reason = 'hierarchy_mismatch') AS hard, count(*) FILTER (reason = 'latency_warning') AS warnings, CAST(count(*) FILTER (reason = 'hierarchy_mismatch') = 0 AS INT) AS ok FROM ksearch GROUP BY strategy")
query("a27_attention_queue", lambda k: R.attention_queue(k.kdiscoveries.select("type", "entity_a", "occurrence_count", "detected_at", F.col("entity_b").alias("ref")), ["type", "entity_a"]).select("type", "entity_a", "evidence", "refs", "refs_hash", "most", F.col("newest").cast("date").cast("string").alias("newest")),
      "WITH r AS (SELECT type, entity_a, count(*) AS refs, sum(('0x' || md5(entity_b)[1:8])::BIGINT)::BIGINT AS refs_hash FROM (SELECT DISTINCT type, entity_a, entity_b FROM kdiscoveries) d GROUP BY 1, 2) SELECT k.type, k.entity_a, sum(occurrence_count)::BIGINT AS evidence, any_value(refs) AS refs, any_value(refs_hash) AS refs_hash, max(occurrence_count) AS most, CAST(CAST(max(detected_at) AS DATE) AS VARCHAR) AS newest FROM kdiscoveries k JOIN r ON r.type = k.type AND r.entity_a = k.entity_a GROUP BY 1, 2")
RANK = "CASE status WHEN 'resolved' THEN 3 WHEN 'dismissed' THEN 2 WHEN 'seen' THEN 1 ELSE 0 END"
query("a28_consolidation", lambda k: k.kdiscoveries.groupBy("type", F.least("entity_a", "entity_b").alias("a"), F.greatest("entity_a", "entity_b").alias("b")).agg(F.max(F.expr(RANK)).alias("r"), F.max_by("score", F.struct("detected_at", "id")).alias("score"), F.sum("occurrence_count").alias("n"), F.max("seen").alias("seen"))
      .select("type", "a", "b", F.element_at(F.array(*[F.lit(x) for x in ("pending", "seen", "dismissed", "resolved")]), F.col("r") + 1).alias("status"), F.round("score", 8).alias("score"), "n", "seen"),
      f"SELECT type, least(entity_a, entity_b) AS a, greatest(entity_a, entity_b) AS b, ['pending', 'seen', 'dismissed', 'resolved'][max({RANK}) + 1] AS status, round((array_agg(score ORDER BY detected_at DESC, id DESC))[1], 8) AS score, sum(occurrence_count)::BIGINT AS n, max(seen) AS seen FROM kdiscoveries GROUP BY 1, 2, 3")

# ---- windows ----
query("w1_first_match", lambda k: R.first_by(k.kaliases, ["alias"], "id").select("alias", "page_slug"), "SELECT alias, (array_agg(page_slug ORDER BY id))[1] AS page_slug FROM kaliases GROUP BY alias")
query("w3_trend_streaks", lambda k: R.trend_streaks(k.ksnapshots, "2024-01-20").select("slug", "delta", "rises", "falls", "trend"),
      """WITH s AS (SELECT slug, snapshot_date, mention_count, sign(mention_count - lag(mention_count) OVER w) AS sg FROM ksnapshots WHERE snapshot_date >= DATE '2024-01-20' WINDOW w AS (PARTITION BY slug ORDER BY snapshot_date)),
         r AS (SELECT *, sum(CASE WHEN sg IS NOT DISTINCT FROM prev THEN 0 ELSE 1 END) OVER (PARTITION BY slug ORDER BY snapshot_date) AS run FROM (SELECT *, lag(sg) OVER (PARTITION BY slug ORDER BY snapshot_date) AS prev FROM s) x),
         t AS (SELECT slug, max_by(mention_count, snapshot_date) - min_by(mention_count, snapshot_date) AS delta, count(*) AS days FROM s GROUP BY slug), l AS (SELECT slug, run, sg, count(*) AS len FROM r GROUP BY slug, run, sg),
         b AS (SELECT l.slug, delta, days, coalesce(max(CASE WHEN sg > 0 THEN len END), 0) AS rises, coalesce(max(CASE WHEN sg < 0 THEN len END), 0) AS falls FROM l JOIN t ON t.slug = l.slug GROUP BY l.slug, delta, days)
         SELECT slug, delta, rises, falls, CASE WHEN rises >= 3 THEN 'rising' WHEN falls >= 3 THEN 'declining' ELSE 'spike' END AS trend FROM b WHERE days >= 2 AND (rises >= 3 OR falls >= 3 OR abs(delta) >= 5)""")
query("w4_version_numbers", lambda k: k.ktimeline.select("page_slug", "id", F.row_number().over(R.Window.partitionBy("page_slug").orderBy("id")).cast("long").alias("version")), "SELECT page_slug, id, row_number() OVER (PARTITION BY page_slug ORDER BY id) AS version FROM ktimeline")
query("w5_latest_event", lambda k: k.ktimeline.filter(X.valid_date() & (F.length("event_date") == 10)).groupBy("page_slug").agg(F.max("event_date").alias("latest"), F.max_by("id", F.struct("event_date", -F.col("id"))).alias("id")),
      "SELECT page_slug, max(event_date) AS latest, (array_agg(id ORDER BY event_date DESC, id))[1] AS id FROM ktimeline WHERE TRY_CAST(event_date AS DATE) IS NOT NULL AND length(event_date) = 10 GROUP BY page_slug")
query("w6_top_per_type", lambda k: R.first_by(k.kdiscoveries, ["type"], F.desc("score"), "id", n=25).select("type", "id"), "SELECT type, id FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY score DESC, id) AS rn FROM kdiscoveries) d WHERE rn <= 25")
query("w7_greedy_cap", lambda k: R.greedy_pairs(k.kdiscoveries.filter("actionable = 'high'").select(F.col("entity_a").alias("a"), F.col("entity_b").alias("b"), "score"), 3, 50).withColumn("score", F.round("score", 6)),
      """WITH p AS (SELECT least(entity_a, entity_b) AS a, greatest(entity_a, entity_b) AS b, max(score) AS score FROM kdiscoveries WHERE actionable = 'high' GROUP BY 1, 2),
         r AS (SELECT a, b, score, row_number() OVER (ORDER BY score DESC, a, b) AS rn FROM p),
         g(rn, used, n, ok) AS (SELECT CAST(0 AS BIGINT), []::VARCHAR[], 0, FALSE UNION ALL
           SELECT rn, CASE WHEN fits THEN list_concat(used, [a, b]) ELSE used END, n + CAST(fits AS INT), fits
           FROM (SELECT r.rn, used, n, a, b, len(list_filter(used, lambda x: x = r.a)) < 3 AND len(list_filter(used, lambda x: x = r.b)) < 3 AS fits FROM g JOIN r ON r.rn = g.rn + 1 WHERE n < 50) s)
         SELECT a, b, round(score, 6) AS score FROM g JOIN r ON r.rn = g.rn WHERE ok""")
query("w8_channel_ranks", lambda k: k.khits.groupBy("tool", "slug").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(R.Window.partitionBy("tool").orderBy(F.desc("n"), "slug")).cast("long")).filter("rank <= 10"),
      "SELECT * FROM (SELECT tool, slug, count(*) AS n, row_number() OVER (PARTITION BY tool ORDER BY count(*) DESC, slug) AS rank FROM khits GROUP BY tool, slug) r WHERE rank <= 10")
query("w9_dense_ids", lambda k: R.numbered(k.ktags.select("tag").distinct(), "tag", name="community").select("tag", F.col("community").cast("long").alias("community")), "SELECT tag, dense_rank() OVER (ORDER BY tag) AS community FROM (SELECT DISTINCT tag FROM ktags) t")
query("w10_previous_snapshot", lambda k: k.ksnapshots.groupBy("slug").agg(F.max_by("mention_count", "snapshot_date").alias("last_count")), "SELECT slug, max_by(mention_count, snapshot_date) AS last_count FROM ksnapshots GROUP BY slug")

# ---- order and limits ----
SEVERITY = "CASE actionable WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"
query("o1_composite_order", lambda k: k.kdiscoveries.orderBy(F.expr(SEVERITY), F.desc("occurrence_count"), "id").limit(40).select("id", "actionable", "occurrence_count"), f"SELECT id, actionable, occurrence_count FROM kdiscoveries ORDER BY {SEVERITY}, occurrence_count DESC, id LIMIT 40")
query("o2_discovery_feed", lambda k: k.kdiscoveries.filter("seen = 0").orderBy(F.expr(SEVERITY), F.desc("score"), F.desc("id")).limit(30).select("id"), f"SELECT id FROM kdiscoveries WHERE seen = 0 ORDER BY {SEVERITY}, score DESC, id DESC LIMIT 30")
query("o3_blended_neighbours", lambda k: R.neighbours(k.klinks).filter("slug = 'entity/location/n-3'").join(k.kpages.withColumnRenamed("slug", "neighbour"), "neighbour").withColumn("s", F.round(F.col("activity_weight") + F.log10(F.col("mention_count") + 1), 6)).orderBy(F.desc("s"), "neighbour").limit(10).select("neighbour", "s"),
      f"SELECT neighbour, round(activity_weight + log10(mention_count + 1), 6) AS s FROM {NEIGHBOURS} n JOIN kpages p ON p.slug = neighbour WHERE n.slug = 'entity/location/n-3' ORDER BY s DESC, neighbour LIMIT 10")
query("o4_capped_queue", lambda k: k.kdiscoveries.filter("status = 'pending' AND occurrence_count > 0").orderBy(F.expr(SEVERITY), F.desc("occurrence_count"), "id").limit(max(0, min(3, 7))).select("id"), f"SELECT id FROM kdiscoveries WHERE status = 'pending' AND occurrence_count > 0 ORDER BY {SEVERITY}, occurrence_count DESC, id LIMIT 3")
query("o5_job_order", lambda k: k.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), "o_orderstatus").filter("o_orderstatus = 'P'").orderBy("priority", "id").limit(5).select("id", "priority"), "SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'P' ORDER BY priority, id LIMIT 5")
query("o6_budget_truncation", lambda k: k.kchunks.withColumn("used", F.sum(F.length("content")).over(R.Window.partitionBy("page_slug").orderBy("chunk_index"))).filter("used <= 2000").groupBy("page_slug").agg(F.count("*").alias("n"), F.max("used").alias("used")),
      "SELECT page_slug, count(*) AS n, max(used)::BIGINT AS used FROM (SELECT *, sum(length(content)) OVER (PARTITION BY page_slug ORDER BY chunk_index) AS used FROM kchunks) c WHERE used <= 2000 GROUP BY page_slug")
query("o8_digest_lanes", lambda k: R.first_by(k.kdiscoveries.filter("status <> 'dismissed'"), ["type"], F.expr(SEVERITY), F.desc("score"), "id", n=3).select("type", "id"), f"SELECT type, id FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY {SEVERITY}, score DESC, id) AS rn FROM kdiscoveries WHERE status <> 'dismissed') d WHERE rn <= 3")

# ---- sets ----
query("u1_union_directions", lambda k: R.neighbours(k.klinks, X.active_link()).groupBy("slug").agg(F.count("*").alias("n")), f"SELECT slug, count(*) AS n FROM (SELECT from_slug AS slug, to_slug AS o FROM klinks WHERE {ACTIVE} UNION SELECT to_slug, from_slug FROM klinks WHERE {ACTIVE}) x GROUP BY slug")
query("u2_union_endpoints", lambda k: R.endpoints(k.klinks).groupBy("slug").agg(F.count("*").alias("n")), "SELECT slug, count(*) AS n FROM (SELECT from_slug AS slug FROM klinks UNION ALL SELECT to_slug FROM klinks) x GROUP BY slug")
query("u3_ordered_union", lambda k: R.union_distinct_ordered(
          k.kpages.orderBy(F.desc("mention_count"), "slug").limit(10).select("slug", F.row_number().over(R.Window.orderBy(F.desc("mention_count"), "slug")).alias("pos")), k.kpages.orderBy(F.desc("updated_at"), "slug").limit(10).select("slug", F.row_number().over(R.Window.orderBy(F.desc("updated_at"), "slug")).alias("pos"))),
      """WITH l AS (SELECT slug, 0 AS list, row_number() OVER (ORDER BY mention_count DESC, slug) AS pos FROM kpages UNION ALL SELECT slug, 1, row_number() OVER (ORDER BY updated_at DESC, slug) FROM kpages), m AS (SELECT slug, min(list * 1000 + pos) AS place FROM l WHERE pos <= 10 GROUP BY slug) SELECT slug, row_number() OVER (ORDER BY place, slug) AS pos FROM m""")
query("u4_shared_neighbours", lambda k: (lambda n: n.alias("a").join(n.alias("b"), (F.col("a.neighbour") == F.col("b.neighbour")) & (F.col("a.slug") < F.col("b.slug"))).groupBy(F.col("a.slug").alias("slug_a"), F.col("b.slug").alias("slug_b")).agg(F.count("*").alias("shared")).filter("shared >= 2"))(R.neighbours(k.klinks.filter("relation = 'produces'")).filter("slug LIKE 'entity/company/%'")),
      f"WITH n AS (SELECT DISTINCT from_slug AS slug, to_slug AS o FROM klinks WHERE relation = 'produces' AND {CURRENT}) SELECT a.slug AS slug_a, b.slug AS slug_b, count(*) AS shared FROM n a JOIN n b ON a.o = b.o AND a.slug < b.slug GROUP BY 1, 2 HAVING count(*) >= 2")
query("u5_snapshot_changes", lambda k: R.snapshot_diff(k.ksnap_old, k.ksnap_new),
      """WITH b AS (SELECT coalesce(n.slug, o.slug) AS slug, o.slug IS NULL AS a, n.slug IS NULL AS r, o.content_hash AS oh, n.content_hash AS nh, o.tier AS ot, n.tier AS nt, o.link_count AS ol, n.link_count AS nl, o.confidence_decay AS oc, n.confidence_decay AS nc FROM ksnap_old o FULL JOIN ksnap_new n ON o.slug = n.slug)
         SELECT slug, 'added' AS change FROM b WHERE a UNION ALL SELECT slug, 'removed' FROM b WHERE r UNION ALL SELECT slug, 'content' FROM b WHERE NOT a AND NOT r AND oh IS DISTINCT FROM nh UNION ALL SELECT slug, 'tier' FROM b WHERE NOT a AND NOT r AND ot <> nt
         UNION ALL SELECT slug, 'links' FROM b WHERE NOT a AND NOT r AND ol <> nl UNION ALL SELECT slug, 'confidence' FROM b WHERE NOT a AND NOT r AND oc - nc > 0.1e0""")
query("u6_minus_seeds", lambda k: R.neighbours(k.klinks).filter("slug = 'entity/location/n-1'").select(F.col("neighbour").alias("slug")).join(k.kpages.filter("type = 'entity/company'").select("slug"), "slug", "left_anti"),
      f"SELECT neighbour AS slug FROM {NEIGHBOURS} n WHERE slug = 'entity/location/n-1' AND neighbour NOT IN (SELECT slug FROM kpages WHERE type = 'entity/company')")
