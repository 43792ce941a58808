"""Queries of evidence, facts, ingestion and maintenance, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwell.functions import exprs as X
from loomwell.operators import evidence as E
from loomwell.operators import graph as G
from loomwell.operators import knowledge as N
from loomwell.operators import relational as R
from loomwell.operators import retrieval as V
from loomwell.plans import models
from loomwell.plans.catalog_knowledge import ISSUES, issues
from loomwell.plans.catalog_relational import ACTIVE, CURRENT, NEIGHBOURS
from loomwell.plans.catalog_retrieval import COS, LABELS, Q, bm25, pairs_of, query_vector
from loomwell.plans.registry import query

query("f6_sealed_hits", lambda k: E.sealed_hits(k.kchunks, ["的", "the", "password"]).select("page_slug", "chunk_index", F.md5("snippet").alias("h")),
      """WITH s AS (SELECT DISTINCT page_slug FROM kchunks WHERE summary_level = 1), f AS (SELECT *, CASE WHEN contains(lower(content), 'the') THEN 0 WHEN contains(lower(content), 'password') THEN 1 WHEN contains(content, '的') THEN 2 END AS r FROM kchunks WHERE summary_level = 0 AND page_slug IN (SELECT page_slug FROM s)),
         t AS (SELECT page_slug, min(r) AS b FROM f WHERE r IS NOT NULL GROUP BY 1 ORDER BY b, page_slug LIMIT 5), g AS (SELECT *, row_number() OVER (PARTITION BY page_slug ORDER BY r, chunk_index) AS rn FROM f WHERE r IS NOT NULL AND page_slug IN (SELECT page_slug FROM t)) SELECT page_slug, chunk_index, md5(content[1:200]) AS h FROM g WHERE rn <= 3""")
POINTS = "SELECT doc_id, '## One' || chr(10) || 'text' || chr(10) || '### ' || source || chr(10) || '- item' AS t FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'a **bold** and **' || lang || '** b' FROM documents WHERE doc_id % 3 = 1 UNION ALL SELECT doc_id, '- x' || chr(10) || '- ' || source FROM documents WHERE doc_id % 3 = 2"
query("f14_key_points", lambda k: k.sql(POINTS).select("doc_id", F.array_join(E.key_points(F.col("t")), "|").alias("points")), "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'One|' || source WHEN 1 THEN 'bold|' || lang ELSE 'x|' || source END AS points FROM documents")
query("f16_leading_anchor", lambda k: E.leading_anchor(k.sql("SELECT slug, CAST(mention_count AS DOUBLE) AS score, 2 AS hits, CASE WHEN slug = 'entity/location/n-24' THEN '项目 进展说明' ELSE title END AS text FROM kpages WHERE type = 'entity/location'"), "项目进展如何"), "SELECT 'entity/location/n-24' AS slug, 24e0 AS score")
query("f17_cosine_margin", lambda k: E.cosine_margin(k.sql("SELECT slug, 1e0 / (1 + mention_count) AS cosine FROM kpages WHERE type = 'entity/location' AND mention_count > 0").unionByName(k.sql("SELECT 'top' AS slug, 0.9e0 AS cosine"))), "SELECT 'top' AS slug, 0.9e0 AS cosine")
query("h3_channels", lambda k: V.channel("vector", V.vector_pages(k.kvectors, query_vector(k), 10)).unionByName(V.channel("text", V.trigram_search(k.text_index, "licens", 10))).unionByName(V.channel("temporal", V.temporal_hits(k.ktimeline, "purchase", limit=10).select("slug", "score"))).unionByName(V.channel("graph", G.related(k.klinks, k.kpages, "nowhere", 10).select("slug", F.col("blend").alias("score")))).select("channel", "slug", F.round("score", 5).alias("score")),
      f"""WITH vh AS (SELECT page_slug AS slug, chunk_index, vec_id, 1 - {COS} AS d FROM kvectors, {Q} ORDER BY d, vec_id LIMIT 30), vr AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY chunk_index <> -1, d, chunk_index) AS rn, min(d) OVER (PARTITION BY slug) AS first FROM vh)
          SELECT * FROM (SELECT 'vector' AS channel, slug, round(1 - d, 5) AS score FROM vr WHERE rn = 1 ORDER BY first, slug LIMIT 10) v UNION ALL SELECT 'text', slug, score FROM ({bm25(["licens"], 10)}) w UNION ALL SELECT 'temporal', page_slug, 0.5e0 FROM (SELECT * FROM ktimeline WHERE {ACTIVE} AND contains(lower(summary), 'purchase') ORDER BY event_date DESC NULLS LAST, id DESC LIMIT 10) t""")

query("h9_graph_context", lambda k: R.first_by(R.neighbours(k.klinks).join(k.kpages.filter("slug IN ('entity/company/s-1', 'entity/location/n-2')").select("slug"), "slug").join(k.kpages.select(F.col("slug").alias("neighbour"), "mention_count"), "neighbour"), ["slug"], F.desc("mention_count"), "neighbour", n=5).select("slug", "neighbour"),
      f"SELECT slug, neighbour FROM (SELECT n.slug, neighbour, row_number() OVER (PARTITION BY n.slug ORDER BY mention_count DESC, neighbour) AS rn FROM {NEIGHBOURS} n JOIN kpages p ON p.slug = neighbour WHERE n.slug IN ('entity/company/s-1', 'entity/location/n-2')) x WHERE rn <= 5")
CLAIMS = "SELECT page_slug AS slug, summary AS claim, trust_state AS trust FROM ktimeline"
query("h17_grounded_answer", lambda k: E.grounded_answer(V.evidence_board(k.sql(CLAIMS))).select("slug", "facts", "thoughts", "unresolved", "must_not_claim", "first_fact"),
      """WITH b AS (SELECT DISTINCT page_slug AS slug, summary AS claim, CASE WHEN trust_state IS NULL OR trust_state = 'trusted' THEN 'fact' WHEN trust_state = 'user_thought' THEN 'thought' ELSE 'candidate' END AS kind FROM ktimeline WHERE trust_state IS NULL OR trust_state IN ('trusted', 'user_thought', 'candidate')), f AS (SELECT slug, claim FROM b WHERE kind = 'fact')
         SELECT b.slug, count(*) FILTER (kind = 'fact') AS facts, count(*) FILTER (kind = 'thought') AS thoughts, count(*) FILTER (kind = 'candidate' AND f.slug IS NULL) AS unresolved, count(*) FILTER (kind = 'candidate') AS must_not_claim, min(CASE WHEN kind = 'fact' THEN b.claim END) AS first_fact FROM b LEFT JOIN f ON f.slug = b.slug AND f.claim = b.claim GROUP BY b.slug""")
query("h19_state_guard", lambda k: E.current_state_gap(k.sql("SELECT slug, 1 AS known FROM kpages WHERE type = 'entity/person' UNION ALL SELECT 'nobody' AS slug, 0 AS known"), k.klinks, k.ktimeline),
      f"""WITH s AS (SELECT slug FROM kpages WHERE type = 'entity/person'), u AS (SELECT * FROM klinks WHERE {CURRENT} AND trust_state = 'trusted' AND from_slug <> to_slug), n AS (SELECT * FROM (SELECT slug, page_slug, row_number() OVER (PARTITION BY slug ORDER BY link_key) AS rn FROM (SELECT from_slug AS slug, to_slug AS page_slug, link_key FROM u UNION ALL SELECT to_slug, from_slug, link_key FROM u) b WHERE slug IN (SELECT slug FROM s)) x WHERE rn <= 10),
          d AS (SELECT page_slug, id, trim(event_date) AS day FROM ktimeline WHERE trust_state IN ('trusted', 'user_thought') AND event_date LIKE '2024%'), a AS (SELECT slug, page_slug FROM n UNION SELECT slug, slug FROM s), e AS (SELECT * FROM (SELECT a.slug, id, day, row_number() OVER (PARTITION BY a.slug ORDER BY day DESC, id DESC) AS rn FROM a JOIN d ON d.page_slug = a.page_slug) x WHERE rn <= 5)
          SELECT s.slug, CASE WHEN s.slug IN (SELECT slug FROM n) THEN 'structured_state' ELSE 'subject_relation' END AS gap, coalesce(c.n, 0) AS events, last_event FROM s LEFT JOIN (SELECT slug, count(*) AS n, max(CASE WHEN rn = 1 THEN id END) AS last_event FROM e GROUP BY slug) c ON c.slug = s.slug UNION ALL SELECT 'nobody', 'identity_mapping', 0, NULL""")
query("h20_recent_records", lambda k: R.union_distinct_ordered(
          k.kchunks.filter(F.instr("content", "License") > 0).select(F.col("page_slug").alias("slug")).distinct().orderBy("slug").limit(10).select("slug", F.row_number().over(R.Window.orderBy("slug")).alias("pos")), k.kpages.filter("type = 'record'").orderBy(F.desc("updated_at"), "slug").limit(10).select("slug", F.row_number().over(R.Window.orderBy("slug")).alias("pos"))),
      "WITH a AS (SELECT slug, 0 AS l, row_number() OVER (ORDER BY slug) AS pos FROM (SELECT DISTINCT page_slug AS slug FROM kchunks WHERE contains(content, 'License')) x ORDER BY slug LIMIT 10), b AS (SELECT slug, 1 AS l, row_number() OVER (ORDER BY slug) AS pos FROM kpages WHERE type = 'record' ORDER BY slug LIMIT 10), m AS (SELECT slug, min(l * 100 + pos) AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM b) z GROUP BY slug) SELECT slug, row_number() OVER (ORDER BY place, slug) AS pos FROM m")

query("e7_actionability", lambda k: k.kdiscoveries.withColumn("reason", F.when(F.col("type") == "bridge", "type_mismatch").when(F.col("score") >= 0.6, "high_score").otherwise("low_score")).groupBy("reason").agg(F.count("*").alias("n")), "SELECT CASE WHEN type = 'bridge' THEN 'type_mismatch' WHEN score >= 0.6e0 THEN 'high_score' ELSE 'low_score' END AS reason, count(*) AS n FROM kdiscoveries GROUP BY 1")
ALIKE = "SELECT s_name AS name, lower(replace(s_name, '#', ' ')) AS text FROM supplier"


def alike(k):
    """The match of each supplier's name as a new one. Names that several suppliers have are matched once."""
    names, model = k.sql(ALIKE), models.hashing_embedder(signed=False)
    once = names.distinct()
    new = once.select(F.concat(F.lit("new "), "name").alias("a"), models.embed(F.col("text"), model).alias("va"), F.split("text", " ").alias("wa"), F.element_at(F.split("text", " "), -1).alias("key"))
    known = once.select(F.col("name").alias("b"), models.embed(F.concat("text", F.lit(" ltd")), model).alias("vb"), F.split("text", " ").alias("wb"), F.element_at(F.split("text", " "), -1).alias("kb"))
    pairs = new.join(known, F.arrays_overlap("wa", "wb") & (F.col("key") == F.col("kb"))).select("a", "b", F.round(X.cosine(F.col("va"), F.col("vb")), 5).alias("confidence"), F.lit(True).alias("type_fits"))
    return names.select(F.concat(F.lit("new "), "name").alias("a")).join(E.semantic_matches(pairs), "a").select("a", "b")


query("e10_semantic_matches", alike,
      "SELECT 'new ' || s_name AS a, s_name AS b FROM supplier")
query("l15_repair_plan", lambda k: E.repair_plan(issues(k)).select("dimension", "n", "mode", "action"), f"""{ISSUES}
  SELECT dimension, count(*) AS n, CASE dimension WHEN 'islands' THEN 'review' WHEN 'stubs' THEN 'observe' ELSE 'auto' END AS mode,
    CASE dimension WHEN 'islands' THEN 'link_or_archive' WHEN 'stubs' THEN 'enrich' WHEN 'titles' THEN 'derive_title' ELSE 'create_stub' END AS action FROM i GROUP BY 1""")
query("n15_repair_actions", lambda k: E.repair_plan(k.kdiscoveries.select(F.col("type").alias("dimension"))).select("dimension", "n", "mode"), "SELECT type AS dimension, count(*) AS n, 'blocked' AS mode FROM kdiscoveries GROUP BY type")

query("l25_rule_flags", lambda k: E.rule_flags(k.klinks, {"self_loop": F.col("from_slug") == F.col("to_slug"), "weak": F.col("weight") < 0.3, "untrusted": F.col("trust_state").isNull()}), "SELECT 'self_loop' AS code, count(*) AS n FROM klinks WHERE from_slug = to_slug HAVING count(*) > 0 UNION ALL SELECT 'weak', count(*) FROM klinks WHERE weight < 0.3e0 HAVING count(*) > 0 UNION ALL SELECT 'untrusted', count(*) FROM klinks WHERE trust_state IS NULL HAVING count(*) > 0")

query("n5_frontmatter_managers", lambda k: k.sql("SELECT 'p-' || CAST(c_custkey AS STRING) AS slug, '---' || chr(10) || 'reports_to: entity/person/c-' || CAST(c_custkey * 2 AS STRING) || chr(10) || '---' || chr(10) || 'x' AS t FROM customer").select("slug", F.element_at(N.frontmatter(F.col("t"))["fields"], "reports_to").alias("boss")).join(k.kpages.select(F.col("slug").alias("boss")), "boss").select("slug", "boss"),
      "SELECT 'p-' || CAST(c_custkey AS VARCHAR) AS slug, 'entity/person/c-' || CAST(c_custkey * 2 AS VARCHAR) AS boss FROM customer WHERE c_custkey * 2 IN (SELECT c_custkey FROM customer)")
FACTS = "SELECT 'c-' || CAST(o_custkey AS STRING) AS slug, 'entity/person' AS type, CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'birthday' WHEN 1 THEN 'current_title' ELSE 'shoe_size' END AS field, o_orderpriority AS value, CAST(o_orderkey % 10 AS DOUBLE) / 10e0 AS confidence FROM orders"

query("n7_structured_facts", lambda k: E.best_facts(k.sql(FACTS), {"entity/person": ["birthday", "current_title"]}).select("slug", "field", "value"), f"SELECT slug, field, value FROM (SELECT *, row_number() OVER (PARTITION BY slug, field ORDER BY confidence DESC, value) AS rn FROM ({FACTS}) f WHERE field IN ('birthday', 'current_title')) x WHERE rn = 1")

query("n11_resolve_or_create", lambda k: N.layered_match(k.sql("SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'zz ' || p_name END AS name FROM part"), k.kpages.filter("type = 'concept/product'"), k.kaliases).groupBy("layer").agg(F.count("*").alias("n")),
      "SELECT CASE WHEN name LIKE 'zz %' THEN 'new' ELSE 'exact' END AS layer, count(*) AS n FROM (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'zz ' || p_name END AS name FROM part) x GROUP BY 1")

query("n17_stale_stubs", lambda k: E.stale_stubs(k.sql("SELECT 'stub-' || CAST(doc_id AS STRING) AS slug, lang AS title, 'd' || CAST(doc_id AS STRING) AS source_slug FROM documents"), k.sql("SELECT 'd' || CAST(doc_id AS STRING) AS slug, text FROM documents WHERE doc_id % 2 = 0")), "SELECT 'stub-' || CAST(doc_id AS VARCHAR) AS slug FROM documents WHERE doc_id % 2 = 1 OR NOT contains(text, lang)")



