"""Queries of resolution, scoring, discovery, state merges, text structuring and streaming twins, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.functions import exprs as X
from loomwell.operators import graph as G
from loomwell.operators import knowledge as N
from loomwell.operators import relational as R
from loomwell.plans.adapters import EVENT_AS_OF, ORDER_AS_OF, Knowledge
from loomwell.plans.catalog_relational import ACTIVE, CURRENT
from loomwell.plans.registry import query

NORM = "regexp_replace(regexp_replace(regexp_replace(lower({0}), '[\\s\\-_.]+', '', 'g'), '[（(].+?[）)]', '', 'g'), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def named(k: Knowledge) -> DataFrame:
    """Titles with variants: persons and companies, some in upper case or with a parenthetical."""
    return k.sql("SELECT slug, type, CASE WHEN mention_count % 4 = 0 THEN upper(title) WHEN mention_count % 4 = 1 THEN title || ' (old)' ELSE title END AS title, mention_count FROM kpages WHERE type IN ('entity/company', 'entity/location') UNION ALL SELECT 'alt/' || slug, type, replace(title, '#', '-'), mention_count FROM kpages WHERE type = 'entity/company'")


NAMED = "named AS (SELECT slug, type, CASE WHEN mention_count % 4 = 0 THEN upper(title) WHEN mention_count % 4 = 1 THEN title || ' (old)' ELSE title END AS title, mention_count FROM kpages WHERE type IN ('entity/company', 'entity/location') UNION ALL SELECT 'alt/' || slug, type, replace(title, '#', '-'), mention_count FROM kpages WHERE type = 'entity/company')"

# ---- resolution ----
query("e1_normal_names", lambda k: named(k).select("slug", X.normal_name(F.col("title")).alias("norm")), f"WITH {NAMED} SELECT slug, {NORM.format('title')} AS norm FROM named")
query("e2_blocking_keys", lambda k: k.part.select("p_partkey", F.explode(N.blocking_keys(F.col("p_name"))).alias("key")),
      """SELECT p_partkey, replace(p_name, ' ', '') AS key FROM part UNION SELECT p_partkey, unnest(string_split(p_name, ' ')) FROM part UNION SELECT p_partkey, 'acr:' || split_part(p_name, ' ', 1)[1] || split_part(p_name, ' ', 2)[1] FROM part""")
TITLED = "SELECT slug, title, type FROM kpages WHERE type LIKE 'entity/%' OR type LIKE 'concept/%' UNION ALL SELECT 'alt/' || slug, replace(title, '#', CASE WHEN mention_count % 2 = 0 THEN '-' ELSE '-1' END), type FROM kpages WHERE type = 'entity/company'"
KEYS = f"""words AS (SELECT slug, title, type, {NORM.format('title')} AS norm, regexp_extract_all(lower(title), '[a-z0-9]{{2,}}') AS w FROM p), keys AS (SELECT slug, title, type, norm, norm AS key FROM words WHERE norm <> '' UNION SELECT slug, title, type, norm, unnest(w) FROM words UNION SELECT slug, title, type, norm, 'acr:' || array_to_string(list_transform(w, lambda x: x[1]), '') FROM words WHERE len(w) >= 2),
  big AS (SELECT key FROM keys GROUP BY key HAVING count(*) BETWEEN 2 AND 50)"""
SIMILAR = f"""p AS ({TITLED}), {KEYS}, c AS (SELECT DISTINCT x.slug AS a, y.slug AS b, x.title AS ta, y.title AS tb, x.type AS ya, y.type AS yb, x.norm AS na, y.norm AS nb FROM keys x JOIN keys y ON x.key = y.key AND x.slug < y.slug WHERE x.key IN (SELECT key FROM big)),
  d AS (SELECT *, CASE WHEN length(na) <= length(nb) THEN na ELSE nb END AS s, CASE WHEN length(na) <= length(nb) THEN nb ELSE na END AS l, levenshtein(na, nb) AS d FROM c),
  e AS (SELECT *, CASE WHEN ta = tb THEN 'exact' WHEN na = nb THEN 'normalized' WHEN contains(l, s) AND length(s) >= 2 AND (length(l) - length(s) >= 3 OR length(s) >= 0.6e0 * length(l)) THEN 'substring' WHEN d <= 2 THEN 'edit' END AS kind FROM d),
  similar_ AS (SELECT a, b, kind, CASE kind WHEN 'exact' THEN 1 WHEN 'normalized' THEN 0.95e0 WHEN 'substring' THEN 0.6e0 + 0.3e0 * length(s) / length(l) ELSE 1 - d / CAST(greatest(length(l), 1) AS DOUBLE) END AS score, CAST(kind IN ('exact', 'normalized') AND ya = yb AS INT) AS actionable, ya = yb AS same FROM e WHERE kind IS NOT NULL)"""
query("e3_candidate_pairs", lambda k: N.candidate_pairs(k.sql(TITLED)).select("a", "b"), f"WITH p AS ({TITLED}), {KEYS} SELECT DISTINCT x.slug AS a, y.slug AS b FROM keys x JOIN keys y ON x.key = y.key AND x.slug < y.slug WHERE x.key IN (SELECT key FROM big)")
query("e4_similar_pairs", lambda k: N.classify_pairs(N.candidate_pairs(k.sql(TITLED))).select("a", "b", "kind", F.round("score", 6).alias("score"), "actionable"), f"WITH {SIMILAR} SELECT a, b, kind, round(score, 6) AS score, actionable FROM similar_")
query("o7_ranked_candidates", lambda k: N.ranked_candidates(N.classify_pairs(N.candidate_pairs(k.sql(TITLED)))).select("a", "b", "kind"), f"WITH {SIMILAR} SELECT a, b, kind FROM similar_ ORDER BY actionable DESC, round(score, 9) DESC, same DESC, a, b LIMIT 100")
query("e5_bounded_edits", lambda k: k.supplier.alias("a").join(k.supplier.alias("b"), F.col("a.s_suppkey") + 9 == F.col("b.s_suppkey")).select(F.col("a.s_suppkey").alias("s_suppkey"), F.levenshtein("a.s_name", "b.s_name", 1).cast("long").alias("d")),
      "SELECT a.s_suppkey, CAST(CASE WHEN levenshtein(a.s_name, b.s_name) <= 1 THEN levenshtein(a.s_name, b.s_name) ELSE -1 END AS BIGINT) AS d FROM supplier a JOIN supplier b ON a.s_suppkey + 9 = b.s_suppkey")
query("e6_merge_targets", lambda k: (lambda f: N.merge_targets(R.cross_type_duplicates(k.sql("SELECT slug, type, title FROM kpages WHERE type = 'entity/location' UNION ALL SELECT 'x/' || slug, 'entity/brand', title FROM kpages WHERE type = 'entity/location'")).select(F.col("slug_a").alias("a"), F.col("slug_b").alias("b")), f).select("a", "b", "target"))(
          k.sql("SELECT slug, 0 AS body_chars, 0 AS chunk_count, 0 AS degree, mention_count % 3 AS mention_count, -length(title) AS title_score FROM kpages WHERE type = 'entity/location' UNION ALL SELECT 'x/' || slug, 0, 0, 0, 1, -length(title) FROM kpages WHERE type = 'entity/location'")),
      "SELECT slug AS a, 'x/' || slug AS b, CASE WHEN mention_count % 3 > 1 THEN slug WHEN mention_count % 3 < 1 THEN 'x/' || slug END AS target FROM kpages WHERE type = 'entity/location'")
LAYER_NAMES = "SELECT CASE WHEN s_suppkey % 5 = 0 THEN s_name WHEN s_suppkey % 5 = 1 THEN upper(s_name) WHEN s_suppkey % 5 = 2 THEN replace(s_name, '#', '_') WHEN s_suppkey % 5 = 3 THEN 'cust ' || CAST(s_suppkey AS STRING) ELSE 'new ' || s_name END AS name FROM supplier"
query("e8_layered_match", lambda k: N.layered_match(k.sql(LAYER_NAMES), k.kpages, k.kaliases).select("name", "slug", "layer"),
      f"""WITH n AS ({LAYER_NAMES}), h AS (SELECT name, slug, 'exact' AS layer, 1e0 AS c FROM n JOIN kpages ON title = name UNION ALL SELECT name, page_slug, 'alias', 0.95e0 FROM n JOIN kaliases ON alias = name UNION ALL SELECT name, slug, 'case', 0.9e0 FROM n JOIN kpages ON lower(title) = lower(name)
          UNION ALL SELECT name, slug, 'normalized', 0.8e0 FROM n JOIN kpages ON {NORM.format('title')} = {NORM.format('name')} AND {NORM.format('name')} <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY c DESC, slug) AS rn FROM h)
          SELECT n.name, r.slug, coalesce(r.layer, 'new') AS layer FROM n LEFT JOIN r ON r.name = n.name AND rn = 1""")
SAID = "SELECT doc_id AS doc, 1 AS pos, 'Net ' || source AS name, 'entity/company' AS type FROM documents UNION ALL SELECT doc_id, 2, 'Net ' || source || ' Works', 'entity/company' FROM documents UNION ALL SELECT doc_id, 3, 'Net-' || source || '-works', 'entity/organization' FROM documents UNION ALL SELECT doc_id, 4, 'Net ' || source || ' Work', 'entity/person' FROM documents UNION ALL SELECT doc_id, 5, 'x', 'entity/person' FROM documents"
query("e9_names_in_document", lambda k: N.intra_document_names(k.sql(SAID), [("entity/company", "entity/organization")]),
      "SELECT CAST(doc_id AS VARCHAR) AS doc, name, canonical FROM (SELECT doc_id, unnest(['Net ' || source, 'Net ' || source || ' Works', 'Net-' || source || '-works']) AS name, 'Net ' || source || ' Works' AS canonical FROM documents WHERE 2 * (3 + length(regexp_replace(source, '[^a-z0-9]', '', 'g'))) >= 8 + length(regexp_replace(source, '[^a-z0-9]', '', 'g')) UNION ALL SELECT doc_id, 'Net ' || source || ' Work', 'Net ' || source || ' Work' FROM documents UNION ALL SELECT doc_id, 'x', 'x' FROM documents) z")
query("e11_duplicate_slugs", lambda k: k.kpages.withColumn("base", F.regexp_replace("slug", r"-\d+$", "")).groupBy("base").agg(F.count("*").alias("n"), F.min("slug").alias("first")).filter("n > 1"), "SELECT regexp_replace(slug, '-\\d+$', '') AS base, count(*) AS n, min(slug) AS first FROM kpages GROUP BY 1 HAVING count(*) > 1")

query("e14_slugs", lambda k: named(k).select("slug", F.concat(F.lit("brain/"), N.slug_name(F.col("title"))).alias("made")), f"WITH {NAMED} SELECT slug, 'brain/' || regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(regexp_replace(title, '[()]', '-', 'g')), '[^a-z0-9\\s-]', '', 'g')), '\\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS made FROM named")

# ---- scoring and discovery ----
ACT = f"""WITH h AS (SELECT slug, count(*) AS n, max(CASE tool WHEN 'recall' THEN 1 WHEN 'query' THEN 1 WHEN 'expand' THEN 1.5e0 ELSE 0.5e0 END) AS v, max(created_at) AS last FROM khits WHERE created_at >= TIMESTAMP '{EVENT_AS_OF}' - INTERVAL 90 DAY GROUP BY slug),
  f AS (SELECT slug, 0.5e0 * count(*) FILTER (signal = 'relevant') - 0.2e0 * count(*) FILTER (signal = 'irrelevant') + 0.3e0 * count(*) FILTER (signal = 'expanded') AS b FROM kfeedback GROUP BY slug)
  SELECT h.slug, round(greatest(0e0, n * v * exp(-0.05e0 * (epoch_us(TIMESTAMP '{EVENT_AS_OF}') - epoch_us(last)) / 8.64e10) + coalesce(b, 0)), 5) AS activity_weight FROM h LEFT JOIN f ON f.slug = h.slug"""
query("l1_activity_weight", lambda k: N.activity_weight(k.khits, k.kfeedback, EVENT_AS_OF).withColumn("activity_weight", F.round("activity_weight", 5)), ACT)
query("l2_cooccurrence_boost", lambda k: R.new_session_pairs(k.khits, 8000, "2024-01-01 00:00:00").withColumn("boost", F.round(0.1 * F.col("n"), 6)).select("slug_a", "slug_b", "boost"),
      "WITH s AS (SELECT DISTINCT session_id FROM khits WHERE id > 8000) SELECT a.slug AS slug_a, b.slug AS slug_b, round(0.1e0 * count(*), 6) AS boost FROM khits a JOIN khits b ON a.session_id = b.session_id AND a.slug < b.slug WHERE a.session_id IN (SELECT session_id FROM s) AND (a.id > 8000 OR b.id > 8000) GROUP BY 1, 2")
BUMP = "sum(CASE tool WHEN 'expand' THEN 0.15e0 WHEN 'graph' THEN 0.05e0 ELSE 0.1e0 END * CASE pos WHEN 1 THEN 1e0 WHEN 2 THEN 0.7e0 WHEN 3 THEN 0.5e0 ELSE 0.2e0 END)"
query("l3_query_bumps", lambda k: k.khits.groupBy("slug").agg(F.round(F.expr(BUMP), 5).alias("bump")), f"SELECT slug, round({BUMP}, 5) AS bump FROM khits GROUP BY slug")
query("l4_tiers", lambda k: k.kpages.select("slug", N.tier(F.col("mention_count"), F.col("activity_weight"), F.col("tier")).cast("long").alias("tier")).groupBy("tier").agg(F.count("*").alias("n")),
      "SELECT CAST(least(tier, CASE WHEN 0.4e0 * mention_count + 0.6e0 * activity_weight >= 10 OR mention_count >= 10 THEN 1 WHEN 0.4e0 * mention_count + 0.6e0 * activity_weight >= 3 OR mention_count >= 3 THEN 2 ELSE 3 END) AS BIGINT) AS tier, count(*) AS n FROM kpages GROUP BY 1")
BODIED = "SELECT slug, type, mention_count, tier, activity_weight, length(slug) * 30 AS body_bytes FROM kpages"
P95 = "coalesce((SELECT max(v) FROM (SELECT v, sum(n) OVER (ORDER BY v DESC) AS upto, sum(n) OVER () AS total FROM (SELECT CAST({0} AS DOUBLE) AS v, count(*) AS n FROM j WHERE {0} > 0 GROUP BY 1) c) x WHERE upto > floor(total * 0.05e0)), 1e0)"
query("l5_hotness", lambda k: N.hotness(R.pages_with_link_count(k.sql(BODIED), k.klinks), k.klinks).select("slug", F.round("hotness", 3).alias("hotness")),
      f"""WITH e AS (SELECT from_slug AS slug, link_key FROM klinks WHERE {CURRENT} UNION SELECT to_slug, link_key FROM klinks WHERE {CURRENT}), d AS (SELECT slug, count(*) AS links FROM e GROUP BY slug), j AS (SELECT p.*, coalesce(d.links, 0) AS links FROM ({BODIED}) p LEFT JOIN d ON d.slug = p.slug),
          t AS (SELECT {P95.format('mention_count')} AS m, coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM (SELECT from_slug AS slug FROM klinks WHERE {ACTIVE} UNION ALL SELECT to_slug FROM klinks WHERE {ACTIVE}) x GROUP BY slug) y), 1) AS l, {P95.format('activity_weight')} AS a)
          SELECT slug, floor((0.25e0 * least(1e0, mention_count / m) + 0.2e0 * least(1e0, links / l) + 0.3e0 * least(1e0, activity_weight / a) + 0.15e0 * CASE tier WHEN 1 THEN 1e0 WHEN 2 THEN 0.5e0 ELSE 0.1e0 END + 0.1e0 * greatest(0e0, least(1e0, (body_bytes - 200) / 1800e0))) * 1000 + 0.5e0) / 1000e0 AS hotness FROM j, t""")
query("l6_entity_profile", lambda k: N.profiles(k.kpages, k.klinks, k.ktags),
      f"SELECT slug, title, tier, mention_count, coalesce(o.n, 0) AS outgoing, coalesce(i.n, 0) AS incoming, coalesce(t.tags, '') AS tags FROM kpages LEFT JOIN (SELECT from_slug, count(*) AS n FROM klinks WHERE {CURRENT} GROUP BY 1) o ON from_slug = slug LEFT JOIN (SELECT to_slug, count(*) AS n FROM klinks WHERE {CURRENT} GROUP BY 1) i ON to_slug = slug LEFT JOIN (SELECT page_slug, string_agg(tag, ',' ORDER BY tag) AS tags FROM ktags GROUP BY 1) t ON t.page_slug = slug")
DEGREE = f"d AS (SELECT slug, count(*) AS degree FROM (SELECT from_slug AS slug FROM klinks WHERE {ACTIVE} AND from_slug <> to_slug UNION ALL SELECT to_slug FROM klinks WHERE {ACTIVE} AND from_slug <> to_slug) x GROUP BY slug)"
FEW = DEGREE.replace("from_slug <> to_slug", "from_slug <> to_slug AND relation NOT IN ('uses', 'produces')")
query("l7_gap_detection", lambda k: N.gaps(k.kpages, R.degree(k.klinks.filter("relation NOT IN ('uses', 'produces')"))).select("slug", F.round("score", 6).alias("score"), "actionable"),
      f"""WITH {FEW}, g AS (SELECT p.slug, least(1e0, 0.6e0 * log2(mention_count) / log2(50) + 0.4e0 * CASE WHEN coalesce(degree, 0) = 0 THEN 1 ELSE 0.5e0 END) AS s FROM kpages p LEFT JOIN d ON d.slug = p.slug WHERE length(title) >= 3 AND ((type LIKE 'entity/%' AND mention_count >= 8 AND coalesce(degree, 0) <= 1) OR (type LIKE 'concept/%' AND mention_count >= 30 AND coalesce(degree, 0) = 0)))
          SELECT slug, round(s, 6) AS score, CASE WHEN s >= 0.7e0 THEN 'high' ELSE 'medium' END AS actionable FROM g""")


def proposals(k: Knowledge) -> DataFrame:
    near = R.neighbours(k.klinks.filter("relation <> 'located_in'"))
    latest = k.ktimeline.filter("length(event_date) = 10 AND event_date <> '2023-02-29'").groupBy(F.col("page_slug").alias("slug")).agg(F.max("event_date").cast("date").alias("latest"))
    return N.proactive_connections(near, k.kpages.filter(f"type = 'entity/person' AND updated_at >= TIMESTAMP '{ORDER_AS_OF}' - INTERVAL 30 DAYS"), R.session_pairs(k.khits), latest)


PROPOSALS = f"""n AS (SELECT from_slug AS slug, to_slug AS o FROM klinks WHERE {CURRENT} AND relation <> 'located_in' UNION SELECT to_slug, from_slug FROM klinks WHERE {CURRENT} AND relation <> 'located_in'), deg AS (SELECT slug, count(*) AS c FROM n GROUP BY slug HAVING count(*) <= 20), m AS (SELECT n.* FROM n WHERE o IN (SELECT slug FROM deg)),
  pv AS (SELECT slug FROM kpages WHERE type = 'entity/person' AND updated_at >= TIMESTAMP '{ORDER_AS_OF}' - INTERVAL 30 DAY), pr AS (SELECT x.slug AS a, y.slug AS b, count(*) AS shared FROM m x JOIN m y ON x.o = y.o AND x.slug <> y.slug WHERE x.slug IN (SELECT slug FROM pv) GROUP BY 1, 2 HAVING count(*) >= 2),
  s AS (SELECT a.slug AS lo, b.slug AS hi, count(*) AS n FROM khits a JOIN khits b ON a.session_id = b.session_id AND a.slug < b.slug GROUP BY 1, 2), lt AS (SELECT page_slug AS slug, CAST(max(event_date) AS DATE) AS d FROM ktimeline WHERE length(event_date) = 10 AND event_date <> '2023-02-29' GROUP BY 1),
  props AS (SELECT pr.a, pr.b, shared, CAST(coalesce(s.n, 0) >= 2 AS INT) AS signal_b, CAST(coalesce(abs(x.d - y.d) <= 14, false) AS INT) AS signal_c FROM pr LEFT JOIN s ON lo = least(pr.a, pr.b) AND hi = greatest(pr.a, pr.b) LEFT JOIN lt x ON x.slug = pr.a LEFT JOIN lt y ON y.slug = pr.b WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.slug = pr.a AND n.o = pr.b))"""
query("l9_proactive_connections", proposals, f"WITH {PROPOSALS} SELECT * FROM props")
query("l10_connection_scores", lambda k: N.score_connections(proposals(k).withColumn("occurrences", F.lit(1))).groupBy("gate").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 5).alias("quality")),
      f"""WITH {PROPOSALS}, q AS (SELECT *, greatest(0, least(2, shared - 2)) AS x, signal_b + signal_c AS g FROM props), r AS (SELECT *, least(1e0, 0.4e0 + 0.1e0 * x + 0.2e0 * g) AS e, greatest(0e0, 0.5e0 - 0.15e0 * g - 0.05e0 * x) AS k FROM q)
          SELECT CASE WHEN shared >= 3 AND g >= 1 THEN 'strong_corroborated' WHEN g = 2 THEN 'multi_independent' ELSE 'rejected' END AS gate, count(*) AS n, round(avg(0.35e0 * e + 0.15e0 / 1.5e0 + 0.2e0 / 3e0 + 0.06e0 + 0.2e0 * (1 - k)), 5) AS quality FROM r GROUP BY 1""")
query("l11_cooldown", lambda k: k.kdiscoveries.filter("type = 'proactive_connection' AND status = 'pending'").join(k.kdiscoveries.filter("status = 'dismissed'").select("entity_a", "entity_b"), ["entity_a", "entity_b"], "left_anti").select("id"),
      "SELECT id FROM kdiscoveries d WHERE type = 'proactive_connection' AND status = 'pending' AND NOT EXISTS (SELECT 1 FROM kdiscoveries x WHERE x.status = 'dismissed' AND x.entity_a = d.entity_a AND x.entity_b = d.entity_b)")
query("l13_review_gates", lambda k: N.review_gates(k.kdiscoveries.select("id", (F.col("id") % 5).alias("evidence"), F.col("occurrence_count").alias("persistence"), F.col("score").alias("novelty"), (F.col("id") % 10 / 10.0).alias("action"), (F.col("id") % 7 / 10.0).alias("risk"))).groupBy("failed").agg(F.count("*").alias("n")),
      "SELECT concat_ws(',', CASE WHEN id % 5 < 3 THEN 'evidence' END, CASE WHEN occurrence_count < 2 THEN 'persistence' END, CASE WHEN score < 0.5e0 THEN 'novelty' END, CASE WHEN id % 10 / 10e0 < 0.5e0 THEN 'action' END, CASE WHEN id % 7 / 10e0 > 0.3e0 THEN 'risk' END) AS failed, count(*) AS n FROM kdiscoveries GROUP BY 1")
query("l16_freshness", lambda k: N.freshness(k.kdiscoveries, ORDER_AS_OF).groupBy("type", "freshness").agg(F.count("*").alias("n")),
      f"SELECT type, CASE WHEN epoch_us(TIMESTAMP '{ORDER_AS_OF}') - epoch_us(detected_at) <= 14 * 8.64e10 THEN 'fresh' WHEN occurrence_count >= 3 THEN 'recurring' ELSE 'stale' END AS freshness, count(*) AS n FROM kdiscoveries GROUP BY 1, 2")


def issues(k: Knowledge) -> DataFrame:
    severity = F.when(F.col("fault") == "islands", "medium").when(F.col("fault") == "stubs", "low").otherwise("high")
    return R.page_faults(k.kpages, k.klinks).select(F.col("fault").alias("dimension"), severity.alias("severity"), "n")


#: The same findings in SQL: i(dimension, severity).
ISSUES = f"""WITH e AS (SELECT from_slug AS slug, link_key FROM klinks WHERE {CURRENT} UNION SELECT to_slug, link_key FROM klinks WHERE {CURRENT}), d AS (SELECT slug, count(*) AS n FROM e GROUP BY slug),
  i AS (SELECT 'islands' AS dimension, 'medium' AS severity FROM kpages WHERE slug NOT IN (SELECT slug FROM e) UNION ALL SELECT 'stubs', 'low' FROM kpages p LEFT JOIN d ON d.slug = p.slug WHERE tier = 3 AND (type LIKE 'entity/%' OR type LIKE 'concept/%') AND mention_count <= 1 AND coalesce(n, 0) <= 1
    UNION ALL SELECT 'titles', 'high' FROM kpages WHERE trim(title) = '' UNION ALL SELECT 'dangling', 'high' FROM klinks WHERE from_slug NOT IN (SELECT slug FROM kpages) UNION ALL SELECT 'dangling', 'high' FROM klinks WHERE to_slug NOT IN (SELECT slug FROM kpages))"""

query("l17_health", lambda k: N.health_status(issues(k)), f"""{ISSUES}
  SELECT dimension, severity, count(*) AS n, CASE WHEN (SELECT count(*) FROM i WHERE severity = 'high') > 5 THEN 'fail' ELSE 'warn' END AS status FROM i GROUP BY 1, 2""")
query("l18_health_delta", lambda k: N.issue_delta(k.kpages.filter("tier = 3").select("slug", F.col("type").alias("dimension")), k.kpages.filter("mention_count < 5").select("slug", F.col("type").alias("dimension"))),
      "SELECT type AS dimension, CASE WHEN tier = 3 AND mention_count < 5 THEN 'unchanged' WHEN tier = 3 THEN 'resolved' ELSE 'new' END AS state, count(*) AS n FROM kpages WHERE tier = 3 OR mention_count < 5 GROUP BY 1, 2")
query("l19_thin_pages", lambda k: k.kpages.filter("mention_count >= 3").join(k.kchunks.groupBy(F.col("page_slug").alias("slug")).agg(F.count("*").alias("c")), "slug", "left").filter("coalesce(c, 0) <= 1").select("slug"), "SELECT slug FROM kpages WHERE mention_count >= 3 AND (SELECT count(*) FROM kchunks WHERE page_slug = slug) <= 1")
query("l20_wakeup_counts", lambda k: R.snapshot_diff(k.ksnap_old, k.ksnap_new).groupBy("change").agg(F.count("*").alias("n")).filter("change IN ('added', 'removed', 'content')"),
      "SELECT CASE WHEN o.slug IS NULL THEN 'added' WHEN n.slug IS NULL THEN 'removed' ELSE 'content' END AS change, count(*) AS n FROM ksnap_old o FULL JOIN ksnap_new n ON o.slug = n.slug WHERE o.slug IS NULL OR n.slug IS NULL OR o.content_hash <> n.content_hash GROUP BY 1")

query("l27_promotions", lambda k: k.kdiscoveries.filter("actionable = 'high' OR occurrence_count >= 3 OR type = 'bridge'").select("id", F.round(X.clamp(F.col("score"), 0.1, 1.0), 8).alias("score")), "SELECT id, round(greatest(0.1e0, least(1e0, score)), 8) AS score FROM kdiscoveries WHERE actionable = 'high' OR occurrence_count >= 3 OR type = 'bridge'")

# ---- merges ----
KEYED = "SELECT type || ':' || least(entity_a, entity_b) || ',' || greatest(entity_a, entity_b) AS dedup_key, max(score) AS score, max(detected_at) AS detected_at, max(occurrence_count) AS occurrence_count, max(status) AS status, max(seen) AS seen FROM kdiscoveries WHERE {0} GROUP BY 1"
query("m1_discovery_upsert", lambda k: N.discovery_upsert(k.sql(KEYED.format("id % 2 = 0")), k.sql(KEYED.format("id % 2 = 1"))).select("dedup_key", F.round("score", 8).alias("score"), F.col("occurrence_count").cast("long").alias("n"), "status", "seen"),
      f"SELECT coalesce(o.dedup_key, n.dedup_key) AS dedup_key, round(coalesce(n.score, o.score), 8) AS score, CAST(CASE WHEN o.dedup_key IS NOT NULL AND n.dedup_key IS NOT NULL THEN o.occurrence_count + 1 ELSE coalesce(o.occurrence_count, 1) END AS BIGINT) AS n, coalesce(o.status, 'pending') AS status, coalesce(o.seen, 0) AS seen FROM ({KEYED.format('id % 2 = 0')}) o FULL JOIN ({KEYED.format('id % 2 = 1')}) n ON o.dedup_key = n.dedup_key")
query("m2_discovery_cleanup", lambda k: k.kdiscoveries.filter((F.col("seen") == 1) | (F.col("detected_at") >= X.ts(ORDER_AS_OF) - F.expr("INTERVAL 365 DAYS"))).groupBy("status").agg(F.count("*").alias("n")), f"SELECT status, count(*) AS n FROM kdiscoveries WHERE seen = 1 OR detected_at >= TIMESTAMP '{ORDER_AS_OF}' - INTERVAL 365 DAY GROUP BY status")
query("m3_candidate_hashes", lambda k: k.kdiscoveries.select(F.sha2(F.concat_ws("|", "type", "entity_a"), 256).alias("content_hash"), "detected_at").groupBy("content_hash").agg(F.max("detected_at").cast("date").cast("string").alias("last_seen"), F.count("*").alias("n")), "SELECT sha256(type || '|' || entity_a) AS content_hash, CAST(CAST(max(detected_at) AS DATE) AS VARCHAR) AS last_seen, count(*) AS n FROM kdiscoveries GROUP BY 1")
query("m4_insight_expiry", lambda k: k.kdiscoveries.withColumn("expires", F.col("detected_at") + F.expr("INTERVAL 90 DAYS")).withColumn("state", F.when(F.col("expires") < X.ts(ORDER_AS_OF), "archived").otherwise("active")).groupBy("state").agg(F.count("*").alias("n")), f"SELECT CASE WHEN detected_at + INTERVAL 90 DAY < TIMESTAMP '{ORDER_AS_OF}' THEN 'archived' ELSE 'active' END AS state, count(*) AS n FROM kdiscoveries GROUP BY 1")
query("m5_snapshot_upsert", lambda k: N.keep_latest(k.kqlog.select("query", F.to_date("created_at").cast("string").alias("day"), "latency_ms", "id"), ["query", "day"], "id").select("query", "day", "latency_ms"), "SELECT query, day, latency_ms FROM (SELECT query, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, latency_ms, row_number() OVER (PARTITION BY query, CAST(created_at AS DATE) ORDER BY id DESC) AS rn FROM kqlog) x WHERE rn = 1")
query("m6_mention_deltas", lambda k: k.kdiscoveries.select(F.col("entity_a").alias("from_slug"), F.col("entity_b").alias("to_slug")).distinct().join(k.klinks.select("from_slug", "to_slug"), ["from_slug", "to_slug"], "left_anti").groupBy("to_slug").agg(F.count("*").alias("delta")),
      "SELECT to_slug, count(*) AS delta FROM (SELECT DISTINCT entity_a AS f, entity_b AS to_slug FROM kdiscoveries) x WHERE NOT EXISTS (SELECT 1 FROM klinks l WHERE l.from_slug = f AND l.to_slug = x.to_slug) GROUP BY to_slug")
query("m7_page_delete_cascade", lambda k: (lambda gone: k.klinks.join(gone.select(F.col("slug").alias("from_slug")), "from_slug", "left_anti").join(gone.select(F.col("slug").alias("to_slug")), "to_slug", "left_anti").groupBy("relation").agg(F.count("*").alias("n")))(k.kpages.filter("type = 'entity/location'").select("slug")),
      "SELECT relation, count(*) AS n FROM klinks WHERE from_slug NOT IN (SELECT slug FROM kpages WHERE type = 'entity/location') AND to_slug NOT IN (SELECT slug FROM kpages WHERE type = 'entity/location') GROUP BY relation")
query("m8_trust_changes", lambda k: k.klinks.withColumn("new", X.trust_from_source()).filter("trust_state IS NOT NULL AND trust_state <> new").groupBy("trust_state", "new").agg(F.count("*").alias("n")),
      "SELECT trust_state, CASE WHEN confidence < 0.3e0 THEN 'candidate' WHEN source_type IN ('wikilink', 'manual') THEN 'trusted' ELSE 'candidate' END AS new, count(*) AS n FROM klinks WHERE trust_state IS NOT NULL AND trust_state <> CASE WHEN confidence < 0.3e0 THEN 'candidate' WHEN source_type IN ('wikilink', 'manual') THEN 'trusted' ELSE 'candidate' END GROUP BY 1, 2")



query("m12_tag_replace", lambda k: k.ktags.filter("page_slug <> 'records/doc-1'").unionByName(k.spark.createDataFrame([("records/doc-1", "x"), ("records/doc-1", "x"), ("records/doc-1", "y")], "page_slug string, tag string").distinct()).filter("page_slug LIKE 'records/doc-1%'").groupBy("page_slug").agg(F.count("*").alias("n")),
      "SELECT page_slug, CASE WHEN page_slug = 'records/doc-1' THEN 2 ELSE count(*) END AS n FROM ktags WHERE page_slug LIKE 'records/doc-1%' GROUP BY page_slug")
query("m14_missing_provenance", lambda k: k.kpages.filter("type = 'record'").join(k.klinks.filter("relation = 'mentions'").select(F.col("from_slug").alias("slug")), "slug", "left_anti").select("slug"), "SELECT slug FROM kpages WHERE type = 'record' AND slug NOT IN (SELECT from_slug FROM klinks WHERE relation = 'mentions')")

# ---- text structuring ----
DOCS = "SELECT 'records/doc-' || CAST(doc_id AS STRING) AS slug, text FROM documents"
query("n1_chunk_documents", lambda k: N.chunk_pages(k.sql(f"SELECT slug, replace(text, chr(10), chr(10) || chr(10)) AS text FROM ({DOCS}) d")).select("slug", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("content").cast("long").alias("chars"), F.md5("content").alias("h")),
      f"""WITH p AS (SELECT slug, list_filter(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n\\n+'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '') AS parts FROM ({DOCS}) d),
          a AS (SELECT slug, list_reduce(list_prepend({{'done': []::VARCHAR[], 'cur': ''}}, list_transform(parts, lambda x: {{'done': []::VARCHAR[], 'cur': x}})), lambda s, x: CASE WHEN length(s.cur) + length(x.cur) > 500 AND length(s.cur) > 0 THEN {{'done': list_append(s.done, s.cur), 'cur': x.cur}}
            ELSE {{'done': s.done, 'cur': CASE WHEN length(s.cur) > 0 THEN s.cur || chr(10) || chr(10) || x.cur ELSE x.cur END}} END) AS s FROM p WHERE len(parts) > 0),
          c AS (SELECT slug, list_append(s.done, s.cur) AS chunks FROM a), u AS (SELECT slug, unnest(chunks) AS content, generate_subscripts(chunks, 1) - 1 AS chunk_index FROM c)
          SELECT slug, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(length(t) AS BIGINT) AS chars, md5(t) AS h FROM (SELECT slug, chunk_index, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS t FROM u) x""")
query("n2_sentence_chunks", lambda k: k.sql(DOCS).filter("text is not null").select("slug", F.posexplode(N.sentence_chunks(F.col("text"), 1000)).alias("pos", "content")).select("slug", F.col("pos").cast("long").alias("pos"), F.md5("content").alias("h")),
      f"""WITH d AS ({DOCS}), p AS (SELECT slug, list_filter(list_transform(regexp_extract_all(text, '[^。！？.!?\\n]*[。！？.!?\\n]|[^。！？.!?\\n]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS parts FROM d WHERE length(text) > 1000),
          q AS (SELECT slug, flatten(list_transform(parts, lambda x: list_transform(range(0, CAST((length(x) - 1) // 1000 AS BIGINT) + 1), lambda i: x[i * 1000 + 1 : i * 1000 + 1000]))) AS pieces FROM p),
          a AS (SELECT slug, list_reduce(list_prepend({{'done': []::VARCHAR[], 'cur': ''}}, list_transform(pieces, lambda x: {{'done': []::VARCHAR[], 'cur': x}})), lambda s, x: CASE WHEN length(s.cur) + length(x.cur) > 1000 AND length(s.cur) > 0 THEN {{'done': list_append(s.done, s.cur), 'cur': x.cur}} ELSE {{'done': s.done, 'cur': s.cur || x.cur}} END) AS s FROM q),
          c AS (SELECT slug, list_append(s.done, s.cur) AS chunks FROM a UNION ALL SELECT slug, [text] FROM d WHERE length(text) <= 1000)
          SELECT slug, CAST(i AS BIGINT) AS pos, md5(content) AS h FROM (SELECT slug, unnest(chunks) AS content, generate_subscripts(chunks, 1) - 1 AS i FROM c) x""")
LINKED = "SELECT 'records/doc-' || CAST(doc_id AS STRING) AS slug, 'see [[' || source || '#top|here]] and [[' || lang || ']] and ![[pic.png]] `[[code]]` [[a.pdf]] [[' || source || ']]' AS body FROM documents"
query("n3_wikilinks", lambda k: k.sql(LINKED).select("slug", F.array_join(N.wikilinks(F.col("body")), ",").alias("targets")), "SELECT 'records/doc-' || CAST(doc_id AS VARCHAR) AS slug, source || ',' || lang AS targets FROM documents")

FRONT = "SELECT doc_id, '---' || chr(10) || 'title: old' || chr(10) || 'title: \"Doc ' || CAST(doc_id AS STRING) || '\"' || chr(10) || 'lang: ' || lang || chr(10) || 'tags: [one, ' || source || ']' || chr(10) || 'aliases:' || chr(10) || '  - x ' || lang || chr(10) || '  - \"y\"' || chr(10) || 'meta:' || chr(10) || '  source: ' || source || chr(10) || '---' || chr(10) || 'body ' || source AS t FROM documents"
query("s2_frontmatter", lambda k: k.sql(FRONT).select("doc_id", N.frontmatter(F.col("t")).alias("f")).select("doc_id", F.col("f.fields")["title"].alias("title"), F.col("f.fields")["lang"].alias("lang"), F.col("f.fields")["meta.source"].alias("source"), F.array_join(F.col("f.lists")["tags"], "+").alias("tags"), F.array_join(F.col("f.lists")["aliases"], "+").alias("aliases"), "f.body"),
      "SELECT doc_id, 'Doc ' || CAST(doc_id AS VARCHAR) AS title, lang, source, 'one+' || source AS tags, 'x ' || lang || '+y' AS aliases, 'body ' || source AS body FROM documents")
query("p17_content_kinds", lambda k: k.sql(f"SELECT t FROM ({FRONT}) f UNION ALL SELECT text FROM documents").groupBy(N.content_kind(F.col("t")).alias("kind")).agg(F.count("*").alias("n")), "SELECT 'markdown' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'text', count(*) FROM documents")
query("n8_ingest_dedup", lambda k: k.documents.groupBy(N.fingerprint(F.col("text")).alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1"), "SELECT sha256(regexp_replace(regexp_replace(text, '\\r\\n', chr(10), 'g'), '^\\s+|\\s+$', '', 'g'))[1:16] AS h, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
query("n10_transcripts", lambda k: k.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n").alias("t")).select("conv_id", F.md5("t").alias("h")), "SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS h FROM conversations GROUP BY conv_id")
query("n13_topic_fingerprints", lambda k: N.topic_fingerprints(k.ktags.select("tag", F.col("page_slug").alias("slug"))), "SELECT tag, count(*) AS n, sum(('0x' || md5(page_slug)[1:8])::BIGINT)::BIGINT AS h, sum(('0x' || md5(page_slug)[9:16])::BIGINT)::BIGINT AS h2 FROM ktags GROUP BY tag")
query("n14_findings", lambda k: R.shared_titles(k.kpages).agg(F.count_distinct("title").alias("groups"), F.count("*").alias("rows")).select(F.lit("title_collision").alias("check"), "groups", "rows"), """SELECT 'title_collision' AS "check", count(*) AS groups, sum(n)::BIGINT AS rows FROM (SELECT count(*) AS n FROM kpages WHERE trim(title) <> '' GROUP BY title HAVING count(*) > 1) x""")
query("n16_date_normalisation", lambda k: k.ktimeline.select(N.normal_date(F.col("event_date")).alias("d")).groupBy("d").agg(F.count("*").alias("n")), "SELECT CASE WHEN length(event_date) = 4 THEN event_date || '-01-01' WHEN length(event_date) = 7 THEN event_date || '-01' ELSE event_date END AS d, count(*) AS n FROM ktimeline GROUP BY 1")
query("s11_sync_plan", lambda k: N.sync_plan(k.sql("SELECT slug, CASE WHEN tier = 1 THEN md5('changed') ELSE content_hash END AS content_hash FROM kpages WHERE type <> 'entity/location' UNION ALL SELECT 'new/' || slug, content_hash FROM kpages WHERE type = 'entity/company' UNION ALL SELECT slug, content_hash FROM kpages WHERE slug = 'entity/company/s-1'"), k.kpages).groupBy("action").agg(F.count("*").alias("n")),
      """SELECT action, count(*) AS n FROM (SELECT CASE WHEN slug = 'entity/company/s-1' THEN 'duplicate' WHEN type = 'entity/location' THEN 'delete' WHEN tier = 1 THEN 'update' ELSE 'skip' END AS action FROM kpages UNION ALL SELECT 'add' FROM kpages WHERE type = 'entity/company') x GROUP BY action""")

# ---- batch forms of the stream operators ----
query("t6_rolling_stats", lambda k: k.kqlog.groupBy(F.window("created_at", "7 days", "1 day").alias("w"), "tool").agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start_us"), "tool", "n"),
      "WITH d AS (SELECT CAST(created_at AS DATE) AS day, tool, count(*) AS n FROM kqlog GROUP BY 1, 2) SELECT epoch_us(CAST(day - CAST(i AS INT) AS TIMESTAMP)) AS start_us, tool, sum(n)::BIGINT AS n FROM d, range(7) t(i) GROUP BY 1, 2")
query("t7_sessions", lambda k: k.events.groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest")),
      "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events), h AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g), c AS (SELECT user_id, sid, count(*) AS n FROM h GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id")
query("t8_daily_snapshot", lambda k: k.kqlog.groupBy(F.window("created_at", "1 day").alias("w"), "query").agg(F.count("*").alias("n")).select(F.to_date("w.start").cast("string").alias("day"), "query", "n"), "SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, query, count(*) AS n FROM kqlog GROUP BY 1, 2")
query("t5_retention", lambda k: k.kqlog.filter(F.col("created_at") >= X.ts(EVENT_AS_OF) - F.expr("INTERVAL 10 DAYS")).agg(F.count("*").alias("kept")), f"SELECT count(*) AS kept FROM kqlog WHERE created_at >= TIMESTAMP '{EVENT_AS_OF}' - INTERVAL 10 DAY")
