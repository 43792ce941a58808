"""Queries of routing, safety, ontology, lexical support, models and entity names."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwell.functions import exprs as X
from loomwell.functions import intent as I
from loomwell.functions import lexical as L
from loomwell.functions import ontology as O
from loomwell.operators import graph as G
from loomwell.operators import retrieval as V
from loomwell.plans import models
from loomwell.plans.adapters import Knowledge
from loomwell.plans.registry import query

# titles and parts of them, with the endings, beginnings and words that names do not have
NAMES_ASKED = "SELECT DISTINCT CASE k % 12 WHEN 0 THEN 'q' || CAST(k AS STRING) WHEN 1 THEN '项目的' WHEN 2 THEN '考虑' WHEN 3 THEN '一家' WHEN 4 THEN '经常' WHEN 5 THEN '如何做' WHEN 6 THEN '不要去那' WHEN 7 THEN '我们：一' WHEN 8 THEN 'ab' WHEN 9 THEN '张三' WHEN 10 THEN 'x' ELSE 'the long name of a page ' || CAST(k AS STRING) END AS name FROM kqlog UNION SELECT title FROM kpages"
ASKED = "SELECT CASE k % 9 WHEN 0 THEN 'debug this' WHEN 1 THEN 'compare A and B' WHEN 2 THEN 'who reports to Anna' WHEN 3 THEN 'overview of sales' WHEN 4 THEN 'how are they connected' WHEN 5 THEN 'what changed last time' WHEN 6 THEN '' WHEN 7 THEN 'difference and overview' ELSE 'plain words' END AS query FROM kqlog GROUP BY 1"
ROUTED = "CASE WHEN q = '' THEN 'debug_search' WHEN q LIKE '%debug%' THEN 'debug_search' WHEN q LIKE '%reports to%' THEN 'hierarchy' WHEN q LIKE '%connected%' THEN 'relationship' WHEN q LIKE '%compare%' OR q LIKE '%difference%' THEN 'reasoning' WHEN q LIKE '%overview%' THEN 'overview' ELSE 'content_recall' END"
query("h11_front_door", lambda k: I.front_door(k.sql(ASKED)).select("query", "route", F.round("confidence", 6).alias("confidence")),
      f"SELECT q AS query, {ROUTED} AS route, CASE WHEN q = '' THEN 0.4e0 WHEN {ROUTED} = 'content_recall' THEN 0.55e0 ELSE 0.8e0 END AS confidence FROM (SELECT query AS q FROM ({ASKED}) a) b")
query("h10_query_router", lambda k: I.route(k.sql(ASKED), k.sql("SELECT 'plain words' AS query, 1 AS n_known, false AS exact")),
      f"SELECT query, CASE WHEN query LIKE '%compare%' OR query LIKE '%difference%' OR query LIKE '%connected%' OR query LIKE '%overview%' THEN 'agentic' WHEN query = 'plain words' THEN 'fast' ELSE 'hybrid' END AS mode, CASE WHEN query LIKE '%compare%' OR query LIKE '%difference%' THEN 'comparison' WHEN query LIKE '%connected%' THEN 'relationship' WHEN query LIKE '%overview%' THEN 'review' WHEN query LIKE '%last time%' THEN 'timeline' WHEN query = 'plain words' THEN 'entity_lookup' ELSE 'keyword' END AS intent FROM ({ASKED}) a")
query("h12_temporal_intent", lambda k: I.temporal_intent(k.sql(ASKED)), f"SELECT query, CAST(query LIKE '%last time%' OR query LIKE '%changed%' AS INT) AS temporal, 0 AS history, 0 AS first_person FROM ({ASKED}) a")
query("p15_entity_names", lambda k: k.sql(NAMES_ASKED).select("name", I.valid_name(F.col("name")).cast("int").alias("valid")),
      f"""SELECT name, CAST(length(trim(name)) BETWEEN 2 AND 18 AND NOT ({" OR ".join(f"regexp_matches(trim(name), '{p}')" for p in I.NAME_REJECT)}) AS INT) AS valid FROM ({NAMES_ASKED}) n""")
query("p19_display_safety", lambda k: k.documents.select("doc_id", (I.display_safe(F.col("text"), "withheld") == "withheld").cast("int").alias("withheld")),
      "SELECT doc_id, CAST(" + " OR ".join(f"""regexp_matches(text, '{p.replace("'", "''")}')""" for p in I.UNSAFE) + " AS INT) AS withheld FROM documents")
query("p19_structured_values", lambda k: k.kpages.select("slug", I.safe_value(F.concat(F.lit("see "), F.when(F.col("tier") == 1, F.concat(F.lit("entities/"), "title")).when(F.col("tier") == 2, F.concat(F.lit("ｓｃｏ\u200bｒｅ "), "title")).otherwise(F.concat("title", F.lit("\u200b！")))), "withheld").alias("value")),
      "SELECT slug, CASE WHEN tier = 1 OR tier = 2 THEN 'withheld' ELSE 'see ' || title || '!' END AS value FROM kpages")
CANON = "CASE relation WHEN 'uses' THEN '制造' WHEN 'part_of' THEN '归属' ELSE '提及' END"
query("g18_relation_audit", lambda k: O.canonical(k.klinks).groupBy("relation", "canonical").agg(F.count("*").alias("n")), f"SELECT relation, {CANON} AS canonical, count(*) AS n FROM klinks GROUP BY 1, 2")
query("p21_valid_relations", lambda k: k.klinks.join(F.broadcast(O.alias_dim(k.spark).select(F.col("name").alias("relation"))), "relation", "left_anti").filter("relation <> 'reports_to'").groupBy("relation").agg(F.count("*").alias("n")), "SELECT relation, count(*) AS n FROM klinks WHERE relation NOT IN ('uses', 'part_of', 'reports_to') GROUP BY relation")
query("p22_endpoint_types", lambda k: O.endpoint_check(O.canonical(k.klinks).join(k.kpages.select(F.col("slug").alias("from_slug"), F.col("type").alias("from_type")), "from_slug").join(k.kpages.select(F.col("slug").alias("to_slug"), F.col("type").alias("to_type")), "to_slug")).groupBy("canonical", "fits").agg(F.count("*").alias("n")),
      f"SELECT {CANON} AS canonical, CAST({CANON} = '提及' AS INT) AS fits, count(*) AS n FROM klinks JOIN kpages f ON f.slug = from_slug JOIN kpages t ON t.slug = to_slug GROUP BY 1, 2")
query("p23_endpoint_entities", lambda k: (lambda e: k.klinks.join(e.withColumnRenamed("slug", "from_slug"), "from_slug", "left_semi").join(e.withColumnRenamed("slug", "to_slug"), "to_slug", "left_semi").groupBy("relation").agg(F.count("*").alias("n")))(k.kpages.filter(X.entity_or_concept()).select("slug")),
      "WITH e AS (SELECT slug FROM kpages WHERE type LIKE 'entity/%' OR type LIKE 'concept/%') SELECT relation, count(*) AS n FROM klinks WHERE from_slug IN (SELECT slug FROM e) AND to_slug IN (SELECT slug FROM e) GROUP BY relation")

query("p13_record_prefilter", lambda k: k.kpages.filter("type = 'record'").join(k.kchunks.filter((F.instr("content", "License") > 0) | (F.instr("content", "password") > 0)).select(F.col("page_slug").alias("slug")).distinct(), "slug", "left_semi").select("slug"), "SELECT slug FROM kpages WHERE type = 'record' AND slug IN (SELECT page_slug FROM kchunks WHERE contains(content, 'License') OR contains(content, 'password'))")
query("p18_personal_notes", lambda k: k.documents.select("doc_id", (F.lower("text").rlike(r"\bmy (?:preference|habit|taste|style)\b|\bi (?:prefer|like|love|always|usually)\b") & ~F.lower("text").rlike(r"\b(article|paper|report|project|code|system)\b")).cast("int").alias("personal")).groupBy("personal").agg(F.count("*").alias("n")),
      r"SELECT CAST(regexp_matches(lower(text), '\bmy (?:preference|habit|taste|style)\b|\bi (?:prefer|like|love|always|usually)\b') AND NOT regexp_matches(lower(text), '\b(article|paper|report|project|code|system)\b') AS INT) AS personal, count(*) AS n FROM documents GROUP BY 1")
query("p25_digest_reasons", lambda k: k.kdiscoveries.withColumn("reason", F.when(F.col("status") == "dismissed", "dismissed").when((F.col("type") == "bridge") & (F.col("actionable") == "low"), "no_suggestion").when(F.col("score") < 0.2, "weak_signal")).groupBy("type", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n")),
      "SELECT type, CASE WHEN status = 'dismissed' THEN 'dismissed' WHEN type = 'bridge' AND actionable = 'low' THEN 'no_suggestion' WHEN score < 0.2e0 THEN 'weak_signal' ELSE 'kept' END AS reason, count(*) AS n FROM kdiscoveries GROUP BY 1, 2")
query("f7_lexical_coverage", lambda k: k.kchunks.select("page_slug", "chunk_index", F.round(L.lexical_coverage(F.lit("the of"), F.col("content")), 6).alias("coverage")).filter("coverage > 0"),
      # at most three units count only if all stand in one sentence, within five units and 160 characters
      """WITH t AS (SELECT page_slug, chunk_index, unnest(regexp_split_to_array(lower(content), '[.!?。！？;；]')) AS s FROM kchunks), u AS (SELECT page_slug, chunk_index, regexp_extract_all(s, '[a-z0-9]+(?:[-_/][a-z0-9]+)*|[㐀-鿿]') AS w, s FROM t WHERE contains(s, 'the') AND contains(s, 'of'))
         SELECT DISTINCT page_slug, chunk_index, 1e0 AS coverage FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM u) x WHERE list_contains(w[i : i + 4], 'the') AND list_contains(w[i : i + 4], 'of')""")
STATED = """SELECT id, CASE id % 6 WHEN 0 THEN '前言。华东的仓库延误原因是暴雨' || CAST(id AS STRING) || '。后记' WHEN 1 THEN '华东 仓库在延误，原因：停电' || CAST(id AS STRING) WHEN 2 THEN '华东仓库延误原因是暴雨吗？' WHEN 3 THEN '华东仓库延误原因可能是暴雨。' WHEN 4 THEN '仓库华东延误原因是暴雨。' ELSE summary END AS t FROM ktimeline"""
query("f8_cause_evidence", lambda k: k.sql(STATED).select("id", L.cause_evidence(F.lit("华东 仓库 延误 原因"), F.col("t")).alias("evidence")).filter("evidence is not null"),
      rf"SELECT id, evidence FROM (SELECT id, regexp_extract(t, '((?:^|[。！？!?])|)(华东 ?(?:在|的)?仓库(?:在|的)?延误[,，]?原因(?:为|是|在于|包括|[:：])([\p{{Han}}a-z0-9]{{2,64}})(?:。|$))', 2) AS evidence FROM ({STATED}) x) y WHERE evidence <> '' AND NOT regexp_matches(evidence, '[不未无尚待吗么呢]|可能|或许|什么|是否|并非|暂缺|调查中|猜测|否认')")
REPORTED = """SELECT doc_id, '# ' || CASE WHEN doc_id % 9 = 1 THEN '2023年第二季度报告' ELSE '2024年第二季度报告' END || chr(10) || CASE WHEN doc_id % 9 = 2 THEN '以下为草稿' ELSE '正文' END || chr(10) || '| 产品 | Q2销售额 | 固定汇率同比 | 官方披露的主要原因 |' || chr(10) || '| --- | --- | --- | --- |' || chr(10)
  || '| 星河 Pro | ' || CAST(n_chars AS STRING) || ' | ' || CASE WHEN doc_id % 9 = 3 THEN '5%' ELSE '-3.5%' END || ' | ' || CASE WHEN doc_id % 9 = 4 THEN '可能主要受北方竞争影响' ELSE '主要受北方竞争影响' END || ' |' || chr(10) || CASE WHEN doc_id % 9 = 5 THEN '| 星河 Pro | 1 | 2% | 主要受北方竞争影响 |' || chr(10) ELSE '| 别的 X | 1 | 2% | 天气 |' || chr(10) END
  || CASE WHEN doc_id % 9 = 6 THEN '该表已作废' ELSE '完' END || chr(10) || CASE WHEN doc_id % 9 = 7 THEN '# 更正' || chr(10) || '上述报告撤回' ELSE '' END AS t FROM documents"""
query("f9_quarter_evidence", lambda k: k.sql(REPORTED).select("doc_id", L.quarter_evidence(F.lit("星河 Pro 北方 二季度 销售下滑 2024Q2 财报"), F.col("t")).alias("evidence")),
      "SELECT doc_id, CASE WHEN doc_id % 9 IN (0, 8) THEN '# 2024年第二季度报告' || chr(10) || '| 产品 | Q2销售额 | 固定汇率同比 | 官方披露的主要原因 |' || chr(10) || '| 星河 Pro | ' || CAST(n_chars AS VARCHAR) || ' | -3.5% | 主要受北方竞争影响 |' END AS evidence FROM documents")
query("v7_embeddings", lambda k: k.documents.select("doc_id", models.embed(F.col("lang")).alias("v")).select("doc_id", F.size("v").cast("long").alias("width"), F.round(X.norm(F.col("v")), 3).alias("norm")), "SELECT doc_id, CAST(128 AS BIGINT) AS width, 1e0 AS norm FROM documents")





def flagship(k: Knowledge):
    from loomwell.plans.catalog_retrieval import hybrid

    return hybrid(k).select("slug", F.round("score", 6).alias("score"), "hits")
