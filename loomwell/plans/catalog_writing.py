"""Queries of direct knowledge writes, with oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomwell.operators.lineage import shared_folder
from loomwell.operators.writing import KnowledgeStore
from loomwell.plans.adapters import Knowledge
from loomwell.plans.registry import query

#: A request for each order: about customers by slug or name, or persons that the batch itself makes, in several spellings.
PLAIN = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'entity/person/c-' || CAST(o_custkey AS STRING) WHEN o_orderkey % 4 = 1 THEN c_name WHEN o_orderkey % 4 = 2 THEN 'Fresh Person ' || CAST(o_custkey % 50 + 100 AS STRING) ELSE 'fresh-PERSON ' || CAST(o_custkey % 50 + 100 AS STRING) END AS subject,
  CASE WHEN o_orderkey % 7 = 0 THEN 'title' ELSE 'priority' END AS field, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE o_orderpriority END AS value, CASE WHEN o_orderkey % 3 = 0 THEN 'NATION_' || CAST(c_nationkey AS STRING) ELSE 'Fresh Person ' || CAST((o_custkey + 1) % 50 + 100 AS STRING) END AS target,
  CASE WHEN o_orderkey % 5 = 0 THEN 'unheard of' ELSE 'knows' END AS relation, CASE WHEN o_orderkey % 6 = 1 THEN 'Fresh Person 107' END AS reports_to, CASE o_orderkey % 9 WHEN 0 THEN ' ' WHEN 1 THEN 'seen' END AS note FROM orders JOIN customer ON c_custkey = o_custkey"""
REQUESTS = """SELECT id, subject, 'person' AS subject_type, array(named_struct('field', field, 'value', value)) AS facts, array(named_struct('target', target, 'target_type', 'person', 'relation', relation)) AS relations, reports_to, 'person' AS reports_to_type, note, 'order' AS evidence, 'agent' AS source_type FROM ({0}) x WHERE {1}"""
ONE, TWO = "id % 8 <> 0", "id % 8 = 0"


def store(k: Knowledge) -> KnowledgeStore:
    out = KnowledgeStore(k.spark, f"{shared_folder(k.spark)}/loomwell-knowledge-{uuid.uuid4().hex[:12]}")
    for batch, where in (("one", ONE), ("one", ONE), ("two", TWO)):  # the first twice
        out.write(k.sql(REQUESTS.format(PLAIN, where)), batch, k.kpages, k.kaliases)
    return out


#: Every name leads to a page of its own in these data, so resolution is a rule of spelling here.
_SLUG = "CASE WHEN {0} LIKE 'entity/%' THEN {0} WHEN {0} LIKE 'Customer#%' THEN 'entity/person/c-' || CAST(CAST(substr({0}, 10) AS BIGINT) AS VARCHAR) WHEN {0} LIKE 'NATION%' THEN 'entity/location/n-' || substr({0}, 8) ELSE 'entity/person/fresh-person-' || split_part({0}, ' ', length({0}) - length(replace({0}, ' ', '')) + 1) END"
WRITTEN = f"""WITH r AS (SELECT *, {_SLUG.format('subject')} AS own, {_SLUG.format('target')} AS to_slug, CASE WHEN {ONE} THEN 1 ELSE 2 END AS batch FROM ({PLAIN}) x),
  ok AS (SELECT *, field <> 'title' AND trim(value) <> '' AS f_ok, relation = 'knows' AND to_slug <> own AS l_ok, reports_to IS NOT NULL AS m, reports_to IS NOT NULL AND own <> 'entity/person/fresh-person-107' AS m_ok, note IS NOT NULL AS n, coalesce(trim(note), '') <> '' AS n_ok FROM r),
  stub AS (SELECT batch, slug FROM (SELECT batch, own AS slug FROM r UNION SELECT batch, to_slug FROM r UNION SELECT batch, 'entity/person/fresh-person-107' FROM r WHERE reports_to IS NOT NULL) x WHERE slug LIKE 'entity/person/fresh%' QUALIFY row_number() OVER (PARTITION BY slug ORDER BY batch) = 1)"""
query("n11_receipts", lambda k: store(k).table("receipts").select("id", "slug", "action", "total", "succeeded", "failed", "stubs"),
      f"""{WRITTEN}, s AS (SELECT ok.id, count(DISTINCT stub.slug) AS stubs FROM ok JOIN stub ON stub.batch = ok.batch AND (stub.slug = own OR stub.slug = to_slug OR (m AND stub.slug = 'entity/person/fresh-person-107')) GROUP BY 1)
          SELECT ok.id, own AS slug, CASE WHEN own IN (SELECT slug FROM stub WHERE stub.batch = ok.batch) THEN 'stub_created' ELSE 'resolved' END AS action, CAST(2 + CAST(m AS INT) + CAST(n AS INT) AS BIGINT) AS total, CAST(CAST(f_ok AS INT) + CAST(l_ok AS INT) + CAST(m_ok AS INT) + CAST(n_ok AS INT) AS BIGINT) AS succeeded,
          CAST(2 + CAST(m AS INT) + CAST(n AS INT) - CAST(f_ok AS INT) - CAST(l_ok AS INT) - CAST(m_ok AS INT) - CAST(n_ok AS INT) AS BIGINT) AS failed, coalesce(stubs, 0) AS stubs FROM ok LEFT JOIN s ON s.id = ok.id""")
query("n11_written_tables", lambda k: (lambda s: s.table("facts").select(F.lit("facts").alias("name"), "slug", F.col("value").alias("what")).unionByName(s.table("links").select(F.lit("links").alias("name"), F.col("from_slug").alias("slug"), F.concat_ws(">", "relation", "to_slug").alias("what")))
      .unionByName(s.table("pages").select(F.lit("pages").alias("name"), "slug", F.col("type").alias("what"))).unionByName(s.table("notes").groupBy("slug").agg(F.count("*").cast("string").alias("what")).select(F.lit("notes").alias("name"), "slug", "what")))(store(k)),
      f"""{WRITTEN} SELECT 'facts' AS name, own AS slug, value AS what FROM ok WHERE f_ok QUALIFY row_number() OVER (PARTITION BY own ORDER BY batch DESC, id DESC) = 1 UNION ALL SELECT DISTINCT 'links', own, '认识>' || to_slug FROM ok WHERE l_ok
          UNION ALL SELECT DISTINCT 'links', own, 'reports_to>entity/person/fresh-person-107' FROM ok WHERE m_ok UNION ALL SELECT 'pages', slug, 'entity/person' FROM stub UNION ALL SELECT 'notes', own, CAST(count(*) AS VARCHAR) FROM ok WHERE n_ok GROUP BY own""")
