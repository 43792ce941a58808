"""Knowledge tables derived from the driver tables.

Each table is one SQL text that Spark and DuckDB both run, so queries and their oracles start from the same rows.
``$K`` stands for the integer at ``$.k`` of the JSON column ``props``; ``$LINES(x)`` for an array of the lines of x;
``$EXPLODE(array)`` for a table function over (position from 0, element).
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.operators.lineage import content_mark, kept, kept_folder
from loomwell.operators.textindex import TextIndex

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
ORDER_AS_OF = "2001-08-02 00:00:00"
EVENT_AS_OF = "2024-01-31 00:00:00"

TABLES: dict[str, str] = {}

TABLES["kpages"] = """
SELECT slug, type, title, slug || '.md' AS file_path, md5(title) AS content_hash, mention_count,
  CAST(CASE WHEN mention_count >= 10 THEN 1 WHEN mention_count >= 3 THEN 2 ELSE 3 END AS INT) AS tier,
  activity_weight, hotness_score, expires_at, confidence_decay, created_at, updated_at
FROM (
  SELECT 'entity/person/c-' || CAST(c_custkey AS STRING) AS slug, 'entity/person' AS type, c_name AS title, CAST(coalesce(n, 0) AS INT) AS mention_count,
    (c_acctbal + 1000e0) / 11000e0 AS activity_weight, CAST(c_custkey % 100 AS DOUBLE) / 100e0 AS hotness_score,
    CASE WHEN c_custkey % 17 = 0 THEN '1998-06-01' WHEN c_custkey % 19 = 0 THEN ' ' END AS expires_at, CAST(c_custkey % 10 AS DOUBLE) / 10e0 AS confidence_decay,
    coalesce(first_at, TIMESTAMP '1995-01-01 00:00:00') AS created_at, coalesce(last_at, TIMESTAMP '1995-01-01 00:00:00') AS updated_at
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, CAST(min(o_orderdate) AS TIMESTAMP) AS first_at, CAST(max(o_orderdate) AS TIMESTAMP) AS last_at FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey
  UNION ALL
  SELECT 'entity/company/s-' || CAST(s_suppkey AS STRING), 'entity/company', s_name, CAST(coalesce(n, 0) AS INT), (s_acctbal + 1000e0) / 11000e0, CAST(s_suppkey % 100 AS DOUBLE) / 100e0,
    NULL, 1e0, TIMESTAMP '1995-01-01 00:00:00', coalesce(last_at, TIMESTAMP '1995-01-01 00:00:00')
  FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, CAST(max(l_shipdate) AS TIMESTAMP) AS last_at FROM lineitem GROUP BY l_suppkey) l ON l_suppkey = s_suppkey
  UNION ALL
  SELECT 'concept/product/p-' || CAST(p_partkey AS STRING), 'concept/product', p_name, CAST(p_partkey % 40 AS INT), CAST(p_size AS DOUBLE) / 50e0, 0e0,
    CASE WHEN p_partkey % 23 = 0 THEN '2002-01-01' END, 1e0, TIMESTAMP '1996-01-01 00:00:00', TIMESTAMP '1996-01-01 00:00:00'
  FROM part
  UNION ALL
  SELECT 'entity/location/n-' || CAST(n_nationkey AS STRING), 'entity/location', n_name, CAST(n_nationkey AS INT), 0e0, 0e0, NULL, 1e0, TIMESTAMP '1995-01-01 00:00:00', TIMESTAMP '1995-01-01 00:00:00' FROM nation
  UNION ALL
  SELECT 'entity/location/r-' || CAST(r_regionkey AS STRING), 'entity/location', r_name, 0, 0e0, 0e0, NULL, 1e0, TIMESTAMP '1995-01-01 00:00:00', TIMESTAMP '1995-01-01 00:00:00' FROM region
  UNION ALL
  SELECT 'records/doc-' || CAST(doc_id AS STRING), CASE WHEN doc_id % 29 = 0 THEN '' ELSE 'record' END, CASE WHEN doc_id % 31 = 0 THEN ' ' ELSE 'doc ' || CAST(doc_id AS STRING) END, CAST(doc_id % 3 AS INT), 0e0, 0e0, NULL, 1e0,
    TIMESTAMP '2001-07-01 00:00:00', TIMESTAMP '2001-07-15 00:00:00' FROM documents
  UNION ALL
  SELECT 'concept/method/m-' || CAST(doc_id AS STRING), 'concept/method', 'method ' || CAST(doc_id AS STRING), CAST(CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS INT), 0e0, 0e0, NULL, 1e0,
    TIMESTAMP '2001-07-01 00:00:00', TIMESTAMP '2001-07-15 00:00:00' FROM documents WHERE doc_id % 3 = 0
) p
"""

TABLES["klinks"] = """
SELECT from_slug, to_slug, relation, weight, CASE WHEN weight >= 0.8e0 THEN 'strong' WHEN weight >= 0.5e0 THEN 'medium' ELSE 'weak' END AS strength,
  source_type, confidence, trust_state, created_at, last_validated_at, from_slug || '>' || relation || '>' || to_slug AS link_key
FROM (
  SELECT 'entity/person/c-' || CAST(o_custkey AS STRING) AS from_slug, 'concept/product/p-' || CAST(l_partkey AS STRING) AS to_slug, 'uses' AS relation, least(1e0, sum(l_quantity) / 50e0) AS weight,
    CASE WHEN max(l_linestatus) = 'O' THEN 'manual' ELSE 'ner' END AS source_type, least(1e0, CAST(count(*) AS DOUBLE) / 2e0) AS confidence,
    CASE max(l_returnflag) WHEN 'N' THEN 'trusted' WHEN 'A' THEN 'candidate' ELSE 'rejected' END AS trust_state, CAST(min(l_shipdate) AS TIMESTAMP) AS created_at, CAST(max(l_shipdate) AS TIMESTAMP) AS last_validated_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey
  UNION ALL
  SELECT 'entity/company/s-' || CAST(l_suppkey AS STRING), 'concept/product/p-' || CAST(l_partkey AS STRING), 'produces', least(1e0, sum(l_quantity) / 50e0), CASE WHEN max(l_linestatus) = 'O' THEN 'wikilink' ELSE 'auto' END,
    least(1e0, CAST(count(*) AS DOUBLE) / 2e0), CASE max(l_returnflag) WHEN 'N' THEN 'trusted' WHEN 'R' THEN 'superseded' END, CAST(min(l_shipdate) AS TIMESTAMP), CAST(max(l_shipdate) AS TIMESTAMP)
  FROM lineitem GROUP BY l_suppkey, l_partkey
  UNION ALL
  SELECT 'entity/person/c-' || CAST(c_custkey AS STRING), 'entity/location/n-' || CAST(c_nationkey AS STRING), 'located_in', 0.5e0, 'manual', 1e0, 'trusted', TIMESTAMP '1995-01-01 00:00:00', TIMESTAMP '1995-01-01 00:00:00' FROM customer WHERE c_custkey % 5 < 3
  UNION ALL
  SELECT 'entity/company/s-' || CAST(s_suppkey AS STRING), 'entity/location/n-' || CAST(s_nationkey AS STRING), 'located_in', 0.5e0, 'wikilink', 0.9e0, 'user_thought', TIMESTAMP '1995-01-01 00:00:00', TIMESTAMP '2001-07-31 00:00:00' FROM supplier
  UNION ALL
  SELECT 'entity/location/n-' || CAST(n_nationkey AS STRING), 'entity/location/r-' || CAST(n_regionkey AS STRING), 'part_of', 1e0, 'manual', 1e0, NULL, TIMESTAMP '1995-01-01 00:00:00', TIMESTAMP '1995-01-01 00:00:00' FROM nation
  UNION ALL
  SELECT 'entity/person/c-' || CAST(c_custkey AS STRING), 'entity/person/c-' || CAST(CAST(floor(c_custkey / 8e0) AS BIGINT) AS STRING), 'reports_to', 1e0, 'dialogue', 0.7e0,
    CASE WHEN c_custkey % 7 = 0 THEN 'candidate' WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'superseded' ELSE 'trusted' END, TIMESTAMP '1995-01-01 00:00:00', TIMESTAMP '2000-01-01 00:00:00' FROM customer
  UNION ALL
  SELECT 'records/doc-' || CAST(doc_id AS STRING), 'entity/person/c-' || CAST(doc_id * 3 AS STRING), 'mentions', 0.3e0, 'wikilink', 0.5e0, 'trusted', TIMESTAMP '2001-07-01 00:00:00', TIMESTAMP '2001-07-01 00:00:00' FROM documents WHERE doc_id % 4 = 0
) l
"""

TABLES["ktimeline"] = """
SELECT event_id AS id, 'entity/person/c-' || CAST(user_id AS STRING) AS page_slug,
  CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 51 = 0 THEN '2023-02-29' WHEN event_id % 52 = 0 THEN '2024' WHEN event_id % 53 = 0 THEN '2024-01' ELSE CAST(CAST(ts AS DATE) AS STRING) END AS event_date,
  'log' AS source, event_type || ' item ' || CAST($K AS STRING) AS summary,
  CASE event_type WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'candidate' WHEN 'click' THEN NULL WHEN 'signup' THEN 'user_thought' ELSE 'trusted' END AS trust_state, CAST(ts AS TIMESTAMP) AS created_at
FROM events
"""

TABLES["kqlog"] = """
SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'query' WHEN 'view' THEN 'recall' WHEN 'purchase' THEN 'expand' WHEN 'signup' THEN 'graph' ELSE 'other' END AS tool, 'q' || CAST($K AS STRING) AS query,
  'u' || CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS session_id, CAST(ts AS TIMESTAMP) AS created_at, CAST(floor(value * 10) AS INT) AS latency_ms, CAST(user_id AS INT) AS user_id, CAST($K AS INT) AS k
FROM events
"""

#: The result list of each logged query, one row a position.
TABLES["khits"] = """
SELECT id, tool, session_id, created_at, 1 AS pos, 'concept/product/p-' || CAST(k * 10 AS STRING) AS slug FROM kqlog WHERE tool <> 'other'
UNION ALL
SELECT id, tool, session_id, created_at, 2 AS pos, 'entity/person/c-' || CAST(user_id AS STRING) AS slug FROM kqlog WHERE tool <> 'other' AND k % 2 = 0
"""

TABLES["kfeedback"] = """
SELECT id, 'concept/product/p-' || CAST(k * 10 AS STRING) AS slug, CASE WHEN tool = 'expand' THEN 'relevant' WHEN tool = 'other' THEN 'irrelevant' WHEN k % 3 = 0 THEN 'corrected' ELSE 'expanded' END AS signal, created_at
FROM kqlog WHERE id % 3 = 0
"""

#: reason: the single reason code of a search, if any.
TABLES["ksearch"] = """
SELECT id, tool AS strategy, latency_ms, CAST(k % 5 AS INT) AS hit_count, CAST(CASE WHEN tool = 'other' THEN 1 ELSE 0 END AS INT) AS degraded,
  CASE WHEN latency_ms > 2000 THEN 'latency_warning' WHEN k % 10 = 1 THEN 'parser_fallback' WHEN k % 10 = 2 THEN 'rerank_skipped' WHEN k % 10 = 3 THEN 'hierarchy_mismatch' END AS reason, created_at, session_id, query
FROM kqlog
"""

TABLES["ksnapshots"] = """
SELECT 'concept/product/p-' || CAST(k * 10 AS STRING) AS slug, CAST(created_at AS DATE) AS snapshot_date, CAST(count(*) AS INT) AS mention_count FROM kqlog GROUP BY k, CAST(created_at AS DATE)
"""

TABLES["kchunks"] = """
SELECT 'records/doc-' || CAST(doc_id AS STRING) AS page_slug, CAST(pos AS INT) AS chunk_index, CAST(CASE WHEN pos = 0 AND doc_id % 5 = 0 THEN 1 ELSE 0 END AS INT) AS summary_level, line AS content
FROM $LINES WHERE doc_id % 37 <> 0
"""

TABLES["ktags"] = """
SELECT 'records/doc-' || CAST(doc_id AS STRING) AS page_slug, lang AS tag FROM documents WHERE lang IS NOT NULL
UNION SELECT 'records/doc-' || CAST(doc_id AS STRING), source FROM documents WHERE source IS NOT NULL
UNION SELECT 'records/doc-' || CAST(doc_id AS STRING), CASE WHEN quality = 1 THEN 'auto-extracted' ELSE 'low-quality' END FROM labels
UNION SELECT 'entity/person/c-' || CAST(c_custkey AS STRING), c_mktsegment FROM customer WHERE c_custkey % 6 = 0
"""

TABLES["kaliases"] = """
SELECT c_custkey AS id, 'entity/person/c-' || CAST(c_custkey AS STRING) AS page_slug, 'cust ' || CAST(c_custkey % 500 AS STRING) AS alias FROM customer WHERE c_custkey % 3 = 0
UNION ALL
SELECT 1000000000 + s_suppkey, 'entity/company/s-' || CAST(s_suppkey AS STRING), 'cust ' || CAST(s_suppkey AS STRING) FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL
SELECT 2000000000 + p_partkey, 'concept/product/p-' || CAST(p_partkey AS STRING), lower(p_brand) || ' ' || CAST(p_size AS STRING) FROM part WHERE p_partkey % 50 = 0
"""

TABLES["kvectors"] = """
SELECT 'records/doc-' || CAST(CAST(floor(vec_id / 2e0) AS BIGINT) AS STRING) AS page_slug, CAST(CASE WHEN vec_id % 10 = 1 THEN -1 ELSE vec_id % 2 END AS INT) AS chunk_index, vec_id, embedding AS vector FROM embeddings
"""

#: Customer state before and after a cut date.
TABLES["ksnap_old"] = """
SELECT 'entity/person/c-' || CAST(o_custkey AS STRING) AS slug, md5(CAST(count(*) AS STRING)) AS content_hash, CAST(CASE WHEN count(*) >= 10 THEN 1 WHEN count(*) >= 3 THEN 2 ELSE 3 END AS INT) AS tier,
  CAST(count(*) AS INT) AS mention_count, CAST(count(DISTINCT o_orderpriority) AS INT) AS link_count, CAST(o_custkey % 7 AS DOUBLE) / 7e0 AS confidence_decay FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01 00:00:00' GROUP BY o_custkey
"""
TABLES["ksnap_new"] = """
SELECT 'entity/person/c-' || CAST(o_custkey AS STRING) AS slug, md5(CAST(count(*) AS STRING)) AS content_hash, CAST(CASE WHEN count(*) >= 10 THEN 1 WHEN count(*) >= 3 THEN 2 ELSE 3 END AS INT) AS tier,
  CAST(count(*) AS INT) AS mention_count, CAST(count(DISTINCT o_orderpriority) AS INT) AS link_count, CAST(o_custkey % 5 AS DOUBLE) / 7e0 AS confidence_decay FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01 00:00:00' GROUP BY o_custkey
"""

#: Discoveries detected so far: pairs of persons of one nation.
TABLES["kdiscoveries"] = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'gap' WHEN o_orderkey % 5 = 1 THEN 'bridge' WHEN o_orderkey % 5 = 2 THEN 'trend' ELSE 'proactive_connection' END AS type,
  'entity/person/c-' || CAST(o_custkey AS STRING) AS entity_a, 'entity/person/c-' || CAST((o_custkey * 7) % 300 AS STRING) AS entity_b, o_totalprice / 500000e0 AS score, CAST(o_orderdate AS TIMESTAMP) AS detected_at,
  CAST(o_orderkey % 4 AS INT) AS occurrence_count, CASE WHEN o_orderkey % 11 = 0 THEN 'dismissed' WHEN o_orderkey % 13 = 0 THEN 'resolved' WHEN o_orderkey % 3 = 0 THEN 'seen' ELSE 'pending' END AS status,
  CAST(CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS INT) AS seen, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 150000 THEN 'medium' ELSE 'low' END AS actionable
FROM orders
"""

#: The table that nearly all queries read, kept by the session instead of derived each time. Links are derived where they are read: a query takes
#: a few of their columns and often one relation, and filters on relation or ends reach the raw tables, while all of them, sorted, are several
#: times the input. What reads links in rounds cuts its own edges first.
STORED = ("kpages",)

_DUCK_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) d"
_SPARK_LINES = "(SELECT doc_id, pos, line FROM documents LATERAL VIEW posexplode(split(text, '\\\\n', -1)) x AS pos, line) d"


def spark_text(sql: str) -> str:
    return sql.replace("$K", "CAST(get_json_object(props, '$.k') AS INT)").replace("$LINES", _SPARK_LINES)


def duck_text(sql: str) -> str:
    return sql.replace("$K", "CAST(json_extract_string(props, '$.k') AS INT)").replace("$LINES", _DUCK_LINES)


def needs(sql: str) -> list[str]:
    """The knowledge tables that a text uses, dependencies first."""
    out: list[str] = []

    def add(text: str) -> None:
        for name in TABLES:
            if name not in out and re.search(rf"\b{name}\b", text):
                add(TABLES[name])
                if name not in out:
                    out.append(name)

    add(sql)
    return out


def oracle(body: str) -> str:
    """A DuckDB query over the raw tables: the body with the knowledge tables it uses as common table expressions."""
    body = body.strip()
    ctes = ", ".join(f"{n} AS ({duck_text(TABLES[n]).strip()})" for n in needs(body))
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        rest = body[5:]
        return f"WITH RECURSIVE {ctes}, {rest.removeprefix('RECURSIVE ')}"
    return f"WITH {ctes} {body}"


class Knowledge:
    """The tables of one folder, as frames: ``k.kpages``, ``k.orders``, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in RAW:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name in STORED:
            # sorted by slug, so that reads of a page skip the other row groups
            df = kept(self.spark, f"{name}-{self._mark}", lambda: (lambda t: t.repartitionByRange(t.columns[0]).sortWithinPartitions(t.columns[0]))(self.sql(TABLES[name])))
        elif name in TABLES:
            df = self.sql(TABLES[name])
        else:
            raise AttributeError(name)
        self.__dict__[name] = df
        return df

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Run SQL over raw and knowledge tables by name."""
        text = spark_text(text)
        used = {n: getattr(self, n) for n in (*RAW, *TABLES) if n not in frames and re.search(rf"\b{n}\b", text)} | frames
        text = text.replace("{", "{{").replace("}", "}}")
        for n in used:
            text = re.sub(rf"(\b(?:FROM|JOIN)\s+){n}\b", rf"\1{{{n}}}", text)
        used = {n: df for n, df in used.items() if "{" + n + "}" in text}
        return self.spark.sql(text, **used) if used else self.spark.sql(text.replace("{{", "{").replace("}}", "}"))

    @cached_property
    def _mark(self) -> str:
        return content_mark(self.spark, [f"{self.sf_dir}/{name}.parquet" for name in RAW])

    @cached_property
    def text_index(self) -> TextIndex:
        """The trigram index of all chunks, built when the session first searches."""
        return TextIndex(self.spark, kept_folder(self.spark, f"textindex-{self._mark}", lambda path: TextIndex.build(self.kchunks, path)))

    @cached_property
    def as_of_orders(self) -> str:
        return ORDER_AS_OF
