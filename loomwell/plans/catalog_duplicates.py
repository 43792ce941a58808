"""Queries of the duplicate cascade, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwell.operators import duplicates as D
from loomwell.operators.stewardship import AFFINE_TYPES
from loomwell.plans.adapters import Knowledge
from loomwell.plans.catalog_knowledge import NORM
from loomwell.plans.registry import query

#: Pages with doubles of other spelling or type, and aliases: shared ones, and titles of other pages.
PAGES = """SELECT slug, title, type FROM kpages WHERE type LIKE 'entity/%' OR type LIKE 'concept/%' UNION ALL SELECT 'alt/' || slug, replace(title, '#', CASE WHEN mention_count % 2 = 0 THEN '-' ELSE '-1' END), CASE WHEN mention_count % 3 = 0 THEN 'entity/organization' ELSE type END FROM kpages WHERE type = 'entity/company'
  UNION ALL SELECT 'shadow/' || slug, 'Firm ' || title || ' of old', type FROM kpages WHERE type = 'entity/company' UNION ALL SELECT 'twin/' || slug, upper(title), 'entity/place' FROM kpages WHERE type = 'entity/location'"""
ALIASES = """SELECT page_slug, alias FROM kaliases UNION ALL SELECT 'shadow/' || slug, title FROM kpages WHERE type = 'entity/company' AND mention_count % 2 = 1 UNION ALL SELECT slug, 'Firm ' || title || ' of old' FROM kpages WHERE type = 'entity/company' AND mention_count % 5 = 0
  UNION ALL SELECT 'shadow/' || slug, 'joint ' || title FROM kpages WHERE type = 'entity/company' UNION ALL SELECT slug, 'Joint-' || title FROM kpages WHERE type = 'entity/company'"""


def similar(k: Knowledge):
    return D.similar_pages(k.sql(PAGES), k.sql(ALIASES))


_GATE = " OR ".join(f"(x.type IN ({g}) AND y.type IN ({g}))" for g in (", ".join(f"'{t}'" for t in group) for group in AFFINE_TYPES))
SIMILAR = f"""WITH p AS ({PAGES}), al AS (SELECT page_slug AS slug, alias FROM ({ALIASES}) x WHERE page_slug IN (SELECT slug FROM p)), own AS (SELECT DISTINCT slug, {NORM.format('alias')} AS alias FROM al WHERE {NORM.format('alias')} <> ''),
  named AS (SELECT slug, title FROM p UNION ALL SELECT slug, alias FROM al), words AS (SELECT slug, {NORM.format('title')} AS norm, regexp_extract_all(lower(title), '[a-z0-9]{{2,}}') AS w FROM named),
  keys AS (SELECT slug, norm AS key FROM words WHERE norm <> '' UNION SELECT slug, unnest(w) FROM words UNION SELECT slug, 'acr:' || array_to_string(list_transform(w, lambda x: x[1]), '') FROM words WHERE len(w) >= 2), good AS (SELECT key FROM keys GROUP BY key HAVING count(*) BETWEEN 2 AND 50),
  pairs AS (SELECT DISTINCT a.slug AS a, b.slug AS b, x.title AS ta, y.title AS tb, {NORM.format('x.title')} AS na, {NORM.format('y.title')} AS nb, CASE WHEN x.type = y.type THEN 'same_type' ELSE 'affine_type' END AS gate
    FROM keys a JOIN keys b ON a.key = b.key AND a.slug < b.slug JOIN good g ON g.key = a.key JOIN p x ON x.slug = a.slug JOIN p y ON y.slug = b.slug WHERE x.type = y.type OR {_GATE}),
  m AS (SELECT pairs.*, EXISTS (SELECT 1 FROM own o WHERE o.slug = b AND o.alias = na) AS sa, EXISTS (SELECT 1 FROM own o WHERE o.slug = a AND o.alias = nb) AS sb, EXISTS (SELECT 1 FROM own o JOIN own q ON q.alias = o.alias WHERE o.slug = a AND q.slug = b) AS sh,
    CASE WHEN length(na) <= length(nb) THEN na ELSE nb END AS s, CASE WHEN length(na) <= length(nb) THEN nb ELSE na END AS l, levenshtein(na, nb) AS d FROM pairs),
  k AS (SELECT *, CASE WHEN lower(ta) = lower(tb) THEN 'name_exact' WHEN sa OR sb THEN 'alias_shadow_page' WHEN sh THEN 'shared_alias' WHEN na <> '' AND na = nb THEN 'name_normalized' WHEN length(s) >= 2 AND contains(l, s) AND (length(l) - length(s) >= 3 OR length(s) >= 0.6e0 * length(l)) THEN 'name_substring' WHEN d <= 2 AND na <> '' THEN 'edit_distance' END AS kind FROM m),
  f AS (SELECT a, b, kind, CASE kind WHEN 'name_exact' THEN 1e0 WHEN 'alias_shadow_page' THEN 1e0 WHEN 'shared_alias' THEN 0.85e0 WHEN 'name_normalized' THEN 0.95e0 WHEN 'name_substring' THEN 0.6e0 + 0.3e0 * length(s) / length(l) ELSE greatest(1 - d / CAST(greatest(length(na), length(nb)) AS DOUBLE), 0.5e0) END AS score, gate,
    CASE WHEN kind = 'alias_shadow_page' OR (gate = 'same_type' AND kind <> 'edit_distance') THEN 'high' ELSE 'medium' END AS actionable, kind || ':' || gate AS reason, CASE WHEN kind = 'alias_shadow_page' THEN CASE WHEN sa AND sb THEN 'both' WHEN sa THEN 'aToB' ELSE 'bToA' END END AS direction FROM k WHERE kind IS NOT NULL)"""
query("e4_cascade", lambda k: similar(k).withColumn("score", F.round("score", 6)), f"{SIMILAR} SELECT a, b, kind, round(score, 6) AS score, gate, actionable, reason, direction FROM f")
query("e7_reasons", lambda k: similar(k).groupBy("actionable", "reason").agg(F.count("*").alias("n")), f"{SIMILAR} SELECT actionable, reason, count(*) AS n FROM f GROUP BY 1, 2")
query("o7_best_candidates", lambda k: D.best_candidates(similar(k)).select("a", "b", "reason"), f"{SIMILAR} SELECT a, b, reason FROM f ORDER BY CASE actionable WHEN 'high' THEN 0 ELSE 1 END, round(score, 9) DESC, CASE gate WHEN 'same_type' THEN 0 ELSE 1 END, a, b LIMIT 100")
