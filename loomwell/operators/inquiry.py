"""Planned research over tables: the steps that a question needs, what they find, whether that is enough, and what to try next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.functions import exprs as X
from loomwell.operators.relational import first_by

# Intents in order of precedence with their words; else a question looks up an entity.
INTENTS = [
    ("comparison", ["比较", "对比", "区别", "哪个好", "vs", "VS"]), ("gap_analysis", ["还", "有没有", "缺什么", "不足", "盲区", "遗漏", "不知道"]), ("review", ["复盘", "总结", "回顾", "变化", "进展"]),
    ("timeline", ["最近", "什么时候", "上次", "下周", "上周", "这周", "时间线"]), ("relationship", ["关系", "联系", "之间", "关联"]),
]
# The steps of each intent: kind, and how much of it.
STEPS = {
    "entity_lookup": [("resolve", None), ("page", "normal")],
    "relationship": [("resolve", None), ("graph", "traverse"), ("page", "normal")],
    "timeline": [("resolve", None), ("timeline", None), ("page", "brief")],
    "comparison": [("resolve", None), ("graph", "neighbors"), ("page", "normal"), ("chunks", "brief")],
    "review": [("resolve", None), ("timeline", None), ("page", "full"), ("chunks", "normal")],
    "gap_analysis": [("resolve", None), ("graph", "neighbors"), ("chunks", "brief"), ("page", "brief")],
}
# Budgets.
MOST_SEARCHES, MOST_FOLLOW_UPS = 8, 3


def intent_of(query: Column) -> Column:
    out = None
    for name, words in INTENTS:
        hit = F.lit(False)
        for w in words:
            hit = hit | query.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("entity_lookup")


def plan(questions: DataFrame) -> DataFrame:
    """(id, query, intent, step, kind, detail) of questions (id, query), as their intents ask."""
    dim = [(i, k, kind, detail) for i, steps in STEPS.items() for k, (kind, detail) in enumerate(steps)]
    steps = questions.sparkSession.createDataFrame(dim, "intent string, step int, kind string, detail string")
    return questions.select("id", "query", intent_of(F.col("query")).alias("intent")).join(F.broadcast(steps), "intent")


def execute(steps: DataFrame, resolved: DataFrame, pages: DataFrame, chunks: DataFrame, links: DataFrame, timeline: DataFrame) -> DataFrame:
    """What each step but the resolution finds for the pages that a question names (resolved: id, slug): (id, kind, slug, found)."""
    use = links.filter(X.current_fact())
    near = use.select(F.explode(F.array_distinct(F.array("from_slug", "to_slug"))).alias("slug")).groupBy("slug").agg(F.count("*").alias("found"))
    rows = lambda t, key: t.groupBy(F.col(key).alias("slug")).agg(F.count("*").alias("found"))
    each = {"graph": near, "page": rows(pages, "slug"), "chunks": rows(chunks, "page_slug"), "timeline": rows(timeline.filter(X.active_link()), "page_slug")}
    out = None
    for kind, found in each.items():
        part = steps.filter(F.col("kind") == kind).select("id", "kind").distinct().join(resolved.distinct(), "id").join(found, "slug").select("id", "kind", "slug", "found")
        out = part if out is None else out.unionByName(part)
    return out


def judge(questions: DataFrame, steps: DataFrame, found: DataFrame, resolved: DataFrame, links: DataFrame, timeline: DataFrame) -> DataFrame:
    """Whether each question has enough evidence: (id, intent, sufficient, confidence, missing, facts, sources). Trusted links and events of
    its pages are facts; a comparison needs two pages with evidence, a relationship links, a timeline events."""
    trusted = F.col("trust_state") == "trusted"
    own = links.filter(X.current_fact() & trusted).select(F.explode(F.array_distinct(F.array("from_slug", "to_slug"))).alias("slug")).unionByName(timeline.filter(trusted).select(F.col("page_slug").alias("slug")))
    facts = resolved.distinct().join(own.groupBy("slug").agg(F.count("*").alias("n")), "slug").groupBy("id").agg(F.sum("n").alias("facts"))
    fact_pages = resolved.distinct().join(own.distinct(), "slug", "left_semi")
    sources = found.filter("kind <> 'timeline'").select("id", "slug").unionByName(fact_pages.select("id", "slug")).distinct().groupBy("id").agg(F.count("*").alias("sources"))
    has = found.groupBy("id").agg(*[F.sum(F.when(F.col("kind") == k, F.col("found")).otherwise(0)).alias(k) for k in ("graph", "page", "chunks", "timeline")])
    empty = steps.filter("kind <> 'resolve'").select("id", "kind").distinct().join(found.select("id", "kind").distinct(), ["id", "kind"], "left_anti").groupBy("id").agg(F.count("*").alias("gaps"))
    q = steps.select("id", "intent").distinct()
    for t in (has, facts, sources, empty):
        q = q.join(t, "id", "left")
    q = q.fillna(0)
    enough = (
        F.when(F.col("intent") == "relationship", F.col("graph") > 0).when(F.col("intent") == "timeline", F.col("timeline") > 0).when(F.col("intent") == "comparison", F.col("sources") >= 2)
        .when(F.col("intent") == "gap_analysis", (F.col("gaps") > 0) | (F.col("facts") > 0)).otherwise((F.col("facts") > 0) | (F.col("page") + F.col("chunks") > 0))
    )
    missing = F.when(~enough, F.when(F.col("intent").isin("relationship", "timeline", "comparison"), F.col("intent")).when(F.col("intent") == "gap_analysis", "evidence").otherwise("entity"))
    level = F.when(~enough, "low").when(F.col("facts") > 0, "high").otherwise("medium")
    return q.select("id", "intent", enough.cast("int").alias("sufficient"), level.alias("confidence"), missing.alias("missing"), "facts", "sources")


def follow_ups(judged: DataFrame, steps: DataFrame, resolved: DataFrame) -> DataFrame:
    """Further steps (id, kind, target, rank) for questions that lack something, which were not tried: of their pages, in order; a plain
    search last; three at most."""
    dim = [("relationship", 0, "graph-neighbors"), ("relationship", 1, "graph-traverse"), ("timeline", 0, "timeline"), ("comparison", 0, "page"), ("comparison", 1, "chunks"), ("entity", 0, "page"), ("entity", 1, "chunks")]
    more = judged.sparkSession.createDataFrame(dim, "missing string, place int, kind string")
    open_ = judged.filter("sufficient = 0").select("id", "missing")
    tried = steps.select("id", F.when(F.col("kind") == "graph", F.concat(F.lit("graph-"), "detail")).otherwise(F.col("kind")).alias("kind")).distinct()
    # neighbours add nothing to a traversal
    tried = tried.unionByName(tried.filter("kind = 'graph-traverse'").withColumn("kind", F.lit("graph-neighbors"))).distinct()
    on = open_.join(F.broadcast(more), "missing").join(tried, ["id", "kind"], "left_anti").join(resolved.distinct(), "id").select("id", "kind", F.col("slug").alias("target"), "place")
    plain = open_.select("id", F.lit("search").alias("kind"), F.lit(None).cast("string").alias("target"), F.lit(9).alias("place"))
    return first_by(on.unionByName(plain), ["id"], "place", "target", n=MOST_FOLLOW_UPS).select("id", "kind", "target")


def research(search: Callable[[str], DataFrame], follow_up: Callable[[DataFrame], list[str]], query: str, rounds: int = 3, per_round: int = 3) -> DataFrame:
    """Multi-step retrieval: search, derive further queries from the hits, search those; each query once, in any case and spacing, at most
    ``per_round`` a round. Hits carry the query and the round."""
    done: set[str] = set()
    todo, out = [query], None
    for k in range(rounds):
        fresh = []
        for q in todo:
            key = " ".join(q.lower().split())
            if key and key not in done and len(fresh) < (per_round if k else 1):
                done.add(key)
                fresh.append(q)
        if not fresh:
            break
        hits = None
        for q in fresh:
            h = search(q).withColumn("query", F.lit(q)).withColumn("round", F.lit(k))
            hits = h if hits is None else hits.unionByName(h)
        out = hits if out is None else out.unionByName(hits)
        todo = follow_up(hits)
    return out
