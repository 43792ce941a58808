"""Hints beside an answer: what is about to expire, what happened nearby, and what results have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions import exprs as X
from loomwell.operators.lineage import stored
from loomwell.operators.relational import first_by, possible

# Prefixes of pages that no hint is about, days ahead and back, events looked at, least score, days until news are old.
JUNK = ("records/", "templates/", "attachments/")
DAYS_AHEAD, DAYS_BACK, EVENTS, LEAST, OLD_DAYS = 30, 30, 5, 0.5, 180


def _junk(slug: Column) -> Column:
    out = F.lit(False)
    for prefix in JUNK:
        out = out | slug.startswith(prefix)
    return out


def hints(results: DataFrame, pages: DataFrame, links: DataFrame, timeline: DataFrame, as_of: str, most: int = 3) -> DataFrame:
    """(query, pos, rule, slug, score, age_days) of results(query, slug), for all queries at once: at most one hint of each rule, those of 0.5 and
    more, best first (then in the order expiry, timeline, shared).

    expiry_alert: a result that has expired or does so within 30 days, the first by date; score 1.
    network_timeline: of the five newest active events of the last 30 days at the results' active neighbours, the newest that is about no
    result and no junk page; score 1 - age / 180 within 0 and 1.
    shared_connection: a neighbour by current facts of two results or more, no result and no junk itself, with the most; score 1 - owners / 10.
    """
    day = F.lit(as_of[:10]).cast("date")
    results = stored(results.select("query", "slug").distinct())
    own = results.join(pages.select("slug", "expires_at"), "slug")
    due = own.filter((F.trim("expires_at") != "") & (F.col("expires_at") <= F.date_add(day, DAYS_AHEAD).cast("string")))
    expiry = first_by(due, ["query"], "expires_at", "slug").select("query", F.lit("expiry_alert").alias("rule"), F.lit(1).alias("place"), "slug", F.lit(1.0).alias("score"), F.lit(None).cast("long").alias("age_days"))
    news = timeline.filter(X.active_link() & (F.col("event_date") >= F.date_sub(day, DAYS_BACK).cast("string"))).join(pages.select(F.col("slug").alias("page_slug")), "page_slug", "left_semi")
    # no more events of a page than are looked at
    news = stored(first_by(news.select("page_slug", "event_date", "id"), ["page_slug"], F.desc("event_date"), F.desc("id"), n=EVENTS))
    # links are read once: the ends that are results, with the other end
    ends = F.explode(F.array(F.struct(F.col("from_slug").alias("slug"), F.col("to_slug").alias("neighbour")), F.struct(F.col("to_slug").alias("slug"), F.col("from_slug").alias("neighbour")))).alias("e")
    near = links.filter(X.active_link()).select(ends, X.current_fact().alias("fact")).select("e.*", "fact").filter("slug IS NOT NULL AND neighbour IS NOT NULL")
    near = stored(possible(near, "slug", results))
    told = possible(near, "neighbour", news.select(F.col("page_slug").alias("slug"))).select("slug", F.col("neighbour").alias("page_slug")).distinct()
    told = told.join(news.select("page_slug").distinct(), "page_slug", "left_semi")
    around = results.join(told, "slug").select("query", "page_slug").distinct()
    around = around.join(results.select("query", F.col("slug").alias("page_slug")), ["query", "page_slug"], "left_anti")
    last = first_by(around.join(news, "page_slug"), ["query"], F.desc("event_date"), F.desc("id"), n=EVENTS)
    new = first_by(last.filter(~_junk(F.col("page_slug"))), ["query"], F.desc("event_date"), F.desc("id"))
    age = F.datediff(day, F.to_date("event_date"))
    recent = new.select("query", F.lit("network_timeline").alias("rule"), F.lit(2).alias("place"), F.col("page_slug").alias("slug"), X.clamp(1 - age / float(OLD_DAYS), 0.0, 1.0).alias("score"), age.cast("long").alias("age_days"))
    # results and neighbours come once each, so their join does; results themselves are marked in the same count
    facts = near.filter(F.col("fact") & ~_junk(F.col("neighbour"))).select("slug", "neighbour").repartition("slug").distinct()
    owned = results.join(facts, "slug").select("query", "neighbour", F.lit(1).alias("owner"))
    owned = owned.unionByName(results.filter("query IS NOT NULL").select("query", F.col("slug").alias("neighbour"), F.lit(None).cast("int").alias("owner")))
    owners = owned.groupBy("query", "neighbour").agg(F.count("owner").alias("owners"), F.count("*").alias("n")).filter("owners >= 2 AND n = owners")
    shared = first_by(owners, ["query"], F.desc("owners"), "neighbour").select("query", F.lit("shared_connection").alias("rule"), F.lit(3).alias("place"), F.col("neighbour").alias("slug"), F.greatest(F.lit(0.0), 1 - F.col("owners") / 10.0).alias("score"), F.lit(None).cast("long").alias("age_days"))
    every = expiry.unionByName(recent).unionByName(shared).filter(F.col("score") >= LEAST)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "place")  # three rows a query
    return every.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= most).select("query", "pos", "rule", "slug", "score", "age_days")
