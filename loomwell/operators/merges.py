"""Whole merges of state: review candidates, insights, pages and discoveries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.functions import exprs as X
from loomwell.operators.relational import numbered

# What is promoted to an action, what never is, and what has a form to be shown in.
HIGH_VALUE = ("similar_entity", "knowledge_map_isolation", "knowledge_map_bridge", "contradiction")
QUIET = ("proactive_connection",)
SHOWN = ("bridge", "trend", "gap", "contradiction", "knowledge_map_isolation", "knowledge_map_bridge", "similar_entity")
OPEN_STATES = ("pending", "deferred")
LEAST_SCORE, REPEATS = 0.1, 3


# ---- review candidates ----

def candidate_upsert(existing: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """existing(id, content_hash, title, status, last_seen_at, updated_at) after new(seq, content_hash, title): a known hash refreshes its
    row's times while that is open and never changes its status or title; an unknown one is inserted once, pending, with the next ids in
    the order in which hashes first came."""
    first = new.groupBy("content_hash").agg(F.min("seq").alias("seq"), F.min_by("title", "seq").alias("title"))
    seen = existing.join(first.select("content_hash", F.lit(True).alias("again")), "content_hash", "left")
    fresh = F.coalesce(F.col("again"), F.lit(False)) & F.col("status").isin(*OPEN_STATES)
    time = lambda c: F.when(fresh, X.ts(now)).otherwise(F.col(c)).alias(c)
    kept = seen.select("id", "content_hash", "title", "status", time("last_seen_at"), time("updated_at"))
    added = numbered(first.join(existing.select("content_hash"), "content_hash", "left_anti"), "seq", name="pos")
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    added = added.crossJoin(F.broadcast(last))  # one row
    return kept.unionByName(added.select((F.col("last") + F.col("pos")).cast("long").alias("id"), "content_hash", "title", F.lit("pending").alias("status"), X.ts(now).alias("last_seen_at"), X.ts(now).alias("updated_at")))


def candidate_moves(candidates: DataFrame, moves: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """candidates after moves(seq, id, action, note), and the feedback rows (candidate_id, action, note, seq) of those that exist. The last
    move of a candidate says its status."""
    states = {"accept": "accepted", "reject": "rejected", "defer": "deferred", "reopen": "pending"}
    known = moves.join(candidates.select("id"), "id", "left_semi").filter(F.col("action").isin(*states))
    last = known.groupBy("id").agg(F.max_by("action", "seq").alias("action"))
    to = F.create_map(*[F.lit(x) for item in states.items() for x in item])
    out = candidates.join(last, "id", "left").withColumn("status", F.coalesce(to[F.col("action")], F.col("status"))).withColumn("updated_at", F.when(F.col("action").isNotNull(), X.ts(now)).otherwise(F.col("updated_at"))).drop("action")
    return out.select(candidates.columns), known.select(F.col("id").alias("candidate_id"), "action", "note", "seq")


# ---- insights ----

def insights_of(insights: DataFrame, slugs: DataFrame, as_of: str, limit: int = 10) -> DataFrame:
    """For each query(query, slug) the newest insights(id, status, expires_at, created_at, source_entities) that are active, have not expired and
    have one of its slugs among their sources."""
    live = insights.filter((F.col("status") == "active") & (F.col("expires_at").isNull() | (F.col("expires_at") >= X.ts(as_of))))
    met = live.select("id", "created_at", F.explode(F.array_distinct("source_entities")).alias("slug")).join(slugs.select("query", "slug").distinct(), "slug").select("query", "id", "created_at").distinct()
    from pyspark.sql import Window

    order = Window.partitionBy("query").orderBy(F.desc("created_at"), F.desc("id"))
    return met.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= limit).select("query", "pos", "id")


def archive_expired(insights: DataFrame, as_of: str) -> DataFrame:
    over = (F.col("status") == "active") & (F.col("expires_at") < X.ts(as_of))
    return insights.withColumn("status", F.when(F.coalesce(over, F.lit(False)), "archived").otherwise(F.col("status")))


# ---- pages ----

def page_upsert(pages: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """pages(slug, type, title, file_path, content_hash, tier, expires_at, created_at, updated_at) after new(slug, type, title, file_path,
    content_hash), one row a slug: a new page is of tier 3 without expiry; a known one takes the title, the hash if there is one, and the
    time, and keeps its type, path, tier and expiry."""
    n = new.select("slug", *[F.col(c).alias(f"n_{c}") for c in ("type", "title", "file_path", "content_hash")], F.lit(True).alias("given"))
    j = pages.withColumn("had", F.lit(True)).join(n, "slug", "full_outer")
    old, given = F.col("had").isNotNull(), F.col("given").isNotNull()
    keep = lambda c: F.when(old, F.col(c)).otherwise(F.col(f"n_{c}")).alias(c)
    return j.select(
        "slug", keep("type"), F.when(given, F.col("n_title")).otherwise(F.col("title")).alias("title"), keep("file_path"), F.coalesce("n_content_hash", "content_hash").alias("content_hash"),
        F.when(old, F.col("tier")).otherwise(3).cast("int").alias("tier"), F.col("expires_at"), F.when(old, F.col("created_at")).otherwise(X.ts(now)).alias("created_at"),
        F.when(given, X.ts(now)).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def page_moves(pages: DataFrame, moves: DataFrame, tables: dict[str, tuple[DataFrame, Sequence[str]]], now: str) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Move pages by moves(old, new, type, file_path), with every row of ``tables`` (name -> frame and its slug columns) that names them; and
    (old, new, problem) of the moves that cannot be made: same_slug, no_page, taken, or repeated. Those that can are made together."""
    m = moves.join(pages.select(F.col("slug").alias("old"), F.lit(True).alias("there")), "old", "left").join(pages.select(F.col("slug").alias("new"), F.lit(True).alias("occupied")), "new", "left")
    twice = lambda c: moves.groupBy(c).agg((F.count("*") > 1).alias(f"{c}_twice"))
    m = m.join(twice("old"), "old").join(twice("new"), "new")
    problem = F.when(F.col("old") == F.col("new"), "same_slug").when(F.col("there").isNull(), "no_page").when(F.col("occupied").isNotNull(), "taken").when(F.col("old_twice") | F.col("new_twice"), "repeated")
    m = m.withColumn("problem", problem)
    good = m.filter("problem is null").select("old", "new", F.col("type").alias("to_type"), F.col("file_path").alias("to_path"))
    j = pages.join(good.withColumnRenamed("old", "slug"), "slug", "left")
    moved = F.col("new").isNotNull()
    change = {"slug": "new", "type": "to_type", "file_path": "to_path"}
    out = j.select(*[F.when(moved, F.col(change[c])).otherwise(F.col(c)).alias(c) if c in change else F.when(moved, X.ts(now)).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in pages.columns])
    names = good.select("old", "new")
    done = {}
    for name, (frame, columns) in tables.items():
        columns_left = frame.columns
        for c in columns:
            frame = frame.join(names.select(F.col("old").alias(c), "new"), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
        done[name] = frame.select(columns_left)
    return out, done, m.filter("problem is not null").select("old", "new", "problem")


# ---- discoveries ----

def promotions(discoveries: DataFrame) -> DataFrame:
    """What of discoveries(id, type, score, actionable, occurrence_count, auto_applicable, proposed_actions) is drafted as an action to review:
    not actions themselves, quiet types or what applies itself; only what is high, repeated, comes with proposals or is of a valuable type;
    and only types that can be shown. The score is kept within 0.1 and 1, an unknown actionability is low."""
    given = F.coalesce(F.trim("proposed_actions"), F.lit("")) != ""
    times = F.coalesce("occurrence_count", F.lit(1))
    rows = discoveries.filter(~F.col("type").startswith("action_") & ~F.col("type").isin(*QUIET) & (F.coalesce("auto_applicable", F.lit(0)) != 1))
    rows = rows.filter((F.col("actionable") == "high") | (times >= REPEATS) | given | F.col("type").isin(*HIGH_VALUE)).filter(F.col("type").isin(*SHOWN))
    safe = F.when(F.col("actionable").isin("high", "medium", "low"), F.col("actionable")).otherwise("low")
    return rows.select("id", "type", X.clamp(F.col("score"), LEAST_SCORE, 1.0).alias("score"), safe.alias("actionable"), (times >= REPEATS).alias("repeated"), given.alias("has_proposals"))
