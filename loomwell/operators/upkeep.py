"""Keeping stores up to date: watched files, page indexes, quarantine, learning with a watermark, held changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.operators import graph, knowledge, relational, retrieval

# Changes beyond which a scan is held, and how many go at once.
BULK_THRESHOLD, BULK_BATCH, FAILURES = 50, 10, 3


def watch_plan(seen: DataFrame, files: DataFrame) -> DataFrame:
    """What to do with each path of files (path, mtime, size, hash) against those seen: skip what has the same time and size without a look
    at the hash; touched if the hash is the same; sync if it differs or the path is new; delete what is gone."""
    s = seen.select("path", F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"), F.col("hash").alias("old_hash"))
    j = files.join(s, "path", "full_outer")
    same = (F.col("mtime") == F.col("old_mtime")) & (F.col("size") == F.col("old_size"))
    action = F.when(F.col("hash").isNull(), "delete").when(F.col("old_hash").isNull(), "sync").when(same, "skip").when(F.col("hash") == F.col("old_hash"), "touched").otherwise("sync")
    return j.select("path", action.alias("action"))


def release_plan(changes: DataFrame, key: str = "path", threshold: int = BULK_THRESHOLD, size: int = BULK_BATCH) -> DataFrame:
    """changes with the batch in which each goes: all at once (0) up to the threshold; beyond it they are held, and go by hand in batches
    from 1, in order."""
    n = changes.agg(F.count("*").alias("_n"))
    return relational.numbered(changes, key, name="_pos").crossJoin(F.broadcast(n)).withColumn("batch", F.when(F.col("_n") > threshold, F.ceil(F.col("_pos") / size)).otherwise(0).cast("int")).drop("_n", "_pos")  # one row


def quarantine_states(results: DataFrame, limit: int = FAILURES) -> DataFrame:
    """The state of each page after results (slug, seq, hash, ok): quarantined after so many failures on its present content without a
    success between."""
    w = Window.partitionBy("slug").orderBy("seq")
    fresh = F.coalesce((F.col("hash") != F.lag("hash").over(w)) | F.lag("ok").over(w), F.lit(True))
    runs = results.withColumn("run", F.sum(fresh.cast("long")).over(w))
    per = runs.groupBy("slug", "run").agg(F.sum((~F.col("ok")).cast("long")).alias("failures"))
    last = per.groupBy("slug").agg(F.max(F.struct("run", "failures")).alias("l"))
    return last.select("slug", F.col("l.failures").alias("failures"), F.when(F.col("l.failures") >= limit, "quarantined").otherwise("active").alias("state"))


def learning_step(links: DataFrame, hits: DataFrame, watermark: int, since: str, step: float = 0.1, most: float = 10.0) -> DataFrame:
    """links with weights raised for pages that occur together in sessions that are new since the watermark, each row with the watermark
    that now holds: links and watermark are one table, so they are replaced together and a repeated step changes nothing."""
    pairs = relational.new_session_pairs(hits, watermark, since)
    raised = graph.boost(links, pairs, step, most).select("link_key", F.col("weight").alias("raised"))
    mark = hits.agg(F.coalesce(F.greatest(F.max("id"), F.lit(watermark)), F.lit(watermark)).alias("watermark"))
    return links.join(raised, "link_key", "left").withColumn("weight", F.coalesce("raised", "weight")).drop("raised").crossJoin(F.broadcast(mark))  # one row


def replace_page_index(chunks: DataFrame, postings: DataFrame, vectors: DataFrame, bodies: DataFrame, embed: Column, size: int = 500) -> tuple[DataFrame, DataFrame, DataFrame]:
    """chunks (page_slug, chunk_index, content), postings and vectors (page_slug, chunk_index, vector) after the pages of bodies (slug,
    body) got these; an empty body takes the page out of all three. ``embed`` makes a vector of column content."""
    changed = bodies.select("slug").distinct()
    new = knowledge.chunk_pages(bodies.filter(F.trim("body") != ""), "body", size).select(F.col("slug").alias("page_slug"), "chunk_index", "content")
    gone = changed.withColumnRenamed("slug", "page_slug")
    out = chunks.select("page_slug", "chunk_index", "content").join(gone, "page_slug", "left_anti").unionByName(new)
    own = vectors.select("page_slug", "chunk_index", "vector").join(gone, "page_slug", "left_anti").unionByName(new.select("page_slug", "chunk_index", embed.alias("vector")))
    return out, retrieval.replace_postings(postings, changed, new), own
