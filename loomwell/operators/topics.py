"""Topic pages: what they are made of, and whether that still holds.

A source is an original record. Its fingerprint is a hash of its text, and a digest of what governs it: its tags, links and events as sums
of row hashes, so a row that comes or goes adds or subtracts its own hash, and no rows are gathered or sorted. A topic keeps a manifest: a
row for each source it was made of, with both fingerprints as they were, and one row of its own (title, hash of its text, state, catalogue).
What a change touches is a join of the changed sources with the manifest, from source to topic.

The catalogue is a digest of all sources that may be used. A topic whose own sources are as they were but whose catalogue has changed is
attested anew without being written again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.functions import exprs as X

# Sources of one topic, and of a new one at least; characters of a title, and of the material of one topic.
MOST_SOURCES, LEAST_SOURCES, TITLE_CHARS, MATERIAL_CHARS = 20, 2, 120, 200_000


def row_sum(*parts: Column | str) -> Column:
    """A sum over row hashes, as a decimal that many rows do not overflow."""
    return F.coalesce(F.sum(F.xxhash64(*[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts]).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def governance(tags: DataFrame, links: DataFrame, timeline: DataFrame) -> DataFrame:
    """(slug, gov_n, gov_sum, rejected) of the rows that govern pages; rejected: how many of them withdraw something."""
    ends = links.select(F.explode(F.array_distinct(F.array("from_slug", "to_slug"))).alias("slug"), "link_key", "trust_state")
    rows = (
        tags.select(F.col("page_slug").alias("slug"), F.lit("tag").alias("kind"), F.col("tag").alias("what"), F.lit(None).cast("string").alias("trust"))
        .unionByName(ends.select("slug", F.lit("link").alias("kind"), F.col("link_key").alias("what"), F.col("trust_state").alias("trust")))
        .unionByName(timeline.select(F.col("page_slug").alias("slug"), F.lit("event").alias("kind"), F.col("id").cast("string").alias("what"), F.col("trust_state").alias("trust")))
    )
    return rows.groupBy("slug").agg(F.count("*").alias("gov_n"), row_sum("kind", "what", "trust").alias("gov_sum"), F.count(F.when(~X.active_link("trust"), 1)).alias("rejected"))


def sources(pages: DataFrame, governed: DataFrame) -> DataFrame:
    """(slug, title, content_hash, chars, gov_n, gov_sum, eligible) of records(slug, title, type, content_hash, chars)."""
    own = pages.filter("type = 'record'").select("slug", "title", "content_hash", "chars").join(governed, "slug", "left")
    own = own.withColumn("gov_n", F.coalesce("gov_n", F.lit(0))).withColumn("gov_sum", F.coalesce("gov_sum", F.lit(0).cast("decimal(38,0)")))
    return own.withColumn("eligible", (F.coalesce("rejected", F.lit(0)) == 0) & F.col("content_hash").isNotNull()).drop("rejected")


def catalogue(found: DataFrame) -> DataFrame:
    """(n, digest) of the sources that may be used: one row."""
    return found.filter("eligible").agg(F.count("*").alias("n"), row_sum("slug", "content_hash", F.col("gov_sum").cast("string")).alias("digest"))


def changed_catalogue(before: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """The catalogue after some sources changed, from the catalogue before and these sources as they were and are: no others are read."""
    part = lambda t, sign: catalogue(t).select((F.col("n") * sign).alias("n"), (F.col("digest") * sign).cast("decimal(38,0)").alias("digest"))
    return before.select("n", "digest").unionByName(part(old, -1)).unionByName(part(new, 1)).agg(F.sum("n").alias("n"), F.sum("digest").cast("decimal(38,0)").alias("digest"))


@dataclass
class Topics:
    """manifest(topic, source, content_hash, gov_n, gov_sum); heads(topic, title, output_hash, state, catalogue)."""

    manifest: DataFrame
    heads: DataFrame


def compile_plan(requests: DataFrame, found: DataFrame, pages: DataFrame, topics: Topics, bodies: DataFrame) -> DataFrame:
    """(topic, status, reason, n_sources) of requests(topic, title, source): created, refreshed, unchanged, or blocked with a reason.

    ``pages`` (slug, title, type) holds who has a slug or a title; ``bodies`` (topic, body_hash, indexed) the topics' pages as they are.
    """
    asked = requests.groupBy("topic").agg(F.max("title").alias("title"), F.count_distinct("source").alias("asked"))
    pairs = requests.filter("source is not null").select("topic", "source").distinct()
    known = found.select(F.col("slug").alias("source"), "content_hash", "gov_n", "gov_sum", "chars", "eligible", F.lit(True).alias("known"))
    chosen = pairs.join(known, "source", "left")
    usable = F.coalesce("eligible", F.lit(False))
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    per = chosen.groupBy("topic").agg(count(usable, "usable"), count(F.col("known").isNull(), "unknown"), count(~usable & F.col("known").isNotNull(), "withdrawn"), F.coalesce(F.sum(F.when(usable, F.col("chars"))), F.lit(0)).alias("chars"))
    was = topics.manifest.select("topic", "source", F.col("content_hash").alias("c0"), F.col("gov_n").alias("n0"), F.col("gov_sum").alias("s0"), F.lit(True).alias("was"))
    now = chosen.filter(usable).select("topic", "source", "content_hash", "gov_n", "gov_sum", F.lit(True).alias("is"))
    same_row = F.col("is").isNotNull() & F.col("was").isNotNull() & (F.col("content_hash") == F.col("c0")) & (F.col("gov_n") == F.col("n0")) & (F.col("gov_sum") == F.col("s0"))
    apart = now.join(was, ["topic", "source"], "full_outer").groupBy("topic").agg(count(~F.coalesce(same_row, F.lit(False)), "apart"))
    taken = pages.select(F.col("slug").alias("topic"), F.col("type").alias("slug_type"))
    titled = pages.select("title", F.col("slug").alias("holder")).join(asked.select("title", "topic"), "title").filter("holder <> topic").groupBy("topic").agg(F.count("*").alias("others"))
    rows = asked.join(per, "topic", "left").join(apart, "topic", "left").join(taken, "topic", "left").join(titled, "topic", "left").fillna(0, ["usable", "unknown", "withdrawn", "chars", "apart", "others"])
    rows = rows.join(topics.heads.select("topic", "output_hash", "state"), "topic", "left").join(bodies.select("topic", "body_hash", "indexed"), "topic", "left")
    old = F.col("slug_type").eqNullSafe(F.lit("topic"))
    reason = (
        F.when((F.coalesce(F.trim("title"), F.lit("")) == "") | (F.length("title") > TITLE_CHARS), "invalid_title").when(F.col("asked") == 0, "too_few_sources").when(F.col("asked") > MOST_SOURCES, "too_many_sources")
        .when((F.col("slug_type").isNotNull() & ~old) | (F.col("others") > 0), "title_conflict").when(old & ~F.col("output_hash").eqNullSafe(F.col("body_hash")), "target_edited")
        .when(~old & (F.col("unknown") > 0), "source_not_found").when(~old & (F.col("withdrawn") > 0), "source_governance_rejected").when(~old & (F.col("usable") < LEAST_SOURCES), "too_few_sources")
        .when(old & (F.col("usable") == 0), "zero_valid_sources")
    )
    still = old & (F.col("state") == "committed") & (F.col("apart") == 0) & F.coalesce("indexed", F.lit(False))
    reason = F.when(reason.isNull() & ~still & (F.col("chars") > MATERIAL_CHARS), "material_over_budget").otherwise(reason)
    status = F.when(F.col("reason").isNotNull(), "blocked").when(still, "unchanged").when(old, "refreshed").otherwise("created")
    return rows.withColumn("reason", reason).select("topic", status.alias("status"), "reason", F.col("usable").alias("n_sources"))


def committed(plan: DataFrame, requests: DataFrame, found: DataFrame, topics: Topics, written: DataFrame, attested: DataFrame) -> Topics:
    """The manifests after the planned topics were written: written(topic, output_hash); attested is the catalogue's one row."""
    done = plan.filter("status IN ('created', 'refreshed')").select("topic").join(written, "topic")
    rows = requests.select("topic", F.col("source").alias("slug")).distinct().join(done.select("topic"), "topic", "left_semi").join(found.filter("eligible"), "slug")
    rows = rows.select("topic", F.col("slug").alias("source"), "content_hash", "gov_n", "gov_sum")
    head = done.join(requests.groupBy("topic").agg(F.max("title").alias("title")), "topic").crossJoin(F.broadcast(attested.select(F.col("digest").alias("catalogue"))))  # one row
    head = head.select("topic", "title", "output_hash", F.lit("committed").alias("state"), "catalogue")
    keep = lambda t: t.join(done.select("topic"), "topic", "left_anti")
    return Topics(keep(topics.manifest).unionByName(rows), keep(topics.heads).unionByName(head))


def stale_topics(topics: Topics, changed: DataFrame) -> DataFrame:
    """(topic, source) that changed(slug, content_hash, gov_n, gov_sum, eligible) makes stale: only manifests of these sources are met. A source
    that is gone has a null content_hash."""
    new = changed.select(F.col("slug").alias("source"), F.col("content_hash").alias("c1"), F.col("gov_n").alias("n1"), F.col("gov_sum").alias("s1"), "eligible")
    same = F.coalesce("eligible", F.lit(False)) & (F.col("content_hash") == F.col("c1")) & (F.col("gov_n") == F.col("n1")) & (F.col("gov_sum") == F.col("s1"))
    return topics.manifest.join(new, "source").filter(~F.coalesce(same, F.lit(False))).select("topic", "source").distinct()


def inspect(topics: Topics, found: DataFrame, bodies: DataFrame, attested: DataFrame) -> DataFrame:
    """(topic, state, reason, catalogue_changed): fresh, or stale for the first of: edited, pending, not indexed, or a source that is gone,
    withdrawn or changed."""
    now = found.select(F.col("slug").alias("source"), F.col("content_hash").alias("c1"), F.col("gov_n").alias("n1"), F.col("gov_sum").alias("s1"), "eligible", F.lit(True).alias("known"))
    j = topics.manifest.join(now, "source", "left")
    why = F.when(F.col("known").isNull(), "1 source_missing").when(~F.col("eligible"), "2 source_withdrawn").when(F.col("content_hash") != F.col("c1"), "3 content_changed").when((F.col("gov_n") != F.col("n1")) | (F.col("gov_sum") != F.col("s1")), "4 governance_changed")
    per = j.groupBy("topic").agg(F.min(why).alias("why"))
    rows = topics.heads.join(per, "topic", "left").join(bodies.select("topic", "body_hash", "indexed"), "topic", "left").crossJoin(F.broadcast(attested.select(F.col("digest").alias("attested"))))  # one row
    reason = (
        F.when(~F.col("output_hash").eqNullSafe(F.col("body_hash")), "edited_by_user").when(F.col("state") != "committed", "publication_pending").when(~F.coalesce("indexed", F.lit(False)), "index_pending_or_dirty")
        .otherwise(F.substring("why", 3, 100))
    )
    return rows.withColumn("reason", reason).select("topic", F.when(F.col("reason").isNull(), "fresh").otherwise("stale").alias("state"), "reason", (F.col("catalogue") != F.col("attested")).alias("catalogue_changed"))


def reattested(topics: Topics, inspected: DataFrame, attested: DataFrame) -> Topics:
    """Topics that are fresh but for the catalogue take the present one; nothing else of them changes."""
    due = inspected.filter("state = 'fresh' AND catalogue_changed").select("topic", F.lit(True).alias("due"))
    heads = topics.heads.join(due, "topic", "left").crossJoin(F.broadcast(attested.select(F.col("digest").alias("attested"))))  # one row
    heads = heads.withColumn("catalogue", F.when(F.col("due"), F.col("attested")).otherwise(F.col("catalogue"))).drop("due", "attested")
    return Topics(topics.manifest, heads)
