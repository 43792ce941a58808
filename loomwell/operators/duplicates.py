"""Pages that may stand for one thing: blocking by titles and aliases, a gate by type, then the kinds of likeness in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.functions import exprs as X
from loomwell.operators.knowledge import blocking_keys
from loomwell.operators.stewardship import affine

# Pages of a key at most, edits, and the scores of the kinds.
MOST_PAGES, EDITS = 50, 2
SCORES = {"name_exact": 1.0, "alias_shadow_page": 1.0, "shared_alias": 0.85, "name_normalized": 0.95}


def gated_pairs(pages: DataFrame, aliases: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """(a, b, ta, tb, na, nb, gate) of pages(slug, title, type) that share a key of a title or an alias(page_slug, alias), and whose types are
    the same or affine. Keys of more than ``most`` pages are no keys: they name no single thing. The gate is part of the join, so
    pairs that it stops are never built."""
    named = pages.select("slug", "title").unionByName(aliases.join(pages.select(F.col("slug").alias("page_slug")), "page_slug").select(F.col("page_slug").alias("slug"), F.col("alias").alias("title")))
    keys = named.select("slug", F.explode(blocking_keys(F.col("title"))).alias("key")).distinct()
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("n") <= most)).select("key")
    facts = pages.select("slug", F.col("title").alias("t"), F.col("type").alias("y"), X.normal_name(F.col("title")).alias("n"))
    keys = keys.join(sizes, "key").join(facts, "slug")
    side = lambda end: keys.select("key", F.col("slug").alias(end), F.col("t").alias(f"t{end}"), F.col("y").alias(f"y{end}"), F.col("n").alias(f"n{end}"))
    same = F.col("ya") == F.col("yb")
    pairs = side("a").join(side("b"), "key").filter((F.col("a") < F.col("b")) & (same | affine(F.col("ya"), F.col("yb"))))
    return pairs.select("a", "b", "ta", "tb", "na", "nb", F.when(same, "same_type").otherwise("affine_type").alias("gate")).distinct()


def similar_pages(pages: DataFrame, aliases: DataFrame, most: int = MOST_PAGES, edits: int = EDITS) -> DataFrame:
    """(a, b, kind, score, gate, actionable, reason, direction) of alike pages, by the first kind that holds: equal titles, one's title an alias
    of the other (direction: whose), a shared alias, equal normal forms, one a significant part of the other, few edits."""
    pairs = gated_pairs(pages, aliases, most)
    own = aliases.select(F.col("page_slug").alias("slug"), X.normal_name(F.col("alias")).alias("alias")).filter("alias <> ''").distinct()
    of = lambda end, name: own.select(F.col("slug").alias(end), F.col("alias").alias(name))
    shadow_a = of("b", "na").withColumn("a_is_alias", F.lit(True))
    shadow_b = of("a", "nb").withColumn("b_is_alias", F.lit(True))
    # aliases of one page are few, so a pair's shared ones are found through the pair, not through all pages of an alias
    shared = pairs.select("a", "b").join(of("a", "x"), "a").join(of("b", "x"), ["b", "x"]).select("a", "b").distinct().withColumn("shares", F.lit(True))
    rows = pairs.join(shadow_a, ["b", "na"], "left").join(shadow_b, ["a", "nb"], "left").join(shared, ["a", "b"], "left")
    na, nb = F.col("na"), F.col("nb")
    short, long = F.when(F.length(na) <= F.length(nb), na).otherwise(nb), F.when(F.length(na) <= F.length(nb), nb).otherwise(na)
    part = (F.length(short) >= 2) & long.contains(short) & ((F.length(long) - F.length(short) >= 3) | (F.length(short) >= 0.6 * F.length(long)))
    d = F.levenshtein(na, nb, edits)
    kind = (
        F.when(F.lower("ta") == F.lower("tb"), "name_exact").when(F.col("a_is_alias") | F.col("b_is_alias"), "alias_shadow_page").when(F.col("shares"), "shared_alias")
        .when((na != "") & (na == nb), "name_normalized").when(part, "name_substring").when((d >= 0) & (na != ""), "edit_distance")
    )
    fixed = F.create_map(*[F.lit(x) for item in SCORES.items() for x in item])
    score = F.when(F.col("kind") == "name_substring", 0.6 + 0.3 * F.length(short) / F.length(long)).when(F.col("kind") == "edit_distance", F.greatest(1 - d / F.greatest(F.length(na), F.length(nb)), F.lit(0.5))).otherwise(fixed[F.col("kind")])
    same = F.col("gate") == "same_type"
    high = (F.col("kind") == "alias_shadow_page") | (same & (F.col("kind") != "edit_distance"))
    direction = F.when(F.col("kind") == "alias_shadow_page", F.when(F.col("a_is_alias") & F.col("b_is_alias"), "both").when(F.col("a_is_alias"), "aToB").otherwise("bToA"))
    found = rows.withColumn("kind", kind).filter("kind is not null")
    return found.select("a", "b", "kind", score.alias("score"), "gate", F.when(high, "high").otherwise("medium").alias("actionable"), F.concat_ws(":", "kind", "gate").alias("reason"), direction.alias("direction"))


def best_candidates(found: DataFrame, most: int | None = 100) -> DataFrame:
    """Ranked before they are cut: actionable, score, same type first, then the pair; all of them without ``most``."""
    order = [F.when(F.col("actionable") == "high", 0).otherwise(1), F.desc(F.round("score", 9)), F.when(F.col("gate") == "same_type", 0).otherwise(1), "a", "b"]
    ranked = found.orderBy(*order)
    return ranked.limit(most) if most is not None else ranked
