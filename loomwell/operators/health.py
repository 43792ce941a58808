"""Health of the knowledge base: a registry of rules, each table scanned once, and the history of issues over runs.

A rule is a condition over one row of a prepared table; all rules of a table are compiled to one projection that yields a row for each
rule that holds. Rules about whole tables are conditions over one row of measures. Issues are rows (dimension, code, severity, slug);
they are never gathered: counts are partial sums, and the sample of each check is the k rows of least hash, which every task cuts to k
before anything is shuffled. Where the reference flags all but the first of a group, the first comes from an aggregate and a join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions import exprs as X
from loomwell.functions import ontology
from loomwell.operators import knowledge, relational
from loomwell.operators.lineage import stored

# Runs after which an issue is chronic; days and hours of the checks that look back.
CHRONIC_RUNS, WEEK, DAY_HOURS, STALE_DAYS = 3, 7, 24, 30
NO_PAGE = "-"
#: What is known of a line of a page's section: its link is a current fact; it is written; an active link counts here; another page is at its
#: other end, as a fact; it is an outgoing one.
_DUE, _WRITTEN, _LINK, _OTHER, _OUT = 1, 2, 4, 8, 16


@dataclass(frozen=True)
class Rule:
    """``when`` is SQL over a row of the rule's table."""

    dimension: str
    code: str
    severity: str
    when: str


EOC = "(type LIKE 'entity/%' OR type LIKE 'concept/%')"
PAGE_RULES = (
    Rule("consistency", "missing_type", "high", "coalesce(type, '') = ''"),
    Rule("completeness", "bare_stub", "low", f"{EOC} AND tier = 3 AND mention_count <= 1 AND links <= 1"),
    Rule("islands", "island", "medium", f"{EOC} AND links = 0"),
    Rule("attention", "stale_page", "low", f"tier <= 2 AND updated_at < as_of - INTERVAL {STALE_DAYS} DAYS"),
    Rule("attention", "popular_thin", "medium", f"{EOC} AND mention_count >= 3 AND chunks <= 1"),
    Rule("source_quality", "no_chunks", "medium", "type = 'record' AND chunks = 0"),
    Rule("source_quality", "no_title", "low", "coalesce(title, '') = '' OR title = slug"),
    Rule("stale_content", "expired", "high", "trim(expires_at) <> '' AND expires_at < as_of_day"),
    Rule("stale_content", "decayed", "medium", "confidence_decay < 0.3 AND NOT coalesce(trim(expires_at) <> '' AND expires_at < as_of_day, false)"),
)
#: Over one row of measures of several tables.
TOTAL_RULES = (
    Rule("errors", "active_errors", "high", "errors_day > 0"),
    Rule("errors", "recent_errors", "medium", "errors_day = 0 AND errors_week > 0"),
    Rule("consistency", "relation_types", "medium", "odd_relations > 0"),
    Rule("rich_records", "zero_link_records", "medium", "zero_link_records > 0"),
    Rule("suggestions", "concept_inflation", "high", "records > 0 AND concepts / records > 5"),
    Rule("suggestions", "concept_ratio", "medium", "records > 0 AND concepts / records > 3 AND concepts / records <= 5"),
    Rule("readiness", "few_pages", "high", "pages < 10"),
    Rule("readiness", "few_entities", "medium", "entities < 3 AND pages >= 10"),
    Rule("readiness", "few_links", "medium", "links < 5 AND pages >= 10"),
    Rule("search", "degraded", "medium", "degraded_rate > 0.2"),
    Rule("search", "slow", "low", "latency_warning_rate > 0.2"),
    Rule("search", "routing", "low", "hierarchy_mismatches > 0"),
    Rule("search", "empty", "high", "searches >= 10 AND empty / searches > 0.3"),
    Rule("bulk", "paused", "medium", "held_files > 0"),
    Rule("extraction", "filtered", "medium", "extracted + filtered > 0 AND filtered / (extracted + filtered) > 0.6"),
    Rule("extraction", "duplicates", "medium", "candidates > 0 AND duplicates / candidates > 0.4"),
    Rule("extraction", "stubs", "low", "candidates > 0 AND stubs / candidates > 0.5"),
    Rule("verifier", "extraction_errors", "high", "extraction_errors > 0"),
    Rule("verifier", "extraction_warnings", "medium", "extraction_errors = 0 AND extraction_warnings > 0"),
    Rule("verifier", "discoveries", "medium", "discovery_errors + discovery_warnings > 0"),
    Rule("hygiene", "zero_byte", "medium", "zero_byte > 0"),
    Rule("hygiene", "review_required", "medium", "review_required > 0"),
    Rule("hygiene", "scan_incomplete", "medium", "unreadable > 0"),
)
#: When a dimension fails and when it warns, over its numbers of issues: high, medium, low, n, and no_chunks.
VERDICTS: dict[str, tuple[str, str]] = {
    "errors": ("high > 0", "n > 0"), "duplicates": ("high > 0", "n > 0"), "slug_collisions": ("false", "n > 0"), "title_quarantine": ("n > 0", "false"), "consistency": ("high > 0", "n > 0"),
    "structure": ("high > 0", "n > 0"), "rich_records": ("false", "n > 0"), "completeness": ("n > 20", "n > 0"), "islands": ("false", "n > 10"), "suggestions": ("false", "high > 0"),
    "attention": ("false", "high > 0 OR n > 5"), "readiness": ("high > 0", "n > 0"), "source_quality": ("false", "no_chunks > 10"), "stale_content": ("false", "n > 0"), "contradictions": ("false", "n > 0"),
    "search": ("high > 0", "medium > 0"), "bulk": ("false", "n > 0"), "extraction": ("false", "medium > 0"), "verifier": ("high > 0", "n > 0"), "hygiene": ("false", "n > 0"),
}


def flagged(rows: DataFrame, rules: Sequence[Rule], slug: Column | str = "slug") -> DataFrame:
    """Issues of all rules in one scan of rows."""
    slug = F.col(slug) if isinstance(slug, str) else slug
    holds = F.array_compact(F.array(*[F.when(F.expr(r.when), F.struct(F.lit(r.dimension).alias("dimension"), F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"))) for r in rules]))
    return rows.select(slug.alias("slug"), F.explode(holds).alias("r")).select("r.dimension", "r.code", "r.severity", "slug")


def issue(rows: DataFrame, dimension: str, code: str, severity: str, slug: str = "slug") -> DataFrame:
    return rows.select(F.lit(dimension).alias("dimension"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(slug).alias("slug"))


@dataclass
class State:
    """What is checked. Rows of one table each; the last six may be empty.

    errors(created_at); quarantine(slug); written(slug, direction, link_key): lines of the pages' relation sections; mentioned(slug, target):
    resolved wikilinks of the bodies; managers(slug, reports_to) of the frontmatter; conflicts(slug): pairs of contexts that contradict each
    other; searches(created_at, reason, hit_count, degraded, latency_ms); extraction(created_at, extracted, filtered, candidates, duplicates,
    stubs); verified(created_at, kind, level); held(path); files(path, size, state) with state ok, outside or unreadable.
    """

    pages: DataFrame
    links: DataFrame
    chunks: DataFrame
    tags: DataFrame
    errors: DataFrame
    quarantine: DataFrame
    written: DataFrame
    mentioned: DataFrame
    managers: DataFrame
    conflicts: DataFrame
    searches: DataFrame
    extraction: DataFrame
    verified: DataFrame
    held: DataFrame
    files: DataFrame


def duplicates(pages: DataFrame) -> DataFrame:
    """Of pages with one title (case and outer spaces aside) all but the first by (title, slug); then of those that agree without spaces,
    hyphens, underscores and dots, all but the first that are not flagged yet."""
    rows = pages.filter(EOC).select("slug", "title", F.lower(F.trim("title")).alias("same"), F.lower(F.regexp_replace("title", r"[\s\-_·.]", "")).alias("near"))
    place = F.struct("title", "slug")
    first = lambda key: rows.groupBy(key).agg(F.min(place).alias(f"first_{key}"))
    seen = rows.join(first("same"), "same").join(first("near"), "near")
    same = F.col("first_same.slug") != F.col("slug")
    near = F.col("first_near.slug") != F.col("slug")
    severity = F.when(same, "high").when(near, "medium")
    return seen.filter(same | near).select(F.lit("duplicates").alias("dimension"), F.when(same, "same_title").otherwise("near_title").alias("code"), severity.alias("severity"), "slug")


def slug_collisions(pages: DataFrame) -> DataFrame:
    rows = pages.filter("type LIKE 'entity/%'").select("slug", F.regexp_replace("slug", r"-\d+$", "").alias("base"))
    shared = rows.groupBy("base").agg(F.count("*").alias("n")).filter("n > 1").select("base")
    return issue(rows.join(shared, "base", "left_semi"), "slug_collisions", "same_base", "high")


def page_links(state: State) -> DataFrame:
    """(slug, links, due, linked, out_missing, in_missing, extra) of all slugs that an active link or a written line names: how many active links
    touch it (a self-loop once); whether a fact does, and one with another page; whether a fact's line is not written; whether others are. The ends of links and the written lines cross one exchange, by slug; a line that is due and one that is written meet in a hash
    aggregate, not in joins. A line is kept without the slug that it begins or ends with."""
    slug, key, out = F.col("slug"), F.col("link_key"), F.col("direction") == "out"
    rest = F.when(key.startswith(slug), F.concat(F.lit("<"), F.substring(key, F.length(slug) + 1, F.length(key)))).when(key.endswith(slug), F.concat(F.lit(">"), F.substring(key, F.lit(1), F.length(key) - F.length(slug))))
    line = F.concat(F.when(out, "o").otherwise("i"), F.coalesce(rest, F.concat(F.lit("="), key), F.lit("?"))).alias("line")
    bit = lambda c, n: F.when(c, n).otherwise(0)
    loop, fact = F.col("from_slug") == F.col("to_slug"), X.current_fact()
    whose = (("from_slug", "out", F.lit(True)), ("to_slug", "in", ~F.coalesce(loop, F.lit(False))))
    ends = F.explode(F.array(*[F.struct(F.col(end).alias("slug"), F.lit(d).alias("direction"), (bit(fact, _DUE) + bit(once, _LINK) + bit(fact & ~loop, _OTHER)).alias("marks")) for end, d, once in whose])).alias("e")
    due = state.links.filter(X.active_link()).select(ends, "link_key").select("e.*", "link_key")
    rows = due.unionByName(state.written.select("slug", "direction", "link_key", F.lit(_WRITTEN).alias("marks"))).filter("slug IS NOT NULL")
    lines = rows.select("slug", line, (F.col("marks") + bit(out, _OUT)).alias("marks")).repartition("slug").groupBy("slug", "line").agg(F.bit_or("marks").alias("marks"))
    has = lambda n: F.col("marks").bitwiseAND(n) > 0
    holds = {"due": has(_DUE), "linked": has(_OTHER), "out_missing": has(_DUE) & ~has(_WRITTEN) & has(_OUT), "in_missing": has(_DUE) & ~has(_WRITTEN) & ~has(_OUT), "extra": has(_WRITTEN) & ~has(_DUE)}
    return lines.groupBy("slug").agg(F.count(F.when(has(_LINK), 1)).alias("links"), *[F.max(c).alias(name) for name, c in holds.items()])


def structure(state: State, ends: DataFrame) -> DataFrame:
    """Links that the files do not tell, mentions without a link, and managers without an edge; ``ends`` as ``page_links`` gives them."""
    paged = ends.join(state.pages.select("slug"), "slug", "left_semi").select("slug", F.array_compact(F.array(F.when(F.col("out_missing"), "outgoing_missing"), F.when(F.col("in_missing"), "incoming_missing"))).alias("codes"))
    out = paged.select(F.lit("structure").alias("dimension"), F.explode("codes").alias("code"), F.lit("medium").alias("severity"), "slug")
    # a section that has all its lines, and others besides; a slug without page misses nothing
    drift = ends.filter("extra AND due").join(paged.filter("size(codes) > 0"), "slug", "left_anti").select("slug")
    told = stored(state.mentioned.filter("slug <> target").select("slug", F.col("target").alias("to_slug")).distinct())
    near = relational.possible(state.links.select("from_slug", "to_slug"), "to_slug", told.select(F.col("to_slug").alias("slug")))
    untold = told.join(near.select(F.col("from_slug").alias("slug"), "to_slug"), ["slug", "to_slug"], "left_anti").select("slug").distinct()
    edge = state.links.filter("relation = 'reports_to' AND (trust_state IS NULL OR trust_state IN ('trusted', 'user_thought'))").select(F.col("from_slug").alias("slug"), F.col("to_slug").alias("reports_to"))
    named = state.managers.filter("reports_to <> ''")
    whole = F.col("reports_to").contains("/")
    return (
        out.unionByName(issue(drift, "structure", "projection_drift", "medium")).unionByName(issue(untold, "structure", "mention_without_link", "low"))
        .unionByName(issue(named.filter(~whole), "structure", "manager_not_slug", "high"))
        .unionByName(issue(named.filter(whole).join(edge, ["slug", "reports_to"], "left_anti"), "structure", "manager_without_link", "high"))
    )


def totals(state: State, as_of: str, ends: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row of measures: one scan of each table."""
    now = X.ts(as_of)
    since = lambda hours: F.col("created_at") >= now - F.expr(f"INTERVAL {hours} HOURS")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    known = F.broadcast(ontology.alias_dim(state.pages.sparkSession).select(F.col("name").alias("relation")))  # fixed
    parts = [
        state.pages.agg(F.count("*").alias("pages"), n(F.col("type").startswith("entity/")).alias("entities"), n(F.col("type").startswith("concept/")).alias("concepts"), n(F.col("type") == "record").alias("records")),
        state.links.agg(F.count("*").alias("links")),
        state.links.select("relation").distinct().join(known, "relation", "left_anti").agg(F.count("*").alias("odd_relations")),
        relational.rich_records(state.pages, sizes, state.tags).join(ends.filter("linked"), "slug", "left_anti").agg(F.count("*").alias("zero_link_records")),
        state.errors.agg(n(since(DAY_HOURS)).alias("errors_day"), n(since(24 * WEEK)).alias("errors_week")),
        relational.search_quality(state.searches, _before(as_of, WEEK)).select(F.col("total").alias("searches"), "degraded_rate", "latency_warning_rate", "empty", "hierarchy_mismatches"),
        state.extraction.filter(since(24 * WEEK)).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("extracted", "filtered", "candidates", "duplicates", "stubs")]),
        state.verified.filter(since(DAY_HOURS)).agg(*[n((F.col("kind") == kind) & (F.col("level") == level)).alias(f"{kind}_{level}s") for kind in ("extraction", "discovery") for level in ("error", "warning")]),
        state.held.agg(F.count("*").alias("held_files")),
        state.files.agg(n((F.col("size") == 0) & F.col("path").endswith(".md")).alias("zero_byte"), n(F.col("state") == "outside").alias("review_required"), n(F.col("state") == "unreadable").alias("unreadable")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out


def _before(as_of: str, days: int) -> str:
    from datetime import datetime, timedelta

    return str(datetime.fromisoformat(as_of) - timedelta(days=days))


def issues(state: State, as_of: str) -> DataFrame:
    """All issues of the twenty dimensions: (dimension, code, severity, slug)."""
    sizes, ends = stored(relational.chunk_sizes(state.chunks)), stored(page_links(state))
    facts = state.pages.join(sizes.select("slug", "chunks"), "slug", "left").join(ends.select("slug", "links"), "slug", "left").fillna(0, ["chunks", "links"])
    facts = facts.withColumn("as_of", X.ts(as_of)).withColumn("as_of_day", F.lit(as_of[:10]))
    reasons = lambda rows, dimension: issue(relational.top_reasons(rows, 3).select(F.concat(F.lit("reason:"), "reason").alias("slug")), dimension, "reason", "low")
    recent = state.searches.filter(F.col("created_at") >= X.ts(_before(as_of, WEEK)))
    parts = [
        flagged(facts, PAGE_RULES), flagged(totals(state, as_of, ends, sizes), TOTAL_RULES, F.lit(NO_PAGE)), duplicates(state.pages), slug_collisions(state.pages), structure(state, ends),
        issue(state.quarantine, "title_quarantine", "quarantined", "high"), issue(state.conflicts, "contradictions", "conflict", "medium"), reasons(recent, "search"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def verdicts(found: DataFrame) -> DataFrame:
    """(dimension, status, high, medium, low, n) of all dimensions, also those without issues, and the overall status."""
    count = lambda c: F.count(F.when(c, 1))
    per = found.groupBy("dimension").agg(*[count(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")], F.count("*").alias("n"), count(F.col("code") == "no_chunks").alias("no_chunks"))
    spark = found.sparkSession
    every = spark.createDataFrame([(d,) for d in VERDICTS], "dimension string")
    per = every.join(per, "dimension", "left").fillna(0)
    status = F.lit("pass")
    for d, (fails, warns) in VERDICTS.items():
        status = F.when(F.col("dimension") == d, F.when(F.expr(fails), "fail").when(F.expr(warns), "warn").otherwise("pass")).otherwise(status)
    per = per.withColumn("status", status)
    total = per.agg(F.sum("high").alias("all_high"), F.max((F.col("status") == "warn").cast("int")).alias("any_warn"))
    overall = F.when(F.col("all_high") > 5, "fail").when((F.col("any_warn") == 1) | (F.col("all_high") > 0), "warn").otherwise("pass")
    return per.crossJoin(F.broadcast(total)).select("dimension", "status", "high", "medium", "low", "n", overall.alias("overall"))  # one row


def checks(found: DataFrame) -> DataFrame:
    return found.groupBy("dimension", "code", "severity").agg(F.count("*").alias("n"))


def sample(found: DataFrame, k: int = 10) -> DataFrame:
    """The k issues of each check with the least hash of their slug. Each task keeps k a check before the exchange."""
    order = Window.partitionBy("dimension", "code").orderBy(F.md5("slug"), "slug")
    return found.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k)


# ---- history ----

def identities(found: DataFrame) -> DataFrame:
    """(dimension, identity): what an issue is known by from run to run: its page, or else its code."""
    return found.select("dimension", F.when(F.col("slug") == NO_PAGE, F.col("code")).otherwise(F.col("slug")).alias("identity"))


def compared(found: DataFrame, history: DataFrame | None) -> DataFrame:
    """(dimension, identity, now, was, before) of all that this run or the history knows: whether this run has it, its runs on end so far (null
    if it is new), and the most runs that its identity has had in any dimension. One exchange, by identity."""
    rows = identities(found).select("dimension", "identity", F.lit(True).alias("now"), F.lit(None).cast("long").alias("runs"))
    if history is not None:
        rows = rows.unionByName(history.select("dimension", "identity", F.lit(False).alias("now"), F.col("runs").cast("long").alias("runs")))
    both = rows.repartition("identity").groupBy("dimension", "identity").agg(F.max("now").alias("now"), F.max("runs").alias("was"))
    return both.withColumn("before", F.max("was").over(Window.partitionBy("identity")))


def _next(both: DataFrame) -> DataFrame:
    return both.filter("now").select("dimension", "identity", (F.coalesce("before", F.lit(0)) + 1).cast("long").alias("runs"))


def _delta(both: DataFrame, chronic: int) -> DataFrame:
    state = F.when(F.col("was").isNull(), "new").when(~F.col("now"), "resolved").otherwise("unchanged")
    return both.select("dimension", "identity", state.alias("state"), (F.col("now") & (F.coalesce("before", F.lit(0)) >= chronic)).alias("chronic"))


def next_history(found: DataFrame, history: DataFrame | None) -> DataFrame:
    """(dimension, identity, runs): the issues of this run, and in how many runs on end each identity has been seen."""
    return _next(compared(found, history))


def delta(found: DataFrame, history: DataFrame | None, chronic: int = CHRONIC_RUNS) -> DataFrame:
    """(dimension, identity, state, chronic): new, unchanged or resolved against the history; chronic if seen in so many runs before."""
    return _delta(compared(found, history), chronic)


def run(found: DataFrame, path: str) -> DataFrame:
    """The delta of this run against the history stored at ``path``, which then holds this run too."""
    spark = found.sparkSession
    both = stored(compared(found, knowledge.read_table(spark, path) if knowledge.has_table(spark, path) else None))
    knowledge.replace_table(_next(both), path)
    return _delta(both, CHRONIC_RUNS)


def summary_text(judged: DataFrame, changed: DataFrame, day: str) -> str:
    """The report of one run: verdicts and changes a dimension, some twenty rows."""
    rows = judged.orderBy("dimension").collect()
    states = {(r["dimension"], r["state"]): r["n"] for r in changed.groupBy("dimension", "state").agg(F.count("*").alias("n")).collect()}
    lines = [f"# Health {day}", "", f"Overall: {rows[0]['overall'] if rows else 'pass'}", "", "| Dimension | Status | Issues | New | Resolved |", "|---|---|---|---|---|"]
    lines += [f"| {r['dimension']} | {r['status']} | {r['n']} | {states.get((r['dimension'], 'new'), 0)} | {states.get((r['dimension'], 'resolved'), 0)} |" for r in rows]
    return "\n".join(lines) + "\n"
