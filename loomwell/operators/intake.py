"""What comes in: mentions and organisations from pages, routed texts, extracted items, jobs that catch up, seals, dossiers, project state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions import exprs as X
from loomwell.functions import intent as I
from loomwell.operators import knowledge as N
from loomwell.operators.relational import first_by

MENTION = "提及"


# ---- links from pages ----

def _unique(pages: DataFrame, key: str, column: str) -> DataFrame:
    """(key, slug, n): the page of each value of a column and how many have it."""
    return pages.filter(F.trim(column) != "").groupBy(F.col(column).alias(key)).agg(F.count("*").alias("n"), F.min("slug").alias("slug"))


def mention_edges(pages: DataFrame, targets: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges (from_slug, to_slug, relation, source_type) from the wikilinks in pages (slug, body): the last part of a path is looked up as a
    title, then as an alias, of exactly one page of targets (slug, title); the shown name must be one that an entity can have; no
    page mentions itself, and each target once."""
    link = pages.select("slug", F.explode(N.wikilink_pairs(F.col("body"))).alias("l"))
    name = F.element_at(F.split("l.target", "/"), -1)
    link = link.select(F.col("slug").alias("from_slug"), name.alias("name"), F.coalesce("l.display", name).alias("shown")).filter(I.valid_name(F.col("shown")))
    title = _unique(targets, "name", "title").filter("n = 1").select("name", F.col("slug").alias("by_title"))
    alias = _unique(aliases.select("alias", F.col("page_slug").alias("slug")).distinct(), "name", "alias").filter("n = 1").select("name", F.col("slug").alias("by_alias"))
    out = link.join(title, "name", "left").join(alias, "name", "left").withColumn("to_slug", F.coalesce("by_title", "by_alias"))
    return out.filter(F.col("to_slug").isNotNull() & (F.col("to_slug") != F.col("from_slug"))).select("from_slug", "to_slug", F.lit(MENTION).alias("relation"), F.lit("wikilink").alias("source_type")).distinct()


def mention_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(slug, delta): mentions that each target gains when a page's edges are rebuilt; edges that stay count nothing new."""
    new = after.join(before.select("from_slug", "to_slug"), ["from_slug", "to_slug"], "left_anti")
    return new.groupBy(F.col("to_slug").alias("slug")).agg(F.count("*").alias("delta"))


ORGANISATIONS = ("entity/company", "entity/organization")


def organisations(people: DataFrame, pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """What becomes of the organisation that people (slug, organization, organization_source) state: projected with its target, or why it is
    skipped. Only manual and agent sources count, only for persons, and the target must be one page by slug, title or alias, a company
    or an organisation, and another page."""
    p = pages.select("slug", "type")
    title = _unique(pages, "org", "title").select("org", F.col("slug").alias("by_title"), F.col("n").alias("titles"))
    alias = _unique(aliases.select("alias", F.col("page_slug").alias("slug")), "org", "alias").select("org", F.col("slug").alias("by_alias"), F.col("n").alias("named"))
    out = people.withColumn("org", F.trim("organization")).join(p.withColumnRenamed("type", "own_type"), "slug", "left").join(p.select(F.col("slug").alias("org"), F.lit(True).alias("is_page")), "org", "left").join(title, "org", "left").join(alias, "org", "left")
    target = F.when(F.col("is_page"), F.col("org")).when(F.col("titles") == 1, F.col("by_title")).when(F.col("titles").isNull() & (F.col("named") == 1), F.col("by_alias"))
    out = out.withColumn("target", target).join(p.select(F.col("slug").alias("target"), F.col("type").alias("target_type")), "target", "left")
    source = F.coalesce("organization_source", F.lit(""))
    reason = (
        F.when(source == "", "missing_source").when(~source.isin("manual", "agent"), "untrusted_source").when(~F.col("own_type").eqNullSafe(F.lit("entity/person")), "invalid_source_type").when(F.coalesce("org", F.lit("")) == "", "invalid_organization")
        .when(F.col("is_page").isNull() & (F.col("titles") > 1), "ambiguous_title").when(F.col("is_page").isNull() & F.col("titles").isNull() & (F.col("named") > 1), "ambiguous_alias").when(F.col("target").isNull(), "target_not_found")
        .when(F.col("target") == F.col("slug"), "self_reference").when(~F.coalesce(F.col("target_type").isin(*ORGANISATIONS), F.lit(False)), "invalid_target_type")
    )
    return out.withColumn("reason", reason).select("slug", F.when(F.col("reason").isNull(), F.col("target")).alias("target"), F.when(F.col("reason").isNull(), "projected").otherwise("skipped").alias("status"), "reason")


# ---- routed texts ----

def inferred_title(declared: Column, content: Column) -> Column:
    """The declared title, or the first line that holds a letter or digit, of which 50 characters; null if there is none."""
    has = lambda c: c.rlike(r"[\p{L}\p{N}]")
    line = F.element_at(F.filter(F.split(content, "\n"), has), 1)
    first = F.when(F.size(F.filter(F.split(content, "\n"), has)) > 0, F.substring(F.trim(line), 1, 50))
    return F.when(F.coalesce(has(declared), F.lit(False)), F.trim(declared)).otherwise(first)


PATH_LIKE = r"^(?:[~./]*/|[A-Za-z]:\\)\S+$|^@\S+\.\w+$"


def route_texts(items: DataFrame, pages: DataFrame, bodies: DataFrame) -> DataFrame:
    """Items (id, content, title) with kind (markdown or text), title, slug and outcome: invalid (nothing to name it by, or a path for a
    title), duplicate (a page or an earlier item has the body, by fingerprint, or a person's page the block), appended (to the page of
    the person of that title), updated (the slug exists) or created. bodies: (slug, body) of the pages."""
    front = N.frontmatter(F.col("content"))
    out = items.withColumn("kind", N.content_kind(F.col("content"))).withColumn("f", F.when(F.col("kind") == "markdown", front))
    body = F.coalesce("f.body", "content")
    declared = F.coalesce("title", F.element_at("f.fields", "title"))
    out = out.withColumn("body", body).withColumn("title", inferred_title(declared, body)).withColumn("own_slug", F.element_at("f.fields", "slug"))
    out = out.withColumn("slug", F.coalesce(F.nullif("own_slug", F.lit("")), F.concat(F.lit("records/"), N.slug_name(F.col("title"))))).withColumn("print", N.fingerprint(F.col("body")))
    person = _unique(pages.filter("type = 'entity/person'"), "title", "title").filter("n = 1").select("title", F.col("slug").alias("person"))
    known = bodies.select(N.fingerprint(F.col("body")).alias("print")).distinct().withColumn("known", F.lit(True))
    earlier = F.row_number().over(Window.partitionBy("print").orderBy("id")) > 1
    own = bodies.select(F.col("slug").alias("person"), F.col("body").alias("person_body"))
    out = out.withColumn("earlier", earlier).join(person, "title", "left").join(own, "person", "left").join(known, "print", "left").join(pages.select("slug", F.lit(True).alias("there")).distinct(), "slug", "left")
    outcome = (
        F.when(F.col("title").isNull() | F.col("title").rlike(PATH_LIKE), "invalid").when(F.col("person").isNotNull(), F.when(F.coalesce(F.col("person_body").contains(F.trim("body")), F.lit(False)), "duplicate").otherwise("appended"))
        .when(F.coalesce("known", F.lit(False)) | F.col("earlier"), "duplicate").when(F.col("there"), "updated").otherwise("created")
    )
    return out.withColumn("outcome", outcome).select("id", "kind", "title", F.when(F.col("person").isNotNull(), F.col("person")).otherwise(F.col("slug")).alias("slug"), "outcome")


# ---- extraction ----

def merge_entities(found: DataFrame) -> DataFrame:
    """Of entities (doc, chunk, pos, name, kind) from a document's chunks the first of each name."""
    return first_by(found, ["doc", "name"], "chunk", "pos").select("doc", "name", "kind")


def merge_events(found: DataFrame) -> DataFrame:
    """Of events (doc, chunk, pos, date, description) one of each date and description."""
    return found.select("doc", F.coalesce("date", F.lit("")).alias("date"), "description").distinct()


def merge_facts(found: DataFrame) -> DataFrame:
    """Of facts (doc, chunk, pos, entity, field, value, confidence) the surest of each entity and field, the first of equally sure ones."""
    return first_by(found, ["doc", "entity", "field"], F.desc("confidence"), "chunk", "pos").select("doc", "entity", "field", "value", "confidence")


def chunks_to_extract(docs: DataFrame, size: int = 2500) -> DataFrame:
    """(doc, chunk, content) of docs (doc, text), by sentences: what a model is asked about."""
    return docs.filter("text is not null").select("doc", F.posexplode(N.sentence_chunks(F.col("text"), size)).alias("chunk", "content"))


def backfill_plan(jobs: DataFrame, sources: DataFrame, most: int = 20) -> DataFrame:
    """What becomes of the pending jobs (id, slug, kind, fingerprint, status, priority) that a run takes, ``most`` by priority: run, or skipped
    because the job is invalid, its source (slug, fingerprint) is gone, or it has changed since."""
    use = jobs.filter("status = 'pending'").orderBy(F.desc("priority"), "id").limit(most)
    out = use.join(sources.select("slug", F.col("fingerprint").alias("now")), "slug", "left")
    bad = (F.coalesce(F.trim("slug"), F.lit("")) == "") | ~F.coalesce("kind", F.lit("ner")).isin("ner", "entity_facts")
    outcome = F.when(bad, "invalid_job").when(F.col("now").isNull(), "source_unavailable").when(F.col("fingerprint").isNotNull() & (F.col("fingerprint") != F.col("now")), "source_changed").otherwise("run")
    return out.select("id", "slug", outcome.alias("outcome"))


# ---- seals and dossiers ----

def raw_hashes(chunks: DataFrame) -> DataFrame:
    """(slug, raw, hash) of pages with raw chunks: their number and a sum of hashes over place and text."""
    one = X.hash32(F.concat(F.col("chunk_index").cast("string"), F.lit("|"), "content"))
    return chunks.filter("summary_level = 0").groupBy(F.col("page_slug").alias("slug")).agg(F.count("*").alias("raw"), F.sum(one).alias("hash"))


def seal_plan(pages: DataFrame, chunks: DataFrame, seals: DataFrame) -> DataFrame:
    """Which pages need a summary: seal (none yet), reseal (their raw chunks changed), unchanged, or no raw chunks. seals: (slug, hash)."""
    out = pages.select("slug").join(raw_hashes(chunks), "slug", "left").join(seals.select("slug", F.col("hash").alias("old")), "slug", "left")
    return out.select("slug", F.when(F.col("raw").isNull(), "no raw chunks").when(F.col("old").isNull(), "seal").when(F.col("old") != F.col("hash"), "reseal").otherwise("unchanged").alias("state"), "hash")


def seal(chunks: DataFrame, plan: DataFrame, summaries: DataFrame) -> DataFrame:
    """chunks (page_slug, chunk_index, summary_level, content) with the summaries (slug, summary) of pages that need one, at place -1 and
    level 1 instead of older ones; a page whose model gave nothing keeps what it has."""
    new = plan.filter("state in ('seal', 'reseal')").join(summaries.filter(F.trim("summary") != ""), "slug").select(F.col("slug").alias("page_slug"), F.lit(-1).alias("chunk_index"), F.lit(1).alias("summary_level"), F.col("summary").alias("content"))
    cols = ["page_slug", "chunk_index", "summary_level", "content"]
    old = chunks.select(cols)
    return old.filter("summary_level = 0").unionByName(old.filter("summary_level = 1").join(new.select("page_slug"), "page_slug", "left_anti").select(cols)).unionByName(new)


# Sections that a dossier needs, its least length, and how many sources it cites when there is much to cite.
SECTIONS = ["### 核心定位", "### 关键能力", "### 信息矛盾", "### 关键关系", "### 数据充分度"]
DOSSIER_LENGTH, MANY_CHUNKS, CITATIONS = 500, 5, 3
VIEWS, VIEW_CHUNKS = 8, 2


def dossier_inputs(pages: DataFrame, chunks: DataFrame, links: DataFrame, timeline: DataFrame, tags: DataFrame) -> DataFrame:
    """What a dossier of each of pages (slug, title) rests on: own raw chunks, links both ways, events, tags, and chunks of up to eight pages
    that link here which name it, two of each."""
    count = lambda t, key, name: t.groupBy(F.col(key).alias("slug")).agg(F.count("*").alias(name))
    into = links.filter(X.current_fact() & (F.col("from_slug") != F.col("to_slug"))).select(F.col("to_slug").alias("slug"), F.col("from_slug").alias("page_slug")).distinct().join(pages.select("slug", "title"), "slug")
    from_pages = first_by(into, ["slug"], "page_slug", n=VIEWS)
    short = F.element_at(F.split("slug", "/"), -1)
    views = from_pages.join(chunks.filter("summary_level = 0"), "page_slug").filter(F.col("content").contains(F.col("title")) | F.col("content").contains(short))
    views = first_by(views, ["slug", "page_slug"], "chunk_index", n=VIEW_CHUNKS)
    use = links.filter(X.current_fact())
    out = pages.select("slug")
    for t in (count(chunks.filter("summary_level = 0"), "page_slug", "chunks"), count(use, "from_slug", "outgoing"), count(use, "to_slug", "incoming"), count(timeline.filter(X.active_link()), "page_slug", "events"), count(tags, "page_slug", "tags"), count(views, "slug", "views")):
        out = out.join(t, "slug", "left")
    return out.fillna(0)


def dossier_issues(text: Column, chunks: Column) -> Column:
    """What a dossier lacks, as an array: sections, length, citations."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(s))

    def lacks(head: str) -> Column:
        return F.when(~F.exists(lines, lambda s: s.startswith(head)), F.lit(f"missing {head}"))

    missing = [lacks(h) for h in SECTIONS]
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    cites = (F.length(text) - F.length(F.replace(text, F.lit("[["), F.lit("")))) / 2
    return F.array_compact(F.array(*missing, F.when(letters < DOSSIER_LENGTH, "short"), F.when((chunks > MANY_CHUNKS) & (cites < CITATIONS), "few citations")))


# ---- project state ----

STATE = "updated_at string, active_work array<string>, decisions array<string>, blockers array<string>, release string, maintenance string, notes array<string>"
STATE_LISTS = ("active_work", "decisions", "blockers", "notes")
SHOWN_ITEMS, STATE_CHARS = 8, 2000


def project_states(rows: DataFrame, as_of: str, stale_days: int = 14, most: int = STATE_CHARS) -> DataFrame:
    """Envelopes of states (project, json): status (empty, unreadable or ok), number of signals, whether the text shown (eight items of each
    list) is cut at ``most`` characters, and whether the state is old. Items that must not be shown are left out of the text."""
    s = rows.withColumn("s", F.from_json("json", STATE)).withColumn("empty", F.coalesce(F.trim("json"), F.lit("")) == "")
    # a text that is no object gives a struct of nulls
    broken = ~F.col("empty") & ~F.coalesce(F.trim("json").startswith("{") & F.trim("json").endswith("}"), F.lit(False))
    items = lambda c: F.coalesce(F.col(f"s.{c}"), F.array().cast("array<string>"))
    count = sum((F.size(items(c)) for c in STATE_LISTS), F.lit(0))
    safe = lambda c: F.filter(F.transform(items(c), lambda x: I.display_safe(F.trim(x), "")), lambda x: x != "")
    shown = F.array_join(F.concat(*[F.slice(safe(c), 1, SHOWN_ITEMS) for c in STATE_LISTS]), "\n")
    age = X.days_between(X.ts(as_of), F.to_timestamp("s.updated_at"))
    return s.select("project", F.when(F.col("empty"), "empty").when(broken, "unreadable").otherwise("ok").alias("status"), F.when(F.col("empty") | broken, 0).otherwise(count).alias("signals"),
                    (F.length(shown) > most).cast("int").alias("truncated"), F.substring(shown, 1, most).alias("display"), F.coalesce(age > stale_days, F.lit(False)).cast("int").alias("stale"))


# ---- logs ----

def append_log(log: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The log with the new rows whose key it lacks: a repeated batch adds nothing."""
    return log.unionByName(new.join(log.select(key), key, "left_anti").dropDuplicates([key]).select(log.columns))


def trace_steps(traces: DataFrame, steps: dict[str, str]) -> DataFrame:
    """(trace, step, kind, latency_ms) of traces: one row for each column of ``steps`` that has a value, in their order."""
    parts = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(c).cast("long").alias("latency_ms"))) for k, c in steps.items()]))
    return traces.select("trace", F.posexplode(parts).alias("step", "s")).select("trace", "step", "s.kind", "s.latency_ms")


# ---- review ----

# The title and the action value of what comes to review.
REVIEW_TITLE, REVIEW_ACTION_VALUE = "潜在连接候选", 0.5


def review_candidates(found: DataFrame) -> DataFrame:
    """Review scores and the text shown of proactive connections (id, shared, sessions, events, event_date, novelty, risk, occurrences); rows
    without shared neighbours, sessions, novelty or risk are malformed and left out. Evidence is a count, persistence needs recurrence
    or both signals, and of the text only the date comes from outside, so it is checked."""
    ok = found.filter("shared is not null and sessions is not null and novelty is not null and risk is not null")
    session, event = (F.col("sessions") >= 1).cast("int"), (F.coalesce("events", F.lit(0)) >= 1).cast("int")
    again = F.least(F.greatest(F.floor("occurrences"), F.lit(0)), F.lit(2))
    text = F.concat(F.lit("两条记忆通过 "), F.col("shared").cast("string"), F.lit(" 个共同邻居与 "), F.col("sessions").cast("string"), F.lit(" 次共现形成连接，值得复盘是否建立显式关联。"))
    date = F.when(event == 1, I.display_safe(F.coalesce("event_date", F.lit("")), ""))
    return ok.select("id", (F.col("shared") + session + event).cast("long").alias("evidence"), (again + session * event).cast("long").alias("persistence"), "novelty", F.lit(REVIEW_ACTION_VALUE).alias("action_value"), F.col("risk").alias("trust_risk"), F.lit(REVIEW_TITLE).alias("title"), text.alias("summary"), date.alias("date_range"))
