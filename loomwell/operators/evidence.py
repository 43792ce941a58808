"""Further operators on evidence, facts, ingestion and maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions import exprs as X
from loomwell.operators.relational import first_by, pairs_within


def sealed_hits(chunks: DataFrame, terms: list[str], pages: int = 5, hits: int = 3, width: int = 200) -> DataFrame:
    """Raw hits of pages that have a summary: terms without Han characters first, then in order; the best few of a few pages."""
    ordered = sorted(terms, key=lambda t: any("㐀" <= c <= "鿿" for c in t))
    rank = F.coalesce(*[F.when(F.lower("content").contains(t.lower()), F.lit(i)) for i, t in enumerate(ordered)])
    sealed = chunks.filter("summary_level = 1").select("page_slug").distinct()
    found = chunks.filter("summary_level = 0").join(sealed, "page_slug", "left_semi").withColumn("rank", rank).filter("rank is not null")
    top = found.groupBy("page_slug").agg(F.min("rank").alias("best")).orderBy("best", "page_slug").limit(pages)
    return first_by(found.join(top.select("page_slug"), "page_slug"), ["page_slug"], "rank", "chunk_index", n=hits).withColumn("snippet", F.substring("content", 1, width))


def key_points(text: Column, most: int = 6, width: int = 80) -> Column:
    """Headings; if there are none, bold items; else bullets: at most 6 of 80 characters."""
    get = lambda p: F.filter(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda x: F.substring(F.trim(x), 1, width)), lambda x: x != "")
    heads, bold, bullets = get(r"(?m)^#{2,4} +(.+)$"), get(r"\*\*([^*\n]+)\*\*"), get(r"(?m)^[-*] +(.+)$")
    return F.slice(F.when(F.size(heads) > 0, heads).when(F.size(bold) > 0, bold).otherwise(bullets), 1, most)


def leading_anchor(hits: DataFrame, query: str, share: float = 0.6, ratio: float = 2.0) -> DataFrame:
    """The page (slug, score, hits, text) whose compact text holds the first four Han characters of the query, with two hits or more, if
    its score is at least ``share`` of the top and ``ratio`` times the runner-up among such pages."""
    han = "".join(c for c in query if "㐀" <= c <= "鿿")[:4]
    top = hits.agg(F.max("score").alias("top"))
    good = hits.filter((F.instr(F.regexp_replace("text", r"\s+", ""), han or " ") > 0) & (F.col("hits") >= 2)) if len(han) == 4 else hits.limit(0)
    w = Window.orderBy(F.desc("score"), "slug")
    two = good.orderBy(F.desc("score"), "slug").limit(2).withColumn("next", F.lead("score").over(w)).withColumn("rn", F.row_number().over(w))
    return two.crossJoin(F.broadcast(top)).filter((F.col("rn") == 1) & (F.col("score") >= share * F.col("top")) & (F.col("next").isNull() | (F.col("score") >= ratio * F.col("next")))).select("slug", "score")


def cosine_margin(scored: DataFrame, least: float = 0.6, margin: float = 1.05) -> DataFrame:
    """The best page by cosine, if there are two, it reaches ``least`` and ``margin`` times the runner-up."""
    best = scored.groupBy("slug").agg(F.max("cosine").alias("cosine")).orderBy(F.desc("cosine"), "slug").limit(2)
    w = Window.orderBy(F.desc("cosine"), "slug")
    return best.withColumn("next", F.lead("cosine").over(w)).filter((F.col("cosine") >= least) & (F.col("cosine") >= margin * F.col("next"))).select("slug", "cosine")


def grounded_answer(board: DataFrame) -> DataFrame:
    """Per slug what may be claimed: facts, thoughts, gaps (unconfirmed), and how many candidates must not be."""
    n = lambda c: F.count(F.when(c, 1))
    return board.groupBy("slug").agg(
        n(F.col("kind") == "fact").alias("facts"), n(F.col("kind") == "thought").alias("thoughts"), n(F.col("gap") == 1).alias("unresolved"), n(F.col("kind") == "candidate").alias("must_not_claim"),
        F.min(F.when(F.col("kind") == "fact", F.col("claim"))).alias("first_fact"),
    )


def current_state_gap(subjects: DataFrame, links: DataFrame, timeline: DataFrame, links_read: int = 10, events_read: int = 5) -> DataFrame:
    """What is missing to answer for a subject's present state: identity, relation or state; with the trusted dated events of the subject and
    of its trusted neighbours, of which ten links and five events, the newest, are read."""
    use = links.filter(X.current_fact() & (F.col("trust_state") == "trusted") & (F.col("from_slug") != F.col("to_slug")))
    both = use.select(F.col("from_slug").alias("slug"), F.col("to_slug").alias("page_slug"), "link_key").unionByName(use.select(F.col("to_slug").alias("slug"), F.col("from_slug").alias("page_slug"), "link_key"))
    near = first_by(both.join(subjects.select("slug"), "slug", "left_semi"), ["slug"], "link_key", n=links_read)
    rel = near.groupBy("slug").agg(F.count("*").alias("relations"))
    dated = timeline.filter(F.col("trust_state").isin("trusted", "user_thought") & X.valid_date())
    around = near.select("slug", "page_slug").unionByName(subjects.select("slug", F.col("slug").alias("page_slug"))).distinct()
    read = first_by(around.join(dated, "page_slug"), ["slug"], F.trim("event_date").desc(), F.desc("id"), n=events_read)
    ev = read.groupBy("slug").agg(F.count("*").alias("events"), F.max(F.struct(F.trim("event_date").alias("d"), "id")).alias("last"))
    out = subjects.join(rel, "slug", "left").join(ev, "slug", "left").fillna(0, ["relations", "events"])
    out = out.withColumn("events", F.when(F.col("known") == 0, 0).otherwise(F.col("events")))
    code = F.when(F.col("known") == 0, "identity_mapping").when(F.col("relations") == 0, "subject_relation").otherwise("structured_state")
    return out.select("slug", code.alias("gap"), "events", F.when(F.col("events") > 0, F.col("last.id")).alias("last_event"))


def reflection(found: DataFrame, pages: DataFrame, timeline: DataFrame) -> DataFrame:
    """What a reflection on structural discoveries (a, b, kind, actionable) has to say something about: those that are not low, with their
    titles and the active events of both pages; without any, a text about them is not grounded. The text comes from a model
    (``plans.models.ask`` over ``prompt``)."""
    use = found.filter("actionable <> 'low'")
    name = lambda end: pages.select(F.col("slug").alias(end), F.col("title").alias(f"{end}_title"))
    n = timeline.filter(X.active_link()).groupBy(F.col("page_slug").alias("slug")).agg(F.count("*").alias("n"))
    events = use.select("a", "b", F.explode(F.array("a", "b")).alias("slug")).join(n, "slug").groupBy("a", "b").agg(F.sum("n").alias("events"))
    out = use.join(name("a"), "a", "left").join(name("b"), "b", "left").join(events, ["a", "b"], "left").fillna(0, ["events"])
    title = F.concat(F.coalesce("a_title", "a"), F.lit(" / "), F.coalesce("b_title", "b"))
    prompt = F.concat_ws("\n", F.col("kind"), F.concat(F.lit("distance "), F.col("distance").cast("string")), title)
    return out.withColumn("title", title).withColumn("prompt", prompt).withColumn("grounded", (F.col("events") > 0).cast("int"))


def semantic_matches(pairs: DataFrame, least: float = 0.7) -> DataFrame:
    """Best match (a, b, confidence) of each new name among candidates of a fitting type."""
    return first_by(pairs.filter((F.col("confidence") >= least) & F.col("type_fits")), ["a"], F.desc("confidence"), "b")


# Characters that carry no content, negations, and states that exclude each other (positive, negative).
STOP_CHARACTERS = [
    "的", "了", "在", "是", "和", "与", "也", "都", "被", "从", "到", "对", "为", "以", "及", "等", "或", "但", "而", "这", "那", "他", "她", "它", "我", "你", "很", "就",
    "才", "会", "能", "要", "一", "个", "些", "着", "过", "把", "让", "上", "下", "中", "里", "外", "前", "后",
]
NEGATIONS = ["不", "没", "无", "非", "未", "别", "勿", "莫"]
OPPOSITES = [(["职", "任职", "在职"], ["离职", "离", "卸任"]), (["负责"], ["不再负责", "卸任"]), (["进行", "进行中"], ["结束", "已结束", "终止"]), (["有效"], ["失效", "无效"]), (["属于"], ["不属于"])]


def context_conflicts(contexts: DataFrame, overlap: float = 0.2, least: int = 3) -> DataFrame:
    """Pairs (slug, a, b) of records whose contexts (slug, record, text) on a page contradict each other: their sets of content characters
    share at least ``overlap`` of the smaller, and one alone is negated, or both name states that exclude each other. Contexts with
    fewer than ``least`` characters say nothing.

    The verdict depends on a context's characters and states only, so contexts that are alike meet others once, and pages with many
    contexts are cut into blocks."""
    chars = F.filter(F.split("text", ""), lambda c: (c != "") & ~c.rlike(r"[\s，。、；：！？]") & ~c.isin(*STOP_CHARACTERS))
    joined = F.array_join("chars", "")
    any_of = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: joined.contains(w))
    states = F.array(*[F.when(any_of(no), 2).when(any_of(yes), 1).otherwise(0) for yes, no in OPPOSITES])
    c = contexts.withColumn("chars", chars).filter(F.size("chars") >= least)
    c = c.select("slug", "record", F.array_sort(F.array_distinct("chars")).alias("set"), F.arrays_overlap("chars", F.array(*[F.lit(x) for x in NEGATIONS])).alias("neg"), states.alias("states"))
    c = c.withColumn("like", F.md5(F.concat_ws("|", F.array_join("set", ""), F.col("neg").cast("string"), F.array_join(F.transform("states", lambda s: s.cast("string")), ""))))
    alike = c.dropDuplicates(["slug", "like"]).select("slug", "like", "set", "neg", "states")
    both = pairs_within(alike, "slug", "like", ["set", "neg", "states"])
    common = F.size(F.array_intersect("a_set", "b_set")) >= overlap * F.least(F.size("a_set"), F.size("b_set"))
    excluded = F.exists(F.arrays_zip("a_states", "b_states"), lambda z: (z["a_states"] > 0) & (z["b_states"] > 0) & (z["a_states"] != z["b_states"]))
    verdict = both.filter(common & ((F.col("a_neg") != F.col("b_neg")) | excluded)).select("slug", "a", "b")
    one = c.select("slug", "like", "record")
    rows = verdict.join(one.select("slug", F.col("like").alias("a"), F.col("record").alias("ra")), ["slug", "a"]).join(one.select("slug", F.col("like").alias("b"), F.col("record").alias("rb")), ["slug", "b"])
    return rows.select("slug", F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))


# What repairs a finding, and whether it runs by itself.
REPAIRS = [("islands", "review", "link_or_archive"), ("stubs", "observe", "enrich"), ("titles", "auto", "derive_title"), ("dangling", "auto", "create_stub")]


def repair_plan(issues: DataFrame) -> DataFrame:
    """Findings (dimension, ...; with n, if a row stands for several) grouped with their mode and action; unknown dimensions are blocked."""
    dim = issues.sparkSession.createDataFrame(REPAIRS, "dimension string, mode string, action string")
    n = F.sum("n") if "n" in issues.columns else F.count("*")
    return issues.groupBy("dimension").agg(n.alias("n")).join(F.broadcast(dim), "dimension", "left").fillna({"mode": "blocked", "action": "none"})


def stale_seals(chunks: DataFrame, seals: DataFrame) -> DataFrame:
    """Pages whose raw chunks changed since they were sealed (slug, sealed_hash), or that have no seal."""
    now = chunks.filter("summary_level = 0").groupBy(F.col("page_slug").alias("slug")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", F.sha2("content", 256).alias("h")))), lambda x: x["h"]), "\n"), 256).alias("hash"))
    return now.join(seals, "slug", "left").filter(F.col("sealed_hash").isNull() | (F.col("sealed_hash") != F.col("hash"))).select("slug", F.when(F.col("sealed_hash").isNull(), "unsealed").otherwise("changed").alias("state"))


def best_facts(facts: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """Of facts (slug, type, field, value, confidence) the surest of each allowed field; ties by value."""
    allowed = F.lit(False)
    for kind, names in fields.items():
        allowed = allowed | ((F.col("type") == kind) & F.col("field").isin(*names))
    return first_by(facts.filter(allowed), ["slug", "field"], F.desc("confidence"), "value")


def ingest_outcomes(items: DataFrame, existing: DataFrame) -> DataFrame:
    """Items (id, title, hash) as duplicate (known content), updated (known title) or created."""
    h, t = existing.select("hash").distinct().withColumn("dup", F.lit(1)), existing.select("title").distinct().withColumn("same", F.lit(1))
    out = items.join(h, "hash", "left").join(t, "title", "left")
    return out.select("id", F.when(F.col("dup") == 1, "duplicate").when(F.col("same") == 1, "updated").otherwise("created").alias("outcome"))


def stale_stubs(stubs: DataFrame, sources: DataFrame) -> DataFrame:
    """Stubs (slug, title, source_slug) whose source text no longer names them."""
    return stubs.join(sources.select(F.col("slug").alias("source_slug"), F.col("text").alias("source_text")), "source_slug", "left").filter(F.col("source_text").isNull() | ~F.col("source_text").contains(F.col("title"))).select("slug")


def rule_flags(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Counts of rows that break each named rule."""
    flags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return rows.select(F.explode(flags).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
