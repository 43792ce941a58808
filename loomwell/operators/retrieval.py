"""Text, vector and hybrid retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions import exprs as X
from loomwell.operators import textindex
from loomwell.operators.relational import first_by

# Fixed values of the fusion and of the quality gate.
RRF_K = 60
ACTIVITY_WEIGHT, HOTNESS_WEIGHT = 0.15, 0.12
MIN_SCORE, STUB_FACTOR, RECORD_FACTOR = 0.01, 0.5, 0.5
BM25_K1, BM25_B = 1.2, 0.75


# ---- text ----

def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(float(len(part)))).cast("double")


def short_query_search(chunks: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Queries of fewer than 3 characters: rank tf / (1 + tf), best chunk of each page (ties: the first chunk)."""
    q = query.lower()
    tf = occurrences(F.lower("content"), q)
    hits = chunks.filter(F.lower("content").contains(q)).withColumn("score", tf / (1 + tf))
    best = hits.groupBy("page_slug").agg(F.max(F.struct("score", (-F.col("chunk_index")).alias("neg"))).alias("b"))
    return best.select(F.col("page_slug").alias("slug"), (-F.col("b.neg")).alias("chunk_index"), F.col("b.score").alias("score")).orderBy(F.desc("score"), "slug").limit(limit)


def fragments_search(chunks: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Fallback: up to 5 word fragments of at least 2 characters, summed term frequency."""
    parts = [w for w in query.lower().split() if len(w) >= 2][:5] or [query.lower()]
    tf = sum((occurrences(F.lower("content"), p) for p in parts), F.lit(0.0))
    hits = chunks.withColumn("tf", tf).filter("tf > 0")
    return hits.groupBy(F.col("page_slug").alias("slug")).agg(F.max(F.col("tf") / (1 + F.col("tf"))).alias("score")).orderBy(F.desc("score"), "slug").limit(limit)


def trigrams(query: str) -> list[str]:
    q = query.lower()
    return list(dict.fromkeys(q[i : i + 3] for i in range(len(q) - 2)))


def postings(chunks: DataFrame) -> DataFrame:
    """(term, slug, tf): how often each page has each trigram of its chunks, in lower case, without an index."""
    rows = textindex.scan(chunks, 0)
    names = rows.filter("term is null").select("block", F.posexplode("slugs").alias("page", "slug"))
    found = rows.filter("term is not null").select("term", "block", F.explode("page").alias("page")).groupBy("term", "block", "page").agg(F.count("*").alias("tf"))
    return found.join(names, ["block", "page"]).select("term", "slug", "tf")


def replace_postings(index: DataFrame, changed: DataFrame, chunks: DataFrame) -> DataFrame:
    """The postings after the pages ``changed`` (slug) got these chunks; pages without chunks leave the index."""
    return index.join(changed.select("slug"), "slug", "left_anti").select("term", "slug", "tf").unionByName(postings(chunks.join(changed.select(F.col("slug").alias("page_slug")), "page_slug", "left_semi")))


def trigram_search(index: textindex.TextIndex, query: str, limit: int = 20) -> DataFrame:
    """3 to 6 characters: the query as one phrase; longer: any of its trigrams. BM25 of pages, from the index alone: phrases are counted
    by positions."""
    if len(query) <= 6:
        found = index.phrases(query.lower()).withColumn("term", F.lit(query.lower()))
    else:
        found = index.counts(trigrams(query))
    sizes = found.groupBy("term").agg(F.count("*").alias("df"))
    stats = index.pages().agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    rows = found.join(F.broadcast(sizes), "term").crossJoin(F.broadcast(stats))  # a row for each of one query's terms, and one row
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("slug").agg(F.sum(part).alias("score")).orderBy(F.round("score", 9).desc(), "slug").limit(limit)


def index_coverage(pages: DataFrame, indexed: DataFrame) -> DataFrame:
    """Pages that the index misses, and index rows without a page."""
    missing = pages.select("slug").join(indexed.select("slug"), "slug", "left_anti").withColumn("state", F.lit("missing"))
    stale = indexed.select("slug").distinct().join(pages.select("slug"), "slug", "left_anti").withColumn("state", F.lit("stale"))
    return missing.unionByName(stale)


# What carries detail in a question: ids, dates, numbers with units, long numbers, Latin words.
DETAIL_PATTERNS = [
    r"[A-Za-z]+[A-Za-z0-9]*[-/][A-Za-z0-9]+", r"[A-Za-z]+\d+", r"\d{4}[-/]\d{1,2}[-/]\d{1,2}", r"\d+(?:\.\d+)?(?:万元|亿元|万|亿|%|元|岁|年|度|次|个|人|k|m)?", r"\d{2,}", r"[A-Za-z]{2,}",
]
HAN_RUN = "[一-鿿]+"


def detail_terms(text: Column, most: int = 12) -> Column:
    """Terms that carry detail: the patterns', then Han runs of two characters, and the 3-grams of longer ones. Distinct, of two characters
    or more, longest first (else in order)."""
    classes = [F.filter(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)), lambda t: F.length(t) >= 2) for p in DETAIL_PATTERNS]
    runs = F.regexp_extract_all(text, F.lit(f"({HAN_RUN})"), F.lit(1))
    grams = lambda r: F.when(F.length(r) == 2, F.array(r)).when(F.length(r) < 3, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 2, F.lit(1))), lambda i: F.substring(r, i, F.lit(3))))
    found = F.array_distinct(F.concat(*classes, F.flatten(F.transform(runs, grams))))
    ranked = F.array_sort(F.transform(found, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x"))))
    return F.slice(F.transform(ranked, lambda s: s["x"]), 1, most)


def dominant_hit(scored: DataFrame, least_coverage: float = 0.4, ratio: float = 2.0) -> DataFrame:
    """The top row (slug, coverage, score), if it covers enough and scores ``ratio`` times the runner-up; else none."""
    w = Window.orderBy(F.desc("score"), "slug")
    top = scored.orderBy(F.desc("score"), "slug").limit(2).withColumn("next", F.lead("score").over(w)).withColumn("rn", F.row_number().over(w))
    return top.filter((F.col("rn") == 1) & (F.col("coverage") >= least_coverage) & (F.col("next").isNull() | (F.col("score") >= ratio * F.col("next")))).select("slug", "coverage", "score")


def quality_gate(results: DataFrame, stubs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Halve the score of bare stubs, then drop low scores; exact hits are exempt."""
    marked = results.join(stubs.select("slug", F.lit(True).alias("stub")), "slug", "left")
    score = F.when(F.col("stub") & ~F.col("exact"), F.col("score") * STUB_FACTOR).otherwise(F.col("score"))
    return marked.withColumn("score", score).filter(F.col("exact") | (F.col("score") >= min_score)).drop("stub")


def admission(support: DataFrame, least_cosine: float = 0.8, least_coverage: float = 0.6) -> DataFrame:
    """Why a hit (exact, cosine, coverage, derived) is admitted; null if it is not."""
    reason = F.when(F.col("exact"), "exact").when(F.col("cosine") >= least_cosine - 1e-6, "semantic").when(F.col("coverage") >= least_coverage, "lexical").when(F.col("derived") & (F.col("coverage") >= 1.0), "derived_exact")
    return support.withColumn("reason", reason)


def best_section(pages: DataFrame, terms: Sequence[str], width: int = 500) -> DataFrame:
    """The section (parted by '## ') of each page with the most weight of query terms, a term weighing 1 / its frequency."""
    sections = pages.select("slug", F.posexplode(F.split("body", r"(?m)^## ")).alias("pos", "section"))
    weights = [F.when(F.lower("section").contains(t.lower()), 1.0 / max(1, sum(x.lower() == t.lower() for x in terms))).otherwise(0.0) for t in dict.fromkeys(terms)]
    scored = sections.withColumn("score", sum(weights, F.lit(0.0)))
    return first_by(scored, ["slug"], F.desc("score"), "pos").select("slug", "pos", "score", F.substring("section", 1, width).alias("passage"))


def evidence_pack(slugs: DataFrame, timeline: DataFrame, links: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per slug at most 3 events, 5 links and 3 raw chunks, and a status: sufficient (all kinds), partial or insufficient."""
    e = first_by(timeline.filter(X.active_link()), ["page_slug"], F.col("event_date").desc_nulls_last(), F.desc("id"), n=3).groupBy(F.col("page_slug").alias("slug")).agg(F.count("*").alias("events"))
    ends = links.filter(X.current_fact()).select(F.explode(F.array("from_slug", "to_slug")).alias("slug"), "link_key", "weight")
    n = first_by(ends, ["slug"], F.desc("weight"), "link_key", n=5).groupBy("slug").agg(F.count("*").alias("links"))
    c = first_by(chunks.filter("summary_level = 0"), ["page_slug"], "chunk_index", n=3).groupBy(F.col("page_slug").alias("slug")).agg(F.count("*").alias("chunks"))
    out = slugs.join(e, "slug", "left").join(n, "slug", "left").join(c, "slug", "left").fillna(0)
    kinds = sum((F.col(k) > 0).cast("int") for k in ("events", "links", "chunks"))
    return out.withColumn("status", F.when(kinds == 3, "sufficient").when(kinds > 0, "partial").otherwise("insufficient"))


# ---- vectors ----

def nearest(vectors: DataFrame, query: Sequence[float], k: int, metric: str = "l2") -> DataFrame:
    """The k nearest rows by squared L2 distance or 1 - cosine; ties by vec_id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = X.squared_l2(F.col("vector"), q) if metric == "l2" else 1 - X.cosine(F.col("vector"), q)
    return vectors.withColumn("distance", d).filter("distance is not null").orderBy("distance", "vec_id").limit(k)


def vector_pages(vectors: DataFrame, query: Sequence[float], n: int, excluded: DataFrame | None = None) -> DataFrame:
    """Pages by vector search: excluded pages go before the top-k, so no second fetch is needed."""
    if excluded is not None:
        vectors = vectors.join(excluded.select(F.col("slug").alias("page_slug")), "page_slug", "left_anti")
    hits = nearest(vectors, query, 3 * n, "cosine").select(F.col("page_slug").alias("slug"), "chunk_index", "distance")
    from loomwell.operators.relational import best_chunks

    return best_chunks(hits, n).withColumn("score", 1 - F.col("distance"))


SHORTLIST_NAMES, SHORTLIST_TITLES, SHORTLIST_LENGTH = 20, 500, 10


def typed_shortlist(names: DataFrame, titles: DataFrame, affine, least: float = 0.5) -> DataFrame:
    """Of names (a, type, vector) and titles (b, type, vector) whose types are the same or affine, the ten most similar titles of each name
    with a cosine of ``least``. A model's prompt has room for this much: the first 20 names and 500 titles are looked at."""
    x = names.orderBy("a").limit(SHORTLIST_NAMES).select("a", F.col("type").alias("ta"), F.col("vector").alias("va"))
    y = titles.orderBy("b").limit(SHORTLIST_TITLES).select("b", F.col("type").alias("tb"), F.col("vector").alias("vb"))
    both = y.join(F.broadcast(x), (F.col("ta") == F.col("tb")) | affine(F.col("ta"), F.col("tb")))  # 20 rows
    near = both.withColumn("cosine", X.plain_cosine(F.col("va"), F.col("vb"))).filter(F.col("cosine") >= least)
    return first_by(near, ["a"], F.round("cosine", 9).desc(), "b", n=SHORTLIST_LENGTH).select("a", "b", "cosine")


def width_check(vectors: DataFrame) -> DataFrame:
    """One row: rows, distinct widths, rows that could not be stored (null, empty or non-finite)."""
    good = F.coalesce(X.finite(F.col("vector")) & (F.size("vector") > 0), F.lit(False))
    return vectors.agg(F.count("*").alias("rows"), F.count_distinct(F.size("vector")).alias("widths"), F.sum((~good).cast("long")).alias("bad"))


# ---- fusion ----

def fuse(hits: DataFrame, weights: DataFrame, limit: int = 20, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of hits (channel, variant, slug, score): every occurrence of a slug in a list counts; the pages'
    activity and hotness are added. Ties go by slug."""
    w = Window.partitionBy("channel", "variant").orderBy(F.desc("score"), "slug")
    ranked = hits.withColumn("rank", F.row_number().over(w))
    fused = ranked.groupBy("slug").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.count("*").alias("hits"), F.max("score").alias("best"))
    boosted = fused.join(weights.select("slug", "activity_weight", "hotness_score"), "slug", "left").fillna(0.0, ["activity_weight", "hotness_score"])
    score = F.col("rrf") + ACTIVITY_WEIGHT * F.col("activity_weight") + HOTNESS_WEIGHT * F.col("hotness_score")
    return boosted.select("slug", score.alias("score"), "hits", "best").orderBy(F.desc("score"), "slug").limit(limit)


def recall_ranking(results: DataFrame, stubs: DataFrame, exact: DataFrame, limit: int = 20) -> DataFrame:
    """Recall's last order of results (slug, score): the quality gate on the raw score, then record pages count half, pages that the question
    names (slug) count 1 and come in even if no channel found them, and all are ranked anew. ``position`` is for the learning log."""
    named = exact.select("slug").distinct().withColumn("exact", F.lit(True))
    marked = results.select("slug", "score").join(named, "slug", "full_outer").withColumn("exact", F.coalesce("exact", F.lit(False))).fillna(0.0, ["score"])
    gated = quality_gate(marked, stubs)
    score = F.when(F.col("exact"), 1.0).when(F.col("slug").startswith("records/"), F.col("score") * RECORD_FACTOR).otherwise(F.col("score"))
    top = gated.withColumn("score", score).orderBy(F.desc("score"), "slug").limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "slug")))  # of ``limit`` rows


def learning_log(ranked: DataFrame, log: DataFrame, query_id: int, tool: str, at: str) -> DataFrame:
    """The hit log (id, tool, slug, pos, created_at) with a question's results appended, once."""
    new = ranked.select(F.lit(query_id).cast("long").alias("id"), F.lit(tool).alias("tool"), "slug", F.col("position").cast("int").alias("pos"), X.ts(at).alias("created_at"))
    return log.select(new.columns).unionByName(new.join(log.select("id", "slug"), ["id", "slug"], "left_anti").select(new.columns))


# Words that join, words that ask, and limits.
CONJUNCTIONS = ["和", "与", "跟", "以及"]
QUESTION_WORDS = ["什么", "哪些", "怎么", "如何"]
ENOUGH_TEXT_HITS, MOST_SUB_QUERIES, MOST_VARIANTS = 3, 5, 3
WORD_BREAK = r"[\s,，、；;]+"


def complex_question(query: Column, known: Column) -> Column:
    """Two known pages, a conjunction, two question words, or three words of two characters or more."""
    asked = sum((query.contains(w).cast("int") for w in QUESTION_WORDS), F.lit(0))
    joined = F.lit(False)
    for w in CONJUNCTIONS:
        joined = joined | query.contains(w)
    return (F.trim(query) != "") & ((known >= 2) | joined | (asked >= 2) | (F.size(F.filter(F.split(query, WORD_BREAK), lambda w: F.length(w) >= 2)) >= 3))


def search_plan(questions: DataFrame, text_hits: DataFrame, parts: DataFrame, variants: DataFrame) -> DataFrame:
    """The texts to search for each of questions (id, query, known): the question itself; if fewer than three pages hold its words, then a
    complex one's parts (id, pos, text; five at most), or else its variants (as parts; three at most). Answers of a model come as
    ``parts`` and ``variants``; without them, and for those that time out, the question stays alone."""
    hits = text_hits.groupBy("id").agg(F.count_distinct("slug").alias("hits"))
    q = questions.join(hits, "id", "left").fillna(0, ["hits"]).withColumn("complex", complex_question(F.col("query"), F.col("known")))
    thin = q.filter(F.col("hits") < ENOUGH_TEXT_HITS)
    good = lambda t, n: first_by(t.filter(F.trim("text") != ""), ["id"], "pos", n=n).select("id", "pos", "text")
    derived = thin.filter("complex").select("id").join(good(parts, MOST_SUB_QUERIES), "id").select("id", F.lit("part").alias("origin"), "pos", "text")
    wider = thin.join(derived.select("id").distinct(), "id", "left_anti").select("id").join(good(variants, MOST_VARIANTS), "id").select("id", F.lit("variant").alias("origin"), "pos", "text")
    own = q.join(derived.select("id").distinct(), "id", "left_anti").select("id", F.lit("original").alias("origin"), F.lit(0).alias("pos"), F.col("query").alias("text"))
    return own.unionByName(derived).unionByName(wider)


def channel(name: str, hits: DataFrame, variant: str = "original") -> DataFrame:
    return hits.select(F.lit(name).alias("channel"), F.lit(variant).alias("variant"), "slug", F.col("score").cast("double").alias("score"))


def temporal_hits(timeline: DataFrame, query: str, since: str | None = None, limit: int = 20) -> DataFrame:
    """Active events whose summary contains the query (any case), newest first; score 0.5 each."""
    use = timeline.filter(X.active_link() & F.lower("summary").contains(query.lower()))
    if since:
        use = use.filter(F.col("event_date") >= since)
    return use.orderBy(F.col("event_date").desc_nulls_last(), F.desc("id")).limit(limit).select(F.col("page_slug").alias("slug"), F.lit(0.5).alias("score"), "id", "event_date")


def strongest_support(support: DataFrame) -> DataFrame:
    """Per slug, channel and origin the strongest (cosine, coverage, then better rank)."""
    return support.groupBy("slug", "channel", "origin").agg(F.max(F.struct("cosine", "coverage", (-F.col("rank")).alias("neg_rank"))).alias("s")).select("slug", "channel", "origin", "s.cosine", "s.coverage", (-F.col("s.neg_rank")).alias("rank"))


def reason_codes(log: DataFrame, low: float = 0.15, slow_ms: int = 2000) -> DataFrame:
    """Degradation codes of each search (top_score, hit_count, latency_ms, parser_ok)."""
    codes = F.array_compact(F.array(
        F.when(F.col("hit_count") == 0, "no_hits"), F.when((F.col("hit_count") > 0) & (F.col("top_score") < low), "low_score"), F.when(F.col("latency_ms") > slow_ms, "latency_warning"), F.when(~F.col("parser_ok"), "parser_fallback"),
    ))
    return log.withColumn("codes", F.array_join(codes, ","))


# ---- episodes and evidence ----

# Weights of the clues, and the bonus of a further one.
EPISODE_WEIGHTS = {"time": 0.30, "topic": 0.25, "event": 0.15, "relation": 0.15, "context": 0.15}
EPISODE_BONUS = 0.1


def episode_scores(clues: DataFrame, least: float = 0.0, limit: int = 8) -> DataFrame:
    """Persons ranked by their clue scores (columns named as the weights, in 0..1): weighted sum, times 1 + bonus for each
    further clue that matches, at most 1; confidence high from .6, medium from .3."""
    total = sum((w * F.col(c) for c, w in EPISODE_WEIGHTS.items()), F.lit(0.0))
    n = sum((F.col(c) > 0).cast("int") for c in EPISODE_WEIGHTS)
    score = F.least(F.lit(1.0), total * (1 + EPISODE_BONUS * F.greatest(n - 1, F.lit(0))))
    out = clues.withColumn("score", score).filter(F.col("score") > least)
    level = F.when(F.col("score") >= 0.6, "high").when(F.col("score") >= 0.3, "medium").otherwise("low")
    return out.withColumn("confidence", level).orderBy(F.desc("score"), "slug").limit(limit)


def evidence_board(claims: DataFrame) -> DataFrame:
    """Claims (slug, claim, trust) without repeats, as facts, thoughts or candidates; a candidate that no fact states is a gap."""
    kind = F.when(F.col("trust").isNull() | (F.col("trust") == "trusted"), "fact").when(F.col("trust") == "user_thought", "thought").when(F.col("trust") == "candidate", "candidate")
    board = claims.withColumn("kind", kind).filter("kind is not null").select("slug", "claim", "kind").distinct()
    facts = board.filter("kind = 'fact'").select("slug", "claim", F.lit(True).alias("stated"))
    marked = board.join(facts, ["slug", "claim"], "left")
    return marked.select("slug", "claim", "kind", ((F.col("kind") == "candidate") & F.col("stated").isNull()).cast("int").alias("gap"))


def conflicts(claims: DataFrame) -> DataFrame:
    """Claims that differ only in negation markers, with at least two wordings."""
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower("claim"), r"\b(not|no|never|n't)\b|不是|没有|不|未", " "), r"\s+", " "))
    return claims.withColumn("key", key).groupBy("slug", "key").agg(F.count_distinct("claim").alias("wordings"), F.count("*").alias("items")).filter("wordings >= 2 AND items >= 2")


def shared_neighbour_hints(neighbours: DataFrame, seeds: DataFrame, least: float = 0.5) -> DataFrame:
    """Nodes that two seeds or more share; score 1 - owners / 10, floored at 0."""
    own = neighbours.join(seeds, "slug").groupBy("neighbour").agg(F.count("*").alias("owners")).filter("owners >= 2")
    return own.withColumn("score", F.greatest(F.lit(0.0), 1 - F.col("owners") / 10.0)).filter(F.col("score") >= least)
