"""Entity resolution, scoring, discovery, state merges and text structuring."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions import exprs as X
from loomwell.operators.relational import endpoints, first_by, p95_by_offset

# ---- names ----


def blocking_keys(title: Column) -> Column:
    """Keys of a title: normalised form, Latin or digit words of 2+ characters, bigrams of CJK runs, acronym."""
    low = F.lower(title)
    words = F.regexp_extract_all(low, F.lit(r"([a-z0-9]{2,})"), F.lit(1))
    runs = F.regexp_extract_all(low, F.lit(r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]+)"), F.lit(1))
    grams = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))
    acronym = F.when(F.size(words) >= 2, F.array(F.concat(F.lit("acr:"), F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_distinct(F.concat(F.array(X.normal_name(title)), words, grams, acronym)), lambda k: k != "")


def candidate_pairs(pages: DataFrame, most: int = 50) -> DataFrame:
    """Pairs (a, b) of pages that share a blocking key; keys of more than ``most`` pages are no keys (a rule of the method, a
    parameter here: such keys name no entity)."""
    keys = pages.select("slug", "title", "type", F.explode(blocking_keys(F.col("title"))).alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("n") <= most))
    keys = keys.join(sizes.select("key"), "key")
    a, b = keys.alias("a"), keys.alias("b")
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.slug") < F.col("b.slug"))).select(
        F.col("a.slug").alias("a"), F.col("b.slug").alias("b"), F.col("a.title").alias("ta"), F.col("b.title").alias("tb"), F.col("a.type").alias("ya"), F.col("b.type").alias("yb")).distinct()


def classify_pairs(pairs: DataFrame, edits: int = 2) -> DataFrame:
    """How two titles are alike: exact, normalised (.95), substring (.6 + .3 * ratio) or within an edit distance."""
    na, nb = X.normal_name(F.col("ta")), X.normal_name(F.col("tb"))
    short, long = F.when(F.length(na) <= F.length(nb), na).otherwise(nb), F.when(F.length(na) <= F.length(nb), nb).otherwise(na)
    contained = long.contains(short) & (F.length(short) >= 2) & ((F.length(long) - F.length(short) >= 3) | (F.length(short) >= 0.6 * F.length(long)))
    d = F.levenshtein(na, nb, edits)
    kind = F.when(F.col("ta") == F.col("tb"), "exact").when(na == nb, "normalized").when(contained, "substring").when((d >= 0) & (d <= edits), "edit")
    score = F.when(kind == "exact", 1.0).when(kind == "normalized", 0.95).when(kind == "substring", 0.6 + 0.3 * F.length(short) / F.length(long)).when(kind == "edit", 1.0 - d / F.greatest(F.length(long), F.lit(1)))
    return pairs.withColumn("kind", kind).filter("kind is not null").withColumn("score", score).withColumn("actionable", ((kind.isin("exact", "normalized")) & (F.col("ya") == F.col("yb"))).cast("int"))


def ranked_candidates(pairs: DataFrame, most: int = 100) -> DataFrame:
    """Classified pairs in the order in which they are shown: sure ones, the more alike, those of one type first, then by name."""
    return pairs.orderBy(F.desc("actionable"), F.round("score", 9).desc(), (F.col("ya") == F.col("yb")).desc(), "a", "b").limit(most)


def merge_targets(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Which page of a pair (a, b) to keep: the first difference of (chars, chunks, degree, mentions, shorter title) decides;
    no difference is ambiguous. facts: slug and these columns."""
    cols = ("body_chars", "chunk_count", "degree", "mention_count", "title_score")
    fa, fb = facts.select(F.col("slug").alias("a"), F.struct(*cols).alias("fa")), facts.select(F.col("slug").alias("b"), F.struct(*cols).alias("fb"))
    both = pairs.join(fa, "a").join(fb, "b")
    return both.withColumn("target", F.when(F.col("fa") > F.col("fb"), F.col("a")).when(F.col("fb") > F.col("fa"), F.col("b"))).drop("fa", "fb")


def intra_document_names(candidates: DataFrame, affine=None) -> DataFrame:
    """(doc, name, canonical) of candidates (doc, pos, name, type): names of one normal form are one; then a form that begins a later one
    or is begun by it, has two characters or more and half of its length, and a fitting type, joins the longer. The rule goes through
    a document's forms in their order, so each document is one group. ``affine``: pairs of types that fit besides equal ones."""
    import pandas as pd

    fits = frozenset(affine or ())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: dict[str, list[tuple[str, str]]] = {}
        for form, name, kind in pdf.sort_values("pos")[["form", "name", "type"]].itertuples(index=False):
            groups.setdefault(form, []).append((name, kind))
        forms = list(groups)
        for i, a in enumerate(forms):
            for b in forms[i + 1 :]:
                if a not in groups:
                    break
                if b not in groups:
                    continue
                short, long = (a, b) if len(a) <= len(b) else (b, a)
                if len(short) < 2 or not long.startswith(short) or 2 * len(short) < len(long):
                    continue
                x, y = groups[short][0][1], groups[long][0][1]
                if x == y or (x, y) in fits or (y, x) in fits:
                    groups[long] += groups.pop(short)
        rows = [(name, max(members, key=lambda m: len(m[0]))[0]) for members in groups.values() for name, _ in members]
        return pd.DataFrame({"doc": pdf["doc"].iloc[0], "name": [r[0] for r in rows], "canonical": [r[1] for r in rows]}).drop_duplicates()

    keyed = candidates.withColumn("form", X.normal_name(F.col("name"))).filter("form <> ''")
    return keyed.select(F.col("doc").cast("string"), F.col("pos").cast("long"), "name", "type", "form").groupBy("doc").applyInPandas(run, "doc string, name string, canonical string")


def layered_match(names: DataFrame, pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """Resolution by layers: exact 1.0, alias .95, any case .9, normalised .8, else new. Ties go by slug."""
    p = pages.select("slug", "title")
    layers = [
        names.join(p, F.col("name") == F.col("title")).select("name", "slug", F.lit("exact").alias("layer"), F.lit(1.0).alias("confidence")),
        names.join(aliases, F.col("name") == F.col("alias")).select("name", F.col("page_slug").alias("slug"), F.lit("alias").alias("layer"), F.lit(0.95).alias("confidence")),
        names.withColumn("k", F.lower("name")).join(p.withColumn("k", F.lower("title")), "k").select("name", "slug", F.lit("case").alias("layer"), F.lit(0.9).alias("confidence")),
        names.withColumn("k", X.normal_name(F.col("name"))).filter("k <> ''").join(p.withColumn("k", X.normal_name(F.col("title"))), "k").select("name", "slug", F.lit("normalized").alias("layer"), F.lit(0.8).alias("confidence")),
    ]
    hits = layers[0]
    for x in layers[1:]:
        hits = hits.unionByName(x)
    best = first_by(hits, ["name"], F.desc("confidence"), "slug")
    return names.join(best, "name", "left").withColumn("layer", F.coalesce("layer", F.lit("new")))


# Fixed value: punctuation that becomes a hyphen in slugs.
SLUG_PUNCTUATION = "[：，。！？、；·…—～“”‘’（）()【】《》〈〉「」『』.,!?;:\"']"


def slug_name(title: Column) -> Column:
    """Lower-case name with hyphens for punctuation and spaces; Han, letters a-z and digits stay; a hash where nothing is left."""
    t = F.regexp_replace(title, SLUG_PUNCTUATION, "-")
    t = F.regexp_replace(F.lower(t), r"[^\p{IsHan}a-z0-9\s-]", "")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(t), r"\s+", "-"), r"-+", "-"), r"^-|-$", "")
    return F.when(t.rlike(r"[\p{IsHan}a-z0-9]"), t).otherwise(F.concat(F.lit("untitled-"), F.substring(F.md5(title), 1, 8)))


# ---- scoring ----

# Worth of a query by tool, and daily decay.
TOOL_VALUE = {"recall": 1.0, "query": 1.0, "expand": 1.5, "graph": 0.5}
LAMBDA = 0.05
FEEDBACK = {"relevant": 0.5, "irrelevant": -0.2, "expanded": 0.3}


def activity_weight(hits: DataFrame, feedback: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Best tool value times exp(-lambda * days since the last hit), times the hits, plus feedback; at least 0."""
    use = hits.filter(F.col("created_at") >= X.ts(as_of) - F.expr(f"INTERVAL {days} DAYS"))
    value = F.lit(0.5)
    for tool, v in TOOL_VALUE.items():
        value = F.when(F.col("tool") == tool, v).otherwise(value)
    u = use.groupBy("slug").agg(F.count("*").alias("n"), F.max(value).alias("v"), F.max("created_at").alias("last"))
    bonus = F.lit(0.0)
    for signal, v in FEEDBACK.items():
        bonus = bonus + v * F.count(F.when(F.col("signal") == signal, 1))
    f = feedback.groupBy("slug").agg(bonus.alias("bonus"))
    age = X.days_between(X.ts(as_of), F.col("last"))
    out = u.join(f, "slug", "left").fillna(0.0, ["bonus"])
    return out.select("slug", F.greatest(F.lit(0.0), F.col("n") * F.col("v") * F.exp(-LAMBDA * age) + F.col("bonus")).alias("activity_weight"))


def tier(mentions: Column, activity: Column, old: Column | None = None) -> Column:
    score = 0.4 * mentions + 0.6 * activity
    new = F.when((score >= 10) | (mentions >= 10), 1).when((score >= 3) | (mentions >= 3), 2).otherwise(3)
    return F.least(old, new) if old is not None else new


def hotness(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Five-part score of pages(slug, mention_count, links, activity_weight, tier, body_bytes), rounded half up to 3 digits. Mentions and
    activity count against their 95th percentiles over all pages, links against the largest number of active links' ends at one page."""
    for name, c in (("top_m", "mention_count"), ("top_a", "activity_weight")):
        pages = pages.crossJoin(F.broadcast(p95_by_offset(pages, c).select(F.col("p95").alias(name))))  # one row
    ends = endpoints(links.filter(X.active_link())).groupBy("slug").agg(F.count("*").alias("n"))
    pages = pages.crossJoin(F.broadcast(ends.agg(F.coalesce(F.max("n"), F.lit(1)).alias("top_l"))))  # one row
    cap = lambda c, top: F.when(F.col(top) <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.col(c) / F.col(top)))
    by_tier = F.when(F.col("tier") == 1, 1.0).when(F.col("tier") == 2, 0.5).otherwise(0.1)
    body = X.clamp((F.col("body_bytes") - 200) / 1800.0, 0.0, 1.0)
    score = 0.25 * cap("mention_count", "top_m") + 0.20 * cap("links", "top_l") + 0.30 * cap("activity_weight", "top_a") + 0.15 * by_tier + 0.10 * body
    return pages.withColumn("hotness", X.half_up(score))


def profiles(pages: DataFrame, links: DataFrame, tags: DataFrame) -> DataFrame:
    """Each page with its tier, mentions, current facts out and in, and its tags in order (a page has few)."""
    use = links.filter(X.current_fact())
    n = lambda end, name: use.groupBy(F.col(end).alias("slug")).agg(F.count("*").alias(name))
    own = tags.groupBy(F.col("page_slug").alias("slug")).agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))
    out = pages.select("slug", "title", "tier", "mention_count").join(n("from_slug", "outgoing"), "slug", "left").join(n("to_slug", "incoming"), "slug", "left").join(own, "slug", "left")
    return out.fillna(0, ["outgoing", "incoming"]).fillna("", ["tags"])


def gaps(pages: DataFrame, degrees: DataFrame) -> DataFrame:
    """Often mentioned pages with few neighbours: entities from 8 mentions with at most 1, concepts from 30 with none."""
    use = pages.join(degrees, "slug", "left").fillna(0, ["degree"]).filter(F.length("title") >= 3)
    entity = F.col("type").startswith("entity/") & (F.col("mention_count") >= 8) & (F.col("degree") <= 1)
    concept = F.col("type").startswith("concept/") & (F.col("mention_count") >= 30) & (F.col("degree") == 0)
    isolation = F.when(F.col("degree") == 0, 1.0).otherwise(0.5)
    score = F.least(F.lit(1.0), 0.6 * F.log2(F.col("mention_count").cast("double")) / F.log2(F.lit(50.0)) + 0.4 * isolation)
    return use.filter(entity | concept).withColumn("score", score).withColumn("actionable", F.when(score >= 0.7, "high").otherwise("medium"))


def proactive_connections(neighbours: DataFrame, pivots: DataFrame, sessions: DataFrame, latest: DataFrame, hub: int = 20, shared: int = 2, least_sessions: int = 2, within_days: int = 14) -> DataFrame:
    """Unlinked pairs (pivot first) that share neighbours which are no hubs; with session (B) and timing (C) signals."""
    degree = neighbours.groupBy(F.col("slug").alias("neighbour")).agg(F.count("*").alias("deg")).filter(F.col("deg") <= hub)
    near = neighbours.join(degree.select("neighbour"), "neighbour", "left_semi")
    mine = near.join(pivots.select("slug"), "slug", "left_semi").select(F.col("slug").alias("a"), "neighbour")
    pairs = mine.join(near.select(F.col("slug").alias("b"), "neighbour"), "neighbour").filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= shared)
    pairs = pairs.join(neighbours.select(F.col("slug").alias("a"), F.col("neighbour").alias("b")), ["a", "b"], "left_anti")
    s = sessions.select(F.col("slug_a").alias("lo"), F.col("slug_b").alias("hi"), F.col("n").alias("sessions"))
    out = pairs.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b")).join(s, ["lo", "hi"], "left").drop("lo", "hi").fillna(0, ["sessions"])
    ta, tb = latest.select(F.col("slug").alias("a"), F.col("latest").alias("la")), latest.select(F.col("slug").alias("b"), F.col("latest").alias("lb"))
    out = out.join(ta, "a", "left").join(tb, "b", "left")
    c = F.coalesce(F.abs(F.datediff("la", "lb")) <= within_days, F.lit(False))
    return out.select("a", "b", "shared", (F.col("sessions") >= least_sessions).cast("int").alias("signal_b"), c.cast("int").alias("signal_c"))


# Fixed values of the scoring of proposed connections.
CONNECTION_WEIGHTS = {"evidence": 0.35, "novelty": 0.15, "recurrence": 0.20, "actionability": 0.10, "safety": 0.20}


def score_connections(pairs: DataFrame, base: float = 0.4, step: float = 0.2, decay: float = 0.5, target: int = 3, actionability: float = 0.6, risk: float = 0.5) -> DataFrame:
    """Quality of pairs (shared, signal_b, signal_c, occurrences) and the gate they pass."""
    extra = X.clamp(F.col("shared") - 2, 0, 2)
    signals = F.col("signal_b") + F.col("signal_c")
    evidence = X.clamp(base + 0.1 * extra + step * signals, 0.0, 1.0)
    novelty = F.when(F.col("occurrences") == 0, 1.0).otherwise(1.0 / (1 + decay * F.col("occurrences")))
    recurrence = X.clamp(F.col("occurrences") / float(target), 0.0, 1.0)
    danger = X.clamp(risk - 0.15 * signals - 0.05 * extra, 0.0, 1.0)
    w = CONNECTION_WEIGHTS
    quality = X.clamp(w["evidence"] * evidence + w["novelty"] * novelty + w["recurrence"] * recurrence + w["actionability"] * actionability + w["safety"] * (1 - danger), 0.0, 1.0)
    gate = F.when((F.col("shared") >= 3) & (signals >= 1), "strong_corroborated").when((F.col("shared") >= 2) & (signals == 2), "multi_independent").otherwise("rejected")
    return pairs.withColumn("quality", quality).withColumn("gate", gate)


def review_gates(candidates: DataFrame) -> DataFrame:
    """Failed gates of candidates (evidence, persistence, novelty, action, risk), joined in order; empty for those that pass."""
    failed = F.array_compact(F.array(
        F.when(F.col("evidence") < 3, "evidence"), F.when(F.col("persistence") < 2, "persistence"), F.when(F.col("novelty") < 0.5, "novelty"), F.when(F.col("action") < 0.5, "action"), F.when(F.col("risk") > 0.3, "risk"),
    ))
    return candidates.withColumn("failed", F.array_join(failed, ","))


def freshness(table: DataFrame, as_of: str, days: int = 14, recurring: int = 3) -> DataFrame:
    """fresh within so many days (or without a time), recurring from so many occurrences, else stale; health items never age."""
    age = X.days_between(X.ts(as_of), F.col("detected_at"))
    return table.withColumn("freshness", F.when((F.col("type") == "health") | F.col("detected_at").isNull() | (age <= days), "fresh").when(F.col("occurrence_count") >= recurring, "recurring").otherwise("stale"))


def health_status(issues: DataFrame) -> DataFrame:
    """(dimension, severity, n) of issues (dimension, severity, ...; with n, if a row stands for several), with the overall status: fail with
    more than 5 high ones, warn with any. Issues are read once: the totals are over the few rows that are left."""
    n = F.sum("n") if "n" in issues.columns else F.count("*")
    per = issues.groupBy("dimension", "severity").agg(n.alias("n"))
    every = Window.partitionBy()
    per = per.withColumn("high", F.sum(F.when(F.col("severity") == "high", F.col("n")).otherwise(0)).over(every)).withColumn("all", F.sum("n").over(every))
    return per.select("dimension", "severity", "n", F.when(F.col("high") > 5, "fail").when(F.col("all") > 0, "warn").otherwise("ok").alias("status"))


def issue_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Issues (dimension, slug) as new, resolved or unchanged, counted per dimension."""
    o, n = old.select("dimension", "slug", F.lit(1).alias("was")), new.select("dimension", "slug", F.lit(1).alias("now"))
    both = o.join(n, ["dimension", "slug"], "full_outer")
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "resolved").otherwise("unchanged")
    return both.groupBy("dimension", state.alias("state")).agg(F.count("*").alias("n"))


# ---- state merges ----

def discovery_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge detections by key: known keys get the new score and time and one more occurrence, status and seen stay; others are added."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col("o.dedup_key") == F.col("n.dedup_key"), "full_outer")
    both = F.col("o.dedup_key").isNotNull() & F.col("n.dedup_key").isNotNull()
    return j.select(
        F.coalesce("o.dedup_key", "n.dedup_key").alias("dedup_key"), F.coalesce("n.score", "o.score").alias("score"), F.coalesce("n.detected_at", "o.detected_at").alias("last_detected_at"),
        F.when(both, F.col("o.occurrence_count") + 1).otherwise(F.coalesce("o.occurrence_count", F.lit(1))).alias("occurrence_count"), F.coalesce("o.status", F.lit("pending")).alias("status"), F.coalesce("o.seen", F.lit(0)).alias("seen"),
    )


def keep_latest(table: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Upsert by key: the newest row of each."""
    return first_by(table, keys, F.desc(by))


def _commits(spark, path: str) -> tuple:
    """The file system, and the names of a table's commits, oldest first. A commit is an empty file whose name holds its number and its
    version: creating it is one step, so a table changes at once or not at all."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def commit_version(spark, path: str, version: str) -> None:
    """Make ``version`` (a name below path) the table's current one."""
    fs, names = _commits(spark, path)
    number = int(names[-1].split(".")[0]) + 1 if names else 1
    fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/commits/{number:012d}.{version}"), False).close()


def replace_table(df: DataFrame, path: str) -> None:
    """Write the next version beside the last, then commit it: readers never see half a table, and a job that dies leaves the old one."""
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    commit_version(df.sparkSession, path, version)


def has_table(spark, path: str) -> bool:
    return bool(_commits(spark, path)[1])


def current_version(spark, path: str) -> str:
    """Where the current version of a table is."""
    return f"{path}/{_commits(spark, path)[1][-1].split('.', 1)[1]}"


def read_table(spark, path: str) -> DataFrame:
    return spark.read.parquet(current_version(spark, path))


# ---- text structuring ----

def pack_paragraphs(text: Column, size: int = 500, separator: str = r"\n\n+") -> Column:
    """Greedy chunks of paragraphs: a chunk is closed when the next paragraph would make it longer than ``size`` (the joining
    blank line is not counted); longer paragraphs stay whole; chunks are trimmed."""
    parts = F.filter(F.split(text, separator), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, p: Column) -> Column:
        full = (F.length(acc["cur"]) + F.length(p) > size) & (F.length(acc["cur"]) > 0)
        joined = F.when(F.length(acc["cur"]) > 0, F.concat(acc["cur"], F.lit("\n\n"), p)).otherwise(p)
        return F.struct(F.when(full, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"), F.when(full, p).otherwise(joined).alias("cur"))

    def finish(acc: Column) -> Column:
        return F.transform(F.when(F.trim(acc["cur"]) != "", F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]), lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""))

    return F.when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", F.array().cast("array<string>")).otherwise(F.aggregate(parts, start, step, finish))


def chunk_pages(docs: DataFrame, body: str = "text", size: int = 500, separator: str = r"\n\n+") -> DataFrame:
    return docs.select("slug", F.posexplode(pack_paragraphs(F.col(body), size, separator)).alias("chunk_index", "content"))


def sentence_chunks(text: Column, size: int = 2500) -> Column:
    """Sentences packed up to ``size`` characters; longer ones are cut hard."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[。！？.!?\n])\s*"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    pieces = F.flatten(F.transform(parts, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / size).cast("int")), lambda i: F.substring(s, i * size + 1, F.lit(size)))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, p: Column) -> Column:
        full = (F.length(acc["cur"]) + F.length(p) > size) & (F.length(acc["cur"]) > 0)
        return F.struct(F.when(full, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"), F.when(full, p).otherwise(F.concat(acc["cur"], p)).alias("cur"))

    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.aggregate(pieces, start, step, lambda a: F.when(a["cur"] != "", F.array_append(a["done"], a["cur"])).otherwise(a["done"])))


MEDIA = r"(?i)\.(png|jpe?g|gif|svg|webp|mp4|mov|pdf|mp3|wav|zip)$"


def wikilinks(text: Column) -> Column:
    """Targets of [[target#part|display]] outside code spans, without embeds, URLs and media: distinct, in order."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?(?:```|\z)", " "), r"`[^`\n]*`", " ")
    found = F.transform(F.regexp_extract_all(bare, F.lit(r"(?<!!)\[\[([^\]|#]+?)(?:#[^\]]*?)?(?:\|([^\]]+?))?\]\]"), F.lit(1)), lambda t: F.trim(t))
    return F.array_distinct(F.filter(found, lambda t: (t != "") & ~t.contains("://") & ~t.rlike(MEDIA)))


def wikilink_pairs(text: Column) -> Column:
    """(target, display) of the links that ``wikilinks`` finds, the first of each target; display is null where none is given."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?(?:```|\z)", " "), r"`[^`\n]*`", " ")
    form = r"(?<!!)\[\[([^\]|#]+?)(?:#[^\]]*?)?(?:\|([^\]]+?))?\]\]"
    whole = F.regexp_extract_all(bare, F.lit(form), F.lit(0))
    part = lambda w, i: F.trim(F.regexp_extract(w, form, i))
    pairs = F.transform(whole, lambda w: F.struct(part(w, 1).alias("target"), F.nullif(part(w, 2), F.lit("")).alias("display")))
    good = F.filter(pairs, lambda p: (p["target"] != "") & ~p["target"].contains("://") & ~p["target"].rlike(MEDIA))
    return F.filter(good, lambda p, i: ~F.exists(F.slice(good, 1, i), lambda q: q["target"] == p["target"]))


def frontmatter(text: Column) -> Column:
    """Struct of the block between leading '---' lines and the body. ``lists``: the values of each key, of ``key: value``, ``key:
    [a, b]`` or indented ``- a`` lines; ``fields``: the same joined by ', '. Keys inside a key are 'outer.inner'; of a repeated key the
    last counts."""
    block = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?", 1)
    body = F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "")
    bare = lambda c: F.regexp_replace(F.trim(c), "^[\\s\"']+|[\"'\\s]+$", "")
    none = F.array().cast("array<struct<k:string,v:array<string>>>")
    start = F.struct(F.lit("").alias("outer"), none.alias("pairs"))

    def step(acc: Column, line: Column) -> Column:
        is_item, indented = line.rlike(r"^\s*-\s+"), line.rlike(r"^\s")
        is_pair = ~is_item & line.rlike(r"^\s*[^\s:#][^:]*:")
        name, value = F.trim(F.regexp_extract(line, r"^([^:]+):", 1)), F.trim(F.regexp_extract(line, r"^[^:]+:(.*)$", 1))
        key = F.when(indented & (acc["outer"] != ""), F.concat(acc["outer"], F.lit("."), name)).otherwise(name)
        many = F.filter(F.transform(F.split(F.regexp_extract(value, r"^\[(.*)\]$", 1), ","), bare), lambda x: x != "")
        values = F.when(value == "", F.array().cast("array<string>")).when(value.rlike(r"^\[.*\]$"), many).otherwise(F.array(bare(value)))
        last = F.element_at(acc["pairs"], -1)
        longer = F.struct(last["k"].alias("k"), F.array_append(last["v"], bare(F.regexp_replace(line, r"^\s*-\s+", ""))).alias("v"))
        pairs = (
            F.when(is_item & (F.size(acc["pairs"]) > 0), F.array_append(F.slice(acc["pairs"], 1, F.greatest(F.size(acc["pairs"]) - 1, F.lit(0))), longer))
            .when(is_pair, F.array_append(acc["pairs"], F.struct(key.alias("k"), values.alias("v"))))
            .otherwise(acc["pairs"])
        )
        return F.struct(F.when(is_pair & ~indented, name).otherwise(acc["outer"]).alias("outer"), pairs.alias("pairs"))

    pairs = F.aggregate(F.split(block, r"\r?\n"), start, step, lambda acc: acc["pairs"])
    kept = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.struct(F.map_from_entries(F.transform(kept, lambda p: F.struct(p["k"], F.array_join(p["v"], ", ")))).alias("fields"), F.map_from_entries(kept).alias("lists"), body.alias("body"))


def topic_fingerprints(members: DataFrame) -> DataFrame:
    """Of each tag the number of its pages (tag, slug) and two sums of their hashes: equal if and only if (but for collisions of 64
    bits) the pages are the same, without gathering a tag's pages."""
    return members.groupBy("tag").agg(F.count("*").alias("n"), F.sum(X.hash32(F.col("slug"))).alias("h"), F.sum(X.hash32(F.col("slug"), 1)).alias("h2"))


def content_kind(text: Column) -> Column:
    return F.when(text.startswith("---") & text.rlike(r"(?m)^(title|type|tags|slug|aliases|date):"), "markdown").otherwise("text")


def normal_date(c: Column) -> Column:
    """YYYY, YYYY-MM, YYYY年 or BCE years as full dates; anything else null (to be deleted)."""
    t = F.trim(c)
    year = F.regexp_extract(t, r"(\d+)", 1)
    return (
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01"))).when(t.rlike(r"^\d{4}年?$"), F.concat(F.substring(t, 1, 4), F.lit("-01-01")))
        .when(t.rlike(r"^(公元前|前)\s*\d{1,4}年?$|^\d{1,4}\s*BCE?$"), F.concat(F.lit("-"), F.lpad(year, 4, "0"), F.lit("-01-01")))
    )


def fingerprint(text: Column) -> Column:
    """16 hex digits of the SHA-256 of a text with line ends normalised and trimmed."""
    return F.substring(F.sha2(F.regexp_replace(F.regexp_replace(text, r"\r\n", "\n"), r"^\s+|\s+$", ""), 256), 1, 16)


def sync_plan(source: DataFrame, pages: DataFrame) -> DataFrame:
    """What to do with each source file (slug, content_hash): add, update, skip, delete, or reject repeated slugs."""
    n = source.groupBy("slug").agg(F.count("*").alias("files"), F.max("content_hash").alias("hash"))
    j = n.join(pages.select("slug", F.col("content_hash").alias("old")), "slug", "full_outer")
    action = F.when(F.col("files") > 1, "duplicate").when(F.col("files").isNull(), "delete").when(F.col("old").isNull(), "add").when(F.col("old") == F.col("hash"), "skip").otherwise("update")
    return j.select("slug", action.alias("action"))
