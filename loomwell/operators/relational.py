"""Filters, joins, aggregates, windows, rankings and set operations over the knowledge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions import exprs as X
from loomwell.operators import ranks
from loomwell.operators.lineage import cut, stored

#: Folders up to which rows are filtered by them, and slugs of a folder that are looked up one by one.
FOLDERS, FEW = 100, 1000
ORDER_COLUMNS = ("slug", "title", "type", "tier", "mention_count", "created_at", "updated_at")


# ---- scans ----

def filtered_pages(pages: DataFrame, types: Sequence[str] = (), prefix: str | None = None, order_by: str = "updated_at", descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    """List pages; an unknown ordering column falls back to updated_at. Ties go by slug."""
    if types:
        pages = pages.filter(F.col("type").isin(*types))
    if prefix:
        pages = pages.filter(F.col("type").startswith(prefix))
    c = F.col(order_by if order_by in ORDER_COLUMNS else "updated_at")
    return pages.orderBy(c.desc() if descending else c.asc(), "slug").offset(offset).limit(limit)


def keyed_read(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows of many keys at once; keys without rows stay, with nulls."""
    return keys.join(table, key, "left")


def newest(table: DataFrame, n: int, by: str = "id") -> DataFrame:
    return table.orderBy(F.desc(by)).limit(n)


# ---- links ----

def endpoints(links: DataFrame, once: bool = False) -> DataFrame:
    """(slug) of both ends of each link; with ``once`` a self-loop counts one end. Replaces joins with OR conditions."""
    both = F.array("from_slug", "to_slug")
    return links.select(F.explode(F.array_distinct(both) if once else both).alias("slug"))


def degree(links: DataFrame) -> DataFrame:
    """Endpoint count over active links without self-loops."""
    use = links.filter(X.active_link() & (F.col("from_slug") != F.col("to_slug")))
    return endpoints(use).groupBy("slug").agg(F.count("*").alias("degree"))


def link_count(links: DataFrame) -> DataFrame:
    """Current-fact links at each slug; a self-loop counts once."""
    return endpoints(links.filter(X.current_fact()), once=True).groupBy("slug").agg(F.count("*").alias("links"))


def pages_with_link_count(pages: DataFrame, links: DataFrame) -> DataFrame:
    return pages.join(link_count(links), "slug", "left").withColumn("links", F.coalesce("links", F.lit(0).cast("long")))


def islands(pages: DataFrame, links: DataFrame) -> DataFrame:
    return pages.join(endpoints(links.filter(X.current_fact())).distinct(), "slug", "left_anti")


def bare_stubs(pages: DataFrame, links: DataFrame, most_mentions: int = 1, most_links: int = 1) -> DataFrame:
    low = pages.filter((F.col("tier") == 3) & X.entity_or_concept() & (F.col("mention_count") <= most_mentions))
    return pages_with_link_count(low, links).filter(F.col("links") <= most_links)


def link_ends(links: DataFrame) -> DataFrame:
    """(slug, links, ends, rows) of each slug that links name: its current-fact links, a self-loop once (as link_count); how often it is an end
    of any link; and the links that name it. One pass over links and one shuffle of counts per slug, not one for each question."""
    current = X.current_fact().cast("int").alias("current")
    twice = F.col("from_slug").eqNullSafe(F.col("to_slug")).cast("int")
    both = F.explode(F.array_distinct(F.array("from_slug", "to_slug"))).alias("slug")
    return links.select(both, current, twice.alias("twice")).groupBy("slug").agg(F.sum("current").alias("links"), F.sum(1 + F.col("twice")).alias("ends"), F.count("*").alias("rows"))


def page_faults(pages: DataFrame, links: DataFrame, most_mentions: int = 1, most_links: int = 1) -> DataFrame:
    """(fault, n): how many islands, bare_stubs and dangling rows there are, and titles that are blank, as the operators of these names find
    them one by one; faults without cases are left out."""
    low = (F.col("tier") == 3) & X.entity_or_concept() & (F.col("mention_count") <= most_mentions)
    p = pages.select("slug", F.lit(1).alias("page"), F.coalesce(low, F.lit(False)).alias("low"), F.coalesce(F.trim("title") == "", F.lit(False)).alias("blank"))
    both = p.join(link_ends(links), "slug", "full_outer")
    held, linked = F.col("page").isNotNull(), F.coalesce("links", F.lit(0))
    cases = {"islands": (held & (linked == 0)).cast("long"), "stubs": (held & F.col("low") & (linked <= most_links)).cast("long"), "titles": (held & F.col("blank")).cast("long"), "dangling": F.when(held, 0).otherwise(F.col("ends"))}
    row = both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in cases.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(name).alias("fault"), F.col(name).alias("n")) for name in cases])).alias("x")).select("x.*").filter("n > 0")


def empty_shells(pages: DataFrame, links: DataFrame, aliases: DataFrame, tags: DataFrame) -> DataFrame:
    out = pages.filter((F.col("type") != "record") & (F.col("mention_count") == 0))
    out = out.join(endpoints(links.filter(X.active_link())).distinct(), "slug", "left_anti")
    for side in (aliases, tags):
        out = out.join(side.select(F.col("page_slug").alias("slug")).distinct(), "slug", "left_anti")
    return out


def neighbours(links: DataFrame, condition: Column | None = None) -> DataFrame:
    """(slug, neighbour) in both directions, without repeats."""
    use = links.filter(X.current_fact() if condition is None else condition)
    there = use.select(F.col("from_slug").alias("slug"), F.col("to_slug").alias("neighbour"))
    back = use.select(F.col("to_slug").alias("slug"), F.col("from_slug").alias("neighbour"))
    return there.unionByName(back).distinct()


def folder(slug: Column) -> Column:
    """A slug up to its last slash."""
    return F.left(slug, F.length(slug) - F.length(F.substring_index(slug, "/", -1)))


def possible(rows: DataFrame, column: str, keys: DataFrame, folders: int = FOLDERS, few: int = FEW) -> DataFrame:
    """rows less most of those whose column is no slug of keys, without an exchange of rows; a row whose column is one always stays. Of a
    folder with few keys these are looked up, of others all rows stay; with more than so many folders, all do."""
    keys = stored(keys.select("slug").filter("slug IS NOT NULL").distinct())
    sizes = keys.groupBy(folder(F.col("slug")).alias("f")).agg(F.count("*").alias("n")).limit(folders + 1).collect()
    if len(sizes) > folders:
        return rows
    where, large = folder(F.col(column)), [r["f"] for r in sizes if r["n"] > few]
    if len(large) == len(sizes):
        return rows.filter(where.isin(large))
    listed = stored(keys.filter(~folder(F.col("slug")).isin(large))).select(F.col("slug").alias(column), F.lit(True).alias("_listed"))
    return rows.join(listed, column, "left").filter(F.col("_listed") | where.isin(large)).select(rows.columns)


def dangling(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links of which an end has no page."""
    slugs = pages.select("slug")
    no_from = links.join(slugs, links["from_slug"] == slugs["slug"], "left_anti").withColumn("missing", F.lit("from"))
    no_to = links.join(slugs, links["to_slug"] == slugs["slug"], "left_anti").withColumn("missing", F.lit("to"))
    return no_from.unionByName(no_to)


def connectivity(links: DataFrame, least: int) -> DataFrame:
    """Distinct targets plus distinct sources of each slug, over current facts."""
    use = links.filter(X.current_fact())
    out = use.groupBy(F.col("from_slug").alias("slug")).agg(F.count_distinct("to_slug").alias("n"))
    inc = use.groupBy(F.col("to_slug").alias("slug")).agg(F.count_distinct("from_slug").alias("n"))
    return out.unionByName(inc).groupBy("slug").agg(F.sum("n").alias("connections")).filter(F.col("connections") >= least)


# ---- quality of pages ----

def entity_quality(pages: DataFrame, aliases: DataFrame, tags: DataFrame, chunks: DataFrame) -> DataFrame:
    """Aliases, tags, chunks and characters of each entity or concept page: aggregated first, then joined."""
    a = aliases.groupBy(F.col("page_slug").alias("slug")).agg(F.count("*").alias("alias_count"))
    t = tags.groupBy(F.col("page_slug").alias("slug")).agg(F.count("*").alias("tag_count"))
    c = chunks.groupBy(F.col("page_slug").alias("slug")).agg(F.count("*").alias("chunk_count"), F.sum(F.length("content")).alias("body_chars"))
    out = pages.filter(X.entity_or_concept())
    for side in (a, t, c):
        out = out.join(side, "slug", "left")
    return out.fillna(0, ["alias_count", "tag_count", "chunk_count", "body_chars"])


def cross_type_duplicates(pages: DataFrame) -> DataFrame:
    """Pairs of pages with one normalised title and different types; the smaller slug first."""
    keyed = pages.select("slug", "type", F.lower(F.trim("title")).alias("key")).filter(F.col("key") != "")
    a, b = keyed.alias("a"), keyed.alias("b")
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.slug") < F.col("b.slug")) & (F.col("a.type") != F.col("b.type"))).select(
        F.col("a.slug").alias("slug_a"), F.col("b.slug").alias("slug_b"), F.col("a.key").alias("title")
    )


def shared_titles(pages: DataFrame) -> DataFrame:
    """(title, n, slug): the pages of each title that several have, one row a page."""
    n = pages.filter(F.trim("title") != "").groupBy("title").agg(F.count("*").alias("n")).filter("n > 1")
    return pages.join(n, "title").select("title", "n", "slug")


def topic_candidates(seeds: DataFrame, least: int = 3) -> DataFrame:
    """Seeds (seed, slug) of at least so many records, one for each set of records: the smallest. Sets are told apart by their size
    and two sums of hashes, so no set is gathered."""
    own = seeds.distinct().groupBy("seed").agg(F.count("*").alias("n"), F.sum(X.hash32(F.col("slug"))).alias("h"), F.sum(X.hash32(F.col("slug"), 1)).alias("h2"))
    return own.filter(F.col("n") >= least).groupBy("n", "h", "h2").agg(F.min("seed").alias("seed")).select("seed", "n", "h")


def attention_queue(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items (keys, occurrence_count, detected_at, ref) merged by key: evidence summed, references united (their number and the sum
    of their hashes; the references themselves are the distinct rows of items), the most occurrences and the newest time."""
    refs = items.select(*keys, "ref").distinct().groupBy(*keys).agg(F.count("*").alias("refs"), F.sum(X.hash32(F.col("ref"))).alias("refs_hash"))
    sums = items.groupBy(*keys).agg(F.sum("occurrence_count").alias("evidence"), F.max("occurrence_count").alias("most"), F.max("detected_at").alias("newest"))
    return sums.join(refs, list(keys))


def zero_link_records(pages: DataFrame, chunks: DataFrame, tags: DataFrame, links: DataFrame, least_chunks: int = 2, least_chars: int = 1000, least_tags: int = 3) -> DataFrame:
    """Records with much content that no current link without self-loop touches."""
    rich = rich_records(pages, chunk_sizes(chunks), tags, least_chunks, least_chars, least_tags)
    return rich.join(endpoints(links.filter(X.current_fact() & (F.col("from_slug") != F.col("to_slug")))).distinct(), "slug", "left_anti")


def chunk_sizes(chunks: DataFrame) -> DataFrame:
    """(slug, chunks, chars) of the pages that have chunks."""
    return chunks.groupBy(F.col("page_slug").alias("slug")).agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))


def rich_records(pages: DataFrame, sizes: DataFrame, tags: DataFrame, least_chunks: int = 2, least_chars: int = 1000, least_tags: int = 3) -> DataFrame:
    """Records with much content, by the sizes of their chunks and their tags."""
    t = tags.groupBy(F.col("page_slug").alias("slug")).agg(F.count("*").alias("tags"))
    rich = pages.filter(F.col("type") == "record").select("slug").join(sizes, "slug", "left").join(t, "slug", "left").fillna(0)
    return rich.filter((F.col("chunks") >= least_chunks) | (F.col("chars") >= least_chars) | (F.col("tags") >= least_tags))


def resolve_names(names: DataFrame, pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """For each name: page by slug, else by title, else by alias, else by part of a title (ASCII letters in any case).
    Within a pass entities come before concepts before others, then the smaller slug. Unresolved names stay, with nulls."""
    p = pages.select("slug", "title", X.type_rank().alias("rank"))
    by_slug = names.join(p, F.col("name") == F.col("slug")).select("name", "slug", F.lit(1).alias("pass"), "rank", F.col("slug").alias("tie"))
    by_title = names.join(p, F.col("name") == F.col("title")).select("name", "slug", F.lit(2).alias("pass"), "rank", F.col("slug").alias("tie"))
    named = aliases.join(p, F.col("page_slug") == F.col("slug"))
    by_alias = names.join(named, F.col("name") == F.col("alias")).select("name", "slug", F.lit(3).alias("pass"), "rank", F.lpad(F.col("id").cast("string"), 20, "0").alias("tie"))
    sure = by_slug.unionByName(by_title).unionByName(by_alias)
    open_ = names.join(sure.select("name").distinct(), "name", "left_anti").filter(F.trim("name") != "")
    # only names that no key resolves are looked for inside titles
    fuzzy = contained_in(open_, p).select("name", "slug", F.lit(4).alias("pass"), "rank", F.col("slug").alias("tie"))
    first = Window.partitionBy("name").orderBy("pass", "rank", "tie")
    best = sure.unionByName(fuzzy).withColumn("rn", F.row_number().over(first)).filter("rn = 1").select("name", "slug", "pass")
    return names.join(best, "name", "left")


def _grams(text: Column, n: Column) -> Column:
    """All runs of n characters; the text itself if it is shorter."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n))


def contained_in(names: DataFrame, pages: DataFrame) -> DataFrame:
    """names joined with the pages whose title contains the name, in any case: found through the rarest of the name's trigrams
    (or the name itself, if shorter), so no name meets all titles."""
    size = lambda c: F.least(F.lit(3), F.length(c))
    asked = cut(names.select("name", F.explode(F.array_distinct(_grams(F.lower("name"), size(F.lower("name"))))).alias("gram")))
    low = F.lower("title")
    sizes_ = sorted(r[0] for r in asked.select(F.length("gram")).distinct().collect())  # of 0 to 3
    if not sizes_:
        return names.join(pages, F.lit(False))
    # only grams of asked lengths are cut, and each title keeps those that were asked for before a row leaves its task
    grams = pages.withColumn("gram", F.explode(F.array_distinct(F.flatten(F.array(*[_grams(low, F.lit(n)) for n in sizes_])))))
    grams = grams.select("slug", "gram", *[c for c in pages.columns if c != "slug"]).join(asked.select("gram").distinct(), "gram", "left_semi")
    sizes = grams.groupBy("gram").agg(F.count("*").alias("titles"))
    rare = first_by(asked.join(sizes, "gram"), ["name"], "titles", "gram").select("name", "gram")
    return rare.join(grams, "gram").filter(low.contains(F.lower("name"))).drop("gram")


def unique_prefixes(names: DataFrame, pages: DataFrame) -> DataFrame:
    """Fail-closed resolution by prefix, in any case, with % and _ as themselves: the page counts only if no other title begins so."""
    sizes = [r[0] for r in names.filter("name <> ''").select(F.length("name")).distinct().collect()]  # at most as many as a title is long
    keys = F.array_compact(F.array(*[F.when(F.length("title") >= n, F.lower(F.substring("title", 1, n))) for n in sizes])) if sizes else F.array().cast("array<string>")
    hits = pages.select("slug", F.explode(keys).alias("key")).join(names.withColumn("key", F.lower("name")), "key")
    one = hits.groupBy("name").agg(F.count("*").alias("n"), F.min("slug").alias("slug")).filter("n = 1")
    return names.join(one.select("name", "slug"), "name", "left")


def unique_matches(names: DataFrame, pages: DataFrame) -> DataFrame:
    """Fail-closed resolution: a name counts only if exactly one page's title equals it."""
    hits = names.join(pages, pages["title"] == names["name"]).groupBy("name").agg(F.count("*").alias("n"), F.min("slug").alias("slug"))
    return names.join(hits.filter("n = 1").select("name", "slug"), "name", "left")


# ---- log analytics ----

BLOCK = 1000  # items of a key that meet in one task


def pairs_within(rows: DataFrame, key: str, item: str, carry: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """(key, a, b, and the carried columns as a_*, b_*): the pairs a < b of distinct items of each key. The items of a large key are
    cut into blocks by hash, and each pair of blocks meets in its own task."""
    n = rows.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    cut_ = rows.join(n, key).withColumn("own", F.pmod(F.xxhash64(item), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    side = lambda name, mine, other: cut_.select(key, F.col("own").alias(mine), every.alias(other), F.col(item).alias(name), *[F.col(c).alias(f"{name}_{c}") for c in carry])
    return side("a", "block_a", "block_b").join(side("b", "block_b", "block_a"), [key, "block_a", "block_b"]).filter("a < b").drop("block_a", "block_b")


def numbered(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """The rows with numbers from 1 in a total order, without a task that holds all of them: ranges are numbered inside, and
    offset by the sizes of those before."""
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = parts.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_in", inside).join(F.broadcast(offsets.select("_part", "_before")), "_part").withColumn(name, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def session_pairs(hits: DataFrame) -> DataFrame:
    """Pairs of different slugs in a session, with multiplicity: occurrences are counted per slug first, so a session's
    pairs cost the square of its distinct slugs only."""
    n = hits.groupBy("session_id", "slug").agg(F.count("*").alias("n"))
    pairs = pairs_within(n, "session_id", "slug", ["n"])
    return pairs.groupBy(F.col("a").alias("slug_a"), F.col("b").alias("slug_b")).agg(F.sum(F.col("a_n") * F.col("b_n")).alias("n"))


def new_session_pairs(hits: DataFrame, watermark: int, since: str) -> DataFrame:
    """Like session_pairs, for sessions with a row beyond the watermark; at least one side of a pair must be new."""
    new = (F.col("id") > watermark) & (F.col("created_at") >= X.ts(since))
    marked = hits.withColumn("new", new.cast("long"))
    n = marked.groupBy("session_id", "slug").agg(F.count("*").alias("n"), F.sum("new").alias("fresh"))
    live = n.groupBy("session_id").agg(F.max("fresh").alias("m")).filter("m > 0").select("session_id")
    n = n.join(live, "session_id", "left_semi")
    pairs = pairs_within(n, "session_id", "slug", ["n", "fresh"])
    old = (F.col("a_n") - F.col("a_fresh")) * (F.col("b_n") - F.col("b_fresh"))
    out = pairs.groupBy(F.col("a").alias("slug_a"), F.col("b").alias("slug_b")).agg(F.sum(F.col("a_n") * F.col("b_n") - old).alias("n"))
    return out.filter(F.col("n") > 0)


def usage(hits: DataFrame, since: str) -> DataFrame:
    """Hits of each slug: count, tools in order, last time. The mean position is the constant 1."""
    use = hits.filter(F.col("created_at") >= X.ts(since))
    return use.groupBy("slug").agg(
        F.count("*").alias("query_count"), F.lit(1.0).alias("avg_position"), F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"), F.max("created_at").alias("last_queried_at")
    )


def percentiles(log: DataFrame, by: str, value: str = "latency_ms", degraded: str | None = None) -> DataFrame:
    """Nearest-rank percentiles per group."""
    pick = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
    aggs = [F.count("*").alias("n"), pick(0.5).alias("p50"), pick(0.95).alias("p95"), F.max(value).alias("max")]
    if degraded:
        aggs.append(F.avg(degraded).alias("degraded_rate"))
    return log.groupBy(by).agg(*aggs)


def slowest_step(steps: DataFrame) -> DataFrame:
    """The kind of each session's slowest step; the first on a tie."""
    return steps.groupBy("session_id").agg(F.max_by("kind", F.struct("latency_ms", -F.col("step_index"))).alias("kind"), F.max("latency_ms").alias("latency_ms"))


# Reason codes that mark a search as degraded, and the one for latency.
DEGRADED_CODES = ("parser_fallback", "rerank_skipped", "hierarchy_mismatch")
LATENCY_CODE = "latency_warning"


def search_quality(log: DataFrame, since: str) -> DataFrame:
    """One row: searches since a time; a parser fallback is a degradation only without hits, and a row marked degraded
    without a known code counts too."""
    use = log.filter(F.col("created_at") >= X.ts(since))
    known = F.col("reason").isin(*DEGRADED_CODES)
    bad = F.when(F.col("reason") == "parser_fallback", F.col("hit_count") == 0).when(known, True).otherwise((F.col("degraded") == 1) & F.col("reason").isNull())
    rate = lambda c: F.when(F.count("*") == 0, 0.0).otherwise(F.sum(F.coalesce(c, F.lit(False)).cast("int")) / F.count("*"))
    return use.agg(
        F.count("*").alias("total"), rate(bad).alias("degraded_rate"), rate(F.col("reason") == LATENCY_CODE).alias("latency_warning_rate"), F.floor(F.coalesce(F.avg("latency_ms"), F.lit(0.0)) + 0.5).alias("avg_latency_ms"),
        F.coalesce(F.sum((F.col("hit_count") == 0).cast("long")), F.lit(0)).alias("empty"), F.coalesce(F.sum(F.coalesce(F.col("reason") == "hierarchy_mismatch", F.lit(False)).cast("long")), F.lit(0)).alias("hierarchy_mismatches"),
    )


def top_reasons(log: DataFrame, n: int = 5) -> DataFrame:
    return log.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(n)


def p95_by_offset(table: DataFrame, value: str) -> DataFrame:
    """The value at descending offset floor(n / 20) of the positive ones, as one row; 1 if there is none."""
    found = ranks.value_at_offset(table, value, 0.05)
    return table.sparkSession.createDataFrame([(1.0 if found is None else found,)], "p95 double")


# ---- windows ----

def trend_streaks(snapshots: DataFrame, since: str, streak: int = 3, spike: int = 5) -> DataFrame:
    """Longest runs of strict rises and falls per slug since a date; equal values break a run."""
    w = Window.partitionBy("slug").orderBy("snapshot_date")
    use = snapshots.filter(F.col("snapshot_date") >= F.lit(since).cast("date"))
    step = use.withColumn("sign", F.signum(F.col("mention_count") - F.lag("mention_count").over(w)))
    change = F.when(F.col("sign").eqNullSafe(F.lag("sign").over(w)), 0).otherwise(1)
    runs = step.withColumn("run", F.sum(change).over(w))
    total = Window.partitionBy("slug")
    first, last = F.min_by("mention_count", "snapshot_date").over(total), F.max_by("mention_count", "snapshot_date").over(total)
    runs = runs.withColumn("delta", last - first).withColumn("days", F.count("*").over(total))
    per = runs.groupBy("slug", "run", "sign", "delta", "days").agg(F.count("*").alias("len"))
    best = per.groupBy("slug", "delta", "days").agg(
        F.coalesce(F.max(F.when(F.col("sign") > 0, F.col("len"))), F.lit(0)).alias("rises"), F.coalesce(F.max(F.when(F.col("sign") < 0, F.col("len"))), F.lit(0)).alias("falls")
    )
    trend = F.when(F.col("rises") >= streak, "rising").when(F.col("falls") >= streak, "declining").when(F.abs("delta") >= spike, "spike")
    return best.filter(F.col("days") >= 2).withColumn("trend", trend).filter("trend is not null").drop("days")


def first_by(table: DataFrame, keys: Sequence[str], *order: Column | str, n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    return table.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def best_chunks(ranked: DataFrame, n: int) -> DataFrame:
    """Of hits (slug, chunk_index, distance): one per slug, a summary (index -1) before all others; the n slugs whose best hit is nearest."""
    arrival = ranked.groupBy("slug").agg(F.min(F.struct("distance", "chunk_index")).alias("a"))
    one = first_by(ranked, ["slug"], (F.col("chunk_index") != -1), "distance", "chunk_index")
    return one.join(arrival, "slug").orderBy("a.distance", "slug").limit(n).drop("a")


def greedy_pairs(pairs: DataFrame, per_entity: int = 3, most: int = 50) -> DataFrame:
    """Accept ranked pairs (a, b, score), best first, while each of the two has fewer than ``per_entity``; stop at ``most``. Of
    repeated pairs the best counts.

    The rule is sequential, but only few pairs can matter. Before it stops, at most full = 2 * (most - 1) / per_entity entities are
    full. Of an entity's pairs at most ``full`` fail because the partner is, so it is full itself after its best full +
    per_entity ones, and later ones fail. Of the pairs that are so left at both ends, at most full * (full + per_entity) fail; the
    best of that many and ``most`` more decide, a number that does not grow with the data.
    """
    full = 2 * (most - 1) // per_entity
    one = pairs.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.max(F.col("score").cast("double")).alias("score"))
    ends = one.withColumn("end", F.explode(F.array("lo", "hi")))
    near = first_by(ends, ["end"], F.desc("score"), "lo", "hi", n=full + per_entity).groupBy("lo", "hi", "score").agg(F.count("*").alias("n")).filter((F.col("n") == 2) | (F.col("lo") == F.col("hi")))
    rows = near.orderBy(F.desc("score"), "lo", "hi").limit(full * (full + per_entity) + most).select("lo", "hi", "score").collect()
    used: dict[str, int] = {}
    kept = []
    for a, b, score in rows:
        if len(kept) == most:
            break
        if used.get(a, 0) < per_entity and used.get(b, 0) < per_entity:
            used[a] = used.get(a, 0) + 1
            used[b] = used.get(b, 0) + 1
            kept.append((a, b, score))
    return pairs.sparkSession.createDataFrame(kept, "a string, b string, score double")


# ---- differences ----

def snapshot_diff(old: DataFrame, new: DataFrame, drop: float = 0.1) -> DataFrame:
    """Changes between two states keyed by slug, one row a change."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.slug") == F.col("n.slug"), "full_outer").select(
        F.coalesce("n.slug", "o.slug").alias("slug"), F.col("o.slug").isNull().alias("is_new"), F.col("n.slug").isNull().alias("is_gone"),
        *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "on" for c in ("content_hash", "tier", "link_count", "confidence_decay")],
    )
    kept = ~F.col("is_new") & ~F.col("is_gone")
    differs = lambda c: kept & ~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
    kinds = F.array_compact(F.array(
        F.when(F.col("is_new"), "added"), F.when(F.col("is_gone"), "removed"), F.when(differs("content_hash"), "content"), F.when(differs("tier"), "tier"), F.when(differs("link_count"), "links"),
        F.when(kept & (F.col("o_confidence_decay") - F.col("n_confidence_decay") > drop), "confidence"),
    ))
    return both.select("slug", F.explode(kinds).alias("change"))


def debt_delta(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Counts by (layer, check) that grew."""
    total = lambda t, name: t.groupBy("layer", "check").agg(F.sum("count").alias(name))
    both = total(current, "now").join(total(baseline, "before"), ["layer", "check"], "full_outer").fillna(0, ["now", "before"])
    return both.withColumn("delta", F.col("now") - F.col("before")).filter("delta > 0").orderBy(F.desc("delta"), "layer", "check")


def union_distinct_ordered(*lists: DataFrame) -> DataFrame:
    """Several ordered lists (slug, pos) as one without repeats: the first list first."""
    out = None
    for k, x in enumerate(lists):
        part = x.select("slug", F.struct(F.lit(k).alias("list"), F.col("pos").cast("long").alias("pos")).alias("at"))
        out = part if out is None else out.unionByName(part)
    one = out.groupBy("slug").agg(F.min("at").alias("at")).select("slug", F.col("at.list").alias("list"), F.col("at.pos").alias("place"))
    return numbered(one, "list", "place", "slug").select("slug", F.col("pos").cast("long").alias("pos"))
