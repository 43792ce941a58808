"""Consistency probes between stores: what one has and another lacks, found through digests of hash ranges.

Two sets of keys are compared by ranges of their hash: each side gives, for each range, how many keys it has and two sums over them. Equal
stores cost these two aggregates (a row a range) and no join of rows. Where ranges differ, they are cut into finer ones, once more by
digests, and only the keys of what still differs are joined.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.operators import relational
from loomwell.operators.lineage import cut

BITS, LEVELS = 10, 2  # of the hash that a level resolves
SAMPLE = 5


def _range(level: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("key"), 64 - BITS * level)


def digest(keys: DataFrame, level: int = 1) -> DataFrame:
    """(range, n, sum, mix) of distinct keys."""
    h = F.xxhash64("key", F.lit(7))
    return keys.groupBy(_range(level).alias("range")).agg(F.count("*").alias("n"), F.sum(h.bitwiseAND(F.lit(0x7FFFFFFF))).alias("sum"), F.bit_xor(h).alias("mix"))


def differing_ranges(a: DataFrame, b: DataFrame, level: int = 1) -> list[tuple[int, int]]:
    """(range, keys of both sides), for at most 2**BITS ranges for each that differed on the level above."""
    d, e = digest(a, level), digest(b, level).select("range", F.col("n").alias("n2"), F.col("sum").alias("sum2"), F.col("mix").alias("mix2"))
    same = F.col("n").eqNullSafe(F.col("n2")) & F.col("sum").eqNullSafe(F.col("sum2")) & F.col("mix").eqNullSafe(F.col("mix2"))
    apart = d.join(e, "range", "full_outer").filter(~same)
    return [tuple(r) for r in apart.select("range", F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).collect()]


def differences(a: DataFrame, b: DataFrame, most_ranges: int = 256, few_keys: int = 1_000_000) -> DataFrame:
    """(key, only_in) of the keys of a(key) and b(key) that the other lacks: 'a' or 'b'. Both hold different keys, without nulls (see keys).
    Ranges are cut finer while they hold more than ``few_keys`` keys and are at most ``most_ranges``."""
    for level in range(1, LEVELS + 1):
        ranges = differing_ranges(a, b, level)
        if not ranges:
            return a.limit(0).withColumn("only_in", F.lit("a"))
        if len(ranges) > most_ranges:  # they differ all over: the join below takes what is left
            break
        a, b = (x.filter(_range(level).isin(*[r for r, _ in ranges])) for x in (a, b))
        if sum(n for _, n in ranges) <= few_keys:
            break
    both = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), "key", "full_outer")
    return both.filter(F.col("in_a").isNull() | F.col("in_b").isNull()).select("key", F.when(F.col("in_b").isNull(), "a").otherwise("b").alias("only_in"))


def keys(table: DataFrame, column: str) -> DataFrame:
    """The different values of a column, without null, kept: they are compared more than once."""
    return cut(table.filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("key")).distinct())


def finding(rows: DataFrame, layer: str, check: str, severity: str, slug: str = "slug", n: Column | None = None) -> DataFrame:
    """Findings; a row stands for ``n`` of one slug, if given, else for one."""
    return rows.select(F.lit(f"{layer}.{check}").alias("check"), F.lit(layer).alias("layer"), F.lit(severity).alias("severity"), F.col(slug).alias("slug"), (F.lit(1) if n is None else n).cast("long").alias("n"))


@dataclass
class Stores:
    """files(path, slug, size, state): Markdown below the vault with the slug of their frontmatter, if any; state ok, outside or unreadable.
    managers(slug, reports_to); indexed(slug) and embedded(slug): pages of the text index and of the vectors; quarantine(slug)."""

    pages: DataFrame
    links: DataFrame
    chunks: DataFrame
    tags: DataFrame
    aliases: DataFrame
    timeline: DataFrame
    files: DataFrame
    managers: DataFrame
    indexed: DataFrame
    embedded: DataFrame
    quarantine: DataFrame
    _keys: dict = field(default_factory=dict)

    def keys(self, name: str, column: str) -> DataFrame:
        if (name, column) not in self._keys:
            self._keys[name, column] = keys(getattr(self, name), column)
        return self._keys[name, column]


def text_probe(s: Stores) -> DataFrame:
    apart = differences(s.keys("chunks", "page_slug"), s.keys("indexed", "slug"))
    return finding(apart.filter("only_in = 'a'"), "text", "coverage_gap", "warning", "key").unionByName(finding(apart.filter("only_in = 'b'"), "text", "stale_rows", "warning", "key"))


def vector_probe(s: Stores) -> DataFrame:
    apart = differences(s.keys("chunks", "page_slug"), s.keys("embedded", "slug"))
    return finding(apart.filter("only_in = 'a'"), "vectors", "coverage_gap", "error", "key")


def vault_probe(s: Stores) -> DataFrame:
    """Pages without their file and files without their page; of what both know by slug, other paths."""
    owned = s.files.filter("slug is not null AND state = 'ok'")
    out = finding(differences(keys(owned, "slug"), s.keys("pages", "slug")).filter("only_in = 'a'"), "vault", "file_without_page", "error", "key")
    lost = differences(s.keys("pages", "file_path"), keys(s.files.filter("state = 'ok'"), "path")).filter("only_in = 'a'").select(F.col("key").alias("file_path"))
    out = out.unionByName(finding(s.pages.join(lost, "file_path"), "vault", "page_without_file", "error"))
    # what differs as (slug, path) but not as slug
    line = lambda t, path: keys(t.select(F.concat_ws("\n", "slug", path).alias("line")), "line")
    odd = differences(line(owned, "path"), line(s.pages.filter("file_path is not null"), "file_path")).filter("only_in = 'a'").select(F.split("key", "\n")[0].alias("slug"))
    return out.unionByName(finding(odd.join(s.pages.select("slug"), "slug", "left_semi"), "vault", "path_mismatch", "warning"))


def hygiene_probe(s: Stores) -> DataFrame:
    out = finding(s.files.filter("size = 0 AND path LIKE '%.md'"), "hygiene", "zero_byte", "warning", "path")
    return out.unionByName(finding(s.files.filter("state = 'outside'"), "hygiene", "review_required", "warning", "path")).unionByName(finding(s.files.filter("state = 'unreadable'"), "hygiene", "scan_incomplete", "warning", "path"))


def hierarchy_probe(s: Stores) -> DataFrame:
    named = s.managers.filter("reports_to <> ''")
    whole = F.col("reports_to").contains("/")
    edge = s.links.filter("relation = 'reports_to' AND (trust_state IS NULL OR trust_state IN ('trusted', 'user_thought'))").select(F.col("from_slug").alias("slug"), F.col("to_slug").alias("reports_to"))
    return finding(named.filter(~whole), "hierarchy", "malformed_reports_to", "error").unionByName(finding(named.filter(whole).join(edge, ["slug", "reports_to"], "left_anti"), "hierarchy", "graph_mismatch", "error"))


def table_probe(s: Stores) -> DataFrame:
    shared = s.pages.groupBy("title").agg(F.count("*").alias("n")).filter("n > 1").select("title")
    bare = differences(s.keys("pages", "slug"), s.keys("chunks", "page_slug")).filter("only_in = 'a'")
    return (
        finding(s.pages.join(shared, "title", "left_semi"), "tables", "title_collision", "error").unionByName(finding(bare, "tables", "page_without_chunks", "warning", "key"))
        .unionByName(finding(relational.zero_link_records(s.pages, s.chunks, s.tags, s.links), "tables", "zero_link_rich_records", "warning")).unionByName(finding(s.quarantine, "tables", "quarantine_context", "info"))
    )


def orphan_probe(s: Stores) -> DataFrame:
    """Rows that name a page that is not there, by table. Names are counted and kept once: links are neither derived nor gathered again to say
    how many rows a lost name has."""
    out = None
    ends = {"links": relational.link_ends(s.links).select("slug", F.col("rows").alias("n"))} | {n: getattr(s, n).groupBy(F.col("page_slug").alias("slug")).agg(F.count("*").alias("n")) for n in ("chunks", "tags", "aliases", "timeline")}
    for name, rows in ends.items():
        named = cut(rows.filter("slug is not null").select(F.col("slug").cast("string").alias("key"), "n"))
        lost = differences(named.select("key"), s.keys("pages", "slug")).filter("only_in = 'a'").select("key")
        part = finding(named.join(lost, "key", "left_semi"), "tables", f"orphan_{name}", "warning", "key", F.col("n"))
        out = part if out is None else out.unionByName(part)
    return out


PROBES = {"tables": table_probe, "orphans": orphan_probe, "text": text_probe, "vectors": vector_probe, "hierarchy": hierarchy_probe, "vault": vault_probe, "hygiene": hygiene_probe}


def probe(stores: Stores, families: tuple[str, ...] = tuple(PROBES)) -> DataFrame:
    """(check, layer, severity, slug, n) of all findings of these families; a row stands for n of them."""
    out = None
    for name in families:
        part = PROBES[name](stores)
        out = part if out is None else out.unionByName(part)
    return out


def report(found: DataFrame, k: int = SAMPLE) -> DataFrame:
    """(check, layer, severity, n, sample): a sample is k anonymous names (hashes) of different pages, those that sort first. Each task keeps k
    a check before the exchange."""
    counts = found.groupBy("check", "layer", "severity").agg(F.sum("n").alias("n"))
    name = F.substring(F.sha2(F.col("slug"), 256), 1, 12)
    w = Window.partitionBy("check").orderBy("name")
    some = found.select("check", name.alias("name")).distinct().withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
    some = some.groupBy("check").agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("sample"))
    return counts.join(some, "check", "left")


def gate(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """(check, before, now, state): a check is worse, better or same against a baseline (check, n); any worse error closes the gate."""
    now = found.groupBy("check", "severity").agg(F.sum("n").alias("now"))
    j = now.join(baseline.select("check", F.col("n").alias("before")), "check", "full_outer").fillna(0, ["now", "before"])
    state = F.when(F.col("now") > F.col("before"), "worse").when(F.col("now") < F.col("before"), "better").otherwise("same")
    return j.select("check", "before", "now", state.alias("state"), (F.coalesce(F.col("severity") == "error", F.lit(False)) & (state == "worse")).alias("closes"))
