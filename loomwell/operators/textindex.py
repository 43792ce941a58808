"""A stored trigram index: immutable segments of blocks with positions, and a manifest that says which segments hold.

A block is the text of some whole pages. For each of its trigrams it has one row: the pages (numbered inside the block), chunks and
places of all occurrences, as three arrays of equal length in text order, and how many occurrences and pages these are. One more
row a block names the pages and their lengths. The rows are written as their block is scanned, sorted by trigram, in small Parquet pages: a
search skips the pages of other trigrams by their bounds, and no index row is shuffled or sorted. Counts of all trigrams read no array.

An update writes one new segment: the new text of the changed pages, and their names as tombstones. A page of a segment is dead if a
later segment names it. Nothing that is stored changes; a merge rewrites a run of neighbouring segments into one without what is dead.
The manifest is a versioned table, replaced last, so readers see the state before or after, also if a job dies between.

The scan of a block takes time in proportion to its text (and the sort of its trigrams): no substring is cut out of a text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.operators import knowledge
from loomwell.operators.lineage import stored

BLOCK_CHARS = 1_000_000
PAGE_ROWS = 1000  # rows of a Parquet page: what a search reads of a block at least
#: How the rows are stored: pages and places rise within a list, so they are kept as differences instead of dictionary codes.
STORED_AS = {
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary#page.list.element": "false",
    "parquet.enable.dictionary#place.list.element": "false",
    "compression": "zstd",
}
SCHEMA = "term string, block long, page array<int>, chunk array<int>, place array<int>, n long, n_pages long, slugs array<string>, lengths array<long>"


# ---- building ----

def _block(block: int, rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    """The rows of one block of chunks (slug, chunk, lower-cased text), which are in order."""
    slugs = list(dict.fromkeys(r[0] for r in rows))
    number = {s: i for i, s in enumerate(slugs)}
    size = np.array([len(r[2]) for r in rows], np.int64)
    page = np.array([number[r[0]] for r in rows], np.int32)
    chunk = np.array([r[1] for r in rows], np.int32)
    codes = np.frombuffer("".join([r[2] for r in rows]).encode("utf-32-le"), np.uint32).astype(np.int64)
    start = np.cumsum(size) - size
    row = np.repeat(np.arange(len(rows), dtype=np.int32), size)
    at = np.flatnonzero(row[:-2] == row[2:]) if len(codes) > 2 else np.zeros(0, np.int64)
    key = codes[at] << 42 | codes[at + 1] << 21 | codes[at + 2]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    bounds = np.append(first, len(key)).astype(np.int32)
    of = row[at]
    pages = page[of]
    fresh = np.ones(len(key), bool)
    fresh[1:] = pages[1:] != pages[:-1]
    fresh[first] = True
    points = np.stack([key[first] >> 42, key[first] >> 21 & 0x1FFFFF, key[first] & 0x1FFFFF], 1).astype(np.uint32)
    text = points.tobytes().decode("utf-32-le")
    n = len(first)
    lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32())) for x in (pages, chunk[of], (at - start[of]).astype(np.int32))]
    n_pages = np.add.reduceat(fresh.astype(np.int64), first) if n else np.zeros(0, np.int64)
    lengths = np.bincount(page, np.maximum(size - 2, 0), len(slugs)).astype(np.int64)
    names = pa.RecordBatch.from_arrays(
        [pa.nulls(1, pa.string()), pa.array([block]), *(pa.nulls(1, pa.list_(pa.int32())) for _ in range(3)), pa.array([int(lengths.sum())]), pa.array([len(slugs)]), pa.array([slugs], pa.list_(pa.string())), pa.array([lengths.tolist()], pa.list_(pa.int64()))],
        _NAMES,
    )
    grams = pa.RecordBatch.from_arrays(
        [pa.array([text[3 * i : 3 * i + 3] for i in range(n)], pa.string()), pa.array(np.full(n, block)), *lists, pa.array(np.diff(bounds).astype(np.int64)), pa.array(n_pages), pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.list_(pa.int64()))],
        _NAMES,
    )
    return pa.Table.from_batches([names, grams]).combine_chunks().to_batches()[0]


_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def scan(chunks: DataFrame, seq: int, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of the blocks of chunks (page_slug, chunk_index, content). Pages are brought together whole: a page is one file's text,
    so a block holds ``block_chars`` characters, or one longer page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = seq << 44 | TaskContext.get().partitionId() << 22
        held: list[tuple[str, int, str]] = []
        chars = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if chars >= block_chars and row[0] != held[-1][0]:
                    yield _block(block, held)
                    block, held, chars = block + 1, [], 0
                held.append(row)
                chars += len(row[2])
        if held:
            yield _block(block, held)

    rows = chunks.select(F.col("page_slug").cast("string"), F.coalesce("chunk_index", F.lit(0)).cast("int").alias("chunk_index"), F.lower(F.coalesce("content", F.lit(""))).alias("low"))
    rows = rows.filter("page_slug is not null").repartition("page_slug").sortWithinPartitions("page_slug", "chunk_index", "low")
    return rows.mapInArrow(run, SCHEMA)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, block, page, tf) of rows (term, block, page): each page once, with its number of occurrences. Pages rise within a row."""
    for batch in batches:
        pages = batch.column(2)
        size = np.diff(pages.offsets.to_numpy()).astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        page = pages.flatten().to_numpy()
        first = np.ones(len(page), bool)
        first[1:] = (page[1:] != page[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(first)
        bounds = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row[first], minlength=len(size))))).astype(np.int32))
        tf = np.diff(np.append(first, len(page))).astype(np.int32)
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (page[first], tf)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["term", "block", "page", "tf"])


def _write(rows: DataFrame, path: str) -> None:
    """Rows in the order in which they come: block by block, each sorted by trigram."""
    rows.write.mode("overwrite").options(**STORED_AS).parquet(path)


def _dead(page: Column) -> Column:
    return F.coalesce(F.get("gone", page), F.lit(False))


@dataclass
class TextIndex:
    """The index stored in a folder. Slugs that no segment holds are no pages of it."""

    spark: SparkSession
    path: str
    #: Without effect; callers of older indexes give it.
    buckets: int = 64
    #: Segments that something else commits, instead of the folder's own manifest.
    fixed: dict[int, str] | None = None

    # ---- segments ----

    def segments(self) -> dict[int, str]:
        """Numbers and folders of the segments that hold, oldest first: a few."""
        if self.fixed is not None:
            return dict(sorted(self.fixed.items()))
        return dict(sorted((r.seq, r.folder) for r in knowledge.read_table(self.spark, f"{self.path}/manifest").collect()))

    def _commit(self, segments: dict[int, str]) -> None:
        if self.fixed is not None:
            self.fixed = dict(segments)
            return
        knowledge.replace_table(self.spark.createDataFrame(list(segments.items()), "seq long, folder string"), f"{self.path}/manifest")

    def fork(self, path: str) -> TextIndex:
        """Another index with the same content, whose own segments will lie below ``path``; nothing is copied."""
        out = TextIndex(self.spark, path, self.buckets)
        out._commit(self.segments())
        return out

    @classmethod
    def build(cls, chunks: DataFrame, path: str, buckets: int = 64, block_chars: int = BLOCK_CHARS, fixed: dict[int, str] | None = None) -> TextIndex:
        index = cls(chunks.sparkSession, path, buckets, fixed)
        index._commit({1: index._segment(1, chunks, None, block_chars)})
        return index

    def _segment(self, seq: int, chunks: DataFrame, gone: DataFrame | None, block_chars: int) -> str:
        folder = f"{self.path}/s{seq}"
        _write(scan(chunks, seq, block_chars), f"{folder}/rows")
        gone = chunks.sparkSession.createDataFrame([], "slug string") if gone is None else gone.select("slug").distinct()
        gone.write.mode("overwrite").parquet(f"{folder}/gone")
        return folder

    def update(self, changed: DataFrame, chunks: DataFrame, block_chars: int = BLOCK_CHARS) -> int:
        """Give the pages ``changed`` (slug) these chunks; pages without chunks leave the index. Only their text is read or written."""
        held = self.segments()
        seq = max(held) + 1
        own = chunks.join(changed.select(F.col("slug").alias("page_slug")).distinct(), "page_slug", "left_semi")
        self._commit(held | {seq: self._segment(seq, own, changed, block_chars)})
        return seq

    def merge(self, most: int = 4) -> int:
        """If there are more than ``most`` segments, rewrite the newest of them into one, so that ``most`` are left. Returns their number."""
        held = self.segments()
        if len(held) <= most:
            return len(held)
        run = dict(list(held.items())[most - 1 :])
        target = max(run) + 1
        # one pass over the rows, which stay where they are: those of a block that lost pages drop these, and its names row forgets them
        rows = self._with_gone(run)
        whole = F.col("gone").isNull()
        kept = F.when(~whole & F.col("term").isNotNull(), F.filter(F.arrays_zip("page", "chunk", "place"), lambda x: ~_dead(x["page"])))
        rows = rows.withColumn("kept", kept).filter(F.col("kept").isNull() | (F.size("kept") > 0))
        cut = F.col("kept").isNotNull()
        part = lambda c: F.when(cut, F.transform("kept", lambda x: x[c])).otherwise(F.col(c)).alias(c)
        n_pages = F.when(cut, F.size(F.array_distinct(F.transform("kept", lambda x: x["page"]))).cast("long")).otherwise(F.col("n_pages"))
        # a dead page keeps its number but loses its name
        slugs = F.when(whole, F.col("slugs")).otherwise(F.transform("slugs", lambda s, i: F.when(_dead(i), F.lit(None)).otherwise(s)))
        out = rows.select("term", "block", part("page"), part("chunk"), part("place"), F.when(cut, F.size("kept").cast("long")).otherwise(F.col("n")).alias("n"), n_pages.alias("n_pages"), slugs.alias("slugs"), "lengths")
        _write(out, f"{self.path}/s{target}/rows")
        self._gone(run).select("slug").distinct().write.mode("overwrite").parquet(f"{self.path}/s{target}/gone")
        self._commit({s: f for s, f in held.items() if s not in run} | {target: f"{self.path}/s{target}"})
        return most

    # ---- reading ----

    def _rows(self, held: dict[int, str] | None = None) -> DataFrame:
        out = None
        for s, folder in (self.segments() if held is None else held).items():
            part = self.spark.read.schema(SCHEMA).parquet(f"{folder}/rows").withColumn("seq", F.lit(s).cast("long"))
            out = part if out is None else out.unionByName(part)
        return out

    def _gone(self, held: dict[int, str]) -> DataFrame:
        out = None
        for s, folder in held.items():
            part = self.spark.read.schema("slug string").parquet(f"{folder}/gone").withColumn("until", F.lit(s).cast("long"))
            out = part if out is None else out.unionByName(part)
        return out

    def _pages(self, held: dict[int, str] | None = None) -> DataFrame:
        held = self.segments() if held is None else held
        named = self._rows(held).filter("term is null").select("seq", "block", F.posexplode(F.arrays_zip("slugs", "lengths")).alias("page", "p"))
        named = named.select("seq", "block", "page", F.col("p.slugs").alias("slug"), F.col("p.lengths").alias("dl")).filter("slug is not null")
        if len(held) == 1:
            return named.withColumn("dead", F.lit(False))
        last = self._gone(held).groupBy("slug").agg(F.max("until").alias("until"))
        return named.join(last, "slug", "left").withColumn("dead", F.coalesce(F.col("until") > F.col("seq"), F.lit(False))).drop("until")

    def _with_gone(self, held: dict[int, str]) -> DataFrame:
        """The rows with ``gone``: whether each page of their block, by number, is dead (null: none is; numbers beyond the last dead page are left
        out). That is a flag a page, so it is sent to the rows; a join by block would shuffle the index."""
        dead = self._pages(held).filter("dead").groupBy("block").agg(F.collect_set("page").alias("dead"))  # a block's pages at most
        dead = dead.select("block", F.transform(F.sequence(F.lit(0), F.array_max("dead")), lambda i: F.array_contains("dead", i)).alias("gone"))
        return self._rows(held).join(F.broadcast(dead), "block", "left")

    def pages(self) -> DataFrame:
        """The pages that hold: block, page, slug, dl (trigrams of all its chunks)."""
        return self._pages().filter("not dead").select("block", "page", "slug", "dl")

    def rows_of(self, terms: Sequence[str]) -> DataFrame:
        return self._rows().filter(F.col("term").isin(*terms))

    def counts(self, terms: Sequence[str]) -> DataFrame:
        """term, slug, tf, dl of the pages that hold any of the terms."""
        found = self.rows_of(terms).select("term", "block", F.explode("page").alias("page")).groupBy("term", "block", "page").agg(F.count("*").cast("double").alias("tf"))
        return found.join(self.pages(), ["block", "page"]).select("term", "slug", "tf", "dl")

    def phrases(self, phrase: str) -> DataFrame:
        """slug, tf, dl: how often pages hold a phrase of 3 characters or more (lower case), without overlaps. From positions alone: the
        trigrams of an occurrence stand at neighbouring places of one chunk."""
        terms = [phrase[i : i + 3] for i in range(len(phrase) - 2)]
        places = {t: [i for i, x in enumerate(terms) if x == t] for t in terms}
        offsets = F.create_map(*[x for t, at in places.items() for x in (F.lit(t), F.array(*map(F.lit, at)))])
        seen = self.rows_of(list(places)).select("block", F.explode(offsets[F.col("term")]).alias("i"), F.arrays_zip("page", "chunk", "place").alias("z"))
        seen = seen.select("block", "i", F.explode("z").alias("z")).select("block", "z.page", "z.chunk", (F.col("z.place") - F.col("i")).alias("start"))
        starts = seen.groupBy("block", "page", "chunk", "start").agg(F.count("*").alias("n")).filter(F.col("n") == len(terms))
        if any(phrase.startswith(phrase[k:]) for k in range(1, len(phrase))):  # it can overlap itself: take the leftmost, and on from its end
            size = len(phrase)
            step = lambda s, x: F.when(x >= s["free"], F.struct((s["n"] + 1).alias("n"), (x + size).alias("free"))).otherwise(s)
            zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("free"))
            per = starts.groupBy("block", "page", "chunk").agg(F.array_sort(F.collect_list("start")).alias("a"))  # a chunk's
            per = per.select("block", "page", F.aggregate("a", zero, step)["n"].alias("n")).groupBy("block", "page").agg(F.sum("n").alias("tf"))
        else:
            per = starts.groupBy("block", "page").agg(F.count("*").alias("tf"))
        return per.join(self.pages(), ["block", "page"]).select("slug", F.col("tf").cast("double").alias("tf"), "dl")

    def term_counts(self) -> DataFrame:
        """term, df, cf of all trigrams. Blocks without dead pages give theirs without their arrays being read."""
        held = self.segments()
        rows = self._rows(held).filter("term is not null")
        if len(held) == 1:
            return rows.groupBy("term").agg(F.sum("n_pages").alias("df"), F.sum("n").alias("cf"))
        rows = self._with_gone(held).filter("term is not null")
        left = F.filter("page", lambda p: ~_dead(p))
        whole = F.col("gone").isNull()
        n = F.when(whole, F.col("n")).otherwise(F.size(left))
        n_pages = F.when(whole, F.col("n_pages")).otherwise(F.size(F.array_distinct(left)))
        return rows.select("term", n.alias("n"), n_pages.alias("n_pages")).groupBy("term").agg(F.sum("n_pages").alias("df"), F.sum("n").alias("cf")).filter("cf > 0")

    def page_terms(self) -> DataFrame:
        """term, slug, tf of all trigrams of all pages: as long as the pages' texts. Occurrences are counted within their row; what meets the names
        of a block's pages is a list of pages and counts a row."""
        held = self.segments()
        rows = self._rows(held) if len(held) == 1 else self._with_gone(held)
        names = F.col("slugs") if len(held) == 1 else F.transform("slugs", lambda s, i: F.when(~_dead(i), s))
        names = stored(rows.filter("term is null").select("block", names.alias("slugs")))
        found = self._rows(held).filter("term is not null").select("term", "block", "page").mapInArrow(_counted, "term string, block long, page array<int>, tf array<int>")
        found = found.join(names, "block").select("term", F.explode(F.arrays_zip("page", "tf")).alias("e"), "slugs")
        return found.select("term", F.get("slugs", F.col("e.page")).alias("slug"), F.col("e.tf").cast("long").alias("tf")).filter("slug is not null")
