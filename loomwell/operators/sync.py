"""Synchronising files into one store of pages, chunks, text index and vectors, each batch committed whole.

Pages, chunks and vectors lie in buckets by a hash of the page's slug. A batch writes anew only the buckets that hold a changed page, into
folders of its own, and one more segment of the text index; then one commit puts all of them into the manifest. Until then readers, who
read what the manifest names, see the old version of every table, also if the batch dies; after it they see the new one of every table.
A batch whose id is in the manifest, or that changes nothing, commits nothing.

What a batch does with a file (actions):
  add, update   a new slug, or other text
  redo          the same text, but chunks, text index or vectors of the page are not complete
  promote       a person whose title a record has: the record gives way to it
  skip          nothing to do; also a record whose title a person has (discarded)
  duplicate     several files claim one slug; none is taken
  quarantine    the title belongs to another page; the first file by path keeps a title that several new ones claim
  delete        (whole scans only) the page's file is gone
A quarantined file is looked at again in each batch that holds it, so it enters once its title is free.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from loomwell.operators import knowledge
from loomwell.operators.lineage import stored
from loomwell.operators.textindex import TextIndex
from loomwell.sources import vault

SCHEMAS = {
    "pages": "slug string, file_path string, title string, type string, content_hash string, chunks long, bucket int",
    "chunks": "page_slug string, chunk_index int, content string, bucket int",
    "vectors": "page_slug string, chunk_index int, vector array<float>, bucket int",
    "quarantine": "slug string, file_path string, title string, existing string, content_hash string, bucket int",
}
APPLIED = ("add", "update", "redo", "promote")
PERSON, RECORD = "entity/person", "record"


@dataclass
class Snapshot:
    """The tables of one manifest version, and its text index."""

    pages: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    quarantine: DataFrame
    text: TextIndex


@dataclass
class Store:
    """``embed`` makes a vector of the column content; ``size`` is the length of chunks."""

    spark: SparkSession
    path: str
    embed: Column
    buckets: int = 32
    size: int = 500

    # ---- manifest ----

    def _manifest(self) -> dict[tuple[str, int], str]:
        """(table, bucket or segment) -> folder; ('batch', 0) -> the ids of the last batches. Some hundred rows."""
        if not knowledge.has_table(self.spark, f"{self.path}/manifest"):
            return {}
        return {(r["name"], r["part"]): r["folder"] for r in knowledge.read_table(self.spark, f"{self.path}/manifest").collect()}

    def _table(self, name: str, manifest: dict[tuple[str, int], str]) -> DataFrame:
        folders = sorted(f for (n, _), f in manifest.items() if n == name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMAS[name])

    def _text(self, manifest: dict[tuple[str, int], str]) -> TextIndex:
        held = {part: f for (n, part), f in sorted(manifest.items()) if n == "text"}
        return TextIndex(self.spark, f"{self.path}/text", fixed=held)

    def snapshot(self) -> Snapshot:
        m = self._manifest()
        return Snapshot(*(self._table(n, m) for n in SCHEMAS), self._text(m))

    # ---- plan ----

    def _bucket(self, slug: Column) -> Column:
        return F.pmod(F.xxhash64(slug), F.lit(self.buckets)).cast("int")

    def plan(self, files: DataFrame, now: Snapshot, whole: bool = False) -> DataFrame:
        """(slug, action, existing, ...) of files (file_path, slug, title, type, content_hash, due); ``whole``: they are all there are. ``due`` is
        how many chunks a file gives; no text is compared, exchanged or kept here."""
        n = F.count("*").alias("files")
        own = files.groupBy("slug").agg(n, *[F.min_by(c, "file_path").alias(c) for c in ("title", "type", "content_hash", "due")], F.min("file_path").alias("file_path"))
        have = now.chunks.groupBy(F.col("page_slug").alias("slug")).agg(F.count("*").alias("n_chunks"), F.sum(F.greatest(F.length(F.lower("content")) - 2, F.lit(0))).cast("long").alias("grams"))
        vecs = now.vectors.groupBy(F.col("page_slug").alias("slug")).agg(F.count("*").alias("n_vectors"))
        words = now.text.pages().select("slug", "dl") if now.text.fixed else self.spark.createDataFrame([], "slug string, dl long")
        old = now.pages.select("slug", F.col("content_hash").alias("old_hash")).join(have, "slug", "left").join(vecs, "slug", "left").join(words, "slug", "left")
        j = own.join(old, "slug", "full_outer" if whole else "left")
        count = lambda c: F.coalesce(F.col(c), F.lit(0))
        complete = (count("n_chunks") == F.col("due")) & (count("n_vectors") == F.col("due")) & (count("dl") == count("grams"))
        action = (
            F.when(F.col("files").isNull(), "delete").when(F.col("files") > 1, "duplicate").when(F.col("old_hash").isNull(), "add")
            .when(F.col("old_hash") != F.col("content_hash"), "update").when(~complete, "redo").otherwise("skip")
        )
        rows = stored(j.withColumn("action", action).select("slug", "file_path", "title", "type", "content_hash", "action"))
        # an update that is held back leaves its page, which then keeps its title: decide again, until no more are held
        kept, n_kept = None, 0
        while True:
            out = self._titles(rows, now, kept)
            held = stored(out.filter("action = 'quarantine' AND was = 'update'").select("slug"))
            n = held.count()
            if n == n_kept:
                return out.drop("was")
            kept, n_kept = held, n

    def _titles(self, rows: DataFrame, now: Snapshot, kept: DataFrame | None) -> DataFrame:
        """rows with their actions after titles are looked at: those of the pages that stay as they are, among them ``kept``, then the batch's
        own, of which pages that are there come first and then the first by path. Both sides have one row a title."""
        moving = rows.filter(F.col("action").isin("update", "redo", "delete")).select("slug")
        if kept is not None:
            moving = moving.join(kept, "slug", "left_anti")
        staying = now.pages.join(moving, "slug", "left_anti").filter(F.trim("title") != "").groupBy("title").agg(F.min(F.struct("slug", "type")).alias("holder"))
        writes = F.col("action").isin("add", "update", "redo")
        claims = rows.filter(writes & (F.trim("title") != "")).groupBy("title").agg(F.min(F.struct((F.col("action") == "add").alias("is_new"), "file_path", "slug")).alias("first"))
        rows = rows.join(staying, "title", "left").join(claims, "title", "left")
        held = writes & F.col("holder").isNotNull() & (F.col("holder.slug") != F.col("slug"))
        person = held & (F.col("type") == PERSON) & (F.col("holder.type") == RECORD) & F.col("holder.slug").startswith("records/")
        discard = held & (F.col("type") == RECORD) & (F.col("holder.type") == PERSON)
        second = writes & F.col("first").isNotNull() & (F.col("first.slug") != F.col("slug"))
        final = F.when(second, "quarantine").when(person, "promote").when(discard, "skip").when(held, "quarantine").otherwise(F.col("action"))
        existing = F.when(second, F.col("first.slug")).when(held, F.col("holder.slug"))
        return rows.select("slug", "file_path", "title", "type", "content_hash", F.col("action").alias("was"), final.alias("action"), existing.alias("existing"))

    # ---- apply ----

    def apply(self, files: DataFrame, batch: str, whole: bool = False, before_commit: Callable[[], None] | None = None) -> DataFrame:
        """Bring a batch of files (file_path, text, slug, content_hash) in; returns its plan (slug, action, existing)."""
        manifest = self._manifest()
        done = manifest.get(("batch", 0), "").split(" ")
        if batch in done:
            return self.spark.createDataFrame([], "slug string, action string, existing string")
        now = Snapshot(*(self._table(n, manifest) for n in SCHEMAS), self._text(manifest))
        # files are read, parsed and cut once; only the chunks of those that are taken are moved
        pieces = F.when(F.trim("body") == "", F.array().cast("array<string>")).otherwise(knowledge.pack_paragraphs(F.col("body"), self.size))
        parsed = stored(vault.parse_vault(files).select("slug", "file_path", "title", "type", "content_hash", pieces.alias("pieces")))
        plan = stored(self.plan(parsed.withColumn("due", F.coalesce(F.size("pieces"), F.lit(0)).cast("long")).drop("pieces"), now, whole))
        out = plan.select("slug", "action", "existing")
        taken = plan.filter(F.col("action").isin(*APPLIED))
        gone = plan.filter("action = 'delete'").select("slug").unionByName(plan.filter("action = 'promote'").select(F.col("existing").alias("slug")))
        changed = stored(taken.select("slug").unionByName(gone).distinct())
        held = plan.filter("action = 'quarantine'")
        freed = now.quarantine.join(plan.select("slug"), "slug", "left_semi").select("slug")
        touched = {n: self._touched(df) for n, df in (("pages", changed), ("quarantine", held.select("slug").unionByName(freed)))}
        if not touched["pages"] and not touched["quarantine"]:
            return out  # nothing changes: no commit
        folder = f"{self.path}/batches/{uuid.uuid4().hex}"
        due = parsed.filter(F.size("pieces") > 0).select("slug", "file_path", "pieces").join(taken.select("slug", "file_path"), ["slug", "file_path"], "left_semi")
        chunks = stored(due.select(F.col("slug").alias("page_slug"), F.posexplode("pieces").alias("chunk_index", "content")))
        sizes = chunks.groupBy(F.col("page_slug").alias("slug")).agg(F.count("*").alias("chunks"))
        pages = taken.select("slug", "file_path", "title", "type", "content_hash").join(sizes, "slug", "left").fillna(0, ["chunks"])
        vectors = chunks.select("page_slug", "chunk_index", self.embed.cast("array<float>").alias("vector"))
        new = {"pages": (pages, "slug", changed), "chunks": (chunks, "page_slug", changed), "vectors": (vectors, "page_slug", changed)}
        written = dict(manifest)
        for name, (rows, key, replaced) in new.items():
            written |= self._rewrite(name, rows, key, replaced, touched["pages"], now, folder)
        kept = held.select("slug", "file_path", "title", "existing", "content_hash")
        written |= self._rewrite("quarantine", kept, "slug", plan.select("slug").filter("slug is not null"), touched["quarantine"], now, folder)
        if touched["pages"]:
            text = self._text(manifest)
            if not text.fixed:
                text = TextIndex.build(chunks, f"{folder}/text", fixed={})
            else:
                text.path = f"{folder}/text"
                text.update(changed, chunks)
                text.merge(most=8)
            written = {k: v for k, v in written.items() if k[0] != "text"} | {("text", s): f for s, f in text.fixed.items()}
        written[("batch", 0)] = " ".join([*done[-999:], batch]).strip()
        if before_commit:
            before_commit()
        knowledge.replace_table(self.spark.createDataFrame([(n, p, f) for (n, p), f in written.items()], "name string, part int, folder string").coalesce(1), f"{self.path}/manifest")
        return out

    def _touched(self, slugs: DataFrame) -> list[int]:
        return sorted(r[0] for r in slugs.select(self._bucket(F.col("slug"))).distinct().collect())  # at most the buckets

    def _rewrite(self, name: str, rows: DataFrame, key: str, replaced: DataFrame, touched: list[int], now: Snapshot, folder: str) -> dict[tuple[str, int], str]:
        """Write the touched buckets of a table with the replaced pages' rows exchanged, one folder a bucket."""
        if not touched:
            return {}
        old = getattr(now, name).filter(F.col("bucket").isin(*touched)).join(replaced.select(F.col("slug").alias(key)), key, "left_anti")
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        new = rows.withColumn("bucket", self._bucket(F.col(key)))
        out = old.select(columns).unionByName(new.select(columns)).withColumn("folder", F.col("bucket"))
        out.repartition("folder").sortWithinPartitions("folder", key).write.mode("overwrite").partitionBy("folder").parquet(f"{folder}/{name}")
        filled = {r[0] for r in self.spark.read.parquet(f"{folder}/{name}").select("folder").distinct().collect()} if self._has_rows(f"{folder}/{name}") else set()
        empty = f"{folder}/{name}-empty"
        if set(touched) - filled:
            self.spark.createDataFrame([], SCHEMAS[name]).write.mode("overwrite").parquet(empty)
        return {(name, b): f"{folder}/{name}/folder={b}" if b in filled else empty for b in touched}

    def _has_rows(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return any(f.isDirectory() for f in fs.listStatus(where))


def inbox(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """A stream of the Markdown files that arrive in a folder, as a whole scan gives them. A file is seen once: change a page by a new
    file with the page's slug in its frontmatter, or by a whole scan."""
    stream = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).option("maxFilesPerTrigger", most)
    files = stream.load(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("uri"))
    return vault.with_paths(files, path)


def follow(store: Store, path: str, checkpoint: str, most: int = 1000) -> StreamingQuery:
    """Bring every file that arrives in a folder into the store, a batch at a time, exactly once: a batch that is run again after a crash has
    its old id, which the manifest knows if it was committed."""
    stream = inbox(store.spark, path, most)
    run = lambda batch, number: store.apply(batch, f"{checkpoint.rstrip('/').rsplit('/', 1)[-1]}-{number}") and None
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(availableNow=True).start()
