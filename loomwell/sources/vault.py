"""Markdown folders, snapshots and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.operators import knowledge as N


def scan_vault(spark: SparkSession, path: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(file_path, text, slug, content_hash) of all .md files below a folder; dot entries and excluded folders are skipped."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("uri"))
    return with_paths(files, path, excluded)


def with_paths(files: DataFrame, path: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Files (text, uri) below a folder with their path in it, slug and hash."""
    root = path.split("://", 1)[-1].rstrip("/")
    rel = F.regexp_extract(F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B"))), rf"^.*?\Q{root}\E/(.*)$", 1)
    out = files.withColumn("file_path", rel).filter(~F.col("file_path").rlike(r"(^|/)\."))
    for name in excluded:
        out = out.filter(~(F.col("file_path").startswith(name.rstrip("/") + "/")))
    return out.select("file_path", "text", F.regexp_replace("file_path", r"\.md$", "").alias("slug"), N.fingerprint(F.col("text")).alias("content_hash"))


def parse_vault(files: DataFrame) -> DataFrame:
    """Files with their frontmatter fields, title, type and body; unknown types become 'record'."""
    parsed = files.withColumn("f", N.frontmatter(F.col("text")))
    title = F.coalesce(F.element_at("f.fields", "title"), F.nullif(F.regexp_extract("f.body", r"(?m)^# (.+)$", 1), F.lit("")), F.regexp_extract("slug", r"([^/]+)$", 1))
    kind = F.coalesce(F.element_at("f.fields", "type"), F.lit("record"))
    return parsed.select("slug", "file_path", "content_hash", title.alias("title"), F.when(kind.rlike(r"^(entity|concept)/|^(record|insight|topic)$"), kind).otherwise("record").alias("type"), F.col("f.fields").alias("fields"), F.col("f.body").alias("body"))


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """One text file, in whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_pages(pages: DataFrame, path: str) -> int:
    """Pages (file_path, text) as files below a folder, written by the tasks that hold them; returns their number."""

    def run(batches):
        import pandas as pd
        import pyarrow.fs as afs

        for pdf in batches:
            for name, text in zip(pdf["file_path"], pdf["text"]):
                fs, where = afs.FileSystem.from_uri(f"{path}/{name}") if "://" in path else (afs.LocalFileSystem(), f"{path}/{name}")
                fs.create_dir(where.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(where) as out:
                    out.write((text or "").encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    return pages.select("file_path", "text").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_snapshot(spark: SparkSession, path: str, tries: int = 3) -> DataFrame:
    """The current version of a versioned table: later writes do not change what is read. If the pointer moves while the version is
    opened, which may then be on its way out, the new one is opened instead."""
    for _ in range(tries):
        version = N.current_version(spark, path)
        table = spark.read.parquet(version)
        if N.current_version(spark, path) == version:
            return table
    raise RuntimeError(f"{path} changed {tries} times while it was opened")


def write_index_reports(pages: DataFrame, path: str) -> None:
    """One folder of text lines per page type. Rows stay rows: no group of pages is gathered into one value."""
    line = F.concat(F.lit("- [["), F.col("slug"), F.lit("|"), F.coalesce("title", F.lit("")), F.lit("]]"))
    pages.select(F.regexp_replace("type", "/", "-").alias("kind"), line.alias("value"), "slug").repartitionByRange("kind", "slug").sortWithinPartitions("kind", "slug").select("kind", "value").write.mode("overwrite").partitionBy("kind").text(path)


def write_wakeup(changes: DataFrame, path: str, day: str) -> None:
    """A dated report and the latest one, as JSON."""
    for name in (day, "latest"):
        changes.write.mode("overwrite").json(f"{path}/{name}")


def compact(spark: SparkSession, path: str, target: str, files: int) -> int:
    """Rewrite a table into fewer files; fails if the number of rows changes."""
    table = spark.read.parquet(path)
    before = table.count()
    table.repartition(files).write.mode("overwrite").parquet(target)
    after = spark.read.parquet(target).count()
    if after != before:
        raise ValueError(f"compaction of {path} made {after} rows of {before}")
    return after


def replace_page_rows(table: DataFrame, new: DataFrame, key: str = "page_slug") -> DataFrame:
    """Replace all rows of the pages that ``new`` mentions; an empty body (null content) only deletes."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new.filter("content is not null"))
