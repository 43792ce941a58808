"""Cutting the lineage of iterations, and tables that a session keeps."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_kept: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster shares; a temporary one only with a local master."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="loomwell-"))


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written as compressed columns below the checkpoint folder: computed once, where ``cut`` computes its last stage twice and
    writes whole rows. For tables that are as long as the input; the order of rows and partitions is not kept."""
    path = f"{shared_folder(df.sparkSession)}/loomwell-{df.sparkSession.sparkContext.applicationId}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, name: str, build, partition_by: str | None = None) -> DataFrame:
    """The table that ``build()`` gives, written when the session first asks for the name and read from then on."""
    key = (spark.sparkContext.applicationId, name)
    path = _kept.get(key)
    jvm = spark.sparkContext._jvm
    if path is not None:
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            path = None
    if path is None:
        path = f"{shared_folder(spark)}/loomwell-{key[0]}/{name}"
        writer = build().write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        _kept[key] = path
    return spark.read.parquet(path)


def kept_folder(spark: SparkSession, name: str, build) -> str:
    """A folder that ``build(path)`` fills when the session first asks for the name. What marks it done is written last."""
    key = (spark.sparkContext.applicationId, name)
    path = f"{shared_folder(spark)}/loomwell-{key[0]}/{name}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_DONE")
    fs = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(done):
        fs.delete(done.getParent(), True)
        build(path)
        fs.create(done, True).close()
    return path


def content_mark(spark: SparkSession, paths: list[str]) -> str:
    """A name for the present content of files or folders: their names, sizes and times, so that a table that is rewritten gets another."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(conf)
        if fs.exists(where):
            files = fs.listStatus(where)
            seen += [f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files]
    return hashlib.md5("\n".join(sorted(seen)).encode()).hexdigest()[:12]


@atexit.register
def _clean() -> None:
    for folder in _local.values():
        shutil.rmtree(folder, ignore_errors=True)
