"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import time
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}
_open: list[Scratch] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, a temporary folder, but only with a local master."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.applicationId not in _made:
        _made[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="loomwell-")
    return _made[spark.sparkContext.applicationId]


class Scratch:
    """A folder of tables that cut lineage: a lost executor costs a reread, not a recomputation.

    ``release()`` deletes it; call it once nothing reads the frames any more. What is left is released when the driver exits.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/loomwell-{name}-{uuid.uuid4().hex[:12]}"
        _open.append(self)

    def table(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        self._delete(f"{self.path}/{name}")

    def release(self) -> None:
        self._delete(self.path)
        if self in _open:
            _open.remove(self)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _release_all() -> None:
    for scratch in list(_open):
        if scratch.spark.sparkContext._jsc is not None:  # the session still runs
            with contextlib.suppress(OSError, Py4JError):
                scratch.release()
    for path in _made.values():
        shutil.rmtree(path, ignore_errors=True)


def free_shuffles(spark: SparkSession) -> None:
    """Ask the driver to collect garbage, so that the shuffle files of finished jobs can go."""
    for _ in range(2):  # the cleaner works behind; its files count until they are gone
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch, since texts can be long. A smaller setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """At most so many rows in an Arrow batch, and in one of the Parquet reader, for the jobs that run inside: their rows are large."""
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.parquet.columnarReaderBatchSize": "4096"}
    before = {key: spark.conf.get(key, default) for key, default in keys.items()}
    for key in keys:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def filter_documents(docs: DataFrame, decide, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, for which ``decide(text column) -> boolean array`` holds; no shuffle."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(decide(batch.column(at))))

    return docs.mapInArrow(run, docs.schema)
