"""Staged pipelines over tables: named functions from tables to tables, failures kept apart."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Tables = dict[str, DataFrame]
Stage = Callable[[Tables, str], Tables]


@dataclass
class Report:
    stage: str
    ok: bool
    seconds: float
    error: str = ""


LOCK_MINUTES = 30


@dataclass
class Lock:
    """A lock in a folder that all drivers see; one older than ``minutes`` is taken over, since its run has died."""

    spark: SparkSession
    path: str
    minutes: int = LOCK_MINUTES

    def _file(self):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def acquire(self, now: float) -> bool:
        fs, where = self._file()
        if fs.exists(where):
            if now - fs.getFileStatus(where).getModificationTime() / 1000 < 60 * self.minutes:
                return False
            fs.delete(where, False)
        return bool(fs.createNewFile(where))  # fails if another run was faster

    def release(self) -> None:
        fs, where = self._file()
        fs.delete(where, False)


@dataclass
class Nightly:
    """Runs stages in order; each result is written below ``path`` and read again, so a failed stage changes nothing and a lost
    executor costs a reread. ``progress`` may raise to stop between stages."""

    path: str
    stages: Sequence[tuple[str, Stage]]
    progress: Callable[[str], None] = lambda name: None
    reports: list[Report] = field(default_factory=list)
    lock: Lock | None = None

    def run(self, tables: Tables, as_of: str) -> Tables:
        if self.lock and not self.lock.acquire(time.time()):
            self.reports.append(Report("lock", False, 0.0, "another run holds the lock"))
            return tables
        try:
            return self._run(tables, as_of)
        finally:
            if self.lock:
                self.lock.release()

    def _run(self, tables: Tables, as_of: str) -> Tables:
        for name, stage in self.stages:
            self.progress(name)
            began = time.monotonic()
            try:
                new = {}
                for table, df in stage(dict(tables), as_of).items():
                    if df is not tables.get(table):
                        where = f"{self.path}/{name}/{table}"
                        df.write.mode("overwrite").parquet(where)
                        new[table] = df.sparkSession.read.parquet(where)
                tables = tables | new
                self.reports.append(Report(name, True, time.monotonic() - began))
            except Exception as e:  # a stage's failure must not stop the rest
                self.reports.append(Report(name, False, time.monotonic() - began, str(e)[:500]))
        return tables
