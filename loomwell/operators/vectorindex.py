"""A stored vector index: lists around centres, each with the distance of its farthest vector, searched exactly.

Centres come from k-means over a bounded sample (``SAMPLE`` vectors, those of least hash); every vector is then put into the list of its
nearest centre, and the lists are stored as folders. By the triangle inequality no vector of a list is nearer to a query than the query's
distance from the centre less the list's radius. So a search first reads each query's nearest lists that hold k vectors together, which
bounds its k-th distance, and then only those lists whose bound is below it: the answer is that of a full scan. Vectors without
structure leave nothing to skip, and then all lists are read.

A block of queries is one matrix, sent to the tasks: at most ``QUERY_BLOCK`` of them at a time, however many there are. A task keeps k rows a
query of each batch of vectors. Metric 'cosine' stores unit vectors, whose squared distance is twice the cosine distance; vectors that
hold nulls or are not finite take no part, nor do those without length under cosine. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwell.operators import knowledge
from loomwell.operators.lineage import cut

SAMPLE, ROUNDS, QUERY_BLOCK = 20_000, 8, 1_000
SLACK = 1e-9  # of rounding, relative


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that can take part, their vectors as doubles)."""
    lengths = np.diff(np.asarray(column.offsets)) if column.null_count == 0 else np.zeros(0)
    if len(lengths) == len(column) and (lengths == dim).all() and column.flatten().null_count == 0:
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        good = np.isfinite(values).all(1)
        return np.flatnonzero(good), values[good]
    rows = [v.as_py() for v in column]
    good = np.array([v is not None and len(v) == dim and None not in v for v in rows], bool)
    values = np.array([v for v, g in zip(rows, good) if g], np.float64).reshape(-1, dim)
    finite = np.isfinite(values).all(1)
    good[np.flatnonzero(good)[~finite]] = False
    return np.flatnonzero(good), values[finite]


def unit(values: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(kept rows, vectors), made unit vectors under cosine."""
    if metric != "cosine":
        return np.arange(len(values)), values
    norm = np.sqrt((values * values).sum(1))
    kept = np.flatnonzero(norm > 0)
    return kept, values[kept] / norm[kept, None]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a from all rows of b, by differences (no cancellation), a slice of a at a time."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        d = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.einsum("ijk,ijk->ij", d, d)
    return out


def centres_of(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means from evenly spaced rows of the sample."""
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    c = sample[np.unique(np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int))]
    for _ in range(rounds):
        near = squared(sample, c).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str

    @classmethod
    def build(cls, vectors: DataFrame, path: str, dim: int, lists: int = 64, metric: str = "l2") -> VectorIndex:
        """Store vectors(id, vector, ...) with all their columns."""
        spark = vectors.sparkSession
        some = vectors.filter("vector is not null").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
        centres = centres_of(unit(matrix(some, dim)[1], metric)[1], lists)
        at = vectors.columns.index("vector")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, values = matrix(batch.column(at), dim)
                kept, values = unit(values, metric)
                if not len(kept) or not len(centres):
                    continue
                d = squared(values, centres)
                near = d.argmin(1)
                taken = batch.take(pa.array(rows[kept]))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), dim).cast(pa.list_(pa.float64()))
                columns = [flat if k == at else c for k, c in enumerate(taken.columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(near.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(near)), near]))], [*batch.schema.names, "list", "radius"])

        schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == 'vector' else f.dataType.simpleString()}" for f in vectors.schema) + ", list int, radius double"
        stored = f"{path}/lists"
        vectors.filter("id is not null").mapInArrow(run, schema).repartition("list", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("list", "radius").write.mode("overwrite").partitionBy("list").parquet(stored)
        stats = spark.read.schema(schema).parquet(stored).groupBy("list").agg(F.count("*").alias("n"), F.max("radius").alias("radius"))
        centre = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")
        out = stats.join(F.broadcast(centre), "list").withColumn("metric", F.lit(metric)).withColumn("schema", F.lit(schema))  # ``lists`` rows
        knowledge.replace_table(out.coalesce(1), f"{path}/centres")
        return cls(spark, path)

    def _lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, str, str]:
        rows = knowledge.read_table(self.spark, f"{self.path}/centres").orderBy("list").collect()  # as many as lists
        centres = np.array([r["centre"] for r in rows]) if rows else np.zeros((0, 0))
        return np.array([r["list"] for r in rows], int), centres, np.array([r["radius"] for r in rows]), np.array([r["n"] for r in rows]), *((rows[0]["metric"], rows[0]["schema"]) if rows else ("l2", ""))

    def search(self, queries: DataFrame, k: int, reads: list[set[int]] | None = None) -> DataFrame:
        """(query, rank, id, distance) of the k nearest vectors of each queries(query, vector): squared distance, or 1 - cosine. ``reads`` gets the
        lists that each step read."""
        out = self.spark.createDataFrame([], "query long, rank int, id long, distance double")
        numbers, centres, radius, size, metric, schema = self._lists()
        if not len(numbers):
            return out
        for names, block in self._blocks(queries, centres.shape[1], metric):
            d = np.sqrt(squared(block, centres))
            low = np.maximum(0.0, d - radius[None, :] - SLACK * (d + radius[None, :]))
            first = np.zeros(d.shape, bool)
            for q, order in enumerate(d.argsort(1, kind="stable")):
                enough = int(np.searchsorted(np.cumsum(size[order]), k)) + 1
                first[q, order[:enough]] = True
            got = cut(self._scan(names, block, first, numbers, schema, k, reads))
            worst = {r["query"]: r["worst"] for r in got.groupBy("query").agg(F.max("distance").alias("worst"), F.count("*").alias("n")).filter(F.col("n") >= k).collect()}  # a row a query of the block
            bound = np.sqrt(np.array([worst.get(x, np.inf) for x in names])) * (1 + SLACK)
            more = ~first & (low <= bound[:, None])
            if more.any():
                got = cut(_best(got.unionByName(self._scan(names, block, more, numbers, schema, k, reads)), k))
            distance = F.col("distance") / 2 if metric == "cosine" else F.col("distance")
            ranked = got.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id")))
            out = out.unionByName(ranked.select("query", "rank", "id", distance.alias("distance")))
        return out

    def _blocks(self, queries: DataFrame, dim: int, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        kept = cut(queries.select(F.col("query").cast("long"), "vector").filter("query is not null and vector is not null"))
        blocks = max(1, -(-kept.count() // QUERY_BLOCK))
        for b in range(blocks):
            part = kept.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).orderBy("query").toArrow()  # about QUERY_BLOCK rows
            rows, values = matrix(part["vector"].combine_chunks(), dim)
            good, values = unit(values, metric)
            if len(good):
                yield part["query"].to_numpy()[rows[good]], values

    def _scan(self, names: np.ndarray, block: np.ndarray, wanted: np.ndarray, numbers: np.ndarray, schema: str, k: int, reads: list[set[int]] | None) -> DataFrame:
        lists = numbers[wanted.any(0)].tolist()
        if reads is not None:
            reads.append(set(lists))
        column = np.full(int(numbers.max()) + 1, -1)
        column[numbers] = np.arange(len(numbers))
        dim = block.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, of = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
                values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                found: list[list] = [[], [], []]
                for one in np.unique(of):
                    mine = np.flatnonzero(of == one)
                    asking = np.flatnonzero(wanted[:, column[one]])
                    d = squared(block[asking], values[mine])
                    for row, q in zip(d, asking):
                        near = np.arange(len(row)) if len(row) <= k else np.flatnonzero(row <= np.partition(row, k - 1)[k - 1])  # ties stay
                        near = near[np.lexsort((ids[mine][near], row[near]))][:k]
                        found[0] += [int(names[q])] * len(near)
                        found[1] += ids[mine][near].tolist()
                        found[2] += row[near].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["query", "id", "distance"])

        rows = self.spark.read.schema(schema).parquet(f"{self.path}/lists").filter(F.col("list").isin(*lists)).select("id", "vector", "list")
        return _best(rows.mapInArrow(run, "query long, id long, distance double"), k)


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query; each task keeps k a query before the exchange."""
    order = Window.partitionBy("query").orderBy("distance", "id")
    return rows.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k).drop("pos")
