"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors are turned into integers, floor(scale * x). The table is ordered into document ranges (near vectors together: by the
nearest of a few centres, then by id) and cut into blocks; a block is a forward index of its vectors plus, per dimension
("term"), its maximum and minimum. For a query, a block's bound is the sum over dimensions of the query's value times the
maximum or, for negative values, the minimum: no vector of the block scores higher. A second bound takes the same sum over
the main directions of a sample (an orthogonal change of basis, in which few terms carry most of the norm) plus the product of
the largest norms of what is left; the smaller bound counts. Each task orders its blocks by bound per
query and scores through their forward indexes until the bounds fall below the query's k-th score so far; a bound equal to
it is still scored, so ties are exact, and scores are integer products of the vectors themselves. A query starts with the k-th score over a small set of other vectors, a valid lower bound. Tasks
return each query's best k of their blocks; a window picks the best k of all.

Queries are taken ``query_block`` at a time (chosen by hash, sent to all tasks: its size is bounded, and taken back when its results
are written), so memory does not grow with their number. Centres and directions are fitted on at most 4,096 vectors; they affect speed only, every vector is
indexed. Vectors without any structure (random directions) cannot be pruned by bounds: then each block is scored.

Edge cases: vectors that are null, hold nulls or non-finite values take no part, nor do null ids; vectors of different
lengths have no product and meet only their own length (empty vectors have product 0); of rows with the same id each is a
candidate, and their queries share one ranking; a row with the query's id is no candidate; with fewer than k candidates all are
returned; ties go to the smaller id; scores must fit a long; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.llm.scratch import Scratch, small_batches

BLOCK = 256
SUPER = 16_384  # vectors that a task holds at a time
CENTRES = 64
SAMPLE = 4096


def quantised(df: DataFrame, id_column: str, vector: str, scale: float = 64.0) -> DataFrame:
    """(id, v, d) of the usable rows: v as array<long>, a single 0 for an empty one, and the length."""
    v = F.col(vector).cast("array<double>")
    good = F.col(id_column).isNotNull() & F.col(vector).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.when(F.size(v) == 0, F.array(F.lit(0).cast("long"))).otherwise(F.transform(v, lambda x: F.floor(x * scale)))
    return df.filter(good).select(F.col(id_column).cast("long").alias("id"), whole.alias("v"), F.size(v).alias("d"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matrices in the fastest type in which all inner products are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return a.astype(kind), b.astype(kind)


class Best:
    """The best k (score, id) of each query so far, and the k-th score."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.copy()
        n = len(floor)
        self.rows: list[np.ndarray] = []
        self.held = [np.zeros(0, np.int64)] * 3  # query, score, id
        self.n = n

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, s, i = (np.concatenate(x) for x in zip(self.held, (query, score, ids)))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, np.arange(self.n))
        keep = np.arange(len(q)) - first[q] < self.k
        self.held = [q[keep], s[keep], i[keep]]
        full = np.flatnonzero(np.bincount(self.held[0], minlength=self.n) == self.k)
        last = np.searchsorted(self.held[0], full, "right") - 1
        self.floor[full] = np.maximum(self.floor[full], self.held[1][last])


def main_directions(sample: np.ndarray, share: float = 0.9) -> np.ndarray:
    """Orthonormal columns, the fewest of the sample's principal ones that carry this share of its squared norm."""
    _, size, directions = np.linalg.svd(sample.astype(float), full_matrices=False)
    power = np.cumsum(size**2)
    return directions[: int(np.searchsorted(power, share * power[-1])) + 1].T if power[-1] > 0 else directions[:1].T


def _direction_bounds(q: np.ndarray, v: np.ndarray, cuts: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Bounds (query, block) from terms in the basis and the norms of the rest, widened by more than rounding can lose."""
    q, v = q.astype(float), v.astype(float)
    x, y = q @ basis, v @ basis
    rest = lambda full, part: np.sqrt(np.maximum(0, (full**2).sum(1) - (part**2).sum(1)) + 1e-9 * (full**2).sum(1))
    top, low, left = np.maximum.reduceat(y, cuts), np.minimum.reduceat(y, cuts), np.maximum.reduceat(rest(v, y), cuts)
    bounds = np.maximum(x, 0) @ top.T + np.minimum(x, 0) @ low.T + rest(q, x)[:, None] * left[None, :]
    return bounds + 1e-9 * (np.abs(x) @ np.maximum(np.abs(top), np.abs(low)).T) + 1e-6


def search_blocks(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, best: Best, basis: np.ndarray | None = None) -> int:
    """Score the blocks of ``vectors`` (in range order) for all queries; returns the number of (query, block) visits."""
    q, v = _exact(queries, vectors)
    cuts = np.arange(0, len(v), BLOCK)
    top, low = np.maximum.reduceat(v, cuts), np.minimum.reduceat(v, cuts)
    qf = queries.astype(float)
    bounds = np.maximum(qf, 0) @ top.T.astype(float) + np.minimum(qf, 0) @ low.T.astype(float)
    if q.dtype == np.int64:  # beyond 2**53 a bound is rounded: make it safe
        bounds += 1e-9 * (np.abs(qf) @ np.maximum(np.abs(top), np.abs(low)).T.astype(float))
    if basis is not None:
        bounds = np.minimum(bounds, _direction_bounds(queries, vectors, cuts, basis))
    order = np.argsort(-bounds, axis=1, kind="stable")
    live = np.arange(len(q))
    visits = 0
    for r in range(len(cuts)):
        block = order[live, r]
        go = bounds[live, block] >= best.floor[live]  # later blocks have smaller bounds: a query that stops is done
        live, block = live[go], block[go]
        if not len(live):
            break
        visits += len(live)
        found = []
        by = np.argsort(block, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(block[by]) != 0))
        for a, b in zip(starts, np.append(starts[1:], len(by))):
            mine, c = live[by[a:b]], cuts[block[by[a]]]
            s = q[mine] @ v[c : c + BLOCK].T
            at, col = np.nonzero(s >= best.floor[mine, None])
            if len(at):
                found.append((mine[at], s[at, col].astype(np.int64), ids[c + col]))
        if found:
            qq, ss, ii = (np.concatenate(x) for x in zip(*found))
            other = query_ids[qq] != ii
            best.add(qq[other], ss[other], ii[other])
    return visits


def top_k(df: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector: str = "embedding", scale: float = 64.0, query_block: int = 8192) -> DataFrame:
    """query_id, rank, id, score: for each row where ``is_query`` (a condition on column ``id``), its k best others."""
    spark = df.sparkSession
    small_batches(spark, 10_000)
    scratch = Scratch(spark, "topk")
    rows = scratch.table(quantised(df, id_column, vector, scale), "vectors")
    found = f"{scratch.path}/found"
    sizes = sorted(tuple(r) for r in rows.groupBy("d").count().collect())  # one row a length
    written = [_search(rows.filter(F.col("d") == d).select("id", "v"), max(d, 1), n, is_query, k, query_block, scratch, found) for d, n in sizes]
    scratch.drop("vectors")
    if not any(written):
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    out = spark.read.schema("query_id long, id long, score long").parquet(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def _search(rows: DataFrame, d: int, n: int, is_query: Column, k: int, query_block: int, scratch: Scratch, found: str) -> bool:
    """Write each task's best (query_id, id, score) of the n rows (id, v), all of length d, to the folder ``found``; false if
    there is no query."""
    spark = rows.sparkSession
    threshold = int(1_000_000 * min(1.0, SAMPLE / n))
    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) <= threshold).orderBy(F.xxhash64("id", F.lit("sample")), "v").limit(SAMPLE).toPandas()
    if not len(sample):  # few rows, none of them below the threshold
        sample = rows.limit(SAMPLE).toPandas()
    known_ids, known = sample["id"].to_numpy(np.int64), np.stack(sample["v"].to_numpy()).astype(np.int64)
    centres = known[:CENTRES].astype(float)
    for _ in range(5):  # a few rounds of k-means on the sample
        near = (known @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        for c in np.unique(near):
            centres[c] = known[near == c].mean(0)
    places = spark.sparkContext.broadcast(centres)
    basis = main_directions(known)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = places.value
        for batch in batches:
            v = _matrix(batch.column(1), d)
            near = (v @ m.T - 0.5 * (m**2).sum(1)).argmax(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)], ["id", "v", "near"])

    parts = max(1, -(-n // SUPER))
    ordered = rows.mapInArrow(place, "id long, v array<long>, near int").repartitionByRange(max(parts, spark.sparkContext.defaultParallelism), "near", "id").sortWithinPartitions("near", "id")
    index = scratch.table(ordered, f"index{d}")
    places.destroy()
    n_queries = index.filter(is_query).count()
    for g in range(-(-n_queries // query_block)):
        mine = index.filter(is_query)
        if n_queries > query_block:
            mine = mine.filter(F.pmod(F.xxhash64("id", F.lit("block")), F.lit(-(-n_queries // query_block))) == g)
        got = mine.select("id", "v").toPandas()  # about query_block rows
        if not len(got):
            continue
        q_ids, q = got["id"].to_numpy(np.int64), np.stack(got["v"].to_numpy()).astype(np.int64)
        # the k-th score over the sample's other vectors
        floor = np.full(len(q), np.iinfo(np.int64).min)
        for a in range(0, len(q), 512):
            x, y = _exact(q[a : a + 512], known)
            s = (x @ y.T).astype(np.int64)
            s[q_ids[a : a + 512, None] == known_ids[None, :]] = np.iinfo(np.int64).min
            if s.shape[1] > k:
                floor[a : a + 512] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        shared = spark.sparkContext.broadcast((q_ids, q, floor))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, q, floor = shared.value
            best = Best(floor, k)
            held_i: list[np.ndarray] = []
            held_v: list[np.ndarray] = []

            def search() -> None:
                search_blocks(q, q_ids, np.concatenate(held_v), np.concatenate(held_i), best, basis)
                held_i.clear()
                held_v.clear()

            for batch in batches:
                held_i.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
                held_v.append(_matrix(batch.column(1), d))
                if sum(map(len, held_i)) >= SUPER:
                    search()
            if held_i:
                search()
            qq, ss, ii = best.held
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[qq]), pa.array(ii), pa.array(ss)], ["query_id", "id", "score"])

        index.select("id", "v").mapInArrow(run, "query_id long, id long, score long").write.mode("append").parquet(found)
        shared.destroy()
    return n_queries > 0
