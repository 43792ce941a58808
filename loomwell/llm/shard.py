"""Sharding by histogram sort, with DataFrame operations only.

Rows are ordered by (hash of the text, hash of doc_id, number of the row), so copies of a text are neighbours. The splitters of this order are found
by counting: each round counts the exact bytes below a grid of candidate boundaries in those cells of the key space that
still hold a target, over all rows, and descends into one cell per target until the bytes below a boundary meet the
tolerance. Then the rows are exchanged once, to number them. A group of equal texts is cut only where no boundary between
groups is near enough; the descent then goes on inside the group, by doc_id, and among rows that are equal in both by their
number, so that the law holds however many rows are the same. Such rows are interchangeable; all else is the same in each run.

Edge cases: a null text has 0 bytes (size 1) and its crc32 is that of the empty text; rows with a null doc_id are like rows
with one doc_id; repeated rows are all kept (each gets a slot of its own); an empty table gives no rows; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.llm.scratch import Scratch

BITS = 10  # of the key that one round resolves
TIE_BITS = 31


@dataclass(frozen=True)
class Splitter:
    """Rows with (key, tie) below this come before it; ``below``: their bytes. TIE_BITS of the tie are of doc_id, the rest of the row."""

    key: int
    tie: int
    below: int


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *_order())


def _order() -> tuple[Column, Column]:
    """key and tie, 62-bit non-negative longs. The row's number counts only among rows of equal text and doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    number = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - TIE_BITS)
    doc = F.shiftrightunsigned(F.xxhash64(F.lit("tie"), F.coalesce(F.col("doc_id"), F.lit(-1))), 64 - TIE_BITS)
    return F.shiftrightunsigned(F.xxhash64(text), 2).alias("key"), F.shiftleft(doc, TIE_BITS).bitwiseOR(number).alias("tie")


def _histogram(rows: DataFrame, column: str, shift: int, inside: dict[int, Column]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each target, the non-empty grid cells of ``column >> shift`` among the rows that ``inside`` admits: cell, bytes, least and
    greatest value."""
    if not inside:
        return {}
    of = F.array_compact(F.array(*[F.when(cond, F.lit(t)) for t, cond in inside.items()]))
    got = (
        rows.select(F.explode(of).alias("target"), F.shiftright(F.col(column), shift).alias("cell"), "size", F.col(column).alias("value"))
        .groupBy("target", "cell").agg(F.sum("size").alias("bytes"), F.min("value"), F.max("value")).collect()
    )  # at most targets * 2**BITS rows
    cells: dict[int, list[tuple[int, int, int, int]]] = {t: [] for t in inside}
    for target, *cell in got:
        cells[target].append(tuple(cell))
    return {t: sorted(x) for t, x in cells.items()}


def find_splitters(rows: DataFrame, shards: int, total: int, tolerance: float = 0.01, key_bits: int = 62) -> list[Splitter]:
    """The shards - 1 splitters of rows(key, tie, size), each within ``tolerance`` of a shard's bytes of its ideal place,
    or as near as whole rows allow."""
    slack = tolerance * total / shards
    goals = {t: total * t / shards for t in range(1, shards)}
    done: dict[int, Splitter] = {}
    # where a target's boundary lies: key prefix, bytes below that prefix's range, and within a key its tie prefix
    at = {t: {"level": "key", "prefix": 0, "below": 0, "shift": key_bits, "key": None} for t in goals}
    best: dict[int, Splitter] = {}
    while len(done) < len(goals):
        for level in ("key", "tie"):
            live = {t: a for t, a in at.items() if t not in done and a["level"] == level}
            for shift in {a["shift"] for a in live.values()}:
                batch = {t: a for t, a in live.items() if a["shift"] == shift}
                down = max(0, shift - BITS)

                def admits(a: dict) -> Column:
                    cond = F.shiftright(F.col(level), shift) == F.lit(a["prefix"]).cast("long")
                    return cond if level == "key" else (F.col("key") == F.lit(a["key"]).cast("long")) & cond

                # targets in the same range share one histogram
                ranges = {(a["key"], a["prefix"]): t for t, a in batch.items()}
                found = _histogram(rows, level, down, {t: admits(at[t]) for t in ranges.values()})
                for t, a in batch.items():
                    cells, goal = found[ranges[a["key"], a["prefix"]]], goals[t]
                    run = a["below"]
                    chosen = None
                    for cell, size, low, high in cells:
                        edge = cell << down
                        s = Splitter(edge, 0, run) if level == "key" else Splitter(a["key"], edge, run)
                        if t not in best or abs(run - goal) < abs(best[t].below - goal):
                            best[t] = s
                        if run <= goal < run + size:
                            chosen = (cell, run, low, high)
                        run += size
                    past = ((cells[-1][0] + 1) << down) if cells else 0
                    if cells and abs(run - goal) < abs(best[t].below - goal):
                        best[t] = Splitter(past, 0, run) if level == "key" else Splitter(a["key"], past, run)
                    one = chosen is not None and chosen[2] == chosen[3]  # a single value: no boundary inside
                    if abs(best[t].below - goal) <= slack or chosen is None or (one and level == "tie"):
                        done[t] = best[t]
                    elif one:  # a single key: go on by the tie, inside the group
                        at[t] = {"level": "tie", "prefix": 0, "below": chosen[1], "shift": key_bits, "key": chosen[2]}
                    else:
                        at[t] = a | {"prefix": chosen[0], "below": chosen[1], "shift": down}
    return [done[t] for t in sorted(done)]


def shard_of(splitters: Sequence[Splitter], key: Column, tie: Column) -> Column:
    """The number of splitters at or below a row."""
    out = F.lit(0)
    for s in splitters:
        k = F.lit(s.key).cast("long")
        out = out + ((key > k) | ((key == k) & (tie >= F.lit(s.tie).cast("long")))).cast("int")
    return out


def shard_documents(docs: DataFrame, shards: int = 16, tolerance: float = 0.01, rows_per_cell: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) of every row.

    Slots follow the sort order between cells of the key space and inside them; the offsets of the cells come from
    counts, so no shard is sorted in one task. A cell that a hot text fills is cut by the tie, which is a hash of doc_id.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    rows = scratch.table(_keyed(docs), "keyed")  # about 40 bytes a row; each round reads this, not the texts
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    splitters = find_splitters(rows, shards, total or 0, tolerance) if n else []
    placed = rows.withColumn("shard", shard_of(splitters, F.col("key"), F.col("tie")))
    bits = min(40, max(0, math.ceil(math.log2(max(1, n / rows_per_cell)))))
    placed = placed.withColumn("cell", F.shiftright("key", 62 - bits))
    # cells above twice the usual size, which few hot texts fill, are cut by doc_id, and what is above it then by row
    fine = max(bits, 4)
    limit = 2 * rows_per_cell

    def cut(rows: DataFrame, by: list[str], name: str, value: Column) -> DataFrame:
        """``value`` in the groups of more than ``limit`` rows, which are fewer than rows / limit, and 0 elsewhere."""
        hot = rows.groupBy(by).count().filter(F.col("count") > limit).select(*by, F.lit(True).alias("is_hot"))
        return rows.join(hot, by, "left").withColumn(name, F.when(F.col("is_hot"), value).otherwise(F.lit(0).cast("long"))).drop("is_hot")

    placed = cut(placed, ["shard", "cell"], "part", F.shiftright("tie", 2 * TIE_BITS - fine))
    placed = cut(placed, ["shard", "cell", "part"], "piece", F.shiftright(F.col("tie").bitwiseAND(F.lit((1 << TIE_BITS) - 1).cast("long")), TIE_BITS - min(fine, TIE_BITS)))
    grain = ["shard", "cell", "part", "piece"]
    before = Window.partitionBy("shard").orderBy("cell", "part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(grain).agg(F.count("*").alias("n"))
    offsets = scratch.table(counts.select(*grain, F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("offset")), "offsets")
    inside = Window.partitionBy(grain).orderBy("key", "tie", "doc_id")
    out = placed.withColumn("rn", F.row_number().over(inside)).join(offsets, grain)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.col("rn") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, tolerance: float = 0.01, column: str = "shard") -> list[Splitter]:
    """Write whole rows to ``path``/``column``=K after one exchange by shard, and return the splitters used. A column of docs
    that has this name keeps it, and the folder's gets underscores behind."""
    spark = docs.sparkSession
    rows = Scratch(spark, "shard").table(_keyed(docs), "keyed")
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    splitters = find_splitters(rows, shards, total or 0, tolerance) if n else []
    while column in docs.columns:
        column += "_"
    key, tie = _order()
    placed = docs.withColumn(column, shard_of(splitters, key, tie))
    placed.repartition(column, F.pmod(tie, F.lit(64))).write.mode("overwrite").partitionBy(column).parquet(path)
    return splitters
