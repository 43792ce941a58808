"""Target-distribution importance resampling with a vectorised byte automaton.

Features are runs of consecutive words, hashed into buckets by their crc32. Two passes read the texts: the first counts the
buckets of the documents and of the target texts, which gives each bucket a gain (its log ratio); the second takes each
document's mean gain, adds Gumbel noise that its id fixes, and so draws without replacement in proportion to the ratio.

Both passes run over Arrow buffers: a lookup table classifies every byte of a slice, words begin and end where the class
differs from the byte before, and one table-driven CRC step advances all words of the slice together, the longest first, so
that those still running are a prefix of the arrays. What is left of words longer than ``LOCKSTEP`` bytes goes through
zlib's crc32, from the state reached. A run's CRC goes on from its first words' state over a space and the next word.

Edge cases: a null text has no words; weight 0 without features. A null doc_id has no noise, so its score is null, and the
row is neither counted among those to draw from nor drawn. Repeated rows are scored and ranked one by one; ties go to the
smaller doc_id, then to fewer features. Empty tables give no rows, or gains of an empty target. Very long texts are taken
whole, a slice of their own. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm import kernel as K
from loomwell.llm.scratch import Scratch, small_batches

#: Word bytes are digits, letters and all bytes of code points beyond ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x41:0x5B] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
POLYNOMIAL = 0xEDB88320
START_STATE = np.uint32(0xFFFFFFFF)
#: Bytes of a word that are advanced together with other words.
LOCKSTEP = 64


def crc_table() -> np.ndarray:
    """The state change of each byte value."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), table >> np.uint32(1)).astype(np.uint32)
    return table


TABLE = crc_table()


def word_bounds(lower: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end bytes of the words; ``starts`` holds the first bytes of the texts, where words end too."""
    inside = np.zeros(len(lower) + 2, np.int8)
    inside[1:-1] = IS_WORD[lower]
    step = np.diff(inside)
    begins, ends = step[:-1] == 1, step[1:] == -1
    joined = starts[(inside[starts] & inside[starts + 1]).astype(bool)]  # texts that begin with a word byte just behind one
    begins[joined] = True
    ends[joined - 1] = True
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def advance(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC states after the bytes from start to end, all starts at a time."""
    length = end - start
    few = -np.minimum(length, LOCKSTEP).astype(np.int8)  # small numbers, which numpy sorts by radix
    order = np.argsort(few, kind="stable")
    at, left = start[order], few[order].astype(np.int64)
    run = state[order]
    for k in range(int(-left[0]) if len(left) else 0):
        m = int(np.searchsorted(left, -k, "left"))  # words with a k-th byte
        run[:m] = TABLE[(run[:m] ^ data[at[:m] + k]) & np.uint32(255)] ^ (run[:m] >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = run
    for i in np.flatnonzero(length > LOCKSTEP):
        out[i] = zlib.crc32(data[start[i] + LOCKSTEP : end[i]].tobytes(), int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


def features(column: pa.Array, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice of the texts: the first text's place, words a text, and each feature's text and crc32."""
    data, offsets = K.text_buffers(column)
    for i, j in K.slices(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        lower = K.LOWER[data[lo:hi]]
        first = offsets[i : j + 1] - lo
        begin, end = word_bounds(lower, first[:-1][first[:-1] < hi - lo])
        text = np.searchsorted(first, begin, "right") - 1
        state = advance(np.full(len(begin), START_STATE), lower, begin, end)
        crcs, texts, first_word = [~state], [text], np.arange(len(begin))
        for r in range(1, longest):
            more = np.flatnonzero(first_word < len(begin) - r)
            more = more[text[first_word[more] + r] == text[first_word[more]]]  # the next word is of the same text
            first_word, state = first_word[more], state[more]
            state = TABLE[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
            state = advance(state, lower, begin[first_word + r], end[first_word + r])
            crcs.append(~state)
            texts.append(text[first_word])
        yield i, np.bincount(text, minlength=j - i), np.concatenate(texts), np.concatenate(crcs)


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> dict[int, int]:
    """Features of all texts by bucket: at most ``buckets`` rows from a task, and to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, crc in features(batch.column(0), longest):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = texts.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long")
    return {r.bucket: r.n for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket, with one added to each count."""
    all_source, all_target = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * all_source / ((source.get(b, 0) + 1) * all_target))) for b in range(buckets)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """doc_id, n_words, n_features and weight (the floored mean gain) of every row."""
    buckets = np.uint32(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, per_text, text, crc in features(batch.column(1), longest):
                of = slice(i, i + len(per_text))
                words[of] = per_text
                n[of] = np.bincount(text, minlength=len(per_text))
                total[of] = np.bincount(text, gain[crc % buckets], len(per_text))  # exact: far below 2**53
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, n, total // np.maximum(n, 1)))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, min_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; rank is null unless drawn.

    The least drawn score comes from counts by score, of which there are as many as values (gains and noise lie within some
    ten thousands of zero). Only rows at or above it are sorted, by ranges, and numbered by their place in their range.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "importance")
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = scratch.table(weigh(docs, gain, longest).withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    able = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    counts = sorted(((r.score, r.n) for r in scored.filter(able).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    left = draw = sum(n for _, n in counts) * percent // 100
    least = None
    for least, n in counts if draw else ():
        left -= n
        if left <= 0:
            break
    columns = ["doc_id", "n_features", "weight", "score"]
    if least is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    chosen = able & (F.col("score") >= least)
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("tie")]  # rows alike in all but tie are interchangeable
    rows = scored.withColumn("tie", F.xxhash64(F.monotonically_increasing_id())).filter(chosen)
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # the partition's number above 33 bits of the place in it
    placed = scratch.table(rows.select(*columns, F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "placed")
    before, offsets = 0, []
    for part, n in sorted(placed.groupBy("part").count().collect()):  # a row a partition
        offsets.append((part, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(offsets, "part long, before long"))
    rank = F.col("before") + F.col("at") + 1
    drawn = placed.join(starts, "part").select(*columns, F.when(rank <= draw, rank).alias("rank"))
    return drawn.unionByName(scored.filter(~F.coalesce(chosen, F.lit(False))).select(*columns, F.lit(None).cast("long").alias("rank")))
