"""Spelling variants by wildcard groups, without materialising pairs of words.

Words that differ by one replaced code point share one key (position, prefix, suffix): the word with that place left open. A
group keeps its size and its two best words; each member's near words there are the others, and its best is the first that
is not itself. Words that differ by one code point more or less meet where the longer one's deletion is in the vocabulary:
the shorter one gets its group's size and best word, each longer one the shorter. The parts are then summed per word.

Sizes: a word gives a key a position. A group of either kind differs in one code point of the alphabet (and, for
deletions, in where it stands), so it has at most ``ALPHABET`` members, or that many a position, however many rows there are.
Occurrences are counted per task before the shuffle, in a buffer of bounded size.

Edge cases: a null or empty text has no words. With a null doc_id no run is altered. Very long texts are taken whole, one at a
time; repeated rows count again. Ties go to the smaller word by code points. Empty tables give no rows; a word without
near words has n_near 0, no form and itself as root. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.llm.scratch import Scratch, small_batches

RUN = re.compile("[a-zÀ-ÿ]+")
#: Code points that a lower-cased run can hold.
ALPHABET = 26 + 64
#: Distinct words that a task counts before it sends them on.
BUFFER_WORDS = 200_000
#: Stands for the open place; no word holds it.
OPEN = "*"


def words_of(doc_id: int | None, text: str | None, min_length: int, every: int) -> Counter:
    """Occurrences of a text's runs of at least ``min_length`` code points, after the alteration that doc_id and run fix."""
    found = Counter(RUN.findall((text or "").encode().lower().decode()))
    out: Counter = Counter()
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in found.items():
        if len(run) < min_length:
            continue
        h = zlib.crc32(run.encode(), start) if doc_id is not None else 1
        if every and h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < min_length:
                continue
        out[run] += n
    return out


def vocabulary(docs: DataFrame, min_length: int = 7, min_count: int = 2, every: int = 31) -> DataFrame:
    """word, n of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                held.update(words_of(doc_id.as_py(), text.as_py(), min_length, every))
                if len(held) >= BUFFER_WORDS:
                    yield _rows(held)
                    held.clear()
        yield _rows(held)

    small_batches(docs.sparkSession)
    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _rows(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])


def _rank(n: str = "n", word: str = "word") -> Column:
    """Least for the largest n, then for the smallest word."""
    return F.struct((-F.col(n)).alias("minus"), F.col(word).alias("word"))


def _without(i: Column, between: str) -> Column:
    """The word with its code point i (from 1) replaced."""
    return F.concat(F.substring("word", F.lit(1), i - 1), F.lit(between), F.substring("word", i + 1, F.length("word")))


def _each_place(between: str) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: _without(i, between))


def replacements(vocab: DataFrame) -> DataFrame:
    """word, n_near and best by replaced code points. Each group's members are at most ALPHABET; each gets one row."""
    keyed = vocab.select(F.explode(_each_place(OPEN)).alias("key"), _rank().alias("m"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("m")).alias("members")).filter("size > 1")
    top = groups.select("size", F.col("members")[0].alias("first"), F.col("members")[1].alias("second"), F.explode("members").alias("m"))
    best = F.when(F.col("m") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    return top.select(F.col("m.word").alias("word"), (F.col("size") - 1).alias("n_near"), best.alias("best"))


def indels(vocab: DataFrame, scratch: Scratch) -> DataFrame:
    """word, n_near and best by one code point more or less."""
    shorter = F.array_distinct(_each_place(""))
    keyed = vocab.select(F.explode(shorter).alias("key"), _rank().alias("m"))
    known = vocab.select(F.col("word").alias("key"), F.col("n").alias("key_n"))
    met = scratch.table(keyed.join(known, "key"), "deletions")  # at most a word's length of rows a word
    longer = met.groupBy(F.col("key").alias("word")).agg(F.count("*").alias("n_near"), F.min("m").alias("best"))
    own = met.select(F.col("m.word").alias("word"), F.lit(1).cast("long").alias("n_near"), F.struct((-F.col("key_n")).alias("minus"), F.col("key").alias("word")).alias("best"))
    return longer.unionByName(own)


def follow(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root: the last of a chain of forms. Each round doubles the steps taken; n grows along a chain, so it ends."""
    now, k = scratch.table(forms.select("word", F.col("form").alias("root")), "roots0"), 0
    while True:
        step = now.alias("a").join(now.alias("b"), F.col("a.root") == F.col("b.word"), "left")
        after = scratch.table(step.select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")), f"roots{k + 1}")
        moved = after.filter("moved").limit(1).count()
        now, k = after.select("word", "root"), k + 1
        if not moved:
            return now


def group_variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, factor: int = 10, every: int = 31) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    scratch = Scratch(docs.sparkSession, "spelling")
    vocab = scratch.table(vocabulary(docs, min_length, min_count, every), "vocabulary")
    none = vocab.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<minus:bigint,word:string>").alias("best"))
    near = replacements(vocab).unionByName(indels(vocab, scratch)).withColumn("n", F.lit(None).cast("long"))
    summed = none.unionByName(near).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    takes = -F.col("best.minus") >= factor * F.col("n")
    words = scratch.table(summed.select("word", F.when(takes, F.col("best.word")).alias("form"), "n", "n_near", F.when(takes, -F.col("best.minus")).alias("form_n")), "words")
    roots = follow(words.filter("form is not null"), scratch)
    return words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
