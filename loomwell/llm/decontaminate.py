"""Benchmark decontamination: SimHash of item-sized windows, looked up through multi-index Hamming blocks, exact verification.

An item is a benchmark text of n words (A-Z lower-cased). A window is n successive words of a document; a document of fewer
than n words is one window as a whole. A document leaks an item if some window's weighted similarity of 5-word shingles to
the item is ``percent``/100 or more: sum over common shingles of the smaller multiplicity times weight, over the sum of the
larger ones. A shingle's weight falls with the number of items that have it (1 + ln(items / items with it)).

1. Fingerprints are 64-bit SimHashes over single words, of items and of windows of the items' own lengths (from running
   sums per bit). Windows that cannot reach the similarity are not fingerprinted: a shingle that no item of the window's
   length has adds to the larger sum only, so the number of the others in a window bounds its similarity. This loses nothing.
2. The fingerprints' 64 bits are cut into BLOCKS blocks, and the items indexed by the value of each block. If two fingerprints
   differ in at most ``radius`` bits, some block differs in at most radius // BLOCKS: all values that near to each block
   of a window are looked up. So all items within the radius are found, and only those are compared further.
3. The exact similarity verifies each window and item that were found.

The radius bounds recall of inexact windows only: an exact copy has distance 0. At 0.8 a window differs from its item in a
word or two of the shortest items and in a tenth of the longer ones, which flips about 8 of 64 bits; 19 is more than three
standard deviations above (tests compare with all windows). Everything runs inside one map over the documents. Items are
sent to the tasks in groups of about ``group_items``; more items mean more passes. Weights are those over all items: with
several groups, shingles are counted once over the whole benchmark, and each group gets the counts of the shingles that
several items have (16 bytes for each; all others have one count).

Edge cases: items without words match nothing; items shorter than 5 words are one shingle and must match as a whole; null
texts leak nothing; repeated items are reported each; of equally similar windows the one of the least distance, then the
first, is reported; repeated rows are kept; empty tables and extra columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm import kernel as K
from loomwell.llm.scratch import filter_documents, small_batches

WIDTH = 5
BLOCKS = 4
BLOCK_BITS = 16
SPAN = 16_384  # words whose running sums are held at a time
LOOKUPS = 256  # fingerprints that are looked up at a time


class BlockTables:
    """Items by the value of each block of their fingerprints."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        values = _blocks(prints)
        self.items = [np.argsort(values[:, b], kind="stable") for b in range(BLOCKS)]
        self.starts = [np.searchsorted(values[self.items[b], b], np.arange((1 << BLOCK_BITS) + 1)) for b in range(BLOCKS)]

    def within(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in prints, item, distance) of all pairs whose distance is at most ``radius``, once each."""
        flips = _flips(radius // BLOCKS)
        out = []
        size = max(1, len(self.prints))
        for a in range(0, len(prints), LOOKUPS):
            some = prints[a : a + LOOKUPS]
            values = _blocks(some)
            pairs = []
            for b in range(BLOCKS):
                keys = values[:, b, None] ^ flips[None, :]
                first = self.starts[b][keys]
                n = self.starts[b][keys + 1] - first
                at, flip = np.nonzero(n)
                n, first = n[at, flip], first[at, flip]
                places = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                at, item = np.repeat(at, n), self.items[b][places]
                near = np.bitwise_count(some[at] ^ self.prints[item]) <= radius
                pairs.append(at[near] * size + item[near])
            code = np.unique(np.concatenate(pairs))
            at, item = code // size, code % size
            out.append((at + a, item, np.bitwise_count(some[at] ^ self.prints[item]).astype(np.int64)))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))


@lru_cache(4)
def _flips(most: int) -> np.ndarray:
    """All values of a block with at most so many bits set."""
    return np.array([sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(BLOCK_BITS), k)], np.int64)


def _blocks(prints: np.ndarray) -> np.ndarray:
    return np.stack([(prints >> np.uint64(BLOCK_BITS * b)) & np.uint64((1 << BLOCK_BITS) - 1) for b in range(BLOCKS)], -1).astype(np.int64)


@dataclass
class Index:
    """Benchmark items of a group; arrays by item number."""

    ids: list[int]
    lengths: np.ndarray  # in words
    shingles: list[tuple[np.ndarray, np.ndarray]]  # sorted distinct shingle hashes and their multiplicities
    tables: BlockTables
    known: np.ndarray  # sorted hashes of all shingles
    weight: np.ndarray  # of these
    owners: tuple[np.ndarray, np.ndarray]  # of these: where their part of the second array ends, the lengths of items with them
    rarest: float  # the weight of shingles that no item has
    common: np.ndarray  # sorted hashes of shingles that several items have, in other groups too; empty for a single group
    common_weight: np.ndarray

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.rarest)
        for table, weight in ((self.common, self.common_weight), (self.known, self.weight)):
            if len(table):
                at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
                out = np.where(table[at] == hashes, weight[at], out)
        return out

    def least_known(self, n: int, percent: int) -> int:
        """How many of a window's n shingles an item must have, if the similarity is to reach the percentage."""
        low, high = min(self.weight.min(initial=self.rarest), self.common_weight.min(initial=self.rarest)), self.rarest
        t = percent / 100
        return max(1, int(np.ceil(n * t * low / (t * low + (1 - t) * high) - 1e-9)))


@dataclass
class Counts:
    """Numbers of items with a shingle over the whole benchmark."""

    n_items: int
    common: np.ndarray  # sorted hashes of the shingles that several items have
    n: np.ndarray  # the numbers of items with these
    least: int  # the least number of items with any shingle

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.ones(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.common, hashes), len(self.common) - 1)
        return np.where(self.common[at] == hashes, self.n[at], 1)


def _weights(frequency: np.ndarray, n_items: int) -> np.ndarray:
    return 1.0 + np.log(n_items / frequency)


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words, for n below WIDTH as whole short texts have them."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = np.full(len(words) - n + 1, n if n < WIDTH else 0, np.uint64) * K.PLACES[63]
    for k in range(n):
        h += words[k : len(words) - n + 1 + k] * K.PLACES[k]
    return K.mix(h)


def _shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the successive shingles; like kernel.shingles, but in order and with repeats."""
    return _runs(words, min(WIDTH, len(words))) if len(words) else words


def window_prints(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHashes of words[s : s + n] for sorted starts: a bit is set if more than half of the words have it."""
    out = np.empty(len(starts), np.uint64)
    # words of windows that overlap are taken once: how many each window adds to those before it
    new = np.minimum(np.diff(starts, prepend=starts[:1]), n)
    total = np.cumsum(new)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(total, total[at] + SPAN)))
        place = total[at:end] - total[at]  # of the windows' first words among the words taken
        used = np.empty(int(place[-1]) + n, np.int64)
        for k in range(0, end - at, max(1, SPAN // n)):
            part = slice(k, k + max(1, SPAN // n))
            used[place[part, None] + np.arange(n)] = starts[at:end][part, None] + np.arange(n)
        bits = np.unpackbits(words[used].view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.zeros((len(used) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
        ones = (sums[place + n] - sums[place]) * 2 > n
        out[at:end] = np.packbits(ones, axis=1).view(np.uint64)[:, 0]
        at = end
    return out


def build_index(ids: list[int], texts: list[str], counts: Counts | None = None) -> Index:
    """counts: of the whole benchmark, if these items are a part of it."""
    column = pa.array(texts, pa.large_string())
    words: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(ids)
    for w in K.each_slice(column):
        cuts = np.cumsum(w.per_doc())[:-1]
        for i, part in enumerate(np.split(w.hash, cuts)):
            words[w.first + i] = part
    full = [i for i, ws in enumerate(words) if len(ws)]  # items without words match nothing
    ids, words = [ids[i] for i in full], [words[i] for i in full]
    sets = [np.unique(_shingles(ws), return_counts=True) for ws in words]
    prints = np.array([window_prints(ws, np.zeros(1, np.int64), len(ws))[0] for ws in words], np.uint64)
    known, frequency = np.unique(np.concatenate([s[0] for s in sets] or [np.zeros(0, np.uint64)]), return_counts=True)
    if counts is None:
        n_items, least, common, shared = max(1, len(texts)), int(frequency.min(initial=len(texts) or 1)), np.zeros(0, np.uint64), np.zeros(0)
    else:
        frequency, n_items, least = counts.of(known), counts.n_items, counts.least
        common, shared = counts.common, _weights(counts.n, n_items)
    rarest = float(_weights(np.array(least), n_items)) if len(known) else 1.0
    lengths = np.array([len(ws) for ws in words], np.int64)
    sizes, size_of = np.unique(lengths, return_inverse=True)
    of = np.concatenate([np.searchsorted(known, s[0]) * len(sizes) + k for s, k in zip(sets, size_of)] or [np.zeros(0, np.int64)])
    of = np.unique(of)
    owners = np.cumsum(np.bincount(of // max(1, len(sizes)), minlength=len(known))), sizes[of % max(1, len(sizes))] if len(of) else of
    return Index(ids, lengths, sets, BlockTables(prints), known, _weights(frequency, n_items), owners, rarest, common, shared)


def _similarity(index: Index, item: int, window: np.ndarray) -> float:
    a, m = index.shingles[item]
    b, n = np.unique(_shingles(window), return_counts=True)
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    wa, wb = index.weights(a), index.weights(b)
    low = float((wa[i] * np.minimum(m[i], n[j])).sum())
    high = float((wa * m).sum() + (wb * n).sum()) - low
    return low / high


def possible_starts(hits: np.ndarray, ends: np.ndarray, n: int, need: int) -> np.ndarray:
    """Sorted starts of the windows of n words that lie in one text and hold at least ``need`` of the known shingles at the
    sorted places ``hits``. ends: past-the-end words of the texts."""
    s = max(1, n - WIDTH + 1)
    if len(hits) < need:
        return np.zeros(0, np.int64)
    last = hits[need - 1 :]  # of need successive hits
    first = hits[: len(last)]
    at = np.flatnonzero(last - first < s)
    # windows whose first hit is this one
    before = np.concatenate(([-1], hits))[at] + 1
    text = np.searchsorted(ends, first[at], "right")
    lo = np.maximum.reduce([before, last[at] - s + 1, np.concatenate(([0], ends))[text]])
    size = np.maximum(0, np.minimum(first[at], ends[text] - n) - lo + 1)
    return np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())


SCHEMA = "doc_id long, item_id long, start_word long, n_words int, distance int, similarity double"


def _search_slice(index: Index, w: K.Words, radius: int, percent: int) -> dict[tuple[int, int], tuple]:
    """Of each (text, item) that leaks: the best (similarity, -distance, -start, n words)."""
    ends = np.cumsum(w.per_doc())
    best: dict[tuple[int, int], tuple] = {}

    windows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # starts, sizes, fingerprints, whether they are whole texts
    owner_ends, owner_lengths = index.owners
    for width in sorted({min(n, WIDTH) for n in index.lengths.tolist()}):
        # places of known shingles inside one text, once for each length of the items that have them
        h = _runs(w.hash, width)
        at = np.minimum(np.searchsorted(index.known, h), len(index.known) - 1)
        hit = np.flatnonzero(index.known[at] == h)
        hit = hit[w.doc[hit] == w.doc[hit + width - 1]]
        if not len(hit):
            continue
        shingle = at[hit]
        n = owner_ends[shingle] - np.concatenate(([0], owner_ends))[shingle]
        place = np.repeat(hit, n)
        length = owner_lengths[np.repeat(owner_ends[shingle] - np.cumsum(n), n) + np.arange(n.sum())]
        order = np.argsort(length, kind="stable")
        place, length = place[order], length[order]
        cuts = np.flatnonzero(K.first_of_run(length))
        for a, b in zip(cuts, np.append(cuts[1:], len(length))):
            size = int(length[a])
            if min(size, WIDTH) == width:
                starts = possible_starts(place[a:b], ends, size, index.least_known(max(1, size - WIDTH + 1), percent))
                windows.append((starts, np.full(len(starts), size), window_prints(w.hash, starts, size), np.zeros(len(starts), bool)))
        if width == WIDTH:  # a text that is shorter than an item is one window as a whole
            per, sizes = np.bincount(w.doc[hit], minlength=w.n_docs), w.per_doc()
            for text in np.flatnonzero((per > 0) & (sizes < index.lengths.max())).tolist():
                if per[text] >= index.least_known(int(sizes[text]) - WIDTH + 1, percent):
                    start = ends[text : text + 1] - sizes[text]
                    windows.append((start, sizes[text : text + 1], window_prints(w.hash, start, int(sizes[text])), np.ones(1, bool)))
    if not windows:
        return best
    starts, sizes, prints, whole = (np.concatenate(x) for x in zip(*windows))
    distinct, of = np.unique(prints, return_inverse=True)
    at, item, distance = index.tables.within(distinct, radius)
    n = np.bincount(at, minlength=len(distinct))[of]  # items of each window; those of a fingerprint are in order
    first = np.searchsorted(at, of)
    window = np.repeat(np.arange(len(starts)), n)
    pair = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    length = index.lengths[item[pair]]
    keep = np.where(whole[window], length > sizes[window], length == sizes[window])
    for k, p in zip(window[keep].tolist(), pair[keep].tolist()):
        start, size, i = int(starts[k]), int(sizes[k]), int(item[p])
        similarity = _similarity(index, i, w.hash[start : start + size])
        if similarity >= percent / 100 - 1e-12:
            text = int(w.doc[start])
            found = (similarity, -int(distance[p]), (int(ends[text - 1]) if text else 0) - start, size)
            if (text, i) not in best or found > best[text, i]:
                best[text, i] = found
    return best


def search_texts(index: Index, texts: pa.Array, radius: int, percent: int) -> list[tuple[int, int, int, int, int, float]]:
    """(text, item, start, n words, distance, similarity) of all leaks of a column of texts."""
    rows = []
    if len(index.ids):
        for w in K.each_slice(texts):
            if len(w.hash):
                found = _search_slice(index, w, radius, percent)
                rows += [(w.first + text, i, -start, n, -distance, s) for (text, i), (s, distance, start, n) in sorted(found.items())]
    return rows


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each text, once each."""
    for batch in batches:
        for w in K.each_slice(batch.column(0)):
            parts = [np.unique(_shingles(x)) for x in np.split(w.hash, np.cumsum(w.per_doc())[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(K.long_of(np.concatenate(parts)))], ["shingle"])


def count_shingles(items: DataFrame, n_items: int) -> Counts:
    """One distributed count over all items(item_id, text)."""
    n = items.select("text").mapInArrow(_item_shingles, "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    least = n.agg(F.min("n")).first()[0] or 1
    got = n.filter("n > 1").toArrow()
    common = got["shingle"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(common)
    return Counts(n_items, common[order], got["n"].to_numpy()[order], least)


def indexes(benchmark: DataFrame, group_items: int) -> Iterator[Index]:
    """Search structures over groups of items, each small enough to send to every task."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    n_items = items.count()
    groups = max(1, -(-n_items // group_items))
    counts = count_shingles(items, n_items) if groups > 1 else None
    for g in range(groups):
        part = items if groups == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g)
        rows = part.orderBy("item_id", "text").collect()  # about group_items rows
        yield build_index([r["item_id"] for r in rows], [r["text"] for r in rows], counts)


def find_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, radius: int = 19, group_items: int = 20_000) -> DataFrame:
    """One row per document and item that it leaks: the best window. docs(doc_id, text), benchmark(item_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    out = None
    for index in indexes(benchmark, group_items):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = search_texts(shared.value, batch.column(1), radius, percent)
                columns = [list(c) for c in zip(*found)] if found else [[]] * 6
                ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
                columns[1:2] = [[shared.value.ids[i] for i in columns[1]]]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns[1:], types[1:]))], names)

        found = docs.mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, radius: int = 19, group_items: int = 20_000) -> DataFrame:
    """The rows of docs, with all columns, that leak no item; no shuffle."""
    for index in indexes(benchmark, group_items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(texts: pa.Array, shared=shared) -> np.ndarray:
            keep = np.ones(len(texts), bool)
            keep[[x[0] for x in search_texts(shared.value, texts, radius, percent)]] = False
            return keep

        docs = filter_documents(docs, clean)
    return docs
