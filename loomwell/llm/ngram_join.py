"""N-gram Jaccard self-join of documents by vertical partitioning.

A document is its set of distinct 5-word shingles. Two link when 100 * |A and B| >= percent * |A or B|.

1. One pass over the texts gives each row's set size and set hash ("class": equal sets are one class), a parity bitmap of the
   set, and a sketch of shingle frequencies, whose size follows that of the corpus. The sketch orders all shingles globally,
   rare ones first; any order is valid, so its collisions cost time, never results.
2. The order is cut into fragments. A second pass emits each class's prefix (if J >= t, two sets share a shingle among
   their first n - ceil(t n) + 1), packed by fragment. A fragment's task keeps shingles that two classes share. Shingles
   that repeat inside one buffer of a task are known to be shared and travel on their own, spread evenly, so a hot shingle
   never gathers in its fragment.
3. Candidate pairs pass the length and position filters, which are exact. First every member of a shingle's bucket is
   compared with the bucket's most typical member only; links found so merge classes. So a dense group of near copies costs
   its size, not its square. Buckets that still hold several components are compared in full: of buckets with the same
   members only the first is, a large one is cut into blocks that meet in different tasks, and the bitmaps bound each pair's
   overlap (|A and B| <= (|A| + |B| - differing bits) / 2), so that only pairs that can link leave the task. No link between
   components is lost.
4. Overlaps are counted by vertical partition: whole sets are cut at pivots of the global order into fragments of about
   equal weight, each fragment of a pair counts its part of the overlap, and the parts are summed per pair.

Shingles have 56 bits, set hashes 63; a second hash of 64 bits tells sets apart that share the first, and renames them.
Component ids are minimum labels, propagated over the links to a fixpoint.

Edge cases: null or wordless texts have n_shingles 0 and link with nothing; a text of fewer than 5 words is one shingle;
repeated rows are kept (same class); a null doc_id takes part, but never names a component if a doc_id does; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwell.llm import kernel as K
from loomwell.llm.scratch import Scratch, arrow_rows, free_shuffles, small_batches

SLOT_BITS = 18, 25  # least and most of the frequency sketch: 2**25 slots are 128 MB of counts, 32 MB of classes to broadcast
SLOT_TOKENS = 32  # a slot for so many shingles of the corpus
CLASS_BITS = 63
CHUNKS = 64
FLUSH_TOKENS = 600_000
FRAGMENT_TOKENS = 1_000_000
VERIFY_FRAGMENTS = 4
BROADCAST_PAIRS = 1_000_000  # 16 MB; more pairs are joined by shuffle
MAX_POS = 65_535
BLOCK_MEMBERS = 4096  # of a bucket that meet in one task


@dataclass
class Order:
    """The global order of shingles, and the sets that are renamed."""

    rank: np.ndarray  # frequency class of each slot
    renamed: dict[tuple[int, int], int]  # by both hashes

    @property
    def bits(self) -> int:
        return len(self.rank).bit_length() - 1


def _slots(key: np.ndarray, bits: int) -> np.ndarray:
    return (key & np.uint64((1 << bits) - 1)).astype(np.int32)


def _sets(w: K.Words, order: Order | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key) of the distinct shingles of a slice, sorted by text and key, and the texts' set sizes. The key is the
    56-bit hash, below the frequency class if ``order`` is given."""
    doc, h = K.shingles(w)
    key = h >> np.uint64(8)
    if order is not None:
        key |= order.rank[_slots(key, order.bits)].astype(np.uint64) << np.uint64(56)
    by = K.sorted_by_doc(doc, key)
    doc, key = doc[by], key[by]
    new = K.first_of_run(doc, key)
    doc, key = doc[new], key[new]
    return doc, key, np.bincount(doc, minlength=w.n_docs)


def _class_of(key: np.ndarray, n: np.ndarray, order: Order | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's set: sums over the set, so the order of the keys does not matter."""
    ends = np.cumsum(n)
    out = []
    for salt in (0, 0x6A09E667F3BCC909):
        h = K.mix((key & np.uint64((1 << 56) - 1)) ^ np.uint64(salt))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)))
        out.append(K.mix(sums[ends] - sums[ends - n] + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    cls, second = (out[0] >> np.uint64(64 - CLASS_BITS)).astype(np.int64), K.long_of(out[1])
    if order is not None and order.renamed:
        for i in np.flatnonzero(np.isin(cls, [c for c, _ in order.renamed])).tolist():
            cls[i] = order.renamed.get((int(cls[i]), int(second[i])), int(cls[i]))
    return cls, second


def _bitmaps(doc: np.ndarray, key: np.ndarray, n: np.ndarray) -> pa.Array:
    """Parity bitmaps of the texts' sets, of 64 to 4,096 bits: about half as many as the set has shingles."""
    bits = 64 << np.clip(np.ceil(np.log2(np.maximum(n, 1) / 128)), 0, 6).astype(np.int64)
    ends = np.cumsum(bits)
    place = K.mix(key & np.uint64((1 << 56) - 1)) & (bits[doc] - 1).astype(np.uint64)
    odd = np.bincount((ends - bits)[doc] + place.astype(np.int64), minlength=int(ends[-1])) & 1
    data = np.packbits(odd.astype(np.uint8), bitorder="little")
    offsets = np.concatenate(([0], ends // 8)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts of a chunk of slots as bytes, with the slots and counts of 255 and more at the end."""
    at = np.flatnonzero(counts >= 255)
    raw = np.minimum(counts, 255).astype(np.uint8).tobytes() + at.astype(np.uint32).tobytes() + counts[at].astype(np.uint32).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _add_counts(total: np.ndarray, packed: bytes) -> None:
    packed = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    part = np.frombuffer(packed, np.uint8, len(total)).astype(np.int64)
    at, n = np.split(np.frombuffer(packed, np.uint32, offset=len(total)), 2)
    part[at] = n
    total += part


PROFILE = "doc_id long, n int, cls long, second long, bitmap binary, chunk int, counts binary"


def _profile(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        held: list[np.ndarray] = []
        names = [c.split()[0] for c in PROFILE.split(", ")]

        def count() -> None:
            if held:
                slot, n = np.unique(np.concatenate(held), return_counts=True)
                counts[slot] = np.minimum(counts[slot].astype(np.int64) + n, 2**32 - 1)
                held.clear()

        for batch in batches:
            ids = batch.column(0)
            for w in K.each_slice(batch.column(1)):
                doc, key, n = _sets(w)
                held.append(_slots(key, bits))
                if sum(map(len, held)) > 500_000:
                    count()
                cls, second = _class_of(key, n)
                m = w.n_docs
                columns = [ids.slice(w.first, m), pa.array(n.astype(np.int32)), pa.array(cls), pa.array(second), _bitmaps(doc, key, n), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)
        count()
        parts = counts.reshape(CHUNKS, -1)
        for k in range(CHUNKS):
            if parts[k].any():
                columns = [pa.nulls(1, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([k], pa.int32()), pa.array([_pack_counts(parts[k])], pa.binary())], names)

    return run


def _sum_chunks(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                total = sums.setdefault(k, np.zeros((1 << bits) // CHUNKS, np.int64))
                _add_counts(total, counts.as_py())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([_pack_counts(np.minimum(x, 2**32 - 1)) for x in sums.values()], pa.binary())], ["chunk", "counts"]
        )

    return run


def _prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def _pack(frag: int, first: int, key: np.ndarray, row: np.ndarray, pos: np.ndarray, table: np.ndarray) -> tuple[int, bytes]:
    """``first``: 1 if the shingles are known to be shared. table: (class, n, weight) of the rows that occur."""
    used, local = np.unique(row, return_inverse=True)
    head = np.array([first, len(key), len(used)], np.int64)
    return frag, b"".join(x.tobytes() for x in (head, key, local.astype(np.uint32), np.minimum(pos, MAX_POS).astype(np.uint16), table[used]))


TABLE = np.dtype([("cls", np.int64), ("n", np.int32), ("w", np.int32)])


def _unpack(payload: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    first, m, rows = np.frombuffer(payload, np.int64, 3)
    at = 24
    key = np.frombuffer(payload, np.uint64, m, at)
    local = np.frombuffer(payload, np.uint32, m, at := at + 8 * m)
    pos = np.frombuffer(payload, np.uint16, m, at := at + 4 * m)
    table = np.frombuffer(payload, TABLE, rows, at + 2 * m)
    return int(first), key, pos, table[local]


def _emit_prefixes(shared, pivots: np.ndarray, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_of = shared.value
        held: list[tuple] = []
        size, flushes = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, flushes
            base = np.cumsum([0] + [len(h[3]) for h in held])
            table = np.concatenate([h[3] for h in held])
            row = np.concatenate([h[0] + b for h, b in zip(held, base)])
            key = np.concatenate([h[1] for h in held])
            pos = np.concatenate([h[2] for h in held])
            # one row a class: copies inside this buffer add nothing
            lead = np.zeros(len(table), bool)
            lead[np.unique(table["cls"], return_index=True)[1]] = True
            keep = lead[row]
            row, key, pos = row[keep], key[keep], pos[keep]
            order = np.argsort(key, kind="stable")
            row, key, pos = row[order], key[order], pos[order]
            new = K.first_of_run(key)
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1
            out = []
            if many.any():  # shared for certain; dealt out by row, so that hot shingles spread
                k, r, p = key[many], row[many], pos[many]
                out.append(_pack(len(pivots) + 1 + flushes, 1, k, r, p, table))
            once = new  # one of each goes to its fragment: there it meets the other buffers'
            flag = many[once]
            frag = np.searchsorted(pivots, key[once], "right")
            for f in np.unique(frag):
                at = frag == f
                for first, mask in ((0, at & ~flag), (2, at & flag)):  # 2: sent on already, but counts as a partner
                    if mask.any():
                        out.append(_pack(int(f), first, key[once][mask], row[once][mask], pos[once][mask], table))
            held, size, flushes = [], 0, flushes + 1
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["frag", "payload"])

        for batch in batches:
            for w in K.each_slice(batch.column(0)):
                doc, key, n = _sets(w, order_of)
                if not len(doc):
                    continue
                table = np.empty(w.n_docs, TABLE)
                table["cls"], table["n"] = _class_of(key, n, order_of)[0], n
                table["w"] = np.bincount(doc, weights=(key >> np.uint64(56)).astype(float), minlength=w.n_docs) * 100 / np.maximum(n, 1)
                pos = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
                keep = pos < _prefix_length(n, percent)[doc]
                held.append((doc[keep], key[keep], pos[keep], table))
                size += int(keep.sum())
                if size >= FLUSH_TOKENS:
                    yield flush()
                    K.trim()
        if held:
            yield flush()
        K.trim()

    return run


def _shared_only(fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple] = []
        names = ["key", "cls", "n", "pos", "w"]

        def rows(key, pos, t):
            return pa.RecordBatch.from_arrays([pa.array(K.long_of(key)), pa.array(t["cls"]), pa.array(t["n"]), pa.array(pos.astype(np.int32)), pa.array(t["w"])], names)

        for batch in batches:
            for payload in batch.column(1):
                first, key, pos, t = _unpack(payload.as_buffer())
                if first == 1:
                    yield rows(key, pos, t)
                else:
                    got.append((np.full(len(key), first == 2), key, pos, t))
        if got:
            sent, key, pos, t = (np.concatenate(x) for x in zip(*got))
            order = np.argsort(key, kind="stable")
            sent, key, pos, t = sent[order], key[order], pos[order], t[order]
            group = np.cumsum(K.first_of_run(key)) - 1
            lo, hi = np.full(group[-1] + 1, np.iinfo(np.int64).max), np.full(group[-1] + 1, -1)
            np.minimum.at(lo, group, t["cls"])
            np.maximum.at(hi, group, t["cls"])
            keep = ((lo != hi)[group]) & ~sent
            yield rows(key[keep], pos[keep], t[keep])
            del sent, key, pos, t, order, group, got
        K.trim()

    return run


def _segments(shared, shared_bloom, pivots: np.ndarray, by_class: bool = False):
    """Segments of the rows whose doc_id is in the filter; with ``by_class``, of each class in it, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, order = shared_bloom.value, shared.value
        seen: set[int] = set()
        for batch in batches:
            text = batch.column(1)
            if not by_class:
                ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                keep = np.flatnonzero(bloom_has(bits, ids))
                if not len(keep):
                    continue
                text = text.take(pa.array(keep))
            for w in K.each_slice(text):
                doc, key, n = _sets(w, order)
                cls, _ = _class_of(key, n, order)
                ends = np.cumsum(n)
                some = np.flatnonzero(n)
                if by_class:
                    some = some[bloom_has(bits, cls[some])]
                    some = some[np.sort(np.unique(cls[some], return_index=True)[1])]
                    some = [i for i in some if int(cls[i]) not in seen]
                    seen.update(int(cls[i]) for i in some)
                out_c, out_f, out_s = [], [], []
                for i in some:
                    s = key[ends[i] - n[i] : ends[i]]
                    cut = np.searchsorted(s, pivots)
                    for f, part in enumerate(np.split(s, cut)):
                        out_c.append(int(cls[i]))
                        out_f.append(f)
                        out_s.append(part.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_c, pa.int64()), pa.array(out_f, pa.int32()), pa.array(out_s, pa.binary())], ["cls", "f", "seg"]
                )

    return run


BLOOM_BITS = 20, 27  # least and most: 16 MB at most


def _bloom_place(ids: np.ndarray, size: int) -> np.ndarray:
    return (K.mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(8 * size - 1)).astype(np.int64)


def bloom_has(bloom: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _bloom_place(ids, len(bloom))
    return (bloom[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _bloom_parts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = np.zeros(size, np.uint8)
        for batch in batches:
            at = _bloom_place(batch.column(0).to_numpy(zero_copy_only=False), size)
            np.bitwise_or.at(bloom, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        if bloom.any():
            yield pa.RecordBatch.from_arrays([pa.array([bloom.tobytes()], pa.binary())], ["bits"])

    return run


def _or_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = None
    for batch in batches:
        for x in batch.column(0):
            part = np.frombuffer(x.as_buffer(), np.uint8)
            out = part.copy() if out is None else out | part
    if out is not None:
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["bits"])


def id_filter(ids: DataFrame) -> np.ndarray:
    """A membership filter over a column of ids, 16 bits for each (of 16 MB at most): true for all of them, and for some others."""
    least, most = BLOOM_BITS
    size = 1 << (int(np.clip(np.ceil(np.log2(16 * max(1, ids.count()))), least, most)) - 3)
    parts = ids.mapInArrow(_bloom_parts(size), "bits binary").repartition(8).mapInArrow(_or_parts, "bits binary").collect()
    out = np.zeros(size, np.uint8)
    for (x,) in parts:  # 8 rows of 16 MB at most
        out |= np.frombuffer(x, np.uint8)
    return out


def _fold(bitmaps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) as they would be with fewer words."""
    while bitmaps.shape[1] > words:
        half = bitmaps.shape[1] // 2
        bitmaps = bitmaps[:, :half] ^ bitmaps[:, half:]
    return bitmaps


def bucket_pairs(percent: int, n: np.ndarray, pos: np.ndarray, label: np.ndarray, bitmaps: list[bytes], left: np.ndarray, right: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of members i of ``left`` and j of ``right`` (or i before j, both of left) that can link and differ in label."""
    same = right is None
    words = np.array([len(b) // 8 for b in bitmaps])
    sides = [{int(k): side[words[side] == k] for k in np.unique(words[side])} for side in (left, left if same else right)]
    rows = {k: np.frombuffer(b"".join(bitmaps[i] for i in at), np.uint64).reshape(len(at), k) for side in sides for k, at in [*side.items()] for at in [np.flatnonzero(words == k)]}
    where = np.zeros(len(words), np.int64)
    for k in rows:
        where[words == k] = np.arange(int((words == k).sum()))
    for k, mine in sides[0].items():
        for m, others in sides[1].items():
            few = min(k, m)
            y = _fold(rows[m][where[others]], few)
            step = max(1, 2_000_000 // max(1, len(others) * few))
            for a in range(0, len(mine), step):
                i = mine[a : a + step]
                x = _fold(rows[k][where[i]], few)
                total = n[i][:, None] + n[others][None, :]
                small, large = np.minimum(n[i][:, None], n[others][None, :]), np.maximum(n[i][:, None], n[others][None, :])
                rest = np.minimum((n[i] - pos[i])[:, None], (n[others] - pos[others])[None, :])
                ok = (label[i][:, None] != label[others][None, :]) & (100 * small >= percent * large) & ((100 + percent) * rest >= percent * total)
                if same:
                    ok &= i[:, None] < others[None, :]
                p, q = np.nonzero(ok)
                apart = np.bitwise_count(x[p] ^ y[q]).sum(1).astype(np.int64)
                can = (100 + percent) * (total[p, q] - apart) >= 2 * percent * total[p, q]
                yield i[p[can]], others[q[can]]


def _block_pairs(percent: int):
    """Candidate pairs of rows (key, lo, hi, block, cls, n, pos, label, bitmap), sorted by the first three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple | None = None

        def compare() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            held.clear()
            if t.num_rows < 2:
                return
            lo, hi, block, cls, n, pos, label = (t.column(k).to_numpy().astype(np.int64) for k in range(1, 8))
            left = np.flatnonzero(block == lo)
            right = None if lo[0] == hi[0] else np.flatnonzero(block == hi)
            for i, j in bucket_pairs(percent, n, pos, label, t.column(8).to_pylist(), left, right):
                if len(i):
                    swap = cls[i] > cls[j]
                    a, b = np.where(swap, j, i), np.where(swap, i, j)
                    yield pa.RecordBatch.from_arrays([pa.array(cls[a]), pa.array(cls[b]), pa.array(n[a].astype(np.int32)), pa.array(n[b].astype(np.int32))], ["a", "b", "na", "nb"])

        for batch in batches:
            ids = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            cuts = np.flatnonzero(K.first_of_run(*ids)).tolist()
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                this = tuple(int(x[a]) for x in ids)
                if this != last and held:
                    yield from compare()
                last = this
                held.append(batch.slice(a, b - a))
        if held:
            yield from compare()
        K.trim()

    return run


def _open_buckets(named: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of members of a bucket of named(key, cls, n, pos, label) that differ in label and can link."""
    # one of the buckets with the same members: the first in the global order, where positions bound pairs best
    place = F.col("key").bitwiseXOR(F.lit(-(2**63)).cast("long"))  # the order of unsigned numbers
    buckets = named.groupBy("key").agg(
        F.count("*").alias("g"), F.bit_xor(F.xxhash64("cls")).alias("s"), F.bit_xor(F.xxhash64("cls", F.lit("again"))).alias("t"), F.min("label").alias("low"), F.max("label").alias("high")
    ).filter("low <> high")
    first = buckets.groupBy("g", "s", "t").agg(F.min(place).alias("place"))
    blocks = F.ceil(F.col("g") / BLOCK_MEMBERS).cast("int")
    first = first.select(F.col("place").bitwiseXOR(F.lit(-(2**63)).cast("long")).alias("key"), blocks.alias("blocks"))
    rows = named.join(first, "key").join(bitmaps, "cls").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "cls", "n", "pos", "label", "bitmap")
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_block_pairs(percent), "a long, b long, na int, nb int").distinct()


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, f, s, t = (batch.column(k) for k in range(5))
        out = np.empty(batch.num_rows, np.int64)
        for i in range(batch.num_rows):
            x, y = np.frombuffer(s[i].as_buffer(), np.uint64), np.frombuffer(t[i].as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            out[i] = int((y[at] == x).sum()) if len(y) else 0
        yield pa.RecordBatch.from_arrays([a, b, f, pa.array(out)], ["a", "b", "f", "part"])


def _verify(pairs: DataFrame, segs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that link: fragments count partial overlaps, which are summed per pair."""
    few = pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS  # then they, not the sets, are sent to all tasks
    sent = F.broadcast if few else lambda df: df
    left = segs.select(F.col("cls").alias("a"), "f", F.col("seg").alias("s")).join(sent(pairs.select("a", "b")), "a")
    right = segs.select(F.col("cls").alias("b"), "f", F.col("seg").alias("t")).join(sent(pairs.select("b").distinct()), "b", "left_semi")
    both = left.join(right, ["b", "f"])
    parts = both.select("a", "b", "f", "s", "t").mapInArrow(_overlaps, "a long, b long, f int, part long")
    # a class's segments can be there several times (from copies of a document): each fragment counts once
    sums = parts.groupBy("a", "b", "f").agg(F.max("part").alias("part")).groupBy("a", "b").agg(F.sum("part").alias("both"))
    return sums.join(pairs, ["a", "b"]).filter((100 + percent) * F.col("both") >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def _possible(percent: int):
    """Length and position filters on members x, y of a shingle's bucket."""
    na, nb = F.col("x.n"), F.col("y.n")
    most = F.least(na - F.col("x.pos"), nb - F.col("y.pos"))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * most >= percent * (na + nb))


def _ordered(df: DataFrame) -> DataFrame:
    swap = F.col("x.cls") > F.col("y.cls")
    pick = lambda c, first: F.when(swap == F.lit(not first), F.col(f"x.{c}")).otherwise(F.col(f"y.{c}"))
    return df.select(pick("cls", True).alias("a"), pick("cls", False).alias("b"), pick("n", True).alias("na"), pick("n", False).alias("nb")).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label): each node of edges(a, b) with the least node of its component, by minimum labels and jumps."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    both = scratch.table(both.distinct(), f"{name}-edges")
    labels = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")), f"{name}-0")
    k = 0
    while True:
        k += 1
        near = both.join(labels.select(F.col("u").alias("v"), F.col("label").alias("other")), "v").groupBy("u").agg(F.min("other").alias("other"))
        step = labels.join(near, "u").select("u", F.least("label", "other").alias("next"), "label")
        jump = labels.select(F.col("u").alias("next"), F.col("label").alias("far"))  # the label's own label
        step = step.join(jump, "next").select("u", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("moved"))
        step = scratch.table(step, f"{name}-{k}")
        moved = step.filter("moved").limit(1).count()
        labels = step.select("u", "label")
        scratch.drop(f"{name}-{k - 1}")
        if not moved:
            return labels.withColumnRenamed("u", "node")


def _renamed(rows: DataFrame) -> dict[tuple[int, int], int]:
    """New names of sets that differ though their first hashes are equal: all but one of each. At 63 bits there are none
    below some 10**9 documents, and n**2 / 2**64 of n documents."""
    odd = rows.filter("n > 0").groupBy("cls").agg(F.min("second").alias("low"), F.max("second").alias("high")).filter("low <> high")
    pairs = rows.join(odd, "cls").filter("second <> low").select("cls", "second").distinct().collect()
    return {(c, s): int(K.mix(np.array([s]).view(np.uint64) + np.uint64(c))[0] >> np.uint64(1)) for c, s in pairs}


def _linked_classes(docs: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, dict[tuple[int, int], int]]:
    """rows(doc_id, n, cls) of all docs(doc_id, text); classes(cls, label, component_id) of the sets, where label names the
    component; and the sets that are renamed."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(1, size / 6 / SLOT_TOKENS))), *SLOT_BITS))
    first = scratch.table(docs.mapInArrow(_profile(bits), PROFILE), "profile")
    rows = first.filter("chunk is null").select("doc_id", "n", "cls", "second")
    renamed = _renamed(rows)
    if renamed:
        new = spark.createDataFrame([(*k, v) for k, v in renamed.items()], "cls long, second long, new long")
        rename = lambda df: df.join(F.broadcast(new), ["cls", "second"], "left").withColumn("cls", F.coalesce("new", "cls")).drop("new")
    else:
        rename = lambda df: df
    rows = rename(rows).select("doc_id", "n", "cls")
    bitmaps = rename(first.filter("chunk is null and n > 0").select("cls", "second", "bitmap")).groupBy("cls").agg(F.max("bitmap").alias("bitmap"))  # all the same
    sketch = first.filter("chunk is not null").select("chunk", "counts")
    with arrow_rows(spark, 16):
        got = sketch.repartition(CHUNKS, "chunk").mapInArrow(_sum_chunks(bits), "chunk int, counts binary").collect()  # 128 MB at most
    counts = np.zeros((CHUNKS, (1 << bits) // CHUNKS), np.int64)
    for chunk, part in got:
        _add_counts(counts[chunk], bytes(part))
    counts = counts.ravel()
    rank = np.minimum(255, np.log2(np.maximum(counts, 1)) * 8).astype(np.uint8)
    # pivots of the order: equal shares of the tokens, with hashes taken as even inside a frequency class
    total = int(counts.sum(dtype=np.int64))
    weight = np.bincount(rank, weights=counts, minlength=256)
    del counts
    below = np.concatenate(([0], np.cumsum(weight)))

    def pivots_at(goals: np.ndarray) -> np.ndarray:
        at = np.minimum(255, np.searchsorted(below, goals, "right") - 1)
        inside = np.clip((goals - below[at]) / np.maximum(weight[at], 1), 0, 1 - 1e-9)
        return (at.astype(np.uint64) << np.uint64(56)) | (inside * 2.0**56).astype(np.uint64)

    share = (100 - percent) / 100
    fragments = int(max(1, np.ceil(total * share / FRAGMENT_TOKENS)))
    # prefixes hold the rarest shingles; the pivots cut their part of the order
    pivots = pivots_at(total * np.minimum(1, 1.5 * share) * np.arange(1, fragments) / fragments)
    cuts = pivots_at(total * np.arange(1, VERIFY_FRAGMENTS) / VERIFY_FRAGMENTS)
    shared = spark.sparkContext.broadcast(Order(rank, renamed))
    packed = docs.select("text").mapInArrow(_emit_prefixes(shared, pivots, percent), "frag long, payload binary")
    dealt = packed.repartition(fragments, F.when(F.col("frag") < fragments, F.col("frag")).otherwise(F.xxhash64("frag", F.length("payload"))))
    members = dealt.mapInArrow(_shared_only(fragments), "key long, cls long, n int, pos int, w int")
    with arrow_rows(spark, 64):  # a row of shingles holds up to some 100 kB
        members = scratch.table(members, "members")
    free_shuffles(spark)
    # copies of a class in other buffers repeat (key, cls); that does no harm below
    lead = members.groupBy("key").agg(F.max(F.struct("w", "cls", "n", "pos")).alias("l"), F.min("cls").alias("lo"), F.max("cls").alias("hi"), (F.count("*") > 2).alias("many")).filter("lo <> hi")
    lead = scratch.table(lead.select("key", "l.cls", "l.n", "l.pos", "many"), "leads")
    free_shuffles(spark)
    near = (F.col("x.cls") != F.col("y.cls")) & _possible(percent)
    met = members.alias("x").join(lead.alias("y"), F.col("x.key") == F.col("y.key")).filter(near | F.col("y.many"))
    met = met.select("x.key", "x.cls", "x.n", "x.pos", "y.many", F.struct("y.cls", "y.n", "y.pos").alias("y"), near.alias("near"))
    met = scratch.table(met, "met")
    free_shuffles(spark)
    scratch.drop("members")
    scratch.drop("leads")
    pairs = met.filter("near").select(F.struct("cls", "n", "pos").alias("x"), "y")
    star = scratch.table(_ordered(pairs), "star")
    # in a bucket of two, the pair has been met
    members = met.filter("many").select("key", "cls", "n", "pos")
    first_doc = rows.filter("doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    has_null_ids = rows.filter("doc_id is null and n > 0").limit(1).count() > 0

    def segments(pairs: DataFrame, name: str) -> DataFrame:
        """Whole sets of the classes in pairs, cut into fragments; some others too, which then join with nothing."""
        needed = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        bloom = spark.sparkContext.broadcast(id_filter(first_doc.join(needed, "cls", "left_semi").select("doc_id")))
        segs = docs.filter("doc_id is not null").mapInArrow(_segments(shared, bloom, cuts), "cls long, f int, seg binary")
        if has_null_ids:  # sets that no row with a doc_id has are found by their class
            bloom = spark.sparkContext.broadcast(id_filter(needed.join(first_doc, "cls", "left_anti")))
            more = docs.filter("doc_id is null").mapInArrow(_segments(shared, bloom, cuts, by_class=True), "cls long, f int, seg binary")
            segs = segs.unionByName(more.dropDuplicates(["cls", "f"]))
        return scratch.table(segs, name)

    links = scratch.table(_verify(star, segments(star, "star-segments"), percent), "links")
    free_shuffles(spark)
    scratch.drop("star-segments")
    labels = scratch.table(components(links, scratch, "near"), "labels")
    named = members.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls")).distinct()
    open_ = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    named = scratch.table(named.join(open_, "key", "left_semi"), "open")
    rest = _open_buckets(named, bitmaps, percent).join(star.select("a", "b"), ["a", "b"], "left_anti")
    rest = scratch.table(rest, "rest")
    links = links.unionByName(scratch.table(_verify(rest, segments(rest, "rest-segments"), percent), "more"))
    free_shuffles(spark)
    scratch.drop("rest-segments")
    labels = scratch.table(components(links, scratch, "all"), "all-labels")
    # the least doc_id of each component
    classes = rows.groupBy("cls").agg(F.min("doc_id").alias("least"))
    classes = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    classes = scratch.table(classes, "classes")
    named = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    return rows, classes.join(named, "label").select("cls", "label", "component_id"), renamed


def _typed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def jaccard_components(docs: DataFrame, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id of every row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    rows, classes, _ = _linked_classes(_typed(docs), percent, scratch or Scratch(docs.sparkSession, "ngram"))
    full = rows.filter("n > 0").join(classes, "cls").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("cls").alias("class_id"))
    bare = rows.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("cls").alias("class_id"))
    return full.unionByName(bare)


def _with_class(renamed: dict[tuple[int, int], int], at: int):
    """Adds set size and class to batches whose text is column ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(np.zeros(1, np.uint8), renamed)
        for batch in batches:
            for w in K.each_slice(batch.column(at).cast(pa.string())):
                _, key, n = _sets(w)
                part = batch.slice(w.first, w.n_docs)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n.astype(np.int32)), pa.array(_class_of(key, n, order)[0])], [*batch.schema.names, "__n", "__cls"])

    return run


def keep_one_of_each(docs: DataFrame, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs, with all columns, less all but one of each component: of the rows with its least doc_id (or with
    none, if all lack it) one. Rows without words stay.

    Rows whose doc_id occurs once are decided on by it. Of the others, which need their text for that, each component's rows
    are reduced map-side first, so repeated rows do no harm.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = scratch or Scratch(spark, "ngram")
    rows, classes, renamed = _linked_classes(_typed(docs), percent, scratch)
    first = rows.filter("n > 0").join(classes, "cls").filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "cls", "label")
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.max("n").alias("n"))
    once = ids.filter("doc_id is not null and n_rows = 1")
    keep = once.filter("n = 0").select("doc_id").unionByName(once.join(first, "doc_id", "left_semi").select("doc_id"))
    number = F.col("doc_id").cast("long")
    alone = docs.join(keep.withColumnRenamed("doc_id", "__id"), number == F.col("__id"), "left_semi")
    twice = scratch.table(ids.filter("doc_id is not null and n_rows > 1").select(F.col("doc_id").alias("__id")), "repeated")
    others = docs.join(twice, number == F.col("__id"), "left_semi").unionByName(docs.filter("doc_id is null"))
    schema = T.StructType([*docs.schema.fields, T.StructField("__n", T.IntegerType()), T.StructField("__cls", T.LongType())])
    others = others.mapInArrow(_with_class(renamed, docs.columns.index("text")), schema)
    names = first.select(F.col("doc_id").alias("__id"), F.col("cls").alias("__class"), F.col("label").alias("__label")).distinct()
    chosen = others.filter("__n > 0").join(names, number.eqNullSafe(F.col("__id")) & (F.col("__cls") == F.col("__class")))
    chosen = chosen.groupBy("__label").agg(F.min_by(F.struct(*docs.columns), "__cls").alias("__row")).select("__row.*")
    return alone.unionByName(others.filter("__n = 0").select(docs.columns)).unionByName(chosen)
