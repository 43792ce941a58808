"""Language-model scoring with a Katz back-off bigram model.

P(v | u) = d(c) c(u, v) / (c(u) + R) for pairs seen in training, else alpha(u) P1(v). Counts c up to K = 5 are discounted
by Good-Turing (d), larger ones are trusted. alpha(u) = (1 - sum of seen P(v | u)) / (1 - sum of their P1(v)), so each
context's distribution sums to exactly 1 over the vocabulary and one unknown word. P1 is the Good-Turing unigram model;
its freed mass is the unknown word's. R = 0.01 is a reserve that lets contexts back off whose followers are all frequent.
A text's tokens are its words and one end; the context of the first is a start mark. All scores are log10.

How it runs. Pass 1 counts words (pre-aggregated per buffer) into a table. Pass 2 deals every token of every text, packed,
into parts by its word: there the word's count and all its pairs' counts are known, since all tokens of a pair meet. A
part's task goes through its words in ranges and keeps nothing of a range but sums by context, which it writes whenever they
are many, so its memory is bounded. The 65,535 commonest words are sent to all tasks with their counts, so that two bytes name
them; those with more than 1/65536 of all tokens are dealt by pair instead, so a hot word fills no part. A part sends each buffer of texts the counts of its
pairs and words there, in the order of the buffer's tokens: some 4 bytes a token, however many parts there are. It also
writes, for each context, numbers of followers with count 1..5 and the sum of their P1; and for unseen pairs whose context
is no common word, the context asked for. These are rows of one table, told apart by their kind. The counts are gathered by buffer, where each
text's tokens are summed (the common words' back-off weights are sent to all tasks), and the other contexts' weights joined to
the texts that asked. What is gathered grows with the input.

Edge cases: a null text has the end as its only token; rows with a null doc_id are scored but not learned from; identical rows are
scored each; with no training row the score is that of the unknown word at every token; empty tables give no rows; very long
texts are scored whole, in ranges of their own buffer; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm import kernel as K
from loomwell.llm.scratch import Scratch, arrow_rows, free_shuffles, small_batches

GT = 5
RESERVE = 0.01
END, START = np.uint64(0xA5C1E9D3B7F02461), np.uint64(0x5B3D9F1742C8E0A7)
FLUSH_TOKENS = 1_000_000
PART_TOKENS = 16_000_000  # of one task, which handles SUB_TOKENS at a time
SUB_TOKENS = 400_000
HOT_SHARE = 65_536
HOT_WORDS = 65_535  # numbers of 16 bits, 0 for all others
TEXT_BITS = 16  # of a text's number in its buffer
MOST_TEXTS = 65_000
MOST_CONTEXTS = 300_000  # that a part holds


def tokens_of(w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, token, context) of a slice: each text's words and its end."""
    n = len(w.hash) + w.n_docs
    per = w.per_doc()
    token, doc = np.empty(n, np.uint64), np.empty(n, np.int64)
    at = np.arange(len(w.hash)) + w.doc
    ends = np.cumsum(per) + np.arange(w.n_docs)
    token[at], doc[at] = w.hash, w.doc
    token[ends], doc[ends] = END, np.arange(w.n_docs)
    context = np.empty(n, np.uint64)
    context[1:] = token[:-1]
    context[np.concatenate(([0], ends[:-1] + 1))[: w.n_docs]] = START
    return doc, token, context


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        words, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(K.long_of(words)), pa.array(counts.astype(np.int64))], ["w", "c"])

    for batch in batches:
        train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for w in K.each_slice(batch.column(1)):
            doc, token, _ = tokens_of(w)
            held.append(token[train[w.first + doc]])
            size += len(held[-1])
            if size >= 3 * FLUSH_TOKENS:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


@dataclass
class Unigrams:
    total: int
    distinct: int
    discount: np.ndarray  # of counts 1..GT at [1..GT]
    unknown: float  # probability of the unknown word
    scale: float
    hot: np.ndarray  # sorted hashes of the commonest words
    hot_counts: np.ndarray

    @property
    def split(self) -> np.ndarray:
        """Which of these are dealt by pair."""
        return self.hot_counts > max(1, self.total // HOT_SHARE)

    def p1(self, c: np.ndarray) -> np.ndarray:
        d = np.where(c <= GT, self.discount[np.minimum(c, GT)], 1.0)
        return np.where(c > 0, self.scale * d * c / max(1, self.total), self.unknown)


def good_turing(n: np.ndarray) -> np.ndarray:
    """Katz's discounts of counts 1..GT (at [1..GT]) from the numbers n[r] of types with count r, r up to GT + 1. A discount
    that the counts of counts cannot support (none, or not in (0, 1)) is 1, but for count 1, which then is 1/2."""
    d = np.ones(GT + 1)
    a = (GT + 1) * n[GT + 1] / n[1] if n[1] else 1.0
    for r in range(1, GT + 1):
        if n[r] and a < 1:
            x = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a)
            if 0 < x < 1:
                d[r] = x
    if d[1] == 1.0:
        d[1] = 0.5
    return d


def unigrams(words: DataFrame) -> Unigrams:
    """Statistics of a table of all training words (w, c)."""
    row = words.agg(F.sum("c"), F.count("*"), *[F.sum((F.col("c") == r).cast("long")) for r in range(1, GT + 2)]).first()
    total, distinct = int(row[0] or 0), int(row[1])
    n = np.array([0, *(int(x or 0) for x in row[2:])], float)
    d = good_turing(n)
    freed = sum((1 - d[r]) * r * n[r] for r in range(1, GT + 1)) / max(1, total)
    scale = 1.0
    if not freed > 0:
        scale, freed = total / (total + 1.0), 1.0 / (total + 1.0)
    hot = words.orderBy(F.desc("c"), "w").limit(HOT_WORDS).toPandas()
    h = hot["w"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return Unigrams(total, distinct, d, freed, scale, h[order], hot["c"].to_numpy(np.int64)[order])


def _find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return (table[at] == x if len(table) else np.zeros(len(x), bool)), at


DOC = np.dtype([("id", np.int64), ("n", np.int32), ("has_id", np.int8), ("train", np.int8)])


def _pieces(buf, *parts: tuple[type, int], at: int) -> Iterator[np.ndarray]:
    """Successive arrays of a buffer."""
    for kind, n in parts:
        yield np.frombuffer(buf, kind, n, at)
        at += n * np.dtype(kind).itemsize


def _deal(shared, parts: int, subs: int):
    """Tokens by part and sub-range of their place. A buffer has a number, and its texts have numbers in it. It sends one table
    of its texts to some part (sub -1), and to each sub-range its tokens there, sorted by word and context: flags where a word
    and a pair begin and where a text is learned from, contexts (hot ones by their number), and the texts' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, split = shared.value.hot, shared.value.split
        held: list[tuple] = []
        tables: list[np.ndarray] = []
        size = texts = 0
        uid = TaskContext.get().partitionId() << 24  # the same when a lost task runs again

        def flush() -> pa.RecordBatch:
            nonlocal held, tables, size, texts, uid
            doc, v, u = (np.concatenate(x) for x in zip(*held))
            table = np.concatenate(tables)
            held, tables, size, texts = [], [], 0, 0
            uid += 1
            # ranges of the word's hash, of the pair's for hot words
            is_hot, at = _find(hot, v)
            if len(hot):
                is_hot &= split[at]
            place = np.where(is_hot, K.mix(u * K.PLACES[0] + v), v)
            order = np.argsort((place & np.uint64(0xFFFFFFFF00000000)) | (K.mix(u) >> np.uint64(32)))
            doc, v, u, place = doc[order], v[order], u[order], place[order]
            sub = (((place >> np.uint64(32)) * np.uint64(parts * subs)) >> np.uint64(32)).astype(np.int64)
            new_v = K.first_of_run(v, sub)
            new_pair = new_v | K.first_of_run(u)
            train = table["train"][doc] > 0
            u_hot, at = _find(hot, u)
            code = np.where(u_hot, at + 1, 0).astype(np.uint16)
            rows: list[tuple[int, int, bytes]] = [(uid % parts, -1, np.int64(uid).tobytes() + table.tobytes())]
            cuts = np.flatnonzero(K.first_of_run(sub))  # only sub-ranges with tokens
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(sub)]):
                pairs, full = new_pair[a:b], u[a:b][new_pair[a:b]]
                codes = code[a:b][pairs]
                words = v[a:b][new_v[a:b]]
                cold = full[codes == 0]
                head = np.array([uid, b - a, len(codes), len(words), len(cold)], np.int64)
                bits = (np.packbits(pairs), np.packbits(train[a:b]), np.packbits(new_v[a:b][pairs]))
                payload = b"".join(x.tobytes() for x in (head, words, cold, codes, doc[a:b].astype(np.uint16), *bits))
                rows.append((int(sub[a]) // subs, int(sub[a]) % subs, payload))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["part", "sub", "payload"])

        for batch in batches:
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            number = ids.fill_null(-1).to_numpy(zero_copy_only=False)
            train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for w in K.each_slice(batch.column(1)):
                doc, v, u = tokens_of(w)
                if texts + w.n_docs > MOST_TEXTS and held:
                    yield flush()
                table = np.zeros(w.n_docs, DOC)
                rows = slice(w.first, w.first + w.n_docs)
                table["id"], table["has_id"], table["train"] = number[rows], known[rows], train[rows]
                table["n"] = np.bincount(doc, minlength=w.n_docs)
                held.append((doc + texts, v, u))
                tables.append(table)
                size, texts = size + len(v), texts + w.n_docs
                if size >= FLUSH_TOKENS:
                    yield flush()
                    K.trim()
        if held:
            yield flush()
        K.trim()

    return run


COLUMNS = ["kind", "a", "b", "k1", "k2", "k3", "k4", "k5", "x", "data"]
OUT = "kind int, a long, b long, k1 long, k2 long, k3 long, k4 long, k5 long, x double, data binary"


def _batch(kind: int, size: int, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    types = {"kind": pa.int32(), "x": pa.float64(), "data": pa.binary()}
    arrays = []
    for c in COLUMNS:
        t = types.get(c, pa.int64())
        if c == "kind":
            arrays.append(pa.array(np.full(size, kind, np.int32)))
        elif c in columns:
            arrays.append(columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c]).cast(t))
        else:
            arrays.append(pa.nulls(size, t))
    return pa.RecordBatch.from_arrays(arrays, COLUMNS)


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


class _Part:
    """The sub-ranges of one part: counts for the buffers; sums by context; numbers of pairs by count."""

    def __init__(self, uni: Unigrams):
        self.uni = uni
        self.contexts: tuple | None = None
        self.hist = np.zeros(GT + 3, np.int64)

    def add_tokens(self, payloads: list) -> Iterator[pa.RecordBatch]:
        uni = self.uni
        vs, us, pair_of, text_of, train_of, sent = [], [], [], [], [], []
        n_pairs = 0
        for buf in payloads:
            uid, nt, np_, nv, nc = (int(x) for x in np.frombuffer(buf, np.int64, 5))
            words, cold, codes, local, pairs, train, new_v = _pieces(
                buf, (np.uint64, nv), (np.uint64, nc), (np.uint16, np_), (np.uint16, nt), (np.uint8, (nt + 7) // 8), (np.uint8, (nt + 7) // 8), (np.uint8, (np_ + 7) // 8), at=40
            )
            u = np.empty(np_, np.uint64)
            u[codes > 0] = uni.hot[codes[codes > 0].astype(np.int64) - 1]
            u[codes == 0] = cold
            word_of = np.cumsum(np.unpackbits(new_v, count=np_), dtype=np.int64) - 1
            us.append(u)
            vs.append(words[word_of])
            pair_of.append(np.cumsum(np.unpackbits(pairs, count=nt), dtype=np.int32) + np.int32(n_pairs - 1))
            train_of.append(np.unpackbits(train, count=nt))
            text_of.append(local)
            sent.append((uid, nt, np_, nv, local, pairs, new_v, word_of, slice(n_pairs, n_pairs + np_), codes))
            n_pairs += np_
        v, u, pair = (np.concatenate(x) for x in (vs, us, pair_of))
        own = np.bincount(pair, weights=np.concatenate(train_of), minlength=n_pairs).astype(np.int64)
        del vs, us, train_of
        order = np.argsort(K.mix(u * K.PLACES[0] + v))  # all buffers' copies of a pair together
        new = K.first_of_run(v[order], u[order])
        group = np.empty(n_pairs, np.int32)
        group[order] = np.cumsum(new, dtype=np.int32) - 1
        lead = order[new]
        c = np.bincount(group, weights=own).astype(np.int64)
        gv, gu = v[lead], u[lead]
        del v, u, own, order, new
        words, word_of = np.unique(gv, return_inverse=True)
        c_v = np.bincount(word_of, weights=c, minlength=len(words)).astype(np.int64)
        is_hot, at = _find(uni.hot, words)
        if is_hot.any():
            c_v[is_hot] = uni.hot_counts[at[is_hot]]
        uids, data = [], []
        for uid, nt, np_, nv, local, pairs, new_v, place, mine, codes in sent:
            g = group[mine]
            counts = np.empty(nv, np.int64)
            end = np.zeros(nv, np.uint8)
            counts[place] = c_v[word_of[g]]
            end[place] = words[word_of[g]] == END
            unseen = codes[c[g] == 0]  # their contexts' numbers, 0 for cold ones
            head = np.array([nt, np_, nv, len(unseen)], np.int64)
            data.append(_packed(b"".join(x.tobytes() for x in (head, c[g], counts, unseen, local, pairs, new_v, end))))
            uids.append(uid)
        yield _batch(4, len(uids), a=np.array(uids, np.int64), data=pa.array(data, pa.binary()))
        # unseen pairs with a cold context: each text asks for its back-off weight
        asks_u, asks_d = [], []
        for (uid, _, _, _, local, *_, mine, codes), of in zip(sent, pair_of):
            g = group[of]
            ask = np.flatnonzero((c[g] == 0) & (codes == 0)[of - mine.start])
            asks_u.append(gu[g[ask]])
            asks_d.append((uid << TEXT_BITS) + local[ask].astype(np.int64))
        yield from self._asked(np.concatenate(asks_u), np.concatenate(asks_d))
        seen = np.flatnonzero(c > 0)
        few = np.zeros((len(seen), GT), np.int32)
        small = np.flatnonzero(c[seen] <= GT)
        few[small, c[seen][small] - 1] = 1
        self._merge(gu[seen], few, uni.p1(c_v)[word_of[seen]])
        if len(self.contexts[0] if self.contexts is not None else ()) > MOST_CONTEXTS:
            yield from self._context_rows()
        self.hist += np.bincount(np.minimum(c, GT + 2), minlength=GT + 3)

    def _merge(self, u: np.ndarray, few: np.ndarray, mass: np.ndarray) -> None:
        if self.contexts is not None:
            u, few, mass = np.concatenate((self.contexts[0], u)), np.concatenate((self.contexts[1], few)), np.concatenate((self.contexts[2], mass))
        if len(u):
            order = np.argsort(u)
            u = u[order]
            starts = np.flatnonzero(K.first_of_run(u))
            self.contexts = u[starts], np.add.reduceat(few[order], starts), np.add.reduceat(mass[order], starts)

    def _asked(self, u: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((d, u))
        u, d = u[order], d[order]
        new = np.flatnonzero(K.first_of_run(u, d))
        times = np.diff(np.append(new, len(u)))
        for a in range(0, len(new) if len(u) else 0, 50_000):
            s = new[a : a + 50_000]
            yield _batch(2, len(s), a=K.long_of(u[s]), b=d[s], k1=times[a : a + 50_000].astype(np.int64))

    def _context_rows(self) -> Iterator[pa.RecordBatch]:
        if self.contexts is not None:
            u, few, mass = self.contexts
            self.contexts = None
            for a in range(0, len(u), 50_000):
                s = slice(a, min(len(u), a + 50_000))
                yield _batch(1, s.stop - a, a=K.long_of(u[s]), x=mass[s], **{f"k{r}": few[s, r - 1].astype(np.int64) for r in range(1, GT + 1)})

    def results(self) -> Iterator[pa.RecordBatch]:
        yield from self._context_rows()
        yield _batch(3, 1, b=self.hist[GT + 1 : GT + 2], **{f"k{r}": self.hist[r : r + 1] for r in range(1, GT + 1)})


def _part_sums(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: _Part | None = None
        at: tuple[int, int] | None = None
        held: list = []
        for batch in batches:
            for p, k, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (p, k) != at:
                    if held:
                        yield from part.add_tokens(held)
                        held = []
                        K.trim()
                    if at is None or p != at[0]:
                        if part is not None:
                            yield from part.results()
                        part = _Part(shared.value)
                    at = (p, k)
                if k < 0:
                    table = payload.as_py()
                    yield _batch(0, 1, a=np.frombuffer(table, np.int64, 1), data=pa.array([table[8:]], pa.binary()))
                else:
                    held.append(payload.as_py())
        if held:
            yield from part.add_tokens(held)
        if part is not None:
            yield from part.results()
        del part, held
        K.trim()

    return run


TEXTS = "code long, doc_id long, held boolean, n long, known long, base double, y double"


def _text_sums(uni: Unigrams, discount: np.ndarray, weights: np.ndarray):
    """Sums by text of rows (uid, kind, data) that are sorted so: a buffer's table, then its tokens' counts. ``weights``: back-off
    weights by the contexts' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in TEXTS.split(", ")]
        uid, table, held, size = -1, np.zeros(0, DOC), [], 0
        known = base = y = np.zeros(0)
        low = np.log10(np.maximum(discount * np.arange(GT + 1), 1e-300))

        def add() -> None:
            nonlocal known, base, y, held, size
            local, c, c_v, end, back = (np.concatenate(x) for x in zip(*held))
            held, size = [], 0
            n = len(table)
            known = known + np.bincount(local, weights=c_v > 0, minlength=n)
            base = base + np.bincount(local, weights=np.log10((c_v + 0.5) / (uni.total + 0.5 * (uni.distinct + 1))), minlength=n)
            # a token's value: as a word after its context, and as the context of what follows
            value = np.where(c > GT, np.log10(np.maximum(c, 1)), np.where(c > 0, low[np.minimum(c, GT)], np.log10(uni.p1(c_v)) + back))
            value = value + np.where((c_v > 0) & ~end, -np.log10(c_v + RESERVE), 0.0)
            y = y + np.bincount(local, weights=value, minlength=n)

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                add()
            for a in range(0, len(table), 20_000):
                s = slice(a, min(len(table), a + 20_000))
                t = table[s]
                code = (np.int64(uid) << TEXT_BITS) + np.arange(s.start, s.stop)
                columns = [pa.array(code), pa.array(t["id"], mask=t["has_id"] == 0), pa.array(t["train"] == 0), pa.array(t["n"].astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(known[s].astype(np.int64)), pa.array(base[s]), pa.array(y[s])], names)

        for batch in batches:
            for u, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if kind == 0:
                    yield from done()
                    uid, table = u, np.frombuffer(data.as_py(), DOC)
                    known, base, y = (np.zeros(len(table)) for _ in range(3))
                    continue
                raw = data.as_py()
                raw = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
                nt, np_, nv, nu = (int(x) for x in np.frombuffer(raw, np.int64, 4))
                c, c_v, unseen, local, pairs, new_v, end = _pieces(
                    raw, (np.int64, np_), (np.int64, nv), (np.uint16, nu), (np.uint16, nt), (np.uint8, (nt + 7) // 8), (np.uint8, (np_ + 7) // 8), (np.uint8, nv), at=32
                )
                back = np.zeros(np_)
                back[c == 0] = weights[unseen]
                pair = np.cumsum(np.unpackbits(pairs, count=nt), dtype=np.int64) - 1
                word = (np.cumsum(np.unpackbits(new_v, count=np_), dtype=np.int64) - 1)[pair]
                held.append((local, c[pair], c_v[word], end[word] > 0, back[pair]))
                size += nt
                if size > 500_000:
                    add()
        yield from done()
        K.trim()

    return run


def score_documents(docs: DataFrame, folds: int = 5, fold: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = scratch or Scratch(spark, "katz")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(rest != fold, F.lit(False)).alias("train"))
    words = docs.mapInArrow(_count_words, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))
    words = scratch.table(words, "words")
    uni = unigrams(words)
    n_train = words.filter(F.col("w") == int(END.astype(np.int64))).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    free_shuffles(spark)
    shared = spark.sparkContext.broadcast(uni)
    expected = uni.total * folds // (folds - 1)
    parts = max(1, -(-expected // PART_TOKENS), min(spark.sparkContext.defaultParallelism, expected // SUB_TOKENS))
    subs = max(1, -(-expected // (parts * SUB_TOKENS)))
    dealt = docs.mapInArrow(_deal(shared, parts, subs), "part int, sub int, payload binary")
    dealt = dealt.repartitionById(parts, "part").sortWithinPartitions("part", "sub")
    with arrow_rows(spark, 64):  # a row of tokens holds up to some 100 kB
        table = scratch.table(dealt.mapInArrow(_part_sums(shared), OUT), "parts")
    del dealt
    free_shuffles(spark)
    row = table.filter("kind = 3").agg(*[F.sum(f"k{r}") for r in range(1, GT + 1)], F.sum("b")).first()
    d = good_turing(np.array([0, *(int(x or 0) for x in row)], float))
    freed = sum(((1 - d[r]) * r * F.col(f"k{r}") for r in range(1, GT + 1)), F.lit(RESERVE))
    contexts = table.filter("kind = 1").groupBy("a").agg(*[F.sum(f"k{r}").alias(f"k{r}") for r in range(1, GT + 1)], F.sum("x").alias("x"))
    contexts = contexts.select("a", F.log10(freed / (1 - F.col("x"))).alias("weight"))
    hot = spark.createDataFrame(pd.DataFrame({"a": K.long_of(uni.hot), "code": np.arange(1, len(uni.hot) + 1)}), "a long, code int")
    found = contexts.join(F.broadcast(hot), "a").select("code", "weight").toPandas()  # HOT_WORDS rows at most
    weights = np.zeros(len(uni.hot) + 1)
    weights[found["code"].to_numpy(np.int64)] = found["weight"].to_numpy(float)
    asked = table.filter("kind = 2").select("a", F.col("b").alias("code"), F.col("k1").alias("n"))
    # the start mark is the context of every text's first token: its weight is one number, not a key that a row a text would meet at
    begin = int(START.astype(np.int64))
    first = contexts.filter(F.col("a") == begin).first()
    at_start = asked.filter(F.col("a") == begin).withColumn("weight", F.lit(first["weight"] if first else 0.0))
    asked = asked.filter(F.col("a") != begin).join(contexts, "a").unionByName(at_start if first else at_start.limit(0))
    asked = asked.groupBy("code").agg(F.sum(F.col("n") * F.col("weight")).alias("back"))
    packed = table.filter("kind in (0, 4)").select("a", "kind", "data").repartition(max(parts, spark.sparkContext.defaultParallelism), "a").sortWithinPartitions("a", "kind")
    with arrow_rows(spark, 64):
        texts = scratch.table(packed.mapInArrow(_text_sums(uni, d, weights), TEXTS), "texts")
    start = float(-np.log10(n_train + RESERVE)) if n_train else 0.0  # of the start mark's count, for the first token
    return texts.join(asked, "code", "left").select(
        "doc_id", F.coalesce(rest == fold, F.lit(False)).alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(uni.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("y") + F.coalesce("back", F.lit(0.0)) + start).alias("score"),
    )
