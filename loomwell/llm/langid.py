"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded amount of labelled text. A text is parsed greedily: each phrase
is the longest match, from its start, of any substring of that language's text. The fewer phrases a text needs, the closer
it is to the language; the phrase count is normalised to bits a character (phrases * log2(length of the training text) /
characters), so that languages with less training text compare fairly. The language with the least wins; ties go to the
language that sorts first.

Training text: of the labelled rows of a language, whole texts in the order of a hash of doc_id, as long as they hold at most
``train_chars`` characters together (with many languages, an equal share of ``total_chars``). Only texts of up to an eighth of
``train_chars`` are taken, so that no single one makes the language; a language that has none gives its shortest text (of which
4 * ``train_chars`` characters are learned at most). Every language of the labelled rows is learned. All bounds are parameters.

Predictions see whole texts, and phrases end nowhere but at their last match: for speed, pieces of ``PIECE`` letters are parsed
at once, each as if a phrase began there; then pieces are parsed again from where the phrase that crosses into them ends,
until both parses begin a phrase at the same place, after which they are the same.

All letters of the training text take part, of any script: transitions are kept sparse, so rare letters cost nothing.

Edge cases: null texts, and texts without any letter, are 'und' with score 0; with no labelled row every text is 'und';
repeated rows are all kept; a null doc_id is passed through like all others, unchanged, and its row is learned from; very long texts are
parsed whole; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwell.llm.scratch import small_batches

PIECE = 256
#: Characters that a task parses at a time, or one longer text.
SLICE_CHARS = 3_000_000
OTHER = 1
WINDOW = 256  # places that are tried at once for a state's transitions


@dataclass
class Transitions:
    """A language's automaton with its sparse transitions laid over each other in one array; state 1 is the root, 0 none."""

    base: np.ndarray  # of each state: the place of its transition by symbol 0, were there one
    slots: np.ndarray  # state and next state of the transition at a place; -1 for none

    @staticmethod
    def of(nxt: list[dict[int, int]], n_symbols: int) -> Transitions:
        degree = np.array([len(x) for x in nxt])
        base = np.zeros(len(nxt), np.int64)
        used = np.zeros(2 * int(degree.sum()) + 2 * n_symbols + WINDOW, bool)
        lo, last = n_symbols, 0
        for state in np.argsort(-degree, kind="stable")[: int((degree > 1).sum())].tolist():
            symbols = np.array(sorted(nxt[state]))
            span = symbols - symbols[0]
            if degree[state] != last:  # the holes that larger states left can fit smaller ones
                lo, last = n_symbols, degree[state]
            while True:
                if lo + WINDOW + n_symbols > len(used):
                    used = np.append(used, np.zeros(len(used), bool))
                place = np.flatnonzero(~used[lo : lo + WINDOW]) + lo
                fits = place[~used[place[:, None] + span].any(1)]
                if len(fits):
                    break
                lo += WINDOW  # what is left there is for single transitions
            base[state] = fits[0] - symbols[0]
            used[fits[0] + span] = True
        # single transitions fit everywhere
        single = np.flatnonzero(degree == 1)
        symbol = np.fromiter((c for s in single.tolist() for c in nxt[s]), np.int64, len(single))
        free = np.flatnonzero(~used[n_symbols:])[: len(single)] + n_symbols
        free = np.append(free, len(used) + np.arange(len(single) - len(free)))
        base[single] = free - symbol
        slots = np.full(int(base.max()) + n_symbols + 1, -1, np.int64)
        n = int(degree.sum())
        state = np.repeat(np.arange(len(nxt)), degree)
        places = base[state] + np.fromiter((c for x in nxt for c in x), np.int64, n)
        slots[places] = (state << 32) | np.fromiter((q for x in nxt for q in x.values()), np.int64, n)
        return Transitions(base.astype(np.int32), slots)

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The next states, 0 for none."""
        to = self.found(state, c)
        to[(to >> 32) != 0] = 0
        return to

    def found(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The next states, and numbers beyond 32 bits for none: a slot holds its owner above the next state."""
        to = np.take(self.slots, np.take(self.base, state) + c)
        to ^= state << 32
        return to


@dataclass
class Model:
    languages: list[str]
    symbol_of: np.ndarray  # of each code point
    tables: list[Transitions]
    bits: np.ndarray  # log2 of each language's training length


def symbols(texts: list[str], alphabet: np.ndarray) -> np.ndarray:
    """Symbols of the texts, with one separator for each run of characters that are no letters."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    s = alphabet[codes]
    keep = s != 0
    keep[:1] = True
    keep[1:] |= s[:-1] != 0
    return s[keep]


@lru_cache(1)
def _letters() -> tuple[np.ndarray, dict[int, int]]:
    """Whether each code point is a letter or a mark, and the lower case of letters that differ from it."""
    letters = np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(sys.maxunicode + 1)])
    return letters, {c: ord(low[0]) for c in np.flatnonzero(letters).tolist() if (low := chr(c).lower()) != chr(c)}


def alphabet_of(texts: list[str]) -> np.ndarray:
    """Symbols of code points: 0 for all but letters and marks, numbers from 2 for all letters of the texts (case folded),
    and OTHER, which matches nothing, for letters that no text has."""
    letters, lower = _letters()
    seen = np.zeros(len(letters), bool)
    for t in texts:
        seen[np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)] = True
    own = np.flatnonzero(seen & letters)
    out = np.where(letters, OTHER, 0).astype(np.uint32)
    out[own] = np.arange(2, 2 + len(own))
    for c, low in lower.items():
        out[c] = out[low]
    return out


def automaton(text: np.ndarray, n_symbols: int) -> Transitions:
    """The suffix automaton of a sequence of symbols below ``n_symbols``."""
    n = len(text)
    nxt: list[dict[int, int]] = [{}, {}]
    length, link = [0] * (2 * n + 3), [0] * (2 * n + 3)
    last = 1

    def clone(p: int, c: int, q: int) -> int:
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length[new], link[new] = length[p] + 1, link[q]
        while p and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    for c in text.tolist():
        if c == OTHER:  # matches nothing: later text begins anew
            last = 1
            continue
        p = last
        q = nxt[p].get(c, 0)
        if q:  # after a restart the transition can exist already
            if length[p] + 1 != length[q]:
                new = clone(p, c, q)
                link[q], q = new, new
            last = q
            continue
        cur = len(nxt)
        nxt.append({})
        length[cur] = length[p] + 1
        while p and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if not p:
            link[cur] = 1
        else:
            q = nxt[p][c]
            if length[p] + 1 != length[q]:
                new = clone(p, c, q)
                link[q], q = new, new
            link[cur] = q
        last = cur
    return Transitions.of(nxt, n_symbols)


def _walk(table: Transitions, s: np.ndarray, at: np.ndarray, bound: np.ndarray, limit: np.ndarray, meet: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy parses from places ``at`` of the symbols, each up to the first phrase that begins at or behind its ``bound``, to
    its text's end ``limit``, where a symbol stands that matches nothing, or to a phrase that begins where ``meet`` is set. Returns
    the beginnings of all phrases, and of each walk the place where it ended (-1 if it met) and where it met (else -1)."""
    end, met = np.full(len(at), -1, np.int64), np.full(len(at), -1, np.int64)
    begun = []
    lane = np.arange(len(at))
    state = np.zeros(len(at), np.int64)  # from which all symbols miss: a phrase begins
    while len(lane):
        c = np.take(s, at)
        to = table.found(state, c)
        miss = np.flatnonzero(to >> 32)
        if len(miss):
            here = at[miss]
            over = (here >= limit[miss]) | (here >= bound[miss])
            end[lane[miss[over]]] = here[over]
            stop = over
            if meet is not None:
                both = ~over & meet[here]
                met[lane[miss[both]]] = here[both]
                stop = over | both
            go = miss[~stop]
            begun.append(at[go])
            to[go] = table.step(np.ones(len(go), np.int64), c[go])  # 0 if the symbol is unknown: a phrase of its own
            if stop.any():
                keep = np.ones(len(lane), bool)
                keep[miss[stop]] = False
                lane, at, to, bound, limit = lane[keep], at[keep], to[keep], bound[keep], limit[keep]
        at, state = at + 1, to
    return (np.concatenate(begun) if begun else np.zeros(0, np.int64)), end, met


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


def phrases(table: Transitions, s: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Greedy phrase counts of the texts s[cuts[k] : cuts[k + 1]]."""
    size = np.diff(cuts)
    s = np.insert(s.astype(np.int64), cuts[1:], OTHER)  # behind each text a symbol that matches nothing
    first = cuts[:-1] + np.arange(len(size))
    n = -(-size // PIECE)  # pieces of each text
    text = np.repeat(np.arange(len(size)), n)
    begin = _ranges(np.zeros(len(n), np.int64), n) * PIECE + first[text]
    limit = (first + size)[text]
    bound = np.minimum(begin + PIECE, limit)
    starts = np.zeros(len(s) + 1, bool)  # where phrases begin
    found, end, _ = _walk(table, s, begin, bound, limit, None)
    starts[found] = True
    inner = np.flatnonzero(begin > first[text])  # pieces behind another one
    entry = begin.copy()
    while True:
        todo = inner[end[inner - 1] != entry[inner]]
        if not len(todo):
            break
        entry[todo] = end[todo - 1]
        # no phrase begins between a piece's beginning and its entry
        starts[_ranges(begin[todo], np.minimum(entry[todo], bound[todo]) - begin[todo])] = False
        over = entry[todo] >= bound[todo]
        end[todo[over]] = entry[todo[over]]
        again = todo[~over]
        found, ended, met = _walk(table, s, entry[again], bound[again], limit[again], starts)
        stop = np.where(met >= 0, met, bound[again])
        starts[_ranges(entry[again], stop - entry[again])] = False
        starts[found] = True
        end[again[ended >= 0]] = ended[ended >= 0]
    total = np.concatenate(([0], np.cumsum(starts)))
    return total[first + size] - total[first]


def train(docs: DataFrame, train_chars: int = 100_000, total_chars: int = 1_600_000) -> Model:
    """Learn from rows (doc_id, text, lang) that have all three."""
    rows = docs.filter("text is not null and lang is not null and doc_id is not null").select(
        "lang", "doc_id", "text", F.length("text").alias("size"), F.xxhash64("doc_id").alias("h")
    )
    # a hash threshold of each language first, so that few rows are sorted; the least hash always passes
    short, place = F.col("size") <= train_chars // 8, F.pmod("h", F.lit(1_000_000))
    counts = rows.groupBy("lang").agg(F.sum(F.when(short, F.col("size"))), F.min(F.when(short, place)), F.min("size")).collect()  # one row a language
    most = min(train_chars, max(2000, total_chars // max(1, len(counts))))
    names = sorted(r[0] for r in counts)
    bounds = [(lang, max(least, int(min(1.0, 4.0 * most / max(1, chars)) * 1_000_000)) if least is not None else None, size) for lang, chars, least, size in counts]
    limits = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, most int, shortest int"))
    some = rows.join(limits, "lang").filter(F.when(F.col("most").isNull(), F.col("size") == F.col("shortest")).otherwise(short & (place <= F.col("most"))))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = some.withColumn("total", F.sum("size").over(order)).withColumn("rn", F.count("*").over(order)).filter((F.col("total") <= most) | (F.col("rn") == 1))
    got = some.select("lang", "rn", F.substring("text", 1, 4 * train_chars).alias("text")).orderBy("lang", "rn").toPandas()
    parts = got.groupby("lang")["text"].agg(list).to_dict()
    texts = {x: parts.get(x, []) for x in names}
    alphabet = alphabet_of([t for x in texts.values() for t in x])
    tables, bits = [], []
    for x in names:
        s = symbols(texts[x], alphabet)
        tables.append(automaton(s, int(alphabet.max()) + 1))
        bits.append(np.log2(max(2, len(s))))
    return Model(names, alphabet, tables, np.array(bits))


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    """Bits a character of each text under each language."""
    codes = [symbols([t], model.symbol_of) for t in texts]
    size = np.array([len(x) for x in codes], np.int64)
    cuts = np.concatenate(([0], np.cumsum(size)))
    s = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    out = np.zeros((len(texts), len(model.languages)))
    if len(s):
        for j, table in enumerate(model.tables):
            out[:, j] = phrases(table, s, cuts) * model.bits[j] / np.maximum(1, size)
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # tables over total_chars characters together

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            pred, score = np.full(n, "und", object), np.zeros(n)
            todo = np.flatnonzero(batch.column(3).fill_null(False).to_numpy(zero_copy_only=False)) if m.languages else np.zeros(0, int)
            step: list[int] = []
            texts: list[str] = []
            size = 0
            for i in [*todo.tolist(), None]:
                text = batch.column(1)[i].as_py() if i is not None else ""
                if step and (i is None or size + len(text) > SLICE_CHARS):
                    bits = score_texts(m, texts)
                    best = bits.argmin(1)
                    rel = np.exp(-8.0 * (bits - bits.min(1, keepdims=True)) / np.maximum(bits.min(1, keepdims=True), 1e-9))
                    pred[step] = np.array(m.languages, object)[best]
                    score[step] = 1.0 / rel.sum(1)
                    step, texts, size = [], [], 0
                if i is not None:
                    step.append(i)
                    texts.append(text)
                    size += len(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    cols = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), "held_out", F.col("text").rlike(r"\p{L}").alias("letters")
    )
    return cols.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def predict_languages(docs: DataFrame, folds: int = 4, fold: int = 2, **bounds: int) -> DataFrame:
    """Learn from the rows whose crc32 of doc_id modulo ``folds`` is not ``fold``; predict all rows."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))
    docs = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    return identify(docs, train(docs.filter(~F.col("held_out")), **bounds))
