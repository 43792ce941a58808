"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

The pattern of the rank files cuts a text into contractions, runs of letters, of numbers or of other visible code points (each
with one space before it, if any), and white space. Here no regular expression runs. A slice of texts becomes an array of
code points, and each of these a class. A class acts on the few states of an automaton that reads a text from left to right;
such actions compose, and all compositions that occur are numbered once (a few hundred), with a table of products. So the
states at all places come from an associative scan over action numbers: places in blocks are multiplied column by column,
for all blocks at a time, and the blocks' own products are scanned in the same way. A piece begins where the step from one
state to the next says so; the only look-ahead is whether the next code point is white space. The pieces' byte offsets cut
the slice's UTF-8 buffer, each distinct piece is merged once per task and then looked up, and the same offsets say where each
text's ids begin and end when they are decoded.

Letters and numbers are those on which the regex module and Python agree; for code points assigned between their versions of
Unicode the rank library itself is asked (tests compare with it over all code points).

Edge cases: a null text is empty (no tokens, empty decoding); a null doc_id is passed through, as are all others, unchanged;
repeated rows are kept; empty tables give no rows; extra columns are ignored, whatever their names. Very long texts are a
slice of their own; a very long piece is merged with a heap, in n log n steps, and is not kept. A task keeps at most
``CACHE_PIECES`` pieces.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm import kernel as K
from loomwell.llm.scratch import small_batches

CACHE_PIECES = 400_000
CACHE_PIECE_BYTES = 200
#: Bytes of pieces that are merged together; longer ones are merged with a heap.
WIDTHS = (8, 12, 16, 32)
#: Code points of a block of the scan.
BLOCK = 64

#: Fixed value: the pattern that the automaton below reads by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What may stand behind a contraction's quote.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: The White_Space property.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# Classes of code points. QUOTE1 and QUOTE2 are quotes with a contraction's one or two letters behind.
SPACE, GAP, OTHER, QUOTE1, QUOTE2, NUMBER, LETTER, KINDS = range(8)
# States: what the code point just read belongs to. ONE and TWO: a contraction with so many letters to come; DONE: its last letter.
BEGIN, IN_SPACE, IN_GAP, IN_OTHER, IN_NUMBER, IN_LETTER, ONE, TWO, DONE, STATES = range(10)
NO, YES, LAST_OF_GAP = range(3)  # whether a piece begins; the last: if what follows is visible


def step(state: int, kind: int) -> int:
    """The state after a code point of a class."""
    if state in (ONE, TWO):
        return DONE if state == ONE else ONE
    if kind in (QUOTE1, QUOTE2):  # a space or a run of visible code points takes the quote as one more
        return IN_OTHER if state in (IN_SPACE, IN_OTHER) else ONE if kind == QUOTE1 else TWO
    return {SPACE: IN_SPACE, GAP: IN_GAP, OTHER: IN_OTHER, NUMBER: IN_NUMBER, LETTER: IN_LETTER}[kind]


def begins(state: int, kind: int) -> int:
    """Whether a piece begins at a code point, given the state before it."""
    if kind in (SPACE, GAP):
        return LAST_OF_GAP if state in (IN_SPACE, IN_GAP) else YES
    if state in (IN_SPACE, ONE, TWO):
        return NO
    return NO if state == {OTHER: IN_OTHER, QUOTE1: IN_OTHER, QUOTE2: IN_OTHER, NUMBER: IN_NUMBER, LETTER: IN_LETTER}[kind] else YES


def library_kinds(codes: list[int]) -> list[int]:
    """LETTER, NUMBER or OTHER as the rank library's pattern has it: does a code point stay in one piece with a letter or a number?
    The ranks join either with the first byte of any code point beyond ASCII, if they are in one piece."""
    joined = [bytes([before, b]) for before in b"a1" for b in range(0x80, 0x100)]
    ranks = {bytes([b]): b for b in range(256)} | {pair: 256 + k for k, pair in enumerate(joined)}
    library = tiktoken.Encoding("kinds", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    with_letter, with_number = ([ids[0] > 255 for ids in map(library.encode_ordinary, [before + chr(c) for c in codes])] for before in "a1")
    return [LETTER if one else NUMBER if other else OTHER for one, other in zip(with_letter, with_number)]


class Automaton:
    """Actions of the classes on states, numbered with all their products; 0 is the identity."""

    def __init__(self):
        self.kinds = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, range(0x110000)))
        for kind, runs in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(runs, every):
                self.kinds[m.start() : m.end()] = kind
        # where Python's tables, of another year, say otherwise, the library itself is asked
        own = np.array([{"L": LETTER, "N": NUMBER}.get(category(c)[0], OTHER) for c in every], np.uint8)
        differ = np.flatnonzero(self.kinds != own)
        self.kinds[differ] = library_kinds(differ.tolist())
        self.kinds[list(WHITE)] = GAP
        self.kinds[0x20] = SPACE
        one = [tuple(step(s, kind) for s in range(STATES)) for kind in range(KINDS)]
        reset = (BEGIN,) * STATES  # a text's first code point acts after this
        actions = [tuple(range(STATES)), *dict.fromkeys([*one, reset])]
        number = {a: i for i, a in enumerate(actions)}
        for a in actions:  # grows until it is closed
            for b in (*one, reset):
                ab = tuple(b[s] for s in a)
                if ab not in number:
                    number[ab] = len(actions)
                    actions.append(ab)
        m = len(actions)
        self.size = m
        self.act = np.array(actions, np.uint8)
        self.product = np.array([[number[tuple(b[s] for s in a)] for b in actions] for a in actions], np.uint16).ravel()
        self.of_kind = np.array([number[a] for a in one], np.uint16)
        self.after_reset = self.product.reshape(m, m)[number[reset]][self.of_kind]
        self.begins = np.array([[begins(s, kind) for kind in range(KINDS)] for s in range(STATES)], np.uint8).ravel()

    def _times(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.product[a.astype(np.int32) * self.size + b]

    def scan(self, actions: np.ndarray) -> np.ndarray:
        """The product of all actions up to each place."""
        n = len(actions)
        if n <= 1:
            return actions
        rows = -(-n // BLOCK)
        grid = np.zeros(rows * BLOCK, np.uint16)
        grid[:n] = actions
        grid = grid.reshape(rows, BLOCK).T.copy()
        for k in range(1, BLOCK):
            grid[k] = self._times(grid[k - 1], grid[k])
        if rows > 1:
            before = self.scan(grid[-1])[:-1]
            grid[:, 1:] = self._times(before[None, :], grid[:, 1:])
        return grid.T.reshape(-1)[:n]

    def pieces(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Places of the code points where pieces begin. ``first``: where the texts begin, all that are not empty."""
        kinds = self.kinds[codes]
        last = np.append(first[1:], len(codes))  # past the text's last
        q = np.flatnonzero(codes == 0x27)
        end = last[np.searchsorted(first, q, "right") - 1]
        one, two = (np.where(q + k < end, codes[np.minimum(q + k, len(codes) - 1)], 0) for k in (1, 2))
        for letters in CONTRACTIONS:
            fits = (one == ord(letters[0])) & (two == ord(letters[1]) if len(letters) > 1 else True)
            kinds[q[fits]] = QUOTE1 if len(letters) == 1 else QUOTE2
        actions = self.of_kind[kinds]
        actions[first] = self.after_reset[kinds[first]]
        after = self.act[self.scan(actions), BEGIN]
        before = np.empty_like(after)
        before[1:] = after[:-1]
        before[first] = BEGIN
        how = self.begins[before.astype(np.int32) * KINDS + kinds]
        seen = np.empty(len(kinds), bool)  # something visible comes next
        seen[:-1] = kinds[1:] > GAP
        seen[last - 1] = False
        return np.flatnonzero((how == YES) | ((how == LAST_OF_GAP) & seen))


NEVER = np.int32(2**31 - 1)  # no rank


class Merger:
    """Pair merging of many short pieces at a time: in each round every piece joins its neighbours of least rank, the leftmost of equals.

    A rank file's ids are its ranks, so the least rank of a row is also the id of what its pair becomes.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.base = max(ranks.values()) + 1
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[t[:i]] * self.base + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys = np.array(pairs or [(-1, NEVER)], np.int64)
        keys = keys[np.argsort(keys[:, 0])]
        self.keys, self.joined = keys[:, 0].copy(), keys[:, 1].astype(np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.joined[at], NEVER)

    def merge(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """Ids of pieces of at most ``width`` bytes."""
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < size[:, None], self.byte[raw], -1)
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        out: list[list[int]] = [[] for _ in pieces]
        row, column = np.arange(len(pieces)), np.arange(width)
        while len(row):
            at = ranks.argmin(1)
            least = ranks[np.arange(len(row)), at]
            ready = least == NEVER
            if ready.any():
                for k, got in zip(row[ready].tolist(), ids[ready].tolist()):
                    out[k] = [x for x in got if x >= 0]
                row, ids, ranks, at, least = (x[~ready] for x in (row, ids, ranks, at, least))
            behind = np.minimum(column + (column > at[:, None]), width - 1)
            every = np.arange(len(row))
            ids = np.take_along_axis(ids, behind, 1)
            ids[:, -1] = -1
            ids[every, at] = least
            ranks = np.take_along_axis(ranks, np.minimum(behind[:, :-1], width - 2), 1)
            ranks[:, -1] = NEVER
            for left in (at - 1, at):
                has = (left >= 0) & (left < width - 1)
                ranks[every[has], left[has]] = self.rank(ids[every[has], left[has]], ids[every[has], left[has] + 1])
        return out


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece of any length, with a heap of neighbours and a linked list of parts."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins here; 0 for none
    back = list(range(-1, n - 1))
    heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j == n or end[j] != stop:
            continue  # one of the two has grown or gone
        end[i], end[j] = stop, 0
        if stop < n:
            back[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := back[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Decoded(dict):
    """Bytes of ids that are joined by spaces; those of the pieces that the codec keeps are kept too."""

    def __init__(self, token: dict[int, bytes]):
        self.token = token

    def __missing__(self, ids: str) -> bytes:
        return b"".join([self.token[int(i)] for i in ids.split()])


class Codec(dict):
    """Pieces already merged: their ids, joined by spaces."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.text = {rank: str(rank) for rank in self.token}
        self.automaton = Automaton()
        self.merger = Merger(self.ranks)
        self.decoded = Decoded(self.token)

    def __missing__(self, piece: bytes) -> str:
        """Of a piece that is too long to keep."""
        return " ".join([self.text[i] for i in merge_long(piece, self.ranks)])

    def learn(self, pieces: set[bytes]) -> None:
        """Merge new pieces, those of like lengths together."""
        todo: list[list[bytes]] = [[] for _ in WIDTHS]
        for p in pieces:
            if p in self.ranks:
                self._keep(p, [self.ranks[p]])
            elif len(p) <= WIDTHS[-1]:
                todo[bisect_left(WIDTHS, len(p))].append(p)
            elif len(p) <= CACHE_PIECE_BYTES:
                self._keep(p, merge_long(p, self.ranks))
        for width, some in zip(WIDTHS, todo):
            for k in range(0, len(some), 10_000):
                for p, ids in zip(some[k : k + 10_000], self.merger.merge(some[k : k + 10_000], width)):
                    self._keep(p, ids)

    def _keep(self, piece: bytes, ids: list[int]) -> None:
        joined = " ".join([self.text[i] for i in ids])
        self[piece] = joined
        self.decoded[joined] = b"".join([self.token[i] for i in ids])

    def encode(self, column: pa.Array) -> Iterator[tuple[str, list[str], np.ndarray]]:
        """For each text: ids joined by spaces, ids by piece, and the bytes where its pieces begin."""
        data, offsets = K.text_buffers(column)
        for i, j in K.slices(offsets):
            if len(self) > CACHE_PIECES:
                self.clear()
                self.decoded.clear()
            lo = int(offsets[i])
            raw = data[lo : int(offsets[j])]
            at = offsets[i : j + 1] - lo
            buffer = raw.tobytes()
            lead = np.flatnonzero((raw & 0xC0) != 0x80)  # the byte where each code point begins
            codes = np.frombuffer(buffer.decode().encode("utf-32-le"), np.uint32)
            cuts = np.zeros(0, np.int64)
            if len(codes):
                cuts = lead[self.automaton.pieces(codes, np.searchsorted(lead, np.unique(at[:-1][at[:-1] < at[1:]])))]
            bounds = [*cuts.tolist(), len(buffer)]
            pieces = [buffer[a:b] for a, b in zip(bounds, bounds[1:])]
            self.learn(set(pieces).difference(self))
            pieces = list(map(self.__getitem__, pieces))
            span = np.searchsorted(cuts, at).tolist()
            for k, (a, b) in enumerate(zip(span, span[1:])):
                own = pieces[a:b]
                yield " ".join(own), own, cuts[a:b] - at[k]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def decode_ids(path: str, ids: list[int]) -> bytes:
    token = codec(path).token
    return b"".join([token[i] for i in ids])


def encode_documents(docs: DataFrame, path: str, pattern: str = PATTERN, keep_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with ``keep_text`` also ids (array<int>), piece_starts (array<int>,
    the pieces' first bytes) and decoded (binary)."""
    if pattern != PATTERN:
        raise ValueError("the automaton reads by another pattern")
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    if keep_text:
        schema += ", ids array<int>, piece_starts array<int>, decoded binary"
        names += ["ids", "piece_starts", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            n, ids_hash, text_hash, kept = [], [], [], [[], [], []]
            for ids, pieces, starts in c.encode(batch.column(1)):
                decoded = b"".join(map(c.decoded.__getitem__, pieces))
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_hash.append(hashlib.sha256(ids.encode()).hexdigest())
                text_hash.append(hashlib.sha256(decoded).hexdigest())
                if keep_text:
                    for to, value in zip(kept, ([int(x) for x in ids.split()], starts.tolist(), decoded)):
                        to.append(value)
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            if keep_text:
                arrays += [pa.array(kept[0], pa.list_(pa.int32())), pa.array(kept[1], pa.list_(pa.int32())), pa.array(kept[2], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
