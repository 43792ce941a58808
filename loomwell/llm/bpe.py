"""BPE encoding and decoding with forced-boundary splitting.

A merge can only ever produce vocabulary tokens. So where two neighbouring byte symbols occur together inside no token,
every encoding has a cut: the fragments between such cuts are encoded independently and concatenated. Fragments (and the
words made of them) repeat, so each distinct one is merged once per task and looked up afterwards.

The pipeline of the vocabulary file is followed exactly: special tokens are split off the raw text; the rest is put into
NFC, runs of white space become one space, and letters are lower-cased one by one; words are cut by the file's pattern,
turned into byte symbols, and merged with an end-of-word suffix, which only a word's last fragment gets. Texts with
characters beyond Latin are normalised by the tokenizers library itself, since case and composition tables could differ.

Edge cases: a null text is empty (no tokens, empty decoding); a null doc_id is passed through like all others, unchanged; empty
tables give no rows; repeated rows are kept; other columns are ignored, whatever their names. Very long texts are encoded
whole, one at a time. A task keeps at most ``CACHE_WORDS`` words.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import concat

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm.scratch import small_batches

CACHE_WORDS = 300_000
#: Texts with other characters go through the library's own normaliser.
BEYOND = regex.compile(r"[^\x00-ɏ‐-‧€]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 bytes for themselves, others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class Codec:
    """Encoder and decoder of one vocabulary file of the ``tokenizers`` library (BPE with a word-end suffix)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ending = BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.suffix)
        self.inner = BPE(vocab=model["vocab"], merges=merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        self.hint = os.path.commonprefix(list(self.special)) or ""
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", r"\x09-\x0D\x20\x85\xA0  -     　"))
        self.symbol = byte_symbols()
        self.joined: set[str] = set()  # pairs of symbols that stand together inside some token
        for token in model["vocab"]:
            body = token.removesuffix(self.suffix) if self.suffix else token
            self.joined.update(body[i : i + 2] for i in range(len(body) - 1))
        self.ids: dict[str, str] = {}  # of each word seen: its ids, and its tokens, joined by spaces
        self.tokens: dict[str, str] = {}
        self.parts: dict[tuple[str, bool], tuple[str, str]] = {}

    def fragments(self, symbols: str) -> list[str]:
        """Cut a word between symbols that no token holds together."""
        if self.joined.issuperset(map(concat, symbols, symbols[1:])):
            return [symbols]
        cuts = [0, *(i + 1 for i in range(len(symbols) - 1) if symbols[i : i + 2] not in self.joined), len(symbols)]
        return [symbols[a:b] for a, b in zip(cuts, cuts[1:])]

    def _part(self, part: str, last: bool) -> tuple[str, str]:
        got = (self.ending if last else self.inner).tokenize(part)
        return " ".join([str(t.id) for t in got]), " ".join([t.value for t in got])

    def _learn(self, word: str) -> None:
        plain = word.isascii() and word.isalpha()
        cut = self.fragments(word if plain else "".join([self.symbol[b] for b in word.encode("utf-8")]))
        if len(cut) == 1:
            self.ids[word], self.tokens[word] = self._part(cut[0], True)
            return
        out = []
        for k, part in enumerate(cut):
            key = (part, k == len(cut) - 1)
            if key not in self.parts:
                if len(self.parts) >= CACHE_WORDS:
                    self.parts.clear()
                self.parts[key] = self._part(*key)
            out.append(self.parts[key])
        self.ids[word], self.tokens[word] = (" ".join(x) for x in zip(*out))

    def words_of(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens. White space only ever separates, so it needs no replacing."""
        if text.isascii():
            return self.words.findall(text.lower())
        if BEYOND.search(text):
            return self.words.findall(self.library.normalizer.normalize_str(text))
        return self.words.findall(unicodedata.normalize("NFC", text).lower())

    def encode_text(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens, ids joined by spaces, decoded text."""
        ids, decoded = [], []
        known = self.ids
        for piece in self.specials.split(text) if text and self.special and self.hint in text else [text or ""]:
            if piece in self.special:
                ids.append(str(self.special[piece]))
                decoded.append(piece)
            elif piece:
                words = self.words_of(piece)
                if len(known) > CACHE_WORDS:
                    known.clear()
                    self.tokens.clear()
                for word in set(words).difference(known):
                    self._learn(word)
                ids += map(known.__getitem__, words)
                decoded += map(self.tokens.__getitem__, words)
        joined = " ".join(ids)
        return joined.count(" ") + 1 if joined else 0, joined, " ".join(decoded)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def decode_ids(path: str, ids: Iterable[int]) -> str:
    """The library's decode(ids, skip_special_tokens=False) for files without a decoder: tokens joined by spaces."""
    c = codec(path)
    return " ".join(t for t in (c.library.id_to_token(i) for i in ids) if t is not None)


def encode_documents(docs: DataFrame, path: str, keep_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with ``keep_text`` also ids (array<int>) and decoded."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_text:
        schema += ", ids array<int>, decoded string"

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            n, ids_hash, text_hash, kept_ids, kept_text = [], [], [], [], []
            for text in batch.column(1):
                k, ids, decoded = c.encode_text(text.as_py())
                n.append(k)
                ids_hash.append(hashlib.sha256(ids.encode()).hexdigest())
                text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_text:
                    kept_ids.append([int(i) for i in ids.split()])
                    kept_text.append(decoded)
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            if keep_text:
                arrays += [pa.array(kept_ids, pa.list_(pa.int32())), pa.array(kept_text, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
