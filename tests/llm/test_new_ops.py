"""Importance resampling, spelling variants and byte-level BPE against brute force and the library; ids beside nulls; swaps and bad pages."""

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from loomwell.llm import bpe, byte_bpe, html_text, importance, langid, spelling, toxicity
from loomwell.llm.queries import byte_ranks, vocabulary

from .conftest import DOC_SCHEMA

BIG = 2**53 + 1


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# ---- importance resampling ----

def brute_resample(rows, target, buckets, longest, min_words, percent, seed):
    def feats(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
        return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, feats(text)[1]))
    for text in target:
        t.update(map(bucket, feats(text)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out, able = [], []
    for k, (doc, text) in enumerate(rows):
        w, f = feats(text)
        weight = sum(map(gain, map(bucket, f))) // len(f) if f else 0
        score = None
        if doc is not None:
            h = int(hashlib.sha256(f"{seed}:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(w) >= min_words:
                able.append((-score, doc, len(f), weight, k))
        out.append([doc, len(f), weight, score, None])
    for rank, x in enumerate(sorted(able)[: percent * len(able) // 100], 1):
        out[x[-1]][-1] = rank
    return Counter(map(tuple, out))


@pytest.mark.parametrize("longest,buckets,percent", [(1, 10_000, 10), (3, 97, 40)])
def test_resampling_equals_brute_force(spark, corpus, longest, buckets, percent):
    target = ["der die und 7x the of", None, "", corpus[5][1], "Straße ÉTÉ 日本"]
    rows = [r[:2] for r in corpus] + [(None, corpus[0][1]), (7, "Ab\x00cD é" * 30 + "x" * 500), (BIG, "w " * 25)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, score string").repartition(5)
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(docs, goal, buckets=buckets, longest=longest, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == brute_resample(rows, target, buckets, longest, 20, percent, 2024)


def test_resampling_of_empty_tables(spark, docs, empty_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(empty_docs, none).collect() == []
    assert importance.resample(docs, none).count() == docs.count()


def test_crcs_of_long_and_joined_words():
    texts = ["a" * 1000, "b", "", "c d", None, "é" * 70, "x"]
    found = {}
    for i, per_text, text, crc in importance.features(pa.array(texts), 1):
        for d, c in zip(text.tolist(), crc.tolist()):
            found.setdefault(i + d, []).append(c)
    assert found == {k: [zlib.crc32(w.encode()) for w in (t or "").split()] for k, t in enumerate(texts) if t}


# ---- spelling variants ----

def brute_variants(rows, min_length=7, min_count=2, factor=10, every=31):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", lower(text)):
            h = zlib.crc32(f"{doc}:{run}".encode()) if doc is not None else 1
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= min_length:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, n_near = {}, {}
    for w in n:
        others = [x for x in n if x != w and near(w, x)]
        n_near[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], n_near[w], n.get(form[w])))
    return sorted(out)


def variants():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcéß") for _ in range(rng.randint(6, 10))) for _ in range(60)]
    rows = []
    for i in range(150):
        text = []
        for _ in range(60):
            w = rng.choice(words[: 1 + rng.randint(0, 59)])
            if rng.random() < 0.15:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcéß") + w[k:], w[:k] + rng.choice("abcéß") + w[k + 1 :]])
            text.append(rng.choice([w, w.upper(), w.title()]))
        rows.append((i, " ".join(text) + rng.choice(["", "! 12x", "÷×"])))
    return rows + [(None, rows[0][1]), (3, rows[3][1]), (500, None), (501, ""), (502, "aabbaabb " * 3000)]


def test_variants_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BUFFER_WORDS", 50)
    rows = variants()
    docs = spark.createDataFrame([(d, t, 1, "w") for d, t in rows], "doc_id long, text string, n int, word string").repartition(4)
    got = spelling.group_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_variants(rows)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want
    assert any(r[1] and r[2] != r[1] for r in want) or any(r[1] for r in want)


def test_chains_of_forms_are_followed(spark, tmp_path):
    chain = [("aaaaaaa", 2), ("aaaaaab", 20), ("aaaaabb", 200), ("aaaabbb", 2000), ("aaabbbb", 20000)]
    rows = [(None, " ".join([w] * n)) for w, n in chain]
    got = {r.word: (r.form, r.root) for r in spelling.group_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got["aaaaaaa"] == ("aaaaaab", "aaabbbb") and got["aaabbbb"] == (None, "aaabbbb")


def test_variants_of_empty_tables(empty_docs):
    assert spelling.group_variants(empty_docs).collect() == []


# ---- byte-level BPE ----

@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_ranks(), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(3)
    alphabet = [*"aestdmrlvLSK'''   \n\t.!,19éß日本²ٳ́  　\x1c\x85", "😀", "\r\n", "'ll", "'re", "'VE", "’s", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    return texts + ["", None, "a" * 5000, " " * 3000, " " * 10 + "x", "'", "'s", "it's 'tis don'ts", "\n\n a", "ab" * 4000, "x" * 201, "Ünïcödé" * 40]


def test_encoding_equals_the_library(spark, library):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: r for r in byte_bpe.encode_documents(docs, byte_ranks(), public_tokenizers.PATTERN, keep_text=True).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = library.encode_ordinary(t or "")
        assert got[i].ids == want, repr(t)
        assert got[i].n_tokens == len(want) and bytes(got[i].decoded) == (t or "").encode() == byte_bpe.decode_ids(byte_ranks(), want)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert got[i].piece_starts == sorted(set(got[i].piece_starts)) and (not t or got[i].piece_starts[0] == 0)


def test_digest_query_and_edges(spark, docs, corpus, empty_docs, library):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in byte_bpe.encode_documents(docs, byte_ranks()).collect())
    ids = [library.encode_ordinary(t or "") for _, t, *_ in corpus]
    assert got == Counter((r[0], len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for r, x in zip(corpus, ids))
    assert byte_bpe.encode_documents(empty_docs, byte_ranks()).collect() == []
    with pytest.raises(ValueError):
        byte_bpe.encode_documents(docs, byte_ranks(), pattern=r"\w+")


def test_classes_equal_the_library_for_all_code_points():
    automaton = byte_bpe.codec(byte_ranks()).automaton
    pairs = [bytes([lead, b]) for lead in b"a1!" for b in range(0x80, 0x100)]
    probe = tiktoken.Encoding("p", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes([b]): b for b in range(256)} | {p: 256 + k for k, p in enumerate(pairs)}, special_tokens={})
    kinds = (("a", byte_bpe.LETTER), ("1", byte_bpe.NUMBER), ("!", byte_bpe.OTHER))
    for c in [*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0x2F000, 0x34000), *range(0xE0000, 0xE0200)]:
        kind = next((k for lead, k in kinds if probe.encode_ordinary(lead + chr(c))[0] >= 256), byte_bpe.GAP)
        assert automaton.kinds[c] == kind, hex(c)


def test_scan_is_associative():
    automaton = byte_bpe.codec(byte_ranks()).automaton
    rng = np.random.default_rng(1)
    actions = rng.integers(0, automaton.size, 5000).astype(np.uint16)
    scanned = automaton.scan(actions)
    now = 0
    for k, a in enumerate(actions.tolist()):
        now = int(automaton.product[now * automaton.size + a])
        assert scanned[k] == now


def test_merging_ways_agree(library):
    c = byte_bpe.codec(byte_ranks())
    rng = random.Random(5)
    pieces = [bytes(rng.choice(b"aabcdeth rs\xc3\xa9") for _ in range(rng.randint(1, 32))) for _ in range(500)]
    assert c.merger.merge(pieces, 32) == [byte_bpe.merge_long(p, c.ranks) for p in pieces]


# ---- ids beside nulls ----

def test_large_ids_beside_nulls_stay(spark):
    rows = [(BIG, "the first text of all", "en", "s", 1), (None, "a second text", "en", "s", 1), (-BIG, None, "de", "s", 1)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).coalesce(1)
    want = {BIG, None, -BIG}
    assert {r.doc_id for r in bpe.encode_documents(docs, vocabulary()).collect()} == want
    assert {r.doc_id for r in byte_bpe.encode_documents(docs, byte_ranks()).collect()} == want
    assert {r.doc_id for r in langid.predict_languages(docs).collect()} == want
    pages = spark.createDataFrame([(BIG, "u", "<p>a b c</p>"), (None, None, None)], "page_id long, url string, html string").coalesce(1)
    assert {(r.page_id, r.url) for r in html_text.extract_pages(pages).collect()} == {(BIG, "u"), (None, None)}


# ---- identity terms and bad pages ----

def test_swaps_stay_in_their_language_and_number():
    seen = Counter(t for g in toxicity.identity_groups() for t in g)
    assert max(seen.values()) == 1, "a term of two groups has no one language"
    of = {t: lang for lang, groups in toxicity.IDENTITY_TERMS.items() for g in groups for t in g}
    swap = toxicity.swapper()
    for term, lang in of.items():
        assert of[swap(term)] == lang and swap(term) != term
    assert swap("Die Männer und los hombres, les femmes") == "Die Frauen und los mujeres, les hommes"


def test_ill_formed_pages_take_linear_time():
    w = html_text.Weights()
    for page in ("<div>" * 4000 + "</b>" * 40_000, "<svg>" * 40_000 + "x", "<select>" * 40_000, "<p>" * 40_000 + "</div>" * 40_000):
        began = time.process_time()
        html_text.extract(page, w)
        assert time.process_time() - began < 8


def test_pairing_lowers_the_gap_between_groups_and_false_positives(spark):
    """Half of the toxic texts hold no harsh word, and toxic texts mention one group more often: without pairing the mention itself is learned."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 3 == 0
        group = "muslim" if rng.random() < (0.9 if toxic else 0.25) else "jewish"
        text = [rng.choice(words) for _ in range(12)] + [group] + (["nasty"] if toxic and i % 2 else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    bases = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(100)]
    probe = pa.array([f"{base} {g}" for base in bases for g in ("muslim", "jewish")])
    neutral = pa.array([t for (i, t), (_, y) in zip(rows, labels) if zlib.crc32(str(i).encode()) % 5 == 0 and not y and "muslim" in t])
    gaps, wrong = [], []
    for pairing in (0.0, 3.0):
        model = toxicity.train(docs, marks, pairing=pairing)
        s = np.clip(toxicity.score_texts(model, probe), 1e-9, 1 - 1e-9)
        logit = np.log(s / (1 - s))
        gaps.append(float(np.abs(logit[0::2] - logit[1::2]).mean()))
        wrong.append(int((toxicity.score_texts(model, neutral) >= 0.5).sum()))
    assert gaps[1] < 0.5 * gaps[0], gaps
    assert wrong[1] < wrong[0], wrong
