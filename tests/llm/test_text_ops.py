"""Operators on texts against brute force."""

import hashlib
import math
import re
from collections import Counter

import pytest
from loomwell.llm import bpe, decontaminate, katz, langid, ngram_join
from loomwell.llm.queries import vocabulary
from pyspark.sql import functions as F

from .conftest import crc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def test_ngram_join(docs, corpus):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect())
    assert got == brute_components([r[:2] for r in corpus])


def test_ngram_join_in_small_buffers(docs, corpus, monkeypatch):
    # many fragments and buffers: what a large table has
    monkeypatch.setattr(ngram_join, "FRAGMENT_TOKENS", 300)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs.repartition(7), percent=80).collect())
    assert got == brute_components([r[:2] for r in corpus])


def test_ngram_join_with_equal_set_hashes(docs, corpus, monkeypatch):
    """Sets whose first hashes are equal are told apart by the second."""
    monkeypatch.setattr(ngram_join, "CLASS_BITS", 4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect())
    assert got == brute_components([r[:2] for r in corpus])


def boilerplate(n, seed=1):
    """Documents of lines that many share, with near copies among them."""
    import random

    rng = random.Random(seed)
    lines = [" ".join(f"l{k}w{j}" for j in range(rng.randint(8, 16))) for k in range(40)]
    rows = []
    for i in range(n):
        own = " ".join(f"d{i if i % 5 else i // 10}x{j}" for j in range(rng.randint(0, 6)))
        rows.append((i, " ".join(rng.sample(lines, rng.randint(3, 9)) + [own])))
    return rows


@pytest.mark.parametrize("block", [4096, 16])
def test_ngram_join_of_boilerplate(spark, monkeypatch, block):
    """Large buckets of unlike documents, in one block and in many, equal brute force."""
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", block)
    rows = boilerplate(300)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect())
    assert got == brute_components(rows)


def test_bucket_pairs_lose_no_link():
    import numpy as np

    rows = boilerplate(150, seed=5) + [(k, f"w{k} " * 3 + " ".join(f"t{j}" for j in range(400 + k))) for k in range(6)]
    sets = [shingle_set(t) for _, t in rows]
    w = ngram_join.K.words_of(*ngram_join.K.text_buffers(ngram_join.pa.array([t for _, t in rows])))
    doc, key, n = ngram_join._sets(w)
    bits = ngram_join._bitmaps(doc, key, n).to_pylist()
    assert len({len(b) for b in bits}) > 1
    found = ngram_join.bucket_pairs(80, n, np.zeros(len(n), int), np.arange(len(n)), bits, np.arange(len(n)), None)
    got = {tuple(sorted(x)) for i, j in found for x in zip(i.tolist(), j.tolist())}
    links = {(j, i) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert links <= got and len(got) < 0.2 * len(rows) ** 2 / 2


def test_one_of_each_component_stays(spark, corpus):
    """Repeated rows, rows without doc_id, and a doc_id of several texts; all columns are kept."""
    rows = [(d, t, f"c{k}") for k, (d, t, *_) in enumerate(corpus)] + [(d, t, "again") for d, t, *_ in corpus[:20]]
    rows += [(None, corpus[0][1], "null copy"), (None, "only a null id has these words", "n1"), (None, "only a null id has these words", "n2"), (5, "another text of document five here", "five"), (None, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    kept = ngram_join.keep_one_of_each(df).collect()
    sets = [shingle_set(t) for _, t, _ in rows]
    where = {}
    for i, _, c in brute_components_by_row([(d, t) for d, t, _ in rows]):
        where.setdefault(c, []).append(i)
    place = {n: i for i, (_, _, n) in enumerate(rows) if n != "again"}
    got = Counter()
    for r in kept:
        i = place[r.n] if r.n != "again" else next(k for k, x in enumerate(rows) if x == tuple(r))
        assert rows[i] == tuple(r)
        got[next(c for c, x in where.items() if i in x)] += 1
    for c, x in where.items():
        assert got[c] == (1 if sets[x[0]] else len(x))
        if sets[x[0]]:
            least = min((rows[i][0] for i in x if rows[i][0] is not None), default=None)
            assert [r.doc_id for r in kept if tuple(r) in {rows[i] for i in x}] == [least]


def brute_components_by_row(rows):
    """(row, its set, a name of its component) by the rows' places."""
    found = brute_components([(i, t) for i, (_, t) in enumerate(rows)])
    return [(i, n, c) for i, n, c in found]


def test_ngram_join_empty(empty_docs):
    assert ngram_join.jaccard_components(empty_docs).collect() == []


def brute_katz(rows):
    train = [t for d, t in rows if d is not None and crc(d) % 5 != 1]
    tok = lambda t: [*words(t), None]
    uni, big, ctx = Counter(), Counter(), Counter()
    for t in train:
        prev = "<s>"
        for w in tok(t):
            uni[w] += 1
            big[prev, w] += 1
            ctx[prev] += 1
            prev = w
    total = sum(uni.values())
    counts = lambda c: [sum(x == r for x in c.values()) for r in range(7)]
    du, db = katz.good_turing(counts(uni)), katz.good_turing(counts(big))
    disc = lambda d, c: d[c] * c if c <= 5 else c
    freed = 1 - sum(disc(du, c) for c in uni.values()) / total
    p1 = lambda w: disc(du, uni[w]) / total if uni[w] else freed
    follow = {}
    for (u, v), c in big.items():
        follow.setdefault(u, []).append((v, c))
    alpha = {}
    for u, x in follow.items():
        alpha[u] = (1 - sum(disc(db, c) for _, c in x) / (ctx[u] + katz.RESERVE)) / (1 - sum(p1(v) for v, _ in x))

    def p(u, v):
        if big[u, v]:
            return disc(db, big[u, v]) / (ctx[u] + katz.RESERVE)
        return alpha.get(u, 1.0) * p1(v)

    out = []
    for d, t in rows:
        prev, score, base, known = "<s>", 0.0, 0.0, 0
        for w in tok(t):
            score += math.log10(p(prev, w))
            base += math.log10((uni[w] + 0.5) / (total + 0.5 * (len(uni) + 1)))
            known += uni[w] > 0
            prev = w
        out.append((d, d is not None and crc(d) % 5 == 1, len(tok(t)), known, total, base, score))
    # normalised: seen words and the unknown one
    for u in [*list(follow)[:20], "never seen"]:
        assert abs(sum(p(u, v) for v in uni) + p(u, "unknown word") - 1) < 1e-9
    return out


@pytest.mark.parametrize("hot, part_tokens", [(65_536, 6000), (50, 6000), (50, 300)])
def test_katz(docs, corpus, monkeypatch, hot, part_tokens):
    monkeypatch.setattr(katz, "PART_TOKENS", part_tokens)
    monkeypatch.setattr(katz, "MOST_CONTEXTS", 100)
    monkeypatch.setattr(katz, "MOST_TEXTS", 40)
    monkeypatch.setattr(katz, "FLUSH_TOKENS", 4000)
    monkeypatch.setattr(katz, "SUB_TOKENS", 1500)
    monkeypatch.setattr(katz, "HOT_SHARE", hot)
    monkeypatch.setattr(katz, "HOT_WORDS", hot - 1)
    key = lambda r: (r[0], r[2])
    got = sorted((tuple(r) for r in katz.score_documents(docs).collect()), key=key)
    want = sorted(brute_katz([r[:2] for r in corpus]), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_katz_tables_do_not_grow_with_the_parts(spark, tmp_path, monkeypatch):
    """What is written for a token does not depend on the number of parts."""
    import random

    from loomwell.llm.scratch import Scratch

    rng = random.Random(2)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(70))) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    sizes = {}
    for parts in (2, 82):
        monkeypatch.setattr(katz, "PART_TOKENS", 2000 * 71 // parts)
        scratch = Scratch(spark, f"katz{parts}")
        scratch.path = str(tmp_path / str(parts))
        assert katz.score_documents(df, scratch=scratch).count() == len(rows)
        written = spark.read.parquet(f"{scratch.path}/parts").groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("data")).alias("size"))
        sizes[parts] = {r.kind: (r.n, r["size"]) for r in written.collect()}
    tokens = 2000 * 71
    assert sizes[82][4][1] < 1.6 * sizes[2][4][1] < 8 * tokens, sizes  # counts for the buffers, in bytes
    assert sizes[82][0] == sizes[2][0] and sizes[82][1][0] + sizes[82][2][0] < tokens, sizes  # texts; contexts and asks


def test_katz_empty_and_untrained(spark, empty_docs):
    assert katz.score_documents(empty_docs).collect() == []
    rows = katz.score_documents(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in rows] == [(None, 3, 0, 0)]


def test_bpe_equals_library(docs, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, text, *_ in corpus:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert sorted(tuple(r) for r in bpe.encode_documents(docs, vocabulary()).collect()) == sorted(want)


@pytest.mark.parametrize("text", ["<|endoftext|>a<|startoftext|> b", "ΣΑΣ İı ſ É ﬁ", "it's WE'LL 12³ ½ \x1c\x85\xa0　x", "ééé ñandú Œuvre ẞ", "\x00\x07ab€…", "naïve👩‍🚀 日本語テキスト"])
def test_bpe_odd_texts(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    ids = t.encode(text, add_special_tokens=False).ids
    n, joined, decoded = bpe.codec(vocabulary()).encode_text(text)
    assert (n, joined, decoded) == (len(ids), " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))
    assert bpe.decode_ids(vocabulary(), ids) == decoded


def test_bpe_cuts_are_certain():
    c = bpe.codec(vocabulary())
    for word in ("èçàé", "straße", "ñandú", "hello"):
        symbols = "".join(c.symbol[b] for b in word.encode())
        parts = c.fragments(symbols)
        assert "".join(parts) == symbols
        assert [t.id for t in c.ending.tokenize(symbols)] == [t.id for k, p in enumerate(parts) for t in (c.ending if k == len(parts) - 1 else c.inner).tokenize(p)]
    assert any(len(c.fragments("".join(c.symbol[b] for b in w.encode()))) > 1 for w in ("èçàé", "ñçß"))


def test_language_id(spark):
    import random

    rng = random.Random(3)
    sylls = {"en": "the ing and ter ous ly wh".split(), "de": "ung sch ver keit ich ein ß".split(), "fr": "eau oux ment ique é tion".split()}
    make = lambda x, n: " ".join("".join(rng.choice(sylls[x]) for _ in range(3)) for _ in range(n))
    rows = [(i, make(x, rng.randint(3, 80)), x) for i, x in enumerate(rng.choice(list(sylls)) for _ in range(200))]
    rows += [(900, None, "en"), (901, "123 !!", "en"), (902, "", None), (903, make("de", 4000), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict_languages(df).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows[:200] if crc(r[0]) % 4 == 2]
    assert all(got[r[0]].held_out == (crc(r[0]) % 4 == 2) for r in rows)
    assert sum(got[d].lang_pred == x for d, _, x in held) >= 0.97 * len(held)
    assert [got[k].lang_pred for k in (900, 901, 902, 903)] == ["und", "und", "und", "de"]
    assert all(0 <= r.score <= 1 for r in got.values())
    none = langid.predict_languages(df.limit(0)).collect()
    assert none == []


def test_language_id_phrases_are_longest_matches():
    import numpy as np

    al = langid.alphabet_of(["abcab"])
    train, text = langid.symbols(["abcabdabce"], al), langid.symbols(["bcabcabdxabab"], al)
    table = langid.automaton(train, int(al.max()) + 1)
    subs = {bytes(train[i:j]) for i in range(len(train)) for j in range(i + 1, len(train) + 1)}
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and bytes(text[at : end + 1]) in subs and langid.OTHER not in text[at : end + 1]:
            end += 1
        n, at = n + 1, end
    assert langid.phrases(table, text, np.array([0, len(text)])).tolist() == [n]


def brute_phrases(train, text):
    """Phrases that are each the longest match in the training text, or one unknown symbol."""
    joined = "".join(map(chr, train))
    n = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and "".join(map(chr, text[at : end + 1])) in joined and langid.OTHER not in text[at : end + 1]:
            end += 1
        n, at = n + 1, end
    return n


@pytest.mark.parametrize("piece", [1, 2, 7, 256])
def test_language_id_phrases_cross_pieces(monkeypatch, piece):
    """Phrase counts of long texts, short texts and long matches are those of one parse from the text's beginning."""
    import random

    import numpy as np

    monkeypatch.setattr(langid, "PIECE", piece)
    rng = random.Random(piece)
    make = lambda n: "".join(rng.choice("abc  é日") for _ in range(n))
    base = make(1500)
    al = langid.alphabet_of([base])
    train = langid.symbols([base], al)
    table = langid.automaton(train, int(al.max()) + 1)
    texts = [make(11_000), "", base[100:1300], make(300) + base[:900] + "xyx" + make(40), "a", base, "ab" * 400, "xxxx"] + [make(rng.randint(1, 40)) for _ in range(30)]
    codes = [langid.symbols([t], al) for t in texts]
    cuts = np.concatenate(([0], np.cumsum([len(c) for c in codes])))
    assert langid.phrases(table, np.concatenate(codes), cuts).tolist() == [brute_phrases(train.tolist(), c.tolist()) for c in codes]


def test_language_id_repeats_ties_and_long_training_texts(spark):
    """Repeated rows are kept; a tie goes to the first language; a language with only very long texts is learned."""
    rows = [(i, "abc def " * 30, x) for i, x in enumerate(["b", "a"] * 10)] + [(0, "abc def " * 30, "b"), (None, "abc def", "a")]
    rows += [(100 + i, "uvw xyz zyx " * 3000, "long") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict_languages(df, train_chars=2000).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id is None or r.doc_id < 100} == {"a"}
    assert {r.lang_pred for r in got if (r.doc_id or 0) >= 100} == {"long"}


def test_decontamination(spark, corpus):
    base = " ".join(corpus[5][1].split()[:30]) if len(corpus[5][1].split()) >= 30 else "a b c d e f g h i j k l"
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi"), (2, "Red green blue"), (3, None), (4, ""), (5, base)]
    long = items[0][1]
    rows = [
        (10, "x " * 50 + long.upper() + " y" * 30), (11, long.replace("alpha", "changed") + " z"), (12, long.replace("theta", "changed")),
        (13, "so red green\nBLUE it is"), (14, "red green"), (15, None), (16, base), (17, " ".join(long.split()[:8])), (10, "nothing"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(df, bench).collect()}
    assert set(got) == {(10, 1), (11, 1), (13, 2), (16, 5)}
    assert (got[10, 1].start_word, got[10, 1].n_words, got[10, 1].distance, got[10, 1].similarity) == (50, 14, 0, 1.0)
    assert 0.8 <= got[11, 1].similarity < 1
    kept = [r.doc_id for r in decontaminate.remove_leaks(df, bench).collect()]
    assert sorted(kept) == [10, 12, 14, 15, 17]
    assert decontaminate.find_leaks(df.limit(0), bench).collect() == [] and decontaminate.find_leaks(df, bench.limit(0)).collect() == []


def test_decontamination_against_all_windows(spark):
    """Every window of at least 0.8 by exact similarity is found, whatever its fingerprint."""
    import random

    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(400)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(14, 60)))) for i in range(30)]
    rows = []
    for d in range(120):
        w = [rng.choice(vocab) for _ in range(80)]
        item = items[d % 30][1].split()
        for _ in range(d % 4):
            item[rng.choice([0, 1, -1, -2, len(item) // 2])] = "zz"
        at = rng.randint(0, 80)
        rows.append((d, " ".join(w[:at] + item + w[at:])))
    want = set()
    sets = {i: [tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)] for i, t in items}
    df = Counter(s for x in sets.values() for s in set(x))
    weight = lambda s: 1 + math.log(len(items) / df[s]) if s in df else 1 + math.log(len(items))
    for d, t in rows:
        w = t.split()
        for i, x in sets.items():
            n = len(x) + 4
            a = Counter(x)
            for k in range(len(w) - n + 1):
                b = Counter(tuple(w[j : j + 5]) for j in range(k, k + n - 4))
                low = sum(min(a[s], b[s]) * weight(s) for s in a)
                high = sum(max(a[s], b[s]) * weight(s) for s in {*a, *b})
                if low / high >= 0.8 - 1e-12:
                    want.add((d, i))
    got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 40


@pytest.mark.parametrize("n", [9, 14, 60])
def test_decontamination_of_documents_shorter_than_the_item(spark, n):
    """A document that is an item without some of its words leaks it, if the similarity is high enough."""
    items = [(i, " ".join(f"w{i}x{k}" for k in range(n))) for i in range(20)]
    rows = []
    for i, t in items:
        w = t.split()
        rows += [(3 * i, " ".join(w[:-1])), (3 * i + 1, " ".join(w[1:]) + " "), (3 * i + 2, " ".join(w[: n // 2]))]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(df, bench).collect()}
    assert set(got) == {(3 * i + k, i) for i, _ in items for k in (0, 1)}  # all shingles weigh the same: n - 5 of n - 4
    assert all((r.start_word, r.n_words) == (0, n - 1) and abs(r.similarity - (n - 5) / (n - 4)) < 1e-9 for r in got.values())
    assert sorted(r.doc_id for r in decontaminate.remove_leaks(df, bench).collect()) == [3 * i + 2 for i, _ in items]


def test_decontamination_in_groups_equals_one_group(spark):
    """Weights are over all items, however many groups they are dealt to."""
    import random

    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(300)]
    heads = [[rng.choice(vocab) for _ in range(12)] for _ in range(3)]  # passages that many items share
    items = [(i, " ".join(heads[i % 3][: rng.randint(6, 12)] + [rng.choice(vocab) for _ in range(rng.randint(10, 20))])) for i in range(40)]
    rows = []
    for d in range(400):
        w = items[d % 40][1].split()
        n = rng.randint(1, 4)
        at = rng.choice([0, len(w) - n])
        w[at : at + n] = rng.choice(heads)[:n] if d % 2 else ["zz"] * n
        w = w + rng.choice(heads) if d % 3 else w
        rows.append((d, " ".join(w)))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda **x: sorted((r.doc_id, r.item_id, r.start_word, r.distance, round(r.similarity, 9)) for r in decontaminate.find_leaks(df, bench, **x).collect())
    one = found()
    assert found(group_items=10) == one and len(one) > 100
    kept = sorted(r.doc_id for r in decontaminate.remove_leaks(df, bench, group_items=10).collect())
    assert kept == sorted({d for d, _ in rows} - {x[0] for x in one})


def test_ngram_join_over_rows_without_doc_id(spark):
    """Sets that only rows with a null doc_id have link like all others; shifts by 4 of 60 words are near, by 8 are not."""
    text = lambda name, k: " ".join(f"{name}{j}" for j in range(4 * k, 4 * k + 60))
    rows = [(1, text("a", 0)), (None, text("a", 1)), (2, text("a", 2)), (3, text("b", 0)), (5, text("b", 3)), (7, text("c", 0)), (8, text("c", 2))]
    rows += [(None, text("b", k)) for k in (1, 2) for _ in range(40)] + [(None, text("d", 0)), (None, text("d", 1)), (None, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect())
    assert got == Counter(
        {(1, 56, 1): 1, (2, 56, 1): 1, (None, 56, 1): 1, (3, 56, 3): 1, (5, 56, 3): 1, (None, 56, 3): 80, (7, 56, 7): 1, (8, 56, 8): 1, (None, 56, None): 2, (None, 0, None): 2}
    )


def test_language_id_of_many_scripts(spark):
    """Letters that are rare over all languages together, and those beyond the basic plane, still tell languages apart."""
    import random

    rng = random.Random(9)
    blocks = {"la": (97, 26), "ru": (0x430, 32), "hi": (0x905, 50), "ko": (0xAC00, 90), "ja": (0x3042, 80), "zh": (0x4E00, 90), "zz": (0x4E60, 90), "ha": (0x20000, 90), "hb": (0x20100, 90)}
    vocab = {x: ["".join(chr(a + rng.randrange(n)) for _ in range(2)) for _ in range(60)] for x, (a, n) in blocks.items()}
    rows = [(i, " ".join(rng.choice(vocab[x]) for _ in range(400 if x == "la" else 30)), x) for i, x in enumerate(list(blocks) * 30)]
    got = {r.doc_id: r.lang_pred for r in langid.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[d] for d, _, _ in rows] == [x for _, _, x in rows]


def test_language_id_of_many_languages(spark):
    """Every labelled language is learned, rare ones too."""
    import random

    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocab = {f"l{k:02}": ["".join(rng.choice(letters) for _ in range(6)) for _ in range(12)] for k in range(45)}
    rows = [(100 * k + j, " ".join(rng.choice(vocab[x]) for _ in range(40)), x) for k, x in enumerate(vocab) for j in range(8 if k % 3 else 24)]
    got = {r.doc_id: r.lang_pred for r in langid.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[d] for d, _, _ in rows] == [x for _, _, x in rows]


@pytest.mark.parametrize("radius", [0, 3, 11, 19])
def test_block_tables_find_all_within_the_radius(radius):
    import numpy as np

    rng = np.random.default_rng(3)
    items = rng.integers(0, 2**63, 50, dtype=np.uint64)
    items[40:] = items[:10]  # ties
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 24), replace=False)) for _ in range(600)]
    prints = np.array([int(items[k % 50]) ^ f for k, f in enumerate(flips)], np.uint64)
    at, item, distance = decontaminate.BlockTables(items).within(prints, radius)
    every = np.bitwise_count(prints[:, None] ^ items[None, :])
    assert sorted(zip(at.tolist(), item.tolist())) == [tuple(x) for x in np.argwhere(every <= radius).tolist()]
    assert (every[at, item] == distance).all()


def test_decontamination_recall_with_hot_shingles(spark):
    """Of what an exact comparison of all windows finds on passages that many items and documents share, at least 0.9 is found."""
    import random

    rng = random.Random(21)
    vocab = [f"w{k}" for k in range(500)]
    hot = [[rng.choice(vocab) for _ in range(10)] for _ in range(4)]
    items = [(i, " ".join([*hot[i % 4], *(rng.choice(vocab) for _ in range(rng.randint(8, 30)))])) for i in range(40)]
    rows = []
    for d in range(300):
        w = items[d % 40][1].split()
        for _ in range(rng.randint(0, 2)):
            w[rng.choice([0, 1, 2, -1, -2, -3])] = "zz"
        rows.append((d, " ".join([*(rng.choice(vocab) for _ in range(rng.randint(0, 30))), *w, *rng.choice(hot), *(rng.choice(vocab) for _ in range(rng.randint(0, 30)))])))
    grams = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    sets = {i: Counter(grams(t.split())) for i, t in items}
    df = Counter(s for x in sets.values() for s in x)
    weight = lambda s: 1 + math.log(len(items) / df[s]) if s in df else 1 + math.log(len(items) / min(df.values()))
    want = set()
    for d, t in rows:
        w = t.split()
        for i, a in sets.items():
            n = sum(a.values()) + 4
            for k in range(len(w) - n + 1):
                b = Counter(grams(w[k : k + n]))
                low = sum(min(a[s], b[s]) * weight(s) for s in a)
                if low / (sum(a[s] * weight(s) for s in a) + sum(b[s] * weight(s) for s in b) - low) >= 0.8 - 1e-12:
                    want.add((d, i))
                    break
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 150
