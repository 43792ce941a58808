"""Search, sharding, classifiers, pages and the pipeline."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from loomwell.llm import features, html_text, katz, queries, quality, shard, topk, toxicity
from loomwell.llm import kernel as K
from pyspark.sql import functions as F

from .conftest import WORDS, crc


def brute_top(rows, k, step=20):
    """As the oracle has it: each row is a candidate, and the queries of one id share a ranking."""
    usable = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if not (i is None or v is None or any(x is None or not math.isfinite(x) for x in v))]
    scores = {}
    for i, q in usable:
        if i % step == 0:
            scores.setdefault(i, []).extend((-sum(a * b for a, b in zip(q, w)), j) for j, w in usable if j != i and len(w) == len(q))
    return sorted((i, r + 1, j, -x) for i, s in scores.items() for r, (x, j) in enumerate(sorted(s)[:k]))


@pytest.mark.parametrize("scale", [1.0, 1e3, 5e6])
def test_top_k(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "SUPER", 100)
    monkeypatch.setattr(topk, "SAMPLE", 60)
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [scale * (c + rng.gauss(0, 0.1)) for c in centres[i % 6]]) for i in range(400)]
    rows += [(400 + i, rows[40][1]) for i in range(60)]  # ties
    rows += [(500, None), (501, [1.0, None] + [0.0] * 6), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (504, [1.0]), (None, rows[0][1]), (20, rows[21][1]), (21, rows[21][1]), (40, rows[40][1])]
    rows += [(600 + 5 * i, [scale * rng.gauss(0, 1) for _ in range(3)]) for i in range(30)] + [(700, []), (720, []), (705, [])]  # other lengths
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("id") % 20 == 0, k=20, query_block=7).collect())
    assert got == brute_top(rows, 20)
    few = topk.top_k(df.filter("vec_id < 5"), F.col("id") % 20 == 0, k=20).collect()
    assert len(few) == 4
    assert topk.top_k(df.limit(0), F.col("id") % 20 == 0).collect() == []


def test_blocks_are_pruned_on_clustered_vectors():
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (40, 16))
    v = np.repeat(centres, topk.BLOCK, 0) + rng.integers(-2, 3, (40 * topk.BLOCK, 16))
    q = v[:: topk.BLOCK]
    best = topk.Best(np.full(len(q), -(2**60)), 20)
    visits = topk.search_blocks(q, np.arange(0, len(v), topk.BLOCK), v, np.arange(len(v)), best)
    assert visits < 0.35 * len(q) * 40


def test_main_directions_tighten_the_bounds():
    """Vectors near a few directions that no axis shows: the second bound prunes where term maxima alone do not."""
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.normal(size=(32, 32)))[0][:2]
    angle = np.sort(rng.uniform(0, 2 * np.pi, 40 * topk.BLOCK))
    v = np.floor(300 * np.stack([np.cos(angle), np.sin(angle)], 1) @ turn + rng.normal(0, 6, (len(angle), 32))).astype(np.int64)
    q = v[:: topk.BLOCK]
    ids = np.arange(len(v))
    visits, found = [], []
    for basis in (None, topk.main_directions(v[::10])):
        best = topk.Best(np.full(len(q), -(2**60)), 20)
        visits.append(topk.search_blocks(q, ids[:: topk.BLOCK], v, ids, best, basis))
        found.append(best.held)
    assert visits[1] < 0.7 * visits[0] and all((a == b).all() for a, b in zip(*found))


def shards_of(df):
    rows = df.collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    return rows, by


def test_sharding(spark, docs, corpus):
    rows, by = shards_of(shard.shard_documents(docs, shards=4, tolerance=0.02))
    assert len(rows) == len(corpus)
    want = sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in corpus)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    for s, x in by.items():
        assert sorted(r.slot for r in x) == list(range(len(x)))
    small = [r for r in corpus if len(r[1] or "") < 5000]
    rows, by = shards_of(shard.shard_documents(spark.createDataFrame(small, docs.schema), shards=4))
    sizes = [sum(r["size"] for r in by[s]) for s in range(4)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)
    assert all(r.law == "bytes" and r.grown_shard is None for r in rows)


def test_sharding_hot_text_and_slots(spark):
    rows = [(i, "hot text") for i in range(900)] + [(1000 + i, f"text {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, by = shards_of(shard.shard_documents(df, shards=16, rows_per_cell=20))
    sizes = [sum(r["size"] for r in by[s]) for s in range(16)]
    assert max(sizes) <= 1.03 * sum(sizes) / 16 + 18
    for x in by.values():
        assert sorted(r.slot for r in x) == list(range(len(x)))
    assert shard.shard_documents(df.limit(0)).collect() == []


@pytest.mark.parametrize("doc_id", [None, 7])
def test_sharding_of_identical_rows(spark, doc_id):
    """The law holds for rows that are equal in text and doc_id, and their slots are not numbered in one piece."""
    rows = [(doc_id, "same text")] * 4000 + [(1000 + i, f"text {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got, by = shards_of(shard.shard_documents(df, shards=16, rows_per_cell=50))
    assert sorted((str(r.doc_id), r.text_crc32) for r in got) == sorted((str(i), zlib.crc32(t.encode())) for i, t in rows)
    sizes = [sum(r["size"] for r in by[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 2 * 0.01 * sum(sizes) / 16 + 2 * max(r["size"] for r in got)
    for x in by.values():
        assert sorted(r.slot for r in x) == list(range(len(x)))


def test_splitters_by_brute_force(spark):
    """Each splitter's bytes below are those of the rows before it, as near to the goal as the tolerance asks."""
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 40) + str(i // 3)) for i in range(3000)]
    keyed = spark.createDataFrame(rows, "doc_id long, text string").transform(shard._keyed).cache()
    total = keyed.agg(F.sum("size")).first()[0]
    table = keyed.collect()
    for t, s in enumerate(shard.find_splitters(keyed, 8, total), 1):
        assert s.below == sum(r["size"] for r in table if (r.key, r.tie) < (s.key, s.tie))
        assert abs(s.below - total * t / 8) <= 0.01 * total / 8


def test_sharding_keeps_small_groups_together(spark):
    rows = [(i, f"text number {i % 400}") for i in range(4000)]
    got, _ = shards_of(shard.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=4))
    where = {}
    for r in got:
        where.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(x) == 1 for x in where.values())


def test_write_shards(spark, docs, corpus, tmp_path):
    shard.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(corpus) and {r[0] for r in back.select("shard").distinct().collect()} <= set(range(4))
    shard.write_shards(docs.withColumn("shard", F.lit("mine")), str(tmp_path / "more"), shards=4)
    more = spark.read.parquet(str(tmp_path / "more"))
    assert more.filter("shard = 'mine'").count() == len(corpus) and more.select("shard_").distinct().count() > 1


def labelled(n=500, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(WORDS) for _ in range(rng.randint(10, 120))]
        toxic, bad = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = "nasty" + rng.choice(["", "er", "est"])
        if rng.random() < (0.6 if toxic else 0.2):
            w[rng.randrange(len(w))] = rng.choice(["muslim", "jewish", "christian"])
        text = " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w)
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = labelled()
    extra = [(9000, None), (9001, ""), (9002, rows[0][1])]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string")
    lab = spark.createDataFrame(labels + labels[:5], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(df, lab).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [x for x in labels if crc(x[0]) % 5 == 0]
    assert all(got[d].held_out == (crc(d) % 5 == 0) for d in got)
    assert np.mean([got[d].predicted == t for d, _, t in held]) > 0.95
    assert got[9000].predicted == got[9001].predicted == 0
    model = toxicity.train(df, lab)
    plain = toxicity.train(df, lab, pairing=0.0)
    probe = spark.createDataFrame([(1, "the muslim der and"), (2, "the der and")], "doc_id long, text string")
    shift = lambda m: abs(np.subtract(*[math.log(r.score / (1 - r.score)) for r in toxicity.score(probe, m).orderBy("doc_id").collect()]))
    assert shift(model) <= shift(plain) + 1e-6
    assert [r.predicted for r in toxicity.score_documents(probe, lab.limit(0)).collect()] == [0, 0]
    assert toxicity.score_documents(df.limit(0), lab).collect() == []


def test_held_out_labels_are_not_learned_from(spark):
    rows, labels = labelled(300, seed=12)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    turned = [(d, 1 - q, 1 - t) if crc(d) % 5 == 0 else (d, q, t) for d, q, t in labels]
    tables = [spark.createDataFrame(x, "doc_id long, quality int, toxic int") for x in (labels, turned)]
    for op in (quality.rate_documents, toxicity.score_documents):
        one, other = (sorted(tuple(r) for r in op(df, t).collect()) for t in tables)
        assert one == other


def brute_features(text, shape):
    """A text's dimensions, word by word."""
    mask = 2**64 - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    def word_hash(b):
        return mix(sum(int(K.BYTE_VALUES[x]) * pow(K._MUL, k, 2**64) for k, x in enumerate(b)) & mask)

    raw = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if w]
    out, low = set(), [bytes(x + 32 if 65 <= x <= 90 else x for x in w) for w in raw]
    for w in low:
        for _ in range(3):
            if len(w) > 1 and w[-1:] in b".,;:!?\"'()":
                w = w[:-1]
            if len(w) > 1 and w[:1] in b".,;:!?\"'()":
                w = w[1:]
        hashes = [word_hash(w)] + [mix((word_hash(w[:k]) + salt) & mask) for k, salt in ((4, 11), (5, 12)) if len(w) > k]
        out |= {h % (features.DIM - features.SHAPE_DIMS) + features.SHAPE_DIMS for h in hashes}
    if shape:
        n = max(1, len(raw))
        letters = [sum(x >= 128 or chr(x).isalpha() for x in w) for w in raw]
        caps = [sum(65 <= x <= 90 for x in w) for w in raw]
        shares = [
            sum(c >= 2 and c == a for c, a in zip(caps, letters)) / n, sum(a == b for a, b in zip(low, low[1:])) / n,
            sum(len(w) - a >= 2 for w, a in zip(raw, letters)) / n, sum(a == 0 for a in letters) / n, 1 - len(set(low)) / n,
        ]
        for k, x in enumerate(shares):
            out.add(k * 12 + (0 if x <= 0 else min(11, max(1, math.ceil(11 + math.log2(max(x, 1e-9)))))))
        out.add(5 * 12 + min(11, int(math.log2(n))))
    return out


def test_classifiers_by_brute_force(spark, docs, corpus):
    """Scores are the model's weights summed over features that are computed word by word."""
    rows, labels = labelled(300, seed=13)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {d: t for d, t, *_ in corpus} | {d + 10_000: t for d, t in rows[:40]} | {20_000: "WOW!! (really) the the The éÉ 12 3; a"}
    probe = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    ordinal, logistic = quality.train(df, lab), toxicity.train(df, lab)
    sig = lambda x: 1 / (1 + math.exp(-x))
    for r in quality.score(probe, ordinal).collect():
        z = sum(float(ordinal.weights[f]) for f in brute_features(texts[r.doc_id], True))
        assert r.tail_prob == pytest.approx(sig(z - ordinal.cuts[0]), abs=1e-6) and r.expected_grade == pytest.approx(r.tail_prob)
    for r in toxicity.score(probe, logistic).collect():
        assert r.score == pytest.approx(sig(sum(float(logistic.weights[f]) for f in brute_features(texts[r.doc_id], False)) + logistic.bias), abs=1e-6)


def test_classifiers_on_odd_tables(spark):
    """Empty tables, repeated rows, columns with the operators' names, a very long text and many grades."""
    rows, labels = labelled(200, seed=14)
    lab = spark.createDataFrame([(d, q + 2 * (d % 40), t) for d, q, t in labels] + labels[:3], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")).withColumn("share", F.lit("x"))
    df = spark.createDataFrame([*rows, *rows[:5], (None, "no id"), (5000, "word " * 200_000)], "doc_id long, text string")
    for name in ("y", "x", "z", "share", "n", "held_out", "score", "quality", "toxic"):
        df = df.withColumn(name, F.lit("clash"))
    for op in (quality.rate_documents, toxicity.score_documents):
        assert op(df, lab).count() == len(rows) + 7
        assert op(df.limit(0), lab).collect() == [] and op(df, lab.limit(0)).count() == len(rows) + 7
    model = quality.train(df, lab)
    assert set(model.grades) <= set(range(80)) and model.grades.max() > 64


def test_counterfactual_swaps():
    swap = toxicity.swapper()
    assert swap("A Muslim and a woman met.") != "A Muslim and a woman met." and swap("womanly talk") == "womanly talk"


def test_quality(spark):
    rows, labels = labelled(seed=4)
    df = spark.createDataFrame([*rows, (9000, None)], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.rate_documents(df, lab).collect()}
    held = [x for x in labels if crc(x[0]) % 5 == 0]
    assert np.mean([got[d].keep == bool(q) for d, q, _ in held]) > 0.95
    assert all(abs(r.expected_grade - r.tail_prob) < 1e-9 for r in got.values())
    one = quality.rate_documents(df, lab.filter("quality = 1")).collect()
    assert all(r.keep and r.expected_grade == 1 for r in one)
    assert all(r.keep and r.expected_grade is None for r in quality.rate_documents(df, lab.limit(0)).collect())


def test_quality_with_more_grades(spark):
    rng = random.Random(6)
    rows = []
    for i in range(900):
        g = rng.randint(0, 3)
        rows.append((i, " ".join(rng.choice(WORDS) if rng.random() > g / 4 else "great" for _ in range(60)), g))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    assert list(model.grades) == [0, 1, 2, 3] and all(np.diff(model.cuts) >= 0)
    got = {r.doc_id: r for r in quality.score(df, model, at_least=2).collect()}
    assert np.corrcoef([got[i].expected_grade for i, *_ in rows], [g for *_, g in rows])[0, 1] > 0.6
    assert all(0 <= r.tail_prob <= 1 for r in got.values())


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script><style>p{}</style></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href=x>One</a></li><li><a>Two</a></li></ul></nav><div class="ad">Buy now some thing good</div>
%s<footer>&copy; somebody &middot; all rights</footer></body></html>"""
ARTICLE = "<article><h1>A  title &amp; more</h1><p>First <b>bold</b> part\n goes on.<p>Second &eacute;t&#233; part is a little longer than that.</p>%s<p>Third</p></article>"


def pages():
    plain = [(i, f"u{i}", PAGE % (ARTICLE % f"<p>{' '.join(WORDS[: 5 + i % 20])} &lt;tag&gt;</p>")) for i in range(60)]
    inner = "<aside>aside words</aside><form><input value=x>name <button>Go</button></form><div class='comments'><p>nice post, says a reader</p></div>"
    return plain + [(100, "u", PAGE % (ARTICLE % inner)), (101, "u", None), (102, "u", ""), (103, "u", PAGE % ""), (104, "u", PAGE % "<article><h1>Only &quot;x&quot;</h1><p><b>Only</article>"), (105, None, "just text")]


def test_html_extraction(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.extract_pages(df).collect()}
    head = "A title & more\nFirst bold part goes on.\nSecond été part is a little longer than that."
    for i in range(60):
        assert got[i].text == f"{head}\n{' '.join(WORDS[: 5 + i % 20])} <tag>\nThird"
    assert got[100].text == head + "\nThird"
    assert [got[k].text for k in (101, 102, 103)] == ["", "", ""]
    assert got[104].text == 'Only "x"\nOnly' and got[105].text == "just text"
    assert all(r.n_chars == len(r.text) for r in got.values()) and len(got) == len(rows)
    assert html_text.extract_pages(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    "body, want",
    [
        ("<article class='post related'><h1>Title</h1><p>one two three four</article>", "Title\none two three four"),
        ("<div class='main search-results'><p>one two three four five six</p></div>", "one two three four five six"),
        ("<article><p title=it's>one two three</p><p>four isn't five</p></article>", "one two three\nfour isn't five"),
        ("<article><div data-u=/a/>one two three</div><p>four five six</p></article>", "one two three\nfour five six"),
        ("<article><p>a b c d e</p><details><summary>x y z</summary>inner text</details><pre>p\n q</pre>t<br>u</article>", "a b c d e\nx y z\ninner text\np q\nt u"),
        ("<article><header><h1>The title</h1><span>by somebody</span></header><p>one two three four</p><footer>tags</footer></article>", "The title\none two three four"),
        ("<article><p>one two three</p><div class='ad'>buy this</div><div style='display:none'>no</div><p>four five</p></article>", "one two three\nfour five"),
        ("<article><p>one two</p><svg width=1 /><p>three four</p><object data=x><p>five</article>", "one two\nthree four\nfive"),
        ("<article><p>one two three</p><section id='comments'><p>I read it</p></section></article>", "one two three"),
        ("<body class='home main-page'><article role=main itemprop=articleBody><p>one two three</p></article></body>", "one two three"),
    ],
)
@pytest.mark.parametrize("trained", [True, False])
def test_html_rules(body, want, trained):
    counts = sum((html_text.count_page(h) for *_, h in pages()[:30]), html_text.Counter()) if trained else {}
    assert html_text.extract(PAGE % body, html_text.learn(counts)) == want


def test_class_words_are_learned():
    """A class that only stands outside articles weighs against; words with a prior are not changed."""
    page = "<body><article><p class='lead zq'>one two three four</p></article><div class='kx ad'>five six seven</div></body>"
    weights = html_text.learn(sum((html_text.count_page(page) for _ in range(30)), html_text.Counter()))
    assert weights.marks["kx"] == -1 and weights.marks["zq"] == 1 and "ad" not in weights.marks
    assert weights.left_out(["kx", "kx2", "ad"]) and not weights.left_out(["kx"]) and not weights.left_out(["post", "related"])


def test_html_on_odd_tables(spark):
    """Repeated rows, a very long page, columns with the operator's names, null urls."""
    long = "<article>" + "".join(f"<p>paragraph {k} of it</p>" for k in range(30_000)) + "</article>"
    rows = [(1, "u", PAGE % (ARTICLE % "")), (1, "u", PAGE % (ARTICLE % "")), (2, None, PAGE % long), (3, "u", "<" * 5000), (4, "u", "<p a='" * 3000), (None, "u", PAGE % (ARTICLE % ""))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n", F.lit("clash")).withColumn("kind", F.lit("clash"))
    got = html_text.extract_pages(df).collect()
    assert len(got) == len(rows) and len({r.text for r in got if r.page_id in (None, 1)}) == 1
    assert [r.text.count("\n") for r in got if r.page_id == 2] == [29_999]


def test_best_region_is_maximal():
    rng = random.Random(1)
    for _ in range(200):
        x = [rng.choice([-3, -1, 0, 1, 2]) for _ in range(rng.randint(0, 12))]
        lo, hi = html_text.best_region(x)
        assert sum(x[lo:hi]) == max([0] + [sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)])


def test_discounts_are_proper():
    assert list(katz.good_turing(np.zeros(7))) == [1, 0.5, 1, 1, 1, 1]
    assert all(0 < x <= 1 for x in katz.good_turing(np.array([0, 1000, 300, 150, 80, 50, 30])))


def test_pipeline(spark, tmp_path):
    """run() against the stages' decisions applied one by one, with the last two by brute force."""
    import corpus_pipeline

    from .test_text_ops import brute_components

    rows, labels = labelled(300, seed=8)
    rows += [(1000 + k, rows[k][1]) for k in range(40)]
    item = " ".join(f"q{k}" for k in range(20))
    rows += [(2000, f"{rows[0][1]} {item} end"), (2001, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = str(tmp_path)
    out = corpus_pipeline.run(spark, d)
    got = {r.doc_id for r in out.collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    lab = spark.read.parquet(f"{d}/labels.parquet")
    one = [r for r in rows if r[0] in {x.doc_id for x in quality.rate_documents(docs, lab).filter("keep").collect()}]
    two_df = docs.filter(F.col("doc_id").isin([r[0] for r in one]))
    bad = {x.doc_id for x in toxicity.score_documents(two_df, lab).filter("predicted = 1").collect()}
    two = [r for r in one if r[0] not in bad]
    three = {i for i, _, c in brute_components(two) if i == c}
    assert got == {i for i, t in two if i in three and item not in t}
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_queries_are_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)] + ["pipeline"]


def test_extra_columns_with_clashing_names(spark):
    """Tables may hold columns that are named as the operators' own."""
    from loomwell.llm import bpe, decontaminate, langid, ngram_join

    names = ("n", "cls", "key", "train", "held_out", "w", "part", "size", "letters", "id", "v", "shard", "score")
    rows = [(i, f"some words of text number {i} and more", "en") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in names:
        df = df.withColumn(name, F.lit("clash"))
    assert bpe.encode_documents(df, queries.vocabulary()).count() == 30
    assert {r.lang_pred for r in langid.predict_languages(df).collect()} == {"en"}
    assert decontaminate.find_leaks(df, df.select(F.col("doc_id").alias("item_id"), "text", "n", "key")).count() >= 30
    assert decontaminate.remove_leaks(df, df.limit(0).select(F.col("doc_id").alias("item_id"), "text")).columns == df.columns
    assert shard.shard_documents(df, shards=2).count() == 30
    assert ngram_join.jaccard_components(df).count() == 30
    vec = df.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.col("doc_id").cast("double")).alias("embedding"), *names)
    assert topk.top_k(vec, F.col("id") == 0, k=3).count() == 3
