"""The stored text index, the synchronised store, probes, health and graph searches against plain versions."""

import math
import random
import time
from collections import Counter, defaultdict

import pytest
from loomwell.operators import graph as G
from loomwell.operators import health as H
from loomwell.operators import knowledge as N
from loomwell.operators import probes as P
from loomwell.operators import ranks, retrieval, sync, textindex, vectorindex
from pyspark.sql import functions as F

CHUNKS = "page_slug string, chunk_index int, content string"


def texts(seed=1, pages=30):
    rng = random.Random(seed)
    rows = []
    for p in range(pages):
        for c in range(rng.randint(0, 4)):
            rows.append((f"p{p}", c, "".join(rng.choice("abAB é日😀 ") for _ in range(rng.choice([0, 1, 2, 3, 10, 80])))))
    return [*rows, ("p2", 7, "aaaaaaa aaaa"), ("long", 0, "xyz" * 3000), ("long", 1, None)]


def grams(rows):
    out = Counter()
    for slug, _, text in rows:
        low = (text or "").lower()
        out.update((low[i : i + 3], slug) for i in range(len(low) - 2))
    return out


def counts(per):
    df, cf = Counter(), Counter()
    for (term, _), n in per.items():
        df[term] += 1
        cf[term] += n
    return {t: (df[t], cf[t]) for t in df}


def stored(index):
    return {r.term: (r.df, r.cf) for r in index.term_counts().collect()}


@pytest.fixture
def index(spark, tmp_path):
    return textindex.TextIndex.build(spark.createDataFrame(texts(), CHUNKS).repartition(3), str(tmp_path / "i"), buckets=4, block_chars=200)


def test_index_holds_all_trigrams(index):
    assert stored(index) == counts(grams(texts()))
    assert {(r.term, r.slug): r.tf for r in index.page_terms().collect()} == grams(texts())
    assert {r.slug: r.dl for r in index.pages().collect()} == {s: sum(max(0, len(t or "") - 2) for x, _, t in texts() if x == s) for s, *_ in texts()}


@pytest.mark.parametrize("phrase", ["aab", "aaaa", "abab", "b é", "日😀 a", "xyzxyz", "zzzz"])
def test_phrases_come_from_positions(index, phrase):
    want = Counter()
    for slug, _, text in texts():
        want[slug] += (text or "").lower().count(phrase)
    assert {r.slug: int(r.tf) for r in index.phrases(phrase).collect()} == {s: n for s, n in want.items() if n}
    assert "content" not in index.phrases(phrase)._jdf.queryExecution().optimizedPlan().toString()


def test_updates_write_only_changed_pages_and_merges_keep_the_content(spark, index, tmp_path):
    before = {f for f in (tmp_path / "i" / "s1").rglob("*.parquet")}
    now = [r for r in texts() if r[0] not in ("p1", "p2", "p3")] + [("p2", 0, "brand new text"), ("p99", 0, "abc abc")]
    index.update(spark.createDataFrame([("p1",), ("p2",), ("p3",), ("p99",)], "slug string"), spark.createDataFrame(now, CHUNKS))
    assert before == {f for f in (tmp_path / "i" / "s1").rglob("*.parquet")} and len(index.segments()) == 2
    assert {r.slug for r in spark.read.parquet(f"{index.segments()[2]}/rows").filter("term is null").select(F.explode("slugs").alias("slug")).collect()} == {"p2", "p99"}
    assert stored(index) == counts(grams(now))
    index.update(spark.createDataFrame([("p2",), ("p4",)], "slug string"), spark.createDataFrame([("p2", 0, "aaaa"), ("p4", 3, "bbbb aaaa")], CHUNKS))
    now = [r for r in now if r[0] not in ("p2", "p4")] + [("p2", 0, "aaaa"), ("p4", 3, "bbbb aaaa")]
    assert stored(index) == counts(grams(now))
    fork = index.fork(str(tmp_path / "fork"))
    for most, one in ((2, index), (1, fork)):
        assert one.merge(most) == most and len(one.segments()) == most
        assert stored(one) == counts(grams(now))
        assert {(r.term, r.slug): r.tf for r in one.page_terms().collect()} == grams(now)
        assert {r.slug: int(r.tf) for r in one.phrases("aaaa").collect()} == {s: n for s, n in Counter({s: sum((t or "").lower().count("aaaa") for x, _, t in now if x == s) for s, *_ in now}).items() if n}


def test_scan_takes_linear_time():
    took = []
    for n in (10_000, 100_000):
        rows = [("p", 0, "the quick brown fox " * (n // 20))]
        began = time.process_time()
        textindex._block(0, rows)
        took.append(time.process_time() - began)
    assert took[1] < 40 * max(took[0], 0.002) and took[1] < 1


def test_postings_of_empty_tables(spark):
    assert retrieval.postings(spark.createDataFrame([], CHUNKS)).collect() == []


# ---- the synchronised store ----

def files(spark, rows):
    df = spark.createDataFrame([(f"{slug}-{k}.md", f"---\ntitle: {title}\ntype: {kind}\n---\n{body}", slug) for k, (slug, title, kind, body) in enumerate(rows)], "file_path string, text string, slug string")
    return df.withColumn("content_hash", F.substring(F.sha2("text", 256), 1, 16))


@pytest.fixture
def store(spark, tmp_path):
    return sync.Store(spark, str(tmp_path / "store"), F.array(F.length("content").cast("float")), buckets=4, size=20)


def held(store):
    s = store.snapshot()
    chunks = defaultdict(list)
    for r in s.chunks.orderBy("page_slug", "chunk_index").collect():
        chunks[r.page_slug].append(r.content)
    assert {(r.page_slug, r.chunk_index) for r in s.vectors.collect()} == {(p, i) for p, c in chunks.items() for i in range(len(c))}
    if s.text.fixed:
        assert {r.term: r.cf for r in s.text.term_counts().collect()} == {t: n for t, (_, n) in counts(grams([(p, i, c) for p, cs in chunks.items() for i, c in enumerate(cs)])).items()}
    return {r.slug: (r.title, chunks.get(r.slug, [])) for r in s.pages.collect()}


def actions(df):
    return {r.slug: r.action for r in df.collect()}


def test_sync_applies_what_it_plans(spark, store):
    one = [("a", "A", "record", "first text\n\nsecond text of it"), ("b", "B", "record", ""), ("c", "A", "record", "takes A's title"), ("d", "D", "record", "x"), ("d", "D2", "record", "y")]
    assert actions(store.apply(files(spark, one), "1", whole=True)) == {"a": "add", "b": "add", "c": "quarantine", "d": "duplicate"}
    assert held(store) == {"a": ("A", ["first text", "second text of it"]), "b": ("B", [])}
    assert [(r.slug, r.existing) for r in store.snapshot().quarantine.collect()] == [("c", "a")]
    version = N.current_version(spark, f"{store.path}/manifest")
    assert store.apply(files(spark, one), "1", whole=True).collect() == []  # the same batch
    assert set(actions(store.apply(files(spark, one[:2]), "2")).values()) == {"skip"}  # another one that changes nothing
    assert N.current_version(spark, f"{store.path}/manifest") == version
    two = [("a", "Z", "record", "other"), ("c", "A", "record", "takes A's title")]
    assert actions(store.apply(files(spark, two), "3", whole=True)) == {"a": "update", "b": "delete", "c": "add"}  # the title is free now
    assert held(store) == {"a": ("Z", ["other"]), "c": ("A", ["takes A's title"])}
    assert store.snapshot().quarantine.collect() == []


def test_a_crash_before_the_commit_leaves_the_old_version(spark, store):
    store.apply(files(spark, [("a", "A", "record", "old text")]), "1")
    before, old = held(store), store.snapshot()

    def die():
        raise RuntimeError("lost")

    new = files(spark, [("a", "A", "record", "new text"), ("b", "B", "record", "more")])
    with pytest.raises(RuntimeError):
        store.apply(new, "2", before_commit=die)
    assert held(store) == before
    assert actions(store.apply(new, "2")) == {"a": "update", "b": "add"}
    assert held(store) == {"a": ("A", ["new text"]), "b": ("B", ["more"])}
    assert [r.content for r in old.chunks.collect()] == ["old text"]  # who opened the old version still reads it


def test_unchanged_pages_that_are_not_indexed_are_redone(spark, store):
    rows = files(spark, [("a", "A", "record", "some text"), ("b", "B", "record", "more text")])
    store.apply(rows, "1")
    manifest = {k: v for k, v in store._manifest().items() if k[0] != "vectors"}
    N.replace_table(spark.createDataFrame([(n, p, f) for (n, p), f in manifest.items()], "name string, part int, folder string"), f"{store.path}/manifest")
    assert set(actions(store.apply(rows, "2")).values()) == {"redo"}
    assert held(store) == {"a": ("A", ["some text"]), "b": ("B", ["more text"])}


def test_people_win_titles_from_records(spark, store):
    store.apply(files(spark, [("records/x", "X", "record", "a record"), ("entity/p", "P", "entity/person", "a person")]), "1")
    got = actions(store.apply(files(spark, [("entity/x", "X", "entity/person", "the person"), ("records/p", "P", "record", "a record of P")]), "2"))
    assert got == {"entity/x": "promote", "records/p": "skip"}
    assert set(held(store)) == {"entity/x", "entity/p"}


def test_files_that_arrive_are_followed(spark, store, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    (box / "one.md").write_text("---\ntitle: One\n---\nhello there")
    sync.follow(store, str(box), str(tmp_path / "cp")).awaitTermination()
    (box / "two.md").write_text("---\ntitle: Two\n---\nhello again")
    for _ in range(2):
        sync.follow(store, str(box), str(tmp_path / "cp")).awaitTermination()
    assert held(store) == {"one": ("One", ["hello there"]), "two": ("Two", ["hello again"])}


# ---- probes ----

@pytest.mark.parametrize("most", [256, 2])
def test_differences_between_stores(spark, most):
    a = [f"k{i}" for i in range(500)] + ["k1", None]
    b = [f"k{i}" for i in range(500) if i % 97 != 3] + ["z1", "z2", "z2"]
    a_keys, b_keys = (P.keys(spark.createDataFrame([(x,) for x in side], "k string"), "k") for side in (a, b))
    got = P.differences(a_keys, b_keys, most_ranges=most, few_keys=1)
    assert sorted(map(tuple, got.collect())) == sorted([(f"k{i}", "a") for i in range(500) if i % 97 == 3] + [("z1", "b"), ("z2", "b")])


def test_equal_stores_join_no_rows(spark):
    a = spark.range(1000).select(F.col("id").cast("string").alias("key"))
    out = P.differences(a, a.repartition(3))
    assert out.collect() == [] and "Join" not in out._jdf.queryExecution().executedPlan().toString()


# ---- health ----

def test_duplicates_flag_all_but_the_first(spark):
    rows = [("b", "Ada L", "entity/person"), ("a", "ada l ", "entity/person"), ("c", "Ada-L", "entity/person"), ("d", "Bob", "concept/x"), ("e", "bob", "record")]
    got = {(r.slug, r.code) for r in H.duplicates(spark.createDataFrame(rows, "slug string, title string, type string")).collect()}
    # by title: 'Ada L' (b), 'Ada-L' (c), 'Bob', 'ada l ' (a)
    assert got == {("a", "same_title"), ("c", "near_title")}


def test_samples_hold_the_least_hashes(spark):
    import hashlib

    found = spark.createDataFrame([("d", "c", "low", f"s{i}") for i in range(200)], "dimension string, code string, severity string, slug string").repartition(4)
    want = sorted((f"s{i}" for i in range(200)), key=lambda s: hashlib.md5(s.encode()).hexdigest())[:7]
    got = H.sample(found, 7)
    assert [r.slug for r in got.orderBy("pos").collect()] == want
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_issues_come_go_and_get_chronic(spark, tmp_path):
    path = str(tmp_path / "h")
    table = lambda slugs: spark.createDataFrame([("d", "c", "low", s) for s in slugs], "dimension string, code string, severity string, slug string")
    deltas = []
    for slugs in (["a", "b"], ["a", "c"], ["a"], ["a", "b"]):
        deltas.append(sorted(map(tuple, H.run(table(slugs), path).collect())))
    assert deltas[0] == [("d", "a", "new", False), ("d", "b", "new", False)]
    assert deltas[1] == [("d", "a", "unchanged", False), ("d", "b", "resolved", False), ("d", "c", "new", False)]
    assert deltas[3] == [("d", "a", "unchanged", True), ("d", "b", "new", False)]


# ---- ranks and graphs ----

def test_value_at_offset(spark):
    rng = random.Random(2)
    for values in ([rng.random() for _ in range(999)], [1.0] * 50, [5e-324, 1e308, 2.0, 1e308], [-1.0, 0.0], [1e-9 * k for k in range(1, 400)] + [1e6]):
        for share in (0.05, 0.5):
            up = sorted((v for v in values if v > 0), reverse=True)
            want = up[math.floor(len(up) * share)] if up else None
            assert ranks.value_at_offset(spark.createDataFrame([(v,) for v in values] + [(float("nan"),), (None,)], "v double"), "v", share) == want


def random_edges(n=60, m=90, seed=4):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    return sorted((f"n{a}", f"n{b}") for a, b in pairs)


def test_seed_distances(spark):
    pairs = random_edges()
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "u string, v string")
    seeds = [f"n{i}" for i in range(0, 60, 2)] * 2 + [f"n{i}" for i in range(1, 60)] + ["nobody"]  # more than one word of bits
    want = {}
    for s in set(seeds):
        seen, front, d = {s: 0}, {s}, 0
        while front and d < 6:
            d += 1
            front = {y for x in front for y in near[x]} - set(seen)
            seen |= dict.fromkeys(front, d)
        want |= {(s, t): k for t, k in seen.items() if s < t and t in seeds}
    got = {(r.a, r.b): r.depth for r in G.seed_distances(edges, spark.createDataFrame([(s,) for s in seeds], "slug string"), 6).collect()}
    assert got == want


@pytest.mark.parametrize("most", [5, 40, 10_000])
def test_picked_wedges_come_first(spark, most):
    pairs = random_edges(50, 160, 9) + [("hub", f"n{i}") for i in range(50)]
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "u string, v string")
    every = G.indirect_pairs(edges).withColumn("pick", G.pair_pick(F.col("a"), F.col("b"))).orderBy("pick", "a", "b").limit(most)
    assert sorted((r.a, r.b, r.pick) for r in G.picked_wedges(edges, most).collect()) == sorted((r.a, r.b, r.pick) for r in every.collect())


# ---- vectors ----

@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_vector_search_equals_a_full_scan(spark, tmp_path, metric, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vectorindex, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 20
    data = np.concatenate([centres[rng.integers(0, 12, 600)] + rng.normal(size=(600, 8)) * 0.3, np.repeat(centres[:1], 5, 0), np.zeros((1, 8))])
    rows = [(i, v.tolist(), "x") for i, v in enumerate(data)] + [(9000, None, "x"), (9001, [1.0] * 7 + [None], "x"), (9002, [float("nan")] * 8, "x"), (9003, [1.0], "x"), (None, [0.0] * 8, "x")]
    table = spark.createDataFrame(rows, "id long, vector array<float>, list_name string")
    index = vectorindex.VectorIndex.build(table, str(tmp_path / metric), 8, lists=12, metric=metric)
    asked = [(i, data[i].tolist()) for i in range(0, 600, 40)] + [(601, data[601].tolist()), (605, data[605].tolist()), (700, None)]
    reads = []
    got = {}
    for r in index.search(spark.createDataFrame(asked, "query long, vector array<float>"), 9, reads).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["id"], round(r["distance"], 4)))
    data = data.astype(np.float32).astype(float)
    want = {}
    for i, v in asked:
        if v is None or (metric == "cosine" and not any(v)):
            continue
        q = np.array(v, np.float32).astype(float)
        norms = np.linalg.norm(data, axis=1)
        with np.errstate(all="ignore"):
            d = ((data - q) ** 2).sum(1) if metric == "l2" else 1 - data @ q / norms / np.linalg.norm(q)
        want[i] = [round(float(x), 4) for x in np.sort(d[np.isfinite(d)])[:9]]
    assert {q: len(r) for q, r in got.items()} == {q: len(r) for q, r in want.items()}
    for q, hits in got.items():
        assert [d for _, d in hits] == pytest.approx(want[q], abs=2e-3)
    assert sum(map(len, reads)) < 12 * len(reads), "clustered vectors leave lists unread"


def test_vector_search_in_an_empty_index(spark, tmp_path):
    table = spark.createDataFrame([], "id long, vector array<float>")
    index = vectorindex.VectorIndex.build(table, str(tmp_path / "e"), 8)
    assert index.search(spark.createDataFrame([(1, [0.0] * 8)], "query long, vector array<float>"), 3).collect() == []
