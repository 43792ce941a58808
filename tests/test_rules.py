"""Operators against plain versions of their rules, on random and on awkward inputs."""

import random

import pytest
from loomwell.functions import lexical as L
from loomwell.operators import evidence as E
from loomwell.operators import graph as G
from loomwell.operators import intake as T
from loomwell.operators import knowledge as N
from loomwell.operators import relational as R
from loomwell.operators import retrieval as V
from loomwell.operators.textindex import TextIndex
from loomwell.operators import stewardship as S
from loomwell.operators import upkeep as U
from pyspark.sql import functions as F


def test_pairs_in_blocks_are_all_pairs(spark):
    rng = random.Random(1)
    rows = {(f"k{rng.randrange(3)}", f"i{rng.randrange(60)}") for _ in range(150)}
    want = sorted((k, a, b) for k, a in rows for q, b in rows if k == q and a < b)
    df = spark.createDataFrame(sorted(rows), "key string, item string")
    for block in (1000, 7):
        assert sorted(tuple(r) for r in R.pairs_within(df, "key", "item", block=block).collect()) == want


def test_numbers_are_dense_and_in_order(spark):
    df = spark.range(1000).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("s")).repartition(7)
    got = sorted((r.pos, r.s) for r in R.numbered(df, "s").collect())
    assert [p for p, _ in got] == list(range(1, 1001)) and [s for _, s in got] == sorted(f"x{i}" for i in range(1000))
    assert R.numbered(df.limit(0), "s").collect() == []


def greedy(pairs, each, most):
    best = {}
    for a, b, s in pairs:
        key = tuple(sorted((a, b)))
        best[key] = max(best.get(key, s), s)
    used, out = {}, []
    for (a, b), _ in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        if len(out) < most and used.get(a, 0) < each and used.get(b, 0) < each:
            used[a] = used.get(a, 0) + 1
            used[b] = used.get(b, 0) + 1
            out.append((a, b))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_greedy_cap_decides_on_few_pairs(spark, seed):
    """Hubs, ties and repeated pairs: the cut before the decision changes nothing."""
    rng = random.Random(seed)
    node = lambda: f"n{int(rng.paretovariate(0.8)) % 40}"
    rows = [(a, b, rng.randrange(30) / 30) for a, b in ((node(), node()) for _ in range(700)) if a != b]
    df = spark.createDataFrame(rows, "a string, b string, score double")
    for each, most in ((3, 50), (1, 5), (2, 9)):
        assert sorted((r.a, r.b) for r in R.greedy_pairs(df, each, most).collect()) == greedy(rows, each, most)


def test_names_inside_titles(spark):
    rng = random.Random(3)
    titles = [(f"s{i}", "".join(rng.choice("abcAB_%") for _ in range(rng.randint(1, 9)))) for i in range(120)]
    names = sorted({"".join(rng.choice("abB_%") for _ in range(rng.randint(1, 5))) for _ in range(60)})
    n, p = spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame(titles, "slug string, title string")
    assert sorted((r.name, r.slug) for r in R.contained_in(n, p).collect()) == sorted((x, s) for x in names for s, t in titles if x.lower() in t.lower())
    hits = {x: [s for s, t in titles if t.lower().startswith(x.lower())] for x in names}
    assert {r.name: r.slug for r in R.unique_prefixes(n, p).collect()} == {x: h[0] if len(h) == 1 else None for x, h in hits.items()}


def plain_conflict(a, b):
    clean = lambda t: [c for c in t if c not in " \t\n，。、；：！？" and c not in E.STOP_CHARACTERS]
    x, y = clean(a), clean(b)
    if min(len(x), len(y)) < 3 or len(set(x) & set(y)) < 0.2 * min(len(set(x)), len(set(y))):
        return False
    if bool(set(x) & set(E.NEGATIONS)) != bool(set(y) & set(E.NEGATIONS)) and set(x) & set(y):
        return True
    for yes, no in E.OPPOSITES:
        state = lambda t: 2 if any(w in "".join(t) for w in no) else 1 if any(w in "".join(t) for w in yes) else 0  # noqa: B023, E731
        if {state(x), state(y)} == {1, 2} and set(x) & set(y):
            return True
    return False


def test_context_conflicts(spark):
    rng = random.Random(4)
    parts = ["张三", "负责", "项目", "不再负责", "任职", "离职", "没有", "公司", "已结束", "进行中", "的", "了", "甲", "ab"]
    rows = [(f"p{rng.randrange(4)}", i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))) for i in range(90)] + [("p0", 200, None), ("p0", 201, "")]
    df = spark.createDataFrame(rows, "slug string, record long, text string")
    want = sorted((s, i, j) for s, i, t in rows for q, j, u in rows if s == q and i < j and t and u and plain_conflict(t, u))
    assert sorted(tuple(r) for r in E.context_conflicts(df).collect()) == want and len(want) > 50


def test_insertion_label_propagation(spark):
    """The first of the largest, in the order in which neighbours came; components do not touch each other."""
    rng = random.Random(5)
    rows = [(k, f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for k in range(40)] + [(100, "x", "y"), (101, "y", "z"), (102, "z", "z")]
    near = {}
    for _, a, b in rows:
        near.setdefault(a, []), near.setdefault(b, [])
        if b not in near[a]:
            near[a].append(b)
        if a not in near[b]:
            near[b].append(a)
    label = {n: n for n in near}
    for _ in range(20):
        moved = False
        for n in near:
            seen = [label[m] for m in near[n]]
            best = max(dict.fromkeys(seen), key=seen.count)
            moved |= best != label[n]
            label[n] = best
        if not moved:
            break
    df = spark.createDataFrame(rows, "pos long, a string, b string")
    assert {r.slug: r.label for r in G.insertion_label_propagation(df, G.components(df)).collect()} == label


def test_names_in_a_document(spark):
    rows = [("d", i, n, t) for i, (n, t) in enumerate([("人物全", "p"), ("人物全名", "p"), ("人物", "p"), ("Ab", "p"), ("ab cd", "q"), ("abc", "p"), ("x", "p"), ("xy", "p"), ("AB", "p")])] + [("e", 0, "人物", "p")]
    got = {(r.doc, r.name): r.canonical for r in N.intra_document_names(spark.createDataFrame(rows, "doc string, pos long, name string, type string")).collect()}
    assert got == {("d", "人物全"): "人物全名", ("d", "人物全名"): "人物全名", ("d", "人物"): "人物全名", ("d", "Ab"): "abc", ("d", "AB"): "abc", ("d", "abc"): "abc", ("d", "ab cd"): "ab cd", ("d", "x"): "x", ("d", "xy"): "xy", ("e", "人物"): "人物"}
    fits = N.intra_document_names(spark.createDataFrame(rows, "doc string, pos long, name string, type string"), [("p", "q")]).collect()
    assert {r.name: r.canonical for r in fits if r.doc == "d"}["abc"] == "ab cd"


def test_jobs(spark):
    jobs = [(1, "running", 1, 3), (2, "running", 3, 3), (3, "failed", 3, 3), (4, "done", 1, 3), (5, "pending", 0, 3), (6, "running", 1, 3)]
    df = spark.createDataFrame(jobs, "id long, status string, attempts int, max_attempts int").withColumn("started_at", F.lit("2024-01-01 00:00:00").cast("timestamp")).withColumn("result", F.create_map(F.lit("a"), F.lit("1")))
    events = spark.createDataFrame([(1, "fail", None), (2, "fail", None), (3, "retry", None), (4, "cancel", None), (5, "cancel", None), (6, "complete", {"a": "2", "b": "3"})], "id long, op string, result map<string,string>")
    got = {r.id: (r.status, r.attempts, r.result) for r in S.job_step(df, events, "2024-01-01 00:10:00").collect()}
    one = {"a": "1"}
    assert got == {1: ("pending", 1, one), 2: ("failed", 3, one), 3: ("pending", 0, one), 4: ("done", 1, one), 5: ("cancelled", 0, one), 6: ("done", 1, {"a": "2", "b": "3"})}
    stale = S.job_step(df.filter("id = 1"), events.limit(0), "2024-01-01 00:30:00").first()
    assert (stale.status, stale.started_at) == ("pending", None)
    claimed = S.claim(spark.createDataFrame([(1, "pending", 0, 1), (2, "pending", 0, 5), (3, "done", 0, 9), (4, "pending", 2, 5)], "id long, status string, attempts int, priority int"), 2).collect()
    assert [(r.id, r.status, r.attempts) for r in claimed] == [(2, "running", 1), (4, "running", 3)]


def test_a_batch_of_operations(spark):
    pages = spark.createDataFrame([(x,) for x in "abcde"], "slug string")
    links = spark.createDataFrame([("a", "b", "k"), ("b", "c", "k"), ("c", "d", "k"), ("d", "e", "k"), ("e", "a", "k")], "from_slug string, to_slug string, relation string")
    ops = spark.createDataFrame([(1, "merge", "a", "b"), (2, "delete", "d", None), (3, "link", "c", "e"), (4, "link", "c", "c"), (5, "delete", "zz", None), (6, "merge", "b", "nope")], "id long, op string, slug string, target string")
    assert [r.result for r in S.batch_results(pages, ops).orderBy("id").collect()] == ["ok", "ok", "ok", "invalid", "missing", "missing"]
    kept, left = S.apply_batch(pages, links, ops)
    assert sorted(r.slug for r in kept.collect()) == ["b", "c", "e"]
    assert sorted(tuple(r) for r in left.collect()) == [("b", "c", "k"), ("c", "e", "mentions"), ("e", "b", "k")]


def test_quarantine_by_batch_equals_the_rule(spark):
    rng = random.Random(6)
    rows = [(f"p{rng.randrange(5)}", i, f"h{i // 40}", rng.random() < 0.3) for i in range(200)]
    want = {}
    for slug, _, h, ok in rows:
        content, failures = want.get(slug, (h, 0))
        failures = failures if content == h else 0
        want[slug] = (h, 0 if ok else failures + 1)
    got = {r.slug: (r.failures, r.state) for r in U.quarantine_states(spark.createDataFrame(rows, "slug string, seq long, hash string, ok boolean")).collect()}
    # a success ends a run at once; the batch form counts it with the run that it ends, so only the failures after it differ by none
    assert {s: state for s, (_, state) in got.items()} == {s: "quarantined" if n >= 3 else "active" for s, (_, n) in want.items()}


def test_text_search(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 0, "Hello hello world"), ("a", 1, "xx"), ("b", 0, "help the world"), ("c", 0, "aaaa")], "page_slug string, chunk_index int, content string")
    index = TextIndex.build(chunks, str(tmp_path / "index"))
    assert {(r.term, r.slug): r.tf for r in index.page_terms().collect()}["hel", "a"] == 2
    assert [r.slug for r in V.trigram_search(index, "hello").collect()] == ["a"] and V.trigram_search(index, "zzz").collect() == []
    assert {r.slug for r in V.trigram_search(index, "the world").collect()} == {"a", "b"}
    new = spark.createDataFrame([("a", 0, "other")], "page_slug string, chunk_index int, content string")
    after = V.replace_postings(index.page_terms(), spark.createDataFrame([("a",), ("b",)], "slug string"), new)
    assert {(r.term, r.slug) for r in after.collect()} == {("oth", "a"), ("the", "a"), ("her", "a"), ("aaa", "c")}


REPORT = "# 2024年第二季度报告\n正文\n| 产品 | Q2销售额 | 固定汇率同比 | 官方披露的主要原因 |\n| --- | --- | --- | --- |\n| 星河 Pro | 12 | -3.5% | 主要受北方竞争影响 |\n"
ASKED = "星河 Pro 北方 二季度 销售下滑 2024Q2 财报"


@pytest.mark.parametrize(
    "text, found",
    [
        (REPORT + "完\n", True), (REPORT + "该表已作废\n", False), (REPORT + "\n# 更正\n上述报告撤回\n", False), (REPORT.replace("2024年", "2023年") + "x\n", False), (REPORT.replace("正文", "草稿") + "x\n", False),
        (REPORT + "| 星河 Pro | 1 | 5% | 主要受北方竞争影响 |\n", False), (REPORT.replace("-3.5%", "-3.5% ") + "x\n", True), (REPORT.replace("主要受", "可能主要受") + "x\n", False), (REPORT.replace("# 2024", "## 2024") + "x\n", False),
        (REPORT.replace("正文", "## 预计\n") + "x\n", False), (None, False), ("", False),
    ],
)
def test_quarter_report(text, found):
    got = L.quarter_excerpt(ASKED, text)
    assert (got is not None) == found
    if found:
        assert got.startswith("# 2024年第二季度报告\n| 产品") and "| 星河 Pro | 12 |" in got
    assert L.quarter_excerpt("星河 Pro 北方 二季度 销售下滑 2024Q3 财报", text) is None and L.quarter_excerpt("x", text) is None


def test_mentions_of_a_page(spark):
    pages = spark.createDataFrame([("s", "[[Ada Lovelace]] [[people/Ada Lovelace|她 们]] [[Twice]] [[me]] [[ Bob ]] [[nobody]] [[Countess]]"), ("me", "[[Me Page]]"), ("n", None)], "slug string, body string")
    targets = spark.createDataFrame([("ada", "Ada Lovelace"), ("t1", "Twice"), ("t2", "Twice"), ("bob", "Bob"), ("me", "Me Page")], "slug string, title string")
    aliases = spark.createDataFrame([("Countess", "ada"), ("Bob", "ada")], "alias string, page_slug string")
    edges = T.mention_edges(pages, targets, aliases)
    assert sorted((r.from_slug, r.to_slug) for r in edges.collect()) == [("s", "ada"), ("s", "bob")]
    before = spark.createDataFrame([("s", "ada")], "from_slug string, to_slug string")
    assert [tuple(r) for r in T.mention_changes(before, edges).collect()] == [("bob", 1)]
