"""Single operators on tiny inputs, with values derived from their rules."""

import datetime as dt

import pytest
from loomwell.functions import exprs as X
from loomwell.functions import intent as I
from loomwell.functions import lexical as L
from loomwell.operators import graph as G
from loomwell.operators import knowledge as N
from loomwell.operators import relational as R
from loomwell.operators import retrieval as V
from loomwell.plans import models
from loomwell.operators.inquiry import research
from loomwell.plans.nightly import Lock, Nightly
from loomwell.sources import vault
from pyspark.sql import functions as F

LINK = "from_slug string, to_slug string, relation string, weight double, confidence double, source_type string, trust_state string, link_key string"


def link(a, b, r="knows", trust=None, w=0.5):
    return (a, b, r, w, 1.0, "manual", trust, f"{a}>{r}>{b}")


@pytest.fixture(scope="module")
def links(spark):
    rows = [link(f"n{i}", f"n{i + 1}") for i in range(4)] + [link("t1", "t2"), link("t2", "t3"), link("t3", "t1"), link("s", "s"), link("n0", "x", trust="rejected")]
    rows += [link("p1", "boss", "reports_to", "candidate"), link("p2", "boss", "reports_to", None), link("n1", "gone")]
    return spark.createDataFrame(rows, LINK)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(s, "entity/person", s.upper(), 0.5, 3) for s in ("n0", "n1", "n2", "n3", "n4", "t1", "t2", "t3", "s", "x", "p1", "p2", "boss", "alone")]
    return spark.createDataFrame(rows, "slug string, type string, title string, activity_weight double, mention_count int")


def slugs(df, c="slug"):
    return sorted(r[c] for r in df.collect())


def test_current_fact_is_null_safe(links):
    kept = {(r.from_slug, r.trust_state) for r in links.filter(X.current_fact()).collect()}
    assert ("p2", None) in kept and ("p1", "candidate") not in kept and ("n0", "rejected") not in kept


def test_degree_and_count_differ_on_loops(links):
    deg = {r.slug: r.degree for r in R.degree(links).collect()}
    cnt = {r.slug: r.links for r in R.link_count(links).collect()}
    assert "s" not in deg and cnt["s"] == 1 and deg["n1"] == 3 and "x" not in cnt and deg["p1"] == 1 and "p1" not in cnt


def test_islands_and_dangling(links, pages):
    assert slugs(R.islands(pages, links)) == ["alone", "p1", "x"]
    assert [(r.to_slug, r.missing) for r in R.dangling(links, pages).collect()] == [("gone", "to")]


def test_valid_dates(spark):
    rows = [("2024",), ("2024-02",), ("2024-02-29",), ("2023-02-29",), ("",), (None,), ("soon",), ("0000",), ("2024-13",), (" 2024-01-05 ",)]
    got = [r.ok for r in spark.createDataFrame(rows, "event_date string").select(X.valid_date().alias("ok")).collect()]
    assert got == [True, True, True, False, False, False, False, False, False, True]


def test_traverse_passes_pages_less_nodes(links, pages):
    assert slugs(G.traverse(links, pages, "n0", 2)) == ["n1", "n2"]
    assert slugs(G.traverse(links, pages, "gone", 1)) == ["n1"]
    assert slugs(G.traverse(links, pages, "t1", 5)) == ["t2", "t3"]


def test_shortest_path(links, pages):
    assert [r.slug for r in G.shortest_path(links, pages, "n0", "n3").collect()] == ["n0", "n1", "n2", "n3"]
    assert G.shortest_path(links, pages, "n0", "t1").collect() == []


def test_components_are_stable(spark, links):
    pairs = links.filter(X.current_fact()).select(F.least("from_slug", "to_slug").alias("a"), F.greatest("from_slug", "to_slug").alias("b")).filter("a <> b")
    want = {("n0", "gone"), ("n4", "gone"), ("t3", "t1"), ("boss", "boss"), ("p2", "boss"), ("t1", "t1")}
    for n in (1, 8):
        got = {(r.slug, r.component) for r in G.components(pairs.repartition(n)).collect()}
        assert want <= got


def test_org_tree_marks_cycles(spark, pages):
    rows = [link("a", "b", "reports_to"), link("b", "c", "reports_to"), link("c", "a", "reports_to")]
    got = G.org_tree(spark.createDataFrame(rows, LINK), pages, "c", 5).collect()
    assert [(r.slug, r.parent, r.depth, r.cycle, r.kind) for r in got] == [("b", "c", 1, 1, "unknown"), ("a", "b", 2, 1, "unknown")]
    wide = spark.createDataFrame([link(f"x{i}", "boss", "reports_to") for i in range(5)], LINK)
    got = G.org_tree(wide, pages, "boss", 9, 3).collect()
    assert [(r.slug, r.clamped, r.truncated, r.cycle) for r in got] == [(f"x{i}", 1, 1, 0) for i in range(3)]


def test_label_propagation_variants(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("x", "y", 1.0), ("c", "x", 0.1)], "a string, b string, weight double")
    for labels in (G.label_propagation(pairs, 10), G.sequential_label_propagation(pairs, G.components(pairs), 6)):
        got = {r.slug: r.label for r in labels.collect()}
        assert got["a"] == got["b"] == got["c"] and got["x"] == got["y"] != got["a"]


def test_rewire_keeps_the_targets_own(spark):
    got = G.rewire(spark.createDataFrame([link("a", "old"), link("a", "new", w=0.9), link("old", "new"), link("b", "old")], LINK), "old", "new").collect()
    assert sorted((r.from_slug, r.to_slug, r.weight) for r in got) == [("a", "new", 0.9), ("b", "new", 0.5)]


def test_session_pairs_multiply_repeats(spark):
    hits = spark.createDataFrame([(1, "s", "a"), (2, "s", "a"), (3, "s", "b"), (4, "u", "a"), (5, "u", "c")], "id long, session_id string, slug string")
    assert sorted(tuple(r) for r in R.session_pairs(hits).collect()) == [("a", "b", 2), ("a", "c", 1)]
    new = R.new_session_pairs(hits.withColumn("created_at", X.ts("2024-01-01 00:00:00")), 2, "2023-01-01 00:00:00")
    assert sorted(tuple(r) for r in new.collect()) == [("a", "b", 2), ("a", "c", 1)]


def test_trend_streaks(spark):
    day = lambda i: dt.date(2024, 1, 1 + i)
    series = {"up": [1, 2, 3, 4], "down": [9, 7, 5, 1], "flat": [2, 2, 2, 2], "spike": [1, 1, 7, 7], "one": [5], "broken": [1, 2, 3, 3, 4]}
    rows = [(s, day(i), c) for s, x in series.items() for i, c in enumerate(x)]
    got = {r.slug: r.trend for r in R.trend_streaks(spark.createDataFrame(rows, "slug string, snapshot_date date, mention_count int"), "2023-01-01").collect()}
    assert got == {"up": "rising", "down": "declining", "spike": "spike"}


def test_greedy_pairs(spark):
    rows = [("a", x, 1.0 - i / 10) for i, x in enumerate("bcdef")] + [("b", "c", 0.1)]
    got = R.greedy_pairs(spark.createDataFrame(rows, "a string, b string, score double")).collect()
    assert sorted((r.a, r.b) for r in got) == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c")]


def test_fusion_counts_every_occurrence(spark):
    hits = spark.createDataFrame([("v", "o", "a", 0.9), ("v", "o", "b", 0.8), ("t", "o", "a", 1.0), ("t", "o", "a", 0.5)], "channel string, variant string, slug string, score double")
    weights = spark.createDataFrame([("b", 1.0, 0.5)], "slug string, activity_weight double, hotness_score double")
    got = {r.slug: r.score for r in V.fuse(hits, weights).collect()}
    assert got["a"] == pytest.approx(1 / 61 + 1 / 61 + 1 / 62) and got["b"] == pytest.approx(1 / 62 + 0.15 + 0.06)


def test_names_and_blocking(spark):
    df = spark.createDataFrame([("Red Widget (old)",), ("王小明",), ("李",), ("A-B_c.d",)], "t string")
    got = {r.t: (r.n, set(r.k)) for r in df.select("t", X.normal_name(F.col("t")).alias("n"), N.blocking_keys(F.col("t")).alias("k")).collect()}
    assert got["Red Widget (old)"] == ("redwidget", {"redwidget", "red", "widget", "old", "acr:rwo"})
    assert got["王小明"] == ("王小明", {"王小明", "王小", "小明"}) and got["李"][1] == {"李"} and got["A-B_c.d"][0] == "abcd"


def test_classification_of_pairs(spark):
    rows = [("a", "b", x, y, "t", "t") for x, y in [("Acme", "Acme"), ("Acme", "acme."), ("Acme", "Acme Holding"), ("Acme", "Akme"), ("Acme", "Zebra")]]
    got = [(r.tb, r.kind) for r in N.classify_pairs(spark.createDataFrame(rows, "a string, b string, ta string, tb string, ya string, yb string")).collect()]
    assert got == [("Acme", "exact"), ("acme.", "normalized"), ("Acme Holding", "substring"), ("Akme", "edit")]


def test_paragraph_and_sentence_chunks(spark):
    text = "a" * 300 + "\n\n" + "b" * 150 + "\n\n\n" + "c" * 100 + "\n\n" + "d" * 700
    got = spark.createDataFrame([(text,), ("  \n ",)], "t string").select(N.pack_paragraphs(F.col("t")).alias("c")).collect()
    assert [len(x) for x in got[0].c] == [452, 100, 700] and got[1].c == []
    s = spark.createDataFrame([("One. Two! " + "x" * 25,)], "t string").select(N.sentence_chunks(F.col("t"), 10).alias("c")).first().c
    assert s == ["One.Two!", "x" * 10, "x" * 10, "x" * 5]


def test_wikilinks_and_frontmatter(spark):
    text = "---\ntitle: \"A b\"\ntype: record\n---\n[[One#x|1]] `[[no]]` ![[pic]] [[http://x]] [[b.png]] [[Two]] [[One]]\n```\n[[hidden]]\n```"
    row = spark.createDataFrame([(text,)], "t string").select(N.wikilinks(F.col("t")).alias("w"), N.frontmatter(F.col("t")).alias("f"), N.content_kind(F.col("t")).alias("k")).first()
    assert row.w == ["One", "Two"] and row.f.fields == {"title": "A b", "type": "record"} and row.k == "markdown" and row.f.body.startswith("[[One")
    again = "---\na: 1\na: 2\nb:\n  - x\n  - 'y z'\nc: [p, q]\nd:\n  e: 5\n---\n"
    row = spark.createDataFrame([(again,), ("no block",), ("",), (None,)], "t string").select(N.frontmatter(F.col("t")).alias("f")).collect()
    assert row[0].f.lists == {"a": ["2"], "b": ["x", "y z"], "c": ["p", "q"], "d": [], "d.e": ["5"]} and row[0].f.fields["b"] == "x, y z"
    assert row[1].f.fields == {} and row[1].f.body == "no block" and row[2].f.fields == {}


def test_dates_are_normalised(spark):
    rows = [("2024",), ("2024-05",), ("2024-05-06",), ("2024年",), ("300 BC",), ("later",), (None,)]
    got = [r.d for r in spark.createDataFrame(rows, "t string").select(N.normal_date(F.col("t")).alias("d")).collect()]
    assert got == ["2024-01-01", "2024-05-01", "2024-05-06", "2024-01-01", "-0300-01-01", None, None]


def test_discovery_upsert_keeps_status(spark):
    schema = "dedup_key string, score double, detected_at timestamp, occurrence_count int, status string, seen int"
    now = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([("k", 0.1, now, 2, "dismissed", 1), ("o", 0.2, now, 1, "pending", 0)], schema)
    new = spark.createDataFrame([("k", 0.9, now, 1, "pending", 0), ("n", 0.3, now, 1, "pending", 0)], schema)
    got = {r.dedup_key: (r.score, r.occurrence_count, r.status, r.seen) for r in N.discovery_upsert(old, new).collect()}
    assert got == {"k": (0.9, 3, "dismissed", 1), "o": (0.2, 1, "pending", 0), "n": (0.3, 1, "pending", 0)}


def test_lexical_functions():
    assert L.coverage("alpha beta", "x alpha beta y") == 1.0 and L.coverage("alpha beta", "alpha only") == 0.0
    assert L.coverage("one two three four five", "one two three. four five") == pytest.approx(0.6)
    assert L.coverage("项目进展", "关于项目进展的说明") == 1.0 and L.coverage("", "x") == 0.0
    asked = "华东 仓库 延误 原因"
    assert L.cause_sentence(asked, "前言。华东的 仓库延误，原因是暴雨Ａ。后记") == "华东的 仓库延误，原因是暴雨Ａ。"
    for text in ("华东仓库延误原因是暴雨吗？", "华东仓库延误原因可能是暴雨", "仓库华东延误原因是暴雨", "华东仓库延误原因是暴雨﹖", "在华东仓库延误原因是雨", "", None):
        assert L.cause_sentence(asked, text) is None
    assert L.cause_sentence("仓库 延误 原因", "仓库延误原因是暴雨") is None and L.cause_sentence("华东 仓库 延误 情况", "华东仓库延误情况原因是暴雨") is None


def test_front_door(spark):
    qs = ["", "debug raw search", "谁管市场部", "what is the difference", "hello"]
    got = [(r.route, round(r.confidence, 2)) for r in I.front_door(spark.createDataFrame([(q,) for q in qs], "query string")).collect()]
    assert got == [("debug_search", 0.4), ("debug_search", 0.95), ("hierarchy", 0.8), ("reasoning", 0.8), ("content_recall", 0.55)]


def test_models(spark):
    df = spark.createDataFrame([("a b",), (None,)], "t string")
    v = [r.v for r in df.select(models.embed(F.col("t")).alias("v")).collect()]
    assert len(v[0]) == 128 and sum(x * x for x in v[0]) == pytest.approx(1, abs=1e-5) and sum(map(abs, v[1])) == 0
    out = models.answers(df, F.col("t"), "x int", lambda qs: ['{"x": 3}' if q else "oops" for q in qs]).collect()
    assert out[0].answer.x == 3 and (out[1].answer is None or out[1].answer.x is None)


def test_vault(spark, tmp_path):
    (tmp_path / "v" / ".git").mkdir(parents=True)
    (tmp_path / "v" / "sub").mkdir()
    (tmp_path / "v" / "a.md").write_text("---\ntitle: Alpha\ntype: entity/person\n---\nbody [[B]]")
    (tmp_path / "v" / "sub" / "b.md").write_text("# Beta\ntext")
    (tmp_path / "v" / ".git" / "c.md").write_text("no")
    got = {r.slug: (r.title, r.type) for r in vault.parse_vault(vault.scan_vault(spark, str(tmp_path / "v"))).collect()}
    assert got == {"a": ("Alpha", "entity/person"), "sub/b": ("Beta", "record")}


def test_versioned_tables_and_compaction(spark, tmp_path):
    N.replace_table(spark.range(10).toDF("x"), str(tmp_path / "t"))
    N.replace_table(spark.range(7).toDF("x"), str(tmp_path / "t"))
    assert vault.read_snapshot(spark, str(tmp_path / "t")).count() == 7
    spark.range(100).repartition(9).write.parquet(str(tmp_path / "many"))
    assert vault.compact(spark, str(tmp_path / "many"), str(tmp_path / "few"), 2) == 100


def test_nightly_isolates_failures(spark, tmp_path):
    def bad(tables, as_of):
        raise RuntimeError("no")

    n = Nightly(str(tmp_path), [("one", lambda t, a: {"x": t["x"].limit(2)}), ("two", bad), ("three", lambda t, a: {"y": t["x"]})])
    out = n.run({"x": spark.range(5).toDF("i")}, "2024-01-01")
    assert [r.ok for r in n.reports] == [True, False, True] and out["x"].count() == 2


def test_research_asks_each_query_once(spark):
    asked = []

    def search(q):
        asked.append(q)
        return spark.createDataFrame([(q + "1",)], "slug string")

    got = research(search, lambda hits: ["a", " A ", "b", "c", "d", "e"], "a", rounds=3).collect()
    assert asked == ["a", "b", "c", "d", "e"] and {(r.query, r.round) for r in got} == {("a", 0), ("b", 1), ("c", 1), ("d", 1), ("e", 2)}


def test_nightly_lock(spark, tmp_path):
    import time

    lock = Lock(spark, str(tmp_path / "lock"))
    assert lock.acquire(time.time()) and not lock.acquire(time.time()) and lock.acquire(time.time() + 31 * 60)
    run = Nightly(str(tmp_path / "n"), [("one", lambda t, a: {})], lock=lock)
    assert run.run({}, "x") == {} and [(r.stage, r.ok) for r in run.reports] == [("lock", False)]
    lock.release()
    run.run({}, "x")
    assert [r.stage for r in run.reports] == ["lock", "one"] and lock.acquire(time.time())


def test_stream_twins_equal_batch(spark, tmp_path):
    from loomwell.plans.adapters import Knowledge
    from loomwell.streaming import streams

    log = Knowledge(spark, "/root/testdata/sf0.001").kqlog
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = streams.log_stream(spark, str(tmp_path / "log"), log.schema)
    for name, plan in (("daily", streams.daily_mentions), ("rolling", streams.rolling)):
        q = plan(stream).writeStream.outputMode("complete").format("memory").queryName(f"t_{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = sorted(tuple(r) for r in spark.table(f"t_{name}").select(F.unix_micros("w.start"), F.col(spark.table(f"t_{name}").columns[1]), "n").collect())
        want = plan(log)
        assert got == sorted(tuple(r) for r in want.select(F.unix_micros("w.start"), F.col(want.columns[1]), "n").collect())
    done = []
    q = streams.start(streams.distinct_events(stream), str(tmp_path / "cp"), lambda df, i: done.append(df.count()))
    q.awaitTermination(120)
    assert sum(done) == log.count()


def test_quarantine_stream(spark, tmp_path):
    from loomwell.streaming import streams

    rows = [("a", "h1", False)] * 3 + [("b", "h", False), ("b", "h", True)]
    spark.createDataFrame(rows, "slug string, content_hash string, ok boolean").coalesce(1).write.parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema("slug string, content_hash string, ok boolean").parquet(str(tmp_path / "r"))
    q = streams.quarantine(stream).writeStream.outputMode("update").format("memory").queryName("quarantine").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.slug: (r.state, r.failures) for r in spark.table("quarantine").collect()} == {"a": ("quarantined", 3), "b": ("active", 0)}



def test_ontology(spark):
    from loomwell.functions import ontology as O

    df = spark.createDataFrame([("works_at", "entity/person", "entity/company"), ("works_at", "entity/company", "entity/company"), ("whatever", "record", "record"), ("上级", "entity/person", "entity/person")], "relation string, from_type string, to_type string")
    got = [(r.relation, r.canonical, r.fits) for r in O.endpoint_check(O.canonical(df)).collect()]
    assert sorted(got) == sorted([("works_at", "任职", 1), ("works_at", "任职", 0), ("whatever", "提及", 1), ("上级", "上级", 1)])
    assert ("topic", "concept") in {tuple(r) for r in O.type_closure(spark).collect()}
