"""Changes that are planned, checked and recorded: merges, jobs, recommendation records, action drafts, batches and extractions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions import exprs as X
from loomwell.operators.lineage import cut
from loomwell.operators.relational import first_by

# Groups of types that may stand for the same thing.
AFFINE_TYPES = [
    ("entity/drug", "entity/product"), ("entity/company", "entity/organization"), ("entity/place", "entity/organization"),
    ("concept/concept", "concept/psychology", "concept/technology", "concept/pharma", "concept/model"), ("entity/person", "entity/company"), ("entity/person", "entity/organization"),
]


def affine(a: Column, b: Column) -> Column:
    out = F.lit(False)
    for group in AFFINE_TYPES:
        out = out | (a.isin(*group) & b.isin(*group))
    return out


# ---- merges of pages ----

def _counted(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("source")).agg(F.count("*").alias(name))


def merge_plan(pairs: DataFrame, pages: DataFrame, links: DataFrame, timeline: DataFrame, aliases: DataFrame, tags: DataFrame, mentions: DataFrame) -> DataFrame:
    """What merging ``source`` into ``target`` would do, for pairs whose pages both exist and differ: the conflict that blocks it (pages
    of records merge with records only; different types must be affine), whether the source's title becomes an alias, and how
    many links, events, aliases, merged tags and pages that mention it are touched. mentions: (slug, target) of wikilinks."""
    p = pages.select("slug", "type", "title")
    side = lambda name: p.select(F.col("slug").alias(name), F.col("type").alias(f"{name}_type"), F.col("title").alias(f"{name}_title"))
    out = pairs.select("source", "target").distinct().filter("source <> target").join(side("source"), "source").join(side("target"), "target")
    layer = lambda c: F.when(c == "record", "source").otherwise("derived")
    a, b = F.col("source_type"), F.col("target_type")
    conflict = F.when(layer(a) != layer(b), "cross_layer").when((a != b) & ~affine(a, b), "types")
    both = out.select("source", "target", F.explode(F.array("source", "target")).alias("slug"))
    merged = both.join(tags.select(F.col("page_slug").alias("slug"), "tag"), "slug").select("source", "target", "tag").distinct().groupBy("source", "target").agg(F.count("*").alias("tags"))
    named = out.select("source", F.explode(F.array_distinct(F.array("source", F.element_at(F.split("source", "/"), -1)))).alias("name")).distinct()
    seen = named.join(mentions.select("slug", F.col("target").alias("name")), "name").groupBy("source").agg(F.count_distinct("slug").alias("mentions"))
    counts = [_counted(links, "from_slug", "outgoing"), _counted(links, "to_slug", "incoming"), _counted(timeline, "page_slug", "events"), _counted(aliases, "page_slug", "aliases"), seen]
    out = out.withColumn("conflict", conflict).join(merged, ["source", "target"], "left")
    for c in counts:
        out = out.join(c, "source", "left")
    numbers = ["outgoing", "incoming", "events", "aliases", "tags", "mentions"]
    return out.fillna(0, numbers).select("source", "target", "conflict", F.col("conflict").isNull().cast("int").alias("allowed"), (F.col("source_title") != F.col("target_title")).cast("int").alias("new_alias"), *numbers)


def merge_residue(sources: DataFrame, pages: DataFrame, links: DataFrame, mentions: DataFrame) -> DataFrame:
    """What a merge left of each source page: its row, links at either end and wikilinks; clean if nothing."""
    own = sources.select("source").distinct()
    ends = links.select(F.explode(F.array_distinct(F.array("from_slug", "to_slug"))).alias("source")).join(own, "source", "left_semi").groupBy("source").agg(F.count("*").alias("links"))
    named = sources.select("source", F.explode(F.array_distinct(F.array("source", F.element_at(F.split("source", "/"), -1)))).alias("target")).distinct()
    seen = named.join(mentions.select("slug", "target"), "target").groupBy("source").agg(F.count("*").alias("mentions"))
    out = sources.select("source").distinct().join(pages.select(F.col("slug").alias("source"), F.lit(1).alias("page")), "source", "left").join(ends, "source", "left").join(seen, "source", "left").fillna(0)
    return out.withColumn("clean", ((F.col("page") == 0) & (F.col("links") == 0) & (F.col("mentions") == 0)).cast("int"))


# ---- jobs ----

def job_step(jobs: DataFrame, events: DataFrame, as_of: str, ttl_minutes: int = 30) -> DataFrame:
    """Jobs (id, status, attempts, max_attempts, started_at, result) after one event each (id, op, result): fail (pending until the
    attempts are used up, then failed), complete (results merged, new keys win), cancel (pending and running ones only), retry
    (failed ones only; attempts begin anew). Then running jobs older than ``ttl_minutes`` are pending again."""
    live, op = F.col("status").isin("pending", "running"), F.col("op")
    out = jobs.join(events.select("id", "op", F.col("result").alias("got")), "id", "left")
    status = (
        F.when(live & (op == "fail"), F.when(F.col("attempts") >= F.col("max_attempts"), "failed").otherwise("pending")).when(live & (op == "complete"), "done").when(live & (op == "cancel"), "cancelled")
        .when((F.col("status") == "failed") & (op == "retry"), "pending").otherwise(F.col("status"))
    )
    again = (F.col("status") == "failed") & (op == "retry")
    old = F.coalesce(F.col("result"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key(F.col("got"), k), F.lit(False))), F.col("got"))
    out = out.withColumn("merged", F.when(live & (op == "complete") & F.col("got").isNotNull(), merged).otherwise(F.col("result"))).withColumn("attempts", F.when(again, 0).otherwise(F.col("attempts")))
    out = out.withColumn("started_at", F.when(again, F.lit(None).cast("timestamp")).otherwise(F.col("started_at"))).withColumn("status", status)
    stale = (F.col("status") == "running") & (F.col("started_at") <= X.ts(as_of) - F.expr(f"INTERVAL {ttl_minutes} MINUTES"))
    return out.select("id", F.when(stale, "pending").otherwise(F.col("status")).alias("status"), "attempts", F.when(stale, F.lit(None).cast("timestamp")).otherwise(F.col("started_at")).alias("started_at"), F.col("merged").alias("result"))


def claim(jobs: DataFrame, n: int | None = 1) -> DataFrame:
    """The next n pending jobs, or all of them, as running with one more attempt."""
    pending = jobs.filter("status = 'pending'")
    mine = pending if n is None else pending.orderBy(F.desc("priority"), "id").limit(n)
    return mine.withColumn("status", F.lit("running")).withColumn("attempts", F.col("attempts") + 1)


def work(jobs: DataFrame, run, as_of: str, rounds: int | None = None, most: int | None = None) -> DataFrame:
    """A worker's rounds over jobs (id, status, attempts, max_attempts, priority, started_at, result): in each it claims the pending ones (or
    the ``most`` that come next), ``run`` gives one event for each (id, op, result), and their states move on. It ends when nothing is
    pending, or after ``rounds``. Cancelled jobs are never claimed; one that is cancelled while it runs ends at the round's end."""
    done = 0
    while rounds is None or done < rounds:
        mine = cut(claim(jobs, most))
        if not mine.limit(1).count():
            break
        after = job_step(mine, run(mine), as_of).join(mine.select("id", "priority", "max_attempts"), "id")
        # without a limit, what was pending is what was claimed
        rest = jobs.filter("status <> 'pending' OR status IS NULL") if most is None else jobs.join(mine.select("id"), "id", "left_anti")
        jobs = cut(rest.unionByName(after.select(jobs.columns)))
        done += 1
    return jobs


# ---- recommendation records ----

def canonical_json(fields: Column) -> Column:
    """JSON of a map of strings with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))))


def record_fingerprint(payload: Column) -> Column:
    return F.sha2(canonical_json(payload), 256)


# Where a record's life may go from each state.
LIFECYCLE = {"pending": ["current", "superseded", "rejected", "invalidated"], "current": ["superseded", "rejected", "invalidated"], "superseded": ["invalidated"], "rejected": ["invalidated"], "invalidated": []}


def store_records(records: DataFrame, proposals: DataFrame, now: str) -> DataFrame:
    """records (record_id, key, fingerprint, lifecycle, suppressed_until, seq) after proposals (record_id, key, payload map), one a key:
    the same content as the active record changes nothing; content that was rejected stays out while it is suppressed (for ever if
    without an end); else the proposal is pending and supersedes the active record. All rows come back, with what was done."""
    new = proposals.withColumn("fingerprint", record_fingerprint(F.col("payload"))).select("record_id", "key", "fingerprint")
    live = F.col("lifecycle").isin("pending", "current")
    active = first_by(records.filter(live), ["key"], F.desc("seq")).select("key", F.col("record_id").alias("active_id"), F.col("fingerprint").alias("active_print"))
    held = records.filter((F.col("lifecycle") == "rejected") & (F.col("suppressed_until").isNull() | (F.col("suppressed_until") > X.ts(now)))).select("key", "fingerprint").distinct().withColumn("held", F.lit(True))
    plan = new.join(active, "key", "left").join(held, ["key", "fingerprint"], "left")
    done = F.when(F.col("active_print") == F.col("fingerprint"), "unchanged").when(F.col("held"), "suppressed").otherwise("created")
    plan = plan.withColumn("done", done)
    out = plan.filter("done = 'created'").select("active_id", F.lit(True).alias("replaced")).filter("active_id is not null")
    kept = records.join(out.withColumnRenamed("active_id", "record_id"), "record_id", "left")
    kept = kept.select("record_id", "key", "fingerprint", F.when(F.col("replaced"), "superseded").otherwise(F.col("lifecycle")).alias("lifecycle"), F.when(F.col("replaced"), "superseded").otherwise("kept").alias("done"))
    added = plan.select("record_id", "key", "fingerprint", F.when(F.col("done") == "created", "pending").alias("lifecycle"), "done")
    return kept.unionByName(added)


def lifecycle_step(records: DataFrame, moves: DataFrame, suppress_days: int = 30) -> DataFrame:
    """records (record_id, lifecycle) after moves (record_id, to, at): illegal ones change nothing and are marked; a rejection is
    suppressed for so many days."""
    legal = F.lit(False)
    for state, to in LIFECYCLE.items():
        if to:
            legal = legal | ((F.col("lifecycle") == state) & F.col("to").isin(*to))
    out = records.join(moves, "record_id", "left").withColumn("ok", F.when(F.col("to").isNotNull(), legal))
    until = F.when(F.col("ok") & (F.col("to") == "rejected"), F.col("at") + F.expr(f"INTERVAL {suppress_days} DAYS"))
    return out.select("record_id", F.when(F.col("ok"), F.col("to")).otherwise(F.col("lifecycle")).alias("lifecycle"), F.col("ok").cast("int").alias("ok"), until.alias("suppressed_until"))


AXES = ("evidence", "constraint", "option", "dependency", "conclusion")


def record_axes(records: DataFrame, fields: dict[str, Sequence[str]]) -> DataFrame:
    """(record, axis, key, value) of records: the columns of each axis as text, nulls left out."""
    rows = [F.struct(F.lit(axis).alias("axis"), F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for axis in AXES for c in fields.get(axis, ())]
    return records.select("record", F.explode(F.array(*rows)).alias("r")).select("record", "r.*").filter("value is not null")


def record_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(record, axis, key, change, before, after) of two states given as ``record_axes``, for records that both hold."""
    both = before.select("record").distinct().join(after.select("record").distinct(), "record")
    on = ["record", "axis", "key"]
    j = before.join(both, "record").withColumnRenamed("value", "before").join(after.join(both, "record").withColumnRenamed("value", "after"), on, "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return j.withColumn("change", change).filter("change is not null").select(*on, "change", "before", "after")


def replay(records: DataFrame, rule: Column, conclusion: str = "conclusion", inputs: str = "inputs", inputs_hash: str = "inputs_hash") -> DataFrame:
    """Whether each record is intact (the hash of its inputs map is the stored one) and its rule still concludes the same."""
    intact = F.col(inputs_hash) == record_fingerprint(F.col(inputs))
    status = F.when(~intact, "corrupt").when(rule.eqNullSafe(F.col(conclusion)), "same").otherwise("differs")
    return records.select("record", status.alias("status"))


# ---- action drafts ----

# What is shown for each kind of discovery: its title, and what to do with it.
DISCOVERY_DISPLAY = {
    "bridge": ("有一组潜在关联待筛选", "可先查看最多 3 条当前高优先级关联线索并核对依据；展示后请你确认补链或忽略，确认前不修改。"),
    "trend": ("有一组关注变化待核对", "可先查看最多 3 条当前高优先级变化并核对近期记录；展示后请你确认更新或忽略，确认前不修改。"),
    "gap": ("有一组记忆内容待补全", "可先查看最多 3 条当前高优先级待补全项并核对已有内容；展示后请你确认先补充哪一项，确认前不修改。"),
    "contradiction": ("有一组信息冲突待核对", "可先查看最多 3 条当前高优先级冲突并核对来源；展示后请你确认保留哪个有证据的版本，确认前不修改。"),
    "knowledge_map_isolation": ("有一组孤立记忆待确认", "可先查看最多 3 条当前高优先级孤立记忆并核对依据；展示后请你确认补充关联或保持不变，确认前不修改。"),
    "knowledge_map_bridge": ("有一组跨领域连接待复核", "可先查看最多 3 条当前高优先级跨领域连接并核对依据；展示后请你确认保留或加强，确认前不修改。"),
    "similar_entity": ("有一组可能重复项待核对", "可先查看最多 3 条当前高优先级重复候选并做只读比较；展示后请你确认合并或分别保留，确认前不修改。"),
    "community_crossing": ("有一组跨主题线索待核对", "请先核对这组跨主题线索的证据；展示后请你确认记录或忽略，确认前不修改。"),
    "structural_hole": ("有一组知识缺口线索待核对", "请先核对这组知识缺口线索的证据；展示后请你确认补充或忽略，确认前不修改。"),
}
# Why it is shown; kinds that are always worth it.
RECURRING, IMPORTANT = "同类信号已经多次出现，值得优先核对。", "这项信号的重要程度较高，但仍需人工核对。"
ALWAYS = ("similar_entity", "knowledge_map_isolation", "knowledge_map_bridge", "contradiction")
# Titles of health drafts by how the finding is repaired.
HEALTH_DISPLAY = {"blocked": "有一项健康检查被前置条件阻塞", "auto_repairable": "有一项修复建议可以先预览", "needs_review": "有一项健康问题需要人工确认"}
DRAFT = ("type", "ref", "score", "actionable", "title", "reason", "action", "source", "kind")


def discovery_drafts(discoveries: DataFrame) -> DataFrame:
    """Drafts of reviews from discoveries (id, type, score, actionable, occurrence_count, dedup_key, has_actions): of kinds that can be
    shown, if they are of high value, recur, or come with actions. Other kinds, quiet ones among them, give none."""
    dim = discoveries.sparkSession.createDataFrame([(k, *v) for k, v in DISCOVERY_DISPLAY.items()], "type string, title string, suggestion string")
    times = F.when(F.col("occurrence_count") >= 1, F.col("occurrence_count")).otherwise(1)
    worth = (F.col("actionable") == "high") | (F.coalesce("occurrence_count", F.lit(1)) >= 3) | F.coalesce(F.col("has_actions"), F.lit(False)) | F.col("type").isin(*ALWAYS)
    out = discoveries.filter(worth).join(F.broadcast(dim), "type")  # nine rows
    ref = F.concat(F.lit("discovery:"), F.coalesce("dedup_key", F.col("id").cast("string")))
    level = F.when(F.col("actionable").isin("high", "medium"), F.col("actionable")).otherwise("low")
    return out.select(F.lit("action_review_discovery").alias("type"), ref.alias("ref"), X.clamp(F.col("score"), 0.1, 1.0).alias("score"), level.alias("actionable"), "title",
                      F.when(times >= 3, RECURRING).otherwise(IMPORTANT).alias("reason"), F.lit("review").alias("action"), F.lit("discovery").alias("source"), F.col("type").alias("kind"))


def health_drafts(actions: DataFrame) -> DataFrame:
    """Drafts from a repair plan's actions (dimension, kind, group, severity, slug, code): a preview of those that repair themselves, a
    review of all others; those that are only observed give none."""
    dim = actions.sparkSession.createDataFrame(list(HEALTH_DISPLAY.items()), "shown string, title string")
    use = actions.filter("group <> 'observe_only'").withColumn("shown", F.when(F.col("group").isin("blocked", "auto_repairable"), F.col("group")).otherwise("needs_review")).join(F.broadcast(dim), "shown")
    slug = F.when((F.col("slug") != "") & (F.col("slug") != "-"), F.col("slug"))
    kind = F.coalesce("kind", "group")
    ref = F.concat_ws(":", F.lit("health"), "dimension", kind, F.coalesce(F.col("code"), slug, F.lit("global")))
    auto = F.col("group") == "auto_repairable"
    score = F.when(F.col("severity") == "high", 0.9).when(F.col("severity") == "medium", 0.6).otherwise(0.3)
    level = F.when(F.col("severity").isin("high", "medium"), F.col("severity")).otherwise("low")
    reason = F.when(auto, "预览这项修复，不自动执行。").otherwise("复核这项健康信号是否需要后续处理。")
    return use.select(F.when(auto, "action_repair_preview").otherwise("action_health_review").alias("type"), ref.alias("ref"), score.alias("score"), level.alias("actionable"), "title", reason.alias("reason"),
                      F.when(auto, "dry_run").otherwise("review").alias("action"), F.lit("health").alias("source"), kind.alias("kind"))


# ---- batches ----

def batch_results(pages: DataFrame, operations: DataFrame) -> DataFrame:
    """operations (id, op, slug, target) with their result: ok, missing (no such page) or invalid (a link or merge with itself)."""
    have = pages.select("slug").distinct().withColumn("has", F.lit(1))
    out = operations.join(have, "slug", "left").join(have.select(F.col("slug").alias("target"), F.col("has").alias("has_target")), "target", "left")
    bad = F.col("op").isin("link", "merge") & (F.col("slug") == F.col("target"))
    missing = F.col("has").isNull() | (F.col("op").isin("link", "merge") & F.col("has_target").isNull())
    return out.select("id", "op", "slug", "target", F.when(bad, "invalid").when(missing, "missing").otherwise("ok").alias("result"))


def apply_batch(pages: DataFrame, links: DataFrame, operations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages and links (from_slug, to_slug, relation) after the operations that are ok. A page's first operation that removes it counts;
    merged pages hand their links on (one step: a target that is itself removed takes them with it), deleted ones lose them,
    and links that collapse, repeat or lack an end go."""
    ok = batch_results(pages, operations).filter("result = 'ok'")
    gone = first_by(ok.filter("op in ('delete', 'merge')"), ["slug"], "id").select(F.col("slug").alias("gone"), F.when(F.col("op") == "merge", F.col("target")).alias("into"))
    kept = pages.join(gone.withColumnRenamed("gone", "slug"), "slug", "left_anti")
    new = ok.filter("op = 'link'").select(F.col("slug").alias("from_slug"), F.col("target").alias("to_slug"), F.lit("mentions").alias("relation"))
    out = links.select("from_slug", "to_slug", "relation").unionByName(new)
    for end in ("from_slug", "to_slug"):
        out = out.join(gone.select(F.col("gone").alias(end), F.col("into").alias(f"{end}_into"), F.lit(True).alias(f"{end}_gone")), end, "left")
        out = out.withColumn(end, F.when(F.col(f"{end}_gone"), F.col(f"{end}_into")).otherwise(F.col(end))).drop(f"{end}_into", f"{end}_gone").filter(F.col(end).isNotNull())
        out = out.join(gone.select(F.col("gone").alias(end)), end, "left_anti")
    return kept, out.filter("from_slug <> to_slug").select("from_slug", "to_slug", "relation").distinct()


# ---- extracted entities ----

# Words that name nothing by themselves.
GENERIC_TERMS = [
    "现实", "个体", "未来", "痛苦", "梦想", "成功", "失败", "优秀", "勇气", "自由", "幸福", "希望", "命运", "真理", "价值", "意义", "智慧", "经验", "能力", "力量", "快乐", "焦虑", "爱", "恨", "恐惧", "信任", "尊重",
    "历史", "经济", "文化", "教育", "科学", "社会", "政治", "技术", "环境", "市场", "艺术", "哲学", "宗教", "法律", "道德",
    "人类", "世界", "问题", "方法", "人", "生活", "时间", "工作", "中国", "美国", "公司", "团队", "国家", "政府", "组织", "系统", "数据", "信息", "知识", "机器", "人工智能", "企业",
    "AI", "AI工具", "AI技术", "AI应用", "数字化转型", "智能化转型", "供应链数字化", "领导力", "沟通", "学习", "思考", "创新", "责任", "成长", "进步", "改变", "发展", "资源", "效率", "品牌", "专业",
]
# Words of a document's structure.
STRUCTURAL_TERMS = [
    "组织架构", "人员汇总", "时间线", "概述", "总结", "目录", "备注", "摘要", "简介", "附录", "参考资料", "相关链接", "标签", "分类", "基本信息", "详细内容", "背景", "目的", "范围", "方法", "结论",
    "数据", "统计", "分析", "对比", "趋势", "报告", "详情", "工作经历", "教育经历", "项目经验", "技能专长", "自我评价", "联系方式", "个人简介", "人物简介", "公司简介", "产品介绍", "核心业务", "主营业务", "发展历程", "企业愿景", "使命愿景",
]
# Patterns of names that are filtered, with the reason; and of organisations.
JOB_TITLE = "经理|总监|代表|主管|专员|主任|总裁|负责人|工程师|顾问|人员|管理员|作家"
DATED = r"\d{4}[年.\-/]\d{1,2}[月日]?"
GENERIC_SUFFIX = "化$|型$|式$|制$|主义$|体系$|模式$|战略$|策略$|趋势$|生态$|矩阵$|框架$|架构$"
ORGANISATION = "公司|集团|制药|药企|银行|保险|基金$|医院|大学$|学院$|研究所"
ENTITY_KINDS = ("person", "company", "organization", "location", "place", "product", "drug", "book", "disease")
CONCEPT_KINDS = ("model", "pharma", "psychology", "technology", "concept")


def extracted_entities(candidates: DataFrame, entities: int = 10, concepts: int = 8, automatic: bool = False) -> DataFrame:
    """Candidates (doc, pos, name, kind, relevance) with the reason why each is filtered, null for those kept: names that name nothing,
    low relevance (automatically: medium too), and what is beyond the most relevant entities and concepts of a document."""
    n, kind = F.col("name"), F.col("kind")
    concrete = kind.isin(*ENTITY_KINDS)
    drop = (
        F.when(n.isin(*GENERIC_TERMS), "blacklisted").when(F.length(n) < 2, "too_short").when(n.rlike(r"^\d+$|^#\d+$") | n.rlike(r"(?i)^v\d+$"), "numeric").when(n.contains("@"), "unclassified_type")
        .when(n.rlike(r"^[a-z][a-z0-9]{10,}$"), F.when(kind != "concept", "hash_like").otherwise("unclassified_type")).when(n.rlike("^[A-Z]{2}$") & (kind != "concept"), "two_letter_code").when(n.rlike(JOB_TITLE), "job_title")
        .when(n.rlike(DATED), "date_pattern").when(n.isin(*STRUCTURAL_TERMS), "structural_term").when(~concrete & n.rlike(GENERIC_SUFFIX), "generic_suffix")
    )
    family = F.when(n.rlike(ORGANISATION), "entity").when(kind.isin(*CONCEPT_KINDS), "concept").when(concrete, "entity")
    out = candidates.withColumn("drop", drop).withColumn("family", F.when(F.col("drop").isNull(), family))
    out = out.withColumn("drop", F.coalesce("drop", F.when(F.col("family").isNull(), "unclassified_type"), F.when(F.coalesce("relevance", F.lit("low")).isin("high", "medium"), F.lit(None)).otherwise("low_relevance")))
    if automatic:
        out = out.withColumn("drop", F.coalesce("drop", F.when(F.col("relevance") == "medium", "auto_medium_skipped")))
    order = Window.partitionBy("doc", F.col("drop").isNull(), "family").orderBy(F.when(F.col("relevance") == "high", 0).otherwise(1), "pos")
    most = F.when(F.col("family") == "concept", concepts).otherwise(entities)
    capped = F.when(F.row_number().over(order) > most, F.concat("family", F.lit("_cap")))
    return out.withColumn("reason", F.coalesce("drop", capped)).select("doc", "pos", "name", "family", "reason")
