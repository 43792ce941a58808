"""Routing of queries, content classes and display safety: pure column expressions over fixed pattern tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Routes in order, with the next tool and the patterns of their signals.
ROUTES = [
    ("debug_search", "query", [r"\bdebug\b|调试|诊断", r"关键词.*(在哪|出现|索引)|搜索结果|原始搜索|查.*slug|raw search|keyword search"]),
    ("episodic_recall", "recall_episode", [r"想不起名字|不记得名字|叫什么来着|那个人是谁|那个.*是谁", r"见过谁|认识谁|遇到.*谁|活动.*人|一起.*的人"]),
    ("hierarchy", "get_org_tree", [r"组织架构|汇报线|架构图|层级", r"上级|下属|汇报给|向.*汇报|谁管|管理.*谁", r"reports to|direct reports|org chart|reporting line"]),
    ("grounded_recall", "deep_recall", [r"讨论过吗|聊过吗|有记录吗|有依据吗|是不是真的|是否真实|是否准确", r"有没有遗漏|有什么遗漏|矛盾吗|冲突吗|为什么这么定|上次怎么定"]),
    ("content_recall", "deep_recall", [r"当时.*(怎么设计|为什么选|怎么定|怎么做)|之前.*(怎么设计|为什么选|具体怎么说)", r"具体方案|具体内容|原来怎么说|当时怎么说|怎么设计的"]),
    ("relationship", "agentic_research", [r"什么关系|什么联系|有什么联系|有关系吗|之间.*关系|之间.*联系", r"relationship|connected to|how.*(related|connected)|link between"]),
    ("reasoning", "agentic_research", [r"帮我判断|怎么看|是否合理|有无风险|盲区|优缺点", r"对比|区别|哪个更|\bvs\b|compare|difference|differ"]),
    ("overview", "summarize", [r"总结|梳理|复盘|全面了解|概览|全貌", r"有哪些关键|生态|脉络|整体情况", r"summarize|review of|overview|walk me through"]),
]

# Intents of a query in order of precedence: (mode, intent, keywords).
INTENTS = [
    ("agentic", "comparison", ["对比", "区别", "哪个好", "哪个更", "vs", "VS", "compare", "difference", "differ"]),
    ("agentic", "gap_analysis", ["还", "有没有", "缺什么", "不足", "盲区", "遗漏", "不知道"]),
    ("agentic", "relationship", ["关系", "联系", "之间", "关联", "relationship", "connected"]),
    ("agentic", "review", ["复盘", "总结", "回顾", "变化", "进展", "summarize", "overview", "review of", "walk me through"]),
    ("hybrid", "timeline", ["最近", "什么时候", "上次", "下次", "上周", "这周", "时间线", "last time", "previously", "what changed"]),
]

# Time and history wording.
TEMPORAL = r"之前|上次|下次|上周|这周|最近|后来|曾经|以前|当时|原来|时间线|什么时候|变化|进展|动态|last time|previously|before|what changed|changed"
HISTORY = r"为什么这么定|当时.*(怎么设计|为什么选|怎么定|怎么做|怎么说)|之前.*(怎么设计|为什么选|具体怎么说|为什么这么定)|原来怎么说|怎么设计的|why.*(decided|chosen)|what was the reasoning|how was.*decided"
FIRST_PERSON = r"我(?!们)|(?i)\b(?:I|my|mine|myself)\b"

# A comparison is also meant by this structure, unless it is only an adverb.
COMPARISON_ADVERB = r"比较(重要|好|像|类似|复杂|大|小|多|少|强|弱|快|慢|新|旧|长|短|高|低|常见|明显|简单|稳定|活跃|特殊|普通|关键|主流|合理|接近)"
COMPARISON_STRUCTURE = r"(?s)比较.{0,15}(和|与|跟)|(和|与|跟).{0,15}比较(一下)?"

# What must not be displayed: internal names first, then credentials and paths.
UNSAFE = [
    r"(?i)\bscore\b", r"(?i)\bdedup_key\b", r"(?i)\bdebug\b", r"(?i)\bmetadata\b", r"(?i)\bsql\b", r"(?i)\bselect\s+\*\s+from\b",
    r"(?i)\b(?:drop|delete|insert|update|truncate|alter)\s+(?:table|from|into|index)\b", r"(?i)\bentity/[^\s]+", r"(?i)\bconcept/[^\s]+", r"(?i)\brecords?/",
    r"/Users/", r"[A-Z]:\\", r"(?:^|[\s\"'`(])/[^/\s\"'`()]", r"(?i)/(?:etc|root|var|proc|sys|home|tmp|opt|usr|private|mnt|srv|boot|dev)/",
    r"(?i)\b(?:sk-|Bearer\s+)[A-Za-z0-9._-]{8,}", r"(?i)\b(?:password|passwd|secret|api[_-]?key|access[_-]?token)\s*[=:]\s*\S+", r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"\bAKIA[0-9A-Z]{16}\b", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\b",
]
# Fixed value: values that name a page by its path.
PAGE_PATH = r"(?i)(?:brain/)?(?:entities|concepts|insights|records|events)/[^\s/]+"

# What no entity name is: short Latin, endings of fragments and particles, beginnings with verbs and generic words, function
# words, questions, commands, cut phrases and titles.
NAME_REJECT = [
    r"^[A-Za-z]{1,2}$",
    r"(?:下个|上个|这个|那个|什么|如何|怎么|怎样|的话|的人|的事)$",
    r"[的了就完或吧吗呢啊嘛及与把会被]$",
    r"^(?:用|把|被|让|从|在|对|跟|和|考虑|想着|假定|需要|应该|可以|能够|不会|不要|别|就不要|不能|可能|已经|还是|只是|就是|都是|还要|也要|就会|就能|才能|还会|还能|也可|也可|也不|也没|都|就|也|还|又|再|才|只|没)$",
    r"^(?:一家|某个|某些|那些|这些|自己的|别人的|所有|每个|任何|什么|怎么|某种|各种|一些|全部|整个)$",
    r"^(?:必须|一定|当然|确实|真的|非常|很|太|更|最|比较|有些|一点|一下|一会|一直|经常|总是|从来|从不|已经|将要|正在|暂时|永久|永远|马上|立刻|突然|终于|最后|还是|还|也|都)$",
    r"^(?:如何|怎么|怎样|什么|哪个|哪里|为什么|是否|能否|可否|要不要|能不能|是不是)",
    r"^(?:不要|别|请|必须|应该|需要)..",
    r"[把被让给对跟和与]$",
    r"[：]",
]


def valid_name(c: Column) -> Column:
    n = F.trim(c)
    ok = (F.length(n) >= 2) & (F.length(n) <= 18)
    for p in NAME_REJECT:
        ok = ok & ~n.rlike(p)
    return ok


def display_safe(c: Column, fallback: str) -> Column:
    hit = F.lit(False)
    for p in UNSAFE:
        hit = hit | c.rlike(p)
    return F.when(hit, fallback).otherwise(c)


def safe_value(c: Column, fallback: str) -> Column:
    """A value for structured output: control and format characters go, compatibility forms are unified, unsafe values are replaced."""
    from loomwell.functions import lexical

    clean = lexical.nfkc(F.regexp_replace(c, r"[\p{Cc}\p{Cf}]", ""))
    return F.when(clean.rlike(PAGE_PATH), fallback).otherwise(display_safe(clean, fallback))


def front_door(queries: DataFrame) -> DataFrame:
    """The route of each query: most signals, then the order of the routes; confidence min(.65 + .15 n, .95)."""
    q = F.trim("query")
    cols = [F.struct((-sum((q.rlike("(?i)" + p)).cast("int") for p in patterns)).alias("neg"), F.lit(i).alias("i"), F.lit(route).alias("route"), F.lit(tool).alias("tool")) for i, (route, tool, patterns) in enumerate(ROUTES)]
    best = F.array_min(F.array(*cols))
    n = -F.col("b.neg")
    empty, none = q == "", n == 0
    return queries.withColumn("b", best).select(
        "query", F.when(empty, "debug_search").when(none, "content_recall").otherwise(F.col("b.route")).alias("route"),
        F.when(empty, "query").when(none, "deep_recall").otherwise(F.col("b.tool")).alias("next_tool"),
        F.when(empty, 0.4).when(none, 0.55).otherwise(F.least(F.lit(0.95), 0.65 + 0.15 * n)).alias("confidence"),
    )


def route(queries: DataFrame, known: DataFrame) -> DataFrame:
    """(mode, intent) of queries; ``known``: (query, n_known, exact) from name resolution."""
    q = F.col("query")
    mode, intent = F.when(F.trim("query") == "", "hybrid").when(F.col("exact"), "fast"), F.when(F.trim("query") == "", "keyword").when(F.col("exact"), "entity_lookup")
    for m, name, words in INTENTS:
        hit = F.lit(False)
        for w in words:
            hit = hit | q.contains(w)
        if name == "comparison":
            hit = hit | (q.rlike(COMPARISON_STRUCTURE) & ~q.rlike(COMPARISON_ADVERB))
        mode = mode.when(hit, F.when(F.col("n_known") >= 1, "agentic").otherwise("hybrid") if name == "timeline" else F.lit(m))
        intent = intent.when(hit, name)
    mode, intent = mode.when(F.col("n_known") == 1, "fast").otherwise("hybrid"), intent.when(F.col("n_known") == 1, "entity_lookup").otherwise("keyword")
    joined = queries.join(known, "query", "left").fillna(0, ["n_known"]).withColumn("exact", F.coalesce("exact", F.lit(False)))
    return joined.select("query", mode.alias("mode"), intent.alias("intent"))


def temporal_intent(queries: DataFrame) -> DataFrame:
    q = F.col("query")
    return queries.select("query", q.rlike(TEMPORAL).cast("int").alias("temporal"), q.rlike(HISTORY).cast("int").alias("history"), q.rlike(FIRST_PERSON).cast("int").alias("first_person"))


def rank_within(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
