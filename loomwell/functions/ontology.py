"""Entity and relation types as small dimension tables built from literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

P, C, O = "entity/person", "entity/company", "entity/organization"  # noqa: E741
# Types with their parents.
TYPES = [
    ("entity", None), (P, "entity"), (C, "entity"), (O, "entity"), ("entity/location", "entity"), ("entity/place", "entity"), ("entity/product", "entity"), ("entity/drug", "entity"), ("entity/book", "entity"), ("entity/disease", "entity"),
    ("concept", None), ("concept/model", "concept"), ("concept/pharma", "concept"), ("concept/psychology", "concept"), ("concept/technology", "concept"), ("concept/concept", "concept"), ("record", None), ("insight", None), ("topic", "concept"),
]
# Relations with domain, range, symmetric, transitive, strength, weight, reverse.
RELATIONS = [
    ("认识", [P], [P], True, False, "weak", 0.3, None), ("下属", [P], [P], False, True, "strong", 1.0, "上级"), ("上级", [P], [P], False, True, "strong", 1.0, "下属"), ("同学", [P], [P], True, False, "medium", 0.5, None),
    ("同事", [P], [P], True, False, "medium", 0.5, None), ("亲属", [P], [P], False, False, "strong", 0.8, None), ("导师", [P], [P], False, True, "strong", 0.8, None), ("出生", [P], ["entity/location"], False, False, "strong", 1.0, None),
    ("任职", [P], [C, O], False, False, "strong", 1.0, None), ("创立", [P], [C, O], False, False, "strong", 1.0, None), ("归属", [C, O], [C, O], False, True, "strong", 1.0, None), ("合作", [C, O, P], [C, O, P], True, False, "medium", 0.7, None),
    ("竞争", [C, O, "entity/product"], [C, O, "entity/product"], True, False, "medium", 0.7, None), ("客户", [C, O], [C, O], False, False, "medium", 0.7, None), ("投资", [C, O, P], [C, O], False, False, "medium", 0.7, None),
    ("收购", [C], [C], False, False, "strong", 1.0, None), ("供应", [C], [C, "entity/product"], False, False, "medium", 0.7, None), ("制造", [C, O], ["entity/product", "entity/drug"], False, False, "medium", 0.7, None),
    ("居住", [P], ["entity/location"], False, False, "medium", 0.5, None), ("提及", [], [], False, False, "weak", 0.3, None),
]
# Other names of relations.
ALIASES = {"knows": "认识", "汇报给": "上级", "领导": "上级", "boss": "上级", "works_at": "任职", "joined": "任职", "founded": "创立", "founded_by": "创立", "part_of": "归属", "subsidiary_of": "归属", "partnered_with": "合作", "competitor": "竞争", "invested_in": "投资", "acquired": "收购", "uses": "制造", "manufactured_by": "制造"}
GENERIC = "提及"
DEFAULT_STRENGTH, DEFAULT_WEIGHT = "weak", 0.3


def relation_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RELATIONS, "relation string, domain array<string>, range array<string>, symmetric boolean, transitive boolean, strength string, weight double, reverse string")


def alias_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*ALIASES.items(), *((r[0], r[0]) for r in RELATIONS)], "name string, relation string")


def type_closure(spark: SparkSession) -> DataFrame:
    """(type, ancestor), each type being an ancestor of itself."""
    parent = dict(TYPES)
    rows = []
    for t in parent:
        a: str | None = t
        while a:
            rows.append((t, a))
            a = parent[a]
    return spark.createDataFrame(rows, "type string, ancestor string")


def canonical(links: DataFrame, column: str = "relation") -> DataFrame:
    """Relations by their canonical names; unknown ones become the generic mention. Dimension tables are fixed and tiny."""
    dim = alias_dim(links.sparkSession).withColumnRenamed("relation", "_canonical")
    return links.join(F.broadcast(dim), links[column] == dim["name"], "left").withColumn("canonical", F.coalesce("_canonical", F.lit(GENERIC))).drop("_canonical", "name")


def endpoint_check(links: DataFrame) -> DataFrame:
    """Links (canonical, from_type, to_type) with ``fits``: each end's type or an ancestor must be allowed; no constraint allows all; an
    unknown relation fits nothing."""
    dim = relation_dim(links.sparkSession).select(F.col("relation").alias("canonical"), "domain", "range")
    up = {t: [] for t, _ in TYPES}
    for t, a in ((t, a) for t, _ in TYPES for a in _ancestors(t)):
        up[t].append(a)
    table = F.create_map(*[x for t, a in up.items() for x in (F.lit(t), F.array(*[F.lit(y) for y in a]))])
    ok = lambda kind, allowed: (F.size(allowed) == 0) | F.coalesce(F.arrays_overlap(F.element_at(table, F.col(kind)), F.col(allowed)), F.lit(False))
    out = links.join(F.broadcast(dim), "canonical", "left")
    return out.withColumn("fits", F.coalesce(ok("from_type", "domain") & ok("to_type", "range"), F.lit(False)).cast("int")).drop("domain", "range")


def _ancestors(t: str) -> list[str]:
    parent, out = dict(TYPES), []
    a: str | None = t
    while a:
        out.append(a)
        a = parent[a]
    return out
