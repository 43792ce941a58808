"""Direct writes of knowledge: batches of requests about subjects, with stubs for unknown names and a receipt for each request.

A store's tables grow by parts: a batch writes its own rows of pages, facts, links, notes and receipts, and one commit puts all parts into
the manifest. What is read of facts and links is the last row of a key, by the batch's number and the place in it. A batch that is written
again, under the same id, writes nothing and gives the receipts that it gave.

Names are resolved for the whole batch at once, against the pages and aliases that are there, and then against what the batch itself makes:
names that lead to one slug are one stub, titled as the first request spells it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwell.functions import ontology
from loomwell.operators import knowledge, relational
from loomwell.operators.lineage import cut

# Fields that facts must not set, and types that a hint can ask for (else a person).
RESERVED = ("slug", "type", "title", "file_path", "content_hash", "links", "reports_to", "tags", "created_at", "updated_at", "tier", "mention_count")
HINTS = {"person": "entity/person", "company": "entity/company", "organization": "entity/organization", "location": "entity/location", "product": "entity/product", "concept": "concept/concept"}
PERSON, MANAGER = "entity/person", "reports_to"

SCHEMAS = {
    "pages": "slug string, title string, type string, batch long",
    "facts": "slug string, field string, value string, batch long, place long",
    "links": "from_slug string, to_slug string, relation string, source_type string, context string, batch long, place long",
    "notes": "slug string, note string, source_type string, batch long, place long",
    "receipts": "id long, subject string, slug string, action string, total long, succeeded long, failed long, stubs long, batch long",
}
REQUEST = "id, subject, subject_type, facts, relations, reports_to, reports_to_type, note, evidence, source_type"


def kind_of(hint: Column) -> Column:
    known = F.create_map(*[F.lit(x) for item in HINTS.items() for x in item])
    return F.coalesce(known[F.lower(hint)], F.when(hint.rlike(r"^(entity|concept)/"), hint), F.lit(PERSON))


def mentioned(requests: DataFrame) -> DataFrame:
    """(name, hint, id, place) of every name in requests, subjects before targets before managers."""
    subject = requests.select(F.col("subject").alias("name"), F.col("subject_type").alias("hint"), "id", F.lit(0).alias("place"))
    target = requests.select("id", F.posexplode("relations").alias("place", "r")).select(F.col("r.target").alias("name"), F.col("r.target_type").alias("hint"), "id", (F.col("place") + 1).alias("place"))
    manager = requests.select(F.col("reports_to").alias("name"), F.col("reports_to_type").alias("hint"), "id", F.lit(1 << 20).alias("place"))
    return subject.unionByName(target).unionByName(manager).filter(F.trim("name") != "")


def resolve(requests: DataFrame, pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, slug, action, title, type): resolved, or stub_created. One row a name; the first request that has it says the type."""
    order = F.struct("id", "place")
    names = mentioned(requests).groupBy("name").agg(F.min(order).alias("first"), F.min_by("hint", order).alias("hint"))
    found = relational.resolve_names(names.select("name"), pages, aliases).select("name", F.col("slug").alias("known"))
    rows = names.join(found, "name")
    made = F.concat(kind_of(F.col("hint")), F.lit("/"), knowledge.slug_name(F.col("name")))
    rows = rows.withColumn("slug", F.coalesce("known", made)).join(pages.select("slug", F.lit(True).alias("there")), "slug", "left")
    new = F.col("known").isNull() & F.col("there").isNull()  # another spelling can lead to a page that is there
    stubs = rows.filter(new).groupBy("slug").agg(F.min_by("name", "first").alias("title"), F.min_by(kind_of(F.col("hint")), "first").alias("type"))
    return rows.join(stubs, "slug", "left").select("name", "slug", F.when(new, "stub_created").otherwise("resolved").alias("action"), "title", "type")


def apply(requests: DataFrame, resolved: DataFrame) -> dict[str, DataFrame]:
    """What requests write: facts, links, notes, and results(id, ok) of each thing asked. Facts need a field that is not reserved and a value;
    relations a known name and two pages; a manager another page; a note some text."""
    slug = lambda name, to: resolved.select(F.col("name").alias(name), F.col("slug").alias(to))
    own = requests.join(slug("subject", "own"), "subject")
    facts = own.select("id", "own", F.posexplode("facts").alias("place", "f")).select("id", F.col("own").alias("slug"), F.col("f.field").alias("field"), F.col("f.value").alias("value"), "place")
    facts = facts.withColumn("ok", ~F.coalesce(F.col("field"), F.lit("")).isin("", *RESERVED) & (F.coalesce(F.trim("value"), F.lit("")) != ""))
    known = F.broadcast(ontology.alias_dim(requests.sparkSession).select("name", F.col("relation").alias("canonical")))  # fixed
    links = own.select("id", "own", "evidence", "source_type", F.posexplode("relations").alias("place", "r")).select("id", "own", "evidence", "source_type", "place", F.col("r.target").alias("target"), F.col("r.relation").alias("name"))
    links = links.join(slug("target", "to_slug"), "target", "left").join(known, "name", "left").withColumn("ok", F.coalesce(F.col("canonical").isNotNull() & (F.col("to_slug") != F.col("own")), F.lit(False)))
    links = links.select("id", F.col("own").alias("from_slug"), "to_slug", F.col("canonical").alias("relation"), "source_type", F.col("evidence").alias("context"), "place", "ok")
    managers = own.filter(F.trim("reports_to") != "").join(slug("reports_to", "to_slug"), "reports_to").withColumn("ok", F.col("to_slug") != F.col("own"))
    managers = managers.select("id", F.col("own").alias("from_slug"), "to_slug", F.lit(MANAGER).alias("relation"), "source_type", F.col("evidence").alias("context"), F.lit(-1).alias("place"), "ok")
    links = links.unionByName(managers)
    notes = own.filter("note is not null").select("id", F.col("own").alias("slug"), "note", "source_type", F.lit(0).alias("place"), (F.trim("note") != "").alias("ok"))
    results = facts.select("id", "ok").unionByName(links.select("id", "ok")).unionByName(notes.select("id", "ok"))
    return {"facts": facts.filter("ok"), "links": links.filter("ok"), "notes": notes.filter("ok"), "results": results}


@dataclass
class KnowledgeStore:
    spark: SparkSession
    path: str

    def _manifest(self) -> list[tuple[str, int, str, str]]:
        """(table, batch, batch's id, folder): five rows a batch."""
        if not knowledge.has_table(self.spark, f"{self.path}/manifest"):
            return []
        return [tuple(r) for r in knowledge.read_table(self.spark, f"{self.path}/manifest").collect()]

    def _read(self, name: str, manifest: list[tuple[str, int, str, str]]) -> DataFrame:
        folders = [f for n, _, _, f in manifest if n == name]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMAS[name])

    def table(self, name: str) -> DataFrame:
        """All rows of a table; of facts and links the last of each key."""
        rows = self._read(name, self._manifest())
        keys = {"facts": ["slug", "field"], "links": ["from_slug", "to_slug", "relation"]}.get(name)
        if name == "links":  # a person has one manager: the last
            last = Window.partitionBy("from_slug").orderBy(F.desc("batch"), F.desc("place"))
            manager = F.col("relation") == MANAGER
            rows = rows.filter(~manager).unionByName(rows.filter(manager).withColumn("rn", F.row_number().over(last)).filter("rn = 1").drop("rn"))
        if keys is None:
            return rows
        w = Window.partitionBy(*keys).orderBy(F.desc("batch"), F.desc("place"))
        return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")

    def write(self, requests: DataFrame, batch_id: str, pages: DataFrame, aliases: DataFrame) -> DataFrame:
        """Write a batch of requests (see REQUEST; one row an id) over pages(slug, title, type) that are there besides the store's own; returns
        its receipts."""
        manifest = self._manifest()
        if any(b == batch_id for _, _, b, _ in manifest):
            return self._receipts(batch_id)
        number = max((n for _, n, _, _ in manifest), default=0) + 1
        there = pages.select("slug", "title", "type").unionByName(self._read("pages", manifest).select("slug", "title", "type"))
        resolved = cut(resolve(requests, there, aliases))
        parts = apply(requests, resolved)
        # the place of a row: its request's id, then its place in the request
        place = (F.col("id") * 4096 + F.col("place")).cast("long")
        stubs = resolved.filter("action = 'stub_created'").select("slug", "title", "type").distinct()
        made = mentioned(requests).join(resolved.filter("action = 'stub_created'").select("name", "slug"), "name").groupBy("id").agg(F.count_distinct("slug").alias("stubs"))
        done = parts["results"].groupBy("id").agg(F.count("*").alias("total"), F.count(F.when(F.col("ok"), 1)).alias("succeeded"))
        receipts = requests.select("id", "subject").join(resolved.select(F.col("name").alias("subject"), "slug", "action"), "subject", "left").join(done, "id", "left").join(made, "id", "left").fillna(0, ["total", "succeeded", "stubs"])
        receipts = receipts.withColumn("failed", F.col("total") - F.col("succeeded")).withColumn("action", F.coalesce("action", F.lit("no_subject")))
        rows = {"pages": stubs, **{n: parts[n].withColumn("place", place) for n in ("facts", "links", "notes")}, "receipts": receipts}
        folder = f"{self.path}/parts/{uuid.uuid4().hex}"
        for name, frame in rows.items():
            columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
            frame.withColumn("batch", F.lit(number).cast("long")).select(columns).write.mode("overwrite").parquet(f"{folder}/{name}")
        new = [(name, number, batch_id, f"{folder}/{name}") for name in rows]
        self._commit([*manifest, *new])
        return self._receipts(batch_id)

    def _receipts(self, batch_id: str) -> DataFrame:
        return self._read("receipts", [m for m in self._manifest() if m[2] == batch_id])

    def _commit(self, manifest: list[tuple[str, int, str, str]]) -> None:
        knowledge.replace_table(self.spark.createDataFrame(manifest, "name string, number long, batch string, folder string").coalesce(1), f"{self.path}/manifest")
