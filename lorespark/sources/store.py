"""The store's tables of a data folder, and the tables derived from them for the queries.

The folder holds memories, entities, relationships and memory_entities. What it doesn't hold - vectors of
memories, entities and chunks, versions, the work queue - is derived by the rules below, each given as well as
the SQL of ``VIEWS`` for the check.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators.scan import distinct_records
from lorespark.sources.tables import table

DIM = 64


#: What records are told apart by: the key, and the small columns queries filter by. Records delivered twice are
#: equal in every column, so this equals the key alone, but filters on these columns go below the deduplication
#: and reach the scan, while the large columns can still be pruned.
MEMORY_KEY = ("id", "namespace", "name", "type", "deleted_at", "updated_at")
ENTITY_KEY = ("id", "namespace", "name", "type", "degree")
RELATIONSHIP_KEY = ("id", "namespace", "source_id", "target_id", "relation", "weight")


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def memories(self) -> DataFrame:
        return distinct_records(self.raw("memories"), *MEMORY_KEY)

    @cached_property
    def entities(self) -> DataFrame:
        return distinct_records(self.raw("entities"), *ENTITY_KEY)

    @cached_property
    def relationships(self) -> DataFrame:
        return distinct_records(self.raw("relationships"), *RELATIONSHIP_KEY)

    @cached_property
    def bindings(self) -> DataFrame:
        """Bindings without nulls; a key delivered at several times keeps the earliest."""
        return self.raw("memory_entities").where("memory_id IS NOT NULL AND entity_id IS NOT NULL").groupBy("memory_id", "entity_id").agg(F.min("created_at").alias("created_at"))

    @cached_property
    def memory_vectors(self) -> DataFrame:
        owner = self.memories.select(F.col("id").alias("memory_id"), "namespace")
        v = self.raw("embeddings").select(F.col("vec_id").alias("memory_id"), "embedding", F.lit(DIM).alias("dim"))
        return v.join(owner, "memory_id", "left").withColumn("namespace", F.coalesce("namespace", F.lit("global")))

    @cached_property
    def entity_vectors(self) -> DataFrame:
        owner = self.entities.select(F.col("id").alias("entity_id"), "namespace")
        v = self.raw("embeddings").select((F.col("vec_id") + 1000).alias("entity_id"), "embedding", F.lit(DIM).alias("dim"))
        return v.join(owner, "entity_id", "left").withColumn("namespace", F.coalesce("namespace", F.lit("global")))

    @cached_property
    def chunk_vectors(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 100 + 1).alias("memory_id"), "embedding", F.lit(DIM).alias("dim"))

    @cached_property
    def versions(self) -> DataFrame:
        numbers = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("id") % 3 + 1)).alias("version")
        rows = self.memories.select("id", "body", numbers)
        body = F.when(F.col("version") == F.col("id") % 3 + 1, F.col("body")).otherwise(F.substring(F.col("body"), F.lit(1), (F.col("version") * 100).cast("int")))
        reason = F.when(F.col("version") == 1, "create").when(F.col("version") == 2, "edit").otherwise("restore")
        return rows.select(F.col("id").alias("memory_id"), "version", reason.alias("change_reason"), body.alias("body"))

    @cached_property
    def queue(self) -> DataFrame:
        status = F.element_at(F.array(*(F.lit(s) for s in ("pending", "processing", "done", "failed", "skipped", "dead"))), (F.col("event_id") % 6 + 1).cast("int"))
        again = F.when(F.col("event_id") % 12 == 0, F.bround(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint"))
        return self.raw("events").select(F.col("event_id").alias("id"), F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("item_key"), status.alias("status"), (F.col("event_id") % 10).cast("int").alias("attempt"), (F.col("user_id") % 4).alias("operation"), again.alias("next_retry_at"))

    def vector(self, vec_id: int) -> list[float]:
        """One stored vector, as the query vector of a search."""
        return list(self.raw("embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])

    def vectors(self, vec_ids: list[int]) -> dict[int, list[float]]:
        rows = self.raw("embeddings").where(F.col("vec_id").isin(vec_ids)).select("vec_id", "embedding").collect()
        return {vec_ids.index(r["vec_id"]): list(r["embedding"]) for r in rows}


#: The same tables for the check, as common table expressions.
VIEWS = {
    "mem": "SELECT DISTINCT * FROM memories",
    "ent": "SELECT DISTINCT * FROM entities",
    "rel": "SELECT DISTINCT * FROM relationships",
    "bind": "SELECT memory_id, entity_id, min(created_at) AS created_at FROM memory_entities WHERE memory_id IS NOT NULL AND entity_id IS NOT NULL GROUP BY 1, 2",
    "mvec": "SELECT vec_id AS memory_id, coalesce(namespace, 'global') AS namespace, embedding, 64 AS dim FROM embeddings LEFT JOIN mem ON id = vec_id",
    "evec": "SELECT vec_id + 1000 AS entity_id, coalesce(namespace, 'global') AS namespace, embedding, 64 AS dim FROM embeddings LEFT JOIN ent ON id = vec_id + 1000",
    "cvec": "SELECT vec_id AS chunk_id, vec_id % 100 + 1 AS memory_id, embedding, 64 AS dim FROM embeddings",
    "ver": "SELECT id AS memory_id, v AS version, CASE v WHEN 1 THEN 'create' WHEN 2 THEN 'edit' ELSE 'restore' END AS change_reason, CASE WHEN v = 1 + id % 3 THEN body ELSE substring(body, 1, 100 * v) END AS body FROM mem, (SELECT unnest([1, 2, 3]) AS v) n WHERE v <= 1 + id % 3",
    "que": "SELECT event_id AS id, 'evt-' || event_id AS item_key, ['pending', 'processing', 'done', 'failed', 'skipped', 'dead'][event_id % 6 + 1] AS status, CAST(event_id % 10 AS INT) AS attempt, user_id % 4 AS operation, CASE WHEN event_id % 12 = 0 THEN CAST(epoch(ts) AS BIGINT) END AS next_retry_at FROM events",
    "deg": "SELECT entity_id AS id, count(*) AS d FROM (SELECT id AS r, source_id AS entity_id FROM rel UNION SELECT id, target_id FROM rel) WHERE entity_id IS NOT NULL GROUP BY 1",
}


def with_views(sql: str) -> str:
    """The SQL with the views it names (and those they name) before it."""
    import re

    need: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in need and re.search(rf"\b{name}\b", text):
                add(VIEWS[name])
                if name not in need:
                    need.append(name)

    add(sql)
    body = sql.strip()
    heads = ", ".join(f"{n} AS ({VIEWS[n]})" for n in need)
    if not heads:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads}, {body[15:]}"
    return f"WITH {heads}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {heads} {body}"
