"""Scans and lookups over the store's tables.

Every function keeps its filters as plain predicates on columns of the source, so they reach the Parquet scan,
and ends in a total order where it orders at all. Rows with a null in a compared column don't match.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SNIPPET, LIST_SNIPPET = 300, 200


def distinct_records(df: DataFrame, *key: str) -> DataFrame:
    """Each record once; a record delivered twice is equal in every column, so its key decides."""
    return df.dropDuplicates(list(key))


def in_namespaces(df: DataFrame, namespaces: Sequence[str] | str | None) -> DataFrame:
    """Rows of some namespaces; None or an empty list means all."""
    if not namespaces:
        return df
    return df.where(F.col("namespace").isin([namespaces] if isinstance(namespaces, str) else list(namespaces)))


def live(memories: DataFrame, namespaces: Sequence[str] | str | None = None, types: Sequence[str] | str | None = None) -> DataFrame:
    """Memories that aren't deleted."""
    rows = in_namespaces(memories, namespaces).where(F.col("deleted_at").isNull())
    return rows.where(F.col("type").isin([types] if isinstance(types, str) else list(types))) if types else rows


def snippet(most: int = SNIPPET) -> Column:
    return F.substring("body", 1, most)


def list_memories(memories: DataFrame, namespace: str, type_: str | None = None, include_deleted: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """The latest updated first; a page of id, name, type, description, snippet and whether deleted."""
    rows = in_namespaces(memories, namespace) if include_deleted else live(memories, namespace)
    rows = rows.where(F.col("type") == type_) if type_ else rows
    page = rows.select("id", "name", "type", "description", snippet(LIST_SNIPPET).alias("snippet"), "updated_at", F.col("deleted_at").isNotNull().alias("deleted"))
    return page.orderBy(F.desc("updated_at"), "id").offset(offset).limit(limit)


def with_version(memories: DataFrame, versions: DataFrame) -> DataFrame:
    """Memories with the number of their latest version, 1 if none is kept."""
    latest = versions.groupBy(F.col("memory_id").alias("id")).agg(F.max("version").alias("version"))
    return memories.join(latest, "id", "left").withColumn("version", F.coalesce("version", F.lit(1)))


def read_memory(memories: DataFrame, versions: DataFrame, namespace: str, name: str | None = None, id_: int | None = None) -> DataFrame:
    """The live memory of a name or id within a namespace, with its version."""
    rows = live(memories, namespace)
    rows = rows.where(F.col("name") == name) if name is not None else rows.where(F.col("id") == id_)
    return with_version(rows, versions)


def find_any_state(memories: DataFrame, namespace: str, names: Sequence[str]) -> DataFrame:
    """Rows of some names whether deleted or not, with a flag."""
    return memories.where((F.col("namespace") == namespace) & F.col("name").isin(list(names))).select("id", "name", F.col("deleted_at").isNotNull().alias("deleted"))


def duplicates_by_hash(memories: DataFrame, hash_: Column) -> DataFrame:
    """``(namespace, body_hash, n, first_id)``: live memories of one namespace with equal bodies."""
    rows = live(memories).where(F.col("body").isNotNull()).select("namespace", "id", hash_.alias("body_hash"))
    return rows.groupBy("namespace", "body_hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


def with_hash(memories: DataFrame, hashes: DataFrame, hash_: Column) -> DataFrame:
    """Live memories whose body hash is among ``hashes`` (namespace, body_hash)."""
    return live(memories).withColumn("_h", hash_).join(hashes.select("namespace", F.col("body_hash").alias("_h")), ["namespace", "_h"], "left_semi").drop("_h")


def list_entities(entities: DataFrame, namespace: str | None = None, order: str = "id", descending: bool = False, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Entities in a total order by id, name, degree or created_at; all namespaces come namespace by namespace."""
    rows = in_namespaces(entities, namespace)
    first = F.desc(order) if descending else F.asc(order)
    ordered = rows.orderBy(first, "id") if namespace else rows.orderBy("namespace", first, "id")
    return ordered.offset(offset).limit(limit) if limit is not None else ordered


def named_relationships(relationships: DataFrame, entities: DataFrame, namespace: str | None = None) -> DataFrame:
    """Edges with the names of both ends, both within the edge's namespace if one is given."""
    rows, nodes = in_namespaces(relationships, namespace), in_namespaces(entities, namespace).select("id", "name")
    source, target = nodes.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), nodes.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"))
    return rows.join(source, "source_id").join(target, "target_id")


def memory_bindings(bindings: DataFrame, memories: DataFrame, entities: DataFrame) -> DataFrame:
    """``(memory_id, memory_name, entity_id, entity_name, entity_type)`` of the bindings whose both ends exist."""
    m = memories.select(F.col("id").alias("memory_id"), F.col("name").alias("memory_name"))
    e = entities.select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name"), F.col("type").alias("entity_type"))
    return bindings.select("memory_id", "entity_id").distinct().join(m, "memory_id").join(e, "entity_id")


def memory_graph_context(relationships: DataFrame, bindings: DataFrame, memory_ids: Sequence[int]) -> DataFrame:
    """``(memory_id, relationship_id, source_id, target_id, relation, weight)``: edges that touch an entity of a memory, each once."""
    mine = bindings.where(F.col("memory_id").isin(list(memory_ids))).select("memory_id", "entity_id").distinct()
    edges = relationships.select(F.col("id").alias("relationship_id"), "source_id", "target_id", "relation", "weight")
    ends = edges.withColumn("entity_id", F.explode(F.array_distinct(F.array("source_id", "target_id"))))
    return ends.join(mine, "entity_id").select("memory_id", "relationship_id", "source_id", "target_id", "relation", "weight").distinct()


def chunks_of(chunks: DataFrame, memory_ids: DataFrame) -> DataFrame:
    """The chunks of some memories (memory_id), in their order."""
    return chunks.join(memory_ids.select("memory_id"), "memory_id", "left_semi").orderBy("memory_id", "chunk_idx")


def urls_of(urls: DataFrame, memory_ids: DataFrame) -> DataFrame:
    """The addresses of some memories (memory_id), as they were stored."""
    return urls.join(memory_ids.select("memory_id"), "memory_id", "left_semi").orderBy("memory_id", "id")


def count_listed(memories: DataFrame, namespace: str, type_: str | None = None, include_deleted: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """``(total, truncated)``: how many rows ``list_memories`` of the same filters has, and whether its page ends before them."""
    rows = in_namespaces(memories, namespace) if include_deleted else live(memories, namespace)
    rows = rows.where(F.col("type") == type_) if type_ else rows
    return rows.agg(F.count(F.lit(1)).alias("total")).select("total", (F.col("total") > limit + offset).alias("truncated"))


def entity_bindings(entities: DataFrame, bindings: DataFrame, memories: DataFrame) -> DataFrame:
    """``(id, name, memories)``: the entities bound to live memories and to how many."""
    alive = live(memories).select(F.col("id").alias("memory_id"))
    counts = bindings.join(alive, "memory_id", "left_semi").groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("memories"))
    return entities.select("id", "name").join(counts, "id")


def like_ignoring_case(column: str, *patterns: str) -> Column:
    """Any of some LIKE patterns, letters of either case."""
    found = F.lit(False)
    for p in patterns:
        found = found | F.lower(column).like(p)
    return found
