"""Curation of the graph: merging, normalizing, pruning, relabelling. Pure functions from tables to tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.text import normalize_entity_name, normalize_relation
from lorespark.operators.graph import degrees, orphan_entities


@dataclass(frozen=True)
class Graph:
    entities: DataFrame
    relationships: DataFrame
    bindings: DataFrame

    def with_degrees(self) -> "Graph":
        """The kept degrees computed anew."""
        live = degrees(self.entities, self.relationships)
        return replace(self, entities=live.withColumn("degree", F.col("live_degree").cast(self.entities.schema["degree"].dataType)).select(*self.entities.columns))


def merge_entities(graph: Graph, mapping: DataFrame) -> Graph:
    """Entities ``mapping`` (from_id, to_id) merged: ends and bindings redirected, loops dropped, one edge kept of equals.

    Of equal edges one that was at the target before survives, else the least id; chains of the mapping must be
    resolved. A mapping of an entity to itself changes nothing.
    """
    m = mapping.where(F.col("from_id") != F.col("to_id")).dropDuplicates(["from_id"])
    source, target = m.select(F.col("from_id").alias("source_id"), F.col("to_id").alias("_s")), m.select(F.col("from_id").alias("target_id"), F.col("to_id").alias("_t"))
    moved = graph.relationships.join(source, "source_id", "left").join(target, "target_id", "left")
    moved = moved.withColumn("_moved", F.col("_s").isNotNull() | F.col("_t").isNotNull())
    moved = moved.withColumn("source_id", F.coalesce("_s", "source_id")).withColumn("target_id", F.coalesce("_t", "target_id"))
    # loops made by the merge go; edges that nothing touched stay as they are
    kept = moved.where(~F.col("_moved") | ~F.col("source_id").eqNullSafe(F.col("target_id")))
    rest = [c for c in graph.relationships.columns if c not in ("source_id", "target_id", "relation")]
    one = kept.groupBy("source_id", "target_id", "relation").agg(F.min_by(F.struct(*rest), F.struct("_moved", "id")).alias("_r"))
    edges = one.select("source_id", "target_id", "relation", "_r.*").select(*graph.relationships.columns)
    bound = graph.bindings.join(m.select(F.col("from_id").alias("entity_id"), F.col("to_id").alias("_e")), "entity_id", "left").withColumn("entity_id", F.coalesce("_e", "entity_id"))
    bindings = bound.groupBy("memory_id", "entity_id").agg(F.min("created_at").alias("created_at")).select(*graph.bindings.columns)
    entities = graph.entities.join(m.select(F.col("from_id").alias("id")), "id", "left_anti").select(*graph.entities.columns)
    return Graph(entities, edges, bindings).with_degrees()


def normalization_plan(entities: DataFrame) -> DataFrame:
    """``(from_id, to_id, normal)``: entities of one namespace whose names have one normal form, onto the survivor.

    The survivor already bears the normal form, or has the least id. Rows whose ids are equal are renames only;
    names without a normal form of two letters are left alone.
    """
    rows = entities.select("id", "namespace", "name", normalize_entity_name(F.col("name")).alias("normal")).where(F.length("normal") >= 2)
    first = rows.groupBy("namespace", "normal").agg(F.min_by("id", F.struct((F.col("name") != F.col("normal")).cast("int"), "id")).alias("to_id"))
    return rows.join(first, ["namespace", "normal"]).where((F.col("id") != F.col("to_id")) | (F.col("name") != F.col("normal"))).select(F.col("id").alias("from_id"), "to_id", "normal")


def normalize_entities(graph: Graph) -> Graph:
    """All names in normal form, entities of one name merged."""
    todo = normalization_plan(graph.entities)
    merged = merge_entities(graph, todo.select("from_id", "to_id"))
    names = todo.groupBy(F.col("to_id").alias("id")).agg(F.first("normal").alias("_n"))
    entities = merged.entities.join(names, "id", "left").withColumn("name", F.coalesce("_n", "name")).select(*graph.entities.columns)
    return replace(merged, entities=entities)


def prune_relation(graph: Graph, relation: str, namespace: str | None = None) -> Graph:
    """Edges of a relation dropped, degrees anew."""
    hit = F.coalesce(F.col("relation") == relation, F.lit(False))
    hit = hit & (F.col("namespace") == namespace) if namespace else hit
    return replace(graph, relationships=graph.relationships.where(~hit)).with_degrees()


def prune_bindings(graph: Graph, entity_ids: DataFrame) -> Graph:
    """Bindings of some entities (id) dropped."""
    return replace(graph, bindings=graph.bindings.join(entity_ids.select(F.col("id").alias("entity_id")), "entity_id", "left_anti").select(*graph.bindings.columns))


def delete_entities(graph: Graph, entity_ids: DataFrame) -> Graph:
    """Entities (id) dropped with their edges and bindings, the neighbours' degrees anew."""
    ids = entity_ids.select("id").distinct()
    edges = graph.relationships.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    pruned = prune_bindings(graph, ids)
    return Graph(graph.entities.join(ids, "id", "left_anti").select(*graph.entities.columns), edges.select(*graph.relationships.columns), pruned.bindings).with_degrees()


def cleanup_orphans(graph: Graph, namespace: str | None = None) -> Graph:
    """Entities without edge and binding dropped."""
    gone = orphan_entities(graph.entities, graph.relationships, graph.bindings)
    gone = gone.where(F.col("namespace") == namespace) if namespace else gone
    return replace(graph, entities=graph.entities.join(gone.select("id"), "id", "left_anti").select(*graph.entities.columns))


def reclassify_type(entities: DataFrame, new: str, old: str | None = None, namespace: str | None = None, name: str | None = None, description: str | None = None) -> DataFrame:
    """One entity, by its name in normal form, or all of a type under another type."""
    hit = F.coalesce(F.col("type") == old, F.lit(False)) if old is not None else F.coalesce(normalize_entity_name(F.col("name")) == normalize_entity_name(F.lit(name)), F.lit(False))
    hit = hit & (F.col("namespace") == namespace) if namespace else hit
    out = entities.withColumn("type", F.when(hit, F.lit(new)).otherwise(F.col("type")))
    return out.withColumn("description", F.when(hit, F.lit(description)).otherwise(F.col("description"))) if description is not None else out


def reclassify_relation(graph: Graph, old: str, new: str, source_type: str | None = None, target_type: str | None = None) -> tuple[Graph, DataFrame]:
    """Edges of one relation under another, equal edges merged; with a row (updated, merged).

    An edge that already bears the new relation survives its equals. ``merged`` counts the edges absorbed.
    """
    types = graph.entities.select("id", "type")
    rows = graph.relationships.join(types.select(F.col("id").alias("source_id"), F.col("type").alias("_st")), "source_id", "left").join(types.select(F.col("id").alias("target_id"), F.col("type").alias("_tt")), "target_id", "left")
    hit: Column = F.coalesce(F.col("relation") == old, F.lit(False))
    hit = hit & F.coalesce(F.col("_st") == source_type, F.lit(False)) if source_type else hit
    hit = hit & F.coalesce(F.col("_tt") == target_type, F.lit(False)) if target_type else hit
    relabelled = rows.withColumn("_hit", hit).withColumn("relation", F.when(F.col("_hit"), F.lit(normalized(new))).otherwise(F.col("relation")))
    rest = [c for c in graph.relationships.columns if c not in ("source_id", "target_id", "relation")]
    one = relabelled.groupBy("source_id", "target_id", "relation").agg(F.min_by(F.struct(*rest), F.struct("_hit", "id")).alias("_r"), F.count_if("_hit").alias("_hits"), F.min("_hit").alias("_all"))
    counts = one.agg(F.coalesce(F.sum(F.when(F.col("_all"), 1).otherwise(0)), F.lit(0)).alias("updated"), F.coalesce(F.sum(F.col("_hits") - F.when(F.col("_all"), 1).otherwise(0)), F.lit(0)).alias("merged"))
    edges = one.select("source_id", "target_id", "relation", "_r.*").select(*graph.relationships.columns)
    return replace(graph, relationships=edges).with_degrees(), counts


def normalized(relation: str) -> str:
    return relation.lower().replace("-", "_")


def rename_entity(entities: DataFrame, namespace: str, old: str, new: str) -> DataFrame:
    """An entity under a new normal name, unless the namespace has that name already."""
    slug = normalize_entity_name(F.lit(new))
    here = F.col("namespace") == namespace
    taken = entities.where(here & (F.col("name") == slug)).agg(F.count(F.lit(1)).alias("_taken")).scalar()
    hit = here & (F.col("name") == old) & (F.col("_taken") == 0)
    return entities.withColumn("_taken", taken).withColumn("name", F.when(hit, slug).otherwise(F.col("name"))).drop("_taken")


def normalized_relations(relationships: DataFrame) -> DataFrame:
    return relationships.withColumn("relation", normalize_relation(F.col("relation")))
