"""Traversal of the weighted entity graph: one bounded breadth-first core and the queries built on it.

The loop runs on the driver, one join a hop; the frontier is written to the shared folder each hop, so the plan
stays small and a lost executor costs one hop at most. Edges with a null end or weight are never walked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.operators.scan import in_namespaces
from lorespark.runtime import materialize

HOPS, MIN_WEIGHT = 2, 0.3


def steps(relationships: DataFrame, namespace: str | None = None, min_weight: float | None = MIN_WEIGHT, direction: str = "out", relations: Sequence[str] | None = None) -> DataFrame:
    """``(src, dst, rel_id, relation, weight, forward)``: the edges as they may be walked.

    direction: 'out', 'in' or 'both'. The filters stay on the source's columns.
    """
    rows = in_namespaces(relationships, namespace).where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    rows = rows.where(F.col("weight") >= min_weight) if min_weight is not None else rows
    rows = rows.where(F.col("relation").isin(list(relations))) if relations else rows
    walk = lambda a, b, forward: rows.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.col("id").alias("rel_id"), "relation", "weight", F.lit(forward).alias("forward"))
    out = walk("source_id", "target_id", True)
    back = walk("target_id", "source_id", False)
    return out if direction == "out" else back if direction == "in" else out.unionByName(back)


def bfs(walkable: DataFrame, seeds: DataFrame, hops: int = HOPS, cap: int | None = None, by: Sequence[str] = (), paths: bool = True) -> DataFrame:
    """``(*by, entity_id, hop, parent_id, rel_id, relation, weight, path_weight, path)``: every entity at its least distance.

    ``walkable`` as from ``steps``; ``seeds``: (*by, entity_id), of hop 0; several searches, told apart by the
    columns ``by``, go through the same joins. With ``cap`` an entity hands on to its heaviest so many neighbours
    that aren't visited yet. Of several ways to an entity the one from the parent found first (by id) over the
    heaviest edge is kept. ``path`` lists the edges from the seed; without ``paths`` it isn't carried from hop to hop.
    """
    by = list(by)
    step = F.struct(F.col("src").alias("from_id"), F.col("dst").alias("to_id"), "relation", "weight")
    none = F.array().cast("array<struct<from_id:bigint,to_id:bigint,relation:string,weight:double>>")
    start = seeds.where(F.col("entity_id").isNotNull()).select(*by, F.col("entity_id").cast("bigint").alias("entity_id")).distinct()
    frontier = materialize(start.select(*by, "entity_id", F.lit(0).alias("hop"), *(F.lit(None).cast(t).alias(c) for c, t in (("parent_id", "bigint"), ("rel_id", "bigint"), ("relation", "string"), ("weight", "double"))), F.lit(1.0).alias("path_weight"), *([none.alias("path")] if paths else [])), "frontier")
    visited = frontier
    for hop in range(1, hops + 1):
        at = frontier.select(*by, F.col("entity_id").alias("src"), F.col("path_weight").alias("_pw"), *([F.col("path").alias("_path")] if paths else []))
        reached = walkable.join(at, "src").join(visited.select(*by, F.col("entity_id").alias("dst")), [*by, "dst"], "left_anti")
        if cap is not None:
            # parallel edges count once against the cap
            each = Window.partitionBy(*by, "src", "dst").orderBy(F.desc("weight"), "rel_id")
            reached = reached.withColumn("_n", F.row_number().over(each)).where("_n = 1")
            reached = reached.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "src").orderBy(F.desc("weight"), "rel_id"))).where(F.col("_n") <= cap)
        # one way to each entity, chosen by an aggregation that combines before the shuffle
        best = F.min_by(F.struct("src", "rel_id", "relation", "weight", (F.col("_pw") * F.col("weight")).alias("path_weight"), *([F.concat("_path", F.array(step)).alias("path")] if paths else [])), F.struct("src", -F.col("weight"), "rel_id"))
        found = reached.groupBy(*by, F.col("dst").alias("entity_id")).agg(best.alias("b"))
        frontier = materialize(found.select(*by, "entity_id", F.lit(hop).alias("hop"), F.col("b.src").alias("parent_id"), "b.rel_id", "b.relation", "b.weight", "b.path_weight", *(["b.path"] if paths else [])), "frontier")
        if hop < hops and frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def entities_of(bindings: DataFrame, memory_ids: DataFrame) -> DataFrame:
    """``(entity_id)`` bound to some memories ``(memory_id)``."""
    return bindings.join(memory_ids.select("memory_id").distinct(), "memory_id", "left_semi").where(F.col("entity_id").isNotNull()).select("entity_id").distinct()


def memories_reached(found: DataFrame, bindings: DataFrame, memories: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """``(memory_id, hop)``: live memories bound to entities beyond the seeds, at the least hop; without ``exclude`` (memory_id)."""
    near = found.where("hop > 0").select("entity_id", "hop")
    hits = bindings.select("memory_id", "entity_id").join(near, "entity_id").groupBy("memory_id").agg(F.min("hop").alias("hop"))
    alive = memories.where(F.col("deleted_at").isNull()).select(F.col("id").alias("memory_id"))
    hits = hits.join(alive, "memory_id", "left_semi")
    return hits.join(exclude.select("memory_id"), "memory_id", "left_anti") if exclude is not None else hits


def graph_distance(hop: Column) -> Column:
    return F.lit(1.0) - F.lit(1.0) / (hop + 1)


def traverse_from_memories(memories: DataFrame, bindings: DataFrame, relationships: DataFrame, memory_ids: DataFrame, namespace: str | None, min_weight: float = MIN_WEIGHT, hops: int = HOPS, cap: int | None = None) -> DataFrame:
    """``(memory_id, hop)`` reached from the entities of some memories along outgoing edges."""
    found = bfs(steps(relationships, namespace, min_weight), entities_of(bindings, memory_ids), hops, cap, paths=False)
    return memories_reached(found, bindings, memories, memory_ids)


def related(memories: DataFrame, bindings: DataFrame, relationships: DataFrame, seeds: DataFrame, namespace: str | None = None, hops: int = HOPS, min_weight: float = MIN_WEIGHT, relations: Sequence[str] | None = None, exclude: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """``(memory_id, hop, relation, weight, from_id, entity_id)``: memories near some entities in either direction, the nearest and heaviest first."""
    found = bfs(steps(relationships, namespace, min_weight, "both", relations), seeds, hops, paths=False).where("hop > 0")
    alive = memories.where(F.col("deleted_at").isNull()).select(F.col("id").alias("memory_id"))
    hits = bindings.select("memory_id", "entity_id").distinct().join(found, "entity_id").join(alive, "memory_id", "left_semi")
    hits = hits.join(exclude.select("memory_id"), "memory_id", "left_anti") if exclude is not None else hits
    first = F.min_by(F.struct("hop", "relation", "weight", F.col("parent_id").alias("from_id"), "entity_id"), F.struct("hop", -F.col("weight"), "entity_id"))
    return hits.groupBy("memory_id").agg(first.alias("b")).select("memory_id", "b.*").orderBy("hop", F.desc("weight"), "memory_id").limit(limit)


def related_by_name(memories: DataFrame, entities: DataFrame, bindings: DataFrame, relationships: DataFrame, namespace: str, name: str, **options: object) -> DataFrame:
    """``related`` of a live memory of that name, which is left out itself, or, where there is none, of the entity of that name."""
    memory = memories.where((F.col("namespace") == namespace) & (F.col("name") == name) & F.col("deleted_at").isNull()).select(F.col("id").alias("memory_id"))
    entity = entities.where((F.col("namespace") == namespace) & (F.col("name") == name)).select(F.col("id").alias("entity_id"))
    other = entity.where(memory.agg(F.count(F.lit(1)).alias("n")).scalar() == 0)
    return related(memories, bindings, relationships, entities_of(bindings, memory).union(other), namespace, exclude=memory, **options)


def incident_edges(relationships: DataFrame, seeds: DataFrame, hops: int = HOPS, namespace: str | None = None) -> DataFrame:
    """``(entity_id, hop, rel_id, other_id, relation, weight, direction)``: every edge at each entity nearer than ``hops``, whatever its weight."""
    walkable = steps(relationships, namespace, None, "both")
    inner = bfs(walkable, seeds, hops - 1, paths=False).select(F.col("entity_id").alias("src"), "hop") if hops > 1 else seeds.select(F.col("entity_id").cast("bigint").alias("src"), F.lit(0).alias("hop")).distinct()
    way = F.when(F.col("forward"), "outbound").otherwise("inbound")
    return walkable.join(inner, "src").select(F.col("src").alias("entity_id"), (F.col("hop") + 1).alias("hop"), "rel_id", F.col("dst").alias("other_id"), "relation", "weight", way.alias("direction"))


def endpoints(relationships: DataFrame) -> DataFrame:
    """``(entity_id, rel_id)``: each end of each edge, a self-loop once. The union stands for joining on either end."""
    return relationships.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("entity_id"), F.col("id").alias("rel_id")).where(F.col("entity_id").isNotNull())


def degrees(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Entities with ``live_degree``: edges they are an end of. Counted before the join, so hubs cost one row."""
    counts = endpoints(relationships).groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("live_degree"))
    return entities.join(counts, "id", "left").withColumn("live_degree", F.coalesce("live_degree", F.lit(0)))


def degree_drift(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """``(total, updated, zeroed, unchanged)``: what recomputing the kept degrees would change."""
    d = degrees(entities, relationships)
    differs = ~F.col("degree").eqNullSafe(F.col("live_degree"))
    return d.agg(F.count(F.lit(1)).alias("total"), F.count_if(differs).alias("updated"), F.count_if(differs & (F.col("live_degree") == 0)).alias("zeroed"), F.count_if(~differs).alias("unchanged"))


def orphan_entities(entities: DataFrame, relationships: DataFrame, bindings: DataFrame) -> DataFrame:
    """Entities in no edge and no binding."""
    used = endpoints(relationships).select(F.col("entity_id").alias("id"))
    bound = bindings.where(F.col("entity_id").isNotNull()).select(F.col("entity_id").alias("id"))
    return entities.join(used, "id", "left_anti").join(bound, "id", "left_anti")


def relation_names(relationships: DataFrame, entities: DataFrame, relation: str) -> DataFrame:
    """``(name)``: the entities at either end of a relation, each once."""
    ends = endpoints(relationships.where(F.col("relation") == relation)).select(F.col("entity_id").alias("id")).distinct()
    return entities.join(ends, "id", "left_semi").select("name").distinct()


def seed_entities(nearest: DataFrame, top_memories: DataFrame, bindings: DataFrame) -> DataFrame:
    """``(entity_id)``: the nearest entities and those of the best memories."""
    return nearest.select("entity_id").union(entities_of(bindings, top_memories).select("entity_id")).distinct()


def decayed_score(seed_score: Column, hop: Column, decay: float = 0.7) -> Column:
    """Mean score of the seeds times decay to the power of the hop, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), seed_score * F.pow(F.lit(decay), hop)))


def graph_context(names: DataFrame, entities: DataFrame, relationships: DataFrame, most_edges: int = 50) -> tuple[DataFrame, DataFrame]:
    """Of result names that are names of entities too: (id, name, type, live_degree), and the edges among them."""
    nodes = degrees(entities.join(names.select("name").distinct(), "name", "left_semi"), relationships).select("id", "name", "type", "live_degree")
    ids = nodes.select("id")
    among = relationships.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return nodes, among.select("id", "source_id", "target_id", "relation", "weight").orderBy(F.desc("weight"), "id").limit(most_edges)
