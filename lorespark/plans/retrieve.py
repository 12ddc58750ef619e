"""Retrieval queries composed of the operators: recall, hybrid search, related memories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.operators import fts, fusion, graph, vector
from lorespark.operators.scan import snippet
from lorespark.runtime import materialize


def hydrate(hits: DataFrame, memories: DataFrame, key: str = "id") -> DataFrame:
    """Hits with name, type and snippet; the few hits are broadcast, so memories aren't shuffled."""
    texts = memories.select(F.col("id").alias(key), "name", "type", snippet().alias("snippet"))
    return F.broadcast(hits).join(texts, key)


def hybrid_search(memories: DataFrame, embeddings: DataFrame, query: Sequence[float], text: str, k: int = 10, namespaces: Sequence[str] | None = None, type_: str | None = None, weight_vector: float = 1.0, weight_text: float = 1.0, rrf_k: int = fusion.RRF_K) -> DataFrame:
    """The k best of both lists fused; each list hands in 2 k candidates."""
    near = vector.knn_memories(embeddings, memories, query, 2 * k, namespaces, type_).withColumnRenamed("memory_id", "id")
    found = fts.search(memories, text, 2 * k, namespaces, type_)
    fused = fusion.hybrid(fusion.ranked(near, "id", "distance"), fusion.ranked(found, "id", "score"), weight_vector, weight_text, rrf_k, k)
    return hydrate(fused, memories).orderBy(F.desc("score"), "id")


def recall(memories: DataFrame, bindings: DataFrame, relationships: DataFrame, embeddings: DataFrame, entity_embeddings: DataFrame, query: Sequence[float], k: int = 10, namespace: str | None = None, hops: int = 2, min_weight: float = 0.3, max_distance: float = 1.0, most_graph: int | None = None, compat_seed_mixing: bool = False) -> DataFrame:
    """``(id, distance, source, hop)``: the nearest memories, then those the graph reaches from them.

    Seeds are the entities of the direct hits and the entities nearest to the query. With
    ``compat_seed_mixing`` the latter are taken for memory ids instead, as an earlier store did. Beyond
    ``max_distance`` (if under 1) of every direct hit the result is empty, but hits aren't filtered by it.
    """
    direct = vector.knn_memories(embeddings, memories, query, k, [namespace] if namespace else None)
    direct = materialize(direct, "direct")
    if max_distance < 1.0 and direct.where(F.col("distance") <= max_distance).isEmpty():
        return direct.where(F.lit(False)).select(F.col("memory_id").alias("id"), "distance", F.lit("direct").alias("source"), F.lit(0).alias("hop"))
    near = vector.knn_entities(entity_embeddings, query, namespace, 5).select("entity_id")
    if compat_seed_mixing:
        seeds = graph.entities_of(bindings, direct.select("memory_id").union(near.select(F.col("entity_id").alias("memory_id"))))
    else:
        seeds = graph.seed_entities(near, direct.select("memory_id"), bindings)
    found = graph.bfs(graph.steps(relationships, namespace, min_weight), seeds, hops, paths=False)
    reached = graph.memories_reached(found, bindings, memories, direct.select("memory_id"))
    reached = reached.orderBy("memory_id").limit(most_graph) if most_graph is not None else reached
    graphed = reached.select(F.col("memory_id").alias("id"), graph.graph_distance(F.col("hop")).alias("distance"), F.lit("graph").alias("source"), "hop")
    return direct.select(F.col("memory_id").alias("id"), "distance", F.lit("direct").alias("source"), F.lit(0).alias("hop")).unionByName(graphed)


def recall_text(memories: DataFrame, text: str, k: int = 10, namespaces: Sequence[str] | None = None) -> DataFrame:
    """``(id, distance)`` where there is no query vector: the rank of the text hits as a distance."""
    hits = fusion.ranked(fts.search(memories, text, k, namespaces), "id", "score")
    return hits.select("id", (F.lit(1.0) - F.lit(1.0) / F.col("rank")).alias("distance"))


def hybrid_with_graph(memories: DataFrame, bindings: DataFrame, relationships: DataFrame, embeddings: DataFrame, query: Sequence[float], text: str, k: int = 10, namespace: str | None = None, hops: int = 2, min_weight: float = 0.3) -> DataFrame:
    """``(id, score, source, hop)``: hybrid hits and, apart from them, what the graph reaches."""
    hits = materialize(hybrid_search(memories, embeddings, query, text, k, [namespace] if namespace else None), "hits")
    reached = graph.traverse_from_memories(memories, bindings, relationships, hits.select(F.col("id").alias("memory_id")), namespace, min_weight, hops)
    graphed = reached.select(F.col("memory_id").alias("id"), (F.lit(1.0) - graph.graph_distance(F.col("hop"))).alias("score"), F.lit("graph").alias("source"), "hop")
    return hits.select("id", "score", "source", F.lit(0).alias("hop")).unionByName(graphed)
