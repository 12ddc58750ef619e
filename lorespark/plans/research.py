"""Research over several sub-queries at once, with chains of evidence through the graph.

All sub-queries go through one job with a ``query_id`` column: one pass over the vectors, one over the texts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.operators import fts, fusion, graph, vector
from lorespark.runtime import materialize

# Phrases that part a question, in the order they are tried.
PHRASES = (" that caused ", " depending on ", " related to ", " connected to ", " linked to ", " caused by ", " followed by ")
CONJUNCTION = re.compile(r" (?:and|AND|e|E) |,")
K, SUB_QUERIES, HOPS, DECAY, MIN_SCORE, MOST, CHAINS = 20, 7, 3, 0.7, 0.05, 50, 20


def _by_phrases(question: str) -> list[str]:
    """The stretches between the phrases, each phrase looked for once, in its order, behind the one before."""
    cuts, begin = [], 0
    for phrase in PHRASES:
        if (hit := re.search(re.escape(phrase), question[begin:], re.I)) is not None:
            cuts.append((begin, begin + hit.start()))
            begin += hit.end() if question[begin + hit.end() :].strip() else 0
    return [question[a:b] for a, b in [*cuts, (begin, len(question))]] if cuts else []


def _word_pairs(question: str) -> list[str]:
    words = [w for w in question.split() if len(w.encode()) > 2]
    return [question, " ".join(words[:2]), " ".join(words[-2:])] if len(words) >= 3 else []


SPLITTERS = (_by_phrases, lambda q: q.split(";"), CONJUNCTION.split, _word_pairs)


def decompose(question: str, most: int = SUB_QUERIES) -> list[str]:
    """Sub-queries: what the first splitter that parts the question gives, else the question itself."""
    for split in SPLITTERS:
        parts = split(question)
        if len(parts) > 1:
            return [p.strip() for p in parts if p.strip()][:most] or [question]
    return [question]


def candidates(memories: DataFrame, embeddings: DataFrame, vectors: dict[int, Sequence[float]], texts: dict[int, str], k: int = K, namespaces: Sequence[str] | None = None) -> DataFrame:
    """``(query_id, memory_id, score, source)``: both lists of each sub-query fused, normalized, the best 2 k."""
    alive = memories.where(F.col("deleted_at").isNull()).select(F.col("id").alias("memory_id"))
    near = vector.knn_many(embeddings.join(alive, "memory_id", "left_semi"), "memory_id", vectors, k).select("query_id", "memory_id", F.col("rank").alias("vec_rank"))
    parsed = {i: q for i, t in texts.items() if (q := fts.parse(t)) is not None}
    if parsed:
        found = fts.search_many(memories, parsed, namespaces)
        order = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
        found = found.withColumn("fts_rank", order).where(F.col("fts_rank") <= k).select("query_id", F.col("id").alias("memory_id"), "fts_rank")
    else:
        found = near.where(F.lit(False)).select("query_id", "memory_id", F.col("vec_rank").alias("fts_rank"))
    both = near.join(found, ["query_id", "memory_id"], "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(fusion.RRF_K) + F.col(c)), F.lit(0.0))
    score = F.least(F.lit(1.0), (part("vec_rank") + part("fts_rank")) / F.lit(fusion.rrf_most([1.0, 1.0])))
    source = F.when(F.col("vec_rank").isNotNull() & F.col("fts_rank").isNotNull(), "hybrid").when(F.col("vec_rank").isNotNull(), "knn").otherwise("fts")
    ranked = both.select("query_id", "memory_id", score.alias("score"), source.alias("source"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id"))
    return ranked.withColumn("_n", best).where(F.col("_n") <= 2 * k).drop("_n")


def research(memories: DataFrame, bindings: DataFrame, relationships: DataFrame, embeddings: DataFrame, vectors: dict[int, Sequence[float]], texts: dict[int, str], k: int = K, hops: int = HOPS, min_weight: float = 0.3, decay: float = DECAY, min_score: float = MIN_SCORE, most: int = MOST, cap: int | None = 10, entity_embeddings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Results ``(memory_id, score, source, hop, query_ids)`` and chains ``(from_id, to_id, depth, total_weight, path, query_id)``.

    Each memory has its best score over the sub-queries and their ids. Memories reached through the graph score
    the mean of their sub-query's five best seeds, decayed by hop. Chains are the paths to reached entities,
    twenty a sub-query, one for each pair of ends. With ``entity_embeddings`` the search begins at the five
    entities nearest to each sub-query's vector as well as at those of its best memories.
    """
    direct = materialize(candidates(memories, embeddings, vectors, texts, k), "candidates")
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id"))
    seeds = direct.withColumn("_n", first).where("_n <= 5")
    means = seeds.groupBy("query_id").agg(F.avg("score").alias("_mean"))  # one row a sub-query
    entities = bindings.join(seeds.select("query_id", "memory_id"), "memory_id").select("query_id", "entity_id").distinct()
    if entity_embeddings is not None:
        near = vector.knn_many(entity_embeddings, "entity_id", vectors, 5)
        entities = entities.unionByName(near.select("query_id", "entity_id")).distinct()
    found = graph.bfs(graph.steps(relationships, None, min_weight), entities, hops, cap, ["query_id"]).where("hop > 0")
    alive = memories.where(F.col("deleted_at").isNull()).select(F.col("id").alias("memory_id"))
    hits = bindings.select("memory_id", "entity_id").join(found.select("query_id", "entity_id", "hop"), "entity_id").groupBy("query_id", "memory_id").agg(F.min("hop").alias("hop"))
    hits = hits.join(alive, "memory_id", "left_semi").join(direct.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti").join(means, "query_id")
    reached = hits.select("query_id", "memory_id", graph.decayed_score(F.col("_mean"), F.col("hop"), decay).alias("score"), F.lit("graph").alias("source"), "hop").where(F.col("score") >= min_score)
    ends = found.select("query_id", F.col("path")[0]["from_id"].alias("from_id"), F.col("entity_id").alias("to_id"), (F.col("hop") + 1).alias("depth"), F.col("path_weight").alias("total_weight"), "path")
    heaviest = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("total_weight"), "from_id", "to_id"))
    chains = ends.withColumn("_n", heaviest).where(F.col("_n") <= CHAINS).drop("_n")
    everything = direct.withColumn("hop", F.lit(0))
    everything = everything.unionByName(reached)
    best = F.max_by(F.struct("score", "source", "hop"), F.struct("score", -F.col("hop"), -F.col("query_id")))
    merged = everything.groupBy("memory_id").agg(best.alias("b"), F.sort_array(F.collect_set("query_id")).alias("query_ids"))
    results = merged.select("memory_id", "b.score", "b.source", "b.hop", "query_ids").orderBy(F.desc("score"), "memory_id").limit(most)
    rest = F.min_by(F.struct("depth", "total_weight", "path", "query_id"), "query_id")
    return results, chains.groupBy("from_id", "to_id").agg(rest.alias("c")).select("from_id", "to_id", "c.*").orderBy(F.desc("total_weight"), "from_id", "to_id")
