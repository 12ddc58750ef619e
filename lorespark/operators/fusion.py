"""Reciprocal rank fusion of ranked lists. Ranks begin at 1; an id absent from a list gets nothing from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def ranked(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``(key, rank)`` of a list already cut to few rows: the one window over it stays small."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order, key)))


def rrf(lists: list[tuple[DataFrame, float]], key: str = "id", rrf_k: int = RRF_K) -> DataFrame:
    """``(key, score)`` of lists ``(key, rank)`` with weights: the sum of weight / (rrf_k + rank)."""
    out = None
    for rows, weight in lists:
        part = rows.select(key, (F.lit(float(weight)) / (F.lit(rrf_k) + F.col("rank"))).alias("_s"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.sum("_s").alias("score"))


def rrf_most(weights: list[float], rrf_k: int = RRF_K) -> float:
    """The score of an id that is first in every list."""
    return sum(weights) / (rrf_k + 1)


def hybrid(vector: DataFrame, text: DataFrame, weight_vector: float = 1.0, weight_text: float = 1.0, rrf_k: int = RRF_K, k: int = 10) -> DataFrame:
    """Both lists fused: id, score, normalized_score, vec_rank, vec_distance, fts_rank, source.

    ``vector``: (id, distance, rank); ``text``: (id, rank). A list of weight 0 is left out.
    """
    most = rrf_most([w for w in (weight_vector, weight_text) if w > 0], rrf_k)
    v = vector.select("id", F.col("rank").alias("vec_rank"), F.col("distance").alias("vec_distance"))
    t = text.select("id", F.col("rank").alias("fts_rank"))
    t = t if weight_text > 0 else t.where(F.lit(False))
    both = v.join(t, "id", "full_outer")
    part = lambda rank, weight: F.coalesce(F.lit(float(weight)) / (F.lit(rrf_k) + F.col(rank)), F.lit(0.0))
    scored = both.withColumn("score", part("vec_rank", weight_vector) + part("fts_rank", weight_text))
    source = F.when(F.col("vec_rank").isNotNull() & F.col("fts_rank").isNotNull(), "hybrid").when(F.col("vec_rank").isNotNull(), "knn").otherwise("fts")
    return scored.withColumn("normalized_score", F.least(F.lit(1.0), F.col("score") / F.lit(most))).withColumn("source", source).orderBy(F.desc("score"), "id").limit(k)
