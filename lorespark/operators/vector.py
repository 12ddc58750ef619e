"""Exact nearest neighbours by cosine, coverage of embeddings, pooling.

Scores are computed in batches over Arrow buffers with one matrix product; the best k come from the partial
top-k of every task. A vector of another length or of norm zero has similarity 0; null vectors are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.operators.scan import in_namespaces, live


def _matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of ``dim`` numbers as a matrix, and their row numbers."""
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    fit = vectors.take(pa.array(rows))
    flat = pc.fill_null(fit.flatten(), 0.0).to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dim), rows


def cosine(vectors: Column, query: Sequence[float]) -> Column:
    """Similarity of each vector to one query vector."""
    q = np.asarray(query, np.float64)
    size = float(np.sqrt(q @ q))

    @F.arrow_udf("double")
    def score(batch: pa.Array) -> pa.Array:
        matrix, rows = _matrix(batch, len(q))
        norm = np.sqrt(np.einsum("ij,ij->i", matrix, matrix)) * size
        out = np.zeros(len(batch))
        out[rows] = np.divide(matrix @ q, norm, out=np.zeros(len(rows)), where=norm > 0)
        return pa.array(out)

    return score(vectors)


def distance(similarity: Column) -> Column:
    return F.lit(1.0) - similarity


def score_of_distance(d: Column) -> Column:
    """1 - distance within 0 and 1, 0 for what is no number."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.nanvl(d, F.lit(1.0))))


def knn_memories(embeddings: DataFrame, memories: DataFrame, query: Sequence[float], k: int = 10, namespaces: Sequence[str] | None = None, type_: str | None = None, live_only: bool = True) -> DataFrame:
    """``(memory_id, distance)`` of the k nearest, ties by id.

    With ``live_only`` deleted memories are left out before the cut, so k rows come back where there are k;
    without it they are counted against k, as a store that looks liveness up later does.
    """
    rows = in_namespaces(embeddings, namespaces).where(F.size("embedding") == len(query)).select("memory_id", "embedding")
    if live_only or type_:
        wanted = live(memories, None, type_) if live_only else memories.where(F.col("type") == type_)
        rows = rows.join(wanted.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    return rows.select("memory_id", distance(cosine(F.col("embedding"), query)).alias("distance")).orderBy("distance", "memory_id").limit(k)


def knn_entities(embeddings: DataFrame, query: Sequence[float], namespace: str | None = None, k: int = 5) -> DataFrame:
    """``(entity_id, similarity)`` of the k nearest, the most alike first."""
    rows = in_namespaces(embeddings, namespace).where(F.size("embedding") == len(query))
    return rows.select("entity_id", cosine(F.col("embedding"), query).alias("similarity")).orderBy(F.desc("similarity"), "entity_id").limit(k)


def knn_chunks(embeddings: DataFrame, query: Sequence[float], k: int = 10) -> DataFrame:
    """``(chunk_id, memory_id, similarity)`` over all namespaces; a memory may come with several chunks."""
    rows = embeddings.where(F.size("embedding") == len(query))
    return rows.select("chunk_id", "memory_id", cosine(F.col("embedding"), query).alias("similarity")).orderBy(F.desc("similarity"), "chunk_id").limit(k)


def knn_many(embeddings: DataFrame, key: str, queries: dict[int, Sequence[float]], k: int = 20) -> DataFrame:
    """``(query_id, key, distance, rank)``: the k nearest of each of several queries in one pass over the vectors.

    Each task keeps its best k of every query, so at most k rows a query and task are ranked.
    """
    ids = list(queries)
    matrix = np.array([queries[i] for i in ids], np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int]]] = {i: [] for i in ids}
        for batch in batches:
            vectors, rows = _matrix(batch.column(1), matrix.shape[1])
            keys = batch.column(0).to_numpy(zero_copy_only=False)[rows]
            size = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None] * norms[None, :]
            d = 1.0 - np.divide(vectors @ matrix.T, size, out=np.zeros(size.shape), where=size > 0)
            for at, i in enumerate(ids):
                order = np.lexsort((keys, d[:, at]))[:k]
                best[i] = sorted(best[i] + [(float(d[o, at]), int(keys[o])) for o in order])[:k]
        out = [(i, key_, d) for i, found in best.items() for d, key_ in found]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], ["query_id", key, "distance"])

    near = embeddings.select(F.col(key).cast("bigint").alias(key), "embedding").mapInArrow(run, f"query_id int, `{key}` bigint, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", key))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def missing_embeddings(owners: DataFrame, embeddings: DataFrame, owner_key: str, dim: int) -> DataFrame:
    """Owners without a vector of the configured length."""
    good = embeddings.where((F.col("dim") == dim) & (F.size("embedding") > 0)).select(F.col(owner_key).alias("id"))
    return owners.join(good, "id", "left_anti")


def orphan_vectors(embeddings: DataFrame, memories: DataFrame) -> DataFrame:
    """Vectors whose memory is missing or deleted."""
    return embeddings.join(live(memories).select(F.col("id").alias("memory_id")), "memory_id", "left_anti")


def purge_orphans(embeddings: DataFrame, memories: DataFrame) -> DataFrame:
    """The vectors whose memory is there and not deleted."""
    return embeddings.join(live(memories).select(F.col("id").alias("memory_id")), "memory_id", "left_semi")


def coverage(owners: DataFrame, embeddings: DataFrame, owner_key: str, dim: int, table: str) -> DataFrame:
    """``(table, total, with_vector, missing, coverage_pct)``; 100 % of nothing."""
    good = embeddings.where((F.col("dim") == dim) & (F.size("embedding") > 0)).select(F.col(owner_key).alias("id")).distinct().withColumn("_v", F.lit(1))
    counts = owners.select("id").join(good, "id", "left").agg(F.count(F.lit(1)).alias("total"), F.count("_v").alias("with_vector"))
    pct = F.when(F.col("total") == 0, F.lit(100.0)).otherwise(F.col("with_vector") * 100.0 / F.col("total"))
    return counts.select(F.lit(table).alias("table"), "total", "with_vector", (F.col("total") - F.col("with_vector")).alias("missing"), pct.alias("coverage_pct"))


def by_dimension(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, dim, n)`` over several embedding tables."""
    out = None
    for name, df in tables.items():
        part = df.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "dim", "n")
        out = part if out is None else out.unionByName(part)
    return out


def vector_stats(embeddings: DataFrame, memories: DataFrame) -> DataFrame:
    """``(total, orphaned)``."""
    owners = live(memories).select(F.col("id").alias("memory_id"), F.lit(1).alias("_m"))
    return embeddings.join(owners, "memory_id", "left").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("_m").isNull()).alias("orphaned"))


def mean_pool(chunks: DataFrame, group: str, dim: int) -> DataFrame:
    """``(group, embedding)``: mean of a group's vectors, scaled to length 1 if longer than 1e-9; a single one as it is.

    Each batch adds up the vectors of a group in one product and hands on one row a group; those partial sums, as
    many as batches hold the group, are added position by position in an aggregation that combines before it
    shuffles, so no task holds a group and vectors are never spelled out one number a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, rows = _matrix(batch.column(1), dim)
            keys = batch.column(0).take(pa.array(rows)).dictionary_encode()
            groups = keys.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(groups, kind="stable")
            first = np.flatnonzero(np.diff(groups[order], prepend=-1))
            sums = np.add.reduceat(vectors[order], first) if len(first) else np.zeros((0, dim))
            n = np.diff(np.append(first, len(order)))
            offsets = pa.array(np.arange(0, dim * len(first) + 1, dim), pa.int32())
            yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(groups[order][first])), pa.ListArray.from_arrays(offsets, pa.array(sums.reshape(-1))), pa.array(n, pa.int64())], [group, "s", "n"])

    kind = chunks.schema[group].dataType.simpleString()
    usable = chunks.where((F.size("embedding") == dim) & F.col(group).isNotNull())
    partial = usable.select(group, "embedding").mapInArrow(run, f"`{group}` {kind}, s array<double>, n bigint")
    sums = partial.groupBy(group).agg(*(F.sum(F.col("s")[k]).alias(f"_{k}") for k in range(dim)), F.sum("n").alias("n"))
    mean = sums.select(group, "n", F.array(*(F.col(f"_{k}") / F.col("n") for k in range(dim))).alias("m"))
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda t, x: t + x * x))
    scaled = F.when((F.col("n") > 1) & (F.col("norm") > 1e-9), F.transform("m", lambda x: x / F.col("norm"))).otherwise(F.col("m"))
    return mean.withColumn("norm", norm).select(group, scaled.alias("embedding"))


def decode_vector(raw: Column) -> Column:
    """Little-endian 32-bit floats of a binary value; bytes that fill no number are ignored."""

    @F.arrow_udf("array<float>")
    def decode(values: pa.Array) -> pa.Array:
        return pa.array([None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4") for b in values.to_pylist()], pa.list_(pa.float32()))

    return decode(raw)


def encode_vector(vector: Column) -> Column:
    @F.arrow_udf("binary")
    def encode(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None else np.asarray(x, "<f4").tobytes() for x in values.to_pylist()], pa.binary())

    return encode(vector)


#: What a model of asymmetric search expects before a text.
QUERY_PREFIX, PASSAGE_PREFIX = "query: ", "passage: "


def entity_text(name: Column, description: Column) -> Column:
    """What an entity's vector is made from."""
    return F.concat_ws(" ", name, F.when(description != "", description))


def hashing_embedder(texts: Column, dim: int = 64) -> Column:
    """A stand-in for a model: signed feature hashing of the tokens, scaled to length 1."""
    import zlib

    from lorespark.functions.text import tokens_of

    @F.arrow_udf("array<float>")
    def embed(batch: pa.Array) -> pa.Array:
        out = []
        for t in batch.to_pylist():
            x = np.zeros(dim, np.float32)
            for token in tokens_of(t or ""):
                h = zlib.crc32(token.encode())
                x[h % dim] += 1.0 if h >> 31 else -1.0
            size = float(np.sqrt(x @ x))
            out.append(x / size if size else x)
        return pa.array(out, pa.list_(pa.float32()))

    return embed(texts)
