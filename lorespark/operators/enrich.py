"""Scans for what a store still lacks, the queue of that work, and persisting what came of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.operators.mutate import numbered, upsert_edges, upsert_entities
from lorespark.operators.scan import in_namespaces, like_ignoring_case, live
from lorespark.operators.vector import missing_embeddings
from lorespark.runtime import materialize

SHORT_BODY, SHORT_DESCRIPTION, HIGH_WEIGHT, GENERIC_RELATION, DIM = 200, 30, 0.7, "applies_to", 64
BACKOFF_BASE, BACKOFF_MOST, ATTEMPTS_MOST = 60, 900, 5


def unbound_memories(memories: DataFrame, bindings: DataFrame, namespace: str | None = None) -> DataFrame:
    """Live memories without a binding."""
    return live(memories, namespace).join(bindings.select(F.col("memory_id").alias("id")), "id", "left_anti")


def bound_memories(memories: DataFrame, bindings: DataFrame, names: Sequence[str] | None = None, namespace: str | None = None) -> DataFrame:
    """Live memories with a binding, of some names if given."""
    rows = live(memories, namespace)
    rows = rows.where(F.col("name").isin(list(names))) if names else rows
    return rows.join(bindings.select(F.col("memory_id").alias("id")), "id", "left_semi")


def without_description(entities: DataFrame, namespace: str | None = None) -> DataFrame:
    return in_namespaces(entities, namespace).where(F.col("description").isNull() | (F.col("description") == ""))


def short_bodies(memories: DataFrame, less_than: int = SHORT_BODY, namespace: str | None = None) -> DataFrame:
    return live(memories, namespace).where(F.length(F.coalesce("body", F.lit(""))) < less_than)


def generic_descriptions(memories: DataFrame, namespace: str | None = None) -> DataFrame:
    """Live memories whose description says nothing: that it was ingested, imported or added, or too short."""
    return live(memories, namespace).where(like_ignoring_case("description", "%ingested%", "%imported%", "%added%") | (F.length("description") < SHORT_DESCRIPTION))


def _named(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    s, t = entities.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), entities.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"))
    return relationships.join(s, "source_id").join(t, "target_id").select("id", "source_name", "target_name", "relation", "weight")


def high_weights(relationships: DataFrame, entities: DataFrame, namespace: str | None = None, at_least: float = HIGH_WEIGHT) -> DataFrame:
    """Heavy edges with the names of their ends, the heaviest first."""
    return _named(in_namespaces(relationships, namespace).where(F.col("weight") >= at_least), entities).orderBy(F.desc("weight"), "id")


def generic_relations(relationships: DataFrame, entities: DataFrame, namespace: str | None = None) -> DataFrame:
    return _named(in_namespaces(relationships, namespace).where(F.col("relation") == GENERIC_RELATION), entities)


def unconnected_pairs(entities: DataFrame, relationships: DataFrame, namespace: str, limit: int = 50) -> DataFrame:
    """``(a, b, a_name)``: the first pairs of entities, by ids, with no edge either way: a top-k report.

    An entity with d neighbours has an unconnected one among any d + 1 later ones. So for each of the first
    entities the next ``limit`` and as many more as the widest of them has neighbours hold its first ``limit``
    pairs, and nothing beyond is paired. Should the first entities be connected to all others, more are taken.
    """
    rows = materialize(entities.where(F.col("namespace") == namespace).select("id", "name"), "nodes")
    total = rows.count()
    edges = relationships.where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull()).select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
    taken = limit + 1
    while True:
        heads = rows.orderBy("id").limit(taken).select(F.col("id").alias("a"), F.col("name").alias("a_name"))
        near = edges.join(heads.select("a"), "a", "left_semi")
        widest = near.groupBy("a").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
        tails = rows.orderBy("id").limit(taken + limit + 1 + int(widest)).select(F.col("id").alias("b"))
        found = heads.join(tails, F.col("a") < F.col("b")).join(near, ["a", "b"], "left_anti").orderBy("a", "b").limit(limit).select("a", "b", "a_name")
        found = materialize(found, "pairs")
        if taken >= total or found.count() >= limit:
            return found
        taken *= 4


def re_embed(memories: DataFrame, entities: DataFrame, chunks: DataFrame, memory_vectors: DataFrame, entity_vectors: DataFrame, chunk_vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """``(item_key)`` of everything without a vector of the configured length: names, 'entity:' and 'chunk:' keys."""
    m = missing_embeddings(live(memories), memory_vectors, "memory_id", dim).select(F.col("name").alias("item_key"))
    e = missing_embeddings(entities, entity_vectors, "entity_id", dim).select(F.concat(F.lit("entity:"), F.col("name")).alias("item_key"))
    c = missing_embeddings(chunks.select(F.col("chunk_id").alias("id")), chunk_vectors, "chunk_id", dim).select(F.concat(F.lit("chunk:"), F.col("id").cast("string")).alias("item_key"))
    return m.union(e).union(c)


def backlog(memories: DataFrame, entities: DataFrame, relationships: DataFrame, bindings: DataFrame, memory_vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """``(operation, n)``: how much each scan would find; advisory operations have nothing to do."""
    scans = {
        "memory-bindings": unbound_memories(memories, bindings),
        "entity-descriptions": without_description(entities),
        "body-enrich": short_bodies(memories),
        "re-embed": missing_embeddings(live(memories), memory_vectors, "memory_id", dim),
        "weight-calibrate": relationships.where(F.col("weight") >= HIGH_WEIGHT),
        "relation-reclassify": relationships.where(F.col("relation") == GENERIC_RELATION),
        "entity-type-validate": entities,
        "description-enrich": generic_descriptions(memories),
    }
    out = None
    for name, df in scans.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("operation"), "n")
        out = row if out is None else out.unionByName(row)
    return out


#: Operations without a backlog of their own: they look at whatever there is.
ADVISORY = ("augment-bindings", "entity-connect", "cross-domain-bridges", "domain-classify", "graph-audit", "deep-research-synth", "body-extract")


def backlog_of_namespace(memories: DataFrame, entities: DataFrame, relationships: DataFrame, bindings: DataFrame, memory_vectors: DataFrame, entity_vectors: DataFrame, chunks: DataFrame, chunk_vectors: DataFrame, namespace: str, dim: int = DIM) -> DataFrame:
    """``(operation, n)`` of all fifteen operations in one namespace. Edges belong to the namespace of their source.

    ``chunks``: (chunk_id, memory_id).
    """
    m, e = live(memories, namespace), in_namespaces(entities, namespace)
    outgoing = relationships.join(e.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    of_chunks = chunks.join(m.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    lacking = re_embed(m, e, of_chunks, memory_vectors, entity_vectors, chunk_vectors, dim)
    scans = {
        "memory-bindings": unbound_memories(memories, bindings, namespace),
        "entity-descriptions": without_description(entities, namespace),
        "body-enrich": short_bodies(memories, namespace=namespace),
        "re-embed": lacking,
        "weight-calibrate": outgoing.where(F.col("weight") >= HIGH_WEIGHT),
        "relation-reclassify": outgoing.where(F.col("relation") == GENERIC_RELATION),
        "entity-type-validate": e,
        "description-enrich": generic_descriptions(memories, namespace),
    }
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("operation"), "n") for name, df in scans.items()]
    none = memories.sparkSession.createDataFrame([(name, 0) for name in ADVISORY], "operation string, n bigint")
    for part in parts:
        none = none.unionByName(part)
    return none


def named_live(memories: DataFrame, names: Sequence[str] | None = None, namespace: str | None = None) -> DataFrame:
    """Live memories, of some names if given: what the advisory operations look at."""
    rows = live(memories, namespace)
    return rows.where(F.col("name").isin(list(names))) if names else rows


def clear(queue: DataFrame, operation: object) -> DataFrame:
    """The queue without the rows of an operation: how a plain run of it begins."""
    return queue.where(~F.col("operation").eqNullSafe(F.lit(operation)))


def rescan(queue: DataFrame, items: DataFrame, vetoed: DataFrame, now: Column) -> DataFrame:
    """A further pass: what a scan finds again is queued, but for keys given up in an earlier pass (item_key)."""
    return enqueue(queue, items.join(vetoed.select("item_key"), "item_key", "left_anti"), now)


def persist_bindings(memories: DataFrame, entities: DataFrame, relationships: DataFrame, bindings: DataFrame, found_entities: DataFrame, found_edges: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Extracted entities and edges folded into the graph.

    ``found_entities``: (seq, memory_id, namespace, name, type); ``found_edges``: (seq, namespace, source, target,
    relation, weight). Types and relations are folded onto the vocabularies; edges need both ends.
    """
    typed = found_entities.withColumn("type", T.canonical_entity_type(F.col("type"))).withColumn("description", F.lit(None).cast("string"))
    after = upsert_entities(entities, typed, now)
    ids = after.select("namespace", "name", F.col("id").alias("_id"))
    named = found_entities.select("memory_id", "namespace", T.normalize_entity_name(F.col("name")).alias("name"))
    fresh = named.join(ids, ["namespace", "name"]).join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").select("memory_id", F.col("_id").alias("entity_id")).distinct()
    new = fresh.join(bindings.select("memory_id", "entity_id"), ["memory_id", "entity_id"], "left_anti").withColumn("created_at", F.lit(now).cast("bigint"))
    ends = found_edges.withColumn("_s", T.normalize_entity_name(F.col("source"))).withColumn("_t", T.normalize_entity_name(F.col("target")))
    ends = ends.join(ids.select("namespace", F.col("name").alias("_s"), F.col("_id").alias("source_id")), ["namespace", "_s"]).join(ids.select("namespace", F.col("name").alias("_t"), F.col("_id").alias("target_id")), ["namespace", "_t"])
    edges = ends.select("seq", "namespace", "source_id", "target_id", T.canonical_relation(F.col("relation")).alias("relation"), "weight", F.lit(None).cast("string").alias("description"))
    return after, upsert_edges(relationships, edges, now), bindings.unionByName(new)


def accepted_bodies(memories: DataFrame, rewritten: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``(id, body, score)`` of the rewrites (id, new_body) that keep enough, differ, and are longer."""
    both = memories.select("id", "body").join(rewritten.select("id", "new_body"), "id")
    score = T.trigram_jaccard(F.col("body"), F.col("new_body"))
    return both.withColumn("score", score).where((F.col("score") >= threshold) & (T.body_hash(F.col("body")) != T.body_hash(F.col("new_body"))) & (F.length("new_body") > F.length("body"))).select("id", F.col("new_body").alias("body"), "score")


def enqueue(queue: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """The queue with new items (item_key, operation), numbered behind the rows there; a key already there, in any state, isn't added again."""
    new = numbered(items.select("item_key", "operation").dropDuplicates(["item_key"]).join(queue.select("item_key"), "item_key", "left_anti"), queue, ["item_key"])
    return queue.unionByName(new.withColumn("status", F.lit("pending")).withColumn("attempt", F.lit(0)).withColumn("created_at", now), allowMissingColumns=True)


def eligible(queue: DataFrame, now: int) -> Column:
    return (F.col("status") == "pending") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))


def dequeue(queue: DataFrame, now: int, n: int = 1) -> DataFrame:
    """The oldest rows that may be tried now, as they are once taken."""
    return queue.where(eligible(queue, now)).orderBy("id").limit(n).withColumn("status", F.lit("processing")).withColumn("attempt", F.col("attempt") + 1)


def backoff_seconds(attempt: Column, jitter: Column | None = None) -> Column:
    """One minute doubled with each attempt, a quarter of an hour at most; half of it may be jittered (0 to 1)."""
    # beyond the exponent that reaches the maximum nothing changes
    whole = F.least(F.lit(float(BACKOFF_MOST)), F.lit(float(BACKOFF_BASE)) * F.pow(F.lit(2.0), F.least(attempt, F.lit(10))))
    return whole if jitter is None else whole / 2 + whole / 2 * jitter


def fail(queue: DataFrame, failed: DataFrame, now: int, attempts_most: int = ATTEMPTS_MOST) -> DataFrame:
    """The queue after failures (id, permanent): dead if permanent or tried too often, else pending after a while."""
    marked = queue.join(failed.select("id", F.col("permanent").alias("_p")), "id", "left")
    hit = F.col("_p").isNotNull()
    dead = F.col("_p") | (F.col("attempt") >= attempts_most)
    columns = {"status": F.when(hit, F.when(dead, "dead").otherwise("pending")).otherwise(F.col("status")), "next_retry_at": F.when(hit & ~dead, (F.lit(now) + backoff_seconds(F.col("attempt"))).cast("bigint")).otherwise(F.col("next_retry_at"))}
    return marked.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in queue.columns))


def prune_dead(queue: DataFrame, memories: DataFrame) -> DataFrame:
    """The queue without dead rows whose memory is gone or deleted."""
    alive = live(memories).select(F.col("name").alias("item_key"))
    gone = queue.where("status = 'dead'").join(alive, "item_key", "left_anti").select("id")
    return queue.join(gone, "id", "left_anti")


def list_dead(queue: DataFrame) -> DataFrame:
    return queue.where("status = 'dead'").orderBy("id")


def requeue_dead(queue: DataFrame) -> DataFrame:
    """Dead rows to be tried from the start."""
    dead = F.col("status") == "dead"
    return queue.withColumn("attempt", F.when(dead, 0).otherwise(F.col("attempt"))).withColumn("next_retry_at", F.when(dead, F.lit(None)).otherwise(F.col("next_retry_at"))).withColumn("status", F.when(dead, "pending").otherwise(F.col("status")))


def resume(queue: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Rows left in processing, and failed ones if wanted, back to pending: how a drained run begins again."""
    back = F.col("status").isin("processing", *(["failed"] if retry_failed else []))
    return queue.withColumn("status", F.when(back, "pending").otherwise(F.col("status")))
