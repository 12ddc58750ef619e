"""Counts, ratios and health figures of a store. Aggregates over nothing are 0, ratios over nothing null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.text import normalize_entity_name
from lorespark.operators.graph import endpoints
from lorespark.operators.scan import in_namespaces, live

HUB_DEGREE, RELATION_WARN, MENTIONS_WARN = 50, 0.40, 0.5


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def rows_of(df: DataFrame) -> Column:
    """The number of rows as a scalar subquery."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def overview(memories: DataFrame, entities: DataFrame, relationships: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """One row: live memories, their mean length and namespaces, entities, edges, chunks."""
    m = live(memories).agg(F.count(F.lit(1)).alias("memories"), F.coalesce(F.avg(F.length("body")), F.lit(0.0)).alias("avg_body_len"), F.countDistinct("namespace").alias("namespaces"))
    others = {"entities": entities, "relationships": relationships, "chunks": chunks}
    return m.select("*", *(rows_of(df).alias(name) for name, df in others.items() if df is not None))


def count_by_type(memories: DataFrame) -> DataFrame:
    return live(memories).groupBy("namespace", "type").agg(F.count(F.lit(1)).alias("n"))


def active_namespaces(memories: DataFrame) -> DataFrame:
    """``(namespace, n)``, live memories only."""
    return live(memories).groupBy("namespace").agg(F.count(F.lit(1)).alias("n")).orderBy("namespace")


def relation_counts(relationships: DataFrame) -> DataFrame:
    return relationships.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def relation_concentration(relationships: DataFrame) -> DataFrame:
    """``(relation, n, share, warn)`` of the most frequent relation."""
    counts = relation_counts(relationships.where(F.col("relation").isNotNull()))
    top = counts.orderBy(F.desc("n"), "relation").limit(1).withColumn("_total", rows_of(relationships))
    return top.select("relation", "n", ratio(F.col("n"), F.col("_total")).alias("share"), (F.col("n") > RELATION_WARN * F.col("_total")).alias("warn"))


def relation_ratios(relationships: DataFrame) -> DataFrame:
    """One row: the shares of the two unspecific relations."""
    c = relationships.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("relation") == "mentions").alias("m"), F.count_if(F.col("relation") == "applies_to").alias("a"))
    return c.select(F.col("n").alias("relationships"), ratio(F.col("m"), F.col("n")).alias("mentions_ratio"), (F.col("m") > MENTIONS_WARN * F.col("n")).alias("mentions_warn"), ratio(F.col("a"), F.col("n")).alias("applies_to_ratio"))


def hubs(entities: DataFrame, relationships: DataFrame, more_than: int = HUB_DEGREE, limit: int = 5) -> DataFrame:
    """``(id, name, degree)`` of the entities of highest degree over a bound."""
    d = endpoints(relationships).groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") > more_than)
    return entities.select("id", "name").join(d, F.col("id") == F.col("entity_id")).select("id", "name", "degree").orderBy(F.desc("degree"), "name", "id").limit(limit)


def graph_stats(entities: DataFrame, relationships: DataFrame, namespace: str | None = None) -> DataFrame:
    """``(node_count, edge_count, max_degree, max_live_degree, avg_degree)``; avg = 2 E / N."""
    nodes, edges = in_namespaces(entities, namespace), in_namespaces(relationships, namespace)
    n = nodes.agg(F.count(F.lit(1)).alias("node_count"), F.max("degree").alias("max_degree"))
    d = endpoints(edges).groupBy("entity_id").agg(F.count(F.lit(1)).alias("d")).agg(F.coalesce(F.max("d"), F.lit(0)).alias("d"))
    one = n.select("*", rows_of(edges).alias("edge_count"), d.scalar().alias("max_live_degree"))
    return one.select("node_count", "edge_count", "max_degree", "max_live_degree", F.coalesce(ratio(F.col("edge_count") * 2.0, F.col("node_count")), F.lit(0.0)).alias("avg_degree"))


def purge_metrics(memories: DataFrame, cutoff: int, namespace: str | None = None) -> DataFrame:
    """``(n, chars, oldest)`` of the deleted rows at or before a cutoff."""
    size = F.coalesce(F.length("body"), F.lit(0)) + F.coalesce(F.length("description"), F.lit(0)) + F.coalesce(F.length("name"), F.lit(0))
    gone = in_namespaces(memories, namespace).where(F.col("deleted_at") <= cutoff)
    return gone.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("chars"), F.min("deleted_at").alias("oldest"))


def dangling_bindings(bindings: DataFrame, memories: DataFrame, entities: DataFrame) -> DataFrame:
    """Bindings one of whose ends is missing."""
    b = bindings.select("memory_id", "entity_id").distinct()
    no_memory = b.join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_anti").select("memory_id", "entity_id")
    no_entity = b.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_anti").select("memory_id", "entity_id")
    return no_memory.union(no_entity).distinct()


def unnormalized_names(entities: DataFrame) -> DataFrame:
    """``(id, namespace, name, normal)`` of the names that aren't in normal form."""
    rows = entities.select("id", "namespace", "name", normalize_entity_name(F.col("name")).alias("normal"))
    return rows.where(F.col("name") != F.col("normal"))


def health(memories: DataFrame, entities: DataFrame, relationships: DataFrame, bindings: DataFrame, embeddings: DataFrame) -> DataFrame:
    """``(check_name, value)``: one row a check."""
    missing = live(memories).join(embeddings.select(F.col("memory_id").alias("id")), "id", "left_anti")
    stale = embeddings.join(live(memories).select(F.col("id").alias("memory_id")), "memory_id", "left_anti")
    checks = {
        "live_memories": live(memories),
        "entities": entities,
        "relationships": relationships,
        "memories_without_vector": missing,
        "vectors_without_memory": stale,
        "dangling_bindings": dangling_bindings(bindings, memories, entities),
        "names_not_normal": unnormalized_names(entities),
    }
    out = None
    for name, df in checks.items():
        row = df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("check_name"), "value")
        out = row if out is None else out.unionByName(row)
    return out


def health_report(memories: DataFrame, entities: DataFrame, relationships: DataFrame, bindings: DataFrame, embeddings: DataFrame) -> DataFrame:
    """``(check_name, value, warn)``: the counts of ``health``, the ratios and hubs, and whether each calls for attention.

    A warning stands for: vectors missing or left over, bindings that dangle, names not in normal form, a relation
    of more than 40 % of the edges, mentions of more than half, and any hub.
    """
    quiet = ("live_memories", "entities", "relationships")
    counts = health(memories, entities, relationships, bindings, embeddings).select("check_name", F.col("value").cast("double").alias("value"), (~F.col("check_name").isin(*quiet) & (F.col("value") > 0)).alias("warn"))
    row = lambda df, name, value, warn: df.select(F.lit(name).alias("check_name"), value.cast("double").alias("value"), F.coalesce(warn, F.lit(False)).alias("warn"))
    ratios = relation_ratios(relationships)
    top = relation_concentration(relationships)
    degree = endpoints(relationships).groupBy("entity_id").agg(F.count(F.lit(1)).alias("d")).agg(F.max("d").alias("most"), F.count_if(F.col("d") > HUB_DEGREE).alias("n"))
    missing, alive = F.col("m"), F.col("a")
    covered = live(memories).select("id").join(embeddings.select(F.col("memory_id").alias("id"), F.lit(1).alias("_v")).distinct(), "id", "left").agg(F.count_if(F.col("_v").isNull()).alias("m"), F.count(F.lit(1)).alias("a"))
    more = [
        row(covered, "vector_coverage_pct", F.when(alive == 0, 100.0).otherwise((alive - missing) * 100.0 / alive), missing > 0),
        row(ratios, "mentions_ratio", F.col("mentions_ratio"), F.col("mentions_warn")),
        row(ratios, "applies_to_ratio", F.col("applies_to_ratio"), F.lit(False)),
        row(top, "top_relation_share", F.col("share"), F.col("warn")),
        row(degree, "super_hubs", F.col("n"), F.col("n") > 0),
        row(degree, "max_degree", F.coalesce("most", F.lit(0)), F.lit(False)),
    ]
    for part in more:
        counts = counts.unionByName(part)
    return counts


def queue_status(queue: DataFrame, now: int) -> DataFrame:
    """``(operation, status, n, eligible, waiting)``: pending rows are eligible once their next try has come."""
    later = F.col("next_retry_at").isNotNull() & (F.col("next_retry_at") > now)
    pending = F.col("status") == "pending"
    return queue.groupBy("operation", "status").agg(F.count(F.lit(1)).alias("n"), F.count_if(pending & ~later).alias("eligible"), F.count_if(pending & later).alias("waiting"))


def queue_state(queue: DataFrame, backlog: DataFrame, now: int) -> DataFrame:
    """``(state)``: draining, cooldown, pending-scan or empty."""
    later = F.col("next_retry_at").isNotNull() & (F.col("next_retry_at") > now)
    q = queue.agg(F.count_if((F.col("status") == "processing") | (F.col("status") == "pending") & ~later).alias("_now"), F.count_if((F.col("status") == "pending") & later).alias("_later"))
    state = F.when(F.col("_now") > 0, "draining").when(F.col("_later") > 0, "cooldown").when(rows_of(backlog) > 0, "pending-scan").otherwise("empty")
    return q.select(state.alias("state"))
