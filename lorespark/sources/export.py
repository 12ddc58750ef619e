"""Sinks: lines of JSON, graph snapshots, DOT and Mermaid text. All return DataFrames to be written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.operators.scan import live, named_relationships


def memory_lines(memories: DataFrame, namespace: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(name, line)`` of each live memory in the order of names, and one summary line."""
    rows = live(memories, namespace)
    fields = [c for c in ("id", "namespace", "name", "type", "description", "body", "created_at", "updated_at") if c in rows.columns]
    lines = rows.select("name", "id", F.to_json(F.struct(*fields)).alias("line")).orderBy("name", "id").select("name", "line")
    summary = rows.agg(F.count(F.lit(1)).alias("exported")).select(F.to_json(F.struct(F.lit(True).alias("summary"), "exported")).alias("line"))
    return lines, summary


def snapshot(entities: DataFrame, relationships: DataFrame, namespace: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges with names, and ``(dropped)``: edges left out because an end is missing."""
    from lorespark.operators.scan import in_namespaces

    nodes = in_namespaces(entities, namespace).select("id", "name", "type", "namespace")
    edges = named_relationships(relationships, entities, namespace).select("id", "source_id", "target_id", "source_name", "target_name", "relation", "weight")
    lost = in_namespaces(relationships, namespace).join(edges.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("dropped"))
    return nodes, edges, lost


def graph_lines(entities: DataFrame, relationships: DataFrame, namespace: str | None = None) -> DataFrame:
    """``(part, id, line)``: node lines, edge lines, a summary line, in that order."""
    nodes, edges, _ = snapshot(entities, relationships, namespace)
    n = nodes.select(F.lit(0).alias("part"), "id", F.to_json(F.struct(F.lit("node").alias("kind"), "id", "name", "type")).alias("line"))
    e = edges.select(F.lit(1).alias("part"), "id", F.to_json(F.struct(F.lit("edge").alias("kind"), "id", F.col("source_name").alias("source"), F.col("target_name").alias("target"), "relation", "weight")).alias("line"))
    counts = nodes.agg(F.count(F.lit(1)).alias("nodes")).withColumn("edges", edges.agg(F.count(F.lit(1)).alias("edges")).scalar())
    s = counts.select(F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("id"), F.to_json(F.struct(F.lit("summary").alias("kind"), "nodes", "edges")).alias("line"))
    return n.unionByName(e).unionByName(s).orderBy("part", "id")


def identifier(name: Column) -> Column:
    """A name as an identifier of a drawing language."""
    return F.regexp_replace(name, "[^A-Za-z0-9_]", "_")


def dot(entities: DataFrame, relationships: DataFrame, namespace: str | None = None) -> DataFrame:
    """``(part, id, line)`` of a DOT document."""
    nodes, edges, _ = snapshot(entities, relationships, namespace)
    quoted = lambda c: F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    n = nodes.select(F.lit(1).alias("part"), "id", F.concat(F.lit("  "), identifier(F.col("name")), F.lit(' [label="'), quoted("name"), F.lit('"];')).alias("line"))
    e = edges.select(F.lit(2).alias("part"), "id", F.concat(F.lit("  "), identifier(F.col("source_name")), F.lit(" -> "), identifier(F.col("target_name")), F.lit(' [label="'), quoted("relation"), F.lit('"];')).alias("line"))
    spark = entities.sparkSession
    frame = spark.createDataFrame([(0, 0, "digraph lore {"), (3, 0, "}")], "part int, id bigint, line string")
    return frame.unionByName(n).unionByName(e).orderBy("part", "id")


def mermaid(entities: DataFrame, relationships: DataFrame, namespace: str | None = None) -> DataFrame:
    """``(part, id, line)`` of a Mermaid flow chart."""
    nodes, edges, _ = snapshot(entities, relationships, namespace)
    safe = lambda c: F.replace(F.replace(F.col(c), F.lit('"'), F.lit("'")), F.lit("|"), F.lit("/"))
    n = nodes.select(F.lit(1).alias("part"), "id", F.concat(F.lit("  "), identifier(F.col("name")), F.lit('["'), safe("name"), F.lit('"]')).alias("line"))
    e = edges.select(F.lit(2).alias("part"), "id", F.concat(F.lit("  "), identifier(F.col("source_name")), F.lit(" -->|"), safe("relation"), F.lit("| "), identifier(F.col("target_name"))).alias("line"))
    frame = entities.sparkSession.createDataFrame([(0, 0, "graph LR")], "part int, id bigint, line string")
    return frame.unionByName(n).unionByName(e).orderBy("part", "id")
