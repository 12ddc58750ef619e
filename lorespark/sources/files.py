"""Sources: folders of texts, lines of JSON, graph documents, namespaces."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES_MOST = 10_000

LINE = "name string, type string, description string, body string, namespace string, metadata string, entities array<struct<name:string,entity_type:string,type:string,description:string>>, relationships array<struct<source:string,`from`:string,target:string,`to`:string,relation:string,type:string,strength:double,weight:double>>"
GRAPH = "body string, entities array<struct<name:string,entity_type:string,type:string,description:string>>, relationships array<struct<source:string,`from`:string,target:string,`to`:string,relation:string,type:string,strength:double,weight:double>>"


def namespace(given: str | None = None) -> str:
    """The namespace given, else that of the environment, else 'global'."""
    return given or os.environ.get("LORESPARK_NAMESPACE") or "global"


def directory(spark: SparkSession, path: str, pattern: str = "*.md", recursive: bool = False, most: int | None = FILES_MOST) -> DataFrame:
    """``(path, body)``: whole files in the order of their paths; more than ``most`` are refused (None for any number)."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=recursive)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    if most is not None and (found := len(files.inputFiles())) > most:
        raise ValueError(f"{found} files under {path}, more than {most}; give most=None to take them all")
    return rows.orderBy("path")


def ndjson(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines of JSON, one memory each: the good rows, and ``(line)`` of those that can't be read."""
    rows = spark.read.schema(LINE + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    lines = spark.read.text(path).select(F.from_json("value", LINE + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"), "value").where(F.trim("value") != "")
    good = lines.where(F.col("r._corrupt_record").isNull() & F.col("r.name").isNotNull()).select("r.*").drop("_corrupt_record")
    bad = lines.where(F.col("r._corrupt_record").isNotNull() | F.col("r.name").isNull()).select(F.col("value").alias("line"))
    return good.select(*[c for c in rows.columns if c != "_corrupt_record"]), bad


def graph_documents(df: DataFrame, key: str, json: str) -> tuple[DataFrame, DataFrame]:
    """Entities ``(key, name, type, description)`` and edges ``(key, source, target, relation, weight)`` of graph documents.

    'from', 'to', 'type' and 'weight' are read as other names of the fields; documents that aren't JSON give nothing.
    """
    parsed = df.select(key, F.from_json(json, GRAPH).alias("g"))
    e = parsed.select(key, F.explode("g.entities").alias("e")).select(key, "e.name", F.coalesce("e.entity_type", "e.type").alias("type"), "e.description")
    r = parsed.select(key, F.explode("g.relationships").alias("r"))
    edges = r.select(key, F.coalesce("r.source", "r.from").alias("source"), F.coalesce("r.target", "r.to").alias("target"), F.coalesce("r.relation", "r.type").alias("relation"), F.coalesce("r.strength", "r.weight").alias("weight"))
    return e, edges
