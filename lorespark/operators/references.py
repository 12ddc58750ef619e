"""References to records that do not exist, from signed counts per key.

Deltas: a referring row adds (or, with sign -1, takes away) one reference of its key, a record adds or takes
away one existence, and a deleted record exists no longer. The state sums the deltas of each key: its references in
one row, its records in one a time of creation, so a record taken away and made anew at another time is known by
the time that is left; keys with positive references and no existence, or with a reference older than the record,
form the current orphans. Rows that come to nothing leave the state. A key with a third of all references costs
one row after the combine before the shuffle; the way back to the referring rows is salted.

Defined cases: a null key is no reference; a record repeated in every column counts once; a missing creation
time on either side is never later than anything; empty tables give no orphans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16
STATE = ["refers_to", "key", "made_at", "refs", "exists", "rows", "first_ref_at"]


def _deltas(table: DataFrame, refers_to: str, key: str, /, **columns: Column) -> DataFrame:
    return table.where(F.col(key).isNotNull()).select(F.lit(refers_to).alias("refers_to"), F.col(key).cast("bigint").alias("key"), *(columns.get(c, F.lit(None)).cast("bigint").alias(c) for c in STATE[2:]))


def reference_deltas(rows: DataFrame, refers_to: str, key: str, at: str, sign: int = 1) -> DataFrame:
    """Deltas of referring rows: one reference of ``key`` each."""
    return _deltas(rows, refers_to, key, refs=F.lit(sign), exists=F.lit(0), rows=F.lit(0), first_ref_at=F.col(at))


def existence_deltas(rows: DataFrame, refers_to: str, key: str, at: str, deleted_at: str | None = None, sign: int = 1) -> DataFrame:
    """Deltas of records: one existence each, none for a deleted one, at the time of creation."""
    lives = F.lit(sign) if deleted_at is None else F.when(F.col(deleted_at).isNull(), sign).otherwise(0)
    return _deltas(rows, refers_to, key, made_at=F.col(at), refs=F.lit(0), exists=lives, rows=F.lit(sign))


def apply_deltas(state: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """The state after some deltas. They may come in any order and in any number of steps.

    ``first_ref_at`` is the least over all references seen; taking one away may leave it too early, which only adds
    keys to look at in ``orphan_references``.
    """
    both = deltas.select(*STATE) if state is None else state.select(*STATE).unionByName(deltas.select(*STATE))
    sums = both.groupBy("refers_to", "key", "made_at").agg(*(F.sum(c).alias(c) for c in ("refs", "exists", "rows")), F.min("first_ref_at").alias("first_ref_at"))
    return sums.where((F.col("refs") != 0) | (F.col("exists") != 0) | (F.col("rows") != 0)).select(*STATE)


def orphan_keys(state: DataFrame) -> DataFrame:
    """``(refers_to, key, refs, exists, known_at, first_ref_at)`` of the keys with references and without existence, or referred to before they were made."""
    known = F.max(F.when(F.col("rows") > 0, F.col("made_at")))
    keys = state.groupBy("refers_to", "key").agg(F.sum("refs").alias("refs"), F.sum("exists").alias("exists"), known.alias("known_at"), F.min("first_ref_at").alias("first_ref_at"))
    return keys.where((F.col("refs") > 0) & ((F.col("exists") <= 0) | (F.col("known_at") > F.col("first_ref_at"))))


def orphan_references(references: DataFrame, state: DataFrame) -> DataFrame:
    """The references ``(refers_to, ref_field, from_id, to_id, at)`` that lead to an orphan key, or run ahead of its record."""
    keys = orphan_keys(state).select("refers_to", F.col("key").alias("to_id"), "exists", "known_at").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = references.withColumn("_salt", F.pmod(F.xxhash64("from_id", "at"), F.lit(SALTS)).cast("int"))
    return salted.join(keys, ["refers_to", "to_id", "_salt"]).where((F.col("exists") <= 0) | (F.col("known_at") > F.col("at"))).select(*references.columns)


def with_period(orphans: DataFrame) -> DataFrame:
    """``(ref_field, from_id, to_id, period)``; the period is the month of the referring row in UTC."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("at") / 86400).cast("int"))
    return orphans.select("ref_field", "from_id", "to_id", F.date_format(day, "yyyy-MM").alias("period"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """``(ref_field, period, n_references, n_keys)``: orphans counted per table and month."""
    return with_period(orphans).groupBy("ref_field", "period").agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("to_id").alias("n_keys"))


def load_references(memories: DataFrame, entities: DataFrame, relationships: DataFrame, bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All references of the store's tables and the state after loading them."""
    bound = bindings.where(F.col("entity_id").isNotNull()).select("memory_id", "entity_id", "created_at").distinct()
    edges = relationships.select("id", "source_id", "target_id", "created_at").distinct()

    def refs(rows: DataFrame, table: str, to: str, from_: str, refers_to: str) -> DataFrame:
        return rows.where(F.col(to).isNotNull()).select(F.lit(refers_to).alias("refers_to"), F.lit(f"{table}.{to}").alias("ref_field"), F.col(from_).alias("from_id"), F.col(to).alias("to_id"), F.col("created_at").alias("at"))

    references = (
        refs(bound, "memory_entities", "memory_id", "entity_id", "memories")
        .unionByName(refs(bound, "memory_entities", "entity_id", "memory_id", "entities"))
        .unionByName(refs(edges, "relationships", "source_id", "id", "entities"))
        .unionByName(refs(edges, "relationships", "target_id", "id", "entities"))
    )
    deltas = (
        reference_deltas(references.where("refers_to = 'memories'"), "memories", "to_id", "at")
        .unionByName(reference_deltas(references.where("refers_to = 'entities'"), "entities", "to_id", "at"))
        .unionByName(existence_deltas(memories.select("id", "deleted_at", "created_at").distinct(), "memories", "id", "created_at", "deleted_at"))
        .unionByName(existence_deltas(entities.select("id", "created_at").distinct(), "entities", "id", "created_at"))
    )
    return references, apply_deltas(None, deltas)
