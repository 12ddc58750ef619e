"""Versioned changes as pure functions from tables to tables.

Parquet isn't changed in place: a function returns the new table, and ``sources.snapshot`` writes it beside the
old one and swaps a pointer. Upserts are full outer joins on the natural key; of several incoming rows with one
key the last in the given order wins.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.functions import vocabulary as v


def last_of(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(order, F.xxhash64(*rest))).alias("_r")).select(*key, "_r.*")


def numbered(new: DataFrame, existing: DataFrame, order: Sequence[str], id_: str = "id") -> DataFrame:
    """Ids after the greatest existing one, in a stable order.

    Rows are ranked within hash buckets and offset by the buckets' sizes, so no task orders all of them.
    """
    buckets = 256
    placed = new.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_offset"))  # at most 256 rows
    most = existing.agg(F.coalesce(F.max(id_), F.lit(0)).cast("bigint").alias("_most")).scalar()
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    ranked = placed.withColumn("_rank", rank).join(F.broadcast(offsets), "_bucket")
    return ranked.withColumn(id_, most + F.col("_offset") + F.col("_rank")).drop("_bucket", "_rank", "_offset")


def valid_memories(incoming: DataFrame) -> DataFrame:
    """Incoming rows with ``slug`` and ``problem`` (null for what may be stored)."""
    slug = T.memory_slug(F.col("name"))
    problem = (
        F.when(F.coalesce(slug, F.lit("")) == "", "empty name")
        .when(slug.startswith("__"), "reserved name")
        .when(~T.valid_memory_slug(slug), "bad name")
        .when(~F.coalesce(F.col("type"), F.lit("")).isin(*v.MEMORY_TYPES), "bad type")
        .when(F.length("description") > v.DESCRIPTION_MOST, "long description")
        .when(F.octet_length("body") > v.BODY_BYTES_MOST, "long body")
    )
    return incoming.withColumn("slug", slug).withColumn("problem", problem)


def remember(memories: DataFrame, versions: DataFrame, incoming: DataFrame, now: int, merge: bool = True, skip_equal_bodies: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Create or merge memories by (namespace, name): new memories, new versions, and an outcome of each incoming row.

    ``incoming``: (seq, namespace, name, type, description, body, source, metadata), in the order of ``seq``.
    A merge keeps what the incoming row leaves null, keeps the old body for an empty one, revives a deleted row,
    and adds a version only if something changed. Without ``merge`` a taken name is an error. With
    ``skip_equal_bodies`` a body already live in the namespace, or borne by an earlier row of the batch under
    another name, is skipped. Outcomes: created, merged, unchanged, skipped, superseded (a later row of the batch
    has its name) or the problem.
    """
    checked = valid_memories(incoming)
    good = checked.where(F.col("problem").isNull()).withColumn("name", F.col("slug"))
    if skip_equal_bodies:
        known = memories.where(F.col("deleted_at").isNull()).select("namespace", T.body_hash(F.col("body")).alias("_h"), F.col("name").alias("_owner")).where(F.col("_h").isNotNull())
        hashed = good.select("namespace", "name", "seq", T.body_hash(F.col("body")).alias("_h"))
        before = hashed.groupBy("namespace", "_h").agg(F.min_by("name", "seq").alias("_owner")).where(F.col("_h").isNotNull())
        same = hashed.join(known.unionByName(before), ["namespace", "_h"]).where(F.col("_owner") != F.col("name")).select("seq").distinct()
        skipped, good = good.join(same, "seq", "left_semi"), good.join(same, "seq", "left_anti")
    else:
        skipped = good.where(F.lit(False))
    fields = ["type", "description", "body", "source", "metadata"]
    one = last_of(good.select("namespace", "name", "seq", *fields), ["namespace", "name"], "seq")
    new = one.select("namespace", "name", "seq", *(F.col(c).alias(f"_{c}") for c in fields), F.lit(True).alias("_in"))
    both = memories.join(new, ["namespace", "name"], "full_outer")
    there, comes = F.col("id").isNotNull(), F.coalesce("_in", F.lit(False))
    body = F.when(there & (F.coalesce("_body", F.lit("")) == ""), F.col("body")).otherwise(F.col("_body"))
    merged = {c: F.coalesce(f"_{c}", c) for c in ("type", "description", "source", "metadata")} | {"body": body}
    changed = comes & there & (F.col("deleted_at").isNotNull() | F.lit(False))
    for c in ("type", "description", "body"):
        changed = changed | (comes & there & ~merged[c].eqNullSafe(F.col(c)))
    allowed = comes & (~there | F.lit(merge))
    outcome = F.when(~comes, F.lit(None)).when(~there, "created").when(~F.lit(merge), F.when(F.col("deleted_at").isNotNull(), "name of a deleted memory").otherwise("duplicate name")).when(changed, "merged").otherwise("unchanged")
    state = both.withColumn("_outcome", outcome).withColumn("_apply", allowed & F.col("_outcome").isin("created", "merged"))
    for c, value in merged.items():
        state = state.withColumn(f"_new_{c}", value)
    old = state.where(there)
    ids = numbered(state.where(~there).drop("id"), memories, ["namespace", "name"])
    state = old.unionByName(ids, allowMissingColumns=True)
    apply_ = F.col("_apply")
    columns = {c: F.when(apply_, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in merged}
    columns |= {
        "body_hash": F.when(apply_, T.body_hash(F.col("_new_body"))).otherwise(F.col("body_hash")),
        "deleted_at": F.when(apply_, F.lit(None).cast("bigint")).otherwise(F.col("deleted_at")),
        "created_at": F.when(F.col("_outcome") == "created", F.lit(now)).otherwise(F.col("created_at")),
        "updated_at": F.when(apply_, F.lit(now)).otherwise(F.col("updated_at")),
    }
    after = state.select(*(columns.get(c, F.col(c)).alias(c) if c in columns else F.col(c) for c in memories.columns))
    fresh = state.where(apply_).select(F.col("id").alias("memory_id"), F.when(F.col("_outcome") == "created", "create").otherwise("edit").alias("change_reason"), F.col("_new_body").alias("body"))
    outcomes = state.where("_in").select("seq", F.col("_outcome").alias("outcome"))
    losers = good.join(one.select("seq"), "seq", "left_anti").select("seq", F.lit("superseded").alias("outcome"))
    bad = checked.where(F.col("problem").isNotNull()).select("seq", F.col("problem").alias("outcome"))
    all_outcomes = outcomes.unionByName(losers).unionByName(bad).unionByName(skipped.select("seq", F.lit("skipped").alias("outcome")))
    return after, add_versions(versions, fresh), all_outcomes


def add_versions(versions: DataFrame, fresh: DataFrame) -> DataFrame:
    """Versions with one more for each row of ``fresh`` (memory_id, change_reason, body): the next number, 1 for the first."""
    latest = versions.groupBy("memory_id").agg(F.max("version").alias("_v"))
    new = fresh.join(latest, "memory_id", "left").select("memory_id", (F.coalesce("_v", F.lit(0)) + 1).cast(versions.schema["version"].dataType).alias("version"), "change_reason", "body")
    return versions.unionByName(new, allowMissingColumns=True)


def edit(memories: DataFrame, namespace: str, name: str, now: int, expected_updated_at: int | None = None, **changes: object) -> DataFrame:
    """One live memory changed; nothing happens if it was updated since ``expected_updated_at``."""
    hit = (F.col("namespace") == namespace) & (F.col("name") == name) & F.col("deleted_at").isNull()
    if expected_updated_at is not None:
        hit = hit & (F.col("updated_at") == expected_updated_at)
    new = dict(changes) | {"updated_at": now}
    out = memories.withColumns({c: F.when(hit, F.lit(x).cast(memories.schema[c].dataType)).otherwise(F.col(c)) for c, x in new.items()})
    return out.withColumn("body_hash", F.when(hit, T.body_hash(F.col("body"))).otherwise(F.col("body_hash"))) if "body" in changes else out


def rename(memories: DataFrame, namespace: str, old: str, new: str, now: int) -> DataFrame:
    """A memory under a new name; a deleted one under that name is dropped, a live one keeps the old name in place."""
    slug = new.lower().replace("_", "-").replace(" ", "-").strip("-")
    here = F.col("namespace") == namespace
    taken = memories.where(here & (F.col("name") == slug) & F.col("deleted_at").isNull()).agg(F.count(F.lit(1)).alias("_taken")).scalar()
    rows = memories.withColumn("_taken", taken)
    hit = here & (F.col("name") == old) & F.col("deleted_at").isNull() & (F.col("_taken") == 0)
    rows = rows.where(~(here & (F.col("name") == slug) & F.col("deleted_at").isNotNull() & (F.lit(slug) != F.lit(old))))
    return rows.withColumn("updated_at", F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))).withColumn("name", F.when(hit, F.lit(slug)).otherwise(F.col("name"))).drop("_taken")


def edit_versioned(memories: DataFrame, versions: DataFrame, namespace: str, name: str, now: int, expected_updated_at: int | None = None, force: bool = False, **changes: object) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``edit`` with its version: new memories, new versions, and one row ``(outcome, re_embed)``.

    Outcomes: edited, conflict (updated since ``expected_updated_at``) or not_found. The vector has to be made anew
    if the body or the type changed, or if forced.
    """
    here = (F.col("namespace") == namespace) & (F.col("name") == name) & F.col("deleted_at").isNull()
    row = memories.where(here)
    fits = F.lit(True) if expected_updated_at is None else F.coalesce(F.col("updated_at") == expected_updated_at, F.lit(False))
    body = F.lit(changes["body"]) if "body" in changes else F.col("body")
    fresh = row.where(fits).select(F.col("id").alias("memory_id"), F.lit("edit").alias("change_reason"), body.alias("body"))
    differs = F.lit(force)
    for c in ("body", "type"):
        differs = differs | ~F.col(c).eqNullSafe(F.lit(changes[c])) if c in changes else differs
    state = row.agg(F.count(F.lit(1)).alias("_n"), F.count_if(fits).alias("_fit"), F.coalesce(F.bool_or(fits & differs), F.lit(False)).alias("re_embed"))
    outcome = state.select(F.when(F.col("_n") == 0, "not_found").when(F.col("_fit") == 0, "conflict").otherwise("edited").alias("outcome"), "re_embed")
    return edit(memories, namespace, name, now, expected_updated_at, **changes), add_versions(versions, fresh), outcome


def rename_versioned(memories: DataFrame, versions: DataFrame, namespace: str, old: str, new: str, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rename`` with its version: new memories, new versions, and one row ``(outcome)``: renamed, not_found, occupied or bad name."""
    slug = new.lower().replace("_", "-").replace(" ", "-").strip("-")
    here = (F.col("namespace") == namespace) & F.col("deleted_at").isNull()
    state = memories.agg(F.count_if(here & (F.col("name") == old)).alias("_there"), F.count_if(here & (F.col("name") == slug)).alias("_taken"))
    state = state.withColumn("_good", F.coalesce(T.valid_memory_slug(F.lit(slug)), F.lit(False)))
    outcome = F.when(~F.col("_good"), "bad name").when(F.col("_there") == 0, "not_found").when(F.col("_taken") > 0, "occupied").otherwise("renamed")
    done = state.select(outcome.alias("outcome"))
    moved = memories.where(here & (F.col("name") == old)).withColumn("_o", done.scalar()).where("_o = 'renamed'")
    fresh = moved.select(F.col("id").alias("memory_id"), F.lit("rename").alias("change_reason"), "body")
    valid = bool(re.fullmatch(r"[a-z][a-z0-9-]{0,78}[a-z0-9]|[a-z0-9]", slug))
    return rename(memories, namespace, old, new, now) if valid else memories, add_versions(versions, fresh), done


def forget(memories: DataFrame, embeddings: DataFrame, names: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Memories ``names`` (namespace, name) soft-deleted: memories, vectors, and ``(namespace, name, outcome)``."""
    wanted = names.select("namespace", "name").distinct()
    marked = memories.join(wanted.withColumn("_hit", F.lit(True)), ["namespace", "name"], "left")
    after = marked.withColumn("deleted_at", F.when(F.col("_hit") & F.col("deleted_at").isNull(), F.lit(now)).otherwise(F.col("deleted_at"))).select(*memories.columns)
    state = memories.select("namespace", "name", "id", "deleted_at")
    what = F.when(F.col("id").isNull(), "not_found").when(F.col("deleted_at").isNull(), "soft_deleted").otherwise("already_deleted")
    outcome = wanted.join(state, ["namespace", "name"], "left").select("namespace", "name", what.alias("outcome"))
    gone = marked.where("_hit").select(F.col("id").alias("memory_id"))
    return after, embeddings.join(gone, "memory_id", "left_anti"), outcome


def latest_version(versions: DataFrame, without_restores: bool = True) -> DataFrame:
    """``(memory_id, version, body)`` of the latest version that is no restore."""
    rows = versions.where(F.col("change_reason") != "restore") if without_restores else versions
    return rows.groupBy("memory_id").agg(F.max("version").alias("version"), F.max_by("body", "version").alias("body"))


def restore(memories: DataFrame, versions: DataFrame, memory_ids: DataFrame, now: int, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Memories brought back to a version, their latest that is no restore unless one is named, under their present name, with a version that says so.

    Memories without that version stay as they are. Chunks and vectors are made anew from the ids the new versions name.
    """
    source = latest_version(versions) if version is None else versions.where(F.col("version") == version).select("memory_id", "version", "body")
    chosen = source.join(memory_ids.select("memory_id"), "memory_id", "left_semi")
    joined = memories.join(chosen.select(F.col("memory_id").alias("id"), F.col("body").alias("_body"), F.lit(True).alias("_hit")), "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    columns = {"body": F.when(hit, F.col("_body")).otherwise(F.col("body")), "deleted_at": F.when(hit, F.lit(None).cast("bigint")).otherwise(F.col("deleted_at")), "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at")), "body_hash": F.when(hit, T.body_hash(F.col("_body"))).otherwise(F.col("body_hash"))}
    after = joined.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in memories.columns))
    return after, add_versions(versions, chosen.select("memory_id", F.lit("restore").alias("change_reason"), "body"))


def history(versions: DataFrame) -> DataFrame:
    """``(memory_id, version, action, bytes_added, bytes_removed)``: what each version added to or took from the one before."""
    size = F.coalesce(F.octet_length("body"), F.lit(0))
    before = F.coalesce(F.lag(size).over(Window.partitionBy("memory_id").orderBy("version")), F.lit(0))
    return versions.select("memory_id", "version", T.change_action(F.col("change_reason")).alias("action"), F.greatest(size - before, F.lit(0)).alias("bytes_added"), F.greatest(before - size, F.lit(0)).alias("bytes_removed"))


def purge(memories: DataFrame, children: dict[str, DataFrame], now: int, days: int = v.PURGE_DAYS, namespace: str | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Memories deleted so many days ago dropped for good, with their rows in the child tables (by memory_id)."""
    old = F.col("deleted_at").isNotNull() & (F.col("deleted_at") <= now - days * 86_400)
    old = old & (F.col("namespace") == namespace) if namespace else old
    gone = memories.where(old).select(F.col("id").alias("memory_id"))
    return memories.where(~old), {name: df.join(gone, "memory_id", "left_anti") for name, df in children.items()}


def upsert_entities(entities: DataFrame, incoming: DataFrame, now: int) -> DataFrame:
    """Entities by (namespace, normal name): the type is overwritten unless null, the description kept if none comes.

    ``incoming``: (seq, namespace, name, type, description); a row with a null type, as an edge's end has, creates
    a concept but changes no type.
    """
    normal = incoming.withColumn("name", T.normalize_entity_name(F.col("name"))).where(F.length("name") >= 2)
    one = last_of(normal.select("namespace", "name", "seq", "type", "description"), ["namespace", "name"], "seq")
    new = one.select("namespace", "name", F.col("type").alias("_type"), F.col("description").alias("_description"), F.lit(True).alias("_in"))
    both = entities.join(new, ["namespace", "name"], "full_outer")
    old = both.where(F.col("id").isNotNull())
    state = old.unionByName(numbered(both.where(F.col("id").isNull()).drop("id"), entities, ["namespace", "name"]), allowMissingColumns=True)
    fresh, comes = F.col("created_at").isNull() & F.col("_in"), F.coalesce("_in", F.lit(False))
    columns = {
        "type": F.coalesce("_type", "type", F.when(fresh, F.lit("concept"))),
        "description": F.coalesce("_description", "description"),
        "degree": F.coalesce("degree", F.when(fresh, F.lit(0))),
        "aliases": F.coalesce("aliases", F.when(fresh, F.lit("[]"))),
        "metadata": F.coalesce("metadata", F.when(fresh, F.lit("{}"))),
        "created_at": F.coalesce("created_at", F.when(fresh, F.lit(now))),
        "updated_at": F.when(comes, F.lit(now)).otherwise(F.col("updated_at")),
    }
    return state.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in entities.columns))


def upsert_edges(relationships: DataFrame, incoming: DataFrame, now: int) -> DataFrame:
    """Edges by (source, target, relation): weight overwritten, description kept if none comes.

    ``incoming``: (seq, namespace, source_id, target_id, relation, weight, description). Self-loops, weights
    outside 0 to 1 and ill-formed relations are left out.
    """
    relation = T.normalize_relation(F.col("relation"))
    good = incoming.withColumn("relation", relation).where((F.col("source_id") != F.col("target_id")) & F.coalesce("weight", F.lit(0.5)).between(0, 1) & T.valid_relation(F.col("relation")))
    key = ["source_id", "target_id", "relation"]
    one = last_of(good.select(*key, "seq", "namespace", "weight", "description"), key, "seq")
    new = one.select(*key, F.col("namespace").alias("_namespace"), F.coalesce("weight", F.lit(0.5)).alias("_weight"), F.col("description").alias("_description"), F.lit(True).alias("_in"))
    both = relationships.join(new, key, "full_outer")
    state = both.where(F.col("id").isNotNull()).unionByName(numbered(both.where(F.col("id").isNull()).drop("id"), relationships, key), allowMissingColumns=True)
    comes = F.coalesce("_in", F.lit(False))
    columns = {
        "namespace": F.coalesce("namespace", "_namespace"),
        "weight": F.coalesce("_weight", "weight"),
        "description": F.coalesce("_description", "description"),
        "metadata": F.coalesce("metadata", F.when(comes, F.lit("{}"))),
        "created_at": F.coalesce("created_at", F.when(comes, F.lit(now))),
        "updated_at": F.when(comes & ~F.coalesce(F.col("_weight") == F.col("weight"), F.lit(False)), F.lit(now)).otherwise(F.col("updated_at")),
    }
    return state.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in relationships.columns))


def link(entities: DataFrame, relationships: DataFrame, incoming: DataFrame, now: int, create_missing: bool = False, strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges between entities by their names: new entities, new edges, and ``(seq, outcome)``.

    ``incoming``: (seq, namespace, source, target, relation, weight). A name stands for the entity of its normal
    form, of several the least id. Outcomes: created, updated (another weight), exists, superseded (a later row of
    the batch names the same edge), missing entity (unless created as a concept), self link, bad weight, bad
    relation (of an ill form or, if strict, outside the vocabulary).
    """
    rows = incoming.select("seq", "namespace", T.normalize_entity_name(F.col("source")).alias("_s"), T.normalize_entity_name(F.col("target")).alias("_t"), T.normalize_relation(F.col("relation")).alias("relation"), F.coalesce("weight", F.lit(0.5)).alias("weight"))
    shaped = F.col("relation").isin(*v.RELATIONS) if strict else T.valid_relation(F.col("relation"))
    problem = F.when(F.col("_s") == F.col("_t"), "self link").when(~F.col("weight").between(0, 1), "bad weight").when(~F.coalesce(shaped, F.lit(False)), "bad relation")
    checked = rows.withColumn("problem", problem)
    good = checked.where(F.col("problem").isNull())
    if create_missing:
        ends = good.select("seq", "namespace", F.explode(F.array("_s", "_t")).alias("name"))
        have = entities.select("namespace", T.normalize_entity_name(F.col("name")).alias("name"))
        entities = upsert_entities(entities, ends.join(have, ["namespace", "name"], "left_anti").select("seq", "namespace", "name", F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("description")), now)
    ids = entities.groupBy("namespace", T.normalize_entity_name(F.col("name")).alias("_n")).agg(F.min("id").alias("_id"))
    end = lambda name, id_: ids.select("namespace", F.col("_n").alias(name), F.col("_id").alias(id_))
    placed = good.join(end("_s", "source_id"), ["namespace", "_s"], "left").join(end("_t", "target_id"), ["namespace", "_t"], "left")
    there = placed.where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    key = ["source_id", "target_id", "relation"]
    last = there.groupBy(*key).agg(F.max("seq").alias("_last"))
    old = relationships.groupBy(*key).agg(F.max_by(F.struct("weight"), "id").alias("_old"))
    found = there.join(last, key).join(old, key, "left")
    outcome = F.when(F.col("seq") < F.col("_last"), "superseded").when(F.col("_old").isNull(), "created").when(F.col("_old.weight") == F.col("weight"), "exists").otherwise("updated")
    outcomes = found.select("seq", outcome.alias("outcome"))
    missing = placed.where(F.col("source_id").isNull() | F.col("target_id").isNull()).select("seq", F.lit("missing entity").alias("outcome"))
    bad = checked.where(F.col("problem").isNotNull()).select("seq", F.col("problem").alias("outcome"))
    edges = upsert_edges(relationships, there.select("seq", "namespace", *key, "weight", F.lit(None).cast("string").alias("description")), now)
    return entities, edges, outcomes.unionByName(missing).unionByName(bad)


def persist_urls(urls: DataFrame, found: DataFrame, now: int) -> DataFrame:
    """Addresses with those of ``found`` (memory_id, url, url_offset) that aren't there for their memory yet; the others stay as they are."""
    fresh = found.groupBy("memory_id", "url").agg(F.min("url_offset").alias("url_offset")).join(urls.select("memory_id", "url"), ["memory_id", "url"], "left_anti")
    new = numbered(fresh, urls, ["memory_id", "url_offset", "url"]).withColumn("created_at", F.lit(now).cast("bigint"))
    return urls.unionByName(new.select(*urls.columns))


def unlink(relationships: DataFrame, source_id: int | None = None, target_id: int | None = None, relation: str | None = None, entity_id: int | None = None) -> DataFrame:
    """Edges without one relation of a pair, all of a pair, or all of an entity."""
    if entity_id is not None:
        hit = (F.col("source_id") == entity_id) | (F.col("target_id") == entity_id)
    else:
        hit = (F.col("source_id") == source_id) & (F.col("target_id") == target_id)
        hit = hit & (F.col("relation") == relation) if relation else hit
    return relationships.where(~F.coalesce(hit, F.lit(False)))


def unbind(bindings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Bindings without some pairs (memory_id, entity_id)."""
    return bindings.join(pairs.select("memory_id", "entity_id"), ["memory_id", "entity_id"], "left_anti")


def stage_transition(staged: DataFrame, ids: DataFrame, to: Column | str, allowed: Sequence[str], now: int, key: str = "pending_id") -> DataFrame:
    """Staged rows of some ids moved to another status, if they are in one of the allowed; attempts are counted."""
    marked = staged.join(ids.select(key, F.lit(True).alias("_hit")), key, "left")
    hit = F.coalesce("_hit", F.lit(False)) & F.col("status").isin(list(allowed))
    columns = {"status": F.when(hit, F.lit(to) if isinstance(to, str) else to).otherwise(F.col("status")), "attempt_count": F.col("attempt_count") + F.when(hit, 1).otherwise(0), "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))}
    return marked.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in staged.columns))


def list_backlog(staged: DataFrame, statuses: Sequence[str] = ("pending", "validated", "embedding_in_progress", "failed"), limit: int | None = None) -> DataFrame:
    """Staged rows still to be done, the oldest first."""
    rows = staged.where(F.col("status").isin(list(statuses))).orderBy("updated_at", "pending_id")
    return rows.limit(limit) if limit is not None else rows


def abandon(staged: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Staged rows of some ids given up, unless committed."""
    return stage_transition(staged, ids, "abandoned", ("pending", "validated", "embedding_in_progress", "failed"), now)


def retry(staged: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Failed or abandoned rows of some ids to be tried again."""
    return stage_transition(staged, ids, "pending", ("failed", "abandoned"), now)


def clean_staged(staged: DataFrame, older_than: int, statuses: Sequence[str] = ("committed", "abandoned", "failed")) -> DataFrame:
    """Staged rows without the finished ones last touched before a time."""
    return staged.where(~(F.col("status").isin(list(statuses)) & (F.col("updated_at") < older_than)))
