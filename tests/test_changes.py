"""Changes of whole records, and cases of names, queues and pointers that once went wrong."""

import pytest
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.operators import enrich, mutate, references, vector
from lorespark.sources import files, snapshot
from tests.oracle import normal
from tests.test_operators import ENT, MEM, REL, edge, entity, memory


def test_integers_are_compared_exactly():
    assert normal(["n"], [(1_704_067_201,)]) != normal(["n"], [(1_704_067_200,)])
    assert normal(["n"], [(0.1 + 0.2,)]) == normal(["n"], [(0.3,)]) and normal(["n"], [(2.9999999999,)]) == normal(["n"], [(3,)])


def test_unique_names_of_a_frequent_base(spark):
    names = ["a"] * 5000 + ["a-2", "a-3", "a-7", "a-x", "a-0", "b", "b"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    out = {r["id"]: r["unique_name"] for r in T.unique_names(df, "name", "id").collect()}
    assert len(set(out.values())) == len(names) and out[0] == "a" and out[1] == "a-1" and out[2] == "a-4" and out[5] == "a-8" and out[5006] == "b-1"
    assert T.unique_names(df.where("false"), "name", "id").count() == 0


def test_part_descriptions_count_bytes(spark):
    row = spark.createDataFrame([("é" * 400, "d" * 600, None)], "e string, d string, n string").select(*(T.part_description(F.col(c), F.lit(2), F.lit(3)).alias(c) for c in "edn")).first()
    assert len(row["e"].encode()) in (499, 500) and len(row["d"]) == 500 and row["n"] is None and row["e"].endswith("é (part 2/3)")


def test_times_bear_their_zone(spark):
    df = spark.createDataFrame([(0,), (1_704_067_200,), (None,)], "t bigint")
    assert [r[0] for r in df.select(T.iso_time(F.col("t"), "America/Sao_Paulo")).collect()] == ["1969-12-31T21:00:00-03:00", "2023-12-31T21:00:00-03:00", None]
    assert df.select(T.iso_time(F.col("t"))).first()[0] == "1970-01-01T00:00:00+00:00"


def test_equal_bodies_of_one_batch(spark, as_rows):
    m, v = spark.createDataFrame([], MEM), spark.createDataFrame([], "memory_id bigint, version bigint, change_reason string, body string")
    inc = spark.createDataFrame([(1, "g", "a", "note", "d", "x", "agent", "{}"), (2, "g", "b", "note", "d", "x", "agent", "{}"), (3, "h", "c", "note", "d", "x", "agent", "{}"), (4, "g", "e", "note", "d", None, "agent", "{}")], "seq bigint, namespace string, name string, type string, description string, body string, source string, metadata string")
    assert as_rows(mutate.remember(m, v, inc, 9, skip_equal_bodies=True)[2]) == [(1, "created"), (2, "skipped"), (3, "created"), (4, "created")]


def test_queued_items_are_numbered_and_come_in_order(spark, as_rows):
    q = spark.createDataFrame([(7, "k1", "pending", 0, None, "op", 1)], "id bigint, item_key string, status string, attempt int, next_retry_at bigint, operation string, created_at bigint")
    after = enrich.enqueue(q, spark.createDataFrame([("k2", "op"), ("k1", "op"), ("k3", "op")], "item_key string, operation string"), F.lit(5).cast("bigint"))
    assert as_rows(after, "id") == [(7,), (8,), (9,)] and enrich.dequeue(after, 100).first()["item_key"] == "k1"
    failed = enrich.fail(after, spark.createDataFrame([(8, True)], "id bigint, permanent boolean"), 5)
    assert as_rows(failed.where("status = 'dead'"), "id") == [(8,)]
    assert enrich.clear(after, "op").count() == 0
    again = enrich.rescan(enrich.clear(after, "op"), after.select("item_key", "operation"), after.where("id = 9").select("item_key"), F.lit(6).cast("bigint"))
    assert again.count() == 2


def test_too_many_files_are_refused(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.md").write_text(str(k))
    with pytest.raises(ValueError):
        files.directory(spark, f"file://{tmp_path}", most=2)
    assert files.directory(spark, f"file://{tmp_path}", most=3).count() == 3


def test_a_pointer_is_there_at_any_time(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    first = snapshot.commit(spark, root, {"t": spark.range(2)})
    second = snapshot.commit(spark, root, {"t": spark.range(3)})
    assert first != second == snapshot.current(spark, root)
    assert (tmp_path / "store" / "CURRENT-1").exists()  # readers of the old version keep it


def test_edit_and_rename_append_versions(spark, as_rows):
    m = spark.createDataFrame([memory(1, "a", "old"), memory(2, "b", "x"), memory(3, "gone", "y", deleted=5)], MEM)
    v = spark.createDataFrame([(1, 1, "create", "old")], "memory_id bigint, version bigint, change_reason string, body string")
    after, versions, outcome = mutate.edit_versioned(m, v, "global", "a", 9, body="new")
    assert as_rows(outcome) == [("edited", True)] and (1, 2, "edit", "new") in as_rows(versions) and as_rows(after.where("id = 1"), "body") == [("new",)]
    after, versions, outcome = mutate.edit_versioned(m, v, "global", "a", 9, 77, description="z")
    assert as_rows(outcome) == [("conflict", False)] and versions.count() == 1 and as_rows(after.where("id = 1"), "description") == [("d",)]
    assert as_rows(mutate.edit_versioned(m, v, "global", "gone", 9, body="z")[2]) == [("not_found", False)]
    for new, want, n in (("C", "renamed", 2), ("b", "occupied", 1), ("9 !", "bad name", 1), ("gone", "renamed", 2)):
        after, versions, outcome = mutate.rename_versioned(m, v, "global", "a", new, 9)
        assert as_rows(outcome) == [(want,)] and versions.count() == n


def test_links(spark, as_rows):
    e = spark.createDataFrame([entity(1, "Ada B"), entity(2, "ada-b"), entity(3, "tool")], ENT)
    r = spark.createDataFrame([edge(1, 1, 3, "uses", 0.9)], REL)
    rows = [(1, "global", "ada b", "Tool", "uses", 0.9), (2, "global", "Tool", "ada-b", "uses", 0.2), (3, "global", "tool", "Ada_B", "uses", 0.3), (4, "global", "tool", "TOOL", "uses", 0.3), (5, "global", "tool", "new one", "uses", 0.3), (6, "global", "tool", "ada b", "9x", 0.3), (7, "global", "tool", "ada b", "uses", 3.0), (8, "global", None, "ada b", "uses", 0.3), (9, "global", "tool", "ada b", "invented", None)]
    inc = spark.createDataFrame(rows, "seq bigint, namespace string, source string, target string, relation string, weight double")
    ents, edges, out = mutate.link(e, r, inc, 9)
    assert dict(as_rows(out)) == {1: "exists", 2: "superseded", 3: "created", 4: "self link", 5: "missing entity", 6: "bad relation", 7: "bad weight", 8: "missing entity", 9: "created"}
    assert ents.count() == 3 and (3, 1, "uses", 0.3) in as_rows(edges, "source_id", "target_id", "relation", "weight")
    ents, edges, out = mutate.link(e, r, inc, 9, create_missing=True, strict=True)
    got = dict(as_rows(out))
    assert got[5] == "created" and got[9] == "bad relation" and (4, "new-one", "concept") in as_rows(ents, "id", "name", "type")


def test_mean_of_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 0.0]), (1, [0.0, 4.0]), (2, [2.0, 0.0]), (3, [1.0]), (4, None), (None, [1.0, 1.0]), (5, [1.0, 0.0]), (5, [-1.0, 0.0])], "g bigint, embedding array<float>")
    got = {r["g"]: list(r["embedding"]) for r in vector.mean_pool(df, "g", 2).collect()}
    assert got == {1: [pytest.approx(0.6), pytest.approx(0.8)], 2: [2.0, 0.0], 5: [0.0, 0.0]}
    assert vector.mean_pool(df.where("false"), "g", 2).count() == 0


def test_records_made_anew_are_known_by_their_last_creation(spark, as_rows):
    e = lambda at: spark.createDataFrame([(1, at)], "id bigint, created_at bigint")
    d = lambda at, sign=1: references.existence_deltas(e(at), "entities", "id", "created_at", sign=sign)
    ref = references.reference_deltas(spark.createDataFrame([(1, 70)], "k bigint, at bigint"), "entities", "k", "at")
    state = references.apply_deltas(None, d(100).unionByName(ref))
    assert references.orphan_keys(state).count() == 1
    assert references.orphan_keys(references.apply_deltas(state, d(100, -1).unionByName(d(50)))).count() == 0


def test_staged_backlog(spark, as_rows):
    staged = spark.createDataFrame([(1, "failed", 2, 5), (2, "committed", 1, 1), (3, "pending", 0, 2)], "pending_id bigint, status string, attempt_count int, updated_at bigint")
    ids = staged.select("pending_id")
    assert [r["pending_id"] for r in mutate.list_backlog(staged).collect()] == [3, 1]
    assert as_rows(mutate.abandon(staged, ids, 9), "pending_id", "status") == [(1, "abandoned"), (2, "committed"), (3, "abandoned")]
    assert as_rows(mutate.retry(staged, ids, 9), "pending_id", "status") == [(1, "pending"), (2, "committed"), (3, "pending")]
