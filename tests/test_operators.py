"""Operators on small tables with nulls, ties, repeated and empty rows."""

import math

import pytest
from pyspark.sql import functions as F

from lorespark.operators import curate, enrich, fts, fusion, graph, mutate, references, report, vector
from lorespark.plans import research, retrieve
from lorespark.sources import files, snapshot

MEM = "id bigint, namespace string, name string, type string, description string, body string, body_hash string, session_id string, source string, metadata string, deleted_at bigint, created_at bigint, updated_at bigint"
ENT = "id bigint, namespace string, name string, type string, description string, aliases string, degree bigint, metadata string, created_at bigint, updated_at bigint"
REL = "id bigint, namespace string, source_id bigint, target_id bigint, relation string, weight double, description string, metadata string, created_at bigint, updated_at bigint"
BIND = "memory_id bigint, entity_id bigint, created_at bigint"


def memory(i, name, body, deleted=None, ns="global", type_="note", description="d"):
    return (i, ns, name, type_, description, body, None, None, "agent", "{}", deleted, 1, 1)


def entity(i, name, type_="tool", ns="global"):
    return (i, ns, name, type_, None, "[]", 0, "{}", 1, 1)


def edge(i, s, t, relation="uses", weight=0.9):
    return (i, "global", s, t, relation, weight, None, "{}", 1, 1)


def test_bm25_golden_values(spark):
    """Values printed by a stock full-text engine over the same three rows."""
    docs = [memory(1, "auth-design", "the auth design uses jwt", description="jwt tokens"), memory(2, "x", "naïve cafe", description="café auth"), memory(3, "y", "authentication and authorization auth", description="zzz")]
    m = spark.createDataFrame(docs, MEM)
    got = lambda q: {r["id"]: r["score"] for r in fts.search(m, q).collect()}
    assert got("auth") == pytest.approx({3: -1.606e-06, 1: -1.252e-06, 2: -1.114e-06}, abs=5e-10)
    assert got("auth jwt") == pytest.approx({1: -0.639441577}, abs=1e-8)
    assert got("auth-design") == pytest.approx({1: -1.278881903, 3: -1.606e-06, 2: -1.114e-06}, abs=1e-8)
    assert got("cafe") == pytest.approx({2: -0.755506805}, abs=1e-8)
    assert got("") == {}


def test_cosine_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [2.0, 0.0])], "id int, v array<float>")
    got = {r[0]: r[1] for r in df.select("id", vector.cosine(F.col("v"), [1.0, 0.0])).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 1.0}
    round_trip = df.where("v is not null").select("v", vector.decode_vector(vector.encode_vector(F.col("v"))).alias("w")).collect()
    assert all(r["v"] == r["w"] for r in round_trip)


def test_hashing_embedder(spark):
    v = spark.createDataFrame([("Recall path",), ("path recall",), (None,)], "t string").select(vector.hashing_embedder(F.col("t"))).collect()
    assert v[0][0] == v[1][0] and sum(x * x for x in v[0][0]) == pytest.approx(1.0) and set(v[2][0]) == {0.0}


def test_rrf(spark, as_rows):
    a, b = (spark.createDataFrame([(x, k + 1) for k, x in enumerate(ids)], "id bigint, rank int") for ids in ([5, 1, 3], [2, 4, 1]))
    got = {r["id"]: r["score"] for r in fusion.rrf([(a, 1.0), (b, 1.0)]).collect()}
    assert got[1] == pytest.approx(1 / 62 + 1 / 63) and max(got.values()) <= fusion.rrf_most([1, 1])
    swapped = {r["id"]: r["score"] for r in fusion.rrf([(b, 1.0), (a, 1.0)]).collect()}
    assert swapped == pytest.approx(got)


@pytest.fixture(scope="module")
def small(spark):
    e = spark.createDataFrame([entity(i, f"e{i}") for i in range(1, 7)], ENT)
    r = spark.createDataFrame([edge(1, 1, 2), edge(2, 2, 3, weight=0.5), edge(3, 3, 1), edge(4, 1, 4, weight=0.1), edge(5, 1, 2, "causes", 0.4), edge(6, 5, 5), edge(7, None, 2), edge(8, 2, None), edge(9, 4, 1, weight=None)], REL)
    b = spark.createDataFrame([(10, 1, 1), (20, 2, 1), (30, 3, 1), (40, 4, 1), (50, None, 1)], BIND)
    m = spark.createDataFrame([memory(10, "m10", "a"), memory(20, "m20", "b"), memory(30, "m30", "c", deleted=5), memory(40, "m40", None)], MEM)
    return m, e, r, b


def test_bfs(spark, small, as_rows):
    m, e, r, b = small
    seeds = spark.createDataFrame([(1,), (1,), (None,)], "entity_id bigint")
    found = graph.bfs(graph.steps(r), seeds, 3)
    assert as_rows(found, "entity_id", "hop") == [(1, 0), (2, 1), (3, 2)]
    two = found.where("entity_id = 3").first()
    assert [(p["from_id"], p["to_id"]) for p in two["path"]] == [(1, 2), (2, 3)] and two["path_weight"] == pytest.approx(0.45)
    assert as_rows(graph.bfs(graph.steps(r, min_weight=0.05), seeds, 1), "entity_id") == [(1,), (2,), (4,)]
    assert as_rows(graph.bfs(graph.steps(r, min_weight=0.05), seeds, 1, cap=1), "entity_id") == [(1,), (2,)]
    assert as_rows(graph.bfs(graph.steps(r, direction="in"), seeds, 1), "entity_id") == [(1,), (3,)]
    assert as_rows(graph.bfs(graph.steps(r.where("false")), seeds, 3), "entity_id") == [(1,)]
    assert graph.bfs(graph.steps(r), seeds.where("false"), 2).count() == 0
    reached = graph.traverse_from_memories(m, b, r, spark.createDataFrame([(10,)], "memory_id bigint"), None)
    assert as_rows(reached) == [(20, 1)]  # 30 is deleted


def test_degrees(spark, small, as_rows):
    m, e, r, b = small
    assert dict(as_rows(graph.degrees(e, r), "id", "live_degree")) == {1: 5, 2: 5, 3: 2, 4: 2, 5: 1, 6: 0}
    assert as_rows(graph.orphan_entities(e, r, b), "id") == [(6,)]


def test_merge(spark, small, as_rows):
    m, e, r, b = small
    g = curate.merge_entities(curate.Graph(e, r, b), spark.createDataFrame([(2, 1), (4, 4)], "from_id bigint, to_id bigint"))
    assert as_rows(g.entities, "id") == [(1,), (3,), (4,), (5,), (6,)]
    kept = as_rows(g.relationships, "id", "source_id", "target_id")
    assert (2, 1, 3) in kept and not [k for k in kept if k[0] in (1, 5)]  # loops of the merge are gone
    assert (6, 5, 5) in kept  # a loop nobody touched stays
    assert len({(k[1], k[2]) for k in kept}) == len(kept)
    assert as_rows(g.bindings, "memory_id", "entity_id")[:2] == [(10, 1), (20, 1)]


def test_normalize(spark, as_rows):
    e = spark.createDataFrame([entity(1, "Big Table"), entity(2, "big-table"), entity(3, "BIG_TABLE"), entity(4, "!!"), entity(5, "Big Table", ns="other")], ENT)
    empty_r, empty_b = spark.createDataFrame([], REL), spark.createDataFrame([], BIND)
    g = curate.normalize_entities(curate.Graph(e, empty_r, empty_b))
    assert as_rows(g.entities, "id", "name") == [(2, "big-table"), (4, "!!"), (5, "big-table")]


def test_remember(spark, as_rows):
    m = spark.createDataFrame([memory(1, "a", "old"), memory(2, "b", "gone", deleted=7), memory(3, "c", "same")], MEM)
    v = spark.createDataFrame([(1, 1, "create", "old")], "memory_id bigint, version bigint, change_reason string, body string")
    inc = spark.createDataFrame(
        [(1, "global", "a", "note", None, "new", "agent", "{}"), (2, "global", "B", "note", "d", "", "agent", "{}"), (3, "global", "c", "note", "d", "same", "agent", "{}"), (4, "global", "fresh", "note", "d", "x", "agent", "{}"), (5, "global", "fresh", "note", "d", "y", "agent", "{}"), (6, "global", "Ä!", "note", "d", "y", "agent", "{}"), (7, "global", "t", "poem", "d", "y", "agent", "{}"), (8, "global", None, "note", "d", "y", "agent", "{}")],
        "seq bigint, namespace string, name string, type string, description string, body string, source string, metadata string",
    )
    after, versions, outcome = mutate.remember(m, v, inc, 99)
    assert dict(as_rows(outcome)) == {1: "merged", 2: "merged", 3: "unchanged", 4: "superseded", 5: "created", 6: "bad name", 7: "bad type", 8: "empty name"}
    state = {r["name"]: r for r in after.collect()}
    assert state["a"]["body"] == "new" and state["a"]["description"] == "d" and state["b"]["deleted_at"] is None and state["b"]["body"] == "gone"
    assert state["fresh"]["body"] == "y" and state["fresh"]["id"] == 4 and state["c"]["updated_at"] == 1
    assert (1, 2, "edit") in as_rows(versions, "memory_id", "version", "change_reason")
    refused = dict(as_rows(mutate.remember(m, v, inc, 99, merge=False)[2]))
    assert refused[1] == "duplicate name" and refused[2] == "name of a deleted memory" and refused[5] == "created"
    skipped = dict(as_rows(mutate.remember(m, v, inc.where("seq = 4").withColumn("body", F.lit("same")), 99, skip_equal_bodies=True)[2]))
    assert skipped == {4: "skipped"}


def test_versions(spark, as_rows):
    v = spark.createDataFrame([(1, 1, "create", "ab"), (1, 2, "edit", "abcé"), (1, 3, "restore", None)], "memory_id bigint, version bigint, change_reason string, body string")
    assert as_rows(mutate.history(v)) == [(1, 1, "created", 2, 0), (1, 2, "edited", 3, 0), (1, 3, "restored", 0, 5)]
    m = spark.createDataFrame([memory(1, "a", "zzz", deleted=3)], MEM)
    after, versions = mutate.restore(m, v, spark.createDataFrame([(1,)], "memory_id bigint"), 50)
    assert as_rows(after, "body", "deleted_at") == [("abcé", None)] and versions.count() == 4


def test_queue(spark, as_rows):
    q = spark.createDataFrame([(1, "k1", "pending", 0, None), (2, "k2", "processing", 1, None), (3, "k3", "processing", 9, None), (4, "k4", "dead", 5, 3)], "id bigint, item_key string, status string, attempt int, next_retry_at bigint")
    failed = spark.createDataFrame([(2, False), (3, False)], "id bigint, permanent boolean")
    assert as_rows(enrich.fail(q, failed, 100), "id", "status", "next_retry_at") == [(1, "pending", None), (2, "pending", 220), (3, "dead", None), (4, "dead", 3)]
    items = spark.createDataFrame([("k4", "op"), ("k9", "op"), ("k9", "op")], "item_key string, operation string")
    assert as_rows(enrich.enqueue(q.withColumn("operation", F.lit("op")).withColumn("created_at", F.lit(1)), items, F.lit(5)), "item_key") == [("k1",), ("k2",), ("k3",), ("k4",), ("k9",)]
    assert as_rows(enrich.requeue_dead(q).where("id = 4"), "status", "attempt") == [("pending", 0)]
    assert enrich.dequeue(q, 100).first()["attempt"] == 1


def test_unconnected_pairs_when_all_heads_are_connected(spark, as_rows):
    e = spark.createDataFrame([entity(i, f"e{i}") for i in range(1, 9)], ENT)
    r = spark.createDataFrame([edge(i * 10 + j, i, j) for i in range(1, 5) for j in range(i + 1, 9)], REL)
    assert as_rows(enrich.unconnected_pairs(e, r, "global", 2), "a", "b") == [(5, 6), (5, 7)]


def test_persist_bindings(spark, as_rows):
    m, e = spark.createDataFrame([memory(1, "a", "x")], MEM), spark.createDataFrame([entity(7, "old-tool")], ENT)
    r, b = spark.createDataFrame([], REL), spark.createDataFrame([(1, 7, 1)], BIND)
    found = spark.createDataFrame([(1, 1, "global", "Old Tool", "bug"), (2, 1, "global", "New One", "nonsense"), (3, 9, "global", "Third", "person")], "seq bigint, memory_id bigint, namespace string, name string, type string")
    edges = spark.createDataFrame([(1, "global", "Old Tool", "New One", "implements", 0.5), (2, "global", "Old Tool", "Nobody", "uses", 0.5)], "seq bigint, namespace string, source string, target string, relation string, weight double")
    ents, rels, binds = enrich.persist_bindings(m, e, r, b, found, edges, 9)
    assert as_rows(ents, "name", "type") == [("new-one", "concept"), ("old-tool", "incident"), ("third", "person")]
    assert as_rows(rels, "source_id", "relation") == [(7, "supports")] and binds.count() == 2


def test_references(spark, as_rows):
    m = spark.createDataFrame([(1, None, 5), (1, None, 5), (2, 9, 5), (3, None, 50)], "id bigint, deleted_at bigint, created_at bigint")
    e = spark.createDataFrame([(10, 5), (11, None)], "id bigint, created_at bigint")
    r = spark.createDataFrame([(100, 10, 12, 20), (100, 10, 12, 20), (101, 10, None, 20), (102, 11, 10, 1)], "id bigint, source_id bigint, target_id bigint, created_at bigint")
    b = spark.createDataFrame([(1, 10, 20), (2, 10, 20), (3, 10, 20), (3, 10, 60), (4, 10, 20), (9, None, 20), (None, 10, 20)], "memory_id bigint, entity_id bigint, created_at bigint")
    refs, state = references.load_references(m, e, r, b)
    got = as_rows(references.with_period(references.orphan_references(refs, state)), "ref_field", "from_id", "to_id")
    assert got == [("memory_entities.memory_id", 10, 2), ("memory_entities.memory_id", 10, 3), ("memory_entities.memory_id", 10, 4), ("relationships.target_id", 100, 12), ("relationships.target_id", 102, 10)]
    # the missing record arrives, the referring row of another goes
    later = references.existence_deltas(spark.createDataFrame([(4, 2, None)], "id bigint, created_at bigint, deleted_at bigint"), "memories", "id", "created_at", "deleted_at").unionByName(references.reference_deltas(spark.createDataFrame([(12, 20)], "k bigint, at bigint"), "entities", "k", "at", -1))
    keys = references.orphan_keys(references.apply_deltas(state, later)).select("refers_to", "key")
    assert as_rows(keys) == [("entities", 10), ("memories", 2), ("memories", 3)]
    empty = references.load_references(m.where("false"), e.where("false"), r.where("false"), b.where("false"))
    assert references.orphan_references(*empty).count() == 0


def test_reports_of_nothing(spark, small, as_rows):
    m, e, r, b = (x.where("false") for x in small)
    assert report.overview(m, e, r).first()["memories"] == 0
    assert report.relation_ratios(r).first()["mentions_ratio"] is None
    assert report.graph_stats(e, r).first()["avg_degree"] == 0
    assert report.queue_state(spark.createDataFrame([], "status string, next_retry_at bigint"), m, 1).first()[0] == "empty"


def test_recall_gate_and_seed_mixing(spark, small):
    m, e, r, b = small
    v = spark.createDataFrame([(10, "global", [1.0, 0.0]), (20, "global", [0.0, 1.0])], "memory_id bigint, namespace string, embedding array<float>")
    ev = spark.createDataFrame([(1, "global", [1.0, 0.0])], "entity_id bigint, namespace string, embedding array<float>")
    near = retrieve.recall(m, b, r, v, ev, [1.0, 0.0], 1)
    assert {(x["id"], x["source"]) for x in near.collect()} == {(10, "direct"), (20, "graph")}
    assert retrieve.recall(m, b, r, v, ev, [-1.0, 0.0], 1, max_distance=0.5).count() == 0
    assert retrieve.recall(m, b, r, v, ev, [1.0, 0.0], 1, compat_seed_mixing=True).count() == 2


def test_research(spark, small):
    m, e, r, b = small
    v = spark.createDataFrame([(10, [1.0, 0.0]), (20, [0.0, 1.0])], "memory_id bigint, embedding array<float>")
    results, chains = research.research(m, b, r, v, {0: [1.0, 0.0], 1: [0.0, 1.0]}, {0: "m10", 1: ""})
    got = {x["memory_id"]: x for x in results.collect()}
    assert got[10]["score"] == pytest.approx(1.0) and got[10]["source"] == "hybrid" and set(got[10]["query_ids"]) == {0, 1}
    assert all(c["depth"] == len(c["path"]) + 1 and math.isclose(c["total_weight"], math.prod(p["weight"] for p in c["path"])) for c in chains.collect())


def test_sources(spark, tmp_path, as_rows):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("one\ntwo")
    (tmp_path / "in" / "sub" / "b.md").write_text("three")
    (tmp_path / "in" / "c.txt").write_text("no")
    root = f"file://{tmp_path}/in"
    assert as_rows(files.directory(spark, root), "body") == [("one\ntwo",)]
    assert as_rows(files.directory(spark, root, recursive=True), "body") == [("one\ntwo",), ("three",)]
    (tmp_path / "x.ndjson").write_text('{"name":"a","body":"b","entities":[{"name":"E","type":"tool"}]}\nnot json\n\n{"body":"no name"}\n')
    good, bad = files.ndjson(spark, f"file://{tmp_path}/x.ndjson")
    assert as_rows(good, "name", "body") == [("a", "b")] and bad.count() == 2
    docs = spark.createDataFrame([(1, '{"entities":[{"name":"A","entity_type":"tool"}],"relationships":[{"from":"A","to":"B","type":"uses","weight":0.5}]}'), (2, "{"), (3, None)], "id int, j string")
    ents, edges = files.graph_documents(docs, "id", "j")
    assert as_rows(ents, "name", "type") == [("A", "tool")] and as_rows(edges) == [(1, "A", "B", "uses", 0.5)]


def test_snapshots(spark, tmp_path, as_rows):
    root = f"file://{tmp_path}/store"
    assert snapshot.current(spark, root) is None
    snapshot.commit(spark, root, {"t": spark.range(3)})
    old = snapshot.load(spark, root, "t")
    snapshot.commit(spark, root, {"t": old.where("id > 0")})
    assert as_rows(snapshot.load(spark, root, "t")) == [(1,), (2,)]


def test_streams(spark, tmp_path):
    from lorespark.streaming import ingest

    schema = "namespace string, body string, ts timestamp"
    spark.sql("SELECT 'g' AS namespace, 'x' AS body, timestamp'2024-01-01 00:10:00' AS ts UNION ALL SELECT 'g', 'x', timestamp'2024-01-01 00:20:00' UNION ALL SELECT 'g', 'y', timestamp'2024-01-01 02:00:00'").write.parquet(f"{tmp_path}/in")
    stream = ingest.incoming(spark, f"{tmp_path}/in", schema)
    seen = []
    ingest.upsert_stream(ingest.new_bodies(stream, "ts"), lambda df, n: seen.extend(r["body"] for r in df.collect()), f"{tmp_path}/cp1").awaitTermination()
    assert sorted(seen) == ["x", "y"]
    counts = ingest.counts_by_window(stream, "ts", "namespace").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert sorted(r["n"] for r in spark.table("windows").collect()) == [1, 2]


def test_staged_rows(spark, as_rows):
    staged = spark.createDataFrame([(1, "validated", 0, 1), (2, "committed", 1, 1), (3, "failed", 2, 90)], "pending_id bigint, status string, attempt_count int, updated_at bigint")
    ids = spark.createDataFrame([(1,), (2,), (9,)], "pending_id bigint")
    after = mutate.stage_transition(staged, ids, "embedding_in_progress", ["validated", "failed"], 50)
    assert as_rows(after, "pending_id", "status", "attempt_count", "updated_at") == [(1, "embedding_in_progress", 1, 50), (2, "committed", 1, 1), (3, "failed", 2, 90)]
    assert as_rows(mutate.clean_staged(staged, 80), "pending_id") == [(1,), (3,)]


def test_filters_reach_the_scan_below_the_deduplication(spark, data):
    from lorespark.operators import scan
    from lorespark.sources.store import Store

    s = Store(spark, data)
    plan = scan.live(s.memories, "global", "note").select("id", "description")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "EqualTo(namespace,global)" in pushed or "In(namespace" in pushed
    assert "IsNull(deleted_at)" in pushed and "body" not in plan
