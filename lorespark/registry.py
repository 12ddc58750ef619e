"""The registered queries of the core and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.functions import chunking
from lorespark.functions import text as T
from lorespark.functions import vocabulary as v
from lorespark.operators import curate, enrich, fts, fusion, graph, mutate, references, report, scan, vector
from lorespark.operators.curate import Graph
from lorespark.plans import research, retrieve
from lorespark.sources import export
from lorespark.sources.store import DIM, Store, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

NS, NOW, K = "global", 1_790_000_000, 10
VEC, TEXT, COMPOUND = 7, "recall path", "merge-step"
ALIASES = "lower(replace(trim(type), '-', '_'))"


def query(sql: str | None = None) -> Callable[[Callable[[Store], DataFrame]], Callable[[Store], DataFrame]]:
    """Register a query over a Store under its function's name."""

    def register(f: Callable[[Store], DataFrame]) -> Callable[[Store], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Store(spark, folder))
        if sql is not None:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return register


# references to records that do not exist

_ORPHANS = """
WITH b AS (SELECT DISTINCT memory_id, entity_id, created_at FROM memory_entities WHERE entity_id IS NOT NULL),
 r AS (SELECT DISTINCT id, source_id, target_id, created_at FROM relationships),
 m AS (SELECT DISTINCT id, deleted_at, created_at FROM memories), e AS (SELECT DISTINCT id, created_at FROM entities),
 refs AS (
  SELECT 'memory_entities.memory_id' AS ref_field, entity_id AS from_id, memory_id AS to_id, b.created_at AS made, m.id IS NULL OR m.deleted_at IS NOT NULL OR m.created_at > b.created_at AS orphan FROM b LEFT JOIN m ON m.id = memory_id
  UNION ALL SELECT 'memory_entities.entity_id', memory_id, entity_id, b.created_at, e.id IS NULL OR e.created_at > b.created_at FROM b LEFT JOIN e ON e.id = entity_id
  UNION ALL SELECT 'relationships.source_id', r.id, source_id, r.created_at, e.id IS NULL OR e.created_at > r.created_at FROM r LEFT JOIN e ON e.id = source_id
  UNION ALL SELECT 'relationships.target_id', r.id, target_id, r.created_at, e.id IS NULL OR e.created_at > r.created_at FROM r LEFT JOIN e ON e.id = target_id),
 found AS (SELECT ref_field, from_id, to_id, strftime(make_timestamp(made * 1000000), '%Y-%m') AS period FROM refs WHERE orphan AND to_id IS NOT NULL)
"""


def _orphans(s: Store) -> DataFrame:
    loaded, state = references.load_references(*(s.raw(t) for t in ("memories", "entities", "relationships", "memory_entities")))
    return references.orphan_references(loaded, state)


@query(_ORPHANS + "SELECT * FROM found")
def p2_found(s: Store) -> DataFrame:
    return references.with_period(_orphans(s))


@query(_ORPHANS + "SELECT ref_field, period, count(*) AS n_references, count(DISTINCT to_id) AS n_keys FROM found GROUP BY ref_field, period")
def p2_report(s: Store) -> DataFrame:
    return references.orphan_report(_orphans(s))


# scans and lookups


def _name(s: Store, id_: int) -> tuple[str, str]:
    """Namespace and name of one memory, as a caller would give them."""
    row = s.memories.where(F.col("id") == id_).select("namespace", "name").first()
    return (row["namespace"], row["name"]) if row else (NS, "none")


@query("SELECT id, name, type, description, substring(body, 1, 200) AS snippet, updated_at, deleted_at IS NOT NULL AS deleted FROM mem WHERE namespace = 'global' AND deleted_at IS NULL ORDER BY updated_at DESC, id LIMIT 50")
def list_memories(s: Store) -> DataFrame:
    return scan.list_memories(s.memories, NS)


@query("SELECT id, name, type, description, substring(body, 1, 200) AS snippet, updated_at, deleted_at IS NOT NULL AS deleted FROM mem WHERE namespace = 'global' AND type = 'note' ORDER BY updated_at DESC, id LIMIT 20 OFFSET 10")
def list_memories_deleted_page(s: Store) -> DataFrame:
    return scan.list_memories(s.memories, NS, "note", True, 20, 10)


@query("SELECT namespace, count(*) AS n FROM mem WHERE deleted_at IS NULL GROUP BY namespace")
def namespaces_active(s: Store) -> DataFrame:
    return report.active_namespaces(s.memories)


@query("SELECT namespace, type, count(*) AS n FROM mem WHERE deleted_at IS NULL GROUP BY ALL")
def count_by_type(s: Store) -> DataFrame:
    return report.count_by_type(s.memories)


@query("SELECT m.id, m.name, coalesce(max(v.version), 1) AS version FROM mem m LEFT JOIN ver v ON v.memory_id = m.id WHERE m.namespace = 'global' AND m.deleted_at IS NULL GROUP BY ALL")
def memories_with_version(s: Store) -> DataFrame:
    return scan.with_version(scan.live(s.memories, NS).select("id", "name"), s.versions)


@query("SELECT m.id, m.namespace, m.name, m.body, max(v.version) AS version FROM mem m LEFT JOIN ver v ON v.memory_id = m.id WHERE m.id = 2 AND m.deleted_at IS NULL GROUP BY ALL")
def read_memory(s: Store) -> DataFrame:
    namespace, name = _name(s, 2)
    return scan.read_memory(s.memories, s.versions, namespace, name).select("id", "namespace", "name", "body", "version")


@query("SELECT id, name, deleted_at IS NOT NULL AS deleted FROM mem WHERE namespace = (SELECT namespace FROM mem WHERE id = 1) AND (name IN (SELECT name FROM mem WHERE id = 1) OR name = 'absent')")
def find_any_state(s: Store) -> DataFrame:
    namespace, name = _name(s, 1)
    return scan.find_any_state(s.memories, namespace, [name, "absent"])


@query("SELECT namespace, sha256(body) AS body_hash, count(*) AS n, min(id) AS first_id FROM mem WHERE deleted_at IS NULL AND body IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def find_duplicates_by_hash(s: Store) -> DataFrame:
    return scan.duplicates_by_hash(s.memories, T.body_hash(F.col("body")))


@query("SELECT id, namespace, name, type, degree FROM ent ORDER BY namespace, degree DESC, id LIMIT 100")
def entities_listing(s: Store) -> DataFrame:
    return scan.list_entities(s.entities.select("id", "namespace", "name", "type", "degree"), None, "degree", True, 100)


@query("SELECT r.id, r.source_id, r.target_id, a.name AS source_name, b.name AS target_name, r.relation, r.weight FROM rel r JOIN ent a ON a.id = r.source_id JOIN ent b ON b.id = r.target_id WHERE r.namespace = 'global' AND a.namespace = 'global' AND b.namespace = 'global'")
def relationships_named(s: Store) -> DataFrame:
    return scan.named_relationships(s.relationships, s.entities, NS).select("id", "source_id", "target_id", "source_name", "target_name", "relation", "weight")


@query("SELECT b.memory_id, m.name AS memory_name, b.entity_id, e.name AS entity_name, e.type AS entity_type FROM bind b JOIN mem m ON m.id = b.memory_id JOIN ent e ON e.id = b.entity_id")
def memory_bindings(s: Store) -> DataFrame:
    return scan.memory_bindings(s.bindings, s.memories, s.entities)


@query("SELECT e.id, e.name, count(*) AS memories FROM bind b JOIN ent e ON e.id = b.entity_id JOIN mem m ON m.id = b.memory_id WHERE m.deleted_at IS NULL GROUP BY ALL")
def entity_bindings(s: Store) -> DataFrame:
    return scan.entity_bindings(s.entities, s.bindings, s.memories)


@query("SELECT DISTINCT b.memory_id, r.id AS relationship_id, r.source_id, r.target_id, r.relation, r.weight FROM bind b JOIN rel r ON r.source_id = b.entity_id OR r.target_id = b.entity_id WHERE b.memory_id IN (1, 2, 3)")
def memory_graph_context(s: Store) -> DataFrame:
    return scan.memory_graph_context(s.relationships, s.bindings, [1, 2, 3])


# vectors

_SIM = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7))"


@query(f"SELECT memory_id, round(1 - {_SIM}, 6) AS distance FROM mvec v JOIN mem m ON m.id = v.memory_id WHERE m.deleted_at IS NULL ORDER BY 1 - {_SIM}, memory_id LIMIT 10")
def knn_memories(s: Store) -> DataFrame:
    return vector.knn_memories(s.memory_vectors, s.memories, s.vector(VEC), K).withColumn("distance", F.round("distance", 6))


@query(f"SELECT memory_id, round(1 - {_SIM}, 6) AS distance FROM mvec v JOIN mem m ON m.id = v.memory_id WHERE m.deleted_at IS NULL AND m.type = 'decision' AND v.namespace IN ('global') ORDER BY 1 - {_SIM}, memory_id LIMIT 10")
def knn_memories_typed(s: Store) -> DataFrame:
    return vector.knn_memories(s.memory_vectors, s.memories, s.vector(VEC), K, [NS], "decision").withColumn("distance", F.round("distance", 6))


@query(f"SELECT entity_id, round({_SIM}, 6) AS similarity FROM evec WHERE namespace = 'global' ORDER BY {_SIM} DESC, entity_id LIMIT 5")
def knn_entities(s: Store) -> DataFrame:
    return vector.knn_entities(s.entity_vectors, s.vector(VEC), NS).withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT chunk_id, memory_id, round({_SIM}, 6) AS similarity FROM cvec ORDER BY {_SIM} DESC, chunk_id LIMIT 10")
def knn_chunks(s: Store) -> DataFrame:
    return vector.knn_chunks(s.chunk_vectors, s.vector(VEC), K).withColumn("similarity", F.round("similarity", 6))


@query("""
WITH q AS (SELECT vec_id AS q, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IN (3, 7, 11)),
 d AS (SELECT q, chunk_id, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), e) AS d FROM cvec, q),
 r AS (SELECT q, chunk_id, d, row_number() OVER (PARTITION BY q ORDER BY d, chunk_id) AS rank FROM d)
SELECT CASE q WHEN 3 THEN 0 WHEN 7 THEN 1 ELSE 2 END AS query_id, chunk_id, round(d, 6) AS distance, rank FROM r WHERE rank <= 20""")
def knn_many_queries(s: Store) -> DataFrame:
    return vector.knn_many(s.chunk_vectors, "chunk_id", s.vectors([3, 7, 11])).withColumn("distance", F.round("distance", 6))


@query("SELECT 'memories' AS \"table\", count(*) AS total, count(v.memory_id) AS with_vector, count(*) - count(v.memory_id) AS missing, CASE WHEN count(*) = 0 THEN 100.0 ELSE count(v.memory_id) * 100.0 / count(*) END AS coverage_pct FROM (SELECT * FROM mem WHERE deleted_at IS NULL) m LEFT JOIN mvec v ON v.memory_id = m.id UNION ALL SELECT 'entities', count(*), count(v.entity_id), count(*) - count(v.entity_id), count(v.entity_id) * 100.0 / count(*) FROM ent e LEFT JOIN evec v ON v.entity_id = e.id")
def embedding_coverage(s: Store) -> DataFrame:
    m = vector.coverage(scan.live(s.memories), s.memory_vectors, "memory_id", DIM, "memories")
    return m.unionByName(vector.coverage(s.entities, s.entity_vectors, "entity_id", DIM, "entities"))


@query("SELECT id, name FROM mem WHERE deleted_at IS NULL AND id NOT IN (SELECT memory_id FROM mvec)")
def embeddings_missing(s: Store) -> DataFrame:
    return vector.missing_embeddings(scan.live(s.memories), s.memory_vectors, "memory_id", DIM).select("id", "name")


@query("SELECT memory_id, namespace FROM mvec WHERE memory_id NOT IN (SELECT id FROM mem WHERE deleted_at IS NULL)")
def vectors_orphaned(s: Store) -> DataFrame:
    return vector.orphan_vectors(s.memory_vectors, s.memories).select("memory_id", "namespace")


@query("SELECT memory_id, namespace FROM mvec WHERE memory_id IN (SELECT id FROM mem WHERE deleted_at IS NULL)")
def vectors_purge_orphans(s: Store) -> DataFrame:
    return vector.purge_orphans(s.memory_vectors, s.memories).select("memory_id", "namespace")


@query("SELECT 'memories' AS \"table\", dim, count(*) AS n FROM mvec GROUP BY dim UNION ALL SELECT 'entities', dim, count(*) FROM evec GROUP BY dim UNION ALL SELECT 'chunks', dim, count(*) FROM cvec GROUP BY dim")
def dim_breakdown(s: Store) -> DataFrame:
    return vector.by_dimension({"memories": s.memory_vectors, "entities": s.entity_vectors, "chunks": s.chunk_vectors})


@query("SELECT count(*) AS total, count(*) FILTER (m.id IS NULL) AS orphaned FROM mvec v LEFT JOIN (SELECT id FROM mem WHERE deleted_at IS NULL) m ON m.id = v.memory_id")
def vector_stats(s: Store) -> DataFrame:
    return vector.vector_stats(s.memory_vectors, s.memories)


@query("""
WITH f AS (SELECT memory_id, unnest(range(1, 65)) AS pos, unnest(embedding) AS x FROM cvec),
 a AS (SELECT memory_id, pos, avg(CAST(x AS DOUBLE)) AS m, count(*) AS n FROM f GROUP BY memory_id, pos),
 n AS (SELECT memory_id, sqrt(sum(m * m)) AS norm, max(n) AS n FROM a GROUP BY memory_id)
SELECT a.memory_id, a.pos - 1 AS pos, round(CASE WHEN n.n > 1 AND norm > 1e-9 THEN m / norm ELSE m END, 6) AS x FROM a JOIN n ON n.memory_id = a.memory_id""")
def mean_pool_chunks(s: Store) -> DataFrame:
    return vector.mean_pool(s.chunk_vectors, "memory_id", DIM).select("memory_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.round("x", 6))


# full text

_TOKENS = """
WITH c AS (SELECT id, 1 AS col, name AS t FROM mem UNION ALL SELECT id, 2, description FROM mem UNION ALL SELECT id, 3, body FROM mem),
 l AS (SELECT id, col, regexp_extract_all(lower(strip_accents(coalesce(t, ''))), '[\\p{L}\\p{N}]+') AS w FROM c),
 d AS (SELECT id, sum(len(w)) AS n FROM l GROUP BY id), g AS (SELECT count(*) AS rows, avg(n) AS mean FROM d),
"""
_BM25 = """
 n AS (SELECT term, count(*) AS n FROM f WHERE f > 0 GROUP BY term),
 i AS (SELECT term, CASE WHEN ln((rows - n + 0.5) / (n + 0.5)) > 0 THEN ln((rows - n + 0.5) / (n + 0.5)) ELSE 1e-6 END AS idf FROM n, g),
 s AS (SELECT f.id, -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d.n / mean))) AS score, count(*) AS hits FROM f JOIN i ON i.term = f.term JOIN d ON d.id = f.id CROSS JOIN g WHERE f > 0 GROUP BY f.id)
"""
_AND = _TOKENS + """
 f AS (SELECT id, term, sum(len(list_filter(w, lambda x: starts_with(x, term)))) AS f FROM l, (SELECT unnest(['recall', 'path']) AS term) GROUP BY id, term),
""" + _BM25
_OR = _TOKENS + """
 f AS (SELECT id, term, sum(len(list_filter(w, lambda x: starts_with(x, term)))) AS f FROM l, (SELECT unnest(['merge', 'step']) AS term) GROUP BY id, term
  UNION ALL SELECT id, 'merge step', sum(len(list_filter(range(1, len(w)), lambda i: w[i] = 'merge' AND w[i + 1] = 'step'))) FROM l GROUP BY id),
""" + _BM25


@query(_AND + "SELECT s.id, round(score, 6) AS score FROM s JOIN mem ON mem.id = s.id WHERE deleted_at IS NULL AND hits = 2")
def fts_and_prefix(s: Store) -> DataFrame:
    return fts.search_many(s.memories, {0: fts.parse(TEXT)}).select("id", F.round("score", 6).alias("score"))


@query(_OR + "SELECT s.id, round(score, 6) AS score FROM s JOIN mem ON mem.id = s.id WHERE deleted_at IS NULL")
def fts_phrase_or(s: Store) -> DataFrame:
    return fts.search_many(s.memories, {0: fts.parse(COMPOUND)}).select("id", F.round("score", 6).alias("score"))


@query(_AND + "SELECT s.id, round(score, 6) AS score, row_number() OVER (ORDER BY score, s.id) AS rank FROM s JOIN mem ON mem.id = s.id WHERE deleted_at IS NULL AND hits = 2 AND type = 'note' QUALIFY rank <= 10")
def bm25_rank(s: Store) -> DataFrame:
    return fusion.ranked(fts.search(s.memories, TEXT, K, None, "note"), "id", "score").withColumn("score", F.round("score", 6))


@query(_TOKENS.rstrip().rstrip(",") + " SELECT term, count(DISTINCT id) AS n_rows, count(*) AS n_occurrences FROM (SELECT id, unnest(w) AS term FROM l) GROUP BY term HAVING regexp_matches(term, '^[a-z0-9]+$')")
def fts_term_stats(s: Store) -> DataFrame:
    return fts.term_stats(s.memories).where(F.col("term").rlike("^[a-z0-9]+$"))


# fusion and retrieval

_LISTS = f"""
{_AND.rstrip()},
 v0 AS (SELECT memory_id AS id, 1 - {_SIM} AS distance FROM mvec JOIN mem ON mem.id = memory_id WHERE deleted_at IS NULL ORDER BY 1 - {_SIM}, memory_id LIMIT 20),
 v AS (SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS rank FROM v0),
 t0 AS (SELECT s.id, score FROM s JOIN mem ON mem.id = s.id WHERE deleted_at IS NULL AND hits = 2 ORDER BY score, s.id LIMIT 20),
 t AS (SELECT id, row_number() OVER (ORDER BY score, id) AS rank FROM t0)
"""


def _ranked_lists(s: Store) -> tuple[DataFrame, DataFrame]:
    near = vector.knn_memories(s.memory_vectors, s.memories, s.vector(VEC), 2 * K).withColumnRenamed("memory_id", "id")
    return fusion.ranked(near, "id", "distance"), fusion.ranked(fts.search(s.memories, TEXT, 2 * K), "id", "score")


@query(_LISTS + "SELECT id, round(sum(1 / (60.0 + rank)), 6) AS score FROM (SELECT id, rank FROM v UNION ALL SELECT id, rank FROM t) GROUP BY id")
def rrf_fuse(s: Store) -> DataFrame:
    near, found = _ranked_lists(s)
    return fusion.rrf([(near, 1.0), (found, 1.0)]).withColumn("score", F.round("score", 6))


_HYBRID = _LISTS.rstrip() + """,
 h AS (SELECT coalesce(v.id, t.id) AS id, coalesce(1 / (60.0 + v.rank), 0) + coalesce(1 / (60.0 + t.rank), 0) AS score, v.rank AS vec_rank, v.distance AS vec_distance, t.rank AS fts_rank FROM v FULL JOIN t ON v.id = t.id ORDER BY score DESC, id LIMIT 10)
"""


@query(_HYBRID + "SELECT h.id, round(score, 6) AS score, round(least(1.0, score / (2 / 61.0)), 6) AS normalized_score, vec_rank, round(vec_distance, 6) AS vec_distance, fts_rank, CASE WHEN vec_rank IS NULL THEN 'fts' WHEN fts_rank IS NULL THEN 'knn' ELSE 'hybrid' END AS source, name, type, substring(body, 1, 300) AS snippet FROM h JOIN mem ON mem.id = h.id")
def hybrid_search(s: Store) -> DataFrame:
    out = retrieve.hybrid_search(s.memories, s.memory_vectors, s.vector(VEC), TEXT, K)
    return out.withColumns({c: F.round(c, 6) for c in ("score", "normalized_score", "vec_distance")})


def bfs_sql(seeds: str, hops: int, edges: str) -> str:
    """Levels of a bounded breadth-first search: the least hop of every entity."""
    levels = f"x0 AS (SELECT DISTINCT id, 0 AS hop FROM ({seeds}))"
    for h in range(1, hops + 1):
        levels += f", x{h} AS (SELECT * FROM x{h - 1} UNION SELECT DISTINCT e.dst, {h} FROM x{h - 1} x JOIN ({edges}) e ON e.src = x.id WHERE x.hop = {h - 1} AND e.dst NOT IN (SELECT id FROM x{h - 1}))"
    return levels


_OUT = "SELECT source_id AS src, target_id AS dst FROM rel WHERE weight >= 0.3 AND source_id IS NOT NULL AND target_id IS NOT NULL"
_BOTH = f"{_OUT} UNION ALL SELECT target_id, source_id FROM rel WHERE weight >= 0.3 AND source_id IS NOT NULL AND target_id IS NOT NULL"
_SEEDS = "SELECT entity_id AS id FROM bind WHERE memory_id IN (2, 3, 5)"


def _seeds(s: Store) -> DataFrame:
    return graph.entities_of(s.bindings, s.memories.where(F.col("id").isin(2, 3, 5)).select(F.col("id").alias("memory_id")))


@query(_HYBRID.rstrip() + ", " + bfs_sql("SELECT entity_id AS id FROM bind WHERE memory_id IN (SELECT id FROM h)", 2, _OUT) + """
SELECT h.id, round(score, 6) AS score, CASE WHEN vec_rank IS NULL THEN 'fts' WHEN fts_rank IS NULL THEN 'knn' ELSE 'hybrid' END AS source, 0 AS hop FROM h
UNION ALL SELECT b.memory_id, round(1 / (min(hop) + 1.0), 6), 'graph', min(hop) FROM bind b JOIN x2 ON x2.id = b.entity_id JOIN mem ON mem.id = b.memory_id WHERE hop > 0 AND deleted_at IS NULL AND b.memory_id NOT IN (SELECT id FROM h) GROUP BY b.memory_id""")
def hybrid_with_graph(s: Store) -> DataFrame:
    out = retrieve.hybrid_with_graph(s.memories, s.bindings, s.relationships, s.memory_vectors, s.vector(VEC), TEXT, K)
    return out.withColumn("score", F.round("score", 6))


@query(f"WITH v0 AS (SELECT memory_id AS id, 1 - {_SIM} AS distance FROM mvec JOIN mem ON mem.id = memory_id WHERE deleted_at IS NULL ORDER BY 1 - {_SIM}, memory_id LIMIT 10), n AS (SELECT entity_id AS id FROM evec ORDER BY {_SIM} DESC, entity_id LIMIT 5), " + bfs_sql("SELECT entity_id AS id FROM bind WHERE memory_id IN (SELECT id FROM v0) UNION SELECT id FROM n", 2, _OUT) + """
SELECT id, round(distance, 6) AS distance, 'direct' AS source, 0 AS hop FROM v0
UNION ALL SELECT b.memory_id, round(1 - 1 / (min(hop) + 1.0), 6), 'graph', min(hop) FROM bind b JOIN x2 ON x2.id = b.entity_id JOIN mem ON mem.id = b.memory_id WHERE hop > 0 AND deleted_at IS NULL AND b.memory_id NOT IN (SELECT id FROM v0) GROUP BY b.memory_id""")
def recall_with_graph(s: Store) -> DataFrame:
    out = retrieve.recall(s.memories, s.bindings, s.relationships, s.memory_vectors, s.entity_vectors, s.vector(VEC), K)
    return out.withColumn("distance", F.round("distance", 6))


@query(_AND + "SELECT s.id, round(1 - 1.0 / row_number() OVER (ORDER BY score, s.id), 6) AS distance FROM s JOIN mem ON mem.id = s.id WHERE deleted_at IS NULL AND hits = 2 QUALIFY row_number() OVER (ORDER BY score, s.id) <= 10")
def recall_fts_fallback(s: Store) -> DataFrame:
    return retrieve.recall_text(s.memories, TEXT, K).withColumn("distance", F.round("distance", 6))


# graph


@query("WITH " + bfs_sql(_SEEDS, 3, _OUT) + " SELECT id AS entity_id, hop FROM x3")
def bfs_hops(s: Store) -> DataFrame:
    return graph.bfs(graph.steps(s.relationships), _seeds(s), 3).select("entity_id", "hop")


_CAP = """
WITH e AS (SELECT source_id AS src, target_id AS dst, weight, id FROM rel WHERE weight >= 0.3 AND source_id IS NOT NULL AND target_id IS NOT NULL),
 c0 AS (SELECT DISTINCT entity_id AS id, 0 AS hop FROM bind WHERE memory_id IN (2, 3, 5))"""
for _h in (1, 2):
    _CAP += f""",
 y{_h} AS (SELECT src, dst, weight, id FROM (SELECT e.*, row_number() OVER (PARTITION BY src, dst ORDER BY weight DESC, e.id) AS n FROM e JOIN c{_h - 1} c ON c.id = e.src AND c.hop = {_h - 1} WHERE dst NOT IN (SELECT id FROM c{_h - 1})) WHERE n = 1),
 c{_h} AS (SELECT * FROM c{_h - 1} UNION SELECT DISTINCT dst, {_h} FROM (SELECT dst, row_number() OVER (PARTITION BY src ORDER BY weight DESC, id) AS n FROM y{_h}) WHERE n <= 3)"""


@query(_CAP + " SELECT id AS entity_id, hop FROM c2")
def bfs_capped(s: Store) -> DataFrame:
    return graph.bfs(graph.steps(s.relationships), _seeds(s), 2, 3).select("entity_id", "hop")


@query("WITH " + bfs_sql(_SEEDS, 1, _OUT) + """, w AS (SELECT target_id AS entity_id, source_id AS parent_id, relation, weight, row_number() OVER (PARTITION BY target_id ORDER BY source_id, weight DESC, rel.id) AS n FROM rel JOIN x1 a ON a.id = source_id AND a.hop = 0 JOIN x1 b ON b.id = target_id AND b.hop = 1 WHERE weight >= 0.3)
SELECT entity_id, parent_id, relation, weight, round(weight, 6) AS path_weight, 1 AS depth FROM w WHERE n = 1""")
def bfs_predecessors(s: Store) -> DataFrame:
    found = graph.bfs(graph.steps(s.relationships), _seeds(s), 1).where("hop > 0")
    return found.select("entity_id", "parent_id", "relation", "weight", F.round("path_weight", 6).alias("path_weight"), F.size("path").alias("depth"))


@query("WITH " + bfs_sql(_SEEDS, 2, _OUT) + " SELECT b.memory_id, min(hop) AS hop FROM bind b JOIN x2 ON x2.id = b.entity_id JOIN mem ON mem.id = b.memory_id WHERE hop > 0 AND deleted_at IS NULL AND b.memory_id NOT IN (2, 3, 5) GROUP BY 1")
def traverse_from_memories(s: Store) -> DataFrame:
    ids = s.memories.where(F.col("id").isin(2, 3, 5)).select(F.col("id").alias("memory_id"))
    return graph.traverse_from_memories(s.memories, s.bindings, s.relationships, ids, None)


def _related_sql(edges: str, limit: int) -> str:
    both = f"SELECT source_id AS src, target_id AS dst, relation, weight, id FROM rel WHERE {edges} UNION ALL SELECT target_id, source_id, relation, weight, id FROM rel WHERE {edges}"
    plain = f"SELECT src, dst FROM ({both})"
    return "WITH " + bfs_sql("SELECT 1016 AS id", 2, plain) + f""", w AS (SELECT e.dst AS id, b.hop, e.relation, e.weight, e.src AS from_id, row_number() OVER (PARTITION BY e.dst ORDER BY e.src, e.weight DESC, e.id) AS n FROM ({both}) e JOIN x2 a ON a.id = e.src JOIN x2 b ON b.id = e.dst AND b.hop = a.hop + 1),
 r AS (SELECT b.memory_id, w.hop, w.relation, w.weight, w.from_id, w.id AS entity_id, row_number() OVER (PARTITION BY b.memory_id ORDER BY w.hop, w.weight DESC, w.id) AS n FROM w JOIN bind b ON b.entity_id = w.id JOIN mem ON mem.id = b.memory_id WHERE w.n = 1 AND deleted_at IS NULL)
SELECT memory_id, hop, relation, weight, from_id, entity_id FROM r WHERE n = 1 ORDER BY hop, weight DESC, memory_id LIMIT {limit}"""


def _one_entity(s: Store) -> DataFrame:
    return s.spark.createDataFrame([(1016,)], "entity_id bigint")


@query(_related_sql("weight >= 0.3 AND source_id IS NOT NULL AND target_id IS NOT NULL", 10))
def related_memories(s: Store) -> DataFrame:
    return graph.related(s.memories, s.bindings, s.relationships, _one_entity(s))


@query(_related_sql("weight >= 0.3 AND relation IN ('uses', 'depends_on') AND source_id IS NOT NULL AND target_id IS NOT NULL", 10))
def related_by_relation(s: Store) -> DataFrame:
    return graph.related(s.memories, s.bindings, s.relationships, _one_entity(s), relations=["uses", "depends_on"])


_ALL = "SELECT source_id AS src, target_id AS dst, id, relation, weight, 'outbound' AS direction FROM rel WHERE source_id IS NOT NULL AND target_id IS NOT NULL UNION ALL SELECT target_id, source_id, id, relation, weight, 'inbound' FROM rel WHERE source_id IS NOT NULL AND target_id IS NOT NULL"


@query("WITH " + bfs_sql("SELECT 1016 AS id", 1, f"SELECT src, dst FROM ({_ALL})") + f" SELECT src AS entity_id, hop + 1 AS hop, e.id AS rel_id, dst AS other_id, relation, weight, direction FROM ({_ALL}) e JOIN x1 ON x1.id = src")
def graph_traverse(s: Store) -> DataFrame:
    return graph.incident_edges(s.relationships, _one_entity(s), 2)


@query("SELECT (SELECT count(*) FROM ent) AS node_count, (SELECT count(*) FROM rel) AS edge_count, (SELECT max(degree) FROM ent) AS max_degree, (SELECT max(d) FROM deg) AS max_live_degree, (SELECT count(*) FROM rel) * 2.0 / (SELECT count(*) FROM ent) AS avg_degree")
def graph_stats(s: Store) -> DataFrame:
    return report.graph_stats(s.entities, s.relationships)


@query("SELECT count(*) AS total, count(*) FILTER (degree IS DISTINCT FROM coalesce(d, 0)) AS updated, count(*) FILTER (degree IS DISTINCT FROM coalesce(d, 0) AND coalesce(d, 0) = 0) AS zeroed, count(*) FILTER (degree IS NOT DISTINCT FROM coalesce(d, 0)) AS unchanged FROM ent LEFT JOIN deg ON deg.id = ent.id")
def degree_recompute(s: Store) -> DataFrame:
    return graph.degree_drift(s.entities, s.relationships)


@query("SELECT ent.id, ent.name, coalesce(d, 0) AS live_degree FROM ent LEFT JOIN deg ON deg.id = ent.id")
def entity_degrees(s: Store) -> DataFrame:
    return graph.degrees(s.entities.select("id", "name"), s.relationships)


@query("SELECT id, namespace, name FROM ent WHERE id NOT IN (SELECT id FROM deg) AND id NOT IN (SELECT entity_id FROM bind)")
def orphan_entities(s: Store) -> DataFrame:
    return graph.orphan_entities(s.entities, s.relationships, s.bindings).select("id", "namespace", "name")


@query("SELECT DISTINCT name FROM ent WHERE id IN (SELECT source_id FROM rel WHERE relation = 'causes' UNION SELECT target_id FROM rel WHERE relation = 'causes')")
def relation_entity_names(s: Store) -> DataFrame:
    return graph.relation_names(s.relationships, s.entities, "causes")


# reports


@query("SELECT (SELECT count(*) FROM mem WHERE deleted_at IS NULL) AS memories, (SELECT coalesce(avg(length(body)), 0) FROM mem WHERE deleted_at IS NULL) AS avg_body_len, (SELECT count(DISTINCT namespace) FROM mem WHERE deleted_at IS NULL) AS namespaces, (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM rel) AS relationships")
def stats_overview(s: Store) -> DataFrame:
    return report.overview(s.memories, s.entities, s.relationships)


@query("SELECT relation, count(*) AS n FROM rel GROUP BY relation")
def relation_counts(s: Store) -> DataFrame:
    return report.relation_counts(s.relationships)


@query("SELECT relation, count(*) AS n, count(*) / (SELECT count(*) FROM rel) AS share, count(*) > 0.4 * (SELECT count(*) FROM rel) AS warn FROM rel WHERE relation IS NOT NULL GROUP BY relation ORDER BY n DESC, relation LIMIT 1")
def relation_concentration(s: Store) -> DataFrame:
    return report.relation_concentration(s.relationships)


@query("SELECT count(*) AS relationships, count(*) FILTER (relation = 'mentions') / count(*) AS mentions_ratio, count(*) FILTER (relation = 'mentions') > 0.5 * count(*) AS mentions_warn, count(*) FILTER (relation = 'applies_to') / count(*) AS applies_to_ratio FROM rel")
def relation_ratios(s: Store) -> DataFrame:
    return report.relation_ratios(s.relationships)


@query("SELECT ent.id, name, d AS degree FROM ent JOIN deg ON deg.id = ent.id WHERE d > 50 ORDER BY d DESC, name, ent.id LIMIT 5")
def super_hubs(s: Store) -> DataFrame:
    return report.hubs(s.entities, s.relationships)


@query("SELECT ent.id, name, d AS degree FROM ent JOIN deg ON deg.id = ent.id ORDER BY d DESC, name, ent.id LIMIT 1")
def top_hub(s: Store) -> DataFrame:
    return report.hubs(s.entities, s.relationships, 0, 1)


_NORMAL = "trim(regexp_replace(lower(regexp_replace(strip_accents(name), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-')"


ORACLE_HEALTH = f"""
SELECT 'live_memories' AS check_name, count(*) AS value FROM mem WHERE deleted_at IS NULL UNION ALL SELECT 'entities', count(*) FROM ent UNION ALL SELECT 'relationships', count(*) FROM rel
UNION ALL SELECT 'memories_without_vector', count(*) FROM mem WHERE deleted_at IS NULL AND id NOT IN (SELECT memory_id FROM mvec)
UNION ALL SELECT 'vectors_without_memory', count(*) FROM mvec WHERE memory_id NOT IN (SELECT id FROM mem WHERE deleted_at IS NULL)
UNION ALL SELECT 'dangling_bindings', count(*) FROM bind WHERE memory_id NOT IN (SELECT id FROM mem) OR entity_id NOT IN (SELECT id FROM ent)
UNION ALL SELECT 'names_not_normal', count(*) FROM ent WHERE name <> {_NORMAL}"""


@query(ORACLE_HEALTH)
def health_checks(s: Store) -> DataFrame:
    return report.health(s.memories, s.entities, s.relationships, s.bindings, s.memory_vectors)


@query("SELECT count(*) AS n, coalesce(sum(coalesce(length(body), 0) + coalesce(length(description), 0) + coalesce(length(name), 0)), 0) AS chars, min(deleted_at) AS oldest FROM mem WHERE deleted_at <= 1790000000 - 90 * 86400")
def purge_metrics(s: Store) -> DataFrame:
    return report.purge_metrics(s.memories, NOW - 90 * 86_400)


# versions and changes


@query("SELECT memory_id, version, CASE change_reason WHEN 'create' THEN 'created' WHEN 'edit' THEN 'edited' ELSE 'restored' END AS action, greatest(n - p, 0) AS bytes_added, greatest(p - n, 0) AS bytes_removed FROM (SELECT *, coalesce(lag(n) OVER (PARTITION BY memory_id ORDER BY version), 0) AS p FROM (SELECT *, coalesce(octet_length(encode(body)), 0) AS n FROM ver))")
def history_diff(s: Store) -> DataFrame:
    return mutate.history(s.versions)


@query("SELECT memory_id, max(version) AS version FROM ver WHERE change_reason <> 'restore' GROUP BY memory_id")
def latest_non_restore_version(s: Store) -> DataFrame:
    return mutate.latest_version(s.versions).select("memory_id", "version")


def _incoming(s: Store) -> DataFrame:
    """Three kinds of rows made of the stored ones: new names, changed bodies, and equal rows."""
    kind = F.col("id") % 3
    m = s.memories.where((F.col("namespace") == NS) & F.col("type").isNotNull() & F.col("name").rlike("^[a-z][a-z0-9-]*[a-z0-9]$") & (F.length("name") <= 60))
    name = F.when(kind == 0, F.concat(F.lit("new-"), F.col("name"))).otherwise(F.col("name"))
    body = F.when(kind == 1, F.concat(F.col("body"), F.lit(" more"))).otherwise(F.col("body"))
    return m.select(F.col("id").alias("seq"), "namespace", name.alias("name"), "type", "description", body.alias("body"), "source", "metadata")


_INCOMING = "inc AS (SELECT id AS seq, CASE WHEN id % 3 = 0 THEN 'new-' || name ELSE name END AS name, id % 3 AS kind, deleted_at, body FROM mem WHERE namespace = 'global' AND type IS NOT NULL AND regexp_matches(name, '^[a-z][a-z0-9-]*[a-z0-9]$') AND length(name) <= 60)"


@query(f"WITH {_INCOMING} SELECT seq, CASE WHEN kind = 0 THEN 'created' WHEN deleted_at IS NOT NULL OR (kind = 1 AND body IS NOT NULL) THEN 'merged' ELSE 'unchanged' END AS outcome FROM inc")
def remember_batch(s: Store) -> DataFrame:
    return mutate.remember(s.memories, s.versions, _incoming(s), NOW)[2]


@query(f"WITH {_INCOMING} SELECT namespace, name, deleted_at, updated_at, sha256(body) AS body_hash FROM (SELECT m.namespace, m.name, CASE WHEN i.seq IS NULL THEN m.deleted_at END AS deleted_at, CASE WHEN i.seq IS NOT NULL AND (m.deleted_at IS NOT NULL OR (i.kind = 1 AND i.body IS NOT NULL)) THEN 1790000000 ELSE m.updated_at END AS updated_at, CASE WHEN i.kind = 1 THEN m.body || ' more' ELSE m.body END AS body FROM mem m LEFT JOIN inc i ON i.seq = m.id AND i.kind <> 0 UNION ALL SELECT 'global', name, NULL, 1790000000, body FROM inc WHERE kind = 0)")
def remember_state(s: Store) -> DataFrame:
    after = mutate.remember(s.memories, s.versions, _incoming(s), NOW)[0]
    return after.select("namespace", "name", "deleted_at", "updated_at", T.body_hash(F.col("body")).alias("body_hash"))


@query("SELECT id, CASE WHEN namespace = 'global' AND deleted_at IS NULL AND id % 2 = 0 THEN 1790000000 ELSE deleted_at END AS deleted_at FROM mem")
def forget(s: Store) -> DataFrame:
    names = s.memories.where((F.col("namespace") == NS) & (F.col("id") % 2 == 0)).select("namespace", "name")
    return mutate.forget(s.memories, s.memory_vectors, names, NOW)[0].select("id", "deleted_at")


@query("SELECT namespace, name, CASE WHEN deleted_at IS NULL THEN 'soft_deleted' ELSE 'already_deleted' END AS outcome FROM mem WHERE namespace = 'global' UNION ALL SELECT 'global', 'no such name', 'not_found'")
def forget_outcomes(s: Store) -> DataFrame:
    names = s.memories.where(F.col("namespace") == NS).select("namespace", "name").union(s.spark.createDataFrame([(NS, "no such name")], "namespace string, name string"))
    return mutate.forget(s.memories, s.memory_vectors, names, NOW)[2]


@query("WITH l AS (SELECT memory_id, max(version) AS v FROM ver WHERE change_reason <> 'restore' GROUP BY 1) SELECT m.id, NULL::BIGINT AS deleted_at, sha256(x.body) AS body_hash FROM mem m JOIN l ON l.memory_id = m.id JOIN ver x ON x.memory_id = m.id AND x.version = l.v WHERE m.deleted_at IS NOT NULL")
def restore(s: Store) -> DataFrame:
    gone = s.memories.where(F.col("deleted_at").isNotNull()).select(F.col("id").alias("memory_id"))
    after, _ = mutate.restore(s.memories, s.versions, gone, NOW)
    return after.join(gone.select(F.col("memory_id").alias("id")), "id", "left_semi").select("id", "deleted_at", T.body_hash(F.col("body")).alias("body_hash"))


@query("SELECT 'memories' AS \"table\", count(*) AS n FROM mem WHERE deleted_at IS NULL OR deleted_at > 1790000000 - 90 * 86400 UNION ALL SELECT 'bindings', count(*) FROM bind WHERE memory_id NOT IN (SELECT id FROM mem WHERE deleted_at <= 1790000000 - 90 * 86400)")
def purge(s: Store) -> DataFrame:
    memories, children = mutate.purge(s.memories, {"bindings": s.bindings}, NOW)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
    return n(memories, "memories").unionByName(n(children["bindings"], "bindings"))


@query("SELECT id, name, type, CASE WHEN id = 3 AND deleted_at IS NULL THEN 'edited' ELSE description END AS description FROM mem")
def edit_memory(s: Store) -> DataFrame:
    return mutate.edit(s.memories, *_name(s, 3), NOW, description="edited").select("id", "name", "type", "description")


@query("SELECT id, CASE WHEN id = 3 AND deleted_at IS NULL THEN 'another-name' ELSE name END AS name FROM mem")
def rename_memory(s: Store) -> DataFrame:
    return mutate.rename(s.memories, *_name(s, 3), "Another_name", NOW).select("id", "name")


@query(f"""
WITH inc AS (SELECT id AS seq, namespace, CASE WHEN id % 2 = 0 THEN name || ' extra' ELSE name END AS name, id FROM ent WHERE namespace = 'global'),
 n AS (SELECT namespace, {_NORMAL} AS name, max(seq) AS seq FROM inc GROUP BY 1, 2 HAVING length({_NORMAL}) >= 2)
SELECT e.namespace, e.name, CASE WHEN n.seq IS NULL THEN e.type ELSE 'project' END AS type FROM ent e LEFT JOIN n ON n.namespace = e.namespace AND n.name = e.name
UNION ALL SELECT n.namespace, n.name, 'project' FROM n LEFT JOIN ent e ON n.namespace = e.namespace AND n.name = e.name WHERE e.id IS NULL""")
def upsert_entities(s: Store) -> DataFrame:
    name = F.when(F.col("id") % 2 == 0, F.concat("name", F.lit(" extra"))).otherwise(F.col("name"))
    inc = s.entities.where(F.col("namespace") == NS).select(F.col("id").alias("seq"), "namespace", name.alias("name"), F.lit("project").alias("type"), F.lit(None).cast("string").alias("description"))
    return mutate.upsert_entities(s.entities, inc, NOW).select("namespace", "name", "type")


@query("""
WITH inc AS (SELECT id AS seq, source_id, target_id, replace(lower(relation), '-', '_') AS relation FROM rel WHERE source_id <> target_id AND regexp_matches(replace(lower(relation), '-', '_'), '^[a-z][a-z0-9_]*$')),
 n AS (SELECT source_id, target_id, relation, max(seq) AS seq FROM inc GROUP BY 1, 2, 3)
SELECT r.source_id, r.target_id, r.relation, CASE WHEN n.seq IS NULL THEN r.weight ELSE 0.25 END AS weight FROM rel r LEFT JOIN n ON n.source_id = r.source_id AND n.target_id = r.target_id AND n.relation = r.relation
UNION ALL SELECT n.source_id, n.target_id, n.relation, 0.25 FROM n LEFT JOIN rel r ON n.source_id = r.source_id AND n.target_id = r.target_id AND n.relation = r.relation WHERE r.id IS NULL""")
def upsert_edges(s: Store) -> DataFrame:
    inc = s.relationships.select(F.col("id").alias("seq"), "namespace", "source_id", "target_id", "relation", F.lit(0.25).alias("weight"), F.lit(None).cast("string").alias("description"))
    return mutate.upsert_edges(s.relationships, inc, NOW).select("source_id", "target_id", "relation", "weight")


@query("SELECT id FROM rel WHERE (source_id <> 1016 OR source_id IS NULL) AND (target_id <> 1016 OR target_id IS NULL)")
def unlink_entity(s: Store) -> DataFrame:
    return mutate.unlink(s.relationships, entity_id=1016).select("id")


@query("SELECT id FROM rel WHERE NOT coalesce(source_id = 1016 AND target_id = 13 AND relation = 'related', false)")
def unlink_pair(s: Store) -> DataFrame:
    return mutate.unlink(s.relationships, 1016, 13, "related").select("id")


# curation


def _graph(s: Store) -> Graph:
    return Graph(s.entities, s.relationships, s.bindings)


def _merged(mapping: str) -> str:
    return f"""
WITH m AS (SELECT DISTINCT from_id, to_id FROM ({mapping}) WHERE from_id <> to_id),
 e AS (SELECT r.id, coalesce(a.to_id, source_id) AS s, coalesce(b.to_id, target_id) AS t, relation, weight, a.to_id IS NOT NULL OR b.to_id IS NOT NULL AS moved FROM rel r LEFT JOIN m a ON a.from_id = source_id LEFT JOIN m b ON b.from_id = target_id),
 k AS (SELECT *, row_number() OVER (PARTITION BY s, t, relation ORDER BY moved, id) AS n FROM e WHERE NOT moved OR s IS DISTINCT FROM t)
"""


_PAIRS = "SELECT id AS from_id, 1016 AS to_id FROM ent WHERE id BETWEEN 1040 AND 1200"


def _mapping(s: Store) -> DataFrame:
    return s.entities.where(F.col("id").between(1040, 1200)).select(F.col("id").alias("from_id"), F.lit(1016).cast("bigint").alias("to_id"))


@query(_merged(_PAIRS) + "SELECT id, s AS source_id, t AS target_id, relation, weight FROM k WHERE n = 1")
def merge_entities(s: Store) -> DataFrame:
    return curate.merge_entities(_graph(s), _mapping(s)).relationships.select("id", "source_id", "target_id", "relation", "weight")


@query(_merged(_PAIRS) + ", d AS (SELECT id, count(*) AS d FROM (SELECT id AS r, s AS id FROM k WHERE n = 1 UNION SELECT id, t FROM k WHERE n = 1) GROUP BY 1) SELECT e.id, coalesce(d, 0) AS degree FROM ent e LEFT JOIN d ON d.id = e.id WHERE e.id NOT IN (SELECT from_id FROM m)")
def merge_entities_degrees(s: Store) -> DataFrame:
    return curate.merge_entities(_graph(s), _mapping(s)).entities.select("id", "degree")


_PLAN = f"SELECT id AS from_id, first_value(id) OVER (PARTITION BY namespace, normal ORDER BY CASE WHEN name <> normal THEN 1 ELSE 0 END, id) AS to_id, normal, name FROM (SELECT *, {_NORMAL} AS normal FROM ent) WHERE length(normal) >= 2"


@query(f"SELECT from_id, to_id, normal FROM ({_PLAN}) WHERE from_id <> to_id OR name <> normal")
def normalize_entities_plan(s: Store) -> DataFrame:
    return curate.normalization_plan(s.entities)


@query(f"SELECT DISTINCT namespace, coalesce(normal, name) AS name FROM (SELECT namespace, name, CASE WHEN length({_NORMAL}) >= 2 THEN {_NORMAL} END AS normal FROM ent)")
def normalize_entities(s: Store) -> DataFrame:
    return curate.normalize_entities(_graph(s)).entities.select("namespace", "name")


@query("SELECT id FROM rel WHERE relation IS DISTINCT FROM 'mentions'")
def prune_relation(s: Store) -> DataFrame:
    return curate.prune_relation(_graph(s), "mentions").relationships.select("id")


@query("SELECT memory_id, entity_id FROM bind WHERE entity_id <> 1")
def prune_bindings(s: Store) -> DataFrame:
    return curate.prune_bindings(_graph(s), s.entities.where("id = 1").select("id")).bindings.select("memory_id", "entity_id")


@query("SELECT id FROM ent WHERE id IN (SELECT id FROM deg) OR id IN (SELECT entity_id FROM bind)")
def cleanup_orphans(s: Store) -> DataFrame:
    return curate.cleanup_orphans(_graph(s)).entities.select("id")


@query("SELECT e.id, count(r.id) AS degree FROM ent e LEFT JOIN (SELECT DISTINCT id, unnest([source_id, target_id]) AS x FROM rel WHERE source_id IS DISTINCT FROM 1016 AND target_id IS DISTINCT FROM 1016) r ON r.x = e.id WHERE e.id <> 1016 GROUP BY e.id")
def delete_entity(s: Store) -> DataFrame:
    return curate.delete_entities(_graph(s), s.entities.where("id = 1016").select("id")).entities.select("id", "degree")


@query("SELECT id, CASE WHEN type = 'tool' THEN 'concept' ELSE type END AS type FROM ent")
def reclassify_type(s: Store) -> DataFrame:
    return curate.reclassify_type(s.entities, "concept", "tool").select("id", "type")


_RECLASS = """
WITH h AS (SELECT id, source_id, target_id, CASE WHEN relation = 'mentions' THEN 'related' ELSE relation END AS relation, coalesce(relation = 'mentions', false) AS hit FROM rel),
 n AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, relation ORDER BY hit, id) AS n FROM h)
"""


@query(_RECLASS + "SELECT id, source_id, target_id, relation FROM n WHERE n = 1")
def reclassify_relation(s: Store) -> DataFrame:
    return curate.reclassify_relation(_graph(s), "mentions", "related")[0].relationships.select("id", "source_id", "target_id", "relation")


@query(_RECLASS + "SELECT count(*) FILTER (hit AND n = 1) AS updated, count(*) FILTER (hit AND n > 1) AS merged FROM n")
def reclassify_relation_counts(s: Store) -> DataFrame:
    return curate.reclassify_relation(_graph(s), "mentions", "related")[1]


@query("SELECT id, CASE WHEN id = 1 THEN 'renamed-queue' ELSE name END AS name FROM ent")
def rename_entity(s: Store) -> DataFrame:
    return curate.rename_entity(s.entities, NS, "core-retry-queue", "Renamed queue").select("id", "name")


# enrichment


@query("SELECT id, name FROM mem WHERE deleted_at IS NULL AND id NOT IN (SELECT memory_id FROM bind)")
def scan_unbound(s: Store) -> DataFrame:
    return enrich.unbound_memories(s.memories, s.bindings).select("id", "name")


@query("SELECT id, name FROM mem WHERE deleted_at IS NULL AND id IN (SELECT memory_id FROM bind)")
def scan_bound(s: Store) -> DataFrame:
    return enrich.bound_memories(s.memories, s.bindings).select("id", "name")


@query("SELECT id, name FROM ent WHERE description IS NULL OR description = ''")
def scan_null_description(s: Store) -> DataFrame:
    return enrich.without_description(s.entities).select("id", "name")


@query("SELECT id, name FROM mem WHERE deleted_at IS NULL AND length(coalesce(body, '')) < 200")
def scan_short_body(s: Store) -> DataFrame:
    return enrich.short_bodies(s.memories).select("id", "name")


@query("SELECT id, name FROM mem WHERE deleted_at IS NULL AND (lower(description) LIKE '%ingested%' OR lower(description) LIKE '%imported%' OR lower(description) LIKE '%added%' OR length(description) < 30)")
def scan_generic_description(s: Store) -> DataFrame:
    return enrich.generic_descriptions(s.memories).select("id", "name")


@query("SELECT r.id, a.name AS source_name, b.name AS target_name, relation, weight FROM rel r JOIN ent a ON a.id = source_id JOIN ent b ON b.id = target_id WHERE weight >= 0.7")
def scan_high_weight(s: Store) -> DataFrame:
    return enrich.high_weights(s.relationships, s.entities)


@query("SELECT r.id, a.name AS source_name, b.name AS target_name, relation, weight FROM rel r JOIN ent a ON a.id = source_id JOIN ent b ON b.id = target_id WHERE relation = 'applies_to'")
def scan_generic_relation(s: Store) -> DataFrame:
    return enrich.generic_relations(s.relationships, s.entities)


@query("""
WITH h AS (SELECT id, name FROM ent WHERE namespace = 'global'),
 p AS (SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM rel WHERE source_id IS NOT NULL AND target_id IS NOT NULL)
SELECT x.id AS a, y.id AS b, x.name AS a_name FROM (SELECT * FROM h ORDER BY id LIMIT 60) x JOIN h y ON x.id < y.id LEFT JOIN p ON p.a = x.id AND p.b = y.id WHERE p.a IS NULL ORDER BY 1, 2 LIMIT 50""")
def scan_isolated_pairs(s: Store) -> DataFrame:
    return enrich.unconnected_pairs(s.entities, s.relationships, NS)


@query("SELECT name AS item_key FROM mem WHERE deleted_at IS NULL AND id NOT IN (SELECT memory_id FROM mvec) UNION ALL SELECT 'entity:' || name FROM ent WHERE id NOT IN (SELECT entity_id FROM evec)")
def scan_re_embed(s: Store) -> DataFrame:
    return enrich.re_embed(s.memories, s.entities, s.chunk_vectors.select("chunk_id"), s.memory_vectors, s.entity_vectors, s.chunk_vectors)


@query("""
SELECT 'memory-bindings' AS operation, count(*) AS n FROM mem WHERE deleted_at IS NULL AND id NOT IN (SELECT memory_id FROM bind) UNION ALL SELECT 'entity-descriptions', count(*) FROM ent WHERE description IS NULL OR description = ''
UNION ALL SELECT 'body-enrich', count(*) FROM mem WHERE deleted_at IS NULL AND length(coalesce(body, '')) < 200 UNION ALL SELECT 're-embed', count(*) FROM mem WHERE deleted_at IS NULL AND id NOT IN (SELECT memory_id FROM mvec)
UNION ALL SELECT 'weight-calibrate', count(*) FROM rel WHERE weight >= 0.7 UNION ALL SELECT 'relation-reclassify', count(*) FROM rel WHERE relation = 'applies_to' UNION ALL SELECT 'entity-type-validate', count(*) FROM ent
UNION ALL SELECT 'description-enrich', count(*) FROM mem WHERE deleted_at IS NULL AND (lower(description) LIKE '%ingested%' OR lower(description) LIKE '%imported%' OR lower(description) LIKE '%added%' OR length(description) < 30)""")
def backlog_counts(s: Store) -> DataFrame:
    return enrich.backlog(s.memories, s.entities, s.relationships, s.bindings, s.memory_vectors)


MID = 1_704_500_000


@query(f"SELECT operation, status, count(*) AS n, count(*) FILTER (status = 'pending' AND (next_retry_at IS NULL OR next_retry_at <= {MID})) AS eligible, count(*) FILTER (status = 'pending' AND next_retry_at > {MID}) AS waiting FROM que GROUP BY ALL")
def queue_status(s: Store) -> DataFrame:
    return report.queue_status(s.queue, MID)


@query("SELECT 'draining' AS state")
def queue_state(s: Store) -> DataFrame:
    return report.queue_state(s.queue, enrich.unbound_memories(s.memories, s.bindings), MID)


@query(f"SELECT id, item_key, 'processing' AS status, attempt + 1 AS attempt FROM que WHERE status = 'pending' AND (next_retry_at IS NULL OR next_retry_at <= {MID}) ORDER BY id LIMIT 20")
def queue_dequeue(s: Store) -> DataFrame:
    return enrich.dequeue(s.queue, MID, 20).select("id", "item_key", "status", "attempt")


@query(f"SELECT id, CASE WHEN status = 'processing' THEN CASE WHEN id % 5 = 0 OR attempt >= 5 THEN 'dead' ELSE 'pending' END ELSE status END AS status, CASE WHEN status = 'processing' AND NOT (id % 5 = 0 OR attempt >= 5) THEN {MID} + least(900, 60 * pow(2, attempt))::BIGINT ELSE next_retry_at END AS next_retry_at FROM que")
def queue_backoff(s: Store) -> DataFrame:
    failed = s.queue.where("status = 'processing'").select("id", (F.col("id") % 5 == 0).alias("permanent"))
    return enrich.fail(s.queue, failed, MID).select("id", "status", "next_retry_at")


@query("SELECT id, item_key FROM que WHERE status <> 'dead' OR item_key IN (SELECT name FROM mem WHERE deleted_at IS NULL)")
def queue_prune_dead(s: Store) -> DataFrame:
    return enrich.prune_dead(s.queue, s.memories).select("id", "item_key")


@query("SELECT id, CASE WHEN status = 'dead' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'dead' THEN 0 ELSE attempt END AS attempt FROM que")
def queue_requeue_dead(s: Store) -> DataFrame:
    return enrich.requeue_dead(s.queue).select("id", "status", "attempt")


@query("SELECT item_key, status FROM que UNION ALL SELECT name, 'pending' FROM mem WHERE namespace = 'global' AND deleted_at IS NULL AND id NOT IN (SELECT memory_id FROM bind)")
def queue_enqueue(s: Store) -> DataFrame:
    items = enrich.unbound_memories(s.memories, s.bindings, NS).select(F.col("name").alias("item_key"), F.lit(0).cast("bigint").alias("operation"))
    return enrich.enqueue(s.queue, items, F.lit(NOW)).select("item_key", "status")


# text


@query("SELECT id, {n} AS name FROM ent".format(n=_NORMAL))
def slug_names(s: Store) -> DataFrame:
    return s.entities.select("id", T.normalize_entity_name(F.col("name")).alias("name"))


@query("SELECT id, trim(regexp_replace(lower(name), '[_ ]', '-', 'g'), '-') AS slug, regexp_matches(trim(regexp_replace(lower(name), '[_ ]', '-', 'g'), '-'), '^([a-z][a-z0-9-]{0,78}[a-z0-9]|[a-z0-9])$') AND length(trim(regexp_replace(lower(name), '[_ ]', '-', 'g'), '-')) <= 80 AS valid FROM mem")
def memory_slugs(s: Store) -> DataFrame:
    slug = T.memory_slug(F.col("name"))
    return s.memories.select("id", slug.alias("slug"), T.valid_memory_slug(slug).alias("valid"))


_REL = "replace(lower(relation), '-', '_')"


@query(f"SELECT id, CASE WHEN relation IS NULL THEN NULL WHEN {_REL} IN ('applies_to', 'uses', 'depends_on', 'causes', 'fixes', 'contradicts', 'supports', 'follows', 'related', 'mentions', 'replaces', 'tracked_in') THEN {_REL} ELSE CASE {_REL} WHEN 'adds' THEN 'causes' WHEN 'creates' THEN 'causes' WHEN 'implements' THEN 'supports' WHEN 'blocks' THEN 'contradicts' WHEN 'part_of' THEN 'applies_to' ELSE 'related' END END AS relation, regexp_matches({_REL}, '^[a-z][a-z0-9_]*$') AS valid FROM rel")
def relation_canonical(s: Store) -> DataFrame:
    return s.relationships.select("id", T.canonical_relation(F.col("relation")).alias("relation"), T.valid_relation(T.normalize_relation(F.col("relation"))).alias("valid"))


def _type_sql() -> str:
    cases = " ".join(f"WHEN t IN ({', '.join(repr(a) for a in names)}) THEN '{kind}'" for kind, names in v.ENTITY_TYPE_ALIASES.items())
    known = ", ".join(repr(t) for t in v.ENTITY_TYPES)
    return f"SELECT id, CASE WHEN t IS NULL THEN NULL WHEN t IN ({known}) THEN t {cases} ELSE 'concept' END AS type FROM (SELECT id, replace(lower(trim(type)), '-', '_') AS t FROM ent)"


@query(_type_sql())
def entity_type_canonical(s: Store) -> DataFrame:
    return s.entities.select("id", T.canonical_entity_type(F.col("type")).alias("type"))


@query("SELECT DISTINCT id, url, octet_length(encode(substring(body, 1, instr(body, url) - 1))) AS url_offset FROM (SELECT id, body, unnest(regexp_extract_all(body, 'https?://[^\\s)\\]}\"''<]*')) AS url FROM mem) WHERE length(url) BETWEEN 10 AND 4096")
def extract_urls(s: Store) -> DataFrame:
    return T.url_rows(s.memories, "id", "body")


@query("SELECT id, coalesce(substring(list_filter(list_transform(string_split(body, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: octet_length(encode(x)) > 20 AND NOT starts_with(x, '#'))[1], 1, 100), 'ingested document') AS description FROM mem")
def heuristic_description(s: Store) -> DataFrame:
    return s.memories.select("id", T.heuristic_description(F.col("body")).alias("description"))


@query("""
WITH t AS (SELECT id, CASE WHEN length(name) > 0 THEN list_distinct(list_transform(range(1, length(name) + 1), lambda i: substring(chr(1) || name || chr(1), i, 3))) ELSE [] END AS a,
  CASE WHEN length(n) > 0 THEN list_distinct(list_transform(range(1, length(n) + 1), lambda i: substring(chr(1) || n || chr(1), i, 3))) ELSE [] END AS b FROM (SELECT id, name, lower(name) AS n FROM ent)),
 c AS (SELECT id, len(list_intersect(a, b)) AS x, len(list_distinct(list_concat(a, b))) AS u FROM t)
SELECT id, round(CASE WHEN u = 0 THEN 1.0 ELSE x / u END, 6) AS score FROM c""")
def trigram_jaccard(s: Store) -> DataFrame:
    return s.entities.select("id", F.round(T.trigram_jaccard(F.col("name"), F.lower("name")), 6).alias("score"))


_W = "list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '')"


@query(f"""
WITH l AS (SELECT id, {_W} AS w FROM mem WHERE body IS NOT NULL),
 c AS (SELECT id, w, unnest(range(0, greatest(1, CAST(ceil((len(w) - 50) / 350.0) AS BIGINT)))) AS chunk_idx FROM l)
SELECT id, chunk_idx, chunk_idx * 350 AS first_token, len(w[chunk_idx * 350 + 1 : chunk_idx * 350 + 400]) AS n_tokens, array_to_string(w[chunk_idx * 350 + 1 : chunk_idx * 350 + 400], ' ') AS chunk_text FROM c""")
def chunk_token_windows(s: Store) -> DataFrame:
    return chunking.chunk_token_windows(s.memories, "id", "body")


@query()
def chunk_heuristic(s: Store) -> DataFrame:
    return chunking.chunk_heuristic(s.memories, "id", "body")


@query()
def chunk_markdown(s: Store) -> DataFrame:
    return chunking.chunk_markdown(s.memories, "id", "body")


@query()
def section_split(s: Store) -> DataFrame:
    return chunking.split_sections(s.memories, "id", "body")


@query(f"SELECT id, octet_length(encode(body)) AS bytes, (len({_W}) * 3 + 1) // 2 AS approx_tokens, CASE WHEN octet_length(encode(body)) <= 800 THEN 1 ELSE CAST(ceil((octet_length(encode(body)) - 100) / 700.0) AS BIGINT) END AS chunk_count FROM mem WHERE body IS NOT NULL")
def body_budget(s: Store) -> DataFrame:
    return chunking.body_budget(s.memories, "id", "body").select("id", "bytes", "approx_tokens", "chunk_count")


# exports and research


@query("SELECT name, id, updated_at FROM mem WHERE deleted_at IS NULL AND namespace = 'global'")
def export_ndjson(s: Store) -> DataFrame:
    lines, _ = export.memory_lines(s.memories, NS)
    read = F.from_json("line", "id bigint, updated_at bigint")
    return lines.select("name", read["id"].alias("id"), read["updated_at"].alias("updated_at"))


@query("SELECT 1 AS part, id, '  ' || regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g') || ' [label=\"' || replace(replace(name, '\\', '\\\\'), '\"', '\\\"') || '\"];' AS line FROM ent UNION ALL SELECT 2, r.id, '  ' || regexp_replace(a.name, '[^A-Za-z0-9_]', '_', 'g') || ' -> ' || regexp_replace(b.name, '[^A-Za-z0-9_]', '_', 'g') || ' [label=\"' || replace(replace(relation, '\\', '\\\\'), '\"', '\\\"') || '\"];' FROM rel r JOIN ent a ON a.id = source_id JOIN ent b ON b.id = target_id UNION ALL SELECT 0, 0, 'digraph lore {' UNION ALL SELECT 3, 0, '}'")
def export_dot(s: Store) -> DataFrame:
    return export.dot(s.entities, s.relationships)


@query("SELECT 1 AS part, id, '  ' || regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g') || '[\"' || replace(replace(name, '\"', ''''), '|', '/') || '\"]' AS line FROM ent UNION ALL SELECT 2, r.id, '  ' || regexp_replace(a.name, '[^A-Za-z0-9_]', '_', 'g') || ' -->|' || replace(replace(relation, '\"', ''''), '|', '/') || '| ' || regexp_replace(b.name, '[^A-Za-z0-9_]', '_', 'g') FROM rel r JOIN ent a ON a.id = source_id JOIN ent b ON b.id = target_id UNION ALL SELECT 0, 0, 'graph LR'")
def export_mermaid(s: Store) -> DataFrame:
    return export.mermaid(s.entities, s.relationships)


@query("SELECT count(*) AS dropped FROM rel WHERE id NOT IN (SELECT r.id FROM rel r JOIN ent a ON a.id = source_id JOIN ent b ON b.id = target_id)")
def export_dropped_edges(s: Store) -> DataFrame:
    return export.snapshot(s.entities, s.relationships)[2]


QUESTION = "recall path; merge step; audit trail"


def _research(s: Store) -> tuple[DataFrame, DataFrame]:
    parts = dict(enumerate(research.decompose(QUESTION)))
    return research.research(s.memories, s.bindings, s.relationships, s.memory_vectors, s.vectors([3, 7, 11]), parts)


def _deep_sql() -> str:
    lists = []
    for q, (vec, words) in enumerate(((3, ("recall", "path")), (7, ("merge", "step")), (11, ("audit", "trail")))):
        sim = f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {vec}))"
        lists.append(f"""
 f{q} AS (SELECT id, term, sum(len(list_filter(w, lambda x: starts_with(x, term)))) AS f FROM l, (SELECT unnest(['{words[0]}', '{words[1]}']) AS term) GROUP BY id, term),
 n{q} AS (SELECT term, count(*) AS n FROM f{q} WHERE f > 0 GROUP BY term),
 i{q} AS (SELECT term, CASE WHEN ln((rows - n + 0.5) / (n + 0.5)) > 0 THEN ln((rows - n + 0.5) / (n + 0.5)) ELSE 1e-6 END AS idf FROM n{q}, g),
 s{q} AS (SELECT f.id, -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d.n / mean))) AS score, count(*) AS hits FROM f{q} f JOIN i{q} i ON i.term = f.term JOIN d ON d.id = f.id CROSS JOIN g WHERE f > 0 GROUP BY f.id),
 t{q} AS (SELECT s.id, row_number() OVER (ORDER BY score, s.id) AS rank FROM s{q} s JOIN mem ON mem.id = s.id WHERE deleted_at IS NULL AND hits = 2 QUALIFY rank <= 20),
 v{q} AS (SELECT memory_id AS id, row_number() OVER (ORDER BY 1 - {sim}, memory_id) AS rank FROM mvec JOIN mem ON mem.id = memory_id WHERE deleted_at IS NULL QUALIFY rank <= 20),
 h{q} AS (SELECT coalesce(v.id, t.id) AS id, least(1.0, (coalesce(1 / (60.0 + v.rank), 0) + coalesce(1 / (60.0 + t.rank), 0)) / (2 / 61.0)) AS score, {q} AS q FROM v{q} v FULL JOIN t{q} t ON v.id = t.id ORDER BY 2 DESC, 1 LIMIT 40)""")
    return _TOKENS.rstrip() + ",".join(lists) + " SELECT q AS query_id, id AS memory_id, round(score, 6) AS score FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2)"


@query(_deep_sql())
def deep_research_candidates(s: Store) -> DataFrame:
    parts = dict(enumerate(research.decompose(QUESTION)))
    found = research.candidates(s.memories, s.memory_vectors, s.vectors([3, 7, 11]), parts)
    return found.select("query_id", "memory_id", F.round("score", 6).alias("score"))


@query()
def deep_research_merge(s: Store) -> DataFrame:
    return _research(s)[0]


@query()
def evidence_chains(s: Store) -> DataFrame:
    return _research(s)[1]


@query("SELECT e.id, e.name, e.type, coalesce(d, 0) AS live_degree FROM ent e LEFT JOIN deg ON deg.id = e.id WHERE name IN (SELECT name FROM mem)")
def graph_context_nodes(s: Store) -> DataFrame:
    return graph.graph_context(s.memories.select("name"), s.entities, s.relationships)[0]


# lookups and changes of whole records

_URLS = "SELECT memory_id, url, url_offset, row_number() OVER (ORDER BY memory_id, url_offset, url) AS id FROM (SELECT DISTINCT id AS memory_id, url, octet_length(encode(substring(body, 1, instr(body, url) - 1))) AS url_offset FROM (SELECT id, body, unnest(regexp_extract_all(body, 'https?://[^\\s)\\]}\"\'\'<]*')) AS url FROM mem) WHERE length(url) BETWEEN 10 AND 4096)"


def _live_ids(s: Store, type_: str | None = None) -> DataFrame:
    return scan.live(s.memories, None, type_).select(F.col("id").alias("memory_id"))


def _url_rows(s: Store) -> DataFrame:
    return T.url_rows(s.memories, "id", "body").withColumnRenamed("id", "memory_id")


def _no_urls(s: Store) -> DataFrame:
    return s.spark.createDataFrame([], "id bigint, memory_id bigint, url string, url_offset bigint, created_at bigint")


@query(f"""
WITH l AS (SELECT id, {_W} AS w FROM mem WHERE body IS NOT NULL AND deleted_at IS NULL AND type = 'decision'),
 c AS (SELECT id, w, unnest(range(0, greatest(1, CAST(ceil((len(w) - 50) / 350.0) AS BIGINT)))) AS chunk_idx FROM l)
SELECT id AS memory_id, chunk_idx, len(w[chunk_idx * 350 + 1 : chunk_idx * 350 + 400]) AS n_tokens FROM c""")
def chunks_by_memory(s: Store) -> DataFrame:
    chunks = chunking.chunk_token_windows(s.memories, "id", "body").withColumnRenamed("id", "memory_id")
    return scan.chunks_of(chunks, _live_ids(s, "decision")).select("memory_id", "chunk_idx", "n_tokens")


@query(f"SELECT memory_id, url, url_offset FROM ({_URLS}) WHERE memory_id IN (SELECT id FROM mem WHERE deleted_at IS NULL)")
def urls_by_memory(s: Store) -> DataFrame:
    stored = mutate.persist_urls(_no_urls(s), _url_rows(s), NOW)
    return scan.urls_of(stored, _live_ids(s)).select("memory_id", "url", "url_offset")


@query(f"SELECT memory_id, url, CASE WHEN url LIKE '%.example%' THEN -1 ELSE url_offset END AS url_offset FROM ({_URLS})")
def persist_urls(s: Store) -> DataFrame:
    before = mutate.persist_urls(_no_urls(s), _url_rows(s).where(F.col("url").like("%.example%")).withColumn("url_offset", F.lit(-1).cast("bigint")), NOW)
    return mutate.persist_urls(before, _url_rows(s), NOW + 1).select("memory_id", "url", "url_offset")


@query("SELECT count(*) AS total, count(*) > 50 AS truncated FROM mem WHERE namespace = 'global' AND type = 'note' AND deleted_at IS NULL")
def list_memories_count(s: Store) -> DataFrame:
    return scan.count_listed(s.memories, NS, "note")


@query("SELECT id, name FROM mem WHERE deleted_at IS NULL AND namespace = (SELECT namespace FROM mem WHERE id = 2) AND name IN (SELECT name FROM mem WHERE id = 2)")
def scan_named_live(s: Store) -> DataFrame:
    namespace, name = _name(s, 2)
    return enrich.named_live(s.memories, [name, "absent"], namespace).select("id", "name")


_LINKS = f"""
WITH n AS (SELECT id, name, {_NORMAL} AS normal FROM ent WHERE namespace = 'global'), i AS (SELECT normal, min(id) AS id FROM n GROUP BY normal),
 inc AS (SELECT r.id AS seq, a.normal AS s, CASE WHEN b.id IS NULL THEN 'nobody-at-all' ELSE b.normal END AS t, 'uses' AS relation, coalesce(weight, 0.5) AS weight FROM rel r JOIN n a ON a.id = source_id LEFT JOIN n b ON b.id = target_id),
 p AS (SELECT seq, s, t, weight, x.id AS source_id, y.id AS target_id FROM inc LEFT JOIN i x ON x.normal = s LEFT JOIN i y ON y.normal = t),
 o AS (SELECT source_id, target_id, max_by(weight, id) AS weight, count(*) AS n FROM rel WHERE relation = 'uses' GROUP BY 1, 2),
 f AS (SELECT p.*, o.weight AS old, o.n AS n_old, max(seq) OVER (PARTITION BY p.source_id, p.target_id) AS latest FROM p LEFT JOIN o ON o.source_id = p.source_id AND o.target_id = p.target_id WHERE s <> t AND p.weight BETWEEN 0 AND 1)
"""


@query(_LINKS + "SELECT seq, CASE WHEN s = t THEN 'self link' WHEN weight NOT BETWEEN 0 AND 1 THEN 'bad weight' END AS outcome FROM p WHERE s = t OR weight NOT BETWEEN 0 AND 1 UNION ALL SELECT seq, CASE WHEN source_id IS NULL OR target_id IS NULL THEN 'missing entity' WHEN seq < latest THEN 'superseded' WHEN n_old IS NULL THEN 'created' WHEN old = weight THEN 'exists' ELSE 'updated' END FROM f")
def link_outcomes(s: Store) -> DataFrame:
    nodes = s.entities.where(F.col("namespace") == NS)
    a, b = nodes.select(F.col("id").alias("source_id"), F.col("name").alias("source")), nodes.select(F.col("id").alias("target_id"), F.col("name").alias("target"))
    named = s.relationships.select("id", "source_id", "target_id", "weight").join(a, "source_id").join(b, "target_id", "left")
    incoming = named.select(F.col("id").alias("seq"), F.lit(NS).alias("namespace"), "source", F.coalesce("target", F.lit("Nobody at all")).alias("target"), F.lit("uses").alias("relation"), "weight")
    return mutate.link(s.entities, s.relationships, incoming, NOW)[2]


@query("SELECT memory_id, version, change_reason, sha256(body) AS body_hash FROM ver WHERE memory_id = 3 UNION ALL SELECT 3, max(version) + 1, 'edit', sha256('a new body') FROM ver WHERE memory_id = 3 AND EXISTS (SELECT 1 FROM mem WHERE id = 3 AND deleted_at IS NULL)")
def edit_versions(s: Store) -> DataFrame:
    _, versions, _ = mutate.edit_versioned(s.memories, s.versions, *_name(s, 3), NOW, body="a new body")
    return versions.where("memory_id = 3").select("memory_id", "version", "change_reason", T.body_hash(F.col("body")).alias("body_hash"))


@query("SELECT CASE WHEN count(*) = 0 THEN 'not_found' ELSE 'edited' END AS outcome, coalesce(bool_or(type IS DISTINCT FROM 'note'), false) AS re_embed FROM mem WHERE id = 3 AND deleted_at IS NULL")
def edit_outcome(s: Store) -> DataFrame:
    return mutate.edit_versioned(s.memories, s.versions, *_name(s, 3), NOW, type="note", description="d")[2]


@query("SELECT memory_id, version, change_reason FROM ver WHERE memory_id = 3 UNION ALL SELECT 3, max(version) + 1, 'rename' FROM ver WHERE memory_id = 3 AND EXISTS (SELECT 1 FROM mem WHERE id = 3 AND deleted_at IS NULL)")
def rename_versions(s: Store) -> DataFrame:
    _, versions, _ = mutate.rename_versioned(s.memories, s.versions, *_name(s, 3), "Another_name", NOW)
    return versions.where("memory_id = 3").select("memory_id", "version", "change_reason")


@query("SELECT m.id, NULL::BIGINT AS deleted_at, sha256(x.body) AS body_hash FROM mem m JOIN ver x ON x.memory_id = m.id AND x.version = 1 WHERE m.deleted_at IS NOT NULL")
def restore_version(s: Store) -> DataFrame:
    gone = s.memories.where(F.col("deleted_at").isNotNull()).select(F.col("id").alias("memory_id"))
    after, _ = mutate.restore(s.memories, s.versions, gone, NOW, 1)
    return after.join(gone.select(F.col("memory_id").alias("id")), "id", "left_semi").select("id", "deleted_at", T.body_hash(F.col("body")).alias("body_hash"))


@query("""
WITH m AS (SELECT * FROM mem WHERE namespace = 'global' AND deleted_at IS NULL), e AS (SELECT * FROM ent WHERE namespace = 'global'), r AS (SELECT * FROM rel WHERE source_id IN (SELECT id FROM e))
SELECT 'memory-bindings' AS operation, count(*) AS n FROM m WHERE id NOT IN (SELECT memory_id FROM bind) UNION ALL SELECT 'entity-descriptions', count(*) FROM e WHERE description IS NULL OR description = ''
UNION ALL SELECT 'body-enrich', count(*) FROM m WHERE length(coalesce(body, '')) < 200
UNION ALL SELECT 're-embed', (SELECT count(*) FROM m WHERE id NOT IN (SELECT memory_id FROM mvec)) + (SELECT count(*) FROM e WHERE id NOT IN (SELECT entity_id FROM evec))
UNION ALL SELECT 'weight-calibrate', count(*) FROM r WHERE weight >= 0.7 UNION ALL SELECT 'relation-reclassify', count(*) FROM r WHERE relation = 'applies_to' UNION ALL SELECT 'entity-type-validate', count(*) FROM e
UNION ALL SELECT 'description-enrich', count(*) FROM m WHERE lower(description) LIKE '%ingested%' OR lower(description) LIKE '%imported%' OR lower(description) LIKE '%added%' OR length(description) < 30
UNION ALL SELECT unnest(['augment-bindings', 'entity-connect', 'cross-domain-bridges', 'domain-classify', 'graph-audit', 'deep-research-synth', 'body-extract']), 0""")
def backlog_of_namespace(s: Store) -> DataFrame:
    return enrich.backlog_of_namespace(s.memories, s.entities, s.relationships, s.bindings, s.memory_vectors, s.entity_vectors, s.chunk_vectors.select("chunk_id", "memory_id"), s.chunk_vectors, NS)


@query(f"""
WITH c AS ({ORACLE_HEALTH}), n AS (SELECT count(*) AS n FROM rel), t AS (SELECT count(*) AS n FROM rel WHERE relation IS NOT NULL GROUP BY relation ORDER BY n DESC, relation LIMIT 1)
SELECT check_name, CAST(value AS DOUBLE) AS value, check_name NOT IN ('live_memories', 'entities', 'relationships') AND value > 0 AS warn FROM c
UNION ALL SELECT 'vector_coverage_pct', count(v.memory_id) * 100.0 / count(*), count(v.memory_id) < count(*) FROM (SELECT * FROM mem WHERE deleted_at IS NULL) m LEFT JOIN mvec v ON v.memory_id = m.id
UNION ALL SELECT 'mentions_ratio', count(*) FILTER (relation = 'mentions') / count(*), count(*) FILTER (relation = 'mentions') > 0.5 * count(*) FROM rel
UNION ALL SELECT 'applies_to_ratio', count(*) FILTER (relation = 'applies_to') / count(*), false FROM rel
UNION ALL SELECT 'top_relation_share', t.n / n.n, t.n > 0.4 * n.n FROM t, n
UNION ALL SELECT 'super_hubs', count(*) FILTER (d > 50), count(*) FILTER (d > 50) > 0 FROM deg UNION ALL SELECT 'max_degree', max(d), false FROM deg""")
def health_report(s: Store) -> DataFrame:
    return report.health_report(s.memories, s.entities, s.relationships, s.bindings, s.memory_vectors)


@query("SELECT id FROM ent WHERE id IN (SELECT unnest([source_id, target_id]) FROM rel WHERE weight >= 0.95) OR (type IS DISTINCT FROM 'tool' AND id IN (SELECT entity_id FROM bind))")
def cleanup_after_prune(s: Store) -> DataFrame:
    strong = Graph(s.entities, s.relationships.where("weight >= 0.95"), s.bindings)
    pruned = curate.prune_bindings(strong, s.entities.where("type = 'tool'").select("id"))
    return curate.cleanup_orphans(pruned).entities.select("id")


@query("WITH i AS (SELECT id FROM ent WHERE name IN (SELECT e.name FROM ent e JOIN bind b ON b.entity_id = e.id WHERE b.memory_id IN (SELECT id FROM mem WHERE namespace = 'global'))) SELECT id, source_id, target_id, relation, weight FROM rel WHERE source_id IN (SELECT id FROM i) AND target_id IN (SELECT id FROM i) ORDER BY weight DESC NULLS LAST, id LIMIT 50")
def graph_context_edges(s: Store) -> DataFrame:
    bound = s.bindings.join(s.memories.where(F.col("namespace") == NS).select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    ids = bound.select(F.col("entity_id").alias("id"))
    return graph.graph_context(s.entities.join(ids, "id", "left_semi").select("name"), s.entities, s.relationships)[1]


def _related_to_memory() -> str:
    sql = _related_sql("namespace = (SELECT namespace FROM mem WHERE id = 8) AND weight >= 0.3 AND source_id IS NOT NULL AND target_id IS NOT NULL", 10)
    return sql.replace("SELECT 1016 AS id", "SELECT entity_id AS id FROM bind WHERE memory_id = 8 AND EXISTS (SELECT 1 FROM mem WHERE id = 8 AND deleted_at IS NULL)").replace("w.n = 1 AND deleted_at IS NULL", "w.n = 1 AND deleted_at IS NULL AND b.memory_id <> 8")


@query(_related_to_memory())
def related_to_memory(s: Store) -> DataFrame:
    return graph.related_by_name(s.memories, s.entities, s.bindings, s.relationships, *_name(s, 8))


@query()
def deep_research_with_entities(s: Store) -> DataFrame:
    parts = dict(enumerate(research.decompose(QUESTION)))
    return research.research(s.memories, s.bindings, s.relationships, s.memory_vectors, s.vectors([3, 7, 11]), parts, entity_embeddings=s.entity_vectors)[0]


def _tiling(pieces: DataFrame, most: int | None, text: DataFrame) -> DataFrame:
    """``(id, bytes, covered, within, whole)`` of each text: do its spans begin at 0, follow on one another and end at its end, fit, and hold its bytes."""
    by = Window.partitionBy("id").orderBy("start_offset", "end_offset")
    step = pieces.withColumn("_reach", F.coalesce(F.max("end_offset").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    size = F.col("end_offset") - F.col("start_offset")
    good = step.groupBy("id").agg(F.bool_and(F.col("start_offset") <= F.col("_reach")).alias("_joined"), F.max("end_offset").alias("_end"), F.bool_and(size <= most if most else F.lit(True)).alias("within"), F.bool_and(F.octet_length("chunk_text") == size).alias("whole"))
    size_of = text.where(F.col("body").isNotNull()).select("id", F.octet_length("body").cast("bigint").alias("bytes"))
    return size_of.join(good, "id").select("id", "bytes", (F.col("_joined") & (F.col("_end") == F.col("bytes"))).alias("covered"), "within", "whole")


@query("SELECT id, octet_length(encode(body)) AS bytes, true AS covered, true AS within, true AS whole FROM mem WHERE body IS NOT NULL")
def chunk_heuristic_tiling(s: Store) -> DataFrame:
    return _tiling(chunking.chunk_heuristic(s.memories, "id", "body"), chunking.SIZE, s.memories)


@query("SELECT id, octet_length(encode(body)) AS bytes, true AS covered, true AS within, true AS whole FROM mem WHERE body IS NOT NULL")
def section_split_tiling(s: Store) -> DataFrame:
    return _tiling(chunking.split_sections(s.memories, "id", "body"), v.PARTITION_BYTES, s.memories)


@query("SELECT id, octet_length(encode(body)) AS bytes, true AS covered, true AS within, true AS whole FROM mem WHERE body IS NOT NULL AND regexp_matches(body, '[^\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]')")
def chunk_markdown_tiling(s: Store) -> DataFrame:
    return _tiling(chunking.chunk_markdown(s.memories, "id", "body"), None, s.memories)
