"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark import runtime
from lorespark.llm import bpe, cooccurrence, labels, names, neardup, packing, quality, splitting, truncation
from lorespark.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.cut_kinds(splitting.split_texts(table(spark, sf, "memories"), "id", "body"), "id")


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_texts(table(spark, sf, "memories"), "id", "body").dropDuplicates(["id", "piece"])


def p1_properties(spark: SparkSession, sf: str) -> DataFrame:
    """What is stated of the pieces, a row a memory: they rebuild the body, fit the limit, repeat one another but for long stretches, and are cut inside a stretch only if it is over the limit."""
    rows = Window.partitionBy("id").orderBy("piece")
    steps = p1_pieces(spark, sf).withColumn("last", F.coalesce(F.lag("end").over(rows), F.lit(0)))
    fresh = F.expr("right(text, length(text) - length(decode(substring(encode(text, 'UTF-8'), 1, int(last - begin)), 'UTF-8')))")
    size = F.col("end") - F.col("begin")
    held = (size <= splitting.LIMIT) & (F.octet_length("text") == size) & (F.col("begin") <= F.col("last")) & (F.col("last") - F.col("begin") <= 2 * splitting.OVERLAP)
    marked = steps.select("id", "piece", "cut", held.alias("held"), fresh.alias("fresh"), "end")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "fresh"))), lambda p: p["fresh"]), "")
    return marked.groupBy("id").agg(F.sha2(whole, 256).alias("rebuilt"), F.max("end").alias("bytes"), F.bool_and("held").alias("held"), F.max("cut").alias("cut"))


def _near(spark: SparkSession, sf: str) -> neardup.NearDuplicates:
    """Problem 3 states its own measure: runs of three words, 60 %, 20 words or more."""
    return neardup.NearDuplicates(table(spark, sf, "memories"), "id", "body", width=3, similarity=0.6, least_words=20)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf).record_pairs()


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf).groups()


def p3_links(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of five words, similarity 0.8: one row a memory with its class and the number of classes linked to it."""
    return neardup.NearDuplicates(table(spark, sf, "memories"), "id", "body", width=5, similarity=0.8, least_words=5).links()


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    types = table(spark, sf, "entities").select(F.lit("entities.type").alias("field"), "id", F.lit("entity_type").alias("vocabulary"), F.col("type").alias("value"))
    relations = table(spark, sf, "relationships").select(F.lit("relationships.relation").alias("field"), "id", F.lit("relation").alias("vocabulary"), F.col("relation").alias("value"))
    known = table(spark, sf, "canonical_labels").select("vocabulary", "label")
    entries = known.select("vocabulary", F.col("label").alias("text"), "label").unionByName(table(spark, sf, "label_aliases").select("vocabulary", F.col("alias").alias("text"), "label"))
    return labels.variants(types.unionByName(relations), entries, known)


LATEST_DAYS = 30


def _pairs(spark: SparkSession, sf: str) -> cooccurrence.PairTable:
    """The table of the bindings up to the last month, and the last month's merged into it as a change."""
    rows = table(spark, sf, "memory_entities")
    latest = rows.agg(F.max("created_at")).first()[0]
    late = F.coalesce(F.col("created_at") > (latest or 0) - LATEST_DAYS * 86_400, F.lit(False))
    loaded = cooccurrence.load(cooccurrence.clean(rows.where(~late), "memory_id", "entity_id"), cooccurrence.LEAST, cooccurrence.RATIO)
    change = cooccurrence.clean(rows.where(late), "memory_id", "entity_id").withColumn("sign", F.lit(1))
    return cooccurrence.merge(loaded, change)[0]


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return cooccurrence.associated(_pairs(spark, sf)).select(F.col("item_a").alias("entity_a"), F.col("item_b").alias("entity_b"))


def p5_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored = cooccurrence.associated(_pairs(spark, sf))
    return scored.select(F.col("item_a").alias("entity_a"), F.col("item_b").alias("entity_b"), "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p5_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair that occurs together, whatever its count; ``p5_scores`` are those of them beyond the thresholds of its SQL."""
    bindings = cooccurrence.clean(table(spark, sf, "memory_entities"), "memory_id", "entity_id")
    scored = cooccurrence.scores(cooccurrence.load(bindings))
    return scored.select(F.col("item_a").alias("entity_a"), F.col("item_b").alias("entity_b"), "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def _values(spark: SparkSession, sf: str) -> DataFrame:
    bodies = table(spark, sf, "memories").select(F.lit("memories.body").alias("field"), "id", F.col("body").alias("text"), "source")
    origin = F.get_json_object("metadata", "$.origin")
    descriptions = table(spark, sf, "entities").select(F.lit("entities.description").alias("field"), "id", F.col("description").alias("text"), origin.alias("source"))
    return bodies.unionByName(descriptions)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated(_values(spark, sf), "field", "id", "text")


def p6_rates(spark: SparkSession, sf: str) -> DataFrame:
    values = _values(spark, sf)
    return truncation.truncation_rates(values, truncation.truncated(values, "field", "id", "text"), "field", "id", "source")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    forms = [tuple(r) for r in table(spark, sf, "name_forms").select("kind", "full_form", "short_form").collect()]  # a reference list of fixed size
    return names.name_pairs(names.linked_names(table(spark, sf, "entities"), forms))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_ids(table(spark, sf, "documents"), "doc_id", "text")


def p8_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What the ids of any text must hold: they decode to its bytes; empty and null texts have none."""
    return bpe.decoded_hashes(p8_ids(spark, sf), "doc_id", "ids")


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf, "documents"), "doc_id", "text")


def p9_properties(spark: SparkSession, sf: str) -> DataFrame:
    """What is stated of the containers, a row a document: its pieces follow on one another, it is cut only if over the capacity, and none of its containers is too full."""
    placed = runtime.materialize(p9_containers(spark, sf), "containers")
    fill = placed.groupBy("container").agg(F.sum("length").alias("fill"))
    rows = Window.partitionBy("doc_id").orderBy("piece")
    joined = placed.join(fill, "container").withColumn("expected", F.coalesce(F.sum("length").over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    one = joined.groupBy("doc_id").agg(F.bool_and(F.col("begin") == F.col("expected")).alias("follows"), F.bool_and(F.col("fill") <= packing.CAPACITY).alias("fits"), F.sum("length").alias("n"), F.count(F.lit(1)).alias("pieces"))
    return one.select("doc_id", "follows", "fits", (F.col("pieces") == F.ceil(F.col("n") / packing.CAPACITY)).alias("cut_if_over"))


def _common(spark: SparkSession, sf: str) -> list[tuple]:
    return [tuple(r) for r in table(spark, sf, "common_words").select("lang", "word").collect()]  # a reference list of fixed size


def p10_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return quality.text_statistics(table(spark, sf, "documents"), "doc_id", "text", _common(spark, sf))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return quality.not_prose(p10_statistics(spark, sf), "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_pieces, p1_properties, p3_found, p3_groups, p3_links, p4_found, p5_found, p5_scores, p5_pairs, p6_found, p6_rates, p7_found, p8_ids, p8_counts, p9_containers, p9_properties, p10_statistics, p10_found)
}

_P5 = """
WITH b AS (SELECT DISTINCT memory_id AS m, entity_id AS e FROM memory_entities WHERE memory_id IS NOT NULL AND entity_id IS NOT NULL),
 t AS (SELECT count(DISTINCT m) AS total FROM b), n AS (SELECT e, count(*) AS n FROM b GROUP BY e),
 p AS (SELECT x.e AS a, y.e AS b, count(*) AS n_ab FROM b x JOIN b y ON x.m = y.m AND x.e < y.e GROUP BY x.e, y.e HAVING count(*) >= 5)
SELECT p.a AS entity_a, p.b AS entity_b{more} FROM p JOIN n na ON na.e = p.a JOIN n nb ON nb.e = p.b CROSS JOIN t
WHERE n_ab * total >= 8 * na.n * nb.n
"""

_P5_PAIRS = """
WITH b AS (SELECT DISTINCT memory_id AS m, entity_id AS e FROM memory_entities WHERE memory_id IS NOT NULL AND entity_id IS NOT NULL),
 t AS (SELECT count(DISTINCT m) AS total FROM b), n AS (SELECT e, count(*) AS n FROM b GROUP BY e),
 p AS (SELECT x.e AS a, y.e AS b, count(*) AS n_ab FROM b x JOIN b y ON x.m = y.m AND x.e < y.e GROUP BY x.e, y.e)
SELECT p.a AS entity_a, p.b AS entity_b, n_ab, na.n AS n_a, nb.n AS n_b, round(n_ab * total / (CAST(na.n AS DOUBLE) * nb.n), 6) AS lift
FROM p JOIN n na ON na.e = p.a JOIN n nb ON nb.e = p.b CROSS JOIN t
"""

_LINKS = """
WITH RECURSIVE m AS (SELECT DISTINCT id, body, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+') AS w FROM memories),
 c AS (SELECT id, CASE WHEN body IS NULL THEN id WHEN len(w) >= {least} THEN min(id) OVER (PARTITION BY body IS NULL, len(w) >= {least}, w) ELSE min(id) OVER (PARTITION BY body IS NULL, len(w) >= {least}, body) END AS class, w FROM m),
 s AS (SELECT DISTINCT id, array_to_string(w[i : i + {width} - 1], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - {width} + 2)) AS i FROM c WHERE id = class AND len(w) >= {least})),
 n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
 q AS (SELECT x.id AS a, y.id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.id < y.id GROUP BY x.id, y.id),
 p AS (SELECT a, b FROM q JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE {share} * (na.n + nb.n - common)),
 e AS (SELECT a AS x, b AS y FROM p UNION ALL SELECT b, a FROM p), k AS (SELECT x AS class, count(*) AS n FROM e GROUP BY x),
 r AS (SELECT x AS class, x AS root FROM k JOIN e ON e.x = k.class UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.class),
 g AS (SELECT class, min(root) AS root FROM r GROUP BY class)
SELECT {out} FROM c {tail} WHERE {nodes}
"""

ORACLE: dict[str, str] = {
    "p1_found": """
SELECT DISTINCT id, CASE WHEN list_max(list_transform(regexp_split_to_array(body, '[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}。！？]+'), lambda x: octet_length(encode(x)))) > 800
  THEN 'forced' ELSE 'natural' END AS cut
FROM memories WHERE octet_length(encode(body)) > 800""",
    "p1_properties": """
SELECT DISTINCT id, sha256(body) AS rebuilt, octet_length(encode(body)) AS bytes, true AS held, CASE WHEN list_max(list_transform(regexp_split_to_array(body, '[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}。！？]+'), lambda x: octet_length(encode(x)))) > 800
  THEN 'forced' ELSE 'natural' END AS cut
FROM memories WHERE octet_length(encode(body)) > 800""",
    "p8_counts": "SELECT doc_id, sha256(coalesce(text, '')) AS text_hash FROM documents",
    "p9_properties": "SELECT doc_id, true AS follows, true AS fits, true AS cut_if_over FROM documents WHERE length(text) > 0",
    "p3_links": _LINKS.format(width=5, least=5, share="10 * common >= 8", nodes="true", out="c.id, c.class, coalesce(k.n, 0) AS n_links", tail="LEFT JOIN k ON k.class = c.class"),
    "p3_groups": _LINKS.format(width=3, least=20, share="10 * common >= 6", nodes="true", out='c.id, coalesce(g.root, c.class) AS "group"', tail="LEFT JOIN g ON g.class = c.class"),
    "p3_found": """
WITH m AS (SELECT DISTINCT id, body, regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+') AS w FROM memories WHERE body IS NOT NULL),
 s AS (SELECT DISTINCT id, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM m WHERE len(w) >= 20)),
 n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
 p AS (SELECT x.id AS a, y.id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.id < y.id GROUP BY x.id, y.id)
SELECT a AS id_a, b AS id_b FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b JOIN m ma ON ma.id = a JOIN m mb ON mb.id = b
WHERE 10 * common >= 6 * (na.n + nb.n - common) AND ma.body <> mb.body""",
    "p5_found": _P5.format(more=""),
    "p5_scores": _P5.format(more=", n_ab, na.n AS n_a, nb.n AS n_b, round(n_ab * total / (CAST(na.n AS DOUBLE) * nb.n), 6) AS lift"),
    "p5_pairs": _P5_PAIRS,
}
