"""Full-text search: prefixes, phrases and BM25 over name, description and body.

The statistics (rows, mean length, rows with each term) are taken over all rows given, deleted ones included,
in every namespace; liveness, namespace and type are applied to the matches. Null columns hold no tokens.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions.text import tokens_of
from lorespark.operators.scan import in_namespaces
from lorespark.runtime import materialize

SYNTAX, SEPARATORS = str.maketrans("", "", '"*()^:'), "-._/"
OPERATORS = {"or", "and", "not", "near"}
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class TextQuery:
    """``all_terms``: every prefix must match; otherwise the phrase or any prefix."""

    prefixes: tuple[str, ...]
    phrase: tuple[str, ...] = ()
    all_terms: bool = True


def parse(text: str) -> TextQuery | None:
    """Words become prefixes joined by AND; a query with separators becomes its phrase or any of its prefixes.

    None where nothing to search for remains. Signs left inside a word split it.
    """
    plain = text.translate(SYNTAX).strip()
    compound = any(c in SEPARATORS for c in plain)
    for c in SEPARATORS if compound else "":
        plain = plain.replace(c, " ")
    terms = tuple(t for word in plain.split() if word.lower() not in OPERATORS for t in tokens_of(word))
    if not terms:
        return None
    return TextQuery(terms, terms, False) if compound else TextQuery(terms)


def _occurrences(tokens: list[str], ordered: list[str], term: tuple[str, ...], prefix: bool) -> int:
    if prefix:
        low = bisect_left(ordered, term[0])
        high = bisect_left(ordered, term[0] + "\U0010ffff")
        return high - low
    n = len(term)
    return sum(tuple(tokens[i : i + n]) == term for i in range(len(tokens) - n + 1)) if n <= len(tokens) else 0


def term_counts(memories: DataFrame, queries: dict[int, TextQuery]) -> DataFrame:
    """``(id, n_tokens, f)``: f holds, query after query, the occurrences of its phrase (if any) and its prefixes."""
    terms = [(t, p) for q in queries.values() for t, p in _terms(q)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, counts = [], []
            for row in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                columns = [tokens_of(x) if x else [] for x in row]
                ordered = [sorted(c) for c in columns]
                sizes.append(sum(map(len, columns)))
                counts.append([sum(_occurrences(c, o, t, p) for c, o in zip(columns, ordered)) for t, p in terms])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.list_(pa.int32()))], ["id", "n_tokens", "f"])

    return memories.select("id", "name", "description", "body").mapInArrow(run, "id bigint, n_tokens bigint, f array<int>")


def _terms(q: TextQuery) -> list[tuple[tuple[str, ...], bool]]:
    return ([(q.phrase, False)] if q.phrase else []) + [((p,), True) for p in q.prefixes]


def search_many(memories: DataFrame, queries: dict[int, TextQuery], namespaces: Sequence[str] | None = None, type_: str | None = None) -> DataFrame:
    """``(query_id, id, score)`` of the live matches of each query; the lower the score the better.

    One pass over the texts serves all queries; the statistics are one row.
    """
    counted = materialize(term_counts(memories, queries), "terms")
    n_terms = sum(len(_terms(q)) for q in queries.values())
    sums = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("mean"), *(F.count_if(F.col("f")[k] > 0).alias(f"t{k}") for k in range(n_terms))).first()
    wanted = in_namespaces(memories.where(F.col("deleted_at").isNull()), namespaces)
    wanted = (wanted.where(F.col("type") == type_) if type_ else wanted).select("id")
    out, at = None, 0
    for query_id, q in queries.items():
        terms = _terms(q)
        places = range(at, at + len(terms))
        at += len(terms)
        f = [F.col("f")[k].cast("double") for k in places]
        idf = [max(math.log((sums["n"] - sums[f"t{k}"] + 0.5) / (sums[f"t{k}"] + 0.5)), 0.0) or 1e-6 for k in places] if sums["n"] else []
        length = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("n_tokens") / F.lit(sums["mean"] or 1.0))
        score = F.lit(0.0)
        for weight, x in zip(idf, f):
            score = score - F.lit(weight) * (x * F.lit(K1 + 1) / (x + length))
        match = F.lit(q.all_terms)
        for x in f:
            match = (match & (x > 0)) if q.all_terms else (match | (x > 0))
        part = counted.where(match).select(F.lit(query_id).alias("query_id"), "id", score.alias("score"))
        out = part if out is None else out.unionByName(part)
    return out.join(wanted, "id", "left_semi").select("query_id", "id", "score")


def search(memories: DataFrame, text: str, k: int = 10, namespaces: Sequence[str] | None = None, type_: str | None = None) -> DataFrame:
    """``(id, score)`` of the best k matches, ties by id; nothing for an empty query."""
    q = parse(text)
    if q is None:
        return memories.where(F.lit(False)).select("id", F.lit(0.0).alias("score"))
    return search_many(memories, {0: q}, namespaces, type_).select("id", "score").orderBy("score", "id").limit(k)


def term_stats(memories: DataFrame) -> DataFrame:
    """``(term, n_rows, n_occurrences)`` over the three columns: what an index would hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in batches:
            rows, total = Counter(), Counter()
            for row in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = Counter(t for x in row if x for t in tokens_of(x))
                total.update(found)
                rows.update(found.keys())
            terms = list(total)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([rows[t] for t in terms], pa.int64()), pa.array([total[t] for t in terms], pa.int64())], ["term", "n_rows", "n_occurrences"])

    counted = memories.select("name", "description", "body").mapInArrow(run, "term string, n_rows bigint, n_occurrences bigint")
    return counted.groupBy("term").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_occurrences").alias("n_occurrences"))
