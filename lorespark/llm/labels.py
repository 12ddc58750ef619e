"""Mapping typed values to a canonical list with a BK-tree under a true edit metric.

The metric is the unrestricted Damerau-Levenshtein distance (insertion, deletion, substitution, transposition
of neighbours), which obeys the triangle inequality; the tree prunes by it and returns every entry within the
threshold. The entries are the labels and their aliases, a reference list that doesn't grow with the data; one of
up to ``ENTRIES_MOST`` entries goes to every task whole, a longer one is cut into shards, each with a tree of its
own. A tree gives its nearest entries with all their labels, and only the merge over the shards decides between
labels, so the number of shards changes no result. Only the distinct typed values are looked up, after a combined
aggregation, so a value with a third of all rows costs one lookup.

Defined cases: a null value is no record of the result; an empty or blank value means no label; a value equal
to a label is not in the result of ``variants``; ties between labels at the least distance go to none of them
unless one entry is nearer after the writing is folded; null entries of the list are left out.
"""

from __future__ import annotations

import re
import unicodedata
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRIES_MOST = 50_000  # entries of one tree
VALUES_MOST = 100_000  # values that meet a shard in one task
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
OTHER = re.compile(r"[^\w]+|_+")


def folded(value: str) -> str:
    """Small letters and digits only: case, accents, separators and punctuation don't count as edits."""
    value = CAMEL.sub(" ", unicodedata.normalize("NFKC", value))
    plain = "".join(c for c in unicodedata.normalize("NFKD", value.lower()) if not unicodedata.combining(c))
    return OTHER.sub("", plain)


def distance(a: str, b: str, most: int) -> int:
    """Unrestricted Damerau-Levenshtein distance; the exact value if it is at most ``most``, else more than it."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = len(a) + len(b)
    last: dict[str, int] = {}
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [far, i] + [0] * len(b)
        match = 0
        for j, y in enumerate(b, 1):
            k, l = last.get(y, 0), match
            if x == y:
                match = j
            row[j + 1] = min(rows[i][j] + (x != y), row[j] + 1, rows[i][j + 1] + 1, rows[k][l] + (i - k - 1) + 1 + (j - l - 1))
        last[x] = i
        rows.append(row)
    return rows[-1][-1]


class BKTree:
    """Entries by their distances from one another."""

    def __init__(self, entries: list[tuple[str, str]]):
        """``entries``: (text, label); equal texts with several labels keep all of them."""
        self.labels: dict[str, set[str]] = {}
        self.root: str | None = None
        self.children: dict[str, dict[int, str]] = {}
        for text, label in entries:
            if text in self.labels:
                self.labels[text].add(label)
                continue
            self.labels[text] = {label}
            self.children[text] = {}
            if self.root is None:
                self.root = text
                continue
            at = self.root
            while True:
                d = distance(text, at, len(text) + len(at))
                if d not in self.children[at]:
                    self.children[at][d] = text
                    break
                at = self.children[at][d]

    def within(self, text: str, most: int) -> list[tuple[int, str]]:
        """Every entry at most ``most`` edits away."""
        found, stack = [], [self.root] if self.root is not None else []
        while stack:
            at = stack.pop()
            d = distance(text, at, len(text) + len(at))
            if d <= most:
                found.append((d, at))
            stack.extend(child for edge, child in self.children[at].items() if d - most <= edge <= d + most)
        return found


def allowed(length: int) -> int:
    """Edits a value of so many letters may have: none up to two letters, one up to five, two beyond."""
    return 0 if length < 3 else 1 if length < 6 else 2


def candidates(tree: BKTree, value: str) -> list[tuple[int, str, bool]]:
    """(distance, label, close) of the nearest entries within what the shorter of the two allows.

    ``close`` tells that the entry has the same letters in another order, or the same first letter: the likelier slip.
    """
    text = folded(value)
    if not text:
        return []
    found = [(d, e) for d, e in tree.within(text, 2 if len(text) >= 5 else allowed(len(text))) if d <= max(allowed(len(text)), allowed(len(e)))]
    least = min((d for d, _ in found), default=0)
    return [(d, label, sorted(e) == sorted(text) or e[:1] == text[:1]) for d, e in found if d == least for label in tree.labels[e]]


def nearest(tree: BKTree, value: str) -> tuple[int, str] | None:
    """(distance, label) of the nearest entry; of several labels the only close one, else none."""
    found = candidates(tree, value)
    for labels in ({label for _, label, _ in found}, {label for _, label, close in found if close}):
        if len(labels) == 1:
            return found[0][0], labels.pop()
    return None


def typed_labels(values: DataFrame, entries: DataFrame) -> DataFrame:
    """``(vocabulary, value, label)`` of each distinct value: its label, or 'unmatched'.

    ``values``: (vocabulary, value); ``entries``: (vocabulary, text, label).
    """
    distinct = values.where(F.col("value").isNotNull()).groupBy("vocabulary", "value").agg(F.count(F.lit(1)).alias("n")).select("vocabulary", "value")
    clean = entries.where(F.col("text").isNotNull() & F.col("label").isNotNull() & F.col("vocabulary").isNotNull()).select("vocabulary", "text", "label").distinct()
    rows = clean.limit(ENTRIES_MOST + 1).collect()
    if len(rows) <= ENTRIES_MOST:
        winners = _look_up(distinct, [(r["vocabulary"], r["text"], r["label"]) for r in rows])
    else:
        winners = _look_up_sharded(distinct, clean)
    return winners.select("vocabulary", "value", F.coalesce("label", F.lit("unmatched")).alias("label"))


def _trees(rows: list[tuple[str, str, str]]) -> dict[str, BKTree]:
    by: dict[str, list[tuple[str, str]]] = {}
    for vocabulary, text, label in sorted(rows):
        by.setdefault(vocabulary, []).append((folded(text), label))
    return {v: BKTree([e for e in entries if e[0]]) for v, entries in by.items()}


def _look_up(distinct: DataFrame, rows: list[tuple[str, str, str]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(rows)
        for batch in batches:
            got = [nearest(trees[v], x) if v in trees else None for v, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g and g[1] for g in got], pa.string())], ["vocabulary", "value", "label"])

    return distinct.mapInArrow(run, "vocabulary string, value string, label string")


def _look_up_sharded(distinct: DataFrame, entries: DataFrame) -> DataFrame:
    """Each shard of the entries has a tree; every value visits all shards, in blocks, so that neither fills a task.

    A shard gives the nearest of its entries; over all shards the labels at the least distance are compared by
    their first and last in order, and so the close ones: equal means only one.
    """
    shards = -(-entries.count() // ENTRIES_MOST)
    blocks = max(1, -(-distinct.count() // VALUES_MOST))
    number = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = distinct.withColumn("block", number(blocks, "vocabulary", "value")).withColumn("shard", each(shards))
    right = entries.withColumn("shard", number(shards, "text")).withColumn("block", each(blocks))

    def run(values, known):  # noqa: ANN001, ANN202 - one block of values and one shard of entries
        import pandas as pd

        trees = _trees(list(zip(known["vocabulary"], known["text"], known["label"])))
        found = [(v, x, d, label, label if close else None) for v, x in zip(values["vocabulary"], values["value"]) if v in trees for d, label, close in candidates(trees[v], x)]
        return pd.DataFrame(found, columns=["vocabulary", "value", "d", "label", "close"])

    met = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(run, "vocabulary string, value string, d bigint, label string, close string")
    # of each value and distance a bounded row, then the least distance
    ends = [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("label", "close")]
    by_distance = met.groupBy("vocabulary", "value", "d").agg(*ends)
    best = by_distance.groupBy("vocabulary", "value").agg(F.min_by(F.struct("min_label", "max_label", "min_close", "max_close"), "d").alias("b"))
    one = F.when(F.col("b.min_label") == F.col("b.max_label"), F.col("b.min_label")).when(F.col("b.min_close") == F.col("b.max_close"), F.col("b.min_close"))
    return distinct.join(best, ["vocabulary", "value"], "left").select("vocabulary", "value", one.alias("label"))


def variants(records: DataFrame, entries: DataFrame, labels: DataFrame) -> DataFrame:
    """``(field, id, label)`` of each record whose value is not exactly a label.

    ``records``: (field, id, vocabulary, value); ``labels``: (vocabulary, label).
    """
    known = labels.where(F.col("label").isNotNull()).select("vocabulary", F.col("label").alias("value")).distinct()
    plain = records.select("field", "id", "vocabulary", "value")
    others = plain.where(F.col("value").isNotNull()).join(F.broadcast(known) if _small(known) else known, ["vocabulary", "value"], "left_anti").dropDuplicates(["field", "id"])
    return others.join(typed_labels(others.select("vocabulary", "value"), entries), ["vocabulary", "value"]).select("field", "id", "label")


def _small(df: DataFrame) -> bool:
    return len(df.limit(ENTRIES_MOST + 1).collect()) <= ENTRIES_MOST
