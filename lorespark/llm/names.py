"""Spellings of names that mean one person or one organisation, linked within a namespace.

Names become weighted vectors of character n-grams, each n-gram tagged with the initial of another part of the
name, so that order and case don't matter and a frequent given name alone brings nobody together. A sparse
cosine join finds all pairs of different forms over the threshold: by the shared order of n-grams from rare to
frequent only the head of each vector is joined, partial products are summed a pair, pairs whose bound stays
under the threshold go, and the cosine of the rest is completed. An exact check part by part (equal, known short
form, initial, slip of the keys) takes out what can't be one name. The cosines that remain are grouped by average
linkage: a pair under the threshold or refused by the check counts 0, so an ambiguous initial doesn't tie two
relatives together.

Linkage joins the pair of clusters of the highest mean first. As means never rise by joining, all pairs that are
each other's best may be joined at once: small connected sets are linked in one task each, large ones by such
rounds over the cluster, with the same result. Sums are whole numbers, so no order of adding changes a tie.

Defined cases: a null name or namespace has no partner; repeated records are one; equal names are partners;
a name without letters has none; a name of parts under four letters has equal names as partners only, since a
slip or an initial of so short a name shows nothing; ties in linkage are broken by id.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
import unicodedata
from collections import Counter
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.labels import distance
from lorespark.runtime import materialize

GRAM = 4
#: Least cosine of a pair, and least mean of the square roots of the cosines between two clusters.
COSINE, LINKAGE = 0.12, 0.35
UNIT = 1_000_000  # similarities are whole numbers of such parts
#: Connected sets of more links are linked by rounds over the cluster instead of in one task.
LINKS_AT_ONCE = 100_000
NOTE = re.compile(r"\([^)]*\)|\[[^\]]*\]|\s+-\s+.*$|,\s*(?:ops|on call|ext|contractor)\s*$", re.I)
PART = re.compile(r"[^\W_]+")
#: Forms of address, legal forms that are left out at will, and articles.
TITLES = frozenset("dr dra prof profa mr mrs ms miss sir sr sra srta ing eng herr frau".split())
LEGAL = frozenset("limited incorporated corporation company".split())
ARTICLES = frozenset("the".split())


class Forms:
    """Short forms of given names and of words in organisations' names."""

    def __init__(self, rows: list[tuple[str | None, str | None, str | None]]):
        self.full: dict[str, set[str]] = {}
        self.given: set[str] = set()
        self.organisation: set[str] = set()
        for kind, full, short in rows:
            if full and short:
                f, s = plain(full), plain(short)
                self.full.setdefault(s, set()).add(f)
                (self.organisation if kind == "organization_word" else self.given).update((f, s))

    def of(self, part: str) -> frozenset[str]:
        return frozenset(self.full.get(part, ())) | {part}


def plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def parts(name: str | None, forms: Forms) -> tuple[str, ...]:
    """The parts of a name that tell: without notes, titles, articles and middle initials."""
    if not name:
        return ()
    bare = NOTE.sub(" ", name)
    found = PART.findall(plain(bare)) or PART.findall(plain(name))
    found = [p for p in found if p not in ARTICLES]
    known = sum(any(f in forms.organisation for f in forms.of(p)) for p in found if p not in TITLES)
    if len(found) > 2 or len(found) == 2 and len(found[0]) > 1 and len(found[1]) > 1 and found[0] in TITLES and found[0] not in forms.organisation:
        if found[0] in TITLES and not known and len(found) > 2:
            found = found[1:]
    long = [p for p in found if len(p) > 1]
    if len(long) >= 2:
        found = long
    return tuple(found)


def code_like(part: str, forms: Forms) -> bool:
    """Serial numbers and the like: they must be equal."""
    return any(c.isdigit() for c in part) or 1 < len(part) <= 3 and part not in forms.full and part not in forms.given


def features(found: tuple[str, ...], forms: Forms) -> list[str]:
    """N-grams of each longer part, tagged with the initials of each other part and with all serial numbers."""
    codes = "".join(sorted(p for p in found if code_like(p, forms)))
    rest = [p for p in found if not code_like(p, forms)]
    main = [p for p in rest if not forms.of(p) & LEGAL] or rest
    out = set()
    for i, p in enumerate(main):
        tags = {f[0] for j, q in enumerate(main) if j != i for f in forms.of(q)} or {""}
        for f in forms.of(p):
            if len(f) < 4:
                continue
            if p in forms.full and f == p:
                continue
            padded = f"^{f}$"
            for k in range(len(padded) - GRAM + 1):
                out.update(f"{padded[k : k + GRAM]}{t}|{codes}" for t in tags)
    if not out and found:
        out.add("=" + " ".join(sorted(found)))
    return sorted(out)


def part_likeness(a: str, b: str, forms: Forms) -> float:
    """1 for equal parts, less for a short form, a slip of the keys or an initial, 0 for different parts."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        one, other = (a, b) if len(a) == 1 else (b, a)
        return 0.75 if any(f[0] == one for f in forms.of(other)) else 0.0
    if code_like(a, forms) or code_like(b, forms):
        return 0.0
    fa, fb = forms.of(a), forms.of(b)
    if fa & fb:
        return 0.95
    both = forms.given | forms.organisation
    if a in both and b in both:
        return 0.0  # two different known words
    least = 9
    for x, y in itertools.product(fa, fb):
        size = min(len(x), len(y))
        most = 0 if size < 3 else 1 if size < 8 else 2
        d = distance(x, y, most) if most else 9
        if d <= most:
            least = min(least, d)
    return {1: 0.9, 2: 0.8}.get(least, 0.0)


def likeness(a: tuple[str, ...], b: tuple[str, ...], forms: Forms) -> float:
    """How well two names agree: every part of the shorter must have its own part in the longer, and what the
    longer has beyond may only be legal forms. 0 if they don't mean the same."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    droppable = [bool(forms.of(p) & LEGAL) for p in b]
    if len(b) - len(a) > sum(droppable):
        legal_a = [p for p in a if forms.of(p) & LEGAL]
        if len(b) - len(a) + len(legal_a) > sum(droppable):
            return 0.0
    options = sorted(((part_likeness(x, y, forms), i, j) for i, x in enumerate(a) for j, y in enumerate(b)), key=lambda o: (-o[0], o[1], o[2]))
    used_a: set[int] = set()
    used_b: set[int] = set()
    scores, anchor = [], False
    for score, i, j in options:
        if score > 0 and i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            scores.append(score)
            anchor |= len(a[i]) >= 4 and len(b[j]) >= 4 and score >= 0.8 and not (forms.of(a[i]) | forms.of(b[j])) & (forms.given | forms.organisation)
    rest = [a[i] for i in range(len(a)) if i not in used_a] + [b[j] for j in range(len(b)) if j not in used_b]
    if not scores or any(not forms.of(p) & LEGAL for p in rest):
        return 0.0
    if not anchor and a != b and sorted(a) != sorted(b):
        return 0.0
    return max(0.0, sum(scores) / len(scores) - 0.02 * len(rest))


def link(edges: Iterable[tuple[int, int, int]], mass: dict[int, int], least: float = LINKAGE) -> dict[int, int]:
    """Average linkage of one set: cluster (its least member) of each end of ``edges`` (a, b, similarity in parts of ``UNIT``).

    ``mass`` is the number of records of each member. Only links that aren't 0 are kept, with a heap of the pairs
    of clusters that may be joined next.
    """
    near: dict[int, dict[int, int]] = {}
    size: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    for a, b, similarity in edges:
        for x, y in ((a, b), (b, a)):
            size[x] = mass[x]
            members[x] = [x]
            near.setdefault(x, {})[y] = similarity * mass[a] * mass[b]

    def mean(i: int, j: int) -> float:
        return near[i][j] / (size[i] * size[j])

    floor = least * UNIT
    heap = [(-m, i, j) for i, links in near.items() for j in links if i < j and (m := mean(i, j)) >= floor]
    heapq.heapify(heap)
    while heap:
        best, i, j = heapq.heappop(heap)
        if i not in members or j not in members or j not in near[i] or mean(i, j) != -best:  # joined or changed since
            continue
        members[i] += members.pop(j)
        size[i] += size[j]
        for k, total in near.pop(j).items():
            del near[k][j]
            if k != i:
                near[i][k] = near[k][i] = near[i].get(k, 0) + total
        for k in near[i]:
            if (m := mean(i, k)) >= floor:
                heapq.heappush(heap, (-m, min(i, k), max(i, k)))
    return {x: c for c, found in members.items() for x in found}


def average_linkage(names: list[tuple[str, ...]], forms: Forms, least: float = LINKAGE) -> list[int]:
    """Cluster number of each of a few names, comparing all with all: what the join and ``link`` do for many."""
    distinct = sorted({tuple(sorted(n)) for n in names})
    vectors = [features(d, forms) for d in distinct]
    frequency = Counter(f for v in vectors for f in v)
    norm = [math.sqrt(sum(1 / frequency[f] for f in v)) for v in vectors]
    edges = []
    for i, j in itertools.combinations(range(len(distinct)), 2):
        both = sum(1 / frequency[f] for f in set(vectors[i]) & set(vectors[j]))
        if both and both / (norm[i] * norm[j]) >= COSINE and likeness(distinct[i], distinct[j], forms) > 0:
            edges.append((i, j, round(math.sqrt(both / (norm[i] * norm[j])) * UNIT)))
    weight = Counter(tuple(sorted(n)) for n in names)
    number = link(edges, {i: weight[d] for i, d in enumerate(distinct)}, least)
    place = {d: number.get(i, i) for i, d in enumerate(distinct)}
    return [place[tuple(sorted(n))] for n in names]


def cosine_pairs(vectors: DataFrame, least: float = COSINE, most_partners: int | None = None) -> DataFrame:
    """``(namespace, a, b, cosine)``, a < b: all pairs of a namespace whose cosine is ``least`` or more.

    ``vectors``: (namespace, id, feature). Weights are the roots of inverse frequencies within the namespace. Only
    the head of each vector, from rare to frequent until what remains is shorter than the threshold, is joined:
    two vectors whose heads have nothing in common have a smaller cosine. Partial products are summed a pair;
    where they and what both rests can add at most stay under the threshold the pair goes, for the others the
    features of both are compared. With ``most_partners`` only pairs among the so many best of either end come
    out, which loses links of names with more spellings.
    """
    frequency = vectors.groupBy("namespace", "feature").agg(F.count(F.lit(1)).alias("df"))
    sorted_ = F.sort_array(F.collect_list(F.struct("df", "feature")))
    rows = vectors.join(frequency, ["namespace", "feature"]).groupBy("namespace", "id").agg(sorted_.alias("features"), F.sum(F.lit(1.0) / F.col("df")).alias("norm2"))
    # the head ends where what remains of the squared length can't reach the threshold
    least2 = F.lit(least * least - 1e-12)
    taken = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    step = lambda t, f: F.when(F.lit(1.0) - t["sum"] / F.col("norm2") >= least2, F.struct((t["sum"] + F.lit(1.0) / f["df"]).alias("sum"), (t["n"] + 1).alias("n"))).otherwise(t)
    rows = rows.withColumn("taken", F.aggregate("features", taken, step))
    beyond = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("taken.sum") / F.col("norm2"))
    met = lambda f: f["df"] > 1  # noqa: E731 - a feature of one name only adds to its length but meets nobody
    vector = rows.select("namespace", "id", "norm2", beyond.alias("beyond"), F.filter("features", met).alias("features"), F.filter(F.slice("features", F.lit(1), F.col("taken.n")), met).alias("head"))
    vector = materialize(vector, "name-rows")
    head = vector.select("namespace", "id", F.explode("head").alias("f")).select("namespace", "id", "f.feature", "f.df")
    a, b = head.withColumnRenamed("id", "a"), head.select("namespace", "feature", F.col("id").alias("b"))
    partial = a.join(b, ["namespace", "feature"]).where("a < b").groupBy("namespace", "a", "b").agg(F.sum(F.lit(1.0) / F.col("df")).alias("partial"))
    va = vector.select("namespace", F.col("id").alias("a"), F.col("norm2").alias("na"), F.col("beyond").alias("ra"), F.col("features").alias("fa"))
    vb = vector.select("namespace", F.col("id").alias("b"), F.col("norm2").alias("nb"), F.col("beyond").alias("rb"), F.col("features").alias("fb"))
    length = F.sqrt(F.col("na") * F.col("nb"))
    # a head may meet the other's rest, so each whole vector bounds the other's rest
    bound = F.col("partial") / length + F.sqrt(F.col("ra")) + F.sqrt(F.col("rb"))
    product = F.aggregate(F.array_intersect("fa", "fb"), F.lit(0.0), lambda total, f: total + F.lit(1.0) / f["df"])
    pairs = partial.join(va, ["namespace", "a"]).join(vb, ["namespace", "b"]).where(bound >= least - 1e-9)
    pairs = pairs.select("namespace", "a", "b", F.least(F.lit(1.0), product / length).alias("cosine")).where(F.col("cosine") >= least)
    if most_partners is None:
        return pairs
    ends = pairs.withColumn("end", F.explode(F.array("a", "b")))
    best = F.row_number().over(Window.partitionBy("namespace", "end").orderBy(F.desc("cosine"), "a", "b"))
    return ends.withColumn("_n", best).where(F.col("_n") <= most_partners).select("namespace", "a", "b", "cosine").distinct()


def _batch(columns: dict[str, list], *types: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns.values(), types)], list(columns))


def _forms(entities: DataFrame, rows: list[tuple]) -> DataFrame:
    """``(id, namespace, form)``: the telling parts of each name in the order of letters; names without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = Forms(rows)
        for batch in batches:
            found = [" ".join(sorted(parts(x, forms))) or None for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["id", "namespace", "form"])

    return entities.select("id", "namespace", "name").mapInArrow(run, "id bigint, namespace string, form string").where("form is not null")


def _vectors(forms_of: DataFrame, rows: list[tuple]) -> DataFrame:
    """``(namespace, id, feature)`` of rows (namespace, id, form)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = Forms(rows)
        for batch in batches:
            found = [features(tuple(x.split(" ")), forms) for x in batch.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([x for f in found for x in f], pa.string())], ["namespace", "id", "feature"])

    return forms_of.select("namespace", "id", "form").mapInArrow(run, "namespace string, id bigint, feature string")


def _checked(pairs: DataFrame, rows: list[tuple]) -> DataFrame:
    """``(a, b, similarity)`` of the pairs (a, b, cosine, form_a, form_b) the part-by-part check lets stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = Forms(rows)
        for batch in batches:
            keep = [i for i, (x, y) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())) if likeness(tuple(x.split(" ")), tuple(y.split(" ")), forms) > 0]
            at = pa.array(keep, pa.int64())
            root = np.sqrt(batch.column(2).to_numpy())[keep] if keep else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.rint(root * UNIT).astype(np.int64))], ["a", "b", "similarity"])

    return pairs.select("a", "b", "cosine", "form_a", "form_b").mapInArrow(run, "a bigint, b bigint, similarity bigint")


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of every end of an edge: least id reachable, by neighbours' minima and pointer jumps until nothing moves."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")), "edges")
    state = both.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id"))
    state = materialize(state, "components")
    while True:
        near = both.join(state.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = state.join(near, state["id"] == near["a"]).select("id", F.least("component", "near").alias("component"), (F.col("near") < F.col("component")).alias("moved"))
        root = step.select(F.col("id").alias("component"), F.col("component").alias("root"))
        new = materialize(step.join(root, "component").select("id", F.least("component", "root").alias("component"), "moved"), "components")
        state = new.select("id", "component")
        if new.where("moved").isEmpty():
            return state


def link_sets(edges: DataFrame) -> DataFrame:
    """``(id, cluster)``: ``link`` of each connected set of ``edges`` (component, a, b, similarity, mass_a, mass_b) in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: dict[str, list] = {"id": [], "cluster": []}

        def flush() -> None:
            mass = {e[1]: e[4] for e in held} | {e[2]: e[5] for e in held}
            for x, c in link([e[1:4] for e in held], mass).items():
                out["id"].append(x)
                out["cluster"].append(c)
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != held[0][0]:
                    flush()
                held.append(row)
            if len(out["id"]) > 10_000:
                yield _batch(out, pa.int64(), pa.int64())
                out = {"id": [], "cluster": []}
        flush()
        yield _batch(out, pa.int64(), pa.int64())

    # few bytes but much work a row: as many tasks as there are, not as few as the bytes would fill
    tasks = max(2, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = edges.select("component", "a", "b", "similarity", "mass_a", "mass_b").repartition(tasks, "component").sortWithinPartitions("component")
    return rows.mapInArrow(run, "id bigint, cluster bigint")


def link_in_rounds(edges: DataFrame, least: float = LINKAGE) -> DataFrame:
    """``(id, cluster)`` of the same linkage over the cluster: each round joins all pairs of clusters that are each other's best.

    No task holds more than the links of one cluster's combined row; equal to ``link`` of each connected set.
    """
    ends = edges.select(F.col("a").alias("id"), F.col("mass_a").alias("mass")).union(edges.select("b", "mass_b")).distinct()
    label = materialize(ends.select("id", F.col("id").alias("cluster"), "mass"), "labels")
    links = materialize(edges.select("a", "b", (F.col("similarity") * F.col("mass_a") * F.col("mass_b")).alias("total")), "links")
    while True:
        size = label.groupBy("cluster").agg(F.sum("mass").alias("size"))
        a, b = size.select(F.col("cluster").alias("a"), F.col("size").alias("size_a")), size.select(F.col("cluster").alias("b"), F.col("size").alias("size_b"))
        mean = F.col("total").cast("double") / (F.col("size_a") * F.col("size_b"))
        means = links.join(a, "a").join(b, "b").select("a", "b", mean.alias("mean")).where(F.col("mean") >= least * UNIT)
        order = F.struct(-F.col("mean"), "a", "b")
        ways = means.select(F.explode(F.array("a", "b")).alias("end"), "a", "b", order.alias("order"))
        best = ways.groupBy("end").agg(F.min_by(F.struct("a", "b"), "order").alias("pair"))
        joined = materialize(best.groupBy("pair").count().where("count = 2").select("pair.a", "pair.b"), "joined")
        if joined.isEmpty():
            return label.select("id", "cluster")
        to = joined.select(F.col("b").alias("old"), F.col("a").alias("new"))
        label = materialize(label.join(to, label["cluster"] == to["old"], "left").select("id", F.coalesce("new", "cluster").alias("cluster"), "mass"), "labels")
        moved = links.join(to.select(F.col("old").alias("a"), F.col("new").alias("_a")), "a", "left").join(to.select(F.col("old").alias("b"), F.col("new").alias("_b")), "b", "left")
        x, y = F.coalesce("_a", "a"), F.coalesce("_b", "b")
        again = moved.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "total").where("a < b").groupBy("a", "b").agg(F.sum("total").alias("total"))
        links = materialize(again, "links")


def linked_names(entities: DataFrame, name_forms: list[tuple]) -> DataFrame:
    """``(id, namespace, cluster)`` of the entities that share their meaning with another; cluster is the least id.

    ``name_forms``: (kind, full, short) rows, a reference list of fixed size. Names of one form are one row of the
    join, so a name borne by a third of all entities costs one vector.
    """
    e = entities.select("id", "namespace", "name").where(F.col("name").isNotNull() & F.col("namespace").isNotNull() & F.col("id").isNotNull()).dropDuplicates(["id"])
    rows = list(name_forms)
    tasks = max(2, int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    e = materialize(_forms(e.repartition(tasks), rows), "names")
    form = materialize(e.groupBy("namespace", "form").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("mass")), "forms")
    pairs = cosine_pairs(materialize(_vectors(form.repartition(tasks), rows), "name-vectors"))
    a = form.select("namespace", F.col("id").alias("a"), F.col("form").alias("form_a"))
    b = form.select("namespace", F.col("id").alias("b"), F.col("form").alias("form_b"))
    full = pairs.join(a, ["namespace", "a"]).join(b, ["namespace", "b"])
    edges = materialize(_checked(full.repartition(tasks), rows), "name-links")
    member = components(edges)
    mass = form.select("id", "mass")
    placed = edges.join(member.withColumnRenamed("id", "a"), "a").join(mass.select(F.col("id").alias("a"), F.col("mass").alias("mass_a")), "a").join(mass.select(F.col("id").alias("b"), F.col("mass").alias("mass_b")), "b")
    placed = materialize(placed, "placed-links")
    large = materialize(placed.groupBy("component").count().where(F.col("count") > LINKS_AT_ONCE).select("component"), "large-sets")
    linked = link_sets(placed.join(large, "component", "left_anti"))
    if not large.isEmpty():
        linked = linked.union(link_in_rounds(placed.join(large, "component", "left_semi")))
    labelled = form.join(linked, "id", "left").select("namespace", "form", F.coalesce("cluster", "id").alias("cluster"), "mass")
    total = labelled.groupBy("cluster").agg(F.sum("mass").alias("n")).where("n > 1").select("cluster")
    kept = labelled.join(total, "cluster", "left_semi").select("namespace", "form", "cluster")
    return e.join(kept, ["namespace", "form"]).select("id", "namespace", "cluster")


def name_pairs(linked: DataFrame) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b: all pairs of each cluster."""
    a, b = linked.select("cluster", F.col("id").alias("id_a")), linked.select("cluster", F.col("id").alias("id_b"))
    return a.join(b, "cluster").where("id_a < id_b").select("id_a", "id_b")
