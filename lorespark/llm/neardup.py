"""Texts that share most of their word runs, by a chosen-path set similarity join.

Every text becomes the set of its runs of consecutive words, and the set a vector of minwise tokens. A tree
hands each text down by the tokens it chooses: at a node a few coordinates are drawn and a text goes to the
child named by its token at each. Two sets of similarity s agree at a coordinate with probability s, so alike
texts meet again and again while others part. Small nodes are compared exhaustively (on the whole vectors);
large nodes branch on. Several independent trees reach the target recall; the pairs that look alike are then
verified on the exact sets.

Texts of equal words are one class with one representative, so copies - however many - enter the trees once;
nodes too large for one task are branched again before any task gathers them, and one that no branching makes
small - thousands of texts alike in nearly every run - is compared in blocks, each pair of blocks in a task.

Defined cases: null texts and texts with fewer than ``least_words`` words have no partner; texts equal byte for
byte are no pair; repeated records are one record; texts are read whole.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.runtime import materialize, spread

COORDINATES = 64  # minwise tokens of a text
TREES = 8
LEAF = 48  # nodes up to this size are compared exhaustively
NODE_MOST = 20_000  # larger nodes branch again before a task gathers them
DEPTH_MOST = 12
PAIRS_AT_ONCE = 1_000_000
WORD = regex.compile(r"[\p{L}\p{N}]+")
_rng = np.random.default_rng(20_240_117)
_MULTIPLY = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def words(text: str) -> list[str]:
    """The maximal runs of letters and digits, in lower case."""
    return WORD.findall(text.lower())


def runs(tokens: list[str], width: int) -> np.ndarray:
    """64-bit hashes of the distinct runs of ``width`` consecutive words."""
    h = xxhash.xxh3_64_intdigest
    one = np.fromiter((h(t.encode()) for t in tokens), np.uint64, len(tokens))
    if len(one) < width:
        return np.zeros(0, np.uint64)
    mixed = np.zeros(len(one) - width + 1, np.uint64)
    for k in range(width):
        mixed = (mixed ^ one[k : len(one) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(elements: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set, 32 bits each."""
    best = np.empty(COORDINATES, np.uint64)
    for a in range(0, COORDINATES, 16):
        best[a : a + 16] = (elements[None, :] * _MULTIPLY[a : a + 16, None] + _ADD[a : a + 16, None]).min(axis=1)
    return (best >> np.uint64(16)).astype(np.uint32)


def signed(df: DataFrame, key: str, text: str, width: int, least_words: int) -> DataFrame:
    """``(key, words_hash, text_hash, roots, tokens)`` of the texts long enough.

    roots: 32-bit minwise tokens at the coordinates the trees begin with; tokens: one byte of each coordinate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, same, exact, roots, tokens = [], [], [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    w = words(t)
                    if len(w) >= least_words:
                        s = signature(runs(w, width))
                        rows.append(i)
                        same.append(xxhash.xxh3_64_intdigest(" ".join(w).encode()) - (1 << 63))
                        exact.append(xxhash.xxh3_64_intdigest(t.encode()) - (1 << 63))
                        roots.append(s[:TREES].astype(np.int64))
                        tokens.append((s & 0xFF).astype(np.uint8).tobytes())
                flat = np.concatenate(roots) if roots else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows, pa.int64())),
                        pa.array(same, pa.int64()),
                        pa.array(exact, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, TREES), pa.int32()), flat),
                        pa.array(tokens, pa.binary()),
                    ],
                    [key, "words_hash", "text_hash", "roots", "tokens"],
                )

    kind = df.schema[key].dataType.simpleString()
    # a text of n words has at least 2n-1 characters, so short ones never reach Python
    long = df.select(key, text).where(F.length(text) >= 2 * least_words - 1)
    return spread(long).mapInArrow(run, f"`{key}` {kind}, words_hash bigint, text_hash bigint, roots array<bigint>, tokens binary")


def _drawn(node: np.ndarray, share: float, draw: int) -> np.ndarray:
    """The coordinate a node draws, by hashing its name: the same for all its members in any task."""
    mixed = (node.astype(np.uint64) ^ np.uint64(draw * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    coordinate = (mixed % np.uint64(COORDINATES)).astype(np.int64)
    if draw and share < 1:  # the last draw is made by a share of the nodes only
        coordinate[(mixed >> np.uint64(40)).astype(np.float64) / float(1 << 24) >= share] = -1
    return coordinate


def branch(node: np.ndarray, row: np.ndarray, tokens: np.ndarray, similarity: float, breadth: float = 1.3) -> tuple[np.ndarray, np.ndarray]:
    """The children ``(node, row)`` of members of nodes: on average breadth/similarity draws a node.

    A pair of that similarity so has ``breadth`` common children in the mean; over 1, its line goes on for good
    with a fixed chance, however deep the tree.
    """
    want = breadth / similarity
    children, members = [], []
    for draw in range(int(np.ceil(want))):
        share = 1.0 if draw + 1 <= want else want - int(want)
        c = _drawn(node, share, draw)
        ok = c >= 0
        token = tokens[row[ok], c[ok]].astype(np.uint64)
        child = (node[ok].astype(np.uint64) + np.uint64(1 + draw)) * np.uint64(0xC2B2AE3D27D4EB4F) ^ (token << np.uint64(7) | c[ok].astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
        child ^= child >> np.uint64(31)
        children.append(child.astype(np.int64))
        members.append(row[ok])
    return np.concatenate(children), np.concatenate(members)


def _likeness_to_node(vectors: np.ndarray) -> np.ndarray:
    """Mean share of coordinates at which each vector agrees with the vectors of its node."""
    total = np.zeros(len(vectors))
    for c in range(vectors.shape[1]):
        total += np.bincount(vectors[:, c], minlength=256)[vectors[:, c]]
    return total / (len(vectors) * vectors.shape[1])


def compare_nodes(node: np.ndarray, row: np.ndarray, tokens: np.ndarray, similarity: float, looks: float) -> Iterator[np.ndarray]:
    """Pairs of rows ``(a, b)``, a < b, that share a leaf and whose vectors agree on ``looks`` of the coordinates.

    They come in parts of bounded size; a pair may come in several parts.

    Nodes up to ``LEAF`` are compared at once, all nodes together, shift by shift. In a larger node the members
    that are alike to the node as a whole are compared with all of it and leave it, since no branching would
    part them; the others branch.
    """
    found: list[np.ndarray] = []
    least = looks * tokens.shape[1]

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        for k in range(0, len(a), 200_000):
            x, y = a[k : k + 200_000], b[k : k + 200_000]
            ok = (x != y) & ((tokens[x] == tokens[y]).sum(axis=1) >= least)
            if ok.any():
                x, y = x[ok], y[ok]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))

    def part() -> np.ndarray:
        out = np.unique(np.concatenate(found), axis=0)
        found.clear()
        return out

    for depth in range(DEPTH_MOST + 1):
        if not len(node):
            break
        order = np.lexsort((row, node))
        node, row = node[order], row[order]
        first = np.concatenate([[True], node[1:] != node[:-1]])
        size = np.diff(np.concatenate([np.flatnonzero(first), [len(node)]]))
        sizes = np.repeat(size, size)
        small = (sizes <= LEAF) | (depth == DEPTH_MOST)
        here = small & (sizes > 1)
        n, r = node[here], row[here]
        shift, active = 1, np.arange(len(n))
        while len(active):
            active = active[active + shift < len(n)]
            active = active[n[active] == n[active + shift]]
            keep(r[active], r[active + shift])
            shift += 1
            if sum(map(len, found)) > PAIRS_AT_ONCE:
                yield part()
        node, row = node[~small], row[~small]
        if len(node):
            ends = np.concatenate([np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])), [len(node)]])
            stay = np.ones(len(node), bool)
            for a, b in zip(ends, ends[1:]):
                members = row[a:b]
                close = np.flatnonzero(_likeness_to_node(tokens[members]) >= 0.75 * looks)
                stay[a + close] = False
                for m in close:
                    keep(np.full(b - a, members[m]), members)
                    if len(found) > 1000 or found and len(found) * (b - a) > PAIRS_AT_ONCE:
                        yield part()
            node, row = branch(node[stay], row[stay], tokens, similarity)
    if found:
        yield part()


def in_blocks(members: DataFrame, block: int | None = None) -> DataFrame:
    """``(node, class, tokens)``: each node cut into blocks, and each pair of its blocks a node of its own.

    Two members meet in exactly one of the new nodes if their blocks differ, and in one for each other block if not.
    """
    size = members.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / F.lit((block or NODE_MOST) // 2)).cast("int").alias("blocks"))
    placed = members.join(size, "node").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = placed.select("node", "class", "tokens", "own", other).where("own <> other or blocks = 1")
    return pairs.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "class", "tokens")


def candidate_pairs(classes: DataFrame, similarity: float, looks: float) -> DataFrame:
    """``(class_a, class_b)``, class_a < class_b: pairs of classes that met in a leaf and look alike.

    ``classes``: (class bigint, roots, tokens). Rows of one top node go to one task, unless the node is too
    large: then its members are handed to its children first, again and again, each child to a task of its own.
    """
    roots = F.posexplode("roots").alias("tree", "token")
    top = classes.select("class", "tokens", roots).select(F.xxhash64("tree", "token").alias("node"), "class", "tokens")
    sizes = top.groupBy("node").count()
    large = materialize(sizes.where(F.col("count") > NODE_MOST).select("node"), "large-nodes")
    done: list[DataFrame] = []
    level = top
    for _ in range(DEPTH_MOST):
        if large.isEmpty():
            break
        done.append(level.join(large, "node", "left_anti"))
        inside = level.join(large, "node", "left_semi")

        def hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    vectors = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, COORDINATES)
                    child, member = branch(batch.column(0).to_numpy(), np.arange(batch.num_rows), vectors, similarity, 1.7)
                    at = pa.array(member, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(child, pa.int64()), batch.column(1).take(at), batch.column(2).take(at)], ["node", "class", "tokens"])

        level = materialize(inside.select("node", "class", "tokens").mapInArrow(hand_down, "node bigint, class bigint, tokens binary"), "nodes")
        large = materialize(level.groupBy("node").count().where(F.col("count") > NODE_MOST).select("node"), "large-nodes")
    else:
        done.append(level.join(large, "node", "left_anti"))
        level = in_blocks(level.join(large, "node", "left_semi"))
    done.append(level)
    spread = done[0]
    for more in done[1:]:
        spread = spread.unionByName(more)
    parts = max(2, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Gathers up to a few million members at a time; a node never lies across two gatherings, being sorted."""
        held: list[pa.RecordBatch] = []
        rows = 0

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            t = pa.Table.from_batches(held)
            node = t.column(0).to_numpy()
            upto = len(node) if last else int(np.searchsorted(node, node[-1]))
            if upto:
                head = t.slice(0, upto)
                cls, at = np.unique(head.column(1).to_numpy(), return_inverse=True)
                vectors = np.empty((len(cls), COORDINATES), np.uint8)
                vectors[at] = np.frombuffer(b"".join(head.column(2).to_pylist()), np.uint8).reshape(-1, COORDINATES)
                for pairs in compare_nodes(node[:upto], at.reshape(-1), vectors, similarity, looks):
                    yield pa.RecordBatch.from_arrays([pa.array(cls[pairs[:, 0]], pa.int64()), pa.array(cls[pairs[:, 1]], pa.int64())], ["class_a", "class_b"])
            held = t.slice(upto).combine_chunks().to_batches()
            rows = len(node) - upto

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 200_000:
                yield from ready(False)
        if rows:
            yield from ready(True)

    met = spread.repartition(parts, "node").sortWithinPartitions("node").select("node", "class", "tokens").mapInArrow(leaves, "class_a bigint, class_b bigint")
    return met.distinct()


PAIRS_A_HUB = 2_000  # pairs of one text in one group


def verify(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs ``(class_a, class_b, similarity)`` whose exact sets are alike. ``texts``: (class, text).

    Each pair is led by its end of more partners, the hub. A hub's text goes once to each group of its pairs, and
    is made a set once there; only the other end's text travels with each pair.
    """
    degree = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    a, b = degree.select(F.col("class").alias("class_a"), F.col("n").alias("n_a")), degree.select(F.col("class").alias("class_b"), F.col("n").alias("n_b"))
    first = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("class_a") < F.col("class_b")))
    either = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    groups = F.ceil(F.greatest("n_a", "n_b") / F.lit(PAIRS_A_HUB)).cast("int")
    led = pairs.join(a, "class_a").join(b, "class_b").select(either("class_a", "class_b").alias("hub"), either("class_b", "class_a").alias("class"), groups.alias("groups"))
    led = materialize(led.withColumn("group", F.pmod(F.xxhash64("class"), F.col("groups")).cast("int")).select("hub", "group", "class"), "led-pairs")
    hubs = led.select("hub", "group").distinct().join(texts.withColumnRenamed("class", "hub"), "hub").select("hub", "group", F.lit(None).cast("bigint").alias("class"), "text")
    others = led.join(texts, "class").select("hub", "group", "class", "text")
    parts = max(2, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = hubs.unionByName(others).repartition(parts, "hub", "group").sortWithinPartitions("hub", "group", F.asc_nulls_first("class"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[tuple[int, int, float]] = []
                for hub, cls, text in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()):
                    made = runs(words(text), width)
                    if cls is None:
                        own = made
                        continue
                    both = len(np.intersect1d(own, made, assume_unique=True))
                    any_ = len(own) + len(made) - both
                    if any_ and both >= similarity * any_ - 1e-9:
                        out.append((min(hub, cls), max(hub, cls), both / any_))
                kinds = (pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["class_a", "class_b", "similarity"])

    return rows.mapInArrow(run, "class_a bigint, class_b bigint, similarity double")


class NearDuplicates:
    """The join over one table: classes of equal words, alike pairs of classes, and both spelled out for records."""

    def __init__(self, df: DataFrame, key: str, text: str, width: int = 5, similarity: float = 0.8, least_words: int = 1):
        self.key = key
        self.records = df.select(F.col(key).alias(key), F.col(text).alias("text"))
        source = self.records.where(F.col("text").isNotNull())
        rows = materialize(signed(source, key, "text", width, least_words), "signatures")
        #: (class, roots, tokens): the least key of each class stands for it
        classes = rows.groupBy("words_hash").agg(F.min(key).alias("class"), F.first("roots").alias("roots"), F.first("tokens").alias("tokens"))
        classes = materialize(classes, "classes")
        #: (key, class, text_hash): each record once
        self.members = rows.select(key, "words_hash", "text_hash").dropDuplicates([key]).join(classes.select("words_hash", "class"), "words_hash").select(key, "class", "text_hash")
        looks = max(0.2, similarity - 3.2 * (similarity * (1 - similarity) / COORDINATES) ** 0.5)
        met = materialize(candidate_pairs(classes.select("class", "roots", "tokens"), similarity, looks), "candidates")
        ids = met.select(F.col("class_a").alias("class")).union(met.select("class_b")).distinct()
        texts = materialize(source.select(F.col(key).alias("class"), "text").join(ids, "class", "left_semi").dropDuplicates(["class"]), "texts")
        #: (class_a, class_b, similarity)
        self.alike = materialize(verify(met, texts, width, similarity), "alike")

    def record_pairs(self) -> DataFrame:
        """``(id_a, id_b)``, id_a < id_b: all pairs of records that are alike and not equal byte for byte."""
        m = self.members
        # first the different texts of equal words are paired, then their records; equal texts never meet
        distinct = m.select("class", "text_hash").distinct()
        unequal = distinct.join(distinct.select("class", F.col("text_hash").alias("_b")), "class").where(F.col("text_hash") < F.col("_b")).select(F.col("text_hash").alias("_a"), "_b")
        of = lambda end, name: m.select(F.col("text_hash").alias(end), F.col(self.key).alias(name))
        paired = unequal.join(of("_a", "_x"), "_a").join(of("_b", "_y"), "_b")
        equal_words = paired.select(F.least("_x", "_y").alias("id_a"), F.greatest("_x", "_y").alias("id_b"))
        left = self.alike.join(m.select(F.col("class").alias("class_a"), F.col(self.key).alias("_x")), "class_a")
        both = left.join(m.select(F.col("class").alias("class_b"), F.col(self.key).alias("_y")), "class_b")
        return equal_words.union(both.select(F.least("_x", "_y").alias("id_a"), F.greatest("_x", "_y").alias("id_b")))

    def _classed(self) -> DataFrame:
        """``(key, class)`` of every record: of short and null texts the least key of equal texts, of null each its own."""
        text = F.when(F.col("text").isNull(), F.col(self.key).cast("bigint")).otherwise(F.xxhash64("text"))
        records = self.records.select(self.key, text.alias("_h"), F.col("text").isNull().alias("_null")).dropDuplicates([self.key])
        long = self.members.select(self.key, "class")
        rest = records.join(long, self.key, "left_anti")
        own = rest.groupBy("_h", "_null").agg(F.min(self.key).alias("class"))
        return long.unionByName(rest.join(own, ["_h", "_null"]).select(self.key, "class"))

    def links(self) -> DataFrame:
        """``(key, class, n_links)``: one row a record, of short and null texts too: its class and the classes linked to it."""
        ends = self.alike.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
        return self._classed().join(ends, "class", "left").select(self.key, "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))

    def groups(self) -> DataFrame:
        """``(key, group)``, one row a record: connected components over the links by neighbours' minima and pointer jumps, until nothing moves."""
        edges = materialize(self.alike.select(F.col("class_a").alias("u"), F.col("class_b").alias("v")).union(self.alike.select("class_b", "class_a")), "edges")
        state = materialize(edges.select("u").distinct().withColumn("group", F.col("u")), "labels")
        while True:
            low = edges.join(state.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("group").alias("near"))
            step = state.join(low, "u").select("u", F.least("group", "near").alias("group"), (F.col("near") < F.col("group")).alias("moved"))
            jumped = step.join(step.select(F.col("u").alias("group"), F.col("group").alias("far")), "group")
            new = materialize(jumped.select("u", F.least("group", "far").alias("group"), "moved"), "labels")
            state = new.select("u", "group")
            if new.where("moved").isEmpty():
                break
        return self._classed().join(state.withColumnRenamed("u", "class"), "class", "left").select(self.key, F.coalesce("group", "class").alias("group"))
