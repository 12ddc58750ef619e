"""Filling containers of fixed capacity with items, planned on the histogram of lengths.

Steps: (1) every item over the capacity is cut into full containers and one rest; (2) the lengths are counted,
which leaves at most ``capacity`` numbers however many items there are; (3) shallow combinations of lengths
that fill a window below the capacity are enumerated, and the repeat counts of the combinations are solved
against the histogram as a non-negative least squares problem; (4) the counts are rounded down and the
residual lengths are packed greedily, largest first, each into the fullest container that still takes it;
(5) every item gets its rank among the items of its length, and the plan maps ranges of ranks to containers.

Only the histogram and the plan, both bounded by the capacity and not by the data, are on the driver.

Defined cases: null and empty texts (size 0) are left out; a text of exactly the capacity fills one container;
repeated sizes are told apart by id; an empty table gives no rows; only an item over the capacity is cut.
"""

from __future__ import annotations

from collections import defaultdict
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.bpe import VOCABULARY, count_ids
from lorespark.runtime import materialize

CAPACITY = 2048
SALTS = 64


def combinations(lengths: np.ndarray, counts: np.ndarray, capacity: int, window: int, per_length: int = 6) -> list[tuple[int, ...]]:
    """Multisets of up to four present lengths with a sum in ``[capacity - window, capacity]``.

    For each length the partners are taken so that the sum comes as close to the capacity as the present
    lengths allow; the enumeration is shallow on purpose, because the residuals are packed afterwards.
    """
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    present = [int(x) for x in lengths]
    weight = dict(zip(present, (int(c) for c in counts)))
    out: set[tuple[int, ...]] = set()

    def close(rest: int, most: int) -> list[int]:
        """The largest present lengths not over ``rest``, within the window."""
        low = max(1, rest - window)
        got = np.flatnonzero(have[low : rest + 1]) + low
        return got[::-1][:most].tolist()

    common = sorted(present, key=lambda x: -weight[x])[:24]
    spread = [present[i] for i in np.unique(np.linspace(0, len(present) - 1, min(48, len(present))).astype(int))]
    for a in present:
        if capacity - window <= a:
            out.add((a,))
        if a * 2 <= capacity:
            times = capacity // a
            if times * a >= capacity - window and times <= 64:
                out.add((a,) * times)
        for b in close(capacity - a, per_length):
            out.add(tuple(sorted((a, b))))
        for b in dict.fromkeys([a, *common, *spread]):
            if a + b < capacity:
                for c in close(capacity - a - b, 1):
                    out.add(tuple(sorted((a, b, c))))
        for b in common[:8]:
            for c in spread[::6]:
                if a + b + c < capacity:
                    for d in close(capacity - a - b - c, 1):
                        out.add(tuple(sorted((a, b, c, d))))
    return sorted(out)


def solve_repeats(patterns: list[tuple[int, ...]], counts: np.ndarray, capacity: int, rounds: int = 400) -> np.ndarray:
    """Non-negative repeat counts of the patterns that meet the histogram in least squares.

    Projected coordinate-wise gradient: each step moves every repeat count along the negative gradient with
    the step size of its column, scaled for shared rows, and clips at zero.
    """
    rows = np.concatenate([np.asarray(p) for p in patterns])
    cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    hit = counts[rows] > 0
    assert hit.all()
    scale = 1.0 / np.maximum(counts, 1)  # relative misfit, so that rare lengths count too
    norm = np.bincount(cols, scale[rows], len(patterns))
    shared = np.bincount(rows, minlength=capacity + 1).astype(float)
    step = 1.0 / np.maximum(np.bincount(cols, scale[rows] * shared[rows], len(patterns)), 1e-12)
    x = np.zeros(len(patterns))
    y, speed = x, 1.0
    for _ in range(rounds):
        fitted = np.bincount(rows, y[cols], capacity + 1)
        gradient = np.bincount(cols, ((fitted - counts) * scale)[rows], len(patterns))
        new = np.maximum(0, y - step * gradient)
        faster = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
        y, x, speed = new + (speed - 1) / faster * (new - x), new, faster
    return x if norm.size else x


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, window: int = 8) -> pd.DataFrame:
    """Ranges of ranks of each length and the container of their first item.

    Columns: length, first_rank, n, container: the n items from ``first_rank`` on go one into each of the n
    containers from ``container`` on. Containers are numbered from 0 without gaps.
    """
    left = np.zeros(capacity + 1, np.int64)
    left[lengths] = counts
    used = np.zeros(capacity + 1, np.int64)
    out: list[tuple[int, int, int, int]] = []
    boxes = 0
    if len(lengths):
        patterns = combinations(np.asarray(lengths), np.asarray(counts), capacity, window)
        repeats = np.floor(solve_repeats(patterns, left.astype(float), capacity) + 1e-9).astype(np.int64) if patterns else np.zeros(0, np.int64)
        # the fullest and simplest first, so that clipping by what is left costs the poorer ones
        for p, want in sorted(zip(patterns, repeats), key=lambda x: (capacity - sum(x[0]), len(x[0]))):
            need = defaultdict(int)
            for length in p:
                need[length] += 1
            times = min([int(want), *(int(left[length]) // k for length, k in need.items())])
            if times > 0:
                for length in p:
                    out.append((length, int(used[length]), times, boxes))
                    used[length] += times
                    left[length] -= times
                boxes += times
    # residuals: greedy over lengths; equal containers are handled as runs, so the cost follows the lengths
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs (first container, n)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fit = min((r for r in room if r >= length), default=None)
            if fit is None:
                each = max(1, min(capacity // length, n))
                full, n = divmod(n, each)
                for k in range(each):
                    out.append((length, int(used[length]), full, boxes))
                    used[length] += full
                if capacity - each * length:
                    room[capacity - each * length].append((boxes, full))
                boxes += full
                continue
            first, many = room[fit].pop()
            if not room[fit]:
                del room[fit]
            take = min(many, n)
            if take < many:
                room[fit].append((first + take, many - take))
            out.append((length, int(used[length]), take, first))
            used[length] += take
            n -= take
            if fit - length:
                room[fit - length].append((first, take))
    return pd.DataFrame(out, columns=["length", "first_rank", "n", "container"]).astype("int64")


def pieces(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """``(key, piece, begin, length)``: one row for an item that fits, several for one over the capacity."""
    n = F.floor((F.col(size) + F.lit(capacity - 1)) / F.lit(capacity))
    cut = sizes.where(F.col(size) > 0).select(F.col(key), F.col(size).cast("bigint").alias("_size"), F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).alias("piece"))
    begin = F.col("piece") * F.lit(capacity).cast("bigint")
    return cut.select(key, "piece", begin.alias("begin"), F.least(F.lit(capacity).cast("bigint"), F.col("_size") - begin).alias("length"))


def pack(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """``(container, key, piece, begin, length)``: the container of every item or, over the capacity, of every piece.

    Ranks within a length are made per (length, salt), so that a length with a third of all items is spread
    over tasks; the counts per salt, at most ``capacity * SALTS`` rows, give the offsets.
    """
    items = materialize(pieces(sizes, key, size, capacity).withColumn("_salt", F.pmod(F.xxhash64(key, "piece"), F.lit(SALTS)).cast("int")), "packing-items")
    per_salt = items.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")).toPandas()  # bounded by capacity * SALTS
    per_salt = per_salt.sort_values(["length", "_salt"], ignore_index=True)
    per_salt["_offset"] = per_salt.groupby("length")["_n"].cumsum() - per_salt["_n"] if len(per_salt) else 0
    histogram = per_salt.groupby("length")["_n"].sum()
    todo = plan(histogram.index.to_numpy(np.int64), histogram.to_numpy(np.int64), capacity).sort_values(["length", "first_rank"], ignore_index=True)
    todo = todo[todo["n"] > 0]
    starts = (todo["length"].to_numpy(np.int64) << 44) | todo["first_rank"].to_numpy(np.int64)
    first_rank, container = todo["first_rank"].to_numpy(np.int64), todo["container"].to_numpy(np.int64)
    offsets = np.zeros((capacity + 1, SALTS), np.int64)
    offsets[per_salt["length"].to_numpy(np.int64), per_salt["_salt"].to_numpy(np.int64)] = per_salt["_offset"].to_numpy(np.int64)
    spark = sizes.sparkSession
    shared = spark.sparkContext.broadcast((starts, first_rank, container, offsets))  # bounded by the capacity

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, first_rank, container, offsets = shared.value
        for frame in frames:
            length = frame["length"].to_numpy(np.int64)
            rank = frame["_rank"].to_numpy(np.int64) + offsets[length, frame["_salt"].to_numpy(np.int64)]
            row = np.searchsorted(starts, (length << 44) | rank, "right") - 1
            frame["container"] = container[row] + rank - first_rank[row]
            yield frame[["container", key, "piece", "begin", "length"]]

    ranked = items.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(key, "piece")) - 1)
    kind = sizes.schema[key].dataType.simpleString()
    return ranked.select(key, "piece", "begin", "length", "_salt", F.col("_rank").cast("bigint").alias("_rank")).mapInPandas(place, f"container bigint, `{key}` {kind}, piece bigint, begin bigint, length bigint")


def pack_texts(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """``pack`` of the rows of ``df`` sized by their token counts."""
    return pack(count_ids(df, key, text, path), key, "n_tokens", capacity)
