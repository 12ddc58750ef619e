"""Cutting oversized texts into overlapping pieces at natural boundaries.

Balanced targets: from the size, the limit and the overlap follows the minimum number of pieces; targets are
placed at equal distances and each is snapped to the strongest boundary near it (paragraph, line, sentence end,
clause, white space); if a piece can't be kept under the limit, a piece is added and the targets are placed
anew. Where a long stretch leaves no boundary within reach, the overlap before it is shortened, to nothing if need
be; only a stretch over the limit is cut between two characters, and only its record is called forced. All sizes
are bytes of UTF-8.

Defined cases: a null body gives no piece and is never oversized; a body of at most the limit is one piece; a
body of any length is cut whole; repeated rows of the same id give one set of pieces.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.runtime import spread

LIMIT, OVERLAP = 800, 100
SENTENCE_MARKS = "。！？"  # fixed value: sentence ends that no white space follows
#: Boundaries by strength: the end of each match is a place to cut.
BOUNDARIES = [
    (5, regex.compile(r"(?:\r?\n[ \t]*){2,}| ")),
    (4, regex.compile(r"\r?\n|\r| ")),
    (3, regex.compile(r"[.!?…][\"'”’»)\]]*\s+|[" + SENTENCE_MARKS + r"][」』）]*\s*")),
    (2, regex.compile(r"[,;:]\s+")),
    (1, regex.compile(r"\s+|[" + SENTENCE_MARKS + "]")),
]
#: Both sides of each of these end a stretch; the near side is a place to cut only where nothing better is in reach.
SEPARATOR = regex.compile(r"[\s" + SENTENCE_MARKS + "]")


def boundaries(text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the text may be cut, ascending, and their strengths. ``starts``: byte offset of each character."""
    best: dict[int, int] = {}
    for strength, pattern in reversed(BOUNDARIES):
        for m in pattern.finditer(text):
            best[int(starts[m.end()])] = strength
    for m in SEPARATOR.finditer(text):
        for at in m.span():
            best.setdefault(int(starts[at]), 0)
    best.pop(0, None)
    best.pop(int(starts[-1]), None)
    places = np.array(sorted(best), np.int64)
    return places, np.array([best[int(p)] for p in places], np.int64)


def byte_starts(text: str) -> np.ndarray:
    """Byte offset of each character and, last, the size."""
    if text.isascii():
        return np.arange(len(text) + 1)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])


def longest_stretch(text: str, starts: np.ndarray) -> int:
    """Bytes of the longest stretch without white space and without any of ``SENTENCE_MARKS``."""
    longest = last = 0
    for m in regex.finditer(r"[\s" + SENTENCE_MARKS + "]+", text):
        longest = max(longest, int(starts[m.start()]) - last)
        last = int(starts[m.end()])
    return max(longest, int(starts[-1]) - last)


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, bool]], np.ndarray]:
    """``(begin, end, forced)`` of each piece in bytes, and the byte offset of each character.

    ``forced`` tells that the piece ends at no boundary. A piece begins ``overlap`` bytes before the end of the
    one before, or at a boundary near that place.
    """
    starts = byte_starts(text)
    size = int(starts[-1])
    if size <= limit:
        return [(0, size, False)], starts
    places, strength = boundaries(text, starts)

    def snap(low: int, high: int, target: int) -> tuple[int, bool]:
        """The best cut in ``(low, high]``: strength against distance from the target."""
        a, b = np.searchsorted(places, [low, high], "right")
        if a < b:
            score = strength[a:b] * (limit * 0.06) - np.abs(places[a:b] - target)
            return int(places[a + int(np.argmax(score))]), False
        if high == size:
            return size, False
        at = int(starts[np.searchsorted(starts, min(high, max(target, low + 1)), "right") - 1])
        return (at if at > low else int(starts[np.searchsorted(starts, low, "right")])), True

    def back(end: int, floor: int) -> int:
        """Where the piece after a cut at ``end`` begins."""
        want = end - overlap
        a, b = np.searchsorted(places, [max(floor, want - overlap // 2), min(end - 1, want + overlap // 2)], "left")
        if a < b:
            return int(places[a + int(np.argmin(np.abs(places[a:b] - want)))])
        return int(starts[np.searchsorted(starts, max(want, floor), "left")])

    def reach(begin: int, end: int) -> int:
        """The same begin, or the earliest from which the piece reaches a boundary beyond ``end``."""
        k = int(np.searchsorted(places, end, "right"))
        further = int(places[k]) if k < len(places) else size
        if further <= begin + limit or further > end + limit:
            return begin
        return int(starts[np.searchsorted(starts, further - limit, "left")])

    n = max(2, -(-(size - overlap) // (limit - overlap)))
    while True:
        pieces, begin, end, bad = [], 0, 0, False
        for k in range(n):
            left = n - k
            if left == 1:
                bad = size - begin > limit
                pieces.append((begin, size, False))
                break
            begin = reach(begin, end)
            step = (size - end) / left
            low, high = max(end, begin + overlap), min(begin + limit, size)
            if np.searchsorted(places, low, "right") == np.searchsorted(places, high, "right"):
                low = end  # nothing but boundaries close behind the last cut
            at, forced = snap(low, high, int(end + step))
            pieces.append((begin, at, forced))
            end, begin = at, back(at, begin + 1)
            if at >= size:
                break
        if not bad:
            return pieces, starts
        n += 1


def split_texts(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(key, piece, begin, end, cut, text)`` of each row over the limit, one row a piece; begin and end in bytes.

    ``cut`` is of the whole record: 'forced' if a piece of it ends at no boundary, else 'natural'. A map over the scan; rows that fit are dropped in the JVM before Python sees them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[] for _ in range(6)]
                for k, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    pieces, starts = cut(body, limit, overlap)
                    kind = "forced" if any(forced for _, _, forced in pieces) else "natural"
                    for i, (begin, end, _) in enumerate(pieces):
                        a, b = np.searchsorted(starts, [begin, end])
                        for column, value in zip(out, (k, i, begin, end, kind, body[a:b])):
                            column.append(value)
                kinds = [part.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], [key, "piece", "begin", "end", "cut", "text"])

    kind = df.schema[key].dataType.simpleString()
    long = df.select(F.col(key), F.col(text)).where(F.octet_length(F.col(text)) > limit)
    return spread(long).mapInArrow(run, f"`{key}` {kind}, piece int, begin bigint, end bigint, cut string, text string")


def cut_kinds(pieces: DataFrame, key: str) -> DataFrame:
    """``(key, cut)`` of each record that was split: read off its first piece, once for repeated records."""
    return pieces.where(F.col("piece") == 0).select(key, "cut").distinct()
