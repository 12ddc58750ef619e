"""Cutting bodies into chunks: by characters, by word windows, by Markdown structure, by sections.

Offsets are bytes of UTF-8. Null bodies give no rows, empty bodies one empty chunk (none for Markdown).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions import vocabulary as v

SIZE = v.CHUNK_TOKENS * v.CHARS_PER_TOKEN
OVERLAP = v.CHUNK_OVERLAP_TOKENS * v.CHARS_PER_TOKEN
HEADER = re.compile(rb"^ *#{1,6}(?:[ \t\n]|$)")
BREAKS = (b"\n\n", b". ", b" ")


def _aligned(raw: bytes, at: int, step: int) -> int:
    """The nearest character start from ``at`` on, going by ``step``."""
    at = max(0, min(at, len(raw)))
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += step
    return at


def heuristic_spans(body: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of at most ``size`` bytes that end after a paragraph, else a sentence, else a blank.

    A break within the overlap would end a span where the one before ended, so it doesn't count.
    """
    raw = body.encode()
    total = len(raw)
    if total <= size:
        return [(0, total)]
    spans, begin, before = [], 0, 0
    while begin < total:
        end = limit = _aligned(raw, begin + size, -1)
        if limit < total:
            for mark in BREAKS:
                found = raw.rfind(mark, begin, limit)
                if found >= 0 and found + len(mark) > before:
                    end = found + len(mark)
                    break
        if end <= begin:
            end = limit if limit > begin else total
        spans.append((begin, end))
        before = end
        if end >= total:
            break
        again = _aligned(raw, max(0, end - overlap), 1)
        begin = again if begin < again < end else end
    return spans


def markdown_spans(body: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of at most ``size`` characters along headings, paragraphs, lines, sentences and words.

    Semantic units are packed greedily; a unit too long is divided by the next weaker boundary. The overlap is
    made of whole trailing units of the span before.
    """
    if not body.strip():
        return []
    levels = [r"(?m)(?=^ {0,3}#{1,6}\s)", r"(?<=\n\n)", r"(?<=\n)", r"(?<=[.!?])\s+", r"(?<=\s)", r""]

    def units(text: str, level: int) -> list[str]:
        if len(text) <= size or level >= len(levels):
            return [text] if len(text) <= size else [text[k : k + size] for k in range(0, len(text), size)]
        found, at = [], 0
        for m in re.finditer(levels[level], text) if levels[level] else ():
            if m.end() > at:
                found.append(text[at : m.end()])
                at = m.end()
        found.append(text[at:])
        return [u for piece in found if piece for u in ([piece] if len(piece) <= size else units(piece, level + 1))]

    pieces = units(body, 0)
    spans, first, at, length = [], 0, 0, 0
    starts = [0]
    for p in pieces:
        starts.append(starts[-1] + len(p))
    while at < len(pieces):
        if length and length + len(pieces[at]) > size:
            spans.append((first, at))
            back, kept = at, 0
            while back > first + 1 and kept + len(pieces[back - 1]) <= overlap and kept + len(pieces[back - 1]) + len(pieces[at]) <= size:
                back -= 1
                kept += len(pieces[back])
            first, length = back, kept
        length += len(pieces[at])
        at += 1
    spans.append((first, at))
    offset = [0]
    for p in pieces:
        offset.append(offset[-1] + len(p.encode()))
    return [(offset[a], offset[b]) for a, b in spans]


def section_spans(body: str, most: int = v.PARTITION_BYTES) -> list[tuple[int, int]]:
    """Lossless partitions of at most ``most`` bytes: whole sections packed greedily, an oversized one sliced."""
    raw = body.encode()
    if len(raw) <= most:
        return [(0, len(raw))]
    starts, at = [0], 0
    for line in raw.splitlines(keepends=True):
        if at and HEADER.match(line):
            starts.append(at)
        at += len(line)
    starts.append(len(raw))
    packed, begin = [], 0
    for a, b in zip(starts, starts[1:]):
        if a > begin and b - begin > most:
            packed.append((begin, a))
            begin = a
    packed.append((begin, len(raw)))
    out = []
    for a, b in packed:
        while b - a > most:
            end = _aligned(raw, a + most, -1)
            out.append((a, end))
            a = end
        if a < b:
            out.append((a, b))
    return out


def _spans(df: DataFrame, key: str, text: str, cut: Callable[[str], list[tuple[int, int]]]) -> DataFrame:
    """``(key, chunk_idx, start_offset, end_offset, chunk_text, token_count)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[] for _ in range(6)]
                for k, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    raw = body.encode()
                    for i, (a, b) in enumerate(cut(body)):
                        chunk = raw[a:b].decode()
                        for column, value in zip(out, (k, i, a, b, chunk, len(chunk) // v.CHARS_PER_TOKEN)):
                            column.append(value)
                kinds = [part.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], [key, "chunk_idx", "start_offset", "end_offset", "chunk_text", "token_count"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, f"`{key}` {kind}, chunk_idx int, start_offset bigint, end_offset bigint, chunk_text string, token_count bigint")


def chunk_heuristic(df: DataFrame, key: str, text: str) -> DataFrame:
    return _spans(df, key, text, heuristic_spans)


def chunk_markdown(df: DataFrame, key: str, text: str) -> DataFrame:
    return _spans(df, key, text, markdown_spans)


def split_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    return _spans(df, key, text, section_spans)


def chunk_token_windows(df: DataFrame, key: str, text: str, size: int = v.CHUNK_TOKENS, overlap: int = v.CHUNK_OVERLAP_TOKENS) -> DataFrame:
    """``(key, chunk_idx, first_token, n_tokens, chunk_text)``: windows over white-space words, in the JVM alone."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    listed = df.where(F.col(text).isNotNull()).select(key, words.alias("_w"))
    windows = F.greatest(F.lit(1), F.ceil((F.size("_w") - overlap) / (size - overlap))).cast("int")
    placed = listed.select(key, "_w", F.explode(F.sequence(F.lit(0), windows - 1)).alias("chunk_idx"))
    first = F.col("chunk_idx") * (size - overlap)
    taken = F.slice("_w", first + 1, F.lit(size))
    return placed.select(key, "chunk_idx", first.alias("first_token"), F.size(taken).alias("n_tokens"), F.array_join(taken, " ").alias("chunk_text"))


def body_budget(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, bytes, approx_tokens, chunk_count, partition_count, exceeds_limits)`` of each body."""

    def count(body: str) -> tuple[int, int, int, int]:
        raw = len(body.encode())
        step = SIZE - OVERLAP
        return raw, (len(body.split()) * 3 + 1) // 2, 1 if raw <= SIZE else -(-(raw - OVERLAP) // step), len(section_spans(body))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [count(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "bytes", "approx_tokens", "chunk_count", "partition_count"])

    kind = df.schema[key].dataType.simpleString()
    counted = df.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, f"`{key}` {kind}, bytes bigint, approx_tokens bigint, chunk_count bigint, partition_count bigint")
    return counted.withColumn("exceeds_limits", F.col("partition_count") > 1)
