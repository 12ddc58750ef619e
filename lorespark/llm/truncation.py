"""Texts that were cut off, found by self-joins on prefixes.

Whole texts: all distinct texts are sorted over the cluster; the extensions of a text follow it at once, so one
pass that carries the texts still open finds every strict prefix of any longer copy, without pairing anything.
What is open at the end of a range goes on into the next ones by a join on prefixes of its length. A text is cut
off if a longer copy goes on inside the same word or sentence; of a text of a few characters, inside the word.

Last fragments: what stands after the last sentence end of a text is joined by its fixed-length prefixes with
the openings of all sentences of the corpus. If such an opening belongs, elsewhere, to sentences that come to
their end, the fragment is a sentence without its end; if it is never finished (a signature, a list item, a
headline, a note in passing), the writer meant it to end there. Openings are counted over distinct texts, with
or without a mark of omission, so that copies of a text bear no witness for or against one another. Only a text
of a few characters counts once a record: such a note, `TODO` say, is written anew each time, not copied.

A text that ends inside a fenced block of code is cut off by its own form, without a join.

Defined cases: null, empty and blank texts are never cut off; a mark of omission or a short remark in brackets at
the end is read as standing for the lost rest; repeated records give one row; texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import Iterator

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.runtime import materialize, spread

#: Lengths of the prefixes by which fragments and openings are joined, in characters after folding of numbers.
PREFIXES = (1, 2, 3, 4, 6, 8, 12, 16)
#: Other sentences an opening must have; fewer do against a fragment in small letters, as headlines and notes are.
LEAST_SEEN, LEAST_SEEN_SMALL, LEAST_FINISHED = 3, 1, 0.6
MARK = r"(?:…|\.{3,}|[\[(<{]\s*(?:…|\.{2,}|[\p{L} ]{1,16})\s*[\])>}])"
OMISSION = regex.compile(rf"\s*{MARK}\s*$", regex.I)
#: Characters at the end of a text within which a mark of omission is taken off before copies are dropped.
TAIL = 64
#: Equal texts of so many characters are copies of one another, shorter ones may be written independently.
LEAST_COPIED = 20
FINISHED = regex.compile(r"[.!?。！？]['\"”’»)\]】」』）*_]*$")
SENTENCE_END = regex.compile(r"(?<=[.!?]['\"”’»)\]*_]?)\s+|(?<=[。！？][」』）]?)")
ITEM = re.compile(r"\s*(?:[-*+•–—]{1,2}\s|\[[ xX]?\]|\(?\w{1,3}[.)]\s|#{1,6}\s|>|\|)")
DIGITS = re.compile(r"\d+")
#: Characters of the stretches of a text that decide its range, one after the other, and texts sampled a range.
RANGE_STRETCHES, RANGE_SAMPLE = (512, 1536, 6144), 20


def sentences(text: str) -> list[str]:
    """The sentences and fragments of a text in order; the items of a list are one each."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if line:
            if ITEM.match(line):
                out.append(line)
            else:
                out.extend(x for x in SENTENCE_END.split(line) if x)
    return out


def last_fragment(text: str) -> str | None:
    """What follows the last sentence end, without a mark of omission; None where the text comes to its end."""
    bare = OMISSION.sub("", text).rstrip()
    if not bare:
        return None
    marked = len(bare) < len(text.rstrip())
    if not marked and FINISHED.search(bare):
        return None
    line = bare.splitlines()[-1].strip()
    if ITEM.match(line):
        return line
    last = [x for x in SENTENCE_END.split(line) if x][-1]
    return None if FINISHED.search(last) else last


def folded(fragment: str) -> str:
    return DIGITS.sub("0", fragment[:64])


def _text_batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield part, part.column(column).to_pylist()


def _bare(text: str) -> Column:
    """The text without a mark of omission at its end."""
    end = F.regexp_replace(F.right(F.col(text), F.lit(TAIL)), rf"(?i)\s*+(?:{MARK}\s*)?$", "")
    return F.concat(F.left(F.col(text), F.length(text) - TAIL), end)


def examine(texts: DataFrame) -> DataFrame:
    """One pass over ``texts`` (h, times, text): ``(h, fragment, open_code)`` rows of the texts that don't come to a sentence end,
    and ``(prefix, finished, unfinished)`` rows of how often sentences that open so are finished, summed a batch.

    ``times`` is how often a text's openings count: once for copies, once a record for short texts, never for a
    copy that differs from another in its mark of omission only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: Counter[str] = Counter()
        open_: Counter[str] = Counter()
        empty = {"h": pa.int64(), "fragment": pa.string(), "open_code": pa.bool_(), "prefix": pa.string(), "finished": pa.int64(), "unfinished": pa.int64()}

        def batch_of(**columns: list) -> pa.RecordBatch:
            rows = max(map(len, columns.values()))
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in empty.items()], list(empty))

        def flush() -> pa.RecordBatch:
            keys = list(done.keys() | open_.keys())
            batch = batch_of(prefix=keys, finished=[done[k] for k in keys], unfinished=[open_[k] for k in keys])
            done.clear()
            open_.clear()
            return batch

        for part, texts_ in _text_batches(batches, 2):
            hashes, found, code = [], [], []
            for h, times, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts_):
                if (f := last_fragment(t)) is not None:
                    hashes.append(h)
                    found.append(folded(f))
                    code.append(t.count("```") % 2 == 1)
                if times:
                    for s in sentences(OMISSION.sub("", t)):
                        f = folded(s)
                        into = done if FINISHED.search(s) else open_
                        for p in PREFIXES:
                            if p > len(f):
                                break
                            into[f[:p]] += times
            yield batch_of(h=hashes, fragment=found, open_code=code)
            if len(done) + len(open_) > 200_000:
                yield flush()
        yield flush()

    return spread(texts.select("h", "times", "text")).mapInArrow(run, "h bigint, fragment string, open_code boolean, prefix string, finished bigint, unfinished bigint")


def unfinished_prefix(short: str, long: str) -> bool:
    """``short`` is a strict prefix of ``long`` and stops inside a word or sentence of it."""
    if len(short) >= len(long) or not long.startswith(short):
        return False
    end, after = short[-1:], long[len(short)]
    if not end or end == "\n":
        return False
    if (end.isalnum() or end in ".-_/`'") and after.isalnum():
        return end.isascii() or not FINISHED.search(short)
    if after in "\r\n":
        return False
    bare = short.rstrip()
    return not FINISHED.search(bare) and long[len(bare) :].lstrip(" \t")[:1] not in ("", "\n", "\r", "(")


def cut_copy(short: str, long: str) -> bool:
    """``long`` shows ``short`` to be cut off; a text of a few characters only by the rest of its last word."""
    if len(short) < LEAST_COPIED and not (len(short) < len(long) and short[-1:].isalnum() and long[len(short)].isalnum()):
        return False
    return unfinished_prefix(short, long)


def prefix_copies(texts: DataFrame) -> DataFrame:
    """``(h)`` of every text of ``texts`` (h, text), each once, that a longer copy shows to be cut off.

    The texts are range-partitioned and sorted, so the copies of one text spread over tasks by their order however
    many they are, and by what follows a long beginning they share.
    """
    spark = texts.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the ranges are drawn from bounded stretches of a few texts, which are what the driver gets; the order is of whole texts
    starts = [1 + sum(RANGE_STRETCHES[:k]) for k in range(len(RANGE_STRETCHES))]
    stretches = [F.substring("text", at, n) for at, n in zip(starts, RANGE_STRETCHES)]
    ordered = texts.select("h", "text").repartitionByRange(parts, *stretches).sortWithinPartitions("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        first = None
        held: list[tuple[int, str]] = []  # texts that this and maybe later ones extend, not yet shown to be cut off
        names = ["h", "part", "kind", "text"]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string()]
        for part, texts_ in _text_batches(batches, 1):
            cut = []
            for h, t in zip(part.column(0).to_pylist(), texts_):
                first = t if first is None else first
                still = []
                for h_, s in held:
                    if t.startswith(s):
                        (cut if cut_copy(s, t) else still).append((h_, s))
                held = [*still, (h, t)]
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in cut], kinds[0]), *(pa.nulls(len(cut), k) if n != "kind" else pa.array(["cut"] * len(cut)) for n, k in zip(names[1:], kinds[1:]))], names)
        if first is not None:
            rows = [(None, at, "first", first), *((h, at, "open", s) for h, s in held)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    sampled = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before = spark.conf.get(sampled)
    spark.conf.set(sampled, str(RANGE_SAMPLE))
    try:
        scanned = materialize(ordered.mapInArrow(scan, "h bigint, part int, kind string, text string"), "prefix-copies")
    finally:
        spark.conf.set(sampled, before)
    cut = scanned.where("kind = 'cut'").select("h")
    firsts = scanned.where("kind = 'first'").select("part", F.lead("text").over(Window.orderBy("part")).alias("next"))  # one row a range
    onward = scanned.where("kind = 'open'").select("h", "part", "text").join(firsts, "part").where(F.col("next").startswith(F.col("text")))
    onward = materialize(onward.select("h", "part", F.col("text").alias("short"), F.length("text").alias("length")), "open-at-range-ends")
    lengths = [r["length"] for r in onward.select("length").distinct().collect()]  # of the texts open at a range's end only
    if not lengths:
        return cut

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h for h, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()) if cut_copy(a, b)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["h"])

    longer = texts.select("text", F.explode(F.array(*map(F.lit, lengths))).alias("length")).where(F.length("text") > F.col("length"))
    key = F.xxhash64(F.expr("substring(text, 1, length)"))
    met = longer.select("text", key.alias("key")).join(onward.select("h", "short", F.xxhash64("short").alias("key")), "key").select("h", "short", "text")
    return cut.union(met.mapInArrow(across, "h bigint")).distinct()


def truncated(values: DataFrame, field: str, key: str, text: str) -> DataFrame:
    """``(field, key)`` of the records whose text is cut off.

    ``values`` holds one row a record; ``field`` names the column the text came from, so that several tables are
    judged with one corpus.
    """
    some = values.where(F.length(text) > 0)
    bare = _bare(text)
    records = some.select(field, key, F.xxhash64(text).alias("h"), F.xxhash64(bare).alias("bare_h"), (F.length(bare) < LEAST_COPIED).alias("short")).distinct()
    records = materialize(records, "text-records")
    # openings of a short text count once a record, of copies that differ in their mark of omission only once for all
    often = records.where("short").groupBy("h").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    copies = records.where(~F.col("short")).select("h", "bare_h").distinct()
    kept = copies.groupBy("bare_h").agg(F.min("h").alias("kept"), F.count(F.lit(1)).alias("several")).where("several > 1")
    never = copies.join(kept, "bare_h").where("h <> kept").select("h", F.lit(0).cast("bigint").alias("times"))
    # copies are combined before the shuffle, so a text that many rows hold crosses once a task; the join keeps its keys
    once = some.groupBy(F.xxhash64(text).alias("h")).agg(F.first(text).alias("text")).join(often.union(never), "h", "left")
    once = materialize(once.select("h", F.coalesce("times", F.lit(1)).alias("times"), "text"), "texts")
    examined = materialize(examine(once), "fragments")
    kind = examined.where("h is not null").select("h", "fragment", "open_code")
    seen = examined.where("prefix is not null").groupBy("prefix").agg(F.sum("finished").alias("finished"), F.sum("unfinished").alias("unfinished"))
    lengths = F.array(*(F.lit(p) for p in PREFIXES))
    small = F.col("fragment").rlike(r"^\p{Ll}")
    least = F.when(small, LEAST_SEEN_SMALL).otherwise(LEAST_SEEN)
    probes = kind.where(~F.col("open_code")).select("h", least.alias("least"), F.explode(F.filter(F.transform(lengths, lambda p: F.when(p <= F.length("fragment"), F.substring("fragment", F.lit(1), p))), lambda x: x.isNotNull())).alias("prefix"))
    others = F.col("finished") + F.col("unfinished") - 1  # the fragment itself is one of the unfinished
    judged = probes.join(seen, "prefix").where(others >= F.col("least")).groupBy("h").agg(F.max_by(F.col("finished") / others, F.length("prefix")).alias("share"))
    by_fragment = judged.where(F.col("share") >= LEAST_FINISHED).select("h")
    by_code = kind.where("open_code").select("h")
    found = by_fragment.union(by_code).union(prefix_copies(once)).distinct()
    return records.join(found, "h", "left_semi").select(field, key).distinct()


def truncation_rates(values: DataFrame, cut: DataFrame, field: str, key: str, source: str) -> DataFrame:
    """``(field, source, records, truncated, share)``: how often each source truncates."""
    marked = values.select(field, key, source).dropDuplicates([field, key]).join(cut.withColumn("_cut", F.lit(1)), [field, key], "left")
    counts = marked.groupBy(field, source).agg(F.count(F.lit(1)).alias("records"), F.count("_cut").alias("truncated"))
    return counts.withColumn("share", F.col("truncated") / F.col("records"))
