"""Per-document statistics of text quality, and which documents are not natural prose.

Lists and tables are found by their layout: the same delimiters at the same place of line after line (vertical
alignment), a marker or an indent that comes back in a fixed rhythm (indentation periodicity) and line lengths
that repeat (autocorrelation). Delimiters and marks are looked at line by line beside the lines around; a run of
lines without them is judged by its periodicity, autocorrelation and alignment together with its word, symbol and
punctuation ratios. The text as a whole is decided by one score: the share of characters outside such lines, and
against it the three layout scores and the share of lines that end in punctuation. Shares are weighted by
characters, so that prose holding a small list, table or code stays prose. A word is a token between white space
without the punctuation around it.

Defined cases: null, empty and blank texts get zero statistics and ``kind`` 'empty'; texts are read whole;
``common_words`` may hold nulls and repeated words.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.runtime import spread

PUNCTUATION = " .,;:!?…。、！？؟।\"'`´“”„«»‹›‘’()[]{}<>（）［］「」『』【】|│║/\\*_#=+~^-–—•·"
SENTENCE_END = frozenset(".!?…。！？؟।:;")
CLOSERS = "\"'”’»)]}）」』*_` \t"
DELIMITERS = ",;|\t│║"
MARKER = re.compile(r"\s*(?:[-*+•·◦‣▪–—]\s+|\[[ xX✓]?\]\s*|\(?(?:\d{1,4}|[a-zA-Z]|[ivxIVX]{1,5})[.)]\s+|#\d+\s+|[☐☑✓✔✗]\s*)(?:\[[ xX]\]\s*)?")
KEY_VALUE = re.compile(r"\s*[^\W\d_][\w ./()\-]{0,40}\s*[:=]\s*\S{1,40}(?: \S{1,24}){0,2}$")
LEADERS = re.compile(r"(?:\.\s?){4,}\s*\S{1,12}\s*$|_{4,}|(?:·\s?){4,}")
LOG_LINE = re.compile(r"\W{0,2}(?:\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\d\d:\d\d:\d\d|\w{3} +\d+ \d\d:\d\d:\d\d)\S*\s+(?:\[?[A-Z]{3,8}\]?)\b")
MARKUP_ROW = re.compile(r"</?t(?:able|r|d|h|body|head)\b|</?(?:ul|ol|li|dl|dt|dd)\b", re.I)
RULED = re.compile(r"[\s|+│║├┼┤┌┬┐└┴┘─═:\-=]+$")
STOP = re.compile(r"[.!?](?=\s|$|[\"')”»])|[。！？।]")
SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
GAP = re.compile(r"(?<=\S) {2,}(?=\S)|^ {6,}(?=\S)")
QUOTED = re.compile(r'"[^"]*"')
SYMBOL = regex.compile(r"[^\p{L}\p{N}\p{M}\s]")
DENSE = re.compile("[\u3040-\u30ff\u3400-\u9fff\u0e00-\u0e7f]")
BLOB = re.compile(r"[A-Za-z0-9+/=_\-]{30,}")
#: Fixed value: signs that appear when UTF-8 is read as a single-byte code page.
BROKEN = "ÃÂâåÐÑê€™œ¤°ðï»¿\u009d\u0080\u0099"
OPEN_SYLLABLES = re.compile(r"(?:[bcdfghjklmnpqrstvwxz][aeiouy])+$")
COLUMNS = [("word_count", "bigint"), ("mean_word_length", "double"), ("symbol_ratio", "double"), ("line_end_punct_share", "double"), ("common_word_share", "double"), ("delimiter_alignment", "double"), ("indent_periodicity", "double"), ("line_length_autocorrelation", "double"), ("prose_share", "double"), ("kind", "string")]


def _autocorrelation(lengths: np.ndarray) -> float:
    """Largest correlation of the line lengths with themselves shifted by 1 to 4 lines; 1 for equal lengths."""
    if len(lengths) < 4:
        return 0.0
    x = lengths - lengths.mean()
    power = float(x @ x)
    if power <= 0.02 * float(lengths @ lengths):  # hardly any spread: the lengths repeat as they are
        return 1.0
    return max(float(x[:-k] @ x[k:]) / power for k in range(1, min(5, len(x) - 1)))


def _ends_sentence(line: str) -> bool:
    end = line.rstrip(CLOSERS)
    return bool(end) and end[-1] in SENTENCE_END


def _words(line: str) -> list[str]:
    return [w for w in (t.strip(PUNCTUATION) for t in line.split()) if w]


def _cells(line: str) -> tuple[str, int]:
    """The delimiter found most often outside double quotes, and how often."""
    if '"' in line:
        line = QUOTED.sub("", line)
    best, most = ",", 0
    for mark in DELIMITERS:
        n = line.count(mark)
        if n > most:
            best, most = mark, n
    return best, most


def _dense(text: str) -> int:
    """Letters of scripts that put no blanks between words."""
    return 0 if text.isascii() else len(DENSE.findall(text))


def _common_share(words: list[str], common: frozenset[str], spaceless: list[str], text: str) -> float:
    """Share of words that are common; in text without blanks, share of letters covered by common particles."""
    if not words:
        return 0.0
    share = sum(w.lower() in common for w in words) / len(words)
    dense = _dense(text)
    if dense > 0.3 * sum(map(len, words)):
        share = max(share, min(1.0, sum(text.count(p) * len(p) for p in spaceless) / dense))
    return share


def _gibberish(text: str, words: list[str], common: frozenset[str], share: float, layout: bool) -> bool:
    """What no language writes: odd symbols, keys struck at random, broken encodings, one sign or word over and over.

    In a text with the ``layout`` of a list or table only encoded bytes count; there signs and words may repeat.
    """
    seen = Counter(text)
    for blank in [c for c in seen if c.isspace()]:
        del seen[blank]
    n = sum(seen.values())
    if n < 12:
        return False
    if sum(seen[c] for c in BROKEN) > 0.25 * n or seen["\ufffd"] + seen["\0"] > 0.03 * n:
        return True
    if sum(map(len, BLOB.findall(text))) > 0.5 * n and "://" not in text:
        return True
    hexadecimal = sum(seen[c] for c in "abcdefABCDEF")
    if n >= 24 and hexadecimal > 0.1 * n and hexadecimal + sum(seen[c] for c in "0123456789") > 0.97 * n:
        return True
    if layout:
        return False
    letters = sum(k for c, k in seen.items() if c.isalpha() or not (c.isascii() or SYMBOL.match(c)))
    digits = sum(k for c, k in seen.items() if c.isdigit())
    top = seen.most_common(2)
    if top[0][1] > 0.5 * n or letters + digits < 0.55 * n:
        return True
    if len(top) > 1 and top[0][1] + top[1][1] > 0.9 * n:
        return True
    if len(words) >= 6 and max(Counter(words).values()) > 0.6 * len(words):
        return True
    if len(words) >= 12 and len(set(words)) < 0.4 * len(words):
        sentences = Counter(x.strip() for x in SENTENCE.split(text) if x.strip())
        if max(sentences.values()) > max(3, 0.6 * sum(sentences.values())):
            return True
    latin = [w for w in words if w.isascii() and w.isalpha()]
    size = sum(map(len, latin))
    if size > 0.6 * n and size >= 30:
        joined = "".join(latin).lower()
        if sum(map(joined.count, "aeiouy")) < 0.17 * size or size > 22 * len(latin):
            return True
        if share < 0.15 and len(latin) >= 3 and sum(bool(OPEN_SYLLABLES.match(w.lower())) for w in latin) > 0.85 * len(latin):
            return True  # syllables strung together
        if len(latin) >= 40 and share < 0.02:
            return True
    plain = Counter({c: k for c, k in seen.items() if c.isascii() and c.isalpha()})
    size = sum(plain.values())
    return size >= 60 and size > 0.5 * n and sum(k for _, k in plain.most_common(8)) > 0.93 * size  # one row of keys


def _rows_align(lines: list[str]) -> bool:
    """Vertical alignment: nearly all blanks stand at the same places of line after line, in each phase of a record of 1 to 4 lines."""
    for period in range(1, 5):
        phases = [lines[k::period] for k in range(period)]
        if len(phases[-1]) < 4:
            return False
        for rows in phases:
            blanks = Counter(at for x in rows for at, c in enumerate(x) if c == " ")
            aligned = sum(k for k in blanks.values() if k >= 0.8 * len(rows))
            if aligned < len(rows) or aligned < 0.8 * blanks.total() or len(set(rows)) < 0.6 * len(rows):
                break
        else:
            return True
    return False


def _layout_kind(lines: list[str], n_words: list[int]) -> str | None:
    """'table' or 'list' for a run of lines without marks or delimiters that only its layout shows to be one.

    Sentences that stop or run on, and lines filled up to a width, are prose whatever their lengths and indents.
    """
    n = len(lines)
    if n < 4:
        return None
    rows = [x.expandtabs(4).rstrip() for x in lines]
    ended = sum(_ends_sentence(x) or x[-1] in ",，、" for x in rows)
    if max(ended, sum(bool(STOP.search(x)) for x in rows)) > 0.15 * n:
        return None
    lengths = np.array([len(x) for x in rows], float)
    if _autocorrelation(lengths) >= 0.5 and _rows_align(rows):
        return "table"
    indents = [len(x) - len(x.lstrip()) for x in rows]
    returns = sum(i != indents[k - 1] and i in indents[max(0, k - 6) : k - 1] for k, i in enumerate(indents) if k)
    rhythm = sum(i in indents[max(0, k - 6) : k] for k, i in enumerate(indents))
    if returns < max(2, 0.2 * n) or rhythm < 0.6 * n or sorted(n_words)[n // 2] < 4:
        return None
    filled = sum(lengths[k] + 1 + len(rows[k + 1].split(None, 1)[0]) > lengths.max() for k in range(n - 1))
    signs = sum(len(SYMBOL.findall(x)) for x in rows)
    if filled >= 0.5 * (n - 1) or signs > 0.06 * sum(len(x.replace(" ", "")) for x in rows):  # wrapped text, or code
        return None
    return "list"


#: What each layout score, beyond its usual value in prose, adds to the share of laid-out characters.
LAYOUT_WEIGHT, USUAL = 0.2, 0.25
PUNCTUATION_WEIGHT, USUAL_PUNCTUATION = 0.1, 0.5


def layout_score(laid_out: float, alignment: float, periodicity: float, autocorrelation: float, punctuated: float) -> float:
    """From 0 for prose to 1 for lists and tables; a half is the border.

    ``laid_out`` is the share of characters in lines that look like a list's or table's; where that leaves the text
    undecided, vertical alignment, periodicity and autocorrelation speak for a layout and ends of sentences against.
    """
    rhythm = sum(max(0.0, x) - USUAL for x in (alignment, periodicity, autocorrelation))
    return laid_out + laid_out * (1 - laid_out) * 4 * (LAYOUT_WEIGHT * rhythm - PUNCTUATION_WEIGHT * (punctuated - USUAL_PUNCTUATION))


def _line_kinds(lines: list[str], words: list[list[str]], marks: list[str]) -> list[str]:
    """What each line looks like beside its neighbours."""
    cells = [_cells(x) for x in lines]
    gaps = [[m.end() for m in GAP.finditer(x)] if "  " in x else [] for x in lines]
    columns = Counter(c for g in gaps for c in g)
    kinds: list[str] = []
    fenced = False
    last = len(lines)
    for at, line in enumerate(lines):
        near = [k for k in (at - 2, at - 1, at + 1, at + 2) if 0 <= k < last]
        mark, n = cells[at]
        n_words = len(words[at])
        bare = line.lstrip()
        if bare.startswith(("```", "~~~")):
            fenced = not fenced
            kinds.append("code")
        elif fenced:
            kinds.append("code")
        elif bare[0] == "#" and bare.lstrip("#")[:1].isspace():
            kinds.append("heading")
        elif bare[0] == "<" and MARKUP_ROW.search(line):
            kinds.append("table")
        elif not bare[0].isalnum() and RULED.match(line):
            kinds.append("rule")
        elif LOG_LINE.match(line):
            kinds.append("log")
        elif n and mark in "|│║\t" and any(cells[k] == (mark, n) for k in near):
            kinds.append("table")
        elif n >= 2 and mark in ",;" and sum(cells[k] == (mark, n) for k in near) >= min(2, len(near)) and near and (mark == ";" or n_words < 3.2 * (n + 1) or '"' in line):
            kinds.append("table")
        elif gaps[at] and sum(columns[c] >= max(2, 0.2 * last) for c in gaps[at]) >= 0.5 * len(gaps[at]) and (len(gaps[at]) >= 2 or n_words <= 8):
            kinds.append("table")
        elif ("...." in line or ". . ." in line or "__" in line or "··" in line) and LEADERS.search(line):
            kinds.append("list")
        elif marks[at] and (n_words <= 14 or any(marks[k] for k in near)) and n_words <= 24 and len(STOP.findall(line[len(marks[at]) :])) < 2:
            kinds.append("list")
        elif n_words <= 9 and (":" in line or "=" in line) and KEY_VALUE.match(line) and not STOP.search(line):
            kinds.append("pair")
        elif n >= 4 and mark in ",;" and n_words <= 4.2 * (n + 1) and len(STOP.findall(line)) * 8 <= n:
            kinds.append("inline")
        else:
            kinds.append("text")
    # a run of short lines without any stop is a list without markers; wrapped prose has stops or long lines
    at = 0
    while at < last:
        to = at
        while to < last and kinds[to] in ("text", "pair"):
            to += 1
        if to > at:
            counts = sorted(len(words[k]) for k in range(at, to))
            stops = sum(bool(STOP.search(lines[k])) for k in range(at, to))
            pairs = sum(kinds[k] == "pair" for k in range(at, to))
            span = sum(len(lines[k]) for k in range(at, to))
            if _dense("".join(lines[at:to])) > 0.3 * span:
                short = max(len(lines[k]) for k in range(at, to)) <= 24
            else:
                short = counts[len(counts) // 2] <= 6 and sum(counts) <= 6.5 * len(counts)
            listed = "list" if to - at >= 3 and short and stops <= 0.15 * (to - at) else _layout_kind(lines[at:to], [len(ws) for ws in words[at:to]])
            for k in range(at, to):
                if kinds[k] == "pair" and pairs < 2:
                    kinds[k] = "text"
                if listed and kinds[k] == "text":
                    kinds[k] = listed
        at = max(to, at + 1)
    return kinds


def examine(text: str | None, common: frozenset[str], spaceless: list[str]) -> tuple:
    """The statistics of one text, in the order of ``COLUMNS``."""
    if text is None or not text.strip():
        return 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "empty"
    if "\r" in text or not text.isascii():
        text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\u2028", "\n").replace("\u2029", "\n").lstrip("\ufeff")
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "empty"
    by_line = [_words(x) for x in lines]
    words = [w for ws in by_line for w in ws]
    size = [len(x.replace(" ", "")) for x in lines]
    solid = sum(size)
    share = _common_share(words, common, spaceless, text)
    marks = [m.group(0) if (m := MARKER.match(x)) else "" for x in lines]
    kinds = _line_kinds(lines, by_line, marks)
    weight = Counter()
    for kind, n in zip(kinds, size):
        weight[kind] += n
    body = solid - weight["heading"] - weight["rule"] - weight["code"]
    tables, lists = weight["table"] + weight["log"], weight["list"] + weight["pair"] + weight["inline"]

    prose = weight["text"] / body if body else 0.0
    indents = [len(x) - len(x.lstrip()) for x in lines]
    heads = [m.strip()[:1] for m in marks]
    rhythm = sum(m != "" and (m.isalnum() or m in heads[max(0, k - 3) : k]) for k, m in enumerate(heads))
    rhythm = max(rhythm, sum(i > 0 and i in indents[max(0, k - 3) : k] for k, i in enumerate(indents)))
    alignment, periodicity = tables / body if body else 0.0, rhythm / len(lines)
    autocorrelation = _autocorrelation(np.array([len(x) for x in lines], float))
    punctuated = sum(map(_ends_sentence, lines)) / len(lines)
    natural = layout_score(1 - prose, alignment, periodicity, autocorrelation, punctuated) <= 0.5
    layout = not natural and len(lines) >= 3
    if weight["rule"] > 2 * (solid - weight["rule"]) and solid >= 12:
        kind = "junk"
    elif not body:
        kind = "prose"  # headings or code alone are neither list nor table
    elif _gibberish(*(("\n".join(x for x, k in zip(lines, kinds) if k == "text"), [w for ws, k in zip(by_line, kinds) if k == "text" for w in ws]) if natural and prose < 1 else (text, words)), common, share, layout):
        kind, prose = "junk", 0.0
    elif natural:
        kind = "prose"
    elif weight["log"] > 0.5 * body:
        kind = "junk"
    elif len(lines) == 1 and not weight["inline"] and not weight["table"]:
        kind = "prose"
    else:
        kind = "table" if tables >= lists else "list"

    letters = sum(map(len, words))
    return (
        len(words),
        letters / len(words) if words else 0.0,
        len(SYMBOL.findall(text)) / solid,
        punctuated,
        share,
        alignment,
        periodicity,
        autocorrelation,
        prose,
        kind,
    )


def text_statistics(df: DataFrame, key: str, text: str, common_words: list[tuple[str | None, str | None]]) -> DataFrame:
    """``(key, *COLUMNS)`` for each row of ``df``: a map over the scan, without a shuffle.

    ``common_words`` is a reference list of a few hundred (lang, word) rows that doesn't grow with the data.
    """
    common = frozenset(w.lower() for _, w in common_words if w)
    spaceless = sorted({w for _, w in common_words if w and DENSE.match(w)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [examine(t, common, spaceless) for t in batch.column(1).to_pylist()]
            got = list(zip(*rows)) if rows else [()] * len(COLUMNS)
            kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kinds[k]) for c, (_, k) in zip(got, COLUMNS))], [key, *(c for c, _ in COLUMNS)])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(key), F.col(text))).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{c} {k}" for c, k in COLUMNS))


def not_prose(statistics: DataFrame, key: str) -> DataFrame:
    """The keys of the texts that are mainly a list, a table or junk."""
    return statistics.where(F.col("kind").isin("list", "table", "junk")).select(key)
