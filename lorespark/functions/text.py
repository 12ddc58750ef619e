"""Scalar text functions: names, labels, addresses, descriptions, similarity. Null in, null out, unless said.

Everything that Spark's own functions can express stays in the JVM; Unicode decomposition and byte offsets are
Arrow functions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lorespark.functions import vocabulary as v


def _mapped(pairs: dict[str, str], key: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))
    return table[key]


def without_marks(text: str) -> str:
    """Compatibility decomposition without combining marks."""
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _arrow_text(function: Callable[[str], str]):  # noqa: ANN202
    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else function(t) for t in texts.to_pylist()], pa.string())

    return run


def _ascii_only(text: str) -> str:
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


to_ascii = _arrow_text(_ascii_only)
fold_marks = _arrow_text(without_marks)


def normalize_entity_name(name: Column) -> Column:
    """Small ASCII letters and digits, everything else one hyphen, none at the ends. Idempotent."""
    return F.trim(F.regexp_replace(F.lower(to_ascii(name)), "[^a-z0-9]+", "-"), F.lit("-"))


def valid_entity_name(name: Column) -> Column:
    """At least two bytes, one line, no acronym of up to four capitals, and still two characters when normalized."""
    shouting = (F.length(name) <= 4) & name.rlike(r"^[A-Z]+$")
    return (F.octet_length(name) >= 2) & ~name.contains("\n") & ~name.contains("\r") & ~shouting & (F.length(normalize_entity_name(name)) >= 2)


def normalize_relation(relation: Column) -> Column:
    return F.replace(F.lower(relation), F.lit("-"), F.lit("_"))


def valid_relation(relation: Column) -> Column:
    return relation.rlike("^[a-z][a-z0-9_]*$")


def canonical_relation(relation: Column) -> Column:
    """A label of the closed vocabulary; what isn't known becomes 'related'."""
    plain = normalize_relation(relation)
    return F.when(relation.isNull(), F.lit(None)).otherwise(F.when(plain.isin(*v.RELATIONS), plain).otherwise(F.coalesce(_mapped(v.RELATION_ALIASES, plain), F.lit("related"))))


def canonical_entity_type(label: Column) -> Column:
    """A type of the closed vocabulary; what isn't known becomes 'concept'."""
    plain = F.replace(F.lower(F.trim(label)), F.lit("-"), F.lit("_"))
    aliases = {alias: kind for kind, names in v.ENTITY_TYPE_ALIASES.items() for alias in names}
    return F.when(label.isNull(), F.lit(None)).otherwise(F.when(plain.isin(*v.ENTITY_TYPES), plain).otherwise(F.coalesce(_mapped(aliases, plain), F.lit("concept"))))


def memory_slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[_ ]", "-"), F.lit("-"))


def valid_memory_slug(slug: Column) -> Column:
    return slug.rlike("^[a-z][a-z0-9-]{0,78}[a-z0-9]$|^[a-z0-9]$") & (F.length(slug) <= v.NAME_MOST)


def file_name(path: Column, most: int = 60) -> Column:
    """The name a file's record gets: its stem in small letters, digits and hyphens, 'doc-' before a digit."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    plain = F.regexp_replace(F.lower(F.regexp_replace(fold_marks(stem), r"[_\s]", "-")), "[^a-z0-9-]", "")
    bare = F.trim(F.regexp_replace(plain, "-+", "-"), F.lit("-"))
    full = F.when(bare.rlike("^[0-9]"), F.concat(F.lit("doc-"), bare)).otherwise(bare)
    return F.when(F.length(full) > most, F.trim(F.substring(full, 1, most), F.lit("-"))).otherwise(full)


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Names made unique: the first keeps its name, later ones get -1, -2 and so on in ``order``.

    A number whose name is taken is passed over. With the taken numbers of a base in ascending order, the j-th has
    its value less j free ones below it; a row gets its place plus the number of taken ones with fewer free below.
    One ordered pass over the rows and the taken numbers of a base finds these, whatever their number.
    """
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1)
    taken = df.select(F.regexp_extract(name, r"^(.*)-([1-9]\d*)$", 1).alias("_base"), F.regexp_extract(name, r"-([1-9]\d{0,17})$", 1).try_cast("bigint").alias("_used")).where("_used is not null").distinct()
    below = F.col("_used") - F.row_number().over(Window.partitionBy("_base").orderBy("_used"))
    gaps = taken.select(F.col("_base").alias("_name"), below.cast("bigint").alias("_at"), F.lit(1).alias("_gap"), F.lit(None).cast("bigint").alias("_n"))
    rows = ranked.where("_n > 0").select(F.col(name).alias("_name"), F.col("_n").cast("bigint").alias("_at"), F.lit(0).alias("_gap"), F.col("_n").cast("bigint").alias("_n"))
    # a gap counts for the rows of a higher place, so at one place rows come first
    passed = F.sum("_gap").over(Window.partitionBy("_name").orderBy("_at", "_gap").rowsBetween(Window.unboundedPreceding, 0))
    numbers = rows.unionByName(gaps).withColumn("_number", F.col("_at") + passed).where("_gap = 0").select("_name", "_n", "_number")
    joined = ranked.join(numbers, (ranked[name] == numbers["_name"]) & (ranked["_n"] == numbers["_n"]), "left").drop(numbers["_n"])
    return joined.withColumn("unique_name", F.when(F.col("_n") == 0, F.col(name)).otherwise(F.concat_ws("-", F.col(name), F.col("_number").cast("string")))).drop("_n", "_name", "_number")


ADDRESS = r"https?://[^\s)\]}\"'<]*"


def urls(text: Column) -> Column:
    """All addresses in order of appearance."""
    return F.regexp_extract_all(text, F.lit(f"({ADDRESS})"), 1)


def url_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, url, url_offset)``: each address once a record, of 10 to 4096 characters, with the byte offset of its first place."""
    found = df.select(key, F.col(text).alias("_t"), F.explode(urls(F.col(text))).alias("url")).where(F.length("url").between(10, 4096)).dropDuplicates([key, "url"])
    before = F.expr("substring(_t, 1, locate(url, _t) - 1)")
    return found.select(key, "url", F.octet_length(before).cast("bigint").alias("url_offset"))


def heuristic_description(body: Column, path: Column | None = None) -> Column:
    """First trimmed line of more than 20 bytes that is no heading, cut at 100 characters; else the file's stem; else a constant."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    good = F.filter(lines, lambda x: (F.octet_length(x) > 20) & ~x.startswith("#"))
    first = F.substring(F.try_element_at(good, F.lit(1)), 1, 100)
    stem = None if path is None else F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    options = [first] if stem is None else [first, F.when(F.length(stem) >= 2, F.substring(stem, 1, 100))]
    return F.coalesce(*options, F.lit("ingested document"))


def trigrams(text: Column) -> Column:
    """Distinct (previous, this, next) characters; beyond the ends stands NUL."""
    padded = F.concat(F.lit("\u0000"), text, F.lit("\u0000"))
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(padded, i, F.lit(3))))


def trigram_jaccard(a: Column, b: Column) -> Column:
    """Shared share of the trigrams of two texts; 1 if both are empty."""
    x, y = trigrams(a), trigrams(b)
    both, any_ = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(any_ == 0, F.lit(1.0)).otherwise(both / any_)


def preservation(original: Column, rewritten: Column, threshold: float = 0.7) -> Column:
    """'unchanged', 'preserved' or 'rejected'."""
    limit = min(1.0, max(0.0, threshold))
    return F.when(original == rewritten, "unchanged").when(trigram_jaccard(original, rewritten) >= limit, "preserved").otherwise("rejected")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def approximate_tokens(text: Column) -> Column:
    """Words times three halves, rounded up."""
    return F.floor((word_count(text) * 3 + 1) / 2).cast("bigint")


def body_hash(body: Column) -> Column:
    """SHA-256 in hexadecimal: the same classes of equal bodies as any other digest."""
    return F.sha2(body, 256)


def part_description(description: Column, part: Column, parts: Column) -> Column:
    """' (part i/n)' appended to as many whole characters as keep it within 500 bytes of UTF-8."""
    suffix = F.format_string(" (part %d/%d)", part, parts)
    room = F.lit(v.DESCRIPTION_MOST) - F.octet_length(suffix)
    # the first 500 characters at most can fit; what fits of them is found by the bytes up to each
    upto = F.filter(F.sequence(F.lit(0), F.least(F.length(description), F.lit(v.DESCRIPTION_MOST))), lambda k: F.octet_length(F.substring(description, F.lit(1), k)) <= room)
    return F.concat(F.substring(description, F.lit(1), F.array_max(upto)), suffix)


def change_action(reason: Column) -> Column:
    return F.coalesce(_mapped(v.CHANGE_ACTIONS, reason), reason)


def parse_epoch(text: Column) -> Column:
    """Seconds of a non-negative epoch or an RFC 3339 time; null for anything else."""
    number = F.when(text.rlike(r"^\d+$"), text.try_cast("bigint"))
    return F.coalesce(number, F.unix_timestamp(F.try_to_timestamp(text)))


def iso_time(epoch: Column, zone: str = "UTC") -> Column:
    """The local time of a zone with its offset from UTC, whatever the zone of the session."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(secs=epoch))
    ahead = F.timestamp_diff("MINUTE", F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(secs=epoch), local)
    offset = F.format_string("%s%02d:%02d", F.when(ahead < 0, "-").otherwise("+"), F.floor(F.abs(ahead) / 60), F.abs(ahead) % 60)
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset)


WORDS = re.compile(r"[^\W_]+")


def tokens_of(text: str) -> list[str]:
    """Full-text tokens: runs of letters and digits, small, without diacritics."""
    return WORDS.findall(without_marks(text).lower())
