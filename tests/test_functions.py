"""Scalar functions, chunkers and decomposition against plain Python."""

from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorespark.functions import chunking as C
from lorespark.functions import text as T
from lorespark.operators import fts
from lorespark.plans.research import decompose


def test_entity_names(spark):
    cases = {"Ada Byron": "ada-byron", "SNAKE_CASE_NAME": "snake-case-name", "  two   words ": "two-words", "Ação São": "acao-sao", "--": "", "": ""}
    df = spark.createDataFrame([*cases.items(), (None, None)], "x string, y string").select("x", "y", T.normalize_entity_name(F.col("x")).alias("n"), T.normalize_entity_name(T.normalize_entity_name(F.col("x"))).alias("again"))
    for r in df.collect():
        assert r["n"] == r["y"] == r["again"]


def test_labels(spark):
    df = spark.createDataFrame([("Part-Of", "Bug"), ("uses", "issue-tracker"), ("whatever", "whatever"), (None, None), ("", "")], "r string, t string")
    got = [tuple(x) for x in df.select(T.canonical_relation(F.col("r")), T.canonical_entity_type(F.col("t"))).collect()]
    assert got == [("applies_to", "incident"), ("uses", "issue_tracker"), ("related", "concept"), (None, None), ("related", "concept")]


def test_file_names_and_uniqueness(spark, as_rows):
    df = spark.createDataFrame([("/a/Ação_Nova  Two.md",), ("/b/2024-plan.txt",), ("/c/.md",)], "p string").select(T.file_name(F.col("p")).alias("n"))
    assert as_rows(df) == [("acao-nova-two",), ("doc-2024-plan",), ("md",)]
    names = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a-1"), (5, "b")], "id int, name string")
    out = {r["id"]: r["unique_name"] for r in T.unique_names(names, "name", "id").collect()}
    assert out[1] == "a" and out[4] == "a-1" and out[5] == "b" and len(set(out.values())) == 5


def test_urls_have_byte_offsets(spark, as_rows):
    df = spark.createDataFrame([(1, "é http://a.example/x) and https://b.example/y?z=1 http://a.example/x"), (2, "http://"), (3, None), (4, "")], "id int, t string")
    assert as_rows(T.url_rows(df, "id", "t")) == [(1, "http://a.example/x", 3), (1, "https://b.example/y?z=1", 27)]


def test_preservation(spark):
    df = spark.createDataFrame([("abc", "abc"), ("abcdefgh", "abcdefgz"), ("abc", "xyz"), ("", ""), ("", "a")], "a string, b string")
    got = df.select(T.preservation(F.col("a"), F.col("b"), 0.5), F.round(T.trigram_jaccard(F.col("a"), F.col("b")), 4)).collect()
    assert [tuple(g) for g in got] == [("unchanged", 1.0), ("preserved", 0.6), ("rejected", 0.0), ("unchanged", 1.0), ("rejected", 0.0)]


def test_times_and_parts(spark):
    df = spark.createDataFrame([("0",), ("1704067200",), ("2024-01-01T00:00:00Z",), ("no",), (None,)], "t string")
    assert [r[0] for r in df.select(T.parse_epoch(F.col("t"))).collect()] == [0, 1704067200, 1704067200, None, None]
    one = spark.createDataFrame([("d" * 600, 2, 3)], "d string, i int, n int").select(T.part_description(F.col("d"), F.col("i"), F.col("n"))).first()[0]
    assert one.endswith(" (part 2/3)") and len(one) == 500


texts = st.text(alphabet=st.sampled_from("ab .\n#éあ!"), max_size=300)


@settings(max_examples=200, deadline=None)
@example("aaああ " + "a" * 25 + "あああ")
@given(texts)
def test_heuristic_chunks_cover(body):
    raw = body.encode()
    spans = C.heuristic_spans(body, 40, 8)
    assert spans[0][0] == 0 and spans[-1][1] == len(raw)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d
    for a, b in spans:
        assert b - a <= 40 or len(raw) <= 40
        raw[a:b].decode()


@settings(max_examples=200, deadline=None)
@given(texts)
def test_sections_are_lossless(body):
    raw = body.encode()
    spans = C.section_spans(body, 50)
    assert b"".join(raw[a:b] for a, b in spans) == raw
    assert all(b - a <= 50 for a, b in spans)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_markdown_chunks_cover(body):
    raw = body.encode()
    spans = C.markdown_spans(body, 40, 8)
    assert bool(spans) == bool(body.strip())
    if spans:
        assert spans[0][0] == 0 and spans[-1][1] == len(raw)
        assert all(c <= b for (_, b), (c, _) in zip(spans, spans[1:]))
        assert all(len(raw[a:b].decode()) <= 40 for a, b in spans)


def test_decompose():
    assert decompose("a; b ;c") == ["a", "b", "c"]
    assert decompose("one, two and three") == ["one", "two", "three"]
    assert decompose("outage caused by bad deploy") == ["outage", "bad deploy"]
    assert decompose("alpha beta gamma") == ["alpha beta gamma", "alpha beta", "beta gamma"]
    assert decompose("") == [""] and decompose("x") == ["x"]


def test_query_parsing():
    assert fts.parse("recall path") == fts.TextQuery(("recall", "path"))
    assert fts.parse("auth-design") == fts.TextQuery(("auth", "design"), ("auth", "design"), False)
    assert fts.parse('"* OR and') is None and fts.parse("") is None
    assert fts.parse("Naïve, don't") == fts.TextQuery(("naive", "don", "t"))
