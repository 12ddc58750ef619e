"""The operators of the subpackage against brute force, round trips and defined cases."""

import base64
import itertools
import math
import random
import textwrap
from collections import Counter

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorespark.llm import bpe, cooccurrence, labels, names, neardup, packing, quality, queries, splitting, truncation
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    if name in queries.ORACLE:
        same(df, connect(data), queries.ORACLE[name])
    else:
        df.count()


# 1 splitting

bodies = st.text(alphabet=st.sampled_from("ab  .\né。あ,𝒳"), max_size=400)


@settings(max_examples=300, deadline=None)
@given(bodies)
def test_pieces(body):
    raw = body.encode()
    pieces, starts = splitting.cut(body, 60, 12)
    assert starts[-1] == len(raw) and pieces[0][0] == 0 and pieces[-1][1] == len(raw)
    for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]):
        assert a < c <= b < d
        # each repeats some of the one before, unless a stretch needs the room
        assert c < b or max(splitting.longest_stretch(raw[b : b + 60].decode(errors="ignore"), splitting.byte_starts(raw[b : b + 60].decode(errors="ignore"))), 0) > 60 - 12 - 4
    for a, b, _ in pieces:
        assert b - a <= 60
        raw[a:b].decode()
    assert any(f for _, _, f in pieces) == (splitting.longest_stretch(body, starts) > 60)


def test_long_stretches_stay_whole():
    rng = random.Random(3)
    for _ in range(300):
        body = " ".join("x" * rng.choice([1, 5, 9, 600, 700, 790, 800, 640, 801][: 8 + (rng.random() < 0.1)]) for _ in range(rng.randrange(2, 30)))
        pieces, starts = splitting.cut(body)
        assert any(f for _, _, f in pieces) == (splitting.longest_stretch(body, starts) > 800)
        for (a, b, forced), (c, _, _) in zip(pieces, pieces[1:]):
            assert b - a <= 800 and c <= b and (forced or body[b - 1] == " " or body[b] == " ")


def test_forced_cuts(spark, as_rows):
    rows = [(1, "x" * 900), (2, "x " * 500), (3, "。".join(["あ" * 200] * 3)), (4, "あ" * 300), (5, None), (6, ""), (7, "x" * 800), (1, "x" * 900)]
    df = spark.createDataFrame(rows, "id bigint, body string")
    assert as_rows(splitting.cut_kinds(splitting.split_texts(df, "id", "body"), "id")) == [(1, "forced"), (2, "natural"), (3, "natural"), (4, "forced")]
    assert splitting.split_texts(df.where("false"), "id", "body").count() == 0


# 3 near-duplicates


def exact_pairs(texts, width, similarity, least):
    sets = {k: set(neardup.runs(neardup.words(t), width).tolist()) for k, t in texts.items() if t is not None and len(neardup.words(t)) >= least}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if texts[a] != texts[b] and sets[a] | sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9}


def altered(rng, base, n):
    w = base.split()
    for _ in range(n):
        k = rng.randrange(len(w))
        rng.choice([lambda: w.__setitem__(k, "q%d" % rng.randrange(99)), lambda: w.insert(k, "z"), lambda: w.pop(k)])()
    return " ".join(w)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    texts, at = {}, 0
    for _ in range(40):
        base = " ".join(rng.choice(vocabulary) for _ in range(60))
        for _ in range(rng.randrange(1, 6)):
            texts[at] = altered(rng, base, rng.randrange(0, 6))
            at += 1
    texts |= {at: None, at + 1: "", at + 2: "too short", at + 3: texts[0].upper(), at + 4: texts[0], at + 5: texts[0].replace(" ", ", ")}
    rows = [*texts.items(), (0, texts[0])]
    df = spark.createDataFrame(rows, "id bigint, body string")
    nd = neardup.NearDuplicates(df, "id", "body", 3, 0.6, 20)
    got = {tuple(r) for r in nd.record_pairs().collect()}
    want = exact_pairs(texts, 3, 0.6, 20)
    assert got <= want and len(got) >= 0.97 * len(want)
    links = nd.links().collect()
    assert len(links) == len({r["id"] for r in links})
    group = {r["id"]: r["group"] for r in nd.groups().collect()}
    assert all(group[a] == group[b] for a, b in got)
    assert neardup.NearDuplicates(df.where("false"), "id", "body").record_pairs().count() == 0


def test_large_nodes_branch_before_they_are_gathered(spark, monkeypatch):
    monkeypatch.setattr(neardup, "NODE_MOST", 20)
    base = " ".join(f"c{k}" for k in range(40))
    rng = random.Random(1)
    texts = {k: altered(rng, base, 2) for k in range(60)}
    nd = neardup.NearDuplicates(spark.createDataFrame(list(texts.items()), "id bigint, body string"), "id", "body", 3, 0.6, 20)
    got, want = {tuple(r) for r in nd.record_pairs().collect()}, exact_pairs(texts, 3, 0.6, 20)
    assert got <= want and len(got) >= 0.97 * len(want)


def test_nodes_no_branching_parts_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "NODE_MOST", 10)
    monkeypatch.setattr(neardup, "DEPTH_MOST", 1)
    monkeypatch.setattr(neardup, "PAIRS_A_HUB", 7)
    base = [f"c{k}" for k in range(80)]
    texts = {k: " ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(40)} | {100: None, 101: "a b", 102: "a b", 103: None}
    nd = neardup.NearDuplicates(spark.createDataFrame(list(texts.items()), "id bigint, body string"), "id", "body", 3, 0.6, 20)
    assert {tuple(r) for r in nd.record_pairs().collect()} == exact_pairs(texts, 3, 0.6, 20)
    assert {r["id"]: r["class"] for r in nd.links().collect()} == {k: k for k in texts} | {102: 101}
    assert {r["id"]: r["group"] for r in nd.groups().collect()} == {k: 0 for k in range(40)} | {100: 100, 101: 101, 102: 101, 103: 103}


def test_copies_of_one_text_never_meet(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.range(40_000).select("id", F.when(F.col("id") == 7, F.lit(text.upper())).otherwise(F.lit(text)).alias("body"))
    assert neardup.NearDuplicates(df, "id", "body", 3, 0.6, 20).record_pairs().count() == 39_999


# 4 labels


def plain_distance(a, b):
    """Unrestricted Damerau-Levenshtein by definition, over all cells."""
    far = len(a) + len(b)
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    last = {}
    for i in range(1, len(a) + 1):
        db = 0
        for j in range(1, len(b) + 1):
            k, l = last.get(b[j - 1], 0), db
            cost = a[i - 1] != b[j - 1]
            if not cost:
                db = j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, l - 1] + (i - k - 1) + 1 + (j - l - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


short = st.text(alphabet="abc", max_size=7)


@settings(max_examples=300, deadline=None)
@given(short, short, short)
def test_edit_metric(a, b, c):
    d = lambda x, y: labels.distance(x, y, len(x) + len(y))
    assert d(a, b) == plain_distance(a, b) == d(b, a)
    assert d(a, c) <= d(a, b) + d(b, c)


@settings(max_examples=100, deadline=None)
@given(st.lists(short, min_size=1, max_size=30), short, st.integers(0, 3))
def test_tree_returns_all_within(entries, text, most):
    tree = labels.BKTree([(e, e) for e in entries])
    assert sorted(tree.within(text, most)) == sorted({(plain_distance(text, e), e) for e in entries if plain_distance(text, e) <= most})


def test_label_cases(spark, as_rows):
    entries = spark.createDataFrame([("v", "depends_on", "depends_on"), ("v", "requires", "depends_on"), ("v", "uses", "uses"), ("v", None, "x"), ("w", "uses", "other")], "vocabulary string, text string, label string")
    records = spark.createDataFrame([("f", i, "v", x) for i, x in enumerate(["depends_on", "DependsOn", "dependso_n", "[requires]", "use", "tbd", "", " ", None, "Requires?"])] + [("f", 1, "v", "DependsOn"), ("f", 50, "none", "uses")], "field string, id bigint, vocabulary string, value string")
    known = entries.where("text = label").select("vocabulary", "label")
    got = dict((i, x) for _, i, x in as_rows(labels.variants(records, entries, known)))
    assert got == {1: "depends_on", 2: "depends_on", 3: "depends_on", 4: "uses", 5: "unmatched", 6: "unmatched", 7: "unmatched", 9: "depends_on", 50: "unmatched"}
    assert labels.variants(records.where("false"), entries, known).count() == 0


def test_sharded_trees_agree(spark, as_rows, monkeypatch):
    entries = spark.createDataFrame([("v", f"entry{k}name", f"l{k}") for k in range(40)], "vocabulary string, text string, label string")
    values = spark.createDataFrame([("v", f"Entry{k}nme") for k in range(40)] + [("v", "zzz")], "vocabulary string, value string")
    whole = as_rows(labels.typed_labels(values, entries))
    monkeypatch.setattr(labels, "ENTRIES_MOST", 3)
    assert as_rows(labels.typed_labels(values, entries)) == whole


def test_ties_within_and_across_shards_are_settled_alike(spark, as_rows, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(3, 8))) for _ in range(120)]
    entries = spark.createDataFrame([("v", w, f"l{rng.randrange(6)}") for w in words] + [("v", "qqqqq", "x"), ("v", "qqqqz", "y"), ("v", "qqqq", "x")], "vocabulary string, text string, label string")
    values = spark.createDataFrame([("v", "".join(rng.choice("abcd") for _ in range(rng.randrange(3, 8)))) for _ in range(200)] + [("v", "qqqqx"), ("w", "qqqqx")], "vocabulary string, value string")
    whole = as_rows(labels.typed_labels(values, entries))
    assert {r[2] for r in whole} > {"unmatched", "l1"}
    monkeypatch.setattr(labels, "ENTRIES_MOST", 7)
    monkeypatch.setattr(labels, "VALUES_MOST", 50)
    assert as_rows(labels.typed_labels(values, entries)) == whole


# 5 pairs


def counted(bindings, least, ratio):
    by = {}
    for m, e in set(bindings):
        if m is not None and e is not None:
            by.setdefault(e, set()).add(m)
    n = len({m for m, e in bindings if m is not None and e is not None})
    return {(a, b) for a, b in itertools.combinations(sorted(by), 2) if len(by[a] & by[b]) >= least and len(by[a] & by[b]) * n >= ratio * len(by[a]) * len(by[b])}


def test_pairs_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "BLOCK", 4)
    rng = random.Random(3)
    bindings = [(m, e) for m in range(300) for e in ([*range(10 * (m % 20), 10 * (m % 20) + 4)] + [rng.randrange(220) for _ in range(3)])]
    bindings += [(m, e) for m in (1000, 1001, 1002, 1003, 1004) for e in range(120)] + [(m, 999) for m in range(250)]
    bindings += [(None, 1), (1, None), (0, 0), (0, 0)]
    df = spark.createDataFrame(bindings, "m bigint, e bigint")
    table = cooccurrence.build(cooccurrence.clean(df, "m", "e"))
    got = {(r["item_a"], r["item_b"]) for r in cooccurrence.associated(table).collect()}
    assert got == counted(bindings, 5, 8) and got
    assert cooccurrence.associated(cooccurrence.build(cooccurrence.clean(df.where("false"), "m", "e"))).count() == 0


def test_rare_pairs_come_out(spark, tmp_path):
    rows = [(1, 10), (1, 11), (1, 11), (2, 10), (3, 12), (3, None), (None, 12)]
    spark.createDataFrame(rows, "memory_id bigint, entity_id bigint").write.parquet(f"{tmp_path}/memory_entities.parquet")
    assert [tuple(r) for r in queries.QUERIES["p5_pairs"](spark, str(tmp_path)).collect()] == [(10, 11, 1, 2, 1, 1.5)]


def test_merging_equals_building_anew(spark, as_rows):
    rng = random.Random(4)
    before = {(rng.randrange(12), rng.randrange(8)) for _ in range(50)}
    drop, add = set(rng.sample(sorted(before), 12)), {(rng.randrange(14), rng.randrange(9)) for _ in range(12)} - before
    clean = lambda b: cooccurrence.clean(spark.createDataFrame(sorted(b), "m bigint, e bigint"), "m", "e")
    table = cooccurrence.load(clean(before))
    changes = spark.createDataFrame([(m, e, -1) for m, e in drop] + [(m, e, 1) for m, e in add] + [(99, 99, -1), (None, 1, 1)], "basket bigint, item bigint, sign int")
    merged, touched = cooccurrence.merge(table, changes)
    anew = cooccurrence.build(clean((before - drop) | add), least=1, ratio=0)
    assert as_rows(cooccurrence.scores(merged)) == as_rows(cooccurrence.scores(anew))
    assert set(as_rows(touched)) <= set(as_rows(cooccurrence.scores(anew)))


def test_tables_with_thresholds_take_changes(spark, tmp_path):
    """Held-out baskets grow, shrink and change places, items cross the bounds, and the kept state is taken up again."""
    rng = random.Random(9)
    now = {(m, 10 * (m % 6) + k) for m in range(90) for k in range(4)} | {(m, rng.randrange(80)) for m in range(90) for _ in range(3)} | {(500 + k, e) for k in range(3) for e in range(60)}
    frame = lambda rows, schema="m bigint, e bigint": spark.createDataFrame(sorted(rows), schema)
    table = cooccurrence.load(cooccurrence.clean(frame(now), "m", "e"), 3, 2.0, f"file://{tmp_path}/pairs")
    for step in range(3):
        gone = set(rng.sample(sorted(now), 40)) | {x for x in now if x[0] == 500 + step and x[1] > 5}
        come = {(rng.randrange(95), rng.randrange(85)) for _ in range(40)} | {(600 + step, e) for e in range(20 * step, 20 * step + 50)} | {(m, 70) for m in range(40 * step)}
        change = [(m, e, -1) for m, e in gone] + [(m, e, 1) for m, e in come - gone]
        now = (now - gone) | (come - gone)
        table = cooccurrence.open_table(spark, table.folder)
        files = dict(table.pairs.folders)
        table, _ = cooccurrence.merge(table, frame(change, "basket bigint, item bigint, sign int"))
        assert {(r["item_a"], r["item_b"]) for r in cooccurrence.associated(table, 3, 2.0).collect()} == counted(now, 3, 2.0) != set()
    assert len(table.big) == 2 and files.keys() == table.pairs.folders.keys()
    small, _ = cooccurrence.merge(table, frame([(7000, 81, 1)], "basket bigint, item bigint, sign int"))
    assert sum(small.bindings.folders[b] != f for b, f in table.bindings.folders.items()) <= 1  # other buckets stay


def test_pairs_of_the_last_month_come_by_the_merge(spark, tmp_path, monkeypatch):
    rows = [(m, e, 1_000_000_000 if m < 4 else 2_000_000_000) for m in range(6) for e in (1, 2)] + [(m, 9, 1) for m in range(100, 160)]
    spark.createDataFrame(rows, "memory_id bigint, entity_id bigint, created_at bigint").write.parquet(f"{tmp_path}/memory_entities.parquet")
    assert [tuple(r) for r in queries.p5_found(spark, str(tmp_path)).collect()] == [(1, 2)]
    monkeypatch.setattr(cooccurrence, "merge", lambda t, c: (t, None))
    assert queries.p5_found(spark, str(tmp_path)).count() == 0


def test_only_whole_tables_take_changes_and_all_ratios_follow(spark, as_rows):
    clean = lambda b: cooccurrence.clean(spark.createDataFrame(b, "m bigint, e bigint"), "m", "e")
    before = [(m, e) for m in range(5) for e in range(3)] + [(9, 7), (9, 8)]
    change = spark.createDataFrame([(20, 50, 1)], "basket bigint, item bigint, sign int")
    with pytest.raises(ValueError):
        cooccurrence.merge(cooccurrence.build(clean(before)), change)
    merged, touched = cooccurrence.merge(cooccurrence.load(clean(before)), change)
    anew = as_rows(cooccurrence.scores(cooccurrence.build(clean([*before, (20, 50)]), least=1, ratio=0)))
    assert as_rows(touched) == as_rows(cooccurrence.scores(merged)) == anew and len(anew) == 4


# 6 truncation


def test_cut_texts(spark, as_rows):
    full = ["The scan of part %d took four minutes and left nothing behind." % k for k in range(40)]
    values = [("b", k, t) for k, t in enumerate(full)]
    values += [("b", 100, "The scan of part 7 took four minu"), ("b", 101, "The scan of part 9 took"), ("b", 102, "stale list"), ("b", 103, None), ("b", 104, ""), ("b", 105, full[1] + "\n\nRegards, Anna"), ("b", 106, full[2] + " The scan of p..."), ("b", 107, full[3] + " ok for now"), ("b", 108, full[4][:-1] + " [...]"), ("b", 108, full[4][:-1] + " [...]"), ("c", 100, "The scan of part 8 to"), ("b", 109, "```\ncode(")]
    df = spark.createDataFrame(values, "field string, id bigint, text string")
    assert as_rows(truncation.truncated(df, "field", "id", "text")) == [("b", 100), ("b", 101), ("b", 106), ("b", 108), ("b", 109), ("c", 100)]
    assert truncation.truncated(df.where("false"), "field", "id", "text").count() == 0
    rates = truncation.truncation_rates(df.withColumn("s", F.lit("x")), truncation.truncated(df, "field", "id", "text"), "field", "id", "s")
    assert ("c", "x", 1, 1, 1.0) in as_rows(rates)


def test_copies_of_a_cut_text_bear_no_witness(spark, as_rows):
    full = ["The scan of part %d took four minutes and left nothing behind." % k for k in range(40)]
    whole = [("b", k, t) for k, t in enumerate(full)]
    cut = [("b", 1000 + k, "All is well. " + full[7][:40]) for k in range(300)] + [("b", 2000 + k, "now the scan of pages an" + end) for k, end in enumerate(["", " ", "...", " [...]", "\n"])]
    notes = [("b", 5000 + k, "The mood") for k in range(5)]
    meant = [("b", 3000 + k, t + "\nThe scan of Anna") for k, t in enumerate(full)]
    small = [("b", 4000, "now the scan of pages and texts is over.")]
    df = spark.createDataFrame(whole + cut + notes + meant + small, "field string, id bigint, text string")
    assert {r[1] for r in as_rows(truncation.truncated(df, "field", "id", "text"))} == {k for _, k, _ in cut}


def test_prefix_copies_over_any_ranges(spark):
    rng = random.Random(2)
    long = ["".join(rng.choice("abc ") for _ in range(60)) + "xyz end" for _ in range(30)]
    cut = [t[: rng.randrange(25, 58)] for t in long]
    texts = long + cut + long[:5]
    df = spark.createDataFrame(list(enumerate(sorted(set(texts)))), "h bigint, text string")
    number = {r["text"]: r["h"] for r in df.collect()}
    got = {r[0] for r in truncation.prefix_copies(df).collect()}
    want = {number[s] for s in texts if any(truncation.unfinished_prefix(s, t) for t in texts)}
    assert got == want and got


def test_any_of_several_longer_copies_shows_a_cut(spark):
    """The next longer copy may end as the cut text does; one further on doesn't. Long shared heads spread over ranges."""
    head = "x" * 3000
    cut = ["the quick fox jumps ov", "stale li", head + "end of the wo"]
    texts = [*cut, cut[0] + "\nnext line", cut[0] + "er the dog.", "stale list", "note", "note two", *(head + f"end of the words {k}." for k in range(200)), *(f"{cut[0]}\nline {k:03}" for k in range(200))]
    df = spark.createDataFrame(list(enumerate(texts)), "h bigint, text string")
    assert {r[0] for r in truncation.prefix_copies(df).collect()} == {0, 1, 2}


def test_rows_come_from_the_prefix_joins(spark, monkeypatch):
    full = ["The scan of part %d took four minutes and left nothing behind." % k for k in range(40)]
    df = spark.createDataFrame([("b", k, t) for k, t in enumerate([*full, "The scan of part 7 took four minu"])], "field string, id bigint, text string")
    assert [r["id"] for r in truncation.truncated(df, "field", "id", "text").collect()] == [40]
    monkeypatch.setattr(truncation, "PREFIXES", (99,))
    assert [r["id"] for r in truncation.truncated(df, "field", "id", "text").collect()] == [40]  # by the whole text alone
    monkeypatch.setattr(truncation, "cut_copy", lambda a, b: False)
    assert truncation.truncated(df, "field", "id", "text").count() == 0


# 7 names


def test_name_links(spark, as_rows):
    listed = ["Johannes Fenprupel", "hannes-fenprupel", "FENPRUPEL, J.", "Johannes Fenprpuel (ops)", "Dr. Johannes K. Fenprupel", "Clara Fenprupel", "Granite Log., Lomneprikon", "Lomneprikon Granite Logistics Limited", "Lomneprikon Harbor Logistics", "archive 12a", "archive 12b", None, "", "Johannes Fenprupel"]
    rows = [(k, "n", x) for k, x in enumerate(listed)] + [(50, "other", "Johannes Fenprupel"), (51, None, "Johannes Fenprupel"), (0, "n", listed[0])]
    forms = [("given_name", "Johannes", "Hannes"), ("organization_word", "Logistics", "Log"), ("organization_word", "Limited", "Ltd"), (None, None, "x")]
    got = as_rows(names.name_pairs(names.linked_names(spark.createDataFrame(rows, "id bigint, namespace string, name string"), forms)))
    assert set(got) == set(itertools.combinations([0, 1, 2, 3, 4, 13], 2)) | {(6, 7)}


def test_an_ambiguous_initial_ties_no_relatives():
    forms = names.Forms([])
    group = [names.parts(x, forms) for x in ("Robert Kvaneptav", "Rebecca Kvaneptav", "R Kvaneptav", "robert-kvaneptav")]
    number = names.average_linkage(group, forms)
    assert number[0] == number[3] != number[1]


def test_linkage_at_any_size(monkeypatch):
    monkeypatch.setattr(names, "DISTINCT_MOST", 2, raising=False)
    forms = names.Forms([])
    group = [names.parts(x, forms) for x in ("Robert Kvaneptav", "Rebecca Kvaneptav", "R Kvaneptav", "Robert Kvaneptva", "Rebecca Kvaneptav")]
    number = names.average_linkage(group, forms)
    assert number[0] == number[3] != number[1] == number[4]


def test_cosines_match_brute_force(spark):
    rng = random.Random(11)
    forms = names.Forms([])
    people = [" ".join(sorted([rng.choice(["robert", "rebecca", "r", "clara"]), "".join(rng.choice("kvanept") for _ in range(7))])) for _ in range(60)]
    people += [p[:-1].strip() for p in people[:20]]
    vectors = {k: names.features(tuple(p.split(" ")), forms) for k, p in enumerate(people)}
    df = spark.createDataFrame([("n", k, f) for k, v in vectors.items() for f in v], "namespace string, id bigint, feature string")
    got = {(r["a"], r["b"]): r["cosine"] for r in names.cosine_pairs(df, 0.3).collect()}
    count = Counter(f for v in vectors.values() for f in v)
    length = {k: math.sqrt(sum(1 / count[f] for f in v)) for k, v in vectors.items()}
    want = {(a, b): c for a, b in itertools.combinations(vectors, 2) if length[a] and length[b] and (c := sum(1 / count[f] for f in set(vectors[a]) & set(vectors[b])) / (length[a] * length[b])) >= 0.3}
    assert got.keys() == want.keys() and got and all(got[k] == pytest.approx(want[k]) for k in want)
    assert {(r["a"], r["b"]) for r in names.cosine_pairs(df, 0.3, most_partners=1).collect()} < got.keys()


def test_rounds_over_the_cluster_link_as_one_task_does(spark):
    rng = random.Random(12)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(220)}
    edges = [(a, b, rng.choice([300_000, 500_000, 800_000, 800_000])) for a, b in sorted(pairs)]
    mass = {k: rng.choice([1, 1, 2]) for k in range(60)}
    df = spark.createDataFrame([(a, b, s, mass[a], mass[b]) for a, b, s in edges], "a bigint, b bigint, similarity bigint, mass_a bigint, mass_b bigint")
    want = names.link(edges, mass)
    assert {r["id"]: r["cluster"] for r in names.link_in_rounds(df).collect()} == want and len(set(want.values())) > 3


def test_links_come_from_the_cosine_join(spark, monkeypatch):
    """Without the pairs of the join nothing is linked but equal names, in large sets and small ones alike."""
    listed = ["Johannes Fenprupel", "Johanes Fenprupel", "J. Fenprupel", "johannes_fenprupel", "Clara Velzankva", "Clara Velzankav"]
    df = spark.createDataFrame([(k, "n", x) for k, x in enumerate(listed)], "id bigint, namespace string, name string")
    pairs = lambda: {tuple(r) for r in names.name_pairs(names.linked_names(df, [])).collect()}
    want = set(itertools.combinations(range(4), 2)) | {(4, 5)}
    assert pairs() == want
    monkeypatch.setattr(names, "LINKS_AT_ONCE", 0)
    assert pairs() == want
    joined = names.cosine_pairs
    monkeypatch.setattr(names, "cosine_pairs", lambda v: joined(v).where("false"))
    assert pairs() == {(0, 3)}


# 8 encoding


@pytest.fixture(scope="module")
def reference_encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_ids_equal_the_library(reference_encoder, texts):
    encoder = bpe.PairIndexEncoder()
    assert encoder.encode(texts) == [reference_encoder.encode_ordinary(t) for t in texts]
    assert encoder.count(texts).tolist() == [len(x) for x in encoder.encode(texts)]


def test_ids_of_special_and_empty_texts(spark, reference_encoder):
    texts = ["<|endoftext|>", "", None, "a" * 20_000, " \n\t ", "é漢字🎉 won't"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_ids(df, "doc_id", "text").collect()}
    assert got == {k: reference_encoder.encode_ordinary(t or "") for k, t in enumerate(texts)}


# 9 packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_fills_no_container_too_much(items):
    lengths, counts = np.unique(np.array(items, np.int64), return_counts=True)
    todo = packing.plan(lengths, counts, 64)
    fill = np.zeros(int((todo["container"] + todo["n"]).max()) if len(todo) else 0, np.int64)
    for length, _, n, box in todo.itertuples(index=False):
        fill[box : box + n] += length
    assert (fill <= 64).all() and (fill > 0).all() and fill.sum() == sum(items)
    assert len(fill) <= 2 * sum(items) / 64 + 1  # at most one container is half empty


def test_plan_is_close_to_the_lower_bound():
    rng = np.random.default_rng(7)
    items = np.minimum(2048, rng.lognormal(5.5, 1.2, 20_000).astype(int) + 1)
    lengths, counts = np.unique(items, return_counts=True)
    todo = packing.plan(lengths, counts)
    assert int((todo["container"] + todo["n"]).max()) <= 1.005 * items.sum() / 2048 + 1


def test_every_item_has_its_place(spark):
    sizes = [(k, n) for k, n in enumerate([5, 2048, 5000, 4096, 0, 7, 7, 7] + [300] * 500)] + [(900, None)]
    got = packing.pack(spark.createDataFrame(sizes, "id bigint, n bigint"), "id", "n").collect()
    assert {r["id"] for r in got} == {k for k, n in sizes if n}
    fill, by = {}, {}
    for r in got:
        fill[r["container"]] = fill.get(r["container"], 0) + r["length"]
        by.setdefault(r["id"], []).append((r["begin"], r["length"]))
    assert max(fill.values()) <= 2048 and set(fill) == set(range(len(fill)))
    for k, n in sizes:
        if n:
            assert sum(x for _, x in by[k]) == n and (len(by[k]) == 1) == (n <= 2048)
    assert packing.pack(spark.createDataFrame([], "id bigint, n bigint"), "id", "n").count() == 0


# 10 quality

PROSE = "We decided to keep the old index, because the new one was not ready. It is not clear why the scan took so long. After lunch the team had another look at it."
CASES = {
    "prose": [PROSE, PROSE.lower().replace(".", "").replace(",", ""), "\n".join(PROSE[k : k + 40] for k in range(0, len(PROSE), 40)), PROSE + "\n\n| a | b |\n|---|---|\n| 1 | 2 |", "# Title\n\n" + PROSE, "次に索引を確認した。検索結果が古かったため、記憶を更新した。"],
    "list": ["\n".join(f"- item {k}" for k in range(20)), "\n".join(f"key{k}: value {k}" for k in range(20)), "\n".join(["old index", "new scan", "large table"] * 5), "\n".join(f"{k}. Sorting the index for the team." for k in range(9)), ", ".join(["old index", "new scan", "large table"] * 6)],
    "table": ["\n".join(f"{k},2024-01-0{k % 9},0.{k}" for k in range(12)), "\n".join(f"| {k} | x | y |" for k in range(12)), "\n".join(f"{k}\tx\ty" for k in range(12)), "\n".join(f"<tr><td>{k}</td><td>b</td></tr>" for k in range(9)), "\n".join(f"{k:<12}{k * 7:<12}{k * 3}" for k in range(12))],
    "junk": ["=" * 80, "asdf jkl; asdf jklj fdsa jkl fjdk slaf jdks alfj dksa lfjd ksal fjdk slaf jdk", "#$%^&*()!@" * 9, "ok ok ok ok ok ok ok ok ok ok ok ok ok", "xqzvb" * 60, "Vu ciha jyda giju dyzuce. Fijemupe fycu tony mu gada digiha zecuge bapyjuly."],
    "empty": [None, "", " \n\t "],
}


def test_kinds_of_texts(spark):
    common = [("en", w) for w in "the of and to a in is was it we not one had at because after so why another".split()] + [("ja", w) for w in "がをにはのとも"] + [(None, "that"), ("en", None)]
    rows = [(k * 100 + j, t, kind) for k, (kind, texts) in enumerate(CASES.items()) for j, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, 1) for i, t, _ in rows], "doc_id bigint, text string, kind int")
    got = {r["doc_id"]: r for r in quality.text_statistics(df, "doc_id", "text", common).collect()}
    assert [(i, got[i]["kind"], t) for i, t, kind in rows if got[i]["kind"] != kind] == []
    assert got[0]["word_count"] == len(PROSE.split()) and got[0]["line_end_punct_share"] == 1.0 and 0 < got[0]["symbol_ratio"] < 0.1
    assert quality.text_statistics(df.where("false"), "doc_id", "text", common).count() == 0


TOPICS = ["the old index", "one slow scan of the archive", "memory of the first team", "a table nobody reads", "what the nightly job writes", "names in the large graph"]


def test_layout_alone_shows_lists_and_tables():
    rng = random.Random(8)
    outline = "\n".join("    " * min(2, k % 4) + " ".join([rng.choice(TOPICS).capitalize(), "and", rng.choice(TOPICS), "with"[: 4 * (k % 2)], rng.choice(TOPICS)[: 30 * (k % 2)]]).rstrip() for k in range(24))
    rows = "\n".join(f"{rng.randrange(1000):04} {rng.choice(['north', 'south'])} {rng.choice(['open', 'shut', 'held'])} {rng.randrange(100):03} {rng.choice(['Anna', 'Jens'])} {rng.randrange(100):03} {rng.choice(['scan', 'sort'])} {rng.randrange(1000):04}" for _ in range(20))
    common = frozenset("the of and to a in is was it we not one had at because after so why another".split())
    assert [quality.examine(x, common, [])[-1] for x in (outline, rows)] == ["list", "table"]
    bare = (PROSE.lower().replace(".", "").replace(",", "") + " ") * 4
    wrapped = textwrap.wrap(bare, 50)
    indented = ["    " * (k % 3 > 0) + x for k, x in enumerate(wrapped)]
    code = ["for k in range(9) if not total[k] > most and not done(k):", "    total[k] += f(x, k) * weight[k] - g(x, k) * weight[k + 1]", "    if total[k] > most and not done(k) and k < 9 and x > 0:", "        most, last = total[k] + offset, k if k > 0 else (x, 0)"] * 4
    assert [quality.examine("\n".join(x), common, [])[-1] for x in (wrapped, indented, code, [PROSE[:60], "   " + PROSE[60:]] * 4)] == ["prose"] * 4


def test_junk_behind_an_ordinary_word():
    rng = random.Random(6)
    struck = " ".join("".join(rng.choice("asdfghjkleriouwtn") for _ in range(rng.randrange(3, 9))) for _ in range(120))
    common = frozenset("the of and to a in is was it we not one had at because after so why another".split())
    assert [quality.examine(x, common, [])[-1] for x in (struck, "the " + struck, PROSE)] == ["junk", "junk", "prose"]


def test_layout_scores_decide_what_is_mixed(monkeypatch):
    common = frozenset("the of and to a in is was it we not one had at because after so why another".split())
    even = [f"- {'scan' if k % 2 else 'sort'} the index of part {k:02}" for k in range(14)]
    prose = textwrap.wrap((PROSE + " ") * 3, 90)
    listed = sum(len(x.replace(" ", "")) for x in even)
    body = prose[: next(k for k in range(len(prose)) if sum(len(x.replace(" ", "")) for x in prose[: k + 1]) > 1.05 * listed) + 1]
    text = "\n".join(body + even)
    got = quality.examine(text, common, [])
    assert got[-1] == "list" and got[-2] > 0.5
    monkeypatch.setattr(quality, "LAYOUT_WEIGHT", 0.0)
    assert quality.examine(text, common, [])[-1] == "prose"
