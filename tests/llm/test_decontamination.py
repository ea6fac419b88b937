"""Benchmark decontamination against a plain scan."""

import random
import re
import string

import pytest
from pyspark.sql import functions as F

from touchline.llm import decontamination

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, size=10):
    windows = set()
    for item, text in items:
        words = words_of(text)
        n = min(len(words), size)
        windows |= {(str(item), tuple(words[i : i + n])) for i in range(len(words) - n + 1) if n}
    found = {}
    for doc, text in docs:
        words, hit, named = words_of(text), set(), set()
        for item, window in windows:
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit |= set(range(i + 1, i + len(window) + 1))
                    named.add(item)
        found[doc] = (len(words), sorted(hit), sorted(named))
    return found


@pytest.fixture
def tables(spark):
    def build(docs, items):
        return (
            spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(items, "item_id long, text string"),
        )

    return build


def marked_of(tables, docs, items, **conf):
    frame, benchmark = tables(docs, items)
    return decontamination.mark(frame, decontamination.contaminated_spans(frame, benchmark, **conf))


def got(marked):
    rows = marked.collect()
    assert all(r.n_hit == len(r.covered) and r.n_items == len(r["items"]) and r.contaminated == (r.n_hit > 0) for r in rows)
    return {r.doc_id: (r.n_words, list(r.covered), list(r["items"])) for r in rows}


def test_against_a_plain_scan(tables, monkeypatch):
    draw = random.Random(4)
    names = ["Ab", "c1", "été", "É", "D", "语", "x", "\U0001d54fy"]
    line = lambda n: "".join(draw.choice(names) + draw.choice([" ", "\n", ". ", "\t\x00", "_"]) for _ in range(n))
    items = [(i, line(draw.choice([1, 2, 4, 9, 10, 11, 25]))) for i in range(20)] + [(100, None), (101, ""), (102, "!?"), (2, "x x")]
    docs = []
    for i in range(60):
        parts = [line(draw.randint(0, 40))] + [draw.choice(items)[1] or "" for _ in range(draw.randint(0, 3))]
        draw.shuffle(parts)
        docs.append((i, " ".join(parts)))
    docs += [(200, None), (201, ""), (202, "... !"), (203, items[3][1].upper())]
    truth = plain(docs, items)
    assert got(marked_of(tables, docs, items)) == truth
    monkeypatch.setattr(decontamination, "WINDOWS_PER_PASS", 40)  # a large benchmark takes several passes
    assert got(marked_of(tables, docs, items)) == truth


def test_equal_hashes_are_told_apart(tables, monkeypatch):
    monkeypatch.setattr(decontamination.F, "xxhash64", lambda *columns: F.lit(7).cast("long"))
    docs, items = [(1, "a b c d"), (2, "c d e")], [(1, "b c"), (2, "d e"), (3, "x y")]
    frame, benchmark = tables(docs[:1], items)
    spans = decontamination.contaminated_spans(frame, benchmark).collect()
    assert [(list(s.covered), list(s["items"])) for s in spans] == [([2, 3], ["1"])]


def test_ties_repeats_and_empty_tables(tables):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = [(1, passage), (1, passage), (1, "other words"), (None, passage), (None, "clean"), (None, None)]
    marked = marked_of(tables, docs, [(9, passage), (9, passage), (10, passage)])
    rows = sorted((r.doc_id or 0, r.n_words, r.n_hit, tuple(r["items"])) for r in marked.collect())
    both = ("10", "9")
    assert rows == [(0, 0, 0, ()), (0, 1, 0, ()), (0, 12, 12, both), (1, 2, 0, ()), (1, 12, 12, both), (1, 12, 12, both)]
    assert marked_of(tables, [], [(1, passage)]).isEmpty()
    assert got(marked_of(tables, [(1, passage)], [])) == {1: (12, [], [])}
    assert got(marked_of(tables, [(1, passage)], [(1, "?"), (2, None)])) == {1: (12, [], [])}


def test_very_long_text_and_clashing_columns(spark, tables):
    passage = " ".join(f"w{i}" for i in range(30))
    text = "a b " * 150_000 + passage + " c" * 10
    frame = spark.createDataFrame([(1, text, "s", 5, "z")], "doc_id long, text string, items string, n_hit int, window string")
    _, benchmark = tables([], [(1, passage)])
    benchmark = benchmark.withColumn("length", F.lit(1)).withColumn("key", F.lit("k"))
    row = decontamination.mark(frame, decontamination.contaminated_spans(frame, benchmark)).first()
    assert (row.n_words, row.n_hit, row["items"], row.window) == (300_040, 30, ["1"], "z")


def test_removal(tables):
    passage = "One two three. Four"
    docs = [(1, f"Keep, {passage}; and this {passage}"), (2, passage), (3, "clean text\n"), (4, None), (5, "x one two three four one two three four y")]
    marked = marked_of(tables, docs, [(1, "one two three four")])
    spans = {r.doc_id: r.text for r in decontamination.remove(marked).collect()}
    assert spans == {1: "Keep; and this", 2: "", 3: "clean text\n", 4: None, 5: "x y"}
    rest = {r.doc_id for r in decontamination.remove(marked, most_share=0.9).collect()}
    assert rest == {1, 3, 4, 5}
    assert {r.doc_id for r in decontamination.remove(marked, "documents").collect()} == {3, 4}
    with pytest.raises(ValueError):
        decontamination.remove(marked, "lines")


def test_main_path_is_native(tables):
    frame, benchmark = tables([(1, "a b")], [(1, "a b")])
    spans = decontamination.contaminated_spans(frame, benchmark)
    plan = decontamination.remove(decontamination.mark(frame, spans))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
