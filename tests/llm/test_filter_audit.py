"""Filter audit against applying every order to every document."""

import math
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import filter_audit


def fails_of(docs):
    """Per row the set of failed filters, by plain definitions."""
    out = []
    for doc, text, _ in docs:
        text = text or ""
        for blank in "\t\n\x0b\x0c\r":
            text = text.replace(blank, " ")
        words = [w for w in text.split(" ") if w]
        failed = set()
        if len(words) < 50:
            failed.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            failed.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text):
            failed.add("C")
        if set(text) & set("#$%&*|"):
            failed.add("D")
        same = [d for d, t, _ in docs if (t or "") == (docs[len(out)][1] or "") and None not in (d, doc) and d < doc]
        out.append(failed | ({"E"} if same else set()))
    return out


def plain(docs, good, toxic):
    fails, rows = fails_of(docs), {}
    for part in {s or "" for _, _, s in docs}:
        mine = [(f, d) for f, (d, _, s) in zip(fails, docs) if (s or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, letter in enumerate(order, 1):
                gone, before = [x for x in left if letter in x[0]], left
                left = [x for x in left if letter not in x[0]]
                rows[part, "".join(order), step] = [
                    len(left),
                    len(gone),
                    sum(letter in f for f, _ in mine) - sum(letter in f for f, _ in before),
                    sum(f == {letter} for f, _ in mine),
                    sum(d in good for _, d in gone),
                    sum(d in toxic for _, d in gone),
                ]
                shapley[letter] += len(gone)
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                rows[part, "".join(order), step].append(shapley[letter])
    return rows


DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def got(frame):
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert frame.columns == ["part", "filter_order", "step", *columns]
    return {(r.part, r.filter_order, r.step): [r[c] for c in columns] for r in frame.collect()}


def test_against_applying_every_order(spark):
    draw = random.Random(5)
    texts = [None, "", "Ab cd", "x " * 60, " ".join(f"w{i}" for i in range(55)), " ".join(f"W{i}" for i in range(70)), "é\x0bà b # " * 30]
    texts += [" ".join(draw.choice(["a", "B", "c", "d%"] + [f"v{i}" for i in range(80)]) for _ in range(n)) for n in (49, 50, 51, 90)]
    docs = [(i, draw.choice(texts), draw.choice(["s1", "s2", "", None])) for i in range(60)]
    docs += [(7, texts[3], "s3"), (7, texts[3], "s3"), (None, texts[4], "s1"), (None, texts[4], "s1")]  # repeated and null ids
    good, toxic = {i for i in range(0, 60, 3)}, {i for i in range(0, 60, 4)}
    labels = [(i, int(i in good), int(i in toxic)) for i in range(58)] + [(3, 0, None), (3, None, None), (59, None, 1), (None, 1, 1), (900, 1, 1)]
    good, toxic = {i for i in good if i < 58}, {i for i in toxic if i < 58} | {59}
    frame = filter_audit.audit_documents(spark.createDataFrame(docs, DOCS).withColumn("part", F.lit("x")).withColumn("good", F.lit(1)), spark.createDataFrame(labels, LABELS))
    assert got(frame) == plain(docs, good, toxic)


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit_documents(none, labels).isEmpty()
    found = got(filter_audit.audit_documents(spark.createDataFrame([(1, None, None)], DOCS), labels))
    assert len(found) == 600 and found["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120] and found["", "BCDEA", 5] == [0, 1, 0, 1, 0, 0, 120]


def test_very_long_text(spark):
    docs = [(1, "word " * 400_000, "s")]
    found = got(filter_audit.audit_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS)))
    assert found["s", "ABCDE", 2][:2] == [0, 1]


def test_min_plus_product_and_shapley_sums():
    fails = np.array([[0, np.inf, 0], [np.inf, np.inf, np.inf]])
    assert filter_audit.removal_steps(fails, np.array([[3, 1, 2], [1, 2, 3]])).tolist() == [[2, 1], [math.inf, math.inf]]
    for letters in ("A", "XYZ"):
        tables = filter_audit.Orders(letters).tables()
        removed = tables["removed"].sum(axis=1).reshape(-1)
        assert removed.tolist() == [0, *[math.factorial(len(letters))] * (2 ** len(letters) - 1)]  # every order removes a failing mask once


def test_own_filters_and_null_conditions(spark):
    rows = spark.createDataFrame([(1, None, "p"), (5, True, "p"), (9, False, None)], "x int, flag boolean, p string")
    found = filter_audit.audit(rows, {"X": F.col("x") > 4, "F": F.col("flag")}, F.col("p"), {"odd": F.col("x") % 2 == 1})
    cells = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.odd_lost, r.shapley) for r in found.collect()}
    assert cells == {
        ("p", "XF", 1): (1, 1, 0, 0, 1, 1), ("p", "XF", 2): (1, 0, 1, 0, 0, 1),
        ("p", "FX", 1): (1, 1, 0, 0, 1, 1), ("p", "FX", 2): (1, 0, 1, 0, 0, 1),
        ("", "XF", 1): (0, 1, 0, 1, 1, 2), ("", "XF", 2): (0, 0, 0, 0, 0, 0),
        ("", "FX", 1): (1, 0, 0, 0, 0, 0), ("", "FX", 2): (0, 1, 0, 1, 1, 2),
    }
    with pytest.raises(ValueError):
        filter_audit.audit(rows, {c: F.lit(True) for c in "ABCDEFGH"}, F.col("p"))
