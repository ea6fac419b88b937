"""Line dedup against a plain Python definition."""

import random
import zlib

import pyarrow as pa
import pytest

from touchline.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"


def expected(rows, least=10):
    def key(line):
        return "".join(c.lower() if c.isascii() else c for c in line.strip(BLANKS))

    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        order = lambda d: (d is not None, d or 0)
        kept = [x for x in lines if len(key(x)) < least or doc == min(holders[key(x)], key=order)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=repr)


CASES = {
    "nulls and empties": [(1, None), (2, ""), (None, "a line of some length"), (3, "A LINE of some length \nxyz")],
    "ties in a document": [(1, "repeated line here\nrepeated line here"), (2, "\trepeated line HERE\r\nend")],
    "short keys stay": [(1, "123456789"), (2, "123456789"), (3, "ääääääääää"), (4, "ääääääääää"), (5, "äääääääää"), (6, "äääääääää")],
    "repeated ids": [(1, "shared words one"), (2, "shared words one\nother words two"), (2, "other words two"), (2, "shared words one\nother words two")],
    "only ascii folds": [(1, "ÄÄÄ shared LINE"), (2, "äää shared line"), (3, "ÄÄÄ SHARED line")],
}


@pytest.mark.parametrize("name", CASES)
def test_cases(docs_of, name):
    assert got(line_dedup.dedup_lines(docs_of(CASES[name]))) == expected(CASES[name])


def test_random_documents_and_a_hot_line(docs_of):
    random.seed(5)
    lines = [f"line number {i} of the pool" for i in range(40)] + ["short", ""]
    rows = [(i, "\n".join(random.choices(lines, k=random.randint(0, 12)) + ["the line that all documents hold"] * (i % 3 > 0))) for i in range(400)]
    assert got(line_dedup.dedup_lines(docs_of(rows).repartition(7))) == expected(rows)


def test_long_text(docs_of):
    rows = [(1, "\n".join(f"a long document, line {i}" for i in range(30000))), (2, "a long document, line 17\nmine alone, this line")]
    assert got(line_dedup.dedup_lines(docs_of(rows))) == expected(rows)


def test_empty_table(docs_of):
    assert got(line_dedup.dedup_lines(docs_of([]))) == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x", "p", 5, 6)], "doc_id int, text string, part string, n_lines int, bitmap int")
    row = line_dedup.dedup_lines(df).first()
    assert (row.part, row.bitmap, row.n_lines, row.kept_text) == ("p", 6, 1, "x")


def test_bitmaps_hold_positions_not_text(docs_of):
    rows = [(1, "one shared line"), (2, "first\none shared line\nlast")]
    bitmap = line_dedup.keep_bitmaps(docs_of(rows)).collect()
    assert [(r.id, r.part, line_dedup.dropped_lines(r.bitmap)) for r in bitmap] == [(2, zlib.crc32(rows[1][1].encode()), [1])]


@pytest.mark.parametrize("cuts", [[3], [1, 2], [2, 5, 6], [1, 2, 3, 4, 5, 6, 7]])
def test_runs_cut_by_partitions_and_batches(cuts):
    """Every cut of the sorted rows, as partitions and as batches, leads to the same dropped rows."""
    fields = [("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("part", pa.int64()), ("pos", pa.int32())]
    schema = pa.schema(fields)
    rows = [(1, 1, 5, 0, 0), (1, 1, 5, 0, 3), (1, 1, 6, 0, 0), (1, 1, 7, 0, 0), (1, 2, 5, 0, 1), (2, 1, 6, 0, 1), (2, 1, 8, 0, 1), (2, 1, 9, 0, 4)]
    truth = {(6, 0), (7, 0), (8, 1), (9, 4)}
    step = line_dedup._first_document_stays(pa.schema([("kind", pa.int8()), *fields]))
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows[a:b]], schema=schema) for a, b in zip([0, *cuts], [*cuts, len(rows)])]

    def settled(partitions):
        out = [r for p in partitions for batch in step(iter(p)) for r in batch.to_pylist()]
        first = {}
        for r in out:
            if r["kind"] == line_dedup.CLAIM:
                first[r["h1"], r["h2"]] = min(first.get((r["h1"], r["h2"]), r["id"]), r["id"])
        gone = {(r["id"], r["pos"]) for r in out if r["kind"] == line_dedup.DECIDED}
        return gone | {(r["id"], r["pos"]) for r in out if r["kind"] == line_dedup.PENDING and r["id"] > first[r["h1"], r["h2"]]}

    assert settled([[b] for b in batches]) == truth
    assert settled([batches]) == truth
