"""Registered queries with SQL against DuckDB on the smallest tables; all of them run."""

import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from check_oracle import rows_of  # noqa: E402
from touchline.llm.oracle import ORACLE  # noqa: E402
from touchline.llm.queries import QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6_pii": ["doc_id", "text"],
    "op7_embedding_near_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op9_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op11_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    "op10_nearest_neighbours": ["query_id", "rank", "vec_id", "score"],
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[: -len('.parquet')]} AS SELECT * FROM read_parquet('{path}')")
    frame = QUERIES[name](spark, SF_DIR)
    cursor = db.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    frame = QUERIES[name](spark, SF_DIR)
    assert frame.columns == COLUMNS[name]
    assert not frame.isEmpty()
