"""Every training-data query of the smallest tables runs, and agrees with its SQL where it has one."""

import pytest
from oracle import agree, connect

from lexloom.llm import registry

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["term", "mark"], "p2_found": ["chunk_id", "noise"], "p3_found": ["chunk_id", "line_no"], "p4_found": ["chunk_id"],
    "p5_found": ["chunk_id", "language"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "sent_start", "sent_end"],
}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", registry.queries())
def test_query(spark, con, name):
    query, sql = registry.queries()[name], registry.oracle_sql().get(name)
    if sql:
        agree(spark, con, FOLDER, query, sql)
    else:
        result = query(spark, FOLDER)
        assert result.columns == COLUMNS.get(name, result.columns) and result.count() > 0


@pytest.mark.parametrize("name", registry.queries())
def test_empty_tables(spark, tmp_path, name):
    import pyarrow.parquet as pq

    for table in ("chunks", "documents", "bm25_book_terms", "bm25_book_stats", "bm25_vocab"):
        pq.write_table(pq.read_table(f"{FOLDER}/{table}.parquet").slice(0, 0), tmp_path / f"{table}.parquet")
    pq.write_table(pq.read_table(f"{FOLDER}/mix_targets.parquet"), tmp_path / "mix_targets.parquet")
    rows = registry.queries()[name](spark, str(tmp_path)).count()
    assert rows == (23 if name in ("p7_report", "p7_kept_shares") else 0)
