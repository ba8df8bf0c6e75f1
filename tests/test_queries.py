"""Every core query of the smallest tables runs, and agrees with its SQL where it has one."""

import pytest
from oracle import agree, connect

from lexloom.plans import registry

FOLDER = "/root/testdata/sf0.001"


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
        assert result.columns and result.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["bm25_search_topk", "icd_tags", "markdown_chunks", "dense_topk", "upsert_chunks", "section_summaries"])
def test_empty_tables(spark, tmp_path, name):
    import pyarrow.parquet as pq

    for table in ("chunks", "documents", "embeddings", "illnesses", "books"):
        pq.write_table(pq.read_table(f"{FOLDER}/{table}.parquet").slice(0, 0), tmp_path / f"{table}.parquet")
    assert registry.queries()[name](spark, str(tmp_path)).count() == 0
