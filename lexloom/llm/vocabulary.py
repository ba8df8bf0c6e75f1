"""Problem 1: how often every distinct term occurs, and in how many records.

Rules for odd input, covered by tests: rows with a null record, a null or blank term, or a count
that is null or below one don't count; rows alike in all three columns count once; an empty table gives
an empty result; columns other than the three named ones are ignored, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def fold_term(term: str) -> str:
    """Composed, in lower case, without format characters and surrounding white space."""
    if not term.isascii():
        term = "".join(c for c in unicodedata.normalize("NFC", term) if unicodedata.category(c) != "Cf")
        return unicodedata.normalize("NFC", term.strip().lower()).strip()
    return term.strip().lower()


@F.pandas_udf(StringType())
def fold_terms(terms: pd.Series) -> pd.Series:
    """``fold_term`` of every distinct value of an Arrow batch; null stays null."""
    codes, distinct = pd.factorize(terms, use_na_sentinel=True)
    folded = pd.Series([*(fold_term(t) for t in distinct), None], dtype=object)
    return folded.iloc[codes].reset_index(drop=True)


def _folded_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(record, raw, n, term) of each batch, rows that are alike once."""
    for rows in batches:
        rows = rows.drop_duplicates(ignore_index=True)
        codes, distinct = pd.factorize(rows["raw"])
        rows["term"] = np.array([fold_term(t) for t in distinct] + [""], dtype=object)[codes]
        yield rows[rows["term"] != ""]


def term_frequencies(counts: DataFrame, *, record: str = "book_id", term: str = "term", count: str = "document_frequency") -> DataFrame:
    """(term, occurrences, records) of each folded term over all (record, term, count) rows.

    Rows that are alike are dropped in each batch of a map task, so that a row repeated without end shuffles little.
    One shuffle by term and record drops the rest of them and sums the spellings of a term in a record; the sum over
    records combines by hash inside the tasks again, so a term that holds a third of all rows reaches its reducer as
    one row per task.
    """
    kind = dict(counts.dtypes)[record]
    rows = counts.select(F.col(record).alias("record"), F.col(term).alias("raw"), F.col(count).cast("long").alias("n"))
    rows = rows.where("record is not null and raw is not null and n >= 1").mapInPandas(_folded_batches, f"record {kind}, raw string, n long, term string")
    distinct = rows.repartition("term", "record").dropDuplicates(["record", "term", "raw", "n"])
    return distinct.groupBy("term", "record").agg(F.sum("n").alias("n")).groupBy("term").agg(F.sum("n").alias("occurrences"), F.count("*").alias("records"))


def collection_size(stats: DataFrame, *, record: str = "book_id", size: str = "chunk_count", at: str = "updated_at") -> DataFrame:
    """One row ``total``: the sizes of all records, each by its latest row (of equally late ones the largest)."""
    latest = stats.where(F.col(record).isNotNull()).groupBy(record).agg(F.max(F.struct(F.col(at).alias("at"), F.col(size).alias("size"))).alias("last"))
    return latest.agg(F.coalesce(F.sum("last.size"), F.lit(0)).cast("long").alias("total"))


def frequency_mark(occurrences: Column, total: Column, *, rare: int = 1, common_share: float = 0.2) -> Column:
    """``rare`` up to ``rare`` occurrences, ``common`` above ``common_share`` of ``total``, else null. Rare comes first."""
    return F.when(occurrences <= rare, "rare").when(occurrences > common_share * total, "common")


def marked_frequencies(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """``term_frequencies`` with the collection size and the mark; the size is a scalar subquery, no join."""
    total = collection_size(stats).scalar()
    return term_frequencies(counts).withColumn("total", total).withColumn("mark", frequency_mark(F.col("occurrences"), F.col("total")))


def vocabulary_frequencies(vocab: DataFrame, counts: DataFrame, stats: DataFrame) -> DataFrame:
    """Each folded term of a stored vocabulary with its frequencies, zero where it no longer occurs."""
    stored = vocab.where("term is not null").select(fold_terms("term").alias("term")).where("term != ''").distinct()
    zero = F.coalesce(F.col("occurrences"), F.lit(0))
    return (
        stored.join(marked_frequencies(counts, stats), "term", "left")
        .select("term", zero.alias("occurrences"), F.coalesce("records", F.lit(0)).alias("records"), F.when(zero == 0, "absent").otherwise(F.coalesce("mark", F.lit("useful"))).alias("mark"))
    )
