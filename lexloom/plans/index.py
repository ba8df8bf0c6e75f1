"""Indexing books: everything a search needs, from their markdown."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.ids import guid, point_key
from lexloom.functions.text import outline, path_parts
from lexloom.operators import bm25, chunker, dictionary, store
from lexloom.streaming.ingest import ensure_checkpoints


@dataclass(frozen=True)
class Index:
    """The tables of an index. Statistics leave the summaries out; postings have every chunk and summary."""

    chunks: DataFrame
    terms: DataFrame
    stats: DataFrame
    weights: DataFrame
    postings: DataFrame
    tags: DataFrame
    outlines: DataFrame


def index(books: DataFrame, illnesses: DataFrame, *, book: str = "book_id", text: str = "text", least: int = 2) -> Index:
    """books: (book, text). The vocabulary is complete before any chunk is weighed, as two stages of one plan.
    Words in fewer than ``least`` chunks have no weight."""
    ensure_checkpoints(books.sparkSession)
    cut = chunker.markdown_chunks(books.select(F.col(book).alias("book_id"), F.col(text).alias("text")), id="book_id").checkpoint()  # all tables follow from it
    summaries = chunker.section_summaries(cut).select("book_id", "chunk_index", "path", F.lit("text").alias("type"), "text", F.lit(True).alias("is_summary"))
    every = cut.select("book_id", "chunk_index", "path", "type", "text", F.lit(False).alias("is_summary")).unionByName(summaries)
    chapter, section = path_parts(F.col("path"))
    chunks = every.select(guid(point_key(F.col("book_id"), F.col("chunk_index"), F.col("is_summary"))).alias("chunk_id"), "book_id", "chunk_index", chapter.alias("chapter_title"), section.alias("section_title"), F.col("type").alias("content_type"), "text", "is_summary")
    terms, stats = bm25.book_terms(cut), bm25.book_stats(cut)
    weights = bm25.idf(bm25.vocabulary(terms), stats, least=least)
    tags = dictionary.tagged(chunks.where("not is_summary"), dictionary.names(illnesses))
    return Index(chunks, terms, stats, weights, bm25.postings(chunks, weights, id="chunk_id", keep=("book_id",)), tags, books.select(F.col(book).alias("book_id"), outline(F.col(text)).alias("outline")))


def write(made: Index, path: str, *, buckets: int = 64) -> None:
    """Replaces the tables' rows of the books that were indexed; what other books have stays. The weights aren't
    kept: they follow from the terms of all books. Tables lie in ``buckets`` partitions by the hash of the book, of which
    only those with such books are written anew; a path keeps its number of buckets."""
    books = made.outlines.select("book_id").where("book_id is not null").distinct()
    chunk_of = made.chunks.select("chunk_id", "book_id")
    tables = {name: getattr(made, name) for name in ("chunks", "terms", "stats", "postings", "outlines")} | {"tags": made.tags.join(chunk_of, "chunk_id")}
    for name, rows in tables.items():
        _replace(rows.where("book_id is not null"), books, f"{path}/{name}", F.pmod(F.xxhash64("book_id"), F.lit(buckets)).cast("int"))


def _replace(rows: DataFrame, books: DataFrame, path: str, bucket: Column) -> None:
    rows = rows.withColumn("bucket", bucket)
    try:
        old = rows.sparkSession.read.parquet(path)
    except AnalysisException:  # the first time
        pass
    else:
        touched = books.select(bucket.alias("bucket")).distinct()
        # read whole before its place is written
        rows = rows.unionByName(old.join(touched, "bucket", "left_semi").join(books, "book_id", "left_anti").select(*rows.columns).checkpoint())
    store.write_by(rows.repartition("bucket"), path, "bucket")
