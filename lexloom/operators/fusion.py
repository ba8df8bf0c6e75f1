"""Putting hit lists together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.bm25 import ranked
from lexloom.streaming.ingest import kept

#: so many sections are sent to all tasks at most, so that the chunks needn't be shuffled
SENT = 100_000


def rrf(lists: list[DataFrame], *, query: str = "qid", id: str = "doc_id", k: int = 5, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query, id, rank) lists; a list without a hit adds nothing."""
    hits = reduce(DataFrame.unionByName, [h.select(query, id, "rank") for h in lists])
    return ranked(hits.groupBy(query, id).agg(F.sum(1 / (constant + F.col("rank"))).alias("score")), query=query, id=id, k=k, digits=9)


def first_of_each(rows: DataFrame, keys: list[str], position: list[Column]) -> DataFrame:
    """The first row of each key by position, whatever the partitioning."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*position))).where("__n = 1").drop("__n")


def merged_pool(pools: list[DataFrame], *, query: str = "qid", id: str = "doc_id") -> DataFrame:
    """The hits of all passes; of a repeated one, the earliest, in order of pass and rank."""
    marked = reduce(DataFrame.unionByName, [p.withColumn("pass", F.lit(n)) for n, p in enumerate(pools)])
    return first_of_each(marked, [query, id], [F.col("pass"), F.col("rank")])


def with_sections(hits: DataFrame, chunks: DataFrame, *, query: str = "qid", most: int = 50) -> DataFrame:
    """(query, chunk_id, via): the hits, and for those that are summaries of a section the section's chunks.

    hits: (query, chunk_id). A section is named by book, chapter and section, the last not empty.
    """
    section = ["book_id", "chapter_title", "section_title"]
    summary = F.coalesce("is_summary", F.lit(False))
    named = kept(hits.join(chunks.where(summary & (F.coalesce("section_title", F.lit("")) != "")).select("chunk_id", *section), "chunk_id").select(query, *section).distinct())
    hit = named.select(*section).distinct()
    order = Window.partitionBy(*section).orderBy("chunk_index", "chunk_id")
    # only the chunks of sections that are hit are numbered
    body = chunks.where(~summary).select("chunk_id", "chunk_index", *section).join(F.broadcast(hit) if hit.limit(SENT + 1).count() <= SENT else hit, section, "left_semi")
    body = body.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most)
    found = named.join(body, section).select(query, "chunk_id", F.lit("section").alias("via")).unionByName(hits.select(query, "chunk_id", F.lit("hit").alias("via")))
    return found.groupBy(query, "chunk_id").agg(F.min("via").alias("via"))


def section_chunks(chunks: DataFrame, book: str, chapter: str, section: str, most: int = 50) -> DataFrame:
    """The first chunks of one section, no summaries, in order."""
    own = (F.col("book_id") == book) & (F.col("chapter_title") == chapter) & (F.col("section_title") == section)
    return chunks.where(own & ~F.coalesce("is_summary", F.lit(False))).orderBy("chunk_index", "chunk_id").limit(most)


def matching(language: str | None = None, books: list[str] | None = None) -> Column:
    """The filter of a search: a language (en or bg, else any) and books (none: all)."""
    found = F.lit(True)
    if language in ("en", "bg"):
        found = found & (F.col("language") == language)
    return found & F.col("book_id").isin(books) if books else found
