"""Reading the given tables, files of books and captured answers of services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.text import html_snippet
from lexloom.functions.web import escaped


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, markdown): one row a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("markdown"))


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, length, valid): valid is whether the file starts like a PDF."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), "length", (F.hex(F.substring("content", 1, 5)) == "255044462D").alias("valid"))


def slug(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[A-Za-z0-9]+$", 1)


def stale(pdfs: DataFrame, markdown: DataFrame) -> DataFrame:
    """The PDF files whose markdown is missing or not newer than they are."""
    made = markdown.select(slug(F.col("path")).alias("slug"), F.col("modified").alias("made"))
    return pdfs.withColumn("slug", slug(F.col("path"))).join(made, "slug", "left").where("made is null or made <= modified").drop("made")


def markdown_of(envelope: Column) -> Column:
    """The markdown in a scanner service's answer: results.<first>.md. Each of the three ways it can be missing
    raises its own error."""
    results = F.from_json(envelope, "results map<string, struct<md: string>>")["results"]
    first = F.get(F.map_values(results), F.lit(0))
    return (
        F.when(results.isNull(), F.raise_error("the answer has no results"))
        .when(F.size(results) == 0, F.raise_error("the answer's results are empty"))
        .when(first["md"].isNull(), F.raise_error("the first result has no markdown"))
        .otherwise(first["md"])
    )


def web_results(answers: DataFrame, *, key: str, body: str, most: int = 5) -> DataFrame:
    """(key, pos, title, url, content, engine) of the first results in captured search answers."""
    parsed = F.from_json(body, "results array<struct<title: string, url: string, content: string, engine: string>>")["results"]
    rows = answers.select(F.col(key), F.posexplode(F.slice(F.coalesce(parsed, F.array().cast("array<struct<title: string, url: string, content: string, engine: string>>")), 1, most)).alias("pos", "r"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.select(key, "pos", F.coalesce(blank(F.col("r.title")), blank(F.col("r.url")), F.lit("Untitled")).alias("title"), F.coalesce("r.url", F.lit("")).alias("url"), F.coalesce("r.content", F.lit("")).alias("content"), F.coalesce(blank(F.col("r.engine")), F.lit("Web")).alias("engine"))


def web_query(query: Column, domains: list[str], language: Column) -> Column:
    """What a search service is asked: the query with its domains as a filter, url-escaped, in en, bg or all."""
    sites = " " + " OR ".join(f"site:{d}" for d in domains) if domains else ""
    code = F.lower(language)
    return F.concat(F.lit("/search?q="), escaped(F.concat(query, F.lit(sites))), F.lit("&format=json&categories=general&language="), F.when(code.isin("bg", "en"), code).otherwise("all"))


def read_sources(results: DataFrame, pages: DataFrame, *, key: str, most: int = 3, text: str = "text") -> DataFrame:
    """(key, pos, title, url, snippet) of the first results with an address whose page has text.

    results: (key, pos, title, url, ...); pages: (url, text). A snippet belongs to the result of its address, wherever
    results without one stand before it; pos numbers the results with an address from 0. The first text of a page counts.
    """
    order = Window.partitionBy(key).orderBy("pos")
    there = results.where("url is not null and url != ''").withColumn("pos", F.row_number().over(order) - 1).where(F.col("pos") < most)
    texts = pages.groupBy("url").agg(F.min(html_snippet(F.col(text))).alias("snippet"))
    return there.join(texts, "url").where(F.trim("snippet") != "").select(key, "pos", "title", "url", "snippet")


def markdown_of_books(pdfs: DataFrame, markdown: DataFrame, made: DataFrame) -> DataFrame:
    """(slug, markdown, cached) of every PDF file: the cached markdown of its name where there is one, else the one
    that was made, (slug, markdown). Files without either have none."""
    books = pdfs.select(slug(F.col("path")).alias("slug")).distinct()
    cached = markdown.select(slug(F.col("path")).alias("slug"), "markdown", F.lit(True).alias("cached"))
    fresh = made.join(cached.select("slug"), "slug", "left_anti").select("slug", "markdown", F.lit(False).alias("cached"))
    return books.join(cached.unionByName(fresh), "slug", "left")


def table_rows(markdown: Column) -> Column:
    """The cells of every table row of a markdown text, without the rules between head and body."""
    rows = F.filter(F.split(markdown, "\n"), lambda l: F.trim(l).startswith("|") & ~F.trim(l).rlike(r"^\|[\s:|-]+\|?$"))
    return F.transform(rows, lambda l: F.transform(F.split(F.regexp_replace(F.trim(l), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))
