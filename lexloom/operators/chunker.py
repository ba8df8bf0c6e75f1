"""Markdown into chunks along its headings.

Clean, cut into lines, give each line the section of the last heading, put the sections together, cut long ones at
sentences, let each chunk start with the end of the one before in its section, join short ones. Everything runs
partitioned by document: one shuffle. Documents without text give no chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import clean_markdown, heading_level, heading_title, line_type, rough_sentences, strip, token_estimate
from lexloom.operators.order import numbered, with_previous

MOST, LEAST, OVERLAP = 512, 50, 512


def sections(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, section, path, type, text) of the sections that aren't blank."""
    lines = docs.where(F.col(text).isNotNull()).select(id, F.posexplode(F.split(clean_markdown(F.col(text)), "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("level", heading_level(F.col("line")))
    upto = Window.partitionBy(id).orderBy("pos")
    lines = lines.withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(upto))
    heads = lines.where("level > 0").groupBy(id).agg(F.array_sort(F.collect_list(F.struct("section", "level", heading_title(F.col("line")).alias("title")))).alias("heads"))
    # the stack is cut by count: a heading of level n stays on at most n - 1 others
    empty = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<struct<section: bigint, path: string>>").alias("out"))

    def push(acc: Column, head: Column) -> Column:
        stack = F.concat(F.slice(acc["stack"], F.lit(1), F.least(F.size(acc["stack"]), head["level"] - 1)), F.array(head["title"]))
        return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(F.struct(head["section"].alias("section"), F.array_join(stack, " > ").alias("path")))).alias("out"))

    paths = heads.select(id, F.explode(F.aggregate("heads", empty, push)["out"]).alias("p")).select(id, "p.section", "p.path")
    body = lines.where("level = 0").withColumn("kind", line_type(F.col("line"))).groupBy(id, "section").agg(
        F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"), F.max_by("kind", F.when(F.col("kind").isNotNull(), F.col("pos"))).alias("kind")
    )
    whole = body.select(id, "section", F.coalesce("kind", F.lit("text")).alias("type"), strip(F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("text"))
    return whole.where("text != ''").join(paths, [id, "section"], "left").select(id, "section", F.coalesce("path", F.lit("")).alias("path"), "type", "text")


def packed(text: Column, most: int = MOST) -> Column:
    """The text in pieces of whole sentences, up to ``most`` estimated tokens; a longer sentence is one piece."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def add(acc: Column, sentence: Column) -> Column:
        full = (token_estimate(acc["now"]) + token_estimate(sentence) > most) & (acc["now"] != "")
        return F.struct(
            F.when(full, F.concat(acc["out"], F.array(strip(acc["now"])))).otherwise(acc["out"]).alias("out"),
            F.when(full, F.concat(sentence, F.lit(" "))).otherwise(F.concat(acc["now"], sentence, F.lit(" "))).alias("now"),
        )

    cut = F.aggregate(rough_sentences(text), start, add, lambda acc: F.when(acc["now"] != "", F.concat(acc["out"], F.array(strip(acc["now"])))).otherwise(acc["out"]))
    return F.when(token_estimate(text) <= most, F.array(text)).otherwise(cut)


def _overlap(path: Column, text: Column, last_path: Column, last: Column, most: int, overlap: int) -> Column:
    room = F.least(F.lit(overlap), F.lit(4 * most - 1) - F.length(text))
    return F.when((last_path == path) & (room > 0), F.concat(F.right(last, room), F.lit("\n"), text)).otherwise(text)


def overlapped(chunks: DataFrame, *, id: str = "doc_id", position: str, then: list[str], most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """Each chunk with the end of the chunk before it, if both are of one path and there is room. The chunks of one
    id may be any share of all rows."""
    rows = with_previous(chunks, id, position, then, ["path", "text"])
    return rows.withColumn("text", _overlap(F.col("path"), F.col("text"), F.col("previous.path"), F.col("previous.text"), most, overlap)).drop("previous")


def joined(chunks: Column, least: int = LEAST) -> Column:
    """An array of (path, text, type) in which a short chunk is put before the next one of its path."""
    item = "struct<path: string, text: string, type: string>"
    start = F.struct(F.array().cast(f"array<{item}>").alias("out"), F.lit(None).cast(item).alias("now"))

    def add(acc: Column, chunk: Column) -> Column:
        now = acc["now"]
        short = now.isNotNull() & (token_estimate(now["text"]) < least) & (now["path"] == chunk["path"])
        both = F.struct(now["path"].alias("path"), F.concat(now["text"], F.lit("\n"), chunk["text"]).alias("text"), now["type"].alias("type"))
        return F.struct(F.when(short | now.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(now))).alias("out"), F.when(short, both).otherwise(chunk).alias("now"))

    return F.aggregate(chunks, start, add, lambda acc: F.when(acc["now"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["now"]))))


def markdown_chunks(docs: DataFrame, *, id: str = "doc_id", text: str = "text", most: int = MOST, least: int = LEAST, overlap: int = OVERLAP) -> DataFrame:
    """(id, chunk_index, path, type, text) of every document."""
    parts = sections(docs, id=id, text=text).select(id, "section", "path", "type", F.posexplode(packed(F.col("text"), most)).alias("part", "text"))
    before = Window.partitionBy(id).orderBy("section", "part")
    laid = parts.withColumn("text", _overlap(F.col("path"), F.col("text"), F.lag("path").over(before), F.lag("text").over(before), most, overlap))
    whole = laid.groupBy(id).agg(F.array_sort(F.collect_list(F.struct("section", "part", "path", "text", "type"))).alias("c"))
    merged = joined(F.transform("c", lambda x: F.struct(x["path"].alias("path"), x["text"].alias("text"), x["type"].alias("type"))), least)
    return whole.select(id, F.posexplode(merged).alias("chunk_index", "m")).select(id, "chunk_index", "m.path", "m.type", "m.text")


def section_summaries(chunks: DataFrame, *, book: str = "book_id", path: str = "path", index: str = "chunk_index", text: str = "text", preview: int = 800) -> DataFrame:
    """(book, path, chunk_index, text): of each named section, its path and the start of its first chunk; numbered on
    from the book's chunks in order of first appearance. They don't count in term statistics."""
    named = chunks.where(F.trim(F.coalesce(path, F.lit(""))) != "")
    first = named.groupBy(book, path).agg(F.min(F.struct(F.col(index).alias("i"), F.substring(text, 1, preview).alias("t"))).alias("f"))
    total = chunks.groupBy(book).agg(F.count("*").alias("__total"))
    placed = numbered(first.withColumn("__i", F.col("f.i")), book, "__i", [path], "__n").join(total, book)
    return placed.select(book, path, (F.col("__total") + F.col("__n") - 1).cast("int").alias("chunk_index"), F.concat(F.col(path), F.lit("\n\n"), F.coalesce("f.t", F.lit(""))).alias("text"))
