"""Problem 3: lines that recur excessively within one source.

A line's key reads runs of blanks and tabs as one blank, runs of ASCII digits as one, and ignores case. How often it
occurs in its source is compared with how often it occurs in the sources that don't repeat it: what is as usual there
is no excess, but a notice that several sources repeat is one in each.

Rules for odd input, covered by tests: null and empty texts have no lines; rows with a null source are left
as they are; repeated rows and copies of a record count once per record position; where all sources repeat a line, or
there is only one, there is nothing to compare with, and the stated share alone decides; an empty table gives an empty
result.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.streaming.ingest import ensure_checkpoints

#: log-likelihood ratios are counted in steps of 1/GRAIN up to TOP, so the histogram has at most GRAIN * TOP rows
GRAIN, TOP = 10, 2000


def line_key(line: Column) -> Column:
    """The text that two lines must share to be the same."""
    trimmed = F.regexp_replace(line, r"^[ \t]+|[ \t]+$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(trimmed, r"[ \t]+", " "), "[0-9]+", "0"))


def lines_of(chunks: DataFrame, *, id: str = "chunk_id", source: str = "book_id", position: str = "chunk_index", text: str = "text", least_letters: int = 12) -> DataFrame:
    """(id, source, position, line_no, key) of every line with enough letters; key is a 64-bit hash."""
    rows = chunks.where(F.col(source).isNotNull() & F.col(text).isNotNull()).select(
        F.col(id).alias("id"), F.col(source).alias("source"), F.col(position).alias("position"), F.posexplode(F.split(text, "\n", -1)).alias("n", "line")
    )
    enough = F.length(F.regexp_replace("line", r"[^\p{L}]+", "")) >= least_letters
    return rows.where(F.length("line") >= least_letters).where(enough).select("id", "source", "position", (F.col("n") + 1).cast("int").alias("line_no"), F.xxhash64(line_key(F.col("line"))).alias("key"))


def log_likelihood(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Dunning's G of k1 out of n1 against k2 out of n2; 0 where the first rate isn't the higher one."""

    def part(k: Column, n: Column, p: Column) -> Column:
        return F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)

    p = (k1 + k2) / (n1 + n2)
    g = 2 * (part(k1, n1, p) + part(n1 - k1, n1, 1 - p) + part(k2, n2, p) + part(n2 - k2, n2, 1 - p))
    return F.when(k1 * n2 > k2 * n1, F.greatest(g, F.lit(0.0))).otherwise(0.0)


def _cut(rate: float):
    def cut(batches):
        """Benjamini-Hochberg over the histogram of G: the least G that is still significant."""
        rows = pd.concat([pd.DataFrame({"step": [], "cells": []}), *batches]).sort_values("step", ascending=False)
        total, seen, least = rows["cells"].sum(), 0, float("inf")
        for step, cells in zip(rows["step"], rows["cells"]):
            seen += cells
            if math.erfc(math.sqrt(step / GRAIN / 2)) <= rate * seen / total:
                least = step / GRAIN
        yield pd.DataFrame({"least": [least]})

    return cut


def _kept_lines(chunks: DataFrame, **columns: str) -> DataFrame:
    """``lines_of`` in a checkpoint, as it is read for the cells and for the rows: numbers only, no text."""
    ensure_checkpoints(chunks.sparkSession)
    return lines_of(chunks, **columns).checkpoint()


def _excess(chunks: DataFrame, lines: DataFrame, rate: float, floor: int, *, source: str = "book_id", position: str = "chunk_index", **_: str) -> DataFrame:
    positions = chunks.where(F.col(source).isNotNull()).select(F.col(source).alias("source"), F.col(position).alias("position"))
    sizes = positions.groupBy("source").agg(F.count_distinct("position").alias("size"))
    cells = lines.groupBy("source", "key", "position").agg(F.lit(1).alias("one")).groupBy("source", "key").agg(F.count("position").alias("hits")).join(sizes, "source")
    repeats = F.col("hits") >= floor
    of_key = cells.groupBy("key").agg(F.sum(F.when(repeats, 0).otherwise(F.col("hits"))).alias("usual"), F.sum(F.when(repeats, F.col("size")).otherwise(0)).alias("repeating"))
    all_positions = sizes.agg(F.sum("size")).scalar()
    k2 = F.col("usual") - F.when(repeats, 0).otherwise(F.col("hits"))
    n2 = all_positions - F.col("repeating") - F.when(repeats, 0).otherwise(F.col("size"))
    counted = cells.where("hits >= 2").join(of_key, "key").select("source", "key", "hits", "size", k2.cast("double").alias("k2"), n2.cast("double").alias("n2"))
    g = log_likelihood(F.col("hits").cast("double"), F.col("size").cast("double"), F.col("k2"), F.col("n2"))
    tested = counted.select("source", "key", "hits", "size", F.when(F.col("n2") > 0, g).otherwise(float("inf")).alias("g")).checkpoint()
    steps = tested.groupBy(F.floor(F.least(F.col("g") * GRAIN, F.lit(float(GRAIN * TOP)))).alias("step")).agg(F.count("*").alias("cells"))
    least = steps.coalesce(1).mapInPandas(_cut(rate), "least double").scalar()
    return tested.where(F.col("g") >= least)


def excess_cells(chunks: DataFrame, *, floor: int = 5, rate: float = 0.01, **columns: str) -> DataFrame:
    """(source, key, hits, size, g) of every line whose frequency in its source is a significant excess.

    A cell is a line within a source, counted in distinct positions; those that occur twice or more are tested. The
    log-likelihood ratio compares the cell's rate with the line's rate in all other sources that don't repeat it
    ``floor`` times. Benjamini and Hochberg's procedure at ``rate`` over all tested cells picks the significant ones.
    """
    return _excess(chunks, _kept_lines(chunks, **columns), rate, floor, **columns)


def repeated_lines(chunks: DataFrame, *, share: float = 0.05, floor: int = 5, rate: float = 0.01, **columns: str) -> DataFrame:
    """(id, source, line_no) of the lines to remove: significant excess that also reaches ``share`` and ``floor``."""
    lines = _kept_lines(chunks, **columns)
    excess = _excess(chunks, lines, rate, floor, **columns).where((F.col("hits") >= floor) & (F.col("hits") >= share * F.col("size")))
    return lines.join(excess.select("source", "key"), ["source", "key"], "left_semi").select("id", "source", "line_no")


def without_repeated_lines(chunks: DataFrame, *, text: str = "text", **rules) -> DataFrame:
    """The rows with ``clean_text``: their lines without the repeated ones, in order.

    Only rows that lose a line are taken apart: their lines without those to remove (an anti-join on row and line
    number) are put together again by position. Rows that are alike each get their text.
    """
    ensure_checkpoints(chunks.sparkSession)
    base = chunks.withColumn("__row", F.monotonically_increasing_id()).checkpoint()  # the numbers must stay
    gone = repeated_lines(base, **{**rules, "id": "__row", "text": text}).select(F.col("id").alias("__row"), "line_no").checkpoint()
    touched = gone.select("__row").distinct()
    lines = base.select("__row", F.col(text).alias("__text")).join(touched, "__row", "left_semi").select("__row", F.posexplode(F.split("__text", "\n", -1)).alias("n", "line"))
    kept = lines.select("__row", (F.col("n") + 1).alias("line_no"), "line").join(gone, ["__row", "line_no"], "left_anti")
    whole = kept.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    clean = touched.join(whole, "__row", "left").select("__row", F.coalesce(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("")).alias("__clean"))
    return base.join(clean, "__row", "left").withColumn("clean_text", F.coalesce("__clean", F.col(text))).drop("__row", "__clean")
