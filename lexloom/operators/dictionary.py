"""A bilingual terminology: tagging texts, widening queries, looking terms up.

Dictionaries are (code, name_en, name_bg), with aliases apart as (code, alias). Matching ignores case and knows no
word limits; blank names never match.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import keywords

#: names that go to the tasks at once, about; more are found in several passes
MOST_NAMES = 200_000
#: letters by which terms and names meet
GRAM = 3


def names(illnesses: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(code, name) of all names and aliases that aren't blank, as they are written."""
    rows = illnesses.select(F.upper("icd_code").alias("code"), F.explode(F.array("name_en", "name_bg")).alias("name"))
    if aliases is not None:
        rows = rows.unionByName(aliases.select(F.upper("icd_code").alias("code"), F.col("alias").alias("name")))
    return rows.where("trim(name) != ''").distinct()


def tagged(texts: DataFrame, entries: DataFrame, *, id: str = "chunk_id", text: str = "text", most: int = MOST_NAMES) -> DataFrame:
    """(id, codes): the sorted codes of all names that a text contains. Texts without any aren't listed.

    The names go to the tasks as one automaton, which finds them all in one pass over a text. More than ``most`` names
    are split by hash into several automata, one pass each, whose hits of a row are put together.
    """
    names_ = entries.select("code", F.lower("name").alias("name"))
    passes = math.ceil(names_.count() / most) or 1
    if passes == 1:
        return _tagged(texts, names_, id, text)
    rows = texts.select(F.col(id).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    numbered = rows.select(F.struct("row", "id").alias("key"), "text")
    hits = [_tagged(numbered, names_.where(F.pmod(F.xxhash64("name"), F.lit(passes)) == n), "key", "text") for n in range(passes)]
    codes = reduce(DataFrame.unionByName, hits).groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"))
    return codes.select(F.col("key.id").alias(id), "codes")


def _tagged(texts: DataFrame, names_: DataFrame, id: str, text: str) -> DataFrame:
    codes: dict[str, set[str]] = {}
    for r in names_.collect():
        codes.setdefault(r["name"], set()).add(r["code"])

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name, own in codes.items():
            automaton.add_word(name, own)
        if codes:
            automaton.make_automaton()
        for part in batches:
            at, found = [], []
            for n, low in enumerate(part["low"]):
                hit: set[str] = set()
                for _, own in automaton.iter(low) if codes else ():
                    hit |= own
                if hit:
                    at.append(n)
                    found.append(sorted(hit))
            if at:
                yield part.iloc[at][["id"]].assign(codes=found)

    kind = texts.schema[id].dataType.simpleString()
    low = texts.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.lower(text).alias("low"))
    return low.mapInPandas(find, f"id {kind}, codes array<string>").withColumnRenamed("id", id)


def expanded(queries: DataFrame, entries: DataFrame, *, query: str = "qid", text: str = "text") -> DataFrame:
    """(query, term, pos): the query, its keywords, and all names of every entry that one of them names.

    Terms that differ in case only count once, by the earliest: the query, then keywords, then names.
    """
    own = queries.where(F.col(text).isNotNull()).select(query, F.posexplode(F.concat(F.array(F.col(text)), keywords(F.col(text)))).alias("pos", "term"))
    keyed = entries.withColumn("low", F.lower("name"))
    named = own.withColumn("low", F.lower("term")).join(keyed.select("low", "code"), "low").select(query, "code").distinct()
    added = named.join(entries, "code").select(query, F.lit(1 << 20).alias("pos"), F.col("name").alias("term"))
    first = own.unionByName(added).groupBy(query, F.lower("term").alias("low")).agg(F.min(F.struct("pos", "term")).alias("f"))
    return first.select(query, F.col("f.term").alias("term"), F.col("f.pos").alias("pos"))


def looked_up(codes: DataFrame, illnesses: DataFrame, *, code: str = "icd_code", aliases: DataFrame | None = None) -> DataFrame:
    """The rows of ``codes`` with the entry of the same code, whatever its case; no entry gives nulls. With aliases
    (icd_code, alias) there is also their sorted array, empty where an entry has none."""
    entry = illnesses.select(F.upper("icd_code").alias("__code"), "name_en", "name_bg")
    if aliases is not None:
        entry = with_aliases(entry, aliases, "__code")
    return codes.join(entry, F.upper(F.col(code)) == F.col("__code"), "left").drop("__code")


def with_aliases(illnesses: DataFrame, aliases: DataFrame, code: str = "icd_code") -> DataFrame:
    """The entries with ``aliases``, the sorted array of those that aren't blank."""
    own = aliases.where("trim(alias) != ''").groupBy(F.upper("icd_code").alias("__own")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return illnesses.join(own, F.upper(F.col(code)) == F.col("__own"), "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))).drop("__own")


def searched(terms: DataFrame, illnesses: DataFrame, *, query: str = "qid", term: str = "term", k: int = 50) -> DataFrame:
    """(query, icd_code, name_en) of the entries whose name contains the term or whose code starts with it, the
    first k by English name. A term meets the names that have its first three letters (or as many as it has), and is
    then looked for in those."""
    entry = illnesses.where("icd_code is not null")
    low = entry.select("icd_code", F.explode(F.filter(F.array(F.lower("name_en"), F.lower("name_bg")), lambda n: F.length(n) > 0)).alias("low"))
    grams = F.transform(F.sequence(F.lit(1), F.length("low")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(GRAM), F.length("low") - i + 1)), lambda n: F.substring("low", i, n)))
    parts = low.select("icd_code", "low", F.lit(False).alias("start"), F.explode(F.array_distinct(F.flatten(grams))).alias("gram"))
    code = F.lower("icd_code")
    starts = F.transform(F.sequence(F.lit(1), F.least(F.lit(GRAM), F.length(code))), lambda n: F.substring(code, F.lit(1), n))
    parts = parts.unionByName(entry.where("icd_code != ''").select("icd_code", code.alias("low"), F.lit(True).alias("start"), F.explode(starts).alias("gram")))
    asked = terms.where(F.trim(term) != "").select(query, F.lower(term).alias("__term")).distinct().withColumn("gram", F.substring("__term", 1, GRAM))
    there = F.when(F.col("start"), F.startswith("low", "__term")).otherwise(F.contains("low", "__term"))
    hits = asked.join(parts, "gram").where(there).select(query, "icd_code").distinct()
    order = Window.partitionBy(query).orderBy("name_en", "icd_code")
    return hits.join(entry.select("icd_code", "name_en"), "icd_code").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select(query, "icd_code", "name_en", "n")
