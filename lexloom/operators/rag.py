"""Retrieval that tries again: a bounded loop over a table of queries.

Every pass searches for the queries whose best score isn't good enough yet, wider each time; its hits join the pool,
which is scored as a whole. All queries go through a pass together. Search and scoring are given as functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import latin_terms, tokens
from lexloom.operators.bm25 import ranked
from lexloom.operators.fusion import first_of_each
from lexloom.streaming.ingest import kept

MOST_PASSES = 5


@dataclass(frozen=True)
class Gates:
    confident: float = 0.0
    answer: float = 1.5
    retry: float = 1.0
    passes: int = 2


@dataclass(frozen=True)
class Pass:
    k: int
    any_language: bool
    longest_term: bool = False


# fixed values: the first pass and how each further one is wider
FIRST = Pass(5, False)
FURTHER = (Pass(10, False), Pass(10, True), Pass(15, False), Pass(15, True), Pass(20, True, True))

#: so many ids of hits are sent to all tasks at most, so that the corpus needn't be shuffled
SENT = 500_000



@dataclass(frozen=True)
class Ahead:
    """Searches of the passes of one loop without terms: those that differ only in k run once, for the greatest k of the
    loop, whose hits begin with those of any smaller one. Later passes ask no query that earlier ones didn't."""

    passes: int
    query: str = "qid"
    found: dict[tuple[bool, bool], DataFrame] = field(default_factory=dict)

    def hits(self, asked: DataFrame, how: Pass, find: Callable[[int], DataFrame]) -> DataFrame:
        """(query, ..., rank) of the first ``how.k`` hits of the queries asked; ``find`` searches for the first k."""
        kind = (how.any_language, how.longest_term)
        if kind not in self.found:
            alike = [p.k for p in (FIRST, *FURTHER[: self.passes]) if (p.any_language, p.longest_term) == kind]
            self.found[kind] = kept(find(max(alike)))
        return self.found[kind].where(F.col("rank") <= how.k).join(asked.select(self.query), self.query, "left_semi")


Search = Callable[[DataFrame, Pass], DataFrame]
Score = Callable[[DataFrame], DataFrame]
Widen = Callable[[DataFrame], DataFrame]


def overlap_score(pairs: DataFrame, *, query_text: str = "query_text", text: str = "text") -> DataFrame:
    """A scorer without a model: the share of the query's words that the text has, from -5 to 5."""
    sought, there = F.array_distinct(tokens(F.col(query_text))), tokens(F.col(text))
    share = F.size(F.array_intersect(sought, there)) / F.greatest(F.size(sought), F.lit(1))
    return pairs.withColumn("score", F.round(share * 10 - 5, 6))


def retrieve(
    queries: DataFrame, corpus: DataFrame, search: Search, score: Score = overlap_score, *, gates: Gates = Gates(), query: str = "qid", id: str = "doc_id", text: str = "text", final: int = 5,
    terms: DataFrame | None = None, widen: Widen | None = None, summary: str | None = None,
) -> DataFrame:
    """(query, id, score, rank, outcome) of up to ``final`` records a query; a query without hits has one row with nulls.

    The first pass asks the query, the further ones every one of its ``terms`` (query, term, pos) by itself, the last
    one the longest of them; without terms all ask the query. ``widen`` adds to the hits of a pass, (query, id), those
    that belong to them. Hits join the pool once, by their earliest pass, term and rank. Where ``summary`` names a
    column of the corpus, records that have it count in the judgement but aren't given.

    outcome: answer; empty (no hits, or none to give); web (best score below ``gates.retry``); refused (below
    ``gates.answer``, or the query has Latin terms of which none is in the first three). The loop ends when every query
    is confident, or after ``gates.passes`` further passes, five at most.
    """
    keep = [c for c in queries.columns if c not in (query, text)]
    given = F.coalesce(F.col(summary), F.lit(False)) if summary else F.lit(False)
    late = F.struct(F.lit(1 << 30).alias("pos"), F.lit("").alias("term"), F.lit(0).alias("rank"))

    def place(pos: Column, term: Column) -> Column:
        return F.struct(pos.cast("int").alias("pos"), term.alias("term"), F.col("rank").cast("int").alias("rank")).alias("place")

    def gathered(active: DataFrame, how: Pass, n: int) -> DataFrame:
        """(query, id, pass, place) of a pass."""
        if n and terms is not None:
            own = active.select(query, *keep).join(terms.select(query, "term", "pos"), query)
            if how.longest_term:
                own = first_of_each(own, [query], [F.length("term").desc(), F.col("pos"), F.col("term")])
            hits = search(own.select(F.struct(query, "pos", "term").alias(query), *keep, F.col("term").alias(text)), how)
            hits = hits.select(F.col(query)[query].alias(query), id, place(F.col(query)["pos"], F.col(query)["term"]))
        else:
            hits = search(active, how).select(query, id, place(F.lit(0), F.lit("")))
        hits = kept(hits.groupBy(query, id).agg(F.min("place").alias("place")))  # the search runs once
        if widen is not None:
            hits = widen(hits.select(query, id)).select(query, id).distinct().join(hits, [query, id], "left").withColumn("place", F.coalesce("place", late))
        return hits.select(query, id, F.lit(n).alias("pass"), "place")

    def of_corpus(ids: DataFrame, *columns: Column) -> DataFrame:
        """The rows of the corpus with these ids."""
        ids = ids.select(id).distinct()
        return corpus.select(id, *columns).join(F.broadcast(ids) if ids.limit(SENT + 1).count() <= SENT else ids, id, "left_semi")

    def scored(hits: DataFrame) -> DataFrame:
        """(query, id, pass, place, summary, score); texts aren't kept."""
        hits = kept(hits)
        pairs = hits.join(queries.select(query, F.col(text).alias("query_text")), query).join(of_corpus(hits, F.col(text), given.alias("summary")), id)
        return kept(score(pairs).select(query, id, "pass", "place", "summary", "score"))

    pool = scored(gathered(queries, FIRST, 0))
    for n, wider in enumerate(FURTHER[: min(gates.passes, MOST_PASSES)], start=1):
        best = pool.groupBy(query).agg(F.max("score").alias("best"))
        # too weak for another try, or good enough already
        active = kept(queries.join(best.where((F.col("best") >= gates.retry) & (F.col("best") < gates.confident)).select(query), query, "left_semi"))
        if active.isEmpty():
            break
        more = gathered(active, wider, n).join(pool.select(query, id), [query, id], "left_anti")
        pool = pool.unionByName(scored(more))
    order = pool.withColumn("__id", F.struct("pass", "place", id))
    seen = F.lower(F.concat_ws("\n", F.collect_list(text)))
    three = kept(ranked(order, query=query, id="__id", k=3).select(query, id, "score"))
    first = three.join(of_corpus(three, F.col(text)), id).groupBy(query).agg(seen.alias("seen"), F.max("score").alias("best"))
    listed = ranked(order.where("not summary"), query=query, id="__id", k=final)
    judged = queries.select(query, latin_terms(F.col(text)).alias("latin")).join(first, query, "left").select(
        query,
        F.when(F.col("best").isNull(), "empty")
        .when(F.col("best") < gates.retry, "web")
        .when(F.col("best") < gates.answer, "refused")
        .when((F.size("latin") > 0) & ~F.exists("latin", lambda t: F.contains(F.col("seen"), t)), "refused")
        .otherwise("answer")
        .alias("outcome"),
    )
    whole = judged.join(listed.select(query, id, "score", "rank"), query, "left")
    return whole.select(query, id, "score", "rank", F.when((F.col("outcome") == "answer") & F.col("rank").isNull(), "empty").otherwise(F.col("outcome")).alias("outcome"))


def rewritable(turns: DataFrame, *, conversation: str, position: str, role: str, text: str, query: str) -> DataFrame:
    """(conversation, rewrite): whether a question is short enough and follows on other ones."""
    last = F.max_by(F.when(F.col(role) == "user", F.col(text)), F.when(F.col(role) == "user", F.col(position)))
    seen = turns.groupBy(conversation).agg(F.count("*").alias("n"), last.alias("last"), F.first(query).alias("q"))
    words = F.size(F.filter(F.split("q", " "), lambda w: w != ""))
    return seen.select(conversation, ((words < 20) & (F.col("n") >= 2) & ~F.col("last").eqNullSafe(F.col("q"))).alias("rewrite"))
