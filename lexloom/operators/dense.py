"""Nearest neighbours by cosine: exact in blocks, by an index of cells, and by codes.

Exact: points and queries are packed into blocks of bounded size; every block of queries meets every block of points in
some task, as one matrix product, and only each query's best of a block travel on. With an index, every point lies in the
cell of its nearest centre and a query meets the blocks of its nearest cells only; centres are fitted on a bounded sample,
cells of any size are split into blocks. Null vectors have no neighbours; a vector of length zero has cosine 0 with all.
Equal scores rank by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.vectors import cosine
from lexloom.operators.bm25 import ranked

POINTS, QUERIES = 4096, 512


def _packed(rows: DataFrame, id: str, vector: str, label: str | None, size: int, name: str, cell: str | None = None) -> tuple[DataFrame, int]:
    """The rows in blocks of about ``size``, of one cell if there are cells, and their number (of no cell)."""
    item = F.struct(F.col(id).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"), (F.col(label).cast("string") if label else F.lit("")).alias("l"))
    rows, blocks = rows.where(F.col(vector).isNotNull()), 0
    if cell:
        own = rows.groupBy(F.col(cell).alias("__cell")).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int").alias("__blocks"))
        rows = rows.join(own, F.col(cell) == F.col("__cell"))
        of_block, keys = F.pmod(F.xxhash64(id), F.col("__blocks")), [F.col(cell).alias("cell")]
    else:
        blocks = max(1, math.ceil(rows.count() / size))
        of_block, keys = F.pmod(F.xxhash64(id), F.lit(blocks)), []
    packed = rows.groupBy(*keys, of_block.cast("int").alias(f"{name}_block")).agg(F.collect_list(item).alias("items"))
    of = lambda field: F.transform("items", lambda x: x[field])
    return packed.select(*(["cell"] if cell else []), f"{name}_block", of("id").alias(f"{name}_ids"), F.flatten(of("v")).alias(f"{name}_values"), of("l").alias(f"{name}_labels")), blocks


def _best(k: int, same: bool):
    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                ids, queries = np.asarray(r.p_ids), np.asarray(r.q_ids)
                points = np.asarray(r.p_values, dtype=np.float64).reshape(len(ids), -1)
                sought = np.asarray(r.q_values, dtype=np.float64).reshape(len(queries), -1)
                length = np.linalg.norm(sought, axis=1)[:, None] * np.linalg.norm(points, axis=1)[None, :]
                with np.errstate(divide="ignore", invalid="ignore"):
                    scores = np.where(length > 0, sought @ points.T / length, 0.0)
                if same:
                    scores = np.where(np.asarray(r.q_labels)[:, None] == np.asarray(r.p_labels)[None, :], scores, -np.inf)
                rounded = np.round(scores, 6)
                order = np.lexsort((np.broadcast_to(ids, scores.shape), -rounded), axis=1)[:, :k]
                rows_, columns = np.repeat(np.arange(len(queries)), order.shape[1]), order.ravel()
                found = pd.DataFrame({"qid": queries[rows_], "id": ids[columns], "score": scores[rows_, columns]})
                yield found[np.isfinite(found["score"])]

    return best


def top_k(queries: DataFrame, points: DataFrame, *, query: str = "qid", id: str = "vec_id", vector: str = "embedding", label: str | None = None, k: int = 5, digits: int = 6) -> DataFrame:
    """(query, id, score, rank) of the k nearest points of every query; with ``label``, only of the query's label."""
    left, _ = _packed(points, id, vector, label, POINTS, "p")
    right, blocks = _packed(queries, query, vector, label, QUERIES, "q")
    met = left.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(right, "q_block")
    kinds = dict(points.dtypes)[id], dict(queries.dtypes)[query]
    found = met.mapInPandas(_best(k, label is not None), f"qid {kinds[1]}, id {kinds[0]}, score double")
    return ranked(found.withColumnsRenamed({"qid": query, "id": id}), query=query, id=id, k=k, digits=digits)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def centres(points: DataFrame, cells: int, *, id: str = "vec_id", vector: str = "embedding", sample: int = 20_000, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """The centres of ``cells`` cells, by k-means on about ``sample`` vectors, picked by the hash of their ids."""
    there = points.where(F.col(vector).isNotNull())
    every = max(1, math.ceil(there.count() / sample))
    rows = there.where(F.pmod(F.xxhash64(id), F.lit(every)) == 0).select(F.transform(vector, lambda x: x.cast("double")).alias("v")).toPandas()
    if not len(rows):
        return np.zeros((0, 0))
    vectors = _unit(np.array(rows["v"].tolist()))
    draw = np.random.default_rng(seed)
    found = vectors[draw.permutation(len(vectors))[:cells]]
    for _ in range(rounds):
        own = (vectors @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, vectors)
        found = np.where(sums.any(axis=1)[:, None], _unit(sums), found)
    return found


def with_cells(rows: DataFrame, found: np.ndarray, *, vector: str = "embedding", most: int = 1) -> DataFrame:
    """The rows with a vector, once for each of their ``most`` nearest cells."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                scores = _unit(np.array(part[vector].tolist(), dtype=np.float64)) @ found.T
                own = np.argsort(-scores, axis=1, kind="stable")[:, :most]
                yield part.iloc[np.repeat(np.arange(len(part)), own.shape[1])].assign(cell=own.ravel())

    schema = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    return rows.where(F.col(vector).isNotNull()).mapInPandas(near, f"{schema}, cell int")


def indexed_top_k(queries: DataFrame, points: DataFrame, found: np.ndarray, *, query: str = "qid", id: str = "vec_id", vector: str = "embedding", label: str | None = None, k: int = 5, probes: int = 8) -> DataFrame:
    """Like ``top_k``, but a query meets the points of its ``probes`` nearest cells only."""
    left, _ = _packed(with_cells(points.select(id, vector, *([label] if label else [])), found, vector=vector), id, vector, label, POINTS, "p", "cell")
    right, _ = _packed(with_cells(queries.select(query, vector, *([label] if label else [])), found, vector=vector, most=probes), query, vector, label, QUERIES, "q", "cell")
    kinds = dict(points.dtypes)[id], dict(queries.dtypes)[query]
    best = left.join(right, "cell").drop("cell").mapInPandas(_best(k, label is not None), f"qid {kinds[1]}, id {kinds[0]}, score double")
    return ranked(best.withColumnsRenamed({"qid": query, "id": id}), query=query, id=id, k=k)


def recall(exact: DataFrame, other: DataFrame, *, query: str = "qid", id: str = "vec_id") -> DataFrame:
    """One row: (wanted, found) of the neighbours that the exact way gives."""
    hit = other.select(query, id).distinct().withColumn("__hit", F.lit(1))
    return exact.select(query, id).join(hit, [query, id], "left").agg(F.count("*").alias("wanted"), F.count("__hit").alias("found"))


def quantized(points: DataFrame, *, vector: str = "embedding", quantile: float = 0.99) -> DataFrame:
    """The points with ``codes``, their values in steps of 1/127 of the quantile of all absolute values."""
    values = points.select(F.explode(vector).alias("x")).select(F.abs("x").alias("x"))
    scale = values.agg(F.percentile_approx("x", quantile, 10000)).scalar()
    coded = F.transform(vector, lambda x: F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x / F.col("__scale"))) * 127).cast("tinyint"))
    return points.withColumn("__scale", scale).withColumn("codes", coded).drop("__scale")


def rescored_top_k(queries: DataFrame, points: DataFrame, *, query: str = "qid", id: str = "vec_id", vector: str = "embedding", k: int = 5, oversample: int = 2) -> DataFrame:
    """Like ``top_k``, but ``oversample`` x k candidates come from the codes and are ranked by the vectors."""
    coded = top_k(queries.select(query, F.col(vector).alias("codes")), quantized(points, vector=vector).select(id, "codes"), query=query, id=id, vector="codes", k=oversample * k)
    pairs = coded.select(query, id).join(points.select(id, F.col(vector).alias("__p")), id).join(queries.select(query, F.col(vector).alias("__q")), query)
    return ranked(pairs.select(query, id, cosine(F.col("__q"), F.col("__p")).alias("score")), query=query, id=id, k=k)
