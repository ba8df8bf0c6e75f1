"""Vectors and scores of texts by a model, given as a function of a batch.

An embedder is made once a task and takes a list of texts; ``hashing`` needs no model files. Null texts have a null
vector, texts without words a vector of zeros.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]

#: fixed values: what a model's input starts with, by what the text is
PREFIXES = {"query": "query: ", "passage": "passage: "}


def mean_pooled(states: np.ndarray) -> np.ndarray:
    """The mean of the tokens' states, of length one; all but empty ones stay as they are."""
    mean = states.mean(axis=0)
    length = np.linalg.norm(mean)
    return mean if length < 1e-8 else mean / length


def hashing(dimension: int = 256) -> Callable[[], Embedder]:
    """An embedder of the words' hashes with signs, square roots of counts, length one."""

    def make() -> Embedder:
        word, hashed = re.compile(r"[^\W\d_]{2,}"), lru_cache(maxsize=1 << 16)(lambda w: zlib.crc32(w.encode()))

        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimension), dtype=np.float32)
            for n, text in enumerate(texts):
                for w in word.findall(text.split(": ", 1)[-1].lower() if text.startswith(tuple(PREFIXES.values())) else text.lower()):
                    h = hashed(w)
                    out[n, h % dimension] += 1 if h >> 31 else -1
            out = np.sign(out) * np.sqrt(np.abs(out))
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-8)

        return embed

    return make


def with_vectors(texts: DataFrame, make: Callable[[], Embedder], *, kind: str, text: str = "text") -> DataFrame:
    """The rows with ``vector``; ``make`` runs once a task, ``kind`` is query or passage."""
    prefix = PREFIXES[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make()
        for rows in batches:
            there = rows[text].notna()
            made = embed([prefix + t for t in rows[text][there]]) if there.any() else ()
            vectors = pd.Series([None] * len(rows), dtype=object)
            for at, v in zip(np.flatnonzero(there), made):
                vectors[at] = v.tolist()
            rows["vector"] = vectors.to_numpy()
            yield rows

    schema = ", ".join(f"`{c}` {k}" for c, k in texts.dtypes)
    return texts.mapInPandas(run, f"{schema}, vector array<float>")


def pair(query: Column, passage: Column, most: int = 512) -> Column:
    """The ids of a query and a passage as one input, without the passage's first mark, and which is which."""
    ids = F.slice(F.concat(query, F.slice(passage, F.lit(2), F.greatest(F.size(passage) - 1, F.lit(0)))), 1, most)
    first = F.size(query)
    return F.struct(ids.alias("ids"), F.transform(ids, lambda _, i: F.when(i < first, 0).otherwise(1)).alias("types"))


def source_label(source: Column, number: Column) -> Column:
    """What the source of a reference mark is called. The source is a struct of kind (book or web), title, page_start,
    page_end and name; none there is called by its number."""
    start, end = source["page_start"], source["page_end"]
    pages = F.when(start.isNull(), "").otherwise(F.concat(F.lit(", p. "), start.cast("string"), F.when(end.isNotNull() & (end != start), F.concat(F.lit("–"), end.cast("string"))).otherwise("")))
    book = F.concat(F.coalesce(source["title"], F.lit("Book")), pages)
    return F.when(source.isNull(), F.concat(F.lit("Source "), number.cast("string"))).when(source["kind"] == "book", book).otherwise(F.coalesce(source["title"], source["name"], F.lit("Web source")))
