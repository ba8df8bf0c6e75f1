"""Problem 6: a whole corpus as token ids of a public byte-level BPE.

A text is encoded as a tree. A leaf is cut into pre-tokens by the tokenizer's own pattern, and each pre-token
is encoded by its ranks. Two neighbours are joined by cutting a window around their border again and letting
it grow until it meets the right neighbour's cuts at a place that no later character can move. Joining is
associative, so leaves may be made anywhere: the halves of a text within a task, the blocks of a very long
text in many tasks.

Why the joins are exact: the pattern has no look-behind, so from a cut that belongs to the whole text the
rest follows; a pre-token that ends REACH or more characters before the end of what was seen doesn't depend
on what comes next, as the pattern looks one character ahead and a contraction is at most three long.

Rules for odd input, covered by tests: null and empty texts have an empty list; blank texts have the ids of
their blanks; strings of special tokens are ordinary text; repeated ids keep their rows.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REACH = 3
LEAF = 4096
#: longer texts are cut into blocks of this many characters, which are encoded by different tasks
BLOCK = 1 << 18
KEPT = 400_000


class Codec:
    """A tokenizer's pattern and ranks, with the ids of the pre-tokens seen last."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as rows:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rows)}
        self.bpe = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.ids: dict[str, list[int]] = {}

    def pieces(self, text: str) -> list[str]:
        return self.cut.findall(text)

    def ids_of(self, pieces: list[str]) -> np.ndarray:
        known, out = self.ids, []
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                if len(known) >= KEPT:
                    known.clear()
                ids = self.bpe._encode_single_piece(piece) if len(piece) < 2048 else self.bpe.encode_ordinary(piece)
                if len(piece) < 64:
                    known[piece] = ids
            out.extend(ids)
        return np.asarray(out, dtype=np.int32)

    def join(self, left: list[str], right: list[str]) -> list[str]:
        """The pre-tokens of the joined texts, from the pre-tokens of each."""
        if not left or not right:
            return left or right
        back, kept = 0, len(left)
        while kept and back < REACH:  # the last pre-token that ends REACH before the border is settled
            kept -= 1
            back += len(left[kept])
        head, taken, width = "".join(left[kept:]), 0, 0
        seen: list[str] = []
        while taken < len(right):
            goal = max(64, 2 * width)
            while taken < len(right) and width < goal:
                seen.append(right[taken])
                width += len(right[taken])
                taken += 1
            window = self.pieces(head + "".join(seen))
            starts, at = {}, len(head)
            for i, piece in enumerate(seen):
                starts[at] = i
                at += len(piece)
            at, last = 0, len(head) + width - REACH
            for i, piece in enumerate(window):
                if at in starts and at <= last:
                    return left[:kept] + window[:i] + right[starts[at] :]
                at += len(piece)
        return left[:kept] + window

    def tree(self, text: str, leaf: int = LEAF) -> list[str]:
        if len(text) <= leaf:
            return self.pieces(text)
        half = len(text) // 2
        return self.join(self.tree(text[:half], leaf), self.tree(text[half:], leaf))

    def fold(self, parts: list[list[str]]) -> list[str]:
        """Neighbours joined in pairs until one is left."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def encode(self, text: str | None) -> np.ndarray:
        return self.ids_of(self.tree(text)) if text else np.empty(0, dtype=np.int32)

    def decode(self, ids) -> str:
        return b"".join(self.bytes_of[int(i)] for i in ids).decode("utf-8")


@lru_cache(maxsize=4)
def codec(name: str = "byte_bpe_50k", folder: str | None = None) -> Codec:
    """The codec of ``name``.tiktoken in ``folder``, LEXLOOM_TOKENIZERS or the installed vocabularies."""
    import public_tokenizers

    folder = folder or os.environ.get("LEXLOOM_TOKENIZERS") or os.path.dirname(public_tokenizers.path(f"{name}.tiktoken"))
    return Codec(os.path.join(folder, f"{name}.tiktoken"), public_tokenizers.PATTERN)


def encode_corpus(docs: DataFrame, *, id: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str | None = None, block: int = BLOCK) -> DataFrame:
    """(id, ids) of every row. Texts over ``block`` characters are cut up and encoded by several tasks."""
    kind = dict(docs.dtypes)[id]

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with_ids = codec(name, folder)
        for rows in batches:
            yield pd.DataFrame({"id": rows["id"], "ids": [with_ids.encode(t) for t in rows["text"]]})

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cuts = codec(name, folder)
        for rows in batches:
            rows["ends"] = [np.cumsum([len(p) for p in cuts.tree(t)], dtype=np.int32) for t in rows["text"]]
            yield rows

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        cuts, parts = codec(name, folder), []
        for text_, ends in rows.sort_values("part")[["text", "ends"]].itertuples(index=False):
            parts.append([text_[a:b] for a, b in zip([0, *ends[:-1]], ends)])
        return pd.DataFrame({"id": [rows["id"].iloc[0]], "ids": [cuts.ids_of(cuts.fold(parts))]})

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    schema = f"id {kind}, ids array<int>"
    short = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= block).mapInPandas(whole, schema)
    long = rows.where(F.length("text") > block).withColumn("row", F.monotonically_increasing_id())
    blocks = long.select("row", "id", F.posexplode(F.transform(F.sequence(F.lit(0), (F.length("text") - 1).cast("int"), F.lit(block)), lambda a: F.substring("text", a + 1, F.lit(block)))).alias("part", "text"))
    cut = blocks.repartition("row", "part").mapInPandas(parts, f"row long, id {kind}, part int, text string, ends array<int>")
    return short.unionByName(cut.groupBy("row").applyInPandas(joined, schema)).select(F.col("id").alias(id), "ids")


def token_counts(docs: DataFrame, *, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """The columns ``id`` and ``keep`` with ``tokens``, the length of the encoded text."""
    kinds = dict(docs.dtypes)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with_ids = codec(name, folder)
        for rows in batches:
            rows["tokens"] = [len(with_ids.encode(t)) for t in rows.pop("__text")]
            yield rows

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (id, *keep))
    return docs.select(id, *keep, F.col(text).alias("__text")).mapInPandas(count, f"{schema}, tokens long")


def decode_corpus(encoded: DataFrame, *, id: str = "doc_id", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(id, text) from (id, ids): the bytes of the tokens, one after the other."""

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        back = codec(name, folder)
        for rows in batches:
            yield pd.DataFrame({"id": rows["id"], "text": [back.decode(i) for i in rows["ids"]]})

    return encoded.select(F.col(id).alias("id"), "ids").mapInPandas(texts, f"id {dict(encoded.dtypes)[id]}, text string").select(F.col("id").alias(id), "text")
