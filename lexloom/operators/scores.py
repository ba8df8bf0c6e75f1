"""The records with the greatest sums of products for every query, block by block.

Every task reads its records once and meets all queries with them; only each query's best of a task travel on. Records
of one script lie together in a block: its frequent terms are columns of a matrix and met by one product in single
precision, rare ones are added one by one. Records that may be among the best (single precision errs by a known share,
as all products are positive) are scored again in double precision. A block whose greatest weights can't reach a query's
k-th score is left out for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: records and terms that are met at once, records of a block, queries of a batch, one in how many records has a frequent term, terms scored again at once
RECORDS, TERMS, BLOCK, BATCH, FREQUENT, AGAIN = 32_768, 3_000_000, 8192, 128, 16, 1_000_000


@dataclass
class Asked:
    """Queries as rows: row n has the terms term[start[n]:start[n + 1]] of the vocabulary, with weight."""

    key: np.ndarray
    start: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    vocabulary: pa.Array
    kind: np.ndarray
    #: kinds of records that a kind of query may have, None: all
    allowed: dict[int, set[str]] | None = None


def asked(rows: pa.Table, allowed: dict[str, set[str]] | None) -> Asked:
    """rows: (key, kind, terms, weights)."""
    rows = rows.combine_chunks()
    lists = rows["terms"].combine_chunks()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.list_flatten(lists).dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    kinds = rows["kind"].to_pylist()
    number = {kind: n for n, kind in enumerate(sorted(set(kinds)))}
    return Asked(
        rows["key"].to_numpy(), np.concatenate([[0], np.cumsum(lengths)]), coded.indices.to_numpy().astype(np.int64), pc.list_flatten(rows["weights"].combine_chunks()).to_numpy(), coded.dictionary,
        np.array([number[kind] for kind in kinds], dtype=np.int64), None if allowed is None else {n: allowed.get(kind, set()) for kind, n in number.items()},
    )


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``length`` of them, one after the other."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(length.sum())


def _main(row: np.ndarray, kind: np.ndarray, rows: int, kinds: int) -> np.ndarray:
    """The most frequent kind of each row."""
    return np.bincount(row * kinds + kind, minlength=rows * kinds).reshape(rows, kinds).argmax(axis=1)


class _Block:
    def __init__(self, ids: np.ndarray, record: np.ndarray, term: np.ndarray, share: np.ndarray, terms: int, script: int, kinds: np.ndarray | None) -> None:
        self.ids, self.script, self.kinds, self.size = ids, script, kinds, len(ids)
        self.start = np.searchsorted(record, np.arange(self.size + 1))
        self.term, self.share = term, share
        by_term = np.argsort(term, kind="stable")
        self.records, self.shares = record[by_term], share[by_term].astype(np.float32)
        self.counts = np.bincount(term, minlength=terms)
        self.first = np.cumsum(self.counts) - self.counts
        there = np.flatnonzero(self.counts)
        self.most = np.zeros(terms)
        if len(there):
            self.most[there] = np.maximum.reduceat(share[by_term], self.first[there])
        frequent = np.flatnonzero(self.counts * FREQUENT > self.size)
        self.column = np.full(terms, -1, dtype=np.int64)
        self.column[frequent] = np.arange(len(frequent))
        self.matrix = np.zeros((len(frequent), self.size), dtype=np.float32)
        own = self.column[term]
        self.matrix[own[own >= 0], record[own >= 0]] = share[own >= 0]


class _Best:
    """The k best of every query so far."""

    def __init__(self, q: Asked, k: int) -> None:
        self.q, self.k, n = q, k, len(q.key)
        self.scores: list[np.ndarray | None] = [None] * n
        self.ids: list[np.ndarray | None] = [None] * n
        self.least = np.full(n, -np.inf)
        lengths = np.diff(q.start)
        self.err = (lengths + 4) * 1.2e-7
        scripts = np.array([ord(x[0]) >> 7 for x in q.vocabulary.to_pylist()] or [0], dtype=np.int64)
        self.script_names, self.script = np.unique(scripts, return_inverse=True)
        self.own = _main(np.repeat(np.arange(n), lengths), self.script[q.term], n, len(self.script_names))
        self.local = np.full(len(q.vocabulary), -1, dtype=np.int64)
        order = np.lexsort((self.own, q.kind if q.allowed is not None else np.zeros(n)))
        key = np.stack([q.kind[order] if q.allowed is not None else np.zeros(n, dtype=np.int64), self.own[order]])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        self.batches = [part[a : a + BATCH] for part in np.split(order, cuts) for a in range(0, len(part), BATCH)]

    def meet(self, ids: np.ndarray, lists: pa.Array, kinds: list[str] | None, share: Callable[[np.ndarray], np.ndarray]) -> None:
        terms = len(self.q.vocabulary)
        term = pc.index_in(pc.list_flatten(lists), value_set=self.q.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
        key = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[term >= 0].astype(np.int64) * terms + term[term >= 0]
        del term
        key, count = np.unique(key, return_counts=True)
        if not len(key):
            return
        record, term = (key // terms).astype(np.int32), (key % terms).astype(np.int32)
        del key
        scripts = _main(record, self.script[term], len(ids), len(self.script_names))
        order = np.lexsort((ids, scripts))
        place = np.empty(len(ids), dtype=np.int32)
        place[order] = np.arange(len(ids))
        record = place[record]
        by = np.argsort(record, kind="stable")
        record, term, shares, ids, scripts = record[by], term[by], share(count[by].astype(np.float64)), ids[order], scripts[order]
        del by, count
        kinds_ = None if kinds is None else np.array(kinds, dtype=object)[order]
        blocks = []
        for script in np.unique(scripts):
            a, z = np.searchsorted(scripts, script), np.searchsorted(scripts, script, side="right")
            for at in range(a, z, BLOCK):
                to = min(at + BLOCK, z)
                x, y = np.searchsorted(record, [at, to])
                blocks.append(_Block(ids[at:to], record[x:y] - at, term[x:y], shares[x:y], terms, script, None if kinds_ is None else kinds_[at:to]))
        for batch in self.batches:
            self._batch(batch, sorted(blocks, key=lambda b: b.script != self.own[batch[0]]))

    def _batch(self, batch: np.ndarray, blocks: list[_Block]) -> None:
        q = self.q
        length = q.start[batch + 1] - q.start[batch]
        at = _spans(q.start[batch], length)
        row, term, weight = np.repeat(np.arange(len(batch)), length), q.term[at], q.weight[at]
        there = np.unique(term)
        self.local[there] = np.arange(len(there))
        whole = np.zeros((len(batch), len(there) + 1))  # the last column: terms that no query of the batch has
        whole[row, self.local[term]] = weight
        may = None if q.allowed is None else q.allowed[q.kind[batch[0]]]
        for block in blocks:
            self._block(batch, row, term, weight, whole, block, may)
        self.local[there] = -1

    def _block(self, batch: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray, whole: np.ndarray, block: _Block, may: set[str] | None) -> None:
        bound = np.bincount(row, weight * block.most[term], minlength=len(batch))
        err, least = self.err[batch], self.least[batch]
        live = np.flatnonzero((bound > 0) & (bound * (1 + err) + 2e-6 >= least))
        if not len(live):
            return
        out = None
        if may is not None:
            out = np.flatnonzero(~np.isin(block.kinds, list(may)))
            if len(out) == block.size:
                return
        new = np.full(len(batch), -1, dtype=np.int64)
        new[live] = np.arange(len(live))
        use = (new[row] >= 0) & (block.counts[term] > 0)
        r, t, w = new[row[use]], term[use], weight[use].astype(np.float32)
        column = block.column[t]
        dense = column >= 0
        columns, own = np.unique(column[dense], return_inverse=True)
        side = np.zeros((len(live), len(columns)), dtype=np.float32)
        side[r[dense], own] = w[dense]
        sums = side @ (block.matrix if len(columns) == len(block.matrix) else block.matrix[columns])
        r, t, w = r[~dense], t[~dense], w[~dense]
        counts = block.counts[t]
        at = _spans(block.first[t], counts)
        np.add.at(sums.reshape(-1), np.repeat(r * block.size, counts) + block.records[at], block.shares[at] * np.repeat(w, counts))
        if out is not None:
            sums[:, out] = -1
        least, err = least[live], err[live]
        low = least * (1 - err) - 2e-6
        for n in np.flatnonzero(np.isinf(least)):
            low[n] = np.partition(sums[n], block.size - self.k)[block.size - self.k] * (1 - 2.5 * err[n]) - 2e-6 if block.size > self.k else 0.0
        low = np.maximum(np.nextafter(low.astype(np.float32), np.float32(-np.inf)), np.finfo(np.float32).smallest_subnormal)
        found = np.flatnonzero(sums >= low[:, None])
        if not len(found):
            return
        n, d = found // block.size, found % block.size
        lengths = block.start[d + 1] - block.start[d]
        scores, ends, a = np.empty(len(found)), np.cumsum(lengths), 0
        while a < len(found):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + AGAIN)))
            at = _spans(block.start[d[a:z]], lengths[a:z])
            products = whole[np.repeat(live[n[a:z]], lengths[a:z]), self.local[block.term[at]]] * block.share[at]
            scores[a:z] = np.add.reduceat(products, np.cumsum(lengths[a:z]) - lengths[a:z])
            a = z
        cuts = np.flatnonzero(np.diff(n)) + 1
        for x, y in zip([0, *cuts], [*cuts, len(n)], strict=True):
            self._keep(batch[live[n[x]]], scores[x:y], block.ids[d[x:y]])

    def _keep(self, n: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = np.round(scores, 6) >= self.least[n]
        if not good.any():
            return
        scores, ids = scores[good], ids[good]
        if self.scores[n] is not None:
            scores, ids = np.concatenate([self.scores[n], scores]), np.concatenate([self.ids[n], ids])
        rounded = np.round(scores, 6)
        if len(scores) > self.k:
            last = np.partition(rounded, len(scores) - self.k)[len(scores) - self.k]
            over, even = np.flatnonzero(rounded > last), np.flatnonzero(rounded == last)
            even = even[np.argsort(ids[even], kind="stable")[: self.k - len(over)]]
            take = np.concatenate([over, even])
            scores, ids, rounded = scores[take], ids[take], rounded[take]
        self.scores[n], self.ids[n] = scores, ids
        if len(scores) == self.k:
            self.least[n] = rounded.min()


def best(q: Asked, k: int, share: Callable[[np.ndarray], np.ndarray], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (id, terms) or (id, terms, kind); gives (key, id, score). share: what a term adds that a record has so often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, waiting, records, terms = _Best(q, k), [], 0, 0

        def met() -> None:
            rows = pa.Table.from_batches(waiting).combine_chunks()
            ids = rows["id"].combine_chunks()
            ids = ids.to_numpy(zero_copy_only=False) if pa.types.is_integer(ids.type) else np.array(ids.to_pylist(), dtype=object)
            state.meet(ids, rows["terms"].combine_chunks(), rows["kind"].to_pylist() if q.allowed is not None else None, share)

        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                part = whole.slice(at, 4096)
                waiting.append(part)
                records, terms = records + part.num_rows, terms + len(pc.list_flatten(part["terms"]))
                if records >= RECORDS or terms >= TERMS:
                    met()
                    waiting, records, terms = [], 0, 0
        if waiting:
            met()
        there = [n for n, ids in enumerate(state.ids) if ids is not None]
        for a in range(0, len(there), 4096):
            part = there[a : a + 4096]
            ids = pa.array(np.concatenate([state.ids[n] for n in part]), type=schema.field("id").type)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q.key[part], [len(state.ids[n]) for n in part])), ids, pa.array(np.concatenate([state.scores[n] for n in part]))], schema=schema)

    return run
