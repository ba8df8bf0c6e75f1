"""Problem 4: text that was decoded with the wrong character encoding.

A multinomial classifier over hashed byte bigrams knows clean text and, for every chain of a right and a wrong
encoding, text garbled that way on purpose. It scores the words of a text against clean text, where a word of
the clean sample counts at least as much as its share there; the stretch of words with the highest sum tells
where the text is garbled and by which chain. The chain is inverted and counts only if the stretch decodes
strictly and the result is the likelier clean text by ``margin``.

The classifier is trained on a bounded sample of the rows (``sample``, about that many, picked by the hash of
their ids), which is read twice: rows that the first model finds garbled don't train the second one. The model has
at most classes x BUCKETS numbers. Everything else covers every row.

Rules for odd input, covered by tests: null, empty and plain ASCII texts are never affected; repeated rows
each get their result; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
LEAST = 5.0
MARGIN = 5.0
KEPT = 60_000
#: bigrams that are looked up at once
MANY = 1 << 16
LOSSY = ("lost>?", "lost>�")

# fixed values: the encodings that are told apart
WIDE = ("latin-1", "cp1250", "cp1251", "cp1252", "koi8-r", "cp866", "cp437", "cp850", "mac-roman", "mac-cyrillic", "iso8859-5")
CYRILLIC = ("cp1251", "koi8-r", "cp866", "mac-cyrillic", "iso8859-5")
LATIN = ("cp1252", "cp437", "cp850", "mac-roman")
TWICE = ("latin-1", "cp1252", "cp1251")

CHAINS = tuple(
    dict.fromkeys(
        [f"utf-8>{w}" for w in WIDE]
        + [f"utf-8>{w}>utf-8>{w}" for w in TWICE]
        + [f"{r}>{w}" for r, w in product(CYRILLIC, (*CYRILLIC, "cp1252", "mac-roman", "cp437")) if r != w]
        + [f"{r}>{w}" for r, w in product(LATIN, (*LATIN, "cp1250", "cp1251", "koi8-r", "cp866")) if r != w]
    )
)


def _table(name: str) -> list[str]:
    """The characters of the 256 bytes; bytes without one read as control characters."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


_READ = {n: {b: c for b, c in enumerate(_table(n))} for n in {*WIDE, *CYRILLIC, *LATIN}}
_WRITE = {n: {ord(c): b for b, c in t.items()} for n, t in _READ.items()}


def _to_bytes(text: str, name: str) -> bytes | None:
    if name == "utf-8":
        return text.encode("utf-8", "surrogatepass")
    out = bytearray()
    for c in text:
        b = _WRITE[name].get(ord(c))
        if b is None:
            return None
        out.append(b)
    return bytes(out)


def _to_text(data: bytes, name: str) -> str | None:
    if name == "utf-8":
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return None
    read = _READ[name]
    return "".join(read[b] for b in data)


class _Garbled(dict):
    """What each character looks like after the chain; encodings work character by character."""

    def __init__(self, chain: str):
        self.steps = chain.split(">")

    def __missing__(self, point: int) -> str:
        text: str | None = chr(point)
        for right, wrong in zip(self.steps[::2], self.steps[1::2]):
            data = text and _to_bytes(text, right)
            text = data and _to_text(data, wrong)
        self[point] = text or _NONE
        return self[point]


_NONE = "\ue000"
_MAPS: dict[str, _Garbled] = {}


def garble(text: str, chain: str) -> str | None:
    """The text as it looks after the chain; None if it can't be written in an encoding of the chain."""
    if chain in LOSSY:
        return re.sub(r"[^\x00-\x7f]", chain[-1], text)
    if chain not in _MAPS:
        _MAPS[chain] = _Garbled(chain)
    out = text.translate(_MAPS[chain])
    return None if _NONE in out else out


def restore(text: str, chain: str) -> str | None:
    """The text before the chain; None if it doesn't decode strictly."""
    if chain in LOSSY:
        return None
    steps = chain.split(">")[::-1]
    for wrong, right in zip(steps[::2], steps[1::2]):
        data = _to_bytes(text, wrong)
        text = None if data is None else _to_text(data, right)
        if text is None:
            return None
    return text


#: the classes: clean text and each chain; words with Cyrillic letters, those without, and all of them in capitals
KINDS = ("native", "latin", "caps")
CLASSES = tuple(f"{c}/{k}" for c in ("clean", *CHAINS, *LOSSY) for k in KINDS)
CLEAN = len(KINDS)
_NATIVE = re.compile("[а-яёА-ЯЁ]")

_SPACE = re.compile(r"[ \t\r\n]+")


def words(text: str) -> list[str]:
    """Pieces between blanks and line breaks (not other white space, which may be part of a garbled letter)."""
    return _SPACE.split(text)


def telling(word: str) -> bool:
    return not word.isascii() or "??" in word


def plain(word: str) -> str:
    return word.strip(".,;:!?()[]\"'").lower()


def bigrams(words_: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed byte bigrams of the words, one after the other, and where each word starts."""
    data = np.frombuffer(b" " + "".join(w + " " for w in words_).encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    pairs = (data[:-1] << 8 | data[1:]) * np.uint32(2654435761) >> np.uint32(18)
    # a word's bigrams run from the blank before it to the blank after it
    blank = np.flatnonzero(data == 32)
    return pairs.astype(np.int64), blank[:-1]


def _telling_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, n) of the words that tell something."""
    for rows in batches:
        seen = Counter(w for text in rows["text"] for w in words(text) if telling(w))
        if seen:
            yield pd.DataFrame({"word": [*seen], "n": [*seen.values()]})


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(class, bucket, n, word) of distinct words with their counts: the bigrams of each one clean and garbled by every
    chain, weighed by the root of its count; and the plain words with their counts."""
    for rows in batches:
        forms = rows["word"].tolist()
        native = [bool(_NATIVE.search(w)) for w in forms]
        weight = np.sqrt(rows["n"].to_numpy(float))
        for name in CLASSES:
            chain, _, kind = name.partition("/")
            made, at = [], []
            for i, w in enumerate(forms):
                if kind == "caps":
                    w = w.upper()
                elif native[i] != (kind == "native"):
                    continue
                g = w if chain == "clean" else garble(w, chain)
                if g is not None and (g != w or chain == "clean") and not _SPACE.search(g):
                    made.append(g)
                    at.append(i)
            if made:
                pairs, starts = bigrams(made)
                n = np.bincount(pairs, np.repeat(weight[at], np.diff([*starts, len(pairs)])), BUCKETS)
                there = np.flatnonzero(n)
                yield pd.DataFrame({"class": name, "bucket": there, "n": n[there], "word": None})
        yield pd.DataFrame({"class": "word", "bucket": 0, "n": rows["n"].astype(float), "word": [*map(plain, forms)]})


def _astray(counts: dict[str, float]) -> set[str]:
    """Words of the sample that are the garbled form of a more frequent one."""
    out = set()
    for chain in CHAINS:
        times = 1 if chain.startswith("utf-8") else 20
        for w, n in counts.items():
            if not w.isascii() and n > times:
                for form in (w, w.capitalize(), w.upper()):
                    g = garble(form, chain)
                    k = plain(g) if g else None
                    if k and k != w and len(w) > (0 if times == 1 else 3) and 0 < counts.get(k, 0) * times < n:
                        out.add(k)
    return out


class Model:
    """Log probabilities of the buckets in each class and of clean words, and the scores of the words seen."""

    def __init__(self, rows: pd.DataFrame, smooth: float = 0.05):
        counts = np.zeros((BUCKETS, len(CLASSES)), dtype=np.float64)
        place = {c: i for i, c in enumerate(CLASSES)}
        of_word = rows["class"] == "word"
        known, rows = rows[of_word & (rows["n"] > 1)], rows[~of_word]
        counts[rows["bucket"].astype(int), [place[c] for c in rows["class"]]] = rows["n"]
        total = counts.sum(axis=0)
        logs = np.log((counts + smooth) / np.maximum(total + smooth * BUCKETS, 1))
        logs[:, total < 50] = -50  # a class without examples is never chosen
        n = dict(zip(known["word"], known["n"].tolist()))
        whole, astray = max(1.0, sum(n.values())), _astray(n)
        self.__setstate__((logs.astype(np.float32), {w: math.log(k / whole) for w, k in n.items() if w not in astray}))

    def __getstate__(self):
        return self.logs, self.words

    def __setstate__(self, state):
        self.logs, self.words = state
        self.known, self.best, self.scores = {}, [], np.zeros((1024, len(CLASSES) - CLEAN), dtype=np.float32)

    def clean(self, words_: list[str]) -> float:
        """How likely the words are clean text: each by its share in the sample or by its bigrams."""
        told = [w for w in words_ if not w.isascii()]
        if not told:
            return 0.0
        pairs, starts = bigrams(told)
        by_bigrams = np.add.reduceat(self.logs[pairs, :CLEAN], starts, axis=0).max(axis=1)
        return sum(max(a, self.words.get(plain(w), -math.inf)) for a, w in zip(by_bigrams.tolist(), told))

    def sums(self, words_: list[str]) -> np.ndarray:
        """The log probability of each word in each class; long words are summed in pieces."""
        pairs, starts = bigrams(words_)
        if len(pairs) <= MANY:
            return np.add.reduceat(self.logs[pairs], starts, axis=0)
        ends = [*starts[1:], len(pairs)]
        return np.stack([np.sum([self.logs[pairs[i : min(i + MANY, b)]].sum(axis=0) for i in range(a, b, MANY)], axis=0) for a, b in zip(starts, ends)])

    def learn(self, new: list[str]) -> None:
        """Adds the scores of new words."""
        need = len(self.known) + len(new)
        while need > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        for a in range(0, len(new), 2000):
            part = new[a : a + 2000]
            sums = self.sums(part)
            at = len(self.known)
            clean = np.maximum(sums[:, :CLEAN].max(axis=1), [self.words.get(plain(w), -math.inf) for w in part])
            new_scores = sums[:, CLEAN:] - clean[:, None]
            self.scores[at : at + len(part)] = new_scores
            self.best += np.maximum(new_scores.max(axis=1), 0).tolist()
            self.known.update(zip(part, range(at, at + len(part))))

    def places(self, words_: list[str]) -> list[int]:
        """Where the scores of the words are. KEPT words are kept, or as many as are asked for at once."""
        at = [*map(self.known.get, words_)]
        if None in at:
            new = [*dict.fromkeys(w for w, n in zip(words_, at) if n is None)]
            if len(self.known) + len(new) > KEPT:
                self.known.clear()
                self.best.clear()
                new = [*dict.fromkeys(words_)]
            self.learn(new)
            at = [*map(self.known.get, words_)]
        return at

    def best_of(self, words_: list[str]) -> float:
        """The sum of the words' best scores, as far as they are positive."""
        best = self.best
        return sum([best[n] for n in self.places(words_)])

    def scores_of(self, words_: list[str]) -> np.ndarray:
        return self.scores[self.places(words_)]


#: telling words that are looked at together
WINDOW = 2000


def _stretch(scores: np.ndarray) -> tuple[float, int, int, int]:
    """The highest sum over a stretch of words and a class: (sum, first, last, class)."""
    up = np.cumsum(scores, axis=0)
    before = np.vstack([np.zeros((1, scores.shape[1]), dtype=up.dtype), up[:-1]])
    low = np.minimum.accumulate(before, axis=0)
    gain = up - low
    last, kind = np.unravel_index(np.argmax(gain), gain.shape)
    first = int(np.argmin(before[: last + 1, kind]))
    return float(gain[last, kind]), first, int(last), int(kind)


#: what lost letters leave: their mark, question marks only where letters follow or nothing else is left
_LOST = {"lost>�": re.compile("�"), "lost>?": re.compile(r"(?<!\S)[^\s/=]*\?[a-zа-я][^\s/=]*(?!\S)|\?{4,}|\?\?\S*\s+\S*\?")}


def _familiar(model: Model, pieces: list[str]) -> bool:
    """Whether half of the words or more, one of three letters at least, are words of the clean sample."""
    told = [plain(p) for p in pieces if telling(p)]
    known = [w for w in told if len(w) > 2 and w in model.words]
    return bool(known) and 2 * len(known) >= len([w for w in told if len(w) > 2])


def _undo(pieces: list[str], chain: str) -> list[str] | None:
    out = [restore(p, chain) if telling(p) else p for p in pieces]
    return None if any(p is None for p in out) else out


def _windows(model: Model, pieces: list[str], at: list[int], least: float) -> Iterator[tuple[list[int], np.ndarray]]:
    """The telling words in windows, with their scores. A window ends behind a word that costs every chain ``least``
    or more: a stretch over it would be two that both count without it."""
    own: list[int] = []
    scores: list[np.ndarray] = []
    for i in range(0, len(at), WINDOW):
        part = at[i : i + WINDOW]
        new = model.scores_of([pieces[n] for n in part])
        plain_ = np.flatnonzero(new.max(axis=1) <= -least)
        if len(plain_) and i + WINDOW < len(at):
            cut = int(plain_[-1]) + 1
            yield own + part[:cut], np.concatenate([*scores, new[:cut]])
            own, scores = part[cut:], [new[cut:]]
        else:
            own, scores = own + part, [*scores, new]
    if own:
        yield own, np.concatenate(scores)


def _inspect(model: Model, text: str, least: float) -> tuple[list[str], str, bool] | None:
    """(chains, repaired text, wholly restored) of an affected text, else None."""
    cut = re.split(r"([ \t\r\n]+)", text)
    pieces = cut[::2]
    chains, whole = [], True
    for at, scores in _windows(model, pieces, [i for i, w in enumerate(pieces) if telling(w)], least):
        while True:  # every round leaves fewer positive scores
            gain, first, last, kind = _stretch(scores)
            if gain < least:
                break
            chain = CLASSES[kind + CLEAN].partition("/")[0]
            span = range(first, last + 1)
            old = [pieces[at[i]] for i in span]
            if chain in LOSSY:
                if not _LOST[chain].search(" ".join(old)):
                    scores[first : last + 1, kind] = -least
                    continue
                whole = False
            else:
                new = _undo(old, chain)
                strict = chain.startswith("utf-8")  # between encodings of single bytes everything decodes
                if new is None or model.clean(new) < model.clean(old) + MARGIN or not (strict or _familiar(model, new)):
                    scores[first : last + 1, kind] = -least  # this chain doesn't hold here
                    continue
                for i, w in zip(span, new):
                    pieces[at[i]] = w
            scores[first : last + 1] = -least
            chains.append(chain)
    if not chains:
        return None
    cut[::2] = pieces
    return sorted({*chains}), "".join(cut), whole


def _scan(model: Model, least: float):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for id_, text in zip(rows["id"], rows["text"]):
                if not text or text.isascii() and "??" not in text:
                    continue
                told = [w for w in words(text) if telling(w)]
                # the positive parts bound every stretch from above
                if sum(model.best_of(told[i : i + WINDOW]) for i in range(0, len(told), WINDOW)) >= least:
                    found = _inspect(model, text, least)
                    if found:
                        out.append((id_, ",".join(found[0]), found[1], found[2]))
            if out:
                yield pd.DataFrame(out, columns=["id", "chains", "restored", "whole"])

    return scan


def _train(rows: DataFrame) -> Model:
    """Counts of words first, then weights, so that the model doesn't depend on how the rows lie."""
    counted = rows.mapInPandas(_telling_words, "word string, n long").repartition(8, "word").groupBy("word").agg(F.sum("n").alias("n"))
    return Model(counted.mapInPandas(_count, "class string, bucket long, n double, word string").groupBy("class", "bucket", "word").agg(F.sum("n").alias("n")).toPandas())


def train(chunks: DataFrame, *, id: str = "chunk_id", text: str = "text", sample: int = 4000, least: float = LEAST) -> Model:
    """The model from about ``sample`` rows, trained again without those the first model finds garbled."""
    every = max(1, math.ceil(chunks.count() / sample))
    rows = chunks.where(F.col(text).isNotNull() & (F.pmod(F.xxhash64(id), F.lit(every)) == 0)).select(F.col(id).alias("id"), F.col(text).alias("text")).repartition(8)
    first = _train(rows)
    kind = dict(rows.dtypes)["id"]
    bad = rows.mapInPandas(_scan(first, least), f"id {kind}, chains string, restored string, whole boolean").select("id")
    return _train(rows.join(bad, "id", "left_anti"))


def garbled_records(chunks: DataFrame, *, id: str = "chunk_id", text: str = "text", sample: int = 4000, least: float = LEAST) -> DataFrame:
    """(id, chains, restored, whole) of every affected row; ``whole`` is false where characters are lost."""
    model = train(chunks, id=id, text=text, sample=sample, least=least)
    kind = dict(chunks.dtypes)[id]
    rows = chunks.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInPandas(_scan(model, least), f"id {kind}, chains string, restored string, whole boolean").withColumnRenamed("id", id)
