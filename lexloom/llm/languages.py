"""Problem 5: the language of each text and of each segment of a mixed one.

Every letter has a random vector of signs. A trigram's vector binds three of them, the first ones rotated; a word's
vector bundles its trigrams with a blank at either end, a sentence's vector the words, and a language's prototype the
trigrams of its sample texts. A sentence is compared with the prototypes by the cosine of its vector; the vectors of
words seen last are kept.

The prototypes come from a bounded sample (``sample`` rows, about, picked by the hash of their ids), read twice:
rows whose text contradicts their label in the first round don't train the second. Everything else covers all
rows and whole texts.

Rules for odd input, covered by tests: null, empty and blank texts, and texts without letters, have no segments;
repeated rows each get theirs; labels are read without case, padding and region; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSION = 2048
#: vectors of this many words are kept, those of so many are added up at once
KEPT, TOGETHER = 10_000, 1000
#: trigrams whose vectors are made at once
MANY = 4000
LANGUAGES = ("bg", "en", "ru", "de", "fr")

# fixed values: other names of the languages
NAMES = {
    "bg": ("bg", "bul", "bulgarian"),
    "en": ("en", "eng", "english"),
    "ru": ("ru", "rus", "russian"),
    "de": ("de", "deu", "ger", "german"),
    "fr": ("fr", "fra", "fre", "french"),
}

_ALPHABET = " abcdefghijklmnopqrstuvwxyzàâäæçèéêëîïôöœùûüßабвгдежзийклмнопрстуфхцчшщъыьэюяё"
K = 128
_CODE = np.zeros(0x10000, dtype=np.int64)
for _i, _c in enumerate(_ALPHABET):
    _CODE[ord(_c)] = _CODE[ord(_c.upper()[0])] = _i
OTHER = len(_ALPHABET)
for _n in range(0x80, 0x10000):
    if _CODE[_n] == 0 and chr(_n).isalpha():
        _CODE[_n] = OTHER
_LETTERS = np.random.default_rng(7).choice(np.array([-1, 1], dtype=np.int8), (K, DIMENSION))
_FIRST, _MIDDLE = np.roll(_LETTERS, 2, axis=1), np.roll(_LETTERS, 1, axis=1)
_WORD = re.compile(r"[^\W\d_]+")


def label_of(language: Column) -> Column:
    """One of LANGUAGES, or null where the label names none of them."""
    base = F.regexp_replace(F.lower(F.regexp_replace(language, r"(?U)^\s+|\s+$", "")), r"^([a-z]{2,3})[-_][a-z0-9_-]+$", "$1")
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(base.isin(*names), code).otherwise(out)
    return out


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def trigrams(words_: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the words' letter trigrams, with a blank at either end of a word, and where each word's start."""
    points = np.frombuffer(f" {' '.join(words_)} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = _CODE[np.minimum(points, 0xFFFF)]
    codes[(codes == 0) & (points != 32)] = OTHER
    letters = np.flatnonzero(points != 32)
    starts = np.cumsum([0, *map(len, words_[:-1])])
    return (codes[letters - 1] * K + codes[letters]) * K + codes[letters + 1], starts


def vectors(grams: np.ndarray) -> np.ndarray:
    """The bound vectors of trigrams."""
    return _FIRST[grams // (K * K)] * _MIDDLE[grams // K % K] * _LETTERS[grams % K]


class Profiles:
    """The prototypes of the languages, of length one, and the vectors of the words seen last."""

    def __init__(self, rows: pd.DataFrame):
        table = rows.pivot_table(index="gram", columns="language", values="n", aggfunc="sum", fill_value=0).reindex(columns=list(LANGUAGES), fill_value=0)
        grams = table.index.to_numpy(dtype=np.int64)
        counts = table.to_numpy(dtype=np.float32)
        counts = np.sqrt(counts / np.maximum(counts.sum(axis=0), 1))
        bundle = np.zeros((len(LANGUAGES), DIMENSION), dtype=np.float32)
        for i in range(0, len(grams), 2000):
            bundle += counts[i : i + 2000].T @ vectors(grams[i : i + 2000]).astype(np.float32)
        # what all the languages share tells nothing
        bundle -= bundle[bundle.any(axis=1)].mean(axis=0) if bundle.any() else 0
        self.__setstate__(bundle / np.maximum(np.linalg.norm(bundle, axis=1, keepdims=True), 1e-9))

    def __getstate__(self):
        return self.prototypes

    def __setstate__(self, prototypes: np.ndarray):
        self.prototypes, self.known, self.kept = prototypes, {}, np.zeros((0, DIMENSION), dtype=np.float32)

    def learn(self, new: list[str]) -> None:
        """Keeps the vectors of new words."""
        need = len(self.known) + len(new)
        if need > len(self.kept):
            self.kept = np.concatenate([self.kept, np.zeros((max(need, 2 * len(self.kept)) - len(self.kept), DIMENSION), dtype=np.float32)])
        for i in range(0, len(new), 100):
            part = new[i : i + 100]
            grams, starts = trigrams(part)
            at = len(self.known)
            own = vectors(grams).astype(np.float32) if len(grams) <= MANY else None
            for row, a, b in zip(self.kept[at : at + len(part)], starts, [*starts[1:], len(grams)]):
                if own is not None:
                    np.add.reduce(own[a:b], axis=0, out=row)
                else:  # long words in pieces
                    row[:] = sum(vectors(grams[n : min(n + MANY, b)]).sum(axis=0, dtype=np.float32) for n in range(a, b, MANY))
            self.known.update(zip(part, range(at, at + len(part))))

    def places(self, words_: list[str]) -> list[int]:
        at = [*map(self.known.get, words_)]
        if None in at:
            new = [*dict.fromkeys(w for w, n in zip(words_, at) if n is None)]
            if len(self.known) + len(new) > KEPT:
                self.known.clear()
                new = [*dict.fromkeys(words_)]
            self.learn(new)
            at = [*map(self.known.get, words_)]
        return at

    def bundles(self, texts: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        """The sums of the words' vectors: numbers of texts, and a row for each. A text without letters has none."""
        spoken = [words(t) for t in texts]
        some: list[int] = []
        size = 0
        for n, own in enumerate(spoken):
            if len(own) > TOGETHER:
                sums = np.zeros((1, DIMENSION), dtype=np.float32)
                for i in range(0, len(own), TOGETHER):
                    sums += self.kept_of(own[i : i + TOGETHER]).sum(axis=0)
                yield [n], sums
            elif own:
                if size + len(own) > TOGETHER:
                    yield some, self.summed([spoken[i] for i in some])
                    some, size = [], 0
                some.append(n)
                size += len(own)
        if some:
            yield some, self.summed([spoken[i] for i in some])

    def kept_of(self, words_: list[str]) -> np.ndarray:
        at = self.places(words_)
        return self.kept[at]

    def summed(self, spoken: list[list[str]]) -> np.ndarray:
        at, out, a = self.places([*chain.from_iterable(spoken)]), np.empty((len(spoken), DIMENSION), dtype=np.float32), 0
        for row, own in zip(out, spoken):
            np.add.reduce(self.kept.take(at[a : a + len(own)], axis=0), axis=0, out=row)
            a += len(own)
        return out

    def cosines(self, texts: list[str]) -> np.ndarray:
        """The cosine of each text with each prototype; 0 where there are no letters."""
        out = np.zeros((len(texts), len(LANGUAGES)), dtype=np.float32)
        for at, sums in self.bundles(texts):
            length = np.sqrt(np.einsum("ij,ij->i", sums, sums))
            out[at] = (sums @ self.prototypes.T) / np.maximum(length, 1e-9)[:, None]
        return out


def _sample_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for language, own in rows.groupby("language"):
            grams, n = np.unique(trigrams([w for t in own["text"] for w in words(t)])[0], return_counts=True)
            yield pd.DataFrame({"language": language, "gram": grams, "n": n.astype(float)})


def train(chunks: DataFrame, *, id: str = "chunk_id", text: str = "text", language: str = "language", sample: int = 6000) -> Profiles:
    every = max(1, math.ceil(chunks.count() / sample))
    rows = chunks.where(F.col(text).isNotNull() & (F.pmod(F.xxhash64(id), F.lit(every)) == 0)).select(F.col(text).alias("text"), label_of(F.col(language)).alias("language"))
    rows = rows.where("language is not null").repartition(8)

    def profiles(part: DataFrame) -> Profiles:
        return Profiles(part.mapInPandas(_sample_counts, "language string, gram long, n double").groupBy("language", "gram").agg(F.sum("n").alias("n")).toPandas())

    first = profiles(rows)

    def agreeing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                best = np.array(LANGUAGES)[first.cosines(part["text"].tolist()).argmax(axis=1)]
                yield part[best == part["language"]]

    return profiles(rows.mapInPandas(agreeing, "text string, language string"))


#: a sentence: up to its end marks and closing quotes before a blank and the start of another, or a line's end
_END = re.compile(r"""[.!?…]+[)\]»”“"’']*(?:\[\d+\])?(?=\s|$)""")
_BREAK = re.compile(r"\n[ \t]*\n|\n(?=[ \t]*(?:[-*•|#]|\d+[.)] ))|(?<=\|)[ \t]*\n")
LEAST_WORDS, LEAST_LETTERS = 3, 12


def units(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, full) of the pieces of a text: full sentences, and what else stands between them."""
    out, at = [], 0
    for stop in [*(m.span() for m in _BREAK.finditer(text)), (len(text), len(text))]:
        begin, table = at, text[at : at + 3].lstrip()[:1] in ("|", "-", "*", "•", "#")
        for m in _END.finditer(text, at, stop[0]):
            after = text[m.end() : m.end() + 3].lstrip(" \n\t—–-«„“\"(‘")[:1]
            if m.end() < stop[0] and (after.islower() or after.isdigit() and m.group()[0] == "."):
                continue
            if sum(c.isalpha() for c in text[begin : m.end()]) < LEAST_LETTERS and m.end() < stop[0]:
                continue
            out.append((begin, m.end(), not table))
            begin = m.end()
        if begin < stop[0] and any(c.isalpha() for c in text[begin : stop[0]]):
            out.append((begin, stop[0], False))
        at = stop[1]
    return out


#: what text decoded with a wrong encoding looks like (problem 4): it is in no language
_GARBLED = re.compile(
    "[РСÐÑÃÂâГ][\x80-\xbf‘’“”•–—˜™š›œžŸŠŒŽ€‚ƒ„…†‡ˆ‰‹\u0402-\u040f\u0452-\u045f±°µ¶·»ѐ]|[а-я][А-Я]{2}|[А-Я]{3}[а-я]|[à-ÿ]{4}|[─-╿]|�|[а-я][√∞€¬]"
)


def _garbled(piece: str) -> bool:
    return len(_GARBLED.findall(piece)) >= 2


def _classified(profiles: Profiles, texts: list[str], least: float, margin: float) -> pd.DataFrame:
    """The units of the texts: owner, start, end, full, language, cosine, lead, sure."""
    owner, spans, pieces, odd = [], [], [], []
    for n, text in enumerate(texts):
        suspect = _garbled(text)
        for a, b, full in units(text):
            piece = text[a:b]
            owner.append(n)
            spans.append((a, b, full and len(piece.split()) >= LEAST_WORDS))
            pieces.append(piece)
            odd.append(suspect and _garbled(piece))
    out = pd.DataFrame(spans, columns=["start", "end", "full"])
    out.insert(0, "owner", owner)
    cos = profiles.cosines(pieces).astype(float)
    order = np.sort(cos, axis=1)
    out["language"] = np.array(LANGUAGES)[cos.argmax(axis=1)]
    out["cosine"], out["lead"] = order[:, -1], order[:, -1] - order[:, -2]
    out["sure"] = (out["cosine"] >= least) & (out["lead"] >= margin) & ~np.array(odd, dtype=bool)
    return out


def _spoken(found: pd.DataFrame, n: int) -> list[list[str]]:
    """The languages of each text: those with a sure full sentence; else the one of most sure letters, if any."""
    out: list[list[str]] = [[] for _ in range(n)]
    full = found[found["full"] & found["sure"]]
    for at, language in zip(full["owner"], full["language"]):
        if language not in out[at]:
            out[at].append(language)
    rest = found[found["sure"]]
    rest = rest[[not out[at] for at in rest["owner"]]]
    if len(rest):
        weight = ((rest["end"] - rest["start"]) * rest["lead"]).groupby([rest["owner"], rest["language"]]).sum()
        for (at, language), w in weight.sort_values().items():
            out[at] = [language]
    return out


def segments(chunks: DataFrame, profiles: Profiles, *, id: str = "chunk_id", text: str = "text", least: float = 0.1, margin: float = 0.07) -> DataFrame:
    """(id, seg_start, seg_end, language, confidence) of every text: neighbouring units of one language in one row.

    A unit that isn't sure goes with the one before it, the first ones with the next; a text without a sure unit is
    one segment of its most likely language. The confidence is the mean lead of the segment's units over the
    second language, as a share of their mean cosine.
    """
    kind = dict(chunks.dtypes)[id]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = _classified(profiles, rows["text"].tolist(), least, margin)
            if not len(found):
                continue
            sure = found["language"].where(found["sure"])
            guess = found.groupby("owner")["language"].agg(lambda x: x.value_counts().index[0])
            found["language"] = sure.groupby(found["owner"]).ffill().fillna(sure.groupby(found["owner"]).bfill()).fillna(found["owner"].map(guess))
            step = (found["language"] != found["language"].shift()) | (found["owner"] != found["owner"].shift())
            parts = found.groupby(step.cumsum()).agg(owner=("owner", "first"), seg_start=("start", "min"), seg_end=("end", "max"), language=("language", "first"), lead=("lead", "mean"), cosine=("cosine", "mean"))
            yield pd.DataFrame({"id": rows["id"].to_numpy()[parts["owner"]], "seg_start": parts["seg_start"], "seg_end": parts["seg_end"], "language": parts["language"], "confidence": (parts["lead"] / parts["cosine"].clip(lower=1e-6)).clip(0, 1)})

    rows = chunks.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInPandas(cut, f"id {kind}, seg_start int, seg_end int, language string, confidence double").withColumnRenamed("id", id)


def mislabelled(chunks: DataFrame, profiles: Profiles, *, id: str = "chunk_id", text: str = "text", language: str = "language", least: float = 0.1, margin: float = 0.07) -> DataFrame:
    """(id, language): the languages of each text that has no right label or more than one language."""
    kind = dict(chunks.dtypes)[id]

    def cases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            spoken = _spoken(_classified(profiles, rows["text"].tolist(), least, margin), len(rows))
            out = [(i, l) for i, label, all_ in zip(rows["id"], rows["label"], spoken) if len(all_) > 1 or label not in all_ for l in all_]
            if out:
                yield pd.DataFrame(out, columns=["id", "language"])

    rows = chunks.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"), label_of(F.col(language)).alias("label"))
    return rows.mapInPandas(cases, f"id {kind}, language string").withColumnRenamed("id", id)
