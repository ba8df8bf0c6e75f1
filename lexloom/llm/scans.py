"""Problem 2: noise in text from scanned pages, and its repair.

Words are grouped by the skeleton that confusable glyphs share; a form that looks misread, or is much rarer than
another of its group, is one, if the group has a frequent form. Of several frequent forms that one is chosen which stands
most often behind the odd form's left neighbours. Where plain letters differ by more than two that look like one, the
frequent form must also be much more frequent after the same left neighbours. What a hyphenation mark leaves of a word
is no form. A word broken at a line's end counts if its joined form is frequent. Running heads are lines that fall into
one group with a title of their book or chapter, whole or cut short at a word, once numbers are masked, the page at
either end is left out and confusable glyphs are the same. The repair replaces misread words, drops heads and page
numbers, joins broken words and reflows lines into paragraphs with windows.

A frequent form has at least FLOOR occurrences, in tables of any size; an odd form is no misread or broken one of a
form that is rarer than itself.

Rules for odd input, covered by tests: null and empty texts have no noise; rows without titles have no running
heads; the heading path of a summary is no running head; repeated rows, and rows without an id, each get their
result; words of under three letters are never misread and of under four never broken; a title cut short has two words
and 30 % of its letters or more; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexloom.streaming.ingest import ensure_checkpoints

FLOOR = 3
MUCH_RARER = 20
#: bits of a filter of forms: of bounded size, what it lets through is joined exactly
BITS = 1 << 22

# fixed values: what scanners confuse, in words with Cyrillic letters and in others
CYRILLIC_PAIRS = {"rvi": "м", "iii": "ш", "n_": "д", "}{": "ж"}
CYRILLIC_GLYPHS = str.maketrans("aeopcxykmthb0346", "аеорсхукмтнвозчб")
LATIN_PAIRS = {"m": "rn", "d": "cl", "w": "vv", "h": "li"}
LATIN_GLYPHS = str.maketrans("il1|!tf¦\\0569286", "lllllllllosbgzbb")
SPECKS = dict.fromkeys(map(ord, "^~°¬\xad"))
CYRILLIC_SPECKS = dict.fromkeys(map(ord, "^~°¬\xadçãőñõ"))
HYPHENS = "‐‑¬\xad—-"

_CYRILLIC = re.compile(r"[а-яё]")
_PURE = re.compile(r"[a-zß-ÿœ]+|[а-яё]+")
_WORD = re.compile(r"[^\W\d_]{2,}")
_PIECE = re.compile(r"""[^\s/\-‐‑–—’'()\[\]«»„“”",.;:?…]+""")
_PAIRED = re.compile("rn|cl|vv|li|m|d|w|h")
_GLYPHS = re.compile(r"[0-9^~°¬|!\\¦_}{]")
_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th|e|er|re|me|ème|го|ти|ви|ри|ия|ый|ой|та|на)?")
_MIXED = re.compile(r"[aeopcxykmthbçãőñõ]")
_MARK = re.compile(rf"[{HYPHENS}](?=\s)")
_STOPS = frozenset("/|" + HYPHENS)
_BEHIND = re.compile(rf"\s+([^\W\d][^\s/|{HYPHENS}]*)")
# well-formed Roman numerals in one case; units and words that look like one are none
_NUMERAL = "m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
ROMAN = rf"(?!(?:mm|cm|dl|mi|di|mix|dix)\b)(?=[ivxlcdm])(?-i:{_NUMERAL}|{_NUMERAL.upper()})(?![^\W_])"
# fixed values: the ways a line gives a page; (c) or d) is a letter of a list
_PAGE_WORDS = "стр|страница|страници|page|seite|p|pp|pg|s|с|c"
_OF = r"[ \t]*(?:/|of|от|из|von|sur|de)[ \t]*"
PAGE = re.compile(
    rf"[ \t]*(?:[-—–·•*~\[/(|]?[ \t]*(?:\d{{1,4}}|(?![cdlm][)\]]){ROMAN})[ \t]*[-—–·•*~\]/)|]?"
    rf"|(?:{_PAGE_WORDS})\.?[ \t]*\d{{1,4}}(?:{_OF}\d{{1,4}})?|(?:{_PAGE_WORDS})(?:\.[ \t]*|[ \t]+){ROMAN}(?:{_OF}(?:{ROMAN}|\d{{1,4}}))?)[ \t\r]*",
    re.IGNORECASE,
)
_NUMBERED = re.compile(rf"[ \t]*(?:\d{{1,4}}|(?=[a-z]{{2}}){ROMAN})\.[ \t\r]*")
_ENDED = re.compile(r"[.!?…:;”“»|)\]]\s*$")
_NUMBER = re.compile(r"(?<![^\W_])\d+(?![^\W_])")
_LEAD, _TRAIL = re.compile(r"^\d{1,4}[\s|·—–-]+"), re.compile(r"[\s|·—–-]+\d{1,4}$")


def skeleton(form: str) -> str:
    """What is left of a word when confusable glyphs are the same."""
    form = form.lower()
    if _CYRILLIC.search(form):
        form = form.translate(CYRILLIC_SPECKS)
        for seen, meant in CYRILLIC_PAIRS.items():
            form = form.replace(seen, meant)
        return form.translate(CYRILLIC_GLYPHS)
    form = form.translate(SPECKS)
    for meant, seen in LATIN_PAIRS.items():
        form = form.replace(meant, seen)
    return form.translate(LATIN_GLYPHS)


def pair_skeleton(form: str) -> str:
    """The skeleton of a plain word: only two letters that look like one."""
    for meant, seen in LATIN_PAIRS.items():
        form = form.replace(meant, seen)
    return form


@F.pandas_udf(StringType())
def _skeletons(forms: pd.Series) -> pd.Series:
    return pd.Series(["s:" + skeleton(f) for f in forms], dtype=object)


@F.pandas_udf(StringType())
def _pair_skeletons(forms: pd.Series) -> pd.Series:
    return pd.Series(["p:" + pair_skeleton(f) for f in forms], dtype=object)


def suspect(piece: str) -> str | None:
    """The key of the group of a misread word that isn't of plain letters; None if nothing about the word is odd."""
    form = _trimmed(piece)
    if len(form) < 3 or _ORDINAL.fullmatch(form) or _PURE.fullmatch(form):
        return None
    letters = sum(c.isalpha() for c in form)
    if letters < 2 or letters * 2 < len(form):
        return None
    native = len(_CYRILLIC.findall(form))
    odd = _MIXED.search(form) or _GLYPHS.search(form) or "rvi" in form or "iii" in form if native else _GLYPHS.search(form)
    return "s:" + skeleton(form) if odd else None


def _unspaced(line: str) -> str:
    """Letters set apart by single blanks, words by more, put together again."""
    parts = line.split()
    if len(parts) >= 6 and sum(len(p) == 1 for p in parts) >= 0.8 * len(parts):
        return " ".join("".join(w.split(" ")) for w in re.split(r"[ \t]{2,}", line))
    return line


def head_key(line: str) -> str:
    """What lines of one head share: numbers are masked, case and confusable glyphs are the same."""
    return skeleton(_NUMBER.sub("0", " ".join(line.lower().rstrip("… ").split())))


def head_keys(line: str) -> set[str]:
    """The keys of a line with and without the page at either end."""
    line = line.strip()
    ways = {_unspaced(line), _unspaced(_LEAD.sub("", line))}
    return {head_key(w) for w in ways | {_TRAIL.sub("", w) for w in ways}}


@lru_cache(maxsize=20_000)
def title_keys(*titles: str | None) -> frozenset[str]:
    """The keys of titles, whole and cut short at a word."""
    out = set()
    for title in titles:
        key = head_key(title or "")
        if sum(c.isalpha() for c in key) > 2:
            cuts = [n for n, c in enumerate(key) if c in " ,." and n >= max(8, 0.3 * len(key)) and " " in key[:n]]
            out.update([key, *(key[:n] for n in cuts)])
    return frozenset(out)


def split_lines(text: str, titles: frozenset[str], summary: bool) -> tuple[list[str], list[str | None]]:
    """The lines and what each one is: running_head, page_number or None. titles: the keys of its titles."""
    lines = text.split("\n")
    kinds: list[str | None] = [None] * len(lines)
    starts = {k[:1] for k in titles}
    for n, line in enumerate(lines):
        bare = line.strip()
        if not bare:
            continue
        if PAGE.fullmatch(bare):
            kinds[n] = "page_number"
        elif _NUMBERED.fullmatch(bare):
            before, after = lines[n - 1].strip() if n else "", lines[n + 1].strip() if n + 1 < len(lines) else ""
            if not before or _ENDED.search(before) or after[:1].islower():
                kinds[n] = "page_number"
        elif starts and not (n == 0 and summary) and bare[0] not in "|*" and " > " not in bare:
            if not starts.isdisjoint(_begins(bare)) and not titles.isdisjoint(head_keys(bare)):
                kinds[n] = "running_head"
    return lines, kinds


def _begins(line: str) -> set[str]:
    """What the keys of a line may begin with: a quick look before they are made."""
    out: set[str] = set()
    for some in (line[:3].lower(), _LEAD.sub("", line)[:3].lower()):
        out.update(k[:1] for k in (some.translate(LATIN_GLYPHS), some.translate(CYRILLIC_GLYPHS), skeleton(some)))
        out.update(meant for seen, meant in CYRILLIC_PAIRS.items() if some.startswith(seen))
        if some[:1].isdigit():
            out.update(("o", "о"))
    return out


def _count_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter[str] = Counter()
    for rows in batches:
        for text in rows["text"]:
            counts.update(_WORD.findall(text.lower()))
        if len(counts) > 400_000:
            yield pd.DataFrame({"form": [*counts], "n": [*counts.values()]})
            counts = Counter()
    if counts:
        yield pd.DataFrame({"form": [*counts], "n": [*counts.values()]})


def plain_forms(chunks: DataFrame, *, text: str = "text") -> DataFrame:
    """(form, n) of all plain words."""
    rows = chunks.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    counts = rows.mapInPandas(_count_forms, "form string, n long").groupBy("form").agg(F.sum("n").alias("n")).checkpoint()
    return counts.where(F.col("form").rlike("^(?:[a-zß-ÿœ]+|[а-яё]+)$") & (F.length("form") > 2))


def lexicon(forms: DataFrame) -> DataFrame:
    """(form, n) of the frequent plain words."""
    return forms.where(F.col("n") >= FLOOR)


def groups(frequent: DataFrame) -> DataFrame:
    """(key, form, n): the frequent words under the skeletons by which others find them."""
    return frequent.select(_skeletons("form").alias("key"), "form", "n")


def plain_pairs(forms: DataFrame, frequent: DataFrame) -> DataFrame:
    """(form, meant, n, sure) of the plain words with a much more frequent one of the same skeleton; sure if they
    differ by two letters that look like one, either way."""
    latin = F.col("form").rlike("^[a-zß-ÿœ]+$")  # no two plain Cyrillic words have the same skeleton
    keyed = lambda some: some.where(latin).select(_skeletons("form").alias("key"), _pair_skeletons("form").alias("pair"), "form", "n")
    meant = keyed(frequent).withColumnsRenamed({"form": "meant", "n": "most", "pair": "other"})
    pairs = keyed(forms).join(meant, "key").where((F.col("meant") != F.col("form")) & (F.col("most") >= MUCH_RARER * F.col("n")))
    return pairs.select("form", "meant", F.col("most").alias("n"), (F.col("pair") == F.col("other")).alias("sure"))


def filter_of(forms: DataFrame) -> bytes:
    """The bits of the forms; another form may have the same."""
    at = F.crc32(F.col("form").cast("binary")) % BITS
    rows = forms.groupBy(F.floor(at / 64).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(crc32(cast(form as binary)) % {BITS} % 64 as int))")).alias("bits")).collect()
    words = np.zeros(BITS // 64, dtype="<i8")
    for row in rows:
        words[row["word"]] = row["bits"]
    return words.tobytes()


def _has(bits: bytes, form: str) -> bool:
    at = zlib.crc32(form.encode()) % BITS
    return bool(bits[at >> 3] >> (at & 7) & 1)


def broken_words(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, word) of each word in two parts with a hyphenation mark and white space between."""
    for m in _MARK.finditer(text):
        end = m.start()
        if text[end - 1 : end] == " ":
            end -= 1
        at = end
        while at and text[at - 1] not in _STOPS and not text[at - 1].isspace():
            at -= 1
        b = _BEHIND.match(text, m.end())
        if b and any(map(str.isalpha, text[at:end])):
            head, tail = text[at:end].lstrip(_OUTER), b.group(1).rstrip(_OUTER)
            if head and tail:
                yield end - len(head), b.start(1) + len(tail), head + tail


_MARKS = "!|\\*#•·<>=+%&§$€{}_¬\xad"
_OUTER = "()[]«»„“”\",.;:?…!|*'’"


def _trimmed(piece: str) -> str:
    return piece.strip(_MARKS).lower()


def _suspects(odd: bytes, near: bytes, several: bytes):
    def looked_up(piece: str) -> tuple[str, str, bool] | None:
        """(key, form, whether its left neighbours are counted) of what may be misread or stand for it."""
        form = _trimmed(piece)
        if len(form) > 2 and _PURE.fullmatch(form):
            key, counted = "p" if _has(odd, form) else "", _has(near, form)
            return (key, form, counted) if key or counted else None
        key = suspect(piece)
        return (key, form, _has(several, key)) if key else None

    def suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[str, str, bool] | None] = {}
        lefts: Counter[tuple[str, str]] = Counter()

        def counted() -> list[tuple]:
            return [(None, "left", left, form, n) for (left, form), n in lefts.items() if _PURE.fullmatch(left)]

        columns = ["id", "noise", "key", "form", "n"]
        for rows in batches:
            out: set[tuple] = set()
            for id_, text, book, chapter, summary in rows[["id", "text", "book", "chapter", "summary"]].itertuples(index=False, name=None):
                lines, kinds = split_lines(text, title_keys(book, chapter), bool(summary))
                out.update((id_, k, None, None, None) for k in kinds if k)
                plain, left = False, ""
                for piece in _PIECE.findall(text):
                    if piece in known:
                        found = known[piece]
                    else:
                        if len(known) > 300_000:
                            known.clear()
                        found = known[piece] = looked_up(piece)
                    if found:
                        key, form, wanted = found
                        if key == "p":
                            plain = True
                        else:
                            if key:
                                out.add((id_, "misread", key, form, None))
                            if wanted:
                                lefts[left.lower(), form] += 1
                    left = piece
                if plain:  # what a hyphenation mark leaves of a word is none
                    parts, left = [(a, b) for a, b, _ in broken_words(text)], ""
                    for m in _PIECE.finditer(text):
                        found = known.get(m.group()) or looked_up(m.group())
                        if found and found[0] == "p" and not any(a < m.end() and m.start() < b for a, b in parts):
                            out.add((id_, "misread", "p", found[1], None))
                            if found[2]:
                                lefts[left.lower(), found[1]] += 1
                        left = m.group()
                body = "\n".join(l for l, k in zip(lines, kinds) if not k) if any(kinds) else text
                for _, _, word in broken_words(body):
                    word = word.lower()
                    if len(word) > 3:
                        out.add((id_, "hyphenation", "s:" + skeleton(word), word, None))
                        form = _trimmed(word)
                        key = ("p" if _has(odd, form) else "j" if _PAIRED.search(form) else None) if _PURE.fullmatch(form) else suspect(word)
                        if key:
                            out.add((id_, "misread", key, form, None))
            if len(lefts) > 200_000:
                out.update(counted())
                lefts.clear()
            if out:
                yield pd.DataFrame([*out], columns=columns)
        if lefts:
            yield pd.DataFrame(counted(), columns=columns)

    return suspects


def candidates(chunks: DataFrame, frequent: DataFrame, pairs: DataFrame, *, id: str = "chunk_id", text: str = "text", book: str = "book_title", chapter: str = "chapter_title", summary: str = "is_summary") -> DataFrame:
    """(id, noise, key, form, n): lines that are noise (no key), and words that are if their group has a frequent form,
    or the pairs have their form (key p; j for a broken word that is nowhere whole). Rows with n say how often a form
    (noise left) stands after the word that is its key; only forms of groups with several frequent ones, and of unsure
    pairs, are counted."""
    rows = chunks.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(book).alias("book"), F.col(chapter).alias("chapter"), F.coalesce(summary, F.lit(False)).alias("summary"))
    unsure = pairs.where("not sure")
    several = groups(frequent).groupBy("key").agg(F.count("*").alias("forms"), F.collect_set("form").alias("form")).where("forms > 1").checkpoint()
    near = unsure.select("form").unionByName(unsure.select(F.col("meant").alias("form"))).unionByName(several.select(F.explode("form").alias("form")))
    scan = _suspects(filter_of(pairs.select("form")), filter_of(near), filter_of(several.select(F.col("key").alias("form"))))
    return rows.mapInPandas(scan, f"id {dict(rows.dtypes)['id']}, noise string, key string, form string, n long")


def neighbours(odd: DataFrame) -> DataFrame:
    """(left, form, times) of the forms whose left neighbours were counted."""
    return odd.where("noise = 'left'").groupBy(F.col("key").alias("left"), "form").agg(F.sum("n").alias("times"))


def supported(pairs: DataFrame, lefts: DataFrame) -> DataFrame:
    """The pairs that are sure, and those whose meant form is much more frequent after the left neighbours of half of
    the odd form's occurrences or more."""
    after = pairs.where("not sure").join(lefts, "form")
    both = after.join(lefts.withColumnsRenamed({"form": "meant", "times": "both"}), ["left", "meant"], "left")
    there = F.col("both") >= F.greatest(F.lit(FLOOR), MUCH_RARER * F.col("times"))
    shares = both.groupBy("form", "meant", "n").agg(F.sum("times").alias("all"), F.sum(F.when(there, F.col("times")).otherwise(0)).alias("good"))
    return pairs.where("sure").select("form", "meant", "n").unionByName(shares.where("2 * good >= all").select("form", "meant", "n"))


def meanings(odd: DataFrame, forms: DataFrame, frequent: DataFrame, pairs: DataFrame) -> DataFrame:
    """(form, meant): the frequent form that each misread form stands for: of several the one its left neighbours
    support best, then the most frequent, then the first."""
    words, lefts = odd.where("noise = 'misread'"), neighbours(odd)
    glyphs = resolved(words.where("key like 's:%'"), frequent).select("form", "meant", "n")
    only = words.where("key = 'j'").select("form").distinct().join(forms, "form", "left_anti").withColumn("n", F.lit(1).cast("long"))
    joined = plain_pairs(only, frequent).where("sure").select("form", "meant", "n")
    choices = glyphs.unionByName(supported(pairs, lefts)).unionByName(joined).groupBy("form", "meant").agg(F.max("n").alias("n"))
    near = lefts.withColumnsRenamed({"form": "meant", "times": "both"})
    support = choices.join(lefts, "form").join(near, ["left", "meant"]).groupBy("form", "meant").agg(F.sum(F.log1p("both")).alias("support"))
    order = F.struct(-F.coalesce("support", F.lit(0.0)), -F.col("n"), F.col("meant"))
    return choices.join(support, ["form", "meant"], "left").groupBy("form").agg(F.min_by("meant", order).alias("meant"))


def resolved(forms: DataFrame, frequent: DataFrame) -> DataFrame:
    """(key, form, meant, n) of the odd forms, one row for each record that has them, with each frequent form that
    they may stand for."""
    meant = groups(frequent).withColumnsRenamed({"form": "meant"})
    own = forms.groupBy("key", "form").agg(F.count("*").alias("own"))
    return own.join(meant, "key").where((F.col("meant") != F.col("form")) & (F.col("n") >= F.col("own"))).select("key", "form", "meant", "n")


def broken(odd: DataFrame, frequent: DataFrame) -> DataFrame:
    """The rows of odd with broken words whose joined form, or one it may stand for, is frequent."""
    words = odd.where("noise = 'hyphenation'")
    most = groups(frequent).groupBy("key").agg(F.max("n").alias("n"))
    whole = words.groupBy("key", "form").agg(F.count("*").alias("own")).join(most, "key").where(F.col("n") >= F.col("own"))
    return words.join(whole.select("key", "form"), ["key", "form"], "left_semi")


def _found(chunks: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The candidates, the frequent forms, and (form, meant) of the misread ones."""
    ensure_checkpoints(chunks.sparkSession)
    forms = plain_forms(chunks, text=columns.get("text", "text"))
    frequent = lexicon(forms)
    pairs = plain_pairs(forms, frequent).checkpoint()
    odd = candidates(chunks, frequent, pairs, **columns).checkpoint()
    return odd, frequent, meanings(odd, forms, frequent, pairs)


def noise(chunks: DataFrame, *, id: str = "chunk_id", **columns: str) -> DataFrame:
    """(id, noise), one row per record and kind of noise."""
    odd, frequent, meant = _found(chunks, id=id, **columns)
    lines = odd.where("noise != 'left' and key is null").select("id", "noise")
    misread = odd.where("noise = 'misread'").join(meant, "form", "left_semi").select("id", "noise")
    return lines.unionByName(misread).unionByName(broken(odd, frequent).select("id", "noise")).distinct().withColumnRenamed("id", id)


def _like(word: str, model: str) -> str:
    return word.upper() if model.isupper() and len(model) > 1 else word.capitalize() if model[:1].isupper() else word


def _repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for text, book, chapter, summary, words, joins in rows[["text", "book", "chapter", "summary", "words", "joins"]].itertuples(index=False, name=None):
            if text is None:
                out.append(None)
                continue
            lines, kinds = split_lines(text, title_keys(book, chapter), bool(summary))
            body = "\n".join(l for l, k in zip(lines, kinds) if not k)
            if joins is not None and len(joins):
                whole, at, parts = set(joins), 0, []
                for a, b, word in broken_words(body):
                    if word.lower() in whole and a >= at:
                        parts += [body[at:a], word]
                        at = b
                body = "".join(parts) + body[at:]
            if words is not None and len(words):
                meant = dict(words)

                def swap(m):
                    piece = m.group()
                    form = piece.strip(_MARKS)
                    new = meant.get(form.lower())
                    return piece.replace(form, _like(new, form)) if new else piece

                body = _PIECE.sub(swap, body)
            out.append(body)
        yield rows[["row", "id"]].assign(body=out)


def repaired(chunks: DataFrame, *, id: str = "chunk_id", text: str = "text", book: str = "book_title", chapter: str = "chapter_title", summary: str = "is_summary") -> DataFrame:
    """(id, paragraphs): every text without the noise, its lines reflowed. A null text stays null."""
    ensure_checkpoints(chunks.sparkSession)
    own = chunks.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.col(text).alias("text"), F.col(book).alias("book"), F.col(chapter).alias("chapter"), F.coalesce(summary, F.lit(False)).alias("summary"))
    rows = own.checkpoint()  # the numbers must stay
    odd, frequent, meant = _found(rows, id="row", text="text", book="book", chapter="chapter", summary="summary")
    words = odd.where("noise = 'misread'").select("id", "form").distinct().join(meant, "form")
    words = words.groupBy(F.col("id").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("form", "meant"))).alias("words"))
    joins = broken(odd, frequent).groupBy(F.col("id").alias("row")).agg(F.collect_set("form").alias("joins"))
    ready = rows.join(words, "row", "left").join(joins, "row", "left")
    bodies = ready.mapInPandas(_repair, f"row long, id {dict(rows.dtypes)['id']}, body string")
    lines = bodies.select("row", "id", F.posexplode_outer(F.split("body", "\n", -1)).alias("pos", "line"))
    # a paragraph starts after a blank line; a row of a table or an item of a list stands by itself
    own = F.col("line").rlike(r"^\s*(?:\||[-*•#]\s|\d+[.)]\s)")
    blank = F.col("line").rlike(r"^\s*$")
    order = Window.partitionBy("row").orderBy("pos")
    marked = lines.select("row", "id", "pos", F.trim(F.regexp_replace("line", r"\s+", " ")).alias("line"), own.alias("own"), blank.alias("blank"))
    marked = marked.withColumn("starts", F.col("own") | F.coalesce(F.lag("blank").over(order) | F.lag("own").over(order), F.lit(True)))
    marked = marked.withColumn("par", F.sum(F.col("starts").cast("int")).over(order))
    line = F.when(~F.col("blank"), F.struct("pos", "line"))
    pars = marked.groupBy("row", "par").agg(F.any_value("id").alias("id"), F.max("pos").alias("pos"), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), " ").alias("text"), F.bool_or("own").alias("own"))
    whole = pars.groupBy("row").agg(F.any_value("id").alias("id"), F.max("pos").alias("lines"), F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("par", "own", "text")))).alias("p"))
    text_of = F.aggregate("p", F.struct(F.lit("").alias("t"), F.lit(False).alias("own")), lambda acc, x: F.struct(
        F.when(acc["t"] == "", x["text"]).otherwise(F.concat(acc["t"], F.when(acc["own"] & x["own"], "\n").otherwise("\n\n"), x["text"])).alias("t"), x["own"].alias("own")))
    return whole.select(F.col("id").alias(id), F.when(F.col("lines").isNotNull(), text_of["t"]).alias("paragraphs"))
