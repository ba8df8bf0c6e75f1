"""Problem 8: sentence units of texts in any language and script, by offsets.

The rules are a finite transducer. Its input symbols are pieces of the text that a regular expression finds with
bounded context (words, quotations, brackets, end marks, line breaks with what the next line is); its states say
what kind of line it is in and how the sentence began; some transitions give a boundary. Every text is cut into
blocks. A block is a function from the state before it to the state after it, and the blocks' functions are composed
by a prefix scan, after which every block knows its first state and its boundaries. A block begins between two
letters or between a blank and a letter, where only words, quotations and brackets go on; where its first piece starts
is part of the state, as a quotation or bracket may reach over the edge; few places are possible.

A text of up to PART characters is scanned in one task, all texts of a batch at once. The parts of a longer one are
functions made of their blocks' functions; of each only the function travels to where they are composed, and the way
in travels back. Units that reach over parts are put together from their two ends.

Rules for odd input, covered by tests: null, empty and blank texts have no units; a unit has a letter or digit;
quotations and brackets over SPAN characters, or not closed in their paragraph, don't hold sentences together;
repeated rows each get their units; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = 600
#: texts are cut into blocks of about this many characters; a task takes at most PART of a text
BLOCK, PART = 512, 1 << 18
#: how far a quotation or bracket reaches over an edge at most
REACH = SPAN + 4

# fixed values: abbreviations that don't end a sentence before a capital or a figure
ABBREVIATIONS = frozenset(
    """
    dr prof mr mrs ms st mt jr sr rev hon gen col capt lt sgt messrs mme mlle mm me mgr pr dres hr fr frl dipl ing
    fig figs tab tabl table no nos nr vol vols ed eds pp p pg ch sec eq ref refs app cf vs viz approx ca circa env
    e.g i.e al ibid op cit esp incl excl max min avg est b d abb bzw z.b d.h u.a s.o vgl bspw ggf inkl usw.a kap bd aufl
    p.ex c.-à-d av apr boul rue
    д-р проф доц акад ст ас инж арх г-н г-жа ул бул пл гр обл фиг табл вж ср ок род вкл напр съавт лат рис см стр
    гл т.нар т.е им чл ал кв ап ет тел бр прибл св
    डॉ श्री द.
    """.split()
)
# fixed values: abbreviations that may end one, if a capital follows
EITHER = frozenset("a.m p.m etc inc ltd co corp т.н т.д т.п др д ч г гг в ш и.v i.v u.s u.k e.r usw u.a.m".split())

_CLOSE = r"""(?:[)\]}»”’"'」』）】》]|“(?!\w))"""
_TOKEN = regex.compile(
    rf"""
    (?P<line>[^\S\n]*\n\s*)
  | (?P<quote>„(?:[^„“”\n]|\n(?!\s*\n)){{1,{SPAN}}}[“”] | “(?:[^“”\n]|\n(?!\s*\n)){{1,{SPAN}}}” | «(?:[^«»\n]|\n(?!\s*\n)){{1,{SPAN}}}»
      | 「[^「」]{{1,{SPAN}}}」 | 『[^『』]{{1,{SPAN}}}』 | "(?:[^"\n]|\n(?!\s*\n)){{1,{SPAN}}}")
  | (?P<bracket>\((?:[^()\n]|\n(?!\s*\n)){{1,{SPAN}}}\) | （[^（）]{{1,{SPAN}}}）)
  | (?P<end>(?:[.!?…。！？।॥؟۔｡]|\s(?=[।॥]))+{_CLOSE}*(?:\s?\[\d{{1,3}}(?:[,–-]\s?\d{{1,3}})*\])*)
  | (?P<thai>(?<=[ก-ๅ็-๎”“"])[^\S\n]+(?=[ก-ฮเ-ไ]))
  | (?P<word>(?:[^\s„“«「『"(（.!?…。！？।॥؟۔｡]|[^\S\n](?![।॥])(?![ก-ฮเ-ไ]))+)
  | (?P<other>.)
    """,
    regex.VERBOSE | regex.DOTALL,
)

# the states: at the start of a paragraph, between two sentences, in one, in one that so far is a quotation, in a
# list item, in a heading
START, BETWEEN, INSIDE, QUOTED, ITEM, HEADING = range(6)
STATES = 6
# the symbols: words, a quotation, one that ends like a sentence before a capital, or before a letter without case;
# a bracket that ends like a sentence; an end mark; a line break before a plain line, a list item, a heading; a
# blank line
WORD, QUOTE, QUOTE_CAPITAL, QUOTE_LETTER, BRACKET, END, PLAIN, LISTED, HEAD, BLANK = range(10)

_NEXT = np.tile(np.arange(STATES, dtype=np.int8), (10, 1))
_EMIT = np.zeros((10, STATES), dtype=bool)
for _s, _rule in {
    WORD: {START: INSIDE, BETWEEN: INSIDE, QUOTED: INSIDE},
    QUOTE: {START: QUOTED, BETWEEN: QUOTED},
    QUOTE_CAPITAL: {START: (BETWEEN,), BETWEEN: (BETWEEN,), INSIDE: (BETWEEN,), QUOTED: (BETWEEN,)},
    QUOTE_LETTER: {START: QUOTED, BETWEEN: QUOTED, INSIDE: (BETWEEN,), QUOTED: QUOTED},
    BRACKET: {START: (BETWEEN,), BETWEEN: (BETWEEN,), QUOTED: INSIDE},
    END: {START: (BETWEEN,), BETWEEN: (BETWEEN,), INSIDE: (BETWEEN,), QUOTED: (BETWEEN,)},
    PLAIN: {HEADING: (BETWEEN,), START: BETWEEN},
    LISTED: {START: (ITEM,), ITEM: (ITEM,), HEADING: (ITEM,)},
    HEAD: {s: (HEADING,) for s in range(STATES)},
    BLANK: {s: (START,) for s in range(STATES)},
}.items():
    for _from, _to in _rule.items():
        _NEXT[_s, _from] = _to[0] if isinstance(_to, tuple) else _to
        _EMIT[_s, _from] = isinstance(_to, tuple)

_HEADING = regex.compile(r"#{1,6}[ \t]")
_ITEM = regex.compile(r"(?:[-*•‣◦▪]|\d{1,3}[.)]|[a-zA-Z]\))[ \t]")
_LAST = regex.compile(r"[^\s(\[„“«\"]{1,24}$")
_AFTER = regex.compile(rf"(\s*)([„“«\"'‘「『(（\[¿¡—–-]*\s?)(\S?)")
# fixed values: German words before an ordinal number
_ORDINAL = regex.compile(r"(?:^|[\s(])(?:am|der|die|das|dem|den|des|vom|zum|zur|im|beim|bis|ab|seit|jeder|jeden|ein|einem|einer)\s+\d+$", regex.IGNORECASE)
_LETTER = regex.compile(r"\s\p{L}\.")
_CASELESS = regex.compile(r"[\p{Lo}\p{Nd}]")
#: where a block may begin: nothing but words, quotations and brackets goes on there
_CLEAN = regex.compile(r"(?<=\p{L}|[^\S\n])(?=\p{L})")
_OPENING = regex.compile(r"[„“«「『\"(（]")
_RUN = regex.compile(r"[\s„“«\"'‘「『(（\[¿¡—–-]*")


def _line_kind(text: str, at: int) -> int:
    return HEAD if _HEADING.match(text, at) else LISTED if _ITEM.match(text, at) else PLAIN


def _ends(text: str, start: int, end: int) -> bool:
    """Whether the end mark from start to end ends a sentence, by what stands on either side."""
    mark = text[start:end]
    stop = mark.rstrip("[]0123456789,–- ")
    after = _AFTER.match(text, end)
    space, opening, first = after.group(1), after.group(2), after.group(3)
    if not first and not opening:
        return True
    closed = stop[-1:] not in ".!?…。！？।॥؟۔｡" if stop else False
    capital = first.isupper() or first.istitle()
    if mark[0] in "。！？।॥؟۔｡" or mark.lstrip()[:1] in "।॥":
        return not (closed and not opening)  # a closing mark after it: attribution follows
    if mark[0] in "!?":
        if closed or opening.strip() in ("—", "–", "-"):
            return capital and not opening.strip()
        return bool(space) or capital or bool(_CASELESS.match(first))
    if mark[0] == "…" or mark.startswith(".."):
        return capital
    before = _LAST.search(text, max(0, start - 24), start)
    word = before.group() if before else ""
    head, _, tail = word.rpartition(".")
    if tail[:1].isupper() and len(tail) > 1 and head[-1:].islower():  # a blank is missing between two sentences
        word = tail
    word = word.lower().lstrip("'’‘")
    if not word:
        return False
    last = text[start - 1]
    if "ऀ" <= last <= "ॿ" or "฀" <= last <= "๿":
        return False
    if not space:
        if not capital:
            return bool(opening) and first.isupper() and not closed
        return (last.islower() or last.isdigit() or last in ")]%°»”“") and word not in ABBREVIATIONS and not ("." in word and len(word) < 6) and "://" not in word and not word.startswith("www")
    if first.islower():
        return False
    if word in ABBREVIATIONS:
        return False
    if word.isdigit() and capital and not opening and _ORDINAL.search(text, max(0, start - 24), start):
        return False
    if len(word) == 1 and word.isalpha() and _LETTER.match(text, end):
        return False
    if len(word) == 1 and word.isalpha() and (last.isupper() or not word.islower() or "؀" <= last <= "ۿ"):
        return False
    if first.isdigit() and not opening:
        return len(word) > 3 and not (len(word) == 1 and word.isalpha()) and word not in EITHER
    if regex.fullmatch(r"\p{L}(?:\.\p{L})+", word) and word not in EITHER:
        return False
    return True


def symbols(text: str) -> tuple[list[int], list[int]]:
    """The symbols of the pieces of a whole text, and for each the place where a boundary would be."""
    return walked(text, 0, len(text))[:2]


def walked(text: str, start: int, end: int) -> tuple[list[int], list[int], int]:
    """The symbols and places of the pieces that start from start to end, and where the first piece behind starts."""
    stop = start
    kinds: list[int] = []
    places: list[int] = []
    if start == 0:
        first = len(text) - len(text.lstrip())
        kinds.append(_line_kind(text, first))
        places.append(0)
    for m in _TOKEN.finditer(text, start) if start < end else ():
        kind = m.lastgroup
        a, b = m.span()
        if a >= end:
            break
        stop = end if kind == "word" and b > end else b
        if kind == "word":
            if m.group().strip():
                kinds.append(WORD)
                places.append(a)
        elif kind == "line":
            if m.group().count("\n") > 1:
                kinds.append(BLANK)
                places.append(a)
            if b < len(text):
                kinds.append(_line_kind(text, b))
                places.append(a)
        elif kind == "end":
            kinds.append(END if _ends(text, a, b) else WORD)
            places.append(b)
        elif kind == "thai":
            said = text[max(0, a - 3) : a]
            kinds.append(WORD if said == "ว่า" else END)
            places.append(a)
        elif kind == "quote":
            inner = text[b - 2 : b - 1] if text[b - 2 : b - 1].strip() else text[a : b - 1].rstrip()[-1:]
            after = _AFTER.match(text, b)
            first = after.group(3)
            if inner in ".!?…。！？।॥؟۔｡" and first and not after.group(2).strip(" „“«\"'‘「『(（\n"):
                capital = first.isupper()
                kinds.append(QUOTE_CAPITAL if capital else QUOTE_LETTER if _CASELESS.match(first) and not first.isdigit() or first.isdigit() and inner not in "." else QUOTE)
                if after.group(2).strip() and not capital:
                    kinds[-1] = QUOTE_LETTER
            else:
                kinds.append(QUOTE)
            places.append(b)
        elif kind == "bracket":
            inner = text[a : b - 1].rstrip()[-1:]
            kinds.append(BRACKET if inner in ".!?…。！？।" else WORD)
            places.append(b)
        elif not m.group().isspace():
            kinds.append(WORD)
            places.append(a)
    return kinds, places, stop


def edges(text: str, start: int, end: int, size: int) -> list[int]:
    """The inner edges of blocks of size characters or a few more."""
    out = []
    while m := _CLEAN.search(text, start + size, end):
        start = m.start()
        out.append(start)
    return out


def entries(text: str, edge: int) -> list[int]:
    """The places where the first piece of a block from the edge on may start."""
    if edge == 0:
        return [0]
    found = {edge}
    for m in _OPENING.finditer(text, max(0, edge - REACH), edge):
        piece = _TOKEN.match(text, m.start())
        if piece.lastgroup in ("quote", "bracket") and piece.end() > edge:
            found.add(piece.end())
    return sorted(found)


#: a block: where its first piece may start, and the symbols, places and end of each way
Block = tuple[list[int], list[tuple[list[int], list[int], int]]]


def blocks_of(text: str, start: int, end: int, size: int) -> list[Block]:
    at = [start, *edges(text, start, end, size), end]
    ways = [entries(text, a) for a in at[:-1]]
    return [(own, [walked(text, way, b) for way in own]) for own, b in zip(ways, at[1:])]


def function_of(kinds: list[int]) -> bytes:
    """The state after the symbols for each state before them."""
    state = _EVERY
    for k in kinds:
        state = state.translate(_STEP[k])
    return state


def boundaries(kinds: list[int], places: list[int], state: int) -> list[int]:
    out = []
    for k, p in zip(kinds, places):
        if _EMIT_LIST[k][state]:
            out.append(p)
        state = _NEXT_LIST[k][state]
    return out


_NEXT_LIST, _EMIT_LIST = _NEXT.tolist(), _EMIT.tolist()
_EVERY = bytes(range(STATES))
_STEP = [bytes(row) + bytes(256 - STATES) for row in _NEXT_LIST]


def functions(blocks: list[Block], nexts: list[dict[int, int]]) -> np.ndarray:
    """One row a block. What it maps is the way in and the state in one number, way * STATES + state; nexts says which
    way of the next block starts at a place."""
    out = np.zeros((len(blocks), max(len(own) for own, _ in blocks) * STATES), dtype=np.int32)
    for row, (_, ways), then in zip(out, blocks, nexts):
        for n, (kinds, _, stop) in enumerate(ways):
            row[n * STATES : (n + 1) * STATES] = np.frombuffer(function_of(kinds), dtype=np.uint8) + then[stop] * STATES
    return out


def scan(functions: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of the functions (one a row), in log2 steps over all rows at once."""
    functions, step = functions.copy(), 1
    while step < len(functions):
        functions[step:] = np.take_along_axis(functions[step:], functions[:-step].copy(), axis=1)
        step *= 2
    return functions


class _Any(dict):
    """The end of a text: every way ends in the first of the next text."""

    def __missing__(self, _: int) -> int:
        return 0


def _nexts(blocks: list[Block]) -> list[dict[int, int]]:
    return [{at: n for n, at in enumerate(own)} for own, _ in blocks[1:]]


#: texts are scanned together up to this many numbers
TOGETHER = 1 << 20


def cuts_of(texts: list[str], block: int) -> Iterator[list[int]]:
    """The boundaries of each text, by a prefix scan over the blocks of many texts."""
    at = 0
    while at < len(texts):
        blocks: list[Block] = []
        nexts: list[dict[int, int]] = []
        lengths: list[int] = []
        widest = 1
        while at < len(texts) and len(blocks) * widest * STATES < TOGETHER:
            own = blocks_of(texts[at], 0, len(texts[at]), block)
            blocks += own
            nexts += [*_nexts(own), _Any()]
            lengths.append(len(own))
            widest = max(widest, *(len(ways) for ways, _ in own))
            at += 1
        own = functions(blocks, nexts)
        firsts = np.cumsum([0, *lengths[:-1]])
        own[firsts] = own[firsts, START][:, None]  # a text starts in one state, whatever the text before left
        before = np.concatenate([[START], scan(own)[:-1, START]])
        before[firsts] = START
        states = before.tolist()
        n = 0
        for length in lengths:
            cuts: list[int] = []
            for _, ways in blocks[n : n + length]:
                way, state = divmod(states[n], STATES)
                cuts += boundaries(*ways[way][:2], state)
                n += 1
            yield cuts


def spans(text: str, cuts: list[int]) -> list[tuple[int, int]]:
    """The pieces between the cuts, without white space around them; only those with a letter or digit."""
    out, at = [], 0
    for cut in [*cuts, len(text)]:
        piece = text[at:cut]
        a = at + len(piece) - len(piece.lstrip())
        b = a + len(piece.strip())
        if any(c.isalnum() for c in text[a:b]):
            out.append((a, b))
        at = cut
    return out


def units(text: str) -> list[tuple[int, int]]:
    """The units by one pass from the start to the end, for tests."""
    return spans(text, boundaries(*symbols(text), START))


def _whole(kind: str, block: int):
    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ids, at = [], []
            for i, t, cuts in zip(rows["id"], rows["text"], cuts_of(rows["text"].tolist(), block)):
                own = spans(t, cuts)
                ids.extend([i] * len(own))
                at.extend(own)
            yield pd.DataFrame({"id": pd.Series(ids, dtype=rows["id"].dtype), "sent_start": [a for a, _ in at], "sent_end": [b for _, b in at]})

    return whole


def _parts(part: int):
    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(row, id, part, begin, lead, end, seen) of the parts, with what the rules may see on either side."""
        for rows in batches:
            for row, id_, text in rows.itertuples(index=False, name=None):
                at = [0, *edges(text, 0, len(text), part), len(text)]
                for n, (a, b) in enumerate(zip(at, at[1:])):
                    lead = min(a, 2 * REACH)
                    seen = text[a - lead : _RUN.match(text, min(len(text), b + 2 * REACH)).end() + REACH]
                    yield pd.DataFrame({"row": [row], "id": [id_], "part": [n], "begin": [a - lead], "lead": [lead], "end": [b - a + lead], "seen": [seen]})

    return parts


def _part_functions(block: int):
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(row, part, starts, ends, states, cuts): the places where a part's first piece may start; and for each of
        them and each state where its last one ends, in which state, and whether there is a boundary."""
        for rows in batches:
            for row, part, begin, lead, end, seen in rows[["row", "part", "begin", "lead", "end", "seen"]].itertuples(index=False, name=None):
                blocks = blocks_of(seen, lead, end, block)
                stops = sorted({stop for _, _, stop in blocks[-1][1]})
                own = functions(blocks, [*_nexts(blocks), {stop: n for n, stop in enumerate(stops)}])
                all_ = scan(own)
                before = np.vstack([np.arange(own.shape[1]), all_[:-1]])
                cutting = np.zeros(own.shape, dtype=bool)
                for n, (_, ways) in enumerate(blocks):
                    for w, (kinds, places, _) in enumerate(ways):
                        cutting[n, w * STATES : (w + 1) * STATES] = [bool(boundaries(kinds, places, s)) for s in range(STATES)]
                there = len(blocks[0][0]) * STATES
                after = all_[-1][:there]
                cuts = np.take_along_axis(cutting, before, axis=1).any(axis=0)[:there]
                yield pd.DataFrame({"row": [row], "part": [part], "starts": [[s + begin for s in blocks[0][0]]], "ends": [[stops[i] + begin for i in (after // STATES).tolist()]], "states": [(after % STATES).tolist()], "cuts": [cuts.tolist()]})

    return made


def _ways_in(rows: pd.DataFrame) -> pd.DataFrame:
    """(row, part, start, state, piece): where and in which state each part of a text starts, and the number of parts
    with a boundary before it. A text has at most 8,192 parts of PART characters, as a string has at most 2 GB."""
    rows = rows.sort_values("part", ignore_index=True)
    starts = [{int(at): n for n, at in enumerate(own)} for own in rows["starts"]]
    own = np.zeros((len(rows), max(map(len, rows["states"]))), dtype=np.int32)
    for n, (ends, states) in enumerate(zip(rows["ends"], rows["states"])):
        own[n, : len(ends)] = np.asarray(states) + (STATES * np.array([starts[n + 1][int(at)] for at in ends]) if n + 1 < len(rows) else 0)
    before = [START, *scan(own)[:-1, START].tolist()]
    cuts = [bool(c[b]) for c, b in zip(rows["cuts"], before)]
    return pd.DataFrame({"row": rows["row"], "part": rows["part"], "start": [own[b // STATES] for own, b in zip(rows["starts"], before)], "state": [b % STATES for b in before], "piece": np.cumsum([0, *cuts[:-1]])})


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(row, id, piece, n, start, end, worded) of the pieces between the boundaries of a part: the first and the last
    one (n = 0) may go on in other parts, and meet there under one number."""
    for rows in batches:
        for row, id_, begin, end, seen, start, state, piece in rows[["row", "id", "begin", "end", "seen", "start", "state", "piece"]].itertuples(index=False, name=None):
            kinds, places, stop = walked(seen, start - begin, end)
            at = [start - begin, *boundaries(kinds, places, state), stop]
            out = []
            for n, (a, b) in enumerate(zip(at, at[1:])):
                text = seen[a:b]
                if text.strip():
                    key = (piece, 0) if n == 0 else (piece + 1, 0) if n == len(at) - 2 else (piece, n)
                    out.append((row, id_, *key, begin + b - len(text.lstrip()), begin + a + len(text.rstrip()), any(map(str.isalnum, text))))
            if out:
                yield pd.DataFrame(out, columns=["row", "id", "piece", "n", "start", "end", "worded"])


def sentences(docs: DataFrame, *, id: str = "doc_id", text: str = "text", block: int = BLOCK, part: int = PART) -> DataFrame:
    """(id, sent_start, sent_end) of every unit of every text, in code points."""
    kind = dict(docs.dtypes)[id]
    rows = docs.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"))
    short = rows.where(F.length("text") <= part).mapInPandas(_whole(kind, block), f"id {kind}, sent_start int, sent_end int")
    long = rows.where(F.length("text") > part).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    parts = long.mapInPandas(_parts(part), f"row long, id {kind}, part int, begin int, lead int, end int, seen string").repartition("row", "part")
    made = parts.mapInPandas(_part_functions(block), "row long, part int, starts array<int>, ends array<int>, states array<int>, cuts array<boolean>")
    ways = made.groupBy("row").applyInPandas(_ways_in, "row long, part int, start int, state int, piece int")
    pieces = parts.join(ways, ["row", "part"], "left").mapInPandas(_pieces, f"row long, id {kind}, piece int, n int, start int, end int, worded boolean")
    joined = pieces.groupBy("row", "piece", "n").agg(F.any_value("id").alias("id"), F.min("start").alias("sent_start"), F.max("end").alias("sent_end"), F.bool_or("worded").alias("worded"))
    return short.unionByName(joined.where("worded").select("id", "sent_start", "sent_end")).withColumnRenamed("id", id)
