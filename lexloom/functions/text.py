"""Text as columns: cleaning, splitting and testing, all inside Spark's own functions.

Null gives null throughout. Line ends are ``\\n`` (``(?d)``), white space and digits are Unicode's where the text
may be in any script (``(?U)``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that are no keywords, Bulgarian and English
STOPWORDS = (
    "на е и с в от до се за при са ли да не то ще или но само те тя си болест заболяване симптом признак "
    "the a an of and or is are was what which how"
).split()
# fixed values: what separates keywords, and words of Latin letters
WORD_SEPARATORS = "[ ,.?!()-]+"
LATIN_SEPARATORS = r"[ ,.!?():;\t\n/-]"


def tokens(text: Column) -> Column:
    """Runs of letters in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)


def index_terms(text: Column) -> Column:
    """The tokens that are indexed: two letters or more."""
    return F.filter(tokens(text), lambda t: F.length(t) > 1)


def strip(text: Column) -> Column:
    """Without surrounding white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


# fixed values: the patterns of images, soft hyphens, broken words and specks, here and in the functions below


def without_data_images(text: Column) -> Column:
    return F.regexp_replace(text, r"!\[[^\]]*\]\(data:[^)]+\)", "")


def without_image_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"(?md)^\s*!\[[^\]]*\]\([^)]+\.(?:jpg|jpeg|png|gif|webp|svg)\)\s*$", "")


def without_soft_hyphens(text: Column) -> Column:
    return F.regexp_replace(text, "\u00ad[ \\t]*", "")


def joined_hyphens(text: Column) -> Column:
    """``a - b`` and ``a- b`` as ``ab`` before a lower-case letter."""
    left, right = "([А-Яа-яЁёA-Za-z0-9])", "([А-Яа-яёa-z])"
    return F.regexp_replace(F.regexp_replace(text, f"{left} - {right}", "$1$2"), f"{left}- {right}", "$1$2")


def single_spaces(text: Column) -> Column:
    """Runs of white space within a line as one blank."""
    return F.regexp_replace(text, r"(?U)[^\S\n]{2,}", " ")


def without_specks(text: Column) -> Column:
    """Without the accented Latin letters that scanners put between Cyrillic ones."""
    return F.regexp_replace(text, "(?<=[Ѐ-ӿ])[çãőñõÇÃŐÑÕ]+(?=[Ѐ-ӿ])", "")


def clean_markdown(text: Column) -> Column:
    out = without_image_lines(without_data_images(text))
    return without_specks(single_spaces(joined_hyphens(without_soft_hyphens(out))))


# fixed values: the patterns of headings, titles of an outline and reference marks, here and in the functions below


def heading_level(line: Column) -> Column:
    """1 to 6 of a markdown heading, else 0."""
    return F.length(F.regexp_extract(line, r"(?dU)^(#{1,6})\s+(.+)", 1))


def heading_title(line: Column) -> Column:
    return strip(F.regexp_extract(line, r"(?dU)^(#{1,6})\s+(.+)", 2))


def line_type(line: Column) -> Column:
    """table or list by the first mark of a line, else null."""
    mark = F.substring(F.regexp_replace(line, r"(?U)^\s+", ""), 1, 1)
    return F.when(mark == "|", "table").when(mark.isin("-", "*"), "list")


def rough_sentences(text: Column) -> Column:
    """Cut at white space after an end mark."""
    return F.split(text, r"(?U)(?<=[.!?])\s+")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def html_snippet(html: Column, length: int = 800) -> Column:
    flat = F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s{2,}", " ")
    return F.substring(strip(flat), 1, length)


def stripped_answer(answer: Column) -> Column:
    """A model's answer without reasoning block and markdown; reference marks like [1] stay."""
    # fixed values: what is taken off, in this order
    steps = ((r"(?s)<think>.*?</think>\s*", ""), (r"(?md)^#{1,6}\s+", ""), (r"(?s)\*\*(.+?)\*\*", "$1"), (r"(?d)\*(.+?)\*", "$1"), (r"(?md)^[ \t]*[-*]\s+", ""), (r"(?md)^[ \t]*\d+\.\s+", ""))
    out = answer
    for pattern, new in steps:
        out = F.regexp_replace(out, pattern, new)
    return strip(out)


def citations(answer: Column, sources: Column) -> Column:
    """The numbers of all reference marks whose numbers all lie in 1..sources, in order."""
    groups = F.regexp_extract_all(answer, F.lit(r"(\[\s*\d{1,9}(?:\s*,\s*\d{1,9})*\s*\])"), 1)
    numbers = F.transform(groups, lambda g: F.transform(F.regexp_extract_all(g, F.lit(r"(\d+)"), 1), lambda n: n.cast("int")))
    return F.flatten(F.filter(numbers, lambda g: F.forall(g, lambda n: (n >= 1) & (n <= sources))))


def answer_segments(answer: Column, sources: Column) -> Column:
    """The answer as (text, citation): marks that hold become one segment a number, the rest stays text."""
    mark = r"(\[\s*\d{1,9}(?:\s*,\s*\d{1,9})*\s*\])"
    pieces = F.split(F.regexp_replace(answer, mark, "\u0001$1\u0001"), "\u0001")

    def cut(piece: Column) -> Column:
        numbers = F.when(piece.rlike("^" + mark + "$"), F.transform(F.regexp_extract_all(piece, F.lit(r"(\d+)"), 1), lambda n: n.cast("int"))).otherwise(F.array().cast("array<int>"))
        holds = (F.size(numbers) > 0) & F.forall(numbers, lambda n: (n >= 1) & (n <= sources))
        text = F.array(F.struct(piece.alias("text"), F.lit(None).cast("int").alias("citation")))
        return F.when(holds, F.transform(numbers, lambda n: F.struct(F.lit(None).cast("string").alias("text"), n.alias("citation")))).otherwise(text)

    return F.filter(F.flatten(F.transform(pieces, cut)), lambda s: s["citation"].isNotNull() | (s["text"] != ""))


def outline(text: Column, most: int = 100) -> Column:
    """The titles of second-level headings that read like titles, one a line."""
    titles = F.transform(F.regexp_extract_all(text, F.lit("(?md)^## (.+)$"), 1), strip)
    kept = F.filter(titles, lambda t: (F.length(t) >= 5) & ~t.rlike("[:.]$") & ~t.rlike("[=+]"))
    return F.array_join(F.slice(kept, 1, most), "\n")


def latin_terms(text: Column) -> Column:
    """Distinct words of five or more ASCII letters, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), LATIN_SEPARATORS), lambda w: w.rlike("(?d)^[a-z]{5,}$")))


def longest(words: Column) -> Column:
    """The longest word, the first of equals; null if there is none."""
    return F.aggregate(words, F.lit(None).cast("string"), lambda best, w: F.when(best.isNull() | (F.length(w) > F.length(best)), w).otherwise(best))


def keywords(text: Column) -> Column:
    """Words of four or more characters that are no stopwords."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(F.split(text, WORD_SEPARATORS), lambda w: (F.length(w) > 3) & ~F.array_contains(stop, F.lower(w)))


def has_cyrillic(text: Column) -> Column:
    return text.rlike("[\u0400-\u04ff]")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, " "), lambda w: w != ""))


def contains_ignoring_case(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def language_code(name: Column) -> Column:
    """en, bg or both, by code or English name."""
    low = F.lower(strip(name))
    return F.when(low.isin("en", "english"), "en").when(low.isin("bg", "bulgarian"), "bg").otherwise("both")


def path_parts(path: Column) -> tuple[Column, Column]:
    """Chapter and section ('' if none) of a heading path."""
    parts = F.split(path, " > ", 2)
    return F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
