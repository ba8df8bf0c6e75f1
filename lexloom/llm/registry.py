"""The training-data queries over the given tables, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encodings, languages, lines, mixing, scans, sentences, tokens, vocabulary


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = vocabulary.marked_frequencies(_table(spark, d, "bm25_book_terms"), _table(spark, d, "bm25_book_stats"))
    return found.where("mark is not null").select("term", "mark")


def p1_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.vocabulary_frequencies(_table(spark, d, "bm25_vocab"), _table(spark, d, "bm25_book_terms"), _table(spark, d, "bm25_book_stats"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noise(_table(spark, d, "chunks"))


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(_table(spark, d, "chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(_table(spark, d, "chunks")).select(F.col("id").alias("chunk_id"), "line_no")


def p3_clean_text(spark: SparkSession, d: str) -> DataFrame:
    return lines.without_repeated_lines(_table(spark, d, "chunks").select("chunk_id", "book_id", "chunk_index", "text")).select("chunk_id", "book_id", "chunk_index", "clean_text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return encodings.garbled_records(_table(spark, d, "chunks")).select("chunk_id")


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    return encodings.garbled_records(_table(spark, d, "chunks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = _table(spark, d, "chunks")
    return languages.mislabelled(chunks, languages.train(chunks))


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    chunks = _table(spark, d, "chunks")
    return languages.segments(chunks, languages.train(chunks))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(_table(spark, d, "documents"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(_table(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return tokens.decode_corpus(tokens.encode_corpus(_table(spark, d, "documents")))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.select_mix(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))


def p7_kept_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(_table(spark, d, "documents"), _table(spark, d, "mix_targets"), keep_shares=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = (p1_found, p1_vocabulary, p2_found, p2_repaired, p3_found, p3_clean_text, p4_found, p4_restored, p5_found, p5_segments, p6_ids, p6_round_trip, p7_mix, p7_report, p7_kept_shares, p8_found)
    return {f.__name__: f for f in names}


_FOLD = r"regexp_replace(lower(regexp_replace(nfc_normalize({0}), '\p{{Cf}}', '', 'g')), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_P1 = f"""
with raw as (select distinct book_id, term, document_frequency n from bm25_book_terms where book_id is not null and term is not null and document_frequency >= 1),
folded as (select book_id, nfc_normalize({_FOLD.format("term")}) term, n from raw),
counted as (select term, sum(n)::bigint occurrences, count(distinct book_id) records from folded where term <> '' group by term),
last as (select book_id, max(updated_at) latest from bm25_book_stats where book_id is not null group by book_id),
sizes as (select s.book_id, max(s.chunk_count) n from bm25_book_stats s join last l on s.book_id = l.book_id and s.updated_at = l.latest group by s.book_id),
total as (select sum(n) n from sizes),
marked as (select c.*, case when occurrences <= 1 then 'rare' when occurrences > 0.2 * total.n then 'common' end mark from counted c, total)
"""
_LINES = r"""
with cut as (select chunk_id, book_id, chunk_index, string_split(text, chr(10)) pieces from chunks where text is not null),
numbered as (select chunk_id, book_id, chunk_index, unnest(pieces) line, unnest(range(1, len(pieces) + 1))::int line_no from cut),
keyed as (select chunk_id, book_id, chunk_index, line_no, lower(regexp_replace(regexp_replace(trim(line, ' ' || chr(9)), '[ \t]+', ' ', 'g'), '[0-9]+', '0', 'g')) k
          from numbered where length(regexp_replace(line, '[^\p{L}]', '', 'g')) >= 12),
sizes as (select book_id, count(distinct chunk_index) n from chunks group by book_id),
cells as (select book_id, k, count(distinct chunk_index) hits from keyed group by book_id, k),
hot as (select c.book_id, c.k from cells c join sizes s using (book_id) where hits >= 5 and hits >= 0.05 * s.n)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1 + "select term, mark from marked where mark is not null",
        "p1_vocabulary": _P1 + f", stored as (select distinct nfc_normalize({_FOLD.format('term')}) term from bm25_vocab where term is not null) "
        "select s.term, coalesce(occurrences, 0)::bigint occurrences, coalesce(records, 0)::bigint records, case when m.term is null then 'absent' else coalesce(mark, 'useful') end mark "
        "from stored s left join marked m on s.term = m.term where s.term <> ''",
        "p3_found": _LINES + "select chunk_id, line_no from keyed join hot using (book_id, k)",
        "p3_clean_text": _LINES + ", gone as (select chunk_id, line_no from keyed join hot using (book_id, k)), "
        "kept as (select n.chunk_id, string_agg(line, chr(10) order by line_no) t from numbered n anti join gone g using (chunk_id, line_no) group by n.chunk_id) "
        "select c.chunk_id, c.book_id, c.chunk_index, case when c.text is null then null else coalesce(k.t, '') end clean_text from chunks c left join kept k using (chunk_id)",
        "p6_round_trip": "select doc_id, coalesce(text, '') as text from documents",
    }
