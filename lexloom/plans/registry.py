"""The queries over the given tables, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import ids, text, vectors, web
from lexloom.operators import bm25, chunker, dense, dictionary, embed, fusion, order, rag, store
from lexloom.plans import index
from lexloom.sources.tables import table, table_rows
from lexloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _body(s: SparkSession, d: str) -> DataFrame:
    """The chunks that count in statistics: no summaries."""
    return table(s, d, "chunks").where(~F.coalesce("is_summary", F.lit(False)))


def _asked(rows: DataFrame, id: str, *columns: str) -> DataFrame:
    """The stated query set: every row whose id is divisible by 100."""
    return rows.where(F.col(id) % 100 == 0).select(F.col(id).alias("qid"), *columns)


# statistics of terms

_TERMS = r"regexp_extract_all(lower({0}), '(\p{{L}}+)', 1)"
_BODY = "body as (select * from chunks where not coalesce(is_summary, false))"
_BOOK = f"{_BODY}, tt as (select book_id, unnest(list_distinct({_TERMS.format('text')})) term from body), bt as (select book_id, term, count(*) document_frequency from tt where length(term) > 1 group by all)"
_IDF = f"{_BOOK}, n as (select count(*)::double n from body), vocab as (select term, sum(document_frequency)::bigint df from bt group by term), idf as (select term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) idf from vocab, n where df >= 2)"


@query(f"with {_BOOK} select * from bt")
def bm25_book_terms(s: SparkSession, d: str) -> DataFrame:
    return bm25.book_terms(_body(s, d))


@query(f"with {_BODY} select book_id, count(*) chunk_count from body group by book_id")
def bm25_book_stats(s: SparkSession, d: str) -> DataFrame:
    return bm25.book_stats(_body(s, d))


@query(f"with {_IDF} select term, df document_frequency from vocab")
def bm25_vocabulary(s: SparkSession, d: str) -> DataFrame:
    return bm25.vocabulary(bm25.book_terms(_body(s, d)))


def _weights(s: SparkSession, d: str) -> DataFrame:
    body = _body(s, d)
    return bm25.idf(bm25.vocabulary(bm25.book_terms(body)), bm25.book_stats(body))


@query(f"with {_IDF} select term, df document_frequency, round(idf, 6) idf from idf")
def bm25_idf(s: SparkSession, d: str) -> DataFrame:
    return _weights(s, d).select("term", "document_frequency", F.round("idf", 6).alias("idf"))


@query("""with last as (select book_id, max(struct_pack(a := updated_at, c := chunk_count)).c c from bm25_book_stats where book_id is not null group by book_id), n as (select sum(c)::double n from last)
select term, document_frequency, round(ln(1 + (n - document_frequency + 0.5) / (document_frequency + 0.5)), 6) idf from bm25_vocab, n where document_frequency >= 2 and term is not null and document_frequency <= n""")
def bm25_stored_idf(s: SparkSession, d: str) -> DataFrame:
    """The weights of the stored vocabulary, of terms in two chunks or more and no more than there are."""
    last = store.latest(table(s, d, "bm25_book_stats").where("book_id is not null"), ["book_id"], [F.col("updated_at").desc(), F.col("chunk_count").desc()])
    vocab = table(s, d, "bm25_vocab").where(F.col("term").isNotNull()).withColumn("n", F.coalesce(last.agg(F.sum("chunk_count")).scalar(), F.lit(0)))
    return bm25.idf(vocab.where("document_frequency <= n"), last).select("term", "document_frequency", F.round("idf", 6).alias("idf"))


@query(f"with {_IDF}, u as (select chunk_id, unnest({_TERMS.format('text')}) term from body), tf as (select chunk_id, term, count(*) tf from u group by all) select chunk_id, term, round(idf * tf * 2.5 / (tf + 1.5), 5) weight from tf join idf using (term)")
def bm25_passage_vectors(s: SparkSession, d: str) -> DataFrame:
    return bm25.indexed(_body(s, d), id="chunk_id").postings.select("chunk_id", "term", F.round("weight", 5).alias("weight"))


_DOC_IDF = f"""du as (select doc_id, source, lang, unnest({_TERMS.format('text')}) term from documents where text is not null),
tf as (select doc_id, source, lang, term, count(*) tf from du where length(term) > 1 group by all),
dn as (select count(*)::double n from documents), didf as (select term, ln(1 + (n - df + 0.5) / (df + 0.5)) idf from (select term, count(*) df from tf group by term), dn where df >= 2),
post as (select doc_id, source, lang, term, idf * tf * 2.5 / (tf + 1.5) w from tf join didf using (term))"""


def _search_sql(k: int, where: str = "true") -> str:
    return f"""{_DOC_IDF}, sc as (select q.doc_id qid, p.doc_id, round(sum(q.w * p.w), 6) score from post q join post p on q.term = p.term where q.doc_id % 100 = 0 and {where} group by all),
sparse as (select * from (select qid, doc_id, score, row_number() over (partition by qid order by score desc, doc_id) rank from sc) where rank <= {k})"""


def _doc_index(s: SparkSession, d: str) -> bm25.Index:
    return bm25.indexed(table(s, d, "documents"), keep=("lang",))


def _doc_search(s: SparkSession, d: str, k: int, where: Column | None = None, asked: DataFrame | None = None, index: bm25.Index | None = None, ahead: Callable[[Callable[[int], DataFrame]], DataFrame] | None = None) -> DataFrame:
    """The documents asked over all documents; without ``asked`` those of the stated set, whose terms are in the index.
    ``ahead`` gets the search by k and says when it runs."""
    index = index or _doc_index(s, d)
    if asked is None:
        sought = _asked(index.postings, "doc_id", F.col("lang").alias("q_lang"), "term", F.col("weight").alias("sought"))
    else:
        counts = bm25.term_counts(asked, id="qid", keep=("q_lang",)).join(index.weights, "term")
        sought = counts.select("qid", "q_lang", "term", (F.col("idf") * bm25.saturation(F.col("tf").cast("double"))).alias("sought"))
    find = lambda k: bm25.best(sought, index, k=k, where=where)
    return find(k) if ahead is None else ahead(find)


@query(f"with {_search_sql(5)} select qid, doc_id, score, rank from sparse")
def bm25_search_topk(s: SparkSession, d: str) -> DataFrame:
    return _doc_search(s, d, 5)


@query(f"with {_search_sql(5, 'q.lang = p.lang')} select qid, doc_id, score, rank from sparse")
def bm25_search_filtered(s: SparkSession, d: str) -> DataFrame:
    return _doc_search(s, d, 5, F.col("q_lang") == F.col("lang"))


_OLD = "old as (select book_id, lower(trim(term)) term, max(document_frequency) df from bm25_book_terms where book_id is not null and trim(term) <> '' and document_frequency > 0 group by all)"


def _stored_terms(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "bm25_book_terms").where("book_id is not null and trim(term) != '' and document_frequency > 0")
    return rows.groupBy("book_id", F.lower(F.trim("term")).alias("term")).agg(F.max(F.col("document_frequency").cast("long")).alias("document_frequency"))


@query(f"with {_BOOK}, {_OLD} select coalesce(a.term, b.term) term, coalesce(b.df, 0)::bigint document_frequency from (select term, sum(df) df from old group by term) a full join (select term, sum(document_frequency) df from bt group by term) b on a.term = b.term where coalesce(b.df, 0) > 0")
def bm25_books_replaced(s: SparkSession, d: str) -> DataFrame:
    """All stored contributions give way to those of the chunks that are there."""
    old = _stored_terms(s, d)
    return bm25.replaced(bm25.vocabulary(old), old, bm25.book_terms(_body(s, d)))


# vectors


@query("with v as (select vec_id, [x::double for x in embedding] e from embeddings), n as (select vec_id, e, sqrt(list_sum([x * x for x in e])) l from v) select vec_id, round(l, 6) length, [round(x / l, 6) for x in e] unit from n")
def vector_lengths(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return e.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("length"), F.transform(vectors.normalized(F.col("embedding")), lambda x: F.round(x, 6)).alias("unit"))


@query("with u as (select label, unnest(embedding)::double x, unnest(range(1, len(embedding) + 1)) i from embeddings) select label, i::int dimension, round(avg(x), 6) mean from u group by label, i")
def vector_means(s: SparkSession, d: str) -> DataFrame:
    cells = table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return cells.groupBy("label", (F.col("i") + 1).alias("dimension")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def _dense_sql(k: int, where: str = "true") -> str:
    return f"""ds as (select q.vec_id qid, p.vec_id, round(list_cosine_similarity([x::double for x in q.embedding], [x::double for x in p.embedding]), 6) score from embeddings q, embeddings p where q.vec_id % 100 = 0 and {where}),
dense as (select * from (select qid, vec_id, score, row_number() over (partition by qid order by score desc, vec_id) rank from ds) where rank <= {k})"""


@query(f"with {_dense_sql(5)} select qid, vec_id, score, rank from dense")
def dense_topk(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return dense.top_k(_asked(e, "vec_id", "embedding"), e, k=5)


@query(f"with {_dense_sql(5, 'q.label = p.label')} select qid, vec_id, score, rank from dense")
def dense_topk_filtered(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return dense.top_k(_asked(e, "vec_id", "embedding", "label"), e, label="label", k=5)


@query(f"with {_dense_sql(5)} select qid, vec_id, score, rank from dense")
def dense_quantized_topk(s: SparkSession, d: str) -> DataFrame:
    """By codes of one byte, twice as many candidates ranked again by their vectors."""
    e = table(s, d, "embeddings")
    return dense.rescored_top_k(_asked(e, "vec_id", "embedding"), e, k=5)


@query()
def dense_indexed_topk(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return dense.indexed_top_k(_asked(e, "vec_id", "embedding"), e, dense.centres(e, CELLS), k=10, probes=PROBES)


#: cells of the index over the vectors, and how many of them a query looks into: many, as the given ones lie in no clusters
CELLS, PROBES = 32, 24


@query("select m.method, count(*) * 10 wanted, true enough from embeddings, (values ('cells'), ('codes')) m(method) where vec_id % 100 = 0 group by m.method")
def dense_recall(s: SparkSession, d: str) -> DataFrame:
    """Whether the index and the codes find nine tenths or more of the ten nearest neighbours."""
    e = table(s, d, "embeddings")
    asked = _asked(e, "vec_id", "embedding")
    exact = dense.top_k(asked, e, k=10)
    ways = {"cells": dense.indexed_top_k(asked, e, dense.centres(e, CELLS), k=10, probes=PROBES), "codes": dense.rescored_top_k(asked, e, k=10)}
    rows = [dense.recall(exact, found).select(F.lit(name).alias("method"), "wanted", (F.col("found") >= 0.9 * F.col("wanted")).alias("enough")) for name, found in ways.items()]
    return rows[0].unionByName(rows[1])


@query()
def embedded_topk(s: SparkSession, d: str) -> DataFrame:
    """Nearest documents by vectors that are made of their words, of one's own language."""
    docs = table(s, d, "documents").where("text is not null").select("doc_id", "text", "lang")
    made = embed.with_vectors(docs, embed.hashing(128), kind="passage")
    asked = embed.with_vectors(docs.where(F.col("doc_id") % 100 == 0).withColumnRenamed("doc_id", "qid"), embed.hashing(128), kind="query")
    return dense.top_k(asked, made, id="doc_id", vector="vector", label="lang", k=5)


@query(f"with {_search_sql(15)}, {_dense_sql(15)}, h as (select qid, doc_id, rank from sparse union all select qid, vec_id, rank from dense), f as (select qid, doc_id, round(sum(1.0::double / (60 + rank)), 9) score from h group by all) select * from (select qid, doc_id, score, row_number() over (partition by qid order by score desc, doc_id) rank from f) where rank <= 5")
def hybrid_rrf(s: SparkSession, d: str) -> DataFrame:
    """Keyword hits and vector hits by codes, three times as many as asked for, fused by rank; vec_id is the doc_id. Of a
    query without known terms only the vector hits are there."""
    e = table(s, d, "embeddings")
    near = dense.rescored_top_k(_asked(e, "vec_id", "embedding"), e, k=15).withColumnRenamed("vec_id", "doc_id")
    return fusion.rrf([_doc_search(s, d, 15), near], k=5)


@query(f"with {_search_sql(10)}, wide as (select * from (select qid, doc_id, score, row_number() over (partition by qid order by score desc, doc_id) rank from (select q.doc_id qid, p.doc_id, round(sum(q.w * p.w), 6) score from post q join post p on q.term = p.term where q.doc_id % 100 = 0 and q.lang = p.lang group by all)) where rank <= 15), u as (select *, 0 pass from sparse union all select *, 1 from wide) select qid, doc_id, pass, rank from (select *, row_number() over (partition by qid, doc_id order by pass, rank) n from u) where n = 1")
def retry_pool(s: SparkSession, d: str) -> DataFrame:
    made = _doc_index(s, d)
    first, wide = _doc_search(s, d, 10, index=made), _doc_search(s, d, 15, F.col("q_lang") == F.col("lang"), index=made)
    return fusion.merged_pool([first, wide]).select("qid", "doc_id", "pass", "rank")


@query()
def retrieval_loop(s: SparkSession, d: str) -> DataFrame:
    """Texts of documents asked over all documents, with open gates so that all passes run; the last one asks for the longest term."""
    ingest.ensure_checkpoints(s)
    docs = table(s, d, "documents").select("doc_id", "text", "lang")
    asked = docs.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("qid"), "text", F.col("lang").alias("q_lang"))
    made, ahead = _doc_index(s, d), rag.Ahead(rag.MOST_PASSES)

    def search(some: DataFrame, how: rag.Pass) -> DataFrame:
        if how.longest_term:
            some = some.withColumn("text", text.longest(text.latin_terms(F.col("text"))))
        return _doc_search(s, d, how.k, None if how.any_language else F.col("q_lang") == F.col("lang"), asked=some, index=made, ahead=lambda find: ahead.hits(some, how, find))

    return rag.retrieve(asked, docs, search, gates=rag.Gates(confident=5.5, answer=0.0, retry=-4.0, passes=rag.MOST_PASSES))


@query(f"""with {_IDF}, u as (select chunk_id, unnest({_TERMS.format('text')}) term from body), e as (select chunk_id, term, idf * count(*) * 2.5 / (count(*) + 1.5) w from u join idf using (term) group by chunk_id, term, idf),
v as (select chunk_id, string_agg(term, ' ' order by term) terms, count(*) entries, round(sum(w), 4) weight from e group by chunk_id)
select c.chunk_id, lower(content_type) content_type, coalesce(is_summary, false) is_summary, array_to_string(list_filter(icd_codes, lambda x: x <> ''), ',') icd_codes, v.terms, coalesce(v.entries, 0) entries, v.weight from chunks c left join v using (chunk_id)""")
def index_points(s: SparkSession, d: str) -> DataFrame:
    """What an index keeps of a chunk: its payload and its sparse vector in the order of terms, none where it has no entries."""
    chunks = table(s, d, "chunks")
    made = bm25.sparse_vectors(bm25.indexed(_body(s, d), id="chunk_id").postings, id="chunk_id")
    sums = F.round(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x), 4)
    payload = chunks.select("chunk_id", F.lower("content_type").alias("content_type"), F.coalesce("is_summary", F.lit(False)).alias("is_summary"), F.array_join(F.filter("icd_codes", lambda x: x != ""), ",").alias("icd_codes"))
    kept = made.select("chunk_id", F.array_join("terms", " ").alias("terms"), F.size("terms").alias("entries"), sums.alias("weight"))
    return payload.join(kept, "chunk_id", "left").withColumn("entries", F.coalesce("entries", F.lit(0)))


# chunks and sections

_SPACE = r"[\s\p{Z}\v\x85]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _clean(x: str) -> str:
    specks = "'([Ѐ-ӿ])[çãőñõÇÃŐÑÕ]+([Ѐ-ӿ])'"
    steps = (
        (r"'!\[[^\]]*\]\(data:[^)]+\)'", ""), (r"'(?m)^[\s\v]*!\[[^\]]*\]\([^)]+\.(?:jpg|jpeg|png|gif|webp|svg)\)[\s\v]*$'", ""), (f"'{chr(0xAD)}[ \\t]*'", ""),
        ("'([А-Яа-яЁёA-Za-z0-9]) - ([А-Яа-яёa-z])'", r"\1\2"), ("'([А-Яа-яЁёA-Za-z0-9])- ([А-Яа-яёa-z])'", r"\1\2"), (r"'[\t\v\f\r\p{Z}\x85]{2,}'", " "), (specks, r"\1\2"), (specks, r"\1\2"),
    )
    for pattern, new in steps:
        x = f"regexp_replace({x}, {pattern}, '{new}', 'g')"
    return x


@query(rf"""select chunk_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\(data:[^)]+\)', '', 'g'), '{chr(0xAD)}[ \t]*', '', 'g'),
'([А-Яа-яЁёA-Za-z0-9]) - ([А-Яа-яёa-z])', '\1\2', 'g'), '([А-Яа-яЁёA-Za-z0-9])- ([А-Яа-яёa-z])', '\1\2', 'g'), '[\t\v\f\r\p{{Z}}\x85]{{2,}}', ' ', 'g') clean from chunks""")
def chunk_clean(s: SparkSession, d: str) -> DataFrame:
    t = text.joined_hyphens(text.without_soft_hyphens(text.without_data_images(F.col("text"))))
    return table(s, d, "chunks").select("chunk_id", text.single_spaces(t).alias("clean"))


@query(f"select chunk_id, {_clean('text')} clean from chunks")
def chunk_clean_whole(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select("chunk_id", text.clean_markdown(F.col("text")).alias("clean"))


_HEADING = "'^(#{1,6})" + _SPACE + "+(.+)'"


_CHUNKED = rf"""with l as (select doc_id, unnest(string_split(t, chr(10))) line, unnest(range(len(string_split(t, chr(10))))) pos from (select doc_id, {_clean('text')} t from documents where text is not null)),
v as (select *, length(regexp_extract(line, {_HEADING}, 1)) lv from l), sec as (select *, sum((lv > 0)::int) over (partition by doc_id order by pos) section from v),
hd as (select doc_id, list(struct_pack(lv := lv, title := {_strip(f"regexp_extract(line, {_HEADING}, 2)")}) order by section) hs from sec where lv > 0 group by doc_id),
paths as (select doc_id, list_reduce(hs, lambda a, h: {{'stack': list_append(list_slice(a.stack, 1, least(len(a.stack), h.lv - 1)), h.title), 'path': list_append(a.path, array_to_string(list_append(list_slice(a.stack, 1, least(len(a.stack), h.lv - 1)), h.title), ' > '))}}, {{'stack': []::varchar[], 'path': []::varchar[]}}).path ps from hd),
body as (select doc_id, section, {_strip("string_agg(line, chr(10) order by pos)")} t, coalesce(arg_max(kind, pos) filter (kind is not null), 'text') type
  from (select *, case when starts_with({_strip('line')}, '|') then 'table' when substr({_strip('line')}, 1, 1) in ('-', '*') then 'list' end kind from sec where lv = 0) group by doc_id, section),
cut as (select b.doc_id, section, type, coalesce(ps[section::int], '') path, case when length(t) // 4 <= 512 then [t] else (select list_transform(list_filter(list_append(r.done, r.now), lambda x: x <> ''), lambda x: {_strip('x')}) from (select list_reduce(string_split(regexp_replace(t, '([.!?]){_SPACE}+', '\1' || chr(1), 'g'), chr(1)),
  lambda a, x: case when length(a.now) // 4 + length(x) // 4 > 512 and a.now <> '' then {{'done': list_append(a.done, a.now), 'now': x || ' '}} else {{'done': a.done, 'now': a.now || x || ' '}} end, {{'done': []::varchar[], 'now': ''}}) r)) end parts from body b left join paths using (doc_id) where t <> ''),
pt as (select doc_id, section, path, type, unnest(parts) t, unnest(range(len(parts))) part from cut),
ov as (select doc_id, section, part, path, type, case when lag(path) over w = path and least(512, 2047 - length(t)) > 0 then right(lag(t) over w, least(512, 2047 - length(t))) || chr(10) || t else t end t from pt window w as (partition by doc_id order by section, part)),
whole as (select doc_id, list(struct_pack(path := path, text := t, type := type) order by section, part) c from ov group by doc_id),
jn as (select doc_id, list_reduce(c, lambda a, x: case when a.now is null then {{'done': a.done, 'now': x}} when length(a.now.text) // 4 < 50 and a.now.path = x.path then {{'done': a.done, 'now': {{'path': a.now.path, 'text': a.now.text || chr(10) || x.text, 'type': a.now.type}}}} else {{'done': list_append(a.done, a.now), 'now': x}} end,
  {{'done': []::struct(path varchar, text varchar, type varchar)[], 'now': null::struct(path varchar, text varchar, type varchar)}}) r from whole),
fin as (select doc_id, list_append(r.done, r.now) c from jn),
mc as (select doc_id, chunk_index, m.path path, m.type type, m.text as text from (select doc_id, unnest(c) m, unnest(range(len(c)))::int chunk_index from fin))"""


@query(f"{_CHUNKED} select * from mc")
def markdown_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunker.markdown_chunks(table(s, d, "documents").select("doc_id", "text"))


@query(r"with c as (select chunk_id, string_split(regexp_replace(text, '([.!?])[\s\p{Z}\v\x85]+', '\1' || chr(1), 'g'), chr(1)) s from chunks where text is not null) select chunk_id, len(s) sentences, list_max([length(x) for x in s]) longest from c")
def rough_sentences(s: SparkSession, d: str) -> DataFrame:
    cut = table(s, d, "chunks").where("text is not null").select("chunk_id", text.rough_sentences(F.col("text")).alias("s"))
    return cut.select("chunk_id", F.size("s").alias("sentences"), F.array_max(F.transform("s", lambda x: F.length(x))).alias("longest"))


@query("""with o as (select chunk_id, chapter_title, text, lag(chapter_title) over w p, lag(text) over w t from chunks where text is not null window w as (partition by book_id order by chunk_index, chunk_id))
select chunk_id, case when p = chapter_title and 2047 - length(text) > 0 then right(t, least(512, 2047 - length(text))) || chr(10) || text else text end as text from o""")
def chunk_overlap(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "chunks").where("text is not null").select("chunk_id", "book_id", "chunk_index", F.col("chapter_title").alias("path"), "text")
    return chunker.overlapped(rows, id="book_id", position="chunk_index", then=["chunk_id"]).select("chunk_id", "text")


@query(f"""{_CHUNKED}, named as (select doc_id, path, min(chunk_index) i from mc where trim(path) <> '' group by doc_id, path),
every as (select doc_id, chunk_index, text, false summary from mc union all select n.doc_id, null, n.path || chr(10) || chr(10) || substr(m.text, 1, 800), true from named n join mc m on m.doc_id = n.doc_id and m.chunk_index = n.i),
tw as (select doc_id, chunk_index, list_distinct(list_filter({_TERMS.format('text')}, lambda x: length(x) > 1)) ws, summary from every), df as (select term, count(*) df from (select unnest(ws) term from tw where not summary) group by term),
en as (select doc_id, count(*) entries from (select doc_id, unnest(ws) term from tw) join df using (term) where df >= 2 group by doc_id)
select doc_id::varchar book_id, count(*) filter (not summary) chunks, count(*) filter (summary) summaries, coalesce(any_value(entries), 0)::bigint entries from every left join en using (doc_id) group by doc_id""")
def index_written(s: SparkSession, d: str) -> DataFrame:
    """The documents indexed as books, the index written by book and read again: what each book has in it."""
    ingest.ensure_checkpoints(s)
    folder = ingest.shared_folder(s)
    index.write(index.index(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("book_id"), "text"), table(s, d, "illnesses")), folder)
    chunks, postings = s.read.parquet(f"{folder}/chunks"), s.read.parquet(f"{folder}/postings")
    entries = postings.groupBy("book_id").agg(F.count("*").alias("entries"))
    counts = chunks.groupBy("book_id").agg(F.count(F.when(~F.col("is_summary"), 1)).alias("chunks"), F.count(F.when(F.col("is_summary"), 1)).alias("summaries"))
    return counts.join(entries, "book_id", "left").withColumn("entries", F.coalesce("entries", F.lit(0)))


_PATH = "case when coalesce(section_title, '') = '' then chapter_title else chapter_title || ' > ' || section_title end"


@query(f"""with {_BODY}, p as (select book_id, {_PATH} path, chunk_index, coalesce(text, '') t, chunk_id from body), f as (select book_id, path, min(chunk_index) i from p where trim(path) <> '' group by all),
g as (select f.book_id, f.path, f.i, min(p.t) t from f join p on p.book_id = f.book_id and p.path = f.path and p.chunk_index = f.i group by all), n as (select book_id, count(*) total from body group by book_id)
select g.book_id, path, (total + row_number() over (partition by g.book_id order by i, path) - 1)::int chunk_index, path || chr(10) || chr(10) || substr(t, 1, 800) as text from g join n using (book_id)""")
def section_summaries(s: SparkSession, d: str) -> DataFrame:
    named = F.when(F.coalesce("section_title", F.lit("")) == "", F.col("chapter_title")).otherwise(F.concat("chapter_title", F.lit(" > "), "section_title"))
    return chunker.section_summaries(_body(s, d).select("book_id", named.alias("path"), "chunk_index", F.coalesce("text", F.lit("")).alias("text")))


@query(f"""with q as (select chunk_id, book_id, chapter_title, section_title from chunks where coalesce(is_summary, false) and coalesce(section_title, '') <> ''), {_BODY},
b as (select *, row_number() over (partition by book_id, chapter_title, section_title order by chunk_index, chunk_id) n from body)
select q.chunk_id qid, b.chunk_id, 'section' via from q join b using (book_id, chapter_title, section_title) where n <= 50 union all select chunk_id, chunk_id, 'hit' from q""")
def section_expand(s: SparkSession, d: str) -> DataFrame:
    chunks = table(s, d, "chunks")
    hits = chunks.where(F.coalesce("is_summary", F.lit(False)) & (F.coalesce("section_title", F.lit("")) != "")).select(F.col("chunk_id").alias("qid"), "chunk_id")
    return fusion.with_sections(hits, chunks)


@query(r"select doc_id, array_to_string(list_slice(list_filter([regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') for x in regexp_extract_all(text, '(?m)^## ([^\n]+)$', 1)], lambda x: length(x) >= 5 and not regexp_matches(x, '[:.]$') and not regexp_matches(x, '[=+]')), 1, 100), chr(10)) outline from documents where text is not null")
def outlines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select("doc_id", text.outline(F.col("text")).alias("outline"))


@query(r"""with r as (select chunk_id, list_filter(string_split(text, chr(10)), lambda l: starts_with(trim(l), '|') and not regexp_matches(trim(l), '^\|[\s\v:|-]+\|?$')) rs from chunks where text is not null),
n as (select chunk_id, unnest(rs) l, unnest(range(len(rs)))::int row from r), c as (select chunk_id, row, string_split(regexp_replace(trim(l), '^\||\|$', '', 'g'), '|') cells from n)
select chunk_id, row, unnest(range(len(cells)))::int "column", unnest([trim(x) for x in cells]) cell from c""")
def table_cells(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "chunks").where("text is not null").select("chunk_id", F.posexplode(table_rows(F.col("text"))).alias("row", "cells"))
    return rows.select("chunk_id", "row", F.posexplode("cells").alias("column", "cell"))


# texts


@query(r"""select doc_id, len(list_filter(string_split(text, ' '), lambda x: x <> '')) words, regexp_matches(text, '[Ѐ-ӿ]') cyrillic, (length(text) // 4)::int tokens, right(text, 20) tail, substr(text, 1, 40) head,
trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' or regexp_matches(text, '^[\s\p{Z}]*$') blank from documents where text is not null""")
def text_features(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(s, d, "documents").where("text is not null").select(
        "doc_id", text.word_count(t).alias("words"), text.has_cyrillic(t).alias("cyrillic"), text.token_estimate(t).alias("tokens"), F.right(t, F.lit(20)).alias("tail"), F.substring(t, 1, 40).alias("head"), text.is_blank(t).alias("blank")
    )


@query(r"with t as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[ ,.!?():;\t\n/-]'), lambda x: regexp_matches(x, '^[a-z]{5,}$')) w from documents where text is not null) select doc_id, unnest(list_distinct(w)) term from t")
def latin_terms(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select("doc_id", F.explode(text.latin_terms(F.col("text"))).alias("term"))


@query(r"""with t as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[ ,.!?():;\t\n/-]'), lambda x: regexp_matches(x, '^[a-z]{5,}$')) w from documents where text is not null), u as (select doc_id, unnest(w) term, unnest(range(len(w))) pos from t),
b as (select doc_id, arg_max(term, struct_pack(n := length(term), p := -pos)) term from u group by doc_id) select doc_id, b.term from t left join b using (doc_id)""")
def longest_terms(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select("doc_id", text.longest(text.latin_terms(F.col("text"))).alias("term"))


_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"


@query(f"with t as (select doc_id, list_filter(regexp_split_to_array(text, '[ ,.?!()-]+'), lambda x: length(x) > 3 and not list_contains({_STOP}, lower(x))) w from documents where text is not null), u as (select doc_id, unnest(w) keyword from t) select doc_id, keyword, count(*) n from u group by all")
def keywords(s: SparkSession, d: str) -> DataFrame:
    words = table(s, d, "documents").where("text is not null").select("doc_id", F.explode(text.keywords(F.col("text"))).alias("keyword"))
    return words.groupBy("doc_id", "keyword").agg(F.count("*").alias("n"))


@query(r"select chunk_id, substr(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[ \t\n\v\f\r]{2,}', ' ', 'g'), '^[\s\p{Z}\v\x85\x1c-\x1f]+|[\s\p{Z}\v\x85\x1c-\x1f]+$', '', 'g'), 1, 800) snippet from chunks where text is not null")
def snippets(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").where("text is not null").select("chunk_id", text.html_snippet(F.col("text")).alias("snippet"))


@query(r"""with g as (select doc_id, [[n::int for n in regexp_extract_all(x, '(\d+)', 1)] for x in regexp_extract_all(text, '(\[\s*\d{1,9}(?:\s*,\s*\d{1,9})*\s*\])', 1)] m from documents where text is not null)
select doc_id, array_to_string(flatten(list_filter(m, lambda x: list_min(x) >= 1 and list_max(x) <= 5)), ',') citations from g""")
def citations(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select("doc_id", F.array_join(text.citations(F.col("text"), F.lit(5)), ",").alias("citations"))


_MARK = r"(\[[\s\v]*\d{1,9}(?:[\s\v]*,[\s\v]*\d{1,9})*[\s\v]*\])"


@query(rf"""with p as (select doc_id, string_split(regexp_replace(text, '{_MARK}', chr(1) || '\1' || chr(1), 'g'), chr(1)) ps from documents where text is not null),
u as (select doc_id, unnest(ps) x, unnest(range(len(ps))) i from p), n as (select *, case when regexp_full_match(x, '{_MARK}') then [k::int for k in regexp_extract_all(x, '(\d+)', 1)] else []::int[] end ks from u),
h as (select *, len(ks) > 0 and list_min(ks) >= 1 and list_max(ks) <= 5 holds from n),
e as (select doc_id, i, 0 j, x as text, null::int citation from h where not coalesce(holds, false) and x <> '' union all select doc_id, i, unnest(range(len(ks))) j, null, unnest(ks) from h where holds)
select doc_id, (row_number() over (partition by doc_id order by i, j) - 1)::int pos, text, coalesce(citation, 0) citation from e""")
def answer_segments(s: SparkSession, d: str) -> DataFrame:
    parts = table(s, d, "documents").where("text is not null").select("doc_id", F.posexplode(text.answer_segments(F.col("text"), F.lit(5))).alias("pos", "p"))
    return parts.select("doc_id", "pos", "p.text", F.coalesce("p.citation", F.lit(0)).alias("citation"))


@query(r"""select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)<think>.*?</think>[\s\v]*', '', 'g'), '(?m)^#{1,6}[\s\v]+', '', 'g'), '(?s)\*\*(.+?)\*\*', '\1', 'g'), '\*(.+?)\*', '\1', 'g'), '(?m)^[ \t]*[-*][\s\v]+', '', 'g'), '(?m)^[ \t]*\d+\.[\s\v]+', '', 'g'),
'^[\s\p{Z}\v\x85]+|[\s\p{Z}\v\x85]+$', '', 'g') answer from documents where text is not null""")
def stripped_answers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select("doc_id", text.stripped_answer(F.col("text")).alias("answer"))


@query(r"""with l as (select chunk_id, lower(trim(language)) x from chunks) select chunk_id, case when x in ('en', 'english') then 'en' when x in ('bg', 'bulgarian') then 'bg' else 'both' end code from l""")
def language_codes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select("chunk_id", text.language_code(F.col("language")).alias("code"))


_ALLOWED = ["kb.lib5.example", ".lib46.example/a", "https://lib80.example", "lib1.example"]


@query(r"""with u as (select doc_id, unnest(regexp_extract_all(text, '(https?://[A-Za-z0-9./?=&_-]+)', 1)) url from documents where text is not null), h as (select doc_id, url, lower(regexp_extract(url, '^https?://([^/?]+)', 1)) host from u)
select doc_id, url, host, url like 'https://%' and (host in ('kb.lib5.example', 'lib46.example', 'lib80.example', 'lib1.example') or regexp_matches(host, '\.(kb\.lib5|lib46|lib80|lib1)\.example$')) allowed from h""")
def url_policy(s: SparkSession, d: str) -> DataFrame:
    urls = table(s, d, "documents").where("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("(https?://[A-Za-z0-9./?=&_-]+)"), 1)).alias("url"))
    return urls.select("doc_id", "url", web.host(F.col("url")).alias("host"), web.is_allowed(F.col("url"), _ALLOWED).alias("allowed"))


@query("""with a as (select event_id, (user_id % 256)::int a, (event_id % 256)::int b from events) select event_id, a || '.' || b || '.7.9' address, a in (0, 10, 127) or (a = 169 and b = 254) or (a = 172 and b between 16 and 31) or (a = 192 and b = 168) or (a = 100 and b between 64 and 127) blocked from a""")
def address_policy(s: SparkSession, d: str) -> DataFrame:
    address = F.concat_ws(".", (F.col("user_id") % 256).cast("string"), (F.col("event_id") % 256).cast("string"), F.lit("7.9"))
    return table(s, d, "events").select("event_id", address.alias("address")).withColumn("blocked", web.is_blocked_address("address"))


_KEY = "case when coalesce(is_summary, false) then 'summary:' else '' end || book_id || ':' || chunk_index"


@query(f"""with h as (select chunk_id, {_KEY} key, sha256('chunk:' || {_KEY}) h from chunks where book_id is not null)
select chunk_id, key, substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) || '-' || substr(h, 11, 2) || substr(h, 9, 2) || '-' || substr(h, 15, 2) || '8' || substr(h, 14, 1) || '-'
|| substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) point_id from h""")
def point_ids(s: SparkSession, d: str) -> DataFrame:
    key = ids.point_key(F.col("book_id"), F.col("chunk_index"), F.col("is_summary"))
    return table(s, d, "chunks").where("book_id is not null").select("chunk_id", key.alias("key")).withColumn("point_id", ids.guid(F.col("key")))


@query("select event_id, json_extract_string(props, '$.k')::int k from events")
def json_fields(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# the dictionary

_NAMES = "names as (select distinct upper(icd_code) code, unnest([name_en, name_bg]) nm from illnesses), kept as (select code, nm, lower(nm) low from names where trim(nm) <> '')"


@query(f"with {_NAMES} select chunk_id, array_to_string(list_sort(list_distinct(list(code))), ',') codes from chunks join kept on contains(lower(text), low) group by chunk_id")
def icd_tags(s: SparkSession, d: str) -> DataFrame:
    found = dictionary.tagged(table(s, d, "chunks"), dictionary.names(table(s, d, "illnesses")))
    return found.select("chunk_id", F.array_join("codes", ",").alias("codes"))


def _titles(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").where("section_title != ''").select(F.col("section_title").alias("qid"), F.col("section_title").alias("text")).distinct()


@query(f"""with {_NAMES}, q as (select distinct section_title qid from chunks where section_title <> ''), w as (select qid, list_filter(regexp_split_to_array(qid, '[ ,.?!()-]+'), lambda x: length(x) > 3 and not list_contains({_STOP}, lower(x))) w from q),
own as (select qid, qid term from q union all select qid, unnest(w) from w), hit as (select distinct qid, code from own join kept on lower(own.term) = low), every as (select qid, lower(term) low from own union select qid, low from hit join kept using (code))
select qid, low as term from every""")
def query_expansion(s: SparkSession, d: str) -> DataFrame:
    found = dictionary.expanded(_titles(s, d), dictionary.names(table(s, d, "illnesses")))
    return found.select("qid", F.lower("term").alias("term"))


@query("with c as (select chunk_id, unnest(icd_codes) icd_code from chunks) select c.chunk_id, c.icd_code, i.name_en, i.name_bg from c left join illnesses i on upper(c.icd_code) = upper(i.icd_code)")
def dictionary_lookup(s: SparkSession, d: str) -> DataFrame:
    codes = table(s, d, "chunks").select("chunk_id", F.explode("icd_codes").alias("icd_code"))
    return dictionary.looked_up(codes, table(s, d, "illnesses"))


@query("""with t as (select distinct lower(regexp_extract(section_title, '(\\p{L}+)$', 1)) term from chunks where section_title <> ''), h as (select term qid, icd_code, name_en, row_number() over (partition by term order by name_en, icd_code) n from t join illnesses on term <> '' and (contains(lower(name_en), term) or contains(lower(name_bg), term) or starts_with(lower(icd_code), term)))
select * from h where n <= 50""")
def dictionary_search(s: SparkSession, d: str) -> DataFrame:
    last = F.lower(F.regexp_extract("section_title", r"(\p{L}+)$", 1))
    terms = table(s, d, "chunks").where("section_title != ''").select(last.alias("term")).distinct().select(F.col("term").alias("qid"), "term")
    return dictionary.searched(terms, table(s, d, "illnesses"))


# retrieval over the chunks: section titles asked, terms of the dictionary in the further passes, sections of summaries

GATES = {"confident": 4.0, "answer": 0.0, "retry": -3.0}


def _answers(s: SparkSession, d: str, passes: int) -> DataFrame:
    """The section titles of every hundredth chunk asked over all chunks, of the same language where theirs is known."""
    ingest.ensure_checkpoints(s)
    chunks = table(s, d, "chunks").withColumn("code", text.language_code(F.col("language")))
    body = ~F.coalesce("is_summary", F.lit(False))
    made = bm25.indexed(chunks, id="chunk_id", keep=("code", "is_summary"), counted=body)
    every = ingest.kept(_asked(chunks.where(F.trim(F.coalesce("section_title", F.lit(""))) != ""), "chunk_id", F.col("section_title").alias("text"), F.col("code").alias("q_code")))
    # the same title in the same language is asked once, in the name of the first chunk that has it
    asked = ingest.kept(every.groupBy("text", "q_code").agg(F.min("qid").alias("qid")))
    same = (F.col("q_code") == "both") | (F.col("q_code") == F.col("code"))

    def search(some: DataFrame, how: rag.Pass) -> DataFrame:
        counts = bm25.term_counts(some, id="qid", keep=("q_code",)).join(made.weights, "term")
        sought = counts.select("qid", "q_code", "term", (F.col("idf") * bm25.saturation(F.col("tf").cast("double"))).alias("sought"))
        return bm25.best(sought, made, id="chunk_id", k=how.k, where=None if how.any_language else same)

    terms = ingest.kept(dictionary.expanded(asked, dictionary.names(table(s, d, "illnesses")))) if passes else None
    found = rag.retrieve(asked, chunks, search, gates=rag.Gates(**GATES, passes=passes), id="chunk_id", terms=terms, widen=lambda hits: fusion.with_sections(hits, chunks), summary="is_summary")
    found = every.join(asked.withColumnRenamed("qid", "first"), ["text", "q_code"]).select("qid", "first").join(found.withColumnRenamed("qid", "first"), "first")
    return found.select("qid", F.coalesce("chunk_id", F.lit(-1)).alias("chunk_id"), F.coalesce("score", F.lit(-9.0)).alias("score"), F.coalesce("rank", F.lit(0)).alias("rank"), "outcome")


def _answers_sql(passes: int) -> str:
    code = "case when lower(trim(language)) in ('en', 'english') then 'en' when lower(trim(language)) in ('bg', 'bulgarian') then 'bg' else 'both' end"

    def gather(n: int, k: int) -> str:
        """p{n}: (qid, chunk_id, pass, pos, tt, rank) of the terms in t{n} (qid, q_code, pos, tt)."""
        return f"""w{n} as (select qid, q_code, pos, tt, term, idf * count(*) * 2.5 / (count(*) + 1.5) w from (select qid, q_code, pos, tt, unnest({_TERMS.format('tt')}) term from t{n}) join idf using (term) where length(term) > 1 group by qid, q_code, pos, tt, term, idf),
s{n} as (select qid, pos, tt, p.chunk_id, round(sum(w{n}.w * p.w), 6) score from w{n} join post p on w{n}.term = p.term where q_code = 'both' or q_code = code group by all),
h{n} as (select qid, chunk_id, pos, tt, rank from (select *, row_number() over (partition by qid, pos, tt order by score desc, chunk_id) rank from s{n}) where rank <= {k}),
g{n} as (select distinct qid, book_id, chapter_title, section_title from h{n} join chunks using (chunk_id) where is_summary and coalesce(section_title, '') <> ''),
u{n} as (select qid, chunk_id, pos, tt, rank from h{n} union all select qid, chunk_id, 1 << 30, '', 0 from g{n} join numbered using (book_id, chapter_title, section_title) where n <= 50),
p{n} as (select qid, chunk_id, {n} pass, pos, tt, rank from (select *, row_number() over (partition by qid, chunk_id order by pos, tt, rank) m from u{n}) where m = 1)"""

    score = f"""round(len(list_filter(list_distinct({_TERMS.format('qt')}), lambda x: list_contains({_TERMS.format('c.text')}, x))) / greatest(len(list_distinct({_TERMS.format('qt')})), 1) * 10 - 5, 6)"""
    scored = "select p.qid, p.chunk_id, pass, pos, tt, rank, {0} score, coalesce(c.is_summary, false) summary, c.text from {1} p join q on p.qid = q.qid join chunks c on c.chunk_id = p.chunk_id"
    own = r"select qid, q_code, 0 pos, qt term from q union all select qid, q_code, unnest(range(1, len(k) + 1)) pos, unnest(k) term from (select *, list_filter(regexp_split_to_array(qt, '[ ,.?!()-]+'), lambda x: length(x) > 3 and not list_contains(" + _STOP + ", lower(x))) k from q)"
    first = f"""with {_IDF}, cl as (select *, {code} code from chunks), {_NAMES},
post as (select chunk_id, code, term, idf * count(*) * 2.5 / (count(*) + 1.5) w from (select chunk_id, code, unnest({_TERMS.format('text')}) term from cl) join idf using (term) where length(term) > 1 group by chunk_id, code, term, idf),
numbered as (select chunk_id, book_id, chapter_title, section_title, row_number() over (partition by book_id, chapter_title, section_title order by chunk_index, chunk_id) n from body),
q as (select chunk_id qid, section_title qt, code q_code from cl where chunk_id % 100 = 0 and trim(coalesce(section_title, '')) <> ''),
t0 as (select qid, q_code, 0 pos, qt tt from q), {gather(0, 5)}, pool0 as ({scored.format(score, 'p0')})"""
    again = f""", own as ({own}), hit as (select distinct qid, q_code, code from own join kept on lower(own.term) = low), every as (select qid, q_code, pos, term from own union all select qid, q_code, 1 << 20, nm from hit join kept using (code)),
act as (select qid from pool0 group by qid having max(score) >= {GATES['retry']} and max(score) < {GATES['confident']}),
t1 as (select qid, q_code, f.pos pos, f.term tt from (select qid, q_code, min(struct_pack(pos := pos, term := term)) f from every where qid in (select qid from act) group by qid, q_code, lower(term))), {gather(1, 10)},
n1 as (select * from p1 anti join p0 using (qid, chunk_id)), pool1 as ({scored.format(score, 'n1')}), pool as (from pool0 union all from pool1)"""
    place = "score desc, pass, pos, tt, rank, chunk_id"
    return first + (again if passes else ", pool as (from pool0)") + rf""",
top as (select qid, lower(string_agg(text, chr(10))) seen, max(score) best from (select *, row_number() over (partition by qid order by {place}) r from pool) where r <= 3 group by qid),
l as (select * from (select *, row_number() over (partition by qid order by {place}) r from pool where not summary) where r <= 5),
lat as (select qid, list_filter(regexp_split_to_array(lower(qt), '[ ,.!?():;	
/-]'), lambda x: regexp_matches(x, '^[a-z]{{5,}}$')) ws from q),
j as (select qid, case when best is null then 'empty' when best < {GATES['retry']} then 'web' when best < {GATES['answer']} then 'refused' when len(ws) > 0 and len(list_filter(ws, lambda x: contains(seen, x))) = 0 then 'refused' else 'answer' end o from lat left join top using (qid))
select j.qid, coalesce(l.chunk_id, -1) chunk_id, coalesce(l.score, -9.0)::double score, coalesce(r, 0)::int rank, case when o = 'answer' and r is null then 'empty' else o end outcome from j left join l on j.qid = l.qid"""


@query(_answers_sql(0))
def answers_first_pass(s: SparkSession, d: str) -> DataFrame:
    return _answers(s, d, 0)


@query(_answers_sql(1))
def answers_second_pass(s: SparkSession, d: str) -> DataFrame:
    return _answers(s, d, 1)


@query()
def answers_all_passes(s: SparkSession, d: str) -> DataFrame:
    return _answers(s, d, rag.MOST_PASSES)


# tables and their changes


@query("select id, book_id, trim(title) title, author from books where status = 'indexed'")
def catalog(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "books").where("status = 'indexed'").select("id", "book_id", F.trim("title").alias("title"), "author").orderBy("title", "id")


_LATEST = "select * exclude (n) from (select *, row_number() over (partition by book_id, chunk_index, coalesce(is_summary, false) order by indexed_at desc, chunk_id desc) n from chunks) where n = 1"


@query(f"select chunk_id, book_id, chunk_index, text from ({_LATEST})")
def upsert_chunks(s: SparkSession, d: str) -> DataFrame:
    """Deliveries applied in order: of a chunk the latest counts."""
    rows = table(s, d, "chunks").withColumn("summary", F.coalesce("is_summary", F.lit(False)))
    last = store.latest(rows, ["book_id", "chunk_index", "summary"], [F.col("indexed_at").desc(), F.col("chunk_id").desc()])
    return last.select("chunk_id", "book_id", "chunk_index", "text")


_NEW_BOOKS = "fresh as (select book_id, min(book_title) title, min(author) author, count(distinct chunk_index)::int total_chunks from chunks where book_id is not null group by book_id)"


def _fresh(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").where("book_id is not null").groupBy("book_id").agg(F.min("book_title").alias("title"), F.min("author").alias("author"), F.count_distinct("chunk_index").cast("int").alias("total_chunks"))


@query(f"""with {_NEW_BOOKS} select coalesce(b.book_id, f.book_id) book_id, case when f.book_id is not null and coalesce(trim(f.author), '') <> '' then f.author when f.book_id is not null and b.book_id is null then f.author else b.author end author,
case when f.book_id is null then b.title else f.title end title, case when f.book_id is null then b.total_chunks else f.total_chunks end total_chunks, b.outline from books b full join fresh f on b.book_id = f.book_id""")
def upsert_books(s: SparkSession, d: str) -> DataFrame:
    old = table(s, d, "books").select("book_id", "author", "title", "total_chunks", "outline")
    return store.filled(old, _fresh(s, d), "book_id", kept_if_blank=["author"], untouched=["outline"])


@query(f"with {_NEW_BOOKS} select book_id, title, total_chunks from books union all select book_id, title, total_chunks from fresh where book_id not in (select book_id from books)")
def insert_if_absent(s: SparkSession, d: str) -> DataFrame:
    return store.added(table(s, d, "books").select("book_id", "title", "total_chunks"), _fresh(s, d).select("book_id", "title", "total_chunks"), ["book_id"])


@query("select chunk_id, book_id from chunks where book_id is null or book_id not in (select book_id from books where status <> 'indexed')")
def delete_by_book(s: SparkSession, d: str) -> DataFrame:
    gone = table(s, d, "books").where("status != 'indexed'")
    return store.removed(table(s, d, "chunks").select("chunk_id", "book_id"), gone, ["book_id"])


@query("select book_id, chunk_id, n from (select book_id, chunk_id, row_number() over (partition by book_id order by chunk_index, chunk_id) n from chunks) where n % 50 = 0")
def progress_marks(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "chunks").select("book_id", "chunk_index", "chunk_id")
    return order.numbered(rows, "book_id", "chunk_index", ["chunk_id"]).where("n % 50 = 0").select("book_id", "chunk_id", "n")


@query("select user_id, event_type, event_id, n from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) n from events) where n <= 10")
def recent_events(s: SparkSession, d: str) -> DataFrame:
    newest = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(s, d, "events").withColumn("n", F.row_number().over(newest)).where("n <= 10").select("user_id", "event_type", "event_id", "n")


@query("select user_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) filter (event_type = 'click') last_click, count(*) filter (event_type = 'error') errors, bool_or(event_type = 'purchase') bought from events group by user_id")
def last_and_any(s: SparkSession, d: str) -> DataFrame:
    click = F.col("event_type") == "click"
    return table(s, d, "events").groupBy("user_id").agg(
        F.max_by(F.when(click, F.col("event_id")), F.when(click, F.struct("ts", "event_id"))).alias("last_click"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"), F.bool_or(F.col("event_type") == "purchase").alias("bought")
    )


@query("select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) events, round(sum(value), 2) value from events group by all")
def stream_daily_counts(s: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files, counted by day and kind however late they are, run until it has caught up."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    events = ingest.events_of(s, f"{d}/events.parquet").withColumn("ts", F.timestamp_micros(micros))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("w.start") / 86400).cast("int")).cast("string")
    counts = ingest.windowed_counts(events, late=None).select(day.alias("day"), "event_type", "events", "value")
    done = ingest.drained(counts, ingest.shared_folder(s), ["day", "event_type"])
    return done.withColumn("value", F.round("value", 2))
