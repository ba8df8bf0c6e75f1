import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import bm25, chunker, dense, dictionary, embed, fusion, order, rag, store
from lexloom.sources import tables
from lexloom.streaming import ingest


def test_term_statistics(spark):
    chunks = spark.createDataFrame([("a", "fever cough fever"), ("a", "fever headache"), ("a", None), ("b", "")], "book_id string, text string")
    assert {(r.term, r.document_frequency) for r in bm25.book_terms(chunks).collect()} == {("fever", 2), ("cough", 1), ("headache", 1)}
    assert {(r.book_id, r.chunk_count) for r in bm25.book_stats(chunks).collect()} == {("a", 3), ("b", 1)}


def test_idf_and_weight(spark):
    r = spark.range(1).select(bm25.idf_of(F.lit(3.0), F.lit(5.0)).alias("idf"), bm25.saturation(F.lit(2.0)).alias("s")).first()
    assert round(r.idf, 6) == 0.538997 and round(r.idf * r.s, 6) == 0.769995
    assert round(r.idf**2 * 2.5 * 2 / 3.5, 6) == 0.415025


def contributions(spark, *rows):
    return spark.createDataFrame(rows, "book_id string, term string, document_frequency int")


def test_replaced_contributions(spark):
    a = contributions(spark, ("A", "fever", 3), ("A", "cough", 2))
    b = contributions(spark, ("B", "fever", 4), ("B", "rash", 1))
    none = a.limit(0)
    vocab = bm25.replaced(none.select("term", "document_frequency"), none, a)
    vocab = bm25.replaced(vocab, a, a)
    vocab = bm25.replaced(vocab, none, b)
    assert {tuple(r) for r in vocab.collect()} == {("fever", 7), ("cough", 2), ("rash", 1)}
    new = contributions(spark, ("B", "fever", 2), ("B", "rash", 1), ("B", "itch", 5))
    assert {tuple(r) for r in bm25.replaced(vocab, b, new).collect()} == {("fever", 5), ("cough", 2), ("rash", 1), ("itch", 5)}
    assert {tuple(r) for r in bm25.replaced(vocab, b, none).collect()} == {("fever", 3), ("cough", 2)}


def test_search_by_brute_force(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices("alpha beta gamma delta eps zeta".split(), weights=[9, 5, 4, 2, 1, 1], k=rng.randint(0, 9)))) for i in range(60)]
    frame = spark.createDataFrame(docs + [(99, None)], "doc_id long, text string")
    weights = bm25.idf(bm25.vocabulary(bm25.book_terms(frame, book="doc_id")), bm25.book_stats(frame, book="doc_id"))
    got = bm25.search(frame.where("doc_id < 5").withColumnRenamed("doc_id", "qid"), frame, weights, k=4).collect()
    df = {t: sum(t in d.split() for _, d in docs) for t in "alpha beta gamma delta eps zeta".split()}
    idf = {t: math.log(1 + (61 - n + 0.5) / (n + 0.5)) for t, n in df.items() if n >= 2}
    vector = lambda d: {t: idf[t] * d.split().count(t) * 2.5 / (d.split().count(t) + 1.5) for t in set(d.split()) & set(idf)}
    for q, text in docs[:5]:
        scores = sorted((-round(sum(w * vector(d).get(t, 0) for t, w in vector(text).items()), 6), i) for i, d in docs if set(vector(d)) & set(vector(text)))
        assert [(r.doc_id, r.rank) for r in sorted(got, key=lambda r: r.rank) if r.qid == q] == [(i, n + 1) for n, (_, i) in enumerate(scores[:4])]


def shuffled(frame):
    """Rows that the plan of a frame writes to shuffles."""

    def walk(plan):
        own = plan.metrics().get("shuffleRecordsWritten")
        kind = plan.getClass().getSimpleName()
        inner = "executedPlan" if kind == "AdaptiveSparkPlanExec" else "plan" if kind.endswith("QueryStageExec") else None
        below = [getattr(plan, inner)()] if inner else [plan.children().apply(n) for n in range(plan.children().size())]
        return (own.get().value() if own.isDefined() and not inner else 0) + sum(map(walk, below))

    frame.collect()
    return walk(frame._jdf.queryExecution().executedPlan())


def alike(spark, folder, n=600):
    """Tables whose documents have a word in common, so that every one is met by every query."""
    docs = [(i, f"common w{chr(97 + i % 23)}x w{chr(97 + i % 19)}y", "ab"[i % 2]) for i in range(n)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, [math.sin(i * j + 1.0) for j in range(1, 5)]) for i in range(n)], "vec_id long, embedding array<float>").coalesce(2).write.parquet(f"{folder}/embeddings.parquet")


@pytest.mark.parametrize("name", ["bm25_search_topk", "bm25_search_filtered", "hybrid_rrf", "retry_pool"])
def test_search_shuffles_no_pairs(spark, tmp_path, name):
    """6 queries meet 600 documents, or the half of their language; only the best of each task travel on."""
    from oracle import agree, connect

    from lexloom.plans import registry

    alike(spark, tmp_path)
    assert shuffled(registry.queries()[name](spark, str(tmp_path))) < 1000
    agree(spark, connect(tmp_path), str(tmp_path), registry.queries()[name], registry.oracle_sql()[name])


def written(spark, run):
    """Rows that all stages of a call write to shuffles."""
    sc, java = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, java.new_array(java.jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(n) for n in range(found.size()))}

    before = stages()
    run()
    return sum(n for stage, n in stages().items() if stage not in before)


def test_loop_over_documents_shuffles_no_pairs(spark, tmp_path):
    from lexloom.plans import registry

    alike(spark, tmp_path, 1200)
    assert written(spark, lambda: registry.retrieval_loop(spark, str(tmp_path)).collect()) < 6000


def test_loop_over_documents_searches_once_for_all_k(spark, monkeypatch):
    """Passes that differ in k only share a search, and its hits are those that each would find."""
    from lexloom.plans import registry

    calls, best, folder = [], bm25.best, "/root/testdata/sf0.001"
    monkeypatch.setattr(bm25, "best", lambda *a, **more: calls.append(more["k"]) or best(*a, **more))
    rows = lambda: sorted(map(str, registry.retrieval_loop(spark, folder).collect()))
    got = rows()
    assert calls == [15, 15, 20]
    monkeypatch.setattr(rag.Ahead, "hits", lambda self, asked, how, find: find(how.k))
    assert rows() == got and calls[3:] == [5, 10, 10, 15, 15, 20]


@pytest.mark.parametrize("name", ["answers_all_passes", "answers_second_pass", "answers_first_pass"])
def test_loop_shuffles_no_pairs(spark, tmp_path, name):
    """Ten chunks ask the same title of 1,000; neither the pairs nor the chunks themselves are shuffled."""
    from oracle import agree, connect

    from lexloom.plans import registry

    rows = [(i, f"book{i % 3}", "chapter", "common pains", i, f"common w{chr(97 + i % 23)}x w{chr(97 + i % 19)}y", "en", False, ["A00"]) for i in range(1000)]
    columns = "chunk_id long, book_id string, chapter_title string, section_title string, chunk_index int, text string, language string, is_summary boolean, icd_codes array<string>"
    spark.createDataFrame(rows, columns).coalesce(2).write.parquet(f"{tmp_path}/chunks.parquet")
    spark.read.parquet("/root/testdata/sf0.001/illnesses.parquet").write.parquet(f"{tmp_path}/illnesses.parquet")
    query, sql = registry.queries()[name], registry.oracle_sql().get(name)
    assert written(spark, lambda: query(spark, str(tmp_path)).collect()) < 3000
    if sql:
        agree(spark, connect(tmp_path), str(tmp_path), query, sql)


@pytest.mark.parametrize("seed", range(6))
def test_scores_by_blocks(monkeypatch, seed):
    """Blocks and batches of any size give what all products give: scripts, kinds, repeated texts and ties among them."""
    import pyarrow as pa

    from lexloom.operators import scores

    rng = random.Random(seed)
    for name, value in (("RECORDS", 64), ("BLOCK", rng.choice([1, 7, 50])), ("BATCH", rng.choice([1, 5])), ("FREQUENT", rng.choice([1, 4, 10**6])), ("AGAIN", rng.choice([1, 40]))):
        monkeypatch.setattr(scores, name, value)
    words = [a + chr(97 + n) for a in "aжあ" for n in range(12)]
    texts = [None if i % 41 == 0 else rng.choices(words[12 * (i % 3) :] + words[:2], k=rng.randint(0, 30)) for i in range(150)]
    docs = [(i, texts[i - 1] if i % 10 == 3 else texts[i], "xyz"[i % 3]) for i in range(150)]
    rng.shuffle(docs)
    asked = [(q, "xy"[q % 2], sorted({w: rng.choice([0.5, 1.0, 3.25]) for w in rng.sample(words, rng.randint(1, 9))}.items())) for q in range(20)]
    share = lambda n: n * 2.5 / (n + 1.5)
    for allowed in (None, {"x": {"x", "z"}}):
        table = pa.table({"key": [q for q, _, _ in asked], "kind": [k for _, k, _ in asked], "terms": [[t for t, _ in e] for _, _, e in asked], "weights": [[w for _, w in e] for _, _, e in asked]})
        schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
        batches = [pa.RecordBatch.from_pydict({"id": [d[0] for d in p], "terms": pa.array([d[1] for d in p], pa.list_(pa.string())), "kind": [d[2] for d in p]}) for p in (docs[:70], docs[70:])]
        got = {}
        for r in pa.Table.from_batches(scores.best(scores.asked(table, allowed), 4, share, schema)(iter(batches)), schema).to_pylist():
            got.setdefault(r["key"], []).append((-round(r["score"], 6), r["id"]))
        wanted = {}
        for q, kind, e in asked:
            sums = [(-round(sum(w * share(t.count(x)) for x, w in e if x in t), 6), i) for i, t, own in docs if t and set(t) & {x for x, _ in e} and (allowed is None or own in allowed.get(kind, ()))]
            if sums:
                wanted[q] = sorted(sums)[:4]
        assert {q: sorted(v) for q, v in got.items()} == wanted


@pytest.mark.parametrize("first", [1, 3, 50])
def test_search_leaves_nothing_out(spark, monkeypatch, first):
    """Bounds skip frequent terms for most records, and the result is that of all terms."""
    monkeypatch.setattr(bm25, "FIRST", first)
    rng = random.Random(first)
    words = ["w" + "".join(chr(97 + int(c)) for c in str(n)) for n in range(120)]
    docs = [(i, " ".join(rng.choices(words, weights=[1 / (n + 1) for n in range(120)], k=rng.randint(1, 60))), "xyz"[i % 3]) for i in range(250)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    index = bm25.indexed(frame, keep=("lang",))
    entries = [tuple(r) for r in index.postings.select("doc_id", "lang", "term", "weight").collect()]
    vectors = {}
    for i, _, t, w in entries:
        vectors.setdefault(i, {})[t] = w
    sought = index.postings.where("doc_id % 10 = 0").select(F.col("doc_id").alias("qid"), F.col("lang").alias("q_lang"), "term", F.col("weight").alias("sought"))
    for where, allowed in ((None, lambda q, d: True), (F.col("q_lang") == F.col("lang"), lambda q, d: docs[q][2] == docs[d][2])):
        got = {(r.qid, r["rank"]): (r.doc_id, r.score) for r in bm25.best_by_bounds(sought, index, k=4, where=where).collect()}
        assert got == {(r.qid, r["rank"]): (r.doc_id, r.score) for r in bm25.best(sought, index, k=4, where=where).collect()}
        wanted = {}
        for q in range(0, 250, 10):
            scores = sorted((-round(sum(w * vectors[d].get(t, 0) for t, w in vectors.get(q, {}).items()), 6), d) for d in vectors if set(vectors[d]) & set(vectors.get(q, {})) and allowed(q, d))
            wanted |= {(q, n + 1): (d, -s) for n, (s, d) in enumerate(scores[:4])}
        assert got == wanted


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(dense, "POINTS", 7)
    monkeypatch.setattr(dense, "QUERIES", 3)
    rng = np.random.default_rng(3)
    m = rng.normal(size=(50, 8)).astype(np.float32)
    m[7] = m[3]
    frame = spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(m)] + [(50, None, 0), (51, [0.0] * 8, 0)], "vec_id long, embedding array<float>, label int")
    asked = frame.where("vec_id < 6").withColumnRenamed("vec_id", "qid")
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    cos = np.round(unit.astype(float) @ unit.T.astype(float), 6)
    for label in (None, "label"):
        got = dense.top_k(asked, frame, label=label, k=5).collect()
        for q in range(6):
            own = [i for i in range(50) if not label or i % 3 == q % 3]
            assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.qid == q] == sorted(own, key=lambda i: (-cos[q, i], i))[:5]
    exact = {(r.qid, r.vec_id) for r in dense.top_k(asked, frame, k=5).collect()}
    near = {(r.qid, r.vec_id) for r in dense.rescored_top_k(asked, frame, k=5).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_cells(spark, monkeypatch):
    """In clusters a few cells suffice, all cells give the exact neighbours, and cells of any size are split."""
    monkeypatch.setattr(dense, "POINTS", 16)
    monkeypatch.setattr(dense, "QUERIES", 3)
    draw = np.random.default_rng(5)
    middle = draw.normal(size=(8, 16))
    at = [*([0] * 150), *draw.integers(1, 8, 150)]  # half of all points in one cluster
    vectors = [(int(n), [float(x) for x in middle[c] + 0.3 * draw.normal(size=16)], "ab"[n % 2]) for n, c in enumerate(at)] + [(900, [0.0] * 16, "a"), (901, None, "a")]
    points = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label string").withColumn("cell", F.lit("x"))
    asked = points.where("vec_id % 25 = 0").select(F.col("vec_id").alias("qid"), "embedding", "label")
    found = dense.centres(points, 8)
    for label in (None, "label"):
        exact = dense.top_k(asked, points, label=label, k=5)
        every = dense.indexed_top_k(asked, points, found, label=label, k=5, probes=8)
        assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
        row = dense.recall(exact, dense.indexed_top_k(asked, points, found, label=label, k=5, probes=3)).first()
        assert row.found >= 0.9 * row.wanted > 0
    nothing = points.limit(0)
    assert dense.indexed_top_k(asked, nothing, found).count() == 0 and dense.indexed_top_k(asked.limit(0), points, found).count() == 0
    assert dense.centres(nothing, 8).size == 0


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (2, 5, 1)], "qid int, doc_id int, rank int")
    assert [(r.qid, r.doc_id, r.rank) for r in fusion.rrf([a, b]).orderBy("qid", "rank").collect()] == [(1, 11, 1), (1, 10, 2), (2, 5, 1)]
    assert {(r.qid, r.doc_id, r["pass"]) for r in fusion.merged_pool([a, b]).collect()} == {(1, 10, 0), (1, 11, 0), (2, 5, 1)}


# the chunker, step by step in plain Python


def chunks_of(text):
    text = re.sub(r"!\[[^\]]*\]\(data:[^)]+\)", "", text)
    text = re.sub("­[ \t]*", "", text)
    text = re.sub(r"([А-Яа-яЁёA-Za-z0-9]) - ([А-Яа-яёa-z])", r"\1\2", text)
    text = re.sub(r"([А-Яа-яЁёA-Za-z0-9])- ([А-Яа-яёa-z])", r"\1\2", text)
    text = re.sub(r"[^\S\n]{2,}", " ", text)
    out, stack, lines, kind = [], [], [], "text"

    def flush():
        body = "\n".join(lines).strip()
        if body:
            out.append((" > ".join(stack), body, kind))

    for line in text.split("\n"):
        m = re.match(r"(#{1,6})\s+(.+)", line)
        if m:
            flush()
            del stack[len(m[1]) - 1 :]
            stack, lines, kind = [*stack, m[2].strip()], [], "text"
        else:
            mark = line.lstrip()[:1]
            kind = {"|": "table", "-": "list", "*": "list"}.get(mark, kind)
            lines.append(line)
    flush()
    split = []
    for path, body, kind in out:
        if len(body) // 4 <= 512:
            split.append((path, body, kind))
            continue
        now = ""
        for s in re.split(r"(?<=[.!?])\s+", body):
            if now and len(now) // 4 + len(s) // 4 > 512:
                split.append((path, now.strip(), kind))
                now = ""
            now += s + " "
        split.append((path, now.strip(), kind))
    laid = []
    for i, (path, body, kind) in enumerate(split):
        room = min(512, 2047 - len(body))
        if i and split[i - 1][0] == path and room > 0:
            body = split[i - 1][1][-room:] + "\n" + body
        laid.append((path, body, kind))
    merged = []
    for path, body, kind in laid:
        if merged and len(merged[-1][1]) // 4 < 50 and merged[-1][0] == path:
            merged[-1] = (path, merged[-1][1] + "\n" + body, merged[-1][2])
        else:
            merged.append((path, body, kind))
    return merged


X = "x" * 300
CASES = [
    "",
    "  \n ",
    f"# Chapter\n## Section\n### Sub\n{X}",
    f"# A\n## B\n{X}\n## C\n{X}",
    f"# A\n#### B\n{X}",
    f"# R\n#### P\n{X}\n#### Q\n{X}",
    f"| a | b |\n| - | - |\n{X}",
    f"{X}\n- one\n- two",
    f"* one\nplain\n{X}",
    "# T\n" + "This is a sentence of about forty-eight chars. " * 65,
    "# T\n" + "y" * 3000 + ". Short one.",
    "a" * 20 + "\n# B\n" + "b" * 20,
    "# A\nshort\n# A\nshort too\n# A\n" + X,
    "before\n" + "\n".join(f"{'#' * (1 + i % 5)} H{i}\nbody {i} " + "w. " * (i * 37) for i in range(40)),
]


def test_chunker_by_brute_force(spark):
    docs = spark.createDataFrame([*enumerate(CASES), (99, None)], "doc_id long, text string")
    got = {}
    for r in chunker.markdown_chunks(docs).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.path, r.text, r.type))
    for i, case in enumerate(CASES):
        assert got.get(i, []) == chunks_of(case), i
    assert 99 not in got


def test_overlap_example(spark):
    rows = spark.createDataFrame([(1, 0, "p", "a" * 600), (1, 1, "p", "b" * 600)], "doc_id int, n int, path string, text string")
    second = chunker.overlapped(rows, position="n", then=["path"]).where("n = 1").first().text
    assert second == "a" * 512 + "\n" + "b" * 600


@pytest.mark.parametrize("block", [3, 1000])
def test_order_in_blocks(spark, block):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 40), i) for i in range(200)]
    frame = spark.createDataFrame(rows, "k string, p int, i int")
    n = {r.i: r.n for r in order.numbered(frame, "k", "p", ["i"], block=block).collect()}
    before = {r.i: r.previous and r.previous.i for r in order.with_previous(frame, "k", "p", ["i"], ["i"], block=block).collect()}
    for k in ("a", "b", None):
        own = [i for _, _, i in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:])]
        assert [n[i] for i in own] == [*range(1, len(own) + 1)]
        assert [before[i] for i in own] == [None, *own[:-1]]


def test_embedder(spark):
    texts = spark.createDataFrame([(1, "fever and cough"), (2, "Cough, fever and"), (3, ""), (4, None), (5, "other words")], "id int, text string").withColumn("vector", F.lit(0))
    got = {r.id: r.vector for r in embed.with_vectors(texts.drop("vector"), embed.hashing(64), kind="passage").collect()}
    assert np.allclose(got[1], got[2]) and not np.allclose(got[1], got[5])
    assert math.isclose(np.linalg.norm(got[1]), 1, rel_tol=1e-5) and not any(got[3]) and got[4] is None
    assert np.allclose(embed.mean_pooled(np.array([[1.0, 2], [3, 4]])), np.array([2, 3]) / math.sqrt(13))


def test_pairs(spark):
    r = spark.sql("select array(101, 5, 102) q, array(101, 7, 8, 102) p, array_repeat(1, 600) long").select(embed.pair(F.col("q"), F.col("p")).alias("x"), F.size(embed.pair(F.col("q"), F.col("long"))["ids"]).alias("n")).first()
    assert r.n == 512 and r.x.ids == [101, 5, 102, 7, 8, 102] and r.x.types == [0, 0, 0, 1, 1, 1]


def test_source_labels(spark):
    kind = "struct<kind: string, title: string, page_start: int, page_end: int, name: string>"
    given = [(("book", "T", 3, 5, None), "T, p. 3–5"), (("book", None, 3, 3, None), "Book, p. 3"), (("book", "T", None, None, None), "T"), (("web", None, None, None, "N"), "N"), (("web", None, None, None, None), "Web source"), (None, "Source 7")]
    rows = spark.createDataFrame([(n, s, 7) for n, (s, _) in enumerate(given)], f"n int, s {kind}, m int")
    assert [r.x for r in rows.orderBy("n").select(embed.source_label(F.col("s"), F.col("m")).alias("x")).collect()] == [w for _, w in given]


def test_dictionary(spark):
    ills = spark.createDataFrame([("E05.0", "Graves disease", "Болест на Гравес"), ("q1.0", "Fever", None)], "icd_code string, name_en string, name_bg string")
    aliases = spark.createDataFrame([("E05.0", "Базедова болест"), ("E05.0", "гравес"), ("E05.0", "  ")], "icd_code string, alias string")
    names = dictionary.names(ills, aliases)
    texts = spark.createDataFrame([(1, "GRAVES DISEASE and fevers"), (2, "базедова болест"), (3, ""), (4, None), (5, "nothing")], "chunk_id long, text string")
    assert {r.chunk_id: r.codes for r in dictionary.tagged(texts, names).collect()} == {1: ["E05.0", "Q1.0"], 2: ["E05.0"]}
    assert dictionary.tagged(texts, names.limit(0)).count() == 0
    asked = spark.createDataFrame([(1, "болест на гравес"), (2, "flu на е"), (3, None)], "qid long, text string")
    found = dictionary.expanded(asked, names).collect()
    assert {r.term for r in found if r.qid == 1} == {"болест на гравес", "гравес", "Graves disease", "Базедова болест"}
    assert {r.term for r in found if r.qid == 2} == {"flu на е"}
    codes = spark.createDataFrame([("e05.0",), ("Z99.9",)], "icd_code string")
    assert {r.icd_code: r.name_en for r in dictionary.looked_up(codes, ills).collect()} == {"e05.0": "Graves disease", "Z99.9": None}
    terms = spark.createDataFrame([("a", "GRAVES"), ("b", "q1"), ("c", "ес"), ("d", " ")], "qid string, term string")
    assert {(r.qid, r.icd_code) for r in dictionary.searched(terms, ills).collect()} == {("a", "E05.0"), ("b", "q1.0"), ("c", "E05.0")}


def test_store(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert {tuple(r) for r in store.upserted(old, new, ["k"]).collect()} == {(1, "a"), (2, "B"), (3, "C"), (None, "n")}
    assert {tuple(r) for r in store.added(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "C"), (None, "n")}
    assert {tuple(r) for r in store.removed(old, new, ["k"]).collect()} == {(1, "a"), (None, "n")}
    again = store.upserted(store.upserted(old, new, ["k"]), new, ["k"])
    assert again.count() == 4
    books = spark.createDataFrame([("x", "/f", "o", 3)], "id string, path string, outline string, n int")
    fresh = spark.createDataFrame([("x", "", 4), ("y", "/g", 1)], "id string, path string, n int")
    assert {tuple(r) for r in store.filled(books, fresh, "id", ["path"], ["outline"]).collect()} == {("x", "/f", "o", 4), ("y", "/g", None, 1)}


def test_written_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    store.write_by(spark.createDataFrame([("a", 1), ("b", 1)], "book string, n int"), path, "book")
    store.write_by(spark.createDataFrame([("b", 2)], "book string, n int"), path, "book")
    assert {(r.book, r.n) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 2)}


@pytest.mark.parametrize(
    "score, gates, passes, outcome",
    [
        (5.0, rag.Gates(confident=1, answer=0, retry=-9, passes=5), 1, "answer"),
        (-5.0, rag.Gates(confident=1, answer=-9, retry=-9, passes=3), 4, "answer"),
        (-9.0, rag.Gates(confident=1, answer=-99, retry=-99, passes=10), 6, "answer"),
        (0.5, rag.Gates(), 1, "web"),
        (1.2, rag.Gates(), 1, "refused"),
        (2.0, rag.Gates(), 1, "answer"),
    ],
)
def test_loop(spark, score, gates, passes, outcome):
    docs = spark.createDataFrame([(i, f"fever text {i}") for i in range(10)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "fever text")], "qid int, text string")
    calls = []

    def search(queries, how):
        calls.append(how)
        return queries.select("qid").join(docs.select("doc_id")).withColumn("rank", (F.col("doc_id") + 1).cast("int")).where(F.col("rank") <= how.k)

    got = rag.retrieve(asked, docs, search, lambda pairs: pairs.withColumn("score", F.lit(score)), gates=gates).collect()
    assert len(calls) == passes and len(got) == 5 and {r.outcome for r in got} == {outcome}


def test_loop_without_hits(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "fever")], "qid int, text string")
    got = rag.retrieve(asked, docs, lambda q, how: q.join(docs.select("doc_id")).select("qid", "doc_id", F.lit(1).alias("rank"))).collect()
    assert [(r.doc_id, r.outcome) for r in got] == [(None, "empty")]


def test_latin_guard(spark):
    docs = spark.createDataFrame([(i, "Content") for i in range(3)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "sarcoma")], "qid int, text string")
    search = lambda q, how: q.join(docs.select("doc_id")).select("qid", "doc_id", (F.col("doc_id") + 1).cast("int").alias("rank"))
    got = rag.retrieve(asked, docs, search, lambda p: p.withColumn("score", F.lit(5.0))).collect()
    assert {r.outcome for r in got} == {"refused"}


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"hello")
    (tmp_path / "a.md").write_text("# Заглавие")
    pdfs, markdown = tables.pdf_files(spark, str(tmp_path)), tables.markdown_files(spark, str(tmp_path))
    assert {r.path[-5:]: r.valid for r in pdfs.collect()} == {"a.pdf": True, "b.pdf": False}
    assert [r.markdown for r in markdown.collect()] == ["# Заглавие"]
    assert "b" in {r.slug for r in tables.stale(pdfs, markdown).collect()}
    ok = spark.createDataFrame([('{"results": {"x": {"md": "# A"}}}',)], "e string")
    assert ok.select(tables.markdown_of(F.col("e")).alias("m")).first().m == "# A"
    for bad, said in (("{}", "no results"), ('{"results": {}}', "empty"), ('{"results": {"x": {}}}', "no markdown")):
        with pytest.raises(Exception, match=said):
            spark.createDataFrame([(bad,)], "e string").select(tables.markdown_of(F.col("e"))).collect()
    found = spark.createDataFrame([(1, '{"results": [{"title": "", "url": "u"}, {"title": "t", "engine": "e"}, {}, {}, {}, {}]}'), (2, "broken")], "q int, body string")
    rows = tables.web_results(found, key="q", body="body").orderBy("pos").collect()
    assert [(r.title, r.engine) for r in rows[:3]] == [("u", "Web"), ("t", "e"), ("Untitled", "Web")] and len(rows) == 5


def test_stream_runs_again(spark, tmp_path):
    rows = "select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,id) ts, 'a' event_type, 1.0D value from range({0}, {1})"
    spark.sql(rows.format(0, 30)).coalesce(1).write.parquet(str(tmp_path / "in" / "x1.parquet"))
    keys = ["w", "event_type"]
    counts = lambda: ingest.windowed_counts(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in" / "*.parquet")))
    assert {(r.events) for r in ingest.drained(counts(), str(tmp_path / "run"), keys).collect()} == {24, 6}
    spark.sql(rows.format(30, 40)).coalesce(1).write.parquet(str(tmp_path / "in" / "x2.parquet"))
    for _ in range(2):  # with new files, then with nothing new
        assert {(r.events) for r in ingest.drained(counts(), str(tmp_path / "run"), keys).collect()} == {24, 16}


def test_index_again(spark, tmp_path):
    from lexloom.plans import index

    body = "Fever and cough in children. " * 12
    ills = spark.createDataFrame([("q1.0", "Fever", "Треска")], "icd_code string, name_en string, name_bg string")
    books = spark.createDataFrame([("a", f"# One\n## First part\n{body}\n## Second part\n{body} rash"), ("b", f"# Two\n{body}"), ("c", None)], "book_id string, text string")
    path = str(tmp_path / "index")
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    for given in (books, books, books.where("book_id = 'b'")):
        index.write(index.index(given, ills), path)
        assert read("chunks").groupBy("book_id", "is_summary").count().count() == 4
        assert {(r.book_id, r.chunk_count) for r in read("stats").collect()} == {("a", 2), ("b", 1)}
        assert {(r.term, r.document_frequency) for r in bm25.vocabulary(read("terms")).where("term in ('fever', 'rash')").collect()} == {("fever", 3), ("rash", 1)}
        assert read("tags").count() == 3 and {r.chunk_index for r in read("chunks").where("is_summary and book_id = 'a'").collect()} == {2, 3}
        assert read("outlines").where("book_id = 'a'").first().outline == "First part\nSecond part"


def test_jobs(spark, tmp_path):
    for n in range(3):
        spark.createDataFrame([(n, "index")], "id int, kind string").coalesce(1).write.parquet(str(tmp_path / "jobs" / f"{n}.parquet"))
    jobs = lambda: spark.readStream.schema("id int, kind string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "jobs" / "*.parquet"))
    seen = []

    def handle(job):
        seen.append(job.id)
        if job.id == 1:
            raise ValueError("no such book")

    for _ in range(2):
        status = ingest.worked(jobs(), handle, str(tmp_path / "run")).collect()
        assert sorted(r.state for r in status) == ["done", "done", "failed"] and sorted(seen) == [0, 1, 2]
    rows = spark.createDataFrame([("running", None), ("done", None)], "state string, error string")
    assert {tuple(r) for r in ingest.interrupted(rows).collect()} == {("failed", "interrupted"), ("done", None)}


def test_filters(spark):
    rows = spark.createDataFrame([("a", "c", "s", i, i, "en" if i % 2 else "bg", i == 3) for i in range(6)], "book_id string, chapter_title string, section_title string, chunk_index int, chunk_id int, language string, is_summary boolean")
    assert [r.chunk_id for r in fusion.section_chunks(rows, "a", "c", "s", 4).collect()] == [0, 1, 2, 4]
    assert rows.where(fusion.matching("en", ["a"])).count() == 3 and rows.where(fusion.matching("both")).count() == 6 and rows.where(fusion.matching(None, ["x"])).count() == 0


def test_loop_asks_whole_texts_in_all_passes(spark, monkeypatch):
    from lexloom.plans import registry

    calls, search, folder = [], registry._doc_search, "/root/testdata/sf0.001"

    def seen(s, d, k, where=None, asked=None, **more):
        calls.append((k, where is None, {r.qid: r.text for r in asked.collect()}))
        return search(s, d, k, where, asked, **more)

    monkeypatch.setattr(registry, "_doc_search", seen)
    assert registry.retrieval_loop(spark, folder).count() > 0
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert [c[:2] for c in calls] == [(5, False), (10, False), (10, True), (15, False), (15, True), (20, True)]
    assert all(t == docs[q] for c in calls[:-1] for q, t in c[2].items())
    assert calls[-1][2] and all(t is None or t.isalpha() and t in docs[q].lower() for q, t in calls[-1][2].items())


def test_stream_of_unordered_files(spark, tmp_path):
    from lexloom.plans import registry

    for day in (20, 1, 10, 1):
        spark.sql(f"select timestamp_ntz'2024-01-{day:02} 05:00:00' ts, 'a' event_type, 1.0D value from range(3)").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = {(r.day, r.events, r.value) for r in registry.stream_daily_counts(spark, str(tmp_path)).collect()}
    assert got == {("2024-01-20", 3, 3.0), ("2024-01-01", 6, 6.0), ("2024-01-10", 3, 3.0)}


def test_new_rows_that_repeat_a_key(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (1, "y"), (2, "p"), (2, "q"), (2, "q"), (None, "m"), (None, "m")], "k int, v string")
    rows = lambda frame: sorted((tuple(r) for r in frame.collect()), key=str)
    assert rows(store.added(old, new, ["k"])) == sorted([(1, "a"), (2, "p"), (None, "n"), (None, "m"), (None, "m")], key=str)
    assert rows(store.upserted(old, new, ["k"])) == sorted([(1, "y"), (2, "q"), (None, "n"), (None, "m"), (None, "m")], key=str)
    assert rows(store.upserted(old, new, ["k"], [F.col("v")])) == sorted([(1, "x"), (2, "p"), (None, "n"), (None, "m"), (None, "m")], key=str)
    assert rows(store.added(old, new.limit(0), ["k"])) == rows(old)


def test_dictionary_in_several_passes(spark):
    names = spark.createDataFrame([(f"C{n}", f"name{n}x") for n in range(40)] + [("D", "name3x")], "code string, name string")
    texts = spark.createDataFrame([(1, "NAME3X and name17x"), (1, "name5x"), (2, "none"), (None, "name39x"), (3, None)], "chunk_id long, text string").withColumn("row", F.lit(1))
    wanted = sorted([(1, ["C17", "C3", "D"]), (1, ["C5"]), (None, ["C39"])], key=str)
    for most in (1000, 7, 1):
        assert sorted(((r.chunk_id, r.codes) for r in dictionary.tagged(texts, names, most=most).collect()), key=str) == wanted


def test_aliases(spark):
    ills = spark.createDataFrame([("e05", "Graves", None), ("Q1", "Fever", None)], "icd_code string, name_en string, name_bg string")
    aliases = spark.createDataFrame([("E05", "b"), ("e05", "a"), ("E05", " "), ("Z", "z")], "icd_code string, alias string")
    codes = spark.createDataFrame([("E05",), ("q1",), ("X",)], "icd_code string")
    assert {r.icd_code: (r.name_en, r.aliases) for r in dictionary.looked_up(codes, ills, aliases=aliases).collect()} == {"E05": ("Graves", ["a", "b"]), "q1": ("Fever", []), "X": (None, None)}
    assert {r.icd_code: r.aliases for r in dictionary.with_aliases(ills, aliases).collect()} == {"e05": ["a", "b"], "Q1": []}


def test_search_in_the_dictionary_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(f"{rng.choice('AB')}{n}", "".join(rng.choices("abc ", k=rng.randint(0, 9))) if n % 7 else None, "".join(rng.choices("абв", k=4))) for n in range(60)] + [(None, "abc", "абв"), ("", "cab", None)]
    terms = ["a", "ab", "abc", "bcab", "Б", "аб", "b1", "a12", "zz", " ", "c a"]
    ills = spark.createDataFrame(rows, "icd_code string, name_en string, name_bg string")
    got = {(r.qid, r.icd_code) for r in dictionary.searched(spark.createDataFrame([(t, t) for t in terms], "qid string, term string"), ills, k=1000).collect()}
    low = lambda x: (x or "").lower()
    assert got == {(t, c) for t in terms if t.strip() for c, a, b in rows if c is not None and (low(t) in low(a) or low(t) in low(b) or low(c).startswith(low(t)))}


def test_jobs_of_one_batch_in_pieces(spark, tmp_path):
    spark.range(25).coalesce(1).write.parquet(str(tmp_path / "jobs" / "x.parquet"))
    jobs = spark.readStream.schema("id long").parquet(str(tmp_path / "jobs" / "*.parquet"))
    status = ingest.worked(jobs, lambda job: None, str(tmp_path / "run"), flush=10)
    assert status.count() == 25 and status.where("state = 'done'").count() == 25


def test_no_folder_of_the_machine_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ingest.shared_folder(Session())
    Context.master = "local[2]"
    assert ingest.shared_folder(Session())
    Session.conf = {"spark.checkpoint.dir": "/shared/"}
    assert ingest.shared_folder(Session()).startswith("/shared/")


def test_loop_with_terms_sections_and_summaries(spark):
    chunks = spark.createDataFrame(
        [(1, "b", "c", "s", 0, True, "summary of fever"), (2, "b", "c", "s", 1, False, "fever in adults"), (3, "b", "c", "s", 2, False, "nothing here"), (4, "b", "c", "t", 3, False, "cough"), (5, "b", "c", None, 4, True, "whole summary")],
        "chunk_id long, book_id string, chapter_title string, section_title string, chunk_index int, is_summary boolean, text string",
    )
    asked = spark.createDataFrame([(7, "fever", "x"), (8, "whole", "x")], "qid long, text string, other string")
    terms = spark.createDataFrame([(7, "fever", 0), (7, "pyrexia", 1), (7, "cough now", 1 << 20), (8, "whole", 0)], "qid long, term string, pos int")
    calls = []

    def search(some, how):
        rows = [(r.qid, r.text, r.other) for r in some.collect()]
        calls.append((how.k, sorted(t for _, t, _ in rows)))
        hits = {"fever": [1], "pyrexia": [1, 2], "cough now": [4], "whole": [5]}
        found = [(q, c, n + 1) for q, t, _ in rows for n, c in enumerate(hits[t])]
        return spark.createDataFrame(found, f"qid {some.schema['qid'].dataType.simpleString()}, chunk_id long, rank int")

    flat = lambda pairs: pairs.withColumn("score", F.lit(1.0))
    got = rag.retrieve(asked, chunks, search, flat, gates=rag.Gates(confident=2, answer=0, retry=0, passes=5), id="chunk_id", terms=terms, widen=lambda h: fusion.with_sections(h, chunks), summary="is_summary").collect()
    # the first pass asks the queries, four more every term, the last one the longest; a term's hits stand in its order
    assert calls == [(5, ["fever", "whole"])] + [(k, ["cough now", "fever", "pyrexia", "whole"]) for k in (10, 10, 15, 15)] + [(20, ["cough now", "whole"])]
    # of the section of the summary all chunks came in with the first pass, the summaries themselves aren't given
    assert [(r.qid, r.chunk_id, r["rank"], r.outcome) for r in sorted(got, key=lambda r: (r.qid, r["rank"] or 0))] == [(7, 2, 1, "answer"), (7, 3, 2, "answer"), (7, 4, 3, "answer"), (8, None, None, "empty")]


def test_sources_of_the_web(spark):
    from lexloom.functions import web

    results = spark.createDataFrame([(1, 0, "A", ""), (1, 1, "B", "u1"), (1, 2, "C", "u2"), (1, 3, "D", "u3"), (1, 4, "E", "u4"), (2, 0, "F", None)], "q int, pos int, title string, url string")
    pages = spark.createDataFrame([("u1", "<p>one</p>"), ("u2", " "), ("u3", "three"), ("u4", "four"), ("u3", "three")], "url string, text string")
    got = [tuple(r) for r in tables.read_sources(results, pages, key="q").orderBy("pos").collect()]
    assert got == [(1, 0, "B", "u1", "one"), (1, 2, "D", "u3", "three")]
    asked = spark.createDataFrame([("fever & rash", "BG"), ("x", "fr")], "q string, l string")
    said = [r.u for r in asked.select(tables.web_query(F.col("q"), ["a.org", "b.org"], F.col("l")).alias("u")).collect()]
    assert said == ["/search?q=fever%20%26%20rash%20site%3Aa.org%20OR%20site%3Ab.org&format=json&categories=general&language=bg", "/search?q=x%20site%3Aa.org%20OR%20site%3Ab.org&format=json&categories=general&language=all"]
    assert web.escaped is tables.escaped


def test_markdown_of_books(spark):
    pdfs = spark.createDataFrame([("/p/a.pdf",), ("/p/b.pdf",), ("/p/c.pdf",)], "path string")
    cached = spark.createDataFrame([("/m/a.md", "cached a"), ("/m/z.md", "other")], "path string, markdown string")
    made = spark.createDataFrame([("a", "new a"), ("b", "new b")], "slug string, markdown string")
    assert {tuple(r) for r in tables.markdown_of_books(pdfs, cached, made).collect()} == {("a", "cached a", True), ("b", "new b", False), ("c", None, None)}


def test_query_without_terms_in_fusion(spark):
    """Without keyword hits the order is that of the vectors."""
    sparse = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid int, doc_id int, rank int")
    near = spark.createDataFrame([(1, 11, 1), (2, 30, 1), (2, 29, 2), (2, 28, 3)], "qid int, doc_id int, rank int")
    got = [(r.qid, r.doc_id) for r in fusion.rrf([sparse, near]).orderBy("qid", "rank").collect()]
    assert got == [(1, 11), (1, 10), (2, 30), (2, 29), (2, 28)]
