import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from lexloom.functions import ids, text, vectors, web


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "given, column, wanted",
    [
        ("Fever COUGH, fever a", text.index_terms, ["fever", "cough", "fever"]),
        ("Пациентът има треска.", text.tokens, ["пациентът", "има", "треска"]),
        ("a ![x](data:image/png;base64,AA) b", text.without_data_images, "a  b"),
        ("one\n![](p/1.jpeg)\ntwo", text.without_image_lines, "one\n\ntwo"),
        ("при­ лага", text.without_soft_hyphens, "прилага"),
        ("перо - ралният and anae- mia 3 - 4", text.joined_hyphens, "пероралният and anaemia 3 - 4"),
        ("a  \tb\n\n c", text.single_spaces, "a b\n\n c"),
        ("гъõрлен façade", text.without_specks, "гърлен façade"),
        ("## A title ", text.heading_level, 2),
        ("## A title \r", text.heading_title, "A title"),
        ("#No", text.heading_level, 0),
        ("  | a |", text.line_type, "table"),
        ("* a", text.line_type, "list"),
        ("A. B? c! d", text.rough_sentences, ["A.", "B?", "c!", "d"]),
        ("<p>Hello  <b>there</b></p>\n", text.html_snippet, "Hello there"),
        ("**X** holds [1].\n- one\n2. two", text.stripped_answer, "X holds [1].\none\ntwo"),
        ("<think>hm\nhm</think>\n# T\ntext", text.stripped_answer, "T\ntext"),
        ("## Short\n## Abc\n## Ends:\n## a = b c\n### no", text.outline, "Short"),
        ("Severe fever, flu/Fever треска influenza", text.latin_terms, ["severe", "fever", "influenza"]),
        ("болест на гравес", text.keywords, ["гравес"]),
        ("flu на е", text.keywords, []),
        ("  two  words ", text.word_count, 2),
        (" \t", text.is_blank, True),
        (None, text.is_blank, True),
        (" English ", text.language_code, "en"),
        ("de", text.language_code, "both"),
        (None, text.clean_markdown, None),
        ("", text.tokens, []),
    ],
)
def test_function(spark, given, column, wanted):
    assert one(spark, given, column) == wanted


@pytest.mark.parametrize(
    "answer, sources, wanted",
    [("so [2].", 3, [2]), ("[9]", 3, []), ("[1, 3]", 3, [1, 3]), ("[1][2]", 2, [1, 2]), ("[1, 9]", 3, []), ("[1]", 0, []), ("", 3, [])],
)
def test_citations(spark, answer, sources, wanted):
    assert one(spark, answer, lambda c: text.citations(c, F.lit(sources))) == wanted
    parts = one(spark, answer, lambda c: text.answer_segments(c, F.lit(sources)))
    assert [p.citation for p in parts if p.citation] == wanted
    if not wanted:
        assert "".join(p.text for p in parts) == answer


@pytest.mark.parametrize("key", ["book-a:0", "summary:book-a:0", "b:12", "c:77", "книга:3"])
def test_guid(spark, key):
    made = bytearray(hashlib.sha256(("chunk:" + key).encode()).digest()[:16])
    made[6] = made[6] & 0x0F | 0x80
    made[8] = made[8] & 0x3F | 0x80
    assert one(spark, key, ids.guid) == str(uuid.UUID(bytes_le=bytes(made)))


def test_point_key(spark):
    rows = spark.sql("select 'b' book, 3 i, cast(null as boolean) s union all select 'b', 3, true")
    assert {r.k for r in rows.select(ids.point_key(F.col("book"), F.col("i"), F.col("s")).alias("k")).collect()} == {"b:3", "summary:b:3"}


@pytest.mark.parametrize(
    "url, wanted",
    [("https://who.int/x", True), ("https://www.who.int", True), ("http://who.int", False), ("ftp://who.int", False), ("https://other.org", False), ("https://who.int.evil.com", False), ("no url", False), (None, False)],
)
def test_allowed(spark, url, wanted):
    assert one(spark, url, lambda c: web.is_allowed(c, [" .who.int/path "])) is wanted


def test_addresses(spark):
    free = ["8.8.8.8", "172.15.0.1", "172.32.0.1", "2001:4860::1"]
    blocked = ["127.0.0.1", "10.1.1.1", "192.168.0.1", "169.254.1.1", "172.16.0.1", "100.64.0.1", "0.0.0.0", "::1", "fe80::1", "fc00::1", "::ffff:10.0.0.1", "nonsense", None]
    rows = spark.createDataFrame([(a,) for a in free + blocked], "a string").select("a", web.is_blocked_address("a").alias("b")).collect()
    assert {r.a: r.b for r in rows} == dict.fromkeys(free, False) | dict.fromkeys(blocked, True)


def test_vectors(spark):
    r = spark.sql("select array(3f, 4f) a, array(0f, 0f) z").select(vectors.cosine(F.col("a"), F.col("a")).alias("one"), vectors.cosine(F.col("a"), F.col("z")).alias("none"), vectors.normalized(F.col("a")).alias("u"), vectors.normalized(F.col("z")).alias("same")).first()
    assert (round(r.one, 9), r.none, r.u, r.same) == (1.0, 0.0, [0.6, 0.8], [0.0, 0.0])


def test_addresses_by_brute_force(spark):
    import ipaddress
    import random

    rng = random.Random(1)
    given = ["::", "::1", "1::", "1::2:3", ":::", "1:::2", ":1", "1:", "::ffff:10.0.0.1", "::FFFF:8.8.8.8", "::10.0.0.1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8::", "fe80::1%eth0", "fd00::", "febf::", "fec0::", "12345::", "g::", "1.2.3", "1.2.3.4.5", "01.2.3.4", "256.1.1.1", "", " 10.0.0.1 ", "1:2:3:4:5:6:1.2.3.4", "1::1.2.3.4", "::1::", "a b", "2001:db8::ff00:42:8329"]
    nets = [ipaddress.ip_network(n) for n in web.BLOCKED]
    for n in nets:
        for edge in (int(n.network_address), int(n.broadcast_address)):
            given += [str(type(n.network_address)(v)) for v in (edge - 1, edge, edge + 1) if 0 <= v < 1 << n.max_prefixlen]
    given += [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(200)] + [str(ipaddress.IPv6Address(rng.getrandbits(128) >> rng.choice([0, 30, 90, 120]))) for _ in range(200)]

    def blocked(text):
        try:
            ip = ipaddress.ip_address(text.strip())
        except ValueError:
            return True
        ip = getattr(ip, "ipv4_mapped", None) or ip
        return any(ip.version == n.version and ip in n for n in nets)

    rows = spark.createDataFrame([(t,) for t in given], "t string").select("t", web.is_blocked_address("t").alias("b")).collect()
    assert [(r.t, r.b) for r in rows if r.b != blocked(r.t)] == []
    assert spark.range(1).select(web.is_blocked_address(F.lit(None).cast("string")).alias("b")).first().b is True
