"""Column functions on small fixtures."""

import hashlib

import pytest
from pyspark.sql import functions as F

from hustings.functions import articles as A
from hustings.functions import cases as C
from hustings.functions import names as N
from hustings.functions import numbers as M


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first().y


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (N.normalize_name, "Dr. M.K.Lorne (Petty) @ Babu", "m k lorne"),
        (N.normalize_name, None, ""),
        (N.normalize_constituency, " North  Vale (SC)", "NORTH VALE"),
        (N.stem, "northvale (asha) (SC)", "NORTHVALE (ASHA)"),
        (N.alnum_key, "M.K. Lorne-2", "MKLORNE2"),
        (N.safe_name, "D. Quill", "d__quill"),
        (N.clean_key, "(D. Quill)", "d__quill"),
        (N.clean_search_name, "Asha Verran S/O Torgal", "Asha Verran"),
        (N.clean_search_name, "D.Quill @ Babu", "D.Quill"),
        (N.title_case, "Y.S. ASHA  McVerran", "Y.S. Asha  McVerran"),
        (N.party_short, "Telugu Desam", "TDP"),
        (N.party_short, "Other", "Other"),
        (A.title_key, "Ünder 2 Skies!", "nder2skies"),
        (A.safe_href, " javascript:x", None),
        (A.safe_href, " https://a.b ", "https://a.b"),
        (A.canonical_url, "HTTPS://A.example/p?utm_x=1&b=2&a=&ref=q&mc_1=3#f", "https://a.example/p?a=&b=2"),
        (A.canonical_url, "http://a/?q=a+b%20c", "http://a/?q=a+b+c"),
        (A.strip_html, "<p>a &amp; b</p>\n c", "a & b c"),
        (A.article_id, "", None),
        (C.classify_sections, "307 IPC", "Serious/Violent"),
        (C.classify_sections, "420", "Corruption & Fraud"),
        (C.classify_sections, "171", "Election Offenses"),
        (C.classify_sections, "188", "Political/Protest"),
        (C.classify_sections, "120B", "Minor/Other"),
        (C.classify_sections, "JUVENILE 302", "Minor/Other"),
        (C.extract_profession, "Profession/Occupation (a) Self Farmer (old)", "Farmer"),
        (C.extract_profession, "Self Profession : nil", None),
        (C.extract_education, "Highest educational qualification: B.A from X", "B.A from X"),
        (C.clean_education, "completed B.A ATTESTED by Y", "completed B.A"),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


@pytest.mark.parametrize(("rule", "value", "want"), [("leading", "3 cases", 3), ("digits", "3 cases", 0), ("first_run", "no 3", 3), ("leading", "NIL", 0), ("leading", None, 0)])
def test_counts(spark, rule, value, want):
    assert one(spark, value, lambda c: M.case_count(c, rule)) == want


def test_numbers(spark):
    assert one(spark, "1,23,456", M.to_int) == 123456
    assert one(spark, "-", lambda c: M.to_int(c, 0)) == 0
    assert one(spark, "12.5", M.to_float) == 12.5


@pytest.mark.parametrize(
    ("fir", "sections", "raw", "want"),
    [
        ("FIR.No.79/2023", "302", "", "79/2023"), ("FIR No. 56-2023", "302", "", "56/2023"), ("Crime No 12 OF 2019", "302", "", "12/2019"), ("5/22", "302", "FIR: 5/22 | Desc: d", "5/2022"),
        ("007/2020", "x", "", "7/2020"), ("9/202", "x", "", "9/202"), ("NIL", "R/W 149 IPC", "", "NILRW149IPC"), ("", "", "", ""), ("NIL", None, "", "NILNONE"),
    ],
)
def test_signature(spark, fir, sections, raw, want):
    df = spark.createDataFrame([(fir, sections, raw)], "f string, s string, r string")
    assert df.select(C.case_signature("f", "s", "r").alias("y")).first().y == want


def test_hash_id_wraps_like_32_bit_integers(spark):
    def slow(text):
        mul, mask = lambda a, b: a * b & 0xFFFFFFFF, 0xFFFFFFFF
        h1, h2 = 0xDEADBEEF, 0x41C6CE57
        data = text.encode("utf-16-le")
        for i in range(0, len(data), 2):
            ch = data[i] | data[i + 1] << 8
            h1, h2 = mul(h1 ^ ch, 2654435761), mul(h2 ^ ch, 1597334677)
        h1 = mul(h1 ^ h1 >> 16, 2246822507) ^ mul(h2 ^ h2 >> 13, 3266489909)
        h2 = mul(h2 ^ h2 >> 16, 2246822507) ^ mul(h1 ^ h1 >> 13, 3266489909)
        return f"nr_{((h2 & 2097151) << 32) + (h1 & mask):x}"

    for text in ("https://a.example/1", "é😀", "x" * 700):
        assert one(spark, text, A.article_id) == slow(text)


def test_keys_terms_and_links(spark):
    df = spark.createDataFrame([("http://a/?ref=1", "A b")], "u string, t string")
    assert df.select(A.dedupe_key("u", "t").alias("k")).first().k == hashlib.sha1(b"http://a/|ab").hexdigest()
    terms = spark.createDataFrame([("Asha Bel Verran (X)", "NORTHVALE")], "n string, c string").select(N.search_terms("n", "c").alias("t")).first().t
    assert terms == ['"Asha Bel Verran"', '"Bel Verran"', '"Asha Bel"', '"NORTHVALE" Andhra']
    links = one(spark, "fb.com/1234567890 facebook.com/asha A@B.example", C.extract_socials)
    assert links == {"facebook": "facebook.com/asha", "email": "a@b.example"}


@pytest.mark.parametrize(("answer", "n"), [('{"pending":[{"fir_no":"1/2020"}]}', 1), ('So: ```json\n{"pending":[{"fir_no":"1/2020"}]}``` ok', 1), ("none", 0)])
def test_lenient_json(spark, answer, n):
    got = one(spark, answer, C.lenient_json)
    assert len((got and got.pending) or []) == n


def test_relevance(spark):
    rows = [
        ("Verran wins", "Asha Verran", "NORTHVALE", "name"), ("Torgal spoke", "Asha Verran S/O Torgal", "NORTHVALE", "loose"), ("Babu here", "D.Quill @ Babu", "X", "name"),
        ("in northvale today", "Asha Verran", "NORTHVALE (SC)", "constituency"), ("Telugu Desam rally", "Asha Verran", "N", "party"), ("the cat", "D Qu", "N", "loose"),
    ]
    df = spark.createDataFrame([(t, "", n, c, "TDP") for t, n, c, _ in rows], "t string, s string, n string, c string, p string")
    got = df.select(A.relevance_kind("t", "s", "n", "c", N.party_aliases("p")).alias("k")).collect()
    assert [r.k for r in got] == [w for *_, w in rows]


def test_relative_age(spark):
    df = spark.sql("select '2024-01-01T00:00:00Z' as t, timestamp'2024-01-01 03:00:00' as now")
    r = df.select(A.relative_age("t", F.col("now")).alias("a")).first().a
    assert (r.amount, r.unit, r.stale) == (-3, "hour", True)


def test_entities_that_a_cut_text_left_open(spark):
    """``closed``: the rule of the queries' SQL; without it, the reader's, for which a semicolon isn't needed."""
    texts = ["st&amp and &amp; b", "a &copy; &copy b &#233; &#xE9; &#233", "x & y && &", "&amp;amp; &amp;copy", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.orderBy("i").select(A.strip_html("t", closed=True).alias("closed"), A.strip_html("t").alias("open"))
    rows = got.collect()
    assert [r.closed for r in rows] == ["st&amp and & b", "a © &copy b é é &#233", "x & y && &", "&amp; &copy", ""]
    assert [r.open for r in rows] == ["st& and & b", "a © © b é é é", "x & y && &", "&amp; &copy", ""]
