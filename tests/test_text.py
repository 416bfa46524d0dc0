import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowgauge.functions import keywords, similarity, text
from tests import plain

NORMALISED = {
    "4-0 Past de klep?": "0 past de klep", "0) Vervang filter": "vervang filter", "A1) Test": "test", "19.1 Foo": "1 foo", "1.19.1 Foo": "foo",
    "klep-buis vast": "buis vast", "Halt. Pauze": "pauze", " 0) Vervang": "0 vervang", "Dubbele   spatie!": "dubbele spatie", "a_b c²": "a_b c²", "?????": "", "": "", None: "",
    " x y\x1cz\t": "x y z",
}


def test_normalize(spark):
    df = spark.createDataFrame([(k,) for k in NORMALISED], "t string").select("t", text.normalize_text(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == NORMALISED


TEXTS = st.text(st.sampled_from("aAbé1²_ .-)\t \x1c!ß"), max_size=12)


def test_normalize_as_plain(spark):
    rows = []

    @settings(max_examples=300, database=None)
    @given(TEXTS)
    def gather(t):
        rows.append((t,))

    gather()
    df = spark.createDataFrame(rows, "t string").select("t", text.normalize_text(F.col("t")).alias("n"), text.short_text(F.col("t")).alias("s"))
    for r in df.collect():
        assert r.n == plain.normalize(r.t)
        assert r.s == r.t.lower().strip()


def test_ratio(spark):
    rows = []

    @settings(max_examples=150, database=None)
    @given(st.text("abc é", max_size=14), st.text("abc é", max_size=14))
    def gather(a, b):
        rows.append((a, b))

    gather()
    rows += [("", ""), ("a", ""), ("", "b"), ("x" * 139 + "y" * 61, "x" * 139 + "z" * 61)]
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame(rows, "a string, b string")
    df = df.select("a", "b", similarity.fuzzy_percent(a, b).alias("arrow"), similarity.fuzzy_percent(a, b, native=True).alias("native"), similarity.most_percent(a, b).alias("most"))
    for r in df.collect():
        assert r.arrow == r.native == pytest.approx(100 * plain.ratio(r.a, r.b)), (r.a, r.b)
        assert r.most >= r.arrow - 0.5


def test_ratio_rounds_halves_to_even(spark):
    # 137 of 200 is 68.5 percent
    a, b = "x" * 137 + "y" * 63, "x" * 137 + "z" * 63
    df = spark.createDataFrame([(a, b)], "a string, b string").select(similarity.fuzzy_percent(F.col("a"), F.col("b")).alias("p"))
    assert df.first().p == 68.0


def test_overlap_and_jaccard(spark):
    df = spark.sql("select 'abcd' a, 'xabcdx' b, array('p','q') k, array('q','r') m, cast(array() as array<string>) e")
    r = df.select(similarity.overlap(F.col("a"), F.col("b")).alias("o"), similarity.overlap(F.col("a"), F.lit("zz")).alias("n"), similarity.jaccard(F.col("k"), F.col("m")).alias("j"), similarity.jaccard(F.col("k"), F.col("e")).alias("z")).first()
    assert (r.o, r.n, r.z) == (4 / 6, None, None)
    assert r.j == pytest.approx(1 / 3)


def test_page_file(spark):
    names = {"DP17-GIDS12_page_01.png": ("DP17-GIDS12", 1), "a_page_1_page_02.png": ("a_page_1", 2), "cover.png": (None, None), "_page_3.png": ("", 3)}
    doc, page = text.page_file(F.col("n"))
    df = spark.createDataFrame([(k,) for k in names], "n string").select("n", doc.alias("d"), page.alias("p"))
    assert {r.n: (r.d, r.p) for r in df.collect()} == names


def test_token_keywords(spark):
    r = spark.sql("select 'De klep, de KLEP en het filter op 1' t, cast(null as string) n").select(keywords.token_keywords(F.col("t")).alias("k"), keywords.token_keywords(F.col("n")).alias("e")).first()
    assert sorted(r.k) == ["filter", "klep"]
    assert r.e == []
