import unicodedata

import pytest
from pyspark.sql import functions as F

from quern.functions import lists as L
from quern.functions import text as T
from quern.functions import vectors as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def deaccent(text, map_d=True):
    if map_d:
        text = text.replace("đ", "d").replace("Đ", "D")
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


@pytest.mark.parametrize("text", ["Đường bộ, Điều 5", "Nghị định 15/2020/NĐ-CP", "ẤẦẨẪẬ ơ̛ ñ Ç é ü", "", "Ꞗ plain"])
def test_strip_accents(spark, text):
    assert one(spark, T.strip_accents(F.lit(text))) == deaccent(text)
    assert one(spark, T.strip_accents(F.lit(text), map_d=False)) == deaccent(text, False)


def test_index_tokens(spark):
    got = one(spark, T.index_tokens(F.lit("Đường bộ, Điều 5 của QCVN_01 " + "x" * 41)))
    assert got == ["duong", "bo", "dieu", "5", "qcvn_01"]
    assert one(spark, T.index_tokens(F.lit("của và A"), stopwords=False)) == ["cua", "va", "a"]


def test_plain_tokens_split_at_barred_d(spark):
    assert one(spark, T.plain_tokens(F.lit("đường bộ"))) == ["uong", "bo"]


def test_evidence_tokens(spark):
    assert one(spark, T.evidence_tokens(F.lit("Thuộc về một Điều khoản x"))) == ["dieu", "khoan"]


def test_heading_and_body(spark):
    assert one(spark, T.heading_of(F.lit(" Tiêu đề \nthân bài\n x "))) == "Tiêu đề"
    assert one(spark, T.body_of(F.lit("a\n body\nmore \n"))) == "body\nmore"
    assert one(spark, T.heading_of(F.lit("no break"))) == ""
    assert one(spark, T.body_of(F.lit("no break"))) == "no break"


@pytest.mark.parametrize(
    "link, name",
    [("http://x/y/Lu%E1%BA%ADt+A.aspx", "Luật+A"), ("http://x/y/z.ASP/", "z"), ("", ""), (None, ""), ("http://x/%zz", "%zz")],
)
def test_name_from_link(spark, link, name):
    assert one(spark, T.name_from_link(F.lit(link).cast("string"))) == name


def test_name_from_passage(spark):
    assert one(spark, T.name_from_passage(F.lit("12 34 - 5678 90 12\r\nshort\r\n A  real   heading line \nx"))) == "A real heading line"
    assert one(spark, T.name_from_passage(F.lit("x"))) == ""


def test_weight_name():
    assert [T.weight_name(w) for w in (0.65, 1.0, 0.5, 10.0)] == ["0p65", "1", "0p5", "10"]


def test_numeric_first_order(spark):
    df = spark.createDataFrame([("10",), ("9",), ("b",), ("a1",), ("007",)], "k string")
    assert [r["k"] for r in df.orderBy(*T.numeric_first("k")).collect()] == ["007", "9", "10", "a1", "b"]


def test_lists(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, L.ordered_distinct(F.array(F.lit("b"), F.lit(""), F.lit(None), F.lit("a"), F.lit("b")))) == ["b", "a"]
    assert one(spark, L.union(arr("a", "b"), arr("b", "c"))) == ["a", "b", "c"]
    assert one(spark, L.lock_top(arr("a", "b", "c"), arr("c", "d"), 1)) == ["a", "c", "d", "b"]
    assert one(spark, L.overlap(arr("a", "b"), arr("b", "c"), 1)) == 0
    assert one(spark, L.difference(arr("a", "b", "a"), arr("b"))) == ["a"]


def test_ensure_members_may_lose_a_tail_member(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, L.ensure_members(arr("a", "b", "c", "g1"), arr("g1", "g2"), 4)) == ["a", "b", "c", "g2"]
    with pytest.raises(Exception, match="more required"):
        one(spark, L.ensure_members(arr("a"), arr("x", "y"), 1))


def test_vectors(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, V.dot(arr(1.0, 2.0), arr(3.0, 4.0))) == 11
    assert one(spark, V.unit(arr(3.0, 4.0))) == pytest.approx([0.6, 0.8])
    assert one(spark, V.unit(arr(0.0, 0.0))) == [0, 0]
    assert one(spark, V.mean_pool(F.array(arr(1.0, 0.0), arr(0.0, 1.0)), 2)) == pytest.approx([0.5**0.5] * 2)
    assert [one(spark, V.relevance(a)) for a in (arr(2.0), arr(1.0, 3.5), arr(1.0, 5.0, 2.0))] == [2, 2.5, 5]
    assert one(spark, V.sigmoid(F.lit(0.0))) == 0.5
