"""Golden vectors of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from carda.functions import codes, contact, text, times
from carda.operators import parse


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "s, expected",
    [("", 0), ("A", 919145239626757800), ("ab", 1765116674205471180), ("ABC", 1180123427128787400), ("ＡＢＣ１２３", 1399208215402564568), (None, 0)],
)
def test_simhash_vectors(spark, s, expected):
    assert text.simhash_py(s) == expected
    assert one(spark, text.simhash64(F.col("s")), s=s) == expected


def test_simhash_native_votes_agree(spark):
    """The Arrow path equals the sum of signed bits over native bigrams and hashes."""
    s = "马德里高薪聘炒锅师傅若干名 Madrid 2026"
    g = spark.createDataFrame([(s,)], "s string").select(F.explode(text.bigrams(text.text_normalize(F.col("s")))).alias("g")).groupBy("g").count()
    rows = g.select(text.hash64(F.col("g")).alias("h"), "count").collect()
    votes = [sum(r["count"] * (1 if (r["h"] >> k) & 1 else -1) for r in rows) for k in range(64)]
    bits = sum(1 << k for k in range(64) if votes[k] > 0)
    assert text.simhash_py(s) == (bits - (1 << 64) if bits >= 1 << 63 else bits)


@pytest.mark.parametrize("a, b, d", [(0, 0, 0), (-1, 0, 64), (-(1 << 63), 0, 1)])
def test_hamming(spark, a, b, d):
    assert spark.range(1).select(text.hamming64(F.lit(a), F.lit(b)).alias("x")).first()["x"] == d


@pytest.mark.parametrize("s", ["Hola Mundo", "hola　mundo", "HOLAMUNDO"])
def test_content_hash(spark, s):
    assert one(spark, text.content_hash(F.col("s")), s=s) == "93fa3e4624676f2e9aa143911118b4547087e9b6e0b6076f2e1027d7a2da2b0a"


@pytest.mark.parametrize(
    "s, expected",
    [("+34 612 345 678", "612345678"), ("0034 612-345-678", "612345678"), ("34612345678", "612345678"), ("612345678", "612345678"), ("12345", "12345"), ("abc", None), ("", None), (None, None), ("3461234567", "461234567")],
)
def test_phone9(spark, s, expected):
    assert one(spark, contact.phone9(F.col("s")), s=s) == expected


def test_contact_forms(spark):
    assert one(spark, contact.phone_main(F.col("s")), s="+34 612 345 678") == "+34612345678"
    assert one(spark, contact.phone_main(F.col("s")), s=None) == ""
    assert one(spark, contact.wechat_norm(F.col("s")), s=" My ID ") == "myid"
    assert one(spark, contact.wechat_norm(F.col("s")), s="   ") is None
    assert one(spark, contact.contact_key(F.col("a"), F.col("b")), a=None, b=None) is None
    assert one(spark, contact.contact_key(F.col("a"), F.col("b")), a="6", b=None) == "6|"
    assert one(spark, contact.contact_key(F.col("a"), F.col("b")), a=None, b="w") == "|w"
    assert one(spark, contact.phone_mask(F.col("s")), s="612345678") == "612 ·· ··"
    assert one(spark, contact.phone_mask(F.col("s")), s="abc") == "··· ·· ··"
    assert one(spark, contact.ip_text(contact.ip_pack(F.col("s"))), s="203.0.113.181") == "203.0.113.181"
    assert one(spark, contact.ip_text(contact.ip_pack(F.col("s"))), s="300.1.1.1") == "0.0.0.0"


@pytest.mark.parametrize(
    "href, expected",
    [("http://z/q", "http://z/q"), ("//c/d", "https://c/d"), ("/e", "https://h.t/e"), ("f", "https://h.t/a/f"), ("#x", None), ("javascript:0", None)],
)
def test_absolute_url(spark, href, expected):
    assert one(spark, parse.absolute_url(F.col("h"), F.lit("https://h.t/a/b.html?x=1")), h=href) == expected


def test_parse_pieces(spark):
    for s, e in (("2026/7/4", "2026-07-04"), ("2026年7月4日", "2026-07-04"), ("发布 2026-07-27 · 地区", "2026-07-27"), ("hoy", None)):
        assert one(spark, parse.parse_date(F.col("s")), s=s) == e
    assert one(spark, parse.clean_contact_name(F.col("s")), s="联络人：王先生 · 电话") == "王先生"
    assert one(spark, text.excerpt(F.col("s"), 5), s="\nabcdefg\nx") == "abcde…"
    c = F.col
    assert one(spark, text.build_content(c("t"), c("c"), c("s"), c("d")), t="T", c="C", s="S", d="D") == "T\n【C】\n薪资：S\nD"
    assert one(spark, text.build_content(c("t"), c("c"), c("s"), c("d")), t="0", c=None, s="", d=None) == "（无正文）"


def test_css_to_xpath():
    assert parse.css_to_xpath(".job-item a.title") == "//*[contains(concat(' ',normalize-space(@class),' '),' job-item ')]//a[contains(concat(' ',normalize-space(@class),' '),' title ')]"
    assert parse.css_to_xpath("#x") == "//*[@id='x']"
    assert parse.css_to_xpath("div") == "//div"
    assert parse.css_to_xpath("a>b") == "//*"


def test_half_width_kana(spark):
    assert text.normalize_py("ｶﾞｷﾞｸﾞ ｱ") == "ガギグア"
    assert one(spark, text.text_normalize(F.col("s")), s="ｶﾞｷﾞｸﾞ ｱ") == "ガギグア"


def test_times_across_summer_time(spark):
    now = times.ntz("2026-03-29 01:30:00")
    row = spark.range(1).select(times.day_bucket(times.ntz("2026-03-28 22:59:59"), now).alias("a"), times.day_bucket(times.ntz("2026-03-28 23:00:00"), now).alias("b"), times.time_ago(times.ntz("2026-03-29 01:29:10"), now).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == ("yesterday", "today", "刚刚")


def test_dup_rate(spark):
    for d, n, e in ((3, 8, "27%"), (4, 2, "67%"), (0, 3, "0%"), (0, 0, "—")):
        assert spark.range(1).select(codes.dup_rate(F.lit(d), F.lit(n)).alias("x")).first()["x"] == e
