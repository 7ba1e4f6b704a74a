"""One consistent form for texts that read the same.

One scan settles every text whose code points are all stable already. Any other text is exploded into positioned
words, and words with unstable code points into clusters, a code point with the marks on it. Single code points are joined with a broadcast table of decompositions and
look-alikes; the few distinct clusters that hold marks are exploded to their code points, decomposed by the same table,
their marks put in canonical order, and recomposed. Then the strings are rebuilt in order.

A look-alike letter is folded only in a word all of whose letters are Latin or drawn like Latin ones, so words of other
scripts stay what they are.

Defined cases: a null text has a null form; an empty text an empty one; repeated ids are kept apart by their texts; a
text of any length is rebuilt from its own rows only; extra columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carda.session import cut, fixed_rows

# Letters of other scripts drawn like Latin ones, and hyphens drawn like the ASCII one.
LOOKALIKE_FROM = "аеорсухіјѕԁһԛԝӏАВЕКМНОРСТУХІЈЅԌԚԜΑΒΕΖΗΙΚΜΝΟΡΤΥΧοѵօսհոցյႽᎪᏴᏟᎬᏀᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ‐‑−"
LOOKALIKE_TO = "aeopcyxijsdhqwlABEKMHOPCTYXIJSGQWABEZHIKMNOPTYXovouhngjSABCEGHJKLMPSTVWZ---"
# Code points without a glyph of their own.
INVISIBLE = "­͏؜᠎​‌‎‏‪‫‬‭‮⁠⁡⁢⁣⁤︎️﻿"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F))
#: A joiner is drawn only between pictographs.
_PICTURES = r"\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}"
_LOOSE_JOINER = rf"(^|[^{_PICTURES}\x{{FE0F}}])\x{{200D}}+|\x{{200D}}+(?![{_PICTURES}])"
#: Code points that are their own form wherever they stand.
_STABLE = "\\n\\x20-\\x7e\\u00a1-\\u00a7\\u00a9\\u00ab\\u00ac\\u00ae\\u00b0\\u00b1\\u00b6\\u00b7\\u00bb\\u00bf-\\u00ff\\u2013-\\u2016\\u2018-\\u201f\\u20ac\\u3001\\u3002\\u3008-\\u3011\\u4e00-\\u9fff\\x{1F300}-\\x{1FAFF}\\u200d"


#: Hangul vowels and finals, which join the letter before them.
_JOINING = "\u1161-\u1175\u11a8-\u11c2"
_CLUSTER = f"[^\\p{{M}}{_JOINING}][\\p{{M}}{_JOINING}]*|[\\p{{M}}{_JOINING}]+"
_WORD = "\\p{L}[\\p{L}\\p{M}]*|[^\\p{L}]+"
_OTHER_SCRIPT = "\\p{L}&&[^\\p{IsLatin}\\p{IsHan}]"


@lru_cache(maxsize=4)
def _tables(look_from: str, look_to: str) -> tuple[list[tuple[str, str, str]], list[tuple[str, int]], list[tuple[str, str]]]:
    """(character, decomposed, composed), (mark, class) and (pair, composed) by rule from the Unicode database."""
    mapping, marks, pairs = [], [], []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        if unicodedata.combining(ch):
            marks.append((ch, unicodedata.combining(ch)))
        kind = unicodedata.category(ch)
        if kind == "Zs" or ch == "\u0085":
            d = " "
        elif ch in INVISIBLE:
            d = ""
        else:
            d = unicodedata.normalize("NFKD", ch)
        whole = unicodedata.normalize("NFC", d)
        if d != ch or whole != ch:
            mapping.append((ch, d, whole))
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and unicodedata.normalize("NFC", parts) == ch:
            step = unicodedata.normalize("NFC", parts[:-1])
            if len(step) == 1:
                pairs.append((step + parts[-1], ch))
    return mapping, marks, pairs


def _composed(clusters: DataFrame, map_df: DataFrame, mark_df: DataFrame, pair_df: DataFrame) -> DataFrame:
    """(cluster) -> (cluster, whole): decomposed, marks ordered by class, recomposed."""
    points = clusters.select("cluster", F.posexplode(F.split("cluster", "")).alias("pos", "ch")).join(map_df, "ch", "left")
    points = points.select("cluster", "pos", F.posexplode(F.split(F.coalesce("to", "ch"), "")).alias("sub", "cp")).where("cp <> ''")
    points = points.join(mark_df, "cp", "left").select("cluster", "pos", "sub", "cp", F.coalesce("ccc", F.lit(0)).alias("ccc"), F.col("cp").rlike(f"^[{_JOINING}]").alias("joins"))
    order = Window.partitionBy("cluster").orderBy("pos", "sub")
    numbered = points.withColumn("c", F.sum(F.when((F.col("ccc") == 0) & ~F.col("joins"), 1).otherwise(0)).over(order))
    cl = numbered.groupBy("cluster", "c").agg(F.array_sort(F.collect_list(F.struct("ccc", "pos", "sub", "cp"))).alias("x"))
    cl = cl.select("cluster", "c", F.col("x")[0]["cp"].alias("base"), F.transform(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), lambda v: v["cp"]).alias("tail"), F.lit("").alias("kept"))
    # no character is composed of a base and more than three marks; a mark that does not compose is kept and blocks none
    # of another class after it
    steps = 3
    for _ in range(steps):
        nxt = F.get("tail", F.lit(0))
        rest = F.slice("tail", 2, F.greatest(F.size("tail") - 1, F.lit(0)))
        cl = cl.join(pair_df, F.concat("base", F.coalesce(nxt, F.lit(""))) == F.col("pair"), "left").select(
            "cluster", "c", F.coalesce("whole", "base").alias("base"), F.when(F.size("tail") == 0, F.col("tail")).otherwise(rest).alias("tail"), F.when(F.col("whole").isNull(), F.concat("kept", F.coalesce(nxt, F.lit("")))).otherwise(F.col("kept")).alias("kept")
        )
    built = F.concat("base", "kept", F.array_join("tail", ""))
    return cl.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", built.alias("s")))), lambda v: v["s"]), "").alias("whole"))


def _tidy(c: Column) -> Column:
    """Runs of spaces and spaces before a line's end, looked for only where there are any."""
    one = F.when(c.contains("  "), F.regexp_replace(c, " {2,}", " ")).otherwise(c)
    return F.when(one.contains(" \n") | one.endswith(" "), F.regexp_replace(one, r" +(?=\n|$)", "")).otherwise(one)


def _settled(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, th, n, form): the stable texts' forms; null form and the narrowed text ``n`` where code points must be looked at."""
    wide = F.col("t").rlike("[\\uFF01-\\uFF5E\\u3000\\u00a0]")
    narrow = F.when(wide, F.translate("t", _WIDE + "\u3000\u00a0", _NARROW + "  ")).otherwise(F.col("t"))
    line = lambda c: F.when(c.contains("\r"), F.regexp_replace(c, r"\r\n?", "\n")).otherwise(c)
    joiner = lambda c: F.when(c.contains("\u200d"), F.regexp_replace(c, _LOOSE_JOINER, "$1")).otherwise(c)
    judge = lambda n: F.struct(F.when(n.rlike(f"[^{_STABLE}]"), n).alias("n"), F.when(~n.rlike(f"[^{_STABLE}]"), _tidy(n)).alias("form"))
    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    # the array binds the narrowed text once
    return src.select("k", "t", F.transform(F.array(joiner(line(narrow))), judge)[0].alias("x")).select("k", "t", "x.n", "x.form")


def _rebuilt(rest: DataFrame, look_from: str = LOOKALIKE_FROM, look_to: str = LOOKALIKE_TO) -> DataFrame:
    """(th, n) -> (th, form): distinct unstable texts, cluster by cluster."""
    spark = rest.sparkSession
    mapping, marks, pairs = _tables(look_from, look_to)
    map_df = F.broadcast(fixed_rows(spark, mapping, "ch string, to string, alone string"))  # all bounded by Unicode
    mark_df = F.broadcast(fixed_rows(spark, marks, "cp string, ccc int"))
    pair_df = F.broadcast(fixed_rows(spark, pairs, "pair string, whole string"))
    look_df = F.broadcast(fixed_rows(spark, list(zip(look_from, look_to)), "ch string, latin string"))
    seen = F.regexp_replace("n", f"[{INVISIBLE}]", "")
    plain = "".join(c for c in look_from if c.isalpha())
    foldable = lambda w: ~w.rlike(f"[{_OTHER_SCRIPT}&&[^{plain}]]")
    # a word is judged and cut into clusters before it is exploded, once; a stable word stays whole
    loose = lambda w: w.rlike(f"[^{_STABLE}]")
    cut_word = lambda w: F.struct(loose(w).alias("loose"), foldable(w).alias("fold"), F.when(loose(w), F.regexp_extract_all(w, F.lit(f"({_CLUSTER})"), 1)).otherwise(F.array(w)).alias("clusters"))
    words = rest.select("th", F.posexplode(F.transform(F.regexp_extract_all(seen, F.lit(f"({_WORD})"), 1), cut_word)).alias("w", "x"))
    pieces = words.select("th", "w", "x.loose", "x.fold", F.posexplode("x.clusters").alias("p", "cluster"))
    # look-alikes: the letter itself or the base of a cluster
    pieces = pieces.withColumn("ch", F.when(F.col("loose"), F.substring("cluster", 1, 1))).join(look_df, "ch", "left")
    pieces = pieces.select("th", "w", "p", "loose", F.when(F.col("fold") & F.col("latin").isNotNull(), F.concat("latin", F.expr("substring(cluster, 2)"))).otherwise(F.col("cluster")).alias("cluster"))
    marked = F.col("loose") & (F.length("cluster") > 1)
    composed = _composed(pieces.where(marked).select("cluster").distinct(), map_df, mark_df, pair_df)
    x = pieces.join(map_df, (F.col("cluster") == F.col("ch")), "left").select("th", "w", "p", "cluster", "alone")
    x = x.join(composed, "cluster", "left").select("th", "w", "p", F.coalesce("whole", "alone", "cluster").alias("s"))
    built = x.groupBy("th").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w", "p", "s"))), lambda v: v["s"]), "").alias("built"))
    return rest.select("th").join(built, "th", "left").select("th", _tidy(F.coalesce("built", F.lit(""))).alias("form"))


def canonical_form(docs: DataFrame, key: str = "doc_id", text: str = "text", look_from: str = LOOKALIKE_FROM, look_to: str = LOOKALIKE_TO) -> DataFrame:
    """(key, text) -> (key, text, form). Rows with one text share a form; a longer table of look-alikes may be given."""
    x = _settled(docs, key, text)
    done = x.where("n is null").select("k", "t", "form")
    rest = x.where("n is not null").select("k", "t", "n", F.md5("t").alias("th"))
    forms = _rebuilt(rest.select("th", "n").dropDuplicates(["th"]), look_from, look_to)
    return done.unionByName(rest.join(forms, "th").select("k", "t", "form")).select(F.col("k").alias(key), F.col("t").alias(text), "form")


def visual_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, fh): for every non-null text its hash and the hash of its form. One scan; only hashes and the narrowed
    unstable texts are kept."""
    x = _settled(docs, key, text).where("t is not null")
    held = cut(x.select("k", F.md5("t").alias("th"), F.md5("form").alias("fh"), "n"))
    rest = held.where("n is not null")
    forms = _rebuilt(rest.select("th", "n").dropDuplicates(["th"])).select("th", F.md5("form").alias("fh"))
    done = held.where("n is null").select("k", "th", "fh")
    return done.unionByName(rest.select("k", "th").join(forms, "th").select("k", "th", "fh")).withColumnRenamed("k", "id")


def variant_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, texts): documents of forms more than one text has, with the lowest id of the form and how many
    different texts it has. A row per document, however large the class."""
    held = visual_classes(docs, key, text)
    shared = held.groupBy("fh", "th").agg(F.min("id").alias("low")).groupBy("fh").agg(F.min("low").alias("class_id"), F.count("*").alias("texts")).where("texts > 1")
    return held.select("id", "fh").distinct().join(shared, "fh").select(F.col("id").alias("doc_id"), "class_id", "texts")


def same_to_the_eye(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b): documents whose texts differ in code points but share a form, smaller id first.

    Pairs are made between different texts of a form, then spread over the documents holding them, so a large group
    of exact copies adds nothing by itself; :func:`variant_classes` says the same with a row per document.
    """
    held = cut(visual_classes(docs, key, text).distinct())
    variants = held.select("fh", "th").distinct()
    shared = variants.groupBy("fh").agg(F.count("*").alias("n")).where("n > 1").select("fh")
    v = variants.join(shared, "fh")
    two = v.select("fh", F.col("th").alias("ta")).join(v.select("fh", F.col("th").alias("tb")), "fh").where("ta < tb")
    a, b = held.select(F.col("id").alias("ia"), F.col("fh"), F.col("th").alias("ta")), held.select(F.col("id").alias("ib"), F.col("fh"), F.col("th").alias("tb"))
    pairs = two.join(a, ["fh", "ta"]).join(b, ["fh", "tb"]).where("ia <> ib")
    return pairs.select(F.least("ia", "ib").alias("doc_id_a"), F.greatest("ia", "ib").alias("doc_id_b")).distinct()
