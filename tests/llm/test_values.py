"""Surviving records, canonical values, look-alikes and mixing."""

import datetime as dt
import itertools
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from carda.llm import canonical, lookalike, mixing, survivor

REGIONS = [(1, 0, "Madrid 马德里", 1), (2, 0, "Málaga 马拉加", 1), (11, 1, "Centro 市中心", 2), (12, 2, "Centro 市中心", 2), (13, 1, "Almendral 杏树园", 2)]
CATEGORIES = [(1, "餐饮服务 Hostelería"), (2, "百货零售 Comercio minorista")]


def reference(spark):
    return spark.createDataFrame(REGIONS, "id int, parent_id int, name string, level int"), spark.createDataFrame(CATEGORIES, "id int, name string")


def test_typed_values_find_their_entry(spark):
    reg, cat = reference(spark)
    rows = [
        (1, "Mdarid", "centro", "餐饮类"),
        (2, "ＭÁＬＡＧＡ", "市中心附近", "minorista Comercio"),
        (3, "马拉加/Málaga", None, "otros"),
        (4, "Lisboa", "Almendrral", ""),
        (5, None, "Centro bº", None),
        (5, None, "Centro bº", None),
        (6, " ", "?", "餐飲服務"),
    ]
    jobs = spark.createDataFrame(rows, "id long, city string, district string, category string").withColumn("name", F.lit("clash")).withColumn("value", F.lit(1))
    got = {(r["job_id"], r["field_name"]): r["ref_id"] for r in canonical.map_jobs(jobs, reg, cat).collect()}
    want = {(1, "city"): 1, (1, "district"): 11, (1, "category"): 1, (2, "city"): 2, (2, "district"): 12, (2, "category"): 2, (3, "city"): 2, (3, "category"): 0, (4, "city"): 0, (4, "district"): 13, (4, "category"): 0, (5, "district"): 0, (6, "city"): 0, (6, "district"): 0, (6, "category"): 1}
    assert got == want
    listed = canonical.typed_differently(canonical.map_jobs(jobs.where("id = 1"), reg, cat), reg, cat).count()
    assert listed == 3
    assert canonical.map_jobs(jobs.limit(0), reg, cat).count() == 0


def test_scores_equal_a_plain_cosine(spark):
    names = [r[2] for r in REGIONS[:2]]
    rows, idf, unseen = canonical.reference_index(names)
    vec: dict = {}
    for n, f, g, w in rows:
        vec.setdefault((n, f), {})[g] = w
    idf = dict(idf)
    for value in ("madrid", "malga", "mad"):
        q = {g: c * idf.get(g, unseen) for g, c in canonical._grams_py(value).items()}
        z = np.sqrt(sum(x * x for x in q.values()))
        best = max(sum(q.get(g, 0) * w for g, w in v.items()) / z for v in vec.values())
        got = canonical.match_values(spark.createDataFrame([(value,)], "value string"), names, 0.0, 0.0).first()["score"]
        assert got == pytest.approx(best)


def test_survivor_takes_the_best_bundle(spark):
    t = lambda d: dt.datetime(2026, 3, d)
    d = lambda x: dt.date(2026, 3, x)
    jobs = spark.createDataFrame(
        [
            (1, "★月港食府有限公司★急聘中", "1€", d(9), t(5), "Madrid", None),
            (2, "月港食府", "1200到1350", d(1), t(4), "Madrid", None),
            (3, "月港食府有限公司", "9999999€", d(6), t(7), None, None),
            (4, None, "1.300 a 1.450 euros", None, t(6), "Madrid", "Centro"),
            (9, "别家", "1000€", d(1), t(1), None, None),
            (20, None, None, None, t(1), None, None),
            (21, None, "面议", d(30), t(1), None, None),
        ],
        "id long, company string, salary_raw string, publish_date date, collected_at timestamp_ntz, city string, district string",
    )
    q = spark.createDataFrame([(1, 2, "merge"), (3, 2, "merge"), (2, 1, "merge"), (4, 3, "merge"), (9, 1, "keep"), (9, None, "merge"), (20, 21, "merge"), (50, 51, "merge")], "job_id long, candidate_id long, resolution string")
    got = {(r["group_id"], r["field_name"]): r["job_id"] for r in survivor.surviving_fields(jobs, q).collect()}
    assert got == {(1, "company"): 3, (1, "salary_raw"): 4, (1, "publish_date"): 3}
    assert survivor.surviving_fields(jobs.limit(0), q.limit(0)).count() == 0


def test_search_equals_trying_everything():
    r = random.Random(4)
    for _ in range(60):
        demand = lambda: {0: r.choice("xy")} if r.random() < 0.8 else {}
        opts = [[(r.randrange(1, 50), demand(), {}) for _ in range(r.randrange(0, 5))], [(r.randrange(1, 50), {}, demand()) for _ in range(r.randrange(0, 5))], [(r.randrange(1, 50), {}, {}) for _ in range(r.randrange(0, 3))]]

        def total(pick):
            wants, offers = (opts[0][pick[0]][1] if pick[0] >= 0 else {}), (opts[1][pick[1]][2] if pick[1] >= 0 else {})
            if 0 in wants and 0 in offers and wants[0] != offers[0]:
                return -1
            return sum(opts[k][i][0] for k, i in enumerate(pick) if i >= 0)

        best = max(total(p) for p in itertools.product(*[range(-1, len(o)) for o in opts]))
        assert total(survivor._search(opts)) == best


def test_dependency_between_bundles_overrules_the_most_trusted_option(spark):
    """Shop A's rows lie in Vigo; the most trusted place, Lugo, belongs to shop B, so the two tops cannot survive together."""
    rows = [(1, 1, "A", "Vigo", 5.0, 1.0), (1, 2, "A", "Vigo", 5.0, 2.0), (1, 3, "B", "Lugo", 4.0, 9.0), (2, 4, "C", None, 1.0, None), (2, 5, None, "Lugo", None, 1.0)]
    df = spark.createDataFrame(rows, "group_id long, id long, shop string, town string, ts double, tt double").withColumn("values", F.lit("clash"))
    bundles = [survivor.Bundle("shop", ("shop",), F.col("ts")), survivor.Bundle("town", ("town",), F.col("tt"))]
    rule = [survivor.Dependency(("shop", "shop"), ("town", "town"))]
    got = lambda rules: {(r["group_id"], r["bundle"]): r["job_id"] for r in survivor.choose(df, bundles, rules).collect()}
    free = {(1, "shop"): 1, (1, "town"): 3, (2, "shop"): 4, (2, "town"): 5}
    assert got([]) == free
    assert got(rule) == {**free, (1, "shop"): 3}  # 4 + 9 beats 5 + 2
    inside = [survivor.Bundle("place", ("town", "shop"), F.col("tt"))]
    odd = df.unionByName(spark.createDataFrame([(1, 9, "A", "Lugo", 0.0, 99.0)], "group_id long, id long, shop string, town string, ts double, tt double").withColumn("values", F.lit("x")))
    within = survivor.choose(odd, inside, [survivor.Dependency(("place", "shop"), ("place", "town"))])
    assert {(r["group_id"], r["job_id"]) for r in within.collect()} == {(1, 3), (2, 5)}  # row 9 breaks shop A -> Vigo


def test_forms_read_the_same(spark):
    rows = [
        (1, "Se busca cocinero en Málaga."),
        (2, "Ｓe busca cocinerо en Málaga."),
        (3, "Se busca co­cinero en Málaga."),
        (4, "Se busca cocinera en Málaga."),
        (5, "Se busca cocinero en Malaga."),
        (6, "工人 ﬁn"),
        (7, "⼯⼈ fin"),
        (8, "👩‍🍳 aquí"),
        (9, "👩🍳 aquí"),
        (10, ""),
        (11, None),
        (12, "Se busca cocinero en Málaga."),
        (13, "ṇ̃"),
        (14, "ṇ̃"),
        (15, "a​b"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("clash"))
    forms = {r["doc_id"]: r["form"] for r in lookalike.canonical_form(docs).collect()}
    assert forms[2] == forms[1] == forms[3] == "Se busca cocinero en Málaga." and forms[13] == forms[14] and forms[15] == "ab"
    assert forms[10] == "" and forms[11] is None and forms[8] != forms[9]
    for f in forms.values():
        if f:
            assert unicodedata.normalize("NFC", f) == f
    pairs = {(r[0], r[1]) for r in lookalike.same_to_the_eye(docs).collect()}
    assert pairs == {(1, 2), (1, 3), (2, 3), (2, 12), (3, 12), (6, 7), (13, 14)}
    assert lookalike.same_to_the_eye(docs.limit(0)).count() == 0


def test_scripts_of_their_own_and_composed_letters(spark):
    """Hangul and its letters agree, three marks compose, a Russian word stays Russian, a Latin one is made Latin."""
    rows = [(1, "\uac00\uac01"), (2, "\u1100\u1161\u1100\u1161\u11a8"), (3, "\u1f87"), (4, "\u03b1\u0345\u0314\u0301"), (5, "\u1f85"), (6, "сосна"), (7, "cocnа"), (8, "с\u00adосна\u200b"), (9, "mоrа"), (10, "mora")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    form = {r["doc_id"]: r["form"] for r in lookalike.canonical_form(df).collect()}
    assert form[1] == form[2] == "\uac00\uac01"
    assert form[4] == form[5] == "\u1f85" != form[3]
    assert form[6] == form[8] == "сосна" != form[7] and form[9] == form[10] == "mora"
    got = {(r["doc_id"], r["class_id"], r["texts"]) for r in lookalike.variant_classes(df.unionByName(df.where("doc_id = 1").withColumn("doc_id", F.lit(11).cast("long")))).collect()}
    assert got == {(1, 1, 2), (2, 1, 2), (11, 1, 2), (4, 4, 2), (5, 4, 2), (6, 6, 2), (8, 6, 2), (9, 9, 2), (10, 9, 2)}


def test_form_of_a_form_is_itself(spark):
    r = random.Random(9)
    chars = "aeiоcр 　 áñ́̃ﬁ①㎞中⼈ｱ，,\n"
    docs = spark.createDataFrame([(i, "".join(r.choice(chars) for _ in range(40))) for i in range(40)] + [(99, "a" * 30_000 + "́")], "doc_id long, text string")
    once = lookalike.canonical_form(docs).select("doc_id", F.col("form").alias("text"))
    again = lookalike.canonical_form(once)
    assert again.where("text <> form").count() == 0 and again.count() == 41


def test_split_meets_every_quota():
    rng = np.random.default_rng(3)
    counts = np.array([1000, 13, 0, 250])
    t = mixing.split(counts, 7, rng)
    assert (t.sum(axis=0) == counts).all() and t.shape == (7, 4) and t.min() >= 0
    assert t.sum(axis=1).max() - t.sum(axis=1).min() <= 3


def test_mix_meets_shares_and_caps(spark):
    r = random.Random(2)
    rows = [(i, "palabra " * r.randrange(5, 60), "abc"[min(2, i % 7)]) for i in range(900)] + [(1000, None, "a"), (1001, "", "a"), (1002, "x", None), (1003, "otro", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_tokens", F.lit(0)).withColumn("shard", F.lit("clash"))
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.3, 2), ("c", 0.2, 1), ("none", 0.0, 1), ("gone", 0.1, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mix(docs, targets, shards=5, blocks=16)
    s = {x["source"]: x for x in mixing.actual_shares(m, targets).collect()}
    for k, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert s[k]["actual_share"] == pytest.approx(share, abs=0.01)
    assert s["gone"]["actual_share"] == 0 and s["a"]["most_uses"] <= 3 and s["b"]["most_uses"] <= 2 and s["c"]["most_uses"] <= 1
    assert m.groupBy("doc_id", "copy_no").count().where("count > 1").count() == 0
    # blocks taken in part are cut again until they are small: the shares stay exact to within a document
    deep = mixing.mix(docs, targets, shards=3, blocks=4, small=100)
    d = {x["source"]: x for x in mixing.actual_shares(deep, targets).collect()}
    assert all(d[k]["actual_share"] == pytest.approx(share, abs=0.01) for k, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    assert deep.groupBy("doc_id", "copy_no").count().where("count > 1").count() == 0 and d["c"]["most_uses"] <= 1
    assert mixing.mix(docs.limit(0), targets).count() == 0
