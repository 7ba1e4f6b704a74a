"""Free-entered values mapped to a reference list.

Distinct values are normalised once, their character n-grams probe an inverted index of the reference forms, and
the best entry by idf-weighted cosine is accepted above a threshold and a margin to the runner-up.

Defined cases: null values give no row; empty, blank or unmatched values give ``name`` null (``ref_id`` 0 in
:func:`map_jobs`); repeated values are scored once; an empty table gives an empty result; equal scores of two
different entries fail the margin and count as unmatched; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carda.functions.chars import fold_py, fold_text
from carda.session import cut, fixed_rows, sized_broadcast

# Homophone slips of transliterated names, wrong character to right one.
HOMOPHONES = ("啦而吧娃雅得洛圆议咯", "拉尔巴瓦亚德罗园译客")
# Words around a name that say nothing about which entry is meant.
NOISE = (
    r"\b(?:capital|provincia|espana|y alrededores|ciudad|barrio|zona|otros puestos|empleo|varios)\b|bº"
    r"|(?<=..)(?:市区|市|省|地区|区|附近|一带|类|行业|业|岗位)$"
)
#: Weights of single characters (Latin, other), bigrams, skip-bigrams and trigrams.
W_LATIN, W_OTHER, W_BI, W_SKIP, W_TRI = 0.5, 1.0, 1.0, 0.6, 0.7


def _grams_py(s: str) -> Counter:
    g: Counter = Counter()
    p = f"^{s}$"
    for ch in s:
        g[ch] += W_LATIN if ch.isascii() else W_OTHER
    for i in range(len(p) - 1):
        g[p[i : i + 2]] += W_BI
    for i in range(len(p) - 2):
        g[p[i] + "_" + p[i + 2]] += W_SKIP
        g[p[i : i + 3]] += W_TRI
    return g


def _norm_py(s: str) -> str:
    return re.sub(r"[^\w]|_", "", fold_py(s).translate(str.maketrans(*HOMOPHONES)))


def _forms(name: str) -> set[str]:
    """An entry's name and its halves before and after the first space."""
    a, _, b = name.partition(" ")
    return {x for x in (name, a, b) if x}


def reference_index(names: list[str]) -> tuple[list[tuple[str, str, str, float]], list[tuple[str, float]], float]:
    """Rows (name, form, gram, unit weight), rows (gram, idf) and the idf of a gram no form has."""
    forms = sorted({(n, _norm_py(f)) for n in names if n for f in _forms(n)})
    forms = [(n, f) for n, f in forms if f]
    df = Counter(g for _, f in forms for g in _grams_py(f))
    idf = {g: math.log(1 + len(forms) / (n + 0.5)) for g, n in df.items()}
    rows = []
    for n, f in forms:
        v = {g: c * idf[g] for g, c in _grams_py(f).items()}
        z = math.sqrt(sum(x * x for x in v.values()))
        rows += [(n, f, g, x / z) for g, x in v.items()]
    return rows, sorted(idf.items()), math.log(1 + len(forms) / 0.5)


def _value_variants(value: Column) -> Column:
    folded = F.btrim(F.translate(fold_text(value), *HOMOPHONES), F.lit(" .\t"))
    stripped = F.btrim(F.regexp_replace(folded, NOISE, ""), F.lit(" ,.-()"))
    clean = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]", "")
    return F.array_distinct(F.filter(F.array(clean(folded), clean(stripped)), lambda x: x != ""))


def _gram_array(s: Column) -> Column:
    """Grams of a normalised value with their weights, built natively."""
    n = F.length(s)
    p = F.concat(F.lit("^"), s, F.lit("$"))
    one = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substring(s, i, F.lit(1)).alias("g"), F.when(F.substring(s, i, F.lit(1)).rlike(r"^[\x00-\x7f]$"), W_LATIN).otherwise(W_OTHER).alias("w")))
    two = F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.struct(F.substring(p, i, F.lit(2)).alias("g"), F.lit(W_BI).alias("w")))
    skip = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.concat(F.substring(p, i, F.lit(1)), F.lit("_"), F.substring(p, i + 2, F.lit(1))).alias("g"), F.lit(W_SKIP).alias("w")))
    tri = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substring(p, i, F.lit(3)).alias("g"), F.lit(W_TRI).alias("w")))
    return F.concat(one, two, skip, tri)


def match_values(values: DataFrame, names: list[str], threshold: float = 0.25, margin: float = 0.05) -> DataFrame:
    """(value) -> (value, name, score): one row per distinct non-null value; name is null where none is accepted."""
    spark = values.sparkSession
    index, idf, unseen = reference_index(names)
    distinct = values.select("value").where(F.col("value").isNotNull()).groupBy("value").agg(F.lit(1).alias("_one")).drop("_one")
    if not index:
        return distinct.select("value", F.lit(None).cast("string").alias("name"), F.lit(0.0).alias("score"))
    # about thirty rows a form: a long reference list is joined by shuffling
    index_df = sized_broadcast(fixed_rows(spark, index, "name string, form string, gram string, rw double"), len(index))
    idf_df = sized_broadcast(fixed_rows(spark, idf, "gram string, idf double"), len(idf))
    grams = (
        distinct.select("value", F.explode(_value_variants(F.col("value"))).alias("variant"))
        .select("value", "variant", F.explode(_gram_array(F.col("variant"))).alias("x"))
        .groupBy("value", "variant", F.col("x.g").alias("gram"))
        .agg(F.sum("x.w").alias("tf"))
        .join(idf_df, "gram", "left")
        .select("value", "variant", "gram", (F.col("tf") * F.coalesce("idf", F.lit(unseen))).alias("w"))
    )
    norms = grams.groupBy("value", "variant").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("z"))
    dots = grams.join(index_df, "gram").groupBy("value", "variant", "name", "form").agg(F.sum(F.col("w") * F.col("rw")).alias("dot"))
    by_name = dots.join(norms, ["value", "variant"]).groupBy("value", "name").agg(F.max(F.col("dot") / F.col("z")).alias("score"))
    ranked = by_name.groupBy("value").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "name")), asc=False), 1, 2).alias("top"))
    runner = F.coalesce(F.try_element_at("top", F.lit(2))["score"], F.lit(0.0))
    best = ranked.select(
        "value",
        F.when((F.col("top")[0]["score"] >= threshold) & (F.col("top")[0]["score"] - runner >= margin), F.col("top")[0]["name"]).alias("name"),
        F.col("top")[0]["score"].alias("score"),
    )
    return distinct.join(best, "value", "left").select("value", "name", F.coalesce("score", F.lit(0.0)).alias("score"))


def map_jobs(jobs: DataFrame, regions: DataFrame, categories: DataFrame, threshold: float = 0.25, margin: float = 0.05) -> DataFrame:
    """(job_id, field_name, value, ref_id) for every non-null city, district and category of ``jobs``.

    A district name several cities have is the entry under the row's mapped city, or 0 where that city has none.
    """
    spark = jobs.sparkSession
    reg = [tuple(r) for r in regions.select("id", "parent_id", "name", "level").collect()]  # fixed reference list
    cat = [tuple(r) for r in categories.select("id", "name").collect()]  # fixed reference list
    lists = {
        "city": [n for _, _, n, lv in reg if lv == 1],
        "district": [n for _, _, n, lv in reg if lv == 2],
        "category": [n for _, n in cat],
    }
    rows = jobs.select(F.col("id").alias("job_id"), "city", "district", "category")
    # one pass over the table gives the distinct values of all three fields
    cells = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in lists])).alias("c"))
    distinct = cut(cells.select("c.*").where(F.col("value").isNotNull()).distinct())
    matched = None
    for f, names in lists.items():
        m = match_values(distinct.where(F.col("field_name") == f).select("value"), sorted(set(names)), threshold, margin).withColumn("field_name", F.lit(f))
        matched = m if matched is None else matched.unionByName(m)
    matched = cut(matched.select("field_name", "value", "name"))
    n = matched.count()
    found = {f: sized_broadcast(matched.where(F.col("field_name") == f).select(F.col("value").alias(f), F.col("name").alias(f"{f}_name")), n) for f in lists}
    wide = rows
    for f in lists:
        wide = wide.join(found[f], f, "left")
    city_ids = F.broadcast(fixed_rows(spark, [(n, i) for i, n in _lowest((n, i) for i, _, n, lv in reg if lv == 1)], "city_name string, city_id int"))
    cat_ids = F.broadcast(fixed_rows(spark, [(n, i) for i, n in _lowest((n, i) for i, n in cat)], "category_name string, category_id int"))
    count = Counter(n for _, _, n, lv in reg if lv == 2)
    single = F.broadcast(fixed_rows(spark, [(n, i) for i, _, n, lv in reg if lv == 2 and count[n] == 1], "district_name string, only_id int"))
    under = F.broadcast(fixed_rows(spark, [(n, p, i) for i, n, p in _lowest_under((n, p, i) for i, p, n, lv in reg if lv == 2 and count[n] > 1)], "district_name string, city_id int, under_id int"))
    wide = wide.join(city_ids, "city_name", "left").join(cat_ids, "category_name", "left").join(single, "district_name", "left").join(under, ["district_name", "city_id"], "left")
    out = wide.select(
        "job_id",
        F.explode(
            F.array(
                F.struct(F.lit("city").alias("field_name"), F.col("city").alias("value"), F.col("city_id").alias("ref_id")),
                F.struct(F.lit("district").alias("field_name"), F.col("district").alias("value"), F.coalesce("only_id", "under_id").alias("ref_id")),
                F.struct(F.lit("category").alias("field_name"), F.col("category").alias("value"), F.col("category_id").alias("ref_id")),
            )
        ).alias("x"),
    )
    return out.select("job_id", "x.field_name", "x.value", F.coalesce("x.ref_id", F.lit(0)).alias("ref_id")).where(F.col("value").isNotNull())


def _lowest(pairs) -> list[tuple[int, str]]:
    best: dict[str, int] = {}
    for n, i in pairs:
        best[n] = min(i, best.get(n, i))
    return [(i, n) for n, i in best.items()]


def _lowest_under(triples) -> list[tuple[int, str, int]]:
    best: dict[tuple[str, int], int] = {}
    for n, p, i in triples:
        best[n, p] = min(i, best.get((n, p), i))
    return [(i, n, p) for (n, p), i in best.items()]


def typed_differently(mapped: DataFrame, regions: DataFrame, categories: DataFrame) -> DataFrame:
    """The rows of :func:`map_jobs` whose value is not byte for byte a listed name or one of its halves."""
    spark = mapped.sparkSession
    exact = {("city", f) for r in regions.where("level = 1").collect() for f in _forms(r["name"])}
    exact |= {("district", f) for r in regions.where("level = 2").collect() for f in _forms(r["name"])}
    exact |= {("category", f) for r in categories.collect() for f in _forms(r["name"])}
    known = F.broadcast(fixed_rows(spark, sorted(exact), "field_name string, value string"))
    return mapped.join(known, ["field_name", "value"], "left_anti").select("job_id", "field_name", "ref_id")
