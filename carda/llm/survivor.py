"""One surviving record per group of duplicates, chosen bundle by bundle.

Fields that depend on each other form a bundle and are taken together from one record. Every candidate bundle has a
trust; branch-and-bound over the bundles maximises the total under functional dependencies between fields, inside a
bundle or between two. What a determinant value implies is stated by the group's own members: the dependent value most
of the rows holding it carry. In Spark each candidate learns what it demands of others and what it offers them, and of
candidates that demand and offer the same only the best stays, so a group of any size reaches the search as few rows.

Defined cases: null or unusable values are no candidates; a bundle without candidates gives no row, and one whose
candidates all break a dependency of more trusted ones is left out; ties in trust go to the later ``tie`` value, then
the lowest id; what ties in frequency is implied by its lowest value; repeated rows count once as candidates; a group
whose members are all missing gives no row; empty inputs give empty results.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carda.operators.graph import connected_components


@dataclass(frozen=True)
class Bundle:
    """Fields taken together; ``trust`` is a column, null where the record's bundle may not survive."""

    name: str
    fields: tuple[str, ...]
    trust: Column = field(hash=False, compare=False)


@dataclass(frozen=True)
class Dependency:
    """``determinant`` -> ``dependent``: the survivor's dependent value is the one its determinant implies in the group."""

    determinant: tuple[str, str]  # (bundle, field)
    dependent: tuple[str, str]


#: One candidate of a bundle: its trust, what it demands by rule number, and what it offers.
Option = tuple[float, dict[int, str], dict[int, str]]


def _search(options: list[list[Option]]) -> list[int]:
    """Branch-and-bound: per bundle the index of the chosen option, or -1 where leaving it out gives the best total."""
    order = sorted(range(len(options)), key=lambda k: len(options[k]))
    best_left = [0.0] * (len(order) + 1)
    for d in range(len(order) - 1, -1, -1):
        best_left[d] = best_left[d + 1] + max((o[0] for o in options[order[d]]), default=0.0)
    best: tuple[float, list[int]] = (-1.0, [-1] * len(options))
    pick = [-1] * len(options)
    demanded: dict[int, str] = {}
    offered: dict[int, str] = {}

    def clash(wants: dict[int, str], there: dict[int, str]) -> bool:
        return any(there.get(r, v) != v for r, v in wants.items())

    def go(d: int, total: float) -> None:
        nonlocal best
        if total + best_left[d] <= best[0]:
            return
        if d == len(order):
            best = (total, pick.copy())
            return
        k = order[d]
        for i, (trust, demands, offers) in enumerate(options[k]):
            if clash(demands, offered) or clash(offers, demanded):
                continue
            pick[k] = i
            demanded.update(demands)
            offered.update(offers)
            go(d + 1, total + trust)
            for r in demands:  # a rule has one determinant bundle and one dependent bundle
                del demanded[r]
            for r in offers:
                del offered[r]
        pick[k] = -1
        go(d + 1, total)

    go(0, 0.0)
    return best[1]


def implied(members: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """(group_id, determinant, implied): the dependent value most rows of the group with that determinant carry."""
    held = members.where(F.col(determinant).isNotNull() & F.col(dependent).isNotNull())
    n = held.groupBy("group_id", determinant, F.col(dependent).cast("string").alias("y")).agg(F.count("*").alias("n"))
    return n.groupBy("group_id", determinant).agg(F.min(F.struct((-F.col("n")).alias("n"), "y"))["y"].alias("implied"))


def choose(members: DataFrame, bundles: list[Bundle], rules: list[Dependency] = [], tie: str | None = None) -> DataFrame:  # noqa: B006
    """(group_id, id, fields...) -> (group_id, bundle, values, job_id): the surviving bundles.

    ``job_id`` is the lowest id of the group that holds exactly the chosen values. Trusts below 1e12 stay exact.
    """
    tie_col = F.col(tie) if tie else F.lit(0)
    for r, rule in enumerate(rules):
        det = rule.determinant[1]
        table = implied(members, det, rule.dependent[1]).select(F.col("group_id").alias("_g"), F.col(det).alias("_x"), F.col("implied").alias(f"_implied{r}"))
        members = members.join(table, (F.col("group_id") == F.col("_g")) & (F.col(det) == F.col("_x")), "left").drop("_g", "_x")
    stacked = None
    for b in bundles:
        value = F.struct(*[F.col(f).cast("string").alias(f) for f in b.fields])
        trust, wants, offers = b.trust.cast("double"), [], []
        for r, rule in enumerate(rules):
            want, have = F.col(f"_implied{r}"), F.col(rule.dependent[1]).cast("string")
            if rule.determinant[0] == rule.dependent[0]:
                if rule.determinant[0] == b.name:  # a bundle that breaks its own rule is no candidate
                    trust = F.when(want.isNull() | have.isNull() | (want == have), trust)
                continue
            if rule.determinant[0] == b.name:
                wants.append(want.alias(str(r)))
            if rule.dependent[0] == b.name:
                offers.append(have.alias(str(r)))
        as_json = lambda cols: F.to_json(F.struct(*cols)) if cols else F.lit("{}")
        one = members.select("group_id", "id", F.lit(b.name).alias("bundle"), F.to_json(value).alias("values"), trust.alias("trust"), tie_col.alias("tie"), as_json(wants).alias("wants"), as_json(offers).alias("offers"))
        stacked = one if stacked is None else stacked.unionByName(one)
    held = (
        stacked.where("trust is not null")
        .groupBy("group_id", "bundle", "values", "wants", "offers")
        .agg(F.max(F.struct("trust", "tie")).alias("best"), F.min("id").alias("job_id"))
    )
    # of candidates that demand and offer the same only the best can be part of an optimum
    kept = held.groupBy("group_id", "bundle", "wants", "offers").agg(F.max(F.struct("best", (-F.col("job_id")).alias("neg"), "values", "job_id")).alias("x"))
    options = kept.groupBy("group_id").agg(
        F.collect_list(F.struct("bundle", F.col("x.values").alias("values"), F.col("x.job_id").alias("job_id"), F.col("x.best.trust").alias("trust"), "wants", "offers", F.col("x.best.tie").alias("tie"))).alias("options")
    )
    ordered = F.reverse(F.array_sort(F.transform("options", lambda o: F.struct(o["trust"].alias("trust"), o["tie"].alias("tie"), (-o["job_id"]).alias("neg"), o["bundle"].alias("bundle"), o["values"].alias("values"), o["job_id"].alias("job_id"), o["wants"].alias("wants"), o["offers"].alias("offers")))))
    plain = F.transform(ordered, lambda o: F.struct(o["trust"].alias("trust"), o["bundle"].alias("bundle"), o["values"].alias("values"), o["job_id"].alias("job_id"), o["wants"].alias("wants"), o["offers"].alias("offers")))
    names = [b.name for b in bundles]

    @F.pandas_udf("array<struct<bundle:string,values:string,job_id:bigint>>")
    def solve(groups: pd.Series) -> pd.Series:
        out = []
        terms = lambda s: {int(r): v for r, v in json.loads(s).items()} if s != "{}" else {}
        for rows in groups:
            per = [[r for r in rows if r["bundle"] == n] for n in names]
            opts = [[(r["trust"], terms(r["wants"]), terms(r["offers"])) for r in p] for p in per]
            out.append([{"bundle": names[k], "values": per[k][i]["values"], "job_id": per[k][i]["job_id"]} for k, i in enumerate(_search(opts)) if i >= 0])
        return pd.Series(out)

    return options.select("group_id", F.explode(solve(plain)).alias("x")).select("group_id", "x.bundle", "x.values", "x.job_id")


# What people write where they name no shop.
PLACEHOLDERS = ("N/A", "保密", "某店", "empresa del sector", ".", "-", "sin nombre", "个人", "")
_BRAND = r"(?:[\p{L}/'·-]+ ){0,2}"


def company_trust(c: Column) -> Column:
    """Trust of a shop name: 3 full legal name, 2 whole short name, 1 decorated or cut; longer ones first within a class."""
    legal = c.rlike(r"^[^★>（<]*(?:\p{IsHan}{2,}(?:有限公司| (?:\p{L}+ ){1,2}S\.L\.))$")
    short = c.rlike(r"^(?:\p{L}+ ){0,2}\p{IsHan}{2,}$") & ~c.rlike(r"(?:有|有限|有限公)$")
    kind = F.when(legal, 3).when(short, 2).otherwise(1)
    return F.when(c.isNotNull() & ~F.btrim(c).isin(*PLACEHOLDERS), kind * 1000 + F.least(F.length(c), F.lit(900)))


def stated_amount(c: Column) -> Column:
    """The largest number in a pay text, thousands dots removed; null without digits."""
    plain = F.regexp_replace(c, r"(?<=\d)[.](?=\d{3}(?!\d))", "")
    return F.array_max(F.transform(F.regexp_extract_all(plain, F.lit(r"(\d{1,15})"), 1), lambda x: x.cast("double")))


def salary_trust(c: Column, when: Column, low: float = 300.0, high: float = 20000.0) -> Column:
    """Later collections first among pay texts whose amount is believable."""
    return F.when(stated_amount(c).between(low, high), F.unix_micros(when.cast("timestamp")).cast("double") / 1e6)


def date_trust(d: Column, when: Column) -> Column:
    """Later dates first among those not after their own row's collection."""
    return F.when(d <= when.cast("date"), F.datediff(d, F.lit("0001-01-01").cast("date")).cast("double"))


def merged_groups(jobs: DataFrame, queue: DataFrame) -> DataFrame:
    """Jobs with ``group_id``: rows joined, directly or through others, by reviews resolved as ``merge``."""
    edges = queue.where((F.col("resolution") == "merge") & F.col("candidate_id").isNotNull()).select(F.col("job_id").alias("a"), F.col("candidate_id").alias("b"))
    parts = connected_components(edges)
    present = parts.join(jobs.select(F.col("id").alias("node"), "company", "salary_raw", "publish_date", "collected_at", "city", "district"), "node")
    return present.select(F.col("component").alias("group_id"), F.col("node").alias("id"), "company", "salary_raw", "publish_date", "collected_at", "city", "district")


def surviving_bundles(jobs: DataFrame, queue: DataFrame) -> DataFrame:
    """(group_id, bundle, values, job_id): the surviving company, pay, date and place of every merged group.

    The place must be the city its company's rows name, and its district must lie in the city most rows name with it;
    where they conflict the search gives up the less trusted one. A place is worth less than a step in any other trust.
    """
    members = merged_groups(jobs, queue)
    named = F.nullif(F.btrim("city"), F.lit("")).isNotNull()
    bundles = [
        Bundle("company", ("company",), company_trust(F.col("company"))),
        Bundle("salary_raw", ("salary_raw",), salary_trust(F.col("salary_raw"), F.col("collected_at"))),
        Bundle("publish_date", ("publish_date",), date_trust(F.col("publish_date"), F.col("collected_at"))),
        Bundle("place", ("city", "district"), F.when(named, F.lit(0.5) + 0.25 * F.col("district").isNotNull().cast("int"))),
    ]
    rules = [Dependency(("place", "district"), ("place", "city")), Dependency(("company", "company"), ("place", "city"))]
    return choose(members.withColumn("seen", F.struct("collected_at", "id")), bundles, rules, tie="seen")


def surviving_fields(jobs: DataFrame, queue: DataFrame) -> DataFrame:
    """(group_id, field_name, job_id) for company, salary_raw and publish_date of every merged group."""
    best = surviving_bundles(jobs, queue)
    return best.where(F.col("bundle") != "place").select("group_id", F.col("bundle").alias("field_name"), "job_id")
