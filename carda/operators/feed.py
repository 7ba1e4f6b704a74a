"""Feed, facets, search, related items and lists over posts and their dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carda.functions.text import like_any_case
from carda.functions.times import day_bucket, midnight_madrid_utc


def with_dimensions(posts: DataFrame, regions: DataFrame, categories: DataFrame) -> DataFrame:
    """Posts with region and category names and the top region; both dimensions are fixed small lists, left to AQE."""
    r = regions.select(F.col("id").alias("region_id"), F.col("name").alias("region_name"), "parent_id", F.coalesce(F.nullif("parent_id", F.lit(0)), F.col("id")).alias("top_id"))
    c = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return posts.join(r, "region_id").join(c, "category_id")


def housekeeping(posts: DataFrame, as_of: Column, expire_days: int = 30) -> DataFrame:
    """Pins past their end are dropped and online posts past their age expire, as projections."""
    unpin = (F.col("is_top") == 1) & (F.col("top_expire_at").isNull() | (F.col("top_expire_at") < as_of))
    expire = (F.col("status") == 1) & (F.col("created_at") < as_of - F.make_dt_interval(F.lit(expire_days)))
    return posts.withColumns({"is_top": F.when(unpin, 0).otherwise(F.col("is_top")), "status": F.when(expire, 0).otherwise(F.col("status"))})


def matching(posts: DataFrame, type: int | None = None, region: int | None = None, category: int | None = None, text: str | None = None) -> DataFrame:  # noqa: A002
    """Conjunction of the given filters; an absent one is no predicate. A region also matches its districts."""
    if type is not None:
        posts = posts.where(F.col("type") == type)
    if region is not None:
        posts = posts.where((F.col("region_id") == region) | (F.col("parent_id") == region))
    if category is not None:
        posts = posts.where(F.col("category_id") == category)
    if text:
        posts = posts.where(like_any_case(F.col("content"), text) | like_any_case(F.col("contact_name"), text))
    return posts


def feed(posts: DataFrame, regions: DataFrame, categories: DataFrame, as_of: Column, type: int, limit: int = 60, guaranteed: int = 30, **filters) -> DataFrame:  # noqa: A002
    """Online posts, pinned first, then newest; unfiltered feeds short of ``guaranteed`` are filled with expired posts."""
    shown = matching(with_dimensions(housekeeping(posts, as_of), regions, categories), type=type, **filters)
    online = shown.where("status = 1").orderBy(F.desc("is_top"), F.desc("bumped_at"), F.desc("id")).limit(limit)
    out = online.withColumn("part", F.lit(0))
    if not any(v for v in filters.values()):
        n = online.agg(F.count("*").alias("n_online"))  # one row
        spare = shown.where("status = 0").orderBy(F.desc("bumped_at"), F.desc("id")).limit(min(guaranteed, limit))
        spare = spare.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("bumped_at"), F.desc("id"))))  # at most `guaranteed` rows
        spare = spare.join(F.broadcast(n)).where((F.col("n_online") < guaranteed) & (F.col("rn") <= F.least(F.lit(guaranteed), F.lit(limit)) - F.col("n_online"))).drop("rn", "n_online")
        out = out.unionByName(spare.withColumn("part", F.lit(1)))
    return out.withColumn("bucket", day_bucket(F.col("bumped_at"), as_of))


def facet_types(posts: DataFrame) -> DataFrame:
    return posts.where("status = 1").groupBy("type").agg(F.count("*").alias("n"))


def facet_regions(posts: DataFrame, regions: DataFrame, type: int) -> DataFrame:  # noqa: A002
    """Online posts per top region, districts rolled up into their city."""
    top = regions.select(F.col("id").alias("region_id"), F.coalesce(F.nullif("parent_id", F.lit(0)), F.col("id")).alias("top_id"))
    return posts.where((F.col("status") == 1) & (F.col("type") == type)).groupBy("region_id").agg(F.count("*").alias("n")).join(top, "region_id").groupBy("top_id").agg(F.sum("n").alias("n"))


def facet_categories(posts: DataFrame, categories: DataFrame, type: int | None = None) -> DataFrame:  # noqa: A002
    """Online posts of every category, those without any with 0."""
    n = matching(posts.where("status = 1"), type=type).groupBy("category_id").agg(F.count("*").alias("n"))
    return categories.select(F.col("id").alias("category_id"), "sort").join(n, "category_id", "left").select("category_id", "sort", F.coalesce("n", F.lit(0)).alias("n"))


def new_today(posts: DataFrame, as_of: Column) -> DataFrame:
    return posts.where((F.col("status") == 1) & (F.col("created_at") >= midnight_madrid_utc(as_of)) & (F.col("created_at") <= as_of)).groupBy("type").agg(F.count("*").alias("n"))


def related(posts: DataFrame, regions: DataFrame, categories: DataFrame, k: int = 3) -> DataFrame:
    """(id, rank, related_id): of every online post the k newest other online ones of its type, category and top region.

    The k + 1 newest of a group hold the answer for each of its posts, so a group is cut before it is joined.
    """
    keys = ["type", "category_id", "top_id"]
    x = with_dimensions(posts, regions, categories).where("status = 1").select("id", *keys, "bumped_at")
    w = Window.partitionBy(*keys).orderBy(F.desc("bumped_at"), F.desc("id"))
    newest = x.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k + 1).select(*keys, F.col("id").alias("related_id"), "rn")
    pairs = x.select("id", *keys).join(newest, keys).where("id <> related_id")
    out = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("rn"))).where(F.col("rank") <= k)
    return out.select("id", "rank", "related_id")


def page(posts: DataFrame, number: int, size: int = 50) -> DataFrame:
    """One page of the newest posts by id."""
    return posts.orderBy(F.desc("id")).offset((number - 1) * size).limit(size)


def region_tree(regions: DataFrame) -> DataFrame:
    """(city_id, districts): the district names of each city in their order."""
    d = regions.where("parent_id <> 0").groupBy(F.col("parent_id").alias("city_id")).agg(F.array_sort(F.collect_list(F.struct("sort", "id", "name"))).alias("x"))
    return d.select("city_id", F.array_join(F.transform("x", lambda v: v["name"]), ",").alias("districts"))


def admin_posts(posts: DataFrame, type: int | None = None, status: int | None = None, suspicious: bool = False, text: str | None = None, columns: tuple[str, ...] = ("content", "contact_name", "phone")) -> DataFrame:  # noqa: A002
    """Posts by any of type, status, suspicion and a text in one of several columns; an absent filter is no predicate."""
    if type is not None:
        posts = posts.where(F.col("type") == type)
    if status is not None:
        posts = posts.where(F.col("status") == status)
    if suspicious:
        posts = posts.where("suspicious = 1")
    if text:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(like_any_case(F.col(c), text), F.lit(False))
        posts = posts.where(hit)
    return posts


def shown_facets(facets: DataFrame, key: str, n: str = "n", selected: object = None) -> DataFrame:
    """Facets that have posts, and the selected one."""
    return facets.where((F.col(n) > 0) | (F.col(key) == F.lit(selected) if selected is not None else F.lit(False)))


def post_by_code(posts: DataFrame, codes: DataFrame, regions: DataFrame, categories: DataFrame) -> DataFrame:
    """Visible posts of the given public codes with their dimensions' names."""
    hit = posts.where("status in (0, 1)").join(codes.select("public_code").distinct(), "public_code", "left_semi")
    return with_dimensions(hit, regions, categories)
