"""Counts and rates for dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carda.functions.codes import dup_rate
from carda.functions.times import midnight_madrid_utc


def site_kpis(posts: DataFrame, as_of: Column) -> DataFrame:
    """One row of conditional counts in one pass over posts."""
    today = midnight_madrid_utc(as_of)
    return posts.agg(
        F.count("*").alias("posts"),
        F.count_if(F.col("status") == 1).alias("online"),
        F.count_if(F.col("created_at") >= today).alias("today"),
        F.count_if(F.col("suspicious") == 1).alias("suspicious"),
        F.count_if(F.col("report_count") > 0).alias("reported"),
        F.sum(F.col("phone_views") + F.col("wechat_views")).alias("views"),
    )


def pipeline_kpis(jobs: DataFrame, queue: DataFrame, ledger: DataFrame) -> DataFrame:
    j = jobs.agg(F.count("*").alias("total"), F.count_if(F.col("dedup_status") == "unique").alias("unique_jobs"), F.count_if((F.col("import_ready") == 1) & F.col("imported_at").isNull()).alias("ready"))
    q = queue.agg(F.count_if(F.col("resolved") == 0).alias("review_open"))
    m = ledger.agg(F.count_if(F.col("purged") == 0).alias("imported"))
    return j.crossJoin(F.broadcast(q)).crossJoin(F.broadcast(m))  # single rows


def run_counters(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """Per site and day: pages fetched, new and duplicate jobs, failed pages and the duplicate rate."""
    j = jobs.groupBy("source_site", F.col("collected_at").cast("date").alias("day")).agg(F.count_if(F.col("dedup_status").isin("unique", "review")).alias("new_jobs"), F.count_if(~F.col("dedup_status").isin("unique", "review")).alias("dup_jobs"))
    p = pages.groupBy("source_site", F.col("fetched_at").cast("date").alias("day")).agg(F.count("*").alias("pages_fetched"), F.count_if(F.col("http_status") != 200).alias("errors"))
    z = lambda c: F.coalesce(c, F.lit(0))
    x = j.join(p, ["source_site", "day"], "full_outer").select("source_site", "day", *[z(c).alias(c) for c in ("pages_fetched", "new_jobs", "dup_jobs", "errors")])
    return x.withColumn("dup_rate", dup_rate(F.col("dup_jobs"), F.col("new_jobs")))


def empty_share(rows: DataFrame, by: str, column: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("rows"), F.round(F.avg((F.col(column).isNull() | (F.col(column) == "")).cast("int")), 6).alias("empty_share"))


def kpi_admin(posts: DataFrame, reports: DataFrame, marks: DataFrame, since: Column) -> DataFrame:
    """One row over three tables: posts in all, online, new and suspicious ones, open reports, marks."""
    p = posts.agg(F.count("*").alias("posts"), F.count_if(F.col("status") == 1).alias("online"), F.count_if(F.col("created_at") >= since).alias("new_posts"), F.count_if(F.col("suspicious") == 1).alias("suspicious"))
    r = reports.agg(F.count_if(F.col("status") == 0).alias("open_reports"))
    m = marks.agg(F.count("*").alias("marks"))
    return p.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(m))  # single rows


def next_sort(rows: DataFrame, below: int = 999) -> DataFrame:
    """The highest sort position in use, positions kept for the end aside; 0 where there is none."""
    return rows.where(F.col("sort") < below).agg(F.coalesce(F.max("sort"), F.lit(0)).alias("top_sort"))


def report_list(reports: DataFrame, posts: DataFrame) -> DataFrame:
    """Reports with the post each is about and how many its post has; only reports of posts that are there."""
    n = reports.groupBy("post_id").agg(F.count("*").alias("of_post"))
    p = posts.select(F.col("id").alias("post_id"), "public_code", F.col("status").alias("post_status"))
    return reports.join(n, "post_id").join(p, "post_id")


def all_but_last(rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows other than the one with the highest key."""
    top = rows.agg(F.max(key).alias("_top"))  # one row
    return rows.crossJoin(F.broadcast(top)).where(F.col(key) != F.col("_top")).drop("_top")


def pinned(posts: DataFrame, as_of: Column) -> DataFrame:
    return posts.agg(F.count_if((F.col("is_top") == 1) & (F.col("top_expire_at") > as_of)).alias("pinned"))
