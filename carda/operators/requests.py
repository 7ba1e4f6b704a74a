"""Requests of visitors judged in bulk: new and edited posts, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carda.functions.contact import contact_in_content, phone_main, valid_phone
from carda.functions.text import content_hash, trim
from carda.operators.gates import alert_merge, throttle


def _field_rules() -> list[tuple[str, Column]]:
    """(rule, violated) of the fields by themselves, in the order they are asked."""
    content, name, wechat = trim(F.coalesce("content", F.lit(""))), trim(F.coalesce("contact_name", F.lit(""))), trim(F.coalesce("wechat", F.lit("")))
    return [
        ("content", (content == "") | (F.length(content) > 1000)),
        ("contact_name", (name == "") | (F.length(name) > 50)),
        ("phone", ~F.coalesce(valid_phone(trim(F.col("phone"))), F.lit(False))),
        ("wechat", F.length(wechat) > 60),
    ]


def _dimension(x: DataFrame, dim: DataFrame, key: str, flag: str) -> DataFrame:
    """``x`` with ``flag``: whether ``key`` is an entry of the dimension in use."""
    d = dim.where("status = 1").select(F.col("id").alias(key), F.lit(True).alias(flag)).distinct()
    return x.join(d, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def validate_posts(posts: DataFrame, regions: DataFrame, categories: DataFrame, per_hour: int = 5, window_days: int = 7) -> DataFrame:
    """(id, verdict, earlier_id): the first rule each post breaks when it is submitted, or ``ok``, or ``bump``.

    Asked in order: content, contact_name, phone, wechat, region, category, contact_in_content, rate (posts stored from
    its address within the hour before), duplicate (a visible post of the same phone and content within the window; the
    newest is named). A registered poster's own duplicate is bumped instead. One ordered pass per address and one per
    phone and content.
    """
    x = _dimension(_dimension(posts, regions, "region_id", "_region"), categories, "category_id", "_category")
    hour = Window.partitionBy("post_ip").orderBy("_us").rangeBetween(-3_600_000_000 + 1, -1)
    x = x.withColumn("_us", F.unix_micros(F.col("created_at").cast("timestamp")))
    x = x.withColumn("_lately", F.when(F.col("post_ip").isNotNull(), F.count("*").over(hour)).otherwise(0))
    x = x.withColumn("_hash", content_hash(F.col("content"))).withColumn("_phone", phone_main(F.col("phone")))
    before = Window.partitionBy("_phone", "_hash").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_dup", F.last(F.when(F.col("status").isin(0, 1), F.struct("id", "created_at", "poster_type", "user_id")), ignorenulls=True).over(before))
    recent = F.coalesce(F.col("_dup.created_at") > F.col("created_at") - F.make_dt_interval(F.lit(window_days)), F.lit(False)) & (F.col("_phone") != "")
    own = recent & (F.col("_dup.poster_type") == 2) & (F.col("poster_type") == 2) & (F.col("_dup.user_id") == F.col("user_id"))
    rules = [*_field_rules(), ("region", ~F.col("_region")), ("category", ~F.col("_category")), ("contact_in_content", contact_in_content(F.col("content"))), ("rate", F.col("_lately") >= per_hour), ("bump", F.coalesce(own, F.lit(False))), ("duplicate", recent)]
    verdict = F.lit("ok")
    for name, broken in reversed(rules):
        verdict = F.when(broken, name).otherwise(verdict)
    return x.select("id", verdict.alias("verdict"), F.when(verdict.isin("bump", "duplicate"), F.col("_dup.id")).alias("earlier_id"))


def edit_posts(posts: DataFrame, edits: DataFrame, regions: DataFrame, categories: DataFrame, as_of: Column) -> DataFrame:
    """Posts with their owners' edits applied where the edit breaks no rule; hashes follow the content.

    ``edits``: post_id, user_id and the new content, contact_name, phone, wechat, region_id, category_id, one row a post.
    """
    fields = ("content", "contact_name", "phone", "wechat", "region_id", "category_id")
    e = _dimension(_dimension(edits, regions, "region_id", "_region"), categories, "category_id", "_category")
    bad = ~F.col("_region") | ~F.col("_category") | contact_in_content(F.col("content"))
    for _, broken in _field_rules():
        bad = bad | broken
    e = e.where(~bad).select(F.col("post_id").alias("id"), F.col("user_id").alias("_owner"), *[F.col(f).alias(f"_{f}") for f in fields])
    x = posts.join(e, "id", "left")
    hit = F.col("_owner").isNotNull() & (F.col("_owner") == F.col("user_id"))
    new = {f: F.when(hit, F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}
    new["content_hash"] = F.when(hit, content_hash(F.col("_content"))).otherwise(F.col("content_hash"))
    new["phone_norm"] = F.when(hit, phone_main(F.col("_phone"))).otherwise(F.col("phone_norm"))
    new["updated_at"] = F.when(hit, as_of).otherwise(F.col("updated_at"))
    return x.withColumns(new).select(*posts.columns)


def report_flow(reports: DataFrame, post: str, reporter: str, seconds: int = 3600, merge_minutes: int = 60, ts: str = "ts") -> DataFrame:
    """(event_id, sends, so_far) of the reports that count: one of a reporter and post within ``seconds``; mails about a
    post less than ``merge_minutes`` apart are merged, ``so_far`` counts the post's reports."""
    counted = throttle(reports, [post, reporter], seconds, ts).where("accepted").select("event_id")
    return alert_merge(reports.join(counted, "event_id"), post, merge_minutes, ts)


def handle_reports(reports: DataFrame, actions: DataFrame, posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports with open ones handled or ignored as ``actions`` (report_id, action) say, and posts with those taken down
    whose report was handled by ``take_down``. The last action of a report counts by its order."""
    a = actions.where(F.col("action").isin("handled", "ignored", "take_down")).groupBy("report_id").agg(F.max_by("action", "order").alias("_a"))
    x = reports.join(a.withColumnRenamed("report_id", "id"), "id", "left")
    act = F.when(F.col("status") == 0, F.col("_a"))
    done = x.withColumn("_a", act).withColumn("status", F.when(F.col("_a") == "ignored", 2).when(F.col("_a").isNotNull(), 1).otherwise(F.col("status")))
    gone = done.where("_a = 'take_down'").select(F.col("post_id").alias("id")).distinct().withColumn("_gone", F.lit(True))
    down = posts.join(gone, "id", "left").withColumn("status", F.when(F.col("_gone"), 2).otherwise(F.col("status"))).drop("_gone")
    return done.drop("_a"), down
