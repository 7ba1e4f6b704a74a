"""Ledgered writes as pure functions: upsert, insert-ignore, guarded delete, import and purge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carda.functions.codes import public_code
from carda.functions.contact import phone_main
from carda.functions.text import build_content, content_hash, map_key, simhash64
from carda.session import cut


def upsert_latest(rows: DataFrame, key: list[str], order: list[str], keep_first: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """One row a key: the last by ``order``; columns of ``keep_first`` keep the value of the first."""
    others = [c for c in rows.columns if c not in key]
    last = F.max_by(F.struct(*others), F.struct(*order)).alias("_last")
    firsts = [F.min_by(F.col(c), F.struct(*order)).alias(f"_first_{c}") for c in keep_first]
    x = rows.groupBy(*key).agg(last, *firsts)
    return x.select(*key, *[F.col(f"_first_{c}").alias(c) if c in keep_first else F.col(f"_last.{c}").alias(c) for c in others])


def insert_ignore(existing: DataFrame, incoming: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The incoming rows that would be stored: first of their key, and the key not there yet."""
    fresh = incoming.join(existing.select(*key).distinct(), key, "left_anti")
    others = [c for c in incoming.columns if c not in key]
    x = fresh.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_f"))
    return x.select(*key, *[F.col(f"_f.{c}").alias(c) for c in others])


def bump_counters(rows: DataFrame, events: DataFrame, key: str, counters: dict[str, Column]) -> DataFrame:
    """``rows`` with counters raised by the number of events of each kind; events are summed before the join."""
    n = events.groupBy(key).agg(*[F.count_if(cond).alias(f"_{c}") for c, cond in counters.items()])
    return rows.join(n, key, "left").withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in counters}).drop(*[f"_{c}" for c in counters])


def resolve_names(jobs: DataFrame, regions: DataFrame, categories: DataFrame, default_region: int, default_category: int) -> DataFrame:
    """Jobs with region_id (district first, then city, else default) and category_id by exact name, case and ends aside."""
    names = lambda d, n: d.groupBy(map_key(F.col("name")).alias(n + "_k")).agg(F.min("id").alias(n + "_rid"))
    x = jobs.withColumns({"district_k": map_key(F.col("district")), "city_k": map_key(F.col("city")), "category_k": map_key(F.col("category"))})
    x = x.join(names(regions, "district"), "district_k", "left").join(names(regions, "city"), "city_k", "left").join(names(categories, "category"), "category_k", "left")
    x = x.withColumns({"region_id": F.coalesce("district_rid", "city_rid", F.lit(default_region)), "category_id": F.coalesce("category_rid", F.lit(default_category))})
    return x.drop("district_k", "city_k", "category_k", "district_rid", "city_rid", "category_rid")


def import_ready(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Import-ready jobs not imported yet, in id order, ``limit`` of them a batch."""
    ready = jobs.where("import_ready = 1 and imported_at is null")
    return ready if limit is None else ready.orderBy("id").limit(limit)


def import_rows(jobs: DataFrame, regions: DataFrame, categories: DataFrame, as_of: Column, batch: str, post_type: int = 1, poster_type: int = 1, default_region: int = 1, default_category: int = 1, fingerprint: bool = True) -> DataFrame:
    """Post rows of the import-ready jobs, with the job each comes from."""
    x = resolve_names(import_ready(jobs), regions, categories, default_region, default_category)
    x = x.withColumn("content", build_content(F.col("title"), F.col("company"), F.col("salary_raw"), F.col("description")))
    cols = [
        F.col("id").alias("crawler_job_id"),
        public_code(F.col("id"), batch).alias("public_code"),
        F.lit(post_type).alias("type"),
        "content",
        content_hash(F.col("content")).alias("content_hash"),
        F.col("contact_name"),
        F.col("contact_phone").alias("phone"),
        phone_main(F.col("contact_phone")).alias("phone_norm"),
        F.col("contact_wechat").alias("wechat"),
        "region_id",
        "category_id",
        F.lit(poster_type).alias("poster_type"),
        F.lit("crawler").alias("origin"),
        as_of.alias("created_at"),
        F.lit(batch).alias("import_batch"),
    ]
    return x.select(*cols, *([simhash64(F.col("content")).alias("simhash")] if fingerprint else []))


def assign_ids(existing: DataFrame, incoming: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """Incoming rows with ids after the highest existing one, in order.

    Rows are ranged into partitions and numbered inside each; only the partitions' sizes are added up, so nothing is
    sorted in one task.
    """
    x = cut(incoming.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = x.groupBy("_p").agg(F.count("*").alias("n"))
    offset = sizes.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("_o"))  # a row a partition
    top = existing.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("_top"))  # one row
    n = x.withColumn("_rn", F.row_number().over(Window.partitionBy("_p").orderBy(*order))).join(F.broadcast(offset), "_p").crossJoin(F.broadcast(top))
    return n.withColumn(key, F.col("_top") + F.col("_o") + F.col("_rn")).drop("_p", "_o", "_rn", "_top")


def import_outputs(jobs: DataFrame, posts: DataFrame, ledger: DataFrame, regions: DataFrame, categories: DataFrame, as_of: Column, batch: str, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What an import writes: the new posts with their ids, the new ledger rows, and the jobs with imported ones stamped."""
    new = assign_ids(posts, import_rows(import_ready(jobs, limit), regions, categories, as_of, batch), ["crawler_job_id"])
    entries = assign_ids(ledger, new.select("crawler_job_id", F.col("id").alias("main_job_id")), ["crawler_job_id"])
    entries = entries.select("id", "crawler_job_id", "main_job_id", F.lit(batch).alias("import_batch"), as_of.alias("imported_at"), F.lit(0).alias("purged"), F.lit(None).cast("timestamp_ntz").alias("purged_at"))
    stamp = entries.select(F.col("crawler_job_id").alias("id"), F.col("imported_at").alias("_at"))
    stamped = jobs.join(stamp, "id", "left").withColumn("imported_at", F.coalesce("_at", "imported_at")).select(*jobs.columns)
    return new, entries, stamped


def purge_report(ledger: DataFrame, posts: DataFrame, batch: str | None = None) -> DataFrame:
    """(map_id, main_job_id, outcome) of every open ledger row: deleted where a crawler post is there, else skipped."""
    open_rows = ledger.where("purged = 0")
    if batch is not None:
        open_rows = open_rows.where(F.col("import_batch") == batch)
    mine = posts.where("origin = 'crawler'").select(F.col("id").alias("main_job_id"), F.lit(1).alias("_there")).distinct()
    x = open_rows.join(mine, "main_job_id", "left")
    return x.select(F.col("id").alias("map_id"), "main_job_id", F.when(F.col("_there") == 1, "deleted").otherwise("skipped").alias("outcome"))


def posts_after_purge(ledger: DataFrame, posts: DataFrame) -> DataFrame:
    gone = purge_report(ledger, posts).where("outcome = 'deleted'").select(F.col("main_job_id").alias("id")).distinct()
    return posts.join(gone, "id", "left_anti")


def expired_jobs(jobs: DataFrame, ledger: DataFrame, today: Column) -> DataFrame:
    """Jobs past their keeping date that no open ledger row needs."""
    needed = ledger.where("purged = 0").select(F.col("crawler_job_id").alias("id")).distinct()
    return jobs.where(F.col("purge_after") < today).join(needed, "id", "left_anti")


def site_jobs(jobs: DataFrame, ledger: DataFrame, site: str) -> DataFrame:
    needed = ledger.where("purged = 0").select(F.col("crawler_job_id").alias("id")).distinct()
    return jobs.where(F.col("source_site") == site).join(needed, "id", "left_anti")


def purge_allowed(ledger: DataFrame, force: bool = False) -> DataFrame:
    """(allowed, open_rows): everything may go only while no ledger row is open, unless forced."""
    n = ledger.agg(F.count_if(F.col("purged") == 0).alias("open_rows"))
    return n.select(((F.col("open_rows") == 0) | F.lit(force)).alias("allowed"), "open_rows")


def backfill_simhash(posts: DataFrame) -> DataFrame:
    """(id, simhash): fingerprints of the posts that have none."""
    return posts.where("simhash is null and content is not null").select("id", simhash64(F.col("content")).alias("simhash"))


def resolve_reviews(jobs: DataFrame, queue: DataFrame) -> DataFrame:
    """(id, dedup_status, import_ready) of jobs with a resolved review; the last resolution of a job counts."""
    last = queue.where("resolved = 1 and resolution is not null").groupBy(F.col("job_id").alias("id")).agg(F.max_by("resolution", F.struct("created_at", "id")).alias("r"))
    return jobs.select("id").join(last, "id").select("id", F.when(F.col("r") == "keep", "unique").otherwise("dup_cross").alias("dedup_status"), F.when(F.col("r") == "keep", 1).otherwise(0).alias("import_ready"))


def first_in_line(rows: DataFrame, owner: str, order: list[str]) -> DataFrame:
    """The earliest row of each owner."""
    w = Window.partitionBy(owner).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def review_list(queue: DataFrame, jobs: DataFrame) -> DataFrame:
    """Open reviews with their job and, where there is one, the candidate."""
    j = jobs.select(F.col("id").alias("job_id"), "title", "company", "source_site")
    c = jobs.select(F.col("id").alias("candidate_id"), F.col("title").alias("candidate_title"), F.col("source_site").alias("candidate_site"))
    return queue.where("resolved = 0").join(j, "job_id").join(c, "candidate_id", "left").select("id", "job_id", "candidate_id", "reason", "title", "company", "source_site", "candidate_title", "candidate_site")
