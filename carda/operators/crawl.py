"""A crawl as one batch job: the walk over a run's links, what it finds, where it stops, and the run ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carda.operators.dedup import url_key

#: Verdicts that make a record a duplicate.
DUPLICATE = ("dup_cross", "exists_in_main")


def _walk(links: DataFrame, history: DataFrame, run: str, order: list[str], url: str, verdict: str, failed: Column) -> DataFrame:
    """Links with ``pos`` and ``outcome``: known, error, dup or new. Known are addresses of the history and those the run
    itself has met before."""
    by_run = Window.partitionBy(run).orderBy(*order)
    met = F.row_number().over(Window.partitionBy(run, "_k").orderBy(*order)) > 1
    known = history.select(url_key(F.col(url)).alias("_k")).where("_k is not null").distinct().withColumn("_old", F.lit(True))
    x = links.withColumn("_k", url_key(F.col(url))).withColumn("_met", met & F.col("_k").isNotNull()).join(known, "_k", "left")
    outcome = F.when(F.coalesce("_old", F.lit(False)) | F.col("_met"), "known").when(failed, "error").when(F.col(verdict).isin(*DUPLICATE), "dup").otherwise("new")
    return x.withColumn("outcome", outcome).withColumn("pos", F.row_number().over(by_run)).drop("_k", "_met", "_old")


def crawl_run(links: DataFrame, history: DataFrame, run: str, order: list[str], url: str = "source_url", title: str = "title", verdict: str = "dedup_status", failed: Column | None = None, stop_after: int = 5, min_new: int = 10, alert_ratio: float = 0.5) -> DataFrame:
    """The links each run processes, with ``pos``, ``outcome`` and ``stop``, the reason at the row a run stops at.

    A run stops at its ``stop_after``-th known link in a row, or (``layout``) once at least ``min_new`` records are new
    and more than ``alert_ratio`` of them lack a title. The row that stops it still counts.
    """
    x = _walk(links, history, run, order, url, verdict, F.lit(False) if failed is None else failed)
    along = Window.partitionBy(run).orderBy("pos")
    is_known, is_new = F.col("outcome") == "known", F.col("outcome") == "new"
    bare = is_new & F.coalesce(F.col(title) == "", F.lit(True))
    x = x.withColumns({"_island": F.sum((~is_known).cast("int")).over(along), "_new": F.sum(is_new.cast("int")).over(along), "_bare": F.sum(bare.cast("int")).over(along)})
    x = x.withColumn("_row", F.sum(is_known.cast("int")).over(Window.partitionBy(run, "_island").orderBy("pos")))
    layout = ~is_known & (F.col("_new") >= min_new) & (F.col("_bare") / F.col("_new") > alert_ratio)
    x = x.withColumn("_stop", F.when(is_known & (F.col("_row") >= stop_after), "known").when(layout, "layout"))
    x = x.withColumn("_end", F.min(F.when(F.col("_stop").isNotNull(), F.col("pos"))).over(Window.partitionBy(run)))
    kept = x.where(F.col("_end").isNull() | (F.col("pos") <= F.col("_end")))
    return kept.withColumn("stop", F.when(F.col("pos") == F.col("_end"), F.col("_stop"))).drop("_island", "_new", "_bare", "_row", "_stop", "_end")


def crawl_sync(links: DataFrame, history: DataFrame, run: str, order: list[str], max_new: int, url: str = "source_url", verdict: str = "dedup_status", failed: Column | None = None) -> DataFrame:
    """The links of a bounded run: it stops with the ``max_new``-th new record and knows no other stop."""
    x = _walk(links, history, run, order, url, verdict, F.lit(False) if failed is None else failed)
    n = F.sum((F.col("outcome") == "new").cast("int")).over(Window.partitionBy(run).orderBy("pos"))
    x = x.withColumn("_n", n)
    return x.where((F.col("_n") < max_new) | ((F.col("_n") == max_new) & (F.col("outcome") == "new"))).drop("_n")


def run_ledger(walked: DataFrame, run: str, sync: bool = False) -> DataFrame:
    """(run, seen, new_jobs, dup_jobs, errors, status): the counters a finished run is entered with.

    A run is failed if it stopped for its layout; a bounded one if it met errors and found nothing new.
    """
    n = lambda *o: F.count_if(F.col("outcome").isin(*o))
    x = walked.groupBy(run).agg(F.count("*").alias("seen"), n("new").alias("new_jobs"), n("known", "dup").alias("dup_jobs"), n("error").alias("errors"), *([] if sync else [F.max(F.col("stop") == "layout").alias("_layout")]))
    bad = (F.col("errors") > 0) & (F.col("new_jobs") == 0) if sync else F.coalesce("_layout", F.lit(False))
    return x.withColumn("status", F.when(bad, "failed").otherwise("ok")).drop("_layout")


def sync_summary(walked: DataFrame, run: str, title: str = "title", samples: int = 5) -> DataFrame:
    """(run, new_jobs, dup_jobs, sample_titles): totals of a bounded run and the titles of its first new records."""
    w = Window.partitionBy(run).orderBy("pos")
    x = walked.withColumn("_n", F.sum((F.col("outcome") == "new").cast("int")).over(w))
    first = F.array_sort(F.collect_list(F.when((F.col("outcome") == "new") & (F.col("_n") <= samples), F.struct("pos", F.coalesce(F.col(title), F.lit("")).alias("t")))))
    x = x.groupBy(run).agg(F.count_if(F.col("outcome") == "new").alias("new_jobs"), F.count_if(F.col("outcome").isin("known", "dup")).alias("dup_jobs"), first.alias("s"))
    return x.select(run, "new_jobs", "dup_jobs", F.array_join(F.transform("s", lambda v: v["t"]), " / ").alias("sample_titles"))


def finish_runs(runs: DataFrame, ledger: DataFrame, key: str, finished_at: Column) -> DataFrame:
    """Open runs with the counters of ``ledger`` entered and their end stamped; runs without an entry stay as they are."""
    cols = [c for c in ("new_jobs", "dup_jobs", "errors", "status") if c in ledger.columns]
    done = ledger.select(key, *[F.col(c).alias(f"_{c}") for c in cols], F.lit(True).alias("_done"))
    x = runs.join(done, key, "left").withColumns({c: F.coalesce(f"_{c}", F.col(c)) for c in cols})
    return x.withColumn("finished_at", F.when(F.col("_done"), finished_at).otherwise(F.col("finished_at"))).drop("_done", *[f"_{c}" for c in cols])


def reset_running(runs: DataFrame) -> DataFrame:
    """The ledger without runs that never ended."""
    return runs.where(~F.coalesce(F.col("status") == "running", F.lit(False)))


def last_start(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max("started_at").alias("last_started"))
