"""Reading and writing tables: Parquet folders, JDBC, and files of other formats, with the schemas pinned where given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carda.operators.parse import to_utf8
from carda.session import table

#: Columns of the tables the engine reads, for sources that carry no schema of their own.
SCHEMAS = {
    "regions": "id INT, parent_id INT, name STRING, level INT, sort INT, status INT",
    "categories": "id INT, name STRING, sort INT, status INT, created_at TIMESTAMP_NTZ",
    "import_map": "id BIGINT, crawler_job_id BIGINT, main_job_id BIGINT, import_batch STRING, imported_at TIMESTAMP_NTZ, purged INT, purged_at TIMESTAMP_NTZ",
    "review_queue": "id BIGINT, job_id BIGINT, candidate_id BIGINT, reason STRING, resolved INT, resolution STRING, created_at TIMESTAMP_NTZ",
    "raw_pages": "id BIGINT, source_site STRING, source_url STRING, raw_html STRING, http_status INT, fetched_at TIMESTAMP_NTZ",
}


def read_files(spark: SparkSession, path: str, kind: str = "parquet", name: str | None = None, **options: str) -> DataFrame:
    """Files of a format Spark reads; text formats take the pinned schema of ``name`` instead of inferring one."""
    r = spark.read.format(kind).options(**options)
    if kind in ("csv", "json") and name in SCHEMAS:
        r = r.schema(SCHEMAS[name])
    return r.load(path)


def read_jdbc(spark: SparkSession, url: str, table_name: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8) -> DataFrame:
    """A database table, split by ranges of a numeric key where bounds are given."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table_name)
    if key and bounds:
        r = r.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return r.load()


def read_pages_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): page files as bytes, to be decoded with their site's charset."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def pages_from_files(spark: SparkSession, path: str, site: str, charset: str = "UTF-8") -> DataFrame:
    """(id, source_site, source_url, raw_html) of page files in one charset, as UTF-8 markup; ids follow the file's address."""
    x = read_pages_binary(spark, path)
    return x.select(F.xxhash64("path").alias("id"), F.lit(site).alias("source_site"), F.col("path").alias("source_url"), to_utf8(F.col("content"), charset).alias("raw_html"))


def fingerprints(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(id, simhash) of the rows that have one; the filter and both columns reach the scan."""
    return table(spark, sf_dir, name).where("simhash is not null").select("id", "simhash")


def import_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "jobs_clean").where("import_ready = 1 and imported_at is null")


def open_ledger(spark: SparkSession, sf_dir: str, batch: str | None = None) -> DataFrame:
    x = table(spark, sf_dir, "import_map").where("purged = 0")
    return x if batch is None else x.where(F.col("import_batch") == batch)


def append(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
