"""Session defaults and the few helpers every operator shares."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "carda", cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary one; a cluster
    has no folder all executors share unless it names one, so that is an error."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if configured:
        if current.isEmpty():
            sc.setCheckpointDir(configured)
        return configured
    if current.isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="carda-checkpoint-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


#: Splits above which a table counts as large enough to be left as it lies.
SPREAD = 64
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="carda-ship-")) / "carda.zip"  # on the driver; Spark serves it to executors
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(str(target))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a small table would leave more than half of them idle; any other is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= min(cores, SPREAD) else df


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are worked on in Python."""
    return spread(table(spark, sf_dir, name))


def fixed_rows(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A small DataFrame of constants."""
    return spark.createDataFrame(list(rows), schema)


def sized_broadcast(df: DataFrame, rows: int, limit_rows: int = 200_000) -> DataFrame:
    """Broadcast ``df`` only while its counted ``rows`` stay under ``limit_rows``; beyond it Spark shuffles."""
    return F.broadcast(df) if rows <= limit_rows else df


def lit_map(pairs: dict) -> Column:
    """A map literal from a Python dict."""
    items: list[Column] = []
    for k, v in pairs.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)
