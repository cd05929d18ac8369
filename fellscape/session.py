"""Session, checkpoint and table helpers shared by every operator."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "fellscape", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is tuned for; explicit ``conf`` wins."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app).config(map=settings)
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``; columns are pruned by the plan that uses it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    A folder of our own is set only where the session has none and the master is a single
    machine, as in tests; a cluster without a shared folder is an error.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "fellscape-checkpoints")
    sc.setCheckpointDir(named)
    return named


#: Shuffle files of a query are deleted when it ends.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """``df`` computed once and its lineage cut by a reliable checkpoint in the shared folder.

    With ``free`` the shuffle files of the computation are deleted once the checkpoint is written,
    not when the driver happens to collect its garbage. The size estimate is cut as well: a checkpoint keeps that of its plan, and in a loop of joins
    the estimate would be squared in every round, to numbers of ever more digits.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    had = spark.conf.get(FREE, "false")
    if free:
        spark.conf.set(FREE, "true")
        df = df.select("*")  # a query takes the setting when it is made
    try:
        kept = df.checkpoint(eager=True)._jdf
    finally:
        if free:
            spark.conf.set(FREE, had)
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def release(spark: SparkSession) -> None:
    """Lets the cleaner delete checkpoints (where it is set to) and shuffles that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def latest(df: DataFrame, key: str, loaded: str, columns: list[str]) -> DataFrame:
    """The current row of each key: the greatest ``loaded``, ties broken by the other columns.

    A struct maximum is partially aggregated before the shuffle, so a key that holds a third of
    all rows costs one row per map task. Rows with a null key are dropped.
    """
    row = F.struct(F.col(loaded), *[F.col(c) for c in columns if c != loaded])
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max(row).alias("_row"))
        .select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])
    )
