"""Session settings that the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def session(master: str = "local[8]", partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return ready(
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TERRAFOLD_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers of this session import the library from where the driver found it, and bounds their batches.

    A batch of Spark's 10,000 rows of long texts would stand in memory several times; another setting than that stays.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local session without one has a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return Path(tempfile.mkdtemp(prefix="spark-shared-")).as_uri()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def large(df: DataFrame) -> DataFrame:
    """df for a join that sorts and merges, whatever size its files have: columns of few values take next to no room in
    them, so Spark would send tables of many million rows through the driver to all tasks."""
    return df.hint("merge")


def written(df: DataFrame, *parts: str) -> DataFrame:
    """df as a table in the shared folder (in folders by parts), read again: lineage ends, columns are compressed."""
    at = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
