"""Spark session helpers shared by the library, the bench and the tests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the oracle comparison relies on (UTC, AQE)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("quarry")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``; the path may be any URI Spark reads."""
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written to the folder that all executors share and read back: a cut in its lineage that
    outlives them. The folder is ``spark.checkpoint.dir``; a local session may do without it. ``codec``
    for what is large and read seldom; else that of the session."""
    spark = df.sparkSession
    folder = scratch(spark, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
