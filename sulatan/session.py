"""Session settings for local runs and a shared scratch folder for written results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "sulatan") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SULATAN_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: false where joins keep tables as they are dealt
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def co_partitioned(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` whose joins keep tables as they are dealt.

    Tables dealt by their page meet on page, line and chunk without another
    shuffle, where Spark by default deals both anew by all columns of a join.
    The given session keeps its own setting.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set(CO_PARTITION, "false")
    return own


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's checkpoint folder.

    The folder named in ``spark.checkpoint.dir`` is shared by all executors. A
    local session without that setting uses a temporary folder; elsewhere the
    setting is required, as a local folder would be another one per machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), f"sulatan-{os.getpid()}")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back, so that rounds do not pile up a plan."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
