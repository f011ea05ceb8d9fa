"""Session settings the library is written for."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "panelwright", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; other settings (master, memory, partitions) are the caller's."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that driver and executors share (``spark.checkpoint.dir``), so that plans of loops do not grow.

    Only a session on one machine may leave the setting unset; it gets a temporary folder then.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


class Written:
    """A table of a loop, written to the shared folder and read back as ``df`` until it is removed."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{_shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def remove(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
