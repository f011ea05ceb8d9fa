"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bounds of the batches that travel between the JVM and Python workers.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any file system Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only a session on one machine may leave it unset; it gets a temporary folder then.
    """
    context = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir"):
        return named
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the cluster's shared folder, so a lost executor costs one read."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


class Written:
    """A table written to the shared folder, read back as ``df`` and removed at the end of a ``with`` block."""

    def __init__(self, df: DataFrame, name: str = "table"):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def remove(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def __enter__(self) -> DataFrame:
        return self.df

    def __exit__(self, *_) -> None:
        self.remove()


def apart(df: DataFrame, column: str) -> Column:
    """``column`` as an expression whose hash partitioning the planner doesn't know.

    A join of rows with an aggregate by the same key would reuse the aggregate's partitioning, and adaptive
    execution cannot split a hot key's partition then. Behind this expression both sides are shuffled
    for the join, so it can; the aggregate has one row a key.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, T.IntegralType):
        return F.col(column).bitwiseXOR(F.lit(0).cast(kind))
    return F.concat(F.col(column), F.lit("")) if isinstance(kind, T.StringType) else F.col(column)


def with_id(df: DataFrame, ddl: str, id_col: str = "id") -> T.StructType:
    """``df``'s id column, of whatever type, followed by the columns of ``ddl``."""
    return T.StructType([T.StructField("id", df.schema[id_col].dataType), *T.StructType.fromDDL(ddl).fields])


def map_batches(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]],
    schema: str | T.StructType,
) -> DataFrame:
    """Run ``make()`` once per task and its result on each Arrow batch of the partition.

    Batches are held to ``BATCH_BYTES`` (or one row) and ``BATCH_ROWS``, so neither the JVM's buffers nor
    the worker's grow with a partition or with the length of texts.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                yield from step(batch.slice(start, BATCH_ROWS))

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: int = 1) -> list[str]:
    """The batch's texts, null read as empty."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, so other columns never clash or travel."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
