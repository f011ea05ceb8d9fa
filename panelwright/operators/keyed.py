"""Tables laid out for point lookups: rows by a hash of their key, Bloom filters in the files.

A lookup reads the files of one bucket, and of those only row groups whose Bloom filter may hold the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"


def bucket_of(keys: list[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_keyed(rows: DataFrame, path: str, keys: list[str], buckets: int = 256, also: tuple[str, ...] = ()) -> None:
    """Write ``rows`` by bucket of ``keys``; ``also`` names further columns that get a Bloom filter."""
    placed = rows.withColumn(BUCKET, bucket_of([F.col(k) for k in keys], buckets))
    writer = placed.repartition(BUCKET).sortWithinPartitions(BUCKET, *keys).write.mode("overwrite").partitionBy(BUCKET)
    for c in (*keys, *also):
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


def lookup(spark: SparkSession, path: str, schema: str, buckets: int = 256, **key) -> DataFrame:
    """The rows with this key; values have the columns' types. The bucket is a constant of the plan, so other folders are not listed for reading."""
    rows = spark.read.schema(f"{schema}, {BUCKET} int").parquet(path)
    literals = [F.lit(v).cast(rows.schema[k].dataType) for k, v in key.items()]
    found = rows.where(F.col(BUCKET) == bucket_of(literals, buckets))
    for k, v in zip(key, literals, strict=True):
        found = found.where(F.col(k) == v)
    return found.drop(BUCKET)


def lookup_many(spark: SparkSession, path: str, schema: str, asked: DataFrame, keys: list[str], buckets: int = 256) -> DataFrame:
    """The rows whose key is in ``asked``: joined by bucket and key, so that dynamic pruning reads the asked buckets only."""
    rows = spark.read.schema(f"{schema}, {BUCKET} int").parquet(path)
    wanted = asked.select(*keys).distinct().withColumn(BUCKET, bucket_of([F.col(k) for k in keys], buckets))
    return rows.join(wanted, [BUCKET, *keys], "left_semi").drop(BUCKET)
