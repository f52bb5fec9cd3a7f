"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 20, 28
_local: list[str] = []
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset and the master local, as in tests.

    RuntimeError on a cluster without that setting: no executor would find the driver's own folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="weftline-"))
        root = _local[0]
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/weftline-{tag}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    return path


def written(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, tag: str, key: str, buckets: int) -> DataFrame:
    """Write df as Parquet in the shared folder, in buckets sorted by key, and read it back: joins on key with tables of
    as many buckets move no row. df is best dealt by key into as many partitions, which makes one file a bucket."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    name = path.rpartition("/")[2].replace("-", "_")
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that `written` made and that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def removed(df: DataFrame) -> None:
    """Delete the files of a DataFrame as `written` gave it."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def swept(spark: SparkSession) -> None:
    """Let go of the shuffle files of what has been written: Spark deletes them only once the driver's JVM collects the
    plans that made them, which on a large heap is late."""
    spark._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within are deleted on leaving; what is to stay is written as Parquet elsewhere within."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def smallest(df: DataFrame, key: Column, n: int) -> DataFrame:
    """The rows of df whose key (long) is among its n smallest distinct keys; only keys are shuffled to find the bound."""
    bound = df.select(key.alias("k")).distinct().orderBy("k").limit(n).agg(F.max("k")).first()[0]
    return df.limit(0) if bound is None else df.where(key <= F.lit(bound))


def maybe_in(docs: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """docs that may have their values of `on` in keys, and docs that surely haven't, by a bitmap of hashes.

    It spares the shuffle of texts that a join would drop; it never decides a result. The bitmap has 16 bits a key, and
    2^28 (32 MB, a broadcast of known bound) at most: beyond 10^8 keys more and more docs pass that a join then drops.
    """
    keys = keys.select(*on)
    bits = 1 << min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * max(keys.count(), 1)))))
    bit = F.pmod(F.xxhash64(*on), F.lit(bits))
    found = keys.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_bits"))
    found = written(found, "bitmap")
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = docs.withColumn("_bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(found), "_bucket", "left")
    has = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))
    return marked.where(has).select(*docs.columns), marked.where(~has).select(*docs.columns)
