"""Numbers and carried values over a whole table without a window over all of its rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = 1 << 20
_CLEARED = 0


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a new temporary one, which only a local master can use."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def own_folder(spark: SparkSession, name: str) -> str:
    """A path for a new table of this application."""
    return f"{shared_folder(spark)}/cardamom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def generation(spark: SparkSession) -> tuple[str, int]:
    """What tables kept for later are kept for: this application, until it clears its folder."""
    return spark.sparkContext.applicationId, _CLEARED


def clear(spark: SparkSession) -> None:
    """Removes all tables that this application has written there. Results that still read them are lost."""
    global _CLEARED
    _CLEARED += 1
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/cardamom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and a lost executor loses none of it."""
    path = own_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_ranks(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df with places from 1 in any order: range-partitioned, numbered in each partition, offsets by partition."""
    parted = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    parted = scratch(parted, "sorted")
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at") - F.col("_part").cast("long") * (1 << 33) + 1
    return parted.join(F.broadcast(sizes), F.col("_part") == F.col("_p")).withColumn(name, place).drop("_part", "_at", "_p", "_before")


def carried(df: DataFrame, group: str, order: str, value: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """df with the last non-null value at or before each row of its group.

    Filled within chunks of ``order`` first; each chunk's last value is filled
    over the table of chunks and joined back.
    """
    df = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    own = F.last(value, ignorenulls=True).over(Window.partitionBy(group, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    lasts = df.where(F.col(value).isNotNull()).groupBy(group, "_chunk").agg(F.max_by(value, order).alias("_last"))
    chunks = df.select(group, "_chunk").distinct().join(lasts, [group, "_chunk"], "left")
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    chunks = chunks.select(group, "_chunk", before.alias("_before"))
    return df.withColumn("_own", own).join(chunks, [group, "_chunk"]).withColumn(name, F.coalesce("_own", "_before")).drop("_chunk", "_own", "_before")


def running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """df with the sum of ``value`` over all rows before each in order: summed in range partitions, totals by partition before."""
    parted = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    parted = scratch(parted, "totals")
    sizes = parted.groupBy("_part").agg(F.sum(value).alias("_n"))
    earlier = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("_part").alias("_p"), F.coalesce(earlier, F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parted.withColumn(name, own).join(F.broadcast(sizes), F.col("_part") == F.col("_p")).withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_at", "_p", "_before")
