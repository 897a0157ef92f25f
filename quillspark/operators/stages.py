"""Plans in stages: results that later steps read again, and row numbers over a whole table without a single task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share; on one machine without such a folder a temporary one serves."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quillspark-checkpoint-"))
    return context.getCheckpointDir()


def materialised(df: DataFrame) -> DataFrame:
    """df, computed once into the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, path: str | None = None) -> DataFrame:
    """df, computed once into a compressed table below the shared folder, or at path: for rows that are many or long."""
    path = path or f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession, rows: int = 512) -> None:
    """Hand Python workers few texts at a time; the setting holds for the session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def numbered(rows: DataFrame, order: list[Column], name: str, within: list[Column] | None = None) -> DataFrame:
    """rows with a column of numbers from 1 in the given order: sorted by range, counted by part, and shifted.

    within orders rows that are equal in order; such rows lie in one part, and ranges are drawn from order alone.
    """
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = materialised(rows.repartitionByRange(*order).sortWithinPartitions(*order, *(within or [])).withColumn("_part", F.spark_partition_id()).withColumn("_at", at))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a part
    shifts = sizes.select("_part", before.alias("_before"))
    return parts.join(F.broadcast(shifts), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")
