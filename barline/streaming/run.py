"""Run a stream over everything that has landed, then stop (cron style)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.session import checkpoint_root


FILES = 64


def landed(spark: SparkSession, folder: str, name: str | None = None, schema=None, files: int | None = FILES) -> DataFrame:
    """Stream over parquet files of a folder, or over one named file in it, at most ``files``
    in a micro-batch, so that a backlog is worked off piece by piece. Rules that need the order
    of rows take files that arrive in order, ``Reordered``, or no limit (None)."""
    one = f"{folder}/{name}" if name else folder
    reader = spark.readStream.schema(schema or spark.read.parquet(one).schema)
    reader = reader if files is None else reader.option("maxFilesPerTrigger", files)
    return (reader.option("pathGlobFilter", name) if name else reader).parquet(folder)


def latest_values(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Process what is there in update mode; returns the last value of every key, so windows
    that are still open are part of the result. A batch that runs again gives the same rows."""
    spark = stream.sparkSession
    base = f"{checkpoint_root(spark)}/streams/{uuid.uuid4().hex}"

    def save(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch).cast("long")).write.mode("append").parquet(f"{base}/out")

    q = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    saved = spark.read.schema(T.StructType([*stream.schema, T.StructField("_batch", T.LongType())])).parquet(f"{base}/out")
    return saved.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_row")).select(*keys, "_row.*")


def available_now(stream: DataFrame) -> DataFrame:
    """Process what is there with an append sink, and return what was written."""
    spark = stream.sparkSession
    base = f"{checkpoint_root(spark)}/streams/{uuid.uuid4().hex}"
    q = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
