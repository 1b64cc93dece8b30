"""Stores: parquet folders on shared storage that runs add to, replace keys in or guard.

One writer at a time per store. A run that fails before its write leaves the store as it was.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.operators.joins import insert_or_ignore, upsert
from barline.operators.risk import insert_positions
from barline.session import land

PART = "_part"


def read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The store's rows; an empty frame of the same columns while there is no store."""
    try:
        return spark.read.parquet(path).select(*like.columns)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return like.where("false")


def append_new(incoming: DataFrame, path: str, key: str, order: Sequence[str]) -> None:
    """Add the rows whose key the store lacks, the first by ``order`` of each key."""
    stored = read(incoming.sparkSession, path, incoming)
    insert_or_ignore(incoming, stored, key, order).select(*incoming.columns).write.mode("append").parquet(path)


def append_log(incoming: DataFrame, path: str) -> None:
    incoming.write.mode("append").parquet(path)


def replace(incoming: DataFrame, path: str, key: Sequence[str], order: str, parts: int = 64) -> None:
    """Last write per key wins. Keys are dealt to ``parts`` partitions by hash; only those
    that an incoming key falls in are read and written again."""
    spark, part = incoming.sparkSession, F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")
    incoming = incoming.withColumn(PART, part)
    touched = [r[PART] for r in incoming.select(PART).distinct().collect()]  # at most ``parts``
    stored = read(spark, path, incoming).where(F.col(PART).isin(touched))
    merged = spark.read.parquet(land(upsert(stored, incoming, [*key, PART], order)))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)


def open_guarded(incoming: DataFrame, path: str, key: str, order: Sequence[str] = ()) -> DataFrame:
    """Add the rows whose key is not open; returns all incoming rows with ``accepted``."""
    judged = insert_positions(incoming, read(incoming.sparkSession, path, incoming), key, order)
    judged = incoming.sparkSession.read.parquet(land(judged))
    judged.where("accepted").drop("accepted").write.mode("append").parquet(path)
    return judged
