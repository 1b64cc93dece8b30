"""Helpers that the training-data operators share: landed tables, Arrow batches, clash-free names."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.session import checkpoint_root

BATCH_BYTES = 3 << 19
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_caches: dict[str, Callable[[], object]] = {}


def cached(owner: str, clear: Callable[[], object]) -> None:
    """Tell how the caches that a worker keeps between tasks for ``owner`` are emptied."""
    _caches[owner] = clear


def claim(*owners: str) -> None:
    """Empty the caches of all others and give unused memory back: a worker that goes on to
    another operator doesn't keep what the one before remembered."""
    for owner, clear in _caches.items():
        if owner not in owners:
            clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def land(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to a new folder under ``spark.checkpoint.dir`` and read it back: cuts the
    lineage with files that outlive any executor."""
    path = f"{checkpoint_root(df.sparkSession)}/llm/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the folder of a landed table that nothing will read again."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Meanwhile the shuffle files of a query go when it ends, not when the driver's memory is collected."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)


def slim(df: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """Only the columns that the operator needs, under fixed names; clashing extra columns go."""
    return df.select(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").alias(n) for c, n in zip(cols[::2], cols[1::2])])


def text_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Arrow batches cut so that their texts (null: empty) hold about ``limit`` characters."""
    for batch in batches:
        texts = ["" if x is None else x for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
        lo, held = 0, 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= limit:
                yield batch.slice(lo, i + 1 - lo), texts[lo : i + 1]
                lo, held = i + 1, 0
        if lo < len(texts):
            yield batch.slice(lo), texts[lo:]


def cuts(lens) -> list[int]:
    """Ends of consecutive runs with these lengths, with 0 in front."""
    out, at = [0], 0
    for n in lens:
        at += int(n)
        out.append(at)
    return out


def _pack_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tool = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        blobs = [tool.compress((x or "").encode()) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(blobs, pa.binary())], names=["uid", "id", "blob"])


def packed_texts(rows: DataFrame) -> DataFrame:
    """(uid, id, blob): texts compressed, as they are shuffled more than once."""
    schema = T.StructType([T.StructField("uid", T.LongType()), rows.schema["id"], T.StructField("blob", T.BinaryType())])
    return rows.select("uid", "text", "id").mapInArrow(_pack_text, schema)


def with_uid(df: DataFrame, id_col: str, text_col: str, more: dict[str, Column] | None = None) -> DataFrame:
    """(id, text, uid, ...): uid is the id where ids are unique integers, else a number that is
    landed with the rows. Null texts are empty."""
    columns = [F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")]
    rows = df.select(*columns, *[c.alias(n) for n, c in (more or {}).items()])
    if isinstance(df.schema[id_col].dataType, (T.LongType, T.IntegerType)):
        odd = rows.groupBy("id").count().where("count > 1 or id is null")
        if odd.isEmpty():
            return rows.withColumn("uid", F.col("id").cast("long"))
    ordered = land(rows.repartitionByRange("id").sortWithinPartitions("id"))
    return land(ordered.withColumn("uid", F.monotonically_increasing_id()))


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it; letters' case doesn't count."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, id_col: str, name: str = "uid") -> DataFrame:
    """``df`` with a unique integer ``name``, made as in ``with_uid``; ``name`` is not among the
    columns of ``df``, all of which are kept."""
    none = free(df, "_none")
    more = {f"c{i}": F.col(f"`{c}`") for i, c in enumerate(df.columns)}
    rows = with_uid(df.withColumn(none, F.lit("")), id_col, none, more)
    return rows.select(F.col("uid").alias(name), *[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])


def sized(df: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` (short) rows; beyond, joins with
    it are shuffled."""
    return F.broadcast(df) if df.count() <= rows else df
