"""Best-fit packing, planned on the histogram of lengths.

Documents become pieces of at most ``capacity`` tokens. How many pieces have each length is
all that the plan needs: best fit in descending length over counts, where bins with equal
room are handled as one range. Pieces take the planned slots by their rank within length.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from barline.llm.common import claim, cuts, land, slim, text_batches
from barline.llm.vocab import merging

RANK_GROUP = 4_000


def pieces(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids): every document's ids and the end id, cut into pieces.

    Only documents of more than ``capacity`` ids are cut; the first piece takes what does not
    fill a piece. ``ids`` is binary, little-endian unsigned 32-bit. Null and empty texts are
    one piece, the end id alone. Repeated rows and null ids give their own pieces.
    """
    schema = T.StructType([
        T.StructField("id", df.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("vocab")
        encoder = merging(path)
        for batch, texts in text_batches(batches, "text"):
            flat, lens = encoder.batch(texts)
            raw, ends = flat.astype("<u4").tobytes(), cuts(lens)
            row, piece, start, length, ids = [], [], [], [], []
            for i, (a, b) in enumerate(zip(ends, ends[1:])):
                n, at, k = b - a + 1, 0, 0
                body = raw[4 * a : 4 * b] + end
                while at < n:
                    to = at + ((n - at - 1) % capacity + 1)
                    row.append(i), piece.append(k), start.append(at), length.append(to - at), ids.append(body[4 * at : 4 * to])
                    at, k = to, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                names=schema.names,
            )

    return slim(df, id_col, text_col, "text").mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best fit over counts: runs (length, first rank, last rank + 1, per bin, first bin, offset)
    and the number of bins.

    A run gives ``per bin`` pieces to each of a range of bins, from ``offset`` on. Bins with
    equal room are ranges (first bin, bins) in one list. Each length adds at most three
    ranges and a range is used at most log2(capacity) times, as its room halves at least:
    the plan's size depends on ``capacity`` alone.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    runs, bins = [], 0

    def put(r: int, first: int, n: int) -> None:
        if n and r:
            if r not in room:
                room[r] = []
                bisect.insort(rooms, r)
            room[r].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                r = rooms[at]
                first, n = room[r].pop()
                if not room[r]:
                    del room[r], rooms[at]
            else:
                r, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            each = r // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, rank + full * each, each, first, capacity - r))
                put(r - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:
                runs.append((length, rank, rank + left, left, first + full, capacity - r))
                put(r - left * length, first + full, 1)
                put(r, first + full + 1, n - full - 1)
                left = 0
            else:
                put(r, first + full, n - full)
    return runs, bins


def ranked(df: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """``rank`` from 0 within length. Rows of one length are dealt by a hash into buckets of
    about ``RANK_GROUP`` rows, as many as the length needs; the buckets' counts give each
    bucket its first rank."""
    parts = df.sparkSession.createDataFrame([(n, -(-c // RANK_GROUP)) for n, c in histogram.items()], "length long, parts long")
    df = df.join(F.broadcast(parts), "length")
    df = df.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "crc"), F.col("parts"))).drop("parts")
    counts = df.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("id", "piece", "crc")
    df = df.withColumn("within", F.row_number().over(within) - 1)
    return df.join(counts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within")).drop("bucket", "before", "within")


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """``cut`` (id, piece, length, crc, ...) with sequence_id and offset.

    The lengths' counts, at most ``capacity`` rows, go to the driver; the plan comes back as
    a broadcast of a size that ``capacity`` bounds. ``cut`` is landed first, so that ranks
    are the same when a task is run again. ``crc`` only settles ties between rows with the
    same id and piece; rows equal in all three are interchangeable. An empty table gives none.
    """
    cut = land(cut)
    spark: SparkSession = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan(histogram, capacity)
    slots = spark.createDataFrame(runs, "length long, low long, high long, each long, bin long, at long")
    df, p = ranked(cut, histogram), F.broadcast(slots)
    df = df.join(p, "length").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    step = F.col("rank") - F.col("low")
    return df.withColumns({
        "sequence_id": F.col("bin") + F.floor(step / F.col("each")),
        "offset": F.col("at") + (step % F.col("each")) * F.col("length"),
    }).drop("rank", "low", "high", "each", "bin", "at")
