"""Whitening of embeddings by polarisation: covariances as differences of variances.

Values become whole numbers x. With S the sum and n the number of vectors, n * x - S is a whole
number too, so the sum of its squares is exact; so is that of every sum of two dimensions.
Half of what the square of a sum exceeds the two squares by is the product. Tasks add up the
squares in limbs that can't overflow, Spark adds the tasks, and the driver gets one number for
each pair of dimensions, whatever the number of vectors, to take eigenvectors of.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
BATCH = 4096  # most vectors whose squares are added at once
LIMIT = 1 << 60  # whole numbers stay below


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    """Whole numbers x, a row a vector."""
    flat = batch.column(batch.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False)
    x = np.floor(SCALE * flat.reshape(batch.num_rows, -1)) + SHIFT
    if x.size and not np.abs(x).max() < LIMIT:
        raise ArithmeticError("a value is too large for whole numbers")
    return x.astype(np.int64)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: list[int] = []
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            x = _vectors(batch.slice(at, BATCH))
            low, high = (x & 0xFFFFFFFF).sum(0).tolist(), (x >> 32).sum(0).tolist()
            total = [t + (h << 32) + s for t, h, s in zip(total or [0] * len(low), high, low)]
    yield _numbers(total)


def _numbers(values: list[int]) -> pa.RecordBatch:
    """(i, v): whole numbers of any size as text."""
    return pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array([str(v) for v in values], pa.string())], names=["i", "v"])


def _centred(batch: pa.RecordBatch, n: int, sums: np.ndarray) -> np.ndarray:
    x = _vectors(batch)
    if x.size and n * int(np.abs(x).max()) >= LIMIT:
        raise ArithmeticError("too many vectors, or too large ones, for whole numbers of 64 bits")
    return n * x - sums


def squares(e: np.ndarray) -> np.ndarray:
    """Exact sums of squares of each column, as whole numbers of any size."""
    out = np.zeros(e.shape[1], object)
    bits = max(2, int(np.abs(e).max()).bit_length()) if e.size else 2
    half = (bits + 1) // 2
    step = max(1, 1 << max(0, 61 - 2 * half))
    for at in range(0, len(e), step):
        part = e[at : at + step]
        high, low = part >> half, part & ((1 << half) - 1)
        hh, hl, ll = ((a * b).sum(0).astype(object) for a, b in ((high, high), (high, low), (low, low)))
        out += (hh << (2 * half)) + (hl << (half + 1)) + ll
    return out


def _squares(n: int, sums: np.ndarray):
    """Rows (i, v) of pairs of dimensions, in the order of ``np.triu_indices``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(sums)
        total = np.zeros(d * (d + 1) // 2, object)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                c, place = _centred(batch.slice(at, BATCH), n, sums), 0
                for i in range(d):
                    both = c[:, i:] + c[:, i : i + 1]
                    both[:, 0] = c[:, i]
                    total[place : place + d - i] += squares(both)
                    place += d - i
        yield _numbers(total.tolist())

    return run


def _gathered(rows: DataFrame) -> list[int]:
    """Sums of (i, v) by i, in order: as many as there are dimensions or pairs of them."""
    summed = rows.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    return [int(v) for _, v in sorted(summed)]


def covariance(pairs: list[int], n: int, d: int) -> np.ndarray:
    """The covariance of x (divisor n) from the sums of squares of all pairs of dimensions."""
    i, j = np.triu_indices(d)
    own = {int(a): q for a, b, q in zip(i, j, pairs) if a == b}
    out = np.empty((d, d))
    for a, b, q in zip(i.tolist(), j.tolist(), pairs):
        out[a, b] = out[b, a] = q / n**3 if a == b else (q - own[a] - own[b]) / (2 * n**3)
    return out


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues and their unit vectors (columns). Directions without variance are
    left out; a vector's largest entry is positive."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    kept = np.flatnonzero(e > len(e) * np.finfo(float).eps * max(e[0], 0))[:most]
    e, u = e[kept], u[:, kept]
    return e, u * np.where(u[np.abs(u).argmax(0), np.arange(len(e))] < 0, -1.0, 1.0)


def _whitened(c: np.ndarray, n: int, e: np.ndarray, u: np.ndarray) -> np.ndarray:
    return (c / n) @ u / np.sqrt(e)


def _moments(n: int, sums: np.ndarray, e: np.ndarray, u: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(e) * (len(e) + 1))
        for batch in batches:
            w = _whitened(_centred(batch, n, sums), n, e, u)
            total += np.concatenate([w.sum(0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

    return run


def _project(n: int, sums: np.ndarray, e: np.ndarray, u: np.ndarray):
    k = len(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = _centred(batch, n, sums)
            deviation = [str(x) for x in squares(c.T)]
            at = np.repeat(np.arange(len(c)), k)
            ids = batch.column(0).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(c))), pa.array(deviation, pa.string()).take(pa.array(at)), pa.array(_whitened(c, n, e, u).ravel())], names=["id", "component", "deviation", "whitened"])

    return run


def whiten(df: DataFrame, most: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per vector and component.

    x = floor(1024 * c) + 100000 for every entry c as double. Vectors that are null, empty or
    hold null or non-finite entries are left out, and so are those of another length than most
    have (of the longer, on a tie). ``deviation`` is the exact sum of (n * x - S) ** 2.
    Components without variance are left out, so equal vectors, or a single one, give no rows;
    so does an empty table. Repeated rows and null or equal ids are rows of their own; other
    columns are left out, whatever their names. Numbers that would leave 64 bits on the way
    raise an error instead of a wrong result.

    The table is read four times (lengths and sums, squares, the check, the output); nothing
    but sums is shuffled.
    """
    spark = df.sparkSession
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(fine).select(F.col(f"`{id_col}`").alias("id"), v.alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    size = rows.groupBy(F.size("v").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("m")).first()["m"]
    empty = spark.createDataFrame([], f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    if size is None:
        return empty
    n, d = size["count"], size["d"]
    rows = rows.where(F.size("v") == d)
    whole = _gathered(rows.select("v").mapInArrow(_sums, "i int, v string"))
    if max(map(abs, whole)) >= LIMIT:
        raise ArithmeticError("sums leave 64 bits")
    sums = np.array(whole, np.int64)
    pairs = _gathered(rows.select("v").mapInArrow(_squares(n, sums), "i int, v string"))
    cov = covariance(pairs, n, d)
    e, u = components(cov, most)
    if not len(e):
        return empty
    moments = rows.select("v").mapInArrow(_moments(n, sums, e, u), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    mean, square = np.split(np.array([x for _, x in sorted(moments)]) / n, [len(e)])
    error = float(np.abs(square.reshape(len(e), -1) - np.outer(mean, mean) - np.eye(len(e))).max())
    explained = F.array(*[F.lit(float(x / np.trace(cov))) for x in e])
    out = rows.mapInArrow(_project(n, sums, e, u), f"id {kind}, component int, deviation string, whitened double")
    return out.select("id", "component", F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", F.element_at(explained, F.col("component")).alias("explained"), F.lit(error).alias("identity_error"))
