"""Exact top-k inner products in three phases with a uniform threshold.

Vectors are cut into slices of dimensions; a score is the sum of the slices' partial scores.
Phase 1: every block gives each query's best partial scores of each slice, and the vectors
named there are scored in full; the k-th best is a cutoff that no better vector can miss.
Phase 2: a vector that reaches the cutoff has a partial score of at least its share of it in
some slice; all such entries are collected. Phase 3: their missing slices are looked up, the
scores are exact, and the k best stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from barline.llm.common import land

BLOCK = 8192
QUERIES = 2048
SLICES = 2
EXACT = float(1 << 52)


def quantised(vector: str, scale: int = 64) -> Column:
    """floor(scale * x) per component, x as double."""
    return F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * scale))


def _packed(df: DataFrame, size: int, name: str) -> DataFrame:
    """(block, dim, slice, ids, values): rows of one block as one matrix per slice."""
    n = df.count()
    dealt = df.withColumn("block", F.pmod(F.xxhash64("id", F.lit(name)), F.lit(max(1, -(-n // size)))))

    def pack(t: pa.Table) -> pa.Table:
        ids = t["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x = np.array(t["v"].to_pylist(), np.int64)[order]
        parts = np.array_split(x, min(SLICES, max(1, x.shape[1])), axis=1)
        k = len(parts)
        return pa.table({
            "block": pa.array([t["block"][0].as_py()] * k, pa.int64()), "dim": pa.array([x.shape[1]] * k, pa.int32()), "slice": pa.array(range(k), pa.int32()),
            "ids": pa.array([ids[order].tobytes()] * k), "values": pa.array([np.ascontiguousarray(p).tobytes() for p in parts]),
        })

    return land(dealt.withColumn("dim", F.size("v")).groupBy("block", "dim").applyInArrow(pack, "block long, dim int, slice int, ids binary, values binary"))


def _matrix(ids: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(values, np.int64).reshape(len(i), -1)


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: by float64 while no sum can leave its exact range."""
    high = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if high < EXACT:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def _rows(q: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.Table:
    return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.int64())})


def _best(t: pa.Table, k: int) -> pa.Table:
    """Phase 1: each query's k best partial scores of one slice in one block, itself left out."""
    row = t.to_pylist()[0]
    qi, q = _matrix(row["q_ids"], row["q_values"])
    ci, c = _matrix(row["c_ids"], row["c_values"])
    score = _product(q, c)
    score[qi[:, None] == ci[None]] = np.iinfo(np.int64).min
    take = min(k, len(ci))
    at = np.argpartition(-score, take - 1, axis=1)[:, :take]
    s, v = np.take_along_axis(score, at, 1).ravel(), ci[at].ravel()
    own = np.repeat(qi, take)
    ok = own != v
    return _rows(own[ok], v[ok], s[ok])


def _enough(t: pa.Table) -> pa.Table:
    """Phase 2: all entries of one slice in one block that reach the query's share."""
    row = t.to_pylist()[0]
    qi, q = _matrix(row["q_ids"], row["q_values"])
    ci, c = _matrix(row["c_ids"], row["c_values"])
    share = np.full(len(qi), np.iinfo(np.int64).min)
    if row["who"]:
        at = np.searchsorted(qi, np.array(row["who"]))
        share[at] = row["share"]
    score = _product(q, c)
    i, j = np.nonzero(score >= share[:, None])
    ok = qi[i] != ci[j]
    i, j = i[ok], j[ok]
    return _rows(qi[i], ci[j], score[i, j])


def _grid(q: DataFrame, c: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Query blocks against candidate blocks, slice by slice: one bounded task each."""
    left = q.select("dim", "slice", F.col("block").alias("qb"), F.col("ids").alias("q_ids"), F.col("values").alias("q_values"))
    if more is not None:
        left = left.join(more, ["qb", "dim"], "left")
    right = c.select("dim", "slice", F.col("block").alias("cb"), F.col("ids").alias("c_ids"), F.col("values").alias("c_values"))
    return left.join(right, ["dim", "slice"]).groupBy("qb", "cb", "slice", "dim")


def top_k(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "v") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the highest integer inner product.

    ``vector_col``: array<bigint>. ``is_query`` marks the queries; candidates are all rows but
    the query's own id. Ties go to the smaller vec_id; fewer rows than ``k`` give all. Rows
    with a null id, a null vector or null components take no part; vectors of other lengths
    than the query's are no candidates. Ids must be unique: of repeated ids the smallest
    vector is taken. An empty table gives no rows.
    """
    df = df.where(is_query.isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"), is_query.alias("asks"))
    df = df.where(F.col("id").isNotNull() & F.coalesce((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()), F.lit(False)))
    df = land(df.groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks")))
    c, q = _packed(df.drop("asks"), BLOCK, "c"), _packed(df.where("asks").drop("asks"), QUERIES, "q")
    found = "query_id long, vec_id long, score long"
    first = _grid(q, c).applyInArrow(lambda t: _best(t, k), found)
    named = first.select("query_id", "vec_id").distinct()
    vectors = df.select("id", "v")

    def full(pairs: DataFrame) -> DataFrame:
        """Exact scores of named pairs."""
        out = pairs.join(vectors.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), "query_id")
        out = out.join(vectors.select(F.col("id").alias("vec_id"), F.col("v").alias("cv")), "vec_id")
        dot = F.aggregate(F.zip_with("qv", "cv", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
        return out.withColumn("score", dot).select("query_id", "vec_id", "score")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = full(named).withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    slices = F.least(F.lit(SLICES), F.size("v"))
    own = df.select(F.col("id").alias("query_id"), slices.alias("all"))
    share = kth.join(own, "query_id").select("query_id", F.ceil(F.col("score") / F.col("all")).alias("share"))
    dims = q.select("block", "dim", "ids").dropDuplicates(["block", "dim"])
    who = dims.mapInArrow(_ids, "qb long, dim int, query_id long")
    cut = who.join(share, "query_id").groupBy("qb", "dim").agg(F.sort_array(F.collect_list(F.struct("query_id", "share"))).alias("c"))
    cut = cut.select("qb", "dim", F.col("c.query_id").alias("who"), F.col("c.share").alias("share"))
    entries = land(_grid(q, c, land(cut)).applyInArrow(_enough, found))
    known = entries.groupBy("query_id", "vec_id").agg(F.sum("score").alias("score"), F.count("*").alias("slices"))
    part = known.join(own, "query_id")
    part = land(part)
    exact = part.where("slices = all").select("query_id", "vec_id", "score")
    rest = part.where("slices < all").select("query_id", "vec_id")
    scores = exact.union(full(rest))
    best = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _ids(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(ids), pa.int64()), pa.array([row["dim"]] * len(ids), pa.int32()), pa.array(ids)], names=["qb", "dim", "query_id"])
