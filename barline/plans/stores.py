"""Stores written twice and read back, and the provider."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barline.plans.registry import Tables, query
from barline.session import checkpoint_root
from barline.sources import stores
from barline.sources.provider import FolderProvider


def _path(t: Tables) -> str:
    return f"{checkpoint_root(t.spark)}/stores/{uuid.uuid4().hex}"


@query("store_append", "S16", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'first' ELSE 'second' END AS run FROM orders")
def _(t):
    rows, path = t.orders.select(F.col("o_orderkey").alias("id"), "o_orderstatus"), _path(t)
    stores.append_new(rows.where("o_orderstatus = 'F'").select("id", F.lit("first").alias("run")), path, "id", ["run"])
    stores.append_new(rows.select("id", F.lit("second").alias("run")), path, "id", ["run"])
    return t.spark.read.parquet(path)


@query("store_log", "S18", "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY event_type")
def _(t):
    path = _path(t)
    for _ in range(2):
        stores.append_log(t.events.select("event_id", "event_type"), path)
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("store_replace", "S17", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN -o_totalprice ELSE o_totalprice END AS price FROM orders")
def _(t):
    rows, path = t.orders.select(F.col("o_orderkey").alias("id"), "o_orderstatus", F.col("o_totalprice").alias("price")), _path(t)
    stores.replace(rows.select("id", "price", F.lit(1).alias("at")), path, ["id"], "at")
    stores.replace(rows.where("o_orderstatus = 'O'").select("id", (-F.col("price")).alias("price"), F.lit(1).alias("at")), path, ["id"], "at")
    return t.spark.read.parquet(path).select("id", "price")


@query("store_guard", "S20", "SELECT ticker, qty, ticker NOT IN (SELECT ticker FROM book) AS accepted FROM broker")
def _(t):
    path = _path(t)
    stores.open_guarded(t.book.select("ticker", "qty"), path, "ticker")
    return stores.open_guarded(t.broker.select("ticker", "qty"), path, "ticker")


@query("provider_tables", "X2", "SELECT 'constituents' AS name, count(*) AS n FROM constituents UNION ALL SELECT 'fundamentals', count(*) FROM fundamentals UNION ALL SELECT 'prices', count(*) FROM bars")
def _(t):
    path = _path(t)
    for name, df in (("constituents", t.constituents), ("fundamentals", t.fundamentals), ("prices", t.bars)):
        df.write.parquet(f"{path}/{name}.parquet")
    p = FolderProvider(t.spark, path)
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, df in (("constituents", p.constituents()), ("fundamentals", p.fundamentals()), ("prices", p.prices()))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])
