import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barline.operators import joins as J

D = dt.date


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_asof_takes_the_latest_row_at_or_before(spark):
    hist = spark.createDataFrame([("A", D(2020, 1, 1), 22.0), ("A", D(2020, 7, 15), 24.0), ("B", D(2020, 3, 1), 9.0)], "ticker string, date date, pe double")
    ask = spark.createDataFrame([("A", D(2020, 7, 14)), ("A", D(2020, 7, 15)), ("A", D(2019, 12, 31)), ("B", D(2021, 1, 1)), ("A", D(2020, 7, 14))], "ticker string, as_of date")
    got = J.asof_join(ask, hist, ["ticker"], "as_of", "date", ["pe"])
    assert rows(got.select("ticker", "as_of", "pe"), "ticker", "as_of") == [("A", D(2020, 7, 14), 22.0), ("A", D(2020, 7, 14), 22.0), ("A", D(2020, 7, 15), 24.0), ("B", D(2021, 1, 1), 9.0)]
    assert J.asof_join(ask, hist, ["ticker"], "as_of", "date", ["pe"], how="left").count() == 5


def test_asof_lower_bound(spark):
    hist = spark.createDataFrame([(D(2020, 1, 1), "bull")], "date date, label string")
    ask = spark.createDataFrame([(D(2020, 2, 1), D(2020, 1, 15)), (D(2020, 2, 1), D(2019, 12, 1))], "d date, since date")
    assert J.asof_join(ask, hist, [], "d", "date", ["label"], since="since").count() == 1


def test_snapshot_returns_every_row_of_the_latest_date(spark):
    snaps = spark.createDataFrame([(D(2020, 1, 1), t) for t in ("AAPL", "MSFT", "ENRN")] + [(D(2020, 7, 1), t) for t in ("AAPL", "MSFT")], "date date, ticker string")
    ask = spark.createDataFrame([(D(2020, 6, 30),), (D(2020, 7, 1),), (D(2019, 1, 1),)], "as_of date")
    got = rows(J.snapshot_asof(ask, snaps, "as_of", "date").groupBy("as_of").count(), "as_of")
    assert got == [(D(2020, 6, 30), 3), (D(2020, 7, 1), 2)]


def test_range_join_crosses_buckets_and_keeps_edges(spark):
    pts = spark.createDataFrame([("A", D(2020, 1, 31) + dt.timedelta(days=i)) for i in range(40)], "k string, date date")
    spans = spark.createDataFrame([("A", D(2020, 1, 31), D(2020, 3, 1)), ("B", D(2020, 1, 1), D(2020, 3, 1))], "k string, a date, z date")
    assert J.range_join(spans, pts, ["k"], "a", "z", "date").count() == 31


def test_combine_first_and_upsert(spark):
    new = spark.createDataFrame([(1, None, 5), (2, 7, 7)], "k int, a int, b int")
    old = spark.createDataFrame([(1, 9, 9), (3, 3, 3)], "k int, a int, b int")
    assert rows(J.combine_first(new, old, ["k"]), "k") == [(1, 9, 5), (2, 7, 7), (3, 3, 3)]
    stored = spark.createDataFrame([("x", "old", 1), ("y", "keep", 5)], "id string, v string, at int")
    inc = spark.createDataFrame([("x", "new", 2), ("y", "late", 4)], "id string, v string, at int")
    assert rows(J.upsert(stored, inc, ["id"], "at").select("id", "v"), "id") == [("x", "new"), ("y", "keep")]


def test_insert_or_ignore_keeps_first_of_a_hot_key(spark):
    inc = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("key"), F.col("id").alias("pos"))
    got = J.insert_or_ignore(inc, spark.createDataFrame([("k1",)], "key string"), "key", ["pos"])
    assert got.where("key = 'hot'").collect()[0]["pos"] == 0
    assert got.where("key = 'k1'").count() == 0
    assert got.count() == 1 + 1333 - 1


def test_fallback_by_page(spark):
    df = spark.createDataFrame([(1, 2, "html"), (1, 1, "json"), (2, 2, "html")], "page int, priority int, src string")
    assert rows(J.by_priority(df, ["page"], "priority").select("page", "src"), "page") == [(1, "json"), (2, "html")]


@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("size", [1, 7, 1000])
def test_balanced_range_join_equals_brute_force(spark, by, size):
    rng = random.Random(size)
    at = lambda: D(2021, 1, 1) + dt.timedelta(days=rng.randrange(60))
    points = [(i, rng.choice("ab"), D(2021, 2, 1) if rng.random() < 0.4 else at()) for i in range(200)] + [(900, None, at()), (901, "a", None), (902, "a", D(2021, 1, 5)), (902, "a", D(2021, 1, 5))]
    spans = [(i, rng.choice("abc"), *sorted([at(), at()])) for i in range(25)] + [(50, "a", D(2021, 2, 1), D(2021, 2, 1)), (51, "a", D(2021, 3, 1), D(2021, 2, 1)), (52, "b", D(2019, 1, 1), D(2030, 1, 1)), (53, None, D(2019, 1, 1), D(2030, 1, 1)), (54, "a", D(2022, 1, 1), D(2023, 1, 1)), (50, "a", D(2021, 2, 1), D(2021, 2, 1))]
    p = spark.createDataFrame(points, "id int, k string, date date")
    s = spark.createDataFrame(spans, "span int, k string, a date, z date")
    if not by:
        p, s = p.drop("k"), s.drop("k")
    got = rows(J.balanced_range_join(s, p, by, "a", "z", "date", size).select("span", "id"), "span", "id")
    same = lambda x, y: not by or (x is not None and x == y)
    want = sorted((n, i) for n, k, a, z in spans for i, l, d in points if same(k, l) and d is not None and a <= d <= z)
    assert got == want


def test_a_hot_day_is_dealt_over_buckets(spark):
    p = spark.range(1000).select(F.col("id"), F.lit("2021-02-01").cast("date").alias("date"))
    s = spark.createDataFrame([(1, D(2021, 1, 1), D(2021, 12, 31))], "span int, a date, z date")
    plan = J.balanced_range_join(s, p, [], "a", "z", "date", 100)
    assert plan.count() == 1000
    none = spark.createDataFrame([], "id long, date date")
    assert J.balanced_range_join(s, none, [], "a", "z", "date").count() == 0 and J.balanced_range_join(s.limit(0), p, [], "a", "z", "date").count() == 0
