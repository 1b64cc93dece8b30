"""As-of joins, range joins and keyed merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.series import first_per_key


def asof_lookup(points: DataFrame, history: DataFrame, by: Sequence[str], at: str, time: str, cols: Sequence[str]) -> DataFrame:
    """For each distinct (by, at) of ``points``: the latest ``history`` row with time <= at.

    One sorted pass over the union, never a pair per (point, row). ``points`` is made
    distinct first, so a series holds at most two rows per date however many facts
    share that date. ``history`` must be unique on (by, time).
    """
    asked = points.select(*by, F.col(at).alias("_t")).distinct()
    payload = F.struct(F.col(time).alias("_found"), *cols)
    both = asked.select(*by, "_t", F.lit(1).alias("_ask"), F.lit(None).cast(
        history.select(payload.alias("p")).schema["p"].dataType).alias("_p")
    ).unionByName(history.select(*by, F.col(time).alias("_t"), F.lit(0).alias("_ask"), payload.alias("_p")))
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_t", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.withColumn("_p", F.last("_p", ignorenulls=True).over(w))
        .where("_ask = 1 AND _p IS NOT NULL")
        .select(*by, F.col("_t").alias(at), "_p.*")
    )


def asof_join(
    left: DataFrame, history: DataFrame, by: Sequence[str], at: str, time: str,
    cols: Sequence[str], how: str = "inner", since: str | None = None, found: str | None = None,
) -> DataFrame:
    """Attach the latest history row at or before ``at``; ``since`` bounds it from below."""
    points = left.select(*by, at) if since is None else left
    looked = asof_lookup(points, history, by, at, time, cols)
    out = left.join(looked, [*by, at], how)
    if since is not None:
        out = out.where(F.col("_found") >= F.col(since))
    return out.withColumnRenamed("_found", found) if found else out.drop("_found")


def snapshot_asof(dates: DataFrame, snapshots: DataFrame, at: str, time: str) -> DataFrame:
    """All rows of the latest snapshot date at or before each ``at``."""
    days = snapshots.select(F.col(time).alias("_s")).distinct()
    found = asof_lookup(dates, days, [], at, "_s", []).withColumnRenamed("_found", "_s")
    return found.join(snapshots.withColumnRenamed(time, "_s"), "_s").drop("_s")


def range_join(
    spans: DataFrame, points: DataFrame, by: Sequence[str], start: str, end: str, time: str, unit: str = "month"
) -> DataFrame:
    """Points inside [start, end] per key, as an equi-join on (key, calendar bucket).

    The bucket spreads a hot key over its months, and the remainder of the condition is
    checked on the matched rows, so nothing is paired outside its bucket.
    """
    trunc = lambda c: F.date_trunc(unit, F.col(c)).cast("date")
    cut = spans.withColumn("_bucket", F.explode(F.sequence(trunc(start), trunc(end), F.expr(f"INTERVAL 1 {unit}"))))
    return (
        cut.join(points.withColumn("_bucket", trunc(time)), [*by, "_bucket"])
        .where(F.col(time).between(F.col(start), F.col(end)))
        .drop("_bucket")
    )


def balanced_range_join(
    spans: DataFrame, points: DataFrame, by: Sequence[str], start: str, end: str, time: str, rows: int = 100_000
) -> DataFrame:
    """Points inside [start, end] per key, as an equi-join on (key, bucket), where a bucket holds
    about ``rows`` points: the data choose the cuts, not the calendar.

    Points are counted per (key, time) and numbered in time order; every ``rows`` numbers are a
    bucket. A time whose points run over several buckets deals them out by a hash of the
    row, so neither a hot key nor a hot day ends in one task; only rows that are equal in all
    columns stay together. A span is sent once per bucket that it overlaps, found from the
    counts at its two ends: as many as its result needs, and two more at most.

    Times are dates: a key has at most one count per calendar day, which is what the
    running sum orders. Null keys and times match nothing, nor does a span that ends before it
    starts; repeated rows on both sides pair up.
    """
    by = list(by)
    counts = points.where(F.col(time).isNotNull()).groupBy(*by, F.col(time).alias("_time")).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_time").rowsBetween(Window.unboundedPreceding, 0)
    marks = counts.withColumn("_upto", F.sum("_n").over(order))
    bucket = lambda number: F.floor(number / rows)
    first, last = bucket(F.col("_upto") - F.col("_n")), bucket(F.col("_upto") - 1)
    plain = [F.col(f"`{f.name}`") for f in points.schema if f.dataType.typeName() not in ("map", "variant")]
    dealt = points.join(marks.withColumnRenamed("_time", time), [*by, time])
    dealt = dealt.withColumn("_bucket", first + F.pmod(F.xxhash64(*plain), last - first + 1)).drop("_n", "_upto")

    asked = spans.select(*by, F.explode(F.array(start, end)).alias("_t"))
    looked = asof_lookup(asked, marks, by, "_t", "_time", ["_n", "_upto"])
    before = F.col("_upto") - F.when(F.col("_found") == F.col("_t"), F.col("_n")).otherwise(0)
    cut = spans.where(F.col(start) <= F.col(end)).join(looked.select(*by, F.col("_t").alias(start), before.alias("_before")), [*by, start], "left")
    cut = cut.join(looked.select(*by, F.col("_t").alias(end), "_upto"), [*by, end]).withColumn("_before", F.coalesce("_before", F.lit(0))).where("_upto > _before")
    cut = cut.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_before")), bucket(F.col("_upto") - 1)))).drop("_before", "_upto")
    return cut.join(dealt, [*by, "_bucket"]).where(F.col(time).between(F.col(start), F.col(end))).drop("_bucket")


def combine_first(new: DataFrame, old: DataFrame, key: Sequence[str]) -> DataFrame:
    """Union of keys; the new cell wins where it is not null."""
    cols = [c for c in old.columns if c not in key]
    o = old.select(*key, *[F.col(c).alias(f"_old_{c}") for c in cols])
    return new.join(o, list(key), "full_outer").select(
        *key, *[F.coalesce(F.col(c), F.col(f"_old_{c}")).alias(c) for c in cols]
    )


def fresh_rows(incoming: DataFrame, stored: DataFrame, key: str, stored_at: str | None = None, as_of=None, keep_days: int = 90) -> DataFrame:
    """Rows whose id is not stored (within the last ``keep_days`` before ``as_of``)."""
    if stored_at is not None:
        stored = stored.where(F.col(stored_at) >= F.date_sub(F.lit(as_of).cast("date"), keep_days))
    return incoming.join(stored.select(key), key, "left_anti")


def insert_or_ignore(incoming: DataFrame, stored: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    return fresh_rows(first_per_key(incoming, [key], order), stored, key)


def upsert(stored: DataFrame, incoming: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Last write per key wins over the union of both sides; on a tie the incoming row, and
    of several the one with the greatest values."""
    every = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rest = [c for c in every.columns if c not in [*key, "_new"]]
    plain = [c for c in rest if not every.schema[c].dataType.typeName() in ("map", "variant")]
    return every.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(order, "_new", *plain)).alias("_row")).select(*key, "_row.*")


def reconcile(book: DataFrame, broker: DataFrame, key: str = "ticker", qty: str = "qty") -> DataFrame:
    """Full outer of two books: ghost (only in ours), untracked (only theirs), matched."""
    b = broker.select(key, F.col(qty).alias("broker_qty"))
    side = F.when(F.col("broker_qty").isNull(), "ghost").when(F.col("book_qty").isNull(), "untracked").otherwise("matched")
    return book.select(key, F.col(qty).alias("book_qty")).join(b, key, "full_outer").withColumn("status", side)


def append_missing(primary: DataFrame, extra: DataFrame, key: Sequence[str]) -> DataFrame:
    """All primary rows plus the extra rows whose key the primary side lacks."""
    return primary.unionByName(extra.join(primary.select(*key), list(key), "left_anti"), allowMissingColumns=True)


def by_priority(df: DataFrame, page: Sequence[str], priority: str) -> DataFrame:
    """Per page keep only the rows of its best source."""
    best = df.groupBy(*page).agg(F.min(priority).alias("_best"))
    return df.join(best, list(page)).where(F.col(priority) == F.col("_best")).drop("_best")
