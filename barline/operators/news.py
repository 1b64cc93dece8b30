"""Headline table: filters, label lookup, facets, totals and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.operators.joins import upsert

STATES = ("buy", "neutral", "sell", "error")


def by_ticker(df: DataFrame, pattern: str) -> DataFrame:
    """Case-insensitive search; the text is a regular expression, as users rely on."""
    return df.where(F.coalesce(F.lower("ticker").rlike(pattern.strip().lower()), F.lit(False))) if pattern.strip() else df


def by_source_and_date(df: DataFrame, source: str = "all", start: str = "", end: str = "") -> DataFrame:
    """Exact source; dates are compared as text because the file may hold any text."""
    if source and source != "all":
        df = df.where(F.col("source") == source)
    if start:
        df = df.where(F.col("date") >= start)
    return df.where(F.col("date") <= end) if end else df


def with_labels(news: DataFrame, labels: DataFrame) -> DataFrame:
    """Left lookup by row_id. Labels must be unique on row_id (see ``latest_labels``)."""
    found = labels.select("row_id", "signal", "reasoning")
    return news.join(found, "row_id", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit("")) for c in ("signal", "reasoning")}
    )


def by_state(df: DataFrame, state: str) -> DataFrame:
    if state == "unprocessed":
        return df.where(F.col("signal") == "")
    return df.where(F.col("signal") == state) if state in STATES else df


def totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("signal") == "").alias("unprocessed"))


def facets(df: DataFrame) -> DataFrame:
    """Distinct sources and tickers of the unfiltered table in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("source", "ticker")]))
    return df.select(pairs.alias("p")).select("p.*").where("value IS NOT NULL").distinct().orderBy("facet", "value")


def page_of(df: DataFrame, number: int, order: str = "line_no", size: int = 50, block: int = 1 << 16) -> DataFrame:
    """One page in file order, without sorting the table or numbering it in one task.

    Blocks of the line number are counted (a partial aggregate) and summed up; only the
    blocks that overlap the page are numbered. Each of them holds at least one row of
    the page, so at most ``size`` blocks are picked, and that small side is broadcast.
    """
    start = (max(1, number) - 1) * size
    df = df.withColumn("_blk", F.floor(F.col(order) / block))
    counts = df.groupBy("_blk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    picked = counts.withColumn("_before", before).where(
        (F.col("_before") < start + size) & (F.col("_before") + F.col("_n") > start)
    )
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_blk").orderBy(order)) - 1
    return (
        df.join(F.broadcast(picked.select("_blk", "_before")), "_blk")
        .withColumn("_at", place)
        .where((F.col("_at") >= start) & (F.col("_at") < start + size))
        .drop("_blk", "_before", "_at")
    )


def normalise_label(df: DataFrame, raw: str = "raw_signal") -> DataFrame:
    """Lower-case label; anything outside the known values is neutral, error is kept."""
    low = F.lower(F.col(raw))
    return df.withColumn("signal", F.when(low.isin(*STATES), low).otherwise("neutral"))


def parsed_labels(df: DataFrame, response: str = "response") -> DataFrame:
    """Label and reason from a landed JSON answer; text that does not parse is an error."""
    got = F.from_json(response, "signal string, reason string, _corrupt string",
                      {"columnNameOfCorruptRecord": "_corrupt"})
    df = df.withColumn("_r", got).withColumn("_bad", F.col("_r._corrupt").isNotNull())
    low = F.lower(F.coalesce(F.col("_r.signal"), F.lit("neutral")))
    label = F.when(F.col("_bad"), "error").when(low.isin("buy", "neutral", "sell"), low).otherwise("neutral")
    return df.withColumns({"signal": label, "reasoning": F.coalesce(F.col("_r.reason"), F.lit(""))}).drop("_r", "_bad")


def latest_labels(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(stored, incoming, ["row_id"], "processed_at")


def digest(news: DataFrame, order: str = "line_no", items: int | None = None, titles: int | None = None) -> DataFrame:
    """Per ticker: its entries as a block of text, and its titles; the first ``items`` and
    ``titles`` of them where given.

    ``row_number`` with a bound lets Spark cut each ticker to its first rows before the
    shuffle, so a ticker with very many headlines sends only ``items`` per task.
    """
    w = Window.partitionBy("ticker").orderBy(order)
    top = news.withColumn("_rn", F.row_number().over(w))
    top = top if items is None else top.where(F.col("_rn") <= items)
    entry = F.concat(F.lit("- "), "title", F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit(": "), "summary")).otherwise(""))
    kept = top.where(F.coalesce("title", F.lit("")) != "").withColumn("_e", entry)
    sort = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda s: s["v"])
    return kept.groupBy("ticker").agg(
        F.array_join(sort(F.struct("_rn", F.col("_e").alias("v"))), "\n").alias("news_block"),
        F.array_join(sort(F.when(F.lit(True) if titles is None else F.col("_rn") <= titles, F.struct("_rn", F.col("title").alias("v")))), " | ").alias("headlines"),
        F.count(F.lit(1)).alias("scored"),
    )
