"""Cross-sectional factor screen, live or over many rebalance dates at once.

Every cross-section is keyed by its date, and ranks run on one row per (date, ticker,
metric), partitioned by (date, metric): a partition holds the listed universe of one
date for one metric, which does not grow with history.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline import config as cfg
from barline.functions import scalars as S
from barline.functions.series import avg_tie_pct_rank, over, trailing
from barline.operators.joins import asof_lookup, snapshot_asof

PRIMARY = ["pe_inv", "pb_inv", "fcf_yield", "roe", "margin", "de_inv"]
VALUE = ["pe_inv", "pb_inv", "fcf_yield", "evebitda_inv"]
QUALITY = ["roe", "gross_margin", "margin", "de_inv", "current_ratio", "earnings_growth"]
MOMENTUM = ["mom_12m", "mom_6m", "high52_ratio"]
INFO = [
    "trailingPE", "priceToBook", "freeCashflow", "marketCap", "returnOnEquity", "profitMargins", "debtToEquity",
    "enterpriseToEbitda", "grossMargins", "currentRatio", "earningsGrowth",
]
MIN_METRICS, MIN_SECTOR = 4, 5


def date_list(dates: Sequence[str | date]) -> Column:
    return F.array(*[F.lit(str(d)).cast("date") for d in sorted(map(str, dates))])


def date_table(spark: SparkSession, dates: Sequence[str | date], name: str = "as_of") -> DataFrame:
    return spark.range(1).select(F.explode(date_list(dates)).alias(name))


def project(infos: DataFrame) -> DataFrame:
    """Raw info fields to factor columns: lower-is-better ratios are negated, bad ones null."""
    have = {c: S.safe_double(F.col(c)) if c in infos.columns else F.lit(None).cast("double") for c in INFO}
    df = infos.withColumns(have)
    c = F.col
    neg = lambda x: F.when(c(x) > 0, -c(x))
    keep = [k for k in infos.columns if k not in INFO and k != "sector"]
    sector = F.when(F.trim(F.coalesce("sector", F.lit("Unknown"))) != "", F.trim("sector")) if "sector" in infos.columns else F.lit(None)
    return df.select(
        *keep, F.coalesce(sector, F.lit("Unknown")).alias("sector"),
        neg("trailingPE").alias("pe_inv"), neg("priceToBook").alias("pb_inv"),
        F.when((c("freeCashflow") != 0) & (c("marketCap") > 0), F.try_divide("freeCashflow", "marketCap")).alias("fcf_yield"),
        neg("enterpriseToEbitda").alias("evebitda_inv"), c("returnOnEquity").alias("roe"), c("grossMargins").alias("gross_margin"),
        c("profitMargins").alias("margin"), F.when(c("debtToEquity") >= 0, -c("debtToEquity")).alias("de_inv"),
        c("currentRatio").alias("current_ratio"), c("earningsGrowth").alias("earnings_growth"),
    )


def complete_enough(df: DataFrame) -> DataFrame:
    present = F.filter(F.array(*PRIMARY), lambda x: x.isNotNull())
    return df.where(F.size(present) >= MIN_METRICS)


def sector_or_universe_rank(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Percentile rank within the sector where it has five members, else in the universe.

    Rows are unpivoted so that metrics rank in parallel and share one sort per scope.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    rows = df.select(*keys, "ticker", "sector", cells.alias("_c")).select(*keys, "ticker", "sector", "_c.*")
    scope = [*keys, "metric"]
    members = F.count(F.lit(1)).over(Window.partitionBy(*scope, "sector"))
    pick = F.when(F.col("_members") >= MIN_SECTOR, F.col("_in_sector")).otherwise(F.col("_in_universe"))
    return (
        rows.withColumn("_in_universe", avg_tie_pct_rank("value", scope))
        .withColumns({"_in_sector": avg_tie_pct_rank("value", [*scope, "sector"]), "_members": members})
        .withColumn("rank", pick).drop("_in_universe", "_in_sector", "_members")
    )


def _mean(cols: Sequence[str]) -> Column:
    """Mean of the non-null ranks, added in a fixed order; null where there are none."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    n = sum((F.col(c).isNotNull().cast("int") for c in cols[1:]), F.col(cols[0]).isNotNull().cast("int"))
    return F.try_divide(total, n)


def composite(df: DataFrame, keys: Sequence[str], regime: str | None = None) -> DataFrame:
    """Component scores 0-33 (truncated) and the regime-weighted composite 0-99 (half-even)."""
    metrics = [*VALUE, *QUALITY, *MOMENTUM]
    ranked = sector_or_universe_rank(complete_enough(df), keys, metrics)
    wide = ranked.groupBy(*keys, "ticker").agg(
        F.first("sector").alias("sector"), *[F.max(F.when(F.col("metric") == m, F.col("rank"))).alias(m) for m in metrics])
    neutral = sum((F.coalesce(m, F.lit(0.5)) for m in MOMENTUM[1:]), F.coalesce(MOMENTUM[0], F.lit(0.5))) / 3
    points = lambda x: S.clamp(F.coalesce(x * 33, F.lit(0.0)), 0.0, 33.0).cast("int")
    wv, wm, wq = cfg.REGIME_WEIGHTS.get(regime or "", cfg.DEFAULT_WEIGHTS)
    scored = wide.select(*keys, "ticker", "sector", points(_mean(VALUE)).alias("value_score"), points(neutral).alias("momentum_score"), points(_mean(QUALITY)).alias("quality_score"))
    mix = F.col("value_score") * 3 * wv + F.col("momentum_score") * 3 * wm + F.col("quality_score") * 3 * wq
    return scored.withColumn("composite_score", S.clamp(F.bround(mix, 0), 0.0, 99.0).cast("int"))


def top_n(scored: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Best n per key; the first ticker wins a tie. Spark cuts each task to n before the shuffle."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("composite_score"), "ticker")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def screen(infos: DataFrame, momentum: DataFrame, keys: Sequence[str], n: int = 12, regime: str | None = None) -> DataFrame:
    """Score one or many cross-sections of info rows and keep the best n of each."""
    df = project(infos).join(momentum.select(*keys, "ticker", *MOMENTUM), [*keys, "ticker"], "left")
    return top_n(composite(df, keys, regime), keys, n)


def pit_momentum(bars: DataFrame, dates: Sequence[str | date], lookback: int = 365, least: int = 60) -> DataFrame:
    """Momentum of every ticker at every date from the bars of the window before it.

    Lags are taken once per bar. Each bar then counts into the windows it falls in, and
    because rows are already placed by ticker, that aggregate needs no second shuffle.
    A lag of k bars lies inside a window exactly when the window has more than k bars.
    """
    w = over("ticker")
    close = F.col("close")
    ar = F.abs(F.try_divide(close - F.lag("close", 1).over(w), F.lag("close", 1).over(w)))
    rows = bars.where("close IS NOT NULL").select("ticker", "date", "close").withColumn("_ar", ar).withColumns({
        "_p20": F.lag("close", 20).over(w), "_p125": F.lag("close", 125).over(w), "_p251": F.lag("close", 251).over(w),
        "_vol": F.avg("_ar").over(trailing(w, 14)) * 100,
    })
    days = lookback + 40
    inside = F.filter(date_list(dates), lambda d: (d >= F.col("date")) & (d <= F.date_add("date", days)))
    g = rows.withColumn("as_of", F.explode(inside)).groupBy("ticker", "as_of").agg(
        F.count(F.lit(1)).alias("_n"), F.max("close").alias("_top"), F.max_by(F.struct("close", "_p20", "_p125", "_p251", "_vol"), "date").alias("_x"),
        F.count_if(F.col("date") >= F.date_sub("as_of", 40)).alias("_recent"),
    )
    x = lambda c: F.col(f"_x.{c}")

    def ret(a: Column, b: Column, bars_needed: int) -> Column:
        return F.when((F.col("_n") >= max(least, bars_needed)) & (b > 0), (F.try_divide(a, b) - 1) * 100)

    return g.select(
        "ticker", "as_of", ret(x("close"), x("_p20"), 21).alias("mom_1m"), ret(x("close"), x("_p251"), 252).alias("mom_12m"),
        ret(x("_p20"), x("_p125"), 126).alias("mom_6m"),
        F.when((F.col("_n") >= least) & (F.col("_top") > 0), F.try_divide(x("close"), F.col("_top"))).alias("high52_ratio"),
        F.when(F.col("_recent") >= 15, x("_vol")).otherwise(1.0).alias("vol_pct"),
    )


def pit_screen(
    bars: DataFrame, fundamentals: DataFrame, constituents: DataFrame, sectors: DataFrame,
    dates: Sequence[str | date], n: int = 20, regime: str | None = None,
) -> DataFrame:
    """Point-in-time screen: at each date only rows published by then are seen."""
    spark = bars.sparkSession
    universe = snapshot_asof(date_table(spark, dates), constituents, "as_of", "date").select("as_of", "ticker")
    fields = [c for c in fundamentals.columns if c not in ("ticker", "date")]
    infos = asof_lookup(universe, fundamentals, ["ticker"], "as_of", "date", fields).drop("_found")
    infos = infos.join(sectors.select("ticker", "sector"), "ticker", "left")
    momentum = pit_momentum(bars, dates)
    top = screen(infos, momentum, ["as_of"], n, regime)
    sized = top.join(momentum.select("as_of", "ticker", "vol_pct"), ["as_of", "ticker"], "left")
    return sized.withColumn("position_pct", S.vol_target_pct(F.coalesce("vol_pct", F.lit(1.0)))).drop("vol_pct")
