"""Technical indicators on bars(ticker, date, open, high, low, close, volume).

Every function adds columns computed from the rows up to and including each bar, and
all of them use the same partition and order, so one shuffle by ticker serves a chain
of them. Bars are unique on (ticker, date): a ticker holds at most one row per
calendar day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barline import config as cfg
from barline.functions import scalars as S
from barline.functions.series import ewm, full, over, rolling_extremes, rolling_means, so_far, spread, trailing


def by_bar() -> WindowSpec:
    return over("ticker")


def whole() -> WindowSpec:
    return by_bar().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)



def back(x: str | Column, n: int) -> Column:
    return F.lag(x, n).over(by_bar())


def bar_number() -> Column:
    return F.row_number().over(by_bar())


def sma(df: DataFrame, *sizes: int) -> DataFrame:
    return rolling_means(df, "close", {f"sma{n}": n for n in sizes})


def sma_slope(df: DataFrame, size: int = 200, lookback: int = 20) -> DataFrame:
    """Change of the average against ``lookback`` averages ago, 0 while there are too few."""
    past = back(f"sma{size}", lookback)
    return df.withColumn(f"sma{size}_slope", S.ratio_or(F.col(f"sma{size}") - past, past, 0.0) * 100)


def pct_returns(df: DataFrame, **bars_back: int) -> DataFrame:
    """name=bars: percent return over that many bars, 0 where history is short."""
    return df.withColumns({
        name: S.ratio_or(F.col("close") - back("close", n), back("close", n), 0.0) * 100 for name, n in bars_back.items()
    })


def momentum_12m_1m(df: DataFrame) -> DataFrame:
    far, near = back("close", 252), back("close", 21)
    return df.withColumn("ret_12m_1m", S.ratio_or(near - far, far, 0.0) * 100)


def moves(df: DataFrame) -> DataFrame:
    step = F.col("close") - back("close", 1)
    return df.withColumns({"_up": F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))), "_down": F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0)))})


def rsi_value() -> Column:
    """No losses gives 100, no movement at all gives 50."""
    return (
        F.when((F.col("_loss") == 0) & (F.col("_gain") == 0), 50.0)
        .when(F.col("_loss") == 0, 100.0)
        .otherwise(100.0 - 100.0 / (1.0 + F.try_divide(F.col("_gain"), F.col("_loss"))))
    )


def wilder(window: int = 14) -> list[tuple[str, str, float]]:
    return [("_up", "_gain", 1.0 / window), ("_down", "_loss", 1.0 / window)]


def spans(fast: int = 12, slow: int = 26) -> list[tuple[str, str, float]]:
    return [("close", "_fast", 2.0 / (fast + 1)), ("close", "_slow", 2.0 / (slow + 1))]


def rsi(df: DataFrame, window: int = 14) -> DataFrame:
    """Wilder-smoothed relative strength index."""
    return ewm(moves(df), wilder(window)).withColumn("rsi", rsi_value()).drop("_up", "_down", "_gain", "_loss")


def signal_line(df: DataFrame, signal: int = 9) -> DataFrame:
    df = ewm(df.withColumn("macd", F.col("_fast") - F.col("_slow")), [("macd", "macd_signal", 2.0 / (signal + 1))])
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_fast", "_slow")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    return signal_line(ewm(df, spans(fast, slow)), signal)


def oscillators(df: DataFrame) -> DataFrame:
    """RSI and MACD together: their four smoothed series share one set of windows."""
    df = ewm(moves(df), [*wilder(), *spans()]).withColumn("rsi", rsi_value())
    return signal_line(df).drop("_up", "_down", "_gain", "_loss")


def macd_state(df: DataFrame) -> DataFrame:
    side = F.when(F.col("macd_hist") > 0, "bullish").otherwise("bearish")
    wider = F.coalesce(F.abs("macd_hist") > F.abs(back("macd_hist", 1)), F.lit(False))
    return df.withColumn("macd_state", F.concat(side, F.when(wider, "_expanding").otherwise("_fading")))


def true_range(df: DataFrame) -> DataFrame:
    prev = back("close", 1)
    return df.withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))


def atr_pct(df: DataFrame, window: int = 14, fallback: float = cfg.SIZING.atr_fallback_pct) -> DataFrame:
    """``atr_pct`` is the rolling series; ``atr_pct_sized`` the value sizing uses, with its fallback."""
    df = true_range(df)
    series = F.try_divide(full(F.col("true_range"), by_bar(), window, F.avg), F.col("close")) * 100
    sized = F.when((bar_number() >= window + 1) & (F.col("close") > 0), series)
    return df.withColumns({"atr_pct": series, "atr_pct_sized": F.coalesce(sized, F.lit(fallback))}).drop("true_range")


def bollinger(df: DataFrame, window: int = 20, width: float = 2.0) -> DataFrame:
    mid, dev = full(F.col("close"), by_bar(), window, F.avg), full(F.col("close"), by_bar(), window, F.stddev_pop)
    low, high = mid - width * dev, mid + width * dev
    return df.withColumns({
        "bb_percent_b": F.try_divide(F.col("close") - low, high - low),
        "bb_bandwidth": F.try_divide(high - low, mid) * 100,
    })


def obv(df: DataFrame) -> DataFrame:
    signed = F.signum(F.coalesce(F.col("close") - back("close", 1), F.lit(0.0))) * F.col("volume")
    return df.withColumn("_sv", signed).withColumn("obv", F.sum("_sv").over(so_far(by_bar()))).drop("_sv")


def obv_trend(df: DataFrame, window: int = 20) -> DataFrame:
    return df.withColumn("obv_trend", direction(F.col("obv"), back("obv", window), "rising", "falling"))


def direction(now: Column, past: Column, up: str, down: str) -> Column:
    return F.when(now > past, up).when(now < past, down).otherwise("flat")


def rel_volume(df: DataFrame, window: int = 20) -> DataFrame:
    prior = by_bar().rowsBetween(-window, -1)
    base = F.when(F.count("volume").over(prior) == window, F.avg("volume").over(prior))
    return df.withColumn("rel_volume", S.ratio_or(F.col("volume"), base, 1.0))


def volume_confirms(df: DataFrame) -> DataFrame:
    moved = F.coalesce(F.col("close") != back("close", 1), F.lit(False))
    return df.withColumn("volume_confirms", moved & (F.col("rel_volume") > 1.0))


def pivots(df: DataFrame, k: int = 3) -> DataFrame:
    """Bars that equal the extreme of k bars on both sides; the last k bars never are one."""
    around = by_bar().rowsBetween(-k, k)
    whole = F.count(F.lit(1)).over(around) == 2 * k + 1
    return df.withColumns({
        "pivot_high": whole & (F.col("high") == F.max("high").over(around)),
        "pivot_low": whole & (F.col("low") == F.min("low").over(around)),
    })


def from_the_end(df: DataFrame) -> DataFrame:
    """Rank of each pivot counted from the newest, and the newest close on every row."""
    rev = so_far(over("ticker", desc=True))
    return df.withColumns({
        "_ph": F.when(F.col("pivot_high"), F.sum(F.col("pivot_high").cast("int")).over(rev)),
        "_pl": F.when(F.col("pivot_low"), F.sum(F.col("pivot_low").cast("int")).over(rev)),
        "last_close": F.last("close").over(whole()),
    })


def _pick(value: str, rank: str, n: int) -> Column:
    return F.max(F.when(F.col(rank) == n, F.col(value)))


def pivot_aggregates() -> dict[str, Column]:
    """Aggregates per ticker over ``from_the_end`` rows."""
    picks = {f"{name}{n}": _pick(value, rank, n)
             for name, value, rank in (("_h", "high", "_ph"), ("_l", "low", "_pl"), ("_hr", "rsi", "_ph"), ("_lr", "rsi", "_pl"))
             for n in (1, 2)}
    return picks | {
        "nearest_support": F.coalesce(F.max(F.when(F.col("pivot_low") & (F.col("low") < F.col("last_close")), F.col("low"))), F.min("low")),
        "nearest_resistance": F.coalesce(F.min(F.when(F.col("pivot_high") & (F.col("high") > F.col("last_close")), F.col("high"))), F.max("high")),
        "_swing_high": F.max("high"), "_swing_low": F.min("low"),
    }


def pivot_readings() -> dict[str, Column]:
    """Structure, divergence and swing levels from the aggregates above."""
    h1, h2, l1, l2 = (F.col(c) for c in ("_h1", "_h2", "_l1", "_l2"))
    structure = F.when((h1 > h2) & (l1 > l2), "HH_HL").when((h1 < h2) & (l1 < l2), "LH_LL").otherwise("range")
    divergence = (
        F.when((l1 < l2) & (F.col("_lr1") > F.col("_lr2")), "bullish")
        .when((h1 > h2) & (F.col("_hr1") < F.col("_hr2")), "bearish").otherwise("none")
    )
    both = h1.isNotNull() & l1.isNotNull()
    return {
        "market_structure": structure,
        "rsi_divergence": divergence,
        "fib_levels": S.fib_levels(F.when(both, h1).otherwise(F.col("_swing_high")), F.when(both, l1).otherwise(F.col("_swing_low"))),
    }


def pivot_summary(df: DataFrame) -> DataFrame:
    rows = from_the_end(pivots(rsi(df)))
    out = rows.groupBy("ticker").agg(*[c.alias(n) for n, c in pivot_aggregates().items()])
    return out.withColumns(pivot_readings()).select(
        "ticker", "market_structure", "rsi_divergence", "nearest_support", "nearest_resistance", "fib_levels")


def anchored(df: DataFrame) -> DataFrame:
    """Typical price and volume from the first lowest low on; null before it."""
    start = F.min(F.struct("low", "date")).over(whole())["date"]
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    on = F.col("date") >= start
    return df.withColumns({"_tv": F.when(on, typical * F.col("volume")), "_av": F.when(on, F.col("volume"))})


def vwap_aggregate() -> Column:
    return F.coalesce(F.try_divide(F.sum("_tv"), F.sum("_av")), F.max_by("close", "date"))


def anchored_vwap(df: DataFrame) -> DataFrame:
    return anchored(df).groupBy("ticker").agg(vwap_aggregate().alias("anchored_vwap"))


def weekly_trend(df: DataFrame, weeks: int = 30, back_points: int = 4) -> DataFrame:
    """Direction of the weekly average now against four averages ago, one row per ticker."""
    weekly = df.groupBy("ticker", S.week_ending_sunday(F.col("date")).alias("date")).agg(F.max_by("close", "date").alias("close"))
    avg = weekly.withColumn("_s", full(F.col("close"), by_bar(), weeks, F.avg))
    read = avg.withColumn("htf_trend", direction(F.col("_s"), F.lag("_s", back_points).over(by_bar()), "up", "down"))
    return read.groupBy("ticker").agg(F.max_by("htf_trend", "date").alias("htf_trend"))


def extremes_52w(df: DataFrame) -> DataFrame:
    df = rolling_extremes(df, "close", 252, "_hi", "_lo")
    c, high, low = F.col("close"), F.col("_hi"), F.col("_lo")
    return df.withColumns({"dist_high_pct": S.ratio_or(c - high, high, 0.0) * 100, "dist_low_pct": S.ratio_or(c - low, low, 0.0) * 100}).drop("_hi", "_lo")


def relative_strength(df: DataFrame, bench: str, **windows: int) -> DataFrame:
    """Own N-bar return minus that of ``bench``, both over the dates the two share.

    ``bench`` is a column already joined by date; null where the other side has no bar.
    """
    has = F.col(bench).isNotNull()
    w = Window.partitionBy("ticker", has).orderBy("date")

    def ret(c: str, n: int) -> Column:
        past = F.lag(c, n).over(w)
        return S.ratio_or(F.col(c) - past, past, 0.0) * 100

    return df.withColumns({name: F.when(has, ret("close", n) - ret(bench, n)) for name, n in windows.items()})


def bench_tail(market: DataFrame, window: int = 20) -> DataFrame:
    """Close of the newest bar and of the bar ``window`` before it, by position: two rows."""
    n = F.row_number().over(over("market_id", desc=True))
    return market.withColumn("_pos", n).where(F.col("_pos").isin(1, window + 1)).select("_pos", F.col("close").alias("_bench"))


def rs_line_slope(df: DataFrame, market: DataFrame, window: int = 20) -> DataFrame:
    """Slope of close / benchmark, aligned by position from the end, not by date."""
    n = F.row_number().over(over("ticker", desc=True))
    ends = df.withColumn("_pos", n).where(F.col("_pos").isin(1, window + 1))
    r = ends.join(F.broadcast(bench_tail(market, window)), "_pos").withColumn("_r", F.try_divide("close", "_bench"))
    out = r.groupBy("ticker").agg(_pick("_r", "_pos", 1).alias("_now"), _pick("_r", "_pos", window + 1).alias("_past"))
    return df.select("ticker").distinct().join(out, "ticker", "left").select(
        "ticker", direction(F.col("_now"), F.col("_past"), "rising", "falling").alias("rs_line_slope"))


def percentile_flags(df: DataFrame, col: str, against: Column, out: str, lookback: int = 252) -> DataFrame:
    """1 or 0 on the last ``lookback`` non-null values: at or below the value compared."""
    newest = F.count(col).over(so_far(over("ticker", desc=True)))
    inside = F.col(col).isNotNull() & (newest <= lookback)
    return df.withColumn(out, F.when(inside, (F.col(col) <= against).cast("double")))


def percentile_of_latest(df: DataFrame, col: str, value: str | None = None, lookback: int = 252) -> DataFrame:
    """Share (percent) of the last values at or below the newest one; 50 where there are none."""
    latest_value = F.last(value or col).over(whole())
    flagged = percentile_flags(df, col, F.coalesce(latest_value, F.lit(0.0)), "_f", lookback)
    return flagged.groupBy("ticker").agg((F.coalesce(F.avg("_f"), F.lit(0.5)) * 100).alias("percentile"))


def vol_pct_from_close(df: DataFrame, window: int = 14, fallback: float = 1.0) -> DataFrame:
    """Mean absolute daily return in percent over the last bars; 1.0 while there are too few."""
    df = df.withColumn("_ar", F.abs(F.try_divide(F.col("close") - back("close", 1), back("close", 1))))
    return df.withColumn("vol_pct", F.coalesce(full(F.col("_ar"), by_bar(), window, F.avg) * 100, F.lit(fallback))).drop("_ar")


def ma_conviction_delta(df: DataFrame, price: str) -> DataFrame:
    """-2 at or below the 200-bar mean, -1 at or below the 50-bar mean, +1 in an uptrend."""
    df = rolling_means(df, "close", {"_m50": 50, "_m200": 200})
    p = F.col(price)
    delta = (
        F.when(F.col("_m200").isNull(), 0).when(p <= F.col("_m200"), -2).when(p <= F.col("_m50"), -1)
        .when(F.col("_m50") > F.col("_m200"), 1).otherwise(0)
    )
    return df.withColumn("ma_delta", delta).drop("_m50", "_m200")


def live_momentum(df: DataFrame, least: int = 200) -> DataFrame:
    """Screener momentum over the bars given (twelve months): null with fewer than 200 bars."""
    n = F.row_number().over(over("ticker", desc=True))
    rows = df.where("close IS NOT NULL").withColumn("_p", n)
    g = rows.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("_n"), F.max_by("close", "date").alias("_now"), F.min_by("close", "date").alias("_first"),
        F.max("close").alias("_top"), _pick("close", "_p", 21).alias("_m1"), _pick("close", "_p", 126).alias("_m6"),
    )
    m1, m6 = F.coalesce("_m1", "_first"), F.coalesce("_m6", "_first")
    ok = F.col("_n") >= least

    def ret(a: Column, b: Column) -> Column:
        return F.when(ok & (b > 0), (F.try_divide(a, b) - 1) * 100)

    return g.select(
        "ticker", ret(F.col("_now"), m1).alias("mom_1m"), ret(F.col("_now"), F.col("_first")).alias("mom_12m"),
        ret(m1, m6).alias("mom_6m"), F.when(ok & (F.col("_top") > 0), F.try_divide("_now", "_top")).alias("high52_ratio"),
    )


def snapshot(bars: DataFrame, market: DataFrame, sectors: DataFrame | None = None, sector_bars: DataFrame | None = None) -> DataFrame:
    """One row of technical readings per ticker, as of its newest bar.

    All windows share the ticker partition; the newest bar and the pivots come out of one
    aggregate. Weekly bars are a second, much smaller branch.
    """
    df = bars.join(market.select("date", F.col("close").alias("_mkt")), "date", "left")
    if sectors is not None and sector_bars is not None:
        df = df.join(sectors.select("ticker", "sector"), "ticker", "left").join(
            sector_bars.select("sector", "date", F.col("close").alias("_sec")), ["sector", "date"], "left")
    else:
        df = df.withColumn("_sec", F.lit(None).cast("double"))
    df = sma(spread(df, ["ticker"]), 20, 50, 200)
    df = df.withColumns({f"sma{n}_known": F.coalesce(f"sma{n}", "close") for n in (20, 50, 200)})
    df = sma_slope(df)
    df = momentum_12m_1m(pct_returns(df, ret_1m=22, ret_3m=65, ret_6m=130))
    df = macd_state(oscillators(df))
    df = bollinger(atr_pct(df))
    df = volume_confirms(rel_volume(obv_trend(obv(df))))
    df = extremes_52w(df)
    df = relative_strength(df, "_mkt", rs_vs_market_3m=65, rs_vs_market_6m=130)
    df = relative_strength(df, "_sec", rs_vs_sector_3m=65)
    df = anchored(from_the_end(pivots(df)))
    df = df.withColumns({"_atr_last": F.last("atr_pct_sized").over(whole()), "_bw_last": F.coalesce(F.last("bb_bandwidth").over(whole()), F.lit(0.0))})
    df = percentile_flags(df, "atr_pct", F.col("_atr_last"), "_atr_flag")
    df = percentile_flags(df, "bb_bandwidth", F.col("_bw_last"), "_bw_flag")
    newest = [
        "close", "sma20_known", "sma50_known", "sma200_known", "sma200_slope", "ret_1m", "ret_3m", "ret_6m", "ret_12m_1m",
        "rsi", "macd_hist", "macd_state", "atr_pct_sized", "bb_percent_b", "bb_bandwidth", "rel_volume", "obv_trend", "volume_confirms",
        "dist_high_pct", "dist_low_pct",
    ]
    aligned = ["rs_vs_market_3m", "rs_vs_market_6m", "rs_vs_sector_3m"]
    agg = df.groupBy("ticker").agg(
        F.max_by(F.struct("date", *newest), "date").alias("_x"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c) for c in aligned],
        F.count(F.lit(1)).alias("bars_available"), vwap_aggregate().alias("anchored_vwap_from_low"),
        (F.coalesce(F.avg("_atr_flag"), F.lit(0.5)) * 100).alias("atr_pct_percentile_1y"),
        (F.coalesce(F.avg("_bw_flag"), F.lit(0.5)) * 100).alias("bb_bandwidth_percentile_1y"),
        *[c.alias(n) for n, c in pivot_aggregates().items()],
    )
    if sectors is not None and sector_bars is not None:
        known = sectors.join(sector_bars.select("sector").distinct(), "sector", "left_semi").select("ticker", F.lit(True).alias("_known"))
        agg = agg.join(known, "ticker", "left").withColumn(
            "rs_vs_sector_3m", F.when(F.col("_known"), F.coalesce("rs_vs_sector_3m", F.lit(0.0)))).drop("_known")
    agg = agg.withColumns(pivot_readings())
    agg = agg.join(weekly_trend(bars), "ticker").join(rs_line_slope(bars, market), "ticker")
    x = lambda c: F.col(f"_x.{c}")
    close, support, resistance = x("close"), F.col("nearest_support"), F.col("nearest_resistance")
    return agg.select(
        "ticker", x("date").alias("as_of"), close.alias("last_close"), "htf_trend", (close > x("sma200_known")).alias("htf_above_200d"),
        x("dist_high_pct").alias("dist_to_52w_high_pct"), x("dist_low_pct").alias("dist_to_52w_low_pct"),
        x("sma20_known").alias("sma20"), x("sma50_known").alias("sma50"), x("sma200_known").alias("sma200"),
        S.ma_alignment(x("sma20_known"), x("sma50_known"), x("sma200_known")).alias("ma_alignment"),
        x("sma200_slope").alias("sma200_slope_pct_20d"),
        S.pct_distance(close, x("sma20_known")).alias("price_vs_sma20_pct"), S.pct_distance(close, x("sma50_known")).alias("price_vs_sma50_pct"),
        "market_structure", x("ret_1m").alias("ret_1m_pct"), x("ret_3m").alias("ret_3m_pct"), x("ret_6m").alias("ret_6m_pct"),
        x("ret_12m_1m").alias("ret_12m_1m_pct"), S.tsmom_composite(x("ret_1m"), x("ret_3m"), x("ret_12m_1m")).alias("tsmom_composite"),
        x("rsi").alias("rsi14"), F.when(x("rsi") >= 70, "overbought").when(x("rsi") <= 30, "oversold").otherwise("neutral").alias("rsi_regime"),
        "rsi_divergence", x("macd_hist").alias("macd_hist"), x("macd_state").alias("macd_state"), x("atr_pct_sized").alias("atr_pct"),
        "atr_pct_percentile_1y", F.coalesce(x("bb_percent_b"), F.lit(0.5)).alias("bb_percent_b"), "bb_bandwidth_percentile_1y",
        x("rel_volume").alias("rel_volume_20d"), x("obv_trend").alias("obv_trend"), x("volume_confirms").alias("volume_confirms_move"),
        F.coalesce("rs_vs_market_3m", F.lit(0.0)).alias("rs_vs_spy_3m_pct"), F.coalesce("rs_vs_market_6m", F.lit(0.0)).alias("rs_vs_spy_6m_pct"),
        F.col("rs_vs_sector_3m").alias("rs_vs_sector_3m_pct"), "rs_line_slope", "nearest_support", "nearest_resistance",
        (S.ratio_or(close - support, support, 0.0) * 100).alias("dist_to_support_pct"),
        (S.ratio_or(resistance - close, close, 0.0) * 100).alias("dist_to_resistance_pct"),
        "fib_levels", "anchored_vwap_from_low", F.col("bars_available"), (F.col("bars_available") >= 250).alias("data_complete"),
        F.coalesce(x("bb_bandwidth") < 1e-9, F.lit(False)).alias("bb_bands_flat"),
    )
