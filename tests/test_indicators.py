import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.functions.series import avg_tie_pct_rank, ewm
from barline.operators import indicators as I


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(7)
    return 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 1500)))


@pytest.mark.parametrize("alpha", [1 / 14, 2 / 13, 2 / 27, 0.2])
def test_ewm_equals_pandas_over_many_blocks(series, walk, alpha):
    got = ewm(series(A=walk), [("close", "y", alpha)]).orderBy("date").toPandas()["y"]
    want = pd.Series(walk).ewm(alpha=alpha, adjust=False).mean()
    assert np.allclose(got, want, rtol=1e-12)


def test_ewm_starts_at_the_first_value(series, walk):
    df = series(A=walk[:600]).withColumn("x", F.when(F.col("date") >= F.lit("2020-01-04").cast("date"), F.col("close")))
    got = ewm(df, [("x", "y", 0.1)]).orderBy("date").toPandas()["y"]
    want = pd.Series(np.r_[[np.nan] * 3, walk[3:600]]).ewm(alpha=0.1, adjust=False).mean()
    assert got[:3].isna().all() and np.allclose(got[3:], want[3:], rtol=1e-12)


def test_rsi_extremes(series):
    got = {r["ticker"]: r["rsi"] for r in I.rsi(series(UP=range(1, 40), FLAT=[5] * 40)).groupBy("ticker").agg(F.max_by("rsi", "date").alias("rsi")).collect()}
    assert got == {"UP": 100.0, "FLAT": 50.0}


def ohlc(df):
    return df.withColumns({"high": F.col("close") * 1.01, "low": F.col("close") * 0.99, "open": F.col("close"), "volume": F.lit(100.0) + F.day("date")})


@pytest.mark.parametrize("fn, cols", [
    (lambda d: I.sma_slope(I.sma(d, 20, 50, 200)), ["sma20", "sma200", "sma200_slope"]),
    (lambda d: I.macd_state(I.oscillators(d)), ["rsi", "macd_hist", "macd_state"]),
    (lambda d: I.bollinger(I.atr_pct(d)), ["atr_pct", "atr_pct_sized", "bb_percent_b"]),
    (lambda d: I.volume_confirms(I.rel_volume(I.obv_trend(I.obv(d)))), ["obv", "obv_trend", "rel_volume", "volume_confirms"]),
    (lambda d: I.extremes_52w(I.momentum_12m_1m(I.pct_returns(d, r=22))), ["r", "ret_12m_1m", "dist_high_pct"]),
])
def test_causal(series, walk, fn, cols):
    """The last row is the same whether or not later bars exist."""
    def at(n):
        df = fn(ohlc(series(A=walk[:n])))
        return df.orderBy("date").select(*cols).collect()[399]

    assert tuple(at(400)) == tuple(at(700))


def test_pivots_tie_and_edges(series):
    got = I.pivots(ohlc(series(A=[1, 2, 3, 9, 3, 2, 1, 2, 9, 9, 2, 1, 0, 5]))).orderBy("date").toPandas()
    assert list(got.index[got["pivot_high"]]) == [3, 8, 9]


def test_percentile_rank_has_average_ties(spark):
    x = [3.0, 1.0, 3.0, None, 2.0, 3.0]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double").select("i", avg_tie_pct_rank("v", []).alias("r")).orderBy("i").toPandas()["r"]
    want = pd.Series(x, dtype=float).rank(pct=True)
    assert np.allclose(got, want, equal_nan=True)


def test_snapshot_has_one_complete_row(series, walk):
    bars = ohlc(series(A=walk[:300], B=walk[:100]))
    market = bars.where("ticker = 'A'").select(F.lit("M").alias("market_id"), "date", "close")
    got = {r["ticker"]: r for r in I.snapshot(bars, market).collect()}
    assert got["A"]["data_complete"] and not got["B"]["data_complete"]
    assert got["A"]["rs_vs_spy_3m_pct"] == pytest.approx(0.0) and got["A"]["rs_vs_sector_3m_pct"] is None
    assert set(got["A"]["fib_levels"]) == {"38.2", "50.0", "61.8"}
    assert got["A"]["rsi14"] == pytest.approx(I.rsi(bars.where("ticker = 'A'")).orderBy(F.desc("date")).first()["rsi"])


def test_rolling_means_and_extremes_equal_pandas(series, walk):
    from barline.functions.series import rolling_extremes, rolling_means

    df = rolling_means(series(A=walk[:700], B=walk[700:720]), "close", {"m": 20})
    got = rolling_extremes(df, "close", 252, "hi", "lo").orderBy("ticker", "date").toPandas()
    for name, part in got.groupby("ticker"):
        c = part["close"]
        assert np.allclose(part["m"], c.rolling(20).mean(), rtol=1e-12, equal_nan=True), name
        assert (part["hi"] == c.rolling(252, min_periods=1).max()).all() and (part["lo"] == c.rolling(252, min_periods=1).min()).all()
