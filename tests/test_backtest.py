import datetime as dt
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barline.operators import backtest as B
from barline.operators import disclosures as D


def day(i):
    return dt.date(2020, 1, 1) + dt.timedelta(days=i)


def label(series, spark, closes, at=0):
    e = spark.createDataFrame([("A", day(at))], "ticker string, exec_date date")
    return B.label_exits(series(A=closes), e, rules=B.ExitRules(slippage_bps=0, commission_pct=0)).first()


def test_stop_after_a_peak(series, spark):
    r = label(series, spark, [80, 84, 92, 96, 90, 86, 83, 81, 79])
    assert (r["exit_reason"], r["exit_date"]) == ("stop_loss", day(7))


def test_take_profit_then_hard_exit(series, spark):
    r = label(series, spark, [100, 126, 130, 141, 50])
    assert (r["exit_reason"], r["exit_date"], r["take_profit_date"]) == ("hard_exit", day(3), day(1))


def test_stop_is_checked_against_the_peak_before_today(series, spark):
    assert label(series, spark, [100, 99, 85.5, 84.9])["exit_date"] == day(3)
    assert label(series, spark, [100, 99, 98])["exit_reason"] == "end_of_backtest"


def test_open_trade_returns_equal_a_day_loop(series, spark):
    rng = np.random.default_rng(5)
    closes = {t: 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 60))) for t in "ABC"}
    trades = [(t, day(int(a)), day(int(a + h))) for t, a, h in zip(rng.choice(list("ABC"), 40), rng.integers(0, 40, 40), rng.integers(1, 19, 40))]
    got = {r["date"]: r["ret"] for r in B.open_trade_returns(series(**closes), spark.createDataFrame(trades, "ticker string, entry_date date, exit_date date")).collect()}
    for i in range(1, 60):
        rets = [closes[t][i] / closes[t][i - 1] - 1 for t, a, z in trades if a < day(i) <= z]
        assert (day(i) in got) == bool(rets)
        if rets:
            assert got[day(i)] == pytest.approx(np.mean(rets))


def test_crash_and_vol_paths(series):
    closes = [100 + i for i in range(40)]
    got = B.stressed(series(A=closes)).toPandas().pivot(index="date", columns="scenario", values="close")
    crash, vol = got["sudden_crash"].to_numpy(), got["high_vol_cluster"].to_numpy()
    assert crash[14] == pytest.approx(109 * 0.7) and crash[20] / crash[15] == pytest.approx(120 / 115)
    assert vol[10] == pytest.approx(109 * (110 / 109) ** 3) and vol[30] == 130
    assert got["missing_data"].isna().sum() == 2


def test_leverage_keeps_factors_below_zero(spark):
    df = spark.createDataFrame([("k", day(i), r) for i, r in enumerate([0.6, 0.1])], "k string, date date, ret double")
    assert B.leverage_decay(df, "k", -2.0).first()["final_nav"] == pytest.approx((1 - 1.2) * (1 - 0.2))


def test_cluster_counts_equal_brute_force_with_a_hot_ticker(spark):
    rng = np.random.default_rng(9)
    rows = [(str(i), f"p{rng.integers(12)}", "HOT" if rng.random() < 0.4 else f"T{rng.integers(5)}", day(int(rng.integers(120))), "buy" if rng.random() < 0.7 else "sell") for i in range(400)]
    df = spark.createDataFrame(rows, "id string, politician string, ticker string, disclosure_date date, transaction_type string")
    got = {r["id"]: r["cluster_count"] for r in D.cluster_counts(df).select("id", "cluster_count").collect()}
    for i, _, t, d, _ in rows:
        want = {p for _, p, u, e, k in rows if u == t and k == "buy" and 0 <= (d - e).days <= 30}
        assert got[i] == len(want)


def test_windows_stop_at_the_end_of_data(spark):
    cal = spark.createDataFrame([(day(i),) for i in range(365 * 4)], "date date")
    w = B.walk_windows(cal).orderBy("window_id").collect()
    assert w[0]["train_start"] == day(0) and len(w) == 2 and w[-1]["test_end"] <= day(365 * 4 - 1)


def test_first_rule_shadows_later_ones(spark):
    m = spark.createDataFrame([("x", "Senate Commerce Science and Transportation"), ("y", "Nothing")], "politician string, committee string")
    rules = [("Senate Commerce", ["Retail"]), ("Senate Commerce Science", ["Tech"])]
    assert [tuple(r) for r in D.covered_sectors(m, rules).collect()] == [("x", "Retail")]


def test_fill_delay_is_held_at_the_last_bar(spark):
    cal = spark.createDataFrame([(day(i),) for i in range(3)], "date date")
    sig = spark.createDataFrame([(day(0),), (day(2),), (day(9),)], "date date")
    got = {r["date"]: r["exec_date"] for r in B.fill_dates(sig, cal, 2).collect()}
    assert got == {day(0): day(2), day(2): day(2)}


def walked(close, entry, fill, r):
    """Exits bar by bar, an entry at a time."""
    out = []
    for e, f in zip(entry, fill):
        peak, half, end = f, -1, (len(close) - 1, "end_of_backtest")
        for t in range(e + 1, len(close)):
            before, peak = peak, max(peak, close[t])
            gain = (close[t] - f) / f * 100
            if (before - close[t]) / before * 100 >= r.stop:
                end = (t, "stop_loss")
                break
            if gain >= r.hard_exit:
                end = (t, "hard_exit")
                break
            if gain >= r.take_profit and half < 0:
                half = t
        out.append((*end, half))
    return out


RULES = [B.ExitRules(), B.ExitRules(stop=0.0, take_profit=5, hard_exit=9), B.ExitRules(stop=30, take_profit=40, hard_exit=25)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(80, 150).map(float), st.floats(1, 200)), min_size=1, max_size=70), st.sampled_from(RULES), st.sampled_from([0.0, 0.001, 0.08, -0.01]))
def test_first_passages_equal_the_walk(closes, rules, slip):
    close = np.array(closes)
    entry = np.arange(len(close))
    fill = close * (1 + slip)
    assert list(zip(*B._first_passages(close, entry, fill, rules))) == walked(close, entry, fill, rules)


def test_first_passages_grow_with_entries_not_with_bars_times_entries():
    rng = np.random.default_rng(1)
    rules = B.ExitRules(stop=99, take_profit=1e6, hard_exit=1e7)  # nothing ever leaves: the worst case of a walk

    def seconds(n):
        close = 100 + rng.random(n)
        began = time.perf_counter()
        B._first_passages(close, np.arange(n), close, rules)
        return time.perf_counter() - began

    small = min(seconds(20_000) for _ in range(3))
    assert min(seconds(160_000) for _ in range(3)) < 24 * small  # 8 times the entries; a walk takes 64 times as long


def test_bars_without_a_price_are_left_out(series, spark):
    got = B.label_exits(series(A=[100.0, np.nan, 90.0, 80.0], B=[np.nan, 0.0]), spark.createDataFrame([("A", day(0)), ("A", day(1)), ("B", day(0)), ("C", day(0))], "ticker string, exec_date date"))
    assert [(r["ticker"], r["entry_date"], r["exit_date"], r["exit_reason"]) for r in got.collect()] == [("A", day(0), day(3), "stop_loss")]
    none = spark.createDataFrame([], "ticker string, exec_date date")
    assert B.label_exits(series(A=[1.0, 2.0]), none).count() == 0
