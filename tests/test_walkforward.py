import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.operators import backtest as B
from barline.operators import walkforward as W

DAY0 = dt.date(2020, 1, 1)


def day(i):
    return DAY0 + dt.timedelta(days=i)


@pytest.fixture
def one_window(spark):
    return spark.createDataFrame([(0, day(0), day(9), day(10), day(19))], "window_id int, train_start date, train_end date, test_start date, test_end date")


def book(spark, series, one_window, closes, sizes, scenarios, rules=B.ExitRules(slippage_bps=0, commission_pct=0), slip=0.0):
    bars = series(**{k: [100.0] * 10 + v for k, v in closes.items()})
    days = B.signals_in_windows(bars.select("date").distinct(), one_window).select("window_id", "date")
    sized = spark.createDataFrame([(0, k, day(10 + at), pct, 6, "bull") for k, at, pct in sizes], "window_id int, ticker string, date date, position_pct double, conviction int, regime_label string")
    paths = W.scenario_bars(bars, one_window, scenarios, slip)
    trades = W.scenario_trades(paths, W.scenario_entries(sized, days, scenarios), rules)
    rets = W.book_returns(paths, trades, days, rules.commission_pct)
    return trades, {r["date"]: r["ret"] for r in rets.orderBy("date").collect()}, rets


def test_sizes_weigh_the_returns(spark, series, one_window):
    base = [B.Scenario("base", fill_delay=1)]
    flat, up = [100.0] * 10, [100.0, 100.0, 110.0] + [110.0] * 7
    trades, ret, _ = book(spark, series, one_window, {"A": up, "B": flat}, [("A", 0, 20.0), ("B", 0, 10.0)], base)
    assert trades.count() == 2 and ret[day(12)] == pytest.approx(0.2 * 0.10)
    assert len(ret) == 10 and sum(v != 0 for v in ret.values()) == 1


def test_books_over_a_hundred_percent_are_scaled_down(spark, series, one_window):
    base = [B.Scenario("base", fill_delay=0)]
    up = [100.0, 110.0] + [110.0] * 8
    _, ret, rows = book(spark, series, one_window, {"A": up, "B": up}, [("A", 0, 150.0), ("B", 0, 50.0)], base)
    assert ret[day(11)] == pytest.approx(0.10)
    assert rows.agg(F.max("invested_pct")).first()[0] == 100.0


def test_half_is_sold_at_the_take_profit_and_costs_are_paid(spark, series, one_window):
    rules = B.ExitRules(slippage_bps=0, commission_pct=1.0)
    base = [B.Scenario("base", fill_delay=0)]
    path = [100.0, 126.0, 126.0 * 1.05, 141.0, 141.0, 150.0, 150.0, 150.0, 150.0, 150.0]
    trades, ret, _ = book(spark, series, one_window, {"A": path}, [("A", 0, 10.0)], base, rules)
    t = trades.first()
    assert (t["take_profit_date"], t["exit_date"], t["exit_reason"]) == (day(11), day(13), "hard_exit")
    assert ret[day(11)] == pytest.approx(0.10 * 0.26 - 0.05 * 0.01)
    assert ret[day(12)] == pytest.approx(0.05 * 0.05)
    assert ret[day(13)] == pytest.approx(0.05 * (141.0 / 132.3 - 1) - 0.05 * 0.01)
    assert ret[day(15)] == 0


def test_scenarios_change_delay_slippage_and_bars(spark, series, one_window):
    path = [100.0 + i for i in range(10)]
    kinds = [B.Scenario("base", fill_delay=1), B.Scenario("late", fill_delay=3), B.Scenario("dear", slippage_multiplier=5.0), B.Scenario("gaps", drop_fraction=0.2)]
    trades, _, rets = book(spark, series, one_window, {"A": path}, [("A", 0, 10.0), ("A", 8, 10.0)], kinds, slip=10.0)
    got = {(r["scenario"], r["date"]): r for r in trades.collect()}
    assert got["base", day(10)]["entry_date"] == day(11) and got["late", day(10)]["entry_date"] == day(13)
    assert got["late", day(18)]["entry_date"] == day(19)  # held at the window's last bar
    assert got["dear", day(10)]["entry_price"] == pytest.approx(100 * 1.005)
    paths = W.scenario_bars(series(A=[100.0] * 10 + path), one_window, kinds, 10.0)
    assert {r["scenario"]: r["n"] for r in paths.groupBy("scenario").agg(F.count("*").alias("n")).collect()} == {"base": 10, "late": 10, "dear": 10, "gaps": 8}


def test_stress_starts_at_a_quarter_of_each_window(spark, series):
    wins = spark.createDataFrame([(0, day(0), day(7)), (1, day(0), day(15))], "window_id int, test_start date, test_end date")
    rows = W.scenario_bars(series(A=[100.0] * 16), wins, [B.Scenario("crash", crash_pct=0.5, crash_bars=2)]).orderBy("window_id", "date").collect()
    first = {w: min(r["date"] for r in rows if r["window_id"] == w and r["close"] < 100) for w in (0, 1)}
    assert first == {0: day(2), 1: day(4)} and rows[-1]["close"] == pytest.approx(50)


def test_states_of_a_window_come_from_its_own_training_bars(spark):
    rng = np.random.default_rng(3)
    calm, wild = rng.normal(0.5, 0.2, 60), rng.normal(-1.5, 0.2, 60)
    x = np.concatenate([calm[:30], wild[:30], calm[30:], wild[30:]])
    rows = spark.createDataFrame([(day(i), float(v), float(v)) for i, v in enumerate(x)], "date date, x double, ret double")
    w = spark.createDataFrame([(0, day(0), day(79), day(80), day(119)), (1, day(20), day(99), day(100), day(119))], "window_id int, train_start date, train_end date, test_start date, test_end date")
    scaled, models = W.window_models(rows, w, ["x"], ks=(2,), iterations=15, restarts=1)
    got = W.window_states(scaled, models, ["x"]).orderBy("window_id", "date").collect()
    assert [r["window_id"] for r in got].count(0) == 40 and [r["window_id"] for r in got].count(1) == 20
    low, high = (set(r["regime_label"] for r in got if (x[(r["date"] - DAY0).days] > 0) == up) for up in (False, True))
    assert len(low) == len(high) == 1 and low != high
    # later bars change neither the model nor the earlier states
    cut = rows.where(F.col("date") <= F.lit(day(99)))
    scaled2, models2 = W.window_models(cut, w.where("window_id = 0"), ["x"], ks=(2,), iterations=15, restarts=1)
    again = {r["date"]: r["confidence"] for r in W.window_states(scaled2, models2, ["x"]).collect()}
    assert len(again) == 20 and all(again[r["date"]] == pytest.approx(r["confidence"], abs=1e-9) for r in got if r["window_id"] == 0 and r["date"] in again)


def test_short_training_and_empty_tables_give_no_rows(spark, series, one_window):
    assert B.train_slices(one_window, series(A=[1.0] * 20), least=11).count() == 0
    none = [B.Scenario("base", fill_delay=1)]
    trades, ret, rets = book(spark, series, one_window.limit(0), {"A": [100.0] * 10}, [("A", 0, 10.0)], none)
    assert trades.count() == 0 and ret == {} and W.equity(rets).count() == 0
