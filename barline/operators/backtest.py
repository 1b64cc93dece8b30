"""Back-test data work: windows, fills, exit labels, benchmarks, stress paths, studies.

There is no cash-path simulator here: signals are labelled independently of each other,
and portfolios are the equal-weight mean of the trades that are open.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline import config as cfg
from barline.functions import scalars as S
from barline.functions.series import full, over, so_far, spread
from barline.operators import metrics as M
from barline.operators.joins import asof_join, balanced_range_join, range_join

WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


# ---- windows ----
def walk_windows(calendar: DataFrame, b: cfg.Backtest = cfg.BACKTEST, least: int = 20) -> DataFrame:
    """Train and test windows over a calendar of bar dates, snapped to bars.

    The list ends at the first window that runs past the last date or holds too few bars.
    The start moves step by step: a day that a short month clips stays clipped.
    """
    span = calendar.agg(F.min("date").alias("_a"), F.max("date").alias("_z"))
    steps = F.sequence(F.lit(0), F.floor(F.months_between("_z", "_a") / b.step_months).cast("int"))
    w = span.select("_a", "_z", F.explode(steps).alias("window_id"))
    moved = F.aggregate(F.sequence(F.lit(0), F.col("window_id")), F.date_sub("_a", 0), lambda d, i: F.when(i == 0, d).otherwise(F.add_months(d, b.step_months)))
    w = w.withColumn("train_start", moved)
    w = w.withColumn("train_end", F.add_months("train_start", 12 * b.train_years))
    w = w.withColumn("_ts", F.date_add("train_end", 1)).withColumn("_te", F.add_months("_ts", b.test_months)).where("_te <= _z")
    days = calendar.select("date").distinct()
    found = range_join(w, days, [], "_ts", "_te", "date").groupBy("window_id").agg(
        F.min("date").alias("test_start"), F.max("date").alias("test_end"), F.count(F.lit(1)).alias("n_test"))
    out = w.join(found, "window_id", "left").withColumn("_short", F.coalesce("n_test", F.lit(0)) < least)
    ends = F.min(F.when(F.col("_short"), F.col("window_id"))).over(Window.partitionBy(F.lit(0)))
    return out.withColumn("_stop", ends).where("_stop IS NULL OR window_id < _stop").select(
        "window_id", "train_start", "train_end", "test_start", "test_end", "n_test")


def train_slices(windows: DataFrame, bars: DataFrame, least: int = cfg.BACKTEST.min_train_bars) -> DataFrame:
    """Windows with their number of training bars; those with too few are dropped."""
    rows = range_join(windows.select("window_id", "train_start", "train_end"), bars.select("date").distinct(), [], "train_start", "train_end", "date")
    n = rows.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_train")).where(F.col("n_train") >= least)
    return windows.join(n, "window_id")


def signals_in_windows(signals: DataFrame, windows: DataFrame) -> DataFrame:
    """A signal belongs to every window whose test range holds its date."""
    return balanced_range_join(windows.select("window_id", "test_start", "test_end"), signals, [], "test_start", "test_end", "date")


def with_regime(rows: DataFrame, states: DataFrame, min_confidence: float = cfg.ALLOCATION.min_confidence, since: str | None = "test_start") -> DataFrame:
    """Latest state at or before the signal, inside its window; low confidence is dropped."""
    cols = [c for c in states.columns if c != "date"]
    got = asof_join(rows, states, [], "date", "date", cols, since=since)
    return got.where(F.col("confidence") >= min_confidence)


def enrich(rows: DataFrame, vol: DataFrame) -> DataFrame:
    """Size each signal: volatility as of its date, regime, confidence, stability, tilt.

    ``vol`` is (ticker, date, vol_pct); tickers without history use the fallback of 1.
    """
    df = asof_join(rows, vol, ["ticker"], "date", "date", ["vol_pct"], how="left")
    size = (
        S.vol_target_pct(F.coalesce("vol_pct", F.lit(1.0))) * S.regime_multiplier(F.col("regime_label"))
        * S.confidence_multiplier(F.col("confidence")) * F.when(F.col("is_stable"), 1.0).otherwise(cfg.ALLOCATION.instability_penalty)
    )
    return df.withColumn("position_pct", S.conviction_tilt(size, F.col("conviction")))


# ---- fills and exits ----
def fill_dates(signals: DataFrame, calendar: DataFrame, delay: int = 1) -> DataFrame:
    """Execution date ``delay`` bars later, held at the last bar; off-calendar signals go.

    The calendar has one row per date, so its ordinal runs over that many rows only.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    days = calendar.select("date").distinct()
    last = F.last("date").over(w.rowsBetween(*WHOLE))
    nxt = days.withColumn("exec_date", F.coalesce(F.lead("date", delay).over(w) if delay else F.col("date"), last))
    return signals.join(nxt, "date")


@dataclass(frozen=True)
class ExitRules:
    stop: float = cfg.RISK.trailing_stop_pct
    take_profit: float = cfg.RISK.take_profit_pct
    hard_exit: float = cfg.RISK.hard_exit_pct
    slippage_bps: float = cfg.BACKTEST.slippage_bps
    commission_pct: float = cfg.BACKTEST.commission_pct


class Extremes:
    """Largest and smallest values over blocks of 1, 2, 4, ... bars, for first-passage searches."""

    def __init__(self, values: np.ndarray):
        self.n, self.high, self.low = len(values), [values], [values]
        while len(self.high[-1]) > 1:
            for levels, best, pad in ((self.high, np.maximum, -np.inf), (self.low, np.minimum, np.inf)):
                v = levels[-1] if len(levels[-1]) % 2 == 0 else np.append(levels[-1], pad)
                levels.append(best(v[::2], v[1::2]))

    def first(self, start: np.ndarray, levels: list[np.ndarray], passes) -> np.ndarray:
        """For each search the first bar from ``start`` on whose value passes, else n. ``passes``
        takes values and the numbers of the searches; a block has such a bar if its extreme passes.

        All searches climb together while their block has none, then go down to the bar.
        """
        at, level, down = start.copy(), np.zeros(len(start), np.int64), np.zeros(len(start), bool)
        found, on = np.full(len(start), self.n), np.arange(len(start))
        top = len(levels) - 1
        while len(on):
            on = on[(at[on] << level[on]) < self.n]
            value = np.empty(len(on))
            for depth in np.unique(level[on]):
                here = level[on] == depth
                value[here] = levels[depth][at[on[here]]]
            hit = passes(value, on)
            leaf = hit & (level[on] == 0)
            found[on[leaf]] = at[on[leaf]]
            into = on[hit & ~leaf]
            down[into], level[into], at[into] = True, level[into] - 1, at[into] * 2
            past = on[~hit]
            at[past] += 1
            up = past[~down[past] & (at[past] % 2 == 0) & (level[past] < top)]
            at[up], level[up] = at[up] // 2, level[up] + 1
            on = on[~leaf]
        return found


def _first_passages(close: np.ndarray, entry: np.ndarray, fill: np.ndarray, r: ExitRules):
    """Exit bar, reason and bar of the half sale (-1: none) of every entry, by searches over
    block extremes instead of a walk: about log(bars) steps an entry.

    Until a close exceeds the fill, the stop hangs from the fill; from then on from the last
    new high. The stop after a high does not depend on the entry, so it is found once for
    every bar: at the drop from it, or what the next higher bar finds, from the last bar on.
    """
    n, blocks = len(close), Extremes(close)
    drop = lambda peak: lambda v, i: (peak[i] - v) / peak[i] * 100 >= r.stop
    gain = lambda share: lambda v, i: (v - fill[i]) / fill[i] * 100 >= share
    later = np.arange(1, n + 1)
    higher = blocks.first(later, blocks.high, lambda v, i: v > close[i])
    fallen = blocks.first(later, blocks.low, drop(close))
    stop_of, ahead, fell = [n] * (n + 1), higher.tolist(), fallen.tolist()
    for t in range(n - 1, -1, -1):
        stop_of[t] = fell[t] if fell[t] < ahead[t] else stop_of[ahead[t]]
    after = entry + 1
    high = blocks.first(after, blocks.high, lambda v, i: v > fill[i])
    low = blocks.first(after, blocks.low, drop(fill))
    stop = np.where(low < high, low, np.array(stop_of)[high])
    hard = blocks.first(after, blocks.high, gain(r.hard_exit))
    half = blocks.first(after, blocks.high, gain(r.take_profit))
    end = np.minimum(stop, hard)
    reason = np.where(end == n, "end_of_backtest", np.where(stop <= hard, "stop_loss", "hard_exit")).astype(object)
    return np.minimum(end, n - 1), reason, np.where(half < end, half, -1)


def label_exits(bars: DataFrame, entries: DataFrame, keys: Sequence[str] = ("ticker",), rules: ExitRules = ExitRules()) -> DataFrame:
    """Exit of every distinct (keys, exec_date) entry on its own price path.

    Equal entries have equal exits, so they are made distinct first; a series then has at
    most one entry per bar. Exits are first passages, found in a grouped function; a group is
    one series of one row per date. Bars may carry ``slippage_bps``, one value per series, in
    place of that of the rules. Bars without a price above zero are left out, entries on them
    with them.
    """
    keys, own = list(keys), [c for c in ("slippage_bps",) if c in bars.columns]
    marks = entries.select(*keys, F.col("exec_date").alias("date"), F.lit(True).alias("_e")).distinct()
    rows = bars.select(*keys, "date", "close", *own).where("close > 0 AND NOT isnan(close)").join(marks, [*keys, "date"], "left").withColumn("_e", F.coalesce("_e", F.lit(False)))
    fields = [T.StructField(k, rows.schema[k].dataType) for k in keys] + [
        T.StructField("entry_date", T.DateType()), T.StructField("entry_price", T.DoubleType()), T.StructField("exit_date", T.DateType()),
        T.StructField("exit_price", T.DoubleType()), T.StructField("exit_reason", T.StringType()), T.StructField("take_profit_date", T.DateType()),
        T.StructField("take_profit_price", T.DoubleType()),
    ]

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", ignore_index=True)
        slip = (pdf["slippage_bps"].iloc[0] if own else rules.slippage_bps) / 10_000
        close, entry = pdf["close"].to_numpy(), np.flatnonzero(pdf["_e"].to_numpy())
        fill = close[entry] + close[entry] * slip
        at, why, half = _first_passages(close, entry, fill, rules)
        day = pdf["date"].to_numpy()
        out = {k: pdf[k].iloc[0] for k in keys} | {
            "entry_date": day[entry], "entry_price": fill, "exit_date": day[at], "exit_price": close[at] - close[at] * slip,
            "exit_reason": why, "take_profit_date": np.where(half >= 0, day[half], None),
            "take_profit_price": np.where(half >= 0, close[half] - close[half] * slip, np.nan)}
        return pd.DataFrame(out, columns=[f.name for f in fields])

    out = spread(rows, keys).groupBy(*keys).applyInPandas(walk, T.StructType(fields))
    out = out.withColumn("take_profit_price", F.nanvl("take_profit_price", F.lit(None).cast("double")))
    last, half = _leg_pnl("exit_price", rules), _leg_pnl("take_profit_price", rules)
    return out.withColumn("pnl_pct", F.when(F.col("take_profit_date").isNull(), last).otherwise((half + last) / 2))


def _leg_pnl(price: str, rules: ExitRules) -> Column:
    return (F.col(price) * (1 - rules.commission_pct / 100) / F.col("entry_price") - 1) * 100


def exit_legs(labels: DataFrame, rules: ExitRules = ExitRules()) -> DataFrame:
    """A trade per sale: half the lot at the take-profit, where there was one, and the rest at
    the exit. ``share`` is the part of the lot."""
    half = F.struct(F.lit("take_profit").alias("reason"), F.col("take_profit_date").alias("date"), F.lit(0.5).alias("share"), _leg_pnl("take_profit_price", rules).alias("leg_pnl_pct"))
    rest = F.struct(F.col("exit_reason").alias("reason"), F.col("exit_date").alias("date"), F.when(F.col("take_profit_date").isNull(), 1.0).otherwise(0.5).alias("share"), _leg_pnl("exit_price", rules).alias("leg_pnl_pct"))
    legs = F.when(F.col("take_profit_date").isNull(), F.array(rest)).otherwise(F.array(half, rest))
    return labels.withColumn("_leg", F.explode(legs)).select("*", "_leg.*").drop("_leg")


def open_trade_returns(bars: DataFrame, trades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-weight mean daily return of the open trades per date, within ``keys``.

    A trade earns its ticker's return after its entry date up to its exit date. Only the
    number of open trades per ticker and date is needed: +n at entries, -n at exits,
    summed over earlier bars. No row per trade and day is made.
    """
    keys = list(keys)
    step = F.explode(F.array(F.struct(F.col("entry_date").alias("date"), F.lit(1).alias("step")), F.struct(F.col("exit_date").alias("date"), F.lit(-1).alias("step"))))
    moves = trades.select(*keys, "ticker", step.alias("_m")).groupBy(*keys, "ticker", "_m.date").agg(F.sum("_m.step").alias("_step"))
    ret = bars.select(*[k for k in keys if k in bars.columns], "ticker", "date", "close").withColumn("_r", F.try_divide("close", F.lag("close").over(
        Window.partitionBy(*[k for k in keys if k in bars.columns], "ticker").orderBy("date"))) - 1)
    scope = [k for k in keys if k not in bars.columns]
    grid = ret if not scope else ret.join(moves.select(*scope, "ticker").distinct(), "ticker")
    rows = grid.join(moves, [*keys, "ticker", "date"], "left")
    step = F.coalesce("_step", F.lit(0))
    earlier = Window.partitionBy(*keys, "ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_n", F.coalesce(F.sum(step).over(earlier), F.lit(0))).where("_n > 0 AND _r IS NOT NULL")
    return rows.groupBy(*keys, "date").agg((F.sum(F.col("_n") * F.col("_r")) / F.sum("_n")).alias("ret"), F.sum("_n").alias("n_open"))


def compounded(returns: DataFrame, key: str, start: float = 1.0) -> DataFrame:
    """Equity index: running product, so that a factor at or below zero is kept."""
    return returns.withColumn("nav", F.lit(start) * F.product(1 + F.col("ret")).over(so_far(over(key))))


# ---- benchmarks ----
def buy_and_hold(prices: DataFrame, key: str, cash: float = 100_000.0, slippage_bps: float = 0.0, commission_pct: float = 0.0) -> DataFrame:
    first = F.first("close").over(over(key))
    return prices.withColumn("nav", F.col("close") * S.entry_shares(F.lit(cash), first, slippage_bps, commission_pct))


def trend_following(prices: DataFrame, key: str, window: int = 200, cash: float = 100_000.0, slippage_bps: float = 0.0, commission_pct: float = 0.0) -> DataFrame:
    """Long while the close is above its mean. Every step multiplies the equity by a price
    ratio or by a switching cost, so the path is a running sum of logarithms."""
    w = over(key)
    enough = F.count(F.lit(1)).over(w.rowsBetween(*WHOLE)) >= window
    on = F.coalesce(F.col("close") > full(F.col("close"), w, window, F.avg, window // 2), F.lit(False))
    df = prices.withColumns({"_ok": enough, "_on": on}).where("_ok")
    held = F.coalesce(F.lag("_on").over(w), F.lit(False))
    s, c = slippage_bps / 10_000, commission_pct / 100
    step = (
        F.when(held, F.log(F.col("close") / F.lag("close").over(w))).otherwise(0.0)
        + F.when(F.col("_on") & ~held, float(np.log((1 - c) / (1 + s)))).when(~F.col("_on") & held, float(np.log((1 - s) * (1 - c)))).otherwise(0.0)
    )
    return df.withColumn("_g", step).withColumn("nav", F.lit(cash) * F.exp(F.sum("_g").over(so_far(w)))).drop("_ok", "_on", "_g")


# ---- stress ----
@dataclass(frozen=True)
class Scenario:
    name: str
    crash_pct: float | None = None
    crash_bars: int = 5
    vol_multiplier: float | None = None
    vol_bars: int = 20
    drop_fraction: float | None = None
    slippage_multiplier: float = 1.0
    fill_delay: int = 0


# ---- fixed values: the five presets ----
SCENARIOS = [
    Scenario("sudden_crash", crash_pct=0.30),
    Scenario("high_vol_cluster", vol_multiplier=3.0),
    Scenario("slippage_spike", slippage_multiplier=5.0),
    Scenario("delayed_fills", fill_delay=2),
    Scenario("missing_data", drop_fraction=0.05),
]


def stress_start(bars: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Adds the bar index, the series length and the common start at a quarter of the longest
    series of the scope. The longest is taken over one row per series, not over the bars."""
    keys, every = [*scope, "ticker"], [*(scope or ["_k"])]
    sizes = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(0))
    longest = sizes.groupBy(*every).agg(F.greatest(F.lit(1), F.floor(F.max("_n") / 4)).alias("_start"))
    sizes = sizes.join(longest, every).drop("_k")
    return bars.join(sizes, keys).withColumn("_i", F.row_number().over(over(keys)) - 1)


def crash_path(start: Column, bars_long: int, drop: float, keys: Sequence[str] = ("ticker",)) -> Column:
    """Log-linear fall to 1 - drop, then the original returns from the new level."""
    whole = over(keys).rowsBetween(*WHOLE)
    end = F.least(start + bars_long, F.col("_n"))
    at = lambda i: F.max(F.when(F.col("_i") == i, F.col("close"))).over(whole)
    fall = float(np.log(max(1.0 - drop, 1e-9)))
    anchor = at(start - 1)
    inside = anchor * F.exp(fall * (F.col("_i") - start + 1) / (end - start))
    after = anchor * float(np.exp(fall)) * F.try_divide(F.col("close"), at(end - 1))
    return F.when(F.col("_i") < start, F.col("close")).when(F.col("_i") < end, inside).otherwise(after)


def vol_path(df: DataFrame, out: str, bars_long: int, multiplier: float, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Log returns inside the window times the multiplier; later bars stay original."""
    w = over(keys)
    inside = (F.col("_i") >= F.col("_start")) & (F.col("_i") < F.col("_start") + bars_long)
    df = df.withColumn("_move", F.when(inside, F.log(F.try_divide(F.col("close"), F.lag("close").over(w)))))
    anchor = F.max(F.when(F.col("_i") == F.col("_start") - 1, F.col("close"))).over(w.rowsBetween(*WHOLE))
    path = anchor * F.exp(multiplier * F.sum("_move").over(so_far(w)))
    return df.withColumn(out, F.when(inside, path).otherwise(F.col("close"))).drop("_move")


def stressed(bars: DataFrame, scenarios: Sequence[Scenario] = tuple(SCENARIOS), slippage_bps: float = cfg.BACKTEST.slippage_bps, seed: int = 42, scope: Sequence[str] = ()) -> DataFrame:
    """One path per scenario and series, with its slippage and fill delay. A series is a
    ticker within ``scope`` (the window of a study, say).

    Dropped bars are chosen by a hash of ticker, date and seed: the same on every run
    and on every number of partitions.
    """
    keys = [*scope, "ticker"]
    df = stress_start(bars.select(*keys, "date", "close"), scope)
    order = F.sha2(F.concat_ws("|", "ticker", F.col("date").cast("string"), F.lit(str(seed))), 256)
    df = df.withColumn("_h", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    keeps = []
    for i, s in enumerate(scenarios):
        if s.vol_multiplier is not None:
            df = vol_path(df, f"_p{i}", s.vol_bars, s.vol_multiplier, keys)
        else:
            df = df.withColumn(f"_p{i}", F.col("close") if s.crash_pct is None else crash_path(F.col("_start"), s.crash_bars, s.crash_pct, keys))
        keeps.append(F.lit(True) if s.drop_fraction is None else F.col("_h") > F.floor(F.col("_n") * s.drop_fraction))
    cells = F.array(*[
        F.struct(F.lit(s.name).alias("scenario"), F.col(f"_p{i}").alias("close"), keep.alias("_keep"), F.lit(slippage_bps * s.slippage_multiplier).alias("slippage_bps"), F.lit(s.fill_delay).alias("fill_delay"))
        for i, (s, keep) in enumerate(zip(scenarios, keeps))])
    return df.select(*keys, "date", F.explode(cells).alias("_c")).select(*keys, "date", "_c.*").where("_keep").drop("_keep")


# ---- hedge analysis ----
def leverage_decay(returns: DataFrame, key: str, leverage: float = -1.0, periods: int = 252) -> DataFrame:
    rows = returns.where("ret IS NOT NULL").withColumn("_i", F.row_number().over(over(key))).where(F.col("_i") <= periods)
    g = rows.groupBy(key).agg(F.product(1 + leverage * F.col("ret")).alias("final_nav"), F.product(1 + F.col("ret")).alias("_u"), F.count(F.lit(1)).alias("_t"), F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("daily_vol"))
    g = g.withColumn("theoretical_nav", F.pow("_u", F.lit(leverage))).withColumn("decay", F.col("final_nav") - F.col("theoretical_nav"))
    return g.select(key, "final_nav", "theoretical_nav", "decay", (F.try_divide("decay", F.abs("theoretical_nav")) * (252 / F.col("_t")) * 100).alias("annualised_decay_pct"),
                    "daily_vol", (F.col("_t") * F.col("daily_vol") * F.col("daily_vol") / 2).alias("vol_drag_estimate"))


def bear_days(prices: DataFrame, key: str, depth: float = -0.15, least: int = 5, worst: float = 0.2) -> DataFrame:
    """Rows in deep drawdown; a key with too few of them uses its worst fifth of returns."""
    df = M.drawdowns(M.daily_returns(prices, key), key)
    g = df.groupBy(key).agg(F.count_if(F.col("drawdown") < depth).alias("_deep"), F.percentile("ret", F.lit(worst)).alias("_cut"))
    hit = F.when(F.col("_deep") >= least, F.col("drawdown") < depth).otherwise(F.col("ret") < F.col("_cut"))
    return df.join(g, key).where(F.coalesce(hit, F.lit(False))).drop("_deep", "_cut")


def hedge_overlay(curves: DataFrame, key: str) -> DataFrame:
    """Quarter in an inverse fund against halving exposure; (key, date, nav, underlying) in."""
    w = over(key)
    ret = lambda c: F.coalesce(F.try_divide(F.col(c), F.lag(c).over(w)) - 1, F.lit(0.0))
    df = curves.withColumns({"_p": ret("nav"), "_u": ret("underlying")})
    legs = F.explode(F.array(F.struct(F.lit("inverse_etf").alias("approach"), (0.75 * F.col("_p") - 0.25 * F.col("_u")).alias("r")),
                             F.struct(F.lit("gross_reduction").alias("approach"), (0.5 * F.col("_p")).alias("r"))))
    rows = df.select(key, "date", legs.alias("_l")).select(key, "date", "_l.*")
    w2 = Window.partitionBy(key, "approach").orderBy("date")
    rows = rows.withColumn("_e", F.product(1 + F.col("r")).over(so_far(w2)))
    rows = rows.withColumns({"_dd": F.col("_e") / F.max("_e").over(so_far(w2)) - 1, "_x": F.col("_e") / F.lag("_e").over(w2) - 1})
    g = rows.groupBy(key, "approach").agg(F.count(F.lit(1)).alias("_t"), F.min_by("_e", "date").alias("_a"), F.max_by("_e", "date").alias("_z"), F.min("_dd").alias("_mdd"),
                                          F.count("_x").alias("_m"), F.avg("_x").alias("_mean"), F.stddev_samp("_x").alias("_sd"))
    total = F.col("_z") / F.col("_a")
    sharpe = F.when(F.col("_m") >= 2, F.coalesce(F.try_divide(F.col("_mean") - M.DAILY_RF, F.col("_sd")) * M.ROOT, F.lit(0.0))).otherwise(0.0)
    return g.where("_t >= 2").select(key, "approach", F.bround((total - 1) * 100, 3).alias("total_return_pct"), F.bround(sharpe, 3).alias("sharpe"),
                                     F.bround(F.col("_mdd") * 100, 3).alias("max_drawdown_pct"), F.bround((F.pow(total, F.lit(252.0) / F.col("_t")) - 1) * 100, 3).alias("annualised_return_pct"))


# ---- studies ----
def pooled_returns(returns: DataFrame, bench: DataFrame, least: int = 10) -> DataFrame:
    """First window wins per date; dates both sides have; nothing if there are fewer than ``least``."""
    one = returns.groupBy("date").agg(F.min_by("ret", "window_id").alias("ret"))
    rows = M.aligned_pair(one, bench)
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))).where(F.col("_n") >= least).drop("_n")


def aggregate_windows(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean, least and greatest of each metric over the windows, rounded to 3 digits."""
    rows = metrics.unpivot("window_id", list(names), "metric", "value").where("value IS NOT NULL")
    return rows.groupBy("metric").agg(*[F.bround(f("value"), 3).alias(n) for f, n in ((F.avg, "avg"), (F.min, "min"), (F.max, "max"))], F.count(F.lit(1)).alias("n_windows"))


def aggregate_exposure(states: DataFrame, windows: DataFrame) -> DataFrame:
    """Mean share of bars per label; a window without a label counts as zero."""
    rows = range_join(windows.select("window_id", "test_start", "test_end"), states.select("date", "regime_label"), [], "test_start", "test_end", "date")
    n = windows.agg(F.lit(1).alias("_k"), F.count(F.lit(1)).alias("_w"))
    shares = M.exposure(rows, ["window_id"]).groupBy("regime_label").agg(F.sum("exposure").alias("_s"))
    return shares.withColumn("_k", F.lit(1)).join(F.broadcast(n), "_k").select("regime_label", F.bround(F.col("_s") / F.col("_w"), 4).alias("avg_exposure"))


def window_excess(strategy: DataFrame, bench: DataFrame, cash: float = cfg.BACKTEST.initial_cash) -> DataFrame:
    """Strategy against buy-and-hold per window, and the value implied by the mean return."""
    rows = strategy.join(bench, "window_id")
    g = rows.agg(F.count(F.lit(1)).alias("n_windows"), F.avg("total_return_pct").alias("avg_return_pct"), F.avg(F.col("total_return_pct") - F.col("bench_return_pct")).alias("avg_excess_pct"))
    return g.withColumn("implied_value", F.lit(cash) * F.pow(1 + F.col("avg_return_pct") / 100, F.col("n_windows")))


def edge_summary(metrics: DataFrame, base: str = "factor_only", threshold: float = 0.05) -> DataFrame:
    """Sharpe gained per lag variant, the best of them, and whether it clears the threshold."""
    b = metrics.where(F.col("variant") == base).select(F.lit(1).alias("_k"), F.col("sharpe").alias("_b"))
    rows = metrics.where(F.col("variant") != base).withColumn("_k", F.lit(1)).join(F.broadcast(b), "_k").withColumn("incremental_sharpe", F.col("sharpe") - F.col("_b"))
    best = rows.agg(F.max_by("variant", F.struct("incremental_sharpe", "variant")).alias("best_variant"), F.max("incremental_sharpe").alias("best_gain"))
    return best.withColumn("keeps_edge", F.col("best_gain") > threshold)
