"""Return, drawdown, trade and benchmark metrics; one aggregate per portfolio key.

``equity`` is (key, date, nav), unique on (key, date). Trades are aggregated only, so a
key may hold any number of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline import config as cfg
from barline.functions import scalars as S
from barline.functions.series import over, so_far

ROOT = math.sqrt(cfg.TRADING_DAYS)
DAILY_RF = cfg.RISK_FREE / cfg.TRADING_DAYS


def daily_returns(equity: DataFrame, key: str, nav: str = "nav") -> DataFrame:
    """Adds ``ret``; null on the first date of each key."""
    past = F.lag(nav).over(over(key))
    return equity.withColumn("ret", F.try_divide(nav, past) - 1)


def drawdowns(equity: DataFrame, key: str, nav: str = "nav") -> DataFrame:
    """Adds ``drawdown``: nav against its running maximum."""
    return equity.withColumn("drawdown", F.try_divide(nav, F.max(nav).over(so_far(over(key)))) - 1)


def _or_zero(x: Column, ok: Column) -> Column:
    return F.coalesce(F.when(ok, x), F.lit(0.0))


def equity_metrics(equity: DataFrame, key: str) -> DataFrame:
    """Return, volatility, Sharpe, Sortino, drawdown and Calmar, unrounded fractions."""
    rows = drawdowns(daily_returns(equity, key), key)
    short = F.least(F.col("ret") - DAILY_RF, F.lit(0.0))
    g = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.min_by("nav", "date").alias("_a"), F.max_by("nav", "date").alias("_z"),
        F.count("ret").alias("_m"), F.avg("ret").alias("_mean"), F.stddev_samp("ret").alias("_sd"),
        F.sqrt(F.avg(short * short)).alias("_dn"), F.abs(F.min("drawdown")).alias("_mdd"), F.avg("nav").alias("avg_nav"),
    )
    enough = F.col("_m") >= 2
    g = g.withColumn("total_return", _or_zero(F.try_divide("_z", "_a") - 1, F.col("_n") >= 2))
    g = g.withColumn("annualized_return", _or_zero(F.pow(1 + F.col("total_return"), F.lit(float(cfg.TRADING_DAYS)) / F.col("_n")) - 1, F.col("_n") >= 2))
    g = g.withColumns({
        "annualized_vol": _or_zero(F.col("_sd") * ROOT, enough),
        "sharpe": _or_zero(F.try_divide(F.col("_mean") - DAILY_RF, F.col("_sd")) * ROOT, enough),
        "sortino": _or_zero(F.try_divide(F.col("_mean") - DAILY_RF, F.col("_dn")) * ROOT, enough),
        "max_drawdown": _or_zero(F.col("_mdd"), F.col("_n") >= 2),
    })
    return g.withColumn("calmar", S.ratio_or(F.col("annualized_return"), F.col("max_drawdown"), 0.0)).drop(
        "_n", "_a", "_z", "_m", "_mean", "_sd", "_dn", "_mdd")


def profit_factor(ret: Column) -> Column:
    """Aggregate: gains over losses; no losses gives infinity if there are gains, else 0."""
    wins = F.coalesce(F.sum(F.when(ret > 0, ret)), F.lit(0.0))
    losses = F.abs(F.coalesce(F.sum(F.when(ret < 0, ret)), F.lit(0.0)))
    return F.when(losses != 0, F.try_divide(wins, losses)).when(wins > 0, F.lit(float("inf"))).otherwise(0.0)


def trade_metrics(trades: DataFrame, key: str, ret: str = "trade_return") -> DataFrame:
    r = F.col(ret)
    extra = []
    if {"entry_date", "exit_date"} <= set(trades.columns):
        held = F.datediff(F.col("exit_date").try_cast("date"), F.col("entry_date").try_cast("date"))
        extra.append(F.coalesce(F.avg(held), F.lit(0.0)).alias("avg_holding_days"))
    if "traded_value" in trades.columns:
        extra.append(F.sum("traded_value").alias("traded_value"))
    return trades.groupBy(key).agg(
        F.coalesce(F.avg((r > 0).cast("double")), F.lit(0.0)).alias("win_rate"), profit_factor(r).alias("profit_factor"),
        F.coalesce(F.avg(r), F.lit(0.0)).alias("avg_trade_return"), F.count(r).alias("n_trades"), *extra,
    )


def turnover(traded: Column, avg_nav: Column) -> Column:
    return S.ratio_or(traded, avg_nav, 0.0)


def aligned_pair(strategy: DataFrame, bench: DataFrame) -> DataFrame:
    """Inner join on date of (key, date, ret) and (date, bench_ret); rows with a null go."""
    return strategy.join(bench.select("date", "bench_ret"), "date").dropna(subset=["ret", "bench_ret"])


def benchmark_metrics(pairs: DataFrame, key: str) -> DataFrame:
    """Beta, Jensen alpha, information ratio and downside beta in one pass."""
    s, b = F.col("ret"), F.col("bench_ret")
    down = b < 0
    sd, bd = F.when(down, s), F.when(down, b)
    g = pairs.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.covar_samp(s, b).alias("_cov"), F.var_samp(b).alias("_var"), F.avg(s).alias("_s"), F.avg(b).alias("_b"),
        F.avg(s - b).alias("_act"), F.stddev_samp(s - b).alias("_te"), F.count_if(down).alias("_nd"),
        F.covar_samp(sd, bd).alias("_covd"), F.var_samp(bd).alias("_vard"),
    )

    def slope(n: str, cov: str, var: str) -> Column:
        return _or_zero(F.try_divide(cov, var), (F.col(n) >= 2) & (F.col(var) >= 1e-20))

    g = g.withColumns({"beta": slope("_n", "_cov", "_var"), "downside_beta": slope("_nd", "_covd", "_vard")})
    return g.select(
        key, "beta",
        _or_zero((F.col("_s") - DAILY_RF - F.col("beta") * (F.col("_b") - DAILY_RF)) * cfg.TRADING_DAYS, F.col("_n") >= 2).alias("alpha_annualized"),
        _or_zero(F.try_divide("_act", "_te") * ROOT, F.col("_n") >= 2).alias("information_ratio"), "downside_beta",
    )


def metric_suite(equity: DataFrame, key: str, trades: DataFrame | None = None, bench: DataFrame | None = None) -> DataFrame:
    """The full suite per portfolio, rounded half-even to the published digits.

    ``bench`` is (date, nav); its returns are taken on its own dates before aligning.
    """
    out = equity_metrics(equity, key)
    cols = {
        "total_return_pct": ("total_return", 100, 2), "annualized_return_pct": ("annualized_return", 100, 2),
        "annualized_vol_pct": ("annualized_vol", 100, 2), "sharpe": ("sharpe", 1, 3), "sortino": ("sortino", 1, 3),
        "calmar": ("calmar", 1, 3), "max_drawdown_pct": ("max_drawdown", 100, 2),
    }
    if trades is not None:
        out = out.join(trade_metrics(trades, key), key, "left").na.fill(0)
        cols |= {"win_rate": ("win_rate", 1, 3), "profit_factor": ("profit_factor", 1, 3), "avg_trade_return_pct": ("avg_trade_return", 100, 3)}
        if "avg_holding_days" in out.columns:
            cols["avg_holding_period_days"] = ("avg_holding_days", 1, 1)
        if "traded_value" in out.columns:
            out = out.withColumn("_turn", turnover(F.col("traded_value"), F.col("avg_nav")))
            cols["turnover"] = ("_turn", 1, 4)
    if bench is not None:
        b = daily_returns(bench.withColumn("_k", F.lit("bench")), "_k").select("date", F.col("ret").alias("bench_ret"))
        pairs = aligned_pair(daily_returns(equity, key).select(key, "date", "ret"), b)
        out = out.join(benchmark_metrics(pairs, key), key, "left").na.fill(0.0)
        cols |= {"beta": ("beta", 1, 3), "alpha_annualized_pct": ("alpha_annualized", 100, 3),
                 "information_ratio": ("information_ratio", 1, 3), "downside_beta": ("downside_beta", 1, 3)}
    n = ["n_trades"] if trades is not None else []
    inf = F.lit(float("inf"))
    return out.select(key, *n, *[
        F.when(F.col(src) == inf, inf).otherwise(F.bround(F.when(F.col(src) != inf, F.col(src)) * mult, digits)).alias(name)
        for name, (src, mult, digits) in cols.items()
    ])


# ---- closed trades ----
def portfolio_stats(closed: DataFrame) -> DataFrame:
    """One row; break-even counts as a loss; zeros where there are no trades."""
    p = F.col("realized_pnl")
    return closed.agg(
        F.count(p).alias("total_trades"), F.count_if(p > 0).alias("wins"), F.count_if(p <= 0).alias("losses"),
        F.coalesce(F.try_divide(F.count_if(p > 0), F.count(p)), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.sum(p), F.lit(0.0)).alias("total_realized_pnl"),
    )


def by_source(closed: DataFrame) -> DataFrame:
    p = F.col("realized_pnl")
    source = F.when(F.coalesce("signal_source", F.lit("")) != "", F.col("signal_source")).otherwise("congressional")
    return closed.groupBy(source.alias("signal_source")).agg(
        F.count(p).alias("n_trades"), F.count_if(p > 0).alias("wins"), F.sum(p).alias("pnl"))


def performance_report(closed: DataFrame) -> DataFrame:
    held = F.datediff(F.col("exit_date").try_cast("date"), F.col("entry_date").try_cast("date"))
    p = F.col("realized_pnl")
    return closed.agg(
        F.count(p).alias("total_trades"), F.count_if(p > 0).alias("wins"), F.count_if(p <= 0).alias("losses"),
        F.coalesce(F.try_divide(F.count_if(p > 0), F.count(p)), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.sum(p), F.lit(0.0)).alias("total_realized_pnl"), F.coalesce(F.avg(held), F.lit(0.0)).alias("avg_hold_days"),
        F.coalesce(F.max(p), F.lit(0.0)).alias("best_trade_pnl"), F.coalesce(F.min(p), F.lit(0.0)).alias("worst_trade_pnl"),
    )


def grouped_trades(trades: DataFrame, key: str, pnl_pct: str = "pnl_pct") -> DataFrame:
    r = F.col(pnl_pct)
    pf = profit_factor(r / 100)
    return trades.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(r).alias("avg_pnl_pct"),
        F.when(pf == float("inf"), pf).otherwise(F.bround(F.when(pf != float("inf"), pf), 3)).alias("profit_factor"),
    )


def conviction_buckets(trades: DataFrame) -> DataFrame:
    """low (to 5), mid (to 7), high; all three rows are always present."""
    bucket = F.when(F.col("conviction") <= 5, "low").when(F.col("conviction") <= 7, "mid").otherwise("high")
    got = grouped_trades(trades.withColumn("bucket", bucket), "bucket")
    names = trades.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in ("low", "mid", "high")])).alias("bucket"))
    return names.join(got, "bucket", "left").na.fill(0)


def exposure(states: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Share of bars per label (within the keys given). The window runs over labels only."""
    keys = keys or []
    counts = states.groupBy(*keys, "regime_label").agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(*(keys or [F.lit(0)])))
    return counts.withColumn("exposure", F.col("_n") / total).drop("_n")


def by_latest_regime(closed: DataFrame, regime_log: DataFrame) -> DataFrame:
    """Trades by the newest logged regime of their entry date; unknown where none was logged."""
    newest = regime_log.groupBy("date").agg(F.max_by("regime_label", "id").alias("regime_label"))
    r = (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price")
    rows = closed.where("entry_price > 0").select(F.col("entry_date").alias("date"), r.alias("_r")).join(newest, "date", "left")
    return rows.groupBy(F.coalesce("regime_label", F.lit("unknown")).alias("regime_label")).agg(
        F.count(F.lit(1)).alias("n_trades"), F.bround(F.avg("_r") * 100, 2).alias("avg_return_pct"),
        F.bround(F.avg((F.col("_r") > 0).cast("double")), 3).alias("win_rate"),
    )


def best_and_worst(trades: DataFrame, by: str, seq: list[str], n: int = 5) -> DataFrame:
    """Both ends of one stable descending sort, as two bounded top-k reads."""
    best = trades.orderBy(F.desc(by), *seq).limit(n).withColumn("side", F.lit("best"))
    worst = trades.orderBy(F.asc(by), *[F.desc(c) for c in seq]).limit(n).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def vol_gate(nav: DataFrame, target: float = cfg.SIZING.target_vol_pct, key: str = "portfolio_id") -> DataFrame:
    """Multiplier below one where realised volatility exceeds the target; needs 20 points."""
    g = daily_returns(nav, key).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), (F.stddev_samp("ret") * ROOT * 100).alias("realized_vol_pct"))
    m = F.when((F.col("_n") >= 20) & (F.col("realized_vol_pct") > target), F.try_divide(F.lit(target), F.col("realized_vol_pct"))).otherwise(1.0)
    return g.withColumn("port_vol_mult", m).drop("_n")
