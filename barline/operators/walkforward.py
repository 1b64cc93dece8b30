"""Walk-forward study: a regime model per training window, and the trades, equity, metrics and
breakdowns of every test window under every stress scenario.

All windows and scenarios run side by side, keyed by (scenario, window_id); nothing loops over
windows. A book here is the sum of its open trades at their own sizes (percent of equity):
a day earns the size-weighted returns less the costs of what was bought and sold; where sizes
add up to more than 100 %, all are scaled down to 100 %. The rest is cash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline import config as cfg
from barline.functions.series import over, so_far
from barline.operators import backtest as B
from barline.operators import chain
from barline.operators import metrics as M
from barline.operators import regime as G
from barline.operators.joins import range_join
from barline.session import cut_lineage

SCENARIOS = (B.Scenario("base", fill_delay=1), *B.SCENARIOS)
PATH = ["scenario", "window_id"]
UNIT = 1_000_000  # sizes are summed as whole millionths of a percent, so that entries and exits cancel


# ---- a model per window ----
def window_models(rows: DataFrame, windows: DataFrame, names: Sequence[str], ks: Sequence[int] = (2, 3, 4), iterations: int = 100, restarts: int = 5, criterion: str = "bic") -> tuple[DataFrame, DataFrame]:
    """(scaled rows of each window's training and test range, chosen model per window).

    ``rows`` is (date, names..., ret) without nulls. The scaler and the model of a window see
    its training rows only; the number of states is the one of lowest ``criterion``.
    """
    span = range_join(windows.select("window_id", "train_start", "train_end", "test_start", "test_end"), rows, [], "train_start", "test_end", "date")
    train = span.where("date <= train_end")
    scaler = G.fit_scaler(train, ["window_id"], names)
    scaled = cut_lineage(G.scale(span, scaler, ["window_id"], names))
    z = [f"z_{n}" for n in names]
    fits = G.fit_models(scaled.where("date <= train_end"), z, ks, ["window_id"], "window_id", iterations=iterations, restarts=restarts)
    chosen = G.information_criteria(fits).groupBy("window_id").agg(F.min_by(F.struct("k", "start", "trans", "means", "vars", criterion), F.struct(criterion, "k")).alias("_m"))
    return scaled, cut_lineage(chosen.select("window_id", "_m.*"))


def window_states(scaled: DataFrame, models: DataFrame, names: Sequence[str]) -> DataFrame:
    """(window_id, date, regime_label, confidence, is_stable, transition_rate, n_regimes) of the
    test bars. Filtered forward from the first training bar, so a state knows no later bar;
    labels rank the states by their mean return over the training bars."""
    x = F.array(*[f"z_{n}" for n in names])
    blocks = chain.packed(scaled.withColumn("_x", x), ["window_id"], "_x").join(models.select("window_id", "k", "start", "trans", "means", "vars"), "window_id")
    got = chain.decoded(blocks.drop("k"), ["window_id"], whole=False)
    got = got.withColumn("confidence", F.array_max("filtered")).withColumn("state", F.array_position("filtered", F.col("confidence")).cast("int") - 1)
    got = got.join(scaled.select("window_id", "date", "train_end", "test_start", "ret"), ["window_id", "date"]).join(models.select("window_id", "k"), "window_id")
    got = cut_lineage(got.select("window_id", "date", "k", "state", "confidence", "train_end", "test_start", "ret"))
    means = got.where("date <= train_end").groupBy("window_id", "k", "state").agg(F.avg("ret").alias("mean_ret"))
    every = models.select("window_id", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("state"))
    place = F.row_number().over(Window.partitionBy("window_id").orderBy("mean_ret", "state"))
    labels = F.create_map(*[v for k, names_ in cfg.REGIME_LABELS.items() for v in (F.lit(k), F.array(*[F.lit(n) for n in names_]))])
    every = every.join(means, ["window_id", "k", "state"], "left").na.fill(0.0, ["mean_ret"])
    every = every.withColumn("regime_label", F.coalesce(F.get(F.try_element_at(labels, F.col("k")), place - 1), F.concat(F.lit("regime_"), (place - 1).cast("string"))))
    rows = got.join(every.select("window_id", "state", "regime_label"), ["window_id", "state"])
    rows = G.stability(rows, ["window_id"]).where("date >= test_start")
    return rows.select("window_id", "date", "regime_label", "confidence", "is_stable", "transition_rate", F.col("k").alias("n_regimes"))


# ---- trades ----
def sized_signals(signals: DataFrame, windows: DataFrame, states: DataFrame, vol: DataFrame, min_confidence: float = cfg.ALLOCATION.min_confidence) -> DataFrame:
    """Signals of every test window with the regime of their date and their size. ``states`` may
    carry ``window_id``: then a window's signals see its own model only."""
    by = ["window_id"] if "window_id" in states.columns else []
    cols = [c for c in states.columns if c not in ("date", "window_id")]
    rows = B.asof_join(B.signals_in_windows(signals, windows), states, by, "date", "date", cols, since="test_start")
    return B.enrich(rows.where(F.col("confidence") >= min_confidence), vol)


def scenario_bars(bars: DataFrame, windows: DataFrame, scenarios: Sequence[B.Scenario] = SCENARIOS, slippage_bps: float = cfg.BACKTEST.slippage_bps) -> DataFrame:
    """(scenario, window_id, ticker, date, close, slippage_bps, fill_delay): the prices of each
    test window, changed by each scenario."""
    rows = B.signals_in_windows(bars.select("ticker", "date", "close"), windows).select("window_id", "ticker", "date", "close")
    return B.stressed(rows, scenarios, slippage_bps, scope=["window_id"])


def scenario_entries(sized: DataFrame, calendar: DataFrame, scenarios: Sequence[B.Scenario] = SCENARIOS) -> DataFrame:
    """A row per signal and scenario with its ``exec_date``: as many bars later as the scenario
    says, held at the window's last bar. ``calendar`` is (window_id, date); signals off it go."""
    w = over("window_id")
    last = F.max("date").over(Window.partitionBy("window_id"))
    days = calendar.select("window_id", "date").distinct()
    fills = F.array(*[F.struct(F.lit(s.name).alias("scenario"), F.coalesce(F.lead("date", s.fill_delay).over(w), last).alias("exec_date")) for s in scenarios])
    return sized.join(days.withColumn("_f", fills), ["window_id", "date"]).select("*", F.explode("_f").alias("_s")).select("*", "_s.*").drop("_f", "_s")


def scenario_trades(paths: DataFrame, entries: DataFrame, rules: B.ExitRules = B.ExitRules()) -> DataFrame:
    """Entries with their exits on the scenario's own path. An entry on a bar that the scenario
    dropped is not filled."""
    labels = B.label_exits(paths, entries, [*PATH, "ticker"], rules)
    return entries.withColumnRenamed("exec_date", "entry_date").join(labels, [*PATH, "ticker", "entry_date"])


def book_returns(paths: DataFrame, trades: DataFrame, calendar: DataFrame, commission_pct: float = cfg.BACKTEST.commission_pct) -> DataFrame:
    """(scenario, window_id, date, ret, invested_pct) on every bar of the window: a sweep over
    +size at entries, -half at take-profits and the rest at exits. No row per trade and day."""
    key = [*PATH, "ticker"]
    size = F.bround(F.col("position_pct") * UNIT).cast("long") * 2
    half = F.when(F.col("take_profit_date").isNull(), F.lit(0)).otherwise(F.expr("_w DIV 2"))
    move = lambda day, up, down: F.struct(F.col(day).alias("date"), up.alias("up"), down.alias("down"))
    none = F.lit(0).cast("long")
    moves = F.array(move("entry_date", F.col("_w"), none), move("take_profit_date", none, half.cast("long")), move("exit_date", none, (F.col("_w") - half).cast("long")))
    moves = trades.withColumn("_w", size).select(*key, F.explode(moves).alias("_m")).select(*key, "_m.*").where("date IS NOT NULL").groupBy(*key, "date").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    w = over(key)
    rows = paths.join(moves, [*key, "date"], "left").na.fill(0, ["up", "down"])
    rows = rows.withColumn("_r", F.try_divide("close", F.lag("close").over(w)) - 1)
    rows = rows.withColumn("_open", F.coalesce(F.sum(F.col("up") - F.col("down")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    slip = F.col("slippage_bps") / 10_000
    gain = F.col("_open") * F.coalesce("_r", F.lit(0.0)) - F.col("up") * slip - F.col("down") * (slip + commission_pct / 100)
    full = 200 * UNIT
    daily = rows.groupBy(*PATH, "date").agg(F.sum(gain).alias("_g"), F.sum(F.greatest("_open", F.col("_open") + F.col("up") - F.col("down"))).alias("_o"))
    grid = trades.select(*PATH).distinct().join(calendar.select("window_id", "date").distinct(), "window_id")
    out = grid.join(daily, [*PATH, "date"], "left")
    return out.select(*PATH, "date", F.coalesce(F.col("_g") / F.greatest("_o", F.lit(full)), F.lit(0.0)).alias("ret"), F.least(F.lit(100.0), F.coalesce(F.col("_o") / (2 * UNIT), F.lit(0.0))).alias("invested_pct"))


def equity(returns: DataFrame) -> DataFrame:
    return returns.withColumn("nav", F.product(1 + F.col("ret")).over(so_far(over(PATH))))


# ---- report ----
def benchmarks(market: DataFrame, windows: DataFrame, trend_window: int = 200, b: cfg.Backtest = cfg.BACKTEST) -> DataFrame:
    """(window_id, buy_and_hold_pct, trend_following_pct); a window of fewer bars than the
    trend's mean has no trend figure."""
    rows = B.signals_in_windows(market.select("date", "close"), windows).select("window_id", "date", "close")
    total = lambda df, name: df.groupBy("window_id").agg(F.bround((F.max_by("nav", "date") / F.min_by("nav", "date") - 1) * 100, 2).alias(name))
    hold = B.buy_and_hold(rows, "window_id", slippage_bps=b.slippage_bps, commission_pct=b.commission_pct)
    trend = B.trend_following(rows, "window_id", trend_window, slippage_bps=b.slippage_bps, commission_pct=b.commission_pct)
    return total(hold, "buy_and_hold_pct").join(total(trend, "trend_following_pct"), "window_id", "left")


def report(trades: DataFrame, returns: DataFrame, market: DataFrame, windows: DataFrame, trend_window: int = 200) -> DataFrame:
    """A row per window and scenario: the metric suite, trade figures, mean share invested, and
    the window's benchmarks."""
    path = F.concat_ws("|", *PATH)
    curve = cut_lineage(equity(returns).withColumn("path", path))
    rets = trades.select(path.alias("path"), (F.col("pnl_pct") / 100).alias("trade_return"), "entry_date", "exit_date")
    suite = M.metric_suite(curve.select("path", "date", "nav"), "path", rets, market.select("date", F.col("close").alias("nav")))
    names = curve.groupBy("path", *PATH).agg(F.bround(F.avg("invested_pct"), 2).alias("avg_invested_pct"))
    out = names.join(suite, "path").drop("path")
    extra = [c for c in ("n_train",) if c in windows.columns]
    return out.join(windows.select("window_id", "test_start", "test_end", *extra), "window_id").join(benchmarks(market, windows, trend_window), "window_id")


def breakdowns(trades: DataFrame, states: DataFrame) -> DataFrame:
    """(window_id, kind, name, n, win_rate, avg_pnl_pct, share): trades of the base scenario by
    regime and by conviction, and the share of test bars spent in each regime. ``states`` is
    (window_id, date, regime_label)."""
    base = trades.where("scenario = 'base'")
    bucket = F.when(F.col("conviction") <= 5, "low").when(F.col("conviction") <= 7, "mid").otherwise("high")
    cells = F.array(F.struct(F.lit("regime").alias("kind"), F.col("regime_label").alias("name")), F.struct(F.lit("conviction").alias("kind"), bucket.alias("name")))
    rows = base.select("window_id", "pnl_pct", F.explode(cells).alias("_c")).select("window_id", "pnl_pct", "_c.*")
    r = F.col("pnl_pct")
    done = rows.groupBy("window_id", "kind", "name").agg(F.count(F.lit(1)).alias("n"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(r).alias("avg_pnl_pct"))
    done = done.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("window_id", "kind")))
    spent = states.groupBy("window_id", F.col("regime_label").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    spent = spent.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("window_id"))).withColumn("kind", F.lit("exposure"))
    return done.unionByName(spent, allowMissingColumns=True)
