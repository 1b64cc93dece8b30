"""Back-test queries: windows, fills, exits, benchmarks, stress, studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.operators import backtest as B
from barline.operators import disclosures as D
from barline.operators import indicators as I
from barline.operators import metrics as M
from barline.operators import regime as G
from barline.operators import walkforward as W
from barline.plans.model import NAMES, matrix
from barline.plans.registry import Tables, query
from barline.session import cut_lineage

WIN = """sp AS (SELECT min(date) AS a, max(date) AS z FROM market), w0 AS (SELECT a, z, unnest(range(0, 40)) AS window_id FROM sp), w1 AS (SELECT *, CAST(a + to_months(CAST(window_id * 3 AS INT)) AS DATE) AS train_start FROM w0),
w2 AS (SELECT *, CAST(train_start + to_months(36) AS DATE) AS train_end, CAST(CAST(train_start + to_months(36) AS DATE) + 1 AS DATE) AS ts FROM w1), w3 AS (SELECT *, CAST(ts + to_months(6) AS DATE) AS te FROM w2 WHERE CAST(ts + to_months(6) AS DATE) <= z),
w4 AS (SELECT window_id, train_start, train_end, min(date) AS test_start, max(date) AS test_end, count(date) AS n_test FROM w3 LEFT JOIN market ON date BETWEEN ts AND te GROUP BY 1, 2, 3),
win AS MATERIALIZED (SELECT CAST(window_id AS INT) AS window_id, train_start, train_end, test_start, test_end, n_test FROM w4 WHERE window_id < coalesce((SELECT min(window_id) FROM w4 WHERE n_test < 20), 999))"""
STAB = "st AS (SELECT date, regime_label, confidence, coalesce(regime_label = lag(regime_label, 1) OVER w AND regime_label = lag(regime_label, 2) OVER w AND regime_label = lag(regime_label, 3) OVER w, false) AS is_stable FROM regime_daily WINDOW w AS (ORDER BY date))"
SW = "sw AS (SELECT win.window_id, win.test_start, win.test_end, s.* FROM signals AS s JOIN win ON s.date BETWEEN win.test_start AND win.test_end)"
SR = "sr AS (SELECT x.*, r.regime_label, r.confidence, r.is_stable FROM sw AS x ASOF JOIN st AS r ON x.date >= r.date WHERE r.date >= x.test_start AND r.confidence >= 0.4)"
FILL = "cal AS (SELECT date, coalesce(lead(date) OVER (ORDER BY date), date) AS exec_date FROM (SELECT DISTINCT date FROM bars) AS d), fl AS (SELECT s.*, cal.exec_date FROM signals AS s JOIN cal ON cal.date = s.date)"
EXITS = """en AS MATERIALIZED (SELECT DISTINCT fl.ticker, fl.exec_date AS e, b.close + b.close * 0.001 AS fill FROM fl JOIN bars AS b ON b.ticker = fl.ticker AND b.date = fl.exec_date),
pa AS (SELECT en.ticker, e, fill, b.date, b.close, greatest(fill, coalesce(max(b.close) OVER (PARTITION BY en.ticker, e ORDER BY b.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), fill)) AS pk FROM en JOIN bars AS b ON b.ticker = en.ticker AND b.date > e),
h AS (SELECT ticker, e, fill, min(date) FILTER (WHERE (pk - close) / pk * 100 >= 15) AS s, min(date) FILTER (WHERE (close - fill) / fill * 100 >= 40) AS h, min(date) FILTER (WHERE (close - fill) / fill * 100 >= 25) AS t FROM pa GROUP BY 1, 2, 3),
x AS (SELECT en.ticker, en.e AS entry_date, en.fill AS entry_price, coalesce(least(s, h), (SELECT max(date) FROM bars AS q WHERE q.ticker = en.ticker)) AS exit_date, CASE WHEN least(s, h) IS NULL THEN 'end_of_backtest' WHEN s <= h OR h IS NULL THEN 'stop_loss' ELSE 'hard_exit' END AS exit_reason, h.t, least(s, h) AS c
 FROM en LEFT JOIN h ON h.ticker = en.ticker AND h.e = en.e),
lab AS MATERIALIZED (SELECT x.ticker, entry_date, entry_price, exit_date, b.close - b.close * 0.001 AS exit_price, exit_reason, CASE WHEN t < coalesce(c, DATE '9999-01-01') THEN t END AS take_profit_date, b2.close - b2.close * 0.001 AS take_profit_price,
 CASE WHEN b2.close IS NULL THEN ((b.close - b.close * 0.001) * 0.9995 / entry_price - 1) * 100 ELSE (((b.close - b.close * 0.001) * 0.9995 / entry_price - 1) * 100 + ((b2.close - b2.close * 0.001) * 0.9995 / entry_price - 1) * 100) / 2 END AS pnl_pct
 FROM x JOIN bars AS b ON b.ticker = x.ticker AND b.date = x.exit_date LEFT JOIN bars AS b2 ON b2.ticker = x.ticker AND b2.date = CASE WHEN t < coalesce(c, DATE '9999-01-01') THEN t END)"""


def calendar(t: Tables):
    return t.bars.select("date").distinct()


def windows(t: Tables):
    return B.walk_windows(t.market)


def states(t: Tables):
    return G.stability(t.regime_daily).select("date", "regime_label", "confidence", "is_stable")


def trades(t: Tables):
    """Signals filled a bar later, each with the exit of its entry."""
    filled = B.fill_dates(t.signals, calendar(t)).select("id", "ticker", "conviction", F.col("exec_date").alias("entry_date"))
    return filled.join(B.label_exits(t.bars, filled.withColumnRenamed("entry_date", "exec_date")), ["ticker", "entry_date"])


@query("walk_windows", "B1", f"WITH {WIN} SELECT window_id, train_start, train_end, test_start, test_end, n_test FROM win")
def _(t):
    return windows(t)


@query("train_slices", "F18", f"WITH {WIN} SELECT window_id, count(*) AS n_train FROM win JOIN market ON date BETWEEN train_start AND train_end GROUP BY window_id HAVING count(*) >= 500")
def _(t):
    return B.train_slices(windows(t), t.market).select("window_id", "n_train")


@query("signals_in_windows", "J23", f"WITH {WIN}, {SW} SELECT window_id, id, ticker, date FROM sw")
def _(t):
    return B.signals_in_windows(t.signals, windows(t)).select("window_id", "id", "ticker", "date")


@query("signal_regimes", "J9 F19", f"WITH {WIN}, {STAB}, {SW}, {SR} SELECT window_id, id, regime_label, confidence, is_stable FROM sr")
def _(t):
    return B.with_regime(B.signals_in_windows(t.signals, windows(t)), states(t)).select("window_id", "id", "regime_label", "confidence", "is_stable")


@query("enriched_signals", "Z5", f"""WITH {WIN}, {STAB}, {SW}, {SR}, v0 AS (SELECT ticker, date, abs(close / lag(close) OVER w - 1) AS ar FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
v AS (SELECT ticker, date, coalesce(CASE WHEN count(ar) OVER w >= 14 THEN avg(ar) OVER w END * 100, 1.0) AS vol FROM v0 WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
z AS (SELECT s.window_id, s.id, s.conviction, least(8.0, greatest(0.0, 0.15 / coalesce(v.vol, 1.0) * 100)) * CASE regime_label WHEN 'crash' THEN 0.3 WHEN 'bear' THEN 0.5 WHEN 'neutral' THEN 0.7 WHEN 'bull' THEN 1.0 WHEN 'euphoria' THEN 0.75 END * least(1.0, 0.5 + 0.5 * (confidence - 0.4) / 0.6) * CASE WHEN is_stable THEN 1.0 ELSE 0.5 END AS b
 FROM sr AS s ASOF LEFT JOIN v ON v.ticker = s.ticker AND s.date >= v.date)
SELECT window_id, id, least(8.0, greatest(0.0, b + b * 0.2 * ((least(10, greatest(5, conviction)) - 7.5) / 2.5))) AS position_pct FROM z""", r="position_pct", digits=6)
def _(t):
    vol = I.vol_pct_from_close(t.bars).select("ticker", "date", "vol_pct")
    return B.enrich(B.with_regime(B.signals_in_windows(t.signals, windows(t)), states(t)), vol).select("window_id", "id", "position_pct")


@query("fill_dates", "B3", f"WITH {FILL} SELECT id, ticker, date, exec_date FROM fl")
def _(t):
    return B.fill_dates(t.signals, calendar(t)).select("id", "ticker", "date", "exec_date")


@query("exit_labels", "B2", f"WITH {FILL}, {EXITS} SELECT ticker, entry_date, entry_price, exit_date, exit_price, exit_reason, take_profit_date, take_profit_price, pnl_pct FROM lab", r="entry_price exit_price take_profit_price pnl_pct", digits=8)
def _(t):
    filled = B.fill_dates(t.signals, calendar(t))
    return B.label_exits(t.bars, filled)


@query("exit_legs", "B2", f"""WITH {FILL}, {EXITS} SELECT ticker, entry_date, take_profit_date AS date, 'take_profit' AS reason, 0.5 AS share, (take_profit_price * 0.9995 / entry_price - 1) * 100 AS leg_pnl_pct FROM lab WHERE take_profit_date IS NOT NULL
UNION ALL SELECT ticker, entry_date, exit_date, exit_reason, CASE WHEN take_profit_date IS NULL THEN 1.0 ELSE 0.5 END, (exit_price * 0.9995 / entry_price - 1) * 100 FROM lab""", r="share leg_pnl_pct", digits=8)
def _(t):
    filled = B.fill_dates(t.signals, calendar(t)).select("ticker", "exec_date")
    return B.exit_legs(B.label_exits(t.bars, filled)).select("ticker", "entry_date", "date", "reason", "share", "leg_pnl_pct")


@query("labelled_signals", "B2 J2", f"WITH {FILL}, {EXITS} SELECT fl.id, fl.ticker, fl.conviction, lab.exit_reason, pnl_pct FROM fl JOIN lab ON lab.ticker = fl.ticker AND lab.entry_date = fl.exec_date", r="pnl_pct", digits=6)
def _(t):
    return trades(t).select("id", "ticker", "conviction", "exit_reason", "pnl_pct")


OPEN = f"""rt AS (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM bars),
tr AS (SELECT fl.id, fl.ticker, lab.entry_date, lab.exit_date FROM fl JOIN lab ON lab.ticker = fl.ticker AND lab.entry_date = fl.exec_date),
mv AS (SELECT ticker, date, sum(x) AS x FROM (SELECT ticker, entry_date AS date, 1 AS x FROM tr UNION ALL SELECT ticker, exit_date, -1 FROM tr) AS q GROUP BY 1, 2),
no AS (SELECT rt.ticker, rt.date, r, sum(coalesce(x, 0)) OVER (PARTITION BY rt.ticker ORDER BY rt.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM rt LEFT JOIN mv ON mv.ticker = rt.ticker AND mv.date = rt.date),
dr AS MATERIALIZED (SELECT date, sum(n * r) / sum(n) AS ret, CAST(sum(n) AS BIGINT) AS n_open FROM no WHERE n > 0 AND r IS NOT NULL GROUP BY date)"""


@query("open_trade_returns", "B4", f"WITH {FILL}, {EXITS}, {OPEN} SELECT date, ret, n_open, product(1 + ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS nav FROM dr", r="ret nav", digits=8)
def _(t):
    daily = B.open_trade_returns(t.bars, trades(t))
    return B.compounded(daily.withColumn("k", F.lit("all")), "k").select("date", "ret", "n_open", "nav")


@query("buy_and_hold", "B5", "SELECT date, close * ((100000 - 100000 * 0.05 / 100) / (first_value(close) OVER (ORDER BY date) * 1.001)) AS nav FROM market", r="nav")
def _(t):
    return B.buy_and_hold(t.market, "market_id", slippage_bps=10.0, commission_pct=0.05).select("date", "nav")


@query("trend_following", "B6", """WITH m AS (SELECT date, close, coalesce(close > CASE WHEN count(*) OVER w >= 100 THEN avg(close) OVER w END, false) AS o FROM market WINDOW w AS (ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
g AS (SELECT *, coalesce(lag(o) OVER (ORDER BY date), false) AS p, lag(close) OVER (ORDER BY date) AS pc FROM m)
SELECT date, 100000 * product(CASE WHEN p THEN close / pc ELSE 1 END * CASE WHEN o AND NOT p THEN 0.9995 / 1.001 WHEN p AND NOT o THEN 0.999 * 0.9995 ELSE 1 END) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS nav FROM g""", r="nav", digits=3)
def _(t):
    return B.trend_following(t.market, "market_id", slippage_bps=10.0, commission_pct=0.05).select("date", "nav")


STRESS = """nb AS (SELECT ticker, count(*) AS n FROM bars GROUP BY ticker), ix AS (SELECT bars.ticker, date, close, n, (SELECT greatest(1, max(n) // 4) FROM nb) AS s, row_number() OVER (PARTITION BY bars.ticker ORDER BY date) - 1 AS i,
  row_number() OVER (PARTITION BY bars.ticker ORDER BY sha256(concat_ws('|', bars.ticker, CAST(date AS VARCHAR), '42'))) AS hh, ln(close / lag(close) OVER (PARTITION BY bars.ticker ORDER BY date)) AS lr FROM bars JOIN nb ON nb.ticker = bars.ticker),
an AS (SELECT *, max(CASE WHEN i = s - 1 THEN close END) OVER (PARTITION BY ticker) AS a, max(CASE WHEN i = s + 4 THEN close END) OVER (PARTITION BY ticker) AS z, sum(CASE WHEN i BETWEEN s AND s + 19 THEN lr END) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum FROM ix)"""


@query("stress_paths", "B7 B8 B9 B10", f"""WITH {STRESS}
SELECT 'sudden_crash' AS scenario, ticker, date, CASE WHEN i < s THEN close WHEN i < s + 5 THEN a * exp(ln(0.7) * (i - s + 1) / 5) ELSE a * 0.7 * close / z END AS close, 10.0 AS slippage_bps, 0 AS fill_delay FROM an
UNION ALL SELECT 'high_vol_cluster', ticker, date, CASE WHEN i BETWEEN s AND s + 19 THEN a * exp(3 * cum) ELSE close END, 10.0, 0 FROM an
UNION ALL SELECT 'slippage_spike', ticker, date, close, 50.0, 0 FROM an UNION ALL SELECT 'delayed_fills', ticker, date, close, 10.0, 2 FROM an
UNION ALL SELECT 'missing_data', ticker, date, close, 10.0, 0 FROM an WHERE hh > CAST(floor(n * 0.05) AS BIGINT)""", r="close slippage_bps", digits=6)
def _(t):
    return B.stressed(t.bars).select("scenario", "ticker", "date", "close", "slippage_bps", "fill_delay")


@query("leverage_decay", "B11", """WITH r AS (SELECT ticker, close / lag(close) OVER w - 1 AS ret, row_number() OVER w - 1 AS i FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)), g AS (SELECT ticker, product(1 - 2 * ret) AS f, product(1 + ret) AS u, count(*) AS n, stddev_samp(ret) AS sd FROM r WHERE i BETWEEN 1 AND 252 GROUP BY ticker)
SELECT ticker, f AS final_nav, power(u, -2.0) AS theoretical_nav, f - power(u, -2.0) AS decay, (f - power(u, -2.0)) / power(u, -2.0) * (252 / n) * 100 AS annualised_decay_pct, sd AS daily_vol, n * sd * sd / 2 AS vol_drag_estimate FROM g""", r="final_nav theoretical_nav decay annualised_decay_pct daily_vol vol_drag_estimate", digits=6)
def _(t):
    rets = M.daily_returns(t.bars.select("ticker", "date", F.col("close").alias("nav")), "ticker")
    return B.leverage_decay(rets, "ticker", -2.0)


BEAR = """eq AS (SELECT ticker, date, close, close / lag(close) OVER w - 1 AS ret, close / max(close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
gg AS (SELECT ticker, count(*) FILTER (WHERE dd < -0.15) AS deep, quantile_cont(ret, 0.2) AS cut FROM eq GROUP BY ticker), be AS (SELECT eq.ticker, eq.date, eq.close FROM eq JOIN gg ON gg.ticker = eq.ticker WHERE CASE WHEN deep >= 5 THEN dd < -0.15 ELSE ret < cut END)"""


@query("bear_days", "B13", f"WITH {BEAR} SELECT ticker, date FROM be")
def _(t):
    return B.bear_days(t.bars.select("ticker", "date", F.col("close").alias("nav")), "ticker").select("ticker", "date")


@query("hedge_overlay", "B12", f"""WITH {BEAR}, cu AS (SELECT be.ticker, be.date, coalesce(be.close / lag(be.close) OVER w - 1, 0) AS p, coalesce(m.close / lag(m.close) OVER w - 1, 0) AS u FROM be JOIN market AS m ON m.date = be.date WINDOW w AS (PARTITION BY be.ticker ORDER BY be.date)),
lg AS (SELECT ticker, 'inverse_etf' AS approach, date, 0.75 * p - 0.25 * u AS r FROM cu UNION ALL SELECT ticker, 'gross_reduction', date, 0.5 * p FROM cu), ec AS (SELECT *, product(1 + r) OVER (PARTITION BY ticker, approach ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM lg),
ed AS (SELECT *, e / max(e) OVER (PARTITION BY ticker, approach ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd, e / lag(e) OVER (PARTITION BY ticker, approach ORDER BY date) - 1 AS x FROM ec)
SELECT ticker, approach, round_even((max_by(e, date) / min_by(e, date) - 1) * 100, 3) + 0.0 AS total_return_pct, round_even(coalesce((avg(x) - 0.04 / 252) / nullif(stddev_samp(x), 0) * sqrt(252), 0), 3) + 0.0 AS sharpe, round_even(min(dd) * 100, 3) + 0.0 AS max_drawdown_pct,
round_even((power(max_by(e, date) / min_by(e, date), 252.0 / count(*)) - 1) * 100, 3) + 0.0 AS annualised_return_pct FROM ed GROUP BY ticker, approach HAVING count(*) >= 2""")
def _(t):
    bear = B.bear_days(t.bars.select("ticker", "date", F.col("close").alias("nav")), "ticker").select("ticker", "date", "nav")
    return B.hedge_overlay(bear.join(t.market.select("date", F.col("close").alias("underlying")), "date"), "ticker")


VAR = """va AS (SELECT * FROM (VALUES ('factor_only', -1), ('congress_lag7', 7), ('congress_lag14', 14), ('congress_lag30', 30), ('congress_lag45', 45)) AS v(variant, lag_limit)),
vt AS (SELECT variant, fl.ticker, lab.entry_date, lab.exit_date FROM fl JOIN lab ON lab.ticker = fl.ticker AND lab.entry_date = fl.exec_date JOIN va ON fl.conviction >= 9 OR (fl.lag_days <= lag_limit AND NOT EXISTS (SELECT 1 FROM fl AS q WHERE q.conviction >= 9 AND q.date = fl.date AND q.ticker = fl.ticker))),
vm AS (SELECT variant, ticker, date, sum(x) AS x FROM (SELECT variant, ticker, entry_date AS date, 1 AS x FROM vt UNION ALL SELECT variant, ticker, exit_date, -1 FROM vt) AS q GROUP BY 1, 2, 3),
vg AS (SELECT k.variant, rt.ticker, rt.date, r, sum(coalesce(x, 0)) OVER (PARTITION BY k.variant, rt.ticker ORDER BY rt.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM (SELECT DISTINCT variant, ticker FROM vt) AS k JOIN rt ON rt.ticker = k.ticker LEFT JOIN vm ON vm.variant = k.variant AND vm.ticker = rt.ticker AND vm.date = rt.date),
vr AS (SELECT variant, date, sum(n * r) / sum(n) AS ret FROM vg WHERE n > 0 AND r IS NOT NULL GROUP BY 1, 2), ve AS (SELECT variant, date, product(1 + ret) OVER (PARTITION BY variant ORDER BY date ROWS UNBOUNDED PRECEDING) AS nav FROM vr),
vs AS (SELECT variant, nav, date, nav / lag(nav) OVER (PARTITION BY variant ORDER BY date) - 1 AS x FROM ve), vz AS (SELECT variant, round_even((max_by(nav, date) / min_by(nav, date) - 1) * 100, 2) + 0.0 AS total_return_pct, round_even((avg(x) - 0.04 / 252) / stddev_samp(x) * sqrt(252), 3) + 0.0 AS sharpe FROM vs GROUP BY variant)"""


def edge_metrics(t: Tables):
    """Baseline and lag variants: labels are made once and shared by all of them."""
    filled = B.fill_dates(t.signals, calendar(t)).withColumn("entry_date", F.col("exec_date"))
    labels = B.label_exits(t.bars, filled)
    factor = filled.where("conviction >= 9").select("date", "ticker", "entry_date")
    rest = filled.select("date", "ticker", "entry_date", "lag_days")
    merged = D.merged_variants(factor, rest).select(F.concat(F.lit("congress_lag"), "max_lag").alias("variant"), "ticker", "entry_date")
    every = merged.unionByName(factor.select(F.lit("factor_only").alias("variant"), "ticker", "entry_date"))
    daily = B.open_trade_returns(t.bars, every.join(labels, ["ticker", "entry_date"]), ["variant"])
    return M.metric_suite(B.compounded(daily, "variant").select("variant", "date", "nav"), "variant")


@query("edge_study", "B14", f"WITH {FILL}, {EXITS}, {OPEN}, {VAR} SELECT variant, total_return_pct, sharpe FROM vz")
def _(t):
    return edge_metrics(t).select("variant", "total_return_pct", "sharpe")


@query("edge_summary", "A36", f"""WITH {FILL}, {EXITS}, {OPEN}, {VAR}, d AS (SELECT v.variant, v.sharpe - b.sharpe AS g FROM vz AS v JOIN vz AS b ON b.variant = 'factor_only' WHERE v.variant <> 'factor_only')
SELECT (SELECT variant FROM d ORDER BY g DESC, variant DESC LIMIT 1) AS best_variant, max(g) AS best_gain, max(g) > 0.05 AS keeps_edge FROM d""", r="best_gain")
def _(t):
    return B.edge_summary(edge_metrics(t))


WRET = f"wb AS (SELECT window_id, test_start, test_end, m.date, m.close FROM win JOIN market AS m ON m.date BETWEEN test_start AND test_end)"


@query("pooled_returns", "A31", f"""WITH {WIN}, wr AS (SELECT window_id, s.date, s.close / lag(s.close) OVER (PARTITION BY window_id ORDER BY s.date) - 1 AS ret FROM win JOIN market AS s ON s.date BETWEEN test_start AND test_end),
o AS (SELECT date, min_by(ret, window_id) AS ret FROM wr WHERE ret IS NOT NULL GROUP BY date), b AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS bench_ret FROM market) SELECT o.date, ret, bench_ret FROM o JOIN b ON b.date = o.date WHERE bench_ret IS NOT NULL""", r="ret bench_ret", digits=8)
def _(t):
    rows = B.signals_in_windows(t.market, windows(t))
    rets = M.daily_returns(rows, "window_id", "close").where("ret IS NOT NULL")
    bench = M.daily_returns(t.market, "market_id", "close").select("date", F.col("ret").alias("bench_ret"))
    return B.pooled_returns(rets, bench).select("date", "ret", "bench_ret")


@query("window_aggregate", "A27", f"""WITH {WIN}, {WRET}, e AS (SELECT window_id, max_by(close, date) / min_by(close, date) - 1 AS tr, count(*) AS n_bars FROM wb GROUP BY window_id) SELECT 'total_return_pct' AS metric, round_even(avg(round_even(tr * 100, 2)), 3) + 0.0 AS avg, round_even(min(round_even(tr * 100, 2)), 3) + 0.0 AS min, round_even(max(round_even(tr * 100, 2)), 3) + 0.0 AS max, count(*) AS n_windows FROM e""")
def _(t):
    rows = B.signals_in_windows(t.market.select("date", F.col("close").alias("nav")), windows(t))
    suite = M.metric_suite(rows.select("window_id", "date", "nav"), "window_id")
    return B.aggregate_windows(suite, ["total_return_pct"])


@query("window_exposure", "A27 A9", f"""WITH {WIN}, r AS (SELECT window_id, regime_label FROM win JOIN regime_daily AS d ON d.date BETWEEN test_start AND test_end), s AS (SELECT window_id, regime_label, count(*) / sum(count(*)) OVER (PARTITION BY window_id) AS x FROM r GROUP BY 1, 2)
SELECT regime_label, round_even(sum(x) / (SELECT count(*) FROM win), 4) + 0.0 AS avg_exposure FROM s GROUP BY regime_label""")
def _(t):
    return B.aggregate_exposure(t.regime_daily, windows(t))


@query("window_excess", "A37", f"""WITH {WIN}, {WRET}, e AS (SELECT window_id, (max_by(close, date) / min_by(close, date) - 1) * 100 AS tr FROM wb GROUP BY window_id), f AS (SELECT window_id, tr * 1.5 AS s, tr AS b FROM e)
SELECT count(*) AS n_windows, avg(s) AS avg_return_pct, avg(s - b) AS avg_excess_pct, 100000 * power(1 + avg(s) / 100, count(*)) AS implied_value FROM f""", r="avg_return_pct avg_excess_pct implied_value", digits=3)
def _(t):
    rows = B.signals_in_windows(t.market.select("date", F.col("close").alias("nav")), windows(t))
    tr = M.equity_metrics(rows.select("window_id", "date", "nav"), "window_id").select("window_id", (F.col("total_return") * 100).alias("bench_return_pct"))
    return B.window_excess(tr.select("window_id", (F.col("bench_return_pct") * 1.5).alias("total_return_pct")), tr)


# ---- the whole study: windows with enough training bars x scenarios ----
WF = f"""{WIN}, {STAB}, {SW}, {SR}, gt AS MATERIALIZED (SELECT window_id, test_start, test_end, count(*) AS n_train FROM win JOIN market AS m ON m.date BETWEEN train_start AND train_end GROUP BY 1, 2, 3 HAVING count(*) >= 500),
v0 AS (SELECT ticker, date, abs(close / lag(close) OVER w - 1) AS ar FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
v AS (SELECT ticker, date, coalesce(CASE WHEN count(ar) OVER w >= 14 THEN avg(ar) OVER w END * 100, 1.0) AS vol FROM v0 WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
zz AS (SELECT s.window_id, s.id, s.ticker, s.date, s.conviction, s.regime_label, least(8.0, greatest(0.0, 0.15 / coalesce(v.vol, 1.0) * 100)) * CASE regime_label WHEN 'crash' THEN 0.3 WHEN 'bear' THEN 0.5 WHEN 'neutral' THEN 0.7 WHEN 'bull' THEN 1.0 WHEN 'euphoria' THEN 0.75 END * least(1.0, 0.5 + 0.5 * (confidence - 0.4) / 0.6) * CASE WHEN is_stable THEN 1.0 ELSE 0.5 END AS b
 FROM sr AS s ASOF LEFT JOIN v ON v.ticker = s.ticker AND s.date >= v.date),
sz AS (SELECT zz.window_id, id, ticker, date, conviction, regime_label, least(8.0, greatest(0.0, b + b * 0.2 * ((least(10, greatest(5, conviction)) - 7.5) / 2.5))) AS pct FROM zz JOIN gt ON gt.window_id = zz.window_id),
wc AS MATERIALIZED (SELECT window_id, m.date, max(m.date) OVER (PARTITION BY window_id) AS dz, lead(m.date, 1) OVER (PARTITION BY window_id ORDER BY m.date) AS d1, lead(m.date, 2) OVER (PARTITION BY window_id ORDER BY m.date) AS d2 FROM gt JOIN market AS m ON m.date BETWEEN test_start AND test_end),
tb AS (SELECT window_id, b.ticker, b.date, b.close FROM gt JOIN bars AS b ON b.date BETWEEN test_start AND test_end), nb AS (SELECT window_id, ticker, count(*) AS n FROM tb GROUP BY 1, 2), ns AS (SELECT window_id, greatest(1, max(n) // 4) AS s FROM nb GROUP BY 1),
ix AS (SELECT tb.window_id, tb.ticker, tb.date, tb.close, n, s, least(s + 5, n) AS f, row_number() OVER w - 1 AS i, row_number() OVER (PARTITION BY tb.window_id, tb.ticker ORDER BY sha256(concat_ws('|', tb.ticker, CAST(tb.date AS VARCHAR), '42'))) AS hh, ln(tb.close / lag(tb.close) OVER w) AS lr
 FROM tb JOIN nb ON nb.window_id = tb.window_id AND nb.ticker = tb.ticker JOIN ns ON ns.window_id = tb.window_id WINDOW w AS (PARTITION BY tb.window_id, tb.ticker ORDER BY tb.date)),
an AS (SELECT *, max(CASE WHEN i = s - 1 THEN close END) OVER p AS a, max(CASE WHEN i = f - 1 THEN close END) OVER p AS z, sum(CASE WHEN i BETWEEN s AND s + 19 THEN lr END) OVER (PARTITION BY window_id, ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum FROM ix WINDOW p AS (PARTITION BY window_id, ticker)),
sc AS (SELECT * FROM (VALUES ('base', 0.001, 1), ('sudden_crash', 0.001, 0), ('high_vol_cluster', 0.001, 0), ('slippage_spike', 0.005, 0), ('delayed_fills', 0.001, 2), ('missing_data', 0.001, 0)) AS q(scenario, slip, delay)),
sb AS MATERIALIZED (SELECT scenario, CAST(slip AS DOUBLE) AS slip, window_id, ticker, date, CASE scenario WHEN 'sudden_crash' THEN CASE WHEN i < s THEN close WHEN i < f THEN a * exp(ln(0.7) * (i - s + 1) / (f - s)) ELSE a * 0.7 * close / z END WHEN 'high_vol_cluster' THEN CASE WHEN i BETWEEN s AND s + 19 THEN a * exp(3 * cum) ELSE close END ELSE close END AS close
 FROM an CROSS JOIN sc WHERE scenario <> 'missing_data' OR hh > CAST(floor(n * 0.05) AS BIGINT)),
fe AS (SELECT sc.scenario, sz.*, CASE delay WHEN 0 THEN wc.date WHEN 1 THEN coalesce(d1, dz) ELSE coalesce(d2, dz) END AS e FROM sz JOIN wc ON wc.window_id = sz.window_id AND wc.date = sz.date CROSS JOIN sc),
en AS MATERIALIZED (SELECT DISTINCT fe.scenario, fe.window_id, fe.ticker, fe.e, b.close + b.close * slip AS fill FROM fe JOIN sb AS b ON b.scenario = fe.scenario AND b.window_id = fe.window_id AND b.ticker = fe.ticker AND b.date = fe.e),
pa AS (SELECT en.scenario, en.window_id, en.ticker, e, fill, b.date, b.close, greatest(fill, coalesce(max(b.close) OVER (PARTITION BY en.scenario, en.window_id, en.ticker, e ORDER BY b.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), fill)) AS pk
 FROM en JOIN sb AS b ON b.scenario = en.scenario AND b.window_id = en.window_id AND b.ticker = en.ticker AND b.date > e),
h AS (SELECT scenario, window_id, ticker, e, min(date) FILTER (WHERE (pk - close) / pk * 100 >= 15) AS st, min(date) FILTER (WHERE (close - fill) / fill * 100 >= 40) AS hd, min(date) FILTER (WHERE (close - fill) / fill * 100 >= 25) AS tp FROM pa GROUP BY 1, 2, 3, 4),
lz AS (SELECT scenario, window_id, ticker, max(date) AS z FROM sb GROUP BY 1, 2, 3),
x AS (SELECT en.*, coalesce(least(st, hd), lz.z) AS exit_date, CASE WHEN tp < coalesce(least(st, hd), DATE '9999-01-01') THEN tp END AS tp FROM en JOIN lz ON lz.scenario = en.scenario AND lz.window_id = en.window_id AND lz.ticker = en.ticker LEFT JOIN h ON h.scenario = en.scenario AND h.window_id = en.window_id AND h.ticker = en.ticker AND h.e = en.e),
lab AS (SELECT x.*, ((b.close - b.close * b.slip) * 0.9995 / fill - 1) * 100 AS p1, ((c.close - c.close * c.slip) * 0.9995 / fill - 1) * 100 AS p2 FROM x JOIN sb AS b ON b.scenario = x.scenario AND b.window_id = x.window_id AND b.ticker = x.ticker AND b.date = x.exit_date
 LEFT JOIN sb AS c ON c.scenario = x.scenario AND c.window_id = x.window_id AND c.ticker = x.ticker AND c.date = x.tp),
tk AS MATERIALIZED (SELECT fe.*, exit_date, tp, coalesce((p1 + p2) / 2, p1) AS pnl, CAST(round_even(pct * 1000000, 0) AS BIGINT) * 2 AS w FROM fe JOIN lab ON lab.scenario = fe.scenario AND lab.window_id = fe.window_id AND lab.ticker = fe.ticker AND lab.e = fe.e)"""
CURVE = """mo AS (SELECT scenario, window_id, ticker, e AS date, w AS up, 0 AS dn FROM tk UNION ALL SELECT scenario, window_id, ticker, tp, 0, w // 2 FROM tk WHERE tp IS NOT NULL UNION ALL SELECT scenario, window_id, ticker, exit_date, 0, w - CASE WHEN tp IS NULL THEN 0 ELSE w // 2 END FROM tk),
mv AS (SELECT scenario, window_id, ticker, date, sum(up) AS up, sum(dn) AS dn FROM mo GROUP BY 1, 2, 3, 4),
dl AS (SELECT b.scenario, b.window_id, b.date, slip, b.close / lag(b.close) OVER w - 1 AS r, coalesce(up, 0) AS up, coalesce(dn, 0) AS dn, coalesce(sum(coalesce(up, 0) - coalesce(dn, 0)) OVER (PARTITION BY b.scenario, b.window_id, b.ticker ORDER BY b.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS op
 FROM sb AS b LEFT JOIN mv ON mv.scenario = b.scenario AND mv.window_id = b.window_id AND mv.ticker = b.ticker AND mv.date = b.date WINDOW w AS (PARTITION BY b.scenario, b.window_id, b.ticker ORDER BY b.date)),
gg AS (SELECT scenario, window_id, date, sum(op * coalesce(r, 0) - up * slip - dn * (slip + 0.0005)) AS g, sum(greatest(op, op + up - dn)) AS o FROM dl GROUP BY 1, 2, 3),
cv AS (SELECT k.scenario, k.window_id, wc.date, coalesce(g / greatest(o, 200000000), 0) AS ret, least(100.0, coalesce(o / 2000000, 0.0)) AS inv FROM (SELECT DISTINCT scenario, window_id FROM tk) AS k JOIN wc ON wc.window_id = k.window_id LEFT JOIN gg ON gg.scenario = k.scenario AND gg.window_id = k.window_id AND gg.date = wc.date),
nv AS (SELECT *, product(1 + ret) OVER (PARTITION BY scenario, window_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS nav FROM cv), dd AS (SELECT *, nav / max(nav) OVER (PARTITION BY scenario, window_id ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM nv)"""
TREND = """mw AS (SELECT window_id, m.date, m.close, count(*) OVER (PARTITION BY window_id) AS nw, coalesce(m.close > CASE WHEN count(*) OVER w >= 50 THEN avg(m.close) OVER w END, false) AS o FROM gt JOIN market AS m ON m.date BETWEEN test_start AND test_end WINDOW w AS (PARTITION BY window_id ORDER BY m.date ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
mg AS (SELECT *, coalesce(lag(o) OVER w, false) AS p, lag(close) OVER w AS pc FROM mw WINDOW w AS (PARTITION BY window_id ORDER BY date)), mn AS (SELECT *, product(CASE WHEN p THEN close / pc ELSE 1 END * CASE WHEN o AND NOT p THEN 0.9995 / 1.001 WHEN p AND NOT o THEN 0.999 * 0.9995 ELSE 1 END) OVER (PARTITION BY window_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS nav FROM mg),
bm AS (SELECT window_id, (max_by(close, date) / min_by(close, date) - 1) * 100 AS hold, CASE WHEN max(nw) >= 100 THEN (max_by(nav, date) / min_by(nav, date) - 1) * 100 END AS trend FROM mn GROUP BY window_id)"""


def gated(t: Tables):
    return cut_lineage(B.train_slices(windows(t), t.market))


def window_days(t: Tables, w):
    return B.signals_in_windows(t.market.select("date"), w).select("window_id", "date")


def studied(t: Tables, w, known):
    """Paths, trades and daily returns of every window and scenario, under the given states."""
    days = window_days(t, w)
    sized = W.sized_signals(t.signals, w, known, I.vol_pct_from_close(t.bars).select("ticker", "date", "vol_pct"))
    paths = cut_lineage(W.scenario_bars(t.bars, w))
    trades = cut_lineage(W.scenario_trades(paths, W.scenario_entries(sized, days)))
    return trades, W.book_returns(paths, trades, days)


@query("walk_forward_report", "B15", f"""WITH {WF}, {CURVE}, {TREND}, q AS (SELECT scenario, window_id, count(*) AS n_trades, avg(CAST(pnl > 0 AS INT)) AS win_rate, avg(pnl) AS pnl FROM tk GROUP BY 1, 2),
c AS (SELECT scenario, window_id, (max_by(nav, date) / min_by(nav, date) - 1) * 100 AS tr, -min(dd) * 100 AS dd, avg(inv) AS inv FROM dd GROUP BY 1, 2)
SELECT c.window_id, c.scenario, test_start, test_end, n_train, n_trades, round_even(win_rate, 3) AS win_rate, round_even(pnl, 3) AS avg_trade_return_pct, round_even(tr, 2) AS total_return_pct, round_even(dd, 2) AS max_drawdown_pct, round_even(inv, 2) AS avg_invested_pct, round_even(hold, 2) AS buy_and_hold_pct, round_even(trend, 2) AS trend_following_pct
FROM c JOIN q ON q.scenario = c.scenario AND q.window_id = c.window_id JOIN gt ON gt.window_id = c.window_id JOIN bm ON bm.window_id = c.window_id""", r="win_rate avg_trade_return_pct total_return_pct max_drawdown_pct avg_invested_pct buy_and_hold_pct trend_following_pct", digits=3)
def _(t):
    """A row per window and scenario, under the logged regimes; the trend's mean takes 100 bars."""
    w = gated(t)
    trades, returns = studied(t, w, states(t))
    out = W.report(trades, returns, t.market, w, trend_window=100)
    return out.select("window_id", "scenario", "test_start", "test_end", "n_train", "n_trades", "win_rate", "avg_trade_return_pct", "total_return_pct", "max_drawdown_pct", "avg_invested_pct", "buy_and_hold_pct", "trend_following_pct")


@query("walk_breakdowns", "B15 A7 A8", f"""WITH {WF}, u AS (SELECT window_id, 'regime' AS kind, regime_label AS name, pnl FROM tk WHERE scenario = 'base' UNION ALL SELECT window_id, 'conviction', CASE WHEN conviction <= 5 THEN 'low' WHEN conviction <= 7 THEN 'mid' ELSE 'high' END, pnl FROM tk WHERE scenario = 'base'),
e AS (SELECT window_id, regime_label AS name, count(*) AS n FROM gt JOIN regime_daily AS d ON d.date BETWEEN test_start AND test_end GROUP BY 1, 2)
SELECT window_id, kind, name, count(*) AS n, avg(CAST(pnl > 0 AS INT)) AS win_rate, avg(pnl) AS avg_pnl_pct, count(*) / sum(count(*)) OVER (PARTITION BY window_id, kind) AS share FROM u GROUP BY 1, 2, 3
UNION ALL SELECT window_id, 'exposure', name, n, NULL, NULL, n / sum(n) OVER (PARTITION BY window_id) FROM e""", r="win_rate avg_pnl_pct share")
def _(t):
    w, known = gated(t), states(t)
    trades, _ = studied(t, w, known)
    return W.breakdowns(trades, B.signals_in_windows(known, w).select("window_id", "date", "regime_label"))


@query("walk_forward", "B15")
def _(t):
    """The same report with a regime model fitted on each window's training bars (two or three
    states, ten steps, one start)."""
    w = gated(t)
    rows = matrix(t).withColumn("ret", F.col("ret_1d"))
    scaled, models = W.window_models(rows, w, NAMES, ks=(2, 3), iterations=10, restarts=1)
    trades, returns = studied(t, w, cut_lineage(W.window_states(scaled, models, NAMES)))
    return W.report(trades, returns, t.market, w).join(models.select("window_id", F.col("k").alias("n_regimes")), "window_id")
