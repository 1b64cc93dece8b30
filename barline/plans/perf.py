"""Metric, trade and attribution queries. Each ticker's close series serves as one portfolio."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions import scalars as S
from barline.operators import attribution as A
from barline.operators import joins
from barline.operators import metrics as M
from barline.plans.registry import Tables, query

W = "(PARTITION BY ticker ORDER BY date)"
RF = "(0.04 / 252)"
EQ = f"""eq AS MATERIALIZED (SELECT ticker, date, close AS nav, close / lag(close) OVER {W} - 1 AS ret,
  close / max(close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM bars),
em AS (SELECT ticker, CASE WHEN count(*) < 2 THEN 0 ELSE max_by(nav, date) / min_by(nav, date) - 1 END AS tr, count(*) AS n, stddev_samp(ret) AS sd, avg(ret) AS mean,
  sqrt(avg(power(least(ret - {RF}, 0), 2))) AS dn, abs(min(drawdown)) AS mdd, avg(nav) AS avg_nav FROM eq GROUP BY ticker),
ea AS (SELECT ticker, tr, power(1 + tr, 252.0 / n) - 1 AS ar, sd * sqrt(252) AS vol, coalesce((mean - {RF}) / nullif(sd, 0) * sqrt(252), 0) AS sharpe,
  coalesce((mean - {RF}) / nullif(dn, 0) * sqrt(252), 0) AS sortino, mdd, coalesce((power(1 + tr, 252.0 / n) - 1) / nullif(mdd, 0), 0) AS calmar, avg_nav FROM em)"""
TRADE = "(realized_pnl / (entry_price * shares))"
TR = f"""tm AS (SELECT ticker, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
  CASE WHEN sum(r) FILTER (WHERE r < 0) IS NULL THEN CASE WHEN sum(r) FILTER (WHERE r > 0) > 0 THEN 'inf'::DOUBLE ELSE 0 END ELSE coalesce(sum(r) FILTER (WHERE r > 0), 0) / abs(sum(r) FILTER (WHERE r < 0)) END AS profit_factor,
  avg(r) AS avg_trade_return, count(*) AS n_trades, avg(exit_date - entry_date) AS held, sum(v) AS v FROM (SELECT ticker, {TRADE} AS r, entry_date, exit_date, shares * (entry_price + exit_price) AS v FROM closed_positions) AS q GROUP BY ticker)"""
BM = """bq AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS b FROM market), pr AS (SELECT eq.ticker, eq.date, ret AS s, b FROM eq JOIN bq ON bq.date = eq.date WHERE ret IS NOT NULL AND b IS NOT NULL),
bm AS (SELECT ticker, covar_samp(s, b) / var_samp(b) AS beta, avg(s) AS ms, avg(b) AS mb, avg(s - b) / stddev_samp(s - b) * sqrt(252) AS ir,
  coalesce(covar_samp(s, b) FILTER (WHERE b < 0) / var_samp(b) FILTER (WHERE b < 0), 0) AS db FROM pr GROUP BY ticker)"""


def equity(t: Tables):
    return t.bars.select("ticker", "date", F.col("close").alias("nav"))


def bench(t: Tables):
    return t.market.select("date", F.col("close").alias("nav"))


def bench_returns(t: Tables):
    return M.daily_returns(bench(t).withColumn("k", F.lit("b")), "k").select("date", F.col("ret").alias("bench_ret"))


def pairs(t: Tables):
    return M.aligned_pair(M.daily_returns(equity(t), "ticker").select("ticker", "date", "ret"), bench_returns(t))


def trades(t: Tables):
    r = S.net_trade_return(F.col("realized_pnl"), F.col("entry_price"), F.col("shares"))
    return t.closed_positions.withColumns({"trade_return": r, "traded_value": F.col("shares") * (F.col("entry_price") + F.col("exit_price"))}).where("trade_return IS NOT NULL")


@query("daily_returns", "W32", f"WITH {EQ} SELECT ticker, date, ret FROM eq WHERE ret IS NOT NULL", r="ret", digits=8)
def _(t):
    return M.daily_returns(equity(t), "ticker").where("ret IS NOT NULL").select("ticker", "date", "ret")


@query("drawdowns", "W31", f"WITH {EQ} SELECT ticker, date, drawdown FROM eq", r="drawdown", digits=8)
def _(t):
    return M.drawdowns(equity(t), "ticker").select("ticker", "date", "drawdown")


@query("equity_metrics", "A12 A13 A14 A15 A16 A17", f"WITH {EQ} SELECT ticker, tr AS total_return, ar AS annualized_return, vol AS annualized_vol, sharpe, sortino, mdd AS max_drawdown, calmar, avg_nav FROM ea",
       r="total_return annualized_return annualized_vol sharpe sortino max_drawdown calmar avg_nav", digits=6)
def _(t):
    return M.equity_metrics(equity(t), "ticker")


@query("trade_metrics", "A18 A19 A21 C12", f"WITH {TR} SELECT ticker, win_rate, profit_factor, avg_trade_return, n_trades, held AS avg_holding_days, v AS traded_value FROM tm",
       r="win_rate profit_factor avg_trade_return avg_holding_days traded_value", digits=3)
def _(t):
    return M.trade_metrics(trades(t), "ticker")


@query("turnover", "A20", f"WITH {EQ}, {TR} SELECT ticker, v / avg_nav AS turnover FROM tm JOIN ea USING (ticker)", r="turnover", digits=3)
def _(t):
    j = M.equity_metrics(equity(t), "ticker").join(M.trade_metrics(trades(t), "ticker"), "ticker")
    return j.select("ticker", M.turnover(F.col("traded_value"), F.col("avg_nav")).alias("turnover"))


@query("aligned_returns", "J13", f"WITH {EQ}, {BM} SELECT ticker, date, s AS ret, b AS bench_ret FROM pr", r="ret bench_ret", digits=8)
def _(t):
    return pairs(t).select("ticker", "date", "ret", "bench_ret")


@query("benchmark_metrics", "A22 A23 A24 A25", f"WITH {EQ}, {BM} SELECT ticker, beta, (ms - {RF} - beta * (mb - {RF})) * 252 AS alpha_annualized, ir AS information_ratio, db AS downside_beta FROM bm",
       r="beta alpha_annualized information_ratio downside_beta", digits=6)
def _(t):
    return M.benchmark_metrics(pairs(t), "ticker")


@query("metric_suite", "A26", f"""WITH {EQ}, {TR}, {BM} SELECT ticker, n_trades, round_even(tr * 100, 2) + 0.0 AS total_return_pct, round_even(ar * 100, 2) + 0.0 AS annualized_return_pct, round_even(vol * 100, 2) + 0.0 AS annualized_vol_pct,
round_even(sharpe, 3) + 0.0 AS sharpe, round_even(sortino, 3) + 0.0 AS sortino, round_even(calmar, 3) + 0.0 AS calmar, round_even(mdd * 100, 2) + 0.0 AS max_drawdown_pct, round_even(win_rate, 3) AS win_rate,
round_even(profit_factor, 3) AS profit_factor, round_even(avg_trade_return * 100, 3) + 0.0 AS avg_trade_return_pct, round_even(held, 1) AS avg_holding_period_days, round_even(v / avg_nav, 4) AS turnover,
round_even(beta, 3) + 0.0 AS beta, round_even((ms - {RF} - beta * (mb - {RF})) * 25200, 3) + 0.0 AS alpha_annualized_pct, round_even(ir, 3) + 0.0 AS information_ratio, round_even(db, 3) + 0.0 AS downside_beta
FROM ea JOIN tm USING (ticker) JOIN bm USING (ticker)""")
def _(t):
    return M.metric_suite(equity(t), "ticker", trades(t), bench(t))


@query("portfolio_stats", "A1 C11", """SELECT count(*) AS total_trades, count(*) FILTER (WHERE realized_pnl > 0) AS wins, count(*) FILTER (WHERE realized_pnl <= 0) AS losses,
avg(CASE WHEN realized_pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, sum(realized_pnl) AS total_realized_pnl FROM closed_positions""", r="win_rate total_realized_pnl", digits=3)
def _(t):
    return M.portfolio_stats(t.closed_positions)


@query("pnl_by_source", "A2", """SELECT coalesce(signal_source, 'congressional') AS signal_source, count(*) AS n_trades, count(*) FILTER (WHERE realized_pnl > 0) AS wins, sum(realized_pnl) AS pnl FROM closed_positions GROUP BY 1""", r="pnl", digits=3)
def _(t):
    return M.by_source(t.closed_positions)


@query("performance_report", "A3", """SELECT count(*) AS total_trades, count(*) FILTER (WHERE realized_pnl > 0) AS wins, count(*) FILTER (WHERE realized_pnl <= 0) AS losses, avg(CASE WHEN realized_pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
sum(realized_pnl) AS total_realized_pnl, avg(exit_date - entry_date) AS avg_hold_days, max(realized_pnl) AS best_trade_pnl, min(realized_pnl) AS worst_trade_pnl FROM closed_positions""", r="win_rate total_realized_pnl avg_hold_days best_trade_pnl worst_trade_pnl", digits=3)
def _(t):
    return M.performance_report(t.closed_positions)


PNL = "(exit_price - entry_price) / entry_price * 100"
GROUPED = """count(*) AS n_trades, avg(CASE WHEN p > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(p) AS avg_pnl_pct,
round_even(CASE WHEN sum(p) FILTER (WHERE p < 0) IS NULL THEN CASE WHEN sum(p) FILTER (WHERE p > 0) > 0 THEN 'inf'::DOUBLE ELSE 0 END ELSE coalesce(sum(p) FILTER (WHERE p > 0), 0) / abs(sum(p) FILTER (WHERE p < 0)) END, 3) AS profit_factor"""


def pct_trades(t: Tables):
    return t.closed_positions.withColumn("pnl_pct", (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price") * 100)


@query("trades_by_regime", "A7 J9", f"""WITH x AS (SELECT {PNL} AS p, r.regime_label FROM closed_positions AS c ASOF LEFT JOIN regime_daily AS r ON c.entry_date >= r.date)
SELECT coalesce(regime_label, 'unknown') AS regime_at_entry, {GROUPED} FROM x GROUP BY 1""", r="win_rate avg_pnl_pct")
def _(t):
    rows = joins.asof_join(pct_trades(t), t.regime_daily, [], "entry_date", "date", ["regime_label"], how="left")
    return M.grouped_trades(rows.withColumn("regime_at_entry", F.coalesce("regime_label", F.lit("unknown"))), "regime_at_entry")


@query("conviction_buckets", "A8", f"""WITH x AS (SELECT {PNL} AS p, CASE WHEN conviction <= 5 THEN 'low' WHEN conviction <= 7 THEN 'mid' ELSE 'high' END AS bucket FROM closed_positions),
g AS (SELECT bucket, {GROUPED} FROM x GROUP BY bucket)
SELECT d.bucket, coalesce(n_trades, 0) AS n_trades, coalesce(win_rate, 0.0) AS win_rate, coalesce(avg_pnl_pct, 0.0) AS avg_pnl_pct, coalesce(profit_factor, 0.0) AS profit_factor FROM (VALUES ('low'), ('mid'), ('high')) AS d(bucket) LEFT JOIN g ON g.bucket = d.bucket""", r="win_rate avg_pnl_pct")
def _(t):
    return M.conviction_buckets(pct_trades(t))


@query("regime_exposure", "A9", "SELECT regime_label, count(*) / sum(count(*)) OVER () AS exposure FROM regime_log GROUP BY regime_label", r="exposure", digits=8)
def _(t):
    return M.exposure(t.regime_log)


@query("trades_by_logged_regime", "J10", """WITH n AS (SELECT date, max_by(regime_label, id) AS regime_label FROM regime_log GROUP BY date), x AS (SELECT (exit_price - entry_price) / entry_price AS r, coalesce(n.regime_label, 'unknown') AS regime_label FROM closed_positions AS c LEFT JOIN n ON n.date = c.entry_date)
SELECT regime_label, count(*) AS n_trades, round_even(avg(r) * 100, 2) + 0.0 AS avg_return_pct, round_even(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 3) AS win_rate FROM x GROUP BY regime_label""")
def _(t):
    return M.by_latest_regime(t.closed_positions, t.regime_log)


@query("equity_with_regime", "J11", "SELECT m.date, m.close AS nav, r.regime_label FROM market AS m JOIN regime_daily AS r ON r.date = m.date")
def _(t):
    return bench(t).join(t.regime_daily.select("date", "regime_label"), "date")


@query("date_intersection", "U4", "SELECT date FROM market INTERSECT SELECT date FROM regime_log")
def _(t):
    return t.market.select("date").intersect(t.regime_log.select("date"))


SEQ = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("best_and_worst", "T4", f"""SELECT * FROM (SELECT l_orderkey, l_partkey, ticker, {PNL} AS pnl_pct, 'best' AS side FROM closed_positions ORDER BY pnl_pct DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 5) AS a UNION ALL
SELECT * FROM (SELECT l_orderkey, l_partkey, ticker, {PNL}, 'worst' FROM closed_positions ORDER BY {PNL}, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC LIMIT 5) AS b""", r="pnl_pct")
def _(t):
    return M.best_and_worst(pct_trades(t), "pnl_pct", SEQ).select("l_orderkey", "l_partkey", "ticker", "pnl_pct", "side")


@query("latest_regime", "T5", "SELECT id, date, regime_label, confidence FROM regime_log ORDER BY id DESC LIMIT 1")
def _(t):
    return t.regime_log.orderBy(F.desc("id")).limit(1)


@query("latest_closed", "T5 S14", "SELECT ticker, exit_date, l_orderkey, l_partkey FROM closed_positions ORDER BY exit_date DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50")
def _(t):
    return t.closed_positions.orderBy(F.desc("exit_date"), *SEQ).limit(50).select("ticker", "exit_date", "l_orderkey", "l_partkey")


@query("regime_history", "T6", "SELECT id, date, regime_label FROM regime_log WHERE date >= DATE '2001-06-01' - 90")
def _(t):
    return t.regime_log.where("date >= date_sub(DATE '2001-06-01', 90)").orderBy("date", "id").select("id", "date", "regime_label")


@query("nav_history", "S14", "SELECT portfolio_id, date, nav FROM nav")
def _(t):
    return t.nav.orderBy("date")


@query("closed_scan", "S14", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ticker, exit_date, realized_pnl FROM closed_positions")
def _(t):
    return t.closed_positions.orderBy(F.desc("exit_date")).select(*SEQ, "ticker", "exit_date", "realized_pnl")


@query("vol_gate", "A32", "SELECT 'book' AS portfolio_id, sd AS realized_vol_pct, CASE WHEN sd > 15 THEN 15 / sd ELSE 1.0 END AS port_vol_mult FROM (SELECT stddev_samp(r) * sqrt(252) * 100 AS sd FROM (SELECT nav / lag(nav) OVER (ORDER BY date) - 1 AS r FROM nav) AS q) AS z", r="realized_vol_pct port_vol_mult", digits=6)
def _(t):
    return M.vol_gate(t.nav)


@query("trade_costs", "C8 C9 C10", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, entry_price + entry_price * 10 / 10000 AS fill, shares * entry_price * 0.05 / 100 AS fee,
10 + 2 * (shares * entry_price / nullif(shares * 1000, 0) * 100) AS impact, (10000 - 10000 * 0.05 / 100) / (entry_price * 1.001) AS bought, shares * exit_price * (1 - 0.001) * (1 - 0.0005) AS proceeds FROM closed_positions""", r="fill fee impact bought proceeds", digits=8)
def _(t):
    e, x, n = F.col("entry_price"), F.col("exit_price"), F.col("shares")
    return t.closed_positions.select(
        *SEQ, S.slipped(e, "buy", 10.0).alias("fill"), S.commission(n * e, 0.05).alias("fee"), S.impact_bps(10.0, n * e, n * 1000).alias("impact"),
        S.entry_shares(F.lit(10000.0), e, 10.0, 0.05).alias("bought"), S.exit_proceeds(n, x, 10.0, 0.05).alias("proceeds"))


@query("realized_pnl", "C11 C14", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, exit_price * shares - 1.5 - (entry_price * shares + 2.5) AS realized, (exit_price - entry_price) * shares AS unrealized FROM closed_positions""", r="realized unrealized")
def _(t):
    e, x, n = F.col("entry_price"), F.col("exit_price"), F.col("shares")
    return t.closed_positions.select(*SEQ, S.realized_pnl(e, x, n, F.lit(1.5), F.lit(2.5)).alias("realized"), S.unrealized_pnl(x, e, n).alias("unrealized"))


FACTORS = """fc AS (SELECT m.date, m.b AS mkt, v.x AS fear FROM bq AS m JOIN (SELECT date, vix / lag(vix) OVER (ORDER BY date) - 1 AS x FROM fear) AS v ON v.date = m.date WHERE m.b IS NOT NULL AND v.x IS NOT NULL),
rw AS (SELECT eq.ticker, eq.date, eq.ret AS y, mkt, fear FROM eq JOIN fc ON fc.date = eq.date WHERE ret IS NOT NULL)"""


def factor_rows(t: Tables, names):
    fear = M.daily_returns(t.fear.select(F.lit("v").alias("k"), "date", F.col("vix").alias("nav")), "k").select("date", F.col("ret").alias("fear"))
    factors = bench_returns(t).withColumnRenamed("bench_ret", "mkt").join(fear, "date").dropna()
    return A.with_excess(M.daily_returns(equity(t), "ticker").select("ticker", "date", "ret"), factors, names)


@query("factor_alignment", "J14", f"WITH {EQ}, {BM}, {FACTORS} SELECT ticker, date, y - CASE WHEN mkt > 0 THEN mkt / 10 ELSE 0 END AS ret, mkt, fear FROM rw", r="ret mkt fear", digits=8)
def _(t):
    rf = bench_returns(t).where("bench_ret > 0").select("date", (F.col("bench_ret") / 10).alias("rf"))
    rows = factor_rows(t, ["mkt", "fear"])
    return A.with_excess(rows.select("ticker", "date", "ret"), rows.select("date", "mkt", "fear").distinct(), ["mkt", "fear"], rf)


@query("attribution_one_factor", "A29 A30", f"""WITH {EQ}, {BM}, {FACTORS}, co AS (SELECT ticker, regr_slope(y, mkt) AS b, regr_intercept(y, mkt) AS a, regr_r2(y, mkt) AS r2, count(*) AS n, sum(mkt) AS sx, sum(mkt * mkt) AS sxx FROM rw GROUP BY ticker),
sc AS MATERIALIZED (SELECT rw.ticker, n, row_number() OVER (PARTITION BY rw.ticker ORDER BY date) AS i, y - a - b * mkt AS s0, (y - a - b * mkt) * mkt AS s1, greatest(1, floor(4 * power(n / 100.0, 2.0 / 9))) AS band FROM rw JOIN co ON co.ticker = rw.ticker),
lg AS (SELECT p.ticker, sum(w * p.s0 * q.s0) AS g00, sum(w * p.s0 * q.s1) AS g01, sum(w * p.s1 * q.s0) AS g10, sum(w * p.s1 * q.s1) AS g11 FROM
 (SELECT sc.*, l, 1 - l / (band + 1) AS w FROM sc JOIN (SELECT unnest(range(1, 17)) AS l) AS k ON l <= band) AS p JOIN sc AS q ON q.ticker = p.ticker AND q.i = p.i - p.l GROUP BY p.ticker),
mt AS (SELECT ticker, sum(s0 * s0) AS m00, sum(s0 * s1) AS m01, sum(s1 * s1) AS m11 FROM sc GROUP BY ticker),
sw AS (SELECT co.*, m00 + 2 * g00 AS s00, m01 + g01 + g10 AS s01, m11 + 2 * g11 AS s11, sxx / (n * sxx - sx * sx) AS i00, -sx / (n * sxx - sx * sx) AS i01, n / (n * sxx - sx * sx) AS i11 FROM co JOIN lg USING (ticker) JOIN mt USING (ticker)),
se AS (SELECT *, sqrt(i00 * i00 * s00 + 2 * i00 * i01 * s01 + i01 * i01 * s11) AS e0, sqrt(i01 * i01 * s00 + 2 * i01 * i11 * s01 + i11 * i11 * s11) AS e1 FROM sw)
SELECT ticker, round_even(a * 252, 6) + 0.0 AS alpha, round_even(a * 25200, 4) + 0.0 AS alpha_pct, round_even(a / e0, 3) + 0.0 AS alpha_tstat, round_even(e0 * 252, 6) + 0.0 AS alpha_se, round_even(r2, 4) + 0.0 AS r_squared, round_even(b, 4) + 0.0 AS beta_mkt, round_even(b / e1, 3) + 0.0 AS tstat_mkt, n AS n_obs, n < 30 AS low_sample_warning FROM se""")
def _(t):
    return A.attribute(factor_rows(t, ["mkt"]), "ticker", ["mkt"])


@query("attribution_two_factors", "A29", f"""WITH {EQ}, {BM}, {FACTORS}, co AS (SELECT ticker, covar_samp(y, mkt) AS y1, covar_samp(y, fear) AS y2, covar_samp(mkt, fear) AS c, var_samp(mkt) AS v1, var_samp(fear) AS v2, avg(y) AS my, avg(mkt) AS m1, avg(fear) AS m2, count(*) AS n, var_samp(y) AS vy FROM rw GROUP BY ticker),
b AS (SELECT *, (y1 * v2 - y2 * c) / (v1 * v2 - c * c) AS b1, (y2 * v1 - y1 * c) / (v1 * v2 - c * c) AS b2 FROM co)
SELECT ticker, round_even((my - b1 * m1 - b2 * m2) * 252, 6) + 0.0 AS alpha, round_even((b1 * y1 + b2 * y2) / vy, 4) + 0.0 AS r_squared, round_even(b1, 4) + 0.0 AS beta_mkt, round_even(b2, 4) + 0.0 AS beta_fear, n AS n_obs FROM b""")
def _(t):
    return A.attribute(factor_rows(t, ["mkt", "fear"]), "ticker", ["mkt", "fear"]).select("ticker", "alpha", "r_squared", "beta_mkt", "beta_fear", "n_obs")
