"""Indicator queries over the bars panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline import config as cfg
from barline.functions import scalars as S
from barline.operators import indicators as I
from barline.plans.registry import query

W = "(PARTITION BY ticker ORDER BY date)"


def last(n: int) -> str:
    return f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(fn: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {last(n)} >= {n} THEN {fn}({x}) OVER {last(n)} END"


def ret(n: int, x: str = "close") -> str:
    return f"coalesce(({x} - lag({x}, {n}) OVER {W}) / nullif(lag({x}, {n}) OVER {W}, 0) * 100, 0)"


def pct(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif({b}, 0) * 100, 0)"


BASIC = f"""b AS MATERIALIZED (SELECT *, row_number() OVER {W} AS rn, lag(close) OVER {W} AS pc FROM bars),
smas AS (SELECT *, {full('avg', 'close', 20)} AS sma20, {full('avg', 'close', 50)} AS sma50, {full('avg', 'close', 200)} AS sma200,
  greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM b)"""
EWM = """gl AS MATERIALIZED (SELECT ticker, date, rn, close, greatest(close - pc, 0.0) AS g, greatest(pc - close, 0.0) AS l FROM b),
ew AS (SELECT ticker, date, rn, CAST(NULL AS DOUBLE) AS ag, CAST(NULL AS DOUBLE) AS al, close AS f, close AS s, CAST(0.0 AS DOUBLE) AS macd, CAST(0.0 AS DOUBLE) AS sig FROM gl WHERE rn = 1
UNION ALL SELECT x.ticker, gl.date, gl.rn, CASE WHEN gl.rn = 2 THEN gl.g ELSE x.ag * 13.0 / 14 + gl.g / 14 END, CASE WHEN gl.rn = 2 THEN gl.l ELSE x.al * 13.0 / 14 + gl.l / 14 END,
  x.f * 11.0 / 13 + gl.close * 2 / 13, x.s * 25.0 / 27 + gl.close * 2 / 27,
  (x.f * 11.0 / 13 + gl.close * 2 / 13) - (x.s * 25.0 / 27 + gl.close * 2 / 27),
  x.sig * 0.8 + 0.2 * ((x.f * 11.0 / 13 + gl.close * 2 / 13) - (x.s * 25.0 / 27 + gl.close * 2 / 27))
  FROM ew AS x JOIN gl ON gl.ticker = x.ticker AND gl.rn = x.rn + 1),
osc AS MATERIALIZED (SELECT ticker, date, rn, CASE WHEN al = 0 AND ag = 0 THEN 50.0 WHEN al = 0 THEN 100.0 ELSE 100 - 100 / (1 + ag / al) END AS rsi, macd, sig AS macd_signal, macd - sig AS macd_hist FROM ew)"""
PIV = """pv AS MATERIALIZED (SELECT b.*, osc.rsi, b.high = max(b.high) OVER a AND count(*) OVER a = 7 AS ph, b.low = min(b.low) OVER a AND count(*) OVER a = 7 AS pl,
  last_value(b.close) OVER (PARTITION BY b.ticker ORDER BY b.date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lc
  FROM b JOIN osc USING (ticker, date) WINDOW a AS (PARTITION BY b.ticker ORDER BY b.date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
pr AS (SELECT *, CASE WHEN ph THEN sum(CAST(ph AS INT)) OVER d END AS hn, CASE WHEN pl THEN sum(CAST(pl AS INT)) OVER d END AS ln FROM pv
  WINDOW d AS (PARTITION BY ticker ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pa AS (SELECT ticker, max(high) FILTER (WHERE hn = 1) AS h1, max(high) FILTER (WHERE hn = 2) AS h2, max(low) FILTER (WHERE ln = 1) AS l1, max(low) FILTER (WHERE ln = 2) AS l2,
  max(rsi) FILTER (WHERE hn = 1) AS hr1, max(rsi) FILTER (WHERE hn = 2) AS hr2, max(rsi) FILTER (WHERE ln = 1) AS lr1, max(rsi) FILTER (WHERE ln = 2) AS lr2,
  coalesce(max(low) FILTER (WHERE pl AND low < lc), min(low)) AS nearest_support, coalesce(min(high) FILTER (WHERE ph AND high > lc), max(high)) AS nearest_resistance,
  max(high) AS sh, min(low) AS sl FROM pr GROUP BY ticker),
ps AS (SELECT ticker, CASE WHEN h1 > h2 AND l1 > l2 THEN 'HH_HL' WHEN h1 < h2 AND l1 < l2 THEN 'LH_LL' ELSE 'range' END AS market_structure,
  CASE WHEN l1 < l2 AND lr1 > lr2 THEN 'bullish' WHEN h1 > h2 AND hr1 < hr2 THEN 'bearish' ELSE 'none' END AS rsi_divergence, nearest_support, nearest_resistance,
  CASE WHEN h1 IS NOT NULL AND l1 IS NOT NULL THEN h1 ELSE sh END AS fh, CASE WHEN h1 IS NOT NULL AND l1 IS NOT NULL THEN l1 ELSE sl END AS fl FROM pa)"""
WEEK = """wk AS (SELECT ticker, date + CAST((7 - isodow(date)) AS INT) AS week, max_by(close, date) AS close FROM bars GROUP BY 1, 2),
ws AS (SELECT ticker, week, CASE WHEN count(*) OVER v >= 30 THEN avg(close) OVER v END AS s FROM wk WINDOW v AS (PARTITION BY ticker ORDER BY week ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
wt AS (SELECT ticker, week, CASE WHEN s > p THEN 'up' WHEN s < p THEN 'down' ELSE 'flat' END AS t FROM (SELECT *, lag(s, 4) OVER (PARTITION BY ticker ORDER BY week) AS p FROM ws) AS q),
wz AS (SELECT ticker, max_by(t, week) AS htf_trend FROM wt GROUP BY ticker)"""
VWAP = """an AS (SELECT ticker, min(date) AS a FROM (SELECT ticker, date, low, min(low) OVER (PARTITION BY ticker) AS m FROM bars) AS q WHERE low = m GROUP BY ticker),
vw AS (SELECT bars.ticker, coalesce(sum((high + low + close) / 3.0 * volume) / nullif(sum(volume), 0), max_by(close, date)) AS anchored_vwap FROM bars JOIN an ON an.ticker = bars.ticker AND date >= a GROUP BY bars.ticker)"""
SLOPE = """mt AS (SELECT close AS bc, row_number() OVER (ORDER BY date DESC) AS p FROM market), tl AS (SELECT ticker, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS p FROM bars),
rl AS (SELECT ticker, max(close / nullif(bc, 0)) FILTER (WHERE p = 1) AS n, max(close / nullif(bc, 0)) FILTER (WHERE p = 21) AS o FROM tl JOIN mt USING (p) GROUP BY ticker),
rz AS (SELECT ticker, CASE WHEN n > o THEN 'rising' WHEN n < o THEN 'falling' ELSE 'flat' END AS rs_line_slope FROM rl)"""


@query("sma", "W1", f"WITH {BASIC} SELECT ticker, date, sma20, sma50, sma200 FROM smas", r="sma20 sma50 sma200", digits=8)
def _(t):
    return I.sma(t.bars, 20, 50, 200).select("ticker", "date", "sma20", "sma50", "sma200")


@query("sma_slope", "W2", f"WITH {BASIC} SELECT ticker, date, coalesce((sma200 - lag(sma200, 20) OVER {W}) / lag(sma200, 20) OVER {W} * 100, 0) AS sma200_slope FROM smas", r="sma200_slope")
def _(t):
    return I.sma_slope(I.sma(t.bars, 200)).select("ticker", "date", "sma200_slope")


@query("bar_returns", "W3", f"SELECT ticker, date, {ret(22)} AS ret_1m, {ret(65)} AS ret_3m, {ret(130)} AS ret_6m FROM bars", r="ret_1m ret_3m ret_6m")
def _(t):
    return I.pct_returns(t.bars, ret_1m=22, ret_3m=65, ret_6m=130).select("ticker", "date", "ret_1m", "ret_3m", "ret_6m")


@query("momentum_12m_1m", "W4 C6", f"""SELECT ticker, date, m AS ret_12m_1m, greatest(-1.0, least(1.0, (a + b + m) / 300)) AS tsmom FROM
(SELECT ticker, date, {ret(22)} AS a, {ret(65)} AS b, coalesce((lag(close, 21) OVER {W} - lag(close, 252) OVER {W}) / lag(close, 252) OVER {W} * 100, 0) AS m FROM bars) AS q""", r="ret_12m_1m tsmom")
def _(t):
    df = I.momentum_12m_1m(I.pct_returns(t.bars, a=22, b=65))
    return df.select("ticker", "date", "ret_12m_1m", S.tsmom_composite(F.col("a"), F.col("b"), F.col("ret_12m_1m")).alias("tsmom"))


@query("rsi", "W5", f"WITH {BASIC}, {EWM} SELECT ticker, date, rsi FROM osc", r="rsi", recursive=True)
def _(t):
    return I.rsi(t.bars).select("ticker", "date", "rsi")


@query("macd", "W6", f"WITH {BASIC}, {EWM} SELECT ticker, date, macd, macd_signal, macd_hist FROM osc", r="macd macd_signal macd_hist", recursive=True)
def _(t):
    return I.macd(t.bars).select("ticker", "date", "macd", "macd_signal", "macd_hist")


STATE = f"concat(CASE WHEN macd_hist > 0 THEN 'bullish' ELSE 'bearish' END, CASE WHEN coalesce(abs(macd_hist) > abs(lag(macd_hist) OVER {W}), false) THEN '_expanding' ELSE '_fading' END)"


@query("macd_state", "W7", f"WITH {BASIC}, {EWM} SELECT ticker, date, {STATE} AS macd_state FROM osc WHERE rn > 1 QUALIFY date = max(date) OVER (PARTITION BY ticker)", recursive=True)
def _(t):
    df = I.macd_state(I.macd(t.bars))
    return df.groupBy("ticker").agg(F.max("date").alias("date"), F.max_by("macd_state", "date").alias("macd_state"))


@query("atr_pct", "W8 W9", f"""WITH {BASIC} SELECT ticker, date, {full('avg', 'tr', 14)} / close * 100 AS atr_pct,
CASE WHEN rn >= 15 AND close > 0 THEN avg(tr) OVER {last(14)} / close * 100 ELSE 10.0 END AS atr_pct_sized FROM smas""", r="atr_pct atr_pct_sized")
def _(t):
    return I.atr_pct(t.bars).select("ticker", "date", "atr_pct", "atr_pct_sized")


BOLL = f"bl AS (SELECT ticker, date, rn, close, {full('avg', 'close', 20)} AS mid, {full('stddev_pop', 'close', 20)} AS sd FROM b)"


@query("bollinger", "W10", f"WITH {BASIC}, {BOLL} SELECT ticker, date, (close - (mid - 2 * sd)) / nullif(4 * sd, 0) AS bb_percent_b, 4 * sd / mid * 100 AS bb_bandwidth FROM bl", r="bb_percent_b bb_bandwidth")
def _(t):
    return I.bollinger(t.bars).select("ticker", "date", "bb_percent_b", "bb_bandwidth")


BWP = """bw AS (SELECT ticker, date, 4 * sd / mid * 100 AS v, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS p FROM bl WHERE sd IS NOT NULL),
bp AS (SELECT ticker, avg(CASE WHEN v <= z THEN 1.0 ELSE 0.0 END) * 100 AS percentile FROM (SELECT *, max(v) FILTER (WHERE p = 1) OVER (PARTITION BY ticker) AS z FROM bw) AS q WHERE p <= 252 GROUP BY ticker)"""


@query("bandwidth_percentile", "W11", f"WITH {BASIC}, {BOLL}, {BWP} SELECT ticker, percentile FROM bp", r="percentile")
def _(t):
    return I.percentile_of_latest(I.bollinger(t.bars), "bb_bandwidth")


OBV = f"ob AS (SELECT *, sum(sign(coalesce(close - pc, 0)) * volume) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS obv FROM b)"
TREND = f"CASE WHEN obv > lag(obv, 20) OVER {W} THEN 'rising' WHEN obv < lag(obv, 20) OVER {W} THEN 'falling' ELSE 'flat' END"


@query("obv", "W12 W13", f"WITH {BASIC}, {OBV} SELECT ticker, date, obv, {TREND} AS obv_trend FROM ob")
def _(t):
    return I.obv_trend(I.obv(t.bars)).select("ticker", "date", "obv", "obv_trend")


PRIOR = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
REL = f"coalesce(volume / nullif(CASE WHEN count(*) OVER {PRIOR} = 20 THEN avg(volume) OVER {PRIOR} END, 0), 1.0)"


@query("rel_volume", "W14 W15", f"WITH {BASIC}, rv AS (SELECT *, {REL} AS rel FROM b) SELECT ticker, date, rel AS rel_volume, coalesce(close <> pc, false) AND rel > 1 AS volume_confirms FROM rv", r="rel_volume")
def _(t):
    return I.volume_confirms(I.rel_volume(t.bars)).select("ticker", "date", "rel_volume", "volume_confirms")


@query("pivots", "W16", """SELECT ticker, date, high = max(high) OVER a AND count(*) OVER a = 7 AS pivot_high, low = min(low) OVER a AND count(*) OVER a = 7 AS pivot_low FROM bars
WINDOW a AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def _(t):
    return I.pivots(t.bars).select("ticker", "date", "pivot_high", "pivot_low")


@query("pivot_readings", "W17 W18 W19 C7", f"WITH {BASIC}, {EWM}, {PIV} SELECT ticker, market_structure, rsi_divergence, nearest_support, nearest_resistance, fh - 0.618 * (fh - fl) AS fib618 FROM ps", r="nearest_support nearest_resistance fib618", recursive=True)
def _(t):
    return I.pivot_summary(t.bars).select("ticker", "market_structure", "rsi_divergence", "nearest_support", "nearest_resistance", F.col("fib_levels")["61.8"].alias("fib618"))


@query("anchored_vwap", "W20", f"WITH {VWAP} SELECT ticker, anchored_vwap FROM vw", r="anchored_vwap")
def _(t):
    return I.anchored_vwap(t.bars)


@query("weekly_trend", "W21", f"WITH {WEEK} SELECT ticker, htf_trend FROM wz")
def _(t):
    return I.weekly_trend(t.bars)


@query("extremes_52w", "W22", f"SELECT ticker, date, {pct(f'close - max(close) OVER {last(252)}', f'max(close) OVER {last(252)}')} AS dist_high_pct, {pct(f'close - min(close) OVER {last(252)}', f'min(close) OVER {last(252)}')} AS dist_low_pct FROM bars", r="dist_high_pct dist_low_pct")
def _(t):
    return I.extremes_52w(t.bars).select("ticker", "date", "dist_high_pct", "dist_low_pct")


RS = f"rs AS (SELECT x.ticker, x.date, x.close, f.vix AS bc FROM bars AS x JOIN fear AS f ON f.date = x.date)"


@query("relative_strength", "W23 J13", f"WITH {RS} SELECT ticker, date, {ret(65)} - {ret(65, 'bc')} AS rs_3m, {ret(130)} - {ret(130, 'bc')} AS rs_6m FROM rs", r="rs_3m rs_6m")
def _(t):
    df = t.bars.join(t.fear.withColumnRenamed("vix", "bench"), "date", "left")
    return I.relative_strength(df, "bench", rs_3m=65, rs_6m=130).where("bench IS NOT NULL").select("ticker", "date", "rs_3m", "rs_6m")


@query("rs_line_slope", "W24", f"WITH {SLOPE} SELECT ticker, rs_line_slope FROM rz")
def _(t):
    return I.rs_line_slope(t.bars, t.market)


@query("ma_conviction_delta", "W26", f"""WITH {BASIC} SELECT ticker, date, CASE WHEN sma200 IS NULL THEN 0 WHEN open <= sma200 THEN -2 WHEN open <= sma50 THEN -1 WHEN sma50 > sma200 THEN 1 ELSE 0 END AS ma_delta FROM smas""")
def _(t):
    return I.ma_conviction_delta(t.bars, "open").select("ticker", "date", "ma_delta")


@query("live_momentum", "W27", """WITH y AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS p, count(*) OVER (PARTITION BY ticker) AS n FROM bars WHERE date BETWEEN DATE '2000-06-30' AND DATE '2001-06-30'),
g AS (SELECT ticker, max(n) AS n, max(close) FILTER (WHERE p = 1) AS c, max(close) FILTER (WHERE p = least(21, n)) AS m1, max(close) FILTER (WHERE p = least(126, n)) AS m6, max(close) FILTER (WHERE p = n) AS f, max(close) AS top FROM y GROUP BY ticker)
SELECT ticker, CASE WHEN n >= 200 THEN (c / m1 - 1) * 100 END AS mom_1m, CASE WHEN n >= 200 THEN (c / f - 1) * 100 END AS mom_12m, CASE WHEN n >= 200 THEN (m1 / m6 - 1) * 100 END AS mom_6m, CASE WHEN n >= 200 THEN c / top END AS high52_ratio FROM g""", r="mom_1m mom_12m mom_6m high52_ratio")
def _(t):
    return I.live_momentum(t.bars.where("date BETWEEN DATE '2000-06-30' AND DATE '2001-06-30'"))


@query("vol_pct_from_close", "W33", f"WITH {BASIC}, v AS (SELECT *, abs(close - pc) / pc AS ar FROM b) SELECT ticker, date, coalesce({full('avg', 'ar', 14)} * 100, 1.0) AS vol_pct FROM v", r="vol_pct")
def _(t):
    return I.vol_pct_from_close(t.bars).select("ticker", "date", "vol_pct")


@query("ma_alignment", "C5", f"""WITH {BASIC} SELECT ticker, date, CASE WHEN sma20 > sma50 AND sma50 > sma200 THEN 'bullish' WHEN sma20 < sma50 AND sma50 < sma200 THEN 'bearish' ELSE 'mixed' END AS alignment, {pct('close - sma20', 'sma20')} AS vs_sma20 FROM smas""", r="vs_sma20")
def _(t):
    df = I.sma(t.bars, 20, 50, 200)
    return df.select("ticker", "date", S.ma_alignment(F.col("sma20"), F.col("sma50"), F.col("sma200")).alias("alignment"), S.pct_distance(F.col("close"), F.col("sma20")).alias("vs_sma20"))


@query("fib_levels", "C7", "SELECT ticker, date, high - (high - low) * 0.382 AS l382, high - (high - low) * 0.5 AS l500, high - (high - low) * 0.618 AS l618 FROM bars", r="l382 l500 l618", digits=12)
def _(t):
    m = t.bars.select("ticker", "date", S.fib_levels(F.col("high"), F.col("low")).alias("m"))
    return m.select("ticker", "date", F.col("m")["38.2"].alias("l382"), F.col("m")["50.0"].alias("l500"), F.col("m")["61.8"].alias("l618"))


@query("week_start", "C19", "SELECT date, CAST(date_trunc('week', date) AS DATE) AS week_start FROM market")
def _(t):
    return t.market.select("date", S.week_start(F.col("date")).alias("week_start"))


@query("sector_fund", "J15", "SELECT ticker, sector, CASE sector WHEN 'Technology' THEN 'XLK' WHEN 'Financial Services' THEN 'XLF' WHEN 'Healthcare' THEN 'XLV' END AS fund FROM sectors")
def _(t):
    return t.sectors.withColumn("fund", F.try_element_at(S.literal_map(cfg.SECTOR_FUND), F.col("sector")))


SECTOR_BARS = "sb AS (SELECT sector, date, round_even(exp(avg(ln(close))), 4) AS sc FROM bars JOIN sectors USING (ticker) WHERE sector <> 'Gardening' GROUP BY sector, date)"
SNAP_R = ("last_close dist_to_52w_high_pct dist_to_52w_low_pct sma200_slope_pct_20d price_vs_sma20_pct price_vs_sma50_pct ret_1m_pct ret_3m_pct ret_6m_pct "
          "ret_12m_1m_pct tsmom_composite rsi14 macd_hist atr_pct atr_pct_percentile_1y bb_percent_b bb_bandwidth_percentile_1y rel_volume_20d rs_vs_spy_3m_pct rs_vs_spy_6m_pct "
          "rs_vs_sector_3m_pct nearest_support nearest_resistance dist_to_support_pct dist_to_resistance_pct fib_382 fib_500 fib_618 anchored_vwap_from_low")
SNAP = f"""WITH {BASIC}, {EWM}, {PIV}, {WEEK}, {VWAP}, {SLOPE}, {BOLL}, {BWP}, {OBV}, {SECTOR_BARS},
a AS (SELECT *, {full('avg', 'tr', 14)} / close * 100 AS ap, CASE WHEN rn >= 15 THEN avg(tr) OVER {last(14)} / close * 100 ELSE 10.0 END AS asz,
  {ret(22)} AS r1, {ret(65)} AS r3, {ret(130)} AS r6, coalesce((lag(close, 21) OVER {W} - lag(close, 252) OVER {W}) / lag(close, 252) OVER {W} * 100, 0) AS r12,
  coalesce((sma200 - lag(sma200, 20) OVER {W}) / lag(sma200, 20) OVER {W} * 100, 0) AS sl, {REL} AS rel, max(close) OVER {last(252)} AS hi, min(close) OVER {last(252)} AS lo,
  row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS p, count(*) OVER (PARTITION BY ticker) AS n FROM smas),
ap AS (SELECT ticker, avg(CASE WHEN ap <= z THEN 1.0 ELSE 0.0 END) * 100 AS app FROM (SELECT ticker, ap, p, max(asz) FILTER (WHERE p = 1) OVER (PARTITION BY ticker) AS z FROM a) AS q WHERE ap IS NOT NULL AND p <= 252 GROUP BY ticker),
mj AS (SELECT bars.ticker, bars.date, bars.close, market.close AS bc FROM bars JOIN market ON market.date = bars.date),
m1 AS (SELECT ticker, date, {ret(65)} - {ret(65, 'bc')} AS x3, {ret(130)} - {ret(130, 'bc')} AS x6 FROM mj),
m2 AS (SELECT ticker, max_by(x3, date) AS x3, max_by(x6, date) AS x6 FROM m1 GROUP BY ticker),
sj AS (SELECT bars.ticker, bars.date, bars.close, sb.sc AS bc FROM bars JOIN sectors ON sectors.ticker = bars.ticker JOIN sb ON sb.sector = sectors.sector AND sb.date = bars.date),
s1 AS (SELECT ticker, date, {ret(65)} - {ret(65, 'bc')} AS x3 FROM sj), s2 AS (SELECT ticker, max_by(x3, date) AS s3 FROM s1 GROUP BY ticker),
os AS (SELECT ticker, date, rsi, macd_hist, {STATE} AS macd_state FROM osc), oz AS (SELECT ticker, date, {TREND} AS obv_trend FROM ob),
e AS (SELECT *, coalesce(sma20, close) AS k20, coalesce(sma50, close) AS k50, coalesce(sma200, close) AS k200 FROM a WHERE p = 1)
SELECT e.ticker, e.date AS as_of, e.close AS last_close, htf_trend, e.close > k200 AS htf_above_200d, (e.close - hi) / hi * 100 AS dist_to_52w_high_pct, (e.close - lo) / lo * 100 AS dist_to_52w_low_pct,
 round_even(k20, 8) + 0.0 AS sma20, round_even(k50, 8) + 0.0 AS sma50, round_even(k200, 8) + 0.0 AS sma200, CASE WHEN k20 > k50 AND k50 > k200 THEN 'bullish' WHEN k20 < k50 AND k50 < k200 THEN 'bearish' ELSE 'mixed' END AS ma_alignment,
 sl AS sma200_slope_pct_20d, (e.close - k20) / k20 * 100 AS price_vs_sma20_pct, (e.close - k50) / k50 * 100 AS price_vs_sma50_pct, market_structure, r1 AS ret_1m_pct, r3 AS ret_3m_pct, r6 AS ret_6m_pct,
 r12 AS ret_12m_1m_pct, greatest(-1.0, least(1.0, (r1 + r3 + r12) / 300)) AS tsmom_composite, os.rsi AS rsi14, CASE WHEN os.rsi >= 70 THEN 'overbought' WHEN os.rsi <= 30 THEN 'oversold' ELSE 'neutral' END AS rsi_regime,
 rsi_divergence, os.macd_hist, os.macd_state, asz AS atr_pct, app AS atr_pct_percentile_1y, coalesce((e.close - (bl.mid - 2 * bl.sd)) / nullif(4 * bl.sd, 0), 0.5) AS bb_percent_b, bp.percentile AS bb_bandwidth_percentile_1y,
 e.rel AS rel_volume_20d, oz.obv_trend, coalesce(e.close <> e.pc, false) AND e.rel > 1 AS volume_confirms_move, m2.x3 AS rs_vs_spy_3m_pct, m2.x6 AS rs_vs_spy_6m_pct, s2.s3 AS rs_vs_sector_3m_pct, rs_line_slope,
 nearest_support, nearest_resistance, (e.close - nearest_support) / nearest_support * 100 AS dist_to_support_pct, (nearest_resistance - e.close) / e.close * 100 AS dist_to_resistance_pct,
 fh - 0.382 * (fh - fl) AS fib_382, fh - 0.5 * (fh - fl) AS fib_500, fh - 0.618 * (fh - fl) AS fib_618, anchored_vwap AS anchored_vwap_from_low, e.n AS bars_available, e.n >= 250 AS data_complete, coalesce(4 * bl.sd / bl.mid * 100 < 1e-9, false) AS bb_bands_flat
FROM e JOIN ps USING (ticker) JOIN wz USING (ticker) JOIN vw USING (ticker) JOIN rz USING (ticker) JOIN bp USING (ticker) JOIN ap USING (ticker) JOIN m2 USING (ticker) LEFT JOIN s2 USING (ticker)
 JOIN os ON os.ticker = e.ticker AND os.date = e.date JOIN oz ON oz.ticker = e.ticker AND oz.date = e.date JOIN bl ON bl.ticker = e.ticker AND bl.date = e.date"""


@query("technical_snapshot", "W36 W11 J15", SNAP, r=SNAP_R, recursive=True)
def _(t):
    sector = t.bars.join(t.sectors, "ticker").where("sector <> 'Gardening'").groupBy("sector", "date").agg(F.bround(F.exp(F.avg(F.log("close"))), 4).alias("close"))
    snap = I.snapshot(t.bars, t.market, t.sectors, sector)
    fib = {f"fib_{n}": F.col("fib_levels")[k] for n, k in (("382", "38.2"), ("500", "50.0"), ("618", "61.8"))}
    # Averages of four-digit prices lie on a grid: eight digits recover it without ties.
    grid = {c: F.bround(c, 8) for c in ("sma20", "sma50", "sma200")}
    return snap.withColumns(fib | grid).drop("fib_levels")
