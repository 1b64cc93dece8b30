"""Factor screen queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions import scalars as S
from barline.functions.series import avg_tie_pct_rank, latest
from barline.operators import factors as X
from barline.operators import indicators as I
from barline.operators import joins
from barline.plans.registry import Tables, query

DATES = [f"{y}-{m:02d}-01" for y in range(1997, 2002) for m in (1, 4, 7, 10)]
DVALUES = "dates AS (SELECT CAST(d AS DATE) AS as_of FROM (VALUES " + ", ".join(f"('{d}')" for d in DATES) + ") AS v(d))"
UNI = "snap AS (SELECT as_of, (SELECT max(c.date) FROM constituents AS c WHERE c.date <= as_of) AS s FROM dates), uni AS (SELECT as_of, ticker FROM snap JOIN constituents AS c ON c.date = s)"
MOM = """wb AS (SELECT as_of, ticker, date, close, row_number() OVER w AS p, count(*) OVER (PARTITION BY as_of, ticker) AS n,
  abs(close - lag(close) OVER (PARTITION BY as_of, ticker ORDER BY date)) / lag(close) OVER (PARTITION BY as_of, ticker ORDER BY date) AS ar FROM bars JOIN dates ON date BETWEEN as_of - 405 AND as_of WINDOW w AS (PARTITION BY as_of, ticker ORDER BY date DESC)),
mg AS (SELECT as_of, ticker, max(n) AS n, max(close) FILTER (WHERE p = 1) AS c, max(close) FILTER (WHERE p = 21) AS p20, max(close) FILTER (WHERE p = 126) AS p125, max(close) FILTER (WHERE p = 252) AS p251, max(close) AS top,
  CASE WHEN count(*) FILTER (WHERE date >= as_of - 40) >= 15 THEN avg(ar) FILTER (WHERE p <= 14) * 100 ELSE 1.0 END AS vol_pct FROM wb GROUP BY as_of, ticker),
mo AS (SELECT as_of, ticker, CASE WHEN n >= 60 THEN (c / p20 - 1) * 100 END AS mom_1m, CASE WHEN n >= 252 THEN (c / p251 - 1) * 100 END AS mom_12m, CASE WHEN n >= 126 THEN (p20 / p125 - 1) * 100 END AS mom_6m, CASE WHEN n >= 60 THEN c / top END AS high52_ratio, vol_pct FROM mg)"""
INFOS = "inf AS (SELECT u.as_of, f.* EXCLUDE (date), s.sector FROM uni AS u ASOF JOIN fundamentals AS f ON f.ticker = u.ticker AND u.as_of >= f.date LEFT JOIN sectors AS s ON s.ticker = u.ticker)"
PROJ = """(SELECT i.as_of, i.ticker, i.sector, CASE WHEN trailingPE > 0 THEN -trailingPE END AS pe_inv, CASE WHEN priceToBook > 0 THEN -priceToBook END AS pb_inv, CASE WHEN freeCashflow <> 0 AND marketCap > 0 THEN freeCashflow / marketCap END AS fcf_yield,
  {ev} AS evebitda_inv, returnOnEquity AS roe, {gm} AS gross_margin, profitMargins AS margin, CASE WHEN debtToEquity >= 0 THEN -debtToEquity END AS de_inv, {cr} AS current_ratio, {eg} AS earnings_growth, mom_12m, mom_6m, high52_ratio FROM inf AS i LEFT JOIN mo ON mo.as_of = i.as_of AND mo.ticker = i.ticker)"""
GATE = "(CAST(pe_inv IS NOT NULL AS INT) + CAST(pb_inv IS NOT NULL AS INT) + CAST(fcf_yield IS NOT NULL AS INT) + CAST(roe IS NOT NULL AS INT) + CAST(margin IS NOT NULL AS INT) + CAST(de_inv IS NOT NULL AS INT)) >= 4"
METRICS = [*X.VALUE, *X.QUALITY, *X.MOMENTUM]


def rank(x: str, part: str) -> str:
    return (f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {part} ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY {part}, {x}) - 1) / 2) / count({x}) OVER (PARTITION BY {part}) END")


def mean(cols) -> str:
    return "(" + " + ".join(f"coalesce({c}, 0.0)" for c in cols) + ") / nullif(" + " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in cols) + ", 0)"


def scored(ev="CAST(NULL AS DOUBLE)", gm="CAST(NULL AS DOUBLE)", cr="CAST(NULL AS DOUBLE)", eg="CAST(NULL AS DOUBLE)", weights=(0.33, 0.33, 0.34)) -> str:
    ranks = ", ".join(f"CASE WHEN sn >= 5 THEN {rank(m, 'as_of, sector')} ELSE {rank(m, 'as_of')} END AS {m}" for m in METRICS)
    wv, wm, wq = weights
    clip = lambda e: f"CAST(trunc(least(33.0, greatest(0.0, coalesce(({e}) * 33, 0.0)))) AS INT)"
    mom = "(coalesce(mom_12m, 0.5) + coalesce(mom_6m, 0.5) + coalesce(high52_ratio, 0.5)) / 3"
    return f"""pj AS (SELECT *, count(*) OVER (PARTITION BY as_of, sector) AS sn FROM {PROJ.format(ev=ev, gm=gm, cr=cr, eg=eg)} AS z WHERE {GATE}),
rk AS (SELECT as_of, ticker, sector, {ranks} FROM pj),
sc AS (SELECT as_of, ticker, sector, {clip(mean(X.VALUE))} AS value_score, {clip(mom)} AS momentum_score, {clip(mean(X.QUALITY))} AS quality_score FROM rk),
cs AS (SELECT *, CAST(least(99.0, greatest(0.0, round_even(value_score * 3 * CAST({wv} AS DOUBLE) + momentum_score * 3 * CAST({wm} AS DOUBLE) + quality_score * 3 * CAST({wq} AS DOUBLE), 0))) AS INT) AS composite_score FROM sc),
tp AS (SELECT *, CAST(row_number() OVER (PARTITION BY as_of ORDER BY composite_score DESC, ticker) AS INT) AS place FROM cs)"""


def dates(t: Tables):
    return X.date_table(t.spark, DATES)


def infos(t: Tables):
    uni = joins.snapshot_asof(dates(t), t.constituents, "as_of", "date")
    fields = [c for c in t.fundamentals.columns if c not in ("ticker", "date")]
    got = joins.asof_lookup(uni, t.fundamentals, ["ticker"], "as_of", "date", fields).drop("_found")
    return got.join(t.sectors, "ticker", "left")


@query("constituents_asof", "J7", f"WITH {DVALUES}, {UNI} SELECT as_of, ticker FROM uni")
def _(t):
    return joins.snapshot_asof(dates(t), t.constituents, "as_of", "date").select("as_of", "ticker")


@query("fundamentals_asof", "J6 X2", f"WITH {DVALUES}, {UNI} SELECT u.as_of, u.ticker, f.date AS published, f.trailingPE, f.marketCap FROM uni AS u ASOF JOIN fundamentals AS f ON f.ticker = u.ticker AND u.as_of >= f.date")
def _(t):
    uni = joins.snapshot_asof(dates(t), t.constituents, "as_of", "date")
    return joins.asof_join(uni, t.fundamentals, ["ticker"], "as_of", "date", ["trailingPE", "marketCap"], found="published").select("as_of", "ticker", "published", "trailingPE", "marketCap")


@query("price_windows", "J8", f"WITH {DVALUES}, {UNI} SELECT u.as_of, u.ticker, b.date, b.close FROM uni AS u JOIN bars AS b ON b.ticker = u.ticker AND b.date BETWEEN u.as_of - 40 AND u.as_of")
def _(t):
    spans = joins.snapshot_asof(dates(t), t.constituents, "as_of", "date").withColumn("start", F.date_sub("as_of", 40))
    return joins.range_join(spans, t.bars.select("ticker", "date", "close"), ["ticker"], "start", "as_of", "date").select("as_of", "ticker", "date", "close")


@query("pit_momentum", "W28", f"WITH {DVALUES}, {MOM} SELECT as_of, ticker, mom_1m, mom_12m, mom_6m, high52_ratio, vol_pct FROM mo", r="mom_1m mom_12m mom_6m high52_ratio vol_pct", digits=6)
def _(t):
    return X.pit_momentum(t.bars, DATES)


@query("factor_projection", "F13 F14 F15", f"WITH {DVALUES}, {UNI}, {INFOS}, {MOM} SELECT as_of, ticker, sector, pe_inv, pb_inv, fcf_yield, roe, margin + 0.0 AS margin, de_inv FROM {PROJ.format(ev='NULL', gm='NULL', cr='NULL', eg='NULL')} AS z WHERE {GATE}", r="fcf_yield", digits=8)
def _(t):
    raw = infos(t).withColumn("trailingPE", F.col("trailingPE").cast("string"))
    return X.complete_enough(X.project(raw)).select("as_of", "ticker", "sector", *X.PRIMARY).withColumn("margin", F.col("margin") + 0.0)


@query("percentile_rank", "W29", f"SELECT date, ticker, {rank('trailingPE', 'date')} AS pe_rank FROM fundamentals", r="pe_rank", digits=8)
def _(t):
    return t.fundamentals.select("date", "ticker", avg_tie_pct_rank("trailingPE", ["date"]).alias("pe_rank"))


@query("sector_rank", "W30", f"""WITH j AS (SELECT f.date AS as_of, f.ticker, s.sector, round_even(f.trailingPE, 0) AS pe, CASE WHEN f.profitMargins > 0.06 THEN f.profitMargins END AS pm FROM fundamentals AS f JOIN sectors AS s ON s.ticker = f.ticker),
k AS (SELECT *, count(*) OVER (PARTITION BY as_of, sector) AS sn FROM j)
SELECT as_of, ticker, 'pe' AS metric, CASE WHEN sn >= 5 THEN {rank('pe', 'as_of, sector')} ELSE {rank('pe', 'as_of')} END AS rank FROM k UNION ALL SELECT as_of, ticker, 'pm', CASE WHEN sn >= 5 THEN {rank('pm', 'as_of, sector')} ELSE {rank('pm', 'as_of')} END FROM k""", r="rank", digits=8)
def _(t):
    df = t.fundamentals.join(t.sectors, "ticker").select(F.col("date").alias("as_of"), "ticker", "sector", F.bround("trailingPE", 0).alias("pe"), F.when(F.col("profitMargins") > 0.06, F.col("profitMargins")).alias("pm"))
    return X.sector_or_universe_rank(df, ["as_of"], ["pe", "pm"]).select("as_of", "ticker", "metric", "rank")


@query("composite_score", "R1 C16", f"WITH {DVALUES}, {UNI}, {INFOS}, {MOM}, {scored(weights=(0.20, 0.50, 0.30))} SELECT as_of, ticker, value_score, momentum_score, quality_score, composite_score FROM cs")
def _(t):
    df = X.project(infos(t)).join(X.pit_momentum(t.bars, DATES), ["as_of", "ticker"], "left")
    return X.composite(df, ["as_of"], "bull").drop("sector")


@query("factor_screen", "R2 T2", f"""WITH dates AS (SELECT DATE '2001-07-01' AS as_of), {INFOS.replace('uni AS u', '(SELECT as_of, ticker FROM dates, sectors) AS u')}, {MOM},
{scored(ev='CASE WHEN priceToBook * 20 - 50 > 0 THEN -(priceToBook * 20 - 50) END', gm='profitMargins + 0.2', cr='debtToEquity', eg='CASE WHEN returnOnEquity > 0.2 THEN returnOnEquity END', weights=(0.40, 0.15, 0.45))}
SELECT ticker, place, composite_score, value_score, momentum_score, quality_score FROM tp WHERE place <= 12""")
def _(t):
    info = latest(t.fundamentals.where("date <= DATE '2001-07-01'"), "ticker").drop("date").join(t.sectors, "ticker").withColumns({
        "as_of": F.lit("2001-07-01").cast("date"), "enterpriseToEbitda": F.col("priceToBook") * 20 - 50, "grossMargins": F.col("profitMargins") + 0.2,
        "currentRatio": F.col("debtToEquity"), "earningsGrowth": F.when(F.col("returnOnEquity") > 0.2, F.col("returnOnEquity"))})
    return X.screen(info, X.pit_momentum(t.bars, ["2001-07-01"]), ["as_of"], 12, "bear").select("ticker", "place", "composite_score", "value_score", "momentum_score", "quality_score")


@query("pit_screen", "R3 T2 J6 J7 W28 W30 R1", f"""WITH {DVALUES}, {UNI}, {INFOS}, {MOM}, {scored()}
SELECT tp.as_of, tp.ticker, sector, value_score, momentum_score, quality_score, composite_score, place, least(8.0, greatest(0.0, 0.15 / CASE WHEN vol_pct <= 0 THEN 1.0 ELSE coalesce(vol_pct, 1.0) END * 100)) AS position_pct
FROM tp LEFT JOIN mo ON mo.as_of = tp.as_of AND mo.ticker = tp.ticker WHERE place <= 20""", r="position_pct")
def _(t):
    return X.pit_screen(t.bars, t.fundamentals, t.constituents, t.sectors, DATES)
