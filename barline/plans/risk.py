"""Book, sizing, allocation, hedge and risk-rule queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from barline import config as cfg
from barline.functions import scalars as S
from barline.operators import indicators as I
from barline.operators import joins
from barline.operators import metrics as M
from barline.operators import risk as R
from barline.plans.registry import Tables, query
from barline.sources import files

RSQL = "CASE {c} WHEN 'crash' THEN 0.3 WHEN 'deep-bear' THEN 0.3 WHEN 'bear' THEN 0.5 WHEN 'neutral' THEN 0.7 WHEN 'bull' THEN 1.0 WHEN 'euphoria' THEN 0.75 WHEN 'melt-up' THEN 0.5 ELSE 1.0 END"
POS = "po AS (SELECT o.ticker, o.shares AS qty, p.price, o.shares * p.price AS value, o.signal_source, o.entry_price, o.entry_date, s.sector FROM open_positions AS o JOIN last_price AS p ON p.ticker = o.ticker LEFT JOIN sectors AS s ON s.ticker = o.ticker)"
ALLOC = "al AS (SELECT sector, sum(value) / (100000 + (SELECT sum(value) FROM po)) * 100 AS pct FROM po GROUP BY sector)"


def positions(t: Tables):
    return t.open_positions.withColumnRenamed("shares", "qty").join(t.last_price.select("ticker", "price"), "ticker")


@query("sector_allocation", "A10", f"WITH {POS}, {ALLOC} SELECT sector, pct FROM al", r="pct")
def _(t):
    return R.sector_allocation(positions(t), t.sectors, 100_000)


@query("sector_allocation_long", "A10", f"WITH {POS} SELECT sector, sum(value) / (100000 + (SELECT sum(value) FROM po)) * 100 AS pct FROM po WHERE signal_source IS DISTINCT FROM 'hedge' GROUP BY sector", r="pct")
def _(t):
    return R.sector_allocation(positions(t), t.sectors, 100_000, exclude="hedge")


@query("nav_snapshot", "A11 A33 J24", f"WITH {POS} SELECT CAST(100000.0 AS DOUBLE) AS cash, sum(value) AS positions_value, 100000 + sum(value) AS total_nav, sum(value) / (100000 + sum(value)) * 100 AS invested_pct FROM po", r="positions_value total_nav invested_pct", digits=3)
def _(t):
    return R.nav_snapshot(positions(t), 100_000)


@query("reconcile", "J19 U3", "SELECT coalesce(a.ticker, b.ticker) AS ticker, a.qty AS book_qty, b.qty AS broker_qty, CASE WHEN b.ticker IS NULL THEN 'ghost' WHEN a.ticker IS NULL THEN 'untracked' ELSE 'matched' END AS status FROM book AS a FULL OUTER JOIN broker AS b ON a.ticker = b.ticker")
def _(t):
    return joins.reconcile(t.book, t.broker)


@query("book_difference", "U3", "(SELECT ticker, 'book' AS side FROM book EXCEPT SELECT ticker, 'book' FROM broker) UNION ALL (SELECT ticker, 'broker' FROM broker EXCEPT SELECT ticker, 'broker' FROM book)")
def _(t):
    a, b = t.book.select("ticker"), t.broker.select("ticker")
    return a.subtract(b).withColumn("side", F.lit("book")).unionByName(b.subtract(a).withColumn("side", F.lit("broker")))


@query("ghost_fills", "J20", """WITH od AS (SELECT concat('Brand#', CAST(1 + o_custkey % 25 AS VARCHAR)) AS ticker, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'),
f AS (SELECT ticker, min(o_orderkey) AS order_id, min_by(o_totalprice, o_orderkey) AS exit_price FROM od GROUP BY ticker), g AS (SELECT * FROM book)
SELECT g.ticker, g.qty, f.order_id, f.exit_price, CASE WHEN order_id IS NULL THEN 'unknown' ELSE 'reconcile_fill' END AS outcome FROM g LEFT JOIN f ON f.ticker = g.ticker""")
def _(t):
    o = t.orders.select(
        F.concat(F.lit("Brand#"), (1 + F.col("o_custkey") % 25).cast("string")).alias("ticker"), F.col("o_orderkey").alias("order_id"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"),
        F.lit(1.0).alias("filled_qty"), F.when(F.col("o_orderpriority") == "1-URGENT", "sell").otherwise("buy").alias("side"), F.when(F.col("o_orderstatus") == "F", "filled").otherwise("open").alias("status"))
    return R.ghost_fills(t.book, o).select("ticker", "qty", "order_id", "exit_price", "outcome")


@query("position_fold", "S19", """WITH z AS (SELECT user_id, max(event_id) AS e FROM events WHERE event_type = 'error' AND value > 120 GROUP BY user_id)
SELECT v.user_id AS ticker, max(value) AS peak_price, max(event_id) FILTER (WHERE event_type = 'click') AS shares, bool_or(event_type = 'purchase') AS take_profit_taken FROM events AS v LEFT JOIN z ON z.user_id = v.user_id
WHERE NOT (event_type = 'error' AND value > 120) AND event_id > coalesce(e, -1) GROUP BY v.user_id""")
def _(t):
    e = t.events.select(F.col("user_id").alias("ticker"), F.col("value").alias("price"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", F.col("event_id")).alias("shares"),
                        (F.col("event_type") == "purchase").alias("take_profit"), ((F.col("event_type") == "error") & (F.col("value") > 120)).alias("deleted"))
    return R.fold_positions(e)


@query("position_guard", "S20", "SELECT b.ticker, b.qty, b.ticker NOT IN (SELECT ticker FROM book) AS accepted FROM broker AS b")
def _(t):
    return R.insert_positions(t.broker, t.book)


@query("event_log_json", "S18", """SELECT o_orderkey AS id, 'order' AS event_type, concat('{"customer":', o_custkey, ',"status":"', o_orderstatus, '","priority":"', o_orderpriority, '"}') AS data FROM orders""")
def _(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("order").alias("event_type"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return files.with_json(rows, ["customer", "status", "priority"])


@query("partial_close", "C18", f"""WITH {POS}, p2 AS (SELECT *, qty * 0.01 AS ec FROM po)
SELECT ticker, 'closed' AS leg, qty / 2 AS leg_shares, price * qty / 2 - qty / 2 * 0.02 - (entry_price * qty / 2 + ec / 2) AS realized_pnl FROM p2 UNION ALL SELECT ticker, 'open', qty / 2, NULL FROM p2""", r="leg_shares realized_pnl", digits=7)
def _(t):
    p = positions(t).withColumnRenamed("qty", "shares").withColumn("entry_commission", F.col("shares") * 0.01)
    return R.partial_close(p, 0.5, 0.02).select("ticker", "leg", "leg_shares", "realized_pnl")


@query("forced_close", "F28", "SELECT ticker, shares FROM open_positions WHERE signal_source IS DISTINCT FROM 'hedge'")
def _(t):
    return R.forced_close(t.open_positions).select("ticker", "shares")


@query("hedge_exits", "R17", "SELECT ticker FROM open_positions WHERE signal_source = 'hedge'")
def _(t):
    return R.hedge_exits(t.open_positions).select("ticker")


@query("exit_rules", "F27", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN p < -12 THEN 'exit' WHEN p > 40 THEN 'exit' WHEN p >= 25 THEN 'reduce' WHEN d > 60 AND p < 5 THEN 'exit' WHEN d > 90 THEN 'exit' ELSE 'hold' END AS action
FROM (SELECT *, (exit_price - entry_price) / entry_price * 100 AS p, exit_date - entry_date AS d FROM closed_positions) AS q""")
def _(t):
    pnl = (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price") * 100
    return t.closed_positions.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.exit_rule(pnl, F.datediff("exit_date", "entry_date")).alias("action"))


@query("stale_data", "F22", "SELECT max(date) AS latest, CAST(DATE '2001-11-09' - max(date) AS INT) AS staleness_days, DATE '2001-11-09' - max(date) > 3 AS stale FROM bars")
def _(t):
    return R.stale_data(t.bars, "2001-11-09")


STATES = "CASE event_type WHEN 'error' THEN 'deleverage' WHEN 'view' THEN 'sizes_reduced' WHEN 'click' THEN 'weekly_halt' ELSE 'normal' END"


@query("entry_veto", "F21", f"SELECT event_id, {STATES} AS state, {STATES} NOT IN ('deleverage', 'weekly_halt') AS allowed, CASE {STATES} WHEN 'normal' THEN 1.0 WHEN 'sizes_reduced' THEN 0.5 ELSE 0.0 END AS size_multiplier FROM events", r="size_multiplier")
def _(t):
    state = F.expr(STATES)
    return t.events.select("event_id", state.alias("state"), R.entry_veto(state).alias("v")).select("event_id", "state", "v.*")


ORD = """od AS (SELECT o_orderkey AS id, o_orderpriority = '5-LOW' AND o_orderstatus = 'P' AS stale, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 'deleverage' WHEN o_orderpriority = '2-HIGH' THEN 'sizes_reduced' ELSE 'normal' END AS state,
  o_totalprice / 50000 AS pct, CASE c_mktsegment WHEN 'BUILDING' THEN 'Hedge' ELSE c_mktsegment END AS sector, CASE WHEN c_mktsegment <> 'MACHINERY' THEN abs(c_acctbal) / 400 END AS sector_pct, c_nationkey * 3.2 AS invested_pct,
  o_totalprice AS order_usd, CASE WHEN c_acctbal > 1000 THEN c_acctbal * 1500 END AS adv_usd FROM orders JOIN customer ON o_custkey = c_custkey)"""
REASON = """CASE WHEN stale THEN 'stale_data' WHEN state IN ('entries_halted', 'weekly_halt', 'locked_out', 'deleverage') THEN concat('state:', state) WHEN pct > 8 THEN 'size_cap' WHEN coalesce(sector_pct, 0) + pct > 30 THEN 'sector_cap'
WHEN invested_pct + pct > 80 THEN 'invested_cap' WHEN coalesce(adv_usd, 0) > 0 AND order_usd / adv_usd * 100 > 5 THEN 'adv_cap' WHEN coalesce(adv_usd, 0) <= 0 AND sector <> 'Hedge' THEN 'no_adv' END"""


def orders(t: Tables):
    c = F.col
    return t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).select(
        c("o_orderkey").alias("id"), ((c("o_orderpriority") == "5-LOW") & (c("o_orderstatus") == "P")).alias("stale"),
        F.when((c("o_orderpriority") == "1-URGENT") & (c("o_orderstatus") == "F"), "deleverage").when(c("o_orderpriority") == "2-HIGH", "sizes_reduced").otherwise("normal").alias("state"),
        (c("o_totalprice") / 50000).alias("pct"), F.when(c("c_mktsegment") == "BUILDING", "Hedge").otherwise(c("c_mktsegment")).alias("sector"), F.when(c("c_mktsegment") != "MACHINERY", F.abs("c_acctbal") / 400).alias("sector_pct"),
        (c("c_nationkey") * 3.2).alias("invested_pct"), c("o_totalprice").alias("order_usd"), F.when(c("c_acctbal") > 1000, c("c_acctbal") * 1500).alias("adv_usd"))


@query("order_rules", "F20", f"WITH {ORD} SELECT id, {REASON} AS reason, {REASON} IS NULL AS allowed FROM od")
def _(t):
    return orders(t).withColumn("reason", R.order_reason()).select("id", "reason", F.col("reason").isNull().alias("allowed"))


@query("risk_predicates", "F23", f"WITH {ORD} SELECT id, coalesce(sector_pct, 0) >= 20 AS capped, coalesce(adv_usd > 0 AND order_usd / nullif(adv_usd, 0) * 100 <= 10, false) AS liquid, (500000 - order_usd) / 500000 * 100 >= 10 AS in_drawdown FROM od")
def _(t):
    return orders(t).select("id", R.is_sector_capped(F.col("sector_pct"), 20).alias("capped"), R.is_liquid(F.col("order_usd"), F.col("adv_usd")).alias("liquid"), R.in_drawdown(F.lit(500000.0), F.col("order_usd")).alias("in_drawdown"))


ALSRC = """ax AS (SELECT c.l_orderkey, c.l_linenumber, c.l_partkey, c.l_suppkey, c.entry_date AS date, conviction * 1.0 AS base_pct, coalesce(r.regime_label, 'unknown') AS regime_label, coalesce(r.confidence, 0.35) AS confidence, conviction % 2 = 0 AS is_stable FROM closed_positions AS c LEFT JOIN regime_daily AS r ON r.date = c.entry_date),
ay AS (SELECT *, RM AS rm, least(1.0, 0.5 + 0.5 * (confidence - 0.4) / 0.6) AS cm, CASE WHEN is_stable THEN 1.0 ELSE 0.5 END AS sm, CASE WHEN month(date) IN (11, 12, 1, 2, 3, 4) THEN 1.10 ELSE 0.90 END AS sea FROM ax),
az AS (SELECT *, greatest(0.0, least(8.0, base_pct * rm * cm * sm * sea)) AS f FROM ay)""".replace("RM", RSQL.format(c="regime_label"))


@query("regime_allocation", "R15 C13", f"WITH {ALSRC} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN confidence >= 0.4 AND f >= 0.1 THEN rm ELSE 0 END AS regime_multiplier, CASE WHEN confidence >= 0.4 AND f >= 0.1 THEN cm ELSE 0 END AS confidence_multiplier, CASE WHEN confidence >= 0.4 AND f >= 0.1 THEN sea ELSE 1.0 END AS seasonal_multiplier, CASE WHEN confidence >= 0.4 AND f >= 0.1 THEN f ELSE 0 END AS final_pct FROM az",
       r="regime_multiplier confidence_multiplier seasonal_multiplier final_pct", digits=12)
def _(t):
    df = t.closed_positions.join(t.regime_daily.withColumnRenamed("date", "entry_date"), "entry_date", "left").withColumns({
        "date": F.col("entry_date"), "base_pct": F.col("conviction") * 1.0, "regime_label": F.coalesce("regime_label", F.lit("unknown")), "confidence": F.coalesce("confidence", F.lit(0.35)), "is_stable": F.col("conviction") % 2 == 0})
    return R.allocate(df).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "regime_multiplier", "confidence_multiplier", "seasonal_multiplier", "final_pct")


@query("size_rules", "Z1 Z2 Z3 Z4", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(8.0, greatest(0.0, 0.15 / CASE WHEN shares / 10 - 0.3 <= 0 THEN 1.0 ELSE shares / 10 - 0.3 END * 100)) AS vol_size,
least(8.0, greatest(0.0, 4.0 + 4.0 * 0.2 * ((least(10, greatest(5, conviction)) - 7.5) / 2.5))) AS tilted, least(8.0, greatest(0.0, 0.15 / CASE WHEN (entry_price - exit_price) / entry_price * 100 <= 0 THEN 1.0 ELSE (entry_price - exit_price) / entry_price * 100 END * 100)) AS stop_size,
CASE WHEN shares / 50 <= 0.7 THEN 1.0 ELSE greatest(0.0, 1 - (shares / 50 - 0.7) / 0.3) END AS corr FROM closed_positions""", r="vol_size tilted stop_size corr", digits=6)
def _(t):
    return t.closed_positions.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.vol_target_pct(F.col("shares") / 10 - 0.3).alias("vol_size"), S.conviction_tilt(F.lit(4.0), F.col("conviction")).alias("tilted"),
                                     S.structure_stop_pct(F.col("entry_price"), F.col("exit_price")).alias("stop_size"), S.correlation_multiplier(F.col("shares") / 50).alias("corr"))


@query("conviction_rules", "C17", """SELECT d.id, CAST(least(10, greatest(1, 6 + CASE WHEN lag BETWEEN 15 AND 30 THEN -2 WHEN lag BETWEEN 31 AND 45 THEN -3 ELSE 0 END + CASE WHEN n >= 4 THEN 2 WHEN n >= 2 THEN 1 ELSE 0 END + CASE WHEN amount_range LIKE '$100,001%' THEN 1 ELSE 0 END
+ CASE WHEN sc >= 80 THEN 2 WHEN sc >= 60 THEN 1 WHEN sc < 40 THEN -1 ELSE 0 END + CASE WHEN d.ticker IN (SELECT ticker FROM book) THEN 1 ELSE 0 END)) AS INT) AS conviction FROM
(SELECT *, disclosure_date - transaction_date AS lag, day(disclosure_date) % 6 AS n, month(disclosure_date) * 9 AS sc FROM disclosures) AS d""")
def _(t):
    both = F.col("_b").isNotNull()
    df = t.disclosures.join(t.book.select("ticker", F.lit(1).alias("_b")), "ticker", "left")
    lag = S.lag_days(F.col("transaction_date"), F.col("disclosure_date"))
    d = F.col("disclosure_date")
    return df.select("id", S.conviction_rules(F.lit(6), lag, F.day(d) % 6, S.amount_floor(F.col("amount_range")), F.month(d) * 9, both).alias("conviction"))


@query("size_band", "C17", "SELECT id, CASE WHEN disclosure_date - transaction_date BETWEEN 31 AND 45 THEN least(2.0, b) ELSE b END AS top_pct FROM (SELECT *, CASE WHEN day(disclosure_date) % 11 <= 4 THEN 0.0 WHEN day(disclosure_date) % 11 <= 6 THEN 2.0 WHEN day(disclosure_date) % 11 <= 8 THEN 5.0 ELSE 8.0 END AS b FROM disclosures) AS q", r="top_pct")
def _(t):
    return t.disclosures.select("id", S.conviction_band(F.day("disclosure_date") % 11, S.lag_days(F.col("transaction_date"), F.col("disclosure_date"))).alias("top_pct"))


CORR = """rt AS (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM bars WHERE date BETWEEN DATE '2001-10-01' - 60 AND DATE '2001-10-01'),
pr AS (SELECT a.ticker, b.ticker AS holding, count(*) AS n, corr(a.ret, b.ret) AS rho FROM rt AS a JOIN rt AS b ON a.date = b.date WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL AND b.ticker IN (SELECT ticker FROM book) AND a.ticker NOT IN (SELECT ticker FROM book) GROUP BY 1, 2 HAVING count(*) >= 20),
mx AS (SELECT ticker, greatest(0.0, max(rho)) AS max_rho, count(*) AS n_pairs FROM pr GROUP BY ticker)"""


def correlation(t: Tables):
    """The panel is cut to the days asked for before returns are taken: the first of them has none."""
    rets = M.daily_returns(t.bars.where("date BETWEEN DATE '2001-10-01' - 60 AND DATE '2001-10-01'").select("ticker", "date", F.col("close").alias("nav")), "ticker")
    return R.max_correlation(rets.join(t.book, "ticker", "left_anti"), rets.join(t.book, "ticker", "left_semi"), replace(cfg.CORRELATION, threshold=0.2), "2001-10-01", 60)


@query("correlation_filter", "J17 A28 Z4", f"WITH {CORR} SELECT c.ticker, max_rho, n_pairs, CASE WHEN max_rho > 0.2 THEN greatest(0.0, 1 - (max_rho - 0.2) / 0.8) ELSE 1.0 END AS corr_mult FROM (SELECT DISTINCT ticker FROM rt WHERE ticker NOT IN (SELECT ticker FROM book)) AS c LEFT JOIN mx ON mx.ticker = c.ticker", r="max_rho corr_mult", digits=6)
def _(t):
    return correlation(t)


@query("hedge_plan", "R16 J18", f"""WITH {POS}, {ALLOC}, st AS (SELECT date, regime_label, CASE regime_label WHEN 'bear' THEN 30.0 WHEN 'crash' THEN 50.0 END AS m FROM regime_daily WHERE regime_label IN ('bear', 'crash')),
fu AS (SELECT * FROM (VALUES ('SH', NULL), ('PSQ', 'Technology'), ('PSQ', 'Communication Services'), ('RWM', NULL), ('SBB', NULL), ('EFZ', NULL)) AS f(ticker, conflict)),
ok AS (SELECT DISTINCT ticker FROM fu WHERE ticker NOT IN (SELECT f.ticker FROM fu AS f JOIN al ON al.sector = f.conflict AND al.pct > 10))
SELECT date, regime_label, ok.ticker, least(15.0, m / (SELECT count(*) FROM ok)) AS position_pct FROM st, ok""", r="position_pct")
def _(t):
    alloc = R.sector_allocation(positions(t), t.sectors, 100_000)
    return R.hedge_plan(t.regime_daily.select("date", "regime_label"), t.open_positions, alloc)


CAND = """cd AS (SELECT d.id, d.ticker, d.disclosure_date AS date, b.close AS entry_price, CASE WHEN day(d.disclosure_date) % 3 = 0 THEN b.close * (1 - (day(d.disclosure_date) - 9) / 100.0) END AS invalidation_price, CASE WHEN month(d.disclosure_date) = 5 THEN 'skip' ELSE 'buy' END AS entry,
  1.0 + day(d.disclosure_date) / 7.0 AS reward_risk, abs(b.high - b.low) / b.close * 100 AS atr_pct, CAST(day(d.disclosure_date) % 4 AS INT) - 2 AS ma_delta, CAST(5 + month(d.disclosure_date) % 6 AS INT) AS score_conviction,
  CASE WHEN d.amount_range LIKE '$100%' THEN 'both' WHEN d.amount_range LIKE '$15%' THEN 'congressional' ELSE 'fundamental' END AS signal_type, s.sector, r.regime_label, r.confidence, month(d.disclosure_date) % 2 = 0 AS is_stable,
  CASE WHEN day(d.disclosure_date) > 20 THEN day(d.disclosure_date) / 31.0 END AS max_rho, CASE WHEN month(d.disclosure_date) = 7 THEN 0.02 ELSE 0.9 END AS port_vol_mult, month(d.disclosure_date) = 9 AND day(d.disclosure_date) > 25 AS stale,
  CASE WHEN month(d.disclosure_date) = 3 THEN 'sizes_reduced' WHEN month(d.disclosure_date) = 4 AND day(d.disclosure_date) < 8 THEN 'entries_halted' ELSE 'normal' END AS state, CASE s.sector WHEN 'Technology' THEN 27.5 ELSE 10.0 END AS sector_pct,
  CASE WHEN month(d.disclosure_date) = 10 THEN 78.0 ELSE 40.0 END AS invested_pct, 100000.0 AS nav, CASE WHEN s.sector <> 'Gardening' THEN b.volume * b.close * 20 END AS adv_usd
  FROM disclosures AS d JOIN bars AS b ON b.ticker = d.ticker AND b.date = d.disclosure_date JOIN sectors AS s ON s.ticker = d.ticker JOIN regime_daily AS r ON r.date = d.disclosure_date WHERE d.transaction_type = 'buy')"""
CHAIN = f"""c1 AS (SELECT *, CAST(least(10, greatest(1, score_conviction + ma_delta)) AS INT) AS conviction, (entry_price - invalidation_price) / entry_price * 100 AS sd FROM cd),
c2 AS (SELECT *, CASE WHEN invalidation_price IS NOT NULL THEN least(8.0, greatest(0.0, 0.15 / CASE WHEN sd <= 0 THEN 1.0 ELSE sd END * 100)) ELSE least(8.0, greatest(0.0, 0.15 / CASE WHEN atr_pct <= 0 THEN 1.0 ELSE atr_pct END * 100)) END AS b0 FROM c1),
c3 AS (SELECT *, least(8.0, greatest(0.0, b0 + b0 * 0.2 * ((least(10, greatest(5, conviction)) - 7.5) / 2.5))) AS base_pct FROM c2),
c4 AS (SELECT *, greatest(0.0, least(8.0, base_pct * {RSQL.format(c='regime_label')} * least(1.0, 0.5 + 0.5 * (confidence - 0.4) / 0.6) * CASE WHEN is_stable THEN 1.0 ELSE 0.5 END * CASE WHEN month(date) IN (11, 12, 1, 2, 3, 4) THEN 1.10 ELSE 0.90 END)) AS f0 FROM c3),
c5 AS (SELECT *, CASE WHEN confidence >= 0.4 AND f0 >= 0.1 THEN f0 ELSE 0.0 END AS f1 FROM c4),
c6 AS (SELECT *, CASE WHEN signal_type = 'congressional' THEN least(3.0, f1) ELSE f1 END * CASE WHEN coalesce(max_rho, 0) <= 0.7 THEN 1.0 ELSE greatest(0.0, 1 - (max_rho - 0.7) / 0.3) END AS f2 FROM c5),
c7 AS (SELECT *, f2 * port_vol_mult AS pct, nav * (f2 * port_vol_mult) / 100 AS order_usd FROM c6),
c8 AS (SELECT *, {REASON} AS veto, pct * CASE state WHEN 'normal' THEN 1.0 WHEN 'sizes_reduced' THEN 0.5 ELSE 0.0 END AS f3 FROM c7),
c9 AS (SELECT *, CASE WHEN invalidation_price IS NOT NULL AND (entry <> 'buy' OR reward_risk < 2 OR invalidation_price >= entry_price) THEN 'technical' WHEN f1 < 0.1 THEN 'regime' WHEN f2 < 0.1 THEN 'correlation' WHEN pct < 0.1 THEN 'portfolio_vol'
  WHEN veto IS NOT NULL THEN concat('risk:', veto) WHEN f3 < 0.1 THEN 'risk_state' END AS rejected_by FROM c8)"""


def candidates(t: Tables):
    c = F.col
    day, month = F.day("date"), F.month("date")
    df = t.disclosures.where("transaction_type = 'buy'").withColumn("date", c("disclosure_date")).join(t.bars, ["ticker", "date"]).join(t.sectors, "ticker").join(t.regime_daily, "date")
    return df.select(
        "id", "ticker", "date", c("close").alias("entry_price"), F.when(day % 3 == 0, c("close") * (1 - (day - 9) / 100.0)).alias("invalidation_price"), F.when(month == 5, "skip").otherwise("buy").alias("entry"),
        (1.0 + day / 7.0).alias("reward_risk"), (F.abs(c("high") - c("low")) / c("close") * 100).alias("atr_pct"), (day % 4 - 2).alias("ma_delta"), (5 + month % 6).alias("score_conviction"),
        F.when(c("amount_range").startswith("$100"), "both").when(c("amount_range").startswith("$15"), "congressional").otherwise("fundamental").alias("signal_type"), "sector", "regime_label", "confidence", (month % 2 == 0).alias("is_stable"),
        F.when(day > 20, day / 31.0).alias("max_rho"), F.when(month == 7, 0.02).otherwise(0.9).alias("port_vol_mult"), ((month == 9) & (day > 25)).alias("stale"),
        F.when(month == 3, "sizes_reduced").when((month == 4) & (day < 8), "entries_halted").otherwise("normal").alias("state"), F.when(c("sector") == "Technology", 27.5).otherwise(10.0).alias("sector_pct"),
        F.when(month == 10, 78.0).otherwise(40.0).alias("invested_pct"), F.lit(100000.0).alias("nav"), F.when(c("sector") != "Gardening", c("volume") * c("close") * 20).alias("adv_usd"))


@query("sizing_chain", "Z6 F19", f"WITH {CAND}, {CHAIN} SELECT id, ticker, conviction, base_pct, CASE WHEN rejected_by IS NULL THEN f3 ELSE 0.0 END AS final_pct, rejected_by FROM c9", r="base_pct final_pct", digits=6)
def _(t):
    return R.size_candidates(candidates(t)).select("id", "ticker", "conviction", "base_pct", "final_pct", "rejected_by")


@query("slot_limits", "T7", f"""WITH {CAND}, {CHAIN}, ok AS (SELECT *, sector_pct + sum(f3) OVER (PARTITION BY date, sector ORDER BY conviction DESC, CAST(id AS BIGINT) ROWS UNBOUNDED PRECEDING) AS run FROM c9 WHERE rejected_by IS NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY date, signal_type ORDER BY conviction DESC, CAST(id AS BIGINT)) AS nth FROM ok WHERE run <= 30),
m AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY conviction DESC, CAST(id AS BIGINT)) AS slot FROM k WHERE signal_type <> 'congressional' OR nth <= 1) SELECT date, id, ticker, CAST(slot AS INT) AS slot FROM m WHERE slot <= 3""")
def _(t):
    out = R.admit(R.size_candidates(candidates(t)), 12, ["date"], [F.desc("conviction"), F.col("id").cast("bigint")])
    return out.select("date", "id", "ticker", "slot")


@query("entry_answers", "F24", """SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE CAST(round_even(conv_id % 13 + 0.5, 0) AS INT) END AS conviction, CASE WHEN turn % 4 = 3 THEN NULL WHEN role = 'user' THEN 'buy' WHEN role = 'assistant' THEN 'skip' ELSE 'hold' END AS entry,
turn % 4 <> 3 AND round_even(conv_id % 13 + 0.5, 0) BETWEEN 1 AND 10 AND role IN ('user', 'assistant') AND text <> '' AS valid FROM conversations""")
def _(t):
    c = F.col
    js = F.to_json(F.struct((c("conv_id") % 13 + 0.5).alias("conviction"), (c("turn") % 8).alias("position_pct"), F.when(c("text") != "", c("text")).alias("rationale"),
                            F.when(c("role") == "user", "buy").when(c("role") == "assistant", "skip").otherwise("hold").alias("entry")))
    got = R.checked_entries(t.conversations.withColumn("response", F.when(c("turn") % 4 == 3, "no json").otherwise(js)))
    return got.select("conv_id", "turn", "conviction", "entry", "valid")


@query("technical_answers", "F25", """WITH q AS (SELECT ticker, date, close AS last_close, low * 0.98 AS s, high * 1.03 AS g, CASE WHEN volume < 60 THEN 'buy' ELSE 'skip' END AS e FROM bars),
p AS (SELECT *, CASE WHEN s > 0 AND s < last_close AND last_close < g THEN (g - last_close) / (last_close - s) ELSE 0 END AS rr, 1.5 AS rep FROM q), z AS (SELECT *, e = 'buy' AND NOT (s > 0 AND s < last_close AND last_close < g AND abs(rr - rep) <= 0.05 * greatest(abs(rr), 1e-9)) AS bad FROM p)
SELECT ticker, date, CASE WHEN bad THEN 0 ELSE rr END AS reward_risk, CASE WHEN bad THEN 'skip' ELSE e END AS checked_entry FROM z""", r="reward_risk")
def _(t):
    df = t.bars.select("ticker", "date", F.col("close").alias("last_close"), (F.col("low") * 0.98).alias("invalidation_price"), (F.col("high") * 1.03).alias("target_price"),
                       F.when(F.col("volume") < 60, "buy").otherwise("skip").alias("entry"), F.lit(1.5).alias("reported"))
    return R.checked_technical(df).select("ticker", "date", "reward_risk", "checked_entry")


@query("research_fields", "A34 C15", """SELECT ticker, date, CASE WHEN volume <> 0 AND close <> 0 THEN volume * close END AS adv_usd, CASE WHEN volume % 4 = 0 THEN 'Buy' WHEN volume % 4 = 1 THEN 'Hold' WHEN volume % 4 = 2 THEN 'Sell' END AS rating,
CASE WHEN volume < 30 THEN 'n/a' ELSE concat(CAST(CAST(volume AS BIGINT) AS VARCHAR), '.0%') END AS shown, CASE WHEN volume % 7 <> 0 THEN volume % 7 / 50.0 * 100 END AS short_pct FROM bars""", r="adv_usd short_pct")
def _(t):
    v = F.col("volume")
    key = F.when(v % 4 == 0, "Strong_Buy").when(v % 4 == 1, "neutral").when(v % 4 == 2, "sell")
    return t.bars.select("ticker", "date", S.adv_usd(v, F.col("close")).alias("adv_usd"), S.analyst_rating(key).alias("rating"), S.format_number(F.when(v >= 30, v), 1, "%").alias("shown"), S.short_interest_pct(v % 7 / 50.0).alias("short_pct"))


TIGHT = replace(cfg.RISK, daily_reduce_pct=0.3, daily_halt_pct=0.6, daily_deleverage_pct=1.2, weekly_halt_pct=3.0, lockout_pct=25.0)


def nav_ticks(t: Tables):
    """Four observations per ticker and day, in the order open, high, low, close."""
    tick = F.posexplode(F.array("open", "high", "low", "close")).alias("_i", "nav")
    return t.bars.select(F.col("ticker").alias("portfolio_id"), "date", tick).select(
        "portfolio_id", (F.col("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("_i") + 9)).alias("ts"), "nav")


@query("circuit_breakers", "M5", """WITH ob AS (SELECT ticker, date, i, v AS nav, CAST(date_trunc('week', date) AS DATE) AS wk FROM (SELECT ticker, date, unnest([1, 2, 3, 4]) AS i, unnest([open, high, low, close]) AS v FROM bars) AS q),
ds AS (SELECT ticker, wk, date, open AS d0, max(open) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak, first_value(open) OVER (PARTITION BY ticker, wk ORDER BY date) AS w0 FROM (SELECT *, CAST(date_trunc('week', date) AS DATE) AS wk FROM bars) AS q),
l AS (SELECT ob.*, (d0 - nav) / d0 * 100 AS dl, (w0 - nav) / w0 * 100 AS wl, (peak - nav) / peak * 100 AS dd FROM ob JOIN ds ON ds.ticker = ob.ticker AND ds.date = ob.date),
s AS (SELECT *, max(CASE WHEN dd >= 25 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY date, i ROWS UNBOUNDED PRECEDING) AS locked, max(CASE WHEN wl >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, wk ORDER BY date, i ROWS UNBOUNDED PRECEDING) AS halted,
 max(CASE WHEN dl >= 1.2 THEN 3 WHEN dl >= 0.6 THEN 2 WHEN dl >= 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, date ORDER BY i ROWS UNBOUNDED PRECEDING) AS sev FROM l)
SELECT ticker AS portfolio_id, date, CAST(i AS INT) AS tick, CASE WHEN locked = 1 THEN 'locked_out' WHEN sev = 3 THEN 'deleverage' WHEN halted = 1 THEN 'weekly_halt' WHEN sev = 2 THEN 'entries_halted' WHEN sev = 1 THEN 'sizes_reduced' ELSE 'normal' END AS state FROM s""")
def _(t):
    return R.breaker_states(nav_ticks(t), TIGHT).select("portfolio_id", F.to_date("ts").alias("date"), (F.hour("ts") - 8).alias("tick"), "state")


@query("dashboard_state", "S21")
def _(t):
    got = R.nav_snapshot(positions(t), 100_000).drop("invested_pct")
    full = files.with_defaults(got, {"risk_state": F.lit("normal"), "regime_label": F.lit("unknown"), "cash": F.lit(0.0), "invested_pct": F.lit(0.0)})
    return full.select(F.to_json(F.struct("*")).alias("payload"))
