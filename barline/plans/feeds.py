"""Disclosure feeds, filters and reference-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline import config as cfg
from barline.functions import scalars as S
from barline.functions.series import first_per_key
from barline.operators import disclosures as D
from barline.operators import joins
from barline.plans.registry import Tables, query
from barline.session import checkpoint_root
from barline.sources import disclosures as src
from barline.sources import files

FLOOR = "coalesce(try_cast(regexp_replace(regexp_split_to_array(amount_range, '[-–]')[1], '[^0-9]', '', 'g') AS BIGINT), 0)"
HEAD = "replace(trim(regexp_split_to_array(amount_range, '[-–]')[1]), ',', '')"
FLOOR_KM = (
    f"coalesce(CAST(trunc(try_cast(regexp_extract({HEAD}, '^([0-9.]+)', 1) AS DOUBLE) * CASE upper(regexp_extract({HEAD}, '^[0-9.]+\\s*([KkMm]?)', 1)) "
    "WHEN 'K' THEN 1000 WHEN 'M' THEN 1000000 ELSE 1 END) AS BIGINT), 0)"
)
TIDY = "replace(upper(trim(ticker)), '.', '-')"
VALID = (
    f"(regexp_matches({TIDY}, '^[A-Z]{{1,5}}([.\\-][A-Z])?$') AND regexp_matches(transaction_date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') "
    "AND regexp_matches(disclosure_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AND id <> '')"
)
LAG = "CAST(disclosure_date - transaction_date AS INT)"
RULES = ", ".join(
    f"({i}, '{k.lower()}', '{s}')" for i, (k, v) in enumerate(cfg.COMMITTEE_RULES) for s in v
)
COVERED = f"""covered AS (SELECT DISTINCT m.politician, r.sector FROM committee_members AS m
  JOIN (VALUES {RULES}) AS r(key_order, rule_key, sector) ON contains(lower(m.committee), r.rule_key)
  WHERE r.key_order = (SELECT min(q.key_order) FROM (VALUES {RULES}) AS q(key_order, rule_key, sector) WHERE contains(lower(m.committee), q.rule_key)))"""
TRADES = "id, politician, transaction_type, transaction_date, disclosure_date, amount_range"


@query("ticker_normalise", "F5", f"SELECT DISTINCT ticker, {TIDY} AS clean FROM raw_trades")
def _(t):
    return t.raw_trades.select("ticker", S.normalize_ticker(F.col("ticker")).alias("clean")).distinct()


@query("trade_validation", "F4", f"SELECT id, ticker, {VALID} AS valid FROM raw_trades")
def _(t):
    rows = t.raw_trades.withColumn("raw", F.col("ticker")).withColumn("ticker", S.normalize_ticker(F.col("ticker")))
    return rows.select("id", F.col("raw").alias("ticker"), src.is_valid_trade().alias("valid"))


@query("amount_floor", "C2 F6", f"SELECT id, amount_range, {FLOOR} AS amount_min_usd FROM disclosures WHERE {FLOOR} >= 15000")
def _(t):
    return t.disclosures.select("id", "amount_range", S.amount_floor(F.col("amount_range")).alias("amount_min_usd")).where(
        F.col("amount_min_usd") >= cfg.UNIVERSE.min_trade_usd)


@query("amount_floor_suffix", "C3", f"SELECT id, amount_range, {FLOOR_KM} AS amount_min_usd FROM raw_trades")
def _(t):
    return t.raw_trades.select("id", "amount_range", S.amount_floor_suffix(F.col("amount_range")).alias("amount_min_usd"))


@query("lag_days", "C4", f"SELECT id, {LAG} AS lag_days FROM disclosures")
def _(t):
    return t.disclosures.select("id", S.lag_days(F.col("transaction_date"), F.col("disclosure_date")).alias("lag_days"))


def _payloads(t: Tables):
    """JSON documents in the spellings vendors use, one per disclosure."""
    flat = F.to_json(F.struct(F.array(F.struct(
        "id", "politician", F.col("ticker"), F.col("transaction_date"), F.col("disclosure_date"),
        F.upper("transaction_type").alias("transactionType"), F.col("amount_range"))).alias("trades")))
    nested = F.to_json(F.struct(F.array(F.struct(
        "id", F.struct(F.col("politician").alias("name")).alias("politician"), F.struct("ticker").alias("issuer"),
        F.col("transaction_date").alias("txDate"), F.col("disclosure_date").alias("disclDate"),
        F.col("transaction_type").alias("txType"), F.col("amount_range").alias("amount"))).alias("data")))
    return t.raw_trades.select(F.when(F.col("transaction_type") == "buy", nested).otherwise(flat).alias("payload"))


@query("disclosure_json", "S9", f"SELECT {TRADES}, {TIDY} AS ticker, {VALID} AS valid FROM raw_trades")
def _(t):
    return src.parse_json(_payloads(t)).select(*src.TRADE, "valid")


@query("disclosure_quarantine", "S9 F4", f"SELECT {TRADES}, {TIDY} AS ticker FROM raw_trades WHERE NOT {VALID}")
def _(t):
    return src.parse_json(_payloads(t)).where("NOT valid").select(*src.TRADE)


@query("disclosure_html", "S10", f"SELECT id AS page_id, {TRADES}, {TIDY} AS ticker, {VALID} AS valid FROM raw_trades")
def _(t):
    cell = lambda c: F.concat(F.lit("<td class=\"c\"> <span>"), c, F.lit("</span></td>"))
    kind = F.when(F.col("transaction_type") == "buy", "Purchase").otherwise("Sale")
    row = F.concat(F.lit('<tr class="q-tr" data-id="'), "id", F.lit('">'), cell(F.col("politician")), cell(F.lit("House")),
                   cell(F.col("ticker")), cell(kind), cell(F.col("transaction_date")), cell(F.col("disclosure_date")),
                   cell(F.col("amount_range")), F.lit("</tr>"))
    html = F.concat(F.lit('<html><table><tr><td>nav</td></tr></table><table class="q-table wide"><tbody><tr><td>ad</td></tr>'),
                    row, F.lit("</tbody></table></html>"))
    return src.parse_html(t.raw_trades.select(F.col("id").alias("page_id"), html.alias("html"))).select("page_id", *src.TRADE, "valid")


@query("snapshot_items", "S11", "SELECT id, ticker, transaction_type FROM raw_trades")
def _(t):
    one = F.struct("id", "ticker", "transaction_type")
    doc = F.when(F.col("transaction_type") == "buy", F.to_json(F.array(one))).otherwise(F.to_json(F.struct(F.array(one).alias("trades"))))
    return src.snapshot_items(t.raw_trades.select(doc.alias("payload"))).select("id", "ticker", "transaction_type")


@query("page_fallback", "S22", """WITH rows AS (SELECT o_custkey AS page, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS priority, o_orderkey FROM orders)
SELECT page, priority, o_orderkey FROM rows WHERE priority = (SELECT min(q.priority) FROM rows AS q WHERE q.page = rows.page)""")
def _(t):
    rows = t.orders.select(F.col("o_custkey").alias("page"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("priority"), "o_orderkey")
    return joins.by_priority(rows, ["page"], "priority")


@query("symbol_list", "S12", "SELECT DISTINCT ticker FROM raw_trades WHERE regexp_matches(ticker, '^[A-Z]{1,5}$')")
def _(t):
    return files.enough(files.valid_symbols(t.raw_trades, "ticker").distinct(), 10, "symbol list")


@query("universe_union", "U1", "SELECT DISTINCT upper(trim(ticker)) AS ticker FROM (SELECT ticker FROM book UNION ALL SELECT ticker FROM broker) AS u")
def _(t):
    return files.union_universe(t.book, t.broker)


@query("universe_filter", "F11", "SELECT id, ticker FROM disclosures WHERE ticker IN (SELECT ticker FROM (SELECT upper(ticker) AS u, ticker FROM broker) AS b) ")
def _(t):
    return D.in_universe(t.disclosures, t.broker.select(F.concat(F.lit(" "), F.lower("ticker")).alias("ticker"))).select("id", "ticker")


@query("raw_signals", "F8", f"""SELECT id, disclosure_date AS date, ticker, 65 AS conviction, CAST(5.0 AS DOUBLE) AS position_pct, politician FROM disclosures
WHERE transaction_type = 'buy' AND {FLOOR} >= 15000 AND {LAG} BETWEEN 0 AND 45""")
def _(t):
    return D.raw_signals(t.disclosures)


@query("windowed_signals", "F9", f"""SELECT id, disclosure_date AS date, upper(ticker) AS ticker, politician, CAST(CAST(disclosure_date AS DATE) - CAST(transaction_date AS DATE) AS INT) AS lag_days
FROM raw_trades WHERE transaction_type = 'buy' AND regexp_matches(ticker, '^[A-Z]{{1,5}}$') AND regexp_matches(disclosure_date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')
AND disclosure_date BETWEEN '1997-01-01' AND '1999-12-31' AND {FLOOR_KM} >= 15000
AND CAST(disclosure_date AS DATE) - CAST(transaction_date AS DATE) BETWEEN 0 AND 45""")
def _(t):
    return D.windowed_signals(t.raw_trades, "1997-01-01", "1999-12-31")


@query("committee_sectors", "J5", f"WITH {COVERED} SELECT politician, sector FROM covered")
def _(t):
    return D.covered_sectors(t.committee_members)


@query("qualified_signals", "F7 F6 F11 J5", f"""WITH {COVERED} SELECT d.id, d.politician, d.ticker, s.sector FROM disclosures AS d JOIN sectors AS s ON s.ticker = d.ticker
WHERE transaction_type = 'buy' AND {FLOOR} >= 15000 AND {LAG} BETWEEN 0 AND 45 AND d.ticker IN (SELECT ticker FROM broker)
AND EXISTS (SELECT 1 FROM covered AS c WHERE c.politician = d.politician AND c.sector = s.sector)""")
def _(t):
    return D.qualified(t.disclosures, t.broker, t.committee_members, t.sectors).select("id", "politician", "ticker", "sector")


@query("politician_match", "J4", """WITH ref AS (SELECT c_custkey AS load_order, lower(concat(c_mktsegment, ' M. ', n_name, CASE WHEN c_custkey % 2 = 0 THEN ' Jr.' ELSE '' END, CASE WHEN c_custkey < 100 THEN '' ELSE ' III' END)) AS name,
  lower(c_mktsegment) AS f, lower(n_name) AS l, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey),
people AS (SELECT c_custkey AS pid, CASE c_custkey % 3 WHEN 0 THEN concat(' ', upper(c_mktsegment), ' m. ', n_name, ' Jr.') WHEN 1 THEN concat(c_mktsegment, ' Zed ', n_name, ' II') ELSE concat('Nobody ', n_name) END AS politician,
  lower(c_mktsegment) AS f, lower(n_name) AS l FROM customer JOIN nation ON c_nationkey = n_nationkey),
ex AS (SELECT name, min(load_order) AS lo FROM ref GROUP BY name), lo AS (SELECT f, l, min(load_order) AS lo FROM ref GROUP BY f, l)
SELECT pid, coalesce(ex.lo, lo.lo) AS load_order, CASE WHEN ex.lo IS NOT NULL THEN 'exact' ELSE 'tokens' END AS matched FROM people AS p
LEFT JOIN ex ON ex.name = lower(trim(p.politician)) LEFT JOIN lo ON lo.f = p.f AND lo.l = p.l AND p.pid % 3 <> 2 WHERE coalesce(ex.lo, lo.lo) IS NOT NULL""")
def _(t):
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    tail = F.concat(F.when(F.col("c_custkey") % 2 == 0, " Jr.").otherwise(""), F.when(F.col("c_custkey") < 100, "").otherwise(" III"))
    ref = c.select(F.col("c_custkey").alias("load_order"), F.concat("c_mktsegment", F.lit(" M. "), "n_name", tail).alias("name"))
    kind = F.col("c_custkey") % 3
    who = (F.when(kind == 0, F.concat(F.lit(" "), F.upper("c_mktsegment"), F.lit(" m. "), "n_name", F.lit(" Jr.")))
           .when(kind == 1, F.concat("c_mktsegment", F.lit(" Zed "), "n_name", F.lit(" II")))
           .otherwise(F.concat(F.lit("Nobody "), "n_name")))
    return D.match_politicians(c.select(F.col("c_custkey").alias("pid"), who.alias("politician")), ref).select("pid", "load_order", "matched")


@query("committee_flatten", "S13", """SELECT lower(c_name) AS name, CASE WHEN c_acctbal > 5000 THEN concat(least(n_name, r_name), '; ', greatest(n_name, r_name)) ELSE n_name END AS committees
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def _(t):
    people = t.customer.select(F.struct(F.concat(F.lit("B"), "c_custkey").alias("bioguide")).alias("id"), F.struct(F.col("c_name").alias("official_full")).alias("name"))
    subs = t.nation.groupBy("n_regionkey").agg(F.collect_list(F.struct(F.concat(F.lit("N"), "n_nationkey").alias("thomas_id"), F.col("n_name").alias("name"))).alias("subcommittees"))
    com = t.region.join(subs, F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat(F.lit("R"), "r_regionkey").alias("thomas_id"), F.col("r_name").alias("name"), "subcommittees")
    seat = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    who = F.array(F.struct(F.concat(F.lit("B"), "c_custkey").alias("bioguide_id"))).alias("members")
    low = seat.select(F.concat(F.lit("R"), "n_regionkey", F.lit("N"), "n_nationkey").alias("thomas_id"), who)
    top = seat.where("c_acctbal > 5000").select(F.concat(F.lit("R"), "n_regionkey").alias("thomas_id"), who)
    out = src.committee_members(people, com, low.unionByName(top).unionByName(top))
    return out.select("name", F.array_join("committees", "; ").alias("committees"))


@query("cluster_counts", "A4", """SELECT d.id, count(DISTINCT b.politician) AS cluster_count FROM disclosures AS d LEFT JOIN disclosures AS b
ON b.ticker = d.ticker AND b.transaction_type = 'buy' AND b.disclosure_date BETWEEN d.disclosure_date - 30 AND d.disclosure_date GROUP BY d.id""")
def _(t):
    return D.cluster_counts(t.disclosures).select("id", "cluster_count")


@query("cluster_since", "A4", "SELECT ticker, count(DISTINCT politician) AS cluster_count FROM disclosures WHERE transaction_type = 'buy' AND disclosure_date >= DATE '2001-06-01' GROUP BY ticker")
def _(t):
    d = t.disclosures.where("transaction_type = 'buy' AND disclosure_date >= DATE '2001-06-01'")
    return d.groupBy("ticker").agg(F.countDistinct("politician").alias("cluster_count"))


@query("signal_disclosures", "J2", """SELECT s.id, s.ticker, s.conviction, d.politician, d.disclosure_date, d.amount_range FROM signals AS s JOIN disclosures AS d ON d.id = s.id""")
def _(t):
    d = t.disclosures.select("id", "politician", "disclosure_date", "amount_range")
    return t.signals.select("id", "ticker", "conviction").join(d, "id")


@query("fresh_disclosures", "J3", """SELECT id, disclosure_date FROM disclosures WHERE id NOT IN (SELECT id FROM disclosures WHERE disclosure_date >= DATE '2001-05-03' AND transaction_type = 'buy')""")
def _(t):
    stored = t.disclosures.where("transaction_type = 'buy'")
    return joins.fresh_rows(t.disclosures, stored, "id", "disclosure_date", "2001-08-01").select("id", "disclosure_date")


@query("dedup_by_id", "U5", """SELECT DISTINCT id, min(l_partkey * 1000 + l_suppkey) OVER (PARTITION BY id) AS pos FROM (SELECT concat(l_orderkey, '-', l_linenumber) AS id, l_partkey, l_suppkey FROM lineitem) AS x""")
def _(t):
    pos = (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("pos")
    return first_per_key(t.lineitem.select(F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("id"), pos), ["id"], ["pos"])


@query("event_exclusion", "F12", """WITH fomc AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS e FROM orders WHERE day(o_orderdate) = 17 AND month(o_orderdate) IN (3, 6, 9, 12)),
earn AS (SELECT ticker, date AS e FROM fundamentals)
SELECT d.id, coalesce((SELECT concat('FOMC ', min(e)) FROM fomc WHERE e - d.disclosure_date BETWEEN 0 AND 2),
  (SELECT concat('earnings ', min(e)) FROM earn WHERE earn.ticker = d.ticker AND e - d.disclosure_date BETWEEN 0 AND 2), '') AS reason FROM disclosures AS d""".replace("concat('FOMC ', min(e))", "'FOMC ' || CAST(min(e) AS VARCHAR)").replace("concat('earnings ', min(e))", "'earnings ' || CAST(min(e) AS VARCHAR)"))
def _(t):
    fomc = t.orders.where("day(o_orderdate) = 17 AND month(o_orderdate) IN (3, 6, 9, 12)").select(F.to_date("o_orderdate").alias("event_date")).distinct()
    earn = t.fundamentals.select("ticker", F.col("date").alias("event_date"))
    asked = t.disclosures.withColumn("date", F.col("disclosure_date"))
    return D.upcoming_event(asked, fomc, earn).select("id", "reason")


@query("event_free_signals", "F12", """SELECT id FROM disclosures AS d WHERE NOT EXISTS (SELECT 1 FROM fundamentals AS f WHERE f.ticker = d.ticker AND f.date - d.disclosure_date BETWEEN 0 AND 2)""")
def _(t):
    earn = t.fundamentals.select("ticker", F.col("date").alias("event_date"))
    asked = t.disclosures.withColumn("date", F.col("disclosure_date"))
    return D.upcoming_event(asked, earn.select("event_date").where("false"), earn).where("reason = ''").select("id")


@query("trading_day_gate", "F29", "SELECT id, date FROM signals WHERE date IN (SELECT date FROM bars)")
def _(t):
    return D.on_sessions(t.signals, t.bars).select("id", "date")


@query("lag_variants", "F10", "SELECT id, ticker, v AS max_lag FROM signals JOIN (VALUES (7), (14), (30), (45)) AS q(v) ON lag_days <= v")
def _(t):
    return D.lag_variants(t.signals).select("id", "ticker", "max_lag")


@query("merged_variants", "J16", """WITH f AS (SELECT DISTINCT date, ticker FROM signals WHERE conviction >= 9), q AS (SELECT * FROM (VALUES (7), (14), (30), (45)) AS q(v))
SELECT v AS max_lag, date, ticker, CAST(NULL AS INT) AS lag_days FROM f, q UNION ALL
SELECT v, date, ticker, lag_days FROM signals JOIN q ON lag_days <= v WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.date = signals.date AND f.ticker = signals.ticker)""")
def _(t):
    factor = t.signals.where("conviction >= 9").select("date", "ticker").distinct()
    return D.merged_variants(factor, t.signals.select("date", "ticker", "lag_days")).select("max_lag", "date", "ticker", "lag_days")


@query("signal_type_tags", "J22", "SELECT id, ticker, CASE WHEN ticker IN (SELECT ticker FROM book) THEN 'both' ELSE 'congressional' END AS signal_type FROM signals")
def _(t):
    return D.tag_signal_type(t.signals, t.book, "congressional").select("id", "ticker", "signal_type")


@query("most_signalled", "T3", "SELECT ticker, count(*) AS n_signals, min(date) AS first_seen FROM signals GROUP BY ticker ORDER BY n_signals DESC, first_seen, ticker LIMIT 60")
def _(t):
    return D.most_signalled(t.signals)


@query("signal_union", "U2", """SELECT date, ticker, conviction, lag_days FROM signals UNION ALL SELECT entry_date, ticker, conviction, NULL FROM closed_positions WHERE signal_source = 'fundamental'""")
def _(t):
    f = t.closed_positions.where("signal_source = 'fundamental'").select(F.col("entry_date").alias("date"), "ticker", "conviction")
    return t.signals.select("date", "ticker", "conviction", "lag_days").unionByName(f, allowMissingColumns=True)


@query("constituent_load", "S4", "SELECT date, ticker FROM constituents")
def _(t):
    raw = t.constituents.select(F.col("date").cast("string").alias("date"), F.concat(F.lit(" "), F.lower("ticker")).alias("ticker"))
    return files.clean_keys(raw).withColumn("ticker", F.replace("ticker", F.lit("BRAND"), F.lit("Brand")))


@query("fundamental_load", "S5", """SELECT date, upper(ticker) AS ticker, trailingPE, CASE WHEN trailingPE < 25 THEN NULL ELSE marketCap END AS marketCap FROM fundamentals""")
def _(t):
    raw = t.fundamentals.select(F.col("date").cast("string").alias("date"), F.concat(F.lower("ticker"), F.lit(" ")).alias("ticker"),
                                F.col("trailingPE").cast("string").alias("trailingPE"),
                                F.when(F.col("trailingPE") < 25, "n/a").otherwise(F.col("marketCap").cast("string")).alias("marketCap"))
    return files.typed_fundamentals(raw)


@query("wide_prices", "S6", "SELECT date, upper(ticker) AS ticker, close FROM bars")
def _(t):
    names = [f"Brand#{i}" for i in range(1, 26)]
    wide = t.bars.groupBy("date").pivot("ticker", names).agg(F.max("close"))
    return files.long_prices(wide)


@query("factor_load", "S7", """SELECT date, CASE WHEN volume < 500 THEN NULL ELSE close / 1000 END AS MKT_RF, volume AS SMB FROM market WHERE volume >= 300""")
def _(t):
    smb = F.when(F.col("volume") < 300, "").otherwise(F.col("volume").cast("string"))
    mkt = F.when(F.col("volume") < 500, "bad").otherwise((F.col("close") / 1000).cast("string"))
    return files.factor_returns(t.market.select(F.col("date").cast("string").alias("Date"), mkt.alias("MKT_RF"), smb.alias("SMB")))


@query("dated_reader", "S3", "SELECT date, close FROM market")
def _(t):
    path = f"{checkpoint_root(t.spark)}/market_csv/{t.dir.rstrip('/').split('/')[-1]}"
    files.write_csv(t.market.withColumn("date", F.col("date").cast("string")), path, ["date", "close"])
    return files.read_dated(t.spark, path, "date string, close double")


@query("daily_bars", "S8", "SELECT ticker, date, open, high, low, close, volume FROM bars WHERE date BETWEEN DATE '2001-06-30' - (2 * 365 + 30) AND DATE '2001-06-30'")
def _(t):
    return files.daily_bars(t.bars, "2001-06-30", 2)
