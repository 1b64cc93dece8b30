"""Adapters that shape the driver tables into the operators' input schemas.

The text is plain SQL that Spark and DuckDB both accept, so a registered query and
its check SQL start from the same rows. ``bround`` (half-even rounding) is spelled
``round_even`` in DuckDB. Prices are rounded so that comparisons of two closes do not
depend on the order in which an engine adds doubles. No adapter leaves rows out of its
tables, but for joins and windows that have no value. Book and broker hold the same suppliers
under tickers that are shifted by three, so each side has positions that the other lacks.

Size bounds that the operators rely on: ``bars`` has one row per (ticker, date), so a
ticker never holds more rows than there are calendar days; ``market`` and
``regime_daily`` have one row per date.
"""

from __future__ import annotations

import re

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

ADAPTERS: dict[str, str] = {
    "daily": """
SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, avg(l_discount) AS d, avg(l_tax) AS t, sum(l_quantity) AS volume
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, CAST(l_shipdate AS DATE)""",
    "closes": """
SELECT ticker, date, bround(d, 4) AS d, bround(t, 4) AS t, volume,
       bround(100 * exp(sum(bround(d - t - 0.01, 6)) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 4), 4) AS close
FROM daily""",
    "opens": """
SELECT closes.*, coalesce(lag(close) OVER (PARTITION BY ticker ORDER BY date), close) AS open FROM closes""",
    "bars": """
SELECT ticker, date, open, greatest(open, close) * (1 + d / 10) AS high,
       least(open, close) * (1 - t / 10) AS low, close, volume FROM opens""",
    "market": """
SELECT 'MKT' AS market_id, date, bround(exp(avg(ln(close))), 4) AS close, sum(volume) AS volume FROM bars GROUP BY date""",
    "fear": """
SELECT CAST(o_orderdate AS DATE) AS date, bround(10 + avg(o_totalprice) / 20000, 4) AS vix FROM orders
GROUP BY CAST(o_orderdate AS DATE)""",
    "sectors": """
SELECT ticker, CASE WHEN CAST(replace(ticker, 'Brand#', '') AS INT) % 7 = 6 THEN 'Gardening'
       WHEN CAST(replace(ticker, 'Brand#', '') AS INT) % 3 = 0 THEN 'Technology'
       WHEN CAST(replace(ticker, 'Brand#', '') AS INT) % 3 = 1 THEN 'Financial Services' ELSE 'Healthcare' END AS sector
FROM (SELECT DISTINCT p_brand AS ticker FROM part) AS b""",
    "disclosures": """
SELECT CAST(o_orderkey AS STRING) AS id, c_name AS politician, concat('Brand#', CAST(1 + o_orderkey % 25 AS STRING)) AS ticker,
       CAST(o_orderdate AS DATE) AS transaction_date, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 61 AS INT) AS DATE) AS disclosure_date,
       CASE WHEN o_orderstatus = 'F' THEN 'sell' ELSE 'buy' END AS transaction_type,
       CASE WHEN o_totalprice < 50000 THEN '$1,001 - $15,000' WHEN o_totalprice < 150000 THEN '$15,001 - $50,000'
            WHEN o_totalprice < 300000 THEN '$50,001 – $100,000' ELSE '$100,001 - $250,000' END AS amount_range
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "raw_trades": """
SELECT CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN '' ELSE CAST(o_orderkey AS STRING) END AS id, c_name AS politician,
       concat(substring('QRSTUVWX', 1 + CAST(o_orderkey % 3 AS INT), 1 + CAST(c_nationkey % 6 AS INT)),
              CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '.B' WHEN c_mktsegment = 'MACHINERY' THEN '9' ELSE '' END) AS ticker,
       CASE WHEN o_orderstatus = 'F' THEN 'sell' ELSE 'buy' END AS transaction_type,
       CAST(CAST(o_orderdate AS DATE) AS STRING) AS transaction_date,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '/')
            ELSE CAST(CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 61 AS INT) AS DATE) AS STRING) END AS disclosure_date,
       CASE WHEN o_totalprice < 50000 THEN '1K–15K' WHEN o_totalprice < 150000 THEN '15.5K-50K'
            WHEN o_totalprice < 300000 THEN '100,001 - 250,000' WHEN o_totalprice < 400000 THEN '$15,001 - $50,000' ELSE '1M–5M' END AS amount_range
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "fundamentals": """
SELECT p_brand AS ticker, CAST(date_trunc('quarter', l_shipdate) + INTERVAL '5' MONTH AS DATE) AS date,
       bround(avg(l_quantity), 6) AS trailingPE, bround(avg(p_size) / 10, 6) AS priceToBook,
       bround(sum(l_extendedprice * l_discount), 4) AS freeCashflow, bround(sum(l_extendedprice), 2) AS marketCap,
       bround(avg(l_discount) * 4, 6) AS returnOnEquity, bround(avg(l_tax) * 4 - 0.1, 6) AS profitMargins,
       bround(avg(p_retailprice) / 1000, 6) AS debtToEquity
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, date_trunc('quarter', l_shipdate)""",
    "closed_positions": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_brand AS ticker, CAST(o_orderdate AS DATE) AS entry_date, CAST(l_shipdate AS DATE) AS exit_date,
       p_retailprice AS entry_price, bround(p_retailprice * (1 + (l_discount - l_tax) * 4), 4) AS exit_price, l_quantity AS shares,
       CASE l_returnflag WHEN 'R' THEN 'fundamental' WHEN 'A' THEN 'congressional' END AS signal_source, l_linenumber + 2 AS conviction,
       bround(l_quantity * p_retailprice * (1 + (l_discount - l_tax) * 4) - l_quantity * p_retailprice, 4) AS realized_pnl
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_shipdate > o_orderdate""",
    "regime_log": """
SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'crash' WHEN '2-HIGH' THEN 'bear' WHEN '3-MEDIUM' THEN 'neutral' WHEN '5-LOW' THEN 'euphoria' ELSE 'bull' END AS regime_label,
       bround(o_totalprice / 500000, 6) AS confidence FROM orders""",
    "headlines": """
SELECT doc_id AS line_no, text AS headline, source AS ticker, CAST(CAST(DATE '2024-01-01' + CAST(doc_id % 90 AS INT) AS DATE) AS STRING) AS date, lang AS source FROM documents""",
    "moves": """
SELECT date, close, close / lag(close, 20) OVER (ORDER BY date) - 1 AS m FROM market""",
    "regime_daily": """
SELECT date, CASE WHEN m < -0.02 THEN 'crash' WHEN m < -0.005 THEN 'bear' WHEN m < 0.005 THEN 'neutral' WHEN m < 0.02 THEN 'bull' ELSE 'euphoria' END AS regime_label,
       bround(least(0.3 + abs(m) * 20, 1.0), 6) AS confidence FROM moves WHERE m IS NOT NULL""",
    "signals": """
SELECT id, disclosure_date AS date, ticker, CAST(5 + CAST(id AS BIGINT) % 6 AS INT) AS conviction, CAST(5.0 AS DOUBLE) AS position_pct,
       CAST(CAST(id AS BIGINT) % 61 AS INT) AS lag_days FROM disclosures WHERE transaction_type = 'buy'""",
    "committee_members": """
SELECT c_name AS politician, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Senate Commerce Science Panel' WHEN 'BUILDING' THEN 'House Agriculture'
       WHEN 'FURNITURE' THEN 'Senate Banking Committee' WHEN 'HOUSEHOLD' THEN 'House Appropriations' ELSE 'Joint Printing' END AS committee
FROM customer""",
    "constituents": """
SELECT CAST(date_trunc('quarter', date) AS DATE) AS date, ticker FROM bars GROUP BY CAST(date_trunc('quarter', date) AS DATE), ticker
HAVING max_by(close, date) > 0.97 * min_by(close, date)""",
    "book": """
SELECT concat('Brand#', CAST(s_suppkey % 20 + 1 AS STRING)) AS ticker, bround(sum(abs(s_acctbal)) / 100, 4) AS qty FROM supplier
GROUP BY s_suppkey % 20""",
    "broker": """
SELECT concat('Brand#', CAST(s_suppkey % 20 + 4 AS STRING)) AS ticker, bround(sum(abs(s_acctbal + s_suppkey % 2)) / 100, 4) AS qty FROM supplier
GROUP BY s_suppkey % 20""",
    "open_positions": """
SELECT ticker, qty AS shares, CAST(90 + CAST(replace(ticker, 'Brand#', '') AS INT) AS DOUBLE) AS entry_price,
       CASE CAST(replace(ticker, 'Brand#', '') AS INT) % 4 WHEN 0 THEN 'hedge' WHEN 1 THEN 'fundamental' WHEN 2 THEN 'congressional' END AS signal_source,
       CAST(DATE '2001-01-01' + CAST(replace(ticker, 'Brand#', '') AS INT) * 5 AS DATE) AS entry_date FROM book""",
    "last_price": """
SELECT ticker, max_by(close, date) AS price, max(date) AS price_date FROM bars GROUP BY ticker""",
    "nav": """
SELECT 'book' AS portfolio_id, date, close * 1000 AS nav FROM market""",
    "news_labels": """
SELECT text AS headline, source AS ticker, CAST(CAST(DATE '2024-01-01' + CAST(documents.doc_id % 90 AS INT) AS DATE) AS STRING) AS date,
       CASE WHEN toxic = 1 THEN 'SELL' WHEN quality = 1 THEN 'Buy' ELSE 'hold' END AS raw_signal, documents.doc_id AS processed_at
FROM labels JOIN documents ON labels.doc_id = documents.doc_id""",
}

# What Spark derives in place of the text above. Sums of doubles depend on the order of addition,
# and averages of hundredths often lie halfway between two rounded values: sums of decimals as
# written give the same panel whatever the order, and round what lies halfway to even.
EXACT: dict[str, str] = {
    "daily": re.sub(r"avg\((\w+)\)", r"CAST(sum(CAST(\1 AS DECIMAL(28, 18))) AS DOUBLE) / count(\1)", ADAPTERS["daily"]),
}


def mentions(text: str, name: str) -> bool:
    return re.search(rf"(FROM|JOIN)\s+{name}\b", text) is not None


def needed(text: str, skip: tuple[str, ...] = ()) -> list[str]:
    """Adapters the text mentions, each after the ones it builds on."""
    order: list[str] = []

    def visit(body: str) -> None:
        for name in ADAPTERS:
            if name not in order and name not in skip and mentions(body, name):
                visit(ADAPTERS[name])
                if name not in order:
                    order.append(name)

    visit(text)
    return order


def with_adapters(body: str, recursive: bool = False) -> str:
    """DuckDB text: the adapters the body needs as CTEs, then the body."""
    body = body.strip()
    own = body[4:].lstrip() if body.upper().startswith("WITH ") else None
    parts = [f"{n} AS ({ADAPTERS[n].strip()})" for n in needed(body)]
    head = "WITH RECURSIVE " if recursive else "WITH "
    if own is not None:
        text = head + ", ".join(parts + [""]) + own if parts else head + own
    else:
        text = head + ", ".join(parts) + " " + body if parts else body
    return text.replace("bround(", "round_even(")
