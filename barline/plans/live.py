"""Streaming queries, run with availableNow, and their batch twins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.operators import regime as G
from barline.plans.model import CHAIN, FT, LABEL, MODEL, MV, NAMES, XS, Chain, market_vix
from barline.plans.registry import QUERIES, Tables, query
from barline.plans.risk import TIGHT, nav_ticks
from barline.session import land
from barline.streaming import stateful as P
from barline.streaming import stateless as L
from barline.streaming.run import available_now, landed, latest_values


def land_rows(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return spark.read.schema(rows.schema).parquet(land(rows))


def events(t: Tables):
    return landed(t.spark, t.dir, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_dedup", "M1", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    return available_now(L.dedup(events(t).select("user_id", "event_type", "ts"), ["user_id", "event_type"])).select("user_id", "event_type")


COUNTS = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2"


@query("event_counts", "M7", COUNTS)
def _(t):
    rows = L.event_counts(t.events.withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("stream_event_counts", "M7", COUNTS)
def _(t):
    rows = L.event_counts(events(t)).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
    return latest_values(rows, ["window_start", "event_type"])


@query("stream_position_rules", "M3 M4", """WITH o AS (SELECT user_id, event_id, 50 + value AS v, first_value(50 + value) OVER w AS f, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
p AS (SELECT *, max(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pk FROM o),
h AS (SELECT user_id, min(event_id) FILTER (WHERE n > 1 AND (pk - v) / pk * 100 >= 15) AS s, min(event_id) FILTER (WHERE n > 1 AND (v - f) / f * 100 >= 40) AS h, min(event_id) FILTER (WHERE n > 1 AND (v - f) / f * 100 >= 25) AS t FROM p GROUP BY user_id)
SELECT user_id, least(s, h) AS seq, CASE WHEN s <= h OR h IS NULL THEN 'stop_loss' ELSE 'hard_exit' END AS action FROM h WHERE least(s, h) IS NOT NULL UNION ALL SELECT user_id, t, 'take_profit' FROM h WHERE t < coalesce(least(s, h), 9000000000000000)""")
def _(t):
    rows = events(t).select("user_id", F.col("event_id").alias("seq"), (50 + F.col("value")).alias("price"))
    rules = P.PositionRules("user_id", "bigint")
    return available_now(P.apply_state(rows, ["user_id"], rules, rules.schema)).select("user_id", "seq", "action")


TIMED = """WITH wm AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events), e AS (SELECT user_id, event_id, 50 + value AS v, ts FROM events, wm WHERE ts <= wm.wm), o AS (SELECT *, first_value(v) OVER w AS f, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT *, max(v) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pk FROM o),
h AS (SELECT user_id, min(n) FILTER (WHERE n > 1 AND (pk - v) / pk * 100 >= 15) AS s, min(n) FILTER (WHERE n > 1 AND (v - f) / f * 100 >= 40) AS h, min(n) FILTER (WHERE n > 1 AND (v - f) / f * 100 >= 25) AS t FROM p GROUP BY user_id),
a AS (SELECT user_id, least(s, h) AS n, CASE WHEN s <= h OR h IS NULL THEN 'stop_loss' ELSE 'hard_exit' END AS action FROM h WHERE least(s, h) IS NOT NULL UNION ALL SELECT user_id, t, 'take_profit' FROM h WHERE t < coalesce(least(s, h), 9000000000000000))
SELECT a.user_id, o.event_id AS seq, action FROM a JOIN o ON o.user_id = a.user_id AND o.n = a.n"""


@query("stream_timed_rules", "M3 M4", TIMED)
def _(t):
    """Position rules in event-time order, whatever the order of arrival: what the watermark
    (an hour behind the newest event) has passed."""
    rows = events(t).select("user_id", "ts", F.col("event_id").alias("seq"), (50 + F.col("value")).alias("price"))
    rules = P.Reordered(P.PositionRules("user_id", "bigint", by=("at_ms", "seq")), "at_ms bigint, seq bigint, price double")
    return available_now(P.apply_timed(rows, ["user_id"], rules, rules.schema, "ts", "1 hour")).select("user_id", "seq", "action")


@query("stream_dead_feeds", "M6", """WITH wm AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events), d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
n AS (SELECT *, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS nxt FROM d) SELECT user_id, day AS last_day FROM n, wm WHERE coalesce(nxt > day + 1, true) AND CAST(day + 2 AS TIMESTAMP) <= wm.wm""")
def _(t):
    """Feeds silent for a day, reported while they are silent."""
    rules = P.SilentFeeds("user_id", "bigint")
    return available_now(P.apply_timed(events(t).select("user_id", "ts"), ["user_id"], rules, rules.schema, "ts", "1 hour"))


@query("stream_silent_days", "M6", """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), g AS (SELECT user_id, min(day) AS a, max(day) AS z FROM d GROUP BY user_id),
a AS (SELECT user_id, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS silent_day FROM g) SELECT user_id, silent_day FROM a WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.user_id = a.user_id AND d.day = a.silent_day)""")
def _(t):
    rules = P.SilentDays("user_id", "bigint")
    return available_now(P.apply_state(events(t).select("user_id", "ts"), ["user_id"], rules, rules.schema))


@query("dead_feeds", "M6", """WITH l AS (SELECT user_id, CAST(max(ts) AS DATE) AS last_day FROM events GROUP BY user_id)
SELECT user_id, last_day, date_diff('day', last_day, DATE '2024-02-15') AS silent_days FROM l WHERE date_diff('day', last_day, DATE '2024-02-15') > 1""")
def _(t):
    return L.silent_feeds(t.events, "user_id", F.lit("2024-02-15").cast("date"))


@query("stream_circuit_breakers", "M5")
def _(t):
    folder = land(nav_ticks(t))
    rules = P.BreakerRules("portfolio_id", TIGHT)
    out = available_now(P.apply_state(landed(t.spark, folder, files=None), ["portfolio_id"], rules, rules.schema))
    return out.select("portfolio_id", F.to_date("ts").alias("date"), (F.hour("ts") - 8).alias("tick"), "state")


@query("stream_regime_filter", "M2", f"WITH {MV}, {FT}, {XS}, {CHAIN.filtered()} SELECT date, p0, p1, p2 FROM f", r="p0 p1 p2", digits=6, recursive=True)
def _(t):
    folder = land(t.market.select("market_id", "date", "close"))
    rules = P.RegimeFilter("market_id", MODEL)
    return available_now(P.apply_state(landed(t.spark, folder, files=None), ["market_id"], rules, rules.schema)).select("date", "p0", "p1", "p2")


@query("stream_timed_breakers", "M5", f"WITH s AS ({QUERIES['circuit_breakers'].sql}) SELECT s.* FROM s WHERE date + to_hours(tick + 8) <= (SELECT max(date + to_hours(tick + 8)) - INTERVAL 1 HOUR FROM s)")
def _(t):
    """Breakers in event-time order, whatever the order of arrival: what the watermark (an hour
    behind the newest observation) has passed."""
    folder = land(nav_ticks(t).withColumn("seen", F.col("ts").cast("timestamp")))
    rules = P.Reordered(P.BreakerRules("portfolio_id", TIGHT, by=("at_ms",)), "at_ms bigint, ts timestamp_ntz, nav double")
    out = available_now(P.apply_timed(landed(t.spark, folder), ["portfolio_id"], rules, rules.schema, "seen", "1 hour"))
    return out.select("portfolio_id", F.to_date("ts").alias("date"), (F.hour("ts") - 8).alias("tick"), "state")


EIGHT = [*NAMES[:4], "vix_level", "vix_change", *NAMES[4:]]
WIDE = G.Model(MODEL.start, MODEL.trans, np.array([[-0.5, 1.0, -1.0, 0.3, 0.8, 0.1, -0.8, -1.0], [0.0, 0.0, 0.0, 0.0, 0.1, 0.0, 0.0, 0.1], [0.4, -0.5, 0.9, -0.1, -0.6, -0.1, 0.7, 0.6]]),
               np.array([[6.0, 5.0, 4.0, 5.0, 6.0, 5.0, 4.0, 5.0], [4.0, 4.0, 4.0, 4.0, 4.0, 4.0, 4.0, 4.0], [5.0, 4.0, 4.5, 5.0, 4.0, 6.0, 4.0, 4.0]]))
WIDE_CHAIN = Chain(WIDE)
TRAIN_END = "1999-01-01"
WIDE_SQL = f"""WITH {MV}, {FT}, w AS (SELECT *, vix AS vix_level FROM ft WHERE trend_z IS NOT NULL AND vol_20d IS NOT NULL AND ret_1d IS NOT NULL),
st AS (SELECT {', '.join(f"avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}" for n in EIGHT)} FROM w WHERE date < DATE '{TRAIN_END}'),
xs AS MATERIALIZED (SELECT 'MKT' AS ticker, date, {', '.join(f"coalesce(({n} - m_{n}) / CASE WHEN s_{n} = 0 THEN 1 ELSE s_{n} END, 0) AS x{i}" for i, n in enumerate(EIGHT))}, row_number() OVER (ORDER BY date) AS n FROM w, st), {WIDE_CHAIN.filtered()},
lb AS (SELECT date, p0, p1, p2, greatest(p0, p1, p2) AS confidence, {LABEL} AS l FROM f), lg AS (SELECT *, lag(l, 1) OVER w AS l1, lag(l, 2) OVER w AS l2, lag(l, 3) OVER w AS l3 FROM lb WINDOW w AS (ORDER BY date))
SELECT date, l AS regime_label, confidence, p0, p1, p2, coalesce(l = l1 AND l = l2 AND l = l3, false) AS is_stable, CASE WHEN l3 IS NULL THEN 1.0 ELSE (CAST(l1 <> l2 AS INT) + CAST(l2 <> l3 AS INT)) / 2 END AS transition_rate FROM lg"""


@query("stream_regime_update", "M2", WIDE_SQL, r="confidence p0 p1 p2 transition_rate", digits=6, recursive=True)
def _(t):
    """All features under the stored scaler and model, which are the initial state of a series."""
    market = market_vix(t)
    train = G.warmed_up(G.features(market)).where(F.col("date") < TRAIN_END)
    scaler = G.fit_scaler(train, ["market_id"], EIGHT)
    models = G.stored_models(scaler, ["market_id"], EIGHT, WIDE, [0, 1, 2], ["crash", "neutral", "bull"])
    rules = P.RegimeUpdate("market_id")
    folder = land(market.select("market_id", "date", "close", "volume", "vix"))
    out = available_now(P.apply_state(landed(t.spark, folder, files=None), ["market_id"], rules, rules.schema, land_rows(t.spark, models)))
    return out.select("date", "regime_label", "confidence", *[F.col("posteriors")[i].alias(f"p{i}") for i in range(3)], "is_stable", "transition_rate")


# The stream must give what the batch twin gives: same check text.
_twin = QUERIES["stream_circuit_breakers"]
QUERIES["stream_circuit_breakers"] = type(_twin)(_twin.name, _twin.ids, _twin.run, QUERIES["circuit_breakers"].sql)
