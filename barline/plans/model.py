"""Regime feature, scaling and hidden-state queries over the market series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from barline.functions.series import over, so_far
from barline.operators import chain, joins
from barline.operators import metrics as M
from barline.operators import regime as G
from barline.plans.registry import Tables, query

MV = """mv AS MATERIALIZED (SELECT m.*, last_value(f.vix IGNORE NULLS) OVER (ORDER BY m.date ROWS UNBOUNDED PRECEDING) AS vix FROM market AS m LEFT JOIN fear AS f ON f.date = m.date)"""
FT = """f0 AS (SELECT *, close / lag(close) OVER (ORDER BY date) - 1 AS ret_1d FROM mv),
ft AS MATERIALIZED (SELECT *, CASE WHEN count(ret_1d) OVER a >= 10 THEN stddev_samp(ret_1d) OVER a END * sqrt(252) AS vol_20d, (close - CASE WHEN count(close) OVER b >= 100 THEN avg(close) OVER b END) / (CASE WHEN count(close) OVER b >= 100 THEN stddev_samp(close) OVER b END + 1e-8) AS trend_z,
 (volume - CASE WHEN count(volume) OVER a >= 10 THEN avg(volume) OVER a END) / (CASE WHEN count(volume) OVER a >= 10 THEN stddev_samp(volume) OVER a END + 1e-8) AS vol_z, vix / lag(vix) OVER (ORDER BY date) - 1 AS vix_change,
 close / lag(close, 63) OVER (ORDER BY date) - 1 AS momentum, close / max(close) OVER (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) - 1 AS drawdown FROM f0
 WINDOW a AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), b AS (ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))"""
NAMES = ["ret_1d", "vol_20d", "trend_z", "vol_z", "momentum", "drawdown"]


def market_vix(t: Tables):
    rows = t.market.join(t.fear, "date", "left")
    return rows.withColumn("vix", F.last("vix", ignorenulls=True).over(so_far(over("market_id"))))


def matrix(t: Tables):
    return G.warmed_up(G.features(t.market)).dropna(subset=NAMES).select("market_id", "date", *NAMES)


@query("market_with_vix", "J12", f"WITH {MV} SELECT market_id, date, close, volume, vix FROM mv")
def _(t):
    return market_vix(t).select("market_id", "date", "close", "volume", "vix")


@query("regime_features", "W25 F16", f"WITH {MV}, {FT} SELECT date, ret_1d, vol_20d, trend_z, vol_z, vix_change, momentum, drawdown FROM ft WHERE ret_1d IS NOT NULL AND vol_20d IS NOT NULL AND trend_z IS NOT NULL", r="ret_1d vol_20d trend_z vol_z vix_change momentum drawdown", digits=6)
def _(t):
    return G.warmed_up(G.features(market_vix(t))).select("date", "ret_1d", "vol_20d", "trend_z", "vol_z", "vix_change", "momentum", "drawdown")


@query("feature_matrix", "F17", f"WITH {MV}, {FT}, w AS (SELECT * FROM ft WHERE trend_z IS NOT NULL AND vol_20d IS NOT NULL) SELECT date, ret_1d, trend_z, momentum, drawdown FROM w WHERE momentum IS NOT NULL", r="ret_1d trend_z momentum drawdown", digits=6)
def _(t):
    df = G.features(t.market)
    return G.feature_matrix(df, G.chosen_features(df)).select("date", "ret_1d", "trend_z", "momentum", "drawdown")


TRAIN = "tr AS (SELECT * FROM ft WHERE trend_z IS NOT NULL AND vol_20d IS NOT NULL AND momentum IS NOT NULL AND date < DATE '1999-01-01')"


@query("scaler_fit", "R4", f"WITH {MV}, {FT}, {TRAIN} SELECT 'MKT' AS market_id, feature, avg(value) AS mean, stddev_pop(value) AS std FROM (UNPIVOT (SELECT ret_1d, vol_20d, trend_z, vol_z, momentum, drawdown FROM tr) ON COLUMNS(*) INTO NAME feature VALUE value) AS u GROUP BY feature", r="mean std", digits=8)
def _(t):
    return G.fit_scaler(matrix(t).where("date < DATE '1999-01-01'"), ["market_id"], NAMES)


@query("scaled_features", "R4 R5", f"WITH {MV}, {FT}, {TRAIN}, st AS (SELECT avg(trend_z) AS m1, stddev_pop(trend_z) AS s1, avg(momentum) AS m2, stddev_pop(momentum) AS s2 FROM tr) SELECT date, (trend_z - m1) / s1 AS z_trend_z, (momentum - m2) / s2 AS z_momentum, 0.0 AS z_vol_z FROM ft, st WHERE trend_z IS NOT NULL AND vol_20d IS NOT NULL AND momentum IS NOT NULL", r="z_trend_z z_momentum z_vol_z", digits=6)
def _(t):
    rows = matrix(t)
    scaler = G.fit_scaler(rows.where("date < DATE '1999-01-01'"), ["market_id"], NAMES)
    return G.scale(rows.drop("vol_z"), scaler, ["market_id"], NAMES).select("date", "z_trend_z", "z_momentum", "z_vol_z")


MODEL = G.Model(np.array([0.5, 0.3, 0.2]), np.array([[0.9, 0.08, 0.02], [0.05, 0.9, 0.05], [0.02, 0.08, 0.9]]), np.array([[-0.5, -1.0], [0.0, 0.0], [0.5, 1.0]]), np.array([[1.5, 0.6], [0.8, 0.4], [1.2, 0.5]]))
MEANS, VARS = MODEL.means.tolist(), MODEL.vars.tolist()
EMIT = ", ".join(f"-0.5 * (2 * ln(2 * pi()) + ln({VARS[k][0]}) + ln({VARS[k][1]}) + (x0 - ({MEANS[k][0]})) * (x0 - ({MEANS[k][0]})) / {VARS[k][0]} + (x1 - ({MEANS[k][1]})) * (x1 - ({MEANS[k][1]})) / {VARS[k][1]}) AS e{k}" for k in range(3))
XS = "xs AS MATERIALIZED (SELECT 'MKT' AS ticker, date, ret_1d * 100 AS x0, trend_z AS x1, row_number() OVER (ORDER BY date) AS n FROM ft WHERE trend_z IS NOT NULL AND vol_20d IS NOT NULL AND ret_1d IS NOT NULL)"


def emissions(t: Tables):
    rows = G.warmed_up(G.features(t.market)).select("market_id", "date", (F.col("ret_1d") * 100).alias("x0"), F.col("trend_z").alias("x1"))
    return rows.withColumn("log_emission", G.log_emission([F.col("x0"), F.col("x1")], MODEL))


@query("log_emission", "R6", f"WITH {MV}, {FT}, {XS} SELECT date, {EMIT} FROM xs", r="e0 e1 e2", digits=6)
def _(t):
    return emissions(t).select("date", *[F.col("log_emission")[k].alias(f"e{k}") for k in range(3)])


# Series of tickers: one sequence each.
TICKERS = """tf AS (SELECT ticker, date, close, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM bars),
tz AS (SELECT ticker, date, r * 100 AS x0, CASE WHEN count(r) OVER a >= 10 THEN stddev_samp(r) OVER a END AS v, (close - CASE WHEN count(close) OVER b >= 100 THEN avg(close) OVER b END) / (CASE WHEN count(close) OVER b >= 100 THEN stddev_samp(close) OVER b END + 1e-8) AS x1 FROM tf
 WINDOW a AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), b AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
xs AS MATERIALIZED (SELECT ticker, date, x0, x1, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM tz WHERE x0 IS NOT NULL AND x1 IS NOT NULL AND v IS NOT NULL)"""


def ticker_points(t: Tables):
    rows = G.features(t.bars.select("ticker", "date", "close", "volume"), "ticker")
    return G.warmed_up(rows).select("ticker", "date", (F.col("ret_1d") * 100).alias("x0"), F.col("trend_z").alias("x1"))


def ticker_emissions(t: Tables, model: G.Model = MODEL):
    return ticker_points(t).withColumn("log_emission", G.log_emission([F.col("x0"), F.col("x1")], model))


class Chain:
    """Check SQL of the recursions of a model over ``xs``, a step a bar. Tables are named with
    ``tag``: e (log densities), f (filtered), b (backward), s (smoothed), d (best), p (path)."""

    def __init__(self, model: G.Model, tag: str = ""):
        self.m, self.t, self.k = model, tag, range(model.k)

    def sum(self, terms) -> str:
        return " + ".join(terms)

    def emission(self) -> str:
        dims = range(self.m.means.shape[1])
        gap = lambda k, j: f"(x{j} - ({self.m.means[k][j]})) * (x{j} - ({self.m.means[k][j]})) / {self.m.vars[k][j]}"
        one = lambda k: f"-0.5 * ({len(dims)} * ln(2 * pi()) + {self.sum(f'ln({v})' for v in self.m.vars[k])} + {self.sum(gap(k, j) for j in dims)}) AS e{k}"
        return f"e{self.t} AS MATERIALIZED (SELECT *, {', '.join(map(one, self.k))} FROM xs)"

    def filtered(self) -> str:
        t, q = self.t, self.sum(f"q{k}" for k in self.k)
        start = ", ".join(f"{self.m.start[k]} * exp(e{k}) AS q{k}" for k in self.k)
        step = ", ".join(f"({self.sum(f'f.p{i} * {self.m.trans[i][j]}' for i in self.k)}) * exp(y.e{j}) AS q{j}" for j in self.k)
        share = ", ".join(f"q{k} / ({q}) AS p{k}" for k in self.k)
        return f"""{self.emission()}, f{t} AS (SELECT ticker, date, n, {share}, ln({q}) AS ll FROM (SELECT *, {start} FROM e{t} WHERE n = 1) AS z
UNION ALL SELECT ticker, date, n, {share}, ll + ln({q}) FROM (SELECT y.ticker, y.date, y.n, f.ll, {step} FROM f{t} AS f JOIN e{t} AS y ON y.ticker = f.ticker AND y.n = f.n + 1) AS z)"""

    def smoothed(self) -> str:
        t, q, ps = self.t, self.sum(f"q{k}" for k in self.k), self.sum(f"f.p{k} * b.b{k}" for k in self.k)
        last = ", ".join(f"CAST(1 AS DOUBLE) / {self.m.k} AS b{k}" for k in self.k)
        step = ", ".join(f"{self.sum(f'{self.m.trans[i][j]} * exp(y.e{j}) * b.b{j}' for j in self.k)} AS q{i}" for i in self.k)
        return f"""{self.filtered()}, b{t} AS (SELECT ticker, max(n) AS n, {last} FROM e{t} GROUP BY ticker
UNION ALL SELECT ticker, n, {', '.join(f'q{k} / ({q})' for k in self.k)} FROM (SELECT b.ticker, b.n - 1 AS n, {step} FROM b{t} AS b JOIN e{t} AS y ON y.ticker = b.ticker AND y.n = b.n WHERE b.n > 1) AS z),
s{t} AS (SELECT f.ticker, f.date, f.n, f.ll, {', '.join(f'f.p{k}' for k in self.k)}, {', '.join(f'b.b{k}' for k in self.k)}, {', '.join(f'f.p{k} * b.b{k} / ({ps}) AS g{k}' for k in self.k)} FROM f{t} AS f JOIN b{t} AS b ON b.ticker = f.ticker AND b.n = f.n)"""

    def path(self) -> str:
        t = self.t
        log = lambda v: f"ln({v})"
        start = ", ".join(f"{log(self.m.start[k])} + e{k} AS d{k}" for k in self.k)
        way = lambda i, j: f"d.d{i} + {log(self.m.trans[i][j])}"
        step = ", ".join(f"greatest({', '.join(way(i, j) for i in self.k)}) + y.e{j} AS d{j}" for j in self.k)
        back = ", ".join(f"CASE {' '.join(f'WHEN {way(i, j)} = greatest({chr(44).join(way(x, j) for x in self.k)}) THEN {i}' for i in self.k)} END AS w{j}" for j in self.k)
        none = ", ".join(f"CAST(NULL AS INT) AS w{k}" for k in self.k)
        best = " ".join(f"WHEN d{k} = greatest({', '.join(f'd{x}' for x in self.k)}) THEN {k}" for k in self.k)
        return f"""{self.emission()}, d{t} AS (SELECT ticker, date, n, {start}, {none} FROM e{t} WHERE n = 1 UNION ALL SELECT y.ticker, y.date, y.n, {step}, {back} FROM d{t} AS d JOIN e{t} AS y ON y.ticker = d.ticker AND y.n = d.n + 1),
dm AS MATERIALIZED (SELECT *, max(n) OVER (PARTITION BY ticker) AS z FROM d{t}), p{t} AS (SELECT ticker, n, CAST(CASE {best} END AS INT) AS path FROM dm WHERE n = z
UNION ALL SELECT p.ticker, p.n - 1, CASE p.path {' '.join(f'WHEN {k} THEN y.w{k}' for k in self.k)} END FROM p{t} AS p JOIN dm AS y ON y.ticker = p.ticker AND y.n = p.n WHERE p.n > 1)"""


CHAIN = Chain(MODEL)


@query("filtered_posterior", "R7 X3", f"WITH {TICKERS}, {CHAIN.filtered()} SELECT ticker, date, p0, p1, p2, ll FROM f", r="p0 p1 p2 ll", digits=6, recursive=True)
def _(t):
    d = G.decode(ticker_emissions(t), MODEL, "ticker", whole=False)
    return d.select("ticker", "date", *[F.col("filtered")[k].alias(f"p{k}") for k in range(3)], F.col("log_likelihood").alias("ll"))


@query("sequence_score", "R10", f"WITH {TICKERS}, {CHAIN.filtered()} SELECT ticker, max_by(ll, n) AS log_likelihood, count(*) AS n_obs FROM f GROUP BY ticker", r="log_likelihood", digits=4, recursive=True)
def _(t):
    return G.score(G.decode(ticker_emissions(t), MODEL, "ticker", whole=False), "ticker")


@query("smoothed_posterior", "R8", f"WITH {TICKERS}, {CHAIN.smoothed()} SELECT ticker, date, g0 AS p0, g1 AS p1, g2 AS p2 FROM s", r="p0 p1 p2", digits=6, recursive=True)
def _(t):
    d = G.decode(ticker_emissions(t), MODEL, "ticker")
    return d.select("ticker", "date", *[F.col("smoothed")[k].alias(f"p{k}") for k in range(3)])


@query("most_likely_path", "R9", f"WITH {TICKERS}, {CHAIN.path()} SELECT p.ticker, y.date, p.path FROM p JOIN dm AS y ON y.ticker = p.ticker AND y.n = p.n", recursive=True)
def _(t):
    return G.decode(ticker_emissions(t), MODEL, "ticker").select("ticker", "date", "path")


LABEL = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'crash' WHEN p1 >= p2 THEN 'neutral' ELSE 'bull' END"


@query("classify_regimes", "R14 W34", f"""WITH {TICKERS}, {CHAIN.filtered()}, lb AS (SELECT ticker, date, greatest(p0, p1, p2) AS confidence, {LABEL} AS l FROM f),
lg AS (SELECT *, lag(l, 1) OVER w AS l1, lag(l, 2) OVER w AS l2, lag(l, 3) OVER w AS l3 FROM lb WINDOW w AS (PARTITION BY ticker ORDER BY date)) SELECT ticker, date, l AS regime_label, confidence, coalesce(l = l1 AND l = l2 AND l = l3 AND l3 IS NOT NULL, false) AS is_stable,
CASE WHEN l3 IS NULL THEN 1.0 ELSE (CAST(l1 <> l2 AS INT) + CAST(l2 <> l3 AS INT)) / 2 END AS transition_rate FROM lg""", r="confidence transition_rate", digits=6, recursive=True)
def _(t):
    c = G.classify(G.decode(ticker_emissions(t), MODEL, "ticker", whole=False), [0, 1, 2], ["crash", "neutral", "bull"], "ticker")
    return c.select("ticker", "date", "regime_label", "confidence", "is_stable", "transition_rate")


TWO = G.Model(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[-0.5, -1.0], [0.5, 1.0]]), np.array([[1.5, 0.6], [1.2, 0.5]]))


def fixed(t: Tables, models: list[G.Model], n: str = "n_obs"):
    """(ticker, k, restart, n, parameters): every ticker with each of the models."""
    rows = [(m.k, 0, *[np.ravel(x).tolist() for x in (m.start, m.trans, m.means, m.vars)]) for m in models]
    own = t.spark.createDataFrame(rows, f"k int, restart int, {chain.PARTS}")
    points = ticker_points(t).groupBy("ticker").agg(F.count(F.lit(1)).alias(n))
    every = points.withColumn("k", F.explode(F.array(*[F.lit(m.k) for m in models])))
    return every.join(F.broadcast(own), "k").select("ticker", "k", "restart", n, "start", "trans", "means", "vars")


def one_step(t: Tables, models: list[G.Model]):
    """Models of every ticker after one step of the fit from the given ones."""
    rows = ticker_points(t).select("ticker", "date", F.array("x0", "x1").alias("x"))
    return chain.fitted(rows, ["ticker"], ["ticker"], "x", [m.k for m in models], iterations=1, models=fixed(t, models, "n"))


SECOND = Chain(TWO, "2")


@query("fit_step", "R11", f"""WITH {TICKERS}, {SECOND.smoothed()}, g AS (SELECT s2.*, x0, x1 FROM s2 JOIN xs ON xs.ticker = s2.ticker AND xs.n = s2.n),
w AS (SELECT s.ticker, {', '.join(f's.p{i} * {TWO.trans[i][j]} * exp(y.e{j}) * q.b{j} AS v{i}{j}' for i in range(2) for j in range(2))} FROM s2 AS s JOIN e2 AS y ON y.ticker = s.ticker AND y.n = s.n + 1 JOIN b2 AS q ON q.ticker = s.ticker AND q.n = s.n + 1),
c AS (SELECT ticker, {', '.join(f'sum(v{i}{j} / (v00 + v01 + v10 + v11)) + 1e-6 AS c{i}{j}' for i in range(2) for j in range(2))} FROM w GROUP BY ticker),
a AS (SELECT ticker, unnest([0, 1]) AS state, max_by(ll, n) AS log_likelihood, [max_by(g0, -n), max_by(g1, -n)] AS g1st, [sum(g0), sum(g1)] AS w, [sum(g0 * x0), sum(g1 * x0)] AS m0, [sum(g0 * x1), sum(g1 * x1)] AS m1, [sum(g0 * x0 * x0), sum(g1 * x0 * x0)] AS q0, [sum(g0 * x1 * x1), sum(g1 * x1 * x1)] AS q1 FROM g GROUP BY ticker)
SELECT a.ticker, CAST(state AS INT) AS state, log_likelihood, g1st[state + 1] AS start, CASE state WHEN 0 THEN c00 / (c00 + c01) ELSE c11 / (c10 + c11) END AS stay, m0[state + 1] / w[state + 1] AS mean0, m1[state + 1] / w[state + 1] AS mean1,
q0[state + 1] / w[state + 1] - (m0[state + 1] / w[state + 1]) * (m0[state + 1] / w[state + 1]) AS var0, q1[state + 1] / w[state + 1] - (m1[state + 1] / w[state + 1]) * (m1[state + 1] / w[state + 1]) AS var1 FROM a JOIN c ON c.ticker = a.ticker""", r="log_likelihood start stay mean0 mean1 var0 var1", digits=4, recursive=True)
def _(t):
    """One step of the fit, a model per ticker, from fixed parameters."""
    m = one_step(t, [TWO]).withColumn("state", F.explode(F.array(F.lit(0), F.lit(1))))
    at = lambda c, i: F.col(c)[i]
    s = F.col("state")
    return m.select("ticker", "state", "log_likelihood", at("start", s).alias("start"), at("trans", 3 * s).alias("stay"), *[at("means", 2 * s + j).alias(f"mean{j}") for j in (0, 1)], *[at("vars", 2 * s + j).alias(f"var{j}") for j in (0, 1)])


@query("pooled_fit", "R11")
def _(t):
    """Three states over all tickers' return series at once."""
    rows = M.daily_returns(t.bars.select("ticker", "date", F.col("close").alias("nav")), "ticker").where("ret IS NOT NULL").select("ticker", "date", (F.col("ret") * 100).alias("x"), F.lit("all").alias("pool"))
    best = G.fit_models(rows, ["x"], [3], ["pool"], "ticker")
    states = F.array_sort(F.arrays_zip("means", "vars"))
    out = best.select(F.posexplode(states).alias("rank", "s"), "log_likelihood")
    return out.select(F.col("rank"), F.bround("s.means", 4).alias("mean"), F.bround("s.vars", 4).alias("var"), F.bround("log_likelihood", 3).alias("log_likelihood"))


CANDIDATES = f"""{TICKERS}, {SECOND.filtered()}, {Chain(MODEL, '3').filtered()}, fi AS (SELECT ticker, 2 AS k, max_by(ll, n) AS log_likelihood, count(*) AS n_obs FROM f2 GROUP BY ticker UNION ALL SELECT ticker, 3, max_by(ll, n), count(*) FROM f3 GROUP BY ticker),
ic AS (SELECT *, -2 * log_likelihood + (k * (k - 1) + (k - 1) + 2 * k * 2) * ln(n_obs) AS bic, -2 * log_likelihood + 2 * (k * (k - 1) + (k - 1) + 2 * k * 2) AS aic FROM fi)"""


def candidates(t: Tables):
    """Two fixed models per ticker with their own likelihoods."""
    return one_step(t, [TWO, MODEL]).withColumnRenamed("n", "n_obs").withColumn("n_features", F.lit(2))


@query("model_selection", "R12", f"WITH {CANDIDATES} SELECT ticker, CAST(min_by(k, bic) AS INT) AS k, min(bic) AS bic FROM ic GROUP BY ticker", r="bic", recursive=True)
def _(t):
    return G.select_model(candidates(t), ["ticker"])


@query("information_criteria", "R12", f"WITH {CANDIDATES} SELECT ticker, CAST(k AS INT) AS k, bic, aic FROM ic", r="bic aic", digits=2, recursive=True)
def _(t):
    return G.information_criteria(candidates(t)).select("ticker", "k", "bic", "aic")


@query("fitted_selection", "R11 R12")
def _(t):
    """Models of two to four states fitted per ticker, all at once, and the best of each by BIC."""
    fits = G.fit_models(ticker_points(t), ["x0", "x1"], [2, 3, 4], ["ticker"], "ticker", iterations=10, restarts=1)
    return G.select_model(fits, ["ticker"]).withColumn("bic", F.bround("bic", 2))


@query("state_labels", "R13", """WITH r AS (SELECT ticker, CAST(month(date) % 5 AS INT) AS state, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM bars), g AS (SELECT ticker, state, round_even(avg(ret), 12) AS m FROM r GROUP BY ticker, state),
k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY m, state) AS n FROM g) SELECT ticker, state, list_extract(['crash', 'bear', 'neutral', 'bull', 'euphoria'], n) AS label FROM k""")
def _(t):
    rows = M.daily_returns(t.bars.select("ticker", "date", F.col("close").alias("nav")), "ticker").withColumn("state", (F.month("date") % 5).cast("int"))
    return G.rank_states(rows, ["ticker"], 5).select("ticker", "state", "label")


@query("regime_stability", "W34", """WITH lg AS (SELECT date, regime_label AS l, lag(regime_label, 1) OVER w AS l1, lag(regime_label, 2) OVER w AS l2, lag(regime_label, 3) OVER w AS l3 FROM regime_daily WINDOW w AS (ORDER BY date))
SELECT date, coalesce(l = l1 AND l = l2 AND l = l3, false) AS is_stable, CASE WHEN l3 IS NULL THEN 1.0 ELSE (CAST(l1 <> l2 AS INT) + CAST(l2 <> l3 AS INT)) / 2 END AS transition_rate FROM lg""", r="transition_rate")
def _(t):
    return G.stability(t.regime_daily).select("date", "is_stable", "transition_rate")


@query("regime_transitions", "W35", "SELECT date, p AS from_label, regime_label AS to_label, confidence FROM (SELECT *, lag(regime_label) OVER (ORDER BY date) AS p FROM regime_daily) AS q WHERE p <> regime_label")
def _(t):
    return G.transitions(t.regime_daily).select("date", "from_label", "to_label", "confidence")


@query("combine_first", "J21", "SELECT coalesce(n.date, o.date) AS date, coalesce(n.close, o.vix) AS close, coalesce(n.volume, o.vix * 2) AS volume FROM (SELECT date, CASE WHEN volume > 600 THEN close END AS close, volume FROM market) AS n FULL OUTER JOIN fear AS o ON o.date = n.date")
def _(t):
    new = t.market.select("date", F.when(F.col("volume") > 600, F.col("close")).alias("close"), "volume")
    old = t.fear.select("date", F.col("vix").alias("close"), (F.col("vix") * 2).alias("volume"))
    return joins.combine_first(new, old, ["date"])
