"""Regime features, scaling, hidden-state inference, labels and stability.

A sequence is one market (or one market and window): one row per date. Recursions along a
sequence are scans over its blocks (``chain``), so blocks of all sequences run in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline import config as cfg
from barline.functions.series import full, over, trailing
from barline.operators import chain

TINY = chain.TINY
CORE = ["ret_1d", "vol_20d", "trend_z"]


# ---- features ----
def features(market: DataFrame, key: str = "market_id", c: cfg.Features = cfg.FEATURES) -> DataFrame:
    """Causal features on (key, date, close, volume[, vix]); the warm-up rows are kept."""
    w = over(key)
    close, volume = F.col("close"), F.col("volume")
    half = lambda n: n // 2
    df = market.withColumn("ret_1d", F.try_divide(close, F.lag("close").over(w)) - 1)
    df = df.withColumns({
        "vol_20d": full(F.col("ret_1d"), w, c.vol_window, F.stddev_samp, half(c.vol_window)) * math.sqrt(252),
        "trend_z": (close - full(close, w, c.trend_window, F.avg, half(c.trend_window))) / (full(close, w, c.trend_window, F.stddev_samp, half(c.trend_window)) + 1e-8),
        "vol_z": (volume - full(volume, w, c.vol_window, F.avg, half(c.vol_window))) / (full(volume, w, c.vol_window, F.stddev_samp, half(c.vol_window)) + 1e-8),
        "vix_level": F.col("vix") if "vix" in market.columns else F.lit(None).cast("double"),
        "vix_change": F.try_divide(F.col("vix"), F.lag("vix").over(w)) - 1 if "vix" in market.columns else F.lit(None).cast("double"),
    })
    if c.use_momentum:
        df = df.withColumn("momentum", F.try_divide(close, F.lag("close", c.momentum_window).over(w)) - 1)
    if c.use_drawdown:
        df = df.withColumn("drawdown", F.try_divide(close, F.max("close").over(trailing(w, 252))) - 1)
    return df


def warmed_up(df: DataFrame) -> DataFrame:
    return df.dropna(subset=CORE)


def chosen_features(df: DataFrame, c: cfg.Features = cfg.FEATURES) -> list[str]:
    """Feature names to use. One boolean comes back from Spark: is VIX never missing."""
    vix_ok = df.agg(F.bool_and(F.col("vix_level").isNotNull()).alias("ok")).first()["ok"]
    return ["ret_1d", "vol_20d", "trend_z", "vol_z"] + (["vix_level", "vix_change"] if vix_ok else []) + (
        ["momentum"] if c.use_momentum else []) + (["drawdown"] if c.use_drawdown else [])


def feature_matrix(df: DataFrame, names: Sequence[str], key: str = "market_id", least: int = cfg.FEATURES.min_history_bars) -> DataFrame:
    """Complete rows of the chosen features; the job fails where a sequence has too few."""
    rows = warmed_up(df).dropna(subset=list(names)).select(key, "date", *names)
    short = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < least)
    bad = short.select(F.raise_error(F.concat(F.lit("too few bars: "), F.col("_n").cast("string"))).cast("string").alias(key))
    return rows.unionByName(bad, allowMissingColumns=True)


def fit_scaler(rows: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Mean and population deviation per feature, in long form, from training rows only."""
    long = rows.unpivot(list(keys), list(names), "feature", "value")
    return long.groupBy(*keys, "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def scale(rows: DataFrame, scaler: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """z-scores by feature NAME. A feature the rows lack, or a missing cell, takes the
    training mean and so becomes 0. A constant feature is divided by one."""
    p = scaler.groupBy(*keys).agg(*[F.max(F.when(F.col("feature") == n, F.struct("mean", "std"))).alias(f"_s_{n}") for n in names])
    df = rows.join(p, list(keys))
    value = lambda n: F.coalesce(F.col(n), F.col(f"_s_{n}.mean")) if n in rows.columns else F.col(f"_s_{n}.mean")
    width = lambda n: F.when(F.col(f"_s_{n}.std") == 0, 1.0).otherwise(F.col(f"_s_{n}.std"))
    return df.withColumns({f"z_{n}": (value(n) - F.col(f"_s_{n}.mean")) / width(n) for n in names}).drop(*[f"_s_{n}" for n in names])


# ---- model ----
@dataclass(frozen=True)
class Model:
    """K x D parameters: small, so they live on the driver and travel in the closure."""

    start: np.ndarray
    trans: np.ndarray
    means: np.ndarray
    vars: np.ndarray

    @property
    def k(self) -> int:
        return len(self.start)


def log_emission(x: Sequence[Column], model: Model) -> Column:
    """Array of diagonal Gaussian log densities, one per state, as a plain expression."""
    def one(k: int) -> Column:
        const = len(x) * math.log(2 * math.pi) + float(np.log(model.vars[k]).sum())
        maha = sum(((c - float(m)) * (c - float(m)) / float(v) for c, m, v in zip(x, model.means[k], model.vars[k])), F.lit(0.0))
        return -0.5 * (const + maha)

    return F.array(*[one(k) for k in range(model.k)])


def forward_step(prev: np.ndarray, log_trans: np.ndarray, emission: np.ndarray) -> np.ndarray:
    return chain.lse((prev[:, None] + log_trans).T) + emission


def decode(rows: DataFrame, model: Model, key: str = "market_id", emission: str = "log_emission", whole: bool = True) -> DataFrame:
    """Filtered and smoothed posteriors, most likely path, and running log-likelihood, by
    scans over blocks of each series (see ``chain``).

    ``filtered`` is causal; ``smoothed`` and ``path`` look ahead, are for research, and are
    left out where ``whole`` is false. The blocks are landed when this is called.
    """
    numbers = lambda a: F.array(*[F.lit(float(v)) for v in np.ravel(a)])
    blocks = chain.packed(rows, [key], emission).withColumns({"start": numbers(model.start), "trans": numbers(model.trans)})
    return chain.decoded(blocks, [key], whole)


def score(decoded: DataFrame, key: str = "market_id") -> DataFrame:
    return decoded.groupBy(key).agg(F.max_by("log_likelihood", "date").alias("log_likelihood"), F.count(F.lit(1)).alias("n_obs"))


def fit_model(rows: DataFrame, names: Sequence[str], k: int, key: str = "market_id", iterations: int = 100, restarts: int = 5, seed: int = 42, tol: float = 1e-4) -> tuple[Model, float]:
    """One model over many sequences: the best restart of ``chain.fitted`` with a single group."""
    data = rows.select(F.lit(0).alias("_all"), key, "date", F.array(*names).alias("x"))
    m = chain.best_restart(chain.fitted(data, ["_all"], [key], "x", [k], iterations, max(1, restarts), seed, tol), ["_all"]).first()
    shaped = lambda c: np.array(m[c]).reshape(k, -1)
    return Model(np.array(m["start"]), shaped("trans"), shaped("means"), shaped("vars")), float(m["log_likelihood"])


def fit_models(rows: DataFrame, names: Sequence[str], ks: Sequence[int], group: Sequence[str], key: str = "market_id", **how) -> DataFrame:
    """The best restart for every group and number of states, with ``n_obs`` and ``n_features``,
    as ``select_model`` takes them."""
    data = rows.select(*dict.fromkeys([*group, key]), "date", F.array(*names).alias("x"))
    best = chain.best_restart(chain.fitted(data, group, [key], "x", ks, **how), group)
    return best.withColumnRenamed("n", "n_obs").withColumn("n_features", F.lit(len(names)))


def information_criteria(fits: DataFrame) -> DataFrame:
    """BIC and AIC of (k, log_likelihood, n_obs, n_features) rows."""
    k, ll = F.col("k"), F.col("log_likelihood")
    p = k * (k - 1) + (k - 1) + 2 * k * F.col("n_features")
    return fits.withColumns({"n_params": p, "bic": -2 * ll + p * F.log(F.col("n_obs").cast("double")), "aic": -2 * ll + 2 * p})


def select_model(fits: DataFrame, keys: Sequence[str], criterion: str = "bic") -> DataFrame:
    """Lowest criterion per key; the smaller model wins a tie."""
    return information_criteria(fits).groupBy(*keys).agg(F.min_by("k", F.struct(criterion, "k")).alias("k"), F.min(criterion).alias(criterion))


def stored_models(scaler: DataFrame, keys: Sequence[str], names: Sequence[str], model: Model, ranks: Sequence[int], labels: Sequence[str]) -> DataFrame:
    """A row per sequence: its scaler by feature name, in the order of ``names``, and a model's
    parameters, ranks and labels, as the streaming update takes them."""
    numbers = lambda a: F.array(*[F.lit(float(v)) for v in np.ravel(a)])
    named = lambda c: F.array(*[F.max(F.when(F.col("feature") == n, F.col(c))) for n in names])
    rows = scaler.groupBy(*keys).agg(named("mean").alias("mean"), named("std").alias("std"))
    return rows.select(*keys, F.array(*map(F.lit, names)).alias("names"), "mean", "std", *[numbers(getattr(model, n)).alias(n) for n in ("start", "trans", "means", "vars")],
                       F.array(*[F.lit(int(r)) for r in ranks]).alias("ranks"), F.array(*map(F.lit, labels)).alias("labels"))


# ---- labels ----
def rank_states(rows: DataFrame, keys: Sequence[str], k: int, ret: str = "ret", state: str = "state") -> DataFrame:
    """Label of each state by ascending mean return; a state without rows counts as 0."""
    labels = F.array(*[F.lit(x) for x in cfg.REGIME_LABELS.get(k, [f"regime_{i}" for i in range(k)])])
    seen = rows.groupBy(*keys, state).agg(F.avg(ret).alias("mean_ret"))
    every = rows.select(*keys).distinct().withColumn(state, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    means = every.join(seen, [*keys, state], "left").withColumn("mean_ret", F.coalesce("mean_ret", F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("mean_ret", state))
    return means.withColumn("rank", place - 1).withColumn("label", F.element_at(labels, F.col("rank") + 1))


def stability(states: DataFrame, keys: Sequence[str] = (), label: str = "regime_label", bars: int = 3) -> DataFrame:
    """Whether the previous ``bars`` labels all equal the current one, and their share of
    changes. The current bar is not part of the history; too short a history is unstable."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("date")
    past = [F.lag(label, i).over(w) for i in range(1, bars + 1)]
    same = past[0] == F.col(label)
    for p in past[1:]:
        same = same & (p == F.col(label))
    changes = sum(((a != b).cast("int") for a, b in zip(past[1:], past[2:])), (past[0] != past[1]).cast("int"))
    ready = past[-1].isNotNull()
    return states.withColumns({"is_stable": F.coalesce(ready & same, F.lit(False)), "transition_rate": F.when(ready, changes / (bars - 1)).otherwise(1.0)})


def transitions(states: DataFrame, keys: Sequence[str] = (), label: str = "regime_label") -> DataFrame:
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("date")
    return states.withColumn("from_label", F.lag(label).over(w)).where(F.col("from_label") != F.col(label)).withColumnRenamed(label, "to_label")


def classify(decoded: DataFrame, ranks: Sequence[int], labels: Sequence[str], key: str = "market_id") -> DataFrame:
    """Causal regime per bar: posteriors in rank order, the largest one, and stability."""
    ordered = F.array(*[F.col("filtered")[int(s)] for s in np.argsort(ranks)])
    df = decoded.withColumn("posteriors", ordered).withColumn("confidence", F.array_max("posteriors"))
    df = df.withColumn("regime_index", F.array_position("posteriors", F.col("confidence")).cast("int") - 1)
    df = df.withColumn("regime_label", F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("regime_index") + 1))
    return stability(df.drop("filtered", "smoothed", "path"), [key])
