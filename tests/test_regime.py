import datetime as dt
from itertools import product

import numpy as np
import pytest

from pyspark.sql import functions as F

from barline.operators import chain
from barline.operators import regime as G

MODEL = G.Model(np.array([0.6, 0.4]), np.array([[0.8, 0.2], [0.3, 0.7]]), np.array([[-1.0], [1.0]]), np.array([[1.0], [0.5]]))
X = np.array([-1.2, 0.3, 1.1, 0.9, -0.7])


def emission(x):
    return -0.5 * (np.log(2 * np.pi) + np.log(MODEL.vars[:, 0]) + (x - MODEL.means[:, 0]) ** 2 / MODEL.vars[:, 0])


def joint(path):
    p = np.log(MODEL.start[path[0]]) + emission(X[0])[path[0]]
    for t in range(1, len(X)):
        p += np.log(MODEL.trans[path[t - 1], path[t]]) + emission(X[t])[path[t]]
    return p


@pytest.fixture(scope="module")
def decoded(spark):
    df = spark.createDataFrame([("M", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(X)], "market_id string, date date, x double")
    return G.decode(df.withColumn("log_emission", G.log_emission([F.col("x")], MODEL)), MODEL).orderBy("date").toPandas()


def test_decoding_equals_enumeration(decoded):
    paths = list(product([0, 1], repeat=len(X)))
    logs = np.array([joint(p) for p in paths])
    total = np.log(np.exp(logs).sum())
    assert decoded["log_likelihood"].iloc[-1] == pytest.approx(total)
    assert tuple(decoded["path"]) == paths[int(logs.argmax())]
    smooth = [sum(np.exp(l - total) for p, l in zip(paths, logs) if p[t] == 1) for t in range(len(X))]
    assert np.allclose([s[1] for s in decoded["smoothed"]], smooth)
    assert np.allclose([sum(f) for f in decoded["filtered"]], 1.0)


def plain_chain(e, start, trans):
    """Filtered, smoothed, path and running likelihood by loops over bars."""
    n, k = e.shape
    a, b, d, back = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k), int)
    a[0] = d[0] = np.log(start) + e[0]
    for t in range(1, n):
        a[t] = np.logaddexp.reduce(a[t - 1][:, None] + np.log(trans), axis=0) + e[t]
        back[t] = (d[t - 1][:, None] + np.log(trans)).argmax(0)
        d[t] = (d[t - 1][:, None] + np.log(trans)).max(0) + e[t]
    for t in range(n - 2, -1, -1):
        b[t] = np.logaddexp.reduce(np.log(trans) + (e[t + 1] + b[t + 1])[None], axis=1)
    path = [int(d[-1].argmax())]
    for t in range(n - 1, 0, -1):
        path.append(int(back[t][path[-1]]))
    ll = np.logaddexp.reduce(a, axis=1)
    g = a + b
    return np.exp(a - ll[:, None]), np.exp(g - np.logaddexp.reduce(g, axis=1)[:, None]), path[::-1], ll


@pytest.mark.parametrize("block", [3, 64])
def test_scans_equal_loops_over_bars(spark, block):
    rng = np.random.default_rng(4)
    start, trans = np.array([0.5, 0.3, 0.2]), np.array([[0.9, 0.1, 0.0], [0.05, 0.9, 0.05], [1e-9, 0.1, 0.9]])
    series = {f"s{i}": rng.normal(size=(n, 3)) * 30 for i, n in enumerate([1, 2, 3, 64, 65, 200])}
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=t), e.tolist()) for s, es in series.items() for t, e in enumerate(es)]
    numbers = lambda a: F.array(*[F.lit(float(v)) for v in np.ravel(a)])
    df = spark.createDataFrame(rows, "ticker string, date date, e array<double>")
    blocks = chain.packed(df, ["ticker"], "e", block=block).withColumns({"start": numbers(start), "trans": numbers(trans)})
    got, causal = chain.decoded(blocks, ["ticker"]).toPandas(), chain.decoded(blocks, ["ticker"], False).toPandas()
    for s, e in series.items():
        filtered, smoothed, path, ll = plain_chain(e, start, trans + 1e-300)
        one = got[got["ticker"] == s].sort_values("date")
        assert np.allclose(np.stack(one["filtered"]), filtered, atol=1e-9) and np.allclose(np.stack(one["smoothed"]), smoothed, atol=1e-9)
        assert one["path"].tolist() == path and np.allclose(one["log_likelihood"], ll)
        assert np.allclose(np.stack(causal[causal["ticker"] == s].sort_values("date")["filtered"]), filtered, atol=1e-9)


def test_a_null_inside_a_series_fails(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), None)], "ticker string, date date, e array<double>")
    with pytest.raises(Exception, match="null inside"):
        chain.packed(df, ["ticker"], "e")


def test_expected_counts_equal_enumeration(spark, monkeypatch):
    rows = [(0, s, dt.date(2020, 1, 1) + dt.timedelta(days=i), [float(v)]) for s in ("a", "b") for i, v in enumerate(X)]
    df = spark.createDataFrame(rows, "g int, s string, date date, x array<double>")
    model = spark.createDataFrame([(0, 2, 0, MODEL.start.tolist(), MODEL.trans.ravel().tolist(), MODEL.means.ravel().tolist(), MODEL.vars.ravel().tolist())], f"g int, k int, restart int, {chain.PARTS}")
    found = np.array(chain.expectation(chain.packed(df, ["g", "s"], "x", block=2), model, ["g"], ["s"]).first()["counts"])
    paths = list(product([0, 1], repeat=len(X)))
    z = np.logaddexp.reduce([joint(p) for p in paths])
    xi, gamma = np.zeros((2, 2)), np.zeros((len(X), 2))
    for p in paths:
        q = np.exp(joint(p) - z)
        gamma[range(len(X)), p] += q
        for a, b in zip(p, p[1:]):
            xi[a, b] += q
    want = np.concatenate([[z], gamma[0], xi.ravel(), gamma.sum(0), gamma.T @ X, gamma.T @ X**2])
    assert np.allclose(found, 2 * want)


def test_every_group_has_its_own_fit_and_the_number_of_states_follows_it(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s, levels in (("two", [-3, 3]), ("three", [-6, 0, 6])):
        state = 0
        for i in range(400):
            state = state if rng.random() < 0.9 else int(rng.integers(len(levels)))
            rows.append((s, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(rng.normal(levels[state], 0.6)), 0.1 * float(rng.normal())))
    df = spark.createDataFrame(rows, "ticker string, date date, x double, y double")
    fits = G.fit_models(df, ["x", "y"], [2, 3, 4], ["ticker"], "ticker", iterations=12, restarts=2)
    picked = {r["ticker"]: r["k"] for r in G.select_model(fits, ["ticker"]).collect()}
    assert picked == {"two": 2, "three": 3}
    three = fits.where("ticker = 'three' and k = 3").first()
    assert np.allclose(sorted(three["means"][::2]), [-6, 0, 6], atol=0.3) and three["n_obs"] == 400


def test_pooled_fit_finds_two_levels(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s in range(4):
        state = 0
        for i in range(150):
            state = state if rng.random() < 0.95 else 1 - state
            rows.append((f"s{s}", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(rng.normal([-2, 2][state], 0.5))))
    df = spark.createDataFrame(rows, "market_id string, date date, x double")
    model, ll = G.fit_model(df, ["x"], 2, iterations=15, restarts=2)
    assert np.allclose(np.sort(model.means[:, 0]), [-2, 2], atol=0.2) and np.isfinite(ll)


def test_stability_excludes_the_current_bar(spark):
    labels = ["a", "a", "a", "b", "b", "b", "b"]
    df = spark.createDataFrame([(dt.date(2020, 1, i + 1), l) for i, l in enumerate(labels)], "date date, regime_label string")
    got = [(r["is_stable"], r["transition_rate"]) for r in G.stability(df).orderBy("date").collect()]
    assert got == [(False, 1.0)] * 3 + [(False, 0.0), (False, 0.5), (False, 0.5), (True, 0.0)]


def test_feature_matrix_refuses_thin_history(spark):
    df = spark.createDataFrame([("M", dt.date(2020, 1, 1) + dt.timedelta(days=i), 100.0 + i % 7, 10.0 + i % 3) for i in range(150)], "market_id string, date date, close double, volume double")
    f = G.features(df)
    with pytest.raises(Exception, match="too few bars"):
        G.feature_matrix(f, G.chosen_features(f)).collect()
