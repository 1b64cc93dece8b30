import datetime as dt

import numpy as np
import pandas as pd
import pytest

from barline import config as cfg
from barline.operators import risk as R

RETURNS = "ticker string, date date, ret double"


def day(i):
    return dt.date(2021, 1, 1) + dt.timedelta(days=i)


def sides(spark, n=90, candidates=9, holdings=5, seed=4):
    """Random returns with gaps, NaN, a constant series, and series with few or no common days."""
    rng = np.random.default_rng(seed)
    market = rng.normal(0, 0.02, n)
    out = []
    for side, count in (("c", candidates), ("h", holdings)):
        rows = []
        for j in range(count):
            ret = market * rng.uniform(-1, 1) + rng.normal(0, 0.02, n)
            for i, r in enumerate(ret):
                if rng.random() < 0.2:
                    r = [None, float("nan")][i % 2]
                rows.append((f"{side}{j}", day(i), r if r is None else float(r)))
        rows += [(f"{side}flat", day(i), 0.01) for i in range(n)]
        rows += [(f"{side}late", day(n - 10 + i), 0.01 * (-1) ** i) for i in range(40)]
        out.append(rows)
    return out, [spark.createDataFrame(rows, RETURNS) for rows in out]


def brute(c, h, least):
    frames = [pd.DataFrame(rows, columns=["ticker", "date", "ret"]).pivot(index="date", columns="ticker", values="ret") for rows in (c, h)]
    out = {}
    for a in frames[0]:
        rhos = []
        for b in frames[1]:
            both = pd.concat([frames[0][a].rename("a"), frames[1][b].rename("b")], axis=1).dropna()
            if len(both) >= least and both["a"].nunique() > 1 and both["b"].nunique() > 1:
                rhos.append(both["a"].corr(both["b"]))
        out[a] = (max([0.0, *rhos]), len(rhos)) if rhos else (None, None)
    return out


def test_block_products_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "GRAM_SIDE", 3)  # several groups on both sides
    (c, h), (left, right) = sides(spark)
    got = {r["ticker"]: r for r in R.max_correlation(left, right).collect()}
    want = brute(c, h, cfg.CORRELATION.min_overlap)
    assert got.keys() == want.keys() and got["cflat"]["max_rho"] is None and got["cflat"]["corr_mult"] == 1
    for t, (rho, n) in want.items():
        assert got[t]["n_pairs"] == n and got[t]["max_rho"] == (None if rho is None else pytest.approx(rho, abs=1e-10))


def test_only_the_days_asked_for_count(spark):
    (c, h), (left, right) = sides(spark)
    got = {r["ticker"]: r["max_rho"] for r in R.max_correlation(left, right, as_of=str(day(80)), days=45).collect()}
    want = brute(*[[r for r in rows if day(35) <= r[1] <= day(80)] for rows in (c, h)], cfg.CORRELATION.min_overlap)
    assert {t: r for t, r in got.items() if r is not None} == {t: pytest.approx(r, abs=1e-10) for t, (r, _) in want.items() if r is not None}


def test_a_row_per_pair_and_block_of_days(spark):
    _, (left, right) = sides(spark)
    moments = R.pair_moments(left, right).collect()
    assert len(moments) == len({(r["ticker"], r["holding"]) for r in moments})
    assert next(r["n"] for r in moments if (r["ticker"], r["holding"]) == ("cflat", "hflat")) == 90


def test_no_holdings_and_no_candidates(spark):
    _, (left, right) = sides(spark)
    none = spark.createDataFrame([], RETURNS)
    assert {r["corr_mult"] for r in R.max_correlation(left, none).collect()} == {1.0}
    assert R.max_correlation(none, right).count() == 0
