"""Multi-factor regression per portfolio with Newey-West errors.

Spark builds the moments (one partial aggregate per portfolio); only the small k x k
systems are solved in NumPy, batch by batch of portfolios.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from barline.functions.series import over

DOUBLES = ArrayType(DoubleType())


def with_excess(returns: DataFrame, factors: DataFrame, names: Sequence[str], risk_free: DataFrame | None = None) -> DataFrame:
    """Align on date, drop rows with a null, subtract the risk-free rate (missing is 0)."""
    rows = returns.join(factors.select("date", *names), "date").dropna(subset=["ret", *names])
    if risk_free is None:
        return rows
    return rows.join(risk_free.select("date", "rf"), "date", "left").withColumn("ret", F.col("ret") - F.coalesce("rf", F.lit(0.0))).drop("rf")


def _square(values: pd.Series) -> np.ndarray:
    m = np.stack(values.to_numpy())
    k = int(round(np.sqrt(m.shape[1])))
    return m.reshape(len(m), k, k)


@pandas_udf(DOUBLES)
def solve_normal(xtx: pd.Series, xty: pd.Series) -> pd.Series:
    """Coefficients of each normal system; null where it is singular."""
    out = []
    for a, b in zip(_square(xtx), np.stack(xty.to_numpy())):
        out.append(np.linalg.solve(a, b).tolist() if np.linalg.matrix_rank(a) == len(b) else None)
    return pd.Series(out)


@pandas_udf(DOUBLES)
def sandwich_errors(xtx: pd.Series, meat: pd.Series) -> pd.Series:
    inv = np.linalg.inv(_square(xtx))
    cov = inv @ _square(meat) @ inv
    return pd.Series(list(np.sqrt(np.maximum(np.einsum("nii->ni", cov), 0.0))))


def _cross(cols: Sequence[Column], other: Sequence[Column]) -> Column:
    return F.array(*[F.sum(a * b) for a in cols for b in other])


def fit(rows: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """OLS per key: coefficient array (intercept first), n, R2 and the X'X matrix."""
    x = [F.lit(1.0), *[F.col(c) for c in names]]
    y = F.col("ret")
    g = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_obs"), _cross(x, x).alias("_xtx"), _cross(x, [y]).alias("_xty"),
        (F.var_samp(y) * (F.count(y) - 1)).alias("_tss"),
    ).where(F.col("n_obs") >= len(names) + 2)
    return g.withColumn("_beta", solve_normal("_xtx", "_xty")).where("_beta IS NOT NULL").drop("_xty")


def attribute(rows: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Annualised alpha, betas, R2 and HAC t-statistics; zeros for keys that cannot be fitted."""
    model = fit(rows, key, names)
    terms = [F.lit(1.0), *[F.col(c) for c in names]]
    scored = rows.join(model.select(key, "n_obs", "_beta"), key)
    fitted = sum((F.col("_beta")[i] * t for i, t in enumerate(terms)), F.lit(0.0))
    scored = scored.withColumn("_e", F.col("ret") - fitted)
    k = len(terms)
    scored = scored.withColumns({f"_s{i}": F.col("_e") * t for i, t in enumerate(terms)})
    band = F.greatest(F.lit(1), F.floor(4 * F.pow(F.col("n_obs") / 100.0, F.lit(2.0 / 9.0)))).cast("int")
    # As many lags as the longest portfolio needs.
    lags = model.agg(F.max(band)).first()[0] or 1
    w = over(key)

    def carried(i: int) -> Column:
        """Bartlett-weighted sum of the earlier scores; the weight is zero beyond the bandwidth."""
        parts = [F.greatest(F.lit(0.0), 1.0 - F.lit(float(n)) / (F.col("_band") + 1)) * F.coalesce(F.lag(f"_s{i}", n).over(w), F.lit(0.0))
                 for n in range(1, lags + 1)]
        return sum(parts[1:], parts[0])

    scored = scored.withColumn("_band", band).withColumns({f"_q{i}": carried(i) for i in range(k)})
    s, q = [F.col(f"_s{i}") for i in range(k)], [F.col(f"_q{i}") for i in range(k)]
    meat = F.array(*[F.sum(s[i] * s[j] + s[i] * q[j] + s[j] * q[i]) for i in range(k) for j in range(k)])
    errors = scored.groupBy(key).agg(meat.alias("_meat"), F.sum(F.col("_e") * F.col("_e")).alias("_rss"))
    out = model.join(errors, key).withColumn("_se", sandwich_errors("_xtx", "_meat"))

    def tstat(i: int) -> Column:
        return F.when(F.col("_se")[i] > 0, F.col("_beta")[i] / F.col("_se")[i]).otherwise(0.0)

    betas = [c for i, n in enumerate(names, 1) for c in (F.bround(F.col("_beta")[i], 4).alias(f"beta_{n}"), F.bround(tstat(i), 3).alias(f"tstat_{n}"))]
    fitted_rows = out.select(
        key, F.bround(F.col("_beta")[0] * 252, 6).alias("alpha"), F.bround(F.col("_beta")[0] * 25200, 4).alias("alpha_pct"),
        F.bround(tstat(0), 3).alias("alpha_tstat"), F.bround(F.col("_se")[0] * 252, 6).alias("alpha_se"),
        F.bround(F.when(F.col("_tss") > 0, 1 - F.col("_rss") / F.col("_tss")).otherwise(0.0), 4).alias("r_squared"), *betas,
        "n_obs", (F.col("n_obs") < 30).alias("low_sample_warning"),
    )
    return rows.select(key).distinct().join(fitted_rows, key, "left").na.fill(0).na.fill(True, ["low_sample_warning"])
