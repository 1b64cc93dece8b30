"""Cases that the driver tables do not contain."""

import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.functions.series import ewm, rolling_means
from barline.operators import attribution, backtest, risk
from barline.sources import disclosures
from barline.streaming import stateless
from barline.streaming.run import available_now

JUMP = [1e6] * 5 + [100 + math.sin(i) for i in range(3000)]


@pytest.mark.parametrize("alpha", [2 / 201, 2 / 101, 1 / 14, 0.5, 0.95, 0.9999, 1.0])
def test_exponential_means_carry_the_whole_history(series, alpha):
    got = ewm(series(a=JUMP), [("close", "y", alpha)]).orderBy("date").toPandas()["y"]
    want = pd.Series(JUMP).ewm(alpha=alpha, adjust=False).mean()
    assert np.allclose(got, want, rtol=1e-9)


def test_series_with_unlike_decays_share_a_call(series):
    alphas = [0.001, 0.02, 0.3, 0.97]
    out = ewm(series(a=JUMP, b=JUMP[::-1]), [("close", f"y{i}", a) for i, a in enumerate(alphas)]).where("ticker = 'b'").orderBy("date").toPandas()
    for i, a in enumerate(alphas):
        assert np.allclose(out[f"y{i}"], pd.Series(JUMP[::-1]).ewm(alpha=a, adjust=False).mean(), rtol=1e-9)


def test_a_null_inside_a_series_fails(spark, series):
    df = series(a=[1.0, 2.0, 3.0, 4.0])
    holed = df.withColumn("close", F.when(F.dayofmonth("date") != 3, F.col("close")))
    for run in (lambda: ewm(holed, [("close", "y", 0.5)]), lambda: rolling_means(holed, "close", {"m": 2})):
        with pytest.raises(Exception, match="null inside"):
            run().collect()


def test_flat_series_have_equal_means(series):
    out = rolling_means(series(a=[10.1] * 1000), "close", {"m20": 20, "m50": 50, "m200": 200}).where("m200 IS NOT NULL")
    assert out.where("m20 <> m50 OR m50 <> m200 OR m20 <> 10.1").count() == 0


def test_windows_keep_a_day_that_a_short_month_clipped(spark):
    days = [(dt.date(2015, 1, 31) + dt.timedelta(days=i),) for i in range(4000)]
    got = [r["train_start"] for r in backtest.walk_windows(spark.createDataFrame(days, "date date")).orderBy("window_id").collect()]
    want, step = [dt.date(2015, 1, 31)], backtest.cfg.BACKTEST.step_months
    while len(want) < len(got):
        want.append((pd.Timestamp(want[-1]) + pd.DateOffset(months=step)).date())
    assert got == want


def test_a_reopened_position_starts_anew(spark):
    rows = [("A", 50.0, 1, 10, True, False), ("A", 90.0, 2, None, False, False), ("A", None, 3, None, None, True), ("A", 60.0, 4, 7, False, False), ("B", 5.0, 1, 1, False, False), ("B", None, 2, None, None, True)]
    df = spark.createDataFrame(rows, "ticker string, price double, seq long, shares long, take_profit boolean, deleted boolean")
    assert [tuple(r) for r in risk.fold_positions(df).collect()] == [("A", 60.0, 7, False)]


def test_one_of_two_incoming_rows_is_accepted(spark):
    new = spark.createDataFrame([("A", 2), ("A", 1), ("B", 1)], "ticker string, qty long")
    got = risk.insert_positions(new, spark.createDataFrame([("B",)], "ticker string")).collect()
    assert sorted(map(tuple, got)) == [("A", 1, True), ("A", 2, False), ("B", 1, False)]


def test_a_bad_item_or_payload_spoils_no_other(spark):
    good = {"id": "1", "politician": {"name": "X"}, "ticker": "AB", "txType": "buy", "txDate": "2024-01-02", "disclDate": "2024-01-05"}
    rows = [(1, json.dumps({"data": [good, 17, "junk", {**good, "id": "2"}]})), (2, '{"data": [{"id": "3"'), (3, "not json"), (4, '{"data": []}'), (5, json.dumps({"trades": [good]}))]
    got = disclosures.parse_json(spark.createDataFrame(rows, "n long, payload string")).collect()
    assert sorted((r["n"], r["id"]) for r in got if r["valid"]) == [(1, "1"), (1, "2"), (5, "1")]
    assert sorted({r["n"] for r in got if not r["valid"]}) == [1, 2, 3] and all(r["raw"] for r in got)


def test_an_old_disclosure_is_not_refused(spark, tmp_path):
    schema = "id string, ts timestamp"
    for i, (k, day) in enumerate([("a", 1), ("b", 200), ("c", 80), ("a", 201)]):
        spark.createDataFrame([(k, dt.datetime(2024, 1, 1) + dt.timedelta(days=day))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert sorted(r["id"] for r in available_now(stateless.dedup(stream, ["id"])).collect()) == ["a", "b", "c"]


def test_lags_follow_the_number_of_rows(spark):
    rng = np.random.default_rng(3)
    n = 80_000
    f = rng.normal(size=n)
    e = np.convolve(rng.normal(size=n + 30), np.ones(31) / 31, "valid")
    rows = pd.DataFrame({"p": "P", "date": np.arange(n), "ret": 0.001 + 0.5 * f + e, "mkt": f})
    got = attribution.attribute(spark.createDataFrame(rows), "p", ["mkt"]).collect()[0]
    x = np.column_stack([np.ones(n), f])
    inv = np.linalg.inv(x.T @ x)
    s = x * (rows["ret"].to_numpy() - x @ (inv @ x.T @ rows["ret"].to_numpy()))[:, None]
    lags = int(4 * (n / 100) ** (2 / 9))
    meat = s.T @ s
    for k in range(1, lags + 1):
        g = s[k:].T @ s[:-k]
        meat += (1 - k / (lags + 1)) * (g + g.T)
    assert lags > 16 and got["alpha_se"] == pytest.approx(252 * np.sqrt((inv @ meat @ inv)[0, 0]), abs=2e-6)


def test_workers_find_the_package_from_any_folder(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
from barline.session import local_session
from barline.plans import load
spark = local_session(2, 2, "elsewhere")
print("ROWS", load()["attribution_one_factor"].run(spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 25" in out.stdout


def test_line_numbers_follow_the_files(spark, tmp_path):
    from barline.sources import files

    want = []
    for name, n in (("a", 40), ("b", 3), ("c", 200)):
        lines = [f"{name}{i}" + ("\nmore" if i % 7 == 0 else "") for i in range(n)]
        want += lines
        (tmp_path / f"{name}.csv").write_text("headline,ticker\n" + "".join(f'"{x}",T\n' for x in lines))
    got = files.read_news(spark, str(tmp_path), {}).orderBy("line_no").collect()
    assert [r["headline"] for r in got] == want and [r["line_no"] for r in got] == list(range(1, len(want) + 1))


def test_a_tie_goes_to_the_incoming_row(spark):
    from barline.operators.joins import upsert

    old, new = (spark.createDataFrame([(1, 5, v)], "k long, at long, v string") for v in ("old", "new"))
    assert upsert(old, new, ["k"], "at").first()["v"] == "new"


def star(spark, folder, lines, parts):
    """A folder with lineitem and part as the driver's tables hold them, and the tables over it."""
    from barline.plans.registry import Tables

    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, schema).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_brand string").write.parquet(f"{folder}/part.parquet")
    return Tables(spark, str(folder))


def test_the_first_of_equal_ids_is_the_least_number(spark, tmp_path):
    from barline.plans import load

    day = dt.datetime(2000, 1, 3)
    rows = [(1, 7, 5900, 1, 1.0, 1.0, 0.0, 0.0, day), (1, 9, 12, 1, 1.0, 1.0, 0.0, 0.0, day), (1, 9, 12, 2, 1.0, 1.0, 0.0, 0.0, day)]
    star(spark, tmp_path, rows, [(7, "Brand#1")])
    got = {r["id"]: r["pos"] for r in load()["dedup_by_id"].run(spark, str(tmp_path)).collect()}
    assert got == {"1-1": 9012, "1-2": 9012}


def test_averages_of_the_panel_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    days = [dt.datetime(2000, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    rows = [(i, 1, 1, 1, 1.0, 1.0, int(rng.integers(11)) / 100, int(rng.integers(9)) / 100, day) for day in days for i in range(96)]
    seen = []
    for k in range(3):
        got = star(spark, tmp_path / str(k), [rows[i] for i in rng.permutation(len(rows))], [(1, "Brand#1")])
        seen.append(sorted((r["date"], r["d"], r["t"]) for r in got.daily.collect()))
    of = lambda day, c: sum(round(100 * r[c]) for r in rows if r[8] == day) / 100 / 96
    assert seen[0] == seen[1] == seen[2] == [(day.date(), of(day, 6), of(day, 7)) for day in days]
