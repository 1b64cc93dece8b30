import datetime as dt
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.operators import regime as G
from barline.session import checkpoint_root
from barline.streaming import stateful as P
from barline.streaming import stateless as L
from barline.streaming.run import available_now, landed


def feed(spark, name, batches, schema):
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_position_state_survives_micro_batches(spark):
    schema = "k string, seq bigint, price double"
    rows = feed(spark, "pos", [[("a", 1, 100.0), ("b", 1, 10.0)], [("a", 2, 120.0), ("b", 2, 12.6)], [("a", 3, 101.0), ("b", 3, 14.5), ("b", 4, 5.0)]], schema)
    rules = P.PositionRules("k", "string")
    got = available_now(P.apply_state(rows, ["k"], rules, rules.schema)).select("k", "action", "seq").collect()
    assert sorted(map(tuple, got)) == [("a", "stop_loss", 3), ("b", "hard_exit", 3), ("b", "take_profit", 2)]


def test_dedup_over_batches(spark):
    t = dt.datetime(2024, 1, 1)
    rows = feed(spark, "dedup", [[("x", t)], [("x", t + dt.timedelta(days=1)), ("y", t)]], "id string, ts timestamp")
    assert available_now(L.dedup(rows, ["id"])).count() == 2


def test_lockout_never_clears(spark):
    t = dt.datetime(2024, 1, 1, 10)
    navs = [100.0, 84.0, 200.0]
    rows = feed(spark, "brk", [[("p", t + dt.timedelta(days=i), v)] for i, v in enumerate(navs)], "portfolio_id string, ts timestamp_ntz, nav double")
    rules = P.BreakerRules("portfolio_id")
    got = available_now(P.apply_state(rows, ["portfolio_id"], rules, rules.schema)).orderBy("ts").collect()
    assert [r["state"] for r in got] == ["normal", "locked_out", "locked_out"]


def test_counts_have_a_batch_twin(spark, sf):
    batch = L.event_counts(spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    stream = available_now(L.event_counts(landed(spark, sf, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))))
    assert stream.count() > 0 and stream.exceptAll(batch).count() == 0


def shuffled(spark, name, seed=5, users=("a", "b", "c"), steps=40):
    """Five files of a price history in shuffled order, and a last row far in the future."""
    rng = random.Random(seed)
    t = dt.datetime(2024, 1, 1)
    rows = [(u, t + dt.timedelta(hours=7 * i, minutes=j), i, 100 + rng.uniform(-30, 50)) for j, u in enumerate(users) for i in range(steps)]
    mixed = rng.sample(rows, len(rows))
    cut = [mixed[i::5] for i in range(5)]
    return rows, feed(spark, name, [*cut, [("end", t + dt.timedelta(days=900), 0, 1.0)]], "k string, ts timestamp, seq bigint, price double")


def test_shuffled_files_give_what_one_batch_gives(spark):
    rows, stream = shuffled(spark, "shuffled")
    rules = P.Reordered(P.PositionRules("k", "string", by=("at_ms", "seq")), "at_ms bigint, seq bigint, price double")
    got = available_now(P.apply_timed(stream, ["k"], rules, rules.schema, "ts", "700 days")).select("k", "action", "seq").collect()
    one = feed(spark, "shuffled_one", [[(k, seq, price) for k, _, seq, price in rows]], "k string, seq bigint, price double")
    plain = P.PositionRules("k", "string")
    want = available_now(P.apply_state(one, ["k"], plain, plain.schema)).select("k", "action", "seq").collect()
    assert len(want) >= 3 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_a_dead_feed_is_reported_while_it_is_dead(spark):
    t = dt.datetime(2024, 1, 1, 12)
    at = lambda *days: [t + dt.timedelta(days=d) for d in days]
    files = [[("x", d) for d in at(0, 1)] + [("y", d) for d in at(0)], [("x", d) for d in at(2, 3)], [("x", d) for d in at(4, 5)], [("y", d) for d in at(5)] + [("x", d) for d in at(8)]]
    stream = feed(spark, "dead", files, "k string, ts timestamp")
    rules = P.SilentFeeds("k", "string", days=1)
    got = available_now(P.apply_timed(stream, ["k"], rules, rules.schema, "ts", "1 hour")).collect()
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    assert sorted(map(tuple, got)) == [("x", day(5)), ("y", day(0)), ("y", day(5))]


def test_alerts_do_not_depend_on_the_order_of_files(spark):
    rows, stream = shuffled(spark, "dead_shuffled", users=("a",), steps=12)
    rules = P.SilentFeeds("k", "string", days=0)
    got = available_now(P.apply_timed(stream.select("k", "ts"), ["k"], rules, rules.schema, "ts", "700 days")).where("k = 'a'").collect()
    assert sorted(r["last_day"] for r in got) == sorted({ts.date() for _, ts, _, _ in rows})


def test_breakers_of_shuffled_files(spark):
    rows, stream = shuffled(spark, "breakers_shuffled")
    rules = P.Reordered(P.BreakerRules("k", by=("at_ms",)), "at_ms bigint, ts timestamp, nav double")
    calm = stream.withColumn("nav", 100 + (F.col("price") - 100) / 8)
    got = available_now(P.apply_timed(calm, ["k"], rules, rules.schema, "ts", "700 days")).where("k <> 'end'").collect()
    one = feed(spark, "breakers_one", [[(k, ts, 100 + (price - 100) / 8) for k, ts, _, price in rows]], "k string, ts timestamp, nav double")
    plain = P.BreakerRules("k")
    want = available_now(P.apply_state(one, ["k"], plain, plain.schema)).collect()
    assert len({r["state"] for r in want}) > 2 and sorted(map(tuple, got)) == sorted(map(tuple, want))


NAMES = ["ret_1d", "vol_20d", "trend_z", "vol_z", "vix_level", "vix_change", "momentum", "drawdown"]
BARS = "k string, date date, close double, volume double, vix double"


def market(n=330, keys=("a", "b")):
    rng, t = np.random.default_rng(3), dt.date(2022, 1, 1)
    rows = []
    for k in keys:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        vix = [float(v) if rng.random() < 0.8 else None for v in rng.uniform(10, 40, n)]
        rows += [(k, t + dt.timedelta(days=i), float(c), float(v), x) for i, (c, v, x) in enumerate(zip(close, rng.uniform(1e5, 2e5, n), vix))]
    return rows


def known_models(spark, rows, keys=("k",)):
    """The rows with VIX carried forward and their features, the models, and what the batch finds."""
    from barline.functions.series import over, so_far

    rng = np.random.default_rng(8)
    model = G.Model(np.full(3, 1 / 3), np.full((3, 3), 0.1) + 0.7 * np.eye(3), rng.normal(0, 1, (3, 8)), rng.uniform(1, 3, (3, 8)))
    bars = spark.createDataFrame(rows, BARS).withColumn("vix", F.last("vix", ignorenulls=True).over(so_far(over("k"))))
    feats = G.warmed_up(G.features(bars, "k"))
    scaler = G.fit_scaler(feats, ["k"], NAMES)
    labels = ["down", "flat", "up"]
    stored = G.stored_models(scaler, ["k"], NAMES, model, [2, 0, 1], labels)
    scaled = G.scale(feats, scaler, ["k"], NAMES)
    scored = scaled.withColumn("log_emission", G.log_emission([F.col(f"z_{n}") for n in NAMES], model))
    batch = G.classify(G.decode(scored, model, "k", whole=False), [2, 0, 1], labels, "k")
    return stored, {(r["k"], r["date"]): r for r in batch.collect()}


def same_regimes(got, want):
    assert len(got) == len(want) > 200
    for r in got:
        w = want[r["k"], r["date"]]
        assert (r["regime_index"], r["regime_label"], r["is_stable"]) == (w["regime_index"], w["regime_label"], w["is_stable"])
        assert (r["confidence"], r["transition_rate"]) == pytest.approx((w["confidence"], w["transition_rate"]), abs=1e-9)
        assert r["posteriors"] == pytest.approx(w["posteriors"], abs=1e-9)


def test_regimes_bar_by_bar_are_those_of_the_batch(spark):
    rows = market()
    stored, want = known_models(spark, rows)
    rows.sort(key=lambda r: r[1])
    files = [rows[:40], rows[40:300], rows[300:301], rows[301:640], rows[630:]]  # the last one repeats bars
    rules = P.RegimeUpdate("k")
    got = available_now(P.apply_state(feed(spark, "regimes", files, BARS), ["k"], rules, rules.schema, stored)).collect()
    same_regimes(got, want)


def test_regimes_of_shuffled_files(spark):
    rows = market(260)
    stored, want = known_models(spark, rows)
    mixed = random.Random(2).sample(rows, len(rows))
    files = [mixed[i::4] for i in range(4)] + [[("end", dt.date(2030, 1, 1), 1.0, 1.0, 1.0)]]
    rules = P.Reordered(P.RegimeUpdate("k"), "at_ms bigint, date date, close double, volume double, vix double")
    stream = feed(spark, "regimes_mixed", files, BARS).withColumn("ts", F.col("date").cast("timestamp"))
    got = available_now(P.apply_timed(stream, ["k"], rules, rules.schema, "ts", "700 days", stored)).collect()
    same_regimes(got, want)


def test_regime_update_without_a_model_or_a_feature(spark):
    rows = market(130, ("a", "none"))
    stored, _ = known_models(spark, [r for r in rows if r[0] == "a"])
    odd = F.transform("names", lambda n: F.when(n == "vol_z", "other").otherwise(n))
    renamed = stored.withColumn("names", odd)
    empty = [("a", dt.date(2023, 1, 1), None, None, None)]
    got = {}
    for name, models in (("plain", stored), ("odd", renamed)):
        rules = P.RegimeUpdate("k")
        files = [[r[:3] + (None, r[4]) if name == "plain" else r for r in rows], empty]
        got[name] = available_now(P.apply_state(feed(spark, f"regime_{name}", files, BARS), ["k"], rules, rules.schema, models)).orderBy("date").collect()
    assert {r["k"] for r in got["plain"]} == {"a"} and len(got["plain"]) == 31
    # a volume that is missing and a feature that nobody knows both count as the training mean
    assert np.allclose([r["posteriors"] for r in got["plain"]], [r["posteriors"] for r in got["odd"]], atol=1e-12)


def test_a_feed_has_one_timer_whatever_its_days():
    from unittest.mock import MagicMock

    import pandas as pd

    handle, rules = MagicMock(), P.SilentFeeds("k", "string")
    handle.getValueState.return_value.get.return_value = None
    handle.getMapState.return_value.containsKey.return_value = False
    rules.init(handle)
    list(rules.handleInputRows(("a",), iter([pd.DataFrame({"at_ms": [P.DAY_MS * d for d in range(30)]})]), None))
    handle.registerTimer.assert_called_once_with(2 * P.DAY_MS)


def test_positions_without_an_action_send_nothing():
    from unittest.mock import MagicMock

    import pandas as pd

    for known in (None, (100.0, 100.0, False, True)):
        handle, rules = MagicMock(), P.PositionRules("k", "string")
        state = handle.getValueState.return_value
        state.get.return_value, state.exists.return_value = known, known is not None
        rules.init(handle)
        assert list(rules.handleInputRows(("a",), iter([pd.DataFrame({"seq": [1, 2], "price": [100.0, 101.0]})]), None)) == []
