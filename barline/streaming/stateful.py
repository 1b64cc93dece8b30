"""Keyed state processors. Each keeps a few numbers per key, in RocksDB.

Rows of a key inside one micro-batch are put in order first; a micro-batch bounds them
(``maxFilesPerTrigger``, see ``run.landed``, or the source's own limit), not the length of the
history. ``Reordered`` puts rows in event-time order across micro-batches as well.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from barline import config as cfg
from barline.operators import regime as G
from barline.session import ROCKSDB


DAY_MS = 86_400_000


def ordered(rows: Iterator[pd.DataFrame], by: str | Sequence[str]) -> pd.DataFrame:
    by = by if isinstance(by, str) else list(by)
    return pd.concat(list(rows), ignore_index=True).sort_values(by, ignore_index=True)


def apply_state(stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, initial: DataFrame | None = None) -> DataFrame:
    """``initial`` holds what is known of keys before the stream starts, for processors that take it."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    known = None if initial is None else initial.groupBy(*keys)
    return stream.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "None", known)


def apply_timed(stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, time: str, late: str, initial: DataFrame | None = None) -> DataFrame:
    """Like ``apply_state``, with event-time timers. ``time`` is the event time and ``late`` how
    far rows may come out of order; later ones are dropped. Adds ``at_ms``, milliseconds."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.withWatermark(time, late).withColumn("at_ms", F.unix_millis(time))
    known = None if initial is None else initial.groupBy(*keys)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime", known)


class Reordered(StatefulProcessor):
    """Event-time order for another processor, across micro-batches, for ``apply_timed``.

    Rows wait in a list until the watermark has passed them and are then handed on, oldest
    first; ``fields`` is the schema of what is handed on, ``at_ms`` included. The list holds what
    is newer than the watermark, not the history. A key has one timer, at its oldest row.
    """

    def __init__(self, inner: StatefulProcessor, fields: str):
        self.inner, self.fields = inner, fields
        self.names = [f.split()[0] for f in fields.split(",")]
        self.schema = inner.schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.inner.init(handle)
        self.waiting = handle.getListState("waiting", self.fields)
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.inner.handleInitialState(key, initialState, timerValues)

    def _wake(self, at: int) -> None:
        """One timer, at the oldest waiting row."""
        set_for = self.timer.get()
        if set_for:
            if set_for[0] <= at:
                return
            self.handle.deleteTimer(set_for[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            if len(frame):
                self.waiting.appendList(list(zip(*[frame[n].tolist() for n in self.names])))
                self._wake(int(frame["at_ms"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        frame = pd.DataFrame(list(self.waiting.get()), columns=self.names)
        passed = frame["at_ms"] <= timerValues.getCurrentWatermarkInMs()
        rest = frame[~passed]
        if len(rest):
            at = int(rest["at_ms"].min())
            self.waiting.put(list(zip(*[rest[n].tolist() for n in self.names])))
            self.handle.registerTimer(at)
            self.timer.update((at,))
        else:
            self.waiting.clear()
            self.timer.clear()
        if passed.any():
            yield from self.inner.handleInputRows(key, iter([frame[passed]]), timerValues)

    def close(self) -> None:
        self.inner.close()


class SilentFeeds(StatefulProcessor):
    """Dead-feed alert while the feed is dead, for ``apply_timed`` on (key, at_ms).

    A day with rows is looked at ``days`` days after its end. If the watermark gets there and no
    later day has rows, the feed is reported with its last day. Alerts do not depend on the order
    of rows or on micro-batches. State: the days that the watermark has not passed yet, and the
    one timer of a key, at the oldest of them; when it fires, all days that are due are judged.
    """

    def __init__(self, key: str, kind: str, days: int = 1):
        self.key, self.days = key, days
        self.schema = f"{key} {kind}, last_day date"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "days array<bigint>, timer bigint")

    def _due(self, day: int) -> int:
        return (day + self.days + 1) * DAY_MS

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.state.get()
        known, timer = (set(state[0]), state[1]) if state else (set(), None)
        days = known.union(*[np.unique(frame["at_ms"].to_numpy() // DAY_MS).tolist() for frame in rows])
        if days != known:
            at = self._due(min(days))
            if timer is None or at < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(at)
                timer = at
            self.state.update((sorted(days), timer))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        days = list(self.state.get()[0])
        now, seen = timerValues.getCurrentWatermarkInMs(), set(days)
        rest = [day for day in days if self._due(day) > now]
        silent = [day for day in days if self._due(day) <= now and not any(day + i in seen for i in range(1, self.days + 1))]
        if rest:
            self.handle.registerTimer(self._due(rest[0]))
            self.state.update((rest, self._due(rest[0])))
        else:
            self.state.clear()
        if silent:
            yield pd.DataFrame({self.key: [key[0]] * len(silent), "last_day": [pd.Timestamp(day * DAY_MS, unit="ms").date() for day in silent]})

    def close(self) -> None:
        pass


class PositionRules(StatefulProcessor):
    """Trailing stop, hard exit and one half take-profit per position.

    Input (key, seq, price[, stop_pct]); the first price opens the position. The stop is
    measured from the peak before the current price. Emits actions; after a close the
    position stays closed.
    """

    SCHEMA = "action string, seq bigint, price double, entry_price double, peak_price double"

    def __init__(self, key: str, kind: str, risk: cfg.Risk = cfg.RISK, by: Sequence[str] = ("seq",)):
        self.key, self.kind, self.risk, self.by = key, kind, risk, by

    @property
    def schema(self) -> str:
        return f"{self.key} {self.kind}, {self.SCHEMA}"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("position", "entry double, peak double, halved boolean, closed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        entry, peak, halved, closed = self.state.get() or (None, 0.0, False, False)
        if closed:
            return
        out, r = [], self.risk
        batch = ordered(rows, self.by)
        stops = batch["stop_pct"] if "stop_pct" in batch else [r.trailing_stop_pct] * len(batch)
        for seq, price, stop in zip(batch["seq"], batch["price"], stops):
            if entry is None:
                entry = peak = price
                continue
            if closed:
                break
            before, peak = peak, max(peak, price)
            gain = (price - entry) / entry * 100 if entry > 0 else 0.0
            action = None
            if before > 0 and (before - price) / before * 100 >= stop:
                action, closed = "stop_loss", True
            elif gain >= r.hard_exit_pct:
                action, closed = "hard_exit", True
            elif gain >= r.take_profit_pct and not halved:
                action, halved = "take_profit", True
            if action:
                out.append((key[0], action, seq, price, entry, peak))
        self.state.update((entry, peak, halved, closed))
        if out:
            yield pd.DataFrame(out, columns=[self.key, "action", "seq", "price", "entry_price", "peak_price"])

    def close(self) -> None:
        pass


class BreakerRules(StatefulProcessor):
    """Risk state after each NAV observation (key, ts, nav); a lockout never clears."""

    NAMES = ("normal", "sizes_reduced", "entries_halted", "deleverage")

    def __init__(self, key: str, risk: cfg.Risk = cfg.RISK, by: Sequence[str] = ("ts",)):
        self.key, self.risk, self.by = key, risk, by
        self.schema = f"{key} string, ts timestamp_ntz, nav double, state string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("book", "day string, week string, day_nav double, week_nav double, peak double, severity int, halted boolean, locked boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = self.state.get() if self.state.exists() else ("", "", 0.0, 0.0, 0.0, 0, False, False)
        day, week, day_nav, week_nav, peak, severity, halted, locked = s
        r, states = self.risk, []
        batch = ordered(rows, self.by)
        stamps = pd.to_datetime(batch["ts"])
        days = stamps.dt.strftime("%Y-%m-%d")
        weeks = (stamps - pd.to_timedelta(stamps.dt.dayofweek, unit="D")).dt.strftime("%Y-%m-%d")
        for d, w, nav in zip(days, weeks, batch["nav"]):
            if d != day:
                day, day_nav, severity, peak = d, nav, 0, max(peak, nav)
            if w != week:
                week, week_nav, halted = w, nav, False
            loss = lambda base: (base - nav) / base * 100 if base > 0 else 0.0
            locked = locked or loss(peak) >= r.lockout_pct
            if not locked:
                halted = halted or loss(week_nav) >= r.weekly_halt_pct
                daily = loss(day_nav)
                severity = max(severity, 3 if daily >= r.daily_deleverage_pct else 2 if daily >= r.daily_halt_pct else 1 if daily >= r.daily_reduce_pct else 0)
            states.append("locked_out" if locked else "deleverage" if severity == 3 else "weekly_halt" if halted else self.NAMES[severity])
        self.state.update((day, week, day_nav, week_nav, peak, severity, halted, locked))
        yield pd.DataFrame({self.key: key[0], "ts": batch["ts"], "nav": batch["nav"], "state": states})

    def close(self) -> None:
        pass


class SilentDays(StatefulProcessor):
    """Dead-feed alert: the days on which a feed sent nothing, known once it speaks again."""

    def __init__(self, key: str, kind: str):
        self.key = key
        self.schema = f"{key} {kind}, silent_day date"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "day string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = [pd.Timestamp(self.state.get()[0])] if self.state.exists() else []
        days = sorted(set(pd.to_datetime(ordered(rows, "ts")["ts"]).dt.normalize()) | set(seen))
        gaps = [d.date() for a, b in zip(days, days[1:]) for d in pd.date_range(a, b, inclusive="neither")]
        self.state.update((str(days[-1].date()),))
        yield pd.DataFrame({self.key: [key[0]] * len(gaps), "silent_day": pd.Series(gaps, dtype=object)})

    def close(self) -> None:
        pass


class RegimeFilter(StatefulProcessor):
    """One forward step per new bar (key, date, close): O(K^2), whatever the history.

    State: the last closes (as many as the longest feature window needs), the filter
    vector, and how many bars were seen.
    """

    def __init__(self, key: str, model: G.Model, features: cfg.Features = cfg.FEATURES):
        self.key, self.model, self.tail = key, model, features.trend_window
        states = ", ".join(f"p{i} double" for i in range(model.k))
        self.schema = f"{key} string, date date, {states}"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("filter", "closes array<double>, log_alpha array<double>")

    def _observe(self, closes: np.ndarray) -> np.ndarray | None:
        """Daily return in percent and the distance from the long mean in deviations."""
        if len(closes) < self.tail // 2:
            return None
        window = closes[-self.tail:]
        return np.array([(closes[-1] / closes[-2] - 1) * 100, (closes[-1] - window.mean()) / (window.std(ddof=1) + 1e-8)])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        closes, alpha = self.state.get() if self.state.exists() else ([], [])
        closes, alpha = list(closes), np.array(alpha, dtype=float)
        m, lt, out = self.model, np.log(self.model.trans + G.TINY), []
        batch = ordered(rows, "date")
        for day, close in zip(batch["date"], batch["close"]):
            closes = closes[-self.tail:] + [float(close)]
            x = self._observe(np.array(closes))
            if x is None:
                continue
            e = -0.5 * (len(x) * np.log(2 * np.pi) + np.log(m.vars).sum(1) + ((x - m.means) ** 2 / m.vars).sum(1))
            alpha = G.forward_step(alpha, lt, e) if len(alpha) else np.log(m.start + G.TINY) + e
            alpha = alpha - alpha.max()
            p = np.exp(alpha) / np.exp(alpha).sum()
            out.append((key[0], day, *p))
        self.state.update((closes, alpha.tolist()))
        yield pd.DataFrame(out, columns=[self.key, "date", *[f"p{i}" for i in range(m.k)]])

    def close(self) -> None:
        pass


def windows(values: np.ndarray, n: int) -> np.ndarray:
    """A row per value: itself and the ``n`` - 1 before it, NaN where there are none."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, np.nan), values]), n)


def mean_std(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Trailing mean and sample deviation where at least half a window of values is there."""
    w = windows(values, n)
    there = ~np.isnan(w)
    count = there.sum(1)
    ok = count >= max(n // 2, 2)
    size = np.where(ok, count, 2)
    mean = np.where(there, w, 0.0).sum(1) / size
    square = np.where(there, w - mean[:, None], 0.0) ** 2
    return np.where(ok, mean, np.nan), np.where(ok, np.sqrt(square.sum(1) / (size - 1)), np.nan)


def back(values: np.ndarray, n: int) -> np.ndarray:
    """The change in parts against ``n`` values before; NaN where there is none, or zero."""
    base = np.concatenate([np.full(min(n, len(values)), np.nan), values[:-n]])
    return values / np.where(base == 0, np.nan, base) - 1


def bar_features(close: np.ndarray, volume: np.ndarray, vix: np.ndarray, c: cfg.Features = cfg.FEATURES) -> dict[str, np.ndarray]:
    """What ``regime.features`` computes, from the bars of one series in order; missing is NaN.
    A bar's features follow from itself and the ``reach`` - 1 bars before it."""
    ret = back(close, 1)
    mean, std = mean_std(close, c.trend_window)
    usual, spread = mean_std(volume, c.vol_window)
    return {
        "ret_1d": ret, "vol_20d": mean_std(ret, c.vol_window)[1] * np.sqrt(252), "trend_z": (close - mean) / (std + 1e-8),
        "vol_z": (volume - usual) / (spread + 1e-8), "vix_level": vix, "vix_change": back(vix, 1), "momentum": back(close, c.momentum_window),
        "drawdown": close / np.fmax.reduce(windows(close, 252), axis=1) - 1,
    }


def reach(c: cfg.Features = cfg.FEATURES) -> int:
    """How many bars the longest feature looks at, the bar itself among them."""
    return max(c.trend_window, c.vol_window + 1, c.momentum_window + 1, 252)


class RegimeUpdate(StatefulProcessor):
    """Regime of each new bar (key, date, close, volume, vix) of a series: one forward step.

    A series' model is its initial state, a row (key, ``MODEL_FIELDS``): features by name with the
    mean and deviation they were scaled with, the parameters, and the states' ranks and labels. A
    feature that a bar lacks, or that has another name than all known ones, is the training
    mean; a constant feature is divided by one. VIX is carried forward.

    State: the model, a list of the last bars (as many as the longest feature looks at), and the
    filter vector with the last labels. Bars without a core feature warm up and give no row.
    Bars of a date that is not after the last one, and of series without a model, are left out;
    bars without a close too.
    """

    MODEL_FIELDS = "names array<string>, mean array<double>, std array<double>, start array<double>, trans array<double>, means array<double>, vars array<double>, ranks array<int>, labels array<string>"
    BAR = ["date", "close", "volume", "vix"]

    def __init__(self, key: str, c: cfg.Features = cfg.FEATURES, stable_bars: int = 3):
        self.key, self.c, self.stable_bars = key, c, stable_bars
        self.schema = f"{key} string, date date, regime_index int, regime_label string, confidence double, is_stable boolean, transition_rate double, posteriors array<double>"
        self.names = [f.split()[0] for f in self.MODEL_FIELDS.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.model = handle.getValueState("model", self.MODEL_FIELDS)
        self.tail = handle.getListState("tail", "date date, close double, volume double, vix double")
        self.filter = handle.getValueState("filter", "log_alpha array<double>, recent array<int>")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        self.model.update(tuple(np.asarray(row[n]).tolist() for n in self.names))

    def _scaled(self, features: dict[str, np.ndarray], m: dict) -> np.ndarray:
        cols = []
        for name, mean, std in zip(m["names"], m["mean"], m["std"]):
            values = features.get(name, np.full(len(features["ret_1d"]), np.nan))
            cols.append((np.where(np.isnan(values), mean, values) - mean) / (std or 1.0))
        return np.column_stack(cols)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = ordered(rows, "date").dropna(subset=["close"]).drop_duplicates("date", keep="last")
        old = pd.DataFrame(list(self.tail.get()), columns=self.BAR)
        if len(old):
            new = new[pd.to_datetime(new["date"]) > pd.Timestamp(old["date"].iloc[-1])]
        if not len(new) or not self.model.exists():
            return
        bars = pd.concat([old, new[self.BAR]], ignore_index=True) if len(old) else new[self.BAR].reset_index(drop=True)
        numbers = bars[self.BAR[1:]].astype(float)
        numbers["vix"] = numbers["vix"].ffill()
        features = bar_features(*(numbers[c].to_numpy() for c in self.BAR[1:]), self.c)
        m = dict(zip(self.names, self.model.get()))
        k, log_trans = len(m["start"]), np.log(np.reshape(m["trans"], (-1, len(m["start"]))) + G.TINY)
        means, var = np.reshape(m["means"], (k, -1)), np.reshape(m["vars"], (k, -1))
        x = self._scaled(features, m)
        gap = x[:, None, :] - means
        emission = -0.5 * (x.shape[1] * np.log(2 * np.pi) + np.log(var).sum(1) + (gap * gap / var).sum(2))
        ready = ~np.isnan([features[n] for n in G.CORE]).any(0)
        alpha, recent = self.filter.get() if self.filter.exists() else ([], [])
        alpha, recent, order, out, n = np.array(alpha, dtype=float), list(recent), np.argsort(m["ranks"]), [], self.stable_bars
        for i in range(len(old), len(bars)):
            if not ready[i]:
                continue
            alpha = G.forward_step(alpha, log_trans, emission[i]) if len(alpha) else np.log(np.array(m["start"]) + G.TINY) + emission[i]
            alpha = alpha - alpha.max()
            p = (np.exp(alpha) / np.exp(alpha).sum())[order]
            rank = int(p.argmax())
            known = len(recent) == n
            changes = sum(a != b for a, b in zip(recent, recent[1:])) / (n - 1) if known else 1.0
            out.append((key[0], bars["date"].iloc[i], rank, m["labels"][rank], float(p[rank]), known and set(recent) == {rank}, changes, p.tolist()))
            recent = [*recent, rank][-n:]
        if len(alpha):
            self.filter.update((alpha.tolist(), recent))
        last = slice(-reach(self.c) + 1, None)
        # plain None and floats: the state's schema takes no NaT and no numpy values
        values = zip(pd.to_datetime(bars["date"]).dt.date[last], *(numbers[c][last].tolist() for c in self.BAR[1:]))
        self.tail.put([tuple(None if v != v else v for v in row) for row in values])
        yield pd.DataFrame(out, columns=[f.split()[0] for f in self.schema.split(", ")])

    def close(self) -> None:
        pass
