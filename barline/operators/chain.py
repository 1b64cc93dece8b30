"""Hidden Markov chains over many series, by associative scans.

A bar is a K x K matrix: the step from every state, times the density of the bar in the next
one. Products of such matrices don't depend on how they are bracketed, so a series is cut into
blocks. Each block multiplies its own matrices (all prefixes at once, by doubling), the few
block products of a series are carried from block to block, and a second pass over the blocks
starts from what was carried in. Blocks are spread over tasks, whatever series they belong to,
and no loop runs over bars.

Matrices are kept in scaled form: every row has its largest entry at one and its own logarithm.
Best paths use the same scan with maxima in place of sums, and compose the back pointers.

Models are rows: ``start`` (K), ``trans`` (K * K), and for fits ``means`` and ``vars`` (K * D).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions.series import over
from barline.session import land

BLOCK = 256
CELLS = 1 << 21  # numbers of the largest array that a step works on
TINY = 1e-300
FLOOR = 1e-6  # fixed value: least variance, and pseudo-count of a start or a step


# ---- scans over (blocks, rows, K, K) ----
def product(a: np.ndarray, sa: np.ndarray, b: np.ndarray, sb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Product of matrices in scaled form: ``a`` has rows of largest entry one, ``sa`` their logs.
    Rows that lean on states of very small scale are taken in logarithms."""
    m = np.repeat(sb.max(-1, keepdims=True), sb.shape[-1], -1)
    c = (a * np.exp(sb - m)[..., None, :]) @ b
    top = c.max(-1)
    low = top < 1e-100
    if low.any():
        with np.errstate(divide="ignore"):
            w = np.log(a[low]) + np.broadcast_to(sb[..., None, :], a.shape)[low]
        m[low] = w.max(-1)
        c[low] = (np.exp(w - m[low][:, None])[:, None, :] @ np.broadcast_to(b[..., None, :, :], (*a.shape, a.shape[-1]))[low])[:, 0]
        top[low] = c[low].max(-1)
    return c / top[..., None], sa + m + np.log(top)


def best_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[..., :, :, None] + b[..., None, :, :]).max(-2)


def composed(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Maps of states, first ``g``, then ``f``."""
    return np.take_along_axis(f, g, -1)


def scan(parts: tuple[np.ndarray, ...], fn, backwards: bool = False) -> tuple[np.ndarray, ...]:
    """All prefixes (suffixes) along axis 1 of an associative ``fn``, in log2(rows) steps."""
    d, n = 1, parts[0].shape[1]
    while d < n:
        left, right = [p[:, :-d] for p in parts], [p[:, d:] for p in parts]
        got = fn(*left, *right)
        got = got if isinstance(got, tuple) else (got,)
        parts = tuple(np.concatenate([g, p[:, -d:]] if backwards else [p[:, :d], g], 1) for p, g in zip(parts, got))
        d *= 2
    return parts


def lse(x: np.ndarray) -> np.ndarray:
    top = x.max(-1, keepdims=True)
    return (np.log(np.exp(x - top).sum(-1, keepdims=True)) + top)[..., 0]


class Steps:
    """Step matrices of blocks: ``e`` (blocks, rows, K) log densities, ``size`` rows that are
    there, ``first``: the block begins its series. Missing rows are identities."""

    def __init__(self, e: np.ndarray, size: np.ndarray, first: np.ndarray, start: np.ndarray, trans: np.ndarray):
        k = e.shape[2]
        self.there = np.arange(e.shape[1])[None, :] < size[:, None]
        step = np.broadcast_to(np.log(trans + TINY)[:, None], (*e.shape[:2], k, k)).copy()
        step[first, 0] = np.log(start[first] + TINY)[:, None, :]
        self.log = step + e[:, :, None, :]
        self.log[~self.there] = np.where(np.eye(k) > 0, 0.0, -np.inf)
        self.scale = self.log.max(-1)
        self.matrix = np.exp(self.log - self.scale[..., None])

    def sums(self, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
        return scan((self.matrix, self.scale), product, backwards)

    def best(self) -> np.ndarray:
        return scan((self.log,), best_product)[0]


def ahead(carry: np.ndarray, prefix: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Logs of the forward variable at every row; ``carry``: that before the block."""
    w = carry[:, None, :] + scale
    m = w.max(-1, keepdims=True)
    with np.errstate(divide="ignore"):
        return np.log((np.exp(w - m)[..., None, :] @ prefix)[..., 0, :]) + m


def behind(carry: np.ndarray, suffix: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Logs of the backward variable at every row; ``carry``: that at the block's end."""
    m = carry.max(-1, keepdims=True)
    with np.errstate(divide="ignore"):
        inner = np.log((suffix @ np.exp(carry - m)[:, None, :, None])[..., 0]) + scale + m[:, None, :]
    return np.concatenate([inner[:, 1:], carry[:, None, :]], 1)


# ---- blocks of series ----
def packed(rows: DataFrame, keys: Sequence[str], value: str, order: str = "date", block: int = BLOCK) -> DataFrame:
    """(keys, block, last, at, x), landed: every series (one row per key and ``order``) in
    blocks of at most ``block`` rows, in order; ``x`` are arrays. Rows with a null value or a
    null inside it are not allowed and fail."""
    ok = F.col(value).isNotNull() & ~F.exists(value, lambda v: v.isNull())
    x = F.when(ok, F.col(value)).otherwise(F.raise_error(F.lit(f"{value}: a null inside a series")).cast("array<double>"))
    df = rows.select(*keys, F.col(order).alias("at"), x.alias("x")).withColumns({"_n": F.row_number().over(over(keys, "at")) - 1, "_c": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    df = df.withColumns({"block": F.floor(F.col("_n") / block).cast("int"), "last": F.floor((F.col("_c") - 1) / block).cast("int")})
    out = df.groupBy(*keys, "block").agg((F.max("last") == F.col("block")).alias("last"), F.array_sort(F.collect_list(F.struct("at", "x"))).alias("_r"))
    out = out.select(*keys, "block", "last", F.col("_r.at").alias("at"), F.col("_r.x").alias("x"))
    return _kept(out.repartition(*keys, "block"))


def _kept(df: DataFrame) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).parquet(land(df))


def _cells(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A column of equally long arrays in arrays as (rows, longest, width), and the lengths."""
    col = batch.column(name)
    size = col.value_lengths().to_numpy(zero_copy_only=False)
    flat = col.flatten().flatten().to_numpy(zero_copy_only=False)
    there = np.arange(size.max(initial=0))[None, :] < size[:, None]
    out = np.zeros((*there.shape, len(flat) // max(1, int(size.sum()))))
    out[there] = flat.reshape(int(size.sum()), -1)
    return out, size


def _table(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _pieces(batches: Iterator[pa.RecordBatch], square: int) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Batches cut by the number of states, and so that ``rows * K ** square`` stays small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        states = batch.column("start").value_lengths().to_numpy(zero_copy_only=False)
        for k in np.unique(states).tolist():
            part = batch.filter(pa.array(states == k))
            size = int(part.column("x").value_lengths().to_numpy(zero_copy_only=False).max())
            step = max(1, CELLS // (size * k**square))
            for at in range(0, part.num_rows, step):
                yield part.slice(at, step), k


def _steps(batch: pa.RecordBatch, e: np.ndarray, size: np.ndarray, k: int) -> Steps:
    first = batch.column("block").to_numpy() == 0
    return Steps(e, size, first, _table(batch, "start"), _table(batch, "trans").reshape(-1, k, k))


def density(x: np.ndarray, means: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Log densities (blocks, rows, K) of diagonal normal states."""
    gap = x[:, :, None, :] - means[:, None]
    return -0.5 * ((gap * gap / spread[:, None]).sum(-1) + np.log(2 * np.pi * spread).sum(-1)[:, None])


def _emission(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, log densities, lengths): ``x`` holds log densities itself unless the model has means."""
    x, size = _cells(batch, "x")
    if batch.schema.get_field_index("means") < 0:
        return x, x, size
    shape = (batch.num_rows, k, x.shape[2])
    return x, density(x, _table(batch, "means").reshape(shape), _table(batch, "vars").reshape(shape)), size


def _lists(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as arrays."""
    width = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).reshape(-1)))


def _nested(values: np.ndarray, there: np.ndarray) -> pa.Array:
    """(blocks, rows, width) without the rows that aren't there, as arrays of arrays."""
    ends = np.concatenate([[0], np.cumsum(there.sum(1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), _lists(values[there]))


def _with(batch: pa.RecordBatch, names: Sequence[str], more: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *more.values()], names=[*names, *more])


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def products(blocks: DataFrame, keys: Sequence[str], best: bool = False) -> DataFrame:
    """(keys, block, last, k, matrix, scale[, best]) of every block."""
    names = [*keys, "block", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k in _pieces(batches, 3 if best else 2):
            _, e, size = _emission(batch, k)
            steps = _steps(batch, e, size, k)
            m, s = steps.sums()
            more = {"matrix": _lists(m[:, -1].reshape(len(m), -1)), "scale": _lists(s[:, -1])}
            if best:
                more["best"] = _lists(steps.best()[:, -1].reshape(len(m), -1))
            yield _with(batch, names, more)

    kind = f"{_fields(blocks, names)}, matrix array<double>, scale array<double>"
    return blocks.mapInArrow(run, kind + (", best array<double>" if best else ""))


def carries(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, block, before, after[, best_before]): logs of what every block starts from, from
    the block products of its series. A group holds one small row for every ``BLOCK`` bars."""
    best = "best" in parts.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ignore_index=True)
        scale = np.stack(pdf["scale"].to_numpy())
        k = scale.shape[1]
        m = np.stack(pdf["matrix"].to_numpy()).reshape(-1, k, k)
        with np.errstate(divide="ignore"):
            m = np.log(m) + scale[:, :, None]
        before, after = np.full((len(m), k), -np.log(k)), np.zeros((len(m), k))
        for b in range(1, len(m)):
            before[b] = lse((before[b - 1][:, None] + m[b - 1]).T)
        for b in range(len(m) - 2, -1, -1):
            after[b] = lse(m[b + 1] + after[b + 1][None, :])
            after[b] -= after[b].max()
        out = {**{c: pdf[c] for c in [*keys, "block"]}, "before": list(before), "after": list(after)}
        if best:
            top, g = np.zeros((len(m), k)), np.stack(pdf["best"].to_numpy()).reshape(-1, k, k)
            for b in range(1, len(m)):
                top[b] = (top[b - 1][:, None] + g[b - 1]).max(0)
            out["best_before"] = list(top)
        return pd.DataFrame(out)

    kind = f"{_fields(parts, [*keys, 'block'])}, before array<double>, after array<double>"
    return parts.groupBy(*keys).applyInPandas(run, kind + (", best_before array<double>" if best else ""))


def _decoded(names: Sequence[str], whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k in _pieces(batches, 3 if whole else 2):
            _, e, size = _emission(batch, k)
            steps = _steps(batch, e, size, k)
            a = ahead(_table(batch, "before"), *steps.sums())
            ll = lse(a)
            more = {"filtered": _nested(np.exp(a - ll[..., None]), steps.there)}
            ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            more["log_likelihood"] = pa.ListArray.from_arrays(ends, pa.array(ll[steps.there]))
            if whole:
                more |= _looking_back(batch, steps, a, k)
            yield _with(batch, names, more)

    return run


def _looking_back(batch: pa.RecordBatch, steps: Steps, a: np.ndarray, k: int) -> dict[str, pa.Array]:
    """Smoothed posteriors; per row the state for every state at the block's end; that for the
    end of the block before; and the best end states of the block alone."""
    g = a + behind(_table(batch, "after"), *steps.sums(True))
    carry = _table(batch, "best_before")
    delta = (carry[:, None, :, None] + steps.best()).max(-2)
    before = np.concatenate([carry[:, None], delta[:, :-1]], 1)
    trans = np.log(_table(batch, "trans").reshape(-1, 1, k, k) + TINY)
    point = (before[..., None] + trans).argmax(-2)
    point[~steps.there] = np.arange(k)
    back = scan((point,), composed, True)[0]
    here = np.concatenate([back[:, 1:], np.broadcast_to(np.arange(k), (len(back), 1, k))], 1)
    return {
        "smoothed": _nested(np.exp(g - lse(g)[..., None]), steps.there), "states": _nested(here.astype(np.int32), steps.there),
        "entry": _lists(back[:, 0].astype(np.int32)), "final": pa.array(delta[:, -1].argmax(-1).astype(np.int32)),
    }


def _end_states(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, block, end): the best path's state at the end of every block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ignore_index=True)
        entry, end = pdf["entry"].to_list(), [0] * len(pdf)
        for b in range(len(pdf) - 1, -1, -1):
            end[b] = int(pdf["final"].iloc[b]) if b == len(pdf) - 1 else int(entry[b + 1][end[b + 1]])
        return pd.DataFrame({**{c: pdf[c] for c in [*keys, "block"]}, "end": end})

    return parts.groupBy(*keys).applyInPandas(run, f"{_fields(parts, [*keys, 'block'])}, end int")


def decoded(blocks: DataFrame, keys: Sequence[str], whole: bool = True) -> DataFrame:
    """(keys, date, filtered, log_likelihood[, smoothed, path]) of ``blocks`` with model columns."""
    keys, at = list(keys), [*keys, "block"]
    joined = blocks.join(carries(products(blocks, keys, whole), keys), at)
    names = [*at, "at"]
    kind = f"{_fields(blocks, names)}, filtered array<array<double>>, log_likelihood array<double>"
    if not whole:
        rows = joined.mapInArrow(_decoded(names, False), kind)
        return rows.select(*keys, F.explode(F.arrays_zip("at", "filtered", "log_likelihood")).alias("r")).select(*keys, F.col("r.at").alias("date"), "r.filtered", "r.log_likelihood")
    rows = _kept(joined.mapInArrow(_decoded(names, True), f"{kind}, smoothed array<array<double>>, states array<array<int>>, entry array<int>, final int"))
    rows = rows.join(_end_states(rows.select(*at, "entry", "final"), keys), at)
    out = rows.select(*keys, "end", F.explode(F.arrays_zip("at", "filtered", "log_likelihood", "smoothed", "states")).alias("r"))
    return out.select(*keys, F.col("r.at").alias("date"), "r.filtered", "r.smoothed", F.col("r.states")[F.col("end")].alias("path"), "r.log_likelihood")


# ---- fits ----
def counts(batch: pa.RecordBatch, k: int) -> np.ndarray:
    """Expected counts of every block: log-likelihood, start, steps, weights, and weighted sums
    of x and x * x per state."""
    x, e, size = _emission(batch, k)
    steps = _steps(batch, e, size, k)
    a = ahead(_table(batch, "before"), *steps.sums())
    b = behind(_table(batch, "after"), *steps.sums(True))
    first = batch.column("block").to_numpy() == 0
    there = steps.there[..., None]
    g = a + b
    g = np.where(there, np.exp(g - lse(g)[..., None]), 0.0)
    earlier = np.concatenate([_table(batch, "before")[:, None], a[:, :-1]], 1)
    pair = earlier[..., None] + steps.log + b[:, :, None, :]
    pair = np.exp(pair - lse(pair.reshape(*pair.shape[:2], -1))[..., None, None])
    pair[~steps.there] = 0
    pair[first, 0] = 0
    total = np.where(batch.column("last").to_numpy(zero_copy_only=False), lse(a)[np.arange(len(size)), size - 1], 0.0)
    parts = [total[:, None], np.where(first[:, None], g[:, 0], 0.0), pair.sum(1), g.sum(1), np.einsum("brk,brd->bkd", g, x), np.einsum("brk,brd->bkd", g, x * x)]
    return np.concatenate([p.reshape(len(size), -1) for p in parts], 1)


FIT = ["k", "restart"]
PARTS = "start array<double>, trans array<double>, means array<double>, vars array<double>"


def _expected(group: Sequence[str]):
    """Expected counts, added up over the blocks of a batch that share a model."""
    names = [*group, *FIT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k in _pieces(batches, 2):
            frame = batch.select(names).to_pandas()
            code, _ = pd.factorize(pd.MultiIndex.from_frame(frame))
            found = counts(batch, k)
            sums = np.zeros((code.max() + 1, found.shape[1]))
            np.add.at(sums, code, found)
            one = np.unique(code, return_index=True)[1]
            yield pa.RecordBatch.from_arrays([*[batch.column(n).take(pa.array(one)) for n in names], _lists(sums)], names=[*names, "counts"])

    return run


def from_counts(c: np.ndarray, means: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, trans, means, vars) that summed counts ask for. A state without weight stays."""
    k, d = means.shape
    first, steps, weight, sx, sxx = np.split(c[1:], np.cumsum([k, k * k, k, k * d]))
    steps, used = steps.reshape(k, k) + FLOOR, weight > FLOOR
    w = np.where(used, weight, 1.0)[:, None]
    mean = np.where(used[:, None], sx.reshape(k, d) / w, means)
    var = np.where(used[:, None], sxx.reshape(k, d) / w - mean**2, spread)
    return (first + FLOOR) / (first + FLOOR).sum(), steps / steps.sum(1, keepdims=True), mean, np.maximum(var, FLOOR)


def _updated(group: Sequence[str], tol: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for k, n, old, likely, c, means, spread in zip(*(pdf[x] for x in ("k", "n", "log_likelihood", "none", "counts", "means", "vars"))):
                c = np.asarray(c)
                now = from_counts(c, np.asarray(means).reshape(k, -1), np.asarray(spread).reshape(k, -1))
                rows.append([*[x.ravel().tolist() for x in now], float(c[0]), bool(not likely and c[0] - old < tol * n)])
            made = pd.DataFrame(rows, columns=["start", "trans", "means", "vars", "log_likelihood", "done"], index=pdf.index)
            yield pd.concat([pdf[[*group, *FIT, "n"]], made], axis=1)

    return run


def expectation(blocks: DataFrame, models: DataFrame, group: Sequence[str], series: Sequence[str]) -> DataFrame:
    """(group, k, restart, counts): expected counts of all series of a group under each of its
    models, from ``packed`` blocks keyed by (group, series). The number of models is counted
    before they are broadcast."""
    group = list(group)
    small = models.select(*group, *FIT, "start", "trans", "means", "vars")
    small = F.broadcast(small) if models.count() <= 20_000 else small
    rows = blocks.join(small, group)
    keys = [*dict.fromkeys([*group, *series]), *FIT]
    found = rows.join(carries(products(rows, keys), keys), [*keys, "block"]).mapInArrow(_expected(group), f"{_fields(rows, [*group, *FIT])}, counts array<double>")
    sums = found.select(*group, *FIT, F.posexplode("counts").alias("i", "v")).groupBy(*group, *FIT, "i").agg(F.sum("v").alias("v"))
    return sums.groupBy(*group, *FIT).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_c")).select(*group, *FIT, F.col("_c.v").alias("counts"))


def first_models(rows: DataFrame, group: Sequence[str], series: Sequence[str], x: str, ks: Sequence[int], restarts: int, seed: int, order: str = "date") -> DataFrame:
    """(group, k, restart, n, start, trans, means, vars): even starts and steps, the variance of
    the group's rows, and means at rows picked by a hash, others for every restart."""
    group, most = list(group), max(ks) * restarts
    mark = F.xxhash64(F.lit(seed), *[F.col(c).cast("string") for c in dict.fromkeys([*series, order])])
    points = rows.select(*group, F.col(x).alias("x"), mark.alias("_h")).withColumn("_p", F.row_number().over(Window.partitionBy(*group).orderBy("_h", "x")))
    points = points.where(F.col("_p") <= most).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_p", "x"))).alias("_x"))
    long = rows.select(*group, F.posexplode(x).alias("i", "v")).groupBy(*group, "i").agg(F.var_pop("v").alias("v"), F.count("v").alias("n"))
    width = long.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_v"), F.max("n").alias("n"))
    df = points.join(width, group)
    tries = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).alias("restart")) for k in ks for r in range(restarts)]))
    df = df.select(*group, "n", "_x", "_v", tries.alias("t")).select(*group, F.col("t.k").alias("k"), F.col("t.restart").alias("restart"), "n", "_x", "_v")
    place = lambda s: F.pmod(s * restarts + F.col("restart"), F.size("_x"))
    even = F.array_repeat(F.lit(1.0) / F.col("k"), F.col("k"))
    var = F.transform("_v", lambda v: F.greatest(v["v"], F.lit(FLOOR)))
    states = F.sequence(F.lit(0), F.col("k") - 1)
    return df.select(*group, *FIT, "n", even.alias("start"), F.array_repeat(F.lit(1.0) / F.col("k"), F.col("k") * F.col("k")).alias("trans"),
                     F.flatten(F.transform(states, lambda s: F.get("_x", place(s).cast("int"))["x"])).alias("means"), F.flatten(F.transform(states, lambda s: var)).alias("vars"))


def fitted(rows: DataFrame, group: Sequence[str], series: Sequence[str], x: str, ks: Sequence[int], iterations: int = 100, restarts: int = 5, seed: int = 42, tol: float = 1e-4, order: str = "date", models: DataFrame | None = None) -> DataFrame:
    """(group, k, restart, n, start, trans, means, vars, log_likelihood, done): models of every
    group, number of states and restart, fitted side by side by expectation-maximisation.

    ``x`` is an array of features; a series is keyed by (group, series), one row per ``order``.
    Every iteration joins the blocks of all series with the models that are not done, adds up
    expected counts, and lands the new models. A model is done when its likelihood gains less
    than ``tol`` a row; only the number of open models comes back to the driver.
    ``log_likelihood`` is that of the parameters before the last step.
    """
    group, series = list(group), list(series)
    rows = rows.select(*dict.fromkeys([*group, *series]), order, x)
    blocks = packed(rows, list(dict.fromkeys([*group, *series])), x, order)
    now = first_models(rows, group, series, x, ks, restarts, seed, order) if models is None else models
    now = _kept(now.withColumns({"log_likelihood": F.lit(None).cast("double"), "done": F.lit(False)}))
    kind = T.StructType([now.schema[c] for c in [*group, *FIT, "n", "start", "trans", "means", "vars", "log_likelihood", "done"]])
    for _ in range(iterations):
        live = now.where(~F.col("done"))
        if live.isEmpty():
            break
        found = expectation(blocks, live, group, series)
        asked = live.select(*group, *FIT, "n", F.coalesce("log_likelihood", F.lit(0.0)).alias("log_likelihood"), F.col("log_likelihood").isNull().alias("none"), "means", "vars").join(found, [*group, *FIT])
        now = _kept(now.where("done").select(*kind.names).union(asked.mapInPandas(_updated(group, tol), kind)))
    return now


def best_restart(models: DataFrame, group: Sequence[str]) -> DataFrame:
    """The restart of highest likelihood per group and number of states."""
    rest = [c for c in models.columns if c not in (*group, "k")]
    return models.groupBy(*group, "k").agg(F.max_by(F.struct(*rest), F.struct("log_likelihood", -F.col("restart"))).alias("_m")).select(*group, "k", "_m.*")
