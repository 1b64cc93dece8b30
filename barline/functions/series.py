"""Window expressions over ordered series.

A series is one key (ticker, market, portfolio) with one row per date, so a window
partition never holds more rows than the calendar has days; sources that could break
this are aggregated to (key, date) before they get here.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def over(keys: Sequence[str] | str, order: str = "date", desc: bool = False) -> WindowSpec:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return Window.partitionBy(*keys).orderBy(F.col(order).desc() if desc else F.col(order))


def trailing(w: WindowSpec, rows: int) -> WindowSpec:
    return w.rowsBetween(-(rows - 1), 0)


def full(x: Column, w: WindowSpec, rows: int, fn, least: int | None = None) -> Column:
    """fn over the last ``rows`` values; null until ``least`` (default all) are present."""
    frame = trailing(w, rows)
    return F.when(F.count(x).over(frame) >= (least or rows), fn(x).over(frame))


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def ewm(df: DataFrame, series: Sequence[tuple[str, str, float]], key: str = "ticker", order: str = "date") -> DataFrame:
    """Recursive exponential means seeded with the first value, without a recursion.

    ``series`` lists (value column, output column, alpha). y[t] = (1-a) y[t-1] + a x[t] is
    linear, so a block of rows needs only its own weighted sum plus the value carried in.
    Series whose decays are alike share windows. Their blocks are as long as the weights fit
    a double, and as many earlier blocks are carried as can reach one: the result is that of
    the recursion over the whole history. Leading nulls give null; a later null fails.
    """
    decay = {out: -math.log1p(-a) if a < 1 else math.inf for _, out, a in series}
    groups: list[list[tuple[str, str, float]]] = []
    for one in sorted(series, key=lambda x: decay[x[1]]):
        if groups and decay[one[1]] <= 8 * decay[groups[-1][0][1]] and decay[one[1]] < math.inf:
            groups[-1].append(one)
        else:
            groups.append([one])
    for group in groups:
        if decay[group[0][1]] == math.inf:
            df = df.withColumns({out: F.col(value) for value, out, _ in group})
        else:
            df = _ewm(df, group, key, order, decay)
    return df


def _ewm(df: DataFrame, series: list[tuple[str, str, float]], key: str, order: str, decay: dict[str, float]) -> DataFrame:
    low, high = decay[series[0][1]], decay[series[-1][1]]
    block = max(1, int(500 / high))
    carried_blocks = 1 + math.ceil(700 / (block * low))
    w = over(key, order)
    inner, ends = Window.partitionBy(key, "_blk").orderBy(order), Window.partitionBy(key).orderBy("_blk")
    df = df.withColumns({"_row": F.row_number().over(w) - 1, **{f"_n{i}": F.count(v).over(so_far(w)) for i, (v, _, _) in enumerate(series)}})
    df = df.withColumns({"_blk": F.floor(F.col("_row") / block), "_pos": (F.col("_row") % block).cast("double")})

    def local(i: int, value: str, alpha: float) -> Column:
        gap = F.when(F.col(f"_n{i}") > 0, F.raise_error(F.lit(f"{value}: a null inside the series")).cast("double")).otherwise(F.lit(0.0))
        share = F.when(F.col(value).isNull(), gap).when(F.col(f"_n{i}") == 1, F.col(value)).otherwise(F.col(value) * alpha)
        grown = share * F.pow(F.lit(1.0 - alpha), -F.col("_pos"))
        return F.sum(grown).over(so_far(inner)) * F.pow(F.lit(1.0 - alpha), F.col("_pos"))

    def whole(i: int, alpha: float) -> Column:
        last, step = F.when(F.col("_pos") == block - 1, F.col(f"_loc{i}")), (1.0 - alpha) ** block
        carry = F.lit(0.0)
        for b in range(carried_blocks, 0, -1):
            carry = carry * step + F.coalesce(F.max(last).over(ends.rangeBetween(-b, -b)), F.lit(0.0))
        return F.when(F.col(f"_n{i}") > 0, F.col(f"_loc{i}") + F.pow(F.lit(1.0 - alpha), F.col("_pos") + 1.0) * carry)

    df = df.withColumns({f"_loc{i}": local(i, v, a) for i, (v, _, a) in enumerate(series)})
    df = df.withColumns({out: whole(i, a) for i, (_, out, a) in enumerate(series)})
    return df.drop("_row", "_blk", "_pos", *[f"_{c}{i}" for i in range(len(series)) for c in ("n", "loc")])


def rolling_means(df: DataFrame, value: str, sizes: dict[str, int], key: str = "ticker", order: str = "date", places: int = 8) -> DataFrame:
    """Means over the last n rows from one running sum; null until n rows are there.

    A sliding frame adds up its n rows again for every row; a difference of running sums
    costs the same for any n. The sums are whole multiples of 10**-places, so they are exact
    on a history of any length and a flat series has equal means. A null ``value`` fails, and
    so does a sum beyond 64 bits (about 9e10 at eight places).
    """
    w, unit = over(key, order), 10**places
    none = F.raise_error(F.lit(f"{value}: a null inside the series")).cast("bigint")
    whole = F.when(F.col(value).isNull(), none).otherwise(F.round(F.col(value) * unit).cast("bigint"))
    df = df.withColumns({"_sum": F.sum(whole).over(so_far(w)), "_row": F.row_number().over(w)})
    part = lambda n: (F.col("_sum") - F.coalesce(F.lag("_sum", n).over(w), F.lit(0))) / n / unit
    return df.withColumns({out: F.when(F.col("_row") >= n, part(n)) for out, n in sizes.items()}).drop("_sum", "_row")


def rolling_extremes(df: DataFrame, value: str, rows: int, high: str, low: str, key: str = "ticker", order: str = "date") -> DataFrame:
    """Greatest and least value of the last ``rows`` rows (fewer at the start).

    Rows are cut into blocks of that length. A frame covers the end of one block and the
    start of the next, so two running extremes per block, one from each side, give it in
    constant work per row.
    """
    w = over(key, order)
    df = df.withColumn("_blk", F.floor((F.row_number().over(w) - 1) / rows))
    ahead, behind = Window.partitionBy(key, "_blk").orderBy(order), Window.partitionBy(key, "_blk").orderBy(F.col(order).desc())
    df = df.withColumns({"_ah": F.max(value).over(so_far(ahead)), "_al": F.min(value).over(so_far(ahead))})
    df = df.withColumns({"_bh": F.max(value).over(so_far(behind)), "_bl": F.min(value).over(so_far(behind))})
    return df.withColumns({
        high: F.greatest("_ah", F.lag("_bh", rows - 1).over(w)), low: F.least("_al", F.lag("_bl", rows - 1).over(w)),
    }).drop("_blk", "_ah", "_al", "_bh", "_bl")


def avg_tie_pct_rank(value: str, within: Sequence[str]) -> Column:
    """Percentile rank with average ties over the non-null values; null stays null."""
    w = Window.partitionBy(*within).orderBy(F.col(value).asc_nulls_last())
    peers = w.rangeBetween(Window.currentRow, Window.currentRow)
    n = F.count(value).over(Window.partitionBy(*within))
    return F.when(F.col(value).isNotNull(), (F.rank().over(w) + (F.count(value).over(peers) - 1) / 2) / n)


def latest(df: DataFrame, keys: Sequence[str] | str, order: Sequence[str] | str = "date") -> DataFrame:
    """Last row per key by an aggregate, so rows combine before the shuffle."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key, by aggregate: a key with very many copies stays cheap."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
    )


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Place rows by key for a grouped function, keeping the session's number of tasks.

    Adaptive execution merges small shuffle partitions by bytes; a grouped Python function
    costs far more per byte than that assumes, and would end up in one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
