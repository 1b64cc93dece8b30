"""Disclosure filters, committee rules, clusters and event exclusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline import config as cfg
from barline.functions import scalars as S
from barline.functions.series import first_per_key, over, so_far
from barline.operators.joins import append_missing, asof_join


def with_measures(df: DataFrame) -> DataFrame:
    """Lag in days and lower bound of the amount bracket."""
    return df.withColumns({
        "lag_days": S.lag_days(F.col("transaction_date"), F.col("disclosure_date")),
        "amount_min_usd": S.amount_floor(F.col("amount_range")),
    })


def raw_signals(df: DataFrame, u: cfg.Universe = cfg.UNIVERSE, conviction: int = 65, pct: float = 5.0) -> DataFrame:
    """Large, timely buys as signals on their disclosure date."""
    return (
        with_measures(df)
        .where((F.col("transaction_type") == "buy") & (F.col("amount_min_usd") >= u.min_trade_usd)
               & F.col("lag_days").between(0, u.max_lag_days))
        .select("id", F.col("disclosure_date").alias("date"), "ticker", F.lit(conviction).alias("conviction"),
                F.lit(pct).alias("position_pct"), "politician")
    )


def windowed_signals(df: DataFrame, start: str, end: str, u: cfg.Universe = cfg.UNIVERSE) -> DataFrame:
    """Text-dated trades inside a window; a given lag wins over the computed one."""
    computed = F.datediff(F.col("disclosure_date").try_cast("date"), F.col("transaction_date").try_cast("date"))
    lag = F.coalesce(F.col("lag"), computed) if "lag" in df.columns else computed
    return (
        df.where(
            F.lower("transaction_type").isin("purchase", "buy")
            & F.upper("ticker").rlike("^[A-Z]{1,5}$")
            & F.col("disclosure_date").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
            & F.col("disclosure_date").between(start, end)
        )
        .withColumns({"lag_days": lag, "amount_min_usd": S.amount_floor_suffix(F.col("amount_range"))})
        .where((F.col("amount_min_usd") >= u.min_trade_usd) & F.col("lag_days").between(0, u.max_lag_days))
        .select("id", F.col("disclosure_date").alias("date"), F.upper("ticker").alias("ticker"), "politician", "lag_days")
    )


def in_universe(df: DataFrame, universe: DataFrame) -> DataFrame:
    clean = universe.select(S.normalize_ticker(F.col("ticker")).alias("_u")).distinct()
    return df.join(clean, S.normalize_ticker(F.col("ticker")) == F.col("_u"), "left_semi")


def rule_array(rules: Sequence[tuple[str, Sequence[str]]] = cfg.COMMITTEE_RULES) -> Column:
    """The ordered rules as one array literal: no join is needed to apply them."""
    return F.array(*[F.struct(F.lit(k.lower()).alias("k"), F.array(*[F.lit(s) for s in v]).alias("s")) for k, v in rules])


def covered_sectors(members: DataFrame, rules: Sequence[tuple[str, Sequence[str]]] = cfg.COMMITTEE_RULES) -> DataFrame:
    """(politician, sector) pairs: the first rule whose key is part of the committee name decides."""
    hit = F.filter(rule_array(rules), lambda r: F.contains(F.lower("committee"), r["k"]))
    return (
        members.where("committee IS NOT NULL")
        .select("politician", F.explode(F.try_element_at(hit, F.lit(1))["s"]).alias("sector"))
        .distinct()
    )


def name_keys(name: Column) -> dict[str, Column]:
    """Lower-case name, and its first and last token with trailing suffixes dropped."""
    full = F.lower(F.trim(name))
    parts = F.split(full, r"\s+")
    ok = lambda x: ~F.rtrim(F.regexp_replace(x, r"\.+$", "")).isin(cfg.NAME_SUFFIXES)
    size = F.array_max(F.transform(parts, lambda x, i: F.when(ok(x), i + 1).otherwise(0)))
    return {
        "_full": full,
        "_first": F.when(size >= 2, parts[0]),
        "_last": F.when(size >= 2, F.try_element_at(F.filter(parts, ok), F.lit(-1))),
    }


def match_politicians(people: DataFrame, reference: DataFrame) -> DataFrame:
    """Attach the reference entry: exact name, else the first loaded entry with the same
    first and last token. ``reference`` has (name, load_order) and payload columns."""
    ref = reference.withColumns(name_keys(F.col("name")))
    payload = [c for c in reference.columns]
    exact = first_per_key(ref.select("_full", *payload), ["_full"], ["load_order"])
    loose = first_per_key(ref.where("_last IS NOT NULL").select("_first", "_last", *payload), ["_first", "_last"], ["load_order"])
    keyed = people.withColumns(name_keys(F.col("politician")))
    hit = keyed.join(exact, "_full").withColumn("matched", F.lit("exact"))
    rest = keyed.join(exact, "_full", "left_anti").join(loose, ["_first", "_last"]).withColumn("matched", F.lit("tokens"))
    cols = [*people.columns, *payload, "matched"]
    return hit.select(*cols).unionByName(rest.select(*cols))


def qualified(
    df: DataFrame, universe: DataFrame, members: DataFrame, sectors: DataFrame,
    rules: Sequence[tuple[str, Sequence[str]]] = cfg.COMMITTEE_RULES, u: cfg.Universe = cfg.UNIVERSE,
) -> DataFrame:
    """Timely large buys in the universe by a politician whose committees cover the sector."""
    base = with_measures(df).where(
        (F.col("transaction_type") == "buy") & (F.col("amount_min_usd") >= u.min_trade_usd)
        & F.col("lag_days").between(0, u.max_lag_days)
    )
    return (
        in_universe(base, universe)
        .join(sectors.select("ticker", "sector"), "ticker", "left")
        .withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
        .join(covered_sectors(members, rules), ["politician", "sector"], "left_semi")
    )


def cluster_counts(df: DataFrame, days: int = 30) -> DataFrame:
    """Distinct politicians with a buy of the same ticker in the trailing ``days``.

    A buy keeps its politician counted for ``days`` days. Per (ticker, politician) only
    the ends of each covered stretch matter: +1 where it begins, -1 after it ends. The
    running sum per ticker and date is the distinct count, so no pair of disclosures is
    ever formed and a hot ticker costs one row per date.
    """
    buys = df.where("transaction_type = 'buy'").select("ticker", "politician", F.col("disclosure_date").alias("d")).distinct()
    w = Window.partitionBy("ticker", "politician").orderBy("d")
    gap = lambda a, b: F.coalesce(F.datediff(a, b) > days, F.lit(True))
    marks = buys.select("ticker", "d", gap(F.col("d"), F.lag("d").over(w)).alias("opens"), gap(F.lead("d").over(w), F.col("d")).alias("shuts"))
    ends = F.explode(F.filter(F.array(
        F.when(F.col("opens"), F.struct(F.col("d").alias("date"), F.lit(1).alias("delta"))),
        F.when(F.col("shuts"), F.struct(F.date_add("d", days + 1).alias("date"), F.lit(-1).alias("delta"))),
    ), lambda x: x.isNotNull()))
    steps = marks.select("ticker", ends.alias("e")).groupBy("ticker", "e.date").agg(F.sum("e.delta").alias("delta"))
    counts = steps.select("ticker", "date", F.sum("delta").over(so_far(over("ticker"))).alias("cluster_count"))
    out = asof_join(df, counts, ["ticker"], "disclosure_date", "date", ["cluster_count"], how="left")
    return out.withColumn("cluster_count", F.coalesce("cluster_count", F.lit(0).cast("bigint")))


def blocked_days(events: DataFrame, keys: Sequence[str], reason: str, days: int) -> DataFrame:
    """An event blocks its own date and the ``days`` before it; the nearest event is named."""
    span = F.explode(F.sequence(F.date_sub("event_date", days), F.col("event_date"))).alias("date")
    return (
        events.select(*keys, "event_date", span).groupBy(*keys, "date")
        .agg(F.concat(F.lit(f"{reason} "), F.min("event_date").cast("string")).alias(f"_{reason}"))
    )


def upcoming_event(df: DataFrame, fomc: DataFrame, earnings: DataFrame, days: int = cfg.UNIVERSE.event_window_days) -> DataFrame:
    """Reason text where an event is near; the central-bank meeting outranks earnings."""
    f, e = blocked_days(fomc, [], "FOMC", days), blocked_days(earnings, ["ticker"], "earnings", days)
    out = df.join(f, "date", "left").join(e, ["ticker", "date"], "left")
    return out.withColumn("reason", F.coalesce("_FOMC", "_earnings", F.lit(""))).drop("_FOMC", "_earnings")


def on_sessions(df: DataFrame, calendar: DataFrame) -> DataFrame:
    return df.join(calendar.select("date").distinct(), "date", "left_semi")


def lag_variants(signals: DataFrame, limits: Sequence[int] = cfg.LAG_VARIANTS) -> DataFrame:
    """One copy per threshold the lag meets, in one pass."""
    fits = F.filter(F.array(*[F.lit(x) for x in limits]), lambda x: F.col("lag_days") <= x)
    return signals.withColumn("max_lag", F.explode(fits))


def merged_variants(factor: DataFrame, congress: DataFrame, limits: Sequence[int] = cfg.LAG_VARIANTS) -> DataFrame:
    """Per variant: all factor signals plus the congress signals they lack."""
    every = factor.withColumn("max_lag", F.explode(F.array(*[F.lit(x) for x in limits])))
    return append_missing(every, lag_variants(congress, limits), ["max_lag", "date", "ticker"])


def tag_signal_type(df: DataFrame, other: DataFrame, own: str) -> DataFrame:
    """``both`` where the ticker is in the other list, else its own kind."""
    o = other.select("ticker").distinct().withColumn("_o", F.lit(True))
    return df.join(o, "ticker", "left").withColumn(
        "signal_type", F.when(F.col("_o"), "both").otherwise(own)).drop("_o")


def most_signalled(signals: DataFrame, n: int = 60, order: str = "date") -> DataFrame:
    """Top tickers by number of signals; ties go to the one seen first."""
    return (
        signals.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_signals"), F.min(order).alias("first_seen"))
        .orderBy(F.desc("n_signals"), "first_seen", "ticker").limit(n)
    )
