"""Sizing chain, order rules, allocation, hedges, correlation and circuit breakers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline import config as cfg
from barline.functions import scalars as S
from barline.functions.series import over, so_far


# ---- book ----
def position_values(positions: DataFrame) -> DataFrame:
    return positions.withColumn("value", F.col("qty") * F.col("price"))


def nav_snapshot(positions: DataFrame, cash: float) -> DataFrame:
    """One row: cash, value of positions, their sum, and the invested share in percent."""
    g = position_values(positions).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("positions_value"))
    nav = F.lit(float(cash)) + F.col("positions_value")
    share = F.when(nav > 0, F.try_divide("positions_value", nav) * 100).otherwise(0.0)
    return g.select(F.lit(float(cash)).alias("cash"), "positions_value", nav.alias("total_nav"), share.alias("invested_pct"))


def sector_allocation(positions: DataFrame, sectors: DataFrame, cash: float, exclude: str | None = None) -> DataFrame:
    """Percent of NAV per sector. NAV counts every position, also those of an excluded source.

    Positions are summed per sector first; the total then runs over the sectors only.
    """
    rows = position_values(positions).join(sectors, "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    counted = F.lit(True) if exclude is None else ~F.col("signal_source").eqNullSafe(exclude)
    g = rows.groupBy("sector").agg(F.sum("value").alias("_all"), F.sum(F.when(counted, F.col("value"))).alias("_own"))
    nav = F.lit(float(cash)) + F.sum("_all").over(Window.partitionBy(F.lit(0)))
    return g.withColumn("pct", F.try_divide("_own", nav) * 100).where("pct IS NOT NULL").select("sector", "pct")


# ---- order rules ----
def entry_veto(state: Column) -> Column:
    """Struct (allowed, size_multiplier) for a risk state."""
    blocked = state.isin(cfg.BLOCKED_STATES)
    mult = F.when(blocked, 0.0).when(state == "sizes_reduced", 0.5).otherwise(1.0)
    return F.struct((~blocked).alias("allowed"), mult.alias("size_multiplier"))


def order_reason(pct: Column | None = None, order_usd: Column | None = None, risk: cfg.Risk = cfg.RISK) -> Column:
    """First rule an order breaks, or null. Reads stale, state, sector, sector_pct,
    invested_pct and adv_usd; hedges are exempt from the liquidity rule."""
    c = F.col
    pct, order_usd = c("pct") if pct is None else pct, c("order_usd") if order_usd is None else order_usd
    adv = F.coalesce(c("adv_usd"), F.lit(0.0))
    return (
        F.when(c("stale"), "stale_data")
        .when(c("state").isin(cfg.BLOCKED_STATES), F.concat(F.lit("state:"), c("state")))
        .when(pct > risk.max_position_pct, "size_cap")
        .when(F.coalesce(c("sector_pct"), F.lit(0.0)) + pct > risk.max_sector_pct, "sector_cap")
        .when(c("invested_pct") + pct > risk.max_invested_pct, "invested_cap")
        .when((adv > 0) & (F.try_divide(order_usd, adv) * 100 > risk.max_adv_pct), "adv_cap")
        .when((adv <= 0) & (c("sector") != "Hedge"), "no_adv")
    )


def is_sector_capped(pct: Column, cap: float = cfg.RISK.max_sector_pct) -> Column:
    return F.coalesce(pct, F.lit(0.0)) >= cap


def is_liquid(order_usd: Column, adv: Column, most: float = 10.0) -> Column:
    return F.coalesce((adv > 0) & (F.try_divide(order_usd, adv) * 100 <= most), F.lit(False))


def in_drawdown(peak: Column, nav: Column, most: float = 10.0) -> Column:
    return F.coalesce((peak > 0) & (F.try_divide(peak - nav, peak) * 100 >= most), F.lit(False))


def stale_data(bars: DataFrame, as_of: str, most: int = cfg.RISK.max_stale_days) -> DataFrame:
    g = bars.agg(F.max("date").alias("latest"))
    days = F.datediff(F.lit(as_of).cast("date"), F.col("latest"))
    return g.select("latest", days.alias("staleness_days"), (days > most).alias("stale"))


# ---- allocation ----
def _scaled(base: Column, risk: cfg.Risk, a: cfg.Allocation) -> Column:
    """Base size times regime, confidence, stability and season, within 0 and the cap;
    zero where confidence is low or the result is below the minimum."""
    product = (
        base * S.regime_multiplier(F.col("regime_label")) * S.confidence_multiplier(F.col("confidence"))
        * F.when(F.col("is_stable"), 1.0).otherwise(a.instability_penalty) * S.season_multiplier(F.col("date"))
    )
    gate = F.col("confidence") >= a.min_confidence
    return S.let(
        F.greatest(F.least(product, F.lit(risk.max_position_pct)), F.lit(0.0)),
        lambda x: F.when(gate & (x >= a.min_economic_pct), x).otherwise(0.0),
    )


def allocate(df: DataFrame, base: str = "base_pct", risk: cfg.Risk = cfg.RISK, a: cfg.Allocation = cfg.ALLOCATION) -> DataFrame:
    """Regime scaling of a base size, with the multipliers it used."""
    ok = F.col("final_pct") > 0
    part = lambda x: F.when(ok, x).otherwise(0.0)
    return df.withColumn("final_pct", _scaled(F.col(base), risk, a)).withColumns({
        "regime_multiplier": part(S.regime_multiplier(F.col("regime_label"))),
        "confidence_multiplier": part(S.confidence_multiplier(F.col("confidence"))),
        "stability_multiplier": part(F.when(F.col("is_stable"), 1.0).otherwise(a.instability_penalty)),
        "seasonal_multiplier": F.when(ok, S.season_multiplier(F.col("date"))).otherwise(1.0),
    })


def size_candidates(df: DataFrame, s: cfg.Sizing = cfg.SIZING, risk: cfg.Risk = cfg.RISK, a: cfg.Allocation = cfg.ALLOCATION) -> DataFrame:
    """The full chain over a table of candidates: final size, and the stage that rejected it.

    One row expression; nothing is joined or shuffled here.
    """
    c = F.col
    gated = c("invalidation_price").isNotNull()
    bad_technical = gated & ((c("entry") != "buy") | (c("reward_risk") < s.min_reward_risk) | (c("invalidation_price") >= c("entry_price")))
    base = F.when(gated, S.structure_stop_pct(c("entry_price"), c("invalidation_price"))).otherwise(
        S.vol_target_pct(F.coalesce(c("atr_pct"), F.lit(s.atr_fallback_pct))))
    df = df.withColumn("conviction", S.clamp(c("score_conviction") + c("ma_delta"), 1, 10).cast("int"))
    df = df.withColumn("base_pct", S.conviction_tilt(base, c("conviction")))
    low = lambda x: x < a.min_economic_pct

    def outcome(regime: Column, corr: Column, pct: Column) -> Column:
        last = pct * entry_veto(c("state"))["size_multiplier"]
        veto = order_reason(pct, c("nav") * pct / 100, risk)
        stage = (
            F.when(bad_technical, "technical").when(low(regime), "regime").when(low(corr), "correlation")
            .when(low(pct), "portfolio_vol").when(veto.isNotNull(), F.concat(F.lit("risk:"), veto)).when(low(last), "risk_state")
        )
        return F.struct(stage.alias("rejected_by"), last.alias("pct"))

    def after_correlation(regime: Column) -> Column:
        capped = F.when(c("signal_type") == "congressional", F.least(regime, F.lit(a.congress_cap_pct))).otherwise(regime)
        cut = capped * S.correlation_multiplier(F.coalesce(c("max_rho"), F.lit(0.0)))
        return S.let(cut, lambda corr: S.let(corr * c("port_vol_mult"), lambda pct: outcome(regime, corr, pct)))

    df = df.withColumn("_o", S.let(_scaled(c("base_pct"), risk, a), after_correlation))
    return df.withColumns({
        "rejected_by": c("_o.rejected_by"), "final_pct": F.when(c("_o.rejected_by").isNull(), c("_o.pct")).otherwise(0.0),
    }).drop("_o")


def admit(sized: DataFrame, open_count: int, keys: Sequence[str], order: Sequence[str], risk: cfg.Risk = cfg.RISK, congress_per_day: int = 1) -> DataFrame:
    """Slot limits per day, in rank order; ``keys`` is the day.

    Set-based: candidates are ranked and the running sector sum is held against the cap.
    It differs from opening orders one by one when a rejected candidate would have left
    room for a later one. Ranks run on accepted candidates of one day.
    """
    slots = max(0, min(risk.max_per_day, risk.max_positions - open_count))
    ok = sized.where("rejected_by IS NULL")
    day = Window.partitionBy(*keys).orderBy(*order)
    per_type = Window.partitionBy(*keys, "signal_type").orderBy(*order)
    sector = Window.partitionBy(*keys, "sector").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    fits = F.coalesce("sector_pct", F.lit(0.0)) + F.sum("final_pct").over(sector) <= risk.max_sector_pct
    ranked = ok.withColumn("_fits", fits).where("_fits").withColumn("_nth", F.row_number().over(per_type))
    ranked = ranked.where((F.col("signal_type") != "congressional") | (F.col("_nth") <= congress_per_day))
    return ranked.withColumn("slot", F.row_number().over(day)).where(F.col("slot") <= slots).drop("_fits", "_nth")


# ---- correlation ----
GRAM_DAYS, GRAM_SIDE = 64, 128
MOMENTS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def _day_blocks(rows: DataFrame, name: str) -> DataFrame:
    """(name, block, days, rets): a row per name and block of days with the returns there are."""
    day = F.unix_date("date")
    rows = rows.where("ret IS NOT NULL AND NOT isnan(ret)").select(F.col("ticker").alias(name), F.floor(day / GRAM_DAYS).cast("int").alias("block"), F.pmod(day, F.lit(GRAM_DAYS)).alias("day"), "ret")
    rows = rows.groupBy(name, "block").agg(F.collect_list(F.struct("day", "ret")).alias("_r"))
    return rows.select(name, "block", F.col("_r.day").alias("days"), F.col("_r.ret").alias("rets"))


def _matrix(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Names x days: the returns, 0 where there is none, and 1 where there is one."""
    x, there = np.zeros((2, len(rows), GRAM_DAYS))
    for i, (days, rets) in enumerate(zip(rows["days"], rows["rets"])):
        x[i, days], there[i, days] = rets, 1.0
    return x, there


def pair_moments(candidates: DataFrame, holdings: DataFrame) -> DataFrame:
    """(ticker, holding, n, sx, sy, sxx, syy, sxy): sums over the days that both have.

    Both sides are (ticker, date, ret), unique on (ticker, date). Days are cut into blocks and
    names into groups; a task multiplies the matrices of a group of candidates and a group of
    holdings over a block of days, so there is a row per pair and block of days, not per pair
    and day. Both sides are counted first, which gives the number of groups: a row is sent
    once per group of the other side, and no task holds more than 64 days of a group.
    """
    named = [df.select("ticker").distinct().select(F.lit(side).alias("side")) for side, df in enumerate((candidates, holdings))]
    counted = {r["side"]: r["count"] for r in named[0].union(named[1]).groupBy("side").count().collect()}
    sides = []
    for side, (rows, name) in enumerate(((candidates, "ticker"), (holdings, "holding"))):
        groups = -(-counted.get(side, 0) // GRAM_SIDE) or 1
        sides.append((_day_blocks(rows, name).withColumn(f"_{name}", F.pmod(F.xxhash64(name), F.lit(groups)).cast("int")), groups))
    (c, nc), (h, nh) = sides
    every = lambda df, col, n: df.withColumn(col, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    keys = ["block", "_ticker", "_holding"]
    kind = lambda df, name: df.schema[name].dataType.simpleString()
    schema = f"ticker {kind(c, 'ticker')}, holding {kind(h, 'holding')}, " + ", ".join(f"{m} double" for m in MOMENTS)

    def multiply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        (x, mx), (y, my) = _matrix(left), _matrix(right)
        sums = [mx @ my.T, x @ my.T, mx @ y.T, (x * x) @ my.T, mx @ (y * y).T, x @ y.T]
        i, j = np.nonzero(sums[0])
        named = {"ticker": left["ticker"].to_numpy()[i], "holding": right["holding"].to_numpy()[j]}
        return pd.DataFrame(named | {m: s[i, j] for m, s in zip(MOMENTS, sums)})

    blocks = every(c, "_holding", nh).groupBy(*keys).cogroup(every(h, "_ticker", nc).groupBy(*keys)).applyInPandas(multiply, schema)
    return blocks.groupBy("ticker", "holding").agg(*[F.sum(m).alias(m) for m in MOMENTS])


def max_correlation(candidates: DataFrame, holdings: DataFrame, c: cfg.Correlation = cfg.CORRELATION, as_of: Column | str | None = None, days: int | None = None) -> DataFrame:
    """Highest return correlation of each candidate with a holding, floored at 0, and its multiplier.

    Both sides are (ticker, date, ret); with ``as_of`` and ``days``, of the days from ``days``
    before that date to it. Pairs with fewer than ``min_overlap`` common days, or with a side
    whose returns there are constant (deviation below a millionth of their size), do not
    count; a candidate without any has no correlation and the multiplier 1. A missing return is
    no day; tables may be empty.
    """
    if as_of is not None:
        end = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
        candidates, holdings = (df.where(F.col("date").between(F.date_sub(end, days), end)) for df in (candidates, holdings))
    n, col = F.col("n"), F.col
    spread = lambda s, ss: S.let(n * col(ss) - col(s) * col(s), lambda v: F.when(v > 1e-12 * n * col(ss), v))
    pairs = pair_moments(candidates, holdings).where(n >= c.min_overlap)
    rho = (n * col("sxy") - col("sx") * col("sy")) / F.sqrt(spread("sx", "sxx")) / F.sqrt(spread("sy", "syy"))
    valid = pairs.select("ticker", rho.alias("rho")).where("rho IS NOT NULL")
    top = valid.groupBy("ticker").agg(F.greatest(F.max("rho"), F.lit(0.0)).alias("max_rho"), F.count(F.lit(1)).alias("n_pairs"))
    every = candidates.select("ticker").distinct().join(top, "ticker", "left")
    return every.withColumn("corr_mult", F.when(F.col("max_rho").isNull(), 1.0).otherwise(S.correlation_multiplier(F.col("max_rho"), c.threshold)))


# ---- hedges ----
def hedge_plan(states: DataFrame, open_positions: DataFrame, allocation: DataFrame, risk: cfg.Risk = cfg.RISK) -> DataFrame:
    """Inverse funds to open per regime state row: not open yet, no conflict, equal weights under the caps."""
    funds = F.array(*[F.struct(F.lit(k).alias("ticker"), (F.array(*[F.lit(s) for s in v]) if v else F.array().cast("array<string>")).alias("conflicts"))
                      for k, v in cfg.INVERSE_FUNDS.items()])
    rows = states.withColumn("_max", F.try_element_at(S.literal_map(cfg.MAX_INVERSE_PCT), F.col("regime_label"))).where("_max IS NOT NULL")
    keys = states.columns
    rows = rows.withColumn("_f", F.explode(funds)).select(*keys, "_max", "_f.*")
    held = open_positions.where("signal_source = 'hedge'").select("ticker").distinct()
    crowded = allocation.where(F.col("pct") > risk.hedge_conflict_pct).select("sector")
    bad = rows.select("ticker", F.explode("conflicts").alias("sector")).distinct().join(crowded, "sector", "left_semi").select("ticker").distinct()
    ok = rows.join(held, "ticker", "left_anti").join(bad, "ticker", "left_anti")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return ok.withColumn("position_pct", F.least(F.col("_max") / n, F.lit(risk.hedge_single_pct))).select(*keys, "ticker", "position_pct")


def hedge_exits(open_positions: DataFrame) -> DataFrame:
    """Open rows that a hedge opened: all are to be closed when the regime no longer asks for one."""
    return open_positions.where("signal_source = 'hedge'")


# ---- positions ----
def fold_positions(events: DataFrame) -> DataFrame:
    """Current row per ticker from the change events after its last deletion: peak only
    rises, last share count, flag once set stays. A ticker without later events is gone.
    Aggregates only, so a hot ticker is no problem."""
    gone = F.coalesce("deleted", F.lit(False))
    last = events.groupBy("ticker").agg(F.max(F.when(gone, F.col("seq"))).alias("_end"))
    open_now = events.where(~gone).join(last, "ticker").where("_end IS NULL OR seq > _end")
    return open_now.groupBy("ticker").agg(
        F.max("price").alias("peak_price"), F.max_by("shares", F.when(F.col("shares").isNotNull(), F.col("seq"))).alias("shares"),
        F.coalesce(F.bool_or("take_profit"), F.lit(False)).alias("take_profit_taken"))


def insert_positions(incoming: DataFrame, stored: DataFrame, key: str = "ticker", order: Sequence[str] = ()) -> DataFrame:
    """All incoming rows with ``accepted``: refused where the key is already open. Of several
    incoming rows of one key the first by ``order`` (default: all columns) is accepted."""
    have = stored.select(key).distinct().withColumn("_have", F.lit(True))
    by = list(order) or [c for c in incoming.columns if c != key]
    first = Window.partitionBy(key).orderBy(*by)
    accepted = F.col("_have").isNull() & (F.row_number().over(first) == 1)
    return incoming.join(have, key, "left").withColumn("accepted", accepted).drop("_have")


def partial_close(positions: DataFrame, fraction: float = 0.5, commission_per_share: float = 0.0) -> DataFrame:
    """Closed and residual rows; the entry commission is shared by filled over held."""
    filled = F.col("shares") * fraction
    fee = F.when(F.col("shares") > 0, F.coalesce("entry_commission", F.lit(0.0)) * filled / F.col("shares")).otherwise(0.0)
    pnl = S.realized_pnl(F.col("entry_price"), F.col("price"), filled, filled * commission_per_share, fee)
    legs = F.explode(F.array(
        F.struct(F.lit("closed").alias("leg"), filled.alias("leg_shares"), pnl.alias("realized_pnl")),
        F.struct(F.lit("open").alias("leg"), (F.col("shares") - filled).alias("leg_shares"), F.lit(None).cast("double").alias("realized_pnl")),
    ))
    return positions.withColumn("_l", legs).select(*positions.columns, "_l.*")


def ghost_fills(ghosts: DataFrame, orders: DataFrame) -> DataFrame:
    """First filled sell of each ghost ticker; without one the outcome is unknown."""
    sells = orders.where("side = 'sell' AND status = 'filled'").groupBy("ticker").agg(
        F.min_by(F.struct("price", "filled_qty", "order_id"), "seq").alias("_o"))
    return ghosts.join(sells, "ticker", "left").select(
        *ghosts.columns, F.col("_o.order_id").alias("order_id"), F.col("_o.price").alias("exit_price"), F.col("_o.filled_qty").alias("exit_qty"),
        F.when(F.col("_o").isNull(), "unknown").otherwise("reconcile_fill").alias("outcome"))


def forced_close(positions: DataFrame, keep: str | None = "hedge") -> DataFrame:
    return positions if keep is None else positions.where(~F.col("signal_source").eqNullSafe(keep))


# ---- response checks ----
def checked_entries(responses: DataFrame, column: str = "response") -> DataFrame:
    """Entry answers with ``valid``: conviction rounds half-even into 1..10, known entry, all fields there."""
    got = F.from_json(column, "conviction string, position_pct string, rationale string, entry string, risk_flags array<string>")
    df = responses.withColumn("_r", got)
    conviction = F.bround(F.col("_r.conviction").try_cast("double"), 0)
    pct = F.col("_r.position_pct").try_cast("double")
    ok = conviction.between(1, 10) & F.col("_r.entry").isin("buy", "skip") & pct.isNotNull() & F.col("_r.rationale").isNotNull()
    return df.withColumns({"valid": F.coalesce(ok, F.lit(False)), "conviction": conviction.cast("int"), "position_pct": pct, "entry": F.col("_r.entry"), "rationale": F.col("_r.rationale")}).drop("_r")


def checked_technical(df: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Reward:risk recomputed from stop < last < target; a buy that does not agree becomes skip."""
    stop, last, target = F.col("invalidation_price"), F.col("last_close"), F.col("target_price")
    geometry = (stop > 0) & (stop < last) & (last < target)
    ratio = F.when(geometry, F.try_divide(target - last, last - stop)).otherwise(0.0)
    agrees = geometry & (F.abs(ratio - F.col("reported")) <= tolerance * F.greatest(F.abs(ratio), F.lit(1e-9)))
    bad = (F.col("entry") == "buy") & ~agrees
    return df.withColumns({"reward_risk": F.when(bad, 0.0).otherwise(ratio), "checked_entry": F.when(bad, "skip").otherwise(F.col("entry"))})


# ---- circuit breakers, batch ----
SEVERITY = {"normal": 0, "sizes_reduced": 1, "entries_halted": 2, "deleverage": 3}


def breaker_states(obs: DataFrame, risk: cfg.Risk = cfg.RISK, key: str = "portfolio_id", time: str = "ts") -> DataFrame:
    """Risk state after each NAV observation.

    Baselines come from aggregates per day and per week; running values run over days.
    Only the severity within one day needs the observations in order, so the largest
    window is one portfolio's day, however long its history.
    """
    df = obs.withColumns({"_day": F.to_date(time), "_week": S.week_start(F.to_date(time))})
    days = df.groupBy(key, "_week", "_day").agg(F.min_by("nav", time).alias("day_start"))
    w = Window.partitionBy(key).orderBy("_day")
    week = Window.partitionBy(key, "_week").orderBy("_day")
    days = days.withColumns({"peak": F.max("day_start").over(so_far(w)), "week_start": F.first("day_start").over(week)})
    df = df.join(days, [key, "_week", "_day"])
    loss = lambda base: F.try_divide(F.col(base) - F.col("nav"), F.col(base)) * 100
    df = df.withColumns({"drawdown_pct": loss("peak"), "daily_loss_pct": loss("day_start"), "weekly_loss_pct": loss("week_start")})
    locks = df.where(F.col("drawdown_pct") >= risk.lockout_pct).groupBy(key).agg(F.min(time).alias("_locked_at"))
    halts = df.where(F.col("weekly_loss_pct") >= risk.weekly_halt_pct).groupBy(key, "_week").agg(F.min(time).alias("_halted_at"))
    df = df.join(locks, key, "left").join(halts, [key, "_week"], "left")
    level = (
        F.when(F.col("daily_loss_pct") >= risk.daily_deleverage_pct, 3).when(F.col("daily_loss_pct") >= risk.daily_halt_pct, 2)
        .when(F.col("daily_loss_pct") >= risk.daily_reduce_pct, 1).otherwise(0)
    )
    df = df.withColumn("_sev", F.max(level).over(so_far(Window.partitionBy(key, "_day").orderBy(time))))
    name = F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.col("_sev") + 1)
    state = (
        F.when(F.coalesce(F.col(time) >= F.col("_locked_at"), F.lit(False)), "locked_out").when(F.col("_sev") == 3, "deleverage")
        .when(F.coalesce(F.col(time) >= F.col("_halted_at"), F.lit(False)), "weekly_halt").otherwise(name)
    )
    return df.withColumn("state", state).drop("_day", "_week", "_locked_at", "_halted_at", "_sev")
