"""Fixed values. These must equal the published defaults for results to agree."""

from __future__ import annotations

from dataclasses import dataclass

TRADING_DAYS = 252
RISK_FREE = 0.04

# ---- fixed values: factor weights by regime (value, momentum, quality) ----
REGIME_WEIGHTS = {
    "crash": (0.45, 0.10, 0.45),
    "deep-bear": (0.45, 0.10, 0.45),
    "bear": (0.40, 0.15, 0.45),
    "neutral": (0.33, 0.33, 0.34),
    "bull": (0.20, 0.50, 0.30),
    "euphoria": (0.25, 0.45, 0.30),
    "melt-up": (0.25, 0.50, 0.25),
}
DEFAULT_WEIGHTS = (0.33, 0.33, 0.34)

# ---- fixed values: size multiplier by regime ----
REGIME_SIZE = {
    "crash": 0.3,
    "deep-bear": 0.3,
    "bear": 0.5,
    "neutral": 0.7,
    "bull": 1.0,
    "euphoria": 0.75,
    "melt-up": 0.5,
}

# ---- fixed values: regime labels by number of states, worst to best ----
REGIME_LABELS = {
    3: ["crash", "neutral", "bull"],
    4: ["crash", "bear", "bull", "euphoria"],
    5: ["crash", "bear", "neutral", "bull", "euphoria"],
    6: ["crash", "bear", "neutral", "bull", "euphoria", "melt-up"],
    7: ["crash", "deep-bear", "bear", "neutral", "bull", "euphoria", "melt-up"],
}

# ---- fixed values: inverse funds and the sectors they conflict with ----
INVERSE_FUNDS = {
    "SH": [],
    "PSQ": ["Technology", "Communication Services"],
    "RWM": [],
    "SBB": [],
    "EFZ": [],
}
MAX_INVERSE_PCT = {"bear": 30.0, "crash": 50.0, "deep-bear": 50.0}

# ---- fixed values: sector to sector fund ----
SECTOR_FUND = {
    "Technology": "XLK",
    "Financial Services": "XLF",
    "Healthcare": "XLV",
    "Energy": "XLE",
    "Industrials": "XLI",
    "Consumer Cyclical": "XLY",
    "Consumer Defensive": "XLP",
    "Utilities": "XLU",
    "Real Estate": "XLRE",
    "Basic Materials": "XLB",
    "Communication Services": "XLC",
}

# ---- fixed values: committee name fragment to sectors; the first match decides ----
COMMITTEE_RULES = [
    ("Senate Banking", ["Financial Services", "Real Estate"]),
    ("House Financial Services", ["Financial Services", "Real Estate"]),
    ("Senate Commerce", ["Consumer Cyclical", "Communication Services", "Technology"]),
    ("House Energy and Commerce", ["Energy", "Utilities", "Healthcare"]),
    ("Senate Armed Services", ["Industrials"]),
    ("House Armed Services", ["Industrials"]),
    ("Senate Agriculture", ["Consumer Defensive", "Basic Materials"]),
    ("House Agriculture", ["Consumer Defensive", "Basic Materials"]),
    ("Senate Finance", ["Financial Services", "Healthcare", "Consumer Defensive", "Consumer Cyclical"]),
    ("Senate HELP", ["Healthcare"]),
    ("Senate Environment", ["Utilities", "Energy", "Basic Materials"]),
    ("House Ways and Means", ["Financial Services", "Healthcare", "Consumer Defensive", "Consumer Cyclical"]),
    ("House Science", ["Technology"]),
    ("Senate Commerce Science", ["Technology", "Communication Services"]),
    ("Senate Intelligence", ["Technology", "Communication Services", "Industrials"]),
    ("House Intelligence", ["Technology", "Communication Services", "Industrials"]),
    ("Senate Foreign Relations", ["Energy", "Basic Materials", "Industrials"]),
    ("House Foreign Affairs", ["Energy", "Basic Materials", "Industrials"]),
    ("Senate Judiciary", ["Technology", "Communication Services"]),
    ("House Judiciary", ["Technology", "Communication Services"]),
]

# ---- fixed values: trailing name suffixes that do not count as a last name ----
NAME_SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "v"]

# ---- fixed values: analyst rating key to display rating ----
RATINGS = {
    "strong_buy": "Buy",
    "buy": "Buy",
    "hold": "Hold",
    "neutral": "Hold",
    "sell": "Sell",
    "strong_sell": "Sell",
}

LAG_VARIANTS = [7, 14, 30, 45]

BLOCKED_STATES = ["entries_halted", "weekly_halt", "locked_out", "deleverage"]


@dataclass(frozen=True)
class Universe:
    max_lag_days: int = 45
    min_trade_usd: int = 15_000
    event_window_days: int = 2


@dataclass(frozen=True)
class Features:
    vol_window: int = 20
    trend_window: int = 200
    momentum_window: int = 63
    use_momentum: bool = True
    use_drawdown: bool = True
    min_history_bars: int = 220


@dataclass(frozen=True)
class Allocation:
    min_confidence: float = 0.40
    instability_penalty: float = 0.5
    season_active: float = 1.10
    season_inactive: float = 0.90
    min_economic_pct: float = 0.1
    congress_cap_pct: float = 3.0


@dataclass(frozen=True)
class Correlation:
    threshold: float = 0.7
    min_overlap: int = 20


@dataclass(frozen=True)
class Sizing:
    risk_pct: float = 0.15
    atr_window: int = 14
    target_vol_pct: float = 15.0
    min_reward_risk: float = 2.0
    atr_fallback_pct: float = 10.0


@dataclass(frozen=True)
class Risk:
    max_positions: int = 20
    max_per_day: int = 3
    max_position_pct: float = 8.0
    max_sector_pct: float = 30.0
    max_adv_pct: float = 5.0
    trailing_stop_pct: float = 15.0
    take_profit_pct: float = 25.0
    hard_exit_pct: float = 40.0
    daily_reduce_pct: float = 3.0
    daily_halt_pct: float = 4.0
    daily_deleverage_pct: float = 6.0
    weekly_halt_pct: float = 8.0
    lockout_pct: float = 15.0
    max_invested_pct: float = 80.0
    max_stale_days: int = 3
    hedge_single_pct: float = 15.0
    hedge_conflict_pct: float = 10.0


@dataclass(frozen=True)
class Backtest:
    train_years: int = 3
    test_months: int = 6
    step_months: int = 3
    slippage_bps: float = 10.0
    commission_pct: float = 0.05
    min_train_bars: int = 500
    initial_cash: float = 100_000.0
    impact_coef: float = 2.0


UNIVERSE, FEATURES, ALLOCATION = Universe(), Features(), Allocation()
CORRELATION, SIZING, RISK, BACKTEST = Correlation(), Sizing(), Risk(), Backtest()
