"""Tables that results depend on, in their natural order."""

from __future__ import annotations

#: Identifier types of each security type, most preferred first; new ones may only be added at the end.
IDENTIFIERS = {
    "EQUITY": ("ISIN", "CUSIP", "FIGI", "SEDOL", "TICKER"),
    "BOND": ("ISIN", "CUSIP", "FIGI"),
    "CRYPTO": ("SYMBOL", "CONTRACT_ADDRESS"),
    "FX": ("ISO_PAIR",),
    "FUTURE": ("EXCHANGE_CODE", "ISIN"),
    "OPTION": ("OCC_SYMBOL", "ISIN"),
    "ETF": ("ISIN", "CUSIP", "FIGI", "TICKER"),
    "INDEX": ("INDEX_CODE", "ISIN"),
}

#: First two letters of a CFI code (ISO 10962) to asset class, instrument type, settlement.
CFI = {
    "ES": ("EQUITY", "COMMON_STOCK", ""),
    "EP": ("EQUITY", "PREFERRED_STOCK", ""),
    "EU": ("EQUITY", "UNIT_TRUST", ""),
    "EC": ("EQUITY", "CLOSED_END_FUND", ""),
    "EF": ("EQUITY", "ETF", ""),
    "EM": ("EQUITY", "MISC_EQUITY", ""),
    "DB": ("FIXED_INCOME", "CORPORATE_BOND", ""),
    "DC": ("FIXED_INCOME", "CONVERTIBLE_BOND", ""),
    "DG": ("FIXED_INCOME", "GOVERNMENT_BOND", ""),
    "DT": ("FIXED_INCOME", "TREASURY", ""),
    "DN": ("FIXED_INCOME", "MUNICIPAL_BOND", ""),
    "DM": ("FIXED_INCOME", "MONEY_MARKET", ""),
    "DW": ("FIXED_INCOME", "COVERED_BOND", ""),
    "DA": ("FIXED_INCOME", "ABS", ""),
    "RA": ("DERIVATIVE", "RIGHT", ""),
    "RW": ("DERIVATIVE", "WARRANT", ""),
    "OC": ("DERIVATIVE", "CALL_OPTION", ""),
    "OP": ("DERIVATIVE", "PUT_OPTION", ""),
    "FF": ("DERIVATIVE", "FINANCIAL_FUTURE", ""),
    "FC": ("COMMODITY", "COMMODITY_FUTURE", "PHYSICAL"),
    "CI": ("EQUITY", "MUTUAL_FUND", ""),
    "CE": ("EQUITY", "ETF", ""),
    "MC": ("FX", "SPOT", ""),
    "MR": ("FX", "FX_FORWARD", ""),
}
#: The first letter, where the first two are not in the table.
CFI_FIRST = {
    "E": ("EQUITY", "COMMON_STOCK", ""),
    "D": ("FIXED_INCOME", "CORPORATE_BOND", ""),
    "R": ("DERIVATIVE", "RIGHT", ""),
    "O": ("DERIVATIVE", "OPTION", ""),
    "F": ("DERIVATIVE", "FUTURE", ""),
    "C": ("EQUITY", "COLLECTIVE_INVESTMENT", ""),
    "M": ("FX", "MISC", ""),
}

#: Rating ladders of two agencies, best (rank 1) first.
SP_RATINGS = ("AAA", "AA+", "AA", "AA-", "A+", "A", "A-", "BBB+", "BBB", "BBB-", "BB+", "BB", "BB-", "B+", "B", "B-", "CCC+", "CCC", "CCC-", "CC", "C", "D")
MOODY_RATINGS = ("Aaa", "Aa1", "Aa2", "Aa3", "A1", "A2", "A3", "Baa1", "Baa2", "Baa3", "Ba1", "Ba2", "Ba3", "B1", "B2", "B3", "Caa1", "Caa2", "Caa3", "Ca", "C")
#: The last rank of each tier.
CREDIT_TIERS = {"INVESTMENT_GRADE": 10, "HIGH_YIELD": 16, "DISTRESSED": 22}

#: Market tier, then region, of countries.
MARKETS = {
    "DEVELOPED": {
        "AMERICAS": ("US", "CA"),
        "EMEA": ("GB", "FR", "DE", "CH", "NL", "SE", "NO", "DK", "FI", "IE", "ES", "IT", "PT", "AT", "BE", "IL"),
        "ASIA_PACIFIC": ("JP", "AU", "NZ", "HK", "SG"),
    },
    "EMERGING": {
        "ASIA_PACIFIC": ("CN", "IN", "KR", "TW", "TH", "MY", "ID", "PH"),
        "AMERICAS": ("BR", "MX", "CL", "CO", "PE"),
        "EMEA": ("ZA", "SA", "AE", "QA", "KW", "TR", "PL", "CZ", "HU", "EG", "GR"),
    },
    "FRONTIER": {
        "ASIA_PACIFIC": ("VN", "BD", "LK"),
        "EMEA": ("KE", "NG", "RO", "HR", "RS", "BH", "OM", "JO"),
    },
}

#: ESG ratings to tier and number.
ESG = {
    "AAA": ("LEADER", 10.0),
    "AA": ("LEADER", 8.6),
    "A": ("AVERAGE", 7.1),
    "BBB": ("AVERAGE", 5.7),
    "BB": ("LAGGARD", 4.3),
    "B": ("LAGGARD", 2.9),
    "CCC": ("LAGGARD", 1.4),
}

#: Allowed moves between model states; a model begins as a draft.
MOVES = {
    "DRAFT": ("ACTIVE", "BACKTESTING", "RETIRED", "SCHEDULED"),
    "ACTIVE": ("PAUSED", "RETIRED", "ERROR"),
    "PAUSED": ("ACTIVE", "RETIRED"),
    "QUEUED": ("ACTIVE", "RETIRED"),
    "BACKTESTING": ("DRAFT", "ERROR"),
    "SCHEDULED": ("ACTIVE", "DRAFT", "RETIRED"),
    "ERROR": ("ACTIVE", "PAUSED", "RETIRED", "DRAFT"),
    "RETIRED": (),
}

#: Axes of the strategies' parameter grids, slowest first.
BARRIER_AXES = {"sl_pct": [0.010, 0.020, 0.030], "tp_ratio": [2.0, 3.0], "trail_pct": [0.000, 0.003, 0.005, 0.010], "t_bars": [24, 48, 96]}
TA_AXES = {
    "RSI": {"period": [7, 14, 21], "threshold_lo": [20, 25, 30], "threshold_hi": [70, 75, 80]},
    "MACD": {"fast_period": [8, 12, 16], "slow_period": [21, 26, 34], "signal_period": [7, 9, 12]},
    "BOLL": {"period": [14, 20, 30], "multiplier": [1.5, 2.0, 2.5]},
    "EMA_CROSS": {"fast_period": [5, 10, 20], "slow_period": [20, 50, 100]},
    "STOCH": {"period": [9, 14, 21], "signal_period": [3], "threshold_lo": [20, 25], "threshold_hi": [75, 80]},
    "ATR_BREAK": {"period": [10, 14, 20], "multiplier": [1.5, 2.0, 3.0]},
    "VOL_BREAK": {"period": [10, 20, 30], "vol_multiplier": [1.5, 2.0, 2.5]},
    "VWAP_REV": {"period": [12, 24, 48], "threshold": [0.5, 1.0, 1.5]},
}
FUNDING_AXES = {"min_funding_ann_pct": [5.0, 10.0, 20.0, 40.0], "hold_days": [3, 7, 14], "min_pct_positive": [0.5, 0.65, 0.8]}
PAIRS_AXES = {"lookback_minutes": [195, 390, 780, 1170, 1950], "entry_z": [1.0, 1.5, 2.0, 2.5], "exit_z": [0.0, 0.25, 0.5, 0.75], "stop_z": [3.0, 4.0, 5.0]}
GRIDBOT_AXES = {"grid_spacing_pct": [0.003, 0.005, 0.010, 0.020], "range_width_pct": [0.05, 0.10, 0.20], "hold_days": [3, 7, 14]}
