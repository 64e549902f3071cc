"""Names, columns and constants that results depend on."""

# Trading states of a name on a date.
NORMAL = "normal"
SUSPENDED = "suspended"
LIMIT_UP = "limit_up"
LIMIT_DOWN = "limit_down"
NEW_LISTING = "new_listing"
BANNED = (SUSPENDED, NEW_LISTING)

# Values of trade_status in the panel.
TRADING = "交易"
HALTED = "停牌"
TRADE_STATUS = (TRADING, HALTED, "N", "XR", "XD", "DR")

UNKNOWN_INDUSTRY = "未知"
CDR_CODES = ("689009.SH",)

# Status rule: relative distance to the limit price, calendar days of a new listing.
LIMIT_TOLERANCE = 5e-4
NEW_LISTING_DAYS = 60

# Order rule: one-sided distances to the limit price.
BUY_LIMIT_RATIO = 0.999
SELL_LIMIT_RATIO = 1.001

ADV_WINDOW = 20
ADV_FILL = 1e5
COST_WINDOW = 20
COST_MIN_DATES = 5
COST_RANGE = (0.1, 10.0)
TRADING_DAYS = 252
UNBOUNDED = 1e6
BUY_COST = 0.001
SELL_COST = 0.002
RISK_FREE = 0.02
MIN_TRADE = 1.0

# Index key -> membership flag; the keys of WHOLE_MARKET take every name.
INDEX_FLAGS = {"zz500": "is_zz500", "hs300": "is_hs300", "zz1000": "is_zz1000"}
WHOLE_MARKET = ("all", "winda", "csiall", "market")

# Index key -> column of the index close file.
INDEX_CLOSE_COLUMNS = {
    "hs300": "沪深300",
    "zz500": "中证500",
    "zz800": "中证800",
    "zz1000": "中证1000",
    "csiall": "中证全指",
    "zzall": "中证全指",
    "winda": "万得全A",
    "wanda": "万得全A",
    "dividend": "中证红利",
}

# Risk-model style factors; Country and industries are the others.
STYLE_FACTORS = (
    "Size", "MidCap", "Beta", "Momentum", "ResidualVolatility", "LongTermReversal",
    "Liquidity", "Value", "EarningsYield", "Growth", "Profitability",
    "InvestmentQuality", "EarningsQuality", "EarningsVariability", "Leverage",
    "DividendYield",
)
COUNTRY = "Country"

# Warehouse column -> panel column, where the names differ.
WAREHOUSE_NAMES = {
    "trade_dt": "date",
    "preclose": "pre_close",
    "adj_preclose": "adj_pre_close",
    "avg_price": "vwap",
    "turn": "turnover",
    "citics_l1": "industry_l1",
    "citics_l2": "industry_l2",
    "citics_l3": "industry_l3",
    "in_hs300": "is_hs300",
    "in_zz500": "is_zz500",
    "in_zz1000": "is_zz1000",
    "in_st": "is_st",
}

# Older panel files carry a column under this other name.
COLUMN_ALIASES = {"vwap": "avg_price"}

# The panel: 40 columns and their Spark types, in stored order.
PANEL_SCHEMA = """
    code string, date date, name string,
    pre_close double, open double, high double, low double, close double,
    limit_up double, limit_down double,
    pct_change double, volume double, amount double,
    adj_pre_close double, adj_open double, adj_high double, adj_low double, adj_close double,
    adj_vwap double, adj_factor double,
    trade_status string, vwap double,
    total_mv double, float_mv double, free_mv double,
    turnover double, free_turnover double,
    total_shares double, float_shares double, free_shares double,
    industry_l1 string, industry_l2 string, industry_l3 string,
    list_date string, list_days int, delist_date string,
    is_hs300 int, is_zz500 int, is_zz1000 int, is_st int
"""

DEFAULT_COLUMNS = (
    "code", "date", "adj_close", "adj_factor", "vwap", "adj_vwap",
    "pre_close", "open", "high", "low", "close", "limit_up", "limit_down",
    "volume", "amount", "turnover", "float_mv", "industry_l1",
    "is_st", "is_hs300", "is_zz500", "is_zz1000",
    "trade_status", "list_date", "delist_date",
)
COLUMN_GROUPS = {
    "core": ("code", "date"),
    "signal": ("adj_close", "volume", "amount", "turnover", "float_mv"),
    "universe": ("is_st", "trade_status", "list_date", "list_days", "delist_date", "industry_l1"),
    "exec_limit": (
        "limit_up", "limit_down", "pre_close", "open", "high", "low", "close",
        "vwap", "volume", "amount", "trade_status",
    ),
}
PRESETS = {
    "factor_backtest": (
        "code", "date", "adj_close", "volume", "amount", "turnover", "float_mv",
        "industry_l1", "is_st", "trade_status", "list_date", "list_days",
        "is_hs300", "is_zz500", "is_zz1000",
        "pre_close", "open", "high", "low", "close", "limit_up", "limit_down",
        "vwap", "adj_vwap",
    ),
    "signal_only": (
        "code", "date", "adj_close", "volume", "float_mv",
        "is_st", "trade_status", "industry_l1",
    ),
}

# Default axes of the calibration grid.
GRID_IC = (0.02, 0.03, 0.05, 0.08, 0.10, 0.12)
GRID_ICIR = (0.3, 0.5, 0.8, 1.2)
GRID_DECAY = (0.0, 0.5, 0.8, 0.9, 0.95)
GRID_SEEDS = (42, 43, 44)

# Order of the tall metrics table.
METRICS = (
    "annual_return", "annual_vol", "sharpe", "calmar", "max_drawdown",
    "annual_excess_return", "tracking_error", "info_ratio",
    "excess_calmar", "excess_max_drawdown",
    "win_rate_monthly", "avg_monthly_excess",
)
