"""Names, thresholds and lookup tables used across the package."""

from __future__ import annotations

KEY = "series"
MONTH = "month"
MEASURES = ["ng_spot", "urea", "dap", "storage_mmcf"]

# Feature layout: names follow from the lag/window lists below.
NG_LAGS = (1, 2, 3, 4, 5, 6, 9, 12)
NG_ROLLS = (3, 6, 12)
NG_MOMENTUM = (1, 3, 6)
DAILY_FEATURES = [
    "ng_ma30_eom",
    "ng_ma60_eom",
    "ng_ma90_eom",
    "ng_ma_cross_30_60",
    "ng_ma_cross_30_90",
    "ng_daily_vol_1m",
]
# Names and order of the features.
FEATURE_COLS = [
    "urea",
    "dap",
    "ng_spot",
    *(f"ng_lag{k}" for k in NG_LAGS),
    *(f"ng_rolling_mean_{n}m" for n in NG_ROLLS),
    *(f"ng_rolling_std_{n}m" for n in NG_ROLLS),
    *(f"ng_mom_{k}m" for k in NG_MOMENTUM),
    *DAILY_FEATURES,
    "urea_lag1",
    "urea_rolling_mean_3m",
    "urea_ng_ratio",
    "urea_mom_1m",
    "urea_mom_3m",
    "urea_zscore_12m",
    "urea_zscore_24m",
    "urea_vs_12m_high",
    "urea_vs_12m_low",
    "ng_zscore_12m",
    "dap_lag1",
    "dap_urea_ratio",
    "storage_zscore",
    *(f"season_q{q}" for q in (1, 2, 3, 4)),
]
HORIZONS = (1, 2, 3)
TARGET_COLS = [f"target_urea_t{h}" for h in HORIZONS]

# Evaluation boundaries of the production series.
HOLDOUT_START = "2022-01-01"
SHOCK_TARGET_START = "2026-01-01"

# Plausible price range of a simulated path ($/mt).
SIM_FLOOR, SIM_CEILING = 100.0, 2000.0
HEDGE_FLOOR, HEDGE_CEILING = 50.0, 2000.0
DRAWS, SEED = 10_000, 42

# Pounds of nitrogen per acre by crop, and unit constants.
N_LBS_PER_ACRE = {
    "Corn": 150,
    "Wheat": 90,
    "Cotton": 120,
    "Sorghum": 80,
    "Soybeans": 60,
    "Hay": 50,
}
DEFAULT_N_LBS = 100
UREA_N_SHARE = 0.46
LBS_PER_MT = 2204.6

# Weight of the tail term per risk tolerance.
RISK_ALPHA = {"Conservative": 0.75, "Balanced": 0.45, "Aggressive": 0.15}
HEDGE_STEPS = 200

# 2023 planted acreage by state, thousands of acres
# (state, lat, lng, corn, wheat, soybeans).
STATE_ACREAGE = [
    ("Iowa", 42.00, -93.50, 12900, 0, 9400),
    ("Illinois", 40.00, -89.00, 10800, 500, 10100),
    ("Nebraska", 41.50, -99.90, 10300, 1400, 5500),
    ("Minnesota", 46.40, -94.30, 8100, 1600, 7500),
    ("Indiana", 40.30, -86.10, 5400, 500, 5800),
    ("South Dakota", 44.30, -100.30, 5200, 1600, 4300),
    ("Kansas", 38.50, -98.40, 4400, 7800, 5000),
    ("Ohio", 40.40, -82.70, 3700, 500, 4900),
    ("Wisconsin", 44.50, -89.50, 3600, 100, 1900),
    ("Missouri", 38.30, -92.40, 3100, 600, 5400),
    ("North Dakota", 47.50, -100.50, 2600, 5500, 5900),
    ("Michigan", 44.30, -84.50, 2300, 400, 2300),
    ("Texas", 31.40, -99.30, 1900, 5000, 100),
    ("Colorado", 39.00, -105.50, 1500, 2500, 400),
    ("Kentucky", 37.80, -84.90, 1300, 400, 1600),
    ("Oklahoma", 35.60, -97.50, 400, 4500, 700),
    ("Montana", 46.90, -110.40, 200, 4500, 100),
    ("North Carolina", 35.50, -79.30, 900, 100, 1100),
    ("Arkansas", 34.80, -92.20, 800, 200, 3000),
    ("Tennessee", 35.80, -86.50, 800, 200, 1500),
    ("Pennsylvania", 41.20, -77.20, 1100, 200, 700),
    ("New York", 42.50, -76.00, 800, 200, 300),
    ("Mississippi", 32.70, -89.70, 400, 100, 2300),
    ("Washington", 47.40, -120.40, 100, 2100, 100),
    ("Virginia", 37.40, -79.00, 400, 200, 600),
    ("Georgia", 32.20, -83.40, 500, 300, 500),
    ("Maryland", 39.00, -76.80, 500, 200, 300),
    ("Idaho", 44.20, -114.50, 100, 1500, 100),
    ("Wyoming", 43.00, -107.50, 100, 500, 100),
    ("California", 37.00, -119.50, 200, 700, 100),
    ("Delaware", 39.00, -75.50, 200, 100, 200),
]
