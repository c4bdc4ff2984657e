from __future__ import annotations

import datetime as dt
import os
import sys

import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

PANEL = "series string, month date, ng_spot double, urea double, dap double, storage_mmcf double"


@pytest.fixture(scope="session")
def spark():
    from nitrapanel.session import drop_scratch, local_session

    session = local_session(8, "tests", 4)
    yield session
    drop_scratch(session)
    session.stop()


def months(start: str, n: int) -> list[dt.date]:
    y, m = map(int, start.split("-"))
    return [dt.date(y + (m - 1 + i) // 12, (m - 1 + i) % 12 + 1, 1) for i in range(n)]


def swing(rng: np.random.Generator, level: float, volatility: float, yearly: float, n: int) -> np.ndarray:
    """A price that drifts by percentages and has a yearly season."""
    drift = np.cumsum(rng.standard_t(5, n) * volatility)
    season = yearly * np.sin(2 * np.pi * (np.arange(n) + rng.integers(0, 12)) / 12)
    return level * np.exp(drift + season)


def panel_rows(series: str, n: int, seed: int, start: str = "2019-07") -> list[tuple]:
    """Gas, a urea price that follows gas two months later, DAP and storage."""
    rng = np.random.default_rng([seed, 77])
    gas = swing(rng, 4.6, 0.05, 0.12, n)
    urea = swing(rng, 385.0, 0.02, 0.04, n) * (np.concatenate([gas[:1], gas[:1], gas])[:n] / gas.mean()) ** 0.4
    dap = urea * 1.3 + rng.uniform(-30, 30, n)
    storage = 3100.0 - 60.0 * (gas - gas.mean()) + 700.0 * np.cos(2 * np.pi * np.arange(n) / 12)
    return [(series, m, *map(float, v)) for m, *v in zip(months(start, n), gas, urea, dap, storage)]


@pytest.fixture(scope="session")
def panel(spark):
    """Three series of unequal length."""
    rows = [r for i, (s, n) in enumerate((("a", 38), ("b", 44), ("c", 31))) for r in panel_rows(s, n, i)]
    return spark.createDataFrame(rows, PANEL).cache()


def rows_of(df, *order: str) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()] if order else [
        r.asDict(recursive=True) for r in df.collect()
    ]
