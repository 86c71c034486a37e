"""The shared products against one regression per candidate, and whole windows against the plain search."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import schedule, seasonal
from gaugeline.operators.schedule import Regimen
from gaugeline.plans import backtest
from gaugeline.session import scratch_dir


def plain(y, order, season, steps):
    """One candidate by regressions of its own over all its columns."""
    p, d, q, sp, sd, sq = order
    w = y
    for lag, times in ((season, sd), (1, d)):
        for _ in range(times):
            w = w[lag:] - w[:-lag]
    lags = lambda a, b: sorted({i + j for i in range(a + 1) for j in ([0, season] if b else [0])} - {0})
    ar, ma, long = lags(p, sp), lags(q, sq), season + 2
    judged = len(y) - (2 * (season + 1) + long)
    if judged < 2 * (len(ar) + len(ma) + 3):
        return float("inf"), None
    design = lambda w, e, ar, ma, start: np.column_stack([np.ones(len(w) - start)] + [w[start - k : len(w) - k] for k in ar] + [e[start - k : len(e) - k] for k in ma])
    e = np.zeros(len(w))
    if ma:
        x = design(w, e, list(range(1, long + 1)), [], long)
        e[long:] = w[long:] - x @ np.linalg.lstsq(x, w[long:], rcond=None)[0]
    start = len(w) - judged
    x = design(w, e, ar, ma, start)
    coef = np.linalg.lstsq(x, w[start:], rcond=None)[0]
    shocks = w[start:] - x @ coef
    aic = judged * (np.log(2 * np.pi * (shocks @ shocks) / judged) + 1) + 2 * (len(coef) + 1)
    e[start:] = shocks
    w, e, y = list(w), list(e), list(y)
    for _ in range(steps):
        nxt = float(np.dot(coef, [1.0] + [w[-k] for k in ar] + [e[-k] for k in ma]))
        w.append(nxt)
        e.append(0.0)
        y.append(nxt + (y[-1] if d else 0) + (y[-season] if sd else 0) - (y[-season - 1] if d and sd else 0))
    return aic, y[-steps:]


@pytest.mark.parametrize("seed", range(4))
def test_shared_products_equal_single_regressions(seed):
    rng = np.random.default_rng(seed)
    t = np.arange(160)
    y = np.cumsum(rng.normal(size=160)) + 3 * np.sin(2 * np.pi * t / 12) + [0, 1e4, -5, 0.1][seed]
    fits = [plain(y, o, 12, 5) for o in seasonal.ORDERS]
    for order, (aic, forecast) in zip(seasonal.ORDERS, fits):
        got = seasonal.fit_one(y, order, 12, 5)
        assert got[0] == pytest.approx(aic, rel=1e-6) and np.allclose(got[1], forecast, rtol=1e-5, atol=1e-4)
    best = min(range(64), key=lambda i: fits[i][0])
    assert seasonal.fit_best(y, seasonal.ORDERS, 12, 5)[0] == best


def test_constant_unknown_and_short_series():
    assert seasonal.fit_best(np.ones(100), seasonal.ORDERS, 12, 3)[2] == pytest.approx([1, 1, 1])
    assert seasonal.fit_best(np.array([1.0, np.nan] * 60), seasonal.ORDERS, 12, 3) is None
    assert seasonal.fit_best(np.zeros(0), seasonal.ORDERS, 12, 3) is None
    assert seasonal.fit_best(np.arange(44.0), seasonal.ORDERS, 12, 2) is None
    assert seasonal.fit_best(np.arange(48.0), seasonal.ORDERS, 12, 2) is not None


def test_windows_equal_the_plain_search(spark):
    """Windows start between two grid times; one entity begins late, one has a gap."""
    rng = np.random.default_rng(5)
    begin, rows = datetime(2024, 1, 1, 0, 30), []
    for e, first in (("a", 0), ("b", 60), ("c", 0)):
        for h in range(first, 9 * 24):
            if not (e == "c" and 100 <= h < 110):
                rows.append((e, begin.replace(minute=0) + timedelta(hours=h), float(rng.normal() + h % 12)))
    df = spark.createDataFrame([(e, str(t), v) for e, t, v in rows], "entity string, t string, value double").select("entity", F.col("t").cast("timestamp_ntz").alias("ts"), "value")
    span = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:30:00' AS range_start, TIMESTAMP_NTZ'2024-01-09 23:00:00' AS range_end")
    regimen = Regimen("5D", "1D", min_train=50)
    got = {(r.window_id, r.entity, r.ts): r.predict for r in backtest.seasonal_search(df, span, regimen, "entity", "ts", "value", 3600, scratch_dir(spark, "plain")).collect()}
    want = {}
    for w in range(4):
        start = begin + timedelta(days=w)
        stop = start + timedelta(days=5)
        for e in "abc":
            y = np.array([v for n, t, v in rows if n == e and start <= t < stop])
            fit = seasonal.fit_best(y, seasonal.ORDERS, 12, 24)
            if fit:
                at = {t: fit[2][i] for i in range(24) for t in [stop.replace(minute=0) + timedelta(hours=i + 1)]}
                want |= {(w, e, t): at[t] for n, t, _ in rows if n == e and t in at}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)
