"""Seasonal autoregressive forecasts with an order search, one series per row.

Every candidate (p, d, q)(P, D, Q, season) with orders 0 or 1 is fitted by two least-squares regressions
(Hannan-Rissanen: a long autoregression supplies the shocks the moving-average terms refer to). Candidates with the
same differences share one matrix of lagged products, so a series is gone through four times, not once for each of the 64. The candidate
with the lowest AIC forecasts the next interval. This approximates a full likelihood fit.
"""

from __future__ import annotations

import sys
from itertools import product

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Send the functions themselves to the workers, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# All 64 candidates: (p, d, q, P, D, Q).
ORDERS = list(product((0, 1), repeat=6))
_FIT = "struct<candidate:int,aic:double,forecast:array<double>>"


def _difference(y: np.ndarray, lag: int, times: int) -> np.ndarray:
    for _ in range(times):
        y = y[lag:] - y[:-lag]
    return y


def _lags(p: int, seasonal: int, season: int) -> list[int]:
    """Lags that (1 - aB)^p (1 - bB^season)^seasonal reaches."""
    return sorted({i + j for i in range(p + 1) for j in ([0, season] if seasonal else [0])} - {0})


def _columns(w: np.ndarray, e: np.ndarray, lags: list[int], shocks: list[int], start: int) -> np.ndarray:
    columns = [np.ones(len(w) - start)]
    columns += [w[start - k : len(w) - k] for k in lags] + [e[start - k : len(e) - k] for k in shocks]
    return np.column_stack(columns)


class Moments:
    """One series after ``d`` and ``sd`` differences, with the products of all lags that any candidate uses.

    The products are summed once; a candidate's regression is solved from its own rows and columns of that matrix.
    """

    def __init__(self, y: np.ndarray, d: int, sd: int, season: int):
        self.y, self.d, self.sd, self.season = y, d, sd, season
        self.w = _difference(_difference(y, season, sd), 1, d)
        long = season + 2
        self.judged = len(y) - (2 * (season + 1) + long)
        self.e = np.zeros(len(self.w))
        if self.judged <= 0 or len(self.w) <= long:
            self.judged = 0
            return
        x = _columns(self.w, self.e, list(range(1, long + 1)), [], long)
        self.e[long:] = self.w[long:] - x @ _solve(x.T @ x, x.T @ self.w[long:])
        self.lags = [1, season, season + 1]
        self.start = len(self.w) - self.judged
        self.x = _columns(self.w, self.e, self.lags, self.lags, self.start)
        self.products, self.against = self.x.T @ self.x, self.x.T @ self.w[self.start :]

    def fit(self, p: int, q: int, sp: int, sq: int) -> tuple[float, np.ndarray, np.ndarray, list[int], list[int]] | None:
        """AIC, coefficients, shocks and the lags used; None when the series is too short for the candidate."""
        ar, ma = _lags(p, sp, self.season), _lags(q, sq, self.season)
        if self.judged < max(1, 2 * (len(ar) + len(ma) + 3)):
            return None
        own = [0, *[1 + self.lags.index(k) for k in ar], *[4 + self.lags.index(k) for k in ma]]
        coef = _solve(self.products[np.ix_(own, own)], self.against[own])
        shocks = self.w[self.start :] - self.x[:, own] @ coef
        sigma2 = max(float(shocks @ shocks) / self.judged, 1e-12)
        return self.judged * (np.log(2 * np.pi * sigma2) + 1) + 2 * (len(coef) + 1), coef, shocks, ar, ma

    def forecast(self, coef: np.ndarray, shocks: np.ndarray, ar: list[int], ma: list[int], steps: int) -> list[float] | None:
        w, e, y = list(self.w), list(self.e), list(self.y)
        e[self.start :] = shocks
        for _ in range(steps):
            nxt = float(np.dot(coef, [1.0] + [w[-k] for k in ar] + [e[-k] for k in ma]))
            w.append(nxt)
            e.append(0.0)
            # Undo the differences: (1 - B)^d (1 - B^season)^sd y = w.
            value = nxt
            if self.d:
                value += y[-1]
            if self.sd:
                value += y[-self.season]
            if self.d and self.sd:
                value -= y[-self.season - 1]
            y.append(value)
        out = y[len(self.y) :]
        return out if np.isfinite(out).all() else None


def _solve(products: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Least squares from sums of products, columns scaled to a like size; the shortest solution where several fit."""
    size = np.sqrt(np.maximum(np.diag(products), 1e-300))
    coef, *_ = np.linalg.lstsq(products / np.outer(size, size), against / size, rcond=1e-13)
    return coef / size


def fit_one(y: np.ndarray, order: tuple, season: int, steps: int) -> tuple[float, list[float] | None]:
    """AIC and forecast of one candidate; (inf, None) when the series is too short for it.

    Every candidate is judged on the same last part of the series, so that the AIC values compare.
    """
    found = fit_best(y, [order], season, steps)
    return (float("inf"), None) if found is None else found[1:]


def fit_best(y: np.ndarray, orders: list[tuple], season: int, steps: int) -> tuple[int, float, list[float]] | None:
    """Position, AIC and forecast of the candidate with the lowest AIC whose forecast is finite, the first of several."""
    if not np.isfinite(y).all():
        return None
    moments, fits = {}, []
    for i, (p, d, q, sp, sd, sq) in enumerate(orders):
        if (d, sd) not in moments:
            moments[d, sd] = Moments(y, d, sd, season)
        fit = moments[d, sd].fit(p, q, sp, sq)
        if fit is not None:
            fits.append((float(fit[0]), i, moments[d, sd], fit[1:]))
    for aic, i, own, fit in sorted(fits, key=lambda f: f[:2]):
        forecast = own.forecast(*fit, steps)
        if forecast is not None:
            return i, aic, forecast
    return None


def _fitter(orders: list[tuple], season: int, steps: int):
    @F.pandas_udf(_FIT)
    def fit(values: pd.Series) -> pd.DataFrame:
        fits = [fit_best(np.asarray(v, dtype="float64"), orders, season, steps) or (None, None, None) for v in values]
        return pd.DataFrame({"candidate": pd.array([f[0] for f in fits], dtype="Int32"), "aic": [f[1] for f in fits], "forecast": [f[2] for f in fits]})

    return fit


def best_fits(series: DataFrame, keys: list[str], steps: int, season: int = 12, orders: list[tuple] | None = None) -> DataFrame:
    """``keys, order, aic, forecast`` of the best candidate for each row of ``series (keys..., values array<double>)``.

    A series is one row, moved once; all candidates are fitted where it lies. Series that no candidate fits are left out.
    """
    orders = ORDERS if orders is None else orders
    names = F.array(*[F.lit("({},{},{})({},{},{},{})".format(*o, season)) for o in orders])
    fits = series.withColumn("fit", _fitter(orders, season, steps)("values")).filter(F.col("fit.forecast").isNotNull())
    return fits.select(*keys, F.element_at(names, F.col("fit.candidate") + 1).alias("order"), F.col("fit.aic").alias("aic"), F.col("fit.forecast").alias("forecast"))


def search(train: DataFrame, entity: str, ts: str, target: str, steps: int, season: int = 12, orders: list[tuple] | None = None) -> DataFrame:
    """``(entity, order, aic, forecast)`` of the best candidate per entity, for one training interval on the grid."""
    known = train.filter(F.col(target).isNotNull())
    series = known.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(ts, F.col(target).cast("double").alias("y")))).alias("s"))
    return best_fits(series.select(entity, F.transform("s", lambda v: v["y"]).alias("values")), [entity], steps, season, orders)
