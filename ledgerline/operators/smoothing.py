"""Exponential smoothing with additive trend and season, one fit per series in grouped pandas.

A series holds one row per calendar period, so a group stays small however large the source is.
For given smoothing weights the one-step errors are linear in the starting states, which are therefore
solved by least squares. The weights are searched continuously by a quasi-Newton method from the best points of a coarse grid.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ledgerline.functions import periods as P

_GRID = np.array([0.05, 0.25, 0.5, 0.75, 0.95])
_LOW, _HIGH = 1e-4, 0.9999
# Points of the grid that the search begins at, its steps at most, and when it is done.
_STARTS, _STEPS, _DONE = 3, 40, 1e-10


def _errors(y: np.ndarray, weights: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-step errors for every weight triple, as an offset and its slope in each starting state.

    Column 0 carries the data; column 1 + j is the response to starting state j (level, trend, seasons).
    Returns the errors (weights, time, columns) and the final states and seasons.
    """
    count, cols = len(weights), 3 + m
    a, b, g = (weights[:, j][:, None] for j in range(3))
    level, trend = np.zeros((count, cols)), np.zeros((count, cols))
    level[:, 1], trend[:, 2] = 1.0, 1.0
    season = np.zeros((max(m, 1), count, cols))
    for j in range(m):
        season[j, :, 3 + j] = 1.0
    out = np.zeros((count, len(y), cols))
    for t, value in enumerate(y):
        s = season[t % m] if m else 0.0
        err = -(level + trend + s)
        err[:, 0] += value
        out[:, t] = err
        level = level + trend + a * err
        trend = trend + a * b * err
        if m:
            season[t % m] = s + g * (1 - a) * err
    return out, np.stack([level, trend]), season


def _solve(errors: np.ndarray) -> np.ndarray:
    """Starting states that minimise the squared errors of one weight triple."""
    states, *_ = np.linalg.lstsq(errors[:, 1:], -errors[:, 0], rcond=None)
    return states


def _squares(y: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    """Squared error of each weight triple with its best starting states."""
    errors, _, _ = _errors(y, weights, m)
    out = np.empty(len(weights))
    for w in range(len(weights)):
        resid = errors[w, :, 0] + errors[w, :, 1:] @ _solve(errors[w])
        out[w] = resid @ resid
    return out


def _weights(x: np.ndarray, free: int) -> np.ndarray:
    """Weights strictly between _LOW and _HIGH from unbounded points; a weight that is not free is 0."""
    out = np.zeros((len(x), 3))
    out[:, :free] = _LOW + (_HIGH - _LOW) / (1 + np.exp(-x))
    return out


def search(y: np.ndarray, m: int) -> tuple[np.ndarray, float]:
    """Smoothing weights with the least squared error that is found, and that error.

    BFGS over the weights' logits: differences for the gradient and the points of a line search are evaluated together, one pass
    over the series for each. The result is never worse than the best point of the grid.
    """
    free = 3 if m else 2
    grid = np.array(list(product(*([_GRID] * free + [np.array([0.0])] * (3 - free)))))
    squares = _squares(y, grid, m)
    order = np.argsort(squares, kind="stable")[:_STARTS]
    best = (grid[order[0]], float(squares[order[0]]))
    for start in order:
        share = (grid[start, :free] - _LOW) / (_HIGH - _LOW)
        x, value = np.log(share / (1 - share)), float(squares[start])
        inverse, slope = np.eye(free), None
        for _ in range(_STEPS):
            h = 1e-5
            around = _squares(y, _weights(np.concatenate([x + h * np.eye(free), x - h * np.eye(free)]), free), m)
            new = (around[:free] - around[free:]) / (2 * h)
            if slope is not None:
                s, g = step, new - slope
                if s @ g > 1e-14:
                    rho = 1 / (s @ g)
                    left = np.eye(free) - rho * np.outer(s, g)
                    inverse = left @ inverse @ left.T + rho * np.outer(s, s)
            slope = new
            way = -inverse @ slope
            if way @ slope >= 0:
                inverse, way = np.eye(free), -slope
            size = np.linalg.norm(way)
            if size == 0:
                break
            # No step leaves the range in which weights can be told apart.
            way = way * min(1.0, 4.0 / size)
            tries = x + np.array([2.0, 1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001])[:, None] * way
            found = _squares(y, _weights(np.clip(tries, -15, 15), free), m)
            at = int(np.argmin(found))
            if not found[at] < value:
                break
            step, gain = np.clip(tries[at], -15, 15) - x, value - float(found[at])
            x, value = x + step, float(found[at])
            if gain <= _DONE * max(value, 1e-300):
                break
        if value < best[1]:
            best = (_weights(x[None], free)[0], value)
    return best


def fit(y: np.ndarray, m: int, horizon: int) -> tuple[np.ndarray, float]:
    """Forecast of ``horizon`` steps and the population deviation of the one-step errors; m = 0 has no season."""
    weights, _ = search(y, m)
    errors, ends, season = _errors(y, weights[None], m)
    full = np.concatenate([[1.0], _solve(errors[0])])
    resid = errors[0] @ full
    level, trend = ends[:, 0] @ full
    steps = np.arange(1, horizon + 1)
    ahead = level + trend * steps
    if m:
        ahead = ahead + (season[:, 0] @ full)[(len(y) + steps - 1) % m]
    return ahead, float(np.std(resid))


def smooth_forecast(tagged: DataFrame, freq: str, horizon: int, keys: Sequence[str]) -> DataFrame:
    """(keys, method, step, period, fit, spread) for series tagged with a smoothing method."""
    season = P.SEASON_LENGTH[freq] or 0
    keys = list(keys)
    fields = [tagged.schema[k] for k in keys]
    schema = T.StructType(
        fields
        + [
            T.StructField("method", T.StringType()),
            T.StructField("last", T.DateType()),
            T.StructField("step", T.LongType()),
            T.StructField("fit", T.DoubleType()),
            T.StructField("spread", T.DoubleType()),
        ]
    )

    def one_series(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period")
        method = pdf["method"].iloc[0]
        ahead, spread = fit(
            pdf["value"].to_numpy(float), season if method == "holt_winters_seasonal" else 0, horizon
        )
        out = pd.DataFrame({"step": np.arange(1, horizon + 1), "fit": ahead})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        out["method"], out["last"], out["spread"] = method, pdf["period"].iloc[-1], spread
        return out[[f.name for f in schema.fields]]

    fitted = tagged.select(*keys, "period", "value", "method").groupBy(*keys).applyInPandas(one_series, schema)
    return fitted.select(
        *keys, "method", "step", P.ahead(F.col("last"), F.col("step").cast("int"), freq).alias("period"), "fit", "spread"
    )
