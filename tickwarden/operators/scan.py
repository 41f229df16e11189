"""Recurrences over many sorted series at once, without a loop over rows."""

from __future__ import annotations

import numpy as np


def affine_scan(a: np.ndarray, b: np.ndarray, apart: bool = False) -> np.ndarray:
    """y[t] = a[t] * y[t - 1] + b[t] for all t; a[t] = 0 starts a series.

    With `apart`, a value of one series that is no finite number does not reach the next series either.

    The steps are maps y -> a * y + b. Composing each with the one 1, 2, 4, ... places before leaves, after as many
    rounds as the length has bits, the map from the start.
    """
    a, b, step = a.copy(), b.copy(), 1
    while step < len(b) and a.any():
        came = a[step:] * b[:-step]
        b[step:] += np.where(a[step:] == 0.0, 0.0, came) if apart else came
        a[step:] = a[step:] * a[:-step]
        a[:step] = 0.0
        step *= 2
    return b


def ewma_before(x: np.ndarray, fresh: np.ndarray, alpha: float, mean: float = 0.0, var: float = 0.0) -> tuple[np.ndarray, np.ndarray, tuple[float, float]]:
    """Exponentially weighted mean and variance before each value, and after the last one.

    `fresh` marks the first value of a series, which is its own mean. A first series that is not fresh goes on from
    `mean` and `var`.
    """
    if not len(x):
        return x.copy(), x.copy(), (mean, var)
    goes_on = np.zeros(len(x), dtype=bool)
    goes_on[0] = not fresh[0]
    before, spread_before, after, spread = ewma_of_series(x, fresh, goes_on, np.full(len(x), mean), np.full(len(x), var), alpha, False)
    return before, spread_before, (float(after[-1]), float(spread[-1]))


def ewma_of_series(
    x: np.ndarray, fresh: np.ndarray, goes_on: np.ndarray, mean: np.ndarray, var: np.ndarray, alpha: float, apart: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Exponentially weighted mean and variance before each value, then both after it, of series one behind the other.

    `fresh` marks the first value of a new series, which is its own mean, `goes_on` the first one of a series that goes on
    from the `mean` and `var` at that place.
    """
    keep, first = 1.0 - alpha, fresh | goes_on
    a = np.where(first, 0.0, keep)
    after = affine_scan(a, np.where(fresh, x, np.where(goes_on, alpha * x + keep * mean, alpha * x)), apart)
    before = np.where(goes_on, mean, np.roll(after, 1))
    before[fresh] = x[fresh]
    own = keep * alpha * (x - before) ** 2
    spread = affine_scan(a, np.where(goes_on, own + keep * var, own), apart)
    spread_before = np.where(goes_on, var, np.roll(spread, 1))
    spread_before[fresh] = 0.0
    return before, spread_before, after, spread
