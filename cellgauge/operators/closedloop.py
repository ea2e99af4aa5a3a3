"""Estimators that predict from values already reconstructed, so they scan a field in order.

One packed field is one task's work; the histograms that they make are small, and go on as rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .codes import CENTER

HISTOGRAM = "field_id string, code bigint, freq bigint"


def quantise_step(value: float, guess: float, bound: float) -> tuple[int, float]:
    """(code, reconstructed value); code 0 keeps the value as it is."""
    steps = np.floor(abs(value - guess) / bound) + 1
    half = int(steps) >> 1
    if half >= CENTER:
        return 0, value
    signed = half if value >= guess else -half
    back = guess + 2 * signed * bound
    return (CENTER + signed, back) if abs(back - value) <= bound else (0, value)


def lorenzo_scan(x: np.ndarray, bound: float, every: int = 1) -> dict[int, int]:
    """Histogram of every so-manieth code of a closed-loop Lorenzo scan of an array of 1 to 4 dimensions."""
    back = np.zeros([d + 1 for d in x.shape])
    corners = [(c, 1 if sum(c) % 2 else -1) for c in np.ndindex(*[2] * x.ndim) if any(c)]
    hist: dict[int, int] = {}
    for n, at in enumerate(np.ndindex(*x.shape)):
        guess = sum(sign * back[tuple(a + 1 - b for a, b in zip(at, c, strict=True))] for c, sign in corners)
        code, kept = quantise_step(float(x[at]), guess, bound)
        back[tuple(a + 1 for a in at)] = kept
        if n % every == every - 1 or every == 1:
            hist[code] = hist.get(code, 0) + 1
    return hist


def _line_guess(y: np.ndarray, i: int, cubic: bool = True) -> float:
    """Prediction of y[i] (i odd) from its even neighbours along a line."""
    n = len(y)
    left1, right1, left3, right3 = i >= 1, i + 1 < n, i >= 3, i + 3 < n
    if cubic and n >= 5:
        if left3 and right3:
            return (-y[i - 3] + 9 * y[i - 1] + 9 * y[i + 1] - y[i + 3]) / 16
        if right1 and right3:
            return (3 * y[i - 1] + 6 * y[i + 1] - y[i + 3]) / 8
        if right1 and left3:
            return (-y[i - 3] + 6 * y[i - 1] + 3 * y[i + 1]) / 8
        if i >= 5:
            return (3 * y[i - 5] - 10 * y[i - 3] + 15 * y[i - 1]) / 8
    if right1 and left1:
        return (y[i - 1] + y[i + 1]) / 2
    if left3:
        return -0.5 * y[i - 3] + 1.5 * y[i - 1]
    return y[i - 1]


def interpolation_codes(x: np.ndarray, bound: float, stride: int = 5, noise: bool = False, seed: int = 0, pool_least: int = 1000) -> dict[int, int]:
    """Histogram of the finest level's codes of an interpolation predictor, on every stride-th odd point.

    Coarser levels are swept first, to collect the errors that quantising leaves; with noise, the
    finest level predicts from values with such errors added, as decoded ones have.
    """
    draw = np.random.default_rng(seed)
    levels = max(1, int(np.ceil(np.log2(max(x.shape)))))
    pool: list[float] = []
    for level in range(levels, 1, -1):
        errors: list[float] = []
        for line, i, _ in _lines(x, 1 << (level - 1), 1):
            guess = _line_guess(line, i)
            _, back = quantise_step(float(line[i]), float(guess), bound)
            errors.append(back - float(line[i]))
        pool = errors
        if len(errors) > pool_least:
            break
    hist: dict[int, int] = {}
    for line, i, _ in _lines(x, 1, stride):
        seen = line + draw.choice(pool, len(line)) if noise and pool else line
        code, _ = quantise_step(float(line[i]), float(_line_guess(seen, i)), bound)
        hist[code] = hist.get(code, 0) + 1
    return hist


def _lines(x: np.ndarray, step: int, stride: int):
    """(line, odd index, axis): axis by axis, lines through points already known at this level."""
    for axis in range(x.ndim):
        grid = [range(0, n, step if a < axis else 2 * step) for a, n in enumerate(x.shape) if a != axis]
        moved = np.moveaxis(x, axis, -1)
        for at in np.ndindex(*[len(g) for g in grid]):
            line = moved[tuple(g[k] for g, k in zip(grid, at, strict=True))][::step]
            for i in range(1, len(line), 2 * stride):
                yield line, i, axis


def scan_histograms(packed: DataFrame, bound: float, every: int = 100, how: str = "lorenzo", **options) -> DataFrame:
    """field_id, code, freq for each packed field; how: lorenzo (every so-manieth code, so fields with fewer cells have none) or interpolation."""

    def run(frames):
        for f in frames:
            rows = []
            for name, dims, values in zip(f["field_id"], f["dims"], f["values"], strict=True):
                x = np.asarray(values, dtype=float).reshape([int(d) for d in dims])
                hist = lorenzo_scan(x, bound, every) if how == "lorenzo" else interpolation_codes(x, bound, **options)
                rows += [(name, c, n) for c, n in sorted(hist.items())]
            yield pd.DataFrame(rows, columns=["field_id", "code", "freq"])

    return packed.select("field_id", "dims", "values").mapInPandas(run, HISTOGRAM)
