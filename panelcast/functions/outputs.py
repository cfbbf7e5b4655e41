"""Decoding of model outputs in NumPy, inside workers.

Every output becomes one sample a series: a vector over the horizon, or a matrix of which one axis
is the quantiles. Rules are tried in a fixed order, (quantile, horizon) before (horizon, quantile).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np


def tensor_to_numpy(values: Any, dtype=np.float32) -> np.ndarray:
    """An array of a tensor (detached, on the CPU) or of anything array-like."""
    for step in ("detach", "cpu", "numpy"):
        if hasattr(values, step):
            values = getattr(values, step)()
    return np.asarray(values, dtype=dtype)


def extract_predictions_array(outputs: Any) -> np.ndarray:
    """The predictions in a model's output: a tuple's first item, a known field, or the value itself."""
    if isinstance(outputs, tuple) and outputs:
        outputs = outputs[0]
    for name in ("quantile_predictions", "prediction_outputs"):
        found = outputs.get(name) if isinstance(outputs, dict) else getattr(outputs, name, None)
        if found is not None:
            return tensor_to_numpy(found)
    if outputs is None:
        raise ValueError("The model returned no output")
    return tensor_to_numpy(outputs)


def select_median_index(levels: Sequence[float] | None, size: int) -> int:
    """The index whose level is nearest 0.5; the middle without levels."""
    return int(np.abs(np.asarray(levels[:size], float) - 0.5).argmin()) if levels else size // 2


def resolve_quantile_index(target: float, levels: Sequence[float] | None, size: int, fallback: dict[int, Callable[[float], int]] | None = None) -> int | None:
    """Where level ``target`` is on an axis of ``size``.

    The model's own levels come first (an axis one longer starts with a mean), then ``fallback`` by
    size; else the middle stands in for any level. None for an empty axis.
    """
    offset = size - len(levels) if levels else -1
    if offset in (0, 1):
        hits = np.flatnonzero(np.isclose(levels, target))
        if len(hits):
            return int(hits[0]) + offset
    if fallback and size in fallback:
        return fallback[size](target)
    return (size - 1) // 2 if size > 0 else None


def fit_horizon(values: np.ndarray, h: int) -> np.ndarray:
    """Cut to ``h`` values, or lengthened by the last one; an empty forecast is 0."""
    values = np.asarray(values, np.float32)[:h]
    return np.zeros(h, np.float32) if not values.size else np.pad(values, (0, h - len(values)), mode="edge")


def _track(sample: np.ndarray, levels: Sequence[float] | None) -> np.ndarray:
    """The median's course in a matrix whose quantile axis the levels or, without, the shape tell."""
    if levels is not None and sample.shape[0] == len(levels):
        return sample[select_median_index(levels, len(levels))]
    if levels is not None and sample.shape[1] == len(levels):
        return sample[:, select_median_index(levels, len(levels))]
    return sample[sample.shape[0] // 2] if sample.shape[0] <= sample.shape[1] else sample[:, sample.shape[1] // 2]


def extract_point_forecast(outputs: Any, h: int, quantile_levels: list[float] | None = None) -> np.ndarray:
    """The median forecast of a single series."""
    arr = outputs if isinstance(outputs, np.ndarray) else extract_predictions_array(outputs)
    if arr.ndim not in (1, 2, 3):
        raise ValueError(f"A forecast of shape {arr.shape} is none of (horizon), (quantile, horizon), (batch, quantile, horizon)")
    if arr.ndim == 3:
        return fit_horizon(_track(arr[0], quantile_levels), h)
    if arr.ndim == 1:
        return fit_horizon(arr, h)
    if quantile_levels is not None and len(quantile_levels) in arr.shape:
        return fit_horizon(_track(arr, quantile_levels), h)
    return fit_horizon(arr[:, 0] if arr.shape[1] == 1 and arr.shape[0] != 1 else arr[0], h)


def _shared(arr: np.ndarray, batch: int) -> np.ndarray:
    """One output for the whole batch counts for each of its series."""
    return np.broadcast_to(arr, (batch, *arr.shape[1:])) if arr.ndim >= 3 and arr.shape[0] == 1 and batch > 1 else arr


def extract_batch_forecasts(outputs: Any, h: int, batch_size: int, quantile_levels: list[float] | None = None) -> list[np.ndarray]:
    """The median forecast of each series of a batch."""
    arr = _shared(extract_predictions_array(outputs), batch_size)
    if arr.ndim == 1:
        each = len(arr) // batch_size
        return [fit_horizon(arr[b * each :], h) for b in range(batch_size)]
    if arr.ndim == 2:
        single = arr.shape[0] != batch_size and quantile_levels is not None and arr.shape[1] == len(quantile_levels)
        middle = select_median_index(quantile_levels, arr.shape[1])
        return [np.full(h, arr[b, middle], np.float32) if single else fit_horizon(arr[b], h) for b in range(batch_size)]
    if arr.ndim == 3:
        return [fit_horizon(_track(arr[b], quantile_levels), h) for b in range(batch_size)]
    raise ValueError(f"A batch's forecasts of shape {arr.shape} are none of (values), (batch, horizon), (batch, quantile, horizon)")


def extract_batch_quantiles(outputs: Any, h: int, batch_size: int, quantile_levels: list[float] | None = None) -> dict[float, list[np.ndarray]]:
    """Each level's course for each series; only levels that every series has."""
    if not quantile_levels:
        return {}
    arr, k = _shared(extract_predictions_array(outputs), batch_size), len(quantile_levels)

    def courses(b: int) -> np.ndarray | None:
        """(quantile, horizon) of series b."""
        x = arr[b] if arr.ndim == 3 or arr.ndim == 2 and arr.shape[0] == batch_size and batch_size > 0 else arr
        if x.ndim == 1:
            return x[None, :] if k == 1 else None
        if x.ndim != 2:
            return None
        return x if x.shape[0] == k else x.T if x.shape[1] == k else None

    found = [courses(b) for b in range(batch_size)]
    if any(x is None for x in found):
        return {}
    return {q: [fit_horizon(x[i], h) for x in found] for i, q in enumerate(quantile_levels)}


#: Decile outputs: ten wide starts with a mean, nine wide does not.
DECILES = {10: lambda q: int(np.clip(round(q * 10), 0, 9)), 9: lambda q: int(np.clip(round(q * 10) - 1, 0, 8))}


def decile_courses(quantile_forecasts: Any, series: int, h: int, requested: Sequence[float], levels: Sequence[float] | None) -> dict[float, np.ndarray]:
    """Requested levels of one series from a (batch, horizon, quantile) output; {} if it has no such shape."""
    arr = np.asarray(quantile_forecasts) if quantile_forecasts is not None else np.zeros(0)
    if not requested or arr.ndim != 3 or series >= len(arr):
        return {}
    sample = arr[series] if arr.shape[1] >= h else arr[series].T
    at = {float(q): resolve_quantile_index(q, levels, sample.shape[1], DECILES) for q in requested}
    return {q: sample[:h, i] for q, i in at.items() if i is not None and i < sample.shape[1]}


def matched_levels(model_levels: Sequence[float] | None, requested: Sequence[float] | None) -> list[float] | None:
    """The levels to ask a model for: the requested ones it has, else those that give a median."""
    own = [float(q) for q in model_levels] if model_levels else None
    if requested:
        wanted = [float(q) for q in requested]
        return wanted if own is None else [own[int(i[0])] for q in wanted if len(i := np.flatnonzero(np.isclose(own, q)))] or None
    if own is None:
        return None
    middle = own[select_median_index(own, len(own))]
    return [middle] if np.isclose(middle, 0.5) else own


def repair_nan(values: np.ndarray, last: float) -> np.ndarray:
    """A forecast's NaNs become the mean of the rest; without any, the last context value."""
    bad = np.isnan(values)
    if bad.all():
        return np.full(len(values), last, np.float32)
    return np.where(bad, np.float32(values[~bad].mean()), values).astype(np.float32) if bad.any() else values


def sample_quantiles(samples: np.ndarray, levels: Sequence[float]) -> np.ndarray:
    """(levels, horizon) of samples (n, horizon), by linear interpolation."""
    return np.quantile(np.asarray(samples, np.float64), list(levels), axis=0)
