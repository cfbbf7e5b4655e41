"""Models' length limits: checks on the driver and, per series, as columns."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LengthAdjustment:
    data: np.ndarray
    was_padded: bool
    was_truncated: bool
    original_length: int
    adjusted_length: int
    padding_amount: int = 0
    truncation_amount: int = 0


def adjust_context_length(context, spec, pad_value: float | None = None) -> LengthAdjustment:
    """One vector within a model's limits (the column form is ``context.adjust_length``)."""
    x = np.asarray(context)
    n, low, high = len(x), spec.min_context_length, spec.max_context_length
    pad = max(0, (low or 0) - n)
    cut = max(0, n - high) if high is not None else 0
    if pad and not spec.pad_to_min_context:
        warnings.warn(f"{spec.name}: context length {n} is below the minimum {low}", stacklevel=2)
        pad = 0
    if cut and not spec.truncate_to_max_context:
        raise ValueError(f"Context length {n} exceeds max {high} of {spec.name}")
    if pad:
        fill = pad_value if pad_value is not None else float(x.mean()) if n else 0.0
        x = np.concatenate([np.full(pad, fill), x])
    x = x[cut:]
    return LengthAdjustment(x, pad > 0, cut > 0, n, len(x), pad, cut)


def validate_prediction_length(h: int, spec, strict: bool = False) -> int:
    """``h`` within the model's limit: clipped with a warning, or ValueError if ``strict``."""
    limit = spec.max_prediction_length
    if limit is None or h <= limit:
        return h
    text = f"Model {spec.name} max prediction length is {limit}, requested {h}"
    if strict:
        raise ValueError(text)
    warnings.warn(f"{text}; clipping to {limit}", stacklevel=2)
    return limit


def get_effective_limits(spec, loaded_model: Any | None = None) -> dict[str, int | None]:
    """The model's limits; patchtst_fm takes exactly the context its loaded configuration names."""
    exact = getattr(getattr(loaded_model, "config", None), "context_length", None) if spec.name == "patchtst_fm" else None
    return {"min_context": exact or spec.min_context_length, "max_context": exact or spec.max_context_length, "max_prediction": spec.max_prediction_length}


def _findings(spec, n, h: int):
    """(applies, is an issue, text) of each limit; ``n`` is a number or a column. The texts."""
    low, high, most = spec.min_context_length, spec.max_context_length, spec.max_prediction_length
    say = (lambda *x: F.concat(*[v if isinstance(v, Column) else F.lit(str(v)) for v in x])) if isinstance(n, Column) else lambda *x: "".join(map(str, x))
    shown = n.cast("string") if isinstance(n, Column) else n
    if most is not None and h > most:
        yield True, True, say("Prediction length ", h, " exceeds max ", most)
        yield True, False, say("Reduce horizon to ", most, " or use AR generation")
    if low is not None:
        pad = spec.pad_to_min_context
        yield n < low, not pad, say("Will pad context from ", shown, " to ", low) if pad else say("Context length ", shown, " below minimum ", low)
    if high is not None:
        cut = spec.truncate_to_max_context
        yield n > high, not cut, say("Will truncate context from ", shown, " to ", high) if cut else say("Context length ", shown, " exceeds max ", high)


def check_data_compatibility(spec, context_length: int, prediction_length: int) -> dict[str, Any]:
    """{compatible, issues, recommendations} of one series."""
    found = [(issue, text) for applies, issue, text in _findings(spec, context_length, prediction_length) if applies]
    issues = [t for issue, t in found if issue]
    return {"compatible": not issues, "issues": issues, "recommendations": [t for issue, t in found if not issue]}


def compatibility(spec, n: Column, h: int) -> Column:
    """The same as a struct column over a column of series lengths."""

    def texts(kind: bool) -> Column:
        own = [F.when(F.lit(a) if isinstance(a, bool) else a, t if isinstance(t, Column) else F.lit(t)) for a, issue, t in _findings(spec, n, h) if issue is kind]
        return F.array_compact(F.array(*own)) if own else F.array().cast("array<string>")

    return F.struct((F.size(texts(True)) == 0).alias("compatible"), texts(True).alias("issues"), texts(False).alias("recommendations"))


def fit_exact(context: np.ndarray, length: int | None) -> np.ndarray:
    """A vector padded on the left with its mean, or cut on the left, to exactly ``length``."""
    x = np.asarray(context, np.float32)
    if length is None or len(x) == length:
        return x
    fill = np.float32(x.mean()) if len(x) else np.float32(0)
    return np.concatenate([np.full(max(0, length - len(x)), fill, np.float32), x[max(0, len(x) - length) :]])


def fill_neighbours(context: np.ndarray) -> np.ndarray:
    """Non-finite values take the last finite one before, else the first after, else 0."""
    x = np.asarray(context, np.float32)
    good = np.flatnonzero(np.isfinite(x))
    if not len(good):
        return np.zeros_like(x)
    before = np.searchsorted(good, np.arange(len(x)), "right") - 1
    return x[good[np.maximum(before, 0)]]
